"""Column functions on text: terms, token estimates, citations, keys of days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.model import CITATION, CORPUS_LABELS, OTHER_LABEL

#: Terms of this many bytes or more are not indexed.
TERM_MAX_BYTES = 40

# Characters that count as a token each (ideographs, their punctuation, full-width forms).
CJK_RANGES = ((0x3000, 0x303F), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF), (0x20000, 0x2FA1F), (0x30000, 0x3134F))
CJK = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK_RANGES) + "]"


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order, without overlong ones."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & (F.octet_length(t) < TERM_MAX_BYTES))


def token_estimate(text: Column) -> Column:
    """One token for each ideograph and for every four other characters or part of four."""
    other = F.char_length(F.regexp_replace(text, CJK, ""))
    return (F.char_length(text) - other + F.ceil(other / 4)).cast("long")


def segment_key(millis: Column, segment: Column) -> Column:
    """Where a write-ahead segment lies: by its UTC day."""
    return F.concat(F.lit("wal/"), F.date_format(F.timestamp_millis(millis), "yyyy/MM/dd"), F.lit("/"), segment, F.lit(".jsonl"))


def event_id(batch: Column, index: Column) -> Column:
    return F.format_string("%s-%06d", batch, index)


def json_string(metadata: Column, name: str) -> Column:
    """A key's value if it is a JSON string, else null."""
    value = F.try_variant_get(F.try_parse_json(metadata), f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def citation(metadata: Column) -> Column:
    """The citation in metadata; all of its three required keys must be strings."""
    parts = {f.name: json_string(metadata, f.name) for f in CITATION.fields}
    whole = parts["resource_id"].isNotNull() & parts["source_type"].isNotNull() & parts["source_ref"].isNotNull()
    return F.when(whole, F.struct(*[v.alias(k) for k, v in parts.items()]))


def title(metadata: Column) -> Column:
    return F.nullif(json_string(metadata, "title"), F.lit(""))


def static_citation(metadata: Column, doc_id: Column, corpus_type: Column) -> Column:
    """The citation in metadata, else one of the title alone, whose source type is the corpus's label."""
    own = title(metadata)
    fallback = F.struct(
        doc_id.alias("resource_id"),
        corpus_label(corpus_type).alias("source_type"),
        doc_id.alias("source_ref"),
        own.alias("title"),
        F.lit(None).cast("string").alias("url"),
    )
    return F.coalesce(citation(metadata), F.when(own.isNotNull(), fallback))


def corpus_label(corpus_type: Column) -> Column:
    out = F.lit(OTHER_LABEL)
    for name, label in CORPUS_LABELS.items():
        out = F.when(corpus_type == name, label).otherwise(out)
    return out


def block(label: Column, number: Column, head: Column, text: Column) -> Column:
    """One chunk of a context; ``head`` is the citation's title or null."""
    mark = F.concat(F.lit("["), label, F.lit(" #"), number.cast("string"), F.lit("]"))
    return F.concat(mark, F.coalesce(F.concat(F.lit(" "), head), F.lit("")), F.lit("\n"), text, F.lit("\n\n"))
