"""Contexts for language models from retrieved chunks, within a token budget.

At most 200 chunks reach this point, so the alternating cut from the tails of the
two groups runs on the driver; token estimates of tables are column expressions
in ``quillspan.functions.text``.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import Any

from quillspan.functions.text import CJK_RANGES
from quillspan.model import CORPUS_LABELS, OTHER_LABEL, CorpusWeights

# The wording of contexts and prompts.
HEADER = "=== 参考资料 ===\n\n"
FOOTER = "=== 问题 ===\n"
DYNAMIC_LABEL = "用户数据"
STATIC_FIRST = "如法规/合同与用户数据冲突，以法规/合同为准。"
DYNAMIC_FIRST = "优先参考用户数据，不足时补充引用法规/合同。"
BALANCED = "综合两类来源回答，不偏向任何一方。"
SYSTEM_PROMPT = """你是一个专业的文档检索助手。

参考资料分为两类：
- [法规/合同/RFC]：来自共享权威文档库（法律法规、合同模板、RFC等）
- [用户数据]：来自用户的私有文档

{weight}

回答时只引用与问题直接相关的内容，忽略无关片段。
引用时注明来源类型。"""
STRONG_BIAS = 0.7

Chunk = Mapping[str, Any]


def estimate_tokens(text: str) -> int:
    """One token for each ideograph and for every four other characters or part of four."""
    whole = sum(any(a <= ord(c) <= b for a, b in CJK_RANGES) for c in text)
    return whole + math.ceil((len(text) - whole) / 4)


def chunk_block(label: str, number: int, chunk: Chunk) -> str:
    title = (chunk.get("citation") or {}).get("title")
    return f"[{label} #{number}]{'' if title is None else ' ' + title}\n{chunk['text']}\n\n"


def blocks(static: Sequence[Chunk], dynamic: Sequence[Chunk]) -> tuple[list[str], list[str]]:
    """The chunks' blocks, numbered from 1 in each group."""
    return (
        [chunk_block(CORPUS_LABELS.get(c.get("corpus_type"), OTHER_LABEL), n, c) for n, c in enumerate(static, 1)],
        [chunk_block(DYNAMIC_LABEL, n, c) for n, c in enumerate(dynamic, 1)],
    )


def build(static: Sequence[Chunk], dynamic: Sequence[Chunk], query: str) -> str:
    first, second = blocks(static, dynamic)
    return "".join([HEADER, *first, *second, FOOTER, query])


def build_bounded(static: Sequence[Chunk], dynamic: Sequence[Chunk], query: str, max_tokens: int) -> str:
    """As ``build``, but while the estimate is over the budget the costlier group loses its last chunk.

    Of equally costly groups the one with more chunks loses, the dynamic one if those are equal, too.
    """
    groups = [list(g) for g in blocks(static, dynamic)]
    costs = [[estimate_tokens(b) for b in g] for g in groups]
    fixed = estimate_tokens(HEADER + FOOTER + query)
    while any(costs) and fixed + sum(map(sum, costs)) > max_tokens:
        # An empty group costs nothing and has no chunks, so it never loses.
        weight = [(sum(c), len(c)) for c in costs]
        loser = 0 if costs[0] and (not costs[1] or weight[0] > weight[1]) else 1
        costs[loser].pop()
        groups[loser].pop()
    return "".join([HEADER, *groups[0], *groups[1], FOOTER, query])


def system_prompt(weights: CorpusWeights | None = None) -> str:
    sentence = BALANCED
    if weights and weights.static_bias > STRONG_BIAS:
        sentence = STATIC_FIRST
    elif weights and weights.dynamic_bias > STRONG_BIAS:
        sentence = DYNAMIC_FIRST
    return SYSTEM_PROMPT.format(weight=sentence)
