"""Command line: write, build, query, serve, static-build, static-activate."""

from __future__ import annotations

import argparse
import json
import sys

from quillspan.engine import HybridEngine
from quillspan.functions.embed import HashingEmbedder
from quillspan.operators.turbo import Codec
from quillspan.service import handle, serve
from quillspan.sources.release import ReleaseSource
from quillspan.sources.static import StaticSource, read_lines


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillspan", description=__doc__)
    parser.add_argument("command", choices=["write", "build", "query", "serve", "static-build", "static-activate"])
    parser.add_argument("--root", required=True, help="the store's folder")
    parser.add_argument("--body", help="a JSON file with the request; standard input if absent")
    parser.add_argument("--dim", type=int, default=64)
    parser.add_argument("--port", type=int, default=8080)
    parser.add_argument("--source", help="static-build: a file or folder of JSON lines")
    parser.add_argument("--corpus-type", default="legal")
    parser.add_argument("--release", default="static/staged", help="static-build and static-activate: the key of the release's folder")
    args = parser.parse_args(argv)

    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("quillspan").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    embedder = HashingEmbedder(args.dim)
    engine = HybridEngine(spark, args.root, embedder, warn=lambda m: print(m, file=sys.stderr))
    if args.command == "serve":
        serve(engine, args.port).serve_forever()
        return 0
    if args.command == "static-build":
        rows = read_lines(spark, StaticSource(args.source, args.corpus_type)).drop("corpus_type")
        from pyspark.sql import functions as F

        rows = rows.withColumn("embedding", embedder.column(F.col("text")))
        source = ReleaseSource("table", args.source, 1, rows.count(), args.corpus_type)
        out = engine.static_build(rows, Codec.generate(args.dim), f"hashing-{args.dim}", source, args.release)
        print(json.dumps(out, ensure_ascii=False))
        return 0
    if args.command == "static-activate":
        ok = engine.static_activate(args.release)
        print(json.dumps({"activated": ok}))
        return 0 if ok else 1
    raw = open(args.body, "rb").read() if args.body else sys.stdin.buffer.read()
    status, out = handle(engine, "POST", f"/{args.command}", raw)
    print(json.dumps(out, ensure_ascii=False))
    return 0 if status == 200 else 1


if __name__ == "__main__":
    sys.exit(main())
