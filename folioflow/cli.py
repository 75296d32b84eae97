"""Command line: index a library, search it, find strings, show its state."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from folioflow.config import DOC_TYPES, load_config
from folioflow.functions.text import citation, collapse
from folioflow.operators.literal import find_files, find_literal, with_snippets
from folioflow.operators.maintenance import status_by_type
from folioflow.plans.indexing import library_state, search_library, update_index
from folioflow.plans.runtime import session
from folioflow.sources.store import read_index


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="folioflow", description=__doc__)
    top.add_argument("--config", default="folioflow.toml")
    top.add_argument("--index", default="index")
    commands = top.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index")
    index.add_argument("library")
    index.add_argument("--rebuild", action="store_true")
    index.add_argument("--dry-run", action="store_true")
    for name in ("ask", "find"):
        one = commands.add_parser(name)
        one.add_argument("text")
        one.add_argument("--type", action="append", choices=DOC_TYPES)
    commands.choices["ask"].add_argument("-k", type=int)
    commands.choices["ask"].add_argument("--words-only", action="store_true", help="rank without vectors")
    commands.choices["find"].add_argument("--limit", type=int, default=200)
    commands.choices["find"].add_argument("--files", action="store_true")
    commands.choices["find"].add_argument("-C", "--context", type=int, default=60, help="characters shown on either side")
    commands.add_parser("status").add_argument("library", nargs="?", help="compare the index with this folder")
    return top


def main(arguments: list[str] | None = None) -> list[dict]:
    """Run a command; prints and returns its result rows, which are few by the command's own limits."""
    args = parser().parse_args(arguments)
    config, warnings = load_config(args.config)
    for warning in warnings:
        print(warning)
    spark = session("folioflow")
    if args.command == "index":
        log, skipped = update_index(spark, args.library, args.index, config, args.rebuild, args.dry_run)
        counted = log.groupBy("action").agg(F.count(F.lit(1)).alias("files"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("reason"))
        out = counted.unionByName(skipped.select(F.lit("skipped").alias("action"), F.lit(1).cast("bigint").alias("files"), "path", "reason"))
    else:
        passages = read_index(spark, args.index, "passages")
        if args.command == "status":
            out = status_by_type(passages)
            if args.library:
                stale = library_state(spark, args.library, args.index, config)
                none = F.lit(None).cast("bigint")
                out = out.unionByName(stale.select("path", "state").withColumns({"doc_type": F.lit(None).cast("string"), "passages": none, "files": none}), allowMissingColumns=True)
        elif args.command == "find":
            found = find_literal(passages, args.text, args.type, args.limit)
            out = find_files(found) if args.files else with_snippets(found, passages, len(args.text), args.context).orderBy("path", "row_id", "local")
        else:
            hits = search_library(spark, args.index, args.text, config.retrieval, args.k, args.type, **({"model": None} if args.words_only else {}))
            shown = passages.select("row_id", "section", "title", "text")
            # No more rows than the hits asked for.
            out = shown.join(F.broadcast(hits), "row_id").orderBy("tier", F.desc("score"), "row_id")
            parts = [F.round(x, 4).alias(x) for x in ("score", "semantic", "literal", "name_boost", "type_bonus")]
            out = out.select(
                citation(F.col("path"), F.col("section"), F.col("title")).alias("where"), *parts, "phrase_hit", "names_matched",
                collapse(F.col("text"), config.retrieval.snippet_chars).alias("text"),
            )
    rows = [{k: v for k, v in r.asDict().items() if v is not None} for r in out.collect()]
    for row in rows:
        print(json.dumps(row, ensure_ascii=False))
    return rows


if __name__ == "__main__":
    main()
