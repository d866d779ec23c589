"""``python -m clausewright.cli --kb DIR --raw DIR [--rebuild] [--sources ID ...]``"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Build or update the knowledge base")
    parser.add_argument("--kb", required=True, help="folder of the knowledge base")
    parser.add_argument("--raw", required=True, help="folder of local raw documents")
    parser.add_argument("--cache", help="folder of the fetch cache")
    parser.add_argument("--rebuild", action="store_true", help="replace the whole knowledge base")
    parser.add_argument("--embedder", required=True, choices=("model", "hashing"), help="a store must keep to one of them")
    parser.add_argument("--sources", nargs="+", help="ids of the sources to ingest")
    args = parser.parse_args(argv)

    from pyspark.sql import SparkSession

    from clausewright.operators.embedding import hashing_embedder, model_embedder
    from clausewright.plans.ingestion import run_ingestion
    from clausewright.plans.knowledge import KnowledgeBase
    from clausewright.sources.registry import registry

    embed = model_embedder() if args.embedder == "model" else hashing_embedder()
    spark = SparkSession.builder.appName("clausewright").getOrCreate()
    kb = KnowledgeBase(spark, args.kb, embed)
    totals = run_ingestion(
        kb, registry(spark), args.raw, args.cache or f"{args.kb}/fetch_cache", args.rebuild, args.sources
    )
    rejected = totals.pop("error_rows")
    for key, value in totals.items():
        print(f"{key}: {value}")
    if totals["errors"]:
        rejected.show(truncate=False)
    kb.list_sources().show(truncate=55)
    return 1 if totals["errors"] else 0


if __name__ == "__main__":
    sys.exit(main())
