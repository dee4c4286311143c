"""Command line: `ingest` and `setup-index`."""

from __future__ import annotations

import argparse
import sys

from codequarry.config import load_config
from codequarry.operators.store import ChunkStore
from codequarry.plans.ingest import ingest

SHOWN_ERRORS = 10


def main(argv: list[str] | None = None, spark=None) -> int:
    parser = argparse.ArgumentParser(prog="codequarry")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("ingest", help="index the repositories")
    run.add_argument("--repo")
    run.add_argument("--dry-run", action="store_true")
    run.add_argument("--config", default="config.yaml")
    setup = commands.add_parser("setup-index", help="create the chunk table")
    setup.add_argument("-c", "--config", default="config.yaml")
    setup.add_argument("-f", "--force", action="store_true")
    args = parser.parse_args(argv)
    config = load_config(args.config)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("codequarry").getOrCreate()
    store = ChunkStore(spark, f"{config.store.url.rstrip('/')}/{config.store.index}")
    if args.command == "setup-index":
        print("created" if store.create(args.force) else "exists already; --force makes it anew")
        return 0
    result = ingest(spark, config, store, args.repo, args.dry_run)
    print(f"repositories {result.repositories}, files {result.files}, chunks {result.chunks}, indexed {result.indexed}, failed {result.failed}")
    for e in result.errors[:SHOWN_ERRORS]:
        print(" ", e, file=sys.stderr)
    if result.failed > SHOWN_ERRORS:
        print(f"  and {result.failed - SHOWN_ERRORS} more", file=sys.stderr)
    return 1 if result.failed else 0


if __name__ == "__main__":
    sys.exit(main())
