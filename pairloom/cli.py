"""Command line over tables: ``python -m pairloom.cli cache-export|cache-prune|land ...``."""

from __future__ import annotations

import argparse

from pairloom.session import build_session, drop_path, scratch_dir
from pairloom.sources import cache
from pairloom.sources.records import land_runs


def main(argv: list[str] | None = None, spark=None) -> int:
    """Rows written.  A table is replaced only when its successor has been written whole."""
    parser = argparse.ArgumentParser(prog="pairloom")
    verbs = parser.add_subparsers(dest="verb", required=True)
    export = verbs.add_parser("cache-export", help="the cache as JSON lines")
    export.add_argument("cache")
    export.add_argument("out")
    prune = verbs.add_parser("cache-prune", help="keep the newest entries, written to a new table")
    prune.add_argument("cache")
    prune.add_argument("out")
    prune.add_argument("--keep", type=int, required=True)
    prune.add_argument("--since", help="drop entries last used before this timestamp")
    land = verbs.add_parser("land", help="land the runs of a Parquet table that a store doesn't hold")
    land.add_argument("rows")
    land.add_argument("store")
    given = parser.parse_args(argv)
    spark = spark or build_session(app="pairloom-cli")
    if given.verb == "land":
        return land_runs(spark, spark.read.parquet(given.rows), given.store)
    table = spark.read.parquet(given.cache)
    if given.verb == "cache-export":
        cache.export(table, given.out)
        return spark.read.json(given.out).count()
    # aside first: the new table may be the old one's place
    aside = scratch_dir(spark, "pruned")
    cache.prune(table, given.since, given.keep).write.parquet(aside)
    kept = spark.read.parquet(aside)
    kept.write.mode("overwrite").parquet(given.out)
    n = kept.count()
    drop_path(spark, aside)
    return n


if __name__ == "__main__":
    print(main())
