"""Messages delivered more than once: exactly one row of each identifier stays.

The wide rows are never shuffled.  A first, narrow scan ships per row only the
digest of the identifier, the order of delivery and the row's position (file
and row number in it).  A max-aggregate with map-side combine picks the winner
of each identifier, so an identifier that holds a third of all rows is reduced
before it travels.  The winners' positions become one bitmap for each 32,768
rows of each file; what is not set there is the file's deletion vector.  The
wide scan then drops (or, to see what was dropped, keeps) the deleted rows
file by file, with no join and no shuffle.

Defined cases: nulls in the identifier are a value of their own; a null order
counts as lowest; rows equal in the whole order are told apart by position, so
exactly one stays; an empty table gives an empty result; other columns are
carried along whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.keys import clean_key, digest_key
from pairloom.session import arrow_fs, default_parallelism, scratch_dir

#: Rows that one bitmap covers: the size of Spark's own bitmap functions.
BITMAP_ROWS = 32768
FILES_PER_SHARD = 64
#: Columns that hold a row's file and its number there; a table's own columns keep their names.
POSITION = ("_position_file", "_position_row")


def comparison_identifier() -> Column:
    """Digest of (run_id, comparison_index, entity_a_hash, entity_b_hash)."""
    return digest_key(clean_key("run_id"), F.col("comparison_index"), clean_key("entity_a_hash"), clean_key("entity_b_hash"))


def delivery_order() -> list[Column]:
    """The current row: latest observed_at, then smallest delivery_id."""
    return [F.col("observed_at"), -F.col("delivery_id")]


def current_rows(df: DataFrame, identifier: Column, order: list[Column], carry: list[str]) -> DataFrame:
    """One row ``carry`` for each identifier: the greatest by ``order``.

    Narrow: only the digest, the order and ``carry`` are shuffled, after a
    map-side combine.  Rows equal in the whole order are ordered by ``carry``.
    """
    best = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"c_{c}") for c in carry])
    return df.groupBy(identifier.alias("_id")).agg(F.max(best).alias("_best")).select(*[F.col(f"_best.c_{c}").alias(c) for c in carry])


def with_positions(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the Parquet table at ``path`` with their ``POSITION``: digest of the file's name and number in it."""
    return spark.read.parquet(path).withColumns({POSITION[0]: F.xxhash64(F.col("_metadata.file_path")), POSITION[1]: F.col("_metadata.row_index")})


def shards_of(source: DataFrame) -> int:
    """Folders of bitmaps for the data files of ``source``."""
    return max(1, len(source.inputFiles()) // FILES_PER_SHARD)


def write_bitmaps(rows: DataFrame, shards: int) -> str:
    """Write the positions (file_id, row_no) as one bitmap for each 32,768 rows of each file; gives the folder.

    Each shard holds the bitmaps of about 64 data files, sorted by file, so a
    reader opens one small file for each data file that it scans.
    """
    spark = rows.sparkSession
    bucket = F.floor(F.col("row_no") / BITMAP_ROWS).cast("long")
    live = (
        rows.select("file_id", bucket.alias("bucket"), (F.col("row_no") % BITMAP_ROWS).alias("bit"))
        # by hand: with one exchange of 12-byte rows there is no partial aggregate of 4 kB bitmaps in the map tasks
        .repartition(default_parallelism(spark), "file_id", "bucket")
        .groupBy("file_id", "bucket")
        .agg(F.bitmap_construct_agg(F.col("bit")).alias("live"))
    )
    out = scratch_dir(spark, "deletion-vectors")
    (
        live.withColumn("shard", F.pmod("file_id", F.lit(shards)))
        .repartition(min(shards, 4096), "shard")
        .sortWithinPartitions("shard", "file_id", "bucket")
        .write.partitionBy("shard")
        .parquet(out)
    )
    return out


def rows_at(source: DataFrame, columns: list[str], folder: str, shards: int, outside: bool = False) -> DataFrame:
    """``columns`` of the rows of ``source`` (with positions) that the bitmaps hold, or of the others: file by file, with no join."""
    live = _live_udf(folder, shards)(F.col(POSITION[0]), F.col(POSITION[1]))
    return source.select(POSITION[0], POSITION[1], *columns).filter(~live if outside else live).select(*columns)


def build_deletion_vectors(spark: SparkSession, path: str, identifier: Column, order: list[Column]) -> tuple[str, int]:
    """Write the live bitmaps of every file below ``path``; returns their folder and the number of shards."""
    source = with_positions(spark, path)
    shards = shards_of(source)
    best = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], (-F.col(POSITION[0])).alias("f"), (-F.col(POSITION[1])).alias("r"))
    winners = source.groupBy(identifier.alias("_id")).agg(F.max(best).alias("_best")).select((-F.col("_best.f")).alias("file_id"), (-F.col("_best.r")).alias("row_no"))
    return write_bitmaps(winners, shards), shards


def _live_udf(folder: str, shards: int):
    """Whether a row is live; loads the bitmaps of a data file when its first row comes."""

    @F.pandas_udf("boolean")
    def live(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import numpy as np
        import pyarrow.dataset as ds

        fs, root = arrow_fs(folder)
        loaded: dict[int, np.ndarray] = {}

        def bits(file_id: int) -> np.ndarray:
            if file_id not in loaded:
                if len(loaded) > 4:
                    loaded.clear()
                part = f"{root}/shard={file_id % shards}"
                table = ds.dataset(part, filesystem=fs, format="parquet").to_table(filter=ds.field("file_id") == file_id)
                size = (max(table["bucket"].to_pylist(), default=-1) + 1) * BITMAP_ROWS
                flat = np.zeros(size, dtype=bool)
                for bucket, raw in zip(table["bucket"].to_pylist(), table["live"].to_pylist()):
                    got = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), bitorder="little")
                    flat[bucket * BITMAP_ROWS : bucket * BITMAP_ROWS + len(got)] = got
                loaded[file_id] = flat
            return loaded[file_id]

        for files, rows in parts:
            f, r = files.to_numpy(), rows.to_numpy()
            keep = np.zeros(len(f), dtype=bool)
            for file_id in np.unique(f):
                at = np.flatnonzero(f == file_id)
                have = bits(int(file_id))
                inside = at[r[at] < len(have)]
                keep[inside] = have[r[inside]]
            yield pd.Series(keep)

    return live


def deduplicate_files(spark: SparkSession, path: str, identifier: Column | None = None, order: list[Column] | None = None, columns: list[str] | None = None, deleted: bool = False) -> DataFrame:
    """Rows of the Parquet table at ``path`` with one row for each identifier.

    ``deleted``: the rows that go instead of those that stay.  ``columns``: the
    payload to read; all by default.
    """
    identifier = comparison_identifier() if identifier is None else identifier
    order = delivery_order() if order is None else order
    source = with_positions(spark, path)
    payload = columns or [c for c in source.columns if c not in POSITION]
    if not source.inputFiles() or source.limit(1).count() == 0:
        return source.select(*payload)
    folder, shards = build_deletion_vectors(spark, path, identifier, order)
    return rows_at(source, payload, folder, shards, deleted)
