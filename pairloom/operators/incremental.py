"""Processing only new or changed records.

A load follows a commit sequence: a column that is unique and never runs
backwards, whatever the senders' clocks do (``delivery_id``; ``observed_at``
may run ahead and ``landed_at`` is shared by batches).  It fixes its upper bound
once, at its start; reads only the rows after the sequence up to which every key
was considered, pushed down to the files; takes those that are current and lie
after their key's own watermark; writes the records, the keys' new watermarks
and the identifiers' standing to folders of their own; and then publishes all
three together by creating one numbered manifest, which either exists or
doesn't.  A load that dies before that leaves orphaned folders that no reader
lists and the next load starts from the old watermarks: nothing is skipped and
nothing repeated.  Whether an older row is still the current one is asked of the
identifiers' standing that earlier loads committed, for the new rows'
identifiers alone; the history itself isn't read again.

Defined cases: rows without a commit sequence aren't committed yet and wait for
a later load; a key without a watermark is taken whole; nulls in a key are a
value of their own; an empty source commits nothing, nor does one without rows
after the last bound; a row that changes an identifier which an earlier load
took is taken again by the later one.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.keys import clean_key
from pairloom.operators.dedup import POSITION, comparison_identifier, current_rows, delivery_order, rows_at, shards_of, with_positions, write_bitmaps
from pairloom.operators.ordered import BROADCAST_ROWS

#: Copies of the watermark table, so that one key with a third of all rows is spread over as many tasks.
SALTS = 16


def load_watermarks(load_log: DataFrame, key: str = "run_id", status: str = "status", read_to: str = "read_to") -> DataFrame:
    """(key, watermark): up to where each key was loaded with success.

    Failed and running attempts left nothing behind; an attempt that is logged
    under two statuses counts as soon as one of them says succeeded.
    """
    done = load_log.filter((clean_key(status) == "succeeded") & F.col(read_to).isNotNull())
    return done.groupBy(clean_key(key).alias("key")).agg(F.max(read_to).alias("watermark"))


def after_watermark(rows: DataFrame, watermarks: DataFrame, key: Column, sequence: str, spread: Column) -> DataFrame:
    """Rows whose sequence lies after the watermark of their key, or whose key has none.

    The watermark table has a row for each key.  It is counted: up to ``BROADCAST_ROWS`` it is broadcast,
    beyond it is copied ``SALTS`` times and ``spread`` (any well-spread column) picks the copy, so a hot key is joined in many tasks.
    """
    watermarks = watermarks.select(F.col("key").alias("_mark_of"), "watermark")
    if watermarks.count() <= BROADCAST_ROWS:
        few = rows.join(F.broadcast(watermarks), key.eqNullSafe(F.col("_mark_of")), "left")
        return few.filter(F.col("watermark").isNull() | (F.col(sequence) > F.col("watermark"))).select(*[rows[c] for c in rows.columns])
    salted = watermarks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    names = rows.columns
    left = rows.withColumns({"_key": key, "_salt_of": F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")})
    joined = left.join(salted, left["_key"].eqNullSafe(salted["_mark_of"]) & (left["_salt_of"] == salted["_salt"]), "left")
    return joined.filter(F.col("watermark").isNull() | (F.col(sequence) > F.col("watermark"))).select(*[left[c] for c in names])


def pending_comparisons(comparisons: DataFrame, load_log: DataFrame, upper, since=None) -> DataFrame:
    """(run_id, landed_at, delivery_id) of the current rows that the next load must take.

    Narrow: the rows' payload is read again by delivery_id only where it's wanted.
    ``since``: watermark of the loads committed by ``CommittedLoad``, for all keys.
    """
    seen = comparisons.filter(F.col("landed_at") <= F.lit(upper)).withColumn("_run", clean_key("run_id"))
    current = current_rows(seen, comparison_identifier(), delivery_order(), ["delivery_id", "landed_at", "_run"])
    if since is not None:
        current = current.filter(F.col("landed_at") > F.lit(since))
    return after_watermark(current, load_watermarks(load_log), F.col("_run"), "landed_at", F.col("delivery_id")).withColumnRenamed("_run", "run_id")


@dataclass
class Commit:
    sequence: int
    upper: str | None
    data: str | None
    rows: int
    #: Folders of the keys' watermarks and of the identifiers' standing.
    marks: str | None = None
    standing: str | None = None


@dataclass
class Changes:
    """What identifies a record, which of its rows is the current one, and by which key watermarks are kept."""

    key: Column = field(default_factory=lambda: clean_key("run_id"))
    identifier: Column = field(default_factory=comparison_identifier)
    order: list[Column] = field(default_factory=delivery_order)
    sequence: str = "delivery_id"
    columns: list[str] | None = None


def watermarks_in_sequence(rows: DataFrame, watermarks: DataFrame, key: Column, landed: str = "landed_at", sequence: str = "delivery_id") -> DataFrame:
    """(key, watermark): the watermarks in ``landed``, inclusive, as the last ``sequence`` that they cover."""
    slim = rows.select(key.alias("key"), landed, sequence).groupBy("key", landed).agg(F.max(sequence).alias(sequence))
    both = slim.join(watermarks.withColumnRenamed("key", "_key"), F.col("key").eqNullSafe(F.col("_key")))
    return both.filter(F.col(landed) <= F.col("watermark")).groupBy("key").agg(F.max(sequence).alias("watermark"))


class CommittedLoad:
    """A store whose output and watermarks are published by one atomic manifest.

    The file system must tell two writers of one name apart: a POSIX one (by a
    link) or one whose rename without overwriting is atomic, as HDFS's is.
    """

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, store.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, tail: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.store}/{tail}" if tail else self.store)

    def commits(self) -> list[Commit]:
        folder = self._path("_commits")
        if not self._fs.exists(folder):
            return []
        names = sorted(str(s.getPath().getName()) for s in self._fs.listStatus(folder))
        return [Commit(**json.loads(self._read(f"_commits/{n}"))) for n in names if n.endswith(".json")]

    def _read(self, tail: str) -> str:
        stream = self._fs.open(self._path(tail))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _publish(self, commit: Commit) -> None:
        """Write the manifest whole, then give it its number, which only one of several writers can."""
        aside, final = self._path(f"_staged/{uuid.uuid4().hex}.json"), self._path(f"_commits/{commit.sequence:012d}.json")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(commit.__dict__).encode()))
        out.close()
        self._fs.mkdirs(final.getParent())
        try:
            if self._fs.getUri().getScheme() == "file":
                os.link(aside.toUri().getPath(), final.toUri().getPath())
            else:
                conf = self.spark.sparkContext._jsc.hadoopConfiguration()
                option = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
                never = self.spark.sparkContext._gateway.new_array(option, 1)
                never[0] = option.NONE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf).rename(aside, final, never)
        except (FileExistsError, Py4JJavaError) as error:
            if isinstance(error, Py4JJavaError) and not self._fs.exists(final):
                raise
            raise RuntimeError(f"commit {commit.sequence} was taken by another load") from error
        finally:
            self._fs.delete(aside, False)

    def run(self, source: DataFrame, sequence: str, select, before_commit=None) -> Commit | None:
        """One load of an append-only source.  ``select(source, upper, since)`` gives the rows to take.

        ``before_commit`` runs between output and commit (tests make it fail there).
        """
        done = self.commits()
        since = done[-1].upper if done else None
        upper = source.agg(F.max(sequence).alias("u")).first()["u"]
        if upper is None:
            return None
        kind = source.schema[sequence].dataType
        typed = lambda v: None if v is None else F.lit(v).cast(kind)
        data = f"data/{uuid.uuid4().hex}"
        select(source, typed(str(upper)), typed(since)).write.parquet(f"{self.store}/{data}")
        rows = self.spark.read.parquet(f"{self.store}/{data}").count()
        if before_commit is not None:
            before_commit()
        commit = Commit(len(done), str(upper), data, rows)
        self._publish(commit)
        return commit

    def adopt(self, watermarks: DataFrame) -> Commit:
        """Commit (key, watermark) of loads that were made before this store, as its first entry."""
        marks = f"marks/{uuid.uuid4().hex}"
        watermarks.write.parquet(f"{self.store}/{marks}")
        commit = Commit(len(self.commits()), None, None, 0, marks)
        self._publish(commit)
        return commit

    def run_changes(self, path: str, changes: Changes | None = None, before_commit=None) -> Commit | None:
        """One load of the added and changed records of the Parquet table at ``path``, whole rows."""
        changes = changes or Changes()
        spark, seq = self.spark, F.col(changes.sequence)
        source = with_positions(spark, path)
        payload = changes.columns or [c for c in source.columns if c not in POSITION]
        done = self.commits()
        floor = done[-1].upper if done else None
        if not source.inputFiles():
            return None
        upper = source.agg(F.max(seq).alias("u")).first()["u"]
        if upper is None:
            return None
        kind = source.schema[changes.sequence].dataType
        seen = source.filter(seq <= F.lit(upper))
        if floor is not None:
            seen = seen.filter(seq > F.lit(floor).cast(kind))
            if seen.limit(1).count() == 0:
                return None
        orders = [f"o{i}" for i in range(len(changes.order))]
        best = F.struct(*[c.alias(o) for c, o in zip(changes.order, orders)], seq.alias("seq"), F.col(POSITION[0]).alias("file_id"), F.col(POSITION[1]).alias("row_no"), changes.key.alias("key"))
        winners = seen.groupBy(changes.identifier.alias("id")).agg(F.max(best).alias("b")).select("id", *[F.col(f"b.{c}").alias(c) for c in [*orders, "seq", "file_id", "row_no", "key"]])
        standing = f"standing/{uuid.uuid4().hex}"
        winners.write.parquet(f"{self.store}/{standing}")
        winners = spark.read.schema(winners.schema).parquet(f"{self.store}/{standing}")
        taken = winners
        earlier = [f"{self.store}/{c.standing}" for c in done if c.standing]
        if earlier:
            # of the earlier rows only those that share an identifier with a new one
            old = spark.read.parquet(*earlier).select("id", F.struct(*orders, "seq").alias("old"))
            ids = winners.select("id")
            old = old.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "id", "left_semi")
            old = old.groupBy("id").agg(F.max("old").alias("old"))
            taken = winners.join(old, "id", "left").filter(F.col("old").isNull() | (F.col("old") < F.struct(*orders, "seq"))).drop("old")
        marked = [c.marks for c in done if c.marks]
        if marked:
            taken = after_watermark(taken, spark.read.parquet(f"{self.store}/{marked[-1]}"), F.col("key"), "seq", F.col("row_no"))
        shards = shards_of(source)
        data, marks = f"data/{uuid.uuid4().hex}", f"marks/{uuid.uuid4().hex}"
        rows_at(seen, payload, write_bitmaps(taken.select("file_id", "row_no"), shards), shards).write.parquet(f"{self.store}/{data}")
        now = winners.groupBy("key").agg(F.max("seq").alias("watermark"))
        if marked:
            now = now.unionByName(spark.read.parquet(f"{self.store}/{marked[-1]}").select("key", "watermark")).groupBy("key").agg(F.max("watermark").alias("watermark"))
        now.write.parquet(f"{self.store}/{marks}")
        rows = spark.read.parquet(f"{self.store}/{data}").count()
        if before_commit is not None:
            before_commit()
        commit = Commit(len(done), str(upper), data, rows, marks, standing)
        self._publish(commit)
        return commit

    def read(self) -> DataFrame:
        """All committed output; orphans of loads that died aren't seen."""
        paths = [f"{self.store}/{c.data}" for c in self.commits() if c.data]
        if not paths:
            raise FileNotFoundError("nothing is committed yet")
        return self.spark.read.parquet(*paths)
