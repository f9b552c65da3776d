"""What several jobs need of Spark itself: a cut lineage and row numbers without one task for all rows."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names in spark.checkpoint.dir.

    Without one a job on a cluster fails, as no folder of one machine would do; in local mode a temporary one is made.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, *order: Column | str, name: str = "number") -> DataFrame:
    """df with the place of each row from 0 in a total order: sorted in ranges, whose sizes are then added up."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, 33)
    sizes = {r.part: r.n for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # one row for each partition
    base, total = [], 0
    for p in sorted(sizes):
        base += [F.lit(p), F.lit(total)]
        total += sizes[p]
    if not base:
        return placed
    return placed.withColumn(name, F.element_at(F.create_map(*base), part) + F.col(name).bitwiseAND((1 << 33) - 1))


#: Rows of a key on one side that still meet in one task, and frequent keys that are still broadcast.
PART, MOST_FREQUENT = 50_000, 10_000


def joined_in_parts(left: DataFrame, right: DataFrame, key: str, part: int = PART) -> DataFrame:
    """left and right joined on a key; a key with more than `part` rows on a side is dealt out as pairs of parts.

    Of such a key each side is cut into parts by a hash of its rows, and each part of one side meets each of the other in a
    task of its own, so that a task gets about `part` rows of a side at most and every pair of rows meets once. Keys are
    counted in the tasks first. The frequent ones are broadcast if they are few, else joined.
    """
    n = lambda rows, name: rows.groupBy(key).agg(F.count("*").alias(name))
    parts = lambda c: F.ceil(F.col(c) / part).cast("int")
    sizes = n(left, "__l").join(n(right, "__r"), key).filter((F.col("__l") > part) | (F.col("__r") > part))
    frequent = cut(sizes.select(key, parts("__l").alias("__l"), parts("__r").alias("__r")))
    if frequent.isEmpty():
        return left.join(right, key)
    if frequent.count() <= MOST_FREQUENT:
        frequent = F.broadcast(frequent)

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        at = F.pmod(F.xxhash64(*rows.columns), F.coalesce(own, F.lit(1))).alias(f"{own}_at")
        return rows.join(frequent, key, "left").select(*rows.columns, at, F.explode(F.sequence(F.lit(0).cast("long"), (F.coalesce(other, F.lit(1)) - 1).cast("long"))).alias(f"{other}_at"))

    return dealt(left, "__l", "__r").join(dealt(right, "__r", "__l"), [key, "__l_at", "__r_at"]).drop("__l_at", "__r_at")


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder by the file system that it is in."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def parts_of_bytes(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts whose texts hold at most about `most` bytes; a longer text is alone."""
    texts = [pc.fill_null(pc.binary_length(c), 0).to_pylist() for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)]
    at = held = 0
    for i, n in enumerate(map(sum, zip(*texts, strict=True))):
        if held and held + n > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    yield batch.slice(at)
