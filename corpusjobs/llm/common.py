"""Helpers that the operators share: reading, tables in the shared folder, batching, skewed joins, connected components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import cut, shared_folder

__all__ = ["by_bytes", "components", "cut", "free_name", "freed", "gathered", "joined_by_share", "packed_rows", "removed", "shared_folder", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """df written as compressed Parquet to the shared folder and read again: smaller than a checkpoint for wide tables.

    The folder is added to `paths`, by which the caller removes it when nothing reads the table any more.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def freed(spark: SparkSession) -> None:
    """Spark drops the shuffle files of tables that nothing refers to any more when the driver collects its garbage; this asks for it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose values of one string or binary column hold at most about `most` bytes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        total = batch.column(column).nbytes
        if total <= most:
            yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        at, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        yield batch.slice(at)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least `rows` rows, but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def packed_rows(rows: list[tuple[int, int, bytes]], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """(name, pair, data) rows in batches of about `most` bytes."""
    at = held = 0
    for i, row in enumerate(rows):
        held += len(row[2])
        if held >= most or i == len(rows) - 1:
            name, pair, data = zip(*rows[at : i + 1], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array(pair, pa.int64()), pa.array(data, pa.binary())], ["name", "pair", "data"])
            at, held = i + 1, 0


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores behind it that no column of df bears (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key with more than this share of the rows is joined by broadcast: there are fewer than 2,048 of them.
COMMON = 1 / 2048


def joined_by_share(rows: DataFrame, table: DataFrame, keys: list[str], n_col: str) -> DataFrame:
    """rows joined with table on keys, without n_col.

    table has one row for a key, and n_col says how many rows have it. The few keys with a large share of all rows are
    broadcast, so that no task gets them all; the rest are shuffled.
    """
    most = max(1, int(rows.count() * COMMON))
    common = F.broadcast(table.filter(F.col(n_col) > most).drop(n_col))
    rare = rows.join(common.select(*keys), keys, "left_anti").join(table.filter(F.col(n_col) <= most).drop(n_col), keys)
    return rows.join(common, keys).unionByName(rare)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node of its component.

    Alternating large-star and small-star steps (Kiveris et al. 2014): the state is an edge list that never
    outgrows its input, hubs shrink by pre-aggregated minima, and the number of rounds is logarithmic.
    """
    now = cut(edges.select("a", "b").filter("a <> b").distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        now = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
