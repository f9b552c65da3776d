"""Streams over run results, pairs and new seed files.

What is known of keys is Spark's own keyed state: in RocksDB, dealt out by key, with the changes of each batch written to
the checkpoint folder. A batch reads and writes the state of its own keys, whatever earlier batches held, and what it
adds goes to a table of Parquet files with one folder for each batch id, so that a batch that is replayed after a failure
overwrites its own rows and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import corpus


def stored(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The rows of a stored table, of batches before a given one if asked for; none where it does not exist yet."""
    try:
        rows = spark.read.schema(f"{schema}, batch long").option("recursiveFileLookup", False).parquet(path)
        rows.schema  # noqa: B018
    except AnalysisException:
        rows = spark.createDataFrame([], f"{schema}, batch long")
    return (rows if before is None else rows.filter(F.col("batch") < before)).drop("batch")


def put(rows: DataFrame, path: str, batch: int) -> None:
    """Writes the rows as the batch's own, in place of what an earlier try of the same batch wrote."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def insert_new(stream: DataFrame, path: str, checkpoint: str, schema: str, new: Callable[[DataFrame, DataFrame], DataFrame]) -> DataStreamWriter:
    """Each batch adds new(batch, what earlier batches stored) to the table."""

    def run(rows: DataFrame, batch: int) -> None:
        put(new(rows, stored(rows.sparkSession, path, schema, batch)), path, batch)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True)


#: State larger than memory: RocksDB, and of each batch only the changes are uploaded.
KEYED_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def new_keys(stream: DataFrame, keys: list[str], **firsts: Column) -> DataFrame:
    """In each batch the keys that no batch before it had, with aggregates over the batch's rows; for the update mode.

    The state of a key has the time of its first batch, which is the same when a batch is replayed: the time of a batch is
    written down before it runs. Rows are aggregated in the tasks first, so that a key that most rows share stays cheap.
    The clock of the driver must not go back between batches, as after a change of its time.
    """
    for name, value in KEYED_STATE.items():
        stream.sparkSession.conf.set(name, value)
    counted = stream.withColumn("__since", F.current_timestamp()).groupBy(*keys).agg(F.min("__since").alias("__since"), *(c.alias(n) for n, c in firsts.items()))
    return counted.filter(F.col("__since") == F.current_timestamp()).drop("__since")


def to_table(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Each batch's updates as the batch's own folder of the table."""
    return stream.writeStream.outputMode("update").foreachBatch(lambda rows, batch: put(rows, path, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True)


FIRST = "key string, first long, n long"


def crash_key(runs: DataFrame, order: str) -> DataFrame:
    return runs.withColumn("key", F.coalesce(F.col("signature"), F.concat(F.lit("NoSig_"), F.col(order).cast("string"))))


def stream_first_seen(runs: DataFrame, known: DataFrame | None, path: str, checkpoint: str, order: str = "run_id") -> DataStreamWriter:
    """K1: the first run of each signature (signature, run_id), for the whole run; crashes without one are all kept.

    known: signatures that are no news, met by a join with each batch.
    """
    keyed = crash_key(runs, order)
    if known is not None:
        keyed = keyed.join(known.select(F.col("signature").alias("key")).distinct(), "key", "left_anti")
    return to_table(new_keys(keyed, ["key"], first=F.min(order).cast("long"), n=F.count("*")), path, checkpoint)


def stream_first_within(runs: DataFrame, horizon: str, order: str = "run_id", ts: str = "ts") -> DataFrame:
    """K1, bounded: (key, ts, run) of runs whose signature no run within the horizon had, by the time in ts.

    A signature is forgotten when the watermark, the latest ts less the horizon, has passed the ts of the run that was
    given by more than the horizon; then it is news again. Rows behind the watermark are dropped. So the state is that of
    the signatures of two horizons or so.
    """
    for name, value in KEYED_STATE.items():
        runs.sparkSession.conf.set(name, value)
    keyed = crash_key(runs, order).select("key", F.col(ts).cast("timestamp").alias("ts"), F.col(order).alias("run"))
    return keyed.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["key"])


def stream_status(runs: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """K2: samples, crashes and valid rate of each window of ts; rows later than the watermark are dropped.

    runs: ts, crashed, syntax_error. A ts without a time zone is taken in that of the session.
    """
    timed = runs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", window)).agg(F.count("*").alias("samples"), F.count_if("crashed").alias("crashes"), (100.0 * (1 - F.count_if("syntax_error") / F.count("*"))).alias("valid_rate"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "samples", "crashes", "valid_rate")


PAIR = "id_lo long, id_hi long"


def stream_pair_coverage(pairs: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """K3: the distinct unordered pairs so far; their number is the count of the stored table."""
    apart = pairs.filter("id_a <> id_b").select(F.least("id_a", "id_b").alias("id_lo"), F.greatest("id_a", "id_b").alias("id_hi"))
    return to_table(new_keys(apart, ["id_lo", "id_hi"]).select("id_lo", "id_hi"), path, checkpoint)


SEED = "identifier string, content string"


def stream_ingest(spark: SparkSession, folder: str, path: str, checkpoint: str, glob: str = "*") -> DataStreamWriter:
    """K4: new text files of a folder as seeds; an identifier that is stored already is passed over."""
    files = spark.readStream.option("pathGlobFilter", glob).text(folder, wholetext=True)
    named = files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("identifier"), F.col("value").alias("content"))
    return insert_new(named, path, checkpoint, SEED, lambda rows, before: corpus.append_seeds(rows, before, "content").select("identifier", "content"))
