"""Queries over sources, sinks and streams: rows derived from the tables are written to the shared folder and read back."""

from __future__ import annotations

import contextvars
import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import cut, removed, shared_folder
from ..sources import files
from ..streaming import streams
from .triage_queries import RUNS, crashes, signed
from .views import cte, view

QUERIES, ORACLES = {}, {}


def query(sql: str):
    """Register a query and its SQL under its function's name; the folders that it makes are removed when its rows are there."""

    def put(f):
        @functools.wraps(f)
        def run(spark, sf_dir):
            made: list[str] = []
            token = MADE.set(made)
            try:
                return cut(f(spark, sf_dir))
            finally:
                MADE.reset(token)
                for path in made:
                    removed(spark, path)

        QUERIES[f.__name__], ORACLES[f.__name__] = run, sql
        return run

    return put


#: The folders of the query that runs.
MADE: contextvars.ContextVar[list[str]] = contextvars.ContextVar("made")


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    MADE.get([]).append(path)
    return path


def one_file_each(rows: DataFrame, file_no: str, path: str, *order: str) -> None:
    """Writes (file_no, value) as text: the rows of a number from 0 are one file, in order."""
    n = (rows.agg(F.max(file_no)).first()[0] or 0) + 1
    rows.repartitionById(n, F.col(file_no).cast("int")).sortWithinPartitions(file_no, *order).select("value").write.text(path)


NATIONS = "SELECT s_nationkey, s_suppkey, concat('s', s_suppkey, ' ', s_name) AS value FROM supplier"


@query(f"WITH n AS ({NATIONS}) SELECT string_agg(value || chr(10), '' ORDER BY s_suppkey) AS content FROM n GROUP BY s_nationkey")
def s1_read_seed_files(spark, sf_dir):
    """The suppliers of each nation as one text file."""
    path = new_folder(spark, "seed-files")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    one_file_each(spark.sql(f"WITH supplier AS (SELECT * FROM {{supplier}}) {NATIONS}", supplier=supplier), "s_nationkey", path, "s_suppkey")
    return files.read_seed_files(spark, path, [".txt"]).select("content")


@query(cte("seeds") + "SELECT identifier, content, type, CAST(seed_no AS INTEGER) AS word_count, rc FROM seeds")
def s4_s6_load_seeds(spark, sf_dir):
    """All documents as stored seeds with JSON metadata, whose file name says otherwise."""
    path = new_folder(spark, "stored-seeds")
    meta = F.to_json(F.struct(F.lit("other").alias("filename"), "type", F.col("seed_no").cast("int").alias("word_count"), "rc"))
    view(spark, sf_dir, "seeds").select("identifier", "content", meta.alias("metadata")).write.parquet(path)
    back = files.load_seeds(spark, path)
    return back.select(F.col("metadata.filename").alias("identifier"), "content", "metadata.type", "metadata.word_count", "metadata.rc")


@query(RUNS + ", d AS (SELECT signature, min(run_id) AS run_id FROM signed WHERE crashed AND signature IS NOT NULL GROUP BY signature) SELECT signature FROM d WHERE NOT contains(signature, '`')")
def s16_read_crash_reports(spark, sf_dir):
    """Every distinct crash as a report file, and the signatures that are read from them; one with a backtick cannot be written so."""
    path = new_folder(spark, "reports")
    firsts = crashes(spark, sf_dir).filter("signature IS NOT NULL AND NOT contains(signature, '`')").groupBy("signature").agg(F.min("run_id").alias("seed_id"))
    none = F.array().cast("array<string>")
    reports = files.bug_report(firsts.select("seed_id", "signature", F.lit(1).alias("return_code"), F.lit("code").alias("content"), F.lit("out").alias("output"), F.lit("run").alias("command"), none.alias("parents")))
    reports.repartitionByRange(16, "value").write.option("maxRecordsPerFile", 1).text(path)
    return files.read_crash_reports(spark, path, "*.txt")


@query(cte("runs") + "SELECT '# Bug ' || run_id || chr(10) || chr(10) || '**Signature:** `S' || run_id % 3 || '`' || chr(10) || chr(10) || '**Return code:** ' || return_code || chr(10) || chr(10) || '## Code' || chr(10) || '```' || chr(10) || stdout || chr(10) || '```' || chr(10) || chr(10) || '## Output' || chr(10) || '```' || chr(10) || stderr || chr(10) || '```' || chr(10) || chr(10) || '## Command' || chr(10) || '```' || chr(10) || 'run ' || project || chr(10) || '```' || chr(10) || chr(10) || '## Parents' || chr(10) || '- ' || parent_a || chr(10) || '- ' || parent_b AS value FROM runs")
def s21_bug_report(spark, sf_dir):
    runs = view(spark, sf_dir, "runs").select(F.col("run_id").alias("seed_id"), F.concat(F.lit("S"), F.col("run_id") % 3).alias("signature"), "return_code", F.col("stdout").alias("content"), F.col("stderr").alias("output"), F.concat(F.lit("run "), "project").alias("command"), F.array(F.col("parent_a").cast("string"), F.col("parent_b").cast("string")).alias("parents"))
    return files.bug_report(runs)


@query(RUNS + "SELECT run_id, date_trunc('second', CAST(ts AS TIMESTAMP)) AS ts, 'p' || parent_a AS seed_id, CAST(return_code AS INTEGER) AS return_code, crashed, CASE WHEN run_id % 2 = 0 THEN 'run ' || project END AS command, stdout || 'x' AS content, trim(stderr, ' ' || chr(9) || chr(10)) AS stderr FROM signed")
def s17_run_log(spark, sf_dir):
    """All runs written as log files and read back."""
    path = new_folder(spark, "run-log")
    command = F.when(F.col("run_id") % 2 == 0, F.concat(F.lit("run "), "project"))
    runs = signed(spark, sf_dir).select("run_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("p"), "parent_a").alias("seed_id"), "return_code", "crashed", F.lit(0.5).alias("exec_time"), command.alias("command"), F.concat("stdout", F.lit("x")).alias("content"), "stdout", "stderr")
    files.run_log_text(runs).write.text(path)
    return files.read_run_log(spark, path).select("run_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"), "seed_id", "return_code", "crashed", "command", "content", "stderr")


@query("SELECT p_name || p_partkey AS function, CAST(p_size AS INTEGER) AS num_params, p_type AS parameter, p_brand AS type, CAST(p_partkey % 2 AS INTEGER) AS is_optional FROM part")
def s18_api_catalog(spark, sf_dir):
    """Parts as functions with one parameter, a JSON catalog for each brand."""
    path = new_folder(spark, "api")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    given = F.struct(F.col("p_type").alias("name"), F.col("p_brand").alias("type"), (F.col("p_partkey") % 2 == 1).alias("is_optional"))
    own = part.select((F.col("p_partkey") % 64).alias("n"), F.struct(F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").alias("num_params"), F.array(given).alias("parameters")).alias("f"))
    one_file_each(own.groupBy("n").agg(F.to_json(F.struct(F.collect_list("f").alias("functions"))).alias("value")), "n", path)
    functions, parameters = files.load_api_catalog(spark, path)
    return functions.join(parameters.select(F.col("function_id").alias("id"), F.col("name").alias("parameter"), "type", "is_optional"), "id").select(F.col("name").alias("function"), "num_params", "parameter", "type", "is_optional")


@query(cte("class_members") + "SELECT class_name, member, kind, CASE WHEN kind = 'method' THEN CAST(params_count AS INTEGER) END AS params_count FROM class_members")
def s19_class_catalog(spark, sf_dir):
    """Brands as classes with their members, spread over JSON catalogs, so that a class repeats."""
    path = new_folder(spark, "classes")
    is_method = F.col("kind") == "method"
    own = view(spark, sf_dir, "class_members").withColumn("n", F.pmod(F.xxhash64("member"), F.lit(8)))
    grouped = own.groupBy("n", "class_name").agg(F.collect_list(F.when(~is_method, F.col("member"))).alias("attributes"), F.collect_list(F.when(is_method, F.struct(F.col("member").alias("name"), "params_count"))).alias("methods"))
    texts = grouped.groupBy("n").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("class_name").alias("name"), "attributes", "methods")).alias("classes"))).alias("value"))
    one_file_each(texts, "n", path)
    classes, attributes, methods = files.load_class_catalog(spark, path)
    members = attributes.select("class_id", F.col("name").alias("member"), F.lit("attribute").alias("kind"), F.lit(None).cast("int").alias("params_count")).unionByName(methods.select("class_id", F.col("name").alias("member"), F.lit("method").alias("kind"), "params_count"))
    return members.join(classes.withColumnRenamed("id", "class_id"), "class_id").select("class_name", "member", "kind", "params_count")


# -- streams --------------------------------------------------------------------------------------


def source_of(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows as a stream of files, and a new folder for what comes of it."""
    spark, path = rows.sparkSession, new_folder(rows.sparkSession, name)
    rows.write.parquet(f"{path}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{path}/in"), path


@query(RUNS + "SELECT coalesce(signature, 'NoSig_' || run_id) AS key, min(run_id) AS first FROM signed WHERE crashed GROUP BY 1")
def k1_stream_first_seen(spark, sf_dir):
    stream, path = source_of(crashes(spark, sf_dir).select("run_id", "signature"), "first-seen")
    streams.stream_first_seen(stream, None, f"{path}/out", f"{path}/state").start().awaitTermination()
    return streams.stored(spark, f"{path}/out", streams.FIRST).select("key", "first")


#: Crashes in five files by time; of each file the first run of a signature.
SPANS = RUNS + """, crash AS (SELECT coalesce(signature, 'NoSig_' || run_id) AS key, CAST(ts AS TIMESTAMP) AS ts, run_id FROM signed WHERE crashed), z AS (SELECT min(ts) AS a, max(ts) AS b FROM crash),
filed AS (SELECT key, arg_min(ts, (ts, run_id)) AS ts, arg_min(run_id, (ts, run_id)) AS run, least(4, CAST(floor(5 * (epoch(ts) - epoch(a)) / (epoch(b) - epoch(a))) AS INTEGER)) AS file FROM crash, z GROUP BY key, file), """


@query(SPANS.replace("WITH", "WITH RECURSIVE", 1) + """marks AS (SELECT file + 2 AS file, max(max(ts)) OVER (ORDER BY file) - INTERVAL 3 DAY AS mark FROM filed GROUP BY file), o AS (SELECT filed.*, mark, row_number() OVER (PARTITION BY key ORDER BY file) AS i FROM filed LEFT JOIN marks USING (file)),
step AS (SELECT key, i, ts, run, ts AS since, true AS told FROM o WHERE i = 1 UNION ALL SELECT o.key, o.i, o.ts, o.run, CASE WHEN mark > since + INTERVAL 3 DAY THEN o.ts ELSE since END, coalesce(mark > since + INTERVAL 3 DAY, false) FROM step JOIN o ON o.key = step.key AND o.i = step.i + 1)
SELECT key, ts, run FROM step WHERE told""")
def k1_stream_horizon(spark, sf_dir):
    """Crashes that are news within three days, from five files by time, one a batch; a batch sees what is forgotten two batches later."""
    runs = crashes(spark, sf_dir).select(F.coalesce("signature", F.concat(F.lit("NoSig_"), "run_id")).alias("signature"), F.col("ts").cast("timestamp").alias("ts"), "run_id")
    a, b = runs.agg(F.min("ts"), F.max("ts")).first()
    span = (F.unix_micros("ts") - F.unix_micros(F.lit(a))) / (F.unix_micros(F.lit(b)) - F.unix_micros(F.lit(a)))
    filed = runs.withColumn("file", F.least(F.lit(4), F.floor(5 * span).cast("int"))).groupBy("signature", "file").agg(F.min(F.struct("ts", "run_id")).alias("x")).select("signature", "x.ts", "x.run_id", "file")
    path = new_folder(spark, "horizon")
    filed = cut(filed)
    for i in range(5):
        filed.filter(F.col("file") == i).drop("file").coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema("signature string, ts timestamp, run_id long").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    out = streams.stream_first_within(stream, "3 days").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("key string, ts timestamp, run long").parquet(f"{path}/out").select("key", F.col("ts").cast("timestamp_ntz").alias("ts"), "run")


@query(RUNS + ", w AS (SELECT date_trunc('hour', CAST(ts AS TIMESTAMP)) AS start, crashed, syntax_error FROM signed) SELECT start, count(*) AS samples, count(*) FILTER (crashed) AS crashes, round(100.0 * (1 - count(*) FILTER (syntax_error) / count(*)), 6) AS valid_rate FROM w GROUP BY start HAVING start + INTERVAL 2 HOUR <= (SELECT max(CAST(ts AS TIMESTAMP)) FROM signed)")
def k2_stream_status(spark, sf_dir):
    """The windows that the watermark has closed when all runs are read."""
    stream, path = source_of(signed(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "crashed", "syntax_error"), "status")
    out = streams.stream_status(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
    out.trigger(availableNow=True).start().awaitTermination()
    back = spark.read.schema("start timestamp, end timestamp, samples long, crashes long, valid_rate double").parquet(f"{path}/out")
    return back.select(F.col("start").cast("timestamp_ntz").alias("start"), "samples", "crashes", F.round("valid_rate", 6).alias("valid_rate"))


@query(cte("fused_pairs") + "SELECT DISTINCT least(id_a, id_b) AS id_lo, greatest(id_a, id_b) AS id_hi FROM fused_pairs WHERE id_a <> id_b")
def k3_stream_pair_coverage(spark, sf_dir):
    stream, path = source_of(view(spark, sf_dir, "fused_pairs").select(F.col("id_a").cast("long").alias("id_a"), F.col("id_b").cast("long").alias("id_b")), "pairs")
    streams.stream_pair_coverage(stream, f"{path}/out", f"{path}/state").start().awaitTermination()
    return streams.stored(spark, f"{path}/out", streams.PAIR)


@query(f"WITH n AS ({NATIONS}) SELECT string_agg(value || chr(10), '' ORDER BY s_suppkey) AS content FROM n GROUP BY s_nationkey")
def k4_stream_ingest(spark, sf_dir):
    """The suppliers of each nation as a text file; all files come twice, and are taken once."""
    path = new_folder(spark, "ingest")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    one_file_each(spark.sql(f"WITH supplier AS (SELECT * FROM {{supplier}}) {NATIONS}", supplier=supplier), "s_nationkey", f"{path}/in", "s_suppkey")
    for state in ("state", "again"):
        streams.stream_ingest(spark, f"{path}/in", f"{path}/out", f"{path}/{state}", "*.txt").start().awaitTermination()
    return streams.stored(spark, f"{path}/out", streams.SEED).select("content")
