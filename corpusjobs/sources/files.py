"""Reading seed files, crash reports, run logs and catalogs; writing logs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import found, let, strip

#: The rule between blocks of a run log, and the sign for an empty part.
RULE, EMPTY = "=" * 60, "(empty)"


def read_seed_files(spark: SparkSession, path: str, extensions: list[str], charset: str = "UTF-8") -> DataFrame:
    """(identifier, content) of every file below path with one of the suffixes (case counts).

    The identifier is the path below the root. Bytes that are no text in the charset are dropped; with
    ISO-8859-1 there are none. A file of no bytes holds no program and gives no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ends = F.exists(F.array(*map(F.lit, extensions)), lambda e: F.endswith(F.col("path"), e))
    rest = F.substring_index("path", path.rstrip("/") + "/", -1)
    if charset.upper() == "UTF-8":

        @F.pandas_udf("string")
        def text(data):
            return data.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

        content = text(F.col("content"))
    else:
        content = F.decode("content", charset)
    return files.filter(ends).select(rest.alias("identifier"), content.alias("content"))


METADATA = "filename string, type string, word_count int, line_count int, byte_size int, rc int, var_types map<string,string>, functions array<string>, imports array<string>, parents array<string>"


def load_seeds(spark: SparkSession, path: str, metadata: str = METADATA) -> DataFrame:
    """Stored seeds with their JSON metadata parsed; the identifier is the file name, whatever the metadata says."""
    rows = spark.read.parquet(path)
    parsed = F.coalesce(F.from_json("metadata", metadata), F.from_json(F.lit("{}"), metadata))
    return rows.withColumn("metadata", F.struct(parsed.alias("m"))["m"].withField("filename", F.col("identifier")))


def read_crash_reports(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """The known signatures: of every file below path whose name fits, .md as a rule, the one in its first 1024 characters."""
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return texts.select(found(F.substring("value", 1, 1024), r"\*\*Signature:\*\*\s*`([^`]+)`").alias("signature")).filter("signature IS NOT NULL").distinct()


def run_log_text(runs: DataFrame) -> DataFrame:
    """One block of text (value) for each run: run_id, ts, seed_id, return_code, crashed, exec_time, command, content, stdout, stderr."""
    part = lambda c: F.when(F.coalesce(strip(F.col(c)), F.lit("")) == "", EMPTY).otherwise(strip(F.col(c)))
    head = F.format_string(f"\n{RULE}\n[%s] Iteration #%s\n{RULE}\n[SEED ID]     %s\n[RETURN CODE] %s\n[CRASHED]     %s\n[EXEC TIME]   %.3fs", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("run_id").cast("string"), F.col("seed_id").cast("string"), F.col("return_code").cast("string"), F.initcap(F.col("crashed").cast("string")), F.col("exec_time"))
    command = F.when(F.coalesce("command", F.lit("")) != "", F.concat(F.lit("\n[COMMAND]     "), "command")).otherwise("")
    content = F.when(F.coalesce("content", F.lit("")) == "", EMPTY).otherwise(F.col("content"))
    return runs.select(F.concat(head, command, F.lit("\n\n--- SEED CONTENT ---\n"), content, F.lit("\n\n--- STDOUT ---\n"), part("stdout"), F.lit("\n\n--- STDERR ---\n"), part("stderr")).alias("value"))


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """The runs of log files; a part marked as empty is an empty text.

    A record goes from one head to the next, so a run is whole however the files are split. Years begin with 2.
    """
    blocks = spark.read.text(path, lineSep=f"\n{RULE}\n[2").select(F.concat(F.lit("2"), "value").alias("block"))
    head = rf"^(\d{{4}}-\d\d-\d\d \d\d:\d\d:\d\d)\] Iteration #(\d+)\n{RULE}\n"
    text = lambda name, until: let(F.regexp_extract("block", rf"(?s)\n\n--- {name} ---\n(.*?){until}", 1), lambda x: F.when(x == EMPTY, "").otherwise(x))
    field = lambda name: found(F.regexp_extract("block", r"(?s)^(.*?)(?:\n\n|\z)", 1), rf"(?m)^\[{name}\]\s*(.*)$")
    return blocks.filter(F.col("block").rlike(head)).select(
        F.regexp_extract("block", head, 2).cast("long").alias("run_id"), F.to_timestamp(F.regexp_extract("block", head, 1)).alias("ts"), field("SEED ID").alias("seed_id"), field("RETURN CODE").cast("int").alias("return_code"),
        (field("CRASHED") == "True").alias("crashed"), F.regexp_replace(field("EXEC TIME"), "s$", "").cast("double").alias("exec_time"), field("COMMAND").alias("command"),
        text("SEED CONTENT", r"\n\n--- STDOUT ---").alias("content"), text("STDOUT", r"\n\n--- STDERR ---").alias("stdout"), text("STDERR", r"\n*\z").alias("stderr"),
    )


API = "functions array<struct<name: string, num_params: int, parameters: array<struct<name: string, type: string, is_optional: boolean, default_value: string>>>>"


def load_api_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(functions, parameters) of a JSON catalog; the id of a function is a 64-bit hash of its name, so that two names of some ten million may share one."""
    each = spark.read.schema(API).json(path, multiLine=True).select(F.explode("functions").alias("f")).select("f.*").withColumn("id", F.xxhash64("name"))
    functions = each.select("id", "name", F.coalesce("num_params", F.lit(0)).alias("num_params"))
    parameters = each.select(F.col("id").alias("function_id"), F.explode("parameters").alias("p")).select("function_id", "p.name", "p.type", F.coalesce("p.is_optional", F.lit(False)).cast("int").alias("is_optional"), "p.default_value")
    return functions, parameters


CLASSES = "classes array<struct<name: string, attributes: array<string>, methods: array<struct<name: string, params_count: int>>>>"


def load_class_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, attributes, methods): a class name is kept once, by a 64-bit hash of it as id, the members of its repeats are added."""
    each = spark.read.schema(CLASSES).json(path, multiLine=True).select(F.explode("classes").alias("c")).select("c.*").withColumn("id", F.xxhash64("name"))
    return each.select("id", F.col("name").alias("class_name")).distinct(), each.select(F.col("id").alias("class_id"), F.explode("attributes").alias("name")), each.select(F.col("id").alias("class_id"), F.explode("methods").alias("m")).select("class_id", "m.name", "m.params_count")


def bug_report(crashes: DataFrame) -> DataFrame:
    """One Markdown text (value) for each crash: seed_id, signature, return_code, content, output, command, parents (array)."""
    block = lambda c: F.concat(F.lit("```\n"), F.coalesce(c, F.lit("")), F.lit("\n```\n"))
    return crashes.select(F.concat(
        F.lit("# Bug "), F.col("seed_id").cast("string"), F.lit("\n\n**Signature:** `"), F.coalesce("signature", F.lit("unknown")), F.lit("`\n\n**Return code:** "), F.col("return_code").cast("string"),
        F.lit("\n\n## Code\n"), block(F.col("content")), F.lit("\n## Output\n"), block(F.col("output")), F.lit("\n## Command\n"), block(F.col("command")), F.lit("\n## Parents\n"), F.array_join(F.transform("parents", lambda p: F.concat(F.lit("- "), p)), "\n"),
    ).alias("value"))
