"""Files in and out, and streams against their batch forms."""

from __future__ import annotations

import json
import shutil

from pyspark.sql import functions as F

from corpusjobs.operators import triage
from corpusjobs.sources import files
from corpusjobs.streaming import streams


def test_seed_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x.rs").write_bytes(b"caf\xc3\xa9 \xff end")
    (tmp_path / "a" / "b" / "y.rs").write_text(" ")
    (tmp_path / "z.RS").write_text("no")
    got = {r.identifier: r.content for r in files.read_seed_files(spark, str(tmp_path), [".rs"]).collect()}
    assert got == {"a/x.rs": "café  end", "a/b/y.rs": " "}
    latin = {r.identifier: r.content for r in files.read_seed_files(spark, str(tmp_path), [".rs"], "ISO-8859-1").collect()}
    assert latin["a/x.rs"] == "cafÃ© ÿ end"


def test_stored_seeds(spark, tmp_path):
    spark.createDataFrame([("s.txt", "c", json.dumps({"type": "text", "word_count": 2, "filename": "other"})), ("t", "", None)], "identifier string, content string, metadata string").write.parquet(str(tmp_path / "s"))
    got = {r.identifier: r.metadata for r in files.load_seeds(spark, str(tmp_path / "s")).collect()}
    assert got["s.txt"].filename == "s.txt" and got["s.txt"].word_count == 2 and got["t"].filename == "t" and got["t"].type is None


def test_crash_reports(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "README.md").write_text("# x\n**Signature:** `SIG [a > b]`\n")
    (tmp_path / "late.md").write_text("x" * 1024 + "**Signature:** `LATE`")
    assert [r.signature for r in files.read_crash_reports(spark, str(tmp_path)).collect()] == ["SIG [a > b]"]


def test_run_log_round_trip(spark, tmp_path):
    rows = [(1, "2024-01-02 03:04:05", "s1", 0, False, 0.5, None, "code\nmore", "", "err"), (2, "2024-01-02 03:04:06", "s2", 139, True, 1.25, "run x", "", "out", "")]
    runs = spark.createDataFrame(rows, "run_id long, ts string, seed_id string, return_code int, crashed boolean, exec_time double, command string, content string, stdout string, stderr string").withColumn("ts", F.to_timestamp("ts"))
    files.run_log_text(runs).coalesce(1).write.text(str(tmp_path / "log"))
    back = files.read_run_log(spark, str(tmp_path / "log")).orderBy("run_id")
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in runs.orderBy("run_id").collect()]


def test_run_logs_are_whole_however_they_are_split(spark, tmp_path):
    runs = spark.range(300).selectExpr("id AS run_id", "timestamp'2024-01-02 03:04:05' AS ts", "concat('s', id) AS seed_id", "0 AS return_code", "false AS crashed", "0.5D AS exec_time", "cast(null AS string) AS command", "repeat(concat('line ', id, '\n[2 ='), 20) AS content", "'' AS stdout", "'e' AS stderr")
    files.run_log_text(runs).coalesce(1).write.text(str(tmp_path / "log"))
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    try:
        for n in (700, 1001, 4096):
            spark.conf.set(size, str(n))
            back = files.read_run_log(spark, str(tmp_path / "log"))
            assert back.rdd.getNumPartitions() > 20 and sorted((r.run_id, r.content) for r in back.collect()) == sorted((r.run_id, r.content) for r in runs.collect())
    finally:
        spark.conf.set(size, before)


def test_catalogs(spark, tmp_path):
    (tmp_path / "api.json").write_text(json.dumps({"functions": [{"name": "f", "parameters": [{"name": "a", "type": "int", "is_optional": True, "default_value": "1"}]}, {"name": "g", "num_params": 2}]}))
    functions, parameters = files.load_api_catalog(spark, str(tmp_path / "api.json"))
    assert {(r.name, r.num_params) for r in functions.collect()} == {("f", 0), ("g", 2)} and [r.is_optional for r in parameters.collect()] == [1]
    (tmp_path / "c.json").write_text(json.dumps({"classes": [{"name": "A", "attributes": ["x"], "methods": [{"name": "m", "params_count": 1}]}, {"name": "A", "attributes": ["y"]}]}))
    classes, attributes, methods = files.load_class_catalog(spark, str(tmp_path / "c.json"))
    assert classes.count() == 1 and {r.name for r in attributes.collect()} == {"x", "y"} and methods.count() == 1
    text = files.bug_report(spark.createDataFrame([(1, "S", 139, "c", "o", "run", ["p", "q"])], "seed_id int, signature string, return_code int, content string, output string, command string, parents array<string>")).first().value
    assert "**Signature:** `S`" in text and text.endswith("- p\n- q")


def test_first_seen_stream(spark, tmp_path):
    runs = "run_id long, signature string"
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], runs).coalesce(1).write.parquet(source)
    known = spark.createDataFrame([("k",)], "signature string")

    def drain():
        stream = spark.readStream.schema(runs).parquet(source)
        streams.stream_first_seen(stream, known, str(tmp_path / "out"), str(tmp_path / "ck")).start().awaitTermination()
        return {(r.key, r.first) for r in streams.stored(spark, str(tmp_path / "out"), streams.FIRST).collect()}

    assert drain() == {("a", 1), ("NoSig_3", 3)}
    spark.createDataFrame([(4, "a"), (5, "b"), (6, "k")], runs).coalesce(1).write.mode("append").parquet(source)
    assert drain() == {("a", 1), ("NoSig_3", 3), ("b", 5)}
    assert drain() == {("a", 1), ("NoSig_3", 3), ("b", 5)}
    again = streams.stored(spark, str(tmp_path / "out"), streams.FIRST, before=1)
    streams.put(again.limit(0), str(tmp_path / "out"), 1)  # a batch that is tried again replaces its own rows
    assert {r.key for r in streams.stored(spark, str(tmp_path / "out"), streams.FIRST).collect()} == {"a", "NoSig_3"}


def test_pair_stream_and_ingest(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "id_a long, id_b long"
    spark.createDataFrame([(1, 2), (2, 1), (3, 3), (4, 1)], schema).write.parquet(source)
    streams.stream_pair_coverage(spark.readStream.schema(schema).parquet(source), str(tmp_path / "p"), str(tmp_path / "ck")).start().awaitTermination()
    assert {tuple(r) for r in streams.stored(spark, str(tmp_path / "p"), streams.PAIR).collect()} == {(1, 2), (1, 4)}
    (tmp_path / "seeds").mkdir()
    (tmp_path / "seeds" / "a.txt").write_text("one\ntwo")
    for text in ("three", "three"):
        streams.stream_ingest(spark, str(tmp_path / "seeds"), str(tmp_path / "s"), str(tmp_path / "ck2"), "*.txt").start().awaitTermination()
        (tmp_path / "seeds" / "b.txt").write_text(text)
    assert {r.identifier: r.content for r in streams.stored(spark, str(tmp_path / "s"), streams.SEED).collect()} == {"a.txt": "one\ntwo", "b.txt": "three"}


def test_status_stream_drops_late_rows(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "ts timestamp, crashed boolean, syntax_error boolean"
    make = lambda *rows: spark.createDataFrame([(t, c, e) for t, c, e in rows], "ts string, crashed boolean, syntax_error boolean").withColumn("ts", F.to_timestamp("ts")).coalesce(1)
    make(("2024-01-01 00:10:00", True, False), ("2024-01-01 00:20:00", False, True), ("2024-01-01 05:00:00", False, False)).write.parquet(source)

    def drain():
        status = streams.stream_status(spark.readStream.schema(schema).parquet(source))
        status.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.start.hour, r.samples, r.crashes, r.valid_rate) for r in spark.read.parquet(str(tmp_path / "o")).collect())

    assert drain() == [(0, 2, 1, 50.0)]
    make(("2024-01-01 00:30:00", True, False), ("2024-01-01 09:00:00", False, False)).write.mode("append").parquet(source)
    assert drain() == [(0, 2, 1, 50.0), (5, 1, 0, 100.0)]


def test_a_batch_reads_the_state_of_its_own_keys_and_can_be_replayed(spark, tmp_path):
    runs, source, out, ck = "run_id long, signature string", str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "ck"

    def drain():
        query = streams.stream_first_seen(spark.readStream.schema(runs).parquet(source), None, out, str(ck)).start()
        query.awaitTermination()
        return query, sorted((r.key, r.first, r.n) for r in streams.stored(spark, out, streams.FIRST).collect())

    spark.createDataFrame([(2, "a"), (1, "a"), (3, "b")], runs).coalesce(1).write.parquet(source)
    assert drain()[1] == [("a", 1, 2), ("b", 3, 1)]
    spark.createDataFrame([(0, "a"), (5, "c"), (6, None)], runs).coalesce(1).write.mode("append").parquet(source)
    query, found = drain()
    assert found == [("NoSig_6", 6, 1), ("a", 1, 2), ("b", 3, 1), ("c", 5, 1)]
    data = [p for p in query.recentProgress if p.numInputRows]
    assert sum(p.numInputRows for p in data) == 3 and data[-1].stateOperators[0].numRowsTotal == 4  # the batch's own rows; all keys
    # As after a failure between the batch's rows and its commit.
    last = max(int(f.name) for f in (ck / "commits").iterdir() if f.name.isdigit())
    for f in (ck / "commits").glob(f"*{last}*"):
        f.unlink()
    assert drain()[1] == found
    # What is told does not depend on the table of what was told.
    shutil.rmtree(f"{out}/batch=0")
    spark.createDataFrame([(7, "a"), (8, "b"), (9, "d")], runs).coalesce(1).write.mode("append").parquet(source)
    assert drain()[1] == [("NoSig_6", 6, 1), ("c", 5, 1), ("d", 9, 1)]


def test_a_signature_is_news_again_beyond_the_horizon(spark, tmp_path):
    schema, source = "run_id long, signature string, ts timestamp", str(tmp_path / "in")

    def drain(*rows):
        spark.createDataFrame(rows, "run_id long, signature string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(source)
        found = streams.stream_first_within(spark.readStream.schema(schema).parquet(source), "1 hour")
        found.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.key, r.run) for r in spark.read.parquet(str(tmp_path / "o")).collect())

    assert drain((1, "a", "2024-01-01 00:00:00"), (2, "b", "2024-01-01 00:10:00"), (3, None, "2024-01-01 00:10:00")) == [("NoSig_3", 3), ("a", 1), ("b", 2)]
    assert drain((4, "a", "2024-01-01 00:50:00")) == [("NoSig_3", 3), ("a", 1), ("b", 2)]  # within the horizon
    assert drain((5, "b", "2024-01-01 05:00:00"))[-1:] == [("b", 2)]  # not forgotten yet: the watermark follows the batch
    assert drain((6, "a", "2024-01-01 05:10:00"), (7, "b", "2024-01-01 01:00:00"))[1:3] == [("a", 1), ("a", 6)]  # forgotten; a late row is dropped
    assert [k for k, _ in drain((8, "b", "2024-01-01 09:00:00"))].count("b") == 2


def test_pair_stream_tells_each_pair_once(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "id_a long, id_b long"
    for rows in ([(1, 2), (2, 1), (3, 3)], [(2, 1), (5, 4)], [(4, 5), (1, 5)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        streams.stream_pair_coverage(spark.readStream.schema(schema).parquet(source), str(tmp_path / "p"), str(tmp_path / "ck")).start().awaitTermination()
    told = [tuple(r) for r in streams.stored(spark, str(tmp_path / "p"), streams.PAIR).collect()]
    assert sorted(told) == [(1, 2), (1, 5), (4, 5)]


def test_signatures_are_found_within_a_stream(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "run_id long, project string, stdout string, stderr string, return_code int"
    rows = [(1, "clang", "", "LLVM ERROR: bad node", 1), (2, "clang", "", "LLVM ERROR: bad node", 1), (3, "cpython", "fine", "", 0), (4, "rust", "", "thread 'rustc' panicked at src/a.rs:1:2:\nno", 101)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    signed = triage.with_signatures(spark.readStream.schema(schema).parquet(source)).filter("crashed")
    streams.stream_first_seen(signed, None, str(tmp_path / "out"), str(tmp_path / "ck")).start().awaitTermination()
    assert {(r.key, r.first, r.n) for r in streams.stored(spark, str(tmp_path / "out"), streams.FIRST).collect()} == {("LLVM ERROR: bad node", 1, 2), ("RustPanic:src/a.rs:1:2:no", 4, 1)}
