"""Counts and reports over runs, corpora and pair logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import found


def corpus_list(corpus: DataFrame, project: str | None = None) -> DataFrame:
    """A1: entries with the length of their programs, by id."""
    own = corpus if project is None else corpus.filter(F.col("project") == project)
    return own.select("id", "project", "name", F.length("program").alias("length")).orderBy("id")


def project_counts(corpus: DataFrame) -> DataFrame:
    """A2: entries per project and a row TOTAL."""
    return corpus.rollup("project").agg(F.count("*").alias("n"), F.grouping("project").alias("g")).select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("project")).alias("project"), "n").orderBy(F.desc("n"), "project")


def languages(corpus: DataFrame) -> DataFrame:
    """(project, id, target) for every non-empty name in the JSON map of translations."""
    return corpus.select("project", "id", F.explode(F.map_keys(F.from_json("translations", "map<string,string>"))).alias("target"))


def translation_matrix(corpus: DataFrame) -> DataFrame:
    """A3: (target, project, n, total, percent): counts by source project, the target's total and its share of all entries.

    In long form, so that the number of projects does not set the number of columns; pivot_matrix() widens it.
    """
    cells = languages(corpus).groupBy("target", "project").agg(F.count("*").alias("n"))
    totals = cells.groupBy("target").agg(F.sum("n").alias("total"))
    entries = corpus.agg(F.count("*").alias("entries"))
    return cells.join(totals, "target").crossJoin(F.broadcast(entries)).select("target", "project", "n", "total", (100.0 * F.col("total") / F.col("entries")).alias("percent"))


def pivot_matrix(matrix: DataFrame) -> DataFrame:
    """A3 in wide form: a column per project in the order of counts, rows by total descending."""
    order = [r.project for r in matrix.groupBy("project").agg(F.sum("n").alias("s")).orderBy(F.desc("s"), "project").collect()]
    return matrix.groupBy("target", "total", "percent").pivot("project", order).sum("n").fillna(0).orderBy(F.desc("total"), "target")


def project_coverage(corpus: DataFrame) -> DataFrame:
    """A4: translated and all entries per project and target; a project without translations keeps one row."""
    total = corpus.groupBy("project").agg(F.count("*").alias("total"))
    done = languages(corpus).groupBy("project", "target").agg(F.count("*").alias("translated"))
    return total.join(done, "project", "left").select("project", "target", F.coalesce("translated", F.lit(0)).alias("translated"), "total")


def valid_rate(runs: DataFrame) -> DataFrame:
    """A5: percent of samples without a syntax error; 100 without samples."""
    return runs.agg(F.coalesce(100.0 * (1 - F.count_if("syntax_error") / F.nullif(F.count("*"), F.lit(0))), F.lit(100.0)).alias("valid_rate"))


def run_status(runs: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row: samples, seconds, samples per second, distinct signatures, valid rate, pairs covered."""
    seconds = F.max("ts").cast("timestamp").cast("double") - F.min("ts").cast("timestamp").cast("double")
    one = runs.agg(F.count("*").alias("samples"), F.coalesce(seconds, F.lit(0.0)).alias("elapsed"), F.count_distinct("signature").alias("signatures"), F.count_if("syntax_error").alias("errors"))
    per = lambda n: F.when(F.col("elapsed") > 0, F.col(n) / F.col("elapsed")).otherwise(0.0)
    rate = F.when(F.col("samples") == 0, 100.0).otherwise(100.0 * (1 - F.col("errors") / F.col("samples")))
    return one.crossJoin(F.broadcast(coverage)).select("samples", "elapsed", per("samples").alias("samples_per_second"), "signatures", rate.alias("valid_rate"), "covered", (100.0 * F.col("ratio")).alias("percent"), per("covered").alias("pairs_per_second"))


def gcov_summary(lines: DataFrame, line: str = "line") -> DataFrame:
    """Executed lines (each file's share cut to a whole number), all lines and the percentage."""
    pattern = r"^Lines executed:([0-9.]+)% of ([0-9]+)"
    share, count = found(F.col(line), pattern, 1).cast("double"), found(F.col(line), pattern, 2).cast("long")
    sums = lines.agg(F.coalesce(F.sum((share * count / 100).cast("long")), F.lit(0)).alias("executed"), F.coalesce(F.sum(F.when(share.isNotNull(), count)), F.lit(0)).alias("total"))
    return sums.select("executed", "total", F.when(F.col("total") > 0, 100.0 * F.col("executed") / F.col("total")).otherwise(0.0).alias("percent"))


def result_mix(results: DataFrame, status: str = "status") -> DataFrame:
    """Rows by status with the total up to and including each, in the order of statuses."""
    counts = results.groupBy(status).agg(F.count("*").alias("n"))
    return counts.select(status, "n", F.sum("n").over(W.orderBy(status)).alias("running"))


def seed_profile_stats(seeds: DataFrame) -> DataFrame:
    """Seeds per type: how many ran, ran well, and are analysed."""
    return seeds.groupBy("type").agg(F.count("*").alias("seeds"), F.count_if("dryrun_done").alias("ran"), F.count_if(F.col("rc") == 0).alias("ok"), F.count_if("pre_analysis_done").alias("analysed"))


def corpus_entry(corpus: DataFrame, id: int) -> DataFrame:
    """A10: an entry's program and its translations, one row for each, in stored order; an unknown id fails."""
    one = corpus.filter(F.col("id") == id)
    if one.isEmpty():
        raise LookupError(f"no entry {id}")
    own = F.from_json("translations", "map<string,string>")
    return one.select("id", "project", "name", F.posexplode(F.concat(F.array(F.struct(F.lit("").alias("target"), F.col("program").alias("text"))), F.transform(F.map_entries(own), lambda e: F.struct(e["key"].alias("target"), e["value"].alias("text"))))).alias("nth", "part")).select("id", "project", "name", "nth", "part.target", "part.text")
