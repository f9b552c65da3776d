"""Queries over run results and issue tables, each with the SQL that DuckDB checks it by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signatures as G
from ..operators import pairing, stats, triage
from ..operators.tables import cut
from .views import cte, view

#: DuckDB SQL of the cascades for the projects that the view `runs` has.
SIGNED = r"""
, t AS (SELECT *, stderr || stdout AS both_, stderr || chr(10) || stdout AS lined FROM runs),
f AS (SELECT *,
  nullif(trim(regexp_extract(stderr, 'SUMMARY: AddressSanitizer:\s+([^\n]*)', 1)), '') AS asan,
  nullif(trim(regexp_extract(stderr, 'SUMMARY: UndefinedBehaviorSanitizer:\s+([^\n]*)', 1)), '') AS ubsan,
  nullif(trim(regexp_extract(stderr, 'LLVM ERROR:\s+([^\n]+)', 1)), '') AS llvm,
  nullif(trim(regexp_extract(stderr, 'Assertion `([^'']+)'' failed', 1)), '') AS assertion,
  trim(regexp_extract(stderr, '(?m)^1\.\t(?:\S+:\d+:\d+:\s*)?(.+)$', 1)) AS message,
  array_to_string(list_filter(regexp_extract_all(stderr, '(?m)^\s*\d+\s+\S+\s+0x[0-9a-f]+\s+([A-Za-z_][\w:<>,~ &*]*?)\s*\(', 1), lambda x: x <> 'llvm::sys::PrintStackTrace')[1:3], ' > ') AS frames,
  regexp_extract(stderr, 'panicked at ([^:]+\.rs:\d+:\d+):\s*\n?([^\n]*)', 1) AS panic, trim(regexp_extract(stderr, 'panicked at ([^:]+\.rs:\d+:\d+):\s*\n?([^\n]*)', 2)) AS panic_text,
  trim(regexp_extract(stderr, '(?i)error:\s+([^\n]{4,120})', 1)) AS said,
  regexp_extract(stderr, 'SUMMARY: AddressSanitizer:\s+(\S+).*?in (\S+)\s+(\S+:\d+)', 1) AS a1, regexp_extract(stderr, 'SUMMARY: AddressSanitizer:\s+(\S+).*?in (\S+)\s+(\S+:\d+)', 2) AS a2, regexp_extract(stderr, 'SUMMARY: AddressSanitizer:\s+(\S+).*?in (\S+)\s+(\S+:\d+)', 3) AS a3
  FROM t),
s AS (SELECT *, coalesce(
  CASE project
    WHEN 'clang' THEN coalesce('ASAN: ' || asan, 'UBSAN: ' || ubsan, 'LLVM ERROR: ' || llvm, 'Assertion: ' || assertion,
      CASE WHEN contains(stderr, 'Stack dump:' || chr(10)) THEN 'Stack dump: ' || message || ' [' || frames || ']' END,
      CASE WHEN contains(both_, 'Aborted') THEN 'Aborted' WHEN contains(both_, 'Segmentation fault') THEN 'Segmentation fault' END)
    WHEN 'cpython' THEN coalesce(asan, CASE WHEN contains(stderr, 'Segmentation fault') THEN 'Segmentation fault' END)
    WHEN 'php' THEN nullif(trim(regexp_extract(stderr, '(SUMMARY: [^\n]*)', 1)), '')
    ELSE asan END,
  'ASAN:' || nullif(a1, '') || '_in_' || a2 || '_at_' || a3, 'ASAN:' || asan, 'UBSAN:' || left(ubsan, 120),
  'RustPanic:' || nullif(panic, '') || ':' || panic_text, 'Assertion:' || assertion,
  CASE WHEN said <> '' THEN 'Error:' || left(trim(regexp_replace(said, '/\S+', '', 'g')), 100) END,
  CASE WHEN contains(lined, 'Segmentation fault') THEN 'SIGSEGV' WHEN contains(lined, 'Aborted') THEN 'SIGABRT' END,
  'Stderr:' || trim(split_part(stderr, chr(10), 1))) AS any_signature,
  CASE project
    WHEN 'clang' THEN regexp_matches(both_, 'SUMMARY: AddressSanitizer|SUMMARY: UndefinedBehaviorSanitizer|LLVM ERROR|Assertion `|Stack dump:|Segmentation fault|Aborted|core dumped|PLEASE submit')
    WHEN 'cpython' THEN regexp_matches(both_, 'SUMMARY:|: Assertion `')
    WHEN 'php' THEN regexp_matches(both_, 'SUMMARY: AddressSanitizer|SUMMARY: UndefinedBehaviorSanitizer|Assertion: |\(core dumped\)')
    ELSE regexp_matches(both_, 'internal compiler error|thread ''rustc'' panicked|stack overflow|Segmentation fault|core dumped|Aborted|LLVM ERROR') END AS crashed,
  CASE WHEN regexp_matches(lower(stderr), 'error:|syntaxerror|syntax error|indentationerror|could not parse wgsl|validation error') THEN true WHEN return_code = 0 THEN false ELSE return_code NOT IN (1, 139) END AS syntax_error
  FROM f),
signed AS (SELECT *, CASE WHEN crashed THEN any_signature END AS signature FROM s)
"""
RUNS = cte("runs") + SIGNED

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has any."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def runs_table(spark: SparkSession, sf_dir: str, name: str = "runs") -> DataFrame:
    """A view of runs as a table: its texts are long expressions, which each mention would repeat."""
    return cut(view(spark, sf_dir, name))


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.with_signatures(runs_table(spark, sf_dir))


def crashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signed(spark, sf_dir).filter("crashed")


def known_crashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, project and signature of the crashes, found once: a signature is a long expression, which each use would repeat."""
    return cut(crashes(spark, sf_dir).select("run_id", "project", "signature"))


@query(RUNS + "SELECT run_id, crashed, syntax_error FROM signed")
def p8_p9_run_flags(spark, sf_dir):
    return signed(spark, sf_dir).select("run_id", "crashed", "syntax_error")


@query(RUNS + "SELECT run_id, project, any_signature AS signature FROM signed")
def g12_signatures(spark, sf_dir):
    return G.with_signature(runs_table(spark, sf_dir), F.col("project"), F.col("stdout"), F.col("stderr")).select("run_id", "project", "signature")


@query(RUNS + r"""SELECT run_id, coalesce(CASE WHEN project = 'rust' THEN nullif(trim(regexp_extract(stderr, '(SUMMARY: [^\n]*)', 1)), '') WHEN project = 'php' THEN nullif(regexp_extract(stderr, '(Segmentation fault)', 1), '') END,
  'ASAN:' || nullif(a1, '') || '_in_' || a2 || '_at_' || a3, 'ASAN:' || asan, 'UBSAN:' || left(ubsan, 120), 'RustPanic:' || nullif(panic, '') || ':' || panic_text, 'Assertion:' || assertion,
  CASE WHEN said <> '' THEN 'Error:' || left(trim(regexp_replace(said, '/\S+', '', 'g')), 100) END, CASE WHEN contains(lined, 'Segmentation fault') THEN 'SIGSEGV' WHEN contains(lined, 'Aborted') THEN 'SIGABRT' END, 'Stderr:' || trim(split_part(stderr, chr(10), 1))) AS signature FROM f""")
def u3_own_cascades(spark, sf_dir):
    """Signatures by cascades of one's own: another project's, and one with a rule made for the query."""
    own = {"rust": G.php, "php": G.Cascade(G.named("err", "Segmentation fault", "Segmentation fault"))}
    return G.with_signature(runs_table(spark, sf_dir), F.col("project"), F.col("stdout"), F.col("stderr"), cascades=own).select("run_id", "signature")


@query(RUNS + r""", g AS (SELECT run_id, nullif(trim(regexp_extract(stderr, '(SUMMARY: [^\n]*)', 1)), '') AS a, nullif(trim(regexp_extract(stderr, '(Assertion[^:]*:[^\n]*)', 1)), '') AS b FROM runs)
SELECT run_id, coalesce(a, b) AS signature FROM g""")
def g11_reducer_signatures(spark, sf_dir):
    return view(spark, sf_dir, "runs").select("run_id", G.reducer(F.col("stdout"), F.col("stderr")).alias("signature"))


@query(RUNS + "SELECT coalesce(signature, 'NoSig_' || run_id) AS key, min(run_id) AS first, count(*) AS n FROM signed WHERE crashed GROUP BY 1")
def t1_first_seen(spark, sf_dir):
    return triage.first_seen(crashes(spark, sf_dir))


@query(RUNS + ", c AS (SELECT coalesce(signature, 'NoSig_' || run_id) AS key, run_id, project FROM signed WHERE crashed) SELECT key, min(run_id) AS first, count(*) AS n FROM c WHERE key NOT IN (SELECT key FROM c WHERE project = 'clang') GROUP BY key")
def t1_first_seen_after_known(spark, sf_dir):
    """New signatures of all runs, when those of one project are known."""
    all_crashes = known_crashes(spark, sf_dir)
    return triage.first_seen(all_crashes, all_crashes.filter("project = 'clang'").select("signature"))


#: The project's own cascade alone, as saved outputs are read.
OWN = RUNS + r""", o AS (SELECT run_id, coalesce(CASE project
    WHEN 'clang' THEN coalesce('ASAN: ' || asan, 'UBSAN: ' || ubsan, 'LLVM ERROR: ' || llvm, 'Assertion: ' || assertion,
      CASE WHEN contains(stderr, 'Stack dump:' || chr(10)) THEN 'Stack dump: ' || message || ' [' || frames || ']' END, CASE WHEN contains(stderr, 'Segmentation fault') THEN 'Segmentation fault' END)
    WHEN 'cpython' THEN coalesce(asan, CASE WHEN contains(stderr, 'Segmentation fault') THEN 'Segmentation fault' END)
    WHEN 'php' THEN nullif(trim(regexp_extract(stderr, '(SUMMARY: [^\n]*)', 1)), '') ELSE asan END, '(unrecognized) ' || run_id) AS signature FROM signed WHERE crashed),
c AS (SELECT signature, list(CAST(run_id AS VARCHAR) ORDER BY CAST(run_id AS VARCHAR)) AS members, count(*) AS size FROM o GROUP BY signature)
"""


def reports(spark, sf_dir):
    return crashes(spark, sf_dir).select(F.col("run_id").cast("string").alias("name"), "project", F.col("stderr").alias("text"))


@query(OWN + "SELECT signature, CAST(run_id AS VARCHAR) AS member FROM o")
def t2_clusters(spark, sf_dir):
    return triage.cluster_members(reports(spark, sf_dir))


@query(OWN + "SELECT row_number() OVER (ORDER BY size DESC, members[1]) AS rank, signature, size, array_to_string(members[1:6], ', ') || CASE WHEN size > 6 THEN ' +' || (size - 6) || ' more' ELSE '' END AS shown FROM c")
def t3_cluster_report(spark, sf_dir):
    return triage.cluster_report(triage.clusters(triage.cluster_members(reports(spark, sf_dir))))


def distinct_signatures(spark, sf_dir):
    return crashes(spark, sf_dir).filter("signature IS NOT NULL").select("signature").distinct()


FRAMES = RUNS + r""", d AS (SELECT DISTINCT signature FROM signed WHERE signature IS NOT NULL), k AS (SELECT signature,
  CASE WHEN starts_with(signature, 'Stack dump:') THEN string_split(regexp_extract(signature, '\[(.*)\]\s*$', 1), ' > ') ELSE [] END AS frames FROM d) """


@query(FRAMES + "SELECT signature, array_to_string(frames, '|') AS frames FROM k")
def t4_frames(spark, sf_dir):
    return distinct_signatures(spark, sf_dir).select("signature", F.array_join(triage.frames(F.col("signature")), "|").alias("frames"))


@query(FRAMES + "SELECT CASE WHEN len(frames) > 0 THEN 'frames:' || array_to_string(frames, ' > ') ELSE 'text:' || signature END AS match_key, min(signature) AS first, count(*) AS n FROM k GROUP BY 1")
def t5_signatures_match(spark, sf_dir):
    return triage.signature_classes(distinct_signatures(spark, sf_dir))


SHARED = """, k AS (SELECT run_id, project, signature, list_filter(['SUMMARY:', 'Assertion:', 'ASAN:', 'LLVM ERROR:', 'compiler panic:', 'compiler fatal:', 'internal compiler error:', 'Fatal Python error:', 'INTERNAL PANIC:', 'Check failed:', 'Fatal error:', 'Segmentation fault', 'Bus error', 'SIGSEGV', 'SIGABRT'], lambda x: contains(signature, x)) AS w FROM signed WHERE crashed) """


@query(RUNS + SHARED + "SELECT key, min(signature) AS first, count(*) AS n FROM (SELECT signature, unnest(list_concat(['text:' || signature], w)) AS key FROM k) GROUP BY key")
def t6_keyword_match(spark, sf_dir):
    return triage.keyword_classes(known_crashes(spark, sf_dir))


@query(RUNS + SHARED + ", z AS (SELECT * FROM k WHERE project = 'rust'), y AS (SELECT DISTINCT unnest(w) AS x FROM z) SELECT run_id, signature FROM k WHERE project <> 'rust' AND (signature IN (SELECT signature FROM z) OR EXISTS (SELECT 1 FROM y WHERE contains(k.signature, y.x)))")
def t6_keyword_matched(spark, sf_dir):
    """Crashes of other projects that match those of one by a keyword."""
    own = known_crashes(spark, sf_dir)
    return triage.keyword_matched(own.filter("project <> 'rust'").select("run_id", "signature"), own.filter("project = 'rust'").select("signature"))


@query(RUNS + ", k AS (SELECT run_id, project, signature, CASE WHEN starts_with(signature, 'Stack dump:') THEN 'f' || regexp_extract(signature, '\\[(.*)\\]\\s*$', 1) ELSE 't' || signature END AS key FROM signed WHERE crashed) SELECT run_id, signature FROM k WHERE project <> 'rust' AND key IN (SELECT key FROM k WHERE project = 'rust')")
def t5_matched(spark, sf_dir):
    """Crashes of other projects whose signatures match those of one."""
    own = known_crashes(spark, sf_dir)
    return triage.matched(own.filter("project <> 'rust'").select("run_id", "signature"), own.filter("project = 'rust'").select("signature"))


TERMS = FRAMES + r""", w AS (SELECT *, string_split(regexp_extract(signature, '^(ASAN|UBSAN|LLVM ERROR|Assertion):\s*(.*)$', 2), ' ') AS words, list_transform(frames, lambda x: regexp_extract(x, '([A-Za-z_~][A-Za-z0-9_]*)$', 1)) AS names FROM k),
terms AS (SELECT signature, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS nth FROM (SELECT signature, CASE
  WHEN regexp_matches(signature, '^(ASAN|UBSAN|LLVM ERROR|Assertion):') THEN CASE WHEN len(words) >= 2 THEN ['"' || replace(array_to_string(words[1:8], ' '), '"', '') || '"', trim(words[1], '`''".,;:()')] ELSE [trim(words[1], '`''".,;:()')] END
  WHEN starts_with(signature, 'Stack dump:') THEN CASE WHEN len(names) > 1 THEN ['"' || names[1] || '" "' || names[2] || '"', '"' || names[1] || '"'] ELSE ['"' || names[1] || '"'] END
  WHEN signature IN ('Segmentation fault', 'Aborted') THEN []
  ELSE ['"' || left(signature, 80) || '"'] END AS t FROM w)) """


@query(TERMS + "SELECT signature, nth, term FROM terms")
def t7_search_terms(spark, sf_dir):
    return distinct_signatures(spark, sf_dir).select("signature", F.posexplode(triage.search_terms(F.col("signature"))).alias("nth", "term"))


HITS = TERMS.replace(cte("runs"), cte("runs", "issues")) + r""", p AS (SELECT *, CASE WHEN contains(term, '"') THEN regexp_extract_all(term, '"([^"]*)"', 1) ELSE [term] END AS phrases FROM terms),
x AS (SELECT DISTINCT signature, nth, number FROM p JOIN issues i ON len(list_filter(phrases, lambda q: NOT contains(lower(coalesce(title, '') || chr(10) || coalesce(body, '')), lower(q)))) = 0),
hits AS (SELECT p.signature, p.nth, p.term, count(number) AS total, coalesce(list(number ORDER BY number) FILTER (number IS NOT NULL), [])[1:5] AS top FROM p LEFT JOIN x ON x.signature = p.signature AND x.nth = p.nth GROUP BY 1, 2, 3)
"""


def hits(spark, sf_dir):
    return triage.match_issues(distinct_signatures(spark, sf_dir), view(spark, sf_dir, "issues"))


@query(HITS + "SELECT signature, nth, term, total, array_to_string(top, ',') AS top FROM hits")
def t8_match_issues(spark, sf_dir):
    return hits(spark, sf_dir).withColumn("top", F.array_join(F.col("top").cast("array<string>"), ","))


#: A search ends at the first text with 1 to 50 hits; else the first one that was not above a better one stays.
BEST = HITS + """, r AS (SELECT signature, list({'n': total, 't': term} ORDER BY nth) AS h FROM hits GROUP BY signature),
best AS (SELECT signature, CASE WHEN h[1].n BETWEEN 1 AND 50 OR len(h) = 1 THEN h[1] WHEN h[2].n BETWEEN 1 AND 50 THEN h[2] WHEN h[1].n = 0 THEN h[1] WHEN h[2].n = 0 THEN h[1] WHEN h[2].n < h[1].n THEN h[2] ELSE h[1] END AS b FROM r)
"""


@query(BEST + "SELECT signature, b.t AS term, b.n AS total FROM best")
def t9_best_query(spark, sf_dir):
    return triage.best_query(hits(spark, sf_dir))


@query(BEST + """SELECT best.signature, b.n AS total, coalesce(n_open, 0) AS n_open, coalesce(n_closed, 0) AS n_closed, CASE WHEN b.n = 0 THEN 'no match' WHEN n_open > 0 THEN 'open match' ELSE 'closed match' END AS status
FROM best LEFT JOIN (SELECT e.signature, count(*) FILTER (state = 'open') AS n_open, count(*) FILTER (state = 'closed') AS n_closed FROM (SELECT hits.signature, unnest(top) AS number FROM hits JOIN best ON hits.signature = best.signature AND term = b.t) e JOIN issues USING (number) GROUP BY 1) c ON c.signature = best.signature""")
def t10_issue_status(spark, sf_dir):
    found = hits(spark, sf_dir)
    return triage.issue_status(triage.best_query(found), found, view(spark, sf_dir, "issues"))


def rerun_signatures(spark, sf_dir):
    again = runs_table(spark, sf_dir, "reruns")
    crashed = G.crashed(F.lit("clang"), F.lit(""), F.col("stderr"))
    return G.with_signature(again.withColumn("crashed", crashed), F.lit("clang"), F.lit(""), F.col("stderr"), F.col("crashed"), cascades={"clang": G.clang}).select("bug_id", "label", "signature")


ATTRIBUTED = cte("runs", "reruns") + r""", f AS (SELECT bug_id, label, CASE WHEN regexp_matches(stderr, 'SUMMARY: AddressSanitizer|SUMMARY: UndefinedBehaviorSanitizer|LLVM ERROR|Assertion `|Stack dump:|Segmentation fault|Aborted|core dumped') THEN coalesce(
  'ASAN: ' || nullif(trim(regexp_extract(stderr, 'SUMMARY: AddressSanitizer:\s+([^\n]+)', 1)), ''), 'UBSAN: ' || nullif(trim(regexp_extract(stderr, 'SUMMARY: UndefinedBehaviorSanitizer:\s+([^\n]+)', 1)), ''),
  'LLVM ERROR: ' || nullif(trim(regexp_extract(stderr, 'LLVM ERROR:\s+([^\n]+)', 1)), ''), 'Assertion: ' || nullif(trim(regexp_extract(stderr, 'Assertion `([^'']+)'' failed', 1)), ''),
  CASE WHEN contains(stderr, 'Stack dump:') THEN array_to_string(list_filter(regexp_extract_all(stderr, '(?m)^\s*\d+\s+\S+\s+0x[0-9a-f]+\s+([A-Za-z_][\w:<>,~ &*]*?)\s*\(', 1), lambda x: x <> 'llvm::sys::PrintStackTrace'), ' > ') END,
  'Segmentation fault') END AS k FROM reruns),
u AS (SELECT bug_id, min(k) AS fused_key FROM f WHERE label = 'fused' AND k IS NOT NULL GROUP BY 1),
m AS (SELECT f.bug_id, string_agg(DISTINCT label, ',' ORDER BY label) AS parents FROM f JOIN u ON f.bug_id = u.bug_id AND k = fused_key WHERE label <> 'fused' GROUP BY 1),
a AS (SELECT b.bug_id, CASE WHEN fused_key IS NULL THEN 'skipped' WHEN parents IS NOT NULL THEN 'parent-reproducible' ELSE 'fusion-specific' END AS status, coalesce(parents, '') AS parents FROM (SELECT DISTINCT bug_id FROM reruns) b LEFT JOIN u USING (bug_id) LEFT JOIN m USING (bug_id))
"""


@query(ATTRIBUTED + "SELECT * FROM a")
def t11_parent_attribution(spark, sf_dir):
    again = rerun_signatures(spark, sf_dir)
    return triage.parent_attribution(again.select("bug_id"), again)


@query(ATTRIBUTED + "SELECT count(*) FILTER (status <> 'skipped') AS examined, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'parent-reproducible') AS parent_reproducible, count(*) FILTER (status = 'fusion-specific') AS fusion_specific FROM a")
def t12_attribution_summary(spark, sf_dir):
    again = rerun_signatures(spark, sf_dir)
    return triage.attribution_summary(triage.parent_attribution(again.select("bug_id"), again))


@query(RUNS + "SELECT run_id, round(CASE WHEN length(stderr) = 0 THEN 0.0 ELSE (1 - length(trim(regexp_extract(stderr, '^([^\\n]*)', 1))) / length(stderr)) * 100 END, 6) AS percent FROM runs".replace("\\\\n", "\\n"))
def t13_reduction(spark, sf_dir):
    first = F.trim(F.regexp_extract("stderr", r"^([^\n]*)", 1))
    return view(spark, sf_dir, "runs").select("run_id", F.round(triage.reduction_percent(F.length("stderr"), F.length(first)), 6).alias("percent"))


@query("""SELECT l_orderkey AS folder, arg_min(name, (CASE WHEN starts_with(name, 'test') THEN 0 ELSE 1 END) * 10 + CASE WHEN name LIKE '%.php' THEN 0 WHEN name LIKE '%.phpt' THEN 1 ELSE 2 END) AS reproducer
FROM (SELECT l_orderkey, CASE l_linenumber % 4 WHEN 0 THEN 'reproduce.c' WHEN 1 THEN 'test.sh' WHEN 2 THEN 'test.php' ELSE 'test.phpt' END AS name FROM lineitem) WHERE name NOT LIKE '%.sh' GROUP BY 1""")
def t14_reproducer_choice(spark, sf_dir):
    files = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey AS folder", "CASE l_linenumber % 4 WHEN 0 THEN 'reproduce.c' WHEN 1 THEN 'test.sh' WHEN 2 THEN 'test.php' ELSE 'test.phpt' END AS name")
    return triage.reproducer_choice(files)


@query(RUNS + "SELECT round(100.0 * (1 - count(*) FILTER (syntax_error) / count(*)), 6) AS valid_rate FROM signed")
def a5_valid_rate(spark, sf_dir):
    return stats.valid_rate(signed(spark, sf_dir)).select(F.round("valid_rate", 6).alias("valid_rate"))


@query(cte("gcov_lines") + r""", x AS (SELECT CAST(regexp_extract(line, '^Lines executed:([0-9.]+)% of ([0-9]+)', 1) AS DOUBLE) AS p, CAST(regexp_extract(line, '^Lines executed:([0-9.]+)% of ([0-9]+)', 2) AS BIGINT) AS n FROM gcov_lines WHERE line LIKE 'Lines executed:%')
SELECT CAST(sum(CAST(trunc(p * n / 100) AS BIGINT)) AS BIGINT) AS executed, CAST(sum(n) AS BIGINT) AS total, round(100.0 * sum(CAST(trunc(p * n / 100) AS BIGINT)) / sum(n), 6) AS percent FROM x""")
def a7_gcov_summary(spark, sf_dir):
    return stats.gcov_summary(view(spark, sf_dir, "gcov_lines")).withColumn("percent", F.round("percent", 6))


@query(RUNS + ", m AS (SELECT CASE WHEN crashed THEN 'crash' WHEN syntax_error THEN 'error' ELSE 'ok' END AS status FROM signed) SELECT status, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY status) AS BIGINT) AS running FROM m GROUP BY status")
def a8_result_mix(spark, sf_dir):
    return stats.result_mix(signed(spark, sf_dir).select(F.when(F.col("crashed"), "crash").when(F.col("syntax_error"), "error").otherwise("ok").alias("status")))


@query(cte("seeds") + "SELECT type, count(*) AS seeds, count(*) FILTER (dryrun_done) AS ran, count(*) FILTER (rc = 0) AS ok, count(*) FILTER (pre_analysis_done) AS analysed FROM seeds GROUP BY type")
def a9_seed_stats(spark, sf_dir):
    return stats.seed_profile_stats(view(spark, sf_dir, "seeds"))


@query(cte("bug_corpus") + "SELECT id, project, name, length(program) AS length FROM bug_corpus")
def a1_corpus_list(spark, sf_dir):
    return stats.corpus_list(view(spark, sf_dir, "bug_corpus"))


@query(cte("bug_corpus") + "SELECT coalesce(project, 'TOTAL') AS project, count(*) AS n FROM bug_corpus GROUP BY ROLLUP (project)")
def a2_project_counts(spark, sf_dir):
    return stats.project_counts(view(spark, sf_dir, "bug_corpus"))


LANGUAGES = cte("bug_corpus") + ", l AS (SELECT project, id, unnest(json_keys(translations)) AS target FROM bug_corpus) "


@query(LANGUAGES + "SELECT target, project, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY target) AS BIGINT) AS total, round(100.0 * sum(count(*)) OVER (PARTITION BY target) / (SELECT count(*) FROM bug_corpus), 6) AS percent FROM l GROUP BY target, project")
def a3_translation_matrix(spark, sf_dir):
    return stats.translation_matrix(view(spark, sf_dir, "bug_corpus")).withColumn("percent", F.round("percent", 6))


@query(LANGUAGES + "SELECT t.project, target, coalesce(translated, 0) AS translated, total FROM (SELECT project, count(*) AS total FROM bug_corpus GROUP BY 1) t LEFT JOIN (SELECT project, target, count(*) AS translated FROM l GROUP BY 1, 2) d ON t.project = d.project")
def a4_project_coverage(spark, sf_dir):
    return stats.project_coverage(view(spark, sf_dir, "bug_corpus"))


@query(cte("bug_corpus") + """, x AS (SELECT * FROM bug_corpus WHERE id = (SELECT max(id) FROM bug_corpus))
SELECT id, project, name, CAST(0 AS INTEGER) AS nth, '' AS target, program AS text FROM x
UNION ALL SELECT id, project, name, CAST(i AS INTEGER), json_keys(translations)[i], json_extract_string(translations, '$.' || json_keys(translations)[i]) FROM (SELECT *, unnest(range(1, len(json_keys(translations)) + 1)) AS i FROM x)""")
def a10_corpus_entry(spark, sf_dir):
    corpus = view(spark, sf_dir, "bug_corpus")
    return stats.corpus_entry(corpus, corpus.agg(F.max("id")).first()[0])


@query(cte("runs", "fused_pairs") + SIGNED + """, p AS (SELECT count(*) AS covered FROM (SELECT DISTINCT least(id_a, id_b), greatest(id_a, id_b) FROM fused_pairs WHERE id_a <> id_b)), n AS (SELECT CAST(count(*) * (count(*) - 1) / 2 AS DOUBLE) AS total FROM part),
o AS (SELECT count(*) AS samples, CAST(epoch(max(CAST(ts AS TIMESTAMP))) - epoch(min(CAST(ts AS TIMESTAMP))) AS DOUBLE) AS elapsed, count(DISTINCT signature) AS signatures, round(100.0 * (1 - count(*) FILTER (syntax_error) / count(*)), 6) AS valid_rate FROM signed)
SELECT samples, round(elapsed, 3) AS elapsed, round(samples / elapsed, 6) AS samples_per_second, signatures, valid_rate, covered, round(100.0 * least(covered, total) / total, 6) AS percent, round(covered / elapsed, 6) AS pairs_per_second FROM o, p, n""")
def a6_run_status(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.count("*").alias("n"))
    status = stats.run_status(signed(spark, sf_dir), pairing.pair_coverage(n, view(spark, sf_dir, "fused_pairs")))
    return status.withColumn("elapsed", F.round("elapsed", 3)).select("samples", "elapsed", F.round("samples_per_second", 6).alias("samples_per_second"), "signatures", F.round("valid_rate", 6).alias("valid_rate"), "covered", F.round("percent", 6).alias("percent"), F.round("pairs_per_second", 6).alias("pairs_per_second"))
