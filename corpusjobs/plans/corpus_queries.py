"""Queries over seed corpora, each with the SQL that DuckDB checks it by."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from .views import cte, view

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has any."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


SEEDS, BUGS = cte("seeds"), cte("bug_corpus")


@query(SEEDS + "SELECT identifier FROM seeds WHERE NOT (contains(content, 'the ') OR contains(content, 'Token'))")
def s2_blacklist(spark, sf_dir):
    return C.drop_blacklisted(view(spark, sf_dir, "seeds"), ["the ", "Token"]).select("identifier")


@query(SEEDS + ", n AS (SELECT seed_no, md5(content) AS identifier FROM seeds WHERE seed_no % 3 <> 0), e AS (SELECT md5(content) AS identifier FROM seeds WHERE seed_no % 3 = 0) SELECT identifier, min(seed_no) AS seed_no FROM n WHERE identifier NOT IN (SELECT identifier FROM e) GROUP BY 1")
def s3_append_seeds(spark, sf_dir):
    """Texts named by their md5: copies are repeats of an identifier."""
    named = view(spark, sf_dir, "seeds").select("seed_no", F.md5("content").alias("identifier"))
    return C.append_seeds(named.filter("seed_no % 3 <> 0"), named.filter("seed_no % 3 = 0"), "seed_no").select("identifier", "seed_no")


@query(SEEDS + """, w AS (SELECT 1 AS p, seed_no AS q, coalesce(nullif(CASE WHEN seed_no % 2 = 0 THEN 'f' || seed_no % 50 ELSE '' END, ''), CAST(seed_no % 70 AS VARCHAR)) AS identifier, md5(content) AS content FROM seeds
UNION ALL SELECT 0, 0, 'f' || seed_no, md5(identifier) FROM seeds WHERE seed_no < 80) SELECT identifier, arg_max(content, p * 1000000000 + q) AS content FROM w GROUP BY 1""")
def s5_save_subset(spark, sf_dir):
    seeds = view(spark, sf_dir, "seeds")
    rows = seeds.select("seed_no", F.expr("CASE WHEN seed_no % 2 = 0 THEN concat('f', seed_no % 50) ELSE '' END").alias("filename"), F.expr("seed_no % 70").alias("id"), F.md5("content").alias("content"))
    stored = seeds.filter("seed_no < 80").select(F.expr("concat('f', seed_no)").alias("identifier"), F.md5("identifier").alias("content"))
    return C.save_subset(rows, stored, "seed_no")


@query(BUGS + ", j AS (SELECT b.*, e.name IS NOT NULL AS present FROM bug_corpus b LEFT JOIN (SELECT DISTINCT name FROM bug_corpus WHERE project = 'src1') e ON e.name = b.name) SELECT CASE WHEN present THEN 'skipped' WHEN program IS NULL OR id % 7 = 0 THEN 'failed' ELSE 'added' END AS status, count(*) AS n FROM j GROUP BY 1")
def s7_import_programs(spark, sf_dir):
    bugs = view(spark, sf_dir, "bug_corpus")
    new = bugs.select("name", F.when(F.col("id") % 7 != 0, F.col("program")).alias("program"))
    return C.import_programs(new, bugs, "src1")[1]


@query(BUGS + """, t AS (SELECT *, json_extract_string(translations, '$.rust') AS content FROM bug_corpus WHERE translations <> '{}')
SELECT 'bug_corpus_' || id || '_' || project || '_' || coalesce(nullif(name, ''), CAST(id AS VARCHAR)) AS identifier, content, project AS source_project, name AS source_name, id AS bug_corpus_id FROM t WHERE content <> ''""")
def s8_inject_translations(spark, sf_dir):
    return C.inject_translations(view(spark, sf_dir, "bug_corpus"), view(spark, sf_dir, "seeds"), "rust")


@query(SEEDS + ", i AS (SELECT * FROM seeds WHERE seed_no % 2 = 0) SELECT identifier, project FROM i UNION ALL SELECT identifier, project FROM seeds WHERE project = 'src3' AND identifier NOT IN (SELECT identifier FROM i)")
def s9_merge_corpora(spark, sf_dir):
    seeds = view(spark, sf_dir, "seeds").select("seed_no", "identifier", "project")
    return C.merge_corpora(seeds, seeds.filter("seed_no % 2 = 0"), "src3").select("identifier", "project")


@query(SEEDS + "SELECT identifier FROM seeds WHERE CASE WHEN seed_no % 5 = 0 THEN 'bug_corpus' WHEN seed_no % 5 = 1 THEN NULL ELSE type END IS DISTINCT FROM 'bug_corpus'")
def s10_exclude_bug_corpus(spark, sf_dir):
    marked = view(spark, sf_dir, "seeds").withColumn("type", F.expr("CASE WHEN seed_no % 5 = 0 THEN 'bug_corpus' WHEN seed_no % 5 = 1 THEN NULL ELSE type END"))
    return C.exclude_bug_corpus(marked).select("identifier")


@query(SEEDS + """, c AS (SELECT project AS source, CASE WHEN seed_no % 3 = 0 THEN 'T' || seed_no || '.hs' ELSE 'x' || seed_no || '.hs' END AS name FROM seeds WHERE seed_no % 4 <> 1),
b AS (SELECT *, CASE WHEN regexp_matches(name, '^T\\d+[a-zA-Z_]*\\.hs$') THEN 'ticket' ELSE 'other' END AS bucket FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY source, bucket ORDER BY md5('7|' || name), name) AS nth FROM b)
SELECT source, bucket, name FROM r WHERE nth <= CASE bucket WHEN 'ticket' THEN 3 ELSE 2 END""".replace("\\\\", "\\"))
def s11_harvest_pool(spark, sf_dir):
    made = view(spark, sf_dir, "seeds").select(F.col("project").alias("source"), F.expr("CASE WHEN seed_no % 3 = 0 THEN concat('T', seed_no, '.hs') ELSE concat('x', seed_no, '.hs') END").alias("name"), F.expr("CASE WHEN seed_no % 4 = 1 THEN 1 ELSE 0 END").alias("rc"))
    return C.harvest_pool(made, 7, {"ticket": 3, "other": 2}).select("source", "bucket", "name")


@query(SEEDS + "SELECT identifier, replace(identifier, '/', '_') AS flat, 'ghc_' || replace(identifier, '/', '__') AS safe FROM seeds")
def s12_flat_names(spark, sf_dir):
    return view(spark, sf_dir, "seeds").select("identifier", C.flat_name(F.col("identifier")).alias("flat"), C.flat_name(F.col("identifier"), "ghc").alias("safe"))


COPIES = "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat('a/', (doc_id - doc_id % 3) / 3, '/x.php') WHEN 1 THEN concat('a_', (doc_id - 1) / 3, '/x.php') ELSE concat('a/', (doc_id - 2) / 3, '_x.php') END AS path FROM documents"


@query(f"WITH p AS ({COPIES}) SELECT replace(path, '/', '_') AS name, arg_min(path, doc_id) AS path FROM p GROUP BY 1")
def s12_flat_copies(spark, sf_dir):
    """Paths in threes that share a flat name."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return C.flat_copies(spark.sql(f"WITH documents AS (SELECT * FROM {{documents}}) {COPIES}", documents=documents), "doc_id")


CRASHES = cte("runs") + ", c AS (SELECT run_id, project, CASE WHEN run_id % 5 = 0 THEN 'ASAN:memory-leak ' || left(stderr, 40) ELSE repeat(stderr, 3) END AS signature FROM runs WHERE return_code <> 0) "


@query(CRASHES + r""", f AS (SELECT *, regexp_replace(signature, '[^a-zA-Z0-9_\-.]', '_', 'g') AS safe FROM c), g AS (SELECT *, CASE WHEN starts_with(signature, 'ASAN:memory-leak') THEN 'leaks/' ELSE '' END || CASE WHEN length(safe) > 300 THEN left(safe, 291) || '_' || left(sha1(signature), 8) ELSE safe END AS folder FROM f)
SELECT project, folder, arg_max(signature, run_id) AS signature, CASE project WHEN 'php' THEN '.phpt' WHEN 'cpython' THEN '.py' WHEN 'rust' THEN '.rs' ELSE '.c' END AS extension, max(run_id) AS run_id FROM g GROUP BY 1, 2""")
def s13_crash_bundles(spark, sf_dir):
    crashes = view(spark, sf_dir, "runs").filter("return_code <> 0").selectExpr("run_id", "project", "CASE WHEN run_id % 5 = 0 THEN concat('ASAN:memory-leak ', left(stderr, 40)) ELSE repeat(stderr, 3) END AS signature", "CAST(NULL AS STRING) AS extension")
    return C.crash_bundles(crashes)


@query(cte("runs") + "SELECT run_id, CASE WHEN stderr <> '' THEN rtrim(stderr, chr(10)) || chr(10) ELSE '' END || CASE WHEN stdout <> '' THEN rtrim(stdout, chr(10)) || chr(10) ELSE '' END AS output FROM runs")
def s14_bundle_output(spark, sf_dir):
    return view(spark, sf_dir, "runs").select("run_id", C.bundle_output(F.col("stderr"), F.col("stdout")).alias("output"))


@query(cte("runs", "seeds") + ", e AS (SELECT run_id, 'a' AS label, parent_a AS s FROM runs WHERE return_code <> 0 UNION ALL SELECT run_id, 'b', parent_b FROM runs WHERE return_code <> 0) SELECT run_id, label, identifier FROM e JOIN seeds ON seed_no = s")
def s15_bundle_parents(spark, sf_dir):
    crashes = view(spark, sf_dir, "runs").filter("return_code <> 0").select("run_id", F.array("parent_a", "parent_b").alias("parents"))
    return C.bundle_parents(crashes, view(spark, sf_dir, "seeds"))


@query(cte("class_members") + """SELECT class_name, array_to_string(coalesce(list(member ORDER BY member) FILTER (kind = 'attribute'), []), ',') AS attributes,
array_to_string(coalesce(list(member || ':' || params_count ORDER BY member, params_count) FILTER (kind = 'method'), []), ',') AS methods FROM class_members GROUP BY 1""")
def s20_class_catalog(spark, sf_dir):
    found = C.class_catalog(view(spark, sf_dir, "class_members"))
    return found.select("class_name", F.array_join("attributes", ",").alias("attributes"), F.array_join(F.transform("methods", lambda m: F.concat_ws(":", m["name"], m["params_count"])), ",").alias("methods"))


@query(SEEDS + "SELECT seed_no, coalesce(CASE WHEN seed_no % 3 > 0 THEN identifier END, '') AS content, coalesce(CASE WHEN seed_no % 2 > 0 THEN type END, 'raw') AS type FROM seeds")
def s22_normalize_seeds(spark, sf_dir):
    rows = view(spark, sf_dir, "seeds").selectExpr("seed_no", "CASE WHEN seed_no % 3 > 0 THEN identifier END AS content", "CASE WHEN seed_no % 2 > 0 THEN type END AS type")
    return C.normalize_seeds(rows)


#: A text in sections, made from a document.
PHPT = "'--TEST--' || chr(10) || left(content, 20) || chr(10) || CASE WHEN seed_no % 4 = 0 THEN '' ELSE '--FILE--' || chr(10) || '  <?php x' || seed_no || chr(10) || 'y; ' || chr(10) END || '--EXPECT--' || chr(10) || 'ok' || chr(10)"
PHPT_SPARK = "concat('--TEST--', chr(10), left(content, 20), chr(10), CASE WHEN seed_no % 4 = 0 THEN '' ELSE concat('--FILE--', chr(10), '  <?php x', seed_no, chr(10), 'y; ', chr(10)) END, '--EXPECT--', chr(10), 'ok', chr(10))"


@query(SEEDS + f", t AS (SELECT seed_no, {PHPT} AS text FROM seeds) SELECT seed_no, CASE WHEN seed_no % 4 > 0 THEN '<?php x' || seed_no || chr(10) || 'y;' END AS file, CASE WHEN seed_no % 4 = 0 THEN '' ELSE '  <?php x' || seed_no || chr(10) || 'y; ' END AS section, 'ok' AS expected, CASE WHEN seed_no % 4 > 0 THEN '<?php x' || seed_no || chr(10) || 'y;' ELSE text END AS shown FROM t")
def p1_p2_p3_sections(spark, sf_dir):
    text = F.expr(PHPT_SPARK)
    rows = view(spark, sf_dir, "seeds").select("seed_no", text.alias("text"))
    return rows.select("seed_no", C.phpt_file(F.col("text")).alias("file"), C.extract_section(F.col("text"), "--FILE--").alias("section"), C.extract_section(F.col("text"), "--EXPECT--").alias("expected"), C.display_code(F.col("text"), F.lit(".phpt")).alias("shown"))


GO = "CASE seed_no % 6 WHEN 0 THEN '// Skip this' || chr(10) || 'package a' WHEN 1 THEN '// run' || chr(10) || ' package main ' || chr(10) WHEN 2 THEN '// a' || chr(10) || '// b' WHEN 3 THEN '// run' || chr(10) || 'package main' || chr(10) || 'func f() {}' WHEN 4 THEN '  ' ELSE content END"
GO_SPARK = "CASE seed_no % 6 WHEN 0 THEN concat('// Skip this', chr(10), 'package a') WHEN 1 THEN concat('// run', chr(10), ' package main ', chr(10)) WHEN 2 THEN concat('// a', chr(10), '// b') WHEN 3 THEN concat('// run', chr(10), 'package main', chr(10), 'func f() {}') WHEN 4 THEN '  ' ELSE content END"


@query(SEEDS + "SELECT seed_no, CASE WHEN seed_no % 6 IN (0, 1, 2, 4) THEN false ELSE true END AS go, seed_no % 6 <> 4 AND strlen(" + GO + ") <= 100000 AS inferred FROM seeds")
def p4_importable(spark, sf_dir):
    rows = view(spark, sf_dir, "seeds").select("seed_no", F.expr(GO_SPARK).alias("t"))
    return rows.select("seed_no", C.importable(F.col("t"), F.lit("go")).alias("go"), C.importable(F.col("t"), F.lit("inferredbugs-java")).alias("inferred"))


@query(SEEDS + "SELECT seed_no, contains(content, '--EXPECTF--') OR contains(content, 'declare(') OR contains(content, 'namespace') AS secondary, regexp_matches(content, 'func\\.func\\b|arith\\.\\w|scf\\.\\w|memref\\.\\w|module\\s*\\{|cf\\.\\w|linalg\\.\\w') AND NOT regexp_matches(content, '\\bclass\\s+\\w+') AS mlir FROM seeds".replace("\\\\", "\\"))
def p5_p20_text_flags(spark, sf_dir):
    return view(spark, sf_dir, "seeds").select("seed_no", C.php_secondary(F.col("content")).alias("secondary"), C.plausible_mlir(F.col("content")).alias("mlir"))


@query(SEEDS + "SELECT seed_no, CASE WHEN NOT dryrun_done OR NOT pre_analysis_done THEN 'run' WHEN coalesce(rc, -1) = 0 THEN 'keep' ELSE 'drop' END AS plan FROM seeds")
def p6_run_plan(spark, sf_dir):
    return C.run_plan(view(spark, sf_dir, "seeds"), collect=True, filter_valid=True).select("seed_no", "plan")


@query(SEEDS + "SELECT seed_no FROM seeds WHERE rc = 0")
def p7_valid_only(spark, sf_dir):
    return C.valid_only(view(spark, sf_dir, "seeds")).select("seed_no")


@query(cte("runs", "seeds") + "SELECT run_id FROM runs JOIN seeds ON seed_no = parent_a WHERE (contains(stderr, 'SUMMARY:') OR contains(stderr, '(core dumped)') OR contains(stderr, ': Assertion `')) AND NOT contains(stderr, 'obj3.c') AND NOT contains(content, 'Token') AND NOT (contains(content, 'and') AND contains(content, 'the'))")
def p10_report_filter(spark, sf_dir):
    joined = view(spark, sf_dir, "runs").join(view(spark, sf_dir, "seeds").select(F.col("seed_no").alias("parent_a"), "content"), "parent_a")
    return joined.filter(C.report_kept(F.col("stderr"), F.col("content"), ["obj3.c"], ["Token"], [("and", "the")])).select("run_id")


@query(BUGS + "SELECT id, name FROM bug_corpus WHERE json_extract_string(translations, '$.rust') IS NULL")
def p11_translation_worklist(spark, sf_dir):
    return C.translation_worklist(view(spark, sf_dir, "bug_corpus"), "rust").select("id", "name")


@query(BUGS + "SELECT id FROM bug_corpus WHERE contains(json_extract_string(translations, '$.python'), 'ctypes')")
def p12_refine_worklist(spark, sf_dir):
    return C.refine_worklist(view(spark, sf_dir, "bug_corpus"), "python", "ctypes").select("id")


@query(BUGS + ", t AS (SELECT json_extract_string(translations, '$.python') AS text FROM bug_corpus) SELECT CASE WHEN coalesce(text, '') = '' OR contains(text, 'ctypes') THEN 'failed' ELSE 'saved' END AS status, count(*) AS n FROM t GROUP BY 1")
def p13_accept_refined(spark, sf_dir):
    rows = view(spark, sf_dir, "bug_corpus").select("id", C.translations()["python"].alias("text"))
    return C.accept_refined(rows, ["ctypes"]).groupBy("status").agg(F.count("*").alias("n"))


@query(BUGS + "SELECT id, CASE WHEN id % 2 = 0 THEN 'new ' || id ELSE json_extract_string(translations, '$.rust') END AS rust, json_extract_string(translations, '$.python') AS python FROM bug_corpus")
def p14_set_translation(spark, sf_dir):
    bugs = view(spark, sf_dir, "bug_corpus")
    put = C.set_translation(bugs, bugs.filter("id % 2 = 0").selectExpr("id", "'rust' AS target", "concat('new ', id) AS text"))
    return put.select("id", C.translations()["rust"].alias("rust"), C.translations()["python"].alias("python"))


@query(SEEDS + "SELECT identifier, CASE WHEN seed_no % 2 = 0 THEN 7 ELSE rc END AS rc, CASE WHEN seed_no % 6 = 0 THEN true ELSE dryrun_done END AS dryrun_done FROM seeds")
def p15_merge_metadata(spark, sf_dir):
    seeds = view(spark, sf_dir, "seeds")
    updates = seeds.filter("seed_no % 2 = 0").selectExpr("identifier", "7 AS rc", "CASE WHEN seed_no % 6 = 0 THEN true END AS dryrun_done")
    return C.merge_metadata(seeds, updates, ["rc", "dryrun_done"]).select("identifier", "rc", "dryrun_done")


@query(SEEDS + "SELECT seed_no, CASE WHEN seed_no % 2 = 0 THEN 'a = ' || seed_no ELSE 'say ' || seed_no END AS cleaned, CASE WHEN seed_no % 3 = 0 THEN NULL ELSE './run x' || seed_no || ' ./t.c' END AS command FROM seeds")
def p16_p17_replies_and_commands(spark, sf_dir):
    reply = F.expr("CASE WHEN seed_no % 2 = 0 THEN concat('Here:', chr(10), '```python', chr(10), ' a = ', seed_no, chr(10), '```', chr(10), 'done') ELSE concat('  say ', seed_no, chr(10)) END")
    script = F.expr("CASE WHEN seed_no % 3 = 0 THEN concat('#!/bin/sh', chr(10), 'SCRIPT_DIR=x', chr(10)) ELSE concat('#!/bin/sh', chr(10), 'SCRIPT_DIR=x', chr(10), './run x', seed_no, ' $SCRIPT_DIR/t.c', chr(10), '# end', chr(10), ' ', chr(10)) END")
    return view(spark, sf_dir, "seeds").select("seed_no", C.clean_reply(reply).alias("cleaned"), C.repro_command(script).alias("command"))


@query(SEEDS + "SELECT seed_no, CASE seed_no % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'c' ELSE project END AS language, CASE WHEN seed_no % 2 = 0 THEN 'cpp' ELSE 'c' END AS c_type FROM seeds")
def p18_p19_languages(spark, sf_dir):
    name = F.expr("CASE seed_no % 3 WHEN 0 THEN 'CPython' WHEN 1 THEN 'gcc' ELSE upper(project) END")
    path = F.expr("CASE WHEN seed_no % 2 = 0 THEN concat(identifier, '.cc') ELSE concat(identifier, '.c') END")
    return view(spark, sf_dir, "seeds").select("seed_no", C.canonical_language(name).alias("language"), C.c_type(path).alias("c_type"))
