"""Seed corpora: cleaning, appending, subsets, imports, sections, worklists and crash bundles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import draw, found, let, lines, strip

#: Language of the translations of a project; of a seed's type.
TRANSLATION_LANGUAGE = {"cpython": "python", "gcc": "c", "clang": "c", "go": "go", "rust": "rust", "php": "php", "swift": "swift", "lean": "lean", "mlir": "mlir", "naga": "rust", "wgslc": "wgsl", "sql": "sql", "v8": "javascript", "inferredbugs-java": "java", "inferredbugs-csharp": "csharp"}
ANALYSIS_LANGUAGE = {"python": "cpython", "py": "cpython", "cpython": "cpython", "rust": "rust", "rs": "rust", "php": "php", "phpt": "php", "go": "go", "c": "clang", "cpp": "clang", "cxx": "clang", "clang": "clang", "swift": "swift", "haskell": "haskell", "hs": "haskell", "ghc": "haskell", "flang": "flang", "fortran": "flang", "f90": "flang", "mlir": "mlir"}
#: Extension of a project's bundle, by a part of the project's name, first match first.
BUNDLE_EXTENSION = (("php", ".phpt"), ("cpython", ".py"), ("python", ".py"), ("mlir", ".mlir"), ("swift", ".swift"), ("rust", ".rs"), ("clang", ".c"), ("gcc", ".c"), ("flang", ".f90"), ("fortran", ".f90"), ("haskell", ".hs"))
#: Signs of pseudo-code, and of real structure.
NOT_MLIR = (r":\s*string\b", r'(?<!["\w])==(?![>="\w])', r'"std\.', r"\bstd\.(?:constant|addi|load|store|call|return)\b", r"\bimport\s+\w", r"\bdef\s+\w+\s*\(", r"\bclass\s+\w+", r'=\s*constant\s+[\d"(+-]', r"=\s*(?:addi|subi|muli|divi|addf|subf|mulf|divf)\s+%", r"=\s*(?:cmpi|cmpf)\s+\w", r"=\s*(?:alloc|store|load)\s*[(%]", r"%\w+\s*=\s*type\s*\{", r"\balloca\b(?!\s+[^,]*memref)", r"\barith\.divi\b", r"\barith\.modi\b", r"\bfunc\.constant\b", r"(?<!\w)for\s+%\w+\s+in\b", r"(?<!\w)if\s+%\w+\s*:", r'=\s*"[^"]*"\s*:\s*!', r":\s*!(?:string|void|llvm\.str(?:ing)?|object)\b")
MLIR = r"func\.func\b|arith\.\w|scf\.\w|memref\.\w|module\s*\{|cf\.\w|linalg\.\w"
#: Caps of a harvest by bucket.
TICKET, CAPS = r"^T\d+[a-zA-Z_]*\.hs$", {"ticket": 700, "other": 500}


# -- sources and sinks ----------------------------------------------------------------------------


def drop_blacklisted(seeds: DataFrame, terms: list[str]) -> DataFrame:
    """Without seeds whose content holds any of the terms as plain text; null content stays."""
    hit = reduce(lambda a, b: a | b, [F.contains(F.col("content"), F.lit(t)) for t in terms], F.lit(False))
    return seeds.filter(~F.coalesce(hit, F.lit(False)))


def append_seeds(new: DataFrame, existing: DataFrame, order: str, key: str = "identifier") -> DataFrame:
    """S3: rows of new whose key is not stored yet; of a key that repeats, the first by `order`.

    Only keys and order values are shuffled to find the first rows.
    """
    firsts = new.groupBy(key).agg(F.min(order).alias(order)).join(existing.select(key).distinct(), key, "left_anti")
    return new.join(firsts, [key, order], "left_semi")


def save_subset(rows: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """(identifier, content) after writing rows over existing ones; the last write of a key wins.

    The key is the file name, else the id, else a fresh one made from the row.
    """
    fresh = F.md5(F.concat_ws("|", F.coalesce("content", F.lit("")), F.col(order).cast("string")))
    key = F.coalesce(F.nullif("filename", F.lit("")), F.nullif(F.col("id").cast("string"), F.lit("")), fresh)
    written = rows.select(key.alias("identifier"), "content", F.struct(F.lit(1).alias("late"), F.col(order).alias("nth")).alias("at"))
    stored = existing.select("identifier", "content", F.struct(F.lit(0).alias("late"), F.lit(0).cast(rows.schema[order].dataType).alias("nth")).alias("at"))
    return stored.unionByName(written).groupBy("identifier").agg(F.max_by("content", "at").alias("content"))


def import_programs(new: DataFrame, existing: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """(added rows, counts by status): present names are skipped, null programs fail."""
    known = existing.filter(F.col("project") == project).select("name", F.lit(True).alias("present")).distinct()
    status = F.when(F.col("present"), "skipped").when(F.col("program").isNull(), "failed").otherwise("added")
    judged = new.join(known, "name", "left").withColumn("status", status)
    return judged.filter("status = 'added'").drop("present", "status").withColumn("project", F.lit(project)), judged.groupBy("status").agg(F.count("*").alias("n"))


def inject_translations(corpus: DataFrame, seeds: DataFrame, target: str) -> DataFrame:
    """(identifier, content, source_project, source_name, bug_corpus_id) of texts in the target language that are not seeds yet."""
    text = F.get_json_object("translations", f"$.{target}")
    name = F.coalesce(F.nullif("name", F.lit("")), F.col("id").cast("string"))
    made = corpus.filter((F.col("translations") != "{}") & (text != "")).select(F.concat_ws("_", F.lit("bug_corpus"), F.col("id").cast("string"), "project", name).alias("identifier"), text.alias("content"), F.col("project").alias("source_project"), F.col("name").alias("source_name"), F.col("id").alias("bug_corpus_id"))
    return made.join(seeds.select("identifier").distinct(), "identifier", "left_anti")


def merge_corpora(source: DataFrame, into: DataFrame, project: str) -> DataFrame:
    """Into with the project's seeds of source whose identifiers it lacks."""
    return into.unionByName(source.filter(F.col("project") == project).join(into.select("identifier"), "identifier", "left_anti").select(into.columns))


def exclude_bug_corpus(seeds: DataFrame, type_col: str = "type") -> DataFrame:
    """Without seeds of type bug_corpus; a missing type stays."""
    return seeds.filter(~F.col(type_col).eqNullSafe("bug_corpus"))


def harvest_pool(candidates: DataFrame, seed: int, caps: dict[str, int] | None = None) -> DataFrame:
    """Viable candidates (rc 0) in a repeatable random order, up to a cap for each (source, bucket)."""
    bucket = F.when(F.col("name").rlike(TICKET), "ticket").otherwise("other")
    caps = caps or CAPS
    cap = reduce(lambda a, kv: F.when(F.col("bucket") == kv[0], kv[1]).otherwise(a), caps.items(), F.lit(0))
    order = W.partitionBy("source", "bucket").orderBy(draw(seed, F.col("name")), "name")
    # The largest cap is a bound that every task keeps to before its rows are shuffled.
    return candidates.filter("rc = 0").withColumn("bucket", bucket).withColumn("nth", F.row_number().over(order)).filter((F.col("nth") <= max(caps.values(), default=0)) & (F.col("nth") <= cap))


def flat_name(path: Column, prefix: str | None = None) -> Column:
    """One name for a path: separators to _, or with a prefix to __ after prefix_."""
    return F.replace(path, F.lit("/"), F.lit("_")) if prefix is None else F.concat(F.lit(prefix + "_"), F.replace(path, F.lit("/"), F.lit("__")))


def flat_copies(files: DataFrame, order: str, path: str = "path", prefix: str | None = None) -> DataFrame:
    """(name, path) of the files that are copied: of those that share a flat name the first by `order`."""
    return files.groupBy(flat_name(F.col(path), prefix).alias("name")).agg(F.min_by(path, order).alias("path"))


def crash_bundles(crashes: DataFrame) -> DataFrame:
    """One row for each (project, signature): folder, extension and the latest run (project, signature, run_id, extension may be null)."""
    safe = F.regexp_replace("signature", r"[^a-zA-Z0-9_\-.]", "_")
    short = F.when(F.length(safe) > 300, F.concat(F.substring(safe, 1, 291), F.lit("_"), F.substring(F.sha1("signature"), 1, 8))).otherwise(safe)
    folder = F.when(F.col("signature").startswith("ASAN:memory-leak"), F.concat(F.lit("leaks/"), short)).otherwise(short)
    ext = F.lit(".txt")
    for part, own in reversed(BUNDLE_EXTENSION):
        chosen = F.coalesce(F.nullif("extension", F.lit("")), F.lit(own)) if own in (".c", ".f90") else F.lit(own)
        ext = F.when(F.contains("project", F.lit(part)), chosen).otherwise(ext)
    named = crashes.filter("signature IS NOT NULL").select("project", folder.alias("folder"), "signature", "run_id", ext.alias("extension"))
    return named.groupBy("project", "folder").agg(F.max_by("signature", "run_id").alias("signature"), F.max_by("extension", "run_id").alias("extension"), F.max("run_id").alias("run_id"))


def bundle_parents(crashes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(run_id, label, identifier) of each crash's parents that exist, labelled a, b, c, d, then by place.

    crashes: (run_id, parents array of seed_no). The crashes, not the seeds, set the size of the join.
    """
    each = crashes.select("run_id", F.posexplode("parents").alias("nth", "seed_no"))
    label = F.coalesce(F.get(F.array(*map(F.lit, "abcd")), F.col("nth")), F.col("nth").cast("string"))
    return each.join(seeds.select("seed_no", "identifier"), "seed_no").select("run_id", label.alias("label"), "identifier")


def bundle_output(err: Column, out: Column) -> Column:
    """Stderr, then stdout, each without trailing line feeds and with one, as far as they hold text."""
    end = lambda c: F.concat(F.regexp_replace(c, r"\n+$", ""), F.lit("\n"))
    part = lambda c: F.when(F.coalesce(c, F.lit("")) != "", end(c)).otherwise("")
    return F.concat(part(err), part(out))


def class_catalog(members: DataFrame) -> DataFrame:
    """(class_name, attributes, methods): members in order, empty lists where there are none."""
    attribute, method = F.col("kind") == "attribute", F.col("kind") == "method"
    return members.groupBy("class_name").agg(F.sort_array(F.collect_list(F.when(attribute, F.col("member")))).alias("attributes"), F.sort_array(F.collect_list(F.when(method, F.struct(F.col("member").alias("name"), "params_count")))).alias("methods"))


def normalize_seeds(rows: DataFrame) -> DataFrame:
    """Content and type are never missing: bare text is of type raw."""
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    return rows.select(*(c for c in rows.columns if c not in ("content", "type")), F.coalesce(has("content"), F.lit("")).alias("content"), F.coalesce(has("type"), F.lit("raw")).alias("type"))


# -- filters and predicates -----------------------------------------------------------------------


def phpt_file(text: Column) -> Column:
    """The FILE section up to the next section line, stripped; null when there is none."""
    head = r"^--.*--$"
    numbered = let(F.split(text, r"\r\n|\n|\r", -1), lambda ls: F.transform(ls, lambda x, i: F.struct(i.alias("i"), (strip(x).rlike(head) & (F.length(strip(x)) >= 4)).alias("h"), (strip(x) == "--FILE--").alias("f"))))
    start = lambda ns: F.array_min(F.transform(F.filter(ns, lambda n: n["f"]), lambda n: n["i"]))
    span = let(numbered, lambda ns: let(start(ns), lambda s: F.struct(s.alias("s"), F.array_min(F.transform(F.filter(ns, lambda n: n["h"] & ~n["f"] & (n["i"] > s)), lambda n: n["i"])).alias("e"))))
    return let(F.struct(F.split(text, r"\r\n|\n|\r", -1).alias("l"), span.alias("p")), lambda x: F.when(x["p"]["s"].isNotNull() & (F.coalesce(x["p"]["e"], F.size(x["l"])) - x["p"]["s"] > 1), strip(F.array_join(F.slice(x["l"], x["p"]["s"] + 2, F.coalesce(x["p"]["e"], F.size(x["l"])) - x["p"]["s"] - 1), "\n"))))


def extract_section(text: Column, tag: str) -> Column:
    """What follows the tag up to the next --NAME-- or the end, without line feeds around it; empty without the tag."""
    rest = F.substring(text, F.locate(tag, text) + len(tag), F.length(text))
    return F.when(F.locate(tag, text) == 0, "").otherwise(F.btrim(F.get(F.split(rest, r"--[_A-Z]+--", 2), F.lit(0)), F.lit("\n")))


def display_code(content: Column, extension: Column) -> Column:
    """The FILE section of a .phpt text if it has one, else the text."""
    return F.when(extension == ".phpt", F.coalesce(F.nullif(phpt_file(content), F.lit("")), content)).otherwise(content)


def importable(content: Column, project: Column) -> Column:
    """Whether a test file of v8, go or InferredBugs is worth importing."""
    body = strip(content)
    code = lambda t: F.filter(F.transform(lines(t), strip), lambda x: (x != "") & ~x.startswith("//"))
    go = let(body, lambda t: ~strip(F.coalesce(F.get(lines(t), F.lit(0)), F.lit(""))).rlike(r"(?i)^//\s*skip\b") & let(code(t), lambda c: (F.size(c) > 0) & ~((F.size(c) == 1) & F.get(c, F.lit(0)).rlike(r"^package\s+\w+"))))
    small = F.octet_length(content) <= 100_000
    return F.coalesce((body != "") & F.when(project.startswith("inferredbugs"), small).when(project == "go", go).otherwise(True), F.lit(False))


def php_secondary(content: Column) -> Column:
    """P5."""
    return F.contains(content, F.lit("--EXPECTF--")) | F.contains(content, F.lit("declare(")) | F.contains(content, F.lit("namespace"))


def run_plan(seeds: DataFrame, force: bool = False, collect: bool = False, filter_valid: bool = False) -> DataFrame:
    """Seeds with plan: run, keep (done already) or drop (done, but not valid where that is asked for)."""
    done, analysed = F.coalesce("dryrun_done", F.lit(False)), F.coalesce("pre_analysis_done", F.lit(False))
    run = F.lit(force) | (F.lit(filter_valid) & ~done) | (F.lit(collect) & ~analysed)
    return seeds.withColumn("plan", F.when(run, "run").when(F.lit(not filter_valid) | (F.coalesce("rc", F.lit(-1)) == 0), "keep").otherwise("drop"))


def valid_only(seeds: DataFrame, asked: bool = True) -> DataFrame:
    """P7."""
    return seeds.filter("rc = 0") if asked else seeds


def report_kept(out: Column, code: Column, noise: list[str], denied: list[str], pairs: list[tuple[str, str]] = ()) -> Column:
    """P10: whether a crash report stays: no known noise, a crash marker, no denied text (or both of a pair) in the code.

    The lists are tables of the project; markers and the rules for assertions and leaks are fixed.
    """
    any_in = lambda c, terms: reduce(lambda a, b: a | b, [F.contains(c, F.lit(t)) for t in terms], F.lit(False))
    marked = any_in(out, ["SUMMARY:", "SystemError:", "(core dumped)", "Assertion failed:", ": Assertion `"])
    both = reduce(lambda a, p: a | (F.contains(code, F.lit(p[0])) & F.contains(code, F.lit(p[1]))), pairs, F.lit(False))
    asserted = F.contains(out, F.lit(": Assertion `")) & any_in(out, ["python: ../Python/importdl.c", "python: ../Objects/codeobject.c:"])
    leaked = F.contains(out, F.lit("leaked")) & (any_in(code, ["atexit", "curse", "script_helper", "fork()", "pack(*args)", "ConstructsNone", "from xml.parsers import expat"]) | F.contains(out, F.lit("make_executor_from_uops")))
    return ~any_in(out, noise) & marked & ~any_in(code, denied) & ~both & ~F.contains(out, F.lit("_ssl__SSLSocket_write_impl")) & ~asserted & ~leaked


def translations(c: str = "translations") -> Column:
    return F.from_json(c, "map<string,string>")


def translation_worklist(corpus: DataFrame, target: str, source: str | None = None, force: bool = False) -> DataFrame:
    """Entries without a translation to target (all, when forced), by id."""
    own = corpus if source is None else corpus.filter(F.col("project") == source)
    return (own if force else own.filter(~F.map_contains_key(translations(), target))).orderBy("id")


def refine_worklist(corpus: DataFrame, target: str, part: str = "") -> DataFrame:
    """Entries whose translation exists and holds the part."""
    return corpus.filter(F.contains(translations()[target], F.lit(part)))


def accept_refined(refined: DataFrame, avoid: list[str], force: bool = False) -> DataFrame:
    """Rows with status saved or failed: null, empty and texts with an avoided name fail; force admits the last."""
    hit = reduce(lambda a, b: a | b, [F.contains("text", F.lit(t)) for t in avoid], F.lit(False))
    return refined.withColumn("status", F.when(F.coalesce("text", F.lit("")) == "", "failed").when(hit & F.lit(not force), "failed").otherwise("saved"))


def set_translation(corpus: DataFrame, updates: DataFrame) -> DataFrame:
    """Corpus with the translations of (id, target, text) put in; other languages stay, the last row of a pair wins by text.

    An update of an unknown id fails.
    """
    lost = updates.join(corpus.select("id"), "id", "left_anti")
    if not lost.isEmpty():
        raise LookupError(f"no entry {lost.first().id}")
    own = updates.groupBy("id", "target").agg(F.max("text").alias("text")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("target", "text"))).alias("new"))
    kept = F.map_filter(translations(), lambda k, v: ~F.map_contains_key(F.col("new"), k))
    return corpus.join(own, "id", "left").withColumn("translations", F.when(F.col("new").isNull(), F.col("translations")).otherwise(F.to_json(F.map_concat(kept, "new")))).drop("new")


def merge_metadata(seeds: DataFrame, updates: DataFrame, fields: list[str], key: str = "identifier") -> DataFrame:
    """Seeds with the fields that updates give (not null); unknown keys are passed over. One update for each key."""
    new = updates.select(key, *(F.col(f).alias(f"new_{f}") for f in fields))
    return seeds.join(new, key, "left").withColumns({f: F.coalesce(f"new_{f}", f) for f in fields}).drop(*(f"new_{f}" for f in fields))


def clean_reply(text: Column) -> Column:
    """The body of the first fenced block, else the text; stripped."""
    return strip(F.coalesce(found(text, r"(?s)```(?:\w+)?\n(.*?)```"), text))


def repro_command(script: Column) -> Column:
    """The last line that is not blank, a comment or a setting of SCRIPT_DIR, with that folder as `.`; null without one."""
    own = F.filter(lines(script), lambda x: (strip(x) != "") & ~strip(x).startswith("#") & ~F.contains(x, F.lit("SCRIPT_DIR=")))
    last = F.get(F.reverse(own), F.lit(0))
    return F.replace(F.replace(last, F.lit("$SCRIPT_DIR"), F.lit(".")), F.lit("${SCRIPT_DIR}"), F.lit("."))


def canonical_language(name: Column, names: dict[str, str] = TRANSLATION_LANGUAGE) -> Column:
    """By the table, else the lowered name."""
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.element_at(table, F.lower(name)), F.lower(name))


def c_type(path: Column, gcc: bool = True) -> Column:
    """C, cpp or objc by the extension."""
    cpp = (".cc", ".cpp", ".hpp") if gcc else (".cpp", ".cc", ".cxx", ".mm")
    is_cpp = reduce(lambda a, b: a | b, [path.endswith(e) for e in cpp])
    return F.when(is_cpp, "cpp").when(path.endswith(".m") & F.lit(not gcc), "objc").otherwise("c")


def plausible_mlir(text: Column) -> Column:
    """P20: no sign of pseudo-code, and some real structure."""
    return ~reduce(lambda a, b: a | b, [text.rlike(p) for p in NOT_MLIR]) & text.rlike(MLIR)
