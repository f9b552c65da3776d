"""Triage of crashes: first seen, clusters, matches, search terms, known issues, parents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import signatures as G
from ..functions.text import all_found, found, let, strip, words
from .tables import cut, numbered

#: Words that name a kind of crash.
KEYWORDS = ("SUMMARY:", "Assertion:", "ASAN:", "LLVM ERROR:", "compiler panic:", "compiler fatal:", "internal compiler error:", "Fatal Python error:", "INTERNAL PANIC:", "Check failed:", "Fatal error:", "Segmentation fault", "Bus error", "SIGSEGV", "SIGABRT")
#: Messages that nearly every crash of a parser has.
BOILERPLATE = r"current parser token|at annotation token|<eof> parser at end of file|^Program arguments"


def with_signatures(runs: DataFrame) -> DataFrame:
    """runs with crashed, syntax_error and signature (of crashed rows only)."""
    crashed = G.crashed(F.col("project"), F.col("stdout"), F.col("stderr"))
    marked = runs.withColumn("crashed", crashed).withColumn("syntax_error", G.syntax_error(F.col("stderr"), F.col("return_code")))
    return G.with_signature(marked, F.col("project"), F.col("stdout"), F.col("stderr"), F.col("crashed"))


def first_seen(crashes: DataFrame, known: DataFrame | None = None, order: str = "run_id") -> DataFrame:
    """(key, first, n) of signatures not known yet, with the first run by arrival and the number of runs.

    A crash without a signature is kept with a key of its own, NoSig_<run>. The minimum is taken before the
    shuffle, so a signature that most rows share stays cheap.
    """
    key = F.coalesce(F.col("signature"), F.concat(F.lit("NoSig_"), F.col(order).cast("string")))
    seen = crashes.withColumn("key", key).groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    return seen if known is None else seen.join(known.select(F.col("signature").alias("key")).distinct(), "key", "left_anti")


def cluster_members(reports: DataFrame, name: str = "name", text: str = "text", project: str = "project") -> DataFrame:
    """(signature, member) of saved outputs, whose signature is found anew by the project's own cascade."""
    own = G.with_signature(reports, F.col(project), F.lit(""), F.col(text), name="__own", last=None)
    found_anew = F.coalesce("__own", F.concat(F.lit("(unrecognized) "), F.col(name).cast("string")))
    return own.select(found_anew.alias("signature"), F.col(name).cast("string").alias("member"))


def clusters(members: DataFrame, shown: int = 6) -> DataFrame:
    """(signature, size, first): how many members a signature has, and the `shown` smallest of them.

    Both are found in the tasks before anything is shuffled, so a signature of a crash storm stays cheap.
    """
    sizes = members.groupBy("signature").agg(F.count("*").alias("size"))
    nth = F.row_number().over(W.partitionBy("signature").orderBy("member"))
    first = members.withColumn("nth", nth).filter(F.col("nth") <= shown).groupBy("signature").agg(F.sort_array(F.collect_list("member")).alias("first"))
    return sizes.join(first, "signature")


def cluster_report(found_clusters: DataFrame, shown: int = 6) -> DataFrame:
    """Clusters by size descending (ties: smallest member), their rank, the first members and how many more."""
    more = F.when(F.col("size") > shown, F.concat(F.lit(" +"), (F.col("size") - shown).cast("string"), F.lit(" more"))).otherwise("")
    ranked = numbered(found_clusters.withColumn("least", F.get("first", F.lit(0))), F.desc("size"), F.col("least"), name="rank")
    return ranked.select((F.col("rank") + 1).alias("rank"), "signature", "size", F.concat(F.array_join(F.slice("first", 1, shown), ", "), more).alias("shown"))


def bare_text(signature: Column) -> Column:
    """What follows 'Stack dump:'."""
    return strip(F.substring(signature, 12, 2147483647))


def is_chain(text: Column) -> Column:
    return F.contains(text, F.lit("::")) | F.contains(text, F.lit(" > "))


def frames(signature: Column, most: int = 3) -> Column:
    """T4: symbol frames of a stack dump signature; empty for any other."""
    bare = let(bare_text(signature), lambda rest: F.when(is_chain(rest), rest).otherwise(""))
    blob = F.coalesce(found(signature, r"\[(.*)\]\s*$"), bare)
    parts = F.filter(F.transform(F.split(blob, " > ", -1), strip), lambda f: (f != "") & ~F.contains(f, F.lit("+0x")))
    return F.when(signature.startswith("Stack dump:"), F.slice(parts, 1, most)).otherwise(F.array().cast("array<string>"))


def match_key(signature: Column) -> Column:
    """T5: equal keys mean matching signatures; null and empty signatures have none and match nothing."""
    text = F.when(signature != "", F.concat(F.lit("text:"), signature))
    return let(frames(signature), lambda chain: F.when(F.size(chain) > 0, F.concat(F.lit("frames:"), F.array_join(chain, " > "))).otherwise(text))


def signature_classes(rows: DataFrame, signature: str = "signature") -> DataFrame:
    """T5: (match_key, first, n): the classes of matching signatures, which their key names, with the smallest signature and the number of rows.

    Two rows match if match_key() gives them one key; pairs are never formed.
    """
    return rows.select(match_key(F.col(signature)).alias("match_key"), F.col(signature).alias("s")).filter("match_key IS NOT NULL").groupBy("match_key").agg(F.min("s").alias("first"), F.count("*").alias("n"))


def matched(left: DataFrame, right: DataFrame, signature: str = "signature") -> DataFrame:
    """T5: rows of left whose signature matches that of any row of right."""
    keys = right.select(match_key(F.col(signature)).alias("__key")).filter("__key IS NOT NULL").distinct()
    return left.join(keys, match_key(left[signature]) == F.col("__key"), "left_semi")


def keyword_keys(signature: Column) -> Column:
    """What two signatures must share one of: their own text, or a crash keyword; missing ones match their own kind of missing, null or empty."""
    own = F.when(signature.isNull(), F.lit("null:")).otherwise(F.concat(F.lit("text:"), signature))
    return F.concat(F.array(own), F.filter(F.array(*map(F.lit, KEYWORDS)), lambda k: F.coalesce(F.contains(signature, k), F.lit(False))))


def keyword_classes(rows: DataFrame, signature: str = "signature") -> DataFrame:
    """(key, first, n) for each of the keys of the rows: the smallest signature and the number of rows that share the key."""
    return rows.select(F.explode(keyword_keys(F.col(signature))).alias("key"), F.col(signature).alias("s")).groupBy("key").agg(F.min("s").alias("first"), F.count("*").alias("n"))


def keyword_matched(left: DataFrame, right: DataFrame, signature: str = "signature") -> DataFrame:
    """Rows of left that match any row of right: equal, both missing alike, or with a crash keyword in common.

    The keys of right's rows are told apart in two: its keywords are a few, its texts are joined.
    """
    keys = right.select(F.explode(keyword_keys(F.col(signature))).alias("__key")).distinct()
    words = F.coalesce(F.array_intersect(keyword_keys(F.col(signature)), F.lit(list(KEYWORDS))), F.array().cast("array<string>"))
    said = {r["__key"] for r in keys.filter(F.col("__key").isin(*KEYWORDS)).collect()}
    marked = left.withColumn("__word", F.arrays_overlap(words, F.array(*map(F.lit, sorted(said)))) if said else F.lit(False)).withColumn("__own", F.get(keyword_keys(F.col(signature)), F.lit(0)))
    by_text = marked.filter("NOT __word").join(keys, F.col("__own") == F.col("__key"), "left_semi")
    return marked.filter("__word").unionByName(by_text).select(*left.columns)


def short_name(frame: Column) -> Column:
    """the trailing identifier of the last part of a qualified name, else the whole name."""
    return F.coalesce(found(F.substring_index(frame, "::", -1), r"([A-Za-z_~][A-Za-z0-9_]*)$"), frame)


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def search_terms(signature: Column) -> Column:
    """Search texts, the most specific first; none for bare signals."""
    kind = r"^(ASAN|UBSAN|LLVM ERROR|Assertion):\s*(.*)$"
    drop_null = lambda *c: F.array_compact(F.array(*c))

    def of_detail(detail: Column) -> Column:
        phrase = lambda own: F.replace(F.array_join(F.slice(own, 1, 8), " "), F.lit('"'), F.lit(""))
        lone = lambda own: F.btrim(F.get(own, F.lit(0)), F.lit("`'\".,;:()"))
        return let(words(detail), lambda own: F.when(F.size(own) == 0, F.array(detail)).otherwise(drop_null(F.when((F.size(own) >= 2) & (phrase(own) != ""), quoted(phrase(own))), lone(own))))

    def of_frames(names: Column) -> Column:
        bare = let(bare_text(signature), lambda rest: F.when(is_chain(rest), "").otherwise(rest))
        message = F.coalesce(strip(found(signature, r"^Stack dump:\s*(.*?)\s*\[.*\]\s*$")), bare)
        first, next_ = F.get(names, F.lit(0)), F.get(names, F.lit(1))
        alone = let(message, lambda m: F.when((m != "") & ~m.rlike(BOILERPLATE), quoted(m)))
        return drop_null(F.when(F.size(names) > 1, F.concat(quoted(first), F.lit(" "), quoted(next_))), F.when(F.size(names) > 0, quoted(first)).otherwise(alone))

    none = F.array().cast("array<string>")
    by_kind = let(strip(found(signature, kind, 2)), of_detail)
    by_frames = let(F.transform(frames(signature), short_name), of_frames)
    return F.when(signature.rlike("(?d)" + kind), by_kind).when(signature.startswith("Stack dump:"), by_frames).when(signature.isin("Segmentation fault", "Aborted"), none).otherwise(F.array(quoted(F.substring(signature, 1, 80))))


def phrases(term: Column) -> Column:
    """The quoted parts of a search text, or the whole text."""
    return let(all_found(term, r'"([^"]*)"'), lambda parts: F.when(F.size(parts) > 0, parts).otherwise(F.array(term)))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9_]+"), lambda t: t != ""))


def adjacent(tokens: Column) -> Column:
    """The words of a list and each two that stand together, joined by a blank."""
    pairs = F.when(F.size(tokens) > 1, F.zip_with(F.slice(tokens, 1, F.size(tokens) - 1), F.slice(tokens, 2, F.size(tokens) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(tokens, pairs)


def match_issues(found_clusters: DataFrame, issues: DataFrame, shown: int = 5) -> DataFrame:
    """(signature, nth, term, total, top): for each search text the issues whose title or body holds all its phrases.

    Issues are met by the rarest whole word of a text, or the rarest two that stand together in a phrase, as all its words
    may be common, and checked by its phrases; top has up to `shown` numbers, ascending, which are chosen in the tasks
    before anything is shuffled, so that a text that hits every issue stays cheap. Words at the ends of a phrase may be
    parts of longer ones, so they are only used, by the words that hold them, where no inner word exists.
    """
    terms = cut(found_clusters.select("signature", F.posexplode(search_terms(F.col("signature"))).alias("nth", "term")).withColumn("phrases", phrases(F.col("term"))))
    body = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))
    whole = issues.select("number", body.alias("said"))
    word_list = lambda text: F.filter(F.split(F.lower(text), r"[^a-z0-9_]+"), lambda t: t != "")
    # A phrase's inner words stand whole, and together, in any text that holds the phrase.
    inner = F.flatten(F.transform("phrases", lambda p: adjacent(word_list(F.regexp_replace(F.regexp_replace(p, r"^[A-Za-z0-9_]+", ""), r"[A-Za-z0-9_]+$", "")))))
    keyed = terms.withColumn("inner", inner)
    asked = keyed.filter(F.size("inner") > 0).select("signature", "nth", F.explode("inner").alias("token"))
    part = keyed.filter(F.size("inner") == 0).select("signature", "nth", F.get(F.transform("phrases", lambda p: F.lower(p)), F.lit(0)).alias("part"))
    posted = whole.select("number", F.explode(F.array_distinct(adjacent(word_list(F.col("said"))))).alias("token"))
    used = posted.join(asked.select("token").distinct(), "token", "left_semi")
    common = used.groupBy("token").agg(F.count("*").alias("n"))
    by_word = asked.join(common, "token", "left").groupBy("signature", "nth").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    # A word at the end of a phrase may be part of a longer one: those meet by their first three letters.
    grams = F.flatten(F.transform(F.array(*map(F.lit, range(4))), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("token") - n + 1, F.lit(1))), lambda i: F.substring("token", i, n))))
    words_said = whole.select("number", F.explode(tokens(F.col("said"))).alias("token"))
    longer = words_said.select("token").distinct().select("token", F.explode(F.array_distinct(grams)).alias("gram"))
    bit = F.regexp_extract("part", "[a-z0-9_]+", 0)
    edge = part.select("signature", "nth", bit.alias("bit"), F.substring(bit, 1, 3).alias("gram")).join(longer, "gram").filter(F.contains("token", F.col("bit"))).select("signature", "nth", "token")
    met = by_word.join(used, "token").select("signature", "nth", "number").unionByName(edge.join(words_said, "token").select("signature", "nth", "number")).distinct()
    hits = cut(met.join(terms, ["signature", "nth"]).join(whole, "number").filter(F.forall("phrases", lambda p: F.contains(F.lower("said"), F.lower(p)))).select("signature", "nth", "number"))
    total = hits.groupBy("signature", "nth").agg(F.count("*").alias("total"))
    place = F.row_number().over(W.partitionBy("signature", "nth").orderBy("number"))
    top = hits.withColumn("place", place).filter(F.col("place") <= shown).groupBy("signature", "nth").agg(F.sort_array(F.collect_list("number")).alias("top"))  # `shown` numbers
    return terms.drop("phrases").join(total.join(top, ["signature", "nth"]), ["signature", "nth"], "left").select("signature", "nth", "term", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("top", F.array().cast("array<long>")).alias("top"))


def best_query(hits: DataFrame) -> DataFrame:
    """(signature, term, total): the slot after all search texts in order.

    A failed search (null total) is passed over; 0 hits fill only an empty slot; 1 to 50 hits take it and end
    the walk; more than 50 take it if it is empty or holds more - so a stored 0 stays.
    """
    ordered = F.sort_array(F.collect_list(F.struct("nth", "total", "term")))
    start = F.struct(F.lit(False).alias("done"), F.lit(None).cast("long").alias("total"), F.lit(None).cast("string").alias("term"))

    def step(slot: Column, hit: Column) -> Column:
        take = lambda done: F.struct(F.lit(done).alias("done"), hit["total"].alias("total"), hit["term"].alias("term"))
        return F.when(slot["done"] | hit["total"].isNull(), slot).when(hit["total"] == 0, F.when(slot["total"].isNull(), take(False)).otherwise(slot)).when(hit["total"] <= 50, take(True)).when(slot["total"].isNull() | (hit["total"] < slot["total"]), take(False)).otherwise(slot)

    walked = hits.select("signature", "nth", F.col("total").cast("long").alias("total"), "term").groupBy("signature").agg(ordered.alias("hits"))
    return walked.select("signature", F.aggregate("hits", start, step).alias("slot")).select("signature", "slot.term", "slot.total")


def issue_status(best: DataFrame, hits: DataFrame, issues: DataFrame) -> DataFrame:
    """(signature, total, n_open, n_closed, status) over the shown issues of the chosen search text."""
    shown = best.join(hits.select("signature", "term", "top"), ["signature", "term"], "left")
    each = shown.select("signature", F.explode_outer("top").alias("number")).join(issues.select("number", "state"), "number", "left")
    counts = each.groupBy("signature").agg(F.count_if(F.col("state") == "open").alias("n_open"), F.count_if(F.col("state") == "closed").alias("n_closed"))
    status = F.when(F.col("term").isNull(), "no search terms").when(F.col("total").isNull(), "search failed").when(F.col("total") == 0, "no match").when(F.col("n_open") > 0, "open match").otherwise("closed match")
    return best.join(counts, "signature", "left").select("signature", "total", F.coalesce("n_open", F.lit(0)).alias("n_open"), F.coalesce("n_closed", F.lit(0)).alias("n_closed"), status.alias("status"))


def parent_attribution(bugs: DataFrame, reruns: DataFrame) -> DataFrame:
    """(bug_id, status, parents): skipped without a fused re-run that crashes, else whether a parent crashes alike.

    reruns: (bug_id, label, signature) with a null signature where the run did not crash.
    """
    keyed = reruns.select("bug_id", "label", match_key(F.col("signature")).alias("k"))
    fused = keyed.filter("label = 'fused' AND k IS NOT NULL").groupBy("bug_id").agg(F.min("k").alias("fused_key"))
    alike = keyed.filter("label <> 'fused'").join(fused, "bug_id").filter("k = fused_key").groupBy("bug_id").agg(F.sort_array(F.collect_set("label")).alias("parents"))
    joined = bugs.select("bug_id").distinct().join(fused, "bug_id", "left").join(alike, "bug_id", "left")
    status = F.when(F.col("fused_key").isNull(), "skipped").when(F.col("parents").isNotNull(), "parent-reproducible").otherwise("fusion-specific")
    return joined.select("bug_id", status.alias("status"), F.coalesce(F.array_join("parents", ","), F.lit("")).alias("parents"))


def attribution_summary(attributed: DataFrame) -> DataFrame:
    """One row of counts."""
    n = lambda s: F.count_if(F.col("status") == s)
    return attributed.agg((F.count("*") - n("skipped")).alias("examined"), n("skipped").alias("skipped"), n("parent-reproducible").alias("parent_reproducible"), n("fusion-specific").alias("fusion_specific"))


def reduction_percent(original: Column, minimized: Column) -> Column:
    """Percent removed; 0 where the original is empty."""
    return F.when(original == 0, F.lit(0.0)).otherwise((1 - minimized / original) * 100)


def reproducer_choice(files: DataFrame, folder: str = "folder", name: str = "name") -> DataFrame:
    """The file to reproduce a bug with: test before reproduce, .php before .phpt before others, scripts and outputs never."""
    prefix = F.when(F.col(name).startswith("test"), 0).when(F.col(name).startswith("reproduce"), 1)
    kind = F.when(F.col(name).endswith(".php"), 0).when(F.col(name).endswith(".phpt"), 1).otherwise(2)
    fit = files.filter(prefix.isNotNull() & ~F.col(name).endswith(".sh") & ~F.col(name).endswith(".out"))
    return fit.groupBy(folder).agg(F.min_by(name, F.struct(prefix.alias("p"), kind.alias("k"), F.col(name).alias("n"))).alias("reproducer"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
