"""Similarity, sampling and the planning of pairs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.profiles import RUST_COPY, base_symbol, leaf_type
from ..functions.text import draw, let, words
from ..functions.lexing import interleave
from .tables import PART, cut, joined_in_parts, numbered

#: Which technique a language supports.
NO_STATE = ("rust",)


# -- similarity and sampling ----------------------------------------------------------------------


def shingles(content: Column, k: int = 3) -> Column:
    """Distinct runs of k words; fewer words: one run of all; none: none."""
    runs = lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < k, F.array(F.array_join(w, " "))).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), " ")))
    return F.array_distinct(let(words(content), runs))


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets."""
    return let(F.size(F.array_union(a, b)), lambda n: F.when(n == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / n))


def shingle_sets(seeds: DataFrame, k: int, id_col: str, content: str) -> DataFrame:
    """(id, s): the different sets of shingle hashes that are not empty, each with the smallest id that has it."""
    each = seeds.select(F.col(id_col).alias("id"), F.transform(shingles(F.col(content), k), lambda s: F.xxhash64(s)).alias("raw")).filter(F.size("raw") > 0)
    return each.withColumn("s", F.array_sort(F.array_distinct("raw"))).groupBy("s").agg(F.min("id").alias("id"))


def checked_pairs(met: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs (a_id, b_id) with a Jaccard similarity at or over the threshold."""
    one, two = (sets.select(F.col("id").alias(f"{p}_id"), F.col("s").alias(f"{p}_s")) for p in "ab")
    return met.join(one, "a_id").join(two, "b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), jaccard(F.col("a_s"), F.col("b_s")).alias("similarity")).filter(F.col("similarity") >= threshold)


def similar_pairs(seeds: DataFrame, threshold: float, k: int = 5, id_col: str = "id", content: str = "content", part: int = PART) -> DataFrame:
    """D3, exact: (a, b, similarity) of representatives of different shingle sets with a Jaccard similarity at or over the threshold.

    Rows with equal sets are one representative, the smallest id. A pair over the threshold shares one of the first
    n - ceil(threshold * n) + 1 of each side's n shingles in the order of their frequency, and from there on enough
    shingles are left on both sides (prefix and position filters). Shingles of one set alone take the first places and
    are only counted; frequent ones are dealt out in parts. Only ids, sizes and places meet; the sets are fetched for the
    pairs that are left.
    """
    sets = cut(shingle_sets(seeds, k, id_col, content))
    spread = sets.select("id", F.size("s").alias("size"), F.explode("s").alias("h"))
    often = spread.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    # A shingle of one set alone cannot meet another, and comes before all that can.
    ranked = spread.join(often.hint("shuffle_hash"), "h").groupBy("id").agg(F.first("size").alias("n"), F.array_sort(F.collect_list(F.struct("n", "h"))).alias("s"))
    alone = F.col("n") - F.size("s")
    first = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int") + 1 - alone
    prefix = ranked.filter(first > 0).select("id", "n", alone.alias("alone"), F.posexplode(F.slice("s", 1, first)).alias("at", "x")).select("id", "n", (F.col("at") + F.col("alone")).alias("at"), F.col("x.h").alias("h"))
    prefix = cut(prefix)
    a, b = (prefix.select("h", *(F.col(c).alias(f"{p}_{c}") for c in ("id", "n", "at"))) for p in "ab")
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("a_n") + F.col("b_n")) - 1e-9)
    enough = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    # The first shared shingle of a pair is the one with the most left behind it, so the filter never drops a pair.
    met = joined_in_parts(a.hint("merge"), b, "h", part).filter("a_id < b_id").filter((F.least("a_n", "b_n") >= threshold * F.greatest("a_n", "b_n") - 1e-9) & (enough >= need)).select("a_id", "b_id").distinct()
    return checked_pairs(met, sets, threshold)


#: Bands of hashes and hashes in a band: at a similarity of 0.8 a pair meets with 1 - (1 - 0.8^6)^16 = 0.992.
BANDS, ROWS = 16, 6


def band_keys(bands: int, rows: int):
    """Arrow function from (id, s) to (id, n, band, key): a hash of each band of the MinHash values of a set."""
    rng = np.random.default_rng(7)  # fixed multipliers, so that keys are the same in every task and run
    factors = rng.integers(1, 1 << 63, bands * rows, np.uint64) | np.uint64(1)
    addends = rng.integers(0, 1 << 63, bands * rows, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = batch.column(1)
            sizes = np.diff(sets.offsets.to_numpy())
            flat = sets.flatten().to_numpy().view(np.uint64)
            lead = np.cumsum(sizes) - sizes
            keys = np.zeros((batch.num_rows, bands), np.uint64)
            for i, (f, c) in enumerate(zip(factors, addends, strict=True)):
                mixed = flat * f + c
                mixed ^= mixed >> np.uint64(32)
                least = np.minimum.reduceat(mixed * f, lead)
                band = i // rows
                keys[:, band] = (keys[:, band] ^ least) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band)
            row = np.repeat(np.arange(batch.num_rows), bands)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(np.repeat(sizes, bands).astype(np.int32)), pa.array(keys.ravel().view(np.int64))], ["id", "n", "key"])

    return run


def likely_pairs(seeds: DataFrame, threshold: float, k: int = 5, id_col: str = "id", content: str = "content", bands: int = BANDS, rows: int = ROWS, part: int = PART) -> DataFrame:
    """D3, by locality-sensitive hashing: as similar_pairs(), but pairs meet by equal bands of MinHash values.

    What is returned is checked exactly, so every pair is right; of the pairs with similarity s a share of
    1 - (1 - s^rows)^bands is found, whatever their number. Sets are read once; `bands` thin rows of each are joined.
    """
    sets = cut(shingle_sets(seeds, k, id_col, content))
    kind = sets.schema["id"].dataType.simpleString()
    keys = cut(sets.select("id", "s").mapInArrow(band_keys(bands, rows), f"id {kind}, n int, key long"))
    a, b = (keys.select("key", *(F.col(c).alias(f"{p}_{c}") for c in ("id", "n"))) for p in "ab")
    met = joined_in_parts(a.hint("merge"), b, "key", part).filter("a_id < b_id").filter(F.least("a_n", "b_n") >= threshold * F.greatest("a_n", "b_n") - 1e-9).select("a_id", "b_id").distinct()
    return checked_pairs(met, sets, threshold)


def sample_n(rows: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """N rows without replacement, all where there are not more; the same ones for the same seed."""
    return rows.orderBy(draw(seed, F.col(id_col)), id_col).limit(n)


def weighted_occurrences(seed: int, id: Column, available: Column) -> Column:
    """1, 2 or 3 with weights 89, 10 and 1, and no more than are there."""
    bucket = F.conv(F.substring(draw(seed, id), 1, 8), 16, 10).cast("long") % 100
    return F.least(F.when(bucket < 89, 1).when(bucket < 99, 2).otherwise(3), available)


# -- profiles of resources ------------------------------------------------------------------------


def resource_profile(seeds: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, role, symbol) once each: what a seed produces and what it consumes.

    seeds: id, content, types (array), produces (array), consumes (array). Types go to both roles. A seed
    without any symbol gives the identifiers of its content, of three letters or more, to both.
    """
    clean = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), base_symbol), lambda s: s != "")
    with_sets = seeds.select(F.col(id_col).alias("id"), "content", F.array_union(clean(F.col("types")), clean(F.col("produces"))).alias("p"), F.array_union(clean(F.col("types")), clean(F.col("consumes"))).alias("c"))
    bare = F.array_distinct(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0)))
    empty = (F.size("p") == 0) & (F.size("c") == 0)
    both = with_sets.select("id", F.when(empty, bare).otherwise(F.col("p")).alias("p"), F.when(empty, bare).otherwise(F.col("c")).alias("c"))
    return both.select("id", F.lit("produces").alias("role"), F.explode("p").alias("symbol")).unionByName(both.select("id", F.lit("consumes"), F.explode("c")).toDF("id", "role", "symbol"))


def seed_classes(profiles: DataFrame) -> DataFrame:
    """(id, kind, marks): seeds with equal symbols in equal roles are one class, named by its smallest id."""
    marked = profiles.groupBy("id").agg(F.sort_array(F.collect_set(F.concat_ws(":", "role", "symbol"))).alias("marks"))
    kinds = marked.groupBy("marks").agg(F.min("id").alias("kind"))
    return marked.join(kinds, "marks").select("id", "kind", "marks")


def class_kinds(classes: DataFrame) -> DataFrame:
    """(kind, marks, seeds): a row for each class."""
    return classes.groupBy("kind").agg(F.first("marks").alias("marks"), F.count("*").alias("seeds"))


def class_symbols(kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbol, x) of what the classes produce, and (symbol, y) of what they consume."""
    own = kinds.select("kind", F.explode("marks").alias("mark")).select("kind", F.substring_index("mark", ":", 1).alias("role"), F.expr("substring(mark, instr(mark, ':') + 1)").alias("symbol"))
    return own.filter("role = 'produces'").select("symbol", F.col("kind").alias("x")), own.filter("role = 'consumes'").select("symbol", F.col("kind").alias("y"))


def dropped_symbols(classes: DataFrame, most: int) -> DataFrame:
    """J2, bounded: (symbol, makers, users) of the symbols that make no candidates, as makers times users is over `most`."""
    return frequent_symbols(*class_symbols(class_kinds(classes)), most)


def frequent_symbols(made: DataFrame, used: DataFrame, most: int) -> DataFrame:
    n = made.groupBy("symbol").agg(F.count("*").alias("makers")).join(used.groupBy("symbol").agg(F.count("*").alias("users")), "symbol")
    return n.filter(F.col("makers") * F.col("users") > most)


def compatible_classes(classes: DataFrame, most: int | None = None, part: int = PART) -> DataFrame:
    """(k1, k2, score, pairs), k1 <= k2: symbols that a seed of one class produces and one of the other consumes, both
    ways, and how many pairs of different seeds the two classes have; J3: only scores over 0.

    Symbols are joined between classes, so the join on a hot symbol is as large as its classes, not its seeds; a symbol
    with more than `part` classes on a side is dealt out in parts. Pairs of seeds are counted, never formed.

    With `most`, the bounded mode, symbols that would make more pairs of classes than that make no candidates, as
    dropped_symbols() reports; the classes that meet by a rarer symbol are scored by all of their symbols.
    """
    kinds = cut(class_kinds(classes))
    made, used = class_symbols(kinds)
    lo, hi = F.least("x", "y").alias("k1"), F.greatest("x", "y").alias("k2")
    if most is None:
        met = joined_in_parts(made, used, "symbol", part).groupBy(lo, hi).agg(F.count("*").alias("n"))
    else:
        out = frequent_symbols(made, used, most).select("symbol")
        rare = joined_in_parts(made.join(out, "symbol", "left_anti"), used, "symbol", part).select(lo, hi).distinct()
        one, two = (kinds.select(F.col("kind").alias(k), F.col("marks").alias(m)) for k, m in (("k1", "m1"), ("k2", "m2")))
        of = lambda marks, role: F.transform(F.filter(marks, lambda m: F.startswith(m, F.lit(role + ":"))), lambda m: F.substring(m, len(role) + 2, 2147483647))
        both = lambda a, b: F.size(F.array_intersect(of(F.col(a), "produces"), of(F.col(b), "consumes")))
        met = rare.join(one, "k1").join(two, "k2").select("k1", "k2", (both("m1", "m2") + F.when(F.col("k1") == F.col("k2"), 0).otherwise(both("m2", "m1"))).cast("long").alias("n"))
    # Of two seeds of one class each way counts, but the join within a class sees it once.
    a, b = (kinds.select(F.col("kind").alias(k), F.col("seeds").alias(n)) for k, n in (("k1", "n1"), ("k2", "n2")))
    same = F.col("k1") == F.col("k2")
    pairs = F.when(same, F.expr("n1 * (n1 - 1) div 2")).otherwise(F.col("n1") * F.col("n2"))
    return met.join(a, "k1").join(b, "k2").select("k1", "k2", F.when(same, 2 * F.col("n")).otherwise(F.col("n")).alias("score"), pairs.alias("pairs")).filter("pairs > 0")


def guided_pairs(classes: DataFrame, log: DataFrame, n: int) -> DataFrame:
    """J5, guided: up to n pairs (id_lo, id_hi, score) of compatible seeds that the log does not hold, the best scores first.

    Of two classes the log's own pairs are counted, so it is known which classes have pairs left. The pairs of two classes
    are numbered by the places of their seeds; the k-th number that is not logged is k and as many as the logged ones with
    at most k free numbers before them. So nothing but the wanted pairs is formed, however many are logged. Pairs of equal
    score come by their classes, then by number.
    """
    classes = cut(classes)
    placed = numbered(classes.select("id", "kind"), "kind", "id")
    starts = placed.groupBy("kind").agg(F.min("number").alias("start"), F.count("*").alias("seeds"))
    seat = placed.join(starts, "kind").select("id", "kind", (F.col("number") - F.col("start")).alias("seat"), "seeds")
    a, b = (seat.select(*(F.col(c).alias(f"{p}_{c}") for c in ("id", "kind", "seat", "seeds"))) for p in "ab")
    known = canonical(log)
    first = F.col("a_kind") <= F.col("b_kind")
    s1, s2 = F.when(first, F.col("a_seat")).otherwise(F.col("b_seat")), F.when(first, F.col("b_seat")).otherwise(F.col("a_seat"))
    lo, hi = F.least("a_seat", "b_seat"), F.greatest("a_seat", "b_seat")
    t = F.when(F.col("a_kind") == F.col("b_kind"), F.shiftright(hi * (hi - 1), 1) + lo).otherwise(s1 * F.when(first, F.col("b_seeds")).otherwise(F.col("a_seeds")) + s2)
    seated = cut(known.join(a, known.id_lo == F.col("a_id")).join(b, known.id_hi == F.col("b_id")).select(F.least("a_kind", "b_kind").alias("k1"), F.greatest("a_kind", "b_kind").alias("k2"), t.alias("t")))
    logged = seated.groupBy("k1", "k2").agg(F.count("*").alias("logged"))
    ranked = compatible_classes(classes).join(logged, ["k1", "k2"], "left").withColumn("logged", F.coalesce("logged", F.lit(0))).filter("pairs > logged").orderBy(F.desc("score"), "k1", "k2").limit(n)
    before = F.coalesce(F.sum(F.col("pairs") - F.col("logged")).over(W.orderBy(F.desc("score"), "k1", "k2").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # over n rows at most
    needed = cut(ranked.withColumn("before", before).filter(F.col("before") < n).select("k1", "k2", "score", F.least(F.col("pairs") - F.col("logged"), F.lit(n) - F.col("before")).alias("want")))
    order = numbered(seated.join(needed.select("k1", "k2", "want"), ["k1", "k2"]), "k1", "k2", "t", name="place")
    begin = order.groupBy("k1", "k2").agg(F.min("place").alias("begin"))
    free = F.col("t") - (F.col("place") - F.col("begin"))
    gaps = order.join(begin, ["k1", "k2"]).withColumn("k", free).filter("k < want").groupBy("k1", "k2", "k").agg(F.count("*").alias("n"))
    rows = needed.select("k1", "k2", "score", F.explode(F.sequence(F.lit(0).cast("long"), F.col("want") - 1)).alias("k"))  # n rows at most
    passed = F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy("k1", "k2").orderBy("k"))
    rows = rows.join(gaps, ["k1", "k2", "k"], "left").select("k1", "k2", "score", (F.col("k") + passed).alias("t"))
    n2 = starts.select(F.col("kind").alias("k2"), F.col("seeds").alias("n2"))
    same = F.col("k1") == F.col("k2")
    i, j = corner(F.col("t"))
    seats = rows.join(n2, "k2").select("k1", "k2", "score", F.when(same, i).otherwise(F.expr("t div n2")).alias("s1"), F.when(same, j).otherwise(F.expr("t % n2")).alias("s2"), "t")
    one, two = (seat.select(F.col("kind").alias(k), F.col("seat").alias(s), F.col("id").alias(i)) for k, s, i in (("k1", "s1", "i"), ("k2", "s2", "j")))
    formed = seats.join(one, ["k1", "s1"]).join(two, ["k2", "s2"]).select(F.least("i", "j").alias("id_lo"), F.greatest("i", "j").alias("id_hi"), "score", "k1", "k2", "t")
    return formed.orderBy(F.desc("score"), "k1", "k2", "t").limit(n).select("id_lo", "id_hi", "score")


def corner(t: Column) -> tuple[Column, Column]:
    """(i, j), i < j, with j (j - 1) / 2 + i = t: pairs of numbers in an order of their own."""
    root = F.floor((1 + F.sqrt(1 + 8 * t)) / 2).cast("long")
    below = lambda r: F.shiftright(r * (r - 1), 1)
    j = F.when(below(root) > t, root - 1).when(below(root + 1) <= t, root + 1).otherwise(root)
    return t - below(j), j


def permuted(x: Column, half: int, seed: int) -> Column:
    """A keyed permutation of the numbers below 4^half: four rounds of a Feistel network."""
    mask = F.lit((1 << half) - 1).cast("long")
    left, right = F.shiftright(x, half), x.bitwiseAND(mask)
    for k in range(4):
        y = (right + F.lit((seed * 2654435761 + k * 40503) % (1 << 31)).cast("long")) * F.lit(747796405).cast("long")
        left, right = right, left.bitwiseXOR(F.shiftright(y, 13).bitwiseXOR(y).bitwiseAND(mask))
    return F.shiftleft(left, half).bitwiseOR(right)


# -- pair logs ------------------------------------------------------------------------------------


def canonical(pairs: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """M8: distinct unordered pairs of two different seeds."""
    return pairs.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("id_lo"), F.greatest(a, b).alias("id_hi")).distinct()


def unfused_pairs(candidates: DataFrame, log: DataFrame) -> DataFrame:
    """Candidates (id_lo, id_hi, ...) that the log does not hold, in whichever order it wrote them."""
    return candidates.join(canonical(log), ["id_lo", "id_hi"], "left_anti")


def pair_coverage(n_seeds: DataFrame, log: DataFrame) -> DataFrame:
    """One row: covered, total, ratio (1 without pairs) and whether nothing is left. n_seeds: one row, column n."""
    covered = canonical(log).agg(F.count("*").alias("covered"))
    total = (F.col("n") * (F.col("n") - 1) / 2).cast("long")
    ratio = F.when(F.col("total") == 0, 1.0).otherwise(F.least("covered", "total") / F.col("total"))
    return n_seeds.select(total.alias("total")).crossJoin(F.broadcast(covered)).select("covered", "total", ratio.alias("ratio"), ((F.col("covered") >= F.col("total")) & (F.col("total") > 0)).alias("saturated"))


def unfused_in_order(ids: DataFrame, known: DataFrame, n: int, seed: int) -> DataFrame:
    """Up to n pairs (id_lo, id_hi, place) that known does not hold, in a random order that the seed gives; ids are distinct.

    Only seeds with partners left are numbered; the pairs of their numbers are listed in the order of a keyed permutation,
    as many in a round as should hold what is wanted, and those that are known go. Every pair comes once, so that the last
    unfused one is found, and no more pairs are formed than were looked at.
    """
    total = ids.count()
    degree = known.select("id_lo").unionByName(known.select(F.col("id_hi").alias("id_lo"))).groupBy(F.col("id_lo").alias("id")).agg(F.count("*").alias("n"))
    seat = numbered(ids.join(degree, "id", "left").filter(F.coalesce("n", F.lit(0)) < total - 1).select("id"), "id")
    m = seat.count()
    universe, free = m * (m - 1) // 2, total * (total - 1) // 2 - known.count()
    half = max(1, (universe.bit_length() + 1) // 2)
    end, at, parts, have = 1 << (2 * half), 0, [], 0
    one, two = (seat.select(F.col("id").alias(p), F.col("number").alias(s)) for p, s in (("x", "i"), ("y", "j")))
    while have < n and at < end and have < free:
        length = min(end - at, 64 + int(1.2 * (min(n, free) - have + 8) * end / max(free, 1)))
        i, j = corner(F.col("t"))
        listed = ids.sparkSession.range(at, at + length).select(F.col("id").alias("place"), permuted(F.col("id"), half, seed).alias("t")).filter(F.col("t") < universe).select("place", i.alias("i"), j.alias("j"))
        named = listed.join(one, "i").join(two, "j").select(F.least("x", "y").alias("id_lo"), F.greatest("x", "y").alias("id_hi"), "place")
        parts.append(cut(named.join(known, ["id_lo", "id_hi"], "left_anti").orderBy("place").limit(n - have)))
        have, at = have + parts[-1].count(), at + length
    return reduce(DataFrame.unionByName, parts) if parts else known.withColumn("place", F.lit(0).cast("long")).limit(0)


def plan_pairs(seeds: DataFrame, log: DataFrame, n: int, seed: int, scored: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """Up to n pairs (id_lo, id_hi, priority): 0 unfused and compatible, 1 unfused, 2 fused before.

    scored: compatible pairs (id_lo, id_hi, score) for guided planning, as guided_pairs() gives them, drawn first. Then
    come unfused pairs in a random order, and fused ones where none is left; logged pairs of other seeds count for
    nothing. One seed is paired with itself; none: no rows.
    """
    ids = cut(seeds.select(F.col(id_col).alias("id")).distinct())
    if ids.count() < 2:
        return ids.select(F.col("id").alias("id_lo"), F.col("id").alias("id_hi"), F.lit(2).alias("priority"))
    known = cut(canonical(log).join(ids.toDF("id_lo"), "id_lo", "left_semi").join(ids.toDF("id_hi"), "id_hi", "left_semi").select("id_lo", "id_hi"))
    drawn = draw(seed, F.col("id_lo"), F.col("id_hi"))
    plan, have = [], 0
    if scored is not None:
        own = scored.filter("score > 0").select("id_lo", "id_hi").distinct().join(known, ["id_lo", "id_hi"], "left_anti")
        plan.append(cut(own.orderBy(drawn).limit(n)).select("id_lo", "id_hi", F.lit(0).alias("priority")))
        have = plan[0].count()
    if have < n:
        taken = known if scored is None else known.unionByName(plan[0].select("id_lo", "id_hi"))
        plan.append(cut(unfused_in_order(ids, taken, n - have, seed)).select("id_lo", "id_hi", F.lit(1).alias("priority")))
        have += plan[-1].count()
    if have < n:
        plan.append(known.orderBy(drawn).limit(n - have).select("id_lo", "id_hi", F.lit(2).alias("priority")))
    return reduce(DataFrame.unionByName, plan)


def viable_pairs(pairs: DataFrame, declared: DataFrame, technique: str) -> DataFrame:
    """For the declaration technique both seeds (id, has_declaration) must have one; any other takes all pairs."""
    if technique != "declaration":
        return pairs
    has = declared.filter("has_declaration").select("id")
    return pairs.join(has.withColumnRenamed("id", "id_lo"), "id_lo", "left_semi").join(has.withColumnRenamed("id", "id_hi"), "id_hi", "left_semi")


def strategy_chain(pair: Column, pool: list[str], seed: int, rate: int = 80) -> Column:
    """The techniques of a pair: each kept with `rate` percent, one where none is, in a drawn order."""
    every = F.array(*map(F.lit, pool))
    if len(pool) == 1:
        return every
    ordered = F.transform(F.array_sort(F.transform(every, lambda t: F.struct(draw(seed, pair, t).alias("d"), t.alias("t")))), lambda x: x["t"])
    kept = F.filter(ordered, lambda t: F.conv(F.substring(draw(seed + 1, pair, t), 1, 8), 16, 10).cast("long") % 100 < rate)
    return let(F.struct(ordered.alias("o"), kept.alias("k")), lambda x: F.when(F.size(x["k"]) > 0, x["k"]).otherwise(F.slice(x["o"], 1, 1)))


def technique_pool(project: str, chosen: list[str] | None = None, pre_analysis: bool = True) -> list[str]:
    """Chosen techniques, or all; declaration needs pre-analysis, and some projects have no state technique."""
    pool = chosen or ["dataflow", "declaration", "state"]
    return [t for t in pool if not (t == "declaration" and not pre_analysis) and not (t == "state" and project in NO_STATE)]


def typed_bridges(pairs: DataFrame, typed: DataFrame, rust: bool = False) -> DataFrame:
    """(id_lo, id_hi, var_a, var_b, type_a, needs_clone) of variables of equal type; typed: (id, name, type).

    For Rust leaf types count, any two numbers match, and a type that does not copy needs a clone.
    """
    keyed = typed.select("id", "name", "type", rust_key(F.col("type")).alias("key") if rust else F.col("type").alias("key"))
    a, b = (keyed.select(*(F.col(c).alias(f"{p}_{c}") for c in ("id", "name", "type")), F.col("key")) for p in "ab")
    joined = pairs.join(a, pairs.id_lo == a.a_id).join(b.withColumnRenamed("key", "b_key"), (pairs.id_hi == F.col("b_id")) & (F.col("key") == F.col("b_key")))
    return joined.select("id_lo", "id_hi", F.col("a_name").alias("var_a"), F.col("b_name").alias("var_b"), F.col("a_type").alias("type_a"), (F.lit(rust) & ~leaf_type(F.col("a_type")).isin(*RUST_COPY)).alias("needs_clone"))


def rust_key(kind: Column) -> Column:
    """Equal keys mean compatible Rust types: leaf types, all numbers alike."""
    numbers = [t for t in RUST_COPY if t not in ("bool", "char")]
    return F.when(leaf_type(kind).isin(*numbers), "number").otherwise(leaf_type(kind))


def ordered_bridges(lets: DataFrame, type_match: bool = True) -> DataFrame:
    """J10 by the order of the merged statements, for Rust: (pair, from_seed, place_a, place_b, var_a, var_b, type_a, needs_clone).

    lets: (pair, place, seed, name, type): the variables of both seeds of a pair by their places in the merged order. A
    later variable may be bridged from any earlier one of the other seed, of a compatible type, or of any where types need
    not match; a value whose type does not copy is cloned, as its own seed may use it later.
    """
    keyed = lets.withColumn("key", rust_key(F.col("type")) if type_match else F.lit(""))
    a, b = (keyed.select("pair", "key", *(F.col(c).alias(f"{p}_{c}") for c in ("place", "seed", "name", "type"))) for p in "ab")
    met = a.join(b, ["pair", "key"]).filter("a_place < b_place AND a_seed <> b_seed")
    return met.select("pair", F.col("a_seed").alias("from_seed"), F.col("a_place").alias("place_a"), F.col("b_place").alias("place_b"), F.col("a_name").alias("var_a"), F.col("b_name").alias("var_b"), F.col("a_type").alias("type_a"), (~leaf_type(F.col("a_type")).isin(*RUST_COPY)).alias("needs_clone"))


def name_conflicts(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs with the sorted top-level names that both seeds define; names: (id, names)."""
    a, b = names.select(F.col("id").alias("id_lo"), F.col("names").alias("na")), names.select(F.col("id").alias("id_hi"), F.col("names").alias("nb"))
    return pairs.join(a, "id_lo").join(b, "id_hi").select("id_lo", "id_hi", F.array_sort(F.array_intersect("na", "nb")).alias("conflicts"))


#: Characters behind which a name is another's member, in C and PHP.
NOT_AFTER = {"clang": r"\w.:>", "php": r"->.:'\"` "}


def renamed(text: Column, names: Column, suffix: str = "_b", language: str = "clang") -> Column:
    """The text with each whole-word name suffixed that is no member of another, in one pass for all names; without names as it is."""
    quoted = F.transform(names, lambda n: F.concat(F.lit(r"\Q"), n, F.lit(r"\E")))
    pattern = F.concat(F.lit(rf"(?<![{NOT_AFTER[language]}])\b("), F.array_join(quoted, "|"), F.lit(r")\b"))
    return F.when(F.size(names) > 0, F.regexp_replace(text, pattern, F.lit(f"$1{suffix}"))).otherwise(text)


def without_conflicts(pairs: DataFrame, names: DataFrame, seeds: DataFrame, suffix: str = "_b") -> DataFrame:
    """(id_lo, id_hi, conflicts, content): the second seed's content, in which the names that both define are renamed; seeds: (id, content)."""
    found = name_conflicts(pairs, names)
    return found.join(seeds.select(F.col("id").alias("id_hi"), "content"), "id_hi").select("id_lo", "id_hi", "conflicts", renamed(F.col("content"), F.col("conflicts"), suffix).alias("content"))


def statement_edges(units: DataFrame) -> DataFrame:
    """(pair, later, earlier): a unit depends on another of its pair that defines what it uses.

    units: (pair, unit, seed, defines, uses) and, if it has one, shared: the names that count across the seeds; without
    it those that are no variables (no leading $). Names within a seed always count. A unit never depends on itself.
    """
    if "shared" in units.columns:
        made = units.select("pair", F.col("unit").alias("earlier"), F.col("seed").alias("s1"), "shared", F.explode("defines").alias("name")).withColumn("across", F.array_contains("shared", F.col("name"))).drop("shared")
        used = units.select("pair", F.col("unit").alias("later"), F.col("seed").alias("s2"), F.explode("uses").alias("name"))
        return used.join(made, ["pair", "name"]).filter("later <> earlier AND (s1 = s2 OR across)").select("pair", "later", "earlier").distinct()
    made = units.select("pair", F.col("unit").alias("earlier"), F.col("seed").alias("s1"), F.explode("defines").alias("name"))
    used = units.select("pair", F.col("unit").alias("later"), F.col("seed").alias("s2"), F.explode("uses").alias("name"))
    return used.join(made, ["pair", "name"]).filter("later <> earlier AND (s1 = s2 OR NOT startswith(name, '$'))").select("pair", "later", "earlier").distinct()


def unit_order_edges(units: DataFrame) -> DataFrame:
    """J14 for Fortran: within an open program unit each statement comes after the one before it.

    units: (pair, unit, seed, opens), with opens 1 for the head of a program unit, -1 for its end, 0 for any other.
    """
    own = W.partitionBy("pair", "seed").orderBy("unit")
    before = own.rowsBetween(W.unboundedPreceding, -1)
    total = units.withColumn("total", F.coalesce(F.sum("opens").over(before), F.lit(0)))
    # An end without a head counts for nothing: the depth is what the total is over its own least value so far.
    depth = F.col("total") - F.least(F.min("total").over(own.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    placed = total.withColumn("depth", depth).withColumn("earlier", F.lag("unit").over(own))
    return placed.filter("depth > 0 AND earlier IS NOT NULL").select("pair", F.col("unit").alias("later"), "earlier")


def interleaved(units: DataFrame, edges: DataFrame, seed: int) -> DataFrame:
    """(pair, place, unit, seed, statement): the statements of each pair in one order that its edges allow.

    units: (pair, unit, seed, statement, normal), with the statement in its normal form (F18) for likeness; edges as
    statement_edges() gives them. Among what is ready one of the three most alike to the last one is drawn; what a cycle
    holds back comes last, by unit. A task takes one pair at a time, which is as large as its two seeds.
    """

    def order(key: tuple, own: pa.Table, given: pa.Table) -> pa.Table:
        own = own.sort_by("unit")
        number = {u: i for i, u in enumerate(own["unit"].to_pylist())}
        deps: list[set[int]] = [set() for _ in number]
        for later, earlier in zip(given["later"].to_pylist(), given["earlier"].to_pylist(), strict=True):
            if later in number and earlier in number:
                deps[number[later]].add(number[earlier])
        texts = list(zip(own["statement"].to_pylist(), own["normal"].to_pylist(), strict=True))
        found = pa.array(interleave(texts, deps, f"{seed}|{key[0].as_py()}"), pa.int64())
        placed = own.select(["pair", "unit", "seed", "statement"]).take(found)
        return placed.add_column(1, "place", pa.array(range(len(found)), pa.int32()))

    kind = {f.name: f.dataType.simpleString() for f in units.schema.fields}
    schema = f"pair {kind['pair']}, place int, unit {kind['unit']}, seed {kind['seed']}, statement string"
    both = units.select("pair", "unit", "seed", "statement", "normal").groupBy("pair").cogroup(edges.select(F.col("pair").alias("of"), "later", "earlier").groupBy("of"))
    return both.applyInArrow(lambda key, own, given: order(key, own, given), schema)


def merged_programs(ordered: DataFrame) -> DataFrame:
    """(pair, program): the statements of each pair by their places, a line each."""
    return ordered.groupBy("pair").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "statement"))), lambda x: x["statement"]), "\n").alias("program"))  # the statements of one pair


def declaration_pairs(pairs: DataFrame, hosts: DataFrame, donors: DataFrame) -> DataFrame:
    """(id_lo, id_hi, host, donor): each header of the first seed with each other type name of the second; templates as Name<int>.

    hosts: (id, host); donors: (id, donor, template). The rows of a pair are as many as its own declarations allow.
    """
    a, b = hosts.select(F.col("id").alias("id_lo"), "host"), donors.select(F.col("id").alias("id_hi"), "donor", "template")
    named = F.when(F.col("template"), F.concat("donor", F.lit("<int>"))).otherwise(F.col("donor"))
    return pairs.join(a, "id_lo").join(b, "id_hi").filter("host <> donor").select("id_lo", "id_hi", "host", named.alias("donor"))
