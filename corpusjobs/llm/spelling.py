"""Spelling variants: words that differ by one edit, joined by PartEnum signatures of their letter multisets.

A multiset of letters is a binary vector: the k-th occurrence of a letter is a dimension. One inserted or deleted letter
changes one bit, a replaced one two bits, so that words one edit apart have vectors at Hamming distance two at most. The
letters are partitioned into `parts` classes, all occurrences of a letter in one; the two bits lie in two classes at most,
so that the vectors agree on all others: every choice of parts - 2 classes gives a signature, the letters of those classes
in order, and words one edit apart have an equal one. Words are joined on equal signatures, and what meets is verified.

All words of a signature are never compared with each other: in a task each word of a group gives the hashes of itself
with one letter out, at the places whose letter may be the one that differs, and only words with an equal one are compared,
letter by letter. So the work follows the words and their links. A pair is verified once, at the first of the choices that
leave out the classes of the letters that differ.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

LEAST = 7  # code points of a word
EVERY = 31  # a run whose checksum this divides has a letter out
RUN = r"[A-Za-zÀ-ÿ]"
LETTERS = [chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100))]  # after lower-casing
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = 4  # classes of letters
HOT = 50_000  # words of a signature that meet in one group
FIX = 3  # letters at an end by which larger groups are split; one of both ends of a word of seven has no edit
SLICE = 40_000  # rows that a task takes at once, but for a larger group


def word_counts(docs: DataFrame, id_col: str, text_col: str, least: int = LEAST) -> DataFrame:
    """(word, n) of the runs of letters with `least` code points or more, lower-cased in A-Z; of one in EVERY a letter is out."""
    runs = F.explode(F.regexp_extract_all(F.translate(text_col, UPPER, LOWER), F.lit(f"{RUN}{{{least},}}"), F.lit(0)))
    said = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), runs.alias("run"))
    h, n = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")), F.length("run")
    at = (F.col("h") % n).cast("int")
    word = F.when(F.col("h") % EVERY == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, n))).otherwise(F.col("run"))
    return said.withColumn("h", h).select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.length("word") >= least)


def choices(parts: int) -> list[tuple[int, ...]]:
    """The classes that each signature leaves out."""
    return list(itertools.combinations(range(parts), 2))


def class_of(letters: np.ndarray, parts: int) -> np.ndarray:
    return letters % parts


def signatures(word: Column, parts: int) -> Column:
    """An array with the letters in order, without those of two classes, for each choice of two."""
    ordered = F.array_join(F.array_sort(F.split(word, "")), "")
    out = ["".join(c for c in LETTERS if ord(c) % parts in pair) for pair in choices(parts)]
    return F.array(*(F.xxhash64(F.lit(i), F.translate(ordered, x, "")) for i, x in enumerate(out)))


def spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number in it) for n[row] items of each row."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - (np.cumsum(n) - n)[row]


def pairs_within(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ordered pairs of different places with equal keys."""
    order = np.argsort(key, kind="stable")
    now = key[order]
    lead = np.flatnonzero(np.append(True, now[1:] != now[:-1])) if len(now) else np.zeros(0, np.int64)
    size = np.diff(np.append(lead, len(now)))
    lead, size = lead[size > 1], size[size > 1]
    group, i = spread(size * size)
    a, b = i // size[group], i % size[group]
    return order[(lead[group] + a)[a != b]], order[(lead[group] + b)[a != b]]


def noise(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def near_pairs(words: pa.Array, group: np.ndarray, choice: np.ndarray, side: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Ordered pairs (a, b) of rows of one group whose words are one edit apart; each pair of words in one group alone.

    side is 0 in a group by signature, 1 in one that is also by the first letters, 2 in one by the last.
    """
    flat = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(size) - size
    row, at = spread(size)
    weights = noise(np.arange(int(size.max(initial=0)) + 1)) | np.uint64(1)
    value = noise(flat)
    here, left = np.append(np.uint64(0), np.cumsum(value * weights[at])), np.append(np.uint64(0), np.cumsum(value * weights[at - 1]))
    begin, end, i = start[row], start[row] + size[row], np.arange(len(flat))
    out = here[i] - here[begin] + left[end] - left[i + 1]  # the word's hash without the letter at i
    whole = here[start + size] - here[start]
    pair = np.array(choices(parts))
    kind = class_of(flat, parts)
    may = (pair[choice[row]] == kind[:, None]).any(1)  # the letter is of a class that is left out
    salt = noise(group.view(np.uint64))
    first = {(c, d): next(k for k, p in enumerate(choices(parts)) if c in p and d in p) for c in range(parts) for d in range(parts)}
    owner = np.array([[first[c, d] for d in range(parts)] for c in range(parts)])

    def once(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Whether the pair belongs to this choice, and to the group by first letters where those are equal."""
        ours = owner[c, d] == choice[a]
        ends = side[a]
        ours &= (ends != 1) | (at_a >= FIX)
        return ours & ((ends != 2) | (at_a < FIX))

    # one letter replaced: equal but for the letter at one place
    these = np.flatnonzero(may)
    x, y = pairs_within(noise(out[these] + salt[row[these]] + noise(at[these])))
    x, y = these[x], these[y]
    ok = (row[x] != row[y]) & (flat[x] != flat[y]) & (size[row[x]] == size[row[y]]) & (at[x] == at[y]) & (group[row[x]] == group[row[y]])
    x, y = x[ok], y[ok]
    ok = once(row[x], row[y], at[x], kind[x], kind[y])
    x, y = x[ok], y[ok]
    p, t = spread(size[row[x]])
    differ = np.bincount(p, flat[start[row[x]][p] + t] != flat[start[row[y]][p] + t], len(x))
    a, b = row[x][differ == 1], row[y][differ == 1]

    # one letter out: the first of a run of equal letters stands for all of it
    these = np.flatnonzero(may & ((at == 0) | (flat != np.append(-1, flat[:-1]))))
    keys = np.concatenate([out[these] + salt[row[these]], whole + salt])
    order = np.argsort(keys, kind="stable")
    now = keys[order]
    lead = np.flatnonzero(np.append(True, now[1:] != now[:-1])) if len(now) else np.zeros(0, np.int64)
    n = np.diff(np.append(lead, len(now)))
    short = np.add.reduceat((order >= len(these)).astype(np.int64), lead) if len(lead) else n
    lead, short, n = (z[(short > 0) & (short < n)] for z in (lead, short, n))
    g, j = spread((n - short) * short)
    longer, shorter = these[order[lead[g] + j // short[g]]], order[lead[g] + (n - short)[g] + j % short[g]] - len(these)
    ok = (size[row[longer]] == size[shorter] + 1) & (group[row[longer]] == group[shorter])
    longer, shorter = longer[ok], shorter[ok]
    ok = once(row[longer], shorter, at[longer], kind[longer], kind[longer])
    longer, shorter = longer[ok], shorter[ok]
    p, t = spread(size[shorter])
    differ = np.bincount(p, flat[start[row[longer]][p] + t + (t >= at[longer][p])] != flat[start[shorter][p] + t], len(shorter))
    longer, shorter = row[longer][differ == 0], shorter[differ == 0]
    return np.concatenate([a, longer, shorter]), np.concatenate([b, shorter, longer])


def verified(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, n_near, form_n, form) of the words of whole groups; groups come one after the other."""

        def found(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            words, group = rows["word"].combine_chunks() if rows.num_rows else pa.array([], pa.string()), rows["key"].to_numpy()
            n = rows["n"].to_numpy()
            a, b = near_pairs(words, group, rows["choice"].to_numpy(), rows["side"].to_numpy(), parts)
            rank = np.empty(len(words), np.int64)
            rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
            order = np.lexsort((rank[b], -n[b], a))
            a, b = a[order], b[order]
            lead = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
            near = np.diff(np.append(lead, len(a)))
            return pa.RecordBatch.from_arrays([words.take(pa.array(a[lead])), pa.array(near), pa.array(n[b[lead]]), words.take(pa.array(b[lead]))], ["word", "n_near", "form_n", "form"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= SLICE:
                rows = pa.Table.from_batches(held)
                key = rows["key"].to_numpy()
                last = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])
                if last:
                    yield found(rows.slice(0, last))
                    held = rows.slice(last).to_batches()
        if held:
            yield found(pa.Table.from_batches(held))

    return run


def near_words(words: DataFrame, parts: int = PARTS, hot: int = HOT) -> DataFrame:
    """(word, n_near, form, form_n) of the distinct words (word, n) that have near ones: how many, and the one of largest n."""
    rows = words.select("word", "n", F.posexplode(signatures(F.col("word"), parts)).alias("choice", "sig"))
    large = rows.groupBy("sig").agg(F.count("*").alias("size")).filter(F.col("size") > hot).select("sig", F.lit(True).alias("large"))
    met = rows.join(large, "sig", "left")
    ends = F.array(F.struct(F.lit(1).alias("side"), F.xxhash64("sig", F.lit(1), F.substring("word", 1, FIX)).alias("key")), F.struct(F.lit(2).alias("side"), F.xxhash64("sig", F.lit(2), F.substring("word", -FIX, FIX)).alias("key")))
    dealt = met.select("word", "n", "choice", F.inline(F.when(F.col("large"), ends).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("sig").alias("key"))))))
    dealt = dealt.repartition("key").sortWithinPartitions("key")
    some = dealt.mapInArrow(verified(parts), "word string, n_near long, form_n long, form string")
    best = some.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form"))).alias("best"))
    return best.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n"))


def followed(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of (word, form); n grows tenfold from word to form, so that chains have at most log10(most) links."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    reach, longest = 1, len(str(most))
    while reach < longest:
        then = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = cut(now.join(then, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        reach *= 2
    return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = 10, parts: int = PARTS, hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of all texts that occur twice or more.

    Null and empty texts have no words; a null id is an empty one in the checksum of a run. Rows with equal ids and repeated
    rows count each. Of near words with equal n the smallest in code-point order is the form. Words of any length are taken
    whole, with work that grows with their length. An empty table gives no rows. Other columns are not read.
    """
    words = cut(word_counts(docs, id_col, text_col, least).filter("n >= 2"))
    found = words.join(near_words(words, parts, hot), "word", "left")
    formed = F.col("form_n") >= times * F.col("n")
    found = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("form")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n")))
    most = words.agg(F.max("n")).first()[0] or 0
    roots = followed(found.filter("form IS NOT NULL"), most)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
