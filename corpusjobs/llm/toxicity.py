"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams, its ends marked; every n-gram of the vocabulary has an embedding, a
text is the average of the embeddings of its words (a word said n times counts as the root of n), and a linear
softmax over that average gives the chance of toxicity. Embeddings and softmax are trained jointly by gradient
descent in numpy. A misspelt word that training never saw still shares most of its n-grams with the word it
stands for. The vocabulary is made of the n-grams whose presence tells the classes of the sample apart best; texts of the
sample are learnt from whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, cut

#: Words: runs of letters and digits with inner apostrophes; anything else separates.
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
DIM, SCALE, GRAMS = 8, 30.0, (3, 4, 5, 6)
#: Texts in which an n-gram must occur, and n-grams of the vocabulary at most: with four times as many held-out rows are told apart worse.
LEAST, VOCABULARY = 4, 1 << 10
#: Labelled ids of each class that training takes at most, by the order of a hash of the id.
SAMPLE = 2000
#: Words whose margins a task remembers: some 40 MB.
REMEMBERED = 1 << 18


def grams(word: str) -> list[str]:
    marked = f"<{word}>"
    found = [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
    return found if len(marked) > 2 + GRAMS[0] else [*found, marked]


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def bag(text: str | None) -> tuple[list[str], np.ndarray]:
    """Distinct words of a text and their shares."""
    counts = Counter(words(text))
    share = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
    return list(counts), share / max(share.sum(), 1e-9)


@dataclass
class Model:
    """Embeddings of the n-grams of the vocabulary, softmax weights (dim x 2) and bias (2)."""

    vocabulary: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def __post_init__(self):
        # The softmax of two classes depends on the margin alone, which is linear: an n-gram adds a number to it.
        self.margins = dict(zip(self.vocabulary, (self.embeddings @ (self.weights[:, 1] - self.weights[:, 0])).tolist(), strict=True))
        self.base = float(self.bias[1] - self.bias[0])
        self.known: dict[str, float] = {}

    def __reduce__(self):
        return Model, (self.vocabulary, self.embeddings, self.weights, self.bias)

    def word(self, word: str) -> float:
        if (got := self.known.get(word)) is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            parts, margin = grams(word), self.margins.get
            got = self.known[word] = sum([margin(x, 0.0) for x in parts]) / len(parts)
        return got

    def score(self, text: str | None) -> float:
        """The chance of toxicity; that of no words is the softmax of the bias alone."""
        own, share = bag(text)
        margin = self.base + SCALE * float(np.fromiter(map(self.word, own), np.float64, len(own)) @ share)
        return float(1 / (1 + np.exp(-min(max(margin, -30.0), 30.0))))


def presence(texts: Iterator[tuple[list[str], int]]) -> dict[str, list[int]]:
    """In how many clean and toxic texts, given by their distinct words and labels, each n-gram is."""
    seen: dict[str, list[int]] = {}
    for own, label in texts:
        for g in {g for x in own for g in grams(x)}:
            seen.setdefault(g, [0, 0])[label] += 1
    return seen


def spread(n0: Column, n1: Column, clean: int, toxic: int) -> Column:
    """How far the share of toxic and of clean texts with an n-gram lie apart, in standard errors."""
    p = (n0 + n1) / (clean + toxic)
    return F.abs(n1 / toxic - n0 / clean) / F.sqrt(p * (1 - p) + 1e-3)


def gram_shares(own: list[str], share: np.ndarray, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the vocabulary in a text and their shares of it."""
    parts: dict[int, float] = {}
    for x, s in zip(own, share.tolist(), strict=True):
        found = grams(x)
        for g in found:
            if (i := number.get(g)) is not None:
                parts[i] = parts.get(i, 0.0) + s / len(found)
    return np.fromiter(parts.keys(), np.int32, len(parts)), np.fromiter(parts.values(), np.float32, len(parts))


def trained(names: list[str], texts: list[tuple[np.ndarray, np.ndarray]], labels: list[int], rounds: int = 200, rate: float = 0.05, decay: float = 1e-5, seed: int = 7, dim: int = DIM) -> Model:
    """Fit embeddings of the n-grams `names`, softmax and bias jointly to texts as gram_shares() gives them (Adam, all texts at once, classes weighted evenly).

    Labels are 0 or 1; with one class only, the bias alone tells it.
    """
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model([], np.zeros((0, dim)), np.zeros((dim, 2)), np.log([1 - share, share]))
    own_grams, own_parts = zip(*texts, strict=True)
    text_of, gram_of, part = np.repeat(np.arange(len(y), dtype=np.int32), list(map(len, own_grams))), np.concatenate(own_grams), SCALE * np.concatenate(own_parts).astype(np.float64)
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (len(names), dim)), rng.normal(0, 0.5, (dim, 2)), np.zeros(2)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (y == 0).sum())
    for step in range(1, rounds + 1):
        emb, w, bias = params
        out = w[:, 1] - w[:, 0]
        margin = np.bincount(text_of, weights=part * (emb @ out)[gram_of], minlength=len(y)) + bias[1] - bias[0]
        slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) * weight
        by_gram = np.bincount(gram_of, weights=part * slope[text_of], minlength=len(names))
        g_out, g_bias = emb.T @ by_gram, slope.sum()
        grads = (by_gram[:, None] * out[None, :] + decay * emb, np.stack([-g_out, g_out], axis=1) + decay * w, np.array([-g_bias, g_bias]))
        for p, g, (m, v) in zip(params, grads, moments, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(names, *params)


def train(bags: list[tuple[list[str], np.ndarray]], labels: list[int], least: int = LEAST, most: int = VOCABULARY, **options) -> Model:
    """A model of a few bags of words, for use without tables; see fit(), which chooses n-grams and learns alike."""
    keep = [(b, y) for b, y in zip(bags, labels, strict=True) if b[0]]
    n0, n1 = (sum(y == c for _, y in keep) for c in (0, 1))
    names: list[str] = []
    if n0 and n1:
        seen = {g: n for g, n in presence((own, y) for (own, _), y in keep).items() if sum(n) >= least}
        share = {g: sum(n) / (n0 + n1) for g, n in seen.items()}
        names = sorted(seen, key=lambda g: (-abs(seen[g][1] / n1 - seen[g][0] / n0) / (share[g] * (1 - share[g]) + 1e-3) ** 0.5, g))[:most]
    number = {g: i for i, g in enumerate(names)}
    return trained(names, [gram_shares(*b, number) for b, _ in keep], [y for _, y in keep], **options)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, least: int = LEAST, most: int = VOCABULARY, **options) -> Model:
    """A model from at most `sample` labelled ids of each class, chosen by a hash of the id.

    Only ids whose crc32(id as text) mod 5 is not 0 are learnt from, and ids only choose the rows. Of rows that share an
    id the one with the smallest hash of its text counts, so at most 2 `sample` whole texts are learnt from. Tasks count
    in how many of them each n-gram is, of which Spark finds the `most` that tell the classes apart best, and give the
    shares of those in each text; these alone reach the driver. Texts without words, null labels, null ids and labels
    other than 0 and 1 are left out, an id with both labels counts for each; without labelled rows the score is an even
    one.
    """
    key = F.col(id_col).cast("string")
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"), key.alias("k")).filter(F.col("y").isin(0, 1) & F.col("k").isNotNull() & (F.crc32(F.col("k").cast("binary")) % 5 != 0)).distinct()
    picked = None
    for y in (0, 1):
        some = marked.filter(F.col("y") == y).orderBy(F.md5("k"), "k").limit(sample)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id").select("k", "y", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"))  # 2 `sample` rows
    one = cut(texts.groupBy("k", "y").agg(F.min_by("text", F.struct("h", "text")).alias("text")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            own = [(list(set(words(t))), y) for y, t in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            seen = presence(iter(own))
            labels = [sum(y == c for x, y in own if x) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([*seen, None], pa.string()), *(pa.array([*(n[c] for n in seen.values()), labels[c]], pa.int64()) for c in (0, 1))], ["gram", "n0", "n1"])

    found = cut(one.select("y", "text").mapInArrow(counted, "gram string, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    classes = found.filter("gram IS NULL").first()  # the texts of each class
    names: list[str] = []
    if classes and classes.n0 and classes.n1:
        apart = spread(F.col("n0"), F.col("n1"), classes.n0, classes.n1)
        names = [r.gram for r in found.filter(F.col("gram").isNotNull() & (F.col("n0") + F.col("n1") >= least)).orderBy(F.desc(apart), "gram").limit(most).select("gram").collect()]
    number = {g: i for i, g in enumerate(names)}

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2):
            made = [(k, y, *gram_shares(*own, number)) for k, y, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (own := bag(t))[0]]
            if made:
                k, y, at, part = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(y, pa.int32()), *(pa.array([x.tobytes() for x in own], pa.binary()) for own in (at, part))], ["k", "y", "grams", "parts"])

    # As Arrow columns, in the order of labels and ids: rows of lists would take many times the memory of the driver.
    rows = one.select("k", "y", "text").mapInArrow(shared, "k string, y int, grams binary, parts binary").toArrow().sort_by([("y", "ascending"), ("k", "ascending")])
    made = [(np.frombuffer(g, np.int32), np.frombuffer(p, np.float32)) for g, p in zip(rows.column("grams").to_pylist(), rows.column("parts").to_pylist(), strict=True)]
    return trained(names, made, rows.column("y").to_pylist(), **options)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row; scores come from the whole text alone, however long.

    Null and empty texts get the bias. Equal texts have equal scores; repeated rows and null ids stay rows of their own.
    Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(model.score, batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def judged(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document; see fit() and scores(). An empty table gives no rows."""
    found = scores(docs, fit(docs, labels, **options))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows that score 0.5 or more; all columns stay, whatever their names. Null and empty texts stay, and so do repeated rows that score less."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, at):
            yield batch.filter(pa.array([not t or model.score(t) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
