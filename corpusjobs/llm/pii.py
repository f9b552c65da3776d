"""Personal data by base patterns and a semi-Markov conditional random field.

The base finds e-mail addresses, IP addresses, card and phone numbers by their fixed patterns and checks, in
time linear in the text. Around digits and at-signs that the base leaves free, a semi-Markov CRF scores whole
candidate segments (their shape, digits, separators, checksums, neighbours) and a dynamic program over segments
of bounded length chooses boundaries and kinds jointly; what it chooses is added to the base spans. The field
is trained here, by the gradient of its likelihood, on base spans of a bounded sample and on variants of them
that the patterns miss (no plus sign, other separators); numbers that failed a check are its counterexamples.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base; e-mail addresses are found from their at-sign.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Tokens and characters of an entity at most; documents of the training sample, regions of each and characters of a region there.
LONGEST, MOST_CHARS, SAMPLE, REGIONS, REGION = 24, 320, 2000, 8, 1024
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|\s+|.", re.DOTALL)
HOT, GAP = re.compile(r"[0-9@]"), re.compile(r"\s")

Span = tuple[str, int, int]


# -- base -----------------------------------------------------------------------------------------


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def ips(text: str) -> Iterator[Span]:
    """A chain of numbers and dots holds matches of four numbers, one after the other."""
    for m in CHAIN.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts), 4):
            own = parts[i : i + 4]
            end = at + sum(map(len, own)) + len(own) - 1
            if len(own) == 4 and all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in own):
                yield "ip", at, end
            at = end + 1


def cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()


def phones(text: str) -> Iterator[Span]:
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield "phone", *m.span()


def ordered(spans) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind; spans of different kinds may overlap."""
    found: list[Span] = []
    if "@" in text:
        found += emails(text)
    if HOT.search(text):
        if "." in text:
            found += ips(text)
        found += cards(text)
        if "+" in text:
            found += phones(text)
    return ordered(found)


# -- candidate segments ---------------------------------------------------------------------------


def regions(text: str, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """Maximal runs of words that hold a digit or an at-sign, one space apart, outside the taken spans, however long."""
    blocked = sorted((a, b) for _, a, b in taken)
    start = end = -1
    at = 0
    while m := HOT.search(text, at):
        a = b = m.start()
        while a > max(at, end) and not text[a - 1].isspace():
            a -= 1
        b = space.start() if (space := GAP.search(text, b)) else len(text)
        if start >= 0 and a - end <= 1:
            end = b
        else:
            if start >= 0:
                yield from free(start, end, blocked)
            start, end = a, b
        at = b
    if start >= 0:
        yield from free(start, end, blocked)


def free(start: int, end: int, blocked: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for a, b in blocked:
        if b <= start or a >= end:
            continue
        if a > start:
            yield start, a
        start = max(start, b)
    if start < end:
        yield start, end


def fits(kind: str, s: str) -> bool:
    """Whether a segment may be of a kind at all."""
    if kind == "email":
        return s.count("@") == 1 and not any(c.isspace() for c in s) and s[0].isalnum() and s[-1].isalnum()
    digits = sum(c.isdigit() for c in s)
    if kind == "ip":
        return s.count(".") == 3 and digits + 3 == len(s) and ".." not in s and s[0] != "." != s[-1]
    if kind == "card":
        return 13 <= digits <= 19 and all(c.isdigit() or c in " -." for c in s) and s[0].isdigit() and s[-1].isdigit()
    return 7 <= digits <= 15 and all(c.isdigit() or c in "+ ().-" for c in s) and (s[0].isdigit() or s[0] in "+(") and s[-1].isdigit()


def features(kind: str, s: str, before: str, after: str, word: str) -> list[str]:
    """Features of a whole segment: shape, counts, checks and neighbours."""
    digits = "".join(c for c in s if c.isdigit())
    shape = re.sub(r"[0-9]+", lambda m: f"d{min(len(m[0]), 20)}", re.sub(r"[A-Za-z]+", "a", s)) if kind != "email" else ""
    out = ["bias", f"n={len(digits)}", f"before={'w' if before.isalnum() else 's' if before.isspace() else before}", f"after={'w' if after.isalnum() else 's' if after.isspace() else after}", f"word={word[:12].lower()}"]
    if kind == "email":
        host = s.partition("@")[2]
        out += [f"dots={min(host.count('.'), 3)}", f"end={host.rpartition('.')[2][:6].lower()}"]
    elif kind == "ip":
        out += [f"octets={all(int(p[:6]) <= 255 for p in s.split('.'))}"]
    elif kind == "card":
        out += [f"luhn={luhn(digits)}", f"seps={''.join(sorted(set(s) - set('0123456789')))}", f"luhn={luhn(digits)},n={len(digits)}", f"shape={shape}"]
    else:
        out += [f"first={s[0] if not s[0].isdigit() else 'd'}", f"seps={''.join(sorted(set(s) - set('0123456789')))}", f"shape={shape}", f"groups={shape.count('d')}"]
    return [f"{kind}|{x}" for x in out]


def ending(text: str, bounds: list[int], j: int, word: str) -> Iterator[tuple[int, str, list[str]]]:
    """(i, kind, features) of each candidate segment from bound i to bound j: at most LONGEST tokens and MOST_CHARS characters."""
    for i in range(max(0, j - LONGEST), j):
        if bounds[j] - bounds[i] > MOST_CHARS:
            continue
        s = text[bounds[i] : bounds[j]]
        if s[0].isspace() or s[-1].isspace():
            continue
        for kind in KINDS:
            if fits(kind, s):
                yield i, kind, features(kind, s, text[bounds[i] - 1 : bounds[i]] or " ", text[bounds[j] : bounds[j] + 1] or " ", word)


def bounds_of(text: str, start: int, end: int) -> tuple[list[int], str]:
    """Token bounds in a region, and the word before it."""
    left = text[max(0, start - 40) : start].split()
    return [m.start() for m in TOKEN.finditer(text, start, end)] + [end], left[-1] if left else ""


def candidates(text: str, start: int, end: int) -> tuple[list[int], list[list[tuple[int, str, list[str]]]]]:
    """(bounds, by): token bounds in the region; by[j] has (i, kind, features) of each candidate that ends at bound j."""
    bounds, word = bounds_of(text, start, end)
    return bounds, [[], *(list(ending(text, bounds, j, word)) for j in range(1, len(bounds)))]


# -- the field ------------------------------------------------------------------------------------


def logsum(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -math.inf else a


class Field:
    """Weights of segment features; a token outside every segment scores 0."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def score(self, features: list[str]) -> float:
        return sum([self.weights.get(f, 0.0) for f in features])

    def best(self, text: str, start: int, end: int) -> list[Span]:
        """The segments of the best segmentation of a region (ties go to no segment, then to the first)."""
        bounds, word = bounds_of(text, start, end)
        best, back = [0.0] + [-math.inf] * (len(bounds) - 1), [None] * len(bounds)
        for j in range(1, len(bounds)):
            best[j] = best[j - 1]
            for i, kind, found in ending(text, bounds, j, word):
                if (s := best[i] + self.score(found)) > best[j] + 1e-12:
                    best[j], back[j] = s, (i, kind)
        spans, j = [], len(bounds) - 1
        while j:
            if back[j]:
                spans.append((back[j][1], bounds[back[j][0]], bounds[j]))
                j = back[j][0]
            else:
                j -= 1
        return spans

    def train(self, cases: list[tuple[str, list[Span]]], rounds: int = 8, rate: float = 0.5, decay: float = 1e-3, seed: int = 5) -> Field:
        """Stochastic gradient of the likelihood of the gold spans (AdaGrad). A case is a text and its gold spans."""
        made = []
        for text, gold in cases:
            for start, end in regions(text, []):
                bounds, by = candidates(text, start, end)
                if any(by):
                    made.append((bounds, by, {(a, b, k) for k, a, b in gold}))
        rng, seen = random.Random(seed), defaultdict(lambda: 1e-6)
        for _ in range(rounds):
            rng.shuffle(made)
            for bounds, by, gold in made:
                n = len(bounds)
                scored = [[(i, k, f, self.score(f)) for i, k, f in x] for x in by]
                front = [0.0] + [-math.inf] * (n - 1)
                for j in range(1, n):
                    front[j] = front[j - 1]
                    for i, _k, _f, s in scored[j]:
                        front[j] = logsum(front[j], front[i] + s)
                rear = [-math.inf] * (n - 1) + [0.0]
                for j in range(n - 1, 0, -1):
                    rear[j - 1] = logsum(rear[j - 1], rear[j])
                    for i, _k, _f, s in scored[j]:
                        rear[i] = logsum(rear[i], rear[j] + s)
                for j in range(1, n):
                    for i, k, f, s in scored[j]:
                        g = ((bounds[i], bounds[j], k) in gold) - math.exp(min(0.0, front[i] + s + rear[j] - front[-1]))
                        if abs(g) > 1e-4:
                            for x in f:
                                w = self.weights.get(x, 0.0)
                                step = g - decay * w
                                seen[x] += step * step
                                self.weights[x] = w + rate * step / math.sqrt(seen[x])
        return self


def variants(text: str, spans: list[Span], rng: random.Random) -> tuple[str, list[Span]]:
    """The text with some of its spans written in ways that the base misses, and where the spans are then."""
    out, gold, at = [], [], 0
    shift = 0
    for kind, a, b in spans:
        if a < at:
            continue
        s = text[a:b]
        if kind == "phone" and rng.random() < 0.6:
            s = rng.choice((s[1:], s[1:].partition(" ")[2] or s[1:], s[1:].replace(" ", "-"), s[1:].replace(" ", ".")))
        elif kind == "card" and rng.random() < 0.5:
            d = "".join(c for c in s if c.isdigit())
            s = ".".join(d[i : i + 4] for i in range(0, len(d), 4))
        out += [text[at:a], s]
        gold.append((kind, a + shift, a + shift + len(s)))
        shift += len(s) - (b - a)
        at = b
    return "".join([*out, text[at:]]), gold


def counterexamples(rng: random.Random, n: int = 60) -> list[tuple[str, list[Span]]]:
    """Numbers that are nobody's: dates with times, amounts, versions, ranges, handles."""
    pick = lambda a, b: rng.randint(a, b)
    out = []
    for _ in range(n):
        day = f"{pick(1900, 2099)}-{pick(1, 12):02}-{pick(1, 28):02}"
        out += [f"on {day} {pick(0, 23):02}:{pick(0, 59):02} it", f"on {day} {pick(0, 23)} {pick(0, 59)} it", f"from {day} {day} to", f"of {pick(1, 999)} {pick(100, 999)} {pick(100, 999)}.{pick(10, 99)} units", f"version {pick(0, 30)}.{pick(0, 30)}.{pick(0, 9999)} of", f"see x@{pick(1, 99)} or a@b", f"no {pick(10**6, 10**9)} in"]
    return [(x, []) for x in out]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, regions_each: int = REGIONS, region: int = REGION) -> Field:
    """A field from at most `sample` texts with digits or at-signs, by the order of a hash of the text.

    The training sample is bounded: of each such text the first `regions_each` regions, at most `region` characters of
    each and some before and after go to the driver. Finding spans has no such bounds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 0):
            found = []
            for text in batch.column(0).to_pylist():
                found += [text[max(0, a - 60) : min(b, a + region) + 20] for a, b in islice(regions(text, []), regions_each)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["part"])

    some = docs.select(F.col(text_col).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    hashed = some.select("text", F.xxhash64("text").alias("h"))
    last = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]  # only hashes are sorted
    picked = hashed.filter(F.col("h") <= F.lit(last)).select("text")
    parts = sorted(r.part for r in picked.mapInArrow(run, "part string").distinct().collect())
    rng = random.Random(3)
    cases = counterexamples(rng)
    for part in parts:
        gold = base_spans(part)
        cases.append((part, [g for i, g in enumerate(gold) if not any(x[1] < g[2] and g[1] < x[2] for x in gold[:i])]))
        if gold:
            cases.append(variants(part, gold, rng))
    return Field().train(cases)


def spans(text: str | None, field: Field) -> tuple[list[Span], list[Span]]:
    """(base, all): the base spans, and those with what the field adds where the base has none."""
    text = text or ""
    base = base_spans(text)
    added = [s for start, end in regions(text, base) for s in field.best(text, start, end)]
    return base, ordered([*base, *added])


def written(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def personal_data(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, counts of base spans by kind, base_sha256, and all spans.

    Spans are kind:start:end by start, then kind, in code points, the end exclusive. A null text counts as
    empty: no spans. Texts are read whole, and regions of any length are segmented whole, in time and memory linear
    in their tokens; an added entity has at most LONGEST tokens and MOST_CHARS characters. Repeated rows and null ids
    stay rows of their own, an empty table gives no rows, and other columns are not read.
    """
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, found = spans(text, field)
                rows.append((doc, *(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(found)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in zip(names, kinds, strict=True)))
