"""Exact substring dedup: suffixes are sorted by a radix sort that goes no deeper than the threshold.

A string of `length` bytes goes from a document if it also starts in a document with a smaller id. Only suffixes whose
first `length` bytes are equal matter, so they are ordered through `length` bytes only, by most-significant-digit passes
of eight bytes; what is alone in its group after a pass is done, and the groups that are equal after the last pass are
exactly the repeated strings.

Suffixes are dealt out by a first digit that equal strings share wherever they start: the least of the hashes of all runs
of GRAM bytes in them. Neighbouring suffixes mostly share it, so that a stretch of them travels as one string:

1. Texts are packed into chunks of some MB. Each sends the distinct digits of its stretches, six bytes each, to parts by
   digit; a part answers with one bit for each whether other chunks have it too.
2. Stretches with a digit of several documents are sent as distinct strings, with the smallest and largest id of the
   documents of the chunk that have them. A digit with very many stretches (a passage in every third text) is split: its
   suffixes are dealt out one by one, by all their bytes. Each part sorts and answers with the smallest document of
   each suffix, where that is smaller than a document of the chunk.
3. Each chunk drops the bytes that are covered.

Chunks and parts are bounded; ids, digits and answers are packed, so rows stay few. Texts are shuffled twice, as
compressed chunks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, stored

LENGTH = 50  # bytes of a repeated string
GRAM = 24  # bytes of a run whose hash is a digit
CHUNK = 4 << 20  # bytes of text in a chunk; a longer text is one of its own
PART = 1 << 20  # bytes of text for each part
MOST_PARTS = 1 << 16
STRETCH = 64  # suffixes in a stretch
HOT = 4096  # stretches of a digit that are still sorted together
SOME = 16  # stretches of a digit that a chunk reports
BLOCK = 1 << 17  # suffixes hashed at once, so that the arrays stay in the cache
LAST = np.iinfo(np.int64).max  # the place of a null id


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of data[i : i + n] for each i."""
    now, width, factor, out, done = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15, None, 0
    while n:
        if n & 1:
            out = now if out is None else out[: len(out) - width] * np.uint64(factor) + now[done:]
            done += width
        n >>= 1
        if n:
            now = now[:-width] * np.uint64(factor) + now[width:]
            width, factor = 2 * width, factor * factor % (1 << 64)
    return mixed(out)


def least_of(x: np.ndarray, n: int) -> np.ndarray:
    """The least of x[i : i + n] for each i."""
    width = 1
    while 2 * width <= n:
        x, width = np.minimum(x[:-width], x[width:]), 2 * width
    return x if width == n else np.minimum(x[: width - n], x[n - width :])


def stretches(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first suffix, number of suffixes, digit, text) of every stretch: suffixes in a row with one digit in one text."""
    gram = min(GRAM, max(1, length // 2))
    firsts, counts, digits = [], [], []
    for at in range(0, len(data) - length + 1, BLOCK):
        hashes = gram_hashes(data[at : at + BLOCK + length - 1], gram)
        least = least_of(hashes, length - gram + 1)
        inside = np.ones(len(least), bool)
        for e in ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, at + len(least) + length, "left")]:
            inside[max(0, e - at - length + 1) : max(0, e - at)] = False
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | ~inside[:-1] | ~inside[1:]
        begin = np.flatnonzero(new)
        n = np.diff(np.append(begin, len(least)))
        begin, n = begin[inside[begin]], n[inside[begin]]
        if (n > STRETCH).any():
            k = -(-n // STRETCH)
            turn = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            begin, n = np.repeat(begin, k) + STRETCH * turn, np.minimum(np.repeat(n, k) - STRETCH * turn, STRETCH)
        firsts.append(begin + at)
        counts.append(n)
        digits.append(mixed(least[begin]))
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.concatenate(firsts)
    return first, np.concatenate(counts), np.concatenate(digits), np.searchsorted(ends, first, "right")


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number of their order."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        padded = (padded[:-width] << np.uint64(8 * width)) | padded[width:]
    return padded[: len(data)]


def equal_groups(eight: np.ndarray, starts: np.ndarray, length: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(members, group) of the strings of `length` bytes at starts that have an equal one in their group.

    Most-significant-digit passes of eight bytes; what is alone after a pass is done. Members come group by group.
    """
    members = np.arange(len(starts))
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])] if length >= 8 else [0]:
        digit = eight[starts[members] + at]
        if length < 8:
            digit >>= np.uint64(8 * (8 - length))
        order = np.lexsort((digit, group))
        members, group, digit = members[order], group[order], digit[order]
        new = np.ones(len(members), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        alone = new & np.append(new[1:], True)
        members, group = members[~alone], np.cumsum(new)[~alone]
        if not len(members):
            break
    return members, group


def distinct(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each string data[first : first + size] the number of the first string that is equal to it."""
    same = np.arange(len(first))
    eight = eights(data)
    for n in np.unique(size):
        these = np.flatnonzero(size == n)
        members, group = equal_groups(eight, first[these], int(n), np.zeros(len(these), np.int64))
        if len(members):
            lead = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            least = np.minimum.reduceat(these[members], lead)
            same[these[members]] = np.repeat(least, np.diff(np.append(lead, len(members))))
    return same


# -- chunks ---------------------------------------------------------------------------------------


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    head = struct.pack(f"<{len(arrays)}q", *(a.nbytes for a in arrays))
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(a.tobytes() for a in arrays))


def unpacked(value: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    at, out = 8 * len(kinds), []
    for kind, n in zip(kinds, struct.unpack_from(f"<{len(kinds)}q", raw), strict=True):
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at))
        at += n
    return out


def chunks(docs: DataFrame, id_col: str, text_col: str, most: int, paths: list[str]) -> DataFrame:
    """(chunk, n_bytes, data): whole texts with their ids and ends, stored."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        ids, texts, held = [], [], 0

        def row() -> pa.RecordBatch:
            sizes = np.array([-1 if t is None else len(t) for t in texts], np.int64)
            data = packed(np.array([LAST if i is None else i for i in ids], np.int64), np.array([i is None for i in ids]), sizes, np.frombuffer(b"".join(t for t in texts if t), np.uint8))
            return pa.RecordBatch.from_pydict({"chunk": pa.array([base + made]), "n_bytes": pa.array([held]), "data": pa.array([data], pa.binary())})

        for batch in by_bytes(batches, 1):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = 0 if t is None else len(t)
                if ids and held + n > most:
                    yield row()
                    ids, texts, held, made = [], [], 0, made + 1
                ids.append(i)
                texts.append(t)
                held += n
        if ids:
            yield row()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return stored(rows.mapInArrow(pack, "chunk long, n_bytes long, data binary"), paths)


def opened(value: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, which are null, sizes with -1 for null, ends, bytes) of a chunk."""
    ids, null, sizes, data = unpacked(value, np.int64, np.bool_, np.int64, np.uint8)
    return ids, null, sizes, np.cumsum(np.maximum(sizes, 0)), data


def by_part(digits: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins and ends in sorted digits."""
    first = np.array([-(-(p << 16) // parts) << 48 for p in range(parts)], np.uint64)
    return np.append(np.searchsorted(digits, first), len(digits))


def digit_counts(digit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct digits, which of them each stretch has, how many stretches have each)."""
    return np.unique(digit, return_inverse=True, return_counts=True)


def sent_digits(length: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, _, _, ends, data = opened(value)
                own, _, n = digit_counts(stretches(data, ends, length)[2])
                at = by_part(own, parts)
                low = own.view(np.uint8).reshape(-1, 8)[:, :6]
                full = np.flatnonzero(np.diff(at))
                keys = [low[at[p] : at[p + 1]].tobytes() for p in full]
                often = []
                for p in full:
                    many = np.flatnonzero(n[at[p] : at[p + 1]] >= SOME)
                    often.append(np.stack([many, n[at[p] + many]]).astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_pydict({"part": pa.array(full, pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int64()), "keys": pa.array(keys, pa.binary()), "often": pa.array(often, pa.binary())})

    return run


def shared_digits(table: pa.Table, limit: int = HOT) -> pa.Table:
    """For each chunk's digits of one part: a bit for those that other chunks have, and the places of those with `limit` stretches or more."""
    low = [np.frombuffer(k, np.uint8).reshape(-1, 6) for k in table["keys"].to_pylist()]
    sizes = [len(x) for x in low]
    keys = np.zeros((sum(sizes), 8), np.uint8)
    keys[:, :6] = np.concatenate(low)
    values, which, n = np.unique(keys.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
    total, at = n.copy(), 0
    for size, often in zip(sizes, table["often"].to_pylist(), strict=True):
        place, more = np.frombuffer(often, np.uint32).reshape(2, -1)
        np.add.at(total, which[at + place], more.astype(np.int64))
        at += size
    several, hot = (n > 1)[which], (total >= limit)[which]
    ends = np.cumsum(sizes)
    cut = lambda bits: pa.array([np.packbits(bits[e - s : e]).tobytes() for s, e in zip(sizes, ends, strict=True)], pa.binary())
    hots = [np.flatnonzero(hot[e - s : e]).astype(np.uint32).tobytes() for s, e in zip(sizes, ends, strict=True)]
    return pa.table({"chunk": table["chunk"].combine_chunks(), "part": table["part"].combine_chunks(), "bits": cut(several), "hot": pa.array(hots, pa.binary())})


def live_strings(data: np.ndarray, ends: np.ndarray, ids: np.ndarray, length: int, parts: int, answers: list[dict]) -> tuple[np.ndarray, ...]:
    """(first, number of suffixes, digit, document, first equal stretch) of the stretches that other documents may share."""
    first, n, digit, text = stretches(data, ends, length)
    doc = ids[text]
    own, which, _ = digit_counts(digit)
    live, hot, at = np.zeros(len(own), bool), np.zeros(len(own), bool), by_part(own, parts)
    for a in answers:
        b, e = at[a["part"]], at[a["part"] + 1]
        live[b:e] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=e - b)
        hot[b + np.frombuffer(a["hot"], np.uint32)] = True
    least, most = np.full(len(own), LAST), np.full(len(own), np.iinfo(np.int64).min)
    np.minimum.at(least, which, doc)
    np.maximum.at(most, which, doc)
    live |= least < most
    keep = live[which]
    first, n, digit, doc, split = first[keep], n[keep], digit[keep], doc[keep], hot[which[keep]]
    if split.any():  # suffixes of their own, dealt out by all their bytes
        k = n[split]
        single = np.repeat(first[split], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        strings = np.lib.stride_tricks.sliding_window_view(data, length)[single]
        powers = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(length)], np.uint64)
        whole = mixed(strings.astype(np.uint64) @ powers)
        first, n = np.append(first[~split], single), np.append(n[~split], np.ones(len(single), np.int64))
        digit, doc = np.append(digit[~split], mixed(whole)), np.append(doc[~split], np.repeat(doc[split], k))
    return first, n, digit, doc, distinct(data, first, n + length - 1)


def sent_strings(length: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, value, answers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids, _, _, ends, data = opened(value)
                first, n, digit, doc, same = live_strings(data, ends, ids, length, parts, answers or [])
                lead, which = np.unique(same, return_inverse=True)
                if not len(lead):
                    continue
                least, most = np.full(len(lead), LAST), np.full(len(lead), np.iinfo(np.int64).min)
                np.minimum.at(least, which, doc)
                np.maximum.at(most, which, doc)
                order = np.argsort(digit[lead], kind="stable")
                lead, least, most = lead[order], least[order], most[order]
                at = by_part(digit[lead], parts)
                full = np.flatnonzero(np.diff(at))
                rows = []
                for p in full:
                    these = slice(at[p], at[p + 1])
                    begin, size = first[lead[these]], n[lead[these]] + length - 1
                    text = data[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())]
                    rows.append(packed(digit[lead[these]], lead[these].astype(np.uint32), size.astype(np.uint16), least[these], most[these], text))
                yield pa.RecordBatch.from_pydict({"part": pa.array(full, pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int64()), "strings": pa.array(rows, pa.binary())})

    return run


def smallest_documents(data: np.ndarray, first: np.ndarray, size: np.ndarray, digit: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(where the suffixes of each string begin, the smallest document of each suffix) of distinct strings, which are sorted by digit."""
    n = size - length + 1
    place = np.cumsum(n) - n
    found = np.repeat(least, n)
    new = np.append(True, digit[1:] != digit[:-1])
    group = np.cumsum(new)
    shared = np.flatnonzero(~new | ~np.append(new[1:], True))
    eight, at = eights(data), 0
    while at < len(shared):  # about a million suffixes at once, all of a digit
        end = max(int(np.searchsorted(np.cumsum(n[shared[at:]]), 1 << 20)) + at, at + 1)
        end = int(np.searchsorted(group[shared], group[shared[end - 1]], "right"))
        these = shared[at:end]
        k = n[these]
        turn = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        slot = np.repeat(place[these], k) + turn
        members, groups = equal_groups(eight, np.repeat(first[these], k) + turn, length, np.repeat(group[these], k))
        if len(members):
            lead = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
            slots = slot[members]
            found[slots] = np.repeat(np.minimum.reduceat(found[slots], lead), np.diff(np.append(lead, len(members))))
        at = end
    return place, found


def answered(length: int):
    def run(table: pa.Table) -> pa.Table:
        """For each chunk the suffixes of its strings that a smaller document has: (string, from, to, document)."""
        rows = [unpacked(v, np.uint64, np.uint32, np.uint16, np.int64, np.int64, np.uint8) for v in table["strings"].to_pylist()]
        chunk = np.repeat(np.array(table["chunk"].to_pylist(), np.int64), [len(r[0]) for r in rows])
        digit, number, size, least, most, data = (np.concatenate(x) for x in zip(*rows, strict=True))
        size = size.astype(np.int64)
        first = np.cumsum(size) - size
        lead, which = np.unique(distinct(data, first, size), return_inverse=True)
        low = np.full(len(lead), LAST)
        np.minimum.at(low, which, least)
        order = np.argsort(digit[lead], kind="stable")
        lead, low = lead[order], low[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        which = rank[which]
        place, found = smallest_documents(data, first[lead], size[lead], digit[lead], low, length)
        begin = np.zeros(len(found), bool)
        begin[place] = True
        begin[1:] |= found[1:] != found[:-1]
        runs = np.flatnonzero(begin)
        run_end = np.append(runs[1:], len(found))
        run_from = np.searchsorted(runs, place)
        run_n = np.diff(np.append(run_from, len(runs)))[which]
        each = np.repeat(run_from[which], run_n) + np.arange(run_n.sum()) - np.repeat(np.cumsum(run_n) - run_n, run_n)
        record = np.repeat(np.arange(len(which)), run_n)
        told = found[runs[each]] < most[record]
        each, record = each[told], record[told]
        base = place[which[record]]
        fields = number[record], (runs[each] - base).astype(np.uint8), (run_end[each] - base).astype(np.uint8), found[runs[each]]
        bounds = np.flatnonzero(np.append(True, chunk[record][1:] != chunk[record][:-1])) if len(record) else []
        said = [packed(*(x[b:e] for x in fields)) for b, e in zip(bounds, np.append(bounds[1:], len(record)), strict=True)] if len(record) else []
        return pa.table({"chunk": pa.array(chunk[record][bounds] if len(record) else [], pa.int64()), "found": pa.array(said, pa.binary())})

    return run


def cleaned(length: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for value, answers, said in zip(*(batch.column(i).to_pylist() for i in range(1, 4)), strict=True):
                ids, null, sizes, ends, data = opened(value)
                covered = np.zeros(len(data) + 1, np.int32)
                if said:
                    first, _, _, doc, same = live_strings(data, ends, ids, length, parts, answers or [])
                    order = np.argsort(same, kind="stable")
                    number, low, high, least = (np.concatenate(x) for x in zip(*(unpacked(v, np.uint32, np.uint8, np.uint8, np.int64) for v in said), strict=True))
                    b, e = np.searchsorted(same[order], number, "left"), np.searchsorted(same[order], number, "right")
                    k = e - b
                    told = np.repeat(np.arange(len(k)), k)
                    at = order[np.repeat(b, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
                    later = doc[at] > least[told]
                    at, told = at[later], told[later]
                    covered += np.bincount(first[at] + low[told], minlength=len(covered)).astype(np.int32)
                    covered -= np.bincount(first[at] + high[told] + length - 1, minlength=len(covered)).astype(np.int32)
                gone = np.append(0, (np.cumsum(covered[:-1]) > 0).view(np.int8))
                edge = np.diff(np.append(gone, 0))
                begin, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
                # runs of neighbouring texts are told apart at the texts' ends
                start, raw, spans, kept = 0, data.tobytes(), [], []
                for stop in ends.tolist():
                    lo, hi = np.searchsorted(end, start, "right"), np.searchsorted(begin, stop, "left")
                    own = [(max(int(b), start), min(int(e), stop)) for b, e in zip(begin[lo:hi], end[lo:hi], strict=True)] if stop > start else []
                    spans.append([{"start": b - start, "end": e - start} for b, e in own])
                    edges = [start, *(x for pair in own for x in pair), stop]
                    kept.append(b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
                    start = stop
                kept = [None if n < 0 else x for n, x in zip(sizes.tolist(), kept, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([None if x else i for i, x in zip(ids.tolist(), null.tolist(), strict=True)], pa.int64()), pa.array(np.maximum(sizes, 0)), pa.array(spans, kind), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    return run


def without_repeats(docs: DataFrame, paths: list[str], id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, chunk: int = CHUNK, part: int = PART, hot: int = HOT) -> DataFrame:
    """(id, n_bytes, spans, kept) of every row: the removed runs of bytes, and the bytes that are left.

    A byte goes if a string of `length` bytes over it also starts in a document with a smaller id; strings are judged on
    the input. Null texts have no bytes and kept is null; texts shorter than `length` stay. Null ids come after all
    others, and rows with equal ids (repeated rows too) take nothing from each other. Texts may be as long as one task
    can hold about ten times. An empty table gives no rows. Other columns are not read. What is stored is added to paths,
    to be removed when the result has been read.
    """
    spark = docs.sparkSession
    table = chunks(docs, id_col, text_col, chunk, paths)
    total = table.agg(F.sum("n_bytes")).first()[0] or 0
    parts = min(MOST_PARTS, 1 + total // part)
    body = table.select("chunk", "data")
    digits = body.mapInArrow(sent_digits(length, parts), "part int, chunk long, keys binary, often binary")
    shared = digits.groupBy("part").applyInArrow(lambda x: shared_digits(x, hot), "chunk long, part int, bits binary, hot binary")
    shared = stored(shared.groupBy("chunk").agg(F.collect_list(F.struct("part", "bits", "hot")).alias("answers")), paths)  # bits of one chunk
    asked = body.join(shared.hint("shuffle_hash"), "chunk", "left")
    strings = asked.mapInArrow(sent_strings(length, parts), "part int, chunk long, strings binary")
    found = strings.groupBy("part").applyInArrow(answered(length), "chunk long, found binary")
    found = stored(found.groupBy("chunk").agg(F.collect_list("found").alias("found")), paths)
    both = body.join(shared.hint("shuffle_hash"), "chunk", "left").join(found.hint("shuffle_hash"), "chunk", "left")
    return both.mapInArrow(cleaned(length, parts), "id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary").withColumnRenamed("id", id_col)
