"""Benchmark decontamination with a multi-pass Wu-Manber search.

Texts are lower-cased in A-Z and brought to ``" w1 w2 ... wn "``; every window of ``window`` consecutive item
words (an item of fewer words is one window) is a pattern of that form.  Patterns are grouped by length, so that
a short item does not shorten the jumps of the long ones.  Per group, a shift table over blocks skips positions
where no pattern can end, positions with shift zero look up the bucket of their suffix block, and what is in the
bucket is compared directly, byte by byte.  Many positions of a step jump side by side ("lanes") in numpy.

Items are broadcast only in parts of a checked size (``part_bytes`` of item text each); more items mean more
passes over the documents, chained without a shuffle.  After every STAGE_PARTS parts what was found is written and
read again, so that no task holds the tables of more parts than that.

Edge cases: null or empty text has no words; null items and items without words are ignored; items that share an id
count as one; an item without an id hits words like any other, but it can't be named and does not count as an item
found; repeated documents give repeated rows; an empty table gives no rows; columns of any name are passed on.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_steps, stored, utf8

WINDOW = 10
PART_BYTES = 4 << 20
#: Pattern lengths at which a new search group starts; block bytes used in the group.
GROUPS = ((0, 2), (8, 8), (16, 12), (32, 16), (64, 16))
LANE = 1024
STAGE_PARTS = 4
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

_FORM = np.full(256, 32, np.uint8)
for _c in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _FORM[_c] = _c
for _c in range(65, 91):
    _FORM[_c] = _c + 32


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


class Normal:
    """Some texts as one buffer of single-spaced words, documents apart by a byte 1."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b" " + b" \x01 ".join(texts) + b" \x01", np.uint8)
        ends = np.cumsum([len(x) + 3 for x in texts]) - 1
        form = _FORM[raw]
        form[ends] = 1
        keep = form != 32
        keep[0] = True
        keep[1:] |= form[:-1] != 32
        body = form[keep]
        self.n = len(body)
        self.bytes = np.concatenate([body, np.zeros(16, np.uint8)])
        self.eight = np.ndarray((self.n + 8,), "<u8", self.bytes, strides=(1,))
        self.stops = np.flatnonzero(body == 1)
        #: places of the blank before each word
        self.starts = np.flatnonzero((body[:-1] == 32) & (body[1:] > 32))
        self.first = np.searchsorted(self.starts, np.concatenate([[0], self.stops]))


def _block(at: np.ndarray, eight: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit value of the ``size`` bytes at each place; exact up to 8 bytes, mixed beyond."""
    if size <= 8:
        return eight[at] & np.uint64((1 << (8 * size)) - 1 & (2**64 - 1))
    head, tail = eight[at], eight[at + (size - 8)]
    return head * np.uint64(0x9E3779B97F4A7C15) ^ (tail ^ (tail >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Group:
    """Shift table and suffix buckets for patterns of similar length."""

    def __init__(self, patterns: list[bytes], block: int):
        self.m = min(map(len, patterns))
        self.block = min(block, self.m)
        self.lengths = np.array([len(p) for p in patterns])
        flat = np.frombuffer(b"".join(patterns) + bytes(16), np.uint8)
        eight = np.ndarray((len(flat) - 8,), "<u8", flat, strides=(1,))
        self.begin = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = flat
        self.bits = min(22, max(10, int(np.log2(len(patterns) * (self.m - self.block + 1) + 1)) + 3))
        self.shift = np.full(1 << self.bits, self.m - self.block + 1, np.int32)
        for end in range(self.block, self.m + 1):
            keys = _block(self.begin + (end - self.block), eight, self.block)
            np.minimum.at(self.shift, self._slot(keys), self.m - end)
        suffix = _block(self.begin + (self.m - self.block), eight, self.block)
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - self.bits)

    def find(self, text: Normal) -> tuple[np.ndarray, np.ndarray]:
        """Places and pattern numbers of all occurrences."""
        first, last = self.m - self.block, text.n - self.block + 1
        at = np.arange(first, max(first, last), LANE)
        end = np.minimum(at + LANE, last)
        found = []
        while at.size:
            step = self.shift[self._slot(_block(at, text.eight, self.block))]
            if (zero := at[step == 0]).size:
                found.append(zero)
            at = at + np.maximum(step, 1)
            on = at < end
            at, end = at[on], end[on]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.concatenate(found)
        keys = _block(at, text.eight, self.block)
        lo, hi = np.searchsorted(self.suffix, keys, "left"), np.searchsorted(self.suffix, keys, "right")
        count = hi - lo
        at = np.repeat(at, count) - (self.m - self.block)
        which = self.order[np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
        size = self.lengths[which]
        on = at + size <= text.n
        at, which, size = at[on], which[on], size[on]
        for k in range(int(self.lengths.max())):  # direct comparison; false candidates drop out in the first rounds
            if not at.size:
                break
            same = (k >= size) | (text.bytes[at + np.minimum(k, size - 1)] == self.flat[self.begin[which] + np.minimum(k, size - 1)])
            if not same.all():
                at, which, size = at[same], which[same], size[same]
        return at, which


class Patterns:
    """The windows of some items, ready to be searched."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        of: dict[bytes, set[str | None]] = defaultdict(set)
        for item, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                of[b" " + b" ".join(words[i : i + window]) + b" "].add(item)
        self.patterns = sorted(of)
        self.items = [sorted(x for x in of[p] if x is not None) for p in self.patterns]
        sizes = [len(p) for p in self.patterns]
        self.groups = []
        for k, (least, block) in enumerate(GROUPS):
            most = GROUPS[k + 1][0] if k + 1 < len(GROUPS) else 1 << 62
            if own := [i for i, n in enumerate(sizes) if least <= n < most]:
                self.groups.append((np.array(own), Group([self.patterns[i] for i in own], block)))

    def find(self, text: Normal) -> tuple[np.ndarray, np.ndarray]:
        at, which = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for own, group in self.groups:
            a, w = group.find(text)
            at.append(a)
            which.append(own[w])
        return np.concatenate(at), np.concatenate(which)


def _scan(patterns: Patterns, piece: pa.RecordBatch, names: tuple[str, str, str]) -> dict:
    n_words, hits_, items_ = names
    text = Normal(utf8(piece.column("text")))
    at, which = patterns.find(text)
    size = np.array([len(p) for p in patterns.patterns], np.int64)[which] if at.size else at
    doc = np.searchsorted(text.stops, at)
    lo, hi = np.searchsorted(text.starts, at), np.searchsorted(text.starts, at + size - 1)
    hits: dict[int, list] = defaultdict(list)
    items: dict[int, set] = defaultdict(set)
    for k in np.lexsort((lo, doc)):
        d = int(doc[k])
        a, b = int(lo[k] - text.first[d]), int(hi[k] - text.first[d])
        if hits[d] and a <= hits[d][-1][1]:
            hits[d][-1][1] = max(b, hits[d][-1][1])
        else:
            hits[d].append([a, b])
        items[d].update(patterns.items[which[k]])
    before_hits, before_items = piece.column(hits_).to_pylist(), piece.column(items_).to_pylist()
    out_hits, out_items = [], []
    for i, (old, found) in enumerate(zip(before_hits, before_items, strict=True)):
        merged: list = []
        for a, b in sorted([(x["start"], x["end"]) for x in old] + [tuple(x) for x in hits.get(i, ())]):
            if merged and a <= merged[-1]["end"]:
                merged[-1]["end"] = max(b, merged[-1]["end"])
            else:
                merged.append({"start": a, "end": b})
        out_hits.append(merged)
        out_items.append(sorted({*found, *items.get(i, ())}))
    return {c: piece.column(c) for c in piece.schema.names} | {n_words: np.diff(text.first), hits_: out_hits, items_: out_items}


def _bin(bins: int) -> Column:
    return F.pmod(F.xxhash64("item_id", "text"), F.lit(bins))


def _parts(items: DataFrame, part_bytes: int) -> list[tuple[int, int]]:
    """Ranges of hash bins with ``part_bytes`` of ids and texts at most; a bin beyond that (a long item) is a part of its own."""
    size = F.octet_length("text") + F.coalesce(F.octet_length("item_id"), F.lit(0)) + 64
    total = items.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    bins = 64 * max(1, -(-total // part_bytes))
    held = {r["bin"]: r["n"] for r in items.groupBy(_bin(bins).alias("bin")).agg(F.sum(size).alias("n")).collect()}  # 64 rows a part
    out, start, now = [], 0, 0
    for k in range(bins):
        n = held.get(k, 0)
        if now and now + n > part_bytes:
            out.append((start, k))
            start, now = k, 0
        now += n
    return [*out, (start, bins)]


_SPANS = "array<struct<start: bigint, end: bigint>>"


def _searched(docs: DataFrame, benchmark: DataFrame, window: int, part_bytes: int) -> tuple[DataFrame, tuple[str, str, str]]:
    """All columns of ``docs``, with three more: the number of words, the hit word ranges and the items found; and their names."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    items = stored(items.distinct())  # rows that repeat are one
    parts = _parts(items, part_bytes)
    names: tuple = ()
    for _ in range(3):
        names = (*names, free_name(docs, *names))
    n_words, hits, found = names
    out = docs.withColumns({n_words: F.lit(0).cast("long"), hits: F.expr(f"cast(array() as {_SPANS})"), found: F.expr("cast(array() as array<string>)")})
    shape = T.StructType([*docs.schema, *T.StructType.fromDDL(f"{n_words} bigint, {hits} {_SPANS}, {found} array<string>")])
    alive = []
    bins = sum(hi - lo for lo, hi in parts)
    for k, (lo, hi) in enumerate(parts):
        own = items.filter(_bin(bins).between(lo, hi - 1))
        held = spark.sparkContext.broadcast([(r["item_id"], r["text"].encode()) for r in own.toLocalIterator()])
        alive.append(held)
        made: list[Patterns] = []

        def work(piece: pa.RecordBatch, held=held, made=made) -> dict:
            if not made:
                made.append(Patterns(held.value, window))
            return _scan(made[0], piece, names)

        out = map_steps(out, "text", shape, work)
        if len(alive) == STAGE_PARTS and k + 1 < len(parts):
            out = stored(out)
            for x in alive:
                x.destroy()
            alive = []
    return out, names


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """``doc_id, n_words, hits, items``: hit word ranges (start, end exclusive) and the ids of items found."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out, (n_words, hits, found) = _searched(rows, benchmark, window, part_bytes)
    return out.select("doc_id", F.col(n_words).alias("n_words"), F.col(hits).alias("hits"), F.col(found).alias("items"))


def digest(found: DataFrame) -> DataFrame:
    n_hit: Column = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no window of any item occurs, all columns kept."""
    out, (_, hits, _) = _searched(docs, benchmark, window, part_bytes)
    return out.filter(F.size(hits) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
