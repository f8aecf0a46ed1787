"""SimHash near-duplicates over a Gray-order hierarchical index.

A fingerprint has a bit per position of the 64-bit shingle hashes, set where more than half of the hashes have it.
Fingerprints within ``distance`` bits link, and documents of linked fingerprints form a component.

Two fingerprints within 2 bits agree on at least 4 of 6 bit blocks.  The shared masked pattern of each choice of 4
blocks (42 bits or more) is the upper node under which fingerprints meet; at most 22 bits are free below it, which
bounds every group whatever the data.  Below it, fingerprints are sorted by Gray rank and form a binary hierarchy
in which a node keeps the bits all its members share; pairs of nodes are pruned as soon as the differences of
their shared bits exceed the distance.  A group returns each member's least linked member, not its pairs.

Edge cases: null, empty and wordless texts have fingerprint zero and link like any other; fewer words than a
shingle are one shingle; a document's own id is null if its ``doc_id`` is; repeated rows each get a row; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_steps, utf8
from .components import components

WORDS, SEED, DISTANCE = 3, 42, 2
#: Bit blocks; any two fingerprints within two bits agree on four of these six.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
_signed = lambda bits: bits - (1 << 64) if bits >> 63 else bits
MASKS = [_signed(sum(((1 << n) - 1) << at for at, n in chosen)) for chosen in combinations(BLOCKS, len(BLOCKS) - DISTANCE)]
_CHUNK, _PAIRS = 1 << 15, 1 << 20


def fingerprint(text: bytes) -> int:
    """The unsigned fingerprint of a text."""
    words = text.lower().split()  # on bytes: A-Z alone are lowered, and 0x20, 0x09-0x0D alone split
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(WORDS, len(words))
    n = len(words) - k + 1
    hashed = xxhash.xxh64_intdigest
    return majority(
        np.array(
            [hashed(joined[a:b], SEED) for a, b in zip(starts[at : min(n, at + _CHUNK)].tolist(), ends[at + k - 1 : min(n, at + _CHUNK) + k - 1].tolist(), strict=True)],
            "<u8",
        )
        for at in range(0, n, _CHUNK)
    )


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of the hashes."""
    counts, n = np.zeros(64, np.int64), 0
    for h in parts:
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += h.size
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) for every row."""

    def work(piece: pa.RecordBatch) -> dict:
        values = np.array([fingerprint(x) for x in utf8(piece.column("text"))], "<u8")
        return {"doc_id": piece.column("doc_id"), "fp": values.view("<i8")}

    return map_steps(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        "text",
        "doc_id long, fp long",
        work,
    )


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence."""
    rank = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class _Shared:
    """The bits that all members of any range of a sorted array share, from tables over power-of-two ranges."""

    def __init__(self, values: np.ndarray, longest: int):
        self.all, self.any = [values], [values]
        step = 1
        while 2 * step <= longest:
            a, o = self.all[-1], self.any[-1]
            self.all.append(a[:-step] & a[step:])
            self.any.append(o[:-step] | o[step:])
            step *= 2

    def of(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shared bits' values, mask of shared bits) of the ranges [lo, hi)."""
        value, mask = np.empty(lo.size, np.uint64), np.empty(lo.size, np.uint64)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for k in np.unique(level):
            own = level == k
            a, b = lo[own], hi[own] - (1 << int(k))
            value[own] = self.all[k][a] & self.all[k][b]
            mask[own] = ~(value[own] ^ (self.any[k][a] | self.any[k][b]))
        return value, mask


def linked_pairs(values: np.ndarray, group_lo: np.ndarray, group_hi: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of linked pairs inside each group of an array that is sorted by group and Gray rank; of very many, a spanning part."""
    if not group_lo.size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shared = _Shared(values, int((group_hi - group_lo).max()))
    pairs = [np.stack([group_lo, group_hi, group_lo, group_hi])]
    left, right, held = [], [], 0
    while pairs:
        now = pairs.pop()
        if now.shape[1] > 1 << 17:  # depth first in slices: the frontier stays bounded
            pairs += [now[:, : now.shape[1] // 2], now[:, now.shape[1] // 2 :]]
            continue
        (va, ma), (vb, mb) = shared.of(now[0], now[1]), shared.of(now[2], now[3])
        now = now[:, np.bitwise_count((va ^ vb) & ma & mb) <= distance]
        alo, ahi, blo, bhi = now
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        hit = leaf & (alo != blo)
        left.append(alo[hit])
        right.append(blo[hit])
        held += int(hit.sum())
        if held > _PAIRS:  # links that connect the same come in place of all pairs so far
            root = least_linked(values.size, np.concatenate(left), np.concatenate(right))
            on = np.flatnonzero(root != np.arange(values.size))
            left, right, held = [on], [root[on]], 0
        alo, ahi, blo, bhi = now[:, ~leaf]
        if not alo.size:
            continue
        same = alo == blo
        same &= ahi == bhi
        a, b = alo[same], ahi[same]
        mid = (a + b) // 2
        out = [np.stack([a, mid, a, mid]), np.stack([a, mid, mid, b]), np.stack([mid, b, mid, b])]
        a1, a2, b1, b2 = alo[~same], ahi[~same], blo[~same], bhi[~same]
        wide = a2 - a1 >= b2 - b1
        mid = (a1 + a2) // 2
        out += [np.stack([a1, mid, b1, b2])[:, wide], np.stack([mid, a2, b1, b2])[:, wide]]
        mid = (b1 + b2) // 2
        out += [np.stack([a1, a2, b1, mid])[:, ~wide], np.stack([a1, a2, mid, b2])[:, ~wide]]
        pairs.append(np.concatenate(out, axis=1))
    return np.concatenate(left), np.concatenate(right)


def least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of ``n`` nodes reaches over the pairs."""
    label = np.arange(n)
    while a.size:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _join_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``mask, key, fp`` sorted by mask and key: whole groups at a time."""
    shape = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def work(part: np.ndarray) -> pa.RecordBatch | None:
        change = np.flatnonzero((part[0, 1:] != part[0, :-1]) | (part[1, 1:] != part[1, :-1])) + 1
        lo, hi = np.concatenate([[0], change]), np.concatenate([change, [part.shape[1]]])
        own = hi - lo > 1
        keep = np.repeat(own, hi - lo)
        values, group = part[2, keep].view(np.uint64), np.repeat(np.arange(own.sum()), (hi - lo)[own])
        order = np.lexsort((gray_rank(values), group))
        values = np.ascontiguousarray(values[order])
        size = (hi - lo)[own]
        ends = np.cumsum(size)
        a, b = linked_pairs(values, ends - size, ends)
        root = least_linked(values.size, a, b)
        on = root != np.arange(values.size)
        if on.any():
            return pa.RecordBatch.from_arrays([pa.array(values[on].view(np.int64)), pa.array(values[root[on]].view(np.int64))], schema=shape)

    held: list[np.ndarray] = []
    count = 0
    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("mask", "key", "fp")]))
        count += batch.num_rows
        if count < 500_000:
            continue
        part = np.concatenate(held, axis=1)
        change = np.flatnonzero((part[0, 1:] != part[0, :-1]) | (part[1, 1:] != part[1, :-1]))
        if change.size:
            cut = int(change[-1]) + 1
            if (out := work(part[:, :cut])) is not None:
                yield out
            part = part[:, cut:]
        held, count = [part], part.shape[1]
    if count:
        if (out := work(np.concatenate(held, axis=1))) is not None:
            yield out


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links ``u, v`` that connect exactly what ``fp`` values within the distance connect."""
    masks = F.array(*[F.struct(F.lit(i).alias("mask"), F.lit(m).cast("long").alias("bits")) for i, m in enumerate(MASKS)])
    rows = distinct.select("fp", F.explode(masks).alias("m")).select(F.col("m.mask").alias("mask"), F.col("fp").bitwiseAND(F.col("m.bits")).alias("key"), "fp")
    return rows.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_join_groups, "u long, v long").distinct()


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs(doc_id, text)``."""
    marked = checkpointed(fingerprints(docs))
    distinct = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(fingerprint_links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(ids, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is the least of its component, all columns kept.

    ``doc_id`` identifies a document: rows that repeat one stay or go together; rows without one stay.
    """
    gone = near_duplicate_classes(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(classes: DataFrame) -> DataFrame:
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
