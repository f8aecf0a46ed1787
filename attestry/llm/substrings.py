"""Exact substring deduplication by a difference-cover suffix sort that stops at the needed depth.

A byte is removed when a string of ``length`` bytes that covers it also starts earlier: in a document with a smaller
``doc_id``, or earlier in the same document.  Only the first ``length`` bytes of suffixes matter, so that suffixes are
ranked to that depth and no deeper:

1.  *Sampled tuples.*  Places p of each document with p mod v in a difference cover D are sampled: any two places have
    a common shift below v that brings both into the sample, so that two equal strings always hold two sampled places
    with equal tuples of ``length - v`` bytes.  Buckets sort the tuples; those that are unique drop out, the others
    are named by their rank.
2.  *Recursion on names.*  A sampled place and the one v behind it, as a pair of names, reach the full depth.  Buckets
    sort the pairs in order of (name, document, place); a place's predecessor in that order is its source.  Samples
    with one source document and one offset, no further apart than ``length``, settle all suffixes between them.
3.  *Remaining suffixes.*  Suffixes in reach of a shared sample that step 2 has not settled are merged in: named to the
    full depth, sorted in buckets in two rounds (the first drops what is unique), and given their predecessors.
4.  *Adjacent prefixes.*  Each place is compared with its predecessor, byte by byte, over the whole depth: a chunk asks
    the predecessor's chunk for these bytes.  A chunk that holds a string often asks once, and each predecessor serves
    one successor, so that no popular string has a popular chunk.

Order inside a step is that of 64-bit hashes and not of the bytes: ranks serve here to bring equal prefixes side by
side, and any total order does so.  Nothing is taken from a hash without step 4.  Where step 4 finds two strings that
differ under one name, the earliest places of these strings are found by the strings themselves (``_by_strings``), so
that results are exact for any hash.  The order that matters, that of documents and places, is exact.

Edge cases: null and empty texts have no bytes; texts shorter than ``length`` keep everything; documents without an
id come first; rows that repeat a ``doc_id`` are ordered by where they are read and judged as documents of their
own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .chunks import CHUNK_BYTES, NO_ID, Answers, Names, Rounds, Texts, as_table, packed, shared_names
from .common import stored

LENGTH = 100
#: Difference covers: every difference modulo v is one of two members.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 6, 8, 18), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
#: Strings in doubt that one pass over the texts looks for.
DOUBTS_A_PASS = 1_000_000
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_LOCAL = np.uint64(1 << 63)
_NEVER = 1 << 64
_STEP = 1 << 18


def _union(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """True at the places below n that lie in one of the ranges."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    return np.cumsum(edge[:n], dtype=np.int32) > 0


def _runs(mask: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the mask inside documents, which begin at ``begins``."""
    new, last = np.ones(len(mask), bool), np.ones(len(mask), bool)
    new[1:] = ~mask[:-1]
    last[:-1] = ~mask[1:]
    new[begins] = True
    last[begins[begins > 0] - 1] = True
    return np.flatnonzero(mask & new), np.flatnonzero(mask & last) + 1


def _places(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges that begin at ``lo``, one after another."""
    lo, size = lo.astype(np.int64), size.astype(np.int64)
    return np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())


class Layout:
    """Where the documents of a chunk lie; a place is an index into the chunk's bytes."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, length: int):
        self.ids, self.sizes, self.length = ids, sizes, length
        self.end = np.cumsum(sizes)
        self.begin = self.end - sizes
        self.n = int(self.end[-1]) if len(ids) else 0
        self.v = max(v for v in COVERS if v <= length // 2)
        self.width = length - self.v
        #: rows of one id, numbered; a document's key is (id, chunk, number)
        new = np.ones(len(ids), bool)
        new[1:] = ids[1:] != ids[:-1]
        self.number = (np.arange(len(ids)) - np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))).astype("<i4")

    def doc(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, places, "right")

    def starts(self, places: np.ndarray) -> np.ndarray:
        """Which places have room for a whole string."""
        return places + self.length <= self.end[self.doc(places)] if len(places) else np.zeros(0, bool)

    def key(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, number, offset) of places."""
        d = self.doc(places)
        return self.ids[d], self.number[d], (places - self.begin[d]).astype("<u4")

    def find(self, ids: np.ndarray, number: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places of such keys."""
        return self.begin[np.searchsorted(self.ids, ids, "left") + number] + at

    def samples(self) -> np.ndarray:
        """Sampled places with room for a tuple, in documents with room for a string."""
        cover = np.array(COVERS[self.v])
        out = []
        for b, size in zip(self.begin.tolist(), self.sizes.tolist(), strict=True):
            if size >= self.length:
                p = (np.arange(0, size - self.width + 1, self.v)[:, None] + cover).ravel()
                out.append(b + p[p <= size - self.width])
        return np.concatenate(out) if out else np.empty(0, np.int64)


class Chunk(Layout):
    """Some documents, by id, as one run of bytes."""

    def __init__(self, blob: bytes, length: int, bits: int = 64):
        texts = Texts(blob)
        super().__init__(texts.ids, texts.sizes, length)
        self.data = np.frombuffer(texts.data + bytes(16), np.uint8)
        self.eight = np.ndarray((self.n + 8,), "<u8", self.data, strides=(1,))
        self.mask = np.uint64((1 << 64) - (1 << (64 - bits)))

    def names(self, places: np.ndarray, width: int) -> np.ndarray:
        """A hash of the ``width`` bytes (8 or more) at each place; of ``bits`` leading bits."""
        out = np.empty(len(places), np.uint64)
        for a in range(0, len(places), _STEP):
            p = places[a : a + _STEP]
            h = np.full(len(p), np.uint64(width))
            for at in (*range(0, width - 8, 8), width - 8):
                h ^= self.eight[p + at]
                h *= _C1
                h ^= h >> np.uint64(29)
            out[a : a + _STEP] = h * _C2
        return out & self.mask


def _members(names: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Index of each name in the sorted ``among``, or -1."""
    out = np.full(len(names), -1)
    if len(among):
        seen = np.zeros(1 << 22, bool)
        seen[among >> np.uint64(42)] = True
        on = np.flatnonzero(seen[names >> np.uint64(42)])
        at = np.minimum(np.searchsorted(among, names[on]), len(among) - 1)
        hit = among[at] == names[on]
        out[on[hit]] = at[hit]
    return out


def _joined(layout: Layout, chunk: int, places: np.ndarray, sources: tuple) -> tuple[np.ndarray, ...]:
    """Repeated places and their sources (chunk, id, number, offset) as runs: first and last place, and the first's source."""
    s_chunk, s_id, s_number, s_at = sources
    d = layout.doc(places)
    key = [s_at - (places - layout.begin[d]), s_number, s_id, s_chunk, d]
    order = np.lexsort((places, *key))
    p = places[order]
    new = np.ones(len(p), bool)
    if len(p):
        new[1:] = p[1:] - p[:-1] > layout.length
        for x in key:
            x = x[order]
            new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(p)) - 1
    own = order[at]
    return p[at].astype("<u4"), p[last].astype("<u4") if len(p) else p.astype("<u4"), s_chunk[own], s_id[own], s_number[own].astype("<i4"), s_at[own]


def _sources(layout: Layout, chunk: int, places: np.ndarray, names: np.ndarray, asked: np.ndarray, answers: dict, buckets: int) -> tuple[np.ndarray, ...]:
    """Runs of the places that have a predecessor: in this chunk, or for a name's first place in it the one that its bucket named."""
    out = []
    for mine, got in ((places[asked], Names(names[asked], buckets, first=True)), (places[~asked], Names(names[~asked], buckets, first=True))):
        first = mine[got.first]
        flag, *far = got.answered(answers if not out else {}, "<i8", "<i8", "<i4", "<i8")
        where = first[got.of]
        s_id, s_number, s_at = layout.key(where)
        source = [np.full(len(mine), chunk), s_id.copy(), s_number.copy(), s_at.astype("<i8")]
        away = flag[got.of] & (mine == where)
        for to, x in zip(source, far, strict=True):
            to[away] = x[got.of[away]]
        on = away | (mine != where)
        out.append((mine[on], *[x[on] for x in source]))
    p, *source = [np.concatenate(x) for x in zip(*out, strict=True)]
    return _joined(layout, chunk, p, tuple(source))


def _predecessors(owner: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Names that an earlier document of another chunk has, and the place just before in the order."""
    name, ids, number, at = columns
    order = np.lexsort((owner, ids, name))
    flag, before = np.zeros(len(order), bool), np.zeros(len(order), np.int64)
    flag[order[1:]] = name[order[1:]] == name[order[:-1]]
    before[order[1:]] = order[:-1]
    return flag, [owner[before], ids[before], number[before], at[before].astype("<i8")]


class Search:
    """The rounds over one table."""

    def __init__(self, rounds: Rounds, length: int, bits: int):
        self.rounds, self.length, self.bits, self.buckets = rounds, length, bits, rounds.buckets

    def run(self) -> DataFrame:
        r = self.rounds
        length, bits, buckets = self.length, self.bits, self.buckets

        def tuples(blob: bytes) -> tuple[Chunk, np.ndarray, np.ndarray]:
            c = Chunk(blob, length, bits)
            places = c.samples()
            return c, places, c.names(places, c.width)

        def send_tuples(chunk: int, blob: bytes, answers: Answers) -> Iterator[tuple]:
            return Names(tuples(blob)[2], buckets).short_parts(chunk)

        def named(chunk: int, blob: bytes, answers: Answers) -> tuple[np.ndarray, ...]:
            """Shared samples and their tuples' names: (bucket, rank), or a mark of their own where only this chunk has them."""
            c, places, names = tuples(blob)
            distinct = Names(names, buckets)
            shared, rank = distinct.answered(answers.get("tuples", {}), "<u4")
            keep = shared | distinct.many
            name = np.where(
                shared,
                distinct.bucket().astype(np.uint64) << np.uint64(32) | rank.astype(np.uint64),
                _LOCAL | np.arange(len(rank)).astype(np.uint64),
            )[keep]
            at = _members(names, distinct.name[keep])
            on = np.flatnonzero(at >= 0)
            return c.ids, c.sizes, places[on].astype("<u4"), name[at[on]]

        def pairs(state: list[np.ndarray]) -> tuple[Layout, np.ndarray, np.ndarray, np.ndarray]:
            """(layout, places, names of their pairs, whether another chunk may have the pair)."""
            ids, sizes, places, name = state
            layout, places = Layout(ids, sizes, length), places.astype(np.int64)
            at = np.minimum(np.searchsorted(places, places + layout.v), max(0, len(places) - 1))
            on = np.flatnonzero((places[at] == places + layout.v) & layout.starts(places)) if len(places) else at
            a, b = name[on], name[at[on]]
            mixed = (a * _C1 ^ (a >> np.uint64(32))) * _C2 + b * np.uint64(0x94D049BB133111EB)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * _C1
            return layout, places[on], mixed, ((a | b) & _LOCAL) == 0

        def send_first(layout: Layout, chunk: int, places: np.ndarray, names: np.ndarray) -> Iterator[tuple]:
            distinct = Names(names, buckets, first=True)
            return distinct.parts(chunk, distinct.name, *layout.key(places[distinct.first]))

        def send_pairs(chunk: int, blob: None, answers: Answers) -> Iterator[tuple]:
            layout, places, names, asked = pairs(answers["state"][0])
            return send_first(layout, chunk, places[asked], names[asked])

        def settled(chunk: int, blob: None, answers: Answers) -> tuple[np.ndarray, ...]:
            """Runs of repeated places between samples, and the ranges of the remaining suffixes."""
            layout, places, names, asked = pairs(answers["state"][0])
            runs = _sources(layout, chunk, places, names, asked, answers.get("pairs", {}), buckets)
            shared = answers["state"][0][2].astype(np.int64)
            if len(shared):
                mask = np.zeros(layout.n, bool)
                mask[shared] = True
                reach = 1
                while reach < layout.v:  # places before a sample, as far as v; those of another document have no room
                    step = min(reach, layout.v - reach)
                    mask[:-step] |= mask[step:]
                    reach += step
                for b, e in zip(np.maximum(layout.end - length + 1, layout.begin).tolist(), layout.end.tolist(), strict=True):
                    mask[b:e] = False
                mask &= ~_union(runs[0].astype(np.int64), runs[1].astype(np.int64) + 1, layout.n)
                lo, hi = _runs(mask, layout.begin[layout.sizes > 0])
            else:
                lo = hi = shared
            return layout.ids, layout.sizes, *runs, lo.astype("<u4"), (hi - lo).astype("<u4")

        def remaining(blob: bytes, state: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            places = _places(state[-2], state[-1])
            return places, Chunk(blob, length, bits).names(places, length)

        def send_remaining(chunk: int, blob: bytes, answers: Answers) -> Iterator[tuple]:
            return Names(remaining(blob, answers["state"][0])[1], buckets).short_parts(chunk)

        def merged(chunk: int, blob: bytes, answers: Answers) -> tuple[np.ndarray, ...]:
            """Remaining suffixes whose prefix is not unique."""
            places, names = remaining(blob, answers["state"][0])
            distinct = Names(names, buckets)
            shared = distinct.answered(answers.get("remaining", {}), "<u4")[0]
            keep = shared | distinct.many
            at = _members(names, distinct.name[keep])
            on = np.flatnonzero(at >= 0)
            return *answers["state"][0][:-2], places[on].astype("<u4"), names[on], shared[keep][at[on]].astype(np.uint8)

        def send_merged(chunk: int, blob: None, answers: Answers) -> Iterator[tuple]:
            ids, sizes, *_, places, names, asked = answers["state"][0]
            asked = asked.astype(bool)
            return send_first(Layout(ids, sizes, length), chunk, places[asked].astype(np.int64), names[asked])

        def claimed(chunk: int, blob: None, answers: Answers) -> tuple[np.ndarray, ...]:
            """All runs of places that are repeated, if their names are right."""
            ids, sizes, *runs, places, names, asked = answers["state"][0]
            layout = Layout(ids, sizes, length)
            more = _sources(layout, chunk, places.astype(np.int64), names, asked.astype(bool), answers.get("merged", {}), buckets)
            both = [np.concatenate(x) for x in zip(runs, more, strict=True)]
            order = np.lexsort((both[0], both[2]))  # by source's chunk: the order of requests
            return tuple(x[order] for x in both)

        def requests(chunk: int, blob: None, answers: Answers) -> Iterator[tuple]:
            first, last, s_chunk, s_id, s_number, s_at = answers["state"][0]
            for source in np.unique(s_chunk[s_chunk != chunk]).tolist():
                on = s_chunk == source
                yield source, chunk, "wanted", packed(s_id[on], s_number[on], s_at[on], (last[on] - first[on] + length).astype("<u4"))

        def replies(chunk: int, blob: bytes, answers: Answers) -> Iterator[tuple]:
            if wanted := answers.get("wanted"):
                c = Chunk(blob, length)
                for requester, (ids, number, at, size) in wanted.items():
                    yield requester, chunk, "bytes", packed(c.data[_places(c.find(ids, number, at), size)])

        r.ask("tuples", send_tuples, shared_names, short=True)
        r.become(named)
        r.ask("pairs", send_pairs, _predecessors, texts=False)
        r.become(settled, texts=False)
        r.ask("remaining", send_remaining, shared_names, short=True)
        r.become(merged)
        r.ask("merged", send_merged, _predecessors, texts=False)
        r.become(claimed, texts=False)
        wanted = r.rows(requests, r.ANSWER, texts=False)
        r.add(r.rows(replies, r.ANSWER, answers=wanted))
        found = r.stored(self.report())
        doubts = r.stored(found.select(F.explode("doubts").alias("string")).distinct())
        if n := doubts.count():
            self._by_strings(doubts, n)
            found = self.report()
        return stored(found.drop("doubts"))

    def report(self) -> DataFrame:
        """The result, with the strings that step 4 found under a name of another string."""
        length = self.length

        def work(chunk: int, blob: bytes, answers: Answers) -> Iterator[tuple]:
            c = Chunk(blob, length)
            gone, doubts = _compared(c, chunk, answers)
            lo, hi = _runs(gone, c.begin[c.sizes > 0])
            cut = np.searchsorted(c.doc(lo), np.arange(len(c.ids) + 1))
            for i, (b, e) in enumerate(zip(c.begin.tolist(), c.end.tolist(), strict=True)):
                spans = [(int(x), int(y)) for x, y in zip(lo[cut[i] : cut[i + 1]], hi[cut[i] : cut[i + 1]], strict=True)]
                kept = c.data[b:e][~gone[b:e]] if spans else c.data[b:e]
                yield int(c.ids[i]), e - b, e - b - len(kept), [{"start": x - b, "end": y - b} for x, y in spans], hashlib.sha256(kept.tobytes()).hexdigest(), doubts if i == 0 else []

        return self.rounds.rows(
            work,
            "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept_sha256 string, doubts array<binary>",
        )

    def _by_strings(self, doubts: DataFrame, n: int) -> None:
        """The earliest places of strings in doubt, by the strings themselves; each pass looks for a bounded part of them."""
        r, length, parts = self.rounds, self.length, -(-n // DOUBTS_A_PASS)
        earliest = None
        for k in range(parts):
            own = [bytes(x["string"]) for x in doubts.filter(F.pmod(F.xxhash64("string"), F.lit(parts)) == k).toLocalIterator()]
            held = r.spark.sparkContext.broadcast(_sorted_hashes(np.frombuffer(b"".join(own), np.uint8), length))

            def look(chunk: int, blob: bytes, answers: Answers, held=held) -> Iterator[tuple]:
                c = Chunk(blob, length)
                seen: set[bytes] = set()
                for at in _occurrences(c, held.value):
                    if (string := c.data[at : at + length].tobytes()) not in seen:
                        seen.add(string)
                        ids, number, offset = c.key(np.array([at]))
                        yield string, int(ids[0]), chunk, int(number[0]), int(offset[0])

            found = r.rows(look, "string binary, id long, chunk long, number int, at long")
            first = found.groupBy("string").agg(F.min(F.struct("id", "chunk", "number", "at")).alias("first"))
            told = r.stored(found.select("chunk", "string").join(first, "string").select(
                "chunk",
                "string",
                F.col("first.id").alias("id"),
                F.col("first.chunk").alias("source"),
                F.col("first.number").alias("number"),
                F.col("first.at").alias("at"),
            ))
            earliest = told if earliest is None else earliest.unionByName(told)

        shape = to_arrow_schema(T.StructType.fromDDL(r.ANSWER))

        def answer(own: pa.Table) -> pa.Table:
            columns = [own.column(c).to_numpy().astype("<i8") for c in ("id", "source", "number", "at")]
            strings = np.frombuffer(b"".join(own.column("string").to_pylist()), np.uint8)
            return as_table([(own.column("chunk")[0].as_py(), 0, "exact", packed(strings, *columns))], shape)

        r.add(earliest.groupBy("chunk").applyInArrow(answer, r.ANSWER))


def _sorted_hashes(strings: np.ndarray, length: int) -> np.ndarray:
    data = np.concatenate([strings, np.zeros(16, np.uint8)])
    return np.unique(_hashes(data, np.arange(len(strings) // length) * length, length))


def _occurrences(c: Chunk, hashes: np.ndarray) -> Iterator[int]:
    """Places whose string may have one of the hashes."""
    for a in range(0, c.n, _STEP):
        p = np.arange(a, min(c.n, a + _STEP))
        p = p[c.starts(p)]
        yield from p[_members(_hashes(c.data, p, c.length), hashes) >= 0].tolist()


def _hashes(data: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    eight = np.ndarray((len(data) - 8,), "<u8", data, strides=(1,))
    h = np.full(len(places), np.uint64(width + 1))
    for at in (*range(0, width - 8, 8), width - 8):
        h = (h ^ eight[places + at]) * _C2
        h ^= h >> np.uint64(30)
    return h * _C1


def _compared(c: Chunk, chunk: int, answers: Answers) -> tuple[np.ndarray, list[bytes]]:
    """(mask of removed bytes, strings in doubt): every claimed run against its source's bytes."""
    first, last, s_chunk, s_id, s_number, s_at = answers["state"][0]
    first, size = first.astype(np.int64), last.astype(np.int64) - first + c.length
    wrong: list[int] = []
    right = np.ones(len(first), bool)
    for source in np.unique(s_chunk).tolist():
        on = np.flatnonzero(s_chunk == source)
        mine = _places(first[on], size[on])
        there = c.data[_places(c.find(s_id[on], s_number[on], s_at[on]), size[on])] if source == chunk else answers["bytes"][source][0]
        differ = np.flatnonzero(c.data[mine] != there)
        if differ.size:
            end = np.cumsum(size[on])
            bad = np.unique(np.searchsorted(end, differ, "right"))
            right[on[bad]] = False
            for k in bad.tolist():  # places whose string holds a byte that differs
                at = differ[(differ >= end[k] - size[on[k]]) & (differ < end[k])] - (end[k] - size[on[k]])
                inside = _union(np.maximum(at - c.length + 1, 0), at + 1, int(size[on[k]]))[: size[on[k]] - c.length + 1]
                wrong += (first[on[k]] + np.flatnonzero(inside)).tolist()
                good = first[on[k]] + np.flatnonzero(~inside)
                first, size, right = np.concatenate([first, good]), np.concatenate([size, np.full(len(good), c.length)]), np.concatenate([right, np.ones(len(good), bool)])
    gone = _union(first[right], first[right] + size[right], c.n)
    if "exact" not in answers:
        return gone, sorted({c.data[at : at + c.length].tobytes() for at in wrong})
    flat, *key = answers["exact"][0]
    strings = flat.tobytes()
    earliest = {strings[i * c.length : (i + 1) * c.length]: k for i, k in enumerate(zip(*[x.tolist() for x in key], strict=True))}
    for at in _occurrences(c, _sorted_hashes(flat, c.length)):
        ids, number, offset = c.key(np.array([at]))
        if earliest.get(c.data[at : at + c.length].tobytes(), (_NEVER,)) < (int(ids[0]), chunk, int(number[0]), int(offset[0])):
            gone[at : at + c.length] = True
    return gone, []


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES, name_bits: int = 64) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept_sha256`` for every row; spans are byte ranges, ends exclusive.

    ``length`` is 20 at least.  ``name_bits`` is the length of names; the result is the same for any.
    """
    if length < 20:
        raise ValueError("strings of fewer than 20 bytes have no sampled names")
    with Rounds(docs, chunk_bytes=chunk_bytes) as rounds:
        found = Search(rounds, length, name_bits).run()
    return found.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
