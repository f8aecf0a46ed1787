"""Line deduplication with a segment-partition edit join.

A line takes part if it has ``least`` code points or more.  It is removed when an earlier line (smaller ``doc_id``,
or earlier in the same document) is equal to it or within ``edits`` insertions, deletions and substitutions of it;
lines are judged on the input, not on what is left.

Distinct lines are split into ``edits + 1`` segments: a line within ``edits`` edits keeps one segment whole, at a
place that the edits before and after it can have moved only so far.  Each line therefore goes under a key for
each own segment, and for each substring where a shorter or equally long line's segment could stand (length-aware,
only starts that leave enough edits for both sides).  Lines that meet under a key, one of them by its own segment, are
compared: lengths and a parity sketch of their characters first (an edit flips two bits of it at most), then the edit
distance by a banded bit-parallel recurrence on what is left between their common ends.  A line stops at its first
earlier partner.

Distinct lines are handled by the chunk that holds their first occurrence (see ``chunks``).  An exchange of packed key
names counts how many lines own a key and how many hold it; a key that has no owner, or one line alone, drops out.
Lines that hold a key with more than HOT pairs (a template, or boilerplate) go under rarer segments instead: of a
line's substrings of q code points, the ``q * edits + 1`` that are rarest among such lines.  The edits can't touch all of
them, so that two lines within the edits share one, at nearly the same place (GRAMS has q, tried one after another).
Frequencies come from a table of counts of fixed size; they decide how many candidates there are, never which lines
go.  What is still hot after that, where lines differ in a few places only, is dealt over pairs of blocks, so that every
two lines still meet but no task gets all of them.  Texts travel only for lines that have a possible partner.

Edge cases: null text is kept as it is and has no lines; documents without an id keep all their lines; rows that
repeat a ``doc_id`` and text are one document (all keep the first occurrence); a document that loses every line
keeps an empty text; an empty table gives no rows; columns other than ``text`` are passed on as they are, whatever
their type.  Equal lines are told by 128 bits of hash; near ones are compared themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .chunks import NO_ID, Answers, Names, Rounds, Texts, as_table, packed, unpacked
from .common import stored

EDITS, LEAST = 2, 24
#: Lines are spread out as 64-bit codes, so that chunks are smaller here.
CHUNK_BYTES = 4 << 20
#: Pairs under one key above which its lines go under rarer segments; lines in a block of what stays hot.
HOT, BLOCK = 1 << 18, 4096
#: Lengths of the rarer segments, in the order in which they are tried; bits of a cell in the table of their counts.
GRAMS, CELL_BITS = (4, 2), 18
#: Pairs that are compared side by side; code points that are spread out at a time.
PAIRS, PLACES = 1 << 20, 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


def within(a: str, b: str, most: int) -> bool:
    """Whether two texts are within ``most`` edits: common ends off, then bit-parallel columns in a band."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return False
    lo, hi = 0, len(a)
    while lo < hi:  # common start
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    a, b = a[lo:], b[lo:]
    lo, hi = 0, len(a)
    while lo < hi:  # common end
        mid = (lo + hi + 1) // 2
        if a[len(a) - mid : len(a) - lo] == b[len(b) - mid : len(b) - lo]:
            lo = mid
        else:
            hi = mid - 1
    a, b = a[: len(a) - lo], b[: len(b) - lo]
    if not a:
        return len(b) <= most
    # Bit d of row[e] after j characters of b: the first j - most + d characters of a are within e edits of them.
    mask = (1 << (2 * most + 1)) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << (i + most)
    row = [((2 << e) - 1) << most & mask for e in range(most + 1)]
    for j, c in enumerate(b):
        same = places.get(c, 0) >> j & mask
        before, made = 0, 0  # one edit fewer: before and after this character
        for e in range(most + 1):
            held = row[e]
            row[e] = (held & same | before | before >> 1 | made << 1) & mask
            before, made = held, row[e]
        if not row[most]:
            return False
    return bool(row[most] >> (len(a) - len(b) + most) & 1)


def _power(n: int, held: list = []) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006  (kept between calls)
    """Powers of the hash base and of its inverse, modulo 2**64."""
    if not held or len(held[0]) <= n:
        held.clear()
        for x in (_BASE, _BACK):
            powers = np.full(n + 1, x, np.uint64)
            powers[0] = 1
            held.append(powers.cumprod(dtype=np.uint64))
    return held[0][: n + 1], held[1][: n + 1]


class Lines:
    """The distinct lines of a chunk that take part, with their first occurrence in it and their keys."""

    def __init__(self, blob: bytes, least: int):
        self.texts = Texts(blob)
        first: dict[str, tuple[int, int]] = {}
        self.documents: list[list[str] | None] = []
        for i, text in zip(self.texts.ids.tolist(), self.texts.texts(), strict=True):
            lines = None if text is None else text.decode("utf-8", "replace").split("\n")
            self.documents.append(lines)
            for n, line in enumerate(lines or ()) if i != NO_ID else ():
                if len(line) >= least:
                    first.setdefault(line, (i, n))
        self.lines = list(first)
        self.ids, self.numbers = np.array([x[0] for x in first.values()], "<i8"), np.array([x[1] for x in first.values()], "<i4")
        self.size = np.array([len(x) for x in self.lines], np.int64)
        raw = [xxhash.xxh3_128_intdigest(x.encode("utf-8", "surrogatepass"), 42) for x in self.lines]
        self.hash, self.other = np.array([x >> 64 for x in raw], np.uint64), np.array([x & (1 << 64) - 1 for x in raw], np.uint64)

    def only(self, own: np.ndarray) -> None:
        """Make ready the keys of some of the lines."""
        self.own = own
        lines = [self.lines[i] for i in own.tolist()]
        self.own_size = self.size[own]
        self.end = np.cumsum(self.own_size)
        self.begin = self.end - self.own_size
        n = int(self.end[-1]) if len(own) else 0
        power, self.back = _power(n)
        self.sums, self.sketch = np.zeros(n + 1, np.uint64), np.zeros(len(own), np.uint64)
        at = 0
        while at < len(own):  # some lines at a time: codes take eight bytes each
            to = max(at + 1, int(np.searchsorted(self.end, self.begin[at] + PLACES, "right")))
            lo, hi = int(self.begin[at]), int(self.end[to - 1])
            code = np.frombuffer("".join(lines[at:to]).encode("utf-32-le"), "<u4").astype(np.uint64)
            part = (code + np.uint64(1)) * power[lo:hi]
            self.sums[lo + 1 : hi + 1] = np.cumsum(part, dtype=np.uint64) + self.sums[lo]
            self.sketch[at:to] = np.bitwise_xor.reduceat(np.uint64(1) << (code & np.uint64(63)), self.begin[at:to] - lo)
            at = to

    def content(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """A hash of the ``n`` code points at each place."""
        value = (self.sums[at + n] - self.sums[at]) * self.back[at]
        return (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def segments(self, edits: int) -> Entries:
        """Own segments, and substrings where a segment of a line shorter by 0..edits can stand."""
        out = []
        parts = edits + 1
        size = self.own_size
        for gap in range(parts):
            length = size - gap
            short, extra = length // parts, length % parts
            at = np.zeros_like(length)
            for k in range(parts):
                n = short + (k >= parts - extra)
                for move in range(max(-k, gap - (edits - k)), min(k, gap + (edits - k)) + 1):
                    start = at + move
                    ok = np.flatnonzero((start >= 0) & (start + n <= size) & (n > 0))
                    key = _mixed(self.content(self.begin[ok] + start[ok], n[ok]), length[ok] * parts + k)
                    out.append((key, ok, np.full(len(ok), not gap and not move)))
                at = at + n
        return Entries(out)

    def grams(self, which: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, line, place) of all substrings of ``q`` code points of some lines."""
        n = self.own_size[which] - q + 1
        line = np.repeat(which, n)
        place = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
        return self.content(self.begin[line] + place, q), line, place

    def rarest(self, which: np.ndarray, q: int, edits: int, counts: np.ndarray) -> Entries:
        """The rarest substrings of some lines, by length and place."""
        gram, line, place = self.grams(which, q)
        order = np.lexsort((gram, counts[_cell(gram)], line))
        gram, line, place = gram[order], line[order], place[order]
        start = np.searchsorted(line, line, "left")
        last = gram[np.minimum(start + q * edits, np.searchsorted(line, line, "right") - 1)]
        on = (np.arange(len(line)) - start <= q * edits) | (gram == last)  # equal ones go together
        gram, line, place = gram[on], line[on], place[on]
        width = 4 * edits + 1
        key = lambda gap, at: _mixed(gram, ((self.own_size[line] - gap) * 31 + q) * (1 << 32) + at // width)
        out = [(key(0, place), line, np.ones(len(line), bool))]
        for gap in range(edits + 1):
            out += [(key(gap, place + move), line, np.zeros(len(line), bool)) for move in (-edits, edits)]
        return Entries(out)


def _mixed(key: np.ndarray, more: np.ndarray) -> np.ndarray:
    key = (key ^ (key >> np.uint64(32))) * np.uint64(_BASE) + more.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    return (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _cell(gram: np.ndarray) -> np.ndarray:
    return (gram >> np.uint64(64 - CELL_BITS)).astype(np.int64)


class Entries:
    """(key, line, whether the line owns the key: its segment stands where it does in the line itself), each line once a key."""

    def __init__(self, groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        key, line, own = (np.concatenate(x) for x in zip(*groups, strict=True))
        order = np.lexsort((~own, line, key))
        key, line = key[order], line[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
        self.key, self.line, self.own = key[new], line[new], own[order][new]


def _groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], rows: int) -> Iterator[pa.Table]:
    """Whole groups of rows sorted by ``columns``, many small groups or one large one at a time."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        part = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(part.num_rows - 1, bool)
        for c in columns:
            x = part.column(c).to_numpy()
            change |= x[1:] != x[:-1]
        cuts = np.flatnonzero(change)
        if cuts.size:
            cut = int(cuts[-1]) + 1
            yield part.slice(0, cut)
            part = part.slice(cut)
        held, count = part.to_batches(), part.num_rows
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


class Work:
    """A chunk's lines together with the answers so far."""

    def __init__(self, blob: bytes, answers: Answers, edits: int, least: int, buckets: int):
        self.all, self.answers, self.edits, self.buckets = Lines(blob, least), answers, edits, buckets

    def elsewhere(self) -> np.ndarray:
        """Lines whose first occurrence is in another chunk."""
        names = Names(self.all.hash, self.buckets, first=True)
        return names.answered(self.answers.get("lines", {}))[0][names.of]

    def levels(self, tables: list[np.ndarray]) -> Iterator[tuple[Entries, np.ndarray, np.ndarray, np.ndarray]]:
        """(entries, numbers of hot ones, of rare ones that can meet, lines under each entry's key), level by level."""
        self.all.only(np.flatnonzero(~self.elsewhere()))
        entries = self.all.segments(self.edits)
        for level in range(len(tables) + 1):
            if level:
                entries = self.all.rarest(np.unique(entries.line[hot]), GRAMS[level - 1], self.edits, tables[level - 1])  # noqa: F821
            names = Names(entries.key, self.buckets, first=True)
            on, owners, holders = (x[names.of] for x in names.answered(self.answers.get(f"keys{level}", {}), "<i8", "<i8"))
            many = owners * holders > HOT
            hot = np.flatnonzero(on & many)
            yield entries, hot, np.flatnonzero(on & ~many), holders

    def meeting(self, tables: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        """(key, block, index in ``own``, whether it owns the key) of the entries that can meet others."""
        for level, (entries, hot, rare, holders) in enumerate(self.levels(tables)):
            yield entries.key[rare], np.zeros(len(rare), np.int64), entries.line[rare], entries.own[rare]
        if level == len(GRAMS):
            key, line, own, blocks = entries.key[hot], entries.line[hot], entries.own[hot], -(-holders[hot] // BLOCK)
            mine = (self.all.hash[self.all.own[line]] % blocks.astype(np.uint64)).astype(np.int64)
            at = np.repeat(np.arange(len(key)), blocks)
            other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            yield key[at], np.minimum(mine[at], other) * blocks[at] + np.maximum(mine[at], other), line[at], own[at]

    def near(self) -> np.ndarray:
        out = np.zeros(len(self.all.lines), bool)
        for (line,) in self.answers.get("near", {}).values():
            out[line] = True
        return out


def _earlier(owner: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    name, other, i, n = columns
    order = np.lexsort((n, i, other, name))
    new = np.ones(len(name), bool)
    new[1:] = (name[order][1:] != name[order][:-1]) | (other[order][1:] != other[order][:-1])
    first = order[new][np.cumsum(new) - 1]
    flag = np.empty(len(name), bool)
    flag[order] = (i[order] != i[first]) | (n[order] != n[first])
    return flag, []


def _held(owner: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys under which lines can meet: one owns it and another holds it; how many own and hold it."""
    _, group = np.unique(columns[0], return_inverse=True)
    owners, holders = (np.bincount(group, x).astype(np.int64)[group] for x in columns[1:])
    return (owners > 0) & (holders > 1), [owners, holders]


def _like(size_a: np.ndarray, sketch_a: np.ndarray, size_b: np.ndarray, sketch_b: np.ndarray, edits: int) -> np.ndarray:
    return (np.bitwise_count(sketch_a ^ sketch_b) <= 2 * edits) & (np.abs(size_a - size_b) <= edits)


def _possible(edits: int):
    """Lines that meet another line of like length and sketch under a key; groups are sorted owners first."""
    shape = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("chunk", pa.int64()), ("line", pa.int32()), ("own", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, ("key", "block"), 400_000):
            key, block, chunk, line, size, sketch, other = (part.column(c).to_numpy() for c in ("key", "block", "chunk", "line", "size", "sketch", "other"))
            sketch = sketch.view(np.uint64)
            start = np.ones(len(key), bool)
            start[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
            stop = np.append(np.flatnonzero(start)[1:], len(key))[np.cumsum(start) - 1]
            owner = np.flatnonzero(other == 0)
            behind = stop[owner] - owner - 1  # an owner meets all rows after it in its group
            on = np.zeros(len(key), bool)
            ends = np.cumsum(behind)
            lo = 0
            while lo < len(owner):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
                for a in range(0, int(behind[lo]) if hi == lo + 1 else 1, PAIRS):
                    n = np.minimum(behind[lo:hi] - a, PAIRS if hi == lo + 1 else 1 << 62)
                    first = np.repeat(owner[lo:hi], n)
                    second = first + a + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
                    like = _like(size[first], sketch[first], size[second], sketch[second], edits)
                    like &= (chunk[first] != chunk[second]) | (line[first] != line[second])
                    on[first[like]] = on[second[like]] = True
                lo = hi
            if on.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[on], type=f.type) for x, f in zip((key, block, chunk, line, 1 - other), shape, strict=True)],
                    schema=shape,
                )

    return run


def _confirmed(edits: int):
    """Lines of a group (sorted by first place) with an earlier line within the edits; one of the two owns the key."""
    shape = pa.schema([("chunk", pa.int64()), ("line", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, ("key", "block"), 20_000):
            key, block, chunk, line, size, sketch, owns = (part.column(c).to_numpy() for c in ("key", "block", "chunk", "line", "size", "sketch", "own"))
            sketch, text = sketch.view(np.uint64), part.column("text").combine_chunks()
            start = np.ones(len(key), bool)
            start[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
            lo, hi = np.flatnonzero(start), np.append(np.flatnonzero(start)[1:], len(key))
            found = []
            for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                lines = text.slice(a, b - a).to_pylist()
                for i in range(1, b - a):
                    like = _like(size[a : a + i], sketch[a : a + i], size[a + i], sketch[a + i], edits)
                    if not owns[a + i]:
                        like &= owns[a : a + i] > 0
                    if any(lines[k] != lines[i] and within(lines[k], lines[i], edits) for k in np.flatnonzero(like).tolist()):
                        found.append(a + i)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(chunk[found], type=pa.int64()), pa.array(line[found], type=pa.int32())], schema=shape)

    return run


def _by_chunk(rows: DataFrame, kind: str, *columns: str) -> DataFrame:
    """Rows as one answer to each chunk (it has no more of them than keys of its lines)."""

    shape = to_arrow_schema(T.StructType.fromDDL(Rounds.ANSWER))

    def run(own: pa.Table) -> pa.Table:
        return as_table([(own.column("chunk")[0].as_py(), 0, kind, packed(*[own.column(c).to_numpy() for c in columns]))], shape)

    return rows.groupBy("chunk").applyInArrow(run, Rounds.ANSWER)


def _judged(rounds: Rounds, edits: int, least: int):
    """Ask all rounds; what is left is a function of a chunk, its rows' removed line numbers and the text that stays."""
    buckets = rounds.buckets

    def lines(chunk: int, blob: bytes, answers: Answers) -> Iterator[tuple]:
        own = Lines(blob, least)
        names = Names(own.hash, buckets, first=True)
        return names.parts(chunk, names.name, own.other[names.first], own.ids[names.first], own.numbers[names.first])

    def keys(tables: list[np.ndarray]):
        def send(chunk: int, blob: bytes, answers: Answers) -> Iterator[tuple]:
            *_, (entries, _, _, _) = Work(blob, answers, edits, least, buckets).levels(tables)
            names = Names(entries.key, buckets, first=True)
            n = len(names.name)
            return names.short_parts(chunk, np.bincount(names.of[entries.own], minlength=n).astype("<u4"), np.bincount(names.of, minlength=n).astype("<u4"))

        return send

    def counts(tables: list[np.ndarray], q: int):
        def send(chunk: int, blob: bytes, answers: Answers) -> Iterator[tuple]:
            work = Work(blob, answers, edits, least, buckets)
            *_, (entries, hot, _, _) = work.levels(tables)
            cell, n = np.unique(_cell(work.all.grams(np.unique(entries.line[hot]), q)[0]), return_counts=True)
            return zip(cell.tolist(), n.tolist(), strict=True)

        return send

    def sketches(tables: list[np.ndarray]):
        def send(chunk: int, blob: bytes, answers: Answers) -> Iterator[tuple]:
            work = Work(blob, answers, edits, least, buckets)
            for key, block, line, owns in work.meeting(tables):
                own = work.all
                yield from zip(
                    key.view(np.int64).tolist(),
                    block.tolist(),
                    [chunk] * len(key),
                    own.own[line].tolist(),
                    own.own_size[line].tolist(),
                    own.sketch[line].view(np.int64).tolist(),
                    (~owns).astype(np.int32).tolist(),
                    strict=True,
                )

        return send

    def texts(chunk: int, blob: bytes, answers: Answers) -> Iterator[tuple]:
        if "possible" in answers:
            own = Lines(blob, least)
            wanted = answers["possible"][0]
            mine, at = np.unique(wanted[2], return_inverse=True)
            own.only(mine)
            for key, block, owns, k in zip(wanted[0].tolist(), wanted[1].tolist(), wanted[3].tolist(), at.tolist(), strict=True):
                line = int(mine[k])
                yield key, block, chunk, line, int(own.ids[line]), int(own.numbers[line]), int(own.own_size[k]), int(own.sketch[k : k + 1].view(np.int64)[0]), owns, own.lines[line]

    rounds.ask("lines", lines, _earlier)
    tables: list[np.ndarray] = []
    rounds.ask("keys0", keys(tables), _held, short=True)
    for level, q in enumerate(GRAMS):
        if not rounds.answers.filter(F.col("kind") == f"keys{level}").mapInArrow(_any_hot, "hot boolean").head(1):
            break
        counted = rounds.rows(counts(tables, q), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # 2**CELL_BITS rows at most
        table = np.zeros(1 << CELL_BITS, np.int64)
        table[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
        tables.append(table)
        rounds.ask(f"keys{level + 1}", keys(tables), _held, short=True)
    met = rounds.rows(sketches(tables), "key long, block long, chunk long, line int, size int, sketch long, other int")
    possible = met.repartition("key", "block").sortWithinPartitions("key", "block", "other").mapInArrow(
        _possible(edits),
        "key long, block long, chunk long, line int, own int",
    )
    rounds.add(_by_chunk(possible, "possible", "key", "block", "line", "own"))
    told = rounds.rows(texts, "key long, block long, chunk long, line int, doc_id long, number int, size int, sketch long, own int, text string")
    near = told.repartition("key", "block").sortWithinPartitions("key", "block", "doc_id", "number").mapInArrow(_confirmed(edits), "chunk long, line int").distinct()
    rounds.add(_by_chunk(near, "near", "line"))

    def judge(blob: bytes, answers: Answers) -> tuple[Lines, Iterator[tuple[list[int], str | None]]]:
        work = Work(blob, answers, edits, least, buckets)
        own, elsewhere, near = work.all, work.elsewhere(), work.near()
        index = {x: k for k, x in enumerate(own.lines)}

        def rows() -> Iterator[tuple[list[int], str | None]]:
            for i, doc in zip(own.texts.ids.tolist(), own.documents, strict=True):
                gone = []
                for n, line in enumerate(doc or ()) if i != NO_ID else ():
                    if (k := index.get(line)) is not None and (elsewhere[k] or near[k] or own.ids[k] != i or own.numbers[k] != n):
                        gone.append(n)
                left = set(gone)
                yield gone, None if doc is None else "\n".join(x for n, x in enumerate(doc) if n not in left)

        return own, rows()

    return judge


def _any_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each answer that names a hot key."""
    for batch in batches:
        hot = [True for x in batch.column("payload").to_pylist() if (lambda c: (c[1] * c[2] > HOT).any())(unpacked(x))]
        yield pa.RecordBatch.from_arrays([pa.array(hot, type=pa.bool_())], names=["hot"])


def _checked(edits: int, least: int) -> None:
    if edits < 1 or least < max(GRAMS) * (edits + 1):
        raise ValueError(f"lines of {max(GRAMS) * (edits + 1)} code points or more can be compared within {edits} edits")


def without_repeated_lines(docs: DataFrame, *, edits: int = EDITS, least: int = LEAST, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` with the removed lines taken out of ``text``; all columns and rows are kept."""
    _checked(edits, least)
    others = [i for i, c in enumerate(docs.columns) if c != "text"]
    with Rounds(docs, chunk_bytes=chunk_bytes, keep=True) as rounds:
        judge = _judged(rounds, edits, least)

        shape = T.StructType([T.StructField("text", T.StringType()) if f.name == "text" else f for f in docs.schema])
        arrow = to_arrow_schema(shape)

        def report(chunk: int, blob: bytes, answers: Answers) -> pa.Table:
            own, rows = judge(blob, answers)
            texts = pa.array([text for _, text in rows], pa.string())
            rest = own.texts.rest() if others else None
            columns = [texts if f.name == "text" else rest.column(rest.schema.names.index(f"c{i}")) for i, f in enumerate(arrow)]
            return pa.Table.from_arrays([x.cast(f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

        return stored(rounds.rows(report, shape))


def digest(docs: DataFrame, *, edits: int = EDITS, least: int = LEAST, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_sha256`` for every row of ``docs``."""
    _checked(edits, least)
    with Rounds(docs, chunk_bytes=chunk_bytes) as rounds:
        judge = _judged(rounds, edits, least)

        def report(chunk: int, blob: bytes, answers: Answers) -> Iterator[tuple]:
            own, rows = judge(blob, answers)
            for i, doc, (gone, text) in zip(own.texts.ids.tolist(), own.documents, rows, strict=True):
                yield i, len(doc or ()), len(gone), text

        done = stored(rounds.rows(report, "doc_id long, n_lines long, n_removed long, text string").select(
            F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"),
            "n_lines",
            "n_removed",
            F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
        ))
    return done
