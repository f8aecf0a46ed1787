"""Repair the structure of conversations: the cheapest edits after which roles follow ``(s?(ua)+)?``, and of these the least audit.

A conversation's rows stand in order of ``turn`` (nulls first), then role and text.  A row's first fault counts: blank (no
character but ``\\x20\\x09-\\x0D``), duplicate (its role and text stood before in the conversation), truncated (its last character
that is not blank is none of ``.!?``).  Edits, by their initials: Keep (0) needs a role whose initial fits, Rerole to user or
assistant (1), Delete (2; the only one for blank and duplicate rows) and Insert of an empty text as user or assistant, anywhere (5).
A truncated row that stays adds 5.  The audit has the edits' initials in order; of the cheapest ones the ASCII-least is taken.

Method: a node is a row's place with one of four states (nothing yet, after s, after u, after a).  A cost programme from the end gives
each node its cheapest rest; arcs that keep to it are optimal.  Nodes are ranked by their least audits of 1, 2, 4, ... letters, the rank of
twice the letters from a node's rank and that of the node its pointer leads to, and pointers double with them; the arcs of a
node bear different letters, and the least by letter and target's rank is taken.  The doubled pointers then lay out
whole paths at once.  All conversations of a task are worked on together.

Rows are dealt by ranges of (conversation, turn, role, text), so that one with any number of rows is cut into segments, of one partition
each; equal rows may part as well.  Segments of a cut conversation are first reduced to costs between their four entry
and four exit states, which a small job chains backwards; each segment then finds its least paths from each entry, and a
second small job follows the exits.  Only these few numbers of a segment meet in one task.  What must be one value for a whole
conversation (its audit, and the digest of its repaired text, which is read in order as a stream) is the size of the result itself.

Nulls: a null role or text is one space; a null turn stands first and has no part in ``gaps``; a null ``conv_id`` is a
conversation of its own.  Rows that repeat are duplicates.  A role that begins with none of s, u, a can't be kept; an empty
role has no initial.  Texts of any length are told apart by 128 bits of digest and are not shipped to Python but for their
digest.  An empty table gives no rows; ids without rows are the caller's to add.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored

#: rows of a segment, about, and bytes of text
ROWS, BYTES = 1 << 17, 64 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: state after a user or assistant row that is made there: nothing yet, after s, after u, after a
NEXT = np.array([2, 2, 3, 2])
LETTERS = b"DIKR"
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
FAR = 1 << 40
NOTHING = hashlib.sha256(b"").hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """Plant faults by crc32 of ``conv_id:turn``: of 20, 0 drops a row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it a user's."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.filter("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def placed(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with ``seq``, which grows with the order of rows; its upper bits are the segment's partition."""
    blank = F.lit(" ")
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    parts = max(1, -(-size["n"] // ROWS), -(-size["b"] // BYTES))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order, F.asc("tie"))
    return stored(dealt.sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("seq")))


def faults(rows: DataFrame) -> DataFrame:
    """What the programme needs of each row of ``placed``: ``conv_id, part, seq, turn, initial, blank, duplicate, truncated``."""
    rest = F.rtrim(F.col("text"), F.lit(BLANKS))
    key = F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    seen = rows.select("conv_id", "seq", F.shiftright("seq", 33).alias("part"), "turn", F.substring("role", 1, 1).alias("initial"), (rest == "").alias("blank"), F.right(rest, F.lit(1)).isin(*ENDS).alias("ended"), key.alias("key"))
    seen = stored(seen)
    again = seen.groupBy("conv_id", "key").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv_id").alias("of"), F.col("key").alias("what"), "first")
    both = seen.join(again, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("what")), "left")
    duplicate = ~F.col("blank") & F.coalesce(F.col("seq") > F.col("first"), F.lit(False))
    both = both.withColumn("duplicate", duplicate).withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & ~F.col("ended"))
    return stored(both.select("conv_id", "part", "seq", "turn", "initial", "blank", "duplicate", "truncated"))


class Segments:
    """Segments of conversations, rows in order: costs to the end and least paths, for all at once."""

    def __init__(self, rows: pa.Table):
        order = np.argsort(rows.column("seq").to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        self.seq = rows.column("seq").to_numpy()
        self.conv, part = rows.column("conv_id").combine_chunks(), rows.column("part").to_numpy()
        ids, null = self.conv.fill_null(0).to_numpy(zero_copy_only=False), self.conv.is_null().to_numpy(zero_copy_only=False)
        new = np.ones(len(part), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1]) | (part[1:] != part[:-1])
        self.begin = np.flatnonzero(new)
        self.size = np.diff(self.begin, append=len(part))
        self.part = part[self.begin]
        self.ids = [None if n else x for x, n in zip(ids[self.begin].tolist(), null[self.begin].tolist(), strict=True)]
        self.turn = rows.column("turn").combine_chunks()
        self.initial = np.array(rows.column("initial").to_pylist(), object)
        self.fault = {k: rows.column(k).to_numpy() for k in ("blank", "duplicate", "truncated")}
        must = self.fault["blank"] | self.fault["duplicate"]
        stay = np.where(must, FAR, self.fault["truncated"] * TRUNCATED)
        # cost of each row's Keep from each state, and where it leads
        self.keep = np.full((len(part), 4), FAR)
        for role, states in (("s", [0]), ("u", [0, 1, 3]), ("a", [2])):
            self.keep[np.ix_(self.initial == role, states)] = KEEP
        self.keep = np.minimum(self.keep + stay[:, None], FAR)
        self.kept_to = np.where((self.initial == "s")[:, None], 1, NEXT[None, :])
        self.rerole = np.minimum(REROLE + stay, FAR)

    def costs(self, end: np.ndarray) -> np.ndarray:
        """``[segment, state]`` costs behind each segment's last row to costs of all its nodes: ``[row + segment, state]``."""
        out = np.full((len(self.seq) + len(self.size), 4), FAR)
        base = self.begin + np.arange(len(self.size))
        out[base + self.size] = end
        longest = np.argsort(-self.size, kind="stable")
        ordered = self.size[longest]
        for t in range(1, int(ordered[0]) + 1 if len(ordered) else 0):  # the t-th row from the end, of all segments that have one
            own = longest[: np.searchsorted(-ordered, -t, "right")]
            row = self.begin[own] + self.size[own] - t
            node = row + own
            after = out[node + 1]
            best = np.minimum(DELETE + after, self.keep[row] + np.take_along_axis(after, self.kept_to[row], 1))
            best = np.minimum(best, self.rerole[row][:, None] + after[:, NEXT])
            out[node] = inserted(best)
        return out

    def nodes(self) -> np.ndarray:
        """The first node of each segment."""
        return (self.begin + np.arange(len(self.size))) * 4


def inserted(cost: np.ndarray) -> np.ndarray:
    """Costs of states once rows may be inserted before what follows."""
    out = np.minimum(cost, INSERT + cost[:, NEXT])
    return np.minimum(out, INSERT + out[:, NEXT])


#: costs behind a conversation's last row
CLOSED = inserted(np.array([[0, FAR, FAR, 0]]))[0]


class Paths(NamedTuple):
    letters: np.ndarray
    states: np.ndarray
    at: np.ndarray
    exits: np.ndarray


def least_paths(seg: Segments, cost: np.ndarray, last: np.ndarray, starts: np.ndarray) -> Paths:
    """The least optimal audits from the nodes ``starts``: their letters and the states before these, laid out one after the other
    from ``at``, and the states in which they end.  ``last`` marks segments behind which the conversation ends."""
    places, rows = len(cost), len(seg.seq)
    node = np.arange(places * 4)
    state, place = node % 4, node // 4
    of = np.repeat(np.arange(len(seg.size)), seg.size + 1)
    closing = np.zeros(places, bool)
    closing[seg.begin + np.arange(len(seg.size)) + seg.size] = True
    row = np.where(closing, 0, np.arange(places) - of)[place] if rows else np.zeros(places * 4, int)
    flat, closed = cost.reshape(-1), closing[place]
    more = ~closed
    # arcs in the order of LETTERS: delete, insert, keep, rerole
    to = np.stack([node + 4, node - state + NEXT[state], node - state + 4 + (seg.kept_to[row, state] if rows else 0), node - state + 4 + NEXT[state]], 1)
    to[closed] = np.where(np.arange(4)[None, :] == 1, to[closed], node[closed][:, None])
    far = np.full(len(node), FAR)
    price = np.stack([np.where(more, DELETE, far), np.where(more | last[of][place], INSERT, far), np.where(more, seg.keep[row, state], far) if rows else far, np.where(more, seg.rerole[row], far) if rows else far], 1)
    optimal = (price < FAR) & (price + flat[to] == flat[:, None])
    end = closed & ~optimal.any(1)  # also a last node that costs nothing more
    optimal[end] = False

    def chosen(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least optimal arc by its letter and its target's rank, and where it leads."""
        key = np.where(optimal, (np.arange(4)[None, :] + 1) * (len(node) + 1) + rank[to], np.iinfo(np.int64).max)
        arc = key.argmin(1)
        return np.where(end, 0, arc + 1), np.where(end, node, to[node, arc])

    letter, pointer = chosen(np.zeros(len(node), np.int64))
    rank, steps = letter.astype(np.int64), (~end).astype(np.int64)
    pointers = []
    while True:
        pointers.append(pointer)
        if end[pointer].all():
            break
        _, rank = np.unique(rank * (len(node) + 1) + rank[pointer], return_inverse=True)
        steps = steps + steps[pointer]
        pointer = pointer[pointer]
    steps = np.where(end, 0, steps)
    letter, first = chosen(rank)
    assert (first == pointers[0]).all()
    length = steps[starts]
    at = np.concatenate([[0], np.cumsum(length)])
    path = np.full(int(at[-1]), -1)
    path[at[:-1][length > 0]] = starts[length > 0]
    step = np.arange(len(path)) - np.repeat(at[:-1], length)
    whole = np.repeat(length, length)
    for k in reversed(range(len(pointers))):
        known = np.flatnonzero((step % (2 << k) == 0) & (step + (1 << k) < whole))
        path[known + (1 << k)] = pointers[k][path[known]]
    return Paths(letter[path], path % 4, at, pointers[-1][starts] % 4)


def _between(rows: pa.Table) -> pa.Table:
    """A segment's costs from each entry state to each exit state."""
    seg, cost = Segments(rows), []
    for x in range(4):
        end = np.full((1, 4), FAR)
        end[0, x] = 0
        cost.append(seg.costs(end)[0])
    return pa.table({"conv_id": pa.array(seg.ids, pa.int64()), "part": pa.array(seg.part), "costs": pa.array([np.stack(cost, 1).reshape(-1).tolist()], pa.list_(pa.int64()))})


def _chained(rows: pa.Table) -> pa.Table:
    """For each segment of a conversation the costs behind it, from the last one backwards."""
    rows = rows.sort_by("part")
    after, out = CLOSED, []
    for c in reversed(rows.column("costs").to_pylist()):
        out.append(after.tolist())
        after = (np.array(c).reshape(4, 4) + after[None, :]).min(1)
    return rows.select(["conv_id", "part"]).append_column("behind", pa.array(out[::-1], pa.list_(pa.int64())))


def _followed(rows: pa.Table) -> pa.Table:
    """Each segment's entry state, and what differs where it meets the one before: an illegal pair, a turn counted twice."""
    rows = rows.sort_by("part")
    entry, illegal, twice, now, before = [], [], [], 0, None
    for r in rows.to_pylist():
        entry.append(now)
        now = r["exits"][now]
        illegal.append(int(before is not None and before["last_initial"] + r["first_initial"] not in LEGAL))
        twice.append(int(before is not None and before["high"] is not None and before["high"] == r["low"]))
        before = r | {"high": r["high"] if r["high"] is not None else before and before["high"]}
    return pa.table({"conv_id": rows.column("conv_id"), "part": rows.column("part"), "entry": pa.array(entry, pa.int32()), "met": pa.array(illegal, pa.int64()), "twice": pa.array(twice, pa.int64())})


LEGAL = {"su", "ua", "au"}
SOLVED = (
    "conv_id long, part long, start long, cost long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long,"
    "first_initial string, last_initial string, exits array<int>, audits array<string>, made array<string>, alone boolean"
)


def _solved(rows: pa.Table, segments: pa.Table) -> pa.Table:
    """Counts and least paths of a bucket's segments; of a conversation's first one from the first state only."""
    seg = Segments(rows)
    known = {(r["conv_id"], r["part"]): r for r in segments.to_pylist()}
    own = [known[k] for k in zip(seg.ids, seg.part.tolist(), strict=True)]
    cost = seg.costs(np.array([CLOSED if r["behind"] is None else r["behind"] for r in own]).reshape(-1, 4))
    entries = [[0] if r["first"] else [0, 1, 2, 3] for r in own]
    starts = np.concatenate([n + np.array(e) for n, e in zip(seg.nodes().tolist(), entries, strict=True)]).astype(np.int64)
    paths = least_paths(seg, cost, np.array([r["last"] for r in own]), starts)
    letters = np.frombuffer(b"." + LETTERS, np.uint8)[paths.letters].tobytes().decode()
    # what a letter leaves: nothing, the row as it is, or a user's or assistant's
    made = np.where(paths.letters == 1, ord("."), np.where(paths.letters == 3, ord("k"), np.where(paths.states == 2, ord("a"), ord("u")))).astype(np.uint8).tobytes().decode()
    turn, none = seg.turn.fill_null(0).to_numpy(zero_copy_only=False), seg.turn.is_null().to_numpy(zero_copy_only=False)
    pair = np.array([False, *[x + y not in LEGAL for x, y in zip(seg.initial[:-1], seg.initial[1:], strict=True)]], bool)
    out, k = {n: [] for n in _names(SOLVED)}, 0
    for i, (b, n, r, e) in enumerate(zip(seg.begin.tolist(), seg.size.tolist(), own, entries, strict=True)):
        t = turn[b : b + n][~none[b : b + n]]
        exits, audits, texts = [-1] * 4, [""] * 4, [""] * 4
        for s in e:
            lo, hi = int(paths.at[k]), int(paths.at[k + 1])
            exits[s], audits[s], texts[s] = int(paths.exits[k]), letters[lo:hi], made[lo:hi]
            k += 1
        row = (seg.ids[i], int(seg.part[i]), int(seg.seq[b]), int(cost[b + i, 0]) if r["first"] else 0, int(t[0]) if len(t) else None, int(t[-1]) if len(t) else None)
        row += (len(np.unique(t)), *(int(seg.fault[f][b : b + n].sum()) for f in ("blank", "duplicate", "truncated")), int(pair[b + 1 : b + n].sum()))
        for name, x in zip(out, (*row, seg.initial[b], seg.initial[b + n - 1], exits, audits, texts, r["first"] and r["last"]), strict=True):
            out[name].append(x)
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_()}
    return pa.table({n: pa.array(out[n], kinds[k]) for n, k in (x.strip().split(" ") for x in SOLVED.split(","))})


def _names(schema: str) -> list[str]:
    return [x.strip().split(" ")[0] for x in schema.split(",")]


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each letter that leaves one: its place, and the row it keeps or the role of a new one."""
    for batch in batches:
        for r in batch.to_pylist():
            letters, made = np.frombuffer(r["audit"].encode(), np.uint8), np.frombuffer(r["made"].encode(), np.uint8)
            fresh = letters == ord("I")
            seq = r["start"] + np.cumsum(~fresh) - 1
            at = np.flatnonzero(made != ord("."))
            role = np.array([None, "user", "assistant"], object)[np.where(made == ord("u"), 1, np.where(made == ord("a"), 2, 0))][at]
            yield pa.RecordBatch.from_pydict({
                "conv_id": pa.array([r["conv_id"]] * len(at), pa.int64()),
                "part": pa.array([r["part"]] * len(at), pa.int64()),
                "place": pa.array(at, pa.int64()),
                "seq": pa.array(seq[at], pa.int64(), mask=fresh[at]),
                "role": pa.array(role, pa.string()),
                "edit": pa.array([chr(x) for x in letters[at]], pa.string()),
            })


class Repair(NamedTuple):
    """``report``: a row for each conversation that has rows; ``rows``: what stays or is new, in order of (conv_id, part, place)."""

    report: DataFrame
    rows: DataFrame


def repair(rows: DataFrame) -> Repair:
    """Repair ``conv_id long, turn long, role, text``."""
    spark = rows.sparkSession
    bounded_batches(spark)
    held = placed(rows)
    facts = faults(held)
    count = facts.count()
    whole = Window.partitionBy("conv_id")
    segments = facts.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    segments = stored(segments.select("conv_id", "part", (F.col("part") == F.min("part").over(whole)).alias("first"), (F.col("part") == F.max("part").over(whole)).alias("last")))
    cut = segments.filter(~(F.col("first") & F.col("last"))).select(F.col("conv_id").alias("of"), F.col("part").alias("piece"))
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("piece"))
    behind = facts.join(cut, same, "left_semi").groupBy("conv_id", "part").applyInArrow(_between, "conv_id long, part long, costs array<bigint>")
    behind = stored(behind.groupBy("conv_id").applyInArrow(_chained, "conv_id long, part long, behind array<bigint>")).select(F.col("conv_id").alias("of"), F.col("part").alias("piece"), "behind")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // ROWS))
    bucket = F.pmod(F.xxhash64("conv_id", "part"), F.lit(buckets)).alias("bucket")
    a, b = facts.withColumn("bucket", bucket), segments.join(behind, same, "left").drop("of", "piece").withColumn("bucket", bucket)
    solved = stored(a.groupBy("bucket").cogroup(b.groupBy("bucket")).applyInArrow(_solved, SOLVED))
    ways = solved.filter(~F.col("alone")).select("conv_id", "part", "exits", "low", "high", "first_initial", "last_initial")
    ways = ways.groupBy("conv_id").applyInArrow(_followed, "conv_id long, part long, entry int, met long, twice long")
    ways = ways.select(F.col("conv_id").alias("of"), F.col("part").alias("piece"), "entry", "met", "twice")
    at = F.coalesce(F.col("entry"), F.lit(0)) + 1
    chosen = solved.join(ways, same, "left").withColumn("audit", F.element_at("audits", at)).withColumn("made", F.element_at("made", at))
    chosen = stored(chosen.drop("audits", "exits", "of", "piece"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns") + zero("twice"), F.lit(0)).cast("long")
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "")
    report = chosen.groupBy("conv_id").agg(
        gaps.alias("gaps"), *[zero(c).alias(c) for c in ("blank", "duplicate", "truncated")], (zero("illegal") + zero("met")).alias("illegal"), zero("cost").alias("cost"), audit.alias("audit")
    )
    edits = chosen.select("conv_id", "part", "start", "audit", "made").mapInArrow(_edits, "conv_id long, part long, place long, seq long, role string, edit string")
    texts = held.select(F.col("seq").alias("row"), "turn", F.col("role").alias("had"), "text")
    kept = edits.filter(F.col("seq").isNotNull()).join(texts, F.col("seq") == F.col("row")).select("conv_id", "part", "place", "turn", F.coalesce("role", "had").alias("role"), "text", "edit")
    made = edits.filter(F.col("seq").isNull()).select("conv_id", "part", "place", F.lit(None).cast("long").alias("turn"), "role", F.lit("").alias("text"), "edit")
    return Repair(report, kept.unionByName(made))


def digests(rows: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of the repaired ``role:text`` lines, read as a stream in their order."""
    shape = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is not None and conv == now:
                    state.update(b"\n")
                else:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = conv, hashlib.sha256()
                state.update(line.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], schema=shape)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()], pa.string())], schema=shape)

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    return ordered.select("conv_id", F.concat("role", F.lit(":"), "text").alias("line")).mapInArrow(run, "conv_id long, repaired_sha256 string")


def digest(ids: DataFrame, found: Repair) -> DataFrame:
    """A row for each distinct ``conv_id`` of ``ids``; zeros and empty texts where nothing is left of it."""
    own = ids.select("conv_id").distinct()
    report, shas = found.report.withColumnRenamed("conv_id", "of"), digests(found.rows).withColumnRenamed("conv_id", "whose")
    both = own.join(report, F.col("conv_id").eqNullSafe(F.col("of")), "left").join(shas, F.col("conv_id").eqNullSafe(F.col("whose")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"))
