"""Phrase collocations: word sequences that occur often, and more often together than their parts would.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words (``[^\\x20\\x09]+``).  Counts are per
``lang``: n of all word occurrences, f(phrase) of all its occurrences inside pieces, overlaps included.  Candidates are phrases of
2 to DEPTH words with f >= ``least``.  Cut after its first k words a candidate has score floor(1000 * f * n / (f(left) * f(right)));
its lowest cut counts (ties to the smallest k).  A candidate inside a longer one that has at least ``share`` percent of its
occurrences goes.  Each language's first ``most`` by score, f (both descending) and phrase (UTF-8 order) are reported.

The method is multikey quicksort of suffix pointers.  A suffix begins at each word and is DEPTH words deep at most; it ends with
its piece, or before a pair of words that itself is rare.  First leading pairs are counted, by hashes that are sent sorted and
packed: what they add up to is never less than the pair's count, so that a pair below ``least`` is abandoned where it stands
and a chance meeting of hashes only carries one in vain.  The others reach the tasks as a table of 2**BITS marks, a bounded
size whatever the input.  Suffixes of marked pairs are written once, as a table in the shared folder, and routed by their
leading pair to buckets of a bounded number of pointers; a leading pair with more than HOT occurrences is routed by three words,
or four, and what all of it has in common is counted by an aggregate instead, so that no bucket depends on one pair.  A
bucket's task sorts its pointers by three-way partitions, word by word: the part that equals the pivot is one phrase and its
weight the phrase's count, its next word is sorted in turn, and parts lighter than ``least`` are abandoned unsorted.  Pointers
to equal suffixes of one batch travel as one with a weight.  Counts are by the words themselves, and exact; scores are
decimals of 38 digits.

Nulls: a null text is empty, a null ``lang`` is ``und``.  Repeated rows count as often as they occur; ids are not looked at, so
that they may be null or repeat.  A long text is read in steps that end with a piece.  An empty table gives no rows.  Other columns of ``docs`` are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import packed, unpacked
from .common import STEP_BYTES, bounded_batches, removed, shared_folder, stored, text_bytes, utf8

DEPTH, LEAST, SHARE, MOST = 5, 100, 100, 2000
#: occurrences beyond which a leading sequence is routed by one word more; pointers of a bucket, about
HOT, BUCKET = 1 << 17, 1 << 19
#: bits of a pair's hash that are sent, bits of the table of marks; pairs of a slice of hashes, about
SENT, BITS, SLICE = 44, 26, 1 << 23
#: hot sequences up to which they are broadcast
FEW = 100_000
UNKNOWN = "und"
ENDS = (b".", b",", b";", b":", b"!", b"?", b"\n", b"\x0b", b"\x0c", b"\r")
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n")
COUNTED = "lang string, phrase string, n long"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _followed(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Hashes of sequences from those of their beginnings and of their last words."""
    h = (first ^ (first >> np.uint64(29))) * _ODD + then
    return h ^ (h >> np.uint64(32))


def _hashed(lang: list[str], word: list[bytes]) -> np.ndarray:
    seed = {x: xxhash.xxh64_intdigest(x.encode()) for x in set(lang)}
    return np.array([xxhash.xxh64_intdigest(w, seed[x]) for x, w in zip(lang, word, strict=True)], np.uint64)


def marked(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - SENT) & np.uint64((1 << BITS) - 1)
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _slices(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    """Sent hashes with their counts up to 255, by their leading bits, as differences."""
    value, count = np.unique(hashes >> np.uint64(64 - SENT), return_counts=True)
    owner = (value >> np.uint64(SENT - bits)).astype(np.int64)
    edge = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]]) if len(owner) else np.zeros(1, np.int64)
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        gaps = np.diff(value[lo:hi], prepend=np.uint64(owner[lo]) << np.uint64(SENT - bits))
        yield int(owner[lo]), packed(gaps, np.minimum(count[lo:hi], 255).astype(np.uint8))


def _summed(bits: int, least: int):
    def run(rows: pa.Table) -> pa.Table:
        start = np.uint64(rows.column("slice")[0].as_py()) << np.uint64(SENT - bits)
        parts = [unpacked(x) for x in rows.column("payload").to_pylist()]
        value = np.concatenate([np.cumsum(x[0], dtype=np.uint64) + start for x in parts])
        count = np.concatenate([x[1] for x in parts]).astype(np.int64)
        order = np.argsort(value)
        value, count = value[order], count[order]
        at = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        at = value[at][np.add.reduceat(count, at) >= min(least, 255)] & np.uint64((1 << BITS) - 1)
        return pa.table({"word": (at >> np.uint64(6)).astype(np.int64), "bit": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    return run


def frequent_pairs(rows: DataFrame, least: int) -> Broadcast:
    """Marks of all leading pairs that may occur ``least`` times or more."""
    spark = rows.sparkSession
    pairs = text_bytes(rows, "text") // 6
    bits = (max(256, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), pairs // SLICE) - 1).bit_length()
    shape = "slice long, payload binary"

    def send(w: Words) -> dict:
        got = list(_slices(w.pair_hashes()[1], bits))
        return {"slice": pa.array([x[0] for x in got], pa.int64()), "payload": pa.array([x[1] for x in got], pa.binary())}

    found = _mapped(rows, send, shape).groupBy("slice").applyInArrow(_summed(bits, least), "word long, bit long")
    table = found.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(out)


class Words:
    """The words of a batch in order: ``of`` the place of each among the distinct ones (``lang``, ``word``), ``last`` where a piece ends."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        data = b"\n".join([*texts, b""]).translate(_FOLD)
        raw = np.frombuffer(data, np.uint8)
        end = raw == 10
        gap = end | (raw == 32) | (raw == 9)
        start = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]])) if len(raw) else np.empty(0, np.int64)
        stop = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]])) if len(raw) else np.empty(0, np.int64)
        # words one after the other, without what is between them
        offsets = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int64)
        tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[~gap].tobytes())])
        coded = tokens.dictionary_encode()
        piece = np.searchsorted(np.flatnonzero(end), start)
        doc = np.searchsorted(np.cumsum([len(x) + 1 for x in texts]), start, "right")
        names = sorted(set(langs))
        lang = np.array([names.index(x) for x in langs], np.int64)[doc]
        many = max(1, len(coded.dictionary))
        code, self.of, self.count = np.unique(lang * many + coded.indices.to_numpy().astype(np.int64), return_inverse=True, return_counts=True)
        self.lang = pa.array(names, pa.string()).take(pa.array(code // many))
        self.word = coded.dictionary.cast(pa.large_string()).cast(pa.string()).take(pa.array(code % many))
        self.last = np.ones(len(start), bool)
        self.last[:-1] = piece[1:] != piece[:-1]

    def pair_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of all pairs of words of one piece, and their hashes."""
        at = np.flatnonzero(~self.last[:-1])
        word = _hashed(self.lang.to_pylist(), utf8(self.word))
        return at, _followed(word[self.of[at]], word[self.of[at + 1]])

    def counted(self, rows: np.ndarray, weight: np.ndarray) -> dict:
        """``lang, phrase, n`` of sequences of distinct words' places; -1 behind a sequence's end."""
        parts = [self.word.take(pa.array(c, mask=c < 0)) for c in rows.T]
        return {
            "lang": self.lang.take(pa.array(rows[:, 0])),
            "phrase": pc.binary_join_element_wise(*parts, " ", null_handling="skip") if len(parts) > 1 else parts[0],
            "n": pa.array(weight, pa.int64()),
        }


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First row of each distinct one, each row's place among these, and how many rows each stands for; columns have numbers from 0."""
    code = columns[0]
    for k, c in enumerate(columns[1:], 1):
        size = int(c.max(initial=0)) + 1
        if int(code.max(initial=0)) > (1 << 62) // size:
            _, code = np.unique(code, return_inverse=True)
        code = code * size + c
    _, first, inverse, count = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
    return first, inverse, count


def suffixes_of(w: Words, frequent: np.ndarray) -> dict:
    """Distinct suffixes over frequent pairs, with their weights."""
    at, hashes = w.pair_hashes()
    at = at[marked(frequent, hashes)]
    of, ok = w.of, np.zeros(len(w.of), bool)
    ok[at] = True
    far = lambda k: np.minimum(at + k, len(of) - 1)
    run, words = np.ones(len(at), bool), [of[at] + 1]
    for k in range(1, DEPTH):
        run = run & ok[far(k - 1)]
        words.append(np.where(run, of[far(k)] + 1, 0))
    first, _, weight = _distinct(*words)
    return w.counted(np.stack([c[first] - 1 for c in words], 1), weight)


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in parts of STEP_BYTES or less that end with a piece, where it has pieces."""
    at = 0
    while len(text) - at > STEP_BYTES:
        cut = max(text.rfind(x, at, at + STEP_BYTES) for x in ENDS)
        cut = cut if cut >= at else min((k for x in ENDS if (k := text.find(x, at)) >= 0), default=-1)
        if cut < 0:
            break
        yield text[at : cut + 1]
        at = cut + 1
    yield text[at:]


def _mapped(rows: DataFrame, work: Callable[[Words], dict], shape: str = COUNTED) -> DataFrame:
    """``work`` on the words of STEP_BYTES of texts at a time, a longer text in parts; it gives the columns of ``shape``."""
    bounded_batches(rows.sparkSession)

    def out(texts: list[bytes], langs: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(work(Words(texts, langs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, langs, size = [], [], 0
        for batch in batches:
            for text, lang in zip(utf8(batch.column("text")), batch.column("lang").to_pylist(), strict=True):
                for part in _pieces(text):
                    if size and size + len(part) > STEP_BYTES:
                        yield out(texts, langs)
                        texts, langs, size = [], [], 0
                    texts.append(part)
                    langs.append(lang)
                    size += len(part)
        if texts:
            yield out(texts, langs)

    return rows.mapInArrow(run, shape)


def partitions(words: np.ndarray, weight: np.ndarray, known: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Multikey three-way quicksort of rows of ``words`` (-1 behind a row's end; the first column is the language): (a row, words,
    weight) for each sequence of more words than ``known`` that weighs ``least`` or more."""
    chance = np.random.default_rng(42)
    stack = [(np.arange(len(words)), 0)] if weight.sum() >= least else []
    while stack:
        at, depth = stack.pop()
        key = words[at, depth]
        pivot = np.partition(key[chance.integers(0, len(key), 9)], 4)[4]
        same = at[key == pivot]
        for rest in (at[key < pivot], at[key > pivot]):
            if len(rest) and weight[rest].sum() >= least:
                stack.append((rest, depth))
        total = int(weight[same].sum())
        if pivot >= 0 and total >= least:
            if depth > known[same[0]]:
                yield int(same[0]), depth, total
            if depth + 1 < words.shape[1]:
                stack.append((same, depth + 1))


def _bucket(least: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        split = pc.split_pattern(rows.column("phrase").combine_chunks(), " ")
        size = pc.list_value_length(split).to_numpy()
        codes = split.flatten().dictionary_encode().indices.to_numpy()
        table = np.full((len(size), DEPTH + 1), -1, np.int32)
        table[:, 0] = rows.column("lang").combine_chunks().dictionary_encode().indices.to_numpy()
        row = np.repeat(np.arange(len(size)), size)
        table[row, 1 + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = codes
        found = list(partitions(table, rows.column("n").to_numpy(), rows.column("known").to_numpy(), least))
        at = pa.array([x[0] for x in found], pa.int64())
        spelt = rows.column("phrase").take(at).to_pylist()
        return pa.table({
            "lang": rows.column("lang").take(at).cast(pa.string()),
            "phrase": pa.array([" ".join(x.split(" ")[:d]) for x, (_, d, _) in zip(spelt, found, strict=True)], pa.string()),
            "n": pa.array([x[2] for x in found], pa.int64()),
        })

    return run


def phrase_counts(docs: DataFrame, *, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, n`` of all phrases of 1 to DEPTH words that occur ``least`` times or more, and ``lang, n`` of all words."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))

    def summed(df: DataFrame) -> DataFrame:
        return df.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))

    def one(w: Words) -> dict:
        got = w.counted(np.arange(len(w.word))[:, None], w.count)
        all_ = pa.table({"lang": w.lang, "n": w.count}).group_by("lang").aggregate([("n", "sum")])
        total = {"lang": all_.column("lang").combine_chunks(), "phrase": pa.nulls(all_.num_rows, pa.string()), "n": all_.column("n_sum").combine_chunks()}
        return {k: pa.concat_arrays([got[k], total[k].cast(got[k].type)]) for k in got}

    single = stored(summed(_mapped(rows, one)).filter(F.col("phrase").isNull() | (F.col("n") >= least)))
    totals, levels = single.filter(F.col("phrase").isNull()).select("lang", "n"), [single.filter(F.col("phrase").isNotNull())]
    frequent = frequent_pairs(rows, least)
    path = f"{shared_folder(spark)}/attestry-{uuid.uuid4().hex}"
    suffixes = stored(_mapped(rows, lambda w: suffixes_of(w, frequent.value)), path)
    pairs = suffixes.select("lang", F.substring_index("phrase", " ", 2).alias("phrase"), "n")
    levels.append(stored(summed(pairs).filter(F.col("n") >= least)))
    suffixes = suffixes.withColumn("size", F.regexp_count("phrase", F.lit(" ")) + 1).withColumn("known", F.lit(2)).filter("size > 2")
    for depth in range(2, DEPTH):
        # what begins with a hot sequence is routed by one word more, and is counted to that depth here
        hot = levels[-1].filter(F.col("n") > HOT).select(F.col("lang").alias("of"), F.col("phrase").alias("lead"), F.lit(True).alias("hot"))
        few = hot.count()
        if not few:
            break
        hot = F.broadcast(hot) if few <= FEW else hot
        lead = F.substring_index("phrase", " ", depth)
        suffixes = suffixes.join(hot, (F.col("lang") == F.col("of")) & (lead == F.col("lead")) & (F.col("known") == depth), "left")
        suffixes = suffixes.withColumn("known", F.when(F.col("hot"), depth + 1).otherwise(F.col("known"))).drop("of", "lead", "hot")
        deeper = suffixes.filter((F.col("known") == depth + 1) & (F.col("size") > depth)).select("lang", F.substring_index("phrase", " ", depth + 1).alias("phrase"), "n")
        levels.append(stored(summed(deeper).filter(F.col("n") >= least)))
    pointers = levels[1].agg(F.sum("n").alias("n")).first()["n"] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pointers // BUCKET))
    lead = F.when(F.col("known") == 2, F.substring_index("phrase", " ", 2)).when(F.col("known") == 3, F.substring_index("phrase", " ", 3)).otherwise(F.substring_index("phrase", " ", 4))
    sent = suffixes.filter("size > known").select(F.pmod(F.xxhash64("lang", lead), F.lit(buckets)).alias("bucket"), "lang", "phrase", "n", "known")
    levels.append(stored(sent.groupBy("bucket").applyInArrow(_bucket(least), COUNTED)))
    removed(spark, path)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out, totals


def collocations(docs: DataFrame, *, least: int = LEAST, share: int = SHARE, most: int = MOST) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of ``docs`` (``text, lang``): each language's first ``most`` candidates."""
    counts, totals = phrase_counts(docs, least=least)
    counts = stored(counts.withColumn("words", F.split("phrase", " ")).withColumn("size", F.size("words")))
    candidates = counts.filter("size > 1")
    part = lambda name: counts.select(F.col("lang"), F.col("phrase").alias(f"{name}_phrase"), F.col("n").alias(name))
    cuts = candidates.select("lang", "phrase", F.col("n").alias("a"), "words", "size", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.withColumn("l_phrase", F.expr("array_join(slice(words, 1, k), ' ')")).withColumn("r_phrase", F.expr("array_join(slice(words, k + 1, size), ' ')")).drop("words", "size")
    cuts = cuts.join(part("l"), ["lang", "l_phrase"]).join(part("r"), ["lang", "r_phrase"]).join(totals, "lang")
    wide = lambda x: f"CAST({x} AS DECIMAL(19,0))"
    score = F.expr(f"({wide('a')} * {wide('n')} * CAST(1000 AS DECIMAL(4,0))) DIV ({wide('l')} * {wide('r')})")
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r", "n")).alias("s"))
    inner = candidates.filter("size > 2").select("lang", "n", "words", "size", F.explode(F.expr("sequence(2, size - 1)")).alias("m"))
    inner = inner.select("lang", "n", F.explode(F.expr("transform(sequence(1, size - m + 1), i -> array_join(slice(words, i, m), ' '))")).alias("phrase"))
    over = inner.groupBy("lang", "phrase").agg(F.max("n").alias("over"))
    left = scored.join(over, ["lang", "phrase"], "left").filter(F.col("over").isNull() | (F.col("over") * 100 < F.col("s.a") * share))
    rows = left.select("lang", "phrase", "s.a", "s.l", "s.r", "s.n", "s.score", F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
