"""Documents packed in chunks, and rounds of questions about names that chunks share.

A chunk is a run of documents with a bounded number of bytes, of texts and of all else (one longer document is a chunk of its own;
ROW_BYTES stand for what every row takes), packed into one row.  The rows
are written once, in the shared folder, as a table bucketed by chunk, so that every round reads them in place; beyond
MOST_FILES chunks a bucket holds several.  In a round each chunk sends the distinct names that it holds, as packed
arrays by name bucket; a bucket answers to each chunk what it needs to know; answers go back by chunk.  What a chunk
has found so far can be kept as its state, which reaches the next rounds like an answer.  Only names, answers and
states are shuffled, copies inside a chunk are combined before, and no task holds more than a chunk or a bucket.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded_batches, removed, shared_folder, stored

CHUNK_BYTES, BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 8 << 20, 8 << 20, 128, 1 << 24
#: Files of the chunk table at most; messages that one task reads, about.
MOST_FILES, TASK_BYTES = 8192, 64 << 20
ROW_BYTES = 64
#: stands for a missing id: before all others
NO_ID = -(1 << 63)
Answers = dict[str, dict[int, list[np.ndarray]]]


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes under zstandard."""
    out = [len(arrays).to_bytes(4, "little")]
    for a in arrays:
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T) if len(a) else np.empty(0, np.uint8)
        out += [a.dtype.str.encode().ljust(8), len(a).to_bytes(8, "little"), planes.tobytes()]
    return zstandard.compress(b"".join(out), 1)


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    at, out = 4, []
    for _ in range(int.from_bytes(raw[:4], "little")):
        kind, n = np.dtype(raw[at : at + 8].decode().strip()), int.from_bytes(raw[at + 8 : at + 16], "little")
        at += 16
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n) if n else np.empty(0, kind))
        at += n * kind.itemsize
    return out


class Names:
    """Distinct 64-bit names in order; leading bits deal them over the buckets (a power of two)."""

    def __init__(self, names: np.ndarray, buckets: int, *, first: bool = False):
        """``first`` also finds each name's first index in ``names``, and each index's name."""
        if first:
            order = np.argsort(names, kind="stable")
            ordered = names[order]
        else:
            ordered = np.sort(names)
        new = np.ones(len(names), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        at = np.flatnonzero(new)
        self.name = ordered[at]
        self.many = np.diff(at, append=len(names)) > 1
        if first:
            self.first = order[at]
            self.of = np.empty(len(names), np.int64)
            self.of[order] = np.cumsum(new) - 1
        self.bits = np.uint64(buckets.bit_length() - 1)
        bucket = self.bucket()
        edge = np.flatnonzero(np.diff(bucket)) + 1
        lo, hi = np.concatenate([[0], edge]), np.concatenate([edge, [len(bucket)]])
        self.range = {int(bucket[a]): (int(a), int(b)) for a, b in zip(lo, hi, strict=True) if b > a}

    def bucket(self) -> np.ndarray:
        return (self.name >> (np.uint64(64) - self.bits)).astype(np.int64)

    def parts(self, chunk: int, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        for b, (lo, hi) in self.range.items():
            yield b, chunk, packed(*[c[lo:hi] for c in columns])

    def short_parts(self, chunk: int, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """Parts that begin with 32 bits of each name behind the bucket's, as differences: enough to see what is unique."""
        tag = ((self.name << self.bits) >> np.uint64(32)).astype("<u4")
        for b, (lo, hi) in self.range.items():
            yield b, chunk, packed(np.diff(tag[lo:hi], prepend=np.uint32(0)), *[c[lo:hi] for c in columns])

    def answered(self, answers: dict[int, list[np.ndarray]], *kinds: str) -> list[np.ndarray]:
        """Answers that begin with a bit for each name sent: the mask, and the columns, zero where the mask is not set."""
        out = [np.zeros(len(self.name), bool), *[np.zeros(len(self.name), k) for k in kinds]]
        for b, (bits, *columns) in answers.items():
            lo, hi = self.range[b]
            own = np.unpackbits(bits, count=hi - lo).astype(bool)
            out[0][lo:hi] = own
            for to, column in zip(out[1:], columns, strict=False):
                to[lo:hi][own] = column
        return out


class Texts:
    """A chunk's documents in the order of their ids; ``rest`` has the other columns, as an Arrow batch."""

    def __init__(self, blob: bytes):
        self.ids, self.sizes, null, data, rest = unpacked(blob)
        self.null, self.data, self._rest = null.astype(bool), data.tobytes(), rest
        self.end = np.cumsum(self.sizes)
        self.begin = self.end - self.sizes

    def texts(self) -> list[bytes | None]:
        return [None if n else self.data[b:e] for n, b, e in zip(self.null.tolist(), self.begin.tolist(), self.end.tolist(), strict=True)]

    def rest(self) -> pa.RecordBatch:
        return from_ipc(self._rest.tobytes())


def as_table(rows: Iterable[tuple] | pa.Table, shape: pa.Schema) -> pa.Table:
    """Tuples as an Arrow table."""
    if isinstance(rows, pa.Table):
        return rows
    columns = list(zip(*rows, strict=True)) or [()] * len(shape)
    return pa.Table.from_arrays([pa.array(x, type=f.type) for x, f in zip(columns, shape, strict=True)], schema=shape)


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_next_batch()


def _pack(rows: list[pa.RecordBatch]) -> bytes:
    """Rows ``id, text, other columns...`` as one blob."""
    batch = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
    key = np.ascontiguousarray(batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False), "<i8")
    order = np.argsort(key, kind="stable")
    batch = batch.take(pa.array(order))
    texts = batch.column(1).cast(pa.binary()).to_pylist()
    others = batch.select(batch.schema.names[2:])
    rest = np.frombuffer(to_ipc(others), np.uint8) if others.num_columns else np.empty(0, np.uint8)
    return packed(
        key[order],
        np.array([len(x or b"") for x in texts], "<i8"),
        np.array([x is None for x in texts], np.uint8),
        np.frombuffer(b"".join(x or b"" for x in texts), np.uint8),
        rest,
    )


def _chunked(limit: int):
    shape = pa.schema([("chunk", pa.int64()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 24, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([_pack(held)], type=pa.binary())], schema=shape)

        for batch in batches:
            others = batch.select(batch.schema.names[2:])
            each = ROW_BYTES + (others.nbytes // max(1, batch.num_rows) if others.num_columns else 0)
            sizes = pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False) + each
            start = 0
            for i, n in enumerate(sizes.tolist()):
                if (held or i > start) and size + n > limit:
                    held.append(batch.slice(start, i - start))
                    yield out()
                    number, held, size, start = number + 1, [], 0, i
                size += n
            held.append(batch.slice(start))
        if sum(x.num_rows for x in held):
            yield out()

    return run


class Rounds:
    """The chunk table of some documents and the answers so far; both go when the block is left, however it is left.

    ``answers`` reach a chunk's function as ``{kind: {bucket: arrays}}``.
    """

    SENT, ANSWER = "bucket long, chunk long, payload binary", "chunk long, bucket long, kind string, payload binary"

    def __init__(self, docs: DataFrame, *, chunk_bytes: int = CHUNK_BYTES, keep: bool = False):
        """``keep`` holds all columns but ``text`` for the report."""
        self.spark = spark = docs.sparkSession
        bounded_batches(spark)
        others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"] if keep else []
        rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), *others)
        held = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
        self.total = held["b"] + ROW_BYTES * held["n"]
        self.buckets = min(MOST_BUCKETS, 1 << (max(LEAST_BUCKETS, -(-self.total // BUCKET_BYTES)) - 1).bit_length())
        self.tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-self.total // TASK_BYTES))
        files = min(int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")), MOST_FILES, max(8, -(-self.total // chunk_bytes)))
        self.name = f"attestry_chunks_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(spark)}/{self.name}"
        self.chunks = self.answers = None
        self.kept: list[str] = []
        try:
            made = rows.mapInArrow(_chunked(chunk_bytes), "chunk long, blob binary").write.bucketBy(files, "chunk").sortBy("chunk")
            made.option("compression", "uncompressed").option("path", self.path).saveAsTable(self.name)
            self.chunks = spark.table(self.name)
            self.answers = spark.createDataFrame([], self.ANSWER)
        except BaseException:
            self.__exit__()
            raise

    def __enter__(self) -> Rounds:
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        for path in (self.path, *self.kept):
            removed(self.spark, path)

    def stored(self, df: DataFrame) -> DataFrame:
        """A table that lives as long as the rounds."""
        path = f"{self.path}-{len(self.kept)}"
        self.kept.append(path)
        return stored(df, path)

    @staticmethod
    def _got(answers: pa.Table) -> Answers:
        got: Answers = {}
        for kind, bucket, payload in zip(*[answers.column(c).to_pylist() for c in ("kind", "bucket", "payload")], strict=True):
            got.setdefault(kind, {})[bucket] = unpacked(payload)
        return got

    def rows(self, work: Callable, schema: str | T.StructType, *, texts: bool = True, answers: DataFrame | None = None) -> DataFrame:
        """Rows (tuples as in ``schema``, or one Arrow table of them) that ``work(chunk, blob, answers)`` yields; without
        ``texts`` from the answers alone, and the blob is None.  ``answers`` stand in for those kept.

        One Python step a stage, without pandas: each further one has workers of its own, which stay in an executor's memory."""
        held = self.answers if answers is None else answers
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        shape, got = to_arrow_schema(kind), self._got

        def both(chunk: pa.Table, answers: pa.Table) -> pa.Table:
            if not chunk.num_rows:
                return shape.empty_table()
            return as_table(work(chunk.column("chunk")[0].as_py(), chunk.column("blob")[0].as_py(), got(answers)), shape)

        def alone(answers: pa.Table) -> pa.Table:
            return as_table(work(answers.column("chunk")[0].as_py(), None, got(answers)), shape)

        if not texts:
            return held.groupBy("chunk").applyInArrow(alone, kind)
        return self.chunks.groupBy("chunk").cogroup(held.groupBy("chunk")).applyInArrow(both, kind)

    def add(self, answers: DataFrame) -> None:
        """Keep answers (``chunk, bucket, kind, payload``) for the rounds that follow."""
        self.answers = self.answers.unionByName(self.stored(answers))

    def become(self, work: Callable, *, texts: bool = True) -> None:
        """Replace all answers by each chunk's state: the arrays that ``work(chunk, blob, answers)`` returns."""

        def state(chunk: int, blob: bytes | None, answers: Answers) -> Iterator[tuple]:
            yield chunk, 0, "state", packed(*work(chunk, blob, answers))

        self.answers = self.stored(self.rows(state, self.ANSWER, texts=texts))

    def ask(self, kind: str, send: Callable, answer: Callable, *, short: bool = False, texts: bool = True) -> None:
        """``send(chunk, blob, answers)`` yields (bucket, chunk, payload), with ``short`` as from ``Names.short_parts``;
        ``answer(owner, columns)`` gives, for all names that a bucket got (their columns and the chunks that sent them),
        a mask and columns for the names in it."""

        shape = to_arrow_schema(T.StructType.fromDDL(self.ANSWER))

        def run(sent: pa.Table) -> pa.Table:
            bucket, chunks = sent.column("bucket")[0].as_py(), sent.column("chunk").to_numpy()
            parts = [unpacked(x) for x in sent.column("payload").to_pylist()]
            if short:
                parts = [[np.cumsum(x[0], dtype=np.uint32), *x[1:]] for x in parts]
            size = np.array([len(x[0]) for x in parts])
            cut = np.concatenate([[0], np.cumsum(size)])
            columns = [np.concatenate([x[i] for x in parts]) for i in range(len(parts[0]))]
            del parts
            flag, more = answer(np.repeat(chunks, size), columns)
            rows = []
            for i, chunk in enumerate(chunks.tolist()):
                own = flag[cut[i] : cut[i + 1]]
                if own.any():
                    rows.append((chunk, bucket, kind, packed(np.packbits(own), *[x[cut[i] : cut[i + 1]][own] for x in more])))
            return as_table(rows, shape)

        sent = self.rows(send, self.SENT, texts=texts)
        self.add(sent.repartition(self.tasks, "bucket").groupBy("bucket").applyInArrow(run, self.ANSWER))


def shared_names(owner: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Names that more than one chunk sent, and their ranks among these in the bucket."""
    _, group, count = np.unique(columns[0], return_inverse=True, return_counts=True)
    shared = count > 1
    return shared[group], [(np.cumsum(shared) - 1)[group].astype("<u4")]
