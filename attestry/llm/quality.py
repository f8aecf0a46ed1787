"""Document quality from a linear-chain conditional random field over lines.

Every line that is not blank is a node with label good or bad.  A node sees features of its own line (symbols,
capitals, digits, repeated words, words without letters, marked word ends, length) and of the lines before and
after it; neighbouring labels interact through a transition weight.  Forward-backward gives each line's marginal
probability of being good, and the length-weighted mean of the marginals, with the worst part of the text, gives
the document's score through a logistic link.

Labels come by document, not by line.  Learning starts with each line labelled as its document; in bad documents,
lines that look good to a logistic fit are then relabelled good (never the worst one), and the field is fitted to
the relabelled lines by gradient steps on the conditional likelihood.  At most about ``sample`` labelled documents,
chosen by a hash of ``doc_id``, are used, and only their line features come to the driver; longer documents than
LEARN_LINES lines or LEARN_BYTES bytes are scored like any other but not learned from, which bounds the sample.

Sequences lie one behind another in flat arrays, and forward-backward runs over sequences of like length together, so that
memory grows with the text that a task holds, not with its longest document.

Edge cases: null, empty and blank texts have no lines and are scored as one line without characters; conflicting
labels of one document count as bad; with no label to learn from, or labels of one kind only, every score is the
share of good labels (0.5 without any); repeated rows each get a row; an empty table gives no rows.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_steps, sampled

SAMPLE, THRESHOLD = 4000, 0.3
LEARN_LINES, LEARN_BYTES = 500, 64 << 10
#: Lines whose features are held at a time when texts are scored.
LINES = 1 << 14
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_PLAIN = _LETTERS + b"0123456789 .,;:'\"()-?\t\r"
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_DIGIT = bytes(c for c in range(256) if not 48 <= c <= 57)
OWN = 9
FEATURES = 1 + 3 * OWN


def line_features(line: bytes) -> list[float]:
    """Shares in [0, 1] that describe one line."""
    words = line.split()
    n, chars = max(1, len(words)), max(1, len(line) - line.count(b" "))
    letters = max(1, len(line) - len(line.translate(None, _LETTERS)))
    repeated = sum(map(eq, words, words[1:])) / n
    again = sum(map(eq, words, words[2:])) / n
    bare = sum(1 for w in words if not w.translate(None, _PLAIN[52:]).strip() and not w.strip(b"0123456789.,;:'\"()-?|"))
    marked = sum(1 for w in words if not (w[-1:].isalnum() or w[-1] >= 128 or w[-1:] in b".,;:'\")?")) / n
    return [
        len(line.translate(None, _PLAIN)) / chars,
        len(line.translate(None, _NOT_UPPER)) / letters if letters > 3 else 0.0,
        len(line.translate(None, _NOT_DIGIT)) / chars,
        repeated,
        max(0.0, again - repeated),
        bare / n,
        marked,
        1.0 - len(set(zip(words, words[1:], strict=False))) / (n - 1) if n > 8 else 0.0,
        1.0 / (1.0 + n / 8),
    ]


def lines_of(text: bytes) -> list[bytes]:
    return [x for x in text.split(b"\n") if x.strip()] or [b""]


def _around(own: np.ndarray) -> np.ndarray:
    """Features of lines 1 .. n - 2 with those of their neighbours."""
    return np.concatenate([np.ones((len(own) - 2, 1)), own[1:-1], own[:-2], own[2:]], axis=1)


def sequence(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(nodes x FEATURES, characters of each node)."""
    lines = lines_of(text)
    nothing = np.zeros((1, OWN))
    return _around(np.concatenate([nothing, [line_features(x) for x in lines], nothing])), np.array([max(1, len(x)) for x in lines], float)


def potentials(text: bytes, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-potential of good against bad, characters) of each node, with few features in memory at a time."""
    lines = lines_of(text)
    out = np.empty(len(lines))
    for a in range(0, len(lines), LINES):
        b = min(len(lines), a + LINES)
        own = np.zeros((b - a + 2, OWN))
        lo, hi = max(0, a - 1), min(len(lines), b + 1)
        own[lo - a + 1 : hi - a + 1] = [line_features(x) for x in lines[lo:hi]]
        out[a:b] = _around(own) @ node
    return out, np.array([max(1, len(x)) for x in lines], float)


def marginals(unary: list[np.ndarray], step: np.ndarray) -> list[np.ndarray]:
    """P(good) of every node of every sequence; ``unary`` has the log-potential of good against bad."""
    out: list = [None] * len(unary)
    classes: dict[int, list[int]] = {}
    for i, x in enumerate(unary):  # lengths within a factor of two run together
        classes.setdefault(len(x).bit_length(), []).append(i)
    for own in classes.values():
        for i, p in zip(own, _marginals([unary[i] for i in own], step), strict=True):
            out[i] = p
    return out


def _marginals(unary: list[np.ndarray], step: np.ndarray) -> list[np.ndarray]:
    order = sorted(range(len(unary)), key=lambda i: -len(unary[i]))
    size = np.array([len(unary[i]) for i in order])
    longest = int(size[0])
    u = np.zeros((len(order), longest, 2))
    for r, i in enumerate(order):
        u[r, : size[r], 1] = unary[i]
    live = np.searchsorted(-size, -np.arange(longest), "left").tolist()  # sequences with more than t nodes
    forward = u.copy()
    for t in range(1, longest):
        k = live[t]
        forward[:k, t] += np.logaddexp(forward[:k, t - 1, 0, None] + step[0], forward[:k, t - 1, 1, None] + step[1])
    ahead = np.zeros((len(order), 2))
    for t in range(longest - 2, -1, -1):
        k = live[t + 1]
        nxt = ahead[:k] + u[:k, t + 1]
        ahead[:k] = np.logaddexp(nxt[:, 0, None] + step[:, 0], nxt[:, 1, None] + step[:, 1])
        forward[:k, t] += ahead[:k]
    p = 1 / (1 + np.exp(np.clip(forward[..., 0] - forward[..., 1], -500, 500)))
    out: list = [None] * len(order)
    for r, i in enumerate(order):
        out[i] = p[r, : size[r]]
    return out


def _pairs(unary: list[np.ndarray], step: np.ndarray) -> np.ndarray:
    """Expected counts of neighbouring label pairs over all sequences."""
    total = np.zeros((2, 2))
    for x in unary:
        if len(x) < 2:
            continue
        f, b, u = np.zeros((len(x), 2)), np.zeros((len(x), 2)), np.stack([np.zeros(len(x)), x], axis=1)
        f[0] = u[0]
        for t in range(1, len(x)):
            f[t] = u[t] + np.logaddexp(f[t - 1, 0] + step[0], f[t - 1, 1] + step[1])
        for t in range(len(x) - 2, -1, -1):
            b[t] = np.logaddexp(step[:, 0] + u[t + 1, 0] + b[t + 1, 0], step[:, 1] + u[t + 1, 1] + b[t + 1, 1])
        z = np.logaddexp(f[-1, 0], f[-1, 1])
        total += np.exp(f[:-1, :, None] + step[None] + (u[1:] + b[1:])[:, None, :] - z).sum(axis=0)
    return total


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 25, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w = w - np.linalg.solve(h, g)
    return w


class Model:
    """Node weights, transition scores and the document link; ``constant`` replaces all where nothing can be learned."""

    def __init__(self) -> None:
        self.node, self.step, self.link, self.constant = np.zeros(FEATURES), np.zeros((2, 2)), np.array([0.0, 1.0, 0.0]), None

    @staticmethod
    def parts(good: np.ndarray, size: np.ndarray) -> list[float]:
        """Length-weighted mean of the marginals, and the logit of it, bounded."""
        mean = float((good * size).sum() / size.sum())
        return [1.0, mean, float(np.clip(np.log((mean + 1e-3) / (1 - mean + 1e-3)), -7, 7))]

    def scores(self, texts: list[bytes]) -> list[float]:
        if self.constant is not None:
            return [self.constant] * len(texts)
        nodes = [potentials(x, self.node) for x in texts]
        good = marginals([x for x, _ in nodes], self.step)
        return [float(1 / (1 + np.exp(-np.clip(np.dot(self.link, self.parts(p, s)), -30, 30)))) for p, (_, s) in zip(good, nodes, strict=True)]

    def learn(self, sequences: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 3, steps: int = 12) -> None:
        if not len(labels) or len(set(labels.tolist())) < 2:
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return
        ends = np.cumsum([len(x) for x, _ in sequences])
        owner = np.repeat(np.arange(len(sequences)), [len(x) for x, _ in sequences])
        x = np.concatenate([x for x, _ in sequences])
        y = labels[owner].astype(float)
        for _ in range(rounds):  # a bad document keeps its worst line bad; its lines that look good become good
            w = _logistic(x, y, np.ones(len(y)))
            value = x @ w
            y = np.where(labels[owner] == 1, 1.0, (value > 0).astype(float))
            for d in np.flatnonzero(labels == 0):
                a = ends[d] - len(sequences[d][0])
                y[a + int(value[a : ends[d]].argmin())] = 0.0
        self.node = w
        parts = [y[e - len(s[0]) : e].astype(int) for e, s in zip(ends, sequences, strict=True)]
        seen = np.zeros((2, 2))
        for p in parts:
            np.add.at(seen, (p[:-1], p[1:]), 1)
        nodes = len(y)
        for k in range(steps):  # gradient steps on the conditional likelihood, smaller and smaller
            unary = [s[0] @ self.node for s in sequences]
            p = np.concatenate(marginals(unary, self.step))
            rate = 4.0 / (1 + k / 4)
            self.node = self.node + rate * (x.T @ (y - p) / nodes - 1e-4 * self.node)
            self.step = self.step + rate * ((seen - _pairs(unary, self.step)) / nodes - 1e-4 * self.step)
        good = marginals([s[0] @ self.node for s in sequences], self.step)
        self.link = _logistic(
            np.array([self.parts(p, s[1]) for p, s in zip(good, sequences, strict=True)]),
            labels.astype(float),
            np.ones(len(labels)),
            ridge=0.1,
        )


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model:
    """Learn from the texts of ``docs(doc_id, text)`` and ``labels(doc_id, quality)``; rows without a label are left out."""
    marks = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("quality").cast("int").alias("y"),
    ).filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y"))
    chosen = sampled(marks, sample, "doc_id")
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    ).join(F.broadcast(chosen), "doc_id")  # `sample` ids at most
    text = F.coalesce("text", F.lit(""))
    texts = texts.filter((F.octet_length(text) <= LEARN_BYTES) & (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) < LEARN_LINES))
    texts = sampled(texts, sample, "doc_id", "text")  # an id may have many rows

    def work(piece: pa.RecordBatch) -> dict:
        made = [sequence(x or b"") for x in piece.column("text").cast(pa.binary()).to_pylist()]
        return {
            "doc_id": piece.column("doc_id"),
            "y": piece.column("y"),
            "x": [x.astype("<f4").tobytes() for x, _ in made],
            "size": [s.tolist() for _, s in made],
        }

    got = sorted(
        map_steps(texts, "text", "doc_id long, y int, x binary, size array<double>", work).collect(),
        key=lambda r: (r["doc_id"], r["x"]),
    )  # a bounded sample
    model = Model()
    model.learn([(np.frombuffer(r["x"], "<f4").reshape(-1, FEATURES).astype(float), np.array(r["size"])) for r in got], np.array([r["y"] for r in got], int))
    return model


def _scored(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """All columns of ``docs`` and the score as column ``name``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(piece: pa.RecordBatch) -> dict:
        made = held.value.scores([x or b"" for x in piece.column("text").cast(pa.binary()).to_pylist()])
        return {c: piece.column(c) for c in piece.schema.names} | {name: made}

    shape = T.StructType([*docs.schema, T.StructField(name, T.DoubleType())])
    return map_steps(docs, "text", shape, work, limit=2 << 20)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for every row; only ``text`` is looked at."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _scored(rows, model, "score").select("doc_id", "score")


def accepted(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns kept."""
    name = free_name(docs)
    return _scored(docs, model, name).filter(F.col(name) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
