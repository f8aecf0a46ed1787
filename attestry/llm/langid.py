"""Language identification with error-correcting output codes.

Each language has a codeword of signs.  For every bit a binary n-gram classifier tells the languages with +1 from
those with -1: its value on a text is the mean log-odds of the text's hashed byte n-grams (1 to 3 bytes, lower
case, everything but letters taken as blank), put on a logit scale by a one-dimensional logistic fit.  A text's
language is the one whose codeword has the least weighted logistic loss; a bit weighs what it has shown on the
sample (the log-odds of being right).  ``ambiguous`` marks texts whose second-best codeword comes close.

Codes: up to six languages use all distinct splits (exhaustive code); more use random splits, kept when they keep
codewords apart.  Learning uses at most about ``sample_per_language`` texts of each language, chosen by a hash of
``doc_id``, and only n-gram counts by language and bit values by text come back to the driver.

Edge cases: null texts and texts without a letter get ``und`` with score 0; with no labelled row to learn from,
everything is ``und``; with one language, every text with a letter is in it; repeated rows each get a row; an empty
table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_steps, sampled

SAMPLE_PER_LANGUAGE, AMBIGUOUS, BITS = 2000, 0.1, 14
#: languages that can be learned, the most frequent first
LANGUAGES = 1024
UNKNOWN = "und"
#: What the n-grams of one text sum to.
UNIT = 10**8
_LETTER = re.compile(r"[^\W\d_]")  # letters, and some numerals that are none
_FORM = np.full(256, 32, np.int64)
for _c in (*range(97, 123), *range(128, 256)):
    _FORM[_c] = _c
_FORM[0xC2], _SIZE = 32, 1 << BITS  # 0xC2 leads signs, not letters


def ngrams(text: str) -> np.ndarray:
    """Hashed places of a text's n-grams; n-grams of blanks only are left out."""
    b = _FORM[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8)]
    two = b[:-1] << 8 | b[1:]
    three = two[:-1] << 8 | b[2:]
    out = [b[b != 32] + 1, two[two != 0x2020] + (1 << 20), three[three != 0x202020] + (1 << 30)]
    codes = np.concatenate(out).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (codes >> np.uint64(64 - BITS)).astype(np.int64)


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def codewords(n: int) -> np.ndarray:
    """A row of +1/-1 for each of ``n`` languages; any two rows differ in many places."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 6:
        splits = range((1 << (n - 1)) - 1)
        return np.array([[1 if k == n - 1 else (1 if s >> k & 1 else -1) for s in splits] for k in range(n)], float)
    random, best, apart = np.random.default_rng(n), None, -1
    for _ in range(200):
        code = random.choice([-1.0, 1.0], (n, int(10 * np.ceil(np.log2(n)))))
        differ = ((code[:, None] != code[None]).sum(axis=2) + 10**6 * np.eye(n)).min()
        if differ > apart and (abs(code.sum(axis=0)) < n).all():
            best, apart = code, differ
    return best


class Model:
    """Languages, codewords, n-gram weights per bit, and each bit's scale, offset and weight."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.code = codewords(len(languages))
        share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True) if len(languages) else counts
        self.weights = np.zeros((_SIZE, self.code.shape[1]))
        for bit in range(self.code.shape[1]):
            on = self.code[:, bit] > 0
            self.weights[:, bit] = np.log(share[on].mean(axis=0)) - np.log(share[~on].mean(axis=0))
        self.scale, self.offset, self.trust = np.ones(self.code.shape[1]), np.zeros(self.code.shape[1]), np.ones(self.code.shape[1])

    def bits(self, text: str) -> np.ndarray:
        at = ngrams(text)
        if at.size > _SIZE:
            return np.bincount(at, minlength=_SIZE) @ self.weights / at.size
        return self.weights[at].sum(axis=0) / max(1, at.size)

    def calibrate(self, values: np.ndarray, language: np.ndarray) -> None:
        """Fit scale and offset of every bit, and weigh it by how often it is right."""
        for bit in range(self.code.shape[1]):
            x, y = values[:, bit], self.code[language, bit]
            a, b = 1.0, 0.0
            for _ in range(30):  # Newton steps of a ridged logistic fit
                p = 1 / (1 + np.exp(np.clip(y * (a * x + b), -30, 30)))
                g = np.array([-(y * p * x).sum() + 1e-3 * a, -(y * p).sum() + 1e-3 * b])
                r = p * (1 - p)
                h = np.array([[(r * x * x).sum() + 1e-3, (r * x).sum()], [(r * x).sum(), r.sum() + 1e-3]])
                a, b = np.array([a, b]) - np.linalg.solve(h, g)
            self.scale[bit], self.offset[bit] = a, b
            wrong = ((y * (a * x + b) <= 0).sum() + 1) / (len(x) + 2)
            self.trust[bit] = max(0.05, np.log((1 - wrong) / wrong))
        self.trust /= self.trust.mean()

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous)."""
        if not self.languages or text is None or not has_letter(text):
            return UNKNOWN, 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margin = self.bits(text) * self.scale + self.offset
        loss = (self.trust * np.logaddexp(0, -self.code * margin)).sum(axis=1)
        rank = np.argsort(loss, kind="stable")
        p = np.exp(loss[rank[0]] - loss)
        second = float(p[rank[1]] / p.sum())
        return self.languages[rank[0]], float(1 / p.sum()), second > AMBIGUOUS


def fit(docs: DataFrame, *, sample_per_language: int = SAMPLE_PER_LANGUAGE, languages_at_most: int = LANGUAGES) -> Model:
    """Learn from ``doc_id, text, lang`` of rows with a language, at most ``sample_per_language`` of each of the most frequent ones."""
    rows = docs.select(
        "doc_id",
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
    ).filter("lang is not null and text is not null")
    held = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages_at_most).collect()}
    if not held:
        return Model([], np.zeros((0, _SIZE)))
    languages = sorted(held)
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample_per_language / held[k]))])
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(4)), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    most = sum(min(n, sample_per_language) for n in held.values())
    # rows that repeat share one hash: what they add beyond the bound is cut
    sample = sampled(checkpointed(chosen), most + 4 * int(most**0.5) + 1, "doc_id", "text")

    def count(piece: pa.RecordBatch) -> dict:
        total: dict[str, np.ndarray] = {}
        for text, lang in zip(piece.column("text").to_pylist(), piece.column("lang").to_pylist(), strict=True):
            got = np.bincount(ngrams(text), minlength=_SIZE)
            # a long text counts no more than a short one; whole numbers, so that sums do not depend on their order
            total[lang] = total.get(lang, 0) + np.rint(got * (UNIT / max(1, got.sum()))).astype(np.int64)
        at = {k: np.flatnonzero(x) for k, x in total.items()}
        return {"lang": list(at), "cells": list(at.values()), "n": [total[k][x] for k, x in at.items()]}

    rows = map_steps(sample, "text", "lang string, cells array<long>, n array<long>", count).select("lang", F.explode(F.arrays_zip("cells", "n")).alias("x"))
    summed = rows.groupBy("lang", "x.cells").agg(F.sum("x.n").alias("n")).toArrow()  # 2**BITS rows a language at most
    counts = np.zeros((len(languages), _SIZE))
    row = np.array([languages.index(x) for x in summed.column("lang").to_pylist()], np.int64)
    counts[row, summed.column("cells").to_numpy()] = summed.column("n").to_numpy() * (100 / UNIT)
    model = Model(languages, counts)
    if len(languages) > 1:

        def values(piece: pa.RecordBatch) -> dict:
            return {"lang": piece.column("lang"), "bits": [model.bits(x).tolist() for x in piece.column("text").to_pylist()]}

        got = map_steps(sample, "text", "lang string, bits array<double>", values).collect()  # a bounded sample
        got.sort()
        if got:
            model.calibrate(np.array([r["bits"] for r in got]), np.array([languages.index(r["lang"]) for r in got]))
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous`` for every row; only ``text`` is looked at."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(piece: pa.RecordBatch) -> dict:
        got = [held.value.decode(x) for x in piece.column("text").to_pylist()]
        return {"doc_id": piece.column("doc_id"), "lang_pred": [x[0] for x in got], "score": [x[1] for x in got], "ambiguous": [x[2] for x in got]}

    return map_steps(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        "text",
        "doc_id long, lang_pred string, score double, ambiguous boolean",
        work,
    )


def held_out(modulus: int, remainder: int) -> Column:
    """True for documents kept out of learning; a null id is not kept out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))
