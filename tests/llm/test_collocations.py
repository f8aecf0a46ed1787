import random
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from attestry.llm import collocations, queries

from ..comparing import spark_rows, sql_rows
from .helpers import NASTY, documents, empty, set_in_tasks


def _counts(rows):
    """By reading every window."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for end in ".,;:!?\x0b\x0c\r":
            low = low.replace(end, "\n")
        for piece in low.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            for size in range(1, 6):
                for k in range(len(words) - size + 1):
                    f[lang, tuple(words[k : k + size])] += 1
    return f, n


def _brute(rows, least, most):
    f, n = _counts(rows)
    found = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        if any(b == a and len(q) > len(p) and x == lang and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in f.items()):
            continue
        cuts = [(int(Fraction(1000 * a * n[lang], f[lang, p[:k]] * f[lang, p[k:]])), k) for k in range(1, len(p))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, own in found.items() for i, x in enumerate(sorted(own)[:most])}


def _texts(rng, count):
    words = ["the", "a", "of", "New", "York", "é", "\x00", "|"]
    for _ in range(count):
        yield "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\r"]) for _ in range(rng.randrange(60))) + rng.choice(["", " new york of the a", " ONE two three four five six."])


@pytest.mark.parametrize("hot", [1 << 17, 40])
def test_against_every_window(spark, hot):
    """Also with leading pairs, triples and quadruples that count as hot, rows that repeat, and long texts in parts."""
    rng = random.Random(hot)
    texts = [*_texts(rng, 260), *NASTY, *["one TWO three four five six"] * 90, None]
    docs = documents(spark, texts, ids=[None] * len(texts))
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    with set_in_tasks(collocations, HOT=hot, BUCKET=500):
        got = {tuple(r) for r in collocations.collocations(docs, least=12, most=25).collect()}
    assert got == _brute(rows, 12, 25)


def test_query_is_as_in_sql(spark, tmp_path):
    rng = random.Random(1)
    texts = [*_texts(rng, 900), *NASTY]
    langs = [rng.choice(["en"] * 6 + ["de", "und", None, ""]) for _ in texts]
    spark.createDataFrame(list(zip(texts, langs, range(len(texts)), strict=True)), "text string, lang string, rank int").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.register("documents", pa.table({"text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string())}))
    out = queries.op13_collocations(spark, str(tmp_path))
    cols, want = sql_rows(con, queries.SQL["op13_collocations"])
    assert sorted(out.columns) == cols
    assert want
    assert spark_rows(out) == want


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "STEP_BYTES", 7)
    for text in (b"", b"ab, cd; ef gh ij kl mn. op", b"no end at all in here", b"aaaaaaaaaaaaaaa.b", b"......................"):
        parts = list(collocations._pieces(text))
        assert b"".join(parts) == text
        assert all(p[-1:] in collocations.ENDS for p in parts[:-1] if p)


def test_quicksort_finds_heavy_prefixes():
    rng = np.random.default_rng(3)
    words = np.concatenate([np.zeros((4000, 1), int), rng.integers(0, 4, (4000, 5))], 1)
    for k in range(3, 6):
        words[rng.random(4000) < 0.2, k:] = -1
    weight, known = rng.integers(1, 4, 4000), np.full(4000, 1)
    got = {(tuple(words[row, 1 : depth + 1].tolist()), total) for row, depth, total in collocations.partitions(words, weight, known, 30)}
    sums = Counter()
    for r, w in zip(words.tolist(), weight.tolist(), strict=True):
        for d in range(2, 6):
            if r[d] >= 0:
                sums[tuple(r[1 : d + 1])] += w
    assert got == {(p, n) for p, n in sums.items() if n >= 30}


def test_exact_beyond_64_bits(spark):
    """Counts of 10^10 give products of 10^23 and more."""
    a, left, right, n = 10**10 + 7, 10**11 + 3, 10**12 + 9, 10**13 + 1
    rows = spark.createDataFrame([("x", "p q", a), ("x", "p", left), ("x", "q", right)], "lang string, phrase string, n long")
    total = spark.createDataFrame([("x", n)], "lang string, n long")
    old = collocations.phrase_counts
    try:
        collocations.phrase_counts = lambda docs, least: (rows, total)
        (r,) = collocations.collocations(empty(spark)).collect()
    finally:
        collocations.phrase_counts = old
    assert r["score"] == 1000 * a * n // (left * right)


def test_no_rows(spark):
    assert collocations.collocations(empty(spark)).collect() == []
    assert collocations.collocations(documents(spark, [None, "", "..."])).collect() == []
