import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from attestry.llm import linedup, shingles, simhash, substrings
from attestry.llm.chunks import Rounds
from attestry.llm.common import shared_folder
from attestry.llm.components import components

from .helpers import NASTY, documents, empty, set_in_tasks


def union(n, pairs):
    lab = list(range(n))

    def find(x):
        while lab[x] != x:
            x = lab[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        lab[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# --- substrings ----------------------------------------------------------------------------------------------------
def substrings_brute(rows, length):
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for a in range(len(b) - length + 1):
            w = b[a : a + length]
            if w in seen:
                gone[a : a + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(b))), hashlib.sha256(kept).hexdigest()))
    return out


def test_substrings(spark, monkeypatch):
    rng = random.Random(2)
    make = lambda n: "".join(rng.choice("ab cé") for _ in range(n))
    common = make(400)
    texts = [
        *NASTY,
        *[make(rng.randint(0, 300)) for _ in range(12)],
        common,
        common,
        common[50:260],
        "q" + common[100:200] + "r",
        common[100:199],
        make(99),
        "z" * 400,
        "ab" * 90,
    ]
    for _ in range(12):
        a, n = rng.randint(0, 300), rng.randint(60, 300)
        texts.append(make(rng.randint(0, 50)) + common[a : a + n] + make(rng.randint(0, 50)) + common[a // 2 : a // 2 + 120])
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = documents(spark, [x for _, x in rows], ids=[i for i, _ in rows]).repartition(4)
    got = {r[0]: tuple(r) for r in substrings.digest(substrings.repeated_spans(docs, chunk_bytes=3000)).collect()}
    assert got == {r[0]: r for r in substrings_brute(sorted(rows), 100)}
    short = {r[0]: tuple(r) for r in substrings.digest(substrings.repeated_spans(docs, length=33, chunk_bytes=900)).collect()}
    assert short == {r[0]: r for r in substrings_brute(sorted(rows), 33)}
    for bits in (9,):  # names that many strings share: places are compared and looked for by their strings
        weak = {r[0]: tuple(r) for r in substrings.digest(substrings.repeated_spans(docs, chunk_bytes=3000, name_bits=bits)).collect()}
        assert weak == got
    monkeypatch.setattr(substrings, "DOUBTS_A_PASS", 3000)  # several passes
    assert {r[0]: tuple(r) for r in substrings.digest(substrings.repeated_spans(docs, chunk_bytes=9000, name_bits=4)).collect()} == got
    assert substrings.digest(substrings.repeated_spans(empty(spark))).count() == 0


def test_chunk_table_has_few_files_in_the_shared_folder_and_goes(spark):
    docs = documents(spark, [f"text number {i} " * 9 for i in range(60)])
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "4")
    try:
        with Rounds(docs, chunk_bytes=200) as rounds:
            assert rounds.chunks.count() > 40 and rounds.path.startswith(shared_folder(spark))
        assert spark.sql("SHOW TABLES").filter("tableName like 'attestry_chunks%'").count() == 0
        assert substrings.repeated_spans(docs, chunk_bytes=200).count() == 60
        with pytest.raises(ValueError, match="fails"), Rounds(docs) as rounds:
            raise ValueError("fails")
        assert spark.sql("SHOW TABLES").filter("tableName like 'attestry_chunks%'").count() == 0
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")


def test_substrings_of_rows_without_id_and_repeated_rows(spark):
    t = "".join(random.Random(3).choices("abcd", k=150))
    docs = documents(spark, [t, t, t, t], ids=[None, 5, 5, 6])
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in substrings.repeated_spans(docs).collect()), reverse=True)
    assert got == [(True, 0, 0), (False, 6, 150), (False, 5, 150), (False, 5, 150)]


def test_covers():
    for v, d in substrings.COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))


# --- simhash -------------------------------------------------------------------------------------------------------
def fingerprint_brute(x):
    x = "".join(c.lower() if "A" <= c <= "Z" else c for c in (x or ""))
    w = [t for t in re.split("[\x20\x09-\x0d]+", x) if t]
    if not w:
        return 0
    k = min(3, len(w))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_documents(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(50)]
    base = [rng.choices(words, k=200) for _ in range(6)]
    texts = [*NASTY, " ", "A B c", "a b C"]
    for b in base:
        for _ in range(5):
            c = list(b)
            for _ in range(rng.randint(0, 2)):
                c[rng.randrange(len(c))] = rng.choice(words)
            texts.append(" ".join(c))
    docs = documents(spark, texts)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.digest(simhash.near_duplicate_classes(docs)).collect()}
    v = [fingerprint_brute(x) for x in texts]
    root = union(len(v), [(a, b) for a in range(len(v)) for b in range(a) if (v[a] ^ v[b]).bit_count() <= 2])
    assert got == {i: (f"{v[i]:016x}", root[i]) for i in range(len(v))}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(root)
    assert simhash.near_duplicate_classes(empty(spark)).count() == 0


def test_links_of_dense_fingerprints(spark):
    rng = np.random.default_rng(0)
    vals = set()
    for b in rng.integers(0, 2**63, 15, dtype=np.uint64):
        for _ in range(50):
            x = int(b)
            for bit in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(bit)
            vals.add(x)
    vals = sorted(vals | {0, 1, 3, (1 << 64) - 1, (1 << 63) - 1})
    df = spark.createDataFrame([(simhash._signed(x),) for x in vals], "fp long")
    got = {r.node: r.root for r in components(simhash.fingerprint_links(df)).collect()}
    v = np.array(vals, np.uint64)
    root = union(len(v), zip(*np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= 2), strict=True))
    g, h = collections.defaultdict(set), collections.defaultdict(set)
    for i, x in enumerate(vals):
        g[root[i]].add(x)
        h[got.get(simhash._signed(x), simhash._signed(x))].add(x)
    assert sorted(map(sorted, g.values())) == sorted(map(sorted, h.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- shingles ------------------------------------------------------------------------------------------------------
def shingles_brute(x):
    w = [t for t in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (x or ""))) if t]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_copies_against_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    texts = [*NASTY, "A b C d e", "a B c d E", "a b c", "a b  c"]
    for size in (9, 24, 60, 60, 250, 250, 250, 900):
        base = rng.choices(words, k=size)
        for _ in range(25):
            c = list(base)
            for _ in range(rng.randint(0, 2 + size // 25)):
                c[rng.randrange(len(c))] = rng.choice(words)
            texts.append(" ".join(c + rng.choices(words, k=rng.choice((0, 0, size // 12)))))
    texts += [" ".join(rng.choices(words[:3], k=30)) for _ in range(60)]  # shingles that many sets share
    order = rng.sample(range(len(texts)), len(texts))
    docs = documents(spark, [texts[i] for i in order], ids=order).repartition(4)
    sets = [shingles_brute(x) for x in texts]
    near = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0]
    assert sum(sets[a] != sets[b] for a, b in near) > 100
    root = union(len(sets), near)
    assert {r.doc_id: r.component_id for r in shingles.near_copy_classes(docs).collect()} == dict(enumerate(root))
    monkeypatch.setattr(shingles, "BLOCK", 2)  # more than one block under a shingle
    kept = corpus_pipeline.one_of_near_copies(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(root)
    assert shingles.near_copy_classes(empty(spark)).count() == 0


# --- lines ---------------------------------------------------------------------------------------------------------
def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def edited(rng, text, most):
    b = list(text)
    for _ in range(rng.randint(0, most)):
        o, i = rng.random(), rng.randrange(len(b) + 1)
        if o < 0.33:
            b.insert(i, rng.choice("abé "))
        elif b and o < 0.66:
            b.pop(min(i, len(b) - 1))
        elif b:
            b[min(i, len(b) - 1)] = rng.choice("abé ")
    return "".join(b)


def test_bit_parallel_distance():
    rng = random.Random(3)
    for _ in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        b = edited(rng, a, 4)
        for k in range(4):
            assert linedup.within(a, b, k) == (levenshtein(a, b) <= k), (a, b, k)


def lines_brute(rows, edits, least):
    first, out = {}, {}
    for i, t in rows:
        for n, x in enumerate((t or "").split("\n")):
            if len(x) >= least:
                first.setdefault(x, (i, n))
    near = {x for x in first for y in first if first[y] < first[x] and abs(len(x) - len(y)) <= edits and levenshtein(x, y) <= edits}
    for i, t in rows:
        ls = (t or "").split("\n") if t is not None else []
        out[i] = [n for n, x in enumerate(ls) if len(x) >= least and (first[x] != (i, n) or x in near)]
    return out


def test_lines(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abé dfg") for _ in range(rng.randint(20, 60))) for _ in range(12)]
    texts = list(NASTY)
    for _ in range(40):
        texts.append("\n".join(edited(rng, rng.choice(base), 3) for _ in range(rng.randint(1, 5))))
    rows = list(enumerate(texts))
    docs = documents(spark, texts).repartition(5)
    want = lines_brute(rows, 2, 24)
    for hot in (1 << 18, 6):  # few pairs under a key make it hot
        with set_in_tasks(linedup, HOT=hot, BLOCK=3):
            done = linedup.without_repeated_lines(docs, chunk_bytes=1500)
        assert done.schema == docs.schema
        for r in done.collect():
            t = texts[r.doc_id]
            assert r.text == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[r.doc_id]))
            assert (r.score, r.hits, r["items"], r.key) == (r.doc_id, float(r.doc_id), [r.doc_id], "k")
    got = {r.doc_id: r.n_removed for r in linedup.digest(docs, edits=1, least=20, chunk_bytes=700).collect()}
    assert got == {i: len(x) for i, x in lines_brute(rows, 1, 20).items()}
    assert linedup.digest(empty(spark)).count() == 0


def test_other_columns_of_line_dedup_stay_as_they_are(spark):
    line = "a line that is long enough to take part"
    made = spark.sql(f"""SELECT id AS doc_id, timestamp_ntz'2020-01-01 00:00:00.123456' AS a, map(1, 'x', 2, NULL) AS b, X'00FF' AS c, '{line}' AS text,
        CAST(1.5 AS DECIMAL(38, 10)) AS chunk, timestamp'2020-01-01 00:00:00.123456' AS rows, named_struct('text', 1, 'q', array(1.5D, NULL)) AS blob,
        CAST(NULL AS INT) AS c0, IF(id = 1, NULL, 1L) AS line, date'2020-02-02' AS text_ FROM range(3)""")
    done = linedup.without_repeated_lines(made)
    assert done.schema.simpleString() == made.schema.simpleString()
    assert sorted(done.drop("text").collect(), key=lambda r: r.doc_id) == sorted(made.drop("text").collect(), key=lambda r: r.doc_id)
    assert sorted((r.doc_id, r.text) for r in done.collect()) == [(0, line), (1, ""), (2, "")]


def test_many_lines_of_one_template(spark):
    rng = random.Random(1)
    line = lambda: "2024-01-01 INFO gateway worker finished the request of a client with the trace id " + rng.randbytes(20).hex() + " after a while"
    lines = [line() for _ in range(20_000)]
    near = [x[:90] + ("0" if x[90] != "0" else "1") + x[91:] for x in lines[:50]]
    docs = documents(spark, ["\n".join(lines[i : i + 100]) for i in range(0, 20_000, 100)] + ["\n".join(near)])
    got = {r.doc_id: r.n_removed for r in linedup.digest(docs).collect() if r.n_removed}
    assert got == {200: 50}


def test_lines_of_rows_without_id_and_repeated_rows(spark):
    t = "a line that is long enough to take part\nshort"
    docs = documents(spark, [t, t, t, t], ids=[None, 5, 5, 6])
    got = sorted((r.doc_id or 0, r.n_removed) for r in linedup.digest(docs).collect())
    assert got == [(0, 0), (5, 0), (5, 0), (6, 1)]
