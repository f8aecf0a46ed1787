import itertools
import random
import re
import tracemalloc
from unittest import mock

import numpy as np
from pyspark.sql import functions as F

from attestry.llm import langid, packing, quality, topk, toxicity

from .helpers import NASTY, documents, empty

SF = "/root/testdata/sf0.01"


# --- top-k ---------------------------------------------------------------------------------------------------------
def topk_brute(rows, k, is_query):
    whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(whole):
        if is_query(q):
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for m, (c, w) in enumerate(whole) if m != n and len(w) == len(v))
            out += [(q, r, c, -x) for r, (x, c) in enumerate(s[:k], 1)]
    return sorted(out)


def test_topk(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(120)] + [(i, [0.5] * 6) for i in range(120, 140)]
    rows += [
        (200, None),
        (250, []),
        (300, [1.0, None]),
        (350, [float("nan")] * 6),
        (400, [float("inf")] * 6),
        (None, [1.0] * 6),
        (450, [1.0, 2.0]),
        (451, [2.0, 2.0]),
        (50, [rng.uniform(-1, 1) for _ in range(6)]),
    ]
    rows += [(130, [0.5] * 6), (130, [0.25] * 6), (7, [5.0] * 6), (7, [1.0] * 6), (463, [2.0**40, 1.0]), (461, [2.0**40, 2.0]), (462, [0.0, 3.0])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit(1)).withColumn("v", F.lit("x"))
    want = topk_brute(rows, 5, lambda i: i % 10 == 0)
    for shard, block in ((8192, 1024), (16, 3)):
        got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 10 == 0, shard_rows=shard, block_rows=block).collect()))
        assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_tree_boxes_are_tight():
    points = np.random.default_rng(0).integers(-9, 9, (500, 3)).astype(float)
    tree = topk.Tree(np.arange(500), points, leaf=8)
    for (a, b), lo, hi in zip(tree.span, tree.lo, tree.hi, strict=True):
        assert (tree.points[a:b].min(axis=0) == lo).all() and (tree.points[a:b].max(axis=0) == hi).all()


# --- language ------------------------------------------------------------------------------------------------------
def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 6, 9, 20):
        code = langid.codewords(n)
        assert min((a != b).sum() for a, b in itertools.combinations(code, 2)) >= (1 if n == 2 else 2)
        assert (abs(code.sum(axis=0)) < n).all()


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.held_out(4, 2)
    got = langid.identify(docs, langid.fit(docs.filter(~out))).join(docs.select("doc_id", "lang", out.alias("held")), "doc_id").filter("held")
    assert got.filter("lang = lang_pred").count() >= 0.97 * got.count()
    assert got.filter("score < 0 or score > 1").count() == 0


def test_language_edges(spark):
    docs = documents(spark, NASTY)
    model = langid.fit(docs)
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    letters = [x is not None and any(c.isalpha() for c in x) for x in NASTY]
    assert all((got[i] in ("en", "de")) == ok and (got[i] == "und") != ok for i, ok in enumerate(letters))
    nothing = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    one = langid.fit(docs.withColumn("lang", F.lit("xx")))
    assert {r.lang_pred for r in langid.identify(docs, one).collect()} == {"und", "xx"}
    assert langid.identify(empty(spark), model).count() == 0


def test_letters_and_numerals(spark):
    docs = documents(spark, ["½ ² ①", "Ⅷ ٣ _ 7", "ª", "中", "x²"])
    model = langid.fit(documents(spark, ["one fine day", "ein guter Tag"]))
    assert [r.lang_pred == "und" for r in sorted(langid.identify(docs, model).collect(), key=lambda r: r.doc_id)] == [True, True, False, False, False]


def ngrams_brute(text):
    raw = (" " + text.lower() + " ").encode("utf-8", "replace")
    form = [c if 97 <= c <= 122 or c >= 128 and c != 0xC2 else 32 for c in raw]
    codes = [c + 1 for c in form if c != 32]
    codes += [(a << 8 | b) + (1 << 20) for a, b in itertools.pairwise(form) if (a, b) != (32, 32)]
    codes += [(form[i] << 16 | form[i + 1] << 8 | form[i + 2]) + (1 << 30) for i in range(len(form) - 2) if form[i : i + 3] != [32] * 3]
    return [(c * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - langid.BITS for c in codes]


def test_language_against_brute_force(spark):
    """The whole operator once more in plain Python: counts, bits, calibration's results as given, weighted decoding."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    model = langid.fit(docs)
    langs = sorted({x for _, t, x in rows if t is not None and x is not None})
    assert model.languages == langs
    size = 1 << langid.BITS
    counts = {x: [0.5] * size for x in langs}
    for _, text, lang in rows:
        if text is not None and lang is not None:
            grams = ngrams_brute(text)
            got = {}
            for g in grams:
                got[g] = got.get(g, 0) + 1
            for g, n in got.items():
                counts[lang][g] += round(n * (langid.UNIT / len(grams))) * (100 / langid.UNIT)
    share = {x: [c / sum(counts[x]) for c in counts[x]] for x in langs}
    bits = []
    for bit in range(model.code.shape[1]):
        on, off = ([x for k, x in enumerate(langs) if (model.code[k, bit] > 0) == side] for side in (True, False))
        bits.append([np.log(sum(share[x][g] for x in on) / len(on)) - np.log(sum(share[x][g] for x in off) / len(off)) for g in range(size)])
    found = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for i, text, _ in rows:
        if text is None or not any(c.isalpha() for c in text):
            assert found[i].lang_pred == "und" and found[i].score == 0
            continue
        grams = ngrams_brute(text)
        loss = []
        for k in range(len(langs)):
            loss.append(sum(model.trust[b] * np.log1p(np.exp(-model.code[k, b] * (model.scale[b] * sum(bits[b][g] for g in grams) / len(grams) + model.offset[b]))) for b in range(len(bits))))
        p = np.exp(min(loss) - np.array(loss))
        assert found[i].lang_pred == langs[int(np.argmin(loss))] and abs(found[i].score - 1 / p.sum()) < 1e-6
        assert found[i].ambiguous == (sorted(p / p.sum())[-2] > langid.AMBIGUOUS)


# --- quality -------------------------------------------------------------------------------------------------------
def test_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    step = rng.normal(size=(2, 2))
    unary = [rng.normal(size=n) for n in (1, 4, 6, 2)]
    for u, got in zip(unary, quality.marginals(unary, step), strict=True):
        total, good = 0.0, np.zeros(len(u))
        for y in itertools.product((0, 1), repeat=len(u)):
            w = np.exp(sum(u[i] for i in range(len(u)) if y[i]) + sum(step[a, b] for a, b in itertools.pairwise(y)))
            total += w
            good += w * np.array(y)
        assert np.allclose(got, good / total)


def test_quality_memory_grows_with_text_alone():
    texts = [b"a b\n"] * 999 + [b"x\n" * 60_000]
    model = quality.Model()
    tracemalloc.start()
    scores = model.scores(texts)
    assert tracemalloc.get_traced_memory()[1] < 120 << 20 and len(scores) == 1000
    tracemalloc.stop()
    for text in (b"", b"one", b"one\n\ntwo words\n" * 40):
        x, n = quality.sequence(text)
        with mock.patch.object(quality, "LINES", 7):
            u, m = quality.potentials(text, np.arange(quality.FEATURES, dtype=float))
        assert np.allclose(u, x @ np.arange(quality.FEATURES)) and (n == m).all()


def test_quality_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = langid.held_out(5, 0)
    model = quality.fit(docs, labels.filter(~out))
    got = quality.score(docs, model).join(labels.filter(out), "doc_id").withColumn("p", (F.col("score") >= quality.THRESHOLD).cast("int"))
    assert got.filter("p = quality").count() >= 0.95 * got.count()


def test_quality_edges(spark):
    docs = documents(spark, NASTY)
    labels = spark.createDataFrame([(5, 1), (6, 1), (9, 0), (9, 1), (None, 1), (7, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model)
    assert got.count() == len(NASTY) and got.filter("score between 0 and 1").count() == len(NASTY)
    docs = docs.withColumns({"__score": F.lit("x"), "attestry_0": F.lit("y")})
    kept = quality.accepted(docs, model, threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == len(NASTY)
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.score(empty(spark), model).count() == 0


# --- toxicity ------------------------------------------------------------------------------------------------------
def test_grammar():
    s = toxicity.Scorer(toxicity.Lexicon())
    marks = lambda x: "".join(m for _, _, m in s.clauses(x))
    for text, want in {
        "what an idiot": "",
        "you are an idiot": "a",
        "idiots like you": "a",
        "an idiot is what some of them call it": "",
        "you are not an idiot": "d",
        "she said you idiot": "q",
        "she said so. what an idiot": "",
        "they kill time": "V",
        "to kill time": "",
        "that was really an idiot": "s",
        "that was the day of some other idiot": "",
        "we will soon burn it": "t",
        "he will burn it": "T",
        "i will kill you": "tT",
        "i will never hurt you": "d",
        "he wrote that he will burn it": "q",
        "trash, scum and vermin": "pp",
        "a clown here\nand there\na moron. some scum": "PP",
        "a quiet day\nidiot": "",
        "": "",
    }.items():
        assert marks(text) == want, text
    assert s.clauses("fine. you are an idiot. fine") == [(2, 6, "a")]


def test_composition_equals_one_after_another():
    rng = random.Random(5)
    T = toxicity
    symbols = "oivlwgnrstqdaTV$"
    stages = [T.Transducer(0, T._after(T.LINK, 4, {T.INSULT: T.STATED}), symbols), T.Transducer(0, T._after(T.INTEND, 3, {T.VIOLENT: T.THREAT}), symbols)]
    stages += [
        T.Transducer(False, T._from(T.REPORT, dict.fromkeys(T.HARM, T.QUOTED)), symbols),
        T.Transducer(0, T._after(T.NEGATION, 3, dict.fromkeys(T.HARM, T.DENIED)), symbols),
    ]
    stages += [T.Transducer((False, "", 0), T._aimed(4), symbols), T.Transducer((False, False), T._piled, symbols)]
    whole = toxicity.grammar()
    for _ in range(200):
        word = [rng.choice("oivlwgnr$") for _ in range(20)]
        now = word
        for m in stages:
            state, out = m.start, []
            for c in now:
                state, o = m.table[state][c]
                out.append(o)
            now = out
        state, got = whole.start, []
        for c in word:
            state, o = whole.table[state][c]
            got.append(o)
        assert got == now


PLANTED = {
    "I will kill you": True,
    "You are an idiot.": True,
    "Idiots like you ruin it.": True,
    "We will hurt those people.": True,
    "You pathetic loser": True,
    "Du bist ein Idiot": True,
    "We will not kill anyone": False,
    "He said you are an idiot": False,
    "You are not an idiot.": False,
    "Nobody said that they will attack us": False,
    "idiot": False,
    "Trash goes out on Monday.": False,
    "How to kill time on trains": False,
    "They beat the eggs until stiff.": False,
    "The path of a wort and a clown fish.": False,
    "": False,
}


def _any_insult(text):
    return any(w in toxicity.INSULTS for w in re.findall(r"[^\W\d_]+", text.lower()))


def test_clauses_decide_and_not_words(spark):
    """On planted sentences, by the link of a fit on real labels: better than the rule that any insult word is toxic."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scorer = toxicity.fit(docs, labels.filter(~langid.held_out(5, 0)))
    got = {text: scorer.score(scorer.clauses(text)) for text in PLANTED}
    assert {text: x >= 0.5 for text, x in got.items()} == PLANTED, got
    assert sum(_any_insult(text) == toxic for text, toxic in PLANTED.items()) < len(PLANTED) - 4
    assert not {s for s in scorer.lexicon.stems if any(w.startswith(s) for w in scorer.lexicon.fixed) and s in ("path", "wort", "tras", "clow")}


def test_toxicity_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = langid.held_out(5, 0)
    got = toxicity.score(docs, toxicity.fit(docs, labels.filter(~out))).join(labels.filter(out), "doc_id")
    toxic, clean = got.filter("toxic = 1"), got.filter("toxic = 0")
    print("toxicity held out:", toxic.filter("score >= 0.5").count(), toxic.count(), clean.filter("score >= 0.5").count(), clean.count())
    assert toxic.filter("score >= 0.5").count() >= 0.8 * toxic.count() and clean.filter("score >= 0.5").count() <= 0.02 * clean.count()


def test_toxicity_edges(spark):
    docs = documents(spark, [*NASTY, "you idiot", "a fine day"])
    labels = spark.createDataFrame([(len(NASTY), 1), (len(NASTY) + 1, 0), (5, 0), (5, 1), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(got) == len(NASTY) + 2 and all(0 <= x <= 1 for x in got.values()) and got[len(NASTY)] > got[len(NASTY) + 1]
    none = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()}
    assert none[len(NASTY)] > 0.5 and none[0] == 0.0
    assert toxicity.score(empty(spark), toxicity.Scorer(toxicity.Lexicon())).count() == 0


# --- packing -------------------------------------------------------------------------------------------------------
def test_boundaries_are_optimal():
    rng = random.Random(7)
    for _ in range(60):
        h = {s: rng.randint(1, 20) for s in rng.sample(range(1, 40), rng.randint(1, 9))}
        sizes = sorted(h)
        for k in (1, 2, 3, 20):
            pad = lambda bounds: sum(n * (min(b for b in bounds if b >= s) - s) for s, n in h.items())  # noqa: B023, E731
            best = min(pad([*c, sizes[-1]]) for r in range(min(k, len(sizes))) for c in itertools.combinations(sizes[:-1], r))
            got = packing.optimal_boundaries(h, k)
            assert len(got) == min(k, len(sizes)) and got == sorted(got) and pad(got) == best
    assert packing.optimal_boundaries({}, 4) == []


def test_packing_places_everything_once(spark):
    rng = random.Random(3)
    texts = [*NASTY, *[" ".join("w" for _ in range(rng.choice([1, 5, 5, 40, 300]))) for _ in range(200)]]
    docs = documents(spark, texts)
    got = packing.pack(docs, max_tokens=64, buckets=4, budget=256, lane_batches=2).collect()
    words = lambda x: 1 + len([w for w in __import__("re").split("[\x20\x09-\x0d]+", x or "") if w])
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.tokens
        assert r.tokens <= r.bucket
    assert total == {i: words(x) for i, x in enumerate(texts)}
    assert len({(r.batch, r.slot) for r in got}) == len(got)
    for batch in {r.batch for r in got}:
        own = [r for r in got if r.batch == batch]
        assert len({r.bucket for r in own}) == 1 and len(own) * own[0].bucket <= max(256, own[0].bucket)
        assert sorted(r.slot for r in own) == list(range(len(own)))
    again = packing.pack(docs.repartition(7), max_tokens=64, buckets=4, budget=256, lane_batches=2)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))  # whatever the layout
    assert packing.summary(packing.pack(docs)).agg(F.sum("pieces")).first()[0] >= len(texts)
    assert packing.pack(empty(spark)).count() == 0
