import math
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attestry.llm import langid, linedup, packing, quality, queries, toxicity
from attestry.llm.common import stored

from ..comparing import database, spark_rows, sql_rows
from .helpers import NASTY, documents, empty
from .test_dedup import shingles_brute, union
from .test_scans import contamination_brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    cols, want = sql_rows(database(SF), queries.SQL[name])
    assert sorted(df.columns) == cols and spark_rows(df) == want


def test_stages_keep_columns_and_drop_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF))
        if name != "packing":
            assert out.columns == docs.columns
        assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = out
    ids = {r.doc_id for r in docs.collect()}
    assert ids and {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == ids


def test_stages_on_awkward_and_empty_tables(spark):
    for docs in (documents(spark, NASTY, extra=False), empty(spark).select("doc_id", "text", "lang", "source", "n_chars")):
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF))
        docs.count()


def quality_brute(text, model):
    """A document's score by sums over neighbouring labels in plain Python, one node after another."""
    if model.constant is not None:
        return model.constant
    x, size = quality.sequence((text or "").encode())
    u = [float(v) for v in x @ model.node]
    step = model.step.tolist()
    mix = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    ahead, behind = [(0.0, u[0])], [(0.0, 0.0)]
    for v in u[1:]:
        a = ahead[-1]
        ahead.append((mix(a[0] + step[0][0], a[1] + step[1][0]), v + mix(a[0] + step[0][1], a[1] + step[1][1])))
    for v in u[:0:-1]:
        b = behind[-1]
        behind.append(tuple(mix(step[k][0] + b[0], step[k][1] + v + b[1]) for k in (0, 1)))
    good = [1 / (1 + math.exp(min(500, a[0] + b[0] - a[1] - b[1]))) for a, b in zip(ahead, behind[::-1], strict=True)]
    mean = sum(g * n for g, n in zip(good, size, strict=True)) / sum(size)
    logit = max(-7.0, min(7.0, math.log((mean + 1e-3) / (1 - mean + 1e-3))))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.link[0] + model.link[1] * mean + model.link[2] * logit))))


def test_quality_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").filter(~langid.held_out(5, 0)))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in queries.op8_quality(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        want = quality_brute(text, model)
        assert abs(got[i].score - want) < 1e-6 and got[i].predicted == (got[i].score >= 0.3)


def toxicity_brute(text, scorer):
    """(score, clauses) with the rules written out, one pass over a clause for each."""
    lexicon = {w: k for k, words in (("link", toxicity.LINKING), ("intent", toxicity.INTENT), ("report", toxicity.REPORTING), ("not", toxicity.NEGATIONS), ("target", toxicity.TARGETS), ("violent", toxicity.VIOLENCE), ("insult", toxicity.INSULTS)) for w in words}
    found, clauses, earlier = [], 0, False
    aims = {"i": "a", "s": "a", "v": "V", "t": "T"}
    for clause in re.split(r"[.!?;\n]+", (text or "").lower()):
        words = [lexicon.get(w) or ("insult" if any(w[:k] in scorer.lexicon.stems for k in range(4, 9)) else "") for w in re.findall(r"[^\W\d_]+", clause)]
        marks, here, open_ = [], False, {}  # open_: harm that a target may still follow
        for i, word in enumerate(words):
            named = "target" in words[:i]
            if word == "target" and not named:
                late = [k for k in open_ if i - k <= 4]
                if late and late[-1] == max(open_):
                    marks.append(aims[open_[late[-1]]])
                    here |= marks[-1] == "a"
            if word not in ("insult", "violent"):
                continue
            stated = word == "insult" and "link" in words[max(0, i - 4) : i]
            threat = word == "violent" and "intent" in words[max(0, i - 3) : i]
            kind = ("s" if stated else "i") if word == "insult" else "t" if threat else "v"
            if "report" in words[:i]:
                mark = "q"
            elif "not" in words[max(0, i - 3) : i]:
                mark = "d"
            elif named:
                mark = aims[kind]
            else:
                open_[i] = mark = kind
            if mark in ("s", "i") and here:
                mark = "p"
            elif mark == "i" and earlier:
                mark = "P"
            here |= mark in ("i", "s", "a", "p", "P")
            if mark not in ("i", "v"):
                marks.append(mark)
        earlier |= here
        found += marks
        clauses += bool(marks)
    z = scorer.link[0] + sum(scorer.link[1 + toxicity.MARKS.index(m)] * min(3, found.count(m)) for m in set(found))
    return (scorer.constant if scorer.constant is not None and not found else 1 / (1 + math.exp(-max(-30.0, min(30.0, float(z)))))), clauses


def test_toxicity_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scorer = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").filter(~langid.held_out(5, 0)))
    for r in queries.op9_toxicity(spark, SF).join(docs.select("doc_id", "text"), "doc_id").collect():
        score, clauses = toxicity_brute(r.text, scorer)
        assert abs(r.score - score) < 1e-9 and r.n_clauses == clauses and r.predicted == (r.score >= 0.5), r.doc_id


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def packing_brute(rows, pieces_seen):
    """Every piece is there once, batches keep their budget, and no boundaries pad less (a plain programme over all of them)."""
    want = {}
    for i, text in rows:
        n = len(words_of(text)) + 1
        for piece in range(-(-n // packing.MAX_TOKENS)):
            want[i, piece] = min(packing.MAX_TOKENS, n - piece * packing.MAX_TOKENS)
    assert {(r.doc_id, r.piece): r.tokens for r in pieces_seen} == want and len(pieces_seen) == len(want)
    batches = {}
    for r in pieces_seen:
        batches.setdefault(r.batch, []).append(r)
    for own in batches.values():
        assert len({r.bucket for r in own}) == 1 and sorted(r.slot for r in own) == list(range(len(own)))
        assert len(own) * own[0].bucket <= max(packing.BUDGET, own[0].bucket)
    sizes = sorted(set(want.values()))
    count = [sum(v == s for v in want.values()) for s in sizes]
    best = [0.0] + [math.inf] * len(sizes)
    for _ in range(packing.BUCKETS):
        best = [0.0] + [min(
            best[j],
            *(best[i] + sum(c * (sizes[j - 1] - s) for s, c in zip(sizes[i:j], count[i:j], strict=True)) for i in range(j)),
        ) for j in range(1, len(sizes) + 1)]
    assert sum(r.bucket - r.tokens for r in pieces_seen) == best[-1]


def test_packing_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    packing_brute(docs, queries.op10_packing(spark, SF).collect())


def test_pipeline_against_brute_force(spark):
    """All five stages once more by plain means; only the quality model is taken as it was fitted."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels.filter(~langid.held_out(5, 0)))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    rows = [(i, x) for i, x in rows if quality_brute(x, model) >= 0.3]
    first, lines = {}, {}
    for i, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            if len(line) >= 24:
                first.setdefault(line, (i, n))
    by_size = {}
    for line in first:
        by_size.setdefault(len(line), []).append(line)
    gone = {x for x in first if any(first[y] < first[x] and linedup.within(y, x, 2) for n in range(len(x) - 2, len(x) + 3) for y in by_size.get(n, ()) if y != x)}
    for i, text in rows:
        kept = [x for n, x in enumerate((text or "").split("\n")) if len(x) < 24 or (first[x] == (i, n) and x not in gone)]
        lines[i] = None if text is None else "\n".join(kept)
    ids = list(lines)
    sets = [shingles_brute(lines[i]) for i in ids]
    near = [(a, b) for a in range(len(ids)) for b in range(a) if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0]
    single = [ids[k] for k in sorted(set(union(len(ids), near)))]
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = contamination_brute([(i, lines[i]) for i in single], benchmark)
    packing_brute([(i, lines[i]) for i in single if not hit[i][4]], corpus_pipeline.run(spark, SF).collect())
