"""The registered queries of this subpackage and, where SQL can say it, the DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import collocations, conversations, decontaminate, langid, linedup, mixing, packing, quality, secrets, simhash, substrings, topk, toxicity
from .common import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.repeated_spans(table(spark, sf_dir, "documents")))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(4, 2)
    model = langid.fit(docs.filter(~out))
    return langid.identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.digest(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(5, 0)
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(~out))
    return quality.score(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(5, 0)
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~out))
    return toxicity.score(docs, scorer).select(
        "doc_id",
        out.alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.size("clauses").cast("long").alias("n_clauses"),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("copy")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.element_at(F.array(F.lit(3), F.lit(1), F.lit(2)), (F.col("place") % 3 + 1).cast("int"))
    return mixing.mix(table(spark, sf_dir, "documents"), weight, budget=(3, 2), epochs=2).select("doc_id", "size", "source_size", "target", "taken")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.digest(rows, conversations.repair(conversations.damaged(rows)))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_substrings": op2_substrings,
    "op3_topk": op3_topk,
    "op4_language": op4_language,
    "op5_simhash": op5_simhash,
    "op6_linededup": op6_linededup,
    "op7_decontamination": op7_decontamination,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_packing": op10_packing,
    "op11_mixing": op11_mixing,
    "op12_conversations": op12_conversations,
    "op13_collocations": op13_collocations,
    "pipeline": corpus_pipeline.run,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: for SQL: a row inserted after a state, a row kept or changed, a row deleted, and no way at all
_INSERT = "{{'c': {0}.c + 5, 'a': {0}.a || 'I', 'r': list_append({0}.r, '{1}:')}}"
_STAY = "{{'c': {0}.c + 5 * truncated + CASE WHEN {2} THEN {1} ELSE 1000000000000 END, 'a': {0}.a || '{4}', 'r': list_append({0}.r, {3} || ':' || text)}}"
_DELETE = "{{'c': {0}.c + 2, 'a': {0}.a || 'D', 'r': {0}.r}}"
_NO_WAY = "{'c': 1000000000000, 'a': '', 'r': CAST([] AS VARCHAR[])}"


def _keep(state: str, initial: str) -> str:
    return _STAY.format(state, 0, f"free AND role[1] = '{initial}'", "role", "K")


def _rerole(state: str, role: str) -> str:
    return _STAY.format(state, 1, "free", f"'{role}'", "R")


SQL: dict[str, str] = {
    "op3_topk": """
        WITH ok AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
                    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(e, lambda x: CAST(floor(256 * x) AS BIGINT)) AS v FROM ok),
        s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.n <> c.n AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op6_linededup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS ls FROM documents),
        l AS (SELECT doc_id, ls[k] AS line, k FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM d)),
        u AS (SELECT line, length(line) AS n, min((doc_id, k)) AS first FROM l WHERE length(line) >= 24 GROUP BY line),
        near AS (SELECT DISTINCT b.line FROM u a JOIN u b ON a.n BETWEEN b.n - 2 AND b.n + 2 AND a.first < b.first
                 WHERE levenshtein(a.line, b.line) <= 2),
        kept AS (SELECT l.doc_id, l.k, l.line, u.line IS NOT NULL AND (u.first <> (l.doc_id, l.k) OR near.line IS NOT NULL) AS gone
                 FROM l LEFT JOIN u ON l.line = u.line LEFT JOIN near ON l.line = near.line),
        g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
                     coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS kept FROM kept GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)""",
    "op7_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
              FROM benchmark WHERE text IS NOT NULL),
        iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS win
               FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
        dw AS (SELECT doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') AS win
               FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size)),
        hit AS (SELECT dw.doc_id, dw.k, dw.size, iw.item_id FROM dw JOIN iw USING (size, win)),
        words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
               sha256(coalesce(items.ids, '')) AS items_sha256, words.n IS NOT NULL AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_mixing": r"""
        WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                          md5(concat_ws(':', '20240229', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))) AS digest FROM documents),
        s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS n FROM d GROUP BY source),
        p AS (SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS HUGEINT) AS w, sum(n) OVER () AS total FROM s),
        c AS (SELECT *, 12 * n // w AS r, 3 * total - 2 * (sum(2 * n) OVER o - 2 * n) AS above, 2 * (sum(w) OVER () - sum(w) OVER o + w) AS below
              FROM p WINDOW o AS (ORDER BY 12 * n // w, source ROWS UNBOUNDED PRECEDING)),
        l AS (SELECT above AS a, below AS b FROM c WHERE above * w <= below * 2 * n ORDER BY r, c.source LIMIT 1),
        t AS (SELECT source, n, CASE WHEN a * w < b * 2 * n THEN CAST(a * w AS DOUBLE) / CAST(b AS DOUBLE) ELSE CAST(2 * n AS DOUBLE) END AS target,
                     CASE WHEN a * w < b * 2 * n THEN CAST(CAST(a * w AS HUGEINT) // CAST(b AS HUGEINT) AS HUGEINT) ELSE CAST(2 * n AS HUGEINT) END AS words FROM c LEFT JOIN l ON true),
        g AS (SELECT source, digest, CAST(sum(size) AS HUGEINT) AS among FROM d GROUP BY source, digest),
        f AS (SELECT source, digest, among, CAST(sum(among) OVER (PARTITION BY source ORDER BY digest) AS HUGEINT) - among AS before FROM g)
        SELECT d.doc_id, d.size, CAST(t.n AS BIGINT) AS source_size, t.target,
               CAST(CASE WHEN t.n = 0 THEN 0 ELSE words // CAST(t.n AS HUGEINT) * size
                    + CASE WHEN among = 0 THEN 0 ELSE size * greatest(0, least(among, words % CAST(t.n AS HUGEINT) - before)) // among END END AS BIGINT) AS taken
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN f ON d.digest = f.digest AND d.source IS NOT DISTINCT FROM f.source""",
    "op13_collocations": rf"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(coalesce({_LOWER}, ''), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
        t AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM p GROUP BY lang),
        f AS (SELECT lang, size, phrase, CAST(count(*) AS HUGEINT) AS f FROM (
                SELECT lang, size, array_to_string(w[k:k + size - 1], ' ') AS phrase FROM (
                  SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(w) >= size)) GROUP BY ALL HAVING count(*) >= 100),
        c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
        k AS (SELECT lang, phrase, f AS a, array_to_string(w[:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp, k FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
        s AS (SELECT k.lang, k.phrase, a, l.f AS l, r.f AS r, n, k, 1000 * a * n // (l.f * r.f) AS score
              FROM k JOIN f l ON k.lang = l.lang AND k.lp = l.phrase JOIN f r ON k.lang = r.lang AND k.rp = r.phrase JOIN t ON k.lang = t.lang),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        i AS (SELECT lang, array_to_string(w[j:j + m - 1], ' ') AS phrase, max(f) AS over FROM (
                SELECT lang, f, w, m, unnest(range(1, size - m + 2)) AS j FROM (SELECT *, unnest(range(2, size)) AS m FROM c)) GROUP BY ALL)
        SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase,
               CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM b LEFT JOIN i USING (lang, phrase) WHERE over IS NULL OR 100 * over < 100 * a QUALIFY rank <= 2000""",
    "op12_conversations": rf"""
        WITH RECURSIVE d AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
        h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                     xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: CAST(ord(x) AS BIGINT))),
                       lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda e, j: xor(e // 2, 3988292384 * (e % 2))))) % 20 AS fault FROM d),
        a AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                     unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy FROM h WHERE fault <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS kept FROM a),
        f AS (SELECT *, kept = '' AS blank, kept <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
                     lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM o),
        r AS (SELECT *, NOT blank AND NOT duplicate AS free, CAST(NOT blank AND NOT duplicate AND kept[-1] NOT IN ('.', '!', '?') AS BIGINT) AS truncated FROM f),
        p AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, {{'c': CAST(0 AS BIGINT), 'a': '', 'r': CAST([] AS VARCHAR[])}} AS s0, {_NO_WAY} AS s1, {_NO_WAY} AS s2, {_NO_WAY} AS s3 FROM (SELECT DISTINCT conv_id FROM r)
              UNION ALL
              SELECT conv_id, k + 1, {_DELETE.format("s0")}, list_min([{_DELETE.format("s1")}, {_keep("s0", "s")}]),
                     list_min([{_DELETE.format("s2")}, {", ".join(x for s in ("s0", "s1", "s3") for x in (_keep(s, "u"), _rerole(s, "user")))}]),
                     list_min([{_DELETE.format("s3")}, {_keep("s2", "a")}, {_rerole("s2", "assistant")}])
              FROM (SELECT *, list_min([s3_, {_INSERT.format("s2", "assistant")}]) AS s3 FROM (
                      SELECT p.conv_id, k, s0, s1, s3 AS s3_, list_min([s2, {", ".join(_INSERT.format(f"p.{s}", "user") for s in ("s0", "s1", "s3"))}]) AS s2, role, text, free, truncated
                      FROM p JOIN r ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = k + 1))),
        e AS (SELECT conv_id, list_min([s0, s3, {_INSERT.format("s2", "assistant")}]) AS s FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1),
        g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
                     sum(truncated) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
        SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
               CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(s.c, 0) AS BIGINT) AS cost, coalesce(s.a, '') AS audit,
               sha256(coalesce(array_to_string(s.r, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON c.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN e ON c.conv_id IS NOT DISTINCT FROM e.conv_id""",
}
