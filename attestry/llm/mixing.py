"""Mix sources to target weights: capped water-filling, then seeded whole and fractional repetitions (DataFrame functions only).

A document's size is its number of words (``[^\\x20\\x09-\\x0D]+``).  The mix has ``budget`` times the words of all documents;
a source's share follows its weight, but no source is read more than ``epochs`` times.  What a source above that has
too much is shared among the others by weight, again and again, until none is above: the level L is found with
target = min(epochs * size, L * weight).  All of that is exact integer arithmetic; a round is one aggregate over the table
of sources, and only its two sums reach the driver.

A source with target t and size s gives t // s whole repetitions of every document and, of the rest, the documents that come
first in an order by a seeded digest, until the rest is used up; the one at the edge gives its first words.  The edge is
found by two histograms over leading digits of the digest (DIGITS each, added up before the shuffle) and then among
the few documents that share them, so that no source's documents are gathered or sorted, however many it has.

Nulls: a null text has size 0, a null source is a source of its own, after all others; ids may be null or repeat.  Rows with
equal id and text have one digest, and share what falls to them at the edge in proportion (rounded down).  A source
without words, or without a weight, has target 0.  An empty table gives an empty result.  Other columns are not touched:
``mix`` returns its own columns only, and ``repeated`` the documents' columns with the copy's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stored

#: hexadecimal digits of a digest by which documents are first added up, twice
DIGITS = 3
_BIG = "decimal(38,0)"
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str = "text") -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def digest_of(seed: int, doc_id: str = "doc_id", text: str = "text") -> Column:
    """32 hexadecimal digits, by which documents are drawn."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))))


def numbered(sources: DataFrame) -> DataFrame:
    """Sources with ``place``, from 0, by code point, null last: ranges, and one count for each range."""
    spark = sources.sparkSession
    parts = max(1, -(-sources.count() // 1_000_000))
    ranged = sources.repartitionByRange(parts, F.col("source").isNull(), F.col("source")).sortWithinPartitions(F.col("source").isNull(), "source")
    held = stored(ranged.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = held.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row for each million sources
    before, rows = 0, []
    for r in counts:
        rows.append((r["part"], before))
        before += r["n"]
    starts = spark.createDataFrame(rows, "part long, before long")
    inside = held.withColumn("part", part).withColumn("inside", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    return inside.join(starts, "part").withColumn("place", F.col("before") + F.col("inside")).drop("at", "part", "before", "inside")


def targets(sources: DataFrame, *, budget: tuple[int, int], epochs: int) -> DataFrame:
    """``source, source_size, weight`` with ``target`` (double), ``whole`` repetitions and the words of the ``rest``.

    ``weight`` is a whole number, null for 0; ``budget`` is a fraction of all words."""
    numerator, denominator = budget
    big = lambda x: (F.col(x) if isinstance(x, str) else F.lit(x)).cast(_BIG)
    held = sources.withColumn("weight", F.coalesce(F.greatest("weight", F.lit(0)), F.lit(0)).cast("long"))
    held = held.withColumn("cap", F.when(F.col("weight") > 0, F.col("source_size") * epochs).otherwise(F.lit(0)).cast("long"))
    total = held.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    # the level is above / (denominator * below), with above = numerator * total - denominator * (caps of the clamped)
    clamped, above, below = F.col("cap") == 0, 0, 0
    while True:
        sums = held.agg(F.sum(F.when(clamped, F.col("cap")).otherwise(0)).alias("caps"), F.sum(F.when(clamped, 0).otherwise(F.col("weight"))).alias("weights")).first()
        if not sums["weights"]:
            above, below = 0, 0
            break
        now = (numerator * total - denominator * sums["caps"], sums["weights"])
        if now == (above, below):
            break
        above, below = now
        clamped = (F.col("cap") == 0) | (big(above) * big("weight") > big(denominator * below) * big("cap"))
    free = ~clamped if below else F.lit(False)
    words = F.expr(f"(CAST('{above}' AS {_BIG}) * CAST(weight AS DECIMAL(19,0))) DIV CAST('{max(1, denominator * below)}' AS {_BIG})")
    exact = (big(above) * big("weight")).cast("double") / F.lit(float(max(1, denominator * below)))
    held = held.withColumn("target", F.when(free, exact).otherwise(F.col("cap").cast("double")))
    held = held.withColumn("words", F.when(free, words).otherwise(F.col("cap")))
    some = F.col("source_size") > 0
    held = held.withColumn("whole", F.when(some, F.expr("words DIV source_size")).otherwise(F.lit(0)).cast("long"))
    return held.withColumn("rest", F.col("words") - F.col("whole") * F.col("source_size")).drop("cap", "words")


def _edge(docs: DataFrame, held: DataFrame, key: Column) -> DataFrame:
    """For each source, the key at which its rest is used up (``edge``), what is left for it (``left``) and its words (``among``)."""
    sums = docs.groupBy("source", key.alias("edge")).agg(F.sum("size").alias("among"))
    own = held.select(F.col("source").alias("of"), "rest")
    before = F.sum("among").over(Window.partitionBy("source").orderBy("edge")) - F.col("among")
    found = sums.join(own, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("before", before)
    return found.filter((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("among"))).select(
        F.col("source").alias("of"), "edge", (F.col("rest") - F.col("before")).alias("left"), "among"
    )


def mix(docs: DataFrame, weight: Column, *, budget: tuple[int, int] = (3, 2), epochs: int = 2, seed: int = 20240229) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` and, behind them, ``source`` and ``digest``, for every row of ``docs``
    (``doc_id, text, source``).  ``weight`` is a whole number from a source's ``source`` and ``place``; at most ``budget``
    (a fraction of all words), and at most ``epochs`` times a source."""
    slim = stored(docs.select("doc_id", "source", words_of().alias("size"), digest_of(seed).alias("digest")))
    sources = numbered(slim.groupBy("source").agg(F.sum("size").alias("source_size")))
    plan = stored(targets(sources.withColumn("weight", weight), budget=budget, epochs=epochs))

    # the digits at which a source's rest is used up: first ones, next ones, all
    edges, inside = plan, slim
    for k in range(3):
        key = F.substring("digest", 1 + k * DIGITS, DIGITS) if k < 2 else F.col("digest")
        found = stored(_edge(inside.filter("size > 0"), edges, key))
        edges = found.select(F.col("of").alias("source"), F.col("left").alias("rest"))
        same = found.select("of", F.col("edge").alias("at"))
        inside = inside.join(same, inside["source"].eqNullSafe(same["of"]) & (key == F.col("at")), "left_semi")
    last = found.select(F.col("of"), "edge", "left", "among")
    plan = plan.join(last, F.col("source").eqNullSafe(F.col("of")), "left").select(F.col("source").alias("of"), "source_size", "target", "whole", "rest", "edge", "left", "among")
    part = F.expr("(CAST(size AS DECIMAL(19,0)) * CAST(left AS DECIMAL(19,0))) DIV CAST(among AS DECIMAL(19,0))")
    more = F.when(F.col("edge").isNull() | (F.col("digest") > F.col("edge")), F.lit(0)).when(F.col("digest") < F.col("edge"), F.col("size")).otherwise(part)
    return slim.join(stored(plan), F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + more).cast("long").alias("taken"), "source", "digest"
    )


def repeated(docs: DataFrame, mixed: DataFrame, *, seed: int = 20240229) -> DataFrame:
    """The mix itself: ``docs``'s columns, a row for each repetition (its number from 1 in a new column ``repetition``); the
    last one of a document at the edge has its first words only, up to the blank that follows them."""
    digest = free_name(docs)
    rep = "repetition" if "repetition" not in {c.lower() for c in docs.columns} else free_name(docs, digest)
    names = [F.col(f"d.`{c}`") for c in docs.columns if c != "text"]
    taken = mixed.groupBy("source", "digest").agg(F.max("size").alias("size"), F.max("taken").alias("taken")).filter("taken > 0").alias("t")
    own = docs.withColumn(digest, digest_of(seed)).alias("d")
    both = own.join(taken, F.col(f"d.{digest}").eqNullSafe(F.col("t.digest")) & F.col("d.source").eqNullSafe(F.col("t.source")))
    size, number = F.col("t.size"), F.explode(F.expr("sequence(1L, (t.taken + t.size - 1) DIV t.size)")).alias(rep)
    rows = both.select(*names, F.col("d.text").alias("text"), size.alias(f"{digest}_size"), F.col("t.taken").alias(f"{digest}_taken"), number)
    words = F.least(F.col(f"{digest}_size"), F.col(f"{digest}_taken") - (F.col(rep) - 1) * F.col(f"{digest}_size"))
    cut = F.concat_ws("", F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), words.cast("int")))
    return rows.withColumn("text", F.when(words == F.col(f"{digest}_size"), F.col("text")).otherwise(cut)).drop(f"{digest}_size", f"{digest}_taken")
