"""Evaluation of replies: buckets, tallies and rates per category and over all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import rate
from ..functions.text import chart_signals, defenced, is_json, is_json_object, reply_shape

POLICY_FAMILIES = ("label", "security", "scale")
BUCKETS = ("verified", "schema", "semantic", "policy")
FAULTS = ("off_request", "prompt_policy", "upstream_fault", "harness_error")
SHAPES = ("fenced", "bare_object", "empty", "other")
NOTICE = "This chart was withheld because its data was not recomputed and checked."


def verdict_bucket(verified: Column, layer: Column, results: Column) -> Column:
    """``verified``, ``schema`` (failed while decoding), ``policy`` (only policy checks failed) or ``semantic``."""
    failing = F.filter(results, lambda r: r["status"] == "fail")
    policy = F.forall(failing, lambda r: (r["method"] == "resource_policy") | F.split(r["check"], r"\.")[0].isin(*POLICY_FAMILIES))
    return F.when(verified, "verified").when(layer == "decode", "schema").when((F.size(failing) > 0) & policy, "policy").otherwise("semantic")


def fault_bucket(status: Column, detail: Column, pin_mismatch: str) -> Column:
    return F.when((status == 502) & (detail == pin_mismatch), "off_request").when(status == 422, "prompt_policy").when(status >= 500, "upstream_fault").otherwise("harness_error")


def with_reply_facts(df: DataFrame, reply: str) -> DataFrame:
    """``shape, json_valid, json_object, defenced_valid`` of a reply column."""
    c = F.col(reply)
    return df.withColumns({"shape": reply_shape(c), "json_valid": is_json(c), "json_object": is_json_object(c), "defenced_valid": is_json(defenced(c))})


def tallies(details: DataFrame) -> DataFrame:
    """Counts and rates of ``category, ok, bucket, shape, json_valid, json_object, defenced_valid`` per category and, as
    category NULL with ``scope = 'all'``, over all, in one pass."""
    ok = F.col("ok")
    count = lambda c: F.count_if(ok & c)
    counters = {b: count(F.col("bucket") == b) for b in BUCKETS} | {f: F.count_if(~ok & (F.col("bucket") == f)) for f in FAULTS} | {s: count(F.col("shape") == s) for s in SHAPES} | {k: count(F.col(k)) for k in ("json_object", "json_valid", "defenced_valid")}
    got = details.rollup("category").agg(F.grouping_id().alias("__g"), F.count_if(ok).alias("n"), *[v.alias(k) for k, v in counters.items()])
    rates = {
        "json_object_rate": "json_object",
        "json_validity_rate": "json_valid",
        "schema_failure_rate": "schema",
        "semantic_failure_rate": "semantic",
        "policy_failure_rate": "policy",
        "verified_rate": "verified",
    }
    return got.select(
        F.when(F.col("__g") == 1, "all").otherwise("category").alias("scope"),
        "category",
        "n",
        *counters,
        *[rate(F.col(c), F.col("n")).alias(r) for r, c in rates.items()],
    )


def top_failing(results: DataFrame, n: int = 5) -> DataFrame:
    """``check, failures, rank`` from ``position, check, status``: most frequent first, ties by first appearance."""
    got = results.filter("status = 'fail'").groupBy("check").agg(F.count("*").alias("failures"), F.min("position").alias("first"))
    top = got.orderBy(F.desc("failures"), "first").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("failures"), "first"))).select("check", "failures", "rank")


def with_chart_signals(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("signals", chart_signals(F.col(column)))


def guard_last(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The messages with the text of each conversation's last one replaced by a notice, where an assistant's reply holds
    a chart that nobody recomputed; ``blocked`` marks it."""
    ends = messages.groupBy(conversation).agg(F.max(turn).alias("__last"))
    columns = messages.columns
    messages = messages.join(ends, conversation)
    blocked = (F.col("__last") == F.col(turn)) & (F.col(role) == "assistant") & (F.size(chart_signals(F.col(text))) > 0)
    return messages.withColumn("blocked", F.coalesce(blocked, F.lit(False))).withColumn(
        text,
        F.when(F.col("blocked"), NOTICE).otherwise(F.col(text)),
    ).select(*columns, "blocked")


def guarantee(verdicts: DataFrame) -> DataFrame:
    """``corpus, n, false_accepts, false_rejects, errors`` of ``corpus, expected, verdict`` ('accept', 'reject', NULL for an error)."""
    got, want = F.col("verdict"), F.col("expected")
    return verdicts.groupBy("corpus").agg(
        F.count("*").alias("n"),
        F.count_if((want == "reject") & (got == "accept")).alias("false_accepts"),
        F.count_if((want == "accept") & (got == "reject")).alias("false_rejects"),
        F.count_if(got.isNull()).alias("errors"),
    )
