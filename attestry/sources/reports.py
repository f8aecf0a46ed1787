"""Sinks of an evaluation: its report, its details, and where both come from.

``details`` are one JSON object a line, in as many files as there are partitions; the report is one row, the details'
tallies by category under the run's provenance.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import replies


@dataclass(frozen=True)
class Provenance:
    """Taken once when a run begins, and the same in every row of its report."""

    commit: str | None = None
    dirty: bool = False
    schema_sha256: str | None = None
    probed: str = ""
    model: str | None = None
    device: str | None = None
    structured_output: bool | None = None

    def column(self, tools: Mapping[str, str] | None = None) -> Column:
        types = {"dirty": "boolean", "structured_output": "boolean"}
        own = [F.lit(v).cast(types.get(k, "string")).alias(k) for k, v in asdict(self).items()]
        versions = F.map_from_entries(F.array(*[F.struct(F.lit(k), F.lit(v)) for k, v in sorted((tools or {}).items())]).cast("array<struct<key:string,value:string>>"))
        return F.struct(*own, versions.alias("tools"))


def report(details: DataFrame, provenance: Provenance, tools: Mapping[str, str] | None = None) -> DataFrame:
    """One row: ``provenance``, ``prompt_count``, ``categories`` and ``tallies`` of details as in ``replies.with_reply_facts``."""
    tallies = replies.tallies(details)
    rows = tallies.agg(F.array_sort(F.collect_list(F.struct(*tallies.columns))).alias("tallies"))
    counts = details.agg(F.count("*").alias("prompt_count"), F.array_sort(F.collect_set("category")).alias("categories"))
    return counts.join(rows).select(provenance.column(tools).alias("provenance"), "prompt_count", "categories", "tallies")  # one row each


def write(details: DataFrame, provenance: Provenance, path: str, tools: Mapping[str, str] | None = None) -> None:
    """``details`` and ``report`` below a path; the report goes last, so that one that can be read has its details."""
    details.write.json(f"{path}/details")
    report(details, provenance, tools).coalesce(1).write.json(f"{path}/report")


def read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Details with the columns of ``like``."""
    return spark.read.schema(like.schema).json(f"{path}/details")
