"""Comparison of processing modes, gates and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scored(modes: DataFrame) -> DataFrame:
    """modes with `score`: 100 a rank of status, spot ratio, word difference, warnings, failures and references.

    modes: doc_id, mode, mode_ord, status, word_diff, spot_ratio, warnings, failures, refs.
    A null metric costs 15.
    """
    rank = F.when(F.col("status") == "PASS", 2).when(F.col("status") == "WARN", 1).otherwise(0)
    # greatest() and least() pass over nulls, so these are asked for first
    spot = F.when(F.col("spot_ratio").isNull(), -15.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("spot_ratio"))) * 40)
    diff = F.when(F.col("word_diff").isNull(), -15.0).otherwise(-F.greatest(F.lit(0.0), F.col("word_diff")) * 2)
    return modes.withColumn("score", rank * 100 + spot + diff - F.col("warnings") * 6 - F.col("failures") * 20 + F.col("refs") * 0.2)


def best(modes: DataFrame) -> DataFrame:
    """(doc_id, mode, status, score): the highest score among the modes that did not fail, or among all; first on ties."""
    w = Window.partitionBy("doc_id").orderBy((F.col("status") == "FAIL").cast("int"), F.desc("score"), "mode_ord")
    return modes.withColumn("r", F.row_number().over(w)).where("r = 1").select("doc_id", "mode", "status", "score")


def failed(modes: DataFrame) -> DataFrame:
    """The rows of modes that ended in an error: FAIL, no metrics, score -100. modes: doc_id, mode, mode_ord."""
    null = F.lit(None).cast("double")
    return modes.select(
        "doc_id", "mode", "mode_ord", F.lit("FAIL").alias("status"), null.alias("word_diff"), null.alias("spot_ratio"), F.lit(1).alias("warnings"),
        F.lit(1).alias("failures"), F.lit(0).alias("refs"), F.lit(-100.0).alias("score"),
    )


def metric(col, precision: int):
    """A metric as text: n/a for null."""
    return F.when(col.isNull(), "n/a").otherwise(F.format_string(f"%.{precision}f", col.cast("double")))


def confidence_gate(found: DataFrame) -> DataFrame:
    """found with `gate`: appendix below 50, flag below 80, else keep."""
    c = F.col("confidence")
    return found.withColumn("gate", F.when(c < 50, "appendix").when(c < 80, "flag").otherwise("keep"))


def precision_tiers(found: DataFrame) -> DataFrame:
    """found with `tier`: A from 95, B from 90, flag from 85, else retry."""
    c = F.col("confidence")
    return found.withColumn("tier", F.when(c >= 95, "A").when(c >= 90, "B").when(c >= 85, "B-flag").otherwise("retry"))


def comparison(modes: DataFrame, most: int = 20) -> DataFrame:
    """(doc_id, report): a Markdown table of the scored modes, best first."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "mode", "status", metric(F.col("score"), 2), metric(F.col("word_diff"), 2), metric(F.col("spot_ratio"), 3)), F.lit(" |"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "mode_ord")
    rows = modes.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).withColumn("row", row)
    return rows.groupBy("doc_id").agg(F.expr("listagg(row, '\\n') within group (order by r)").alias("report"))


def manifest(papers: DataFrame, chunks: DataFrame, refs: DataFrame, lint: DataFrame) -> DataFrame:
    """(doc_id, manifest): a JSON object a paper with its counts. papers: doc_id, slug; lint: doc_id, status, finding_count."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    j = papers.join(n, "doc_id", "left").join(refs, "doc_id", "left").join(lint, "doc_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    body = F.struct(F.struct("slug").alias("paper"), F.struct(z("chunks").alias("total_chunks")).alias("chunking"), F.struct(z("refs").alias("count")).alias("references"), F.struct(F.coalesce("status", F.lit("UNKNOWN")).alias("status"), z("finding_count").alias("finding_count")).alias("lint"))
    return j.select("doc_id", F.to_json(body).alias("manifest"))
