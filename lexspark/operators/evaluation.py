"""Relevance of ranked lists against graded judgments. A grade other than zero is relevant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def evaluate(ranked: DataFrame, judgments: DataFrame, k: int) -> DataFrame:
    """(query_id, precision, recall, average_precision, reciprocal_rank, ndcg) from ranked
    (query_id, doc_id, rank from 1) and judgments (query_id, doc_id, grade).

    Precision and recall are at k; average precision and reciprocal rank read the whole list;
    the ideal gain is of the best min(k, length of the list) judged documents.
    """
    queries = ranked.select("query_id").union(judgments.select("query_id")).distinct()
    joined = ranked.join(judgments, ["query_id", "doc_id"], "left").withColumn("rel", (F.coalesce("grade", F.lit(0)) != 0).cast("int"))
    so_far = F.sum("rel").over(Window.partitionBy("query_id").orderBy("rank"))
    gain = lambda grade, rank: (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank.cast("double") + 1)
    within = F.col("rank") <= k
    per = (
        joined.withColumn("found", so_far)
        .groupBy("query_id")
        .agg(
            F.count("*").alias("length"),
            F.coalesce(F.sum(F.when(within, F.col("rel"))), F.lit(0)).cast("double").alias("hit"),
            F.coalesce(F.sum(F.when(F.col("rel") == 1, F.col("found") / F.col("rank"))), F.lit(0.0)).alias("ap"),
            F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
            F.coalesce(F.sum(F.when(within, gain(F.coalesce("grade", F.lit(0)), F.col("rank")))), F.lit(0.0)).alias("dcg"),
        )
    )
    best = judgments.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")))
    ideal = (
        best.join(per.select("query_id", "length"), "query_id", "left")
        .groupBy("query_id")
        .agg(
            F.sum((F.col("grade") != 0).cast("int")).cast("double").alias("relevant"),
            F.coalesce(F.sum(F.when((F.col("place") <= k) & (F.col("place") <= F.coalesce("length", F.lit(0))), gain(F.col("grade"), F.col("place")))), F.lit(0.0)).alias("ideal"),
        )
    )
    over = lambda a, b: F.when(F.coalesce(b, F.lit(0.0)) > 0, F.coalesce(a, F.lit(0.0)) / b).otherwise(F.lit(0.0))
    all_of = queries.join(per, "query_id", "left").join(ideal, "query_id", "left")
    return all_of.select(
        "query_id",
        (F.coalesce("hit", F.lit(0.0)) / float(k) if k else F.lit(0.0)).alias("precision"),
        over(F.col("hit"), F.col("relevant")).alias("recall"),
        over(F.col("ap"), F.col("relevant")).alias("average_precision"),
        F.coalesce(1 / F.col("first").cast("double"), F.lit(0.0)).alias("reciprocal_rank"),
        over(F.col("dcg"), F.col("ideal")).alias("ndcg"),
    )


def macro_average(metrics: DataFrame) -> DataFrame:
    """Means over queries."""
    return metrics.agg(*(F.avg(c).alias(c) for c in metrics.columns if c != "query_id"))
