"""Hashed word counts and log ratios, in DataFrame functions alone.

A word is a run of letters, digits or underscores, or a run of other signs, lower-cased.
Words are hashed to buckets. Log ratios are whole numbers (millionths): sums of
them don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+"
SCALE = 1_000_000
SMOOTH = 0.5


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def grams(text: Column, buckets: int) -> Column:
    """The buckets of all words, repeats included."""
    return F.transform(words(text), lambda a: F.pmod(F.xxhash64(a), F.lit(buckets)).cast("int"))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text): rows of one id and text have one key."""
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")


def log_ratio(n: Column, total: Column, base: Column, base_total: Column, buckets: int, shrink: float = 0.0, margin: float = 0.0) -> Column:
    """Log of (share of n in total) / (share of base in base_total), in millionths.

    It is moved towards zero by ``shrink`` standard errors and by ``margin``.
    """
    a, b = n + SMOOTH, base + SMOOTH
    ratio = F.log(a / (total + SMOOTH * buckets)) - F.log(b / (base_total + SMOOTH * buckets))
    less = shrink * F.sqrt(1 / a + 1 / b) + margin
    return F.round(F.signum(ratio) * F.greatest(F.lit(0.0), F.abs(ratio) - less) * SCALE).cast("long")


def scores(docs: DataFrame, model: DataFrame, values: list[str], buckets: int) -> DataFrame:
    """(doc_id, text_hash, rows, n, *values): sums of the model's values over each text's words.

    ``model`` has a row for each bucket at most, so it is broadcast: its size is a parameter.
    One row for each id and text; ``rows`` says how many there are.
    """
    exploded = keyed(docs).select("doc_id", "text_hash", F.posexplode_outer(grams(F.col("text"), buckets)).alias("at", "bucket"))
    summed = (
        exploded.join(F.broadcast(model), "bucket", "left")
        .groupBy("doc_id", "text_hash")
        .agg(
            F.count(F.when(F.coalesce("at", F.lit(0)) == 0, 1)).alias("rows"),
            F.count("bucket").alias("n"),
            *(F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values),
        )
    )
    return summed.select("doc_id", "text_hash", "rows", *(F.expr(f"{c} div rows").alias(c) for c in ("n", *values)))


def labelled(docs: DataFrame, labels: DataFrame, most: int, domain: Column, how: str = "inner") -> DataFrame:
    """Rows of ``docs`` with their ``domain``, for a sample of at most ``most`` labelled ids.

    The sample is the ids with the least hashes, so it is the same at every run; its bound
    is that of the broadcast.
    """
    known = labels.select("doc_id", domain.alias("domain")).where("doc_id is not null and domain is not null").dropDuplicates(["doc_id"])
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", how)
