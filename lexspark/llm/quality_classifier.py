"""Importance resampling: documents drawn by how much likelier the target model makes them.

Two bag-of-n-gram models over hashed buckets (words and pairs of words, lower-cased) are counted in one
pass: one over all documents (raw), one over those that the labels call good (target). A task counts into
arrays of ``BUCKETS`` numbers and hands on a row for each bucket at most. A document's weight is the log of the ratio of
its likelihoods under both models: the sum over its n-grams of log(p_target / p_raw), with half a count added to each bucket. Adding Gumbel noise, hashed from the id, and taking the k
greatest draws k documents without replacement in proportion to their weights. k is the
share of labelled documents that are target-like, of all documents.

The k-th greatest key is found exactly by counting: each pass over the keys splits the
range that holds it into ``SPLIT`` bins. Only counts reach the driver.

Defined cases: a null or empty text has weight zero. Rows with one id and text have one weight and
noise and are drawn together; ties at the threshold go to lower ids, nulls first. Without labels
nothing is known and every row is kept. The fit reads at most ``most`` labelled rows;
the raw model and the weights cover all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .ngrams import SCALE, labelled, log_ratio

BUCKETS = 1 << 16
MOST_LABELLED = 100_000
SPLIT = 4096


WORD = re.compile(r"\w+|[^\w\s]+")


class Grams:
    """Buckets of a text's words and pairs of neighbouring words, repeats included."""

    def __init__(self, buckets: int):
        self.buckets, self.known = np.uint64(buckets), {}

    def __call__(self, text: str | None) -> np.ndarray:
        words, known = WORD.findall((text or "").lower()), self.known
        if len(known) > 500_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] + np.uint64(0x632BE59BD9B4E019))
        pairs = (pairs ^ (pairs >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (np.concatenate([h, pairs ^ (pairs >> np.uint64(32))]) % self.buckets).astype(np.int64)


def counted(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, raw, target) of ``docs`` (text, good), in one pass."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums = Grams(buckets), np.zeros((2, buckets), np.int64)
        for batch in batches:
            held: list[list[np.ndarray]] = [[], []]
            size = 0
            for text, good in zip(batch.column(0), batch.column(1).to_pylist()):
                own = grams(text.as_py())
                size += len(own)
                held[0].append(own)
                if good == 1:
                    held[1].append(own)
                if size > 1 << 20:
                    for k in range(2):
                        sums[k] += np.bincount(np.concatenate([*held[k], own[:0]]), minlength=buckets)
                    held, size = [[], []], 0
            for k in range(2):
                if held[k]:
                    sums[k] += np.bincount(np.concatenate(held[k]), minlength=buckets)
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[0][at]), pa.array(sums[1][at])], ["bucket", "raw", "target"])

    rows = docs.select("text", "good").mapInArrow(count, "bucket int, raw long, target long")
    return rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def model(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, buckets: int = BUCKETS) -> tuple[np.ndarray, float | None]:
    """The weight of each bucket, in millionths, and the share of labelled documents in the target."""
    good = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), 0)
    rows = labelled(docs, labels, most, good, how="left").select("text", F.col("domain").alias("good"))
    share = rows.agg(F.avg("good")).first()[0]
    both = written(counted(rows, buckets), "ngrams")
    raw, target = (x or 0 for x in both.agg(F.sum("raw"), F.sum("target")).first())
    weights = np.zeros(buckets, np.int64)
    if not target:  # nothing is known of the target
        return weights, share
    weight = log_ratio(F.col("target"), F.lit(float(target)), F.col("raw"), F.lit(float(raw)), buckets)
    for r in both.select("bucket", weight.alias("weight")).where("weight <> 0").collect():  # ``buckets`` rows at most
        weights[r["bucket"]] = r["weight"]
    return weights, share


def scored(text: Column, weights: np.ndarray) -> Column:
    """struct(n, weight) of a text: its number of n-grams, and the sum of their weights."""

    @F.arrow_udf("struct<n:long,weight:long>")
    def score(texts: pa.Array) -> pa.Array:
        grams = Grams(len(weights))
        rows = [(len(g), int(weights[g].sum())) for g in (grams(t.as_py()) for t in texts)]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(2)], names=["n", "weight"])

    return score(text)


def least_kept(keys: DataFrame, k: int) -> tuple[int, int] | None:
    """The k-th greatest ``key`` (long), and how many rows with that key are among the k; None if all are."""
    n, low, high = keys.agg(F.sum("rows"), F.min("key"), F.max("key")).first()
    if k >= (n or 0):
        return None
    above = 0
    while low < high:
        width = (high - low) // SPLIT + 1
        bins = keys.where(F.col("key").between(low, high)).groupBy(F.expr(f"(key - {low}L) div {width}L").alias("bin")).agg(F.sum("rows").alias("n"))
        for r in sorted(bins.collect(), key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                low, high = low + r["bin"] * width, min(high, low + (r["bin"] + 1) * width - 1)
                break
            above += r["n"]
    return low, k - above


def resampled(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 42) -> DataFrame:
    """(doc_id, n_grams, log_weight, gumbel_key, kept): a row for each row of ``docs``."""
    weights, found = model(docs, labels)
    share = share if share is not None else 1.0 if found is None else found
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), scored(F.col("text"), weights).alias("s")).select("doc_id", "text_hash", "s.*")
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", "text_hash", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    noise = F.round(-F.log(-F.log(uniform)) * SCALE).cast("long")
    keys = written(rows.select("doc_id", "n", "weight", (F.col("weight") + noise).alias("key"), F.lit(1).cast("long").alias("rows")), "gumbel")
    k = round(share * (keys.agg(F.sum("rows")).first()[0] or 0))
    cut = least_kept(keys, k)
    kept = F.lit(True)
    if cut:
        descending = F.bitwise_not(F.coalesce("doc_id", F.lit(-(1 << 62))))
        last = least_kept(keys.where(F.col("key") == cut[0]).select(descending.alias("key"), "rows"), cut[1])
        at_cut = F.lit(True) if last is None else descending >= F.lit(last[0])
        kept = (F.col("key") > cut[0]) | ((F.col("key") == cut[0]) & at_cut)
    return keys.select(
        "doc_id", F.col("n").alias("n_grams"), (F.col("weight") / SCALE).alias("log_weight"), (F.col("key") / SCALE).alias("gumbel_key"), kept.alias("kept")
    )
