"""Near copies for the pipeline's stage: SimHash groups, joined by verified similarity.

Besides what ``simhash`` links, documents whose sets of five-word shingles have Jaccard similarity
``SIMILARITY`` or more are linked. Candidates share one of ``BANDS`` bands of ``ROWS`` least hashes
each, which a pair at similarity 0.8 misses with probability 0.0004. Each band's first document (by
text hash) is compared with the other members on their whole sets; members that it isn't like are grouped anew by one
more least hash, which documents at similarity 0.8 share four times in five, then by two more, four and so on until each is alone. So many like
documents give a pair each, and many unlike ones that share a passage fall apart in a few rounds, not pair by pair.

A document that is like one linked already, but not like that one's source, has the other bands to meet it.
Texts are told apart by their hash, so several texts of one id are several documents.

Defined cases: texts of under five words have no shingles and are left to ``simhash``, null and empty ones
(fingerprint zero) among them. Rows without an id stay. Of repeated rows one stays; ties go to the least id, then text hash.
An empty table gives no rows; extra columns are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, release, written
from .graph import connected_components
from .simhash import first_of_each, rooted
from .substring_dedup import _ODD, Shingler, mixed

SIMILARITY = 0.8
BANDS, ROWS = 20, 5
SIGNATURE = "text_hash long, n long, whole long, bands array<long>, least array<int>"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingles = Shingler()
    odd = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _ODD[3]) | np.uint64(1)
    for batch in batches:
        out: list[tuple] = []
        for text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            s = np.unique(shingles(text.as_py()))
            if not len(s):
                continue
            least = np.array([(s * k).min() for k in odd]).reshape(BANDS, ROWS)
            bands = mixed((mixed(least) * _ODD[:ROWS]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _ODD[6])
            out.append((text_hash, len(s), xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63), bands.view(np.int64).tolist(), (least >> np.uint64(40)).astype(np.int32).ravel().tolist()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = [c.split()[0] for c in SIGNATURE.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)
        del out
        release()


def similar(text, source):
    """Whether two texts' sets of shingles are alike."""

    @F.arrow_udf("boolean")
    def alike(texts: pa.Array, sources: pa.Array) -> pa.Array:
        shingles, last, out = Shingler(), (None, None), []
        for a, b in zip(texts, sources):
            if last[0] != b:
                last = (b, np.unique(shingles(b.as_py())))
            own = np.unique(shingles(a.as_py()))
            shared = len(np.intersect1d(own, last[1], assume_unique=True))
            out.append(shared > 0 and shared >= SIMILARITY * (len(own) + len(last[1]) - shared))
        del shingles, last
        release()
        return pa.array(out, pa.bool_())

    return alike.asNondeterministic()(text, source)  # else a filter on the result runs it, in another worker, once more


def links(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(u, v) of text hashes of similar documents; pairs within one of ``groups`` (text_hash, root) are left out."""
    named = docs.where("doc_id is not null").select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    signed = written(named.mapInArrow(_signatures, SIGNATURE), "signatures")
    firsts = signed.groupBy("whole").agg(F.min("text_hash").alias("first"))
    found = signed.join(firsts, "whole").where("text_hash <> first").select(F.col("text_hash").alias("u"), F.col("first").alias("v"))
    only = written(signed.join(firsts, "whole").where("text_hash = first").dropDuplicates(["text_hash"]).drop("whole", "first"), "distinct")
    named_groups = only.drop("least").join(groups, "text_hash")
    members = named_groups.select("text_hash", "n", "root", F.posexplode("bands").alias("band", "group"))
    texts, used, more = None, 0, 1  # least hashes that groups share besides their band's, and those of the next round
    while True:
        members = written(members, "members")
        sources = members.groupBy("group").agg(F.min(F.struct("text_hash", "n", "root")).alias("s"), F.min("root").alias("a"), F.max("root").alias("z")).where("a <> z")
        sources = sources.select("group", *(F.col(f"s.{c}").alias(f"source_{c}") for c in ("n", "root")), F.col("s.text_hash").alias("source_hash"))
        pairs = written(members.join(sources, "group").where("text_hash <> source_hash"), "pairs")
        discard(members)
        if pairs.isEmpty():
            return found
        near = F.least("n", "source_n") >= SIMILARITY * F.greatest("n", "source_n")
        asked = written(pairs.where((F.col("root") != F.col("source_root")) & near).select("text_hash", "source_hash").distinct(), "asked")
        if texts is None:  # later rounds ask for other documents of these groups
            ids = pairs.select("text_hash").union(pairs.select("source_hash")).distinct()
            texts = written(named.join(ids, "text_hash", "left_semi").dropDuplicates(["text_hash"]), "texts")
        both = asked.join(texts, "text_hash").join(texts.select(F.col("text_hash").alias("source_hash"), F.col("text").alias("source")), "source_hash")
        alike = written(both.select("text_hash", "source_hash", similar(F.col("text"), F.col("source")).alias("ok")).where("ok").distinct(), "alike")
        found = found.union(alike.select("text_hash", "source_hash"))
        # Those unlike their group's source meet again, without it, where they share more least hashes.
        left = pairs.where("root <> source_root").join(alike, ["text_hash", "source_hash"], "left_anti").select("text_hash", "n", "root", "band", "group")
        at = lambda k: F.pmod((F.col("band") + 1) * ROWS + k, F.lit(BANDS * ROWS)) + 1
        finer = F.xxhash64("group", *(F.element_at("least", at(k)) for k in range(used, min(used + more, BANDS * ROWS))))
        members = left.join(only.select("text_hash", "least"), "text_hash").withColumn("group", finer).drop("least")
        used, more = used + more, 2 * more


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies: the first row (by id, then text hash) of each group stays."""
    rows = written(rooted(docs), "groups")
    of = written(rows.where("doc_id is not null").select("text_hash", "root").distinct(), "roots")  # a text has one fingerprint
    pairs = links(docs, of)
    edges = pairs.join(of.select(F.col("text_hash").alias("u"), F.col("root").alias("a")), "u").join(of.select(F.col("text_hash").alias("v"), F.col("root").alias("b")), "v")
    reached = connected_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    whole = rows.join(reached, rows["root"] == reached["node"], "left").select("doc_id", "text_hash", F.coalesce("component", "root").alias("root"))
    return first_of_each(docs, whole)
