"""SimHash near-duplicates, found with BK-trees.

Fingerprints link at Hamming distance ``RADIUS`` or less; groups are what links reach.
Equal fingerprints collapse first. Two distinct ones within the radius agree on all but
``RADIUS`` of b blocks of bits, so every choice of b - RADIUS blocks is a table whose rows
meet by the value of those blocks, and no link is lost. In each such bucket a BK-tree
(children keyed by their integer distance to the parent) is searched along the edges that
the triangle inequality leaves. b grows with the number of fingerprints, which keeps the
expected bucket small.

A bucket of more than ``SHARD`` fingerprints is dealt into shards. Each shard has a tree of
its own and is sent to every later shard's members as queries, so that no task holds
more than one shard's tree. A tree gives at most one link for each of its components to a
query: links stay linear in the bucket, and they join what all pairs would join.

Defined cases: a null or empty text, or one without words, has fingerprint zero, linked like
any other; under three words the whole sequence is the one shingle. Rows without an id are
linked to nothing (component null) and a stage keeps them. Repeated rows share a group,
of which one row stays. Of different texts with one id each has its own group in a stage; in
``component_id``, which names groups by ids, both show the least id of their groups. Whole texts count.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, written
from .graph import connected_components

RADIUS = 3
SHARD = 4096
#: Expected fingerprints in a bucket, beyond which the blocks get finer.
BUCKET = 64
#: A fingerprint of more than this part of all rows is hot.
HOT = 1000


def shingle_hashes(text: str | None, size: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of lower-cased words, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        joined = [b" ".join(words)]
    else:
        joined = map(b" ".join, zip(*(words[k:] for k in range(size))))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, 42) for s in joined], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit number whose bits are set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, size: int = 3) -> Column:
    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        out = pa.array([majority(shingle_hashes(t.as_py(), size)) for t in texts], pa.int64())
        release()
        return out

    return simhash(text)


class BKTree:
    """Distinct 64-bit numbers by Hamming distance, with the components they form."""

    def __init__(self, radius: int = RADIUS):
        self.radius, self.values, self.kids, self.up, self.whole = radius, [], [], [], None

    def find(self, k: int) -> int:
        up = self.up
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    def insert(self, value: int) -> list[int]:
        """Adds a value; returns one value of each component that it links to."""
        self.whole = None
        links = self.search(value)
        at = len(self.values)
        if at:
            k = 0
            while True:
                d = (value ^ self.values[k]).bit_count()
                if d == 0:
                    return []
                if d not in self.kids[k]:
                    self.kids[k][d] = at
                    break
                k = self.kids[k][d]
        self.values.append(value)
        self.kids.append({})
        self.up.append(at)
        for k in links:
            self.up[self.find(k)] = at
        return [self.values[k] for k in links]

    def close(self) -> None:
        """No more inserts: notes which subtrees lie in one component."""
        self.whole = [self.find(k) for k in range(len(self.values))]
        for k in range(len(self.values) - 1, -1, -1):  # children come after their parent
            if any(self.whole[c] != self.whole[k] for c in self.kids[k].values()):
                self.whole[k] = -1

    def search(self, value: int) -> list[int]:
        """One node within the radius for each component that has any."""
        found: dict[int, int] = {}
        if not self.values:
            return []
        values, kids, whole, radius = self.values, self.kids, self.whole, self.radius
        stack = [0]
        while stack:
            k = stack.pop()
            if whole and whole[k] >= 0 and whole[k] in found:
                continue
            d = (value ^ values[k]).bit_count()
            if d <= radius:
                found.setdefault(self.find(k), k)
            for edge, child in kids[k].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)
        return list(found.values())


def _tree_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (band, key, shard), those to build from first: links (u, v)."""
    group, tree = None, BKTree()
    for batch in batches:
        out: list[tuple[int, int]] = []
        columns = [batch.column(k).to_pylist() for k in range(3)]
        values = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64).tolist()
        for band, key, shard, build, value in zip(*columns, batch.column(3).to_pylist(), values):
            if (band, key, shard) != group:
                group, tree = (band, key, shard), BKTree()
            if build:
                out += [(value, other) for other in tree.insert(value)]
            else:
                if tree.whole is None:
                    tree.close()
                out += [(value, tree.values[k]) for k in tree.search(value)]
        pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["u", "v"])


def block_masks(count: int, radius: int = RADIUS) -> list[int]:
    """Masks (signed) of the choices of blocks that some pair within the radius agrees on."""
    blocks = radius + 1
    while blocks < 16 and count > BUCKET << (64 // blocks * (blocks - radius)):
        blocks += 1
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame, count: int, shard: int = SHARD) -> DataFrame:
    """(u, v) pairs of distinct fingerprints ``fp`` whose components are those of all pairs."""
    masks = block_masks(count)
    banded = distinct.select(
        "fp", F.explode(F.array(*(F.struct(F.lit(k).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)))).alias("b")
    ).select("b.band", "b.key", "fp")
    sizes = banded.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    own = F.when(F.col("n") > shard, F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / shard))).otherwise(F.lit(0)).cast("int")
    dealt = (
        banded.join(sizes, ["band", "key"])
        .select("band", "key", own.alias("own"), "fp")
        .select("band", "key", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("shard"), "own", "fp")
        .select("band", "key", "shard", (F.col("shard") == F.col("own")).alias("build"), "fp")
    )
    sorted_rows = dealt.repartition("band", "key", "shard").sortWithinPartitions("band", "key", "shard", F.desc("build"), "fp")
    return sorted_rows.mapInArrow(_tree_links, "u long, v long")


def _prints(docs: DataFrame, size: int) -> DataFrame:
    return written(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), fingerprint(F.col("text"), size).alias("fp")), "simhash")


def _classes(prints: DataFrame, shard: int) -> DataFrame:
    """(fp, root, first, n) of each distinct fingerprint: the least one that links reach, its own least id, its rows."""
    counted = written(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes")
    reached = connected_components(links(counted.select("fp"), counted.count(), shard))
    return counted.join(reached.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"), "first", "n")


def rooted(docs: DataFrame, size: int = 3, shard: int = SHARD) -> DataFrame:
    """(doc_id, text_hash, fp, root) for each row of ``docs``: root is the least fingerprint that links reach, null without an id."""
    prints = _prints(docs, size)
    found = prints.join(_classes(prints, shard).select("fp", "root"), "fp", "left")
    return found.select("doc_id", "text_hash", "fp", F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("root"))


def near_duplicates(docs: DataFrame, size: int = 3, shard: int = SHARD) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    Components get their least ids among distinct fingerprints, so rows meet them in one join. Fingerprints of more than
    one row in ``HOT``, which are fewer than ``HOT``, meet their rows by a broadcast; the others share a shuffle evenly.
    """
    prints = _prints(docs, size).select("doc_id", "fp")
    classes = _classes(prints, shard)
    firsts = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(classes.join(firsts, "root").select("fp", "component_id", "n"), "named")
    least = (named.agg(F.sum("n")).first()[0] or 0) / HOT
    hot = prints.join(F.broadcast(named.where(F.col("n") > least).select("fp", F.col("component_id").alias("hot_id"))), "fp", "left")
    cold = hot.where("hot_id is null").drop("hot_id").join(named.where(F.col("n") <= least).drop("n"), "fp", "left")
    found = cold.unionByName(hot.where("hot_id is not null").withColumnRenamed("hot_id", "component_id"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def first_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are the first, by id and text hash, of their group; rows without an id stay.

    ``groups``: (doc_id, text_hash, root). One id may have several texts, each with a group of its own.
    """
    firsts = groups.where("doc_id is not null").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("w")).select(F.col("w.doc_id").alias("w_id"), F.col("w.text_hash").alias("w_hash"))
    row = docs.select(F.struct("*").alias("row"))
    text_hash = F.xxhash64(F.coalesce("row.text", F.lit("")))
    chosen = row.join(firsts, (F.col("row.doc_id") == F.col("w_id")) & (text_hash == F.col("w_hash")))
    return chosen.dropDuplicates(["w_id", "w_hash"]).select("row.*").unionByName(docs.where("doc_id is null"))


def keep_one(docs: DataFrame, size: int = 3) -> DataFrame:
    """``docs`` without near-duplicates: the first row of each group stays."""
    return first_of_each(docs, rooted(docs, size))
