"""Document fingerprints: a homomorphic multiset hash, in DataFrame functions alone.

A text is the multiset of its paragraphs (lines). Each paragraph hashes to a wide vector
and a document's vector is their sum, coordinate by coordinate modulo powers of two. So
the order of paragraphs doesn't matter, and adding or taking away a paragraph adds or
subtracts its vector (``added``, ``removed``). The vector has two parts:

* ``EXACT`` coordinates modulo 2^32, hashed from the whole paragraph, for equality;
* the number of the paragraph's word pairs, modulo 2^32, and ``DIMS`` counters modulo 2^16: how many
  of its word pairs hash to a one in that bit. A counter less half the number of pairs is a sum
  of random signs, so products of two documents' counters estimate how many pairs they share.

The likeness of two fingerprints is the cosine so estimated, within 0 and 1 (standard error
``DIMS``^-1/2 at most); equal fingerprints have likeness 1.

Documents are edited with the start of the next one, in descending order of id. For that
the ids are cut into ranges; each range is one window, and the greatest id of a range also goes to
the range above it, the greatest of all to the lowest. Each text is so shuffled once.

Defined cases: a null text counts as empty, and the empty text is the one empty paragraph.
Rows of one id are ordered by text. A row without id comes in no order: the next
document of such a row is empty. A single document is its own next. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

EXACT, DIMS = 8, 128
#: Documents in a range of ids, and ranges at most (their bounds go to every task).
RANGE, RANGES = 2048, 1 << 18
LOW32, LANES = 0xFFFFFFFF, 0x0000000100000001
HEX_EXACT, HEX_DIM = 8, 4


def vectors(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(*keys, rows, exact: array of long, pairs: long, ones: array of short) for each key.

    Rows with equal keys must have equal texts; ``rows`` says how many there are, and the
    vector is that of one. Counters modulo 2^16 are held as signed numbers. The sums of one text are
    few enough columns for the aggregate to be compiled.
    """
    paragraphs = rows.select(*rows.columns, F.posexplode(F.split(F.col(text), "\n")).alias("p_at", "p")).drop(text)
    words = F.split(F.col("p"), " ")
    pairs = paragraphs.select("*", F.posexplode(F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.xxhash64(a, b))).alias("w_at", "w0"))
    hashes = [F.xxhash64(F.col("p"), F.lit(k)) for k in range(EXACT // 2)]
    halves = [h for x in hashes for h in (x.bitwiseAND(F.lit(LOW32)), F.shiftrightunsigned(x, 32))]
    mixed = [F.col("w0"), *(F.xxhash64("w0", F.lit(k)) for k in range(1, DIMS // 64))]
    first = F.col("w_at") == 0
    sums = [F.sum(F.when(first, h).otherwise(F.lit(0))).alias(f"e{k}") for k, h in enumerate(halves)]
    sums += [F.sum(F.shiftright(w, b).bitwiseAND(F.lit(LANES))).alias(f"c{k}_{b}") for k, w in enumerate(mixed) for b in range(32)]
    summed = pairs.groupBy(*keys).agg(*sums, F.count("*").alias("n"), F.count(F.when(first & (F.col("p_at") == 0), 1)).alias("rows"))
    share = lambda c: F.expr(f"{c} div rows")
    low = lambda c: share(c).bitwiseAND(F.lit(LOW32))
    high = lambda c: F.shiftrightunsigned(share(c), 32)
    signed = lambda c: (F.pmod(c + (1 << 15), F.lit(1 << 16)) - (1 << 15)).cast("short")
    exact = F.array(*(low(f"e{k}") for k in range(EXACT)))
    ones = F.array(*(signed(lane(f"c{k}_{b}")) for k in range(DIMS // 64) for lane in (low, high) for b in range(32)))
    return summed.select(*keys, "rows", exact.alias("exact"), low("n").alias("pairs"), ones.alias("ones"))


def _padded(x: Column, width: int) -> Column:
    return F.lower(F.lpad(F.hex(x), width, "0"))


def as_text(exact: Column, pairs: Column, ones: Column) -> Column:
    """The fingerprint as a string of hex digits."""
    return F.concat(
        F.array_join(F.transform(exact, lambda x: _padded(x, HEX_EXACT)), ""), _padded(pairs, HEX_EXACT), F.array_join(F.transform(ones, lambda x: _padded(x.cast("int").bitwiseAND(F.lit(0xFFFF)), HEX_DIM)), "")
    )


def _numbers(fingerprint: Column) -> Column:
    """The coordinates of a fingerprint string: exact ones, number of pairs, counters."""
    wide = F.transform(F.sequence(F.lit(0), F.lit(EXACT)), lambda k: F.conv(F.substr(fingerprint, k * HEX_EXACT + 1, F.lit(HEX_EXACT)), 16, 10).cast("long"))
    start = (EXACT + 1) * HEX_EXACT + 1
    narrow = F.transform(F.sequence(F.lit(0), F.lit(DIMS - 1)), lambda k: F.conv(F.substr(fingerprint, k * HEX_DIM + start, F.lit(HEX_DIM)), 16, 10).cast("long"))
    return F.concat(wide, narrow)


def _combined(a: Column, b: Column, sign: int) -> Column:
    total = F.zip_with(_numbers(a), _numbers(b), lambda x, y: x + sign * y)
    wide = F.transform(F.slice(total, 1, EXACT + 1), lambda x: x.bitwiseAND(F.lit(LOW32)))
    return as_text(F.slice(wide, 1, EXACT), F.element_at(wide, EXACT + 1), F.slice(total, EXACT + 2, DIMS))


def added(fingerprint: Column, paragraphs: Column) -> Column:
    """The fingerprint once paragraphs, given by their fingerprint, are inserted."""
    return _combined(fingerprint, paragraphs, 1)


def removed(fingerprint: Column, paragraphs: Column) -> Column:
    """The fingerprint once paragraphs, given by their fingerprint, are deleted."""
    return _combined(fingerprint, paragraphs, -1)


def likeness(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """From 0 to 1, of two fingerprints given by exact, pairs and ones."""

    def signs(v: dict[str, Column]) -> Column:  # deviations are read as signed 16-bit numbers
        return F.transform(v["ones"], lambda c: (F.pmod(2 * c.cast("long") - v["pairs"] + (1 << 16), F.lit(1 << 17)) - (1 << 16)).cast("double"))

    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    x, y = signs(a), signs(b)
    norm = F.sqrt(dot(x, x) * dot(y, y))
    same = (a["pairs"] == b["pairs"]) & (a["exact"] == b["exact"]) & (a["ones"] == b["ones"])
    return F.when(same, F.lit(1.0)).when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(x, y) / norm))).otherwise(F.lit(0.0))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fingerprint): one row for each id and text."""
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return vectors(rows, ["doc_id", "text_hash"], "text").select("doc_id", "text_hash", as_text(F.col("exact"), F.col("pairs"), F.col("ones")).alias("fingerprint"))


def ranges(docs: DataFrame) -> tuple[list[int], list[int]]:
    """Least and greatest id of consecutive ranges with about ``RANGE`` rows each."""
    ids = docs.select("doc_id").where("doc_id is not null")
    parts = max(1, min(RANGES, -(-ids.count() // RANGE)))
    bounds = ids.repartitionByRange(parts, "doc_id").select("doc_id", F.spark_partition_id().alias("part")).groupBy("part").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    found = sorted((r["low"], r["high"]) for r in bounds.collect())
    return [low for low, _ in found], [high for _, high in found]


def _range_of(value: Column, lows: list[int]) -> Column:
    """The range that holds a value, by halving: sum of the steps that don't overshoot."""
    bounds = F.array(*map(F.lit, lows)) if len(lows) < 64 else F.from_json(F.lit(str(lows)), "array<bigint>")
    steps = [1 << k for k in range(len(lows).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: at + F.when(F.coalesce(F.get(bounds, at + step - 1) <= value, F.lit(False)), step).otherwise(0)) - 1


def with_next(docs: DataFrame) -> list[DataFrame]:
    """(range, doc_id, text, leads, next_id, next_text): the next document in descending order of id.

    ``leads`` holds for one row of each id and text. Two tables, of the rows with an id (dealt out by range) and of those without.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    lows, highs = ranges(docs)
    unordered = rows.where("doc_id is null").select(F.lit(-1).alias("range"), "doc_id", "text", F.lit(False).alias("leads"), F.lit(None).cast("long").alias("next_id"), F.lit("").alias("next_text"))
    if not lows:
        return [unordered]
    at = F.col("range")
    top = F.get(F.from_json(F.lit(str(highs)), "array<bigint>"), at) == F.col("doc_id")
    own = F.struct(at.alias("range"), F.lit(0).alias("copy"))
    above = F.struct(F.pmod(at + 1, F.lit(len(lows))).alias("range"), F.lit(1).alias("copy"))
    dealt = (
        rows.where("doc_id is not null")
        .withColumn("range", _range_of(F.col("doc_id"), lows))
        .select("doc_id", "text", F.explode(F.when(top, F.array(own, above)).otherwise(F.array(own))).alias("r"))
        .select("doc_id", "text", "r.range", "r.copy")
    )
    order = Window.partitionBy("range").orderBy("copy", F.desc("doc_id"), "text")
    again = (F.lag("doc_id").over(order) == F.col("doc_id")) & (F.lag("text").over(order) == F.col("text"))
    paired = dealt.select(
        "range", "doc_id", "text", "copy", (~F.coalesce(again, F.lit(False))).alias("leads"), F.lead("doc_id").over(order).alias("next_id"), F.lead("text").over(order).alias("next_text")
    )
    return [paired.where("copy = 0").drop("copy"), unordered]


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses."""
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.left("text", size - half), F.left("next_text", half))
    keys = ["range", "doc_id", "text_hash", "next_id", "next_hash", "leads", "n_chars", "sha"]
    parts = ["exact", "pairs", "ones"]
    found = None
    for rows in with_next(docs):
        both = rows.select("range", "doc_id", "leads", "next_id", F.xxhash64("text").alias("text_hash"), F.xxhash64("next_text").alias("next_hash"), size.cast("long").alias("n_chars"), "text", edited.alias("edited"))
        texts = both.withColumn("sha", F.sha2("edited", 256)).select(*keys, F.explode(F.array(F.struct(F.lit(False).alias("edit"), F.col("text").alias("t")), F.struct(F.lit(True).alias("edit"), F.col("edited").alias("t")))).alias("v"))
        # Rows lie together by range already, so neither aggregate shuffles.
        single = vectors(texts.select(*keys, "v.edit", "v.t"), [*keys, "edit"], "t")
        sides = single.groupBy(*keys).agg(F.max("rows").alias("rows"), *(F.first(F.when(F.col("edit") == (m == "b"), F.col(c)), ignorenulls=True).alias(f"{c}_{m}") for m in "ab" for c in parts))
        found = sides if found is None else found.unionByName(sides)
    found = written(found.drop("range"), "vectors")
    following = found.where("leads").select(F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash"), *(F.col(f"{c}_a").alias(f"{c}_c") for c in parts))
    col = {m: {c: F.col(f"{c}_{m}") for c in parts} for m in "abc"}
    joined = found.join(following, (F.col("next_id") == F.col("c_id")) & (F.col("next_hash") == F.col("c_hash")), "left")
    return joined.select(
        "doc_id",
        "n_chars",
        F.col("sha").alias("edited_sha256"),
        as_text(*col["a"].values()).alias("fingerprint"),
        as_text(*col["b"].values()).alias("edited_fingerprint"),
        likeness(col["a"], col["b"]).alias("near_edited"),
        F.when(F.col("c_id").isNotNull(), likeness(col["a"], col["c"])).otherwise((F.col("n_chars") == 0).cast("double")).alias("near_next"),
        "rows",
    ).select("*", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy")).drop("rows", "copy")
