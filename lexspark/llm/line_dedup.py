"""Line dedup by winnowing over line hashes.

Lines compare without the white space at their ends; blank lines have no say. In every window of
``WINDOW`` lines the least line hash (the last of equal ones) is its fingerprint. A text gives a row for each
line that is some window's fingerprint, with the windows that it stands for.
Windows of one content have one fingerprint at one place, so a run of ``WINDOW`` or more
lines that occurs twice is sure to share fingerprints at the same lines. Places of a fingerprint join where a window
around them, to either side, has the same content. The earliest place of each window (by id, then text, then line) stays; at
every later one its lines go. As the next window on either side has a fingerprint within it, a match extends both ways, window by window, to the
end of what is repeated, whichever earlier documents its parts are from.

What goes is thus every line within a window of ``WINDOW`` lines whose content occurs
earlier. A fingerprint's places are never paired: they meet the earliest one through sums that combine
map-side, so a line that a third of all documents share costs a row for each place.

Defined cases: null and empty texts stay as they are. Null ids come first. Rows with one id
and text are one document and get the same result. In a stage, documents that
lose all their lines go. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, written

WINDOW = 2
SPACES = " \t\n\x0b\x0c\r"
#: A fingerprint: its place (line in the text) and hash; its windows' first and last lines, and the hash of their content.
FINGERPRINT = "array<struct<at:int,anchor:long,windows:array<struct<first:int,last:int,content:long>>>>"


def window_places(text: str | None, window: int) -> list[dict]:
    lines = [(k, s) for k, line in enumerate((text or "").split("\n")) if (s := line.strip(SPACES))]
    if len(lines) < window:
        return []
    hashes = [xxhash.xxh64_intdigest(s.encode()) for _, s in lines]
    out = []
    for k in range(len(lines) - window + 1):
        own = hashes[k : k + window]
        least = min(own)
        at = k + window - 1 - own[::-1].index(least)
        content = xxhash.xxh64_intdigest("\n".join(s for _, s in lines[k : k + window]).encode(), 1)
        out.append({"first": lines[k][0], "last": lines[k + window - 1][0], "at": lines[at][0], "anchor": least - (1 << 63), "content": content - (1 << 63)})
    return out


def selected(text: str | None, window: int) -> list[dict]:
    """A row for each fingerprint: its place and hash, and the windows that it stands for."""
    out: list[dict] = []
    for w in window_places(text, window):  # in order, and so those of one fingerprint in a row
        if not out or out[-1]["at"] != w["at"]:
            out.append({"at": w["at"], "anchor": w["anchor"], "windows": []})
        out[-1]["windows"].append({k: w[k] for k in ("first", "last", "content")})
    return out


def fingerprints(text: Column, window: int) -> Column:
    @F.arrow_udf(FINGERPRINT)
    def places(texts: pa.Array) -> pa.Array:
        inner = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("content", pa.int64())]))
        kind = pa.list_(pa.struct([("at", pa.int32()), ("anchor", pa.int64()), ("windows", inner)]))
        out = pa.array([selected(t.as_py(), window) for t in texts], kind)
        release()
        return out

    return places(text)


def without(text: Column, spans: Column) -> Column:
    """The text without the lines of its spans (first, last); null where there are none."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for t, spans in zip(texts, lists):
            if not t.is_valid or not spans.is_valid:
                out.append(None)
                continue
            lines = t.as_py().split("\n")
            gone = np.zeros(len(lines), bool)
            for s in spans.as_py():
                gone[s["first"] : s["last"] + 1] = True
            out.append("\n".join(line for line, g in zip(lines, gone) if not g))
        left = pa.array(out, pa.string())
        del out
        release()
        return left

    return cut.asNondeterministic()(text, spans)  # else a filter on the result runs it, in another worker, once more


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, spans) of the texts that repeat an earlier run of lines.

    The earliest places come from sums that combine map-side; the places then meet them in a plain join, which adaptive
    execution splits where a line is hot. Two hashes of 64 bits, of the fingerprint and of the window, tell contents apart.
    """
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    found = written(
        texts.select("doc_id", "text_hash", F.explode(fingerprints(F.col("text"), window)).alias("f")).select("doc_id", "text_hash", "f.*"), "fingerprints"
    )
    place = F.struct("doc_id", "text_hash", F.col("first").alias("line"))
    around = found.select("doc_id", "text_hash", "anchor", F.inline("windows"))
    earliest = around.groupBy("anchor", "content").agg(F.min(place).alias("a"), F.count("*").alias("n")).where("n > 1").select("anchor", "content", "a")
    later = around.join(earliest, ["anchor", "content"]).where(place > F.col("a"))
    return later.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row: the whole row, text: what is left, n_lines, n_deleted) for each row of ``docs``."""
    spans = repeated_spans(docs, window).select(F.col("doc_id").alias("s_id"), F.col("text_hash").alias("s_hash"), "spans")
    whole = docs.select(F.struct("*").alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("s_id")) & (F.xxhash64(F.coalesce("row.text", F.lit(""))) == F.col("s_hash"))
    text = F.when(F.col("spans").isNotNull(), F.col("row.text"))
    joined = whole.join(spans, same, "left").select("row", "spans", without(text, F.col("spans")).alias("left_over"))
    lines = lambda t: F.when(F.coalesce(t, F.lit("")) == "", 0).otherwise(F.size(F.split(t, "\n"))).cast("long")
    left = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(F.col("left_over"))
    n, m = lines(F.col("row.text")), lines(F.col("left_over"))
    return joined.select("row", left.alias("text"), n.alias("n_lines"), F.when(F.col("spans").isNull(), F.lit(0).cast("long")).otherwise(n - m).alias("n_deleted"))


def lines_deleted(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_lines, n_deleted, text) for each row of ``docs``."""
    return deduplicated(docs, window).select("row.doc_id", "n_lines", "n_deleted", "text")


def keep_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with shortened texts (and ``n_chars``, where there is such a column)."""
    found = deduplicated(docs, window).where("n_deleted = 0 or text rlike '[^ \\\\t\\\\n\\\\x0b\\\\f\\\\r]'")
    columns = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("n_deleted") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*(x.alias(c) for c, x in columns.items()))


ORACLE_SQL = r"""
with lines as (
  select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents
), full_lines as (
  select doc_id, pos, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as line from lines
), pairs as (
  select doc_id, pos, lead(pos) over w as last, line || chr(10) || lead(line) over w as content
  from full_lines where line <> '' window w as (partition by doc_id order by pos)
), later as (
  select doc_id, pos, last from pairs where content is not null
  qualify row_number() over (partition by content order by doc_id, pos) > 1
), kept as (
  select l.doc_id, l.pos, l.line from lines l
  where not exists (select 1 from later g where g.doc_id = l.doc_id and l.pos between g.pos and g.last)
), rebuilt as (
  select doc_id, string_agg(line, chr(10) order by pos) as text, count(*) as n from kept group by doc_id
)
select d.doc_id,
  case when coalesce(d.text, '') = '' then 0 else len(string_split(d.text, chr(10))) end::bigint as n_lines,
  case when coalesce(d.text, '') = '' then 0
    else len(string_split(d.text, chr(10))) - case when coalesce(r.text, '') = '' then 0 else r.n end end::bigint as n_deleted,
  case when d.text is null then null else coalesce(r.text, '') end as text
from documents d left join rebuilt r using (doc_id)
"""
