"""Documents as tab-separated text, and adapters from other tables.

The text form has a header and seven columns; tabs, line ends and backslashes within values are
escaped. Errors name the first bad line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import Files

COLUMNS = ("document_id", "version", "deleted", "title", "body", "tags", "timestamp")


class DocumentFileError(ValueError):
    """``code`` with the line (from 1; 0 if there is none)."""

    def __init__(self, code: str, line: int, message: str):
        super().__init__(f"line {line}: {message}")
        self.code, self.line = code, line


def unescaped(value: Column) -> Column:
    r"""``\t``, ``\n``, ``\r`` and ``\\`` replaced: the other escapes lie between doubled backslashes."""

    def plain(part: Column) -> Column:
        for sign, meant in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
            part = F.replace(part, F.lit(sign), F.lit(meant))
        return part

    return F.array_join(F.transform(F.split(value, r"\\\\", -1), plain), "\\")


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Lines (line, value) as mutation rows with ``code``: null, or what is wrong with the line."""
    parts = F.split("value", "\t", -1)
    rows = lines.where("value <> ''").select("line", parts.alias("p"), "value")
    at = lambda k: F.get("p", F.lit(k))
    bad_escape = F.replace("value", F.lit("\\\\"), F.lit("")).rlike(r"\\(?![tnr])")  # a loop over the whole line would overflow the stack
    version = F.when(at(1).rlike("^[0-9]+$"), at(1).try_cast("bigint"))
    code = (
        F.when(bad_escape, "invalid_escape")
        .when(F.size("p") != len(COLUMNS), "wrong_column_count")
        .when(at(0) == "", "empty_document_id")
        .when(F.coalesce(version, F.lit(0)) <= 0, "invalid_version")
        .when(~at(2).isin("0", "1"), "invalid_deleted")
    )
    clean = lambda k: unescaped(at(k))
    return rows.select(
        clean(0).alias("doc_id"),
        version.alias("version"),
        (at(2) == "1").alias("deleted"),
        F.create_map(F.lit("title"), clean(3), F.lit("body"), clean(4), F.lit("tags"), clean(5)).alias("fields"),
        F.create_map(F.lit("timestamp"), clean(6)).alias("stored_metadata"),
        F.col("line").alias("seq"),
        code.alias("code"),
    )


#: Splits of files whose first line numbers are broadcast; a split has 128 MB by default.
MOST_SPLITS = 500_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of each file, from 1.

    Spark reads a file in splits, whose rows are counted first. A line's number is that of the lines in the splits before
    its own and in its own before it, so no task reads more than its share.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # within the task, which reads a split in one run
    lines = spark.read.text(path, lineSep="\n").select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), row.alias("row"), "value")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("row").alias("first")).select("file", "block", (before - F.col("first") + 1).alias("from")).persist()
    few = splits.count() <= MOST_SPLITS
    return lines.join(F.broadcast(splits) if few else splits, ["file", "block"]).select((F.col("row") + F.col("from")).alias("line"), "value")


def escaped(value: Column) -> Column:
    """The inverse of ``unescaped``; null as an empty value."""
    for sign, meant in (("\\\\", "\\"), ("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
        value = F.replace(value, F.lit(meant), F.lit(sign))
    return F.coalesce(value, F.lit(""))


def write_documents(rows: DataFrame, path: str) -> None:
    """Mutations as a folder of document files, a header in each; with no rows, there is one of a header alone."""
    of = lambda column, key: F.try_element_at(column, F.lit(key))
    values = [F.col("doc_id"), F.col("version").cast("string"), F.col("deleted").cast("int").cast("string"), *(of("fields", c) for c in COLUMNS[3:6]), of("stored_metadata", "timestamp")]
    header = "\t".join(COLUMNS) + "\n"
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of the task, which writes a file
    lines = rows.select(F.concat_ws("\t", *map(escaped, values)).alias("line")).select(F.concat(F.when(first, header).otherwise(""), "line").alias("value"))
    lines.write.option("maxRecordsPerFile", 0).text(path, lineSep="\n")
    Files(rows.sparkSession).write(f"{path}/header.tsv", header)


def read_documents(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Mutations of a text file, ``seq`` its lines. ``strict``: the first bad line is an error;
    else bad lines are left out (see ``parsed_lines`` for a report).

    A path may name one file or a folder of them; each has a header and lines of its own. Files are read split by split.
    """
    if not Files(spark).exists(path):
        raise DocumentFileError("open_failed", 0, f"can't open {path}")
    whole = numbered_lines(spark, path)
    firsts = whole.where("line = 1").select((F.col("value") == "\t".join(COLUMNS)).alias("ok")).distinct().collect()
    if [r["ok"] for r in firsts] != [True]:
        raise DocumentFileError("invalid_header", 1, "the header isn't that of a document file")
    rows = parsed_lines(whole.where("line > 1"))
    if strict:
        bad = rows.where("code is not null").orderBy("seq").select("seq", "code").first()
        if bad is not None:
            raise DocumentFileError(bad["code"], bad["seq"], bad["code"].replace("_", " "))
    return rows.where("code is null").drop("code")


def mutations_of(df: DataFrame, doc_id: Column, fields: dict[str, Column], stored: dict[str, Column] | None = None, version: Column | None = None, deleted: Column | None = None, seq: Column | None = None) -> DataFrame:
    """Rows of any table as mutations. Null values are absent fields; empty ones are present."""

    def as_map(columns: dict[str, Column] | None) -> Column:
        if not columns:
            return F.create_map().cast("map<string,string>")
        pairs = F.array(*(F.struct(F.lit(n).alias("key"), c.cast("string").alias("value")) for n, c in columns.items()))
        return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))

    return df.select(
        doc_id.cast("string").alias("doc_id"),
        (version if version is not None else F.lit(1)).cast("bigint").alias("version"),
        F.coalesce(deleted if deleted is not None else F.lit(False), F.lit(False)).alias("deleted"),
        as_map(fields).alias("fields"),
        as_map(stored).alias("stored_metadata"),
        (seq if seq is not None else F.lit(0)).cast("bigint").alias("seq"),
    )


def synthetic(spark: SparkSession, documents: int = 5000, words: int = 20, vocabulary: int = 1000, seed: int = 0xD15EA5E) -> DataFrame:
    """Mutations with random terms, the same at every run."""
    term = lambda k: F.concat(F.lit("term"), F.pmod(F.xxhash64("id", k, F.lit(seed)), F.lit(vocabulary)).cast("string"))
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), term), " ")
    docs = spark.range(documents)
    return mutations_of(docs, F.concat(F.lit("doc-"), F.col("id").cast("string")), {"title": F.lit("benchmark corpus"), "body": body, "tags": F.lit("synthetic")}, seq=F.col("id"))


def json_result(result, indexed: int, docs: DataFrame) -> str:
    """A search result with its documents' fields, as one JSON line. Fields are fetched for the k best only."""
    best = result.hits.join(docs.select("doc_id", "fields"), "doc_id", "left").orderBy("rank")
    hit = F.to_json(F.struct(F.col("doc_id").alias("document_id"), "score", "fields"))
    rows = [r[0] for r in best.select(hit).collect()]
    return f'{{"indexed_documents":{indexed},"total_hits":{result.total_hits},"hits":[{",".join(rows)}]}}'


def cranfield_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a Cranfield-style file (.I, .T, .W sections) as mutations."""
    rows = spark.read.text(path, lineSep="\n.I ")
    body = F.concat(F.lit("\n"), F.col("value"))
    part = lambda sign: F.trim(F.regexp_replace(F.regexp_extract(body, rf"(?s)\n\.{sign}[ \t]*\n(.*?)(?=\n\.[A-Z]|$)", 1), r"\s+", " "))
    number = F.regexp_extract("value", r"^(?:\.I )?\s*0*(\d+)", 1)
    return mutations_of(rows.where(number != ""), number, {"title": part("T"), "body": part("W")})


def cranfield_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text) of a Cranfield-style file of queries (.I, .W): judgments know a query by its place in the file, from 1."""
    rows = spark.read.text(path, lineSep="\n.I ", wholetext=False).coalesce(1)  # a collection has some hundred queries
    text = F.trim(F.regexp_replace(F.regexp_extract(F.concat(F.lit("\n"), F.col("value")), r"(?s)\n\.W[ \t]*\n(.*?)(?=\n\.[A-Z]|$)", 1), r"\s+", " "))
    found = rows.where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("k"), text.alias("text"))
    return found.select((F.col("k") + 1).cast("string").alias("query_id"), "text")


def cranfield_judgments(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, grade): codes 1 to 4 are grades 4 to 1, -1 is zero."""
    parts = F.split(F.trim("value"), r"\s+")
    code = F.get(parts, F.lit(2)).try_cast("int")
    clean = lambda k: F.regexp_replace(F.get(parts, F.lit(k)), "^0+(?=.)", "")
    return spark.read.text(path).where("trim(value) <> ''").select(clean(0).alias("query_id"), clean(1).alias("doc_id"), F.when(code == -1, 0).otherwise(5 - code).alias("grade"))
