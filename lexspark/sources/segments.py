"""Stored indexes: immutable segments, generations that name them, and a writer.

A segment is a folder with three Parquet tables (docs, lengths, postings) and a description that is
written last. Each file of postings holds some documents' and is sorted by (field, term), so a query's
terms prune row groups and pages; no term's postings meet in one task. A manifest lists a generation's segments; the file CURRENT names the generation and is
replaced in one rename, so readers see the old index or the new one. Files go through Hadoop's file systems.
"""

from __future__ import annotations

import json
import re
import threading
import uuid
import weakref
from collections import Counter
from dataclasses import dataclass
from typing import ClassVar

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.index import IndexView, index_of, latest, rejections
from ..schema import IndexSchema
from .files import Files

TABLES = ("docs", "lengths", "postings")
_DOCS = "doc_id string, version bigint, deleted boolean, fields map<string,string>, stored_metadata map<string,string>, seq bigint"
SCHEMAS = {
    "docs": _DOCS,
    "lengths": "doc_id string, field string, dl int",
    "postings": "field string, term string, doc_id string, tf int, dl int, positions array<int>",
}

#: Bytes of a row group of postings.
BLOCK = 16 << 20


class StorageError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def write_segment(index: IndexView, path: str, segment_id: int) -> dict:
    """Writes an index as a segment and reads its counts and checksums back; the description of it."""
    if segment_id <= 0:
        raise StorageError("invalid_id", "segment ids are positive")
    spark, files = index.docs.sparkSession, Files(index.docs.sparkSession)
    if files.exists(f"{path}/segment.json"):
        raise StorageError("segment_exists", f"a segment is there already: {path}")
    index.docs.select(*(c.split()[0] for c in SCHEMAS["docs"].split(", "))).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/docs")
    if index.derived:  # of the documents that are stored now, so that they aren't resolved again
        stored = index_of(spark.read.schema(SCHEMAS["docs"]).parquet(f"{path}/docs"), index.schema)
        lengths, postings = stored.lengths, stored.postings
    else:
        lengths, postings = index.lengths, index.postings
    lengths.select("doc_id", "field", "dl").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/lengths")
    by_term = postings.select("field", "term", "doc_id", "tf", "dl", "positions").sortWithinPartitions("field", "term", "doc_id")
    by_term.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", BLOCK).parquet(f"{path}/postings")
    description = {"id": segment_id, "schema": index.schema.as_dict(), "fingerprint": index.schema.fingerprint, "sums": _sums(spark, path), "bytes": files.size(path)}
    files.write(f"{path}/segment.json", json.dumps(description, sort_keys=True))
    return description


def _sums(spark: SparkSession, path: str) -> dict[str, list]:
    """For each table its number of rows, and the sum of its rows' hashes: a checksum of the content, in any order of rows."""
    out = {}
    for t in TABLES:
        df = spark.read.schema(SCHEMAS[t]).parquet(f"{path}/{t}")
        columns = [F.to_json(c) if kind.startswith("map") else F.col(c) for c, kind in df.dtypes]
        n, total = df.agg(F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first()
        out[t] = [n, str(total or 0)]
    return out


def open_segment(spark: SparkSession, path: str, verify: bool = True) -> IndexView:
    """A segment as an index; StorageError if its description, its row counts or its checksums don't hold."""
    files = Files(spark)
    if not files.exists(f"{path}/segment.json"):
        raise StorageError("open_failed", f"no segment at {path}")
    try:
        description = json.loads(files.read(f"{path}/segment.json"))
        schema = IndexSchema.from_dict(description["schema"])
    except (ValueError, KeyError) as e:
        raise StorageError("corrupt", f"unreadable description at {path}: {e}") from e
    try:
        sums = _sums(spark, path) if verify else None
    except (Py4JJavaError, PySparkException) as e:
        raise StorageError("corrupt", f"unreadable table at {path}") from e
    if schema.fingerprint != description["fingerprint"] or verify and sums != description["sums"]:
        raise StorageError("corrupt", f"the segment at {path} isn't what its description says")
    return IndexView(schema, *(spark.read.schema(SCHEMAS[t]).parquet(f"{path}/{t}") for t in TABLES), generation=description["id"])


def resolved(segments: list[IndexView]) -> DataFrame:
    """(doc_id, place, version) of each document's newest state: place is its segment, the first of equals."""
    every = None
    for place, s in enumerate(segments):
        one = s.docs.select("doc_id", "version", "deleted", F.lit(place).alias("place"))
        every = one if every is None else every.union(one)
    before = Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    winner = F.max(F.struct("version", (-F.col("place")).alias("o"), "deleted")).over(before)  # an id has a row for each segment at most
    clash = every.withColumn("w", winner).where((F.col("w.version") == F.col("version")) & (F.col("w.deleted") != F.col("deleted"))).select("doc_id").first()
    if clash is not None:
        raise StorageError("version_conflict", f"one version of {clash['doc_id']} is both deleted and not")
    newest = every.groupBy("doc_id").agg(F.max(F.struct("version", (-F.col("place")).alias("o"))).alias("w"))
    return newest.select("doc_id", (-F.col("w.o")).alias("place"), F.col("w.version").alias("version"))


def merged(segments: list[IndexView], generation: int = 0) -> IndexView:
    """One index of several segments, each document's newest state; tombstones stay.

    Postings aren't built again: those of a document's winning segment are kept, by a join on its id.
    """
    if not segments:
        raise StorageError("empty_generation", "a generation has segments")
    if any(s.schema != segments[0].schema for s in segments):
        raise StorageError("schema_mismatch", "segments of one generation share a schema")
    if len(segments) == 1:
        s = segments[0]
        return IndexView(s.schema, s.docs, s.lengths, s.postings, generation)
    won = resolved(segments).select(F.col("doc_id").alias("w_id"), F.col("place").alias("w_place"))

    def kept(name: str) -> DataFrame:
        every = None
        for place, s in enumerate(segments):
            one = getattr(s, name).withColumn("place", F.lit(place))
            every = one if every is None else every.unionByName(one)
        return every.join(won, (F.col("doc_id") == F.col("w_id")) & (F.col("place") == F.col("w_place")), "left_semi").drop("place")

    return IndexView(segments[0].schema, kept("docs"), kept("lengths"), kept("postings"), generation)


@dataclass(frozen=True)
class Manifest:
    generation: int
    segments: tuple[int, ...]


class ManifestStore:
    """MANIFEST-n files, and CURRENT, which names one of them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, Files(spark)

    def segment(self, segment_id: int) -> str:
        return f"{self.path}/segment-{segment_id}"

    def publish(self, manifest: Manifest, fault: str | None = None) -> None:
        now = self.current()
        if manifest.generation <= (now.generation if now else 0):
            raise StorageError("stale_generation", "generations ascend")
        if not manifest.segments or len(set(manifest.segments)) != len(manifest.segments):
            raise StorageError("invalid_manifest", "a manifest lists segments, each once")
        for s in manifest.segments:
            if not self.files.exists(f"{self.segment(s)}/segment.json"):
                raise StorageError("missing_segment", f"no segment {s}")
        name = f"MANIFEST-{manifest.generation}"
        self.files.write(f"{self.path}/{name}", json.dumps({"generation": manifest.generation, "segments": manifest.segments}))
        if fault == "before_current":
            raise StorageError("fault", "stopped between manifest and CURRENT")
        self.files.write(f"{self.path}/CURRENT", name)

    def current(self) -> Manifest | None:
        if not self.files.exists(f"{self.path}/CURRENT"):
            return None
        try:
            name = self.files.read(f"{self.path}/CURRENT").strip()
            found = json.loads(self.files.read(f"{self.path}/{name}"))
            manifest = Manifest(int(found["generation"]), tuple(int(s) for s in found["segments"]))
        except (ValueError, KeyError, TypeError) as e:
            raise StorageError("corrupt", f"unreadable manifest: {e}") from e
        if name != f"MANIFEST-{manifest.generation}":
            raise StorageError("corrupt", "CURRENT names another manifest")
        return manifest

    def open_current(self, verify: bool = False) -> IndexView:
        manifest = self.current()
        if manifest is None:
            raise StorageError("no_generation", "nothing was published yet")
        view = merged([open_segment(self.spark, self.segment(s), verify) for s in manifest.segments], manifest.generation)
        self.lease(view, manifest.generation)
        return view

    #: Open views of this process: (path, generation) to their number.
    _LEASES: ClassVar[Counter] = Counter()

    def lease(self, view: IndexView, generation: int) -> None:
        """A generation's segments stay as long as one of its views does."""
        key = (self.path, generation)
        self._LEASES[key] += 1
        weakref.finalize(view, self._LEASES.subtract, [key])

    def leased(self, generation: int) -> bool:
        return self._LEASES[self.path, generation] > 0

    def segments_of(self, generation: int) -> tuple[int, ...]:
        """The segments of a generation whose manifest is still there; none otherwise."""
        name = f"{self.path}/MANIFEST-{generation}"
        return tuple(json.loads(self.files.read(name))["segments"]) if self.files.exists(name) else ()


@dataclass(frozen=True)
class WriterOptions:
    refresh_batches: int = 0  # publish by itself after so many batches; 0: only when asked
    compact_at: int = 8
    compact_width: int = 4
    keep_generations: int = 2  # stay for readers in other processes, the current one included
    most_pending: int = 0  # batches that may wait for a refresh; 0: any number

    def __post_init__(self):
        if self.refresh_batches < 0 or self.keep_generations < 1 or self.most_pending < 0 or self.compact_at < 2 or not 2 <= self.compact_width <= self.compact_at:
            raise StorageError("invalid_options", "limits of the writer contradict each other")


class IndexWriter:
    """Batches of mutations to searchable generations.

    A batch is first appended to a log, a Parquet table of its own in ``log``, and so survives
    the writer; ``refresh`` makes a segment of what is logged, publishes it, and empties the log.
    Until then it can't be found. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: IndexSchema, options: WriterOptions = WriterOptions()):
        self.spark, self.path, self.schema, self.options = spark, path, schema, options
        self.store, self.files = ManifestStore(spark, path), Files(spark)
        self.lock = threading.RLock()
        current = self.store.current()
        if current is not None:
            known = open_segment(spark, self.store.segment(current.segments[0]), False).schema
            if known != schema:
                raise StorageError("schema_mismatch", "the index has another schema")
        self.clean(current)

    def clean(self, current: Manifest | None) -> None:
        """Deletes segments and manifests that no kept generation reads.

        Kept are the last ``keep_generations`` and those of which this process has an open view.
        """
        keep: set[str] = set()
        for name in self.files.names(self.path) if current else ():
            generation = int(name.removeprefix("MANIFEST-")) if re.fullmatch(r"MANIFEST-\d+", name) else 0
            if 0 < generation <= current.generation and (generation > current.generation - self.options.keep_generations or self.store.leased(generation)):
                keep |= {name, *(f"segment-{s}" for s in self.store.segments_of(generation))}
        for name in self.files.names(self.path):
            if name.startswith(("segment-", "MANIFEST-")) and name not in keep:
                self.files.delete(f"{self.path}/{name}")

    def batches(self) -> list[str]:
        return [n for n in self.files.names(f"{self.path}/log") if self.files.exists(f"{self.path}/log/{n}/_SUCCESS")]

    def pending(self) -> DataFrame | None:
        """What is logged but not published, in order."""
        names = self.batches()
        if not names:
            return None
        every = None
        for at, name in enumerate(names):
            one = self.spark.read.schema(_DOCS).parquet(f"{self.path}/log/{name}").withColumn("batch", F.lit(at))
            every = one if every is None else every.union(one)
        return every.withColumn("seq", F.col("batch").cast("bigint") * (1 << 40) + F.col("seq")).drop("batch")

    def put(self, mutations: DataFrame, batch: str | None = None) -> None:
        """Logs a batch. A named batch that is there already is left as it is: writing it twice is safe."""
        with self.lock:
            names = self.files.names(f"{self.path}/log")
            if self.options.most_pending and len(self.batches()) >= self.options.most_pending and not any(batch and n.endswith(f"-{batch}") for n in names):
                raise StorageError("too_many_pending", "refresh before more batches are put")
            if batch is not None and any(n.endswith(f"-{batch}") for n in self.batches()):
                return
            last = max((int(n.split("-")[0]) for n in names), default=0)
            mutations.select(*(c.split()[0] for c in _DOCS.split(", "))).write.mode("overwrite").parquet(f"{self.path}/log/{last + 1:012d}-{batch or uuid.uuid4().hex}")
            if self.options.refresh_batches and len(self.batches()) >= self.options.refresh_batches:
                self.refresh()

    def erase(self, doc_id: str, version: int) -> None:
        row = [(doc_id, version, True, {}, {}, 0)]
        self.put(self.spark.createDataFrame(row, _DOCS))

    def rejected(self) -> DataFrame | None:
        """Logged mutations that won't be accepted, stale ones against the published state included."""
        pending, known = self.pending(), self.published_versions()
        if pending is None:
            return None
        if known is not None:
            pending = known.select("doc_id", "version", F.lit(False).alias("deleted"), F.create_map().cast("map<string,string>").alias("fields"), F.create_map().cast("map<string,string>").alias("stored_metadata"), F.lit(-1).cast("bigint").alias("seq")).unionByName(pending)
        return rejections(pending, self.schema).where("seq >= 0")

    def published_versions(self) -> DataFrame | None:
        return self.store.open_current().docs.select("doc_id", "version") if self.store.current() else None

    def refresh(self) -> int | None:
        """Publishes what is logged; the new generation, or None if nothing was."""
        with self.lock:
            names, pending = self.batches(), self.pending()
            if pending is None:
                return None
            current = self.store.current()
            docs = latest(pending, self.schema)
            if current is not None:
                known = self.published_versions().withColumnRenamed("version", "known")
                docs = docs.join(known, "doc_id", "left").where("known is null or version > known").drop("known")
            number = self._next(current)
            write_segment(index_of(docs, self.schema), self.store.segment(number), number)
            generation = (current.generation if current else 0) + 1
            self.store.publish(Manifest(generation, (*(current.segments if current else ()), number)))
            for name in names:
                self.files.delete(f"{self.path}/log/{name}")
            self.clean(self.store.current())
            return self.compact() or generation

    def _next(self, current: Manifest | None) -> int:
        return max(current.segments, default=0) + 1 if current else 1

    def compact(self) -> int | None:
        """Once there are many segments, merges the smallest; the new generation, or None."""
        current = self.store.current()
        if current is None or len(current.segments) < self.options.compact_at:
            return None
        sizes = {s: self.files.size(self.store.segment(s)) for s in current.segments}
        small = sorted(current.segments, key=lambda s: (sizes[s], current.segments.index(s)))[: self.options.compact_width]
        return self.merge([s for s in current.segments if s in small])

    def merge(self, chosen: list[int]) -> int:
        """Replaces segments, in their order, by one."""
        current = self.store.current()
        number = self._next(current)
        index = merged([open_segment(self.spark, self.store.segment(s), False) for s in chosen])
        write_segment(index, self.store.segment(number), number)
        rest = [number if s == chosen[-1] else s for s in current.segments if s not in chosen[:-1]]
        self.store.publish(Manifest(current.generation + 1, tuple(rest)))
        self.clean(self.store.current())
        return current.generation + 1

    def merge_all(self) -> int | None:
        """One segment of all."""
        with self.lock:
            current = self.store.current()
            return self.merge(list(current.segments)) if current and len(current.segments) > 1 else None

    def open_search_view(self) -> IndexView:
        return self.store.open_current()


def rebuilt(index: IndexView) -> IndexView:
    """The same documents, analyzed again: equal to ``index`` where it is sound."""
    return index_of(index.docs, index.schema)
