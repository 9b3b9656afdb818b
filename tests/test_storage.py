"""Stored indexes, document files, logs and the command line."""

import gc
import json

import pytest
from pyspark.sql import functions as F

from lexspark import cli
from lexspark.functions.analysis import StandardAnalyzer
from lexspark.functions.codec import fnv1a64, shard_of
from lexspark.operators.index import MUTATION, build_index
from lexspark.operators.search import search
from lexspark.schema import IndexSchema
from lexspark.sources.documents import COLUMNS, DocumentFileError, cranfield_documents, cranfield_judgments, cranfield_queries, json_result, read_documents, write_documents
from lexspark.sources.segments import IndexWriter, Manifest, ManifestStore, StorageError, WriterOptions, merged, open_segment, write_segment
from lexspark.streaming.ingest import OrderedReplica, start_ingest
from lexspark.streaming.replication import RECORD, MutationLog, ReplicationError

from .test_search import HAND, LATER

SCHEMA = IndexSchema.default()


def frame(spark, rows, first=0):
    return spark.createDataFrame([(*r, first + n) for n, r in enumerate(rows)], MUTATION)


def hits(view, query):
    return dict(search(view, query, 10).collect())


def write_tsv(path, *lines, header="\t".join(COLUMNS)):
    path.write_text("\n".join([header, *lines]) + "\n", newline="")
    return str(path)


# segments


def test_segment_round_trip_and_pruning(spark, tmp_path):
    index = build_index(frame(spark, LATER), SCHEMA)
    write_segment(index, str(tmp_path / "s"), 3)
    view = open_segment(spark, str(tmp_path / "s"))
    assert view.generation == 3 and view.schema == SCHEMA
    for query in ("search", '"distributed fast search"', "NOT search", "*"):
        assert hits(view, query) == hits(index, query)
    assert not view.violations().where("n > 0").count()
    plan = view.postings.where(view.matching([("title", "search")]))._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(field,title)" in plan
    with pytest.raises(StorageError) as e:
        write_segment(index, str(tmp_path / "s"), 3)
    assert e.value.code == "segment_exists"
    with pytest.raises(StorageError) as e:
        write_segment(index, str(tmp_path / "t"), 0)
    assert e.value.code == "invalid_id"


@pytest.mark.parametrize("harm", ["values", "rows", "table", "description", "schema"])
def test_corrupt_segments_are_refused(spark, tmp_path, harm):
    path = tmp_path / "s"
    index = build_index(frame(spark, HAND), SCHEMA)
    write_segment(index, str(path), 1)
    if harm in ("values", "rows"):  # as many rows with another content; or fewer rows
        rows = index.postings.selectExpr("field", "term", "doc_id", "tf + 1 as tf", "dl", "positions") if harm == "values" else index.postings.limit(3)
        rows.write.mode("overwrite").parquet(str(path / "postings"))
    elif harm == "table":
        for f in (path / "lengths").glob("*.parquet"):
            f.write_bytes(b"PAR1 broken")
        for f in (path / "lengths").glob(".*.crc"):
            f.unlink()
    else:
        found = json.loads((path / "segment.json").read_text())
        (path / "segment.json").write_text("{" if harm == "description" else json.dumps(found | {"fingerprint": "other"}))
        (path / ".segment.json.crc").unlink(missing_ok=True)
    with pytest.raises(StorageError) as e:
        open_segment(spark, str(path))
    assert e.value.code == "corrupt"
    with pytest.raises(StorageError) as e:
        open_segment(spark, str(tmp_path / "none"))
    assert e.value.code == "open_failed"


def test_merge_takes_the_newest_state(spark):
    old, new = (build_index(frame(spark, rows), SCHEMA) for rows in (HAND, LATER[4:]))
    view = merged([old, new])
    assert hits(view, "search") == pytest.approx(hits(build_index(frame(spark, LATER), SCHEMA), "search"))
    with pytest.raises(StorageError):
        merged([])
    clash = build_index(frame(spark, [("a", 1, True, {}, {})]), SCHEMA)
    with pytest.raises(StorageError) as e:
        merged([old, clash])
    assert e.value.code == "version_conflict"


# manifests and the writer


def test_manifests(spark, tmp_path):
    store = ManifestStore(spark, str(tmp_path))
    assert store.current() is None
    with pytest.raises(StorageError) as e:
        store.open_current()
    assert e.value.code == "no_generation"
    for n in (1, 2):
        write_segment(build_index(frame(spark, HAND[:n]), SCHEMA), store.segment(n), n)
    store.publish(Manifest(1, (1,)))
    with pytest.raises(StorageError):
        store.publish(Manifest(2, (2,)), fault="before_current")
    assert store.current() == Manifest(1, (1,))  # readers see the old generation
    store.publish(Manifest(2, (1, 2)))
    assert store.current() == Manifest(2, (1, 2))
    for manifest, code in ((Manifest(2, (1,)), "stale_generation"), (Manifest(3, ()), "invalid_manifest"), (Manifest(3, (1, 1)), "invalid_manifest"), (Manifest(3, (9,)), "missing_segment")):
        with pytest.raises(StorageError) as e:
            store.publish(manifest)
        assert e.value.code == code
    store.files.write(f"{tmp_path}/CURRENT", "MANIFEST-7")
    with pytest.raises(Exception):
        store.current()


def test_writer_and_readers_that_stay(spark, tmp_path):
    writer = IndexWriter(spark, str(tmp_path), SCHEMA, WriterOptions(keep_generations=1, compact_at=3, compact_width=2))
    writer.put(frame(spark, HAND), "first")
    writer.put(frame(spark, HAND), "first")  # a batch written twice counts once
    assert len(writer.batches()) == 1 and writer.store.current() is None
    assert writer.refresh() == 1 and writer.refresh() is None
    old = writer.open_search_view()
    before = hits(old, "search")
    writer.put(frame(spark, LATER[4:5]))
    writer.erase("a", 2)
    assert {r.code for r in writer.rejected().collect()} == set()
    writer.refresh()
    now = writer.open_search_view()
    assert set(hits(now, "*")) == {"b", "c", "d"} and hits(old, "search") == before
    writer.merge_all()
    assert set(hits(writer.open_search_view(), "*")) == {"b", "c", "d"}
    assert hits(old, "search") == before and set(hits(now, "*")) == {"b", "c", "d"}  # retained views outlive the merge
    names = lambda: {n for n in writer.files.names(str(tmp_path)) if n.startswith("segment-")}
    assert len(names()) == 3
    del old, now
    gc.collect()
    writer.clean(writer.store.current())
    assert len(names()) == 1
    again = IndexWriter(spark, str(tmp_path), SCHEMA)
    assert set(hits(again.open_search_view(), "*")) == {"b", "c", "d"}
    with pytest.raises(StorageError) as e:
        IndexWriter(spark, str(tmp_path), IndexSchema(list(SCHEMA.fields.values())[:1]))
    assert e.value.code == "schema_mismatch"


def test_writer_bounds(spark, tmp_path):
    writer = IndexWriter(spark, str(tmp_path), SCHEMA, WriterOptions(most_pending=1))
    writer.put(frame(spark, HAND[:1]), "one")
    writer.put(frame(spark, HAND[:1]), "one")
    with pytest.raises(StorageError) as e:
        writer.put(frame(spark, HAND[1:2]), "two")
    assert e.value.code == "too_many_pending"
    writer.refresh()
    writer.put(frame(spark, HAND[1:2]), "two")
    for bad in ({"compact_at": 1}, {"compact_width": 9}, {"keep_generations": 0}, {"most_pending": -1}):
        with pytest.raises(StorageError):
            WriterOptions(**bad)


def test_stream_to_generation(spark, tmp_path):
    source = tmp_path / "in"
    frame(spark, HAND).coalesce(1).write.parquet(str(source))
    writer = IndexWriter(spark, str(tmp_path / "index"), SCHEMA)
    start_ingest(spark.readStream.schema(MUTATION).parquet(str(source)), writer, str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()
    assert set(hits(writer.open_search_view(), "search")) == {"a", "b", "c"}


# document files


def test_document_file(spark, tmp_path):
    path = write_tsv(tmp_path / "d.tsv", "d1\t1\t0\tA\\tB\tx\\\\ty\\\\\\t z\0w\tt\t2024-01-01", "d2\t2\t1\t\t\t\t")
    rows = {r.doc_id: r for r in read_documents(spark, path).collect()}
    assert rows["d1"].fields == {"title": "A\tB", "body": "x\\ty\\\t z\0w", "tags": "t"} and rows["d1"].stored_metadata == {"timestamp": "2024-01-01"}
    assert rows["d2"].deleted and rows["d2"].version == 2 and rows["d1"].seq < rows["d2"].seq


@pytest.mark.parametrize(
    "line, code",
    [("a\t1\t0\tx", "wrong_column_count"), ("\t1\t0\t\t\t\t", "empty_document_id"), ("a\t0\t0\t\t\t\t", "invalid_version"), ("a\tx\t0\t\t\t\t", "invalid_version"), ("a\t1\t2\t\t\t\t", "invalid_deleted"), ("a\t1\t0\tb\\x\t\t\t", "invalid_escape")],
)
def test_document_file_errors(spark, tmp_path, line, code):
    path = write_tsv(tmp_path / "d.tsv", "ok\t1\t0\t\t\t\t", line)
    with pytest.raises(DocumentFileError) as e:
        read_documents(spark, path)
    assert (e.value.code, e.value.line) == (code, 3)
    assert [r.doc_id for r in read_documents(spark, path, strict=False).collect()] == ["ok"]
    for path, code in ((str(tmp_path / "none"), "open_failed"), (write_tsv(tmp_path / "h.tsv", header="other"), "invalid_header")):
        with pytest.raises(DocumentFileError) as e:
            read_documents(spark, path)
        assert e.value.code == code


def test_document_file_in_splits(spark, tmp_path):
    """Line numbers hold over splits and files; long lines and all escapes come back."""
    lines = [f"d{k}\t1\t0\t\t{'x' * (k % 97)}\t\t" if k % 5 else "" for k in range(2000)]
    path = write_tsv(tmp_path / "d.tsv", *lines)
    bytes_a_split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = {r.doc_id: r.seq for r in read_documents(spark, path).collect()}
        assert spark.read.text(path).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_a_split)
    assert got == {f"d{k}": k + 2 for k in range(2000) if k % 5}
    body = "a\\b\\\\n\tc\nd\re \0 \" ' " + "long \\ " * 20000
    rows = [("d1", 3, False, {"title": "", "body": body}, {"timestamp": "t"}, 0), (" é\t2 ", 1, True, {}, {}, 1), ("\"q\"", 1, False, {"tags": '"'}, {}, 2)]
    write_documents(spark.createDataFrame(rows, "doc_id string, version long, deleted boolean, fields map<string,string>, stored_metadata map<string,string>, seq long").repartition(3), str(tmp_path / "w"))
    back = {r.doc_id: (r.version, r.deleted, r.fields["title"], r.fields["body"], r.fields["tags"], r.stored_metadata["timestamp"]) for r in read_documents(spark, str(tmp_path / "w")).collect()}
    write_documents(spark.createDataFrame([], MUTATION), str(tmp_path / "none"))
    assert read_documents(spark, str(tmp_path / "none")).count() == 0
    assert back == {d: (v, x, f.get("title", ""), f.get("body", ""), f.get("tags", ""), m.get("timestamp", "")) for d, v, x, f, m, _ in rows}


def test_token_offsets(spark):
    text = "Äa, B-c é\U0001d518 x"
    (row,) = spark.createDataFrame([(text,), (None,)], "t string").select(StandardAnalyzer(["b"]).spans(F.col("t")).alias("s")).where("s is not null").collect()
    assert [(s.term, s.position, text.encode()[s.start_offset : s.end_offset].decode().lower()) for s in row.s] == [("Äa", 0, "äa"), ("c", 2, "c"), ("é\U0001d518", 3, "é\U0001d518"), ("x", 4, "x")]


def test_json_result(spark):
    index = build_index(frame(spark, HAND), SCHEMA)
    found = json.loads(json_result(search(index, "search", 1), index.live_count, index.docs))
    assert found["indexed_documents"] == 4 and found["total_hits"] == 3 and len(found["hits"]) == 1
    assert found["hits"][0]["fields"]["title"]


def test_cranfield(spark, tmp_path):
    (tmp_path / "c").write_text(".I 1\n.T\nfirst title\n.A\nx\n.W\nbody\nof one\n.I 002\n.T\nsecond\n.W\nbody two\n")
    rows = {r.doc_id: r.fields for r in cranfield_documents(spark, str(tmp_path / "c")).collect()}
    assert rows == {"1": {"title": "first title", "body": "body of one"}, "2": {"title": "second", "body": "body two"}}
    (tmp_path / "i").write_text(".I 001\n.W\nwhat is\nlift\n.I 004\n.W\ndrag ?\n")
    assert [tuple(r) for r in cranfield_queries(spark, str(tmp_path / "i")).orderBy("query_id").collect()] == [("1", "what is lift"), ("2", "drag ?")]
    (tmp_path / "q").write_text("1 184 2\n1 29 -1\n\n2 007 4\n")
    assert {tuple(r) for r in cranfield_judgments(spark, str(tmp_path / "q")).collect()} == {("1", "184", 3), ("1", "29", 0), ("2", "7", 1)}


def test_command_line(spark, tmp_path, capsys):
    path, segment = write_tsv(tmp_path / "d.tsv", "d1\t1\t0\tdistributed systems\treplication log\tsystems search\t2024-01-01", "d2\t1\t0\tother\tnothing\ta\t2024-01-02"), str(tmp_path / "s")
    assert cli.main(["--documents", path, "--query", "title:distributed OR body:replication", "--write-segment", segment], spark) == 0
    first = json.loads(capsys.readouterr().out)
    assert first["total_hits"] == 1 and first["hits"][0]["document_id"] == "d1"
    assert cli.main(["--segment", segment, "--query", "title:distributed OR body:replication"], spark) == 0
    assert json.loads(capsys.readouterr().out) == first
    assert cli.main(["--segment", segment, "--query", "title:("], spark) == 3
    assert cli.main(["--segment", str(tmp_path / "none"), "--query", "a"], spark) == 2
    assert cli.main(["--documents", path], spark) == 2 and cli.main([], spark) == 2


# logs and shards


def test_mutation_log(spark, tmp_path):
    log = MutationLog(spark, str(tmp_path), 2, 1)
    assert log.replay().count() == 0
    names = [c.split()[0] for c in RECORD.split(", ")]
    values = {"shard": 2, "epoch": 1, "payload": "{}"}
    record = lambda n, **other: tuple((values | {"operation_id": f"op-{n}", "sequence": n} | other)[c] for c in names)
    log.append(spark.createDataFrame([record(2), record(1)], RECORD))
    assert [r.sequence for r in log.replay().collect()] == [1, 2]
    log.append(spark.createDataFrame([record(4)], RECORD))
    with pytest.raises(ReplicationError):
        log.replay()
    log.reset()
    log.append(spark.createDataFrame([record(1, epoch=9)], RECORD))
    with pytest.raises(ReplicationError):
        log.replay()


def test_replica_remembers_the_newest_operations():
    replica = OrderedReplica(1, 1, most_operations=3)
    assert [replica.apply(1, 1, f"op-{n}", n, "x") for n in range(1, 6)] == ["applied"] * 5
    assert len(replica.operations) == 3
    assert replica.apply(1, 1, "op-5", 5, "x") == "duplicate" and replica.apply(1, 1, "op-1", 1, "x") == "stale_sequence"


def test_shards_of_ids(spark):
    ids = ["", "a", "doc-1", "é日𝔘", "x" * 300, None]
    got = {r.i: r.s for r in spark.createDataFrame([(i,) for i in ids], "i string").select("i", shard_of("i", 7).alias("s")).collect()}
    assert got == {i: None if i is None else fnv1a64(i.encode()) % 7 for i in ids}
