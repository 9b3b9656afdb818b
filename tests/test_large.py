"""What keeps the work of an index bounded by its input, and spread over tasks."""

import tracemalloc

import pyarrow as pa

from lexspark import queries
from lexspark.functions.analysis import SPANS, FunctionAnalyzer, StandardAnalyzer, _tokens_column
from lexspark.operators.index import MUTATION, IndexView, build_index, counts_of, latest
from lexspark.operators.search import batch_search, search
from lexspark.schema import Field, FieldType, IndexSchema
from lexspark.sources.segments import write_segment

ROWS = [(f"d{k}", 1, False, {"title": "same", "body": f"same word{k} é same"}, {}, k) for k in range(64)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_are_dealt_before_they_are_analyzed(spark):
    one_file = spark.createDataFrame(ROWS, MUTATION).coalesce(1)
    rows = latest(one_file, IndexSchema.default())
    assert "Broadcast" not in plan_of(rows) and rows.count() == 64


def test_a_search_makes_only_its_terms(spark):
    index = build_index(spark.createDataFrame(ROWS, MUTATION), IndexSchema.default()).persist(postings=False)
    assert not index.postings.storageLevel.useMemory
    assert search(index, "body:same AND body:word7").total_hits == 1
    kept = index._found[1]
    assert {(r.field, r.term) for r in kept.collect()} == {("body", "same"), ("body", "word7")}
    key = ["field", "term", "doc_id", "tf", "dl", "positions"]
    assert kept.select(*key).exceptAll(index.postings.select(*key)).count() == 0
    assert index.postings.where("term = 'same' and field = 'body'").count() == 64 and index.violations().where("n > 0").count() == 0


def test_a_frequent_term_lies_in_several_files(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, MUTATION).repartition(4)
    index = build_index(docs, IndexSchema.default())
    index.docs = docs
    write_segment(index, str(tmp_path / "s"), 1)
    files = spark.read.parquet(str(tmp_path / "s" / "postings")).where("field = 'body' and term = 'same'").selectExpr("input_file_name() as f").distinct()
    assert files.count() > 1


def test_tokens_of_a_batch_are_few_objects():
    texts = ["one two three " * 2000, None, ""] * 20
    run = _tokens_column(StandardAnalyzer().analyze, ("position", "start_offset", "end_offset"), SPANS)
    tracemalloc.start()
    got = run.func(pa.array(texts))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40_000_000  # as dictionaries: more than 100 MB
    assert got[1].as_py() is None and got[2].as_py() == [] and got[0].as_py()[1] == {"term": "two", "position": 1, "start_offset": 4, "end_offset": 7}


def test_terms_are_those_of_analyze():
    for analyzer in (StandardAnalyzer(), StandardAnalyzer(["two"]), FunctionAnalyzer(lambda t: [(w, 2 * k) for k, w in enumerate(t.split())])):
        for text in ("One twö two--three", "", "two"):
            found, at = analyzer.terms(text.encode())
            assert list(zip((t.decode() for t in found), at if at is not None else range(len(found)))) == [(t.term, t.position) for t in analyzer.analyze(text)]


def test_a_shard_is_folded_in_ranges(spark, small, monkeypatch):
    want = {tuple(r) for r in queries.ordered_apply(spark, small).collect()}
    monkeypatch.setattr(queries, "EVENT_RANGE", 100)
    got = queries.ordered_apply(spark, small)
    assert {tuple(r) for r in got.collect()} == want and "range" in plan_of(got)


BATCH = {"a": "body:same OR body:word7 OR body:same OR title:same^0.5", "b": "title:word4 OR title:none", "c": "body:é", "d": "body:none", "e": "body:same AND body:word9", "f": "body:(word1 OR word2 OR word11)"}


def test_a_batch_makes_no_row_for_a_query_document_and_term(spark):
    rows = [*ROWS, ("x", 1, False, {"title": "word4 word4"}, {}, 64), ("y", 1, False, {}, {}, 65), ("z", 1, True, {"body": "same"}, {}, 66)]
    schema = IndexSchema([Field("title", FieldType.TEXT, boost=0.0, analyzer=StandardAnalyzer()), Field("body", FieldType.TEXT, analyzer=StandardAnalyzer())])
    index = build_index(spark.createDataFrame(rows, MUTATION), schema).persist(postings=False)
    stored = build_index(spark.createDataFrame(rows, MUTATION), schema).persist()
    every = {}
    for r in batch_search(index, BATCH, None).collect():
        every.setdefault(r.query_id, []).append((-r.score, r.doc_id))
    assert 0.0 in {x[0] for x in every["b"]} and "d" not in every
    for k in (1, 3, 100):
        want = {(q, d, -x, n + 1) for q, hits in every.items() for n, (x, d) in enumerate(sorted(hits)[:k])}
        for one in (index, stored):
            assert {tuple(r) for r in batch_search(one, BATCH, k).collect()} == want
    assert "collect_list" not in plan_of(batch_search(index, {q: BATCH[q] for q in "abcf"}, 3))


def test_best_are_kept_across_blocks(spark, monkeypatch):
    from lexspark.functions import batch

    whole = [tuple(r) for r in _ranked().hits_of(ROWS)]
    monkeypatch.setattr(batch, "MOST_SCORES", 5)
    assert [tuple(r) for r in _ranked().hits_of(ROWS)] == whole and len(whole) == 2 * 4


def _ranked():
    from lexspark.functions.batch import BatchRanking

    class Ranked(BatchRanking):
        def hits_of(self, rows):
            self.texts(pa.array([r[0] for r in rows]), [("body", StandardAnalyzer(), [r[3]["body"].encode() for r in rows])])
            return [r.values() for b in self.hits() for r in b.to_pylist()]

    return Ranked([("p", "body", "same", 1.0, 0.5, 4.0), ("p", "body", "word60", 2.0, 3.0, 4.0), ("q", "body", "word5", 1.0, 3.0, 4.0), ("q", "body", "same", 1.0, 0.5, 4.0)], 4, 1.2, 0.75)


def test_many_frequencies_are_counted_by_task(spark, monkeypatch):
    index = build_index(spark.createDataFrame(ROWS, MUTATION), IndexSchema.default()).persist(postings=False)
    leaves = [("body", "same"), ("title", "same"), ("body", "word7"), ("body", "é"), ("title", "é")]
    want = dict(zip(leaves, (64, 64, 1, 64, 0)))
    assert {(r.field, r.term): r.df for r in counts_of(index.docs, index.schema, leaves).collect()} == {x: n for x, n in want.items() if n}
    monkeypatch.setattr(IndexView, "MOST_LITERALS", 1)
    assert index.frequencies(leaves) == want and index._found[1] is None


def test_resolved_documents_stay_dealt(spark):
    rows = latest(spark.createDataFrame(ROWS, MUTATION), IndexSchema.default())
    assert rows.rdd.getNumPartitions() == 8 and rows.count() == 64


def test_a_range_reads_dealt_documents(spark):
    key = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"
    spark.conf.set(key, "true")
    try:
        schema = IndexSchema([Field("title", FieldType.TEXT, analyzer=StandardAnalyzer()), Field("n", FieldType.INT64, indexed=False)])
        rows = [(f"r{k}", 1, False, {"title": "x"}, {"n": str(k)}, k) for k in range(64)]
        index = build_index(spark.createDataFrame(rows, MUTATION), schema).persist(postings=False)
        for query, n in (("n:[5 TO 10]", 6), ("title:*", 64)):
            found = search(index, query)
            assert found.total_hits == n and found.matches.rdd.getNumPartitions() == 8
    finally:
        spark.conf.unset(key)
