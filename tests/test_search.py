"""Search against the document-at-a-time evaluator, by both compilers."""

import random

import pytest

from lexspark.functions.analysis import FunctionAnalyzer, StandardAnalyzer
from lexspark.functions.ranking import Bm25
from lexspark.operators.evaluation import evaluate, macro_average
from lexspark.operators.index import MUTATION, build_index, latest, rejections
from lexspark.operators.joins import hits_by_joins
from lexspark.operators.search import ResultCache, SearchError, batch_search, explain, free_text, search
from lexspark.operators.sharding import read_replica, shard_top_k
from lexspark.schema import Field, FieldType, IndexSchema

from .reference import Evaluator, metrics, state

HAND = [
    ("a", 1, False, {"title": "distributed search", "body": "fast distributed engine", "tags": "Systems"}, {"timestamp": "2024-01-01"}),
    ("b", 1, False, {"title": "distributed fast search", "body": "slow search", "tags": "search"}, {"timestamp": "2025-06-15"}),
    ("c", 1, False, {"title": "search search", "body": "unrelated", "tags": "Systems"}, {"timestamp": "2026-12-31"}),
    ("d", 1, False, {"title": "", "body": "", "tags": ""}, {"timestamp": "2022-01-01"}),
]
LATER = HAND + [
    ("b", 2, False, {"title": "no longer matching", "body": "updated alpha", "tags": "updated"}, {"timestamp": "2023-02-02"}),
    ("a", 2, True, {}, {}),
]
QUERIES = [
    "search", "title:search", "tags:Systems", "tags:systems", '"distributed search"', 'title:"distributed fast search"', "distributed AND search", "fast OR slow", "search AND NOT slow",
    "NOT search", "search^2.5", "title:search OR title:search", "---", "timestamp:[2024-01-01 TO 2025-12-31]", "search AND timestamp:[2025-01-01 TO *]", "*",
]
MORE = ['title:"search search"', "NOT (search OR fast)", "(search OR nothing) AND NOT tags:search", "timestamp:[2026-01-01 TO 2024-01-01]", "tags:[A TO T]", "title:* AND search^0.5", "title:(search NOTHING)", "NOT ---"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], MUTATION)


def same(index, rows, query, ks=(10,), joins=True):
    own = Evaluator(state(rows), index.schema)
    for k in ks:
        found = search(index, query, k)
        hits, total = own.search(found.plan, k)
        got = found.collect()
        assert [d for d, _ in got] == [d for d, _ in hits], (query, k)
        assert all(abs(a - b) <= 1e-12 for (_, a), (_, b) in zip(got, hits))
        assert found.total_hits == total
        k or found.hits.collect()
    if joins:
        every = {r.doc_id: r.score for r in hits_by_joins(index, found.plan).collect()}
        want, _ = own.search(found.plan, 1000)
        assert every.keys() == {d for d, _ in want} and all(abs(every[d] - s) <= 1e-12 for d, s in want)


@pytest.fixture(scope="module")
def hand(spark):
    return build_index(frame(spark, HAND), IndexSchema.default()).persist()


def test_hand_picked(hand):
    for query in QUERIES:
        same(hand, HAND, query, (0, 1, 2, 10))
    for query in MORE:
        same(hand, HAND, query)


def test_after_update_and_delete(spark):
    index = build_index(frame(spark, LATER), IndexSchema.default()).persist()
    assert index.live_count == 3 and index.violations().where("n > 0").count() == 0
    for query in QUERIES:
        same(index, LATER, query)


@pytest.mark.parametrize("seed", [7, 29, 101])
def test_random_queries(spark, seed):
    rng = random.Random(seed)
    words = "alpha beta gamma delta search engine fast slow".split()
    some = lambda a, b: " ".join(rng.choice(words) for _ in range(rng.randint(a, b)))
    date = lambda n: f"20{20 + n % 7}-{n % 12 + 1:02d}-{n % 28 + 1:02d}"
    make = lambda n, v: (f"doc-{n}", v, False, {"title": some(2, 6), "body": some(3, 10), "tags": some(1, 1)}, {"timestamp": date(n)})
    rows = [make(n, 1) for n in range(36)] + [make(n, 2) for n in range(6)] + [(f"doc-{n}", 2, True, {}, {}) for n in range(30, 34)]
    index = build_index(frame(spark, rows), IndexSchema.default()).persist()
    w = lambda: rng.choice(words)
    shapes = [
        lambda: w(), lambda: f"title:{w()}", lambda: f"{w()} AND {w()}", lambda: f"{w()} OR {w()}", lambda: f"{w()} AND NOT {w()}", lambda: f'title:"{w()} {w()}"',
        lambda: f"{w()}^2 OR body:{w()}", lambda: f"timestamp:[{date(rng.randrange(9))} TO {date(rng.randrange(20, 40))}]", lambda: f"({w()} OR {w()}) AND NOT tags:missing",
    ]
    asked = {str(n): shapes[n % len(shapes)]() for n in range(45)}
    own = Evaluator(state(rows), index.schema)
    got = {}
    for r in batch_search(index, asked, 11).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    for n, query in asked.items():
        found = search(index, query, rng.randrange(12)) if int(n) < 9 else None
        plan = found.plan if found else search(index, query).plan
        if found:
            same(index, rows, query, (found.k,))
        want, _ = own.search(plan, 11)
        mine = sorted(got.get(n, []))
        assert len(mine) == len(want) and all(abs(a[2] - b[1]) <= 1e-12 for a, b in zip(mine, want))
        assert [m[1] for m in mine] == [d for d, _ in want] or len({round(s, 12) for _, s in want}) < len(want)


def test_wide_queries(hand):
    words = " OR ".join(f"title:w{k}" for k in range(60))
    same(hand, HAND, f"({words}) OR search")
    same(hand, HAND, f'({words} OR title:"distributed search") AND fast')


def test_stop_words_leave_gaps(spark):
    schema = IndexSchema([Field("title", FieldType.TEXT, analyzer=StandardAnalyzer(["the"]))])
    rows = [("gap", 1, False, {"title": "distributed the search"}, {}), ("adjacent", 1, False, {"title": "distributed search"}, {})]
    index = build_index(frame(spark, rows), schema).persist()
    same(index, rows, 'title:"distributed the search"')
    assert [d for d, _ in search(index, 'title:"distributed the search"').collect()] == ["gap"]


def test_custom_analyzer_and_typed_fields(spark):
    pairs = FunctionAnalyzer(lambda text: [(text[k : k + 2], k) for k in range(len(text) - 1)])
    schema = IndexSchema([Field("t", FieldType.TEXT, boost=2.0, analyzer=pairs), Field("n", FieldType.INT64), Field("s", FieldType.KEYWORD, indexed=False)])
    rows = [("x", 1, False, {"t": "abcab", "n": "007"}, {"s": "q"}), ("y", 1, False, {"t": "bcd", "n": "-3"}, {}), ("z", 1, False, {}, {"n": "12"})]
    index = build_index(frame(spark, rows), schema).persist()
    for query in ("t:ab", 't:"abc"', "n:[1 TO 10]", "n:[* TO 7] OR t:bc", "NOT n:[-3 TO -3]", "s:[a TO z]", "n:[5 TO 1]"):
        same(index, rows, query)


def test_statistics(spark):
    rows = [("a", 1, False, {"title": "one two", "body": "one two three four"}, {}), ("b", 1, False, {"title": "one two three four", "body": ""}, {}), ("c", 1, False, {"title": "x"}, {}), ("c", 2, True, {}, {})]
    index = build_index(frame(spark, rows), IndexSchema.default())
    assert index.field_statistics("title") == (2, 6, 3.0) and index.field_statistics("body") == (2, 4, 2.0) and index.field_statistics("no") == (0, 0, 0.0)
    assert index.lookup("title", "one").count() == 2 and index.frequencies([("title", "three")]) == {("title", "three"): 1}


def test_rejections_and_latest(spark):
    rows = [
        ("a", 2, False, {"title": "x"}, {}), ("a", 1, False, {"title": "y"}, {}), ("a", 2, True, {}, {}), ("", 1, False, {}, {}), ("b", 1, False, {"nosuch": "x"}, {}), ("b", 1, False, {"title": "ok"}, {}),
        ("c", 1, False, {"timestamp": "2024-01-01"}, {}), ("d", 1, False, {}, {"timestamp": "2023-02-29"}), ("a", 3, False, {"title": "z"}, {}), ("e", 5, False, {"nosuch": "x"}, {}), ("e", 4, False, {}, {}),
    ]
    df, schema = frame(spark, rows), IndexSchema.default()
    got = {r.seq: r.code for r in rejections(df, schema).collect()}
    assert got == {1: "stale_version", 2: "stale_version", 3: "empty_document_id", 4: "schema_error:unknown_field:nosuch", 6: "schema_error:field_not_indexed:timestamp", 7: "schema_error:invalid_typed_value:timestamp", 9: "schema_error:unknown_field:nosuch"}
    assert {(r.doc_id, r.version, r.seq) for r in latest(df, schema).collect()} == {("a", 3, 8), ("b", 1, 5), ("e", 4, 10)}


def test_explain(spark, hand):
    rows = {r.node: r for r in explain(hand, "title:distributed^2 OR body:systems", "a").collect()}
    assert rows["0"].node_type == "or" and rows["0.1"].term_frequency == 1 and rows["0.1"].document_frequency == 2 and rows["0.1"].corpus_documents == 4 and rows["0.1"].boost == 2
    assert not rows["0.0"].matched and rows["0.0"].score == 0
    assert abs(rows["0"].score - dict(search(hand, "title:distributed^2 OR body:systems").collect())["a"]) < 1e-12
    phrase = explain(hand, 'title:"distributed search" AND NOT timestamp:[2030-01-01 TO *]', "a").collect()
    assert {r.node_type for r in phrase} == {"and", "phrase", "term", "not", "range"}
    assert len(explain(hand, "*", "d").collect()) == 1
    with pytest.raises(SearchError):
        explain(hand, "*", "nosuch")
    index = build_index(frame(spark, LATER), IndexSchema.default())
    assert not explain(index, "*", "a").first().matched


def test_cache(hand):
    cache = ResultCache(4000)
    first = cache.search(hand, "search")
    assert cache.search(hand, "search OR search") == first and (cache.hits, cache.misses) == (1, 1)
    for n in range(12):
        cache.put(("k", n), [("doc", 1.0)] * 3, 3)
    assert cache.evictions and cache.bytes <= 4000
    cache.put(("big",), [("doc", 1.0)] * 1000, 1)
    assert ("big",) not in cache._kept
    own = ResultCache(10_000)
    own.search(hand, "search")
    own.invalidate_before(1)
    assert len(own) == 0 and own.bytes == 0


def test_errors(hand):
    for query, code in (("nosuch:a", "unknown_field"), ("title:[a TO b]", "incompatible_field_type"), (" ".join(f"t{k}" for k in range(140)), "planning_error")):
        with pytest.raises(SearchError) as e:
            search(hand, query)
        assert e.value.code == code
    with pytest.raises(SearchError) as e:
        search(hand, "title:search^1e308^1e308")
    assert e.value.code == "ranking_error"
    assert search(hand, "title:absent^1e308^1e308").collect() == []
    assert abs(dict(search(hand, "title:search", scoring=Bm25(2.0, 0.0)).collect())["c"] - Evaluator(state(HAND), hand.schema, 2.0, 0.0).bm25("c", "title", "search", 1.0)) < 1e-12


def test_free_text(hand):
    assert free_text(hand, "Fast, fast search", "body") == '"fast" OR "fast" OR "search"' and free_text(hand, "--", "body") is None


def test_evaluation(spark):
    lists = {"q1": list("abcd"), "q2": list("zyx"), "q3": []}
    grades = {"q1": {"a": 3, "c": 1, "x": 2}, "q2": {"y": 1, "q": 0}, "q3": {"a": 1}, "q4": {"b": 2}}
    ranked = spark.createDataFrame([(q, d, n) for q, l in lists.items() for n, d in enumerate(l, 1)], "query_id string, doc_id string, rank int")
    judged = spark.createDataFrame([(q, d, g) for q, own in grades.items() for d, g in own.items()], "query_id string, doc_id string, grade int")
    for k in (0, 1, 3, 10):
        got = {r[0]: r[1:] for r in evaluate(ranked, judged, k).collect()}
        for q in grades:
            assert all(abs(a - b) < 1e-12 for a, b in zip(got[q], metrics(lists.get(q, []), grades[q], k))), (q, k)
    assert macro_average(evaluate(ranked, judged, 3)).count() == 1


def test_shards_equal_the_whole(spark):
    rng = random.Random(5)
    words = "red green blue search".split()
    rows = [(f"doc-{n}", 1, False, {"title": " ".join(rng.choice(words) for _ in range(4)), "body": " ".join(rng.choice(words) for _ in range(9))}, {}) for n in range(40)]
    schema = IndexSchema.default()
    index = build_index(frame(spark, rows), schema).persist()
    for query in ("search", "red AND blue", "NOT green", '"red blue"'):
        for k in (1, 7, 100):
            best, counts = shard_top_k(index, query, k, 4)
            whole = search(index, query, k)
            assert [(r.doc_id, r.score) for r in best.collect()] == whole.collect()
        assert sum(r.matches for r in counts.collect()) == whole.total_hits
    nodes = spark.createDataFrame([("a", "suspect", 0, 0), ("b", "healthy", 1, 3), ("c", "healthy", 1, 2), ("d", "draining", 0, 0)], "node_id string, health string, lag long, inflight long")
    assert read_replica(nodes, 5).first()[0] == "c" and read_replica(nodes, -1).count() == 0


def test_benchmark_queries_are_whole_texts(spark, small):
    from lexspark import queries

    index = queries.index_for(spark, small, "documents")
    asked = queries._benchmark_queries(spark, small, index)
    rows = spark.read.parquet(f"{small}/benchmark.parquet").collect()
    assert len(asked) == len(rows) and asked == {str(r["item_id"]): free_text(index, r["text"], "body") for r in rows}


def test_batch_search_topk_returns_all_matches(spark, small, monkeypatch):
    from lexspark import queries

    asked = []
    monkeypatch.setattr(queries, "batch_search", lambda index, trees, k: asked.append(k) or batch_search(index, trees, k))
    got = queries.batch_search_topk(spark, small).where("query_id = 'q2'").count()
    assert asked == [None] and got == spark.read.parquet(f"{small}/documents.parquet").where("lang = 'fr'").count()
