"""Parts that need no Spark: parser, planner, schema, ranking, codec, telemetry, replication."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexspark.functions import codec
from lexspark.functions.analysis import KeywordAnalyzer, StandardAnalyzer, from_descriptor
from lexspark.functions.ranking import Bm25, RankingError
from lexspark.plans import ast
from lexspark.plans.ast import Limits, ParseError
from lexspark.plans.parser import lex, parse
from lexspark.plans.planner import PlanLimits, PlanningError, PlanOptions, plan
from lexspark.schema import Field, FieldType, IndexSchema, SchemaError
from lexspark.streaming.ingest import OrderedReplica
from lexspark.streaming.replication import ReplicationError, ReplicationGroup, recovered, select_replica
from lexspark.telemetry import Metrics

from .reference import Evaluator

DOCS = {
    "a": ({"title": "distributed search", "body": "fast distributed engine", "tags": "Systems"}, {"timestamp": "2024-01-01"}),
    "b": ({"title": "distributed fast search", "body": "slow search", "tags": "search"}, {"timestamp": "2025-06-15"}),
    "c": ({"title": "search search", "body": "unrelated", "tags": "Systems"}, {"timestamp": "2026-12-31"}),
    "d": ({"title": "", "body": "", "tags": ""}, {"timestamp": "2022-01-01"}),
}


def canonical(text, **options):
    return plan(parse(text), Evaluator(DOCS, IndexSchema.default()), PlanOptions(**options)).canonical()


@pytest.mark.parametrize(
    ("text", "code", "position"),
    [
        ('title:"broken', "unterminated_phrase", 6), ("search^zero", "invalid_boost", 7), ("year:[2024 2026]", "expected_range_bound", 11),
        ("  \t\n", "empty_query", 4), ("()", "expected_expression", 1), ('"   "', "expected_expression", 0), ("search^0", "invalid_boost", 7),
        ("year:[2024 TO]", "expected_range_bound", 13), ("(" * 129 + "a", "nesting_too_deep", 128), ("a^1e9999", "invalid_boost", 2),
        ("field:[a TO ]", "expected_range_bound", 12), ("((((", "expected_expression", 4), ("a AND AND b", "expected_expression", 6),
        ("a NOT b", "unexpected_token", 2), ('"a\\n"', "unexpected_character", 2), ("é)", "unexpected_token", 2), ("a^inf", "invalid_boost", 2), ("a^1_0", "invalid_boost", 2),
        ("a^+1", "invalid_boost", 2), ("x:^2", "expected_expression", 2), ("how to cook", "unexpected_token", 4),
    ],
)
def test_parse_errors(text, code, position):
    for _ in range(2):
        with pytest.raises(ParseError) as e:
            parse(text)
        assert (e.value.code, e.value.position) == (code, position)


def test_lexer_limits():
    with pytest.raises(ParseError) as e:
        parse(" OR ".join(["a"] * 3001))
    assert e.value.code == "resource_limit"
    for limits in (Limits(lexemes=0), Limits(lexeme_bytes=2), Limits(query_bytes=3)):
        with pytest.raises(ParseError) as e:
            lex("abcd", limits)
        assert e.value.code == "resource_limit"


def test_parse_shapes():
    shape = parse("a b AND c")
    assert isinstance(shape, ast.Or) and isinstance(shape.right, ast.And)
    assert parse("f:x^2") == ast.Boost(0, ast.Scoped(0, "f", ast.Term(2, "x")), 2.0)
    assert parse("NOT NOT a") == ast.Not(0, ast.Not(4, ast.Term(8, "a")))
    assert parse("f:NOT (x)") == ast.Scoped(0, "f", ast.Not(2, ast.Term(7, "x")))
    assert parse("a^2^3") == ast.Boost(0, ast.Boost(0, ast.Term(0, "a"), 2.0), 3.0)
    assert parse("f:[* TO z-9]") == ast.Range(0, "f", "*", "z-9")
    assert parse('"a \\" \\\\"').text == 'a " \\'


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='ab ():^[]"*\\éANDORT2.', max_size=40))
def test_parser_is_total_and_repeatable(text):
    def outcome():
        try:
            return parse(text)
        except ParseError as e:
            assert 0 <= e.position <= len(text.encode())
            return e.code, e.position

    first = outcome()
    assert first == outcome()
    if isinstance(first, ast.Node):
        try:
            one = plan(first, Evaluator(DOCS, IndexSchema.default()))
        except PlanningError:
            return
        assert one.canonical() == plan(first, Evaluator(DOCS, IndexSchema.default())).canonical()


def test_canonical_forms():
    assert canonical("search") == "O(T(4:body,6:search,1),T(4:tags,6:search,1),T(5:title,6:search,1),)"
    assert canonical("title:a OR title:a") == canonical("title:a AND title:a") == "T(5:title,1:a,1)"
    assert canonical("title:a^2 OR title:a") == "O(T(5:title,1:a,1),T(5:title,1:a,2),)"
    assert canonical("title:a OR title:b OR title:a") == "O(O(T(5:title,1:a,1),T(5:title,1:b,1),),T(5:title,1:a,1),)"
    assert canonical("---") == "O(O(),T(4:tags,3:---,1),)"
    assert canonical("title:---") == "O()"
    assert canonical("title:foo-bar") == "O(T(5:title,3:bar,1),T(5:title,3:foo,1),)"
    assert canonical("title:0.1^0.1") == "O(T(5:title,1:0,0.10000000000000001),T(5:title,1:1,0.10000000000000001),)"
    assert canonical('title:"A b a"') == "P(5:title,1,1:a@0,1:b@1,1:a@2)"
    assert canonical("NOT *") == "N(M())"
    assert canonical("timestamp:[2024-01-01 TO *]") == "R(9:timestamp,10:2024-01-01,1:*,1,1)"
    assert canonical("title:search AND title:distributed") == "A(T(5:title,11:distributed,1),T(5:title,6:search,1),)"
    assert canonical("title:x", default_fields=(("nosuch", 1.0),)) == "T(5:title,1:x,1)"
    with pytest.raises(PlanningError):
        canonical("title:x", default_fields=())


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("nosuch:a", "unknown_field"), ("timestamp:a", "incompatible_field_type"), ("title:[a TO b]", "incompatible_field_type"), ("timestamp:[2023-02-29 TO *]", "invalid_range"),
        (" OR ".join(f"t{k}" for k in range(131)), "resource_limit"), ("nosuch:[1 TO 2]", "unknown_field"),
    ],
)
def test_planning_errors(text, code):
    with pytest.raises(PlanningError) as e:
        canonical(text)
    assert e.value.code == code


def test_plan_limits():
    for limits, text in ((PlanLimits(nodes=2), "a b"), (PlanLimits(tokens=1), "title:a-b"), (PlanLimits(phrase_tokens=1), 'title:"a b"'), (PlanLimits(depth=1), "((a b) c) d")):
        with pytest.raises(PlanningError) as e:
            canonical(text, limits=limits)
        assert e.value.code == "resource_limit"


def test_integer_bounds_and_boosts():
    schema = IndexSchema([
        Field("body", FieldType.TEXT, analyzer=StandardAnalyzer(["the"])), Field("title", FieldType.TEXT, boost=2.0, analyzer=StandardAnalyzer()),
        Field("count", FieldType.INT64, indexed=False), Field("tags", FieldType.KEYWORD, boost=1.5, analyzer=KeywordAnalyzer()),
    ])
    own = Evaluator({}, schema)
    assert plan(parse("count:[001 TO 010]"), own).canonical() == "R(5:count,1:1,2:10,1,1)"
    assert plan(parse("(title:x^3)^2"), own).canonical() == "T(5:title,1:x,12)"
    assert plan(parse('body:"a the b"'), own).canonical() == "P(4:body,1,1:a@0,1:b@2)"
    assert plan(parse("x"), own, PlanOptions((("title", 0.5), ("tags", 2.0)))).canonical() == "O(T(4:tags,1:x,3),T(5:title,1:x,1),)"


def test_schema():
    standard = StandardAnalyzer()
    for fields, code in (
        ([Field("", FieldType.TEXT)], "empty_field_name"), ([Field("a", FieldType.TEXT, boost=math.nan, analyzer=standard)], "invalid_boost"),
        ([Field("a", FieldType.TEXT)], "missing_analyzer"), ([Field("a", FieldType.INT64, analyzer=standard)], "unexpected_analyzer"),
        ([Field("a", FieldType.INT64), Field("a", FieldType.INT64)], "duplicate_field"),
    ):
        with pytest.raises(SchemaError) as e:
            IndexSchema(fields)
        assert e.value.code == code
    schema = IndexSchema.default()
    assert IndexSchema.from_dict(schema.as_dict()) == schema and schema.fingerprint == IndexSchema.default().fingerprint
    schema.validate_value("timestamp", "2024-02-29")
    for bad in ("2023-02-29", "2024-2-9", "0000-01-01", " 2024-01-01", ""):
        with pytest.raises(SchemaError):
            schema.validate_value("timestamp", bad)
    numbers = IndexSchema([Field("n", FieldType.INT64)])
    for good in ("0", "-5", "007", str(2**63 - 1)):
        numbers.validate_value("n", good)
    for bad in ("+5", " 5", "12.5", "", str(2**63)):
        with pytest.raises(SchemaError):
            numbers.validate_value("n", bad)


def test_analyzers():
    tokens = StandardAnalyzer(["THE"]).analyze("The É_a-Bc the 日本x")
    assert [(t.term, t.position) for t in tokens] == [("É", 1), ("a", 2), ("bc", 3), ("日本x", 5)]
    assert (tokens[0].start_offset, tokens[0].end_offset) == (4, 6)
    assert [t.term for t in KeywordAnalyzer().analyze("A b")] == ["A b"] and KeywordAnalyzer().analyze("") == []
    for analyzer in (StandardAnalyzer(["b", "ä:1"]), KeywordAnalyzer()):
        assert from_descriptor(analyzer.descriptor).descriptor == analyzer.descriptor
    with pytest.raises(ValueError):
        from_descriptor("custom-unsupported")


def test_bm25():
    assert abs(Bm25().score(100, 10, 3, 120, 100.0) - 3.411122994035014) < 1e-12
    assert Bm25().score(100, 10, 3, 120, 100.0, 0.0) == 0.0
    for args in ((10, 11, 1, 1, 1.0), (10, 1, 2, 1, 1.0), (10, 1, 1, 1, 0.0)):
        with pytest.raises(RankingError):
            Bm25().score(*args)
    for k1, b in ((0, 0.5), (math.inf, 0.5), (1, 1.1), (1, -0.1)):
        with pytest.raises(RankingError):
            Bm25(k1, b)


@given(st.lists(st.integers(1, codec.MOST), unique=True))
def test_codec_round_trip(values):
    values = sorted(values)
    data = codec.encode_deltas(values)
    assert codec.decode_deltas(data, len(values)) == values


def test_codec_errors():
    assert codec.encode(300) == bytes([0x2C, 0x82]) and codec.fnv1a64(b"a") == 0xAF63DC4C8601EC8C
    for data, code in ((b"\x01", "truncated"), (b"\x00\x80", "non_canonical"), (b"\x7f" * 4 + b"\xff", "overflow"), (b"\x7f" * 5, "overflow")):
        with pytest.raises(codec.CodecError) as e:
            codec.decode(data)
        assert e.value.code == code
    for call, code in ((lambda: codec.encode_deltas([2, 2]), "invalid_order"), (lambda: codec.decode_deltas(b"\x80", 1), "invalid_order"), (lambda: codec.decode_deltas(b"\x81\x81", 1), "non_canonical"), (lambda: codec.decode_deltas(b"", 5, 4), "resource_limit")):
        with pytest.raises(codec.CodecError) as e:
            call()
        assert e.value.code == code


def test_metrics():
    m = Metrics()
    m.increment("b", 2)
    m.increment("a")
    m.increment("bad name")
    m.increment("a", (1 << 64) - 1)
    m.set_gauge("g", 5)
    m.add_gauge("g", -7)
    m.observe("h", 0.5, (0.1, 1.0))
    m.observe("h", 3.0, (0.1, 1.0))
    m.observe("h", 3.0, (0.2, 1.0))
    m.observe("x", math.nan)
    assert m.prometheus() == 'a 18446744073709551615\nb 2\ng -2\nh_bucket{le="0.10000000000000001"} 0\nh_bucket{le="1"} 1\nh_bucket{le="+Inf"} 2\nh_sum 3.5\nh_count 2\n'


def test_ordered_apply_and_recovery():
    r = OrderedReplica(1, 1)
    steps = [((1, 1, "op-1", 1, "x"), "applied"), ((1, 1, "op-1", 1, "x"), "duplicate"), ((1, 1, "op-3", 3, "x"), "sequence_gap"), ((1, 1, "op-1", 1, "y"), "conflicting_operation"), ((2, 1, "o", 2, ""), "wrong_shard"), ((1, 2, "o", 2, ""), "wrong_epoch"), ((1, 1, "", 2, ""), "conflicting_operation"), ((1, 1, "new", 1, ""), "stale_sequence"), ((1, 1, "op-2", 2, ""), "applied")]
    assert [r.apply(*a) for a, _ in steps] == [o for _, o in steps]
    log = [(1, 1, f"o{k}", k, "") for k in range(1, 6)]
    assert recovered(1, 1, log, 2).applied == 5
    with pytest.raises(ReplicationError):
        recovered(1, 1, log[1:])


def test_replication_group():
    g = ReplicationGroup(1, 1, ["n1", "n2", "n3"], 3)
    assert g.submit("a", {"id": "x"}) == {"sequence": 1, "acknowledged": 3} == g.submit("a", {"id": "x"})
    with pytest.raises(ReplicationError):
        g.submit("a", {"id": "y"})
    g.set_health("n3", "unhealthy")
    g.submit("b", {"id": "y"})
    with pytest.raises(ReplicationError) as e:
        g.submit("c", {"id": "z"}, "all_replicas")
    assert e.value.code == "replica_unavailable" and g.replicas[0].state.applied == 3
    with pytest.raises(ReplicationError) as e:
        g.submit("d", {})
    assert e.value.code == "log_full"
    assert g.statuses()[2]["lag"] == 2
    g.set_health("n3", "healthy")
    assert g.statuses()[2]["lag"] == 0 and g.read_from(0) == "n1"
    s = lambda n, h, lag, load: {"node_id": n, "health": h, "lag": lag, "inflight": load}
    assert select_replica([s("a", "suspect", 0, 0), s("b", "healthy", 2, 0), s("c", "healthy", 1, 5), s("d", "healthy", 1, 5)], 2) == "c"
    with pytest.raises(ReplicationError):
        select_replica([s("a", "draining", 0, 0), s("b", "healthy", 9, 0)], 2)


def test_random_bytes_never_crash_the_parser():
    rng = random.Random(3)
    for _ in range(2000):
        raw = bytes(rng.randrange(256) for _ in range(rng.randrange(40)))
        try:
            parse(raw)
        except ParseError as e:
            assert 0 <= e.position <= len(raw)
