"""From a plan to one DataFrame.

All leaves come from one filtered scan of the postings; one aggregate by document brings a
document's leaves into one row; the whole boolean tree is then two expressions over it,
``matched`` and ``score``. However large the query, there is one shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import Bm25
from ..plans.planner import AllPlan, AndPlan, NotPlan, OrPlan, PhrasePlan, Plan, RangePlan, TermPlan
from .index import IndexView

#: Leaves beyond which they come as a map instead of a column each.
WIDE = 40
Leaf = tuple[str, str]


def leaves_of(plan: Plan) -> list[Leaf]:
    """(field, term) of all terms and phrase tokens, each once."""
    found: dict[Leaf, None] = {}
    for node in plan.walk():
        if isinstance(node, TermPlan):
            found[node.field, node.term] = None
        elif isinstance(node, PhrasePlan):
            found.update(dict.fromkeys((node.field, t) for t, _ in node.tokens))
    return list(found)


def needs_universe(plan: Plan) -> bool:
    """Whether a document without any leaf may match."""
    match plan:
        case TermPlan() | PhrasePlan():
            return False
        case AndPlan():
            return bool(plan.parts) and all(map(needs_universe, plan.parts))
        case OrPlan():
            return any(map(needs_universe, plan.parts))
    return True


def never_matches(plan: Plan, df: dict[Leaf, int]) -> bool:
    """Known from frequencies alone."""
    match plan:
        case TermPlan():
            return not df[plan.field, plan.term]
        case PhrasePlan():
            return not plan.tokens or any(not df[plan.field, t] for t, _ in plan.tokens)
        case AndPlan():
            return not plan.parts or any(never_matches(p, df) for p in plan.parts)
        case OrPlan():
            return all(never_matches(p, df) for p in plan.parts)
    return False


class Compiler:
    """Columns of a plan over rows that hold a document's leaves."""

    def __init__(self, index: IndexView, plan: Plan, scoring: Bm25 | None = None):
        self.index, self.plan, self.scoring = index, plan, scoring or Bm25()
        self.leaves = leaves_of(plan)
        self.number = {leaf: k for k, leaf in enumerate(self.leaves)}
        self.df = index.frequencies(self.leaves)
        self.phrases = {(n.field, t) for n in plan.walk() if isinstance(n, PhrasePlan) for t, _ in n.tokens}
        self.wide = len(self.leaves) > WIDE

    def rows(self, postings: DataFrame | None = None) -> DataFrame:
        """(doc_id, leaves): one row for each document that has a leaf."""
        found = self.index.found(self.leaves) if postings is None else postings.where(self.index.matching(self.leaves))
        is_leaf = lambda leaf: (F.col("field") == leaf[0]) & (F.col("term") == leaf[1])
        if self.wide:
            number = F.element_at(F.create_map(*(F.lit(x) for (f, t), k in self.number.items() for x in (f"{len(f)}:{f}{t}", k))), F.concat(F.length("field").cast("string"), F.lit(":"), "field", "term"))
            entry = F.struct(number.alias("k"), F.struct("tf", "dl", "positions").alias("v"))
            return found.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(entry)).alias("leaves"))
        columns = []
        for k, leaf in enumerate(self.leaves):
            columns += [F.max(F.when(is_leaf(leaf), F.col("tf"))).alias(f"tf_{k}"), F.max(F.when(is_leaf(leaf), F.col("dl"))).alias(f"dl_{k}")]
            if leaf in self.phrases:
                columns.append(F.first(F.when(is_leaf(leaf), F.col("positions")), ignorenulls=True).alias(f"at_{k}"))
        return found.groupBy("doc_id").agg(*columns)

    def part(self, leaf: Leaf, name: str) -> Column:
        k = self.number[leaf]
        if self.wide:
            return F.try_element_at("leaves", F.lit(k))[{"tf": "tf", "dl": "dl", "at": "positions"}[name]]
        return F.col(f"{name}_{k}")

    def term_score(self, leaf: Leaf, boost: float) -> Column:
        if not self.df[leaf]:
            return F.lit(0.0)
        self.scoring.check_boost(boost)
        documents, _, average = self.index.field_statistics(leaf[0])
        return self.scoring.column(self.part(leaf, "tf"), self.part(leaf, "dl"), documents, self.df[leaf], average, boost)

    def columns(self, node: Plan) -> tuple[Column, Column]:
        """(matched, never null; score, zero where not matched)."""
        match node:
            case TermPlan():
                leaf = node.field, node.term
                matched = self.part(leaf, "tf").isNotNull()
                return matched, F.when(matched, self.term_score(leaf, node.boost)).otherwise(F.lit(0.0))
            case PhrasePlan():
                return self.phrase(node)
            case AndPlan() | OrPlan():
                if not node.parts:
                    return F.lit(False), F.lit(0.0)
                parts = [self.columns(p) for p in node.parts]
                test = (lambda a, b: a & b) if isinstance(node, AndPlan) else (lambda a, b: a | b)
                matched, total = reduce(test, (m for m, _ in parts)), reduce(lambda a, b: a + b, (s for _, s in parts))
                return matched, F.when(matched, total).otherwise(F.lit(0.0))
            case NotPlan():
                return ~self.columns(node.operand)[0], F.lit(0.0)
            case RangePlan():
                return self.in_range(node), F.lit(0.0)
            case AllPlan():
                return F.lit(True), F.lit(0.0)
        raise TypeError(node)

    def phrase(self, node: PhrasePlan) -> tuple[Column, Column]:
        if not node.tokens:
            return F.lit(False), F.lit(0.0)
        (first, base), *rest = node.tokens
        at = lambda term: self.part((node.field, term), "at")
        there = reduce(lambda a, b: a & b, (at(t).isNotNull() for t in dict.fromkeys(t for t, _ in node.tokens)))
        follows = lambda p: reduce(lambda a, b: a & b, (F.array_contains(at(t), p + (k - base)) for t, k in rest), F.lit(True))
        matched = F.coalesce(there & F.exists(at(first), follows), F.lit(False))
        total = reduce(lambda a, b: a + b, (self.term_score((node.field, t), node.boost) for t, _ in node.tokens))
        return matched, F.when(matched, total).otherwise(F.lit(0.0))

    def in_range(self, node: RangePlan) -> Column:
        value = self.index.value(node.field)
        bound = lambda text: self.index.schema.typed(node.field, F.lit(text))
        test = value.isNotNull()
        if node.lower != "*":
            test &= value >= bound(node.lower) if node.include_lower else value > bound(node.lower)
        if node.upper != "*":
            test &= value <= bound(node.upper) if node.include_upper else value < bound(node.upper)
        return F.coalesce(test, F.lit(False))

    def source(self) -> DataFrame:
        """The rows over which the plan's columns are to be read."""
        docs = self.index.live.select("doc_id", *(["fields", "stored_metadata"] if any(isinstance(n, RangePlan) for n in self.plan.walk()) else []))
        if not self.leaves:
            return docs
        if needs_universe(self.plan):
            return docs.join(self.rows(), "doc_id", "left")
        return self.rows().join(docs, "doc_id") if len(docs.columns) > 1 else self.rows()

    def hits(self) -> DataFrame:
        """(doc_id, score) of every match."""
        if never_matches(self.plan, self.df):
            return self.index.live.sparkSession.createDataFrame([], "doc_id string, score double")
        matched, score = self.columns(self.plan)
        return self.source().where(matched).select("doc_id", score.cast("double").alias("score"))

