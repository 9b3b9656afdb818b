"""The same plans node by node: intersections, unions and exclusions as joins.

It shuffles once for each node, where ``compiler`` shuffles once in all, and serves to check it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import Bm25
from ..plans.planner import AllPlan, AndPlan, NotPlan, OrPlan, PhrasePlan, Plan, RangePlan, TermPlan
from .compiler import Compiler
from .index import IndexView


def hits_by_joins(index: IndexView, plan: Plan, scoring: Bm25 | None = None) -> DataFrame:
    """(doc_id, score) of every match."""
    live = index.live
    none = live.select("doc_id", F.lit(0.0).alias("score")).limit(0)

    def run(node: Plan) -> DataFrame:
        match node:
            case TermPlan() | PhrasePlan():
                own = Compiler(index, node, scoring)
                return own.hits() if own.leaves else none
            case AndPlan() | OrPlan():
                if not node.parts:
                    return none
                how = "inner" if isinstance(node, AndPlan) else "full_outer"

                def add(left: DataFrame, right: DataFrame) -> DataFrame:
                    total = F.coalesce("score", F.lit(0.0)) + F.coalesce("other", F.lit(0.0))
                    return left.join(right.withColumnRenamed("score", "other"), "doc_id", how).select("doc_id", total.alias("score"))

                return reduce(add, map(run, node.parts))
            case NotPlan():
                return live.select("doc_id").join(run(node.operand), "doc_id", "left_anti").select("doc_id", F.lit(0.0).alias("score"))
            case RangePlan():
                return live.where(Compiler(index, node, scoring).in_range(node)).select("doc_id", F.lit(0.0).alias("score"))
            case AllPlan():
                return live.select("doc_id", F.lit(0.0).alias("score"))
        raise TypeError(node)

    return run(plan)
