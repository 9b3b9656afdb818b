"""BM25, as a column and as a Python number, evaluated in one fixed order."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class RankingError(ValueError):
    """``code`` is one of invalid_parameters, inconsistent_statistics, invalid_boost."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75

    def __post_init__(self):
        if not (math.isfinite(self.k1) and self.k1 > 0 and math.isfinite(self.b) and 0 <= self.b <= 1):
            raise RankingError("invalid_parameters", "k1 must be finite and positive, b within 0 and 1")

    @property
    def fingerprint(self) -> str:
        return f"bm25:{self.k1!r}:{self.b!r}"

    @staticmethod
    def check_boost(boost: float) -> None:
        if not math.isfinite(boost) or boost < 0:
            raise RankingError("invalid_boost", "boosts must be finite and not negative")

    def idf(self, documents: int, matching: int) -> float:
        return math.log1p((documents - matching + 0.5) / (matching + 0.5))

    def score(self, documents: int, matching: int, frequency: int, length: int, average: float, boost: float = 1.0) -> float:
        """One term's score in one document."""
        self.check_boost(boost)
        if not (0 < matching <= documents and 0 < frequency <= length and average > 0 and math.isfinite(average)):
            raise RankingError("inconsistent_statistics", "the statistics contradict each other")
        weight = frequency * (self.k1 + 1) / (frequency + self.k1 * (1 - self.b + self.b * length / average))
        return self.idf(documents, matching) * weight * boost

    def column(self, frequency: Column, length: Column, documents: int, matching: int, average: float, boost: float) -> Column:
        tf = frequency.cast("double")
        weight = tf * F.lit(self.k1 + 1) / (tf + F.lit(self.k1) * (F.lit(1 - self.b) + F.lit(self.b) * length.cast("double") / F.lit(float(average))))
        return F.lit(self.idf(documents, matching)) * weight * F.lit(float(boost))


def top_k(hits, k: int):
    """The k best rows of (doc_id, score): by score, then by id."""
    return hits.orderBy(F.desc("score"), F.asc("doc_id")).limit(k)
