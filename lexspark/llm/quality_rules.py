"""Quality rules with compression bands.

A document goes if a base rule fails (too few words, too much text in repeated three-word
windows), or if its zstandard ratio leaves the band for its length: above it the text is
repetitive, below it incompressible (random or encoded data). The same test runs over fixed
chunks, so that a bad stretch inside a long, otherwise ordinary text shows. The last chunk ends where the text does,
and overlaps the one before it; a text of one chunk or less is its whole.

Defined cases: a null text has no words and fails the base rule; so does an empty one.
Repeated rows and ties get equal verdicts, each row on its own. Every figure covers the
whole text. Null ids and extra columns are passed on as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, release

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits of raw bytes divided by compressed bytes.

    ``whole`` has (bytes below which the row holds, least ratio, greatest ratio), the last
    row for all longer texts. Ordinary prose compresses better the longer it is, so both
    limits rise with the length. Chunks all have one length and so one band.
    """

    whole: tuple[tuple[float, float, float], ...] = (
        (512, 1.10, 2.4),
        (1024, 1.20, 2.7),
        (4096, 1.30, 3.0),
        (16384, 1.40, 3.5),
        (65536, 1.45, 4.0),
        (float("inf"), 1.45, 4.5),
    )
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (1.30, 2.8)
    #: The share of chunks that may lie outside the chunk band.
    chunk_share: float = 0.25
    level: int = 3
    min_words: int = 50
    max_repeat_percent: int = 50


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that the text has at least twice."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    size = len(known)
    pairs = ids[:-1] * size + ids[1:]
    if size > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
        size = max(size, int(pairs.max()) + 1)
        if size > 3_000_000_000:  # pragma: no cover - beyond what a string can hold
            raise ValueError("text too long")
    windows = pairs[:-1] * len(known) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def in_bands(raw: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """(ratio of the whole, share of chunks outside their band, verdict)."""
    if not raw:
        return 1.0, 0.0, True
    ratio = len(raw) / len(packer.compress(raw))
    low, high = next((a, b) for below, a, b in bands.whole if len(raw) < below)
    size, bad, starts = bands.chunk_bytes, 0, []
    if len(raw) > size:  # else the whole says as much
        starts = [*range(0, len(raw) - size, size), len(raw) - size]
        view = memoryview(raw)
        for at in starts:
            r = size / len(packer.compress(view[at : at + size]))
            bad += not bands.chunk[0] <= r <= bands.chunk[1]
    share = bad / len(starts) if starts else 0.0
    return ratio, share, low <= ratio <= high and share <= bands.chunk_share


def figures(text: str | None, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple:
    """What one text shows, in the order of ``TYPE``."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # at the six ASCII white-space bytes
    seen: set[str] = set()
    dup_lines = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line.strip(SPACES):
                if line in seen:
                    dup_lines += 1
                seen.add(line)
    n, repeat = len(words), repeated_words(words)
    failed = n < bands.min_words or 100 * repeat > bands.max_repeat_percent * n
    ratio, share, good = in_bands(raw, bands, packer)
    return (
        n,
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        dup_lines,
        repeat,
        failed,
        not failed and good,
        ratio,
        share,
    )


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "zstd_ratio", "bad_chunk_share")
_ARROW = (pa.int64(),) * 5 + (pa.bool_(),) * 2 + (pa.float64(),) * 2
TYPE = ", ".join(f"{n} {t}" for n, t in zip(NAMES, ["long"] * 5 + ["boolean"] * 2 + ["double"] * 2))


def rules(text: Column, bands: Bands = Bands()) -> Column:
    """The figures and the verdict for a text column, as one struct."""

    @F.arrow_udf(f"struct<{TYPE.replace(' ', ':').replace(',:', ',')}>")
    def measure(texts: pa.Array) -> pa.Array:
        packer = zstandard.ZstdCompressor(level=bands.level)
        rows = [figures(t.as_py(), bands, packer) for t in texts]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_ARROW)]
        del rows, packer
        release()
        return pa.StructArray.from_arrays(columns, names=NAMES)

    return measure(text)


def measured(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """``doc_id`` with all figures, a row for each row of ``docs``."""
    return docs.select("doc_id", rules(F.col("text"), bands).alias("r")).select("doc_id", "r.*")


def keep_good(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    tmp = free_name(docs, "rules_")
    found = docs.withColumn(tmp, rules(F.col("text"), bands))
    return found.where(F.col(tmp)["kept"]).drop(tmp)
