"""Analyzers: how the text of a field becomes terms with positions.

Each has a native column form for documents and a Python twin for query text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of terms in lower case, all others as spaces.
_SPACED = bytes(b if _BYTES.match(bytes([b])) else 32 for b in bytes(range(256)).lower())
_CHARS = r"[0-9a-z\x{80}-\x{10FFFF}]+"
TOKENS = "array<struct<term:string,position:int>>"
SPANS = "array<struct<term:string,position:int,start_offset:int,end_offset:int>>"


@dataclass(frozen=True)
class Token:
    term: str
    position: int
    start_offset: int  # bytes
    end_offset: int


def ascii_lower(text: Column) -> Column:
    """Only A-Z change: case beyond ASCII is kept."""
    return F.translate(text, UPPER, LOWER)


class Analyzer:
    """Base of analyzers. ``descriptor`` names one so that a stored index can find it again."""

    descriptor = "custom-unsupported"

    def analyze(self, text: str) -> list[Token]:
        raise NotImplementedError

    def terms(self, raw: bytes) -> tuple[list[bytes], list[int] | None]:
        """Terms of a text and their positions, both in UTF-8; None for positions that count from zero. It serves an index, and may be faster than ``analyze``."""
        tokens = self.analyze(raw.decode("utf-8", "surrogateescape"))
        return [t.term.encode("utf-8", "surrogateescape") for t in tokens], [t.position for t in tokens]

    def column(self, text: Column) -> Column:
        """array(struct(term, position)) of a non-null text; by default through the Python twin."""
        return _tokens_column(self.analyze, ("position",), TOKENS)(text)

    def spans(self, text: Column) -> Column:
        """array(struct(term, position, start_offset, end_offset)) of a text, offsets in its UTF-8 bytes.

        A running sum over tokens has no built-in form that is linear in the text, so this goes through the Python twin; an index doesn't store offsets.
        """
        return _tokens_column(self.analyze, ("position", "start_offset", "end_offset"), SPANS)(text)


def _tokens_column(analyze: Callable[[str], list[Token]], numbers: tuple[str, ...], kind: str) -> Callable[[Column], Column]:
    """A column of an analyzer's tokens. A text's tokens become flat Arrow arrays before the next one's are made, so that few objects live at a time."""

    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        ends, absent, parts = [0], [], []
        columns = [[] for _ in range(1 + len(numbers))]

        def flush() -> None:
            arrays = [pa.array(columns[0], pa.string()), *(pa.array(c, pa.int32()) for c in columns[1:])]
            parts.append(pa.StructArray.from_arrays(arrays, ["term", *numbers]))
            for c in columns:
                c.clear()

        for value in values:
            text = value.as_py()
            tokens = analyze(text) if text is not None else []
            absent.append(text is None)
            ends.append(ends[-1] + len(tokens))
            columns[0] += [t.term for t in tokens]
            for c, name in zip(columns[1:], numbers):
                c += [getattr(t, name) for t in tokens]
            if len(columns[0]) > 1 << 16:
                flush()
        flush()
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(parts), mask=pa.array(absent, pa.bool_()))

    return run


class StandardAnalyzer(Analyzer):
    """Runs of ASCII letters, digits and all characters beyond ASCII, lower-cased in ASCII.

    Stop words go, but hold their position.
    """

    def __init__(self, stop_words: Iterable[str] = ()):
        self.stop_words = frozenset(w.translate(str.maketrans(UPPER, LOWER)) for w in stop_words)

    @property
    def descriptor(self) -> str:
        words = sorted(self.stop_words)
        return f"standard-v1:{len(words)}" + "".join(f":{len(w.encode())}:{w}" for w in words)

    def analyze(self, text: str) -> list[Token]:
        raw = text.encode("utf-8", "surrogateescape").lower()  # bytes: ASCII only
        found = (Token(m[0].decode("utf-8", "surrogateescape"), k, m.start(), m.end()) for k, m in enumerate(_BYTES.finditer(raw)))
        return [t for t in found if t.term not in self.stop_words]

    def terms(self, raw: bytes) -> tuple[list[bytes], list[int] | None]:
        found = raw.translate(_SPACED).split()
        if not self.stop_words:
            return found, None
        stop = {w.encode("utf-8", "surrogateescape") for w in self.stop_words}
        kept = [k for k, t in enumerate(found) if t not in stop]
        return [found[k] for k in kept], kept

    def column(self, text: Column) -> Column:
        terms = F.regexp_extract_all(ascii_lower(text), F.lit(_CHARS), F.lit(0))
        tokens = F.transform(terms, lambda t, k: F.struct(t.alias("term"), k.alias("position")))
        if self.stop_words:
            tokens = F.filter(tokens, lambda t: ~t["term"].isin(*sorted(self.stop_words)))
        return tokens


class KeywordAnalyzer(Analyzer):
    """The whole value is one term; an empty value has none."""

    descriptor = "keyword-v1"

    def analyze(self, text: str) -> list[Token]:
        return [Token(text, 0, 0, len(text.encode()))] if text else []

    def terms(self, raw: bytes) -> tuple[list[bytes], list[int] | None]:
        return [raw] if raw else [], None

    def column(self, text: Column) -> Column:
        one = F.array(F.struct(text.alias("term"), F.lit(0).alias("position")))
        return F.when(text != "", one).otherwise(F.array().cast(TOKENS))


class FunctionAnalyzer(Analyzer):
    """A user's own analysis: a function from text to (term, position) pairs."""

    def __init__(self, function: Callable[[str], list[tuple[str, int]]]):
        self.function = function

    def analyze(self, text: str) -> list[Token]:
        return [Token(t, p, 0, 0) for t, p in self.function(text)]


def from_descriptor(descriptor: str) -> Analyzer:
    """The analyzer that a descriptor names; ValueError if it can't be rebuilt."""
    if descriptor == KeywordAnalyzer.descriptor:
        return KeywordAnalyzer()
    if descriptor.startswith("standard-v1:"):
        count, _, rest = descriptor.removeprefix("standard-v1:").partition(":")
        words, raw = [], rest.encode()
        for _ in range(int(count)):
            size, _, raw = raw.partition(b":")
            words.append(raw[: int(size)].decode())
            raw = raw[int(size) + 1 :]
        return StandardAnalyzer(words)
    raise ValueError(f"unsupported analyzer: {descriptor}")
