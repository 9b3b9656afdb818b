"""What a query text says. Positions are bytes into the text."""

from __future__ import annotations

from dataclasses import dataclass


class ParseError(ValueError):
    """A query text that can't be read: ``code``, and the byte where it went wrong."""

    def __init__(self, code: str, position: int, message: str):
        super().__init__(f"{message} (at byte {position})")
        self.code, self.position = code, position


@dataclass(frozen=True)
class Limits:
    query_bytes: int = 16 * 1024
    lexemes: int = 2048
    lexeme_bytes: int = 4 * 1024
    nesting: int = 128


@dataclass(frozen=True)
class Node:
    position: int


@dataclass(frozen=True)
class Term(Node):
    term: str


@dataclass(frozen=True)
class Phrase(Node):
    text: str


@dataclass(frozen=True)
class MatchAll(Node):
    pass


@dataclass(frozen=True)
class And(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Or(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Not(Node):
    operand: Node


@dataclass(frozen=True)
class Scoped(Node):
    """A query within one field."""

    field: str
    query: Node


@dataclass(frozen=True)
class Range(Node):
    field: str
    lower: str
    upper: str
    include_lower: bool = True
    include_upper: bool = True


@dataclass(frozen=True)
class Boost(Node):
    query: Node
    factor: float
