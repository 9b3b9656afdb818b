"""Declared fields of an index, and what their values may be."""

from __future__ import annotations

import datetime
import enum
import hashlib
import json
import math
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.analysis import Analyzer, KeywordAnalyzer, StandardAnalyzer, from_descriptor


class FieldType(enum.Enum):
    TEXT = "text"
    KEYWORD = "keyword"
    INT64 = "int64"
    TIMESTAMP = "timestamp"  # a calendar date, YYYY-MM-DD


class SchemaError(ValueError):
    def __init__(self, code: str, field: str, message: str):
        super().__init__(message)
        self.code, self.field = code, field


@dataclass(frozen=True)
class Field:
    name: str
    type: FieldType
    indexed: bool = True
    stored: bool = True
    boost: float = 1.0
    analyzer: Analyzer | None = None

    @property
    def searchable(self) -> bool:
        return self.indexed and self.analyzer is not None


_INT, _DATE = re.compile(r"-?[0-9]+", re.ASCII), re.compile(r"\d{4}-\d{2}-\d{2}", re.ASCII)


class IndexSchema:
    def __init__(self, fields: Iterable[Field]):
        self.fields: dict[str, Field] = {}
        for field in fields:
            analyzed = field.indexed and field.type in (FieldType.TEXT, FieldType.KEYWORD)
            if not field.name:
                raise SchemaError("empty_field_name", "", "a field needs a name")
            if not math.isfinite(field.boost) or field.boost < 0:
                raise SchemaError("invalid_boost", field.name, "a field's boost is finite and not negative")
            if analyzed and field.analyzer is None:
                raise SchemaError("missing_analyzer", field.name, "an indexed text or keyword field needs an analyzer")
            if not analyzed and field.analyzer is not None:
                raise SchemaError("unexpected_analyzer", field.name, "only indexed text and keyword fields are analyzed")
            if field.name in self.fields:
                raise SchemaError("duplicate_field", field.name, "a field is declared once")
            self.fields[field.name] = field

    @classmethod
    def default(cls) -> IndexSchema:
        standard = StandardAnalyzer()
        return cls([
            Field("title", FieldType.TEXT, analyzer=standard),
            Field("body", FieldType.TEXT, analyzer=standard),
            Field("tags", FieldType.KEYWORD, analyzer=KeywordAnalyzer()),
            Field("timestamp", FieldType.TIMESTAMP, indexed=False),
        ])

    def find(self, name: str) -> Field | None:
        return self.fields.get(name)

    @property
    def searchable(self) -> list[Field]:
        return [f for f in self.fields.values() if f.searchable]

    def validate_value(self, name: str, value: str) -> None:
        """Raises SchemaError for an unknown field or a value that its type doesn't allow."""
        field = self.find(name)
        if field is None:
            raise SchemaError("unknown_field", name, f"no such field: {name}")
        if field.type is FieldType.INT64 and not (_INT.fullmatch(value) and -(1 << 63) <= int(value) < 1 << 63):
            raise SchemaError("invalid_typed_value", name, f"not an int64: {value!r}")
        if field.type is FieldType.TIMESTAMP:
            try:
                if not _DATE.fullmatch(value):
                    raise ValueError
                datetime.date.fromisoformat(value)
            except ValueError:
                raise SchemaError("invalid_typed_value", name, f"not a date: {value!r}") from None

    def typed(self, name: str, value: Column) -> Column:
        """A field's value in its type; null where it isn't valid."""
        kind = self.fields[name].type
        if kind is FieldType.INT64:
            return F.when(value.rlike("^-?[0-9]+$"), value.try_cast("bigint"))
        if kind is FieldType.TIMESTAMP:
            return F.when(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & (value >= "0001-01-01"), value.try_cast("date"))
        return value

    def violation(self, fields: Column, stored: Column) -> Column:
        """What is wrong with a document's maps, as ``code:field``; null if nothing. Fields come in name order."""
        known = F.array(*(F.lit(n) for n in sorted(self.fields)))

        def first(values: Column, needed: str, code: str) -> list[Column]:
            unknown = F.get(F.array_sort(F.filter(F.map_keys(values), lambda k: ~F.array_contains(known, k))), 0)
            checks = [F.when(unknown.isNotNull(), F.concat(F.lit("unknown_field:"), unknown))]
            for name in sorted(self.fields):
                field, value = self.fields[name], F.try_element_at(values, F.lit(name))
                if field.type in (FieldType.INT64, FieldType.TIMESTAMP):
                    checks.append(F.when(value.isNotNull() & self.typed(name, value).isNull(), F.lit(f"invalid_typed_value:{name}")))
                if not getattr(field, needed):
                    checks.append(F.when(value.isNotNull(), F.lit(f"{code}:{name}")))
            return checks

        return F.coalesce(*first(fields, "indexed", "field_not_indexed"), *first(stored, "stored", "field_not_stored"), F.lit(None).cast("string"))

    def as_dict(self) -> list[dict]:
        return [
            {"name": f.name, "type": f.type.value, "indexed": f.indexed, "stored": f.stored, "boost": f.boost, "analyzer": f.analyzer.descriptor if f.analyzer else None}
            for f in sorted(self.fields.values(), key=lambda f: f.name)
        ]

    @classmethod
    def from_dict(cls, fields: list[dict]) -> IndexSchema:
        return cls(Field(f["name"], FieldType(f["type"]), f["indexed"], f["stored"], f["boost"], from_descriptor(f["analyzer"]) if f["analyzer"] else None) for f in fields)

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(self.as_dict(), sort_keys=True).encode()).hexdigest()

    def __eq__(self, other) -> bool:
        return isinstance(other, IndexSchema) and self.as_dict() == other.as_dict()

    __hash__ = None
