"""Attribute selections with feature-level meaning.

A condition holds for a feature by what its objects have: ``>`` and ``<`` leave
out features with an equal value, ``!=`` needs some value and no equal one.  Of
several conditions, different objects may meet different ones, unless the
selection asks for one object that meets all.
"""

from __future__ import annotations

import datetime
import operator
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.errors import EmptyQuery, UnknownColumn, UnknownOperator, WrongType
from plinth.functions import values

OPERATORS = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}
NAMES = {"Eq": "=", "Ne": "!=", "Gt": ">", "Lt": "<", "Ge": ">=", "Le": "<="}


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: Any

    def __post_init__(self) -> None:
        object.__setattr__(self, "op", NAMES.get(self.op, self.op))
        if self.op not in OPERATORS:
            raise UnknownOperator(self.op)

    def sides(self, key_bytes: int | None = None) -> tuple[Column, Column]:
        """The column and the value; with ``key_bytes``, of texts only so many bytes, filled up with zero bytes."""
        v, k = values.column(self.field), F.lit(self.value)
        if key_bytes is None or not isinstance(self.value, str):
            return v, k
        fill = F.lit(b"\0")
        return tuple(F.rpad(values.prefix_key(c, key_bytes), F.lit(key_bytes), fill) for c in (v, k))

    def row(self, key_bytes: int | None = None) -> Column:
        """Whether the object's own value meets the condition; never for null, nor for NaN in a range."""
        met = OPERATORS[self.op](*self.sides(key_bytes))
        return met & in_range(values.column(self.field), self.value) if self.op in ("<", "<=", ">", ">=") else met

    def feature(self, key_bytes: int | None = None) -> Column:
        """Whether a feature's objects meet the condition, as an aggregate; NaN is in no range."""
        v, k = self.sides(key_bytes)
        if self.op not in ("=", "!="):
            v = F.when(in_range(v, self.value), v)
        equal = F.coalesce(F.bool_or(v == k), F.lit(False))
        if self.op == "=":
            return equal
        if self.op == "!=":
            return (F.count(v) > 0) & ~equal
        if self.op in (">", ">="):
            found = F.max(v) >= k
        else:
            found = F.min(v) <= k
        found = F.coalesce(found, F.lit(False))
        return found if self.op in (">=", "<=") else found & ~equal

    def implied(self, key_bytes: int | None = None) -> Column | None:
        """Objects that can matter; all of them for ``!=``."""
        widened = {"=": "=", ">": ">=", ">=": ">=", "<": "<=", "<=": "<="}.get(self.op)
        return None if widened is None else OPERATORS[widened](*self.sides(key_bytes))


def in_range(v: Column, bound: Any) -> Column:
    """False for NaN, which is greater than all numbers and in no range; only numbers can be NaN."""
    return ~F.isnan(v.cast("double")) if isinstance(bound, (int, float, Decimal)) and not isinstance(bound, bool) else F.lit(True)


def check_type(field: T.StructField, value: Any) -> None:
    """A condition's value must be of its column's type; any number will do for a column of numbers."""
    kind = field.dataType
    fits = {
        T.BooleanType: bool, T.StringType: str, T.BinaryType: (bytes, bytearray), T.TimestampType: (datetime.datetime, datetime.date),
        T.TimestampNTZType: (datetime.datetime, datetime.date), T.DateType: datetime.date,
    }
    wanted = (int, float, Decimal) if isinstance(kind, T.NumericType) else fits.get(type(kind))
    if wanted is None or not isinstance(value, wanted) or isinstance(value, bool) != (wanted is bool):
        raise WrongType(f"{field.name} is {kind.simpleString()}, not {type(value).__name__}")


class AttrQuery:
    """Conditions that must all hold."""

    def __init__(self, conditions: list[Condition | tuple]):
        self.conditions = [c if isinstance(c, Condition) else Condition(*c) for c in conditions]
        if not self.conditions:
            raise EmptyQuery("a selection needs a condition")

    @classmethod
    def from_list(cls, rows: list) -> AttrQuery:
        return cls([tuple(r) for r in rows])

    def to_list(self) -> list[list]:
        return [[c.field, c.op, c.value] for c in self.conditions]


def select_ids(objects: DataFrame, query: AttrQuery | list, key: str, semantics: str = "feature", key_bytes: int | None = None) -> DataFrame:
    """The keys of the features that a query selects, each once; ``key_bytes`` compares only so many bytes of texts.

    Objects that no condition can be decided by are filtered before the
    aggregation, so that the scan skips them; it combines partial aggregates
    before its one shuffle.
    """
    query = query if isinstance(query, AttrQuery) else AttrQuery(query)
    for c in query.conditions:
        if c.field not in objects.columns:
            raise UnknownColumn(c.field)
        check_type(objects.schema[c.field], c.value)
    if semantics == "object":
        met = query.conditions[0].row(key_bytes)
        for c in query.conditions[1:]:
            met = met & c.row(key_bytes)
        return objects.where(met).select(key).distinct()
    needed = [c.implied(key_bytes) for c in query.conditions]
    rows = objects
    if all(n is not None for n in needed):
        some = needed[0]
        for n in needed[1:]:
            some = some | n
        rows = objects.where(some)
    flags = [c.feature(key_bytes).alias(f"met{i}") for i, c in enumerate(query.conditions)]
    met = F.col("met0")
    for i in range(1, len(flags)):
        met = met & F.col(f"met{i}")
    return rows.groupBy(key).agg(*flags).where(met).select(key)


def select_range(objects: DataFrame, field: str, low: Any = None, high: Any = None) -> DataFrame:
    """Rows whose value lies between two bounds, both included; one may be open.  NaN lies in no range."""
    if low is None and high is None:
        raise EmptyQuery("a range needs a bound")
    v = values.column(field)
    rows = objects
    if low is not None:
        rows = rows.where((v >= F.lit(low)) & in_range(v, low))
    if high is not None:
        rows = rows.where((v <= F.lit(high)) & in_range(v, high))
    return rows


def select(features: DataFrame, objects: DataFrame, query: AttrQuery | list, key: str, semantics: str = "feature") -> DataFrame:
    """The selected features, with all their columns, each once."""
    return features.join(select_ids(objects, query, key, semantics), key, "left_semi")


def reject(features: DataFrame, objects: DataFrame, query: AttrQuery | list, key: str, semantics: str = "feature") -> DataFrame:
    """The features that a query doesn't select, with all their columns."""
    return features.join(select_ids(objects, query, key, semantics), key, "left_anti")
