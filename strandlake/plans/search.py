"""Search queries as predicate trees over catalogue tables.

Trees combine with & | ~ and become one Column, so filters reach the scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Query:
    """A node of a predicate tree."""

    def column(self) -> Column:
        raise NotImplementedError

    def __and__(self, other: Query) -> Query:
        return Composite("and", self, other)

    def __or__(self, other: Query) -> Query:
        return Composite("or", self, other)

    def __xor__(self, other: Query) -> Query:
        return (self | other) & ~(self & other)

    def __invert__(self) -> Query:
        return Not(self)


@dataclass
class Composite(Query):
    operator: str
    left: Query
    right: Query

    def column(self) -> Column:
        a, b = self.left.column(), self.right.column()
        return a & b if self.operator == "and" else a | b


@dataclass
class Not(Query):
    query: Query

    def column(self) -> Column:
        return ~self.query.column()


@dataclass
class Text(Query):
    """All words of a term, in any of the columns."""

    term: str
    columns: Sequence[str]

    def column(self) -> Column:
        out = F.lit(True)
        for word in self.term.split():
            hit = F.lit(False)
            for c in self.columns:
                hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(word.lower())), F.lit(False))
            out = out & hit
        return out


@dataclass
class Field(Query):
    name: str
    operator: str
    value: object
    case_sensitive: bool = True

    def column(self) -> Column:
        c, v = F.col(self.name), self.value
        if not self.case_sensitive:
            c = F.lower(c)
            v = v.lower() if isinstance(v, str) else [x.lower() for x in v] if isinstance(v, (list, tuple)) else v
        match self.operator:
            case "exact_match" | "equals":
                return c == F.lit(v)
            case "is_in":
                return c.isin(*v)
            case "greater":
                return c > F.lit(v)
            case "greater_or_equal":
                return c >= F.lit(v)
            case "less":
                return c < F.lit(v)
            case "less_or_equal":
                return c <= F.lit(v)
            case "range":
                return (c >= F.lit(v[0])) & (c < F.lit(v[1]))
            case "range_closed":
                return (c >= F.lit(v[0])) & (c <= F.lit(v[1]))
            case "contains_phrase":
                return F.contains(c, F.lit(v))
            case "contains_words":
                return Text(v, [self.name]).column()
            case "exists":
                return c.isNotNull()
        raise ValueError(f"unknown operator {self.operator}")


def field(name: str, *, case_sensitive: bool = True, **operator) -> Field:
    """One condition: ``field("p_size", greater=3)``; without an operator, that the field exists."""
    if len(operator) > 1:
        raise TypeError("a field takes one operator")
    op, value = next(iter(operator.items()), ("exists", None))
    return Field(name, op, value, case_sensitive)


@dataclass
class Motif(Query):
    """A sequence motif: 'simple' (X is any symbol), 'prosite' or 'regex'."""

    pattern: str
    kind: str
    column_name: str

    def column(self) -> Column:
        return F.col(self.column_name).rlike(motif_regex(self.pattern, self.kind))


def motif_regex(pattern: str, kind: str) -> str:
    if kind == "regex":
        return pattern
    if kind == "simple":
        return "".join("." if c == "X" else re.escape(c) for c in pattern)
    if kind != "prosite":
        raise ValueError(f"unknown kind {kind}")
    out = []
    for part in pattern.strip().rstrip(".").split("-"):
        start, part = part.startswith("<"), part.lstrip("<")
        end, part = part.endswith(">"), part.rstrip(">")
        times = re.search(r"\((\d+)(?:,(\d+))?\)$", part)
        body = part[: times.start()] if times else part
        if body.startswith("{"):
            body = f"[^{body[1:-1]}]"
        elif body.lower() == "x":
            body = "."
        count = "" if not times else "{" + times[1] + (f",{times[2]}" if times[2] else "") + "}"
        out.append(("^" if start else "") + body + count + ("$" if end else ""))
    return "".join(out)


@dataclass
class Sorting:
    column: str
    descending: bool = True

    def order(self) -> Column:
        return F.col(self.column).desc() if self.descending else F.col(self.column).asc()


def search(rows: DataFrame, query: Query, *, sort_by: Sequence[Sorting] = (), window: tuple[int, int] | None = None, group_by: str | None = None, rank_by: Sequence[Sorting] = ()) -> DataFrame:
    """Matching rows: filtered, one representative a group if grouped, sorted, and rows [start, stop) of that."""
    out = rows.where(query.column())
    if group_by is not None:
        order = Window.partitionBy(group_by).orderBy(*[s.order() for s in rank_by or sort_by])
        out = out.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
    if sort_by:
        out = out.orderBy(*[s.order() for s in sort_by])
    if window is not None:
        out = out.offset(window[0]).limit(window[1] - window[0])
    return out


def count(rows: DataFrame, query: Query, *, group_by: str | None = None) -> DataFrame:
    """One row: how many rows match, or how many groups have one."""
    hit = rows.where(query.column())
    return hit.agg((F.count("*") if group_by is None else F.count_distinct(group_by)).alias("n"))


_ESCAPE = re.compile(r'([\\"])')


def term_text(term: str, field_name: str | None = None) -> str:
    """The text form of one search term, quoted where it has blanks."""
    body = f'"{_ESCAPE.sub(lambda m: chr(92) + m[1], term)}"' if " " in term else term
    return body if field_name is None else f"{body}[{field_name}]"
