"""Search requests in JSON, compiled to DataFrame operations behind an allow-list.

A request is an object of query, post_filter, sort, from, size and fields. A clause is an
object of one name: bool, match_all, ids, term, terms, range, exists, prefix, match and
match_phrase. What is not listed, or is over a limit, is refused before a plan is built.
"""

from __future__ import annotations

import datetime
import functools
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X

# Clauses of a request and their nesting, rows of a page and up to its end, values of a list, characters of a text, keys to sort by.
MOST_CLAUSES, MOST_DEPTH, MOST_ROWS, WINDOW, MOST_VALUES, MOST_CHARS, MOST_SORTS = 160, 8, 100, 1000, 1000, 600, 3

KEYWORD, TEXT, NUMBER, DATE = "keyword", "text", "number", "date"
_BOUNDS: dict[str, Callable[[Column, Column], Column]] = {"gte": Column.__ge__, "lte": Column.__le__, "gt": Column.__gt__, "lt": Column.__lt__}


class Refused(ValueError):
    """A request that may not run; the message says why."""


def _object(value: Any, what: str, allowed: set[str] | None = None) -> dict:
    if not isinstance(value, dict):
        raise Refused(f"{what} is no object")
    if allowed is not None and (extra := sorted(set(value) - allowed)):
        raise Refused(f"{what} knows no {', '.join(extra)}")
    return value


def _one(value: Any, what: str) -> tuple[str, Any]:
    if len(_object(value, what)) != 1:
        raise Refused(f"{what} has not one name")
    return next(iter(value.items()))


def _number(value: Any, what: str, least: int, most: int) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not least <= value <= most:
        raise Refused(f"{what} is no whole number from {least} to {most}")
    return value


@dataclass(frozen=True)
class Schema:
    """The fields that requests may use, by kind, and the row's identity."""

    fields: dict[str, str]
    key: str

    def field(self, name: Any, *kinds: str) -> str:
        if not isinstance(name, str) or self.fields.get(name) not in (kinds or tuple(self.fields.values())):
            raise Refused(f"no field {name!r} for this")
        return name

    def value(self, name: str, value: Any) -> Column:
        """A literal of the field's kind."""
        kind = self.fields[name]
        if kind == NUMBER and not isinstance(value, bool) and isinstance(value, (int, float)) and value == value:
            return F.lit(value)
        if kind == DATE and isinstance(value, str):
            try:
                return F.lit(datetime.date.fromisoformat(value))
            except ValueError:
                raise Refused(f"{value!r} is no day") from None
        if kind in (KEYWORD, TEXT) and isinstance(value, str) and len(value) <= MOST_CHARS:
            return F.lit(value)
        raise Refused(f"{name} has no value {str(value)[:40]!r}")

    def column(self, name: str) -> Column:
        return F.col(name).cast("date") if self.fields[name] == DATE else F.col(name)


@dataclass
class _Compiler:
    schema: Schema
    clauses: int = 0
    handlers: dict[str, Callable] = field(init=False)

    def __post_init__(self):
        self.handlers = {n.removeprefix("on_"): getattr(self, n) for n in dir(self) if n.startswith("on_")}

    def clause(self, value: Any, depth: int = 1) -> Column:
        """A predicate that is never null."""
        self.clauses += 1
        if self.clauses > MOST_CLAUSES or depth > MOST_DEPTH:
            raise Refused(f"more than {MOST_CLAUSES} clauses or {MOST_DEPTH} levels")
        name, body = _one(value, "a clause")
        if name not in self.handlers:
            raise Refused(f"no clause {name!r}")
        return F.coalesce(self.handlers[name](body, depth), F.lit(False))

    def on_match_all(self, body: Any, depth: int) -> Column:
        _object(body, "match_all", set())
        return F.lit(True)

    def on_bool(self, body: Any, depth: int) -> Column:
        _object(body, "bool", {"must", "filter", "should", "must_not", "minimum_should_match"})
        lists = {k: v if isinstance(v, list) else [v] for k, v in body.items() if k != "minimum_should_match"}
        parts = {k: [self.clause(c, depth + 1) for c in v] for k, v in lists.items()}
        required = parts.get("must", []) + parts.get("filter", []) + [~c for c in parts.get("must_not", [])]
        should = parts.get("should", [])
        least = _number(body.get("minimum_should_match", int(bool(should) and not (parts.get("must") or parts.get("filter")))), "minimum_should_match", 0, MOST_CLAUSES)
        if least:
            held = functools.reduce(Column.__add__, [c.cast("int") for c in should], F.lit(0))
            required.append(held >= least)
        return functools.reduce(Column.__and__, required, F.lit(True))

    def on_ids(self, body: Any, depth: int) -> Column:
        values = self._list(_object(body, "ids", {"values"}).get("values"))
        return F.col(self.schema.key).cast("string").isin([v if isinstance(v, str) else str(_number(v, "an id", -(2**63), 2**63 - 1)) for v in values])

    def _list(self, values: Any) -> list:
        if not isinstance(values, list) or not 0 < len(values) <= MOST_VALUES:
            raise Refused(f"no list of 1 to {MOST_VALUES} values")
        return values

    def on_term(self, body: Any, depth: int) -> Column:
        name, value = _one(body, "term")
        name = self.schema.field(name, KEYWORD, NUMBER, DATE)
        return self.schema.column(name) == self.schema.value(name, _object(value, "term", {"value"})["value"] if isinstance(value, dict) and value else value)

    def on_terms(self, body: Any, depth: int) -> Column:
        name, values = _one(body, "terms")
        name = self.schema.field(name, KEYWORD, NUMBER, DATE)
        return self.schema.column(name).isin([self.schema.value(name, v) for v in self._list(values)])

    def on_range(self, body: Any, depth: int) -> Column:
        name, bounds = _one(body, "range")
        name = self.schema.field(name, NUMBER, DATE)
        if not _object(bounds, "range", set(_BOUNDS)):
            raise Refused("a range has no bounds")
        return functools.reduce(Column.__and__, [_BOUNDS[k](self.schema.column(name), self.schema.value(name, v)) for k, v in bounds.items()])

    def on_exists(self, body: Any, depth: int) -> Column:
        return F.col(self.schema.field(_object(body, "exists", {"field"}).get("field"))).isNotNull()

    def on_prefix(self, body: Any, depth: int) -> Column:
        name, value = _one(body, "prefix")
        name = self.schema.field(name, KEYWORD)
        return F.startswith(F.col(name), self.schema.value(name, value))

    def _words(self, body: Any, what: str, options: set[str]) -> tuple[str, Column, dict]:
        name, value = _one(body, what)
        name = self.schema.field(name, TEXT)
        options_given = _object(value, what, {"query"} | options) if isinstance(value, dict) else {"query": value}
        text = options_given.get("query")
        self.schema.value(name, text)
        return name, X.words(F.lit(text)), options_given

    def on_match(self, body: Any, depth: int) -> Column:
        name, asked, options = self._words(body, "match", {"operator"})
        operator = options.get("operator", "or")
        if operator not in ("or", "and"):
            raise Refused(f"no operator {operator!r}")
        own = X.words(name)
        every = (F.size(asked) > 0) & (F.size(F.array_except(asked, own)) == 0)
        return every if operator == "and" else F.arrays_overlap(own, asked)

    def on_match_phrase(self, body: Any, depth: int) -> Column:
        name, asked, _ = self._words(body, "match_phrase", set())
        padded = lambda words: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        return (F.size(asked) > 0) & F.contains(padded(X.words(name)), padded(asked))


@dataclass(frozen=True)
class Request:
    """A compiled request."""

    matches: Column
    shown: Column
    order: list[Column]
    start: int
    size: int
    fields: list[str]


def compiled(request: str | dict, schema: Schema) -> Request:
    """Raises Refused for what may not run."""
    if isinstance(request, str):
        def once(pairs: list[tuple[str, Any]]) -> dict:
            if len(dict(pairs)) < len(pairs):
                raise Refused("a name stands twice")
            return dict(pairs)

        try:
            request = json.loads(request, object_pairs_hook=once)
        except (json.JSONDecodeError, RecursionError) as error:
            raise Refused(f"no JSON: {error}") from None
    _object(request, "a request", {"query", "post_filter", "sort", "from", "size", "fields"})
    compiler = _Compiler(schema)
    matches = compiler.clause(request.get("query", {"match_all": {}}))
    shown = compiler.clause(request.get("post_filter", {"match_all": {}}))
    sorts = request.get("sort", [])
    if not isinstance(sorts, list) or len(sorts) > MOST_SORTS:
        raise Refused(f"no list of up to {MOST_SORTS} sorts")
    order = []
    for name, way in (_one(s, "a sort") for s in sorts):
        column = schema.column(schema.field(name, KEYWORD, NUMBER, DATE))
        if way not in ("asc", "desc"):
            raise Refused(f"no order {way!r}")
        order.append(column.asc_nulls_last() if way == "asc" else column.desc_nulls_last())
    start, size = _number(request.get("from", 0), "from", 0, WINDOW), _number(request.get("size", 10), "size", 0, MOST_ROWS)
    if start + size > WINDOW:
        raise Refused(f"rows beyond {WINDOW} are not shown")
    names = request.get("fields", list(schema.fields))
    if not isinstance(names, list):
        raise Refused("fields are no list")
    return Request(matches, shown, [*order, F.col(schema.key).asc()], start, size, [schema.field(n) for n in names])


def rows_of(request: Request, rows: DataFrame, schema: Schema) -> DataFrame:
    """The page of hits that a request asks for, in its order, with its fields and the key."""
    found = rows.where(request.matches & request.shown).orderBy(*request.order).offset(request.start).limit(request.size)
    return found.select(schema.key, *[f for f in request.fields if f != schema.key])


def total(request: Request, rows: DataFrame) -> DataFrame:
    """(total): hits of the query, before the post filter."""
    return rows.where(request.matches).agg(F.count("*").alias("total"))
