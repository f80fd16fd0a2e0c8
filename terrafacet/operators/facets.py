"""Facet text to a predicate on a record set.

A term is [-]field:value. The value is plain, quoted, `*` (not empty), or a range
`[a TO b]` whose ends may be `*`. Terms are joined by " AND " or by " OR ";
`-(...)` inverts each term within and swaps the joiner.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = re.compile(r'^(-?)([\w.]+):(?:"((?:[^"\\]|\\.)*)"|\[(\S+) TO (\S+)\]|(\*)|(.+))$')


@dataclass(frozen=True)
class Term:
    """One test of one field; `low` and `high` make a range, None at either end is open."""

    field: str
    value: str | None = None
    low: float | None = None
    high: float | None = None
    range: bool = False
    negated: bool = False

    def column(self) -> Column:
        text = F.col(self.field).cast("string")
        if self.range:
            number = F.expr(f"try_cast(`{self.field}` as double)")
            tests = [number >= self.low] * (self.low is not None) + [number <= self.high] * (self.high is not None)
            held = F.coalesce(reduce(lambda a, b: a & b, tests, number.isNotNull()), F.lit(False))
        elif self.value == "*":
            held = F.coalesce(text != "", F.lit(False))
        else:
            held = F.coalesce(text == self.value, F.lit(False))
        return ~held if self.negated else held


@dataclass(frozen=True)
class Group:
    """Terms and groups joined by AND or OR."""

    parts: tuple
    any: bool

    def column(self) -> Column:
        columns = [p.column() for p in self.parts]
        return reduce(lambda a, b: a | b if self.any else a & b, columns)


def parse_term(text: str, inverted: bool = False) -> Term:
    found = TERM.match(text.strip())
    if not found:
        raise ValueError(f"no facet term: {text!r}")
    minus, field, quoted, low, high, star, plain = found.groups()
    negated = (minus == "-") != inverted
    if low is not None:
        ends = [None if v == "*" else float(v) for v in (low, high)]
        return Term(field, None, *ends, True, negated)
    value = "*" if star else plain if quoted is None else quoted.replace('\\"', '"')
    return Term(field, value, negated=negated)


def split_top(text: str, joiner: str) -> list[str]:
    """Parts between joiners outside quotes, brackets and parentheses."""
    parts, depth, quoted, start, at = [], 0, False, 0, 0
    while at < len(text):
        c = text[at]
        quoted ^= c == '"' and text[at - 1 : at] != "\\"
        depth += 0 if quoted else (c in "([") - (c in ")]")
        if not quoted and depth == 0 and text.startswith(joiner, at):
            parts.append(text[start:at])
            at = start = at + len(joiner)
        else:
            at += 1
    return [*parts, text[start:]]


def parse(text: str, inverted: bool = False) -> Term | Group:
    """The facet of a text. AND and OR side by side, without parentheses, are an error."""
    text = text.strip()
    if all(len(split_top(text, joiner)) > 1 for joiner in (" AND ", " OR ")):
        raise ValueError(f"AND and OR need parentheses: {text!r}")
    for joiner, any_ in ((" AND ", False), (" OR ", True)):
        parts = split_top(text, joiner)
        if len(parts) > 1:
            return Group(tuple(parse(p, inverted) for p in parts), any_ != inverted)
    negated = text.startswith("-(")
    if (negated or text.startswith("(")) and text.endswith(")"):
        return parse(text[2 if negated else 1 : -1], inverted != negated)
    return parse_term(text, inverted)


def fields_of(facet: Term | Group) -> list[str]:
    """The fields that a facet tests, each once."""
    if isinstance(facet, Term):
        return [facet.field]
    return list(dict.fromkeys(f for p in facet.parts for f in fields_of(p)))


def bounds_of(facet: Term | Group) -> dict[str, tuple[float | None, float | None]]:
    """The least low and the greatest high end of each field's ranges, None where one is open; fields without ranges are left out."""
    found: dict[str, list[Term]] = {}
    for term in terms_of(facet):
        if term.range:
            found.setdefault(term.field, []).append(term)
    ends = {}
    for field, terms in found.items():
        low, high = [t.low for t in terms], [t.high for t in terms]
        ends[field] = (None if None in low else min(low), None if None in high else max(high))
    return ends


def terms_of(facet: Term | Group) -> list[Term]:
    return [facet] if isinstance(facet, Term) else [t for p in facet.parts for t in terms_of(p)]


def text_of(facet: Term | Group) -> str:
    """The text that parse reads as this facet."""
    if isinstance(facet, Group):
        inner = [f"({text_of(p)})" if isinstance(p, Group) else text_of(p) for p in facet.parts]
        return (" OR " if facet.any else " AND ").join(inner)
    end = lambda v: "*" if v is None else repr(v)
    value = f"[{end(facet.low)} TO {end(facet.high)}]" if facet.range else "*" if facet.value == "*" else '"' + facet.value.replace('"', '\\"') + '"'
    return f"{'-' * facet.negated}{facet.field}:{value}"


@dataclass(frozen=True)
class LayerFilter:
    """A layer's values in a range, with a tolerance, or among listed ids."""

    layer: str
    low: float | None = None
    high: float | None = None
    ids: tuple[str, ...] = ()

    def column(self, value: str = "value") -> Column:
        if self.ids:
            return F.coalesce(F.col(value).cast("string").isin(*self.ids), F.lit(False))
        number = F.col(value).cast("double")
        return F.coalesce((number + TOLERANCE >= self.low) & (number - TOLERANCE <= self.high), F.lit(False))


TOLERANCE = 1e-7


def layer_filters(text: str) -> list[LayerFilter]:
    """The filters of ENVELOPE(el1,min,max:cl22,id1,id2): environmental layers (el...) have a range, others ids."""
    inner = text.strip()
    inner = inner[len("ENVELOPE(") : -1] if inner.startswith("ENVELOPE(") and inner.endswith(")") else inner
    found = []
    for part in filter(None, inner.split(":")):
        layer, *rest = [p.strip() for p in part.split(",")]
        if layer.startswith("el"):
            if len(rest) != 2:
                raise ValueError(f"no range: {part!r}")
            found.append(LayerFilter(layer, float(rest[0]), float(rest[1])))
        else:
            found.append(LayerFilter(layer, ids=tuple(rest)))
    return found


def decade(field: str, start: int | None) -> Term:
    """The facet of ten years from `start`, or of all before 1850."""
    return Term(field, low=float(start), high=float(start + 9), range=True) if start is not None else Term(field, high=1849.0, range=True)
