"""Row predicates: comparisons of a column with a literal, and conjunctions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.functions.scalars import ascii_lower, number


@dataclass(frozen=True)
class Predicate:
    op: str
    column: str = ""
    literal: str = ""
    case_sensitive: bool = True
    parts: tuple["Predicate", ...] = ()

    def columns(self) -> set[str]:
        return {self.column} if self.op != "all" else set().union(*[p.columns() for p in self.parts])

    def condition(self, column: Callable[[str], Column]) -> Column:
        """The predicate as a Column; column(name) gives a field as text."""
        if self.op == "all":
            return reduce(lambda a, b: a & b, [p.condition(column) for p in self.parts])
        field = F.coalesce(column(self.column), F.lit(""))
        if self.op == "equal":
            return field == self.literal if self.case_sensitive else ascii_lower(field) == ascii_lower(F.lit(self.literal))
        x, y = number(field), float(self.literal)
        test = {"less": x < y, "less_equal": x <= y, "greater": x > y, "greater_equal": x >= y}[self.op]
        return F.coalesce(test, F.lit(False))


def _literal(value) -> str:
    if isinstance(value, bool) or not isinstance(value, (str, int, float)):
        raise TypeError(f"a predicate compares with text or a number, not {value!r}")
    return value if isinstance(value, str) else repr(value)


def equal(column: str, value, case_sensitive: bool = True) -> Predicate:
    """Equality of text: 7.0 is the text 7.0. Without case, A to Z alone are folded."""
    return Predicate("equal", column, _literal(value), case_sensitive)


def _numeric(op: str):
    def make(column: str, value) -> Predicate:
        text = _literal(value)
        try:
            float(text)
        except ValueError:
            raise RuntimeError(f"{op} wants a number, not {value!r}") from None
        return Predicate(op, column, text)

    make.__name__ = op
    make.__doc__ = f"{op}: numeric comparison; false for a field that is no number."
    return make


less, less_equal, greater, greater_equal = map(_numeric, ("less", "less_equal", "greater", "greater_equal"))


def all_of(*predicates: Predicate) -> Predicate:
    if not predicates:
        raise TypeError("all_of wants a predicate")
    if not all(isinstance(p, Predicate) for p in predicates):
        raise TypeError("all_of wants predicates")
    return Predicate("all", parts=tuple(q for p in predicates for q in (p.parts if p.op == "all" else (p,))))
