"""Set algebra over predicates: folding of constants, simplification, symbols, and evaluation over sorted id sets.

A Known set is either the ids it holds or all ids but those it lacks, so NOT is free and AND, OR are unions, intersections and differences of the
listed ids; none and all are the two with an empty list. Every operation is exact (an OR of two complements is the complement of what both lack).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexil.plans.predicate import SPELLINGS, Label, Node, Op, parse


@dataclass(frozen=True)
class Known:
    """ids, or all but ids."""

    ids: frozenset[int]
    but: bool = False

    @property
    def kind(self) -> str:
        return ("most" if self.ids else "all") if self.but else ("some" if self.ids else "none")


NONE, ALL = Known(frozenset()), Known(frozenset(), True)


def invert(a: Known) -> Known:
    return Known(a.ids, not a.but)


def meet(a: Known, b: Known) -> Known:
    if a.but and b.but:
        return Known(a.ids | b.ids, True)
    if a.but or b.but:
        some, most = (b, a) if a.but else (a, b)
        return Known(some.ids - most.ids)
    return Known(a.ids & b.ids)


def join(a: Known, b: Known) -> Known:
    return invert(meet(invert(a), invert(b)))


def evaluate(node: Node, sets: dict[int, Known], unknown: Known = NONE) -> Known:
    """The set of a predicate from its labels' sets; a label without one is unknown."""
    if isinstance(node, Label):
        return sets.get(node.tid, unknown)
    parts = [evaluate(p, sets, unknown) for p in node.parts]
    return invert(parts[0]) if node.name == "NOT" else meet(*parts) if node.name == "AND" else join(*parts)


def simplify(node: Node, sets: dict[int, Known] | None = None) -> Node | bool:
    """An equivalent predicate, or True or False if it holds for all or none: labels known to be none or all are folded (others stay), double NOTs go,
    equal operands are one, and x AND NOT x, x OR NOT x are folded."""
    sets = sets or {}
    if isinstance(node, Label):
        kind = sets[node.tid].kind if node.tid in sets else ""
        return True if kind == "all" else False if kind == "none" else node
    parts = [simplify(p, sets) for p in node.parts]
    if node.name == "NOT":
        (a,) = parts
        if isinstance(a, bool):
            return not a
        return a.parts[0] if isinstance(a, Op) and a.name == "NOT" else Op("NOT", (a,))
    a, b = parts
    idle = node.name == "AND"  # the constant that changes nothing
    if isinstance(a, bool) or isinstance(b, bool):
        constant, other = (a, b) if isinstance(a, bool) else (b, a)
        return other if constant == idle else constant
    if a == b:
        return a
    if Op("NOT", (a,)) == b or Op("NOT", (b,)) == a:
        return not idle
    return Op(node.name, (a, b))


class Symbols:
    """Names of labels; a formula may use them in place of numbers. Names that have no number yet are unresolved."""

    def __init__(self, numbers: dict[str, int] | None = None):
        self.numbers = dict(numbers or {})

    def bind(self, name: str, tid: int) -> None:
        if self.numbers.setdefault(name, tid) != tid:
            raise ValueError(f"{name!r} stands for {self.numbers[name]}")

    def _words(self, formula: str) -> list[str]:
        return re.sub(r"([()])", r" \1 ", formula).split()

    def unresolved(self, formula: str) -> list[str]:
        free = {"(", ")"}
        return sorted({w for w in self._words(formula) if w not in free and w.upper() not in SPELLINGS and not w.isdigit() and w not in self.numbers})

    def parse(self, formula: str, notation: str = "prefix") -> Node:
        if missing := self.unresolved(formula):
            raise ValueError(f"unresolved names {missing} in {formula!r}")
        return parse(" ".join(str(self.numbers[w]) if w in self.numbers else w for w in self._words(formula)), notation)


def set_operation(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Distinct rows in both (intersect), in either (union) or in the first alone (difference); columns go by name."""
    b = b.select(*a.columns)
    if how == "union":
        return a.unionByName(b).distinct()
    if how not in ("intersect", "difference"):
        raise ValueError(f"unknown operation {how!r}")
    return a.intersect(b) if how == "intersect" else a.subtract(b)


def combined_arrays(a: str, b: str) -> dict[str, object]:
    """Sorted arrays of ids under the three operations, as columns."""
    return {"both": F.array_sort(F.array_intersect(a, b)), "either": F.array_sort(F.array_union(a, b)), "first_only": F.array_sort(F.array_except(a, b))}
