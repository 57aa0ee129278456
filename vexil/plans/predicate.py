"""Label predicates in prefix or postfix notation: one tree, compiled to Spark columns, SQL and text.

A number is true for a vector that has that label. A vector without labels has none of them, so NOT holds for it, unless the
caller asks for the narrower reading (include_unlabelled=False), in which it fails every predicate. Malformed formulas raise ValueError.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings of the operators.
SPELLINGS = {"AND": "AND", "&": "AND", "∧": "AND", "OR": "OR", "|": "OR", "∨": "OR", "NOT": "NOT", "!": "NOT", "¬": "NOT"}


@dataclass(frozen=True)
class Label:
    tid: int


@dataclass(frozen=True)
class Op:
    name: str
    parts: tuple["Node", ...]


Node = Label | Op


def _tokens(formula: str) -> list[str | int]:
    out: list[str | int] = []
    for word in formula.replace("(", " ").replace(")", " ").split():
        if word.upper() in SPELLINGS:
            out.append(SPELLINGS[word.upper()])
        elif word.isascii() and word.isdigit():
            out.append(int(word))
        else:
            raise ValueError(f"unknown token {word!r} in {formula!r}")
    return out


def _fold(tokens: list[str | int], formula: str, left_first: bool) -> Node:
    stack: list[Node] = []
    for t in tokens:
        if isinstance(t, int):
            stack.append(Label(t))
            continue
        size = 1 if t == "NOT" else 2
        if len(stack) < size:
            raise ValueError(f"{t} lacks operands in {formula!r}")
        parts = [stack.pop() for _ in range(size)]
        stack.append(Op(t, tuple(reversed(parts) if left_first else parts)))
    if len(stack) != 1:
        raise ValueError(f"{len(stack)} operands are left in {formula!r}")
    return stack[0]


def parse(formula: str, notation: str = "prefix") -> Node:
    if notation not in ("prefix", "postfix"):
        raise ValueError(f"unknown notation {notation!r}")
    tokens = _tokens(formula)
    return _fold(tokens, formula, True) if notation == "postfix" else _fold(tokens[::-1], formula, False)


def show(node: Node, notation: str = "infix") -> str:
    if isinstance(node, Label):
        return str(node.tid)
    parts = [show(p, notation) for p in node.parts]
    if notation == "prefix":
        return " ".join([node.name, *parts])
    if notation == "postfix":
        return " ".join([*parts, node.name])
    return f"NOT {parts[0]}" if node.name == "NOT" else f"({f' {node.name} '.join(parts)})"


def labels(node: Node) -> set[int]:
    return {node.tid} if isinstance(node, Label) else set().union(*map(labels, node.parts))


def classify(node: Node) -> str:
    """SINGLE, NOT, OR, AND or AND_NOT: by the outermost operator, as formulas in prefix notation show it; an AND with a NOT anywhere is AND_NOT."""
    if isinstance(node, Label):
        return "SINGLE"
    return "AND_NOT" if node.name == "AND" and any(o.name == "NOT" for o in _ops(node)) else node.name


def _ops(node: Node) -> list[Op]:
    return [] if isinstance(node, Label) else [node, *(o for p in node.parts for o in _ops(p))]


def to_column(node: Node, held: str | Column = "labels", include_unlabelled: bool = True) -> Column:
    """A boolean column over an array of labels; a null array counts as empty."""
    held = F.coalesce(F.col(held) if isinstance(held, str) else held, F.expr("cast(array() as array<int>)"))

    def go(n: Node) -> Column:
        if isinstance(n, Label):
            return F.array_contains(held, n.tid)
        parts = [go(p) for p in n.parts]
        return ~parts[0] if n.name == "NOT" else parts[0] & parts[1] if n.name == "AND" else parts[0] | parts[1]

    return go(node) if include_unlabelled else (F.size(held) > 0) & go(node)


def to_sql(node: Node, held: str = "labels") -> str:
    """The same condition for DuckDB."""
    if isinstance(node, Label):
        return f"list_contains({held}, {node.tid})"
    parts = [to_sql(p, held) for p in node.parts]
    return f"(NOT {parts[0]})" if node.name == "NOT" else f"({f' {node.name} '.join(parts)})"


def evaluate(node: Node, held: set[int]) -> bool:
    if isinstance(node, Label):
        return node.tid in held
    parts = [evaluate(p, held) for p in node.parts]
    return not parts[0] if node.name == "NOT" else all(parts) if node.name == "AND" else any(parts)


def qualified(label_lists: DataFrame, formulas: dict[str, Node]) -> DataFrame:
    """filter_id, vec_id: all predicates in one pass over label_lists (vec_id, labels)."""
    tests = F.array(*(F.when(to_column(n), F.lit(name)) for name, n in formulas.items()))
    return label_lists.select("vec_id", F.explode(F.filter(tests, lambda x: x.isNotNull())).alias("filter_id"))


def selectivity(label_lists: DataFrame, formulas: dict[str, Node]) -> DataFrame:
    """filter_id, n_qualified, selectivity of every predicate, those that nothing meets included."""
    sums = label_lists.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(to_column(node)).alias(f"c{i}") for i, node in enumerate(formulas.values())))
    rows = F.inline(F.array(*(F.struct(F.lit(name).alias("filter_id"), F.col(f"c{i}").alias("n_qualified")) for i, name in enumerate(formulas))))
    return sums.select("n", rows).select("filter_id", "n_qualified", F.try_divide("n_qualified", "n").alias("selectivity"))


def resolve(per_query: Column, default: Column, label: Column) -> Column:
    """Which filter counts: the query's own formula, else the default one, else its label (negative or null: none)."""
    blank = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(blank(per_query), blank(default), F.when(label >= 0, label.cast("string")))


def representatives(filters: DataFrame, most: int = 6) -> DataFrame:
    """Of filters (formula, kind, selectivity): the least and the most selective AND and AND_NOT, the middle OR and NOT, without repeats."""
    from pyspark.sql import Window

    once = filters.dropDuplicates(["formula"])
    by = Window.partitionBy("kind")
    ranked = once.withColumns({"rank": F.row_number().over(by.orderBy("selectivity", "formula")), "n": F.count(F.lit(1)).over(by)})
    ends = F.col("kind").isin("AND", "AND_NOT") & ((F.col("rank") == 1) | (F.col("rank") == F.col("n")))
    middle = F.col("kind").isin("OR", "NOT") & (F.col("rank") == F.floor(F.col("n") / 2) + 1)
    turn = F.element_at(F.create_map(*(x for k, v in {"AND": 0, "AND_NOT": 1, "OR": 2, "NOT": 3}.items() for x in (F.lit(k), F.lit(v)))), F.col("kind"))
    return ranked.where(ends | middle).orderBy(turn, "rank").limit(most).drop("n")
