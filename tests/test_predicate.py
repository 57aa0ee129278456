import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vexil.plans.predicate import Label, Op, classify, evaluate, parse, show, to_column

NODES = st.recursive(
    st.integers(0, 5).map(Label),
    lambda inner: inner.map(lambda a: Op("NOT", (a,))) | st.tuples(st.sampled_from(["AND", "OR"]), inner, inner).map(lambda t: Op(t[0], t[1:])),
    max_leaves=6,
)


@given(NODES, st.sets(st.integers(0, 5)))
@settings(max_examples=200, deadline=None)
def test_notations_agree(node, held):
    assert parse(show(node, "prefix")) == node
    assert parse(show(node, "postfix"), "postfix") == node
    assert evaluate(Op("NOT", (node,)), held) != evaluate(node, held)


@pytest.mark.parametrize("formula", ["", "AND 1", "1 2", "NOT", "AND x 1", "1 AND 2", "AND 1 -2"])
def test_malformed_raises(formula):
    with pytest.raises(ValueError):
        parse(formula)


def test_spellings_and_kinds():
    assert parse("∧ 1 ¬ 2") == parse("& 1 (! 2)") == parse("AND 1 NOT 2")
    formulas = ("1", "NOT 1", "AND 1 2", "AND 1 NOT 2", "OR 1 NOT 2", "AND 1 OR 2 3", "NOT AND 1 2", "AND OR 1 2 NOT 3")
    assert [classify(parse(f)) for f in formulas] == ["SINGLE", "NOT", "AND", "AND_NOT", "OR", "AND", "NOT", "AND_NOT"]


def test_columns_follow_evaluate(spark):
    rows = [(0, []), (1, [1]), (2, [1, 2]), (3, None)]
    df = spark.createDataFrame(rows, "vec_id long, labels array<int>")
    for formula in ("NOT 1", "AND 1 NOT 2", "OR 2 NOT 1"):
        node = parse(formula)
        assert {r.vec_id for r in df.where(to_column(node)).collect()} == {i for i, held in rows if evaluate(node, set(held or []))}
        assert {r.vec_id for r in df.where(to_column(node, include_unlabelled=False)).collect()} == {i for i, held in rows if held and evaluate(node, set(held))}
