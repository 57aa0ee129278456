import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vexil.operators import access, selectors, workload
from vexil.plans import algebra
from vexil.plans.predicate import Label, Op, evaluate, parse

NODES = st.recursive(
    st.integers(0, 4).map(Label),
    lambda inner: inner.map(lambda a: Op("NOT", (a,))) | st.tuples(st.sampled_from(["AND", "OR"]), inner, inner).map(lambda t: Op(t[0], t[1:])),
    max_leaves=8,
)
EVERY = frozenset(range(12))
SETS = st.lists(st.tuples(st.frozensets(st.integers(0, 11)), st.booleans()), min_size=5, max_size=5)


@given(NODES, SETS)
@settings(max_examples=300, deadline=None)
def test_sets_and_simplification(node, sets):
    known = {i: algebra.Known(ids, but) for i, (ids, but) in enumerate(sets)}
    held = {i: EVERY - ids if but else ids for i, (ids, but) in enumerate(sets)}
    got = algebra.evaluate(node, known)
    want = {x for x in EVERY if evaluate(node, {i for i in held if x in held[i]})}
    assert (EVERY - got.ids if got.but else got.ids) == want
    short = algebra.simplify(node, {i: k for i, k in known.items() if k.kind in ("none", "all")})
    for x in EVERY:
        mine = {i for i in held if x in held[i]}
        assert (short if isinstance(short, bool) else evaluate(short, mine)) == evaluate(node, mine)


def test_symbols():
    names = algebra.Symbols({"red": 1})
    assert names.unresolved("AND red (NOT blue)") == ["blue"]
    with pytest.raises(ValueError):
        names.parse("AND red NOT blue")
    names.bind("blue", 2)
    assert names.parse("AND red NOT blue") == parse("AND 1 NOT 2")
    with pytest.raises(ValueError):
        names.bind("red", 3)


def test_selectors(spark):
    rows = spark.createDataFrame([(i, f"k{i % 4}" if i % 7 else None) for i in range(200)], "vec_id long, kind string")
    grants = spark.createDataFrame([(i, 1) for i in range(0, 200, 3)] + [(70_000, 1)], "vec_id long, tid int")
    three, low = selectors.label(grants, 1), selectors.id_range(0, 50)
    packed = selectors.label_bitmap(grants, 1)
    called = selectors.callback(lambda kind: kind == "k2", "kind")
    for got, want in (
        (three & low, lambda i: i % 3 == 0 and i < 50),
        (three ^ low, lambda i: (i % 3 == 0) != (i < 50)),
        (~packed | low, lambda i: i % 3 or i < 50),
        (called & selectors.everything(), lambda i: i % 7 and i % 4 == 2),
        (selectors.id_list([]) | selectors.where(F.col("kind") == "k1"), lambda i: i % 7 and i % 4 == 1),
        (selectors.id_table(grants) & packed, lambda i: i % 3 == 0),
    ):
        out = got.filter(rows)
        assert out.columns == ["vec_id", "kind"]
        assert {r.vec_id for r in out.collect()} == {i for i in range(200) if want(i)}


def test_random_numbers_are_the_same_in_sql(spark):
    con = duckdb.connect()
    want = con.execute(f"SELECT a, b, {workload.uniform_sql('a', 'b', seed=7)} AS u FROM (SELECT i * 104729 AS a, i % 13 AS b FROM range(0, 5000) r(i))").fetchall()
    df = spark.range(5000).select((F.col("id") * 104729).alias("a"), (F.col("id") % 13).alias("b"))
    got = [tuple(r) for r in df.select("a", "b", workload.uniform("a", "b", seed=7).alias("u")).orderBy("a").collect()]
    assert got == sorted(want)
    u = [x for _, _, x in got]
    assert all(0 < x < 1 for x in u) and all(abs(sum(x < t for x in u) / 5000 - t) < 0.03 for t in (0.1, 0.5, 0.9))
    pairs = [(x, y) for x, y in zip(u, u[1:])]
    assert abs(sum(x < 0.5 and y < 0.5 for x, y in pairs) / len(pairs) - 0.25) < 0.03


def test_allocation_and_repair(spark):
    known = spark.createDataFrame([(5, 0), (7, 3)], "tid int, number long")
    tids = spark.createDataFrame([(5,), (7,), (1,), (9,), (2,)], "tid int")
    assert {tuple(r) for r in access.allocate(known, tids, [1]).collect()} == {(5, 0), (7, 3), (1, 2), (2, 4), (9, 5)}
    vectors = spark.range(4).select(F.col("id").alias("vec_id"))
    grants = spark.createDataFrame([(0, 1), (0, 1), (1, 2), (1, 1)], "vec_id long, tid int")
    fixed = access.repair(vectors, grants)
    assert fixed["metadata"].first().asDict() == {"train_size": 4, "n_labels": 2, "n_grants": 3, "avg_labels_per_vec": 0.75}
    assert {r.vec_id: r.labels for r in fixed["lists"].collect()} == {0: [1], 1: [1, 2], 2: [], 3: []}


def test_dispatch_and_predicates(spark):
    vectors = spark.range(400).select(F.col("id").alias("vec_id"))
    counts = {r["tid"]: r["count"] for r in workload.synthesise("uniform", vectors, 7).groupBy("tid").count().collect()}
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for method in ("zipf", "skewed", "hierarchical"):
        out = workload.synthesise(method, vectors, 12)
        assert out.select("vec_id").distinct().count() == 400 and out.count() == out.distinct().count()
    with pytest.raises(ValueError):
        workload.synthesise("other", vectors, 3)
    nodes = workload.predicates(list(range(30)), 100, frequent=[0, 1, 2])
    assert len(nodes) == len(set(nodes)) == 100
    ands = [n for n in nodes if n.name == "AND"]
    assert 0.3 < sum(n.parts[0] in (Label(0), Label(1), Label(2)) for n in ands) / len(ands) < 0.8
