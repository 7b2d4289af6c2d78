"""Property tests of the NA-aware helpers against plain-Python statements of R semantics."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from broodline.functions.nulls import keep_first, n_distinct_na, not_in, sole_value

KEYS = st.sampled_from(["a", "b", None])
VALS = st.sampled_from(["x", "y", "z", None])
ROWS = st.lists(st.tuples(KEYS, VALS), min_size=1, max_size=25)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=ROWS)
def test_group_helpers_match_r_semantics(spark, rows):
    data = [(k, v, i) for i, (k, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "k string, v string, o bigint")
    got = {r.k: (r.nd, r.sole) for r in df.groupBy("k").agg(
        n_distinct_na("v").alias("nd"), sole_value("v").alias("sole")).collect()}
    first = {r.k: r.v for r in keep_first(df, ["k"], ["o"]).collect()}
    for key in {k for k, _, _ in data}:
        vals = [v for k, v, _ in data if k == key]
        known = {v for v in vals if v is not None}
        assert got[key][0] == len(set(vals))                   # n_distinct counts NA
        assert got[key][1] == (next(iter(known)) if len(known) == 1 else None)
        assert first[key] == vals[0]                           # first row in input order
    kept = [r.v for r in df.where(not_in("v", ["x"])).collect()]
    assert sorted(kept, key=str) == sorted([v for _, v, _ in data if v != "x"], key=str)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=ROWS)
def test_keep_first_ignores_physical_order(spark, rows):
    data = [(k, v, i) for i, (k, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "k string, v string, o bigint")
    a = sorted(map(tuple, keep_first(df, ["k"], ["o"]).collect()), key=str)
    b = sorted(map(tuple, keep_first(df.repartition(3, F.rand(seed=1)), ["k"], ["o"]).collect()),
               key=str)
    assert a == b


LEFT = st.lists(st.tuples(st.sampled_from(["p", "q"]), st.sampled_from(["a", "b", "c", None]),
                          st.integers(0, 9)), min_size=0, max_size=20)
RIGHT_KEYS = st.sets(st.tuples(st.sampled_from(["p", "q"]), st.sampled_from(["a", "b", "d"])),
                     max_size=6)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(left=LEFT, right=RIGHT_KEYS)
def test_left_plus_missing_equals_full_outer_join(spark, left, right):
    """The skew-safe full join equals Spark's full outer join when the right side is unique
    per key with non-NULL keys (the capture side of the pair table)."""
    from broodline.functions.nulls import left_plus_missing
    ldf = spark.createDataFrame(left, "pop string, k string, v int")
    rdf = spark.createDataFrame([(p, k, i) for i, (p, k) in enumerate(sorted(right))],
                                "pop string, k string, w int")
    got = left_plus_missing(ldf, rdf, ["pop", "k"], ["pop", "k"]).select("pop", "k", "v", "w")
    full = ldf.join(rdf, ["pop", "k"], "full").select("pop", "k", "v", "w")
    norm = lambda df: sorted((tuple(map(str, r)) for r in df.collect()))
    assert norm(got) == norm(full)
