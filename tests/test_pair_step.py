"""The pair table makes each input once, and rows without a key, flag or group keep their values."""

import re

import pytest

from broodline.functions.nulls import left_plus_missing
from broodline.operators import history, pairs
from broodline.plans import queries as Q
from broodline.session import stage
from broodline.sources.schemas import BROOD_SCHEMA, CAPTURE_SCHEMA

from .conftest import SF_SMALL


def _nest(k, pop, season, female, male, clutch="first", exp=None):
    return (k, "PARMAJ", pop, season, f"L{k}", female, male, clutch, None, None, None, None, None, None, 1, None, exp)


def _capture(k, pop, bird, season, sex, exp=None):
    return (k, "PARMAJ", pop, bird, season, None, sex, 2, exp)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    nests = [_nest(1, "P", 2000, "F1", "M1"), _nest(2, "P", 2000, "F1", "M2", "second"), _nest(3, "P", 2000, None, "M3"),
             _nest(4, "P", 2001, "F2", None), _nest(5, None, 2001, "F3", "M3", exp="swap"), _nest(6, "P", None, "F4", "M4"),
             _nest(7, "P", 2001, "F5", "M1", None), _nest(8, "P", 2001, "F5", "M5", None), _nest(9, "P", 2002, "F6", "M6", exp="swap"),
             _nest(10, "P", 2000, "F1", "M1", "second")]
    caps = [_capture(11, "P", "F1", 2001, "F"), _capture(12, "P", "F1", 2000, "F"), _capture(13, "P", "M1", 2002, "M"),
            _capture(14, "P", "M2", 2000, "M", "hormone"), _capture(15, "P", "F5", 2002, "F", "hormone"), _capture(16, None, "F3", 2001, "F")]
    d = tmp_path_factory.mktemp("pair_step")
    spark.createDataFrame(nests, BROOD_SCHEMA).write.parquet(f"{d}/brood")
    spark.createDataFrame(caps, CAPTURE_SCHEMA).write.parquet(f"{d}/capture")
    return spark.read.parquet(f"{d}/brood"), spark.read.parquet(f"{d}/capture")


@pytest.mark.parametrize("mode", ["literal", "both_sexes"])
def test_each_table_is_read_once(tables, mode):
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stage(df)

    last = pairs.pairs_table(*tables, mode=mode, stage=kept)
    plans.append(last._jdf.queryExecution().optimizedPlan().toString())
    reads = [x for p in plans for x in p.splitlines() if "Relation [" in x]
    assert sum("CapturePopID#" in x for x in reads) == 1
    assert sum("Species#" in x and "CapturePopID#" not in x for x in reads) == 1
    # the first seasons and the known keys need none of the joins that add the partner counts
    assert plans[1].count("Join LeftOuter") == 0


@pytest.mark.parametrize("mode", ["literal", "both_sexes"])
@pytest.mark.parametrize("labels", [False, True])
def test_staging_changes_no_row(tables, mode, labels):
    one, cut = (pairs.pairs_table(*tables, mode=mode, labels=labels, stage=s) for s in (None, stage))
    assert sorted(map(str, one.collect())) == sorted(map(str, cut.collect()))
    by_row = {r.row_ord: r for r in cut.collect()}
    assert by_row[1].no_order_f == "no" and by_row[7].no_order_f == "yes"  # another clutch; one clutch order only
    assert by_row[3].no_order_f is None  # alone; among the unknown males a capture has another order than nest 4
    assert by_row[4].no_order_m == "no"
    assert by_row[5].Female_exp and by_row[7].Female_exp and not by_row[4].Female_exp
    assert by_row[3].Female_exp is False


def test_left_plus_missing_keeps_rows_without_a_key(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 4)], "k string, _spread int")
    right = spark.createDataFrame([("a", 7), ("c", 8)], "k string, x int")
    want = {("a", 1, 7), ("a", 2, 7), (None, 3, None), ("b", 4, None), ("c", None, 8)}
    for present in (None, left.select("k")):
        rows = left_plus_missing(left, right, ["k"], ["k"], present).collect()
        assert len(rows) == 5 and {tuple(r) for r in rows} == want


def test_seasons_stage_the_pair_table_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(Q, "stage", lambda df: calls.append(df.columns) or stage(df))
    Q.q_event_codes_by_season(spark, SF_SMALL)
    assert len(calls) == 1


def _first_sort_keys(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return set(re.findall(r"\bSort \[(?:coalesce\()?(\w+)#", plan))


def test_sorts_of_the_pair_table_compare_the_bird_first(tables):
    # a population or season is shared by many rows, so it decides few comparisons
    keys = _first_sort_keys(pairs.pairs_table(*tables, labels=True, stage=None))
    assert keys and keys.isdisjoint({"PopID", "BreedingSeason"})


@pytest.mark.parametrize("focal", ["female", "male"])
def test_sorts_of_the_histories_compare_the_bird_first(tables, focal):
    codes = history.event_codes(stage(pairs.final_pairs(pairs.pairs_table(*tables))), focal)
    wide = history.wide_history(codes, focal, years=[2000, 2001, None])
    assert wide.columns == ["pop", focal, "multi_partner", "2000", "2001", "NA"]
    assert focal in _first_sort_keys(wide)
