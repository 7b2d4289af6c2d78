"""Hot keys: one population-season holds a third of all rows under an unknown female, and
one female has hundreds of partners. AQE's skew-join split is forced on (tiny thresholds)
and the results are compared with the oracle SQL run by DuckDB on the same fixture
(brute force over the full rows)."""

import os
import random
import tempfile

import duckdb
import pytest

from broodline.functions.nulls import left_plus_missing
from broodline.operators import breeding, fledge, history, pairs
from broodline.plans.oracle_sql import oracle_queries
from broodline.plans.queries import FINAL10, round_doubles
from broodline.sources.adapters import BROOD_VIEW_SQL, CAPTURE_VIEW_SQL
from broodline.sources.schemas import BROOD_SCHEMA, CAPTURE_SCHEMA, PAIRS_SCHEMA

import sys
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from oracle_check import rows_of  # noqa: E402


def _fixture():
    rnd = random.Random(7)
    brood, cap = [], []
    k = 0
    types = ["first", "first", "second", "replacement", None]
    for i in range(3600):
        k += 1
        pop = "P" if i % 3 else "Q"
        season = 2000 + rnd.randrange(4)
        if i % 3 == 1:                       # hot: unknown female, one population-season
            pop, season, f = "P", 2001, None
        else:
            f = f"F{rnd.randrange(300)}"
        if i % 11 == 0:                      # hot female with many partners in one season
            pop, season, f = "P", 2002, "F0"
        m = None if rnd.random() < 0.2 else f"M{rnd.randrange(400)}"
        if i % 3 == 1 and i % 5:             # hot group survives de-duplication
            m = f"X{i}"
        exp = rnd.choice([None, None, None, "NA", "brood swap", "control", ""])
        nf = None if rnd.random() < 0.1 else rnd.randrange(10)
        brood.append((k, "PARMAJ", pop, season, f"L{rnd.randrange(60)}", f, m,
                      rnd.choice(types), None, None, None, None, None, None, nf, None, exp))
    for j in range(1500):
        k += 1
        sex = rnd.choice(["F", "M", None])
        ind = f"F{rnd.randrange(300)}" if sex == "F" else f"M{rnd.randrange(400)}"
        cap.append((k, "PARMAJ", rnd.choice(["P", "Q"]), ind, 2000 + rnd.randrange(5), None, sex,
                    rnd.randrange(1, 5), rnd.choice([None, None, "hormone"])))
    return brood, cap


@pytest.fixture(scope="module")
def tables(spark):
    b, c = _fixture()
    d = tempfile.mkdtemp(prefix="broodline-skew-")
    bp, cp = os.path.join(d, "brood"), os.path.join(d, "capture")
    spark.createDataFrame(b, BROOD_SCHEMA).write.parquet(bp)
    spark.createDataFrame(c, CAPTURE_SCHEMA).write.parquet(cp)
    return bp, cp


@pytest.fixture()
def skew_conf(spark):
    keys = {"spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _spark_query(name, b, c):
    fp = lambda: pairs.final_pairs(pairs.pairs_table(b, c))
    return {
        "final_pairs": lambda: fp().select(*FINAL10),
        "event_codes_female": lambda: history.event_codes(fp(), "female"),
        "event_codes_male": lambda: history.event_codes(pairs.drop_unorderable(fp(), "male"), "male"),
        "partner_fidelity": lambda: breeding.partner_fidelity(breeding.breeding_records(b)),
        "drop_unorderable_males": lambda: pairs.drop_unorderable(fp(), "male").select(*FINAL10),
        "pair_diagnostics": lambda: history.pair_diagnostics(fp()),
        "fledge_metrics": lambda: round_doubles(fledge.fledge_metrics(fledge.fledge_input(b))),
    }[name]()


@pytest.mark.parametrize("name", ["final_pairs", "event_codes_female", "event_codes_male",
                                  "partner_fidelity", "drop_unorderable_males", "pair_diagnostics",
                                  "fledge_metrics"])
def test_hot_keys_match_brute_force(spark, tables, skew_conf, name):
    bp, cp = tables
    b, c = spark.read.parquet(bp), spark.read.parquet(cp)
    sdf = _spark_query(name, b, c)
    sql = oracle_queries()[name].replace(BROOD_VIEW_SQL, f"select * from read_parquet('{bp}/*.parquet')") \
        .replace(CAPTURE_VIEW_SQL, f"select * from read_parquet('{cp}/*.parquet')")
    res = duckdb.connect().execute(sql)
    dcols = [x[0] for x in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    srows = sorted(rows_of(sdf.columns, [tuple(r) for r in sdf.collect()]))
    drows = sorted(rows_of(dcols, res.fetchall()))
    assert len(srows) == len(drows) and srows == drows


def test_join_back_is_split_for_hot_unknown_female(spark, tables, skew_conf):
    """The aggregate-and-join-back of the partner counts is a plain (NULL-safe) equi-join,
    so AQE splits the partition of the hot unknown-female key."""
    bp, _ = tables
    cp = pairs.clean_pairs(pairs.pairing_brood(spark.read.parquet(bp)))
    cp.collect()
    plan = cp._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin(skew=true)" in plan


@pytest.fixture(scope="module")
def unknown_males(spark):
    """Pair rows of which 60 % have an unknown male and 20 % belong to one male."""
    rnd = random.Random(3)
    rows = []
    for k in range(20_000):
        male = None if rnd.random() < 0.6 else "HOT" if rnd.random() < 0.5 else f"M{rnd.randrange(3000)}"
        bad = male and male != "HOT" and int(male[1:]) % 50 == 0
        rows.append(("P", "n", 2000 + rnd.randrange(4), f"F{rnd.randrange(5000)}", 1, male, 1, 1, "no", "yes" if bad else "no", 0, k))
    d = os.path.join(tempfile.mkdtemp(prefix="broodline-skew-"), "pairs")
    spark.createDataFrame(rows, PAIRS_SCHEMA).write.parquet(d)
    return spark.read.parquet(d)


def largest_share(df):
    n = [len(p) for p in df.rdd.glom().collect()]
    return max(n) / sum(n)


def joins(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [x.strip(" +-:*()0123456789") for x in plan.splitlines() if "SortMergeJoin" in x], plan


def test_unknown_and_hot_males_are_spread(unknown_males, skew_conf):
    """No partition holds all unknown males, and the hot male's partition is split."""
    kept = pairs.drop_unorderable(unknown_males, "male")
    found, plan = joins(kept)
    assert len(found) == 1 and "skew=true" in found[0], plan
    assert largest_share(kept.where("male is null")) < 0.6
    assert kept.where("male is null").count() == unknown_males.where("male is null").count()


def test_rows_without_a_key_go_round_the_full_join(spark, unknown_males, skew_conf):
    males = spark.createDataFrame([(f"M{i}", i) for i in range(0, 3000, 7)], "IndvID string, x int")
    out = left_plus_missing(unknown_males, males, ["male"], ["IndvID"])
    found, plan = joins(out)
    assert any("LeftOuter" in x and "skew=true" in x for x in found), plan
    assert largest_share(out.where("male is null")) < 0.6


def test_every_join_of_the_coder_is_spread(unknown_males, skew_conf):
    """Birds without a previous partner share no key, and the one population is split."""
    codes = history.event_codes(unknown_males, "female")
    found, plan = joins(codes)
    assert sum("skew=true" in x for x in found) >= 1, plan
    assert largest_share(codes) < 0.5
    assert largest_share(history.pair_diagnostics(unknown_males)) < 0.5
