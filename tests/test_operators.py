"""Hand-written frames per operator, covering the NULL / sentinel branches that the
adapter views do not reach."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from broodline.functions.clean import clutch_order, coalesce_versions, experiment_flag, \
    recode_experiment
from broodline.functions.nulls import keep_first, n_distinct_na, not_in, sole_value
from broodline.operators import breeding, captures, fledge, overview, pairs
from broodline.sources.schemas import BROOD_SCHEMA, CAPTURE_SCHEMA

D = dt.date(2020, 4, 1)


def brood_rows(spark, rows):
    """rows: dicts with any subset of the brood columns."""
    names = [f.name for f in BROOD_SCHEMA.fields]
    data = [tuple(r.get(n) for n in names) for r in rows]
    return spark.createDataFrame(data, BROOD_SCHEMA)


def cap_rows(spark, rows):
    names = [f.name for f in CAPTURE_SCHEMA.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], CAPTURE_SCHEMA)


def test_experiment_rules(spark):
    vals = ["NA;NA;NA", "NA", "FALSE", "", "UNKNOWN", "a control group", "brood swap", None]
    df = spark.createDataFrame([(v,) for v in vals], "e string")
    got = df.select("e", experiment_flag("e", True).alias("p"), experiment_flag("e", False).alias("o"),
                    recode_experiment("e").alias("r")).collect()
    res = {r.e: (r.p, r.o, r.r) for r in got}
    assert res["NA;NA;NA"] == (False, False, None)
    assert res["a control group"] == (False, False, None)
    assert res[""] == (False, True, "")          # blank: none for pairs, experiment elsewhere
    assert res["UNKNOWN"] == (False, True, "UNKNOWN")
    assert res["brood swap"] == (True, True, "brood swap")
    assert res[None] == (False, False, None)


def test_clutch_order(spark):
    df = spark.createDataFrame([(v,) for v in ["first", "replacement", "second", None, "third"]],
                               "c string")
    assert [r.o for r in df.select(clutch_order("c").alias("o")).collect()] == [1, 2, 3, 4, None]


def test_null_helpers(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("a", "y"), ("b", "z"), ("b", "z"),
                                ("c", None)], "g string, v string")
    got = {r.g: (r.nd, r.nk, r.sole) for r in df.groupBy("g").agg(
        n_distinct_na("v").alias("nd"), F.count_distinct("v").alias("nk"),
        sole_value("v").alias("sole")).collect()}
    assert got == {"a": (3, 2, None), "b": (1, 1, "z"), "c": (1, 0, None)}
    kept = df.where(not_in("v", ["x", "y"])).collect()
    assert sorted((r.g, r.v) for r in kept) == sorted([("a", None), ("b", "z"), ("b", "z"), ("c", None)])


def test_keep_first_null_keys_and_order(spark):
    df = spark.createDataFrame([(None, 3, "c"), (None, 1, "a"), ("k", 5, "e"), ("k", 2, "b")],
                               "k string, o bigint, v string")
    got = sorted((r.k or "", r.v) for r in keep_first(df, ["k"], ["o"]).collect())
    assert got == [("", "a"), ("k", "b")]


def test_coalesce_versions_missing_column(spark):
    df = spark.createDataFrame([(1, None), (None, 4)], "NumberFledged_observed int, other int")
    out = coalesce_versions(df, {"NumberFledged": ("NumberFledged_observed", "NumberFledged")},
                            {"NumberFledged": "int"})
    assert [r.NumberFledged for r in out.collect()] == [1, None]


def test_pairing_brood_sentinels_and_case(spark):
    b = brood_rows(spark, [
        dict(row_ord=1, Species="PARMAJ", PopID="P", BreedingSeason=2000, FemaleID="1000000", MaleID=None),
        dict(row_ord=2, Species="PARMAJ", PopID="P", BreedingSeason=2000, FemaleID="f1", MaleID="unknown"),
        dict(row_ord=3, Species="PARMAJ", PopID="P", BreedingSeason=2000, FemaleID="f2", MaleID="UNKNOWN"),
        dict(row_ord=4, Species="PARMAJ", PopID="P", BreedingSeason=2000, FemaleID=None, MaleID=None),
        dict(row_ord=5, Species=None, PopID="P", BreedingSeason=2000, FemaleID="f3", MaleID="m"),
    ])
    got = {r.row_ord: (r.FemaleID, r.MaleID) for r in pairs.pairing_brood(b).collect()}
    # both-unknown row survives (filter ran before the sentinel recode); lower-case
    # 'unknown' is not a sentinel and only becomes 'UNKNOWN' by upper-casing
    assert got == {1: (None, None), 2: ("F1", "UNKNOWN"), 3: ("F2", None)}


def test_partner_counts_and_recode(spark):
    b = brood_rows(spark, [
        dict(row_ord=1, Species="PARMAJ", PopID="P", BreedingSeason=2000, FemaleID="F", MaleID="A"),
        dict(row_ord=2, Species="PARMAJ", PopID="P", BreedingSeason=2000, FemaleID="F", MaleID="B"),
        dict(row_ord=3, Species="PARMAJ", PopID="P", BreedingSeason=2000, FemaleID="F", MaleID=None),
        dict(row_ord=4, Species="PARMAJ", PopID="P", BreedingSeason=2000, FemaleID="F", MaleID="A",
             LocationID="dup"),
        dict(row_ord=5, Species="PARMAJ", PopID="P", BreedingSeason=2000, FemaleID="G", MaleID="A"),
    ])
    cp = pairs.clean_pairs(pairs.pairing_brood(b))
    rows = {(r.FemaleID, r.MaleID): r for r in cp.collect()}
    assert len(rows) == 4 and rows[("F", "A")].LocationID is None   # keep-first by row_ord
    assert rows[("F", "A")].Num_male_partners == 2
    assert rows[("F", "A")].MaleID_recode == "A" and rows[("F", None)].MaleID_recode is None
    assert rows[("G", "A")].MaleID_known == "A"
    assert rows[("F", "A")].Num_female_partners == 2 and rows[("F", None)].Num_female_partners is None


def test_first_season_modes(spark):
    b = brood_rows(spark, [
        dict(row_ord=1, Species="PARMAJ", PopID="P", BreedingSeason=2001, FemaleID="F", MaleID=None),
        dict(row_ord=2, Species="PARMAJ", PopID="P", BreedingSeason=2003, FemaleID="F", MaleID="M"),
        dict(row_ord=3, Species="PARMAJ", PopID="P", BreedingSeason=2002, FemaleID=None, MaleID="N"),
    ])
    ref = pairs.pairing_brood(b)
    cp = pairs.clean_pairs(ref)
    lit = {r.IndvID: r.breed_year for r in pairs.first_season(cp, ref, "literal").collect()}
    both = {r.IndvID: r.breed_year for r in pairs.first_season(cp, ref, "both_sexes").collect()}
    assert lit == {"F": 2003}                  # only females, only seasons with a known male
    assert both == {"F": 2001, "M": 2003, "N": 2002}


def test_build_pairs_capture_only_and_flags(spark):
    b = brood_rows(spark, [
        dict(row_ord=1, Species="PARMAJ", PopID="P", BreedingSeason=2000, FemaleID="F1", MaleID="M1",
             ClutchType_calculated="first"),
        dict(row_ord=2, Species="PARMAJ", PopID="P", BreedingSeason=2001, FemaleID="F1", MaleID="M2",
             ClutchType_calculated="first", ExperimentID="brood swap"),
        dict(row_ord=3, Species="PARMAJ", PopID="P", BreedingSeason=2000, FemaleID=None, MaleID="M3",
             ClutchType_calculated="third"),
    ])
    c = cap_rows(spark, [
        dict(row_ord=10, Species="PARMAJ", CapturePopID="P", IndvID="F1", BreedingSeason=2002,
             Sex_observed="F", CaptureDate=D),
        dict(row_ord=11, Species="PARMAJ", CapturePopID="P", IndvID="F1", BreedingSeason=1999,
             Sex_observed="F", CaptureDate=D),
    ])
    po = pairs.pairs_table(b, c)
    rows = {(r.BreedingSeason, r.FemaleID, r.MaleID): r for r in po.collect()}
    assert set(rows) == {(2000, "F1", "M1"), (2001, "F1", "M2"), (2000, None, "M3"), (2002, "F1", None)}
    cap_only = rows[(2002, "F1", None)]
    assert cap_only.brood is None and cap_only.Record_f == "yes" and cap_only.source_rank == 1
    # the experimental nest of 2001 flags the female in every season, and Male_exp too
    assert all(rows[k].Female_exp and rows[k].Male_exp for k in rows if k[1] == "F1")
    assert rows[(2000, None, "M3")].order is None            # unknown clutch text
    assert rows[(2000, None, "M3")].no_order_m == "no"


def test_breeding_sentinels_and_fidelity(spark):
    b = brood_rows(spark, [
        dict(row_ord=1, Species="PARMAJ", PopID="P", BreedingSeason=2000, FemaleID="1", MaleID="M"),
        dict(row_ord=2, Species="PARMAJ", PopID="P", BreedingSeason=2000, FemaleID="1e+06", MaleID="M"),
        dict(row_ord=3, Species="PARMAJ", PopID="P", BreedingSeason=2000, FemaleID="F", MaleID="0"),
        dict(row_ord=4, Species="PARMAJ", PopID="P", BreedingSeason=2000, FemaleID="F", MaleID="M",
             ClutchType_calculated="first", LayDate_observed=D),
        dict(row_ord=5, Species="PARMAJ", PopID="P", BreedingSeason=2001, FemaleID="F", MaleID="M",
             ClutchType_calculated="first"),
        dict(row_ord=6, Species="PARMAJ", PopID="P", BreedingSeason=2001, FemaleID="F", MaleID="N",
             ClutchType_calculated="second", LayDate_observed=D),
        dict(row_ord=7, Species="PARMAJ", PopID="P", BreedingSeason=2002, FemaleID="F", MaleID="O",
             ClutchType_calculated="first"),
        dict(row_ord=8, Species="PARMAJ", PopID="P", BreedingSeason=2002, FemaleID=None, MaleID="O",
             ExperimentID=""),
    ])
    rec = breeding.breeding_records(b)
    assert rec.count() == 5
    assert {r.Experiment for r in rec.where(F.col("FemaleID").isNull()).collect()} == {"y"}
    fid = {r.row_ord: (r.partner, r.num_yrs) for r in breeding.partner_fidelity(rec).collect()}
    # 2001: first record by lay date is row 6 (dated), NULL lay date sorts last
    assert fid[4] == (None, 3) and fid[6] == ("switched", 3) and fid[5] == (None, 3)
    assert fid[7] == ("switched", 3) and fid[8] == (None, 0)


def test_capture_records_across_pops_and_na(spark):
    c = cap_rows(spark, [
        dict(row_ord=1, Species="PARMAJ", CapturePopID="A", IndvID="X", BreedingSeason=2000, Age_calculated=1),
        dict(row_ord=2, Species="PARMAJ", CapturePopID="B", IndvID="X", BreedingSeason=2000,
             Age_calculated=2, ExperimentID="hormone"),
        dict(row_ord=3, Species="PARMAJ", CapturePopID="A", IndvID="Y", BreedingSeason=2000, Age_calculated=None),
    ])
    got = [tuple(r) for r in captures.capture_records(c).collect()]
    assert got == [("A", "X", 2000, 1, "y")]


def _fledge_rows(spark):
    rows = []
    k = 0
    # population A: 3 seasons, constant share of second clutches; B: one season;
    # C: 2 of 3 seasons without any fledgling count -> pooled fit
    for pop, season, n in [("A", 2000, 4), ("A", 2001, 6), ("A", 2002, 5), ("B", 2000, 3),
                           ("C", 2000, 2), ("C", 2001, None), ("C", 2002, None)]:
        for i, ct in enumerate(["first", "first", "second"]):
            k += 1
            rows.append(dict(row_ord=k, Species="PARMAJ", PopID=pop, BreedingSeason=season,
                             LocationID=f"L{i}", FemaleID=f"F{i}" if i < 2 else "1",
                             ClutchType_calculated=ct,
                             NumberFledged_observed=None if n is None else n + i))
    return brood_rows(spark, rows)


def test_fledge_chain_edge_cases(spark):
    inp = fledge.fledge_input(_fledge_rows(spark))
    m = fledge.fledge_metrics(inp)
    adj = {(r.PopID, r.BreedingSeason): r for r in fledge.adjust_by_regression(m).collect()}
    a = adj[("A", 2000)]
    assert a.females == 3 and a.nests == 3 and a.clutches == 3
    assert a.fledge_fem_avg == pytest.approx((4 + 5) / 2)     # sentinel female "1" excluded
    assert a.prop_second_clutch == pytest.approx(1 / 3)
    # constant x: prediction = mean ratio of the population
    ratios = [adj[("A", y)].fledge_ratio for y in (2000, 2001, 2002)]
    assert a.fledge_ratio_pred == pytest.approx(sum(ratios) / 3)
    assert adj[("C", 2001)].pooled and not a.pooled
    std = {(r.PopID, r.BreedingSeason): r for r in fledge.standardise(
        fledge.adjust_by_regression(m)).collect()}
    assert std[("B", 2000)].pop_tot_fledge_sd is None and std[("B", 2000)].envStd_fledge_num is None
    chg = fledge.standardised_change(fledge.standardise(fledge.adjust_by_regression(m)))
    assert chg.count() == 7


def test_population_overview(spark):
    b = brood_rows(spark, [
        dict(row_ord=1, PopID="A", BreedingSeason=2000, FemaleID="F", MaleID="M"),
        dict(row_ord=2, PopID="A", BreedingSeason=2003, FemaleID="F", MaleID="M"),
        dict(row_ord=3, PopID="B", BreedingSeason=2000, FemaleID="F", MaleID=None),
    ])
    pops = spark.createDataFrame([("A",), ("B",), ("Z",)], "pop_code string")
    done = spark.createDataFrame([("A",)], "PopID string")
    got = [tuple(r) for r in overview.population_overview(b, pops, done).collect()]
    assert got == [("A", 1, 4, "yes")]
    miss = sorted(r.pop_code for r in overview.populations_missing(pops, done).collect())
    assert miss == ["B", "Z"]
