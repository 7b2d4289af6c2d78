"""Unknown seasons and populations: values that sort last, groups of their own."""

import pytest

from broodline.operators import breeding, fledge, history, overview, pairs
from broodline.sources.schemas import PAIRS_SCHEMA

RECORDS = ("PopID string, BreedingSeason int, LocationID string, FemaleID string, MaleID string, "
           "LayDate_observed date, ClutchType_calculated string, Experiment string, row_ord long")


def record(k, pop, season, female="F1", male="M1"):
    return (pop, season, "L", female, male, None, "first", "n", k)


def test_partner_fidelity_keeps_every_record(spark):
    """An unknown season comes last: no status for it, none from it, one more season."""
    rows = [record(1, "P", None), record(2, "P", 2000), record(3, "P", 2001, male="M2"),
            record(4, None, 2000), record(5, None, 2001), record(6, "P", 2002, female=None)]
    got = {r.row_ord: r for r in breeding.partner_fidelity(spark.createDataFrame(rows, RECORDS)).collect()}
    assert {k: r.partner for k, r in got.items()} == {1: None, 2: None, 3: "switched", 4: None, 5: "same", 6: None}
    assert [got[k].num_yrs for k in range(1, 7)] == [3, 3, 3, 2, 2, 0]


def pair(k, pop, year, female, male, n=1):
    return (pop, "n", year, female, n, male, n, 1, "no", "no", 0, k)


@pytest.fixture()
def pair_rows(spark):
    rows = [pair(1, "A", 2000, "F1", "M1"), pair(2, "A", 2001, "F2", "M1"), pair(3, "A", None, "F1", "M1"),
            pair(4, None, 2000, "F3", "M3"), pair(5, None, 2001, "F3", "M3"), pair(6, "A", None, "F1", "M2")]
    return spark.createDataFrame(rows, PAIRS_SCHEMA)


def test_event_codes_of_an_unknown_year_and_population(pair_rows):
    got = {(r.pop, r.female, r.year): r.event_code for r in history.event_codes(pair_rows, "female").collect()}
    assert got == {
        ("A", "F1", 2000): "3", ("A", "F1", 2001): "6", ("A", "F1", None): "3",
        ("A", "F2", 2000): "0", ("A", "F2", 2001): "3", ("A", "F2", None): "6",
        (None, "F3", 2000): "3", (None, "F3", 2001): "1"}


def test_wide_histories_have_a_column_for_the_unknown_year(pair_rows):
    codes = history.event_codes(pair_rows, "female")
    wide = history.wide_history(codes, "female")
    assert wide.columns == ["pop", "female", "multi_partner", "2000", "2001", "NA"]
    assert {(r.pop, r.female): tuple(r)[3:] for r in wide.collect()} == {
        ("A", "F1"): ("3", "6", "3"), ("A", "F2"): ("0", "3", "6"), (None, "F3"): ("3", "1", None)}


def test_event_codes_start_no_job_while_they_are_built(spark, pair_rows):
    group = "event-codes-plan"
    spark.sparkContext.setJobGroup(group, "")
    history.event_codes(pair_rows, "male")
    history.pair_diagnostics(pair_rows)
    pairs.drop_unorderable(pair_rows)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(group) == []
    spark.sparkContext.setJobGroup("", "")


def test_diagnostics_after_an_unknown_year(pair_rows):
    rows = {r.row_ord: r for r in history.pair_diagnostics(pair_rows).collect() if r.row_ord}
    assert len(rows) == 6 and all(r.prev_partner_known_pair for r in rows.values())
    # F1 by (previous partner, year, male): rows 3 (M1, after F2), 1 and 6 (none before)
    assert rows[3].prev_partner == "F2" and rows[3].breeding_previous_year is False
    assert rows[1].breeding_previous_year is False  # the row before has no year
    assert rows[6].breeding_previous_year is True and rows[6].same_female_partner is False
    assert rows[3].same_female_partner is None


def test_first_season_drops_incomplete_rows(spark):
    rows = [("A", None, "F1", "M1"), (None, 2000, "F1", "M1"), ("A", 2001, "F1", "M1"), ("A", 2000, "F1", None)]
    df = spark.createDataFrame(rows, "PopID string, BreedingSeason int, FemaleID string, MaleID string")
    assert [tuple(r) for r in pairs.first_season(df).collect()] == [("A", "F1", 2001)]
    both = {tuple(r) for r in pairs.first_season(df, mode="both_sexes").collect()}
    assert both == {("A", "F1", 2000), ("A", "M1", 2001)}


def test_metric_agreement_keeps_an_unknown_population(spark):
    rows = [(None, y, 0.1 * y, 0.2 * y) for y in (1, 2, 3)] + [(None, None, 0.9, 2.0), ("A", 1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "PopID string, BreedingSeason int, fledge_fem_avg double, fledge_nest_avg_adj double")
    got = {r.PopID: (r.cor, r["count"]) for r in fledge.metric_agreement(df).collect()}
    assert got == {None: (1.0, 4), "A": (None, 1)}


def test_change_puts_an_unknown_season_last(spark):
    rows = [("A", None, 9.0), ("A", 2001, 4.0), ("A", 2000, 1.0)]
    df = spark.createDataFrame(rows, "PopID string, BreedingSeason int, envStd_fledge_num double")
    got = {r.BreedingSeason: r.Ztrans_envStd_fledge_num_lag for r in fledge.standardised_change(df).collect()}
    assert got[2000] is None and got[2001] < 0 < got[None]


def test_overview_of_unknown_seasons(spark):
    brood = spark.createDataFrame([("A", 2000, "f", "m"), ("A", None, "f", "m2"), (None, 2001, "f", "m"), (None, 2003, "f", "m")],
                                  "PopID string, BreedingSeason int, FemaleID string, MaleID string")
    lookup = spark.createDataFrame([("A",), ("Z",)], "pop_code string")
    done = spark.createDataFrame([("A",)], "PopID string")
    got = {r.PopID: (r.num_pairs, r.num_years, r.done) for r in overview.population_overview(brood, lookup, done).collect()}
    assert got == {"A": (2, None, "yes"), None: (1, 3, None)}
    assert [r.pop_code for r in overview.populations_missing(lookup, done).collect()] == ["Z"]
