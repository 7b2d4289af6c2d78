"""The reference's two golden capture-history tables (population HOG, 2019-2022).

The mock input behind them is not shipped; the 16 pair rows below are one input
consistent with the goldens (inferred, see FIXTURES.md §2): one record per bird and
year, so ``order`` is constant and every pair count is 1.
"""

import pytest

from broodline.operators.history import event_codes, wide_history

# fixed values: mock pairs (year, female, male), None = unknown bird
MOCK = [
    (2019, "F1", None),
    (2020, "F1", "M1"), (2020, "F2", "M2"), (2020, "F6", "M6"), (2020, "F5", "M4"),
    (2020, "F7", "M7"), (2020, "F4", None),
    (2021, "F1", "M1"), (2021, "F2", None), (2021, "F4", None), (2021, "F7", None),
    (2021, None, "M8"), (2021, "F3", "M2"), (2021, "F5", "M6"), (2021, "F8", "M3"),
    (2022, "F1", None),
]

# fixed values: golden tables of the reference (columns 2019, 2020, 2021, 2022)
GOLDEN_FEMALES = {
    "F1": "5,3,1,5", "F2": "0,3,4,0", "F3": "0,0,3,0", "F4": "0,5,5,0",
    "F5": "0,3,2,0", "F6": "0,3,6,0", "F7": "0,3,5,0", "F8": "0,0,3,0",
}
GOLDEN_MALES = {
    "M1": "0,3,1,6", "M2": "0,3,2,0", "M3": "0,0,3,0", "M4": "0,3,6,0",
    "M6": "0,3,2,0", "M7": "0,3,6,0", "M8": "0,0,5,0",
}
YEARS = ["2019", "2020", "2021", "2022"]


def mock_pairs(spark):
    rows = [("HOG", "n", y, f, 1, m, 1, 1, "no", "no", 0, i) for i, (y, f, m) in enumerate(MOCK)]
    return spark.createDataFrame(
        rows, "pop string, nest string, year int, female string, f_pair_num bigint, "
              "male string, m_pair_num bigint, order int, no_order_f string, "
              "no_order_m string, source_rank int, row_ord bigint")


def cells(spark, focal, **kw):
    wide = wide_history(event_codes(mock_pairs(spark), focal, **kw), focal,
                        years=[2019, 2020, 2021, 2022])
    return {r[focal]: ",".join(r[y] for y in YEARS) for r in wide.collect()}


def n_equal(got, golden):
    return sum(a == b for k in golden for a, b in zip(got[k].split(","), golden[k].split(",")))


def test_female_golden_all_cells(spark):
    got = cells(spark, "female")
    assert set(got) == set(GOLDEN_FEMALES)
    assert got == GOLDEN_FEMALES


def test_male_golden_current_rule(spark):
    # the male golden predates the "previous partner paired with a known bird" clause of
    # code 6: two cells differ (M1/2022 and M7/2021 become 0)
    got = cells(spark, "male")
    assert set(got) == set(GOLDEN_MALES)
    assert n_equal(got, GOLDEN_MALES) == 26
    assert got["M1"].split(",")[3] == "0" and got["M7"].split(",")[2] == "0"


def test_male_golden_without_known_partner_clause(spark):
    got = cells(spark, "male", require_known_partner=False)
    assert got == GOLDEN_MALES


@pytest.mark.parametrize("focal", ["female", "male"])
def test_multi_partner_zero(spark, focal):
    codes = event_codes(mock_pairs(spark), focal)
    assert {r.multi_partner for r in codes.collect()} == {0}


def test_per_population_export(spark):
    import os
    import tempfile

    from broodline.operators.history import write_histories_per_population
    out = os.path.join(tempfile.mkdtemp(prefix="broodline-hist-"), "f")
    write_histories_per_population(event_codes(mock_pairs(spark), "female"), out)
    assert "pop=HOG" in os.listdir(out)
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 8 * 4 and set(back.columns) == {"female", "year", "multi_partner",
                                                             "event_code", "pop"}
