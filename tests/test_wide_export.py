"""The wide histories of all populations in one job, each with its own columns."""

import glob
import os

from broodline.operators import history
from broodline.sources.rcsv import read_csv_each

CODES = "pop string, female string, year int, multi_partner int, event_code string"


def rows():
    out = []
    for pop, years, birds in (("A", (2000, 2001), 40), ("B", (1999, None), 3), (None, (2005,), 2), ('C "x", y', (2000, 2001, 2002), 1)):
        for b in range(birds):
            out += [(pop, f"f,{b}\n" if b == 2 else f"f{b}", y, b % 2, str((b + (y or 0)) % 7)) for y in years]
    return out


def test_each_population_has_its_own_years(spark, tmp_path):
    path = str(tmp_path / "wide")
    history.write_wide_per_population(spark.createDataFrame(rows(), CODES).repartition(5), "female", path, birds_in_file=7)
    back = read_csv_each(spark, path, "readr").collect()
    got = {(r.fields["pop"], r.fields["female"], None if y == "NA" else int(y), int(r.fields["multi_partner"]), c)
           for r in back for y, c in r.fields.items() if y not in ("pop", "female", "multi_partner")}
    assert got == set(rows())
    files = glob.glob(f"{path}/population=A/part=*/part-*")
    assert 1 < len(files) <= 6  # a large population is written in parts
    for f in files:
        with open(f) as fh:
            assert fh.readline() == "pop,female,multi_partner,2000,2001\n"
    assert os.path.exists(f"{path}/_SUCCESS")


def test_one_job_and_no_second_copy(spark, tmp_path):
    """The number of jobs does not depend on the number of different sets of years, and writing
    again replaces what was there."""
    path, sc = str(tmp_path / "wide"), spark.sparkContext
    jobs = []
    for n in (2, 12):
        table = [(f"P{p}", f"f{b}", 2000 + y, 0, "1") for p in range(n) for b in range(3) for y in range(p + 1)]
        df = spark.createDataFrame(table, CODES)
        sc.setJobGroup(f"wide-{n}", "histories")
        history.write_wide_per_population(df, "female", path)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"wide-{n}")))
        assert read_csv_each(spark, path).count() == 3 * n
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_no_codes_give_no_files(spark, tmp_path):
    path = str(tmp_path / "wide")
    history.write_wide_per_population(spark.createDataFrame([], CODES), "female", path)
    assert not glob.glob(f"{path}/population=*")
