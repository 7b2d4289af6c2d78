"""End-to-end product job: every product written once, contents equal the queries."""

import csv
import glob
import os
import tempfile

import pytest

from broodline.plans import queries as Q
from broodline.plans.products import main, read_input, write_products
from broodline.sources.adapters import brood_view, capture_view
from broodline.sources.rcsv import read_csv_each, read_csv_r, write_csv_r
from broodline.sources.schemas import BROOD_SCHEMA, PAIRS_SCHEMA

from .conftest import SF_SMALL


def test_write_products(spark):
    out = tempfile.mkdtemp(prefix="broodline-products-")
    paths = write_products(brood_view(spark, SF_SMALL), capture_view(spark, SF_SMALL), out)
    assert set(paths) == {"pop_pairs", "pop_pairs_ordered", "event_codes_female_long", "event_codes_female",
                          "event_codes_male_long", "event_codes_male", "breeding_records",
                          "repair_rate", "capture_records", "fledge_counts_std",
                          "fledge_metrics_long", "population_overview", "populations_missing"}
    schema = PAIRS_SCHEMA
    fields = [f for f in schema.fields if f.name not in ("source_rank", "row_ord")]
    from pyspark.sql import types as T
    back = read_csv_r(spark, paths["pop_pairs"], T.StructType(fields), "readr")
    exp = Q.q_final_pairs(spark, SF_SMALL)
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(map(key, back.collect())) == sorted(map(key, exp.collect()))
    pops = sorted(p for p in os.listdir(paths["event_codes_female_long"]) if p.startswith("pop="))
    assert pops and len(pops) == exp.select("pop").distinct().count()
    wide = read_csv_each(spark, paths["event_codes_female"], "readr")
    assert wide.count() == Q.q_wide_history_female(spark, SF_SMALL).count()


def _table(folder):
    """Header and rows of each CSV file of a folder."""
    out = []
    for f in sorted(glob.glob(f"{folder}/**/part-*", recursive=True)):
        if os.path.isdir(f):
            continue
        with open(f, newline="") as fh:
            out.append(list(csv.reader(fh)))
    return out


def test_histories_from_the_pair_file(spark, tmp_path):
    """The golden cases, as two populations of different years, from the pair file alone."""
    rows = [(pop, "n", y0 + y, f, 1, m, 1, 1, "no", "no", 0, k) for pop, y0 in (("A", 2000), ("B", 2010))
            for k, (y, f, m) in enumerate([(0, "F1", "M1"), (1, "F1", "M1"), (2, "F1", "M2"), (0, "F2", None), (1, "F3", "M3")])]
    rows += [("B", "n", 2013, "F9", 1, 'M "9", x', 1, 1, "no", "no", 0, 99)]
    path = str(tmp_path / "pairs.csv")
    write_csv_r(spark.createDataFrame(rows, PAIRS_SCHEMA), path)
    for name, order in (("a", []), ("b", ["--order-by", "pop", "row_ord"])):
        main(["--pairs", path, "--out", str(tmp_path / name), *order])
        tables = _table(tmp_path / name / "event_codes_female")
        headers = {tuple(t[0]) for t in tables}
        assert headers == {("pop", "female", "multi_partner", "2000", "2001", "2002"),
                           ("pop", "female", "multi_partner", "2010", "2011", "2012", "2013")}
        got = {tuple(r[:2]): r[3:] for t in tables for r in t[1:]}
        assert got == {("A", "F1"): ["3", "1", "2"], ("A", "F2"): ["5", "0", "0"], ("A", "F3"): ["0", "3", "0"],
                       ("B", "F1"): ["3", "1", "2", "0"], ("B", "F2"): ["5", "0", "0", "0"],
                       ("B", "F3"): ["0", "3", "0", "0"], ("B", "F9"): ["0", "0", "0", "3"]}


def test_inputs_name_their_order(spark, tmp_path):
    df = brood_view(spark, SF_SMALL)
    write_csv_r(df.drop("row_ord"), str(tmp_path / "b.csv"))
    with pytest.raises(ValueError, match="--order-by"):
        read_input(spark, str(tmp_path / "b.csv"), BROOD_SCHEMA)
    back = read_input(spark, str(tmp_path / "b.csv"), BROOD_SCHEMA, order_by=["LayDate_observed", "FemaleID", "MaleID", "LocationID"])
    assert back.count() == df.count() and sorted(r.row_ord for r in back.collect()) == list(range(1, df.count() + 1))
