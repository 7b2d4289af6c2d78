"""Event codes season after season equal the codes of all rows so far."""

import random

import pytest
from pyspark.sql import functions as F

from broodline.operators import history

COLUMNS = "pop string, year int, female string, male string, f_pair_num long, m_pair_num long, order int, source_rank int, row_ord long"


def pair_rows(seed, seasons):
    """Birds known and unknown, several records a season, a population that skips seasons and an
    unknown population."""
    r = random.Random(seed)
    out = []
    for year in seasons:
        for pop in ("A", "B", None):
            if pop == "B" and r.random() < 0.4:
                continue
            for _ in range(12):
                f, m = r.choice([None, *[f"F{i}" for i in range(8)]]), r.choice([None, *[f"M{i}" for i in range(6)]])
                out.append((pop, year, f, m, r.choice([None, 1, 2]), r.choice([None, 1, 2]), r.choice([None, 1, 2]), r.randint(0, 2), len(out)))
    return out


@pytest.mark.parametrize("focal,known", [("female", True), ("male", False)])
def test_each_step_equals_the_batch(spark, focal, known):
    seasons = [2000, 2001, 2003, None]
    rows = pair_rows(len(focal), seasons)
    df = spark.createDataFrame(rows, COLUMNS)
    state = history.Seasons.none(spark, focal, known)
    assert state.event_codes().count() == 0
    for k, year in enumerate(seasons):
        state = state.add(df.where(F.col("year").eqNullSafe(F.lit(year))))
        so_far = spark.createDataFrame([x for x in rows if x[1] in seasons[: k + 1]], COLUMNS)
        want = history.event_codes(so_far, focal, known)
        got = state.event_codes()
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_seasons_come_in_order(spark):
    df = spark.createDataFrame(pair_rows(3, [2000, 2001]), COLUMNS)
    one = history.Seasons.none(spark).add(df.where("year = 2001"))
    for wrong in (df.where("year = 2000"), df.where("year = 2001")):
        with pytest.raises(ValueError, match="one season"):
            one.add(wrong)
    with pytest.raises(ValueError, match="one season"):
        history.Seasons.none(spark).add(df)


def test_a_stream_of_seasons(spark, tmp_path):
    rows = pair_rows(9, [2000, 2001, 2002])
    df = spark.createDataFrame(rows, COLUMNS)
    source, seen = str(tmp_path / "in"), {}
    for year in (2000, 2001, 2002):
        df.where(F.col("year") == year).coalesce(1).write.mode("append").parquet(source)
        query = None
        if year == 2002:
            stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
            query = history.follow_seasons(stream, history.Seasons.none(spark), lambda codes, n: seen.update({n: sorted(map(str, codes.collect()))}))
            query.processAllAvailable()
            query.stop()
    assert sorted(seen) == [0, 1, 2]
    assert seen[2] == sorted(map(str, history.event_codes(df, "female").collect()))
