"""Capture histories: yearly pair-bond event codes of each bird.

A code tells what became of the bird whose history is built and of the mate it had before:

  0  bird not captured, and no news of its earlier mate either
  1  captured together with the mate of its record before
  2  captured together with another mate
  3  captured with a mate, and nothing known of an earlier one
  4  captured without a known mate, while the earlier mate bred elsewhere that year
  5  captured without a known mate, the earlier mate not breeding or not known
  6  not captured, while the earlier mate bred that year with a known bird

The grid has every known bird in every season observed in its population; rows are ordered
by (year, order, tie) within a bird and the code looks at the mate of the *row* before; the
first record of a year is kept after coding. An unknown year is one more year that sorts
last, an unknown population one more population.

Only a year's first record is kept, and its previous row is the last record of the
population's previous observed year (a filled year has no partner). So the operator
first reduces records to one row per (pop, focal, year) with the first and last partner
(``min_by``/``max_by``: partial aggregation, safe for hot keys), then lags over years.
The lag window therefore holds at most one row per observed year of a population
(calendar-bounded) instead of all records of a bird.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from broodline.functions.nulls import first_last_by, join_null_safe
from broodline.session import stage

ROLES = {
    "female": ("male", "f_pair_num"),
    "male": ("female", "m_pair_num"),
}


def _record_order(focal: str) -> list[str]:
    partner = ROLES[focal][0]
    # reference row order: the pair file is sorted by (pop, season, female, order) on
    # top of brood / female-capture / male-capture rows in input order
    return ["order", "source_rank", "row_ord"] if focal == "female" else \
        ["order", partner, "source_rank", "row_ord"]


def _event_code(c: Column, m: Column, p: Column, b: Column, k: Column, require_known_partner: bool) -> Column:
    """The code of a bird in a year: captured (``c``) with mate ``m``, its earlier mate ``p``, which
    bred that year (``b``), with a known bird (``k``)."""
    six = (~c & b & k) if require_known_partner else (~c & b)
    return (F.when(~c & p.isNull(), "0")
            .when(c & m.isNotNull() & p.isNotNull() & (m == p), "1")
            .when(c & m.isNotNull() & p.isNotNull() & (m != p), "2")
            .when(c & m.isNotNull() & p.isNull(), "3")
            .when(c & m.isNull() & p.isNotNull() & b, "4")
            .when(c & m.isNull() & (p.isNull() | ~b), "5")
            .when(six, "6")
            .otherwise("0"))


def _presence(P: DataFrame, focal: str, partner: str) -> DataFrame:
    """(pop, year, _p, _known): the partners of a season, and whether with a known bird."""
    return (P.where(F.col(partner).isNotNull())
            .groupBy(F.col(partner).alias("_p"), "year", "pop")
            .agg(F.max(F.col(focal).isNotNull()).alias("_known")))


def _with_presence(g: DataFrame, pres: DataFrame, focal: str) -> DataFrame:
    """``g`` with what became of the earlier mate ``_p``: ``_b`` and ``_k`` of ``_event_code``."""
    # rows without a previous partner match nothing; the second key spreads them
    g = g.withColumn("_spread", F.when(F.col("_p").isNull(), F.xxhash64(focal)).otherwise(0))
    g = join_null_safe(g, pres.withColumn("_spread", F.lit(0).cast("bigint")), ["_p", "_spread", "year", "pop"])
    known = F.col("_p").isNotNull()
    return g.withColumns({"_b": F.when(known, F.col("_known").isNotNull()),
                          "_k": F.when(known, F.coalesce("_known", F.lit(False)))})


def event_codes(pairs: DataFrame, focal: str = "female",
                require_known_partner: bool = True) -> DataFrame:
    """Long-form event codes: one row per (pop, focal bird, observed year).

    ``pairs``: final pair rows (``pop, year, female, male, f_pair_num, m_pair_num, order,
    source_rank, row_ord``). ``require_known_partner`` (default, current rule) makes code 6
    require the previous partner to be paired with a *known* bird this year.
    Output: ``pop, <focal>, year, multi_partner INT, event_code STRING``.
    """
    partner, pair_num = ROLES[focal]
    order = _record_order(focal)
    P = pairs.select("pop", "year", focal, partner, pair_num, "order", "source_rank", "row_ord")

    # observed years of each population (any row, also rows of unknown focal birds): a small
    # table, which the planner broadcasts by its size and AQE splits the join beyond that
    years = P.select("pop", "year").distinct()
    recs = P.where(F.col(focal).isNotNull())
    # the bird is the first key, which the sorts below compare first
    per_year = recs.groupBy(focal, "year", "pop").agg(
        *first_last_by(partner, order, "_first", "_last"),
        F.max(F.col(pair_num) == 2).alias("_pn2"),
        F.count(F.lit(1)).alias("_n"))
    grid = join_null_safe(recs.select("pop", focal).distinct(), years, ["pop"], "inner")
    g = join_null_safe(grid, per_year, [focal, "year", "pop"])
    w = Window.partitionBy(focal, "pop").orderBy(F.col("year").asc_nulls_last())
    wb = Window.partitionBy(focal, "pop")
    g = g.select(
        "pop", focal, "year",
        F.col("_n").isNotNull().alias("captured"),
        F.col("_first").alias("_m"),
        F.lag("_last").over(w).alias("_p"),
        F.when(F.coalesce(F.max("_pn2").over(wb), F.lit(False)), 1).otherwise(0)
         .cast("int").alias("multi_partner"))

    g = _with_presence(g, _presence(P, focal, partner), focal)
    code = _event_code(*(F.col(x) for x in ("captured", "_m", "_p", "_b", "_k")), require_known_partner)
    return g.select("pop", focal, "year", "multi_partner", code.alias("event_code"))


@dataclass(frozen=True)
class Seasons:
    """Event codes kept up to date as seasons arrive, one after the other.

    The state is what the next season needs: each known bird with its last mate in its
    population's latest season (``birds``) and the seasons seen (``years``). ``add`` reads the
    state and the new season's pair rows only; codes already made are not touched, since a
    season changes none of them. The result equals ``event_codes`` of all rows so far.

    A step writes its tables into the shared folder and returns a new state, so a step that fails
    is repeated from the state before.
    """

    focal: str
    birds: DataFrame
    years: DataFrame
    codes: tuple[DataFrame, ...] = ()
    require_known_partner: bool = True

    @staticmethod
    def none(spark: SparkSession, focal: str = "female", require_known_partner: bool = True) -> Seasons:
        return Seasons(focal, spark.createDataFrame([], f"pop string, {focal} string, _last string, _multi boolean"),
                       spark.createDataFrame([], "pop string, year int"), (), require_known_partner)

    def add(self, season: DataFrame) -> Seasons:
        """``season``: the final pair rows of one new season of some populations, complete. A season
        that does not come after those of its population is an error; an unknown one is the last."""
        focal = self.focal
        partner, pair_num = ROLES[focal]
        P = season.select("pop", "year", focal, partner, pair_num, "order", "source_rank", "row_ord")
        now = P.select("pop", "year").distinct()
        seen = self.years.withColumn("_seen", F.lit(True)).unionByName(now.withColumn("_seen", F.lit(False)))
        last = F.max(F.struct(F.col("year").isNull(), "year"))  # NULL sorts last
        wrong = seen.groupBy("pop").agg(
            F.max(F.when(F.col("_seen"), F.struct(F.col("year").isNull(), "year"))).alias("before"),
            F.min(F.when(~F.col("_seen"), F.struct(F.col("year").isNull(), "year"))).alias("first"),
            last.alias("last"), F.count_if(~F.col("_seen")).alias("n")).where("n > 1 or (n = 1 and before >= first)").first()
        if wrong:
            raise ValueError(f"population {wrong['pop']}: a step adds one season, after those before")

        per = P.where(F.col(focal).isNotNull()).groupBy("pop", focal).agg(
            *first_last_by(partner, _record_order(focal), "_m", "_now"), F.max(F.col(pair_num) == 2).alias("_pn2"))
        keys = ["pop", focal]
        known = join_null_safe(self.birds, now.select("pop"), ["pop"], "inner").withColumn("_old", F.lit(True))
        every = known.select(*keys).unionByName(per.select(*keys)).distinct()
        g = join_null_safe(every, per.withColumn("_here", F.lit(True)), keys)
        g = join_null_safe(join_null_safe(g, known, keys), now, ["pop"], "inner")
        no = F.lit(False)
        g = g.select(*keys, "year", F.coalesce("_here", no).alias("captured"), "_m", F.col("_last").alias("_p"), "_now",
                     (F.coalesce("_pn2", no) | F.coalesce("_multi", no)).alias("_multi"), F.coalesce("_old", no).alias("_old"))
        g = stage(_with_presence(g, _presence(P, focal, partner), focal))
        code = _event_code(*(F.col(x) for x in ("captured", "_m", "_p", "_b", "_k")), self.require_known_partner)
        # a bird met for the first time was not captured in the seasons before
        before = join_null_safe(g.where("not _old").select(*keys), self.years, ["pop"], "inner")
        codes = stage(g.select(*keys, "year", code.alias("event_code")).unionByName(
            before.select(*keys, "year", F.lit("0").alias("event_code"))))
        # birds of populations without this season stay as they are
        others = self.birds.join(now.select(F.col("pop").alias("_pop")), F.col("pop").eqNullSafe(F.col("_pop")), "left_anti")
        birds = others.unionByName(g.select(*keys, F.when(F.col("captured"), F.col("_now")).alias("_last"), "_multi"))
        return replace(self, birds=stage(birds), years=stage(self.years.unionByName(now)), codes=(*self.codes, codes))

    def event_codes(self) -> DataFrame:
        """All codes so far, in the form of ``event_codes``."""
        if not self.codes:
            return self.birds.select("pop", self.focal, F.lit(0).alias("year"), F.lit(0).alias("multi_partner"), F.lit("").alias("event_code"))
        rows = reduce(DataFrame.unionByName, self.codes)
        multi = self.birds.select("pop", self.focal, F.col("_multi").cast("int").alias("multi_partner"))
        return join_null_safe(rows, multi, ["pop", self.focal], "inner").select("pop", self.focal, "year", "multi_partner", "event_code")


def follow_seasons(stream: DataFrame, state: Seasons, publish: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs ``Seasons.add`` on a stream of pair rows, each micro-batch one season, and gives the
    codes so far to ``publish(codes, number of the season)``. The state lives in the application;
    a new one rebuilds it from the stream's start."""
    now = state

    def one(batch: DataFrame, number: int) -> None:
        nonlocal now
        if not batch.isEmpty():
            now = now.add(stage(batch))
            publish(now.event_codes(), number)

    return stream.writeStream.foreachBatch(one).start()


NO_YEAR = "NA"  # column of an unknown year


def observed_years(df: DataFrame) -> list[int | None]:
    """Distinct ``year`` values in order, an unknown year last (calendar-bounded, a few
    hundred at most), for pivot columns. Event codes cover exactly the observed years of
    the pair rows they were built from, so passing those pair rows avoids evaluating the
    codes twice."""
    years = [r[0] for r in df.select("year").distinct().collect()]
    return sorted((y for y in years if y is not None)) + [None] * (None in years)


def wide_history(codes: DataFrame, focal: str = "female",
                 years: list[int | None] | None = None) -> DataFrame:
    """One row per (pop, focal, multi_partner), one column per year (``"1995"``, ..., and
    ``"NA"`` for an unknown year).

    A year not observed in a population is NULL in that population's rows; every observed
    year of a population is filled. Pass ``years`` to skip the distinct-years job.
    """
    years = years if years is not None else observed_years(codes)
    named = codes.withColumn("_year", F.coalesce(F.col("year").cast("string"), F.lit(NO_YEAR)))
    names = [NO_YEAR if y is None else str(y) for y in years]
    return (named.groupBy(focal, "pop", "multi_partner").pivot("_year", names).agg(F.max("event_code"))
            .select("pop", focal, "multi_partner", *(F.col(f"`{n}`") for n in names)))


def write_histories_per_population(codes: DataFrame, path: str) -> None:
    """One folder per population (``pop=<code>``) from one distributed write (no
    repartition on ``pop``: a large population would land in one task)."""
    from broodline.sources.rcsv import write_csv_r
    write_csv_r(codes, path, partition_by="pop")


BIRDS_IN_FILE = 200_000


def write_wide_per_population(codes: DataFrame, focal: str, path: str, birds_in_file: int = BIRDS_IN_FILE) -> None:
    """Wide histories as CSV, one folder per population, each with the columns of that
    population's own years: ``population=<code>/part=<k>/`` holds one file with header.

    One job, however many different sets of years there are: a bird's codes become one line,
    and each file's header is a row that sorts before its lines. A population is dealt into
    parts of about ``birds_in_file`` birds, so a large one is written by many tasks. Files are
    committed by Spark's own writer, so an attempt that is run again leaves no second copy.
    ``broodline.sources.rcsv.read_csv_each`` reads them.
    """
    from broodline.functions.skew import join_by_share
    from broodline.sources.rcsv import csv_line
    year = F.coalesce(F.col("year").cast("string"), F.lit(NO_YEAR))
    # a bird has a code for each year of its population, so its codes are in the header's order
    at = F.struct(F.col("year").isNull().alias("_null"), F.col("year").alias("_year"), "event_code")
    known = codes.withColumn("_pop", F.coalesce(F.concat(F.lit("p"), "pop"), F.lit("unknown")))
    birds = stage(known.groupBy(focal, "_pop", "pop", "multi_partner").agg(F.sort_array(F.collect_list(at)).alias("_codes")))
    years = known.groupBy("_pop", "pop", "year").agg(F.lit(1)).groupBy("_pop", "pop").agg(F.transform(F.sort_array(
        F.collect_list(F.struct(F.col("year").isNull().alias("_null"), "year", year.alias("_name")))), lambda y: y["_name"]).alias("_years"))
    sizes = birds.groupBy("_pop").agg(F.count(F.lit(1)).alias("_n"))
    pops = stage(years.join(sizes, "_pop").withColumn("_parts", F.ceil(F.col("_n") / birds_in_file).cast("int")))
    total = pops.agg(F.sum("_n")).first()[0] or 0
    parts = pops.select("_pop", "_n", "_parts")
    names = F.concat(F.array(F.lit("pop"), F.lit(focal), F.lit("multi_partner")), F.col("_years"))
    header = pops.select("pop", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), F.lit(0).alias("_at"), csv_line(names).alias("value"))
    fields = F.concat(F.array("pop", focal, F.col("multi_partner").cast("string")), F.transform("_codes", lambda c: c["event_code"]))
    lines = join_by_share(birds, parts, "_pop", "_n", total).select(
        "pop", F.pmod(F.xxhash64(focal), F.col("_parts")).cast("int").alias("part"), F.lit(1).alias("_at"), csv_line(fields).alias("value"))
    (header.unionByName(lines).withColumnRenamed("pop", "population").repartition("population", "part")
     .sortWithinPartitions("population", "part", "_at", "value").select("value", "population", "part")
     .write.mode("overwrite").partitionBy("population", "part").text(path))


def pair_diagnostics(pairs: DataFrame) -> DataFrame:
    """Diagnostic columns of the reference's male test variant, per row of the male grid
    (every known male x every observed year of its population; filled rows have
    ``female`` and ``row_ord`` NULL). Rows are ordered by (year, input order); no clutch
    order and no keep-first, as in that variant.

    ``prev_partner``: female of the male's previous grid row.
    ``prev_partner_known_pair``: the row's male is known (always TRUE here).
    ``breeding_previous_year``: for a known female, whether her row before in the order
    (prev_partner, year, male; NULL last, then input order) has a known year; FALSE on her
    first row. Rows are reduced to one per (female, previous partner), whose first row and
    first row without a year decide that.
    ``same_female_partner``: within (pop, female, year) in that order, whether the male
    equals the previous row's male (NULL when either is unknown or on the first row).
    Cross-year lags run on one row per (pop, male, year); within-year windows hold the
    records of one known bird in one season.
    """
    P = pairs.select("pop", "year", "female", "male", "row_ord")
    years = P.select("pop", "year").distinct()
    recs = P.where(F.col("male").isNotNull())
    per_year = recs.groupBy("pop", "male", "year").agg(
        F.max_by("female", "row_ord").alias("_last_f"), F.count(F.lit(1)).alias("_n"))
    grid = join_null_safe(join_null_safe(recs.select("pop", "male").distinct(), years, ["pop"], "inner"),
                          per_year, ["pop", "male", "year"])
    grid = grid.withColumn("_prev_year", F.lag("_last_f").over(
        Window.partitionBy("pop", "male").orderBy(F.col("year").asc_nulls_last())))
    wy = Window.partitionBy("pop", "male", "year").orderBy("row_ord")
    real = join_null_safe(recs, grid.select("pop", "male", "year", "_prev_year"), ["pop", "male", "year"], "inner") \
        .withColumn("prev_partner", F.when(F.row_number().over(wy) == 1, F.col("_prev_year"))
                    .otherwise(F.lag("female").over(wy))).drop("_prev_year")
    filled = grid.where(F.col("_n").isNull()).select(
        "pop", "year", F.lit(None).cast("string").alias("female"), "male",
        F.lit(None).cast("bigint").alias("row_ord"), F.col("_prev_year").alias("prev_partner"))
    cols = ["pop", "year", "female", "male", "row_ord", "prev_partner"]

    # what depends on the female is NULL for an unknown one: only rows of known females, of
    # which a season has a bounded number, go through her joins and windows
    known = real.where(F.col("female").isNotNull()).select(*cols)
    order = F.struct(F.col("year").isNull(), "year", "male", "row_ord")
    groups = known.groupBy("pop", "female", "prev_partner").agg(
        F.min_by("row_ord", order).alias("_first"),
        F.min_by("row_ord", F.when(F.col("year").isNull(), order)).alias("_first_no_year"))
    before = F.lag(F.col("_first_no_year").isNotNull(), 1, True).over(
        Window.partitionBy("pop", "female").orderBy(F.col("prev_partner").asc_nulls_last()))
    groups = groups.withColumn("_after_no_year", before)
    wf = Window.partitionBy("pop", "female", "year").orderBy(
        *[F.col(c).asc_nulls_last() for c in ("prev_partner", "male", "row_ord")])
    lm = F.lag("male").over(wf)
    known = join_null_safe(known, groups, ["pop", "female", "prev_partner"]).withColumns({
        "breeding_previous_year": ~((F.col("_after_no_year") & (F.col("row_ord") == F.col("_first")))
                                    | (F.col("year").isNull() & (F.col("row_ord") != F.col("_first_no_year")))),
        "same_female_partner": F.when(F.row_number().over(wf) > 1, F.col("male") == lm)})
    rest = real.where(F.col("female").isNull()).select(*cols).unionByName(filled)
    return known.unionByName(rest, allowMissingColumns=True).select(
        *cols, F.lit(True).alias("prev_partner_known_pair"), "breeding_previous_year", "same_female_partner")
