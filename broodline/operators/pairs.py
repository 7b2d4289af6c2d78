"""Pair table: cleaned, de-duplicated male/female pairs per population-season.

Operators follow the reference step by step; every order-sensitive step takes
``row_ord`` (input order) explicitly. Every per-group quantity that the reference
broadcasts to rows with a grouped ``mutate`` is computed here as a ``groupBy``
aggregate (partial aggregation map-side, so a hot key such as "unknown female"
is reduced before the shuffle) and joined back to the rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from broodline.functions.clean import (
    FEMALE_UNKNOWN_PAIRING, MALE_UNKNOWN_PAIRING, SPECIES, clutch_order, date_observed_columns,
    experiment_flag, recode_experiment,
)
from broodline.session import stage as stage_parquet
from broodline.functions.nulls import (
    count_true, join_null_safe, keep_first, left_plus_missing, n_distinct_na, sole_value,
)

#: Keys name the bird first: the sorts of joins and aggregations compare the first key's leading bytes,
#: which tell most birds apart, where a population's or a season's are shared by many rows.
PAIR_KEYS = ["FemaleID", "MaleID", "BreedingSeason", "PopID"]


def _species_with_bird(brood: DataFrame, species: str) -> DataFrame:
    f, m = F.col("FemaleID"), F.col("MaleID")
    return brood.where((F.col("Species") == species) & (f.isNotNull() | m.isNotNull()))


def partner_multiplicity(brood: DataFrame, species: str = SPECIES) -> DataFrame:
    """Per (PopID, FemaleID, BreedingSeason) with a known female: number of male partners
    counting an unknown male as one (``num_partners``) and ignoring it
    (``num_partners_known``). Raw IDs, no cleaning."""
    b = _species_with_bird(brood, species).where(F.col("FemaleID").isNotNull())
    return b.groupBy("PopID", "FemaleID", "BreedingSeason").agg(
        n_distinct_na("MaleID").alias("num_partners"),
        F.count_distinct("MaleID").alias("num_partners_known"))


def partner_crosstab(multiplicity: DataFrame) -> DataFrame:
    """``table(PopID, num_partners)`` in long form (non-empty cells)."""
    return multiplicity.groupBy("PopID", "num_partners").agg(F.count(F.lit(1)).alias("n"))


def pairing_brood(brood: DataFrame, species: str = SPECIES) -> DataFrame:
    """Focal-species nests with at least one bird known, cleaned for pairing.

    Experiment placeholders (incl. ``""``/``UNKNOWN``) and controls -> ``Brood_exp`` FALSE.
    ``1000000`` female / ``1000000``,``UNKNOWN`` male -> NULL, *then* upper-case; this
    runs after the known-bird filter, so rows with both birds unknown can remain.
    """
    f, m = F.col("FemaleID"), F.col("MaleID")
    b = _species_with_bird(brood, species)
    return b.select(
        "row_ord", "PopID", "BreedingSeason", "LocationID",
        F.upper(F.when(~f.isin(list(FEMALE_UNKNOWN_PAIRING)), f)).alias("FemaleID"),
        F.upper(F.when(~m.isin(list(MALE_UNKNOWN_PAIRING)), m)).alias("MaleID"),
        experiment_flag("ExperimentID", blanks_are_none=True).alias("Brood_exp"),
        *date_observed_columns(brood), "ClutchType_calculated")


def clean_pairs(ref: DataFrame, stage=None) -> DataFrame:
    """Distinct pairs (first row per (PopID, season, female, male) in input order) with
    per-season partner counts and the sole known partner of each bird.

    ``Num_male_partners`` = distinct known males of the female that season (NULL when
    the female is unknown); ``MaleID_known`` = that male if exactly one;
    ``MaleID_recode`` = own male when there are exactly 2 partners, else the sole one.
    Mirror columns for males. Counting on the de-duplicated rows gives the same
    distinct counts as on all rows, with fewer rows shuffled. ``stage`` (e.g. Parquet in the
    shared checkpoint folder) is applied to the de-duplicated rows, which are read three
    times.
    """
    d = keep_first(ref, PAIR_KEYS, ["row_ord"])
    d = stage(d) if stage else d
    fk = ["FemaleID", "BreedingSeason", "PopID"]
    mk = ["MaleID", "BreedingSeason", "PopID"]
    # d is unique per (pop, season, female, male): within a (pop, female, season) group
    # the non-null males are already distinct, so a plain count is the distinct count
    # (no distinct-aggregate expansion, one shuffle less per side)
    fem = d.groupBy(*fk).agg(F.count("MaleID").alias("_nm"),
                             sole_value("MaleID").alias("MaleID_known"))
    mal = d.groupBy(*mk).agg(F.count("FemaleID").alias("_nf"),
                             sole_value("FemaleID").alias("FemaleID_known"))
    out = join_null_safe(join_null_safe(d, fem, fk), mal, mk)
    nm = F.when(F.col("FemaleID").isNotNull(), F.col("_nm"))
    nf = F.when(F.col("MaleID").isNotNull(), F.col("_nf"))
    out = out.withColumns({"Num_male_partners": nm, "Num_female_partners": nf})
    out = out.withColumns({
        "MaleID_recode": F.when(F.col("Num_male_partners") == 2, F.col("MaleID"))
                          .otherwise(F.col("MaleID_known")),
        "FemaleID_recode": F.when(F.col("Num_female_partners") == 2, F.col("FemaleID"))
                            .otherwise(F.col("FemaleID_known")),
    })
    return out.drop("_nm", "_nf")


def ordered_multi_partner(pairs: DataFrame) -> DataFrame:
    """Pairs of males with exactly two female partners that season, in
    (PopID, MaleID, season, clutch type) order."""
    return (pairs.where(F.col("Num_female_partners") == 2)
            .orderBy(F.col("PopID").asc_nulls_last(), F.col("MaleID").asc_nulls_last(),
                     F.col("BreedingSeason").asc_nulls_last(),
                     F.col("ClutchType_calculated").asc_nulls_last(), "row_ord"))


def first_season(pairs: DataFrame, ref: DataFrame | None = None,
                 mode: str = "literal") -> DataFrame:
    """First breeding season per (PopID, IndvID).

    ``literal`` (default, reference parity): the reference's grouped ``select`` drags the
    male column along, so its ``na.omit`` keeps only females, and only their rows with a
    known male. ``both_sexes``: the evident intent, every known female and male. Rows with
    an unknown season or population are dropped in both.
    """
    if mode == "literal":
        src = (pairs.select("PopID", "BreedingSeason", F.col("FemaleID").alias("IndvID"), "MaleID")
               .na.drop("any"))
    elif mode == "both_sexes":
        ref = pairs if ref is None else ref
        # each side reduced on its own: the optimizer then leaves out the joins of ``pairs``
        sides = [rows.select("PopID", "BreedingSeason", F.col(c).alias("IndvID")).na.drop("any")
                 .groupBy("PopID", "IndvID").agg(F.min("BreedingSeason").alias("BreedingSeason"))
                 for rows, c in ((pairs, "FemaleID"), (ref, "MaleID"))]
        src = sides[0].unionByName(sides[1])
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return src.groupBy("PopID", "IndvID").agg(F.min("BreedingSeason").alias("breed_year"))


def capture_enrichment(capture: DataFrame, first: DataFrame, species: str = SPECIES) -> DataFrame:
    """Capture rows of breeding individuals from their first breeding season on.

    One row per (PopID, IndvID, season): the first capture in input order (so its sex
    decides the later sex filter); ``Cap_exp`` = any non-placeholder experiment among the
    individual's retained captures; ``years`` = distinct retained seasons.
    The semi-join + left join + ``season >= breed_year`` filter of the reference is one
    inner join here (``first`` has one row per key). Windows below run on the
    season-reduced rows, so a partition holds at most one row per season.
    """
    cap = capture.where(F.col("Species") == species).select(
        "row_ord", F.col("CapturePopID").alias("PopID"), "BreedingSeason", "IndvID",
        "Sex_observed", recode_experiment("ExperimentID").alias("ExperimentID"), "CaptureDate")
    j = cap.join(first, ["IndvID", "PopID"]).where(F.col("BreedingSeason") >= F.col("breed_year"))
    per_season = j.groupBy("IndvID", "BreedingSeason", "PopID").agg(
        F.min_by(F.struct("row_ord", "Sex_observed", "CaptureDate"), F.col("row_ord")).alias("_f"),
        F.max(F.col("ExperimentID").isNotNull()).alias("_exp"))
    w = Window.partitionBy("IndvID", "PopID")
    return per_season.select(
        "PopID", "BreedingSeason", "IndvID",
        F.col("_f.Sex_observed").alias("Sex_observed"), F.col("_f.CaptureDate").alias("CaptureDate"),
        F.max("_exp").over(w).alias("Cap_exp"),
        F.count(F.lit(1)).over(w).alias("years"),
        F.lit("yes").alias("capture"),
        F.col("_f.row_ord").alias("row_ord"))


def build_pairs(pairs: DataFrame, captures: DataFrame, labels: bool = False, stage=None) -> DataFrame:
    """Pairs enriched with capture-only records, experiment flags propagated.

    Two full joins on (PopID, season, female|male) add captures of females, then of males;
    capture-only rows get ``brood`` NULL. Missing flags are FALSE; an experimental nest
    flags both birds; then both ``Female_exp`` *and* ``Male_exp`` are OR-ed over
    (PopID, FemaleID) (reference behaviour: NULL female is one group per population).
    ``source_rank`` (0 brood, 1 female capture, 2 male capture) + ``row_ord`` carry the
    reference's row order for later tie-breaks. ``labels`` adds ``extra_f`` / ``extra_m``:
    whether any record of the female / male in the population came from captures only.
    ``stage`` is applied to the captures, of which each sex is read twice, and to the joined
    rows, which the flags are read from and joined back to.
    """
    stage = stage or (lambda d: d)
    captures = stage(captures)
    dates = [c for c in date_observed_columns(pairs)]
    bp = pairs.select(
        "PopID", "BreedingSeason", "LocationID", "ClutchType_calculated", *dates, "Brood_exp",
        "FemaleID", "MaleID", "Num_male_partners", "Num_female_partners", "row_ord",
    ).withColumns({"brood": F.lit("yes"), "source_rank": F.lit(0)})

    def side(sex, id_col, date_col, rec_col, exp_col, ord_col):
        return captures.where(F.col("Sex_observed") == sex).select(
            "PopID", "BreedingSeason", F.col("IndvID").alias(id_col),
            F.col("CaptureDate").alias(date_col), F.col("capture").alias(rec_col),
            F.col("Cap_exp").alias(exp_col), F.col("row_ord").alias(ord_col))

    fc = side("F", "FemaleID", "Female_cap_dat", "Record_f", "Female_exp", "_f_ord")
    fk, mk = ["FemaleID", "BreedingSeason", "PopID"], ["MaleID", "BreedingSeason", "PopID"]
    j = left_plus_missing(bp, fc, fk, fk)
    j = j.withColumns({"source_rank": F.coalesce("source_rank", F.lit(1)),
                       "row_ord": F.coalesce("row_ord", "_f_ord")}).drop("_f_ord")
    mc = side("M", "MaleID", "Male_cap_dat", "Record_m", "Male_exp", "_m_ord")
    # the females' captures have no male, so the known males are those of the clean pairs
    j = left_plus_missing(j, mc, mk, mk, present=bp)
    j = j.withColumns({"source_rank": F.coalesce("source_rank", F.lit(2)),
                       "row_ord": F.coalesce("row_ord", "_m_ord")}).drop("_m_ord")
    be = F.coalesce("Brood_exp", F.lit(False))
    j = stage(j.withColumns({
        "Brood_exp": be,
        "Female_exp": be | F.coalesce("Female_exp", F.lit(False)),
        "Male_exp": be | F.coalesce("Male_exp", F.lit(False)),
    }))
    # groups without any flag are left out: what matches none is FALSE
    only = F.max(F.col("brood").isNull())
    fk, mk = ["FemaleID", "PopID"], ["MaleID", "PopID"]
    found = {"Female_exp": F.max("Female_exp"), "Male_exp": F.max("Male_exp")} | ({"extra_f": only} if labels else {})
    flags = j.groupBy(*fk).agg(*(c.alias(f"_any_{n}") for n, c in found.items()))
    flags = flags.where(reduce(or_, (F.col(f"_any_{n}") for n in found)))
    j = join_null_safe(j, flags, fk).withColumns({n: F.coalesce(f"_any_{n}", F.lit(False)) for n in found})
    if labels:
        extra_m = j.groupBy(*mk).agg(only.alias("extra_m")).where("extra_m")
        j = join_null_safe(j, extra_m, mk).withColumn("extra_m", F.coalesce("extra_m", F.lit(False)))
    extra = ["extra_f", "extra_m"] if labels else []
    return j.select(
        "PopID", "BreedingSeason", "LocationID", "ClutchType_calculated", *dates, "Brood_exp",
        "brood", "FemaleID", "Female_cap_dat", "Record_f", "Num_male_partners", "Female_exp",
        "MaleID", "Male_cap_dat", "Record_m", "Num_female_partners", "Male_exp",
        *extra, F.col("source_rank").cast("int").alias("source_rank"), "row_ord")


def pair_order(pairs: DataFrame) -> DataFrame:
    """``order`` of the clutch and whether a bird's two partners cannot be ordered.

    ``no_order_f`` = "yes" when all rows of (PopID, season, female) share one order value
    (NULL counts as a value) and the female had exactly 2 partners; NULL when the order
    test holds but the partner count is unknown; else "no". Mirror for males.
    """
    p = pairs.withColumn("order", clutch_order("ClutchType_calculated"))
    k0 = F.coalesce(F.col("order"), F.lit(0))
    several = (F.min(k0) != F.max(k0))  # such groups are fewer than those of one value
    fk = ["FemaleID", "BreedingSeason", "PopID"]
    mk = ["MaleID", "BreedingSeason", "PopID"]
    p, rows = join_null_safe(p, p.groupBy(*fk).agg(several.alias("_more_f")).where("_more_f"), fk), p
    p = join_null_safe(p, rows.groupBy(*mk).agg(several.alias("_more_m")).where("_more_m"), mk)
    cf = F.col("_more_f").isNull() & (F.col("Num_male_partners") == 2)
    cm = F.col("_more_m").isNull() & (F.col("Num_female_partners") == 2)
    return p.withColumns({
        "no_order_f": F.when(cf, "yes").when(~cf, "no"),
        "no_order_m": F.when(cm, "yes").when(~cm, "no"),
    }).drop("_more_f", "_more_m")


def experiment_summary(pairs: DataFrame) -> DataFrame:
    """Per population: distinct experimental females/males and experimental rows."""
    return pairs.groupBy("PopID").agg(
        F.count_distinct(F.when(F.col("Female_exp"), F.col("FemaleID"))).alias("Females_exp"),
        count_true("Female_exp").alias("Females_exp_y"),
        F.count_distinct(F.when(F.col("Male_exp"), F.col("MaleID"))).alias("Males_exp"),
        count_true("Male_exp").alias("Males_exp_y"),
        count_true("Brood_exp").alias("Brood_exp"))


def final_pairs(pairs: DataFrame, keep_tie: bool = True) -> DataFrame:
    """Non-experimental pairs in the 10-column pair-table layout.

    ``keep_tie`` adds ``source_rank``/``row_ord`` (the reference's row order), which the
    event-code operator needs to break ties between records of one bird and season.
    """
    cols = [F.col("PopID").alias("pop"), F.col("LocationID").alias("nest"),
            F.col("BreedingSeason").alias("year"), F.col("FemaleID").alias("female"),
            F.col("Num_male_partners").alias("f_pair_num"), F.col("MaleID").alias("male"),
            F.col("Num_female_partners").alias("m_pair_num"), "order", "no_order_f", "no_order_m"]
    if keep_tie:
        cols += ["source_rank", "row_ord"]
    return pairs.where(~F.col("Brood_exp") & ~F.col("Female_exp") & ~F.col("Male_exp")).select(*cols)


def drop_unorderable(pairs: DataFrame, focal: str = "male") -> DataFrame:
    """Remove every record of birds (any population) with a "yes" unorderable flag.

    Anti-join on the ID only; rows with an unknown focal bird are kept, and go round the
    join (their NULL key would meet in one partition). The flagged birds are grouped by
    (bird, flag), so the join deals them anew by bird: AQE splits a hot bird only where an
    exchange stands directly below the join.
    """
    flag = {"male": "no_order_m", "female": "no_order_f"}[focal]
    bad = pairs.where((F.col(flag) == "yes") & F.col(focal).isNotNull()).groupBy(focal, flag).count().select(focal)
    return pairs.where(F.col(focal).isNotNull()).join(bad, on=focal, how="left_anti") \
        .select(pairs.columns).unionByName(pairs.where(F.col(focal).isNull()))


def pairs_table(brood: DataFrame, capture: DataFrame, mode: str = "literal",
                species: str = SPECIES, stage=stage_parquet, labels: bool = False) -> DataFrame:
    """Brood + capture tables -> ordered pair rows with all flags (before the filter).

    ``stage`` (default: Parquet in the shared checkpoint folder) is applied to the distinct
    pairs, the captures and the joined pairs, each computed once: the steps after read them
    several times (aggregate + join back), so cutting there keeps plans small, lets each
    reader scan only its columns, and lets a lost executor recompute from the stage instead
    of the raw scan. Pass ``stage=None`` for a single lazy plan.
    """
    cp = clean_pairs(pairing_brood(brood, species), stage)
    # the distinct pairs have every male and season of the nests
    caps = capture_enrichment(capture, first_season(cp, mode=mode), species)
    return pair_order(build_pairs(cp, caps, labels, stage))
