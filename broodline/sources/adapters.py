"""Adapter views: the driver's star-schema tables in the brood / capture schemas.

The mapping (documented in FIXTURES.md §3) is arbitrary and exists to reach every
branch of the operators with data whose volume grows with the scale factor. Each view
is a DataFrame plan over the parquet tables, so column pruning and filter pushdown
reach the scans. ``BROOD_VIEW_SQL`` / ``CAPTURE_VIEW_SQL`` are the same mapping as
portable SQL, used by the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broodline.sources.tables import read_table


def brood_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per nest attempt (order), ``row_ord`` = order key (file order). Every order is
    a nest: one without line items has no fledging count. Some nests have no population or
    no season."""
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    # per-order quantity: aggregated map-side before the shuffle on l_orderkey
    q = (read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
         .agg(F.sum("l_quantity").alias("q")))
    j = (o.join(c, o.o_custkey == c.c_custkey, "left")
         .join(q, q.l_orderkey == o.o_orderkey, "left"))
    k = F.col("o_orderkey")
    cust = F.col("o_custkey")
    seg = F.col("c_mktsegment")
    prio1 = F.substring("o_orderpriority", 1, 1)
    return j.select(
        k.alias("row_ord"),
        F.when(k % 17 == 0, "CYACAE").otherwise("PARMAJ").alias("Species"),
        F.when(k % 211 != 9, seg).alias("PopID"),
        F.when(k % 199 != 11, F.year("o_orderdate").cast("int")).alias("BreedingSeason"),
        F.concat(F.lit("L"), (k % 40).cast("string")).alias("LocationID"),
        F.when(k % 10 == 3, F.lit(None).cast("string"))
         .when(k % 97 == 5, "1000000").when(k % 101 == 7, "0")
         .otherwise(F.concat(F.lit("f"), cust.cast("string"))).alias("FemaleID"),
        F.when((k % 10).isin(1, 7), F.lit(None).cast("string"))
         .when(k % 89 == 4, "UNKNOWN")
         .otherwise(F.concat(F.lit("m"), (cust - cust % 5 + F.when(k % 4 == 0, 5).otherwise(0))
                             .cast("string"))).alias("MaleID"),
        F.when(prio1 == "1", "replacement").when(prio1 == "2", "second")
         .when(prio1 == "3", F.lit(None).cast("string")).otherwise("first")
         .alias("ClutchType_calculated"),
        F.col("o_orderdate").cast("date").alias("LayDate_observed"),
        F.when((seg != "BUILDING") & (k % 5 > 0), F.lit(None).cast("string"))
         .when(k % 5 == 0, "NA;NA;NA").when(k % 31 == 1, "brood swap")
         .when(k % 31 == 2, "control group").alias("ExperimentID"),
        F.when(k % 13 == 0, F.lit(None).cast("int"))
         .otherwise(F.col("q").cast("int") % 12).alias("NumberFledged_observed"),
        F.when((k % 13 == 0) & (k % 2 == 0), (k % 9).cast("int")).alias("NumberFledged"),
    )


def capture_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per capture (an order that shipped), ``row_ord`` = order key. Some captures
    have no population or no season."""
    li = (read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
          .agg(F.min("l_shipdate").alias("sd"), F.min("l_linenumber").alias("ln")))
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    j = li.join(o, o.o_orderkey == li.l_orderkey).join(c, c.c_custkey == o.o_custkey, "left")
    k = F.col("l_orderkey")
    cust = F.col("o_custkey")
    return j.select(
        k.alias("row_ord"),
        F.when(k % 17 == 0, "CYACAE").otherwise("PARMAJ").alias("Species"),
        F.when(k % 223 != 5, F.col("c_mktsegment")).alias("CapturePopID"),
        F.when(k % 227 != 13, F.year("sd").cast("int")).alias("BreedingSeason"),
        F.col("sd").cast("date").alias("CaptureDate"),
        F.when(k % 2 == 0, F.concat(F.lit("F"), cust.cast("string")))
         .otherwise(F.concat(F.lit("M"), (cust - cust % 5).cast("string"))).alias("IndvID"),
        F.when(k % 11 == 0, F.lit(None).cast("string")).when(k % 2 == 0, "F")
         .otherwise("M").alias("Sex_observed"),
        F.when(k % 7 == 0, F.lit(None).cast("int")).otherwise(F.col("ln")).alias("Age_calculated"),
        F.when((F.col("c_mktsegment") == "MACHINERY") & (k % 37 == 0), "hormone")
         .alias("ExperimentID"),
    )


# A population code with no data, so the overview sees a missing population.
EMPTY_POPULATION = "NODATA"


def populations_view(brood: DataFrame) -> DataFrame:
    """Population lookup (``pop_code``): every known PopID of the brood table plus one empty
    code."""
    spark = brood.sparkSession
    extra = spark.createDataFrame([(EMPTY_POPULATION,)], "pop_code string")
    known = brood.select(F.col("PopID").alias("pop_code")).where("pop_code is not null")
    return known.distinct().unionByName(extra)


def done_view(nests: DataFrame) -> DataFrame:
    """Populations in the processed reproductive-success table (``PopID``): those with a
    season in the fledging index, that is with a nest of its input."""
    return nests.select("PopID").where("PopID is not null").distinct()


BROOD_VIEW_SQL = """
select o_orderkey as row_ord, case when o_orderkey % 17 = 0 then 'CYACAE' else 'PARMAJ' end as Species,
 case when o_orderkey % 211 <> 9 then c_mktsegment end as PopID,
 case when o_orderkey % 199 <> 11 then cast(year(o_orderdate) as integer) end as BreedingSeason,
 concat('L', cast(o_orderkey % 40 as varchar)) as LocationID,
 case when o_orderkey % 10 = 3 then null when o_orderkey % 97 = 5 then '1000000' when o_orderkey % 101 = 7 then '0'
   else concat('f', cast(o_custkey as varchar)) end as FemaleID,
 case when o_orderkey % 10 in (1, 7) then null when o_orderkey % 89 = 4 then 'UNKNOWN'
   else concat('m', cast(o_custkey - o_custkey % 5 + case when o_orderkey % 4 = 0 then 5 else 0 end as varchar)) end as MaleID,
 case substr(o_orderpriority, 1, 1) when '1' then 'replacement' when '2' then 'second' when '3' then null else 'first' end as ClutchType_calculated,
 cast(o_orderdate as date) as LayDate_observed,
 case when c_mktsegment <> 'BUILDING' and o_orderkey % 5 > 0 then null when o_orderkey % 5 = 0 then 'NA;NA;NA'
   when o_orderkey % 31 = 1 then 'brood swap' when o_orderkey % 31 = 2 then 'control group' else null end as ExperimentID,
 case when o_orderkey % 13 = 0 then null else cast(trunc(q) as integer) % 12 end as NumberFledged_observed,
 case when o_orderkey % 13 = 0 and o_orderkey % 2 = 0 then cast(o_orderkey % 9 as integer) else null end as NumberFledged
from orders left join customer on o_custkey = c_custkey
left join (select l_orderkey, sum(l_quantity) as q from lineitem group by l_orderkey) l on l_orderkey = o_orderkey
"""

CAPTURE_VIEW_SQL = """
select l_orderkey as row_ord, case when l_orderkey % 17 = 0 then 'CYACAE' else 'PARMAJ' end as Species,
 case when l_orderkey % 223 <> 5 then c_mktsegment end as CapturePopID,
 case when l_orderkey % 227 <> 13 then cast(year(sd) as integer) end as BreedingSeason, cast(sd as date) as CaptureDate,
 case when l_orderkey % 2 = 0 then concat('F', cast(o_custkey as varchar))
   else concat('M', cast(o_custkey - o_custkey % 5 as varchar)) end as IndvID,
 case when l_orderkey % 11 = 0 then null when l_orderkey % 2 = 0 then 'F' else 'M' end as Sex_observed,
 case when l_orderkey % 7 = 0 then null else ln end as Age_calculated,
 case when c_mktsegment = 'MACHINERY' and l_orderkey % 37 = 0 then 'hormone' else null end as ExperimentID
from (select l_orderkey, min(l_shipdate) as sd, min(l_linenumber) as ln from lineitem group by l_orderkey) l
join orders on o_orderkey = l_orderkey left join customer on c_custkey = o_custkey
"""
