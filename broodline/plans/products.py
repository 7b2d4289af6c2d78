"""Write every product of the reference from brood + capture tables in one application.

The reference runs one script per product and hands the pair table from one script to
the next through a CSV file. Here the pair table is computed once, written, and read
by both histories; it can also be given, so that the histories run from the file alone. Each
product is one distributed write; the wide histories are one write for each set of years
that populations share.

usage: python -m broodline.plans.products --brood PATH --capture PATH --out DIR
       [--mode literal|both_sexes] [--populations PATH] [--order-by COLUMN ...]
   or: python -m broodline.plans.products --pairs PATH --out DIR [--order-by COLUMN ...]

Inputs are Parquet, or CSV where the path ends in .csv (``read.csv`` rules; ``read_csv`` for
pairs). Results depend on the order of the input rows, so an input names it: by a column
``row_ord``, or by ``--order-by`` with columns that sort the rows without ties.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broodline.operators import breeding, captures, fledge, history, overview, pairs
from broodline.session import ensure_checkpoint_dir, get_spark, stage
from broodline.sources.rcsv import header_of, read_csv_r, with_row_number, write_csv_r
from broodline.sources.schemas import BROOD_SCHEMA, CAPTURE_SCHEMA, PAIRS_SCHEMA

FINAL10 = ["pop", "nest", "year", "female", "f_pair_num", "male", "m_pair_num", "order",
           "no_order_f", "no_order_m"]


class _Out:
    def __init__(self, folder: str):
        self.folder, self.paths = folder, {}

    def path(self, name: str) -> str:
        self.paths[name] = os.path.join(self.folder, name)
        return self.paths[name]

    def put(self, name: str, df: DataFrame, **how) -> None:
        write_csv_r(df, self.path(name), **how)


def write_histories(pair_table: DataFrame, out: _Out) -> None:
    """P2, P3: event codes, long form and one column per year, one folder per population."""
    for focal in ("female", "male"):
        src = pair_table if focal == "female" else stage(pairs.drop_unorderable(pair_table, "male"))
        codes = stage(history.event_codes(src, focal))
        history.write_histories_per_population(codes, out.path(f"event_codes_{focal}_long"))
        history.write_wide_per_population(codes, focal, out.path(f"event_codes_{focal}"))


def write_products(brood: DataFrame, capture: DataFrame, out_dir: str, mode: str = "literal",
                   populations: DataFrame | None = None) -> dict[str, str]:
    """Compute and write all products; returns product name -> output folder."""
    out = _Out(out_dir)
    # P1: the pair table as the reference writes it, and with the columns that order its
    # rows, from which the histories can be made again
    fp = stage(pairs.final_pairs(pairs.pairs_table(brood, capture, mode=mode)))
    out.put("pop_pairs", fp.select(*FINAL10))
    out.put("pop_pairs_ordered", fp)
    write_histories(fp, out)
    # P4: breeding records, sorted as the reference's file, with its row names, and the
    # re-pairing rates behind the reference's chart
    records = stage(breeding.breeding_records(brood))
    out.put("breeding_records", records, row_names_by=["PopID", "BreedingSeason", "FemaleID",
                                                       "LayDate_observed", "row_ord"])
    out.put("repair_rate", breeding.repair_rate(breeding.partner_fidelity(records)))
    # P5: capture records
    out.put("capture_records", captures.capture_records(capture),
            row_names_by=["CapturePopID", "IndvID", "BreedingSeason"])
    # P6: fledging-success index (4 columns, as the reference's file)
    metrics = stage(fledge.fledge_metrics(fledge.fledge_input(brood)))
    adj = stage(fledge.adjust_by_regression(metrics))
    out.put("fledge_counts_std", fledge.standardised_change(fledge.standardise(adj)))
    out.put("fledge_metrics_long", fledge.metric_long(adj))
    # P8: what is there for each population, and which populations are still missing
    done = metrics.select("PopID").distinct()
    if populations is None:
        populations = brood.select(F.col("PopID").alias("pop_code")).where("pop_code is not null").distinct()
    out.put("population_overview", overview.population_overview(brood, populations, done))
    out.put("populations_missing", overview.populations_missing(populations, done))
    return out.paths


def read_input(spark: SparkSession, path: str, schema: T.StructType, flavour: str = "base",
               order_by: list[str] | None = None) -> DataFrame:
    """An input table with its row order in ``row_ord``; see the module. Of a CSV file the
    columns of ``schema`` that its header names are read."""
    if path.rstrip("/").endswith(".csv"):
        names = header_of(spark, path)
        df = read_csv_r(spark, path, T.StructType([f for f in schema.fields if f.name in names]), flavour)
    else:
        df = spark.read.parquet(path)
    if order_by:
        return with_row_number(df.drop("row_ord"), order_by, "row_ord")
    if "row_ord" not in df.columns:
        raise ValueError(f"{path} has no column row_ord: name the columns that order its rows with --order-by")
    return df


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--brood")
    ap.add_argument("--capture")
    ap.add_argument("--pairs")
    ap.add_argument("--populations")
    ap.add_argument("--out", required=True)
    ap.add_argument("--mode", default="literal", choices=["literal", "both_sexes"])
    ap.add_argument("--order-by", nargs="+")
    a = ap.parse_args(argv)
    if not a.pairs and not (a.brood and a.capture):
        ap.error("--pairs, or --brood and --capture")
    spark = get_spark()
    ensure_checkpoint_dir(spark)
    if a.pairs:
        out = _Out(a.out)
        table = read_input(spark, a.pairs, PAIRS_SCHEMA, "readr", a.order_by)
        if "source_rank" not in table.columns:  # the given order covers all sources of rows
            table = table.withColumn("source_rank", F.lit(0))
        write_histories(stage(table), out)
        paths = out.paths
    else:
        populations = read_csv_r(spark, a.populations, T.StructType([T.StructField("pop_code", T.StringType())])) \
            if a.populations else None
        paths = write_products(read_input(spark, a.brood, BROOD_SCHEMA, order_by=a.order_by),
                               read_input(spark, a.capture, CAPTURE_SCHEMA, order_by=a.order_by), a.out, a.mode, populations)
    for name, path in paths.items():
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
