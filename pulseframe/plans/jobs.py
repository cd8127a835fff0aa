"""Command-line jobs.

    spark-submit pulseframe/plans/jobs.py ingest --source x.csv.gz --target x.parquet
    spark-submit pulseframe/plans/jobs.py dataset --raw RAW --rules rules.parquet --output OUT [--noise-type ...]
    spark-submit pulseframe/plans/jobs.py statistics --raw RAW --rules rules.parquet --dataset OUT --output STATS
    spark-submit pulseframe/plans/jobs.py inputs --dataset OUT --output INPUTS [--dropout 0.95 ...]
"""

from __future__ import annotations

import argparse
import os
import sys

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from pulseframe.operators import noise, stats  # noqa: E402
from pulseframe.plans import inputs  # noqa: E402
from pulseframe.plans.dataset import build_dataset  # noqa: E402
from pulseframe.session import get_spark, settle  # noqa: E402
from pulseframe.sources import io  # noqa: E402
from pulseframe.sources.readers import RawData  # noqa: E402
from pulseframe.sources.rules import check_rules, load_rules  # noqa: E402

EVENT_KEY = ["stay_id", "code", "time", "source"]
SPLITS = ("train", "val", "test")
RAW_TABLES = ("CHARTEVENTS", "INPUTEVENTS_CV", "INPUTEVENTS_MV", "ICUSTAYS", "D_ITEMS", "D_LABITEMS", "ADMISSIONS",
              "LABEVENTS", "PATIENTS", "OUTPUTEVENTS")


def generate(spark: SparkSession, args: argparse.Namespace) -> dict[str, str]:
    """Build the dataset from the raw tables and write its three tables by split."""
    options = None
    if args.noise_p > 0:
        options = {"kind": args.noise_type, "p": args.noise_p, "magnitude": args.noise_magnitude, "key_cols": EVENT_KEY}
    lists = spark.read.parquet(args.split_lists) if args.split_lists else None
    built = build_dataset(
        RawData.at(spark, args.raw), check_rules(load_rules(spark, args.rules)), args.leave_outliers, options, lists, args.seed
    )
    return io.write_splits(built.labels, built.demographics, built.events, built.label_splits, built.splits, args.output)


def describe(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    """Write the statistics of a dataset as CSV tables."""
    raw, rules = RawData.at(spark, args.raw), load_rules(spark, args.rules)
    events, labels = (io.read_split(spark, os.path.join(args.dataset, f"{n}.parquet")) for n in ("events", "labels"))
    splits = settle(events.select("stay_id", "split").distinct())
    events, stays, labels = events.drop("split"), raw.adult_stays(), labels.drop("split")
    tables = {
        "raw_numbers": stats.raw_numbers(raw.patients(), stays),
        "features": stats.feature_statistics(rules, raw.items()),
        "training": stats.split_statistics(labels, events, splits),
        "splits_table": stats.split_table(labels, events, stays, splits),
        "raw_dataset": io.file_inventory(spark, {n: os.path.join(args.raw, f"{n}.parquet") for n in RAW_TABLES}),
        "variables": stats.variable_statistics(events)
        .join(stats.normality_distance(events), "variable", "left")
        .orderBy(F.desc("count"), "variable"),
        "patient_journey": stats.journey_statistics(events, stays),
    }
    for name, df in tables.items():
        io.write_csv(df.repartition(1), os.path.join(args.output, name))  # a few rows each
    return tables


def model_inputs(spark: SparkSession, args: argparse.Namespace) -> str:
    """Fit on the training split, store what was fitted, and write padded samples of every split made with it."""
    labels, demographics, events = (io.read_split(spark, os.path.join(args.dataset, f"{n}.parquet")) for n in ("labels", "demographics", "events"))
    of = lambda df, split: df.filter(F.col("split") == split).drop("split")
    path = os.path.join(args.output, "fitted")
    inputs.save(inputs.fit(of(events, "train"), of(demographics, "train"), args.max_minute, args.top), path)
    fitted = inputs.load(spark, path)
    for n, split in enumerate(SPLITS):
        own, traits = settle(of(events, split)), of(demographics, split)
        dropout = args.dropout if split == "train" else 0.0
        pre = inputs.pretrain_input(
            own, traits, fitted, min_input=args.min_input, forecast=args.forecast, max_events=args.max_events, dropout=dropout, draws=args.draws, seed=args.seed
        )
        fine = inputs.finetune_input(own, of(labels, split), traits, fitted, max_events=args.max_events, dropout=dropout, seed=args.seed)
        for kind, samples, keys in (("pretrain", pre, inputs.SAMPLE), ("finetune", fine, ("stay_id", "t1"))):
            batched = inputs.batched(samples, args.batch, args.pad, keys).withColumn("split", F.lit(split))
            batched.write.mode("append" if n else "overwrite").partitionBy("split").parquet(os.path.join(args.output, f"{kind}.parquet"))
    return args.output


def ingest(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return io.csv_to_parquet(spark, args.source, args.target, args.schema)


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = parser.add_subparsers(dest="job", required=True)
    one = jobs.add_parser("ingest")
    one.add_argument("--source", required=True)
    one.add_argument("--target", required=True)
    one.add_argument("--schema", help="DDL text; without it the types are inferred")
    one.set_defaults(run=ingest)
    for name, run in (("dataset", generate), ("statistics", describe)):
        one = jobs.add_parser(name)
        one.add_argument("--raw", required=True, help="folder of the raw parquet tables")
        one.add_argument("--rules", required=True, help="feature rules, parquet or JSON lines")
        one.add_argument("--output", required=True)
        one.add_argument("--seed", type=int, default=42)
        one.set_defaults(run=run)
        if name == "statistics":
            one.add_argument("--dataset", required=True, help="output folder of the dataset job")
            continue
        one.add_argument("--leave-outliers", action="store_true")
        one.add_argument("--noise-type", choices=noise.KINDS, default="gaussian")
        one.add_argument("--noise-p", type=float, default=0.0)
        one.add_argument("--noise-magnitude", type=float, default=0.1)
        one.add_argument("--split-lists", help="parquet table (stay_id, split) instead of random splits")
    one = jobs.add_parser("inputs")
    one.add_argument("--dataset", required=True, help="output folder of the dataset job")
    one.add_argument("--output", required=True)
    one.add_argument("--dropout", type=float, default=0.0, help="probability that a variable of a training sample is dropped")
    for option, value in (("top", 0), ("max-minute", 1440), ("min-input", 720), ("forecast", 120), ("max-events", 512), ("draws", 1), ("batch", 32), ("pad", 0), ("seed", 42)):
        one.add_argument(f"--{option}", type=int, default=value)
    one.set_defaults(run=model_inputs)
    return parser.parse_args(argv)


if __name__ == "__main__":
    arguments = parse()
    arguments.run(get_spark(arguments.job), arguments)
