"""Aggregation of experiment runs."""

from __future__ import annotations



from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseframe.operators.joins import attach

# Scaler class in a run's config -> kind, and the display order of kinds and noises.
RUN_KINDS = {"VariableStandardScaler": "z", "VariableECDFScaler": "ecdf"}
KIND_ORDER = ("z", "ecdf")
NOISE_ORDER = ("none", "gaussian", "uniform")
EXCLUDED_TAGS = ("archive", "with-bias")
SUMMARY_METRICS = ("test_auroc", "test_pr_auc", "test_minrp", "test_loss")


def _rank(column: str, order: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column)).cast("int")


def _mapped(column: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(table, column)


def runs_flatten(
    runs: DataFrame,
    names: dict[str, str],
    stage: str | None = None,
    fraction_range: tuple[float, float] | None = None,
    exclude_tags: tuple[str, ...] = EXCLUDED_TAGS,
    metrics: tuple[str, ...] = SUMMARY_METRICS,
) -> DataFrame:
    """One flat row per finished run, ordered by kind and noise type.

    ``runs`` has ``run_id, name, state, stage, tags`` and the JSON texts ``config`` and
    ``summary``. The best epoch is the last one less the patience of early stopping.
    """

    def config(path):
        return F.get_json_object("config", path)

    def summary(path):
        return F.get_json_object("summary", path).cast("double")

    fraction = config("$.data_fraction").cast("double")
    tags = F.array(*[F.lit(t) for t in exclude_tags])
    kept = runs.filter(
        F.col("name").isin(*names) & (F.col("state") == "finished") & ~F.arrays_overlap(F.col("tags"), tags)
    )
    if stage is not None:
        kept = kept.filter(F.col("stage") == stage)
    if fraction_range is not None:
        kept = kept.filter(fraction.between(*fraction_range))
    dataset = "$.data_config.train.dataset"
    folders = F.split(config(f"{dataset}.path"), "/")
    data = F.try_element_at(folders, F.lit(-2))
    noise = F.regexp_extract(data, "noisy_([a-z]+)", 1)
    flat = kept.select(
        "run_id",
        _mapped(F.col("name"), names).alias("name"),
        "stage",
        _mapped(config(f"{dataset}.scaler_class"), RUN_KINDS).alias("kind"),
        data.alias("data"),
        F.when(noise == "", F.lit("none")).otherwise(noise).alias("noise_type"),
        config("$.data_config.train.loader.batch_size").cast("int").alias("batch_size"),
        fraction.alias("data_fraction"),
        (summary("$._runtime") / 60).alias("training_time"),
        (summary("$.epoch") - F.coalesce(config("$.early_stop_callback.patience").cast("double"), F.lit(0.0)))
        .cast("int").alias("epoch"),
        *[summary(f"$.{m}").alias(m) for m in metrics],
    )
    return flat.orderBy(_rank("kind", KIND_ORDER), _rank("noise_type", NOISE_ORDER), "run_id")


def mean_sem(
    runs: DataFrame, group_by: list[str], metrics: list[str], digits: int = 3, factors: dict[str, float] | None = None
) -> DataFrame:
    """Long table ``(group..., metric, mean, sem)``, rounded; metrics without any value are dropped.

    ``factors`` scales a metric first (pretraining losses are shown times 1000).
    """
    scaled = runs.select(
        *group_by, *[(F.col(m).cast("double") * F.lit(float((factors or {}).get(m, 1.0)))).alias(m) for m in metrics]
    )
    rows = scaled.unpivot(group_by, metrics, "metric", "v")
    table = rows.groupBy(*group_by, "metric").agg(
        F.round(F.avg("v"), digits).alias("mean"),
        F.round(F.stddev_samp("v") / F.sqrt(F.count("v")), digits).alias("sem"),
        F.count("v").alias("_n"),
    )
    present = table.withColumn("_any", F.max("_n").over(Window.partitionBy("metric"))).filter("_any > 0")
    return present.select(*group_by, "metric", "mean", "sem")


def baseline_diff(table: DataFrame, baseline: str, by: str, within: list[str]) -> DataFrame:
    """Relative difference of ``mean`` to the row where ``by`` is ``baseline``, inside ``within`` and metric."""
    keys = [*within, "metric"]
    base = table.filter(F.col(by) == baseline).select(*keys, F.col("mean").alias("_base"))
    return attach(table, base, keys, "left").withColumn(
        "rel_diff", F.try_divide(F.col("mean") - F.col("_base"), F.col("_base"))
    ).drop("_base")


def best_flag(table: DataFrame, within: list[str], how: str | dict[str, str] = "max") -> DataFrame:
    """Mark the best ``mean`` per group and metric: the largest, smallest or nearest to 0.

    ``how`` is ``max``, ``min`` or ``abs_min``, for all metrics or by metric.
    """
    by_metric = how if isinstance(how, dict) else {}
    rule = _mapped(F.col("metric"), by_metric) if by_metric else F.lit(how)
    goal = (
        F.when(rule == "min", -F.col("mean")).when(rule == "abs_min", -F.abs("mean")).otherwise(F.col("mean"))
    )
    keys = [*within, "metric"]
    scored = table.withColumn("_goal", goal)
    top = scored.groupBy(*keys).agg(F.max("_goal").alias("_top"))
    return attach(scored, top, keys).withColumn("best", F.col("_goal") == F.col("_top")).drop("_goal", "_top")


def rescale_between(runs: DataFrame, baselines: DataFrame, metrics: list[str]) -> DataFrame:
    """Rescale metrics so that, per data fraction, the worst and best mean baseline are 0 and 1."""
    means = baselines.groupBy("data", "data_fraction").agg(*[F.avg(m).alias(m) for m in metrics])
    limits = means.groupBy("data_fraction").agg(
        *[f(m).alias(f"_{n}_{m}") for m in metrics for n, f in (("lo", F.min), ("hi", F.max))]
    )
    joined = attach(runs, limits, "data_fraction", "left")
    scaled = {m: F.try_divide(F.col(m) - F.col(f"_lo_{m}"), F.col(f"_hi_{m}") - F.col(f"_lo_{m}")) for m in metrics}
    return joined.withColumns(scaled).select(*runs.columns)


def best_run(runs: DataFrame, metric: str) -> DataFrame:
    """The run with the smallest metric (ties by id), as one row."""
    chosen = F.min(F.struct(F.col(metric).alias("metric"), F.col("run_id").alias("run_id")))
    return runs.filter(F.col(metric).isNotNull()).agg(chosen.alias("_best")).select(
        "_best.run_id", F.col("_best.metric").alias(metric)
    )


def combine_results(
    own: DataFrame, external: DataFrame, name_map: dict[str, str], fractions: list[float] | None = None
) -> DataFrame:
    """Own runs and external results in one table.

    External training times are seconds, names are mapped where listed, and columns without any
    value in the union are dropped.
    """
    renamed = external.withColumn("training_time", F.col("training_time") / 60).withColumn(
        "name", F.coalesce(_mapped(F.col("name"), name_map), F.col("name"))
    )
    both = own.unionByName(renamed, allowMissingColumns=True)
    filled = both.agg(*[F.count(c).alias(c) for c in both.columns]).first()
    both = both.select(*[c for c in both.columns if filled[c] > 0])
    return both if fractions is None else both.filter(F.col("data_fraction").isin(*fractions))
