"""Evaluation of forecasts and audits of numeric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from popgraph.functions.draws import uniform
from popgraph.operators.risk import BETA_CONTACT, BETA_HOUSEHOLD


def regression_metrics(df: DataFrame, keys: list[str], p: str = "prediction", y: str = "target") -> DataFrame:
    e = F.col(p) - F.col(y)
    sst = F.var_pop(y) * F.count(F.lit(1))
    r2 = F.when(sst > 1e-12, 1 - F.sum(e * e) / sst).otherwise(-999.0)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(r2, 6).alias("r2"))


def brier_nll(df: DataFrame, p: str, y: str, eps: float = 1e-7) -> DataFrame:
    q = F.when(F.col(y) == 1, F.col(p)).otherwise(1 - F.col(p))
    return df.agg(F.round(F.avg(F.pow(F.col(p) - F.col(y), 2)), 6).alias("brier"), F.round(F.avg(-F.log(F.greatest(q, F.lit(eps)))), 6).alias("nll"))


def calibration_table(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin")
    return df.groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(y), 6).alias("observed"))


def event_macro_f1(df: DataFrame, pred: str, truth: str) -> DataFrame:
    t = df.groupBy(F.col(truth).alias("c")).agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col(pred) == F.col(truth)).alias("tp"))
    p = df.groupBy(F.col(pred).alias("c")).agg(F.count(F.lit(1)).alias("p"))
    f = t.join(p, "c", "full").na.fill(0)
    return f.agg(F.round(F.avg(2 * F.col("tp") / (F.col("t") + F.col("p"))), 6).alias("macro_f1"))


def weighted_losses(df: DataFrame, weight: Column, gamma: float = 2.0, p: str = "prediction", y: str = "target") -> DataFrame:
    """Weighted squared error, plain and with more weight on targets above zero (1 + gamma * target)."""
    e = weight * F.pow(F.col(p) - F.col(y), 2)
    return df.agg(F.round(F.avg(e), 6).alias("weighted_mse"), F.round(F.avg((1 + gamma * F.col(y)) * e), 6).alias("focal_mse"))


def event_time_error(pred: DataFrame, truth: DataFrame, horizon: int) -> DataFrame:
    """Mean gap of first predicted and first actual day per entity and event; a missing side costs the horizon."""
    a = pred.groupBy("agent_id", "event").agg(F.min("day").alias("pd"))
    b = truth.groupBy("agent_id", "event").agg(F.min("day").alias("td"))
    gap = F.coalesce(F.least(F.abs(F.col("pd") - F.col("td")), F.lit(horizon)), F.lit(horizon))
    return a.join(b, ["agent_id", "event"], "full").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(gap), 6).alias("error"))


def audit_numeric(df: DataFrame, cols: list[str], low: float, high: float) -> DataFrame:
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "field", "x")
    nan = F.isnan("x")
    return rows.groupBy("field").agg(F.count_if(F.col("x").isNull()).alias("nulls"), F.count_if(nan).alias("nans"), F.count_if(F.abs("x") == float("inf")).alias("infs"), F.count_if(~nan & ~F.col("x").between(low, high)).alias("out_of_range"))


def label_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "transition", "x")
    return rows.groupBy("transition").agg(
        F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"), F.min("x").alias("low"), F.max("x").alias("high"),
        F.round(F.percentile("x", F.lit(0.5)), 6).alias("median"), F.round(F.avg(F.when(F.col("x") != 0, 1.0).otherwise(0.0)), 6).alias("non_zero"),
    )


def class_weights(df: DataFrame, cols: list[str], method: str = "inverse_freq") -> DataFrame:
    """(transition, weight) from mean rates, scaled to sum to the number of transitions.

    ``inverse_freq``: 1 / rate; ``balanced``: largest rate / rate; others: equal weights.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "transition", "x").groupBy("transition").agg(F.avg("x").alias("f"))
    every = W.partitionBy()  # one row per transition
    raw = {"inverse_freq": 1 / (F.col("f") + 1e-8), "balanced": F.max("f").over(every) / (F.col("f") + 1e-8)}.get(method, F.lit(1.0))
    w = rows.withColumn("i", raw)
    scaled = F.col("i") * len(cols) / F.sum("i").over(every) if method in ("inverse_freq", "balanced") else F.col("i")
    return w.select("transition", F.round(scaled, 6).alias("weight"))


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """(field, mean, std): a constant column has std 1."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "field", "x")
    std = F.stddev_samp("x")
    return rows.groupBy("field").agg(F.avg("x").alias("mean"), F.when(std < 1e-6, 1.0).otherwise(std).alias("std"))


def apply_scaler(df: DataFrame, key: str, cols: list[str], scaler: DataFrame) -> DataFrame:
    rows = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([key], cols, "field", "x")
    return rows.join(F.broadcast(scaler), "field").select(key, "field", F.round((F.col("x") - F.col("mean")) / F.col("std"), 6).alias("z"))


def _nested(df: DataFrame, part: str) -> bool:
    return df.schema[part].dataType.elementType.typeName() == "array"


def _entries(df: DataFrame, parts: list[str]) -> DataFrame:
    """(field, pos, x) of all entries of array columns, in one pass; an array of steps gives the features of every step under their own places."""

    def listed(part: str) -> Column:
        one = lambda a: F.coalesce(F.transform(a.cast("array<double>"), lambda x, i: F.struct(F.lit(part).alias("field"), i.alias("pos"), x.alias("x"))), none)
        none = F.array().cast("array<struct<field:string,pos:int,x:double>>")
        return F.coalesce(F.flatten(F.transform(part, lambda step: one(step))), none) if _nested(df, part) else one(F.col(part))

    return df.select(F.explode(F.concat(*[listed(p) for p in parts])).alias("_e")).select("_e.field", "_e.pos", "_e.x")


def audit_arrays(df: DataFrame, parts: list[str], low: float, high: float) -> DataFrame:
    """``audit_numeric`` of the entries of array columns, by field."""
    nan = F.isnan("x")
    return _entries(df, parts).groupBy("field").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("x").isNull()).alias("nulls"), F.count_if(nan).alias("nans"), F.count_if(F.abs("x") == float("inf")).alias("infs"), F.count_if(~nan & ~F.col("x").between(low, high)).alias("out_of_range"))


def fit_array_scaler(df: DataFrame, parts: list[str], least: float = 1e-6) -> DataFrame:
    """(field, pos, mean, std) of array columns, one row a place; of arrays of steps, a feature's values at all steps are one sample.

    A constant place, and one seen once, has std 1, so it is only centred; null entries are left out.
    """
    std = F.stddev_samp("x")
    return _entries(df, parts).groupBy("field", "pos").agg(F.avg("x").alias("mean"), F.when(std >= least, std).otherwise(1.0).alias("std"))


def apply_array_scaler(df: DataFrame, parts: list[str], scaler: DataFrame) -> DataFrame:
    """``df`` with its array columns ``parts`` scaled; a place that the scaler lacks becomes null."""
    by = scaler.groupBy("field").agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "std"))).alias("s"))
    model = by.agg(F.map_from_entries(F.collect_list(F.struct("field", "s"))).alias("_model"))  # one row, as wide as the arrays
    j = df.crossJoin(F.broadcast(model))

    def scaled(part: str) -> Column:
        z = lambda a: F.zip_with(a.cast("array<double>"), F.col("_model")[part], lambda x, s: (x - s["mean"]) / s["std"])
        return F.transform(part, lambda step: z(step)) if _nested(df, part) else z(F.col(part))

    return j.withColumns({p: scaled(p) for p in parts}).drop("_model")


def seeded_split(df: DataFrame, key: str, share: float = 0.8, salt: str = "split") -> DataFrame:
    """``df`` with ``train``: true for about ``share`` of the keys, by a hash, so that a key is always on one side."""
    return df.withColumn("train", uniform(F.col(key), salt) < share)


#: Mean days of infection and the reproduction number aimed at.
INFECTIOUS_DAYS, R0_TARGET = 10.0, 2.5


def r0_from_network(household_size: Column, contacts: Column, beta_household: float = BETA_HOUSEHOLD, beta_contact: float = BETA_CONTACT, infectious: float = INFECTIOUS_DAYS) -> Column:
    return (household_size - 1) * (1 - F.exp(F.lit(-beta_household))) + beta_contact * contacts * infectious


def r_eff(history: DataFrame, r0: float = R0_TARGET) -> DataFrame:
    """(day, r_eff): R0 times the share of susceptible entities, from daily S, E, I, R, D."""
    n = F.col("S") + F.col("E") + F.col("I") + F.col("R") + F.col("D")
    return history.select("day", F.round(r0 * F.col("S") / n, 6).alias("r_eff"))


def top_categories(df: DataFrame, col: str, k: int) -> DataFrame:
    return df.groupBy(F.col(col).alias("category")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(k)


def secondary_infections(links: DataFrame, source: str) -> DataFrame:
    by = links.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    return by.agg(F.count(F.lit(1)).alias("sources"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("std"), F.max("n").alias("most"))
