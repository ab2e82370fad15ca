"""How well a metric separates two classes: AUC, its bootstrap interval, Cohen's d, and the ranked report.

Input is long: (metric, label, value). A label that isn't the positive one, also null, is negative; NaN and null values are
missing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specula.functions.scalars import context_sensitive, finite, metric_scope

REPORT = (
    "metric scope context_sensitive direction auc_fake auc_abs auc_abs_ci_low auc_abs_ci_high auc_abs_bootstrap_std"
    " cohen_d_fake_minus_real n_fake n_real missing_rate real_mean fake_mean"
).split()
RESAMPLES, LEVEL, SEED = 1000, 0.95, 42


def _positive(positive: str):
    return F.coalesce(F.col("label") == positive, F.lit(False))


def auc(long: DataFrame, positive: str = "Fake") -> DataFrame:
    """(metric, auc): the chance that a positive scores higher, ties half; NaN if a side is empty.

    Equal to comparing all pairs. Values are counted by (metric, value) first, then dealt in order to ranges of about equal
    size, whatever the metrics. A task runs once over its range: the negatives below a value are those before it in the range,
    and those of a metric's lower ranges, which one row a range and metric tells.
    """
    v = finite("value")
    counts = long.select("metric", v.alias("v"), _positive(positive).alias("pos")).groupBy("metric", "v").agg(F.count_if("pos").alias("p"), F.count_if(~F.col("pos")).alias("n"))
    parts = counts.repartitionByRange("metric", "v").sortWithinPartitions("metric", "v").mapInArrow(_range_sums, "metric string, low double, p long, n long, won double")
    lower = F.coalesce(F.sum("n").over(Window.partitionBy("metric").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = parts.withColumn("won", F.col("won") + F.col("p") * lower).groupBy("metric").agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    pairs = F.nullif(F.col("p").cast("double") * F.col("n"), F.lit(0.0))
    return summed.select("metric", F.coalesce(F.col("won") / pairs, F.lit(float("nan"))).alias("auc"))


def _range_sums(batches):
    """Of a sorted range a row for each metric: its least value, positives, negatives and pairs won within the range.

    A metric's missing values (null) make a row of nothing, so that the metric is there. A metric may span batches.
    """
    held: list = []  # of the last metric seen: metric, low, p, n, won

    def row():
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(held, (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.float64()))], ["metric", "low", "p", "n", "won"])

    for batch in batches:
        names, v = batch.column("metric"), batch.column("v")
        known = v.is_valid().to_numpy(zero_copy_only=False)
        p, n = (np.where(known, batch.column(c).to_numpy(), 0) for c in ("p", "n"))
        level = v.to_numpy(zero_copy_only=False)
        codes = names.dictionary_encode()
        code, heads = codes.indices.fill_null(-1).to_numpy(), codes.dictionary.to_pylist()
        cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            metric = heads[code[a]] if code[a] >= 0 else None
            if held and held[0] != metric:
                yield row()
                held = []
            held = held or [metric, None, 0, 0, 0.0]
            below = held[3] + np.cumsum(n[a:b]) - n[a:b]
            if held[1] is None and known[a:b].any():
                held[1] = float(level[a:b][known[a:b]][0])
            held[2:] = [held[2] + int(p[a:b].sum()), held[3] + int(n[a:b].sum()), held[4] + float((p[a:b] * (below + n[a:b] / 2)).sum())]
    if held:
        yield row()


def separation(long: DataFrame, positive: str = "Fake", negative: str = "Real") -> DataFrame:
    """(metric, cohen_d, n_fake, n_real, missing_rate, real_mean, fake_mean) in one aggregation."""
    v, pos = finite("value"), _positive(positive)
    p, n, r = F.when(pos, v), F.when(~pos, v), F.when(F.col("label") == negative, v)
    out = long.groupBy("metric").agg(
        *(f(x).alias(f"{name}_{k}") for k, x in (("p", p), ("n", n)) for name, f in (("count", F.count), ("avg", F.avg), ("var", F.var_samp))),
        F.count(r).alias("n_real"),
        F.avg(r).alias("real_mean"),
        F.count(v).alias("held"),
        F.count(F.lit(1)).alias("rows"),
    )
    pooled = F.nullif(F.sqrt((F.col("var_p") + F.col("var_n")) / 2), F.lit(0.0))
    enough = (F.col("count_p") >= 2) & (F.col("count_n") >= 2)
    nan = F.lit(float("nan"))
    return out.select(
        "metric",
        F.coalesce(F.when(enough, (F.col("avg_p") - F.col("avg_n")) / pooled), nan).alias("cohen_d"),
        F.col("count_p").alias("n_fake"),
        "n_real",
        (1 - F.col("held") / F.col("rows")).alias("missing_rate"),
        F.coalesce("real_mean", nan).alias("real_mean"),
        F.coalesce("avg_p", nan).alias("fake_mean"),
    )


def _auc_of(neg: np.ndarray, pos: np.ndarray) -> float:
    neg = np.sort(neg)
    return float((np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")).sum() / (2.0 * len(neg) * len(pos)))


def bootstrap(long: DataFrame, order: str, positive: str = "Fake", resamples: int = RESAMPLES, level: float = LEVEL, seed: int = SEED) -> DataFrame:
    """(metric, auc_abs_ci_low, auc_abs_ci_high, auc_abs_bootstrap_std): quantiles of max(AUC, 1 - AUC) over resamples.

    The generator starts anew for each metric and draws positives before negatives, so values are put in the order of the
    column ``order``. Rows without label or value are left out, fewer than two of a side give NaN. A metric is resampled by
    one task, which holds its values, one per video; this is for video tables, not for frames.
    """

    def run(key, rows):
        rows = rows.sort_values("at", kind="stable").dropna(subset=["label", "value"])
        pos = rows.loc[rows["label"] == positive, "value"].to_numpy(float)
        neg = rows.loc[rows["label"] != positive, "value"].to_numpy(float)
        out = [float("nan")] * 3
        if len(pos) > 1 and len(neg) > 1 and resamples:
            rng = np.random.default_rng(seed)
            drawn = np.empty(resamples)
            for k in range(resamples):
                p = rng.choice(pos, size=len(pos), replace=True)
                a = _auc_of(rng.choice(neg, size=len(neg), replace=True), p)
                drawn[k] = max(a, 1 - a)
            tail = (1 - level) / 2
            out = [float(np.quantile(drawn, tail)), float(np.quantile(drawn, 1 - tail)), float(drawn.std(ddof=1)) if resamples > 1 else 0.0]
        return pd.DataFrame([[key[0], *out]], columns=["metric", "lo", "hi", "sd"])

    rows = long.select("metric", "label", F.col("value").cast("double").alias("value"), F.col(order).alias("at"))
    found = rows.groupBy("metric").applyInPandas(run, "metric string, lo double, hi double, sd double")
    nan = F.lit(float("nan"))  # pandas hands NaN back as null
    return found.select("metric", *(F.coalesce(c, nan).alias(n) for c, n in (("lo", "auc_abs_ci_low"), ("hi", "auc_abs_ci_high"), ("sd", "auc_abs_bootstrap_std"))))


def report(long: DataFrame, order: str | None = None, positive: str = "Fake", negative: str = "Real", resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """The report's columns for every metric, the best separated first; without ``order`` the interval is NaN.

    Ranked by auc_abs, then by the size of Cohen's d, what can't be told last.
    """
    nan = F.lit(float("nan"))
    out = auc(long, positive).join(separation(long, positive, negative), "metric")
    if order and resamples:
        out = out.join(bootstrap(long, order, positive, resamples, seed=seed), "metric")
    else:
        out = out.withColumns({c: nan for c in ("auc_abs_ci_low", "auc_abs_ci_high", "auc_abs_bootstrap_std")})
    a = finite("auc")
    out = out.withColumns(
        {
            "auc_fake": F.col("auc"),
            "auc_abs": F.coalesce(F.greatest(a, 1 - a), nan),
            "direction": F.when(a >= 0.5, "higher_fake").when(a < 0.5, "higher_real").otherwise("undefined"),
            "scope": metric_scope("metric"),
            "context_sensitive": context_sensitive("metric"),
            "cohen_d_fake_minus_real": F.col("cohen_d"),
        }
    )
    return ranked(out.select(*REPORT))


def ranked(rows: DataFrame) -> DataFrame:
    return rows.orderBy(finite("auc_abs").desc_nulls_last(), F.abs(finite("cohen_d_fake_minus_real")).desc_nulls_last(), "metric")


def top(rows: DataFrame, k: int = 20) -> DataFrame:
    return ranked(rows).limit(k)
