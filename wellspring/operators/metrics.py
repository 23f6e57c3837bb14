"""Well, dose and classifier metrics as grouped DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.operators.ranking import attach, average_ranks
from wellspring.session import durable

TARGET_SLOPE = -3.1336  # fixed value: reference minutes per decade


def well_means(df: DataFrame, keys=("method_id",), split: str | None = "test") -> DataFrame:
    """Per (keys, chip, well): mean and sample std of predictions (0 for one pixel), true mean, n."""
    if split is not None:
        df = df.filter(F.col("split") == split)
    df = df.filter(F.col("ttp_pred").isNotNull())
    return df.groupBy(*keys, "chip_id", "well_id").agg(
        F.avg("ttp_pred").alias("pred_mean"),
        F.coalesce(F.stddev_samp("ttp_pred"), F.lit(0.0)).alias("pred_std"),
        F.avg("ttp_true").alias("true_mean"),
        F.min_by("log10_conc", "pixel_id").alias("log10_conc"),
        F.count("*").alias("n_pixels"),
    )


def dose_line(wells: DataFrame, keys=("method_id",)) -> DataFrame:
    """Least-squares line of concentration means: slope, r2 and number of concentrations."""
    conc = wells.filter(F.col("log10_conc").isNotNull()).groupBy(*keys, "log10_conc").agg(F.avg("pred_mean").alias("m"))
    return conc.groupBy(*keys).agg(
        F.count("*").alias("n_conc"),
        F.regr_slope("m", "log10_conc").alias("slope"),
        F.pow(correlation("m", "log10_conc"), F.lit(2)).alias("r2"),
    ).withColumn("slope", F.when(F.col("n_conc") >= 2, F.col("slope")))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over rows with both values; NULL where either has no spread."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    a, b = (F.when(x.isNotNull() & y.isNotNull(), c) for c in (x, y))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(a) * F.stddev_pop(b))


def spearman(df: DataFrame, keys, x: str, y: str, split_rows: int | None = None) -> DataFrame:
    """Rank correlation with average ranks of ties, per group."""
    keys = list(keys)
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rx = average_ranks(both, keys, x, split_rows).select(*keys, x, F.col("avg_rank").alias("_rx"))
    ry = average_ranks(both, keys, y, split_rows).select(*keys, y, F.col("avg_rank").alias("_ry"))
    return both.join(rx, [*keys, x]).join(ry, [*keys, y]).groupBy(*keys).agg(correlation("_rx", "_ry").alias("rho"))


def portfolio(df: DataFrame, keys=("method_id",), split: str | None = "test") -> DataFrame:
    """All resolution metrics of every method in one job."""
    keys = list(keys)
    wells = durable(well_means(df, keys, split))  # one pass over pixels; the metrics below read wells
    base = wells.groupBy(*keys).agg(
        F.avg(F.abs(F.col("pred_mean") - F.col("true_mean"))).alias("per_well_mae"),
        F.avg(F.when(F.abs("pred_mean") > 1e-6, F.col("pred_std") / F.abs("pred_mean"))).alias("within_well_cov"),
        F.count("*").alias("n_wells"),
    )
    line = dose_line(wells, keys).select(
        *keys, "slope", F.abs(F.col("slope") - F.lit(TARGET_SLOPE)).alias("slope_proximity"), "r2"
    )
    rho = spearman(wells, keys, "log10_conc", "pred_mean")
    out = attach(attach(base, line, keys, "left"), rho, keys, "left")
    return out.withColumn("passes", F.coalesce((F.col("rho") <= -0.9) & ~F.isnan("rho"), F.lit(False)))


def _safe(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def _rates(tp, fp, tn, fn) -> dict[str, Column]:
    precision, recall = _safe(tp, tp + fp), _safe(tp, tp + fn)
    return {
        "accuracy": (tp + tn) / (tp + fp + tn + fn),
        "precision": precision,
        "recall": recall,
        "f1": _safe(2 * precision * recall, precision + recall),
    }


def confusion(df: DataFrame, keys, truth: str, pred: str) -> DataFrame:
    t, p = F.col(truth) == 1, F.col(pred) == 1
    return df.groupBy(*keys).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
        F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"),
    )


def binary_metrics(df: DataFrame, keys, truth="y_true", score="y_score", thr=0.5, split_rows=None) -> DataFrame:
    """Accuracy, precision, recall, F1, exact AUROC (NULL with one class), n_pos, n_neg.

    Everything is read off the (score, count, positives) table, so ties and hot groups collapse
    before ranks are taken.
    """
    keys = list(keys)
    table = average_ranks(df, keys, score, split_rows, pos=F.col(truth).cast("long"))
    hit = F.col(score) >= thr
    neg = F.col("cnt") - F.col("pos")
    agg = table.groupBy(*keys).agg(
        F.sum("pos").alias("n_pos"), F.sum(neg).alias("n_neg"),
        F.sum(F.col("pos") * F.col("avg_rank")).alias("_rs"),
        F.coalesce(F.sum(F.when(hit, F.col("pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(hit, neg)), F.lit(0)).alias("fp"),
    )
    tp, fp, npos, nneg = (F.col(c) for c in ("tp", "fp", "n_pos", "n_neg"))
    u = F.col("_rs") - npos * (npos + 1) / 2.0
    rates = _rates(tp, fp, nneg - fp, npos - tp)
    return agg.select(
        *keys, *[c.alias(n) for n, c in rates.items()],
        F.when((npos > 0) & (nneg > 0), u / (npos * nneg)).alias("auroc"), "n_pos", "n_neg",
    )


def well_votes(df: DataFrame, keys, thr=0.5, truth="y_true", score="y_score", inclusive=False, label="first") -> DataFrame:
    """Per well: share of positive pixels and the voted class (> 0.5, or >= 0.5 if inclusive)."""
    share = F.avg((F.col(score) >= thr).cast("double"))
    lab = F.max(truth) if label == "max" else F.min_by(truth, F.struct("pixel_id", score, truth))
    out = df.groupBy(*keys, "chip_id", "well_id").agg(share.alias("share"), lab.alias("well_true"))
    vote = F.col("share") >= 0.5 if inclusive else F.col("share") > 0.5
    return out.withColumn("well_pred", vote.cast("int"))


def vote_metrics(df: DataFrame, keys, **kw) -> DataFrame:
    cm = confusion(well_votes(df, keys, **kw), keys, "well_true", "well_pred")
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return cm.select(*keys, (tp + fp + tn + fn).alias("n_wells"), *[c.alias(n) for n, c in _rates(tp, fp, tn, fn).items()])


def regression_metrics(df: DataFrame, keys, pred="ttp_pred", truth="ttp_true") -> DataFrame:
    """MAE, RMSE, R2, MAE of predicting the mean truth, and row counts; NULL predictions dropped."""
    keys = list(keys)
    ok = F.col(pred).isNotNull() & F.col(truth).isNotNull()
    base = df.groupBy(*keys).agg(
        F.count("*").alias("n_total"), F.count_if(ok).alias("n"),
        F.avg(F.when(ok, F.col(truth))).alias("_m"),
        F.avg(F.when(ok, F.abs(F.col(pred) - F.col(truth)))).alias("mae"),
        F.sqrt(F.avg(F.when(ok, F.pow(F.col(pred) - F.col(truth), 2)))).alias("rmse"),
        F.sum(F.when(ok, F.pow(F.col(pred) - F.col(truth), 2))).alias("_res"),
    )
    dev = attach(df.filter(ok), base.select(*keys, "_m"), keys).groupBy(*keys).agg(
        F.avg(F.abs(F.col(truth) - F.col("_m"))).alias("mae_mean"),
        F.sum(F.pow(F.col(truth) - F.col("_m"), 2)).alias("_tot"),
    )
    out = attach(base, dev, keys, "left")
    return out.select(
        *keys, "n_total", "n", (F.col("n_total") - F.col("n")).alias("n_nan"), "mae", "rmse",
        F.when(F.col("_tot") > 0, 1 - F.col("_res") / F.col("_tot")).alias("r2"), "mae_mean",
    )


def upsert(old: DataFrame, new: DataFrame, key: str = "method_id") -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)
