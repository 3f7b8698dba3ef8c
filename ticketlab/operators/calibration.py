"""Regression metrics, quantile-bin reports and isotonic calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlab import functions as fn
from ticketlab.operators import order_stats
from ticketlab.operators.isotonic import Calibrator, fit_steps
from ticketlab.schema import TARGET


def regression_metrics(df: DataFrame, actual: str = TARGET, predicted: str = "pred") -> DataFrame:
    """Error and association measures, one row."""
    y, p = F.col(actual), F.col(predicted)
    error = p - y
    middle = order_stats.median(df.select(F.abs(error).alias("_error")), "_error").scalar()
    measures = df.agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(p).alias("mean_pred"),
        F.avg(y).alias("mean_actual"),
        F.stddev_pop(p).alias("std_pred"),
        F.stddev_pop(y).alias("std_actual"),
        F.when(F.count("*") > 1, F.corr(y, p)).otherwise(0.0).alias("correlation"),
    )
    return measures.select(
        "mae", "rmse", middle.alias("median_ae"),
        "mean_pred", "mean_actual", "std_pred", "std_actual", "correlation",
    )


def quantile_edges(df: DataFrame, column: str, n_bins: int) -> list[float]:
    """Distinct bin edges from minimum to maximum; ties in the data merge bins."""
    exact = order_stats.quantile_list(df, column, [i / n_bins for i in range(n_bins + 1)])
    return sorted(set(exact))


def quantile_bins(df: DataFrame, column: str, n_bins: int) -> DataFrame:
    """Add ``bin_lo`` and ``bin_hi``: right-closed quantile bins, the lowest value included.

    Only inner edges decide, so rounding an outer edge cannot lose a row.
    """
    edges: Sequence[float] = quantile_edges(df, column, n_bins)
    known = df.filter(F.col(column).isNotNull() & ~F.isnan(column))
    bins = list(zip(edges, edges[1:])) or [(e, e) for e in edges]
    lo, hi = F, F
    for a, b in bins[:-1]:
        lo, hi = lo.when(F.col(column) <= b, F.lit(a)), hi.when(F.col(column) <= b, F.lit(b))
    if len(bins) > 1:
        lo, hi = lo.otherwise(F.lit(bins[-1][0])), hi.otherwise(F.lit(bins[-1][1]))
    else:
        last = bins[0] if bins else (None, None)
        lo, hi = F.lit(last[0]).cast("double"), F.lit(last[1]).cast("double")
    return known.withColumns({"bin_lo": lo, "bin_hi": hi})


def calibration_report(
    df: DataFrame, actual: str = TARGET, predicted: str = "pred", n_bins: int = 10
) -> DataFrame:
    """Mean prediction against mean outcome per quantile bin of the prediction."""
    grouped = quantile_bins(df, predicted, n_bins).groupBy("bin_lo", "bin_hi").agg(
        F.count(actual).alias("n"),
        F.avg(predicted).alias("mean_predicted"),
        F.avg(actual).alias("mean_actual"),
    )
    gap = F.abs(F.col("mean_predicted") - F.col("mean_actual"))
    return grouped.withColumn("abs_error", gap).orderBy("bin_lo")


def calibration_bins(
    df: DataFrame, actual: str = TARGET, predicted: str = "pred", n_bins: int = 20
) -> DataFrame:
    """Finer bins with the spread of the outcome, the data of the calibration chart."""
    return (
        quantile_bins(df, predicted, n_bins)
        .groupBy("bin_lo", "bin_hi")
        .agg(
            F.count(actual).alias("n"),
            F.avg(predicted).alias("mean_pred"),
            F.avg(actual).alias("mean_actual"),
            F.stddev_samp(actual).alias("std_actual"),
        )
        .orderBy("bin_lo")
    )


def fit_calibrator(
    df: DataFrame, actual: str = TARGET, predicted: str = "pred", scale: int | None = None
) -> Calibrator:
    """Isotonic fit of the outcome on the score; scores outside the fitted range are clipped.

    ``scale`` states the decimals of the outcomes and makes the fit exact.
    """
    return Calibrator(fit_steps(df, actual, predicted, scale))


def calibrate(
    df: DataFrame, model: Calibrator | None = None, predicted: str = "pred", name: str = "calibrated"
) -> DataFrame:
    """Add the calibrated score; without a calibrator it is the score itself."""
    if model is None:
        return df.withColumn(name, F.col(predicted))
    return model.apply(df, predicted, name)
