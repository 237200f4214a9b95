"""Stacking: many traces of one gather to one trace.

Traces are rows (gather, trace id, samples ARRAY<FLOAT>). A sample is live if its
magnitude exceeds LIVE_EPSILON; dead samples count neither in sums nor in the fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIVE_EPSILON = 1e-30


def exploded(traces: DataFrame, keys: list[str], samples: str = "samples") -> DataFrame:
    """One row per sample: the keys, sample_index (from 0) and amplitude as double."""
    return traces.select(*keys, F.posexplode(samples).alias("sample_index", "a")).withColumn("a", F.col("a").cast("double"))


def live(a: Column) -> Column:
    return F.abs(a) > LIVE_EPSILON


def stack(traces: DataFrame, gather: str, method: str = "mean", min_fold: int = 1, normalize: bool = True, samples: str = "samples") -> DataFrame:
    """Rows (gather, sample_index, stack, fold); method: mean, median. Where fold < min_fold (if over 1) or no sample is live, stack is 0.

    The sums are partial per task before the shuffle, so a gather with very many traces sends one row per task and sample; the median is exact and needs the live values of a (gather, sample) together.
    """
    rows = exploded(traces, [gather], samples)
    a = F.when(live(F.col("a")), F.col("a"))
    if method == "median":
        value = F.percentile(a, F.lit(0.5))
    elif normalize:
        value = F.avg(a)
    else:
        value = F.sum(a)
    out = rows.groupBy(gather, "sample_index").agg(value.alias("stack"), F.count(a).alias("fold"))
    dead = F.col("fold") < max(1, min_fold)
    return out.withColumn("stack", F.when(dead, 0.0).otherwise(F.coalesce("stack", F.lit(0.0))))


def weighted_stack(traces: DataFrame, gather: str, offset: str = "offset", min_fold: int = 1, samples: str = "samples") -> DataFrame:
    """Rows (gather, sample_index, stack, fold): live samples weighed 1 - 0.5 |offset| / the gather's largest, over the weights' sum.

    The weights are linear in |offset|, so partial sums of a and |offset| a are enough: the largest
    offset, from headers alone, joins the sums and not the samples. Rows of null gather are left out.
    """
    far = traces.groupBy(gather).agg(F.max(F.abs(offset)).alias("_far"))
    rows = exploded(traces.where(F.col(gather).isNotNull()).withColumn("_x", F.coalesce(F.abs(offset), F.lit(0)).cast("double")), [gather, "_x"], samples)
    alive = live(F.col("a"))
    total = lambda c, name: F.coalesce(F.sum(F.when(alive, c)), F.lit(0.0)).alias(name)
    sums = rows.groupBy(gather, "sample_index").agg(total(F.col("a"), "_a"), total(F.col("_x") * F.col("a"), "_xa"), total(F.col("_x"), "_xs"), F.count_if(alive).alias("fold")).join(far, gather)
    half = lambda c: 0.5 * F.coalesce(F.try_divide(F.col(c), F.col("_far")), F.lit(0.0))
    mean = F.coalesce(F.try_divide(F.col("_a") - half("_xa"), F.col("fold") - half("_xs")), F.lit(0.0))
    return sums.select(gather, "sample_index", F.when(F.col("fold") < max(1, min_fold), 0.0).otherwise(mean).alias("stack"), "fold")


def stack_inlines(traces: DataFrame, inlines: list[int], inline: str = "inline", gather: str = "cdp", method: str = "mean", min_fold: int = 1, samples: str = "samples") -> DataFrame:
    """Rows (inline, gather, sample_index, stack, fold) of the chosen inlines' gathers, for quality control; the choice is a filter that reaches the scan. No inlines: no rows."""
    chosen = traces.where(F.col(inline).isin(inlines)).select(F.struct(inline, gather).alias("_gather"), samples)
    return stack(chosen, "_gather", method, min_fold, samples=samples).select(f"_gather.{inline}", f"_gather.{gather}", "sample_index", "stack", "fold")


def stack_summary(traces: DataFrame, gather: str, offset: str = "offset", samples: str = "samples") -> DataFrame:
    """(gather, n_traces, mean_offset, rms of the mean stack)."""
    rms = stack(traces, gather, samples=samples).groupBy(gather).agg(F.sqrt(F.avg(F.col("stack") * F.col("stack"))).alias("rms"))
    return traces.groupBy(gather).agg(F.count("*").alias("n_traces"), F.avg(offset).alias("mean_offset")).join(rms, gather)


def stack_noise(before: DataFrame, after: DataFrame, gather: str) -> DataFrame:
    """(gather, sample_index, before, after, noise, difference) of mean stacks: noise is what was taken off, difference what was gained."""
    rows = before.select(gather, "samples", F.lit(0).alias("_after")).unionByName(after.select(gather, "samples", F.lit(1).alias("_after")))
    e = exploded(rows, [gather, "_after"])
    a = F.when(live(F.col("a")), F.col("a"))
    out = e.groupBy(gather, "sample_index").agg(*[F.coalesce(F.avg(F.when(F.col("_after") == k, a)), F.lit(0.0)).alias(n) for k, n in enumerate(("before", "after"))])
    return out.withColumn("noise", F.col("before") - F.col("after")).withColumn("difference", F.col("after") - F.col("before"))
