"""Usage by day and month from batches that may come late, and quotas checked in their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AMOUNTS = ("tokens", "cost", "requests")
ORDER = (("daily_tokens", "day", "tokens"), ("daily_cost", "day", "cost"), ("monthly_tokens", "month", "tokens"), ("monthly_cost", "month", "cost"))


def batch_usage(arrived: DataFrame, tenant: Column, at: Column, tokens: Column, cost: Column) -> DataFrame:
    """tenant, period, start, tokens, cost, requests of one batch, by day and by month in one pass.

    ``cost`` should be a whole number of the smallest unit, so that sums do not depend on their order. Rows without a tenant count
    for ``_platform``; rows without a time are left out.
    """
    rows = arrived.select(F.coalesce(tenant.cast("string"), F.lit("_platform")).alias("tenant"), at.cast("date").alias("date"), tokens.cast("long").alias("t"), cost.cast("long").alias("c")).filter("date IS NOT NULL")
    periods = F.explode(F.array(F.struct(F.lit("day").alias("period"), F.col("date").alias("start")), F.struct(F.lit("month").alias("period"), F.trunc("date", "month").alias("start")))).alias("p")
    # days are summed first, so that each day's rows reach the month as one
    days = rows.groupBy("tenant", "date").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("r"))
    summed = days.select("tenant", periods, "t", "c", "r").groupBy("tenant", "p").agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(n) for x, n in zip("tcr", AMOUNTS, strict=True)))
    return summed.select("tenant", "p.period", "p.start", *AMOUNTS)


def write_batch(usage: DataFrame, path: str, batch: str) -> None:
    """Keeps a batch's usage as a partition of its own; writing the batch again replaces it, so reruns do not count twice."""
    usage.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def rolled_up(parts: DataFrame) -> DataFrame:
    """Usage over all batches: tenant, period, start and the amounts. What came late is added to its day and month."""
    return parts.groupBy("tenant", "period", "start").agg(*(F.sum(c).alias(c) for c in AMOUNTS))


def quota_states(usage: DataFrame, limits: DataFrame, today: Column) -> DataFrame:
    """tenant, breach, used, most, resets of tenants with limits (tenant, daily_tokens, daily_cost, monthly_tokens, monthly_cost).

    The first limit reached in that order is the breach; 0 and null are no limit. ``resets`` is the first day of the next period.
    """
    now = usage.filter(((F.col("period") == "day") & (F.col("start") == today)) | ((F.col("period") == "month") & (F.col("start") == F.trunc(today, "month"))))
    of = lambda period, amount: F.coalesce(F.max(F.when(F.col("period") == period, F.col(amount))), F.lit(0)).alias(f"{period}_{amount}")
    spent = now.groupBy("tenant").agg(*(of(p, a) for p in ("day", "month") for a in ("tokens", "cost")))
    joined = limits.join(spent, "tenant", "left")
    value = lambda p, a: F.coalesce(f"{p}_{a}", F.lit(0))
    resets = {"day": F.date_add(today, 1), "month": F.add_months(F.trunc(today, "month"), 1)}
    met = [F.when((F.coalesce(name, F.lit(0)) > 0) & (value(p, a) >= F.col(name)), F.struct(F.lit(name).alias("breach"), value(p, a).cast("long").alias("used"), F.col(name).cast("long").alias("most"), resets[p].alias("resets"))) for name, p, a in ORDER]
    return joined.select("tenant", F.coalesce(*met).alias("m")).select("tenant", "m.breach", "m.used", "m.most", "m.resets")
