"""The life of prepared wakes as a table: claims under a lease, receipts, retries and terminal failures.

A queue has one row per wake: wake_key, input_hash, wake (the bytes that every try sends), status (pending, delivered or
terminal), retry_ms, lease_ms (null without a claim), failures, delivered_ms and reason. Each step is a projection of the queue
or one join with it, so that a queue of any size moves in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.policy import Limits

#: Kinds of errors that another try does not mend; any other error is tried again.
TERMINAL = ("capacity", "conflict", "callback")


def queue(run_rows: DataFrame) -> DataFrame:
    """The wakes to deliver, due from when their batch was frozen."""
    none = F.lit(None)
    return run_rows.where("status = 'deliver'").select(
        "wake_key", "input_hash", "wake", F.lit("pending").alias("status"), F.col("frozen_ms").cast("bigint").alias("retry_ms"), none.cast("bigint").alias("lease_ms"),
        F.lit(0).alias("failures"), none.cast("bigint").alias("delivered_ms"), none.cast("string").alias("reason"),
    )


def claim(rows: DataFrame, now: Column, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """The queue after a sweep at `now`: what is due and under no running lease gets one. `claimed` tells which rows this sweep owns."""
    mine = (F.col("status") == "pending") & (F.col("retry_ms") <= now) & (F.coalesce("lease_ms", F.lit(0)) <= now)
    return rows.withColumn("claimed", mine).withColumn("lease_ms", F.when(mine, now + limits.lease_ms).otherwise(F.col("lease_ms")))


def settle(rows: DataFrame, results: DataFrame, now: Column, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """The queue after results (wake_key, lease_ms, and an error or the receipt's receipt_key, receipt_hash, receipt_ms), one per wake.

    A result under another lease than the row's is stale and changes nothing. A receipt must name the wake's key and hash.
    """
    r = results.select("wake_key", F.col("lease_ms").alias("__lease"), "error", "receipt_key", "receipt_hash", "receipt_ms", F.lit(True).alias("__there"))
    df = rows.drop("claimed").join(r, "wake_key", "left")
    live = F.coalesce(F.col("__there") & (F.col("status") == "pending") & (F.col("__lease") == F.col("lease_ms")), F.lit(False))
    faulty = F.when(~F.col("receipt_key").eqNullSafe(F.col("wake_key")) | F.col("receipt_ms").isNull(), "callback").when(~F.col("receipt_hash").eqNullSafe(F.col("input_hash")), "conflict")
    error = F.coalesce("error", faulty)
    df = df.withColumn("__live", live).withColumn("__error", error).withColumn("__n", F.col("failures") + 1)
    final = F.col("__error").isin(*TERMINAL) | (F.col("__n") >= limits.max_attempts)
    done = {
        "status": F.when(F.col("__error").isNull(), "delivered").when(final, "terminal").otherwise("pending"),
        "retry_ms": F.when(F.col("__error").isNotNull() & ~final, now + limits.retry_delay_ms).otherwise(F.col("retry_ms")),
        "lease_ms": F.lit(None).cast("bigint"), "failures": F.when(F.col("__error").isNotNull(), F.col("__n")).otherwise(F.col("failures")),
        "delivered_ms": F.when(F.col("__error").isNull(), F.col("receipt_ms")), "reason": F.col("__error"),
    }
    return df.select(*[F.when(F.col("__live"), done[c]).otherwise(F.col(c)).alias(c) if c in done else F.col(c) for c in rows.columns if c != "claimed"])
