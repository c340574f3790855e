"""Batches to outcomes, runs and wakes; native where the decision is declarative."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import object_json, string_json
from ..functions.identity import input_hash_column, wake_key
from ..operators.policy import Limits
from ..operators.rules import Rules
from .batches import decisions

OUTCOME = ("kind", "route_id", "target", "instruction", "decision", "evidence")


def decided(batches: DataFrame, rules: Rules, routes: list[str]) -> DataFrame:
    """Keyed batches with their outcomes: what a Python decision has left in the row stays, Decisions are worked out here."""
    own = [(r, d.columns(routes)) for r, d in decisions(rules)]
    if not own:
        return batches
    columns = {}
    for name in OUTCOME:
        value = F.col(name)
        for r, cols in own:
            value = F.when((F.col("monitor_id") == r.id) & (F.col("definition_version") == r.version), cols[name].cast("string")).otherwise(value)
        columns[name] = value
    return batches.withColumns(columns)


def runs(batches: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """One row per decided batch with its wake, and status: ignored, shadowed, deliver or terminal (a wake over its size cap).

    wake is the canonical text that is delivered, byte for byte, at every try. Undecided batches have no row.
    """
    s = lambda c: string_json(F.col(c))
    woke = F.col("kind") == "wake"
    body = {
        "runKey": s("run_key"), "batchKey": s("batch_key"), "instanceKey": s("instance_key"), "applicationId": s("application_id"), "tenantId": s("tenant_id"), "monitorId": s("monitor_id"),
        "definitionVersion": s("definition_version"), "correlationKey": s("correlation_key"), "rootEventKeys": F.to_json("root_event_keys"), "routeId": s("route_id"),
        "target": F.col("target"), "instruction": s("instruction"), "decision": F.col("decision"), "evidence": F.col("evidence"),
    }
    df = batches.where(F.col("kind").isNotNull()).withColumn("input_hash", F.when(woke, input_hash_column(object_json(body))))
    df = df.withColumn("wake_key", F.when(woke, wake_key(F.col("run_key"), F.col("route_id"))))
    df = df.withColumn("wake", F.when(woke & (F.col("mode") == "active"), object_json(body | {"inputHash": s("input_hash"), "wakeKey": s("wake_key")})))
    status = F.when(~woke, "ignored").when(F.col("mode") == "shadow", "shadowed").when(F.octet_length("wake") > limits.max_wake_bytes, "terminal").otherwise("deliver")
    return df.withColumn("status", status)


def counters(run_rows: DataFrame) -> DataFrame:
    """status, n."""
    return run_rows.groupBy("status").agg(F.count("*").alias("n"))


def undelivered(wakes: DataFrame, delivered: DataFrame) -> DataFrame:
    """Wakes to deliver that `delivered` (wake_key, input_hash) does not hold; a repeated wake stands once."""
    return wakes.where("status = 'deliver'").dropDuplicates(["wake_key", "input_hash"]).join(delivered.select("wake_key"), "wake_key", "left_anti")


def delivery_conflicts(wakes: DataFrame, delivered: DataFrame) -> DataFrame:
    """wake_key, existing, received: the same key with another content."""
    old = delivered.select("wake_key", F.col("input_hash").alias("existing"))
    return wakes.where("status = 'deliver'").select("wake_key", F.col("input_hash").alias("received")).join(old, "wake_key").where("existing <> received").distinct()


def message(wake_rows: DataFrame) -> DataFrame:
    """wake_rows with `message`: what an agent session gets, the trusted instruction apart from the untrusted evidence."""
    s = lambda c: string_json(F.col(c))
    task = object_json({"trust": F.lit('"application"'), "instruction": s("instruction")})
    seen = object_json({"trust": F.lit('"untrusted"'), "value": F.col("evidence")})
    return wake_rows.withColumn("message", object_json({
        "kind": F.lit('"attention"'), "applicationId": s("application_id"), "tenantId": s("tenant_id"), "monitorId": s("monitor_id"), "definitionVersion": s("definition_version"), "correlationKey": s("correlation_key"),
        "wakeKey": s("wake_key"), "runKey": s("run_key"), "batchKey": s("batch_key"), "rootEventKeys": F.to_json("root_event_keys"), "target": F.col("target"), "task": task, "decision": F.col("decision"), "evidence": seen,
    }))


def requests(wake_rows: DataFrame, address: str, state: str = "'{}'", auth: str | None = None) -> DataFrame:
    """What an agent session is sent for each wake: wake_key, idempotency_key, turn_policy, address, state, auth, message.

    address, state and auth are SQL over a wake's row (a literal is a constant). One turn waits for the other in a session.
    """
    df = message(wake_rows.where("status = 'deliver'"))
    own = F.lit(None).cast("string") if auth is None else F.expr(auth).cast("string")
    return df.select("wake_key", F.col("wake_key").alias("idempotency_key"), F.lit("queue").alias("turn_policy"), F.expr(address).cast("string").alias("address"), F.expr(state).cast("string").alias("state"), own.alias("auth"), "message")
