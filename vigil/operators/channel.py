"""Channels: raw rows to canonical, validated, content-addressed events."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json, object_json, plain_json, string_json
from ..functions.identity import event_key, input_hash_column, occurrence_key
from ..functions.scalars import iso, not_blank, positive

#: Fields of a canonical event: name -> (JSON name, kind). Kinds: text (a string), number, time (milliseconds), json (canonical text).
FIELDS = {
    "id": ("id", "text"), "type": ("type", "text"), "version": ("version", "number"), "occurred_ms": ("occurredAt", "time"), "data": ("data", "json"),
    "actor": ("actor", "json"), "auth_ref": ("authRef", "text"), "reply_target": ("replyTarget", "json"), "subjects": ("subjects", "json"),
}
REQUIRED = ("id", "type", "version", "data")
ORIGINS = ("external", "wake", "agent")
PRINCIPALS = ("user", "app", "service", "agent", "unknown")


@dataclass(frozen=True)
class Channel:
    """fields: Columns over a raw row, by the names in FIELDS (an absent optional one is left out, or null in a row).

    source: Columns or constants for channel_id, installation_id and tenant_id. checks: name -> Column that must hold of a raw
    row; rows that fail go to rejects. prepare: an optional step before, such as an explode (one delivery, many events).
    """

    name: str
    version: int
    fields: dict[str, Column]
    partition_key: Column
    installation_id: str | Column = "i0"
    tenant_id: str | Column = "t0"
    origin_kind: str = "external"
    origin_depth: int = 0
    checks: dict[str, Column] = field(default_factory=dict)
    prepare: Callable[[DataFrame], DataFrame] | None = None

    def __post_init__(self):
        positive(self.version, "version")
        if unknown := set(self.fields) - set(FIELDS):
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        if missing := set(REQUIRED) - set(self.fields):
            raise ValueError(f"missing fields: {sorted(missing)}")
        if self.origin_kind not in ORIGINS or self.origin_depth < 0:
            raise ValueError("bad origin")

    def shaped(self, raw: DataFrame, application_id: str, accepted_ms: Column | None = None) -> DataFrame:
        """All rows with their event columns and `issues`, the checks that failed, joined by `; ` (empty if none)."""
        raw = self.prepare(raw) if self.prepare else raw
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        own = {k: self.fields.get(k, F.lit(None)).cast("bigint" if FIELDS[k][1] in ("number", "time") else "string").alias(k) for k in FIELDS}
        issues = F.concat_ws("; ", *[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in self.checks.items()])
        df = raw.select(
            *own.values(), F.lit(application_id).alias("application_id"), F.lit(self.version).cast("bigint").alias("canonicalization_version"),
            F.lit(self.name).alias("channel_id"), lit(self.installation_id).cast("string").alias("installation_id"), lit(self.tenant_id).cast("string").alias("tenant_id"),
            self.partition_key.cast("string").alias("partition_key"), (accepted_ms if accepted_ms is not None else self.fields.get("occurred_ms", F.lit(0))).cast("bigint").alias("accepted_ms"), issues.alias("__raw"),
        )
        shape = {
            "id must not be blank": not_blank(F.col("id")), "type must not be blank": not_blank(F.col("type")), "version must be positive": F.col("version").between(1, 2**53 - 1),
            "data is missing": F.col("data").isNotNull(), "partition key must not be blank": not_blank(F.col("partition_key")),
            "tenant must not be blank": not_blank(F.col("tenant_id")), "installation must not be blank": not_blank(F.col("installation_id")),
            "authRef must not be blank": F.col("auth_ref").isNull() | not_blank(F.col("auth_ref")),
        }
        found = F.concat_ws("; ", F.when(F.col("__raw") != "", F.col("__raw")), *[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in shape.items()])
        return df.withColumn("issues", found).drop("__raw")

    def rejects(self, raw: DataFrame, application_id: str) -> DataFrame:
        return self.shaped(raw, application_id).where("issues <> ''").select("id", "type", "issues")

    def events(self, raw: DataFrame, application_id: str, accepted_ms: Column | None = None) -> DataFrame:
        """Valid rows as accepted events with event_key, input_hash, occurrence_key and their canonical text event_json."""
        df = self.shaped(raw, application_id, accepted_ms).where("issues = ''").drop("issues")
        kinds = {"text": string_json, "number": lambda c: c.cast("string"), "time": lambda c: plain_json(iso(c)), "json": lambda c: c}
        own = {js: kinds[kind](F.col(k)) for k, (js, kind) in FIELDS.items() if k in self.fields}
        given = lambda x, c: string_json(F.col(c)) if isinstance(x, Column) else F.lit(canonical_json(x))
        own["source"] = object_json({"channelId": given(self.name, "channel_id"), "installationId": given(self.installation_id, "installation_id"), "tenantId": given(self.tenant_id, "tenant_id")})
        own["origin"] = F.lit(f'{{"depth":{self.origin_depth},"kind":"{self.origin_kind}"}}')
        df = df.withColumn("event_json", object_json(own))
        accepted = object_json({
            "applicationId": given(application_id, "application_id"), "canonicalizationVersion": F.col("canonicalization_version").cast("string"),
            "event": F.col("event_json"), "partitionKey": string_json(F.col("partition_key")),
        })
        df = df.withColumn("event_key", event_key(*[F.col(c) for c in ("tenant_id", "application_id", "channel_id", "installation_id", "id")])).withColumn("input_hash", input_hash_column(accepted))
        return df.withColumn("occurrence_key", occurrence_key(F.col("event_key"), F.col("input_hash")))


def conflicts(events: DataFrame) -> DataFrame:
    """event_key, contents: keys that came with more than one content."""
    return events.groupBy("event_key").agg(F.countDistinct("input_hash").alias("contents")).where("contents > 1")


def canonicalization_faults(channel: Channel, same: DataFrame, other: DataFrame, application_id: str = "app") -> DataFrame:
    """event_key, input_hash, fault. `same` holds deliveries with their retries, which must keep key and content; `other` changed ones, which must keep the key and change the content."""
    a, b = (channel.events(x, application_id).select("event_key", "input_hash").distinct() for x in (same, other))
    twice = a.groupBy("event_key").agg(F.min("input_hash").alias("input_hash"), F.count("*").alias("n")).where("n > 1").drop("n")
    lost = b.join(a.select("event_key"), "event_key", "left_anti")
    kept = b.join(a, ["event_key", "input_hash"], "left_semi")
    named = lambda df, fault: df.select("event_key", "input_hash", F.lit(fault).alias("fault"))
    return named(twice, "a retry changed the content").unionByName(named(lost, "a change lost its key")).unionByName(named(kept, "a change kept the content"))


def assert_channel(channel: Channel, same: DataFrame, other: DataFrame, application_id: str = "app") -> None:
    """Contract test of a channel: raises with the first fault."""
    fault = canonicalization_faults(channel, same, other, application_id).first()
    if fault or not channel.events(same, application_id).limit(1).count():
        raise AssertionError(f"the channel's canonical form is not stable under retries: {fault}")
