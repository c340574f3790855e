"""Content-addressed keys: domain-separated SHA-256 of canonical JSON, as Columns and for values in hand."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .canonical import array_json, canonical_json, sha256_hex

NAMESPACE = "vg"
VERSIONS = {"event": 1, "occurrence": 1, "direct-dispatch": 2, "branch": 2, "partition": 1, "instance": 3, "batch": 2, "run": 2, "wake": 2, "input": 1, "config": 1, "owner": 1}


class ConflictError(ValueError):
    """The same key came with another content hash."""

    retryable = False

    def __init__(self, namespace: str, key: str, existing: str, received: str):
        super().__init__(f"{namespace}: {key} has {existing}, not {received}")
        self.namespace, self.key, self.existing, self.received = namespace, key, existing, received


class CapacityError(ValueError):
    """A stated limit is exceeded; trying again does not help."""

    retryable = False


class BackpressureError(RuntimeError):
    """Queues are full for now; trying again later may help."""

    retryable = True


class CallbackError(TypeError):
    """A callback returned something outside its contract."""

    retryable = False


def domain(kind: str) -> str:
    return f"{NAMESPACE}:{kind}:v{VERSIONS[kind]}"


def key_column(kind: str, *parts: Column) -> Column:
    """A key from string parts."""
    d = domain(kind)
    return F.concat(F.lit(d + ":"), F.sha2(array_json([F.lit(d), *parts]), 256))


def key(kind: str, *parts) -> str:
    """A key from JSON values in hand."""
    d = domain(kind)
    return f"{d}:{sha256_hex(canonical_json([d, *parts]))}"


def input_hash_column(json_text: Column) -> Column:
    """The hash of a value given as canonical text."""
    d = domain("input")
    return F.concat(F.lit(d + ":"), F.sha2(F.concat(F.lit(f'["{d}",'), json_text, F.lit("]")), 256))


def input_hash(value) -> str:
    return key("input", value)


def event_key(tenant, application, channel, installation, event_id) -> Column:
    return key_column("event", tenant, application, channel, installation, event_id)


def occurrence_key(event, content) -> Column:
    return key_column("occurrence", event, content)


def direct_key(occurrence, generation) -> Column:
    return key_column("direct-dispatch", occurrence, generation)


def partition_cell_key(application, tenant, channel, installation, partition) -> Column:
    return key_column("partition", application, tenant, channel, installation, partition)


def branch_key(occurrence, monitor, version, phase, correlation) -> Column:
    """A null phase is JSON null in the preimage."""
    return key_column("branch", occurrence, monitor, version, phase, correlation)


def instance_key(cell, monitor, version, correlation) -> Column:
    """The phase is no part of it."""
    return key_column("instance", cell, monitor, version, correlation)


def batch_key(instance: Column, branches: Column) -> Column:
    """From the ordered distinct branch keys, nested as an array."""
    d = domain("batch")
    return F.concat(F.lit(d + ":"), F.sha2(F.concat(F.lit(f'["{d}","'), instance, F.lit('",'), F.to_json(branches), F.lit("]")), 256))


def run_key(batch: Column, purpose: str = "primary") -> Column:
    return key_column("run", batch, F.lit(purpose))


def wake_key(run: Column, route: Column) -> Column:
    return key_column("wake", run, route)


def owner_key(config: Column, instance: Column) -> Column:
    """Who owns a stream's state: under another configuration the stream has another owner, and nothing is carried over."""
    return key_column("owner", config, instance)


def lineage_fault(k: Column, parents: Column, events: Column) -> Column:
    """What is wrong with a lineage, as a Column; null if it is distinct, rooted and without itself."""
    distinct = (F.size(F.array_distinct(parents)) == F.size(parents)) & (F.size(F.array_distinct(events)) == F.size(events))
    return F.when(F.size(events) < 1, "no root event").when(~distinct, "repeated key").when(F.array_contains(parents, k), "its own parent")


def is_key(col: Column, kind: str) -> Column:
    return col.rlike(f"^{re.escape(domain(kind))}:[0-9a-f]{{64}}\\z")


def parse_key(text: str, kind: str) -> str:
    if not isinstance(text, str) or not re.fullmatch(re.escape(domain(kind)) + ":[0-9a-f]{64}", text):
        raise ValueError(f"not a {kind} key: {text!r}")
    return text


def assert_same_input(namespace: str, k: str, existing: str, received: str) -> None:
    if existing != received:
        raise ConflictError(namespace, k, existing, received)


def context(k: str, parents: list[str], events: list[str]) -> dict:
    """Lineage of a value: distinct parents and root events, never its own parent."""
    if len(set(parents)) != len(parents) or len(set(events)) != len(events) or not events or k in parents:
        raise ValueError("lineage must be distinct, rooted and without itself")
    return {"key": k, "parent_keys": list(parents), "event_keys": list(events)}
