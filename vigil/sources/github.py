"""A provider channel: GitHub webhook deliveries about pull requests, and check suites with one event per pull request.

Raw rows: delivery_id (the x-github-delivery header), event (pull_request or check_suite), tenant_id, body (the JSON text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import object_json, string_json
from ..functions.scalars import not_blank
from ..operators.channel import Channel

TIMES = ("updated_at", "completed_at", "started_at", "created_at")
PRINCIPAL = {"User": "user", "Bot": "app", "Organization": "service"}


def _at(path: str) -> Column:
    return F.get_json_object("body", f"$.{path}")


def _text(path: str) -> Column:
    """Canonical text of a string at a path; JSON null where it is absent."""
    return F.coalesce(string_json(_at(path)), F.lit("null"))


def _number(path: str) -> Column:
    return F.coalesce(_at(path).cast("bigint").cast("string"), F.lit("null"))


def one_per_pull_request(raw: DataFrame) -> DataFrame:
    """A check suite with N pull requests is N events; one without has none. Adds pull (its number) and part (the object it is about)."""
    pulls = F.from_json(F.get_json_object("body", "$.check_suite.pull_requests"), "array<struct<number:bigint>>")
    own = F.array(F.struct(_at("pull_request.number").cast("bigint").alias("number")))
    none = F.array().cast("array<struct<number:bigint>>")
    numbers = F.when(F.col("event") == "check_suite", F.coalesce(pulls, none)).when(F.col("event") == "pull_request", own).otherwise(none)
    return raw.withColumn("pull", F.explode(F.transform(numbers, lambda x: x["number"])))


def _part(name: str) -> Column:
    """A value of the object that a delivery is about."""
    return F.when(F.col("event") == "check_suite", _at(f"check_suite.{name}")).otherwise(_at(f"pull_request.{name}"))


def occurred_ms() -> Column:
    """The first of the times that can be read."""
    return F.coalesce(*[F.unix_millis(F.try_to_timestamp(_part(t))) for t in TIMES])


def address() -> Column:
    return F.concat(F.lit("repo:"), _at("repository.id"), F.lit(":pull:"), F.col("pull").cast("string"))


def target() -> Column:
    """Where a reply goes: the address and what a session needs to know of the pull request."""
    head = F.when(F.col("event") == "check_suite", _text("check_suite.head_sha")).otherwise(_text("pull_request.head.sha"))
    pull = lambda p: F.when(F.col("event") == "pull_request", _text(f"pull_request.{p}")).otherwise(F.lit("null"))
    null = F.lit("null")
    state = object_json({
        "baseRef": pull("base.ref"), "baseSha": pull("base.sha"), "checkoutPath": null, "conversationKind": F.lit('"pull_request"'), "defaultBranch": pull("base.repo.default_branch"), "headRef": pull("head.ref"),
        "headSha": head, "installationId": _number("installation.id"), "issueNumber": F.col("pull").cast("string"), "owner": _text("repository.owner.login"), "pullRequestNumber": F.col("pull").cast("string"),
        "repo": _text("repository.name"), "repositoryId": _number("repository.id"), "reviewCommentId": null, "reviewThreadRootCommentId": null, "triggeringCommentId": null, "triggeringUserLogin": _text("sender.login"),
    })
    return object_json({"address": string_json(address()), "state": state})


def check_target(target_json: Column) -> Column:
    """Whether a wake's target is one of these."""
    state = lambda p: F.get_json_object(target_json, f"$.state.{p}")
    whole = r"^[1-9]\d{0,15}$"
    ok = not_blank(F.get_json_object(target_json, "$.address")) & (state("conversationKind") == "pull_request") & state("repositoryId").rlike(whole) & state("pullRequestNumber").rlike(whole)
    return F.coalesce(ok & state("owner").isNotNull() & state("repo").isNotNull(), F.lit(False))


def channel() -> Channel:
    """Partitioned by repository and pull request; a check suite's event id carries the pull request."""
    suite = F.col("event") == "check_suite"
    pull = F.col("pull").cast("string")
    repository = object_json({"id": _number("repository.id"), "fullName": _text("repository.full_name"), "name": _text("repository.name"), "owner": _text("repository.owner.login"), "private": F.coalesce(_at("repository.private"), F.lit("false"))})
    common = {"action": _text("action"), "pullRequestNumber": pull, "repository": repository}
    own_suite = object_json(common | {"appSlug": _text("check_suite.app.slug"), "checkSuiteId": _number("check_suite.id"), "conclusion": _text("check_suite.conclusion"), "headSha": _text("check_suite.head_sha"), "status": _text("check_suite.status")})
    own_pull = object_json(common | {"headSha": _text("pull_request.head.sha")})
    kind = F.lit("unknown")
    for theirs, ours in PRINCIPAL.items():
        kind = F.when(_at("sender.type") == theirs, ours).otherwise(kind)
    actor = object_json({"id": string_json(_at("sender.id")), "principalType": string_json(kind), "displayName": string_json(_at("sender.login")), "isBot": F.when(_at("sender.type") == "Bot", "true").otherwise("false")})
    named = lambda ns, k: object_json({"namespace": F.lit(f'"{ns}"'), "key": string_json(k)})
    full = _at("repository.full_name")
    subjects = F.concat(F.lit("["), named("repository", full), F.lit(","), named("pull-request", F.concat(full, F.lit("#"), pull)), F.lit("]"))
    return Channel(
        "github", 1,
        {
            "id": F.when(suite, F.concat(F.col("delivery_id"), F.lit(":pull:"), pull)).otherwise(F.col("delivery_id")), "type": F.when(suite, "github.check-suite").otherwise("github.pull-request"), "version": F.lit(1),
            "occurred_ms": occurred_ms(), "data": F.when(suite, own_suite).otherwise(own_pull), "actor": actor, "reply_target": target(), "subjects": subjects,
        },
        F.concat(F.lit("repository:"), _at("repository.id"), F.lit(":pull-request:"), pull), installation_id=_at("installation.id"), tenant_id=F.col("tenant_id"),
        checks={"a delivery needs its id": not_blank(F.col("delivery_id")), "a delivery needs an installation": not_blank(_at("installation.id"))}, prepare=one_per_pull_request,
    )
