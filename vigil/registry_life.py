"""Registered queries of the provider channel, of delivery and of the checks at handoff, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.identity import is_key, lineage_fault, owner_key
from .functions.scalars import add_ms, is_iso, iso, to_ms
from .operators.channel import canonicalization_faults
from .operators.policy import Limits
from .operators.rules import stream_appends, verify_handoff
from .plans.app import config_key
from .plans.delivery import claim, queue, settle
from .plans.wakes import requests
from .registry import _ERR, _WAKES, ERRORS, FANNED, _ev, _fan, _k, app, branches, events, events_channel, run_rows, t
from .sources import github
from .sources.tables import stored

TIMES = 4
FEW = Limits(max_attempts=3)


def deliveries(spark, d) -> DataFrame:
    """Webhook deliveries made from events: two pull requests for each check suite, with odd times, senders and installations."""
    s = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    n, u = F.col("event_id"), F.col("user_id")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    pulls = F.array_join(F.transform(F.when(n % 4 > 0, F.sequence(F.lit(1), (n % 4).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit('{"number":'), (u + i).cast("string"), F.lit("}"))), ",")
    suite = s(',"check_suite":{"id":', n, ',"head_sha":"h', n, '","status":"completed","conclusion":null,"app":{"slug":"ci"},"updated_at":"soon","completed_at":"', F.when(n % 5 == 0, "never").otherwise(at), '","created_at":"2024-01-01T00:00:00Z","pull_requests":[', pulls, "]}")
    pull = s(',"pull_request":{"number":', u + 1, ',"head":{"sha":"s', n, '","ref":"topic"},"base":{"sha":"b","ref":"main","repo":{"default_branch":"trunk"}},"updated_at":"', F.when(n % 5 == 0, "soon").otherwise(at), '","created_at":"2024-01-01T00:00:00Z"}')
    sender = F.element_at(F.array(*map(F.lit, ("User", "Bot", "Organization", "Mannequin"))), (n % 4 + 1).cast("int"))
    body = s(
        '{"action":"done","repository":{"id":', u + 7, ',"name":"r', u, '","full_name":"o/r', u, '","private":', F.when(n % 2 == 0, "true").otherwise("false"), ',"owner":{"login":"o"}},"sender":{"id":', u, ',"login":"u', u, '","type":"', sender, '"}',
        F.when(n % 50 == 0, "").otherwise(',"installation":{"id":9}'), F.when(n % 3 == 0, suite).otherwise(pull), "}",
    )
    return t(spark, d, "events").select(s("d", n).alias("delivery_id"), F.when(n % 3 == 0, "check_suite").otherwise("pull_request").alias("event"), F.lit("t0").alias("tenant_id"), body.alias("body"))


def hub(spark, d) -> DataFrame:
    return github.channel().events(deliveries(spark, d), "demo")


def q_targets(spark, d) -> DataFrame:
    odd = F.regexp_replace("reply_target", '"repositoryId":(\\d)', '"repositoryId":-$1')
    df = hub(spark, d).select(F.explode(F.array("reply_target", odd, F.lit("{}"), F.regexp_replace("reply_target", '"owner":"o"', '"owner":null'))).alias("target"))
    return df.groupBy(github.check_target(F.col("target")).alias("good")).agg(F.count("*").alias("n"))


def lives(spark, d, stale: bool = False) -> DataFrame:
    """The queue of wakes after sweeps at a wake's own due times; the last digit of its key tells what its receiver does."""
    rows = stored(queue(run_rows(spark, d, [ERRORS])), "queue")
    digit = F.conv(F.substring("wake_key", -1, 1), 16, 10).cast("int")
    for _ in range(TIMES):
        now = F.col("retry_ms")
        rows = claim(rows, now, FEW)
        error = F.when((digit >= 4) & (digit <= 7) & (F.col("failures") < digit - 3), "timeout").when(digit.isin(8, 9), "capacity").when(digit >= 12, "unreachable")
        ok = error.isNull()
        results = rows.where("claimed").select(
            "wake_key", (F.col("lease_ms") - (1 if stale else 0)).alias("lease_ms"), error.alias("error"), F.when(ok & (digit != 11), F.col("wake_key")).alias("receipt_key"),
            F.when(ok, F.when(digit == 10, "other").otherwise(F.col("input_hash"))).alias("receipt_hash"), F.when(ok, now + 5).alias("receipt_ms"),
        )
        rows = stored(settle(rows, results, now, FEW), "queue")
    return rows


def q_owner(spark, d) -> DataFrame:
    one, other = F.lit(app([ERRORS]).config_key()), F.lit(OTHER)
    df = branches(spark, d, [ERRORS]).select("instance_key").distinct()
    return df.select("instance_key", owner_key(one, F.col("instance_key")).alias("owner"), owner_key(other, F.col("instance_key")).alias("other"))


ONE, OTHER = (config_key("demo", {"events": 1}, [ERRORS], ["ops"], limits) for limits in (Limits(), Limits(recent_events=7)))


def q_keys(spark, d) -> DataFrame:
    k = F.col("event_key")
    odd = {"same": k, "upper": F.upper(k), "short": F.substring(k, 1, 70), "version": F.regexp_replace(k, ":v1:", ":v2:"), "kind": F.regexp_replace(k, ":event:", ":run:"), "line": F.concat(k, F.lit("\n")), "null": F.lit(None).cast("string")}
    df = events(spark, d).select(F.explode(F.array(*[F.struct(F.lit(n).alias("form"), c.alias("k")) for n, c in odd.items()])).alias("x")).select("x.*")
    return df.groupBy("form").agg(F.count(F.when(F.coalesce(is_key(F.col("k"), "event"), F.lit(False)), 1)).alias("good"), F.count("*").alias("n"))


def q_lineage(spark, d) -> DataFrame:
    df = events(spark, d).select("event_key", F.col("id").cast("bigint").alias("n"), "occurrence_key")
    k, none = F.col("event_key"), F.array().cast("array<string>")
    parents = F.when(F.col("n") % 3 == 0, F.array(k, F.col("occurrence_key"))).otherwise(F.array("occurrence_key"))
    roots = F.when(F.col("n") % 5 == 0, none).when(F.col("n") % 5 == 1, F.array(k, k)).otherwise(F.array(k))
    return df.select(lineage_fault(k, parents, roots).alias("fault")).groupBy("fault").agg(F.count("*").alias("n"))


def q_canonical(spark, d) -> DataFrame:
    """Retries of all events, some with a changed value; changed ones, of which some are as before and some have another id."""
    e = t(spark, d, "events")
    value = lambda cond, by=1: F.when(F.expr(cond), F.col("value") + by).otherwise(F.col("value"))
    same = e.unionByName(e.withColumn("value", value("event_id % 11 = 0")))
    other = e.withColumn("value", value("event_id % 7 > 0", 2)).withColumn("event_id", F.when(F.col("event_id") % 13 == 0, -F.col("event_id") - 1).otherwise(F.col("event_id")))
    return canonicalization_faults(events_channel(), same, other).groupBy("fault").agg(F.count("*").alias("n"))


def q_handoff(spark, d, appends: bool) -> DataFrame:
    sent = branches(spark, d, FANNED)
    got = sent.withColumn("order_key", F.when((F.col("type") == "error") & (F.col("monitor_id") == "errors"), F.concat("order_key", F.lit("x"))).otherwise(F.col("order_key")))
    if appends:
        got = sent.where("not (monitor_id = 'large' and cast(id as bigint) % 2 = 0)").withColumn("instance_key", F.when(F.col("monitor_id") == "sales", F.concat("instance_key", F.lit("0"))).otherwise(F.col("instance_key")))
    return verify_handoff(got, stream_appends(sent) if appends else None).groupBy("fault").agg(F.count("*").alias("n"))


def q_times(spark, d) -> DataFrame:
    at = iso(to_ms(F.col("ts")))
    forms = F.array(at, F.substring(at, 1, 19), F.concat(F.substring(at, 1, 19), F.lit("Z")), F.regexp_replace(at, "Z$", "+00:00"), F.regexp_replace(at, "-\\d\\dT", "-31T"))
    return t(spark, d, "events").select("event_id", add_ms(at, 86_400_001).alias("later"), F.array_join(F.transform(forms, lambda x: is_iso(x).cast("string")), ",").alias("canonical"))


QUERIES = {
    "github_events": lambda s, d: hub(s, d).select("id", "type", iso(F.col("occurred_ms")).alias("occurred_at"), "partition_key", "installation_id", "data", "actor", "subjects", "event_key"),
    "github_targets": lambda s, d: hub(s, d).select("id", "reply_target"),
    "github_target_checks": q_targets,
    "github_rejects": lambda s, d: github.channel().rejects(deliveries(s, d), "demo").select("id", "issues"),
    "delivery_life": lambda s, d: lives(s, d).select("wake_key", "status", "failures", F.coalesce("delivered_ms", F.lit(-1)).alias("delivered_ms"), "retry_ms", "reason"),
    "delivery_stale": lambda s, d: lives(s, d, stale=True).groupBy("status", "failures").agg(F.count("*").alias("n"), F.count("lease_ms").alias("leased")),
    "redelivery_bytes": lambda s, d: lives(s, d).where("failures > 0").select("wake_key", F.sha2("wake", 256).alias("wake_hash"), "input_hash"),
    "config_owner": q_owner,
    "key_forms": q_keys,
    "lineage_faults": q_lineage,
    "canonicalization_faults": q_canonical,
    "handoff_faults": lambda s, d: q_handoff(s, d, False),
    "append_faults": lambda s, d: q_handoff(s, d, True),
    "iso_times": q_times,
    "session_requests": lambda s, d: requests(run_rows(s, d, [ERRORS]), "concat('room:', correlation_key)", "concat('{\"batch\":\"', batch_key, '\"}')", "'bot'"),
}


# -- SQL for the same rows

_AT = "strftime(make_timestamp((epoch_us(ts) // 1000000) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z')"
_HUB = f"""h0 AS (SELECT event_id AS n, user_id AS u, {_AT} AS happened, event_id % 3 = 0 AS suite, unnest(CASE WHEN event_id % 3 > 0 THEN [user_id + 1] ELSE range(user_id + 1, user_id + 1 + event_id % 4) END) AS pull FROM events),
hub AS (SELECT *, 'd' || n || CASE WHEN suite THEN ':pull:' || pull ELSE '' END AS id, CASE WHEN n % 5 = 0 THEN '2024-01-01T00:00:00.000Z' ELSE happened END AS occurred_at, 'o/r' || u AS full_name,
  '{{"fullName":"o/r' || u || '","id":' || (u + 7) || ',"name":"r' || u || '","owner":"o","private":' || CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END || '}}' AS repo FROM h0)"""
_GOOD = "n % 50 > 0"
_DIGIT = "(strpos('0123456789abcdef', right(wake_key, 1)) - 1)"
_LIFE = f"""{_ERR} {_WAKES}, life AS (SELECT *, {_DIGIT} AS g, CASE WHEN g BETWEEN 4 AND 7 THEN least(g - 3, 3) WHEN g >= 12 THEN 3 WHEN g >= 8 THEN 1 ELSE 0 END AS failures,
  CASE WHEN g <= 5 THEN 'delivered' ELSE CASE WHEN g = 6 OR g = 7 OR g >= 8 THEN 'terminal' END END AS status FROM w)"""


_OWNER = "'vg:owner:v1:' || sha256('[\"vg:owner:v1\",\"' || '{}' || '\",\"' || instance_key || '\"]')"

ORACLES = {
    "github_events": f"""WITH {_HUB} SELECT id, CASE WHEN suite THEN 'github.check-suite' ELSE 'github.pull-request' END AS type, occurred_at, 'repository:' || (u + 7) || ':pull-request:' || pull AS partition_key, '9' AS installation_id,
  CASE WHEN suite THEN '{{"action":"done","appSlug":"ci","checkSuiteId":' || n || ',"conclusion":null,"headSha":"h' || n || '","pullRequestNumber":' || pull || ',"repository":' || repo || ',"status":"completed"}}'
    ELSE '{{"action":"done","headSha":"s' || n || '","pullRequestNumber":' || pull || ',"repository":' || repo || '}}' END AS data,
  '{{"displayName":"u' || u || '","id":"' || u || '","isBot":' || CASE WHEN n % 4 = 1 THEN 'true' ELSE 'false' END || ',"principalType":"' || ['user', 'app', 'service', 'unknown'][n % 4 + 1] || '"}}' AS actor,
  '[{{"key":"' || full_name || '","namespace":"repository"}},{{"key":"' || full_name || '#' || pull || '","namespace":"pull-request"}}]' AS subjects, {_k('event', 1, "'t0'", "'demo'", "'github'", "'9'", 'id')} AS event_key FROM hub WHERE {_GOOD}""",
    "github_targets": f"""WITH {_HUB} SELECT id, '{{"address":"repo:' || (u + 7) || ':pull:' || pull || '","state":{{"baseRef":' || CASE WHEN suite THEN 'null' ELSE '"main"' END || ',"baseSha":' || CASE WHEN suite THEN 'null' ELSE '"b"' END
  || ',"checkoutPath":null,"conversationKind":"pull_request","defaultBranch":' || CASE WHEN suite THEN 'null' ELSE '"trunk"' END || ',"headRef":' || CASE WHEN suite THEN 'null' ELSE '"topic"' END || ',"headSha":"' || CASE WHEN suite THEN 'h' ELSE 's' END || n
  || '","installationId":9,"issueNumber":' || pull || ',"owner":"o","pullRequestNumber":' || pull || ',"repo":"r' || u || '","repositoryId":' || (u + 7) || ',"reviewCommentId":null,"reviewThreadRootCommentId":null,"triggeringCommentId":null,"triggeringUserLogin":"u' || u || '"}}}}' AS reply_target FROM hub WHERE {_GOOD}""",
    "github_target_checks": f"WITH {_HUB}, c AS (SELECT count(*) AS n FROM hub WHERE {_GOOD}) SELECT true AS good, n FROM c UNION ALL SELECT false, 3 * n FROM c",
    "github_rejects": f"WITH {_HUB} SELECT id, 'a delivery needs an installation; installation must not be blank' AS issues FROM hub WHERE NOT {_GOOD}",
    "delivery_life": f"""{_LIFE} SELECT wake_key, status, CAST(failures AS INTEGER) AS failures, CASE WHEN status = 'delivered' THEN frozen_ms + 1000 * failures + 5 ELSE -1 END AS delivered_ms,
  CASE WHEN status = 'delivered' THEN frozen_ms + 1000 * failures WHEN g BETWEEN 8 AND 11 THEN frozen_ms ELSE frozen_ms + 2000 END AS retry_ms,
  CASE WHEN status = 'terminal' THEN CASE WHEN g IN (6, 7) THEN 'timeout' WHEN g <= 9 THEN 'capacity' WHEN g = 10 THEN 'conflict' WHEN g = 11 THEN 'callback' ELSE 'unreachable' END END AS reason FROM life""",
    "delivery_stale": f"{_LIFE} SELECT 'pending' AS status, CAST(0 AS INTEGER) AS failures, count(*) AS n, count(*) AS leased FROM life HAVING count(*) > 0",
    "redelivery_bytes": f"{_LIFE} SELECT wake_key, sha256(wake) AS wake_hash, input_hash FROM life WHERE failures > 0",
    "config_owner": f"{_ERR} SELECT DISTINCT instance_key, {_OWNER.format(ONE)} AS owner, {_OWNER.format(OTHER)} AS other FROM br",
    "key_forms": f"WITH {_ev()} SELECT unnest(['same', 'upper', 'short', 'version', 'kind', 'line', 'null']) AS form, unnest([n, 0, 0, 0, 0, 0, 0]) AS good, n FROM (SELECT count(*) AS n FROM ev)",
    "lineage_faults": "SELECT CASE WHEN event_id % 5 = 0 THEN 'no root event' WHEN event_id % 5 = 1 THEN 'repeated key' WHEN event_id % 3 = 0 THEN 'its own parent' END AS fault, count(*) AS n FROM events GROUP BY 1",
    "canonicalization_faults": """SELECT fault, count(*) AS n FROM (SELECT 'a retry changed the content' AS fault FROM events WHERE event_id % 11 = 0
UNION ALL SELECT 'a change lost its key' FROM events WHERE event_id % 13 = 0 UNION ALL SELECT 'a change kept the content' FROM events WHERE event_id % 7 = 0 AND event_id % 13 > 0) GROUP BY fault""",
    "handoff_faults": _fan("SELECT 'branch hash' AS fault, count(*) AS n FROM br WHERE monitor_id = 'errors'"),
    "append_faults": _fan("SELECT 'append hash' AS fault, count(*) AS n FROM br WHERE monitor_id = 'sales'"),
    "iso_times": "SELECT event_id, strftime(make_timestamp((epoch_us(ts) // 1000 + 86400001) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS later, 'true,false,false,false,' || CASE WHEN month(ts) IN (1, 3, 5, 7, 8, 10, 12) THEN 'true' ELSE 'false' END AS canonical FROM events",
    "session_requests": f"""{_ERR} {_WAKES} SELECT wake_key, wake_key AS idempotency_key, 'queue' AS turn_policy, 'room:' || correlation_key AS address, '{{"batch":"' || batch_key || '"}}' AS state, 'bot' AS auth,
  '{{"applicationId":"demo","batchKey":"' || batch_key || '","correlationKey":"' || correlation_key || '","decision":{{"n":' || n || '}},"definitionVersion":"1","evidence":{{"trust":"untrusted","value":null}},"kind":"attention","monitorId":"' || monitor_id || '","rootEventKeys":' || CAST(to_json(ek) AS VARCHAR)
  || ',"runKey":"' || run_key || '","target":"' || correlation_key || '","task":{{"instruction":"look into these events","trust":"application"}},"tenantId":"t0","wakeKey":"' || wake_key || '"}}' AS message FROM w""",
}
