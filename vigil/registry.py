"""Registered queries of the event engine: demo channels and rules over the test tables, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.canonical import canonical_json, object_json, string_json
from .functions.identity import partition_cell_key
from .functions.scalars import iso, to_ms
from .operators.channel import Channel, conflicts
from .operators.outcomes import Decision, ignore, sequence_sql, wake
from .operators.policy import Limits, debounce, immediate
from .operators.rules import Rule, Rules, fan_out, receipts, stream_appends, verify_fanout
from .plans.app import App, Route
from .plans.batches import replay, spread
from .plans.wakes import counters, delivery_conflicts, undelivered

H = 3_600_000
Q, W, E, C = 6 * H, 24 * H, 4, 12 * H
RING = 3

def events_channel() -> Channel:
    return Channel(
        "events", 1,
        {
            "id": F.col("event_id").cast("string"), "type": F.col("event_type"), "version": F.lit(1), "occurred_ms": to_ms(F.col("ts")),
            "data": object_json({"cents": F.round(F.col("value") * 100).cast("bigint").cast("string"), "k": F.get_json_object("props", "$.k")}),
        },
        F.col("user_id").cast("string"),
    )


def turns_channel() -> Channel:
    """No time: the order key defaults to the id, so the turn is padded."""
    turn = F.lpad(F.col("turn").cast("string"), 4, "0")
    data = object_json({"chars": F.length(F.coalesce("text", F.lit(""))).cast("string")})
    return Channel("conversations", 1, {"id": F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn), "type": F.col("role"), "version": F.lit(1), "data": data}, F.col("conv_id").cast("string"))


def orders_channel() -> Channel:
    data = object_json({"cents": F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string"), "status": string_json(F.col("o_orderstatus"))})
    return Channel("orders", 1, {"id": F.col("o_orderkey").cast("string"), "type": F.lit("order.placed"), "version": F.lit(1), "occurred_ms": to_ms(F.col("o_orderdate")), "data": data}, F.col("o_custkey").cast("string"))


CHANNELS = {"events": events_channel, "conversations": turns_channel, "orders": orders_channel}
MANY = Decision("n >= 2", "look into these events", "concat('\"', correlation_key, '\"')", decision="concat('{\"n\":', n, '}')")
AFTER = Decision(sequence_sql("signup", "purchase"), "a purchase followed a signup", "'\"sales\"'")


def several(view) -> dict:
    """The Python form of a decision by size."""
    return wake("ops", "look into these events") if len(view) >= 2 else ignore()


def always(view) -> dict:
    return wake("ops", "look into this")


ERRORS = Rule("errors", "1", "events", debounce(Q, W, max_events=E), "type = 'error'", decide=MANY)
ALL = Rule("all", "1", "events", debounce(Q, W, max_events=100), decide=MANY)
LARGE = Rule("large", "1", "events", immediate(), "cast(get_json_object(data, '$.cents') as bigint) > 10000", correlation_key="type", decide=MANY)
SHADOW = Rule("clicks", "1", "events", debounce(Q, W), "type = 'click'", mode="shadow", decide=MANY)
SALES = Rule("sales", "1", "events", debounce(Q, W), "type in ('signup', 'purchase')", decide=AFTER)
FANNED = [ERRORS, LARGE, SHADOW, SALES]


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def app(rules: list[Rule], channels: tuple[str, ...] = ("events",), limits: Limits = Limits(), routes: tuple[str, ...] = ("ops",)) -> App:  # noqa: B008
    return App("demo", [CHANNELS[c]() for c in channels], rules, [Route(r) for r in routes], limits)


def events(spark, d, channel: str = "events") -> DataFrame:
    return app([ALL], ("events", "conversations", "orders")).events({channel: t(spark, d, channel)})


def branches(spark, d, rules: list[Rule]) -> DataFrame:
    return fan_out(events(spark, d), Rules(rules))


def batches(spark, d, rules: list[Rule], **kw) -> DataFrame:
    return app(rules, **kw).batches({"events": t(spark, d, "events")})


def run_rows(spark, d, rules: list[Rule], limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    return app(rules, limits=limits).runs({"events": t(spark, d, "events")})


BATCH = ("instance_key", "opened_ms", "frozen_ms", "closed_by", "n", "bytes")


def _limited(**kw) -> Rule:
    given = {"quiet": Q, "max_wait": W, "max_events": 1_000_000, "max_bytes": 1_000_000_000} | kw
    return Rule("all", "1", "events", debounce(**given), decide=MANY)


LIMITED = {
    "debounce_quiet": _limited(max_wait=365 * 24 * H), "debounce_max_wait": _limited(quiet=12 * H), "debounce_max_events": _limited(max_events=3), "debounce_max_bytes": _limited(max_bytes=3000),
    "debounce_full": _limited(max_events=4, max_bytes=4500),
}


def again(spark, d) -> DataFrame:
    """Events of which every third is delivered a second time two days later, and every ninth a third time after ten days."""
    raw = t(spark, d, "events")
    late = lambda n, days: raw.where(F.col("event_id") % n == 0).withColumn("__at", to_ms(F.col("ts")) + days * 24 * H)
    every = raw.withColumn("__at", to_ms(F.col("ts"))).unionByName(late(3, 2)).unionByName(late(9, 10))
    channel = events_channel()
    return channel.events(spread(every), "demo", F.col("__at"))


def q_ring(spark, d) -> DataFrame:
    rule = Rule("all", "1", "events", immediate(), decide=always)
    folded = replay(fan_out(again(spark, d), Rules([rule])), Rules([rule]), ["ops"], Limits(recent_events=RING))
    one = folded.select(F.explode("members.event_key").alias("event_key"), "what")
    return one.groupBy("event_key").agg(F.count(F.when(F.col("what") == "batch", 1)).alias("appended"), F.count(F.when(F.col("what") == "duplicate", 1)).alias("duplicates"))


def changed(spark, d) -> DataFrame:
    """Events, and every tenth again with another value: the same key, another content."""
    raw = t(spark, d, "events")
    return events_channel().events(raw.unionByName(raw.where("event_id % 10 = 0").withColumn("value", F.col("value") + 1)), "demo")


def q_policy_conflicts(spark, d) -> DataFrame:
    """A rule whose policy changed under its version: the first event of a stream pins it, events under another are conflicts."""
    raw = t(spark, d, "events")
    old, new = (Rule("all", "1", "events", immediate() if i else debounce(Q, W), decide=always) for i in range(2))
    ch = events_channel()
    both = fan_out(ch.events(raw.where("event_id % 2 = 0"), "demo"), Rules([old])).unionByName(fan_out(ch.events(raw.where("event_id % 2 = 1"), "demo"), Rules([new])))
    pinned = both.groupBy("instance_key").agg(F.min_by("policy_json", F.struct("accepted_ms", "event_key")).alias("pinned"))
    return both.join(pinned, "instance_key").where("policy_json <> pinned").groupBy("instance_key").agg(F.count("*").alias("n"))


def q_next_due(spark, d) -> DataFrame:
    """When each stream is due next as of 15 January: of its open batch at that time."""
    at = 1_705_276_800_000
    rows = batches(spark, d, [LIMITED["debounce_full"]])
    rows = rows.where((F.col("opened_ms") <= at) & (F.col("frozen_ms") >= at))
    return rows.select("instance_key", "opened_ms", "frozen_ms")


def q_delivery(spark, d, what: str) -> DataFrame:
    rows = run_rows(spark, d, [ERRORS]).where("status = 'deliver'")
    odd = F.conv(F.substring("wake_key", -1, 1), 16, 10).cast("int")
    done = rows.where(odd % 2 == 0).select("wake_key", F.when(odd % 4 == 0, F.col("input_hash")).otherwise("other").alias("input_hash"))
    return undelivered(rows, done).select("wake_key") if what == "new" else delivery_conflicts(rows, done).select("wake_key")


def q_diagnostics(spark, d) -> DataFrame:
    rows = batches(spark, d, [LIMITED["debounce_full"]])
    return rows.agg(F.count_distinct("instance_key").alias("streams"), F.count("*").alias("batches"), F.sum("n").alias("branches"), F.max("n").alias("largest"), F.min("opened_ms").alias("first_ms"), F.max("frozen_ms").alias("last_ms"))


def q_flagship(spark, d) -> DataFrame:
    return run_rows(spark, d, [ERRORS]).where("status = 'deliver'").select("wake_key", "run_key", "batch_key", "instance_key", "n", "closed_by", "opened_ms", "frozen_ms")


def _conversations(spark, d) -> DataFrame:
    """User, then assistant, within a conversation, in the order of turns."""
    rule = Rule("answered", "1", "conversations", debounce(Q, W), "type in ('user', 'assistant')", decide=Decision(sequence_sql("user", "assistant"), "answered", "'null'"))
    a = app([rule], ("conversations",))
    return a.batches({"conversations": t(spark, d, "conversations")}).where("kind = 'wake'").groupBy("instance_key").agg(F.sum("n").alias("n"))


QUERIES = {
    "flagship_wakes": q_flagship,
    "canonical_events": lambda s, d: events(s, d).select("id", "type", "version", iso(F.col("occurred_ms")).alias("occurred_at"), "data", "partition_key", "event_json"),
    "event_key": lambda s, d: events(s, d).select("id", "event_key"),
    "source_input_hash": lambda s, d: events(s, d).select("id", "input_hash"),
    "occurrence_key": lambda s, d: events(s, d).select("id", "occurrence_key"),
    "partition_key": lambda s, d: events(s, d).select("id", partition_cell_key(*[F.col(c) for c in ("application_id", "tenant_id", "channel_id", "installation_id", "partition_key")]).alias("cell_key")),
    "branch_key": lambda s, d: branches(s, d, FANNED).select("id", "monitor_id", "branch_key"),
    "instance_key": lambda s, d: branches(s, d, FANNED).select("id", "monitor_id", "instance_key"),
    "branch_hash": lambda s, d: branches(s, d, [ERRORS]).select("id", "branch_hash"),
    "value_bytes": lambda s, d: branches(s, d, [ERRORS]).select("id", "bytes"),
    "rejects": lambda s, d: Channel(**{**vars(events_channel()), "checks": {"value is too small": F.col("value") >= 10, "no k": F.get_json_object("props", "$.k").isNotNull()}}).rejects(t(s, d, "events").withColumn("event_type", F.when(F.col("event_id") % 50 > 0, F.col("event_type"))), "demo").select("id", "issues"),
    "matches_filter": lambda s, d: branches(s, d, [LARGE]).select("id", "correlation_key"),
    "fanout_multi_rule": lambda s, d: branches(s, d, FANNED).select("id", "monitor_id", "correlation_key", "order_key", "mode"),
    "fanout_zero_match": lambda s, d: receipts(e := events(s, d), fan_out(e, Rules(FANNED))).where("size(branch_keys) = 0").select("event_key", "streams"),
    "fanout_sorted": lambda s, d: receipts(e := events(s, d), fan_out(e, Rules(FANNED))).where("size(branch_keys) > 1").select("event_key", F.array_join("branch_keys", ",").alias("branch_keys")),
    "fanout_faults": lambda s, d: verify_fanout(branches(s, d, FANNED).withColumn("branch_key", F.when(F.col("type") == "error", F.lower(F.concat("branch_key", F.lit("x")))).otherwise(F.col("branch_key")))).groupBy("fault").agg(F.count("*").alias("n")),
    "fanout_byte_cap": lambda s, d: receipts(e := events(s, d), fan_out(e, Rules(FANNED)), Limits(max_branches=1)).where("problem is not null").select("event_key", "problem"),
    "order_key_default": lambda s, d: fan_out(events(s, d, "conversations"), Rules([Rule("turns", "1", "conversations", immediate())])).select("id", "order_key"),
    "orders_channel": lambda s, d: events(s, d, "orders").select("id", "event_key", "data", iso(F.col("occurred_ms")).alias("occurred_at")),
    "stream_appends": lambda s, d: stream_appends(branches(s, d, FANNED)).select("instance_key", "event_key", F.size("branch_keys").cast("bigint").alias("n"), "policies"),
    "receipts_max_accepted_at": lambda s, d: receipts(e := events(s, d), fan_out(e, Rules(FANNED))).groupBy("streams").agg(F.max("accepted_ms").alias("accepted_ms"), F.count("*").alias("n")),
    "immediate_batches": lambda s, d: batches(s, d, [LARGE]).select(*BATCH, "batch_key"),
    **{name: (lambda s, d, r=r: batches(s, d, [r]).select(*BATCH)) for name, r in LIMITED.items()},
    "batch_membership_ordered": lambda s, d: batches(s, d, [ERRORS]).select("instance_key", "opened_ms", F.array_join(F.transform("events", lambda e: e["id"]), ",").alias("ids")),
    "batch_key": lambda s, d: batches(s, d, [ERRORS]).select("instance_key", "opened_ms", "batch_key"),
    "run_key": lambda s, d: batches(s, d, [ERRORS]).select("batch_key", "run_key"),
    "wake_key": lambda s, d: run_rows(s, d, [ERRORS]).where("kind = 'wake'").select("run_key", "wake_key"),
    "wake_payload": lambda s, d: run_rows(s, d, [ERRORS]).where("status = 'deliver'").select("wake_key", "wake", "input_hash"),
    "closed_by_counts": lambda s, d: batches(s, d, [LIMITED["debounce_full"]]).groupBy("closed_by").agg(F.count("*").alias("n")),
    "ring_dedup": q_ring,
    "input_conflicts": lambda s, d: conflicts(changed(s, d)),
    "policy_conflicts": q_policy_conflicts,
    "decide_threshold": lambda s, d: run_rows(s, d, [ERRORS]).select("run_key", "kind", "decision"),
    "decide_sequence_a_then_b": lambda s, d: run_rows(s, d, [SALES]).where("kind = 'wake'").select("instance_key", "opened_ms", "n"),
    "sequence_conversations": _conversations,
    "shadow_vs_active": lambda s, d: run_rows(s, d, [SHADOW, ERRORS]).groupBy("monitor_id", "status").agg(F.count("*").alias("n")),
    "cooldown_batches": lambda s, d: batches(s, d, [Rule("all", "1", "events", debounce(Q, W, cooldown=C, max_events=1_000_000, max_bytes=1_000_000_000), decide=several)]).select(*BATCH, "kind"),
    "cooldown_immediate": lambda s, d: batches(s, d, [Rule("all", "1", "events", immediate(C), decide=always)]).select(*BATCH),
    "wake_size_cap": lambda s, d: run_rows(s, d, [ERRORS], Limits(max_wake_bytes=1400)).groupBy("status").agg(F.count("*").alias("n")),
    "direct_dispatch": lambda s, d: app([ERRORS]).direct({"events": t(s, d, "events")}, "type = 'purchase'", "g1").select("event_key", "direct_key"),
    "delivery_dedup": lambda s, d: q_delivery(s, d, "new"),
    "delivery_conflicts": lambda s, d: q_delivery(s, d, "conflicts"),
    "run_counters": lambda s, d: counters(run_rows(s, d, [ERRORS, SHADOW])),
    "diagnostics": q_diagnostics,
    "next_due_at": q_next_due,
}


# -- SQL for the same rows

def _k(kind: str, version: int, *parts: str) -> str:
    d = f"vg:{kind}:v{version}"
    return f"'{d}:' || sha256(CAST(to_json(['{d}', {', '.join(parts)}]) AS VARCHAR))"


def _hash(json_text: str) -> str:
    return f"""'vg:input:v1:' || sha256('["vg:input:v1",' || ({json_text}) || ']')"""


def _ev(source: str = "SELECT *, (epoch_us(ts) // 1000) AS acc FROM events") -> str:
    return f"""src AS ({source}),
raw AS (SELECT CAST(event_id AS VARCHAR) AS id, event_type AS type, CAST(user_id AS VARCHAR) AS pk, (epoch_us(ts) // 1000) AS t, acc, CAST(round(value * 100) AS BIGINT) AS cents,
  strftime(make_timestamp((epoch_us(ts) // 1000) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso_at,
  '{{"cents":' || CAST(round(value * 100) AS BIGINT) || ',"k":' || json_extract_string(props, '$.k') || '}}' AS data FROM src),
shaped AS (SELECT *, '{{"data":' || data || ',"id":"' || id || '","occurredAt":"' || iso_at || '","origin":{{"depth":0,"kind":"external"}},"source":{{"channelId":"events","installationId":"i0","tenantId":"t0"}},"type":"' || type || '","version":1}}' AS event_json FROM raw),
hashed AS (SELECT *, {_k('event', 1, "'t0'", "'demo'", "'events'", "'i0'", 'id')} AS event_key,
  {_hash("'" + '{"applicationId":"demo","canonicalizationVersion":1,"event":' + "' || event_json || '" + ',"partitionKey":"' + "' || pk || '" + '"}' + "'")} AS input_hash FROM shaped),
ev AS (SELECT *, {_k('occurrence', 1, 'event_key', 'input_hash')} AS occurrence_key, {_k('partition', 1, "'demo'", "'t0'", "'events'", "'i0'", 'pk')} AS cell_key FROM hashed)"""


def _policy(rule: Rule) -> str:
    return canonical_json(rule.policy.value())


def _br(rules: list[Rule], where: dict[str, str] | None = None, corr: dict[str, str] | None = None, source: str = "ev", name: str = "br") -> str:
    """Branches of rules; predicates and correlation keys in DuckDB's SQL where they differ."""
    where, corr, parts = where or {}, corr or {}, []
    for r in rules:
        c = corr.get(r.id, "'default'")
        parts.append(f"SELECT *, '{r.id}' AS monitor_id, {c} AS correlation_key, iso_at AS order_key, '{r.mode}' AS mode, '{_policy(r)}' AS policy FROM {source} WHERE {where.get(r.id, r.matches)}")
    keyed_sql = f"""SELECT *, {_k('branch', 2, 'occurrence_key', 'monitor_id', "'1'", 'NULL', 'correlation_key')} AS branch_key, {_k('instance', 3, 'cell_key', 'monitor_id', "'1'", 'correlation_key')} AS instance_key FROM ({' UNION ALL '.join(parts)})"""
    head = """'{"applicationId":"demo",' || x || '"canonicalizationVersion":1,"correlationKey":"' || correlation_key || '","definitionVersion":"1","event":' || event_json || ',"eventKey":"' || event_key || '",' || y || '"mode":"' || mode || '","monitorId":"' || monitor_id || '","occurrenceKey":"' || occurrence_key || '","orderKey":"' || order_key || '","partitionKey":"' || pk || '","policy":' || policy || ',"sourceInputHash":"' || input_hash || '","tenantId":"t0"}'"""
    text = lambda x, y: head.replace("|| x ||", f"|| {x} ||").replace("|| y ||", f"|| {y} ||")
    key, own = "'\"branchKey\":\"' || branch_key || '\",'", "'\"inputHash\":\"' || branch_hash || '\",'"
    return f"""{name}_k AS ({keyed_sql}), {name}_h AS (SELECT *, {_hash(text("''", "''"))} AS branch_hash FROM {name}_k),
{name} AS (SELECT *, strlen({text(key, own)}) AS bytes FROM {name}_h)"""


ORDER = "ORDER BY order_key, event_key, branch_key"


def _fold(quiet: int, wait: int, most: int, most_bytes: int, branch: str = "br") -> str:
    due = f"least(updated + {quiet}, opened + {wait})"
    return f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY instance_key ORDER BY acc, event_key) AS rn FROM {branch}),
f AS (SELECT instance_key, rn, acc AS opened, acc AS updated, 1 AS n, bytes AS total, 1 AS batch FROM numbered WHERE rn = 1
  UNION ALL SELECT instance_key, rn, CASE WHEN cut THEN acc ELSE opened END, acc, CASE WHEN cut THEN 1 ELSE n + 1 END, CASE WHEN cut THEN bytes ELSE total + bytes END, CASE WHEN cut THEN batch + 1 ELSE batch END
  FROM (SELECT r.instance_key, r.rn, r.acc, r.bytes, f.opened, f.n, f.total, f.batch, r.acc > {due.replace('updated', 'f.updated').replace('opened', 'f.opened')} OR f.n >= {most} OR f.total + r.bytes > {most_bytes} AS cut
    FROM f JOIN numbered r ON r.instance_key = f.instance_key AND r.rn = f.rn + 1)),
g AS (SELECT instance_key, batch, min(r.acc) AS opened_ms, max(r.acc) AS updated_ms, count(*) AS n, CAST(sum(r.bytes) AS BIGINT) AS bytes, any_value(monitor_id) AS monitor_id, any_value(correlation_key) AS correlation_key, any_value(mode) AS mode,
    list(branch_key {ORDER}) AS bk, list(event_key {ORDER}) AS ek, list(id {ORDER}) AS ids, list(type {ORDER}) AS types FROM numbered r JOIN f USING (instance_key, rn) GROUP BY instance_key, batch),
h AS (SELECT *, lead(opened_ms) OVER (PARTITION BY instance_key ORDER BY batch) AS nxt, least(updated_ms + {quiet}, opened_ms + {wait}) AS due FROM g),
b0 AS (SELECT *, CASE WHEN nxt <= due THEN nxt ELSE due END AS frozen_ms, CASE WHEN nxt <= due THEN CASE WHEN n >= {most} THEN 'max-events' ELSE 'max-bytes' END WHEN opened_ms + {wait} <= updated_ms + {quiet} THEN 'max-wait' ELSE 'quiet-period' END AS closed_by FROM h),
{_KEYS}"""


_KEYS = f"""b1 AS (SELECT *, 'vg:batch:v2:' || sha256('["vg:batch:v2","' || instance_key || '",' || CAST(to_json(bk) AS VARCHAR) || ']') AS batch_key FROM b0),
b2 AS (SELECT *, {_k('run', 2, 'batch_key', "'primary'")} AS run_key FROM b1),
batches AS (SELECT *, {_k('wake', 2, 'run_key', "'ops'")} AS wake_key, CASE WHEN n >= 2 THEN 'wake' ELSE 'ignore' END AS kind FROM b2)"""

_WHERE = {"large": "cents > 10000"}
_CORR = {"large": "type"}
_COLS = ", ".join(BATCH)


def _of(rule: Rule) -> str:
    p = rule.policy
    return f"WITH RECURSIVE {_ev()}, {_br([rule])}, {_fold(p.quiet_ms, p.max_wait_ms, p.max_events, p.max_bytes)}"


def _fan(select: str) -> str:
    return f"WITH {_ev()}, {_br(FANNED, _WHERE, _CORR)} {select}"


_ERR, _FULL, _SHD = _of(ERRORS), _of(LIMITED["debounce_full"]), _of(SHADOW)
_BODY = """'"applicationId":"demo","batchKey":"' || batch_key || '","correlationKey":"' || correlation_key || '","decision":{"n":' || n || '},"definitionVersion":"1","evidence":null,' || x || '"instanceKey":"' || instance_key || '","instruction":"look into these events","monitorId":"' || monitor_id || '","rootEventKeys":' || CAST(to_json(ek) AS VARCHAR) || ',"routeId":"ops","runKey":"' || run_key || '","target":"' || correlation_key || '","tenantId":"t0"' || y || '}'"""
_WAKES = f""", w0 AS (SELECT *, {_hash("'{' || " + _BODY.replace('|| x ||', '||').replace("|| y ||", "||"))} AS input_hash FROM batches WHERE kind = 'wake'),
w AS (SELECT *, '{{' || {_BODY.replace('|| x ||', "|| '\"inputHash\":\"' || input_hash || '\",' ||").replace("|| y ||", "|| ',\"wakeKey\":\"' || wake_key || '\"' ||")} AS wake FROM w0)"""
_LAST = "CAST(strpos('0123456789abcdef', right(wake_key, 1)) - 1 AS INTEGER)"
_AGAIN = f"""SELECT *, (epoch_us(ts) // 1000) AS acc FROM events UNION ALL SELECT *, (epoch_us(ts) // 1000) + {2 * 24 * H} FROM events WHERE event_id % 3 = 0 UNION ALL SELECT *, (epoch_us(ts) // 1000) + {10 * 24 * H} FROM events WHERE event_id % 9 = 0"""
_IMM = Rule("all", "1", "events", immediate())
_COOL = Rule("all", "1", "events", debounce(Q, W, cooldown=C, max_events=1_000_000, max_bytes=1_000_000_000))
_COOLED = f"greatest(least(updated + {Q}, opened + {W}), coalesce(cd, 0))"
_TURN = "conv_id || ':' || lpad(CAST(turn AS VARCHAR), 4, '0')"
_SALES_TYPES = "list_position(types, 'signup') > 0 AND list_contains(list_slice(types, CAST(list_position(types, 'signup') AS BIGINT) + 1, len(types)), 'purchase')"

ORACLES = {
    "flagship_wakes": f"{_ERR} SELECT wake_key, run_key, batch_key, instance_key, n, closed_by, opened_ms, frozen_ms FROM batches WHERE kind = 'wake'",
    "canonical_events": f"WITH {_ev()} SELECT id, type, CAST(1 AS BIGINT) AS version, iso_at AS occurred_at, data, pk AS partition_key, event_json FROM ev",
    "event_key": f"WITH {_ev()} SELECT id, event_key FROM ev",
    "source_input_hash": f"WITH {_ev()} SELECT id, input_hash FROM ev",
    "occurrence_key": f"WITH {_ev()} SELECT id, occurrence_key FROM ev",
    "partition_key": f"WITH {_ev()} SELECT id, cell_key FROM ev",
    "branch_key": _fan("SELECT id, monitor_id, branch_key FROM br"),
    "instance_key": _fan("SELECT id, monitor_id, instance_key FROM br"),
    "branch_hash": f"WITH {_ev()}, {_br([ERRORS])} SELECT id, branch_hash FROM br",
    "value_bytes": f"WITH {_ev()}, {_br([ERRORS])} SELECT id, bytes FROM br",
    "rejects": """SELECT CAST(event_id AS VARCHAR) AS id, concat_ws('; ', CASE WHEN NOT coalesce(value >= 10, false) THEN 'value is too small' END, CASE WHEN json_extract(props, '$.k') IS NULL THEN 'no k' END,
  CASE WHEN event_id % 50 = 0 THEN 'type must not be blank' END) AS issues FROM events WHERE NOT coalesce(value >= 10, false) OR json_extract(props, '$.k') IS NULL OR event_id % 50 = 0""",
    "matches_filter": f"WITH {_ev()}, {_br([LARGE], _WHERE, _CORR)} SELECT id, correlation_key FROM br",
    "fanout_multi_rule": _fan("SELECT id, monitor_id, correlation_key, order_key, mode FROM br"),
    "fanout_zero_match": _fan("SELECT event_key, CAST(0 AS BIGINT) AS streams FROM ev WHERE event_key NOT IN (SELECT event_key FROM br)"),
    "fanout_sorted": _fan("SELECT event_key, string_agg(branch_key, ',' ORDER BY branch_key) AS branch_keys FROM br GROUP BY event_key HAVING count(*) > 1"),
    "fanout_faults": _fan("SELECT 'branch key' AS fault, count(*) AS n FROM br WHERE type = 'error'"),
    "fanout_byte_cap": _fan("SELECT event_key, 'too many branches' AS problem FROM br GROUP BY event_key HAVING count(*) > 1"),
    "order_key_default": f"SELECT {_TURN} AS id, {_TURN} AS order_key FROM conversations",
    "orders_channel": f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, {_k('event', 1, "'t0'", "'demo'", "'orders'", "'i0'", 'CAST(o_orderkey AS VARCHAR)')} AS event_key,
  '{{"cents":' || CAST(round(o_totalprice * 100) AS BIGINT) || ',"status":"' || o_orderstatus || '"}}' AS data, strftime(make_timestamp((epoch_us(o_orderdate) // 1000) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS occurred_at FROM orders""",
    "stream_appends": _fan("SELECT instance_key, event_key, count(*) AS n, count(DISTINCT policy) AS policies FROM br GROUP BY ALL"),
    "receipts_max_accepted_at": _fan("SELECT streams, max(acc) AS accepted_ms, count(*) AS n FROM (SELECT ev.event_key, any_value(ev.acc) AS acc, count(DISTINCT br.instance_key) AS streams FROM ev LEFT JOIN br ON ev.event_key = br.event_key GROUP BY ev.event_key) GROUP BY streams"),
    "immediate_batches": f"""WITH {_ev()}, {_br([LARGE], _WHERE, _CORR)}, b0 AS (SELECT *, [branch_key] AS bk, 1 AS n, acc AS opened_ms, acc AS frozen_ms, 'immediate' AS closed_by FROM br), {_KEYS}
SELECT instance_key, opened_ms, frozen_ms, closed_by, CAST(n AS BIGINT) AS n, bytes, batch_key FROM batches""",
    **{name: f"{_of(r)} SELECT {_COLS} FROM batches" for name, r in LIMITED.items()},
    "batch_membership_ordered": f"{_ERR} SELECT instance_key, opened_ms, array_to_string(ids, ',') AS ids FROM batches",
    "batch_key": f"{_ERR} SELECT instance_key, opened_ms, batch_key FROM batches",
    "run_key": f"{_ERR} SELECT batch_key, run_key FROM batches",
    "wake_key": f"{_ERR} SELECT run_key, wake_key FROM batches WHERE kind = 'wake'",
    "wake_payload": f"{_ERR} {_WAKES} SELECT wake_key, wake, input_hash FROM w",
    "closed_by_counts": f"{_FULL} SELECT closed_by, count(*) AS n FROM batches GROUP BY closed_by",
    "ring_dedup": f"""WITH RECURSIVE {_ev(_AGAIN)}, numbered AS (SELECT pk, event_key, row_number() OVER (PARTITION BY pk ORDER BY acc, event_key) AS rn FROM ev),
f AS (SELECT pk, rn, event_key, [event_key] AS ring, false AS dup FROM numbered WHERE rn = 1 UNION ALL
  SELECT r.pk, r.rn, r.event_key, CASE WHEN list_contains(f.ring, r.event_key) THEN f.ring ELSE list_append(f.ring, r.event_key)[-{RING}:] END, list_contains(f.ring, r.event_key) FROM f JOIN numbered r ON r.pk = f.pk AND r.rn = f.rn + 1)
SELECT event_key, count(*) FILTER (NOT dup) AS appended, count(*) FILTER (dup) AS duplicates FROM f GROUP BY event_key""",
    "input_conflicts": f"""WITH {_ev("SELECT *, (epoch_us(ts) // 1000) AS acc FROM events UNION ALL SELECT * REPLACE (value + 1 AS value), (epoch_us(ts) // 1000) FROM events WHERE event_id % 10 = 0")}
SELECT event_key, count(DISTINCT input_hash) AS contents FROM ev GROUP BY event_key HAVING count(DISTINCT input_hash) > 1""",
    "policy_conflicts": f"""WITH {_ev()}, {_br([_IMM])}, p AS (SELECT instance_key, CAST(id AS BIGINT) % 2 AS odd, first_value(CAST(id AS BIGINT) % 2) OVER (PARTITION BY instance_key ORDER BY acc, event_key) AS pinned FROM br)
SELECT instance_key, count(*) AS n FROM p WHERE odd <> pinned GROUP BY instance_key""",
    "decide_threshold": f"{_ERR} SELECT run_key, kind, '{{\"n\":' || n || '}}' AS decision FROM batches",
    "decide_sequence_a_then_b": f"{_of(SALES)} SELECT instance_key, opened_ms, n FROM batches WHERE {_SALES_TYPES}",
    "sequence_conversations": f"""WITH c AS (SELECT *, {_k('partition', 1, "'demo'", "'t0'", "'conversations'", "'i0'", 'CAST(conv_id AS VARCHAR)')} AS cell_key FROM conversations WHERE role IN ('user', 'assistant'))
SELECT {_k('instance', 3, 'cell_key', "'answered'", "'1'", "'default'")} AS instance_key, count(*) AS n FROM c GROUP BY cell_key HAVING min(turn) FILTER (role = 'user') < max(turn) FILTER (role = 'assistant')""",
    "shadow_vs_active": f"""SELECT 'errors' AS monitor_id, CASE kind WHEN 'wake' THEN 'deliver' ELSE 'ignored' END AS status, count(*) AS n FROM ({_ERR} SELECT kind FROM batches) GROUP BY ALL
UNION ALL SELECT 'clicks', CASE kind WHEN 'wake' THEN 'shadowed' ELSE 'ignored' END, count(*) FROM ({_SHD} SELECT kind FROM batches) GROUP BY ALL""",
    "cooldown_batches": f"""WITH RECURSIVE {_ev()}, {_br([_COOL])}, numbered AS (SELECT *, row_number() OVER (PARTITION BY instance_key ORDER BY acc, event_key) AS rn FROM br),
f AS (SELECT instance_key, rn, acc AS opened, acc AS updated, 1 AS n, 1 AS batch, CAST(NULL AS BIGINT) AS cd FROM numbered WHERE rn = 1 UNION ALL
  SELECT instance_key, rn, CASE WHEN cut THEN acc ELSE opened END, acc, CASE WHEN cut THEN 1 ELSE n + 1 END, CASE WHEN cut THEN batch + 1 ELSE batch END,
    CASE WHEN NOT cut THEN cd WHEN n >= 2 AND closes + {C} >= acc THEN closes + {C} END
  FROM (SELECT r.instance_key, r.rn, r.acc, f.opened, f.n, f.batch, f.cd, {_COOLED} AS closes, r.acc > {_COOLED} AS cut FROM f JOIN numbered r ON r.instance_key = f.instance_key AND r.rn = f.rn + 1)),
g AS (SELECT instance_key, batch, min(r.acc) AS opened, max(r.acc) AS updated, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, any_value(cd) AS cd FROM numbered r JOIN f USING (instance_key, rn) GROUP BY instance_key, batch)
SELECT instance_key, opened AS opened_ms, {_COOLED} AS frozen_ms, CASE WHEN cd IS NOT NULL THEN 'cooldown-expired' WHEN opened + {W} <= updated + {Q} THEN 'max-wait' ELSE 'quiet-period' END AS closed_by, n, bytes, CASE WHEN n >= 2 THEN 'wake' ELSE 'ignore' END AS kind FROM g""",
    "cooldown_immediate": f"""WITH RECURSIVE {_ev()}, {_br([Rule("all", "1", "events", immediate(C))])}, numbered AS (SELECT *, row_number() OVER (PARTITION BY instance_key ORDER BY acc, event_key) AS rn FROM br),
f AS (SELECT instance_key, rn, 1 AS batch, false AS waits, acc + {C} AS cd FROM numbered WHERE rn = 1 UNION ALL
  SELECT instance_key, rn, CASE WHEN waits AND acc < cd THEN batch ELSE batch + 1 END, acc < cd OR (waits AND acc < cd + {C}), CASE WHEN acc < cd THEN cd WHEN waits AND acc < cd + {C} THEN cd + {C} ELSE acc + {C} END
  FROM (SELECT r.instance_key, r.rn, r.acc, f.batch, f.waits, f.cd FROM f JOIN numbered r ON r.instance_key = f.instance_key AND r.rn = f.rn + 1)),
g AS (SELECT instance_key, batch, min(r.acc) AS opened, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, bool_or(waits) AS waits, max(cd) AS cd FROM numbered r JOIN f USING (instance_key, rn) GROUP BY instance_key, batch)
SELECT instance_key, opened AS opened_ms, CASE WHEN waits THEN cd ELSE opened END AS frozen_ms, CASE WHEN waits THEN 'cooldown-expired' ELSE 'immediate' END AS closed_by, n, bytes FROM g""",
    "wake_size_cap": f"""{_ERR} {_WAKES} SELECT status, count(*) AS n FROM (SELECT CASE WHEN strlen(wake) > 1400 THEN 'terminal' ELSE 'deliver' END AS status FROM w UNION ALL SELECT 'ignored' FROM batches WHERE kind = 'ignore') GROUP BY status""",
    "direct_dispatch": f"WITH {_ev()} SELECT event_key, {_k('direct-dispatch', 2, 'occurrence_key', chr(39) + 'g1' + chr(39))} AS direct_key FROM ev WHERE type = 'purchase'",
    "delivery_dedup": f"{_ERR} SELECT wake_key FROM batches WHERE kind = 'wake' AND {_LAST} % 2 = 1",
    "delivery_conflicts": f"{_ERR} SELECT wake_key FROM batches WHERE kind = 'wake' AND {_LAST} % 4 = 2",
    "run_counters": f"""SELECT status, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE kind WHEN 'wake' THEN 'deliver' ELSE 'ignored' END AS status, count(*) AS n FROM ({_ERR} SELECT kind FROM batches) GROUP BY ALL
UNION ALL SELECT CASE kind WHEN 'wake' THEN 'shadowed' ELSE 'ignored' END, count(*) FROM ({_SHD} SELECT kind FROM batches) GROUP BY ALL) GROUP BY status""",
    "diagnostics": f"{_FULL} SELECT count(DISTINCT instance_key) AS streams, count(*) AS batches, CAST(sum(n) AS BIGINT) AS branches, max(n) AS largest, min(opened_ms) AS first_ms, max(frozen_ms) AS last_ms FROM batches",
    "next_due_at": f"{_FULL} SELECT instance_key, opened_ms, frozen_ms FROM batches WHERE opened_ms <= 1705276800000 AND frozen_ms >= 1705276800000",
}
