"""The streaming runner against bounded replay, and its sink."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from vigil import registry as R
from vigil.functions.identity import ConflictError
from vigil.operators.mailbox import Mailbox
from vigil.operators.policy import Limits, debounce, immediate
from vigil.operators.rules import Rule, Rules, fan_out
from vigil.plans.batches import replay
from vigil.streaming import runner

DIR = "/root/testdata/sf0.001/events.parquet"
COLUMNS = ("instance_key", "what", "opened_ms", "frozen_ms", "closed_by", "bytes", "kind")
SLOW = Rule("slow", "1", "events", debounce(R.Q, R.W, cooldown=R.C, max_events=3), decide=R.several)
NOW = Rule("now", "1", "events", immediate(), "type = 'error'", decide=R.MANY)


def as_stream(spark, parts, tmp_path):
    """Frames as the files of a source that gives one at each trigger."""
    folder = tmp_path / "in"
    folder.mkdir()
    for i, df in enumerate(parts):
        df.coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        (part,) = [f for f in os.listdir(tmp_path / f"p{i}") if f.endswith(".parquet")]
        shutil.copy(tmp_path / f"p{i}" / part, folder / f"{i}.parquet")
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(df, tmp_path, sink=None):
    w = df.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True)
    q = (w.foreachBatch(sink) if sink else w.format("memory").queryName("streamed")).start()
    q.awaitTermination(240)
    assert not q.isActive and q.exception() is None


@pytest.fixture(scope="module")
def parts(spark):
    """Three triggers: the first events with retries and changed retries among them, then one long after that closes all."""
    e = spark.read.parquet(DIR).where("user_id % 9 = 0").orderBy("ts").limit(90)
    rows = e.collect()
    again = [r for i, r in enumerate(rows) if i % 10 == 0]
    changed = [r.asDict() | {"value": r.value + 1} for i, r in enumerate(rows) if i % 15 == 5]
    late = rows[-1].asDict() | {"event_id": 10**6, "user_id": 10**6, "ts": rows[-1].ts.replace(year=rows[-1].ts.year + 5)}
    make = lambda x: spark.createDataFrame(x, e.schema)
    return [make(rows[:45]), make(rows[45:] + again), make([tuple(c[k] for k in e.columns) for c in changed]), make([tuple(late[k] for k in e.columns)])]


def test_streams_equal_replay(spark, parts, tmp_path):
    rules = Rules([SLOW, NOW])
    a = R.app([SLOW, NOW])
    streamed = runner.stream_batches(fan_out(a.events({"events": as_stream(spark, parts[:1] + parts[3:], tmp_path)}), rules), rules, ["ops"])
    run(streamed.select(*COLUMNS), tmp_path)
    got = sorted(map(tuple, spark.table("streamed").collect()), key=str)
    whole = parts[0].unionByName(parts[3])
    last = 10**6
    want = replay(fan_out(a.events({"events": whole.where(f"user_id < {last}")}), rules), rules, ["ops"]).select(*COLUMNS)
    own = fan_out(a.events({"events": parts[3]}), rules).select("instance_key").distinct()
    alone = {r[0] for r in own.collect()}
    assert [g for g in got if g[0] not in alone] == sorted(map(tuple, want.collect()), key=str)
    assert len(got) > 20


def test_retries_and_conflicts_stand_beside_the_batches(spark, parts, tmp_path):
    rules = Rules([NOW])
    a = R.app([NOW])
    branches = fan_out(a.events({"events": as_stream(spark, parts[:3], tmp_path)}), rules)
    run(runner.stream_batches(branches, rules, ["ops"], delay="3650 days").select("what", "instance_key"), tmp_path)
    errors = lambda df: df.where("event_type = 'error'").count()
    got = {r[0]: r[1] for r in spark.table("streamed").groupBy("what").count().collect()}
    again = errors(parts[1]) + errors(parts[0]) - errors(parts[0].unionByName(parts[1]).dropDuplicates(["event_id"]))
    assert got["duplicate"] == again > 0 and got["conflict"] == errors(parts[2]) > 0


def test_a_full_mailbox_makes_rows_wait():
    """Three branches may be pending; a cooldown holds them, so that later rows wait and are accepted when it ends."""
    rule = Rule("r", "1", "events", immediate(100), decide=R.always)
    p = runner.StreamProcessor({("r", "1"): (rule.policy, rule.decider())}, ["ops"], Limits(max_pending_branches=3))
    stream = {"instance_key": "i", "application_id": "a", "tenant_id": "t", "monitor_id": "r", "definition_version": "1", "correlation_key": "c", "mode": "active"}
    row = lambda n, at: stream | {"accepted_ms": at, "event_key": f"e{n}", "branch_key": f"b{n}", "branch_hash": f"h{n}", "bytes": 10, "order_key": f"{n:03}", "policy_json": "{}", "body": "{}"}
    box, waiting, out = Mailbox("i", rule.policy, "{}active", (), "active", 48), [], []
    for n in range(9):
        r = row(n, 1000 + n)
        out += p._until(box, stream, waiting, r["accepted_ms"])
        if waiting or not p._fits(box, r):
            waiting.append(r)
        else:
            out += p._append(box, stream, r, r["accepted_ms"])
    assert len(waiting) == 5 and json.loads(json.dumps(waiting)) == waiting
    out += p._until(box, stream, waiting, 10_000)
    sizes = [(r["frozen_ms"], len(r["members"])) for r in out]
    assert sizes == [(1000, 1), (1100, 3), (1200, 3), (1300, 2)] and not waiting
    assert [m["event_key"] for r in out for m in r["members"]] == [f"e{n}" for n in range(9)]
    with pytest.raises(ConflictError):
        box.append("e8", "other", [], 10_001)


def test_wake_table(spark, tmp_path):
    path, seen = str(tmp_path / "table"), []
    sink = runner.wake_table(path, lambda df: seen.append(sorted(r.wake_key for r in df.collect())), buckets=4)
    frame = lambda *rows: spark.createDataFrame([(k, h, "ops", f"{k}{h}", s) for k, h, s in rows], "wake_key string, input_hash string, route_id string, wake string, status string")
    one = frame(("a", "1", "deliver"), ("b", "1", "deliver"), ("b", "1", "deliver"), ("c", "1", "ignored"))
    two = frame(("a", "1", "deliver"), ("b", "2", "deliver"), ("d", "2", "deliver"), ("d", "1", "deliver"), ("e", "1", "deliver"))
    for n, df in ((0, one), (1, two), (1, two), (2, frame(("c", "1", "ignored"))), (3, two)):
        sink(df, n)
    assert seen == [["a", "b"], ["d", "e"], ["d", "e"]]
    table = spark.read.parquet(f"{path}/wakes")
    assert sorted((r.wake_key, r.input_hash, r.trigger) for r in table.collect()) == [("a", "1", 0), ("b", "1", 0), ("d", "1", 1), ("e", "1", 1)]
    odd = sorted((r.trigger, r.wake_key, r.existing, r.received) for r in spark.read.parquet(f"{path}/conflicts").collect())
    assert odd == [(1, "b", "1", "2"), (1, "d", "1", "2"), (3, "b", "1", "2"), (3, "d", "1", "2")]


def test_wakes_of_a_stream_reach_the_sink(spark, parts, tmp_path):
    a = R.app([R.ALL, NOW])
    path = str(tmp_path / "table")
    run(runner.stream_runs(a, {"events": as_stream(spark, parts[:1] + parts[3:], tmp_path)}), tmp_path, runner.wake_table(path, buckets=4))
    got = {(r.wake_key, r.input_hash, r.wake) for r in spark.read.parquet(f"{path}/wakes").collect()} if os.path.exists(f"{path}/wakes") else set()
    want = a.runs({"events": parts[0]}).where("status = 'deliver'").select("wake_key", "input_hash", "wake").collect()
    assert want and got == set(map(tuple, want)) and len(a.checkpoint("x").split("/")[1]) == 64
