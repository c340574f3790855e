"""Replay that cuts streams against the fold of whole streams."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vigil import registry as R
from vigil.operators.policy import debounce, immediate
from vigil.operators.rules import Rule, Rules, fan_out
from vigil.plans import batches
from vigil.plans.batches import ROW, Folder, replay

COLUMNS = ("instance_key", "what", "opened_ms", "frozen_ms", "closed_by", "bytes", "kind")
POLICIES = {
    "quiet": debounce(50, 400, max_events=4), "cooled": debounce(50, 400, cooldown=120, max_events=1000), "cooled, few": debounce(50, 400, cooldown=120, max_events=3),
    "cooled, small": debounce(80, 1000, cooldown=60, max_events=1000, max_bytes=4500), "at once": immediate(), "at once, cooled": immediate(90),
}


@pytest.fixture(scope="module")
def events(spark):
    """Streams with bursts, idle times of all lengths, ties, and in one of them an event that comes twice."""
    r, rows, at = random.Random(5), [], 1_700_000_000_000
    for user in range(6):
        t = at
        for n in range(90):
            t += r.choice([0, 0, 1, 10, 40, 50, 51, 120, 170, 290, 291, 400, 1000, 90_000_000])
            rows.append((user * 1000 + n, user, "e", t))
    rows.append((5003, 5, "e", t + 7))
    return spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, at bigint").select(
        "event_id", "user_id", "event_type", F.timestamp_millis("at").alias("ts"), F.lit(1.0).alias("value"), F.lit('{"k":1}').alias("props")
    )


@pytest.mark.parametrize("name", sorted(POLICIES))
@pytest.mark.parametrize("slice_ms", [100, 86_400_000])
def test_cut_streams_equal_whole_ones(spark, events, name, slice_ms):
    rule = Rule("r", "1", "events", POLICIES[name], decide=R.several if "at once" not in name else R.always)
    rules = Rules([rule])
    branches = fan_out(R.app([rule]).events({"events": events}), rules).cache()
    got = sorted((tuple(x) for x in replay(branches, rules, ["ops"], slice_ms=slice_ms).select(*COLUMNS).collect()), key=str)
    rows = sorted((x.asDict() for x in branches.select(*ROW, "policy_json", F.col("event_json").alias("body")).collect()), key=lambda x: (x["instance_key"], x["accepted_ms"], x["event_key"], x["branch_hash"]))
    folder, unit, want = Folder({("r", "1"): (rule.policy, rule.decider())}, ["ops"], 48), None, []
    for x in rows:
        if x["instance_key"] != unit:
            want += folder.begin(unit := x["instance_key"], x)
        want += folder.row(x)
    want += folder.end()
    assert got == sorted((tuple(w[c] for c in COLUMNS) for w in want), key=str)
    assert len(got) > 100


def made(events, name):
    rule = Rule("r", "1", "events", POLICIES[name], decide=R.several if "at once" not in name else R.always)
    rules = Rules([rule])
    return fan_out(R.app([rule]).events({"events": events}), rules), rules


@pytest.mark.parametrize("name", sorted(POLICIES))
@pytest.mark.parametrize("hot_rows", [0, 90])
def test_large_streams_are_cut_and_equal_whole_ones(spark, events, name, hot_rows):
    branches, rules = made(events, name)
    got, want = (sorted((tuple(x) for x in replay(branches, rules, ["ops"], slice_ms=100, hot_rows=n).select(*COLUMNS).collect()), key=str) for n in (hot_rows, 10_000))
    assert got == want and len(got) > 100


@pytest.mark.parametrize("name", sorted(POLICIES))
def test_small_streams_take_one_shuffle_and_no_table(spark, events, name, monkeypatch):
    branches, rules = made(events, name)
    stored, names = batches.stored, []
    monkeypatch.setattr(batches, "stored", lambda df, n: names.append(n) or stored(df, n))
    folded = replay(branches, rules, ["ops"])
    assert names == ["hot"]
    assert str(folded._jdf.queryExecution().sparkPlan()).count("Exchange") == 1


def test_records_hold_rows_as_they_are():
    stream = dict.fromkeys(batches.STREAM, "s")
    rows = [batches.note_row(stream, "duplicate", 5, "e", "b", None), {**batches.note_row(stream, "batch", 6, "é", "b2", "d"), "members": [], "bytes": 7}]
    rows.append({**rows[0], "members": [{"event_key": "x", "branch_key": "y", "body": '{"a":1}'}, {"event_key": "z", "branch_key": None, "body": None}]})
    assert batches._record(rows).equals(pa.RecordBatch.from_pylist(rows, schema=batches.OUT))


def test_raw_rows_of_one_split_are_spread(spark, events):
    one = R.app([Rule("r", "1", "events", immediate())]).folded({"events": events.coalesce(1)}, unique=True)
    assert one.rdd.getNumPartitions() == 4


#: Registered queries that once cut small streams too.
FOUND = [
    "ring_dedup",
    "cooldown_immediate",
    "cooldown_batches",
    "debounce_max_events",
    "debounce_quiet",
    "diagnostics",
    "next_due_at",
    "debounce_full",
    "debounce_max_wait",
    "closed_by_counts",
    "debounce_max_bytes",
    "decide_sequence_a_then_b",
]


@pytest.mark.parametrize("name", FOUND)
def test_registered_queries_write_no_branches(spark, name, monkeypatch):
    stored, names = batches.stored, []
    monkeypatch.setattr(batches, "stored", lambda df, n: names.append(n) or stored(df, n))
    R.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert names == ["hot"]
