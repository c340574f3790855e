"""Continuous operation: one state machine per stream key, event-time timers at its exact deadlines, idempotent sinks.

The state store must be RocksDB (STATE_STORE). The event time is `accepted_at`, which ingress assigns in order, so that the
watermark drops nothing; when an event occurred only orders it within its batch. A deadline fires when the watermark passes it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.identity import ConflictError
from ..operators.mailbox import Branch, Mailbox, settle
from ..operators.outcomes import BatchView, checked
from ..operators.policy import Limits
from ..operators.rules import Rules, fan_out
from ..plans.app import App
from ..plans.batches import FOLDED, ROW, STREAM, batch_row, keyed, note_row
from ..plans.wakes import decided, runs

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUTPUT = "instance_key string, row string"
#: What the state keeps of a row.
INPUT = [*ROW, "policy_json", "body"]


class StreamProcessor(StatefulProcessor):
    """Appends a key's rows in order and fires what is due; the state is the mailbox as JSON, and the rows that wait for room in it.

    A row is admitted when what is pending leaves room for it (Limits.max_pending_branches and max_pending_bytes); else it waits,
    with all that come after it, and is accepted at the time at which due work has made room.
    """

    def __init__(self, policies: dict, routes: list[str], limits: Limits):
        self.policies, self.routes, self.limits = policies, routes, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("box", "value string")

    def _load(self) -> tuple[Mailbox | None, dict | None, list[dict]]:
        if not self.state.exists():
            return None, None, []
        d = json.loads(self.state.get()[0])
        return Mailbox.load(d["box"]), d["stream"], d["waiting"]

    def _store(self, box: Mailbox, stream: dict, waiting: list[dict]) -> None:
        self.state.update((json.dumps({"box": box.dump(), "stream": stream, "waiting": waiting}),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if (due := box.due()) is not None:
            self.handle.registerTimer(due)

    def _settled(self, box: Mailbox, stream: dict, until: int) -> list[dict]:
        _, decide = self.policies[stream["monitor_id"], stream["definition_version"]]
        of = (lambda batch: None) if decide is None else (lambda batch: checked(decide(BatchView(batch, **stream)), self.routes))
        return [batch_row(stream, batch, outcome) for batch, outcome in settle(box, until, of)]

    def _append(self, box: Mailbox, stream: dict, r: dict, at: int) -> list[dict]:
        try:
            status, first = box.append(r["event_key"], r["branch_hash"], [self._branch(r)], at, r["policy_json"] + r["mode"])
        except ConflictError as e:  # reported beside the batches; the stream goes on
            return [note_row(stream, "conflict", at, r["event_key"], r["branch_key"], e.namespace)]
        return [note_row(stream, "duplicate", first, r["event_key"], r["branch_key"], None)] if status == "duplicate" else []

    @staticmethod
    def _branch(r: dict) -> Branch:
        return Branch(r["branch_key"], r["branch_hash"], r["event_key"], r["order_key"], int(r["bytes"]), r["body"])

    def _fits(self, box: Mailbox, r: dict) -> bool:
        """An event that the ring knows needs no room; into an empty mailbox anything goes."""
        return r["event_key"] in box.ring or not box.ledger or box.fits([self._branch(r)], self.limits)

    def _until(self, box: Mailbox, stream: dict, waiting: list[dict], until: int) -> list[dict]:
        """Fire what is due before `until`; rows that wait are appended as soon as a firing has made room."""
        out: list[dict] = []
        while waiting and (due := box.due()) is not None and due < until:
            out += self._settled(box, stream, due + 1)
            while waiting and self._fits(box, waiting[0]):
                out += self._append(box, stream, waiting.pop(0), due)
        return out + self._settled(box, stream, until)

    @staticmethod
    def _frame(key, rows: list[dict]):
        import pandas as pd

        return pd.DataFrame({"instance_key": [key[0]] * len(rows), "row": [json.dumps(r) for r in rows]}, dtype=object)

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        frame = pd.concat(list(rows)).sort_values(["accepted_ms", "event_key", "branch_hash"], kind="stable")  # a trigger's rows of one key
        box, stream, waiting = self._load()
        out: list[dict] = []
        for r in frame[INPUT].astype(object).to_dict("records"):
            r["accepted_ms"], r["bytes"] = int(r["accepted_ms"]), int(r["bytes"])
            if box is None:
                stream = {c: r[c] for c in STREAM}
                box = Mailbox(r["instance_key"], self.policies[r["monitor_id"], r["definition_version"]][0], r["policy_json"] + r["mode"], (), r["mode"], self.limits.recent_events)
            out += self._until(box, stream, waiting, r["accepted_ms"])
            if waiting or not self._fits(box, r):
                waiting.append(r)
            else:
                out += self._append(box, stream, r, r["accepted_ms"])
        self._store(box, stream, waiting)
        if out:
            yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        box, stream, waiting = self._load()
        if box is None:
            return
        out = self._until(box, stream, waiting, expiredTimerInfo.getExpiryTimeInMs() + 1)  # what is due at that time, and nothing later
        self._store(box, stream, waiting)
        if out:
            yield self._frame(key, out)

    def close(self) -> None:
        pass


def stream_batches(branches: DataFrame, rules: Rules, routes: list[str], limits: Limits = Limits(), delay: str = "0 seconds") -> DataFrame:  # noqa: B008
    """A streaming frame of branches to rows of FOLDED. The last open batch of a stream closes when a later event moves time on."""
    policies = {(r.id, r.version): (r.policy, r.decider()) for r in rules.all}
    rows = branches.where("problem is null").select(*ROW, "policy_json", F.col("event_json").alias("body"), F.timestamp_millis("accepted_ms").alias("accepted_at"))
    out = rows.withWatermark("accepted_at", delay).groupBy("instance_key").transformWithStateInPandas(
        statefulProcessor=StreamProcessor(policies, list(routes), limits), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime",
    )
    return out.select(F.from_json("row", FOLDED).alias("r")).select("r.*")


def stream_runs(app: App, raw: dict[str, DataFrame]) -> DataFrame:
    """Streaming raw frames of an application's channels to runs with their wakes."""
    branches = fan_out(app.events(raw), app.rules)
    folded = stream_batches(branches, app.rules, list(app.routes), app.limits)
    return runs(decided(keyed(folded), app.rules, list(app.routes)), app.limits)


def wake_table(path: str, deliver: Callable[[DataFrame], None] | None = None, buckets: int = 256) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of wakes to deliver, under `path`: wakes/bucket=b/trigger=n and conflicts/trigger=n.

    A wake whose key an earlier trigger has is left out, and goes to the conflicts if its content differs; so does all but the
    least content of a key within a trigger. Only the buckets that a trigger's keys fall into are read, and a trigger that is
    repeated replaces what it wrote. deliver(frame) is called when all is written, with the new wakes.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        folder = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        files = folder(path).getFileSystem(spark._jsc.hadoopConfiguration())
        bucket = F.pmod(F.xxhash64("wake_key"), F.lit(buckets)).cast("int").alias("bucket")
        staged = f"{path}/staged/trigger={batch_id}"  # the micro-batch is worked out once
        df.where("status = 'deliver'").select("wake_key", "input_hash", "route_id", "wake", bucket).write.mode("overwrite").parquet(staged)
        new = spark.read.parquet(staged)
        touched = [f"{path}/wakes/bucket={r[0]}" for r in new.select("bucket").distinct().collect()]  # `buckets` at most
        there = [x for x in touched if files.exists(folder(x))]
        held = spark.range(0).selectExpr("'' as wake_key", "'' as existing")
        if there:
            held = spark.read.option("basePath", f"{path}/wakes").parquet(*there).where(F.col("trigger") < batch_id).select("wake_key", F.col("input_hash").alias("existing"))
        first = new.groupBy("wake_key").agg(F.min(F.struct("input_hash", "route_id", "wake", "bucket")).alias("w")).select("wake_key", "w.*")
        fresh = first.join(held, "wake_key", "left_anti").withColumn("trigger", F.lit(batch_id))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "trigger").parquet(f"{path}/wakes")
        known = first.join(held, "wake_key", "left").select("wake_key", F.coalesce("existing", "input_hash").alias("existing"))
        odd = new.select("wake_key", F.col("input_hash").alias("received")).distinct().join(known, "wake_key").where("existing <> received")
        odd.write.mode("overwrite").parquet(f"{path}/conflicts/trigger={batch_id}")
        if deliver:
            there = [x for x in touched if files.exists(folder(f"{x}/trigger={batch_id}"))]
            if there:
                deliver(spark.read.option("basePath", f"{path}/wakes").parquet(*[f"{x}/trigger={batch_id}" for x in there]).select("wake_key", "input_hash", "route_id", "wake"))
        files.delete(folder(staged), True)

    return write
