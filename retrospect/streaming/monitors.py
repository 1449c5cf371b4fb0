"""Assumption monitoring over streams, each with a batch twin that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.versioned import VersionedTable

VERDICTS = "assumption_id long, event_id long, kind string, occurred_at timestamp, verdict string"
CONTRADICTED = "assumption_id string, contradicted_at timestamp, event_id long, verdict string"


def first_contradictions(observations: DataFrame, threshold: float, after: str) -> DataFrame:
    """T01 twin: the first observation of a series after a date over the threshold, of those known on their own day.

    observations: series_id, event_id, ts, version_on (the day of the version), value.
    """
    known = F.col("version_on") <= F.to_date("ts")
    hit = observations.filter((F.col("value") > threshold) & (F.col("ts") > F.lit(after).cast("timestamp_ntz")) & known)
    first = hit.groupBy("series_id").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    return first.select("series_id", F.col("first.ts").alias("contradicted_at"), F.col("first.event_id").alias("event_id"))


def accepted_events(events: DataFrame) -> DataFrame:
    """T02 twin: which events are accepted, each judged by the accepted events that came no later (occurred_at, event_id).

    A CONTRADICTION always is; requests and flips are from the first contradiction on; REVIEWED from the first accepted
    request on, POLICY_RESPONSE and CENSORED from the first accepted flip on. Other kinds are refused.
    """
    order = Window.partitionBy("assumption_id").orderBy("occurred_at", "event_id")
    past = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kind = F.col("kind")
    seen = lambda name, accepted: F.coalesce(F.max(F.when(kind == name, accepted)).over(past), F.lit(False))
    contradicted = events.withColumn("__contradicted", seen("CONTRADICTION", F.lit(True)))
    asked = contradicted.withColumns({f"__{name}": seen(name, F.col("__contradicted")) for name in ("REVIEW_REQUESTED", "STATEMENT_FLIP")})
    ok = (
        F.when(kind == "CONTRADICTION", True)
        .when(kind.isin("REVIEW_REQUESTED", "STATEMENT_FLIP"), F.col("__contradicted"))
        .when(kind == "REVIEWED", F.col("__REVIEW_REQUESTED"))
        .when(kind.isin("POLICY_RESPONSE", "CENSORED"), F.col("__STATEMENT_FLIP"))
    )
    return asked.withColumn("accepted", F.coalesce(ok, F.lit(False))).drop("__contradicted", "__REVIEW_REQUESTED", "__STATEMENT_FLIP")


def current_states(events: DataFrame) -> DataFrame:
    """T05: first contradiction and review of each assumption; as a stream in update mode."""
    kind = F.col("kind")
    return events.groupBy("assumption_id").agg(
        F.min(F.when(kind == "CONTRADICTION", F.col("occurred_at"))).alias("contradicted_at"),
        F.min(F.when(kind == "REVIEWED", F.col("occurred_at"))).alias("reviewed_at"),
        F.count("*").alias("n_events"),
    )


def late_counts(documents: DataFrame, cutoff: str) -> DataFrame:
    """T04: documents of a source in time and late; as a stream in update mode."""
    late = F.col("published") > F.lit(cutoff).cast("date")
    return documents.groupBy("source").agg(F.count_if(~late).alias("in_time"), F.count_if(late).alias("late"))


#: The kinds of events, and what must have been accepted before each.
NEEDS = {
    "CONTRADICTION": (),
    "REVIEW_REQUESTED": ("CONTRADICTION",),
    "REVIEWED": ("CONTRADICTION", "REVIEW_REQUESTED"),
    "STATEMENT_FLIP": ("CONTRADICTION",),
    "POLICY_RESPONSE": ("CONTRADICTION", "STATEMENT_FLIP"),
    "CENSORED": ("CONTRADICTION", "STATEMENT_FLIP"),
}
_DAY_US = 86_400_000_000


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session with the state store that the stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def _micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


class EventOrder(StatefulProcessor):
    """T02 over a stream: judges the events of an assumption in the order of their times, across batches.

    State: `accepted` has the first accepted event of each kind, `known` the (kind, time) pairs seen, `waiting` the events
    whose turn has not come. The turn of an event comes when all have been read that are up to `keep` later than the
    watermark, that is, delay days after it; a timer at its time tells. What comes after its turn is LATE, what is known
    already REPEATED. Once the watermark itself has passed an assumption's last event, its state is dropped: rows that
    could still change it are behind the watermark.
    """

    def __init__(self, keep_days: int):
        self.keep_us = keep_days * _DAY_US

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getMapState("accepted", "kind string", "at long")
        self.known = handle.getMapState("known", "kind string, at long", "event_id long")
        self.waiting = handle.getMapState("waiting", "at long, event_id long", "kind string")
        self.last = handle.getValueState("last", "at long")

    def _timer(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def _told(self, key: tuple, rows: list[tuple[int, int, str, str]]) -> Iterator[pd.DataFrame]:
        if rows:
            out = pd.DataFrame(rows, columns=["at", "event_id", "kind", "verdict"])
            out["occurred_at"] = pd.to_datetime(out.pop("at"), unit="us")
            yield out.assign(assumption_id=key[0])[["assumption_id", "event_id", "kind", "occurred_at", "verdict"]]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        passed = watermark + self.keep_us if watermark > 0 else None
        told = self._released(watermark)  # a batch's timers come after its rows, and these must not change earlier verdicts
        last = self.last.get()[0] if self.last.exists() else None
        for frame in rows:
            events = sorted(zip(_micros(frame["occurred_at"]), frame["event_id"].tolist(), frame["kind"].tolist(), strict=True))
            for at, event_id, kind in events:
                if self.known.containsKey((kind, at)):
                    told.append((at, event_id, kind, "REPEATED"))
                    continue
                self.known.updateValue((kind, at), (event_id,))
                if passed is not None and at <= passed:
                    told.append((at, event_id, kind, "LATE"))
                else:
                    self.waiting.updateValue((at, event_id), (kind,))
                    self._timer(at - self.keep_us)
                if last is None or at > last:
                    last = at
                    self._timer(at)
        if last is not None:
            self.last.update((last,))
        yield from self._told(key, told)

    def _released(self, watermark: int) -> list[tuple[int, int, str, str]]:
        """Verdicts of the events whose turn has come; without events that matter any more, the state is dropped."""
        ready = sorted((tuple(place), kind[0]) for place, kind in self.waiting.iterator() if place[0] <= watermark + self.keep_us)
        told = []
        for (at, event_id), kind in ready:
            self.waiting.removeKey((at, event_id))
            if kind in NEEDS and all(self.accepted.containsKey((need,)) for need in NEEDS[kind]):
                told.append((at, event_id, kind, "ACCEPTED"))
                if not self.accepted.containsKey((kind,)):
                    self.accepted.updateValue((kind,), (at,))
            else:
                told.append((at, event_id, kind, "REFUSED"))
        if self.last.exists() and self.last.get()[0] <= watermark and not self.waiting.exists():
            for state in (self.accepted, self.known, self.waiting, self.last):
                state.clear()
        return told

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._told(key, self._released(timerValues.getCurrentWatermarkInMs() * 1000))

    def close(self) -> None:
        pass


def order_checked(stream: DataFrame, delay_days: int = 1, keep_days: int = 30) -> DataFrame:
    """T02 as a stream (assumption_id, event_id, kind, occurred_at): every event once, with its verdict.

    Events wait delay_days for others of an earlier time; events up to keep_days later than that come out as LATE.
    State is kept per assumption, and keep_days beyond its last event at most.
    """
    held = stream.withWatermark("occurred_at", f"{delay_days + keep_days} days").groupBy("assumption_id")
    return held.transformWithStateInPandas(EventOrder(keep_days), VERDICTS, "append", "EventTime")


class FirstBreach(StatefulProcessor):
    """T01 over a stream: the earliest passing observation of an assumption, told once the watermark has passed it.

    State is one candidate and whether it has been told; an earlier one that comes after that is told as LATE.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "at long, event_id long, told boolean")

    def _row(self, key: tuple, at: int, event_id: int, verdict: str) -> pd.DataFrame:
        row = {"assumption_id": [key[0]], "contradicted_at": [pd.Timestamp(at, unit="us")], "event_id": [event_id], "verdict": [verdict]}
        return pd.DataFrame(row)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, event_id, told = self.first.get() if self.first.exists() else (None, None, False)
        for frame in rows:
            for place in sorted(zip(_micros(frame["ts"]), frame["event_id"].tolist(), strict=True)):
                if at is None or place < (at, event_id):
                    if told:
                        yield self._row(key, *place, "LATE")
                    else:
                        at, event_id = place
                        self.handle.registerTimer(-(-at // 1000))
        self.first.update((at, event_id, told))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, event_id, told = self.first.get()
        if not told and at <= timerValues.getCurrentWatermarkInMs() * 1000:
            self.first.update((at, event_id, True))
            yield self._row(key, at, event_id, "FIRST")

    def close(self) -> None:
        pass


def contradictions(stream: DataFrame, assumptions: DataFrame, watermark: str = "1 day") -> DataFrame:
    """T01 as a stream: the first observation after an assumption's day that passes its threshold, once for each assumption.

    stream: series_id, ts, event_id, version_on, value. assumptions (static): assumption_id, series_id, decided_on, threshold.
    """
    passing = (F.col("value") > F.col("threshold")) & (F.col("ts") > F.col("decided_on")) & (F.col("version_on") <= F.to_date("ts"))
    held = stream.withWatermark("ts", watermark).join(assumptions, "series_id").filter(passing).groupBy("assumption_id")
    return held.transformWithStateInPandas(FirstBreach(), CONTRADICTED, "append", "EventTime")


def split_verdicts(judged: DataFrame, accepted: VersionedTable, aside: VersionedTable, checkpoint: str):
    """A stream of verdicts to a table of accepted events and one of all others, each batch once. Returns the query.

    A batch that is run again, and an event that is stored already, append nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        ok = F.col("verdict") == "ACCEPTED"
        batch.persist()  # the processors run once a batch, also where both tables know the batch
        batch.write.format("noop").mode("overwrite").save()
        accepted.append_new(batch.filter(ok), batch_of=("verdicts", number))
        aside.append_new(batch.filter(~ok), batch_of=("verdicts", number))
        batch.unpersist()

    return judged.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_late(stream: DataFrame, cutoff: str, in_time_path: str, late_path: str, checkpoint: str):
    """T04 as a stream: documents (source, published) to a table of those in time and a side table of late ones.

    Each micro-batch writes both under its number, so a batch that is run again replaces its own files. Returns the query.
    """

    def write(batch: DataFrame, number: int) -> None:
        late = F.col("published") > F.lit(cutoff).cast("date")
        for rows, path in ((batch.filter(~late), in_time_path), (batch.filter(late), late_path)):
            rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_only(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """T03 within the watermark's delay: each key once."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def append_once(stream: DataFrame, table: VersionedTable, checkpoint: str, writer: str):
    """T03 against what is stored: rows of a stream whose key the table lacks, however late they come. Returns the query.

    The table's ledger knows the batches of the writer, so a batch that is run again appends nothing; of a key's rows in
    a batch one is kept. Only the parts of the table that a batch's keys fall in are read.
    """

    def write(batch: DataFrame, number: int) -> None:
        table.append_new(batch, batch_of=(writer, number))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
