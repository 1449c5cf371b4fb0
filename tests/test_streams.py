"""Streams give the rows of their batch twins."""

import datetime
import random
import tempfile
import time

from pyspark.sql import functions as F
from retrospect.plans.temporal import assumption_events
from retrospect.sources.versioned import VersionedTable
from retrospect.streaming import monitors


def _source(spark, rows):
    path = tempfile.mkdtemp(prefix="spark-")
    rows.coalesce(1).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _drained(stream, mode, name):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return stream.sparkSession.table(name)


def _events(spark):
    return assumption_events(spark, "/root/testdata/sf0.001").withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))


def _in_turns(spark, parts):
    """A stream that gives each of the tables as a batch of its own, in order."""
    path = tempfile.mkdtemp(prefix="spark-")
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{path}/n={i}")
        time.sleep(1.1)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


NEEDED = {"REVIEWED": "REVIEW_REQUESTED", "POLICY_RESPONSE": "STATEMENT_FLIP", "CENSORED": "STATEMENT_FLIP"}
SIX = ["CONTRADICTION", "REVIEW_REQUESTED", "REVIEWED", "STATEMENT_FLIP", "POLICY_RESPONSE", "CENSORED"]
EVENT = "assumption_id long, event_id long, kind string, occurred_at timestamp"


def _recorded(events):
    """What a recorder that takes events one by one, in order, and stores only what it accepts, says of each."""
    stored, out = {}, []
    for a, event_id, kind, at in sorted(events, key=lambda e: (e[0], e[3], e[1])):
        own = stored.setdefault(a, set())
        ok = kind in SIX and (kind == "CONTRADICTION" or "CONTRADICTION" in own) and (kind not in NEEDED or NEEDED[kind] in own)
        if ok:
            own.add(kind)
        out.append((a, event_id, kind, at, ok))
    return sorted(out)


def _drawn(seed, n, days):
    rng = random.Random(seed)
    start = datetime.datetime(2024, 3, 1)
    return [(rng.randrange(12), i, rng.choice([*SIX, "MONITORED"]), start + datetime.timedelta(hours=rng.randrange(24 * days))) for i in range(n)]


def test_accepted_events_of_drawn_sequences(spark):
    events = _drawn(1, 900, 60)
    found = monitors.accepted_events(spark.createDataFrame(events, EVENT)).select("assumption_id", "event_id", "kind", "occurred_at", "accepted")
    assert sorted(map(tuple, found.collect())) == _recorded(events)


def _end(events, day):
    return [(-1, 10**6 + day, "END", datetime.datetime(2024, 3, 1) + datetime.timedelta(days=day))]


def test_order_state_machine(spark):
    """Batches out of order within the delay, then late, repeated and far too late events, then state that is gone."""
    monitors.with_state_store(spark)
    once = {(e[0], e[2], e[3]): e for e in _drawn(2, 500, 20)}.values()
    events = sorted(once, key=lambda e: e[1])
    cut = lambda low, high: [e for e in events if low <= e[1] < high]
    late = [(3, 5000, "CONTRADICTION", datetime.datetime(2024, 3, 2, 0, 30)), (99, 5001, "MONITORED", datetime.datetime(2024, 3, 3))]
    again = [(e[0], 6000 + e[1], *e[2:]) for e in events[:40]]
    after = [(e[0], 7000 + e[1], e[2], e[3] + datetime.timedelta(days=400)) for e in events if e[1] < 200]
    turns = [cut(250, 500), cut(0, 250), _end(events, 45), late + again, _end(events, 200), after, _end(events, 900)]
    stream = _in_turns(spark, [spark.createDataFrame(t, EVENT) for t in turns])
    rows = [tuple(r) for r in _drained(monitors.order_checked(stream, 21, 60), "append", "order_checked").collect() if r.assumption_id >= 0]
    told = sorted((a, e, k, at, v == "ACCEPTED") for a, e, k, at, v in rows if v in ("ACCEPTED", "REFUSED"))
    # After a year the state is gone, so events are judged by those that followed only.
    assert told == sorted(_recorded(events) + _recorded(after))
    assert sorted(r[:2] for r in rows if r[4] == "LATE") == sorted(e[:2] for e in late)
    assert sorted(r[:2] for r in rows if r[4] == "REPEATED") == sorted(e[:2] for e in again)


def test_verdicts_are_split_into_two_tables_once(spark):
    monitors.with_state_store(spark)
    events = list({(e[0], e[2], e[3]): e for e in _drawn(4, 200, 20)}.values())
    base, make = tempfile.mkdtemp(prefix="spark-"), VersionedTable.create
    shape = spark.createDataFrame([], monitors.VERDICTS).schema
    accepted, aside = (make(spark, f"{base}/{n}", shape, ["assumption_id", "event_id"], buckets=2) for n in ("accepted", "aside"))
    path = f"{base}/in"
    spark.createDataFrame(events, EVENT).coalesce(1).write.parquet(path)
    spark.createDataFrame(_end(events, 45), EVENT).coalesce(1).write.mode("append").parquet(path)
    for log in ("first", "again"):  # the second query knows nothing of the first, the tables do
        judged = monitors.order_checked(spark.readStream.schema(EVENT).parquet(path), 21, 60)
        monitors.split_verdicts(judged, accepted, aside, f"{base}/{log}").awaitTermination()
    expected = _recorded(events)
    for table, ok in ((accepted, True), (aside, False)):
        held = [r for r in table.read().collect() if r.assumption_id >= 0]
        assert sorted((r.assumption_id, r.event_id) for r in held) == [e[:2] for e in expected if e[4] == ok]


def test_contradictions(spark):
    monitors.with_state_store(spark)
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    version = F.date_add(F.to_date("ts"), F.pmod("event_id", F.lit(3)).cast("int"))
    rows = source.select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", version.alias("version_on"), "value")
    claim = [F.concat(F.lit("a-"), "series_id").alias("assumption_id"), "series_id", F.lit("2024-01-10").cast("timestamp").alias("decided_on")]
    claims = rows.select("series_id").distinct().select(*claim, F.lit(60.0).alias("threshold"))
    last = {"series_id": F.lit("view"), "version_on": F.lit("2024-01-01").cast("date"), "value": F.lit(100.0)}
    end = rows.limit(1).withColumns({**last, "ts": F.lit("2100-01-01").cast("timestamp")})
    early = rows.limit(1).withColumns({**last, "ts": F.lit("2099-01-01").cast("timestamp"), "event_id": F.lit(-5).cast("long")})
    middle = F.lit("2024-01-20").cast("timestamp")
    parts = [rows.filter(F.col("ts") >= middle), rows.filter(F.col("ts") < middle), end, early]
    streamed = _drained(monitors.contradictions(_in_turns(spark, parts), claims, "3650 days"), "append", "contradictions")
    twin = monitors.first_contradictions(rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")), 60.0, "2024-01-10")
    batch = twin.select(F.concat(F.lit("a-"), "series_id"), F.col("contradicted_at").cast("timestamp"), "event_id", F.lit("FIRST"))
    assert streamed.count() > 0 and sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_late_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("source", "doc_id", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(60)).cast("int")).alias("published"))
    base = tempfile.mkdtemp(prefix="spark-")
    monitors.split_late(_source(spark, docs), "2024-02-01", f"{base}/in", f"{base}/late", f"{base}/log").awaitTermination()
    counts = lambda name: dict(spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/{name}").groupBy("source").count().collect())
    in_time, late = counts("in"), counts("late")
    for row in monitors.late_counts(docs, "2024-02-01").collect():
        assert (in_time.get(row.source, 0), late.get(row.source, 0)) == (row.in_time, row.late)


def test_once_only(spark):
    events = _events(spark).select("assumption_id", "kind", "occurred_at")
    twice = events.unionByName(events)
    streamed = _drained(monitors.once_only(_source(spark, twice), twice.columns, "occurred_at", "100 days"), "append", "once_only")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, events.distinct().collect()))


def test_append_once_against_what_is_stored(spark):
    events = _events(spark).select("assumption_id", "kind", "occurred_at").distinct()
    base = tempfile.mkdtemp(prefix="spark-")
    table = VersionedTable.create(spark, f"{base}/events", events.schema, events.columns, buckets=4)
    middle = F.lit("2024-01-15").cast("timestamp")
    parts = [events.filter(F.col("occurred_at") >= middle), events, events.limit(50)]  # the second comes very late, and again
    for log in ("first", "first", "restarted"):
        monitors.append_once(_in_turns(spark, parts), table, f"{base}/{log}", log).awaitTermination()
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, events.collect()))


def test_current_states(spark):
    events = _events(spark)
    streamed = _drained(monitors.current_states(_source(spark, events)), "complete", "current_states")
    assert sorted(map(str, streamed.collect())) == sorted(map(str, monitors.current_states(events).collect()))
