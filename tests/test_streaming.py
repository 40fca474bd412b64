"""Streams against the same computation over the whole table."""

import datetime as dt
import tempfile

from granary.operators import usage
from granary.streaming import jobs
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, session_id long, action string, value double, at timestamp"
LAST = [(10_000, 99, "end", 0.0, T0 + dt.timedelta(days=40))]  # moves the watermark past all else


def folder():
    return "file://" + tempfile.mkdtemp(prefix="granary-")


def events(n=200):
    return [(k, k % 7, ("view", "click")[k % 2], float(k), T0 + dt.timedelta(minutes=37 * k)) for k in range(n)]


def source(spark, rows, schema=EVENTS, files=4):
    path = folder()
    for k in range(files):
        spark.createDataFrame(rows[k * len(rows) // files : (k + 1) * len(rows) // files], schema).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame(LAST if schema == EVENTS else rows[-1:], schema).coalesce(1).write.mode("append").parquet(path)
    return jobs.stream(spark, path, schema, files_per_batch=1)


def drained(frame, name, mode="append"):
    q = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", folder()).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return frame.sparkSession.table(name)


def test_daily_rollup_equals_the_batch(spark):
    rows = events()
    got = {(r.day, r.action): (r.n, r.total) for r in drained(jobs.daily_rollup(source(spark, rows), late="60 days"), "daily", "complete").where("action <> 'end'").collect()}
    want = {}
    for _, _, action, value, at in rows:
        n, t = want.get((at.date(), action), (0, 0.0))
        want[at.date(), action] = n + 1, t + value
    assert got == want


def test_sliding_windows_count_each_event_in_two(spark):
    rows = events(60)
    got = drained(jobs.sliding_counts(source(spark, rows), "2 hours", "1 hour"), "sliding").where("action <> 'end'")
    assert got.agg(F.sum("n")).first()[0] == 2 * len(rows)


def test_sessions_equal_the_batch(spark):
    rows = events(120)
    got = sorted((r.session_id, r.start, r.n) for r in drained(jobs.sessions(source(spark, rows), "300 minutes", late="60 days"), "sessions", "complete").where("session_id < 99").collect())
    batch = usage.sessionised(spark.createDataFrame(rows, EVENTS), 300)
    assert got == sorted((r.session_id, r.start, r.n) for r in batch.collect())


def test_hits_are_recorded_once_also_when_a_batch_runs_again(spark):
    schema = "doc_id long, lang string, updated_at timestamp"
    rows = [(k, ("en", "de")[k % 2], T0 + dt.timedelta(minutes=k)) for k in range(40)]
    rows += [(k, "en", T0 + dt.timedelta(minutes=40 + k)) for k in range(0, 20, 2)]  # changed again
    searches = [("english", F.col("lang") == "en"), ("small", F.col("doc_id") < 10)]
    ledger, path = folder() + "/ledger", folder()
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    for _ in range(2):  # a second stream from the start finds the ledger full
        q = jobs.recorded_hits(jobs.new_hits(jobs.stream(spark, path, schema), searches), ledger, folder())
        q.awaitTermination(120)
    got = sorted((r.search, r.doc_id) for r in spark.read.option("recursiveFileLookup", True).parquet(ledger).collect())
    assert got == sorted({("english", k) for k, lang, _ in rows if lang == "en"} | {("small", k) for k, _, _ in rows if k < 10})


def test_dropped_files_of_equal_content_count_once(spark):
    path = tempfile.mkdtemp(prefix="granary-")
    for k in range(6):
        with open(f"{path}/f{k}.txt", "w") as f:
            f.write(f"content {k % 3}")
    got = drained(jobs.dropped_files(spark, path), "dropped").collect()
    assert len(got) == 3 and {r.content.decode() for r in got} == {"content 0", "content 1", "content 2"}


def test_debounce_keeps_the_last_change_after_a_gap(spark):
    schema = "path string, kind string, at timestamp"
    rows = [("a", "new", T0), ("a", "write", T0 + dt.timedelta(seconds=2)), ("b", "new", T0 + dt.timedelta(seconds=3)), ("a", "gone", T0 + dt.timedelta(seconds=60)), ("z", "end", T0 + dt.timedelta(days=1))]
    path = folder()
    for part in (rows[:4], rows[4:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    frame = jobs.debounced(jobs.stream(spark, path, schema, files_per_batch=1), 10, "60 days")
    got = {(r.path, r.kind, r.at) for r in drained(frame, "debounced", "complete").collect()}
    assert got == {("a", "write", rows[1][2]), ("b", "new", rows[2][2]), ("a", "gone", rows[3][2]), ("z", "end", rows[4][2])}


def test_latest_value_of_each_key(spark):
    rows = events(50)
    got = {}
    frame = jobs.latest_per_key(source(spark, rows), "session_id", "at", "value")
    for r in drained(frame, "latest", "update").orderBy("at").collect():
        got[r.key] = r.value
    want = {}
    for _, session, _, value, _ in rows:
        want[str(session)] = value
    got.pop("99", None)
    assert got == want


def test_notification_ledger(spark):
    ledger = spark.createDataFrame([("s", 1, False), ("s", 2, True), ("t", 1, False)], "search string, doc_id long, notified boolean")
    listed = spark.createDataFrame([("s", 1), ("s", 1), ("x", 9)], "search string, doc_id long")
    assert sorted(tuple(r) for r in usage.notified(ledger, listed).collect()) == [("s", 1, True), ("s", 2, True), ("t", 1, False)]


def test_remembered_hits_outlive_the_watermark(spark):
    """Documents that come again long after, and late ones, give the ledger of the whole table."""
    schema = "doc_id long, text string, updated_at timestamp"
    rows = [(k % 20, ("alpha", "beta", "alpha beta")[k % 3], T0 + dt.timedelta(days=(k * 37) % 90)) for k in range(80)]
    searches = [("a", F.contains("text", F.lit("alpha"))), ("b", F.contains("text", F.lit("beta")))]
    got = drained(jobs.remembered_hits(source(spark, rows, schema, files=8), searches), "remembered").collect()
    want = {(s, k) for k, text, _ in rows for s, word in (("a", "alpha"), ("b", "beta")) if word in text}
    assert sorted((r.search, r.doc_id) for r in got) == sorted(want)
