"""Receipts of one place in their pack or trace go by event, whatever the order in the file."""

import datetime
import random

from tracewell.jobs import audit_jobs


def events(spark, folder):
    """Event i of k and event i + 1,000,000 of k - 1 have one place; the file is not in order."""
    draw, start = random.Random(5), datetime.datetime(2024, 1, 1)
    rows = [(i + 1_000_000 * j, start + datetime.timedelta(seconds=draw.randint(0, 999)), i % 3, "view", 1.0, f'{{"k": {20 - j}}}') for i in range(300) for j in range(4)]
    draw.shuffle(rows)
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return sorted(((u, (20 - i // 1_000_000) * 1_000_000 + i, i, ts) for i, ts, u, *_ in rows))


def back(rows):
    """(user, place) of the events that are earlier than the one before."""
    return sorted((b[0], b[1]) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0] and b[3] < a[3])


def test_timestamps_monotonic_with_ties(spark, tmp_path):
    rows = events(spark, tmp_path)
    got = audit_jobs.timestamps_monotonic(spark, str(tmp_path)).collect()
    assert sorted((int(r.pack_id[2:]), r.line_no) for r in got) == back(rows)


def test_trace_findings_with_ties(spark, tmp_path):
    rows = events(spark, tmp_path)
    got = audit_jobs.trace_findings(spark, str(tmp_path)).where("finding = 'time goes back'").collect()
    assert sorted((int(r.trace_id[2:]), r.seq) for r in got) == back(rows)
