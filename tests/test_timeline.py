"""Event-time streams: any split into micro-batches gives the rows of a plain walk over the events."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from vitrina.streaming import live, timeline

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
EVENT = ("event_id long, ts timestamp, business_id long, scan_id long, kind string, lead_status string, mark_contacted boolean, "
         "reschedule boolean, follow_up_at timestamp, total_found long")


def at(minute):
    return START + timedelta(minutes=minute)


def made_up():
    rng = random.Random(4)
    out = []
    for i in range(400):
        minute = i * 1.5 + rng.random()
        kind = rng.choice(["JOB_STARTED", "JOB_DONE", "JOB_FAILED", "LEAD_PATCH", "REANALYZE"])
        due = rng.choice([None, at(minute + rng.choice([-5, 20, 90]) + rng.random())])
        out.append((i, at(minute), rng.randrange(6), rng.randrange(3), kind, rng.choice([None, "WON", "INTERESTED"]), rng.random() < 0.3, rng.random() < 0.5, due, 30))
    return out


def streamed(spark, tmp_path, events, parts, question):
    """Rows of a question with the events in ``parts`` micro-batches, neighbours swapped within the lateness."""
    folder = tmp_path / f"{question.__name__}-{parts}"
    rng = random.Random(parts)
    size = -(-len(events) // parts)
    order = sorted(events, key=lambda e: (e[0] // size) if parts > 1 else 0)
    for i in range(parts):
        chunk = order[i * size:(i + 1) * size]
        rng.shuffle(chunk)
        spark.createDataFrame(chunk, EVENT).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(folder))
    rows = live.run_to_table(question(stream), f"t-{question.__name__}", "append").collect()
    return sorted(tuple(int(v.replace(tzinfo=timezone.utc).timestamp() * 1000) if isinstance(v, datetime) else v for v in r) for r in rows)


def walked(events, machine, key, kinds, what, lateness=10 * 60_000):
    """The same machine over all events of a key at once, up to the last watermark."""
    ms = lambda e: int(e[1].timestamp() * 1000)
    rows = [e for e in events if e[4] in kinds]
    end = max(map(ms, rows)) - lateness
    out = []
    for k in sorted({e[key] for e in rows}):
        import json

        found, _ = timeline.advance(machine(), {}, [[ms(e), e[0], json.dumps(what(e))] for e in rows if e[key] == k], end)
        out += [(k, *r) for r in found]
    return sorted(out)


def patch(e):
    return {"lead_status": e[5] or ("CONTACTED" if e[6] else None), "reschedule": e[7], "due": e[8] and int(e[8].timestamp() * 1000)}


@pytest.mark.parametrize("parts", [1, 5])
def test_any_split_agrees(spark, tmp_path, parts):
    events = made_up()
    jobs = ["JOB_STARTED", "JOB_DONE", "JOB_FAILED"]
    kind = lambda e: {"kind": e[4], "id": e[0]}
    cases = [
        (timeline.hanging_jobs, walked(events, timeline.HangingJobs, 2, jobs, kind)),
        (timeline.followup_alerts, walked(events, timeline.FollowUps, 2, ["LEAD_PATCH"], patch)),
        (timeline.accepted_requests, walked(events, timeline.OneRequest, 2, ["REANALYZE", *jobs[1:]], kind)),
    ]
    for question, wanted in cases:
        assert wanted and streamed(spark, tmp_path, events, parts, question) == wanted


def test_completion_is_the_same_for_any_split(spark, tmp_path):
    events = made_up()
    one, five = (streamed(spark, tmp_path, events, parts, timeline.completed_scans) for parts in (1, 5))
    assert one == five and len(one) == 3 and all(r[2] >= 30 for r in one)


def ring(machine, events, end):
    import json

    return timeline.advance(machine, {}, [[t, i, json.dumps(w)] for i, (t, w) in enumerate(events)], end)[0]


def test_follow_up_rules():
    rows = lambda *events, end=10_000: ring(timeline.FollowUps(), events, end)
    plan = lambda due: {"reschedule": True, "due": due}
    assert rows((100, plan(500))) == [(500, 500)]
    assert rows((100, plan(500)), (300, plan(900))) == [(900, 900)]  # armed anew
    assert rows((100, plan(500)), (300, plan(None))) == []  # cleared
    assert rows((100, plan(500)), (300, {"lead_status": "WON"})) == []
    assert rows((100, plan(500)), (300, {"lead_status": "LOST"}), (800, {"lead_status": "INTERESTED"})) == [(500, 800)]
    assert rows((100, plan(500)), (600, plan(500))) == [(500, 500)]  # told once
    assert rows((100, plan(50))) == [(50, 100)]
    assert rows((100, plan(500)), end=500) == []


def test_job_and_request_rules():
    job = lambda *kinds: [(t, {"kind": k}) for t, k in kinds]
    minute = 60_000
    assert ring(timeline.HangingJobs(10), job((0, "JOB_STARTED"), (10 * minute, "JOB_DONE")), 99 * minute) == []
    assert ring(timeline.HangingJobs(10), job((0, "JOB_STARTED"), (10 * minute + 1, "JOB_DONE")), 99 * minute) == [(0, 10 * minute)]
    assert ring(timeline.HangingJobs(10), job((0, "JOB_STARTED"), (5 * minute, "JOB_STARTED")), 99 * minute) == [(5 * minute, 15 * minute)]
    ask = lambda *kinds: [(t, {"kind": k, "id": t}) for t, k in kinds]
    events = ask((1, "REANALYZE"), (2, "REANALYZE"), (3, "JOB_DONE"), (4, "REANALYZE"), (5, "JOB_FAILED"), (6, "JOB_DONE"), (7, "REANALYZE"))
    assert [r[0] for r in ring(timeline.OneRequest(), events, 100)] == [1, 4, 7]
