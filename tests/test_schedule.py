"""Due jobs over several batches and a restart, against a plain loop over the clock."""

import datetime as dt
import json
import uuid

import pytest

from loomweb.streaming import schedule

START = dt.datetime(2024, 1, 1, 8, 0)


def command(hours, job, action="tick", kind="interval", every=1, minute=0):
    return {"job_id": job, "at": (START + dt.timedelta(hours=hours)).isoformat(), "action": action, "kind": kind, "hours": every, "minute": minute}


BATCHES = [
    [command(0, "a", "add", every=2), command(0, "b", "add", kind="daily", minute=9 * 60), command(0, "c", "add", every=5)],
    [command(1.5, "clock")],
    [command(2.5, "clock"), command(2.5, "c", "toggle")],
    [command(9, "clock")],  # a was due three times meanwhile
    [command(9.5, "a", "remove"), command(9.5, "c", "toggle")],
    [command(16, "clock")],
    [command(30, "clock")],
    [command(40, "clock")],
]


def run(spark, folder, batches, first):
    for n, rows in enumerate(batches, first):
        with open(f"{folder}/in/{n:03}.json.tmp", "w") as file:
            file.write("\n".join(map(json.dumps, rows)))
        import os

        os.rename(f"{folder}/in/{n:03}.json.tmp", f"{folder}/in/{n:03}.json")
        stream = spark.readStream.schema(schedule.COMMANDS).json(f"{folder}/in")

        def store(rows, batch):
            rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

        query = schedule.run_due(stream, store, folder)
        query.awaitTermination(120)
        assert query.exception() is None


def test_jobs_fire_once_for_each_time_due_and_go_on_after_a_restart(spark, tmp_path):
    folder = str(tmp_path / uuid.uuid4().hex)
    (tmp_path / folder / "in").mkdir(parents=True)
    run(spark, folder, BATCHES[:3], 0)
    before = {(r.job_id, r.fired_at) for r in spark.read.parquet(f"{folder}/out").collect()}
    run(spark, folder, BATCHES[3:], 3)  # each batch is a query of its own: state and timers come from the checkpoint
    rows = spark.read.parquet(f"{folder}/out").collect()
    fired = sorted((r.job_id, (r.fired_at - START).total_seconds() / 3600) for r in rows)
    assert len(fired) == len({(r.job_id, r.fired_at) for r in rows}) and before <= {(r.job_id, r.fired_at) for r in rows}
    assert [t for j, t in fired if j == "a"][:3] == [0.0, 2.5, 9.0] and len([t for j, t in fired if j == "a"]) == 3
    assert [t for j, t in fired if j == "b"] == [1.5, 30.0]
    assert [t for j, t in fired if j == "c"] == [0.0, 9.5, 16.0, 30.0, 40.0]
    for r in rows:
        assert r.due_at <= r.fired_at < r.next_at


@pytest.mark.parametrize("kind, last, now, want", [("interval", None, 5, 5), ("interval", 1, 5, 7), ("daily", None, 5, 9), ("daily", None, 12, 9), ("daily", 9.5, 12, 33), ("daily", 8, 12, 9), ("daily", -3, 12, 9)])
def test_next_time(kind, last, now, want):
    ms = lambda h: None if h is None else int(h * schedule.HOUR)
    assert schedule.next_time(kind, 6, 540, ms(last), ms(now)) == ms(want)
