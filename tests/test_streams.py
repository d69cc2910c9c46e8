"""Replayed streams give what batches give, however many files there are and in whatever order."""

from __future__ import annotations

import os
from functools import partial

import pytest
from support import DATA, same

from tidewater.plans import registry
from tidewater.streaming import jobs

CASES = ["stream_ingest", "stream_tumbling", "stream_late_data", "stream_sliding", "stream_session", "stream_dedup", "stream_foreach_upsert", "stream_state_counters"]


@pytest.fixture(scope="module")
def newest_first(spark, tmp_path_factory):
    """The events in three files, the newest events in the oldest file."""
    d = tmp_path_factory.mktemp("files")
    e = spark.read.parquet(f"{DATA}/events.parquet")
    for k, day in enumerate(("ts >= '2024-01-21'", "ts >= '2024-01-11' AND ts < '2024-01-21'", "ts < '2024-01-11'")):
        e.where(day).coalesce(1).write.mode("append").parquet(f"{d}/events.parquet")
        for f in (d / "events.parquet").glob("part-*"):
            if f.stat().st_mtime > 1e9 + 1000:
                os.utime(f, (1e9 + k, 1e9 + k))
    return str(d)


@pytest.mark.parametrize("name", CASES)
def test_newest_file_first(spark, duck, newest_first, name, monkeypatch):
    monkeypatch.setattr(jobs, "event_files", partial(jobs.event_files, per_trigger=1))
    got, want = same(registry.QUERIES[name](spark, newest_first), duck, registry.ORACLES[name])
    assert got == want
