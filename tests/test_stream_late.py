"""Windows of a stream with late rows in a sink of their own, against a plain walk over the files."""

import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sievekit.streaming import stream as ST

START = datetime(2024, 3, 1, tzinfo=timezone.utc)
# Minutes of the events in each file, by order of arrival; None has no time.
FILES = [[0, 5, 61, None], [3, 130, 64], [2, 59, 60, 119, 250], [249, 131, 0, 190, 190], [400], [130, 341, None, 399]]
SCHEMA = "event_id long, event_time timestamp, flag boolean, window_note string"


def events():
    number = 0
    for minutes in FILES:
        rows = []
        for m in minutes:
            rows.append((number, None if m is None else START + timedelta(minutes=m), number % 3 == 0, "x"))
            number += 1
        yield rows


def expected(window, slide, delay):
    """Counts by window start, and the late (event, window start), in minutes."""
    on_time, late, seen = {}, [], None
    for rows in events():
        before, times = seen, []
        for event, when, flag, _ in rows:
            if when is None:
                late.append((event, None))
                continue
            m = int((when - START).total_seconds() // 60)
            times.append(m)
            first = m // slide * slide
            for w in range(first, m - window, -slide):
                if before is not None and w + window <= before - delay:
                    late.append((event, w))
                else:
                    n, f = on_time.get(w, (0, 0))
                    on_time[w] = (n + 1, f + flag)
        seen = max([*times, *([] if seen is None else [seen])], default=None)
    return on_time, sorted(late, key=str)


@pytest.fixture
def source(spark, tmp_path):
    folder = str(tmp_path / "in")
    os.mkdir(folder)
    for k, rows in enumerate(events()):
        one = str(tmp_path / f"part{k}")
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(one)
        (name,) = [f for f in os.listdir(one) if f.endswith(".parquet")]
        target = f"{folder}/{k}.parquet"
        os.link(f"{one}/{name}", target)
        os.utime(target, (1_700_000_000 + 60 * k,) * 2)
    return folder



@pytest.mark.parametrize("window, slide, delay", [(60, 60, 30), (120, 60, 10), (90, 30, 0)])
def test_both_sinks_equal_a_walk_over_the_files(spark, source, tmp_path, window, slide, delay):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    on_time, late = ST.stream_windowed_split(
        stream, "flag", "event_time", f"{window} minutes", f"{delay} minutes", str(tmp_path / "out"), slide=f"{slide} minutes"
    )
    epoch = lambda c: ((F.unix_timestamp(c) - int(START.timestamp())) / 60).cast("int")
    got = {r.w: (r.events, r.flagged) for r in ST.window_totals(spark, on_time).withColumn("w", epoch("window_start")).collect()}
    missed = spark.read.parquet(late).withColumn("w", epoch("window_start")).collect()
    counts, rows = expected(window, slide, delay)
    assert got == counts
    assert sorted(((r.event_id, r.w) for r in missed), key=str) == rows
    assert all(r.window_note == "x" for r in missed)
    assert any(w is not None for _, w in rows)


def test_stopped_stream_goes_on_with_its_watermark(spark, source, tmp_path):
    out = str(tmp_path / "out")
    run = lambda folder: ST.stream_windowed_split(
        spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder), "flag", "event_time", "60 minutes", "30 minutes", out
    )
    half = str(tmp_path / "live")
    os.mkdir(half)
    for batch in (range(3), range(3, len(FILES))):
        for k in batch:
            os.link(f"{source}/{k}.parquet", f"{half}/{k}.parquet")
        on_time, late = run(half)
    counts, rows = expected(60, 60, 30)
    got = {int(r.window_start.replace(tzinfo=None).timestamp()): r.events for r in ST.window_totals(spark, on_time).collect()}
    assert sorted(got.values()) == sorted(n for n, _ in counts.values())
    assert spark.read.parquet(late).count() == len(rows)
