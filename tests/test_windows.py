"""Windows over a stream of events: late rows, closed windows, and runs that go on where one stopped."""

import collections
import datetime as dt
import random

from girthline.streaming import windows

START = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def folder_of(spark, path, rows):
    spark.createDataFrame(rows, "ts timestamp, det long, other string").coalesce(1).write.mode("append").parquet(str(path))


def plain(batches, delay):
    """Windows closed after the batches: an event counts in a window unless an earlier batch has closed it."""
    mark, open_, out = None, collections.defaultdict(collections.Counter), {}
    for rows in batches:
        for ts, det, _ in rows:
            if ts is None or det is None:
                continue
            first = START + (ts - START) // HOUR * HOUR
            for s in (first, first - HOUR):
                if mark is None or s + 2 * HOUR > mark:
                    open_[s][det] += 1
        newest = max((r[0] for r in rows if r[0] is not None and r[1] is not None), default=None)
        if newest is not None:
            mark = max(mark or newest - delay, newest - delay)
        for s in [s for s in open_ if mark is not None and s + 2 * HOUR <= mark]:
            n = open_.pop(s)
            out[s] = (sum(n.values()), sorted(d for d in n if n[d] % 2))
    return out


def run(spark, source, folder):
    got = windows.written_windows(windows.layer_windows(windows.read_events(spark, str(source), "ts", "det", 1)), str(folder)).collect()
    assert len({r["start"] for r in got}) == len(got)
    return {r["start"]: (r["events"], r["dets"]) for r in got}


def test_late_events_and_restarts(spark, tmp_path):
    rng = random.Random(3)
    some = lambda lo, hi, n: [(START + HOUR * rng.uniform(lo, hi), rng.randrange(4), "x") for _ in range(n)]
    batches = [some(0, 10, 80), some(8, 12, 40), some(2, 13, 40) + [(None, 1, "x"), (START + HOUR * 12, None, "x")], some(30, 31, 5), some(0, 40, 60)]
    batches[1] += batches[1][:7]
    want = plain(batches, 2 * HOUR)
    assert plain(batches[:1], 2 * HOUR) and want != plain([sum(batches, [])], 2 * HOUR)  # some rows come too late
    for i, rows in enumerate(batches):
        folder_of(spark, tmp_path / "in", rows)
        assert run(spark, tmp_path / "in", tmp_path / "out") == plain(batches[: i + 1], 2 * HOUR)
    assert run(spark, tmp_path / "in", tmp_path / "out") == want


def test_no_events(spark, tmp_path):
    folder_of(spark, tmp_path / "in", [])
    assert run(spark, tmp_path / "in", tmp_path / "out") == {}
