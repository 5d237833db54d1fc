"""State of the brute-force stream: IPs share buckets, each with times of its own."""

import random
import tempfile

import pandas as pd

from logtide.streaming import live


class _State:
    """A state record as Spark keeps it, for calls of the function itself."""

    def __init__(self):
        self.value = self.timeout = None
        self.hasTimedOut, self.now = False, 0

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = self.timeout = None

    def getCurrentWatermarkMs(self):
        return self.now

    def setTimeoutTimestamp(self, ms):
        assert ms >= self.now
        self.timeout = ms


def _expected(ips, rows, window, threshold, now):
    """Alerts of a micro-batch; ``ips`` holds, by IP, [counts by second, alerted, forgotten after]."""
    out = set()
    for ip in {r[0] for r in rows}:
        counts, alerted, _ = ips.get(ip, [{}, False, None])
        mine = [r for r in rows if r[0] == ip]
        for _, sec, n, _, _ in mine:
            counts[sec] = counts.get(sec, 0) + n
        for sec in sorted({r[1] for r in mine}):
            total = sum(n for s, n in counts.items() if sec - window <= s <= sec)
            if not alerted and total >= threshold:
                first, has, path = min((f, p is not None, p or "") for _, s, _, f, p in mine if s == sec)
                out.add((ip, first, total, path if has else None))
                alerted = True
        newest = max(counts)
        ips[ip] = [{s: n for s, n in counts.items() if s >= newest - window}, alerted,
                   max((newest + window) * 1000 + 1, now + 1)]
    for ip in [i for i, (_, _, until) in ips.items() if until < now]:
        del ips[ip]
    return out


def test_ips_of_a_bucket_are_alerted_and_forgotten_each_by_itself(monkeypatch):
    monkeypatch.setattr(live, "ROWS_AT_ONCE", 4)
    alerts = 0
    for seed in range(60):
        rng = random.Random(seed)
        fn, state, ips, now, newest = live._alert_state_fn(60, 5, 1), _State(), {}, 0, 0
        for _ in range(12):
            rows = []
            for _ in range(rng.choice([0, 1, 5, 20])):
                sec = 1000 + newest + rng.randint(-90, 40)
                rows.append((rng.choice("abcdé"), sec, rng.randint(1, 3),
                             pd.Timestamp(sec, unit="s") + pd.Timedelta(milliseconds=rng.randint(0, 2)), rng.choice([None, "", "/x", "/y"])))
            want = _expected(ips, rows, 60, 5, now)
            frame = pd.DataFrame(rows, columns=["ip", "ts_epoch", "n", "first", "path"])
            state.now, state.hasTimedOut = now, not rows and state.exists and state.timeout < now
            got = set()
            if rows or state.hasTimedOut:
                parts = [frame.iloc[k:k + 3] for k in range(0, len(frame), 3)]
                for out in fn((0,), iter(parts), state):
                    got |= {tuple(r) for r in out.drop(columns="window_minutes").itertuples(index=False)}
            assert got == want
            assert sorted(state.value[0] if state.exists else []) == sorted(ips)
            alerts += len(got)
            newest += rng.choice([0, 30, 120])
            now = max(now, 1000 * (1000 + newest - rng.choice([20, 100])) + rng.choice([0, 1]))
    assert alerts > 100


def test_state_records_are_bounded_by_the_buckets(spark, monkeypatch):
    monkeypatch.setattr(live, "BUCKETS", 8)
    src = tempfile.mkdtemp(prefix="logtide-stream-")
    with open(f"{src}/a.log", "w") as f:
        for i in range(300):
            f.write(f'10.0.{i // 100}.{i % 100} - - [10/Oct/2023:13:00:{i % 60:02d} +0000] "GET /login HTTP/1.1" 401 5\n' * (2 if i % 3 else 5))
    name = "bounded_state"
    q = (live.stream_brute_force(live.stream_access_log(spark, src), 5, 5).writeStream.format("memory").queryName(name)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert max(s.numRowsTotal for p in q.recentProgress for s in p.stateOperators) <= 8
    assert spark.table(name).count() == 100
