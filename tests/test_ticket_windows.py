import random

from cascata.operators import intervals as I
from cascata.operators import lookups as K

UNIT = 600_000_000  # ten minutes


def made(spark):
    rng = random.Random(3)
    alarms = [(f"g{i % 11}", rng.choice([1, 2, 3, None]), rng.randrange(0, 3000) * UNIT) for i in range(300)] + [("g1", 1, None)]
    windows = [(f"t{i}", a * UNIT, (a + rng.choice([0, 1, 3, 40, 900])) * UNIT) for i in range(60) for a in [rng.randrange(-10, 3050)]] + [("t1", 5 * UNIT, 4 * UNIT), ("t2", None, 9 * UNIT), ("t3", 9 * UNIT, None)]
    targets = [(f"t{i}", s) for i in range(60) for s in (1, 2, 3, None) if rng.random() < 0.6]
    frames = [spark.createDataFrame(r, s).repartition(3) for r, s in ((alarms, "group_id string, site long, ts long"), (windows, "ticket string, start_ts long, end_ts long"), (targets, "ticket string, site long"))]
    hits = {(t, s, g) for t, s in targets if s for w, a, b in windows if w == t and a is not None and b is not None for g, at, ts in alarms if at == s and ts is not None and a <= ts <= b}
    return frames, hits


def joined_on_values(df):
    """Whether a join of the plan has a range condition only on a whole site."""
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line and "site" in line and "_b" not in line]


def test_windows_by_the_next_alarm(spark):
    (alarms, windows, targets), hits = made(spark)
    out = K.in_ticket_windows(alarms, targets, windows)
    assert {tuple(r) for r in out.collect()} == {(t, s) for t, s, _ in hits} and hits
    assert joined_on_values(out) == []
    nearest = I.with_next(windows.withColumn("site", windows.start_ts * 0 + 1), alarms, ["site"], "start_ts", "ts", 7 * UNIT).collect()
    times = sorted(r.ts for r in alarms.collect() if r.site == 1 and r.ts is not None)
    assert len(nearest) == 62 and all(r.next_ts == min((t for t in times if t >= r.start_ts), default=None) for r in nearest)


def test_groups_by_the_spans_they_have(spark):
    (alarms, windows, targets), hits = made(spark)
    out = K.groups_by_windows(windows, targets, alarms)
    assert sorted(tuple(r) for r in out.collect()) == sorted({(t, g) for t, _, g in hits})
    assert joined_on_values(out) == []
    gone = spark.createDataFrame(sorted({(t, g) for t, _, g in hits})[:5], "ticket string, group_id string")
    assert K.groups_by_windows(windows, targets, alarms, gone).count() == len({(t, g) for t, _, g in hits}) - 5
