import os
import random

from pyspark.sql import functions as F

from cascata.operators import components
from cascata.operators.components import connected_components
from cascata.operators.ranking import running_totals
from cascata.session import materialize, passing


def test_running_totals_match_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, *"abcdef"]), rng.randint(-5, 20)) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, k string, n long").repartition(7)
    got = {r.i: (r.rank, r.total) for r in running_totals(df, [F.col("k").asc_nulls_last(), F.col("i").asc()], {"rank": F.lit(1), "total": F.col("n")}).collect()}
    total = 0
    for rank, (i, _, n) in enumerate(sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[0])), 1):
        total += n
        assert got[i] == (rank, total)
    assert running_totals(df.where("false"), [F.col("i")], {"rank": F.lit(1)}).count() == 0


def test_passing_tables_go_and_kept_ones_stay(spark):
    def path(df):
        return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))

    df = spark.range(5)
    with passing(spark) as keep:
        gone = path(materialize(df, "a"))
        with passing(spark) as inner:
            kept = inner(materialize(df, "b"))
            inner_gone = path(materialize(df, "c"))
        assert not os.path.exists(inner_gone) and os.path.exists(path(kept))
        kept = keep(materialize(kept, "d"))
    assert not os.path.exists(gone) and kept.count() == 5


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, None)], "src long, dst long")
    got = dict(connected_components(edges).collect())
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 200}


def test_components_of_few_edges_take_few_jobs(spark, monkeypatch):
    """One task gives what the rounds give, and a handful of jobs leaves the driver's memory alone."""
    rng = random.Random(3)
    rows = [(rng.randrange(200) * 7 - 700, rng.randrange(200) * 7 - 700) for _ in range(170)] + [(None, 5), (6, None), (None, None), (99999, 99999)]
    frame = spark.createDataFrame(rows, "src long, dst long")
    spark.sparkContext.setJobGroup("components-few", "")
    try:
        one = sorted(map(tuple, connected_components(frame).collect()))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components-few")) <= 8
    monkeypatch.setattr(components, "ONE_TASK", -1)
    assert one == sorted(map(tuple, connected_components(frame).collect()))
    assert {(5, 5), (6, 6), (99999, 99999)} <= set(one) and len({c for _, c in one}) > 10
