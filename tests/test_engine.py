import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__
from cascata.operators import alarms as A
from cascata.operators import groups as GR
from cascata.operators import hawkes as H
from cascata.operators import intervals as I
from cascata.operators import learning as L
from cascata.operators import metrics as M
from cascata.plans import rules as R
from cascata.sources import files
from cascata.streaming import hygiene
from cascata.streaming.periods import batch_periods

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("eid", "alarm_title", "alarm_source", "site_id", "first_time", "clear_time")])


def test_entry_points_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["cascade", "events", "n_ne", "n_site", "n_kind", "duration_us", "dominant_ratio"] and out.count() > 0


def test_raise_and_clear(spark):
    raw = spark.createDataFrame([("E", "A", "NE1", "S1", "2026-01-01 00:00:00", "2026-01-01 00:01:00"), ("F", "A", "NE2", "bad", "2026/01/01 00:00:01", None), ("G", "Z", "NE1", "S1", "2026-01-01 00:00:00", None), ("H", "A", "NE9", "", "2026-01-01 00:00:00", None)], SCHEMA)
    ne = spark.createDataFrame([("NE1", "S1"), ("NE2", "S1")], "ne_id string, site_id string")
    got = A.normalize(raw, ["A"], ne, spark.createDataFrame([("S1",)], "site_id string"))
    assert sorted((r.eid, r.site_id, r.is_clear) for r in got.collect()) == [("E", "S1", False), ("E", "S1", True), ("F", "S1", False)]


def test_latest_wins_keeps_keyless_rows(spark):
    rows = spark.createDataFrame([("k", 5, 1, "a"), ("k", 7, 2, "b"), ("k", 7, 3, "c"), (None, 1, 4, "d"), (None, 1, 5, "e")], "k string, m long, o long, v string")
    assert sorted(r.v for r in A.latest_wins(rows, ["k"], F.col("m"), F.col("o")).collect()) == ["b", "d", "e"]


def test_intervals_touch_and_stay_open(spark):
    rows = spark.createDataFrame([("a", 1, 3), ("a", 3, 5), ("a", 7, None), ("a", 9, 10), ("b", 1, 2)], "k string, start_ts long, end_ts long")
    assert sorted((r.k, r.start_ts, r.end_ts, r.n) for r in I.union_intervals(rows, ["k"]).collect()) == [("a", 1, 5, 2), ("a", 7, None, 2), ("b", 1, 2, 1)]
    points = spark.createDataFrame([("x", 10), ("x", 30), ("x", 51)], "k string, t long")
    assert sorted((r.start_ts, r.end_ts) for r in I.merged_windows(points, ["k"], "t", 10).collect()) == [(0, 40), (41, 61)]


def test_running_state_clamps(spark):
    rng = random.Random(2)
    rows = [(i, "d%d" % rng.randint(0, 2), i, rng.choice(["link", "power", "offline"]), rng.random() < 0.5) for i in range(200)]
    got = {r.eid: (r.link_up, r.power_up, r.offline_up) for r in I.running_states(spark.createDataFrame(rows, "eid long, dev string, ts long, kind string, is_clear boolean"), "dev", ["link", "power", "offline"], "ts", "eid").collect()}
    state = {}
    for eid, dev, _, kind, clear in rows:
        s = state.setdefault(dev, dict.fromkeys(("link", "power", "offline"), 0))
        assert got[eid] == tuple(s.values())
        s[kind] = max(0, s[kind] - 1) if clear else s[kind] + 1


def test_hygiene_script(spark):
    rows = [("A", "a1", 10.0, False, 1), ("A", "a2", 11.0, False, 2), ("B", "a0", 9.0, False, 3), ("A", "a3", 12.0, True, 4), ("A", "a4", 13.0, False, 5), ("C", "c", 1.0, True, 6)]
    got = {r.event_id: r.action for r in hygiene.sanitize(spark.createDataFrame(rows, "key string, event_id string, ts double, is_clear boolean, arrival long"), ["key"], hygiene.Policy(2, 0, 10, 10)).collect()}
    assert got == {"a1": "raise", "a2": "skip:duplicate_raise_compressed", "a0": "raise", "a3": "clear", "a4": "skip:flap_reopen_compressed", "c": "skip:late_after_reorder_watermark"}


def test_periods_split_at_the_gap(spark):
    rows = [(1, "e1", 0, False), (1, "e2", 299, False), (1, "e3", 599, False), (1, "e4", 600, True), (1, "e5", 601, False), (2, "f", 5, True)]
    got = batch_periods(spark.createDataFrame(rows, "k long, eid string, ts long, is_clear boolean"), ["k"], 300).orderBy("start_ts").collect()
    assert [(r.start_ts, r.latest_ts, r.end_ts, r.raises, r.cleared) for r in got] == [(0, 299, 599, 2, False), (599, 599, 600, 1, True), (601, 601, None, 1, False)]


def test_parent_choice_fixture(spark):
    ev = spark.createDataFrame([(0, 0, 0.0, 1), (1, 1, 0.5, 2)], "eid long, dim long, t double, seq long")
    pairs = spark.createDataFrame([(1, 0, 1, 0, 2, 1, 0.5)], "t_eid long, s_eid long, t_dim long, s_dim long, t_seq long, s_seq long, dt double")
    edge = spark.createDataFrame([(1, 0, 2.0, 1.0)], "target long, source long, alpha double, beta double")
    mu = spark.createDataFrame([(0, 0.1), (1, 0.001)], "dim long, mu double")
    assert {r.eid: r.parent for r in H.parents(ev, H.pair_scores(pairs, edge), mu).collect()} == {0: None, 1: 0}


def test_em_raises_the_likelihood(spark):
    made = H.simulate([0.05, 0.02], [[0.1, 0.0], [0.7, 0.1]], 1.0, 800.0, 3)
    ev = spark.createDataFrame([(i, "g", int(t * 1e6), d, i + 1) for i, t, d, _ in made], "eid long, site string, ts long, dim long, seq long")
    found = I.history_pairs(ev, ["site"], 10_000_000, 50)
    kinds = lambda e: ev.select(F.col("eid").alias(f"{e}_eid"), F.col("dim").alias(f"{e}_dim"))
    pairs = found.join(kinds("t"), "t_eid").join(kinds("s"), "s_eid").withColumn("dt", F.col("dt") / 1e6)
    model = H.fit(ev, pairs, 800.0, rounds=4)
    assert model["trace"][-1] > model["trace"][0] and model["spectral_radius"] <= 1.0
    alpha = {(r.target, r.source): r.alpha for r in model["edges"].collect()}
    assert alpha[(1, 0)] == max(alpha.values())


def test_link_rule_scenario(spark):
    alarms = spark.createDataFrame([(1, 10, "link", 10_000_000), (2, 20, "offline", 20_000_000)], "eid long, site long, kind string, ts long")
    profile = spark.createDataFrame([(10, ["Transmission"]), (20, ["Transmission"]), (30, ["Transmission"])], "site long, domains array<string>")
    edges = spark.createDataFrame([(10, 20), (30, 20)], "src long, dst long")
    found, symptoms = R.match(R.LINK_RULE, alarms, profile, edges)
    assert [(r.trigger_eid, r.r_parent) for r in found.collect()] == [(2, [10])]
    assert sorted((r.role, r.eid) for r in symptoms.collect()) == [("child", 2), ("parent", 1)]
    assert R.match(R.LINK_RULE, alarms, profile, edges.where("src = 30"))[0].count() == 0


def test_exclusive_roles_and_reduction(spark):
    rows = spark.createDataFrame([("i", "far", 1, 3), ("i", "near", 1, 1), ("i", "far", 2, 2)], "inst string, role string, site long, hop int")
    assert sorted((r.role, r.site) for r in R.own_exclusively(rows, ["far", "near"]).collect()) == [("far", 2), ("near", 1)]
    ab = spark.createDataFrame([("i", 1, 10), ("i", 2, 20)], "inst string, x long, y long")
    bc = spark.createDataFrame([("i", 10, 100)], "inst string, x long, y long")
    left = R.reduce_dependencies([("a", "b", ab), ("b", "c", bc)])
    assert [(r.x, r.y) for r in left[0][2].collect()] == [(1, 10)]


def test_group_history():
    h = GR.GroupHistory(3600)
    assert h.offer("g1", frozenset({"r1"}), 1)[0] == "emitted"
    assert h.offer("g2", frozenset({"r2"}), 2)[0] == "emitted"
    assert h.offer("g1", frozenset({"r1"}), 3)[0] == "suppressed"
    action, alarms, absorbed = h.offer("g3", frozenset({"r1", "r2", "r3"}), 4)
    assert action == "emitted" and len(alarms) == 3 and sorted(absorbed) == ["g1", "g2"] and len(h.groups) == 1


@pytest.mark.parametrize("seed", range(3))
def test_history_conserves_alarms(seed):
    rng = random.Random(seed)
    h, offered = GR.GroupHistory(1e9), set()
    for i in range(60):
        alarms = frozenset(rng.sample(range(40), rng.randint(1, 5)))
        offered |= alarms
        h.offer(f"g{i}", alarms, i)
    assert set().union(*[g[1] for g in h.groups]) == offered
    assert sum(len(g[1]) for g in h.groups) == len(offered)


def test_direction_comparison_fixture(spark):
    left = spark.createDataFrame([("A", "B", "->"), ("B", "C", "->"), ("C", "D", "<->"), ("D", "E", "->")], "a string, b string, direction string")
    right = spark.createDataFrame([("A", "B", "->"), ("B", "C", "<-"), ("C", "D", "<-"), ("E", "F", "<->")], "a string, b string, direction string")
    got = {(r.a, r.b): r.change for r in M.compare_directions(left, right).collect()}
    assert got == {("A", "B"): "agree", ("B", "C"): "reversed", ("C", "D"): "bidirectional_to_directed", ("D", "E"): "left_only", ("E", "F"): "right_only"}


def test_recall_edges(spark):
    target = spark.createDataFrame([("t1", 1), ("t1", 2), ("t2", 5)], "ticket string, site long")
    predicted = spark.createDataFrame([("t1", 1), ("t1", 9), ("t3", 4)], "ticket string, site long")
    got = {r.ticket: (r.recall, r.precision, r.f1) for r in M.site_metrics(target, predicted, "ticket", "site").collect()}
    assert got == {"t1": (0.5, 0.5, 0.5), "t2": (0.0, 0.0, 0.0), "t3": (0.0, 0.0, 0.0)}


def test_relation_rules(spark):
    rows = spark.createDataFrame([("down", "none", 0.9), ("down", "up", 0.9), (None, "up", 0.9), ("down", "up", 0.1), ("none", "none", 0.9)], "gold string, predicted string, score double")
    assert [r.error for r in L.relation_errors(rows, 0.5).collect()] == ["extra", "wrong_direction", "missing", None, None]
    pairs = spark.createDataFrame([("a", "b", 0.6, 0.2, 0.1, 0.1), ("b", "a", 0.1, 0.7, 0.1, 0.1)], "src string, dst string, p_downstream double, p_upstream double, p_both double, p_none double")
    row = L.pair_relations(pairs).first()
    assert row.relation == "downstream" and row.p_downstream == pytest.approx(0.65)


def test_file_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"eid": "1", "alarm_title": "A"}\n{"eid": "2", "alarm_title": "B"}\n')
    (tmp_path / "in/b.csv").write_text("﻿eid,alarm_title\n3,C\n", encoding="utf-8")
    with zipfile.ZipFile(tmp_path / "in/c.zip", "w") as z:
        z.writestr("x.csv", "eid,alarm_title\n4,D\n,\n")
        z.writestr("y.jsonl", json.dumps({"eid": "5", "alarm_title": "E"}) + "\n")
        z.writestr("z.txt", "no")
    schema = T.StructType([T.StructField("eid", T.StringType()), T.StructField("alarm_title", T.StringType())])
    got = files.read_alarms(spark, f"file://{tmp_path}/in", schema)
    assert sorted((r.eid, r.alarm_title) for r in got.collect()) == [("1", "A"), ("2", "B"), ("3", "C"), ("4", "D"), ("5", "E")]


def test_caches_and_models(spark, tmp_path):
    events = spark.createDataFrame([(2, 20), (1, 10)], "eid long, ts long")
    files.write_sorted_cache(events, f"file://{tmp_path}/cache", {"delay": 1})
    back, differs = files.read_sorted_cache(spark, f"file://{tmp_path}/cache", {"delay": 2})
    assert back.count() == 2 and differs == ["delay"]
    files.write_model({"mu": events}, {"a": 1}, f"file://{tmp_path}/model")
    assert files.read_model(spark, f"file://{tmp_path}/model", ["mu"], {"a": 1})["mu"].count() == 2
    with pytest.raises(ValueError, match="another configuration"):
        files.read_model(spark, f"file://{tmp_path}/model", ["mu"], {"a": 2})


def test_streaming_equals_batch(spark, tmp_path):
    rows = [("A", "a1", 10.0, False), ("A", "a2", 11.0, False), ("B", "b1", 9.0, True), ("A", "a3", 12.0, True), ("A", "a4", 13.0, False)]
    df = spark.createDataFrame(rows, "key string, event_id string, ts double, is_clear boolean")
    policy = hygiene.Policy(2, 0, 10, 10)
    want = {r.event_id: r.action for r in hygiene.sanitize(df.withColumn("arrival", F.col("ts").cast("long")), ["key"], policy).collect()}
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    q = hygiene.sanitize_stream(stream, policy).writeStream.format("memory").queryName("clean").option("checkpointLocation", f"file://{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.event_id: r.action for r in spark.table("clean").collect()} == want
