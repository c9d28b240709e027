import math

import pytest
from pyspark.sql import functions as F

from cascata.functions import scalars as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_times_and_flags(spark):
    rows = [("2024-01-02 03:04:05",), ("2024/01/02 03:04:05",), ("2024-01-02T03:04:05",), ("nope",), (None,)]
    got = [r.x for r in spark.createDataFrame(rows, "t string").select(F.unix_seconds(X.parse_time(F.col("t"))).alias("x")).collect()]
    assert got[0] == got[1] == got[2] == 1704164645 and got[3:] == [None, None]
    flags = [r.x for r in spark.createDataFrame([(" YES ",), ("是",), ("1",), ("no",), (None,)], "t string").select(X.is_true_text(F.col("t")).alias("x")).collect()]
    assert flags == [True, True, True, False, False]


def test_clear_delay(spark):
    us = lambda s: F.lit(int(s * 1e6)).cast("long")
    assert one(spark, X.delayed_clear(us(100), us(103.7), 0)) == 103_000_000
    assert one(spark, X.delayed_clear(us(100), us(90), 15)) == 115_000_000


def test_identity_ignores_key_order_and_its_own_field(spark):
    a = X.content_uuid_of({"eid": "E", "告警标题": "A"})
    assert a == X.content_uuid_of({"告警标题": "A", "eid": "E", "occurrence_uuid": "z"}) != X.content_uuid_of({"eid": "E", "告警标题": "B"})
    assert one(spark, X.content_uuid(F.lit('{"告警标题": "A", "eid": "E"}'))) == a


def test_numeric_functions(spark):
    assert one(spark, X.softplus(F.lit(800.0))) == 800.0
    assert one(spark, X.sigmoid(F.lit(-800.0))) == 0.0
    assert one(spark, X.slack_weight(F.lit(-5.0), 10.0, 5.0)) == pytest.approx(0.5)
    assert one(spark, X.slack_weight(F.lit(-11.0), 10.0, 5.0)) == 0.0
    assert one(spark, X.bucket_index(F.lit(10.0), [5.0, 10.0, 20.0])) == 1
    assert one(spark, X.exp_kernel_integral(F.lit(2.0), F.lit(3.0))) == pytest.approx(1 - math.exp(-6))
    assert one(spark, X.rbf_mixture(F.lit(1.0), [2.0], [1.0], [0.5])) == pytest.approx(2 / (math.sqrt(2 * math.pi) * 0.5))
    assert one(spark, X.haversine_km(F.lit(30.0), F.lit(120.0), F.lit(30.09), F.lit(120.0))) == pytest.approx(10.0, abs=0.01)
    assert one(spark, X.dirichlet_log_predictive(F.lit(2.0), F.lit(1.0), 0.5)) == pytest.approx(math.lgamma(3.5) - math.lgamma(1.5))
    assert one(spark, X.link(F.lit(-3.0), "linear")) == 0.0


def test_texts(spark):
    assert one(spark, X.parse_list(F.lit(" a,b;;a | c"))) == ["a", "b", "c"]
    assert one(spark, X.type_label(F.lit("x"), F.lit(" "), F.lit(None).cast("string"))) == "x | <empty> | <empty>"
    assert one(spark, X.merged_direction(F.array(F.lit("->"), F.lit("<-")))) == "<->"
    assert one(spark, X.classify_by_keywords(F.lit("my micro link"), {"DATA": "Data"}, [("MICRO", "Transmission"), ("LINK", "Data")], "Other")) == "Transmission"
    assert one(spark, X.extract_ids(F.lit("AB12 x AB12 CD34"), "[A-Z]{2}[0-9]{2}")) == ["AB12", "CD34"]
    assert one(spark, X.has_token(F.lit("a Data-site"), "data")) and not one(spark, X.has_token(F.lit("metadata"), "data"))
    assert X.parse_prior("direct=2, same_site=0.5") == {"direct": 2.0, "same_site": 0.5}


def test_relation_order(spark):
    rows = [(True, 1, True, True), (False, 1, True, True), (False, 2, True, True), (False, 2, False, True), (False, None, False, True), (False, None, False, False)]
    df = spark.createDataFrame(rows, "d boolean, h int, s boolean, b boolean")
    got = [r.x for r in df.select(X.relation_class(F.col("d"), F.col("h"), F.col("s"), F.col("b")).alias("x")).collect()]
    assert got == ["same_device", "direct", "same_site", "indirect", "cross_site", "unknown"]
