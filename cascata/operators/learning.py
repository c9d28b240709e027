"""Link and relation learning: samples with negatives, group splits, standardising, models, ranking, errors."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cascata.functions.scalars import hash_fraction


def candidate_pairs(edges: DataFrame) -> DataFrame:
    """(a, b) two hops apart that are not linked, a < b: the hard negatives."""
    both = edges.select(F.col("src").alias("x"), F.col("dst").alias("y")).union(edges.select("dst", "src")).distinct()
    two = both.alias("l").join(both.alias("r"), F.col("l.y") == F.col("r.x")).select(F.col("l.x").alias("a"), F.col("r.y").alias("b")).where("a < b").distinct()
    return two.join(both.select(F.col("x").alias("a"), F.col("y").alias("b")), ["a", "b"], "left_anti")


def samples(edges: DataFrame, negatives: DataFrame, per_positive: int, seed: str) -> DataFrame:
    """(a, b, label): every link, and for each node up to ``per_positive`` negatives per link, chosen by hash order."""
    pos = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().withColumn("label", F.lit(1))
    quota = pos.groupBy("a").agg((F.count("*") * per_positive).alias("_q"))
    key = hash_fraction(F.concat_ws("-", "a", "b"), seed)
    order = Window.partitionBy("a").orderBy(key, "b")
    neg = negatives.join(quota, "a").withColumn("_r", F.row_number().over(order)).where("_r <= _q").select("a", "b", F.lit(0).alias("label"))
    return pos.unionByName(neg)


def split_groups(df: DataFrame, group: Column, seed: str, train: float = 0.7, valid: float = 0.15) -> DataFrame:
    """Adds ``part`` by the hash fraction of the group, so that a group is never cut."""
    f = hash_fraction(group.cast("string"), seed)
    return df.withColumn("part", F.when(f < train, "train").when(f < train + valid, "valid").otherwise("test"))


def standardize(df: DataFrame, features: list[str], fit_on: Column) -> DataFrame:
    """Each feature less its mean over its standard deviation (population; 0 counts as 1), both of the rows in ``fit_on``."""
    stats = df.where(fit_on).agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features])
    out = df.crossJoin(F.broadcast(stats))  # one row
    for c in features:
        out = out.withColumn(c, (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0))
    return out.drop(*stats.columns)


def train(df: DataFrame, features: list[str], label: str, kind: str = "logistic", positive_weight: float = 1.0):
    """A fitted model: 'logistic' (binary or multinomial) or 'forest'."""
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(df.withColumn("label", F.col(label).cast("double")))
    rows = rows.withColumn("weight", F.when(F.col("label") == 1.0, positive_weight).otherwise(1.0))
    if kind == "logistic":
        return LogisticRegression(maxIter=50, regParam=1e-3, weightCol="weight").fit(rows)
    if kind == "forest":
        return RandomForestClassifier(numTrees=40, maxDepth=6, seed=7, weightCol="weight").fit(rows)
    raise ValueError(f"unknown kind of model {kind!r}")


def score(model, df: DataFrame, features: list[str]) -> DataFrame:
    """Adds ``probabilities``, an array over classes."""
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(df)
    out = model.transform(rows).withColumn("probabilities", vector_to_array("probability"))
    return out.drop("features", "rawPrediction", "probability", "prediction")


def relation_errors(df: DataFrame, threshold: float) -> DataFrame:
    """Adds ``error`` for gold, predicted and score: extra, wrong_direction, missing or null."""
    none = F.col("predicted") == "none"
    error = (
        F.when(F.col("score") < threshold, None).when(F.col("gold").isNull(), F.when(~none, "missing"))
        .when((F.col("gold") != "none") & none, "extra").when((F.col("gold") != "none") & (F.col("gold") != F.col("predicted")), "wrong_direction")
    )
    return df.withColumn("error", error)


def pair_relations(df: DataFrame) -> DataFrame:
    """(a, b, p_downstream, p_upstream, p_both, p_none, relation): both directions of a pair averaged; ties: the earlier class.

    df: src, dst and the four probabilities of src -> dst. Read from the other end, downstream and upstream change places.
    """
    p = ["downstream", "upstream", "both", "none"]
    straight = df.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), *[F.col(f"p_{c}") for c in p])
    turned = df.where("src > dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("p_upstream").alias("p_downstream"), F.col("p_downstream").alias("p_upstream"), "p_both", "p_none")
    mean = straight.unionByName(turned).groupBy("a", "b").agg(*[F.avg(f"p_{c}").alias(f"p_{c}") for c in p])
    best = F.greatest(*[f"p_{c}" for c in p])
    relation = F.lit("none")
    for c in reversed(p):
        relation = F.when(F.col(f"p_{c}") == best, c).otherwise(relation)
    return mean.withColumn("relation", relation)
