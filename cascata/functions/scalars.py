"""Scalar functions as Column expressions; everything stays inside the JVM except the content UUID and log-gamma."""

from __future__ import annotations

import json
import math
import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_KM = 6371.0
#: Texts that mean "yes", and the namespace of content identities.
TRUE_TEXTS = ("是", "yes", "true", "1", "y")
CONTENT_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "fault-grouping:alarm-content:v1")


def parse_time(text: Column) -> Column:
    """Two fixed layouts, then ISO; null where none fits."""
    text = F.trim(text)
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy/MM/dd HH:mm:ss")), F.try_to_timestamp(text))


def is_true_text(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin(*TRUE_TEXTS), F.lit(False))


def delayed_clear(first_us: Column, clear_us: Column, delay_s: float) -> Column:
    """Effective clear time in microseconds, cut to whole seconds: never earlier than first plus the delay."""
    wait = F.greatest(F.lit(int(delay_s * 1_000_000)).cast("long"), F.greatest(F.lit(0).cast("long"), clear_us - first_us))
    return F.floor((first_us + wait) / 1_000_000).cast("long") * 1_000_000


def hash_fraction(text: Column, seed: str) -> Column:
    """The first 12 hex digits of md5(seed::text) as a fraction of their largest value."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}::"), text)), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(0xFFFFFFFFFFFF))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def to_cartesian(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    return F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))


def chord_to_km(chord: Column) -> Column:
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), chord / 2))


def classify_by_keywords(text: Column, exact: dict[str, str], parts: list[tuple[str, str]], default: str) -> Column:
    """Exact names first, then the first part that the upper-cased text contains."""
    upper = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    found = F.lit(default)
    for part, name in reversed(parts):
        found = F.when(F.contains(upper, F.lit(part)), name).otherwise(found)
    for whole, name in exact.items():
        found = F.when(upper == whole, name).otherwise(found)
    return found


def parse_list(text: Column, separators: str = "[,;|，；、]") -> Column:
    """Distinct trimmed parts of a delimited text, in order; blank parts go."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), separators), lambda x: F.trim(x)), lambda x: x != ""))


def softplus(z: Column) -> Column:
    return F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0))


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def exp_kernel(tau: Column, beta: Column) -> Column:
    return beta * F.exp(-beta * tau)


def exp_kernel_integral(t: Column, beta: Column) -> Column:
    return 1 - F.exp(-beta * t)


def link(x: Column, name: str) -> Column:
    clipped = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), x))
    return {"linear": F.greatest(x, F.lit(0.0)), "exp": F.exp(clipped), "softplus": softplus(clipped)}[name]


def slack_weight(dt: Column, slack: float, half_life: float) -> Column:
    """1 for causes before their effect; halves with each ``half_life`` of lateness; 0 beyond ``slack``."""
    late = F.greatest(-dt, F.lit(0.0))
    return F.when(late > slack, 0.0).otherwise(F.exp(-F.lit(math.log(2.0)) * late / half_life))


def bucket_index(x: Column, right_edges: list[float]) -> Column:
    """Number of right edges below x."""
    return reduce(lambda a, b: a + b, [(x > F.lit(e)).cast("int") for e in right_edges])


def rbf_mixture(dt: Column, weights: list[float], means: list[float], widths: list[float]) -> Column:
    terms = [F.lit(w / (math.sqrt(2 * math.pi) * b)) * F.exp(-0.5 * F.pow((dt - m) / b, 2)) for w, m, b in zip(weights, means, widths)]
    return reduce(lambda a, b: a + b, terms)


def device_state(link_on: Column, power_on: Column, offline_on: Column) -> Column:
    return link_on.cast("int") + 2 * power_on.cast("int") + 4 * offline_on.cast("int")


def relation_class(same_device: Column, hop: Column, same_site: Column, both_sites: Column) -> Column:
    """same_device, direct, same_site, indirect, cross_site or unknown, in this order; hop is null where unreachable."""
    return F.when(same_device, "same_device").when(hop == 1, "direct").when(same_site, "same_site").when(hop > 1, "indirect").when(both_sites, "cross_site").otherwise("unknown")


def topology_score(same: Column, hop: Column) -> Column:
    return F.when(same | (hop == 1), 1.0).when(hop.isNull(), 0.0).otherwise(1.0 / hop)


def type_label(*fields: Column) -> Column:
    return F.concat_ws(" | ", *[F.when(F.trim(F.coalesce(f.cast("string"), F.lit(""))) == "", "<empty>").otherwise(F.trim(f.cast("string"))) for f in fields])


def merged_direction(directions: Column) -> Column:
    """'<->' when both directions were seen in the array, else the one that was."""
    both = F.array_contains(directions, "<->") | (F.array_contains(directions, "->") & F.array_contains(directions, "<-"))
    return F.when(both, "<->").otherwise(F.element_at(directions, 1))


def extract_ids(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 0))


def has_token(text: Column, token: str) -> Column:
    return F.lower(text).rlike(rf"(^|[^a-z0-9]){token.lower()}([^a-z0-9]|$)")


def parse_prior(text: str) -> dict[str, float]:
    """'relation=weight,...'; relations left out weigh 1 when looked up."""
    return {k.strip(): float(v) for k, v in (part.split("=", 1) for part in text.split(",") if part.strip())}


def content_uuid_of(record: dict) -> str:
    kept = {k: v for k, v in record.items() if k != "occurrence_uuid"}
    return str(uuid.uuid5(CONTENT_NAMESPACE, json.dumps(kept, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)))


@F.pandas_udf(T.StringType())
def content_uuid(raw: pd.Series) -> pd.Series:
    """Identity of an alarm record, given as JSON: equal for any order of keys."""
    return raw.map(lambda x: None if x is None else content_uuid_of(json.loads(x)))


@F.pandas_udf(T.DoubleType())
def log_gamma(x: pd.Series) -> pd.Series:
    """Stirling's series from 8 up, after the recurrence for smaller arguments; positive arguments, null stays null."""
    v = x.to_numpy(float, na_value=np.nan)
    shift = np.zeros_like(v)
    for _ in range(8):
        low = v < 8
        shift = np.where(low, shift - np.log(np.where(low, v, 1.0)), shift)
        v = np.where(low, v + 1, v)
    r = 1 / (v * v)
    series = (1 / 12 + r * (-1 / 360 + r * (1 / 1260 + r * (-1 / 1680 + r * (1 / 1188 + r * (-691 / 360360 + r / 156)))))) / v
    return pd.Series(shift + (v - 0.5) * np.log(v) - v + 0.5 * np.log(2 * np.pi) + series)


def dirichlet_log_predictive(new: Column, old: Column, prior: float) -> Column:
    """One token's term of a Dirichlet-multinomial: log-gamma of what is there after minus before."""
    return log_gamma(old + new + prior) - log_gamma(old + prior)
