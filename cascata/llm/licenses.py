"""Licence scan by canonical digest: whole texts, and single lines, are looked up among known licences and notices.

The canonical form of a text leaves out copyright lines, puts A-Z in lower case, joins hyphenated words, takes every other
run of ASCII punctuation and blanks as one blank, and writes equivalent spellings one way. Its SHA-256 is hash-joined with
the digests of a registry of licence texts (a table; it is broadcast if its measured size allows, else shuffled). Lines that contain the word part "icen" in
either case, hyphenated or not, are looked up the same way among short notices, so that a notice inside a longer document is found.

Null text has the digest of the empty text and no licence. Repeated rows give a row each. Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cascata.llm.common import LOWER, SEPARATORS, UPPER, ascii_lower, fits_broadcast
from cascata.llm.license_texts import EQUIVALENT_WORDS, LICENSES, NOTICES
from cascata.session import materialize

#: Lines that state a copyright: the word with a year, sign, name or placeholder behind it, or a bare sign.
COPYRIGHT_LINE = r"^[^A-Za-z0-9(]*(?:[Cc][Oo][Pp][Yy][Rr][Ii][Gg][Hh][Tt](?:ed)?[ ]*(?:\([Cc]\)|©|[0-9]{4}|<|\[|\{|[Bb][Yy] )|\([Cc]\) |©|[Aa]ll [Rr]ights [Rr]eserved)"
NOTICE_PART = "icen"
#: What a line has whose canonical form contains the word part.
NOTICE_LINE = "(?i)" + "-*".join(NOTICE_PART)


def canonical_text(text: str | None) -> str:
    """The canonical form in plain Python, for registries and tests."""
    lines = [x for x in (text or "").split("\n") if not re.search(COPYRIGHT_LINE, x)]
    lowered = "\n".join(lines).replace("-", "").translate(str.maketrans(UPPER, LOWER))
    return " ".join(EQUIVALENT_WORDS.get(w, w) for w in re.split(SEPARATORS, lowered) if w)


def digest(text: str | None) -> str:
    return hashlib.sha256(canonical_text(text).encode()).hexdigest()


def _words(text: Column) -> Column:
    spaced = F.trim(F.regexp_replace(ascii_lower(F.replace(text, F.lit("-"), F.lit(""))), SEPARATORS, " "))
    # Words of other lengths or beginnings have no second spelling, so most are spared the lookup.
    swap = F.create_map(*[F.lit(x) for pair in EQUIVALENT_WORDS.items() for x in pair])
    rare = F.lit("(?:^| )(?:" + "|".join(sorted(EQUIVALENT_WORDS)) + ")(?: |$)")
    swapped = F.array_join(F.transform(F.split(spaced, " "), lambda w: F.coalesce(F.element_at(swap, w), w)), " ")
    return F.when(F.regexp_like(spaced, rare), swapped).otherwise(spaced)


def canonical(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~x.rlike(COPYRIGHT_LINE))
    return _words(F.array_join(lines, "\n"))


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, text): the registry that comes with the package."""
    return spark.createDataFrame(list(LICENSES.items()), "license_id string, text string")


def known_digests(registry: DataFrame) -> DataFrame:
    """(known_digest, license_id) of a registry (license_id, text) of any size; of equal texts the smallest name counts."""
    rows = registry.select(F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("known_digest"), "license_id")
    return materialize(rows.groupBy("known_digest").agg(F.min("license_id").alias("license_id")), "license-registry")


def scan(documents: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, canonical_sha256, license_id (of the whole text) and notices (of its lines), a row per document.

    ``registry`` (license_id, text) takes the place of the known licences that come with the package.
    """
    notices = {digest(line): name for name, lines in NOTICES.items() for line in lines}
    known_notice = F.create_map(*[F.lit(x) for pair in sorted(notices.items()) for x in pair])
    lines = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: x.rlike(NOTICE_LINE))
    named = F.transform(lines, lambda x: F.element_at(known_notice, F.sha2(canonical(x).cast("binary"), 256)))
    docs = documents.select("doc_id", canonical(F.col("text")).alias("_text"), F.array_sort(F.array_distinct(F.array_compact(named))).alias("_named"))
    docs = docs.select(
        "doc_id", F.when(F.col("_text") == "", F.lit(0)).otherwise(F.length("_text") - F.length(F.replace("_text", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
        F.sha2(F.col("_text").cast("binary"), 256).alias("canonical_sha256"), F.array_join("_named", ",").alias("notices"),
    )
    known = known_digests(known_licenses(documents.sparkSession) if registry is None else registry)
    fits = fits_broadcast(known, F.octet_length("known_digest") + F.octet_length("license_id") + 48)
    return docs.join(F.broadcast(known) if fits else known, F.col("canonical_sha256") == F.col("known_digest"), "left").select("doc_id", "n_words", "canonical_sha256", "license_id", "notices")
