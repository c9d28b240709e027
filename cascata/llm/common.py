"""What several operators of this subpackage share: word rules and broadcast bounds."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cascata.session import materialize

#: Words are what lies between these blanks (space, tab, line feed, vertical tab, form feed, carriage return).
BLANK_WORD = r"[^\x20\x09-\x0D]+"
#: Normalised words hold digits, small ASCII letters and everything beyond ASCII; this is what separates them.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: No side of a join above this many bytes is broadcast.
BROADCAST_BYTES = 32 << 20
#: What a row of a few numbers takes in a broadcast table, as measured.
ROW_BYTES = 80

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Texts reach Python in batches of at most ``size`` bytes: rows may be long, and executors hold
    several batches, in growing buffers outside the heap and again in Python."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{size}b")


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Each name, with underscores before it where ``df`` has a column of that name already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def with_row_key(df: DataFrame) -> tuple[DataFrame, tuple[str, str]]:
    """``df`` with two columns that tell its rows apart and stay the same when it is read again: file hash and row number.

    A frame that isn't read from Parquet files is written first.
    """
    file, row = fresh(df, "_file", "_row")
    for source in (lambda: df, lambda: materialize(df, "keyed")):
        try:
            return source().select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)), (file, row)
        except AnalysisException:
            continue
    raise ValueError("rows can't be told apart: a column named _metadata hides the rows' places")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the fast built-in; other letters must stay as they are."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def normal_words(text: Column) -> Column:
    """Array of normalised words; null or wordless text gives an empty array."""
    spaced = F.trim(F.regexp_replace(ascii_lower(text), SEPARATORS, " "))
    return F.when(F.coalesce(F.length(spaced), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def word_count(text: Column) -> Column:
    """Number of blank-separated words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(BLANK_WORD)), F.lit(0)).cast("long")


def fits_broadcast(df: DataFrame, bytes_of: Column, limit: int = BROADCAST_BYTES) -> bool:
    """Measure a side before it is broadcast: the sum of ``bytes_of`` over its rows against ``limit``."""
    return (df.agg(F.sum(bytes_of)).first()[0] or 0) <= limit


def attach(big: DataFrame, small: DataFrame, big_key: str, small_key: str, how: str, null_safe: bool = False, also: Column | None = None, size: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join a table of texts with a narrow one: inside the scan if the narrow one is proven small, else by a shuffle.

    ``small`` must be a written table: it is measured (``size`` bytes, else ``ROW_BYTES`` a row) before it is joined.
    """
    on = F.col(big_key).eqNullSafe(F.col(small_key)) if null_safe else F.col(big_key) == F.col(small_key)
    on = on if also is None else on & also
    fits = (small.count() * ROW_BYTES if size is None else size) <= limit
    return big.join(F.broadcast(small) if fits else small, on, how)
