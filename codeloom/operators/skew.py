"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than one in HOT_PARTS of the large side's rows, so there are fewer than HOT_PARTS.
HOT_PARTS = 200
#: Entries of the sketch that finds them; a key with more rows than one in TRACKED is never missed.
TRACKED = 20_000
#: Keys with fewer rows are never hot.
LEAST_ROWS = 1000


def hot_keys(df: DataFrame, key: str, parts: int = HOT_PARTS) -> list:
    """The keys that hold more than one in `parts` of df's rows: fewer than 2 x `parts` values, whatever the input.

    One scan without a shuffle of keys: a frequent-items sketch of bounded size, combined where the rows are. Its counts
    are upper bounds, so no hot key is missed; one that is only nearly hot may be among them, which does no harm.
    """
    found = df.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {2 * parts}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n"))
    row = found.first()
    return [r["item"] for r in row.top or [] if r["count"] * parts > row.n and r["count"] > LEAST_ROWS]


def lookup(large: DataFrame, index: DataFrame, key: str, values: Sequence[str], hot: Sequence | None = None) -> DataFrame:
    """Left join of `large` with `index`, which has at most one row per key.

    The index rows of the hot keys, a bounded number of them, are broadcast; in the shuffle that serves the other keys
    the rows of hot keys, and those without a key, are spread by a hash of what they hold, so no task gets all rows of
    one. `large` is read once. Null keys match nothing. hot: the result of hot_keys(), by default found here.
    """
    hot = hot_keys(large, key) if hot is None else list(hot)
    index = index.select(F.col(key).alias("k_"), F.struct(*values).alias("v_"))
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    spread = F.concat(F.lit("\0"), F.xxhash64(*large.columns).cast("string"))
    cold = F.when(F.col(key).isNull() | is_hot, spread).otherwise(F.col(key).cast("string"))
    rows = large.withColumn("c_", cold)
    if hot:
        few = F.broadcast(index.where(F.col("k_").isin(hot)).select(F.col("k_").alias("h_"), F.col("v_").alias("w_")))
        rows = rows.join(few, F.col(key) == F.col("h_"), "left")
        index = index.where(~F.col("k_").isin(hot))
    met = rows.join(index.select(F.col("k_").cast("string").alias("c_"), "v_"), "c_", "left")
    found = F.coalesce("w_", "v_") if hot else F.col("v_")
    return met.select(*large.columns, *[found[v].alias(v) for v in values])


def canonical_id(column: Column | str) -> Column:
    """An id regardless of case, blanks at the ends and enclosing braces."""
    column = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(F.lower(column), r"^[\s\x{A0}]*\{?[\s\x{A0}]*|[\s\x{A0}]*\}?[\s\x{A0}]*$", "")
