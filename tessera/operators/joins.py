"""Join operators.

Join strategy is left to Catalyst and adaptive execution, which decide by
bytes: a side known or measured to be small is broadcast, anything else is a
shuffle join whose skewed partitions are split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def left_chain(spine: DataFrame, key: str, sides: list[DataFrame | None]) -> DataFrame:
    """Spine LEFT JOIN each optional side on ``key``; ``None`` sides are skipped."""
    out = spine
    for side in sides:
        if side is None:
            continue
        out = out.join(side, key, "left")
    return out


def join_suffixed(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", suffix: str = "_mf") -> DataFrame:
    """Join with clashing non-key names on the right suffixed."""
    clash = set(left.columns) & set(right.columns) - set(keys)
    r = right.select(*[F.col(c).alias(f"{c}{suffix}" if c in clash else c) for c in right.columns])
    return left.join(r, keys, how)


def missing_keys_count(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Number of distinct keys present in ``a`` and absent from ``b`` (anti join)."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").agg(
        F.count(F.lit(1)).alias("n_missing")
    )


def keep_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in a set (semi join)."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def add_missing_context(display: DataFrame, context: DataFrame, key: str) -> DataFrame:
    """Attach only the context columns not already on ``display``; context deduplicated first."""
    add = [c for c in context.columns if c != key and c not in display.columns]
    if not add:
        return display
    ctx = context.groupBy(key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in add])
    return display.join(ctx, key, "left")


def lookup_from_fact(df: DataFrame, code_col: str, name_cols: list[str], order_col: str) -> DataFrame:
    """Distinct code with the first names seen (explicit order), as a lookup."""
    payload = F.struct(*[F.col(c) for c in name_cols])
    return df.where(F.col(code_col).isNotNull()).groupBy(code_col).agg(
        F.min_by(payload, F.col(order_col)).alias("_n")
    ).select(code_col, *[F.col(f"_n.{c}").alias(c) for c in name_cols])


def salted_join(big: DataFrame, other: DataFrame, key: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join that spreads a hot key over ``salts`` tasks.

    Rows of ``big`` get a salt from a hash of the whole row; ``other`` is
    replicated once per salt (``salts`` copies, a fixed bound).  Every match
    is still produced exactly once, so results are whole.  Use it when one key
    holds a large share of ``big`` and ``other`` is too large to broadcast;
    otherwise adaptive skew-join splitting or a bounded broadcast is simpler.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left joins")
    b = big.withColumn("_salt", (F.abs(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns])) % salts).cast("int"))
    o = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return b.join(o, [key, "_salt"], how).drop("_salt")


def stack_left_join(spine: DataFrame, key: str, sources: dict[str, DataFrame | None]) -> DataFrame:
    """The spine with the columns of every source, in one shuffle however many sources there are.

    Spine and sources are stacked with their number and aggregated by key once, instead of one join after another.  The
    spine and each source have at most one row a key, as snapshots have; a second row raises.  A source that is None (an
    optional input that was not given) adds no columns; keys that only a source has are dropped, and null keys meet none.
    """
    given = {name: df for name, df in sources.items() if df is not None}
    frames = [("", spine), *given.items()]
    owner: dict[str, int] = {}
    for i, (name, df) in enumerate(frames):
        for c in df.columns:
            if c != key and owner.setdefault(c, i) != i:
                raise ValueError(f"column {c!r} of {name!r} is there already")
    stacked = None
    for i, (_, df) in enumerate(frames):
        part = df.where(F.col(key).isNotNull() | F.lit(i == 0)).select(key, *[c for c in df.columns if c != key], F.lit(i).alias("_source"))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    counts = [F.count_if(F.col("_source") == i) for i in range(len(frames))]
    worst = F.greatest(*counts) if len(counts) > 1 else counts[0]
    columns = [F.max(F.when(F.col("_source") == i, F.col(c))).alias(c) for c, i in owner.items()]
    out = stacked.groupBy(key).agg(counts[0].alias("_spine"), worst.alias("_most"), *columns).where(F.col("_spine") > 0)
    once = F.when(F.col("_most") > 1, F.raise_error(F.concat(F.lit("more than one row for key "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("int")).otherwise(1)
    return out.where(once == 1).select(key, *owner)
