"""Group-wise ordering, running values and exact quantiles that survive hot keys.

A plain window puts a whole group into one task.  That is right for the many
ordinary groups, and wrong for a key that holds a third of all rows.  Every
function here therefore counts the groups once (a map-side combined
aggregate), leaves the ordinary ones to a normal window, and range-slices the
hot ones: rows sorted by (key, order) are cut into slices, each slice is
scanned on its own, and what earlier slices contribute is carried in from a
table with one row per (key, slice).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slabspark.session import materialize

HOT_ROWS_CONF = "spark.slabspark.hotGroupRows"
HOT_ROWS = 2_000_000

Order = Sequence[tuple[str, bool]]  # (column, ascending); must end in a unique column


def hot_limit(df: DataFrame) -> int:
    """Largest group a single task may be handed."""
    return int(df.sparkSession.conf.get(HOT_ROWS_CONF, str(HOT_ROWS)))


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame | None:
    """Keys of the groups above the limit, or None.

    One map-side combined count over the key columns answers the usual "none".
    Otherwise at most (rows / limit) keys qualify, so the written table stays
    small and Catalyst broadcasts it by its file size.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = counted.where(F.col("_n") > (hot_limit(df) if limit is None else limit)).drop("_n")
    return None if hot.isEmpty() else materialize(hot, "hot")


def split_hot(df: DataFrame, keys: Sequence[str], bound: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(ordinary groups, hot groups or None).

    ``bound`` may name a cheaper table whose groups are at least as large; it
    is counted instead of ``df``.
    """
    hot = hot_groups(df if bound is None else bound, keys)
    if hot is None:
        return df, None
    cond = same_keys(df, hot, keys)
    return df.join(hot, cond, "left_anti"), df.join(hot, cond, "left_semi")


def _sort(order: Order) -> list[Column]:
    return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in order]


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Order,
    sums: dict[str, Column] | None = None,
    lags: dict[str, tuple[str, int]] | None = None,
    lasts: dict[str, str] | None = None,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Add running values per group, in a total order.

    ``sums``  name -> expression, inclusive running total
    ``lags``  name -> (column, offset), value ``offset`` rows earlier
    ``lasts`` name -> column, latest non-null value up to and including the row
              (all-ascending orders only)
    ``bound`` is passed on to ``split_hot``.
    """
    sums, lags, lasts = sums or {}, lags or {}, lasts or {}
    if lasts and not all(up for _, up in order):
        raise ValueError("carried values need an ascending order")
    ordinary, hot = split_hot(df, keys, bound)
    window = Window.partitionBy(*keys).orderBy(*_sort(order))
    rows = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ordinary.select(
        "*",
        *[F.sum(e).over(rows).alias(n) for n, e in sums.items()],
        *[F.lag(c, k).over(window).alias(n) for n, (c, k) in lags.items()],
        *[F.last(c, ignorenulls=True).over(rows).alias(n) for n, c in lasts.items()],
    )
    if hot is None:
        return out
    return out.unionByName(_sliced_scan(hot, keys, order, sums, lags, lasts))


def _sliced_scan(df, keys, order, sums, lags, lasts) -> DataFrame:
    columns = df.columns
    staged = df.select("*", *[e.alias(f"_in_{n}") for n, e in sums.items()])
    # Slices follow the sort order; the number is physical, so it is written.
    sliced = materialize(
        staged.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], *_sort(order))
        .withColumn("_slice", F.spark_partition_id()),
        "slices",
    )
    position = F.struct(*[F.col(c) for c, _ in order])
    per_slice = sliced.groupBy(*keys, "_slice").agg(
        *[F.sum(f"_in_{n}").alias(f"_sum_{n}") for n in sums],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(f"_last_{n}") for n, c in lasts.items()],
        F.count(F.lit(1)).alias("_rows"),
    )
    # One row per (key, slice): never more than the number of slices per key.
    before = Window.partitionBy(*keys).orderBy("_slice")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    carry = per_slice.select(
        *keys, "_slice",
        *[F.sum(f"_sum_{n}").over(earlier).alias(f"_carry_{n}") for n in sums],
        *[F.last(f"_last_{n}", ignorenulls=True).over(earlier).alias(f"_carry_{n}") for n in lasts],
    )
    body = sliced.withColumn("_halo", F.lit(False))
    depth = max((k for _, k in lags.values()), default=0)
    if depth:
        body = body.unionByName(_halo(sliced, per_slice, keys, order, depth))
    carry = carry.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slice").alias("_k_slice"),
                         *[f"_carry_{n}" for n in (*sums, *lasts)])
    cond = reduce(lambda a, b: a & b, [body[k].eqNullSafe(carry[f"_k_{k}"]) for k in keys])
    joined = body.join(carry, (body["_slice"] == carry["_k_slice"]) & cond, "left")
    window = Window.partitionBy(*keys, "_slice").orderBy(*_sort(order))
    rows = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = ~F.col("_halo")
    return joined.select(
        *columns, "_halo",
        *[_added(F.col(f"_carry_{n}"), F.sum(F.when(own, F.col(f"_in_{n}"))).over(rows)).alias(n) for n in sums],
        *[F.lag(c, k).over(window).alias(n) for n, (c, k) in lags.items()],
        *[F.coalesce(F.last(F.when(own, F.col(c)), ignorenulls=True).over(rows), F.col(f"_carry_{n}")).alias(n)
          for n, c in lasts.items()],
    ).where(own).drop("_halo")


def _added(carry: Column, here: Column) -> Column:
    """Sum of two sums, of which either may have seen no value yet."""
    return F.when(carry.isNull(), here).when(here.isNull(), carry).otherwise(carry + here)


def _halo(sliced, per_slice, keys, order, depth) -> DataFrame:
    """Last ``depth`` rows of each slice, copied into the next ``depth`` slices of the key."""
    flipped = [F.col(c).desc_nulls_last() if up else F.col(c).asc_nulls_first() for c, up in order]
    tail = Window.partitionBy(*keys, "_slice").orderBy(*flipped)
    tails = sliced.withColumn("_rn", F.row_number().over(tail)).where(F.col("_rn") <= depth).drop("_rn")
    ahead = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(1, depth)
    following = per_slice.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slice").alias("_from"),
        F.collect_list("_slice").over(ahead).alias("_next"),
    ).withColumn("_to", F.explode("_next"))
    cond = reduce(lambda a, b: a & b, [tails[k].eqNullSafe(following[f"_k_{k}"]) for k in keys])
    copied = tails.join(following, (tails["_slice"] == following["_from"]) & cond)
    return copied.select(*[tails[c] for c in sliced.columns if c != "_slice"], F.col("_to").alias("_slice"),
                         F.lit(True).alias("_halo"))


def row_numbers(df: DataFrame, keys: Sequence[str], order: Order, name: str) -> DataFrame:
    return ordered_scan(df, keys, order, sums={name: F.lit(1).cast("bigint")})


def competition_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """RANK() OVER (PARTITION BY keys ORDER BY value DESC NULLS LAST).

    Ordinary groups use the window.  In a hot group equal values are counted
    first, so ties never pile up in one slice; the rank is one plus the rows
    strictly ahead.
    """
    ordinary, hot = split_hot(df, keys)
    window = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last())
    out = ordinary.withColumn(name, F.rank().over(window).cast("bigint"))
    if hot is None:
        return out
    counted = hot.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ordered_scan(counted, keys, [(value, False)], sums={"_upto": F.col("_n")}).select(
        *[F.col(c).alias(f"_k_{c}") for c in (*keys, value)], (F.col("_upto") - F.col("_n") + 1).alias(name))
    cond = reduce(lambda a, b: a & b, [hot[c].eqNullSafe(ranked[f"_k_{c}"]) for c in (*keys, value)])
    return out.unionByName(hot.join(ranked, cond).select(*df.columns, name))


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """Exact linearly interpolated percentiles, one row per group.

    The built-in aggregate keeps every distinct value of a group in one task.
    Hot groups instead get counts per (key, value), a running total over them,
    and the two neighbouring order statistics picked by position.
    """
    kept = df.select(*keys, value).where(F.col(value).isNotNull())
    ordinary, hot = split_hot(kept, keys)
    out = ordinary.groupBy(*keys).agg(
        *[F.percentile(value, F.lit(p)).alias(n) for n, p in probabilities.items()])
    if hot is None:
        return out
    counted = hot.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = ordered_scan(counted, keys, [(value, True)], sums={"_upto": F.col("_n")})
    sizes = hot.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    sizes = sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_size")
    cond = reduce(lambda a, b: a & b, [upto[k].eqNullSafe(sizes[f"_k_{k}"]) for k in keys])
    placed = upto.join(F.broadcast(sizes), cond)  # one row per hot group: at most rows / limit
    picks = []
    for n, p in probabilities.items():
        spot = F.lit(float(p)) * (F.col("_size") - 1)
        # smallest value whose running count exceeds the position
        picks.append(F.min(F.when(F.col("_upto") > F.floor(spot), F.col(value))).alias(f"_lo_{n}"))
        picks.append(F.min(F.when(F.col("_upto") > F.ceil(spot), F.col(value))).alias(f"_hi_{n}"))
    edges = placed.groupBy(*keys).agg(F.first("_size").alias("_size"), *picks)
    cols = []
    for n, p in probabilities.items():
        spot = F.lit(float(p)) * (F.col("_size") - 1)
        cols.append((F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (spot - F.floor(spot)))
                    .cast("double").alias(n))
    return out.unionByName(edges.select(*keys, *cols))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per group.

    Spark prunes to k rows per key before the shuffle (window group limit), so
    a hot key sends at most k rows per map task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the greatest by ``order``; combined map-side, no window."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    kept = df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_row"))
    return kept.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def _hash_buckets(df: DataFrame, ids: str, seed: str) -> tuple[DataFrame, DataFrame]:
    """(distinct ids with hash and prefix, id counts and running counts per prefix).

    Ids are ordered by md5(seed|id).  Counts per 4-digit hash prefix (65,536
    rows at most) carry the order, so no global sort runs in one task.
    """
    hashed = df.select(ids).where(F.col(ids).isNotNull()).distinct().withColumn(
        "_h", F.md5(F.concat_ws("|", F.lit(seed), F.col(ids).cast("string")))
    ).withColumn("_p", F.substring("_h", 1, 4))
    counts = hashed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    return hashed, counts.withColumn("_upto", F.sum("_n").over(upto))


def global_positions(df: DataFrame, ids: str, seed: str, name: str = "position") -> DataFrame:
    """0-based position of each distinct id in a seeded pseudo-random order."""
    hashed, buckets = _hash_buckets(df, ids, seed)
    local = Window.partitionBy("_p").orderBy("_h", ids)
    before = buckets.select("_p", (F.col("_upto") - F.col("_n")).alias("_before"))
    return hashed.join(F.broadcast(before), "_p").select(  # at most 65,536 rows
        ids, (F.col("_before") + F.row_number().over(local) - 1).alias(name))


def hash_cut(df: DataFrame, ids: str, fraction: float, seed: str):
    """Last (h, id) of the first max(1, floor(fraction * n)) ids in seeded order, or None.

    Only the one prefix that holds the cut is ranked (about n / 65,536 ids).
    """
    hashed, buckets = _hash_buckets(df, ids, seed)
    buckets = materialize(buckets, "prefixes")
    total = buckets.agg(F.max("_upto")).first()[0]
    if not total:
        return None
    wanted = max(1, int(total * fraction))
    hit = buckets.where((F.col("_upto") >= wanted) & (F.col("_upto") - F.col("_n") < wanted)).first()
    place = wanted - (hit["_upto"] - hit["_n"])
    inside = hashed.where(F.col("_p") == hit["_p"]).orderBy("_h", ids).offset(place - 1).limit(1)
    return inside.select(F.col("_h").alias("h"), F.col(ids).alias("id")).first()
