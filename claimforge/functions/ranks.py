"""Exact quantiles and running sums over values of any number, without a task or a buffer that holds them all.

Values fall into slots in their own order: between cuts that a quantile sketch takes from the values themselves, and there by a fixed rule. Slots
are counted first; what stands before a slot comes from these counts (a small grid), what stands before a value inside its slot from a window over that
slot alone. However close together values lie, a slot between two cuts holds about one in CUTS of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots for each e-fold of an amount: neighbours are 1.6 % apart; all finite doubles make 90,000 slots at most.
SLOTS = 64
#: Slots of scores between 0 and 1.
SCORE_SLOTS = 4096


#: Slots that the sketch's cuts make: a square, so that a search is two short ones.
CUTS = 256
SIDE = 16


def cuts_of(df: DataFrame, value: Column) -> DataFrame:
    """One row: cuts, an array of CUTS - 1 doubles that deal the values into slots of about equal numbers (null without values)."""
    shares = [i / CUTS for i in range(1, CUTS)]
    return df.agg(F.percentile_approx(value.cast("double"), shares, 10_000).alias("_cuts"))


def between_cuts(df: DataFrame, value: Column, cuts: DataFrame, name: str = "_place") -> DataFrame:
    """df with the number of cuts below the value: a search among every SIDE-th cut, then one among those between."""
    v = value.cast("double")

    def search(low: int, high: int, cut) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(v > cut(middle), search(middle + 1, high, cut)).otherwise(search(low, middle, cut))

    coarse = df.join(F.broadcast(cuts), how="cross").withColumn("_part", search(0, SIDE - 1, lambda i: F.get("_cuts", F.lit(SIDE * i + SIDE - 1))))
    fine = search(0, SIDE - 1, lambda i: F.get("_cuts", F.col("_part") * SIDE + i))
    return coarse.withColumn(name, F.col("_part") * SIDE + fine).drop("_part", "_cuts")


def slot_of(v: Column) -> Column:
    """A whole number that never falls where the value rises."""
    return F.signum(v) * F.floor(F.log1p(F.abs(v)) * SLOTS)


def score_slot(v: Column) -> Column:
    return F.floor(v * SCORE_SLOTS)


def running(df: DataFrame, value: str, slot: Column, *sums: str, keys: tuple[str, ...] = (), wanted: Column | None = None) -> DataFrame:
    """df, of one row for each (keys, value), with <sum>_before (rows of smaller value) and <sum>_all for each sum column.

    wanted drops whole slots by what stands before and in them (<sum>_from, <sum>_in, <sum>_all) before their rows are ordered.
    """
    # the condition keeps the sums among the columns read, so that the cuts come from the same exchange as the rows
    cuts = cuts_of(df.where(" and ".join(f"{s} >= 0" for s in sums)), F.col(value))
    placed = between_cuts(df, F.col(value), cuts).withColumn("slot", F.struct(F.col("_place"), slot.alias("_slot"))).drop("_place")
    grid = placed.groupBy(*keys, "slot").agg(*(F.sum(s).alias(f"{s}_in") for s in sums))
    before = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    grid = grid.withColumns({f"{s}_from": F.coalesce(F.sum(f"{s}_in").over(before), F.lit(0)) for s in sums} | {f"{s}_all": F.sum(f"{s}_in").over(every) for s in sums})
    if wanted is not None:
        grid = grid.where(wanted)
    inside = Window.partitionBy(*keys, "slot").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(grid, [*keys, "slot"])
    return out.withColumns({f"{s}_before": F.col(f"{s}_from") + F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums}).drop("slot", *(f"{s}_{x}" for s in sums for x in ("in", "from")))


def quantiles(df: DataFrame, value: Column, keys: tuple[str, ...] = (), **shares: float) -> DataFrame:
    """keys and a column for each share: exact quantiles, interpolated between neighbours as percentile() does.

    Nulls and NaN have no place in the order and are left out; a group without values has no row, but without keys there is always
    one row (of nulls). Keys are never null in the result: rows with a null key are left out.
    """
    v = value.cast("double")
    rows = df.select(*keys, v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return quantiles_of_counts(rows.groupBy(*keys, "v").agg(F.count("*").alias("n")), keys, **shares)


def quantiles_of_counts(counts: DataFrame, keys: tuple[str, ...] = (), **shares: float) -> DataFrame:
    """quantiles() of the doubles v that counts has n times each: one row for each (keys, v), none of them null or NaN. It is read more than once."""
    at = lambda p: F.lit(float(p)) * (F.col("n_all") - 1)
    ends = [f(at(p)).cast("long") for p in shares.values() for f in (F.floor, F.ceil)]
    covers = F.lit(False)
    for end in ends:
        covers = covers | ((F.col("n_from") <= end) & (end < F.col("n_from") + F.col("n_in")))
    placed = running(counts, "v", slot_of(F.col("v")), "n", keys=keys, wanted=covers)
    held = lambda end: F.max(F.when((F.col("n_before") <= end) & (end < F.col("n_before") + F.col("n")), F.col("v")))
    out = placed.groupBy(*keys).agg(F.max("n_all").alias("n_all"), *(held(f(at(p)).cast("long")).alias(f"{name}_{side}") for name, p in shares.items() for side, f in (("low", F.floor), ("high", F.ceil))))

    def between(name: str, p: float) -> Column:
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        return F.when(low == high, low).otherwise((F.ceil(at(p)) - at(p)) * low + (at(p) - F.floor(at(p))) * high)

    return out.select(*keys, *(between(name, p).alias(name) for name, p in shares.items()))
