"""Running totals and exact order statistics without a window over unbounded data.

Values are reduced to distinct ``(groups, value)`` rows first.  Each value gets a coarse and a fine bucket;
running totals are taken over coarse buckets, over the fine buckets of one coarse bucket, and over the values of
one fine bucket, and are then added up.  Values in known bounds get even buckets (``2**RADIX_BITS`` of each kind).
Other values get theirs from their logarithm: 32 coarse buckets per power of two, ``2**RADIX_BITS`` fine ones in each.
An outlier takes a bucket of its own and squeezes no others together: the last window holds only distinct values whose
logarithms agree to 21 bits after the point.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

RADIX_BITS = 16
MOST_GROUPS = 100_000
_COARSE, _FINE = "_coarse", "_fine"


def _before(measures: Sequence[str], partition: list[str], order: list) -> dict[str, Column]:
    window = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return {f"_{m}": F.coalesce(F.sum(m).over(window), F.lit(0)) for m in measures}


def _float_position(v: Column) -> Column:
    """Whole number that rises with a double: its logarithm in steps of ``2**-21``, mirrored below zero.

    The logarithm never falls where its argument rises, so rounding puts values together but never in a wrong order.
    The expression is short on purpose: it runs for every value, and long generated code is never compiled.
    """
    size = F.abs(v)
    step = F.floor(F.log2(size) * 2.0 ** (RADIX_BITS + 5)) + 1100 * 2 ** (RADIX_BITS + 5)
    place = F.when(v == 0, 0).when(F.isnan(v), 1 << 50).when(size == float("inf"), 1 << 49).otherwise(step)
    return F.when(v < 0, -1).otherwise(1) * place


def _float_buckets(v: Column) -> tuple[Column, Column]:
    """Coarse and fine bucket of a double; both rise with the value."""
    position = _float_position(v)
    return F.shiftright(position, RADIX_BITS), position.bitwiseAND(2**RADIX_BITS - 1)


def running_totals(
    rows: DataFrame,
    value: str,
    measures: dict[str, Column],
    groups: Sequence[str] = (),
    ties: Sequence[str] = (),
    bounds: tuple[float, float] | None = None,
) -> DataFrame:
    """Distinct ``(groups, value, ties)`` rows with each measure ``m`` and its total *before* the row, ``m_before``.

    Rows without a value are left out.  ``bounds`` names a known value range (probabilities, hashes).  The distinct rows are
    written once and read by the three levels, so ``rows`` is evaluated once.
    """
    groups, ties, names = list(groups), list(ties), list(measures)
    table = (
        rows.where(F.col(value).isNotNull()).groupBy(*groups, value, *ties)
        .agg(*[expr.alias(name) for name, expr in measures.items()])
    )
    side = 2**RADIX_BITS
    if bounds is None:
        coarse, fine = _float_buckets(F.col(value).cast("double"))
    else:
        low, high = float(bounds[0]), float(bounds[1])
        position = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - F.lit(low)) / F.lit(high - low)))
        coarse = F.least(F.floor(position * side), F.lit(side - 1))
        fine = F.least(F.floor(position * side * side), F.lit(side * side - 1))
    placed = cut_lineage(table.withColumns({_COARSE: coarse, _FINE: fine}))

    fine = placed.groupBy(*groups, _COARSE, _FINE).agg(*[F.sum(m).alias(m) for m in names])
    coarse = fine.groupBy(*groups, _COARSE).agg(*[F.sum(m).alias(m) for m in names])
    coarse = coarse.withColumns(_before(names, groups, [_COARSE])).select(
        *groups, _COARSE, *[F.col(f"_{m}").alias(f"_c_{m}") for m in names])
    fine = fine.withColumns(_before(names, groups + [_COARSE], [_FINE])).join(coarse, groups + [_COARSE]).select(
        *groups, _COARSE, _FINE, *[(F.col(f"_{m}") + F.col(f"_c_{m}")).alias(f"_f_{m}") for m in names])
    located = placed.withColumns(_before(names, groups + [_COARSE, _FINE], [value, *ties]))
    return located.join(fine, groups + [_COARSE, _FINE]).select(
        *groups, value, *ties, *names,
        *[(F.col(f"_{m}") + F.col(f"_f_{m}")).alias(f"{m}_before") for m in names],
    )


def attach(left: DataFrame, right: DataFrame, groups: Sequence[str] = (), how: str = "left") -> DataFrame:
    """Add the columns of a per-group table; without groups ``right`` is one row, read as a scalar subquery.

    Groups are declared dimensions, model columns or classes, often only two for all rows.  The table of groups is therefore
    broadcast and the rows stay where they are; a table of more than ``MOST_GROUPS`` rows is an error.
    """
    if groups:
        fits = F.when(F.col("_group_rows") <= MOST_GROUPS, F.lit(True)).otherwise(
            F.raise_error(F.lit("too many groups for a broadcast table")).cast("boolean"))
        checked = right.withColumn("_group_rows", F.count(F.lit(1)).over(Window.partitionBy())).where(fits).drop("_group_rows")
        return left.join(F.broadcast(checked), list(groups), how)
    packed = right.select(F.struct(*right.columns).alias("_row")).scalar()
    return left.withColumn("_row", packed).select(*left.columns, "_row.*")


def exact_quantiles(
    totals: DataFrame, value: str, count: str, probabilities: Sequence[float], groups: Sequence[str] = ()
) -> DataFrame:
    """Linearly interpolated quantiles per group, read off a running-total table.

    One row per group and probability: ``q`` and ``quantile``.  The position ``(n - 1) * q`` falls between
    two order statistics; both are found by comparing it with the running counts, so no group is ever
    sorted or held by one task.
    """
    groups = list(groups)
    size = totals.groupBy(*groups).agg(F.sum(count).alias("_n"))
    return _interpolated(attach(totals, size, groups), value, count, probabilities, groups)


def _place(q: Column) -> Column:
    return (F.col("_n") - 1) * q


def _holds(count: str, rank: Column) -> Column:
    """Whether the rows of a running-total row stand at ``rank``."""
    return (rank >= F.col(f"{count}_before")) & (rank < F.col(f"{count}_before") + F.col(count))


def _wanted(count: str, probabilities: Sequence[float]) -> Column:
    """The probabilities whose neighbouring ranks the rows of a running-total row hold."""
    return F.filter(
        F.array(*[F.lit(float(q)) for q in probabilities]),
        lambda q: _holds(count, F.floor(_place(q))) | _holds(count, F.ceil(_place(q))))


def _interpolated(sized: DataFrame, value: str, count: str, probabilities: Sequence[float], groups: list[str]) -> DataFrame:
    """Quantiles from running totals that carry the rows of their group, ``_n``."""
    def holds(rank: Column) -> Column:
        return _holds(count, rank)

    hits = sized.withColumn("q", F.explode(_wanted(count, probabilities))).withColumn("_h", _place(F.col("q")))
    picked = hits.groupBy(*groups, "q", "_h").agg(
        F.max(F.when(holds(F.floor("_h")), F.col(value))).alias("_a"),
        F.max(F.when(holds(F.ceil("_h")), F.col(value))).alias("_b"),
    )
    share = F.col("_h") - F.floor("_h")
    return picked.select(
        *groups, "q", (F.col("_a") + (F.col("_b") - F.col("_a")) * share).alias("quantile"))


def bucket_counts(rows: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """``groups, _bucket, rows``: rows per range of values (8,192 per power of two), staged; rows without a value
    have no bucket.  A first pass over any number of values that leaves a short table."""
    return cut_lineage(rows.groupBy(*groups, _bucket(value).alias("_bucket")).agg(F.count(F.lit(1)).alias("rows")))


def _bucket(value: str) -> Column:
    return F.when(F.col(value).isNotNull(), F.shiftright(_float_position(F.col(value).cast("double")), 8))


def bucket_quantiles(
    rows: DataFrame, counts: DataFrame, value: str, probabilities: Sequence[float], groups: Sequence[str] = ()
) -> DataFrame:
    """The quantiles of :func:`exact_quantiles` in a second pass over ``rows``, given their :func:`bucket_counts`.

    The counts tell which buckets hold the wanted ranks (two per group and probability at most, so the table of them is
    broadcast); only values inside these are told apart and moved.
    """
    groups = list(groups)
    known = counts.where("_bucket IS NOT NULL")
    before = known.withColumns(_before(["rows"], groups, ["_bucket"])).withColumnRenamed("_rows", "rows_before")
    sized = attach(before, known.groupBy(*groups).agg(F.sum("rows").alias("_n")), groups)
    chosen = sized.where(F.size(_wanted("rows", probabilities)) > 0).select(*groups, "_bucket", "rows_before", "_n")
    inside = rows.withColumn("_bucket", _bucket(value)).join(F.broadcast(chosen), [*groups, "_bucket"]).groupBy(
        *groups, "_bucket", "rows_before", "_n", value).agg(F.count(F.lit(1)).alias("rows"))
    totals = inside.withColumns(_before(["rows"], [*groups, "_bucket"], [value])).withColumn(
        "rows_before", F.col("rows_before") + F.col("_rows"))
    return _interpolated(totals, value, "rows", probabilities, groups)


def average_ranks(rows: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Rank of every distinct value, ties sharing their average rank (1-based)."""
    totals = running_totals(rows, value, {"n": F.count(F.lit(1))}, groups)
    return totals.select(*groups, value, "n", (F.col("n_before") + (F.col("n") + 1) / 2).alias("rank"))


HOT_SHARE = 1_000


def with_ranks(rows: DataFrame, value: str, groups: Sequence[str], output: str) -> DataFrame:
    """Every row with the average rank of its value in its group; rows without a value are left out.

    Values that at least one in ``HOT_SHARE`` rows of their group have (so at most that many a group) are looked up in a
    broadcast table; only the others are joined by value, and none of those is frequent.  ``rows`` is read twice: give a
    staged table.
    """
    groups = list(groups)
    ranks = cut_lineage(average_ranks(rows, value, groups))
    sizes = ranks.groupBy(*groups).agg(F.sum("n").alias("_group_size"))
    sized = attach(ranks, sizes, groups)
    hot = F.col("n") * HOT_SHARE >= F.col("_group_size")
    keys = [*groups, value]
    known = rows.where(F.col(value).isNotNull())
    frequent = F.broadcast(sized.where(hot).select(*keys, F.col("rank").alias(output)))  # HOT_SHARE rows a group at most
    looked_up = known.join(frequent, keys, "left")
    rest = looked_up.where(F.col(output).isNull()).drop(output).join(
        sized.where(~hot).select(*keys, F.col("rank").alias(output)), keys)
    columns = [*rows.columns, output]
    return looked_up.where(F.col(output).isNotNull()).select(*columns).unionByName(rest.select(*columns))
