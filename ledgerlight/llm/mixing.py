"""Mixing sources to target weights by proportionate-fair block scheduling, in DataFrame functions only.

Every source is a stream of its documents in a hashed order, cut into blocks of ``BLOCK_CHARS`` characters (a document
belongs to the block in which it starts).  The ideal mixture serves all live sources at once, each at its weight; where
one runs out the others grow in proportion.  A source of weight ``w`` and ``n`` blocks has had ``min(n, w v)`` blocks
at virtual time ``v``, so slot time is the concave line ``t(v)`` that these add up to.  Block ``j`` is released at
``floor(t(j / w))`` and due at ``ceil(t((j + 1) / w))``; the released block with the earliest deadline takes the next
slot.  Every block is placed inside its window, so at every slot each source has had less than one block more or
less than its weight says.  All windows are exact: weights are whole numbers out of ``WHOLE``.

Slots are scheduled in cycles, side by side.  A cycle is at least as long as the longest window, so a block reaches
over one cycle end at most.  Which of the blocks across an end ``T`` come before it is settled first: of those
released last the ideal has served some amount by ``T``; no more than that, rounded up, may come before, for each
release; of what this allows the earliest deadlines are taken.  The choice fits the slots on both sides (the ideal
shares meet every bound, and taking by deadline takes at least as many of each deadline as any other choice).
Nothing is dropped or repeated.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

BLOCK_CHARS = 65_536
CYCLE_BLOCKS = 512
WHOLE = 1 << 31
LEAST_SHARE = 1 / 16_384


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))  # null is a source of its own


def _sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, key, size, mark`` for every row, written once; ``mark`` spreads rows without id, too."""
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long") + 1
    row = F.monotonically_increasing_id()
    mark = F.when(F.col("doc_id").isNull(), F.xxhash64(row, F.lit("mix"))).otherwise(F.xxhash64("doc_id", F.lit("mix")))
    return stage(docs.select("doc_id", "source", _key().alias("key"), size.alias("size"), mark.alias("mark")), "mix-rows")


def _placed(sized: DataFrame) -> DataFrame:
    """Rows with ``start``: the characters of the source's stream before the document.

    The running total is taken over two levels of hash buckets (4,096 rows each at most) and inside the small
    buckets, so a hot source is spread like any other.
    """
    rows = sized.withColumns({
        "coarse": F.shiftrightunsigned("mark", 52), "fine": F.shiftrightunsigned("mark", 40).bitwiseAND(F.lit(4095))})
    fine = rows.groupBy("key", "coarse", "fine").agg(F.sum("size").alias("sum"))
    coarse = fine.groupBy("key", "coarse").agg(F.sum("sum").alias("sum"))

    def before(name: str, partition: list[str], order: list[str]) -> Column:
        span = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(name).over(span), F.lit(0))

    coarse = coarse.select("key", "coarse", before("sum", ["key"], ["coarse"]).alias("coarse_before"))
    fine = fine.withColumn("fine_before", before("sum", ["key", "coarse"], ["fine"])).drop("sum").join(
        coarse, ["key", "coarse"])
    inside = before("size", ["key", "coarse", "fine"], ["mark", "doc_id", "size"])
    return rows.withColumn("inside", inside).join(fine, ["key", "coarse", "fine"]).select(
        "doc_id", "source", "key", (F.col("inside") + F.col("fine_before") + F.col("coarse_before")).alias("start"))


def _shares(sized: DataFrame, weights: Mapping[str, float] | None, block: int) -> DataFrame:
    """One row per source: ``key``, weight ``w`` out of ``WHOLE`` and blocks ``n``."""
    totals = sized.groupBy("key").agg(F.sum("size").alias("total"))
    if weights is None:
        weight = F.sqrt("total")
    else:
        named = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (f"={k}", float(v))])
        weight = F.coalesce(F.try_element_at(named, F.col("key")), F.lit(0.0))
    whole = Window.partitionBy()  # one row per source
    share = F.greatest(F.col("weight") / F.greatest(F.sum("weight").over(whole), F.lit(1e-300)), F.lit(LEAST_SHARE))
    return totals.withColumn("weight", weight).select(
        "key", F.round(share * WHOLE).cast("long").alias("w"),
        (F.floor((F.col("total") - 1) / block) + 1).cast("long").alias("n"))


def _lines(shares: DataFrame) -> DataFrame:
    """One row: ``lines``, the pieces of ``t(v)`` in order, and ``slots``, the least cycle for these weights.

    Piece ``done + live v`` ends where the source with ``n`` blocks of weight ``w`` runs out.
    """
    packed = shares.groupBy().agg(F.collect_list(F.struct("w", "n", "key")).alias("all")).where("size(all) > 0")
    return packed.selectExpr(
        # by n / w, compared without division
        "array_sort(all, (a, b) -> CASE WHEN a.n * b.w < b.n * a.w THEN -1 WHEN a.n * b.w > b.n * a.w THEN 1 ELSE 0 END) AS ends",
        "aggregate(all, 0L, (a, s) -> a + s.w) AS whole", "array_min(transform(all, s -> s.w)) AS least",
    ).selectExpr(
        "whole div least + 3 AS slots",
        "aggregate(ends, named_struct('done', 0L, 'live', whole, 'out', cast(array() as "
        "array<struct<done:bigint,live:bigint,w:bigint,n:bigint>>)), (a, s) -> named_struct('done', a.done + s.n, "
        "'live', a.live - s.w, 'out', concat(a.out, array(named_struct('done', a.done, 'live', a.live, 'w', s.w, 'n', s.n)))),"
        " a -> a.out) AS lines")


def _windows(shares: DataFrame, lines: DataFrame) -> DataFrame:
    """``key, j, w, release, deadline`` for every block of every source.

    A source's blocks are dealt by the piece in which they start; the last of a piece may end in a later one, and
    then the lowest piece says when.
    """
    per = shares.withColumn("lines", lines.select("lines").scalar())
    spans = per.selectExpr("key", "w", "n", "lines", """explode(filter(transform(lines, (l, g) -> named_struct(
        'done', l.done, 'live', l.live,
        'a', if(g = 0, 0L, (lines[g - 1].n * w + lines[g - 1].w - 1) div lines[g - 1].w),
        'b', least(n, (l.n * w + l.w - 1) div l.w))), s -> s.a < s.b)) AS span""")
    ends = spans.selectExpr("key", "w", "span", """array_min(transform(lines, l ->
        l.done + (l.live * span.b + w - 1) div w)) AS last_end""")
    return ends.selectExpr("key", "w", "span", "last_end", "explode(sequence(span.a, span.b - 1)) AS j").selectExpr(
        "key", "j", "w", "span.done + span.live * j div w AS release",
        "if(j + 1 = span.b, last_end, span.done + (span.live * (j + 1) + w - 1) div w) AS deadline")


# Of the blocks across a cycle end, latest release first: as many as the ideal has served of them, by deadline.
_BEFORE_END = """aggregate(
  array_sort(collect_list(named_struct('back', -release, 'deadline', deadline, 'key', key, 'j', j, 'part', part))),
  named_struct('part', 0L, 'kept', cast(array() as array<struct<deadline:bigint,key:string,j:bigint>>)),
  (a, x) -> named_struct('part', a.part + x.part, 'kept', slice(
    array_sort(concat(a.kept, array(named_struct('deadline', x.deadline, 'key', x.key, 'j', x.j)))),
    1, cast((a.part + x.part + live - 1) div live as int))),
  a -> a.kept)"""

# Earliest deadline first: ``due`` lists a cycle's blocks by release.
_SLOTS = """aggregate(
  sequence(0, aggregate(due, 0, (n, d) -> n + size(d.blocks)) - 1),
  named_struct('at', 0, 'open', cast(array() as array<struct<deadline:bigint,key:string,j:bigint>>),
               'picks', cast(array() as array<struct<key:string,j:bigint>>)),
  (s, t) -> element_at(transform(array(
    if(get(due, s.at).release = start + t, array_sort(concat(s.open, get(due, s.at).blocks)), s.open)),
    open -> named_struct('at', if(get(due, s.at).release = start + t, s.at + 1, s.at), 'open', slice(open, 2, size(open)),
      'picks', concat(s.picks, array(named_struct('key', open[0].key, 'j', open[0].j))))), 1),
  s -> s.picks)"""


def _slots(shares: DataFrame, cycle: int) -> DataFrame:
    """``key, block, slot, release, deadline`` for every block."""
    lines = stage(_lines(shares), "mix-lines")  # one row
    first = lines.first()
    cycle = max(cycle, first["slots"] if first else 0)
    windows = stage(_windows(shares, lines), "mix-windows").withColumns({
        "cycle": F.expr(f"release div {cycle}"), "edge": F.expr(f"(release div {cycle} + 1) * {cycle}")})
    across = windows.where("deadline > edge")  # a window is no longer than a cycle, so this is its only end
    ends = across.select("edge").distinct().withColumn("lines", lines.select("lines").scalar()).selectExpr(
        "edge AS at", "filter(lines, l -> (edge - l.done) * l.w <= l.n * l.live)[0] AS line").select("at", "line.done", "line.live")
    early = across.join(ends, F.col("edge") == F.col("at")).withColumn(
        "part", F.expr("w * (edge - done) - j * live")).groupBy("edge", "live").agg(F.expr(_BEFORE_END).alias("kept")).select(
        F.explode("kept").alias("k")).select("k.key", "k.j", F.lit(True).alias("early"))
    settled = across.join(early, ["key", "j"], "left").selectExpr(
        "key", "j", "if(early, cycle, cycle + 1) AS cycle", "if(early, release, edge) AS ready", "if(early, edge, deadline) AS due")
    inner = windows.where("deadline <= edge").selectExpr("key", "j", "cycle", "release AS ready", "deadline AS due")
    lists = settled.unionByName(inner).groupBy("cycle", "ready").agg(
        F.collect_list(F.struct(F.col("due").alias("deadline"), "key", "j")).alias("blocks"))
    rows = lists.groupBy("cycle").agg(F.array_sort(F.collect_list(F.struct(F.col("ready").alias("release"), "blocks"))).alias("due"))
    picked = rows.withColumn("start", F.col("cycle") * cycle).selectExpr("start", f"posexplode({_SLOTS}) AS (t, pick)")
    return picked.selectExpr("pick.key AS key", "pick.j AS j", "start + t AS slot").join(windows, ["key", "j"]).selectExpr(
        "key", "j AS block", "slot", "release", "deadline")


def schedule(
    docs: DataFrame, weights: Mapping[str, float] | None = None,
    cycle: int = CYCLE_BLOCKS, block: int = BLOCK_CHARS,
) -> DataFrame:
    """``doc_id, source, block, slot, release, deadline, place`` for every row of ``docs(doc_id, text, source, ...)``.

    Reading by ``slot``, then ``place`` (the characters before the document in its block), gives the mixture.
    ``weights`` maps sources to target weights; without ``weights`` each source weighs the square root of its
    characters.  A source with less than ``LEAST_SHARE`` of the weights, or without one, gets that share.  Null sources
    form one source; null texts count one character; repeated rows are rows.  A cycle has at least ``cycle`` slots, and
    more where a rare source needs them.  Any number of sources is taken; work grows with the square of their number.
    An empty table gives no rows.
    """
    sized = _sized(docs)
    slots = _slots(stage(_shares(sized, weights, block), "mix-shares"), cycle)
    placed = _placed(sized).withColumns({
        "block": F.floor(F.col("start") / block), "place": F.col("start") % block}).drop("start")
    return placed.join(slots, ["key", "block"]).select(
        "doc_id", "source", "block", "slot", "release", "deadline", "place")


def order_of(docs: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """``doc_id, slot, place``: where each ``doc_id`` of ``docs`` stands in the mixture, one row for each."""
    return schedule(docs, weights).where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("slot").alias("slot"), F.min_by("place", "slot").alias("place"))


def in_mixture_order(docs: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """All rows of ``docs`` with their columns, sorted into the mixture across the files they are written to.

    Rows without ``doc_id`` go last.
    """
    order = order_of(docs, weights)
    rows = docs.select("doc_id", F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    ordered = rows.join(order.hint("merge"), "doc_id", "left")  # grows with the documents: never a table to broadcast
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    keys = [F.col("slot").asc_nulls_last(), F.col("place").asc_nulls_last()]
    return ordered.repartitionByRange(int(parts), *keys).sortWithinPartitions(*keys).select(
        *[F.col("row")[c].alias(c) for c in docs.columns])
