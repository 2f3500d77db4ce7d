"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the ``K`` smallest distinct 48-bit hashes of a text's five-word shingles (a shorter text
is one shingle; no words, no hashes).  Sketches of parts merge into the sketch of the whole, and estimate resemblance,
containment and the number of distinct shingles.  The string form has twelve hexadecimal digits a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WORDS, BITS = 128, 5, 48
MOST_RANGES, SEARCH_STEP = 65_536, 256


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def shingle_hashes(tokens: Column, n: int = WORDS) -> Column:
    """Hashes of all shingles of an array of words, repeats included."""
    count = F.size(tokens)
    cut = 64 - BITS
    full = F.transform(
        F.sequence(F.lit(0), count - n),
        lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(tokens, i + j) for j in range(n)]), cut))
    short = F.array(F.shiftrightunsigned(F.xxhash64(F.array_join(tokens, " ")), cut))
    return F.when(count >= n, full).when(count > 0, short).otherwise(F.array().cast("array<bigint>"))


def smallest(hashes: Column, k: int = K) -> Column:
    """The sketch of a collection of hashes."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches stand for."""
    return smallest(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles in all shingles of two texts; two empty texts are alike."""
    both = merge(a, b, k)
    common = F.array_intersect(both, F.array_intersect(a, b))
    return F.when(F.size(both) > 0, F.size(common) / F.size(both)).otherwise(1.0)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    last = F.element_at(a, -1).cast("double") / float(1 << BITS)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / last)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first text's shingles that the second one has, too; an empty text is contained."""
    common = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) > 0, F.least(F.lit(1.0), common / distinct_shingles(a, k))).otherwise(1.0)


def as_text(sketch: Column) -> Column:
    return F.lower(F.array_join(F.transform(sketch, lambda v: F.lpad(F.hex(v), BITS // 4, "0")), ""))


def fingerprint(docs: DataFrame) -> DataFrame:
    """``docs`` with ``sketch``, of its column ``text``."""
    return docs.withColumn("_words", words(F.col("text"))).withColumn("_hashes", shingle_hashes(F.col("_words"))).withColumn(
        "sketch", smallest(F.col("_hashes"))).drop("_words", "_hashes")


def id_ranges(ids: DataFrame) -> list[int]:
    """Largest ids of evenly filled ranges of ids, in descending order; at most ``MOST_RANGES``.

    Spark's own range partitioning finds the ranges, over ids alone.
    """
    parts = 4 * int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ids.where("doc_id IS NOT NULL").select("doc_id").repartitionByRange(min(parts, MOST_RANGES), F.desc("doc_id"))
    tops = dealt.groupBy(F.spark_partition_id().alias("range")).agg(F.max("doc_id").alias("top")).collect()
    return sorted({r["top"] for r in tops}, reverse=True)


def range_of(doc_id: Column, tops: list[int]) -> Column:
    """Number of an id's range, by a search in two steps."""
    rows = [tops[at: at + SEARCH_STEP] for at in range(0, len(tops), SEARCH_STEP)]
    heads = F.array(*[F.lit(r[0]) for r in rows])
    lists = F.array(*[F.array(*[F.lit(t) for t in r]) for r in rows])

    def reached(values: Column) -> Column:
        return F.size(F.filter(values, lambda top: top >= doc_id)) - 1

    step = reached(heads)
    return step * SEARCH_STEP + reached(F.get(lists, step))


def with_next(rows: DataFrame) -> DataFrame:
    """``doc_id, text, sketch, next_text, next_sketch`` of rows with distinct ids (or none, without a next one).

    Texts move once: every id range is one window, and the first row of a range is shown to the range before it, too.
    """
    tops = id_ranges(rows) or [0]
    block = F.when(F.col("doc_id").isNotNull(), range_of(F.col("doc_id"), tops)).otherwise(
        -1 - F.pmod(F.xxhash64("text"), F.lit(len(tops))).cast("int"))
    placed = rows.select("doc_id", "text", block.alias("block"))
    top = F.get(F.array(*[F.lit(t) for t in tops]), F.col("block")) == F.col("doc_id")
    own = F.struct("block", F.lit(False).alias("shown"))
    before = F.struct(F.pmod(F.col("block") - 1, F.lit(len(tops))).alias("block"), F.lit(True).alias("shown"))
    shown = placed.select("doc_id", "text", F.explode(F.when(top, F.array(own, before)).otherwise(F.array(own))).alias("at"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shown.select("doc_id", "text", "at.*").repartition(parts, "block")
    order = Window.partitionBy("block").orderBy("shown", F.desc("doc_id"))
    both = fingerprint(dealt).withColumns({
        "next_text": F.lead("text").over(order), "next_sketch": F.lead("sketch").over(order)})
    known = F.col("doc_id").isNotNull()
    return both.where(~F.col("shown")).select(
        "doc_id", "text", "sketch", F.when(known, F.col("next_text")).alias("next_text"),
        F.when(known, F.col("next_sketch")).alias("next_sketch"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs(doc_id, text, ...)`` and of its edited text.

    The edited text has its last ``floor(n / 2)`` code points replaced by the first as many (or all) of the next document
    in descending ``doc_id`` order, the first document being next to the last.  Where ids repeat, the next document is
    the row of the next smaller id with the smallest text; rows without ``doc_id`` have an empty next document.  Null
    texts are empty; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    named = rows.where("doc_id IS NOT NULL")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        own = with_next(rows)
    else:
        nexts = with_next(named.groupBy("doc_id").agg(F.min("text").alias("text"))).select("doc_id", "next_text", "next_sketch")
        own = fingerprint(rows.join(nexts, "doc_id", "left"))
    own = own.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substr(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half),
        F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    both = fingerprint(own.withColumnRenamed("sketch", "own_sketch").withColumn("text", edited).drop("next_text"))
    return both.select(
        "doc_id", "n_chars", F.sha2("text", 256).alias("edited_sha256"),
        as_text(F.col("own_sketch")).alias("fingerprint"), as_text(F.col("sketch")).alias("edited_fingerprint"),
        resemblance(F.col("own_sketch"), F.col("sketch")).alias("near_edited"),
        resemblance(F.col("own_sketch"), F.coalesce("next_sketch", F.array().cast("array<bigint>"))).alias("near_next"),
        distinct_shingles(F.col("own_sketch")).alias("distinct_shingles"))
