"""Mixing sources to target weights by a time-varying curriculum, with DataFrame functions only.

Each source has a weight and a schedule: a piecewise linear curve of relative weight over training time 0..1. The
schedule's integral gives the source's cumulative demand for words; inverting it at a document's place in its source's
running word count gives the time at which the document is trained on, and the output is range-sorted by that time.

Nulls: a null text has size 0; a null source is a source of its own, last in order; a null doc_id is kept. Rows that
repeat are separate documents. An empty table gives no rows. Other columns are carried: mixed_documents gives all of
them back as they were; of mix, the columns that it adds (size, source_size, target, taken, words_before, position) replace
columns of the same names. Rows that repeat lie together in one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table

WEIGHTS = (3.0, 1.0, 2.0)
#: Knots (time, relative weight) by source class: early, level and late sources.
SCHEDULES = (((0.0, 1.6), (0.5, 1.0), (1.0, 0.4)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.4), (0.5, 1.0), (1.0, 1.6)))
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the order key that make a bucket: 4096 buckets split a hot source.
BUCKET_DIGITS = 3


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.expr(f"regexp_count({text}, r'{WORD}')").cast("long"), F.lit(0).cast("long"))


def source_plan(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, kind, target) by source: share of all sizes dealt by weight, none above most times its size.

    Sources sorted by size over weight saturate in that order, so prefix sums find the level at which the rest fit.
    """
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # One row a source from here on.
    order = W.orderBy(F.col("source").asc_nulls_last())
    kind = (F.row_number().over(order) - 1) % len(weights)
    ranked = per.withColumn("kind", kind).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("kind") + 1))
    by_fill = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(rest)
    levels = ranked.withColumn("level", level).withColumn("full", F.lit(most) * F.col("source_size") <= F.col("level") * F.col("weight"))
    # Past the first source that does not fill up the level only falls.
    lam = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    target = F.when(F.col("full") | lam.isNull(), F.lit(most) * F.col("source_size")).otherwise(F.least(F.lit(most) * F.col("source_size"), lam * F.col("weight")))
    return levels.select("source", "source_size", "kind", F.round(target, 6).alias("target"))


def time_of(part: Column, knots) -> Column:
    """The time at which a schedule has asked for this part (0..1) of its words."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    total, done, out = sum(areas), 0.0, None
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas, strict=False):
        slope = (w1 - w0) / (t1 - t0)
        left = part * total - F.lit(done)
        x = F.lit(t0) + (left / w0 if abs(slope) < 1e-12 else (F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + 2 * slope * left)) - w0) / slope)
        done += area
        out = F.when(part * total <= done, x) if out is None else out.when(part * total <= done, x)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out.otherwise(F.lit(1.0))))


def position(demand: Column, schedules) -> Column:
    """The time at which a source's schedule has asked for this many words, of the columns target and __kind."""
    part = F.when(F.col("target") > 0, F.least(F.lit(1.0), demand / F.col("target")))
    return F.round(F.element_at(F.array(*[time_of(part, s) for s in schedules]), F.col("__kind") % len(schedules) + 1), 9)


_INNER = ("__key", "__bucket", "__start", "__run", "__source", "__b", "__kind")


def order_key() -> Column:
    """What a source's documents are ordered by; those without an id by their text, so that they don't share one bucket."""
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.md5(F.coalesce("text", F.lit(""))))))



def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, schedules=SCHEDULES, digits: int = BUCKET_DIGITS, unsorted: bool = False) -> DataFrame:
    """docs with size, source_size, target, taken (words, repeats counted), words_before and position (time of the first pass, null if not taken), sorted by it.

    The source's words are laid end to end in order of md5(doc_id), again and again; the mix takes the first target of
    them, so at most one document of a source is taken in part. Running counts are two-level: buckets of a source are
    summed first, and only rows of one bucket are sorted together. unsorted leaves the order and the inner columns.
    """
    sized = docs.drop("size", "source_size", "target", "taken", "position", "words_before").withColumn("size", word_count())
    sized = sized.withColumn("__key", order_key()).withColumn("__bucket", F.substring("__key", 1, digits))
    small = docs.select("doc_id", "source", "text").withColumn("size", word_count()).select("source", "size", F.substring(order_key(), 1, digits).alias("__bucket"))
    buckets = small.groupBy("source", "__bucket").agg(F.sum("size").alias("size"))
    plan = source_plan(buckets, weights, share, most)
    start = F.coalesce(F.sum("size").over(W.partitionBy("source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = buckets.withColumn("__start", start).drop("size")
    starts = starts.alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source"))).select("s.source", "s.__bucket", "s.__start", "p.source_size", F.col("p.kind").alias("__kind"), "p.target")
    order = W.partitionBy("source", "__bucket").orderBy("__key", "size", F.xxhash64("text")).rowsBetween(W.unboundedPreceding, -1)
    run = sized.withColumn("__run", F.coalesce(F.sum("size").over(order), F.lit(0)))
    a, b = run.alias("a"), starts.withColumnRenamed("source", "__source").withColumnRenamed("__bucket", "__b").alias("b")
    joined = a.join(b, F.col("a.source").eqNullSafe(F.col("b.__source")) & (F.col("a.__bucket") == F.col("b.__b")))
    quota = F.round("target").cast("long")
    before = F.col("__start") + F.col("__run")
    part = lambda limit: F.greatest(F.lit(0).cast("long"), F.least(limit, before + F.col("size")) - before)
    passes = range(int(-(-most // 1)))
    taken = sum((part(quota - F.lit(k) * F.col("source_size")) for k in passes), F.lit(0).cast("long"))
    out = joined.withColumn("taken", taken).withColumn("words_before", before)
    out = out.withColumn("position", F.when(F.col("taken") > 0, position(before + F.col("size") / 2, schedules)))
    return out if unsorted else out.drop(*_INNER).orderBy(F.col("position").asc_nulls_last(), F.col("doc_id"))


def mixed_documents(docs: DataFrame, schedules=SCHEDULES, positions: bool = False, **how) -> DataFrame:
    """The mix's documents in training order: every pass of a document has its own place in its source's schedule, after
    all words of the passes before it; positions adds these as __position. Each whole pass gives the document, the last pass its taken words.

    A document of size s with t words taken comes t div s times whole; if t mod s words are left, once more with its text
    cut after them (one document of a source at most). Documents without words are not in a mix of words: they are
    dropped only where the source's target is 0, else kept once, at their place in the first pass.
    """
    cols = docs.columns
    # The caller's columns travel in one struct, so none of them can clash with the mix's own.
    own = docs.select("doc_id", "source", "text", F.struct(*(F.col(f"`{c}`") for c in cols if c != "text")).alias("__own"))
    got = mix(own, schedules=schedules, unsorted=True, **how)
    whole = F.when(F.col("size") > 0, F.expr("cast(taken div size as int)")).otherwise(F.when(F.col("target") > 0, 1).otherwise(F.when(F.col("source_size") == 0, 1).otherwise(0)))
    got = got.withColumn("__whole", whole).withColumn("__left", F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0)))
    got = got.withColumn("__pass", F.explode(F.sequence(F.lit(0), F.col("__whole")))).where("__pass < __whole or __left > 0")
    # Words with the white space before each, as joined again they are the text itself.
    cut = F.expr(r"array_join(slice(regexp_extract_all(text, r'[\x20\x09-\x0D]*[^\x20\x09-\x0D]+', 0), 1, cast(__left as int)), '')")
    got = got.withColumn("text", F.when(F.col("__pass") < F.col("__whole"), F.col("text")).otherwise(cut))
    # The cut copy is trained on in the middle of the words that it has.
    words = F.when(F.col("__pass") < F.col("__whole"), F.col("size")).otherwise(F.col("__left"))
    got = got.withColumn("__position", position(F.col("words_before") + F.col("__pass") * F.col("source_size") + words / 2, schedules))
    got = got.orderBy(F.col("__position").asc_nulls_last(), "doc_id", "__pass")
    back = [F.col("text") if c == "text" else F.col(f"__own.`{c}`") for c in cols]
    return got.select(*back, "__position") if positions else got.select(*back)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken", "position")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, 'null ' || md5(coalesce(text, '')))) AS k FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind FROM per),
weighted AS (SELECT *, CASE kind WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM ranked),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)),
filled AS (SELECT *, 2.0::DOUBLE * source_size <= level * weight AS full_up FROM levels),
plan AS (
  SELECT source, source_size, kind, round(CASE WHEN full_up THEN 2.0::DOUBLE * source_size
    ELSE least(2.0::DOUBLE * source_size, max(CASE WHEN NOT full_up THEN level END) OVER () * weight) END, 6) AS target FROM filled),
placed AS (
  SELECT doc_id, size, source_size, kind, target, round(target)::BIGINT AS quota,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
took AS (
  SELECT *, (greatest(0, least(quota, c + size) - c) + greatest(0, least(quota - source_size, c + size) - c))::BIGINT AS taken,
    CASE WHEN target > 0 THEN least(1.0::DOUBLE, (c + size / 2.0::DOUBLE) / target) END AS y FROM placed)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE kind
    WHEN 1 THEN y
    WHEN 0 THEN CASE WHEN y <= 0.65 THEN (sqrt(greatest(0, 2.56 - 2.4 * y)) - 1.6) / -1.2 ELSE 0.5 + (sqrt(greatest(0, 1.0 - 2.4 * (y - 0.65))) - 1.0) / -1.2 END
    ELSE CASE WHEN y <= 0.35 THEN (sqrt(greatest(0, 0.16 + 2.4 * y)) - 0.4) / 1.2 ELSE 0.5 + (sqrt(greatest(0, 1.0 + 2.4 * (y - 0.35))) - 1.0) / 1.2 END END)), 9) END AS position
FROM took
"""
