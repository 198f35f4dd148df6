"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1 (straight lines
between knots).  The schedule's mean is the source's weight; weights share
the words of all documents, no source getting more than ``max_repeats`` times
what it has (the excess is reshared by weight until nobody is above).  Inside
a source the documents stand in a fixed shuffled order; its demand for words,
integrated over time, consumes them in that order, epoch after epoch, until
its target is met.  Inverting the integral at the middle of each document's
copy gives the copy its training position, and a range sort by position lays
out the training order.

Rules: the size of a text is its number of words (null text: 0).  Sources
rank by code point, null last, and the schedules repeat in that order.  The
last copy that a source needs is taken in part: ``last_words`` of its words;
``mix`` rounds that copy to the whole document or to none, at half its size.
Rows that repeat id, source and text share evenly what the mix takes of them.
Documents without words are in no copy that is taken in part.  An empty table
gives an empty result; if all sizes are 0, all targets are 0.

All prefix sums are ``running_sum`` scans, so neither a source with a third of
all rows nor a long list of sources becomes one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolex.llm.common import WORD, cut, named, packed, running_sum, table, unpacked

#: Knots (time, weight) per schedule; the means are 5, 2 and 1.
SCHEDULES = (((0.0, 6.0), (1.0, 4.0)), ((0.0, 1.0), (1.0, 3.0)), ((0.0, 1.0), (1.0, 1.0)))
MAX_REPEATS = 3


def integral(knots) -> list[tuple[float, float, float, float, float]]:
    """Segments (start, length, weight, slope, area before) of a schedule."""
    out, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        out.append((t0, t1 - t0, w0, (w1 - w0) / (t1 - t0), area))
        area += (t1 - t0) * (w0 + w1) / 2
    return out


def mean_weight(knots) -> float:
    t0, dt, w, slope, area = integral(knots)[-1]
    return (area + dt * (2 * w + slope * dt) / 2) / (knots[-1][0] - knots[0][0])


def invert(share: Column, knots) -> Column:
    """The time at which the integrated schedule reaches ``share`` (0..1) of its total."""
    total = mean_weight(knots) * (knots[-1][0] - knots[0][0])
    area = share * F.lit(total)
    out = after = None
    for t0, _, w, slope, before in reversed(integral(knots)):
        rest = F.greatest(area - F.lit(before), F.lit(0.0))
        root = F.lit(w) + F.sqrt(F.greatest(F.lit(w * w) + F.lit(2 * slope) * rest, F.lit(0.0)))
        time = F.lit(t0) + F.when(root > 0, 2 * rest / root).otherwise(F.lit(0.0))
        out = time if out is None else F.when(area < F.lit(after), time).otherwise(out)
        after = before
    return out


def source_targets(sizes: DataFrame, schedules=SCHEDULES, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """From (source, source_size): ``_class`` (index of its schedule) and ``target``.

    With caps q = max_repeats * size / weight in rising order, the sources below
    the common level get their cap; the level is the largest of
    (all words - caps so far) / (all weights - weights so far)."""
    ranked = running_sum(
        sizes.withColumn("_null", F.col("source").isNull()).withColumn("_one", F.lit(1)),
        [], ["_null", "source"], "_one", "op2-ranks").withColumn("_class", F.col("_one_before") % len(schedules))
    weights = F.array(*[F.lit(float(mean_weight(k))) for k in schedules])
    caps = (ranked.withColumn("_weight", F.get(weights, F.col("_class").cast("int")))
            .withColumn("_cap", max_repeats * F.col("source_size"))
            .withColumn("_level", F.col("_cap") / F.col("_weight"))
            .select("source", "source_size", "_null", "_class", "_weight", "_cap", "_level"))
    rising = ["_level", "_null", "source"]
    both = running_sum(running_sum(caps, [], rising, "_cap", "op2-caps"), [], rising, "_weight", "op2-weights")
    both = cut(both, "op2-levels")
    total = both.agg(F.sum("source_size").alias("_words"), F.sum("_weight").alias("_all"))
    level = (both.crossJoin(F.broadcast(total))  # one row
             .agg(F.max((F.col("_words") - F.col("_cap_before")) / (F.col("_all") - F.col("_weight_before")))
                  .alias("_level_of_all")))
    return both.crossJoin(F.broadcast(level)).select(  # one row
        "source", "source_size", F.col("_class").cast("int").alias("_class"),
        F.least(F.col("_cap").cast("double"), F.col("_level_of_all") * F.col("_weight")).alias("target"))


def allot(docs: DataFrame, schedules=SCHEDULES, max_repeats: int = MAX_REPEATS, seed: str = "",
          doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per distinct (id, source, text): ``_doc``, ``_key`` (hash of source
    and text), size, source_size, target, taken, and per copy what
    ``copies`` needs."""
    rows = docs.select(
        named(doc_id).alias("_doc"), named(source).alias("source"),
        F.xxhash64(named(source), named(text)).alias("_key"),
        F.coalesce(F.regexp_count(named(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    units = cut(rows.groupBy("_doc", "_key", "source").agg(
        F.count("*").alias("_rows"), F.max("size").alias("size"))
        .withColumn("_order", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("_doc").cast("string"), F.lit("")))
                                    .cast("binary")))
        .withColumn("_unit", F.col("size") * F.col("_rows")), "op2-units")
    targets = source_targets(units.groupBy("source").agg(F.sum("_unit").alias("source_size")),
                             schedules, max_repeats)
    placed = running_sum(units, ["source"], ["_order", "_doc", "_key"], "_unit", "op2-order")
    targets = cut(targets.withColumnRenamed("source", "_source"), "op2-targets")
    words = F.floor("target")
    return (placed.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
            .withColumn("_words", words)
            .withColumn("_epochs", F.when(F.col("source_size") > 0, F.expr("_words div source_size"))
                        .otherwise(F.lit(0)).cast("long"))
            .withColumn("_rest", F.col("_words") - F.col("_epochs") * F.col("source_size"))
            .withColumn("last_words", F.expr(
                "greatest(0, least(_rest - _unit_before, _unit)) div _rows").cast("long"))
            .withColumn("taken", F.col("_epochs") * F.col("size") + F.col("last_words")))


def position(start: Column, words: Column, schedules=SCHEDULES) -> Column:
    """Training time of the middle of a stretch of a source's consumed words."""
    share = F.least((start + words / 2) / F.col("_words"), F.lit(1.0))
    out = F.lit(None).cast("double")
    for i, knots in enumerate(schedules):
        out = F.when(F.col("_class") == i, invert(share, knots)).otherwise(out)
    return out


def first_position(schedules=SCHEDULES) -> Column:
    """Position of a document's first copy; null if the mix takes none of it."""
    whole = F.when(F.col("_epochs") > 0, F.col("_unit")).otherwise(F.col("last_words") * F.col("_rows"))
    return F.when(F.col("taken") > 0, position(F.col("_unit_before"), whole, schedules))


def mix(docs: DataFrame, schedules=SCHEDULES, max_repeats: int = MAX_REPEATS, seed: str = "",
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The training order: ``docs``' columns, one row per copy that the mix takes,
    range-sorted by position."""
    plan = allot(docs, schedules, max_repeats, seed, doc_id, text, source)
    last = F.when((F.col("last_words") > 0) & (2 * F.col("last_words") >= F.col("size")), 1).otherwise(0)
    copies = F.explode(F.expr("sequence(0, _n - 1)"))
    places = (plan.withColumn("_n", F.col("_epochs") + last).filter("_n > 0")
              .select("_doc", "_key", "_class", "_words", "_epochs", "_unit", "_unit_before", "source_size",
                      "last_words", "_rows", copies.alias("_copy")))
    words = F.when(F.col("_copy") < F.col("_epochs"), F.col("_unit")).otherwise(F.col("last_words") * F.col("_rows"))
    start = F.col("_copy") * F.col("source_size") + F.col("_unit_before")
    places = cut(places.select("_doc", "_key", "_copy", position(start, words, schedules).alias("_position")),
                 "op2-places")
    row = F.col("_row")
    on = row[doc_id].eqNullSafe(F.col("_doc")) & (F.xxhash64(row[source], row[text]) == F.col("_key"))
    return unpacked(packed(docs).join(places, on).orderBy("_position", "_doc", "_key", "_copy"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    plan = allot(docs)
    rows = plan.withColumn("_row", F.explode(F.expr("sequence(1, _rows)")))
    return (rows.withColumn("position", first_position())
            .select(F.col("_doc").alias("doc_id"), "size", "source_size", "target", "taken", "position")
            .orderBy("position", "doc_id"))


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS class
  FROM d GROUP BY source),
w AS (SELECT *, CASE class WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             3 * source_size AS cap FROM s),
c AS (
  SELECT *, coalesce(sum(cap) OVER p, 0)::DOUBLE AS caps_before, coalesce(sum(weight) OVER p, 0) AS weight_before
  FROM w
  WINDOW p AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT max(((SELECT sum(source_size) FROM w)::DOUBLE - caps_before)
             / ((SELECT sum(weight) FROM w) - weight_before)) AS level FROM c),
t AS (
  SELECT source, source_size, class, least(cap::DOUBLE, (SELECT level FROM l) * weight) AS target FROM w),
o AS (
  SELECT d.doc_id, d.size, t.source_size, t.class, t.target, floor(t.target)::BIGINT AS words,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS epochs FROM o),
f AS (
  SELECT *, greatest(0, least(words - epochs * source_size - before, size)) AS last_words FROM e),
g AS (
  SELECT *, epochs * size + last_words AS taken,
         least((before + (CASE WHEN epochs > 0 THEN size ELSE last_words END)::DOUBLE / 2) / words, 1.0::DOUBLE)
           AS share
  FROM f)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
       CASE WHEN taken > 0 THEN
         CASE class
           WHEN 0 THEN 2 * (share * 5) / (6 + sqrt(36 - 4 * (share * 5)))
           WHEN 1 THEN 2 * (share * 2) / (1 + sqrt(1 + 4 * (share * 2)))
           ELSE 2 * share / (1 + sqrt(1 + 0 * share)) END END AS position
FROM g
"""
