"""Mixing of sources to target weights by Efraimidis-Spirakis sampling.

DataFrame functions only. A document's size is its number of words. Sources in
code-point order (null last) weigh 3, 1, 2, repeating, and share 150 % of all
sizes; a target stops at twice its source's size and the excess is shared anew
by weight, which is one water level over the sources sorted by the level at
which they fill up.

A source's target is met by complete epochs first. For the rest, each document
draws an exponential key, scaled by its quality weight; documents are taken in
the order of keys until the rest is spent, and the document at the edge gives
the words that are still missing. The draw is a hash of the document, so reruns
agree.

The prefix sums are split: the keys' logarithms are mapped to ``BUCKETS`` equal
parts, sizes are summed by source and part with map-side combine, and the part
in which a source's rest ends is cut into ``BUCKETS`` parts once more; only the
part of those in which it ends is sorted by document. On a logarithmic scale an
exponential draw of any weight has less than half a percent in a part, so this
holds for sources of any mixture of weights: a source that holds a third of all
rows is never sorted as a whole, nor is a noticeable share of it.

Defined results: a null text has size 0 and takes 0; a source of size 0 has
target 0; a null source is a source of its own; rows of equal ids draw
the same key and are taken in order of size; rows without an id draw by their text; repeated rows are returned
once each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreseek.llm.common import WORD, unused
from loreseek.sources.shared import Scratch

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0
BUCKETS = 4096
_FROM, _TO = -37.0, 6.0  # logarithms of the least and greatest key
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.1 to 1.0: rises with the share of a text's words that are more than marks; empty texts weigh 0.1."""
    length = F.length(text)
    marks = length - F.length(F.translate(text, "!#$%&*|<>{}[]\\^~=@_/+0123456789", ""))
    return F.coalesce(F.greatest(F.lit(0.1), F.round(1 - 2 * marks / F.when(length > 0, length), 3)), F.lit(0.1))


def exponential_key(doc_id: Column, text: Column, weight: Column) -> Column:
    """An exponential draw over the weight, from 52 bits of a hash of the id, or of the text where there is none."""
    unnamed = F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit(""))))
    hashed = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), unnamed)))
    uniform = (F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(uniform) / weight


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size, target) of ``sources`` (source, source_size): one row for each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    full = LIMIT * F.col("source_size") / F.col("weight")
    rising = Window.orderBy("full", F.col("source").asc_nulls_last())
    everything = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    left = SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum(LIMIT * F.col("source_size")).over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = sources.withColumn("weight", weight).withColumn("full", full).withColumn("level", level)
    # The first source that its level does not fill sets the level of all that follow it.
    leveled = leveled.withColumn("level", F.first(F.when(F.col("level") < F.col("full"), F.col("level")), ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, 0)))
    return leveled.select("source", "source_size", F.coalesce(F.col("level") * F.col("weight"), LIMIT * F.col("source_size")).alias("target"))


def _key() -> Column:
    return exponential_key(F.col("doc_id"), F.col("text"), quality_weight(F.col("text")))


def _part(value: Column, low: Column, high: Column) -> Column:
    """The number of the equal part of [low, high] in which a value lies."""
    width = F.when(high > low, high - low).otherwise(F.lit(1.0))
    return F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), F.floor((value - low) / width * BUCKETS))).cast("int")


def _before(rows: DataFrame, name: str) -> DataFrame:
    """(s, p, before, own, low, high): for each source and part of ``rows``, the words of the parts before, its own, and its outer keys."""
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("own"), F.min("key").alias("low"), F.max("key").alias("high"))
    parts = Scratch(rows.sparkSession, "mixing").table(parts, name)
    run = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("own").over(run), F.lit(0)).alias("before"), "own", "low", "high")


def decided(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, epochs, some, key) of each row of ``docs`` (doc_id, text, source).

    some: the words taken beyond the complete epochs.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    drawn = docs.select("doc_id", "source", words(F.col("text")).alias("size"), _key().alias("key"))
    drawn = scratch.table(drawn.withColumn("part", _part(F.log("key"), F.lit(_FROM), F.lit(_TO))), "drawn")
    parts = _before(drawn, "parts")
    goal = targets(parts.groupBy(F.col("s").alias("source")).agg(F.sum("own").alias("source_size")))
    size = F.when(F.col("source_size") > 0, F.col("source_size"))
    epochs = F.coalesce(F.floor(F.col("target") / size), F.lit(0)).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.round("target").cast("long") - F.col("epochs") * F.col("source_size"))
    goal = goal.select(F.col("source").alias("g"), "source_size", "target", "epochs", "rest")
    parts = parts.join(goal, F.col("s").eqNullSafe(F.col("g"))).drop("g")
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))
    columns = ["doc_id", "size", "source_size", "target", "source", "epochs", "key", "some"]
    edge = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("own") > F.col("rest"))
    all_or_none = F.col("size") * (F.col("before") < F.col("rest")).cast("long")
    placed = drawn.join(parts, same)
    settled = [placed.filter(~edge).withColumn("some", all_or_none).select(*columns)]
    # The part in which a source's rest ends, cut once more between its outer keys.
    finer = placed.filter(edge).select("doc_id", "size", "source_size", "target", "source", "epochs", "key", (F.col("rest") - F.col("before")).alias("rest"), _part(F.col("key"), F.col("low"), F.col("high")).alias("part"))
    finer = scratch.table(finer, "finer")
    placed = finer.join(_before(finer, "parts-finer"), same)
    settled.append(placed.filter(~edge).withColumn("some", all_or_none).select(*columns))
    within = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(within), F.lit(0))
    settled.append(placed.filter(edge).withColumn("some", F.greatest(F.lit(0), F.least(F.col("size"), left))).select(*columns))
    every = settled[0].union(settled[1]).union(settled[2])
    return every.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs") + F.col("some")).alias("taken"), "source", "epochs", "some", "key")


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of ``docs`` (doc_id, text, source)."""
    return decided(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix, with all their columns: a row for each epoch, and one more for each document of the fractional part.

    Texts stay whole: the document at a source's edge is in if at least half of it is taken. Each source is
    reduced to its epochs and the last key that is in, so the texts meet one row per source and aren't shuffled.
    """
    inside = F.when((F.col("some") > 0) & (2 * F.col("some") >= F.col("size")), F.col("key"))
    name, epochs, last, copies, copy = unused(docs, "_s", "_epochs", "_last", "_copies", "_copy")
    sources = decided(docs).groupBy("source").agg(F.first("epochs").alias("epochs"), F.max(inside).alias("last"))
    sources = Scratch(docs.sparkSession, "mixing").table(sources.select(F.col("source").alias(name), F.col("epochs").alias(epochs), F.col("last").alias(last)), "sources")
    times = (F.col(epochs) + F.coalesce(_key() <= F.col(last), F.lit(False)).cast("long")).cast("int")
    joined = docs.join(sources, F.col("source").eqNullSafe(F.col(name))).withColumn(copies, times).filter(F.col(copies) > 0)
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy)).drop(copy)


#: The same in DuckDB SQL, without the buckets, which change no result.
MIX_SQL = r"""
WITH drawn AS (
  SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
      / coalesce(greatest(0.1::DOUBLE, round(1 - 2 * (length(text) - length(translate(text, '!#$%&*|<>{}[]\^~=@_/+0123456789', '')))::DOUBLE / nullif(length(text), 0), 3)), 0.1::DOUBLE) AS key
  FROM documents),
sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM drawn GROUP BY source),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS filled FROM sizes),
sums AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM levels WINDOW b AS (ORDER BY filled, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
settled AS (
  SELECT source, source_size, weight, min(CASE WHEN level < filled THEN struct_pack(r := filled, s := level) END) OVER (ORDER BY filled, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS first_open
  FROM sums),
goal AS (
  SELECT source, source_size, coalesce(first_open.s * weight, 2.0::DOUBLE * source_size) AS target FROM settled),
plan AS (
  SELECT *, coalesce(CAST(floor(target / nullif(source_size, 0)) AS BIGINT), 0) AS epochs,
    CAST(round(target) AS BIGINT) - coalesce(CAST(floor(target / nullif(source_size, 0)) AS BIGINT), 0) * source_size AS rest
  FROM goal)
SELECT d.doc_id, d.size, p.source_size, p.target,
  CAST(d.size * p.epochs + greatest(0, least(d.size, p.rest - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM drawn d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
"""
