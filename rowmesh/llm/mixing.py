"""Mixing sources to target weights by Pareto order sampling. DataFrame expressions only.

A source's target is its weight's share of all words, held at MOST times its size; what is cut off is shared out again by
weight (the water level is found in closed form from the sources in order of cap over weight). Every document gets the
whole copies that fit its source's target as often as it can be repeated in full. What is left of the target is filled by
a sample without replacement and with unequal probabilities: a document's inclusion probability grows with the root of
its size, so that long documents are preferred without short ones being lost, and is scaled so that the expected words
are just what is left; where it would pass 1 the document is taken for certain. The others are ranked by random odds over
inclusion odds, and the source takes its ranking's head as long as its words fit what is left: the sample's size is fixed
in words, which are what a mix is measured in. One more document, the one whose size comes nearest to the gap, closes it
if that is nearer than none.

Random numbers are hashes of key and text, so reruns agree. Rows that repeat both share a place in the ranking; where the
head ends among them, as many of them are taken as fit.

No source is ever sorted as a whole: documents fall into BUCKETS ranges of their rank, whose words are summed with
map-side combine, and just the one range in which a source's target lies is ordered. Probabilities are scaled over the
distinct sizes of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowmesh.llm.frame import cut, table, written

WEIGHTS = (1, 2, 3)
MOST = 3
BUCKETS = 1 << 16
#: Inclusion probabilities are in proportion to floor(FINE * sqrt(size)).
FINE = 16
#: Rows of a split place that are numbered in one task, about.
RANGE = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: str, text: str, seed: str = "mix") -> Column:
    """A number in (0, 1) from the hash of key and text, in steps of 2**-52."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.md5(F.col(f"`{text}`")), F.lit("null")))
    digits = F.substring(F.md5(named), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def lean(size: Column) -> Column:
    """The whole number that a document's inclusion probability is in proportion to."""
    return F.floor(FINE * F.sqrt(size.cast("double"))).cast("long")


def allocate(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) with target. One row a source: ordered in one task, by code point and null last for the
    weights, by cap over weight for the level."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("weight", F.array(*[F.lit(w) for w in weights])[(F.row_number().over(by_name) - 1) % len(weights)].cast("long"))
    capped = weighed.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # The level that holds is that of the first source, in this order, which it doesn't lift over its cap.
    levelled = capped.withColumn("level", level).withColumn("at", F.row_number().over(order))
    fits = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("at", "level"))).over(everything)["level"]
    return levelled.withColumn("target", F.least(F.col("weight") * F.coalesce(fits, F.lit(0.0)), F.col("cap").cast("double"))).select("source", "source_size", "target")


def scale_odds(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan (source, source_size, target) with whole, the copies that every document gets, scale: a document is included
    once more with probability min(1, scale * lean(size)), which fills what is left of the target in expectation, and room,
    the words left to the ranking after those that are certain. sizes: (source, size, n), one row a distinct size; those of
    a source are ordered in one task."""
    mu = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = plan.withColumn("whole", F.floor(mu).cast("long")).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    named = whole.withColumnRenamed("source", "__s")
    held = sizes.where("size > 0").join(named, sizes["source"].eqNullSafe(named["__s"])).select("source", "need", "size", lean(F.col("size")).alias("w"), F.col("n").cast("decimal(20,0)").alias("n"))
    larger = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    others = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    sure = F.coalesce(F.sum(F.col("n") * F.col("size")).over(larger).cast("double"), F.lit(0.0))
    free = F.sum(F.col("n") * (F.col("size") * F.col("w"))).over(others).cast("double")
    # The scale if all larger sizes are certain; the largest size that it doesn't lift over 1 decides.
    at = held.withColumn("sure", sure).withColumn("scale", (F.col("need") - F.col("sure")) / free).where(F.col("scale") * F.col("w") <= 1 + 1e-12)
    found = at.groupBy(F.col("source").alias("__f")).agg(F.max_by(F.struct("scale", "sure"), "size").alias("f"))
    joined = whole.join(found, whole["source"].eqNullSafe(found["__f"]), "left")
    return joined.select("source", "source_size", "target", "whole", F.greatest(F.coalesce("f.scale", F.lit(0.0)), F.lit(0.0)).alias("scale"), (F.col("need") - F.coalesce("f.sure", F.lit(0.0))).alias("room"))


def _ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (key, source, size, u) with their source's plan, inclusion probability and place in the ranking."""
    named = plan.withColumnRenamed("source", "__source")
    joined = rows.join(F.broadcast(named), rows["source"].eqNullSafe(named["__source"])).drop("__source")
    ranked = joined.withColumn("__p", F.when(F.col("size") > 0, F.least(F.lit(1.0), F.col("scale") * lean(F.col("size")))).otherwise(F.lit(0.0)))
    ranked = ranked.withColumn("__q", F.when((F.col("__p") > 0) & (F.col("__p") < 1), (F.col("u") / (1 - F.col("u"))) / (F.col("__p") / (1 - F.col("__p")))))
    # Times the source's mean odds, ranks are spread about evenly over the ranges.
    mean = F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col("room") / F.col("source_size")))
    z = F.col("__q") * (mean / (1 - mean))
    return ranked.withColumn("__at", F.struct(F.col("__q").alias("q"), F.col("key").alias("k"), F.col("size").alias("s"))).withColumn("__bucket", F.floor(BUCKETS * (z / (1 + z))).cast("int"))


def plan_mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source of rows (key, source, size, u): source_size, target, whole, scale, room and where its ranking is cut: the
    bucket (edge), the last place taken in it, the place of which just ``part`` of ``among`` rows are taken (split), and the
    place of the closing document. Sources are few: what is joined here is broadcast."""
    sizes = cut(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    plan = cut(scale_odds(sizes, allocate(sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, most)))
    ranked = _ranked(rows, plan).where("__q is not null").withColumnRenamed("source", "src")
    sums = ranked.groupBy("src", "__bucket").agg(F.sum("size").alias("words"), F.first("room").alias("room"))
    over = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("src").orderBy("__bucket"))).where(F.col("upto") > F.col("room"))
    edge = cut(over.groupBy(F.col("src").alias("source")).agg(F.min("__bucket").alias("edge"), F.min_by(F.col("upto") - F.col("words"), "__bucket").alias("before")))

    def of(side: DataFrame) -> DataFrame:
        return ranked.join(F.broadcast(side), ranked["src"].eqNullSafe(side["source"]))

    # Rows of one place are one row here, with their number.
    places = of(edge).where("__bucket = edge").groupBy("source", "room", "before", "__at", "size").agg(F.count("*").alias("n"))
    run = places.withColumn("upto", F.col("before") + F.sum(F.col("n") * F.col("size")).over(Window.partitionBy("source").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)))
    fits = F.col("upto") <= F.col("room")
    ends = run.groupBy("source").agg(
        F.first("room").alias("room"),
        F.max(F.when(fits, F.col("__at"))).alias("last"),
        F.coalesce(F.max(F.when(fits, F.col("upto"))), F.first("before")).alias("filled"),
        F.min(F.when(~fits, F.struct("__at", "n", "size"))).alias("next"),
    )
    # Of rows that share the next place as many are taken as fit.
    part = F.when(F.col("next.n") > 1, F.floor((F.col("room") - F.col("filled")) / F.col("next.size"))).otherwise(F.lit(0)).cast("long")
    ends = ends.join(edge.select(F.col("source").alias("__e"), "edge"), F.col("source").eqNullSafe(F.col("__e"))).withColumn("part", F.coalesce(part, F.lit(0).cast("long")))
    ends = cut(ends.select("source", "edge", "last", "part", F.when(F.col("part") > 0, F.col("next.__at")).alias("split"), F.col("next.n").alias("among"), (F.col("filled") + F.col("part") * F.coalesce("next.size", F.lit(0))).alias("filled")))
    beyond = (F.col("__bucket") > F.col("edge")) | ((F.col("__bucket") == F.col("edge")) & (F.col("last").isNull() | (F.col("__at") > F.col("last"))))
    gap = F.col("room") - F.col("filled")
    nearer = of(ends).where(beyond & (F.abs(gap - F.col("size")) < F.abs(gap)) & ~F.col("__at").eqNullSafe(F.col("split")))
    single = nearer.groupBy("source", "__at").agg(F.count("*").alias("n"), F.first(F.abs(gap - F.col("size"))).alias("far")).where("n = 1")
    closing = single.groupBy(F.col("source").alias("__c")).agg(F.min(F.struct("far", "__at"))["__at"].alias("closing"))
    cuts = ends.drop("filled").withColumnRenamed("source", "__s").join(closing, F.col("__s").eqNullSafe(F.col("__c")), "left").drop("__c")
    return plan.join(cuts, plan["source"].eqNullSafe(cuts["__s"]), "left").drop("__s")


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (key, source, size, u, n and any more), n being a row's number among those of its place, with source_size,
    target and copies, decided by their source's cut alone."""
    ranked = _ranked(rows, plan)
    ahead = F.col("edge").isNull() | (F.col("__bucket") < F.col("edge")) | ((F.col("__bucket") == F.col("edge")) & F.col("last").isNotNull() & (F.col("__at") <= F.col("last")))
    closes = F.col("closing").isNotNull() & (F.col("__at") == F.col("closing"))
    partly = F.col("split").isNotNull() & (F.col("__at") == F.col("split")) & (F.col("n") < F.col("part"))
    extra = (F.col("__p") >= 1) | (F.col("__q").isNotNull() & (ahead | closes | partly))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce(extra, F.lit(False)).cast("long")).otherwise(F.lit(0).cast("long")).alias("copies")
    return ranked.select(*[F.col(f"`{c}`") for c in rows.columns], "source_size", "target", copies)


def _narrow(key: str, text: str, source: str, seed: str) -> list[Column]:
    return [F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), words_of(text).alias("size"), uniform(key, text, seed).alias("u")]


def _splits(plan: DataFrame) -> bool:
    return not plan.where("split is not null").isEmpty()


def _numbers(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(row, n): the number, from 0, of each row of a split place among those of its place. Numbers come from the counts of
    ranges of rows, so that no split place is one task's."""
    held = _ranked(rows, plan).where(F.col("split").isNotNull() & (F.col("__at") == F.col("split")))
    held = held.select("source", "row", F.pmod(F.xxhash64("row"), F.ceil(F.col("among") / RANGE).cast("long")).alias("range"))
    counts = held.groupBy(F.col("source").alias("__s"), F.col("range").alias("__range")).agg(F.count("*").alias("c"))
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy("__s").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = held.withColumn("k", F.row_number().over(Window.partitionBy("source", "range").orderBy("row")) - 1)
    joined = local.join(before, local["source"].eqNullSafe(before["__s"]) & (F.col("range") == F.col("__range")))
    return joined.select("row", (F.col("before") + F.col("k")).alias("n"))


def _numbered(rows: DataFrame, plan: DataFrame) -> DataFrame:
    if not _splits(plan):
        return rows.withColumn("n", F.lit(0).cast("long"))
    return rows.join(_numbers(rows.select("key", "source", "size", "u", "row"), plan), "row", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """Per document: key, source, size, source_size, target (its source's) and taken, the words that the mix takes of it,
    repeats counted.

    Null texts have size 0 and are never taken; null is a source of its own, the last one; null keys are a key like any
    other. Rows that repeat a key and text are taken alike, but for those at which their source's target is reached: of
    these as many as fit. Sources without a word have target 0. An empty table gives no rows; further columns are ignored.
    """
    rows = cut(docs.select(*_narrow(key, text, source, seed)).withColumn("row", F.monotonically_increasing_id()))
    plan = cut(plan_mix(rows, weights, most))
    mixed = with_copies(_numbered(rows, plan), plan)
    return mixed.select(F.col("key").alias(key), "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def resample(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """The mix itself: every document as many times as it is taken, with the columns given. Nulls, repeated rows and empty
    tables as in mix()."""
    plan = cut(plan_mix(cut(docs.select(*_narrow(key, text, source, seed))), weights, most))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    whole = docs.select(own, *_narrow(key, text, source, seed)).withColumn("row", F.monotonically_increasing_id())
    if _splits(plan):  # numbers within a split place need rows that stay as they are
        whole = written(whole, "mixed")
    taken = with_copies(_numbered(whole, plan), plan).where("copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("__row.*")


def op2_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(md5(text), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM s),
c AS (SELECT *, 3 * source_size AS cap, (3 * source_size) / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level,
             row_number() OVER (ORDER BY ratio, source ASC NULLS LAST) AS pos
      FROM c WINDOW o AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(weight * (SELECT arg_min(level, pos) FROM l WHERE level <= ratio), CAST(cap AS DOUBLE)) AS target FROM l),
m AS (SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS BIGINT) AS whole, target - floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) * source_size AS need FROM t),
z AS (SELECT source, size, count(*) AS n, CAST(floor({FINE} * sqrt(size)) AS BIGINT) AS w FROM d WHERE size > 0 GROUP BY 1, 2),
y AS (SELECT z.source, size, w, need, CAST(coalesce(sum(n * size) OVER (PARTITION BY z.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS sure,
             CAST(sum(n * size * w) OVER (PARTITION BY z.source ORDER BY size ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS free
      FROM z JOIN m ON z.source IS NOT DISTINCT FROM m.source),
f AS (SELECT source, arg_max((need - sure) / free, size) AS scale, arg_max(sure, size) AS sure FROM y WHERE (need - sure) / free * w <= 1 + 1e-12 GROUP BY 1),
r AS (SELECT d.*, source_size, target, whole, need - coalesce(f.sure, 0) AS room,
             CASE WHEN size > 0 THEN least(1.0, greatest(coalesce(f.scale, 0), 0) * CAST(floor({FINE} * sqrt(size)) AS BIGINT)) ELSE 0.0 END AS p
      FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source LEFT JOIN f ON f.source IS NOT DISTINCT FROM d.source),
k AS (SELECT *, (u / (1 - u)) / (p / (1 - p)) AS q FROM r WHERE p > 0 AND p < 1),
x AS MATERIALIZED (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id NULLS FIRST, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         dense_rank() OVER (PARTITION BY source ORDER BY q, doc_id NULLS FIRST, size) AS place FROM k),
h AS (SELECT *, count(*) OVER (PARTITION BY source, place) AS n, row_number() OVER (PARTITION BY source, place ORDER BY rid) - 1 AS i,
             min(CASE WHEN upto > room THEN place END) OVER (PARTITION BY source) AS over FROM x),
e AS (SELECT source, any_value(room) AS room, max(CASE WHEN place < over OR over IS NULL THEN upto ELSE 0 END) AS filled,
             max(CASE WHEN place = over AND n > 1 THEN size END) AS tied FROM h GROUP BY 1),
g AS (SELECT source, CASE WHEN tied > 0 THEN CAST(floor((room - filled) / tied) AS BIGINT) ELSE 0 END AS part, room - filled - CASE WHEN tied > 0 THEN floor((room - filled) / tied) * tied ELSE 0 END AS gap FROM e),
v AS (SELECT h.source, arg_min(h.rid, (abs(gap - size), place)) AS closing FROM h JOIN g ON h.source IS NOT DISTINCT FROM g.source
      WHERE place >= over AND n = 1 AND abs(gap - size) < abs(gap) GROUP BY 1),
b AS (SELECT h.rid FROM h JOIN g ON h.source IS NOT DISTINCT FROM g.source LEFT JOIN v ON v.source IS NOT DISTINCT FROM h.source
      WHERE over IS NULL OR place < over OR (place = over AND n > 1 AND i < part) OR h.rid = v.closing)
SELECT r.doc_id, r.size, r.source_size, r.target, CASE WHEN size > 0 THEN CAST(whole + CASE WHEN p >= 1 OR b.rid IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) * r.size ELSE 0 END AS taken
FROM r LEFT JOIN b ON b.rid = r.rid
"""
