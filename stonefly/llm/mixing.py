"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each document has the key -ln(u)/w: u is a hash of its id in (0, 1), w the
quality weight of its text. Within a source documents are taken in order of
their keys up to the token budget. A source that should give more than it has
gives whole epochs first, and only the rest is selected.

No source is sorted as a whole. The keys of a source are cut into ``PARTS``
intervals; their sums, prefix-summed, tell which are in and which are out, and
only the one that the budget falls in is cut again, until it holds ``BUCKET``
keys or fewer and is sorted. Each round divides an interval by ``PARTS``
whatever the distribution of the weights within it, and reads only its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stonefly.llm.common import WORD_CLASS, Scratch

#: Weights of the sources in code-point order, repeating; the mix's size over that of all sources; most epochs.
WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2
BUCKET, PARTS = 4096, 1024
#: Part of the sampling hash; another value draws another mix.
SALT = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("bigint")


def quality(text: Column) -> Column:
    """Weight from 0.1 to 1: falls with the share of mark-up signs in the text."""
    n = F.length(text)
    marks = n - F.length(F.regexp_replace(text, "[#*$%&|<>!]", ""))
    return F.coalesce(F.greatest(F.lit(0.1), 1 - 5 * marks / F.when(n > 0, n)), F.lit(0.1))


def uniform(doc_id: Column, size: Column) -> Column:
    """A number in (0, 1) from the first 13 hex digits of an MD5; the size parts rows without an id."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{SALT}:"), size.cast("string")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def _targets(narrow: DataFrame) -> DataFrame:
    """One row a source: weight, size, target. The excess of sources that stop at ``EPOCHS`` times their size is
    reshared until none is above: sources are capped in order of cap over weight, and the level of the others
    follows from prefix sums. Windows over all sources hold one row a source."""
    s = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    s = s.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("sid") % len(WEIGHTS) + 1).cast("int")))
    s = s.withColumn("cap", float(EPOCHS) * F.col("source_size"))
    every = W.partitionBy()
    rising = W.orderBy(F.col("cap") / F.col("weight"), "sid")
    s = s.withColumns({"total": SHARE * F.sum("source_size").over(every), "all_weight": F.sum("weight").over(every)})
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumns({"capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "gone": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    # the level if all before this source are capped and it is not; the least row whose level fits sets it for all
    s = s.withColumn("level", (F.col("total") - F.col("capped")) / (F.col("all_weight") - F.col("gone")))
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("gone", "level"))).over(every)["level"])
    return s.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))


def _keyed(docs: DataFrame) -> DataFrame:
    """``size`` and ``key`` of each row; the key depends on nothing but the row."""
    text = F.col("text")
    sized = docs.withColumns({"size": words(text), "_w": quality(text)})
    return sized.withColumn("key", -F.log(uniform(F.coalesce(F.col("doc_id").cast("string"), F.md5(text.cast("binary"))), F.col("size"))) / F.col("_w")).drop("_w")


def _mark() -> Column:
    """The total order of the documents of a source."""
    return F.struct(F.col("key"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("size"))


def _edges(own: DataFrame, scratch: Scratch) -> DataFrame:
    """own: ``sid``, ``rest``, ``key``, ``size``, on storage. For each source the interval of keys, ``least`` to ``most``,
    that the budget ``rest`` falls in, and the size of what lies ``before`` it. Each round is a grouped sum of at most
    ``PARTS`` rows a source; ``least`` and ``most`` are keys, so no rounding moves a document over a border."""
    key, done = F.col("key"), []
    rows = own.withColumns({"before": F.lit(0).cast("bigint"), "part": F.floor(key / (1 + key) * PARTS)})
    while True:
        sums = rows.groupBy("sid", "rest", "before", "part").agg(F.sum("size").alias("here"), F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most"))
        start = F.col("before") + F.sum("here").over(W.partitionBy("sid").orderBy("part")) - F.col("here")
        upto = sums.withColumn("start", start).filter(F.col("start") + F.col("here") >= F.col("rest"))
        e = upto.groupBy("sid").agg(F.min(F.struct("part", "start", "n", "least", "most")).alias("e")).select("sid", "e.*")
        edges = scratch.cut(e.select("sid", "least", "most", F.col("start").alias("before"), ((F.col("n") > BUCKET) & (F.col("least") < F.col("most"))).alias("open")))
        done.append(edges.filter("not open"))
        again = edges.filter("open").drop("open")
        if not again.take(1):
            return reduce(DataFrame.unionByName, done)
        within = F.floor((key - F.col("least")) / (F.col("most") - F.col("least")) * PARTS)
        rows = own.join(again, "sid").filter(key.between(F.col("least"), F.col("most"))).withColumn("part", F.least(within, F.lit(PARTS - 1)))


def plan_sources(narrow: DataFrame, scratch: Scratch) -> DataFrame:
    """One row a source: size, target, whole epochs, and the border of the fractional selection, which takes all
    documents of keys under ``least`` and those of keys up to ``most`` that do not come after ``border``."""
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = _targets(narrow).select("source", "sid", "source_size", "target", epochs.alias("epochs"))
    plan = scratch.cut(plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    short = plan.select(F.col("source").alias("_source"), "sid", "rest")
    # rows alike share their fate and are one entry, so that no place holds many of them
    alike = narrow.groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("copies"))
    own = alike.join(short, F.col("source").eqNullSafe(F.col("_source"))).select("sid", "rest", "key", "doc_id", F.col("size").alias("one"), (F.col("size") * F.col("copies")).alias("size"))
    own = scratch.cut(own)
    edges = scratch.cut(_edges(own, scratch))
    inside = own.join(edges, "sid").filter(F.col("key").between(F.col("least"), F.col("most")))
    mark = F.struct(F.col("key"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("one").alias("size"))
    run = F.col("before") + F.sum("size").over(W.partitionBy("sid").orderBy(mark).rowsBetween(W.unboundedPreceding, 0))
    # the document on the border is in if that comes nearer to the budget
    borders = inside.withColumns({"run": run, "mark": mark}).filter(F.col("run") - F.col("size") / 2 < F.col("rest")).groupBy("sid").agg(F.max("mark").alias("border"))
    out = plan.join(edges.select("sid", "least", "most"), "sid", "left").join(borders, "sid", "left")
    return scratch.cut(out.drop("sid", "rest"))


def _copies() -> Column:
    """From a keyed document beside its source's plan."""
    # without a fraction to fill nothing is chosen: the first interval is then the edge, and its border is empty
    key, upto = F.col("key"), F.coalesce(_mark() <= F.col("border"), F.lit(False))
    chosen = F.col("least").isNull() | (key < F.col("least")) | (key <= F.col("most")) & upto
    return (F.col("epochs") + chosen.cast("int")).alias("copies")


def mix(docs: DataFrame) -> DataFrame:
    """For every row of ``docs``: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``, ``source``, ``copies``.

    Null and empty texts have size 0 and cost nothing. A null source is a source of its own, the last. Equal keys go
    by id, then size; rows that are alike in id and size share their fate. Further columns are ignored; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    narrow = scratch.cut(_keyed(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size", "key"))
    plan = plan_sources(narrow, scratch).withColumnRenamed("source", "_source")
    copies = narrow.join(plan, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "size", "source_size", "target", "source", _copies())
    return copies.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def take(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its columns. The border of a source tells of each
    document whether it is in, so texts need no shuffle beside the few rows of the plan.

    Null and empty texts have size 0 and are taken as their keys fall; a null source is a source of its own; repeated rows
    share their fate; equal keys go by id, then size; further columns pass, whatever their names; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    narrow = scratch.cut(_keyed(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size", "key"))
    plan = plan_sources(narrow, scratch).withColumnRenamed("source", "_source")
    keep = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source", "text")
    both = _keyed(keep).join(plan, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_copies", _copies())
    return both.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).select("_row.*")


SQL = f"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    coalesce(greatest(0.1, 1 - 5 * (length(text) - length(regexp_replace(text, '[#*$%&|<>!]', '', 'g'))) / CASE WHEN length(text) > 0 THEN length(text)::DOUBLE END), 0.1) AS w
  FROM documents),
k AS (SELECT doc_id, source, size, -ln((('0x' || md5(coalesce(doc_id::VARCHAR, md5(text), '') || ':{SALT}:' || size::VARCHAR)[1:13])::BIGINT::DOUBLE + 0.5) / {float(1 << 52)!r}) / w AS key FROM d),
s AS (SELECT source, sum(size)::DOUBLE AS z, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM k GROUP BY source),
c AS (SELECT *, 1.5 * sum(z) OVER () AS total, sum(w) OVER () AS all_w,
  coalesce(sum(2 * z) OVER r, 0) AS capped, coalesce(sum(w) OVER r, 0) AS gone
  FROM s WINDOW r AS (ORDER BY 2 * z / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT (total - capped) / (all_w - gone) AS level FROM c WHERE (total - capped) / (all_w - gone) * w <= 2 * z ORDER BY gone LIMIT 1),
t AS (SELECT source, z, least(2 * z, coalesce((SELECT level FROM l) * w, 2 * z)) AS target FROM s),
p AS (SELECT k.*, z, target, CASE WHEN z > 0 THEN floor(target / z) ELSE 0 END AS epochs,
  sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS run
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, z::BIGINT AS source_size, target, ((epochs + chosen) * size)::BIGINT AS taken, source, (epochs + chosen)::INT AS copies
FROM (SELECT *, (run - size / 2.0 < target - epochs * z)::INT AS chosen FROM p)
"""
