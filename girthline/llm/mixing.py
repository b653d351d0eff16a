"""Mix sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its id. A source's token budget becomes a hash threshold: documents below it are
taken. The threshold is found from histograms of tokens by source and hash bucket (12 bits a level); each level looks
only into the one bucket where the running sum crosses the budget, so nothing is ever sorted by hash and larger budgets
contain smaller ones (nested samples). Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unused, word_count, written

BITS, LEVELS = 12, 5
#: A target stops at so many times its source's size.
MOST = 3


def id_hash(doc_id: Column) -> Column:
    """60 bits of the md5 of the id as text (null: the empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in code-point order, null last, get the weights in turn and share the sum of all sizes. A target above
    `most` times its source's size stops there, and the excess is shared again by weight until none is above. That
    is a water level: by rising ratio of cap to weight, sources are capped while the level of the rest is above it.
    There is one row a source, so the windows without a key see the sources only, never documents.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    x = sizes.select("source", "source_size").withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    x = x.withColumn("ratio", F.col("cap").cast("double") / F.col("weight")).withColumn("total", F.sum("source_size").over(every))
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    x = x.withColumn("capped", level > F.col("ratio"))
    left = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every)
    over = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(every)
    return x.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * (left.cast("double") / over)).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, h, size) and (source, budget) to (source, cut): documents with h < cut come as near to the budget as whole documents can.

    Level by level the bucket in which the running sum passes the budget is found and refined; a bucket with a single
    hash is the end. That last document is taken if that is nearer to the budget than leaving it. Rows with equal
    hashes stay together.
    """
    open_ = budgets.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("under"))
    done = None
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = sized.join(open_.select(F.col("source").alias("s"), "prefix", "budget", "under"), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + BITS) == F.col("prefix")))
        hist = inside.groupBy("source", "budget", "under", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        run = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("to", F.col("under") + F.sum("n").over(run))
        crossed = hist.where(F.col("to") > F.col("budget")).withColumn("k", F.row_number().over(run)).where("k = 1")
        step = written(crossed.select("source", "budget", F.col("bucket").alias("prefix"), (F.col("to") - F.col("n")).alias("under"), "to", "h0", "h1"), "boundary")
        last = step.where("h0 = h1") if level < LEVELS - 1 else step
        cut = last.select("source", (F.col("h0") + F.when(F.col("to") - F.col("budget") < F.col("budget") - F.col("under"), 1).otherwise(0)).alias("cut"))
        done = cut if done is None else done.unionByName(cut)
        open_ = step.where("h0 < h1").select("source", "budget", "prefix", "under")
        if level == LEVELS - 1 or open_.isEmpty():
            return done


def plan(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, h, size) to a row a source: source, source_size, target, rounds (copies of all its documents) and cut
    (documents with a smaller hash come once more). Written, so that Spark knows its size before it broadcasts it."""
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    goal = goal.withColumn("rounds", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long"))
    goal = written(goal.withColumn("budget", F.col("target") - F.col("rounds") * F.col("source_size")), "goal")
    cuts = thresholds(sized.select("source", "h", "size"), goal.select("source", "budget"))
    found = goal.join(cuts.select(F.col("source").alias("s"), "cut"), F.col("source").eqNullSafe(F.col("s")), "left")
    return written(found.select("source", "source_size", "target", "rounds", F.coalesce("cut", F.lit(0).cast("long")).alias("cut")), "plan")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: how many times the mix takes each document.

    All documents of a source repeat floor(target / source size) times; those below the hash threshold of the rest
    once more. The same rows give the same mix, whatever the partitions.

    Null text counts 0 words; null source is a source of its own, last in order; a null id hashes as the empty text;
    repeated rows, and ties of hashes, are taken alike; an empty table gives an empty result; other columns are ignored.
    A very long text is one row, whose words are counted by one expression; it is taken whole or not at all.
    """
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("h")), "sized")
    goal = plan(sized, weights, most).withColumnRenamed("source", "s")
    copies = F.col("rounds") + F.when(F.col("h") < F.col("cut"), 1).otherwise(0)
    return sized.join(goal, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("long").alias("copies"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """The mix itself: each row of `docs` as often as mix() takes it, with all its columns.

    Copies follow from the row's own source and hash, so rows with one id in several sources are taken by each source's
    own plan, and texts aren't shuffled to be matched. Null text, source and id, repeated rows, very long texts and an
    empty table are as in mix(); columns of any names stay as they are.
    """
    sized = docs.select("source", word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("h"))
    s, rounds, cut, k = unused(docs, "s", "rounds", "cut", "k")
    goal = plan(written(sized, "sized"), weights, most).select(F.col("source").alias(s), F.col("rounds").alias(rounds), F.col("cut").alias(cut))
    out = docs.join(goal, docs["source"].eqNullSafe(F.col(s)))
    copies = F.col(rounds) + F.when(id_hash(docs["doc_id"]) < F.col(cut), 1).otherwise(0)
    return out.withColumn(k, copies).where(F.col(k) > 0).withColumn(k, F.explode(F.sequence(F.lit(1), F.col(k).cast("int")))).select(*docs.columns)


#: The same rule for DuckDB, with a sort instead of histograms.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS cap,
         (sum(source_size) OVER ())::BIGINT AS total FROM s),
r AS (SELECT *, cap::DOUBLE / weight AS ratio FROM w),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) > ratio AS capped
  FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap::DOUBLE ELSE weight * ((total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::DOUBLE
              / (sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ())::DOUBLE) END AS target FROM l),
t AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size))::BIGINT ELSE 0 END AS rounds FROM g),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rounds, t.target - t.rounds * t.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE UNBOUNDED PRECEDING) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((rounds + CASE WHEN upto <= budget OR (upto - own <= budget AND upto - budget < budget - (upto - own)) THEN 1 ELSE 0 END) * size)::BIGINT AS taken,
       (rounds + CASE WHEN upto <= budget OR (upto - own <= budget AND upto - budget < budget - (upto - own)) THEN 1 ELSE 0 END)::BIGINT AS copies
FROM c
"""
