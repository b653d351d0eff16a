"""Document fingerprints from closed syncmers.

A k-mer is a closed syncmer if the smallest hash of its inner s-mers is that of its first or its last s-mer. That
depends on the k-mer alone, so texts that share a passage share its anchors wherever it stands. Texts are matched by
position through links: a link is an anchor, the next anchor, and the distance between them, so a passage's links agree
in order and offset wherever it stands, and anchors that texts share in other places or orders don't count. Likeness is
that of all links; a fingerprint is a compact text of the smallest hashes of links. Everything is DataFrame code over
arrays: s-mers by one regular expression, window minima by doubling, no position is ever looked up in the text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cuts, let, part_of, written

#: Characters of a k-mer and of its inner s-mers; a k-mer holds 8 of these (the doubling below fixes that number).
S = 6
K = S + 7
#: Hashes in a fingerprint.
SKETCH = 64
#: Documents to a bucket of neighbours, about; ranges that the ids' quantiles cut, at most.
NEIGHBOURS, RANGES = 256, 4096


def short(h: Column) -> Column:
    """31 bits of a 64-bit hash."""
    return F.shiftrightunsigned(h, 33).cast("int")


def place(anchor: Column) -> Column:
    return F.shiftright(anchor, 32)


def hash_of(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def anchors(text: Column) -> Column:
    """Closed syncmers of a text in order, each as one long: pos (in code points from 0) << 32 | hash of 31 bits."""
    mins = lambda a, step: let(a, lambda v: F.zip_with(v, F.slice(v, F.lit(step + 1), F.size(v)), lambda p, q: F.least(p, q)))

    def of(h: Column) -> Column:
        # A window of 8 is two of 4; an edge holds the smallest hash if the smaller edge is no larger than both. The last
        # 7 windows are not whole.
        def of_fours(low: Column) -> Column:
            closed = lambda x, i: F.least(F.get(h, i), F.get(h, i + 7)) <= F.least(x, F.get(low, i + 4))
            mark = lambda x, i: F.when(closed(x, i), F.shiftleft(i.cast("long"), 32) + short(F.xxhash64(F.get(h, i), F.get(h, i + 3), F.get(h, i + 7))))
            return F.filter(F.transform(F.slice(low, F.lit(1), F.greatest(F.size(h) - 7, F.lit(0))), mark), lambda a: a.isNotNull())

        return let(mins(mins(h, 1), 2), of_fours)

    smers = F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{S}}}))."), 1)
    return let(F.transform(smers, lambda x: F.xxhash64(x)), of)


def links(own: Column, whole: Column) -> Column:
    """All distinct links of a text's anchors, sorted: 31-bit hashes of an anchor, the next one and their distance. A
    single anchor stands for itself; a text without anchors has one link, its whole; the empty text has none."""
    linked = lambda p, q: short(F.xxhash64(hash_of(p), hash_of(q), place(q) - place(p)))
    pairs = F.zip_with(F.slice(own, F.lit(1), F.size(own) - 1), F.slice(own, F.lit(2), F.size(own)), linked)
    some = F.when(F.size(own) > 1, pairs).when(F.size(own) == 1, F.transform(own, hash_of)).when(whole != "", F.array(short(F.xxhash64(whole)))).otherwise(F.array().cast("array<int>"))
    return F.sort_array(F.array_distinct(some))


def as_text(found: Column) -> Column:
    """The fingerprint of sorted hashes: the first SKETCH of them."""
    return F.array_join(F.transform(F.slice(found, F.lit(1), F.lit(SKETCH)), lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; two empty ones are alike."""
    return let(F.size(F.array_intersect(a, b)), lambda both: F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / (F.size(a) + F.size(b) - both))).cast("double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint and all distinct links as an array, for each row; null text is the empty text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", F.length(text).cast("long").alias("n_chars"), let(anchors(text), lambda own: links(own, text)).alias("links"))
    return found.select("doc_id", "n_chars", as_text(F.col("links")).alias("fingerprint"), "links")


def positions(docs: DataFrame) -> DataFrame:
    """doc_id, pos, hash: a row for each anchor, to match passages by position."""
    return docs.select("doc_id", F.explode(anchors(F.coalesce(F.col("text"), F.lit("")))).alias("a")).select("doc_id", place(F.col("a")).cast("int").alias("pos"), hash_of(F.col("a")).alias("hash"))


def buckets(docs: DataFrame) -> tuple[Column, Column]:
    """Two numbers of a row: the range of its id, and its bucket, which follows the order of ids.

    Ids' quantiles cut ranges of equal numbers of rows, so ids that crowd or stray don't make a bucket large; with more
    than RANGES * NEIGHBOURS rows each range is cut evenly again.
    """
    facts = docs.agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    ranges = int(min(RANGES, facts["n"] // NEIGHBOURS + 1))
    edges = [int(x) for x in cuts(docs, "doc_id", ranges)]
    part, fine = part_of(F.col("doc_id").cast("long"), edges), -(-facts["n"] // (ranges * NEIGHBOURS)) or 1
    if fine == 1:
        return part, part.cast("long")
    los, ends = [int(facts["lo"]), *edges], [*edges, int(facts["hi"]) + 1]
    at = lambda xs: F.get(F.array(*map(F.lit, xs)), part)
    even = F.floor((F.col("doc_id") - at(los)) / at([max(1, -(-(b - a) // fine)) for a, b in zip(los, ends)]))
    return part, part.cast("long") * fine + F.least(F.lit(fine - 1), F.greatest(F.lit(0), even))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document's are.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document by ascending doc_id; the last document's next is the first. The anchors of the edited text are those of
    its two parts and those of the seam, so no part of a text is searched twice and texts are shuffled once.

    Null text is the empty text. Documents with equal ids follow each other by text; a row without id comes after all
    others, so that its next is the first document, and is no document's next (with no ids at all, nothing follows).
    Repeated rows get a row each; an empty table gives an empty result; other columns are ignored. A very long text's
    anchors are arrays in one row, whose memory grows with the text.

    Neighbours meet in buckets of about 256 (see buckets()). Rows that repeat one id share a bucket, which Spark sorts
    and spills.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    part, bucket = buckets(docs)
    spot = [F.coalesce(part, F.lit(-1)).alias("part"), F.coalesce(bucket, F.lit(-1).cast("long") - F.pmod(F.xxhash64(text), F.lit(1024)), F.lit(0).cast("long")).alias("bucket")]
    # Not null, or Spark would filter each use of the exchange below differently and shuffle the texts again.
    rows = docs.select("doc_id", text.alias("text"), spot[1])
    order = Window.partitionBy("bucket").orderBy("doc_id", "text")
    lead = lambda c: F.when(F.col("bucket") >= 0, F.lead(c).over(order))
    seen = rows.withColumn("at", F.row_number().over(order)).withColumn("next", lead("text")).withColumn("given", F.floor(F.lag(F.length("text")).over(order) / 2).cast("int"))

    # Within a bucket each document also finds the anchors of what the one before it takes over, and hands them back by
    # the window.
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    upto = lambda own, m: let(m, lambda most: F.filter(own, lambda a: place(a) + K <= most))
    moved = lambda own, by: let(F.shiftleft(by.cast("long"), 32), lambda m: F.transform(own, lambda a: a + m))
    own_parts = lambda own, *more: F.struct(links(own, F.col("text")).alias("own"), upto(own, n - half).alias("kept"), *more)
    found = seen.withColumn("s", let(anchors(F.col("text")), lambda own: own_parts(own, upto(own, F.coalesce("given", F.lit(0))).alias("given"))))
    kept, added = F.left("text", n - half), F.left("next", half)
    seam = F.concat(F.right(kept, F.lit(K - 1)), F.left(added, F.lit(K - 1)))
    parts = F.concat("s.kept", moved(anchors(seam), n - half - F.least(n - half, F.lit(K - 1))), moved(F.col("next_given"), n - half))
    row = lambda df: df.select("doc_id", n.cast("long").alias("n_chars"), F.concat(kept, added).alias("edited"), F.col("s.own").alias("links"), parts.alias("parts"), "next_links")
    inner = row(found.withColumn("next_links", lead("s.own")).withColumn("next_given", lead("s.given")).where("next IS NOT NULL"))

    # The last document of each bucket looks up the next bucket's first, which may be in the next range (of these there
    # are at most RANGES). Rows without id look up the first of all, of which each of their buckets has a copy.
    used = written(docs.select(*spot).distinct(), "buckets")
    starts = used.where("part >= 0").groupBy("part").agg(F.min("bucket").alias("start"))
    first = starts.agg(F.min("start")).first()[0]
    starts = starts.select("part", F.coalesce(F.lead("start").over(Window.orderBy("part")), F.lit(first)).alias("turn"))
    after = used.where("part >= 0").withColumn("follow", F.lead("bucket").over(Window.partitionBy("part").orderBy("bucket"))).join(starts, "part")
    after = after.select("bucket", F.coalesce("follow", "turn").alias("next_bucket")).unionByName(used.where("part < 0").select("bucket", (F.col("bucket") - 1024).alias("next_bucket")))
    heads = seen.where("at = 1").select(F.col("bucket").alias("next_bucket"), F.col("text").alias("head"))
    copies = used.where("part < 0").select((F.col("bucket") - 1024).alias("lost"), F.lit(first).cast("long").alias("next_bucket")).join(heads, "next_bucket").select(F.col("lost").alias("next_bucket"), "head")
    ends = seen.where("next IS NULL").drop("next").join(after, "bucket").join(heads.unionByName(copies), "next_bucket", "left").withColumn("next", F.coalesce("head", F.lit("")))
    ends = ends.withColumn("s", let(anchors(F.col("text")), lambda own: own_parts(own)))
    outer = row(ends.withColumn("next_links", let(anchors(F.col("next")), lambda own: links(own, F.col("next")))).withColumn("next_given", anchors(added)))

    both = inner.unionByName(outer).withColumn("edited_links", let(F.col("parts"), lambda own: links(own, F.col("edited"))))
    return both.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("links")).alias("fingerprint"), as_text(F.col("edited_links")).alias("edited_fingerprint"), likeness(F.col("links"), F.col("edited_links")).alias("near_edited"), likeness(F.col("links"), F.col("next_links")).alias("near_next"))
