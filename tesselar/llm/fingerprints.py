"""Operator 1: threshold-scaled document fingerprints, DataFrame functions only.

A text's sketch keeps every hash of a five-word shingle that lies below a fixed
fraction of the hash range. Sketches of any two texts, however unequal, are cut
at the same threshold, so unions of sketches are sketches of unions and shared
hashes over either sketch's hashes estimate containment as well as resemblance.
Sketches merge: the sketch of a collection is the union of its texts' sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pieces_of, table, words

SHINGLE = 5
#: Kept share of shingle hashes: one in SCALE.
SCALE = 4
#: Documents that one range of ids holds when documents are put in order.
RANGE_ROWS = 2000
#: Ranges whose numbers are ordered together.
RANGES = 4096
#: Most quantiles of ids that are looked up for a row.
CUTS = 128


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """Sorted distinct shingle hashes (48 bits) below 2**48 / scale, as array<bigint>.

    A text of fewer words than a shingle has one shingle, all its words, whose hash
    is drawn below the threshold so that it is always kept; a null or blank text has
    none. Words are hashed once, shingles from word hashes. Nothing bounds a sketch
    but its text: a very long text has a sketch of its share of the shingles.
    """
    hashed, limit = F.transform(words(text), lambda w: F.xxhash64(w)), (1 << 48) // scale

    def grams(h: Column) -> Column:
        whole = F.when(F.size(h) > 0, F.array(F.shiftrightunsigned(F.xxhash64(F.lit("whole"), F.array_join(F.transform(h, lambda x: x.cast("string")), " ")), 16) % limit)).otherwise(F.array().cast("array<bigint>"))
        at = F.sequence(F.lit(0), F.size(h) - shingle)
        return F.when(F.size(h) < shingle, whole).otherwise(F.filter(F.transform(at, lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + k) for k in range(shingle)]), 16)), lambda x: x < limit))

    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  evaluated once, used often
    return F.array_sort(F.array_distinct(once(hashed, grams)))


def encode(text: Column, kept: Column) -> Column:
    """Fingerprint string: the text's own hash, then the sketch in hexadecimal.

    The first part tells texts apart whose sketches are both empty.
    """
    own = F.lower(F.lpad(F.hex(F.xxhash64(F.coalesce(text, F.lit("")))), 16, "0"))
    return F.concat(own, F.lit(":"), F.array_join(F.transform(kept, lambda x: F.lower(F.lpad(F.hex(x), 12, "0"))), ""))


def decode(fingerprint: Column) -> Column:
    """The sketch of a fingerprint string."""
    body = F.substring_index(fingerprint, ":", -1)
    n = (F.length(body) / 12).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substring(body, i * 12 + 1, F.lit(12)), 16, 10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def resemblance(a: Column, b: Column, same: Column) -> Column:
    """Estimated Jaccard likeness of two sketches; 1 where ``same`` holds, 0 if both are empty otherwise."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(same, F.lit(1.0)).when(union > 0, shared / union).otherwise(F.lit(0.0))


def containment(a: Column, b: Column, same: Column) -> Column:
    """Estimated share of a's shingles that b has; 1 where ``same`` holds, 0 if a's sketch is empty otherwise."""
    return F.when(same, F.lit(1.0)).when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def merge(a: Column, b: Column) -> Column:
    """The sketch of two sketches' texts together."""
    return F.array_sort(F.array_union(a, b))


def merged(sketches: DataFrame, by: str, kept: str = "kept") -> DataFrame:
    """(by, kept): the sketch of each group's texts together, from rows (by, kept). Hashes are made distinct before they are gathered; a group's sketch is as large as its texts ask for."""
    once = sketches.select(by, F.explode_outer(kept).alias("_x")).distinct()
    return once.groupBy(by).agg(F.array_sort(F.collect_list("_x")).alias(kept))


def in_order(docs: DataFrame, n: int, shingle: int, scale: int) -> DataFrame:
    """Adds _next and _next_kept, the _text and _kept of the next row by _id; after the last row comes the first.

    Rows are dealt to ranges of ids of about RANGE_ROWS rows: at most CUTS
    quantiles, each split evenly. A range is ordered by itself; its last row
    takes the first row of the next range that has rows, found by a join on the
    range's number. Range numbers are ordered in groups of RANGES, and only the
    groups' heads, one for some 8 million rows, in one task.
    """
    k = pieces_of(n, RANGE_ROWS)
    cuts = min(k, CUTS)
    found = docs.agg(F.min("_id").alias("lo"), F.max("_id").alias("hi"), F.percentile_approx("_id", [i / cuts for i in range(1, cuts)] or [0.5], 10 * CUTS).alias("q")).first()
    edges = sorted({found["lo"] or 0, *(found["q"] or [] if cuts > 1 else []), found["hi"] or 0})
    within = -(-k // cuts)
    bounds = F.array(*[F.lit(x).cast("bigint") for x in edges])
    slot = F.least(F.greatest(F.size(F.filter(bounds, lambda b: b <= F.col("_id"))) - 1, F.lit(0)), F.lit(max(len(edges) - 2, 0)))
    # in doubles, as differences of ids may not fit a bigint; they keep the order
    low, high = F.get(F.col("_bounds"), F.col("_slot")).cast("double"), F.get(F.col("_bounds"), F.col("_slot") + 1).cast("double")
    inside = F.coalesce(F.floor((F.col("_id").cast("double") - low) * F.lit(float(within)) / F.nullif(high - low, F.lit(0.0))), F.lit(0))
    part = F.when(F.col("_id").isNotNull(), F.col("_slot") * within + F.least(F.greatest(inside, F.lit(0)), F.lit(within - 1)))
    ranged = docs.withColumn("_slot", slot).withColumn("_bounds", bounds).withColumn("_range", F.coalesce(part.cast("bigint"), F.lit(-1))).drop("_slot", "_bounds")
    firsts = ranged.groupBy("_range").agg(F.min_by("_text", F.struct("_id", "_text")).alias("_first"))
    numbers = firsts.select("_range").withColumn("_g", F.floor(F.col("_range") / RANGES))
    w = Window.orderBy("_g")
    heads = numbers.groupBy("_g").agg(F.min("_range").alias("_head"))
    heads = heads.select("_g", F.coalesce(F.lead("_head").over(w), F.min("_head").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_head"))
    follow = numbers.withColumn("_lead", F.lead("_range").over(Window.partitionBy("_g").orderBy("_range"))).join(heads, "_g").select("_range", F.coalesce("_lead", "_head").alias("_follow"))
    follow = follow.join(firsts.select(F.col("_range").alias("_follow"), "_first"), "_follow").select("_range", "_first", sketch(F.col("_first"), shingle, scale).alias("_first_kept"))
    by = Window.partitionBy("_range").orderBy("_id", "_text")
    led = ranged.withColumn("_next", F.lead("_text").over(by)).withColumn("_next_kept", F.lead("_kept").over(by))
    return led.join(follow, "_range").withColumn("_next_kept", F.coalesce("_next_kept", "_first_kept")).withColumn("_next", F.coalesce("_next", "_first")).drop("_first", "_first_kept", "_range")


def fingerprint_documents(docs: DataFrame, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Fingerprints of documents (doc_id, text), of their edited texts and the likeness of neighbours.

    The edited text has the last floor(n / 2) code points replaced by the first
    as many (or all) of the next document's by doc_id. A null text counts as
    empty and a null doc_id comes first; repeated ids are ordered by text, and ids
    may be any bigint. Whole texts are read, however long. Other columns are
    ignored. An empty table gives no rows; a single document is its own next.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    own = own.withColumn("_kept", sketch(F.col("_text"), shingle, scale))
    n = docs.count()
    if not n:
        pairs = own.withColumn("_next", F.col("_text")).withColumn("_next_kept", F.col("_kept"))
    else:
        pairs = in_order(own, n, shingle, scale)
    half = F.floor(F.length("_text") / 2).cast("int")
    pairs = pairs.withColumn("_edited", F.concat(F.substring("_text", F.lit(1), F.length("_text") - half), F.substring(F.col("_next"), F.lit(1), half)))
    pairs = pairs.withColumn("_edited_kept", sketch(F.col("_edited"), shingle, scale))
    return pairs.select(
        F.col("_id").alias("doc_id"),
        F.length("_text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("_edited"), 256).alias("edited_sha256"),
        encode(F.col("_text"), F.col("_kept")).alias("fingerprint"),
        encode(F.col("_edited"), F.col("_edited_kept")).alias("edited_fingerprint"),
        resemblance(F.col("_kept"), F.col("_edited_kept"), F.col("_text") == F.col("_edited")).alias("near_edited"),
        resemblance(F.col("_kept"), F.col("_next_kept"), F.col("_text") == F.col("_next")).alias("near_next"),
        containment(F.col("_kept"), F.col("_edited_kept"), F.col("_text") == F.col("_edited")).alias("contained_in_edited"),
    )


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
