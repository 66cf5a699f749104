"""Operator 10: mixing sources to target weights, DataFrame functions only.

Targets are met in equal-token blocks. Sainte-Lague apportionment (highest
quotients target / (2 j + 1)) gives each source a whole number of blocks in every
shard of the mix. A source's blocks stand in a seeded order, pass after pass, and
each shard takes as many of them as its quota, from where the shard before it ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, pieces_of, table, words

#: Words of a block.
BLOCK = 16
#: Shards of the mix that have their own quotas.
SHARDS = 8
#: Most passes over a source.
REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = "42"
#: Documents of a source that are ordered together.
BUCKET_ROWS = 2000
# Primes of similar size that the stride of a source's order is drawn from.
STRIDES = (41421377, 43112609, 49979687, 57885161, 61803419, 67867967, 73856093, 83492791)
#: Blocks below which a product with a stride fits 63 bits.
NARROW = 1 << 36


def _targets(sources: DataFrame) -> DataFrame:
    """Adds weight and target to (key, source_size): weighted shares of all words, held at REPEATS times a source's size.

    Pouring the excess back by weight until no source is above its limit ends
    where every target is min(limit, level * weight); the level is found in one
    ordering of the sources by limit / weight.
    """
    every = Window.partitionBy()
    ranked = sources.withColumn("_rn", F.row_number().over(Window.orderBy("key")))
    ranked = ranked.withColumn("weight", F.get(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (F.col("_rn") - 1) % len(WEIGHTS)))
    limit = F.col("source_size") * float(REPEATS)
    by = Window.orderBy(limit / F.col("weight"), "key")
    full = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = ranked.withColumn("_all", F.sum("source_size").over(every).cast("double")).withColumn("_limit", limit)
    s = s.withColumn("_held", F.sum("_limit").over(full)).withColumn("_left", F.sum("weight").over(every) - F.sum("weight").over(full))
    # level if this source and all before it are held at their limits; then the next ratio must not be below it
    s = s.withColumn("_ratio", F.col("_limit") / F.col("weight")).withColumn("_before", (F.col("_all") - (F.col("_held") - F.col("_limit"))) / (F.col("_left") + F.col("weight")))
    s = s.withColumn("_level", F.min(F.when(F.col("_ratio") >= F.col("_before"), F.struct("_ratio", "_before"))).over(every)["_before"])
    return s.withColumn("target", F.least(F.col("_limit"), F.coalesce(F.col("_level") * F.col("weight"), F.col("_limit")))).select("key", "source_size", "rows", "weight", "target")


def _seats(target: Column, divisor: Column) -> Column:
    """Quotients target / (2 j + 1) at or above divisor / 2."""
    return F.when(target <= 0, F.lit(0)).otherwise(F.floor(target / divisor + 0.5)).cast("bigint")


def quotas(sources: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """(key, quotas array<bigint> by shard) from (key, target): whole blocks by Sainte-Lague.

    Seats are dealt in order of the quotients and shard s takes seats number
    floor(s * seats / shards) on, so its quotas are what the method gives after
    that seat less what it gave before. All but 2 * sources quotients are known
    to lie above or below the cut, so only these are ranked. Equal quotients go
    to the smaller key.
    """
    every = Window.partitionBy()
    s = sources.withColumn("_sum", F.sum("target").over(every)).withColumn("_n", F.count("*").over(every))
    s = s.withColumn("_cut", F.explode(F.sequence(F.lit(1), F.lit(shards))))
    s = s.withColumn("_seats", F.floor(F.round(F.col("_sum") / block) * F.col("_cut") / shards).cast("bigint"))
    low = F.col("_seats") - F.col("_n") / 2
    sure = F.when(low > 0, _seats(F.col("target"), F.col("_sum") / low)).otherwise(F.lit(0).cast("bigint"))
    most = F.when(F.col("_seats") > 0, _seats(F.col("target"), F.col("_sum") / (F.col("_seats") + F.col("_n") / 2)))
    s = s.withColumn("_sure", sure).withColumn("_most", F.greatest(F.col("_sure"), F.coalesce(most, F.lit(0))))
    s = s.withColumn("_open", F.col("_seats") - F.sum("_sure").over(Window.partitionBy("_cut")))
    asked = s.where("_most > _sure").withColumn("_j", F.explode(F.sequence(F.col("_sure"), F.col("_most") - 1)))
    asked = asked.withColumn("_rank", F.row_number().over(Window.partitionBy("_cut").orderBy((F.col("target") / (2 * F.col("_j") + 1)).desc(), "key", "_j")))
    won = asked.where("_rank <= _open").groupBy("key", "_cut").agg(F.count("*").alias("_won"))
    total = s.join(won, ["key", "_cut"], "left").select("key", "_cut", (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias("_q"))
    step = total.withColumn("_d", F.col("_q") - F.coalesce(F.lag("_q").over(Window.partitionBy("key").orderBy("_cut")), F.lit(0)))
    return step.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("_cut", "_d"))).alias("_l")).select("key", F.transform("_l", lambda x: x["_d"]).alias("quotas"))


def _drawn(name: Column, part: int) -> Column:
    """A seeded number below 2**32 from a source's name."""
    return F.conv(F.substring(F.md5(F.concat(name, F.lit(f":{SEED}"))), 1 + 8 * part, 8), 16, 10).cast("bigint")


def stride(name: Column, n: Column) -> Column:
    """A seeded prime that does not divide n: the drawn one or one of the two after it (three divide no bigint at once)."""
    first = _drawn(name, 1)
    primes = [F.get(F.array(*[F.lit(p).cast("bigint") for p in STRIDES]), (first + i) % len(STRIDES)) for i in range(3)]
    return F.when(n % primes[0] != 0, primes[0]).when(n % primes[1] != 0, primes[1]).otherwise(primes[2])


def pick(block: Column, n: Column, step: Column, shift: Column) -> Column:
    """Place of a block in the seeded order: a bijection of 0 .. n - 1 for any n; products beyond 63 bits are decimals."""
    narrow = F.pmod((block % n) * (step % n) + shift, n)
    whole = lambda c: c.cast("decimal(19,0)")
    wide = (whole(block % n) * whole(step % n) + whole(shift)) % whole(n)
    return F.when(n < NARROW, narrow).otherwise(wide.cast("bigint"))


def plan(docs: DataFrame, carry: list[str], block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """For each row of docs (doc_id, text, source; of these and others ``carry`` stays): doc_id, size, source_size, target, quotas, _at, _passes, _extra, _left, _blocks, _step, _shift.

    ``_at`` is where the row begins on its source's axis of words, whose order
    is by a seeded digest of the doc_id; rows of equal id are ordered by size and
    a digest of the text. A null text has size 0, a null source is a source of its own, after
    all others. A source's rows are ordered in buckets of the digest, so no task
    holds more than a bucket.
    """
    sized = docs.withColumn("key", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")))
    sized = sized.withColumn("size", F.size(words(F.col("text"))).cast("bigint"))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{SEED}")))
    sized = sized.withColumn("_tie", F.md5(F.coalesce("text", F.lit(""))))
    sized = sized.select(*[c for c in sized.columns if c in carry], "key", "size", "_tie", "doc_id", digest.alias("_order"))
    if not carry:  # narrow rows: texts are split once
        sized = Workspace(docs.sparkSession, "mixing").put(sized, "sized")
    buckets = max(64, pieces_of((docs if carry else sized).count(), BUCKET_ROWS))
    sized = sized.withColumn("bucket", F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("bigint") * buckets / 4294967296).cast("int"))
    narrow = sized.groupBy("key", "bucket").agg(F.sum("size").alias("_sum"), F.count("*").alias("_rows"))
    sources = narrow.groupBy("key").agg(F.sum("_sum").alias("source_size"), F.sum("_rows").alias("rows"))
    aims = _targets(sources)
    held = aims.join(quotas(aims, block, shards), "key")
    size, quota = F.col("source_size"), F.aggregate("quotas", F.lit(0).cast("bigint"), lambda a, x: a + x)
    held = held.withColumn("_words", F.least(quota * block, size * REPEATS)).withColumn("_passes", F.when(size > 0, F.floor(F.col("_words") / size)).otherwise(0).cast("bigint"))
    held = held.withColumn("_rest", F.col("_words") - F.col("_passes") * size).withColumn("_blocks", F.ceil(size / block).cast("bigint"))
    held = held.withColumn("_extra", F.floor(F.col("_rest") / block).cast("bigint")).withColumn("_left", (F.col("_rest") % block).cast("bigint"))
    held = held.withColumn("_shift", F.when(F.col("_blocks") > 0, F.pmod(_drawn(F.col("key.name"), 0), F.col("_blocks")))).withColumn("_step", F.when(F.col("_blocks") > 0, stride(F.col("key.name"), F.col("_blocks"))))
    run = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = narrow.withColumn("_start", F.coalesce(F.sum("_sum").over(run), F.lit(0))).select("key", "bucket", "_start")
    starts = starts.join(held.drop("rows", "weight", "_words", "_rest"), "key")
    inside = Window.partitionBy("key", "bucket").orderBy("_order", "doc_id", "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["key", "bucket"]).withColumn("_at", F.col("_start") + F.col("_in")).drop("_in", "_start", "_order", "_tie", "bucket")


def _numbers(block: int, some: Column) -> Column:
    """Numbers of the blocks that a row has words in, where ``some`` holds."""
    at, size = F.col("_at"), F.col("size")
    first, last = F.floor(at / block).cast("bigint"), F.floor((at + size - 1) / block).cast("bigint")
    return F.when((size > 0) & some, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _part(block: int, k: Column, has: Column) -> tuple[Column, Column]:
    """From and to, in words of the row, of the first ``has`` words of block k."""
    return F.greatest(k * block - F.col("_at"), F.lit(0).cast("bigint")), F.least(k * block + has - F.col("_at"), F.col("size"))


def _cuts(block: int) -> Column:
    """Parts of a row (from, to: words counted from its first) that the extra blocks take."""

    def cut(k: Column) -> Column:
        place = pick(k, F.col("_blocks"), F.col("_step"), F.col("_shift"))
        has = F.when(place < F.col("_extra"), F.lit(block)).when(place == F.col("_extra"), F.col("_left")).otherwise(F.lit(0)).cast("bigint")
        lo, hi = _part(block, k, has)
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    return F.filter(F.transform(_numbers(block, (F.col("_extra") > 0) | (F.col("_left") > 0)), cut), lambda x: x["hi"] > x["lo"])


def mix_blocks(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """The mix by shards: doc_id, source, block, pass, lo, hi, shard for every stretch of words that a shard takes of a document (doc_id, text, source).

    A source's copies of blocks are numbered pass by pass in the seeded order, and
    shard s takes those from its predecessors' quotas on, as many as its own quota;
    a block cut by the limit of REPEATS passes belongs to the last shard that has a quota there.
    """
    planned = plan(docs.select("doc_id", "source", "text"), ["source"], block, shards)
    k, n = F.col("block"), F.col("_blocks")
    rows = planned.withColumn("block", F.explode(_numbers(block, F.lit(True)))).withColumn("_place", pick(k, n, F.col("_step"), F.col("_shift")))
    more = (F.col("_place") < F.col("_extra")) | ((F.col("_place") == F.col("_extra")) & (F.col("_left") > 0))
    passes = F.col("_passes") + F.when(more, 1).otherwise(0)
    rows = rows.where(passes > 0).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), passes - 1)))
    has = F.when((F.col("pass") < F.col("_passes")) | (F.col("_place") < F.col("_extra")), F.lit(block)).otherwise(F.col("_left")).cast("bigint")
    lo, hi = _part(block, k, has)
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda i: F.aggregate(F.slice("quotas", 1, i), F.lit(0).cast("bigint"), lambda a, x: a + x))
    at = F.col("pass") * n + F.col("_place")
    shard = F.least(F.size(F.filter(ends, lambda e: e <= at)), F.lit(shards - 1))
    return rows.select("doc_id", "source", "block", "pass", lo.alias("lo"), hi.alias("hi"), shard.alias("shard")).where("hi > lo")


def mix_counts(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs (doc_id, text, source).

    A null text has size 0, texts of any length count whole, a null source is a
    source of its own after all others. Repeated rows and equal ids are rows of
    their own and ties are settled by digests, so reruns agree; null ids are ids.
    Other columns are ignored. Empty tables give no rows; where all texts are blank
    every target and taken is 0. Only the table of sources is ordered in one task.
    """
    narrow = docs.select("doc_id", "source", "text")
    planned = plan(narrow, [], block, shards)
    got = F.aggregate(_cuts(block), F.lit(0).cast("bigint"), lambda a, x: a + x["hi"] - x["lo"])
    return planned.select("doc_id", "size", "source_size", "target", (F.col("_passes") * F.col("size") + got).alias("taken"))


def mix_documents(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each pass over a document, then one of its extra blocks' words.

    Whole passes keep the text as it is; the extra row has the picked words, one
    space between them, and n_chars follows the text. Documents that the mix takes
    nothing of leave; documents without words stay as they are, as they weigh nothing.
    """
    columns = docs.columns
    others = [c for c in columns if c not in ("doc_id", "text", "n_chars")]
    narrow = docs.select("doc_id", "source", "text", F.struct(*others).alias("_row"))
    planned = plan(narrow, ["text", "_row"], block, shards).withColumn("_parts", _cuts(block))
    picked = lambda w: F.array_join(F.flatten(F.transform("_parts", lambda x: F.slice(w, x["lo"].cast("int") + 1, (x["hi"] - x["lo"]).cast("int")))), " ")
    some = F.when(F.size("_parts") > 0, F.get(F.transform(F.array(words(F.col("text"))), picked), F.lit(0)))  # a text is split once, not for each part
    whole = F.array_repeat(F.col("text"), F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("_passes")).cast("int"))
    texts = F.concat(whole, F.when(some.isNotNull(), F.array(some)).otherwise(F.array().cast("array<string>")))
    out = planned.withColumn("_text", F.explode(texts))
    kept = {"doc_id": F.col("doc_id"), "text": F.col("_text"), "n_chars": F.length("_text").cast("bigint")}
    return out.select(*[kept[c].alias(c) if c in kept else F.col("_row")[c].alias(c) for c in columns])


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents"))


_SQL = [f"(list_value({', '.join(map(str, STRIDES))})[1 + (('0x' || substr(md5(coalesce(d.source, '') || ':{SEED}'), 9, 8))::BIGINT + {i}) % {len(STRIDES)}])" for i in range(3)]
#: The same by ordinary SQL.
ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, length(text) AS nc, text, md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}') AS o,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, CASE (rn - 1) % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS weight, source_size * 3.0::DOUBLE AS lim, (sum(source_size) OVER ())::DOUBLE AS total FROM s),
p AS (SELECT *, sum(lim) OVER (ORDER BY lim / weight, rn ROWS UNBOUNDED PRECEDING) AS held, sum(weight) OVER () - sum(weight) OVER (ORDER BY lim / weight, rn ROWS UNBOUNDED PRECEDING) AS after_w FROM w),
q AS (SELECT *, (total - (held - lim)) / (after_w + weight) AS lvl FROM p),
t AS (SELECT source, rn, source_size, least(lim, coalesce((SELECT lvl FROM q AS x WHERE x.lim / x.weight >= x.lvl ORDER BY x.lim / x.weight, x.lvl LIMIT 1) * weight, lim)) AS target FROM q),
seats AS (SELECT round(sum(target) / {BLOCK})::BIGINT AS n FROM t),
quotient AS (SELECT rn, j, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, rn, j) AS r FROM (SELECT t.rn, t.target, unnest(range((t.target / {BLOCK})::BIGINT + 1000)) AS j FROM t WHERE t.target > 0)),
quota AS (SELECT rn, count(*) FILTER (r <= (SELECT n FROM seats)) AS won FROM quotient GROUP BY rn),
h AS (SELECT t.*, least(coalesce(won, 0) * {BLOCK}, source_size * 3)::BIGINT AS wanted, ceil(source_size / {BLOCK}::DOUBLE)::BIGINT AS blocks FROM t LEFT JOIN quota USING (rn)),
g AS (SELECT *, CASE WHEN source_size > 0 THEN wanted // source_size ELSE 0 END AS passes, CASE WHEN source_size > 0 THEN wanted % source_size ELSE 0 END AS rest FROM h),
a AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.passes, g.rest // {BLOCK} AS extra, g.rest % {BLOCK} AS part, g.blocks,
             CASE WHEN blocks > 0 THEN ('0x' || substr(md5(coalesce(d.source, '') || ':{SEED}'), 1, 8))::BIGINT % blocks END AS shift,
             CASE WHEN blocks % {_SQL[0]} <> 0 THEN {_SQL[0]} WHEN blocks % {_SQL[1]} <> 0 THEN {_SQL[1]} ELSE {_SQL[2]} END AS stride,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size, md5(coalesce(d.text, '')) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
k AS (SELECT *, row_number() OVER () AS id FROM a),
b AS (SELECT id, pos, size, extra, part, kk, ((kk % blocks)::HUGEINT * (stride % blocks) + shift) % blocks AS place
      FROM (SELECT *, unnest(range(pos // {BLOCK}, (pos + size - 1) // {BLOCK} + 1)) AS kk FROM k WHERE size > 0)),
c AS (SELECT id, sum(greatest(0, least(kk * {BLOCK} + CASE WHEN place < extra THEN {BLOCK} WHEN place = extra THEN part ELSE 0 END - pos, size) - greatest(kk * {BLOCK} - pos, 0)))::BIGINT AS got FROM b GROUP BY id)
SELECT doc_id, size, source_size, target, (passes * size + coalesce(got, 0))::BIGINT AS taken FROM k LEFT JOIN c USING (id)
"""
