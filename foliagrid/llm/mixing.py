"""Mixing sources to target weights by systematic sampling, with DataFrame operations only."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import Scratch

#: Fixed values of the mix: weights by the source's place in code point order, the share of all words, the repeat limit.
WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_COPIES = 2
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share_percent=SHARE_PERCENT, most=MOST_COPIES) -> DataFrame:
    """(source, place, source_size, target): targets share share_percent of all words by weight and stop at most times
    a source's words; what is above is shared again by weight. One row per source; null is a source, the last. Sources alone come to one task.

    With sources in order of limit / weight, those below the water level are full and the rest have level * weight. The
    level that holds if all before a source are full comes from prefix sums; it is right for the first source that isn't
    full, and less for all after that one.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    place = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("place", F.row_number().over(ordered) - 1)
    weighed = place.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("most", F.col("source_size") * F.lit(most)).withColumn("fill", F.col("most") / F.col("weight"))
    below = Window.orderBy("fill", "place").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("fill", "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * share_percent / 100 - F.coalesce(F.sum("most").over(below), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    leveled = weighed.withColumn("level", level).withColumn("level", F.max(F.when(F.col("fill") >= F.col("level"), F.col("level"))).over(every))
    target = F.when(F.col("level").isNull(), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), F.col("weight") * F.col("level")))
    return leveled.select("source", F.col("place").cast("long").alias("place"), "source_size", target.alias("target"))


def offset_of(place: Column, seed: int) -> Column:
    """One pseudo-random offset in [0, 1) for each source, in steps of 1 / 65536."""
    return F.pmod((place + 1) * 40_503 + F.lit(seed) * 30_011, F.lit(65_536)).cast("decimal(10,0)") / F.lit(65_536).cast("decimal(10,0)")


def ranked(sizes: DataFrame, scratch: Scratch, of_source: DataFrame | None = None) -> DataFrame:
    """sizes (doc_id, source, size, row_key) with rank: a row's place in its source by size, doc_id and row_key; and with
    the columns of of_source, one row per source.

    Rows are sorted in ranges, whatever their keys, and written with their places in them; what a source has in a range
    is counted, and the counts before it are summed. Rows learn this by range and source, so a source, a size or a doc_id
    that most rows have is dealt to many tasks. Rows that are equal in everything are interchangeable.
    """
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_last(), F.col("row_key"), F.col("__row")]
    dealt = sizes.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    rows = scratch.save(dealt.select("doc_id", "source", "size", "row_key", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "placed")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("part", "source").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("start"))
    base = counts.select(F.col("part").alias("p"), F.col("source").alias("s"), "start", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    if of_source is not None:
        base = base.join(of_source.withColumnRenamed("source", "t"), F.col("s").eqNullSafe(F.col("t"))).drop("t")
    joined = rows.join(base, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    return joined.withColumn("rank", F.col("base") + F.col("at") - F.col("start")).drop("p", "s", "part", "at", "start", "base")


def mix_sizes(sizes: DataFrame, seed: int = 0, scratch: Scratch | None = None, **mix) -> DataFrame:
    """Copies of each row of (doc_id, source, size, row_key): those, source_size, target, copies.

    Every document of a source expects target / source_size copies. Documents are lined up by size, then doc_id, so the
    prefix sum of expected copies before the row of rank i of a source is i times that; a document is emitted once for
    each integer that its interval, moved by the source's offset, crosses. Neighbours have like sizes, so taken words
    differ from the target by the longest document's size at most. A source without words has target 0 and no copies.
    """
    rows = ranked(sizes, scratch or Scratch(sizes.sparkSession, "mix"), source_targets(sizes, **mix))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).cast("decimal(20,18)")
    edge = lambda i: F.floor(i.cast("decimal(14,0)") * F.col("expected") + offset_of(F.col("place"), seed))
    rows = rows.withColumn("expected", expected)
    return rows.select("doc_id", "source", "size", "row_key", "source_size", "target", (edge(F.col("rank") + 1) - edge(F.col("rank"))).cast("long").alias("copies"))


def mix(docs: DataFrame, seed: int = 0, **options) -> DataFrame:
    """The copies of each document: doc_id, source, size, row_key (a hash of the text), source_size, target, copies, taken.

    Sizes are read from the texts once and written to a scratch table. A null text has size 0, a null source is one, rows
    that repeat are documents each; an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    text = F.col("text").cast("string")
    sizes = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("row_key")), "sizes")
    return mix_sizes(sizes, seed, scratch, **options).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, seed: int = 0, **options) -> DataFrame:
    """The documents of the mix, each repeated as often as it was emitted, with the columns of docs.

    Rows are matched to their copies by doc_id, source and a hash of the text; rows that share all three are numbered by
    a hash of the whole row, those with more copies first, so that reruns and tasks that run again agree. Nulls in any
    column are values like others; a null text has no words; an empty table gives no rows.
    """
    names = docs.columns
    plain = lambda doc_id, source, key: [F.coalesce(doc_id, F.lit(0)).cast("long").alias("k1"), doc_id.isNull().alias("k2"), F.coalesce(source, F.lit("")).alias("k3"), source.isNull().alias("k4"), key.alias("k5")]
    key = ["k1", "k2", "k3", "k4", "k5"]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *plain(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64(F.col("text").cast("string"))))
    keyed = keyed.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("row"))))
    copies = mix(docs, seed, **options).filter("copies > 0").select(*plain(F.col("doc_id"), F.col("source"), F.col("row_key")), "copies")
    copies = copies.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("copies"))))
    taken = keyed.join(copies, [*key, "n"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select("row.*")


def mix_sql(table: str = "documents", seed: int = 0) -> str:
    """DuckDB SQL for op5's rows."""
    weights = "[" + ", ".join(f"{w}.0::DOUBLE" for w in WEIGHTS) + "]"
    return f"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM {table}),
placed AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source)),
weighed AS (
  SELECT *, {weights}[(place % {len(WEIGHTS)} + 1)::INT] AS weight, source_size * {MOST_COPIES} AS most FROM placed),
filled AS (SELECT *, most / weight AS fill FROM weighed),
leveled AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * {SHARE_PERCENT} / 100 - coalesce(sum(most) OVER below, 0)::DOUBLE)
    / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER below, 0)) AS own_level
  FROM filled WINDOW below AS (ORDER BY fill, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, place, source_size, coalesce(least(most::DOUBLE, weight * level), most::DOUBLE) AS target
  FROM (SELECT *, max(CASE WHEN fill >= own_level THEN own_level END) OVER () AS level FROM leveled)),
numbered AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, row_number() OVER (PARTITION BY t.place ORDER BY s.size, s.doc_id ASC NULLS LAST) - 1 AS rank,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END::DECIMAL(20,18) AS expected,
    (((t.place + 1) * 40503 + {seed} * 30011) % 65536)::DECIMAL(10,0) / 65536 AS moved
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  ((floor((rank + 1)::DECIMAL(14,0) * expected::DECIMAL(20,18) + moved::DECIMAL(20,18)) - floor(rank::DECIMAL(14,0) * expected::DECIMAL(20,18) + moved::DECIMAL(20,18))) * size)::BIGINT AS taken
FROM numbered"""
