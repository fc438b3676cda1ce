"""Documents whose sets of word 5-grams overlap, by vertical partitioning of a global order of n-grams.

Every set is sorted in one order of all n-grams: those that few documents have come first. Two sets with Jaccard
similarity t or more have an n-gram in common among the first n - ceil(t * n) + 1 of each, so these alone are dealt by
n-gram to find candidates (prefix filter, Chaudhuri et al. 2006), with the bounds that sizes and places give. The order
is cut in fragments of like weight (Rong et al. 2017): a candidate pair's partial overlaps are counted in each fragment
apart, on the pieces of the two sets in it, and summed by pair.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._links import DEALT, SALT_SHIFT, bit_filter, dealt_join, distinct_pairs, first_candidates, has_bit, hot_keys, linked_components, shape
from ._scratch import Scratch
from ._text import lean, longs, mix, slices

GRAM = 5
PERCENT = 80
FRAGMENTS = 4
#: Bins of a set's shape, the fragments' sizes in a finer cut, which bound an overlap before it is counted.
BINS = 256
#: Counters that say how many documents have an n-gram (a sum over those that share a counter): 4 MB of classes to
#: broadcast, whatever the corpus. More counters tell frequent n-grams apart in larger corpora; results don't depend on it.
SKETCH_BITS = 22
SKETCH_BLOCK = 1 << 16
#: Filters of doc ids before a shuffle; a full one lets everything through, and the join after it is exact.
DOC_FILTER_BITS = 24
#: n-grams of a class (power of two of the counter) above this, and three above the mean, are dealt to parts.
HOT_CLASS = 13
FIELD = 28
U = np.uint64


def gram_sets(batch: pa.RecordBatch):
    """(row, sorted distinct n-gram hashes) of every row; no words, no n-grams."""
    for first, _, t in slices(batch, lower=True):
        grams, ptr = t.grams(GRAM)
        for i in range(len(ptr) - 1):
            yield first + i, np.unique(grams[ptr[i] : ptr[i + 1]])


def set_id(grams: np.ndarray) -> int:
    """64 bits of a set, whatever its order: equal sets have equal ids."""
    h = mix(grams ^ U(0x2545F4914F6CDD1D))
    both = np.array([h.sum(dtype=U) + U(len(grams)), np.bitwise_xor.reduce(h)], U)
    return int(mix(both[:1] ^ mix(both[1:]))[0].astype(np.int64))


def _stats(batches):
    """A row for each document (block -1), and the task's counters by block of the sketch."""
    schema = pa.schema([("block", pa.int32()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("n", pa.int64()), ("id", pa.int64()), ("counts", pa.binary())])
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    for batch in batches:
        ids, valid = longs(batch, "doc_id")
        n, cid = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for row, grams in gram_sets(batch):
            n[row] = len(grams)
            if len(grams):
                cid[row] = set_id(grams)
                sketch[grams & U((1 << SKETCH_BITS) - 1)] += 1  # distinct, but for those that share a counter
        yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, -1, np.int32)), pa.array(ids, mask=~valid), batch.column("row_key"), pa.array(n), pa.array(cid, mask=n == 0), pa.nulls(batch.num_rows, pa.binary())], schema=schema)
    some = [b for b in range(len(sketch) // SKETCH_BLOCK) if sketch[b * SKETCH_BLOCK : (b + 1) * SKETCH_BLOCK].any()]
    blobs = [np.minimum(sketch[b * SKETCH_BLOCK : (b + 1) * SKETCH_BLOCK], 65_535).astype(np.uint16).tobytes() for b in some]
    for b, blob in zip(some, blobs, strict=True):
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *[pa.nulls(1, pa.int64())] * 4, pa.array([pa.compress(blob, "zstd", asbytes=True)], pa.binary())], schema=schema)


STATS_SCHEMA = "block int, doc_id long, row_key long, n long, id long, counts binary"


def _add_counts(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, blob in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
            part = np.frombuffer(pa.decompress(blob.as_buffer(), 2 * SKETCH_BLOCK, "zstd"), np.uint16)
            sums[block] = sums.get(block, 0) + part.astype(np.uint64)
    if sums:
        classes = [np.ceil(np.log2(v.astype(np.float64) + 1)).astype(np.uint8).tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(classes, pa.binary())], names=["block", "classes"])


def frequency_classes(stats: DataFrame) -> np.ndarray:
    """The power of two above each counter: SKETCH_BITS and no more decide how much comes to the driver."""
    rows = stats.filter("block >= 0").select("block", "counts").repartition("block").mapInArrow(_add_counts, "block int, classes binary").collect()
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for block, classes in rows:
        out[block * SKETCH_BLOCK : (block + 1) * SKETCH_BLOCK] = np.frombuffer(classes, np.uint8)
    return out


def in_order(grams: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Grams in the global order: by frequency class, then by hash."""
    c = classes[grams & U((1 << SKETCH_BITS) - 1)]
    return grams[np.argsort(c, kind="stable")]


def fragment_cuts(classes: np.ndarray, fragments: int = FRAGMENTS) -> np.ndarray:
    """Where the global order is cut, as order_key: fragments of like numbers of n-grams, as the counters tell."""
    weight = np.bincount(np.minimum(classes, 31), minlength=32) * np.exp2(np.arange(32))
    weight[0] = 0
    ends = np.cumsum(weight)
    want = ends[-1] * np.arange(1, fragments) / fragments
    at = np.minimum(np.searchsorted(ends, want), 31)
    part = (want - ends[at] + weight[at]) / np.maximum(weight[at], 1)
    return (at.astype(U) << U(59)) | np.clip(part * 2.0**59, 0, 2.0**59 - 1024).astype(U)


def order_key(grams: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A number that ascends in the global order: the frequency class and the hash's upper bits."""
    return (np.minimum(classes[grams & U((1 << SKETCH_BITS) - 1)], 31).astype(U) << U(59)) | (grams >> U(5))


def prefix_size(n, percent: int = PERCENT):
    return n - (percent * n + 99) // 100 + 1


def feasible(ma: np.ndarray, mb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sets of these sizes that first meet at these places can overlap enough."""
    low = (1 << FIELD) - 1
    na, nb = ma & low, mb & low
    ia, ib = (ma >> FIELD) & low, (mb >> FIELD) & low
    return (100 + percent) * np.minimum(na - ia, nb - ib) >= percent * (na + nb)


def _prefixes(classes):
    def prefixes(batches):
        order = classes.value
        usual = max(HOT_CLASS, int(np.ceil(order.mean())) + 3)
        for batch in batches:
            keys, ids, metas = [], [], []
            seen = set()

            def flush(keys, ids, metas):
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (keys, ids, metas)], names=["key", "id", "meta"])

            for _, grams in gram_sets(batch):
                n = len(grams)
                if not n:
                    continue
                cid = set_id(grams)
                if cid in seen:
                    continue
                seen.add(cid)
                some = in_order(grams, order)[: prefix_size(n)]
                meta = n | (np.arange(len(some), dtype=np.int64) << FIELD)
                hot = order[some & U((1 << SKETCH_BITS) - 1)].astype(np.int64) - usual
                keys.append(some.astype(np.int64))
                ids.append(np.full(len(some), cid, np.int64))
                parts = np.int64(1) << np.clip(hot, 0, 6)
                share = (cid + (1 << 63)) >> 57  # the id's first seven bits
                metas.append(meta | (np.where(parts > 1, DEALT + (share * parts >> 7), 0) << SALT_SHIFT))
                for i in np.flatnonzero((parts > 1) & (share * parts < 128)):  # the least ids are in every part
                    more = np.arange(1, parts[i], dtype=np.int64)
                    keys.append(np.full(len(more), some[i]).astype(np.int64))
                    ids.append(np.full(len(more), cid, np.int64))
                    metas.append(meta[i] | (DEALT + more << SALT_SHIFT))
                if len(keys) > 4_000:
                    yield flush(keys, ids, metas)
                    keys, ids, metas = [], [], []
            yield flush(keys, ids, metas)

    return prefixes


def in_filter(filled, probe):
    """Keeps the rows of mapInArrow input whose probe column (a hash) hits; drops that column."""

    def keep(batches):
        for batch in batches:
            hit = has_bit(filled.value, batch.column(probe).to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(hit)).drop_columns([probe])

    return keep


def new_sets(batch, seen: set):
    """(doc_id or None, set id, grams) of the batch's sets that no earlier row of the task with this doc_id had."""
    ids, valid = longs(batch, "doc_id")
    for row, grams in gram_sets(batch):
        if len(grams):
            found = ids[row].item() if valid[row] else None, set_id(grams)
            if found not in seen:
                seen.add(found)
                yield *found, grams


def _id_shapes(filled):
    def id_shapes(batches):
        seen: set = set()
        for batch in in_filter(filled, "probe")(batches):
            out = [(doc, cid, len(grams), shape(grams, BINS)) for doc, cid, grams in new_sets(batch, seen)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "id", "n", "shape"])

    return id_shapes


def _set_rows(classes, cuts):
    def of(filled):
        def set_rows(batches):
            types = pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()
            names = ["doc_id", "id", "frag", "n", "grams"]
            make = lambda out: pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=names)
            seen: set = set()
            for batch in in_filter(filled, "probe")(batches):
                out, held = [], 0
                for doc, cid, grams in new_sets(batch, seen):
                    frag = np.searchsorted(cuts, order_key(grams, classes.value), "right")
                    out += [(doc, cid, f, len(grams), grams[frag == f].tobytes()) for f in range(len(cuts) + 1)]
                    held += len(grams)
                    if held >= 1 << 20:
                        yield make(out)
                        out, held = [], 0
                yield make(out)

        return set_rows

    return of


def members(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per document: doc_id, row_key (a hash of its text), n_shingles and comp, a name of its component, null
    without n-grams. Documents with equal sets are one node."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    stats = scratch.save(rows.withColumn("row_key", F.xxhash64("text")).mapInArrow(lean(_stats), STATS_SCHEMA), "stats")
    own = stats.filter("block = -1").select("doc_id", "row_key", F.col("n").alias("n_shingles"), "id")
    found = frequency_classes(stats)
    classes = spark.sparkContext.broadcast(found)
    prefixes = rows.select("doc_id", "text").mapInArrow(lean(_prefixes(classes)), "key long, id long, meta long")
    pairs, large, _ = first_candidates(prefixes, feasible, scratch)
    pairs = scratch.save(distinct_pairs(pairs), "pairs")
    first = own.filter("n_shingles > 0").groupBy("id").agg(F.min("doc_id").alias("doc_id"))  # null if all its rows' are
    probe = F.xxhash64("doc_id")

    def again(ids: DataFrame, name: str, read, schema: str, key: list[str]) -> DataFrame:
        """What read makes of the texts of the sets with these ids, one text for each set."""
        wanted = scratch.save(ids.join(first, "id").select("id", "doc_id"), name)
        filled = spark.sparkContext.broadcast(bit_filter(wanted.select(probe.alias("h")), DOC_FILTER_BITS))
        found = rows.select("doc_id", "text", probe.alias("probe")).mapInArrow(lean(read(filled)), schema)
        named = wanted.select(F.col("id").alias("wanted_id"), F.col("doc_id").alias("wanted_doc"))
        same = (F.col("id") == F.col("wanted_id")) & F.col("doc_id").eqNullSafe(F.col("wanted_doc"))
        return found.join(named, same, "left_semi").dropDuplicates(key).drop("doc_id")

    met = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(large.select("id")).distinct()
    shapes = scratch.save(again(met, "met", _id_shapes, "doc_id long, id long, n long, shape binary", ["id"]), "shapes")
    read_sets = _set_rows(classes, fragment_cuts(found))
    fetch = lambda ids: again(ids, "wanted", read_sets, "doc_id long, id long, frag int, n long, grams binary", ["id", "frag"])
    comps = linked_components(pairs, large, shapes, fetch, feasible, PERCENT, BINS, scratch)
    linked = own.filter("n_shingles > 0").join(comps, "id", "left").select("doc_id", "row_key", "n_shingles", F.coalesce("comp", "id").alias("comp"))
    out = scratch.save(linked.unionByName(own.filter("n_shingles = 0").select("doc_id", "row_key", "n_shingles", F.lit(None).cast("long").alias("comp"))), "members")
    scratch.drop("stats", "buckets", "pairs", "met", "wanted", "shapes")
    return out


def similar_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the least doc_id that links of 80 % or more reach.

    A null text, or one without words, has no n-grams and no links: its component is itself. Documents with equal sets
    are one node, joined to the others once. A row with a null doc_id takes part; its component_id is the least doc_id
    that isn't null, or null. Rows that repeat a doc_id are separate texts that name the same document: each row has its
    own set's component. An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "ngrams")
    found = members(docs, scratch)
    nodes = found.filter("comp IS NOT NULL")
    least = scratch.save(nodes.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("rows")), "least")
    linked = dealt_join(nodes, least.drop("rows"), ["comp"], "doc_id", hot_keys(least, ["comp"])).select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(found.filter("comp IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of linked documents, with the columns of docs.

    The row with the least doc_id that isn't null stays, then the one with the least hash of its text; of rows that
    repeat both, the one with the least hash of all columns, once. Documents without words are no group and all stay. An
    empty table gives no rows; names of other columns don't matter.
    """
    names = docs.columns
    scratch = Scratch(docs.sparkSession, "ngrams")
    nodes = members(docs, scratch).filter("comp IS NOT NULL")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    best = scratch.save(nodes.groupBy("comp").agg(F.min(place).alias("best"), F.count(F.lit(1)).alias("rows")), "best")
    judged = dealt_join(nodes, best.drop("rows"), ["comp"], "row_key", hot_keys(best, ["comp"]))
    rows = judged.groupBy("doc_id", "row_key").agg(F.max(place == F.col("best")).alias("stays"), F.count(F.lit(1)).alias("rows"))
    gone = scratch.save(rows.filter("NOT stays OR rows > 1").select(F.col("doc_id").alias("__gone_id"), F.col("row_key").alias("__gone_key"), "stays"), "gone")
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    keyed = docs.select(row.alias("__row"), F.col("doc_id").cast("long").alias("__id"), F.xxhash64(F.col("text").cast("string")).alias("__key"))
    same = F.col("__id").eqNullSafe(F.col("__gone_id")) & (F.col("__key") == F.col("__gone_key"))
    kept = keyed.join(gone, same, "left_anti").select("__row")
    repeated = gone.filter("stays")
    if not repeated.isEmpty():
        some = keyed.join(repeated, same, "left_semi").groupBy("__id", "__key").agg(F.min_by("__row", F.xxhash64("__row")).alias("__row"))
        kept = kept.unionByName(some.select("__row"))
    return kept.select("__row.*")


def join_sql(table: str = "documents") -> str:
    """DuckDB SQL for op10's rows."""
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {table}),
grams AS (
  SELECT DISTINCT doc_id, gram FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {GRAM} THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - {GRAM - 2}), lambda i: array_to_string(w[i:i + {GRAM - 1}], ' ')) END) AS gram FROM words)),
sizes AS (SELECT w.doc_id, count(gram) AS n FROM words w LEFT JOIN grams g ON w.doc_id = g.doc_id GROUP BY w.doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM grams x JOIN grams y USING (gram) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * o >= {PERCENT} * (s.n + t.n - o)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT sizes.doc_id, n::BIGINT AS n_shingles, min(b) AS component_id FROM sizes JOIN reach ON sizes.doc_id = reach.a GROUP BY sizes.doc_id, n"""
