"""From buckets of candidates to verified links and their components, without all pairs of a group.

Rows (key, id, meta) say that id is in bucket key. Two ids that share a bucket may be linked; a link is verified on their
sets. Components need no more links than join them, so

1. every id of a small bucket meets every other, and every id of a large one meets the bucket's first few;
2. verified links are contracted to components;
3. in large buckets that still hold several components, ids meet further few, of other components only;
4. in the buckets that still do, every pair of ids of different components and like sizes meets.

A set's shape, the numbers of its grams by bin of their hashes, bounds the overlap of two sets from above
by the sum of lesser numbers; pairs that can't reach the limit go no further, and sets themselves aren't sent to be
compared with whole buckets.

No link between different components is lost, and pairs inside a component that the others already connect are never
made. The bits of meta above SALT_SHIFT are 0, or DEALT and the part of its bucket that a row was dealt to; a hot bucket's
first ids are in every part.
"""

import math
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch

#: Buckets of so many ids or fewer are compared whole at once; larger ones by their first FIRST ids, then NEXT others.
SMALL, FIRST, NEXT = 12, 4, 24
#: Rows of one side of a block in the last comparison.
BLOCK_ROWS = 600
SALT_SHIFT, SALT_BITS, DEALT = 56, 7, 64
#: A key is hot that has more than HOT_ROWS rows and 1 / HOT_SHARE of all: fewer than HOT_SHARE keys, whatever the input.
#: Joins deal its rows to PARTS tasks.
HOT_ROWS, HOT_SHARE, PARTS = 1_000, 4_096, 64
#: Bits of a filter that are sent in one row.
FILTER_BLOCK = 1 << 16
#: Sets of more grams are compared pair by pair.
LARGE_SET = 1_024
#: Packed rows in a row of a table, rows that are sorted at once, and that are looked at together.
PACK_ROWS, HELD_ROWS, SENT_ROWS = 340, 2_000_000, 1 << 15
PAIR_SCHEMA = "a long, b long, ma long, mb long"
U = np.uint64


def meta_salt(column: str = "meta"):
    return F.shiftright(F.col(column), SALT_SHIFT).bitwiseAND(F.lit((1 << SALT_BITS) - 1))


def hot_keys(counts: DataFrame, key: list[str], rows: str = "rows") -> DataFrame:
    """The hot keys of a table with a row for each key, to broadcast."""
    total = counts.agg(F.sum(rows)).first()[0] or 0
    return F.broadcast(counts.filter((F.col(rows) > HOT_ROWS) & (F.col(rows) * HOT_SHARE > total)).select(*key, F.lit(True).alias("__hot")))


def dealt_join(many: DataFrame, one: DataFrame, key: list[str], by: str, hot: DataFrame) -> DataFrame:
    """many joined with one, which has a row for each key: rows of hot keys go to parts by hash of a column, and one's row
    to each part."""
    part = F.when(F.col("__hot"), F.pmod(F.xxhash64(by), F.lit(PARTS).cast("long"))).otherwise(F.lit(0).cast("long"))
    parts = F.when(F.col("__hot"), F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    left = many.join(hot, key, "left").withColumn("__part", part).drop("__hot")
    right = one.join(hot, key, "left").withColumn("__part", F.explode(parts)).drop("__hot")
    return left.join(right, [*key, "__part"]).drop("__part")


def _bits(bits):
    def blocks(batches):
        filled = np.zeros(1 << bits, bool)
        for batch in batches:
            filled[batch.column(0).to_numpy(zero_copy_only=False) & ((1 << bits) - 1)] = True
        packed = np.packbits(filled, bitorder="little").reshape(-1, FILTER_BLOCK // 8)
        some = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([pa.compress(packed[b].tobytes(), "zstd", asbytes=True) for b in some], pa.binary())], names=["block", "bits"])

    return blocks


def _any_bits(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, blob in zip(batch.column("block").to_pylist(), batch.column("bits"), strict=True):
            part = np.frombuffer(pa.decompress(blob.as_buffer(), FILTER_BLOCK // 8, "zstd"), np.uint8)
            sums[block] = sums[block] | part if block in sums else part
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([pa.compress(v.tobytes(), "zstd", asbytes=True) for v in sums.values()], pa.binary())], names=["block", "bits"])


def bit_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """Which values of the one column occur, by their low bits, in 2**bits bits: a filter of fixed size, built in tasks."""
    schema = "block long, bits binary"
    rows = hashes.mapInArrow(_bits(bits), schema).repartition("block").mapInArrow(_any_bits, schema).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for block, blob in rows:
        out[block * FILTER_BLOCK // 8 : (block + 1) * FILTER_BLOCK // 8] = np.frombuffer(pa.decompress(blob, FILTER_BLOCK // 8, "zstd"), np.uint8)
    return out.view(np.uint32)


def has_bit(filled: np.ndarray, values: np.ndarray) -> np.ndarray:
    low = values & (len(filled) * 32 - 1)
    return (filled[low >> 5] >> (low & 31).astype(np.uint32)) & 1 == 1


def cut(rows: dict, start: int, end: int | None = None) -> dict:
    return {k: v[start:end] for k, v in rows.items()}


def joined(first: dict, then: dict) -> dict:
    return {k: np.concatenate([v, then[k]]) for k, v in first.items()}


class Buckets:
    """Streams sorted rows by bucket. feasible(meta, meta) -> mask says which pairs can be links at all.

    Whole buckets are compared together. A bucket of more than HOLD rows isn't held: its first ids are kept, and the
    others stream past them.
    """

    HOLD = 8_000

    def __init__(self, feasible):
        self.feasible = feasible

    def __call__(self, batches):
        names = ["key", "id", "meta"]
        rest = {k: np.zeros(0, np.int64) for k in names}
        lead = None
        for batch in batches:
            rows = joined(rest, {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names})
            if lead is not None:
                other = np.flatnonzero((rows["key"] != lead["key"][0]) | (self.salt(rows) != self.salt(lead)[0]))
                end = int(other[0]) if len(other) else len(rows["key"])
                if end:
                    lead, out = self.stream(cut(rows, 0, end), lead)
                    yield out
                rows = cut(rows, end)
                if len(rows["key"]):
                    lead = None
            starts = self.starts(rows)
            if len(starts) > 1:
                yield self.complete(cut(rows, 0, starts[-1]))
                rows = cut(rows, starts[-1])
            if len(rows["key"]) > self.HOLD:
                lead, out = self.stream(rows, None)
                yield out
                rows = cut(rows, 0, 0)
            rest = rows
        if len(rest["key"]):
            yield self.complete(rest)

    @staticmethod
    def salt(rows) -> np.ndarray:
        return rows["meta"] >> SALT_SHIFT

    def starts(self, rows) -> np.ndarray:
        k, s = rows["key"], self.salt(rows)
        return np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])])) if len(k) else np.zeros(0, np.int64)

    def batch(self, kinds, keys, a, b, ma, mb):
        return pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int8)), pa.array(keys), pa.array(a), pa.array(b), pa.array(ma), pa.array(mb)], names=["kind", "key", "a", "b", "ma", "mb"])

    def distinct(self, rows):
        """Rows of one id in one bucket once, with its first meta; and pairs of equal ids with different metas."""
        k, i, m = rows["key"], rows["id"], rows["meta"]
        same = (k[1:] == k[:-1]) & (i[1:] == i[:-1])
        again = np.flatnonzero(same & (m[1:] != m[:-1])) + 1
        keep = np.concatenate([[True], ~(same & (self.salt(rows)[1:] == self.salt(rows)[:-1]))])
        return {n: v[keep] for n, v in rows.items()}, again

    def complete(self, rows):
        everything = rows
        rows, again = self.distinct(rows)
        i, m = rows["id"], rows["meta"]
        starts = self.starts(rows)
        sizes = np.diff(np.append(starts, len(i)))
        size, start = np.repeat(sizes, sizes), np.repeat(starts, sizes)
        at = np.arange(len(i))
        left, right = [], []
        for step in range(1, SMALL):
            x = at[:-step][(size[:-step] <= SMALL) & (start[:-step] == start[step:])] if step < len(at) else at[:0]
            left.append(x)
            right.append(x + step)
        for step in range(FIRST):
            x = at[(size > SMALL) & (at - start > step)]
            left.append(start[x] + step)
            right.append(x)
        left, right = np.concatenate(left), np.concatenate(right)
        good = (i[left] != i[right]) & self.feasible(m[left], m[right])
        left, right = left[good], right[good]
        large = np.flatnonzero((size > SMALL) | (self.salt(rows) > 0))  # a dealt bucket's parts haven't met each other
        return self.rows(rows, left, right, large, everything, again)

    def rows(self, rows, left, right, large, everything, again):
        k, i, m = rows["key"], rows["id"], rows["meta"]
        swap = i[left] > i[right]
        a, b = np.where(swap, right, left), np.where(swap, left, right)
        kinds = np.concatenate([np.zeros(len(a)), np.ones(len(large)), np.full(len(again), 2)])
        cat = lambda x, y, z: np.concatenate([x, y, z])
        ek, ei, em = everything["key"], everything["id"], everything["meta"]
        return self.batch(kinds, cat(k[a], k[large], ek[again]), cat(i[a], i[large], ei[again]), cat(i[b], i[large], ei[again]), cat(m[a], m[large], em[again - 1]), cat(m[b], m[large], em[again]))

    def stream(self, rows, lead):
        """lead: the bucket's first ids, and last the row before these; ids that are met again stay in one piece."""
        if lead is None:
            everything = rows
            rows, again = self.distinct(rows)
            first, met = cut(rows, 0, FIRST), rows
            n = 0
        else:
            everything = joined(lead["last"], rows)
            rows, again = self.distinct(everything)
            rows = cut(rows, 1)
            first = {k: lead[k] for k in rows}
            met = joined(first, rows)
            n = len(first["key"])
        few, many = len(first["key"]), len(met["key"])
        left, right = np.repeat(np.arange(few), many), np.tile(np.arange(many), few)
        ok = (right > left) & (right >= n)
        left, right = left[ok], right[ok]
        good = (met["id"][left] != met["id"][right]) & self.feasible(met["meta"][left], met["meta"][right])
        out = self.rows(met, left[good], right[good], np.arange(n, many), everything, again)
        return first | {"last": cut(everything, -1)}, out


def shape(grams: np.ndarray, bins: int) -> bytes:
    """How many grams are in each of bins ranges of hashes, in one byte each if they fit, else in four."""
    n = np.bincount((grams >> U(64 - bins.bit_length() + 1)).astype(np.int64), minlength=bins)
    return n.astype(np.uint8 if n.max(initial=0) < 256 else np.uint32).tobytes()


def set_shapes(own: np.ndarray, grams: np.ndarray, n: int, bins: int) -> pa.Array:
    """shape() of n sets, of which gram i is in set own[i], ascending."""
    found = np.bincount(own * bins + (grams >> U(64 - bins.bit_length() + 1)).astype(np.int64), minlength=n * bins).reshape(n, bins)
    small = found.max(axis=1, initial=0) < 256
    if small.all():
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * bins, bins, dtype=np.int32)), pa.py_buffer(found.astype(np.uint8).tobytes())])
    return pa.array([row.astype(np.uint8 if less else np.uint32).tobytes() for row, less in zip(found, small, strict=True)], pa.binary())


def flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all values of a binary column without nulls, and where each value's begin."""
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    numbers = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind) if data is not None and offsets[-1] > offsets[0] else np.zeros(0, kind)
    return numbers, (offsets - offsets[0]) // np.dtype(kind).itemsize


def shapes_of(column, bins: int) -> np.ndarray:
    data, ptr = flat(column, np.uint8)
    if len(data) == len(column) * bins and (np.diff(ptr) == bins).all():
        return data.reshape(-1, bins).astype(np.int32)
    rows = [np.frombuffer(x.as_buffer(), np.uint8 if len(x.as_buffer()) == bins else np.uint32) for x in column]
    return np.stack(rows).astype(np.int32) if rows else np.zeros((0, bins), np.int32)


def reaches(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these shapes, row by row, can have 100 * intersection >= percent * union."""
    return (100 + percent) * np.minimum(a, b).sum(axis=-1) >= percent * (a.sum(axis=-1) + b.sum(axis=-1))


BUCKET_SCHEMA = "kind tinyint, key long, a long, b long, ma long, mb long"


def first_candidates(rows: DataFrame, feasible, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (a, b, ma, mb) of step 1, rows (key, id, meta) of large buckets, and (id, ma, mb) of ids met again with
    another meta. Buckets are sorted by Spark, which spills, and streamed."""
    dealt = rows.select("key", "id", "meta").repartition(F.col("key"), meta_salt()).sortWithinPartitions(F.col("key"), meta_salt(), F.col("id"), F.col("meta"))
    return _kinds(scratch.save(dealt.mapInArrow(Buckets(feasible), BUCKET_SCHEMA), "buckets"))


def _kinds(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    pairs = found.filter("kind = 0").select("a", "b", "ma", "mb")
    return pairs, found.filter("kind = 1").select("key", F.col("a").alias("id"), F.col("ma").alias("meta")), found.filter("kind = 2").select(F.col("a").alias("id"), "ma", "mb")


def parts_of(spark) -> int:
    """How many parts of the keys' range rows are packed by: several for each task, a power of two."""
    return 1 << min(14, max(6, (16 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))


def packed(key: np.ndarray, id: np.ndarray, meta: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows (key, id, meta) as (part, rows): the part of the keys' range, and PACK_ROWS rows at most, sorted by key."""
    order = np.argsort(key.view(U))
    rows = np.stack([key, id, meta], axis=1)[order]
    part = (rows[:, 0].view(U) >> U(65 - parts.bit_length())).astype(np.int64)
    bounds = np.searchsorted(part, np.arange(parts + 1))
    n = -(-np.diff(bounds) // PACK_ROWS)
    starts = np.repeat(bounds[:-1], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * PACK_ROWS
    offsets = np.append(starts, len(rows)).astype(np.int32) * np.int32(24)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(parts), n).astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])], names=["part", "rows"])


def in_order(rows: np.ndarray) -> np.ndarray:
    """Rows (key, id, meta) sorted by all three."""
    rows = rows[np.argsort(rows[:, 0])]
    some = np.flatnonzero(repeated(rows))
    tied = rows[some]
    rows[some] = tied[np.lexsort((tied[:, 2], tied[:, 1], tied[:, 0]))]
    return rows


def repeated(rows: np.ndarray) -> np.ndarray:
    """Which of rows in order of key have a key of several rows."""
    same = np.concatenate([[False], rows[1:, 0] == rows[:-1, 0], [False]])
    return same[1:] | same[:-1]


class Part:
    """The rows of one part: held, and from HELD_ROWS on written to a file and read again a range of (key, id) at a time."""

    def __init__(self):
        self.held, self.count, self.file = [], 0, None

    def add(self, rows: np.ndarray) -> None:
        self.held.append(rows)
        self.count += len(rows)
        if self.count > HELD_ROWS:
            self.file = self.file or tempfile.TemporaryFile()
            self.write()

    def write(self) -> None:
        for rows in self.held:
            self.file.write(rows.tobytes())
        self.held, self.count = [], 0

    def ordered(self):
        """All rows in order, in blocks; those alone in their bucket go where the whole part is held."""
        if self.file is None:
            rows = in_order(np.concatenate(self.held))
            yield rows[repeated(rows)]
            return
        self.write()
        n = self.file.tell() // 24
        blocks = [(at, min(HELD_ROWS, n - at)) for at in range(0, n, HELD_ROWS)]
        every = max(1, n // HELD_ROWS)
        sample = in_order(np.concatenate([self.block(*b)[::every] for b in blocks]))
        cuts = [tuple(sample[i, :2].tolist()) for i in range(0, len(sample), max(1, HELD_ROWS // (2 * every)))][1:]
        for low, high in zip([None, *cuts], [*cuts, None], strict=True):
            found = []
            for b in blocks:
                rows = self.block(*b)
                inside = np.ones(len(rows), bool)
                if low:
                    inside &= (rows[:, 0] > low[0]) | ((rows[:, 0] == low[0]) & (rows[:, 1] >= low[1]))
                if high:
                    inside &= (rows[:, 0] < high[0]) | ((rows[:, 0] == high[0]) & (rows[:, 1] < high[1]))
                found.append(rows[inside])
            yield in_order(np.concatenate(found))
        self.file.close()

    def block(self, at: int, n: int) -> np.ndarray:
        self.file.seek(at * 24)
        return np.frombuffer(self.file.read(n * 24), np.int64).reshape(-1, 3)


def _unpacked(batches):
    """Batches of rows (key, id, meta) in order, from packed ones in order of part."""

    def sent(part):
        for rows in part.ordered():
            for at in range(0, len(rows), SENT_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows[at : at + SENT_ROWS].T], names=["key", "id", "meta"])

    part, last = None, None
    for batch in batches:
        parts = batch.column("part").to_numpy(zero_copy_only=False)
        numbers, ptr = flat(batch.column("rows"), np.int64)
        starts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])) if len(parts) else np.zeros(0, np.int64)
        for s, e in zip(starts, np.append(starts[1:], len(parts)), strict=True):
            if part is not None and parts[s] != last:
                yield from sent(part)
                part = None
            part, last = part or Part(), parts[s]
            part.add(numbers[ptr[s] : ptr[e]].reshape(-1, 3).copy())
    if part is not None:
        yield from sent(part)


def packed_candidates(rows: DataFrame, feasible, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """first_candidates() of packed rows without dealt keys, and (id, meta) of all ids in pairs and large buckets: rows cross to
    the workers that sort them a block at a time, and not one by one. A part that is too large to be held is sorted by way of a
    local file."""
    dealt = rows.select("part", "rows").repartition("part").sortWithinPartitions("part")
    found = scratch.save(dealt.mapInArrow(lambda batches: Buckets(feasible)(_unpacked(batches)), BUCKET_SCHEMA), "buckets")
    ends = [F.struct(F.col(x).alias("id"), F.col(m).alias("meta")) for x, m in (("a", "ma"), ("b", "mb"))]
    return *_kinds(found), found.filter("kind < 2").select(F.explode(F.when(F.col("kind") == 0, F.array(*ends)).otherwise(F.array(ends[0]))).alias("e")).select("e.*")


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.first("ma").alias("ma"), F.first("mb").alias("mb"))


def overlaps(x: pa.Array, y: pa.Array) -> np.ndarray:
    """How many grams sets x and y share, row by row; each set is sorted. Grams of x are searched for in y together."""
    (x, px), (y, py) = flat(x, U), flat(y, U)
    own = np.repeat(np.arange(len(px) - 1), np.diff(px))
    low, high = py[own], py[own + 1]
    end = high
    for _ in range(int(np.diff(py).max(initial=0)).bit_length()):
        middle = (low + high) >> 1
        less = (low < high) & (y[np.minimum(middle, len(y) - 1)] < x)
        low, high = np.where(less, middle + 1, low), np.where(less, high, np.maximum(middle, low))
    found = (low < end) & (y[np.minimum(low, len(y) - 1)] == x) if len(y) else np.zeros(len(x), bool)
    return np.bincount(own[found], minlength=len(px) - 1)


def _overlaps(batches):
    for batch in batches:
        out = np.zeros(batch.num_rows, np.int64)
        x, y = batch.column("ga"), batch.column("gb")
        many = np.maximum(np.diff(flat(x, U)[1]), np.diff(flat(y, U)[1])) > LARGE_SET
        some = np.flatnonzero(~many)
        for at in range(0, len(some), BLOCK_ROWS):
            own = some[at : at + BLOCK_ROWS]
            out[own] = overlaps(x.take(pa.array(own)), y.take(pa.array(own)))
        for i in np.flatnonzero(many):
            a, b = sorted((np.frombuffer(c[int(i)].as_buffer(), U) for c in (x, y)), key=len)
            if len(a):
                out[i] = np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("na"), batch.column("nb"), pa.array(out)], names=["a", "b", "na", "nb", "overlap"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union.

    sets has (id, frag, n, grams): the part of a set that is in one fragment of the order of grams, sorted by hash. The
    partial overlaps of a pair are counted in each fragment, and summed.
    """
    a = sets.select(F.col("id").alias("a"), "frag", F.col("n").alias("na"), F.col("grams").alias("ga"))
    b = sets.select(F.col("id").alias("b"), "frag", F.col("n").alias("nb"), F.col("grams").alias("gb"))
    parts = pairs.select("a", "b").join(a, "a").join(b, ["b", "frag"]).select("a", "b", "na", "nb", "ga", "gb")
    counted = parts.mapInArrow(_overlaps, "a long, b long, na long, nb long, overlap long")
    total = counted.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("overlap").alias("o"))
    return total.filter(F.col("o") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def _forest(batches):
    """Links of a partition as (node, least node of its component there): no more rows than nodes."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = [(x, r) for x in list(root) if (r := find(x)) != x]
    for i in range(0, len(nodes), 100_000):
        some = np.array(nodes[i : i + 100_000], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(some[:, 0]), pa.array(some[:, 1])], names=["a", "b"])


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, comp): the least id that each linked id reaches; by alternating large and small stars (Kiveris et al. 2014).

    Each round's edges are a written table; rounds grow as the logarithm of the longest path. Every partition first
    contracts its own links, so that what is shuffled is bounded by nodes.
    """
    edges = scratch.save(links.select("a", "b").mapInArrow(_forest, "a long, b long"), f"{name}-0")
    state, step = None, 0
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state or not now[0]:
            break
        state, step = now, step + 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.filter("a > m").select("a", F.col("m").alias("b"))).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        edges = scratch.save(small.filter("a > b").distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
    leaves = edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    return leaves.unionByName(leaves.select(F.col("comp").alias("id"), "comp").distinct())


def spread(large: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (key, id, meta, comp) of the large buckets, and for each bucket its rows and its least and greatest component."""
    rows = large.join(comps, "id", "left").select("key", "id", "meta", F.coalesce("comp", "id").alias("comp"))
    return rows, rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("rows"))


def unresolved(rows: DataFrame, buckets: DataFrame, shapes: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows (key, id, meta, comp, rows, n, shape) of the large buckets that hold several components."""
    return dealt_join(rows, buckets.filter("lo < hi").select("key", "rows"), ["key"], "id", hot).join(shapes, "id")


def _cross(feasible, percent, bins):
    names = ["key", "i", "j", "side", "id", "meta", "comp", "own"]

    def pairs(batch):
        rows = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
        forms = shapes_of(batch.column("shape"), bins)
        starts = np.flatnonzero(np.concatenate([[True], (rows["key"][1:] != rows["key"][:-1]) | (rows["i"][1:] != rows["i"][:-1]) | (rows["j"][1:] != rows["j"][:-1])]))
        out = [np.zeros((2, 0), np.int64)]
        for s, e in zip(starts, np.append(starts[1:], len(rows["key"])), strict=True):
            within = rows["i"][s] == rows["j"][s]
            side = rows["side"][s:e]
            x = s + np.flatnonzero(side == 0)
            y = x if within else s + np.flatnonzero(side == 1)
            for one in x:
                other = y[y > one] if within else y
                other = other[(rows["comp"][other] != rows["comp"][one]) & (rows["own"][other] | rows["own"][one] > 0)]
                other = other[feasible(np.broadcast_to(rows["meta"][one], other.shape), rows["meta"][other])]
                other = other[reaches(forms[one], forms[other], percent)]
                out.append(np.stack([np.full(len(other), one), other]))
        p, q = np.concatenate(out, axis=1)
        swap = rows["id"][p] > rows["id"][q]
        p, q = np.where(swap, q, p), np.where(swap, p, q)
        return pa.RecordBatch.from_arrays([pa.array(rows[k][v]) for k, v in (("id", p), ("id", q), ("meta", p), ("meta", q))], names=["a", "b", "ma", "mb"])

    def cross(batches):
        rest = None
        for batch in batches:
            batch = batch if rest is None else pa.concat_batches([rest, batch])
            k = [batch.column(x).to_numpy(zero_copy_only=False) for x in ("key", "i", "j")]
            other = np.flatnonzero((k[0] != k[0][-1]) | (k[1] != k[1][-1]) | (k[2] != k[2][-1])) if batch.num_rows else np.zeros(0, int)
            end = int(other[-1]) + 1 if len(other) else 0
            if end:
                yield pairs(batch.slice(0, end))
            rest = batch.slice(end)
        if rest is not None and rest.num_rows:
            yield pairs(rest)

    return cross


def next_candidates(rows: DataFrame, feasible, percent: int, bins: int, count: int, hot: DataFrame) -> DataFrame:
    """Pairs of each id of an unresolved bucket with `count` further ids of it that are in other components."""
    order = F.xxhash64("id")
    some = F.pmod(order, F.greatest(F.lit(1), F.floor(F.col("rows") / (2 * count)))) == 0
    few = rows.filter(some).groupBy("key").agg(F.slice(F.sort_array(F.collect_list(F.struct(order.alias("o"), "id", "meta", "comp", "shape"))), 1, count).alias("few"))
    met = dealt_join(rows, few, ["key"], "id", hot).withColumn("p", F.explode(F.filter("few", lambda p: p["comp"] != F.col("comp"))))
    pairs = met.select(F.col("id").alias("a"), F.col("p.id").alias("b"), F.col("meta").alias("ma"), F.col("p.meta").alias("mb"), F.col("shape").alias("sa"), F.col("p.shape").alias("sb"))
    return distinct_pairs(pairs.mapInArrow(_near(feasible, percent, bins), PAIR_SCHEMA))


def _near(feasible, percent, bins):
    def near(batches):
        for batch in batches:
            a, b, ma, mb = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("a", "b", "ma", "mb"))
            ok = feasible(ma, mb) & reaches(shapes_of(batch.column("sa"), bins), shapes_of(batch.column("sb"), bins), percent)
            swap = a > b
            columns = np.where(swap, b, a)[ok], np.where(swap, a, b)[ok], np.where(swap, mb, ma)[ok], np.where(swap, ma, mb)[ok]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "ma", "mb"])

    return near


def close(pairs: DataFrame, shapes: DataFrame, feasible, percent: int, bins: int) -> DataFrame:
    """The pairs whose shapes allow a link."""
    a, b = (shapes.select(F.col("id").alias(x), F.col("shape").alias(f"s{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ma", "mb", "sa", "sb").mapInArrow(_near(feasible, percent, bins), PAIR_SCHEMA)


def last_candidates(rows: DataFrame, feasible, percent: int, bins: int, scratch: Scratch) -> DataFrame:
    """All pairs of ids of different components in unresolved buckets whose sizes allow a link, by blocks of rows.

    Sizes are cut in bands, so wide that linked sets are in one or in neighbours: a bucket falls apart in groups of a band
    and the one below it, in which rows of the upper one (own) meet all.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(1.0001 * math.log(100 / percent)))
    banded = rows.withColumn("own", F.explode(F.array(F.lit(1).cast("long"), F.lit(0).cast("long")))).withColumn("band", band + 1 - F.col("own"))
    counts = scratch.save(banded.groupBy("key", "band").agg(F.count(F.lit(1)).alias("group_rows"), F.max("own").alias("any")), "bands")
    banded = dealt_join(banded, counts.filter("any = 1 AND group_rows > 1").drop("any"), ["key", "band"], "id", hot_keys(counts, ["key", "band"], "group_rows"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks"))
    dealt = banded.withColumn("blocks", F.ceil(F.col("group_rows") / BLOCK_ROWS)).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    group = F.xxhash64("key", "band").alias("key")
    dealt = dealt.select(group, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("long").alias("side"), "id", "meta", "comp", "own", "shape")
    return distinct_pairs(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_cross(feasible, percent, bins), PAIR_SCHEMA))


def linked_components(pairs: DataFrame, large: DataFrame, shapes: DataFrame, fetch, feasible, percent: int, bins: int, scratch: Scratch) -> DataFrame:
    """(id, comp) of all ids with a link: steps 2 to 4.

    shapes has (id, n, shape) of every id in pairs and large, n the size of its set. fetch(ids) reads the sets (id, frag, n, grams) of those ids
    again from the texts: only sets of pairs that may be links are ever shuffled.
    """
    links = comps = None
    for step in (1, 2, 3):
        if step == 1:
            near = close(pairs, shapes, feasible, percent, bins)
        else:
            rows, buckets = spread(large, comps)
            buckets = scratch.save(buckets, f"spread-{step}")
            if buckets.filter("lo < hi").isEmpty():
                break
            hot = hot_keys(buckets, ["key"])
            rows = scratch.save(unresolved(rows, buckets, shapes, hot), f"mixed-{step}")
            near = next_candidates(rows, feasible, percent, bins, NEXT, hot) if step == 2 else last_candidates(rows, feasible, percent, bins, scratch)
        near = scratch.save(near.select("a", "b"), f"near-{step}")
        if step > 1 and near.isEmpty():
            continue
        sets = scratch.save(fetch(near.select(F.col("a").alias("id")).union(near.select("b")).distinct()), f"sets-{step}")
        more = scratch.save(verified(near, sets, percent), f"links-{step}")
        scratch.drop(f"sets-{step}", f"near-{step}", f"mixed-{step}")
        links = more if links is None else links.unionByName(more)
        comps = scratch.save(components(links, scratch, f"comps-{step}"), f"comps-{step}")
    return comps
