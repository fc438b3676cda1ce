"""Benchmark items in documents: windows of the items' sizes, found by SimHash and verified by weighted shingles.

Every window of a document is fingerprinted: the 64 signed sums of its shingles' weights roll along the text, so that a
window costs a difference of two rows of running sums. Items of like size share one window size (a class), so there are as
many windows at a word as classes, however many sizes the items have. A multi-index finds the items of the class whose
fingerprints are within RADIUS of the window's, all of them by pigeonhole. Around each window that it finds, the item-sized
windows are compared by exact weighted similarity.
"""

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch
from ._text import GRAM_SALTS, Texts, lean, longs, mix, of_strings, slices

SHINGLE = 5
THRESHOLD = 0.8
#: Bits that fingerprints may differ in. Similarity 0.8 differs in 10 of 64 on average, 11 by the class's window, so 15 is
#: one and a half deviations more, and windows one or two words away try again.
RADIUS = 15
BITS, BLOCK_BITS = 64, 16
#: Groups of a class's items, 4 or 8, by which fingerprints that are near none are told.
GROUPS = 4
#: Sizes of items in a class differ by this factor at most.
CLASS_RATIO = 1.15
#: Whole numbers that a weight of 1 has in a fingerprint.
WEIGHT_STEPS = 4
#: Items (and bytes of their texts) that are broadcast and indexed at once, some 20 kB each in a worker; a larger benchmark
#: is searched in so many blocks. Weights are of all.
ITEMS_AT_ONCE, BYTES_AT_ONCE = 4_096, 8 << 20
#: Windows of a class that are fingerprinted together, and such chunks whose fingerprints are held, so that one class's index
#: after the other stays in a processor's cache.
CHUNK, CHUNKS = 8_192, 16
SCHEMA = "doc_id long, item_id long, similarity double, hamming int, start_word long, n_words long"
U = np.uint64


#: The eight signs of each byte.
SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int16) * 2 - 1


def signed(grams: np.ndarray, weights: np.ndarray, kind) -> np.ndarray:
    """A row of 64 signed weights for each gram: plus where its hash has a 1."""
    out = SIGNS.astype(kind, copy=False).take(mix(grams ^ GRAM_SALTS[-1]).view(np.uint8), axis=0).reshape(-1, BITS)
    out *= weights.astype(kind)[:, None]
    return out


def running_sums(rows: np.ndarray) -> np.ndarray:
    """Sums of all rows before each, and of all, by groups of 16 rows, and groups of those."""
    n = len(rows)
    out = np.zeros((1 + -(-n // 16) * 16, rows.shape[1]), rows.dtype)
    out[1 : n + 1] = rows
    groups = out[1:].reshape(-1, 16, rows.shape[1])
    for i in range(1, 16):
        groups[:, i] += groups[:, i - 1]
    if len(groups) > 1:
        groups[1:] += (running_sums(groups[:, 15])[1:-1] if len(groups) > 16 else np.cumsum(groups[:-1, 15], axis=0, dtype=rows.dtype))[:, None]
    return out[: n + 1]


def prints(sums: np.ndarray) -> np.ndarray:
    """64-bit SimHash (Charikar 2002) of rows of sums."""
    return np.packbits((sums > 0).ravel()).view(U)


def fingerprints(grams: np.ndarray, weights: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """SimHash of each run of weighted grams; no run may be empty."""
    if len(ptr) < 2:
        return np.zeros(0, U)
    return prints(np.add.reduceat(signed(grams, weights, np.int64), ptr[:-1], axis=0))


@cache
def near_values(radius: int) -> np.ndarray:
    """What to xor with a block's value to get all values within radius."""
    return np.array([sum(1 << b for b in some) for n in range(radius + 1) for some in combinations(range(BLOCK_BITS), n)], np.uint16)


def least_distances(blocks: np.ndarray) -> list[np.ndarray]:
    """For each column of blocks: how many bits each value differs in from the nearest value of that column."""
    found = []
    for values in blocks.T:
        out = np.full(1 << BLOCK_BITS, BLOCK_BITS, np.uint8)
        out[values] = 0
        for bit in range(BLOCK_BITS):
            a, b = out.reshape(-1, 2, 1 << bit).transpose(1, 0, 2)
            a[:], b[:] = np.minimum(a, b + np.uint8(1)), np.minimum(b, a + np.uint8(1))
        found.append(out)
    return found


class HammingIndex:
    """Fingerprints in four blocks of 16 bits. If two differ in radius bits at most, then in some block by no more than
    that block's share of the radius (shares, each plus one, sum to radius + 1). Each block has a table of all values
    that are so near to a fingerprint's. Bounds come first: the fingerprints are dealt to GROUPS, and blocks' least distances
    from those of a group, a byte of a word for each group, sum to more than the radius in every byte if none is near."""

    def __init__(self, own: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = own, radius
        n = BITS // BLOCK_BITS
        self.shares = [radius // n if i < radius % n + 1 else radius // n - 1 for i in range(n)]
        assert sum(s + 1 for s in self.shares) == radius + 1
        groups = [least_distances(some.view(np.uint16).reshape(-1, n)) for some in np.array_split(own, GROUPS)]
        self.least = [np.ascontiguousarray(np.stack(block, axis=1)).view(f"u{GROUPS}").ravel() for block in zip(*groups, strict=True)]
        self.tables = []
        for block, share in zip(own.view(np.uint16).reshape(-1, n).T, self.shares, strict=True):
            values = (block[:, None] ^ near_values(share)[None, :]).ravel() if share >= 0 else np.zeros(0, np.uint16)
            order = np.argsort(values, kind="stable")
            items = np.repeat(np.arange(len(own), dtype=np.int32), len(near_values(share)))[order] if share >= 0 else np.zeros(0, np.int32)
            counts = np.bincount(values, minlength=1 << BLOCK_BITS)
            small = np.uint8 if counts.max(initial=0) < 256 else np.int32
            self.tables.append((counts.astype(small), np.cumsum(counts) - counts, items))

    def possible(self, values: np.ndarray) -> np.ndarray:
        """Columns of blocks' values (blocks, fingerprints) that the bounds let be near some fingerprint."""
        bound = self.least[0].take(values[0])
        for value, least in zip(values[1:], self.least[1:], strict=True):
            bound += least.take(value)
        word = bound.dtype.type
        every = word(0x0101010101010101 >> 64 - 8 * GROUPS)
        bound += every * word(127 - self.radius)  # sets a byte's highest bit if its sum is beyond the radius
        return np.flatnonzero(bound & (every << word(7)) != every << word(7))

    def within(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in some, number) of all pairs within radius, once or more each."""
        places, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        values = np.ascontiguousarray(some.view(np.uint16).reshape(-1, BITS // BLOCK_BITS).T).astype(np.intp)
        kept = self.possible(values)
        some = some.take(kept)
        for value, (counts, starts, postings) in zip(values.take(kept, axis=1), self.tables, strict=True):
            n = counts.take(value)
            hit = np.flatnonzero(n)
            n = n.take(hit).astype(np.intp)
            ends = np.cumsum(n)
            first = starts.take(value.take(hit)) - (ends - n)
            item = postings.take(np.repeat(first, n) + np.arange(ends[-1] if len(ends) else 0))
            place = np.repeat(hit, n)
            near = np.flatnonzero(np.bitwise_count(some.take(place) ^ self.prints.take(item)) <= self.radius)
            places.append(kept.take(place.take(near)))
            items.append(item.take(near))
        return np.concatenate(places), np.concatenate(items)


class Benchmark:
    """One block of items: shingles, weights, and an index of fingerprints for each class of sizes.

    totals is (items with words, shingles, items with each) of the whole benchmark; without it, of this block.
    """

    def __init__(self, items: list[tuple[int, str | None]], totals: tuple | None = None):
        t = of_strings([x for _, x in items], lower=True)
        n = t.n_words
        some = np.flatnonzero(n > 0)
        self.ids = [items[i][0] for i in some]
        self.sizes = n[some]
        self.k = np.minimum(self.sizes, SHINGLE)
        grams = {int(k): t.grams(int(k)) for k in np.unique(self.k)}
        self.grams = [grams[int(k)][0][grams[int(k)][1][i] : grams[int(k)][1][i + 1]] for i, k in zip(some, self.k, strict=True)]
        if totals is None:
            every = [np.unique(g) for g in self.grams]
            totals = (len(some), *np.unique(np.concatenate([np.zeros(0, U), *every]), return_counts=True))
        n_items, self.known, df = totals
        self.known_bits = np.zeros(1 << 18, bool)
        self.known_bits[self.known & U(len(self.known_bits) - 1)] = True
        self.rarest = 1.0 + np.log(1.0 + n_items)
        self.weight = 1.0 + np.log((1.0 + n_items) / (1.0 + df))
        self.total = np.array([self.weights(g).sum() for g in self.grams])
        #: (words in a shingle, shingles in a window, items, their index, whole numbers that sums need)
        self.classes = []
        for k in np.unique(self.k):
            own = np.flatnonzero(self.k == k)
            own = own[np.argsort(self.sizes[own], kind="stable")]
            counts = self.sizes[own] - k + 1
            while len(own):
                end = int(np.searchsorted(counts, counts[0] * CLASS_RATIO, "right"))
                mine = [self.grams[i] for i in own[:end]]
                flat = np.concatenate(mine)
                ptr = np.concatenate([[0], np.cumsum([len(g) for g in mine])])
                index = HammingIndex(fingerprints(flat, self.steps(self.weights(flat)), ptr))
                window = int(round(float(np.sqrt(counts[0] * counts[end - 1]))))
                kind = np.int16 if window * self.steps(np.array([self.rarest]))[0] < 1 << 15 else np.int64
                self.classes.append((int(k), window, own[:end], index, kind))
                own, counts = own[end:], counts[end:]

    @staticmethod
    def steps(weights: np.ndarray) -> np.ndarray:
        return np.rint(weights * WEIGHT_STEPS).astype(np.int64)

    def places(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where known shingles are in known, and which are."""
        at, known = np.zeros(len(grams), np.int64), np.zeros(len(grams), bool)
        some = np.flatnonzero(self.known_bits.take((grams & U(len(self.known_bits) - 1)).astype(np.intp)))
        if len(some):
            at[some] = np.minimum(np.searchsorted(self.known, grams[some]), len(self.known) - 1)
            known[some] = self.known[at[some]] == grams[some]
        return at, known

    def weights(self, grams: np.ndarray) -> np.ndarray:
        """Rarity of shingles among the items; a shingle of no item weighs most."""
        at, known = self.places(grams)
        return np.where(known, self.weight[at] if len(self.weight) else 0.0, self.rarest)

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard of two bags of shingles: sum of weight * least count over sum of weight * greatest count."""
        values, inverse = np.unique(np.concatenate([window, self.grams[item]]), return_inverse=True)
        a = np.bincount(inverse[: len(window)], minlength=len(values))
        b = np.bincount(inverse[len(window) :], minlength=len(values))
        w = self.weights(values)
        return float((w * np.minimum(a, b)).sum() / (w * np.maximum(a, b)).sum())

    def windows(self, grams: np.ndarray, ptr: np.ndarray, k: int, steps: np.ndarray):
        """(first shingle, shingles, item) of the windows of shingles of k words that the index finds, a chunk at a time.

        A text that is shorter than a class's window, but could be an item of it, is one window.
        """
        lengths = np.diff(ptr)
        left = np.repeat(ptr[1:], lengths) - np.arange(len(grams))
        classes = [c for c in self.classes if c[0] == k]
        most = max(c[1] for c in classes)
        for kind in {c[4] for c in classes}:
            own_kind = [c for c in classes if c[4] is kind]
            for begin in range(0, len(grams), CHUNK * CHUNKS):
                held = [[] for _ in own_kind]
                for at in range(begin, min(len(grams), begin + CHUNK * CHUNKS), CHUNK):
                    end = min(len(grams), at + CHUNK + most)
                    sums = running_sums(signed(grams[at:end], steps[at:end], kind))
                    for (_, n, *_), some in zip(own_kind, held, strict=True):
                        count = min(CHUNK, end - at - n + 1)
                        if count > 0:
                            some.append((at, prints(sums[n : n + count] - sums[:count])))
                for (_, n, items, index, _), some in zip(own_kind, held, strict=True):
                    for at, own in some:
                        place, found = index.within(own)
                        ok = left[at + place] >= n
                        yield at + place[ok], np.full(np.count_nonzero(ok), n), items[found[ok]]
        for _, n, items, index, _ in classes:
            rows = np.flatnonzero((lengths < n) & (lengths * 2 > n))
            if len(rows):
                own = np.concatenate([np.arange(ptr[r], ptr[r + 1]) for r in rows])
                ends = np.cumsum(lengths[rows])
                place, found = index.within(fingerprints(grams[own], steps[own], np.append(0, ends)))
                yield ptr[rows[place]], lengths[rows[place]], items[found]

    def matches(self, t: Texts, threshold: float):
        """(row, item, similarity, hamming, first word, words) of windows that pass, the best for each row and item.

        What a window and an item share weighs no more than the window's shingles that some item has, and the item's
        weight times threshold at least if they are to pass: so most windows that the index finds by chance go.
        """
        out = []
        for k in sorted({c[0] for c in self.classes}):
            grams, ptr = t.grams(k)
            keep = np.repeat(t.n_words >= k, np.diff(ptr))
            grams, ptr = grams[keep], np.concatenate([[0], np.cumsum(np.where(t.n_words >= k, np.diff(ptr), 0))])
            at, known = self.places(grams)
            weight = np.where(known, self.weight[at], self.rarest)
            shared = np.concatenate([[0.0], np.cumsum(np.where(known, weight, 0.0))])
            near: dict[tuple[int, int], list] = {}
            for first, n, item in self.windows(grams, ptr, k, self.steps(weight)):
                row = np.searchsorted(ptr, first, "right") - 1
                low = np.maximum(ptr[row], first - n // 4 - 1)
                high = np.minimum(ptr[row + 1], first + n + n // 4 + 1)
                ok = np.flatnonzero(shared[high] - shared[low] >= threshold * self.total[item] - 1e-6)
                for r, i, a, b in np.unique(np.stack([row[ok], item[ok], low[ok], high[ok]], axis=1), axis=0).tolist():
                    some = near.setdefault((r, i), [])
                    if some and a <= some[-1][1]:
                        some[-1][1] = max(some[-1][1], b)
                    else:
                        some.append([a, b])
            for (r, i), some in sorted(near.items()):
                found = min((x for a, b in some if (x := self.best(grams, weight, int(ptr[r]), int(ptr[r + 1]), a, b, i, threshold))), default=None)
                if found:
                    s, first, n = -found[0], found[1], found[2]
                    print_of = fingerprints(grams[first : first + n], self.steps(weight[first : first + n]), np.array([0, n]))[0]
                    own = fingerprints(self.grams[i], self.steps(self.weights(self.grams[i])), np.array([0, len(self.grams[i])]))[0]
                    out.append((r, i, s, int(np.bitwise_count(print_of ^ own)), first - int(ptr[r]), n + k - 1))
        return sorted(out)

    def best(self, grams, weight, begin: int, end: int, low: int, high: int, item: int, threshold: float):
        """(-similarity, first shingle, shingles) of the item-sized windows between low and high, or None."""
        n = min(len(self.grams[item]), end - begin)
        low, high = max(begin, min(low, end - n)), max(min(high, end), min(low + n, end))
        part, w = grams[low:high], weight[low:high]
        m = np.concatenate([[0.0], np.cumsum(np.where(np.isin(part, self.grams[item]), w, 0.0))])
        every = np.concatenate([[0.0], np.cumsum(w)])
        first = np.arange(max(1, len(part) - n + 1))
        last = np.minimum(first + n, len(part))
        m, b = m[last] - m[first], every[last] - every[first]
        some = first[m >= threshold * (self.total[item] + b - m) - 1e-6]
        found = [(-s, low + f, n) for f in some.tolist() if (s := self.similarity(part[f : f + n], item)) >= threshold]
        return min(found, default=None)


def _searcher(block, totals, threshold):
    def search(batches):
        bench = Benchmark(block.value, totals.value)
        for batch in batches:
            ids, valid = longs(batch, "doc_id")
            out = [(ids[first + row].item() if valid[first + row] else None, bench.ids[item], s, far, at, n) for first, _, t in slices(batch, lower=True) for row, item, s, far, at, n in bench.matches(t, threshold)]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "similarity", "hamming", "start_word", "n_words"])

    return search


def _item_grams(batches):
    """A row for each item's distinct shingle, and one for the item itself: (size, or 0; shingle)."""
    for batch in batches:
        for _, _, t in slices(batch, lower=True):
            sizes, out = t.n_words[t.n_words > 0], []
            for k in np.unique(np.minimum(sizes, SHINGLE)):
                grams, ptr = t.grams(int(k))
                out += [np.unique(grams[ptr[i] : ptr[i + 1]]) for i in np.flatnonzero((np.minimum(t.n_words, SHINGLE) == k) & (t.n_words > 0))]
            flat = np.concatenate([np.zeros(0, U), *out]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([sizes, np.zeros(len(flat), np.int64)]).astype(np.int64)), pa.array(np.concatenate([np.zeros(len(sizes), np.int64), flat]))], names=["size", "gram"])


def benchmark_totals(benchmark: DataFrame) -> tuple:
    """Benchmark's totals of all items: 16 bytes for each distinct shingle, as any may stand in any window."""
    got = benchmark.select(F.col("text").cast("string").alias("text")).mapInArrow(_item_grams, "size long, gram long").groupBy("size", "gram").count().toArrow()
    size, gram, n = (got.column(k).to_numpy() for k in ("size", "gram", "count"))
    item = size > 0
    known = gram[~item].view(U)
    order = np.argsort(known)
    return int(n[item].sum()), known[order], n[~item][order]


def benchmark_blocks(benchmark: DataFrame):
    """The items in blocks that are small enough to broadcast, read one after another."""
    block, held = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        block.append((row[0], row[1]))
        held += len(row[1] or "")
        if len(block) >= ITEMS_AT_ONCE or held >= BYTES_AT_ONCE:
            yield block
            block, held = [], 0
    if block:
        yield block


def find_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document and item with a window of similarity threshold or more: doc_id, item_id, similarity,
    hamming, start_word and n_words of the best window.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z in lower case; shingles have five words, or all of an item
    with fewer. Documents are read once for each block of items and not shuffled. Null or empty texts match nothing,
    repeated documents match alike, items that repeat are found each, an item without id has a null item_id, an empty
    benchmark finds nothing, other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = spark.createDataFrame([], SCHEMA)
    totals = spark.sparkContext.broadcast(benchmark_totals(benchmark))
    for i, block in enumerate(benchmark_blocks(benchmark)):
        part = rows.mapInArrow(lean(_searcher(spark.sparkContext.broadcast(block), totals, threshold)), SCHEMA)
        found = part if i == 0 else found.unionByName(part)
    return found


def _marker(block, totals, threshold):
    def mark(batches):
        bench = Benchmark(block.value, totals.value)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for first, _, t in slices(batch, lower=True):
                for row, *_ in bench.matches(t, threshold):
                    keep[first + row] = False
            yield batch.filter(pa.array(keep))

    return mark


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without any item, with the columns of docs: one pass and no shuffle for each block of items, and a
    table written between blocks.

    Documents with null or empty texts stay, as all do if the benchmark is empty; repeated rows stay or go alike.
    """
    spark = docs.sparkSession
    scratch, totals = Scratch(spark, "clean"), spark.sparkContext.broadcast(benchmark_totals(benchmark))
    last = None
    for i, block in enumerate(benchmark_blocks(benchmark)):
        if last is not None:
            docs = scratch.save(last, f"block-{i}")
        last = docs.mapInArrow(lean(_marker(spark.sparkContext.broadcast(block), totals, threshold)), docs.schema)
    return docs if last is None else last
