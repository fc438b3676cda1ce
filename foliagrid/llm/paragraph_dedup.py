"""Passages and paragraphs that repeat across documents, by MinHash banding.

Two kinds of units are compared. Paragraphs are lines of a shingle or more, of any length. Pieces are cut at words that their own neighbourhood
chooses, whatever the newlines: a word whose hash is the least among the REACH words on either side begins a new one. So a
passage that was pasted into another document has the same pieces wherever it stands and however its lines are broken,
except near its own ends. Units that agree in a band of MinHashes meet, their exact Jaccard similarity of 5-word shingles
is computed, and links make components. Pieces that occur in several documents are
extended word by word as far as they agree with the first occurrence, and neighbours are joined to runs; all occurrences
but the first are to be removed.
"""

import functools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._links import bit_filter, dealt_join, distinct_pairs, flat, has_bit, hot_keys, linked_components, packed, packed_candidates, parts_of, set_shapes
from ._scratch import Scratch
from ._text import GRAM_SALTS, Texts, lean, longs, mix, powers, slices

SHINGLE = 5
PERCENT = 80
REACH = 5
#: Least words of a piece (only a document's first and last can have fewer) and of a run of pieces without a whole line.
LEAST_WORDS, LEAST_RUN = 6, 14
#: At similarity s a pair shares a band with probability 1 - (1 - s ** ROWS) ** BANDS: 0.983 at 0.8, 1 for equal ones.
BANDS, ROWS = 4, 2
FLUSH = 500_000
DOC_BITS, ID_BITS = 22, 24
BINS = 64
U = np.uint64


class Paragraphs:
    """Pieces, then lines: row, first word, words, whether a line, and a hash of the words."""

    def __init__(self, t: Texts):
        h, n = t.hashes, len(t.starts)
        row = np.repeat(np.arange(len(t.n_words)), t.n_words)
        weight = mix(h ^ GRAM_SALTS[-3])
        anchor = np.ones(n, bool)
        for step in range(1, REACH + 1):
            same = row[step:] == row[:-step]
            anchor[step:] &= ~same | (weight[step:] < weight[:-step])
            anchor[:-step] &= ~same | (weight[:-step] <= weight[step:])
        new_row = np.ones(n, bool)
        new_row[1:] = row[1:] != row[:-1]
        new_line = new_row.copy()
        after = np.searchsorted(t.starts, np.flatnonzero(t.data == 10))
        new_line[after[after < n]] = True
        self.cuts = np.append(np.flatnonzero(anchor | new_row), n)
        lines = np.append(np.flatnonzero(new_line), n)
        some, long = np.diff(self.cuts) >= LEAST_WORDS, np.diff(lines) >= SHINGLE
        self.starts, self.ends = np.concatenate([self.cuts[:-1][some], lines[:-1][long]]), np.concatenate([self.cuts[1:][some], lines[1:][long]])
        self.line = np.arange(len(self.starts)) >= np.count_nonzero(some)
        self.row = row[self.starts]
        self.row_starts, self.row_ends = t.ptr[self.row], t.ptr[self.row + 1]
        self.first_word = self.starts - self.row_starts
        self.n_words = self.ends - self.starts
        self.hashes = h
        up, down = powers(n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum(h * up[:-1], out=total[1:])
        self.ids = mix((total[self.ends] - total[self.starts]) * down[self.starts] + self.n_words.astype(U) * GRAM_SALTS[-4]).astype(np.int64)
    @functools.cached_property
    def words(self) -> np.ndarray:
        return (self.hashes >> U(32)).astype(np.uint32)

    @functools.cached_property
    def grams(self) -> np.ndarray:
        h = self.hashes
        out = h[: max(0, len(h) - SHINGLE + 1)] * GRAM_SALTS[0]
        for j in range(1, SHINGLE):
            out += h[j : len(out) + j] * GRAM_SALTS[j]
        return mix(out)

    def shingles(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sets of these units' shingles, each sorted, one after another; and the place in some of each shingle's unit."""
        n = self.n_words[some] - SHINGLE + 1
        own = np.repeat(np.arange(len(some)), n)
        grams = self.grams[np.repeat(self.starts[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        order = np.lexsort((grams, own))
        own, grams = own[order], grams[order]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (grams[1:] != grams[:-1])
        return grams[new], own[new]

    def around(self, some: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """The words before these pieces, backwards to the last cut, and after them, to the next one; none for lines.

        A cut may hang on words up to REACH away that aren't repeated, so REACH more words are taken: any other is shared.
        """
        at = np.searchsorted(self.cuts, self.starts[some])
        before = self.starts[some] - np.maximum(self.cuts[np.maximum(at - 1, 0)] - REACH, self.row_starts[some])
        after = np.minimum(self.cuts[np.minimum(np.searchsorted(self.cuts, self.ends[some], "right"), len(self.cuts) - 1)] + REACH, self.row_ends[some]) - self.ends[some]
        out = []
        for n, first, step in ((before, self.starts[some] - 1, -1), (after, self.ends[some], 1)):
            n = np.where(self.line[some], 0, n)
            offsets = np.concatenate([[0], np.cumsum(n)])
            place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], n)
            flat = self.words[np.repeat(first, n) + step * place]
            out.append(pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(flat.tobytes())]))
        return out[0], out[1]

    def bands(self) -> np.ndarray:
        """Keys (bands, paragraphs): two MinHashes each, of multiplications by odd numbers."""
        if not len(self.starts):
            return np.zeros((BANDS, 0), np.int64)
        edges = np.stack([self.starts, self.ends - SHINGLE + 1], axis=1).ravel()
        padded = np.append(self.grams, np.zeros(1, U))
        out = []
        for b in range(BANDS):
            key = np.full(len(self.starts), b + 1, U)
            for r in range(ROWS):
                key = mix(key ^ np.minimum.reduceat(padded * GRAM_SALTS[8 + b * ROWS + r], edges)[::2])
            out.append(key.astype(np.int64))
        return np.stack(out)


def doc_hash(ids: np.ndarray) -> np.ndarray:
    """56 bits of a document's id, whatever the id."""
    return (mix(ids.astype(U) ^ GRAM_SALTS[-5]) >> U(8)).astype(np.int64)


def _band_rows(parts):
    """Packed (band key, paragraph, document): of a paragraph's documents in a task, two of them at most, the second in one band.

    As many bands are packed together as make FLUSH rows: a task of few paragraphs makes a row for a part, not one for each band.
    """

    def flush(ids, docs, keys):
        ids, docs, keys = np.concatenate(ids), np.concatenate(docs), np.concatenate(keys, axis=1)
        order = np.lexsort((docs, ids))
        ids, docs, keys = ids[order], docs[order], keys[:, order]
        new = np.concatenate([[True], ids[1:] != ids[:-1]])
        last = np.concatenate([new[1:], [True]])
        first_doc = docs[np.flatnonzero(new)][np.cumsum(new) - 1]
        some = [new | (last & (docs != first_doc)), *[new] * (BANDS - 1)]
        together = max(1, FLUSH // np.count_nonzero(new))
        for b in range(0, BANDS, together):
            mask = np.concatenate(some[b : b + together])
            n = len(mask) // len(ids)
            yield packed(keys[b : b + n].ravel()[mask], np.tile(ids, n)[mask], np.tile(docs, n)[mask], parts)

    def band_rows(batches):
        ids, docs, keys, held = [], [], [], 0
        for batch in batches:
            doc = doc_hash(longs(batch, "doc_id")[0])
            for first, _, t in slices(batch, lower=True):
                p = Paragraphs(t)
                ids.append(p.ids)
                docs.append(doc[first + p.row])
                keys.append(p.bands())
                held += len(p.ids)
                if held >= FLUSH:
                    yield from flush(ids, docs, keys)
                    ids, docs, keys, held = [], [], [], 0
        if held:
            yield from flush(ids, docs, keys)

    return band_rows


def _set_rows(docs_in, ids_in, shapes_only):
    def set_rows(batches):
        doc_filter, id_filter = docs_in.value, ids_in.value
        for batch in batches:
            batch = batch.filter(pa.array(has_bit(doc_filter, doc_hash(longs(batch, "doc_id")[0]))))
            for _, _, t in slices(batch, lower=True):
                p = Paragraphs(t)
                some = np.flatnonzero(has_bit(id_filter, p.ids))
                some = some[np.sort(np.unique(p.ids[some], return_index=True)[1])]
                grams, own = p.shingles(some)
                sizes = np.bincount(own, minlength=len(some))
                if shapes_only:
                    yield pa.RecordBatch.from_arrays([pa.array(p.ids[some]), pa.array(sizes), set_shapes(own, grams, len(some), BINS)], names=["id", "n", "shape"])
                else:
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * np.int32(8)
                    sets = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(grams.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(p.ids[some]), pa.array(np.zeros(len(some), np.int32)), pa.array(sizes), sets], names=["id", "frag", "n", "grams"])

    return set_rows


def _occurrences(ids_in):
    def occurrences(batches):
        id_filter = ids_in.value
        for batch in batches:
            docs, valid = longs(batch, "doc_id")
            for first, _, t in slices(batch, lower=True):
                p = Paragraphs(t)
                some = np.flatnonzero(has_bit(id_filter, p.ids))
                at = first + p.row[some]
                yield pa.RecordBatch.from_arrays([pa.array(docs[at], mask=~valid[at]), batch.column("row_key").take(pa.array(at)), pa.array(p.first_word[some]), pa.array(p.n_words[some]), pa.array(p.line[some]), *p.around(some), pa.array(p.ids[some])], names=["doc_id", "row_key", "start_word", "n_words", "line", "before", "after", "id"])

    return occurrences


def agreeing(x: pa.Array, y: pa.Array) -> np.ndarray:
    """How many words two columns of words have in common from their beginnings, row by row; a null has none."""
    (x, px), (y, py) = (flat(c.fill_null(b""), np.uint32) for c in (x, y))
    n = np.minimum(np.diff(px), np.diff(py))
    begin = np.cumsum(n) - n
    at = np.arange(n.sum())
    differ = np.append(np.flatnonzero(x[np.repeat(px[:-1] - begin, n) + at] != y[np.repeat(py[:-1] - begin, n) + at]), n.sum())
    return np.minimum(differ[np.searchsorted(differ, begin)] - begin, n)


def _extended(batches):
    for batch in batches:
        left, right = (agreeing(batch.column(k), batch.column(f"first_{k}")) for k in ("before", "after"))
        rest = batch.drop_columns(["before", "after", "first_before", "first_after"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(left), pa.array(right)], names=[*rest.schema.names, "left", "right"])


def any_pair(ma: np.ndarray, mb: np.ndarray) -> np.ndarray:
    return np.ones(len(ma), bool)


def repeated_passages(docs: DataFrame, least_run: int = LEAST_RUN) -> DataFrame:
    """A row for each run of units that occur in several documents: doc_id, start_word, n_words, component_id (of the
    run's first unit), first_doc_id (the least with it) and removed (whether an earlier occurrence stays).

    Earlier is by doc_id, then text (a hash of it), then place. Pieces have LEAST_WORDS words or more, but for a text's
    first and last; lines have SHINGLE or more (shorter ones have no shingle), and are compared whole, however long. Null
    and empty texts have no units; a null doc_id comes after all others; rows that repeat a doc_id count as one document
    when repeats are sought, and runs are found in each text apart; rows that repeat both count once; an empty table gives
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "paragraphs")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pairs, large, again, met = packed_candidates(rows.mapInArrow(lean(_band_rows(parts_of(spark))), "part int, rows binary"), any_pair, scratch)
    wanted = scratch.save(met.groupBy("id").agg(F.first("meta").alias("meta")), "wanted")
    send = spark.sparkContext.broadcast

    def read_again(own: DataFrame, shapes_only: bool, schema: str) -> DataFrame:
        """Shapes or sets of these paragraphs (id, meta), from the texts of one document for each."""
        filters = send(bit_filter(own.select("meta"), DOC_BITS)), send(bit_filter(own.select("id"), ID_BITS))
        return rows.mapInArrow(lean(_set_rows(*filters, shapes_only)), schema).join(own, "id", "left_semi").dropDuplicates(["id"])

    def fetch(ids: DataFrame) -> DataFrame:
        own = scratch.save(ids.join(wanted, "id").select("id", "meta"), f"own-{uuid.uuid4().hex}")
        return read_again(own, False, "id long, frag int, n long, grams binary")

    pairs = distinct_pairs(pairs)
    shapes = scratch.save(read_again(wanted, True, "id long, n long, shape binary"), "shapes")
    comps = linked_components(pairs, large, shapes, fetch, any_pair, PERCENT, BINS, scratch)
    twice = again.filter("ma <> mb").select("id").distinct()
    nodes = scratch.save(twice.join(comps, "id", "full").select("id", F.coalesce("comp", "id").alias("comp")), "nodes")
    scratch.drop("buckets", "wanted", "shapes")
    keyed = rows.withColumn("row_key", F.xxhash64("text"))
    seen = scratch.save(keyed.mapInArrow(lean(_occurrences(send(bit_filter(nodes.select("id"), ID_BITS)))), "doc_id long, row_key long, start_word long, n_words long, line boolean, before binary, after binary, id long"), "seen")
    times = scratch.save(seen.groupBy("id").agg(F.count(F.lit(1)).alias("rows")), "times")
    found = scratch.save(dealt_join(seen, nodes, ["id"], "row_key", hot_keys(times, ["id"])).drop("id"), "found")
    scratch.drop("seen", "times")
    row = [F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("row_key")]
    place = F.struct(*row, "start_word", (-F.col("n_words")).alias("less"), "line", "before", "after")
    ends = found.groupBy("comp").agg(F.min(place).alias("first"), F.max(F.struct(*row[:2])).alias("last"), F.count(F.lit(1)).alias("rows"))
    ends = scratch.save(ends, "ends")
    first = F.col("first")
    spread = ends.filter(~first["doc_id"].eqNullSafe(F.col("last.doc_id"))).select("comp", first["doc_id"].alias("first_doc_id"), first["row_key"].alias("first_row"), first["start_word"].alias("first_start"), (first["start_word"] - first["less"]).alias("first_end"), first["before"].alias("first_before"), first["after"].alias("first_after"))
    known = dealt_join(found, spread, ["comp"], "row_key", hot_keys(ends, ["comp"])).withColumn("end_word", F.col("start_word") + F.col("n_words"))
    own = F.col("doc_id").eqNullSafe(F.col("first_doc_id")) & (F.col("row_key") == F.col("first_row")) & (F.col("start_word") < F.col("first_end")) & (F.col("end_word") > F.col("first_start"))
    names = ["doc_id", "row_key", "start_word", "end_word", "line", "comp", "first_doc_id", "first_row", "first_start", "first_end", "removed"]
    known = known.withColumn("removed", ~own).select(*names, "before", "after", "first_before", "first_after")
    known = scratch.save(known.mapInArrow(_extended, "doc_id long, row_key long, start_word long, end_word long, line boolean, comp long, first_doc_id long, first_row long, first_start long, first_end long, removed boolean, left long, right long"), "known")
    scratch.drop("nodes", "found", "ends")
    reach = lambda side: F.when(F.col("removed"), F.col(side)).otherwise(0)
    spans = known.select("doc_id", "row_key", (F.col("start_word") - reach("left")).alias("s"), (F.col("end_word") + reach("right")).alias("e"), "line", "removed", "comp", "first_doc_id")
    firsts = known.filter("removed AND left + right > 0").groupBy("comp", "first_doc_id", "first_row", "first_start", "first_end").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    firsts = firsts.select(F.col("first_doc_id").alias("doc_id"), F.col("first_row").alias("row_key"), (F.col("first_start") - F.col("left")).alias("s"), (F.col("first_end") + F.col("right")).alias("e"), F.lit(False).alias("line"), F.lit(False).alias("removed"), "comp", "first_doc_id")
    order = Window.partitionBy("doc_id", "row_key", "removed").orderBy("s", F.desc("e"), "comp")
    starts = F.coalesce(F.col("s") > F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    run = spans.unionByName(firsts).withColumn("starts", starts.cast("int")).withColumn("run", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.struct("s", (-F.col("e")).alias("e"), "comp", "first_doc_id"))
    runs = run.groupBy("doc_id", "row_key", "removed", "run").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"), first.alias("f"), F.max("line").alias("line"))
    runs = runs.filter((F.col("end_word") - F.col("start_word") >= least_run) | F.col("line"))
    return runs.select("doc_id", "start_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), F.col("f.comp").alias("component_id"), F.col("f.first_doc_id").alias("first_doc_id"), "removed")
