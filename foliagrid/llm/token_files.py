"""Token ids of whole texts in static-rANS segments, in ascending doc_id order, and back."""

import gc
import json
import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from . import _rans
from ._scratch import Scratch
from ._text import GRAM_SALTS, U, buffers, lean, longs, mix

END_ID = 0
#: Ids after which a segment is closed, at the end of a slice of documents.
SEGMENT_IDS = 1 << 20
#: Bytes of text that are cut and looked up together, if no text is longer.
SLICE_BYTES = 1 << 20
#: Pieces that a worker remembers (some 60 bytes each) and 8-byte words of the longest; longer ones are encoded where they
#: occur.
MEMO, MEMO_WORDS = 1 << 20, 3
FILE_SCHEMA = "shard int, segment int, n_docs long, n_ids long, image binary"
READ_SCHEMA = "shard int, doc_id long, start long, n_tokens long, ids_crc32 long"

OTHER, LETTER, DIGIT, SPACE, BLANK, APOSTROPHE, MARK = range(7)
KIND = np.full(256, OTHER, np.uint8)
for _byte in range(0x21, 0x7F):
    KIND[_byte] = LETTER if chr(_byte).isalpha() else DIGIT if chr(_byte).isdigit() else APOSTROPHE if _byte == 0x27 else MARK
KIND[[9, 10, 11, 12, 13]] = BLANK
KIND[32] = SPACE
#: Pairs of neighbours' kinds between which a token always ends.
ENDS = np.zeros(64, bool)
for _a, _b in ((LETTER, DIGIT), (DIGIT, LETTER), (LETTER, MARK), (DIGIT, MARK), (LETTER, APOSTROPHE), (DIGIT, APOSTROPHE), (MARK, LETTER), (MARK, DIGIT), (APOSTROPHE, DIGIT)):
    ENDS[8 * _a + _b] = True
#: White space beyond ASCII, in UTF-8.
WIDE_SPACES = [chr(x).encode() for x in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices starts[i] to starts[i] + sizes[i] - 1, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def alphabet() -> np.ndarray:
    """The character that a byte-level vocabulary has for each byte: itself if it is visible in Latin-1, else one from 256 on."""
    visible = [33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255 for b in range(256)]
    return np.array([b if v else 255 + b + 1 - sum(visible[:b]) for b, v in enumerate(visible)], "<u2")


class Encoder:
    """Ids of texts by the tokenizers library, which is called once for each distinct piece of text.

    The byte-level pre-tokenizer (the pattern of GPT-2) always ends a token before a run of white space, before and after
    the run's last character, if that isn't a space that the next token takes, and where an ASCII letter, digit or mark
    meets one of another kind, but for an apostrophe before a letter. Texts are cut there, with array operations. Next to
    other characters no cut is made, and a text is encoded whole where it has white space beyond ASCII or an added token.
    Files with another pre-tokenizer, a normalizer or unusual added tokens aren't cut at all.

    Pieces of one kind of character are single tokens of the pre-tokenizer: they go to the library's model alone, written
    in its alphabet. Letters of Latin-1 and Latin Extended-A count as letters here. Known pieces are found by hash, and
    then compared byte by byte: what differs is encoded by itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        usual = all(x["content"] and not any(x.get(k) for k in ("lstrip", "rstrip", "single_word", "normalized")) and not any(c.isspace() for c in x["content"]) for x in added)
        self.cuts = plain and usual and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding") and not spec["model"].get("dropout")
        self.added = [x["content"].encode() for x in added]
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.model, self.alphabet = self.tokenizer.model, alphabet()
        self.forget()

    def forget(self) -> None:
        """Empty the memory: of each piece, its hash (sorted, with its number), words, size, and where its ids end."""
        self.hashes, self.number = np.zeros(0, U), np.zeros(0, np.int64)
        self.words, self.sizes = np.zeros((0, MEMO_WORDS), U), np.zeros(0, np.int64)
        self.ids, self.id_ends = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def single(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that are a token of the pre-tokenizer each, and how many each has."""
        text, ends, tokenize = self.alphabet[data].tobytes().decode("utf-16-le"), np.cumsum(sizes).tolist(), self.model.tokenize
        found = [[x.id for x in tokenize(text[a:b])] for a, b in zip([0, *ends], ends, strict=False)]
        return np.fromiter(chain.from_iterable(found), self.dtype), np.fromiter(map(len, found), np.int64, len(found))

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin, ascending: at each text that isn't empty, and at each cut; and which are single tokens."""
        n = len(data)
        first = np.zeros(n + 1, bool)
        first[offsets[:-1]] = True
        if not self.cuts or not n:
            starts = np.flatnonzero(first[:n])
            return starts, np.zeros(len(starts), bool)
        kind = KIND[data]
        lead = np.flatnonzero((data >= 0xC2) & (data <= 0xE3))
        lead = lead[lead < n - 1]
        latin = lead[((data[lead] == 0xC3) & (data[lead + 1] | 0x20 != 0xB7)) | (data[lead] == 0xC4) | (data[lead] == 0xC5)]
        kind[latin], kind[latin + 1] = LETTER, LETTER
        blank = (kind == SPACE) | (kind == BLANK)
        cut = np.zeros(n + 1, bool)
        cut[1:n] = ENDS[(kind[:-1] << 3) | kind[1:]] | (blank[1:] & ~blank[:-1])
        last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~first[1:n])  # of a run that something follows in its text
        cut[last] = True
        cut[last[kind[last] == BLANK] + 1] = True
        raw, never = data.tobytes() if self.added else b"", []
        for x in self.added:
            at = raw.find(x)
            while at >= 0:
                never.append(at)
                at = raw.find(x, at + 1)
        for x in WIDE_SPACES:
            at = lead[data[lead] == x[0]]
            for i, byte in enumerate(x[1:], 1):
                at = at[at + i < n]
                at = at[data[at + i] == byte]
            never += at.tolist()
        texts = np.unique(np.searchsorted(offsets, np.array(never, np.int64), "right") - 1)
        for at in texts:
            cut[offsets[at] : offsets[at + 1]] = False
        edge = (first | cut)[:n]
        starts = np.flatnonzero(edge)
        kind[kind == APOSTROPHE] = MARK
        body = starts + (kind[starts] == SPACE)
        edge[body[body < n]] = True
        change = np.flatnonzero((kind[1:] != kind[:-1]) & ~edge[1:]) + 1
        has = kind[np.minimum(body, n - 1)]
        single = (body < np.append(starts[1:], n)) & ((has == LETTER) | (has == DIGIT) | (has == MARK))
        single[np.searchsorted(starts, np.concatenate([change, offsets[texts]]), "right") - 1] = False
        return starts, single

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, END_ID after each, and how many each has."""
        starts, single = self.pieces(data, offsets)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        sizes = ends - starts
        words, h = self.words_of(data, starts, sizes)
        short = single & (sizes <= 8 * MEMO_WORDS)
        place = self.look_up(h)
        place[~short] = -1
        new = np.flatnonzero(short & (place < 0))
        if len(new):
            if len(self.hashes) > MEMO:
                self.forget()
                new = np.flatnonzero(short)
            _, one, same = np.unique(h[new], return_index=True, return_inverse=True)
            place[new] = len(self.hashes) + same
            self.learn(h[new[one]], data, starts[new[one]], sizes[new[one]])
        known = np.flatnonzero(place >= 0)
        wrong = np.zeros(len(place), bool)
        wrong[known] = self.sizes[place[known]] != sizes[known]
        for i, (some, w) in enumerate(words):
            at = place[some]
            found = np.flatnonzero(at >= 0)
            wrong[some[found[self.words[at[found], i] != w[found]]]] = True
        place[wrong] = -1
        alone = np.flatnonzero(place < 0)
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(starts[alone].tolist(), ends[alone].tolist(), strict=True)]
        distinct = {x: i for i, x in enumerate(dict.fromkeys(texts))}
        more = self.whole(list(distinct))
        ids = np.concatenate([self.ids, np.array([END_ID], self.dtype), *more])
        begins = np.concatenate([self.id_ends, len(self.ids) + 1 + np.cumsum([0, *[len(x) for x in more]])])
        place[alone] = len(self.id_ends) + np.array([distinct[x] for x in texts], np.int64)
        ptr = np.searchsorted(starts, offsets)
        order = np.insert(place, ptr[1:], len(self.id_ends) - 1)
        n = begins[order + 1] - begins[order]
        total = np.concatenate([[0], np.cumsum(n)])
        row = ptr + np.arange(len(ptr))
        return ids[ragged(begins[order], n)], total[row[1:]] - total[row[:-1]]

    @staticmethod
    def words_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """The pieces' bytes as 8-byte words: (pieces, words) for the first word, the second, and so on; and hashes."""
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        at_byte = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        some, h, out = np.arange(len(starts)), mix(sizes.astype(U)), []
        for i in range(MEMO_WORDS):
            if i:
                some = some[sizes[some] > 8 * i]
            left = np.minimum(sizes[some] - 8 * i, 8).astype(U)
            w = at_byte[starts[some] + 8 * i] & (~U(0) >> (U(64) - (left << U(3))))
            out.append((some, w))
            h[some] = mix(h[some] ^ w * GRAM_SALTS[i])
        return out, h

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Numbers of known pieces, or -1: each hash is sought among the few that agree in their first bits."""
        out = np.full(len(h), -1, np.int64)
        bits = max(1, len(self.hashes).bit_length())
        first = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((self.hashes >> U(64 - bits)).astype(np.int64), minlength=1 << bits), out=first[1:])
        top = (h >> U(64 - bits)).astype(np.int64)
        at, end, some = first[top], first[top + 1], np.arange(len(h))
        while len(some):
            left = at < end
            some, at, end = some[left], at[left], end[left]
            hit = self.hashes[at] == h[some]
            out[some[hit]] = self.number[at[hit]]
            some, at, end = some[~hit], at[~hit] + 1, end[~hit]
        return out

    def learn(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Put pieces with ascending, new hashes in memory."""
        ids, n = self.single(data[ragged(starts, sizes)], sizes)
        words = np.zeros((len(h), MEMO_WORDS), U)
        for i, (some, w) in enumerate(self.words_of(data, starts, sizes)[0]):
            words[some, i] = w
        at = np.searchsorted(self.hashes, h)
        self.number = np.insert(self.number, at, len(self.hashes) + np.arange(len(h)))
        self.hashes = np.insert(self.hashes, at, h)
        self.words, self.sizes = np.concatenate([self.words, words]), np.concatenate([self.sizes, sizes])
        self.ids, self.id_ends = np.concatenate([self.ids, ids]), np.concatenate([self.id_ends, self.id_ends[-1] + np.cumsum(n)])


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder for each tokenizer file in a worker, whatever the number of its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def text_slices(batch: pa.RecordBatch):
    """(first row, end row, bytes, offsets) of about SLICE_BYTES at most, unless one text is longer."""
    data, offsets = buffers(batch.column(batch.schema.get_field_index("text")))
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def _writer(path: str):
    schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("image", pa.binary())])

    def write(batches):
        encoder = encoder_of(path)
        shard = TaskContext.get().partitionId()
        segment, before, held = 0, 0, []

        def closed():
            nonlocal segment, before, held
            flat, lengths, docs, valid = (np.concatenate(x) for x in zip(*held, strict=True))
            row = pa.RecordBatch.from_pydict({"shard": [shard], "segment": [segment], "n_docs": [len(docs)], "n_ids": [len(flat)], "image": [_rans.pack(flat.astype(np.uint32), docs, valid, lengths, before)]}, schema=schema)
            segment, before, held = segment + 1, before + len(flat), []
            return row

        gc.disable()  # millions of small objects and no cycles
        try:
            for batch in batches:
                docs, valid = longs(batch, "doc_id")
                for first, end, data, offsets in text_slices(batch):
                    held.append((*encoder.encode(data, offsets), docs[first:end], valid[first:end]))
                    if sum(len(x[0]) for x in held) >= SEGMENT_IDS:
                        yield closed()
            if held:
                yield closed()
        finally:
            gc.enable()

    return write


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Write the ids of every text, with the end id, as segments below path, one row (shard, segment, image) each.

    Shards hold ranges of doc_id in ascending order, null first, equal ones by text; a null text is empty. An image is a
    whole file in itself: see _rans.pack. A task holds one segment, or one document if that is longer. Rows that repeat
    are written as often; an empty table has no segments; other columns are ignored.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    ordered.mapInArrow(lean(_writer(tokenizer or default_tokenizer())), FILE_SCHEMA).write.mode("overwrite").parquet(path)


def _read(batches):
    for batch in batches:
        for shard, image in zip(batch.column("shard").to_pylist(), batch.column("image"), strict=True):
            segment = _rans.Segment(image.as_buffer().to_pybytes())
            raw = memoryview(segment.decode().astype("<u4").tobytes())
            ends = np.cumsum(segment.lengths)
            starts = ends - segment.lengths
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(starts), pa.int32()), pa.array(segment.doc_ids, mask=~segment.doc_valid), pa.array(starts + segment.first), pa.array(segment.lengths), pa.array(crcs, pa.int64())],
                schema=pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]),
            )


def read_tokens(spark, path: str) -> DataFrame:
    """What the files say of each document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Every block is decoded and compared with its checksum. Only the shards' totals, one row a shard, are summed in order.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = files.select("shard", "image").mapInArrow(lean(_read), READ_SCHEMA).join(base, "shard")
    return rows.select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def tokens(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs to files in the shared folder and return what read_tokens finds in them."""
    scratch = Scratch(docs.sparkSession, "tokens")
    write_tokens(docs, f"{scratch.path}/files", tokenizer)
    return read_tokens(docs.sparkSession, f"{scratch.path}/files")
