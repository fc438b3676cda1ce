"""A range variant of asymmetric numeral systems (Duda 2013) with static tables, vectorised over blocks and lanes.

A block of ids is dealt to lanes in turn, each lane a 64-bit state that gives up or takes in 32 bits at most per id.
All lanes of all blocks advance together in numpy; blocks share a frequency table and nothing else, so each one can be
decoded alone from its checkpoint: first states, place in the stream, and the CRC-32 of its ids.
"""

import zlib

import numpy as np

U = np.uint64
SCALE_BITS = 18
LOW = 1 << 31
LANES = 64
BLOCK = 1 << 14
MAGIC = b"FGRANS1\0"


def frequencies(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Whole frequencies that sum to 2**bits, at least 1 where counts aren't 0. The largest take the rounding."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.int64)
    if np.count_nonzero(counts) > 1 << bits:
        raise ValueError(f"more than 2**{bits} distinct ids in a segment")
    freq = np.where(counts > 0, np.maximum(1, counts.astype(np.int64) * (1 << bits) // total), 0)
    order = np.argsort(-freq, kind="stable")
    rest = (1 << bits) - int(freq.sum())
    if rest > 0:
        freq[order[0]] += rest
    for i in order:
        if rest >= 0:
            break
        give = min(int(freq[i]) - 1, -rest)
        freq[i] -= give
        rest += give
    return freq


def encode_blocks(slots: np.ndarray, freq: np.ndarray, block: int = BLOCK, lanes: int = LANES, bits: int = SCALE_BITS):
    """First states (blocks, lanes) and 32-bit streams by block of symbol numbers; the last block is filled with symbol 0."""
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(U)
    f = freq.astype(U)
    n_blocks = -(-len(slots) // block)
    steps = block // lanes
    if n_blocks == 1:
        steps = -(-len(slots) // lanes)
    grid = np.zeros(n_blocks * steps * lanes, np.int64)
    grid[: len(slots)] = slots
    grid = np.ascontiguousarray(grid.reshape(n_blocks, steps, lanes).transpose(1, 0, 2))
    x = np.full((n_blocks, lanes), LOW, U)
    words = np.empty((steps, n_blocks, lanes), np.uint32)
    gave = np.empty((steps, n_blocks, lanes), bool)
    for t in range(steps - 1, -1, -1):
        fs = f[grid[t]]
        full = x >= fs << U(32 + 31 - bits)
        words[t] = x
        gave[t] = full
        x >>= full.astype(U) << U(5)
        q = x // fs
        x += q * ((U(1) << U(bits)) - fs) + cum[grid[t]]
    return x, [words[:, b][gave[:, b]] for b in range(n_blocks)]


def decode_blocks(states: np.ndarray, streams: list[np.ndarray], steps: int, freq: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Symbol numbers (blocks, steps * lanes)."""
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]])
    symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
    # a slot's symbol, frequency - 1 and place among the symbol's slots, in fields of bits each
    slot = (symbol.astype(U) << U(2 * bits)) | ((freq - 1).astype(U)[symbol] << U(bits)) | (np.arange(len(symbol)) - cum[symbol]).astype(U)
    stream = np.concatenate([*streams, np.zeros(1, np.uint32)]).astype(np.uint32)
    at = np.concatenate([[0], np.cumsum([len(x) for x in streams])[:-1]]).astype(np.int64)
    x = states.astype(U).ravel()
    out = np.empty((steps, *states.shape), np.int32)
    mask = U((1 << bits) - 1)
    for t in range(steps):
        found = slot[(x & mask).astype(np.int64)]
        out[t] = (found >> U(2 * bits)).reshape(states.shape)
        x = ((found >> U(bits) & mask) + U(1)) * (x >> U(bits)) + (found & mask)
        need = x < U(LOW)
        some = np.flatnonzero(need)
        n = np.count_nonzero(need.reshape(states.shape), axis=1)
        word = stream[np.repeat(at - np.cumsum(n) + n, n) + np.arange(len(some))]
        x[some] = (x[some] << U(32)) | word
        at += n
    return out.transpose(1, 0, 2).reshape(len(states), -1)


def pack(ids: np.ndarray, doc_ids: np.ndarray, doc_valid: np.ndarray, lengths: np.ndarray, first: int) -> bytes:
    """A segment's file image: documents in order, the table, a checkpoint and checksum for each block, then streams.

    ids are the documents' ids, one after another; first is how many ids the shard has before this segment.
    """
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    slot = np.zeros(len(counts), np.int32)
    slot[symbols] = np.arange(len(symbols))
    slots, freq = slot[ids], frequencies(counts[symbols])
    states, streams = encode_blocks(slots, freq) if len(ids) else (np.zeros((0, LANES), U), [])
    crcs = [zlib.crc32(ids[i : i + BLOCK].astype("<u4").tobytes()) for i in range(0, len(ids), BLOCK)]
    head = np.array([len(doc_ids), len(ids), len(symbols), len(streams), LANES, BLOCK, SCALE_BITS, first], "<i8")
    docs = zlib.compress(b"".join([doc_ids.astype("<i8").tobytes(), doc_valid.astype("u1").tobytes(), lengths.astype("<i8").tobytes()]), 1)
    table = zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)
    checkpoints = np.array([len(x) for x in streams], "<u4").tobytes() + np.array(crcs, "<u4").tobytes() + states.astype("<u8").tobytes()
    body = b"".join([head.tobytes(), np.array([len(docs), len(table)], "<i8").tobytes(), docs, table, checkpoints, *[x.astype("<u4").tobytes() for x in streams]])
    return MAGIC + np.array([zlib.crc32(body)], "<u4").tobytes() + body


class Segment:
    """A file image of pack, its checksum verified; blocks are decoded when asked for."""

    def __init__(self, image: bytes):
        if image[:8] != MAGIC or zlib.crc32(image[12:]) != int.from_bytes(image[8:12], "little"):
            raise ValueError("not a token segment, or damaged")
        head = np.frombuffer(image, "<i8", 10, 12)
        n_docs, self.n_ids, n_symbols, self.n_blocks, self.lanes, self.block, self.bits, self.first = (int(v) for v in head[:8])
        at = 12 + 80
        docs = zlib.decompress(image[at : at + int(head[8])])
        at += int(head[8])
        table = zlib.decompress(image[at : at + int(head[9])])
        at += int(head[9])
        self.doc_ids = np.frombuffer(docs, "<i8", n_docs)
        self.doc_valid = np.frombuffer(docs, "u1", n_docs, 8 * n_docs).astype(bool)
        self.lengths = np.frombuffer(docs, "<i8", n_docs, 9 * n_docs)
        self.symbols = np.cumsum(np.frombuffer(table, "<u4", n_symbols)).astype(np.uint32)
        self.freq = np.frombuffer(table, "<u4", n_symbols, 4 * n_symbols).astype(np.int64)
        n = self.n_blocks
        self.sizes = np.frombuffer(image, "<u4", n, at).astype(np.int64)
        self.crcs = np.frombuffer(image, "<u4", n, at + 4 * n)
        self.states = np.frombuffer(image, "<u8", n * self.lanes, at + 8 * n).reshape(n, self.lanes)
        self.image, self.streams_at = image, at + 8 * n + 8 * n * self.lanes + 4 * np.concatenate([[0], np.cumsum(self.sizes)])

    def decode(self, first: int = 0, end: int | None = None) -> np.ndarray:
        """The ids of blocks first to end - 1, each compared with its checksum."""
        end = self.n_blocks if end is None else end
        if first >= end:
            return np.zeros(0, np.uint32)
        streams = [np.frombuffer(self.image, "<u4", int(self.sizes[b]), int(self.streams_at[b])) for b in range(first, end)]
        steps = self.block // self.lanes if self.n_blocks > 1 else -(-self.n_ids // self.lanes)
        ids = self.symbols[decode_blocks(self.states[first:end], streams, steps, self.freq, self.bits)]
        out = []
        for b in range(first, end):
            block = ids[b - first][: min(self.block, self.n_ids - b * self.block)]
            if zlib.crc32(block.astype("<u4").tobytes()) != int(self.crcs[b]):
                raise ValueError(f"block {b} doesn't match its checksum")
            out.append(block)
        return np.concatenate(out)
