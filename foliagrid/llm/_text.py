"""Words, word hashes and word n-grams of Arrow string columns, without a Python object per word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; in UTF-8 those bytes never occur inside another
character. Hashes are 64-bit and the same in every process.
"""

import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All ASCII but letters and digits: for features that shouldn't depend on punctuation.
NOT_LETTER = np.zeros(256, bool)
NOT_LETTER[:128] = [not chr(i).isalnum() for i in range(128)]

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
LENGTH_SALT = U(0xD6E8FEB86659FD93)
SHORT_SALT = U(0xA0761D6478BD642F)
SLICE_BYTES = 1 << 20
RELEASE_BYTES = 16 << 20

_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply): every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers["up"]) < n:
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            table = np.full(max(n, SLICE_BYTES), base, U)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"][:n], _powers["down"][:n]


def running(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the bytes' polynomial, from which spans() has the hash of any span."""
    total = np.zeros(len(data) + 1, U)
    np.cumsum(data.astype(U) * powers(len(data) + 1)[0][:-1], out=total[1:])
    return total


def spans(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans; equal bytes have equal hashes wherever they stand."""
    raw = (total[ends] - total[starts]) * powers(len(total))[1][starts]
    return mix(raw + (ends - starts).astype(U) * LENGTH_SALT)


GRAM_SALTS = mix(np.arange(1, 65, dtype=U)) | U(1)


class Texts:
    """The words of some rows: word w of row i has an index in ptr[i]:ptr[i + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, breaks: np.ndarray = SPACE):
        self.data = data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5)) if lower else data
        self.offsets = offsets
        n = len(data)
        inside = ~((data == 32) | (data - np.uint8(9) < 5)) if breaks is SPACE else ~breaks[data]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[offsets[:-1][offsets[:-1] < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        ends = offsets[1:][offsets[1:] > 0]
        after[ends - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.ptr = np.searchsorted(self.starts, offsets)
        self.n_words = np.diff(self.ptr)
        self._hash = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hash is None:
            self._hash = spans(running(self.data), self.starts, self.ends)
        return self._hash

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k-word windows, and where each row's begin; a row with fewer words has one of all of them."""
        h, n = self.hashes, self.n_words
        counts = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
        ptr = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(ptr[-1], U)
        full = n >= k
        if len(h) >= k:
            rolled = h[: len(h) - k + 1] * GRAM_SALTS[0]
            for j in range(1, k):
                rolled = rolled + h[j : len(h) - k + 1 + j] * GRAM_SALTS[j]
            at = np.repeat(self.ptr[:-1][full] - np.concatenate([[0], np.cumsum(counts[full])[:-1]]), counts[full]) + np.arange(counts[full].sum())
            out[np.repeat(full, counts)] = mix(rolled[at])
        for i in np.flatnonzero(~full & (n > 0)):
            some = h[self.ptr[i] : self.ptr[i + 1]]
            out[ptr[i]] = mix((some * GRAM_SALTS[: len(some)]).sum(dtype=U, keepdims=True) + np.full(1, len(some), U) * SHORT_SALT)[0]
        return out, ptr


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, name: str = "text", lower: bool = False, limit: int = SLICE_BYTES, breaks: np.ndarray = SPACE):
    """The rows of a batch as (first row, end row, Texts), each of about limit bytes at most unless one text is longer."""
    data, offsets = buffers(batch.column(batch.schema.get_field_index(name)))
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, Texts(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], lower, breaks)
        at = end


def of_strings(texts: list[str | None], lower: bool = False) -> Texts:
    return Texts(*buffers(pa.array(texts, pa.large_string())), lower)


def longs(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """An integer column as int64 (0 for null), and which rows aren't null."""
    column = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def release() -> None:
    """Give back to the system what numpy's and Arrow's allocators hold unused: a worker lives through many stages, and keeps
    the memory of its largest batch else."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(function):
    """A function of batches of texts that releases memory at the end, and before that whenever RELEASE_BYTES have come."""

    def each(batches):
        held = 0
        for batch in batches:
            held += batch.nbytes
            yield batch
            del batch
            if held >= RELEASE_BYTES:
                release()
                held = 0

    @functools.wraps(function)
    def run(batches):
        yield from function(each(batches))
        release()

    return run
