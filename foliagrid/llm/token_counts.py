"""Token counts under a unigram model, without writing tokens.

The most probable split of each distinct pre-token is found by dynamic programming along a trie: a node's forward score
is the best over the pieces that end there, from the scores of its ancestors, so a prefix that many pre-tokens share is
scored once. The nodes where pre-tokens end keep the number of pieces on the best path. The trie is gone through by depth,
of pre-tokens of any length together, with the scores of so many depths in memory as the longest piece has bytes.
"""

import base64
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import longs, running, slices, spans

#: Distinct pre-tokens that a task remembers.
MEMO = 1 << 20
#: Scores of pieces that are looked up together, and the depths that they are of, at most.
AT_ONCE, DEPTHS = 1 << 18, 4_096
SCHEMA = "doc_id long, n_tokens long, n_pretokens long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_vocabulary(path: str) -> dict[bytes, float]:
    """Log probabilities of the pieces in a ranks file. Rank r has probability in proportion to 1 / (r + 10), Zipf's law
    for a vocabulary in order of frequency: the files have ranks and no frequencies."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    total = math.fsum(1 / (r + 10) for r in ranks.values())
    return {piece: -math.log(r + 10) - math.log(total) for piece, r in ranks.items()}


class Unigram:
    """The pieces' scores by hash of their bytes. Every single byte must be a piece."""

    def __init__(self, scores: dict[bytes, float]):
        data = np.frombuffer(b"".join(scores), np.uint8)
        sizes = np.array([len(x) for x in scores], np.int64)
        ends = np.cumsum(sizes)
        h = spans(running(data), ends - sizes, ends)
        order = np.argsort(h)
        self.hashes, self.scores = h[order], np.array(list(scores.values()))[order]
        self.sizes = np.array(sorted({int(x) for x in sizes}, reverse=True), np.int64)

    def score(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.scores[at], -np.inf)

    def counts(self, total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces on the best path of each span; of equal scores, the path with the longer last piece.

        Spans are sorted by length, so those that reach a depth are the first n. best and pieces have a row for each of the
        last depths and a column for each span; a node is computed for the first span that has it, and copied to others.
        """
        out = np.zeros(len(starts), np.int64)
        order = np.argsort(starts - ends, kind="stable")
        starts, size = starts[order], (ends - starts)[order]
        most = int(self.sizes[0])
        best, pieces = np.zeros((1, len(starts))), np.zeros((1, len(starts)), np.int64)
        depth = 0
        while (n := int(np.searchsorted(-size, -depth))):
            steps = 1 if depth < most else min(int(size[n - 1]) - depth, DEPTHS, max(1, AT_ONCE // (len(self.sizes) * n)))
            keep = min(len(best), most)
            best, pieces = (np.concatenate([v[len(v) - keep :, :n], np.zeros((steps, n), v.dtype)]) for v in (best, pieces))
            sizes = self.sizes[self.sizes <= depth + steps]
            here = starts[:n] + depth + 1 + np.arange(steps)[:, None]
            prefix = spans(total, np.broadcast_to(starts[:n], here.shape), here)
            if steps > 1:
                scores = self.score(spans(total, here[:, None, :] - sizes[:, None], np.broadcast_to(here[:, None, :], (steps, len(sizes), n))))
            for step in range(steps):
                _, node, copy = np.unique(prefix[step], return_index=True, return_inverse=True) if n > 1 else (None, np.zeros(1, np.int64), np.zeros(1, np.int64))
                if steps > 1:
                    own = scores[step][:, node]
                else:
                    last = np.broadcast_to(here[0, node], (len(sizes), len(node)))
                    own = self.score(spans(total, last - sizes[:, None], last))
                own = own + best[keep + step - sizes][:, node]
                top = own.argmax(axis=0)
                best[keep + step] = own[top, np.arange(len(node))][copy]
                pieces[keep + step] = (pieces[keep + step - sizes[top], node] + 1)[copy]
            depth += steps
            ended = np.flatnonzero(size[:n] == depth)
            out[order[ended]] = pieces[-1, ended]
        return out


def _counter(path: str):
    def count(batches):
        model = Unigram(read_vocabulary(path))
        known, known_n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            tokens, pretokens = [], []
            for _, _, t in slices(batch):
                total = running(t.data)
                row_start = np.repeat(t.offsets[:-1], t.n_words)
                spaced = (t.starts > row_start) & (t.data[np.maximum(t.starts - 1, 0)] == 32)
                starts = t.starts - spaced
                h, first, inverse = np.unique(spans(total, starts, t.ends), return_index=True, return_inverse=True)
                at = np.searchsorted(known, h)
                old = known[np.minimum(at, len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
                n = np.zeros(len(h), np.int64)
                n[old] = known_n[at[old]]
                n[~old] = model.counts(total, starts[first[~old]], t.ends[first[~old]])
                if len(known) > MEMO:
                    known, known_n = h, n
                elif not old.all():
                    known, known_n = np.concatenate([known, h[~old]]), np.concatenate([known_n, n[~old]])
                    order = np.argsort(known)
                    known, known_n = known[order], known_n[order]
                sums = np.concatenate([[0], np.cumsum(n[inverse])])
                covered = np.concatenate([[0], np.cumsum(t.ends - starts)])
                loose = np.diff(t.offsets) - (covered[t.ptr[1:]] - covered[t.ptr[:-1]])
                tokens.append(sums[t.ptr[1:]] - sums[t.ptr[:-1]] + loose)
                pretokens.append(t.n_words + loose)
            ids, valid = longs(batch, "doc_id")
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~valid), pa.array(np.concatenate([np.zeros(0, np.int64), *tokens])), pa.array(np.concatenate([np.zeros(0, np.int64), *pretokens]))], names=["doc_id", "n_tokens", "n_pretokens"])

    return count


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_pretokens.

    Pre-tokens are words (runs of bytes other than 0x20 and 0x09-0x0D) with the space 0x20 before them, if any; each
    other white-space byte is one by itself. A pre-token is scored whole, however long. A null text is empty and has none;
    rows that repeat are counted alike; an empty table gives no rows; other columns are ignored.
    """
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(_counter(vocabulary or default_vocabulary()), SCHEMA)


def brute_force(text: str | None, scores: dict[bytes, float]) -> int:
    """count_tokens for one text, pre-token by pre-token."""
    import re

    n = 0
    for word in re.findall(rb" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]", (text or "").encode()):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            top = (-math.inf, 0)
            for start in range(end):
                s = scores.get(word[start:end])
                if s is not None and best[start][0] + s > top[0]:
                    top = (best[start][0] + s, best[start][1] + 1)
            best.append(top)
        n += best[-1][1]
    return n
