"""Packing documents into training windows by best-fit decreasing.

A block of documents is cut and packed inside one scan task, so there is no shuffle and no key that
could be hot. Documents longer than a window are first cut into full windows; the rest goes, longest
first, to the tightest open window, found by a segment tree indexed by remaining capacity. At the end
of a block the windows that stayed loosely filled are strung together and cut anew, and what is left
over after that becomes sequences whose lengths are powers of two, which need no padding.

Defined cases: a null or empty text is a document of the end token alone; a text of any length is encoded whole, a
few megabytes at a time; repeated rows and repeated ids are documents of their own, null ids too; ties in length go in
order of arrival; an empty table gives no rows; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import textio

#: Bytes of words and their ids that a task keeps: where packing runs by itself, and where it follows other stages,
#: whose memory the executors still hold. Results are the same.
LEXICON, LEXICON_BESIDE = 224 << 20, 80 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Open windows by remaining capacity; finds the smallest capacity of at least c in O(log size)."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def _bump(self, at: int, by: int) -> None:
        at += self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def push(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        self._bump(capacity, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out and returns (capacity, window), or None."""
        count, at = self.count, need + self.leaves
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at *= 2
                at += not count[at]
        capacity = at - self.leaves
        window = self.windows[capacity].pop()
        self._bump(capacity, -1)
        return capacity, window


def plan(lengths: list[int], window: int, loose: float = 0.98) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length). Each token of each document is in exactly one piece."""
    full: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths):
        whole = n - n % window
        full += [[(d, s, window)] for s in range(0, whole, window)]
        if n > whole:
            rest.append((d, whole, n - whole))
    rest.sort(key=lambda p: -p[2])
    tree = CapacityTree(window)
    open_: list[list[tuple[int, int, int]]] = []
    left: list[int] = []
    for piece in rest:
        found = tree.tightest(piece[2])
        if found is None:
            open_.append([piece])
            left.append(window - piece[2])
            at = len(open_) - 1
        else:
            at = found[1]
            open_[at].append(piece)
            left[at] -= piece[2]
        if left[at]:
            tree.push(left[at], at)
    spare: list[tuple[int, int, int]] = []
    for pieces, gap in zip(open_, left, strict=True):
        used = window - gap
        if gap and used < loose * window and used & (used - 1):
            spare += pieces
        else:
            full.append(pieces)
    total = sum(p[2] for p in spare)
    sizes = [window] * (total // window) + [1 << b for b in reversed(range(window.bit_length())) if total % window >> b & 1]
    spare.reverse()
    for size in sizes:
        sequence = []
        while size:
            d, s, n = spare.pop()
            take = min(n, size)
            sequence.append((d, s, take))
            size -= take
            if take < n:
                spare.append((d, s + take, n - take))
        full.append(sequence)
    return full


def pack(docs: DataFrame, encode: Callable[[], Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]], window: int = 4096, block_tokens: int = 1 << 22) -> DataFrame:
    """Pieces of all documents (columns doc_id and text).

    ``encode()`` is called once a task and gives a function from texts to (ids, offsets of each text's
    ids). A block ends at ``block_tokens``, which bounds a task's memory whatever the partition's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, first = encode(), TaskContext.get().partitionId() << 33
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first, held, size
            doc_ids = [d for h in held for d in h[0]]
            ids = np.concatenate([h[1] for h in held])
            lengths = np.concatenate([np.diff(h[2]) for h in held])
            held, size = [], 0
            begin = textio.spans(lengths)
            rows: list[list] = [[] for _ in range(7)]
            for sequence in plan(lengths.tolist(), window):
                offset = 0
                for d, s, n in sequence:
                    a = int(begin[d]) + s
                    for column, value in zip(rows, (doc_ids[d], s, n, zlib.crc32(ids[a : a + n].tobytes()), int(lengths[d]), first, offset), strict=True):
                        column.append(value)
                    offset += n
                first += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in textio.slices(batches, 1):
            doc_ids, texts = batch.column(0).to_pylist(), textio.as_bytes(batch.column(1))
            at = 0
            while at < len(texts):
                end, n = at, 0
                while end < len(texts) and (end == at or n + len(texts[end]) <= 8 << 20):
                    n += len(texts[end])
                    end += 1
                ids, offsets = to_ids(texts[at:end])
                held.append((doc_ids[at:end], ids, offsets))
                size += len(ids)
                at = end
                if size >= block_tokens:
                    yield from flush()
        if held:
            yield from flush()

    return textio.map_batches(docs.select("doc_id", "text"), run, SCHEMA, words=True)


def word_encoder(path: str, end_id: int = 2, most: int = LEXICON) -> Callable[[], Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]]:
    """Ids of a words tokenizer, then the end id, for each text."""

    def make():
        words = textio.lexicon(path, most)

        def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            sizes, ids, of = np.ones(len(texts), np.int64), [], []
            for rows, parts in textio.parts_of(texts):
                split = [t.split() for t in parts]
                found = words.look_up([w for s in split for w in s])
                of.append((rows, textio.sums(words.counts[found], textio.spans(map(len, split)))))
                ids.append(words.expand(found))
                np.add.at(sizes, of[-1][0], of[-1][1])
            offsets = textio.spans(sizes)
            out = np.full(int(offsets[-1]), end_id, "<u4")
            mask = np.ones(len(out), bool)
            mask[offsets[1:] - 1] = False
            out[mask] = np.concatenate(ids) if ids else []
            return out, offsets

        return encode

    return make


def op5_pack(spark, sf_dir: str) -> DataFrame:
    docs = textio.table(spark, sf_dir, "documents")
    return pack(docs, word_encoder(textio.tokenizer_path(textio.WORD_TOKENIZER)))
