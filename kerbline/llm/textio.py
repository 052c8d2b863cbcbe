"""What the operators share: reading tables, Arrow batches to bytes, a lexicon of words, checkpoints.

Texts travel as UTF-8 bytes. ``bytes.split()`` splits at exactly x20 and x09-x0D, so its pieces are
the matches of ``[^\\x20\\x09-\\x0D]+``, and ``bytes.lower()`` lower-cases exactly A-Z.
"""

from __future__ import annotations

import ctypes
import itertools
import os
import re
import zlib
from collections.abc import Callable, Collection, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Classes of bytes as the words tokenizer cuts words: runs of letters, single digits, runs of other marks.
_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = _LETTER
_KIND[list(b"0123456789")] = _DIGIT
_KIND[0x20], _KIND[ord("'")], _KIND[0xC3] = _SPACE, _ODD, _LETTER  # xC3 leads the letters of Latin-1
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id's text mod n; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def fold_of(doc_id: int | None, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, without decoding; null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def give_back() -> None:
    """Returns memory that this worker has freed to the system, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


_LIBC = ctypes.CDLL(None) if os.name == "posix" else None


#: Most bytes and rows of an Arrow batch between the JVM and Python.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, words: bool = False) -> DataFrame:
    """``mapInArrow`` with batches of bounded bytes. The bounds are settings of the session, read when the plan runs;
    smaller ones that are set already stay. words: whether ``run`` uses a lexicon; other tasks give back the one that
    an earlier task left in their worker."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = str(conf.get(key)).rstrip("bB")
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(key, str(most))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_lexicons()
        yield from run(batches)

    return df.mapInArrow(run if words else alone, schema)


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has at most ``most`` bytes of text, or one row: what a task holds at once
    does not depend on how many rows of what length a batch has."""
    taken = 0
    for batch in batches:
        size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            taken += int(ends[end - 1] - (ends[at - 1] if at else 0))
            at = end
            if taken > 16 << 20:
                taken = 0
                give_back()
    give_back()


def spans(lengths: Iterable[int]) -> np.ndarray:
    """Offsets: 0, then the running sums."""
    out = np.fromiter(lengths, np.int64)
    return np.concatenate([[0], np.cumsum(out)])


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values within each span of the offsets (empty spans: 0)."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's shared folder if spark.checkpoint.dir names one, else one of this machine for local runs alone."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not own and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(own or f"/tmp/kerbline-checkpoints-{os.getuid()}")


def cut(df: DataFrame) -> DataFrame:
    """Computes df now and cuts its lineage at files in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Blocks of an added-up vector, groups of tasks in the first level of sums.
BLOCKS, GROUPS = 16, 256


def add_up(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], words: bool = False) -> np.ndarray | None:
    """Sum over tasks of the float64 vector that ``make`` gives for each; added up block by block. words: as of
    ``map_batches``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = make(batches)
        if v is not None:
            parts = np.array_split(v, BLOCKS)
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["block", "v"])

    def total(key: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = None
        for part in rows:
            for x in part["v"]:
                s = np.frombuffer(x) + (0 if s is None else s)
        yield pd.DataFrame({"block": [key[0]], "v": [s.tobytes()]})

    # Two levels, so that no group has a row of every task.
    parts = map_batches(df, run, "block int, v binary", words).withColumn("at", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    some = parts.groupBy("block", "at").applyInPandas(total, "block int, v binary")
    whole = some.groupBy("block").applyInPandas(total, "block int, v binary").collect()
    return np.concatenate([np.frombuffer(r["v"]) for r in sorted(whole, key=lambda r: r["block"])]) if whole else None


def heaviest(counts: DataFrame, most: int) -> DataFrame:
    """The rows of counts (column n) with the largest counts, at most ``most``: those from a class of counts on
    (classes: eighths of a power of two)."""
    kind = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    sizes = sorted(((r[0], r[1]) for r in counts.groupBy(kind.alias("kind")).count().collect() if r[0] is not None), reverse=True)
    total, least = 0, None
    for k, n in sizes:
        if total + n > most:
            break
        total, least = total + n, k
    return counts.where("false") if least is None else counts.where(kind >= least)


class Lexicon:
    """Words to token ids of a public tokenizer, learned as words come.

    The tokenizer splits at white space before it merges, so a text's ids are the ids of its words one
    after the other. ``most`` bounds the bytes that words and their ids take: past it half of the words are
    forgotten, which changes no result.
    """

    def __init__(self, path: str, most: int = 64 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.ends: np.ndarray | None = None
        self.of: dict[bytes, int] | None = None
        self.of_ids: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.reset()

    def attach(self, values: dict[bytes, int]) -> None:
        """From now on ``values`` of new words are kept in ``value`` beside their ids (0 for others)."""
        if self.of is not values:
            self.of = values
            self.reset()

    def beside(self, of: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> None:
        """From now on a number is kept beside each id: ``of(ids, counts)`` of new words. What earlier tasks of the worker
        learned stays if it is the same function of the same object."""
        if self.of_ids != of:
            self.of_ids = of
            self.reset()

    def reset(self) -> None:
        self.numbers = np.empty(1 << 16, np.float32)
        self.index: dict[bytes, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.counts = np.zeros(1 << 14, np.int32)
        self.value = np.zeros(1 << 14, np.int64)
        self.used = self.held = 0

    def forget(self) -> None:
        """Keeps the half that was learned first, which has most of the frequent words, as far as they are short."""
        n = len(self.index) // 2
        self.index = dict(itertools.islice(self.index.items(), n))
        self.used = int(self.starts[n])
        self.held = self._bytes_of(self.index, self.used)
        if self.held > self.most // 2:
            self.reset()

    @staticmethod
    def _bytes_of(words: Collection[bytes], ids: int) -> int:
        """Of words in the index (objects and places included) with so many ids in all."""
        return 150 * len(words) + sum(map(len, words)) + 4 * ids

    def add(self, words: list[bytes]) -> None:
        at = 0
        while at < len(words):
            # The library keeps some 100 bytes for each id while it encodes.
            end, size = at, 0
            while end < len(words) and end - at < 8192 and (end == at or size + len(words[end]) <= 1 << 18):
                size += len(words[end]) + 1
                end += 1
            part = words[at:end]
            at = end
            ids, counts = self._encode(part)
            n, m = len(self.index), len(part)
            if n + m > len(self.starts):
                more = max(len(self.starts) // 2, m)
                self.starts, self.counts, self.value = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.starts, self.counts, self.value))
            if self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.empty(max(len(self.ids) // 2, len(ids)), np.uint32)])
            self.ids[self.used : self.used + len(ids)] = ids
            if self.of_ids is not None:
                if len(self.numbers) < len(self.ids):
                    self.numbers = np.concatenate([self.numbers, np.empty(len(self.ids) - len(self.numbers), np.float32)])
                self.numbers[self.used : self.used + len(ids)] = self.of_ids(ids, counts)
            self.counts[n : n + m] = counts
            if self.of is not None:
                self.value[n : n + m] = np.fromiter(map(self.of.get, part, itertools.repeat(0)), np.int64, m)
            self.starts[n : n + m] = self.used + np.cumsum(counts) - counts
            self.used += len(ids)
            self.index.update(zip(part, range(n, n + m), strict=True))
            self.held += self._bytes_of(part, len(ids))

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these words and how many each has. Words of plain letters, digits and marks go to the
        tokenizer as one text, whose ids are told apart by counting word ends; others go one by one."""
        classes = np.frombuffer(b" ".join(words), np.uint8)
        kind = _KIND[classes]
        if len(kind) > 1:
            second = classes[:-1] == 0xC3
            kind[1:][second] = np.where(np.isin(classes[1:][second], (0x97, 0xB7)), _ODD, _LETTER)
        first = np.ones(len(kind), bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        at = spans(len(w) + 1 for w in words)
        at[-1] -= 1
        pieces = sums(first & (kind != _SPACE), at)
        plain = sums(kind == _ODD, at) == 0
        if self.ends is None:
            self.ends = np.zeros(1 + max(self.tokenizer.get_vocab().values()), bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        quick = [w for w, p in zip(words, plain, strict=True) if p]
        joined = np.array(self.tokenizer.encode_batch_fast([b" ".join(quick).decode()], add_special_tokens=False)[0].ids if quick else [], np.uint32)
        ends = np.flatnonzero(self.ends[joined])
        expected = np.cumsum(pieces[plain])
        if quick and (len(ends) != expected[-1] or (len(ends) and ends[-1] != len(joined) - 1)):
            plain[:], quick, joined = False, [], joined[:0]
        counts = np.zeros(len(words), np.int64)
        if quick:
            counts[plain] = np.diff(np.concatenate([[0], np.concatenate([[0], ends + 1])[expected]]))
        slow = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w, p in zip(words, plain, strict=True) if not p], add_special_tokens=False)]
        counts[~plain] = list(map(len, slow))
        ids = np.empty(int(counts.sum()), np.uint32)
        of_plain = np.repeat(plain, counts)
        ids[of_plain] = joined
        ids[~of_plain] = [i for s in slow for i in s]
        return ids, counts

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """Row of each word; rows hold until the next call."""
        if self.held > self.most:
            self.forget()
        get = self.index.get
        rows = np.fromiter(map(get, words, itertools.repeat(-1)), np.int32, len(words))
        if len(missing := np.flatnonzero(rows < 0)):
            new = [words[i] for i in missing]
            self.add(list(dict.fromkeys(new)))
            rows[missing] = np.fromiter(map(get, new), np.int32, len(new))
        return rows

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Where the ids of these rows stand, one after the other."""
        counts = self.counts[rows].astype(np.int64)
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return np.arange(total) + np.repeat(self.starts[rows] - (ends - counts), counts)

    def expand(self, rows: np.ndarray) -> np.ndarray:
        """The ids of these rows, one after the other."""
        return self.ids[self.places(rows)]


_LEXICONS: dict[str, Lexicon] = {}


def lexicon(path: str, most: int | None = None) -> Lexicon:
    """One lexicon for each file and Python worker; ``most`` sets its bound in bytes."""
    if path not in _LEXICONS:
        _LEXICONS[path] = Lexicon(path)
    if most is not None:
        _LEXICONS[path].most = most
    return _LEXICONS[path]


def drop_lexicons() -> None:
    """Forgets this worker's lexicons, as workers live on between tasks, and returns what earlier tasks have freed."""
    _LEXICONS.clear()
    give_back()


def word_lists(texts: list[bytes], most_bytes: int = 8 << 20, split_text: Callable[[bytes], list[bytes]] = bytes.split) -> Iterator[tuple[int, int, list[bytes], np.ndarray]]:
    """Groups of texts of a bounded size (at least one text each): first, end, all words, offsets of each text's words."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= most_bytes):
            size += len(texts[end])
            end += 1
        split = [split_text(t) for t in texts[at:end]]
        yield at, end, list(itertools.chain.from_iterable(split)), spans(map(len, split))
        at = end


_BREAK = re.compile(rb"[ \n]")


def parts_of(texts: list[bytes], most: int = 4 << 20) -> Iterator[tuple[list[int], list[bytes]]]:
    """The texts, in parts of at most ``most`` bytes or one word: (places of the texts, parts). Longer texts are cut at
    white space, which no word crosses."""
    rows: list[int] = []
    parts: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t) or not t:
            end = len(t)
            if end - at > most:
                end = 1 + max(t.rfind(b" ", at, at + most), t.rfind(b"\n", at, at + most))
                if end <= at:
                    found = _BREAK.search(t, at + most)
                    end = found.end() if found else len(t)
            if parts and size + end - at > most:
                yield rows, parts
                rows, parts, size = [], [], 0
            rows.append(i), parts.append(t[at:end])
            size += end - at
            at = end
            if not t:
                break
    if parts:
        yield rows, parts
