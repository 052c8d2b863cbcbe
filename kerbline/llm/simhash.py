"""Near-duplicates by SimHash with meet-in-the-middle ball hashing.

Fingerprints link at ``RADIUS`` (3) or fewer differing bits. Two that differ must differ in one of three
blocks of bits at least; with that block masked, at most two differing bits are left, so the balls of
half the radius (one bit) around both, within the unmasked bits, share a variant. Every distinct
fingerprint therefore emits, for each masked block, the masked value and all its one-bit variants: 131
rows. The rows are dealt out by variant and sorted; colliding fingerprints are verified on all 64 bits.

Nothing in a bucket is quadratic, nor capped. Members of a bucket with the same masked bits are within
two bits, so they are linked to one of them. Between different masked values, those at one bit always
link, those at two bits link if one of them met without a flip, those at three if both did; in a large
bucket the partners are looked up by flipping at most three of the masked bits, of which there are 22.

Defined cases: texts without words (null and empty ones too) have fingerprint zero and link like any
other; texts of any length are read whole; repeated rows share their fingerprint and component; rows with a null id
are fingerprinted but do not name a component; an empty table gives no rows; other columns are not read, whatever
their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textio
from ..operators.graph import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Bits of the three blocks, low to high.
BLOCKS = ((0, 21), (21, 42), (42, 64))
#: Buckets of up to so many members are compared pairwise.
SMALL = 8


def fingerprint_hashes(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Majority of bits within each span of the hashes."""
    out = np.zeros(len(at) - 1, np.uint64)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if b > a:
            ones = np.zeros(64, np.int64)
            for s in range(a, b, 65536):
                part = h[s : min(b, s + 65536)]
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
            out[i] = np.packbits(2 * ones > b - a, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(texts: list[bytes], k: int = SHINGLE) -> np.ndarray:
    digest, found, sizes = xxhash.xxh64_intdigest, [], []
    for t in texts:
        words = t.lower().split()
        n = len(words)
        if n <= k:
            found += [digest(b" ".join(words), SEED)] if n else []
            sizes.append(int(n > 0))
            continue
        joined = b" ".join(words)
        ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
        begins = [0, *(e + 1 for e in ends[: n - k])]
        found += [digest(joined[a:b], SEED) for a, b in zip(begins, ends[k - 1 :], strict=True)]
        sizes.append(n - k + 1)
    return fingerprint_hashes(np.array(found, np.uint64), textio.spans(sizes))


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textio.slices(batches, 1):
            texts, at = textio.as_bytes(batch.column(1)), 0
            out = []
            while at < len(texts):
                end, n = at, 0
                while end < len(texts) and (end == at or n + len(texts[end]) <= 4 << 20):
                    n += len(texts[end])
                    end += 1
                out.append(fingerprints(texts[at:end]))
                at = end
            fp = np.concatenate(out) if out else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return textio.map_batches(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def _block_masks() -> list[tuple[np.uint64, np.ndarray]]:
    """For each masked block: the mask of kept bits and the flips (none, then each kept bit)."""
    out = []
    for a, b in BLOCKS:
        masked = ((1 << b) - 1) ^ ((1 << a) - 1)
        kept = [1 << i for i in range(64) if not a <= i < b]
        out.append((np.uint64(~masked & (1 << 64) - 1), np.array([0, *kept], np.uint64)))
    return out


MASKS = _block_masks()


def variants(distinct: DataFrame) -> DataFrame:
    """(block, key, fp): the ball of half the radius around each fingerprint, for each masked block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for s in range(0, len(all_fp), 4096):
                fp = all_fp[s : s + 4096]
                for block, (kept, flips) in enumerate(MASKS):
                    keys = ((fp & kept)[:, None] ^ flips[None, :]).reshape(-1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block, np.int8)), pa.array(keys.view(np.int64)), pa.array(np.repeat(fp, len(flips)).view(np.int64))], ["block", "key", "fp"])

    return textio.map_batches(distinct.select("fp"), run, "block byte, key long, fp long")


def _patterns(block: int, bits: int) -> np.ndarray:
    a, b = BLOCKS[block]
    return np.array([sum(1 << i for i in c) for c in itertools.combinations(range(a, b), bits)], np.uint64)


def link_bucket(block: int, key: np.uint64, fp: np.ndarray) -> np.ndarray:
    """Edges (rows of two) of one bucket that join exactly what its members' links of at most RADIUS
    bits through this bucket join."""
    kept, _ = MASKS[block]
    if len(fp) <= 64:
        i, j = np.triu_indices(len(fp), 1)
        near = np.bitwise_count(fp[i] ^ fp[j]) <= RADIUS
        return np.stack([fp[i[near]], fp[j[near]]], 1)
    plain = (fp & kept) == key
    order = np.lexsort((~plain, fp & ~kept))
    fp, plain = fp[order], plain[order]
    x, first = np.unique(fp & ~kept, return_index=True)
    of = np.repeat(np.arange(len(x)), np.diff([*first, len(fp)]))
    rep, has_plain = fp[first], plain[first]
    out = [np.stack([fp, rep[of]], 1)[rep[of] != fp]]
    for bits in (1, 2, 3):
        rows = np.arange(len(x)) if bits < 3 else np.flatnonzero(has_plain)
        if len(rows) * 2 < len(_patterns(block, bits)):
            # Fewer values than flips: one row of distances at a time.
            for r in rows:
                others = np.flatnonzero(np.bitwise_count(x ^ x[r]) == bits)
                others = others[others > r]
                ok = others if bits == 1 else others[has_plain[others] | has_plain[r]] if bits == 2 else others[has_plain[others]]
                out.append(np.stack([np.full(len(ok), rep[r]), rep[ok]], 1))
            continue
        for flip in _patterns(block, bits):
            y = x[rows] ^ flip
            at = np.minimum(np.searchsorted(x, y), len(x) - 1)
            hit = (x[at] == y) & (x[rows] < y)
            a, b = rows[hit], at[hit]
            ok = np.ones(len(a), bool) if bits == 1 else (has_plain[a] | has_plain[b]) if bits == 2 else has_plain[b]
            out.append(np.stack([rep[a[ok]], rep[b[ok]]], 1))
    return np.concatenate(out)


def links(dealt: DataFrame) -> DataFrame:
    """Verified edges (a, b) from variant rows sorted by (block, key) within tasks."""

    def edges(block: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]))
        size = np.diff([*begin, len(key)])
        run_of = np.repeat(np.arange(len(begin)), size)
        out = []
        small = np.repeat((size > 1) & (size <= SMALL), size)
        for off in range(1, SMALL):
            i = np.flatnonzero(small[:-off] & (run_of[off:] == run_of[:-off]))
            if not len(i):
                break
            near = np.bitwise_count(fp[i] ^ fp[i + off]) <= RADIUS
            out.append(np.stack([fp[i[near]], fp[i[near] + off]], 1))
        for r in np.flatnonzero(size > SMALL):
            a = begin[r]
            out.append(link_bucket(int(block[a]), key[a], fp[a : a + size[r]]))
        e = np.concatenate(out) if out else np.zeros((0, 2), np.uint64)
        e = e.view(np.int64)
        e = np.unique(np.stack([e.min(1), e.max(1)], 1), axis=0) if len(e) else e
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e[:, 0])), pa.array(np.ascontiguousarray(e[:, 1]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # parts of the bucket that is still open

        def whole() -> list[np.ndarray]:
            return [np.concatenate(z) for z in zip(*held, strict=True)]

        for batch in batches:
            now = [batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)]
            if not len(now[0]):
                continue
            held.append(now)
            first, last = held[0], now
            if first[0][0] == last[0][-1] and first[1][0] == last[1][-1]:
                continue  # one bucket so far
            now = whole()
            done = int(np.flatnonzero((now[1] != now[1][-1]) | (now[0] != now[0][-1]))[-1]) + 1
            yield edges(*(x[:done] for x in now))
            held = [[x[done:] for x in now]]
        if held:
            yield edges(*whole())

    return textio.map_batches(dealt, run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable) and root (one for each component, where repeated ids
    give two components one id) of every row of docs (doc_id, text)."""
    table = textio.cut(fingerprint_table(docs))
    distinct = textio.cut(table.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    # Every row becomes 131, so they are dealt out over all cores first, however few partitions hold them.
    spread = distinct.repartition(max(distinct.sparkSession.sparkContext.defaultParallelism, distinct.rdd.getNumPartitions()))
    dealt = variants(spread).repartition("block", "key").sortWithinPartitions("block", "key")
    roots = components(links(dealt))
    by_fp = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = by_fp.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = by_fp.join(named, "root").select("fp", "component_id", "root")
    return table.join(by_fp, "fp")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(textio.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
