"""Byte-level BPE encoding and decoding by ranked merges in higher-order functions.

A text is cut by the pattern of the public tokenizer into pieces that are encoded separately. Python cuts the texts of a
task and numbers their distinct pieces; each is folded once when it is first met, and a last step in the same stage
writes the texts down from what earlier rows of the task gave. Nothing is shuffled, broadcast or collected; past ``HEAD``
pieces or ``KEPT`` bytes the numbering begins anew, which changes no result.

The fold (``merged_in_order``): a piece is a string with a character for each of its parts, and over the ranks of the
tokens that occur in its bytes, in ascending order, each rank's pair is replaced by its token. This is the same as
merging the adjacent pair of least rank again and again, if every token of two bytes or more comes down to two parts by
the merges that rank below it (``halves`` checks that for all tokens). Proof: let a merge of rank r be the first that is
followed by one of a lower rank s, of a token t. It made one of t's two parts, so before it t's bytes were three parts,
and no merge had crossed their ends; all merges below s inside them were done, which leaves two parts by the check, and
these would have been merged at s, before r. So ranks only rise, only the two parts of the check are ever merged to a
token, all places of a pair can be merged at once from the left, and a token that occurs nowhere in the bytes is never
made. Tables that fail the check are folded by ``merged``, which searches the least rank anew after each merge.

``merged`` carries the ranks of a piece's pairs along, so that a merge looks up two; its ranks are a literal map (in hashed
buckets, as a map look-up is linear in its size). ``decode_ids`` concatenates binary pieces from a literal array. A fold
is quadratic, so pieces above ``LONG`` bytes are merged by a heap in Python.

Where a text has no two white space characters in a row, its pieces are those of its words, each taken with the
space or line end before it, so they are kept by word; other texts go through the pattern whole.

Defined cases: null and empty texts have no ids; bytes that are not UTF-8 never occur in a Spark string; a text of any
length is encoded whole, and a piece of any length takes O(n log n); repeated rows give repeated rows; an empty table
gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import itertools
import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textio

#: Pieces and bytes of words that a task keeps, bytes above which a piece is merged by a heap, new pieces of a row,
#: buckets of the literal rank map.
HEAD, KEPT, LONG, NEW, BUCKETS = 1 << 20, 128 << 20, 512, 2000, 1 << 15
#: No rank: larger than any.
NONE = 2**31 - 1
#: The characters with the property White_Space, as \s means in the pattern.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: merges the adjacent pair of least rank, the leftmost of equals, until none has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    if len(piece) > 48:
        return _merge_long(piece, ranks)
    return [ranks[p] for p in _parts(piece, ranks)]


def _parts(piece: bytes, ranks: dict[bytes, int], below: int = NONE) -> list[bytes]:
    """What is left of a piece by the merges that rank below a rank."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get = ranks.get
    pairs = [get(parts[i] + parts[i + 1], NONE) for i in range(len(parts) - 1)]
    while pairs:
        least = min(pairs)
        if least >= below:
            break
        i = pairs.index(least)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], NONE)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], NONE)
    return parts


@functools.cache
def halves(path: str) -> dict[int, tuple[int, int]] | None:
    """The two tokens that each token of two bytes or more is merged from; None if the merges that rank below some
    token do not leave two parts of it."""
    ranks, out = load_ranks(path), {}
    for token, rank in ranks.items():
        if len(token) > 1:
            parts = _parts(token, ranks, rank)
            if len(parts) != 2:
                return None
            out[rank] = (ranks[parts[0]], ranks[parts[1]])
    return out


def char_of(rank: int) -> str:
    """The character that stands for a token in the fold, beyond Latin-1 and the surrogates."""
    return chr(rank + 0x100 if rank < 0xD700 else rank + 0x900)


class Within:
    """Finds the tokens that occur in pieces: a tree of what tokens begin with, its edges in a hash table."""

    BITS = 19

    def __init__(self, ranks: dict[bytes, int]):
        node = {bytes([i]): i for i in range(256)}
        edges, rank = [], [-1] * 256
        for token, r in ranks.items():
            for n in range(2, len(token) + 1):
                if token[:n] not in node:
                    edges.append(node[token[: n - 1]] << 8 | token[n - 1])
                    node[token[:n]] = len(rank)
                    rank.append(-1)
            if len(token) > 1:
                rank[node[token]] = r
        self.rank, bits = np.array(rank, np.int32), max(self.BITS, (4 * len(edges)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.edge, self.node = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        edge, to = np.array(edges, np.int64), np.arange(256, len(rank), dtype=np.int32)
        at = self._place(edge)
        while len(edge):
            free = self.edge[at] < 0
            self.edge[at[free]] = edge[free]
            own = self.edge[at] == edge
            self.node[at[own]] = to[own]
            edge, to, at = edge[~own], to[~own], at[~own] + 1 & self.last

    def _place(self, edge: np.ndarray) -> np.ndarray:
        return (edge.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def follow(self, edge: np.ndarray) -> np.ndarray:
        """Where edges lead, -1 where there is none."""
        at = self._place(edge)
        there = self.edge[at]
        while len(other := np.flatnonzero((there != edge) & (there >= 0))):
            at[other] = at[other] + 1 & self.last
            there[other] = self.edge[at[other]]
        return np.where(there < 0, -1, self.node[at])

    def ranks_in(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the tokens of two bytes or more that occur in each piece, ascending, and the pieces' offsets."""
        raw = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        sizes = textio.spans(map(len, pieces))
        of = np.repeat(np.arange(len(pieces)), np.diff(sizes))
        end, at, node = sizes[1:][of], np.arange(1, len(raw) + 1), raw
        found = []
        while True:
            on = np.flatnonzero(at < end)
            of, end, at, node = of[on], end[on], at[on], node[on]
            if not len(on):
                break
            node = self.follow(node << 8 | raw[at])
            on = np.flatnonzero(node >= 0)
            of, end, at, node = of[on], end[on], at[on] + 1, node[on].astype(np.int64)
            rank = self.rank[node]
            found.append((of << 32 | rank)[rank >= 0])
        each = np.sort(np.concatenate([np.zeros(0, np.int64), *found]))
        each = each[np.concatenate([[True], each[1:] != each[:-1]])[: len(each)]]
        return (each & 0xFFFFFFFF).astype(np.int32), textio.spans(np.bincount(each >> 32, minlength=len(pieces)))


@functools.cache
def _within(path: str) -> Within:
    return Within(load_ranks(path))


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap over a linked list of parts."""
    n = len(piece)
    end, nxt, prev = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    live = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and (j := nxt[i]) < n:
            r = ranks.get(piece[i : end[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not live[i] or (j := nxt[i]) >= n or end[j] != stop:
            continue
        live[j] = False
        end[i], nxt[i] = stop, nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
        offer(i)
        offer(prev[i])
    return [ranks[piece[i : end[i]]] for i in range(n) if live[i]]


class Cutter:
    """Texts to pieces, by word where that is the same."""

    def __init__(self, pattern: str):
        import regex

        self.cut = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\S", f"[^{WHITE_SPACE}]").replace(r"\s", f"[{WHITE_SPACE}]")).findall

    def words(self, text: str) -> list[str] | None:
        """The text's words, the first as it stands and others with the space or line end before them; None if its
        pieces are not those of words."""
        words, lines = text.split(), "\n" in text
        if " ".join(words) != (text.replace("\n", " ") if lines else text):  # split also cuts at x1C to x1F
            return None
        return text.replace("\n", " \n").split(" ") if lines else words

    def pieces(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """Of words after the first, all pieces, and how many each word has. A line end starts a word after it; all
        others stand after a space, so they are cut as one text, in which only a word's first piece has a space."""
        own = [w.startswith("\n") for w in words]
        spaced = [w for w, line in zip(words, own, strict=True) if not line]
        out = self.cut(" " + " ".join(spaced)) if spaced else []
        begin = np.flatnonzero(np.fromiter((p[0] == " " for p in out), bool, len(out)))
        counts = np.zeros(len(words), np.int64)
        counts[~np.array(own, bool)] = np.diff(begin, append=len(out))
        if len(spaced) == len(words):
            return out, counts
        ends = np.cumsum(counts).tolist()
        each = [self.cut(w) if line else out[end - n : end] for w, line, end, n in zip(words, own, ends, counts.tolist(), strict=True)]
        return list(itertools.chain.from_iterable(each)), np.fromiter(map(len, each), np.int64, len(each))


class Writer:
    """Texts to numbers of their pieces. Words and pieces are kept by ``known`` and ``numbers`` up to a bound."""

    def __init__(self, path: str, pattern: str, most: int, ordered: bool):
        self.ranks, self.cutter, self.most = load_ranks(path), Cutter(pattern), most
        self.within = _within(path) if ordered else None
        self.chars = [char_of(self.ranks[bytes([i])]) for i in range(256)]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.numbers: dict[str, int] = {}
        # Word k has the pieces of ``at[k]`` to ``at[k + 1]``.
        self.at, self.of_words, self.held = array("i", [0]), array("i"), 0

    def keys(self, text: str) -> list[str]:
        """Words after the first, and with a space before them pieces that stand by themselves."""
        if not text:
            return []
        words = self.cutter.words(text)
        if words is None:
            return [" " + p for p in self.cutter.cut(text)]
        words[:1] = [" " + p for p in self.cutter.cut(words[0])]
        return words

    def write(self, texts: list[str]) -> tuple[list[bytes], int, list[str]]:
        """Of each text the numbers of its pieces, the number of the first new piece, and the new pieces."""
        if self.held > KEPT or len(self.numbers) > self.most:
            self.forget()
        known, numbers = self.known, self.numbers
        first = len(numbers)
        keys = [self.keys(t) for t in texts]
        flat = list(itertools.chain.from_iterable(keys))
        rows = np.fromiter(map(known.get, flat, itertools.repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(rows < 0)
        words = list(dict.fromkeys([flat[i] for i in missing.tolist()]))
        alone = [w for w in words if w[0] == " "]
        words = [w for w in words if w[0] != " "]
        pieces, n = self.cutter.pieces(words)
        pieces += [w[1:] for w in alone]
        words += alone
        n = np.concatenate([n, np.ones(len(alone), np.int64)])
        of = np.fromiter(map(numbers.get, pieces, itertools.repeat(-1)), np.int32, len(pieces))
        unseen = np.flatnonzero(of < 0).tolist()
        new = list(dict.fromkeys([pieces[i] for i in unseen]))
        numbers.update(zip(new, range(first, first + len(new)), strict=True))
        of[unseen] = [numbers[pieces[i]] for i in unseen]
        self.at.frombytes((self.at[-1] + np.cumsum(n)).astype(np.int32).tobytes())
        self.of_words.frombytes(of.tobytes())
        known.update(zip(words, range(len(known), len(known) + len(words)), strict=True))
        self.held += 180 * len(words) + 150 * len(new) + sum(map(len, words)) + 4 * sum(map(len, new))
        rows[missing] = [known[flat[i]] for i in missing.tolist()]
        at, of_words = np.array(self.at, np.int64), np.array(self.of_words, np.int32)
        n = at[rows + 1] - at[rows]
        ends = np.concatenate([[0], np.cumsum(n)])
        pieces = of_words[np.arange(int(ends[-1])) + np.repeat(at[rows] - ends[:-1], n)]
        cuts = ends[textio.spans(map(len, keys))].tolist()
        return [pieces[a:b].tobytes() for a, b in itertools.pairwise(cuts)], first, new

    def begin(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Pieces as the fold begins them, their ranks and offsets; long ones as they end, without ranks."""
        raw = [p.encode() for p in pieces]
        short = [r if len(r) <= LONG else b"" for r in raw]
        begun = ["".join(map(self.chars.__getitem__, r)) if s else "".join(map(char_of, merge(r, self.ranks))) for r, s in zip(raw, short, strict=True)]
        if self.within is not None:
            return begun, *self.within.ranks_in(short)
        at = textio.spans(map(bool, short))
        return begun, np.zeros(int(at[-1]), np.int32), at

    def batch(self, doc_ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        """Rows of new pieces, then those of the texts."""
        numbers, first, new = self.write(texts)
        begun, ranks, of_ranks = self.begin(new)
        ahead = -(-len(new) // NEW)
        empty = np.zeros(len(texts), np.int64)
        per_row = np.concatenate([np.minimum(NEW, len(new) - NEW * np.arange(ahead)), empty])
        at = pa.array(textio.spans(per_row).astype(np.int32))
        within = pa.ListArray.from_arrays(pa.array(of_ranks.astype(np.int32)), pa.array(ranks))
        columns = [
            pa.concat_arrays([pa.nulls(ahead, pa.int64()), doc_ids.cast(pa.int64())]),
            pa.array([None] * ahead + numbers, pa.binary()),
            pa.array(np.concatenate([first + NEW * np.arange(ahead), empty])),
            pa.ListArray.from_arrays(at, pa.array(begun, pa.string())),
            pa.ListArray.from_arrays(at, within),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "numbers", "first", "pieces", "ranks"])


def encode(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False, head: int = HEAD) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; with keep_ids also ids and decoded.

    head: pieces that a task keeps."""
    ordered = halves(path) is not None

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(path, pattern, head, ordered)
        for batch in textio.slices(batches, 1, 1 << 19):
            yield writer.batch(batch.column(0), [t or "" for t in batch.column(1).to_pylist()])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        name, token = ({char_of(r): x for t, r in ranks.items() for x in [of(t, r)]}.__getitem__ for of in (lambda t, r: str(r), lambda t, r: t))
        names: list[str] = []  # ids of each piece, joined by commas
        tokens: list[bytes] = []
        counts = array("i")
        for batch in textio.slices(batches, 1):
            of_batch = np.flatnonzero(batch.column(1).is_valid().to_numpy(zero_copy_only=False))
            n, a, b, ids, decoded = [], [], [], [], []
            for numbers, first, folded in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if numbers is None:
                    if first == 0:
                        names, tokens, counts = [], [], array("i")
                    if first != len(names):
                        raise ValueError("rows of pieces out of order")
                    names += [",".join(map(name, p)) for p in folded]
                    tokens += [b"".join(map(token, p)) for p in folded]
                    counts.extend(map(len, folded))
                    continue
                each = np.frombuffer(numbers, np.int32).tolist()
                i, d = ",".join(map(names.__getitem__, each)), b"".join(map(tokens.__getitem__, each))
                n.append(sum(map(counts.__getitem__, each)))
                a.append(hashlib.sha256(i.encode()).hexdigest())
                b.append(hashlib.sha256(d).hexdigest())
                if keep_ids:
                    ids.append(i)
                    decoded.append(d)
            extra = [pa.array(ids, pa.string()), pa.array(decoded, pa.binary())] if keep_ids else []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of_batch)), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), *extra], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep_ids else [])])

    written = textio.map_batches(docs.select("doc_id", "text"), write, "doc_id long, numbers binary, first long, pieces array<string>, ranks array<array<int>>")
    folded = written.select("doc_id", "numbers", "first", (in_order("pieces", "ranks", path) if ordered else one_by_one("pieces", "ranks", path)).alias("pieces"))
    more = ", ids string, decoded binary" if keep_ids else ""
    return textio.map_batches(folded, fill, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def merged_in_order(start: Column, ranks: Column, path: str) -> Column:
    """A piece, given as characters of its parts, after the merges of these ascending ranks: the pairs of each are
    replaced by its token."""
    of = halves(path)
    last = max(load_ranks(path).values())
    pairs = F.split(F.lit(",".join("".join(map(char_of, of[r])) if r in of else "" for r in range(last + 1))), ",")
    tokens = F.split(F.lit(",".join(map(char_of, range(last + 1)))), ",")
    return F.aggregate(ranks, start, lambda s, r: F.replace(s, F.get(pairs, r), F.get(tokens, r)))


def in_order(pieces: str, ranks: str, path: str) -> Column:
    """The pieces of a row folded by ``merged_in_order``."""
    return F.zip_with(pieces, ranks, lambda s, r: merged_in_order(s, r, path))


def one_by_one(pieces: str, ranks: str, path: str) -> Column:
    """The pieces of a row folded by ``merged``; those without a rank stand as they are."""
    last = max(load_ranks(path).values())
    tokens = F.split(F.lit(",".join(map(char_of, range(last + 1)))), ",")
    of_byte = {char_of(load_ranks(path)[bytes([i])]): f"{i:02x}" for i in range(256)}
    hexes = F.from_json(F.lit(json.dumps(of_byte)), "map<string,string>")
    raw = lambda s: F.unhex(F.array_join(F.transform(F.split(s, ""), lambda c: F.try_element_at(hexes, c)), ""))
    fold = lambda s: F.array_join(F.transform(merged(raw(s), path), lambda i: F.get(tokens, i)), "")
    return F.zip_with(pieces, ranks, lambda s, r: F.when(F.size(r) == 0, s).otherwise(fold(s)))


def rank_literal(path: str, buckets: int = BUCKETS) -> Column:
    """The ranks as a literal array of small maps from hex text to rank, indexed by crc32 of that text."""
    maps: list[dict[str, int]] = [{} for _ in range(buckets)]
    for token, rank in load_ranks(path).items():
        h = token.hex()
        maps[zlib.crc32(h.encode()) % buckets][h] = rank
    return F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), "array<map<string,int>>")


def merged(piece: Column, path: str) -> Column:
    """Ids of a piece (string or binary): ranked merges as a fold of higher-order functions."""
    return _let(rank_literal(path), lambda table: _merged(piece, table))


def _let(value: Column, body) -> Column:
    """body of the value, which stands in the expression once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _merged(piece: Column, table: Column) -> Column:
    def rank(h: Column) -> Column:
        return F.coalesce(F.try_element_at(F.get(table, (F.crc32(h.cast("binary")) % BUCKETS).cast("int")), h), F.lit(NONE))

    def step(s: Column, _: Column) -> Column:
        parts, ranks = s["parts"], s["ranks"]

        def merge_at(at: Column) -> Column:
            """Merges the pair at place ``at``, the leftmost of least rank; only its neighbours' ranks change."""

            def joined(new: Column) -> Column:
                before = F.when(at > 1, F.concat(F.slice(ranks, 1, at - 2), F.array(rank(F.concat(F.get(parts, at - 2), new))))).otherwise(F.array().cast("array<int>"))
                after = F.when(at < F.size(ranks), F.concat(F.array(rank(F.concat(new, F.get(parts, at + 1)))), F.slice(ranks, at + 2, F.size(ranks)))).otherwise(F.array().cast("array<int>"))
                return F.struct(F.concat(F.slice(parts, 1, at - 1), F.array(new), F.slice(parts, at + 2, F.size(parts))).alias("parts"), F.concat(before, after).alias("ranks"))

            return _let(F.concat(F.get(parts, at - 1), F.get(parts, at)), joined)

        due = lambda least: F.when(least < NONE, merge_at(F.array_position(ranks, least).cast("int"))).otherwise(s)
        return F.when(F.size(ranks) == 0, s).otherwise(_let(F.array_min(ranks), due))

    text = F.lower(F.hex(piece.cast("binary")))
    n = F.octet_length(piece.cast("binary"))
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, 2 * i + 1, F.lit(2)))
    ranks = F.transform(F.sequence(F.lit(0), n - 2), lambda i: rank(F.substring(text, 2 * i + 1, F.lit(4))))
    folded = lambda start: F.transform(F.aggregate(F.sequence(F.lit(1), n - 1), start, step)["parts"], rank)
    # A piece that is a token is that token, whatever its merges; that of one byte always is.
    whole = lambda r: F.when(r < NONE, F.array(r)).otherwise(folded(F.struct(parts.alias("parts"), ranks.alias("ranks"))))
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(_let(rank(text), whole))


def encode_words(words: DataFrame, path: str, column: str = "word") -> DataFrame:
    """Adds ``ids`` to a table of pieces."""
    return words.withColumn("ids", merged(F.col(column), path))


def decode_ids(table: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """Adds ``decoded``: the binary pieces of the ids, concatenated."""
    ranks = load_ranks(path)
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    literal = F.split(F.lit(",".join(pieces)), ",")
    return table.withColumn("decoded", F.unhex(F.array_join(F.transform(F.col(column), lambda i: F.get(literal, i)), "")))


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(textio.table(spark, sf_dir, "documents"), textio.tokenizer_path(textio.BYTE_TOKENIZER), public_tokenizers.PATTERN)
