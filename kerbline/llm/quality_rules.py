"""Quality rules: counts of words, symbols, repeated lines and windows, and an n-gram perplexity band.

The language model is an interpolated modified Kneser-Ney model of order ``ORDER`` over the bytes of words (case
folded, with a mark before and an end after each word), one for each language. An n-gram never reaches over a word's
start, so that copies of a text, however many, do not make its words likely beyond what the words themselves are.
Spark counts the longest n-grams over all documents, and the model takes all of them; a caller may ask for a bound, and
then those of the least counts are pruned until at most so many are left, over all languages (the least count that is
kept is the smallest for which that holds). Lower orders,
discounts and back-off weights follow from the kept ones; a count of one is wholly discounted, so that a text does not
vouch for its own rare n-grams. The model is two sorted arrays of 64-bit hashes, of
n-grams with their log-probabilities and of contexts with their log back-off weights: it grows with the different n-grams.

A line end or another white space character than a space is a word of its own here, and where two spaces meet there
is an empty word, so that unusual spacing costs. The perplexity of a text is that of its words (negative
log-probability by number of words). Each language has its own
lower and upper limit: its median over all documents of that language, less or more ``width`` robust deviations,
from a histogram of fixed bins. The deviation is the median absolute one, or the mean absolute one where more than
half of a language's documents measure the same. Documents outside are rejected. Languages are told apart by their
whole names, however many there are: up to ``BANDS`` of them the limits are broadcast, beyond they are joined.

Defined cases: null and empty texts have no words, zero counts and fail the base rule, with no perplexity; null
languages form a language of their own; a text of any length is read whole, a long word in slices; a perplexity
on a limit is inside; repeated rows give repeated rows; an empty table gives no rows; columns of the input that are
not asked for are not read, and those that are keep their values, whatever their names, but must not be named as a
result column.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textio

SYMBOLS = b"#*$%&|<>"
#: Order of the model (at most 5: an n-gram's bytes and length are one number), n-grams that ``prune`` leaves where no
#: number is given, and bins of the histogram.
ORDER, GRAMS, BIN, BINS = 5, 1 << 20, 0.01, 20_000
MIN_WORDS, REPEAT_SHARE = 50, 50
#: Half-width of the perplexity band: robust deviations, and nats a word at least (one bin).
WIDTH, LEAST = 6.0, BIN
#: Languages whose limits are broadcast; bytes of words that a task counts, or keeps results of, at once.
BANDS, HELD = 10_000, 24 << 20
#: Marks before and after a word.
OPEN, CLOSE = b"\x01", b" "

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


_MIX = np.int64(-7046029254386353131)


def repeated_words(words: list[bytes], at: np.ndarray) -> np.ndarray:
    """For each text (offsets ``at`` into ``words``) how many words lie in a 3-word window that it holds
    twice or more. Windows are told apart by the numbers of their words, so exactly."""
    n = len(words)
    if n < 3:
        return np.zeros(len(at) - 1, np.int64)
    number = dict.fromkeys(words)
    number = dict(zip(number, range(len(number)), strict=True))
    h = np.fromiter(map(number.__getitem__, words), np.int64, n)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    whole = np.flatnonzero(doc[:-2] == doc[2:])
    a, b, c, d = h[:-2][whole], h[1:-1][whole], h[2:][whole], doc[whole]
    with np.errstate(over="ignore"):
        w = ((a * _MIX + b) * _MIX + c) * _MIX + d
    order = np.argsort(w)
    same = w[order][1:] == w[order][:-1]
    i, j = order[1:][same], order[:-1][same]
    if ((a[i] != a[j]) | (b[i] != b[j]) | (c[i] != c[j]) | (d[i] != d[j])).any():  # two windows of one hash
        order = np.lexsort((c, b, a, d))
        i, j = order[1:], order[:-1]
        same = (a[i] == a[j]) & (b[i] == b[j]) & (c[i] == c[j]) & (d[i] == d[j])
    twice = np.zeros(len(w), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    marked = np.zeros(n, bool)
    starts = whole[twice]
    for k in range(3):
        marked[starts + k] = True
    return textio.sums(marked, at)


def base_counts(texts: list[bytes]) -> np.ndarray:
    """Rows of (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    out = np.zeros((len(texts), 5), np.int64)
    for first, end, words, at in textio.word_lists(texts):
        out[first:end, 0] = np.diff(at)
        out[first:end, 4] = repeated_words(words, at)
        for i, t in enumerate(texts[first:end], first):
            letters = t.translate(None, textio.WHITE)
            out[i, 1] = len(letters) if letters.isascii() else len(letters.decode("utf-8", "replace"))
            out[i, 2] = len(letters) - len(letters.translate(None, SYMBOLS))
            if b"\n" in t:
                lines = [x for x in t.split(b"\n") if x and not x.isspace()]
                out[i, 3] = len(lines) - len(set(lines))
    return out


def units(text: bytes) -> list[bytes]:
    """The words that the model reads: case folded, with white space other than single spaces as words."""
    for c in (b"\n", b"\t", b"\r", b"\x0b", b"\x0c"):
        if c in text:
            text = text.replace(c, b" " + c + b" ")
    return text.lower().split(b" ") if text else []


def grams_of(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The n-gram that ends at each byte (and at the end) of each word, some words at a time: codes and the word's place.

    A code is the length above ORDER bytes. Its bytes are the last ORDER, or all since the word's open mark."""
    first = 0
    while first < len(words):
        last, size = first, 0
        while last < len(words) and (last == first or size + len(words[last]) <= 1 << 19):
            size += len(words[last]) + 2
            last += 1
        if last == first + 1 and len(words[first]) > 1 << 19:
            whole = OPEN + words[first] + CLOSE
            for s in range(1, len(whole), 1 << 19):
                back = max(0, s - ORDER)
                codes = _codes(np.frombuffer(whole[back : s + (1 << 19)], np.uint8), np.arange(back, min(len(whole), s + (1 << 19))))[s - back :]
                yield codes, np.full(len(codes), first)
        else:
            part = words[first:last]
            buf = np.frombuffer(OPEN + (CLOSE + OPEN).join(part) + CLOSE, np.uint8)
            size_of = np.fromiter(map(len, part), np.int64, len(part)) + 2
            word = np.repeat(np.arange(first, last), size_of)
            place = np.arange(len(buf)) - np.repeat(np.cumsum(size_of) - size_of, size_of)
            inner = place > 0
            yield _codes(buf, place)[inner], word[inner]
        first = last


def _codes(buf: np.ndarray, place: np.ndarray) -> np.ndarray:
    """place: of each byte in its word, the open mark being 0."""
    code = buf.astype(np.uint64)
    for k in range(1, ORDER):
        code[k:] |= np.where(place[k:] >= k, buf[:-k], 0).astype(np.uint64) << np.uint64(8 * k)
    return code | np.minimum(place + 1, ORDER).astype(np.uint64) << np.uint64(8 * ORDER)


def _length(code: np.ndarray) -> np.ndarray:
    return (code >> np.uint64(8 * ORDER)).astype(np.int64)


def _bytes(code: np.ndarray) -> np.ndarray:
    return code & np.uint64((1 << 8 * ORDER) - 1)


def _tag(n: int) -> np.uint64:
    return np.uint64(n << 8 * ORDER)


def suffix(code: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Codes of lengths n without their first byte."""
    above = np.asarray(n, np.uint64) - np.uint64(1)
    return code & (np.uint64(1) << np.uint64(8) * above) - np.uint64(1) | above << np.uint64(8 * ORDER)


def context(code: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Codes of lengths n without their last byte."""
    return _bytes(code) >> np.uint64(8) | np.asarray(n, np.uint64) - np.uint64(1) << np.uint64(8 * ORDER)


def hashed(code: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of codes in one language (an invertible mix of the code and the language's own hash)."""
    with np.errstate(over="ignore"):
        x = code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def seed_of(lang: str | None) -> int:
    return 0 if lang is None else xxhash.xxh64_intdigest(lang.encode(), 1)


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) of the longest n-grams over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str | None, Counter[bytes]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, c in counts.items():
                n = np.fromiter(c.values(), np.int64, len(c))
                for codes, word in grams_of(list(c)):
                    u, where = np.unique(codes, return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(np.bincount(where, n[word]).astype(np.int64))], ["lang", "gram", "n"])
            counts.clear()

        for batch in textio.slices(batches, 0):
            for t, lang in zip(textio.as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                c = counts.setdefault(lang, Counter())
                before, words = len(c), units(t)
                c.update(words)
                # New words by number, and all of a text that is one long word.
                held += (len(c) - before) * 100 + (len(t) if len(t) > 1000 * len(words) else 0)
            if held > HELD:
                yield from out()
                held = 0
        yield from out()

    return textio.map_batches(docs.select("text", "lang"), run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def prune(counted: DataFrame, most: int = GRAMS) -> DataFrame:
    """The n-grams of at least the smallest count for which at most ``most`` are left."""
    sizes = counted.groupBy(F.least("n", F.lit(100_000)).alias("n")).count().toPandas().sort_values("n", ascending=False)
    fits = sizes[sizes["count"].cumsum() <= most]
    least = int(fits["n"].min()) if len(fits) else 100_001
    return counted.where(F.col("n") >= least)


def _discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of each count, from how many are 1 to 4."""
    n1, n2, n3, n4 = (max(1, int((n == k).sum())) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    d = np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.05, 0.05, 0.05], [0, 0.99, 1.99, 2.99])
    return d[np.minimum(n, 3)]


def kneser_ney(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all orders with their log-probabilities, and contexts with their log back-off weights, of one language."""
    length = _length(codes)
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    code, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for k in range(ORDER, 0, -1):
        # Below the highest order a count is that of different bytes before; n-grams at a word's start have none and keep theirs.
        if k < ORDER:
            code, count = np.unique(suffix(code, k + 1), return_counts=True)
        code, count = np.concatenate([code, codes[length == k]]), np.concatenate([count, n[length == k]])
        order = np.argsort(code)
        code, count = code[order], count[order]
        levels.append((code, count))
    out_c, out_p, out_h, out_b = [], [], [], []
    below_c, below_p = np.array([_tag(0)]), np.array([1 / 256])
    for k, (code, count) in enumerate(reversed(levels), 1):
        d = _discounts(count)
        d = np.where(count == 1, 1.0, d)  # a count of one may be the text's own
        h, of = np.unique(context(code, k), return_inverse=True)
        total = np.bincount(of, count, len(h))
        left = np.bincount(of, d, len(h)) / np.maximum(total, 1)
        p = (count - d) / total[of] + left[of] * below_p[np.searchsorted(below_c, suffix(code, k))] if len(code) else np.zeros(0)
        out_c.append(code), out_p.append(np.log(p)), out_h.append(h), out_b.append(np.log(np.maximum(left, 1e-12)))
        below_c, below_p = code, p
    return np.concatenate(out_c), np.concatenate(out_p), np.concatenate(out_h), np.concatenate(out_b)


class Model:
    """Sorted hash arrays of n-grams and contexts of all languages."""

    def __init__(self, counted: pd.DataFrame):
        grams, logs, contexts, backs = [np.zeros(0, np.uint64)], [np.zeros(0)], [np.zeros(0, np.uint64)], [np.zeros(0)]
        for lang, g in counted.groupby("lang", dropna=False):
            seed = seed_of(lang if isinstance(lang, str) else None)
            c, p, h, b = kneser_ney(g["gram"].to_numpy(np.int64).view(np.uint64), g["n"].to_numpy(np.int64))
            grams.append(hashed(c, seed)), logs.append(p), contexts.append(hashed(h, seed)), backs.append(b)
        self.grams, self.logs = _sorted(np.concatenate(grams), np.concatenate(logs))
        self.contexts, self.backs = _sorted(np.concatenate(contexts), np.concatenate(backs))

    def log_probability(self, code: np.ndarray, lang: str | None) -> np.ndarray:
        """Of the last byte of each n-gram after those before it: backs off until an n-gram is found."""
        seed, out, rows = seed_of(lang), np.zeros(len(code)), np.arange(len(code))
        while len(rows):
            at, found = _find(self.grams, hashed(code, seed))
            out[rows[found]] += self.logs[at[found]]
            rows, code = rows[~found], code[~found]
            length = _length(code)
            at, found = _find(self.contexts, hashed(context(code, length), seed))
            out[rows[found]] += self.backs[at[found]]
            out[rows[length == 1]] += -np.log(256)
            more = length > 1
            rows, code = rows[more], suffix(code[more], length[more])
        return out


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], values[order].astype(np.float32)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Scorer:
    """Log-probabilities of words, with those of short words kept up to ``HELD`` bytes."""

    def __init__(self, model: Model):
        self.model, self.known, self.held = model, {}, 0

    def words(self, words: list[bytes], lang: str | None) -> np.ndarray:
        """Of each word; every different one is worked out once."""
        if self.held > HELD:
            self.known, self.held = {}, 0
        known = self.known.setdefault(lang, {})
        new = [w for w in dict.fromkeys(words) if w not in known]
        total = np.zeros(len(new))
        for codes, word in grams_of(new):
            u, where = np.unique(codes, return_inverse=True)
            total += np.bincount(word, self.model.log_probability(u, lang)[where], len(new))
        fresh = dict(zip(new, total.tolist(), strict=True))
        known.update(fresh)
        got = np.fromiter(map(known.__getitem__, words), float, len(words))
        for w in fresh:
            if len(w) > 64:
                del known[w]
            else:
                self.held += 150
        return got


def fit(docs: DataFrame, most: int | None = None) -> Model:
    """The driver gets all counted n-grams, or with ``most`` as many as ``prune`` leaves."""
    counted = count_ngrams(docs)
    return Model((counted if most is None else prune(textio.cut(counted), most)).toArrow().to_pandas())


def measure(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with the base counts, the language and the mean negative log-probability of a word (null: no words)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    n = len(keep)
    # A text that is kept is not sent twice.
    body = keep.index("text") if "text" in keep else n
    lang_at = n + (body == n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for batch in textio.slices(batches, body):
            texts, langs = textio.as_bytes(batch.column(body)), batch.column(lang_at).to_pylist()
            base = base_counts(texts)
            nll = np.full(len(texts), np.nan)
            for lang in dict.fromkeys(langs):
                rows = [i for i, x in enumerate(langs) if x == lang]
                for first, end, words, at in textio.word_lists([texts[i] for i in rows], 2 << 20, units):
                    total, size = textio.sums(scorer.words(words, lang), at), base[rows[first:end], 0]
                    nll[rows[first:end]] = np.where(size > 0, -total / np.maximum(size, 1), np.nan)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], *(pa.array(base[:, j]) for j in range(5)), batch.column(lang_at), pa.array(nll, mask=np.isnan(nll))],
                [*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_lang", "nll"],
            )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    more = [F.col("text").alias("_text")] if body == n else []
    return textio.map_batches(docs.select(*keep, *more, F.col("lang").alias("_lang")), run, f"{kinds}{', ' if keep else ''}{BASE}, _lang string, nll double")


def bands(measured: DataFrame, width: float = WIDTH, least: float = LEAST) -> DataFrame:
    """_lang, lower, upper: from a histogram of at most BINS cells for each language."""
    cell = F.least(F.floor(F.col("nll") / BIN), F.lit(BINS - 1)).cast("long")
    hist = measured.where("nll is not null").groupBy("_lang", cell.alias("x")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy("_lang")

    def middle(h: DataFrame) -> DataFrame:
        upto = F.sum("n").over(whole.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
        counted = h.withColumn("upto", upto).withColumn("all", F.sum("n").over(whole))
        return counted.withColumn("middle", F.min(F.when(F.col("upto") * 2 >= F.col("all"), F.col("x"))).over(whole))

    away = middle(hist).groupBy("_lang", "middle", F.abs(F.col("x") - F.col("middle")).alias("x")).agg(F.sum("n").alias("n"))
    typical = middle(away.withColumnRenamed("middle", "centre")).groupBy("_lang").agg(F.first("centre").alias("centre"), F.first("middle").alias("typical"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"))
    half = F.greatest(F.lit(least), width * BIN * F.when(F.col("typical") > 0, 1.4826 * F.col("typical")).otherwise(1.2533 * F.col("mean")))
    centre = (F.col("centre") + 0.5) * BIN
    return typical.select("_lang", (centre - half).alias("lower"), (centre + half).alias("upper"))


def verdict(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds base_failed and kept."""
    # The limits are few: read once, and broadcast if they are as few as BANDS.
    rows = limits.limit(BANDS + 1).toPandas()
    if len(rows) <= BANDS:
        small = measured.sparkSession.createDataFrame([(x if isinstance(x, str) else None, y, z) for x, y, z in rows.itertuples(index=False, name=None)], "_l string, lower double, upper double")
        joined = measured.join(F.broadcast(small), F.col("_lang").eqNullSafe(F.col("_l")), "left")
    else:
        joined = measured.join(limits.withColumnRenamed("_lang", "_l"), F.col("_lang").eqNullSafe(F.col("_l")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    inside = F.coalesce(F.col("nll").between(F.col("lower"), F.col("upper")), F.lit(False))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & inside).drop("_l", "_lang", "lower", "upper")


def judge(docs: DataFrame, keep: list[str], width: float = WIDTH, least: float = LEAST) -> DataFrame:
    """Columns ``keep`` (of docs, which has text and lang), the base counts, nll, base_failed and kept."""
    measured = textio.cut(measure(docs, fit(docs), keep))
    return verdict(measured, bands(measured, width, least))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = textio.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "nll")


#: Base rules alone, for tests on small tables; the band has no SQL form.
BASE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n >= 2),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)
"""
