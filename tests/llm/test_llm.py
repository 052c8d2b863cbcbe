"""Operators against brute force, the public libraries, round trips and held-out accuracy, and the defined edge cases."""

from __future__ import annotations

import hashlib
import json
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kerbline.operators.graph import components
from kerbline.llm import ann_graph, attention, byte_bpe, html_extract, lm_scoring, packing, pu_quality, quality_rules, queries, simhash, textio, token_counts, tool_chat

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCS)


ODD = [
    (1, None, "en"), (2, "", None), (3, " \n\t ", "en"), (4, "one", "de"), (5, "a b", "en"), (6, "Same text here, twice.", "en"), (6, "Same text here, twice.", "en"),
    (None, "no id at all but words", "en"), (None, None, None), (7, "x" * 5000, "en"), (8, "wörter ß Ünïcode 中文 🙂 a b", "de"), (9, "it's we'll <|endoftext|> don't 12 345", "en"),
    (10, "word " * 30000, "en"), (11, "l\n" * 50, "fr"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with columns that clash with what operators add."""
    extra = {c: F.lit("clash") for c in ("score", "n_tokens", "bucket", "fp", "key", "rest", "kind", "body", "cluster", "nll", "kept")}
    return docs(spark, ODD).repartition(3).withColumns(extra)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(textio.tokenizer_path(textio.WORD_TOKENIZER))


def word_path():
    return textio.tokenizer_path(textio.WORD_TOKENIZER)


def test_lexicon_gives_the_librarys_ids(tokenizer):
    r = random.Random(0)
    parts = ["the", "Straße", "don't", "'s", "a", "9", "12", ",", "...", "é", "é", "×", "÷", "中", "<|endoftext|>", "<|", "İ", " x", "ﬁ"]
    lex = textio.Lexicon(word_path(), most=9_000)
    for _ in range(40):
        words = ["".join(r.choice(parts) for _ in range(r.randint(1, 4))).encode() for _ in range(30)]
        rows = lex.look_up(words)
        assert lex.expand(rows).tolist() == [i for w in words for i in tokenizer.encode(w.decode(), add_special_tokens=False).ids]


def test_token_counts(spark, odd, tokenizer):
    for chunk in (100, 1 << 14):
        got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(odd, word_path(), chunk).collect()), key=str)
        assert got == sorted(((i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in ODD), key=str)
    assert token_counts.token_counts(odd.where("false"), word_path()).count() == 0


def test_transducer_against_the_library(tokenizer):
    r = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyzABCXYZ0123456789 .,;:!?-'\"()[]{}<>|/\\@#$%^&*_+=~`\n\t éèÀÉßüÿ×÷ñÑŸ中文🙂\u0301\x0b\x1c\x85\xa0\x00\x7f"
    texts = ["".join(r.choice(letters if i % 3 else "abthein st're") for _ in range(r.choice([0, 1, 2, 3, 5, 10, 40, 200]))) for i in range(2000)]
    texts += ["", "<|endoftext|>", "a<|endoftext|>b c", "it's we'll don't", "x" * 5000, "ab" * 4000, "1" * 300, "!" * 3000, "é" * 2000 + " " + "ÀÉ" * 999, "thequickbrown" * 900]
    want = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    machine = token_counts.Transducer(word_path(), most=2000)  # begun anew again and again
    for chunk in (1, 7, 1024):
        got = [n for at in range(0, len(texts), 100) for n in machine.counts([t.encode() for t in texts[at : at + 100]], chunk).tolist()]
        assert got == want
    # State maps compose by number, in any grouping, and hold no bytes.
    maps = [{0: (1, 2), 1: (5, 1)}, {1: (4, 3), 5: (4, 2)}, {4: (0, 1)}]
    left = token_counts.compose(token_counts.compose(maps[0], maps[1]), maps[2])
    assert left == token_counts.compose(maps[0], token_counts.compose(maps[1], maps[2])) == token_counts.scan(maps)[-1] == {0: (0, 6), 1: (0, 4)}


def test_long_texts_without_spaces_need_little_memory(spark, tokenizer):
    import tracemalloc

    machine = token_counts.Transducer(word_path())
    machine.counts([b"thequickbrownfox" * 1000])
    peak = []
    for mb in (1, 4):
        text = b"thequickbrownfox" * (mb << 16)
        tracemalloc.start()
        assert machine.counts([text]).tolist() == [mb << 18]
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peak[1] < 4.5 * peak[0] and peak[0] < 200 << 20


def test_parts_of_long_texts():
    texts = [b"", b"a b " * 100, b"x" * 500, b"ab cd"]
    parts = list(textio.parts_of(texts, 50))
    assert [b"".join(p for rows, ps in parts for i, p in zip(rows, ps, strict=True) if i == k) for k in range(4)] == texts
    assert all(sum(map(len, ps)) <= 50 or len(ps) == 1 for _, ps in parts) and {i for rows, _ in parts for i in rows} == {0, 1, 2, 3}


def test_texts_without_spaces_and_a_long_one_are_packed(spark, tokenizer):
    """Words as long as sentences count by their bytes, and a text of 20 MB is cut into whole windows."""
    lex = textio.Lexicon(word_path(), most=1 << 20)
    r = random.Random(1)
    for _ in range(30):
        words = ["".join(r.choice("的一是不了人我在有他这中大来上国") for _ in range(400)).encode() for _ in range(50)]
        rows = lex.look_up(words)
        assert lex.held <= (1 << 20) + 50 * 20_000 and len(rows) == 50
    assert lex.expand(rows[:2]).tolist() == [i for w in words[:2] for i in tokenizer.encode(w.decode(), add_special_tokens=False).ids]
    long = "the of and " * (20 << 20 >> 3)
    got = packing.pack(docs(spark, [(1, long, "en")]).select("doc_id", "text"), packing.word_encoder(word_path())).toPandas()
    assert got.length.sum() == 3 * (20 << 20 >> 3) + 1 and (got.length == 4096).sum() >= len(got) - 13


def test_packing(spark, odd, tokenizer):
    got = packing.pack(odd, packing.word_encoder(word_path()), window=64, block_tokens=2000).toPandas()
    ids = Counter()
    for i, t, _ in ODD:
        ids[(i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]))] += 1
    total = sum(len(k[1]) * n for k, n in ids.items())
    assert got.length.sum() == total
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 64
    known = {(i, len(k)): k for (i, k) in ids}
    for r in got.itertuples():
        k = known[(None if r.doc_id != r.doc_id else int(r.doc_id), r.doc_tokens)]
        assert zlib.crc32(np.array(k[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    assert packing.pack(odd.where("false"), packing.word_encoder(word_path())).count() == 0


def test_best_fit_takes_the_tightest_window():
    tree = packing.CapacityTree(100)
    for capacity, w in ((50, 0), (20, 1), (30, 2), (100, 3)):
        tree.push(capacity, w)
    assert [tree.tightest(n) for n in (21, 21, 60, 20, 1)] == [(30, 2), (50, 0), (100, 3), (20, 1), None]
    r = random.Random(1)
    lengths = [r.randint(1, 9000) for _ in range(400)]
    plan = packing.plan(lengths, 4096)
    covered = sorted(p for s in plan for p in s)
    for d, n in enumerate(lengths):
        mine = [(s, m) for e, s, m in covered if e == d]
        assert [s for s, _ in mine] == [sum(m for _, m in mine[:k]) for k in range(len(mine))] and sum(m for _, m in mine) == n
    sizes = [sum(p[2] for p in s) for s in plan]
    pad = sum(4096 - n for n in sizes if n & (n - 1))
    assert max(sizes) <= 4096 and pad < 0.02 * sum(sizes)


def test_byte_bpe(spark, odd):
    import public_tokenizers
    import tiktoken

    path = textio.tokenizer_path(textio.BYTE_TOKENIZER)
    ranks = byte_bpe.load_ranks(path)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.encode(odd, path, public_tokenizers.PATTERN).collect())
    want = Counter()
    for i, t, _ in ODD:
        ids = lib.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert got == want
    # Texts of odd spacing, with a head so small that most pieces are folded in their rows, and with one that holds all.
    r = random.Random(3)
    alphabet = [*"ab e's 12\n\t\r é中!?.,", " the", "　", "\x85", "\x1c", "  ", "\n\n"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 25))) for _ in range(1500)] + ["#1 a,#0 b " + "q#2" * 5, "z" * 3000 + " " + "é" * 400]
    for head in (3, 100_000):
        rows = byte_bpe.encode(docs(spark, [(k, t, "en") for k, t in enumerate(texts)]), path, public_tokenizers.PATTERN, keep_ids=True, head=head).collect()
        assert len(rows) == len(texts) and byte_bpe.encode(odd.where("false"), path, public_tokenizers.PATTERN, head=head).count() == 0
        for row in rows:
            t = texts[row.doc_id]
            assert row.ids == ",".join(map(str, lib.encode_ordinary(t))) and bytes(row.decoded) == t.encode()
    words = [" hello", "x", "", "zzzzqqq", " Straße", "!!!", "中文"]
    table = byte_bpe.decode_ids(byte_bpe.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), path), path)
    for row in table.collect():
        assert list(row.ids) == (byte_bpe.merge(row.word.encode(), ranks) if row.word else []) and bytes(row.decoded) == row.word.encode()


def test_byte_bpe_folds_each_piece_once_a_task_in_the_order_of_ranks(spark, tmp_path):
    """Nothing is shuffled, broadcast or collected; tables whose ranks are not in order of their merges are folded by search."""
    import base64

    import public_tokenizers
    import tiktoken

    path = textio.tokenizer_path(textio.BYTE_TOKENIZER)
    ranks = byte_bpe.load_ranks(path)
    assert set(byte_bpe.halves(path)) == {r for t, r in ranks.items() if len(t) > 1}
    texts = ["ofblethst ertionenou,\nofblethst  éaiierré 中文中文\x1ca " * 3, "", " ", "a\nb c.d", "x" * 700 + " y"]
    rows = docs(spark, [(k, t, "en") for k, t in enumerate(texts)]).coalesce(1)
    got = byte_bpe.encode(rows, path, public_tokenizers.PATTERN, keep_ids=True)
    plan = got._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Broadcast" not in plan
    pieces = [" ofblethst", "aaaaa", "中文", "q", "ertionenou" * 20]
    flat, at = byte_bpe.Within(ranks).ranks_in([p.encode() for p in pieces])
    for p, a, b in zip(pieces, at[:-1], at[1:], strict=True):
        raw = p.encode()
        assert flat[a:b].tolist() == sorted({ranks[raw[i:j]] for i in range(len(raw)) for j in range(i + 2, len(raw) + 1) if raw[i:j] in ranks})
    # Here "abcd" is a token that no merges reach, and "ab" ranks below the "b" and "c" that could take its place.
    own = tmp_path / "own.tiktoken"
    tokens = [*(bytes([i]) for i in range(256)), b"abcd", b"bc", b"ab", b"bca", b"aa", b"yy"]
    own.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for r, t in enumerate(tokens)))
    assert byte_bpe.halves(str(own)) is None
    r = random.Random(2)
    more = ["abcd", "yy", *("".join(r.choice("abcdy ") for _ in range(r.randint(0, 30))) for _ in range(200)), "y" * 600]
    for table, some in ((path, texts), (str(own), more)):
        lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(table), special_tokens={})
        for head in (1, 1 << 20):
            found = byte_bpe.encode(docs(spark, [(k, t, "en") for k, t in enumerate(some)]), table, public_tokenizers.PATTERN, keep_ids=True, head=head).collect()
            assert {x.doc_id: (x.ids, bytes(x.decoded)) for x in found} == {k: (",".join(map(str, lib.encode_ordinary(t))), t.encode()) for k, t in enumerate(some)}


def test_simhash_against_brute_force(spark, odd):
    import xxhash

    def fingerprint(t):
        w = (t or "").encode().lower().split()
        grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    base = pd.read_parquet(f"{DATA}/documents.parquet")
    rows = [(int(i), t, "en") for i, t in zip(base.doc_id, base.text)]
    r = random.Random(5)
    for i, t, _ in rows[:40]:
        w = t.split()
        w[r.randrange(len(w))] = "changed"
        rows.append((10_000 + i, " ".join(w), "en"))
    rows += [(20_000 + k, t, x) for k, (_, t, x) in enumerate(ODD)]
    got = {x.doc_id: (x.fp, x.component_id) for x in simhash.near_duplicates(docs(spark, rows).repartition(5)).collect()}
    fp = {i: fingerprint(t) for i, t, _ in rows}
    assert all(np.uint64(fp[i]).view(np.int64) == got[i][0] for i in fp)
    ids = sorted(fp)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {i: got[i][1] for i in ids} == {i: find(i) for i in ids}
    assert simhash.near_duplicates(odd.where("false")).count() == 0
    assert simhash.near_duplicates(odd).count() == len(ODD)


def test_large_buckets_link_exactly():
    r = np.random.default_rng(1)
    kept, _ = simhash.MASKS[1]
    key = np.uint64(r.integers(0, 1 << 63)) & kept
    low, high = simhash.BLOCKS[1]
    x = np.unique(r.integers(0, 1 << 9, 300)).astype(np.uint64) << np.uint64(low + 3)
    fp = key | x
    for k in range(0, len(fp), 3):
        fp[k] ^= np.uint64(1) << np.uint64(int(r.choice([*range(low), *range(high, 64)])))
    fp = np.unique(fp)
    assert len(fp) > 64

    def parts(edges):
        root = {int(f): int(f) for f in fp}
        find = lambda a: a if root[a] == a else find(root[a])
        for a, b in edges:
            a, b = find(int(a)), find(int(b))
            root[max(a, b)] = min(a, b)
        return {f: find(f) for f in root}

    edges = simhash.link_bucket(1, key, fp)
    assert all((int(a) ^ int(b)).bit_count() <= 3 for a, b in edges)
    i, j = np.triu_indices(len(fp), 1)
    close = np.bitwise_count(fp[i] ^ fp[j]) <= 3
    assert parts(edges) == parts(zip(fp[i[close]], fp[j[close]]))


def test_components_of_a_hub(spark):
    e = spark.createDataFrame([(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(50)], "a long, b long").repartition(6)
    got = {r.node: r.root for r in components(e).collect()}
    assert len(got) == 2999 + 50 and set(got.values()) == {0, 5000}


def test_quality_rules(spark, odd):
    con = duckdb.connect()
    table = pd.read_parquet(f"{DATA}/documents.parquet")
    odd_rows = pd.DataFrame([(100_000 + k, t, x, "s", 0) for k, (_, t, x) in enumerate(ODD)], columns=table.columns)
    documents = pd.concat([table, odd_rows], ignore_index=True)  # noqa: F841
    con.register("documents", documents)
    want = con.execute(quality_rules.BASE_SQL).df().set_index("doc_id")
    df = docs(spark, [(int(r.doc_id), r.text if isinstance(r.text, str) else None, r.lang if isinstance(r.lang, str) else None) for r in documents.itertuples()])
    got = quality_rules.judge(df, ["doc_id"]).toPandas().set_index("doc_id")
    for c in want.columns:
        assert (got[c].sort_index() == want[c].sort_index()).all(), c
    failed = (got.n_words < 50) | (100 * got.n_repeat_words > 50 * got.n_words)
    assert (got.base_failed == failed).all() and not (got.kept & failed).any() and got.kept.mean() > 0.6
    noise = random.Random(2)
    junk = [(9_999, " ".join("".join(chr(noise.randrange(33, 127)) for _ in range(9)) for _ in range(300)), "en")]
    again = quality_rules.judge(df.unionByName(docs(spark, junk)), ["doc_id"]).where("doc_id = 9999").first()
    assert not again.base_failed and not again.kept
    assert quality_rules.judge(odd.where("false"), ["doc_id"]).count() == 0 and quality_rules.judge(odd, ["doc_id"]).count() == len(ODD)


def test_perplexity_band_rejects_junk_that_passes_the_base_rules(spark):
    d = textio.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    good = textio.table(spark, "/root/testdata/sf0.01", "labels").where("quality = 1").select("doc_id")
    clean = d.join(good, "doc_id").where("lang = 'en' AND size(split(text, ' ')) BETWEEN 300 AND 900").orderBy("doc_id").limit(8).toPandas()
    r = random.Random(4)
    rows = []
    for k, t in enumerate(clean.text):
        words = t.split()[:300]
        torn = ["".join(r.sample(w, len(w))) if i % 4 == 0 else w for i, w in enumerate(words)]
        rows += [(10_000 + k, "   ".join(words), "en"), (20_000 + k, " ".join(torn), "en")]
    got = quality_rules.judge(d.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string")), ["doc_id"]).toPandas().set_index("doc_id")
    assert len(rows) == 16 and not got.loc[[i for i, _, _ in rows]].base_failed.any() and not got.loc[[i for i, _, _ in rows]].kept.any()
    assert got.loc[clean.doc_id].kept.all()
    # Small and even languages: two texts, and copies with one outlier.
    cells = [("1", 1.5), ("1", 1.9), *[("2", 1.5)] * 99, ("2", 3.0), (None, 1.5)]
    limits = quality_rules.bands(spark.createDataFrame(cells, "_lang string, nll double")).toPandas().set_index("_lang")
    inside = [limits.lower[k] <= v <= limits.upper[k] for k, v in cells]
    assert inside == [True] * 101 + [False, True]


def test_band_rejects_a_stated_share_of_labelled_texts(spark):
    """Of texts that pass the base rules the band rejects a good part of those of quality 0 and hardly any other."""
    d = "/root/testdata/sf0.1"
    label = spark.read.parquet(f"{d}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    got = quality_rules.op7_quality_rules(spark, d).join(label, "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg((~F.col("kept")).cast("double")).alias("share")).collect()
    share = {r.quality: r.share for r in got}
    assert share[0] > 0.4 and share[1] < 0.005


def test_bands_join_where_languages_are_many(spark, monkeypatch):
    d = docs(spark, [(i, f"some words of text number {i} " * 12, f"l{i % 7}" if i % 7 else None) for i in range(60)])
    few = sorted(map(str, quality_rules.judge(d, ["doc_id"]).collect()))
    monkeypatch.setattr(quality_rules, "BANDS", 2)
    assert sorted(map(str, quality_rules.judge(d, ["doc_id"]).collect())) == few


def test_kneser_ney_sums_to_one():
    words = [b"the", b"cat", b"sat", b"on", b"the", b"mat", b"rat", b"ran", b"", b"\xc3\xa9t\xc3\xa9", b"x" * 40]
    codes, n = np.unique(np.concatenate([c for c, _ in quality_rules.grams_of(words)]), return_counts=True)
    model = quality_rules.Model(pd.DataFrame({"lang": ["en"] * len(codes), "gram": codes.view(np.int64), "n": n}))
    order = quality_rules.ORDER
    for before in (b"\x01", b"\x01t", b"\x01th", b"\x01the", b"the ", b"zzzz", b"\x01q"):
        code = np.array([int.from_bytes(before + bytes([x]), "big") | (len(before) + 1) << 8 * order for x in range(256)], np.uint64)
        assert abs(np.exp(model.log_probability(code, "en")).sum() - 1) < 1e-4, before
    assert np.allclose(model.log_probability(codes, "de"), -np.log(256)) and (np.diff(model.grams.astype(object)) > 0).all()
    # Long words are read in slices: the same n-grams.
    long = bytes(random.Random(1).choices(b"abc", k=1_200_000))
    whole = b"\x01" + long + b" "
    got = np.concatenate([c for c, _ in quality_rules.grams_of([b"a", long, b"b"])])
    assert len(got) == len(long) + 1 + 4
    for i in (1, 2, 3, 4, 5, 524_288, 524_289, 524_290, 1_048_576, 1_048_577, len(whole) - 1):
        gram = whole[max(0, i - order + 1) : i + 1]
        assert int(got[2 + i - 1]) == int.from_bytes(gram, "big") | len(gram) << 8 * order


def test_pruned_model_keeps_its_bound(spark):
    counted = spark.createDataFrame([(lang, g, g % 4 + 1) for lang in ("a", None) for g in range(40)], "lang string, gram long, n long")
    assert quality_rules.prune(counted, 45).count() == 40 and quality_rules.prune(counted, 45).agg(F.min("n")).first()[0] == 3
    assert quality_rules.prune(counted, 5).count() == 0 and quality_rules.prune(counted, 80).count() == 80


def test_quality_classifier(spark, odd):
    d, l = textio.table(spark, "/root/testdata/sf0.01", "documents"), textio.table(spark, "/root/testdata/sf0.01", "labels")
    got = pu_quality.score(d, pu_quality.train(d, l), ["doc_id"]).join(l, "doc_id").where(textio.fold("doc_id", 3) == 1).toPandas()
    assert ((got.score >= 0.5) == (got.quality == 1)).mean() > 0.9 and got.score.between(0, 1).all()
    # Labels of the held-out fold do not matter.
    flipped = l.withColumn("quality", F.when(textio.fold("doc_id", 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (pu_quality.train(d, x)["w"] for x in (l, flipped))
    assert np.allclose(a, b)
    none = pu_quality.train(odd, l.where("false"))
    scores = pu_quality.score(odd, none, ["doc_id"])
    assert {r.score for r in scores.collect()} == {0.5} and pu_quality.score(odd.where("false"), none, ["doc_id"]).count() == 0
    assert textio.fold_of(None, 3) == 0


def test_prior_estimate():
    r = np.random.default_rng(0)
    p, n = r.normal(1.5, 1, (3000, 1)), r.normal(-1.5, 1, (3000, 1))
    one = lambda x: np.concatenate([x, np.ones((len(x), 1))], 1)
    for share in (0.3, 0.8):
        u = np.concatenate([r.normal(1.5, 1, (int(3000 * share), 1)), n[: int(3000 * (1 - share))]])
        assert abs(pu_quality.estimate_prior(one(p), one(u)) - share) < 0.12


def test_language_model(spark, odd):
    d = textio.table(spark, DATA, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = lm_scoring.score(d, word_path()).toPandas()
    assert len(got) == d.count() and np.isfinite(got.score).all() and (got.score < 0).all()
    rows = [(r.doc_id, r.text) for r in d.collect()]
    c = Counter()
    for i, t in rows:
        if textio.fold_of(i, 7) != 2:
            c.update((t or "").encode().lower().split())
            c[b""] += 1
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), b""]
        want[(i, textio.fold_of(i, 7) == 2, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4))] += 1
    assert Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got.itertuples()) == want
    empty = lm_scoring.score(d.where("false"), word_path())
    assert empty.count() == 0
    nothing = lm_scoring.score(spark.createDataFrame([(5, None), (5, "")], "doc_id long, text string").where(textio.fold("doc_id", 7) == 2), word_path())
    assert nothing.columns == got.columns.tolist()


def test_language_model_reads_all_training_text(spark, odd, tokenizer):
    d = textio.table(spark, DATA, "documents").select("text").unionByName(odd.select("text"))
    spans = lm_scoring.text_spans(d, word_path())
    ids, pairs, targets = Counter(), Counter(), 0
    for t in d.toPandas().text:
        of = [lm_scoring.BEGIN, *tokenizer.encode(" ".join(w.decode() for w in (t or "").encode().lower().split()), add_special_tokens=False).ids, lm_scoring.END]
        ids.update(of[1:])
        pairs.update(zip(of[:-1], of[1:], strict=True))
        targets += len(of) - 1
    counted = lm_scoring.count_words(d, F.lit(True)).select("word", F.col("in_train").alias("n"))
    got = lm_scoring.subword_counts(counted, word_path())
    assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == dict(ids)
    batches = spans.toArrow().combine_chunks().to_batches(max_chunksize=70)
    assert sum((Counter(zip(*(x.tolist() for x in lm_scoring._pairs(*lm_scoring._flat(b))), strict=True)) for b in batches), Counter()) == pairs
    # Every target is trained on once over the rounds; a task with few windows takes all in each.
    row = np.arange(lm_scoring.VOCABULARY, dtype=np.int32)
    taken = lambda some, r: sum(int((y >= 0).sum()) for _, y, _ in lm_scoring.training_windows(iter(some), row, r))
    assert targets > 18 * lm_scoring.LEAST_STEPS * lm_scoring.BATCH * lm_scoring.ROUNDS
    assert sum(taken(batches, r) for r in range(lm_scoring.ROUNDS)) == targets
    assert taken(batches[:1], 0) == taken(batches[:1], 1) > 0


def test_words_so_far(spark, tokenizer):
    """Probabilities of ids after those of their word sum to one, with all prefixes kept and with few, and leave a word's own count out."""
    texts = ["the then there they th", "theory of thatching", "éa " * 3 + "the"]
    counted = lm_scoring.count_words(docs(spark, [(k, t, "en") for k, t in enumerate(texts)]), F.lit(True)).select("word", F.col("in_train").alias("n"))
    share = lm_scoring.subword_counts(counted, word_path()) + 0.5
    share /= share.sum()
    everything = np.arange(lm_scoring.VOCABULARY)
    for most in (10_000, 4):
        table = lm_scoring.prefixes(counted, word_path(), share, most)
        for word in ("the", "theory", "thatching", "zebra"):
            ids = tokenizer.encode(word, add_special_tokens=False).ids
            for k in range(len(ids)):
                flat = np.concatenate([np.tile(np.array(ids[:k], int), (len(everything), 1)), everything[:, None]], 1).reshape(-1)
                p = table.probabilities(flat, np.full(len(everything), k + 1))[k :: k + 1]
                assert abs(p.sum(dtype=float) - 1) < 1e-3, (word, k, most)
    table = lm_scoring.prefixes(counted, word_path(), share)
    ids = np.array(tokenizer.encode("thatching", add_special_tokens=False).ids)
    assert (table.training(ids, np.array([len(ids)])) <= table.scoring(ids, np.array([len(ids)]))).all()


def test_language_model_beats_the_base_on_texts_outside_training(spark):
    got = lm_scoring.op1_lm_score(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert got.score > got.base


def test_sums_in_two_levels(spark, monkeypatch):
    df = spark.range(1000).select("id").repartition(13)
    total = lambda: textio.add_up(df, lambda batches: np.array([float(sum(b.column(0).to_numpy().sum() for b in batches)), 1.0, 0.0]))
    assert total().tolist() == [499_500, 13, 0]
    monkeypatch.setattr(textio, "GROUPS", 3)
    assert total().tolist() == [499_500, 13, 0]


def test_sketch_adds_every_pair():
    """Counted pairs and those added one by one, whatever the share of ids with a column."""
    r = np.random.default_rng(2)
    ids = r.zipf(1.3, (3, 400)) % lm_scoring.VOCABULARY
    row, base = lm_scoring.row_of(np.arange(lm_scoring.VOCABULARY)), r.random(lm_scoring.VOCABULARY) / lm_scoring.VOCABULARY
    pairs = [(x[:-1], x[1:]) for x in ids]
    signs = np.random.default_rng(3).standard_normal((lm_scoring.VOCABULARY, lm_scoring.SKETCH)).astype(np.float32)
    signs /= np.sqrt(base * lm_scoring.VOCABULARY + 1)[:, None]
    want = np.zeros((lm_scoring.ROWS, lm_scoring.SKETCH + 1))
    for a, b in pairs:
        np.add.at(want, row[a], np.concatenate([signs[b], np.ones((len(b), 1))], 1))
    for most in (0, 5, lm_scoring.OWN_IDS):
        column = np.full(lm_scoring.VOCABULARY, lm_scoring.OWN_IDS, np.int32)
        column[:most] = np.arange(most)
        assert np.allclose(lm_scoring.sketch_of(pairs, row, base, column), want, atol=1e-4)


def test_training_steps_stay_in_single_precision():
    """Moves of the weights are single precision and made in place: nothing of the embedding table's size is made anew."""
    import tracemalloc

    r = np.random.default_rng(4)
    rows, v, k = 4096, 500, lm_scoring.CLASSES
    kind = r.integers(0, k, rows).astype(np.int32)
    book = attention.Book(r.random((v, k)).astype(np.float32), np.append(kind, 0).astype(np.int32), np.ones((2, 3), np.float32), np.full(v, 2, np.int32), np.ones(2, np.float32))
    trainer = attention.Trainer(attention.init(rows, k, kind, np.ones(k) / k), book, 2, 0.01, 1)
    x, y = r.integers(0, rows, (8, attention.LENGTH)).astype(np.int32), r.integers(0, v, (8, attention.STRIDE)).astype(np.int32)
    trainer.run(x, y, np.full(y.shape, 0.1, np.float32), 2)
    table = trainer.p["E"].nbytes
    tracemalloc.start()
    trainer.run(x, y, np.full(y.shape, 0.1, np.float32), 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * table and all(z.dtype == np.float32 for z in trainer.p.values())


def test_training_steps_touch_the_rows_they_meet():
    """The same weights as plain Adam over whole tables, across the places where decay is made up for; gradients of E are
    not made for rows that no window of a step meets."""
    r = np.random.default_rng(6)
    rows, v, k = 300, 400, 6
    kind = r.integers(0, k, rows).astype(np.int32)
    book = attention.Book(r.random((v, k)).astype(np.float32), np.append(kind, 0).astype(np.int32), np.ones((2, 3), np.float32), np.full(v, 2, np.int32), np.ones(2, np.float32))
    x, y = r.integers(0, rows, (6, attention.LENGTH)).astype(np.int32), r.integers(0, v, (6, attention.STRIDE)).astype(np.int32)
    word, start = r.random(y.shape).astype(np.float32), attention.init(rows, k, kind, np.ones(k) / k)
    steps = attention.Trainer.MADE_UP + 10
    trainer = attention.Trainer(start, book, 2, 0.01, 1)
    trainer.run(x, y, word, steps)
    p = {key: z.astype(np.float64) for key, z in start.items()}
    m, s = ({key: np.zeros(z.shape) for key, z in p.items()} for _ in range(2))
    rng = np.random.default_rng(1)
    order, at = rng.permutation(6), 0
    for t in range(1, steps + 1):
        if at >= 6:
            order, at = rng.permutation(6), 0
        pick, at = order[at : at + 2], at + 2
        g = attention.gradients({key: z.astype(np.float32) for key, z in p.items()}, book, x[pick], y[pick], word[pick])[1]
        for key in p:
            m[key], s[key] = 0.9 * m[key] + 0.1 * g[key], 0.99 * s[key] + 0.01 * g[key] ** 2
            p[key] -= 0.01 * min(1, t / 8) * np.sqrt(1 - 0.99**t) / (1 - 0.9**t) * m[key] / (np.sqrt(s[key]) + 1e-8)
    # Adam divides by small numbers, so rounding is not damped where gradients are near 0.
    for key in p:
        assert np.quantile(np.abs(trainer.p[key] - p[key]), 0.99) < 2e-3, key
    met, of_met = attention._gradients(start, book, x[:1], y[:1], word[:1])[2:]
    assert met.tolist() == np.unique(x[0]).tolist() and of_met.shape == (len(met), attention.DIM)


def test_lexicon_stays_for_the_next_task_with_the_same_numbers():
    """A method of one object is made anew at each access but is the same function; another object's is not."""

    class Of:
        def numbers(self, ids, counts):
            return np.ones(len(ids), np.float32)

    lex, one = textio.Lexicon(word_path()), Of()
    lex.beside(one.numbers)
    lex.look_up([b"the", b"theory"])
    lex.beside(one.numbers)
    assert len(lex.index) == 2
    lex.beside(Of().numbers)
    assert len(lex.index) == 0


def test_attention_probabilities_and_gradients():
    r = np.random.default_rng(0)
    k, vocabulary, rows = 5, 12, 9
    table = r.random((vocabulary, k)).astype(np.float32)
    table /= table.sum(0)
    kind = r.integers(0, k, rows + 1).astype(np.int32)
    own = np.ones((4, 4), np.float32)
    column = np.minimum(np.arange(vocabulary), 3).astype(np.int32)
    counts = r.random((3, 4))
    for i in range(3):
        rest = table[3:, kind[i]].sum()
        own[i] = counts[i] / counts[i].sum()
        own[i, -1] /= rest
    book = attention.Book(table, kind, own, column, np.full(4, 1e9, np.float32))
    p = attention.init(rows, k, kind[:rows], np.ones(k) / k)
    p["near"] = r.standard_normal(attention.LENGTH).astype(np.float32)
    p["W"] += r.standard_normal(p["W"].shape).astype(np.float32)
    ids = r.integers(0, rows, 70)
    ends = np.array([0, 1, 30, 70])
    x, _, _, text = attention.windows(ids, ends, np.ones(70, np.float32))
    assert sorted(set(text)) == [1, 2]
    share = r.random(vocabulary)
    share /= share.sum()
    even = lambda y: np.full((len(x), attention.STRIDE), y)
    total = sum(np.exp(attention.log_probabilities(p, book, x, even(y), even(np.float32(share[y])))) for y in range(vocabulary))
    used = x[:, attention.CONTEXT :] >= 0
    assert np.allclose(total[used], 1, atol=1e-4)
    # No token sees what follows it, and windows agree on a token whatever comes later.
    beside = r.random(70).astype(np.float32)
    _, y, word, _ = attention.windows(ids, ends, beside)
    later = ids.copy()
    later[60:] = 0
    a = attention.log_probabilities(p, book, x, y, word)
    x2, y2, word2, _ = attention.windows(later, ends, beside)
    b = attention.log_probabilities(p, book, x2, y2, word2)
    same = (x == x2).all(1) & (y == y2).all(1)
    assert np.allclose(a[same], b[same]) and (y >= 0).sum() == 28 + 39
    # Scoring is the same function as training's forward pass, without own counts left out.
    w, _ = attention.forward(p, x)
    u, alone = book.after(np.maximum(x[:, attention.CONTEXT :], 0).reshape(-1), np.maximum(y, 0).reshape(-1))
    want = np.log((w.reshape(-1, k + 2) * np.concatenate([u, alone[:, None], word.reshape(-1, 1)], 1)).sum(1)).reshape(y.shape)
    assert np.allclose(np.where(y < 0, 0, want), a, atol=1e-4)
    loss, g = attention.gradients(p, book, x, y, word)
    for name in ("W", "Wq", "Wo", "near", "E"):
        at = tuple(r.integers(0, n) for n in p[name].shape)
        moved = []
        for step in (1e-2, -1e-2):
            q = {n: v.copy() for n, v in p.items()}
            q[name][at] += step
            moved.append(attention.gradients(q, book, x, y, word)[0])
        assert abs((moved[0] - moved[1]) / 2e-2 - g[name][at]) < 2e-3, name


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>not text</p>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1><a href=/>Home</a></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div id="cookie-notice">We use cookies to make this site better. Accept all of them now.</div><div class="ad">Buy now!</div><!-- <p>hidden</p> -->
<article><h1>Title &amp; more</h1><p>First   paragraph&nbsp;with <b>bold</b>
text that is long enough.<p>Second<br>line &lt;here&gt;, also of some length.</p><aside>Read also: other stories of the day.</aside><ul><li>one point</li><li>two points</li></ul>
<form><label>Mail</label><input><button>Send</button></form></article>
<section class="comments"><article class="comment"><p>I do not agree with any of this, but thanks for the article!</p></article></section>
<footer>&copy; 2020 All rights reserved.</footer>"""


def test_html_extraction(spark):
    assert html_extract.extract(PAGE) == "Title & more\nFirst paragraph with bold text that is long enough.\nSecond line <here>, also of some length.\none point\ntwo points"
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<script>x</script>") == ""
    assert html_extract.extract("just text") == "just text" and html_extract.extract("<p>cut &am") == "cut &am"
    assert html_extract.extract("<div>" * 3000 + "deep text here" + "</div>" * 10) == "deep text here"
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = html_extract.extract_pages(pages, ["page_id", "url"]).collect()
    assert sorted(r.n_chars for r in got) == [0] + [len(html_extract.extract(PAGE))] * 2
    assert html_extract.extract_pages(pages.drop("text").where("false"), ["page_id"]).count() == 0


def test_the_cut_decides_where_a_threshold_fails():
    para = "<p>" + "This paragraph has enough words to be taken for the text of an article. " * 3 + "</p>"
    cases = [
        # A short line between paragraphs stays.
        (f"<div>{para}<p>Then</p>{para}</div>", "Then", False, True),
        # So does a paragraph of the text whose class sounds like a widget.
        (f"<div>{para}<p class='comment-like'>{para[3:-4]}</p>{para}</div>", None, False, True),
        # A sentence among the links of an unnamed menu goes.
        ("<div><ul>" + "<li><a href=/x>Link</a></li>" * 3 + "<li>See all of our other stories here.</li>" + "<li><a href=/x>Link</a></li>" * 3 + f"</ul></div><div>{para}</div>", "See all of our other stories here.", True, False),
    ]
    for page, text, by_threshold, by_cut in cases:
        blocks = html_extract.blocks_of(page)
        at = next(i for i, b in enumerate(blocks) if (b.text == text if text else b.node.boiler))
        assert (html_extract.content_probability(blocks[at]) > 0.5) is by_threshold and html_extract.label(blocks)[at] is by_cut, page
    # An advert among paragraphs goes, by name and by kind.
    assert "Buy" not in html_extract.extract(f"<article>{para}<div class=ad>Buy this now, it is cheap today.</div>{para}<p class=ad>Buy now!</p>{para}</article>")


def test_every_page_gives_its_articles_paragraphs(spark):
    """Brute force by a regular expression over the article of every page of the table."""
    import html as html_lib
    import re

    for r in textio.table(spark, "/root/testdata/sf0.01", "pages").collect():
        article = re.search(r"<article>(.*)</article>", re.sub(r"<(script|style|aside|form)\b.*?</\1>|<!--.*?-->", "", r.html, flags=re.S), re.S)
        want = []
        for part in re.split(r"</?(?:p|h1|h2|h3|li|ul|ol|div|section|blockquote|tr|table)\b[^>]*>", article[1]) if article else []:
            t = " ".join(html_lib.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", part)).split())
            want += [t] if t else []
        assert html_extract.extract(r.html) == "\n".join(want), r.page_id


def test_long_pages_take_linear_time():
    import time

    def seconds(page):
        t = time.perf_counter()
        html_extract.extract(page)
        return time.perf_counter() - t

    for page in (lambda n: "<b>" * n + "</i>" * n, lambda n: "<div><a>" * n + "x", lambda n: "<p>text of some length here.<ul><li><a href=x>l</a></ul>" * n, lambda n: "<td>" * n + "<tr>" * n):
        seconds(page(2000))
        assert seconds(page(40_000)) < 8 * max(seconds(page(10_000)), 0.02)


def test_minimum_cut_against_all_labellings():
    r = random.Random(4)
    for _ in range(40):
        n = r.randint(1, 7)
        s, t = ([r.random() * 3 for _ in range(n)] for _ in "st")
        e = [(i, j, r.random()) for i in range(n) for j in range(i) if r.random() < 0.5]
        cost = lambda keep: sum(t[i] if k else s[i] for i, k in enumerate(keep)) + sum(w for i, j, w in e if keep[i] != keep[j])  # noqa: E731, B023
        best = min(cost([b >> i & 1 for i in range(n)]) for b in range(1 << n))
        assert abs(cost([int(k) for k in html_extract.minimum_cut(s, t, e)]) - best) < 1e-9


def test_tool_chat(spark):
    def q(n):
        return {"tool_call": {"id": n, "name": "add", "arguments": {"b": 2, "a": 1}}}

    rows = [
        (1, 0, "assistant", json.dumps(q("x"))), (1, 1, "tool", json.dumps({"tool_result": {"id": "x", "content": "3"}})), (1, 5, "assistant", json.dumps(q("late"))), (1, 4, "tool", json.dumps({"tool_result": {"id": "late", "content": "?"}})),
        (1, 6, "tool", json.dumps({"tool_result": {"id": "none", "content": "?"}})), (1, 7, "user", "plain \"text\""), (1, 8, "assistant", json.dumps({"tool_call": {"id": "bad", "name": "add", "arguments": {"a": "one", "z": True}}})), (1, 9, "assistant", json.dumps({"tool_call": {"id": "odd", "name": "nope", "arguments": {}}})), (None, None, None, None),
    ]
    schema = {"add": {"a": {"type": "integer", "required": True}, "b": {"type": "integer", "required": True, "max": 5}}}
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in tool_chat.format_events(tool_chat.from_json_texts(table), schema).collect()}
    assert [got[t].linked for t in (0, 1, 5, 4, 6, 7)] == [True, True, True, True, False, False]
    assert got[0].position < got[1].position and got[5].position < got[4].position
    assert got[0].canonical == '{"arguments":{"a":1,"b":2},"id":"x","kind":"call","name":"add","role":"assistant","turn":0}' and got[0].valid
    assert got[8].errors == "a: not integer; b: missing; z: unexpected" and got[9].errors == "unknown tool"
    assert json.loads(got[7].canonical)["content"] == 'plain "text"' and got[None].position is None
    con = duckdb.connect()
    conversations = pd.read_parquet(f"{DATA}/conversations.parquet")
    conversations = pd.concat([conversations, conversations.head(3), pd.DataFrame([(None, None, None, None), (7, 0, "user", None), (7, None, "assistant", "x"), (8, 3, "system", ""), (8, 9, "tool", "t")], columns=conversations.columns)]).astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("conversations", conversations)
    events = spark.createDataFrame([tuple(None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in r) for r in conversations.itertuples(index=False)], "conv_id long, turn long, role string, text string")
    mine = tool_chat.format_events(tool_chat.as_replies(events), tool_chat.REPLY_SCHEMAS)
    sql = con.execute(tool_chat.OP4_SQL)
    names = [c[0] for c in sql.description]
    want = Counter(tuple(r) for r in sql.fetchall())
    assert Counter(tuple(r) for r in mine.select(*names).collect()) == want
    assert mine.where("false").count() == 0
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_vector_search(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(1500, 16)) * r.uniform(0.5, 2, (1500, 1))
    x[100:400] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [None] * 16), (5005, [float("inf")] * 16), (5006, [1.0]), (None, [1.0] * 16)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("node", F.lit("clash"))
    got = ann_graph.nearest(table.select("vec_id", "embedding"), table.select("vec_id", "embedding").where("vec_id % 20 = 0"), 20, "vec_id", "embedding", shard_rows=600).toPandas()
    q = np.arange(0, 1500, 20)
    want = ann_graph.brute_force(np.arange(1500), x, q, x[q], 20)
    both = want.merge(got, on=["query_id", "vec_id"], suffixes=("", "_got"))
    assert len(both) / len(want) >= 0.95 and np.allclose(both.score, both.score_got) and not (got.query_id == got.vec_id).any()
    hot = got[got.query_id == 200].sort_values("rank")
    assert hot.vec_id.tolist()[:5] == want[want.query_id == 200].vec_id.tolist()[:5]
    assert got.groupby("query_id").size().eq(20).all()
    assert ann_graph.nearest(table.where("false"), table, 20, "vec_id", "embedding").count() == 0
    few = table.where("vec_id < 3").select("vec_id", "embedding")
    assert ann_graph.nearest(few, few, 20, "vec_id", "embedding").count() == 6


def test_graph_prunes_few_nodes_and_beams_are_in_order(monkeypatch):
    """Work of the index: a node is pruned a few times, not once for each edge that comes back to it."""
    r = np.random.default_rng(1)
    x = (r.standard_normal((20, 64))[r.integers(0, 20, 3000)] + 2 * r.standard_normal((3000, 64))).astype(np.float32)
    pruned, prune = [], ann_graph.robust_prune
    monkeypatch.setattr(ann_graph, "robust_prune", lambda x, nodes, *a, **b: pruned.append(len(nodes)) or prune(x, nodes, *a, **b))
    graph, entry = ann_graph.build(x)
    assert sum(pruned) <= 3.5 * len(x)
    assert graph.shape == (len(x), ann_graph.DEGREE) and (np.sort(graph, 1)[:, 1:] != np.sort(graph, 1)[:, :-1])[np.sort(graph, 1)[:, 1:] >= 0].all() and not (graph == np.arange(len(x))[:, None]).any()
    q = x[::30] + np.float32(0.1)
    ids, dist = ann_graph.beam_search(x, graph, entry, q, 128)
    want = ((q[:, None] - x[None]) ** 2).sum(2)
    assert (np.diff(dist, axis=1) >= 0).all() and np.allclose(dist, np.take_along_axis(want, ids.astype(np.int64), 1), atol=1e-3)
    nearest = np.argsort(want, 1, kind="stable")[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(ids[:, :20].tolist(), nearest.tolist(), strict=True)]) >= 0.97
    # A graph of fewer nodes than the beam: all of them once, then unused places.
    few, far = ann_graph.beam_search(x[:5], np.array([[1, 2, 1], [0, 3, -1], [0, 4, -1], [1, -1, -1], [2, -1, -1]], np.int32), 0, x[:2], 8)
    assert np.sort(few[:, :5], 1).tolist() == [[0, 1, 2, 3, 4]] * 2 and (few[:, 5:] == -1).all() and np.isinf(far[:, 5:]).all() and np.isfinite(far[:, :5]).all()


def test_vector_search_of_any_size(spark):
    x = np.random.default_rng(0).standard_normal((1500, 8))
    for scale in (1e25, 1e150, 1e-30):
        df = spark.createDataFrame([(i, (v * scale).tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
        got = ann_graph.nearest(df, df.where("id % 100 = 0"), 5, tasks=1, shard_rows=700).toPandas()
        want = ann_graph.brute_force(np.arange(1500), x * scale, np.arange(0, 1500, 100), x[::100] * scale, 5)
        both = want.merge(got, on=["query_id", "vec_id"])
        assert len(both) >= 0.95 * len(want) and np.allclose(both.score_x, both.score_y)


def test_tool_calls_along_links(spark):
    call = lambda i, needs=None, **a: json.dumps({"tool_call": {"id": i, "name": "f", "arguments": a, **({"needs": needs} if needs else {})}})
    done = lambda i, c="x": json.dumps({"tool_result": {"id": i, "content": c}})
    rows = [
        (1, 0, done("a", {"b": 1, "a": [1.50]})), (1, 1, "hi"), (1, 5, call("a", n="42", t="true", o={"b": 1, "a": {"d": 1, "c": 2}}, z=None)), (1, 6, call("b", ["a", "nope"], n=7)), (1, 7, done("b")),
        (2, 0, call("p", ["q"])), (2, 1, call("q", ["p"])), (2, 2, done("p")), (2, 3, done("q")), (2, 4, call("r", ["q"])), (2, 5, call("s")),
        (3, 0, call("1", ["2"])), (3, 1, call("2", ["3"])), (3, 2, call("3")), (3, 3, done("3")), (3, 4, done("2")), (3, 5, done("1")),
        (4, 0, '{"tool_call": broken'), (4, 1, '{"tool_call": {"id": "x", "id": "y"}}'),
    ]
    table = spark.createDataFrame([(c, t, "r", x) for c, t, x in rows], "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("needs", "call_at", "cyclic", "position")})
    schema = {"f": {"n": {"type": "integer"}, "t": {"type": "boolean"}, "o": {"type": "object"}, "z": {"type": "null"}}}
    got = {(r.conv_id, r.turn): r for r in tool_chat.format_events(tool_chat.from_json_texts(table), schema).collect()}
    assert [got[1, t].position for t in (0, 1, 5, 6, 7)] == [11, 2, 10, 12, 15]
    assert got[1, 5].errors == "n: not integer; t: not boolean" and '"arguments":{"n":"42","o":{"a":{"c":2,"d":1},"b":1},"t":"true","z":null}' in got[1, 5].canonical
    assert '"content":"{\\"a\\":[1.5],\\"b\\":1}"' in got[1, 0].canonical
    assert [got[3, t].position for t in range(6)] == [10, 8, 4, 7, 9, 11] and not any(got[3, t].cyclic for t in range(6))
    # A cycle and what is behind it keep their own places.
    assert [got[2, t].position for t in range(6)] == [0, 2, 5, 7, 8, 10] and [got[2, t].cyclic for t in range(6)] == [True] * 5 + [False]
    assert {got[4, t].kind for t in (0, 1)} == {"message"}
    before = [((3, 2), (3, 3)), ((3, 3), (3, 1)), ((3, 1), (3, 4)), ((3, 4), (3, 0)), ((3, 0), (3, 5)), ((1, 5), (1, 0)), ((1, 0), (1, 6))]
    assert all(got[a].position < got[b].position for a, b in before)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert df.count() > 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as pipeline

    start = textio.table(spark, DATA, "documents")
    now, kept = start, []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, now, DATA).write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        if k < 3:
            assert now.columns == pipeline.COLUMNS, name
            assert now.join(start, pipeline.COLUMNS, "left_anti").count() == 0
            kept.append(now.select("doc_id").distinct().count())
    assert start.count() > kept[0] > kept[1] >= kept[2] > 0.5 * start.count()
    assert {r.doc_id for r in now.select("doc_id").distinct().collect()} == {r.doc_id for r in spark.read.parquet(str(tmp_path / "2")).select("doc_id").collect()}
    assert pipeline.run(spark, DATA).select("doc_id").distinct().count() == kept[2]
    repeated = start.limit(5).unionByName(start.limit(5)).withColumn("score", F.lit(1)).unionByName(docs(spark, [(None, "no id", "en"), (None, "no id", "en")]).withColumn("score", F.lit(1)))
    once = pipeline.near_duplicates(spark, repeated, DATA)
    assert once.where("doc_id IS NULL").count() == 1 and once.groupBy("doc_id").count().where("count > 1").count() == 0
    for _, stage in pipeline.STAGES:
        assert stage(spark, start.where("false"), DATA).count() == 0


def test_repeated_ids_lose_only_near_copies(spark):
    import corpus_pipeline as pipeline

    r = random.Random(9)
    text = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(120))
    a, b, c, d = (text() for _ in range(4))
    rows = [(1, a, "en"), (1, a, "en"), (1, b, "en"), (2, a, "en"), (2, c, "en"), (3, c, "en"), (3, d, "en"), (4, d, "en")]
    got = pipeline.near_duplicates(spark, docs(spark, rows).repartition(3), DATA).collect()
    assert sorted((x.doc_id, x.text) for x in got) == sorted([(1, a), (1, b), (2, c), (3, d)])


def test_repeated_queries_ask_once(spark):
    r = np.random.default_rng(3)
    e = spark.createDataFrame([(i, [float(v) for v in r.standard_normal(8)]) for i in range(200)], "vec_id long, embedding array<double>")
    asked = e.where("vec_id % 20 = 0")
    once, twice = (sorted(map(tuple, ann_graph.nearest(e, q, 20, "vec_id", "embedding").collect())) for q in (asked, asked.unionByName(asked)))
    assert once == twice and len(once) == 10 * 20 == len({(q, i) for q, _, i, _ in twice})


def test_model_takes_every_ngram(spark):
    """More different n-grams than any fixed bound it had: none is dropped, unless a bound is asked for."""
    words = np.random.default_rng(3).integers(97, 123, (130_000, 12), np.uint8)
    texts = [(i, b" ".join(w.tobytes() for w in words[i * 1000 : i * 1000 + 1000]).decode(), "x") for i in range(130)]
    d = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    longest = np.unique(np.concatenate([c for _, t, _ in texts for c, _ in quality_rules.grams_of(quality_rules.units(t.encode()))]))
    longest = longest[quality_rules._length(longest) == quality_rules.ORDER]
    assert len(longest) > 1 << 20
    assert quality_rules._find(quality_rules.fit(d).grams, quality_rules.hashed(longest, quality_rules.seed_of("x")))[1].all()
    assert not quality_rules._find(quality_rules.fit(d, 1000).grams, quality_rules.hashed(longest, quality_rules.seed_of("x")))[1].all()


def test_later_tasks_hold_no_lexicon(spark):
    """Workers live on between tasks: a stage that reads no words must not hold what packing learned."""
    import pyarrow as pa

    table = docs(spark, [(i, f"some words {i} of a text", "en") for i in range(40)]).repartition(4)
    packing.pack(table, packing.word_encoder(word_path())).count()

    def held(batches):
        n = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([len(textio._LEXICONS)])], ["n", "lexicons"])

    got = textio.map_batches(table.select("text"), held, "n long, lexicons long").collect()
    assert sum(r.n for r in got) == 40 and all(r.lexicons == 0 for r in got)


def test_index_of_hashes():
    r = np.random.default_rng(6)
    for n in (0, 1, 2, 50_000):
        keys = np.unique(r.integers(0, 1 << 64, n, np.uint64))
        keys = np.unique(np.concatenate([keys, keys[: n // 10] | np.uint64(1)]))
        wanted = np.concatenate([keys, keys + np.uint64(1), np.array([0, 2**64 - 1], np.uint64), r.integers(0, 1 << 64, 1000, np.uint64)])
        at, found = lm_scoring._Index(keys).find(wanted)
        assert (found == np.isin(wanted, keys)).all() and (not n or (keys[at[found]] == wanted[found]).all())
