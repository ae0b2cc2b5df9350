"""Id files, ranked search and whitening against the library, brute force and exact arithmetic, with nulls, ties and odd tables."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import lexical_search, token_files, whitening

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# 11 id files


@pytest.fixture(scope="module")
def tokenizer_file():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


ODD = ["", " ", "a  b ", "x\n\n y\t", "a" * 3000, "日本語テキスト" * 20, "<|endoftext|> hi  <|endoftext|>", "é́ ﬁ\x85\x1c  z  \n", "🙂🙂 " * 5, "\0x\0", None, "it's  we'll\r\n", " " + chr(0x2028) + "q", chr(0x3000) * 3 + "w"]


@pytest.mark.parametrize("bits", [False, True])
def test_id_files_hold_the_librarys_ids(spark, tmp_path, tokenizer_file, bits):
    from tokenizers import Tokenizer

    r = random.Random(4)
    texts = ODD + ["".join(r.choice("ab cdé\n \tß的1,'etion") for _ in range(r.randint(0, 150))) for _ in range(60)] + ["hot copy"] * 40
    rows = [(r.randint(-50, 50) if k % 9 else None, t, "extra", 1, 2) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids string, start int, file int").repartition(5)
    to = str(tmp_path / "ids")
    index = token_files.write_ids(docs, tokenizer_file, to, bits=bits, block=100, file_bytes=1500)
    got = token_files.read_ids(spark, to).collect()
    assert index.count() > 3 and len(got) == len(rows)
    library = Tokenizer.from_file(tokenizer_file)
    encode = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 2]
    assert collections.Counter((x.doc_id, tuple(x.ids)) for x in got) == collections.Counter((i, tuple(encode(t))) for i, t, *_ in rows)
    got.sort(key=lambda x: x.start)
    order = [(x.doc_id is not None, x.doc_id or 0) for x in got]
    assert order == sorted(order)
    assert [x.start for x in got] == np.append(0, np.cumsum([x.n_tokens for x in got])[:-1]).tolist()
    assert all(x.n_tokens == len(x.ids) and x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes()) for x in got)
    whole = np.concatenate([x.ids for x in got])
    for lo, hi in [(0, 1), (95, 305), (len(whole) - 7, len(whole) + 9), (0, len(whole)), (40, 40)]:
        assert token_files.read_span(spark, to, lo, hi).tolist() == whole[lo:hi].tolist()
    # files that no row of the index names are gone
    assert {p.name for p in (tmp_path / "ids").glob("*.planes")} == {x.file for x in index.collect()}


def test_id_files_of_long_texts_and_of_nothing(spark, tmp_path, tokenizer_file, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "PIECE_CHARS", 500)
    long = "some words, and\n more  " * 300 + "x" * 2000 + " end"
    with open(tokenizer_file) as f:
        encoder = token_files.Encoder(f.read(), 2, cache=10)
    parts = encoder([long])[0]
    assert len(parts) > 5
    assert np.frombuffer(b"".join(parts), "<u4").tolist() == [*Tokenizer.from_file(tokenizer_file).encode(long, add_special_tokens=False).ids, 2]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.token_files(empty, tokenizer_file, str(tmp_path / "none")).collect() == []
    assert len(token_files.read_span(spark, str(tmp_path / "none"), 0, 10)) == 0
    with pytest.raises(TypeError):
        token_files.write_ids(spark.createDataFrame([("a", "b")], "doc_id string, text string"), tokenizer_file, str(tmp_path / "bad"))


@pytest.mark.parametrize("alike", [False, True])
def test_chunks_are_told_apart_by_their_bytes(tokenizer_file, monkeypatch, alike):
    from tokenizers import Tokenizer

    if alike:  # all hashes are equal
        monkeypatch.setattr(token_files, "_lane_hash", lambda lanes: np.zeros(len(lanes), np.uint64))
    r = random.Random(5)
    texts = [t or "" for t in ODD] + ["".join(r.choice("ab cdé\n \t\xa0\u2003\u3000\0ß的1,'") for _ in range(r.randint(0, 90))) for _ in range(300)]
    library = Tokenizer.from_file(tokenizer_file)
    with open(tokenizer_file) as f:
        encoder = token_files.Encoder(f.read(), 2, cache=50)
    for some in (texts[:100], texts[100:], texts[::-1]):
        assert [np.frombuffer(b"".join(x), "<u4").tolist() for x in encoder(some)] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in some]


def test_chunks_in_use_stay_known(tokenizer_file):
    """Where the bound is reached, only chunks that the call doesn't use are forgotten, and none is encoded again."""
    with open(tokenizer_file) as f:
        encoder = token_files.Encoder(f.read(), 2, cache=10)
    given = []
    ids = encoder._chunk_ids
    encoder._chunk_ids = lambda chunks: given.append(len(chunks)) or ids(chunks)
    encoder(["a b c d e f"])
    encoder(["a b c d e f g h i j k"])
    encoder(["g h i j k"])
    assert sum(given) == 6 + 5 + 1  # the last text begins without a blank


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [1, 7, 8, 1000, 65536])
def test_planes_round_trip(n, bits):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    assert (token_files.unshuffled(token_files.shuffled(ids, bits), n) == ids).all()
    planes = token_files.shuffled(ids & np.uint32(0xFFFF), bits)
    assert not any(planes[len(planes) // 2 :])  # planes of zeros take no bytes


# 12 ranked search


def brute_search(docs, items, top=20):
    terms = lambda t: TERM.findall((t or "").translate(LOW))
    held = [(i, collections.Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        rows = []
        for i, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w in terms(text) if w in c)
            if score > 0:
                rows.append((-score, i is None, i or 0))
        out += [(item, k, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(rows)[:top], 1)]
    return out


@pytest.mark.parametrize("block_words", [7, 10**6])
def test_search_is_the_brute_force_ranking(spark, block_words, monkeypatch):
    monkeypatch.setattr(lexical_search, "GROUP", 2)
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "ß", "The", "the", "x_y", "日本"]
    text = lambda m: r.choice([" ", "-", "\n"]).join(r.choice(vocabulary) for _ in range(m))
    docs = [(k, text(r.choice([0, 1, 5, 30, 80]))) for k in range(150)] + [(k, "w1 w2 same copy") for k in range(400, 440)] + [(None, "w1 w2 same copy"), (7, "w3 " * 5000), (8, None), (9, "?!")]
    items = [(k, text(r.randint(1, 12))) for k in range(12)] + [(3, "w1 same"), (None, "copy w2 w2"), (20, None), (21, "none of these"), (22, "")]
    d = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id int, text string, rank string, item_id int").repartition(6)
    q = spark.createDataFrame([(i, t, "b") for i, t in items], "item_id int, text string, doc_id string")
    got = [tuple(x) for x in lexical_search.search(d, q, block_words=block_words).select("item_id", "rank", "doc_id", "score").collect()]
    # repeated items are ranked each, so rows are compared as a multiset
    assert collections.Counter(got) == collections.Counter(brute_search(docs, items))


def test_search_over_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    got = lexical_search.search(docs, items)
    assert got.collect() == [] and got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    none = lexical_search.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0))
    assert none.collect() == [] and none.dtypes == got.dtypes


def test_impacts_stay_in_64_bits():
    sizes = np.array([10**12, 3], np.int64)
    got = lexical_search.impacts(np.array([3, 5]), np.array([2, 1]), sizes, 10**10, 10**13)
    assert got.tolist() == [w * (10**9 * t // (1000 * t + 12 * (75 + 25 * s * 10**10 // 10**13))) for w, t, s in zip([3, 5], [2, 1], sizes.tolist(), strict=True)]


# 13 whitening


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1.0) for i, v in rows], "vec_id long, embedding array<float>, n int, whitened double")


def test_whitening_against_exact_arithmetic(spark):
    r = np.random.default_rng(2)
    mixed = (r.standard_normal((300, 12)) @ r.standard_normal((12, 12))).astype(np.float32)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(mixed)] + [(5, [0.5] * 12), (None, [0.25] * 12)]
    bad = [(900, None), (901, [1.0] * 11 + [None]), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, [])]
    got = whitening.whitened(embeddings(spark, [*rows, *bad]).repartition(7)).collect()
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    assert len(got) == 8 * n and {g.n for g in got} == {n} and {g.component for g in got} == set(range(1, 9))
    square = collections.Counter((i, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))) for (i, _), v in zip(rows, x, strict=True))
    assert collections.Counter((g.vec_id, g.deviation) for g in got if g.component == 3) == square
    centred = np.array([[a - s / n for a, s in zip(v, sums, strict=True)] for v in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    for k in range(1, 9):
        want = centred @ vectors[:, -k] / math.sqrt(values[-k])
        have = {g.vec_id: g.whitened for g in got if g.component == k and g.vec_id not in (5, None)}
        want = {i: w for (i, _), w in zip(rows, want, strict=True) if i not in (5, None)}
        sign = math.copysign(1, have[0] * want[0])
        assert all(have[i] == pytest.approx(sign * want[i], abs=1e-9) for i in have)
        assert all(g.explained == pytest.approx(values[-k] / values.sum(), rel=1e-9) for g in got if g.component == k)
    assert {g.identity_error for g in got}.pop() < 1e-9


def test_chan_merge_is_the_whole():
    x = np.random.default_rng(0).integers(0, 200_000, (100, 5))
    whole = whitening.Moments.of(x)
    state = whitening.Moments()
    for part in np.split(x, [1, 1, 40, 97]):
        state = state.merged(whitening.Moments.of(part)) if len(part) % 2 else whitening.Moments.of(part).merged(state)
    assert state.n == 100 and state.sums == whole.sums == x.sum(0).tolist()
    assert np.allclose(state.scatter, np.cov(x.T, bias=True) * 100, rtol=1e-12) and np.allclose(state.mean, x.mean(0))


def test_whitening_without_variance(spark):
    one = whitening.whitened(embeddings(spark, [(1, [0.5, 1.0])])).collect()
    assert [(g.component, g.n, g.deviation, g.whitened, g.explained, g.identity_error) for g in one] == [(1, 1, 0, None, 0.0, None), (2, 1, 0, None, 0.0, None)]
    line = sorted(whitening.whitened(embeddings(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])])).collect(), key=lambda g: (g.component, g.vec_id))
    assert [g.explained for g in line] == pytest.approx([1, 1, 1, 0, 0, 0]) and all(g.whitened is None for g in line[3:])
    assert abs(line[0].whitened) == pytest.approx(math.sqrt(2)) and line[0].identity_error < 1e-12
    assert whitening.whitened(embeddings(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.whitened(embeddings(spark, []).limit(0)).collect() == []


def test_whitening_refuses_what_has_no_covariance(spark):
    for rows in ([(1, [0.0]), (2, [0.0, 1.0])], [(1, [1e30])]):
        with pytest.raises(Exception, match="entries"):
            whitening.whitened(embeddings(spark, rows)).collect()


def test_large_deviations_are_exact_or_null():
    root = math.isqrt((1 << 63) - 1)
    x = np.array([[10**14, -(10**14)], [3, 5], [0, 0]], np.int64)
    assert whitening.deviations(x, 3, x.sum(0).tolist())[2].tolist() == [False, False, False]
    x = np.array([[1 << 30, 0], [0, 0]], np.int64)
    centred, squares, fits = whitening.deviations(x, 2, x.sum(0).tolist())
    assert squares.tolist() == [1 << 60, 1 << 60] and fits.all() and centred[:, 0].tolist() == [float(1 << 29), -float(1 << 29)]
    edge = np.array([[root], [root + 1], [-root], [-root - 1], [7]], np.int64)
    centred, squares, fits = whitening.deviations(edge, 1, [0])
    assert fits.tolist() == [True, False, True, False, True] and squares[fits].tolist() == [root**2, root**2, 49]
    huge = np.array([[(1 << 47)], [-(1 << 47)]], np.int64)
    centred, squares, fits = whitening.deviations(huge, 1 << 20, [0])
    assert not fits.any() and centred[:, 0].tolist() == [float(1 << 47), -float(1 << 47)]


def test_registered_queries_read_whole_tables(spark):
    import os

    from weftline.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    assert QUERIES["op13_whitening"](spark, sf).count() == 8 * spark.read.parquet(f"{sf}/embeddings.parquet").count()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = QUERIES["op12_lexical_search"](spark, sf).select("item_id", "rank", "doc_id", "score")
    assert sorted(map(tuple, got.collect())) == sorted(brute_search([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()]))
    pytest.importorskip("public_tokenizers")
    assert QUERIES["op11_token_files"](spark, sf).agg(F.count("*"), F.min("start")).first() == (docs.count(), 0)
