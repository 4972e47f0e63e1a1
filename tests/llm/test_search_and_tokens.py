"""Exact top-k and BPE against brute force and the tokenizers library; the pipeline as a whole."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fieldspark.llm import bpe, queries, topk

from .helpers import AWKWARD, docs


def _top(rows, k, every):
    whole = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        x = [int(np.floor(np.float64(c) * 1024)) for c in v]
        whole[i] = min(whole.get(i, x), x)
    out = []
    for q in whole:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], x)), i) for i, x in whole.items() if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def _vectors(seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] + 0.2 * rng.normal(size=8)).tolist()) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(120)]  # ties
    rows += [(None, [1.0] * 8), (700, None), (701, [None] * 8), (702, [float("nan")] * 8), (800, [1.0, 2.0]), (900, []), (3, rows[3][1]), (1000, [1e6] * 8)]
    return rows


@pytest.mark.parametrize("block", [1024, 2])
def test_top_k(spark, block):
    rows = _vectors(block)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit(1)).repartition(3)
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    got = sorted(tuple(r) for r in topk.top_k(df, block=block).collect())
    assert got == _top(rows, 10, 100)
    assert topk.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("large", [1e160, 1.5e305])
def test_top_k_of_huge_components(spark, large):
    """Squares of finite components may overflow; no row is lost and scores are held to 64 bits."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(-2, 6)).tolist()) for i in range(60)]
    rows += [(100, [large, 0.0, 1.0, -large]), (200, [-large, large, 0.5, 0.0]), (201, [0.0, 0.0, 3.0, 0.0]), (300, [0.0, 0.0, 2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = {i: [int(np.floor(c * 1024)) for c in v] for i, v in rows}
    want = []
    for q in (i for i in whole if i % 100 == 0):
        held = {i: max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(whole[q], x)))) for i, x in whole.items() if i != q}
        best = sorted(held.items(), key=lambda e: (-e[1], e[0]))[:10]
        want += [(q, n, i, s) for n, (i, s) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == sorted(want)


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(2)
    x = np.floor(1024 * (rng.normal(size=(20, 16))[np.arange(3000) % 20] + 0.05 * rng.normal(size=(3000, 16))))
    pivots = topk.choose_pivots(x[:500], 32)
    q, dq, dx = x[:5], topk.distances(x[:5], pivots), topk.distances(x, pivots)
    assert (topk.upper_bounds(q, dq, x, dx) >= x @ q.T).all()
    best = [topk.Best(10, None) for _ in range(5)]
    done = topk.search(best, np.arange(5), q, dq, np.arange(3000), x, dx)
    assert done < 5 * 3000 / 2
    for k in range(5):
        score = x @ q[k]
        order = sorted((i for i in range(3000) if i != k), key=lambda i: (-score[i], i))[:10]
        assert best[k].ids.tolist() == order


def test_products_beyond_doubles():
    q, rows = np.array([2.0**60, 1.0]), np.array([[2.0, 1.0], [16.0, 0.0], [-16.0, 0.0]])
    assert topk.products(q, rows).tolist() == [2**61 + 1, (1 << 63) - 1, -(1 << 63)]


TEXTS = [
    "Hello  wörld, it's 2023's ΣΑΣ <|endoftext|> foo İx ﬁ\n\n日本 é", "<|startoftext|><|endoftext|>", "ab" * 3000, "!" * 2000, "it'S I'LL X'RE 'TIS ''s",
    "\x1c\x1d\x85 \u2028 x", "é <|endoftext|>\u0301 ǅ ẞ", "<|endof", "٣٤५½²Ⅷ", "\U0001f600\U0001f468\u200d\U0001f469 ok", "\x00\x01\ufeff",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.vocabulary_path())


def test_encoding_equals_the_library(library):
    v = bpe.Vocabulary(queries.vocabulary_path())
    rng = random.Random(1)
    texts = TEXTS + [t for t in AWKWARD if t] + [
        "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0, 0x3000), rng.randrange(0x3000, 0xD7FF), rng.randrange(0xE000, 0x1FFFF)]))
                for _ in range(30)) for _ in range(300)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert list(v.encode(t)) == ids
        assert v.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_settled_characters(library):
    v = bpe.Vocabulary(queries.vocabulary_path())
    settled = [chr(c) for c in range(0x3400) if bpe.SETTLED(chr(c))]
    for k in range(0, len(settled), 50):
        t = "".join(f"{c}x{c}3{c}! {c}{c}" for c in settled[k:k + 50])
        assert list(v.encode(t)) == library.encode(t, add_special_tokens=False).ids


def test_forced_cuts_and_merges():
    v = bpe.Vocabulary(queries.vocabulary_path())
    rng = random.Random(4)
    for _ in range(300):
        word = bytes(rng.choice(b"abcdefgh'\xc3\xa9\xe6\x97\xa5") for _ in range(rng.randrange(1, 60)))
        whole = [v.inside[b] for b in word[:-1]] + [v.last[word[-1]]]
        assert bpe.merge_short(list(whole), v.ranks) == bpe.merge_long(list(whole), v.ranks) == list(v._encode_word(word))


def test_token_columns(spark, library):
    d = docs(spark, AWKWARD + TEXTS, tokens_of=1)
    for r in bpe.tokenize(d, queries.vocabulary_path()).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.tokens.ids == ids and bytes(r.tokens.packed) == np.array(ids, "<u4").tobytes()
        assert r.tokens.decoded == library.decode(ids, skip_special_tokens=False)


def test_query_digests(spark, sf, library):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op10_bpe(spark, sf).collect():
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_pipeline(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "near dedup", "decontamination", "encoding"]
    got = corpus_pipeline.run(spark, sf)
    given = spark.read.parquet(f"{sf}/documents.parquet")
    assert 0 < got.count() < given.count() and got.select("doc_id").distinct().count() == got.count()


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_awkward_tables(spark, sf, stage):
    d = docs(spark, AWKWARD + ["plain words of a clean text " * 3], extra="x")
    name, f = corpus_pipeline.STAGES[stage]
    out = f(spark, d, sf)
    if stage < 4:
        assert tuple(out.columns) == corpus_pipeline.COLUMNS
    assert out.count() >= 4
    assert f(spark, d.limit(0), sf).count() == 0
