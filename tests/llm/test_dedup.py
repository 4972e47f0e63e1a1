"""Near duplicates, line deduplication, decontamination and sharding against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.llm import decontaminate, line_dedup, near_dup, queries, sharding

from .helpers import AWKWARD, docs


def _components(texts, words, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {b" ".join(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = Counter((a, b) for ids in holders.values() for n, a in enumerate(ids) for b in ids[n + 1:])
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def _families(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    out = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 40, 150, 400]))
        for _ in range(rng.choice([1, 2, 6, 25])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out + AWKWARD


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(spark, words):
    texts = list(enumerate(_families(words)))
    d = docs(spark, texts, node=1, n=2, print="p", comp=0)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(d, words=words).collect()}
    assert got == _components(texts, words, 80)


def test_near_duplicates_rounds_and_chains(spark, monkeypatch):
    """Leader rounds only, over a chain in which neighbours are linked and its ends are not."""
    monkeypatch.setattr(near_dup, "PAIRS_PER_ENTRY", 0)
    base = [f"w{i}" for i in range(400)]
    chain = [" ".join(base[k * 10:k * 10 + 200]) for k in range(20)]
    texts = list(enumerate(chain + _families(9)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs(spark, texts), words=4).collect()}
    assert got == _components(texts, 4, 80)


def test_near_duplicates_leaders_where_no_block_is_dense(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "PAIRS_PER_ENTRY", 0)
    monkeypatch.setattr(near_dup, "DENSE", float("inf"))
    texts = list(enumerate(_families(11)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs(spark, texts), words=4).collect()}
    assert got == _components(texts, 4, 80)


def test_near_duplicates_form_no_pairs_within_a_family(spark, monkeypatch):
    """Edited copies of one text, many of them too far from all others: lists hold most pairs of them to the end."""
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 20, raising=False)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(120):
        copy = list(base)
        for at in rng.sample(range(300), rng.choice([2, 9, 10, 11])):
            copy[at] = rng.choice(["new", "old", f"x{rng.random()}"])
        texts.append(" ".join(copy))
    texts = list(enumerate(texts))
    rows, store = Counter(), near_dup.store

    def counted(df, name):
        out = store(df, name)
        rows[name] += out.count()
        return out

    monkeypatch.setattr(near_dup, "store", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs(spark, texts), words=4).collect()}
    want = _components(texts, 4, 80)
    assert got == want and len({c for _, c in want.values()}) > 10
    assert rows["pairs"] <= len(texts) and rows["block-ends"] > 2 * len(texts) // 20


def test_shared_values_of_blocks_are_counted_whole(monkeypatch):
    rng = np.random.default_rng(4)
    xs, ys = ([np.unique(rng.integers(0, 1 << m, n).astype(np.uint64)) for m, n in zip(rng.choice([4, 9, 14], k), rng.integers(1, 300, k), strict=True)]
              for k in (37, 23))
    want = [[len(np.intersect1d(x, y)) for y in ys] for x in xs]
    for often in (0, 1 / 256, 1 / 4, 2):
        monkeypatch.setattr(near_dup, "OFTEN", often)
        monkeypatch.setattr(near_dup, "COLUMNS", 50)
        assert near_dup.shared_values(xs, ys).tolist() == want
    assert near_dup.shared_values(xs[:1], [np.zeros(0, np.uint64)]).tolist() == [[0]]
    i, j = near_dup.alike_sets(xs[:2], [xs[1], xs[0][:-1]], 80)
    assert (1, 0) in set(zip(i.tolist(), j.tolist(), strict=True))


def test_near_duplicates_keeps_no_spent_sketches(spark, monkeypatch, tmp_path):
    from fieldspark.llm import tables

    monkeypatch.setattr(tables, "scratch_path", lambda _spark, name: f"{tmp_path}/{name}-{len(list(tmp_path.iterdir()))}-{id(object())}")
    texts = [f"{k % 5} " + " ".join(f"w{k % 5}x{j}" for j in range(40)) + f" end{k}" for k in range(20)]
    got = near_dup.near_duplicates(docs(spark, texts)).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: k % 5 for k in range(20)}
    kept = {p.name.split("-")[0] + "-" + p.name.split("-")[1] for p in tmp_path.iterdir()}
    assert "sets-of" in kept and "list-entries" in kept
    assert not kept & {"set-nodes", "shared-values"} and not any(k.startswith("sketches") for k in kept)


def test_near_duplicates_copies_leave_sketches_in_place(spark, monkeypatch):
    rows = [(None, 2, b"p", [1, 2]), (7, 2, b"p", [1, 2]), (5, 2, b"p", [1, 2]), (5, 2, b"q", [2, 3]), (9, 1, b"r", [4]), (8, 0, None, [])]
    sketches = spark.createDataFrame(rows, "doc long, n long, print binary, sketch array<long>")
    reps = sketches.filter("n > 0 and doc is not null").groupBy("print").agg(F.min("doc").alias("node"), F.max("doc").alias("last"))
    want = [(5, 2, [1, 2]), (5, 2, [2, 3]), (9, 1, [4])]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes = near_dup.set_nodes(sketches, near_dup.store(reps, "reps"))
        plan = nodes._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
        assert sorted(map(tuple, nodes.collect())) == want
        monkeypatch.setattr(near_dup, "BROADCAST_ROWS", 0)
        assert sorted(map(tuple, near_dup.set_nodes(sketches, near_dup.store(reps, "reps")).collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_values_of_one_document_stay_out_of_the_exchange(spark):
    known = [-5, 3, 1 << 40, -(1 << 62)]
    bits = near_dup.bits_of(spark.createDataFrame([(v,) for v in known], "h long"))
    rng = random.Random(3)
    rows = [(k, [rng.getrandbits(63) - (1 << 62) for _ in range(50)] + known[:k % 5]) for k in range(40)] + [(40, []), (41, None)]
    d = spark.createDataFrame(rows, "k int, s array<long>").repartition(3)
    got = {r.k: r.s or [] for r in d.select("k", near_dup.held_in(bits)("s").alias("s")).collect()}
    assert all([v for v in got[k] if v in known] == (s or [])[50:] for k, s in rows)
    assert sum(map(len, got.values())) < 0.1 * sum(len(s or []) for _, s in rows) + 80


def test_near_duplicates_odd_rows(spark):
    d = docs(spark, [(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (7, "a b c d e"), (8, None)])
    got = sorted(map(str, (tuple(r) for r in near_dup.near_duplicates(d).collect())))
    assert got == sorted(map(str, [(None, 1, 5, True), (5, 1, 5, True), (5, 1, 5, True), (7, 1, 5, False), (8, 0, 8, True)]))
    assert near_dup.near_duplicates(d.limit(0)).count() == 0


def test_near_duplicates_of_ids_with_several_texts(spark):
    one, two = ("a b c d e f", "p q r s t u")
    d = docs(spark, [(5, one), (5, two), (3, two), (9, one), (11, "k l m n o")])
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(d).collect()}
    assert got == {(5, 3, False), (3, 3, True), (9, 3, False), (11, 11, True)}


def test_depths_and_estimates_miss_nothing(spark):
    k = near_dup.SKETCH
    assert near_dup._tail(k, 0.2, k - near_dup.least_shared(k, 80) + 1) < near_dup.MISS
    rng = np.random.default_rng(5)
    sizes = [(n, int(n * f)) for n in (90, 120, 147, 300, 2000) for f in (1.0, 1.1, 1.25)]
    rows = spark.createDataFrame(sizes, "s long, l long").select("s", "l", near_dup.depth(F.col("s"), F.col("l"), k, 80).alias("d"),
                                                                 near_dup.common(F.col("s"), F.col("l"), 80).alias("c"))
    for r in rows.collect():
        for _ in range(60):  # sets that share as little as linked ones may, all own values rarest
            hashes = rng.permutation(r.s + r.l - r.c)
            both, a, b = np.split(hashes, [r.c, r.s])
            x, y = np.sort(np.concatenate([both, a]))[:k], np.sort(np.concatenate([both, b]))[:k]
            shared = np.intersect1d(x, y)
            assert max(len(x), len(y)) - len(shared) + 1 <= r.d


def _line_truth(rows, min_chars, min_docs):
    def key(line):
        k = line.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
        return k if len(k) >= min_chars else None

    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if key(line) and i is not None and t is not None:
                holders[key(line)].add(i)
    frequent = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    return [(i, [p for p, line in enumerate((t or "").split("\n")) if frequent.get(key(line), i) != i]) for i, t in rows]


@pytest.mark.parametrize("options", [{}, {"index_bytes": 1, "shard_keys": 1}])
def test_line_dedup(spark, options):
    rng = random.Random(3)
    lines = ["short", *[f"Line number {k} " + "ä" * rng.randrange(10, 40) for k in range(12)], "  PADDED line that is long enough to be counted \t"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 9)))) for i in range(40)]
    rows += [(40 + i, t) for i, t in enumerate(AWKWARD)] + [(rows[3][0], rows[3][1])] * 3 + [(None, rows[5][1])]
    d = docs(spark, rows, row_key="k")
    got = line_dedup.dedup_lines(d, **options).select("doc_id", "text", "lines.*").collect()
    truth = defaultdict(set)
    for (i, t), (_, drops) in zip(rows, _line_truth(rows, 40, 5), strict=True):
        truth[(i, t)].add(tuple(drops))
    assert len(got) == len(rows)
    assert any(r.dropped for r in got)
    for r in got:
        assert truth[(r.doc_id, r.text)] == {tuple(r.dropped)}
        parts = (r.text or "").split("\n")
        assert r.n_lines == len(parts)
        assert (r.kept or "") == "\n".join(x for p, x in enumerate(parts) if p not in set(r.dropped))
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 62), 1 << 62, 5000)
    keys[:50] = 7  # equal first halves are told apart by the second
    prints = rng.integers(-(1 << 62), 1 << 62, 5000)
    rows = []
    for shard in range(3):
        own = np.mod(keys, 3) == shard
        sizes, bits, order = line_dedup.build_shard(keys[own].view(np.uint64), prints[own].view(np.uint64))
        rows.append((shard, sizes, bits.tobytes(), prints[own][order].tobytes(), np.ones(own.sum(), np.uint32).tobytes(), keys[own][order].tobytes()))
    index = line_dedup.LineIndex(3, rows)
    at = index.probe(keys, prints)
    assert sorted(at) == list(range(5000)) and (index.owners[at] == keys).all()
    assert (index.probe(rng.integers(-(1 << 62), 1 << 62, 5000), prints) == -1).mean() > 0.999


def _words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


@pytest.mark.parametrize("block", [200_000, 3])
def test_decontaminate(spark, block):
    rng = random.Random(5)
    vocabulary = ["a", "b", "C", "ä", "9", "x-y"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 13, 30])))) for k in range(12)] + [(None, "q w e"), (50, None), (3, "z z")]
    rows = [(i, " ".join(rng.choices(vocabulary, k=60)) + "! " + (rng.choice(items)[1] or "")) for i in range(30)]
    rows += [(30 + i, t) for i, t in enumerate(AWKWARD)] + [rows[0]] * 2
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(docs(spark, rows, found=1).drop("found"), bench, block_strings=block).collect()
    assert len(got) == len(rows)
    windows = [(i, tuple(w[k:k + 13])) for i, t in items for w in [_words(t)] if w for k in range(max(1, len(w) - 12))]
    by_length = defaultdict(dict)
    for i, w in windows:
        by_length[len(w)].setdefault(w, set()).add(i)
    for r in got:
        w = _words(r.text)
        hit, found = set(), set()
        for n, known in by_length.items():
            for k in range(len(w) - n + 1):
                ids = known.get(tuple(w[k:k + n]))
                if ids:
                    hit.update(range(k, k + n))
                    found |= ids
        spans = {p for s in r.found.spans for p in range(s.first, s["last"] + 1)}
        assert (r.found.n_words, r.found.n_hit, set(r.found["items"]), spans) == (len(w), len(hit), {str(i) for i in found if i is not None}, hit)
    empty = decontaminate.decontaminate(docs(spark, rows), bench.limit(0)).agg(F.sum("found.n_hit")).first()[0]
    assert empty == 0


def test_shards(spark):
    texts = [f"text {i % 37} " * (1 + i % 50) for i in range(600)] + ["copy " * 200] * 900 + AWKWARD
    rows = list(enumerate(texts)) + [(0, texts[0])] * 2 + [(None, "no id")]
    d = docs(spark, rows, size=1, shard=2)
    got = sharding.assign_shards(d).toPandas()
    assert len(got) == len(rows) and set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()
    assert set(got["shard"]) <= set(range(16))
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() - got["size"].sum() / 16 <= got["size"].max() + got["size"].sum() / 16 / sharding.WHOLE_GROUP
    want = Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert Counter(zip(got["size"], got["text_crc32"], strict=True)) == want
    assert sharding.assign_shards(d.limit(0)).count() == 0


def _places(keys, shards):
    """(shard, slot) of every (h, tie, size) by one plain walk in their order."""
    total, groups = sum(s for _, _, s in keys), Counter()
    for h, _, s in keys:
        groups[h] += s
    out, at, starts, seen = [], 0, {}, Counter()
    for h, tie, s in sorted(keys):
        starts.setdefault(h, at)
        whole = groups[h] * sharding.WHOLE_GROUP * shards <= total
        middle = 2 * starts[h] + groups[h] if whole else 2 * at + s
        shard = middle * shards // (2 * total)
        out.append(((h, tie), shard, seen[shard]))
        seen[shard] += 1
        at += s
    return out


@pytest.mark.parametrize("ranges", [64, 2048])
def test_shards_are_those_of_a_plain_walk(spark, monkeypatch, ranges):
    monkeypatch.setattr(sharding, "RANGES_PER_SHARD", ranges)
    monkeypatch.setattr(sharding, "FEWEST_ROWS", 1)
    texts = [f"group {i % 1500} " * (1 + i % 1500 % 3) for i in range(12_000)] + ["hot copy " * 40] * 800 + ["x"] * 500
    d = docs(spark, list(enumerate(texts)))
    keys = [(r.h, r.doc_id, r.n) for r in d.select(F.xxhash64("text").alias("h"), "doc_id", (F.octet_length("text") + 1).alias("n")).collect()]
    by_id = {k[1]: k[0] for k in keys}
    rows = sharding.assign_shards(d).collect()
    assert sorted(((by_id[r.doc_id], r.doc_id), r.shard, r.slot) for r in rows) == sorted(_places(keys, 16))
    shards = {}
    for r in rows:
        shards.setdefault(by_id[r.doc_id], set()).add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 2  # only the groups of hundreds of copies


def test_shards_of_the_table(spark, sf):
    got = queries.op2_sharding(spark, sf).toPandas()
    assert got["doc_id"].is_unique and len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_digest_of_kept_text(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    truth = {}
    for (i, t), (_, drops) in zip(rows, _line_truth(rows, 40, 5), strict=True):
        kept = "\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in set(drops))
        truth[i] = hashlib.sha256(kept.encode()).hexdigest()
    assert {r.doc_id: r.kept_sha256 for r in queries.op7_line_dedup(spark, sf).collect()} == truth
