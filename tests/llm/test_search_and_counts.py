"""Clusters, ranked search and token counts against brute force, SQL and the tokenizers library."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import regex
from tokenizers import Tokenizer

from terrafacet.llm import ball_trees, bpe, lexical, queries, token_counts

# -- ball trees


def plain_clusters(rows, dim=64, scale=64, k=16, rounds=3):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted(((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None))
    centroids = [v for _, v in named[:k]]
    far = lambda v, z: sum((a - b) ** 2 for a, b in zip(v, z))
    for turn in range(rounds + 1):
        labels = [min((far(v, z), c) for c, z in enumerate(centroids)) for _, v in kept]
        if turn < rounds:
            for c in range(len(centroids)):
                mine = [v for (_, v), (_, label) in zip(kept, labels) if label == c]
                if mine:
                    centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    share = Counter()
    for d, c in labels:
        share[c] += d
    digest = [hashlib.sha256(",".join(map(str, z)).encode()).hexdigest() for z in centroids]
    return sorted(((i, c, d, share[c], sum(share.values()), digest[c]) for (i, _), (d, c) in zip(kept, labels)), key=str)


def clusters(spark, rows, **more):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS v", "'x' AS cluster")
    return sorted(map(tuple, ball_trees.cluster(vectors, **more).collect()), key=str)


def test_op11_equals_sql_and_a_plain_run(spark, sf_dir, same):
    same(queries.QUERIES["op11_ball_tree_clusters"], queries.ORACLES["op11_ball_tree_clusters"])
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{sf_dir}/embeddings.parquet").to_pylist()]
    found = queries.op11_ball_tree_clusters(spark, sf_dir).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert sorted(map(tuple, found), key=str) == plain_clusters(rows)


def test_clusters_of_groups_ties_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(5, 4)) * 3
    rows = [(i, (middles[i % 5] + rng.normal(size=4) * 0.05).astype(np.float32).tolist()) for i in range(600)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(300)] + [(7, [1.0, 2.0, 3.0, 4.0])] * 2 + [(None, [9.0, 9.0, 9.0, -9.0])]
    odd = [(2000, None), (2001, []), (2002, [1.0, None, 1.0, 1.0]), (2003, [1.0, float("nan"), 0.0, 0.0]), (2004, [1.0, 2.0, float("inf"), 0.0]), (2005, [1.0] * 5), (2006, [-0.0] * 4)]
    want = plain_clusters(rows + odd, dim=4, k=6)
    assert clusters(spark, rows + odd, dim=4, k=6) == want and len(want) == len(rows) + 1
    assert clusters(spark, [], dim=4) == [] and clusters(spark, odd[:6], dim=4) == []
    assert clusters(spark, rows[:3], dim=4) == plain_clusters(rows[:3], dim=4)
    with pytest.raises(Exception, match="beyond"):
        clusters(spark, [(1, [3e30] * 4)], dim=4)


def test_balls_go_whole_and_alike():
    """Well separated groups are assigned without looking at one point, with the labels of brute force; large components are exact."""
    rng = np.random.default_rng(5)
    middles = rng.integers(-1000, 1000, (4, 8))
    points = np.concatenate([m + rng.integers(-3, 4, (500, 8)) for m in middles])
    order, nodes = ball_trees.build(points)
    tree = ball_trees.Tree(pa.array(order), points[order].astype(np.int32), **nodes)
    whole, single = tree.assign(middles)
    assert sum(len(n) for n, _ in whole) > 0 and sum(len(r) for r, _ in single) < 100
    assert (tree.labels(middles) == ((tree.points[:, None] - middles) ** 2).sum(2).argmin(1)).all()
    assert (nodes["sums"][0] == points.sum(0)).all() and nodes["squares"][0] == (points**2).sum()
    big = rng.integers(-(1 << 26), 1 << 26, (40, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, c)) for c in big[:5]] for p in big]
    assert ball_trees.squared_distances(big, big[:5]).tolist() == want


# -- ranked search


def plain_ranking(docs, items, k):
    words = lambda t: re.findall(lexical.TERM, (t or "").translate(str.maketrans(lexical.UPPER, lexical.LOWER)))
    counted = [(i, Counter(words(t))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(words(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in counted:
            m = 50 + 50 * sum(c.values()) * n_docs // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -score) for rank, (score, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def ranking(spark, docs, items, k, parts=3, **more):
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string").selectExpr("*", "1 AS term", "2 AS block", "'x' AS score").repartition(parts)
    index, documents, _ = lexical.build_index(frame(docs, "doc_id"))
    return sorted(map(tuple, lexical.search(index, documents, frame(items, "item_id"), k, **more).collect()))


def test_op12_equals_sql(same):
    same(queries.QUERIES["op12_bit_sliced_search"], queries.ORACLES["op12_bit_sliced_search"])


def invented(seed, n, words=60):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(["The", "the", "É", "é", "漢字", "x1", *map(str, range(40))]) for _ in range(rng.randrange(words)))) for i in range(n)]


def test_ranking_equals_a_plain_run_over_several_blocks_and_passes(spark, monkeypatch):
    docs, items = invented(1, 900), [(10 * i, t) for i, t in invented(2, 40, 20)]
    want = plain_ranking(docs, items, 50)
    assert ranking(spark, docs, items, 50) == want
    assert ranking(spark, docs, items, 50, parts=17, pass_terms=90) == want
    assert ranking(spark, docs, items, 3) == plain_ranking(docs, items, 3)


def test_ranking_of_odd_rows_ties_and_empty_tables(spark):
    copies = [(i, "same words here") for i in range(500, 0, -1)]
    docs = copies + [(4, "same words here"), (None, "same words here"), (600, None), (601, ""), (602, "!? ,"), (603, "long " * 200_000 + "words"), (604, "a\x00b\x7fc"), (605, "rare same")]
    items = [(1, "Same WORDS words"), (2, None), (3, "unknown"), (1, "rare"), (None, "same"), (5, "a\x00b"), (5, "a\x00b"), (6, " ".join(map(str, range(3000))) + " rare")]
    assert ranking(spark, docs, items, 50) == plain_ranking(docs, items, 50)
    assert ranking(spark, docs, items, 1000) == plain_ranking(docs, items, 1000)
    assert ranking(spark, [], items, 50) == [] and ranking(spark, docs, [], 50) == []
    assert ranking(spark, docs[501:504], items, 50) == plain_ranking(docs[501:504], items, 50)


def test_slices_add_multiply_and_rank_like_numbers():
    rng = np.random.default_rng(1)
    values, factors = rng.integers(0, 1 << 20, (3, 130)), np.array([0, 1, 28_001])
    width = 192
    bits = np.zeros((20, 3, width), np.uint8)
    bits[:, :, :130] = values >> np.arange(20)[:, None, None] & 1
    packed = np.packbits(bits, axis=2, bitorder="little").view(np.uint64)
    times = lexical.multiply(packed, factors)
    sums = np.concatenate([times, np.zeros((2, *times.shape[1:]), np.uint64)])
    lexical.add(sums, packed)
    for row in range(3):
        got = lexical.values_at(np.ascontiguousarray(sums[:, row]), np.arange(130))
        assert got.tolist() == (values[row] * (factors[row] + 1)).tolist()
        surely, maybe = lexical.top_k(sums[:, row : row + 1], 20)
        sure = lexical.set_bits(surely[0]).tolist()
        assert sorted(sure + lexical.set_bits(maybe[0])[: 20 - len(sure)].tolist()) == sorted(np.argsort(-got, kind="stable")[:20].tolist())


# -- token counts

ODD = [None, "", " ", "\n\n  x", "a" * 5000, "<|endoftext|>a <|endoftext|>", "<|endo", "ftext|>", "it's we'LL 12345678901", "éèüß Ω 漢字 🙂👍🏽", "   tab\t", "x\x00y\x00\x00", "word " * 3000, "!?" * 200, "　  a's 's", "''s '' 't"]


def test_op13_equals_the_library(spark, sf_dir):
    library = Tokenizer.from_file(queries.BYTE_BPE)
    docs = pq.read_table(f"{sf_dir}/documents.parquet").select(["doc_id", "text"]).to_pylist()
    counts = {d["doc_id"]: (len((d["text"] or "").encode()), len(library.encode(d["text"] or "", add_special_tokens=False).ids)) for d in docs}
    found = {tuple(r) for r in queries.op13_token_counts(spark, sf_dir).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()}
    assert found == {(i, b, n, n > 512) for i, (b, n) in counts.items()}


@pytest.mark.parametrize("entries,cache", [(1 << 16, 100_000), (4, 3)])
def test_counts_of_odd_texts_with_any_table(spark, monkeypatch, entries, cache):
    monkeypatch.setattr(token_counts, "TABLE_ENTRIES", entries)
    monkeypatch.setattr(token_counts, "CACHE_WORDS", cache)
    monkeypatch.setattr(token_counts, "CHUNK_BYTES", 100)
    rows = [(k, t, "x", 1) for k, t in enumerate(ODD)] + [(3, ODD[3], "y", 2), (None, "no id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n_tokens int").repartition(3)
    library = Tokenizer.from_file(queries.BYTE_BPE)
    want = sorted(((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _, _ in rows), key=str)
    found = token_counts.count_tokens(docs, queries.BYTE_BPE, 2).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in found), key=str) == want
    assert all(r.over_limit == (r.n_tokens > 2) for r in found)
    assert token_counts.count_tokens(docs.where("false"), queries.BYTE_BPE, 2).collect() == []


def test_pre_tokens_equal_the_pattern():
    cut, rng = regex.compile(bpe.PATTERN).findall, random.Random(4)
    letters = list("ab1 2'' \n\tstremvdl!?é漢　 🙂٣ ")
    for _ in range(4000):
        texts = ["".join(rng.choices(letters, k=rng.randrange(14))) for _ in range(rng.randrange(1, 4))]
        raw, ends = "".join(texts).encode(), np.cumsum([0] + [len(t.encode()) for t in texts])
        begins = token_counts.pre_tokens(np.frombuffer(raw, np.uint8), ends[ends < len(raw)])
        assert [raw[a:b].decode() for a, b in zip(begins, [*begins[1:], len(raw)])] == [w for t in texts for w in cut(t)], texts


def test_length_table_finds_all_and_only_its_words():
    rng = random.Random(8)
    words = list({bytes(rng.choices(range(97, 100), k=rng.randrange(1, 17))) for _ in range(3000)} | {b"\0", b"\0\0"})
    table = token_counts.LengthTable.of(words[:2000], [1 + len(w) % 7 for w in words[:2000]])
    size = np.array(list(map(len, words)))
    found = table(*token_counts.keys_of(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size))
    assert found.tolist() == [1 + len(w) % 7 if k < 2000 else 0 for k, w in enumerate(words)]
