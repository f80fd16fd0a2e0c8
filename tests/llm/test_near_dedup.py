"""Near-duplicate components against brute force on all pairs of full sets."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from terrafacet.llm import near_dedup

SCHEMA = "doc_id long, text string, id string, key long"


def shingles(text: str | None) -> set:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows: list[tuple[int, str | None]], percent: int) -> list[tuple]:
    sets = {}
    for doc_id, text in rows:
        sets.setdefault(doc_id, []).append(shingles(text))
    parent = {d: d for d in sets}

    def root(d: int) -> int:
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(x and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return sorted((d, len(shingles(t)), root(d), root(d) == d) for d, t in rows)


def near_copies(seed: int, groups: int, copies: int, words: int, changes: int) -> list[str]:
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(copies):
            one = list(base)
            for _ in range(rng.randrange(changes + 1)):
                one[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(one))
    return texts


def run(spark, rows, percent):
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in near_dedup.near_duplicates(docs, percent).select("doc_id", "n_shingles", "component_id", "kept").collect())


@pytest.mark.parametrize("percent,changes", [(85, 5), (80, 9)])
def test_components_equal_brute_force(spark, percent, changes):
    rows = list(enumerate(near_copies(percent, 12, 12, 120, changes)))
    assert run(spark, rows, percent) == brute(rows, percent)


def test_hot_group_of_copies_just_below_the_threshold(spark, monkeypatch):
    # pairs lie on both sides of 85 percent, so that many go past the first partners, in several groups
    monkeypatch.setattr(near_dedup, "GROUP_ROWS", 64)
    rows = list(enumerate(near_copies(3, 1, 150, 160, 4)))
    assert run(spark, rows, 85) == brute(rows, 85)


def test_rows_of_buckets_are_not_joined_with_their_seekers(spark):
    """Each row of a bucket meets its set once, and the pick of that set, and nothing else."""
    rows = spark.createDataFrame([(1, k, k % 3, 9, 6, 0) for k in range(9)], "key long, id long, component long, n long, s long, main long")
    sets = spark.createDataFrame([(k, [k] * near_dedup.FINE_WORDS) for k in range(9)], "id long, fine array<long>")
    found = near_dedup.partner_pairs(rows, rows.where("component != main"), sets, 8, 1 << 12)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "LeftOuter" not in plan and len(re.findall("Join", plan)) <= 2
    assert {(r.seeker, r.id) for r in found.collect()} == {(a, b) for a in range(9) for b in range(9) if a % 3 and a % 3 != b % 3}


def test_sets_of_repeated_rows_are_read_from_a_table(spark):
    """Each later step repeats the plan of the sets, so that it has to be a scan, whose size the driver doesn't feel."""
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "d e")], "doc_id long, text string")
    with near_dedup.Scratch(spark) as scratch:
        picks = scratch.stored(docs.select(near_dedup.row_pick(near_dedup.F.col("doc_id"), near_dedup.text_tie()).alias("pick")), "picks")
        sets = near_dedup.member_sets(docs, picks, scratch)
        assert not re.search("Join|Aggregate|Union", sets._jdf.queryExecution().analyzed().toString())
        assert sets.count() == sets.select("id").distinct().count() == 2


def test_long_texts_are_cut_by_weight(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "GROUP_SHINGLES", 2000)
    rows = list(enumerate(near_copies(9, 2, 24, 700, 20)))
    assert run(spark, rows, 85) == brute(rows, 85)


def test_edge_cases(spark):
    text = "one two three four five six seven"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  b"), (6, text), (6, text), (7, text.upper()), (8, "é É " * 30), (9, "\x85 a")]
    assert run(spark, rows, 85) == brute(rows, 85)
    assert run(spark, [], 85) == []


def test_rows_without_doc_id(spark):
    docs = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (None, "lone words"), (None, None)], "doc_id long, text string")
    found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, 85).collect()}
    assert found == {(4, 1, 4, True), (None, 1, 4, False), (None, 1, None, True), (None, 0, None, True)}


def test_keep_one_keeps_the_least_of_each_group_and_all_columns(spark):
    texts = near_copies(5, 6, 5, 80, 1)
    rows = list(enumerate(texts)) + [(100, None), (101, "")]
    docs = spark.createDataFrame([(d, t, "x", d) for d, t in rows], SCHEMA)
    kept = near_dedup.keep_one(docs, 80)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [d for d, _, _, k in brute(rows, 80) if k]


def test_components_end_with_the_round_that_makes_stars(spark, monkeypatch):
    """No further round, with its joins and broadcasts, is run to see that nothing changes."""
    rounds, write = [], near_dedup.Scratch.stored
    monkeypatch.setattr(near_dedup.Scratch, "stored", lambda self, df, name: (rounds.append(name), write(self, df, name))[1])
    for edges, most in (([(k, 0) for k in range(1, 9)], 1), ([(k, k + 1) for k in range(60)], 8)):
        rounds.clear()
        with near_dedup.Scratch(spark) as scratch:
            found = near_dedup.components(spark.createDataFrame(edges, "a long, b long"), scratch)
            ends = {x for e in edges for x in e} - {0}
            assert sorted(map(tuple, found.collect())) == [(k, 0) for k in sorted(ends)]
        assert 1 <= rounds.count("stars") <= most


def test_a_round_of_components_reads_its_edges_four_times_at_most(spark, monkeypatch):
    plans, write = [], near_dedup.Scratch.stored
    monkeypatch.setattr(near_dedup.Scratch, "stored", lambda self, df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(self, df, name))[1])
    with near_dedup.Scratch(spark) as scratch:
        edges = write(scratch, spark.createDataFrame([(1, 2), (3, 2), (3, 3), (9, 7), (7, 8), (2, 1)], "a long, b long"), "edges")
        found = near_dedup.components(edges, scratch)
        assert sorted(map(tuple, found.collect())) == [(2, 1), (3, 1), (8, 7), (9, 7)]
    assert plans and all(plan.count("Relation [") <= 4 for plan in plans)


def test_words_that_a_polynomial_hash_confuses(spark):
    """Thue-Morse words of 1024 letters and their complements are alike to every polynomial modulo 2 ** 64."""
    morse = "".join("ab"[k.bit_count() & 1] for k in range(1024))
    swapped = morse.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{morse} one two three four"), (2, f"{swapped} one two three four"), (3, " ".join([morse, swapped] * 4)), (4, " ".join([morse] * 8))]
    assert run(spark, rows, 85) == brute(rows, 85)
    assert [r[1] for r in run(spark, rows, 85)] == [1, 1, 2, 1]


def test_keep_one_judges_repeated_doc_ids_by_their_texts(spark):
    rows = [(3, "one two three four five six"), (5, "one two  three four five six"), (5, "a lone text under a repeated number"), (7, "x y z"), (7, "X y z"), (None, None), (None, None), (None, ""), (8, ""), (None, "x y z")]
    docs = spark.createDataFrame([(d, t, "a", "b", "c", "d") for d, t in rows], "doc_id long, text string, tie string, words string, least string, row string")
    kept = near_dedup.keep_one(docs, 80)
    assert kept.columns == docs.columns
    found = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert [f for f in found if f[0] != 7] == [(0, ""), (0, ""), (0, ""), (3, rows[0][1]), (5, rows[2][1]), (8, "")]
    assert [f[1].lower() for f in found if f[0] == 7] == ["x y z"]
    assert sorted((r.doc_id or 0, r.text or "") for r in near_dedup.keep_one(docs.repartition(7), 80).collect()) == found


def test_large_ids_and_texts_under_one_id(spark):
    """Any 64-bit number is an id; an unrelated text under the id of a near copy stays."""
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    huge = (1 << 62) + 5
    rows = [(huge, "alpha beta gamma"), (-5, "delta"), ((1 << 63) - 1, text), (-(1 << 63), "lone words of the least id")]
    rows += [(3, "a " + text), (7, text + " b"), (7, "an unrelated text that has words of its own"), (9, "an unrelated text that has words of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(tuple, near_dedup.near_duplicates(docs, 80).drop("n_shingles").collect()))
    assert found == sorted([(huge, huge, True), (-5, -5, True), ((1 << 63) - 1, 3, False), (-(1 << 63), -(1 << 63), True), (3, 3, True), (7, 3, False), (7, 7, True), (9, 7, False)])
    assert sorted(map(tuple, near_dedup.keep_one(docs, 80).collect())) == sorted([rows[0], rows[1], rows[3], rows[4], rows[6]])


def test_repeated_rows_of_a_hot_group(spark):
    texts = near_copies(11, 1, 30, 100, 3)
    rows = [(k % 30, texts[k % 30]) for k in range(600)]
    assert run(spark, rows, 85) == brute(rows, 85)


def test_op5_equals_brute_force(spark):
    """The query over all documents of sf0.01, against all pairs by an inverted list of shingles."""
    import pyarrow.parquet as pq

    from terrafacet.llm import queries

    where = "/root/testdata/sf0.01"
    docs = pq.read_table(f"{where}/documents.parquet").select(["doc_id", "text"]).to_pylist()
    sets = {d["doc_id"]: shingles(d["text"]) for d in docs}
    holders, common = {}, {}
    for i in sorted(sets):
        for s in sets[i]:
            for j in holders.setdefault(s, []):
                common[j, i] = common.get((j, i), 0) + 1
            holders[s].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (j, i), n in common.items():
        if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    want = sorted((i, len(s), find(i), find(i) == i) for i, s in sets.items())
    found = queries.op5_odd_sketch_dedup(spark, where).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, found)) == want and any(not w[3] for w in want)


def test_odd_sketch_difference_follows_similarity():
    import numpy as np

    words = near_dedup.word_hashes(pa.array([" ".join(map(str, range(2000)))]))[0]
    a, b = near_dedup.mix(words[:1000]), near_dedup.mix(words[100:1100])
    sketch = [near_dedup.odd_sketch(near_dedup.minhashes(x, 1024), 64) for x in (a, b)]
    differ = int(np.bitwise_count((sketch[0] ^ sketch[1]).view(np.uint64)).sum())
    assert differ <= near_dedup.most_different_bits(0.8, 1024, 64)
    assert differ > near_dedup.most_different_bits(0.99, 1024, 64)


def test_bitmaps_grow_with_their_ids_up_to_a_bound(spark, monkeypatch):
    few = spark.range(-500, 500)
    small = near_dedup.bitmap_of(few)
    monkeypatch.setattr(near_dedup, "BITMAP_BITS", 1 << 12)
    least = near_dedup.bitmap_of(few)
    assert (32 * len(small), 32 * len(least)) == (1 << 17, 1 << 12)
    for bitmap in (small, least):
        assert near_dedup.in_bitmap(bitmap, np.arange(-500, 500)).all()
    assert near_dedup.in_bitmap(small, np.arange(10_000, 110_000)).mean() < 0.02
    assert len(near_dedup.bitmap_of(few.where("id > 500"))) == 1 << 5
