"""Trained operators: held-out accuracy, a brute-force Kneser-Ney model, recall of the nearest neighbours."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from terrafacet.llm import hnsw, kneser_ney, langid, queries, shared

# -- language identification


def test_op3_is_right_on_held_out_documents(spark, sf_dir):
    docs = {r["doc_id"]: r for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    found = queries.op3_language_id(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    judged = [r for r in found if r.held_out and docs[r.doc_id]["lang"] and r.lang_pred != "und"]
    right = sum(r.lang_pred == docs[r.doc_id]["lang"] for r in judged)
    assert right >= 0.95 * len(judged)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_of_odd_texts_and_without_training_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", "a"), (2, "", "en", "b"), (3, "12 !?", None, "c"), (4, "word", None, "d")], "doc_id long, text string, lang string, score string")
    model = langid.train(docs.where("false"), F.lit(True))
    found = {r.doc_id: (r.lang_pred, r.score, r.accepted) for r in langid.predict(docs, model, "doc_id").collect()}
    assert found == dict.fromkeys([1, 2, 3, 4], ("und", 0.0, False))


def test_more_languages_than_a_model_holds_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    docs = spark.createDataFrame([(k, "some words", f"l{k % 3}") for k in range(9)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        langid.train(docs, F.lit(True))
    assert langid.train(docs.where("lang != 'l0'"), F.lit(True)).languages == ["l1", "l2"]


def test_language_of_repeated_rows_long_texts_and_columns_of_any_name(spark):
    rng = np.random.default_rng(2)
    prose = lambda sounds, n: " ".join("".join(rng.choice(sounds, 3)) for _ in range(n))
    sounds = {"aa": ["ka", "lo", "mi"], "bb": ["xy", "zu", "wä"]}
    rows = [(k, prose(sounds[x], 40), x) for k, x in enumerate(["aa", "bb"] * 40)]
    more = [(7, rows[7][1], "bb"), (100, prose(sounds["aa"], 120_000), None), (101, "kaka 9" * 3, None)]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string, lang string").selectExpr("*", "1 AS `_text`", "2 AS keep", "'x' AS `a b.c`")
    model = langid.train(docs, F.lit(True))
    found = langid.predict(docs, model, "doc_id", "text", "_text", "keep", "a b.c").collect()
    assert len(found) == len(rows) + len(more)
    for r in found:
        assert (r.lang_pred, pytest.approx(r.score)) == model.predict(r.text) and r.accepted == (r.score >= model.reject)
    assert [r.lang_pred for r in found if r.doc_id == 7] == ["bb", "bb"] and [r.lang_pred for r in found if r.doc_id == 100] == ["aa"]
    assert langid.predict(docs.where("false"), model, "doc_id").collect() == []


def test_calibration_rejects_what_is_unlike_the_held_back_texts():
    """fit keeps every fifth text of a language back; their right answers' scores set the score below which it rejects."""
    rng = np.random.default_rng(9)
    texts = [(x, " ".join("".join(rng.choice(s, 3)) for _ in range(30))) for x, s in enumerate((["ka", "lo"], ["xy", "zu"])) for _ in range(60)]
    buckets, counts = zip(*(np.unique(langid.subwords(t), return_counts=True) for _, t in texts))
    model = langid.fit(["aa", "bb"], [x for x, _ in texts], list(buckets), list(counts), 1)
    held = [t for x in (0, 1) for t in [t for y, t in texts if y == x][4::5]]
    scores = sorted(model.predict(t)[1] for t in held)
    assert model.reject == pytest.approx(min(langid.MOST_STRICT, scores[int((1 - langid.KEEP) * len(scores))]), rel=1e-5)
    assert all(model.predict(t)[0] == ("aa", "bb")[x] for x, t in texts)
    assert 0.25 <= model.temperature <= 8


# -- Kneser-Ney


def brute_model(texts: list[str], end: bool = True):
    """Perplexity by the textbook recursion over dictionaries; `end` tells whether the end mark counts in it."""
    order, marks = kneser_ney.ORDER, kneser_ney.START * (kneser_ney.ORDER - 1)
    counts = {order: Counter()}
    for text in texts:
        padded = marks + text + kneser_ney.END
        counts[order].update(padded[k : k + order] for k in range(len(padded) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(gram[1:] for gram in counts[n + 1])
    discount, total, left = {}, {}, {}
    for n, table in counts.items():
        have = Counter(table.values())
        if have[1] and have[2] and have[3]:
            y = have[1] / (have[1] + 2 * have[2])
            discount[n] = [min(max(k - (k + 1) * y * have[k + 1] / have[k], 0.1), k - 0.1) for k in (1, 2, 3)]
        else:
            discount[n] = [0.5, 1.0, 1.5]
        total[n], spent = defaultdict(int), defaultdict(float)
        for gram, c in table.items():
            total[n][gram[:-1]] += c
            spent[gram[:-1]] += discount[n][min(c, 3) - 1]
        left[n] = {ctx: spent[ctx] / total[n][ctx] for ctx in total[n]}

    def p(gram: str) -> float:
        n = len(gram)
        if n == 0:
            return 1 / (len(counts[1]) + 1)
        if gram[:-1] not in total[n]:
            return p(gram[1:])
        c = counts[n][gram]
        own = (c - discount[n][min(c, 3) - 1]) / total[n][gram[:-1]] if c else 0.0
        return own + left[n][gram[:-1]] * p(gram[1:])

    def perplexity(text: str) -> float:
        padded = marks + text + kneser_ney.END
        logs = [math.log(p(padded[k : k + order])) for k in range(len(padded) - order + end)]
        return math.exp(-sum(logs) / len(logs))

    return perplexity


TRUSTED = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "über den Fluß und in die Wälder", "the end"] * 2 + ["one more cat on one more mat", ""]
ASKED = ["the cat on the log", "zzz qqq 漢字", "", None, "Wälder", "the cat sat on the mat " * 40]


@pytest.mark.parametrize("shard_rows", [4_000_000, 150])
def test_perplexity_equals_the_textbook_form(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(kneser_ney, "SHARD_ENTRIES", shard_rows)
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in [*TRUSTED, None]], "text string"))
    docs = spark.createDataFrame(list(enumerate(ASKED)), "doc_id long, text string")
    found = {r.doc_id: r for r in kneser_ney.score(docs, model, "doc_id").collect()}
    plain = brute_model([t for t in TRUSTED if t])
    words = brute_model([kneser_ney.recurrence(t) for t in TRUSTED if t], end=False)
    for k, text in enumerate(ASKED):
        assert found[k].perplexity == (pytest.approx(plain(text), rel=1e-4) if text else None), text
        assert found[k].word_perplexity == (pytest.approx(words(kneser_ney.recurrence(text)), rel=1e-4) if text else None), text


def quantile(values: list[float], q: float) -> float:
    """The least value with at least a share q of all at or below it."""
    return sorted(values)[max(0, math.ceil(q * len(values)) - 1)]


def held(doc_id: int) -> bool:
    """Whether a document is kept out of the counts."""
    return zlib.crc32(str(doc_id).encode()) % kneser_ney.HELD_OUT_FOLDS == 0


def test_thresholds_and_decisions_equal_a_plain_form(spark):
    """Three languages: one with many held-out trusted documents, one with few, one with none in the held-out folds."""
    rng = np.random.default_rng(8)
    free = [d for d in range(1000, 1100) if not held(d)]
    langs = {**{d: "a" for d in range(150)}, **{d: "b" for d in range(150, 190)}, **{d: "c" for d in free[:20]}}
    docs = [(d, " ".join(rng.choice(["ka", "lo", "mi", "ne", "ru"], rng.integers(3, 40))), lang) for d, lang in langs.items()]
    trusted = {d for d in langs if d % 7}
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    found = kneser_ney.classify(frame, spark.createDataFrame([(d,) for d in trusted], "doc_id long")).collect()
    assert len(found) == len(docs)
    for of, name in zip(kneser_ney.NAMES, kneser_ney.LIMITS):
        usual, own = {}, {}
        for lang in "abc":
            mine = [r for r in found if r.lang == lang]
            usual[lang] = quantile([r[of] for r in mine if held(r.doc_id)] or [r[of] for r in mine], 0.5)
            own[lang] = [r[of] for r in mine if held(r.doc_id) and r.doc_id in trusted]
        ratio = quantile([v / usual[lang] for lang in "abc" for v in own[lang]], kneser_ney.QUANTILE)
        assert len(own["a"]) >= kneser_ney.LEAST_HELD_OUT and len(own["b"]) in range(1, kneser_ney.LEAST_HELD_OUT) and not own["c"]
        want = {"a": quantile(own["a"], kneser_ney.QUANTILE), "b": usual["b"] * ratio, "c": usual["c"] * ratio}
        assert all(r[name] == pytest.approx(want[r.lang], rel=1e-9) for r in found)
    assert all(r.kept == (r.perplexity <= r.threshold and r.word_perplexity <= r.word_threshold) for r in found)


def test_thresholds_are_exact_over_many_documents(spark):
    """More values than an approximate quantile holds, dealt to several tasks; ties, and nulls that count for nothing."""
    value = "CASE WHEN id % 9 = 4 THEN NULL ELSE 2 + (id * 7919 % 499979) / CASE WHEN id % 3 = 0 THEN 1 ELSE 7e0 END END"
    scored = spark.range(500_000).repartition(4).selectExpr("id AS doc_id", "CASE WHEN id < 499900 THEN 'a' ELSE 'b' END AS lang", "CAST(2 + id * 7919 % 499979 AS DOUBLE) AS perplexity", f"CAST({value} AS DOUBLE) AS word_perplexity")
    trusted = spark.range(500_000).where("id % 4 > 0 AND (id < 499900 OR id % 10 = 1)").selectExpr("id AS doc_id")
    rows = [r for r in scored.collect() if held(r.doc_id)]
    found = {r.lang: r for r in kneser_ney.thresholds(scored, trusted).collect()}
    assert set(found) == {"a", "b"}
    for of, name in zip(kneser_ney.NAMES, kneser_ney.LIMITS):
        given = [r for r in rows if r[of] is not None]
        own = [r for r in given if r.doc_id % 4 > 0 and (r.doc_id < 499_900 or r.doc_id % 10 == 1)]
        assert 0 < sum(r.lang == "b" for r in own) < kneser_ney.LEAST_HELD_OUT
        usual = {lang: quantile([r[of] for r in given if r.lang == lang], 0.5) for lang in "ab"}
        assert found["a"][name] == quantile([r[of] for r in own if r.lang == "a"], kneser_ney.QUANTILE)
        assert found["b"][name] == usual["b"] * quantile([r[of] / usual[r.lang] for r in own], kneser_ney.QUANTILE)


def test_ids_in_several_broadcasts_or_by_a_shuffle(spark):
    docs = spark.createDataFrame([(d if d >= 0 else None, f"t{d}", "x") for d in [-1, -1, *range(300), 5, 5]], "doc_id long, text string, low string")
    ids = spark.createDataFrame([(d,) for d in [*range(0, 400, 3), 3, 3, None]], "doc_id long")
    want = sorted([f"t{d}" for d in range(0, 300, 3)])
    for most, passes in ((1000, 4), (30, 16), (30, 2)):
        assert sorted(r.text for r in shared.with_ids(docs, ids, most, passes).collect()) == want
    assert shared.with_ids(docs, ids.where("false")).collect() == []


def test_shards_keep_their_bound(spark):
    """Every n-gram of 3 or more has an 'a' before its last character, whatever the context."""
    rng = np.random.default_rng(6)
    texts = ["a".join(rng.choice(list("bcdefghijklmnopqrstuvwxyz"), 60)) for _ in range(150)]
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    entries, shards = model.count(), 8
    sizes = [len(kneser_ney.load_shard(kneser_ney.keyed(model, shards), k).key) for k in range(shards)]
    assert sum(sizes) == entries and max(sizes) <= 1.5 * entries / shards


def test_classify_odd_rows_and_no_trusted_text(spark):
    docs = spark.createDataFrame([(1, None, None, "k"), (1, "x", "en", "k"), (None, "y", "en", "k"), (3, "", "fr", "k")], "doc_id long, text string, lang string, kept string")
    none = spark.createDataFrame([], "doc_id long")
    found = kneser_ney.classify(docs, none).collect()
    assert len(found) == 4 and not any(r.kept for r in found)
    some = kneser_ney.classify(docs, spark.createDataFrame([(1,), (1,)], "doc_id long")).collect()
    assert sorted((r.doc_id or 0, r.kept) for r in some) == [(0, True), (1, False), (1, True), (3, False)]


@pytest.mark.parametrize("some", [lambda d: not held(d), held, lambda d: d in (6, 12)], ids=["none held out", "all held out", "two in one fold"])
def test_trusted_texts_have_thresholds_whatever_their_folds(spark, some):
    """Without trusted text in the fold that is held out all texts were kept, and with all of it there none."""
    rng = np.random.default_rng(4)
    prose = lambda: " ".join("".join(rng.choice(["ka", "lo", "mi", "ne", "ru", "sa"], 2)) for _ in range(60))
    trusted = [d for d in range(400) if some(d)]
    docs = [(d, prose(), "xx") for d in range(400)] + [(900 + k, "#5!9$7&3%1" * 30, "xx") for k in range(5)]
    found = kneser_ney.classify(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([(d,) for d in trusted], "doc_id long")).collect()
    assert len(found) == 405 and all(r.threshold is not None and r.word_threshold is not None for r in found)
    assert not any(r.kept for r in found if r.doc_id >= 900)
    assert sum(r.kept for r in found if r.doc_id in trusted) >= 0.5 * len(trusted)


def test_a_single_trusted_text_is_counted_whatever_its_fold(spark):
    docs = spark.createDataFrame([(6, "one text", "en"), (7, "text one", "en")], "doc_id long, text string, lang string")
    for one_ in (6, 7):
        found = kneser_ney.classify(docs, docs.where(F.col("doc_id") == one_).select("doc_id")).collect()
        assert all(r.kept and r.perplexity is not None and r.threshold is None for r in found)


def test_op9_keeps_good_documents(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf_dir}/labels.parquet").to_pylist()}
    found = queries.op9_kneser_ney(spark, sf_dir).collect()
    assert len(found) == pq.read_metadata(f"{sf_dir}/documents.parquet").num_rows
    good = [r.kept for r in found if labels.get(r.doc_id) == 1]
    assert sum(good) >= 0.97 * len(good)


def test_op9_rejects_bad_documents(spark):
    sf_dir = "/root/testdata/sf0.01"  # English has enough held-out documents here
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf_dir}/labels.parquet").to_pylist()}
    found = [r for r in queries.op9_kneser_ney(spark, sf_dir).collect() if r.lang == "en"]
    bad = [r.kept for r in found if labels.get(r.doc_id) == 0]
    good = [r.kept for r in found if labels.get(r.doc_id) == 1]
    assert sum(bad) <= 0.05 * len(bad) and sum(good) >= 0.97 * len(good)


def test_repeated_words_cost_perplexity(spark):
    vocabulary = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "sa") for b in ("ba", "de", "fi", "go", "tu")]
    rng = np.random.default_rng(3)
    clean = [" ".join(rng.choice(vocabulary, 60)) for _ in range(200)]
    texts = [*clean, "kaba " * 60, "kaba lode\n" * 30, "kaba", "kaba lode"]
    docs = spark.createDataFrame([(k, t, "xx") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in kneser_ney.classify(docs, docs.where("doc_id < 200").select("doc_id")).collect()}
    assert sum(found[k].kept for k in range(200)) >= 190
    assert not found[200].kept and not found[201].kept
    assert all(found[k].word_perplexity <= found[k].word_threshold for k in (202, 203))


def test_languages_with_little_trusted_text_have_thresholds(spark):
    rng = np.random.default_rng(5)
    prose = lambda sounds: " ".join("".join(rng.choice(sounds, 2)) for _ in range(60))
    common, rare = ["ka", "lo", "mi", "ne", "ru", "sa"], ["xy", "zo", "wu", "qi", "vä", "jö"]
    docs = [(k, prose(common), "xx") for k in range(200)] + [(k, prose(rare), None) for k in range(200, 215)]
    docs += [(300, "#5!9$7&3%1" * 30, None), (301, "xyzo " * 80, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in kneser_ney.classify(frame, frame.where("doc_id < 215").select("doc_id")).collect()}
    assert found[210].threshold is not None and found[210].word_threshold is not None
    assert not found[300].kept and not found[301].kept
    assert sum(found[k].kept for k in range(200, 215)) >= 13


# -- nearest neighbours


def brute_nearest(rows, queries_, k):
    unit = {i: np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) for i, v in rows}
    out = {}
    for q in queries_:
        scored = sorted(((-float(unit[q] @ v), i) for i, v in unit.items() if i != q and len(v) == len(unit[q])))
        out[q] = [i for _, i in scored[:k]]
    return out


def test_op10_recall(spark, sf_dir):
    table = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pylist()
    rows = [(r["vec_id"], r["embedding"]) for r in table]
    want = brute_nearest(rows, [i for i, _ in rows if i % 50 == 0], 5)
    found: dict = {}
    for r in sorted(queries.op10_hnsw(spark, sf_dir).collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
    hits = sum(len({*want[q]} & {*found[q]}) for q in want)
    assert found.keys() == want.keys() and hits >= 0.9 * 5 * len(want)


def test_several_shards_copies_ties_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 60)
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=6).round(3).tolist()) for k in range(200)] + [(k, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0]) for k in range(200, 260)]
    bad = [(300, None), (301, [0.0] * 6), (302, [float("nan")] * 6), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (304, [float("inf")] * 6), (305, []), (None, [1.0] * 6), (250, rows[250][1])]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    found: dict = {}
    for r in sorted(hnsw.nearest(frame, frame.where("vec_id % 50 = 0"), 5).collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
    want = brute_nearest([(i, np.float32(v)) for i, v in rows], [0, 50, 100, 150], 5)
    assert found[200] == [201, 202, 203, 204, 205] and found[250] == [200, 201, 202, 203, 204]
    assert sum(len({*want[q]} & {*found[q]}) for q in want) >= 18
    assert set(found) == {0, 50, 100, 150, 200, 250}


def test_scores_are_of_the_original_doubles_and_scaled_copies_tie(spark):
    rng = np.random.default_rng(7)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(100, 140)]
    rows += [(k, [v * 2.0**p for v in (0.1, 0.2, 0.3, 0.4)]) for k, p in zip(range(30), rng.permutation(np.arange(-15, 15)).tolist())]
    rows += [(200, [1e200, 2e200, 0.0, 0.0]), (201, [1e-200, 2.0000001e-200, 0.0, 0.0])]
    frame = spark.createDataFrame([(k, v, "x") for k, v in rows], "vec_id long, embedding array<double>, score string")
    found: dict = {}
    for r in sorted(hnsw.nearest(frame, frame.where("vec_id in (29, 200)"), 5).collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert [i for i, _ in found[29]] == [0, 1, 2, 3, 4] and len({s for _, s in found[29]}) == 1
    a, b = (1.0, 2.0), (1.0, 2.0000001)
    assert found[200][0][0] == 201 and found[200][0][1] == pytest.approx(sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b), abs=1e-15)


def test_no_vectors(spark):
    frame = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert hnsw.nearest(frame, frame, 5).collect() == []


def test_a_model_of_one_shard_passes_through_the_driver_once(spark, monkeypatch):
    """Thresholds and verdicts are scored by one broadcast."""
    loaded, load = [], kneser_ney.load_shard
    monkeypatch.setattr(kneser_ney, "load_shard", lambda table, shard: (loaded.append(shard), load(table, shard))[1])
    docs = spark.createDataFrame([(k, f"plain words of text {k % 7}", "en") for k in range(60)], "doc_id long, text string, lang string")
    found = kneser_ney.classify(docs, docs.select("doc_id")).collect()
    assert len(found) == 60 and all(r.threshold is not None for r in found)
    assert loaded == [0]


def test_a_model_is_put_together_by_one_scan_of_all_orders(spark, monkeypatch):
    """Each scan sends a configuration from the driver; there were eleven at once, whose buffers made the driver's heap grow."""
    plans, write = [], kneser_ney.stored
    monkeypatch.setattr(kneser_ney, "stored", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, name))[1])
    model = kneser_ney.train(spark.createDataFrame([("plain words",), ("plain text",)], "text string"))
    assert [plan.count("Relation [") for plan in plans] == [3]
    sizes = model.groupBy("size").agg(*(F.count(F.when(F.col("context") == c, 1)).alias(n) for c, n in ((False, "grams"), (True, "contexts")))).collect()
    assert {r.size for r in sizes if r.grams} == set(range(kneser_ney.ORDER + 1))
    assert {r.size for r in sizes if r.contexts} == set(range(kneser_ney.ORDER))
