"""Each stage of the corpus pipeline against a plainer form of its decision."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from terrafacet.llm import bpe, kneser_ney, langid, mixing
from terrafacet.llm.queries import BYTE_BPE
from terrafacet.llm.shared import stored
from tests.llm.test_models import brute_model, held, quantile
from tests.llm.test_near_dedup import brute


def plain_quality(docs: list, trusted: set) -> dict:
    """For each doc_id: how far it is from its language's nearer threshold, as a ratio; kept up to 1."""
    worst = {d.doc_id: 0.0 for d in docs}
    for read, end in zip(kneser_ney.READ, kneser_ney.ENDS):
        perplexity = brute_model([read(d.text) for d in docs if d.doc_id in trusted and not held(d.doc_id) and d.text], end)
        scored = [(d, perplexity(read(d.text))) for d in docs if read(d.text)]
        usual, own = {}, defaultdict(list)
        for lang in {d.lang for d, _ in scored}:
            mine = [(d, p) for d, p in scored if d.lang == lang]
            usual[lang] = quantile([p for d, p in mine if held(d.doc_id)] or [p for _, p in mine], 0.5)
            own[lang] = [p for d, p in mine if held(d.doc_id) and d.doc_id in trusted]
        ratio = quantile([p / usual[lang] for lang, found in own.items() for p in found], kneser_ney.QUANTILE)
        for d, p in scored:
            few = len(own[d.lang]) < kneser_ney.LEAST_HELD_OUT
            worst[d.doc_id] = max(worst[d.doc_id], p / (usual[d.lang] * ratio if few else quantile(own[d.lang], kneser_ney.QUANTILE)))
    return worst


def plain_mix(docs: list, most: float) -> Counter:
    """How often each doc_id is taken: the lowest exponent within the limit, whole passes, and the start of one more permutation of blocks."""
    md5 = lambda *parts: hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    size = {d.doc_id: (len(d.text.encode()) + 3) // 4 for d in docs}
    sources = defaultdict(list)
    for d in docs:
        sources[d.source or ""].append(d.doc_id)
    tokens = {s: sum(size[d] for d in ids) for s, ids in sources.items()}
    everything, low, high = sum(tokens.values()), 0.0, 1.0

    def weights(exponent: float) -> dict:
        raised = {s: (n / everything) ** exponent for s, n in tokens.items()}
        return {s: x / sum(raised.values()) for s, x in raised.items()}

    for _ in range(mixing.STEPS):
        middle = (low + high) / 2
        over = max(w * everything / tokens[s] for s, w in weights(middle).items()) > most
        low, high = (middle, high) if over else (low, middle)
    taken = Counter()
    for s, w in weights(high).items():
        passes, rest = divmod(math.floor(w * everything), tokens[s])
        blocks = defaultdict(list)
        for d in sources[s]:
            blocks[md5(mixing.SEED, passes + 1, s, int(md5(d)[:8], 16) % math.ceil(len(sources[s]) ** 0.5))].append(d)
        taken.update({d: passes for d in sources[s]})
        for key in sorted(blocks):
            for d in sorted(blocks[key], key=lambda d: md5(mixing.SEED, passes + 1, d)):
                rest -= size[d]
                taken[d] += rest >= 0
            if rest < 0:
                break
    return +taken


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stored(stage(spark, kept[-1], sf_dir), f"test-{name}"))
        assert kept[-1].columns == docs.columns
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert all(after <= before for before, after in zip(ids, ids[1:]))
    assert len(ids[1]) > 0.8 * len(ids[0]) and len(ids[2]) > 0.8 * len(ids[1])
    model = langid.train(docs, F.lit(True))
    named = {r.doc_id: model.predict(r.text) for r in docs.collect()}
    assert {(r.doc_id, r.lang) for r in kept[1].collect()} == {(d, x) for d, (x, score) in named.items() if x != langid.UNDETERMINED and score >= model.reject}
    trusted = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    worst = plain_quality(kept[1].collect(), trusted)
    assert {d for d, x in worst.items() if x < 1 - 1e-4} <= ids[2] <= {d for d, x in worst.items() if x < 1 + 1e-4}
    assert Counter(r.doc_id for r in kept[4].collect()) == plain_mix(kept[3].collect(), corpus_pipeline.MOST_PASSES)
    near = [(r.doc_id, r.text) for r in kept[2].collect()]
    assert ids[3] == {d for d, _, _, least in brute(near, 80) if least}
    last = corpus_pipeline.STAGES[-1][1](spark, kept[-1], sf_dir).collect()
    assert len(last) == kept[-1].count()
    encoder = bpe.Encoder(bpe.Vocabulary.read(BYTE_BPE))
    texts = {r.doc_id: hashlib.sha256(r.text.encode()).digest() for r in kept[-1].collect()}
    assert all(hashlib.sha256(encoder.decode(r.ids).encode()).digest() == texts[r.doc_id] for r in last)
