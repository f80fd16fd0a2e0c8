"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are the runs of 2 to 4 characters within its lower-cased words,
word ends included. Each is hashed to a row of an embedding table; the rows'
mean goes through a linear layer and a softmax. The model is trained on the
driver by stochastic gradient descent in numpy, on at most `PER_LANGUAGE` rows of
each language; prediction reads every whole text in Arrow batches.

Calibration: a fifth of the sample is kept from training. Its log loss chooses
the softmax's temperature, and the lowest score among its right answers sets the
score under which a prediction is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from terrafacet.llm.shared import map_arrow

BUCKETS, WIDTH = 1 << 15, 16
SIZES = (2, 3, 4)
PER_LANGUAGE, MAX_LANGUAGES = 400, 512
EPOCHS, RATE = 6, 0.6
KEEP, MOST_STRICT = 0.999, 0.5
SALTS = 64
UNDETERMINED = "und"

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point: whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def subwords(text: str) -> np.ndarray:
    """Bucket of every subword of a text; of no letters, none."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    letter = np.concatenate([[False], letters()[code], [False]])
    code = np.where(letter, np.concatenate([[0], code, [0]]), 0).astype(np.uint32)
    code = code[letter | np.concatenate([[True], letter[:-1]])]  # one mark between words
    if len(code) < 3:
        return np.zeros(0, np.int64)
    found, inside = [], np.ones(len(code), bool)
    hashed = code * np.uint32(0x9E3779B1)
    for size in range(2, max(SIZES) + 1):
        n = len(code) - size + 1
        if n <= 0:
            break
        hashed = (hashed[:n] ^ hashed[:n] >> np.uint32(15)) * np.uint32(0x85EBCA77) + code[size - 1 :] * np.uint32(0xC2B2AE3D)
        if size > 2:  # no mark but at the ends
            inside = inside[:n] & (code[size - 2 : size - 2 + n] > 0)
        if size in SIZES:
            mixed = hashed[inside[:n]] if size > 2 else hashed
            found.append((mixed ^ mixed >> np.uint32(13)) * np.uint32(0x27D4EB2F) >> np.uint32(17))
    return np.concatenate(found).astype(np.int64)


@dataclass
class Model:
    """languages; logits: a row per bucket, already embedding times weights; bias; reject: the score below which to reject."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    reject: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score; `und` with 0 for a text without a letter."""
        buckets = subwords(text or "")
        if not len(buckets) or not self.languages:
            return UNDETERMINED, 0.0
        chances = softmax((self.logits.take(buckets, 0).sum(0, dtype=np.float64) / len(buckets) + self.bias) / self.temperature)
        best = int(chances.argmax())
        return self.languages[best], float(chances[best])


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def sample_texts(docs: DataFrame, usable: Column) -> DataFrame:
    """key, lang and text of at most PER_LANGUAGE usable rows of each language, those of least hash.

    Only hashes are ranked, in two steps, so that no language meets in one task;
    the chosen keys are at most PER_LANGUAGE * MAX_LANGUAGES and are broadcast.
    """
    keyed = docs.where(usable & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(
        F.xxhash64("doc_id", "text").alias("key"), F.col("lang").cast("string").alias("lang"), "text"
    )
    ranked = keyed.select("key", "lang", F.pmod("key", F.lit(SALTS)).alias("salt"))
    if keyed.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    for by in (["lang", "salt"], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("key"))).where(F.col("rank") <= PER_LANGUAGE)
    chosen = ranked.select("key", "lang").distinct()
    return keyed.join(F.broadcast(chosen), ["key", "lang"], "left_semi").dropDuplicates(["key", "lang"])


def train(docs: DataFrame, usable: Column, seed: int = 17) -> Model:
    """Train on a bounded sample of the usable rows that have a text and a language.

    Without any such row the model knows no language and every text is `und`.
    More than MAX_LANGUAGES languages raise an error.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = [np.unique(subwords(t), return_counts=True) for t in batch.column("text").to_pylist()]
        lists = [pa.array([p[k].astype(np.int32) for p in pairs], pa.list_(pa.int32())) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("lang"), *lists], names=["key", "lang", "buckets", "counts"])

    rows = map_arrow(sample_texts(docs, usable), run, "key long, lang string, buckets array<int>, counts array<int>").toArrow().to_pandas()
    rows = rows[rows.buckets.map(len) > 0].sort_values(["key", "lang"], kind="stable").reset_index(drop=True)
    languages = sorted(rows.lang.unique())
    return fit(languages, [languages.index(x) for x in rows.lang], list(rows.buckets), list(rows.counts), seed)


def fit(languages: list[str], labels: list[int], buckets: list[np.ndarray], counts: list[np.ndarray], seed: int) -> Model:
    """Stochastic gradient descent over single texts, then calibration on every fifth text of a language."""
    random = np.random.default_rng(seed)
    embedding = random.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    weights, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    shares = [(c / c.sum()).astype(np.float32) for c in counts]
    seen: dict[int, int] = {}
    for label in labels:
        seen[label] = seen.get(label, 0) + 1
    turn, held = {}, []
    for label in labels:
        turn[label] = turn.get(label, -1) + 1
        held.append(seen[label] >= 5 and turn[label] % 5 == 4)
    learn = np.flatnonzero(~np.array(held, bool))
    steps, step = EPOCHS * len(learn), 0
    for _ in range(EPOCHS):
        for i in random.permutation(learn):
            rate = RATE * (1 - step / steps)
            mean = shares[i] @ embedding[buckets[i]]
            error = softmax(mean @ weights + bias)
            error[labels[i]] -= 1
            back = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= rate * error
            embedding[buckets[i]] -= rate * len(shares[i]) * 0.5 * shares[i][:, None] * back
            step += 1
    model = Model(languages, embedding @ weights, bias.astype(np.float64), 1.0, 0.0)
    check = np.flatnonzero(held)
    if len(check):
        raw = np.array([model.logits[buckets[i]].T.astype(np.float64) @ shares[i] for i in check]) + model.bias
        truth = np.array(labels)[check]
        loss = lambda t: -np.log(softmax(raw / t)[np.arange(len(check)), truth] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
        chances = softmax(raw / model.temperature)
        right = np.sort(chances.max(1)[chances.argmax(1) == truth])
        if len(right):
            model.reject = float(min(MOST_STRICT, right[int((1 - KEEP) * len(right))]))
    return model


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """`keep` columns (one or more, of any names) with lang_pred, score and accepted for every row.

    A null or empty text and one without a letter are `und` with score 0 and not
    accepted. A very long text is read whole. Rows that repeat are each judged, with
    the same result, and an empty table has none.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * MAX_LANGUAGES floats at most
    carried = "text" in keep  # then it travels once
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("keep"), *([] if carried else [F.col("text").cast("string").alias("text")]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("keep").field("text") if carried else batch.column("text")
        found = [shipped.value.predict(t) for t in texts.to_pylist()]
        more = [
            pa.array([x for x, _ in found], pa.string()),
            pa.array([s for _, s in found], pa.float64()),
            pa.array([x != UNDETERMINED and s >= shipped.value.reject for x, s in found], pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays([batch.column("keep"), *more], names=["keep", "lang_pred", "score", "accepted"])

    schema = StructType([rows.schema["keep"]]).add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    found = map_arrow(rows, run, schema)
    return found.select("keep.*", "lang_pred", "score", "accepted")
