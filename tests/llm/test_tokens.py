"""BPE against the tokenizers library, and Simple-8b blocks by round trip and against a plain run over all documents."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from terrafacet.llm import bpe, queries, simple8b

ODD = [None, "", " ", "\n\n  x", "a" * 5000, "<|endoftext|>a <|endoftext|>", "it's we'LL 12345678901", "éèüß Ω 漢字 🙂👍🏽", "   tab\t", "x\x00y", "word " * 3000, "!?" * 200]


def texts(sf_dir):
    return pq.read_table(f"{sf_dir}/documents.parquet").select(["doc_id", "text"]).to_pylist()


def odd_documents(spark):
    rows = [(k, t, "other") for k, t in enumerate(ODD)] + [(3, ODD[3], "again"), (None, "no id", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_bpe_equals_the_library_on_odd_texts(spark):
    library = Tokenizer.from_file(queries.BYTE_BPE)
    docs = odd_documents(spark)
    found = bpe.encode_documents(docs, queries.BYTE_BPE, decode=True).collect()
    assert len(found) == docs.count()
    texts_by_id = {r.doc_id: r.text for r in docs.collect()}
    for row in found:
        want = library.encode(texts_by_id[row.doc_id] or "", add_special_tokens=False).ids
        assert row.ids == want, row.doc_id
        assert row.decoded == library.decode(want, skip_special_tokens=False)


def test_op7_equals_the_library(spark, sf_dir):
    library = Tokenizer.from_file(queries.BYTE_BPE)
    found = {r.doc_id: r for r in queries.op7_rank_array_bpe(spark, sf_dir).collect()}
    for doc in texts(sf_dir):
        ids = library.encode(doc["text"] or "", add_special_tokens=False).ids
        row = found.pop(doc["doc_id"])
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert not found


def test_bpe_of_an_empty_table(spark):
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string"), queries.BYTE_BPE).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_pack_round_trip(seed):
    rng = random.Random(seed)
    ids = [rng.getrandbits(rng.choice([1, 3, 9, 16, 20, 31, 52, 53, 60, 61, 64])) for _ in range(rng.choice([1, 7, 400]))]
    ids += [rng.choice([5, 1 << 51, (1 << 64) - 1])] * rng.choice([0, 60, 61, 300, 1000]) + [1]
    array = np.array(ids, np.uint64)
    assert simple8b.unpack(simple8b.pack(array)).tolist() == ids
    assert simple8b.unpack(simple8b.pack(array[:0])).tolist() == []


def plain_digests(docs, end_id=1):
    library = Tokenizer.from_file(queries.WORD_BPE)
    out, start = [], 0
    for doc in sorted(docs, key=lambda d: d["doc_id"]):
        ids = [*library.encode(doc["text"] or "", add_special_tokens=False).ids, end_id]
        out.append((doc["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_op2_equals_a_plain_run(spark, sf_dir):
    found = queries.op2_simple8b(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, found)) == plain_digests(texts(sf_dir))


def test_blocks_of_odd_texts_and_small_blocks(spark, tmp_path):
    docs = odd_documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    simple8b.write_blocks(docs, queries.WORD_BPE, 1, f"file://{tmp_path}/blocks", parts=3, block_ids=50)
    found = {r.doc_id: (r.start, r.ids) for r in simple8b.read_tokens(spark, f"file://{tmp_path}/blocks").collect()}
    library, start = Tokenizer.from_file(queries.WORD_BPE), 0
    for k, text in enumerate(ODD):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert found[k] == (start, ids), k
        start += len(ids)


def test_added_tokens_in_other_case():
    with open(queries.WORD_BPE, encoding="utf-8") as file:
        said = file.read()
    library = Tokenizer.from_str(said)
    odd = ["<|ENDOFTEXT|>", "<|EndOfText|>", "The End<|endoftext|>The END", "x <|EndOfText|>, y", "WORD word Word.", "<|StartOfText|>a"]
    ids, ends = simple8b.PieceEncoder(said).encode(pa.array(odd))
    for text, a, b in zip(odd, [0, *ends], ends):
        assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_words_of_several_batches_are_asked_once_though_the_cache_is_full(monkeypatch):
    with open(queries.WORD_BPE, encoding="utf-8") as file:
        said = file.read()
    monkeypatch.setattr(simple8b, "CACHE_CORES", 40)
    library, encoder, asked = Tokenizer.from_str(said), simple8b.PieceEncoder(said), []
    learn = encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda cores: (asked.extend(cores), learn(cores)))
    usual = ["the", "cat", "sat", "on", "a", "mat"]
    for k in range(12):
        text = " ".join([*usual, *(f"word{k}x{n}" for n in range(15))])
        ids, _ = encoder.encode(pa.array([text, "The CAT."]))
        assert ids.tolist() == [i for t in (text, "The CAT.") for i in library.encode(t, add_special_tokens=False).ids]
        assert len(encoder.cores) <= 40
    assert max(asked.count(w) for w in usual) == 1


def test_places_reached_by_hops():
    rng = random.Random(4)
    for n in (0, 1, 2, 50, 1000):
        count, at, want = [rng.choice([1, 2, 7, 60, 255]) for _ in range(n)], 0, []
        while at < n:
            want.append(at)
            at += count[at]
        assert simple8b.reached(np.array(count, np.uint8)).tolist() == want


def test_blocks_of_an_empty_table_and_repeated_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    simple8b.write_blocks(empty, queries.WORD_BPE, 1, f"file://{tmp_path}/none")
    assert simple8b.read_tokens(spark, f"file://{tmp_path}/none").collect() == []
    twice = spark.createDataFrame([(2, "b"), (2, "b"), (None, "a")], "doc_id long, text string")
    simple8b.write_blocks(twice, queries.WORD_BPE, 1, f"file://{tmp_path}/twice")
    found = sorted(simple8b.read_tokens(spark, f"file://{tmp_path}/twice").collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, len(r.ids)) for r in found] == [(None, 0, 2), (2, 2, 2), (2, 4, 2)]
