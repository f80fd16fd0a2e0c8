"""Operators that SQL can say, against their oracles, with edge cases; media against plain Python."""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import zipfile
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from terrafacet.llm import fixity, media, mixing, queries, quoting, shared


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_oracle(same, name):
    same(queries.QUERIES[name], queries.ORACLES[name])


def test_mixing_of_nulls_repeats_and_an_empty_table(spark):
    rows = [(None, None, "abcd", "p"), (1, "a", None, "p"), (2, "a", "x" * 400, "p"), (2, "a", "x" * 400, "p"), (3, "b", "y" * 8, "p"), (4, "c", "", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, pass string")
    found = mixing.mix_sources(docs, mixing.text_tokens(), repetition=2.0)
    assert found.columns == ["doc_id", "source", "text", "pass", "place"]
    counts = {r.doc_id: r["count"] for r in found.groupBy("doc_id").count().collect()}
    assert 4 not in counts and counts.get(3, 0) <= 2
    assert mixing.mix_sources(docs.where("false"), mixing.text_tokens(), entropy=0.9).collect() == []


def test_mixing_makes_no_plan_of_many_scans(spark, sf_dir, monkeypatch):
    """The documents are looked through once for the last block and once for the cut, each by a plan of three scans; there was one of seven."""
    plans, write = [], mixing.stored
    monkeypatch.setattr(mixing, "stored", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, name))[1])
    assert mixing.mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), mixing.text_tokens(), repetition=1.25).count()
    assert [plan.count("Relation [") for plan in plans] == [1, 3, 3]


def test_mixing_leaves_columns_of_any_name_alone(spark):
    """The names that the operator uses itself, in a table of its own."""
    own = ["last", "docs", "cut", "rest", "passes", "row", "tokens", "copies", "_source", "bkey", "key"]
    docs = spark.createDataFrame([(k, "ab"[k % 2], "x" * 40, *[f"{c}{k}" for c in own]) for k in range(30)], ["doc_id", "source", "text", *own])
    found = mixing.mix_sources(docs, mixing.text_tokens(), entropy=0.9)
    assert found.columns == [*docs.columns, "pass", "place"]
    rows = found.collect()
    assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in own)


def test_repetition_is_the_lowest_exponent_within_the_limit(spark):
    """Against a bisection in plain Python: passes over the sources, and the weights."""
    tokens, limit = {"a": 9000, "b": 700, "c": 100}, 1.5
    share = {k: v / sum(tokens.values()) for k, v in tokens.items()}
    low, high = 0.0, 1.0
    for _ in range(60):
        a = (low + high) / 2
        norm = sum(p**a for p in share.values())
        low, high = (a, high) if max(p ** (a - 1) / norm for p in share.values()) > limit else (low, a)
    norm = sum(p**high for p in share.values())
    sources = spark.createDataFrame([(k, v, 9) for k, v in tokens.items()], "source string, tokens long, docs long")
    found = {r.source: r for r in mixing.source_weights(sources, repetition=limit).collect()}
    assert all(found[k].weight == pytest.approx(share[k] ** high / norm) for k in tokens)
    assert max(found[k].quota / tokens[k] for k in tokens) <= limit


def test_weights_meet_the_entropy(spark):
    import math

    sources = spark.createDataFrame([("a", 9000, 9), ("b", 900, 9), ("c", 100, 9)], "source string, tokens long, docs long")
    weights = [r.weight for r in mixing.source_weights(sources, entropy=0.9).collect()]
    assert -sum(w * math.log(w) for w in weights) / math.log(3) == pytest.approx(0.9, abs=1e-6)


def test_quotes_link_to_originals(spark):
    rows = [
        (1, 0, "user", "First words.\n\nSecond passage here."),
        (1, 1, "bot", "On Monday x wrote:\n> Second  PASSAGE here.\nMy answer."),
        (1, 2, "user", "> My answer.\n>> second passage here.\nThanks."),
        (1, 3, "user", None),
        (None, None, None, "> lost"),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.turn: r for r in quoting.link_replies(messages).collect()}
    assert [(found[t].reply_to, found[t].depth, found[t].thread, found[t].text) for t in (0, 1, 2, 3)] == [
        (None, 0, 0, "First words.\n\nSecond passage here."), (0, 1, 0, "My answer."), (1, 2, 0, "Thanks."), (None, 0, 3, "")
    ]
    assert found[None].text == "" and quoting.link_replies(messages.where("false")).collect() == []


def test_lines_that_announce_nothing_stay(spark):
    texts = ["On balance the council wrote:\nkeep this", "On Monday x wrote:\n\n \n> gone\nkept", "Er schrieb:", "> On Monday y wrote:\n>> deeper\nkept too", "a\nOn Monday x wrote:\r\n> gone\r\nb", "b" * 100_000 + "\nOn it wrote:"]
    messages = spark.createDataFrame([(1, k, "u", t, "x") for k, t in enumerate([*texts, texts[0]])], "conv_id long, turn long, role string, text string, lines string")
    found = {r.turn: r.text for r in quoting.link_replies(messages).collect()}
    assert [found[k] for k in range(7)] == [texts[0], "kept", texts[2], "kept too", "a\nb", texts[5], texts[0]]
    repeated = quoting.link_replies(messages.union(messages)).collect()
    assert len(repeated) == 14


def test_audit_of_null_names_inserts_and_equal_bytes(spark):
    """Against a plain alignment by name."""
    bodies = {**{(0, k): b"same" if k % 3 else f"body {k}".encode() for k in range(0, 400, 2)}, (None, None): b"n", (None, 1): b"m", (2, None): b"o"}
    other = {**bodies, (None, None): b"N", (2, None): b"O", (0, 51): b"same", (0, 101): b"same"}
    del other[(0, 200)], other[(0, 20)]
    schema = "file long, record long, bytes binary, digest string"
    frames = [spark.createDataFrame([(*name, b, "x") for name, b in side.items()], schema) for side in (bodies, other)]
    found = sorted(((r.file is not None, r.file, r.ordinal, r.kind) for r in fixity.audit(*frames).collect()), key=str)
    want = []
    order = lambda name: (name[1] is not None, name[1] or 0)
    for file in (None, 0, 2):
        names = sorted({n for side in (bodies, other) for n in side if n[0] == file}, key=order)
        start = [0, 0]
        for ordinal, name in enumerate(names):
            a, b = (side.get(name) for side in (bodies, other))
            kind = "missing" if b is None else "surplus" if a is None else "corrupt" if a != b else "moved" if start[0] != start[1] else None
            if kind:
                want.append((file is not None, file, ordinal, kind))
            start = [start[0] + len(a or b""), start[1] + len(b or b"")]
    assert found == sorted(want, key=str)


def test_nothing_below_equal_branches_is_fetched(spark):
    first = spark.createDataFrame([(f, k, f"{f} {k}".encode()) for f in range(3) for k in range(500)], "file long, record long, bytes binary")
    second = first.withColumn("bytes", F.when((F.col("file") == 1) & (F.col("record") == 77), F.lit(b"X 77")).otherwise(F.col("bytes")))
    with shared.Scratch(spark) as scratch:
        leaves = [fixity.leaves_of(r, scratch) for r in (first, second)]
        nodes = [fixity.tree(x, fixity.height_of(x)) for x in leaves]
        assert [(r.file.file, r.ordinal) for r in fixity.differing_leaves(nodes, fixity.height_of(leaves[0])).collect()] == [(1, 77)]


def test_audit_finds_planted_damage_alone(spark):
    rows = [(0, k, f"body {k}".encode()) for k in range(300)] + [(None, 1, None)]
    first = spark.createDataFrame(rows[:-1] + [(1, 1, None)], "file long, record long, bytes binary")
    second = first.withColumn("bytes", F.when(F.col("record") == 77, F.lit(b"bodY 77")).otherwise(F.col("bytes"))).where("record != 299")
    found = sorted((r.file, r.ordinal, r.kind) for r in fixity.audit(first, second).collect())
    assert found == [(0, 77, "corrupt"), (0, 299, "missing")]
    assert fixity.audit(first, first).collect() == [] and fixity.audit(first.where("false"), second.where("false")).collect() == []
    assert len({r.root for r in fixity.roots(first.where("file = 0")).union(fixity.roots(second.where("file = 0"))).collect()}) == 2


def png() -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def zipped() -> bytes:
    with zipfile.ZipFile(out := io.BytesIO(), "w") as file:
        file.writestr("a.txt", "text")
    return out.getvalue()


GIF = b"GIF89a\1\0\1\0\0\0\0,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
WHOLE = {"image/png": png(), "application/zip": zipped(), "application/gzip": gzip.compress(b"x" * 99), "image/gif": GIF, "audio/wav": media.wav(b"\x80" * 577)}


@pytest.mark.parametrize("kind", sorted(WHOLE))
def test_sniffing_confirms_structure(kind):
    data = WHOLE[kind]
    assert media.true_type(media.sniff(data), len(data)) == kind
    assert media.true_type(media.sniff(data[:-1]), len(data) - 1) == media.UNKNOWN  # cut off
    assert (kind, 7, len(data)) in media.sniff(b"before " + data + b" after")


def test_types_are_corrected_and_media_carved(spark):
    rows = [(1, "image/gif", png()), (2, "image/png", png()), (3, None, b"text " + GIF + b" and " + png()), (4, media.UNKNOWN, None), (5, media.UNKNOWN, b"")]
    found = media.sniff_media(spark.createDataFrame(rows, "k long, declared string, content binary"))
    assert {r.k: (r.sniffed, r.corrected) for r in found.collect()} == {
        1: ("image/png", True), 2: ("image/png", False), 3: (media.UNKNOWN, True), 4: (media.UNKNOWN, False), 5: (media.UNKNOWN, False)
    }
    assert sorted((r.k, bytes(r.bytes)) for r in media.carve(found).collect()) == sorted([(3, GIF), (3, png())])


def test_op1_equals_a_plain_run(spark, sf_dir):
    found = {r.doc_id: r for r in queries.op1_signature_sniffing(spark, sf_dir).collect()}
    for doc in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist():
        raw, row = (doc["text"] or "").encode(), found.pop(doc["doc_id"])
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (row.n_bytes, row.payload_bytes, row.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (row.tail_crc32, row.media_sha256, row.sniffed) == (zlib.crc32(payload[-32:]), hashlib.sha256(media.wav(payload)).hexdigest(), "audio/wav")
    assert not found
