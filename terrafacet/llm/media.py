"""Signature sniffing of media columns.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over
a blob. Each hit is confirmed by a validator that walks the format's structure
and returns where the medium ends; hits without structure are dropped. The
medium that begins at byte 0 and reaches the end gives the blob's true type,
whatever it was declared as; media found inside can be carved out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafacet.llm.shared import map_arrow

UNKNOWN = "application/octet-stream"
PAD_UNIT = 576
SAMPLE_RATE = 16_000
FOUND = "array<struct<type: string, start: long, length: long>>"


def png_end(data: bytes, at: int) -> int | None:
    """Chunks with right checksums from IHDR to IEND."""
    at, first = at + 8, True
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        kind, end = data[at + 4 : at + 8], at + 12 + size
        if end > len(data) or first and kind != b"IHDR" or zlib.crc32(data[at + 4 : end - 4]) != int.from_bytes(data[end - 4 : end], "big"):
            return None
        if kind == b"IEND":
            return end
        at, first = end, False
    return None


def jpeg_end(data: bytes, at: int) -> int | None:
    """Marker segments, at least one frame and scan, up to EOI."""
    at, frame = at + 2, False
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xD9:
            return at + 2 if frame else None
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if size < 2 or at + 2 + size > len(data):
            return None
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        at += 2 + size
        if kind == 0xDA:  # entropy-coded data: FF is followed by 00 or a restart marker
            while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data) and (data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7):
                at += 2
            if at < 0:
                return None
    return None


def gif_end(data: bytes, at: int) -> int | None:
    """Screen descriptor, then blocks with sub-blocks, up to the trailer."""

    def palette(flags: int) -> int:
        return 3 << (flags & 7) + 1 if flags & 0x80 else 0

    def sub_blocks(at: int) -> int:
        while at < len(data) and data[at]:
            at += 1 + data[at]
        return at + 1

    if at + 13 > len(data):
        return None
    at += 13 + palette(data[at + 10])
    while at < len(data):
        if data[at] == 0x3B:
            return at + 1
        if data[at] == 0x21:
            at = sub_blocks(at + 2)
        elif data[at] == 0x2C and at + 10 < len(data):
            at = sub_blocks(at + 11 + palette(data[at + 9]))
        else:
            return None
    return None


def bmp_end(data: bytes, at: int) -> int | None:
    """File size, known header size, one plane, a legal depth, and pixels that fit."""
    if at + 30 > len(data):
        return None
    size, _, pixels, header, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", data, at + 2)
    row = (abs(width) * depth + 31) // 32 * 4
    fits = header in (40, 52, 56, 64, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and pixels >= 14 + header
    return at + size if fits and width > 0 and height and pixels + row * abs(height) <= size <= len(data) - at else None


def riff_end(need: bytes) -> Callable[[bytes, int], int | None]:
    """A RIFF form whose chunks fill its length exactly and include `need`."""

    def end(data: bytes, at: int) -> int | None:
        stop = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        at, seen = at + 12, need == b""
        if stop > len(data):
            return None
        while at + 8 <= stop:
            seen |= data[at : at + 4].startswith(need)
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            at += 8 + size + size % 2
        return stop if seen and at in (stop, stop + 1) else None

    return end


PIECE = 1 << 14


def gzip_end(data: bytes, at: int) -> int | None:
    """One member that inflates with the right checksum, in bounded pieces."""
    inflate, view = zlib.decompressobj(31), memoryview(data)
    try:
        while not inflate.eof:
            rest = inflate.unconsumed_tail
            if not rest:
                if at >= len(data):
                    return None
                rest = view[at : at + PIECE]  # no copy of what follows
                at += len(rest)
            inflate.decompress(rest, 1 << 20)
    except zlib.error:
        return None
    return at - len(inflate.unused_data)


def zip_end(data: bytes, at: int) -> int | None:
    """The first end record whose directory and entries lead back to `at`."""
    end = at
    while (end := data.find(b"PK\x05\x06", end)) >= 0 and end + 22 <= len(data):
        size, begin, note = struct.unpack_from("<IIH", data, end + 12)
        if at + begin + size == end and data[at + begin : at + begin + 4] in (b"PK\x01\x02", b"PK\x05\x06") and end + 22 + note <= len(data):
            return end + 22 + note
        end += 4
    return None


def pdf_end(data: bytes, at: int) -> int | None:
    """Version, a startxref that points at a table or stream, then the end mark."""
    if not data[at + 5 : at + 6].isdigit():
        return None
    end = at
    while (end := data.find(b"%%EOF", end)) >= 0:
        words = data[max(at, end - 64) : end].split()
        if len(words) >= 2 and words[-2] == b"startxref" and words[-1].isdigit():
            to = at + int(words[-1])
            if to < end and (data[to : to + 4] == b"xref" or b"obj" in data[to : to + 24]):
                return end + 5
        end += 5
    return None


def mp4_end(data: bytes, at: int) -> int | None:
    """Boxes of printable kinds from ftyp on, with moov or mdat among them; the magic stands at byte 4."""
    kinds = set()
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        if size == 1 and at + 16 <= len(data):
            size = int.from_bytes(data[at + 8 : at + 16], "big")
        if size < 8 or at + size > len(data) or not kind.isalnum():
            break
        kinds.add(kind)
        at += size
    return at if kinds & {b"moov", b"mdat", b"moof"} else None


def ogg_end(data: bytes, at: int) -> int | None:
    """Pages with growing numbers, up to the page with the last flag."""
    number = -1
    while data[at : at + 5] == b"OggS\0" and at + 27 <= len(data):
        flags, page, segments = data[at + 5], int.from_bytes(data[at + 18 : at + 22], "little"), data[at + 26]
        end = at + 27 + segments + sum(data[at + 27 : at + 27 + segments])
        if page <= number or end > len(data):
            return None
        if flags & 4:
            return end
        at, number = end, page
    return None


def flac_end(data: bytes, at: int) -> int | None:
    """STREAMINFO first, a chain of metadata, then a frame; a stream has no length, so it reaches the end."""
    at, first = at + 4, True
    while at + 4 <= len(data):
        kind, size = data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        if first and (kind, size) != (0, 34) or kind > 6:
            return None
        last, at, first = data[at] & 0x80, at + 4 + size, False
        if last:
            return len(data) if data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] in (b"\xf8", b"\xf9") else None
    return None


# Fixed values: (type, magic bytes, where in the file they stand, validator).
FORMATS: list[tuple[str, bytes, int, Callable[[bytes, int], int | None]]] = [
    ("image/png", b"\x89PNG\r\n\x1a\n", 0, png_end),
    ("image/jpeg", b"\xff\xd8\xff", 0, jpeg_end),
    ("image/gif", b"GIF87a", 0, gif_end),
    ("image/gif", b"GIF89a", 0, gif_end),
    ("image/bmp", b"BM", 0, bmp_end),
    ("image/webp", b"WEBP", 8, riff_end(b"VP8")),
    ("audio/wav", b"WAVE", 8, riff_end(b"fmt ")),
    ("video/avi", b"AVI ", 8, riff_end(b"")),
    ("application/gzip", b"\x1f\x8b\x08", 0, gzip_end),
    ("application/zip", b"PK\x03\x04", 0, zip_end),
    ("application/pdf", b"%PDF-", 0, pdf_end),
    ("video/mp4", b"ftyp", 4, mp4_end),
    ("audio/ogg", b"OggS", 0, ogg_end),
    ("audio/flac", b"fLaC", 0, flac_end),
]
RIFF_TYPES = {"image/webp", "audio/wav", "video/avi"}


def magic_automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for k, (_, magic, _, _) in enumerate(FORMATS):
        automaton.add_word(magic.decode("latin-1"), k)
    automaton.make_automaton()
    return automaton


_AUTOMATON: list[ahocorasick.Automaton] = []


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, start, length) of every medium whose structure holds, in order of start."""
    if not _AUTOMATON:
        _AUTOMATON.append(magic_automaton())
    found = []
    for last, k in _AUTOMATON[0].iter(data.decode("latin-1")):
        kind, magic, offset, end_of = FORMATS[k]
        at = last + 1 - len(magic) - offset
        if at < 0 or kind in RIFF_TYPES and data[at : at + 4] != b"RIFF":
            continue
        if (end := end_of(data, at)) is not None:
            found.append((kind, at, end - at))
    return sorted(set(found), key=lambda x: (x[1], -x[2], x[0]))


def true_type(found: list[tuple[str, int, int]], size: int) -> str:
    return next((kind for kind, at, n in found if at == 0 and n == size), UNKNOWN)


def sniff_batch(batch: pa.RecordBatch, content: str, declared: str) -> pa.RecordBatch:
    found, sniffed, corrected = [], [], []
    for data, said in zip(batch.column(content).to_pylist(), batch.column(declared).to_pylist()):
        found.append(sniff(data or b""))
        sniffed.append(true_type(found[-1], len(data or b"")))
        corrected.append(sniffed[-1] != said)
    kinds = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
    more = [pa.array([[dict(zip(("type", "start", "length"), x)) for x in xs] for xs in found], kinds), pa.array(sniffed, pa.string()), pa.array(corrected, pa.bool_())]
    return pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "found", "sniffed", "corrected"])


def sniffed_schema(blobs: DataFrame) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in blobs.schema), f"found {FOUND}", "sniffed string", "corrected boolean"])


def sniff_media(blobs: DataFrame, content: str = "content", declared: str = "declared") -> DataFrame:
    """Add `found` (all media in the blob), `sniffed` (its true type) and `corrected` to every row.

    A null or empty blob has nothing in it and the type application/octet-stream.
    `corrected` says that the declared type, null included, isn't the true one.
    Columns named found, sniffed or corrected are replaced. Blobs are read whole.
    """
    kept = blobs.drop("found", "sniffed", "corrected")
    return map_arrow(kept, lambda batch: sniff_batch(batch, content, declared), sniffed_schema(kept))


def carve(sniffed: DataFrame, content: str = "content") -> DataFrame:
    """A row per medium found inside another blob: the row's other columns, `medium` and `bytes`."""
    whole = (F.col("medium.start") == 0) & (F.col("medium.length") == F.length(content))
    rows = sniffed.withColumn("medium", F.explode("found")).where(~whole)
    return rows.withColumn("bytes", F.expr(f"substring(`{content}`, cast(medium.start as int) + 1, cast(medium.length as int))"))


def wav(payload: bytes) -> bytes:
    """8-bit mono samples in a RIFF/WAVE form."""
    form = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(form)) + form


def wav_samples(data: bytes) -> bytes:
    """The samples of an 8-bit WAVE form."""
    at = 12
    while data[at : at + 4] != b"data":
        at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    return data[at + 8 : at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")]


def texts_to_media(docs: DataFrame) -> DataFrame:
    """doc_id, declared and content: each text's UTF-8, filled with bytes 255 to a positive multiple of 576, as 8-bit sound.

    A null text counts as empty. The declared type is the general one that an upload without a type gets.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        content = []
        for text in batch.column("text").to_pylist():
            raw = (text or "").encode()
            content.append(wav(raw.ljust(max(1, -(-len(raw) // PAD_UNIT)) * PAD_UNIT, b"\xff")))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([UNKNOWN] * len(content)), pa.array(content, pa.binary())], names=["doc_id", "declared", "content"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, declared string, content binary")


def sound_features(media: DataFrame, content: str = "content", declared: str = "declared") -> DataFrame:
    """As sniff_media, with `payload` (the samples, null unless it is sound) and `feature`; without the content.

    feature: the type, then of the samples their number, sum, number of crossings
    of the middle, and most common value (the smallest of equals).
    """
    kept = media.drop("found", "sniffed", "corrected", "payload", "feature")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        batch = sniff_batch(batch, content, declared)
        payloads, features = [], []
        for data, kind in zip(batch.column(content).to_pylist(), batch.column("sniffed").to_pylist()):
            payloads.append(wav_samples(data) if kind == "audio/wav" else None)
            samples = np.frombuffer(payloads[-1] or b"", np.uint8)
            crossings, common = int(np.count_nonzero(np.diff(samples >= 128))), int(np.bincount(samples, minlength=256).argmax())
            features.append(f"{kind};frames={len(samples)};sum={int(samples.sum(dtype=np.int64))};crossings={crossings};common={common}")
        names = [n for n in batch.schema.names if n != content]
        columns = [*(batch.column(n) for n in names), pa.array(payloads, pa.binary()), pa.array(features, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[*names, "payload", "feature"])

    return map_arrow(kept, run, sniffed_schema(kept).replace(f"`{content}` binary, ", "") + ", payload binary, feature string")
