import hashlib
import random
import struct
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from granary.llm import gif
from granary.llm.gif import GREYS, Frame, Gif, gif_frames, load, lzw_decode, lzw_encode, media_digests, op10_gif_media, payload_of, read_gif, store, store_texts, write_gif

SCHEMA = "doc_id long, text string, media int"


def plain_decode(stream, least):
    """LZW a bit at a time."""
    bits = [b >> i & 1 for b in stream for i in range(8)]
    clear, out, table, last, width, at = 1 << least, [], [], None, least + 1, 0
    while at + width <= len(bits):
        code = sum(bits[at + i] << i for i in range(width))
        at += width
        if code == clear:
            table, last, width = [[i] for i in range(clear)] + [[], []], None, least + 1
        elif code == clear + 1:
            break
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            out += entry
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
            last = entry
            width = min(12, max(width, len(table).bit_length())) if len(table) >= 1 << width else width
    return bytes(out)


@pytest.mark.parametrize("least", [2, 4, 8])
def test_lzw_round_trip(least):
    rng = random.Random(least)
    for n in (0, 1, 2, 100, 3000, 40_000):
        for kinds in (1, 2, 1 << least):
            data = bytes(rng.randrange(kinds) for _ in range(n))
            stream = lzw_encode(data, least)
            assert lzw_decode(stream, least) == data
            if n <= 3000:
                assert plain_decode(stream, least) == data


def test_full_table_without_clear_and_bad_code():
    rng = random.Random(5)
    data = bytes(rng.randrange(256) for _ in range(6000))
    codes, table, n, prefix = [256], {}, 258, data[0]  # an encoder that never clears
    for b in data[1:]:
        if (prefix, b) in table:
            prefix = table[prefix, b]
        else:
            codes.append(prefix)
            if n < 4096:
                table[prefix, b] = n
                n += 1
            prefix = b
    codes += [prefix, 257]
    value, at, entries = 0, 0, 258
    for i, c in enumerate(codes):
        value |= c << at
        at += 9 if i < 2 else min(12, (entries + min(i - 2, 4096 - 258)).bit_length())
    stream = value.to_bytes((at + 7) // 8, "little")
    assert lzw_decode(stream, 8) == data
    with pytest.raises(ValueError):
        lzw_decode((256 | 300 << 9).to_bytes(3, "little"), 8)


def test_disposal_transparency_and_palettes():
    red_green = np.array([[255, 0, 0], [0, 255, 0]], np.uint8)
    one = lambda v: np.full((2, 2), v)
    frames = [
        Frame(np.zeros((4, 4), int), delay=50),
        Frame(one(1), 1, 1, 30, disposal=3),
        Frame(np.array([[1, 0], [0, 1]]), 0, 0, 20, disposal=2, transparent=0),
        Frame(one(0), 2, 2, 10, palette=np.array([[0, 0, 255], [9, 9, 9], [7, 7, 7]], np.uint8), interlaced=True),
    ]
    got = [(f, start, c.copy().view(np.uint8).reshape(4, 4, 4)) for f, start, c in read_gif(write_gif(Gif(4, 4, red_green, 0, frames))).shown()]
    assert [start for _, start, _ in got] == [0, 50, 80, 100]
    colour = lambda k, y, x: tuple(got[k][2][y, x])
    red, green, blue = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255)
    assert colour(0, 1, 1) == red and colour(1, 1, 1) == green
    assert colour(2, 0, 0) == green and colour(2, 0, 1) == red and colour(2, 1, 1) == green and colour(2, 2, 2) == red
    assert colour(3, 0, 0) == (0, 0, 0, 0) and colour(3, 2, 2) == blue and colour(3, 0, 3) == red


def test_interlace_and_errors():
    rows = np.arange(11)[:, None] * np.ones((1, 5), int)
    gif = Gif(5, 11, GREYS, 0, [Frame(rows, interlaced=True)])
    assert (read_gif(write_gif(gif)).frames[0].indices == rows).all()
    for bad in (b"", b"GIF89a", write_gif(gif)[:-40], b"GIF89a" + bytes(7) + b"\x55"):
        with pytest.raises(ValueError):
            list(read_gif(bad).shown())


def plain_samples(media):
    """Samples of all frames of a GIF, by a decoder of the test's own that goes code by code."""
    flags, at, out = media[10], 13, b""
    at += 3 * (2 << (flags & 7)) if flags & 128 else 0
    while media[at] != 0x3B:
        head = 2
        if media[at] == 0x2C:
            local = media[at + 9]
            head = 10 + (3 * (2 << (local & 7)) if local & 128 else 0)
            least = media[at + head]
            head += 1
        is_image, data, at = media[at] == 0x2C, b"", at + head
        while media[at]:
            data, at = data + media[at + 1 : at + 1 + media[at]], at + 1 + media[at]
        at += 1
        if not is_image:
            continue
        bits, pos, width, table, last = int.from_bytes(data, "little"), 0, least + 1, None, None
        while True:
            code, pos = bits >> pos & (1 << width) - 1, pos + width
            if code == 1 << least:
                table, width, last = {i: bytes([i]) for i in range(1 << least)}, least + 1, None
                continue
            if code == (1 << least) + 1:
                break
            free = len(table) + 2
            entry = table[code] if code in table else last + last[:1]
            if last is not None and free < 4096:
                table[free] = last + entry[:1]
            width = min(12, max(width, (len(table) + 2).bit_length()))
            last, out = entry, out + entry
    return out


def test_query_equals_direct_digests(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    media = {r.doc_id: bytes(r.media) for r in store_texts(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    for i, r in enumerate(op10_gif_media(spark, sf).collect()):
        payload = docs.pop(r.doc_id).encode()
        payload += b"\0" * (-len(payload) % 64 if payload else 64)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(media[r.doc_id]).hexdigest() and r.media_bytes == len(media[r.doc_id])
        if i % 10 == 0:
            assert plain_samples(media[r.doc_id]) == payload
        greys = Counter(b >> 6 for b in payload)
        assert r.feature.endswith("grey=" + ",".join(str(greys[k]) for k in range(4)))
    assert not docs


def test_hostile_files_are_error_rows(spark):
    """Files of a few bytes that declare huge frames, canvases or streams."""
    head = lambda w, h: b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF0, 0, 0) + bytes(6)
    frame = lambda w, h, least, data: b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0) + bytes([least, len(data)]) + data + b"\0"
    huge = head(8, 8) + frame(60_000, 60_000, 2, b"\x44\x01") + b"\x3b"
    canvas = head(60_000, 60_000) + frame(2, 2, 2, b"\x44\x01") + b"\x3b"
    many = head(8, 8) + frame(3000, 3000, 2, b"\x44\x01") * 40 + b"\x3b"
    code = head(8, 8) + frame(2, 2, 200, b"\x44\x01") + b"\x3b"
    fine = head(8, 8) + frame(2, 2, 2, b"\x44\x01") + b"\x3b"
    got = {r.doc_id: r for r in gif_frames(spark.createDataFrame(list(enumerate([huge, canvas, many, code, fine])), "doc_id long, media binary")).collect()}
    assert [bool(got[i].error) for i in range(5)] == [True, True, True, True, False]
    assert len(lzw_decode(lzw_encode(bytes(3_000_000)), 8, 64)) < 100_000_000


def test_frames_and_odd_rows(spark):
    long = "langer Text é " * 40_000
    rows = [(1, None), (2, ""), (3, "x" * 64), (3, "x" * 64), (None, "x" * 65), (4, long)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    assert load(store(payload_of(long)))[0] == payload_of(long)
    got = sorted(((r.doc_id, r.n_bytes, r.payload_bytes) for r in media_digests(df).collect()), key=str)
    assert got == sorted(((i, n := len((t or "").encode()), max(64, -(-n // 64) * 64)) for i, t in rows), key=str)
    frames = gif_frames(store_texts(df)).collect()
    assert len(frames) == 5 + 3 and all(r.error is None and sum(r.histogram) == r.width * r.height for r in frames if r.doc_id != 4)
    bad = spark.createDataFrame([(1, b"GIF89a"), (2, None)], "doc_id long, media binary")
    assert [(r.doc_id, r.frame_no, bool(r.error)) for r in gif_frames(bad).collect()] == [(1, None, True)]
    assert media_digests(spark.createDataFrame([], SCHEMA)).count() == 0 and gif_frames(bad.limit(0)).count() == 0


def test_frames_of_small_files_are_handed_on_together(spark, monkeypatch):
    """Many small canvases share a batch; large ones do not wait for each other."""
    media = spark.createDataFrame([], "doc_id long, media binary")
    monkeypatch.setattr(gif, "text_rows", lambda *columns: SimpleNamespace(mapInArrow=lambda run, schema: run))
    files = [store(payload_of("text"))] * 300 + [store(payload_of("x" * 700_000))]
    batch = lambda files: pa.RecordBatch.from_arrays([pa.array(range(len(files))), pa.array(files)], ["doc_id", "media"])
    out = list(gif_frames(media)([batch(files[:300]), batch(files[300:])]))
    assert [b.num_rows for b in out] == [256, 44, 1, 1, 1]
    assert [i for b in out[:2] for i in b.column(0).to_pylist()] == list(range(300)) and out[4].column(1).to_pylist() == [2]
