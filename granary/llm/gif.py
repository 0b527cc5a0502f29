"""GIF media columns: LZW code streams, palettes, disposal, transparency, timed frames and colour histograms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import documents, map_batches, small_batches, text_rows

#: Colours 0 to 255 as greys: a sample's value is then its colour too.
GREYS = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
#: Width of a stored payload's frames, and their rows at most.
WIDTH, ROWS = 64, 4096
#: Pixels that a file may declare beyond the samples it holds, for its canvas and for all its frames; more is an error.
MOST_BLANK = 1 << 24
#: Bytes of canvases and rows that are handed on together.
HELD, FRAME_ROWS = 1 << 20, 256


# LZW ------------------------------------------------------------------------------------------------------------------


def _widths(first: int, n: int, least: int) -> np.ndarray:
    """Bits of the codes number first to first + n - 1 since the last clear: as many as the table's next entry needs.

    The code after a clear makes no entry, every later one makes one, until 4096 are there."""
    entry = (1 << least) + 2 + np.maximum(np.arange(first, first + n) - 1, 0)
    width = np.full(n, least + 1)
    for w in range(least + 1, 12):
        width += entry >= 1 << w
    return width


def lzw_encode(samples: bytes, least: int = 8) -> bytes:
    """A GIF code stream: begins with a clear, clears again when the table is full, ends with an end code."""
    clear, free = 1 << least, (1 << least) + 2
    codes: list[int] = [clear]
    runs = [1]  # where codes after each clear begin
    table: dict[int, int] = {}
    get, emit, n = table.get, codes.append, free
    if samples:
        prefix = samples[0]
        for b in memoryview(samples)[1:]:
            key = prefix << 8 | b
            code = get(key)
            if code is not None:
                prefix = code
                continue
            emit(prefix)
            prefix = b
            if n < 4096:
                table[key] = n
                n += 1
            else:
                emit(clear)
                runs.append(len(codes))
                table.clear()
                n = free
        emit(prefix)
    emit(clear + 1)
    all_codes = np.array(codes, np.int64)
    width = np.concatenate([[least + 1], *(_widths(0, b - a, least) for a, b in zip(runs, [*runs[1:], len(codes)]))])
    bits = (all_codes[:, None] >> np.arange(12) & 1).astype(np.uint8)
    return np.packbits(bits[np.arange(12) < width[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, least: int, most: int | None = None) -> bytes:
    """The samples of a code stream: any clears, a full table that is kept, and a stream that ends without its end
    code are all read. A code that the table can't have yet is a ValueError, as is a code size out of 1 to 8. Decoding
    ends once there are `most` samples, so a short stream can't grow beyond what its frame shows."""
    if not 1 <= least <= 8:
        raise ValueError(f"code size {least}")
    data = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    words = data[:-2] | data[1:-1] << 8 | data[2:] << 16
    total, clear, free = 8 * len(stream), 1 << least, (1 << least) + 2
    singles = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    table, last, since, bit = singles.copy(), b"", 0, 0
    held, seen = 0, 0  # samples, and items of out that are among them
    while bit < total and (most is None or held < most):
        width = _widths(since, min(4096, (total - bit) // (least + 1) + 1), least)  # no more codes than bits are left for
        end = bit + np.cumsum(width)
        width = width[end <= total]
        if not len(width):
            break
        at = end[: len(width)] - width
        codes = words[at >> 3] >> (at & 7) & (1 << width) - 1
        stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        n = int(stops[0]) if len(stops) else len(codes)
        last = _decode_run(codes[:n].tolist(), table, last, out)
        held, seen = held + sum(map(len, out[seen:])), len(out)
        if n < len(codes):
            if codes[n] == clear + 1:
                break
            bit = int(end[n])
            table, last, since = singles.copy(), b"", 0
        else:
            bit, since = int(end[n - 1]), since + n
    return b"".join(out)


def _decode_run(codes: list[int], table: list[bytes], last: bytes, out: list[bytes]) -> bytes:
    """Decodes codes without a clear among them; table grows up to 4096 entries. Gives the last string."""
    if codes and not last:
        if codes[0] >= len(table):
            raise ValueError(f"code {codes[0]} with {len(table)} entries")
        last = table[codes[0]]
        out.append(last)
        codes = codes[1:]
    room = max(0, 4096 - len(table))
    emit, grow = out.append, table.append
    for code in codes[:room]:
        try:
            entry = table[code]
        except IndexError:
            if code != len(table):
                raise ValueError(f"code {code} with {len(table)} entries") from None
            entry = last + last[:1]
        emit(entry)
        grow(last + entry[:1])
        last = entry
    out.extend(map(table.__getitem__, codes[room:]))
    return table[codes[-1]] if codes[room:] else last


# Files ----------------------------------------------------------------------------------------------------------------


@dataclass
class Frame:
    """A frame as stored: palette indices, place on the canvas, and how it is shown. delay is in ms; palette None
    means the file's."""

    indices: np.ndarray
    left: int = 0
    top: int = 0
    delay: int = 0
    disposal: int = 0
    transparent: int | None = None
    palette: np.ndarray | None = None
    interlaced: bool = False


@dataclass
class Gif:
    width: int
    height: int
    palette: np.ndarray | None
    background: int
    frames: list[Frame]

    def shown(self) -> Iterator[tuple[Frame, int, np.ndarray]]:
        """Each frame, when it appears (ms) and the canvas then: height x width pixels, each the four bytes red, green,
        blue, alpha as one number (little-endian). The canvas changes with the next step; copy it to keep it.

        Disposal 2 clears the frame's place and 3 brings back what was there before; transparent pixels leave the
        canvas as it is."""
        canvas, start = np.zeros((self.height, self.width), "<u4"), 0
        for f in self.frames:
            before = canvas.copy() if f.disposal == 3 else None
            h, w = f.indices.shape
            place = canvas[f.top : f.top + h, f.left : f.left + w]
            indices = f.indices[: place.shape[0], : place.shape[1]]
            palette = f.palette if f.palette is not None else self.palette
            if palette is None:
                raise ValueError("no palette")
            full = np.zeros((256, 4), np.uint8)
            full[: len(palette), :3], full[:, 3] = palette, 255
            drawn = full.view("<u4")[:, 0].take(indices)
            if f.transparent is None:
                place[:] = drawn
            else:
                keep = indices != f.transparent
                place[keep] = drawn[keep]
            yield f, start, canvas
            start += f.delay
            if f.disposal == 2:
                place[:] = 0
            elif f.disposal == 3:
                canvas = before


def _palette_bytes(palette: np.ndarray) -> tuple[int, bytes]:
    """The size field and the table, filled up to a power of two."""
    bits = max(1, (len(palette) - 1).bit_length())
    return bits - 1, palette.astype(np.uint8).tobytes().ljust(3 << bits, b"\0")


def _interlaced_rows(h: int) -> np.ndarray:
    return np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def write_gif(gif: Gif) -> bytes:
    out = [b"GIF89a", struct.pack("<HH", gif.width, gif.height)]
    if gif.palette is not None:
        size, table = _palette_bytes(gif.palette)
        out += [bytes([0xF0 | size, gif.background, 0]), table]
    else:
        out.append(bytes([0x70, gif.background, 0]))
    for f in gif.frames:
        flags = f.disposal << 2 | (f.transparent is not None)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", flags, f.delay // 10, f.transparent or 0, 0))
        h, w = f.indices.shape
        size, table = _palette_bytes(f.palette) if f.palette is not None else (0, b"")
        out += [b"\x2c" + struct.pack("<HHHHB", f.left, f.top, w, h, 0x80 * bool(table) | 0x40 * f.interlaced | size), table]
        colours = f.palette if f.palette is not None else gif.palette
        least = max(2, (len(colours) - 1).bit_length())
        samples = f.indices[_interlaced_rows(h)] if f.interlaced else f.indices
        stream = lzw_encode(samples.astype(np.uint8).tobytes(), least)
        out.append(bytes([least]))
        out += [bytes([len(part)]) + part for i in range(0, len(stream), 255) if (part := stream[i : i + 255])]
        out.append(b"\0")
    return b"".join(out) + b"\x3b"


def read_gif(data: bytes) -> Gif:
    """Parses a whole file; a frame with fewer samples than pixels is filled up with zeros. ValueError on a file that
    is no GIF, ends within a field, or declares more than MOST_BLANK pixels that it has no samples for."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    try:
        return _read(data)
    except (struct.error, IndexError) as e:
        raise ValueError(f"broken GIF: {e}") from e


def _read(data: bytes) -> Gif:
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13

    def table(flags: int) -> np.ndarray | None:
        nonlocal at
        if not flags & 0x80:
            return None
        n = 2 << (flags & 7)
        found = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return found

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(parts)

    gif = Gif(width, height, table(flags), background, [])
    control, blank, held = (0, 0, None), 0, 0
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1]
            at += 2
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                shown, delay, clear = struct.unpack_from("<BHB", body)
                control = (shown >> 2 & 7, 10 * delay, clear if shown & 1 else None)
        elif kind == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette, least = table(flags), data[at]
            at += 1
            samples = lzw_decode(blocks(), least, w * h)[: w * h]
            blank, held = blank + w * h - len(samples), held + len(samples)
            if blank > MOST_BLANK:
                raise ValueError(f"{blank} pixels without samples")
            samples = samples.ljust(w * h, b"\0")
            pixels = np.frombuffer(samples, np.uint8).reshape(h, w)
            if flags & 0x40:
                order, straight = _interlaced_rows(h), np.empty_like(pixels)
                straight[order] = pixels
                pixels = straight
            gif.frames.append(Frame(pixels, left, top, control[1], control[0], control[2], palette, bool(flags & 0x40)))
            control = (0, 0, None)
        else:
            raise ValueError(f"unknown block {kind}")
    if width * height > MOST_BLANK + held:
        raise ValueError(f"a canvas of {width} x {height} pixels for {held} samples")
    return gif


def histogram(pixels: np.ndarray) -> np.ndarray:
    """Opaque pixels by the upper two bits of red, green and blue: 64 counts."""
    bins = (pixels >> 6 & 3) << 4 | (pixels >> 14 & 3) << 2 | pixels >> 22 & 3
    return np.bincount(np.where(pixels >> 24 > 0, bins, 64).ravel(), minlength=65)[:64]


# Payloads -------------------------------------------------------------------------------------------------------------


def payload_of(text: str | None) -> bytes:
    """UTF-8, with bytes 0 up to a positive multiple of 64."""
    data = (text or "").encode()
    return data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH, b"\0")


def store(payload: bytes) -> bytes:
    """A GIF of 64 samples a row and a grey a value, in frames of at most ROWS rows."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    frames = [Frame(rows[i : i + ROWS], delay=100) for i in range(0, len(rows), ROWS)]
    return write_gif(Gif(WIDTH, min(len(rows), ROWS), GREYS, 0, frames))


def load(media: bytes) -> tuple[bytes, str]:
    """The payload as the shown frames have it, and a feature: frames, duration in ms, and the summed histogram."""
    parts, total, n, end = [], np.zeros(64, np.int64), 0, 0
    for f, start, canvas in read_gif(media).shown():
        place = canvas[f.top : f.top + f.indices.shape[0], f.left : f.left + f.indices.shape[1]]
        parts.append((place & 255).astype(np.uint8).tobytes())
        total += histogram(place)
        n, end = n + 1, start + f.delay
    return b"".join(parts), f"frames={n};ms={end};grey=" + ",".join(map(str, total[[0, 21, 42, 63]]))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media binary): each row's whole text as a GIF file; null counts as empty.

    Repeated rows and null doc_ids give a row each, an empty table none; other columns are not read."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([store(payload_of(t)) for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "media"])

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(text_rows(docs, id_col, text_col), make, f"doc_id {kind}, media binary")


FRAMES = "frame_no int, start_ms long, delay_ms int, disposal int, width int, height int, rgba binary, histogram array<long>, error string"


def gif_frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per shown frame of every file: its canvas (RGBA bytes), its time and its 64-bin colour histogram.

    Frames are handed on as soon as their canvases hold HELD bytes, so a worker holds one file, that and one canvas. Null media give no row. A file that
    can't be read gives one row whose error says why; one whose fault shows only while frames are drawn gives the
    frames before it and that row. Repeated rows and null ids give their frames each."""
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *(x.split()[0] for x in FRAMES.split(", "))]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()]

        def frames(data: bytes) -> Iterator[tuple]:
            try:
                for k, (f, start, c) in enumerate(read_gif(data).shown()):
                    yield k, start, f.delay, f.disposal, c.shape[1], c.shape[0], c.tobytes(), histogram(c).tolist(), None
            except ValueError as e:
                yield *(None,) * 8, str(e)

        for batch in batches:
            owner, rows, held = [], [], 0
            made = lambda: pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names)  # noqa: B023, E731
            for i in range(batch.num_rows):
                if (data := batch.column(1)[i].as_py()) is None:
                    continue
                for row in frames(data):
                    owner.append(i)
                    rows.append(row)
                    held += len(row[6] or b"")
                    if held >= HELD or len(rows) >= FRAME_ROWS:
                        yield made()
                        owner, rows, held = [], [], 0
            if rows:
                yield made()

    small_batches(media.sparkSession)
    return text_rows(media, id_col, media_col).mapInArrow(run, f"doc_id {kind}, {FRAMES}")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: sizes and digests of the stored GIF and of the payload read back from it.

    Null counts as empty; equal texts give equal values; repeated rows and null ids give a row each."""

    def make():
        sha = hashlib.sha256

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in batch.column(1).to_pylist():
                media = store(payload_of(text))
                payload, feature = load(media)
                rows.append((len((text or "").encode()), len(payload), sha(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), sha(media).hexdigest(), feature))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 7, types)]
            return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *(x.split()[0] for x in DIGESTS.split(", "))])

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(text_rows(docs, id_col, text_col), make, f"doc_id {kind}, {DIGESTS}")


DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def op10_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(documents(spark, sf_dir))


def gif_frame_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timed frames of every document's GIF: times, sizes, the canvas as a digest and its colour histogram."""
    frames = gif_frames(store_texts(documents(spark, sf_dir)))
    return frames.select("doc_id", "frame_no", "start_ms", "delay_ms", "width", "height", F.sha2("rgba", 256).alias("rgba_sha256"), F.array_join("histogram", ",").alias("histogram"), "error")
