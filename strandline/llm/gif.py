"""GIF media columns: bytes stored as timed frames of 8-bit samples, and GIFs read back.

Reading follows the format in full: colour tables global and local, LZW code
streams with growing codes, interlace, transparency, delays, and disposal (keep,
clear to background, restore what was there). Frames come composed, as RGB.

Writing lays bytes out as rows of ``WIDTH`` samples, ``ROWS`` rows to a frame, on
a grey ramp, so that a sample's value is its colour. Code streams are written with
strings as they occur (or, if asked, as single-sample codes with a clear code before
codes would grow to 10 bits). How wide a code is depends only on its place after the
last clear code, so both sides pack and unpack whole runs of codes in numpy and walk
the string table a code at a time.

Defined results: null and empty texts are stored as one row of spaces; equal
texts have equal media; repeated rows are stored each; null ids stay; other
columns are ignored; broken media raise ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

WIDTH = 192
ROWS = 64
DELAY = 10  # hundredths of a second
GREY = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))
#: Samples between clear codes: codes grow to 10 bits at the 255th.
LITERALS = 250
BINS = 16


class Frame(NamedTuple):
    """A composed frame: RGB pixels of the whole canvas, its own rectangle, its time and rules."""

    rgb: np.ndarray
    box: tuple[int, int, int, int]  # left, top, width, height
    start_ms: int
    delay_ms: int
    disposal: int
    transparent: int | None


def _pack9(codes: np.ndarray) -> bytes:
    """9-bit codes, low bits first."""
    size = -(-len(codes) * 9 // 8)
    c = np.zeros(-(-len(codes) // 8) * 8, np.uint64)
    c[: len(codes)] = codes
    c = c.reshape(-1, 8)
    low = c[:, 0].copy()
    for k in range(1, 8):
        low |= c[:, k] << np.uint64(9 * k)
    out = np.empty((len(c), 9), np.uint8)
    out[:, :8] = low.view(np.uint8).reshape(-1, 8)
    out[:, 8] = c[:, 7] >> np.uint64(1)
    return out.tobytes()[:size]


def lzw_literal(samples: np.ndarray) -> bytes:
    """A code stream of single samples (8 bits each), with clear codes in time."""
    n = len(samples)
    runs = max(1, -(-n // LITERALS))
    codes = np.full((runs, LITERALS + 1), 256, np.uint16)
    padded = np.zeros(runs * LITERALS, np.uint16)
    padded[:n] = samples
    codes[:, 1:] = padded.reshape(runs, LITERALS)
    return _pack9(np.append(codes.reshape(-1)[: n + runs], np.uint16(257)))


def widths(n: int, bits: int) -> np.ndarray:
    """Bits of the first ``n`` codes from a clear code on: both sides know one string more with each code after the first."""
    known = np.arange(n) + (1 << bits) + 1
    return np.clip(np.frexp(known.astype(float))[1], bits + 1, 12)


def lzw_codes(samples: bytes, bits: int = 8) -> list[list[int]]:
    """Codes with strings as they occur, a run for each filling of the table; every run begins with a clear code."""
    clear = 1 << bits
    run, fresh, strings = [clear], clear + 2, {}
    runs = [run]
    if samples:
        at, known, put = samples[0], strings.get, run.append
        for s in samples[1:]:
            pair = at << 8 | s
            code = known(pair)
            if code is not None:
                at = code
                continue
            put(at)
            if fresh < 4096:
                strings[pair] = fresh
                fresh += 1
            else:
                run, fresh, strings = [clear], clear + 2, {}
                known, put = strings.get, run.append
                runs.append(run)
            at = s
        put(at)
    run.append(clear + 1)
    return runs


def lzw_compressed(samples: bytes, bits: int = 8) -> bytes:
    """A code stream with strings as they occur; the table starts anew when full."""
    runs, codes, size, last = lzw_codes(samples, bits), [], [], bits + 1
    for run in runs:
        w = widths(len(run) - 1, bits)
        codes.append(run)
        # a clear code has the width that the table before it had
        size.append(np.concatenate([[last], w]))
        last = int(widths(len(run), bits)[-1])
    code, size = np.concatenate(codes).astype(np.uint32), np.concatenate(size)
    at = np.zeros(len(code) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    shifted = code << (at[:-1] & 7).astype(np.uint32)
    out = np.zeros((int(at[-1]) + 7) // 8 + 3, np.uint32)
    byte = at[:-1] >> 3
    for k in range(3):  # codes don't overlap, so adding sets bits
        out[: len(out)] += np.bincount(byte + k, (shifted >> np.uint32(8 * k)) & np.uint32(255), len(out)).astype(np.uint32)
    return out[: (int(at[-1]) + 7) // 8].astype(np.uint8).tobytes()


def _codes_from(raw: np.ndarray, at: int, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The next codes from bit ``at`` on (right after a clear code), ``n`` at most, and where each ends."""
    ends = at + np.cumsum(widths(n, bits))
    ends = ends[: np.searchsorted(ends, (len(raw) - 3) * 8, "right")]
    begin = np.concatenate([[at], ends[:-1]])[: len(ends)]
    byte = begin >> 3
    value = raw[byte] | raw[byte + 1] << np.uint32(8) | raw[byte + 2] << np.uint32(16)
    return (value >> (begin & 7).astype(np.uint32)) & ((np.uint32(1) << (ends - begin).astype(np.uint32)) - np.uint32(1)), ends


def lzw_decode(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` samples of a code stream."""
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.zeros(len(data) + 3, np.uint32)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    at, size, room = 0, 0, count + 2
    while size < count:
        # a run is read whole: up to its next clear code, its end or the end of the data
        codes, ends = _codes_from(raw, at, room, bits)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stop[0]) if len(stop) else len(codes)
        strings, last = list(base), b""
        add, put = strings.append, out.append
        for code in codes[:n].tolist():
            if code < len(strings):
                said = strings[code]
                if last and len(strings) < 4096:
                    add(last + said[:1])
            elif code == len(strings) and last:
                said = last + last[:1]
                add(said)
            else:
                raise ValueError("a code that isn't in the table")
            last = said
            put(said)
            size += len(said)
            if size >= count:
                break
        if n == len(codes) or codes[n] == end:
            break
        at = int(ends[n])
    return np.frombuffer(b"".join(out), np.uint8)[:count]


def _lzw_steps(data: bytes, bits: int, count: int) -> np.ndarray:
    """Any code stream, byte by byte: the plain form that tests hold ``lzw_decode`` to."""
    clear, end = 1 << bits, (1 << bits) + 1
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    strings, width, last = list(base), bits + 1, None
    out, size, acc, filled = [], 0, 0, 0
    for byte in data:
        acc |= byte << filled
        filled += 8
        while filled >= width:
            code = acc & ((1 << width) - 1)
            acc >>= width
            filled -= width
            if code == clear:
                strings, width, last = list(base), bits + 1, None
                continue
            if code == end:
                return np.frombuffer(b"".join(out), np.uint8)
            if code < len(strings):
                said = strings[code]
            elif code == len(strings) and last is not None:
                said = last + last[:1]
            else:
                raise ValueError("a code that isn't in the table")
            if last is not None and len(strings) < 4096:
                strings.append(last + said[:1])
                if len(strings) == 1 << width and width < 12:
                    width += 1
            last = said
            out.append(said)
            size += len(said)
            if size >= count:
                return np.frombuffer(b"".join(out), np.uint8)
    return np.frombuffer(b"".join(out), np.uint8)


def _blocks(data: bytes) -> bytes:
    """Sub-blocks of 255 bytes, and the empty one."""
    n = len(data) // 255
    body = np.empty((n, 256), np.uint8)
    body[:, 0] = 255
    body[:, 1:] = np.frombuffer(data, np.uint8, n * 255).reshape(n, 255)
    rest = data[n * 255 :]
    return body.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY, compress: bool = True) -> bytes:
    """A GIF of the payload, a positive multiple of ``width`` bytes."""
    lines = len(payload) // width
    if not lines or lines * width != len(payload):
        raise ValueError("the payload must be a positive multiple of the width")
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, lines), 0xF7, 0, 0), GREY]
    samples = np.frombuffer(payload, np.uint8)
    for top in range(0, lines, rows):
        part = samples[top * width : (top + rows) * width]
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay, 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, width, len(part) // width, 0))
        out += [b"\x08", _blocks(lzw_compressed(part.tobytes()) if compress else lzw_literal(part))]
    out.append(b";")
    return b"".join(out)


def decode(media: bytes) -> list[Frame]:
    """The composed frames of a GIF."""
    if media[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    try:
        return _decode(media)
    except (IndexError, struct.error) as e:
        raise ValueError("the GIF ends too soon") from e


def _decode(media: bytes) -> list[Frame]:
    width, height, packed, back, _ = struct.unpack_from("<HHBBB", media, 6)
    at, common = 13, None
    if packed & 0x80:
        size = 3 << ((packed & 7) + 1)
        common = np.frombuffer(media, np.uint8, size, at).reshape(-1, 3)
        at += size
    ground = common[back] if common is not None and back < len(common) else np.zeros(3, np.uint8)
    canvas = np.empty((height, width, 3), np.uint8)
    canvas[:] = ground
    frames: list[Frame] = []
    clock, delay, disposal, clear = 0, 0, 0, None
    while True:
        kind = media[at]
        at += 1
        if kind == 0x3B:
            return frames
        if kind == 0x21:
            label = media[at]
            at += 1
            if label == 0xF9:
                rules, delay, index = struct.unpack_from("<BHB", media, at + 1)
                disposal, clear = (rules >> 2) & 7, index if rules & 1 else None
            while size := media[at]:
                at += size + 1
            at += 1
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", media, at)
        at += 9
        palette = common
        if packed & 0x80:
            size = 3 << ((packed & 7) + 1)
            palette = np.frombuffer(media, np.uint8, size, at).reshape(-1, 3)
            at += size
        if palette is None:
            raise ValueError("a frame without colours")
        bits = media[at]
        at += 1
        parts = []
        while size := media[at]:
            parts.append(media[at + 1 : at + 1 + size])
            at += size + 1
        at += 1
        samples = lzw_decode(b"".join(parts), bits, w * h)
        if len(samples) < w * h:
            raise ValueError("a frame with too few samples")
        image = samples.reshape(h, w)
        if packed & 0x40:
            order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(image)
            straight[order] = image
            image = straight
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        if len(palette) < 256:
            palette = np.vstack([palette, np.zeros((256 - len(palette), 3), np.uint8)])
        colours = palette[image[: area.shape[0], : area.shape[1]]]
        if clear is None:
            area[:] = colours
        else:
            seen = image[: area.shape[0], : area.shape[1]] != clear
            area[seen] = colours[seen]
        frames.append(Frame(canvas.copy(), (left, top, w, h), clock, delay * 10, disposal, clear))
        clock += delay * 10
        if disposal == 2:
            area[:] = ground
        elif before is not None:
            canvas = before
        delay, disposal, clear = 0, 0, None


def histogram(frame: Frame, bins: int = BINS) -> np.ndarray:
    """Counts of the frame's own pixels by red, green and blue, ``bins`` each."""
    left, top, w, h = frame.box
    pixels = frame.rgb[top : top + h, left : left + w].reshape(-1, 3)
    step = 256 // bins
    return np.array([np.bincount(pixels[:, c], minlength=256).reshape(bins, step).sum(1) for c in range(3)])


def payload_of(text: bytes, width: int = WIDTH) -> bytes:
    """The text, filled with spaces to a positive multiple of the width."""
    return text.ljust(max(1, -(-len(text) // width)) * width)


def samples_of(frames: list[Frame]) -> bytes:
    """The bytes that ``encode`` stored: each frame's own rectangle, on the grey ramp."""
    return b"".join(f.rgb[f.box[1] : f.box[1] + f.box[3], f.box[0] : f.box[0] + f.box[2], 0].tobytes() for f in frames)


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in column:
        yield (x.as_py() or "").encode()


def media(docs: DataFrame) -> DataFrame:
    """doc_id and its text as a GIF."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gifs = [encode(payload_of(t)) for t in _texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(gifs, pa.binary())], ["doc_id", "gif"])

    return docs.select("doc_id", "text").mapInArrow(store, "doc_id long, gif binary")


FRAMES = "doc_id long, frame int, start_ms long, delay_ms int, disposal int, left int, top int, width int, height int, rgb binary, red array<int>, green array<int>, blue array<int>"


def frames(gifs: DataFrame) -> DataFrame:
    """Timed frames of (doc_id, gif) rows, with pixels and colour histograms; a null GIF has none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            for i, one in zip(batch.column("doc_id").to_pylist(), batch.column("gif")):
                if one.as_py() is None:
                    continue
                rows = []
                for n, f in enumerate(decode(one.as_py())):
                    red, green, blue = histogram(f).tolist()
                    rows.append(dict(zip(_FRAME_NAMES, (i, n, f.start_ms, f.delay_ms, f.disposal, *f.box, f.rgb.tobytes(), red, green, blue))))
                if rows:
                    schema = schema or _frame_schema()
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return gifs.select("doc_id", "gif").mapInArrow(read, FRAMES)


_FRAME_NAMES = ["doc_id", "frame", "start_ms", "delay_ms", "disposal", "left", "top", "width", "height", "rgb", "red", "green", "blue"]


def _frame_schema() -> pa.Schema:
    kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.int32()] * 6, pa.binary(), *[pa.list_(pa.int32())] * 3]
    return pa.schema(list(zip(_FRAME_NAMES, kinds)))


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_ms long"


def stored(docs: DataFrame) -> DataFrame:
    """Each text stored as a GIF, read back, and digested; media pass from one to the other a document at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in _texts(batch.column("text")):
                gif = encode(payload_of(text))
                shown = decode(gif)
                back = samples_of(shown)
                counts = np.sum([histogram(f)[0] for f in shown], axis=0)
                last = shown[-1]
                rows.append(
                    (
                        len(text),
                        len(back),
                        hashlib.sha256(back).hexdigest(),
                        zlib.crc32(back[-16:]),
                        len(gif),
                        hashlib.sha256(gif).hexdigest(),
                        f"{last.rgb.shape[1]}x{last.rgb.shape[0]}x{len(shown)};" + ",".join(map(str, counts.tolist())),
                        len(shown),
                        last.start_ms + last.delay_ms,
                    )
                )
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]
                arrays = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]
                names = [c.split()[0] for c in DIGEST.split(", ")]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *arrays], names)

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST)


def op7_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(table(spark, sf_dir, "documents"))
