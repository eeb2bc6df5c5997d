import hashlib
import struct
import zlib

import numpy as np
import pytest

from strandline.llm import gif


def test_query(spark, sf, edge):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    want = []
    for i, text in docs.collect():
        b = (text or "").encode()
        p = b.ljust(max(192, -(-len(b) // 192) * 192))
        want.append((repr(i), len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    got = gif.stored(docs).collect()
    assert sorted((repr(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted(want)


@pytest.mark.parametrize("compress", [False, True])
@pytest.mark.parametrize("lines", [1, 2, 63, 64, 65, 200])
def test_round_trip(compress, lines):
    rng = np.random.default_rng(lines)
    for body in (rng.integers(0, 256, 192 * lines).astype(np.uint8).tobytes(), bytes(192 * lines), (b"ab" * 96) * lines):
        media = gif.encode(body, compress=compress)
        frames = gif.decode(media)
        assert gif.samples_of(frames) == body and len(frames) == -(-lines // 64)
        assert [f.start_ms for f in frames] == [100 * i for i in range(len(frames))]
        assert sum(int(gif.histogram(f)[0].sum()) for f in frames) == len(body)


def test_any_stream_reads_as_the_fast_way():
    rng = np.random.default_rng(0)
    s = rng.integers(0, 256, 5000).astype(np.uint8)
    data = gif.lzw_literal(s)
    assert (gif._lzw_steps(data, 8, 5000) == s).all() and (gif.lzw_decode(data, 8, 5000) == s).all()
    for bits in (2, 4, 8):
        t = rng.integers(0, 1 << bits, 30_000).astype(np.uint8)
        assert (gif.lzw_decode(gif.lzw_compressed(t.tobytes(), bits), bits, len(t)) == t).all()


def movie(frames, width=4, height=4, interlace=False):
    """frames: (left, top, samples h x w, disposal, transparent or None, delay)."""
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x81, 0, 0), bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])]
    for left, top, s, disposal, clear, delay in frames:
        s = np.array(s, np.uint8)
        h, w = s.shape
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), delay, clear or 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, left, top, w, h, 0x40 if interlace else 0))
        if interlace:
            s = s[np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])]
        out += [b"\x02", gif._blocks(gif.lzw_compressed(s.tobytes(), 2))]
    return b"".join(out) + b";"


RED, GREEN, BLUE = (255, 0, 0), (0, 255, 0), (0, 0, 255)


def test_disposal_and_transparency():
    full, dot = np.full((4, 4), 1), [[2]]
    keep, back, restore = (gif.decode(movie([(0, 0, full, 1, None, 5), (1, 1, dot, d, None, 7), (2, 2, [[0, 3], [3, 0]], 1, 0, 9)])) for d in (1, 2, 3))
    for f in (keep, back, restore):
        assert [x.start_ms for x in f] == [0, 50, 120] and [x.delay_ms for x in f] == [50, 70, 90]
        assert tuple(f[1].rgb[1, 1]) == GREEN and tuple(f[2].rgb[2, 2]) == RED and tuple(f[2].rgb[2, 3]) == BLUE
    assert tuple(keep[2].rgb[1, 1]) == GREEN and tuple(back[2].rgb[1, 1]) == (0, 0, 0) and tuple(restore[2].rgb[1, 1]) == RED


def test_interlace():
    s = np.arange(16).reshape(16, 1) % 4 + np.zeros((1, 4), int)
    a, b = (gif.decode(movie([(0, 0, s, 1, None, 0)], 4, 16, i))[0].rgb for i in (False, True))
    assert (a == b).all()


def test_frame_table_and_media(spark, edge):
    media = gif.media(edge)
    rows = gif.frames(media).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in edge.collect()}
    assert all(sum(r["red"]) == r["width"] * r["height"] and len(r["rgb"]) % 576 == 0 for r in rows)


def test_broken_media():
    for b in (b"", b"GIF89a", gif.encode(bytes(192))[:-30], b"PNG" + bytes(90)):
        with pytest.raises(ValueError):
            gif.decode(b)
    with pytest.raises(ValueError):
        gif.encode(b"x")


def test_no_rows(none):
    assert gif.stored(none).collect() == [] and gif.frames(gif.media(none)).collect() == []
