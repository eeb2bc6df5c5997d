import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from strandline.llm import packing, tokens


def ids_of(text):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return t.encode(text or "", add_special_tokens=False).ids


def held_to_the_rules(rows, docs, length):
    """docs: (doc_id, text); rows: the packed pieces."""
    want = []
    for i, text in docs:
        ids = np.array(ids_of(text) + [0], "<u4")
        for n, a in enumerate(range(0, len(ids), length)):
            part = ids[a : a + length]
            want.append((repr(i), n, a, len(part), zlib.crc32(part.tobytes())))
    assert sorted((repr(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in by.values():
        at = 0
        for offset, size in sorted(x):
            assert offset == at
            at += size
        assert at <= length
    return len(by), sum(x[3] for x in want)


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    n, total = held_to_the_rules(packing.op4_packing(spark, sf).collect(), docs, 2048)
    assert n <= 1.01 * -(-total // 2048) + 1


def test_edges(edge, none):
    docs = [(r["doc_id"], r["text"]) for r in edge.collect()]
    held_to_the_rules(packing.packed(edge, length=64).collect(), docs, 64)
    held_to_the_rules(packing.packed(edge, length=64, group=3).collect(), docs, 64)
    assert packing.packed(none).collect() == []


def test_squares_fall_as_fast_as_they_can():
    """Each placement is one of least sum of squares among open sequences with room."""
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 30, 200)
    seq, off, n = packing.sum_of_squares(sizes, 30)
    fill = {}
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        counts = np.bincount([30 - f for f in fill.values()], minlength=31)

        def squares(g):
            c = counts.copy()
            c[g] -= 1
            c[g - s] += 1
            return int((c[1:] ** 2).sum())

        fits = [g for g in range(s, 31) if counts[g]]
        if fits:
            g = 30 - fill[seq[i]]
            assert squares(g) == min(map(squares, fits))
        else:
            assert seq[i] not in fill
        assert off[i] == fill.get(seq[i], 0)
        fill[seq[i]] = off[i] + s
    assert len(fill) == n


def test_memo_is_exact():
    e = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", "a., b", "a, b. c.\nd», e.  f ., x!. y 9. Ç, ×. ÿ.\n", "<|STARTOFTEXT|> A<|endoftext|>", "Á. B́, ", "a\x1cb c d", "İ ΣΑΣ don't I'LL", "x" * 300]
    assert [np.frombuffer(b, "<u4").tolist() for b in e.encode([t.encode() for t in texts])] == [ids_of(t) for t in texts]
