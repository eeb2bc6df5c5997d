import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer


def brute_pieces(rows, length=2048):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for i, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for n, a in enumerate(range(0, len(ids), length)):
            out.append((i, n, len(ids[a : a + length]), zlib.crc32(ids[a : a + length].tobytes())))
    return sorted(out)
