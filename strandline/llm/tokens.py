"""Token ids of whole texts by a public tokenizer, word by word through a bounded memo.

Tokenizers of the word kind drop white space and never look across it, so the ids
of a text are those of its runs of other than ASCII white space, one after the
other. (Rarer white space stays inside a run, where the tokenizer itself treats
it.) Runs repeat, so each worker keeps the ids of those it has met, as packed
bytes: joining them gives a text's ids without a step per token. The memo is
bounded by ``MEMO`` runs; runs over ``LONG`` bytes are never kept.
"""

from __future__ import annotations

import os
import re
from array import array
from collections import ChainMap
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Runs kept: two generations of half as many, so common runs outlive rare ones.
MEMO = 900_000
LONG = 64
#: Bytes of text whose words are looked up at once.
PIECE = 1 << 21

#: A comma or full stop at a run's end is split off where it follows a letter or digit (ASCII or Latin-1): letters and
#: marks are separate pieces to the tokenizer anyway. After another mark both are one piece, and texts with that stay as they are.
_MARKS_MEET = re.compile(rb"[.,](?=[ \n])(?<![a-z0-9][.,])(?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][.,])")


#: Runs of ASCII letters in lower case and Latin-1 letters: no marks, digits or signs.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch


def _runs(text: bytes) -> list[bytes]:
    """Runs of other than white space. ASCII capitals are folded, as the tokenizer folds them, but where special tokens may stand."""
    if b"<|" not in text:
        text = text.lower()
    if not _MARKS_MEET.search(text):
        text = text.replace(b". ", b" . ").replace(b", ", b" , ").replace(b".\n", b" .\n")
    return text.split()


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary file lies on this machine (each worker asks for itself)."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit numbers in bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

        # tokens that end a word
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    def _learn(self, runs: list[bytes], into: dict[bytes, bytes]) -> None:
        """Runs of letters alone are one word each to the tokenizer: many are encoded as one text and parted at the ends of words."""
        words, rest = [], []
        for r in runs:
            (words if _LETTERS(r) else rest).append(r)
        for a in range(0, len(words), 4000):
            part = words[a : a + 4000]
            ids = np.array(self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False).ids, "<u4")
            end = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(end) != len(part):
                rest += part
                continue
            body, at = ids.tobytes(), 0
            for r, e in zip(part, end.tolist()):
                into[r] = body[at:e]
                at = e
        self._learn_each(rest, into)

    def _learn_each(self, runs: list[bytes], into: dict[bytes, bytes]) -> None:
        for a in range(0, len(runs), 20_000):
            part = runs[a : a + 20_000]
            found = self.tokenizer.encode_batch_fast([r.decode("utf-8", "replace") for r in part], add_special_tokens=False)
            for r, e in zip(part, found):
                into[r] = array("I", e.ids).tobytes()

    def _lookup(self, met: set[bytes]) -> dict[bytes, bytes]:
        """A table with all of ``met``."""
        if len(self.young) + len(met) > MEMO // 2:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        met -= young.keys()
        kept = met & old.keys()
        young.update((r, old[r]) for r in kept)
        met -= kept
        long = [r for r in met if len(r) > LONG]
        self._learn([r for r in met if len(r) <= LONG], young)
        if not long:
            return young
        once: dict[bytes, bytes] = {}
        self._learn(long, once)
        return ChainMap(once, young)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """One bytes object for each text; equal texts give equal bytes."""
        out, i = [], 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < PIECE):
                size += len(texts[j])
                j += 1
            split = [_runs(t) for t in texts[i:j]]
            get = self._lookup(set().union(*split)).__getitem__
            out += [b"".join(map(get, s)) for s in split]
            i = j
        return out


@lru_cache(2)
def encoder(name: str) -> Encoder:
    return Encoder(vocabulary_path(name))


def text_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return pc.fill_null(texts, "").cast(pa.binary()).to_pylist()
