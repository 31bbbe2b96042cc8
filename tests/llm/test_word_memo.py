"""What the tokenizers library is given, its ids, and the bound of a packing."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers

from demandloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_new_words_reach_the_library_in_runs():
    """Without an added token to part them, too: the ids tell where a word begins."""
    tok, given = packing._Tokens(PATH), []
    tok.border, plain = None, tok._plain
    tok._plain = lambda texts: given.append(len(texts)) or plain(texts)
    text = " ".join(f"wort{k}" for k in range(300)) + "\nzeile, wort7."
    assert list(tok.encode([text])) == plain([text])
    assert sum(given) < 10


def test_words_have_the_ids_of_the_library():
    r, tok = random.Random(5), packing._Tokens(PATH)
    parts = ["a", "b", "Zé", "'s", "n't", " ", " ", "\n", "\n", "\t", "  ", ".", ",", "12", "\0", " ", "　", "中", "\U0001f600", tok.added[0], "\r", "Ġ", "Ċ", "!?", "\x1c", "$#"]
    texts = ["".join(r.choice(parts[: r.choice([9, 15, 26])]) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    assert list(tok.encode(texts)) == tok._plain(texts)


def test_lower_bound_is_that_of_every_cut():
    r = random.Random(3)
    for _ in range(200):
        s = np.sort(np.array([r.randint(1, r.choice([300, 1024, 2047])) for _ in range(r.randint(0, 40))], np.int32))[::-1]
        best = int(-(-s.sum() // 2048)) if len(s) else 0
        for k in range(1, 1025):
            big, mid, low = s > 2048 - k, (s <= 2048 - k) & (s > 1024), (s <= 1024) & (s >= k)
            best = max(best, int(big.sum() + mid.sum() + max(0, -(-(s[low].sum() - mid.sum() * 2048 + s[mid].sum()) // 2048))))
        assert packing.lower_bound(s, 2048) == best
