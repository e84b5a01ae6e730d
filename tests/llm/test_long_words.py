"""Toxicity of runs of letters that are longer than a word's vectors cover."""

import random

import numpy as np

from codeloom.llm import toxicity


def test_pieces_cover_all_characters():
    for n in range(1, 200):
        word = "".join(chr(0x4E00 + k) for k in range(n))
        got = toxicity.words_of(word)
        assert all(len(p) <= toxicity.WORD_CHARS for p in got) and (len(got) == 1) == (n <= toxicity.WORD_CHARS)
        assert all(any(word[a : a + 12] in p for p in got) for a in range(n))


def test_long_words_are_hashed_whole():
    slots, grams = toxicity.word_features(["a" * 30 + "bcd", "a" * 30 + "xyz"])
    assert slots[0] != slots[1] and set(grams[0]) != set(grams[1])


def test_terms_behind_the_first_characters_count():
    r = random.Random(3)
    word = lambda: "".join(r.choice("bdfgklmn") for _ in range(6))
    texts, labels = [], []
    for i in range(300):
        w = [word() for _ in range(12)]
        if i % 3 == 0:
            w[r.randrange(12)] = "zzxqz"
        texts.append(" ".join(w))
        labels.append(int(i % 3 == 0))
    net = toxicity.fit(texts, labels)
    long = "".join(word() for _ in range(20))
    clean, toxic = net.score([long, long[:70] + "zzxqz" + long[70:]])
    assert np.isfinite([clean, toxic]).all() and toxic > clean
