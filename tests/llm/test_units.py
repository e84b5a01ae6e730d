"""Parts without Spark, held against plain versions."""

import difflib
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
import regex
import xxhash

from codeloom.llm import bpe, langid, licenses, linededup, media, mixing, simhash, tokencount, toxicity
from codeloom.llm.queries import tokenizer_path

ALPHABET = "abc dé'stre  \n\t\r\x0b\x1c\x85\xa0​　 12３²ß中文日😀.,!'ll've|<>|endoftext́­_"


def texts(n, seed=1):
    r = random.Random(seed)
    out = ["", " ", "\n", "a", "<|endoftext|>", "x<|endoftext|>y  <|endoftext|>", "a" * 3000, "it's  they'll\n\n\n x"]
    return out + ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_bpe_is_that_of_the_library():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(tokenizer_path()), bpe.BpeCodec(tokenizer_path())
    for t in texts(1500):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == ids, t
        assert own.decode(np.array(ids)) == lib.decode(ids, skip_special_tokens=False), t
    assert own.encode(None).tolist() == []


def test_bpe_forgets_without_changing_results(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 3)
    a, b = bpe.BpeCodec(tokenizer_path()), bpe.codec(tokenizer_path())
    for t in texts(50):
        assert a.encode(t).tolist() == b.encode(t).tolist()


def test_merge_by_scanning():
    """The heap gives what picking the lowest rank again and again gives."""
    c = bpe.codec(tokenizer_path())
    r = random.Random(5)
    for _ in range(300):
        w = "".join(r.choice("etaoinshr") for _ in range(r.randint(1, 20)))
        ids = [c.byte_id[x] for x in w.encode()]
        while True:
            ranks = [(p[0], i, p[1]) for i in range(len(ids) - 1) if (p := c.pairs.get(ids[i] << 24 | ids[i + 1]))]
            if not ranks:
                break
            _, i, new = min(ranks)
            ids[i : i + 2] = [new]
        assert c.merge(w) == ids


def test_fingerprint_by_counting_bits():
    r = random.Random(2)
    for n in (0, 1, 2, 3, 4, 70, 400):
        t = "  ".join(r.choice(["Aa", "b", "É", "c d"]) for _ in range(n)) + "\t"
        w = regex.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
        assert simhash.fingerprint(simhash.shingle_hashes(t, 3)) % (1 << 64) == want
    assert simhash.fingerprint(simhash.shingle_hashes(None, 3)) == 0


def greedy_phrases(text, known):
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in known:
            j += 1
        i = max(j - 1, i + 1)
        n += 1
    return n


def known_substrings(m, train):
    joined = {k: "".join("".join(map(chr, np.append(langid.folded(t), 32))) for t in train[k]) for k in m.langs}
    return {k: {t[a:b] for a in range(len(t)) for b in range(a + 1, len(t) + 1)} for k, t in joined.items()}


def test_phrases_by_greedy_search(monkeypatch):
    train = {"x": ["the cat sat on the mat"], "y": ["le chat est sur la table"]}
    m = langid.Model(train)
    known = known_substrings(m, train)
    r = random.Random(8)
    texts = ["the chat sat", "zzz", "la mat est on", "a", "", "the cat sat on the mat" * 200, "zq" * 1500, "la cat " * 700]
    texts += ["".join(r.choice("the catsonmlurb z\u4e2d") for _ in range(r.choice([5, 511, 512, 513, 3000]))) for _ in range(30)]
    folded = [langid.folded(s) for s in texts]
    want = [[greedy_phrases("".join(map(chr, f)), known[k]) for k in m.langs] for f in folded]
    for piece in (512, 7, 1):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert m.phrases([m.encode(f) for f in folded]).tolist() == want


def test_phrases_of_a_large_alphabet():
    """Thousands of symbols, beyond the first plane too, and many languages keep exact counts."""
    r = random.Random(3)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 2000)] + [chr(c) for c in range(0x20000, 0x20000 + 300)]
    train = {f"l{k}": ["".join(r.choices(letters[700 * (k % 3) :], k=120)) + " abc" * k] for k in range(6)}
    m = langid.Model(train)
    known = known_substrings(m, train)
    texts = ["".join(r.choice([train[k][0][a : a + 9], r.choice(letters)]) for a in r.sample(range(100), 40)) for k in m.langs]
    folded = [langid.folded(t) for t in texts]
    assert m.phrases([m.encode(f) for f in folded]).tolist() == [[greedy_phrases("".join(map(chr, f)), known[k]) for k in m.langs] for f in folded]
    assert m.slots.nbytes + m.base.nbytes < 2_000_000


def test_languages_of_short_rows_are_learned(spark):
    rows = [(i, f"un mot {i % 7}", "fr") for i in range(80)] + [(100 + i, "the quick brown fox jumps over it " * 9 + str(i), "en") for i in range(80)] + [(300, "!!", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.train(docs)
    assert m.langs == ["en", "fr"] and [x[0] for x in m.predict(["un mot", "quick brown", "!!", None])] == ["fr", "en", "und", "und"]
    clashing = docs.withColumn("lang_pred", F.lit("a")).withColumn("score", F.lit(1))
    assert langid.identify(clashing, m, clashing.columns).columns == ["doc_id", "text", "lang", "lang_pred", "score", "lang_pred_", "score_"]


def test_language_edges():
    m = langid.Model({"x": ["the cat sat on the mat and that is that"], "y": ["le chat est sur la table et voila"]})
    assert [p[0] for p in m.predict([None, "", "12 !?", "the cat is on that", "sur la table"])] == ["und", "und", "und", "x", "y"]
    long = "the cat sat on the mat " * 5000
    assert m.predict([long, long]) == m.predict([long]) * 2
    assert langid.Model({}).predict(["text"]) == [("und", 0.0)]


def lcs_like(a, b):
    return [(x, y) for x, y, n in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() for x, y in zip(range(x, x + n), range(y, y + n))]


def test_patience():
    r = random.Random(4)
    for _ in range(300):
        a = [r.randint(0, 30) for _ in range(r.randint(0, 25))]
        b = a[:]
        for _ in range(r.randint(0, 4)):
            b.insert(r.randint(0, len(b)), r.randint(31, 40))
        got = linededup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p < q and s < t for (p, s), (q, t) in zip(got, got[1:]))
    assert linededup.patience([1, 2, 3, 4], [9, 1, 2, 8, 3, 4]) == [(0, 1), (1, 2), (2, 4), (3, 5)]
    assert linededup.patience([5, 5, 5], [5, 5]) == [(0, 0), (1, 1)]
    assert linededup.common_blocks([1, 2, 3], [7, 1, 2, 3], [9, 10, 10, 1], 20) == [1, 2, 3]
    assert linededup.common_blocks([1, 2, 3], [1, 7, 2], [10, 1, 10], 20) == []


def test_png_round_trip():
    for data in (b"", b"a", bytes(range(256)) * 5, b"x" * 64):
        payload = media.padded(data)
        assert len(payload) % 64 == 0 and payload[: len(data)] == data and not any(payload[len(data) :])
        png = media.to_png(payload)
        assert media.from_png(png) == payload
        assert media.read_header(png[:33]) == {"width": 64, "height": len(payload) // 64, "bit_depth": 8, "channels": 1}
        assert media._examine(png)["tail_crc32"] == zlib.crc32(payload[-64:])
    with pytest.raises(ValueError):
        media.read_header(b"\0" * 33)


def test_attribution_by_bytes():
    r = random.Random(6)
    for _ in range(200):
        tokens = np.cumsum([r.randint(1, 4) for _ in range(r.randint(0, 12))])
        total = int(tokens[-1]) if len(tokens) else 0
        cuts = sorted(r.randint(0, total) for _ in range(r.randint(0, 4))) + [total]
        whole, weighted = tokencount.attribute(tokens, np.array(cuts))
        starts = [0, *tokens.tolist()[:-1]] if len(tokens) else []
        section = lambda byte: next(i for i, e in enumerate(cuts) if byte < e)  # noqa: B023, E731
        want_w, want = [0.0] * len(cuts), [0] * len(cuts)
        for s, e in zip(starts, tokens.tolist()):
            want[section(s)] += 1
            for byte in range(s, e):
                want_w[section(byte)] += 1 / (e - s)
        assert whole.tolist() == want and np.allclose(weighted, want_w)


def test_licences():
    mit = next(t for n, k, t in licenses.KNOWN if n == "MIT" and k == "text")
    known = licenses.known_digests()
    changed = "Copyright (c) 2020 Some Body\n\n" + mit.replace("Software", "SOFTWARE").replace(",", " , ").replace("sublicense", "sub-license") + "\nAll rights reserved.\n"
    assert known[licenses.digest(licenses.canonical(changed))][0] == "MIT"
    assert licenses.digest(licenses.canonical(mit + " more")) not in known
    assert licenses.canonical("A  Licence,\nof the COPYRIGHT OWNER") == "a license of the copyright holder"
    assert licenses.canonical(None) == "" and licenses.canonical("Copyright 2020 X") == ""


def test_targets_and_flow():
    t = mixing.targets({"a": 100, "b": 100, None: 10, "c": 0})
    assert list(t) and float(sum(t.values())) == pytest.approx(315.0) and t["a"] == 200 and t["c"] == 0 and t[None] <= 20
    got = mixing.flow({("a",): 10, ("a", "b"): 10, ("b",): 1}, {"a": 12, "b": 14})
    assert sum(v for (p, s), v in got.items() if s == "a") == 12 and sum(v for (p, s), v in got.items() if s == "b") == 14
    # repeats cost: 26 words of 21 need 5 repeated ones at least, and no more
    used = {p: sum(v for (q, _), v in got.items() if q == p) for p in (("a",), ("a", "b"), ("b",))}
    assert sum(max(0, used[p] - n) for p, n in ((("a",), 10), (("a", "b"), 10), (("b",), 1))) == 5
    assert mixing.flow({}, {}) == {}


def test_network_gradients():
    net = toxicity.Network(1)
    r = np.random.default_rng(0)
    for k in ("word", "gram"):
        net.p[k] = r.standard_normal(net.p[k].shape).astype(np.float32) * 0.3
    slots, grams = toxicity.word_features(["idiot", "clown", "éa", "b"])
    ids = np.array([[0, 1, 2, 3, 1], [3, 3, 2, 0, 0], [1, 1, 1, 2, 2]], np.int32)
    y, weight = np.array([1, 0, 1], np.float32), np.ones(3, np.float32)
    g = net.gradients((slots, grams), ids, y, weight)

    def loss():
        p = toxicity.squash(net.run(net.project(net.inputs(slots, grams)), ids).astype(np.float64))
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    for k in ("wx", "u", "wa", "va", "wo", "bo", "bx"):
        at = tuple(r.integers(0, n) for n in net.p[k].shape)
        old, eps = net.p[k][at], 1e-2
        net.p[k][at] = old + eps
        up = loss()
        net.p[k][at] = old - eps
        down = loss()
        net.p[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / (2 * eps), abs=3e-3), k


def test_toxicity_learns_stems():
    r = random.Random(1)
    plain = ["".join(r.choice(["the", "on", "er", "ing", "at"]) for _ in range(r.randint(1, 3))) for _ in range(300)]
    docs, labels = [], []
    for i in range(400):
        w = [r.choice(plain) for _ in range(r.randint(10, 90))]
        if i % 4 == 0:
            for _ in range(4):
                w[r.randrange(len(w))] = "bad" + r.choice(["ly", "ness", "der", "dest", "s"])
        docs.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    net = toxicity.fit(docs[:300], labels[:300])
    s = net.score(docs[300:]) >= 0.3
    assert (s == np.array(labels[300:])).mean() >= 0.95
    assert net.score([None, "", "12 34"]).tolist() == [0.0, 0.0, 0.0]
    a, b = net.score([docs[0], docs[0]])
    assert a == b and toxicity.fit(["a"], [1]) is None and toxicity.fit([], []) is None


def test_windows_cover_all():
    for n in range(1, 200):
        seen = {i for s in toxicity.starts_of(n) for i in range(s, min(n, s + toxicity.SPAN))}
        assert seen == set(range(n))


def test_digest():
    assert licenses.digest("") == hashlib.sha256(b"").hexdigest()


def test_field_counts_by_offsets(spark):
    """Tokens start where the library says; fields hold the separator, are null or empty, ids are tied."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rows = [(1, "a b\x1e\nc", "d\ne"), (1, None, ""), (2, "one", " two"), (3, "x" * 500 + "\n", "y")]
    got = tokencount.field_counts(spark.createDataFrame(rows, "k long, t string, u string").coalesce(1), tokenizer_path(), "k", ["t", "u"]).collect()
    want = []
    for k, *fields in rows:
        first, second = (f or "" for f in fields)
        starts = [a for a, _ in tok.encode(f"{first}\n{second}", add_special_tokens=False).offsets]
        want += [(k, "t", sum(a <= len(first) for a in starts)), (k, "u", sum(a > len(first) for a in starts))]
    assert [(r["k"], r["field"], r["n_tokens"]) for r in got] == want
