import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from estatelens.llm import suffix_dedup
from estatelens.llm.queries import QUERIES


def by_brute_force(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(r, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def sample_texts(seed, alphabet="ab é"):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [make(rng.randint(15, 90)) for _ in range(6)]
    texts = [make(rng.randint(0, 60)) + rng.choice(shared) + make(rng.randint(0, 60)) + rng.choice(shared) for _ in range(30)]
    return [*texts, texts[0], texts[0], "", "", None, "x" * 300, "xy" * 200, "short", "short", make(19), make(20)]


def test_suffix_order_is_the_plain_one():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 50, 400):
        for sigma in (1, 2, 4, 200):
            data = rng.integers(1, sigma + 1, n).astype(np.uint8).tobytes()
            assert suffix_dedup.suffix_order(data).tolist() == sorted(range(n), key=lambda i: data[i:])


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, docs, folder, monkeypatch, seed):
    monkeypatch.setattr(suffix_dedup, "LENGTH", 20)
    monkeypatch.setattr(suffix_dedup, "K", 6)
    monkeypatch.setattr(suffix_dedup, "BATCH", 500)
    monkeypatch.setattr(suffix_dedup, "BLOCK_CHARS", 700)
    monkeypatch.setattr(suffix_dedup, "HASHED_AT_ONCE", 300)
    texts = sample_texts(seed)
    found = {r.doc_id: r for r in QUERIES["op8_suffix_dedup"](spark, folder(documents=docs(texts))).collect()}
    got = [(found[i].n_bytes, found[i].n_removed, found[i].n_spans, found[i].kept_sha256) for i in range(len(texts))]
    assert got == by_brute_force(texts, 20)


def test_full_length_and_empty_table(docs):
    passage = "".join(random.Random(5).choice("abcdefgh \n") for _ in range(700))
    texts = ["A" + passage + "B", "C" + passage, passage[:399], passage[100:500] + "z", "q" * 399, "q" * 399]
    found = {r.doc_id: r for r in suffix_dedup.dedup(docs(texts), keep_text=True).collect()}
    want = by_brute_force(texts, 400)
    assert [(found[i].n_bytes, found[i].n_removed, found[i].n_spans, found[i].kept_sha256) for i in range(6)] == want
    assert found[0].kept == b"AB" and found[3].kept == b"z" and found[4].kept == b"q" * 399
    assert suffix_dedup.dedup(docs([])).count() == 0


def passages_by_brute_force(texts, length, words):
    """The bytes that stay, and the runs of words in repeated passages; copies of that many words go whole."""
    raw = [(t or "").encode() for t in texts]
    found = [list(re.finditer(rb"[^\x20\x09-\x0D]+", r)) for r in raw]
    windows = [[b" ".join(m.group() for m in ms[i:i + words]) for i in range(len(ms) - words + 1)] for ms in found]
    seen, seen_bytes = Counter(w for ws in windows for w in ws), Counter(r[i:i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r, ms, ws in zip(raw, found, windows):
        gone, hit = bytearray(len(r)), [False] * len(ms)
        for i, w in enumerate(ws):
            if seen[w] > 1:
                hit[i:i + words] = [True] * words
        for i, m in enumerate(ms):
            if hit[i]:  # with the white space after it if the next word goes too
                end = ms[i + 1].start() if hit[i + 1:i + 2] == [True] else m.end()
                gone[m.start():end] = b"\x01" * (end - m.start())
        for i in range(len(r) - length + 1):
            if seen_bytes[r[i:i + length]] > 1:
                gone[i:i + length] = b"\x01" * length
        if raw.count(r) > 1 and len(ms) >= words:
            gone = bytearray(b"\x01" * len(r))
        kept = bytes(c for c, g in zip(r, gone) if not g)
        out.append((kept, sum(gone), sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_of_words_against_brute_force(docs, monkeypatch, seed):
    for name, value in (("LENGTH", 25), ("K", 8), ("WORDS", 5), ("WORD_K", 2), ("BATCH", 300), ("BLOCK_CHARS", 700), ("HASHED_AT_ONCE", 300)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijkl") * rng.choice([1, 1, 2, 9]) + rng.choice(["", "é", "."])
    join = lambda ws: "".join(w + rng.choice([" ", " ", "\n", " \t"]) for w in ws)
    make = lambda n: [word() for _ in range(n)]
    shared = [make(n) for n in (4, 5, 5, 6, 9, 14)]
    texts = [join(make(rng.randint(0, 12)) + rng.choice(shared) + make(rng.randint(0, 12)) + rng.choice(shared)) for _ in range(30)]
    texts += [texts[0], texts[0], "a b c d e", "a b c d e", " f g h i j\n", " f g h i j\n", "f g h i", "f g h i", "k " * 9, "", "", None, " " * 90]
    want = passages_by_brute_force(texts, 25, 5)
    found = {r.doc_id: r for r in suffix_dedup.dedup(docs(texts), keep_text=True, passages="cut").collect()}
    assert [(found[i].kept or b"", found[i].n_removed, found[i].n_passages) for i in range(len(texts))] == want
    found = {r.doc_id: r for r in suffix_dedup.dedup(docs(texts), passages="count").collect()}
    plain = by_brute_force(texts, 25)
    got = [(found[i].n_bytes, found[i].n_removed, found[i].n_spans, found[i].kept_sha256) for i in range(len(texts))]
    assert got == plain and [found[i].n_passages for i in range(len(texts))] == [w[2] for w in want]


def test_passage_of_51_words_below_400_bytes(docs):
    words = [f"w{i}" for i in range(52)]
    passage = " ".join(words[:51])
    texts = ["first " + passage + " end", "other\n" + "\n".join(words[:51]), " ".join(["x", *words[1:51], "y"]), passage.upper()]
    assert len(passage) < 400
    found = {r.doc_id: r for r in suffix_dedup.dedup(docs(texts), keep_text=True, passages="cut").collect()}
    assert [found[i].kept_text for i in range(4)] == ["first  end", "other\n", *texts[2:]]
    assert [found[i].n_passages for i in range(4)] == [1, 1, 0, 0]
    found = {r.doc_id: r for r in suffix_dedup.dedup(docs(texts), passages="count").collect()}
    assert [(found[i].n_removed, found[i].n_passages) for i in range(4)] == [(0, 1), (0, 1), (0, 0), (0, 0)]
    assert suffix_dedup.dedup(docs([]), keep_text=True, passages="cut").count() == 0


def test_op8_counts_passages_beside_its_contract(spark, docs, folder):
    passage = " ".join(f"w{i}" for i in range(51))
    found = QUERIES["op8_suffix_dedup"](spark, folder(documents=docs(["a " + passage, passage + " b", "c " + passage[:-4] + " d"])))
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages"]
    assert sorted((r.doc_id, r.n_removed, r.n_passages) for r in found.collect()) == [(0, 0, 1), (1, 0, 1), (2, 0, 0)]
