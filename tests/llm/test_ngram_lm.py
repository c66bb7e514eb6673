import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from estatelens.llm import ngram_lm
from estatelens.llm.queries import QUERIES


@pytest.mark.parametrize("n, universe", [(0, 10), (1, 1), (5, 5), (300, 40), (1000, 1 << 20), (3000, 1 << 62)])
def test_elias_fano_against_a_sorted_array(n, universe):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe, n)).astype(np.uint64)
    arrays, count, low = ngram_lm.EliasFano.build(values)
    ef = ngram_lm.EliasFano(arrays, count, low)
    assert ef.get(np.arange(n)).tolist() == values.tolist()
    x = np.concatenate([values, rng.integers(0, universe + 5, 200).astype(np.uint64)])
    at = np.searchsorted(values, x)
    want = np.where((at < n) & (values[np.minimum(at, n - 1)] == x if n else False), at, -1)
    assert ef.find(x).tolist() == want.tolist()


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    out, word = [], ""
    for c in lower + " ":
        if c in " \t\n\x0b\x0c\r":
            out += [word] if word else []
            word = ""
        else:
            word += c
    return [*out, "</s>"]


def plain_scores(texts):
    train = [tokens(t) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    uni, bi, tri, context, follow = Counter(), Counter(), Counter(), Counter(), Counter()
    for t in train:
        padded = ["<1>", "<2>", *t]
        uni.update(t)
        bi.update(zip(padded[1:], t))
        tri.update(zip(padded, padded[1:], t))
    for (u, v, _), n in tri.items():
        context[u, v] += n
        follow[u, v] += 1
    n, v_all, d, m = sum(uni.values()), len(uni), ngram_lm.DISCOUNT, ngram_lm.BACK_OFF
    out = []
    for text in texts:
        padded, base, score = ["<1>", "<2>", *tokens(text)], 0.0, 0.0
        for a, b, w in zip(padded, padded[1:], padded[2:]):
            p1 = (uni[w] + 1) / (n + v_all + 1)
            c = len(train) if b == "<2>" else uni[b]
            p = (bi[b, w] + m * p1) / (c + m)
            if context[a, b]:
                p = max(tri[a, b, w] - d, 0) / context[a, b] + d * follow[a, b] / context[a, b] * p
            base += math.log10(p1)
            score += math.log10(p)
        known = sum(uni[w] > 0 for w in padded[2:])
        out.append((len(padded) - 2, known, n, base, score))
    return out


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)] + ["É", "x\x01y", "\x01", "don't", " "]
    texts = [rng.choice(["  ", ""]) + rng.choice([" ", "\n", "\t"]).join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    return [*texts, texts[0], texts[0].upper(), "", None, " \r\n", "only here", "the " * 500]


@pytest.mark.parametrize("chars", [1 << 20, 300])
def test_scores_against_a_plain_model(spark, docs, folder, monkeypatch, chars):
    monkeypatch.setattr(ngram_lm, "BLOCK_CHARS", chars)
    texts = corpus()
    rows = {r.doc_id: r for r in QUERIES["op1_ngram_trie"](spark, folder(documents=docs(texts))).collect()}
    assert len(rows) == len(texts)
    for i, (n_tokens, n_known, train, base, score) in enumerate(plain_scores(texts)):
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, train)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(base, abs=1e-9)
        assert r.score == pytest.approx(score, abs=3e-4 * n_tokens)


def test_empty_table(docs):
    assert ngram_lm.score(docs([])).count() == 0
