import random
from collections import Counter

import numpy as np
import pytest

from estatelens.llm import icws


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def corpus(seed):
    """Near copies, chains, copies, short and empty texts, unrelated ones."""
    rng = random.Random(seed)
    texts = [" ".join(words(rng, 80)) for _ in range(10)]
    for base in range(3):
        for _ in range(12):
            copy = texts[base].split()
            copy[rng.randrange(len(copy))] = "edited"
            texts.append(" ".join(copy))
    half = texts[5].split()
    texts += [" ".join(half[:60] + words(rng, 20)), " ".join(half[:74] + words(rng, 3))]
    texts += [texts[3], texts[3], texts[3].upper(), "", None, "", "a b", "a b", "a c", "one", " , "]
    return texts


def plain_classes(texts):
    """All pairs, weighted Jaccard similarity, connected components."""
    def bag(t):
        w = "".join(c if not c.isascii() or c.isalnum() else " " for c in (t or "").lower()).split()
        return Counter([tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))] if w else [])

    bags = [bag(t) for t in texts]
    df = Counter(s for b in bags for s in b)
    idf = {s: 1.5 - round(255 * np.log(n) / np.log(len(texts))) / 510 for s, n in df.items()}
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            low = sum(idf[s] * min(n, bags[j][s]) for s, n in bags[i].items())
            high = sum(idf[s] * max(bags[i][s], bags[j][s]) for s in bags[i].keys() | bags[j].keys())
            if (texts[i] or "") == (texts[j] or "") or high and low / high >= 0.8:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("seed", [1])
def test_classes_against_all_pairs(docs, seed):
    texts = corpus(seed)
    rows = sorted(icws.near_duplicates(docs(texts)).collect(), key=lambda r: r.doc_id)
    want = plain_classes(texts)
    assert [r.class_id for r in rows] == want
    assert [r.class_size for r in rows] == [want.count(c) for c in want]
    kept = icws.without_near_duplicates(docs(texts)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want))


def test_samples_agree_with_the_similarity():
    rng = np.random.default_rng(3)
    shared, own = rng.integers(0, 1 << 62, 900).astype(np.uint64), rng.integers(0, 1 << 62, 200).astype(np.uint64)
    a, b = np.sort(np.append(shared, own[:100])), np.sort(np.append(shared, own[100:]))
    docs = np.repeat([0, 1], [len(a), len(b)])
    rate = []
    for shift in range(40):
        _, keys = icws.band_keys(docs, np.concatenate([a, b]) + np.uint64(shift * 7919), np.full(len(docs), 1.3))
        rate.append((keys[0] == keys[1]).mean())
    assert abs(np.mean(rate) - (900 / 1100) ** icws.ROWS) < 0.08


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 103), (103, 101), (200, 200)]
    got = dict(icws.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect())
    assert got == {**{i: 0 for i in range(21)}, 100: 100, 101: 100, 103: 100}


def test_empty_table(docs):
    assert icws.near_duplicates(docs([])).count() == 0


def test_common_weights_against_pairs():
    rng = np.random.default_rng(7)
    vectors = []
    for _ in range(9):
        h = np.unique(rng.integers(0, 40, 25)).astype(np.uint64)
        code = (h % np.uint64(256)).astype(np.uint8)
        vectors.append((h.tobytes(), rng.integers(1, 5, len(h)).astype(np.uint32).tobytes(), code.tobytes()))
    total = [float((icws.idf(np.frombuffer(c, np.uint8)) * np.frombuffer(t, np.uint32)).sum()) for _, t, c in vectors]
    both = icws.common_weights(vectors, 4)
    for i in range(4):
        for j in range(5):
            want = icws.similarity(vectors[i], vectors[4 + j])
            assert both[i, j] / (total[i] + total[4 + j] - both[i, j]) == pytest.approx(want)
