import re

import numpy as np
import pytest

from estatelens.llm import fm_index
from estatelens.llm.queries import QUERIES

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall((text or "").encode().lower())


def by_brute_force(texts, items):
    windows = {}
    for item, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i:i + 10]), set()).add(str(item))
    out = []
    for text in texts:
        w, hit, found = plain_words(text), set(), set()
        for window, names in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i:i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found |= names
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("sigma", [1, 2, 5])
def test_index_against_brute_force(sigma):
    rng = np.random.default_rng(sigma)
    for n in (0, 1, 2, 5, 60, 300):
        x = rng.integers(0, sigma, n)
        assert fm_index.suffix_order(x).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())
        index = fm_index.FMIndex(x, sigma + 1)
        windows, lengths = rng.integers(0, sigma, (30, 4)), rng.integers(1, 5, 30)
        for low, high, w, k in zip(*index.find(windows, lengths), windows, lengths):
            want = [i for i in range(n - k + 1) if x[i:i + k].tolist() == w[4 - k:].tolist()]
            assert sorted(index.locate(np.arange(low, max(low, high))).tolist()) == want


ITEM = "Alpha beta gamma, delta epsilon zeta eta theta iota kappa lambda mu"
TEXTS = [
    "x " + ITEM + " y", "ALPHA-BETA gamma delta epsilon zeta eta theta iota kappa", ITEM.replace("eta", "x", 1),
    "short phrase here", "a short phrase", None, "", " \n", "beta " * 50, ITEM + " " + ITEM, "é short phrase é short phrase",
    "filler " * 500 + ITEM + " filler" * 500, ITEM, ITEM,
]
ITEMS = [(1, ITEM), (2, "short phrase"), (3, None), (4, ""), (10, "é"), (10, "short phrase"), (5, "beta " * 12)]


@pytest.mark.parametrize("shard, words", [(1 << 20, 1 << 20), (16, 1 << 20), (64, 20)])
def test_query_against_brute_force(spark, docs, folder, monkeypatch, shard, words):
    monkeypatch.setattr(fm_index, "SHARD", shard)
    monkeypatch.setattr(fm_index, "MAX_QUERY_WORDS", words)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    rows = sorted(fm_index.contaminated(docs(TEXTS), items).collect(), key=lambda r: r.doc_id)
    got = [(r.n_words, sum(s.end - s.first for s in r.spans), r["items"]) for r in rows]
    assert got == by_brute_force(TEXTS, ITEMS)
    if shard > 64:
        sf = folder(documents=docs(TEXTS), benchmark=items)
        found = {r.doc_id: r for r in QUERIES["op7_fm_index"](spark, sf).collect()}
        assert [(found[i].n_words, found[i].n_hit, found[i].n_items) for i in range(len(TEXTS))] == [
            (a, b, len(c)) for a, b, c in got]


def test_removal_and_empty_tables(spark, docs):
    items = spark.createDataFrame(ITEMS[:2], "item_id bigint, text string")
    got = {r.doc_id: r.text for r in fm_index.decontaminate(docs(TEXTS), items).collect()}
    assert got[0] == "x  y" and got[3] == " here" and got[5] is None and got[7] == " \n" and got[8] == TEXTS[8]
    assert fm_index.contaminated(docs([]), items).count() == 0
    assert [r.spans for r in fm_index.contaminated(docs(["a b"]), items.limit(0)).collect()] == [[]]


def plain_removal(text, items):
    """The text without its hit words and what stands between words of one span."""
    w = [m.span() for m in WORD.finditer((text or "").encode().lower())]
    words, hit = plain_words(text), set()
    for _, item in items:
        q = plain_words(item)
        for i in range(max(1, len(q) - 9) if q else 0):
            n = len(q[i:i + 10])
            hit |= {(a, a + n) for a in range(len(words) - n + 1) if words[a:a + n] == q[i:i + 10]}
    raw, at, kept, covered = (text or "").encode(), 0, [], {j for a, b in hit for j in range(a, b)}
    for j in sorted(covered):
        if j - 1 not in covered:
            kept.append(raw[at:w[j][0]])
        at = w[j][1]
    return b"".join([*kept, raw[at:]]).decode()


@pytest.mark.parametrize("words", [1 << 20, 20])
def test_removal_is_part_of_the_search(spark, docs, monkeypatch, words):
    """One Python worker per pass of the benchmark, also if the text is asked for twice (three were held per task)."""
    monkeypatch.setattr(fm_index, "MAX_QUERY_WORDS", words)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    texts = [*TEXTS, "x " + ITEM + ", short phrase: y"]  # spans of two passes that touch
    out = fm_index.decontaminate(docs(texts), items)
    passes = len(list(fm_index._query_blocks(items)))
    asked = out.where("not (size(spans) > 0 and trim(text) = '')").select("doc_id", "text")
    nodes = re.findall(r"MapInArrow|ArrowEvalPython|BatchEvalPython", asked._jdf.queryExecution().executedPlan().toString())
    assert nodes == ["MapInArrow"] * passes and (passes > 1) == (words == 20)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {i: None if t is None else plain_removal(t, ITEMS) for i, t in enumerate(texts)}
    assert out.columns == [*docs([]).columns, "n_words", "spans", "items"]
