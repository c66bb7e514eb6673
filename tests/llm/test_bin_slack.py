import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from estatelens.llm import bin_slack

ODD = ["", None, "a", "two  spaces", " lead", "trail \n", "tab\tx\x00y", "one\ntwo three\n\nfour", "é ü 你好 　 z",
       "it's 12 o'clock!", "\n", "x\x1cy z", "word " * 900 + "end", "same same", "same same"]


def reference_ids(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def test_pieces_equal_the_tokenizer_and_tile_their_sequences(docs):
    rows = bin_slack.pack(docs(ODD), capacity=64).collect()
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        of_doc[r.doc_id].append(r)
        of_sequence[r.sequence_id].append(r)
    for i, text in enumerate(ODD):
        pieces = sorted(of_doc[i], key=lambda r: r.piece)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces]).tolist()
        assert ids == reference_ids(text), text
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert all(r.length == 64 for r in pieces[1:]) and all(zlib.crc32(r.ids) == r.ids_crc32 for r in pieces)
    for held in of_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64


def test_fullest_combination_against_all_subsets():
    rng = np.random.default_rng(0)
    for _ in range(200):
        items = rng.integers(1, 20, 8).tolist()
        gap = int(rng.integers(1, 60))
        best = max(s for s in (sum(x for j, x in enumerate(items) if m >> j & 1) for m in range(256)) if s <= gap)
        counts = {x: items.count(x) for x in items}
        used = bin_slack.fullest(gap, counts, sorted(counts, reverse=True))
        assert sum(k * m for k, m in used.items()) == best
        assert all(counts[k] >= m for k, m in used.items())


def test_plan_places_every_piece_once():
    histogram = {64: 3, 40: 7, 24: 5, 10: 11, 3: 100}
    places = bin_slack.plan(histogram, 64)
    for length, n in histogram.items():
        ranks = sorted((a, b) for k, a, b, *_ in places if k == length)
        assert ranks[0][0] == 0 and ranks[-1][1] == n and all(x[1] == y[0] for x, y in zip(ranks, ranks[1:]))
    total = max(s + (b - a) // m for _, a, b, s, m, _ in places)
    assert total == 16  # 1002 tokens need as many


def test_empty_table(docs):
    assert bin_slack.pack(docs([])).count() == 0


def test_ids_pass_python_once(spark):
    """Behind the tokeniser only names of pieces go to Python workers; ids there are held twice, in Arrow buffers of 10,000 rows."""
    docs = spark.createDataFrame([(1, "one two three"), (2, None), (3, "word " * 5000), (3, "word " * 5000)], "doc_id bigint, text string")
    out = bin_slack.pack(docs)
    steps = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "MapInArrow" in line]
    assert len(steps) == 1 and "ids" not in steps[0]
    rows = out.collect()
    assert all(len(r.ids) == 4 * r.length for r in rows)
    assert sum(r.length for r in rows if r.doc_id == 3) == 2 * (max(r.start + r.length for r in rows if r.doc_id == 3))
