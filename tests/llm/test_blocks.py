from collections import Counter

import numpy as np
import pytest

from estatelens.llm import blocks
from estatelens.llm.common import ship, stored

ship(__name__)


def question(row):
    hashes, _ = blocks.word_hashes(blocks.unpack(row["words"].as_py()))
    keys, counts = np.unique(hashes, return_counts=True)
    return keys, [counts.astype(np.uint32)]


def answer(questions):
    asked = [blocks.unpacked(q, np.uint32) for q in questions]
    total = Counter()
    for keys, counts in asked:
        total.update(dict(zip(keys.tolist(), counts.tolist())))
    return [np.array([total[k] for k in keys.tolist()], np.uint32).tobytes() for keys, _ in asked]


@pytest.mark.parametrize("per_shard", [1, 3, 1000])
def test_every_block_gets_the_totals_of_its_keys(spark, docs, monkeypatch, per_shard):
    monkeypatch.setattr(blocks, "BLOCKS_PER_SHARD", per_shard)
    monkeypatch.setattr(blocks, "BLOCK_CHARS", 40)
    texts = [f"word{i % 7} word{i % 3} other{i} all" for i in range(60)]
    made = stored(blocks.to_blocks(docs(texts), "doc_id", "bigint", bytes(range(256))))
    assert made.count() > 20
    asked = blocks.ask(made, question, answer)
    shards = asked.select("block", blocks.F.explode("replies").alias("r")).select("r.shard").distinct().count()
    assert shards > 4 if per_shard == 1 else shards >= 1
    want = Counter(w for t in texts for w in t.split())
    of = {}
    for row in made.join(asked, "block").collect():
        hashes, _ = blocks.word_hashes(blocks.unpack(row.words))
        got = np.concatenate([np.frombuffer(r.reply, np.uint32) for r in row.replies])
        of.update(zip(np.unique(hashes).tolist(), got.tolist()))
    assert sorted(of.values()) == sorted(want.values())
