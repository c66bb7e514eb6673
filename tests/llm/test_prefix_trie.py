import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from estatelens.llm import list_rank, prefix_trie, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    """The nodes by the words of the contract, with dictionaries."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(rs)] for c, rs in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = own.get(base, [])[:h] + own[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, held in members.items():
        worth = (len(held) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += worth
            leaves[node[:d]] += children[node] == 0
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n],
         hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()) for n, m in members.items())


def check(df, rows, **more):
    got = sorted(tuple(r) for r in prefix_trie.trie(df, **more).collect())
    want = plain(rows)
    assert len(got) == len(want)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_small_conversations_against_a_plain_version(spark):
    rng = random.Random(1)
    rows = []
    for c in [*range(70), 500, 501, 519, -7, -21]:
        for t in range(rng.choice([1, 1, 2, 3, 5])):
            rows.append((c, None if t == 0 and c % 3 else 9 - t, rng.choice(["user", None]), rng.choice(["a b", "", None, "c", f"own {c}"])))
    rows += [rows[3], rows[3], rows[-1], (None, 0, "user", "no conversation")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: prefix_trie.F.lit("clash") for c in ("s", "t", "depth", "place", "words", "_range", "head")})
    check(df, [r for r in rows], small=20)


def test_deep_copied_and_popular_conversations(spark):
    rows = [(c, t, "user", "same text here") for c in range(300) for t in range(3)]  # a popular conversation
    rows += [(c, t, "user", f"turn {min(t, 1) * c} {t}") for c in range(1000, 1060) for t in range(2)]  # many children
    rows += [(2000 + 20 * k, t, "user", f"deep {t if t < 150 else t * k}") for k in range(3) for t in range(300)]
    check(spark.createDataFrame(rows, SCHEMA), rows, range_rows=40, small=100)


def test_tied_and_long_texts(spark):
    rows = [(5, 1, "user", "x " * 200_000), (5, 1, "user", "x " * 200_000), (25, 1, "user", "x " * 200_000), (40, None, None, None)]
    check(spark.createDataFrame(rows, SCHEMA), rows)


def test_empty_table(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n, small", [(1, 4), (5, 4), (700, 10)])
def test_list_ranks_against_a_walk(spark, n, small):
    order = list(range(n))
    random.Random(n).shuffle(order)
    rows = [(a, a % 3, b, None if b is None else b % 3, a + 1, 1) for a, b in zip(order, [*order[1:], None])]
    arcs = spark.createDataFrame(rows, "a bigint, b bigint, next_a bigint, next_b bigint, w bigint, one bigint")
    got = {r.a: (r.w, r.one) for r in list_rank.sums_to_end(arcs, ["w", "one"], small).collect()}
    total = 0
    for i, a in enumerate(reversed(order)):
        total += a + 1
        assert got[a] == (total, i + 1)


def test_query_against_a_plain_version(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in queries.op13_prefix_trie(spark, sf).collect()), key=str)
    assert got == sorted(plain(rows), key=str)


def test_query_against_its_twin(spark):
    from queryset import check as twins

    sf = "/root/testdata/sf0.01"
    got = queries.op13_prefix_trie(spark, sf).toArrow()
    want = twins.sql_engine(sf).sql(queries.ORACLES["op13_prefix_trie"]).to_arrow_table()
    assert {f.name: str(f.type) for f in got.schema} == {f.name: str(f.type) for f in want.schema} | {"ends_sha256": str(got.schema.field("ends_sha256").type)}
    assert twins.rows_of(got) == twins.rows_of(want)
