import re
from collections import Counter

import duckdb
import pytest

from estatelens.llm import host_rules, license_join
from estatelens.llm.queries import ORACLES, QUERIES

ODD = [
    "", None, "   \n\t ", "one", "a b c a b c", "x " * 60, " ".join(f"w{i}" for i in range(60)), "a\x0bb\x0cc\rd",
    "line one\nline one\n\nline two\n \nline one", "# ** $$ <tag> | % & é 你好", " ".join(f"w{i % 7}" for i in range(200)),
    "a b c d " * 30 + " ".join(f"u{i}" for i in range(100)), "nb sp 　 wide", "\x01 \x1c x", "word " * 3000,
]


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            hit.update((i, i + 1, i + 2))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
            n < 50 or 100 * len(hit) > 50 * n)


def test_measures_against_plain_python(spark, docs, folder):
    rows = {r.doc_id: r for r in QUERIES["op4_host_rules"](spark, folder(documents=docs(ODD))).collect()}
    for i, text in enumerate(ODD):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_measures(text), text


def test_bad_hosts_take_their_documents(spark):
    good, junk = " ".join(f"w{i}" for i in range(60)), "x " * 60
    rows = [(i, good, "fine") for i in range(40)] + [(100 + i, junk, "bad") for i in range(40)]
    rows += [(200, good, "bad"), (201, good, None), (202, junk, None), (203, good, "small"), (204, junk, "small"), (40, good, "fine")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("kept", host_rules.F.lit(9))
    kept = sorted(r.doc_id for r in host_rules.judge(df).where("kept").collect())
    assert 200 not in kept and 201 in kept and 202 not in kept and kept.count(40) == 1
    assert set(range(41)) <= set(kept)
    assert host_rules.judge(df.limit(0)).count() == 0


LICENSED = [
    "", None, "MIT License", "the mit  license. Apache-License general public license", "mit\nlicense", "permit license",
    "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "intro\nThis work is licensed under the GNU General "
    "Public License, version 3.\nend", "Licensed under the Apache License, Version 2.0. mit license",
    "licensed under cc by", "THIS SOURCE CODE FORM is subject to the terms of the Mozilla Public License, v. 2.0.",
    "This source code form is\nsubject to the terms of the mozilla public license, v. 2.0", "é license mit licensé mit license",
]


LICENSED += [
    "\n".join(t.split()) for _, t in license_join.TEMPLATES] + [t.replace(" ", "\n * ", 9) for _, t in license_join.TEMPLATES] + [
    "Licensed under CC BY-SA 4.0", "all rights reserved " * 40 + "\nlicensed\nunder\ncc by 4.0 " + "x " * 90]


def plain_labels(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = []
    for phrase, label in license_join.PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    labels, best = {x for _, x in found}, 0.0
    sets = license_join.template_sets(license_join.TEMPLATES)
    half = license_join.half_block(license_join.TEMPLATES)
    for at in range(0, len(words), half):
        block = set(words[at:at + 2 * half])
        held = [(len(block & set(t)) / len(t), len(t), k) for k, (_, t) in enumerate(sets)]
        held = [x for x in held if x[0] >= 0.9 - 1e-9]
        for x in held:
            if not any(y > x and y[2] in dict(license_join.alike(sets))[x[2]] for y in held):
                labels.add(sets[x[2]][0])
                best = max(best, x[0])
    starts = sorted(i for i, _ in found)
    return (len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None,
            ",".join(sorted({x for _, x in found})), ",".join(sorted(labels)), 1.0 if starts else best)


def test_licenses_against_plain_python(spark, docs, folder):
    sf = folder(documents=docs(LICENSED))
    rows = {r.doc_id: r for r in QUERIES["op5_license_join"](spark, sf).collect()}
    for i, text in enumerate(LICENSED):
        r = rows[i]
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)
        assert got == plain_labels(text), text
    assert license_join.scan(docs([])).count() == 0
    for i, (label, _) in enumerate(license_join.TEMPLATES):  # wrapped statements
        assert label in rows[14 + i].labels.split(",") and rows[14 + i].score >= 0.9
    assert rows[len(LICENSED) - 2].labels == "cc-by-sa"


def test_other_columns_pass_whatever_their_names(spark):
    names = ["_w", "_row", "own", "row", "tokens", "block", "token", "held", "labels"]
    df = spark.createDataFrame([(1, "MIT License", *names)], ["doc_id", "text", *names])
    row = license_join.scan(df).first()
    assert all(row[n] == n for n in names[:-1]) and row.labels == "mit" and row.doc_id == 1


@pytest.mark.parametrize("name, texts", [("op4_host_rules", ODD), ("op5_license_join", LICENSED)])
def test_sql_twins_on_odd_texts(spark, docs, folder, name, texts):
    sf = folder(documents=docs(texts))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet/*.parquet')")
    columns = ", ".join(QUERIES[name](spark, sf).columns)
    want = con.sql(f"SELECT {columns} FROM ({ORACLES[name]}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in QUERIES[name](spark, sf).orderBy("doc_id").collect()] == want


def test_clashing_columns_pass_every_operator(spark):
    """Names that the operators use inside come back as they went in."""
    from estatelens.llm import host_rules, icws, suffix_dedup

    names = ["h", "first_h", "_h", "_first", "_host", "_bad_host", "_m", "_sha", "_copies", "_kept", "own", "bad", "m", "of_host", "key",
             "node", "root", "id", "first_id", "with.dot", "block"]
    text = "one two three four five six seven eight nine ten " * 60
    rows = [(i, text if i < 2 else f"text number {i} " * 40, "src", *names) for i in range(4)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    results = [host_rules.judge(df, keep_text=True), host_rules.judge(df), icws.near_duplicates(df), icws.without_near_duplicates(df),
               suffix_dedup.dedup(df), suffix_dedup.dedup(df, keep_text=True), license_join.scan(df)]
    for result in results:
        got = [r.asDict() for r in result.collect()]
        assert len(got) == (3 if result is results[3] else 4)
        assert all(r[n] == n for r in got for n in names), result.columns
