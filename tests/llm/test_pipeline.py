import random
from collections import defaultdict

import numpy as np
from test_bin_slack import reference_ids
from test_fm_index import plain_words
from test_icws import plain_classes

import corpus_pipeline


def make_corpus():
    rng = random.Random(9)
    text = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(3000)}" for _ in range(n))
    passage, item = text(90), text(14)
    docs = [text(rng.randint(60, 150)) for _ in range(12)]
    docs += [text(100) + " " + passage + " " + text(100), text(150) + " " + passage + " é" + text(120)]
    docs += [text(60) + " " + item + " " + text(40), docs[0], docs[1].upper(), docs[2] + " more", text(20), "", None, "x " * 90]
    return docs, item, passage


def test_stages_against_plain_versions(spark, docs, folder):
    texts, item, passage = make_corpus()
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    sf = folder(documents=docs(texts).withColumn("kept", corpus_pipeline.F.lit(1)), benchmark=items)
    got, frame = {}, spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        columns = frame.columns
        frame = spark.read.parquet(_written(stage(spark, frame, sf)))
        got[name] = frame.collect()
        assert name == "best-fit packing" or frame.columns == columns
    passing = [i for i, t in enumerate(texts) if len((t or "").split()) >= 50 and t != "x " * 90]
    assert sorted(r.doc_id for r in got["quality rules"]) == passing
    classes = plain_classes([texts[i] for i in passing])
    firsts = [passing[i] for i in sorted(set(classes))]
    assert sorted(r.doc_id for r in got["near-dedup"]) == firsts
    cut = {r.doc_id: r.text for r in got["suffix-array dedup"]}
    assert sorted(cut) == firsts and not any(passage[10:-10] in t for t in cut.values())
    assert all(cut[i] == texts[i] for i in firsts if passage not in texts[i])
    clean = {r.doc_id: r for r in got["decontamination"]}
    for i in firsts:
        hit = b" ".join(plain_words(item)) in b" ".join(plain_words(cut[i]))
        assert hit == (clean[i].text != cut[i]) and item not in clean[i].text
    ids = defaultdict(list)
    for r in sorted(got["best-fit packing"], key=lambda r: (r.doc_id, r.piece)):
        ids[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert {i: reference_ids(r.text) for i, r in clean.items()} == ids
    assert corpus_pipeline.run(spark, sf).count() == len(got["best-fit packing"])


def test_tables_of_earlier_stages_go_once_their_result_is_written(spark, docs, folder):
    texts, item, _ = make_corpus()
    sf = folder(documents=docs(texts), benchmark=spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    (_, first), (_, second), *_ = corpus_pipeline.STAGES
    lazy = first(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    begun = list(corpus_pipeline._TABLES)
    unwritten = second(spark, lazy, sf)  # reads tables of the first stage, which stay
    assert begun and set(begun) <= set(corpus_pipeline._TABLES)
    want = sorted(r.doc_id for r in unwritten.collect())
    assert sorted(r.doc_id for r in second(spark, spark.read.parquet(_written(lazy)), sf).collect()) == want
    assert not set(begun) & set(corpus_pipeline._TABLES)


def test_passages_of_over_50_words_go_whatever_their_bytes(spark, docs):
    words = [f"w{i}" for i in range(51)]
    passage, other = " ".join(words), " ".join(words[:50])
    texts = ["first " + passage, passage + "\nlast one", "\n" + "\n".join(words) + "\n", other + " x", "y " + other]
    assert len(passage) < 400
    left = {r.doc_id: r for r in corpus_pipeline.repeated_strings(spark, docs(texts), "").collect()}
    assert {i: r.text for i, r in left.items()} == {0: "first ", 1: "\nlast one", 3: texts[3], 4: texts[4]}
    assert all(r.n_chars == len(r.text) for r in left.values())


def _written(df):
    path = corpus_pipeline.shared_folder(df.sparkSession)
    df.write.parquet(path)
    return path
