import random
import zlib

import numpy as np
import pytest

from estatelens.llm import quality_knn, toxicity
from estatelens.llm.queries import QUERIES

rng = random.Random(2)


def prose(n):
    return " ".join("".join(rng.choice(["th", "er", "in", "on", "an", "re", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus():
    texts, toxic, quality = [], [], []
    for i in range(240):
        text = prose(rng.randint(5, 120))
        bad = i % 5 == 0
        if bad:
            words = text.split()
            words.insert(rng.randrange(len(words)), rng.choice(["blockhead", "nitwit"]) + rng.choice(["", "s", "!"]))
            text = " ".join(words)
        junk = i % 7 == 0
        if junk:
            text = " ".join(w + rng.choice(["***", "###", "$$$"]) for w in text.split())
        texts.append(text)
        toxic.append(int(bad))
        quality.append(int(not junk))
    return texts, toxic, quality


def tables(spark, docs, folder, texts, toxic, quality, extra=()):
    rows = [(i, q, t) for i, (q, t) in enumerate(zip(quality, toxic))] + list(extra)
    labels = spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
    return folder(documents=docs([*texts, "", None, "x", "é" * 3]), labels=labels)


@pytest.mark.parametrize("name, label, parts, held", [("op2_toxicity", 1, 3, 1), ("op3_quality_knn", 2, 4, 2)])
def test_held_out_accuracy_and_odd_rows(spark, docs, folder, name, label, parts, held):
    texts, toxic, quality = corpus()
    odd = [(None, 1, 1), (5000, 1, 1), (1, None, None), (2, 1 - quality[2], 1 - toxic[2])]
    sf = tables(spark, docs, folder, texts, toxic, quality, odd)
    rows = {r.doc_id: r for r in QUERIES[name](spark, sf).collect()}
    truth = toxic if label == 1 else quality
    tested = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % parts == held]
    assert all(rows[i].held_out == (i in tested) for i in range(len(texts)))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())
    assert np.mean([rows[i].predicted == truth[i] for i in tested]) >= 0.9
    assert len(rows) == len(texts) + 4


@pytest.mark.parametrize("name", ["op2_toxicity", "op3_quality_knn"])
def test_without_labels_and_without_documents(spark, docs, folder, name):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = QUERIES[name](spark, folder(documents=docs(["a b", None]), labels=labels)).collect()
    assert [r.predicted for r in rows] == [0, 0]
    one = spark.createDataFrame([(0, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert len(QUERIES[name](spark, folder(documents=docs(["some text", "b"]), labels=one)).collect()) == 2
    assert QUERIES[name](spark, folder(documents=docs([]), labels=one)).count() == 0


def test_ngrams_stay_inside_their_text():
    whole = toxicity.present(["abcdefgh", "ijklmnop"], None, 1 << toxicity.BUCKET_BITS)
    apart = [toxicity.present([t], None, 1 << toxicity.BUCKET_BITS)[1].tolist() for t in ("abcdefgh", "ijklmnop")]
    assert [whole[1][whole[0] == i].tolist() for i in (0, 1)] == apart


def test_votes_against_plain_neighbours():
    rng = random.Random(1)
    words = ["river", "stone", "maple", "bread", "cheap", "bonus", "|", "%%", "Prize!", "хлеб"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(120)]
    texts += texts[:30]  # ties
    labels = np.array([i % 3 > 0 for i in range(len(texts))])
    space = quality_knn.Space.fit(quality_knn.term_shares(texts), labels)
    asked = texts[:20] + ["", "river river", "unknown words only", "bonus " * 500]
    got = space.score(asked)
    known = [v.astype(np.float64) for v in space.vectors]
    for text, score in zip(asked, got):
        vector = quality_knn._to_unit(quality_knn.weighted(quality_knn.term_shares([text]), space.idf) @ space.axes)[0]
        cosines = [float(np.float32(vector @ v)) for v in space.vectors]
        nearest = sorted(range(len(known)), key=lambda i: (-round(cosines[i], 5), i))[:quality_knn.NEIGHBOURS]
        weights = [max(cosines[i], 0.0) for i in nearest]
        votes = sum(w for w, i in zip(weights, nearest) if labels[i])
        assert abs(score - (votes / sum(weights) if sum(weights) > 0 else 0)) < 0.08
    exact = [s for s, t in zip(got, asked) if t and t in texts]
    assert len(exact) >= 10


def test_repeated_ids_take_the_least_text(spark, docs):
    from estatelens.llm.labelled import training_sample

    rows = docs(["b", "x"]).unionByName(docs(["a", None])).unionByName(docs(["c"]))
    labels = spark.createDataFrame([(0, 1), (1, 1)], "doc_id bigint, toxic int")
    found = training_sample(rows, labels, "toxic", 7, 6, 10).collect()
    assert {(r.doc_id, r.text) for r in found} <= {(0, "a"), (1, "")}


def test_quality_by_wording_alone(spark, docs, folder):
    shapes = random.Random(4)
    good, poor = ["bread", "river", "stone", "maple"], ["cheap", "bonus", "prize", "super"]
    texts = [" ".join(shapes.choice(poor if i % 2 else good) for _ in range(40)) for i in range(200)]
    texts += [" ".join(shapes.choice(["хлебы", "ветра"] if i % 2 else ["домик", "лесок"]) for _ in range(40)) for i in range(200)]
    quality = [1 - i % 2 for i in range(400)]
    rows = {r.doc_id: r for r in QUERIES["op3_quality_knn"](spark, tables(spark, docs, folder, texts, quality, quality)).collect()}
    tested = [i for i in range(400) if rows[i].held_out]
    assert np.mean([rows[i].predicted == quality[i] for i in tested]) >= 0.95


def test_idf_over_all_documents(spark, docs):
    idf = quality_knn.document_idf(docs(["Word, here", "word", "x y", None]))
    shares = quality_knn.term_shares(["WORD"])[0, quality_knn.TERMS + quality_knn.LAGS:]
    column = quality_knn.TERMS + quality_knn.LAGS + np.flatnonzero(shares)
    assert np.allclose(idf[column], np.log(5 / 3) + 1)
