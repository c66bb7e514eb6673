"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Documents become blocks. Blocks ask for the document frequency of their five-word shingles, counted over all
   documents. The weight of a shingle is tf * idf with idf = 1 + (1 - ln df / ln N) / 2: damped, since with a plain
   logarithm one edited word, unique in the corpus, would outweigh all a large group of near copies has in common.
2. BANDS * ROWS consistent samples per text (Ioffe's scheme: equal samples with the probability of the weighted
   Jaccard similarity); texts with equal samples in a band meet in a bucket.
3. Every text is compared with a leader of its buckets, by the weighted Jaccard similarity of the whole texts. Where
   that leaves texts of a bucket unconnected, they are compared with each other (see `links`): connected texts need no
   further pairs, and none is dropped. A leader of many texts meets them in parts of PART.
4. The links' connected components are the classes, by alternating star contraction on written tables.

Texts are known by their hash (MD5): copies are one text throughout and share a class.

Defined results: a null text is an empty one; texts of fewer than five words are one shingle; texts without words are
similar to their own copies only; a class is named by its smallest doc_id; repeated rows are copies; an empty table
gives no rows; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import DOC_END, ask, mixed, pack, to_blocks, unpack, unpacked, word_hashes
from .common import let_go, own_columns, partitions_for, ship, stored
from .fm_index import _TO_WORDS as WORD_BYTES

ship(__name__)

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 3
TILE = 256  # texts of a part of an unfinished bucket; two parts meet in a task
FEATURES = 8192  # columns of a matrix product
SHINGLE_BITS = np.uint64(((1 << 56) - 1) << 8)  # a shingle is 56 bits of its hash
PART = 256  # texts that meet a copy of their leader
PIECE = 1 << 15  # shingles sampled at once
_GRID = 1 << 16


class Shingles:
    """Distinct (shingle, document) of a block with tf, ordered by shingle; `key` numbers the distinct shingles."""

    def __init__(self, data: bytes):
        words, sizes = word_hashes(data)
        n, self.n_docs = len(words), len(sizes)
        narrow = np.uint16 if self.n_docs < 1 << 16 else np.int64  # short numbers are sorted by radix
        doc = np.repeat(np.arange(self.n_docs).astype(narrow), sizes)
        hashes, docs = [], []
        if n >= SHINGLE:
            state = words[:n - SHINGLE + 1].copy()
            for i in range(1, SHINGLE):
                state = state * np.uint64(0x100000001B3) + words[i:n - SHINGLE + 1 + i]
            whole = doc[:n - SHINGLE + 1] == doc[SHINGLE - 1:]
            hashes.append(mixed(state[whole]) & SHINGLE_BITS)
            docs.append(doc[:n - SHINGLE + 1][whole])
        begins = np.cumsum(sizes) - sizes
        short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
        if len(short):
            sums = [np.bitwise_xor.reduce(mixed(words[begins[d]:begins[d] + sizes[d]] + np.arange(1, sizes[d] + 1).astype(np.uint64)))
                    for d in short.tolist()]
            hashes.append(np.array(sums, np.uint64) & SHINGLE_BITS)
            docs.append(short.astype(narrow))
        hashes, docs = (np.concatenate(hashes), np.concatenate(docs)) if hashes else (np.zeros(0, np.uint64), doc)
        order = np.argsort(docs, kind="stable")
        hashes, docs = hashes[order], docs[order]
        order = np.argsort(hashes, kind="stable")  # documents ascend within a shingle
        hashes, docs = hashes[order], docs[order]
        other = np.append(True, hashes[1:] != hashes[:-1])[:len(hashes)]
        new = np.flatnonzero(other | np.append(True, docs[1:] != docs[:-1])[:len(hashes)])
        self.hashes, self.docs = hashes[new], docs[new]
        self.tf = np.diff(np.append(new, len(hashes)))
        self.key = np.cumsum(other[new]) - 1

    def by_document(self, *arrays: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(self.docs, kind="stable")
        return [a[order] for a in (self.docs.astype(np.int64), self.hashes, self.tf, *arrays)]


def _frequency_question(row):
    found = Shingles(unpack(row["words"].as_py()))
    first = np.flatnonzero(np.append(True, np.diff(found.key) > 0)[:len(found.key)])
    return found.hashes[first], [np.diff(np.append(first, len(found.key))).astype(np.uint32)]


def _frequency_answer(n_docs: int):
    def answer(questions: list[bytes]) -> list[bytes]:
        asked = [unpacked(q, np.uint32) for q in questions]
        keys = np.concatenate([k for k, _ in asked])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.append(True, keys[1:] != keys[:-1])
        total = np.add.reduceat(np.concatenate([c for _, c in asked])[order].astype(np.int64), np.flatnonzero(new))
        code = np.rint(255 * np.log(total) / max(np.log(2), np.log(n_docs))).astype(np.uint8)
        back = np.empty(len(keys), np.uint8)
        back[order] = code[np.cumsum(new) - 1]
        return [part.tobytes() for part in np.split(back, np.cumsum([len(k) for k, _ in asked])[:-1])]

    return answer


def idf(code: np.ndarray) -> np.ndarray:
    return 1.5 - code.astype(np.float64) / 510


def _draws() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of the gamma(2, 1) law on a grid, and their logarithms."""
    x = np.linspace(1e-6, 30, 400_000)
    share = 1 - np.exp(-x) * (1 + x)
    grid = np.interp((np.arange(_GRID) + 0.5) / _GRID, share, x).astype(np.float32)
    return grid, np.log(grid)


def band_keys(docs: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct documents and their BANDS bucket keys."""
    gamma, log_gamma = _draws()
    first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1])[:len(docs)])
    names, keys = docs[first], np.zeros((len(first), BANDS), np.uint64)
    ends = np.append(first[1:], len(docs))
    at = 0
    while at < len(first):  # whole documents, about PIECE shingles at a time
        stop = max(at + 1, int(np.searchsorted(ends, first[at] + PIECE, "right")))
        a, b = first[at], ends[stop - 1]
        h, log_w = hashes[a:b], np.log(weights[a:b]).astype(np.float32)
        starts = first[at:stop] - a
        index = np.arange(b - a)
        for sample in range(BANDS * ROWS):
            u = (h ^ np.uint64((sample + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)
            u ^= u >> np.uint64(32)
            r = gamma[(u & np.uint64(0xFFFF)).astype(np.int32)]
            log_c = log_gamma[(u >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int32)]
            beta = (u >> np.uint64(48)).astype(np.float32) * np.float32(1 / _GRID)
            t = np.floor(log_w / r + beta)
            value = (log_c - r * (t - beta + 1)).view(np.int32)
            value = value ^ (value >> 31 & 0x7FFFFFFF)  # integers in the order of the floats
            best = np.minimum.reduceat(value.astype(np.int64) << 32 | index, starts) & 0xFFFFFFFF
            drawn = mixed(h[best] + t[best].astype(np.int64).view(np.uint64) * np.uint64(0x632BE59BD9B4E019))
            band = sample // ROWS
            keys[at:stop, band] = mixed(keys[at:stop, band] + drawn + np.uint64(sample + 1))
        at = stop
    return names, keys


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per distinct text of a block: its bucket keys, total weight and the codes of its shingles."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            found, names = Shingles(unpack(row["words"].as_py())), row["carry"].as_py()
            codes = np.frombuffer(b"".join(r["reply"] for r in row["replies"].as_py() or ()), np.uint8)
            docs, hashes, tf, code = found.by_document(codes[found.key])
            once = np.zeros(len(names), bool)  # copies in the block are sampled once
            once[list({name: d for d, name in enumerate(names)}.values())] = True
            once = once[docs]
            docs, hashes, tf, code = docs[once], hashes[once], tf[once], code[once]
            weights = tf * idf(code)
            who, keys = band_keys(docs, hashes, weights)
            cut = np.append(np.searchsorted(docs, who), len(docs))
            total = np.add.reduceat(weights, cut[:-1]) if len(who) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["block"].as_py()] * len(who), pa.int64()), pa.array([names[d] for d in who.tolist()], pa.binary()),
                 pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())), pa.array(total, pa.float64()),
                 pa.array([pack(code[a:b].tobytes()) for a, b in zip(cut, cut[1:])], pa.binary())],
                names=["block", "h", "keys", "weight", "codes"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles, tf and codes of the wanted texts of a block; only their words are read."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            wanted = {w["h"]: w["codes"] for w in row["wanted"].as_py()}
            texts = dict(zip(row["carry"].as_py(), unpack(row["words"].as_py()).split(DOC_END)))
            names = list(wanted)
            docs, hashes, tf = Shingles(b" ".join(texts[n] + b" " + DOC_END for n in names)).by_document()
            cut = np.searchsorted(docs, np.arange(len(names) + 1))
            spans = list(zip(cut, cut[1:]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array([hashes[a:b].tobytes() for a, b in spans], pa.binary()),
                 pa.array([tf[a:b].astype(np.uint32).tobytes() for a, b in spans], pa.binary()),
                 pa.array([unpack(wanted[n]) for n in names], pa.binary())], names=["h", "shingle", "times", "codes"])


def similarity(a: tuple[bytes, bytes, bytes], b: tuple[bytes, bytes, bytes]) -> float:
    """Weighted Jaccard similarity of two texts (shingles ascending, tf, codes)."""
    (ha, ta, ca), (hb, tb, cb) = ((np.frombuffer(h, np.uint64), np.frombuffer(t, np.uint32), np.frombuffer(c, np.uint8))
                                  for h, t, c in (a, b))
    at = np.minimum(np.searchsorted(hb, ha), max(0, len(hb) - 1))
    same = hb[at] == ha if len(hb) else np.zeros(len(ha), bool)
    both = float((idf(ca[same]) * np.minimum(ta[same], tb[at[same]])).sum())
    either = float((idf(ca) * ta).sum() + (idf(cb) * tb).sum()) - both
    return both / either if either else 0.0


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("shingle", "times", "codes", "shingle2", "times2", "codes2")
    for batch in batches:
        values = [similarity(x[:3], x[3:]) for x in zip(*(batch.column(c).to_pylist() for c in names))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("h"), batch.column("leader"), pa.array(values, pa.float64())], names=["h", "leader", "similarity"])


def compare(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """h, leader, similarity of every edge; leaders' vectors are copied once per PART edges, so none is hot."""
    parts = edges.groupBy("leader").agg(F.ceil(F.count("*") / PART).cast("int").alias("_parts"))
    leaders = parts.join(vectors.withColumnsRenamed({"h": "leader", "shingle": "shingle2", "times": "times2", "codes": "codes2"}), "leader")
    copies = leaders.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    members = edges.join(vectors, "h").join(parts, "leader").withColumn(
        "_part", F.pmod(F.xxhash64("h"), F.col("_parts")).cast("int")).drop("_parts")
    return members.join(copies, ["leader", "_part"]).mapInArrow(_compared, "h binary, leader binary, similarity double")


def common_weights(vectors: list[tuple[bytes, bytes, bytes]], n_first: int) -> np.ndarray:
    """Weight that each of the first n_first texts shares with each of the others, as matrix products.

    A shingle that a text holds t times counts as t features, so the lesser of two tf is what both have. Features of
    one text alone are left out; the rest goes through FEATURES at a time.
    """
    hashes, tf, code = (np.concatenate([np.frombuffer(v[k], t) for v in vectors]) for k, t in (
        (0, np.uint64), (1, np.uint32), (2, np.uint8)))
    text = np.repeat(np.arange(len(vectors)), [len(v[2]) for v in vectors])
    order = np.argsort(hashes, kind="stable")
    number = np.empty(len(hashes), np.int64)
    number[order] = np.cumsum(np.append(False, np.diff(hashes[order]) != 0)[:len(hashes)])
    step = np.arange(int(tf.sum())) - np.repeat(np.cumsum(tf, dtype=np.int64) - tf, tf)
    text, number, weight = np.repeat(text, tf), np.repeat(number, tf), np.repeat(idf(code), tf)
    order = np.lexsort((step, number))
    text, number, step, weight = text[order], number[order], step[order], weight[order]
    new = np.append(True, (number[1:] != number[:-1]) | (step[1:] != step[:-1]))[:len(text)]
    shared = np.flatnonzero(~(new & np.append(new[1:], True)[:len(text)]))
    out = np.zeros((n_first, len(vectors) - n_first))
    feature = np.cumsum(new[shared]) - 1
    for begin in range(0, int(feature[-1]) + 1 if len(feature) else 0, FEATURES):
        a, b = np.searchsorted(feature, [begin, begin + FEATURES])
        has = np.zeros((len(vectors), min(FEATURES, int(feature[b - 1]) - begin + 1)))
        has[text[shared[a:b]], feature[a:b] - begin] = np.sqrt(weight[shared[a:b]])
        out += has[:n_first] @ has[n_first:].T
    return out


def _tile_pairs(threshold: float):
    def solved(rows: list[tuple]) -> pa.RecordBatch:
        i, j = rows[0][2:4]
        first = [r for r in rows if r[4] == i]
        second = first if i == j else [r for r in rows if r[4] == j]
        if not first or not second:
            return pa.RecordBatch.from_arrays([pa.array([], pa.binary())] * 2, names=["h", "leader"])
        both = common_weights([r[8:] for r in (*first, *second)], len(first))
        (root, weight), (root2, weight2) = ((np.array([r[5] for r in x], object), np.array([r[6] for r in x])) for x in (first, second))
        near = (root[:, None] != root2[None]) & (both >= threshold * (weight[:, None] + weight2[None] - both) - 1e-9)
        if i == j:
            near = np.triu(near, 1)
        a, b = np.nonzero(near)
        return pa.RecordBatch.from_arrays(
            [pa.array([first[k][7] for k in a], pa.binary()), pa.array([second[k][7] for k in b], pa.binary())], names=["h", "leader"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of one tile; they come sorted
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:4] != row[:4]:
                    yield solved(held)
                    held = []
                held.append(row)
        if held:
            yield solved(held)

    return run


def links(buckets: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(h, leader) pairs that are similar, enough of them that no two similar texts of a bucket stay unconnected.

    First every text meets one leader: of its buckets' most popular texts (those that share buckets with most others,
    the original among its edited copies) the most popular one. Buckets whose texts are then connected are done. In the
    others all texts not connected yet meet, in tiles: a bucket is cut into parts of about TILE texts, and each two
    parts meet in a task, so that a text travels once per part and not once per pair.
    """
    sizes = buckets.groupBy("band", "key").agg(F.count("*").alias("n"))
    popular = buckets.join(sizes, ["band", "key"]).groupBy("h").agg(F.sum(F.col("n") - 1).alias("popular"))
    members = stored(buckets.select("band", "key", "h", "weight").join(popular, "h"))
    let_go(buckets.sparkSession)
    leaders = members.groupBy("band", "key").agg(F.max(F.struct("popular", "h", "weight")).alias("l"))
    alike = F.least("weight", "l.weight") >= F.greatest("weight", "l.weight") * (threshold - 1e-9)
    edges = members.join(leaders, ["band", "key"]).where((F.col("h") != F.col("l.h")) & alike).groupBy("h").agg(
        F.max("l").alias("l")).select("h", F.col("l.h").alias("leader"))
    near = compare(stored(edges), vectors).where(F.col("similarity") >= threshold).select("h", "leader")
    found = stored(near)
    let_go(buckets.sparkSession)

    roots = components(found, "h", "leader")
    rooted = members.join(roots, F.col("h") == F.col("node"), "left").select(
        "band", "key", "h", "weight", F.coalesce("root", "h").alias("root"))
    unfinished = rooted.groupBy("band", "key").agg(
        F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b")).where("a != b")
    parts = unfinished.select("band", "key", F.ceil(F.col("n") / TILE).cast("int").alias("parts"))
    left = rooted.join(parts, ["band", "key"]).withColumn("part", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int"))
    tiles = left.join(vectors, "h").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "band", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "root", "weight",
        "h", "shingle", "times", "codes")
    tile = ["band", "key", "i", "j"]
    more = tiles.repartition(partitions_for(buckets.sparkSession), *tile).sortWithinPartitions(*tile).mapInArrow(
        _tile_pairs(threshold), "h binary, leader binary")
    return found.union(more.distinct())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node of the edges; root is the component's least node (alternating star contraction)."""
    step = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    seen = None
    while True:
        both = step.union(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        step = stored(
            small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
            .where("u != v").distinct())
        state = step.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == seen:  # a star per component: every node points to the least one
            roots = step.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(step.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """h, class_id (smallest doc_id), first_h (the text of that document), class_size, n_links of every distinct text."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.unhex(F.md5("text")))
    blocks = stored(to_blocks(keyed, "h", "binary", WORD_BYTES))
    n_docs = blocks.agg(F.sum("n_docs")).first()[0] or 0
    answered = blocks.join(ask(blocks, _frequency_question, _frequency_answer(n_docs)), "block", "left")
    sampled = stored(answered.mapInArrow(
        _samples, "block bigint, h binary, keys array<bigint>, weight double, codes binary"))
    let_go(docs.sparkSession)
    buckets = sampled.select("h", "weight", F.posexplode("keys").alias("band", "key")).groupBy("band", "key", "h").agg(
        F.min("weight").alias("weight"))
    met = buckets.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    shared = stored(buckets.join(met, ["band", "key"]))
    let_go(docs.sparkSession)
    place = F.struct("block", "codes")
    wanted = (
        sampled.join(shared.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.min_by(place, "block").alias("p"))
        .groupBy("p.block").agg(F.collect_list(F.struct("h", F.col("p.codes").alias("codes"))).alias("wanted")))
    vectors = stored(blocks.join(wanted, "block").mapInArrow(
        _vectors, "h binary, shingle binary, times binary, codes binary"))
    let_go(docs.sparkSession)
    near = stored(links(shared, vectors, threshold))
    let_go(docs.sparkSession)
    degree = near.select(F.explode(F.array("h", "leader")).alias("h")).groupBy("h").agg(F.count("*").alias("n_links"))
    roots = components(near, "h", "leader")
    texts = keyed.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    rooted = texts.join(roots, texts["h"] == roots["node"], "left").withColumn("root", F.coalesce("root", "h"))
    per_class = rooted.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("first"), F.sum("n").alias("class_size"))
    return rooted.select("h", "root").join(per_class, "root").join(degree, "h", "left").select(
        "h", F.col("first.doc_id").alias("class_id"), F.col("first.h").alias("first_h"), "class_size",
        F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Columns of docs without the text, with class_id, class_size and n_links (leaders and members of its text)."""
    own, columns = own_columns(docs, "text", "class_id", "class_size", "n_links")
    rows = docs.select(own, F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("h"))
    return rows.join(classes(docs, threshold), "h").select(*columns, "class_id", "class_size", "n_links")


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class: the one with the smallest doc_id, and of equal rows one."""
    first = classes(docs, threshold).where(F.col("h") == F.col("first_h")).select(
        F.col("h").alias("first_h"), F.col("class_id").alias("first_id"))
    own, columns = own_columns(docs)
    keyed = docs.select(own, F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("h"), F.col("doc_id").alias("id"))
    kept = keyed.join(first, (F.col("h") == F.col("first_h")) & F.col("id").eqNullSafe(F.col("first_id")))
    return kept.dropDuplicates(["h", "id"]).select(*columns)
