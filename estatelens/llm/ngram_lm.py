"""Language-model scores: a trigram trie in Elias-Fano levels, sharded by word pair, that scores every document.

Documents become blocks of words. Blocks ask shards for the training counts of their words, and send their distinct
trigrams to the shard of the leading pair, which so gets all successors of the pair. A shard builds its part of the
trie from the training counts:

- level 2: the pairs, an Elias-Fano sequence, with quantised counts and back-off weights;
- pointers: where each pair's successors begin, an Elias-Fano sequence as they only grow;
- level 3: the successors of all pairs, each relative to its pair, an Elias-Fano sequence, with quantised discounted
  probabilities.

The levels are one memory-mapped file without a name, gone with the task. The blocks' trigrams are looked up by
successor search: the pair, its pointers, the word within them. The codes go back to the blocks, which add up

    P(w | u v) = (c(uvw) - D) / c(uv) + D * successors(uv) / c(uv) * P(w | v)
    P(w | v)   = (c(vw) + M * P(w)) / (c(v) + M)
    P(w)       = (c(w) + 1) / (N + V + 1)

No part of the model is broadcast; a hot pair is one row per block. Words are known by 64-bit hashes.

Defined results: a null text is an empty one, that is the end token alone; a null id counts as an empty one for the
fold; repeated rows are learnt and scored one by one; without training documents N and V are 0; an empty table gives
no rows; extra columns do not matter.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import (
    ask, ask_shards, mixed, pack, packed_keys, shard_bounds, shards_for, text_blocks, texts_of, unpack, unpacked, unpacked_keys,
)
from .common import ship, stored
from .labelled import fold

ship(__name__)

FOLDS, HELD_OUT = 7, 2
DISCOUNT = 0.75
BACK_OFF = 20.0  # M
BLOCK_CHARS = 10_000_000
PAIR_BITS = np.uint64(((1 << 56) - 1) << 8)  # a pair is 56 bits of its hash
STEPS = 4096  # codes per power of ten
NONE = 65535  # code of probability 0
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BEGIN, END, NIL = (xxhash.xxh3_64_intdigest(x) for x in (b" begin", b" end", b" nil"))  # no word has a blank


# --- levels -------------------------------------------------------------------------


def coded(values: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] as codes: -log10 in steps; 0 as NONE."""
    with np.errstate(divide="ignore"):
        return np.where(values > 0, np.clip(np.rint(-np.log10(values) * STEPS), 0, NONE - 1), NONE).astype(np.uint16)


_VALUES = np.append(10.0 ** (-np.arange(NONE) / STEPS), 0.0)
_ONE = np.uint64(1)
_BYTES = np.uint64(0x0101010101010101)
_TOPS = np.uint64(0x8080808080808080)
_IN_BYTE = np.array([[([i for i in range(8) if b >> i & 1] + [0] * 8)[r] for r in range(8)] for b in range(256)], np.uint8)


def _select_in_word(words: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Place of the nth one (from 0) of each word: by byte sums, then by table."""
    x = words - (words >> _ONE & np.uint64(0x5555555555555555))
    x = (x & np.uint64(0x3333333333333333)) + (x >> np.uint64(2) & np.uint64(0x3333333333333333))
    sums = (x + (x >> np.uint64(4)) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _BYTES
    nth = nth.astype(np.uint64)
    byte = np.bitwise_count(((nth * _BYTES | _TOPS) - sums) & _TOPS).astype(np.uint64) * np.uint64(8)
    before = (sums << np.uint64(8)) >> byte & np.uint64(0xFF)
    return byte.astype(np.int64) + _IN_BYTE[(words >> byte & np.uint64(0xFF)).astype(np.int64), (nth - before).astype(np.int64)]


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary with a directory of counts per word."""

    def __init__(self, arrays: list[np.ndarray], n: int, low_bits: int):
        self.low, self.high, self.ones = arrays
        self.n, self.low_bits = n, low_bits
        self.zeros = np.arange(len(self.ones)) * 64 - self.ones

    @staticmethod
    def build(values: np.ndarray) -> tuple[list[np.ndarray], int, int]:
        n = len(values)
        values = values.astype(np.uint64)
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        low = np.zeros(n * low_bits // 64 + 2, np.uint64)
        if low_bits:
            at = np.arange(n, dtype=np.int64) * low_bits
            part = values & np.uint64((1 << low_bits) - 1)
            shift = (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, at >> 6, part << shift)
            over = np.flatnonzero((at & 63) + low_bits > 64)
            np.bitwise_or.at(low, (at[over] >> 6) + 1, part[over] >> (np.uint64(64) - shift[over]))
        place = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(place[-1]) // 64 + 2 if n else 1) * 64, np.uint8)
        bits[place] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.append(0, np.cumsum(np.bitwise_count(high), dtype=np.int64))
        return [low, high, ones], n, low_bits

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        both = self.low[word] >> shift | np.where(shift > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(shift, _ONE)), np.uint64(0))
        return both & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + _select_in_word(self.high[word], i - self.ones[word])
        return (place - i).astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)

    def _bucket(self, high: np.ndarray) -> np.ndarray:
        """How many values have less than these high bits: ones before the zero that ends the bucket before."""
        out = np.zeros(len(high), np.int64)
        inner = high > 0
        nth = high[inner] - 1
        word = np.minimum(np.searchsorted(self.zeros, nth, "right") - 1, len(self.high) - 1)
        beyond = nth >= self.zeros[-1]
        place = word * 64 + _select_in_word(~self.high[word], np.where(beyond, 0, nth - self.zeros[word]))
        out[inner] = np.where(beyond, self.n, place - nth)
        return np.minimum(out, self.n)

    def find(self, x: np.ndarray, first: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Index of the successor of x (least value >= x) if it equals x, else -1; within [first, end) if given."""
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        high = np.minimum(high, 1 << 62)
        at, stop = self._bucket(high), self._bucket(high + 1)
        if first is not None:
            at, stop = np.maximum(at, first), np.minimum(stop, end)
        low = x & np.uint64((1 << self.low_bits) - 1)
        end, alive = stop.copy(), np.flatnonzero(at < stop)
        while len(alive):  # halves what is left of each bucket
            middle = (at[alive] + end[alive]) >> 1
            less = self._low(middle) < low[alive]
            at[alive] = np.where(less, middle + 1, at[alive])
            end[alive] = np.where(less, end[alive], middle)
            alive = alive[at[alive] < end[alive]]
        held = np.flatnonzero(at < stop)
        hit = held[self._low(at[held]) == low[held]]
        out[hit] = at[hit]
        return out


class Trie:
    """A shard's levels in a memory-mapped file."""

    def __init__(self, pairs: np.ndarray, first: np.ndarray, words: np.ndarray, counts: np.ndarray):
        """pairs ascending; words[first[i]:first[i + 1]] ascending, with their counts, follow pair i."""
        sizes = np.diff(first)
        total = np.add.reduceat(counts, first[:-1]).astype(np.float64) if len(pairs) else np.zeros(0)
        parent = np.repeat(np.arange(len(pairs)), sizes)
        self.base = pairs[0] if len(pairs) else np.uint64(0)
        built = [EliasFano.build((pairs - self.base) >> np.uint64(8)), EliasFano.build(first),
                 EliasFano.build(parent.astype(np.uint64) << np.uint64(32) | words)]
        plain = [coded(1 / total), coded(DISCOUNT * sizes / total),
                 coded(np.maximum(counts - DISCOUNT, 0) / total[parent]) if len(words) else np.zeros(0, np.uint16)]
        mapped = iter(_mapped([*(a for arrays, _, _ in built for a in arrays), *plain]))
        self.pairs, self.pointers, self.words = (
            EliasFano([next(mapped) for _ in arrays], n, low) for arrays, n, low in built)
        self.pair_count, self.pair_back, self.probability = mapped

    def look_up(self, pairs: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of 1 / c and of the back-off weight per pair, of the discounted probability per word below it."""
        node = self.pairs.find((pairs - self.base) >> np.uint64(8))
        node[pairs < self.base] = -1
        known = node >= 0
        count, back = np.full(len(pairs), NONE, np.uint16), np.zeros(len(pairs), np.uint16)
        count[known], back[known] = self.pair_count[node[known]], self.pair_back[node[known]]
        probability = np.full(len(words), NONE, np.uint16)
        below = np.flatnonzero(np.repeat(known, sizes))
        first = np.zeros(len(pairs), np.int64)
        end = np.zeros(len(pairs), np.int64)
        first[known], end[known] = self.pointers.get(node[known]), self.pointers.get(node[known] + 1)
        of = np.repeat(np.arange(len(pairs)), sizes)[below]
        found = self.words.find(node[of].astype(np.uint64) << np.uint64(32) | words[below], first[of], end[of])
        hit = found >= 0
        probability[below[hit]] = self.probability[found[hit]]
        return count, back, probability


def _mapped(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays as views of one memory-mapped file that has no name and ends with them."""
    with tempfile.TemporaryFile() as file:
        for a in arrays:
            file.write(np.ascontiguousarray(a).tobytes())
            file.write(bytes(-a.nbytes % 8 + 8))
        file.flush()
        held = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    out, at = [], 0
    for a in arrays:
        out.append(np.frombuffer(held, a.dtype, len(a), at))
        at += a.nbytes + -a.nbytes % 8 + 8
    return out


# --- blocks -------------------------------------------------------------------------


class Tokens:
    """The words of a block: hashes in order, one text after the other, and which texts train."""

    def __init__(self, row):
        self.carry, texts = texts_of(row)
        split = [t.split() for t in texts]
        self.sizes = np.fromiter(map(len, split), np.int64, len(split))
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for words in split for w in words], np.int64)
        del split, texts
        self.names = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
        self.ids = ids
        self.train = np.array([c["train"] for c in self.carry], bool)

    def word_counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes ascending, with training counts, and for each word number its place among them."""
        counts = np.bincount(self.ids[np.repeat(self.train, self.sizes)], minlength=len(self.names))
        keys = np.append(self.names, np.uint64(END))
        order = np.argsort(keys)
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        return keys[order], np.append(counts, self.train.sum())[order].astype(np.int64), place

    def trigrams(self) -> tuple[np.ndarray, ...]:
        """Distinct trigrams by pair: pairs, successors per pair, successor words, training counts; and of every
        trigram in order (a text of n words has n + 2) its pair's and its own number."""
        n = self.sizes + 4  # two beginnings, the words, the end and nothing behind it
        ends = np.cumsum(n)
        words = np.empty(int(n.sum()), np.uint64)
        inside = np.ones(len(words), bool)
        for back, name in ((0, BEGIN), (1, BEGIN)):
            words[ends - n + back], inside[ends - n + back] = name, False
        for back, name in ((2, END), (1, NIL)):
            words[ends - back], inside[ends - back] = name, False
        words[inside] = self.names[self.ids]
        start = np.ones(len(words), bool)
        start[ends - 1] = start[ends - 2] = False
        start = np.flatnonzero(start)
        pair = mixed(words[start] * np.uint64(0x9E3779B97F4A7C15) + mixed(words[start + 1])) & PAIR_BITS
        word = words[start + 2] >> np.uint64(32)
        train = np.repeat(self.train, self.sizes + 2)
        order = np.argsort(pair)
        sorted_pair = pair[order]
        new_pair = np.append(True, sorted_pair[1:] != sorted_pair[:-1])[:len(order)]
        group = np.cumsum(new_pair) - 1
        several = np.flatnonzero(~(new_pair & np.append(new_pair[1:], True)[:len(order)]))
        key = group[several].astype(np.uint64) << np.uint64(32) | word[order[several]]
        order[several] = order[several][np.argsort(key)]
        sorted_word = word[order]
        new = new_pair | np.append(True, sorted_word[1:] != sorted_word[:-1])[:len(order)]
        number = np.cumsum(new) - 1
        counts = np.bincount(number, train[order], int(new.sum())).astype(np.uint32)
        of_pair, own = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        of_pair[order], own[order] = group, number
        sizes = np.bincount(group[new], minlength=int(new_pair.sum()))
        return sorted_pair[new_pair], sizes, sorted_word[new].astype(np.uint32), counts, of_pair, own


def _word_question(row):
    keys, counts, _ = Tokens(row).word_counts()
    return keys, [counts]


def _word_answer(questions: list[bytes]) -> list[bytes]:
    """Training counts of the words asked; before them, of the whole shard, its training words and tokens."""
    asked = [unpacked(q, np.int64) for q in questions]
    keys, counts = (np.concatenate(x) for x in zip(*asked))
    order = np.argsort(keys)
    new = np.append(True, np.diff(keys[order]) != 0)
    total = np.add.reduceat(counts[order], np.flatnonzero(new))
    back = np.empty(len(keys), np.int64)
    back[order] = total[np.cumsum(new) - 1]
    head = np.array([(total > 0).sum(), total.sum()], np.int64).tobytes()
    return [head + pack(x.tobytes()) for x in np.split(back, np.cumsum([len(k) for k, _ in asked])[:-1])]


def _trigram_question(row, shards: int) -> list[tuple[int, bytes]]:
    pairs, sizes, words, counts, _, _ = Tokens(row).trigrams()
    first = np.append(0, np.cumsum(sizes))
    cut = shard_bounds(pairs, shards).tolist()
    out = []
    for shard, (a, b) in enumerate(zip(cut, cut[1:])):
        if a == b:
            continue
        x, y = int(first[a]), int(first[b])
        small = sizes[a:b].astype(np.uint32).tobytes() + counts[x:y].tobytes()
        out.append((shard, packed_keys(pairs[a:b], small) + words[x:y].tobytes()))
    return out


def _asked_trigrams(question: bytes) -> tuple[np.ndarray, ...]:
    """Pairs, successors per pair, successor words, training counts."""
    pairs, beside, at = unpacked_keys(question)
    small = np.frombuffer(beside, np.uint32)
    return pairs, small[:len(pairs)].astype(np.int64), np.frombuffer(question[at:], np.uint32), small[len(pairs):]


def _trigram_answer(questions: list[bytes]) -> list[bytes]:
    """Builds the shard's trie from the training counts of all blocks, and looks up every block's trigrams."""
    asked = [_asked_trigrams(q) for q in questions]
    pair = np.concatenate([np.repeat(p, s)[c > 0] for p, s, _, c in asked])
    word = np.concatenate([w[c > 0] for _, _, w, c in asked])
    count = np.concatenate([c[c > 0] for _, _, _, c in asked]).astype(np.int64)
    order = np.argsort(pair)
    pair, word, count = pair[order], word[order], count[order]
    new_pair = np.append(True, pair[1:] != pair[:-1])[:len(pair)]
    group = np.cumsum(new_pair) - 1
    order = np.argsort(group.astype(np.uint64) << np.uint64(32) | word)
    group, word, count = group[order], word[order], count[order]
    new = np.append(True, (group[1:] != group[:-1]) | (word[1:] != word[:-1]))[:len(word)]
    total = np.add.reduceat(count, np.flatnonzero(new)) if len(word) else count
    first = np.append(np.flatnonzero(np.append(True, np.diff(group[new]) != 0)), new.sum()) if len(word) else np.zeros(1, np.int64)
    trie = Trie(pair[new_pair], first, word[new].astype(np.uint64), total)
    del pair, order, group, count
    return [pack(b"".join(x.tobytes() for x in trie.look_up(p, s, w.astype(np.uint64))), 3) for p, s, w, _ in asked]


def _scores(shards: int, n_docs: int, n_tokens: int, n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                yield _block_scores(row, shards, n_docs, n_tokens, n_words)

    return run


def _block_scores(row, shards: int, n_docs: int, n_tokens: int, n_words: int) -> pa.RecordBatch:
    tokens = Tokens(row)
    _, _, place = tokens.word_counts()
    counts = np.frombuffer(b"".join(unpack(r["reply"][16:]) for r in row["word_replies"].as_py()), np.int64)[place]
    pairs, _, _, _, of_pair, own = tokens.trigrams()
    cut, codes_of = shard_bounds(pairs, shards), {r["shard"]: r["reply"] for r in row["replies"].as_py()}
    count, back, probability = [], [], []
    for shard, n in enumerate(np.diff(cut).tolist()):
        if n:  # a reply holds two codes per pair and one per trigram
            codes = np.frombuffer(unpack(codes_of[shard]), np.uint16)
            count.append(codes[:n])
            back.append(codes[n:2 * n])
            probability.append(codes[2 * n:])
    count, back, probability = (_VALUES[np.concatenate(x)] for x in (count, back, probability))
    n = tokens.sizes + 1
    ends = np.cumsum(n)
    # of the n + 2 trigrams of a text, the first n + 1 end in its tokens; the pair of the next one is (v, w)
    tri = np.ones(int((n + 1).sum()), bool)
    tri[np.cumsum(n + 1) - 1] = False
    tri = np.flatnonzero(tri)
    c_word = np.empty(int(n.sum()), np.int64)
    inside = np.ones(len(c_word), bool)
    inside[ends - 1] = False
    c_word[inside] = counts[tokens.ids]
    c_word[ends - 1] = counts[-1]
    c_before = np.empty_like(c_word)
    c_before[1:] = c_word[:-1]
    c_before[ends - n] = n_docs
    unigram = (c_word + 1) / (n_tokens + n_words + 1)
    inverse = count[of_pair[tri + 1]]
    c_pair = np.divide(1.0, inverse, out=np.zeros(len(tri)), where=inverse > 0)
    bigram = (np.minimum(c_pair, c_before) + BACK_OFF * unigram) / (c_before + BACK_OFF)
    both = probability[own[tri]] + back[of_pair[tri]] * bigram
    begins = ends - n
    return pa.RecordBatch.from_arrays(
        [pa.array([c["doc_id"] for c in tokens.carry], pa.int64()), pa.array(~tokens.train), pa.array(n),
         pa.array(np.add.reduceat((c_word > 0).astype(np.int64), begins)), pa.array(np.full(len(n), n_tokens)),
         pa.array(np.add.reduceat(np.log10(unigram), begins)), pa.array(np.add.reduceat(np.log10(both), begins))],
        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every document."""
    carry = F.struct("doc_id", (fold(F.col("doc_id"), FOLDS) != HELD_OUT).alias("train")).alias("carry")
    blocks = stored(text_blocks(
        docs.select(carry, "text"), "carry", "struct<doc_id:bigint,train:boolean>", LOWER, BLOCK_CHARS))
    words = stored(ask(blocks, _word_question, _word_answer))
    heads = words.select(F.explode("replies").alias("r")).groupBy("r.shard").agg(
        F.min(F.substring("r.reply", 1, 16)).alias("head")).collect()  # 16 bytes a shard
    n_words, n_tokens = np.sum([np.frombuffer(r["head"], np.int64) for r in heads] or [[0, 0]], axis=0).tolist()
    n_docs = docs.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT).count()
    answers = ask_shards(blocks, _trigram_question, _trigram_answer)
    joined = blocks.join(words.withColumnRenamed("replies", "word_replies"), "block").join(answers, "block")
    return joined.mapInArrow(
        _scores(shards_for(blocks), n_docs, n_tokens, n_words),
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
