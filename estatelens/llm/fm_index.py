"""Benchmark decontamination: FM-indexes over shards of the documents' words, searched for the benchmark's windows.

Every task cuts its documents into shards of at most SHARD words, sorts the shard's suffixes, and keeps the
Burrows-Wheeler transform in a wavelet tree with rank counts. All windows (10 words of an item, or a whole shorter
item) are searched backwards at once; occurrences are located by walking back to sampled suffix positions. Their word
spans are merged per document. Words that no benchmark item has are one symbol, and runs of them one place: no window
can reach across. Nothing is shuffled; only the windows are sent to the tasks, MAX_QUERY_WORDS at a time, and a larger
benchmark is searched in several passes whose spans are merged.

Defined results: a null or empty text has no words and is clean; null or wordless items have no windows; repeated rows
are searched one by one; items with equal ids count as one; an empty table gives no rows, an empty benchmark leaves
all documents clean; extra columns do not matter.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .toxicity import in_slices

ship(__name__)

WINDOW = 10
SHARD = 1 << 20  # words of an index
SAMPLE = 8  # every so many text positions are kept
MAX_QUERY_WORDS = 1_000_000
_DOC_END = b"\x01"
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative symbols by prefix doubling; a suffix that ends is less than its extensions.

    Keys and positions share a 64-bit number, so sorting needs no indirection; suffixes that are alone in their
    place drop out after the first rounds.
    """
    n = len(symbols)
    place = max(1, int(n).bit_length())
    bits = int(symbols.max(initial=0) + 2).bit_length()
    depth = max(1, (64 - place) // bits)
    padded = np.concatenate([symbols.astype(np.uint64) + np.uint64(1), np.zeros(depth, np.uint64)])
    key = np.zeros(n, np.uint64)
    for i in range(depth):
        key = key << np.uint64(bits) | padded[i:n + i]
    low = np.uint64((1 << place) - 1)
    key = np.sort(key << np.uint64(place) | np.arange(n, dtype=np.uint64))
    order = (key & low).astype(np.int64)
    key >>= np.uint64(place)
    new = np.append(True, key[1:] != key[:-1])
    first = np.flatnonzero(new)
    rank = np.zeros(n + 1, np.int64)  # 1 + first place of the group; 0 beyond the end
    rank[order] = np.repeat(first, np.diff(np.append(first, n))) + 1
    open_places = np.flatnonzero(~(new & np.append(new[1:], True)))  # of groups with more than one suffix
    while len(open_places):
        at = order[open_places]
        group = rank[at]
        behind = rank[np.minimum(at + depth, n)]
        step = np.lexsort((behind, group)) if 2 * place + 2 > 63 else np.argsort(group << (place + 1) | behind, kind="stable")
        at, group, behind = at[step], group[step], behind[step]
        order[open_places] = at
        new = np.append(True, (group[1:] != group[:-1]) | (behind[1:] != behind[:-1]))
        first = np.flatnonzero(new)
        rank[at] = np.repeat(open_places[first], np.diff(np.append(first, len(at)))) + 1
        open_places = open_places[~(new & np.append(new[1:], True))]
        depth *= 2
    return order


class Bits:
    """A bit vector with constant-time rank: packed words and the counts before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class FMIndex:
    """Index of one shard: symbols 0 .. sigma - 1; symbol 0 never occurs in a query."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        n = len(symbols)
        text = np.append(symbols + 1, 0)  # 0 ends the text
        order = np.append(n, suffix_order(symbols)) if n else np.zeros(1, np.int64)
        transform = text[order - 1]
        self.smaller = np.append(0, np.cumsum(np.bincount(text, minlength=sigma + 1)))
        self.levels: list[tuple[Bits, int, int]] = []  # wavelet tree by bits from the top, level by level
        for shift in reversed(range(max(1, int(sigma).bit_length()))):
            one = (transform >> shift & 1).astype(bool)
            self.levels.append((Bits(one), int((~one).sum()), shift))
            transform = np.concatenate([transform[~one], transform[one]])
        sampled = order % SAMPLE == 0
        self.sampled, self.samples = Bits(sampled), order[sampled]
        self.size = n + 1

    def _rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The place of each symbol in the last level, from a place in the first."""
        for bits, zeros, shift in self.levels:
            ones = bits.rank(at)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at

    def find(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all windows (rows of symbols, the last `length` columns used): first and end row."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.size)
        alive = np.arange(len(windows))
        for back in range(1, windows.shape[1] + 1):
            alive = alive[(lengths[alive] >= back) & (low[alive] < high[alive])]
            symbol = windows[alive, -back] + 1
            start = self._rank(symbol, np.zeros(len(alive), np.int64))
            low[alive] = self.smaller[symbol] + self._rank(symbol, low[alive]) - start
            high[alive] = self.smaller[symbol] + self._rank(symbol, high[alive]) - start
        return low, high

    def _step_back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix one symbol longer."""
        at, start, symbol = row, np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for bits, zeros, shift in self.levels:
            one = bits.get(at)
            ones, start_ones = bits.rank(at), bits.rank(start)
            at = np.where(one, zeros + ones, at - ones)
            start = np.where(one, zeros + start_ones, start - start_ones)
            symbol |= one.astype(np.int64) << shift
        return self.smaller[symbol] + at - start

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: back to the next sampled one, then its position plus the steps."""
        found, steps, row, number = np.zeros(len(rows), np.int64), 0, rows, np.arange(len(rows))
        while len(row):
            known = self.sampled.get(row)
            found[number[known]] = self.samples[self.sampled.rank(row[known])] + steps
            row, number = self._step_back(row[~known]), number[~known]
            steps += 1
        return found


class Queries:
    """Windows of benchmark items over their own vocabulary."""

    def __init__(self, items: list[tuple[object, str]]):
        self.number: dict[bytes, int] = {}
        held: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text or "")]
            for at in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
                held.setdefault(tuple(ids[at:at + WINDOW]), set()).add(str(item))
        self.lengths = np.array([len(w) for w in held], np.int64)
        self.windows = np.zeros((len(held), WINDOW), np.int64)
        for i, w in enumerate(held):
            self.windows[i, WINDOW - len(w):] = w
        self.items = [sorted(x) for x in held.values()]

    def occurrences(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, window number) of every occurrence, shard by shard; shards overlap by a window less one word."""
        positions, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for begin in range(0, len(symbols), SHARD):
            index = FMIndex(symbols[begin:begin + SHARD + WINDOW - 1], len(self.number) + 1)
            low, high = index.find(self.windows, self.lengths)
            count = np.maximum(high - low, 0)
            number = np.repeat(np.arange(len(count)), count)
            row = np.arange(len(number)) + np.repeat(low - np.cumsum(count) + count, count)
            positions.append(index.locate(row) + begin)
            numbers.append(number)
        return np.concatenate(positions), np.concatenate(numbers)

    def search(self, texts: list[str]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """Per text: number of words, merged spans of hit words, items that hit."""
        lookup = self.number | {_DOC_END: -1}
        joined = b" ".join(t.encode("utf-8", "surrogatepass").translate(_TO_WORDS) + b" " + _DOC_END for t in texts).split()
        ids = np.fromiter(map(lookup.get, joined, itertools.repeat(0)), np.int64, len(joined))
        ends = np.flatnonzero(ids < 0)
        begins = np.append(0, ends[:-1] + 1)
        known = ids > 0
        kept = np.flatnonzero(known | np.append(True, known[:-1]))  # a run of other words stays as one place
        symbols = np.maximum(ids[kept], 0)
        out = [(int(n), [], []) for n in ends - begins]
        if not len(self.lengths):
            return out
        position, number = self.occurrences(symbols)
        start = kept[position]
        text = np.searchsorted(ends, start)
        cover = np.zeros(len(ids) + 1, np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + self.lengths[number], -1)
        edge = np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=0)
        for a, b in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)):
            t = int(np.searchsorted(ends, a))
            out[t][1].append((int(a - begins[t]), int(b - begins[t])))
        hits: dict[int, set[str]] = {}
        for t, n in set(zip(text.tolist(), number.tolist())):
            hits.setdefault(t, set()).update(self.items[n])
        for t, items in hits.items():
            out[t][2].extend(sorted(items))
        return out


RESULT = "n_words bigint, spans array<struct<first:bigint,end:bigint>>, items array<string>"


def _without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the spans' words and what stands between them; spans that overlap or touch are one."""
    if text is None or not spans:
        return text
    raw, kept, at, last = text.encode("utf-8", "surrogatepass"), [], 0, -1
    places = [m.span() for m in _WORD.finditer(raw.translate(_TO_WORDS))]
    for first, end in sorted(spans):
        if first > last:
            kept.append(raw[at:places[first][0]])
        if end > last:
            at, last = places[end - 1][1], end
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def _search(columns: list[str], queries, cut: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Queries(queries.value)
        span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        for batch in in_slices(batches, 8_000_000):
            texts = batch.column("text").to_pylist()
            found = known.search([t or "" for t in texts])
            if cut:
                earlier = batch.column("_spans").to_pylist() if "_spans" in batch.schema.names else [()] * len(texts)
                gone = [[*((s["first"], s["end"]) for s in a), *x[1]] for a, x in zip(earlier, found)]
                at = batch.schema.get_field_index("text")
                batch = batch.set_column(at, batch.schema.field(at), pa.array(map(_without, texts, gone), batch.column(at).type))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array([x[0] for x in found], pa.int64()),
                 pa.array([[{"first": a, "end": b} for a, b in x[1]] for x in found], span),
                 pa.array([x[2] for x in found], pa.list_(pa.string()))],
                names=[*columns, "n_words", "spans", "items"])

    return run


def _query_blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of at most MAX_QUERY_WORDS words (or one longer item); one block is held at a time."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        n = len(row.text or "") // 2 + 1
        if block and size + n > MAX_QUERY_WORDS:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += n
    yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, keep_text: bool = False, cut: bool = False) -> DataFrame:
    """Columns of docs (the text on request), n_words, spans (merged, in words from 0), items of every document.

    With `cut` the last pass takes the words of all spans out of the text it keeps, so no other Python step holds texts.
    """
    spark = docs.sparkSession
    found = docs.drop("n_words", "spans", "items", "_spans", "_items")
    blocks, first = _query_blocks(benchmark), True
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        source = found if first else found.drop("n_words").withColumnsRenamed({"spans": "_spans", "items": "_items"})
        kept = [f for f in source.schema if f.name != "text" or keep_text or following is not None]
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), RESULT])
        search = _search([f.name for f in kept], spark.sparkContext.broadcast(block), cut and following is None)
        found = source.mapInArrow(search, schema)
        if not first:
            found = found.withColumns({
                "spans": _merged(F.concat("_spans", "spans")),
                "items": F.array_sort(F.array_union("_items", "items"))}).drop("_spans", "_items")
        block, first = following, False
    return found


def _merged(spans):
    """Overlapping or touching spans as one."""
    return F.aggregate(
        F.array_sort(spans), F.array().cast("array<struct<first:bigint,end:bigint>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["first"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["first"].alias("first"),
                F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(x))))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents with the text of all hit spans cut out; documents without a hit are left as they are."""
    return contaminated(docs, benchmark, keep_text=True, cut=True)
