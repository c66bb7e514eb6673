"""Removal of every byte that lies in a string of LENGTH bytes which starts elsewhere too.

1. Anchors. Each window of LENGTH bytes picks the K-gram with the least hash in it, so equal windows pick the same
   one. The windows of an anchor go by a longer string around it, left or right of the anchor, whichever lies inside
   the window: equal windows have equal keys, and a key that stands at one place of one text holds no repeat. Which
   keys stand at two places or more is asked of shards of the key space, block by block (see `blocks`).
2. Segments. The text around repeated keys (a run of window starts and LENGTH - 1 bytes more) is grouped by key; equal
   segments of a block are one row with the places they stand at, and count once.
3. Suffix arrays. A task sorts the suffixes of its segments in two stages: those smaller than their successors
   directly, the others induced from them by one scan over the buckets. Neighbours in the order whose common prefix
   has LENGTH bytes are repeats; so are the windows of a segment that stands at several places.
4. The ranges are merged per text. Copies of a text share its result, and have it whole removed if it is long enough.

On request passages of WORDS words that start elsewhere too are found as well, whatever bytes they have and whatever
white space parts their words: the same steps with words, known by 64-bit hashes, for bytes. A task ranks the suffixes
of such segments by 1, 2, 4 ... WORDS words.

A text is known by its hash (MD5), so copies cost one row per task. Equal windows always meet, hence nothing is lost;
a clash of key hashes only makes unequal segments meet, which the suffix order tells apart.

Defined results: a null text is an empty one; texts shorter than LENGTH bytes stay as they are; repeated rows are
copies; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ask, mixed, text_blocks, texts_of, unpacked
from .common import SPACE, own_columns, partitions_for, ship, stored

ship(__name__)

LENGTH = 400
K = 128
WORDS = 51  # words `[^\x20\x09-\x0D]+` of a passage: over 50
WORD_K = 8
BLOCK_CHARS = 6_000_000
HASHED_AT_ONCE = 1_000_000  # bytes, unless one text is longer
BATCH = 1_000_000  # bytes of segments sorted at once, unless one group is larger
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_IN_WORD = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class Hashes:
    """Hashes of any substring: differences of running sums of byte * base^position, moved to position 0."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        powers = np.cumprod(np.append(np.uint64(1), np.full(n, _BASE, np.uint64)), dtype=np.uint64)
        self.back = np.cumprod(np.append(np.uint64(1), np.full(n, _INVERSE, np.uint64)), dtype=np.uint64)
        self.sums = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:len(data)], dtype=np.uint64))

    def of(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        raw = (self.sums[start + length] - self.sums[start]) * self.back[start]
        raw ^= raw >> np.uint64(32)
        raw *= np.uint64(0xD6E8FEB86659FD93)
        return raw ^ raw >> np.uint64(29)

    def of_all(self, length: int) -> np.ndarray:
        """of() for every start."""
        m = len(self.sums) - length
        raw = (self.sums[length:] - self.sums[:m]) * self.back[:m]
        raw ^= raw >> np.uint64(32)
        raw *= np.uint64(0xD6E8FEB86659FD93)
        return raw


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of values[s : s + width] for every s, from running minima within blocks of that width."""
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    so_far = np.minimum.accumulate(padded, axis=1).ravel()
    return np.minimum(ahead[:n], so_far[width - 1:width - 1 + n])


def words_of(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of joined texts start and end, and how many each text has."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    inside = _IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[begins[sizes > 0]] = inside[begins[sizes > 0]]
    last[ends[sizes > 0] - 1] = inside[ends[sizes > 0] - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.diff(np.searchsorted(start, np.append(0, ends)))


def runs_of_windows(hashes: Hashes, sizes: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first start, last start, key) of the windows by anchor and side, in bytes or words of the texts."""
    n = len(hashes.sums) - 1
    ends = np.cumsum(sizes)
    begins = ends - sizes
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none
    grams = hashes.of_all(k)
    low = np.uint64((1 << n.bit_length()) - 1)
    anchor = sliding_least(grams & ~low | np.arange(len(grams), dtype=np.uint64), length - k + 1) & low
    start = np.arange(len(anchor))
    text = np.repeat(np.arange(len(sizes)), sizes)[:len(anchor)]
    inside = start + length <= ends[text]
    start, text, anchor = start[inside], text[inside], anchor[inside].astype(np.int64)
    if not len(start):
        return none, none, none, none
    side = (length - k) // 2
    right = start > anchor - side
    run = anchor * 2 + right
    at = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    last = np.append(at[1:], len(start)) - 1
    a, r = anchor[at], right[at]
    key = np.empty(len(at), np.uint64)
    key[~r] = hashes.of(a[~r] - side, side + k)
    key[r] = hashes.of(a[r], length - side + 1) ^ np.uint64(_BASE)
    t = text[at]
    return t, start[at] - begins[t], start[last] - begins[t], key.view(np.int64)


def suffix_order(data: bytes) -> np.ndarray:
    """All suffixes, by their first LENGTH bytes or more, in two stages."""
    n = len(data)
    text = np.frombuffer(data, np.uint8)
    # Stage 1: suffixes smaller than their successors; of equal neighbours the run's end decides.
    change = np.diff(text.astype(np.int16), append=-1)
    following = np.minimum.accumulate(np.where(change != 0, np.arange(n), n)[::-1])[::-1]
    small = change[following] > 0
    direct = np.flatnonzero(small)
    padded = data + bytes(16)
    words = np.ndarray((n + 8,), ">u8", padded, strides=(1,))
    key = words[direct].astype(np.uint64)
    step = np.argsort(key, kind="stable")
    direct, key = direct[step], key[step]
    new = np.append(True, key[1:] != key[:-1])[:len(direct)]
    tied = np.flatnonzero(~(new & np.append(new[1:], True)[:len(direct)]))
    if len(tied):  # the few whose first 8 bytes are not their own: compared as strings, group by group
        group = np.cumsum(new)[tied]
        at = direct[tied]
        bounds = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        for a, b in zip(bounds.tolist(), np.append(bounds[1:], len(at)).tolist()):
            at[a:b] = sorted(at[a:b].tolist(), key=lambda i: data[i + 8:i + LENGTH])
        direct[tied] = at
    # Stage 2: scan the buckets of first bytes; the predecessor of each suffix, if it is larger, comes next in its own.
    heads = np.searchsorted(text[direct], np.arange(257))
    pieces: list[list[np.ndarray]] = [[] for _ in range(256)]
    pieces[text[n - 1]].append(np.array([n - 1]))
    order = []
    for byte in range(256):
        front = np.concatenate(pieces[byte]) if pieces[byte] else np.zeros(0, np.int64)
        bucket = []
        while len(front):
            bucket.append(front)
            before = front[front > 0] - 1
            front = before[text[before] == byte]  # a run of this byte: larger than its successor as that one is
        bucket.append(direct[heads[byte]:heads[byte + 1]])
        whole = np.concatenate(bucket)
        order.append(whole)
        before = whole[whole > 0] - 1
        before = before[text[before] > byte]
        if len(before):
            first = text[before]
            step = np.argsort(first, kind="stable")
            before, first = before[step], first[step]
            cut = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(before)]):
                pieces[first[a]].append(before[a:b])
    return np.concatenate(order)


def repeated_starts(segments: list[bytes]) -> list[np.ndarray]:
    """Per segment the window starts whose LENGTH bytes stand at another start of any segment."""
    data = b"".join(segments)
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    begins = np.cumsum(sizes) - sizes
    window = np.zeros(len(data), bool)
    for a, n in zip(begins.tolist(), sizes.tolist()):
        window[a:a + n - LENGTH + 1] = True
    order = suffix_order(data)
    order = order[window[order]]
    rows = np.ndarray((len(data) - LENGTH + 1, LENGTH), np.uint8, data, strides=(1, 1))
    words = np.ndarray((len(data) - 7,), np.uint64, data, strides=(1,)) if LENGTH >= 8 else None
    left, right = order[:-1], order[1:]
    if words is not None:  # most neighbours part early
        same = words[left] == words[right]
        left, right = left[same], right[same]
        same = words[left + LENGTH - 8] == words[right + LENGTH - 8]
        left, right = left[same], right[same]
    hit = np.zeros(len(data), bool)
    for a in range(0, len(left), 50_000):
        common = (rows[left[a:a + 50_000]] == rows[right[a:a + 50_000]]).all(axis=1)  # a common prefix of LENGTH
        hit[left[a:a + 50_000][common]] = True
        hit[right[a:a + 50_000][common]] = True
    return [np.flatnonzero(hit[a:a + n]) for a, n in zip(begins.tolist(), sizes.tolist())]


def repeated_words(segments: list[bytes]) -> list[np.ndarray]:
    """The same in words: the window starts whose WORDS words stand at another start of any segment."""
    data = np.frombuffer(b"".join(segments), np.uint8)
    start, end, sizes = words_of(data, np.fromiter(map(len, segments), np.int64, len(segments)))
    codes = Hashes(data).of(start, end - start)
    begins = np.cumsum(sizes) - sizes
    rank, ranked = np.unique(codes, return_inverse=True)[1], 1
    while ranked < WORDS:  # ranks by some words and by as many further on, at most, are ranks by both
        step = min(ranked, WORDS - ranked)
        pair = rank * (rank.max() + 1)
        pair[:-step] += rank[step:]
        rank, ranked = np.unique(pair, return_inverse=True)[1], ranked + step
    window = np.arange(len(codes)) + WORDS <= np.repeat(begins + sizes, sizes)
    hit = window & (np.bincount(rank[window], minlength=len(codes))[rank] > 1)
    return [np.flatnonzero(hit[a:a + n]) for a, n in zip(begins.tolist(), sizes.tolist())]


def _texts_of(row) -> tuple[list[bytes], list[bytes]]:
    """Names and bytes of the distinct texts of a block."""
    texts = dict(zip(*texts_of(row)))
    return list(texts), list(texts.values())


def _block_runs(names: list[bytes], texts: list[bytes], passages: bool) -> tuple[np.ndarray, ...]:
    """(text number, first start, last start, key, place, whether in words) of all runs; the texts are hashed some at a time."""
    none = np.zeros(0, np.int64)
    parts, begin, size = [(none, none, none, none, none.astype(bool))], 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= HASHED_AT_ONCE or i + 1 == len(texts):
            data = np.frombuffer(b"".join(texts[begin:i + 1]), np.uint8)
            sizes = np.fromiter(map(len, texts[begin:i + 1]), np.int64, i + 1 - begin)
            hashes = Hashes(data)
            number, first, last, key = runs_of_windows(hashes, sizes, LENGTH, K)
            parts.append((number + begin, first, last, key, np.zeros(len(key), bool)))
            if passages:
                start, end, counts = words_of(data, sizes)
                number, first, last, key = runs_of_windows(Hashes(hashes.of(start, end - start)), counts, WORDS, WORD_K)
                parts.append((number + begin, first, last, ~key, np.ones(len(key), bool)))
            begin, size = i + 1, 0
    number, first, last, key, words = (np.concatenate(x) for x in zip(*parts))
    name = np.array([int.from_bytes(h[:8], "little") for h in names], np.uint64)
    return number, first, last, key.view(np.uint64), mixed(name[number] + first.astype(np.uint64) * np.uint64(_BASE)), words


def _asked(key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys of a block, each with its least and greatest place."""
    order = np.lexsort((place, key))
    key, place = key[order], place[order]
    new = np.append(True, key[1:] != key[:-1])[:len(key)]
    ends = new | np.append(new[1:], True)[:len(key)]
    return key[ends], [place[ends]]


def _places_question(row, passages: bool):
    _, _, _, key, place, _ = _block_runs(*_texts_of(row), passages)
    return _asked(key, place)


def _places_answer(questions: list[bytes]) -> list[bytes]:
    """For every key sent whether it stands at two places or more."""
    asked = [unpacked(q, np.uint64) for q in questions]
    key, place = (np.concatenate(x) for x in zip(*asked))
    order = np.lexsort((place, key))
    key, place = key[order], place[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    last = np.append(first[1:], len(key)) - 1
    back = np.empty(len(key), np.uint8)
    back[order] = np.repeat(place[first] != place[last], last - first + 1)
    return [x.tobytes() for x in np.split(back, np.cumsum([len(k) for k, _ in asked])[:-1])]


def _segments(batches: Iterator[pa.RecordBatch], passages: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            names, texts = _texts_of(row)
            number, first, last, key, place, words = _block_runs(names, texts, passages)
            sent, _ = _asked(key, place)
            repeated = np.frombuffer(b"".join(r["reply"] for r in row["replies"].as_py() or ()), np.uint8) > 0
            if not repeated.any():
                continue
            chosen = np.flatnonzero(np.isin(key, sent[repeated]))
            chosen = chosen[np.lexsort((number[chosen], words[chosen]))]
            places: dict[tuple[bool, int, bytes], tuple[list[bytes], list[int]]] = {}
            split, parts = -1, []
            for w, k, n, a, b in zip(words[chosen].tolist(), key[chosen].view(np.int64).tolist(), number[chosen].tolist(),
                                     first[chosen].tolist(), last[chosen].tolist()):
                if w and n != split:
                    split, parts = n, texts[n].split()
                segment = b" ".join(parts[a:b + WORDS]) if w else texts[n][a:b + LENGTH]
                owners, starts = places.setdefault((w, k, segment), ([], []))
                owners.append(names[n])
                starts.append(a)
            found = list(places.items())
            for part in (found[i:i + 4096] for i in range(0, len(found), 4096)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0][0] for x in part], pa.bool_()), pa.array([x[0][1] for x in part], pa.int64()),
                     pa.array([x[0][2] for x in part], pa.binary()),
                     pa.array([x[1][0] for x in part], pa.list_(pa.binary())), pa.array([x[1][1] for x in part], pa.list_(pa.int64())),
                     pa.array([row["block"].as_py()] * len(part), pa.int64())],
                    names=["words", "key", "segment", "h", "first", "block"])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by unit, key and segment: groups are gathered up to BATCH bytes, equal segments once."""
    segments: list[bytes] = []
    places: list[dict[tuple[bytes, int], int]] = []
    size, last_key = 0, (False, None)

    def solved() -> pa.RecordBatch:
        found, words = [], last_key[0]
        length, repeated = (WORDS, repeated_words) if words else (LENGTH, repeated_starts)
        for segment, owners, starts in zip(segments, places, repeated(segments)):
            spans = []
            if len(owners) > 1:
                spans = [(0, segment.count(b" ") + 1 if words else len(segment))]
            elif len(starts):
                cut = np.flatnonzero(np.append(True, np.diff(starts) > 1))
                spans = list(zip(starts[cut].tolist(), (starts[np.append(cut[1:], len(starts)) - 1] + length).tolist()))
            found += [(h, block, words, first + a, first + b) for (h, first), block in owners.items() for a, b in spans]
        h, block, unit, begin, end = zip(*found) if found else ((),) * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(h, pa.binary()), pa.array(block, pa.int64()), pa.array(unit, pa.bool_()),
             *(pa.array(x, pa.int64()) for x in (begin, end))], names=["h", "block", "words", "begin", "end"])

    for batch in batches:
        for words, key, segment, owners, starts, block in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
            if (words, key) != last_key and size >= BATCH or segments and words != last_key[0]:
                yield solved()
                segments, places, size = [], [], 0
            if (words, key) != last_key or not segments or segments[-1] != segment:
                segments.append(segment)
                places.append({})
                size += len(segment)
            for place in zip(owners, starts):
                places[-1].setdefault(place, block)  # copies of a text stand at one place
            last_key = (words, key)
    if segments:
        yield solved()


def _merged(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return out


def _cut(batches: Iterator[pa.RecordBatch], cut_passages: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            texts, rows = dict(zip(*_texts_of(row))), []
            for found in row["found"].as_py():
                data = texts[found["h"]]
                passages = _merged((r["begin"], r["end"]) for r in found["ranges"] if r["words"])
                spans = _merged((r["begin"], r["end"]) for r in found["ranges"] if not r["words"])
                if passages and cut_passages:
                    start, end, _ = words_of(np.frombuffer(data, np.uint8), np.array([len(data)]))
                    spans = _merged(spans + [[int(start[a]), int(end[b - 1])] for a, b in passages])
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append((found["h"], sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest(), kept, len(passages)))
            h, removed, n, sha, kept, n_passages = zip(*rows) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(h, pa.binary()), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()),
                 pa.array(kept, pa.binary()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()),
                 pa.array(n_passages, pa.int64())],
                names=["h", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text", "n_passages"])


RESULT = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]


def dedup(docs: DataFrame, keep_text: bool = False, passages: str | None = None) -> DataFrame:
    """Columns of docs without the text, with n_bytes, n_removed, n_spans, kept_sha256; on request `kept`, the bytes
    that stay, and `kept_text`, their whole characters (a cut may fall inside one).

    passages: "count" adds n_passages, the runs of words in passages of WORDS words that start elsewhere too; "cut"
    removes them as well, from their first word to their last one, with what stands there. Copies of a text of so many
    words are one passage each, and go whole.
    """
    text = F.coalesce("text", F.lit(""))
    counted = ["n_passages"] if passages else []
    own, own_names = own_columns(docs, *RESULT, "text", *counted, *(["kept", "kept_text"] if keep_text else []))
    wordy = text.rlike(rf"\A[{SPACE}]*+(?:[^{SPACE}]++[{SPACE}]++){{{WORDS - 1}}}[^{SPACE}]") if passages else F.lit(False)
    keyed = docs.select(own, F.unhex(F.md5(text)).alias("h"), F.octet_length(text).cast("bigint").alias("n_bytes"),
                        F.sha2(text, 256).alias("_sha"), wordy.alias("_wordy"), F.col("text").alias("text"))
    rows = keyed if keep_text else keyed.drop("text")
    least = min(LENGTH, 2 * WORDS - 1) if passages else LENGTH
    long = docs.select(F.unhex(F.md5(text)).alias("h"), text.alias("text")).where(F.octet_length("text") >= least)
    blocks = stored(text_blocks(long, "h", "binary", chars=BLOCK_CHARS))
    answered = blocks.join(ask(blocks, lambda row: _places_question(row, bool(passages)), _places_answer), "block")
    segments = answered.mapInArrow(
        lambda batches: _segments(batches, bool(passages)),
        "words boolean, key bigint, segment binary, h array<binary>, first array<bigint>, block bigint")
    ranges = segments.repartition(partitions_for(docs.sparkSession), "key").sortWithinPartitions("words", "key", "segment").mapInArrow(
        _ranges, "h binary, block bigint, words boolean, begin bigint, end bigint")
    per_text = ranges.groupBy("h").agg(F.min("block").alias("block"), F.collect_set(F.struct("words", "begin", "end")).alias("ranges"))
    per_block = per_text.groupBy("block").agg(F.collect_list(F.struct("h", "ranges")).alias("found"))
    columns = ["h", "n_removed", "n_spans", "kept_sha256", *(["kept", "kept_text"] if keep_text else []), *counted]
    found = blocks.join(per_block, "block").mapInArrow(
        lambda batches: _cut(batches, passages == "cut"),
        "h binary, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, kept_text string, n_passages bigint").select(
        "h", *(F.col(c).alias(f"_{c}") for c in columns[1:]))
    long_enough = F.col("n_bytes") >= LENGTH
    copies = keyed.where(long_enough | F.col("_wordy")).groupBy("h").agg(F.count("*").alias("_copies")).where("_copies > 1")
    copied = F.col("_copies").isNotNull()
    gone = copied if passages == "cut" else copied & long_enough
    kept = [
        F.when(gone, F.lit(b"")).otherwise(F.coalesce("_kept", F.col("text").cast("binary"))).alias("kept"),
        F.when(gone, F.lit("")).otherwise(F.coalesce("_kept_text", "text")).alias("kept_text"),
    ] if keep_text else []
    n_passages = F.when(copied & F.col("_wordy"), 1).otherwise(F.coalesce("_n_passages", F.lit(0))).cast("bigint") if passages else None
    return rows.join(copies, "h", "left").join(found, "h", "left").select(
        *own_names, "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("_n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("_n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("_kept_sha256", "_sha")).alias("kept_sha256"),
        *kept, *([n_passages.alias("n_passages")] if passages else []))
