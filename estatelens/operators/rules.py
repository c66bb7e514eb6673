"""Ordered substring rules as a table: the first rule whose needle a text contains.

Rules are rows (``rule_no``, ``field``, ``needle``), so a rule is added by adding a row. All needles are looked for in
one pass over a text by an Aho-Corasick automaton, however many there are. The rules are dealt into blocks of
BLOCK_CHARS characters of needles at most. A table of one block becomes one automaton that travels with the tasks. Of
more blocks, every task builds one at a time and has the distinct texts pass by it; the smallest rule number over the
blocks wins. So neither what is sent nor what a task holds grows with the table, and no rule goes through the driver.
"""

from __future__ import annotations

import operator
import sys
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # travels with the tasks: no worker needs the package

BLOCK_CHARS = 4_000_000


class _Automata:
    """The automata of one block, one per field."""

    def __init__(self, fields: list[str]):
        self.needles: dict[str, dict[str, int]] = {f: {} for f in fields}
        self.built = None

    def add(self, field: str, needle: str, rule_no: int) -> None:
        known = self.needles[field]
        known[needle] = min(rule_no, known.get(needle, rule_no))

    def build(self) -> None:
        import ahocorasick

        self.built = {}
        for field, known in self.needles.items():
            found, always = ahocorasick.Automaton(), known.pop("", None)
            while known:
                found.add_word(*known.popitem())
            if len(found):
                found.make_automaton()
            self.built[field] = (found if len(found) else None, always)

    def smallest(self, texts: dict[str, list]) -> list:
        """Per row the smallest rule number of the block, None if none matches."""
        if self.built is None:
            self.build()
        best = [None] * len(next(iter(texts.values())))
        for field, (found, always) in self.built.items():
            for i, text in enumerate(texts[field]):
                if text is None:
                    continue
                hits = [] if found is None else [rule_no for _, rule_no in found.iter(text)]
                if always is not None:
                    hits.append(always)
                if best[i] is not None:
                    hits.append(best[i])
                best[i] = min(hits, default=None)
        return best


def _pass(rows: DataFrame, fields: list[str], rules: list, out: str) -> DataFrame:
    """Rows with the smallest rule number of one block, NULL if none matches."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _Automata(fields)
        for rule in rules:
            automata.add(rule["field"], rule["needle"], rule["rule_no"])
        for batch in batches:
            best = automata.smallest({f: batch.column(f).to_pylist() for f in fields})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.int64())], names=[*names, out])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{schema}, `{out}` bigint")


def _by_block(rows: DataFrame, fields: list[str], usable: DataFrame, blocks: int, out: str) -> DataFrame:
    """Rows with the smallest rule number over many blocks, NULL if none matches.

    The distinct texts go to every block; a block comes as often as it takes to have a task per shuffle partition. In a
    task the rules of a block are followed by its texts, which stream by.
    """
    copies = -(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks)
    held = [f"_f{i}" for i in range(len(fields))]
    texts = rows.select(*[F.col(f).alias(h) for f, h in zip(fields, held)]).distinct()
    dealt_texts = texts.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"),
        F.pmod(F.xxhash64(*held), F.lit(copies)).cast("int").alias("_copy"), F.lit(1).alias("_is_text"), *held)
    dealt_rules = usable.select(
        F.pmod(F.xxhash64("field", "needle"), F.lit(blocks)).cast("int").alias("_block"),
        F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_copy"), F.lit(0).alias("_is_text"), "rule_no", "field", "needle")
    dealt = dealt_rules.unionByName(dealt_texts, allowMissingColumns=True).repartition(blocks * copies, "_block", "_copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, automata = None, None
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in ("_block", "_copy", "_is_text"))))
            for (block, copy, is_text), span in groupby(range(len(places)), places.__getitem__):
                begin = next(span)
                part = batch.slice(begin, 1 + sum(1 for _ in span))
                if (block, copy) != at:
                    at, automata = (block, copy), _Automata(fields)
                if not is_text:
                    for rule in zip(*(part.column(c).to_pylist() for c in ("field", "needle", "rule_no"))):
                        automata.add(*rule)
                    continue
                best = automata.smallest({f: part.column(h).to_pylist() for f, h in zip(fields, held)})
                yield pa.RecordBatch.from_arrays([*(part.column(h) for h in held), pa.array(best, pa.int64())], names=[*held, "_best"])

    found = dealt.sortWithinPartitions("_block", "_copy", "_is_text").mapInArrow(run, ", ".join(f"{h} string" for h in held) + ", _best bigint")
    first = found.filter("_best IS NOT NULL").groupBy(*held).agg(F.min("_best").alias("_best"))
    same = reduce(operator.and_, [F.col(f).eqNullSafe(F.col(h)) for f, h in zip(fields, held)])
    return rows.join(first, same, "left").withColumn(out, F.col("_best")).drop("_best", *held)


def first_rules(rows: DataFrame, fields: list[str], rules: DataFrame, out: str = "rule_no") -> DataFrame:
    """Rows with the number of the first rule that matches, by ``rule_no``; NULL for none.

    A rule matches if its ``field`` (one of ``fields``, a text column) contains its ``needle``; an empty needle is
    contained in any text that is not NULL. Letters count as they are: pass lower-cased columns and needles for more.
    """
    usable = rules.filter(F.col("needle").isNotNull() & F.col("field").isin(fields)).select(
        F.col("rule_no").cast("bigint").alias("rule_no"), "field", "needle")
    chars = usable.agg(F.coalesce(F.sum(F.length("needle") + 1), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // (BLOCK_CHARS // 2)))
    if blocks > 1:
        return _by_block(rows, fields, usable, blocks, out)
    return _pass(rows, fields, usable.collect(), "_rule").withColumn(out, F.col("_rule")).drop("_rule")
