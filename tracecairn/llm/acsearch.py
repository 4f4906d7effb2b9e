"""Ranked lexical search by scanning the texts with an Aho-Corasick automaton of all item terms.

Nothing is indexed. Texts are folded byte by byte (A-Z to a-z, what separates terms to one blank), so
that a term is a run of other bytes, and the automaton holds each item term between two blanks: a
match is a whole term. Two scans read the documents. The first counts documents, terms and, for each
item term, the documents that hold it; each task adds up its own and sends one row a term. The second
knows all weights, maps the automaton's matches to items, scores each document in its task, and keeps
each item's best ``k`` of the task; a window over these few rows gives the result.

The automaton is broadcast. Items are dealt by hash to blocks of about ``block_bytes`` of terms, and
each block has scans of its own, so a broadcast is bound by that and the terms of the largest item.
Terms of more than ``LONG`` bytes are found by their digest, as a path through the automaton has one
node a byte.

Null and empty texts have no terms: such documents don't count, such items find nothing. Documents
with repeated or null ids are ranked one by one (null last among equal scores); rows of one item id
(null too) are one item with the terms of all. Ids of documents are whole numbers.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from tracecairn.llm.common import chunks, runs_within
from tracecairn.operators.storage import materialize

#: Fixed value: bytes of 0-9, A-Z, a-z and of every code point above ASCII belong to terms.
FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80
             else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
TOP = 10
BLOCK_BYTES = 1 << 20
LONG = 256
_LONG_RUN = re.compile(rb"[^ ]{%d,}" % (LONG + 1))
#: Score cells (documents x items) that a task holds at a time.
CELLS = 1 << 20
_DOCUMENTS, _TERMS = -1, -2


def fold(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """All texts between blanks, and where each begins (one more at the end)."""
    begins = 1 + np.concatenate(([0], np.cumsum([len(x) + 1 for x in texts], dtype=np.int64)))
    return b" ".join((b"", *texts, b"")).translate(FOLD), begins


@dataclass
class Terms:
    """The terms of a block's items, and for each term its items (``items[starts[t]:starts[t+1]]``)."""

    automaton: ahocorasick.Automaton | None
    long: dict[bytes, int]
    size: int
    item_ids: list
    starts: np.ndarray
    items: np.ndarray

    @classmethod
    def build(cls, pairs: list[tuple[object, bytes]]) -> Terms:
        places, names = {}, {}
        term = np.array([places.setdefault(t, len(places)) for _, t in pairs], np.int64)
        item = np.array([names.setdefault(i, len(names)) for i, _ in pairs], np.int64)
        automaton, long = ahocorasick.Automaton(), {}
        for word, at in places.items():
            if len(word) > LONG:
                long[sha256(word).digest()] = at
            else:
                automaton.add_word(f" {word.decode('latin-1')} ", at)
        if len(automaton):
            automaton.make_automaton()
        order = np.argsort(term, kind="stable")
        starts = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(places)))))
        return cls(automaton if len(automaton) else None, long, len(places), list(names),
                   starts, item[order])

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Terms of each text; and rows (text, item term, occurrences)."""
        folded, begins = fold(texts)
        apart = np.frombuffer(folded, np.uint8) == 0x20
        heads = np.flatnonzero(apart[:-1] & ~apart[1:]) + 1
        n = np.diff(np.searchsorted(heads, begins))
        found = np.zeros(0, np.int64)
        if self.automaton is not None:
            found = np.fromiter(
                chain.from_iterable(self.automaton.iter(folded.decode("latin-1"))), np.int64)
        end, term = found[0::2], found[1::2]
        if self.long:
            runs = [(x.end(), self.long.get(sha256(x[0]).digest(), -1))
                    for x in _LONG_RUN.finditer(folded)]
            more = np.array([x for x in runs if x[1] >= 0], np.int64).reshape(-1, 2)
            end, term = np.concatenate((end, more[:, 0])), np.concatenate((term, more[:, 1]))
        # A match ends on the blank behind its term.
        text = np.searchsorted(begins, end, "right") - 1
        keys, tf = np.unique(text * max(self.size, 1) + term, return_counts=True)
        return n, keys // max(self.size, 1), keys % max(self.size, 1), tf


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term): the distinct terms of each item."""
    kind = items.schema[item_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            texts = part.column(1).to_pylist()
            own = [sorted(set((x or b"").translate(FOLD).split())) for x in texts]
            parents = np.repeat(np.arange(len(own)), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(parents)),
                 pa.array([t for x in own for t in x], pa.binary())], ["item", "term"])

    rows = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"item {kind}, term binary").distinct()


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").to_pylist()]


def _statistics(docs: DataFrame, shared) -> tuple[int, int, np.ndarray]:
    """Documents with terms, terms, and the documents that hold each item term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: Terms = shared.value
        df, documents, total = np.zeros(terms.size, np.int64), 0, 0
        for part in chunks(batches, "text"):
            n, _, term, _ = terms.counts(_texts(part))
            df += np.bincount(term, minlength=terms.size)
            documents, total = documents + int((n > 0).sum()), total + int(n.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((seen, [_DOCUMENTS, _TERMS])), pa.int64()),
             pa.array(np.concatenate((df[seen], [documents, total])), pa.int64())], ["term", "n"])

    # One row a term of the block, whatever the number of documents.
    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(
        F.sum("n").alias("n")).collect()
    counts = {r["term"]: r["n"] for r in rows}
    df = np.array([counts.get(t, 0) for t in range(shared.value.size)], np.int64)
    return counts.get(_DOCUMENTS, 0), counts.get(_TERMS, 0), df


def weights(documents: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1)))
                     for n in df.tolist()], np.int64)


class Best:
    """Each item's ``k`` best documents so far: highest score, then smallest id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.rows = [np.zeros(0, np.int64) for _ in range(4)]

    def add(self, item: np.ndarray, score: np.ndarray, is_null: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.least[item]
        new = (item[good], -score[good], is_null[good], ids[good])
        self.rows = [np.concatenate(x) for x in zip(self.rows, new)]
        if len(self.rows[0]) > 4 * self.k * len(self.least):
            self.settle()

    def settle(self) -> None:
        order = np.lexsort(self.rows[::-1])
        self.rows = [x[order] for x in self.rows]
        per_item = np.bincount(self.rows[0], minlength=len(self.least))
        rank = runs_within(per_item)
        last = np.flatnonzero(rank == self.k - 1)
        self.least[self.rows[0][last]] = -self.rows[1][last]
        self.rows = [x[rank < self.k] for x in self.rows]


def _scored(docs: DataFrame, shared, weight: np.ndarray, documents: int, total: int, k: int,
            kind: DataType) -> DataFrame:
    """(item, score, doc): each task's best documents."""

    arrow_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: Terms = shared.value
        items, many = len(terms.item_ids), np.diff(terms.starts)
        best, step = Best(items, k), max(1, CELLS // max(1, items))
        for part in chunks(batches, "text"):
            ids = part.column("doc")
            is_null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            n, text, term, tf = terms.counts(_texts(part))
            m = 100 - 90 + 90 * n * documents // max(total, 1)
            value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[text]))
            for a in range(0, len(ids), step):
                own = slice(*np.searchsorted(text, (a, a + step)))
                spread = many[term[own]]
                item = terms.items[np.repeat(terms.starts[term[own]], spread) + runs_within(spread)]
                cells = np.zeros(min(step, len(ids) - a) * items, np.int64)
                np.add.at(cells, np.repeat((text[own] - a) * items, spread) + item,
                          np.repeat(value[own], spread))
                hit = np.flatnonzero(cells)
                row = a + hit // items
                best.add(hit % items, cells[hit], is_null[row], ids[row])
        best.settle()
        item, score, null, doc = best.rows
        names = pa.array([terms.item_ids[i] for i in item.tolist()], arrow_kind)
        yield pa.RecordBatch.from_arrays(
            [names, pa.array(-score, pa.int64()), pa.array(doc, pa.int64(), mask=null.astype(bool))],
            ["item", "score", "doc"])

    return docs.mapInArrow(run, f"item {kind.simpleString()}, score long, doc long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES,
           id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(item_col, rank, id_col, score): each item's ``k`` best documents with a score above 0."""
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType
    vocabulary = materialize(item_terms(items, item_col, text_col), "item-terms")
    size = vocabulary.agg(F.sum(F.octet_length("term") + 2)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"),
                       F.col(text_col).cast("binary").alias("text"))
    found = None
    for block in range(blocks):
        own = vocabulary.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        pairs = sorted(map(tuple, own.collect()), key=lambda x: (x[1], repr(x[0])))
        shared = spark.sparkContext.broadcast(Terms.build([(i, bytes(t)) for i, t in pairs]))
        documents, total, df = _statistics(rows, shared)
        part = _scored(rows, shared, weights(documents, df), documents, total, k, kind)
        found = part if found is None else found.unionByName(part)
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select(
        F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def sql(k: int = TOP) -> str:
    """The ranking by plain counting."""
    words = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"""
    return rf"""WITH words AS (SELECT rowid AS row, doc_id, {words} AS term FROM (
    SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
wanted AS (SELECT DISTINCT item_id, {words} AS term FROM benchmark),
tf AS MATERIALIZED (SELECT row, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
size AS (SELECT row, cast(sum(tf) AS BIGINT) AS n FROM tf GROUP BY row),
corpus AS (SELECT count(*) AS docs, cast(sum(n) AS BIGINT) AS terms FROM size),
weight AS (SELECT term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, corpus GROUP BY term, docs),
scored AS (SELECT item_id, doc_id, row, cast(sum(w * ((1000000000 * tf) //
    (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM tf JOIN wanted USING (term) JOIN weight USING (term) JOIN size USING (row), corpus
  GROUP BY item_id, doc_id, row),
ranked AS (SELECT item_id, doc_id, score, cast(row_number() OVER (
    PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {k}"""
