"""Toxicity by bags of subword embeddings.

A word is the mean of the embeddings of its hashed character n-grams, borders included, so that an unseen
spelling shares vectors with the words it resembles. Word vectors are averaged over short
overlapping windows and go into a linear softmax; embeddings and softmax are trained jointly with numpy.
Labels are given for whole documents: a document counts as toxic if any of its windows is,
which is the noisy-or of their probabilities, and gradients flow through that. A document's score is the
probability of its most toxic window; so one insult in a long text is not averaged away.

Training takes at most ``max_docs`` labelled documents of each class, those whose id hashes lowest, of at
most ``max_chars`` characters each and ``max_sum`` / 2 in all; the model has BUCKETS x SIZE numbers. Both are fixed bounds. Scoring
reads whole texts, however long: a text is as toxic as its worst window. Null, empty and blank texts score as the bias alone. Rows with a null label or id do not
train; a document labelled more than once counts as toxic if any label says so. Without documents of both
classes every score is 0.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracecairn.llm.common import chunks, code_points, runs_within, texts_of

BUCKETS, SIZE = 1 << 16, 8
SHORTEST, LONGEST = 3, 5
WINDOW, STRIDE = 8, 4
EPOCHS, RATE, DECAY, MIN_Z = 80, 0.05, 0.02, 4.0
MAX_DOCS, MAX_CHARS, MAX_SUM = 3_000, 20_000, 20_000_000
#: Words of training text that are worked on at a time.
TOKENS_AT_ONCE = 100_000
CACHE_WORDS = 400_000
PUNCTUATION = ".,;:!?\"'()[]{}*#$%&|<>-_/\\"


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (word, bucket): the n-grams of each word between borders."""
    points, begins = code_points([f"<{w}>" for w in words])
    points = points.astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), np.diff(begins))
    left = begins[1:][owner] - np.arange(len(points)) if len(points) else owner
    owners, grams = [], []
    mixed = np.zeros(len(points), np.uint64)
    for n in range(1, LONGEST + 1):
        mixed = mixed * np.uint64(0x100000001B3) + np.concatenate(
            (points[n - 1:], np.zeros(min(n - 1, len(points)), np.uint64)))
        if n >= SHORTEST:
            at = np.flatnonzero(left >= n)
            h = (mixed[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            owners.append(owner[at])
            grams.append((h >> np.uint64(48)).astype(np.int64) % BUCKETS)
    return np.concatenate(owners), np.concatenate(grams)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (document, first word, end) over the joined words of all documents; none without words."""
    before = np.cumsum(counts) - counts
    many = np.where(counts > WINDOW, 1 + -(-(counts - WINDOW) // STRIDE), np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), many)
    first = np.minimum(runs_within(many) * STRIDE, np.maximum(counts - WINDOW, 0)[doc])
    return doc, before[doc] + first, before[doc] + np.minimum(first + WINDOW, counts[doc])


def normal(word: str) -> str:
    return word.strip(PUNCTUATION) or word


@dataclass
class Model:
    """Evidence of each n-gram (its embedding times the softmax difference) and the bias."""

    evidence: np.ndarray
    bias: float

    def __post_init__(self):
        self.place: dict[str, int] = {}
        self.value = array("d")

    def __getstate__(self):
        return {"evidence": self.evidence, "bias": self.bias}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def of_words(self, words: list[str]) -> np.ndarray:
        if len(self.place) > CACHE_WORDS:
            self.place, self.value = {}, array("d")
        got = list(map(self.place.get, words))
        if None in got:
            missing = [i for i, x in enumerate(got) if x is None]
            new = list(dict.fromkeys([words[i] for i in missing]))
            owner, gram = subwords([normal(w) for w in new])
            sums = np.bincount(owner, self.evidence[gram], len(new))
            self.place.update(zip(new, range(len(self.value), len(self.value) + len(new))))
            self.value.frombytes((sums / np.maximum(
                np.bincount(owner, minlength=len(new)), 1)).tobytes())
            for i in missing:
                got[i] = self.place[words[i]]
        return np.array(self.value)[np.array(got, np.int64)]

    def score(self, texts: list[str]) -> np.ndarray:
        split = [x.lower().split() for x in texts]
        counts = np.array([len(x) for x in split], np.int64)
        total = np.concatenate(([0], np.cumsum(self.of_words([w for x in split for w in x]))))
        doc, first, end = windows(counts)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, doc, (total[end] - total[first]) / (end - first))
        logit = self.bias + np.where(counts > 0, best, 0)
        return np.where(np.isneginf(logit), 0, 1 / (1 + np.exp(-np.clip(logit, -700, 700))))


def _z_scores(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """How far the share of documents with an n-gram differs between the classes."""
    clean, toxic = np.minimum(clean, n_clean), np.minimum(toxic, n_toxic)
    share = (clean + toxic + 1) / (n_clean + n_toxic + 2)
    spread = np.sqrt(share * (1 - share) * (1 / max(n_clean, 1) + 1 / max(n_toxic, 1)))
    return (toxic / max(n_toxic, 1) - clean / max(n_clean, 1)) / spread


@dataclass
class Block:
    """Some training documents: their words by number, and their windows."""

    first_doc: int
    words: list[str]
    token: np.ndarray
    counts: np.ndarray

    @classmethod
    def each(cls, texts: list[str]) -> Iterator[Block]:
        """All documents, about TOKENS_AT_ONCE words in a block."""
        known: dict[str, int] = {}
        token, counts = array("i"), []
        for i, text in enumerate(texts):
            words = [normal(w) for w in text.lower().split()]
            counts.append(len(words))
            token.extend([known.setdefault(w, len(known)) for w in words])
            if len(token) >= TOKENS_AT_ONCE or i == len(texts) - 1:
                yield cls(i + 1 - len(counts), list(known), np.array(token, np.int32),
                          np.array(counts, np.int64))
                known, token, counts = {}, array("i"), []

    def documents_with(self, labels: np.ndarray) -> np.ndarray:
        """For each class, how many documents hold each word."""
        holder = np.repeat(np.arange(len(self.counts)), self.counts)
        pairs = np.unique(holder * np.int64(len(self.words) + 1) + self.token)
        of, word = labels[self.first_doc + pairs // (len(self.words) + 1)], pairs % (len(self.words) + 1)
        return np.stack([np.bincount(word[of == k], minlength=len(self.words)) for k in (0, 1)])


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """Train on a bounded list of documents.

    Words and n-grams are made for one block of documents at a time; what is kept of all blocks is a
    few bytes a word and the n-grams that tell the classes apart.
    """
    # Only n-grams whose share of documents differs between the classes get an embedding; the
    # others would learn the training texts by heart.
    shares = np.zeros((2, BUCKETS))
    for block in Block.each(texts):
        owner, gram = subwords(block.words)
        shares += [np.bincount(gram, x[owner], BUCKETS) for x in block.documents_with(labels)]
    telling = np.abs(_z_scores(*shares, *np.bincount(labels, minlength=2))) >= MIN_Z
    blocks = []
    for block in Block.each(texts):
        owner, gram = subwords(block.words)
        per_word = np.maximum(np.bincount(owner, minlength=len(block.words)), 1)
        kept = telling[gram]
        blocks.append((block.first_doc, block.token, per_word.astype(np.int32),
                       owner[kept].astype(np.int32), gram[kept].astype(np.int32),
                       *(x.astype(np.int32) for x in windows(block.counts))))
        del owner, gram, kept

    rng = np.random.default_rng(1)
    table = rng.uniform(-1, 1, (BUCKETS, SIZE)) / SIZE
    soft = rng.uniform(-1, 1, (2, SIZE)) / SIZE
    bias = np.array([2.0, -2.0])
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (table, soft, bias)]
    positive = labels.astype(bool)
    for epoch in range(1, EPOCHS + 1):
        side = soft[1] - soft[0]
        evidence, by_gram, d_bias = table @ side, np.zeros(BUCKETS), 0.0
        for a, token, per_word, owner, gram, doc, first, end in blocks:
            many = int(doc[-1]) + 1 if len(doc) else 0
            length = end - first
            word = np.bincount(owner, evidence[gram], len(per_word)) / per_word
            total = np.concatenate(([0], np.cumsum(word[token])))
            logit = (total[end] - total[first]) / length + bias[1] - bias[0]
            p = 1 / (1 + np.exp(-logit))
            # log(1 - P) of a document is the sum of log(1 - p) of its windows.
            clean = np.bincount(doc, -np.logaddexp(0, logit), many)
            any_toxic = np.maximum(-np.expm1(clean), 1e-6)
            weight = np.where(positive[a:a + many], -np.exp(clean) / any_toxic, 1.0)
            pull = weight[doc] * p / len(texts)
            # Each window's pull spreads over its words, by differences at its ends.
            steps = (np.bincount(first, pull / length, len(token) + 1)
                     - np.bincount(end, pull / length, len(token) + 1))
            by_word = np.bincount(token, np.cumsum(steps)[:-1], len(per_word)) / per_word
            by_gram += np.bincount(gram, by_word[owner], BUCKETS)
            d_bias += pull.sum()
        d_side = by_gram @ table
        grads = (by_gram[:, None] * side, np.stack((-d_side, d_side)), np.array([-d_bias, d_bias]))
        for x, g, (m, v) in zip((table, soft, bias), grads, state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x *= 1 - RATE * DECAY
            x -= RATE * (m / (1 - 0.9 ** epoch)) / (np.sqrt(v / (1 - 0.99 ** epoch)) + 1e-8)
    return Model(np.where(telling, table @ (soft[1] - soft[0]), 0), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS,
          max_chars: int = MAX_CHARS, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_sum: int = MAX_SUM) -> Model:
    """Fit on the labelled rows of ``docs`` within the bounds."""
    marked = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
              .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label")))
    size = F.length(F.coalesce(text_col, F.lit("")))
    short = docs.where(size <= max_chars)
    ids = short.select(F.col(id_col).alias("_id"), size.alias("_size")).groupBy("_id").agg(
        F.max("_size").alias("_size")).join(marked, "_id")
    chosen = None
    for label in (0, 1):
        own = ids.where(F.col("_label") == label).orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
        chosen = own if chosen is None else chosen.unionByName(own)
    # At most 2 * max_docs rows go through this window.
    so_far = Window.partitionBy("_label").orderBy(F.xxhash64("_id"), "_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    chosen = chosen.withColumn("_sum", F.sum("_size").over(so_far)).where(
        F.col("_sum") <= max_sum // 2).select("_id", "_label")
    # At most 2 * max_docs ids, whatever the corpus.
    rows = (short.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
            .join(F.broadcast(chosen), "_id").groupBy("_id", "_label")
            .agg(F.min("_text").alias("_text")).orderBy("_id").collect())
    truth = np.array([r["_label"] for r in rows], np.int64)
    if len(set(truth.tolist())) < 2:
        return Model(np.zeros(BUCKETS), -np.inf)
    texts = [r["_text"] or "" for r in rows]
    del rows
    return fit(texts, truth)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score and predicted; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in chunks(batches, text_col):
            found = own.score(texts_of(part, text_col))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(found), pa.array((found >= 0.5).astype(np.int32))],
                [*part.schema.names, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, score double, predicted int")
