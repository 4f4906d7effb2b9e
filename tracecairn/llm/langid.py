"""Language identification as a mixture of languages, fitted by expectation-maximisation.

Training counts hashed character trigrams by language; that gives P(gram | language). A
document is taken as drawn from a mixture of languages: expectation-maximisation finds its
proportions. Which languages take part is chosen by penalised likelihood: from the best single
language on, the most promising one joins while the mixture gains more than one penalty by it;
then the weakest go while that costs less than their penalty.
Neighbouring trigrams overlap, so likelihoods count a third (``TEMPER``).

The model takes BUCKETS floats per language, whatever the corpus, and is sent to the tasks;
its counts cover all training rows. A very long text is a chunk of its own; repeated rows are
predicted one by one, alike. Null and letterless texts are ``und`` with score 0. Ties
go to the language first by name. Without training rows every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracecairn.llm.common import chunks, code_points, texts_of

BUCKETS = 1 << 16
TEMPER = 1 / 3
ROUNDS = 12
SMOOTHING = 0.05
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (text, trigram bucket, count), sorted; trigrams around a letter, in lower case."""
    points, begins = code_points([x.lower() for x in texts])
    # A border before and after each text, so that no trigram crosses two texts.
    at = np.arange(len(points)) + np.repeat(np.arange(len(texts)), np.diff(begins)) + 1
    padded = np.zeros(len(points) + len(texts) + 1, np.uint32)
    padded[at] = np.where(_letters()[points], points, 0)
    middle = np.flatnonzero(padded)
    code = (padded[middle - 1] * np.uint32(0x9E3779B1) ^ padded[middle] * np.uint32(0x85EBCA77)
            ^ padded[middle + 1] * np.uint32(0xC2B2AE3D))
    code = (code ^ code >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(16)
    owner = np.searchsorted(begins[1:] + np.arange(1, len(texts) + 1), middle, side="right")
    keys, counts = np.unique(owner.astype(np.int64) * BUCKETS + code, return_counts=True)
    return keys // BUCKETS, keys % BUCKETS, counts


@dataclass
class Model:
    """log P(gram | language), one row a gram and one column a language."""

    languages: list[str]
    log_p: np.ndarray

    def fit(self, texts: list[str], penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Proportions by text and language, and the posterior of each text's best language."""
        n, k = len(texts), len(self.languages)
        owner, gram, count = grams_of(texts)
        weight = count * TEMPER
        log_p = self.log_p[gram]
        total = np.bincount(owner, weight, n)
        single = np.stack([np.bincount(owner, weight * log_p[:, j], n) for j in range(k)], 1)
        best = single.argmax(1)
        top = single[np.arange(n), best]
        posterior = 1 / np.exp(single - top[:, None]).sum(1)
        share = np.zeros((n, k))
        share[np.arange(n), best] = 1
        if k == 1 or not len(owner):
            return share, posterior
        cost = penalty * np.log(np.maximum(total, np.e))
        heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        held = owner[heads]
        # Relative to the best single language of the text, so that nothing underflows whole.
        ratio = np.exp(log_p - log_p.max(1, keepdims=True))
        base = np.bincount(owner, weight * log_p.max(1), n)
        mixed, gain = share[held], top[held]
        active, sizes = mixed > 0, np.diff(np.concatenate((heads, [len(owner)])))
        # Forward, then backward: only texts whose set has changed are worked on again.
        for change in (1, -1):
            rows = np.flatnonzero(active.sum(1) > (0 if change > 0 else 2))
            while len(rows):
                own = sizes[rows]
                begins = np.cumsum(own) - own
                pick = (slice(None) if len(rows) == len(held) else
                        np.repeat(heads[rows] - begins, own) + np.arange(own.sum()))
                near, heavy = ratio[pick], weight[pick]
                if change > 0:
                    # The language by whose first share the likelihood would rise most steeply.
                    now = np.maximum((near * np.repeat(mixed[rows], own, 0)).sum(1), 1e-300)
                    slope = np.add.reduceat(near * (heavy / now)[:, None], begins, 0)
                    at = np.where(active[rows], -1, slope).argmax(1)
                else:
                    at = np.where(active[rows], mixed[rows], 2).argmin(1)
                trial = active[rows].copy()
                trial[np.arange(len(rows)), at] = change > 0
                fitted, value = self._mix(near, heavy, begins, trial)
                value += base[held[rows]]
                better = value - change * cost[held[rows]] > gain[rows]
                moved = rows[better]
                active[moved], mixed[moved], gain[moved] = trial[better], fitted[better], value[better]
                # Sets of two have been compared with the best language alone, full ones have no further.
                size = active[moved].sum(1)
                rows = moved[size < k if change > 0 else size > 2]
        share[held] = mixed
        return share, posterior

    @staticmethod
    def _mix(ratio: np.ndarray, weight: np.ndarray, heads: np.ndarray,
             active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log-likelihood of mixtures over the active languages."""
        sizes = np.diff(np.concatenate((heads, [len(weight)])))
        total = np.add.reduceat(weight, heads)
        share = active / active.sum(1, keepdims=True)
        for _ in range(ROUNDS):
            part = ratio * np.repeat(share, sizes, 0)
            part *= (weight / np.maximum(part.sum(1), 1e-300))[:, None]
            share = np.add.reduceat(part, heads, 0) / total[:, None]
        fit = np.log(np.maximum((ratio * np.repeat(share, sizes, 0)).sum(1), 1e-300))
        return share, np.add.reduceat(weight * fit, heads)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count trigrams of all rows with a language; counts are added up in the tasks first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for part in chunks(batches, "text"):
            names = part.column(1).to_pylist()
            owner, gram, times = grams_of(texts_of(part, "text"))
            index = {x: i for i, x in enumerate(dict.fromkeys(names))}
            lang = np.array([index[x] for x in names])[owner] if len(owner) else owner
            for name, i in index.items():
                own = lang == i
                held[name] = held.get(name, 0) + np.bincount(
                    gram[own], times[own], BUCKETS).astype(np.int64)
        for name, sums in held.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()),
                 pa.array(sums[at], pa.int64())], ["lang", "gram", "n"])

    rows = (docs.where(F.col(lang_col).isNotNull())
            .select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
            .mapInArrow(count, "lang string, gram int, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas())
    languages = sorted(rows["lang"].unique())
    counts = np.zeros((BUCKETS, len(languages)))
    for j, name in enumerate(languages):
        own = rows[rows["lang"] == name]
        counts[own["gram"], j] = own["n"]
    # Grams that a language has not shown keep a little of the pooled distribution.
    pooled = counts.sum(1) + 1e-3
    pooled /= pooled.sum()
    total = counts.sum(0)
    mass = SMOOTHING * np.maximum(total, 1) ** 0.5 * 10
    smooth = (counts + pooled[:, None] * mass) / (total + mass)
    return Model(languages, np.log(smooth))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus lang_pred, score, and lang_share (language to proportion).

    Columns of these names that ``docs`` has already are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own.languages, UNKNOWN])
        for part in chunks(batches, text_col):
            texts = texts_of(part, text_col)
            any_letter = np.array([any(map(str.isalpha, x)) for x in texts])
            if own.languages:
                share, posterior = own.fit(texts)
                at = share.argmax(1)
                single = share.max(1) >= 1
                score = np.where(single, posterior, share.max(1))
                at[~any_letter] = len(own.languages)
            else:
                share, at = np.zeros((len(texts), 0)), np.zeros(len(texts), np.int64)
                any_letter, score = np.zeros(len(texts), bool), np.zeros(len(texts))
            score = np.where(any_letter, np.clip(score, 0, 1), 0.0)
            r, c = np.nonzero(share * any_letter[:, None])
            maps = pa.MapArray.from_arrays(
                pa.array(np.searchsorted(r, np.arange(len(texts) + 1)), pa.int32()),
                pa.array(names[c].tolist(), pa.string()), pa.array(share[r, c], pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(names[at].tolist(), pa.string()), pa.array(score), maps],
                [*part.schema.names, "lang_pred", "score", "lang_share"])

    kept = docs.drop("lang_pred", "score", "lang_share")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(
        run, f"{fields}, lang_pred string, score double, lang_share map<string,double>")
