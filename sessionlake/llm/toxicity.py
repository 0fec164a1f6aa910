"""Toxicity by multiple-instance learning: documents have labels, sentences are what offends.

A document is a bag of sentences. A sentence's score is the logistic of its bias and the weights of
its words and word beginnings; a document's is the noisy-or of its sentences and of a leak, which
stands for labels that no sentence explains. Only documents have labels; the likelihood of these,
through the noisy-or, teaches the sentences. Features are chosen by counts over all labelled
training documents (likelihood ratio of feature and label); weights are fitted on a bounded sample
of them, drawn by a hash of the id for either label and weighted back to the true proportions. Then
each text is scored whole, and the sentences that offend are located.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from sessionlake.llm.common import Scratch, ship_code, within
from sessionlake.llm.langid import held_out

#: Labelled documents of either label that weights are fitted on, at most.
SAMPLE = 5_000
#: Features that a model may have, and the least likelihood ratio (chi-squared, 0.001) and documents of each.
FEATURES, LEAST_RATIO, LEAST_DOCS = 4_096, 10.83, 3
#: Beginnings of words that are features beside the words.
PREFIXES = range(3, 8)
#: A document is predicted toxic, and a sentence reported, from this score on.
THRESHOLD = 0.3
_STEPS, _RATE, _RIDGE = 300, 0.1, 0.05
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_FLUSH = 200_000


def sentences(text: str | None) -> Iterator[tuple[int, list[str]]]:
    """(start, lower-cased words) of every sentence with a word: a run without . ! ? or line end."""
    for m in _SENTENCE.finditer(text or ""):
        words = _WORD.findall(m[0].lower())
        if words:
            yield m.start(), words


def features(word: str) -> list[str]:
    """The word and its proper beginnings; those are marked, so that they are not words."""
    return [word] + ["^" + word[:k] for k in PREFIXES if k < len(word)]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


@dataclass
class ToxicModel:
    """Feature weights, a sentence's bias, and the leak as a logit."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0
    leak: float = -30.0
    _known: dict[str, float] = field(default_factory=dict, repr=False)

    def word(self, word: str) -> float:
        """A word's part in its sentence's logit; remembered, as words repeat."""
        got = self._known.get(word)
        if got is None:
            if len(self._known) > _FLUSH:
                self._known.clear()
            got = self._known[word] = sum(self.weights.get(f, 0.0) for f in features(word)) if self.weights else 0.0
        return got

    def logits(self, text: str | None) -> tuple[list[int], np.ndarray]:
        """Starts of the sentences of a text and their logits."""
        at, z = [], []
        for start, words in sentences(text):
            at.append(start)
            z.append(self.bias + sum(map(self.word, words)))
        return at, np.array(z)

    def combine(self, z: np.ndarray) -> float:
        """Noisy-or of sentence logits and the leak; the leak alone for no sentences."""
        spared = -np.logaddexp(0, self.leak) - np.logaddexp(0, z).sum()
        return float(min(1.0, max(0.0, -np.expm1(spared))))


def _spread(labelled: DataFrame) -> DataFrame:
    """(feature, pos, neg, docs): labelled documents with each feature, tallied before the shuffle; feature null counts all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def flush() -> Iterator[pa.RecordBatch]:
            names = list(tally[0].keys() | tally[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([tally[1][f] for f in names], pa.int64()), pa.array([tally[0][f] for f in names], pa.int64())], names=["feature", "pos", "neg"])
            tally[0].clear()
            tally[1].clear()

        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist(), strict=True):
                words = set(_WORD.findall((text.as_py() or "").lower()))
                tally[y].update({f for w in words for f in features(w)})
                tally[y][None] += 1
                if len(tally[0]) + len(tally[1]) > _FLUSH:
                    yield from flush()
        yield from flush()

    return labelled.select("text", "y").mapInArrow(run, "feature string, pos bigint, neg bigint").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def choose(counts: DataFrame, most: int = FEATURES, ratio: float = LEAST_RATIO, least: int = LEAST_DOCS) -> tuple[list[str], int, int]:
    """(features, toxic documents, others): those of the greatest likelihood ratio against the label, most of them at most."""
    total = counts.where("feature is null").first()
    if total is None or not total["pos"] or not total["neg"]:
        return [], int(total["pos"]) if total else 0, int(total["neg"]) if total else 0
    a, b, n, m = F.col("pos"), F.col("neg"), F.lit(total["pos"]), F.lit(total["neg"])
    seen, all_ = a + b, F.lit(total["pos"] + total["neg"])
    part = lambda k, side, group: F.when(k > 0, k * F.log(k * all_ / (side * group))).otherwise(F.lit(0.0))
    g2 = 2 * (part(a, n, seen) + part(b, m, seen) + part(n - a, n, all_ - seen) + part(m - b, m, all_ - seen))
    best = counts.where("feature is not null").where(seen >= least).withColumn("g2", g2).where(F.col("g2") >= ratio).orderBy(F.desc("g2"), "feature").limit(most)
    return [r["feature"] for r in best.select("feature").collect()], int(total["pos"]), int(total["neg"])


def _bags(labelled: DataFrame, names: list[str]) -> pa.Table:
    """Of each document its label and its sentences: their number, and for those with features the features' numbers."""
    places = {f: k for k, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            plain, bags = [], []
            for text in batch.column("text"):
                held: Counter = Counter()
                for _, words in sentences(text.as_py()):
                    ids: list[int] = []
                    for w in words:
                        got = known.get(w)
                        if got is None:
                            if len(known) > _FLUSH:
                                known.clear()
                            got = known[w] = tuple(places[f] for f in features(w) if f in places)
                        ids += got
                    held[tuple(sorted(ids))] += 1
                plain.append(held.pop((), 0))
                bags.append([{"ids": list(k), "n": n} for k, n in held.items()])
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(plain, pa.int64()), pa.array(bags, pa.list_(pa.struct([("ids", pa.list_(pa.int32())), ("n", pa.int64())])))], names=["y", "plain", "bag"])

    return labelled.select("text", "y").mapInArrow(run, "y int, plain bigint, bag array<struct<ids:array<int>,n:bigint>>").toArrow()


def fit(bags: pa.Table, names: list[str], n_pos: int, n_neg: int) -> ToxicModel:
    """Weights that maximise the likelihood of the labels through the noisy-or, by gradient steps (Adam) with a ridge."""
    y = bags.column("y").to_numpy().astype(np.int64)
    if not names or not len(y) or y.all() or not y.any():
        rate = (n_pos + 0.5) / (n_pos + n_neg + 1)
        return ToxicModel(leak=float(np.log(rate / (1 - rate))))
    plain = bags.column("plain").to_numpy().astype(np.float64)
    bag = bags.column("bag").combine_chunks()
    doc = np.repeat(np.arange(len(y)), np.diff(bag.offsets.to_numpy()))
    cells = bag.flatten()
    times, ids = cells.field("n").to_numpy().astype(np.float64), cells.field("ids")
    of = np.repeat(np.arange(len(doc)), np.diff(ids.offsets.to_numpy()))
    ids = ids.flatten().to_numpy()
    weight = np.where(y == 1, n_pos / max(1, (y == 1).sum()), n_neg / max(1, (y == 0).sum()))
    weight = weight * len(y) / weight.sum()
    x = np.concatenate([np.zeros(len(names)), [-5.0, -4.0]])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, _STEPS + 1):
        w, bias, leak = x[:-2], x[-2], x[-1]
        z = bias + np.bincount(of, w[ids], len(doc))
        spared = -np.bincount(doc, times * np.logaddexp(0, z), len(y)) - plain * np.logaddexp(0, bias) - np.logaddexp(0, leak)
        q = np.exp(np.minimum(spared, -1e-9))
        pull = weight * np.where(y == 1, -q / (1 - q), 1.0)  # of the loss, against each unit of noisy-or
        g = pull[doc] * times * _sigmoid(z)
        slope = np.concatenate([np.bincount(ids, g[of], len(names)) + _RIDGE * w, [g.sum() + (pull * plain).sum() * _sigmoid(bias), pull.sum() * _sigmoid(leak)]])
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        x = x - _RATE * min(1.0, 2 * (1 - step / (_STEPS + 1))) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return ToxicModel({f: float(w) for f, w in zip(names, x[:-2], strict=True)}, float(x[-2]), float(x[-1]))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE) -> ToxicModel:
    """A model from the documents that have a label; of an id's labels the greatest counts, above 0 is toxic."""
    ship_code(docs.sparkSession)
    known = labels.select(F.col(doc_id).alias("id"), F.col(toxic).alias("y")).where("id is not null and y is not null").groupBy("id").agg((F.max("y") > 0).cast("int").alias("y"))
    labelled = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(within(known), "id").withColumn("h", F.xxhash64("id"))
    counts = Scratch(docs.sparkSession).save(_spread(labelled), "features")
    names, n_pos, n_neg = choose(counts)
    ends = known.withColumn("h", F.xxhash64("id"))
    last = {y: ends.where(F.col("y") == y).orderBy("h").limit(sample).agg(F.max("h")).first()[0] for y in (0, 1)}
    some = labelled.where(F.when(F.col("y") == 1, F.col("h") <= F.lit(last[1]).cast("bigint")).otherwise(F.col("h") <= F.lit(last[0]).cast("bigint")))
    return fit(_bags(some, names), names, n_pos, n_neg)


def score(docs: DataFrame, model: ToxicModel, text: str, keep: list[Column], threshold: float = THRESHOLD) -> DataFrame:
    """row (the kept columns), score and offending: (start, end, score) of sentences from the threshold on, in code points."""
    ship_code(docs.sparkSession)
    some = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("text"))
    kind = some.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            scores, found = [], []
            for t in batch.column("text"):
                value = t.as_py()
                at, z = model.logits(value)
                scores.append(model.combine(z))
                own = _sigmoid(z)
                found.append([{"start": at[k], "end": _SENTENCE.match(value, at[k]).end(), "score": float(own[k])} for k in np.flatnonzero(own >= threshold)])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64()), pa.array(found, spans)], names=["row", "score", "offending"])

    return some.mapInArrow(run, f"row {kind}, score double, offending array<struct<start:bigint,end:bigint,score:double>>")


def detect(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, offending for every row of docs.

    Learns from labelled rows that aren't held out. A null or blank text has no sentence and gets the
    leak; so do all texts if there is nothing to learn from (no labels, or of one kind only, or
    no feature that tells). A null id is never labelled and not held out. Long texts are read
    whole, a sentence at a time. Repeated rows are scored each; rows whose id repeats share its
    label. Of features that tie the first in order is chosen, and of hashes that tie at the end
    of the sample all. An empty table gives no rows; other columns are ignored.
    """
    out = held_out(F.col(doc_id))
    model = train(docs.where(~out), labels, doc_id, text, toxic, sample)
    keep = [F.col(doc_id).alias("doc_id"), out.alias("held_out")]
    found = score(docs, model, text, keep)
    return found.select("row.*", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")
