"""Language identification with interpolated Kneser-Ney character models.

Symbols are the letters as they are, lower-cased, and one boundary for every run of other
characters; no alphabet is fixed. 5-grams of all training texts are counted by Spark, and the lower
orders' continuation counts, discounts, probabilities and backoff weights are aggregations of
those. A model keeps, for each order, the sorted hashes of its n-grams beside their discounted
probabilities, and of its contexts beside their backoff weights; that is all a task needs. A task
finds the distinct 5-grams of many texts at once, looks each up in the sorted arrays of every
language, and sums up texts from those. A text gets the language of lowest cross-entropy per
symbol, a posterior, and is rejected where its entropy is beyond nearly all texts of that
language; both are calibrated on training rows that the models have not counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from sessionlake.llm.common import Scratch, ship_code

ORDER = 5
#: The models' size: languages at most (those with most training texts), and n-grams of an order in all of them together.
LANGUAGES, ENTRIES = 256, 1 << 20
#: Texts are scored in pieces of at most so many characters, each from a fresh context.
PIECE = 1_000_000
#: Characters that are looked up at a time.
_GROUP = 2_000_000
SHARPNESS = (0.5, 1, 2, 5, 10, 20, 50, 100)
REJECT_AT = 0.999
_OTHER = re.compile(r"[\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PAD = " " * (ORDER - 1)


def symbols(text: str) -> str:
    """Lower-cased letters, and a blank for every run of other characters."""
    return _OTHER.sub(" ", text.lower())


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, begin): of texts of symbols one after another, each after its padding, and where each one's padding starts."""
    begin = np.concatenate([[0], np.cumsum([len(t) + len(_PAD) for t in texts])]).astype(np.int64)
    joined = "".join(_PAD + t for t in texts)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), begin


def rolled(codes: np.ndarray) -> np.ndarray:
    """The hash of the last ORDER code points at every place; windows that begin before the first are short."""
    out, own = np.zeros(len(codes), np.uint64), codes.astype(np.uint64) + np.uint64(1)
    for _ in range(ORDER):
        out[1:] = out[:-1].copy()
        out[:1] = 0
        out = out * _BASE + own
    return out


def hashed(window: np.ndarray) -> np.ndarray:
    """The hash of each row of code points, the same as rolled() has for it."""
    out = np.zeros(len(window), np.uint64)
    for j in range(window.shape[1]):
        out = out * _BASE + (window[:, j].astype(np.uint64) + np.uint64(1))
    return out


def hashes_of(grams: list[str], k: int) -> np.ndarray:
    """The same of strings of k symbols."""
    return hashed(np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(grams), k))


@dataclass
class SortedHashes:
    """Values by n-gram, as a sorted array of hashes beside an array of values."""

    hashes: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, h: np.ndarray, values: np.ndarray) -> SortedHashes:
        order = np.argsort(h)
        return cls(h[order], values[order].astype(np.float64))

    def get(self, h: np.ndarray, default: float) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(h), default)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.values[at], default)


@dataclass
class KneserNey:
    """Interpolated Kneser-Ney: probabilities by n-gram and backoff weights by context, from the highest order down; base is what an unseen symbol gets."""

    probs: list[SortedHashes] = field(default_factory=list)
    backoffs: list[SortedHashes] = field(default_factory=list)
    base: float = 1.0

    def prob(self, window: np.ndarray) -> np.ndarray:
        """Of the last symbol of each row of ORDER code points, after those before it."""
        out, weight = np.zeros(len(window)), np.ones(len(window))
        for k, p, b in zip(range(ORDER, 0, -1), self.probs, self.backoffs, strict=True):
            out += weight * p.get(hashed(window[:, ORDER - k :]), 0.0)
            weight = weight * b.get(hashed(window[:, ORDER - k : -1]), 1.0)
        return out + weight * self.base


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, str]]:
    for k, t in enumerate(texts):
        for lo in range(0, max(len(t or ""), 1), PIECE):
            yield k, (t or "")[lo : lo + PIECE]


def _groups(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """(which texts, symbols of their pieces), so many characters at a time."""
    at, some, size = [], [], 0
    for k, t in _pieces(texts):
        at.append(k)
        some.append(symbols(t))
        size += len(t)
        if size >= _GROUP:
            yield at, some
            at, some, size = [], [], 0
    if at:
        yield at, some


def _distinct(codes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, window, upto): the number of each symbol's 5-gram, the code points of each number, and how many symbols are before each text."""
    real = np.ones(len(codes), bool)
    for k in range(len(_PAD)):
        real[begin[:-1] + k] = False
    places = np.flatnonzero(real)
    number, _ = pd.factorize(rolled(codes)[places])
    first = np.zeros(number.max() + 1 if len(number) else 0, np.int64)
    first[number[::-1]] = places[::-1]
    window = np.stack([codes[first - k] for k in range(ORDER - 1, -1, -1)], axis=1)
    return number, window, np.searchsorted(places, begin)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text mod 4 is 2; a null id counts as the empty text."""
    return _part(doc_id) == 2


def _part(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): how often the texts of each language, of (lang, text), have each 5-gram of symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[str]] = {}
            for name, t in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                by.setdefault(name, []).append(t.as_py())
            for name, texts in by.items():
                for _, some in _groups(texts):
                    codes, begin = points(some)
                    number, window, _ = _distinct(codes, begin)
                    if len(window):
                        grams = np.ascontiguousarray(window).view(f"<U{ORDER}").ravel().tolist()
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(np.bincount(number, minlength=len(window)), pa.int64())], names=["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def all_orders(counts: DataFrame) -> DataFrame:
    """(lang, k, gram, n) of every order: counts of the highest, and of a lower one how many n-grams of the next end in each."""
    top = F.transform(F.sequence(F.lit(1), F.lit(ORDER - 1)), lambda k: F.struct(k.alias("k"), F.substring("gram", F.lit(ORDER) - k, k + 1).alias("longer")))
    longer = counts.select("lang", F.explode(top).alias("s")).select("lang", "s.*").distinct()
    lower = longer.groupBy("lang", "k", F.expr("substring(longer, 2)").alias("gram")).agg(F.count("*").alias("n"))
    return counts.select("lang", F.lit(ORDER).alias("k"), "gram", "n").unionByName(lower)


def smoothed(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(probabilities, backoffs): (lang, k, gram, n, value) each, the latter by context."""
    n1, n2 = (F.count(F.when(F.col("n") == c, True)) for c in (1, 2))
    off = counts.groupBy("lang", "k").agg(F.when((n1 > 0) & (n2 > 0), n1 / (n1 + 2 * n2)).otherwise(F.lit(0.5)).alias("d"))
    seen = counts.withColumn("context", F.expr("substring(gram, 1, k - 1)")).join(F.broadcast(off), ["lang", "k"])  # a row for each language and order
    totals = seen.groupBy("lang", "k", "context").agg(F.sum("n").alias("total"), (F.first("d") * F.count("*")).alias("left"))
    probs = seen.join(totals, ["lang", "k", "context"]).select("lang", "k", "gram", "n", ((F.col("n") - F.col("d")) / F.col("total")).alias("value"))
    return probs, totals.select("lang", "k", F.col("context").alias("gram"), F.col("total").alias("n"), (F.col("left") / F.col("total")).alias("value"))


def train(docs: DataFrame, lang: str = "lang", text: str = "text", languages: int = LANGUAGES, entries: int = ENTRIES) -> dict[str, KneserNey]:
    """A model for each non-null language of docs, from all its texts; of each order the most frequent n-grams, entries of all languages together."""
    usable = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    names = sorted(r["lang"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect())
    if not names:
        return {}
    scratch, each = Scratch(docs.sparkSession), max(1, entries // len(names))
    counts = scratch.save(all_orders(scratch.save(count_grams(usable.where(F.col("lang").isin(names))), "grams")), "orders")
    n_symbols = counts.where("k = 1").select("gram").distinct().count()
    models = {n: KneserNey(base=1 / (n_symbols + 1)) for n in names}
    most = F.row_number().over(Window.partitionBy("lang", "k").orderBy(F.desc("n"), "gram"))
    for rows, to, less in zip(smoothed(counts), ("probs", "backoffs"), (0, 1), strict=True):
        held = rows.withColumn("rn", most).where(F.col("rn") <= each).select("lang", "k", "gram", "value").toArrow()
        groups = held.select(["lang", "k"]).to_pandas().groupby(["lang", "k"]).indices
        grams, values = np.array(held.column("gram").to_pylist(), object), held.column("value").to_numpy()
        for name, model in models.items():
            for k in range(ORDER, 0, -1):
                mine = groups.get((name, k), np.zeros(0, np.int64))
                getattr(model, to).append(SortedHashes.of(hashes_of(grams[mine].tolist(), k - less), values[mine]))
    return models


def entropies(docs: DataFrame, models: dict[str, KneserNey], text: str, keep: list[Column]) -> DataFrame:
    """The kept columns, n_letters and h: cross-entropy per symbol by language (sorted names)."""
    some = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("text"))
    sent, names = docs.sparkSession.sparkContext.broadcast(models), sorted(models)
    kind = some.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            bits, n, letters = np.zeros((len(texts), len(names))), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for at, pieces in _groups(texts):
                codes, begin = points(pieces)
                number, window, upto = _distinct(codes, begin)
                np.add.at(letters, at, [len(p) - p.count(" ") for p in pieces])
                np.add.at(n, at, np.diff(upto))
                for k, name in enumerate(names):
                    cost = -np.log2(sent.value[name].prob(window))
                    part = np.concatenate([[0.0], np.cumsum(cost[number])])
                    np.add.at(bits[:, k], at, np.diff(part[upto]))
            h = bits / np.maximum(n, 1)[:, None]
            offsets = np.arange(0, h.size + 1, max(len(names), 1)) if names else np.zeros(len(texts) + 1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(letters), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h.ravel()))], names=["row", "n_letters", "h"])

    return some.mapInArrow(run, f"row {kind}, n_letters bigint, h array<double>")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted, h_best for every row.

    Learns from rows that aren't held out and have text and language; a third of those calibrates the
    posterior and the limits, and is not counted by the models (if the rest has no text, all are counted, and if
    the third has none, all calibrate). Null texts, texts
    without a letter, and all texts if nothing was learned, are ``und`` with score 0. Long
    texts are scored whole, in pieces; of languages that tie the first by name counts. Rows
    that repeat are counted and returned as often as they come; an empty table gives no rows;
    other columns are ignored.
    """
    ship_code(docs.sparkSession)
    out, tuning = held_out(F.col(doc_id)), _part(F.col(doc_id)) == 3
    models = train(docs.where(~out & ~tuning), lang, text) or train(docs.where(~out), lang, text)
    names = sorted(models)
    keep = [F.col(doc_id).alias("doc_id"), out.alias("held_out"), tuning.alias("tuning"), F.col(lang).cast("string").alias("lang")]
    table = Scratch(docs.sparkSession).save(entropies(docs, models, text, keep), "entropies").select("row.*", "n_letters", "h")
    if not names:
        return table.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"), F.lit(None).cast("double").alias("h_best"))
    best = F.array_min("h")
    table = table.withColumn("h_best", best).withColumn("k", F.array_position("h", best).cast("int"))
    table = table.withColumn("best", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("k")))

    def posterior(of: Column, sharp: float) -> Column:
        return 1 / F.aggregate("h", F.lit(0.0), lambda a, x: a + F.exp(F.least(F.lit(500.0), sharp * (of - x))))

    known = table.where(~F.col("held_out") & (F.col("n_letters") > 0) & F.col("lang").isin(*names))
    kept_back = known.where("tuning")
    known = known if kept_back.isEmpty() else kept_back
    true = F.get("h", F.array_position(F.array(*[F.lit(n) for n in names]), F.col("lang")).cast("int") - 1)
    fits = known.agg(*[F.avg(F.log(F.greatest(posterior(true, s), F.lit(1e-12)))).alias(f"s{k}") for k, s in enumerate(SHARPNESS)]).first()
    sharp = SHARPNESS[max(range(len(SHARPNESS)), key=lambda k: (fits[k] is not None, fits[k] or 0.0))]
    limits = known.where(F.col("lang") == F.col("best")).groupBy("best").agg(F.percentile_approx("h_best", REJECT_AT, 10000).alias("limit"))
    limit = F.lit(None).cast("double")
    for r in limits.collect():  # one row for each language
        limit = F.when(F.col("best") == r["best"], F.lit(float(r["limit"]))).otherwise(limit)
    blank = F.col("n_letters") == 0
    return table.select(
        "doc_id", "held_out", F.when(blank, F.lit("und")).otherwise(F.col("best")).alias("lang_pred"),
        F.when(blank, F.lit(0.0)).otherwise(posterior(F.col("h_best"), sharp)).alias("score"), (~blank & F.coalesce(F.col("h_best") <= limit, F.lit(False))).alias("accepted"), F.when(~blank, F.col("h_best")).alias("h_best"),
    )
