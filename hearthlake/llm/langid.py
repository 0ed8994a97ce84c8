"""Language identification: words first, then ever shorter character n-grams.

Training counts words and character n-grams (orders 4 to 1, with word-edge marks) by language in Spark
over a bounded sample of labelled rows (``sample_rows`` rows and ``sample_bytes`` of text at most, rows read whole); every word, n-gram and language
of the sample is a feature, so the model is no larger than what the sample holds. Scoring adds the log frequency of each known word in every language; a word
that isn't known is covered from left to right by the longest known n-grams.

Cases: null text, empty text or text without a letter: ``und`` with score 0. Text in which nothing is
known at all takes the prior's language with the prior as its score. Ties go to the language that
sorts first. Rows with null lang or null doc_id aren't learned from. An empty training set predicts
``und`` throughout, and an empty table gives an empty result. Very long texts are read whole: words are counted
first, so that each distinct word is scored once. Repeated rows are learned from and predicted like any other;
extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

WORD = re.compile(r"[^\W\d_]+")
ORDERS = (4, 3, 2, 1)
UND = "und"


class Features:
    """Text -> log-frequency vector over the languages, from counts by language: ``floor`` where a language has none."""

    DENSE = 20_000_000  # numbers in a table; more are kept as they are counted, which gives the same vectors

    def __init__(self, texts: list[str], which: np.ndarray, langs: np.ndarray, counts: np.ndarray, n_langs: int):
        below = np.log(np.bincount(langs, counts, n_langs) + 0.5 * len(texts) + 1)
        self.at, self.floor, self.dense = {t: k for k, t in enumerate(texts)}, np.log(0.5) - below, len(texts) * n_langs <= self.DENSE
        order = np.argsort(which, kind="stable")
        which, self.langs, self.logs = which[order], langs[order], (np.log(counts + 0.5) - below[langs])[order]
        self.ends = np.searchsorted(which, np.arange(len(texts)), "right")
        if self.dense:
            self.table = np.tile(self.floor, (len(texts), 1))
            self.table[which, self.langs] = self.logs

    @classmethod
    def of(cls, rows: pa.Table, langs: list[str]) -> Features:
        """rows (word, lang, n), one for each pair."""
        code = lambda name: rows[name].combine_chunks().dictionary_encode()
        words, spoken, number = code("word"), code("lang"), {x: k for k, x in enumerate(langs)}
        of = np.array([number[x] for x in spoken.dictionary.to_pylist()] or [0])
        return cls(words.dictionary.to_pylist(), words.indices.to_numpy().astype(np.int64), of[spoken.indices.to_numpy()], rows["n"].to_numpy().astype(float), len(langs))

    @classmethod
    def again(cls, fields: dict) -> Features:
        """From the fields of another one."""
        made = cls.__new__(cls)
        vars(made).update(fields)
        return made

    def get(self, text: str) -> np.ndarray | None:
        k = self.at.get(text)
        if k is None:
            return None
        if self.dense:
            return self.table[k]
        vector, at = self.floor.copy(), slice(self.ends[k - 1] if k else 0, self.ends[k])
        vector[self.langs[at]] = self.logs[at]
        return vector

    def __contains__(self, text: str) -> bool:
        return text in self.at

    def __getitem__(self, text: str) -> np.ndarray:
        if (vector := self.get(text)) is None:
            raise KeyError(text)
        return vector

    def __iter__(self):
        return iter(self.at)

    def __len__(self) -> int:
        return len(self.at)


class Model:
    """langs, prior; words, and n-grams by order: text -> log-frequency vector."""

    def __init__(self, langs: list[str], prior: np.ndarray, words: Features, by_order: dict[int, Features]):
        self.langs, self.prior, self.words, self.by_order = langs, prior, words, by_order

    @property
    def grams(self) -> dict[str, np.ndarray]:
        return {g: f[g] for f in self.by_order.values() for g in f}

    def backoff(self, word: str) -> np.ndarray:
        """Covers ^word$ by the longest known n-grams; a character that is in none adds nothing."""
        marked, total, at = f"^{word}$", np.zeros(len(self.langs)), 0
        while at < len(marked):
            for n in ORDERS:
                vector = self.by_order[n].get(marked[at : at + n]) if n in self.by_order and at + n <= len(marked) else None
                if vector is not None:
                    total = total + vector
                    at += n
                    break
            else:
                at += 1
        return total

    def predict(self, text: str | None, seen: Rows) -> tuple[str, float]:
        counts = Counter(WORD.findall(text.lower())) if text else {}
        if not self.langs or not any(c.isalpha() for w in counts for c in w):
            return UND, 0.0
        rows = np.fromiter((seen.row(w) for w in counts), np.int64, len(counts))
        total = np.log(self.prior) + np.fromiter(counts.values(), float, len(counts)) @ seen.matrix[rows]
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())


class Rows:
    """Word vectors by number, made as words are met; they are kept as long as there is room."""

    ROOM = 200_000

    def __init__(self, model: Model):
        self.model = model
        self.matrix = np.zeros((self.ROOM // 8, len(model.langs)))
        self.more: dict[str, int] = {}

    def start(self) -> None:
        """Between texts: forget words if their room is used."""
        if len(self.more) > self.ROOM:
            self.more.clear()

    def row(self, word: str) -> int:
        k = self.more.get(word)
        if k is None:
            k = self.more[word] = len(self.more)
            if k >= len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
            vector = self.model.words.get(word)
            self.matrix[k] = self.model.backoff(word) if vector is None else vector
        return k


def sampled(labelled: DataFrame, rows: int, most_bytes: int) -> DataFrame:
    """lang, text: at most so many rows and about so many bytes, those of the smallest hash of doc_id and text; of a row that is too long for what
    is left, and of all after it, none."""
    mark = F.xxhash64("doc_id", "text")
    hashed = labelled.select("lang", F.col("text").alias("text"), mark.alias("h"), F.octet_length("text").alias("bytes"))
    n = hashed.count()
    # so that the ranking sees a few times as many rows as it takes, not that many of every task; equal hashes are equal rows
    share = 4 * rows / max(1, n)
    low = hashed.select("h", "bytes").filter(F.col("h") <= -(1 << 63) + int(share * (1 << 64))) if share < 1 else hashed.select("h", "bytes")
    counts = cut(low.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes")))
    if share < 1 and (counts.agg(F.sum("n")).first()[0] or 0) < rows:  # few different rows
        counts = cut(hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes")))
    taken, left_rows, left_bytes = [], rows, most_bytes
    for r in counts.orderBy("h").limit(rows).collect():  # at most ``rows`` hashes and sizes
        times = min(r["n"], left_rows, left_bytes // max(1, r["bytes"]))
        if not times:
            break
        taken.append((r["h"], times))
        left_rows, left_bytes = left_rows - times, left_bytes - times * r["bytes"]
    spark = labelled.sparkSession
    asked = spark.createDataFrame(taken, "h long, times long")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of equal rows the first of a task."""
        seen: set[int] = set()
        for batch in batches:
            new = [k for k, h in enumerate(batch.column("h").to_pylist()) if not (h in seen or seen.add(h))]
            if new:
                yield batch.take(pa.array(new))

    found = hashed.join(F.broadcast(asked), "h").select("h", "lang", "text", "times").mapInArrow(once, "h long, lang string, text string, times long")
    return found.dropDuplicates(["h"]).select("lang", F.lower("text").alias("text"), "times")


def train(docs: DataFrame, sample_rows: int = 4000, sample_bytes: int = 32 << 20) -> Model:
    """Fit on a sample of the labelled rows (see sampled), repeated rows as often as they are sampled.

    What reaches the driver and is broadcast are the words and n-grams of the sample, which its bytes bound.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sample = cut(sampled(labelled, sample_rows, sample_bytes))
    size = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.sum("times").alias("n")).collect()}  # a row for a language of the sample
    langs = sorted(size)
    if not langs:
        return Model([], np.zeros(0), Features([], np.zeros(0, int), np.zeros(0, int), np.zeros(0), 0), {})
    prior = np.array([size[x] for x in langs], float) / sum(size[x] for x in langs)
    words = sample.select("lang", "times", F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"))).alias("word")).groupBy("lang", "word").agg(F.sum("times").alias("n"))
    words = cut(words)
    marked = words.select("lang", F.concat(F.lit("^"), "word", F.lit("$")).alias("m"), "n")
    grams = None
    for n in ORDERS:
        spots = F.when(F.length("m") >= n, F.sequence(F.lit(1), F.length("m") - (n - 1))).otherwise(F.array().cast("array<int>"))
        one = marked.select("lang", "m", "n", F.explode(spots).alias("at")).select("lang", F.substring(F.col("m"), F.col("at"), F.lit(n)).alias("word"), "n", F.lit(n).alias("order"))
        grams = one if grams is None else grams.unionByName(one)
    grams = grams.groupBy("lang", "order", "word").agg(F.sum("n").alias("n"))

    every = grams.toArrow()
    by_order = {n: Features.of(every.filter(pc.equal(every["order"], n)), langs) for n in ORDERS}
    return Model(langs, prior, Features.of(words.toArrow(), langs), by_order)


def predictor(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A column struct<lang_pred, score> over docs; the bounded model is broadcast."""
    # as plain values: what is broadcast isn't pickled like what tasks run, and tasks need not have this package installed
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.prior, vars(model.words), {n: vars(f) for n, f in model.by_order.items()}))
    kept: list = []

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        if not kept:
            langs, prior, words, by_order = shared.value
            kept.append(Model(langs, prior, Features.again(words), {n: Features.again(f) for n, f in by_order.items()}))
            kept.append(Rows(kept[0]))
        rows = []
        for text in texts:
            kept[1].start()
            rows.append(kept[0].predict(text, kept[1]))
        return pd.DataFrame(rows, columns=["lang_pred", "score"])

    return predict(docs[text].cast("string"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op6(docs: DataFrame) -> DataFrame:
    """lang, source and doc_id are used for learning and for held_out only, never for a prediction."""
    docs = docs.select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predictor(docs, model).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def drop_unknown(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents whose language can be told, with all their columns and without a shuffle.

    Those predicted ``und``, and those of which no language is likelier than all others together (a score under
    ``least``), go.
    """
    model = train(docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"))))
    return docs.filter(predictor(docs, model)["score"] >= least) if least > 0 else docs
