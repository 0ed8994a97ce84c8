"""Spelling variants: words one edit apart, by an even-partition pigeonhole join, and the form that each word follows.

A word is cut in two segments at half its length. One edit leaves one of them whole, so it is a key under which words of
equal length and (at a shifted place) words one letter shorter are looked up. The other segment is cut in the same way, and so
on until the stretch that may hold the edit is of ``FREE`` letters or fewer, or ``DEPTH`` cuts have been made: a key is everything but that stretch,
with its place and the length. So a key's words differ in a short stretch only, and a frequent segment is no large group. A pair
is verified on its stretches, then on the whole words. Of a pair that several stretches could hold the one
with the first differing letter counts, so that each pair is found once.

Words are counted in map tasks first. Forms are followed by doubling: each step has at least ``RATIO`` times the occurrences, so there are
few.

Cases: null text has no words; a null doc_id counts as empty in the hash; ties of occurrences go to the smallest word in code points;
repeated rows count each; very long words are one word with at most 2^DEPTH keys; an empty table gives an empty result; extra columns,
whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import by_bytes
from .common import BATCH_BYTES, cut, text_of

LEAST = 7  # letters
LEAST_N = 2
RATIO = 10
FREE = 2
DEPTH = 6
LOWER = {c: c + 32 for c in range(65, 91)}


def runs_of(doc_id: str, text: str, least: int = LEAST) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a text; every 31st run of a document, by a hash, loses a letter."""
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(re.findall(f"[A-Za-zÀ-ÿ]{{{least},}}", text.translate(LOWER))).items():
        h = zlib.crc32(run.encode(), start)
        if h % 31 == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        yield run, n


def word_counts(docs: DataFrame, least: int = LEAST, least_n: int = LEAST_N) -> DataFrame:
    """word, n: all distinct words."""
    given = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("doc_id"), text_of(docs).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, stop in by_bytes(batch.column("text"), BATCH_BYTES):
                counts: Counter[str] = Counter()
                for doc_id, text in zip(batch.column("doc_id")[at:stop].to_pylist(), batch.column("text")[at:stop].to_pylist(), strict=True):
                    for word, n in runs_of(doc_id, text, least):
                        counts[word] += n
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return given.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def stretches(length: int, free: int = FREE, depth: int = DEPTH) -> list[tuple[int, int]]:
    """(start, stop) of the stretches that can hold the edit, in a word of that length."""
    done, open_ = [], [(0, length, 0)]
    while open_:
        a, b, level = open_.pop()
        if b - a <= free or level >= depth:
            done.append((a, b))
        else:
            open_ += [((a + b) // 2, b, level + 1), (a, (a + b) // 2, level + 1)]
    return done


def keyed(words: DataFrame, longer: int) -> DataFrame:
    """key, part (the stretch without it), after (the letter behind), word, n: as words ``longer`` letters longer are cut."""
    out = "key long, part string, after string, word string, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            rows: list[tuple] = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                size = len(word) + longer
                if size not in cuts:
                    cuts[size] = stretches(size)
                for a, b in cuts[size]:
                    rest = xxhash.xxh3_64_intdigest(f"{size} {a} {word[:a]} {word[b - longer :]}".encode())
                    rows.append((rest - (1 << 63), word[a : b - longer], word[b - longer : b - longer + 1], word, n))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()], strict=True)], names=["key", "part", "after", "word", "n"])

    return words.select("word", "n").mapInArrow(run, out)


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: each pair of words one edit apart, once."""
    index, same, shorter = keyed(words, 0).alias("i"), keyed(words, 0), keyed(words, 1)
    probe = same.withColumn("equal", F.lit(True)).unionByName(shorter.withColumn("equal", F.lit(False))).alias("p")
    c = F.col
    # A letter more whose stretch begins like the shorter one and whose last letter comes again behind it belongs to a later stretch.
    later = c("i.part").startswith(c("p.part")) & (F.substring(c("i.part"), -1, 1) == c("i.after")) & (c("i.after") != "")
    sided = F.when(c("p.equal"), c("i.word") < c("p.word")).otherwise(~later)
    near = (F.levenshtein("i.part", "p.part", 1) == 1) & (F.levenshtein("i.word", "p.word", 1) == 1)
    return index.join(probe, (c("i.key") == c("p.key")) & sided & near).select(c("i.word"), c("i.n"), c("p.word").alias("other"), c("p.n").alias("other_n"))


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """word, form -> word, root, following at most ``steps`` forms."""
    reach, at = 1, forms.select("word", F.col("form").alias("root"))
    while reach < steps:
        then = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = cut(at.join(then, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        reach *= 2
    return at


def variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root."""
    words = cut(word_counts(docs))
    pairs = cut(near_pairs(words))
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    form = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best"))
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form["other"].alias("form"), (-form["less"]).alias("form_n"))
    known = cut(known)
    most = known.agg(F.max("form_n")).first()[0] or 0
    steps = 1
    while ratio**steps * LEAST_N <= most:  # so many forms at most follow one another
        steps += 1
    ends = roots(known.filter(F.col("form").isNotNull()), steps)
    return known.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12(docs: DataFrame) -> DataFrame:
    return variants(docs)
