"""Quality rules: lines that many documents of one host share are removed, and documents depleted by that are rejected.

A document's host is its source (null is a host of its own). Lines are split at \\n and compared without case of A-Z, with all
digits alike and white space as single spaces, by a 128-bit hash. A line counts for a host in how many different texts it
occurs (copies of a text count once, so that a copied document isn't taken for boilerplate). It is removed from all documents of the host if
that number is over ``min_docs`` and over ``share`` of the host's texts. A document that keeps less than ``least_kept`` of its words is
depleted.

The base rules (word characters, symbols, repeated lines, repeated five-word windows) need one document alone. Lines and figures come
from one pass over the texts, which is cut off in the shared folder. Counting folds equal lines in the map tasks, first by
text, then by line; a line that a third of all documents have is a few rows a task. Lines to remove are broadcast
if they are few (counted first), else joined by line and salt.

Cases: null text counts as empty and fails by its number of words; so do texts without words; lines without words don't count;
repeated rows and ties in the limits (exactly ``min_docs``, exactly ``share``) give equal verdicts, and lines at the limit stay; very long
texts are read whole; extra columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import by_bytes
from .common import BATCH_BYTES, cut, narrow, text_of

MIN_DOCS = 10
SHARE = 0.002
LEAST_KEPT = 0.5
WINDOW = 5
SALTS = 16
SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
#: Of bytes: A-Z lower-cased, digits to 0.
ALIKE = bytes(b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated(words: list[bytes], window: int = WINDOW) -> int:
    """Number of words in windows that are found twice or more.

    Windows are grouped exactly: numbers of windows of k words and of the last k words give those of more words.
    """
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[bytes, int] = {}
    first = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) == n:
        return 0
    group, size = first, 1
    while size < window:
        step = min(size, window - size)
        both = group[:-step] * (int(group.max()) + 1) + group[step:]
        _, group, counts = np.unique(both, return_inverse=True, return_counts=True)
        if counts.max() == 1:
            return 0
        size += step
    starts = np.flatnonzero(counts[group] > 1)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:n]))


def figures(raw: bytes) -> list[int]:
    words = raw.split()
    seen, again = set(), 0
    for line in raw.split(b"\n"):
        if line.strip():
            again += line in seen
            seen.add(line)
    points = len(raw.translate(None, SPACE).decode("utf-8", "replace"))
    return [len(words), points, len(raw) - len(raw.translate(None, SYMBOLS)), again, repeated(words)]


def line_sizes(raw: bytes, host: bytes) -> dict[bytes, int]:
    """Hash of each normalised line of a host -> number of words of the text in such lines."""
    sizes: dict[bytes, int] = {}
    for line in raw.translate(ALIKE).split(b"\n"):
        if words := line.split():
            key = xxhash.xxh3_128_digest(host + b"\n" + b" ".join(words))
            sizes[key] = sizes.get(key, 0) + len(words)
    return sizes


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, host, ident (of host and text), the figures and lines (hash, words), a row for each document."""
    host = docs["source"].cast("string")
    given = docs.select(docs["doc_id"], F.coalesce(F.concat(F.lit("="), host), F.lit("")).alias("host"), text_of(docs).alias("text"))
    lines = "array<struct<line: binary, words: long>>"
    out = given.sparkSession.createDataFrame([], f"doc_id {dict(given.dtypes)['doc_id']}, host string, ident binary, {', '.join(f'{f} long' for f in FIGURES)}, lines {lines}").schema
    kind = pa.list_(pa.struct([("line", pa.binary()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, stop in by_bytes(batch.column("text"), BATCH_BYTES):
                part = batch.slice(at, stop - at)
                idents, numbers, found = [], [], []
                for text, of in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("host").to_pylist(), strict=True):
                    of = of.encode()
                    idents.append(hashlib.blake2b(b"%d:" % len(of) + of + text, digest_size=16).digest())
                    numbers.append(figures(text))
                    found.append([{"line": k, "words": w} for k, w in line_sizes(text, of).items()])
                columns = [pa.array([r[k] for r in numbers], pa.int64()) for k in range(len(FIGURES))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("host"), pa.array(idents, pa.binary()), *columns, pa.array(found, kind)], names=out.fieldNames())

    return given.mapInArrow(run, out)


def boilerplate(texts: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """measured() -> line, n_texts: the lines to remove."""
    per_host = texts.select("host", "ident").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of_host"))
    lines = texts.select("host", "ident", F.explode("lines.line").alias("line")).distinct()
    counted = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_texts")).filter(F.col("n_texts") > min_docs)
    return counted.join(narrow(per_host), "host").filter(F.col("n_texts") > F.col("of_host") * F.lit(share)).select("line", "n_texts")


def depleted(texts: DataFrame, remove: DataFrame, least_kept: float = LEAST_KEPT, few: int = 50_000) -> DataFrame:
    """ident, n_removed: the texts that keep too few of their words."""
    lines = texts.select("ident", "n_words", F.explode("lines").alias("at")).select("ident", "n_words", "at.line", "at.words").distinct()
    if remove.limit(few + 1).count() <= few:
        hit = lines.join(F.broadcast(remove.select("line")), "line")
    else:
        salted = remove.select("line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        hit = lines.withColumn("salt", F.pmod(F.xxhash64("ident"), F.lit(SALTS)).cast("int")).join(salted, ["line", "salt"])
    lost = hit.groupBy("ident", "n_words").agg(F.sum("words").alias("n_removed"))
    return lost.filter(F.col("n_words") - F.col("n_removed") < F.col("n_words") * F.lit(least_kept)).select("ident", "n_removed")


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, least_kept: float = LEAST_KEPT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    texts = cut(measured(docs))
    poor = depleted(texts, cut(boilerplate(texts, min_docs, share)), least_kept)
    n, again = F.col("n_words"), F.col("n_repeat_words")
    rows = texts.drop("lines", "host").withColumn("base_failed", (n < 10) | (100 * again > 20 * n))
    return rows.join(poor, "ident", "left").select("doc_id", *FIGURES, "base_failed", (~F.col("base_failed") & F.col("n_removed").isNull()).alias("kept"))


def op11(docs: DataFrame) -> DataFrame:
    return judge(docs)


ORACLE = rf"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM rows),
windows AS (SELECT r, i, w[i : i + 4] AS five FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM words)),
doubled AS (SELECT r, i FROM windows SEMI JOIN (SELECT r, five FROM windows GROUP BY ALL HAVING count(*) > 1) USING (r, five)),
again AS (SELECT r, count(DISTINCT i + k) AS n FROM doubled, range(0, 5) AS t(k) GROUP BY r),
raw AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM rows),
full_lines AS (SELECT r, line FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY r),
alike AS (SELECT r, trim(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM full_lines),
sized AS (SELECT coalesce('=' || source, '') AS host, text, r, line, len(string_split(line, ' ')) AS n FROM alike JOIN rows USING (r)),
hosts AS (SELECT coalesce('=' || source, '') AS host, count(DISTINCT text) AS of_host FROM rows GROUP BY 1),
frequent AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT text) AS n FROM sized GROUP BY ALL) JOIN hosts USING (host) WHERE n > {MIN_DOCS} AND n > of_host * {SHARE}::DOUBLE),
lost AS (SELECT r, sum(n) AS n FROM sized SEMI JOIN frequent USING (host, line) GROUP BY r),
judged AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0) AS n_removed
  FROM rows JOIN words USING (r) LEFT JOIN dups USING (r) LEFT JOIN again USING (r) LEFT JOIN lost USING (r))
SELECT * EXCLUDE (n_removed), n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT n_words - n_removed < n_words * {LEAST_KEPT} AS kept
FROM judged"""
