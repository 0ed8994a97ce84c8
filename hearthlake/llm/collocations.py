"""Phrase collocations from count tries of limited depth, built by shard, cut into prefix ranges and merged.

A shard is a stretch of a partition of about ``SHARD_BYTES``. Its trie holds, for one language, how often each word, pair and triple of
consecutive words within a piece occurs; nodes are kept by level in the order of their words' bytes (a word, its parent's place, a
count). The sorted trie is cut at the bounds of the prefix ranges, which are pairs of words, so that even the phrases of one
frequent word are spread, and each cut is serialised with its own dictionary and compressed. A task merges the runs of a
range, some at a time, so that it holds one merged trie and a bounded number of runs. A word whose phrases are cut by a bound has its
node in all ranges that it reaches into, so that the walk from the root to a phrase meets all left parts. Right
parts are the nodes at the end of suffix links: a triple's is the pair without its first word, whose own is the last word.

The bounds come from a sample of ``SAMPLE`` prefixes. They decide how work is dealt, never a result.

Only nodes with at least ``least`` occurrences leave the merge: the parts of a candidate are at least as frequent as it is. The
arithmetic of scores is decimal with 38 digits. The first ``top`` of each language are found per salt, then among those.

Cases: null text counts as empty, null lang as ``und``; ties in score go by occurrences, then by the phrase's bytes; ties between cuts to the
first; repeated rows count each; very long texts are read whole, a shard may then be larger; extra columns, whatever their names, are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import by_bytes, starts_of
from .common import cut, narrow, text_of

LEAST = 10
TOP = 2000
SHARE = 50  # per cent of a phrase's places inside one longer candidate
SHARD_BYTES = 24 << 20
RANGE_BYTES = 16 << 20  # of text, for each prefix range
MERGE_BYTES = 48 << 20  # of runs that are merged at once
SAMPLE = 100_000
SALTS = 64
END = b"\xff"  # no byte of UTF-8: a piece's end
#: Of bytes: A-Z lower-cased, tabs to spaces, what ends a piece to END.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 0xFF if b in b".,;:!?" or 10 <= b <= 13 else b for b in range(256))
Bound = tuple[str, bytes, bytes]


def tokens(raw: bytes) -> list[bytes]:
    """Words, and END between pieces."""
    return raw.translate(FOLD).replace(END, b" \xff ").split()


@dataclass
class Trie:
    """Nodes by level, sorted: words (dictionary), one: counts of single words; two: parent, word, count; three: likewise, the parent in two."""

    words: list[bytes]
    one: np.ndarray
    two: tuple[np.ndarray, np.ndarray, np.ndarray]
    three: tuple[np.ndarray, np.ndarray, np.ndarray]

    def dump(self) -> bytes:
        names = b" ".join(self.words)
        head = np.array([len(names), len(self.words), len(self.two[0]), len(self.three[0])], np.int64)
        steps = [np.diff(x, prepend=0) for x in (self.two[0], self.three[0])]  # parents ascend
        parts = [self.one.astype(np.int64), *(x.astype(np.int32) for x in (steps[0], self.two[1], steps[1], self.three[1])), self.two[2].astype(np.int64), self.three[2].astype(np.int64)]
        return zstandard.compress(b"".join([head.tobytes(), names, *(p.tobytes() for p in parts)]), 1)

    @staticmethod
    def load(raw: bytes) -> Trie:
        raw = zstandard.decompress(raw)
        size, n, n2, n3 = np.frombuffer(raw, np.int64, 4)
        at = 32 + int(size)

        def take(kind: type, count: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(raw, kind, count, at)
            at += x.nbytes
            return x.astype(np.int64)

        one = take(np.int64, n)
        up2, w2, up3, w3 = (take(np.int32, k) for k in (n2, n2, n3, n3))
        return Trie(raw[32 : 32 + int(size)].split(b" ") if n else [], one, (np.cumsum(up2), w2, take(np.int64, n2)), (np.cumsum(up3), w3, take(np.int64, n3)))

    @property
    def nbytes(self) -> int:
        return 60 * len(self.words) + 24 * (len(self.two[0]) + len(self.three[0]))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their sums, and each key's place among them."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(first) - 1
    at = np.flatnonzero(first)
    return ordered[at], np.add.reduceat(counts[order], at) if len(at) else counts[:0], place


def built(numbers: dict[bytes, int], ids: np.ndarray) -> Trie:
    """The trie of a sequence of words by number of first sight (-1: a piece's end)."""
    words = sorted(numbers)
    rank = np.empty(len(words) + 1, np.int64)
    rank[[numbers[w] for w in words]] = np.arange(len(words))
    rank[-1] = -1
    w, v = rank[ids], max(len(words), 1)
    at = np.flatnonzero((w[:-1] >= 0) & (w[1:] >= 0))
    keys, counts, place = summed(w[at] * v + w[at + 1], np.ones(len(at), np.int64))
    pair = np.full(len(w) + 1, -1, np.int64)
    pair[at] = place
    at = at[pair[at + 1] >= 0]  # a pair follows by one word
    keys3, counts3, _ = summed(pair[at] * v + w[at + 2], np.ones(len(at), np.int64))
    return Trie(words, np.bincount(w[w >= 0], minlength=len(words)).astype(np.int64), (keys // v, keys % v, counts), (keys3 // v, keys3 % v, counts3))


def merged(tries: list[Trie]) -> Trie:
    """Tries over their common dictionary, level by level."""
    words = sorted(set().union(*(t.words for t in tries)))
    at, v = {w: k for k, w in enumerate(words)}, max(len(words), 1)
    maps = [np.fromiter((at[w] for w in t.words), np.int64, len(t.words)) for t in tries]
    one = np.zeros(len(words), np.int64)
    for t, m in zip(tries, maps, strict=True):
        one[m] += t.one
    keys, counts, place = summed(np.concatenate([m[t.two[0]] * v + m[t.two[1]] for t, m in zip(tries, maps, strict=True)]), np.concatenate([t.two[2] for t in tries]))
    begin = starts_of(np.array([len(t.two[0]) for t in tries]))
    keys3, counts3, _ = summed(np.concatenate([place[b + t.three[0]] * v + m[t.three[1]] for b, t, m in zip(begin, tries, maps, strict=True)]), np.concatenate([t.three[2] for t in tries]))
    return Trie(words, one, (keys // v, keys % v, counts), (keys3 // v, keys3 % v, counts3))


def restricted(t: Trie, ones: np.ndarray, a: int, b: int, c: int, d: int) -> Trie:
    """The trie of pairs a..b and triples c..d with the nodes ``ones`` of words, over its own dictionary."""
    two, three = [x[a:b] for x in t.two], [x[c:d] for x in t.three]
    used = np.unique(np.concatenate([ones, two[0], two[1], three[1]]))
    counts = np.zeros(len(used), np.int64)
    counts[np.searchsorted(used, ones)] = t.one[ones]
    near = lambda x: np.searchsorted(used, x)
    return Trie([t.words[k] for k in used], counts, (near(two[0]), near(two[1]), two[2]), (three[0] - a, near(three[1]), three[2]))


def runs(t: Trie, lang: str, bounds: list[Bound]) -> Iterator[tuple[int, Trie]]:
    """(range, trie) of each prefix range; range k is from bound k - 1 up to bound k.

    A word's node goes to the range that holds the word alone and to those that begin within its phrases.
    """
    first, last = bisect_left(bounds, (lang, b"", b"")), bisect_left(bounds, (lang + "\0", b"", b""))
    v, pairs = max(len(t.words), 1), t.two[0] * max(len(t.words), 1) + t.two[1]
    cut1, cut2, inside = [0], [0], [-1]
    for _, w1, w2 in bounds[first:last]:
        r, behind = bisect_left(t.words, w1), bisect_right(t.words, w1)
        cut1.append(behind)
        cut2.append(int(np.searchsorted(pairs, r * v + (bisect_left(t.words, w2) if behind > r else 0))))
        inside.append(r if behind > r else -1)
    cut1.append(len(t.words))
    cut2.append(len(pairs))
    for k in range(len(cut1) - 1):
        ones = np.arange(cut1[k], cut1[k + 1])
        if inside[k] >= 0:
            ones = np.concatenate([[inside[k]], ones[ones != inside[k]]])
        a, b = cut2[k], cut2[k + 1]
        if len(ones) or b > a:
            c, d = np.searchsorted(t.three[0], [a, b])
            yield first + k, restricted(t, ones, a, b, int(c), int(d))


def shards(docs: DataFrame, bounds: list[Bound], shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """range, lang, run: the serialised tries of all shards, cut at the bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, dict[bytes, int]] = {}
        ids: dict[str, list[np.ndarray]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in list(ids):
                del numbers[lang][END]
                trie = built(numbers.pop(lang), np.concatenate(ids.pop(lang)))
                rows = [(k, cut_.dump()) for k, cut_ in runs(trie, lang, bounds)]
                for k in range(0, len(rows), 256):
                    some = rows[k : k + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int32()), pa.array([lang] * len(some), pa.string()), pa.array([r[1] for r in some], pa.binary())], names=["range", "lang", "run"])

        for batch in batches:
            for at, stop in by_bytes(batch.column("text"), 2 << 20):
                texts: dict[str, list[bytes]] = {}
                for lang, text in zip(batch.column("lang")[at:stop].to_pylist(), batch.column("text")[at:stop].cast(pa.binary()).to_pylist(), strict=True):
                    texts.setdefault(lang, []).append(text)
                for lang, some in texts.items():
                    raw = END.join([*some, b""])
                    known = numbers.setdefault(lang, {END: -1})
                    found = tokens(raw)
                    got = np.fromiter((known.setdefault(w, len(known) - 1) for w in found), np.int32, len(found))
                    ids.setdefault(lang, []).append(got)
                    held += len(raw)
                if held >= shard_bytes:
                    yield from flush()
                    held = 0
        yield from flush()

    return docs.mapInArrow(run, "range int, lang string, run binary")


def phrases(t: Trie, low: bytes, least: int) -> Iterator[tuple]:
    """depth, phrase, suffix, a, left1, left2, inner (largest a of a longer phrase that it begins) of a range's frequent nodes, and depth 0: all words.

    The range begins within the phrases of the word ``low``, whose own node belongs to a range before.
    """
    words, (up2, w2, n2), (up3, w3, n3) = t.words, t.two, t.three
    own = [k for k in np.flatnonzero(t.one) if words[k] > low]
    yield 0, None, None, int(t.one[own].sum()), None, None, None
    for k in own:
        if t.one[k] >= least:
            yield 1, words[k], None, int(t.one[k]), None, None, None
    inner = np.zeros(len(n2), np.int64)
    often = np.flatnonzero(n3 >= least)
    np.maximum.at(inner, up3[often], n3[often])
    for k in np.flatnonzero(n2 >= least):
        yield 2, words[up2[k]] + b" " + words[w2[k]], words[w2[k]], int(n2[k]), int(t.one[up2[k]]), None, int(inner[k])
    for k in often:
        p = up3[k]
        suffix = words[w2[p]] + b" " + words[w3[k]]
        yield 3, words[up2[p]] + b" " + suffix, suffix, int(n3[k]), int(t.one[up2[p]]), int(n2[p]), None


NODES = "lang string, depth int, phrase string, suffix string, a long, left1 long, left2 long, inner long"


def nodes(found: DataFrame, bounds: list[Bound], least: int = LEAST, merge_bytes: int = MERGE_BYTES) -> DataFrame:
    """shards() -> the frequent nodes of all languages, each once."""
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 4]
    names = [c.split()[0] for c in NODES.split(", ")]

    def closed(key: tuple[int, str], tries: list[Trie]) -> Iterator[pa.RecordBatch]:
        low = bounds[key[0] - 1][1] if key[0] and bounds[key[0] - 1][0] == key[1] else b""
        rows = [(key[1], *r) for r in phrases(merged(tries), low, least)]
        for k in range(0, len(rows), 10_000):
            columns = list(zip(*rows[k : k + 10_000], strict=True))
            text = lambda c: [x if x is None else x.decode("utf-8", "replace") for x in c]
            columns = [text(c) if n in (2, 3) else c for n, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tries, held = None, [], 0
        for batch in batches:
            for key, raw in zip(zip(batch.column("range").to_pylist(), batch.column("lang").to_pylist(), strict=True), batch.column("run").to_pylist(), strict=True):
                if key != at:
                    if tries:
                        yield from closed(at, tries)
                    at, tries, held = key, [], 0
                tries.append(Trie.load(raw))
                held += tries[-1].nbytes
                if held > merge_bytes and len(tries) > 1:
                    tries = [merged(tries)]
                    held = tries[0].nbytes // 2  # at least as much again before it is merged anew
        if tries:
            yield from closed(at, tries)

    dealt = found.repartition("range").sortWithinPartitions("range", "lang")
    return dealt.mapInArrow(run, NODES)


def bounds_of(docs: DataFrame, range_bytes: int = RANGE_BYTES, sample: int = SAMPLE) -> list[Bound]:
    """Bounds of about equal ranges: quantiles of about ``sample`` prefixes (lang, word, next word) at most, ``each`` of a document."""
    each = 32
    rows, total = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = min(total // range_bytes + 1, sample // 4)
    if n < 2:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                found = tokens(text)
                places = np.unique(np.linspace(0, max(len(found) - 2, 0), each).astype(int))
                rows += [(lang, found[k], found[k + 1]) for k in places if k + 1 < len(found) and END not in found[k : k + 2]]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], names=["lang", "one", "two"])

    some = docs.sample(min(1.0, sample / each / rows), seed=7).mapInArrow(run, "lang string, one binary, two binary")
    got = sorted((r[0], bytes(r[1]), bytes(r[2])) for r in some.collect())
    return sorted({got[len(got) * k // n] for k in range(1, n)}) if got else []


def score(a: str, left: str, right: str) -> Column:
    wide = lambda c: f"CAST({c} AS DECIMAL(16, 0))"
    return F.expr(f"CAST((CAST(1000000 AS DECIMAL(7, 0)) * {wide(a)} * CAST({a} AS DECIMAL(15, 0))) DIV ({wide(left)} * {wide(right)}) AS BIGINT)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE, range_bytes: int = RANGE_BYTES, shard_bytes: int = SHARD_BYTES, merge_bytes: int = MERGE_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    given = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), text_of(docs).alias("text"))
    bounds = bounds_of(given, range_bytes)
    found = cut(nodes(shards(given, bounds, shard_bytes), bounds, least, merge_bytes))
    of = lambda depth: found.filter(F.col("depth") == depth)
    sizes = of(0).groupBy("lang").agg(F.sum("a").alias("n"))
    ends = of(1).select("lang", F.col("phrase").alias("suffix"), F.col("a").alias("right1"))
    two = cut(of(2).join(ends, ["lang", "suffix"]).select("lang", "phrase", "a", F.col("left1").alias("l"), F.col("right1").alias("r"), "inner", score("a", "left1", "right1").alias("score")))
    link = two.select("lang", F.col("phrase").alias("suffix"), F.col("a").alias("right1"), F.col("r").alias("right2"))
    three = of(3).join(link, ["lang", "suffix"])
    cuts = [F.struct(score("a", f"left{k}", f"right{k}").alias("score"), F.lit(k).alias("k"), F.col(f"left{k}").alias("l"), F.col(f"right{k}").alias("r")) for k in (1, 2)]
    three = three.withColumn("cut", F.least(*cuts)).select("lang", "phrase", "suffix", "a", "cut.l", "cut.r", "cut.score")
    behind = three.groupBy("lang", F.col("suffix").alias("phrase")).agg(F.max("a").alias("behind"))
    whole = two.join(behind, ["lang", "phrase"], "left").filter(100 * F.greatest("inner", F.coalesce("behind", F.lit(0))) < share * F.col("a"))
    columns = ["lang", "phrase", "a", "l", "r", "score"]
    every = whole.select(*columns).unionByName(three.select(*columns)).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = every.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(narrow(sizes), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13(docs: DataFrame) -> DataFrame:
    return collocations(docs)


ORACLE = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words)),
sizes AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
one AS (SELECT lang, x, count(*) AS a FROM places GROUP BY ALL HAVING count(*) >= {LEAST}),
two AS (SELECT lang, x, y, count(*) AS a FROM places WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
three AS (SELECT lang, x, y, z, count(*) AS a FROM places WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
cuts AS (
  SELECT t.lang, x || ' ' || y AS phrase, 1 AS k, t.a, p.a AS l, s.a AS r, x || ' ' || y AS pair FROM two t JOIN one p USING (lang, x) JOIN one s ON s.lang = t.lang AND s.x = t.y
  UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, 1, t.a, p.a, s.a, NULL FROM three t JOIN one p USING (lang, x) JOIN two s ON s.lang = t.lang AND s.x = t.y AND s.y = t.z
  UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, 2, t.a, p.a, s.a, NULL FROM three t JOIN two p USING (lang, x, y) JOIN one s ON s.lang = t.lang AND s.x = t.z),
scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
candidates AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, x || ' ' || y AS pair, a FROM three UNION ALL SELECT lang, y || ' ' || z, a FROM three),
longer AS (SELECT lang, pair, max(a) AS b FROM inside GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM candidates LEFT JOIN longer USING (lang, pair) JOIN sizes USING (lang)
WHERE b IS NULL OR 100 * b < {SHARE} * a QUALIFY rank <= {TOP}"""
