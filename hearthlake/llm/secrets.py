"""Secret scans: fixed patterns, and guess costs for values in credential contexts.

Base spans come from three patterns (``BASE``): leftmost, non-overlapping matches of each kind, of
which those that are too short are dropped. The method adds ``guess`` spans: the value after a
credential word is cut into dictionary words, dates, repeats, keyboard walks and brute-force
stretches by dynamic programming over the smallest log10 of guesses; values that cost at least
``MIN_COST`` and aren't covered by a base span are reported. Values of letters only are costed like any
other. The dictionary is ranked: the fixed ``WORDS``, which guessers try first, then every word of the corpus by
how often it occurs in all texts, with the same rank for words of the same count (``word_counts``). A word counts only where
it isn't itself the value after a credential word, and must do so in two different texts at least: a secret
that many copies of a document give away is no word. So prose after "password is" is cheap and a rare word isn't.

No dictionary is collected. The values asked for are cut into all stretches that could be a word, which are joined with the
counts; each value is costed once with its own few words, and costs are joined back to the texts that hold it.

Cases: null text counts as empty, empty texts have no spans (empty string, its SHA-256, zero counts).
Offsets are code points, end exclusive. Spans of one start sort by kind: assign, access, hex, guess.
Very long texts are scanned whole; a value of any length is costed in linear time, since segments
other than brute force have bounded length. Repeated rows give repeated results; a null doc_id is carried along;
extra columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_texts, narrow, text_of

# Kinds in their order, pattern, and the least length of the group named.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),  # runs are maximal, so the length may stand in the pattern
)
KINDS = ("assign", "access", "hex", "guess")
HINTS = ("passw", "secret", "token", "api")
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "api", "credential", "auth")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|credentials?|auth(?:[_-]?key)?)["']?(?:\x20*[:=]\x20*|\x20is\x20)["']?([!-~]{6,})""", re.I | re.A
)
MIN_COST = 10.0
WORDS = (
    "password letmein welcome monkey dragon master login admin access secret shadow sunshine princess football baseball superman "
    "batman trustno hello freedom whatever love summer winter spring autumn monday friday money coffee pepper ginger cookie "
    "flower orange purple silver golden banana apple cheese chocolate guitar music soccer hockey hunter ranger tiger eagle "
    "phoenix falcon wizard magic ninja samurai pirate killer soldier mother father sister brother angel jesus christ heaven "
    "computer internet server system network mobile phone house garden river mountain ocean island forest star moon planet "
    "test user guest root default change example sample demo temp public private token key api the and for with from that this"
).split()
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890")
MAX_SEGMENT = 24
LEET = str.maketrans("430$5178@", "aeossitba")
DATE = re.compile(r"(?:19|20)\d\d(?:[-./]?(?:0[1-9]|1[0-2])(?:[-./]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-./]?(?:0[1-9]|1[0-2])[-./]?(?:19|20)\d\d", re.A)


LEAST_WORD = 3
#: Of bytes: A-Z lower-cased, all that isn't a letter to a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32 for b in range(256))
KEPT = 300_000  # words that a task counts before it hands them on


def asked(text: str) -> list[tuple[int, str]]:
    """(start, value) of the values after credential words."""
    low = text.lower()
    if not any(h in low for h in CONTEXT_HINTS):
        return []
    found = [(m.start(1), m.group(1).rstrip("\"',;.)")) for m in CONTEXT.finditer(text)]
    return [(start, value) for start, value in found if len(value) >= 6]


def word_counts(docs: DataFrame, least: int = LEAST_WORD, longest: int = MAX_SEGMENT) -> DataFrame:
    """word, n: words (runs of ASCII letters, lower-cased) outside credential values that two different texts have.

    Every text is counted, by task first. The smallest and the largest hash of a word's texts tell whether they differ.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            words = [w for w in held if least <= len(w) <= longest]
            made = [pa.array([held[w][k] for w in words], pa.int64()) for k in range(3)]
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), *made], names=["word", "n", "low", "high"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column("text").to_pylist():
                mark = xxhash.xxh3_64_intdigest(text) - (1 << 63)
                for start, value in reversed(asked(text)):
                    text = text[:start] + " " + text[start + len(value) :]
                for word, n in Counter(text.encode("utf-8", "surrogatepass").translate(LETTERS).split()).items():
                    if (seen := held.get(word)) is None:
                        held[word] = [n, mark, mark]
                    else:
                        seen[0] += n
                        if mark < seen[1]:
                            seen[1] = mark
                        elif mark > seen[2]:
                            seen[2] = mark
                if len(held) > KEPT:
                    yield flush()
        yield flush()

    counted = docs.select(text_of(docs).alias("text")).mapInArrow(count, "word string, n long, low long, high long")
    summed = counted.groupBy("word").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return summed.filter(F.col("low") < F.col("high")).select("word", "n")


def stretches(value: str, least: int = LEAST_WORD, longest: int = MAX_SEGMENT) -> set[str]:
    """All parts of a value that could be a word, with letters for the characters that stand for them."""
    plain, found = value.lower().translate(LEET), set()
    for m in re.finditer("[a-z]+", plain):
        run = m.group()
        for at in range(len(run) - least + 1):
            found.update(run[at:stop] for stop in range(at + least, min(len(run), at + longest) + 1))
    return found


def _beside() -> set[str]:
    pairs = {a + b for row in ROWS for a, b in zip(row, row[1:], strict=False)}
    pairs |= {a + b for above, below in zip(ROWS, ROWS[1:3], strict=False) for a, b in zip(above, below, strict=False)}
    return pairs | {p[::-1] for p in pairs}


BESIDE = _beside()


FIXED = {w: k + 1 for k, w in reversed(list(enumerate(WORDS)))}


class GuessCost:
    """Least log10 of guesses over all segmentations of a value. ``ranks``: words and their ranks behind the fixed ones."""

    longest = MAX_SEGMENT

    def __init__(self, ranks: dict[str, int] | None = None):
        self.rank = (ranks or {}) | FIXED

    @staticmethod
    def _alphabet(c: str) -> int:
        return 10 if c.isdigit() else 26 if c.isalpha() else 33

    def __call__(self, value: str) -> float:
        n = len(value)
        low = value.lower()
        plain = low.translate(LEET)
        cost = [0.0] + [math.inf] * n
        dates: dict[int, list[int]] = {}
        for m in DATE.finditer(value):
            dates.setdefault(m.end(), []).append(m.start())
        walk = same = 0  # lengths of the keyboard walk and of the repeat that end here
        for end in range(1, n + 1):
            c = value[end - 1]
            walk = walk + 1 if end > 1 and low[end - 2] + low[end - 1] in BESIDE else 1
            same = same + 1 if end > 1 and value[end - 2] == c else 1
            best = cost[end - 1] + math.log10(self._alphabet(c))  # brute force, a character at a time
            for start in range(max(0, end - self.longest), end - 2):
                rank = self.rank.get(plain[start:end])
                if rank:
                    raw = value[start:end]
                    extra = (0 if raw == raw.lower() else 0.3 if raw.istitle() or raw.isupper() else 1.0) + (0.6 if low[start:end] != plain[start:end] else 0)
                    best = min(best, cost[start] + math.log10(rank + 1) + 0.5 + extra)
            for k in range(3, min(same, MAX_SEGMENT) + 1):
                best = min(best, cost[end - k] + math.log10(self._alphabet(c) * k))
            for k in range(3, min(walk, MAX_SEGMENT) + 1):
                best = min(best, cost[end - k] + math.log10(47 * 4 * k))
            for unit in range(2, 7):  # a unit that repeats costs itself once
                times = 1
                while times < 4 and end - unit * (times + 1) >= 0 and value[end - unit * (times + 1) : end - unit * times] == value[end - unit : end]:
                    times += 1
                if times > 1:
                    own = sum(math.log10(self._alphabet(x)) for x in value[end - unit : end])
                    best = min(best, cost[end - unit * times] + own + math.log10(times))
            for start in dates.get(end, ()):
                best = min(best, cost[start] + math.log10(365 * 130))
            cost[end] = best
        return cost[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns."""
    found = []
    low = text.lower()
    for number, (kind, pattern, group, least) in enumerate(BASE):
        if kind == "assign" and not any(h in low for h in HINTS) or kind == "access" and "AKIA" not in text:
            continue
        found += [(m.start(), number, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return found


def open_values(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, str]]:
    """(start, value) of those that no base span touches."""
    starts, reach = [], [0]  # base spans by start, and how far those up to each reach
    for a, _, b in sorted(base):
        starts.append(a)
        reach.append(max(reach[-1], b))
    return [(start, value) for start, value in asked(text) if reach[bisect_left(starts, start + len(value))] <= start]


def guess_spans(text: str, base: list[tuple[int, int, int]], cost: GuessCost, min_cost: float = MIN_COST) -> list[tuple[int, int, int, float]]:
    costed = [(start, 3, start + len(value), cost(value)) for start, value in open_values(text, base)]
    return [s for s in costed if s[3] >= min_cost]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, ident (of the text), n_assign, n_access, n_hex, base_sha256, base (start, kind, stop), asked (start, value)."""
    spans, values = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())])), pa.list_(pa.struct([("start", pa.int64()), ("value", pa.string())]))

    def per_batch(texts: list[str]) -> list[pa.Array]:
        counts: list[list[int]] = [[], [], []]
        idents, digests, base, more = [], [], [], []
        for text in texts:
            found = base_spans(text)
            for k in range(3):
                counts[k].append(sum(s[1] == k for s in found))
            idents.append(xxhash.xxh3_128_digest(text))
            digests.append(hashlib.sha256(joined(found).encode()).hexdigest())
            base.append([{"start": a, "kind": k, "stop": b} for a, k, b in found])
            more.append([{"start": a, "value": v} for a, v in open_values(text, found)])
        return [pa.array(idents, pa.binary()), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(base, spans), pa.array(more, values)]

    return map_texts(docs, per_batch, "ident binary, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start: long, kind: int, stop: long>>, asked array<struct<start: long, value: string>>")


def ranked_parts(values: DataFrame, counts: DataFrame) -> DataFrame:
    """values (value) -> value, parts (word, rank): their stretches that are words of the corpus. Rank: so many words occur more often, behind the fixed ones."""
    parts = values.select("value", F.explode(F.udf(lambda v: sorted(stretches(v)), "array<string>", useArrow=True)("value")).alias("word"))
    levels = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))  # a row for each count that occurs
    above = F.sum("words").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    levels = levels.select("n", (F.coalesce(above, F.lit(0)) + len(WORDS) + 1).alias("rank"))
    found = parts.join(counts, "word").join(narrow(levels), "n").groupBy("value").agg(F.collect_list(F.struct("word", "rank")).alias("parts"))
    return values.join(found, "value", "left")


def costs(parts: DataFrame, min_cost: float = MIN_COST) -> DataFrame:
    """value, cost of those that cost at least min_cost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for value, words in zip(batch.column("value").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                if (cost := GuessCost({w["word"]: w["rank"] for w in words or ()})(value)) >= min_cost:
                    kept.append((value, cost))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.string()), pa.array([k[1] for k in kept], pa.float64())], names=["value", "cost"])

    return parts.mapInArrow(run, "value string, cost double")


def scan(docs: DataFrame, counts: DataFrame | None = None, min_cost: float = MIN_COST) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess, top_cost (of guess spans, else null).

    ``counts`` (word, n) is the dictionary, that of these documents if it isn't given.
    """
    rows = cut(scanned(docs))
    some = rows.filter(F.size("asked") > 0)
    values = cut(some.select(F.explode("asked.value").alias("value")).distinct())
    if values.isEmpty():
        costed = costs(values.withColumn("parts", F.lit(None).cast("array<struct<word: string, rank: long>>")), min_cost)
    else:
        costed = cut(costs(ranked_parts(values, cut(word_counts(docs)) if counts is None else counts), min_cost))
    spots = some.select("ident", F.explode("asked").alias("at")).select("ident", "at.start", "at.value").distinct()
    span = F.struct("start", F.lit(3).alias("kind"), (F.col("start") + F.length("value")).alias("stop"))
    hits = spots.join(narrow(costed), "value").groupBy("ident").agg(F.collect_list(span).alias("more"), F.max("cost").alias("top_cost"))
    whole = rows.join(narrow(hits), "ident", "left").withColumn("more", F.coalesce("more", F.expr("cast(array() as array<struct<start: long, kind: int, stop: long>>)")))
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    text = F.array_join(F.transform(F.sort_array(F.concat("base", "more")), lambda s: F.concat_ws(":", name(s), s["start"], s["stop"])), ",")
    return whole.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), F.size("more").cast("long").alias("n_guess"), "top_cost")


def op3(docs: DataFrame) -> DataFrame:
    return scan(docs)
