"""Mixing sources to target weights by the cube method.

Every document of a source is due the same multiplicity r = target / source size, at most 3. It is
taken floor(r) times, and once more with an inclusion probability of the rest. The cube method fixes
that last part: the flight phase moves the vector of probabilities along the null space of the
balancing constraints (tokens and documents of the source), which keeps both totals, until fewer
documents than constraints + 1 are undecided; those are the landing.

Scale. Flights run in buckets of a source (BUCKET documents each, so a source with a third of all rows is
many tasks); what each bucket leaves undecided, two documents at most, flies again in the next level's
buckets, until each source has one bucket left, whose last two documents are landed by the rounding
that is nearest in tokens (of FLIGHTS flights the one that lands nearest is taken). Targets come from one row per source.

Cases: null text has size 0 and may be taken like any other; null source is a source of its own, after
all others; ties in size are told apart by doc_id; repeated rows share a size and are interchangeable;
an empty table gives an empty result; a corpus without words has targets of 0; of very long texts only the
size goes on; extra columns, whatever their names, aren't read by the mix and are kept by ``take``. The same
input gives the same mix: random numbers come from a hash of the bucket. Rows of one doc_id (or of null) and one size can't
be told apart and fly in one bucket, a row of five numbers each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, narrow, text_of

WEIGHTS = (1, 2, 3)
CAP = 3.0
BUCKET = 1000
EPS = 1e-9
FLIGHTS = 64


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """sizes(source, source_size, ...) one row per source -> target added.

    Sources by code point, null last, take the weights in turn. The level at which the shares of
    all sources that aren't at their cap use up the total is found from the sorted caps: source k is at
    its cap if cap_k / weight_k is at most that level.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * cap).withColumn("bar", F.col("most") / F.col("w"))
    everyone = Window.partitionBy(F.lit(1))
    below = Window.orderBy("bar", "w", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("total", F.sum("source_size").over(everyone)).withColumn("all_w", F.sum("w").over(everyone))
    t = t.withColumn("used", F.coalesce(F.sum("most").over(below), F.lit(0.0))).withColumn("out_w", F.coalesce(F.sum("w").over(below), F.lit(0.0)))
    t = t.withColumn("level", (F.col("total") - F.col("used")) / (F.col("all_w") - F.col("out_w")))
    # the first source in this order whose bar is above the level that holds if all before it are capped
    t = t.withColumn("found", F.min(F.when(F.col("bar") > F.col("level"), F.struct("bar", "level"))).over(everyone))
    level = F.col("found")["level"]
    capped = F.col("found").isNull() | (F.col("bar") < F.col("found")["bar"])
    return t.withColumn("target", F.when(capped, F.col("most")).otherwise(F.least(F.col("w") * level, F.col("most")))).select(*sizes.columns, "target")


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves p within [0, 1] until at most two entries are undecided; sum(p) and sum(p * size) stay.

    Three undecided documents always leave one direction that changes neither total: the cross
    product of (1, 1, 1) and their sizes; documents of equal size trade places in pairs.
    """
    p = p.copy()
    waiting = [k for k in range(len(p) - 1, -1, -1) if EPS < p[k] < 1 - EPS]
    hand: list[int] = []
    while True:
        while len(hand) < 3 and waiting:
            hand.append(waiting.pop())
        if len(hand) < 3 and not (len(hand) == 2 and size[hand[0]] == size[hand[1]]):
            break
        if len(hand) == 3:
            a, b, c = (size[k] for k in hand)
            move = (b - c, c - a, a - b) if len({a, b, c}) > 1 else (1.0, -1.0, 0.0)
        else:
            move = (1.0, -1.0)
        up = min((1 - p[k]) / m if m > 0 else p[k] / -m for k, m in zip(hand, move, strict=True) if m)
        down = min(p[k] / m if m > 0 else (1 - p[k]) / -m for k, m in zip(hand, move, strict=True) if m)
        step = up if rng.random() * (up + down) < down else -down
        for k, m in zip(hand, move, strict=True):
            p[k] = min(1.0, max(0.0, p[k] + step * m))
            if p[k] < EPS:
                p[k] = 0.0
            elif p[k] > 1 - EPS:
                p[k] = 1.0
        hand = [k for k in hand if 0 < p[k] < 1]
    return p


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rounds the last undecided documents: of all roundings the nearest in tokens, then in documents."""
    left = np.nonzero((p > 0) & (p < 1))[0]
    p = p.copy()
    best = None
    for bits in range(1 << len(left)):
        x = np.array([bits >> k & 1 for k in range(len(left))], float)
        off = (abs(float(((x - p[left]) * size[left]).sum())), abs(float((x - p[left]).sum())), bits)
        if best is None or off < best[0]:
            best = (off, x)
    p[left] = best[1]
    return p


def _fly(last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ident", "size"], kind="stable")
        rng = np.random.default_rng([int(key[0]) & 0xFFFFFFFFFFFFFFFF, int(key[1]), len(rows)])
        p, size = rows["p"].to_numpy(float), rows["size"].to_numpy(float)
        if not last:
            return rows.assign(p=flight(p, size, rng))
        # of several flights the one whose landing is nearest in tokens
        due, landed = float(p @ size), []
        for _ in range(FLIGHTS):
            turn = rng.permutation(len(p))
            x = np.empty(len(p))
            x[turn] = landing(flight(p[turn], size[turn], rng), size[turn])
            landed.append(x)
        return rows.assign(p=min(landed, key=lambda x: abs(float(x @ size) - due)))

    return run


STATE = "doc_id string, ident long, source_key long, size long, p double"


def decide(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """rows(doc_id as string, ident, source_key, size, p) -> the same with p of 0 or 1."""
    done = None
    while True:
        rows = cut(rows)
        counted = rows.groupBy("source_key").agg(F.count(F.lit(1)).alias("members"))
        most = counted.agg(F.max("members")).first()[0] or 0
        last = most <= bucket
        # buckets of a source in proportion to its documents; ident spreads them
        spread = F.lit(0).cast("long") if last else F.pmod(F.xxhash64("ident", "size"), F.greatest(F.lit(1), F.ceil(F.col("members") / bucket)))
        dealt = rows.join(narrow(counted), "source_key").withColumn("bucket", spread).drop("members")
        out = dealt.groupBy("source_key", "bucket").applyInPandas(_fly(last), STATE + ", bucket long").drop("bucket")
        if last:
            return out if done is None else done.unionByName(out)
        out = cut(out)
        settled = out.filter("p = 0 or p = 1")
        done = settled if done is None else done.unionByName(settled)
        rows = out.filter("p > 0 and p < 1")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, bucket: int = BUCKET) -> DataFrame:
    """doc_id, size, source_size, target, times (how often the document is taken), ident (hash of the text), source."""
    size = F.regexp_count(text_of(docs), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")))
    per = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(cap))).otherwise(0.0)
    per = cut(per.withColumn("rate", rate).withColumn("source_key", F.xxhash64(F.col("source").isNull(), F.coalesce("source", F.lit("")))))
    keyed = sized.withColumn("source_key", F.xxhash64(F.col("source").isNull(), F.coalesce("source", F.lit(""))))
    known = keyed.join(narrow(per.drop("source")), "source_key")
    fresh = known.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("doc_id").alias("ident"), "source_key", "size", (F.col("rate") - F.floor("rate")).alias("p"))
    decided = decide(fresh, bucket).select("doc_id", "source_key", "size", F.round("p").cast("long").alias("more"))
    return decided.join(narrow(per), "source_key").select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", "size", "source_size", "target", (F.floor("rate").cast("long") + F.col("more")).alias("times")
    )


def op9(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def take(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns.

    Repeated rows of a document are taken as often as their rows together are.
    """
    name, turn, n = "__mix_times", "__mix_turn", "__mix_rows"
    per_doc = cut(mix(docs, **settings).groupBy(F.col("doc_id").alias("__mix_id")).agg(F.sum("times").alias(name), F.count(F.lit(1)).alias(n)))
    joined = docs.join(per_doc.filter(F.col(name) > 0), docs["doc_id"].eqNullSafe(per_doc["__mix_id"]))
    times = F.col(name)
    if not per_doc.filter(F.col(n) > 1).isEmpty():  # rows of one doc_id share what they are due
        share = F.floor(F.col(name) / F.col(n))
        joined = joined.withColumn("__mix_nr", F.row_number().over(Window.partitionBy("__mix_id").orderBy(F.xxhash64("text", "source"))))
        times = share + F.when(F.col("__mix_nr") <= F.col(name) - share * F.col(n), 1).otherwise(0)
    taken = joined.withColumn(turn, times.cast("long")).filter(F.col(turn) > 0)
    return taken.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(turn)))).select(*docs.columns)
