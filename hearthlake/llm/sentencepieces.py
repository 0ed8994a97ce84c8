"""SentencePiece encoding and decoding over a relational lattice.

A text is normalised as the model asks (a dummy prefix, spaces to U+2581) and cut wherever no piece of the
model has the two characters side by side, which no piece and so no merge can reach over: into words, and
these from their punctuation. The lattice is made once per distinct segment: substrings of bounded length
are exploded, equi-joined to the piece table, grouped by segment and folded with higher-order functions.

The fold depends on the model. For a unigram model it is Viterbi: the state has, for each of the last
positions, the best score and path, and each edge extends them. Viterbi can't give a BPE model's
ids, because merges are greedy in rank, not optimal in sum; for BPE the fold takes the segment's
edges from the best rank down (from left to right in a rank) and merges an edge if two symbols make it
up, which is what the model's own encoder does. What no edge of two characters or more covers are single
characters; those without a piece fall back to bytes. Segments of over MAX_WORD characters, whose symbol
borders don't fit in a 64-bit mask, are folded by the same rule in Python.

Scale. A task takes the documents of its scan in groups of about GROUP_BYTES. A group asks for its distinct
segments by part, a hash range of segments, so that a part meets what the groups ask of it, makes the lattice of
its distinct segments and answers each group with ids. There is a part for PART_BYTES of corpus; beyond
RANGE_BYTES tasks are dealt into ranges with parts of their own, so that no part hears from more groups than
a range has, common as its segments may be. Neither the lattice nor the vocabulary is broadcast, as both
grow with the corpus; the piece table is bounded by the model. The answers are written to the shared folder
before the groups are made again and joined to them. A group's name holds a hash of its segments: rows must
come in an order that a rerun repeats (a scan of files); if they don't, the run fails, never mixes answers.

Cases: null text counts as empty and has no ids; white space is kept, so that decoding gives the text
back (U+2581 in a text becomes a space, as with the model's own encoder, and round_trip is false); lone
surrogates can't occur; very long texts are encoded whole and may be a group of their own; repeated rows,
ties and null doc_ids are encoded like any other row; extra columns, whatever their names, are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import buffers_of, code_points, slices, starts_of, sums, text_array, utf8_lengths
from .common import cut, text_of

MARK = "▁"
MAX_WORD = 60
GROUP_BYTES = 6 << 20
PART_BYTES = 2 << 20
RANGE_BYTES = 64 << 30
WORD = re.compile(f"{MARK}+[^{MARK}]*")
UNIGRAM, BPE = 1, 2
ID_BITS, PLACE_BITS = 24, 6  # an edge's long: rank, start, stop, id
ODD = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The piece table of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.name != "identity" or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only identity normalisation with a dummy prefix is supported")
        held = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == 6}
        if len(held) != 256 or any(held[b] != held[0] + b for b in held):
            raise ValueError("the model has no byte fallback with ids in order")
        self._set([(k, p.piece, float(p.score)) for k, p in enumerate(model.pieces) if p.type in (1, 4)], model.trainer_spec.model_type, held[0])

    @classmethod
    def of(cls, rows: list[tuple[int, str, float]], kind: int, first_byte: int) -> Pieces:
        """From rows (id, piece, score) and the id of byte 0."""
        made = cls.__new__(cls)
        made._set(rows, kind, first_byte)
        return made

    def _set(self, rows: list[tuple[int, str, float]], kind: int, first_byte: int) -> None:
        self.rows, self.kind, self.first_byte = rows, kind, first_byte
        self.longest = max(len(p) for _, p, _ in rows)
        if any(MARK in p.lstrip(MARK) for _, p, _ in rows):
            raise ValueError("a piece reaches over a word's end")

    def table(self, spark: SparkSession) -> DataFrame:
        """h (hash of the piece, the key of joins), piece, held (the rank of the score, then the id), cost."""
        ranks = {score: k for k, score in enumerate(sorted({score for _, _, score in self.rows}, reverse=True))}
        rows = [(piece, ranks[score] << ID_BITS + 2 * PLACE_BITS | k, -score) for k, piece, score in self.rows if self.kind == UNIGRAM or len(piece) > 1]
        return spark.createDataFrame(rows, "piece string, held long, cost double").withColumn("h", F.xxhash64("piece"))


class Folds:
    """What tasks need of the model: the same folds for long segments, where texts are cut, ids of characters, spellings."""

    def __init__(self, pieces: Pieces):
        self.rows, self.kind, self.first_byte, self.longest = pieces.rows, pieces.kind, pieces.first_byte, pieces.longest
        self.ranks = {p: (-s, k) for k, p, s in self.rows}
        chars = sorted({c for _, p, _ in self.rows for c in p})
        self.number = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        pairs = np.array([(ord(a), ord(b)) for _, p, _ in self.rows for a, b in zip(p, p[1:], strict=False)], np.int64).reshape(-1, 2)
        self.beside[self.number[pairs[:, 0]], self.number[pairs[:, 1]]] = True
        self.single = np.full(0x110000, -1, np.int32)
        for k, p, _ in self.rows:
            if len(p) == 1:
                self.single[ord(p)] = k

    def cuts(self, points: np.ndarray) -> np.ndarray:
        """For each code point whether it can't stand in one piece with that before it."""
        of = self.number[points]
        return np.concatenate([[True], ~self.beside[of[:-1], of[1:]]])[: len(of)]

    def edges(self, word: str) -> list[tuple[int, int, int]]:
        """(start, stop, id) of the pieces of two characters or more that a segment of any length is folded to."""
        n, ranks = len(word), self.ranks
        found = [(ranks[word[a:b]][0], a, b) for a in range(n) for b in range(a + 1, min(n, a + self.longest) + 1) if word[a:b] in ranks]
        if self.kind == UNIGRAM:
            best: list[tuple[float, int, int]] = [(0.0, 0, 0)] + [(float("inf"), 0, 0)] * n
            at: dict[int, list[tuple[int, float]]] = {}
            for cost, a, b in found:
                at.setdefault(b, []).append((a, cost))
            for b in range(1, n + 1):
                options = at.get(b, [])
                if not any(a == b - 1 for a, _ in options):
                    options = [*options, (b - 1, NO_PIECE)]
                best[b] = min((best[a][0] + cost, best[a][1] + 1, a) for a, cost in sorted(options))
            ends = [n]
            while ends[-1]:
                ends.append(best[ends[-1]][2])
            ends.reverse()
        else:
            after = list(range(1, n + 2))  # the border after each border
            border = [True] * (n + 1)
            for _, a, b in sorted(e for e in found if e[2] - e[1] > 1):
                if border[a] and border[b] and after[a] != b and after[after[a]] == b:
                    border[after[a]] = False
                    after[a] = b
            ends = [k for k in range(n + 1) if border[k]]
        return [(a, b, ranks[word[a:b]][1]) for a, b in zip(ends, ends[1:], strict=False) if b - a > 1]

    def spell(self, words: pa.Array, kept: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word); kept: places of words and edges of theirs, packed or (start, stop, id)."""
        data, first = code_points(words)
        lengths = np.diff(np.append(first, len(data)))
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        ids, inner = self.single[data], np.zeros(len(data) + 1, np.int32)
        for of, e in kept:
            start, stop, piece = unpacked(e) if e.ndim == 1 else e.T
            ids[first[of] + start] = piece
            np.add.at(inner, first[of] + start + 1, 1)
            np.add.at(inner, first[of] + stop, -1)
        merged = np.cumsum(inner[:-1]) > 0
        size = np.where(ids < 0, utf8_lengths(data), np.uint8(1))
        size[merged] = 0
        # characters without a piece become bytes
        out = np.repeat(ids, size)
        if (lost := np.flatnonzero((ids < 0) & ~merged)).size:
            raw = np.frombuffer("".join(map(chr, data[lost].tolist())).encode(), np.uint8)
            ends = np.cumsum(size, dtype=np.int64)
            out[np.concatenate([np.arange(a, b) for a, b in zip((ends - size)[lost].tolist(), ends[lost].tolist(), strict=True)])] = raw.astype(np.int32) + self.first_byte
        return out, np.bincount(np.repeat(np.arange(len(words)), lengths), size, len(words)).astype(np.int64)

    def spellings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, start, length) by id, U+2581 as a space."""
        text = {k: p.replace(MARK, " ").encode() for k, p, _ in self.rows} | {self.first_byte + b: bytes([b]) for b in range(256)}
        each = [text.get(k, b"") for k in range(max(text) + 1)]
        sizes = np.array([len(x) for x in each], np.int64)
        return np.frombuffer(b"".join(each), np.uint8), starts_of(sizes), sizes


NO_PIECE = float(1 << 40)


def lattice(words: DataFrame, pieces: Pieces, by: tuple[str, ...] = ("word",)) -> DataFrame:
    """words(word, ...), distinct -> word, ..., edges, best first: the pieces that stand in each word.

    Substrings are joined to the piece table on a hash, then compared. Of a unigram model's lattice an edge is
    struct<cost, start, stop, id>; a character that no piece covers has one with id -1 and the highest cost. A
    BPE model's edge is struct<e, within, ends>: e is one long, the rank of the score, then PLACE_BITS of start and
    of stop and ID_BITS of the id; of the word's borders, a bit each, ``within`` has those from start to stop and
    ``ends`` the two. Words that no piece of two characters stands in are missing from it.
    """
    n, least = F.length("word"), 1 if pieces.kind == UNIGRAM else 2
    starts = words.select(*by, F.explode(F.sequence(F.lit(0), n - least)).alias("start"))
    spans = starts.select(*by, "start", F.explode(F.sequence(F.lit(least), F.least(n - F.col("start"), F.lit(pieces.longest)))).alias("size"))
    parts = spans.select(*by, "start", "size", F.substring(F.col("word"), F.col("start") + 1, F.col("size")).alias("part")).withColumn("h", F.xxhash64("part"))
    table = F.broadcast(pieces.table(words.sparkSession))  # as many rows as the model has pieces
    fits = (parts["h"] == table["h"]) & F.startswith(parts["part"], table["piece"]) & F.startswith(table["piece"], parts["part"])
    stop = F.col("start") + F.col("size")
    if pieces.kind == UNIGRAM:
        found = parts.join(table, fits, "left").filter(F.col("held").isNotNull() | (F.col("size") == 1))
        of = F.coalesce(F.col("held").bitwiseAND((1 << ID_BITS) - 1).cast("int"), F.lit(-1))
        edge = F.struct(F.coalesce("cost", F.lit(NO_PIECE)).alias("cost"), "start", stop.alias("stop"), of.alias("id"))
    else:
        found = parts.join(table, fits)
        packed = F.col("held") + F.shiftleft(F.col("start").cast("long"), ID_BITS + PLACE_BITS) + F.shiftleft(stop.cast("long"), ID_BITS)
        edge = F.struct(
            packed.alias("e"), _shift(_bit(F.col("size") + 1) - 1, F.col("start")).alias("within"), _shift(_bit(F.col("size")) + 1, F.col("start")).alias("ends")
        )
    return found.groupBy(*by).agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def _shift(x: Column, k: Column) -> Column:
    return F.call_function("shiftleft", x, k)


def _bit(k: Column) -> Column:
    return _shift(F.lit(1).cast("long"), k)


def unpacked(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, stop and id of packed edges."""
    low = (1 << PLACE_BITS) - 1
    return e >> ID_BITS + PLACE_BITS & low, e >> ID_BITS & low, e & (1 << ID_BITS) - 1


def bpe_path(edges: Column, word: Column) -> Column:
    """The edges that all merges leave, packed. The state is a mask of symbol borders; bit k is the border before character k.

    An edge can be merged if both ends are borders and one border lies between them: that border goes.
    """

    def merge(mask: Column, e: Column) -> Column:
        held = mask.bitwiseAND(e["within"])
        fits = (F.bit_count(held) == 3) & (mask.bitwiseAND(e["ends"]) == e["ends"])
        return F.when(fits, mask.bitwiseXOR(held.bitwiseXOR(e["ends"]))).otherwise(mask)

    def left(mask: Column) -> Column:
        """The edges between neighbouring borders."""
        return F.transform(F.filter(edges, lambda e: mask.bitwiseAND(e["within"]) == e["ends"]), lambda e: e["e"])

    return F.aggregate(edges, _bit(F.length(word) + 1) - 1, merge, left)  # the mask is folded once, not in each test of an edge


def viterbi_path(edges: Column) -> Column:
    """The edges of the cheapest path, packed; among equal costs the fewer pieces, then the earlier ones.

    Edges come by their end; the state maps each reached end to its cheapest path.
    """
    by_end = F.sort_array(F.transform(edges, lambda e: F.struct(e["stop"].alias("stop"), e["start"].alias("start"), e["cost"].alias("cost"), e["id"].alias("id"))))
    state_type = "array<struct<stop:int,cost:double,n:int,path:array<bigint>>>"
    begin = F.array(F.struct(F.lit(0).alias("stop"), F.lit(0.0).alias("cost"), F.lit(0).alias("n"), F.array().cast("array<bigint>").alias("path"))).cast(state_type)

    def extend(state: Column, e: Column) -> Column:
        before = F.get(F.filter(state, lambda s: s["stop"] == e["start"]), F.lit(0))
        packed = F.shiftleft(e["start"].cast("long"), ID_BITS + PLACE_BITS) + F.shiftleft(e["stop"].cast("long"), ID_BITS) + e["id"]
        one = F.when((e["stop"] - e["start"] > 1) & (e["id"] >= 0), F.array(packed)).otherwise(F.array().cast("array<bigint>"))
        made = F.struct(e["stop"].alias("stop"), (before["cost"] + e["cost"]).alias("cost"), (before["n"] + 1).alias("n"), F.concat(before["path"], one).alias("path"))
        held = F.get(F.filter(state, lambda s: s["stop"] == e["stop"]), F.lit(0))
        better = held.isNull() | (made["cost"] < held["cost"]) | ((made["cost"] == held["cost"]) & (made["n"] < held["n"]))
        return F.when(before.isNull() | ~better, state).otherwise(F.concat(F.filter(state, lambda s: s["stop"] != e["stop"]), F.array(made))).cast(state_type)

    return F.aggregate(by_end, begin, extend, lambda s: F.array_max(F.transform(s, lambda x: F.struct(x["stop"].alias("stop"), x["path"].alias("path"))))["path"])


def folded(words: DataFrame, pieces: Pieces, by: tuple[str, ...] = ("word",)) -> DataFrame:
    """words(word, ...), distinct and of at most MAX_WORD characters -> word, ..., kept: packed edges of two characters or more."""
    short = lattice(words.filter(F.length("word").between(1 if pieces.kind == UNIGRAM else 2, MAX_WORD)), pieces, by)
    return short.select(*by, (viterbi_path(F.col("edges")) if pieces.kind == UNIGRAM else bpe_path(F.col("edges"), F.col("word"))).alias("kept"))


# ---- texts and numbers in tasks --------------------------------------------------------------------


def split_words(text: str) -> list[str]:
    """The words of a normalised text, in order; joined, they are the text again."""
    return WORD.findall(MARK + text.replace(" ", MARK)) if text else []


def _bundle(*parts: bytes) -> bytes:
    """Compressed parts, each after its length."""
    press = zstandard.ZstdCompressor(3).compress
    return b"".join(struct.pack("<Q", len(x)) + x for x in map(press, parts))


def _unbundle(data: bytes) -> list[bytes]:
    open_, out, at = zstandard.ZstdDecompressor().decompress, [], 0
    while at < len(data):
        (size,) = struct.unpack_from("<Q", data, at)
        out.append(open_(data[at + 8 : at + 8 + size]))
        at += 8 + size
    return out


def _planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, lowest bytes first, which compresses better than whole numbers."""
    return np.ascontiguousarray(numbers.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.frombuffer(np.frombuffer(planes, np.uint8).reshape(4, -1).T.tobytes(), "<u4").astype(np.int64)


class Group:
    """Documents of one task: their distinct words, and the words' distinct segments in the order in which parts answer."""

    def __init__(self, folds: Folds, parts: int, seed: int, idents: list[str | None], texts: pa.Array):
        lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.match_substring(texts, MARK)).to_numpy(zero_copy_only=False)
        plain, rare = np.flatnonzero(~odd & (lengths > 0)), np.flatnonzero(odd)
        # split at spaces; texts in which marks may run together go the slow way, the mark that all words begin with taken off
        lists = pc.split_pattern(texts.take(pa.array(plain)), " ")
        slow = [[w[1:] for w in split_words(t)] for t in texts.take(pa.array(rare)).to_pylist()]
        words = text_array(pa.chunked_array([lists.flatten(), pa.array([w for s in slow for w in s], pa.string())])).dictionary_encode()
        empty = np.flatnonzero(lengths == 0)
        self.order = np.concatenate([plain, rare, empty])
        self.idents = [idents[k] for k in self.order]
        self.texts = texts
        self.counts = np.concatenate([pc.list_value_length(lists).to_numpy(zero_copy_only=False), [len(s) for s in slow], np.zeros(len(empty))]).astype(np.int64)
        self.places = words.indices.to_numpy(zero_copy_only=False)
        marked = text_array(pc.binary_join_element_wise(pa.scalar(MARK), words.dictionary, "")) if len(words.dictionary) else words.dictionary
        points, first = code_points(marked)
        cuts = folds.cuts(points)
        cuts[first] = True
        at = np.flatnonzero(cuts)
        offsets = np.append(starts_of(utf8_lengths(points))[at], buffers_of(marked)[0][-1]).astype(np.int32)
        segments = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), marked.buffers()[2] or pa.py_buffer(b"")).dictionary_encode() if len(at) else marked.dictionary_encode()
        self.sizes = np.diff(np.append(np.searchsorted(at, first), len(at)))
        held = text_array(segments.dictionary)
        part = self._hash(held) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.segments = rank[segments.indices.to_numpy(zero_copy_only=False)]
        self.distinct, self.part = text_array(held.take(pa.array(order))), part[order].astype(np.int64)
        self.name = xxhash.xxh3_64_intdigest(bytes(buffers_of(self.distinct)[1]), seed) - (1 << 63)

    @staticmethod
    def _hash(texts: pa.Array) -> np.ndarray:
        """A hash of each non-empty text."""
        ends, raw = buffers_of(texts)
        if not len(texts):
            return np.zeros(0, np.uint64)
        sizes = np.diff(ends)
        power = np.cumprod(np.full(int(sizes.max()), ODD))
        at = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes)
        h = np.add.reduceat((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * power[at], ends[:-1])
        h = (h ^ (h >> np.uint64(31))) * ODD
        return h >> np.uint64(33)

    def asked(self) -> tuple[np.ndarray, pa.Array]:
        """Parts, and the segments asked of each with spaces between them."""
        first = np.flatnonzero(np.diff(self.part, prepend=-1))
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(self.part)).astype(np.int32)), self.distinct)
        return self.part[first], pc.binary_join(lists, " ")

    def pack(self) -> bytes:
        """doc_ids; hashes of texts; words a document; places of words, the most frequent first; segments a word; their places."""
        rank = np.argsort(order := np.argsort(-np.bincount(self.places, minlength=len(self.sizes)), kind="stable"), kind="stable")
        ends, raw = buffers_of(self.texts)
        digests = b"".join([xxhash.xxh3_128_digest(raw[ends[k] : ends[k + 1]]) for k in self.order.tolist()])
        segments = slices(self.segments, starts_of(self.sizes)[order], self.sizes[order])
        return _bundle(json.dumps(self.idents).encode(), digests, *map(_planes, (self.counts, rank[self.places], self.sizes[order], segments)))


def groups(batches: Iterator[pa.RecordBatch], folds: Folds, parts: int, most: int = GROUP_BYTES) -> Iterator[Group]:
    """The groups of a task's rows (text, and ident if asked for), in order."""
    from pyspark import TaskContext

    task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

    def flush() -> Group:
        texts = text_array(pa.chunked_array([t for _, t in held]))
        return Group(folds, parts, task << 32 | made, [x for ids, _ in held for x in ids], texts)

    for batch in batches:
        texts = batch.column("text")
        idents = batch.column("ident").to_pylist() if "ident" in batch.schema.names else [None] * len(batch)
        ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < len(batch):
            before = int(ends[at - 1]) if at else 0
            stop = min(len(batch), int(np.searchsorted(ends, before + most - size)) + 1)
            held.append((idents[at:stop], texts.slice(at, stop - at)))
            size, at = size + int(ends[stop - 1]) - before, stop
            if size >= most:
                yield flush()
                pa.default_memory_pool().release_unused()
                made, held, size = made + 1, [], 0
    if held:
        yield flush()


# ---- groups, parts and answers ---------------------------------------------------------------------


def _ask(pieces: Pieces, parts: int, ranges: int):
    """texts -> (part, asked): the group's name and its segments of each part, spaces between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        folds, of = Folds(pieces), zlib.crc32(b"%d" % TaskContext.get().partitionId()) % ranges
        for group in groups(batches, folds, parts):
            part, asked = group.asked()
            yield pa.RecordBatch.from_arrays([pa.array(part + of * parts, pa.int64()), pc.binary_join_element_wise(pa.scalar(str(group.name)), asked, " ")], names=["part", "asked"])

    return run


def _packed(pieces: Pieces, parts: int):
    """(ident, text) -> (group, pack)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds = Folds(pieces)
        for group in groups(batches, folds, parts):
            yield pa.RecordBatch.from_arrays([pa.array([group.name], pa.int64()), pa.array([group.pack()], pa.binary())], names=["group", "pack"])

    return run


def _answer(pieces: Pieces):
    """A part's answers: for each group the ids of the segments that it asked for, in their order."""
    kept_folds: list[Folds] = []

    def run(asked: pa.Table, encoded: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        if not kept_folds:
            kept_folds.append(Folds(pieces))
        folds = kept_folds[0]
        lists = pc.split_pattern(text_array(asked.column("asked")), " ", max_splits=1)
        names = pc.list_element(lists, 0).to_pylist()
        lists = pc.split_pattern(pc.list_element(lists, 1), " ")
        words = text_array(lists.flatten()).dictionary_encode()
        place = words.indices.to_numpy(zero_copy_only=False)
        distinct = text_array(words.dictionary)
        edges = encoded.column("kept").combine_chunks()
        edges = pa.concat_arrays(edges.chunks) if isinstance(edges, pa.ChunkedArray) else edges
        of = pc.index_in(text_array(encoded.column("word")), value_set=distinct).to_numpy(zero_copy_only=False).astype(np.int64)
        kept = [(np.repeat(of, pc.list_value_length(edges).to_numpy(zero_copy_only=False)), edges.flatten().to_numpy(zero_copy_only=False))] if len(of) else []
        for k in np.flatnonzero(pc.utf8_length(distinct).to_numpy(zero_copy_only=False) > MAX_WORD).tolist():
            more = np.array(folds.edges(distinct[k].as_py()), np.int64).reshape(-1, 3)
            kept.append((np.full(len(more), k), more))
        values, sizes = folds.spell(distinct, kept)
        starts, ends = starts_of(sizes), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        blobs = []
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            rows = place[a:b]
            blobs.append(_bundle(_planes(sizes[rows]), _planes(slices(values, starts[rows], sizes[rows]))))
        return pa.table({"group": pa.array([int(x) for x in names], pa.int64()), "part": asked.column("part"), "answer": pa.array(blobs, pa.binary())})

    return run


def _assemble(pieces: Pieces, check: bool):
    """A group's pack and answers -> its documents' ids; with ``check`` their count, checksum and round trip too.

    round_trip: the ids, decoded, are the text again, which its hash in the pack tells.
    """
    kept: list = []

    def run(packs: pa.Table, answers: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # what the group before has left
        if not kept:
            kept.append(Folds(pieces).spellings())
        names = ["doc_id", "ids", *(["n_tokens", "ids_crc32", "round_trip"] if check else [])]
        if not len(packs):
            raise RuntimeError("answers without their group: the rows came in another order; write them to files first")
        (pack,) = packs.column("pack").to_pylist()
        idents, digests, *rest = _unbundle(pack)
        counts, places, per_word, segments = map(_numbers, rest)
        got = [list(map(_numbers, _unbundle(x))) for x in answers.sort_by("part").column("answer").to_pylist()]
        sizes = np.concatenate([n for n, _ in got]) if got else np.zeros(0, np.int64)
        if len(sizes) != (segments.max() + 1 if len(segments) else 0):
            raise RuntimeError("a group without its answers: the rows came in another order; write them to files first")
        values = np.concatenate([ids for _, ids in got]).astype(np.int32) if got else np.zeros(0, np.int32)
        # ids of segments -> of words -> of documents
        values = slices(values, starts_of(sizes)[segments], sizes[segments])
        sizes = sums(sizes[segments], per_word)
        ids = slices(values, starts_of(sizes)[places], sizes[places])
        n = sums(sizes[places], counts)
        ends = np.cumsum(n)
        columns = [pa.array(json.loads(idents), pa.string()), pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids))]
        if check:
            spelled, start, length = kept[0]
            le, digest, checks, same = ids.astype("<u4", copy=False), xxhash.xxh3_128_digest, [], []
            for k, (a, b) in enumerate(zip((ends - n).tolist(), ends.tolist(), strict=True)):
                checks.append(zlib.crc32(le[a:b]))
                text = slices(spelled, start[ids[a:b]], length[ids[a:b]])[1:]  # without the dummy prefix
                same.append(digest(text) == digests[16 * k : 16 * k + 16])
            columns += [pa.array(n, pa.int64()), pa.array(checks, pa.int64()), pa.array(same, pa.bool_())]
        return pa.table(columns, names=names)

    return run


@contextmanager
def grouped_by_hash(spark: SparkSession, keys: int = 1 << 20):
    """Inside, collecting aggregates of up to so many keys a task aren't sorted first; after it the session is as before."""
    name = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(keys))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _encoded(docs: DataFrame, pieces: Pieces, parts: int | None, check: bool) -> DataFrame:
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_of(docs)).cast("long"))).first()[0] or 0
    ranges = -(-size // RANGE_BYTES) or 1
    parts = parts or max(8, size // ranges // PART_BYTES)
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // (16 << 20), 100_000))
    rows = docs.select(F.col("doc_id").cast("string").alias("ident"), text_of(docs).alias("text"))
    asked = rows.select("text").mapInArrow(_ask(pieces, parts, ranges), "part long, asked string").repartition(wide, "part")
    # all of this keeps the dealing by part: Spark adds no exchange, and as both readers of asked need all its columns, deals it once
    words = asked.select(F.col("part").alias("of_part"), F.explode(F.slice(F.split("asked", " "), 2, (1 << 31) - 1)).alias("word")).groupBy("of_part", "word").agg(F.max(F.length("word")).alias("chars"))
    encoded = folded(words.filter(F.col("chars") <= MAX_WORD).select("of_part", "word"), pieces, ("of_part", "word"))
    with grouped_by_hash(spark):
        answers = cut(asked.groupBy("part").cogroup(encoded.groupBy("of_part")).applyInArrow(_answer(pieces), "group long, part long, answer binary"))
    packs = rows.mapInArrow(_packed(pieces, parts), "group long, pack binary").repartition(wide, "group")
    schema = "doc_id string, ids array<int>" + (", n_tokens long, ids_crc32 long, round_trip boolean" if check else "")
    out = packs.groupBy("group").cogroup(answers.repartition(wide, "group").groupBy("group")).applyInArrow(_assemble(pieces, check), schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]))


def encode(docs: DataFrame, model_path: str, parts: int | None = None) -> DataFrame:
    """doc_id, ids: the ids that the model's own encoder gives."""
    return _encoded(docs, Pieces(model_path), parts, False)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text of (doc_id, ids): pieces' texts and bytes joined, U+2581 as spaces, the dummy prefix taken off."""
    pieces = Pieces(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled, start, length = Folds(pieces).spellings()
        for batch in batches:
            texts = []
            for ids in batch.column("ids").to_pylist():
                of = np.array(ids or [], np.int64)
                text = slices(spelled, start[of], length[of]).tobytes().decode("utf-8", "replace")
                texts.append(text[1:] if text[:1] == " " else text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def op8(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32 (ids as little-endian unsigned 32-bit integers), round_trip (decoded, they are the text)."""
    return _encoded(docs, Pieces(model_path), None, True)
