"""Token files: Parquet list columns with controlled row groups, pages and encodings.

``write`` deals documents by ranges of doc_id, sorts them, encodes each whole text in an Arrow batch and
writes one Parquet file per range: doc_id, part, first (ids before the document in its part), n_tokens
and ids. Ids are delta-encoded (Parquet's second writer version without a dictionary) or
dictionary-encoded; row groups and pages have the sizes asked for, and column and offset indexes let
a reader of a few documents, or of the metadata only, skip the rest.

Encoding. Byte-level BPE never merges across a pre-token. Texts are split at spaces, which begin a pre-token
unless white space stands on both sides; the distinct words of some BATCH_BYTES are cut once more where their
characters' classes (CLASSES) always make a border, and the tokenizer itself encodes each distinct chunk. Ids
are then gathered from chunks to words to texts. Texts with such spaces inside white space, or with the string of
an added token, take chunks of a pattern that follows the pre-tokens, or are one chunk. A worker process keeps
what it has encoded, twice CACHE chunks at most. Ids equal those of the whole text.

Cases: null text counts as empty and has the end id only; a null doc_id comes before all others; rows
of one doc_id lie side by side, in the order of their texts' hash, and may be dealt over tasks; equal rows have equal
ids; very long texts are encoded whole; extra columns, whatever their names, are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import buffers_of, by_bytes, code_points, slices, starts_of, sums, text_array, utf8_lengths
from .common import narrow, shared_dir, text_of

END_ID = 2
#: White space to the tokenizer; Python's class also has four separators that are not.
_SPACE, _OTHER = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
CHUNK = re.compile(rf" ?[^\W\d_]+(?=[ \n\t.,;:!?]|\Z)|[.,;:!?]+(?=[ \n\t]|\Z)| ?{_OTHER}+|{_SPACE}+(?!{_OTHER})|{_SPACE}+")
#: A space with white space before it and after it, or the end.
_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
INNER_SPACE = rf"{_WHITE} (?:{_WHITE}|\z)"
CACHE = 150_000
LONGEST = 64  # longer chunks aren't kept
JOINED = 1000
BATCH_BYTES = 8 << 20
#: Classes of characters that always make borders: Latin letters, digits, marks, the apostrophe, space, other white space. The rest is 0.
_NONE, _LETTER, _DIGIT, _MARK, _APOSTROPHE, _BLANK, _LINE = range(7)
CLASSES = np.zeros(0x110000, np.uint8)
CLASSES[[k for k in range(0x250) if chr(k).isalpha()]] = _LETTER
CLASSES[0x30:0x3A] = _DIGIT
CLASSES[[ord(c) for c in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = _MARK
CLASSES[ord("'")] = _APOSTROPHE
CLASSES[ord(" ")] = _BLANK
CLASSES[[ord(c) for c in "\n\t\r"]] = _LINE
#: BORDER[a, b]: a pre-token ends between classes a and b, whatever stands around; for _LINE if no white space is before it.
BORDER = np.zeros((7, 7), bool)
BORDER[_LETTER, [_DIGIT, _MARK, _APOSTROPHE, _BLANK, _LINE]] = True
BORDER[_DIGIT, [_LETTER, _MARK, _APOSTROPHE, _BLANK, _LINE]] = True
BORDER[_MARK, [_LETTER, _DIGIT, _BLANK, _LINE]] = True
BORDER[_APOSTROPHE, [_DIGIT, _BLANK, _LINE]] = True
BORDER[_LINE, [_LETTER, _DIGIT, _MARK, _APOSTROPHE]] = True


class Encoder:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tokenizers

        # the process keeps tokenizers and chunks for its next tasks
        kept = tokenizers.__dict__.setdefault("_kept_by_path", {})
        if path not in kept:
            made = tokenizers.Tokenizer.from_file(path)
            leading = np.array([(made.id_to_token(k) or "").startswith("\u0120") for k in range(made.get_vocab_size())], bool)
            line = made.encode("\n", add_special_tokens=False).ids
            kept[path] = (made, leading, line[0] if len(line) == 1 else -1, {}, {})
        self.tokenizer, self.leading, self.line, self.known, self.before = kept[path]
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]

    def learn(self, chunks: list[str], lines: list[bool]) -> None:
        """Encode chunks that aren't known, those that are marked many at a time.

        Marked are chunks without white space but for one space in front. Those with a space follow each other: their
        first ids, and no others, are of tokens that begin with a space. The rest come a line each.
        """
        spaced = [c for c, x in zip(chunks, lines, strict=True) if x and c[0] == " "]
        words = [c for c, x in zip(chunks, lines, strict=True) if x and c[0] != " "]
        others = [c for c, x in zip(chunks, lines, strict=True) if not x]
        for part, ids in self._together(spaced, ""):
            self._keep(part, ids, at := np.flatnonzero(self.leading[ids]), np.append(at[1:], len(ids)), others)
        for part, ids in self._together(words, "\n"):
            at = np.flatnonzero(ids == self.line)
            self._keep(part, ids, np.append(0, at + 1), np.append(at, len(ids)), others)
        for c, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            self.known[c] = np.array(e.ids, "<i4").tobytes()

    def _together(self, chunks: list[str], between: str) -> Iterator[tuple[list[str], np.ndarray]]:
        parts = [chunks[at : at + JOINED] for at in range(0, len(chunks), JOINED)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([between.join(p) for p in parts], add_special_tokens=False), strict=True):
            yield part, np.array(e.ids, "<i4")

    def _keep(self, part: list[str], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: list[str]) -> None:
        if len(starts) != len(part):  # a tokenizer of another kind
            others += part
            return
        raw = ids.tobytes()
        self.known.update(zip(part, [raw[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True)], strict=True))

    def ids_of(self, words: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each); words marked whole are one chunk each."""
        points, first = code_points(words)
        lengths = np.diff(np.append(first, len(points)))
        kind = CLASSES[points]
        cuts = np.concatenate([[True], BORDER.ravel()[kind[:-1] * np.uint8(7) + kind[1:]]])[: len(kind)]
        line = np.flatnonzero(kind[1:-1] == _LINE)  # white space that more precedes ends no pre-token for sure
        cuts[line[(kind[line] == _BLANK) | (kind[line] == _LINE) | (kind[line] == _NONE)] + 2] = False
        if whole.any():
            cuts[np.repeat(whole, lengths)] = False
        cuts[first[lengths > 0]] = True
        at = np.flatnonzero(cuts)
        ends = np.append(at[1:], len(points))
        offsets = np.append(starts_of(utf8_lengths(points))[at], buffers_of(words)[0][-1]).astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), words.buffers()[2] or pa.py_buffer(b"")) if len(at) else pa.array([], pa.string())
        chunks = chunks.dictionary_encode()
        place = chunks.indices.to_numpy(zero_copy_only=False)
        seen = np.zeros(len(chunks.dictionary), np.int64)
        seen[place[::-1]] = np.arange(len(place))[::-1]  # where each first is
        odd = np.append(0, np.cumsum((kind == _NONE) | (kind == _LINE) | (kind == _BLANK)))
        plain = (odd[ends] - odd[at] - (kind[at] == _BLANK))[seen] == 0 if len(at) else np.zeros(0, bool)
        plain &= (ends - at)[seen] > (kind[at[seen]] == _BLANK) if len(at) else True
        distinct = chunks.dictionary.to_pylist()
        known, older = self.known, self.before
        if len(known) > CACHE:  # what isn't asked for again until the next time goes
            older.clear()
            older.update(known)
            known.clear()
        for c in distinct:
            if c not in known and c in older:
                known[c] = older[c]
        fresh = [k for k, c in enumerate(distinct) if c not in known]
        self.learn([distinct[k] for k in fresh], plain[fresh].tolist())
        got = [known[c] for c in distinct]
        for k in fresh:
            if len(distinct[k]) > LONGEST:
                del known[distinct[k]]
        values, sizes = np.frombuffer(b"".join(got), "<i4"), np.array([len(x) // 4 for x in got], np.int64)
        per_word = np.diff(np.append(np.searchsorted(at, first), len(at)))
        return slices(values, starts_of(sizes)[place], sizes[place]), sums(sizes[place], per_word)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with their end ids, number of ids of each)."""
        texts = text_array(texts)
        added = np.zeros(len(texts), bool)
        for x in self.special:
            added |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        odd = added | pc.match_substring_regex(texts, INNER_SPACE).to_numpy(zero_copy_only=False)
        plain, rare = np.flatnonzero(~odd), np.flatnonzero(odd)
        lists = pc.split_pattern(texts.take(pa.array(plain)), " ")
        count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = text_array(lists.flatten()).dictionary_encode()
        place = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # all words but a text's first have their space in front
        opening = starts_of(count)
        firsts, again = np.unique(place[opening], return_inverse=True)
        place[opening] = len(flat.dictionary) + again
        # a text with an added token's string is one chunk, as the tokenizer cuts there first
        slow = [[t] if special else CHUNK.findall(t) for t, special in zip(texts.take(pa.array(rare)).to_pylist(), added[rare].tolist(), strict=True)]
        other = pa.array([c for s in slow for c in s], pa.string()).dictionary_encode()
        spaced = pc.binary_join_element_wise(pa.scalar(" "), text_array(flat.dictionary), "")
        words = text_array(pa.chunked_array([spaced, flat.dictionary.take(pa.array(firsts)), other.dictionary]))
        values, sizes = self.ids_of(words, np.arange(len(words)) >= len(words) - len(other.dictionary))
        place = np.concatenate([place, other.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(spaced) + len(firsts)])
        # the end id is one more word, after each text's; texts come in their own order again
        places = np.insert(place, ends := np.cumsum(np.concatenate([count, [len(s) for s in slow]]).astype(np.int64)), len(words))
        values, sizes = np.append(values, END_ID).astype(np.int32), np.append(sizes, 1)
        order = np.argsort(np.concatenate([plain, rare]))
        count = np.diff(ends, prepend=0) + 1
        places = slices(places, starts_of(count)[order], count[order])
        return slices(values, starts_of(sizes)[places], sizes[places]), sums(sizes[places], count[order])


OPTIONS = {
    "delta": {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"},
    "dictionary": {"parquet.writer.version": "PARQUET_1_0", "parquet.enable.dictionary": "true"},
}


def encode(docs: DataFrame, tokenizer_path: str, parts: int | None = None) -> DataFrame:
    """doc_id, part, first, n_tokens, ids in ascending order of doc_id within and across partitions."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # so that many rows of one doc_id aren't one task
    dealt = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    ordered = dealt.sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = Encoder(tokenizer_path), 0
        for whole in batches:
            for at, stop in by_bytes(whole.column("text"), BATCH_BYTES):
                batch = whole.slice(at, stop - at)
                flat, sizes = encoder.batch(batch.column("text"))
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("part"), pa.array(before + ends - sizes), pa.array(sizes.astype(np.int32)), lists], names=["doc_id", "part", "first", "n_tokens", "ids"]
                )
                before += int(ends[-1])

    return ordered.mapInArrow(run, "doc_id long, part int, first long, n_tokens int, ids array<int>")


def write(docs: DataFrame, path: str, tokenizer_path: str, encoding: str = "delta", parts: int | None = None, row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10) -> str:
    """Write token files under path and return it."""
    out = encode(docs, tokenizer_path, parts).write.mode("overwrite").option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
    for k, v in OPTIONS[encoding].items():
        out = out.option(k, v)
    out.parquet(path)
    return path


def read(spark, path: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and, on demand, ids. Without ids only metadata is read."""
    rows = spark.read.parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    begun = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    placed = rows.join(narrow(parts.select("part", begun.alias("begun"))), "part")
    columns = ["doc_id", (F.col("begun") + F.col("first")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens")]
    return placed.select(*columns, *(["ids"] if ids else []))


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 over ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            ends = lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return checksums(read(spark, write(docs, path, tokenizer_path)))
