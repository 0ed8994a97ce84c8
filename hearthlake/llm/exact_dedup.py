"""Exact dedup with a cuckoo-filter index.

A digest is the SHA-256 of the text without the characters ``[\\x20\\x09-\\x0D]``. Digests of live
documents are held in cuckoo filters: two candidate buckets of four 16-bit tags each. A tag hit is
never trusted; it is verified against the full digest kept for that slot. When an insertion finds no
place after a bounded number of kicks, the filter doubles and is rebuilt from the stored digests, so
no key is ever lost. Entries count their live documents, so that deletions are exact too.

Scale. Every map task folds its own rows through a filter first, so a digest with a third of all rows
reaches the shuffle once per task. The partial groups are dealt by digest and folded through a second
filter. Row decisions come from a join on the digest, which Spark may split where it is skewed.

Cases: null text counts as empty; texts of white space only are equal to empty ones; ties in length
go to the smallest doc_id; a null doc_id loses against any other; rows that repeat a whole document
count as members and one of them stays; an empty table gives an empty result; other columns of the
input are ignored by the decisions and kept by ``drop_copies``.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_of

SPACES = " \t\n\x0b\x0c\r"
SLOTS = 4
MAX_KICKS = 200
NO_ID = 1 << 63  # sorts after every doc_id


class CuckooIndex:
    """Live digests with payloads; see the module text."""

    def __init__(self, buckets: int = 1024):
        self.digests: list[bytes | None] = []
        self.payload: list = []
        self.free: list[int] = []
        self.live = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.tags = array("H", bytes(2 * SLOTS * buckets))
        self.refs = array("q", bytes(8 * SLOTS * buckets))

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        a, tag = struct.unpack_from("<QH", digest)
        tag = tag ^ (digest[10] << 8) or 1
        first = (a >> 16) & self.mask
        return tag, first, self._other(first, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return (bucket ^ (tag * 0x5BD1E995)) & self.mask

    def find(self, digest: bytes) -> int:
        """The entry of digest, or -1. Tag hits are verified against the stored digest."""
        tag, one, two = self._places(digest)
        for bucket in (one, two):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.tags[slot] == tag and self.digests[self.refs[slot]] == digest:
                    return self.refs[slot]
        return -1

    def insert(self, digest: bytes, payload) -> int:
        """Add a digest that isn't held yet."""
        if self.free:
            ref = self.free.pop()
            self.digests[ref], self.payload[ref] = digest, payload
        else:
            ref = len(self.digests)
            self.digests.append(digest)
            self.payload.append(payload)
        self.live += 1
        if not self._place(digest, ref):
            self._resize()
        return ref

    def _place(self, digest: bytes, ref: int) -> bool:
        tag, one, two = self._places(digest)
        for bucket in (one, two):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.tags[slot]:
                    self.tags[slot], self.refs[slot] = tag, ref
                    return True
        bucket = two
        for kick in range(MAX_KICKS):
            slot = bucket * SLOTS + (kick + tag) % SLOTS
            self.tags[slot], tag = tag, self.tags[slot]
            self.refs[slot], ref = ref, self.refs[slot]
            bucket = self._other(bucket, tag)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.tags[slot]:
                    self.tags[slot], self.refs[slot] = tag, ref
                    return True
        return False

    def _resize(self) -> None:
        """Double until every stored key has a place."""
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self._clear(buckets)
            if all(self._place(d, ref) for ref, d in enumerate(self.digests) if d is not None):
                return

    def delete(self, digest: bytes) -> bool:
        tag, one, two = self._places(digest)
        for bucket in (one, two):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                ref = self.refs[slot]
                if self.tags[slot] == tag and self.digests[ref] == digest:
                    self.tags[slot] = 0
                    self.digests[ref] = self.payload[ref] = None
                    self.free.append(ref)
                    self.live -= 1
                    return True
        return False

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((d, p) for d, p in zip(self.digests, self.payload, strict=True) if d is not None)

    def dump(self) -> bytes:
        """Digests and counts; the filter is rebuilt from them by load()."""
        held = list(self.items())
        return struct.pack("<QQ", self.mask + 1, len(held)) + b"".join(d for d, _ in held) + struct.pack(f"<{len(held)}q", *(p for _, p in held))

    @classmethod
    def load(cls, state: bytes) -> CuckooIndex:
        buckets, n = struct.unpack_from("<QQ", state)
        index, counts = cls(buckets), struct.unpack_from(f"<{n}q", state, 16 + 32 * n)
        for k in range(n):
            index.insert(state[16 + 32 * k : 48 + 32 * k], counts[k])
        return index


def with_digest(docs: DataFrame, digest: str = "digest") -> DataFrame:
    """Add the SHA-256 (binary) of the normalised text."""
    return docs.withColumn(digest, F.unhex(F.sha2(F.translate(text_of(docs), SPACES, "").cast("binary"), 256)))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge (digest, chars, id, n, best) rows through a cuckoo index.

    The best row is the longest, then that of the smallest id; best counts the rows that repeat it.
    """
    index = CuckooIndex()
    payload = index.payload
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(5)]
        for digest, chars, doc, n, best in zip(*columns, strict=True):
            rank = (-chars, NO_ID if doc is None else doc)
            ref = index.find(digest)
            if ref < 0:
                index.insert(digest, [rank, n, best])
            else:
                held = payload[ref]
                held[1] += n
                if rank < held[0]:
                    held[0], held[2] = rank, best
                elif rank == held[0]:
                    held[2] += best
    held = list(index.items())
    for at in range(0, len(held), 20_000):
        part = held[at : at + 20_000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([d for d, _ in part], pa.binary()),
                pa.array([-p[0][0] for _, p in part], pa.int64()),
                pa.array([None if p[0][1] == NO_ID else p[0][1] for _, p in part], pa.int64()),
                pa.array([p[1] for _, p in part], pa.int64()),
                pa.array([p[2] for _, p in part], pa.int64()),
            ],
            names=["digest", "chars", "id", "n", "best"],
        )


GROUP = "digest binary, chars long, id long, n long, best long"


def groups(rows: DataFrame) -> DataFrame:
    """rows(doc_id, digest, chars) -> one row per digest: digest, keep_chars, keep_id, group_size, repeats (rows of the best document)."""
    one = F.lit(1).cast("long")
    local = rows.select("digest", F.col("chars").cast("long").alias("chars"), F.col("doc_id").cast("long").alias("id"), one.alias("n"), one.alias("best")).mapInArrow(_fold, GROUP)
    merged = local.repartition("digest").mapInArrow(_fold, GROUP)
    return merged.select("digest", F.col("chars").alias("keep_chars"), F.col("id").alias("keep_id"), F.col("n").alias("group_size"), F.col("best").alias("repeats"))


def decisions(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = with_digest(docs.select("doc_id", "text")).select("doc_id", "digest", F.length(text_of(docs)).alias("chars"))
    found = groups(rows)
    joined = rows.join(found, "digest", "left")
    best = joined["doc_id"].eqNullSafe(joined["keep_id"]) & (joined["chars"] == joined["keep_chars"])
    # rows that repeat the same document: the first of them stays
    turn = F.row_number().over(Window.partitionBy("doc_id", "digest", "chars").orderBy("keep_id"))
    return joined.withColumn("turn", turn).select(
        "doc_id", "keep_id", "group_size", (best & (F.col("turn") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns.

    The join that picks them has doc_id among its keys, so a large group of copies is spread. Texts are
    dealt once; only if some document that stays is repeated whole are they dealt again.
    """
    key, chars = "__copy_digest", "__copy_chars"
    rows = with_digest(docs, key).withColumn(chars, F.length(text_of(docs)).cast("long"))
    found = cut(groups(rows.select("doc_id", F.col(key).alias("digest"), F.col(chars).alias("chars"))))
    pick = found.select(F.col("digest").alias("__g_digest"), F.col("keep_id").alias("__g_id"), F.col("keep_chars").alias("__g_chars"))
    same = (rows[key] == pick["__g_digest"]) & rows["doc_id"].eqNullSafe(pick["__g_id"]) & (rows[chars] == pick["__g_chars"])
    kept = rows.join(pick, same, "left_semi")
    if not found.filter("repeats > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", key, chars])
    return kept.select(*docs.columns)


def build_index(docs: DataFrame, shards: int = 64) -> DataFrame:
    """A stored index: shard, shards, live (digests), state (binary). Choose shards so that one holds some 10^5 digests."""
    rows = with_digest(docs.select("text")).select("digest", F.lit(1).cast("long").alias("n"))
    return _apply(None, rows.groupBy("digest").agg(F.sum("n").alias("n")), shards)


def update_index(index: DataFrame, inserts: DataFrame, deletes: DataFrame, shards: int | None = None) -> DataFrame:
    """Insert and delete the texts of documents; deleting a digest that isn't live does nothing.

    The index keeps its number of shards; asking for another one is an error. An index without rows takes it (or 64).
    """
    of = index.select("shards").first()
    if of is not None and shards not in (None, of["shards"]):
        raise ValueError(f"the index has {of['shards']} shards, not {shards}")
    shards = of["shards"] if of is not None else shards or 64
    plus = with_digest(inserts.select("text")).select("digest", F.lit(1).cast("long").alias("n"))
    minus = with_digest(deletes.select("text")).select("digest", F.lit(-1).cast("long").alias("n"))
    return _apply(index, plus.unionByName(minus).groupBy("digest").agg(F.sum("n").alias("n")), shards)


def _apply(index: DataFrame | None, changes: DataFrame, shards: int) -> DataFrame:
    shard = F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), F.lit(shards)).cast("int").alias("shard")
    new = changes.select(shard, "digest", "n", F.lit(None).cast("binary").alias("state"))
    if index is not None:
        new = new.unionByName(index.select("shard", F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n"), "state"))

    def fold(table: pa.Table) -> pa.Table:
        shard_id = table.column("shard")[0].as_py()
        states = [s for s in table.column("state").to_pylist() if s is not None]
        held = CuckooIndex.load(states[0]) if states else CuckooIndex()
        for digest, n in zip(table.column("digest").to_pylist(), table.column("n").to_pylist(), strict=True):
            if digest is None:
                continue
            ref = held.find(digest)
            if ref >= 0:
                held.payload[ref] += n
                if held.payload[ref] <= 0:
                    held.delete(digest)
            elif n > 0:
                held.insert(digest, n)
        return pa.table({"shard": pa.array([shard_id], pa.int32()), "shards": pa.array([shards], pa.int32()), "live": pa.array([held.live], pa.int64()), "state": pa.array([held.dump()], pa.binary())})

    return new.groupBy("shard").applyInArrow(fold, "shard int, shards int, live long, state binary")


def op2(docs: DataFrame) -> DataFrame:
    return decisions(docs)


ORACLE = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents
), g as (
  select *, count(*) over (partition by text_sha256) as group_size,
         first_value(doc_id) over (partition by text_sha256 order by chars desc, doc_id nulls last) as keep_id
  from t
)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256 from g
"""
