"""SimHash near-dedup with BK-trees.

A fingerprint has 64 bits for each block; a bit is 1 if it is set in over half of the shingles'
hashes. Texts with equal fingerprints are one node from there on. Nodes are dealt into shards by keys
that every linked pair has in common, each shard builds a BK-tree (children keyed by their integer
Hamming distance to the parent) and every node of the shard searches it, following only the edges
within the radius. Shards give stars, not pairs: each node with the smallest node it reaches there.
Connected components over the stars come from alternating star contraction in DataFrame joins.

The named method broadcasts its shard trees. Together they hold the fingerprints of all documents,
which has no size bound and may not pass through the driver, so trees are built where their shard's
nodes have been dealt.

Two ways to shard:

``block_keys``   for a radius of at most 2 in 64 bits. Of four 16-bit blocks two at least are equal, so
                 the six pairs of blocks are keys. A shard with over MAX_SHARD nodes is dealt again by
                 the six pairs of 8-bit blocks of its other 32 bits; then 48 bits agree and a shard can't
                 hold over 65,536 nodes. Exact: no link is lost.
``sketch keys``  for the wide radius that a similarity of 0.8 needs (one bit in six), where no
                 pigeonhole on bits helps: the smallest hashes of the text's own shingles. Texts with a
                 shingle similarity of 0.8 share one of the eight with a probability above 0.999. The
                 nodes of a key with over SKETCH_SHARD of them (a passage that many documents share) are
                 dealt into blocks of that size, and each pair of blocks is a shard: no link is lost and
                 no task holds more than two blocks, but a key's rows grow with its number of blocks.
                 These links are candidates only: the shingle sets of each group that they make are dealt
                 once, to one task or by pairs of blocks, and compared.

Cases: null text counts as empty; texts without words have fingerprint zero and are linked like any
other; fewer words than a shingle has: the whole sequence; a null doc_id takes part, but never names
a component; repeated rows give repeated results; very long texts are read whole; extra columns, whatever
their names, take no part and are kept by ``drop_near_copies``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts, text_of

SEED = 42
SKETCH = 8
MAX_SHARD = 2048
SKETCH_SHARD = 8192
BLOCK_BYTES = 16 << 20
BLOCK_ROWS = 4096
LEAF = 48
CHUNK = 1 << 15
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included. Lower-casing and splitting of bytes touch ASCII only."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    hash_of = xxhash.xxh64_intdigest
    if len(w) < words:
        return np.array([hash_of(b" ".join(w), SEED)], np.uint64)
    parts = zip(*(w[k:] for k in range(words)), strict=False)
    return np.fromiter((hash_of(s, SEED) for s in map(b" ".join, parts)), np.uint64, len(w) - words + 1)


def fingerprint(hashes: np.ndarray, blocks: int = 1) -> np.ndarray:
    """Blocks after the first take the hashes through a multiply-xor mix."""
    out = np.zeros(blocks, np.uint64)
    if not len(hashes):
        return out
    h = hashes
    for block in range(blocks):
        if block:
            h = (h ^ (h >> np.uint64(31))) * MIX
            h ^= h >> np.uint64(29)
        total = np.zeros(64, np.int64)
        for at in range(0, len(h), CHUNK):
            total += np.unpackbits(h[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[block] = np.packbits((2 * total > len(h)).astype(np.uint8), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, words: int = 3, blocks: int = 1, sketch: bool = False) -> DataFrame:
    """doc_id, fp (binary, big-endian blocks) and, on demand, keys (the smallest shingle hashes)."""

    def per_batch(texts: list[str]) -> list[pa.Array]:
        fps, keys = [], []
        for text in texts:
            h = shingle_hashes(text, words)
            if sketch:
                h = np.unique(h)  # similarity of sets
                keys.append(h[:SKETCH].view(np.int64))
            fps.append(fingerprint(h, blocks).astype(">u8").tobytes())
        made = [pa.array(fps, pa.binary())]
        return [*made, pa.array(keys, pa.list_(pa.int64()))] if sketch else made

    return map_texts(docs, per_batch, "fp binary, keys array<long>" if sketch else "fp binary")


# ---- BK-trees -------------------------------------------------------------------------------------


def distances(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.bitwise_count(many ^ one).sum(axis=-1, dtype=np.int32)


class BKTree:
    """A BK-tree over rows of uint64 blocks. Subtrees of up to LEAF rows stay lists."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        self.root = self._build(np.arange(len(fps)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        apart = distances(self.fps[rows[0]], self.fps[rows[1:]])
        order = np.argsort(apart, kind="stable")
        edges, starts = np.unique(apart[order], return_index=True)
        parts = np.split(rows[1:][order], starts[1:])
        return rows[0], [(int(e), self._build(p)) for e, p in zip(edges, parts, strict=True)]

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row, row) of the tree at most radius apart, in batches; all rows search at once."""
        todo = [(self.root, np.arange(len(self.fps)))]
        while todo:
            node, asking = todo.pop()
            if isinstance(node, np.ndarray):
                for at in range(0, len(asking), 4096):
                    part = asking[at : at + 4096]
                    near = distances(self.fps[node][None, :, :], self.fps[part][:, None, :]) <= radius
                    a, b = np.nonzero(near)
                    yield part[a], node[b]
                continue
            row, children = node
            apart = distances(self.fps[row], self.fps[asking])
            found = asking[apart <= radius]
            yield found, np.full(len(found), row)
            for edge, child in children:
                near = asking[np.abs(apart - edge) <= radius]  # the triangle inequality bars all other edges
                if len(near):
                    todo.append((child, near))


def local_roots(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each row the first row of its component within the shard."""
    root = np.arange(len(fps))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in BKTree(fps).links(radius):
        differ = root[a] != root[b]
        for x, y in zip(a[differ].tolist(), b[differ].tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    return np.array([find(x) for x in range(len(root))], np.int64)


# ---- links ----------------------------------------------------------------------------------------


def _block_pairs(value: Column, width: int) -> list[Column]:
    """The six pairs of the four width-bit blocks of value, each with the number of the pair above."""
    mask = (1 << width) - 1
    block = [F.shiftrightunsigned(value, width * k).bitwiseAND(F.lit(mask)) for k in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    return [(F.lit(n).cast("long") * (1 << (2 * width))) + block[i] * (1 << width) + block[j] for n, (i, j) in enumerate(pairs)]


def block_keys(nodes: DataFrame) -> DataFrame:
    """nodes(fp) of 64 bits -> fp, keys, finer(position in keys -> array of further keys)."""
    value = F.conv(F.hex("fp"), 16, -10).cast("long")
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]

    def rest(i: int, j: int) -> Column:  # the 32 bits outside the pair
        a, b = (k for k in range(4) if k not in (i, j))
        part = [F.shiftrightunsigned(F.col("v"), 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in (a, b)]
        return part[0] * 65536 + part[1]

    return nodes.select("fp", value.alias("v")).select(
        "fp", F.array(*_block_pairs(F.col("v"), 16)).alias("keys"), F.array(*(F.array(*_block_pairs(rest(i, j), 8)) for i, j in pairs)).alias("finer")
    )


def block_pairs(blocks: Column, of: Column) -> Column:
    """The numbers of all pairs of blocks that a row takes part in; ``of`` (a hash) tells its own block."""
    own = F.pmod(of, blocks)
    return F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda other: F.least(own, other) * blocks + F.greatest(own, other))


def sketch_shards(prints: DataFrame, max_shard: int = SKETCH_SHARD) -> DataFrame:
    """prints(fp, keys) -> (fp, key, fine): the nodes of each key, those of large keys by pairs of blocks."""
    rows = prints.select("fp", F.explode("keys").alias("key")).distinct()
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    blocks = F.ceil(F.col("members") / max_shard)
    return rows.join(sizes, "key").select("fp", "key", F.explode(block_pairs(blocks, F.xxhash64("fp"))).alias("fine"))


def stars(keyed: DataFrame, radius: int, max_shard: int = MAX_SHARD) -> DataFrame:
    """keyed(fp, keys, finer) -> (fp, root): links within the shards, one star for each local component."""
    rows = keyed.select("fp", F.posexplode("keys").alias("n", "key"), "finer").select("fp", "key", F.get("finer", F.col("n")).alias("finer"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    sized = rows.join(sizes, "key")
    fine = sized.filter(F.col("members") > max_shard).select("fp", "key", F.explode("finer").alias("fine"))
    shards = sized.filter(F.col("members") <= max_shard).select("fp", "key", F.lit(None).cast("long").alias("fine")).unionByName(fine)
    return shard_stars(shards, radius)


def shard_stars(shards: DataFrame, radius: int) -> DataFrame:
    """shards(fp, key, fine) -> (fp, root): one star for each local component of a shard."""

    def solve(table: pa.Table) -> pa.Table:
        raw = table.column("fp").to_pylist()
        if len(raw) < 2:
            return table.schema.empty_table().select(["fp"]).append_column("root", pa.array([], pa.binary()))
        raw = sorted(set(raw))
        fps = np.frombuffer(b"".join(raw), ">u8").astype(np.uint64).reshape(len(raw), -1)
        root = local_roots(fps, radius)
        moved = np.nonzero(root != np.arange(len(raw)))[0]
        return pa.table({"fp": pa.array([raw[k] for k in moved], pa.binary()), "root": pa.array([raw[root[k]] for k in moved], pa.binary())})

    return shards.groupBy("key", "fine").applyInArrow(solve, "fp binary, root binary").distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """edges(fp, root) -> fp, root: the smallest fp that each node of an edge reaches.

    Alternates large-star and small-star steps until the edges no longer change; each round is cut by
    a checkpoint. The number of rounds grows with the logarithm of a component's size; if max_rounds aren't
    enough, the run fails.
    """
    edges = cut(edges.filter("fp <> root").select(F.greatest("fp", "root").alias("fp"), F.least("fp", "root").alias("root")).distinct())

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("fp", "root"))).first())

    last = mark(edges)
    for _ in range(max_rounds):
        if not last[0]:
            return edges
        both = edges.unionByName(edges.select(F.col("root").alias("fp"), F.col("fp").alias("root")))
        low = both.groupBy("fp").agg(F.least(F.min("root"), F.first("fp")).alias("low"))
        large = both.filter("root > fp").join(low, "fp").select(F.col("root").alias("fp"), F.col("low").alias("root")).filter("fp <> root").distinct()
        least = large.groupBy("fp").agg(F.min("root").alias("low"))
        small = large.join(least, "fp").select(F.col("root").alias("fp"), F.col("low").alias("root")).filter("fp <> root").unionByName(
            least.select("fp", F.col("low").alias("root"))
        )
        edges = cut(small.distinct())
        now = mark(edges)
        if now == last:
            return edges
        last = now
    raise RuntimeError(f"components aren't finished after {max_rounds} rounds")


def link(prints: DataFrame, keyed: Callable[[DataFrame], DataFrame], radius: int, max_shard: int = MAX_SHARD) -> DataFrame:
    """prints(doc_id, fp) -> fp, component_id: the smallest doc_id of the fingerprint's component."""
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low_id")))
    return named(nodes, components(stars(keyed(nodes), radius, max_shard)))


def named(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """nodes(fp, low_id), roots(fp, root) -> fp, component_id."""
    rooted = nodes.select("fp", "low_id").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("low_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def op4(docs: DataFrame) -> DataFrame:
    """Three-word shingles, one 64-bit block, links at two or fewer differing bits."""
    prints = cut(fingerprints(docs, words=3))
    linked = link(prints, block_keys, radius=2)
    return prints.join(linked, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


# ---- near copies by shingle sets -------------------------------------------------------------------


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, node (a 128-bit hash of the set) and shingles (the sorted set's bytes)."""

    def per_batch(texts: list[str]) -> list[pa.Array]:
        sets = [np.unique(shingle_hashes(text, words)).tobytes() for text in texts]
        return [pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())]

    return map_texts(docs, per_batch, "node binary, shingles binary")


def set_roots(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the first of its component, linked at a Jaccard similarity of ``similarity`` or more.

    Each set in turn is compared with the later ones that aren't in its component yet and whose size allows the similarity.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    _, tokens = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    marked = np.zeros(len(tokens) + 1, bool)
    root = np.arange(n)
    for one in range(n):
        later = np.arange(one + 1, n)
        least, most = np.minimum(sizes[one], sizes[later]), np.maximum(sizes[one], sizes[later])
        later = later[(root[later] != root[one]) & (least + 1e-9 >= similarity * most)]
        if not len(later):
            continue
        own = tokens[starts[one] : starts[one + 1]]
        marked[own] = True
        ends = np.cumsum(sizes[later])
        at = np.arange(ends[-1]) + np.repeat(starts[later] - ends + sizes[later], sizes[later])
        hits = np.concatenate([[0], np.cumsum(marked[tokens[at]])])
        both = hits[ends] - hits[ends - sizes[later]]
        marked[own] = False
        found = later[both + 1e-9 >= similarity * (sizes[one] + sizes[later] - both)]
        if len(found):
            joined = np.unique(root[np.append(found, one)])
            root[np.isin(root, joined)] = joined[0]
    return root


def verified(sets: DataFrame, similarity: float, most_bytes: int = BLOCK_BYTES, most_rows: int = BLOCK_ROWS) -> DataFrame:
    """sets(root, node, shingles) -> (fp, root), both of them nodes: stars of exact links within each candidate group.

    A group that is larger than a block is dealt into blocks, of which each pair is compared.
    """
    nodes = sets.groupBy("root", "node").agg(F.first("shingles").alias("shingles"))
    sizes = sets.select("root", "node", F.length("shingles").alias("bytes")).distinct().groupBy("root").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("members"))
    blocks = sizes.filter("members > 1").select("root", F.greatest(F.ceil(F.col("bytes") / most_bytes), F.ceil(F.col("members") / most_rows)).alias("blocks"))
    dealt = nodes.join(blocks, "root").select("root", "node", "shingles", F.explode(block_pairs(F.col("blocks"), F.xxhash64("node"))).alias("fine"))

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        raw = table.column("node").to_pylist()
        root = set_roots([np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()], similarity)
        moved = np.nonzero(root != np.arange(len(raw)))[0]
        return pa.table({"fp": pa.array([raw[k] for k in moved], pa.binary()), "root": pa.array([raw[root[k]] for k in moved], pa.binary())})

    return dealt.groupBy("root", "fine").applyInArrow(solve, "fp binary, root binary").distinct()


def wide_radius(similarity: float, bits: int) -> int:
    """Bits in which texts of that similarity differ at most, but for four standard deviations and what sets of under ten shingles add.

    For equal sizes, the worst case, a Jaccard similarity j is a cosine of 2j/(1+j), and a bit differs
    with a probability of the angle over pi.
    """
    apart = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return round(bits * 1.25 * apart + 4 * np.sqrt(bits * apart * (1 - apart)))


def drop_near_copies(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, blocks: int = 4, max_shard: int = SKETCH_SHARD, most_bytes: int = BLOCK_BYTES, most_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays, with all its columns.

    Links are at a Jaccard similarity of shingle sets of ``similarity`` or more. The fingerprints give
    candidate groups, linked within a wide radius; inside these the sets themselves are compared.
    Null doc_ids come last; of documents that share a doc_id each is judged by its own text, and of a
    group's documents with the smallest doc_id the one with the smallest hash stays. Repeated rows of the
    document that stays are left to exact dedup, and stay.
    """
    of = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.xxhash64(text_of(docs)).alias("of"))
    whole = docs.select(of.alias("doc_id"), "text")  # ids may be null or repeat
    prints = cut(fingerprints(whole, words, blocks, sketch=True).select("doc_id.of", "fp", "keys"))
    near = components(shard_stars(sketch_shards(prints, max_shard), wide_radius(similarity, 64 * blocks)))
    grouped = prints.select("of", "fp").join(near, "fp", "left").select("of", F.coalesce("root", "fp").alias("root"))
    several = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    asked = grouped.join(several, "root").select("of", "root").distinct()
    texts = whole.withColumn("of", F.col("doc_id.of")).join(asked, "of").select(F.struct("doc_id", "root").alias("doc_id"), "text")
    sets = cut(shingle_sets(texts, words).select("doc_id.doc_id", "doc_id.root", "node", "shingles"))
    nodes = sets.groupBy("node").agg(F.min("doc_id").alias("low_id")).withColumnRenamed("node", "fp")
    linked = named(nodes, components(verified(sets, similarity, most_bytes, most_rows)))
    dropped = sets.join(linked, sets["node"] == linked["fp"]).filter("doc_id <> component_id").select(F.col("doc_id").alias("__near_id")).distinct()
    return docs.join(dropped, of == F.col("__near_id"), "left_anti")
