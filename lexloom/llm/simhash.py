"""SimHash near-duplicates (Charikar 2002): 64-bit fingerprints, linked by BK-trees over shards, joined to components.

Fingerprints. A text's ASCII letters are lower-cased, its words (runs without ASCII white space) form shingles, repeats
included; a bit is set if it is set in more than half of the shingles' XXH64 hashes.

Links. Two fingerprints within `radius` differ in at most `radius` of eight bytes, so they agree on some 8 - radius of
them. Every distinct fingerprint goes to one shard for each choice of bytes to leave out (28 for radius 2); members of a
shard agree on all other bytes, so a shard holds at most 2**16 distinct fingerprints for radius 2, however many rows or
copies there are. Each shard builds a BK-tree: the children of a node are keyed by their integer Hamming distance to it.
All members search the tree together and follow only edges within the radius of their own distance.
The tree meets its probes by partition rather than by broadcast: trees over all fingerprints have no size bound, a shard has one.

Components. Each task joins the links of its shards in a local forest, then star steps join the forests of all tasks.
Copies share a fingerprint and are counted once; they never form pairs.

Defined results: a null or empty text has fingerprint 0 and is linked like any other; repeated rows are all labelled and stay
once; rows of one id with unlike texts are rows of their own; a null doc_id never is the smallest, a component of nulls only
has a null id and keeps one row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import drop_stored, fresh, row_hash, small_batches, stored
from lexloom.llm.components import components

SEED, RADIUS, SHINGLE = 42, 2, 3
BYTES = 8


def fingerprint(text: bytes | None, k: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text in UTF-8."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < k:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(k)))))
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    for i in range(0, len(shingles), 4096):
        part = np.frombuffer(b"".join([digest(s, SEED) for s in shingles[i : i + 4096]]), np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, row_key (a hash of the whole row) and fp, the fingerprint's 64 bits as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, k) for t in batch.column(2).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], ["doc_id", "row_key", "fp"])

    return docs.select("doc_id", row_hash(docs).alias("row_key"), "text").mapInArrow(run, "doc_id long, row_key long, fp long")


def bk_links(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Index pairs that connect all of the distinct fps (uint64) within radius of each other, by a BK-tree.

    The tree grows from subsets: a node takes the first of a subset, the rest split into children by integer distance to
    it. The search of all members runs along: at a node, those within the radius are linked to it, and each child
    edge d is followed by those with a distance in d - radius .. d + radius.
    """
    links: list[tuple[int, int]] = []
    everyone = np.arange(len(fps))
    stack = [(everyone, everyone)]
    while stack:
        members, probes = stack.pop()
        node, rest = members[0], members[1:]
        far = np.bitwise_count(fps[probes] ^ fps[node])
        links += [(int(p), int(node)) for p in probes[far <= radius] if p > node]
        if not len(rest):
            continue
        edge = np.bitwise_count(fps[rest] ^ fps[node])
        for d in np.unique(edge):
            follow = probes[(far >= max(0, int(d) - radius)) & (far <= int(d) + radius)]
            if len(follow):
                stack.append((rest[edge == d], follow))
    return links


class _Forest:
    """Union-find whose roots are the least members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    def join(self, x: int, y: int) -> None:
        x, y = sorted((self.root(x), self.root(y)))
        if x != y:
            self.up[y] = x


def shard_masks(radius: int = RADIUS) -> list[int]:
    """For each choice of `radius` bytes the mask, as a signed long, of all other bits."""
    full = (1 << 64) - 1
    masks = [full ^ sum(0xFF << 8 * b for b in out) for out in combinations(range(BYTES), radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fps(fp) whose components are those of all pairs within radius."""
    masks = shard_masks(radius)
    sharded = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("shard", "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()

        def search(fp: np.ndarray) -> None:
            for i, j in bk_links(fp.view(np.uint64), radius):
                forest.join(int(fp[i]), int(fp[j]))

        kept: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            shard, key, fp = (batch.column(i).to_numpy() for i in range(3))
            if kept is not None:
                shard, key, fp = (np.concatenate(x) for x in zip(kept, (shard, key, fp)))
            cuts = np.flatnonzero((shard[1:] != shard[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate([[0], cuts])
            sizes = np.diff(np.concatenate([starts, [len(fp)]]))
            for i in np.flatnonzero(sizes[:-1] > 1):  # the last shard may go on in the next batch
                search(fp[starts[i] : starts[i] + sizes[i]])
            kept = tuple(x[starts[-1] :] for x in (shard, key, fp))
        if kept is not None and len(kept[2]) > 1:
            search(kept[2])
        a = list(forest.up)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([forest.root(x) for x in a], pa.int64())], ["a", "b"])

    dealt = sharded.select("shard", "key", "fp").repartition("shard", "key").sortWithinPartitions("shard", "key", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def _components(marked: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """(fp, root), written, of every distinct fingerprint of marked(fp, ...), and what to drop in the end."""
    distinct = stored(marked.select("fp").distinct(), "simhash-distinct")
    joined = components(fingerprint_links(distinct, radius))
    named = distinct.join(joined, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("of_fp"), F.coalesce("root", "fp").alias("root"))
    return stored(named, "simhash-roots"), distinct


def near_duplicates(docs: DataFrame, radius: int = RADIUS, k: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed long) and component_id, the smallest doc_id that links reach, of every document."""
    marked = stored(fingerprints(docs, k), "simhash")
    roots, distinct = _components(marked, radius)
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    least = stored(least.join(roots, F.col("fp") == F.col("of_fp")).select("fp", "root", "least"), "simhash-least")
    ids = least.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component_id"))
    labels = stored(least.join(ids, F.col("root") == F.col("of")).select(F.col("fp").alias("of_fp"), "component_id"), "simhash-labels")
    for scratch in (distinct, roots, least):
        drop_stored(scratch)
    return marked.join(labels, F.col("fp") == F.col("of_fp")).select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, radius: int = RADIUS, k: int = SHINGLE) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, nulls last, and then of the smallest row hash.

    Rows are told apart by id and row hash, so rows of one id, or without an id, whose texts are unlike all stay. Texts move
    once, to meet the hashes of the rows that stay; only rows that occur several times as they are meet again, to stay once.
    """
    marked = stored(fingerprints(docs, k), "simhash")
    roots, distinct = _components(marked, radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))
    of_fp = marked.groupBy("fp").agg(first.alias("first"))
    kept = of_fp.join(roots, F.col("fp") == F.col("of_fp")).groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.row_key")
    rows = marked.groupBy(F.col("doc_id").alias("m_doc_id"), F.col("row_key").alias("m_row_key")).agg(F.count("*").alias("copies"))
    key, copies, doc_id = (fresh(c, docs) for c in ("row_key", "copies", "kept_id"))
    same = F.col("doc_id").eqNullSafe(F.col("m_doc_id")) & (F.col("row_key") == F.col("m_row_key"))
    kept = stored(kept.join(rows, same).select(F.col("doc_id").alias(doc_id), F.col("row_key").alias("kept_key"), F.col("copies").alias(copies)), "simhash-kept")
    for scratch in (marked, distinct, roots):
        drop_stored(scratch)
    keyed = docs.withColumn(key, row_hash(docs))
    found = keyed.join(kept.withColumnRenamed("kept_key", key + "_kept"), F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.col(key) == F.col(key + "_kept")))
    several = found.where(F.col(copies) > 1).dropDuplicates([doc_id, key])
    return found.where(F.col(copies) == 1).union(several).select(*docs.columns)
