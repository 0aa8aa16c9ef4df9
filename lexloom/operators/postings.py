"""Products of documents and what a token brings (vectors, concepts) without a row for every pair of the two.

Counted rows are gathered into chunks of whole documents, and each chunk into one row a distinct token with the documents that have it.
Those rows meet the tokens' table and return to their chunk, where Arrow and NumPy form the product. What a task holds is one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The last decimal that ranks weights. Counted rows after which a chunk ends, with its last document; rows of a batch that leaves a chunk; products formed at once.
NINTH = Decimal("1e-9")
CHUNK_ROWS, BATCH_ROWS, SLAB = 1_000_000, 2_000, 1_000_000


def gathered(tokens: DataFrame) -> DataFrame:
    """doc_id, token and n with all rows of a document together: rows of term_counts() as they are, others (doc_id, token) counted."""
    if "n" in tokens.columns:
        return tokens.select("doc_id", "token", "n")
    counted = tokens.groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    return counted.repartition("doc_id").sortWithinPartitions("doc_id")


def _codes(ids: pa.Array) -> tuple[np.ndarray, pa.Array]:
    encoded = ids.dictionary_encode(null_encoding="encode")
    return encoded.indices.to_numpy(), encoded.dictionary


def postings(tokens: DataFrame, totals: bool = False) -> DataFrame:
    """chunk, token, ids and ns: the documents of a chunk that have a token, and how often. With totals a row of each chunk has
    no token and the counts of all of a document's tokens."""
    doc_type = tokens.schema["doc_id"].dataType
    schema = T.StructType().add("chunk", "long").add("token", "string").add("ids", T.ArrayType(doc_type)).add("ns", T.ArrayType(T.LongType()))

    def chunk(number: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, n = table.column(0).combine_chunks(), table.column(2).to_numpy()
        codes, names = _codes(table.column(1).combine_chunks())
        order = np.argsort(codes, kind="stable")
        ends = np.searchsorted(codes[order], np.arange(len(names) + 1))
        ids_by, n_by = ids.take(pa.array(order)), n[order]
        for first in range(0, len(names), BATCH_ROWS):
            last = min(first + BATCH_ROWS, len(names))
            a, b = ends[first], ends[last]
            at = pa.array((ends[first : last + 1] - a).astype(np.int32))
            lists = pa.ListArray.from_arrays(at, ids_by.slice(a, b - a)), pa.ListArray.from_arrays(at, pa.array(n_by[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(last - first, number)), names.slice(first, last - first), *lists], schema.names)
        if totals:
            docs, every = _codes(ids)
            sums = np.bincount(docs, weights=n, minlength=len(every)).astype(np.int64)
            at = pa.array([0, len(every)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([None], pa.string()), pa.ListArray.from_arrays(at, every), pa.ListArray.from_arrays(at, pa.array(sums))], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, rows = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            if rows >= CHUNK_ROWS:
                # the chunk ends where the last document of the rows held does
                both, _ = _codes(pa.concat_arrays([held[-1].column(0).slice(len(held[-1]) - 1), batch.column(0)]))
                other = np.flatnonzero(both[1:] != both[0])
                cut = int(other[0]) if len(other) else len(batch)
                held.append(batch.slice(0, cut))
                batch = batch.slice(cut)
                if not len(batch):
                    continue
                yield from chunk(number, held)
                number, held, rows = number + 1, [], 0
            if len(batch):
                held.append(batch)
                rows += len(batch)
        if held:
            yield from chunk(number, held)

    return gathered(tokens).mapInArrow(run, schema)


def _lists(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All elements of a column of lists, and the length of each list."""
    one = column.combine_chunks()
    return one.flatten(), one.value_lengths().fill_null(0).to_numpy().astype(np.int64)


def _by_document(table: pa.Table):
    """Documents of a chunk (codes and ids), and per posting by document: its code, the row of its token and n."""
    ids, lengths = _lists(table.column("ids"))
    n = _lists(table.column("ns"))[0].to_numpy()
    codes, docs = _codes(ids)
    order = np.argsort(codes, kind="stable")
    return docs, codes[order], np.repeat(np.arange(len(lengths)), lengths)[order], n[order]


def vector_means(tokens: DataFrame, embeddings: DataFrame) -> DataFrame:
    """doc_id and mean: the sum of the vectors of a document's tokens, embeddings(term, vec), over the number of its tokens.
    Documents without a known token have no row."""
    doc_type = tokens.schema["doc_id"].dataType
    schema = T.StructType().add("doc_id", doc_type).add("mean", T.ArrayType(T.DoubleType()))

    def product(table: pa.Table) -> pa.Table:
        table = table.sort_by("token")  # sums do not depend on the order of arrival; nulls come last
        known = table.filter(table.column("token").is_valid())
        totals = table.filter(table.column("token").is_null())
        if not len(known):
            return pa.Table.from_arrays([pa.array([], t) for t in (table.schema.field("ids").type.value_type, pa.list_(pa.float64()))], schema.names)
        (single, short), (double, long) = _lists(known.column("single")), _lists(known.column("vec"))
        lengths = short + long  # one of both is null, and has no elements
        width = int(lengths.max(initial=0))
        vectors = np.zeros((len(known), width))  # short vectors end in zeros
        for x, own in ((single, short), (double, long)):
            vectors[np.arange(width) < own[:, None]] = x.fill_null(0.0).to_numpy()
        docs, codes, rows, n = _by_document(known)
        starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, int)
        sums, reach = np.zeros((len(docs), width)), np.zeros(len(docs), np.int64)
        step = max(SLAB // max(width, 1), 1)
        for first in range(0, len(codes), step):  # a slab may begin or end within a document
            part = slice(first, first + step)
            c = codes[part]
            at = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            sums[c[at]] += np.add.reduceat(vectors[rows[part]] * n[part, None], at)
        if len(codes):
            reach[codes[starts]] = np.maximum.reduceat(lengths[rows], starts)
        ids, _ = _lists(totals.column("ids"))
        place, every = _codes(pa.concat_arrays([docs, ids]))
        whole = np.zeros(len(every))
        whole[place[len(docs) :]] = _lists(totals.column("ns"))[0].to_numpy()
        total = whole[place[: len(docs)]]
        kept = np.arange(width) < reach[:, None]
        means = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(reach)).astype(np.int32)), pa.array((sums / total[:, None])[kept]))
        return pa.Table.from_arrays([docs, means], schema.names)

    # vectors that are single precision without loss travel so
    vec = F.col("vec").cast("array<double>")
    exact = F.coalesce(F.forall(vec, lambda x: x == x.cast("float").cast("double")), F.lit(False))
    vectors = embeddings.where("term is not null and vec is not null").select(F.col("term").alias("token"), F.when(exact, vec.cast("array<float>")).alias("single"), F.when(~exact, vec).alias("vec"))
    rows = postings(tokens, totals=True).join(vectors, "token", "left")
    rows = rows.where("single is not null or vec is not null or token is null").select("chunk", "token", "ids", "ns", "single", "vec")
    return rows.groupBy("chunk").applyInArrow(product, schema)


def heaviest(tokens: DataFrame, index: DataFrame, limit: int) -> DataFrame:
    """doc_id, concept_id and weight, the sum of n times weight over a document's tokens in index(token, concept_id, weight): each
    document's `limit` heaviest by the ninth decimal, ties to smaller ids."""
    doc_type, concept_type = tokens.schema["doc_id"].dataType, index.schema["concept_id"].dataType
    schema = T.StructType().add("doc_id", doc_type).add("concept_id", concept_type).add("weight", "double")

    def product(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.sort_by("token")
        docs, codes, rows, n = _by_document(table)
        concepts, lengths = _lists(table.column("concepts"))
        weights = _lists(table.column("weights"))[0].to_numpy()
        concept, names = _codes(concepts)
        begins, pairs = np.append(0, np.cumsum(lengths))[:-1], np.append(0, np.cumsum(lengths[rows]))
        starts = np.searchsorted(codes, np.arange(len(docs) + 1))
        first = 0
        while first < len(docs):  # whole documents, with as many products as a slab has, or one document
            last = max(first + 1, int(np.searchsorted(pairs[starts], pairs[starts[first]] + SLAB, side="right")) - 1)
            part = slice(starts[first], starts[last])
            long = lengths[rows[part]]
            at = np.repeat(begins[rows[part]] - (pairs[:-1][part] - pairs[starts[first]]), long) + np.arange(long.sum())
            keys, key = np.unique(np.repeat(codes[part] - first, long) * len(names) + concept[at], return_inverse=True)
            sums = np.bincount(key, weights=np.repeat(n[part], long) * weights[at], minlength=len(keys))
            doc = keys // max(len(names), 1)
            order = np.lexsort((-sums, doc))
            ends = np.searchsorted(doc, np.arange(last - first + 1))
            least = np.full(last - first, -np.inf)
            many = np.flatnonzero(np.diff(ends) > limit)
            least[many] = sums[order][ends[many] + limit - 1]
            kept = sums >= least[doc] - 2e-9
            for d in np.flatnonzero(np.bincount(doc[kept], minlength=last - first) > limit):  # only rounding tells the last of them
                near = np.arange(ends[d], ends[d + 1])[kept[ends[d] : ends[d + 1]]]
                ids = names.take(pa.array(keys[near] % len(names))).to_pylist()
                rank = sorted(range(len(near)), key=lambda i: (-Decimal(repr(float(sums[near[i]]))).quantize(NINTH, ROUND_HALF_UP), ids[i]))
                kept[near[rank[limit:]]] = False
            ids = docs.take(pa.array(doc[kept] + first)), names.take(pa.array(keys[kept] % max(len(names), 1)))
            yield pa.RecordBatch.from_arrays([*ids, pa.array(sums[kept])], schema.names)
            first = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from product(pa.Table.from_batches(list(batches)))

    by_token = index.groupBy("token").agg(F.collect_list(F.struct("concept_id", F.col("weight").cast("double").alias("weight"))).alias("c"))
    rows = postings(tokens).join(by_token, "token").select("chunk", "token", "ids", "ns", F.col("c.concept_id").alias("concepts"), F.col("c.weight").alias("weights"))
    return rows.groupBy("chunk").applyInArrow(run, schema)
