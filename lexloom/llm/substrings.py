"""Exact-substring deduplication: every byte covered by a `length`-byte string that also starts anywhere else.

Dealing. A place where a string starts is owned by its anchor: the leftmost of the GRAM-byte strings with the smallest hash among those
within the SUB bytes from there. Equal strings of SUB bytes or more have equal anchors at equal places, so all that can match meets under
one anchor. The starts that follow each other under one anchor form an occurrence; the bytes from the first start to `length`
after the last (or the text's end) are its context. Only hashes of anchors and contexts are shuffled, pre-aggregated: equal contexts
(whole copies, however many) are one row with a count, and those counted twice are repeats as they stand. Contexts are fetched
only for anchors that have several different ones.

Sorting. Contexts of the same anchors lie in one shard text of bounded size, whose suffixes are put in order of their first
`length` bytes by two-stage sorting (Itoh and Tanaka 1999): suffixes smaller than their successors are sorted directly, all others
are induced by a scan of the first-byte buckets in ascending order. Adjacent starts with a common prefix of `length` bytes
are repeats. An anchor with more than SHARD_CONTEXTS different contexts (a passage in very many surroundings) is
not sorted in one place: blocks of its windows, aligned by their distance from the anchor, are counted by the hashes of the bytes that all
windows of a block hold and of the bytes that any holds; single windows, by the hash of all their bytes, only where these two leave it open.

Passages. The same common prefixes tell which documents share a passage of PASSAGE_WORDS words (of SUB bytes at least) or of `length`
bytes: at each word start, a prefix that holds so many words marks the document, even where too few bytes repeat to remove any.

Defined results: a null text is empty; texts shorter than `length` lose nothing; repeated rows (equal doc_id and text) are copies of
each other; overlapping repeats count; a null doc_id is an id like any other; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import drop_stored, small_batches, stored

LENGTH, SUB, GRAM = 400, 250, 80
#: Words in a row that make a passage.
PASSAGE_WORDS = 50
#: Bytes hashed at once; bytes of a shard text; different contexts of one anchor that share a shard.
SEGMENT, SHARD_BYTES, SHARD_CONTEXTS = 1 << 20, 1 << 18, 512
#: Starts of a crowded anchor that are judged together.
BLOCK = 16

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers: list[np.ndarray] = []
_PLACE = np.uint64(SEGMENT - 1)


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        for base in (_MULTIPLIER, _INVERSE):
            p = np.full(SEGMENT + 1, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


class _Hashes:
    """64-bit hashes of any substrings of some bytes, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power_tables()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def between(self, a: np.ndarray | slice, b: np.ndarray | slice) -> np.ndarray:
        h = (self.sums[b] - self.sums[a]) * self.down[a]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by running minima within blocks of w from both sides."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


def word_reach(data: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of words that others follow, and where `words` words from each end."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    n = max(len(starts) - words + 1, 0)
    return starts[:n], ends[words - 1 :] if n else ends[:0]


def occurrences(text: bytes, length: int = LENGTH, sub: int = SUB, gram: int = GRAM, words: int = PASSAGE_WORDS) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, first start, number of starts, those of them that `length` bytes follow, bytes of the context,
    whether it holds a passage) of a text's anchors.

    Texts over SEGMENT bytes go in segments that overlap by length - 1 bytes: each start is in one, and its anchor depends
    on the bytes after it only.
    """
    parts = []
    step = SEGMENT - length + 1
    for base in range(0, max(len(text) - sub + 1, 0), step):
        data = np.frombuffer(text, np.uint8, min(SEGMENT, len(text) - base), base)
        n_starts = min(len(data) - sub + 1, step)
        if n_starts <= 0:
            continue
        own = _Hashes(data)
        hashes = own.between(slice(0, len(data) - gram + 1), slice(gram, None))
        keys = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        place = (_window_min(keys, sub - gram + 1) & _PLACE).astype(np.int64)[:n_starts]
        first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        count = np.diff(np.concatenate([first, [n_starts]]))
        anchor = place[first]
        end = np.minimum(first + count - 1 + length, len(data))
        context = own.between(first, end) + (anchor - first).astype(np.uint64)
        full = np.clip(len(data) - length + 1 - first, 0, count)
        at, reach = word_reach(data, words)
        which = np.searchsorted(first, at, "right") - 1
        inside = (at < n_starts) & (reach - at >= sub) & (reach <= end[which])
        passage = full > 0
        passage[which[inside]] = True
        parts.append((hashes[anchor].view(np.int64), context.view(np.int64), first + base, count, full, end - first, passage))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else tuple(np.empty(0, np.int64) for _ in range(7))


def two_stage_order(data: bytes, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffix starts of data in order of their first `depth` bytes, by two-stage sorting.

    wanted: which suffixes to order; with each run of them go those after it up to the next that is smaller than its successor, as
    an induced suffix takes its place from the one that follows it.
    """
    t = np.frombuffer(data, np.uint8).astype(np.int64)
    n = len(t)
    if n == 0:
        return np.empty(0, np.int64)
    # a suffix is smaller than its successor if the next different byte is greater; past the end all is smaller
    after = np.append(t[1:], -1)
    runs = np.flatnonzero(t != after)
    small = (t < after)[runs[np.searchsorted(runs, np.arange(n))]]
    taken = np.ones(n, bool) if wanted is None else wanted.copy()
    if wanted is not None:
        ends = np.flatnonzero(wanted & ~np.append(wanted[1:], True)) + 1
        seeds = np.append(np.flatnonzero(small), n - 1)
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, ends, 1)
        np.add.at(change, seeds[np.searchsorted(seeds, ends)] + 1, -1)
        taken |= np.cumsum(change[:n]) > 0
    size = np.bincount(t[taken], minlength=256)
    base = np.concatenate([[0], np.cumsum(size)[:-1]])
    induced = np.bincount(t[taken & ~small], minlength=256)
    order, rank = np.empty(int(size.sum()), np.int64), np.full(n + 1, -1, np.int64)
    direct = sorted(np.flatnonzero(taken & small).tolist(), key=lambda i: data[i : i + depth])
    if direct:
        d = np.array(direct, np.int64)
        c = t[d]
        within = np.arange(len(d)) - np.searchsorted(c, c)
        spot = base[c] + induced[c] + within
        order[spot], rank[d] = d, spot
    large = np.flatnonzero(taken & ~small)
    large = large[np.argsort(t[large], kind="stable")]
    bounds = np.searchsorted(t[large], np.arange(257))
    for c in np.flatnonzero(induced):
        todo = large[bounds[c] : bounds[c + 1]]
        spot = base[c]
        below = after[todo] < c
        ready, waiting = todo[below], todo[~below]
        while len(ready):
            ready = ready[np.argsort(rank[ready + 1], kind="stable")]
            order[spot : spot + len(ready)] = ready
            rank[ready] = np.arange(spot, spot + len(ready))
            spot += len(ready)
            if not len(waiting):
                break
            known = rank[waiting + 1] >= 0
            ready, waiting = waiting[known], waiting[~known]
    return order


def shard_repeats(contexts: list[tuple[bytes, int, int]], length: int = LENGTH, sub: int = SUB, words: int = PASSAGE_WORDS) -> list[tuple[np.ndarray, bool]]:
    """For each context (bytes, starts, starts that `length` bytes follow) the starts whose `length` bytes also start at another
    place in the shard, and whether a passage does."""
    data = b"\xff".join(b for b, *_ in contexts) + b"\xff"  # no text holds this byte, so nothing matches past a context
    offset = np.cumsum([0] + [len(b) + 1 for b, *_ in contexts])
    valid, full, need = np.zeros(len(data), bool), np.zeros(len(data), bool), np.full(len(data), length)
    for at, (b, n, whole) in zip(offset, contexts):
        valid[at : at + n] = True
        full[at : at + whole] = True
        starts, reach = word_reach(np.frombuffer(b, np.uint8), words)
        inside = (starts < n) & (reach - starts >= sub) & (reach - starts < length)
        need[at + starts[inside]] = (reach - starts)[inside]
    order = two_stage_order(data, length, valid)
    order = order[valid[order]]
    own = _Hashes(np.frombuffer(data, np.uint8))
    repeated, passage = np.zeros(len(data), bool), np.zeros(len(data), bool)

    def alike(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Where n bytes from x and from y are equal: hashes rule out nearly all that are not, bytes decide."""
        within = np.maximum(x, y) + n <= len(data)
        x, y, n, at = x[within], y[within], n[within], np.flatnonzero(within)
        same = own.between(x, x + n) == own.between(y, y + n)
        return np.array([i for i, a, b, k in zip(at[same].tolist(), x[same].tolist(), y[same].tolist(), n[same].tolist()) if data[a : a + k] == data[b : b + k]], np.int64)

    before, behind = order[:-1], order[1:]
    hit = alike(before, behind, np.full(len(before), length))
    repeated[before[hit]] = repeated[behind[hit]] = True
    for x, y in ((before, behind), (behind, before)):
        short = need[x] < length
        x, y = x[short], y[short]
        passage[x[alike(x, y, need[x])]] = True
    repeated &= full
    passage |= repeated
    return [(np.flatnonzero(repeated[at : at + n]), bool(passage[at : at + n].any())) for at, (_, n, _) in zip(offset, contexts)]


_MARK = "anchor long, ctx long, first int, n int"


def _mark_rows(anchors: list[int], ctxs: list[int], found: list[tuple[np.ndarray, bool]]) -> pa.RecordBatch:
    """Runs of repeated starts of contexts; a run of none for a context that only shares a passage."""
    cells: list[list[int]] = [[], [], [], []]
    for a, c, (s, passage) in zip(anchors, ctxs, found):
        runs = [(int(r[0]), len(r)) for r in np.split(s, np.flatnonzero(np.diff(s) > 1) + 1)] if len(s) else [(0, 0)] * passage
        for first, n in runs:
            for cell, x in zip(cells, (a, c, first, n)):
                cell.append(x)
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cells, kinds)], ["anchor", "ctx", "first", "n"])


def _sorted_marks(contexts: DataFrame, length: int, sub: int, words: int) -> DataFrame:
    """Marks of the contexts of anchors that fit a shard, but for those that repeat as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[bytes, int, int]] = {}
        whole: set[tuple[int, int]] = set()
        size, last = 0, None

        def done() -> pa.RecordBatch:
            found = [(k, x) for k, x in zip(held, shard_repeats(list(held.values()), length, sub, words)) if k not in whole]
            return _mark_rows([a for (a, _), _ in found], [c for (_, c), _ in found], [x for _, x in found])

        for batch in batches:
            for anchor, ctx, n, full, copies, data in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if anchor != last and size >= SHARD_BYTES:
                    yield done()
                    held, size = {}, 0
                    whole.clear()
                last = anchor
                if (anchor, ctx) not in held:
                    held[anchor, ctx] = data, n, full
                    size += len(data)
                if copies > 1:
                    whole.add((anchor, ctx))
        if held:
            yield done()

    dealt = contexts.select("anchor", "ctx", "n", "full", "copies", "data").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, _MARK)


def _windows(data: bytes, n: int, full: int, length: int, sub: int, words: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start, end) of the windows of `length` bytes, and of the shorter passages, of a context."""
    starts, reach = word_reach(np.frombuffer(data, np.uint8), words)
    inside = (starts < n) & (reach - starts >= sub) & (reach - starts < length)
    return [(i, i + length) for i in range(full)], list(zip(starts[inside].tolist(), reach[inside].tolist()))


def blocks(data: bytes, n: int, full: int, length: int = LENGTH, sub: int = SUB, gram: int = GRAM, words: int = PASSAGE_WORDS) -> list[tuple[bool, int, int, bytes, bytes]]:
    """(whether of passages, first start, last start, 128-bit hashes of core and piece) of the windows of a context, by blocks of BLOCK
    distances from the anchor.

    The core is what any window that starts in the block holds, the piece all that those of this context hold: equal windows
    lie in blocks of equal cores, and equal pieces have equal windows only.
    """
    hashes = _Hashes(np.frombuffer(data, np.uint8, sub)).between(slice(0, sub - gram + 1), slice(gram, None))
    place = int(((hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)).argmin())  # the first start's anchor is that of all
    width = min(BLOCK, sub)
    rows = []
    for passage, (windows, least) in enumerate(zip(_windows(data, n, full, length, sub, words), (length, sub))):
        for k, own in groupby(windows, lambda w: (place - w[0]) // width):
            (first, end), *more = own
            last, end = more[-1] if more else (first, end)
            latest = place - k * width
            core = xxhash.xxh3_128_digest(data[latest : latest - width + 1 + least])
            rows.append((bool(passage), first, last, core, xxhash.xxh3_128_digest(data[first:end])))
    return rows


def _halves(digests: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]


def _counted_marks(contexts: DataFrame, length: int, sub: int, gram: int, words: int, scratch: list[DataFrame]) -> DataFrame:
    """Marks of the contexts of all other anchors, by 128-bit hashes, counted. One row a block of windows says most: none repeats where
    the core is of one place, all do where the piece is of several. Only where a core has different pieces, each of these (not each
    place) makes one row a window. Contexts that repeat as a whole only are partners of others."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells: list[list] = [[] for _ in range(8)]
            for anchor, ctx, n, full, copies, data in zip(*(batch.column(i).to_pylist() for i in range(6))):
                for row in blocks(data, n, full, length, sub, gram, words):
                    for cell, x in zip(cells, (anchor, ctx, copies > 1, *row)):
                        cell.append(x)
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32())
            arrays = [pa.array(x, k) for x, k in zip(cells, kinds)] + _halves(cells[6]) + _halves(cells[7])
            yield pa.RecordBatch.from_arrays(arrays, ["anchor", "ctx", "whole", "passage", "first", "last", "ch", "cg", "h", "g"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells: list[list] = [[] for _ in range(5)]
            for anchor, ctx, n, full, data, unclear in zip(*(batch.column(i).to_pylist() for i in range(6))):
                windows = _windows(data, n, full, length, sub, words)
                for block in unclear:
                    for a, e in windows[block["passage"]]:
                        if block["first"] <= a <= block["last"]:
                            for cell, x in zip(cells, (anchor, ctx, -1 if block["passage"] else a, block["alone"], xxhash.xxh3_128_digest(data[a:e]))):
                                cell.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cells, kinds)] + _halves(cells[4]), ["anchor", "ctx", "first", "alone", "h", "g"])

    # one row a block of a context: a repeated row must not count as another place
    kind = "anchor long, ctx long, whole boolean, passage boolean, first int, last int, ch long, cg long, h long, g long"
    cuts = contexts.select("anchor", "ctx", "n", "full", "copies", "data").mapInArrow(cut, kind)
    cuts = stored(cuts.dropDuplicates(["anchor", "ctx", "passage", "first"]), "blocks")
    core, own = ["passage", "ch", "cg"], ("anchor", "ctx", "whole", "first", "last")
    pieces = stored(cuts.groupBy(*core, "h", "g").agg(F.count("*").alias("places"), *(F.first(c).alias(c) for c in own)), "pieces")
    several = pieces.groupBy(*core).agg(F.count("*").alias("pieces")).where("pieces > 1").select(*core)
    alone = ((F.col("places") == 1) & ~F.col("whole")).alias("alone")
    unclear = pieces.join(several, core).groupBy("anchor", "ctx").agg(F.collect_list(F.struct("passage", "first", "last", alone)).alias("open"))
    once = contexts.dropDuplicates(["anchor", "ctx"]).join(unclear, ["anchor", "ctx"]).select("anchor", "ctx", "n", "full", "data", "open")
    windows = stored(once.mapInArrow(expand, "anchor long, ctx long, first int, alone boolean, h long, g long"), "windows")
    twice = windows.groupBy("h", "g").agg(F.count("*").alias("places")).where("places > 1").select("h", "g")
    scratch += [cuts, pieces, windows]

    equal = cuts.where(~F.col("whole")).join(pieces.where("places > 1").select(*core, "h", "g"), [*core, "h", "g"])
    # of a passage, a run of none before all others
    equal = equal.select("anchor", "ctx", F.when(F.col("passage"), -1).otherwise(F.col("first")).alias("first"), F.when(F.col("passage"), 0).otherwise(F.col("last") - F.col("first") + 1).alias("n"))
    single = windows.where("alone").join(twice, ["h", "g"]).select("anchor", "ctx", "first", F.when(F.col("first") < 0, 0).otherwise(1).alias("n"))
    hit = equal.union(single).groupBy("anchor", "ctx").agg(F.array_sort(F.collect_set(F.struct("first", "n"))).alias("at"))
    before, behind = (lambda i: F.get("at", i - 1)), (lambda i: F.get("at", i + 1))
    starts = F.filter("at", lambda x, i: (x["n"] > 0) & F.coalesce(before(i)["first"] + before(i)["n"] != x["first"], F.lit(True)))
    ends = F.filter("at", lambda x, i: (x["n"] > 0) & F.coalesce(x["first"] + x["n"] != behind(i)["first"], F.lit(True)))
    zipped = F.zip_with(starts, ends, lambda a, b: F.struct(a["first"].alias("first"), (b["first"] + b["n"] - a["first"]).alias("n")))
    runs = F.when(F.size(zipped) > 0, zipped).otherwise(F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("n"))))
    return hit.select("anchor", "ctx", F.explode(runs).alias("r")).select("anchor", "ctx", "r.first", "r.n")


_FOUND = {"doc_id": pa.int64(), "text_key": pa.int64(), "anchor": pa.int64(), "ctx": pa.int64(), "start": pa.int64(), "n": pa.int32(), "full": pa.int32(), "size": pa.int32(), "passage": pa.bool_()}
_FETCHED = {"anchor": pa.int64(), "ctx": pa.int64(), "n": pa.int32(), "full": pa.int32(), "copies": pa.int64(), "contexts": pa.int64(), "data": pa.binary()}
_DDL = {pa.int64(): "long", pa.bool_(): "boolean", pa.int32(): "int", pa.binary(): "binary"}


def _ddl(kinds: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{c} {_DDL[k]}" for c, k in kinds.items())


def repeated_spans(docs: DataFrame, length: int = LENGTH, sub: int = SUB, gram: int = GRAM, words: int = PASSAGE_WORDS) -> DataFrame:
    """doc_id, text_key (XXH64 of the text) and spans: array of (start, end) in bytes, of documents that repeat `length` bytes or a
    passage. Spans may overlap, and are none if only a passage repeats; their union is what repeats."""
    small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, rows, size = [], [], 0
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for i, text in enumerate(texts):
                if text is not None and len(text) >= sub:
                    held.append(occurrences(text, length, sub, gram, words))
                    rows.append(np.full(len(held[-1][0]), i))
                    size += len(rows[-1])
                if held and (size > 1 << 16 or i + 1 == len(texts)):  # many texts a batch of Arrow
                    at = pa.array(np.concatenate(rows))
                    cells = [pa.array(np.concatenate(x)).cast(k) for x, k in zip(zip(*held), list(_FOUND.values())[2:])]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *cells], list(_FOUND))
                    held, rows, size = [], [], 0

    found = stored(keyed.mapInArrow(mark, _ddl(_FOUND)), "occurrences")
    # the first of each column are of one row: all are taken at once; which row it is doesn't matter
    own = ("doc_id", "text_key", "start", "n", "full", "size", "passage")
    contexts = stored(found.groupBy("anchor", "ctx").agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in own)), "contexts")
    several = contexts.groupBy("anchor").agg(F.count("*").alias("contexts")).where("contexts > 1")
    several = stored(several.withColumnRenamed("anchor", "of"), "several")
    wanted = contexts.join(several, F.col("anchor") == F.col("of"))
    per_doc = wanted.groupBy(F.col("doc_id").alias("w_doc_id"), F.col("text_key").alias("w_text_key")).agg(F.collect_list(F.struct("anchor", "ctx", "start", "size", "n", "full", "copies", "contexts")).alias("wanted"))
    on = F.col("doc_id").eqNullSafe(F.col("w_doc_id")) & (F.col("text_key") == F.col("w_text_key"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, rows in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                data = [text[r["start"] : r["start"] + r["size"]] for r in rows]
                cells = [pa.array([r[c] for r in rows], k) for c, k in list(_FETCHED.items())[:-1]]
                yield pa.RecordBatch.from_arrays([*cells, pa.array(data, pa.binary())], list(_FETCHED))

    fetched = stored(keyed.join(per_doc, on).select("text", "wanted").mapInArrow(fetch, _ddl(_FETCHED)), "context-bytes")
    scratch: list[DataFrame] = []
    whole = contexts.where("copies > 1 and passage").select("anchor", "ctx", F.lit(0).alias("first"), F.col("full").alias("n"))
    few, many = fetched.where(F.col("contexts") <= SHARD_CONTEXTS), fetched.where(F.col("contexts") > SHARD_CONTEXTS)
    marks = whole.union(_sorted_marks(few, length, sub, words)).union(_counted_marks(many, length, sub, gram, words, scratch))
    marks = stored(marks.select(F.col("anchor").alias("m_anchor"), F.col("ctx").alias("m_ctx"), "first", F.col("n").alias("run")), "marks")
    for old in (contexts, several, fetched, *scratch):
        drop_stored(old)
    hit = found.join(marks, (F.col("anchor") == F.col("m_anchor")) & (F.col("ctx") == F.col("m_ctx")))
    start = F.col("start") + F.col("first")
    span = F.when(F.col("run") > 0, F.struct(start.alias("start"), (start + F.col("run") - 1 + length).alias("end")))
    hit = stored(hit.select("doc_id", "text_key", span.alias("span")), "hits")
    for old in (found, marks):
        drop_stored(old)
    return hit.groupBy("doc_id", "text_key").agg(F.collect_list("span").alias("spans"))


def deduplicated(docs: DataFrame, length: int = LENGTH, sub: int = SUB, gram: int = GRAM, words: int = PASSAGE_WORDS) -> DataFrame:
    """doc_id, n_bytes, removed (array of maximal (start, end) runs in bytes), kept (the remaining bytes) and shared (whether
    a passage of it starts elsewhere as well) of every document."""
    spans = repeated_spans(docs, length, sub, gram, words).withColumnsRenamed({"doc_id": "s_doc_id", "text_key": "s_text_key"})
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    on = F.col("doc_id").eqNullSafe(F.col("s_doc_id")) & (F.col("text_key") == F.col("s_text_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, removed, kept = [], [], []
            shared = pc.is_valid(batch.column(2))
            for text, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                runs: list[list[int]] = []
                for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                sizes.append(len(text))
                removed.append([{"start": a, "end": b} for a, b in runs])
                edges = [0, *(x for r in runs for x in r), len(text)]
                kept.append(b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary()), shared], ["doc_id", "n_bytes", "removed", "kept", "shared"])

    joined = keyed.join(spans, on, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary, shared boolean")
