"""Token-ID output: texts to ids, ids to Huffman-coded files in ascending doc_id order, and back.

File format, a folder with two Parquet tables written by Spark's own committer, so lost executors leave no torn file:
  codebook  id, length: the canonical code (llm/huffman.py) of the whole collection
  blocks    shard, seq, shard_start, doc_ids, lengths, payload, checkpoints: a run of whole documents in doc_id order;
            payload holds their ids back to back, checkpoints the bit offset of every 256th id
Shards ascend with doc_id; shard_start counts the ids before a row within its shard, so a document's place among all ids
is a sum of shard totals (one number a shard) away.

Defined results: a null text is empty; null doc_ids come first; rows of one id go by a hash of their ids; repeated rows are all kept,
next to each other; an empty table gives empty tables; further columns are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexloom.llm import huffman
from lexloom.llm.common import Memory, drop_stored, small_batches, stored

#: Ids after which a row of blocks ends, at a document's end.
ROW_IDS = 1 << 20
#: Words and their ids that a worker keeps at most, but for one batch; words whose ids are gathered at once; texts of a batch.
POOL_WORDS, POOL_IDS, GATHER, BATCH = 1_000_000, 1 << 23, 1 << 16, 3072

_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRETOKENS = regex.compile(_SPLIT).findall
_ASCII_PRETOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+").findall
_ODD = regex.compile(r"[^\S ]|<\|").search
#: Stands for the end of a text among words; no word holds a space.
END = " "
_encoders: dict[int, "TextEncoder"] = {}


def _byte_characters() -> dict[int, str]:
    """The printable character that byte-level models use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Pool:
    """Ids of words, laid end to end: a word's number, its place among the known ones, gives where its ids start and how many they
    are. Forgets all when full."""

    def __init__(self, learn, dtype: str):
        self.learn, self.dtype = learn, np.dtype(dtype)
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.n, self.used = 0, 0
        self.starts, self.sizes, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, self.dtype)

    def add(self, rows: list[bytes]) -> np.ndarray:
        """Numbers of new rows of ids."""
        data = np.frombuffer(b"".join(rows), self.dtype)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // self.dtype.itemsize
        for name, need in (("starts", self.n + len(rows)), ("sizes", self.n + len(rows)), ("ids", self.used + len(data))):
            old = getattr(self, name)
            if need > len(old):
                new = np.zeros(max(need, 2 * len(old)), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        numbers = np.arange(self.n, self.n + len(rows))
        self.starts[numbers], self.sizes[numbers] = self.used + np.cumsum(sizes) - sizes, sizes
        self.ids[self.used : self.used + len(data)] = data
        self.n, self.used = self.n + len(rows), self.used + len(data)
        return numbers

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Numbers of distinct words; new ones are learned."""
        found = pc.index_in(words, value_set=self.known)
        out = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if found.null_count:
            new = words.filter(pc.is_null(found))
            first = self.add([self.learn(w) for w in new.to_pylist()])[0]
            out[out < 0] = np.arange(first, first + len(new))
            self.known = pa.concat_arrays([self.known, new])
        return out

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a row of words, and how many each word has."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes, dtype=np.int64)
        out = np.empty(int(ends[-1]) if len(ends) else 0, self.dtype)
        for i in range(0, len(numbers), GATHER):
            some, at = sizes[i : i + GATHER], int(ends[i] - sizes[i])
            upto = ends[i : i + GATHER] - at
            place = np.repeat(self.starts[numbers[i : i + GATHER]] - (upto - some), some)
            place += np.arange(len(place))
            out[at : at + len(place)] = self.ids[place]
        return out, sizes


class TextEncoder:
    """Encodes texts by a tokenizer of the tokenizers library, with ids of the narrowest of 16 and 32 bits.

    Where the tokenizer's file says that it drops white space and splits words by the usual pattern (no rule then crosses
    white space), a batch of texts is cut into words and dictionary-encoded by Arrow; each distinct word that is new is normalised and
    split once, the library's model encodes new pretokens, and the ids of all words are gathered by their dictionary numbers.
    Words with odd white space or special tokens, and all texts of other tokenizers, take the library's full path.
    """

    def __init__(self, spec: str, end_id: int | None = None):
        self.tokenizer = Tokenizer.from_str(spec)
        self.dtype = id_type(spec)
        self.suffix = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()
        said = json.loads(spec)
        steps = [n["type"] for n in (said.get("normalizer") or {}).get("normalizers", [])]
        parts = (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
        split = parts[0] if parts else {}
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in parts] == ["Split", "ByteLevel"] and split["pattern"] == {"Regex": _SPLIT} and split["invert"] and split["behavior"] == "Removed" and said["model"].get("end_of_word_suffix") == "</w>"
        self.model, self.code = self.tokenizer.model, "H" if self.dtype == "<u2" else "I"
        self.characters = _byte_characters()
        self._normal = self.tokenizer.normalizer.normalize_str if self.by_word else str
        self.pretokens, self.words = Memory(self._pretoken), _Pool(self._word, self.dtype)

    def _ids(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _pretoken(self, pretoken: str) -> bytes:
        shown = pretoken if pretoken.isascii() else pretoken.encode().decode("latin-1").translate(self.characters)
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _word(self, word: str) -> bytes:
        if word == END:
            return self.suffix
        # below U+0250 every character is in normal form C by itself and has one lower case
        normal = word.lower() if word.isascii() or max(word) < "\u0250" else self._normal(word)
        known = self.pretokens
        if normal.isalpha() and word.isalpha():  # by far the most
            return known[normal]
        if _ODD(word):
            return self._ids(word)
        if normal[:-1].isalpha() and normal[-1] in ",.":
            return known[normal[:-1]] + known[normal[-1]]
        return b"".join([known[p] for p in (_ASCII_PRETOKENS if normal.isascii() else _PRETOKENS)(normal)])

    def encode(self, texts: pa.Array) -> pa.Array:
        """Little-endian ids of each text, and the end id."""
        if not self.by_word:
            return pa.array([self._ids(t or "") + self.suffix for t in texts.to_pylist()], pa.binary())
        if self.words.n > POOL_WORDS or self.words.used > POOL_IDS:
            self.words.forget()
        self.pretokens.age()
        # a mark between a letter or digit and white space is a pretoken of its own: words with and without it share their ids
        texts = pc.replace_substring_regex(pc.fill_null(texts, ""), r"([\pL\pN])([,.])(\s)", r"\1 \2\3")
        words = pc.ascii_split_whitespace(texts)
        upto = words.offsets.to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        numbers = self.words.numbers(coded.dictionary)[coded.indices.to_numpy()]
        upto -= upto[0]
        if self.suffix:  # the end id is a word after the last of each text
            numbers = np.insert(numbers, upto[1:], self.words.numbers(pa.array([END]))[0])
            upto += np.arange(len(upto))
        ids, sizes = self.words.gather(numbers)
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[upto] * ids.itemsize
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])


def id_type(spec: str) -> str:
    """numpy type of the ids of a tokenizer's file."""
    return "<u2" if Tokenizer.from_str(spec).get_vocab_size() <= 1 << 16 else "<u4"


def encode_ids(docs: DataFrame, spec: str, end_id: int | None = None) -> DataFrame:
    """doc_id and ids (binary, little-endian of id_type(spec)) of every whole text; end_id closes each document.

    spec is the tokenizer's file (of fixed size), which is broadcast: executors need no copy of it.
    """
    small_batches(docs.sparkSession, BATCH)
    sent = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash((sent.value, end_id))
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = TextEncoder(sent.value, end_id)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _encoders[key].encode(batch.column(1))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def count_ids(encoded: DataFrame, dtype: str) -> np.ndarray:
    """Occurrences of every id over the whole collection: at most one number an id of the vocabulary reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            some = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype))
            if len(some) > len(total):
                total, some = some.astype(np.int64), total
            total[: len(some)] += some
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    rows = encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows.id.max()) + 1 if len(rows) else 0, np.int64)
    counts[rows.id.to_numpy(np.int64)] = rows.n.to_numpy(np.int64)
    return counts


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int | None = None) -> None:
    """Encode all texts and write them to path in the format above, in ascending doc_id order."""
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = f.read()
    dtype = id_type(spec)
    encoded = stored(encode_ids(docs, spec, end_id), "token-ids")
    lengths = huffman.code_lengths(count_ids(encoded, dtype))
    ids = np.flatnonzero(lengths)
    book = pa.table({"id": ids, "length": lengths[ids].astype(np.int32)})
    spark.createDataFrame(book.to_pandas(), "id long, length int").coalesce(1).write.parquet(f"{path}/codebook")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, width = huffman.Codebook(lengths), np.dtype(dtype).itemsize
        shard, seq, start = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        rows: list[bytes] = []
        held = 0

        def row() -> pa.RecordBatch:
            tokens = np.frombuffer(b"".join(rows), dtype)
            payload, checkpoints = code.encode(tokens)
            cells = [shard, seq, start, doc_ids, [len(r) // width for r in rows], payload, checkpoints]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, (f.type for f in _ROW))], schema=_ROW)

        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids.append(doc_id)
                rows.append(data)
                held += len(data) // width
                if held >= ROW_IDS:
                    yield row()
                    seq, start, held, doc_ids, rows = seq + 1, start + held, 0, [], []
        if rows:
            yield row()

    # ranges go on within one id, so rows without ids, however many, are dealt to several shards
    keyed = encoded.withColumn("tie", F.xxhash64("ids"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "ids").mapInArrow(run, _ROW_DDL).write.parquet(f"{path}/blocks")
    drop_stored(encoded)


_ROW = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("shard_start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary()), ("checkpoints", pa.binary())])
_ROW_DDL = "shard int, seq int, shard_start long, doc_ids array<long>, lengths array<long>, payload binary, checkpoints binary"


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (binary, little-endian uint32) of every document."""
    small_batches(spark, rows=4)
    book = spark.read.parquet(f"{path}/codebook").toPandas()
    lengths = np.zeros(int(book.id.max()) + 1 if len(book) else 1, np.uint8)
    lengths[book.id.to_numpy()] = book.length.to_numpy()
    blocks = spark.read.schema(_ROW_DDL).parquet(f"{path}/blocks")
    own = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = {r.shard: r.n for r in blocks.groupBy("shard").agg(F.max(F.col("shard_start") + own).alias("n")).collect()}
    before, at = {}, 0
    for shard in sorted(totals):
        before[shard], at = at, at + totals[shard]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = huffman.Codebook(lengths)
        for batch in batches:
            for r in batch.to_pylist():
                sizes = np.array(r["lengths"], np.int64)
                ids = code.decode(r["payload"], r["checkpoints"], int(sizes.sum())).astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                starts = ends - sizes
                for i in range(0, len(sizes), 1024):
                    a, b = starts[i : i + 1024], ends[i : i + 1024]
                    data = [ids[4 * x : 4 * y] for x, y in zip(a.tolist(), b.tolist())]
                    cells = [pa.array(r["doc_ids"][i : i + 1024], pa.int64()), pa.array(a + before[r["shard"]] + r["shard_start"]), pa.array(b - a), pa.array(data, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cells, ["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
