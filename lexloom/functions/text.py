"""Text functions: tokens, stems, n-grams and character references."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text that is parted into words at a time, in bytes, and distinct words whose stems a worker remembers.
SLICE_BYTES, STEMS = 4 << 20, 500_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII word characters; null has none. Accented letters part words."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\W+"), "")


def exploded_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, pos and token of every token."""
    return docs.select("doc_id", F.posexplode(tokens(F.col(text))).alias("pos", "token"))


def valid(rows: DataFrame, stop_words: DataFrame | None = None) -> DataFrame:
    """Rows whose token has no digit and is not in stop_words(token)."""
    kept = rows.where(~F.rlike("token", F.lit("[0-9]")))
    return kept if stop_words is None else kept.join(stop_words.select("token").distinct(), "token", "left_anti")


def term_counts(docs: DataFrame, text: str = "text", n: int = 1, stop_words: DataFrame | None = None, stem: bool = False, valid_only: bool = True) -> DataFrame:
    """doc_id, token and n: occurrences of every valid token (or of every token), or stem, or run of `n` of them, in every document.

    Rows are counted where a text is read, in Arrow batches, so that no single occurrence is shuffled; all rows of a document lie
    together. Only where ids repeat are the counts of an id's texts summed up by a shuffle."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("token", T.StringType()), T.StructField("n", T.LongType())])
    stop = [] if stop_words is None else [r.token for r in stop_words.select("token").distinct().collect()]  # a list of function words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                row, names, gram, count = _grams(part.column(1), n, stop, stem, valid_only)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), names.take(pa.array(gram)), pa.array(count)], schema.names)

    rows = docs.select("doc_id", F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text")).mapInArrow(run, schema)
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy("doc_id", "token").agg(F.sum("n").alias("n")).repartition("doc_id").sortWithinPartitions("doc_id")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of (doc_id, text) in runs of rows of SLICE_BYTES, or of one longer text."""
    ends, first = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)), 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield batch.slice(first, last - first)
        first = last


_WORD_BYTES = np.zeros(256, bool)
_WORD_BYTES[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz")] = True


def _words(text: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Row and word of every run of word bytes; bytes of other than ASCII letters part words."""
    _, ends, data = text.buffers()
    at = np.frombuffer(ends, np.int64 if pa.types.is_large_string(text.type) else np.int32)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    word = _WORD_BYTES[raw]
    start = word.copy()
    start[1:] &= ~word[:-1]
    begins = at[:-1][at[:-1] < len(raw)]
    start[begins] = word[begins]
    first = np.flatnonzero(start)
    offsets = np.append(np.cumsum(word, dtype=np.int32)[first] - 1, np.count_nonzero(word)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(raw[word]))
    return np.searchsorted(at, first, side="right") - 1, words.dictionary_encode()


def _grams(text: pa.Array, n: int, stop: list[str], stem: bool, valid_only: bool) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Row, names, gram (a place in names) and count of the runs of n valid tokens of every text of a batch, by row."""
    row, words = _words(text)
    codes, values = words.indices.to_numpy(), words.dictionary
    kept = np.ones(len(values), bool)
    if valid_only:
        kept &= ~pc.match_substring_regex(values, "[0-9]").to_numpy(zero_copy_only=False)
    kept &= ~pc.is_in(values, pa.array(stop, pa.string())).to_numpy(zero_copy_only=False)
    if stem:
        stems = pa.array([_remembered_stem(w) for w in values.to_pylist()], pa.string())
        kept &= pc.not_equal(stems, "").to_numpy(zero_copy_only=False)
        stems = stems.dictionary_encode()
        codes, taken, values = stems.indices.to_numpy()[codes], kept[codes], stems.dictionary
    else:
        taken = kept[codes]
    row, codes = row[taken], codes[taken].astype(np.int64)
    first = np.flatnonzero(row[: max(len(row) - n + 1, 0)] == row[n - 1 :])
    gram, names = codes[first], values
    for i in range(1, n):
        pairs, gram = np.unique(gram * len(values) + codes[first + i], return_inverse=True)
        names = pc.binary_join_element_wise(names.take(pa.array(pairs // len(values))), values.take(pa.array(pairs % len(values))), " ")
    found, count = np.unique(row[first] * max(len(names), 1) + gram, return_counts=True)
    return found // max(len(names), 1), names, found % max(len(names), 1), count.astype(np.int64)


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words, joined by blanks."""
    starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
    none = F.array().cast("array<string>")
    return F.when(F.size(words) < n, none).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " ")))


def decode_references(text: Column) -> Column:
    """&lt; &gt; &#N; of printable ASCII and &amp;, the last one last, then trimmed. Named references beyond these fail."""
    strange = F.regexp_extract(text, r"&(?!lt;|gt;|amp;|#\d+;)[A-Za-z]+;", 0)
    known = F.when(strange != "", F.raise_error(F.concat(F.lit("unknown entity "), strange))).otherwise(text)
    out = F.replace(F.replace(known, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))
    codes = F.regexp_extract_all(out, F.lit(r"&#(\d+);"), F.lit(1))
    out = F.aggregate(F.array_distinct(codes), out, lambda acc, c: F.replace(acc, F.concat(F.lit("&#"), c, F.lit(";")), F.char(c.cast("long"))))
    return F.trim(F.replace(out, F.lit("&amp;"), F.lit("&")))


def _measure(stem: str) -> int:
    kinds = "".join("v" if _vowel(stem, i) else "c" for i in range(len(stem)))
    return sum(a == "v" and b == "c" for a, b in zip(kinds, kinds[1:]))


def _vowel(word: str, i: int) -> bool:
    return word[i] in "aeiou" or (word[i] == "y" and i > 0 and not _vowel(word, i - 1))


def _has_vowel(stem: str) -> bool:
    return any(_vowel(stem, i) for i in range(len(stem)))


def _short_end(w: str) -> bool:
    return len(w) >= 3 and not _vowel(w, len(w) - 1) and _vowel(w, len(w) - 2) and not _vowel(w, len(w) - 3) and w[-1] not in "wxy"


_STEP2 = "ational ate tional tion enci ence anci ance izer ize abli able alli al entli ent eli e ousli ous ization ize ation ate ator ate alism al iveness ive fulness ful ousness ous aliti al iviti ive biliti ble".split()
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def porter_stem(w: str) -> str:
    """Porter's stemmer (1980)."""
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if _has_vowel(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _short_end(w):
                        w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (dict(zip(_STEP2[::2], _STEP2[1::2])), _STEP3):
        end = max((e for e in rules if w.endswith(e)), key=len, default=None)
        if end and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + rules[end]
    end = max((e for e in _STEP4 if w.endswith(e)), key=len, default=None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)][-1:] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short_end(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@lru_cache(STEMS)
def _remembered_stem(word: str) -> str:
    return porter_stem(word)


def stemmed(rows: DataFrame) -> DataFrame:
    """rows with tokens replaced by their stems; each distinct token is stemmed once, in Arrow batches."""

    @F.pandas_udf("string")
    def stem(words: pd.Series) -> pd.Series:
        return words.map(porter_stem)

    stems = rows.select("token").distinct().withColumn("stem", stem("token"))
    return rows.join(stems, "token").withColumn("token", F.col("stem")).drop("stem").where(F.col("token") != "")
