"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong spans come from three patterns, leftmost and non-overlapping within a kind. Positions are found without a UDF: the
pieces between the matches of a pattern (split) and the matches themselves (regexp_extract_all) alternate, so running
lengths give every start and end in code points. A text is only taken apart where a search found the pattern in it.

Weak parts prove nothing alone: 40-character mixed strings (`key`), endpoints (`endpoint`: URLs and host names of services)
and user names (`user`). They are reported only when complementary parts co-occur within a scope: a `key` near an access identifier, an endpoint near a
key or an assigned secret, a user near an assigned secret. Linking is an interval join: parts are dealt by (document, cell
of SCOPE code points), each looks at its own cell and the two beside it, and a left semi join keeps the weak ones whose
gap to a partner is at most SCOPE. A cell holds at most SCOPE / 12 parts of a kind, however many a document or a
source has, so no cell grows with the data.

Rows are keyed by (doc_id, XXH64 of the text): repeated rows share one result each, a null doc_id is a key like any other.
A null or empty text has no spans. Tied starts are ordered by kind. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import fresh, stored

#: Code points between linked parts at most.
SCOPE = 256

_QUOTE = "[\"']?"
_KEYWORD = "(?i:password|passwd|secret|token|api_?key)"
ASSIGN = rf"{_KEYWORD}{_QUOTE}\x20*[:=]\x20*{_QUOTE}[A-Za-z0-9+/_.=-]+"
ASSIGN_HEAD = rf"^{_KEYWORD}{_QUOTE}\x20*[:=]\x20*{_QUOTE}"
#: kind, pattern, smallest length of what LENGTH_OF leaves of a match
STRONG = (("assign", ASSIGN, 12), ("access", "AKIA[A-Z0-9]+", 18), ("hex", "(?<![0-9a-f])[0-9a-f]{16,}+", 16))
WEAK = (
    ("key", r"(?<![A-Za-z0-9+/=_.-])(?=[A-Za-z0-9+/]{0,39}[A-Z])(?=[A-Za-z0-9+/]{0,39}[a-z])(?=[A-Za-z0-9+/]{0,39}[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_.-])"),
    ("endpoint", r"(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]{4,}+"),
    ("user", r"(?i:user(?:name)?|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,}+"),
)
ORDER = [k for k, *_ in STRONG] + [k for k, *_ in WEAK]
#: Parts that complete each other.
PARTNERS = {"key": ("access",), "endpoint": ("assign", "access", "key"), "user": ("assign", "hex")}


def spans_of(text: Column, kind: str, pattern: str, least: int = 0) -> Column:
    """array<struct<start, end, kind>> of the pattern's matches in code points, end exclusive; empty where there is none."""
    # a piece before the k-th match is the k-th of split(); its length and the match's give the position of all that follow
    matches = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    pieces = F.split(text, pattern, -1)
    value = (lambda m: F.char_length(m) - F.char_length(F.regexp_extract(m, ASSIGN_HEAD, 0))) if kind == "assign" else F.char_length
    pairs = F.zip_with(matches, F.slice(pieces, 1, F.greatest(F.size(matches), F.lit(0))), lambda m, p: F.struct(F.char_length(p).alias("gap"), F.char_length(m).alias("n"), value(m).alias("v")))
    empty = F.array().cast("array<struct<start:int,end:int,ok:boolean>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["n"]
        found = F.struct(start.alias("start"), end.alias("end"), (x["v"] >= least).alias("ok"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))

    walked = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    kept = F.transform(F.filter(walked, lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), F.lit(ORDER.index(kind)).alias("rank"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return F.when(F.rlike(text, F.lit(pattern)), kept).otherwise(none)


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with text_key, strong and weak: arrays of (start, rank of the kind, end)."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({
        "text_key": F.xxhash64(F.col(text)),
        "strong": F.array_sort(F.concat(*(spans_of(t, k, p, n) for k, p, n in STRONG))),
        "weak": F.concat(*(spans_of(t, k, p) for k, p in WEAK)),
    })


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts (doc_id, text_key, start, rank, end) with a complementary part within scope; parts are distinct rows."""
    cell = F.floor(F.col("start") / scope).cast("int")
    wants = F.create_map(*(x for k, v in PARTNERS.items() for x in (F.lit(ORDER.index(k)), F.array(*(F.lit(ORDER.index(p)) for p in v)))))
    weak = parts.where(F.col("rank") >= len(STRONG)).withColumn("wants", wants[F.col("rank")])
    # a long part reaches into several cells; its partner must find it from the cell of its end as well
    near = weak.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / scope).cast("int") - 1, F.floor(F.col("end") / scope).cast("int") + 1)))
    other = parts.withColumns({"cell": F.explode(F.array_distinct(F.array(cell, F.floor(F.col("end") / scope).cast("int"))))})
    other = other.select(*(F.col(c).alias(f"o_{c}") for c in ("doc_id", "text_key", "start", "rank", "end", "cell")))
    gap = F.greatest(F.col("start") - F.col("o_end"), F.col("o_start") - F.col("end"))
    on = F.col("doc_id").eqNullSafe(F.col("o_doc_id")) & (F.col("text_key") == F.col("o_text_key")) & (F.col("cell") == F.col("o_cell")) & F.array_contains(F.col("wants"), F.col("o_rank")) & (gap <= scope)
    return near.join(other, on, "left_semi").select("doc_id", "text_key", "start", "rank", "end").distinct()


def hits(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row a (doc_id, text_key) with any span: strong (base spans) and spans (with linked weak ones), by start and kind."""
    some = F.size("strong") + F.size("weak")
    found = scanned(docs, text).select("doc_id", "text_key", "strong", "weak").where(some > 0).dropDuplicates(["doc_id", "text_key"])
    found = stored(found, "secret-hits")
    marked = found.where((F.size("weak") > 0) & (some > 1))
    parts = marked.select("doc_id", "text_key", F.explode(F.concat("strong", "weak")).alias("s")).select("doc_id", "text_key", "s.*")
    near = linked(parts, scope).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "rank", "end")).alias("near"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return _keyed(found, near).select("doc_id", "text_key", "strong", F.array_sort(F.concat("strong", F.coalesce("near", none))).alias("spans"))


def _keyed(left: DataFrame, right: DataFrame) -> DataFrame:
    """left with the columns of right's row of the same (doc_id, text_key), if there is one."""
    doc, key = fresh("key_doc_id", left), fresh("key_text", left)
    right = right.withColumnsRenamed({"doc_id": doc, "text_key": key})
    on = F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("text_key").eqNullSafe(F.col(key))
    return left.join(right, on, "left").drop(doc, key)


def secrets(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """docs with strong and spans, empty arrays where nothing was found. text_key, strong and spans replace columns so named."""
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    rows = docs.drop("text_key", "strong", "spans").withColumn("text_key", F.xxhash64(F.col(text)))
    rows = _keyed(rows, hits(docs, text, scope)).drop("text_key")
    return rows.withColumns({"strong": F.coalesce("strong", none), "spans": F.coalesce("spans", none)})


def listing(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*map(F.lit, ORDER))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """text with every span replaced by mask; overlapping and touching spans become one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        between = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        out = F.when(s["start"] > acc["at"], F.concat(acc["out"], between, F.lit(mask))).when((acc["at"] == 0) & (s["start"] == 0), F.lit(mask)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
