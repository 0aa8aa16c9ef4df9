"""Mixing sources to target weights by Pareto order sampling (Rosén 1997).

Every source gets a target number of words. A document of a source whose target is r times its size gets floor(r)
certain whole copies; the fraction left is sampled without replacement with unequal inclusion odds: a document's
probability is c times its weight, by default the number of binary digits of its size, so that longer documents are likelier and very
long ones not overwhelmingly so. c makes the expected words meet the target; documents whose probability would reach 1 are
certain and taken first. Each other document draws a uniform u from a keyed hash, its rank is the random odds u/(1-u) over
its inclusion odds p/(1-p), and the lowest ranks are taken until the words of the source are as near to its target as whole
documents allow: a sample of fixed size in words.

No group is gathered. The cut in each source's rank order is found by two rounds of 1024-bin counts, pre-aggregated in
the map tasks, and an exact ordering of the few rows in the last bin; a source with a third of all rows only sends
counts.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 take 0
words; equal rows are numbered and each number draws its own hash, so that a source of equal rows or of null ids meets its
target as well; an empty table gives an empty mix; further columns pass through mix() unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.llm.common import drop_stored, n_words, row_hash, stored

BINS = 1024
SCALE = float(1 << 48)


def uniform(doc_id: Column, text_key: Column, number: Column, seed: int) -> Column:
    """A reproducible uniform in (0, 1) of 48 bits from MD5 of the seed, the id, the text's MD5 and the number among equal rows."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), text_key, number.cast("string")))
    return (F.conv(F.substring(key, 1, 12), 16, 10).cast("long").cast("double") + 0.5) / SCALE


def source_targets(sums: DataFrame, max_copies: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Water-filling: adds target (double) to sums(source, source_size, ...), one row a source.

    Weights repeat along the sources in code-point order, null last. A target above max_copies times its source's size
    stops there and the excess is shared again by weight until no target is above its stop. Stops per weight ascending,
    the stopped sources are a prefix, so one ordered pass over the sources finds the level that the others share.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long"))
    weighed = weighed.withColumn("stop", F.col("source_size") * max_copies)
    order = W.orderBy((F.col("stop") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    level = (
        weighed.withColumn("total", F.sum("source_size").over(W.partitionBy()))
        .withColumn("spent", F.coalesce(F.sum("stop").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("place", F.row_number().over(order))
    )
    free = F.col("stop") * F.col("rest") > F.col("weight") * (F.col("total") - F.col("spent"))
    level = level.withColumn("first", F.min(F.when(free, F.struct("place", "total", "spent", "rest"))).over(W.partitionBy()))
    shared = (F.col("weight") * (F.col("first.total") - F.col("first.spent"))).cast("double") / F.col("first.rest")
    stopped = F.col("first").isNull() | (F.col("place") < F.col("first.place"))
    return level.select(*sums.columns, F.when(stopped, F.col("stop").cast("double")).otherwise(shared).alias("target"))


def size_weight(size: Column) -> Column:
    """Default inclusion weight: binary digits of the size, at least 1."""
    return F.length(F.bin(size)).cast("long")


def _key(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id"), row_hash(docs).alias("row_key")]


def ranked(docs: DataFrame, size: Column, seed: int, weight: Column | None = None) -> DataFrame:
    """Slim rows (doc_id, row_key, source, size, w, number, of, u) of the mix; the text stays behind. Equal rows are counted
    and numbered, so nothing is gathered for them. weight: whole relative inclusion weights of documents from 1 on."""
    text = F.md5(F.coalesce(F.col("text"), F.lit(""))) if "text" in docs.columns else F.lit("")
    rows = docs.select(*_key(docs), "source", size.cast("long").alias("size"), text.alias("text_key"), *([] if weight is None else [weight.cast("long").alias("w")]))
    if weight is None:
        rows = rows.withColumn("w", size_weight(F.col("size")))
    rows = rows.withColumn("w", F.greatest(F.coalesce("w", F.lit(1)), F.lit(1).cast("long")))
    counted = rows.groupBy("doc_id", "row_key").agg(*(F.first(c).alias(c) for c in ("source", "size", "w", "text_key")), F.count("*").alias("of"))
    each = counted.withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("of"))))
    return each.withColumn("u", uniform(F.col("doc_id"), F.col("text_key"), F.col("number"), seed)).drop("text_key")


def _beside(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with the columns of their source's row as mix_<name>. Spark broadcasts that table only if its files are
    smaller than the session's threshold; it joins by shuffle otherwise."""
    named = sources.select(*(F.col(c).alias(f"mix_{c}") for c in sources.columns))
    return rows.join(named, F.col("source").eqNullSafe(F.col("mix_source")), "left")


def _certain() -> Column:
    return F.coalesce(F.col("w") >= F.col("mix_sure"), F.lit(False))


def _rank() -> Column:
    """The Pareto rank as z in (0, 1): random odds over inclusion odds q, squeezed by q/(1+q), which keeps the order."""
    p = F.col("w") * F.col("mix_left") / F.greatest(F.col("mix_weighed"), F.lit(1))
    q = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    return F.when((p > 0) & (p < 1), q / (1 + q)).otherwise(F.lit(1.0))


def inclusion(weights: DataFrame) -> DataFrame:
    """Per source of weights(source, w, words, left): the least certain weight `sure` (null if none is), what is `left` to sample
    after the certain words, and the `weighed` words (sum of w times size) of the rest: p = w * left / weighed.

    A weight is certain if w times what is left, after all heavier weights, reaches the weighed words of it and all
    lighter ones. The heavier weights of a certain one are certain too, so one pass over the few weights of each source finds them.
    """
    heavy = W.partitionBy("source").orderBy(F.desc("w"))
    rows = weights.withColumn("above", F.coalesce(F.sum("words").over(heavy.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("weighed", F.sum(F.col("w") * F.col("words")).over(heavy.rowsBetween(0, W.unboundedFollowing)))
    sure = F.col("w") * (F.col("left") - F.col("above")) >= F.col("weighed")
    rows = rows.withColumn("certain", sure & (F.col("words") > 0))
    below = F.max(F.when(~F.col("certain"), F.struct("w", (F.col("left") - F.col("above")).alias("left"), "weighed")))
    return rows.groupBy("source").agg(F.min(F.when(F.col("certain"), F.col("w"))).alias("sure"), below.alias("b")).select(
        "source", "sure", F.coalesce("b.left", F.lit(0.0)).alias("left"), F.coalesce("b.weighed", F.lit(0)).alias("weighed"))


def plan(slim: DataFrame, max_copies: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row a source: source, source_size, target, whole, sure, left, weighed and the cut (z_cut, id_cut) of its rank order.

    slim is ranked() and stored. A document gets `whole` copies, and one more if it is certain or at or before the cut.
    """
    by_weight = stored(slim.groupBy("source", "w").agg(F.sum("size").cast("long").alias("words")), "mix-weights")
    sums = by_weight.groupBy("source").agg(F.sum("words").cast("long").alias("source_size"))
    some = F.col("source_size") > 0
    sources = source_targets(sums, max_copies, weights)
    sources = sources.withColumn("whole", F.when(some, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = stored(sources.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")), "mix-sources")
    odds = inclusion(_beside(by_weight, sources).select("source", "w", "words", F.col("mix_left").alias("left")))
    planned = stored(_beside(sources.drop("left"), odds).select(*(c for c in sources.columns if c != "left"), *(F.col(f"mix_{c}").alias(c) for c in ("sure", "left", "weighed"))), "mix-odds")
    rows = _beside(slim, planned).where(~_certain()).withColumn("z", _rank()).select("doc_id", "row_key", "number", "source", "size", "z", F.col("mix_left").alias("left"))
    scratch = [by_weight, sources, planned]
    cuts = None
    for bits in (BINS, BINS * BINS):
        inside = rows.withColumn("bin", F.floor(F.col("z") * bits).cast("long"))
        if cuts is None:
            inside = inside.withColumn("mix_before", F.lit(0).cast("long"))
        else:
            inside = _beside(inside, cuts).where(F.floor(F.col("bin") / BINS) == F.col("mix_bin"))
        counts = inside.groupBy("source", "bin").agg(F.sum("size").alias("n"), F.first("mix_before").alias("before"), F.first("left").alias("left"))
        counts = counts.withColumn("upto", F.sum("n").over(W.partitionBy("source").orderBy("bin")) + F.col("before"))
        first = F.min(F.when(F.col("upto") >= F.col("left"), F.struct("bin", (F.col("upto") - F.col("n")).alias("before"))))
        cuts = stored(counts.groupBy("source").agg(first.alias("c")).select("source", "c.bin", "c.before"), "mix-cuts")
        scratch.append(cuts)
    last = _beside(rows, cuts).where(F.floor(F.col("z") * (BINS * BINS)) == F.col("mix_bin"))
    last = last.withColumn("after", F.sum("size").over(W.partitionBy("source").orderBy("z", "doc_id", "row_key", "number").rowsBetween(W.unboundedPreceding, 0)) + F.col("mix_before"))
    taken = last.where(2 * F.col("after") - F.col("size") < 2 * F.col("left"))
    best = stored(taken.groupBy("source").agg(F.max(F.struct("z", "doc_id", "row_key", "number")).alias("cut")), "mix-best")
    out = _beside(_beside(planned, cuts).drop("mix_source", "mix_before"), best)
    z_cut = F.coalesce(F.col("mix_cut.z"), F.col("mix_bin") / F.lit(BINS * BINS))
    out = stored(out.select(*planned.columns, z_cut.alias("z_cut"), F.col("mix_cut").alias("cut")), "mix-plan")
    for old in (*scratch, best):
        drop_stored(old)
    return out


def copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target and copies to rows that hold source, doc_id, row_key, number, w and u."""
    z = _rank()
    own, cut = F.struct("doc_id", "row_key", "number"), F.struct("mix_cut.doc_id", "mix_cut.row_key", "mix_cut.number")
    at_cut = (z == F.col("mix_z_cut")) & F.col("mix_cut").isNotNull() & (own <= cut)
    extra = _certain() | (F.col("mix_left") > 0) & ((z < F.col("mix_z_cut")) | at_cut)
    n = F.col("mix_whole") + F.coalesce(extra, F.lit(False)).cast("long")
    return _beside(rows, plan).select(*rows.columns, F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), n.alias("copies"))


def mix(docs: DataFrame, seed: int = 7, max_copies: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mixed collection: rows of docs, each as often as the plan copies it, with the columns of docs.

    Rows that occur once decide where they stand and their texts don't move. Of equal rows one stays, as often as all of them
    together are copied; their table joins by broadcast only if its files are below the session's threshold.
    """
    own = docs.columns
    slim = stored(ranked(docs, n_words(F.col("text")), seed), "mix-slim")
    chosen = plan(slim, max_copies, weights)
    several = slim.where("of > 1")
    several = copies(several, chosen).groupBy(F.col("doc_id").alias("m_doc_id"), F.col("row_key").alias("m_row_key")).agg(F.sum("copies").alias("all_copies"))
    several = stored(several, "mix-several")
    size = n_words(F.col("text"))
    text = F.md5(F.coalesce(F.col("text"), F.lit("")))
    ids = docs.select(F.struct(*own).alias("row"), "source", *_key(docs), size_weight(size).alias("w"), F.lit(1).cast("long").alias("number"), uniform(F.col("doc_id"), text, F.lit(1), seed).alias("u"))
    same = F.col("doc_id").eqNullSafe(F.col("m_doc_id")) & (F.col("row_key") == F.col("m_row_key"))
    if several.isEmpty():
        counted = copies(ids, chosen)
    else:
        beside = ids.join(several, same, "left")
        once = copies(beside.where(F.col("all_copies").isNull()).drop("m_doc_id", "m_row_key", "all_copies"), chosen)
        first = beside.where(F.col("all_copies").isNotNull()).dropDuplicates(["m_doc_id", "m_row_key"])
        counted = once.select("row", "copies").union(first.select("row", F.col("all_copies").alias("copies")))
    repeated = counted.where(F.col("copies") > 0)
    return repeated.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def mix_report(docs: DataFrame, seed: int = 7, max_copies: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Per document: doc_id, size, source_size, target and taken words."""
    slim = stored(ranked(docs, n_words(F.col("text")), seed), "mix-slim")
    rows = copies(slim, plan(slim, max_copies, weights))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


MIX_SQL = r"""
WITH sized AS (
  SELECT *, length(bin(size))::BIGINT AS w,
    (('0x' || substr(md5(concat_ws(':', '7', coalesce(doc_id::VARCHAR, 'null'), text_key, number::VARCHAR)), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS text_key,
    row_number() OVER (PARTITION BY doc_id, source, text, lang, n_chars) AS number FROM documents)),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS stop FROM sums),
level AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(stop) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    row_number() OVER o AS place
  FROM weighed WINDOW o AS (ORDER BY stop::DOUBLE / weight, source NULLS LAST)),
first AS (SELECT total, spent, rest, place FROM level WHERE stop * rest > weight * (total - spent) ORDER BY place LIMIT 1),
targets AS (
  SELECT l.source, l.source_size,
    CASE WHEN f.place IS NULL OR l.place < f.place THEN l.stop::DOUBLE
         ELSE (l.weight * (f.total - f.spent))::DOUBLE / f.rest::DOUBLE END AS target
  FROM level l LEFT JOIN first f ON true),
filled AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets),
weights AS (
  SELECT s.source, s.w, sum(s.size)::BIGINT AS words, any_value(t.target - t.whole * t.source_size) AS remains
  FROM sized s JOIN filled t ON s.source IS NOT DISTINCT FROM t.source GROUP BY s.source, s.w),
heavy AS (
  SELECT *, coalesce(sum(words) OVER (h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
    sum(w * words) OVER (h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weighed
  FROM weights WINDOW h AS (PARTITION BY source ORDER BY w DESC)),
odds AS (
  SELECT source, min(w) FILTER (certain) AS sure, coalesce(arg_max(remains - above, w) FILTER (NOT certain), 0) AS remains,
    coalesce(arg_max(weighed, w) FILTER (NOT certain), 0)::BIGINT AS weighed
  FROM (SELECT *, words > 0 AND w * (remains - above) >= weighed AS certain FROM heavy) GROUP BY source),
rows_ AS (
  SELECT s.doc_id, s.number, s.size, s.u, t.source, t.source_size, t.target, t.whole, o.remains, coalesce(s.w >= o.sure, false) AS certain,
    s.w * o.remains / greatest(o.weighed, 1)::DOUBLE AS p
  FROM sized s JOIN filled t ON s.source IS NOT DISTINCT FROM t.source JOIN odds o ON s.source IS NOT DISTINCT FROM o.source),
ranked AS (
  SELECT *, sum(CASE WHEN certain THEN 0 ELSE size END) OVER (PARTITION BY source
    ORDER BY CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) ELSE 1e300 END, doc_id NULLS FIRST, number ROWS UNBOUNDED PRECEDING) AS after
  FROM rows_)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN certain OR (remains > 0 AND 2 * after - size < 2 * remains) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ranked
"""
