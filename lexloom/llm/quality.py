"""Quality rules as a short-circuit cascade, in Spark SQL functions only.

A rule is a predicate over a text, with whatever has to be measured for it inside: a measure that only one rule reads is worked out in
that rule's branch of a CASE, and so only for documents that no earlier rule has rejected. The cascade times every rule on a bounded
sample of the documents (Bernoulli draws of SAMPLE rows on average) against a scan without rules, estimates the share it
rejects, and orders the rules by rejection per cost. The order decides only how soon a document is given up, never whether: a
document is kept if no rule rejects it. failed_rule and rules_tried tell where the cascade stopped; they follow the order, and so the
clock, and may differ between runs, unlike the verdict.

Measures of a text (null: no words): n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words. cascade() gives them for every
document, in columns q_<measure>, or with measure=False leaves them to the rules that need them. n_repeat_words is found
within the row: windows of eight words are hashed (64-bit), a text whose hashes are all distinct stops there, otherwise
the hashes are sorted with their positions and the words covered by repeated ones are counted. Nothing is exploded or
shuffled, so no group of equal texts can meet in one task.

Defined results: an empty or null text has no words and fails the base rule; repeated rows and ties get equal results;
extra columns pass through, but for any named q_<measure>, base_failed, failed_rule or rules_tried, which the results replace; an
empty table gives an empty result.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import fresh, n_words, spaced

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Rows, on average, of the sample on which rules are timed and their selectivity is estimated.
SAMPLE = 2000


def _count(text: Column, chars: str) -> Column:
    """How many of the given ASCII characters a text holds: bytes lost when each is deleted."""
    lost = F.lit(0)
    for c in chars:
        lost = lost + F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    return lost.cast("long")


def _let(value: Column, use) -> Column:
    """use(value) with value computed once for a row: a lambda over a one-element array binds it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeat_words(words: Column, k: int = WINDOW) -> Column:
    """Words that lie in a window of k words found twice or more in the text, first copies included."""

    def covered(windows: Column) -> Column:
        def in_order(rows: Column) -> Column:
            same = lambda i, j: F.get(rows, i)["h"] == F.get(rows, j)["h"]
            marked = F.filter(rows, lambda _, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
            return _let(F.array_sort(F.transform(marked, lambda r: r["i"])), lambda at: F.aggregate(
                F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.when(b.isNull(), k).otherwise(F.least(b - a, F.lit(k)))),
                F.lit(0).cast("long"), lambda n, x: n + x))

        rows = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(_let(rows, in_order))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k)))
    return F.when(F.size(words) <= k, F.lit(0).cast("long")).otherwise(_let(hashes, covered))


def _measures(text: str) -> dict[str, Column]:
    """Every measure by itself."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    words = F.array_remove(F.split(spaced(F.col(text)), " "), "")
    return {
        "n_words": n_words(F.col(text)),
        "word_chars": F.char_length(t).cast("long") - _count(t, " \t\n\x0b\x0c\r"),
        "n_symbols": _count(t, SYMBOLS),
        "n_dup_lines": _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": _let(words, lambda w: repeat_words(w)),
    }


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with q_<measure> columns; the text is split into words once."""
    words = F.array_remove(F.split(spaced(F.col(text)), " "), "")
    both = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    name = fresh("q_words", docs)
    rest = {f"q_{k}": v for k, v in _measures(text).items() if k not in ("n_words", "n_repeat_words")}
    out = docs.withColumns({name: both, **rest})
    return out.withColumns({f"q_{k}": F.col(f"{name}.{k}") for k in ("n_words", "n_repeat_words")}).drop(name)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def base_failed(q: dict[str, Column] | None = None) -> Column:
    q = q or {k: F.col(f"q_{k}") for k in _measures("text")}
    return (q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])


def default_rules(text: str = "text", measured: bool = True) -> list[Rule]:
    """Beyond the base: thresholds in the spirit of the published Gopher rules, over whole texts and integers only.

    measured: the rules read q_ columns that are there anyway; else each rule measures for itself, and the base rules are rules as well.
    """
    q = {k: F.col(f"q_{k}") if measured else v for k, v in _measures(text).items()}
    t, words, chars = F.coalesce(F.col(text), F.lit("")), q["n_words"], q["word_chars"]
    upper = F.char_length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long")
    base = [Rule("short", words < 20), Rule("repeats", 100 * q["n_repeat_words"] > 30 * words)]
    return [
        *([] if measured else base),
        Rule("symbols", 10 * q["n_symbols"] > 3 * words),
        Rule("short_words", chars < 2 * words),
        Rule("long_words", chars > 20 * words),
        Rule("dup_lines", 100 * q["n_dup_lines"] > 30 * (F.regexp_count(t, F.lit(r"\n")) + 1)),
        Rule("shouting", 2 * upper > chars),
        Rule("placeholder", F.contains(F.lower(t), F.lit("lorem ipsum"))),
    ]


def ordered(rules: list[Rule], sample: DataFrame, runs: int = 2) -> list[Rule]:
    """Rules by rejected share per second on the sample, best first, then the cheaper first; the sample is bounded.

    A rule's seconds are the least of `runs` scans with it over the least without any, so that compiling and starting jobs do not count.
    """
    rows = sample.persist()
    total = max(rows.count(), 1)

    def timed(hit: Column) -> tuple[float, int]:
        took, n = [], 0
        for _ in range(runs):
            began = time.perf_counter()
            n = rows.agg(F.count_if(hit)).head()[0]
            took.append(time.perf_counter() - began)
        return min(took), n

    idle = timed(F.lit(True))[0]
    score = []
    for rule in rules:
        seconds, n = timed(rule.rejects)
        cost = max(seconds - idle, 1e-4)
        score.append((-(n / total) / cost, cost))
    rows.unpersist()
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: score[i])]


def cascade(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE, measure: bool = True, order: bool = True, text: str = "text") -> DataFrame:
    """docs with failed_rule, the first rule of the estimated order that rejects (null: kept), and rules_tried.

    measure: also q_<measure> and base_failed for every document; what fails the base is rejected as `base` before any rule.
    order: False takes the rules as they are given.
    """
    rules = default_rules(text, measure) if rules is None else rules
    rows = measured(docs, text) if measure else docs
    if order and len(rules) > 1:
        # drawn row by row: a limit would send sample_rows rows of every partition to one task
        share = min(1.0, sample_rows / max(docs.count(), 1))
        sample = docs.sample(share, seed=1)
        rules = ordered(rules, measured(sample, text) if measure else sample)
    verdict = F.when(base_failed(), "base") if measure else F.when(F.lit(False), "")
    for rule in rules:
        verdict = verdict.when(F.coalesce(rule.rejects, F.lit(False)), rule.name)
    out = rows.withColumns({**({"base_failed": base_failed()} if measure else {}), "failed_rule": verdict})
    place = F.array_position(F.array(*(F.lit(r.name) for r in rules)), F.col("failed_rule")).cast("int") if rules else F.lit(0)
    return out.withColumn("rules_tried", F.when(F.col("failed_rule").isNull(), F.lit(len(rules))).otherwise(place))


QUALITY_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 7)) AS i FROM w WHERE len(words) > 8)),
found AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (
  SELECT doc_id, sum(least(coalesce(after - i, 8), 8))::BIGINT AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM found) GROUP BY doc_id),
base AS (
  SELECT w.doc_id, w.text, len(words)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
    (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS n_lines
  FROM w LEFT JOIN covered c USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 100 * n_dup_lines > 30 * n_lines OR 2 * n_upper > word_chars OR contains(lower(text), 'lorem ipsum')) AS kept
FROM judged
"""
