"""Quality rules as a bitmask ledger.

Every rule is evaluated once per text. Its verdict is one bit of ``fail_bits`` beside the measurements
it was made from, so a policy is only a mask: applying another version, or asking what a policy would
keep without one of its rules, reads the ledger and no text. All of it is Column expressions in one
projection; nothing is shuffled.

Defined results: null and empty texts have every count 0 and fail ``few_words``; repeated rows and
null ids stay as they are; an empty table gives an empty table; other columns, whatever their names, are not read; a
text of any length is measured whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, WORD, Scratch

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Bits of a packed window: its position below, its hash above. Texts of more words use the wide form.
NARROW, WIDE = (1 << 21) - 1, (1 << 40) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _window(words: Column, i: Column) -> list[Column]:
    return [F.get(words, i + k) for k in range(3)]


def _same_as_neighbour(rows: Column, key: Callable[[Column], Column]) -> Column:
    near = lambda x, i: F.coalesce(key(x) == key(F.get(rows, i - 1)), F.lit(False)) | F.coalesce(key(x) == key(F.get(rows, i + 1)), F.lit(False))
    return F.filter(rows, near)


def n_repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more; ``words`` should be bound by ``let``.

    Windows are sorted by hash as plain longs, with the position in the low bits. Those that share the
    hash with a neighbour are compared again as strings, so a collision of hashes changes nothing.
    """
    low = F.when(F.size(words) < NARROW, F.lit(NARROW).cast("long")).otherwise(F.lit(WIDE))
    high = F.when(F.size(words) < NARROW, F.lit(~NARROW).cast("long")).otherwise(F.lit(~WIDE))
    packed = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(*_window(words, i)).bitwiseAND(high).bitwiseOR(i.cast("long"))))
    maybe = let(packed, lambda s: F.transform(_same_as_neighbour(s, lambda x: x.bitwiseAND(high)), lambda x: x.bitwiseAND(low).cast("int")))
    texts = F.sort_array(F.transform(maybe, lambda i: F.struct(F.concat_ws(" ", *_window(words, i)).alias("s"), i.alias("i"))))
    sure = F.sort_array(let(texts, lambda t: F.transform(_same_as_neighbour(t, lambda x: x["s"]), lambda x: x["i"])))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(sure, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return F.when(F.size(words) >= 4, covered).otherwise(F.lit(0).cast("long"))


def _lacks(text: Column, chars: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")


def measurements(text: Column) -> Column:
    """A struct of all counts of ``text``."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: F.char_length(F.translate(x, SPACES, "")) > 0)
    made = [
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), n_repeat_words(w).alias("n_repeat_words"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        F.char_length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        _lacks(text, SYMBOLS).alias("n_symbols"),
        _lacks(text, UPPER).alias("n_capitals"),
        _lacks(text, "!").alias("n_shouts"),
    ]
    return F.struct(*made)


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts"]

#: Rules by bit, as the SQL condition of failing over the measurements.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "n_dup_lines >= 2 and 100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 3 * n_words or word_chars > 10 * n_words",
    "capitals": "100 * n_capitals > 40 * word_chars",
    "shouts": "2 * n_shouts > n_words",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}
#: Versioned policies: the rules whose failure rejects a text.
POLICIES = {"base": ["few_words", "repeated_words"], "v1": list(RULES)}


def mask(policy: str | list[str]) -> int:
    return sum(BIT[r] for r in (POLICIES[policy] if isinstance(policy, str) else policy))


_FIELDS = {"n_words": "w.n_words", "n_dup_lines": "l.n_dup_lines", "n_repeat_words": "w.n_repeat_words", "n_lines": "l.n_lines"}


def _bits(at: str = "") -> str:
    """fail_bits as SQL over the measurements, whose names begin with ``at``."""
    return " + ".join(f"if({re.sub(r'\b(n_[a-z_]+|word_chars)\b', at + r'\1', rule)}, {BIT[name]}L, 0L)" for name, rule in RULES.items())


def kept_rows(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """All columns of ``docs`` (with a text column) for the rows that ``policy`` keeps: its mask over the row's own bits, so nothing is joined."""
    named = "_quality_measurements"
    while any(c.lower().startswith(named) for c in docs.columns):
        named = "_" + named
    judged = docs.withColumn(named, F.explode(F.array(measurements(F.col("text")))))
    flat = judged.select("*", F.struct(*[F.col(f"{named}.{_FIELDS.get(c, c)}").alias(c) for c in MEASURES]).alias(named + "_"))
    both = mask(list(dict.fromkeys(POLICIES["base"] + POLICIES[policy])))
    return flat.where(F.expr(f"({_bits(named + '_.')}) & {both}L") == 0).select(*docs.columns)


def ledger(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, measurements, fail_bits) for every row of ``docs`` (doc_id, text)."""
    made = docs.select(F.col("doc_id"), F.explode(F.array(measurements(F.col("text")))).alias("m"))
    flat = made.select("doc_id", *[F.col(f"m.{_FIELDS.get(c, c)}").alias(c) for c in MEASURES])
    return flat.withColumn("fail_bits", F.expr(_bits()))


def stored_ledger(docs: DataFrame) -> DataFrame:
    """The ledger as a written table, which any number of policies and ablations read instead of the texts."""
    return Scratch(docs.sparkSession, "quality").keep(ledger(docs), "ledger")


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with base_failed and kept; kept is false if base_failed, else what the policy says."""
    base = F.col("fail_bits").bitwiseAND(F.lit(mask("base"))) != 0
    return rows.withColumn("base_failed", base).withColumn("kept", ~base & (F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0))


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Rows (rule, failed, failed_alone, kept, kept_without) of a policy, from a ledger.

    One grouped count by failure pattern (at most 2**rules rows), then bit tests on the patterns.
    """
    used = POLICIES[policy]
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in used])).alias("r")
    each = patterns.select("bits", "n", rules).select("bits", "n", "r.*")
    out = each.groupBy("rule").agg(total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("failed"), total(F.col("bits") == F.col("bit")).alias("failed_alone"), total(F.col("bits") == 0).alias("kept"))
    return out.withColumn("kept_without", F.col("kept") + F.col("failed_alone"))


_WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS_SQL} AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM t)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (SELECT t.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
  (length(t) - length(replace(t, '!', '')))::BIGINT AS n_shouts FROM t LEFT JOIN c USING (doc_id)),
b AS (SELECT *, ({" + ".join(f"CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END" for name, rule in RULES.items())})::BIGINT AS fail_bits FROM m)
SELECT *, (fail_bits & {mask("base")}) <> 0 AS base_failed, (fail_bits & {mask("v1")}) = 0 AS kept FROM b
"""
