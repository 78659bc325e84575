"""Text measures, script detection and language planning, as Column expressions.

Lengths come in three kinds: code points without white space, UTF-16 units, and plain code points. White
space is the ECMAScript set, which neither of Java's ``\\s`` modes equals, so it is written out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space of ECMAScript.
JSWS = r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

# Code point ranges by script, in the order that breaks ties.
SCRIPT_RANGES = {
    "latin": r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}\x{100}-\x{24f}]",
    "arabic": r"[\x{600}-\x{6ff}]",
    "cyrillic": r"[\x{400}-\x{4ff}]",
    "cjk": r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]",
    "devanagari": r"[\x{900}-\x{97f}]",
}
SCRIPTS = tuple(SCRIPT_RANGES)
# Recognition model by script.
REC_MODELS = {"latin": "en", "arabic": "ar", "cyrillic": "ru", "cjk": "zh", "devanagari": "hi"}
SAMPLE_BYTES = 8192


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each computed once: the optimizer copies a projection into every use, but not a generator."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def nonws_length(text: Column) -> Column:
    """Code points that are not white space."""
    return F.length(F.regexp_replace(text, JSWS, ""))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def trim(text: Column) -> Column:
    # \z, since $ also matches before a last line end; a run is tried from its start only, so that long ones take linear time.
    return F.regexp_replace(text, rf"^{JSWS}+|(?<!{JSWS}){JSWS}++\z", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return trim(F.regexp_replace(text, f"{JSWS}+", " "))


def utf16_prefix(text: Column, units: int) -> Column:
    """The first ``units`` UTF-16 units; half of a surrogate pair at the cut is dropped."""
    wide = F.encode(text, "UTF-16BE")
    split = F.hex(F.substring(wide, 2 * units - 1, 1)).between("D8", "DB") & (F.octet_length(wide) > 2 * units)
    short = F.decode(F.when(split, F.substring(wide, 1, 2 * units - 2)).otherwise(F.substring(wide, 1, 2 * units)), "UTF-16BE")
    return F.when(F.length(text) == utf16_length(text), F.substring(text, 1, units)).otherwise(short)


def decode_utf8(content: Column) -> Column:
    """Lenient UTF-8 with one leading byte order mark removed."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"^\x{feff}", "")


def page_text(items: Column) -> Column:
    """Text of a page from its text-layer items, which are joined without a separator."""
    return collapse(F.array_join(items, ""))


def script_tally(text: Column) -> Column:
    """struct<latin, arabic, cyrillic, cjk, devanagari> of letter counts."""
    return F.struct(*[F.coalesce(F.regexp_count(text, F.lit(ranges)), F.lit(0)).cast("int").alias(name) for name, ranges in SCRIPT_RANGES.items()])


def dominant_script(tally: Column) -> Column:
    """The script with most letters; one that is not Latin needs two of them, else Latin if there is any, else unknown."""
    most = F.greatest(*[tally[s] for s in SCRIPTS])
    best = F
    for s in SCRIPTS:
        best = best.when(tally[s] == most, s)
    return F.when((most > 0) & ((tally["latin"] == most) | (most >= 2)), best).when(tally["latin"] > 0, "latin").otherwise("unknown")


def detect_script(text: Column) -> Column:
    return dominant_script(script_tally(text))


def script_to_rec_model(script: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in REC_MODELS.items() for x in pair]), script)


def language_plan(detected: Column, cached: Column) -> Column:
    """struct<load, offload>: Latin, unknown and cached scripts need nothing; any other replaces the non-Latin ones."""
    none = F.array().cast("array<string>")
    settled = detected.isin("latin", "unknown") | F.array_contains(cached, detected)
    return F.struct(
        F.when(settled, none).otherwise(F.array(detected)).alias("load"),
        F.when(settled, none).otherwise(F.filter(cached, lambda s: (s != "latin") & (s != detected))).alias("offload"),
    )


def utf8_sample(content: Column, size: int = SAMPLE_BYTES) -> Column:
    return decode_utf8(F.substring(content, 1, size))


def character_sample(content: Column, size: int = SAMPLE_BYTES) -> Column:
    """The first ``size`` code points, which have four bytes at most."""
    return F.substring(F.make_valid_utf8(F.substring(content, 1, 4 * size).cast("string")), 1, size)
