"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, the rest lower-case words without punctuation.
Windows of template tokens are hashed and joined with the benchmark's, and so are windows of case-folded
tokens, in which no word is a name: capitals cannot hide a copy. A document is a candidate for an item
once it holds half of the item's windows of either kind. Shared windows then vote for shifts (place in the
document less place in the item). A place is one shift, a range of nearby shifts (words were inserted) or
the whole text; in each that itself holds half of the windows, slots inside matched windows are laid on
the item's: one value of the item must always stand for the same value in the document. One consistent
place will do. So an exact copy passes wherever it stands, a question with other numbers or names passes
too, and unrelated text in the same mould fails.

All of it is Column expressions and joins. Only window hashes are exploded, and only those that the
benchmark holds survive the first join; the benchmark's windows are broadcast if they are counted to
be few, else the join shuffles.

Windows of which less than half is words count with the values that stand in them, so lists of figures are
found verbatim. An item of fewer tokens than a window is one window of all its plain tokens, found wherever
a document holds them in a row (a one-word item in every text with that word). A verbatim run of RUN tokens
is a leak whatever share of the item it is.

Defined results: null and empty texts and texts without letters or digits hold no windows; texts that
repeat an id are judged one by one, and any of them marks the document or item; empty tables give an empty
table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small

WIDTH, PERCENT = 8, 50
#: Tokens in a row that are a leak as they stand, whatever share of the item. It is above what a short question with one value changed still shares.
RUN = 30
#: Sizes of the ranges of shifts that make one place: insertions of up to half of one never part an item.
RANGES = (16, 128)
NUMBER, NAME, UNIT = "", "", ""
#: Fixed: units that count as such after a number.
UNITS = "km|cm|mm|m|kg|g|mg|lb|lbs|oz|s|ms|min|h|l|ml|hz|khz|mhz|ghz|kb|mb|gb|tb|w|kw|v|usd|eur|gbp|percent|dollars|euros|hours|minutes|seconds|days|weeks|months|years|miles|meters|metres|feet|inches|pounds|liters|litres|degrees"

#: (pattern, replacement) in order; a slot token is its placeholder followed by its value.
STEPS = [
    ("[-]", " "),
    (r"([0-9]+)", f" {NUMBER}$1 "),
    (rf"({NUMBER}[0-9]+ +)((?i:{UNITS}))([^\p{{L}}\p{{N}}]|$)", f"$1{UNIT}$2$3"),
    (r"([\p{Ll},;] )(\p{Lu})", f"$1{NAME}$2"),
]
JUNK = r"[^\p{L}\p{N}\x{e000}-\x{e002}]+"
SLOT = r"([\x{e000}-\x{e002}])[\p{L}\p{N}]+"
#: Slots of case-folded text. Case tells names, so there they are words.
FOLDED = r"([\x{e000}\x{e002}])[\p{L}\p{N}]+"


def _marked(text: Column) -> Column:
    for pattern, new in STEPS:
        text = F.regexp_replace(text, pattern, new)
    return F.trim(F.regexp_replace(F.lower(F.upper(text)), JUNK, " "))


def slot_tokens(text: Column) -> Column:
    """Tokens of ``text``; slots hold a placeholder and their value."""
    return F.split(_marked(text), " ")


def template_tokens(text: Column) -> Column:
    """Tokens of ``text``; slots are bare placeholders."""
    return F.split(F.regexp_replace(_marked(text), SLOT, "$1"), " ")


def _plain(token: Column) -> Column:
    return F.translate(token, NUMBER + NAME + UNIT, "")


def _windows(rows: DataFrame, least: Column, width: int) -> DataFrame:
    """``rows`` (text and others) without text, a row (at, x) per window of ``least`` tokens: its first token, and all tokens in a struct."""
    others = [c for c in rows.columns if c != "text"]
    marked = rows.select(*others, F.explode(F.array(_marked(F.col("text")))).alias("m")).where("m <> ''")
    forms = {"t": F.regexp_replace("m", SLOT, "$1"), "f": F.regexp_replace(F.translate("m", NAME, ""), FOLDED, "$1"), "e": _plain(F.col("m"))}
    figures = F.length("m") - F.length(F.translate("m", NUMBER + UNIT, ""))
    tokens = marked.select(*others, F.explode(F.array(F.struct(*[F.split(c, " ").alias(k) for k, c in forms.items()], (figures * 2 > width).alias("figures")))).alias("x"))
    many = F.size("x.t") - least
    return tokens.select(*others, "x", F.explode(F.when(many >= 0, F.sequence(F.lit(0), many))).alias("at"))


def _cut(form: str, width: int) -> Column:
    """A window that _windows gives. It is cut out of the tokens outside any lambda, so that the loop is compiled."""
    return F.slice(f"x.{form}", F.col("at") + 1, width)


def _folded(width: int) -> Column:
    """The hash of a case-folded window; where less than half of it is words, of the values that stand in it too."""
    words = F.size(F.array_remove(F.array_remove(_cut("f", width), NUMBER), UNIT))
    return F.when(F.col("x.figures") & (words * 2 < width), F.xxhash64(_cut("e", width))).otherwise(F.xxhash64(_cut("f", width)))


def _hashes(width: int, shorter: list[int]) -> Column:
    """Hashes of a window as a template and case-folded (one where it holds no name), and of ``shorter`` windows' plain tokens."""
    t, f = F.xxhash64(_cut("t", width)), _folded(width)
    within = lambda n: F.size("x.t") - F.col("at") >= n
    both = F.when(t == f, F.array(f)).otherwise(F.array(f, t))
    if not shorter:
        return both
    return F.concat(F.when(within(width), both).otherwise(F.array().cast("array<long>")), F.array(*[F.when(within(n), F.xxhash64(_cut("e", n))) for n in shorter]))


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows (item_id, part, i, size, hash, t, f) for windows of ``width`` tokens, or all tokens of a shorter item; part tells texts of one item_id apart.

    t: it is a window of the template, at least half literal words. f: of the case-folded text, where
    names are literal words, and figures keep their values if they are more than half.
    """
    rows = items.where("item_id is not null and length(text) > 0").select("item_id", F.xxhash64("text").alias("part"), "text").distinct()
    size = F.least(F.size("x.t"), F.lit(width))
    found = _windows(rows, size, width)
    kind = lambda h, t: F.struct(h.alias("hash"), F.lit(t).alias("t"), F.lit(1 - t).alias("f"))
    own = F.size(F.filter(_cut("t", width), lambda t: ~t.isin(NUMBER, NAME, UNIT)))
    short = F.array(kind(F.xxhash64(_cut("e", width)), 0))
    both = F.array(kind(_folded(width), 0), F.when(own * 2 >= width, kind(F.xxhash64(_cut("t", width)), 1)))
    out = found.select("item_id", "part", F.col("at").alias("i"), size.alias("size"), F.explode(F.when(size < width, short).otherwise(both)).alias("w")).where("w is not null")
    return out.groupBy("item_id", "part", "i", "size", "w.hash").agg(F.max("w.t").alias("t"), F.max("w.f").alias("f"))


def _places(shift: Column) -> Column:
    """The places a match belongs to: its own shift, ranges of nearby shifts (each twice, by half a range apart, so that none parts neighbours), and the whole text."""
    cut = lambda size, by: F.struct(F.lit(size + by).alias("range"), F.floor((shift + by) / size).cast("int").alias("nth"))
    return F.array(cut(1, 0), *[cut(size, by) for size in RANGES for by in (0, size // 2)], F.struct(F.lit(0).alias("range"), F.lit(0).alias("nth")))


def _slots(laid: Column, item: Column, doc: Column, width: int) -> Column:
    """Pairs (item's value, document's value) of slots inside the matched windows (i, shift)."""
    pairs = lambda w: F.transform(F.sequence(w["i"], w["i"] + width - 1), lambda k: F.struct(F.get(item, k).alias("v"), _plain(F.get(doc, k + w["shift"])).alias("u")))
    return F.array_distinct(F.filter(F.flatten(F.transform(laid, pairs)), lambda p: F.substring(p["v"], 1, 1).isin(NUMBER, NAME, UNIT)))


def _verbatim(laid: Column, item: Column, doc: Column, width: int) -> Column:
    """Tokens in the longest row of matched windows (i, shift) that agree in all values too."""
    plain = lambda tokens, at: F.transform(F.slice(tokens, at + 1, width), _plain)
    same = F.filter(laid, lambda w: plain(item, w["i"]) == plain(doc, w["i"] + w["shift"]))

    def step(a: Column, w: Column) -> Column:
        many = F.when((w["i"] == a["i"] + 1) & (w["shift"] == a["shift"]), a["many"] + 1).otherwise(F.lit(1))
        return F.struct(w["i"].alias("i"), w["shift"].alias("shift"), many.alias("many"), F.greatest(a["most"], many).alias("most"))

    start = F.struct(F.lit(-2).alias("i"), F.lit(0).alias("shift"), F.lit(0).alias("many"), F.lit(0).alias("most"))
    return F.aggregate(same, start, step, lambda a: a["most"] + width - 1)


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT, run: int = RUN, broadcast_windows: int = 1 << 20) -> DataFrame:
    """Rows (doc_id, item_id, n_shared, n_windows, n_slots, consistent) of documents (doc_id, text) that hold ``percent`` of an item's (item_id, text) windows, or ``run`` of its tokens in a row.

    The figures are those of the best place: a consistent one if there is any, then the one with most windows. A verbatim run is consistent.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    windows = scratch.keep(item_windows(items, width), "windows")
    pair, part = ["doc_id", "copy", "item_id", "part"], ["item_id", "part"]
    sizes = windows.groupBy(*part).agg(F.sum("t").alias("n_t"), F.sum("f").alias("n_f"))
    texts = docs.where("doc_id is not null and length(text) > 0").select("doc_id", F.xxhash64("text").alias("copy"), "text")
    shorter = [r[0] for r in windows.where(F.col("size") < width).select("size").distinct().orderBy("size").collect()]
    hashes = _windows(texts, F.lit(min([width, *shorter])), width).select("doc_id", "copy", F.col("at").alias("d"), F.explode(_hashes(width, shorter)).alias("hash"))
    found = hashes.join(small(windows, broadcast_windows), "hash").select(*pair, "i", (F.col("d") - F.col("i")).alias("shift"), "t", "f")
    matches = scratch.keep(found.distinct(), "matches")

    def enough(rows: DataFrame) -> DataFrame:
        share = lambda k: F.when(F.col(f"n_{k}") > 0, F.struct((F.col(f"s_{k}") / F.col(f"n_{k}")).alias("share"), F.col(f"s_{k}").alias("n_shared"), F.col(f"n_{k}").alias("n_windows")))
        return rows.join(small(sizes, broadcast_windows), part).withColumn("best", F.greatest(share("t"), share("f"))).withColumn("whole", 100 * F.col("best.n_shared") >= percent * F.col("best.n_windows")).where(F.col("whole") | (F.col("s_f") > run - width))

    counted = matches.groupBy(*pair, "i").agg(F.max("t").alias("t"), F.max("f").alias("f")).groupBy(*pair).agg(F.sum("t").alias("s_t"), F.sum("f").alias("s_f"))
    pairs = scratch.keep(enough(counted).select(*pair), "pairs")
    placed = matches.join(small(pairs, broadcast_windows), pair, "left_semi")
    placed = placed.groupBy(*pair, "i", "shift").agg(F.max("t").alias("t"), F.max("f").alias("f"))
    votes = placed.withColumn("votes", F.count("*").over(Window.partitionBy(*pair, "shift")))
    best = votes.select("*", F.explode(_places(F.col("shift"))).alias("place")).groupBy(*pair, "place", "i").agg(F.max_by(F.struct("shift", "t", "f"), F.struct("votes", -F.col("shift"))).alias("m"))
    laid = enough(best.groupBy(*pair, "place").agg(F.sum("m.t").alias("s_t"), F.sum("m.f").alias("s_f"), F.sort_array(F.collect_list(F.struct("i", "m.shift"))).alias("laid")))
    laid = laid.groupBy(*pair).agg(F.collect_set(F.struct("best.n_shared", "best.n_windows", "whole", "s_f", "laid")).alias("places"))

    ids = pairs.select("doc_id").distinct()
    own = texts.join(small(ids, broadcast_windows), "doc_id", "left_semi").distinct().join(laid, ["doc_id", "copy"])
    bench = items.where("item_id is not null and length(text) > 0").select("item_id", F.xxhash64("text").alias("part"), F.col("text").alias("item")).distinct()
    own = own.join(small(bench, 1 << 12), part)
    own = own.select("doc_id", "item_id", "places", F.explode(F.array(F.struct(slot_tokens(F.col("text")).alias("ds"), slot_tokens(F.col("item")).alias("is")))).alias("x"))
    own = own.select("doc_id", "item_id", "x", F.explode("places").alias("p"))
    row = F.when(F.col("p.s_f") > run - width, _verbatim(F.col("p.laid"), F.col("x.is"), F.col("x.ds"), width)).otherwise(F.lit(0)) >= run
    own = own.select("doc_id", "item_id", "p.n_shared", "p.n_windows", "p.whole", F.explode(F.array(F.struct(_slots(F.col("p.laid"), F.col("x.is"), F.col("x.ds"), width).alias("slots"), row.alias("run")))).alias("y"))
    even = F.size("y.slots") == F.size(F.array_distinct(F.transform("y.slots", lambda p: p["v"])))
    judged = own.where(F.col("whole") | F.col("y.run")).select("doc_id", "item_id", "n_shared", "n_windows", F.size("y.slots").cast("long").alias("n_slots"), (F.col("y.run") | (F.col("whole") & even)).alias("consistent"))
    top = judged.groupBy("doc_id", "item_id").agg(F.max(F.struct("consistent", (F.col("n_shared") / F.col("n_windows")).alias("share"), "n_shared", "n_windows", "n_slots")).alias("b"))
    return top.select("doc_id", "item_id", "b.n_shared", "b.n_windows", "b.n_slots", "b.consistent")


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Rows (doc_id, contaminated, n_items, item_id, percent) of the documents that hold an item with consistent slots, and of no others; item_id is the least such item."""
    found = contamination(docs, items, **options).where("consistent")
    share = F.floor(100 * F.col("n_shared") / F.col("n_windows"))
    return found.groupBy("doc_id").agg(F.lit(True).alias("contaminated"), F.count("*").alias("n_items"), F.min("item_id").alias("item_id"), F.max(share).cast("long").alias("percent"))
