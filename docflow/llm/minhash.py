"""Near-duplicate groups: one-permutation MinHash with optimal densification, banded, star edges.

1. One scan turns each text into its set of shingle hashes, a fingerprint of that set and band keys.
   The 64-bit hashes fall into ``bins`` bins by their top bits; each bin keeps its least value. An
   empty bin copies the first filled bin on its own fixed random tour, so that every bin of the
   signature agrees with probability J, also for sets smaller than the number of bins.
2. Rows with equal sets are one node (its id: the least doc_id), so copies make no pairs.
3. Every bucket (band, key) elects one centre and links its other members to it: as many candidate
   edges as members. Edges are confirmed on the full sets, and components formed.
4. Exactness: what no star has settled, pairs of one bucket in different components, is confirmed too:
   in small buckets pair by pair, in crowded ones for pairs that share a rare shingle (an exact prefix
   filter). There is no cap on buckets or partners.

At 32 bands of 4 a pair with J = 0.8 shares no bucket with probability 5e-8.

Defined results: null or wordless text has n_shingles 0 and no links; rows that repeat a doc_id are one
document; a null doc_id takes the component of its text's set, null if no other row has it; an empty
table gives an empty table; other columns are not read, whatever their names; a text of any length is taken
whole, its words hashed a piece at a time (8 bytes of memory a word and array, of which there are about six).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix, slices, small, word_hashes
from .components import connected_components

_U = np.uint64
_STEPS = mix(np.arange(1, 65, dtype=_U)) | _U(1)


def shingle_sets(texts: list[bytes | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's runs of ``size`` words (of all its words as one, if there are fewer), and where each text's end."""
    h, stops = word_hashes(texts)
    starts = np.concatenate([[0], stops[:-1]])
    runs = np.zeros(max(0, len(h) - size + 1), _U)
    for k in range(size):
        runs += h[k : k + len(runs)] * _STEPS[k]
    runs = mix(runs + _U(size))
    sets = []
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        if b - a >= size:
            own = np.sort(runs[a : b - size + 1])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            sets.append(mix(np.array([(h[a:b] * _STEPS[: b - a]).sum(dtype=_U) + _U(b - a)])) if b > a else h[:0])
    return (np.concatenate(sets) if sets else h[:0]), np.cumsum([len(s) for s in sets])


@lru_cache(4)
def _tours(bins: int) -> np.ndarray:
    return np.stack([np.random.default_rng(k).permutation(bins) for k in range(bins)])


def signatures(shingles: np.ndarray, owner: np.ndarray, n: int, bins: int) -> np.ndarray:
    """The least hash in each of ``bins`` (a power of two) bins of each of ``n`` owners' sorted sets; empty bins borrow along their tours."""
    where = owner * bins + (shingles >> _U(65 - bins.bit_length())).astype(np.int64)
    first = np.flatnonzero(np.diff(where, prepend=-1))
    out, filled = np.zeros(n * bins, _U), np.zeros(n * bins, bool)
    out[where[first]], filled[where[first]] = shingles[first], True
    empty = np.flatnonzero(~filled & np.repeat(filled.reshape(n, bins).any(1), bins))
    tours, base, slot = _tours(bins), empty // bins * bins, empty % bins
    for step in range(bins):
        lender = base + tours[slot, step]
        hit = filled[lender]
        out[empty[hit]] = out[lender[hit]]
        empty, base, slot = empty[~hit], base[~hit], slot[~hit]
        if not len(empty):
            break
    return out.reshape(n, bins)


def band_keys(sigs: np.ndarray, rows: int) -> np.ndarray:
    table = sigs.reshape(len(sigs), -1, rows)
    return mix((table * _STEPS[:rows]).sum(2, dtype=_U) + np.arange(table.shape[1], dtype=_U) * _STEPS[40])


def _sketch(size: int, bins: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            items, stops = shingle_sets(texts, size)
            counts = np.diff(stops, prepend=0)
            keys = band_keys(signatures(items, np.repeat(np.arange(len(texts)), counts), len(texts), bins), rows).view(np.int64)
            prints = [xxhash.xxh3_128_digest(items[b - n : b]) if n else None for b, n in zip(stops.tolist(), counts.tolist(), strict=True)]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), pa.array(prints, pa.binary()), bands], ["doc_id", "n_shingles", "print", "bands"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            items, stops = shingle_sets(texts, size)
            sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()), pa.array(items.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), sets], ["id", "items"])

    return run


def _confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int, most: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Only texts that some pair names are read again."""
    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    named = docs.join(small(ends, most), "doc_id", "left_semi").select("doc_id", "text")
    sets = named.mapInArrow(_sets(size), "id long, items array<long>").where("size(items) > 0")
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("ib")), "b").join(sets.select(F.col("id").alias("a"), F.col("items").alias("ia")), "a")
    shared = F.size(F.array_intersect("ia", "ib"))
    return both.where(100 * shared >= percent * (F.size("ia") + F.size("ib") - shared)).select("a", "b")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bins: int = 128, rows: int = 4, crowd: int = 24, broadcast_ids: int = 1 << 20) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Texts with 100 * |A & B| >= percent * |A | B| are linked. component_id is the smallest doc_id
    reachable; kept is doc_id = component_id. Of rows that repeat a kept doc_id, all are kept.
    ``crowd``: buckets up to this size are settled pair by pair, larger ones by rare shingles.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = scratch.keep(docs.mapInArrow(_sketch(size, bins, rows), "doc_id long, n_shingles long, print binary, bands array<long>"), "sketch")
    groups = scratch.keep(sketch.where("print is not null").groupBy("print").agg(F.min("doc_id").alias("id")), "groups")
    nodes = sketch.where("doc_id is not null").join(groups.where("id is not null"), (sketch["print"] == groups["print"]) & (F.col("doc_id") == F.col("id"))).select("id", "n_shingles", "bands")
    members = nodes.select("id", "n_shingles", F.explode("bands").alias("bucket")).distinct()
    crowded = members.groupBy("bucket").agg(F.count("*").alias("many")).where("many > 1")
    members = scratch.keep(members.join(crowded, "bucket"), "members")

    # The centre of a bucket is its member with the most neighbours over all buckets, likely what the others were made from.
    degree = members.groupBy("id").agg(F.sum("many").alias("degree"))
    placed = members.join(degree, "id")
    centre = placed.groupBy("bucket").agg(F.min(F.struct(-F.col("degree"), F.col("id").alias("id"), F.col("n_shingles").alias("n"))).alias("centre"))
    star = placed.join(centre, "bucket").where("id <> centre.id").where(100 * F.least("n_shingles", "centre.n") >= percent * F.greatest("n_shingles", "centre.n"))
    tested = scratch.keep(star.select(F.greatest("id", "centre.id").alias("a"), F.least("id", "centre.id").alias("b")).distinct(), "star")
    links = scratch.keep(_confirm(tested, docs, size, percent, broadcast_ids), "links")
    component = scratch.keep(connected_components(links, scratch), "components")

    placed = members.join(component, members["id"] == component["node"], "left").select("bucket", "id", "n_shingles", "many", F.coalesce("component", "id").alias("c"))
    mixed = placed.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("bucket")
    rest = scratch.keep(placed.join(mixed, "bucket"), "mixed")
    pairs = _small_crowds(rest.where(F.col("many") <= crowd), percent).union(_large_crowds(rest.where(F.col("many") > crowd), docs, size, percent, broadcast_ids, scratch))
    pairs = scratch.keep(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "rest")
    if pairs.limit(1).count():
        found = scratch.keep(_confirm(pairs, docs, size, percent, broadcast_ids), "links")
        if found.limit(1).count():
            component = scratch.keep(connected_components(links.union(found), scratch), "components")
    scratch.leave(sketch, groups, component)
    label = groups.join(component, groups["id"] == component["node"], "left").select("print", F.coalesce("component", "id").alias("label"))
    out = sketch.join(label, "print", "left").select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _small_crowds(rest: DataFrame, percent: int) -> DataFrame:
    """All pairs of one bucket in different components; a bucket is at most a crowd, so rows stay in proportion."""
    left, right = rest.select("bucket", "id", "n_shingles", "c"), rest.select("bucket", F.col("id").alias("id2"), F.col("n_shingles").alias("n2"), F.col("c").alias("c2"))
    fits = 100 * F.least("n_shingles", "n2") >= percent * F.greatest("n_shingles", "n2")
    pairs = left.join(right, (left["bucket"] == right["bucket"]) & (F.col("c") < F.col("c2")) & fits)
    return pairs.select(F.greatest("id", "id2").alias("a"), F.least("id", "id2").alias("b"))


def _large_crowds(rest: DataFrame, docs: DataFrame, size: int, percent: int, most: int, scratch: Scratch) -> DataFrame:
    """Pairs in different components whose sets can still be similar enough, by exact prefix filtering.

    With all shingles in one order, rarest first, two sets that share x of their items share one of
    the first |A| - x + 1 of either. In a crowd of near copies the rare ones are each text's own
    edits, so texts that are too far apart share none of them, and no pair is made.
    """
    who = scratch.keep(rest.select("id", "c").distinct(), "crowd")
    named = docs.join(small(who.select(F.col("id").alias("doc_id")), most), "doc_id", "left_semi").select("doc_id", "text")
    items = scratch.keep(named.mapInArrow(_sets(size), "id long, items array<long>").where("size(items) > 0").select("id", F.size("items").alias("n"), F.explode("items").alias("item")).distinct(), "items")
    counted = items.join(items.groupBy("item").agg(F.count("*").alias("df")), "item")
    longest = F.floor(F.col("n") * (100 - percent) / 100) + 1
    order = counted.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("order")).join(who, "id")
    early = scratch.keep(order.select("id", "n", "c", F.posexplode(F.slice("order", F.lit(1), longest.cast("int"))).alias("at", "entry")).select("id", "n", "c", (F.col("at") + 1).alias("at"), "entry.item"), "early")
    # Of an item's rows, those of its most frequent component make no pairs with each other: only the others look for partners.
    usual = early.groupBy("item", "c").agg(F.count("*").alias("k")).groupBy("item").agg(F.max_by("c", F.struct("k", "c")).alias("usual"), F.count("*").alias("kinds")).where("kinds > 1")
    left = early.join(usual, "item").where("c <> usual").select("item", "id", "n", "c", "at")
    right = early.select("item", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("c").alias("c2"), F.col("at").alias("at2"))
    need = F.ceil((F.col("n") + F.col("n2")) * percent / (100.0 + percent) - 1e-9)
    fits = (F.col("c") != F.col("c2")) & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")) & (F.col("at") <= F.col("n") - need + 1) & (F.col("at2") <= F.col("n2") - need + 1)
    pairs = left.join(right, (left["item"] == right["item"]) & fits)
    return pairs.select(F.greatest("id", "id2").alias("a"), F.least("id", "id2").alias("b"))
