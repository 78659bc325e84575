"""Removal of byte strings that occur elsewhere, by deep-shallow suffix sorting.

Every position that starts a string of ``length`` bytes is sorted among the positions it could equal:

1. One scan gives each position the least hash among the ``gram``-byte strings inside its window. Equal
   windows have equal keys, so a key's positions can be sorted apart from all others. Neighbouring
   positions with one key form a run; a run is emitted as its key, the BLAKE2b-128 digest of its bytes and
   its place, no text. Long texts are scanned in pieces that overlap by a window.
2. Keys with one run are done, unless the run repeats inside itself. Runs with equal key and digest
   repeat each other in whole. So sorting is left for keys under which different runs meet, the
   borders of repeated passages, with one run standing for all its copies.
3. Those runs' texts are fetched and their suffixes sorted: multikey quicksort, 8 bytes at a time, to
   a shallow depth; then the groups that still agree go into blind tries, which branch on the first
   byte that differs from the node's reference and skip all bytes in between. Suffixes that agree in
   ``length`` bytes repeat. A key with more runs or bytes than one task should sort is first split by depth
   over the cluster: its positions are dealt by their first 32 bytes, groups that are still too large by
   64 and so on, and sorted as before; at full depth a group is one string, which needs no sorting.
4. Repeated positions become byte spans, spans of a text are merged, and the rest is kept.

Strings are judged on the input. Matches never cross texts.

Defined results: null and empty texts, and texts shorter than ``length``, lose nothing; rows equal in
doc_id and text repeat each other; null ids are fine; an empty table gives an empty table; other columns,
whatever their names, are not read; texts of any length (under 2 GB) are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _POWERS, _TABLE, Scratch, mix, slices, small

LENGTH, GRAM, SHALLOW = 200, 40, 4  # bytes, bytes, 8-byte words
_U = np.uint64
_TOP = ~_U(0)
RUNS = "key long, digest binary, id long, h long, start int, n int, self boolean"
CUT = "key long, c long, id long, h long, start int, bytes binary"
SEGMENT = 1 << 20  # positions of a long text that are scanned at once


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """min(a[i : i + width]) for every whole window, from block-wise prefix and suffix minima."""
    n = len(a) - width + 1
    if n <= 0:
        return a[:0]
    blocks = np.concatenate([a, np.full(-len(a) % width, _TOP, a.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs_of(texts: list[bytes | None], length: int, gram: int):
    """(text, start, n, key, self) arrays of the runs of all texts."""
    data = np.frombuffer(b"".join([t or b"" for t in texts]), np.uint8)
    sizes = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    none = np.empty(0, np.int64)
    width = length - gram + 1
    if len(data) < length:
        return none, none, none, none.view(_U), none.astype(bool)
    up, down = _POWERS.to(len(data) + 1)
    letters = _TABLE[False].copy()
    letters[letters == 0] = mix(np.arange(901, 901 + int((letters == 0).sum()), dtype=_U)) | _U(1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(letters[data] * up[: len(data)], out=sums[1:])
    grams = mix((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])
    least = sliding_min(grams, width)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    valid = ends[owner] - np.arange(len(least)) >= length
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | ~valid[:-1]
    first = np.flatnonzero(change & valid)
    if not len(first):
        return none, none, none, none.view(_U), none.astype(bool)
    stop = np.searchsorted(np.flatnonzero(change | ~valid), first, "right")
    marks = np.append(np.flatnonzero(change | ~valid), len(least))
    n = marks[stop] - first
    key = least[first]

    # A run can repeat inside itself only if its least gram occurs in it twice, less than a window apart.
    far = ~sliding_min(np.concatenate([np.full(width - 1, _TOP), ~least, np.full(width - 1, _TOP)]), width)
    picked = np.flatnonzero(far[: len(grams)] == grams)
    p, q = picked[:-1], picked[1:]
    twice = (grams[p] == grams[q]) & (q - p <= width)
    p, q = p[twice], q[twice]
    again = np.zeros(len(first), bool)
    if len(p):
        low, high = (np.clip(np.searchsorted(first, np.maximum(x, 0), "right") - 1, 0, len(first) - 1) for x in (q - width + 1, p))
        for at in (low, high):
            again[at[key[at] == grams[p]]] = True
        for a, b, v in set(zip(low.tolist(), high.tolist(), grams[p].tolist(), strict=True)):
            if b - a > 1:
                again[a : b + 1] |= key[a : b + 1] == _U(v)
    return owner[first], first - (ends - sizes)[owner[first]], n, key, again


def _runs(length: int, gram: int, segment: int = SEGMENT):
    def parts(texts: list[bytes | None]) -> Iterator[tuple[list, int, int]]:
        """(texts, number of the first, place in it). A run that a segment ends is two runs of one key, which are sorted among the others like any."""
        if max(len(t or b"") for t in texts) <= segment:
            yield texts, 0, 0
            return
        for k, t in enumerate(texts):
            for at in range(0, len(t or b"") - length + 1, segment):
                yield [t[at : at + segment + length - 1]], k, at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            for some, k, at in parts(texts):
                owner, start, n, key, again = runs_of(some, length, gram)
                digests = [hashlib.blake2b(some[o][a:b], digest_size=16).digest() for o, a, b in zip(owner.tolist(), start.tolist(), (start + n + length - 1).tolist(), strict=True)]
                ids, h = (np.asarray(part.column(c), np.int64)[owner + k] for c in ("id", "h"))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(digests, pa.binary()), pa.array(ids), pa.array(h), pa.array((start + at).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(again)], ["key", "digest", "id", "h", "start", "n", "self"])

    return run


def _splits(changed: np.ndarray) -> np.ndarray:
    """Dense labels from marks of where a sorted sequence begins a new class."""
    return np.cumsum(changed) - 1


def suffix_classes(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, label): suffixes ``at`` of ``data`` sorted by their first ``length`` bytes within each group, and the class of each in that order.

    Equal labels are equal strings of the same group. ``data`` must go 8 bytes beyond each string.
    """
    words = np.lib.stride_tricks.sliding_window_view(data, 8)

    def word(k: int, which: np.ndarray) -> np.ndarray:
        w = np.ascontiguousarray(words[at[which] + 8 * k]).view(">u8").ravel().astype(_U)
        rest = length - 8 * k
        return w if rest >= 8 else w >> _U(8 * (8 - rest))

    depth = -(-length // 8)
    # Shallow: a ternary split on one 8-byte letter is a sort by (class, letter); only classes with several members go on.
    _, rank, count = np.unique(group, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - count)[rank]
    open_ = np.arange(len(at))
    for k in range(min(shallow, depth)):
        open_ = open_[np.bincount(rank[open_])[rank[open_]] > 1]
        rank[open_] = _refine(rank, open_, [word(k, open_)])
    # Deep: one blind trie per class, all tries a level at a time.
    solved = np.zeros(len(at), bool)
    while True:
        open_ = np.flatnonzero((np.bincount(rank)[rank] > 1) & ~solved)
        if not len(open_):
            break
        open_ = open_[np.argsort(rank[open_], kind="stable")]
        head = np.concatenate([[True], rank[open_][1:] != rank[open_][:-1]])
        reference = open_[head][_splits(head)]
        skip = np.full(len(open_), depth, np.int64)
        mine, theirs = np.zeros(len(open_), _U), np.zeros(len(open_), _U)
        left = np.arange(len(open_))
        for k in range(min(shallow, depth), depth):
            a, b = word(k, open_[left]), word(k, reference[left])
            differ = a != b
            hit = left[differ]
            skip[hit], mine[hit], theirs[hit] = k, a[differ], b[differ]
            left = left[~differ]
            if not len(left):
                break
        equal = skip == depth
        side = np.where(equal, 1, np.where(mine < theirs, 0, 2))
        # In order: smaller ones that leave the reference early, then late; the equal; larger ones late, then early.
        rank[open_] = _refine(rank, open_, [mine, np.where(side == 2, -skip, skip).astype(np.int64), side])
        solved[open_[equal]] = True
    order = np.argsort(rank, kind="stable")
    return order, rank[order]


def _refine(rank: np.ndarray, which: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """New ranks of the members ``which``, split by ``keys`` (last one first); ranks of different old classes stay in order and disjoint.

    Ranks are positions: a class's rank is the number of members in smaller classes, so splitting one class moves no other.
    """
    if not len(which):
        return rank[which]
    order = np.lexsort([*keys, rank[which]])
    old = rank[which][order]
    new = np.ones(len(order), bool)
    new[1:] = old[1:] != old[:-1]
    classes = np.flatnonzero(new)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    inside = np.arange(len(order)) - classes[np.searchsorted(classes, np.arange(len(order)), "right") - 1]
    starts = np.flatnonzero(new)
    out = np.empty(len(order), np.int64)
    out[order] = old + inside[starts][_splits(new)]
    return out


def repeated_positions(texts: list[bytes], copies: np.ndarray, keys: np.ndarray, length: int) -> list[np.ndarray]:
    """For each run's bytes, which of its positions repeat: in another run of its key, in itself, or because the run has copies."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n = sizes - length + 1
    base = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), n)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    data = np.frombuffer(b"".join(texts) + b"\0" * 16, np.uint8)
    order, label = suffix_classes(data, base[owner] + inside, keys[owner], length)
    first = np.concatenate([[True], label[1:] != label[:-1]])
    weight = np.add.reduceat(copies[owner][order], np.flatnonzero(first))
    flags = np.empty(len(owner), bool)
    flags[order] = (weight > 1)[_splits(first)]
    return np.split(flags, np.cumsum(n)[:-1])


def _sorted_groups(length: int, most: int):
    """Over rows (key, c, id, h, start, bytes) ordered by key: byte spans (id, h, low, high) that repeat. ``most``: bytes sorted at once."""

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        keys = np.array([r[0] for r in rows], np.int64)
        found = repeated_positions([r[5] for r in rows], np.array([r[1] for r in rows], np.int64), keys, length)
        out = []
        for (_, c, i, h, start, _), flags in zip(rows, found, strict=True):
            if c == 1 and flags.any():
                edge = np.diff(np.concatenate([[False], flags, [False]]).view(np.int8))
                for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                    out.append((i, h, start + a, start + b + length - 1))
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["id", "h", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # A batch of whole groups is sorted once it is large enough; only a single key's own runs can make it larger.
                if held >= most and waiting[-1][0] != row[0]:
                    yield spans(waiting)
                    waiting, held = [], 0
                waiting.append(row)
                held += len(row[5])
        if waiting:
            yield spans(waiting)

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "c", "id", "h", "start", "bytes"]
        for part, texts in slices(batches):
            rows = []
            for i, h, text, wanted in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, part.column(3).to_pylist(), strict=True):
                rows += [(w["key"], w["c"], i, h, w["start"], text[w["start"] : w["start"] + w["n"] + length - 1]) for w in wanted]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return run


def _positions(length: int, most: int = 1 << 12):
    """A row per position of each run, in the form of a run of one position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, c, i, h, start, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                n = len(text) - length + 1
                for at in range(0, n, most):
                    m = min(most, n - at)
                    same = lambda v, m=m: pa.array(np.full(m, v, np.int64))
                    yield pa.RecordBatch.from_arrays([same(key), same(c), same(i), same(h), pa.array(np.arange(start + at, start + at + m, dtype=np.int32)), pa.array([text[k : k + length] for k in range(at, at + m)])], batch.schema.names)

    return run


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches):
        rows = []
        for i, h, text, spans in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, part.column(3).to_pylist(), strict=True):
            merged: list[list[int]] = []
            for low, high in sorted((s["low"], s["high"]) for s in spans):
                if merged and low <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], high)
                else:
                    merged.append([low, high])
            left, at = [], 0
            for low, high in merged:
                left.append(text[at:low])
                at = high
            left.append(text[at:])
            rest = b"".join(left)
            rows.append((i, h, len(text) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), rest))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["id", "h", "n_removed", "n_spans", "kept_sha256", "kept"])


def _split_by_depth(positions: DataFrame, scratch: Scratch, length: int, crowd: int, broadcast_ids: int) -> tuple[DataFrame, DataFrame]:
    """(rows of CUT to sort, their key a group of at most ``crowd`` positions; spans of the groups that are one string).

    Groups are strings of one key that agree in a prefix, which doubles until they are few enough.
    """
    left, depth, groups, spans = positions, 8 * SHALLOW, None, None
    while spans is None:
        depth = min(depth, length)
        dealt = left.withColumn("key", F.xxhash64("key", F.substring("bytes", 1, depth)))
        size = scratch.keep(dealt.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), "sizes")
        few = dealt.join(small(size.where(F.col("k") <= crowd).select("key"), broadcast_ids), "key", "left_semi")
        groups = few if groups is None else groups.unionByName(few)
        left = scratch.keep(dealt.join(small(size.where(F.col("k") > crowd).select("key"), broadcast_ids), "key", "left_semi"), "crowded")
        if depth == length:
            twice = left.groupBy("key", "bytes").agg(F.sum("c").alias("k")).where("k > 1").select("key", "bytes")
            spans = left.where("c = 1").join(twice, ["key", "bytes"], "left_semi").select("id", "h", F.col("start").alias("low"), (F.col("start") + length).alias("high"))
        depth *= 2
    return groups, spans


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, batch_bytes: int = 1 << 20, broadcast_ids: int = 1 << 20, crowd: int = 1 << 13, crowd_bytes: int = 1 << 25, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(spans, texts): rows (id, h, low, high) of repeated byte spans, and rows (id, h, text) of the texts that have some or might.

    ``crowd``, ``crowd_bytes``: different runs and bytes of a key that one task sorts as they are. ``segment``: positions of a long text that are scanned at once.
    """
    scan = docs.where(F.octet_length("text") >= length)
    runs = scratch.keep(scan.mapInArrow(_runs(length, gram, segment), RUNS), "runs")
    keys = runs.groupBy("key").agg(F.count("*").alias("total"), F.bool_or("self").alias("any")).where("total > 1 or any").select("key")
    met = scratch.keep(runs.join(keys, "key"), "met")
    scratch.drop(runs)
    copies = met.groupBy("key", "digest").agg(F.count("*").alias("c"), F.min(F.struct("id", "h", "start", "n")).alias("r"), F.bool_or("self").alias("any"))
    copies = scratch.keep(copies, "copies")
    whole = met.join(copies.where("c > 1").select("key", "digest"), ["key", "digest"]).select("id", "h", F.col("start").alias("low"), (F.col("start") + F.col("n") + length - 1).alias("high"))
    whole = scratch.keep(whole, "whole")
    mixed = copies.groupBy("key").agg(F.count("*").alias("kinds"), F.sum(F.col("r.n") + length).alias("bytes"), F.bool_or(F.col("any") & (F.col("c") == 1)).alias("own")).where("kinds > 1 or own")
    hot = (F.col("kinds") > crowd) | (F.col("bytes") > crowd_bytes)
    border = scratch.keep(copies.join(mixed.select("key", hot.alias("hot")), "key").select("key", "hot", "c", "r.*"), "border")
    scratch.drop(met, copies)
    ids = scratch.keep(whole.select("id", "h").union(border.select("id", "h")).distinct(), "ids")
    texts = scratch.keep(scan.join(small(ids, broadcast_ids), ["id", "h"], "left_semi"), "texts")
    any_hot = border.where("hot").limit(1).count() > 0

    def cut(runs: DataFrame) -> DataFrame:
        wanted = runs.groupBy("id", "h").agg(F.collect_list(F.struct("key", "c", "start", "n")).alias("wanted"))
        return texts.dropDuplicates(["id", "h"]).join(wanted, ["id", "h"]).select("id", "h", "text", "wanted").mapInArrow(_cut(length), CUT)

    def sorted_spans(runs: DataFrame) -> DataFrame:
        ordered = runs.repartition("key").sortWithinPartitions("key")
        return scratch.keep(ordered.mapInArrow(_sorted_groups(length, batch_bytes), "id long, h long, low int, high int"), "spans")

    spans = whole.union(sorted_spans(cut(border.where("not hot"))))
    if any_hot:
        positions = scratch.keep(cut(border.where("hot")).mapInArrow(_positions(length), CUT), "positions")
        groups, same = _split_by_depth(positions, scratch, length, crowd, broadcast_ids)
        spans = spans.union(sorted_spans(groups)).union(same)
    return spans, texts


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, texts_out: bool = False, **options) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row of ``docs`` (doc_id, text); kept: the remaining bytes."""
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    null = -(1 << 63)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(null)).alias("id"), F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    spans, texts = repeated_spans(rows.select("id", "h", "text"), scratch, length, gram, **options)
    listed = spans.groupBy("id", "h").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    cut = texts.dropDuplicates(["id", "h"]).join(listed, ["id", "h"]).select("id", "h", "text", "spans").mapInArrow(_keep, "id long, h long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    cut = scratch.keep(cut if texts_out else cut.drop("kept"), "cut")
    base = rows.select("doc_id", "id", "h", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("all"), *([F.col("text").cast("binary").alias("whole")] if texts_out else []))
    zero = F.lit(0).cast("long")
    out = [F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "all").alias("kept_sha256")]
    return base.join(cut, ["id", "h"], "left").select("doc_id", "n_bytes", *out, *([F.coalesce("kept", "whole").alias("kept")] if texts_out else []))
