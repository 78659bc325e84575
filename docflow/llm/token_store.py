"""Token ids in a content-addressed store.

Layout of a store, all Parquet in one folder:

* ``packed/kind=chunk``: digest, payload. Every distinct run of ids once. The payload is little-endian
  unsigned integers of ``width`` bytes; the digest is BLAKE2b-128 of it.
* ``recipes``: part, ordinal, local, doc_id, n_tokens, root, digests, lengths, in ascending (doc_id, root)
  over and within the parts. ``digests`` and ``lengths`` list a document's chunks; ``root`` is its Merkle root.
* ``manifest``: part, first ids of the part in the whole id stream, counts, the Merkle root of the part's
  recipes, and the Merkle root over all parts.

Chunks end where a rolling hash over the last 16 ids has its low bits clear, so equal passages give
equal chunks wherever they lie, and insertions only change chunks near them. Writing takes one scan
(texts are encoded once) and one shuffle of chunks by digest, after each task has dropped its own
repeats; what is left of them meets in the shuffle's sort, which spills.

Reading recomputes the Merkle trees from the recipes and raises where they differ from the manifest
(a recipe or part is lost, added or changed, a count or root is wrong), checks every payload against
its digest, every recipe against its root, and raises on a missing chunk. The trees have 4096 children a node;
each level is a grouped aggregate of bounded groups. A document's crc32 is put together from its
chunks' crc32s, which is linear, so no payload is shuffled on the way back and no document is gathered.

Defined results: a null text counts as empty and is the end id alone; rows that repeat a doc_id are
kept, ordered by their roots; null ids come first; an empty table gives an empty store and table; other
columns, whatever their names, are not read; a text of any length is encoded whole, in memory of some
times its size.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vocab
from .common import Scratch, batch_rows, mix, slices

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
WINDOW, LEAST, MEAN, MOST = 16, 64, 256, 1024  # ids
SEEN = 1 << 16  # digests a task remembers, to drop its repeats before the shuffle
FAN = 1 << 12  # children of a node in a part's Merkle tree
PIECES = 5 << 17  # pieces of a generation of those that are remembered
BLOCK = 1 << 20  # bytes of a long text that are worked on at once
NEAR = 1 << 15  # ids that are hashed at once, so that they stay in the processor's cache

#: White space other than spaces and line ends: in ASCII, by first byte outside it, and outside it.
OTHER = bytes([9, 11, 12, 13, 28, 29, 30, 31])
WIDE = {b"\xc2": re.compile(rb"\xc2[\x85\xa0]"), b"\xe1": re.compile(rb"\xe1\x9a\x80"), b"\xe2": re.compile(rb"\xe2(?:\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f)"), b"\xe3": re.compile(rb"\xe3\x80\x80")}
#: A single space between other characters: a token begins there.
CUT = re.compile(rb"(?<=[^\x09-\x0d\x1c-\x20]) (?=[^\x09-\x0d\x1c-\x20])")
#: Letters of vocab.PLAIN in UTF-8 and then punctuation, each of which is a pre-token by itself.
SIMPLE = re.compile(rb"( ?)((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])*)([!-&(-/:-@\[-`{-~]*)")

#: The punctuation of SIMPLE.
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 39)


def has_wide_space(text: bytes) -> bool:
    return not text.isascii() and any(first in text and found.search(text) is not None for first, found in WIDE.items())


class PieceIds(vocab.Remembered):
    """Packed ids of ``b" " + piece``; a key that begins with a space stands for the piece without it."""

    def __init__(self, file: str, width: int):
        super().__init__(PIECES)
        self.tokenizer = vocab.load(file)
        self.merge = self.tokenizer.model.tokenize
        self.letters, self.space, self.kind = "".join(vocab.byte_letters()), vocab.spelled(" "), "H" if width == 2 else "I"
        self.line = self[b" \n"]
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def pack(self, ids: list[int]) -> bytes:
        try:
            out = array(self.kind, ids)
        except OverflowError:
            raise ValueError("ids of this vocabulary need width 4") from None
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def whole(self, text: bytes) -> bytes:
        return self.pack(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids)

    def merged(self, token: bytes) -> bytes:
        """The packed ids of one pre-token, space included."""
        return self.pack([t.id for t in self.merge(codecs.charmap_decode(token, "strict", self.letters)[0])])

    def __missing__(self, piece: bytes) -> bytes:
        value = self.old.get(piece)
        if value is None:
            # Punctuation after a word is a pre-token of its own, so the word is looked up by itself.
            word = piece.rstrip(PUNCTUATION)
            if not word.isalpha():
                value = self.made(piece)
            elif len(word) < len(piece):
                value = self[word] + self[b" " + piece[len(word) :]]
            else:
                value = self.pack([t.id for t in self.merge(self.space + piece.decode())])
        return self.keep(piece, value)

    def made(self, piece: bytes) -> bytes:
        m = SIMPLE.fullmatch(piece)
        if m is None:
            return self.whole(piece[1:] if piece[:1] == b" " else b" " + piece)
        if m[2] and m[3]:
            return self[m[1] + m[2]] + self[b" " + m[3]]
        return self.merged(piece[1:] if m[1] else b" " + piece)

    def text(self, text: bytes) -> bytes:
        if has_wide_space(text) or any(a in text for a in self.added):
            return self.whole(text)
        parts, at = [], 0
        while len(text) - at > BLOCK and (m := CUT.search(text, at + BLOCK)):
            parts.append(self.block(text[at : m.start()]))
            at = m.start()
        parts.append(self.block(text[at:] if at else text))
        return b"".join(parts)

    def block(self, text: bytes) -> bytes:
        if len(text.translate(None, OTHER)) < len(text) or text[-1:] == b" " or b"  " in text or b" \n" in text or b"\n " in text:
            first, *rest = CUT.split(text)
            return self[b" " + first] + b"".join(map(self.__getitem__, rest))
        # Of the line ends before a line the last is a pre-token of its own; those at the end of the text are one.
        out, ends, get = [], 0, self.__getitem__
        for line in text.split(b"\n"):
            if line:
                if ends:
                    out.append(self[b" " + b"\n" * (ends - 1)] + self.line if ends > 1 else self.line)
                words = line.split(b" ")
                words[:1] = [b" " + words[0]] if words[0] else []
                out += map(get, words)
                ends = 0
            ends += 1
        if ends > 1:
            out.append(self[b" " + b"\n" * (ends - 1)])
        return b"".join(out)


@lru_cache(4)
def _pieces(file: str, width: int) -> PieceIds:
    return PieceIds(file, width)


_GEAR = mix(np.arange(1, (1 << 18) + 1, dtype=np.uint64))


def cut_points(ids: np.ndarray, stops: np.ndarray) -> list[list[int]]:
    """Where each document's chunks end, for documents laid end to end in ``ids``."""
    marks = []
    step = min(BLOCK, NEAR)
    for at in range(0, len(ids), step):
        low = max(0, at - WINDOW + 1)
        h = _GEAR[ids[low : at + step].astype(np.int64) & 0x3FFFF]
        span = 1
        while span < WINDOW:
            h[span:] = h[span:] + (h[:-span] << np.uint64(span))
            span *= 2
        marks += (np.flatnonzero((mix(h[at - low :]) & np.uint64(MEAN - 1)) == 0) + at + 1).tolist()
    cuts, k, start = [], 0, 0
    for stop in stops.tolist():
        own, last = [], start
        while last < stop:
            while k < len(marks) and marks[k] < last + LEAST:
                k += 1
            cut = min(stop, last + MOST, marks[k] if k < len(marks) else stop)
            own.append(cut)
            last = cut
        cuts.append(own)
        start = stop
    return cuts


def merkle(leaves: list[bytes]) -> bytes:
    """The root over 16-byte digests: pairs are hashed level by level, an odd last one moves up; none gives the hash of nothing."""
    if not leaves:
        return hashlib.blake2b(b"", digest_size=16).digest()
    while len(leaves) > 1:
        pairs = [hashlib.blake2b(b"\x01" + leaves[i] + leaves[i + 1], digest_size=16).digest() for i in range(0, len(leaves) - 1, 2)]
        leaves = pairs + leaves[len(pairs) * 2 :]
    return hashlib.blake2b(b"\x00" + leaves[0], digest_size=16).digest()


ROWS = "kind string, digest binary, payload binary, spread long, doc_id long, n_tokens long, root binary, digests binary, lengths array<int>"
RECIPES = "part int, ordinal long, local long, doc_id long, n_tokens long, root binary, digests binary, lengths array<int>"
_ARROW = pa.schema([("kind", pa.string()), ("digest", pa.binary()), ("payload", pa.binary()), ("spread", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("digests", pa.binary()), ("lengths", pa.list_(pa.int32()))])


def _encode(file: str, end_id: int, width: int):
    """Rows of ROWS: chunks, a task's own repeats left out as far as it remembers them, and recipes, each with a ``spread`` of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, seen, spread = _pieces(file, width), set(), TaskContext.get().partitionId() << 36
        end = pieces.pack([end_id])
        for part, texts in slices(batches):
            packed = [pieces.text(t) + end if t else end for t in texts]
            flat = b"".join(packed)
            stops = np.cumsum([len(p) // width for p in packed])
            chunks, recipes, start = [], [], 0
            for doc, cuts in zip(part.column(0).to_pylist(), cut_points(np.frombuffer(flat, f"<u{width}"), stops), strict=True):
                names, sizes, first = [], [], start
                for cut in cuts:
                    payload = flat[start * width : cut * width]
                    name = hashlib.blake2b(payload, digest_size=16).digest()
                    names.append(name)
                    sizes.append(cut - start)
                    start = cut
                    if name not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(name)
                        chunks.append((name, payload))
                recipes.append((spread, doc, start - first, merkle(names), b"".join(names), sizes))
                spread += 1
            for k, rows in (("chunk", chunks), ("recipe", recipes)):
                if rows:
                    cols = list(zip(*rows, strict=True))
                    values = [[k] * len(rows), *cols, *[None] * 6] if k == "chunk" else [[k] * len(rows), None, None, *cols]
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), f.type) if v is None else pa.array(v, f.type) for v, f in zip(values, _ARROW, strict=True)], schema=_ARROW)

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at, nth = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = np.asarray(batch.column(1), np.int64)
        starts = at + np.cumsum(n) - n
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(nth + np.arange(len(n))), pa.array(starts), *batch.columns], ["part", "ordinal", "local", *batch.schema.names])
        at, nth = at + int(n.sum()), nth + len(n)


MANIFEST = "part int, start long, n_docs long, n_tokens long, first_doc long, last_doc long, seal binary, root binary"


def _leaf(*parts: object) -> bytes:
    return hashlib.blake2b(repr(parts).encode(), digest_size=16).digest()


def manifest_of(recipes: DataFrame) -> list[tuple]:
    """Rows of MANIFEST as the recipes themselves have it. What is collected is a row per part and FAN ** 2 documents."""
    leaf = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("ordinal", "local", "doc_id", "n_tokens")], F.hex("root")), 256)
    level = recipes.select("part", "ordinal", leaf.alias("digest"), F.lit(1).cast("long").alias("n_docs"), "n_tokens", F.col("doc_id").alias("first_doc"), F.col("doc_id").alias("last_doc"))
    for _ in range(2):
        below = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "digest"))), lambda x: x["digest"]), "")
        level = level.groupBy("part", F.floor(F.col("ordinal") / FAN).alias("ordinal")).agg(F.sha2(below, 256).alias("digest"), F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"))
    parts: dict[int, list] = {}
    for r in level.orderBy("part", "ordinal").collect():
        parts.setdefault(r["part"], []).append(r)
    listed, at = [], 0
    for part, nodes in parts.items():
        known = lambda c, nodes=nodes: [r[c] for r in nodes if r[c] is not None]
        n_docs, n_tokens = sum(known("n_docs")), sum(known("n_tokens"))
        seal = merkle([_leaf(r["ordinal"], r["digest"]) for r in nodes])
        listed.append((part, at, n_docs, n_tokens, min(known("first_doc"), default=None), max(known("last_doc"), default=None), seal))
        at += n_tokens
    root = merkle([_leaf(*x) for x in listed])
    return [(*x, root) for x in listed]


def write_store(docs: DataFrame, path: str, file: str | None = None, end_id: int = END_ID, width: int = 2) -> None:
    """Encodes ``docs`` (doc_id, text), ends each document with ``end_id`` and writes a store to the empty folder ``path``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(file or vocab.path(TOKENIZER), end_id, width), ROWS)
    # Recipes ride along in the shuffle, so that texts are encoded once; each is a group by itself.
    nth = F.row_number().over(Window.partitionBy("kind", "digest", "spread").orderBy("digest"))
    once = rows.withColumn("nth", nth).where("kind = 'recipe' or nth = 1").drop("nth")
    with batch_rows(spark):
        once.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/packed")
    loose = spark.read.schema(ROWS).parquet(f"{path}/packed").where("kind = 'recipe'").select("doc_id", "n_tokens", "root", "digests", "lengths", "spread")
    ordered = loose.repartitionByRange("doc_id", "root", "spread").sortWithinPartitions("doc_id", "root", "spread").drop("spread")
    ordered.mapInArrow(_number, RECIPES).write.option("compression", "zstd").parquet(f"{path}/recipes")
    made = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    spark.createDataFrame(manifest_of(made), MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of the store at ``path``; raises ValueError unless the recipes there have the very Merkle roots, counts and places it names."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    known = lambda x: tuple(bytes(v) if isinstance(v, bytearray) else v for v in x)
    said = sorted(known(r) for r in manifest.collect())
    found = manifest_of(spark.read.schema(RECIPES).parquet(f"{path}/recipes"))
    for have, want in zip(found, said, strict=False):
        if have[:-1] != want[:-1]:
            raise ValueError(f"part {want[0]} of the store does not match the manifest")
    if len(found) != len(said):
        raise ValueError(f"the manifest lists {len(said)} parts, and {len(found)} are there")
    if {x[-1] for x in found} != {x[-1] for x in said}:
        raise ValueError("the manifest's root is not that of its parts")
    return manifest


_POLY = 0xEDB88320


@lru_cache(1)
def _shifts() -> list[np.ndarray]:
    """For each k, 4 tables of 256 that append 2**k zero bytes to a crc32."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(_POLY), byte >> 1).astype(np.uint32)

    def apply(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
        return tables[0][c & 255] ^ tables[1][c >> 8 & 255] ^ tables[2][c >> 16 & 255] ^ tables[3][c >> 24]

    each = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    out = [np.stack([byte[x & 255] ^ (x >> np.uint32(8)) for x in each])]
    for _ in range(47):
        out.append(np.stack([apply(out[-1], x) for x in out[-1]]))
    return out


def crc_shift(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Each crc32 as if that many zero bytes followed: crc32(a + b) = crc_shift(crc32(a), len(b)) ^ crc32(b)."""
    crc, zeros, k = crc.astype(np.uint32), zeros.astype(np.int64), 0
    while zeros.any():
        odd = np.flatnonzero(zeros & 1)
        t, c = _shifts()[k], crc[odd]
        crc[odd] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
        zeros, k = zeros >> 1, k + 1
    return crc


def _check_chunks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, payloads = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name, payload in zip(names, payloads, strict=True):
                if hashlib.blake2b(payload, digest_size=16).digest() != name or len(payload) % width:
                    raise ValueError(f"chunk {name.hex()} does not match its digest")
            # The ids of a batch are widened at once.
            wide = memoryview(np.frombuffer(b"".join(payloads), f"<u{width}").astype("<u4").tobytes())
            sizes = np.fromiter(map(len, payloads), np.int64, len(payloads)) // width
            stops = (4 * np.cumsum(sizes)).tolist()
            crcs = [zlib.crc32(wide[a:b]) for a, b in zip([0, *stops], stops, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crcs, pa.int64()), pa.array(sizes.astype(np.int32))], ["digest", "crc", "n"])

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (part, local, digest, n, after) per chunk of each recipe, whose root is checked first; after: bytes of 4-byte ids that follow."""
    for batch in batches:
        part, local, n, root, digests, lengths = (batch.column(c) for c in ("part", "local", "n_tokens", "root", "digests", "lengths"))
        many, names = np.asarray(pc.fill_null(pc.list_value_length(lengths), 0), np.int64), digests.to_pylist()
        sizes = np.asarray(lengths.flatten(), np.int64)
        before = np.concatenate([[0], np.cumsum(sizes)])
        stops = np.cumsum(many)
        even = before[stops] - before[stops - many] == np.asarray(n, np.int64)
        for at, (k, own, leaf, right) in enumerate(zip(many.tolist(), names, root.to_pylist(), even.tolist(), strict=True)):
            if not right or len(own) != 16 * k or merkle([own[i : i + 16] for i in range(0, len(own), 16)]) != leaf:
                raise ValueError(f"recipe at {local[at].as_py()} of part {part[at].as_py()} does not match its root")
        offsets = pa.py_buffer(np.arange(0, 16 * len(sizes) + 1, 16, dtype=np.int32))
        digest = pa.Array.from_buffers(pa.binary(), len(sizes), [None, offsets, pa.py_buffer(b"".join(names))])
        after = 4 * (np.repeat(before[stops], many) - before[1:])
        cols = [np.repeat(np.asarray(part, np.int32), many), np.repeat(np.asarray(local, np.int64), many), digest, sizes.astype(np.int32), after]
        yield pa.RecordBatch.from_arrays([c if c is digest else pa.array(c) for c in cols], ["part", "local", "digest", "size", "after"])


def _shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = crc_shift(np.asarray(batch.column(2), np.int64), np.asarray(batch.column(3), np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crc.astype(np.int64)), batch.column(4)], ["part", "local", "crc", "n"])


def read_store(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32, root) from a store's files; raises on any mismatch with the manifest, digests, roots or lengths."""
    manifest = verify(spark, path)
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    chunks = spark.read.schema(ROWS).parquet(f"{path}/packed").where("kind = 'chunk'").select("digest", "payload").mapInArrow(_check_chunks(width), "digest binary, crc long, n int")
    uses = recipes.select("part", "local", "n_tokens", "root", "digests", "lengths").mapInArrow(_spread, "part int, local long, digest binary, size int, after long")
    found = uses.join(chunks, "digest", "left").withColumn("n", F.when(F.col("n") == F.col("size"), F.col("n")).otherwise(F.raise_error(F.lit("a chunk is missing or has another length"))))
    shifted = found.select("part", "local", "crc", "after", "n").mapInArrow(_shift, "part int, local long, crc long, n int")
    whole = shifted.groupBy("part", "local").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("n_tokens"))
    known = recipes.select("part", "local", "doc_id", "root").join(whole, ["part", "local"])
    # The manifest has one row per part; parts are bounded by the number of range partitions.
    return known.join(F.broadcast(manifest.select("part", F.col("start").alias("base"))), "part").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "root")


def tokens_of(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, at, n, ids): the stored ids themselves, a row per chunk; at orders a document's chunks."""
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes").join(F.broadcast(verify(spark, path).select("part", F.col("start").alias("base"))), "part")
    each = recipes.select("doc_id", (F.col("base") + F.col("local")).alias("start"), "digests", F.posexplode("lengths").alias("at", "n"))
    each = each.withColumn("digest", F.expr("substring(digests, 16 * at + 1, 16)")).drop("digests")
    chunks = spark.read.schema(ROWS).parquet(f"{path}/packed").where("kind = 'chunk'").select("digest", "payload")
    lost = F.raise_error(F.lit("a chunk is missing")).cast("binary")
    return each.join(chunks, "digest", "left").select("doc_id", "start", "at", "n", F.coalesce("payload", lost).alias("ids"))


def store_round_trip(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes a store (by default to the shared folder) and reads it back."""
    spark = docs.sparkSession
    path = path or Scratch(spark, "token-store").path("store")
    write_store(docs, path, **options)
    return read_store(spark, path, options.get("width", 2)).drop("root")
