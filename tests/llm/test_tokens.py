import random
import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docflow.llm import token_counts as C
from docflow.llm import token_store as S
from docflow.llm import vocab

TEXTS = [
    "Hello world, it's a test.", "", None, " lead", "trail ", "a  b\n c\n\nd", "don't <|endoftext|>x <|startoftext|> y", "İstanbul ŉ ǅ ﬁ éx é z 12a3 ½²x__--!!  　ab\x85cd", "日本語 テスト ΣΑΣ ά", "word " * 900, "x" * 3000, "a\x1c b q  z", "Hello world, it's a test.",
]


def test_counts_equal_the_library(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int")
    tokenizer = vocab.load(vocab.path(C.TOKENIZER))
    rows = C.token_counts(docs, limit=100).orderBy("doc_id").collect()
    want = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]
    assert [r["n_tokens"] for r in rows] == want and [r["over_limit"] for r in rows] == [n > 100 for n in want]
    assert [r["n_bytes"] for r in rows] == [len((t or "").encode()) for t in TEXTS]
    assert C.token_counts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [S.BLOCK, 2])
def test_random_texts_encode_as_the_library_does(monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    r = random.Random(3)
    letters = ["a", " ", "\n", "\n\n", "B", "ab.", "r", "'s", "1", "\xa0", "é", "!", "  ", "\t", "<|endoftext|>", "—", "́", "​", " ", "ß"]
    pieces, tokenizer = S.PieceIds(vocab.path(S.TOKENIZER), 4), vocab.load(vocab.path(S.TOKENIZER))
    counts, other = C.ChunkCounts(vocab.path(C.TOKENIZER), C.whole_tokens(vocab.path(C.TOKENIZER))), vocab.load(vocab.path(C.TOKENIZER))
    for _ in range(1500):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 10)))
        assert np.frombuffer(pieces.text(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert sum(map(counts.__getitem__, text.encode().split())) == len(other.encode(text, add_special_tokens=False).ids)


def test_crc_of_parts():
    r = np.random.default_rng(0)
    for _ in range(50):
        a, b = r.bytes(int(r.integers(0, 200))), r.bytes(int(r.integers(0, 5000)))
        assert int(S.crc_shift(np.array([zlib.crc32(a)]), np.array([len(b)]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_round_trip(spark, tmp_path):
    tokenizer = vocab.load(vocab.path(S.TOKENIZER))
    rows = [(99 - i, t) for i, t in enumerate(TEXTS)] + [(5, TEXTS[9]), (5, TEXTS[9]), (None, "none")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    path = str(tmp_path / "store")
    S.write_store(docs, path)
    out = S.read_store(spark, path).orderBy("start").collect()
    at = 0
    ids = lambda t: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    for (doc, text), r in zip(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)), out, strict=True):
        want = ids(text)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    chunks = spark.read.schema(S.ROWS).parquet(f"{path}/packed").where("kind = 'chunk'")
    assert chunks.count() == chunks.select("digest").distinct().count()
    stored = S.tokens_of(spark, path).where("doc_id = 90").orderBy("at").collect()
    assert b"".join(bytes(r["ids"]) for r in stored) == ids(TEXTS[9]).astype("<u2").tobytes()
    assert S.store_round_trip(docs.limit(0), str(tmp_path / "none")).count() == 0


def test_a_store_that_was_changed_is_not_read(spark, tmp_path):
    path = str(tmp_path / "store")
    S.write_store(spark.createDataFrame([(i, f"some text {i}") for i in range(40)], "doc_id long, text string").repartition(3), path)
    assert S.read_store(spark, path).count() == 40

    def changed(name, made, said):
        """The store with one table replaced."""
        broken = tmp_path / uuid.uuid4().hex
        for part in ("packed", "recipes", "manifest"):
            table = spark.read.parquet(f"{path}/{part}")
            out = (made(table) if part == name else table).write
            (out.partitionBy("kind") if part == "packed" else out).parquet(str(broken / part))
        with pytest.raises(Exception, match=said):
            S.read_store(spark, str(broken)).collect()
        with pytest.raises(Exception, match="digest" if "digest" in said else said):
            S.tokens_of(spark, str(broken)).collect() if "digest" not in said else S.read_store(spark, str(broken)).collect()

    one = F.col("doc_id") == 7
    changed("packed", lambda t: t.withColumn("payload", F.when(F.col("kind") == "chunk", F.lit(b"\1\0"))), "does not match its digest")
    changed("packed", lambda t: t.where("kind = 'recipe' or hex(digest) > '4'"), "a chunk is missing")
    changed("recipes", lambda t: t.where("doc_id % 2 = 0"), "does not match the manifest")
    changed("recipes", lambda t: t.where(~one), "does not match the manifest")
    changed("recipes", lambda t: t.union(t.where(one)), "does not match the manifest")
    changed("recipes", lambda t: t.withColumn("n_tokens", F.col("n_tokens") + one.cast("long")), "does not match the manifest")
    changed("recipes", lambda t: t.withColumn("root", F.when(one, F.lit(b"0" * 16)).otherwise(F.col("root"))), "does not match the manifest")
    changed("recipes", lambda t: t.where("part > 0"), "does not match the manifest|parts")
    changed("manifest", lambda t: t.withColumn("n_docs", F.col("n_docs") + 1), "does not match the manifest")
    changed("manifest", lambda t: t.withColumn("seal", F.lit(b"0" * 16)), "does not match the manifest")
    changed("manifest", lambda t: t.withColumn("root", F.lit(b"0" * 16)), "root is not that of its parts")
    changed("manifest", lambda t: t.where("part < 0"), "lists 0 parts")


def test_blocks_of_recipes_make_one_tree(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "FAN", 4)
    path = str(tmp_path / "store")
    S.write_store(spark.createDataFrame([(i, f"text {i}") for i in range(90)], "doc_id long, text string"), path)
    assert sum(r["n_docs"] for r in S.verify(spark, path).collect()) == 90 and S.read_store(spark, path).count() == 90


def test_cuts_do_not_depend_on_blocks(monkeypatch):
    ids = np.random.default_rng(2).integers(0, 50000, 9000).astype("<u2")
    stops, whole = np.array([100, 5000, 9000]), []
    for block in (S.BLOCK, 700):
        monkeypatch.setattr(S, "BLOCK", block)
        whole.append(S.cut_points(ids, stops))
    assert whole[0] == whole[1] and [c[-1] for c in whole[0]] == stops.tolist()


def test_pieces_with_punctuation_are_remembered_like_words(monkeypatch):
    tokenizer = vocab.load(vocab.path(S.TOKENIZER))
    pieces = S.PieceIds(vocab.path(S.TOKENIZER), 4)
    text = "plain words, (in) été... été, \"quoted\" A.B. don't, ß! 12,\n (again) words, été..."
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(pieces.text(text.encode()), "<u4").tolist() == want
    assert all(p.encode() in pieces for p in ("words,", "été...", "été,", "A.B.", " plain"))
    # A text of known pieces is looked up and nothing else.
    monkeypatch.setattr(S.PieceIds, "__missing__", lambda self, piece: pytest.fail(f"{piece} is not remembered"))
    assert np.frombuffer(pieces.text(text.encode()), "<u4").tolist() == want


def test_chunks_are_checked_one_by_one():
    import hashlib

    import pyarrow as pa

    r = np.random.default_rng(4)
    for width in (2, 4):
        ids = [r.integers(0, 50000, n).astype(f"<u{width}") for n in (1, 0, 700, 64)]
        batch = lambda rows: pa.record_batch([pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in rows], pa.binary()), pa.array(rows, pa.binary())], ["digest", "payload"])
        rows = [x.tobytes() for x in ids]
        out, none = S._check_chunks(width)(iter([batch(rows), batch([])]))
        assert out.column(1).to_pylist() == [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
        assert out.column(2).to_pylist() == [1, 0, 700, 64] and none.num_rows == 0
        with pytest.raises(ValueError, match="does not match its digest"):
            list(S._check_chunks(width)(iter([batch([rows[0], rows[2][:-1]])])))


def test_recipes_are_checked_one_by_one():
    import pyarrow as pa

    r = np.random.default_rng(6)
    sizes = [[5], [64, 1024, 1], [70, 3]]
    names = [r.bytes(16 * len(x)) for x in sizes]
    roots = [S.merkle([x[i : i + 16] for i in range(0, len(x), 16)]) for x in names]
    kinds = {"part": pa.int32(), "local": pa.int64(), "n_tokens": pa.int64(), "root": pa.binary(), "digests": pa.binary(), "lengths": pa.list_(pa.int32())}

    def rows(**other):
        values = {"part": [3, 3, 4], "local": [0, 5, 9], "n_tokens": [sum(x) for x in sizes], "root": roots, "digests": names, "lengths": sizes} | other
        batch = pa.record_batch([pa.array(values[k], t) for k, t in kinds.items()], list(kinds))
        return [list(zip(*b.to_pydict().values(), strict=True)) for b in S._spread(iter([batch, batch.slice(0, 0), batch.slice(1)]))]

    want = [(p, at, x[16 * i : 16 * i + 16], y[i], 4 * sum(y[i + 1 :])) for p, at, x, y in zip([3, 3, 4], [0, 5, 9], names, sizes, strict=True) for i in range(len(y))]
    assert rows() == [want, [], want[1:]]
    for bad in ({"root": [roots[0], roots[2], roots[1]]}, {"lengths": [[5], [64, 1025], [70, 3]]}, {"lengths": [[5], [64, 1024, 1], [73]]}, {"n_tokens": [5, 1089, 74]}, {"digests": [names[0], names[1], names[2][:-1]]}):
        with pytest.raises(ValueError, match="recipe at . of part . does not match its root"):
            rows(**bad)
