import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from docflow.llm import suffix_dedup as S


def brute(texts: list[str | None], length: int):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        rest = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


def made(seed: int) -> list[str | None]:
    r = random.Random(seed)
    words = ["ab", "the", "é", "of", "zz", "q"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = say(30)
    out = [say(r.randint(0, 60)) for _ in range(12)]
    out += [say(9) + passage + say(7), passage, passage[5:70] + say(20), "a" * 90, "ab" * 60, "", None, say(3) + "xyzxyzxyz" * 15]
    return out + [out[0], out[0], out[13]]


@pytest.mark.parametrize("length,gram,crowd,segment", [(20, 6, 1 << 13, 1 << 20), (33, 16, 1 << 13, 17), (64, 40, 1 << 13, 1 << 20), (20, 6, 1, 50), (70, 16, 2, 1 << 20)])
def test_equals_brute_force(spark, length, gram, crowd, segment):
    texts = made(length)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, h string").repartition(3)
    rows = S.remove_repeats(docs, length, gram, crowd=crowd, segment=segment, batch_bytes=500).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows] == brute(texts, length)


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "abcdefgh" * 4), (1, "abcdefgh" * 4), (None, "0123456789" * 3 + "x"), (None, None)], "doc_id long, text string")
    rows = sorted((r["n_bytes"], r["n_removed"]) for r in S.remove_repeats(docs, 30, 8).collect())
    assert rows == [(0, 0), (31, 0), (32, 32), (32, 32)]
    assert S.remove_repeats(docs.limit(0), 30, 8).count() == 0


def test_kept_bytes_are_returned(spark):
    docs = spark.createDataFrame([(1, "x" + "hello world " * 2), (2, "hello world " * 2 + "y"), (3, "z")], "doc_id long, text string")
    rows = {r["doc_id"]: bytes(r["kept"]) for r in S.remove_repeats(docs, 24, 8, texts_out=True).collect()}
    assert rows == {1: b"x", 2: b"y", 3: b"z"}


def test_suffix_order_is_sorted():
    r = np.random.default_rng(1)
    data = np.concatenate([r.integers(97, 99, 3000).astype(np.uint8), np.tile(np.frombuffer(b"abc", np.uint8), 200), np.zeros(16, np.uint8)])
    at, length = np.arange(0, 3400), 100
    order, label = S.suffix_classes(data, at, np.zeros(len(at), np.int64), length, shallow=2)
    strings = [data[at[k] : at[k] + length].tobytes() for k in order]
    assert strings == sorted(strings)
    assert all((a == b) == (x == y) for a, b, x, y in zip(strings, strings[1:], label, label[1:], strict=False))
