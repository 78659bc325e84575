"""Token counts with a whole-token shortcut.

Offline, once on the driver: every vocabulary string that can be a pre-token is given to the BPE model, and
those that come back as one token are proved whole and broadcast (at most the vocabulary). Counting then takes each pre-token in that set as one token
and merges only the rest. White space never lies inside a token of this tokenizer, so texts are cut at
white space and the count of a distinct chunk is remembered (in bounded memory) and added up.
Strings of added tokens inside texts count as the library's default does.

One scan, nothing is shuffled. Defined results: a null text counts as empty, 0 bytes and 0 tokens;
repeated rows and null ids stay as they are; an empty table gives an empty table; other columns are
not read, whatever their names; a text of any length is counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .common import slices

TOKENIZER, LIMIT = "word_bpe_49k.json", 2048
END = "</w>"


@lru_cache(4)
def whole_tokens(file: str) -> frozenset[str]:
    """The spelled pre-tokens that the model of ``file`` encodes as one token, each one proved by encoding it."""
    tokenizer = vocab.load(file)
    model = tokenizer.model
    found = (v.removesuffix(END) for v in tokenizer.get_vocab(with_added_tokens=False) if v.endswith(END) and v != END)
    return frozenset(p for p in found if len(model.tokenize(p)) == 1)


class ChunkCounts(vocab.Remembered):
    def __init__(self, file: str, whole: frozenset[str]):
        super().__init__()
        self.tokenizer, self.whole = vocab.load(file), whole
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def pieces(self, pieces: list[str]) -> int:
        merge = self.tokenizer.model.tokenize
        return sum(1 if p in self.whole else len(merge(p)) for p in pieces)

    def compute(self, chunk: bytes) -> int:
        text = chunk.decode()
        if plain := vocab.PLAIN.fullmatch(text):
            return self.pieces([vocab.spelled(p.lower()) for p in plain.groups() if p])
        if any(a in text for a in self.added):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        text = self.tokenizer.normalizer.normalize_str(text)
        return self.pieces([p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)])


@lru_cache(4)
def _counts(file: str, whole) -> ChunkCounts:
    return ChunkCounts(file, whole.value)


def _count(file: str, whole, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker process has one object for a broadcast value, so what it remembers lasts from task to task.
        count = _counts(file, whole).__getitem__
        for part, texts in slices(batches):
            sizes = [len(t or b"") for t in texts]
            tokens = [sum(map(count, t.split())) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, file: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    file = file or vocab.path(TOKENIZER)
    return rows.mapInArrow(_count(file, docs.sparkSession.sparkContext.broadcast(whole_tokens(file)), limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
