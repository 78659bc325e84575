"""PDFs through an injected opener: text layers and page images as page tables.

No PDF library is part of this engine. ``open_text`` and ``open_images`` are given the bytes of one document and
yield its pages in order; they run where the data is, a document at a time, and what they raise is a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.assemble import MAX_PAGES

TEXT_LAYER = "doc_id {key}, index int, text string, error string"
IMAGES = "doc_id {key}, index int, image binary, error string"


def _pages(read: Callable[[bytes], Iterable], kind: pa.DataType, value: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0)
            for row, content in enumerate(batch.column(1).to_pylist()):
                got, error = [], None
                try:
                    for page in read(content):
                        if most and len(got) >= most:
                            break
                        got.append(page)
                except Exception as e:  # a broken document is its own warning, not the job's failure
                    got, error = [], str(e) or type(e).__name__
                n = len(got) if error is None else 1
                index = pa.array(range(n), pa.int32()) if error is None else pa.array([None], pa.int32())
                yield pa.RecordBatch.from_arrays([names.take(pa.array([row] * n, pa.int64())), index, pa.array(got or [None] * n, kind), pa.array([error] * n, pa.string())], ["doc_id", "index", value, "error"])

    return run


def _key(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def text_layer(docs: DataFrame, open_text: Callable[[bytes], Iterable[str]]) -> DataFrame:
    """Rows (doc_id, index, text, error) of the PDFs in ``docs`` (doc_id, content). One that cannot be opened has one row, an error without an index."""
    pdfs = docs.where(F.startswith("content", F.expr("X'25504446'"))).select("doc_id", "content")
    return pdfs.mapInArrow(_pages(open_text, pa.string(), "text", 0), TEXT_LAYER.format(key=_key(docs)))


def page_images(docs: DataFrame, open_images: Callable[[bytes], Iterable[bytes]], max_pages: int = MAX_PAGES) -> DataFrame:
    """Rows (doc_id, index, image, error), of the first ``max_pages`` pages (all if 0); pages beyond are not rendered."""
    pdfs = docs.where(F.startswith("content", F.expr("X'25504446'"))).select("doc_id", "content")
    return pdfs.mapInArrow(_pages(open_images, pa.binary(), "image", max_pages), IMAGES.format(key=_key(docs)))


def opened(pages: DataFrame) -> DataFrame:
    """The page table without documents that could not be opened, as ``api.parse`` takes it."""
    return pages.where("error is null").drop("error")
