"""Content kind from bytes, file name and MIME type, in that order of trust."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading bytes by kind, tested in this order.
IMAGE_MAGIC = ("89504E47", "FFD8FF", "47494638", "424D")
PDF_MAGIC, RIFF_MAGIC, OLE_MAGIC = "25504446", "52494646", "D0CF11E0A1B11AE1"
ZIP_MAGIC = ("504B0304", "504B0506", "504B0708")
# Extensions and MIME types.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "webp", "bmp", "tiff", "tif")
TEXT_EXTENSIONS = ("txt", "md", "markdown", "json", "xml", "html", "htm", "log")
LEGACY_EXTENSIONS = ("doc", "xls", "ppt")
WORD_MIMES = ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/msword")
SHEET_MIMES = ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.ms-excel")
# Warnings.
LEGACY_BYTES = "legacy_office_not_supported: legacy .doc/.xls/.ppt (OLE2) cannot be parsed; convert to .docx/.xlsx"
LEGACY_NAME = "legacy_office_not_supported: legacy .doc/.xls/.ppt cannot be parsed; convert to .docx/.xlsx"
AMBIGUOUS = "ooxml_kind_ambiguous: ZIP/OOXML container could not be sub-typed; assuming docx"
UNKNOWN = "kind_unknown: could not determine document type"
SCAN_BYTES = 4096


def _bytes(text: str) -> Column:
    return F.expr(f"X'{text}'")


def starts_with(content: Column, magic: str) -> Column:
    return F.startswith(content, _bytes(magic))


def contains_ascii(content: Column, needle: str, limit: int = SCAN_BYTES) -> Column:
    return F.contains(F.substring(content, 1, limit), F.lit(needle).cast("binary"))


def extension(filename: Column) -> Column:
    """Lower-case text after the last dot; null without one."""
    return F.when(F.instr(filename, ".") > 0, F.lower(F.substring_index(filename, ".", -1)))


def mime_kind(mime: Column) -> Column:
    return (
        F.when(mime == "application/pdf", "pdf").when(mime.startswith("image/"), "image").when(mime.isin(*WORD_MIMES), "docx").when(mime.isin(*SHEET_MIMES), "xlsx").when(mime == "text/csv", "csv").when(mime.startswith("text/"), "text")
    )


def sniff(content: Column, filename: Column, mime: Column | None = None) -> Column:
    """struct<kind, warnings>. Magic needs four bytes; a RIFF that is no WebP goes on to the name."""
    mime = F.lit(None).cast("string") if mime is None else mime
    ext, enough = F.coalesce(extension(filename), F.lit("")), F.coalesce(F.octet_length(content) >= 4, F.lit(False))

    def found(kind: str, *warnings: str) -> Column:
        listed = ", ".join(f"'{w}'" for w in warnings)
        return F.expr(f"named_struct('kind', '{kind}', 'warnings', cast(array({listed}) AS array<string>))")

    def any_of(magics: tuple[str, ...]) -> Column:
        out = starts_with(content, magics[0])
        for m in magics[1:]:
            out = out | starts_with(content, m)
        return enough & out

    zipped = any_of(ZIP_MAGIC)
    out = F.when(any_of((PDF_MAGIC,)), found("pdf")).when(any_of(IMAGE_MAGIC), found("image"))
    out = out.when(any_of((RIFF_MAGIC,)) & (F.octet_length(content) >= 12) & contains_ascii(content, "WEBP", 12), found("image"))
    out = out.when(any_of((OLE_MAGIC,)), found("other", LEGACY_BYTES))
    out = out.when(zipped & contains_ascii(content, "word/document.xml"), found("docx")).when(zipped & contains_ascii(content, "xl/workbook.xml"), found("xlsx"))
    out = out.when(zipped & (ext == "xlsx"), found("xlsx")).when(zipped & (ext == "docx"), found("docx")).when(zipped, found("docx", AMBIGUOUS))
    for kind in ("pdf", "docx", "xlsx", "csv"):
        out = out.when(ext == kind, found(kind))
    out = out.when(ext.isin(*LEGACY_EXTENSIONS), found("other", LEGACY_NAME)).when(ext.isin(*IMAGE_EXTENSIONS), found("image")).when(ext.isin(*TEXT_EXTENSIONS), found("text"))
    by_mime = mime_kind(mime)
    return out.when(by_mime.isNotNull(), found("").withField("kind", by_mime)).otherwise(found("other", UNKNOWN))


def image_mime(content: Column, fallback: str = "image/png") -> Column:
    """jpeg, png or webp by magic, else ``fallback``."""
    webp = starts_with(content, RIFF_MAGIC) & (F.substring(content, 9, 4) == F.lit("WEBP").cast("binary"))
    return F.when(starts_with(content, "FFD8FF"), "image/jpeg").when(starts_with(content, "89504E47"), "image/png").when(webp, "image/webp").otherwise(fallback)
