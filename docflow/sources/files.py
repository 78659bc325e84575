"""Files as rows, and text out of office containers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.batches import small_batches
from ..functions.text import JSWS, decode_utf8

_RESULT = StructType([StructField("text", StringType()), StructField("error", StringType())])


def read_files(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Rows (doc_id, filename, bytes, content) of the files under ``path``. ``max_bytes`` filters on the file size before any is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    return files.select(F.col("path").alias("doc_id"), F.substring_index("path", "/", -1).alias("filename"), F.col("length").alias("bytes"), "content")


def oversized(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """Rows (doc_id, filename, bytes) of the files that are too large; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") > max_bytes).select(F.col("path").alias("doc_id"), F.substring_index("path", "/", -1).alias("filename"), F.col("length").alias("bytes"))


def split_pages(docs: DataFrame, key: str = "doc_id", text: str = "text", separator: str = "\n") -> DataFrame:
    """A page table (key, index, text) from texts with a page separator."""
    return docs.select(key, F.posexplode(F.split(F.col(text), separator)).alias("index", "text"))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def docx_text(content: bytes) -> str:
    """Paragraphs of a word document, each followed by a blank line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for paragraph in (e for e in root.iter() if _local(e.tag) == "p"):
        parts = []
        for e in paragraph.iter():
            name = _local(e.tag)
            parts.append((e.text or "") if name == "t" else "\t" if name == "tab" else "\n" if name in ("br", "cr") else "")
        out.append("".join(parts))
    return "\n\n".join(out) + ("\n\n" if out else "")


def _column_number(reference: str) -> int:
    n = 0
    for c in reference:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n - 1


# Number formats by their built-in id.
FORMATS = {1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0", 38: "#,##0", 39: "#,##0.00", 40: "#,##0.00", 45: "mm:ss", 46: "[h]:mm:ss", 48: "0.0E+0"}
MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
#: Pieces of a format: literals, elapsed hours, half of the day, runs of a date letter, a number's shape, anything else.
PIECES = re.compile(r'"([^"]*)"|\\(.)|(\[h+\])|(AM/PM|A/P)|([ymdhs]+)|([0#?][0#?,.]*(?:E\+0+)?)|(.)', re.I | re.S)


def general(x: float) -> str:
    """A number without a format: up to 11 digits."""
    return f"{x:.11g}".replace("e+", "E+").replace("e-", "E-")


def _moment(x: float, pieces: list[tuple]) -> str:
    """A day number as a date or time."""
    at = datetime(1899, 12, 31 if x < 60 else 30) + timedelta(seconds=round(x * 86400))
    half, out, before = any(p[3] for p in pieces), [], ""
    for k, (quoted, escaped, elapsed, ampm, letters, number, other) in enumerate(pieces):
        if letters:
            kind, n = letters[0].lower(), len(letters)
            later = next((p[4][0].lower() for p in pieces[k + 1 :] if p[4]), "")
            hour = (at.hour - 1) % 12 + 1 if half else at.hour
            if kind == "m" and (before == "h" or later == "s"):
                text = f"{at.minute:0{min(n, 2)}d}"
            elif kind == "m":
                text = f"{at.month:0{n}d}" if n < 3 else MONTHS[at.month - 1][:3] if n == 3 else MONTHS[at.month - 1]
            elif kind == "d":
                text = f"{at.day:0{n}d}" if n < 3 else DAYS[at.weekday()][:3] if n == 3 else DAYS[at.weekday()]
            else:
                text = {"y": str(at.year) if n > 2 else f"{at.year % 100:02d}", "h": f"{hour:0{min(n, 2)}d}", "s": f"{at.second:0{min(n, 2)}d}"}[kind]
            before = kind
        elif elapsed:
            text, before = str(int(round(x * 86400) // 3600)), "h"
        elif ampm:
            text = "PM" if at.hour >= 12 else "AM"
        else:
            text = quoted or escaped or number or other
        out.append(text)
    return "".join(out)


def formatted(x: float, code: str) -> str:
    """A number as a spreadsheet shows it. Colours, conditions and padding of the format are left out."""
    if not code or code.lower() in ("general", "@"):
        return general(x)
    sections = code.split(";")
    negative = x < 0 and len(sections) > 1 and sections[1] != ""
    code = re.sub(r"\[(?!h+\])[^\]]*\]|_.|\*.", "", sections[1] if negative else sections[0], flags=re.I)
    x = -x if negative else x
    pieces = PIECES.findall(code)
    if any(p[4] or p[2] for p in pieces):
        return _moment(x, pieces)
    if not any(p[5] for p in pieces):
        return "".join(p[0] or p[1] or p[6] for p in pieces) or general(x)
    value, out, done = x * 100 ** sum(p[6] == "%" for p in pieces), [], False
    for p in pieces:
        if p[5] and not done:
            shape, _, power = p[5].partition("E+")
            whole, _, part = shape.partition(".")
            least, most = part.count("0"), len(part)
            if power:
                digits, exponent = f"{value:.{most}E}".split("E")
                text = f"{digits}E{exponent[0]}{abs(int(exponent)):0{len(power)}d}"
            else:
                rounded = Decimal(repr(value)).quantize(Decimal(1).scaleb(-most), ROUND_HALF_UP)
                text = f"{rounded:{',' if ',' in whole.rstrip(',') else ''}f}"
                while most > least and text.endswith("0"):
                    text, most = text[:-1], most - 1
                text = text.rstrip(".") if not most else text
            out.append(text)
            done = True
        else:
            out.append(p[0] or p[1] or ("" if p[5] else p[6]))
    return "".join(out)


def _csv_cell(value: str) -> str:
    return '"' + value.replace('"', '""') + '"' if any(c in value for c in ',"\n\r') else value


def xlsx_text(content: bytes) -> str:
    """Every sheet as CSV without blank rows, numbers and dates as they are shown; with several sheets each under a line ``# name``."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(e.text or "" for e in item.iter() if _local(e.tag) == "t"))
        targets = {}
        if "xl/_rels/workbook.xml.rels" in names:
            targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        codes: list[str] = []
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {int(e.get("numFmtId", 0)): e.get("formatCode", "") for e in styles.iter() if _local(e.tag) == "numFmt"}
            used = next((e for e in styles.iter() if _local(e.tag) == "cellXfs"), [])
            codes = [(FORMATS | own).get(int(e.get("numFmtId", 0)), "") for e in used]
        sheets = []
        listed = [e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet"]
        for k, sheet in enumerate(listed):
            link = next((v for a, v in sheet.attrib.items() if _local(a) == "id"), None)
            target = targets.get(link, f"worksheets/sheet{k + 1}.xml").lstrip("/")
            path = target if target.startswith("xl/") else f"xl/{target}"
            lines = []
            # A row at a time: the elements of a whole sheet take many times its size.
            for row in (e for _, e in ElementTree.iterparse(z.open(path)) if _local(e.tag) == "row"):
                cells: dict[int, str] = {}
                for at, cell in enumerate(e for e in row if _local(e.tag) == "c"):
                    value = "".join(e.text or "" for e in cell.iter() if _local(e.tag) in ("v", "t"))
                    if cell.get("t") == "s" and value:
                        value = shared[int(value)]
                    elif cell.get("t") == "b":
                        value = "TRUE" if value == "1" else "FALSE"
                    elif cell.get("t") in (None, "n") and value:
                        style = int(cell.get("s") or 0)
                        value = formatted(float(value), codes[style] if style < len(codes) else "")
                    cells[_column_number(cell.get("r", "")) if cell.get("r") else at] = value
                if any(cells.values()):
                    lines.append(",".join(_csv_cell(cells.get(i, "")) for i in range(max(cells) + 1)))
                row.clear()
            sheets.append((sheet.get("name", ""), "\n".join(lines)))
    return "\n".join(f"# {name}\n{body}" if len(sheets) > 1 else body for name, body in sheets).strip()


def _container(read):
    @pandas_udf(_RESULT)
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for content in batch:
                try:
                    rows.append((read(bytes(content)), None))
                except Exception as e:  # any broken container is this document's warning, not the job's failure
                    rows.append((None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["text", "error"])

    def extracted(content: Column) -> Column:
        small_batches()
        return extract(content)

    return extracted


extract_docx = _container(docx_text)
extract_xlsx = _container(xlsx_text)


def csv_text(content: Column) -> Column:
    """A CSV file as text, without blank rows; line ends inside quoted cells belong to the cell."""
    rows = F.regexp_extract_all(decode_utf8(content), F.lit(r'(?:[^"\r\n]++|"[^"]*+(?:"|\z))++'), F.lit(0))
    return F.array_join(F.filter(rows, lambda r: F.regexp_replace(r, f"{JSWS}|,", "") != ""), "\n")
