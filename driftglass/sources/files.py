"""Files as a source: binary imports with a size cap, text corpora, and extraction whose failures are values."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftglass.functions.text import decode_entities, html_title, html_text, is_html, sniff, upload_text, wreckage
from driftglass.session import beside

MOST_BYTES, TO_OPEN = 16 * 1024 * 1024, 64 << 10
#: RTF destinations whose text is not the document's.
RTF_SKIPPED = "fonttbl colortbl stylesheet info pict object header footer headerl headerr footerl footerr footnote annotation listtable listoverridetable rsidtbl themedata xmlnstbl".split()
RTF_BREAKS = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "column": "\n", "tab": " ", "cell": " ", "row": " ", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}
_RTF = re.compile(r"\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")


def imported(spark: SparkSession, path: str | list[str], most: int = MOST_BYTES) -> DataFrame:
    """(path, filename, length, content, format, error) of the files under path, or paths. Larger ones come without content, as errors. A folder is
    listed once, where a pattern would have each of its files listed by itself; a small file counts for TO_OPEN bytes when tasks are dealt
    files (Spark's own 4 MB put 32 files in a task). The listing goes with the frame: Spark would keep up to 250 MB of listings."""
    own = beside(spark, spark__sql__files__openCostInBytes=str(TO_OPEN), spark__sql__execution__arrow__maxRecordsPerBatch="256", spark__sql__hive__manageFilesourcePartitions="false")
    rows = own.read.format("binaryFile").load(path)
    fits = F.col("length") <= most
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "length", F.when(fits, F.col("content")).alias("content"), F.when(fits, sniff(F.col("content"))).alias("format"), F.when(~fits, "too-large").alias("error"))


def decoded(raw: bytes) -> str:
    """Text of bytes: UTF-16 by its mark, else UTF-8, with U+FFFD for what is none."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    return raw.decode("utf-8-sig", "replace")


def rtf_text(raw: bytes) -> str:
    out: list[str] = []
    stack: list[tuple[bool, int]] = []
    hidden, after, skip = False, 1, 0
    for m in _RTF.finditer(raw.decode("latin-1")):
        code, word, arg, sign, brace, text = m.groups()
        if brace == "{":
            stack.append((hidden, after))
        elif brace == "}":
            hidden, after = stack.pop() if stack else (False, 1)
        elif word:
            if word in RTF_SKIPPED:
                hidden = True
            elif word == "uc":
                after = int(arg or 1)
            elif word == "u" and arg:
                if not hidden:
                    out.append(chr(int(arg) % 65536))
                skip = after
            elif word in RTF_BREAKS and not hidden:
                out.append(RTF_BREAKS[word])
        elif sign == "*":
            hidden = True
        elif not hidden and (piece := bytes([int(code, 16)]).decode("cp1252", "ignore") if code else sign if sign and sign in "\\{}" else " " if sign == "~" else text or ""):
            taken = min(skip, len(piece))
            skip -= taken
            out.append(piece[taken:])
    return "".join(out).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")  # a character may have come as two units


def office_text(raw: bytes) -> tuple[str, str | None]:
    """(text, title) of a word-processor file: headings as `## `, paragraphs as lines; deleted text and notes go."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        body = next((n for n in ("word/document.xml", "content.xml") if n in names), None)
        if body is None:
            raise ValueError("no-document")
        xml = z.read(body).decode("utf-8", "replace")
        meta = next((z.read(n).decode("utf-8", "replace") for n in ("docProps/core.xml", "meta.xml") if n in names), "")
    gone = r"(?s)<(w:del|w:instrText|office:annotation|text:tracked-changes)\b.*?</\1>"
    xml = re.sub(gone, "", xml)
    lines = []
    for para in re.findall(r"(?s)<(?:w:p|text:p|text:h)\b[^>]*?(?<!/)>.*?</(?:w:p|text:p|text:h)>", xml):
        heading = para.startswith("<text:h") or re.search(r'<w:pStyle w:val="(?:Heading|Title)', para)
        para = re.sub(r"<(?:w:br|w:cr|text:line-break)\b[^>]*>", "\n", re.sub(r"<(?:w:tab|text:tab|text:s)\b[^>]*>", " ", para))
        text = re.sub(r"[^\S\n]+", " ", re.sub(r"<[^>]*>", "", para)).strip()
        if text:
            lines.append(f"## {text}" if heading else text)
    title = re.search(r"(?s)<dc:title[^>]*>(.*?)</dc:title>", meta)
    return "\n".join(lines), title[1].strip() or None if title else None


def read_text(raw: bytes, kind: str) -> tuple[str | None, str | None, str | None]:
    """(text, title, error) of a file's bytes; markup is still in the text of pages."""
    try:
        if kind == "text":
            return decoded(raw), None, None
        if kind == "rtf":
            return rtf_text(raw), None, None
        if kind == "zip":
            return *office_text(raw), None
    except (ValueError, zipfile.BadZipFile, KeyError):
        return None, None, "damaged"
    return None, None, "unsupported"


def extracted(files: DataFrame) -> DataFrame:
    """files (path, filename, content, format, error) plus title and text. What cannot be read has its error as a value:
    unsupported, damaged, binary or empty. Markup is taken off by column expressions; only bytes of other formats go to Python."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [read_text(raw, kind) if error is None else (None, None, error) for raw, kind, error in zip(batch.content, batch.format, batch.error, strict=True)]
            yield batch.drop(columns=["content", "error"]).assign(raw_text=[r[0] for r in rows], raw_title=[r[1] for r in rows], error=[r[2] for r in rows])

    schema = files.drop("content", "error").schema.add("raw_text", "string").add("raw_title", "string").add("error", "string")
    return cleaned(files.mapInPandas(read, schema))


def cleaned(rows: DataFrame) -> DataFrame:
    """rows (filename, format, raw_text, raw_title, error) with text and title in place of the raw ones."""
    page = (F.col("format") == "text") & is_html(F.col("raw_text"), F.col("filename"))
    text = F.when(page, html_text(F.col("raw_text"))).when(F.col("format") == "zip", decode_entities(F.col("raw_text"))).otherwise(upload_text(F.col("raw_text")))
    title = F.when(page, html_title(F.col("raw_text"))).otherwise(decode_entities(F.col("raw_title")))
    rows = rows.withColumns({"text": text, "title": title})
    rows = rows.withColumn("error", F.coalesce("error", F.when(wreckage(F.col("raw_text")), "binary").when(F.length("text") == 0, "empty")))
    return rows.withColumn("text", F.when(F.col("error").isNull(), F.col("text"))).drop("raw_text", "raw_title")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(filename, text) of the text files under path, whole; empty files have no row."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"), F.col("value").alias("text"))
