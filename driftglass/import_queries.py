"""Queries over files that the given tables are written to, in the formats that people bring; the same in SQL."""

from __future__ import annotations

import io
import zipfile
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from driftglass.queries import _entities, _html, query
from driftglass.session import beside, scratch, staged, table
from driftglass.sources import files, imports


class _Rtf(dict):
    """What RTF has for a character, by its code point; each is worked out once."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        units = c.encode("utf-16-be", "surrogatepass")
        plain = {"\n": "\\par ", "\\": "\\\\", "{": "\\{", "}": "\\}"}.get(c) or (c if " " <= c < "\x7f" or c == "\t" else None)
        self[code] = plain or "".join(f"\\u{int.from_bytes(units[i : i + 2], signed=True)}?" for i in range(0, len(units), 2))
        return self[code]


_RTF = _Rtf()


def as_rtf(text: str) -> bytes:
    """A text as RTF: line ends as paragraphs, characters beyond ASCII as numbers of their UTF-16 units."""
    return ("{\\rtf1\\ansi{\\fonttbl{\\f0 Times;}}" + text.translate(_RTF) + "}").encode("ascii")


def as_office(text: str, title: str) -> bytes:
    """A text as a word-processor file, a paragraph each line."""
    escaped = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escaped(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
        z.writestr("word/document.xml", f"<w:document><w:body>{body}</w:body></w:document>")
        z.writestr("docProps/core.xml", f"<cp:coreProperties><dc:title>{escaped(title)}</dc:title></cp:coreProperties>")
    return out.getvalue()


#: The four formats that documents are written in, one after the other.
ENDINGS = ("txt", "rtf", "docx", "utf16.txt")


@F.pandas_udf(BinaryType())
def _written(text: pd.Series, ending: pd.Series, title: pd.Series) -> pd.Series:
    made = {"txt": lambda t, _: t.encode(), "rtf": lambda t, _: as_rtf(t), "docx": as_office, "utf16.txt": lambda t, _: t.encode("utf-16")}
    return pd.Series([made[e](x, n) for x, e, n in zip(text, ending, title, strict=True)])


def _ending() -> Column:
    return F.array(*map(F.lit, ENDINGS))[F.pmod("doc_id", F.lit(len(ENDINGS))).cast("int")]


#: Rows that a Python worker holds at once while files are written: texts, files and their copies are in memory several times over.
FILES_AT_ONCE = "256"
#: Folders of files that Spark's reader is given at once: it has a record of each file in the driver's memory.
FOLDERS_AT_ONCE = 16


def _folder(spark: SparkSession, d: str) -> str:
    """A folder with all documents and pages as files, in folders of about imports.A_FOLDER."""
    folder, own = scratch(spark, "imports"), beside(spark, spark__sql__execution__arrow__maxRecordsPerBatch=FILES_AT_ONCE)
    docs, pages = table(own, d, "documents"), table(own, d, "pages")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _ending().alias("ending"), F.coalesce("source", F.lit("")).alias("source"))
    texts = texts.select(F.concat_ws(".", "doc_id", "ending").alias("filename"), _written("text", "ending", "source").alias("raw"))
    htmls = pages.select(F.concat(F.lit("page-"), "page_id", F.lit(".html")).alias("filename"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("raw"))
    for name, rows, files in (("documents", texts, docs.count()), ("pages", htmls, pages.count())):
        imports.exported(rows.withColumn("below", imports.below(F.col("filename"), files)), f"{folder}/{name}")
    return folder


_TRIMMED = r"regexp_replace(regexp_replace({0}, '^[\s\x{{FEFF}}\x{{A0}}]+', ''), '[\s\x{{FEFF}}\x{{A0}}]+$', '')"
_LINES = r"array_to_string(list_filter(list_transform(string_split({0}, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f\v]+', ' ', 'g'))), lambda x: x <> ''), chr(10))"
_TITLE = rf"nullif(trim(regexp_replace({_entities(r'''regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)''')}, '\s+', ' ', 'g')), '')"
_IMPORTED = rf"""docs AS (SELECT doc_id, {list(ENDINGS)}[doc_id % {len(ENDINGS)} + 1] AS ending, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
found AS (SELECT doc_id || '.' || ending AS filename, CASE ending WHEN 'rtf' THEN 'rtf' WHEN 'docx' THEN 'zip' ELSE 'text' END AS format, CASE WHEN ending = 'docx' THEN {_LINES.format("text")} ELSE {_TRIMMED.format("text")} END AS text,
    CASE WHEN ending = 'docx' THEN nullif(source, '') END AS title FROM docs
  UNION ALL SELECT 'page-' || page_id || '.html', 'text', {_html("coalesce(html, '')")}, {_TITLE} FROM pages)"""


@query(f"WITH {_IMPORTED} SELECT filename, format, nullif(text, '') AS text, title, CASE WHEN text = '' THEN 'empty' END AS error FROM found")
def imported_files(spark: SparkSession, d: str) -> DataFrame:
    """All documents and pages, read back from text, UTF-16, RTF, word-processor and HTML files."""
    return imports.read_imports(spark, _folder(spark, d)).select("filename", "format", "text", "title", "error")


@query(f"WITH {_IMPORTED} SELECT filename, length(coalesce(text, '')) AS chars, title FROM found WHERE filename NOT LIKE 'page-%'")
def extracted_files(spark: SparkSession, d: str) -> DataFrame:
    """The documents among the files, through Spark's own reader of binary files. It lists files on the driver, so folders are read a few
    at a time."""
    folders, parts = imports.folders_of(f"{_folder(spark, d)}/documents"), []
    for at in range(0, len(folders), FOLDERS_AT_ONCE):
        rows = files.extracted(files.imported(spark, folders[at : at + FOLDERS_AT_ONCE]))
        rows = rows.select("filename", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), "title")
        parts.append(rows if len(folders) <= FOLDERS_AT_ONCE else staged(rows, "extracted"))
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], "filename string, chars long, title string"))


@query(f"WITH {_IMPORTED} SELECT format, count(*) AS files, sum(len(text))::BIGINT AS chars, count(title) AS titles FROM found WHERE filename NOT LIKE '%.txt' GROUP BY 1")
def imported_formats(spark: SparkSession, d: str) -> DataFrame:
    """What files other than plain text hold, by format; the names are filtered where files are listed."""
    folder, name = _folder(spark, d), F.col("filename")
    rows = reduce(DataFrame.unionByName, [imports.read_imports(spark, folder, told=told) for told in (name.endswith(".rtf"), name.endswith(".docx"), name.startswith("page-"))])
    return rows.groupBy("format").agg(F.count(F.lit(1)).alias("files"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.count("title").alias("titles"))
