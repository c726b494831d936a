"""Files to documents and chunks: text, Office formats, PDF where a reader is installed, question sets and snapshots."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import document_id, strip

# Suffixes that a directory scan takes.
SUFFIXES = ["pdf", "docx", "pptx", "xlsx", "txt", "md", "csv"]
CHUNK = "file_path string, chunk_order_index int, content string, section_path string, page_number int, modality string"
GOLDEN = "id string, query string, expected_answer string, ground_truth_contexts array<string>, tags array<string>"
Row = tuple[int, str, str | None, int | None, str]


def from_texts(texts: DataFrame, content: str = "content", path: str = "file_path") -> DataFrame:
    """Texts with their document id."""
    return texts.withColumn("doc_id", document_id(F.col(content), F.col(path)))


def scan(spark: SparkSession, folder: str, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """path, content (binary) of all files below a folder with an allowed suffix, whatever its case."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return rows.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(suffixes)).select("path", "length", "modificationTime", "content")


def text_files(files: DataFrame) -> DataFrame:
    """Plain-text files as documents; bytes that aren't UTF-8 become replacement characters."""
    plain = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin("txt", "md", "csv"))

    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda b: bytes(b).decode("utf-8", errors="replace"))

    text = F.pandas_udf(decode, "string")(F.col("content"))
    return from_texts(plain.select(F.col("path").alias("file_path"), text.alias("content")))


def markdown(rows: list[list[str]]) -> str:
    """A table's rows, the first as its head."""
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])]) if rows else ""


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text(node: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == "t")


def _tables(root: ElementTree.Element) -> Iterator[list[list[str]]]:
    for table in (x for x in root.iter() if _local(x.tag) == "tbl"):
        yield [[_text(c).strip() for c in row if _local(c.tag) == "tc"] for row in table if _local(row.tag) == "tr"]


def parse_docx(data: bytes) -> list[Row]:
    """Non-empty paragraphs at their place among all, then tables."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    body = next(x for x in root if _local(x.tag) == "body")
    out: list[Row] = [(i, t, None, None, "text") for i, p in enumerate(x for x in body if _local(x.tag) == "p") if (t := _text(p).strip())]
    for i, rows in enumerate(_tables(body)):
        out.append((len(out), markdown(rows), f"table-{i}", None, "table"))
    return out


def parse_pptx(data: bytes) -> list[Row]:
    """A chunk a slide: its paragraphs, and its tables, by line."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
    out: list[Row] = []
    for i, name in enumerate(names, 1):
        root = ElementTree.fromstring(z.read(name))
        cells = {id(p) for t in root.iter() if _local(t.tag) == "tbl" for p in t.iter()}
        lines = [t for p in root.iter() if _local(p.tag) == "p" and id(p) not in cells and (t := _text(p).strip())]
        lines += map(markdown, _tables(root))
        if lines:
            out.append((len(out), "\n".join(lines), f"slide-{i}", i, "text"))
    return out


def parse_xlsx(data: bytes) -> list[Row]:
    """A table a sheet; empty cells are empty strings."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = [_text(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    titles = [x.get("name") for x in book.iter() if _local(x.tag) == "sheet"]
    names = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
    out: list[Row] = []
    for title, name in zip(titles, names, strict=False):
        rows: list[list[str]] = []
        for row in (x for x in ElementTree.fromstring(z.read(name)).iter() if _local(x.tag) == "row"):
            cells: dict[int, str] = {}
            for c in row:
                letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
                at = len(cells)
                if letters:
                    at = 0
                    for ch in letters:
                        at = at * 26 + ord(ch) - 64
                    at -= 1
                value = next((v.text or "" for v in c if _local(v.tag) == "v"), _text(c))
                cells[at] = shared[int(value)] if c.get("t") == "s" and value else value
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        width = max(map(len, rows), default=0)
        if width:
            out.append((len(out), markdown([r + [""] * (width - len(r)) for r in rows]), title, None, "table"))
    return out


def parse_pdf(data: bytes) -> list[Row]:
    """A chunk a page with text. Needs pypdf; without it a file is one row of modality `error`."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        return [(0, f"{type(e).__name__}: {e}", None, None, "error")]
    pages = [(p.extract_text() or "").strip() for p in PdfReader(io.BytesIO(data)).pages]
    return [(i, t, None, i + 1, "text") for i, t in enumerate(pages) if t]


PARSERS: dict[str, Callable[[bytes], list[Row]]] = {"docx": parse_docx, "pptx": parse_pptx, "xlsx": parse_xlsx, "pdf": parse_pdf}


def office_files(files: DataFrame, parsers: dict[str, Callable[[bytes], list[Row]]] | None = None) -> DataFrame:
    """Chunks of files with a parser; a damaged file gives one row of modality `error` with the message."""
    by = PARSERS | (parsers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = by[path.rsplit(".", 1)[-1].lower()](bytes(data))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, StopIteration) as e:
                    rows = [(0, f"{type(e).__name__}: {e}", None, None, "error")]
                out += [(path, *r) for r in rows]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHUNK.split(", ")]).astype({"page_number": "Int32"})

    some = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(list(by)))
    return some.select("path", "content").mapInPandas(run, CHUNK)


def goldens(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON-lines set; lines that can't be read are left out."""
    return spark.read.schema(GOLDEN).json(path).where("query is not null")


def snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON store of one object by id, as rows with an id; nothing where it can't be read."""
    raw = spark.read.text(path, wholetext=True)
    held = F.coalesce(F.from_json("value", f"map<string,struct<{schema}>>"), F.create_map().cast(f"map<string,struct<{schema}>>"))
    return raw.select(F.explode(held).alias("id", "v")).select("id", "v.*")


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """metric, value of a stored report."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "aggregate_metrics map<string,double>").alias("r"))
    return raw.select(F.explode("r.aggregate_metrics").alias("metric", "value"))


def summary(content):
    """The first hundred characters, stripped."""
    return strip(F.substring(content, 1, 100))
