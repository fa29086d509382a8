"""Document folders as chunk tables. Files are listed and read by Spark; each file is parsed by one task."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaysift.config import DEFAULT, EngineConfig
from quaysift.operators.chunking import pack_rows

EXTENSIONS = ("pdf", "csv", "xlsx", "docx", "txt")
CHUNKS = "text string, doc_name string, page int, chunk_id string, is_table boolean, ord int"
#: Cell texts that count as missing.
MISSING = frozenset(("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"))

#: Bytes of a PDF and its page limit -> (page tables, page text) of each page; none is built in.
PdfReader = Callable[[bytes, int], list[tuple[list[list[list[str | None]]], str]]]


def format_table(rows: list[list[str | None]]) -> str:
    """Rows of cells as lines; blank rows dropped."""
    cells = [[(c or "").strip() for c in row] for row in rows]
    return "\n".join(" | ".join(row) for row in cells if any(row))


def _rendered(rows: list[list[str]], n: int) -> list[str]:
    """Lines of a table's body; whole numbers of a column with gaps show as decimals, as in a float column."""
    columns = list(zip(*[(r + [""] * n)[:n] for r in rows])) if rows else []
    shown = []
    for column in columns:
        empty = [c in MISSING for c in column]
        filled = [c for c, e in zip(column, empty) if not e]
        whole = bool(filled) and all(re.fullmatch(r"[+-]?\d+", c) for c in filled)
        decimal = bool(filled) and not whole and all(re.fullmatch(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", c) for c in filled)
        if decimal or whole and any(empty):
            shown.append(["" if e else repr(float(c)) for c, e in zip(column, empty)])
        elif whole:
            shown.append([str(int(c)) for c in column])
        else:
            shown.append(["" if e else c for c, e in zip(column, empty)])
    return [" | ".join(row) for row in zip(*shown)]


def _chunks_of_table(header: list[str], body: list[list[str]], doc: str, stem: str, budget: int) -> list[tuple]:
    if not body:
        return [("(empty)", doc, 1, stem, True)]
    return [(text, doc, 1, cid, True) for cid, text in pack_rows(" | ".join(header), _rendered(body, len(header)), stem, budget)]


def parse_csv(data: bytes, name: str, config: EngineConfig = DEFAULT) -> list[tuple]:
    """Rows with too many fields are skipped, short ones padded; a header alone gives a placeholder."""
    rows = list(csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"))))
    rows = [r for r in rows if r]
    if not rows:
        raise ValueError(f"no columns in {name}")
    header = rows[0]
    return _chunks_of_table(header, [r for r in rows[1:] if len(r) <= len(header)], name, _stem(name), config.max_text_chars)


def parse_txt(data: bytes, name: str, config: EngineConfig = DEFAULT) -> list[tuple]:
    text = data.decode("utf-8", "ignore").strip()
    return [((text or "(empty)")[: config.max_text_chars], name, 1, _stem(name), False)]


_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_D = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def parse_xlsx(data: bytes, name: str, config: EngineConfig = DEFAULT) -> list[tuple]:
    """One table for each sheet, named file::sheet; the budget is shared by the sheets."""
    book = zipfile.ZipFile(io.BytesIO(data))
    read = lambda path: ElementTree.fromstring(book.read(path))
    shared = [("".join(t.text or "" for t in si.iter(f"{_S}t"))) for si in read("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in book.namelist() else []
    targets = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")}
    sheets = read("xl/workbook.xml").find(f"{_S}sheets")
    out: list[tuple] = []
    budget = config.max_text_chars // max(len(sheets), 1)
    for sheet in sheets:
        path = targets[sheet.get(f"{_R}id")].lstrip("/")
        table: list[list[str]] = []
        for row in read(path if path.startswith("xl/") else f"xl/{path}").iter(f"{_S}row"):
            cells: dict[int, str] = {}
            for k, c in enumerate(row.findall(f"{_S}c")):
                v, kind = c.find(f"{_S}v"), c.get("t")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                elif v is None or v.text is None:
                    continue
                else:
                    value = shared[int(v.text)] if kind == "s" else ("True" if v.text == "1" else "False") if kind == "b" else v.text
                cells[_column(c.get("r")) if c.get("r") else k] = value
            table.append([cells.get(k, "") for k in range(max(cells) + 1)] if cells else [])
        doc, stem = f"{name}::{sheet.get('name')}", f"{_stem(name)}_{sheet.get('name')}"
        if not table or not table[0]:
            out.append(("(empty)", doc, 1, stem, True))
        else:
            out += _chunks_of_table(table[0], [r for r in table[1:] if any(r)], doc, stem, budget)
    return out


def parse_docx(data: bytes, name: str, config: EngineConfig = DEFAULT) -> list[tuple]:
    """Tables first, then the paragraphs that aren't blank."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_D}body")
    text_of = lambda e: "".join(t.text or "" for t in e.iter(f"{_D}t"))
    out = []
    for k, table in enumerate(body.findall(f"{_D}tbl")):
        text = format_table([["\n".join(text_of(p) for p in cell.iter(f"{_D}p")) for cell in row.findall(f"{_D}tc")] for row in table.findall(f"{_D}tr")])
        if text:
            out.append((text[: config.max_text_chars], name, 1, f"{_stem(name)}_table{k}", True))
    text = "\n".join(t for p in body.findall(f"{_D}p") if (t := text_of(p)).strip())
    if text or not out:
        out.append(((text or "(no text)")[: config.max_text_chars], name, 1, _stem(name), False))
    return out


def parse_pdf(data: bytes, name: str, reader: PdfReader | None, config: EngineConfig = DEFAULT) -> list[tuple]:
    """Tables, then text, of each of the first pages, within the page's share of the budget."""
    if reader is None:
        raise ValueError(f"{name}: no PDF reader was given")
    share, out = config.max_text_chars // config.max_pages_per_pdf, []
    for n, (tables, text) in enumerate(reader(data, config.max_pages_per_pdf)[: config.max_pages_per_pdf], 1):
        for k, table in enumerate(tables):
            if shown := format_table(table):
                out.append((shown[:share], name, n, f"{_stem(name)}_p{n}_t{k}", True))
        if text and text.strip():
            out.append((text.strip()[:share], name, n, f"{_stem(name)}_p{n}", False))
    return out


def _stem(name: str) -> str:
    return name.rsplit(".", 1)[0]


def scan_folder(spark: SparkSession, folder: str, pdf_reader: PdfReader | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """Chunks of all documents of a folder in order: text, doc_name, page, chunk_id, is_table, pos.

    Extensions are taken as written, in the order of EXTENSIONS; templates are left out; an empty folder is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    extension = F.regexp_extract("path", r"\.([^.]+)$", 1)
    listed = files.select("path", "content", name.alias("name"), F.array_position(F.array(*map(F.lit, EXTENSIONS)), extension).cast("int").alias("group"))
    listed = listed.filter(~(F.lower("name").contains("memo_template") & (F.lower(extension) == "docx")))
    parsers = {1: None, 2: parse_csv, 3: parse_xlsx, 4: parse_docx, 5: parse_txt}

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, content, file_name, group in pdf.itertuples(index=False, name=None):
                found = parse_pdf(content, file_name, pdf_reader, config) if group == 1 else parsers[group](content, file_name, config)
                rows += [(*c, k, group, path) for k, c in enumerate(found)]
            yield pd.DataFrame(rows, columns=["text", "doc_name", "page", "chunk_id", "is_table", "ord", "grp", "path"])

    out = listed.mapInPandas(parse, CHUNKS + ", grp int, path string")
    if out.isEmpty():
        raise FileNotFoundError(f"no documents in {folder}")
    # places in the folder's order without a single-task window: numbers within files on top of the files' offsets
    sizes = out.groupBy("grp", "path").agg(F.count("*").alias("n")).orderBy("grp", "path").collect()
    offsets, total = [], 0
    for r in sizes:
        offsets.append((r.path, total))
        total += r.n
    at = spark.createDataFrame(offsets, "path string, offset bigint")
    return out.join(at, "path").select("text", "doc_name", "page", "chunk_id", "is_table", (F.col("offset") + F.col("ord")).alias("pos"))


def template_headers(paragraphs: DataFrame) -> list[str]:
    """Section titles of a template (ord, paragraph): short lines that are no placeholders; the default six where none is found.

    A template is one document; its titles come to the driver whole. The openings that are passed over are fixed values.
    """
    kept = paragraphs.filter(
        (F.trim("paragraph") != "") & (F.length(F.trim("paragraph")) < 80) & ~F.col("paragraph").contains("{{")
        & ~F.trim("paragraph").rlike(r"^(?:MEMORANDUM|Company:|Summary:|Appendix|Investment Memo:)") & ~F.lower(F.trim("paragraph")).startswith("appendix")
    )
    return [r.t for r in kept.select(F.trim("paragraph").alias("t")).orderBy("ord").collect()] or list(DEFAULT_SECTIONS)


#: Sections of a memo without a template.
DEFAULT_SECTIONS = (
    "Executive Summary", "Market & Industry Overview", "Business & Product Overview", "Key Financial Metrics", "Management & Organization", "Key Risks & Diligence Findings",
)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON fixture of one object."""
    return spark.read.option("multiLine", True).json(path)


def accepted_uploads(paths: DataFrame) -> DataFrame:
    """Paths whose extension, in any case, is one of the known ones."""
    return paths.filter(F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin(*EXTENSIONS))
