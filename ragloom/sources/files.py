"""Files: Markdown folders, workbooks, and any table as a Markdown sheet."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROWS, HEADER_ROWS = 5000, 5
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def scan(spark: SparkSession, path: str, glob: str = "*.{md,markdown}", recursive: bool = True) -> DataFrame:
    """file_name (the path under the root), file_type, file_hash, file_size, modified, text; blank files are left out."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    text = F.decode("content", "UTF-8")
    cols = (F.col("path"), name.alias("base_name"), file_type(name).alias("file_type"), F.sha2("content", 256).alias("file_hash"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"), text.alias("text"))
    return df.select(*cols).where(F.trim("text") != "")


def file_type(name: Column) -> Column:
    """TYPE of TYPE__name.md, else General."""
    return F.when(F.contains(name, F.lit("__")), F.split(name, "__", 2)[0]).otherwise("General")


def plain_name(name: Column) -> Column:
    return F.when(F.contains(name, F.lit("__")), F.split(name, "__", 2)[1]).otherwise(name)


def cells_of(data: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, value) of an .xlsx workbook's cells that are not empty."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        read = lambda n: ElementTree.fromstring(z.read(n))
        shared = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in read("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
        target = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")}
        for sheet in read("xl/workbook.xml").iter(f"{_NS}sheet"):
            at = target[sheet.get(_REL)]
            at = at.lstrip("/") if at.startswith("/") else posixpath.join("xl", at)
            for c in read(at).iter(f"{_NS}c"):
                ref = c.get("r", "")
                letters = "".join(x for x in ref if x.isalpha())
                col = 0
                for x in letters:
                    col = col * 26 + ord(x.upper()) - 64
                v = c.find(f"{_NS}v")
                raw = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
                if c.get("t") == "s" and raw:
                    raw = shared[int(raw)]
                if raw:
                    yield sheet.get("name", ""), int("".join(x for x in ref if x.isdigit())) - 1, col - 1, raw


def sheet_markdown(cells: list[tuple[int, int, str]], file: str, sheet: str, max_rows: int = MAX_ROWS) -> str | None:
    """A sheet's cells (row, column, value) as a titled Markdown table; None without a header or data."""
    rows: dict[int, dict[int, str]] = {}
    for r, c, v in cells:
        v = " ".join((v or "").replace("\r", "\n").split("\n")).strip().replace("|", "\\|")
        if v:
            rows.setdefault(r, {})[c] = v
    first = min((r for r in rows if r < HEADER_ROWS), default=None)
    if first is None:
        return None
    data = [rows[r] for r in sorted(rows) if r > first][:max_rows]
    if not data:
        return None
    wide = max(rows[first]) + 1
    head = [rows[first].get(c, f"Column {c + 1}") for c in range(wide)]
    line = lambda xs: "| " + " | ".join(xs) + " |"
    out = [f"## {file} — {sheet}", "", f"{len(data)} rows x {wide} columns: {', '.join(head)}", "", line(head), line(["---"] * wide)]
    return "\n".join(out + [line([r.get(c, "") for c in range(wide)]) for r in data])


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """file_name, sheet_name, text of every sheet of the .xlsx files in a folder; lock files are skipped."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, data in zip(b["file_name"], b["content"], strict=True):
                by: dict[str, list] = {}
                for sheet, r, c, v in cells_of(data):
                    by.setdefault(sheet, []).append((r, c, v))
                out += [(name, s, t) for s, cells in by.items() if (t := sheet_markdown(cells, name, s))]
            yield pd.DataFrame(out, columns=["file_name", "sheet_name", "text"])

    return df.where(~F.col("file_name").startswith("~$")).mapInPandas(run, "file_name string, sheet_name string, text string")


def table_markdown(df: DataFrame, file: str, sheet: str, order: str) -> DataFrame:
    """One row, text: a small table as a Markdown sheet, at most MAX_ROWS rows of it."""
    cell = lambda c: F.replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n]+", " "), F.lit("|"), F.lit("\\|"))
    rows = df.orderBy(order).limit(MAX_ROWS).select(F.col(order).alias("_o"), F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |")).alias("line"))
    head = " | ".join(df.columns)
    rule = " | ".join(["---"] * len(df.columns))
    agg = rows.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.struct("_o", "line")))["line"], "\n").alias("body"))
    top = F.concat(F.lit(f"## {file} — {sheet}\n\n"), F.col("n").cast("string"), F.lit(f" rows x {len(df.columns)} columns: {', '.join(df.columns)}\n\n| {head} |\n| {rule} |\n"))
    return agg.select(F.concat(top, F.col("body")).alias("text"))
