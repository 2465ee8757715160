"""Noise in converted documents and web pages: contents, running headers, repeated chrome, broken tables.

Line machines that carry state run over Arrow batches; the pure functions below
them need no Spark. What is only about counts stays relational.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Whole-line patterns.
_PAGE = re.compile(r"(page|p\.)\s*\d+\s*(of|/\s*\d+)?\s*", re.I | re.A)
_VERSION = re.compile(r".{0,10}(version|ver)\s*[:.]?\s*\d+\.\d+\s*", re.I | re.A)
_COPY = re.compile(r"(©|copyright|confidential|all rights reserved).*", re.I)
_ISSUED = re.compile(r"(date/month issued:|this document is confidential|express written permission).*", re.I)
_PAGE_OF = re.compile(r".*page \d+ of \d+.*|.*version:\s*\d+.*", re.I | re.A)
_CONTENTS = re.compile(r"\s*#{0,4}\s*(table of contents|contents|index)\s*", re.I)
_ENTRY = re.compile(r"\d+(\.\d+){1,3}\.?\s+[A-Za-z].*\s+\d+\s*", re.A)
_TITLE = re.compile(r"(?i:(chapter|section|part|annex|appendix)\s+\d+.*)|\d+(\.\d+)*\s+[A-Z].*", re.A)
_CHROME = re.compile(r"[A-Z][A-Za-z\s&\-]{4,60}")
_MONEY = re.compile(r"\b(BDT|DDT|Taka|USD|Tk\.|\d{1,3},\d{3})\b", re.A)
_CURRENCY = re.compile(r"\b(BDT|DDT|Tk\.)\b", re.A)
_GROUPED = re.compile(r"\d{1,3},\d{3}", re.A)
_CHROME_WORDS = ("human resource", "confidential", "all rights reserved", "page ")


def normalise(line: str) -> str:
    return re.sub(r"\s+", " ", line.strip().lower(), flags=re.A)


def is_toc_line(t: str) -> bool:
    if not t or len(t) > 220 or not re.fullmatch(r".*\d\s*", t, re.A):
        return False
    gapped = 20 < len(t) < 180 and re.search("[A-Za-z]", t) and re.fullmatch(r".*\s{2,}\d+\s*", t, re.A)
    return bool(re.fullmatch(r".*(\.{2,}|-{2,})\s*\d+\s*", t, re.A) or gapped)


def is_running_line(t: str) -> bool:
    """A page, version, copyright or issue line of its own."""
    if _PAGE.fullmatch(t) or _ISSUED.fullmatch(t) or _PAGE_OF.fullmatch(t):
        return True
    return bool((len(t) < 40 and _VERSION.fullmatch(t)) or (len(t) < 120 and _COPY.fullmatch(t)))


def looks_like_chrome(t: str, names: tuple[str, ...] = ()) -> bool:
    low = t.lower()
    if len(t) < 8:
        return False
    if any(w in low for w in (*_CHROME_WORDS, *names)) or re.search(r"version\s*[:.]?\s*\d", low, re.A) or re.search("date.*issued", low):
        return True
    return bool(_CHROME.fullmatch(t))


def strip(text: str, names: tuple[str, ...] = (), head: int = 120) -> tuple[str, int, int]:
    """(text, contents lines removed, header and footer lines removed). names: words of the owner's running headers."""
    lines = text.split("\n")
    often = Counter(n for n in map(normalise, lines) if 0 < len(n) <= 120)
    out: list[str] = []
    toc = chrome = prose = 0
    inside = False
    for i, line in enumerate(lines):
        t = line.strip()
        if t and is_running_line(t):
            chrome += 1
        elif _CONTENTS.fullmatch(line) and t:
            inside, prose = True, 0
            toc += 1
        elif inside and t and not t.startswith("#") and (is_toc_line(t) or (len(t) <= 120 and _TITLE.fullmatch(t))):
            toc += 1
        elif inside and t:
            # A heading, or five other lines, end the contents; what is no contents line stays.
            prose += 1
            inside = not (t.startswith("#") or prose >= 5)
            out.append(line)
        elif not inside and t and ((i < head and is_toc_line(t)) or (len(t) < 180 and _ENTRY.fullmatch(t))):
            toc += 1
        elif not inside and often[normalise(line)] >= 3 and looks_like_chrome(t, names):
            chrome += 1
        else:
            out.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)), toc, chrome


def _continues_row(t: str) -> bool:
    """Money, a number before other words, a pipe, a few characters, or two words of a short title."""
    short = len(t) <= 25 or (len(t) < 80 and bool(re.match(r"[A-Z][a-z]+\s+[A-Z]", t)))
    return bool(t) and (short or "|" in t or bool(_MONEY.search(t) or re.match(r"\d+\s+\S", t, re.A)))


def _is_data(t: str) -> bool:
    """What may follow a blank line within a table: grouped digits, a currency, a numbered title, or a few characters that are no sentence."""
    few = len(t) <= 20 and "." not in t and not t.endswith(":")
    return bool(t) and (few or bool(_GROUPED.search(t) or _CURRENCY.search(t) or re.match(r"\d+\s+[A-Z]", t, re.A)))


def repair_tables(text: str) -> str:
    """Within a pipe table, lines that look like parts of a row get pipes; a blank line stays inside only before more of it."""
    lines, out, inside = text.split("\n"), [], False
    for i, line in enumerate(lines):
        t = line.strip()
        if t.startswith("|") and t.endswith("|"):
            inside = True
        elif inside and (_continues_row(t) or _is_data(t)):
            line = f"| {t} |"
        elif inside:
            after = lines[i + 1].strip() if i + 1 < len(lines) else ""
            inside = not t and (after.startswith("|") or _is_data(after))
        out.append(line)
    return "\n".join(out)


def clean(text: str, names: tuple[str, ...] = ()) -> tuple[str, int, int]:
    text, toc, chrome = strip(text, names)
    return repair_tables(text).strip(), toc, chrome


def strip_noise(docs: DataFrame, names: tuple[str, ...] = (), doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text, toc_removed, chrome_removed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [clean(t, names) for t in b["text"].fillna("")]
            yield pd.DataFrame({doc_id: b[doc_id], "text": [g[0] for g in got], "toc_removed": [g[1] for g in got], "chrome_removed": [g[2] for g in got]})

    return docs.select(doc_id, "text").mapInPandas(run, f"{doc_id} long, text string, toc_removed long, chrome_removed long")


def line_counts(docs: DataFrame, least: int = 3, longest: int = 120, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, line, n: normalised lines that a document repeats."""
    rows = docs.select(doc_id, F.explode(T.lines(F.col("text"))).alias("line")).select(doc_id, T.squeeze(F.col("line")).alias("line"))
    return rows.where((F.col("line") != "") & (F.length("line") <= longest)).groupBy(doc_id, "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def page_boilerplate(pages: DataFrame, least: int = 12, page_id: str = "page_id") -> DataFrame:
    """line, pages: normalised lines on at least half of the pages, and two; none of a single page."""
    rows = pages.select(page_id, F.explode(T.lines(F.col("text"))).alias("line")).select(page_id, T.squeeze(F.col("line")).alias("line"))
    counts = rows.where(F.length("line") >= least).distinct().groupBy("line").agg(F.count("*").alias("pages"))
    n = pages.agg(F.countDistinct(page_id).alias("n"))
    both = counts.join(F.broadcast(n), F.lit(True))  # n is one row
    return both.where((F.col("n") >= 2) & (F.col("pages") >= F.greatest(F.lit(2), F.floor((F.col("n") + 1) / 2)))).select("line", "pages")


def page_clean(pages: DataFrame, boilerplate: DataFrame, page_id: str = "page_id", names: tuple[str, ...] = ()) -> DataFrame:
    """page_id, text: pages without the boilerplate lines, by an anti join on the normalised line and an ordered return; then without their own noise."""

    @F.pandas_udf("string")
    def stripped(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: strip(t, names)[0])

    rows = pages.select(page_id, F.posexplode(T.lines(F.col("text"))).alias("pos", "raw")).withColumn("line", T.squeeze(F.col("raw")))
    kept = rows.join(boilerplate.select("line"), "line", "left_anti")
    kept = kept.groupBy(page_id).agg(F.array_sort(F.collect_list(F.struct("pos", "raw"))).alias("rows"))
    text = F.regexp_replace(stripped(F.array_join(F.col("rows.raw"), "\n")), r"(?m)^[ \t]*\r?\n(?:[ \t]*\r?\n){2,}", "\n\n")
    return pages.select(page_id).join(kept.select(page_id, T.trim(text).alias("text")), page_id, "left").select(page_id, F.coalesce("text", F.lit("")).alias("text"))


def page_gate(cleaned: DataFrame, boilerplate: DataFrame | None = None, raw: str = "raw_text", text: str = "text", enough: int = 300, raw_enough: int = 200) -> DataFrame:
    """status ok, kept_raw or failed, and the text that goes on. Raw text is kept only where the run has boilerplate lines."""
    names = cleaned.columns
    if boilerplate is None:
        cleaned = cleaned.withColumn("any shared", F.lit(False))
    else:
        cleaned = cleaned.join(F.broadcast(boilerplate.agg((F.count("*") > 0).alias("any shared"))), F.lit(True))  # one row
    status = F.when(F.length(text) >= enough, "ok").when((F.length(raw) >= raw_enough) & F.col("any shared"), "kept_raw").otherwise("failed")
    return cleaned.withColumn("status", status).select(*names, "status").withColumn("text", F.when(F.col("status") == "kept_raw", F.col(raw)).when(F.col("status") == "ok", F.col(text)))
