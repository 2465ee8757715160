"""Table-aware chunking: prose by sections and sentences with overlap, tables by row groups under a repeated header."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from . import noise

_ROW = re.compile(r"\|.*\|\s*")
_RULE = re.compile(r"\|[\s\-:|]+\|\s*")
_CUT = re.compile(r"(?=\n#{1,4}\s)|(?=\n\d{1,2}\.\d{1,2}(?:\.\d{1,3})?\.?\s+[A-Za-z])|(?=\n\n)", re.A)
_HEADING = re.compile(r"^#{1,4}\s+(.*)$", re.M)
_SUB = re.compile(r"(\d{1,2}\.\d{1,2}\.\d{1,3})\.?(\s+.*)?", re.A)
# Lines that contain what stands on every page of a document.
_BOILERPLATE = re.compile(r"express written permission of|all rights reserved|©\s*\d{4}|date/month issued:|this document is confidential|page \d+ of \d+|version:\s*\d+", re.I | re.A)
_NUMBERED = re.compile(r"^(\d{1,2}\.\d{1,2})\.?\s+([A-Za-z].*)$", re.M | re.A)


@dataclass(frozen=True)
class Sizes:
    chunk: int = 1000
    overlap: int = 200
    table: int = 1800


@dataclass
class Chunk:
    kind: str
    section: str
    text: str
    parent: str = ""
    row_group: int = -1


def blocks(text: str) -> list[tuple[bool, str]]:
    """Alternating (is a table, text)."""
    out: list[tuple[bool, list[str]]] = []
    for line in text.split("\n"):
        table = bool(_ROW.fullmatch(line)) or bool(out and out[-1][0] and _goes_on(line.strip()))
        if not out or out[-1][0] != table:
            out.append((table, []))
        out[-1][1].append(line)
    return [(t, "\n".join(ls)) for t, ls in out]


def _goes_on(t: str) -> bool:
    """A broken-off piece of a table row."""
    if not t or t.startswith("#") or re.match(r"\d+\.\d", t, re.A):
        return False
    money = re.search(r"\b(BDT|DDT|Taka|USD|\d{1,3},\d{3})\b", t, re.A)
    return bool(len(t) <= 30 or money or re.match(r"\d+\s", t, re.A) or "|" in t or (len(t) < 60 and re.match(r"[A-Z][a-z]+\s", t)))


def join_tables(parts: list[tuple[bool, str]], budget: int, gap: int = 300) -> list[tuple[bool, str]]:
    """Tables with nothing but a short gap between them become one, if it fits."""
    out: list[tuple[bool, str]] = []
    for table, text in parts:
        if table and out and out[-1][0] and len(out[-1][1]) + len(text) < budget:
            out[-1] = (True, f"{out[-1][1]}\n{text}")
        elif table and len(out) > 1 and out[-2][0] and len(out[-1][1]) < gap and "#" not in out[-1][1] and len(out[-2][1]) + len(out[-1][1]) + len(text) < budget:
            between = out.pop()[1].strip()
            out[-1] = (True, "\n".join(x for x in (out[-1][1], between, text) if x))
        else:
            out.append((table, text))
    return out


def split_row(row: str, budget: int) -> list[str]:
    """A row too long for any chunk, cut at spaces past half the budget."""
    out = []
    while len(row) > budget:
        at = row.rfind(" ", budget // 2, budget)
        at = at if at > 0 else budget
        out.append(row[:at])
        row = row[at:].lstrip()
    return [*out, row]


def strip_boilerplate(text: str) -> str:
    return "\n".join(x for x in text.split("\n") if not _BOILERPLATE.search(x))


def table_chunks(text: str, section: str, sizes: Sizes) -> list[Chunk]:
    text = strip_boilerplate(text)
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return []
    rule = next((i for i, x in enumerate(lines[:3]) if _RULE.fullmatch(x)), None)
    head = lines[: rule + 1] if rule is not None else lines[:1]
    rows = lines[len(head) :]
    parent = hashlib.sha256(text.encode()).hexdigest()[:16]
    if not rows:
        return [Chunk("table", section, text, parent, 0)]
    room = max(sizes.table - sum(len(x) + 1 for x in head), sizes.table // 4)
    rows = [p for r in rows for p in split_row(r, room)]
    out, held = [], []
    for r in rows:
        if held and sum(len(x) + 1 for x in held) + len(r) > room:
            out.append(held)
            last = held[-1]
            held = [last] if len(last) + len(r) + 2 <= room else []  # one row is shown twice
        held.append(r)
    out.append(held)
    return [Chunk("table", section, "\n".join([*head, *g]), parent, i) for i, g in enumerate(out)]


def fragments(text: str, size: int) -> list[str]:
    """Cut before headings and blank lines; what is too long at sentences, and at last anywhere."""
    out = []
    edges = [0, *sorted({m.start() for m in _CUT.finditer(text)} - {0}), len(text)]
    for part in (text[a:b] for a, b in zip(edges, edges[1:], strict=False)):
        if len(part) <= size:
            out.append(part)
            continue
        held = ""
        for s in re.split(r"(?<=[.!?])\s+|\n{2,}", part):
            if held and len(held) + len(s) + 1 > size:
                out.append(held)
                held = ""
            held = f"{held} {s}" if held else s
            while len(held) > 1.2 * size:
                out.append(held[:size])
                held = held[size:]
        out.append(held)
    return [p for p in out if p.strip()]


def tail(text: str, overlap: int) -> str:
    """The last sentence or line within the overlap, else its last words."""
    window = text[-2 * overlap :]
    ends = [window.rfind(d) + len(d) for d in (". ", "?\n", "!\n", "\n") if window.rfind(d) > len(window) - overlap - 50]
    best = window[max(ends) :].strip() if ends else ""
    if 20 < len(best) <= 1.5 * overlap:
        return best
    hard = text[-overlap:]
    at = hard.find(" ")
    return hard[at + 1 :] if 0 < at < 100 else hard


def heading(text: str) -> str:
    md, no = _HEADING.search(text), _NUMBERED.search(text)
    if md and (not no or md.start() <= no.start()):
        return md[1].strip()[:120]
    return f"{no[1]} {no[2]}".strip() if no and len(no[0]) <= 120 else ""


def numbered_sub(text: str) -> str:
    """The N.N.N number that the first line with text begins with."""
    first = next((x.strip() for x in text.split("\n") if x.strip()), "")
    m = _SUB.fullmatch(first)
    return m[1] if m else ""


def effective(section: str, sub: str) -> str:
    return f"{section} / {sub}" if section and sub else section or sub


def text_chunks(text: str, section: str, sizes: Sizes, sub: str = "") -> tuple[list[Chunk], str, str]:
    """Chunks of prose, and the section and sub-point it ends in. A new one never shares a chunk with the one before."""
    out: list[Chunk] = []
    held = ""
    fresh = False  # held has more than carried-over text

    def flush() -> None:
        body = held.strip()
        if body and fresh:
            at = effective(section, sub)
            label = f"[{at}]\n" if at and body.split("\n", 1)[0].strip() != f"[{at}]" else ""
            out.append(Chunk("text", at, label + body))

    for part in fragments(strip_boilerplate(text), sizes.chunk):
        new = heading(part)
        point = "" if new else numbered_sub(part)
        if (new and new != section) or (point and point != sub):
            flush()
            held, fresh = "", False
        elif new and sub:
            flush()  # the section's own heading again: its sub-point has ended
            held, fresh = "", False
        if new:
            section, sub = new, ""
        elif point:
            sub = point
        if held and len(held) + len(part) > sizes.chunk:
            flush()
            held, fresh = (tail(held, sizes.overlap) + "\n" if sizes.overlap else ""), False
        held, fresh = held + part, True
    flush()
    return out, section, sub


def split(text: str, sizes: Sizes = Sizes(), names: tuple[str, ...] = ()) -> list[Chunk]:
    out: list[Chunk] = []
    section = sub = ""
    for table, part in join_tables(blocks(noise.strip(text, names)[0]), sizes.table):
        if table:
            out += table_chunks(part, effective(section, sub), sizes)
        elif part.strip():
            got, section, sub = text_chunks(part, section, sizes, sub)
            out += got
    return out


def chunk_docs(docs: DataFrame, sizes: Sizes = Sizes(), names: tuple[str, ...] = (), doc_id: str = "doc_id") -> DataFrame:
    """doc_id, chunk_id, chunk_index, total_chunks, content_type, section_header, parent_table_id, row_group, text. Ids follow from content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b[doc_id], b["text"].fillna(""), strict=True):
                got = split(t, sizes, names)
                for n, c in enumerate(got):
                    cid = hashlib.sha256(f"{i}|{n}|{c.text}".encode()).hexdigest()
                    rows.append((i, cid, n, len(got), c.kind, c.section or None, c.parent or None, c.row_group if c.row_group >= 0 else None, c.text))
            yield pd.DataFrame(rows, columns=[doc_id, "chunk_id", "chunk_index", "total_chunks", "content_type", "section_header", "parent_table_id", "row_group", "text"]).astype({"row_group": "Int64"})

    schema = f"{doc_id} long, chunk_id string, chunk_index long, total_chunks long, content_type string, section_header string, parent_table_id string, row_group long, text string"
    return docs.select(doc_id, "text").mapInPandas(run, schema)
