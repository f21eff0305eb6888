"""Office documents to addressable parts, from their bytes: zipped XML read with the standard library.

A document that is broken, encrypted or of another kind gives an error code and
no parts.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PART_BYTES = 256 << 20
# fixed values: the part that tells an OOXML family, and its media type
FAMILIES = {
    "word/document.xml": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "ppt/presentation.xml": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xl/workbook.xml": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}
_REQUIRED = ("[Content_Types].xml", "_rels/.rels")
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _open(content: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(content))
    names = z.namelist()
    if any(names.count(n) != 1 for n in _REQUIRED) or sum(f in names for f in FAMILIES) != 1:
        raise ValueError("no single office family")
    if any(i.flag_bits & 1 for i in z.infolist()):
        raise ValueError("encrypted")
    return z


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    if z.getinfo(name).file_size > MAX_PART_BYTES:
        raise ValueError("too large")
    raw = z.read(name)
    if b"<!DOCTYPE" in raw[:4096] or b"<!ENTITY" in raw:
        raise ValueError("document types aren't read")
    return ElementTree.fromstring(raw)


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attribute(e: ElementTree.Element, name: str) -> str:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), "")


def _text(e: ElementTree.Element) -> str:
    out = []
    for x in e.iter():
        if _local(x) == "t":
            out.append(x.text or "")
        elif _local(x) in ("tab", "br"):
            out.append("\t" if _local(x) == "tab" else "\n")
    return "".join(out)


def _cell(text: str) -> str:
    return text.replace("\\", "\\\\").replace("|", "\\|").replace("\n", "<br>").strip()


def _table(rows: list[list[str]]) -> str:
    width = max(map(len, rows))
    lines = ["| " + " | ".join(_cell(c) for c in r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def word_parts(content: bytes) -> list[tuple[str, str, str]]:
    """Sections before headings of a text document."""
    body = next(e for e in _xml(_open(content), "word/document.xml") if _local(e) == "body")
    sections: list[list[str]] = [[]]
    for e in body:
        if _local(e) == "tbl":
            rows = [[_text(c) for c in r if _local(c) == "tc"] for r in e if _local(r) == "tr"]
            if rows:
                sections[-1].append(_table(rows))
        elif _local(e) == "p":
            style = next((_attribute(x, "val") for x in e.iter() if _local(x) == "pStyle"), "").lower().replace(" ", "")
            text = _text(e).strip()
            if style.startswith("heading") and style[7:] in "123456" and style[7:] and text:
                sections.append(["#" * int(style[7:]) + " " + text])
            elif text:
                sections[-1].append(text)
    return [("section", str(k), "\n\n".join(s)) for k, s in enumerate([s for s in sections if s], 1)]


def _targets(z: zipfile.ZipFile, relations: str, folder: str) -> dict[str, str]:
    return {r.attrib["Id"]: (r.attrib["Target"].lstrip("/") if r.attrib["Target"].startswith("/") else folder + r.attrib["Target"]) for r in _xml(z, relations)}


def slide_parts(content: bytes) -> list[tuple[str, str, str]]:
    """Slides in the order of the presentation."""
    z = _open(content)
    targets = _targets(z, "ppt/_rels/presentation.xml.rels", "ppt/")
    out = []
    for k, e in enumerate([x for x in _xml(z, "ppt/presentation.xml").iter() if _local(x) == "sldId"], 1):
        blocks = []
        root = _xml(z, targets[e.attrib[_RELATION]])
        inside = {p for t in root.iter() if _local(t) == "tbl" for p in t.iter()}
        for x in root.iter():
            if _local(x) == "tbl":
                rows = [[_text(c) for c in r if _local(c) == "tc"] for r in x if _local(r) == "tr"]
                if rows:
                    blocks.append(_table(rows))
            elif _local(x) == "p" and x not in inside and _text(x).strip():
                blocks.append(_text(x).strip())
        out.append(("slide", str(k), "\n\n".join(blocks)))
    return out


def sheet_parts(content: bytes) -> list[tuple[str, str, str]]:
    """Sheets as tables; formulas are kept as they were written."""
    z = _open(content)
    shared = [_text(e) for e in _xml(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
    targets = _targets(z, "xl/_rels/workbook.xml.rels", "xl/")
    out = []
    for k, e in enumerate([x for x in _xml(z, "xl/workbook.xml").iter() if _local(x) == "sheet"], 1):
        rows: list[list[str]] = []
        for r in [x for x in _xml(z, targets[e.attrib[_RELATION]]).iter() if _local(x) == "row"]:
            cells: list[str] = []
            for c in r:
                column = 0
                for letter in _attribute(c, "r").rstrip("0123456789"):
                    column = column * 26 + ord(letter) - 64
                cells += [""] * ((column or len(cells) + 1) - 1 - len(cells))
                formula = next((x.text for x in c if _local(x) == "f" and x.text), None)
                value = next((x.text or "" for x in c if _local(x) == "v"), _text(c))
                cells.append("=" + formula if formula else shared[int(value)] if c.attrib.get("t") == "s" and value else value)
            rows.append(cells)
        rows = [r for r in rows if any(r)]
        out.append(("sheet", str(k), f"## {e.attrib.get('name', '')}" + ("\n\n" + _table(rows) if rows else "")))
    return out


PARSERS = {"docx": word_parts, "pptx": slide_parts, "xlsx": sheet_parts}


def ooxml_media_type(content: Column) -> Column:
    """Media type of an OOXML package with exactly one family; null for anything else."""

    @F.pandas_udf("string")
    def sniff(batch: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            try:
                names = _open(bytes(b)).namelist() if b is not None else []
            except (ValueError, zipfile.BadZipFile, NotImplementedError):
                return None
            return next((m for f, m in FAMILIES.items() if f in names), None)

        return batch.map(one)

    return sniff(content)


def office_parts(files: DataFrame, key: str, content: str, kind: str) -> DataFrame:
    """doc, anchor_kind, anchor_value, content, code: a row a part; a failed document is one row with its code.

    :param kind: column with docx, pptx or xlsx.
    """
    own = dict(files.dtypes)[key]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, (raw, k) in enumerate(zip(batch.column("content").to_pylist(), batch.column("kind").to_pylist())):
                try:
                    parts = [(*p, None) for p in PARSERS[k](raw or b"")]
                    if not any(p[2].strip() for p in parts):
                        parts = [(None, None, None, "empty_extraction")]
                except (ValueError, KeyError, StopIteration, IndexError, NotImplementedError, zipfile.BadZipFile, ElementTree.ParseError, RuntimeError):
                    parts = [(None, None, None, "malformed_input")]
                out += parts
                rows += [i] * len(parts)
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(rows, pa.int64())), *[pa.array(c, pa.string()) for c in cols]], names=["doc", "anchor_kind", "anchor_value", "content", "code"])

    given = files.select(F.col(key).alias("doc"), F.col(content).alias("content"), F.col(kind).alias("kind"))
    return given.mapInArrow(parse, f"doc {own}, anchor_kind string, anchor_value string, content string, code string")


def rendered_bytes_valid(content: Column, media_type: Column) -> Column:
    """Whether the bytes of a rendered capture begin as its media type says."""
    head = F.hex(F.substring(content, 1, 8))
    text = F.lower(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"))
    return (
        F.when(media_type == "application/pdf", F.startswith(head, F.lit("25504446")))
        .when(media_type == "image/png", head == "89504E470D0A1A0A")
        .when(media_type == "image/jpeg", F.startswith(head, F.lit("FFD8FF")))
        .when(media_type.isin("text/html", "application/xhtml+xml"), F.contains(text, F.lit("<html")) | F.contains(text, F.lit("<!doctype html")) | F.contains(text, F.lit("<body")))
        .when(media_type.startswith("text/"), F.is_valid_utf8(content.cast("string")))
        .otherwise(F.lit(False))
    )
