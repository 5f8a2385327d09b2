"""Text out of files: OOXML, PDF strings, plain formats, and normal forms of documents, JSON and CSV."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of one archive member at most.
MEMBER = 64 << 20
_PARTS = {"docx": r"word/document\.xml", "pptx": r"ppt/slides/slide\d+\.xml", "xlsx": r"xl/sharedStrings\.xml"}


def _member(archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> bytes:
    with archive.open(info) as f:
        data = f.read(MEMBER + 1)
    if len(data) > MEMBER:
        raise ValueError("an archive member is too large")
    return data


def ooxml(data: bytes, kind: str) -> str:
    """Character data of all elements with local name ``t``, one line per part."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for info in sorted(archive.infolist(), key=lambda i: i.filename):
            if not re.fullmatch(_PARTS[kind], info.filename):
                continue
            words = []
            try:
                for _, e in ElementTree.iterparse(io.BytesIO(_member(archive, info))):
                    if e.tag.rpartition("}")[2] == "t":
                        words.append("".join(e.itertext()))
            except ElementTree.ParseError:
                pass  # what was read before the fault is kept
            text = " ".join(words).strip()
            out += [text] if text else []
    return "\n".join(out).strip()


_HEX = re.compile(rb"<([^>]*)>")


def pdf(data: bytes) -> str:
    """Printable ASCII of literal and hexadecimal strings, each followed by a space."""
    out, i = [], 0
    while i < len(data):
        c = data[i : i + 1]
        if c == b"(":
            start, depth = i + 1, 1
            i += 1
            while i < len(data) and depth:
                if data[i : i + 1] == b"\\":
                    i += 1
                elif data[i : i + 1] in b"()":
                    depth += 1 if data[i : i + 1] == b"(" else -1
                i += 1
            text = "".join(chr(b) for b in data[start : i - 1] if 32 <= b < 127) if not depth else ""
            out += [text, " "] if text else []
        elif c == b"<" and data[i + 1 : i + 2] not in (b"<", b""):
            m = _HEX.match(data, i)
            body = m[1] if m else data[i + 1 :]
            k = 0
            while k < len(body):
                pair = body[k : k + 2]
                if re.fullmatch(rb"[0-9A-Fa-f]{2}", pair):
                    b = int(pair, 16)
                    out += [chr(b)] if 32 <= b < 127 else []
                    k += 2
                else:
                    k += 1
            out.append(" ")
            i += len(body) + 1
        else:
            i += 1
    return "".join(out).strip()


def by_name(name: str, data: bytes) -> str:
    """The text of a file by its extension."""
    kind = name.rpartition(".")[2].lower()
    if kind in _PARTS:
        return ooxml(data, kind)
    return pdf(data) if kind == "pdf" else data.decode("utf-8", "ignore")


def extracted(df: DataFrame, path: str = "path", content: str = "content", out: str = "text", error: str = "error") -> DataFrame:
    """Adds the text of each file, or why it cannot be read."""

    @F.pandas_udf("struct<text:string,error:string>")
    def run(names: pd.Series, bodies: pd.Series) -> pd.DataFrame:
        rows = []
        for n, b in zip(names, bodies, strict=True):
            try:
                rows.append((by_name(n or "", bytes(b)) if b is not None else None, None))
            except (ValueError, zipfile.BadZipFile, KeyError) as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["text", "error"])

    made = df.withColumn("_f", run.asNondeterministic()(path, content))
    return made.withColumns({out: F.col("_f.text"), error: F.col("_f.error")}).drop("_f")


@F.pandas_udf(T.StringType())
def document_xml(bodies: pd.Series) -> pd.Series:
    """The body part of word-processor files."""

    def one(b):
        with zipfile.ZipFile(io.BytesIO(bytes(b))) as archive:
            return _member(archive, archive.getinfo("word/document.xml")).decode("utf-8", "ignore")

    return bodies.map(one, na_action="ignore")


def clean_document(c: Column) -> Column:
    """Text of document XML without tags, field codes, page references and lines of noise."""
    text = F.regexp_replace(c, "<[^>]*>?|>", "")
    text = F.regexp_replace(text, r'\\[a-zA-Z](?:[\t\n\f\r ]+"[^"]*")?', "")
    text = F.regexp_replace(text, r"(?i)(PAGEREF|HYPERLINK|TOC|_Toc)[\t\n\f\r ]*[0-9A-Za-z_]*", "")
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[\t\f\r \x0b]+|[\t\f\r \x0b]+$", ""))
    noise = r"""^[\t\n\f\r 0-9\\/_\-.,;:|&*#@!()"']+$"""
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(noise)), "\n")


@F.pandas_udf(T.StringType())
def csv_records(texts: pd.Series) -> pd.Series:
    """CSV as records of ``header: value`` lines; cells beyond the header get a column number. Other texts stay."""

    def one(t):
        try:
            rows = [r for r in csv.reader(io.StringIO(t), strict=True) if r]
        except csv.Error:
            return t
        if len(rows) < 2 or any(len(r) != len(rows[0]) for r in rows):
            return t
        out = []
        for i, row in enumerate(rows[1:], 1):
            out.append(f"--- Record {i} ---")
            out += [f"{rows[0][j] if j < len(rows[0]) else f'Column_{j}'}: {cell}" for j, cell in enumerate(row)]
            out.append("")
        return "\n".join(out) + "\n"

    return texts.map(one, na_action="ignore")


def sniffed(content: Column, name: Column) -> Column:
    """A file's kind by its first bytes, then by its name."""
    end = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return F.when(F.substring(content, 1, 4) == F.lit(b"PK\x03\x04"), F.when(end.isin("docx", "pptx", "xlsx"), end).otherwise("zip")).when(F.substring(content, 1, 4) == F.lit(b"%PDF"), "pdf").when(end.isin("json", "csv", "txt", "md"), end).otherwise("text")
