"""Files of a repository as tables. Sizes are filtered in the scan; ignored folders and extensions by the path."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions, folders that are left out, and the largest file.
EXTENSIONS, MOST_BYTES = (".py", ".java", ".js"), 100_000
IGNORED = (".git", "venv", "__pycache__", "node_modules", ".idea", ".vscode")
DOCUMENTS = (".pdf", ".docx", ".md", ".txt")


def scan(spark: SparkSession, root: str, extensions: Sequence[str] = EXTENSIONS, most_bytes: int | None = MOST_BYTES) -> DataFrame:
    """path (relative to the root, with slashes), length and content of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if most_bytes is not None:
        files = files.where(F.col("length") <= most_bytes)
    base = re.escape(root.rstrip("/").removeprefix("file:"))
    path = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), rf"^[a-z]*:?/*?{base}/", "")
    segments = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    kept = files.select(path.alias("path"), "length", "content").where(F.lower(F.regexp_extract("path", r"\.[^./]+$", 0)).isin([e.lower() for e in extensions]))
    return kept.where(~F.arrays_overlap(segments, F.array(*[F.lit(x) for x in IGNORED])))


def changed(files: DataFrame, names: DataFrame) -> DataFrame:
    """The scanned files that a list of changed paths names: the same size, folder and extension filters as a full scan has."""
    return files.join(names, "path", "left_semi")


def lenient_text(content: Column) -> Column:
    """UTF-8 with what isn't UTF-8 left out."""
    return F.replace(F.validate_utf8(F.make_valid_utf8(content.cast("string"))), F.lit("\ufffd"), F.lit(""))


def docx_text(data: bytes) -> str:
    """The paragraphs of a .docx file, a line each."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        tree = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in tree.iter(f"{w}p"))


_STREAM = re.compile(rb"<<(?:(?!endobj).){0,4000}?>>\s*stream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\bT[dDmJj*]\b|\bET\b|['\"]", re.S)
_ESCAPE = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)")
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _shown(stream: bytes) -> str:
    """The strings that a page's content stream shows, a line for each change of the text's place."""
    out: list[bytes] = []
    for m in _SHOWN.finditer(stream):
        t = m[0]
        if t[:1] == b"(":
            out.append(_ESCAPE.sub(lambda e: _NAMED.get(e[1], b"" if e[1][-1:] == b"\n" else bytes([int(e[1], 8) & 255]) if e[1].isdigit() else e[1]), t[1:-1]))
        elif t[:1] == b"<":
            digits = re.sub(rb"\s", b"", t[1:-1])
            out.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        elif t not in (b"Tj", b"TJ") and out and out[-1] != b"\n":
            out.append(b"\n")
    return b"".join(out).decode("latin-1").strip("\n")


def pdf_text(data: bytes) -> str:
    """The pages of a .pdf file, each with a line end. Without PyPDF2, the strings that its plain or deflated content streams show in a one-byte encoding; ValueError where there are none."""
    try:
        from PyPDF2 import PdfReader
    except ImportError:
        if not data.startswith(b"%PDF"):
            raise ValueError("not a PDF file") from None
        pages = []
        for m in _STREAM.finditer(data):
            stream = m[1]
            if b"FlateDecode" in m[0][: len(m[0]) - len(stream)]:
                try:
                    stream = zlib.decompressobj().decompress(stream)
                except zlib.error:
                    continue
            if b"BT" in stream and (shown := _shown(stream)):
                pages.append(shown + "\n")
        if not pages:
            raise ValueError("no text that can be read without a PDF library") from None
        return "".join(pages)
    return "".join((page.extract_text() or "") + "\n" for page in PdfReader(io.BytesIO(data)).pages)


def read_document(name: str, data: bytes) -> tuple[str, str | None]:
    """A document's text by its extension, empty for others, and the error of a file that can't be read."""
    extension = name.lower().rpartition(".")[2]
    try:
        if extension in ("md", "txt"):
            return data.decode("utf-8", "ignore"), None
        return (docx_text(data) if extension == "docx" else pdf_text(data) if extension == "pdf" else ""), None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError) as e:
        return "", str(e)[:500]


def document_text(name: str, data: bytes) -> str:
    """A document's text; empty for files that can't be read."""
    return read_document(name, data)[0]


def documents(spark: SparkSession, root: str, extensions: Sequence[str] = DOCUMENTS) -> DataFrame:
    """path, text and error (of those that can't be read, whose text is empty) of the documents below a folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            read = [read_document(p, bytes(c)) for p, c in zip(b["path"], b["content"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "text": [t for t, _ in read], "error": [e for _, e in read]}, dtype=object)

    return scan(spark, root, extensions, None).select("path", "content").mapInPandas(run, "path string, text string, error string")
