"""Documents of several formats in a folder -> cleaned texts. A file that can't be read gives an empty text and its error, never a failure."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.cleaning import cleaned

SUPPORTED = ("pdf", "docx", "txt", "xml", "md")
LEAST_PDF = 100
#: Only files with these endings are opened at all.
_GLOB = "*.{" + ",".join(f for e in SUPPORTED for f in (e, e.upper())) + "}"
# Element name -> heading.
HEADINGS = {
    "applicant": "CONTACT", "summary": "PROFESSIONAL SUMMARY", "education": "EDUCATION", "technicalskills": "TECHNICAL SKILLS", "skills": "TECHNICAL SKILLS",
    "experience": "EXPERIENCE", "projects": "PROJECTS", "certifications": "CERTIFICATIONS", "achievements": "ACHIEVEMENTS", "activities": "ACTIVITIES",
}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def xml_text(data: bytes) -> str:
    """Lines in document order: elements right under the root that have children give a heading, bullets a dash, a category attribute a label.

    Text after a child is left out. What isn't well-formed loses its tags.
    """
    try:
        root = ET.fromstring(data)
    except ET.ParseError:
        return re.sub(r"<[^>]+>", " ", data.decode("utf-8", "replace"))
    out: list[str] = []
    todo = [(root, 0)]
    while todo:
        node, depth = todo.pop()
        tag = node.tag.rpartition("}")[2].lower()
        if depth == 1 and len(node):
            out.append("\n" + HEADINGS.get(tag, tag.upper()))
        if (node.text or "").strip():
            out.append(("- " if tag == "bullet" else "") + node.text.strip())
        if node.get("category"):
            out.append(f"{node.get('category')}:")
        todo += [(child, depth + 1) for child in reversed(node)]
    return "\n".join(out)


def docx_text(data: bytes) -> str:
    """Paragraphs of the body, then the tables: of each row the cells that aren't empty, each once, joined by ' | '."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    words = lambda node: "".join("\t" if t.tag == f"{_W}tab" else t.text or "" for t in node.iter() if t.tag in (f"{_W}t", f"{_W}tab"))
    out = [words(p) for p in body.findall(f"{_W}p")]
    for row in body.iter(f"{_W}tr"):
        cells = [" ".join(words(p) for p in c.findall(f"{_W}p")).strip() for c in row.findall(f"{_W}tc")]
        if any(cells):
            out.append(" | ".join(dict.fromkeys(c for c in cells if c)))
    return "\n".join(out)


def pdf_text(data: bytes) -> str:
    """Pages joined by line ends; recognised from images where almost no text is inside. Both need optional packages."""
    import fitz

    with fitz.open(stream=data, filetype="pdf") as doc:
        text = "\n".join(page.get_text() for page in doc)
        if len(text.strip()) >= LEAST_PDF:
            return text
        try:
            import pytesseract
            from PIL import Image

            images = (Image.open(io.BytesIO(page.get_pixmap(dpi=200).tobytes("png"))) for page in doc)
            return "\n".join(pytesseract.image_to_string(i) for i in images) or text
        except Exception:
            return text


_READERS = {"xml": xml_text, "docx": docx_text, "pdf": pdf_text}


def read_bytes(fmt: str, data: bytes) -> tuple[str, str | None]:
    """(text as extracted, error)."""
    try:
        if fmt not in SUPPORTED:
            return "", f"unsupported format {fmt}"
        return _READERS[fmt](data) if fmt in _READERS else data.decode("utf-8", "replace"), None
    except Exception as e:
        return "", f"{type(e).__name__}: {e}"


def _parsed(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [read_bytes(f, bytes(c)) for f, c in zip(b["fmt"], b["content"])]
            yield pd.DataFrame({"stem": b["stem"], "fmt": b["fmt"], "path": b["path"], "raw_text": [t for t, _ in done], "error": [e for _, e in done]})

    read = files.mapInPandas(run, "stem string, fmt string, path string, raw_text string, error string")
    return read.withColumn("raw_text", cleaned(F.col("raw_text")))


def _named(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("fmt"), "path", "content").where(F.col("fmt").isin(*SUPPORTED))


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, fmt, path, raw_text, error) of the supported files right in a folder."""
    return _parsed(_named(spark.read.format("binaryFile").option("pathGlobFilter", _GLOB).load(folder)))


def stream_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stream of new files."""
    return _parsed(_named(spark.readStream.format("binaryFile").option("pathGlobFilter", _GLOB).schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)))


def pick_description(files: DataFrame) -> DataFrame:
    """The one file to take as description: the first PDF or DOCX by path, else the first MD or TXT; an error where there is none."""
    order = F.struct(F.when(F.col("fmt").isin("pdf", "docx"), 0).otherwise(1), F.col("path"))
    cols = F.struct(*files.columns)
    found = files.where(F.col("fmt").isin("pdf", "docx", "md", "txt")).agg(F.min_by(cols, order).alias("f"))
    # An aggregate over no file at all has one row, too, so it is there that the want of one is noticed.
    return found.select(F.when(F.col("f").isNull(), F.raise_error(F.lit("no description among the files")).cast(found.schema["f"].dataType)).otherwise(F.col("f")).alias("f")).select("f.*")
