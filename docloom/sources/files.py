"""Folder inventory and text extraction of files of many kinds."""

from __future__ import annotations

import io
import re
import shutil
import subprocess
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.textops import path_extension, readable_utf8, strip_all, strip_html, strip_rtf

# What counts as text, what is not listed, limits of an archive.
TEXT_EXTENSIONS = ("txt", "md", "csv", "log", "json", "xml", "yml", "yaml", "tsv")
SKIPPED_EXTENSIONS = ("js", "css", "map", "woff", "woff2")
SKIPPED_NAMES = (".gitkeep", "README.md")
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "tif", "tiff", "gif", "bmp")
MOST_MEMBERS, MOST_MEMBER_BYTES, MOST_ARCHIVE_BYTES = 200, 80 << 20, 400 << 20
_RECORD = "rel_path string, ext string, size_bytes long, text string, extraction_ok boolean, extraction_method string, extraction_error string"


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, length, modificationTime, content) of the files below ``root``.

    Hidden files, web assets, saved-page side folders and the root's own readme are left out. The filters stand
    before the content, so a query that doesn't use the content doesn't read it.
    """
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", "^.*?" + re.escape(base), "")
    parts = F.split(rel, "/")
    name = F.element_at(parts, -1)
    keep = ~F.exists(parts, lambda p: p.startswith(".") | p.endswith("_files")) & ~path_extension(rel).isin(*SKIPPED_EXTENSIONS) & ~rel.isin(*SKIPPED_NAMES)
    return files.where(keep).select(rel.alias("rel_path"), name.alias("name"), "length", "modificationTime", "content")


def safe_member(name: str) -> bool:
    """An archive member that may be unpacked: no way out of the folder, no system file."""
    parts = name.replace("\\", "/").split("/")
    return not (name.startswith(("/", "\\")) or ":" in parts[0] or ".." in parts or "__MACOSX" in parts or parts[-1].startswith("._") or parts[-1] in ("", ".DS_Store"))


def expand_archives(files: DataFrame) -> DataFrame:
    """(rel_path, content) of all files, members of zip archives in place of the archives.

    Members keep within the limits of number and size; unsafe ones are left out; a broken archive gives one row with
    its own content. Archives are opened in the tasks, nothing is written.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["rel_path"], pdf["content"]):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        left = MOST_ARCHIVE_BYTES
                        for info in [i for i in z.infolist() if not i.is_dir() and safe_member(i.filename)][:MOST_MEMBERS]:
                            if info.file_size <= min(MOST_MEMBER_BYTES, left):
                                rows.append((f"{path}/{info.filename}", z.read(info)))
                                left -= info.file_size
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError):
                    rows.append((path, content))
                yield pd.DataFrame(rows, columns=["rel_path", "content"])

    zipped = path_extension(F.col("rel_path")) == "zip"
    plain = files.where(~zipped).select("rel_path", "content")
    return plain.unionAll(files.where(zipped).select("rel_path", "content").mapInPandas(run, "rel_path string, content binary"))


def _texts(xml: bytes) -> list[str]:
    """Text and tail of every element whose name ends in t, in document order."""
    out = []
    for e in ElementTree.fromstring(xml).iter():
        if str(e.tag).endswith("t"):
            out += [x for x in (e.text, e.tail) if x and x.strip()]
    return out


def office_text(content: bytes, ext: str) -> str:
    """Text of a docx, pptx or xlsx file: paragraphs by line, slides (in order of name) by blank line, shared strings by line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        if ext == "docx":
            return "\n".join(_texts(z.read("word/document.xml")))
        if ext == "pptx":
            slides = sorted(n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n))
            return "\n\n".join("\n".join(_texts(z.read(n))) for n in slides)
        return "\n".join(_texts(z.read("xl/sharedStrings.xml"))) if "xl/sharedStrings.xml" in names else ""


#: Pages that are read by character recognition at most, and their scale (fixed values).
OCR_PAGES, OCR_SCALE = 12, 2.0
LEAST_TEXT = 30


def _by_pypdf(content: bytes) -> str:
    from pypdf import PdfReader

    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)


def _by_pdftotext(content: bytes) -> str:
    if not shutil.which("pdftotext"):
        raise ImportError("pdftotext is not installed")
    return subprocess.run(["pdftotext", "-layout", "-", "-"], input=content, capture_output=True, timeout=120, check=True).stdout.decode("utf-8", "replace")


def _by_pymupdf(content: bytes) -> str:
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        return "\n".join(page.get_text() for page in doc)


def _by_recognition(content: bytes) -> str:
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        parts = [image_text(page.get_pixmap(matrix=fitz.Matrix(OCR_SCALE, OCR_SCALE)).tobytes("png")) for page in list(doc)[:OCR_PAGES]]
        return "\n".join([*parts, *([f"[{len(doc) - OCR_PAGES} further pages not read]"] if len(doc) > OCR_PAGES else [])])


#: Readers of a PDF in the order they are tried: (method, function). Those that aren't installed are passed over.
PDF_READERS: list[tuple[str, Callable[[bytes], str]]] = [("pypdf", _by_pypdf), ("pdftotext", _by_pdftotext), ("pymupdf", _by_pymupdf), ("ocr", _by_recognition)]


def is_locked_pdf(content: bytes) -> bool:
    return b"/Encrypt" in content


def pdf_text(content: bytes) -> tuple[str, str]:
    """(text, method) of a PDF: the first reader that gives ``LEAST_TEXT`` characters, else the longest text of any.

    A locked file is an error and reaches no reader; so is one for which no reader is installed or all fail.
    """
    if is_locked_pdf(content):
        raise ValueError("PDF is locked")
    best, method, errors = "", "pdf", []
    for name, read in PDF_READERS:
        try:
            text = read(content)
        except ImportError:
            continue
        except Exception as e:  # noqa: BLE001 - the next reader may do better
            errors.append(f"{name}: {e}")
            continue
        if len(text.strip()) > len(best.strip()):
            best, method = text, name
        if len(best.strip()) >= LEAST_TEXT:
            break
    if not best.strip():
        raise ValueError("; ".join(errors) if errors else "no PDF reader installed or no text in it")
    return best, method


def image_text(content: bytes) -> str:
    """Text of an image by an installed recognizer; an error where there is none."""
    try:
        import pytesseract
        from PIL import Image
    except ImportError:
        raise ValueError("no reader for images") from None
    return pytesseract.image_to_string(Image.open(io.BytesIO(content)))


def _containers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, ext, content in zip(pdf["rel_path"], pdf["ext"], pdf["content"]):
            text, error, method = "", None, "image" if ext in IMAGE_EXTENSIONS else ext
            try:
                if ext == "pdf":
                    text, method = pdf_text(content)
                else:
                    text = image_text(content) if ext in IMAGE_EXTENSIONS else office_text(content, ext)
            except Exception as e:  # noqa: BLE001 - an error is a field of the record
                error = f"{type(e).__name__}: {e}"[:200]
            rows.append((path, ext, len(content), text, None, method, error))
        yield pd.DataFrame(rows, columns=["rel_path", "ext", "size_bytes", "text", "extraction_ok", "extraction_method", "extraction_error"])


def extract(files: DataFrame) -> DataFrame:
    """Extraction record of each (rel_path, content): never an exception, always a row.

    Text, pages and RTF are read in the JVM; containers and images go to Arrow batches; the rest are records
    with an error. A text of nothing but white space is an error of its own and keeps its method.
    """
    f = files.select("rel_path", path_extension(F.col("rel_path")).alias("ext"), "content")
    body = readable_utf8(F.col("content"))
    kind = (
        F.when(F.col("ext").isin(*TEXT_EXTENSIONS), "text")
        .when(F.col("ext").isin("html", "htm"), "html")
        .when(F.col("ext") == "rtf", "rtf")
        .when(F.is_valid_utf8(F.col("content").cast("string")) & ~F.col("content").cast("string").contains("\u0000"), "utf-8")
        .otherwise("unreadable")
    )
    containers = ("docx", "pptx", "xlsx", "pdf", *IMAGE_EXTENSIONS)
    native = f.where(~F.col("ext").isin(*containers)).withColumn("kind", kind)
    text: Column = F.when(F.col("kind").isin("text", "utf-8"), body).when(F.col("kind") == "html", strip_html(body)).when(F.col("kind") == "rtf", strip_rtf(body)).otherwise("")
    error = F.when(F.col("kind") == "unreadable", "unreadable file type")
    rows = native.select("rel_path", "ext", F.length("content").cast("long").alias("size_bytes"), text.alias("text"), F.lit(None).cast("boolean").alias("extraction_ok"), F.col("kind").alias("extraction_method"), error.alias("extraction_error"))
    both = rows.unionAll(f.where(F.col("ext").isin(*containers)).mapInPandas(_containers, _RECORD))
    blank = strip_all(F.col("text")) == ""
    message = F.coalesce("extraction_error", F.when(blank, "no text extracted"))
    return both.withColumn("extraction_error", message).withColumn("extraction_ok", message.isNull())
