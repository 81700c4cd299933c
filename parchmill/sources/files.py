"""Files to pages: checks, decoding, text, word-processor and PDF documents, OCR words.

Files come from any table with path, length and content (such as Spark's binaryFile source).
Rows that cannot be read go to a reject table with a reason instead of raising.

Defined results: suffixes count in any case; a null path or a missing file is rejected; null
content of a readable suffix gives one page without text; repeated rows stay repeated.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import is_blank
from ..functions.text import size_mb
from ..plans.config import PROFILES, Config

PAGE = "page_number:int,text:string,is_ocr:boolean,confidence:double"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of a folder, all levels."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def file_checks(files: DataFrame, cfg: Config = PROFILES["module"]) -> DataFrame:
    """Add suffix, size_mb and reject_reason (null for files that can be read)."""
    s = suffix(F.col("path"))
    why = F.when(F.col("path").isNull() | (F.col("path") == ""), "missing path").when(F.col("path").endswith("/"), "not a file").when(~s.isin(*cfg.extensions), F.concat(F.lit("unsupported suffix: "), s))
    return files.withColumns({"suffix": s, "size_mb": size_mb(F.col("length")), "reject_reason": why})


def decode(content: Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-1, which takes any; a byte-order mark
    stays; carriage returns become line feeds."""
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "\r\n?", "\n")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _own_text(node) -> str:
    out = []
    for x in node.iter():
        if x.tag == _W + "t":
            out.append(x.text or "")
        elif x.tag == _W + "tab":
            out.append("\t")
        elif x.tag in (_W + "br", _W + "cr"):
            out.append("\n")
    return "".join(out)


def docx_text(content: bytes) -> str:
    """Paragraphs that are not blank, then the rows of all tables, cells with ' | ' between."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(_W + "body")
    lines = [t for p in body.findall(_W + "p") if (t := _own_text(p)).strip()]
    for row in (r for table in body.findall(_W + "tbl") for r in table.findall(_W + "tr")):
        cells = ["\n".join(_own_text(p) for p in c.findall(_W + "p")).strip() for c in row.findall(_W + "tc")]
        if any(cells):
            lines.append(" | ".join(c for c in cells if c))
    return "\n".join(lines)


def pdf_pages(content: bytes, cfg: Config, ocr: Callable[[object], tuple[str, float]] | None = None) -> list[dict]:
    """One row per page. Needs pdfplumber; only pages with too little text go to OCR."""
    try:
        import pdfplumber
    except ImportError as e:
        raise ImportError("PDF files need pdfplumber: pip install pdfplumber") from e
    out = []
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for n, page in enumerate(pdf.pages, 1):
            text = page.extract_text(x_tolerance=3, y_tolerance=3) or ""
            scanned = sum(c.isprintable() and not c.isspace() for c in text) < cfg.min_page_chars
            conf = None
            if scanned:
                text, conf = ocr(page) if ocr else ("", None)
            out.append({"page_number": n, "text": text, "is_ocr": scanned, "confidence": conf})
    return out


def extract(files: DataFrame, key: str = "doc_id", cfg: Config = PROFILES["module"], ocr: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, rejects). Text files stay in the JVM; other formats run as Arrow functions.
    A file that fails is one page without text, with the error in ``error``."""
    checked = file_checks(files, cfg)
    good, rejects = checked.where("reject_reason is null"), checked.where("reject_reason is not null").select(key, "path", "reject_reason")
    txt = good.where("suffix = '.txt'").select(key, F.lit(1).alias("page_number"), decode(F.col("content")).alias("text"), F.lit(False).alias("is_ocr"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("error"))

    @F.pandas_udf(f"struct<pages:array<struct<{PAGE}>>,error:string>")
    def rich(kind: pd.Series, content: pd.Series) -> pd.DataFrame:
        out = []
        for k, c in zip(kind, content):
            try:
                if c is None:
                    raise ValueError("no content")
                pages = [{"page_number": 1, "text": docx_text(bytes(c)), "is_ocr": False, "confidence": None}] if k == ".docx" else pdf_pages(bytes(c), cfg, ocr)
                out.append((pages, None))
            except Exception as e:  # a broken file must not end the job
                out.append(([{"page_number": 1, "text": "", "is_ocr": k == ".pdf", "confidence": None}], f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["pages", "error"])

    other = good.where("suffix <> '.txt'").withColumn("_r", rich("suffix", "content"))
    other = other.select(key, F.explode("_r.pages").alias("p"), F.col("_r.error").alias("error")).select(key, "p.*", "error")
    return txt.unionByName(other), rejects


def printable_count(text: Column) -> Column:
    """Characters that are neither control, format, separator nor white space."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\p{C}\p{Z}\s]", ""))


def is_scanned(text: Column, cfg: Config = PROFILES["module"]) -> Column:
    return printable_count(text) < cfg.min_page_chars


def words_to_page(words: DataFrame, *keys: str, order: str = "pos", word: str = "word", conf: str = "conf") -> DataFrame:
    """OCR words to a page: words with a confidence that are not blank, joined by blanks;
    the mean confidence also counts blank words; 0 without any."""
    rated = F.col(conf) >= 0
    shown = F.when(rated & ~is_blank(F.col(word)), F.struct(order, word))
    return words.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x[word]), " ").alias("text"),
        F.coalesce(F.avg(F.when(rated, F.col(conf).cast("double"))), F.lit(0.0)).alias("confidence"),
    )


def lines_to_page(lines: DataFrame, *keys: str, order: str = "pos", text: str = "text", conf: str = "conf") -> DataFrame:
    """OCR lines to a page, confidences from 0 to 1, a missing one counting as 1; in percent."""
    return lines.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n").alias("text"),
        F.coalesce(F.avg(F.coalesce(F.col(conf).cast("double"), F.lit(1.0)) * 100), F.lit(0.0)).alias("confidence"),
    )


def documents(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, raw_text, total_pages, used_ocr): pages that are not blank joined by blank lines
    in page order; all pages count."""
    shown = F.when(F.col("text").isNotNull() & ~is_blank(F.col("text")), F.struct("page_number", "text"))
    return pages.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["text"]), "\n\n").alias("raw_text"),
        F.count("*").alias("total_pages"),
        F.coalesce(F.bool_or("is_ocr"), F.lit(False)).alias("used_ocr"),
    )


def ocr_language(pages: DataFrame, detect: Callable[[Column], Column], key: str = "doc_id") -> DataFrame:
    """(key, ocr_lang): the language of the first of pages 1 to 3 with more than 20
    characters; 'ta' where there is none."""
    first = pages.where((F.col("page_number") <= 3) & (F.length(F.trim("text")) > 20)).groupBy(key).agg(F.min_by("text", "page_number").alias("_t"))
    return pages.select(key).distinct().join(first, key, "left").select(key, F.when(F.col("_t").isNull(), "ta").otherwise(detect(F.col("_t"))).alias("ocr_lang"))


def split_empty(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with text, rejects without)."""
    empty = F.col("raw_text").isNull() | is_blank(F.col("raw_text"))
    return docs.where(~empty), docs.where(empty).withColumn("reject_reason", F.lit("no text"))
