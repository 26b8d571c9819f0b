"""Page rows of PDF files; needs the optional package pypdf."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def extract_pages(data: bytes) -> list[str]:
    """Texts of a PDF's pages."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the package pypdf") from e
    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]


def pdf_pages(spark: SparkSession, folder: str, extract=extract_pages) -> DataFrame:
    """(source, page, total_pages, text, content_hash, error): non-blank pages, numbered from 1, of all PDFs below a folder.

    A file without any text, or that fails, gives one row with an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(folder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    pages = extract(content)
                except Exception as e:  # a bad file is a row, not a failed job
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
                    continue
                good = [(path, i, len(pages), t, None) for i, t in enumerate(pages, 1) if t.strip()]
                rows += good or [(path, None, len(pages), None, "empty_pdf_text")]
            yield pd.DataFrame(rows, columns=["source", "page", "total_pages", "text", "error"]).astype({"page": "Int32", "total_pages": "Int32"})

    made = files.select("path", "content").mapInPandas(run, "source string, page int, total_pages int, text string, error string")
    return made.select("source", "page", "total_pages", "text", F.sha2("text", 256).alias("content_hash"), "error")
