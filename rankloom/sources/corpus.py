"""Corpora from directories and uploads: scan, fingerprint, text extraction, upload rules."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rankloom.functions import text as T

MIN_CHARS, MAX_CHARS = 500, 240_000
MAX_BYTES = 1024 * 1024
EXTENSIONS = ["pdf", "docx", "txt", "md"]


def _path(root: str) -> Column:
    """A file's path under root."""
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^(?:file:)?/+", "/"), root.rstrip("/") + "/"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """SRC-1: id, title (the path under root), category (its first folder, else root) and text of all .md and .txt files, blank ones left out."""
    full, prefix = _path(root)
    files = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select(full.alias("full"), F.col("value").alias("text"))
    title = F.regexp_replace("full", "^.*?" + prefix.replace("\\", "/").replace(".", "\\."), "")
    docs = files.withColumn("title", title).where(F.col("title").rlike("(?i)\\.(md|txt)$") & (T.trim_all(F.col("text")) != ""))
    category = F.when(F.contains("title", F.lit("/")), F.split("title", "/")[0]).otherwise("root")
    return docs.select(F.concat(F.lit("kb_"), F.left(F.sha1(F.col("title").cast("binary")), F.lit(12))).alias("id"), "title", category.alias("category"), "text")


def fingerprint(documents: DataFrame) -> DataFrame:
    """One row: the first 16 hexadecimal digits of a digest over titles and lengths, number of documents and of characters.

    The definition asks for one list of all titles and lengths; it holds no texts, and must fit a string of 2 GB (some 40 million titles).
    """
    entry = F.concat_ws(":", "title", F.length("text").cast("string"))
    joined = F.expr("listagg(entry, '|') within group (order by entry)")
    return documents.select(entry.alias("entry"), F.length("text").alias("chars")).agg(F.left(F.sha2(joined.cast("binary"), 256), F.lit(16)).alias("fingerprint"), F.count("*").alias("documents"), F.sum("chars").alias("chars"))


def categories(documents: DataFrame) -> DataFrame:
    """Documents by category."""
    return documents.groupBy("category").agg(F.count("*").alias("n"))


def gate(files: DataFrame) -> DataFrame:
    """SRC-6: files (name, bytes) with ``problem``: of a type that isn't taken, or too large; null if neither."""
    ext = F.lower(F.regexp_extract("name", "\\.([^.]+)$", 1))
    return files.withColumn("problem", F.when(~ext.isin(EXTENSIONS), "unsupported type").when(F.col("bytes") > MAX_BYTES, "too large"))


def _extract_one(name: str, content: bytes) -> tuple[str | None, str | None]:
    ext = name.rsplit(".", 1)[-1].lower()
    if ext in ("txt", "md"):
        return content.decode("utf-8", "replace"), None
    if ext not in ("pdf", "docx"):
        return None, "unsupported type"
    try:
        return (_docx(content) if ext == "docx" else _pdf(content)), None
    except ImportError:
        return None, f"no reader for .{ext} is installed"
    except Exception as e:  # a broken file is a row with a problem, not the end of the job
        return None, f"could not be read: {type(e).__name__}"


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _docx(content: bytes) -> str:
    """The paragraphs of a Word file, which is a zip of XML."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    marks = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n"}
    return "\n\n".join("".join(marks[e.tag](e) for e in p.iter() if e.tag in marks) for p in body.iter(f"{_W}p"))


def _pdf(content: bytes) -> str:
    import pypdf

    return "\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages)


def extract(files: DataFrame) -> DataFrame:
    """SRC-3: name, text and problem of files (name, content); text files as UTF-8, others by the readers that are installed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [_extract_one(n, c) for n, c in zip(pdf["name"], pdf["content"])]
            yield pd.DataFrame({"name": pdf["name"], "text": [t for t, _ in done], "problem": [p for _, p in done]})

    return files.select("name", "content").mapInPandas(run, "name string, text string, problem string")


def _upload_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from rankloom.operators.chunking import hash_id

    for pdf in batches:
        yield pdf.assign(id=["up_" + hash_id(f"{t}:{n}") for t, n in zip(pdf["title"], pdf["chars"])])


def uploaded(texts: DataFrame) -> DataFrame:
    """SRC-4: documents of uploads (title, text): cleaned, at most MAX_CHARS, with ``problem`` if too short and ``notice`` if trimmed."""
    clean = texts.select("title", T.clean_extracted(F.coalesce("text", F.lit(""))).alias("clean"))
    cut = clean.select("title", T.trim_to_chars(F.col("clean"), MAX_CHARS).alias("text"), F.length("clean").alias("before"))
    short = F.length("text") < MIN_CHARS
    rows = cut.select("title", F.lit("uploaded").alias("category"), "text", F.length("text").alias("chars"), F.when(short, "fewer than 500 characters of text").alias("problem"), F.when(F.col("before") > MAX_CHARS, "trimmed to 240000 characters").alias("notice"))
    return rows.mapInPandas(_upload_ids, "title string, category string, text string, chars int, problem string, notice string, id string")


def pasted(spark: SparkSession, title: str, text: str) -> DataFrame:
    """SRC-5: a text that was pasted, as an upload of a .txt file."""
    return uploaded(spark.createDataFrame([(f"{title}.txt", text)], "title string, text string"))
