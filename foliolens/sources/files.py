"""Reading documents and writing results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the first bytes of a PDF file.
PDF_MAGIC = "255044462D"
# Folders that are never searched for documents.
EXCLUDED = [".git", ".venv", "venv", "__pycache__", "legacy", "reviews"]
#: The layout of a document as PDF libraries give it: pages of blocks of lines of spans; type 0 is text.
LAYOUT = "array<struct<blocks:array<struct<type:int,lines:array<struct<spans:array<struct<text:string,size:double,flags:int,font:string,bbox:array<double>>>>>>>,tables:array<string>>>"


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, md): whole Markdown files."""
    return spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").load(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("md"))


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, status): PDF files; status says whether the content is empty, none, or a PDF."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    magic = F.hex(F.substring("content", 1, 5)) == PDF_MAGIC
    return f.select("path", "content", F.when(F.col("length") == 0, "empty").when(magic, "ok").otherwise("not-a-pdf").alias("status"))


def discover_pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, candidates): the PDF files right in a folder by path, without those of excluded folders, and how many there are.

    A caller that needs one document takes it where candidates is 1.
    """
    parts = F.split("path", "/")
    found = read_pdfs(spark, folder).where(~F.arrays_overlap(parts, F.array(*map(F.lit, EXCLUDED)))).select("path")
    return found.crossJoin(found.agg(F.count("*").alias("candidates"))).orderBy("path")


def spans(layouts: DataFrame) -> DataFrame:
    """(doc_id, ord, page, text, size, flags, font, bbox): the text spans of (doc_id, pages), pages as LAYOUT, in order."""
    per_page = F.transform(
        "pages",
        lambda p, n: F.transform(
            F.flatten(F.transform(F.flatten(F.transform(F.filter(p["blocks"], lambda b: b["type"] == 0), lambda b: b["lines"])), lambda x: x["spans"])),
            lambda s: F.struct((n + 1).alias("page"), s["text"].alias("text"), s["size"].alias("size"), s["flags"].alias("flags"), s["font"].alias("font"), s["bbox"].alias("bbox")),
        ),
    )
    return layouts.select("doc_id", F.posexplode(F.flatten(per_page)).alias("p", "s")).select("doc_id", (F.col("p") + 1).alias("ord"), "s.*")


def table_count(layouts: DataFrame) -> DataFrame:
    """(doc_id, tables): the tables found on all pages of (doc_id, pages); a page without any counts none."""
    return layouts.select("doc_id", F.aggregate("pages", F.lit(0), lambda n, p: n + F.greatest(F.coalesce(F.size(p["tables"]), F.lit(0)), F.lit(0))).alias("tables"))


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, pages): layouts as JSON, one document a line."""
    return spark.read.schema(f"doc_id long, pages {LAYOUT}").json(path)


def pdf_pages(pdfs: DataFrame) -> DataFrame:
    """(path, page_no, text) of the PDFs with status ok; needs an optional PDF library on the executors."""

    def run(batches):
        import io

        import pandas as pd

        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise RuntimeError("reading PDF text needs the optional package pypdf") from e
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                rows += [(path, n, p.extract_text() or "") for n, p in enumerate(PdfReader(io.BytesIO(content)).pages, 1)]
            yield pd.DataFrame(rows, columns=["path", "page_no", "text"])

    return pdfs.where("status = 'ok'").mapInPandas(run, "path string, page_no int, text string")


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """One row a reference of JSON files that hold lists; authors may be a list or a string."""
    raw = spark.read.format("text").option("wholetext", True).load(path)
    item = "array<struct<title:string,authors:string,year:string,doi:string,journal:string,raw_text:string>>"
    return (
        raw.select(F.posexplode(F.from_json("value", item)).alias("p", "r"))
        .select((F.col("p") + 1).alias("ref_index"), "r.*")
        .na.fill("")
    )


def write_json(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One JSON object a line; an existing folder is an error unless overwritten."""
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_pretty_json(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Each row as an indented JSON object, nulls included; letters stay as they are."""
    body = F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"})
    df.select(body.alias("value")).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_pages(pages: DataFrame, path: str, overwrite: bool = False) -> None:
    """The text of (doc_id, html) under path/doc_id=..., a file each."""
    pages.select("doc_id", F.col("html").alias("value")).repartition("doc_id").write.mode("overwrite" if overwrite else "errorifexists").partitionBy("doc_id").text(path)


def write_workspace(tables: dict[str, DataFrame], base: str, run_id: str, overwrite: bool = False) -> None:
    """Every table as Parquet under base/run_id/name; an existing one is an error unless overwritten."""
    for name, df in tables.items():
        df.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{base}/{run_id}/{name}")


def absent_passes(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of wanted (doc_id, dimension, body) that existing has not yet."""
    return wanted.join(existing.select("doc_id", "dimension"), ["doc_id", "dimension"], "left_anti")
