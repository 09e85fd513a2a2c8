"""Folders of documents as a source: listing, classification, reading, rules, counters.

A folder is one machine's, so the driver lists it (paths and sizes only) and the listing becomes a DataFrame; workers
read the files. Spark's own listing would drop names that start with a dot or an underscore.
"""

from __future__ import annotations

import contextlib
import os
from collections.abc import Iterator
from importlib.util import find_spec

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..functions.session import stored
from ..operators.quality import reject_reason

#: Suffixes by kind, directories that hold no documents, the largest file read.
TEXT_SUFFIXES = (".txt", ".md", ".markdown", ".rst", ".org", ".tex", ".csv", ".tsv", ".log")
CODE_SUFFIXES = (".py", ".js", ".ts", ".tsx", ".jsx", ".rs", ".go", ".c", ".h", ".cpp", ".hpp", ".java", ".kt", ".rb", ".php", ".cs", ".swift", ".sh", ".bash", ".sql", ".html", ".css", ".scss", ".yaml", ".yml", ".toml", ".json", ".xml")
JSONL_SUFFIXES = (".jsonl", ".ndjson")
PDF_SUFFIXES = (".pdf",)
SKIP_DIRS = (".git", ".svn", ".hg", "node_modules", "__pycache__", ".venv", "venv", ".tox", "dist", "build", ".next", "target", ".idea", ".vscode")
MAX_FILE_BYTES = 20 * 1024 * 1024


def classify(path: Column) -> Column:
    """prose, code, jsonl, pdf, or null, by the last suffix of the file name."""
    suffix = F.lower(F.regexp_extract(F.regexp_extract(path, r"[^/]*$", 0), r"[^.](\.[^.]+)$", 1))
    return F.when(suffix.isin(*TEXT_SUFFIXES), "prose").when(suffix.isin(*CODE_SUFFIXES), "code").when(suffix.isin(*JSONL_SUFFIXES), "jsonl").when(suffix.isin(*PDF_SUFFIXES), "pdf")


def walk(root: str, follow_symlinks: bool = False) -> Iterator[tuple[str, int]]:
    """(path, bytes) of files below ``root``, without skipped and dot directories; each directory is entered once.

    A folder's files come by name, then its folders, the last name first. What cannot be read is passed over.
    """
    entered = set()
    for here, folders, files in os.walk(root, followlinks=follow_symlinks):
        place = os.path.realpath(here)
        if place in entered:
            folders.clear()
            continue
        entered.add(place)
        folders[:] = sorted((f for f in folders if f not in SKIP_DIRS and f[0] != "."), reverse=True)
        for path in (os.path.join(here, f) for f in sorted(files)):
            try:
                if (follow_symlinks or not os.path.islink(path)) and os.path.isfile(path):
                    yield path, os.path.getsize(path)
            except OSError:
                continue


def listing(spark: SparkSession, root: str, follow_symlinks: bool = False) -> DataFrame:
    """ord, path, name (relative), bytes, kind of a folder's files."""
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    rows = [(i, p, os.path.relpath(p, root), n) for i, (p, n) in enumerate(walk(root, follow_symlinks))]
    return spark.createDataFrame(rows, "ord long, path string, name string, bytes long").withColumn("kind", classify(F.col("name")))


_READ = T.StructType([T.StructField("status", T.StringType()), T.StructField("text", T.StringType())])


def _pdf(path: str) -> tuple[str, str | None]:
    """Pages with a blank line between; without the optional reader none, and a broken file reads as empty."""
    if not find_spec("pypdf"):
        return "skipped_pdf_no_reader", None
    pages: list[str] = []
    with contextlib.suppress(Exception):
        from pypdf import PdfReader

        pages += [page.extract_text() or "" for page in PdfReader(path).pages]
    return "read", "\n\n".join(pages)


def _read(path: str, kind: str) -> tuple[str, str | None]:
    if kind == "pdf":
        return _pdf(path)
    try:
        with open(path, "rb") as f:
            data = f.read()
    except OSError:  # as unreadable as a binary one
        return "skipped_binary", None
    return ("skipped_binary", None) if b"\0" in data[:8192] else ("read", data.decode("utf-8", "replace"))


@F.arrow_udf(_READ)
def read_files(paths, kinds):
    """Status and text of each file: UTF-8 with replacements; a NUL among the first 8192 bytes means binary."""
    import pyarrow as pa

    out = [_read(p.as_py(), k.as_py()) if p.is_valid else (None, None) for p, k in zip(paths, kinds, strict=True)]
    return pa.array([{"status": s, "text": x} for s, x in out], pa.struct([("status", pa.string()), ("text", pa.string())]))


def _rows(texts: DataFrame) -> DataFrame:
    """JSONL files as rows: blank lines are passed over, broken ones and non-string texts counted."""
    line = texts.select("ord", "name", F.posexplode(F.split("text", "\n", -1)).alias("line", "json")).filter(t.strip(F.col("json")) != "")
    v = F.try_parse_json("json")
    kind_of = lambda key: F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))
    got = lambda key: F.try_variant_get(v, f"$.{key}", "string")
    said = F.coalesce(got("text"), F.lit(""))
    filled = ~kind_of("text").isin("VOID") & (said != "") & ((kind_of("text") == "STRING") | ~said.isin("0", "0.0", "false", "[]", "{}"))  # what a condition takes for false
    raw = F.when(filled, F.struct(kind_of("text").alias("k"), got("text").alias("t"))).otherwise(F.struct(kind_of("content").alias("k"), got("content").alias("t")))
    row = line.withColumns({"raw": raw, "own": got("kind"), "object": F.schema_of_variant(v).startswith("OBJECT")})
    bad = v.isNull() | ~F.coalesce("object", F.lit(False)) | (F.col("raw.k").isNotNull() & ~F.col("raw.k").isin("STRING", "VOID"))
    status = F.when(bad, "skipped_bad_json").when(F.coalesce("raw.t", F.lit("")) == "", "skipped_empty").otherwise("read")
    return row.select("ord", "line", F.element_at(F.split("name", "/"), -1).alias("path"), F.when(F.col("own") == "code", "code").otherwise("prose").alias("kind"), status.alias("status"), F.col("raw.t").alias("text"))


def documents(spark: SparkSession, root: str, source: str = "custom", apply_filters: bool = True, follow_symlinks: bool = False) -> DataFrame:
    """All that a folder holds, with a status: kept, skipped_<why> or filtered_<reason>. Keep those that are ``kept``."""
    files = listing(spark, root, follow_symlinks)
    skip = F.when(F.col("kind").isNull(), "skipped_unsupported").when(F.col("bytes") > MAX_FILE_BYTES, "skipped_too_large")
    files = files.withColumn("skip", skip)
    read = stored(files.repartition("ord").withColumn("r", read_files(F.when(F.col("skip").isNull(), F.col("path")), "kind")), "files")
    one = read.filter("kind is null or kind <> 'jsonl' or skip is not null").select("ord", F.lit(0).alias("line"), F.col("name").alias("path"), F.when(F.col("kind") == "code", "code").otherwise("prose").alias("kind"), F.coalesce("skip", "r.status").alias("status"), F.col("r.text").alias("text"))
    blocked = read.filter("kind = 'jsonl' and skip is null and r.status <> 'read'").select("ord", F.lit(0).alias("line"), F.col("name").alias("path"), F.lit("prose").alias("kind"), F.col("r.status").alias("status"), F.lit(None).cast("string").alias("text"))
    many = _rows(read.filter("kind = 'jsonl' and skip is null and r.status = 'read'").select("ord", "name", F.col("r.text").alias("text")))
    rows = one.unionByName(blocked).unionByName(many).withColumn("text", t.normalise(F.col("text")))
    rows = rows.withColumn("status", F.when((F.col("status") == "read") & (F.col("text") == ""), "skipped_empty").otherwise(F.col("status")))
    if apply_filters:
        reason = F.when(F.col("status") == "read", reject_reason(F.col("text"), F.col("kind")))
        pooled = F.when(F.lower("path").rlike(r"\.(jsonl|ndjson)$"), F.lit("filtered_jsonl_row")).otherwise(F.concat(F.lit("filtered_"), reason))
        rows = rows.withColumn("status", F.when(reason.isNotNull(), pooled).otherwise(F.col("status")))
    final = F.when(F.col("status") == "read", "kept").otherwise(F.col("status"))
    return rows.select("ord", "line", "path", F.lit(source).alias("source"), "kind", final.alias("status"), "text")


def counters(rows: DataFrame) -> DataFrame:
    """Documents and characters by status."""
    return rows.groupBy("status").agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.when(F.col("status") == "kept", F.length("text"))), F.lit(0)).alias("characters"))
