"""File sources: uploads by suffix, word-processor documents, markdown snippet libraries, directories, logs."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions.text import strip

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """Non-empty paragraphs, then table rows as cells joined by ' | ', parted by blank lines."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()
    paragraphs = [said(p) for p in body.findall(f"{_W}p")]
    rows = [" | ".join(filter(None, (said(c) for c in r.findall(f"{_W}tc")))) for r in body.iter(f"{_W}tr")]
    return "\n\n".join(x for x in [*paragraphs, *rows] if x)


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, loader, content, error) of the files below ``path``, the first path winning for each name.

    Text and markdown are decoded as UTF-8 without broken bytes, docx is unpacked; other kinds get an error, since their
    converters are external programs.  Each file is one row of a distributed scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.select("path", "content", F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
    first = named.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("path"))).where("r = 1").drop("r")
    suffix = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))

    @F.pandas_udf("content string, error string")
    def load(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for kinds, data in batches:
            out = []
            for kind, raw in zip(kinds, data):
                try:
                    if kind in ("txt", "md"):
                        out.append((raw.decode("utf-8", "ignore"), None))
                    elif kind == "docx":
                        out.append((docx_text(raw), None))
                    else:
                        out.append((None, f"no reader for .{kind}"))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["content", "error"], dtype=object)

    loaded = first.withColumn("loader", suffix).withColumn("d", load("loader", "content"))
    return loaded.select("name", "path", "loader", "d.content", "d.error")


def snippets(documents: DataFrame, key: str, content: str) -> DataFrame:
    """(key, number, title, themes, reuse_mode, text): the parts of markdown libraries that begin with '## n. title'.

    The quoted text is the block of lines that begin with '>'; fields without a line are null."""
    parts = documents.select(F.col(key), F.explode(F.split(F.col(content), r"(?m)^(?=## \d+\.)")).alias("part")).where(F.col("part").rlike(r"^## \d+\."))
    field = lambda name: F.nullif(strip(F.regexp_extract("part", f"(?m)^{name}[:：](.*)$", 1)), F.lit(""))
    quoted = F.filter(F.split("part", r"\r?\n"), lambda x: x.startswith(">"))
    body = F.array_join(F.transform(quoted, lambda x: strip(F.regexp_replace(x, "^>", ""))), "\n")
    return parts.select(
        key, F.regexp_extract("part", r"^## (\d+)\.", 1).cast("int").alias("number"), strip(F.regexp_extract("part", r"^## \d+\.(.*)", 1)).alias("title"),
        field("主题").alias("themes"), field("复用方式").alias("reuse_mode"), body.alias("text"),
    )


def log_tail(spark: SparkSession, path: str, n: int = 80) -> DataFrame:
    """The last ``n`` lines of a log, newest first."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    return lines.orderBy(F.desc("at")).limit(n).select("value")


def write_snapshot(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace the snapshot of a table; with ``partitions``, only those that ``df`` holds."""
    writer = df.write.mode("overwrite")
    if partitions:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partitions)
    writer.parquet(path)


def safe_name(text: str) -> str:
    """A folder name from any text."""
    return re.sub(r"[^a-zA-Z0-9_.:-]+", "_", text)
