"""Table-generating text operators: fixed-size chunks, spans, size hierarchies, summary nodes, memory lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.functions.text import collapse_lines, route_summary, strip

HIERARCHY = (200, 800, 2400)


def _starts(n: Column, size: int, step: int) -> Column:
    """0-based numbers of the chunks of a text of n characters."""
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / float(step)).cast("int"))
    return F.sequence(F.lit(0), last)


def chunks(df: DataFrame, key: str, text: str, size: int = 520, overlap: int = 80) -> DataFrame:
    """(key, chunk_index, content, chunk_size, chunk_overlap) of every text.

    ``size`` is at least 100, ``overlap`` below it.  A text within the size, an empty or a null one too, is one chunk."""
    size = max(100, size)
    overlap = min(max(0, overlap), size - 1)
    t = df.select(F.col(key), collapse_lines(strip(F.coalesce(F.col(text), F.lit("")))).alias("t"))
    step = size - overlap
    cut = t.select(key, "t", F.explode(_starts(F.length("t"), size, step)).alias("chunk_index"))
    return cut.select(
        key, "chunk_index", F.substring("t", F.col("chunk_index") * step + 1, F.lit(size)).alias("content"),
        F.lit(size).alias("chunk_size"), F.lit(overlap).alias("chunk_overlap"),
    )


def spans(df: DataFrame, key: str, text: str, size: int = 520, overlap: int = 0) -> DataFrame:
    """(key, chunk_index, n_chars of the text, start_char, end_char, content); empty and null texts have no spans."""
    size = max(100, size)
    overlap = min(max(0, overlap), size - 1)
    step = size - overlap
    t = df.select(F.col(key), collapse_lines(strip(F.coalesce(F.col(text), F.lit("")))).alias("t")).where(F.length("t") > 0)
    cut = t.select(key, "t", F.explode(_starts(F.length("t"), size, step)).alias("chunk_index"))
    start = F.col("chunk_index") * step
    return cut.select(
        key, "chunk_index", F.length("t").alias("n_chars"), start.cast("int").alias("start_char"), F.least(start + size, F.length("t")).cast("int").alias("end_char"),
        F.substring("t", start + 1, F.lit(size)).alias("content"),
    )


def hierarchy(df: DataFrame, key: str, text: str, sizes: tuple[int, ...] = HIERARCHY) -> DataFrame:
    """Nodes of each size, smallest first as level 0, each with the key of the parent that holds its middle.

    The parent follows from the middle's place in closed form, so no interval join is needed."""
    sizes = tuple(sorted({max(100, s) for s in sizes}))
    levels = []
    for level, size in enumerate(sizes):
        nodes = spans(df, key, text, size, 0)
        if level + 1 < len(sizes):
            up = sizes[level + 1]
            middle = (F.col("start_char") + F.col("end_char")) / 2
            n_parents = F.greatest(F.lit(1), F.ceil(F.col("n_chars") / float(up)))
            parent = F.concat(F.lit(f"L{level + 1}:"), F.least(F.floor(middle / up), n_parents - 1).cast("int").cast("string"))
        else:
            parent = F.lit(None).cast("string")
        levels.append(
            nodes.select(
                key, F.concat(F.lit(f"L{level}:"), F.col("chunk_index").cast("string")).alias("node_key"), F.lit(level).alias("level"),
                "chunk_index", parent.alias("parent_key"), "start_char", "end_char", F.lit(size).alias("chunk_size"), "content",
            )
        )
    return reduce(DataFrame.unionByName, levels)


def summary_nodes(df: DataFrame, key: str, title: str, folder: str, text: str) -> DataFrame:
    """(node_id, key, text): one routing node per document."""
    empty = F.lit("")
    body = route_summary(F.coalesce(F.col(title), empty), F.coalesce(F.col(folder), F.lit("默认")), F.coalesce(F.col(text), empty))
    return df.select(F.concat(F.lit("summary-"), F.col(key).cast("string")).alias("node_id"), F.col(key), body.alias("text"))


def deposit_memories(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, memory): lines worth keeping, each under its last 【section】 header.

    Sections on private matters are skipped; bullets are stripped, lines without one need eight characters."""
    lines = df.select(F.col(key), F.posexplode(F.split(F.col(text), r"\r\n|\n|\r")).alias("line_no", "raw")).withColumn("line", strip(F.col("raw")))
    header = F.when(F.col("line").rlike("^【.*】$"), F.regexp_replace("line", "^[【】]+|[【】]+$", ""))
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("header", header).withColumn("section", F.coalesce(F.last("header", ignorenulls=True).over(so_far), F.lit("")))
    bullet = F.col("line").rlike("^[-•]")
    body = F.when(bullet, strip(F.expr("substring(line, 2)"))).otherwise(F.when(F.length("line") >= 8, F.col("line")).otherwise(F.lit("")))
    kept = lines.where("header is null and line != '' and not (section like '%不应沉淀%' or section like '%私有信息%')").withColumn("body", body)
    kept = kept.where("body not in ('', '无', '暂无', '没有')")
    memory = F.when(F.col("section") != "", F.concat("section", F.lit("："), "body")).otherwise(F.col("body"))
    return kept.select(key, "line_no", memory.alias("memory"))
