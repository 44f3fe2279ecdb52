"""Queries over markdown snippets and headings in the stored contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.session import spread, table


def headings(spark, sf):
    """Headings of every content: lines that begin with marks or a section number."""
    d = spread(table(spark, sf, "documents").where("content is not null").select("doc_id", "content"))
    lines = d.select("doc_id", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(r"^(#{1,6} |[0-9]+\.[0-9]+ )")).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


QUERIES = {"headings": headings}
SQL = {
    "headings": "select doc_id, line_no, line from (select doc_id, unnest(range(len(l))) as line_no, unnest(l) as line from (select doc_id, string_split(content, chr(10)) as l from documents where content is not null)) where regexp_matches(line, '^(#{1,6} |[0-9]+\\.[0-9]+ )')"
}
