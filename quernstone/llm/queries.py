"""The queries of this subpackage, each over its whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.bpe import encode_corpus
from quernstone.llm.neighbours import class_links, found_pairs, nearest
from quernstone.llm.packing import pack, plan_report
from quernstone.llm.pairs import judge_pairs
from quernstone.llm.pii import mentions, redacted
from quernstone.llm.residue import residue
from quernstone.llm.scans import damage, repaired
from quernstone.llm.sentences import sentence_units
from quernstone.llm.split import split_oversized
from quernstone.session import spread, table


def _chunk_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(spread(table(spark, sf_dir, "document_chunks").select("id", "content", "chunk_size", "chunk_overlap")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that the splitter cut into more than one piece."""
    cut_rows = _chunk_pieces(spark, sf_dir).where("piece_index = 1")
    return cut_rows.select(F.col("key").alias("chunk_id"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized chunk."""
    return _chunk_pieces(spark, sf_dir).withColumnRenamed("key", "chunk_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of usable vectors of one model with a cosine of at least 0.95."""
    return found_pairs(spark, sf_dir)


def p3_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar vectors for the rows whose id is divisible by 20, against all rows."""
    return nearest(spark, sf_dir)


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector with its class of exact copies and the number of similar classes."""
    return class_links(spark, sf_dir)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every defective draft or edited answer with its defect."""
    bad = p6_residue(spark, sf_dir, ("title",)).select("question_id")
    return judge_pairs(
        table(spark, sf_dir, "answers").select("id", "question_id", "draft", "edited"),
        table(spark, sf_dir, "questions").select("id", "title"),
        bad,
        spread(table(spark, sf_dir, "documents").where("lower(substring(lang, 1, 2)) in ('en', 'de', 'fr', 'es')").select("lang", "text")),
    )


def p5_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged lines of scanned pages with the joined word or correction."""
    return damage(table(spark, sf_dir, "documents"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged lines of scanned pages."""
    return p5_damage(spark, sf_dir).select("doc_id", "line_no", "kind")


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pdf documents as continuous readable paragraphs."""
    return repaired(table(spark, sf_dir, "documents"))


def p6_residue(spark: SparkSession, sf_dir: str, wanted: tuple[str, ...] = ("title", "description")) -> DataFrame:
    """Question fields that hold template residue, filler, an error page or a script notice, with kind and coverage."""
    prose = table(spark, sf_dir, "answers").select(F.col("draft").alias("text"))
    return residue(spread(table(spark, sf_dir, "questions").select("id", "title", "description")), spread(prose), wanted)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields to keep out."""
    return p6_residue(spark, sf_dir).select("question_id", "field_name")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units of the documents that are no pdf and of the sentence nodes."""
    documents = table(spark, sf_dir, "documents").where("loader is null or loader != 'pdf'")
    nodes = table(spark, sf_dir, "sentence_nodes")
    rows = documents.select(F.lit("documents").alias("rec_table"), F.col("doc_id").alias("rec_id"), F.col("content").alias("text"))
    return sentence_units(rows.union(nodes.select(F.lit("sentence_nodes"), "id", "sentence")))


def p7_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and length of the units of each table."""
    n = F.col("end_char") - F.col("start_char")
    return p7_found(spark, sf_dir).groupBy("rec_table").agg(F.count("*").alias("n_units"), F.avg(n).alias("mean_chars"), F.max(n).alias("max_chars"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode_corpus(table(spark, sf_dir, "documents"))


def p9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, for each container kind."""
    return pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_capacities"))


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each kind are, against the fewest that could hold the tokens."""
    kinds = table(spark, sf_dir, "pack_capacities").select("pack_id", "capacity")
    per_container = p9_pack(spark, sf_dir).where("n_tokens > 0").groupBy("pack_id", "container").agg(F.sum("n_tokens").alias("filled"))
    return (
        per_container.join(F.broadcast(kinds), "pack_id")
        .groupBy("pack_id", "capacity")
        .agg(F.count("*").alias("containers"), F.sum("filled").alias("tokens"), F.max("filled").alias("fullest"))
        .withColumn("fewest", F.ceil(F.col("tokens") / F.col("capacity")))
        .withColumn("used", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 4))
    )


def p9_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each container kind: the share of the fitted patterns in its plan and the tokens that patterns place."""
    return plan_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_capacities"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention of personal information in documents.text."""
    return mentions(table(spark, sf_dir, "documents"))


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every documents.text with typed placeholders."""
    return redacted(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p3_found": p3_found,
    "p3_knn": p3_knn,
    "p3_classes": p3_classes,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_damage": p5_damage,
    "p5_repaired": p5_repaired,
    "p6_found": p6_found,
    "p6_residue": p6_residue,
    "p7_found": p7_found,
    "p7_lengths": p7_lengths,
    "p8_ids": p8_ids,
    "p9_pack": p9_pack,
    "p9_fill": p9_fill,
    "p9_plan": p9_plan,
    "p10_found": p10_found,
    "p10_redacted": p10_redacted,
}

#: DuckDB has the same trimmed length without the pieces.
P1_SQL = """
select id as chunk_id from document_chunks
where chunk_size > 0 and length(trim(content, ' ' || chr(9) || chr(13) || chr(10) || chr(160) || chr(12288))) > chunk_size
"""
SQL: dict[str, str] = {"p1_found": P1_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
