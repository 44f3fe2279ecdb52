"""Block products against the scores of single pairs."""

import pytest
from pyspark.sql import functions as F

from quernstone.functions import scoring, text
from quernstone.operators import ranking, retrieval
from quernstone.plans import search_queries

TEXTS = ["", None, "ho", "ho ho x", "How should I talk?", "他很孤独", "他很\n孤独 ho", "Interpretationen der Träume, interpretationen", "🙂a🙂a", "A" * 9000, "abc_12 abc_12 12345678 123456789", "ÄÖ ß İ"]


@pytest.fixture(scope="module")
def both(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "id long, content string").repartition(3)
    q = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "他", "ho", "nothing here"])], "query_id long, query string")
    return q, d


def best(df, k):
    return sorted(map(tuple, retrieval.top_k(df, ["query_id"], [F.desc("score"), F.asc("id")], k).select("query_id", "id", "score").collect()))


@pytest.mark.parametrize("tokens", [text.tokens, text.words])
def test_lexical(both, monkeypatch, tokens):
    monkeypatch.setattr(ranking, "TILE", 5)
    monkeypatch.setattr(ranking, "QUERIES", 4)
    q, d = both
    assert sorted(map(tuple, ranking.lexical(q, d, "id", 4, tokens).collect())) == best(retrieval.lexical_scores(q, d, "id", tokens), 4)
    assert best(ranking.lexical(q, d, "id", None, tokens), 99) == best(retrieval.lexical_scores(q, d, "id", tokens), 99)
    assert ranking.lexical(q.limit(0), d, "id", 4, tokens).count() == 0
    assert ranking.lexical(q, d.limit(0), "id", 4, tokens).count() == 0


def test_normalised(both, monkeypatch):
    for name, n in (("PAIRED", 10), ("QUERIES", 4), ("ASKED", 3), ("SENT", 7)):
        monkeypatch.setattr(ranking, name, n)
    q, d = both
    q = q.unionByName(q.withColumn("query_id", F.col("query_id") + 100))
    s = retrieval.lexical_scores(q, d, "id")
    want = s.select("query_id", "id", F.round(scoring.max_normalised(F.col("score"), "query_id"), 4))
    assert sorted(map(tuple, ranking.normalised(q, d, "id").collect())) == sorted(map(tuple, want.collect()))
    assert ranking.normalised(q.limit(0), d, "id").count() == 0
    assert ranking.normalised(q, d.limit(0), "id").count() == 0


def test_equal_queries_are_written_small(spark, tmp_path):
    """max_normalise fills the disk with its result; three equal titles may not take three times the room of one."""
    tokens = lambda n: F.concat_ws(" ", *(F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(60))) for i in range(n)))
    titles = spark.range(20).select(F.col("id").alias("query_id"), tokens(6).alias("query"))
    spark.range(4096).select("id", tokens(30).alias("content")).repartition(1).write.parquet(f"{tmp_path}/document_chunks.parquet")
    size = {}
    for copies in (1, 3):
        sf = tmp_path / str(copies)
        sf.mkdir()
        (sf / "document_chunks.parquet").symlink_to(tmp_path / "document_chunks.parquet")
        each = titles.crossJoin(spark.range(copies).withColumnRenamed("id", "copy"))
        each.select((F.col("query_id") * 320 + F.col("copy") * 20).alias("id"), F.col("query").alias("title")).write.parquet(f"{sf}/questions.parquet")
        search_queries.max_normalise(spark, str(sf)).write.parquet(f"{sf}/out")
        assert spark.read.parquet(f"{sf}/out").count() == copies * 20 * 4096
        size[copies] = sum(f.stat().st_size for f in (sf / "out").glob("*.parquet"))
    assert size[3] < 1.8 * size[1]


def test_bm25(both, monkeypatch):
    monkeypatch.setattr(ranking, "QUERIES", 4)
    q, d = both
    assert sorted(map(tuple, ranking.bm25(q, d, "id", 4).collect())) == best(retrieval.bm25_scores(q, d, "id"), 4)
    assert ranking.bm25(q.limit(0), d, "id", 4).count() == 0
    assert ranking.bm25(q, d.limit(0), "id", 4).count() == 0


@pytest.mark.parametrize("name", ["lexical_topk", "exact_bonus", "rerank_fill", "widening", "route_attach", "chunk_window", "bucket_merge", "multi_mode_dedupe", "lexical_only", "trace_projection", "max_normalise"])
def test_pairs_are_not_shuffled(spark, sf, name):
    """No query joins the tokens of texts and titles, which makes a row of every pair that shares one."""
    plan = search_queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "inline" not in plan


def test_vectors_are_not_shuffled(spark, monkeypatch):
    """However many queries there are, only each task's best hits move."""
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    rows = spark.range(60).select("id", F.array(F.cos("id"), F.sin("id")).alias("v"))
    hits = retrieval.vector_top_k(rows.select(F.col("id").alias("query_id"), "v"), rows, "id", 3)
    assert "CoGroup" not in hits._jdf.queryExecution().optimizedPlan().toString()
    assert hits.count() == 180 and hits.where("query_id = id and score = 1").count() == 60


def test_hierarchy_keeps_no_texts(spark, sf, monkeypatch):
    """What is written to the checkpoint folder is the tree without its texts."""
    kept = []
    monkeypatch.setattr(search_queries, "cut", lambda df: kept.append(df.columns) or df)
    assert search_queries.hierarchy_merge(spark, sf).count() > 0
    assert kept == [["document_id", "node_key", "parent_key"]]
