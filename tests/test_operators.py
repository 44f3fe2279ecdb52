"""Operators against plain Python on edge cases: nulls, empty and long texts, ties, repeated rows, empty tables."""

import io
import math
import random
import re
import zipfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.functions import scoring, text
from quernstone.operators import chunking, retrieval, store
from quernstone.sources import files
from quernstone.streaming import ingest

EDGE = ["", "a", "\n\n\n\n", "　x 空　", "🙂a", "我觉得。可能？也许!", "e.g. one. Two!", "A" * 3000, None]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, t string, content string")


def column(spark, texts, c):
    return [r.v for r in frame(spark, texts).select("id", c.alias("v")).orderBy("id").collect()]


def test_tokens(spark):
    def tokenise(t):
        t = t.lower()
        return re.findall(r"[a-z0-9_]+|[一-鿿]", t) + [t[i : i + 2] for i in range(max(0, len(t) - 1)) if "\n" not in t[i : i + 2]]

    texts = [t for t in EDGE if t is not None]
    assert [Counter(v) for v in column(spark, texts, text.tokens(F.col("t")))] == [Counter(tokenise(t)) for t in texts]


def test_noise_and_anonymise(spark):
    assert column(spark, ["QQ 123456", "好", "----=====", "正常的一行文字", ""], text.is_noise(F.col("t"))) == [True, False, True, False, False]
    got = column(spark, ["写信到a.b@example.org吧", "电话13812345678", "小明来了"], text.anonymise(F.col("t")))
    assert got == ["写信到[邮箱]吧", "电话[手机号]", "小某来了"]


def chunks_of(t, size, overlap):
    t = re.sub(r"\n{3,}", "\n\n", t.strip())
    if len(t) <= size:
        return [t]
    out, start = [], 0
    while True:
        end = min(len(t), start + size)
        out.append(t[start:end])
        if end == len(t):
            return out
        start = end - overlap


def test_chunks(spark):
    rnd = random.Random(1)
    texts = [*(t for t in EDGE if t is not None), *("".join(rnd.choice("ab \n字") for _ in range(rnd.randint(0, 900))) for _ in range(40))]
    for size, overlap in ((100, 0), (100, 99), (250, 60)):
        rows = chunking.chunks(frame(spark, texts), "id", "t", size, overlap).orderBy("id", "chunk_index").collect()
        got = {}
        for r in rows:
            got.setdefault(r.id, []).append(r.content)
        assert [got[i] for i in range(len(texts))] == [chunks_of(t, size, overlap) for t in texts]


def test_hierarchy_parents_hold_their_children(spark):
    nodes = chunking.hierarchy(frame(spark, ["x" * 5000, "y" * 150, "", None]), "id", "t").collect()
    by = {(n.id, n.node_key): n for n in nodes}
    assert {n.id for n in nodes} == {0, 1}
    for n in nodes:
        if n.parent_key:
            p = by[n.id, n.parent_key]
            assert p.start_char <= (n.start_char + n.end_char) / 2 and ((n.start_char + n.end_char) / 2 < p.end_char or p.end_char == max(m.end_char for m in nodes if m.id == n.id))


def test_deposit_memories(spark):
    t = "【风格】\n- 少用排比\n无\n【不应沉淀】\n- 秘密\n【】\n这一行有八个字以上吧\n短"
    assert [r.memory for r in chunking.deposit_memories(frame(spark, [t, None, ""]), "id", "t").orderBy("line_no").collect()] == ["风格：少用排比", "这一行有八个字以上吧"]


def test_cosines(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [1.0]), ([], []), ([0.0], [1.0])], "a array<double>, b array<double>")
    rows = df.select(scoring.cosine_zip(F.col("a"), F.col("b")).alias("z"), scoring.cosine_strict(F.col("a"), F.col("b")).alias("s")).collect()
    assert [round(r.z, 6) for r in rows] == [1.0, round(1 / math.sqrt(2), 6), 0.0, 0.0] and [r.s for r in rows] == [1.0, 0.0, 0.0, 0.0]


def test_vector_top_k_ties_and_groups(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i % 3)], "m" if i < 30 else "n") for i in range(40)], "id bigint, v array<double>, g string")
    got = retrieval.vector_top_k(rows.where("id in (0, 33)").select(F.col("id").alias("query_id"), "v", "g"), rows, "id", 3, "g")
    by = {}
    for r in got.collect():
        by.setdefault(r.query_id, []).append((-r.score, r.id))
    assert sorted(by[0]) == [(-1.0, 0), (-1.0, 3), (-1.0, 6)] and {i for _, i in by[33]} == {30, 33, 36}
    assert retrieval.vector_top_k(rows.limit(0).select(F.col("id").alias("query_id"), "v"), rows, "id", 3).count() == 0


def test_hierarchy_merge(spark):
    nodes = spark.createDataFrame(
        [(1, f"L0:{i}", f"L1:{i // 2}") for i in range(4)] + [(1, "L1:0", "L2:0"), (1, "L1:1", "L2:0"), (1, "L2:0", None)], "document_id int, node_key string, parent_key string"
    )
    hits = lambda *k: spark.createDataFrame([(7, 1, f"L0:{i}", 0.1 * (i + 1)) for i in k], "query_id int, document_id int, node_key string, score double")
    keys = lambda df: sorted((r.node_key, round(r.score, 2)) for r in df.collect())
    assert keys(retrieval.hierarchy_merge(hits(0, 1, 2, 3), nodes)) == [("L2:0", 0.4)]
    assert keys(retrieval.hierarchy_merge(hits(0, 1, 3), nodes)) == [("L0:3", 0.4), ("L1:0", 0.2)]
    assert keys(retrieval.hierarchy_merge(hits(0), nodes)) == [("L0:0", 0.1)]
    assert keys(retrieval.hierarchy_merge(hits(0, 1), nodes, threshold=1.0, strict=True)) == [("L0:0", 0.1), ("L0:1", 0.2)]


def test_widen_and_rerank(spark):
    every = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "query_id int, id int")
    assert sorted(map(tuple, retrieval.widen(every.where("id = 1"), every).collect())) == [(1, 1), (2, 3)]
    hits = spark.createDataFrame([(1, i, i) for i in (1, 2, 3)], "query_id int, id int, rank int")
    order = spark.createDataFrame([(1, [3, 9, 3])], "query_id int, positions array<int>")
    assert sorted((r.rerank_rank, r.id) for r in retrieval.rerank(hits, order).collect()) == [(1, 3), (2, 1), (3, 2)]


def test_store(spark):
    old = spark.createDataFrame([(1, "a", "t1"), (2, "b", "t2")], "id bigint, v string, made string")
    new = spark.createDataFrame([(2, "c", "t9"), (3, "d", "t9")], "id bigint, v string, made string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(store.upsert(old, new, "id", keep=("made",))) == [(1, "a", "t1"), (2, "c", "t2"), (3, "d", "t9")]
    assert rows(store.insert_or_ignore(old, new, "id")) == [(1, "a", "t1"), (2, "b", "t2"), (3, "d", "t9")]
    added = spark.createDataFrame([(f"n{i}", "t", i) for i in range(50)], "v string, made string, o int")
    ids = {r.v: r.id for r in store.insert(old, added, "id", "o").collect()}
    assert [ids[f"n{i}"] for i in range(50)] == list(range(3, 53))
    assert rows(store.delete_keys(old, new, {"id": "id"})) == [(1, "a", "t1")]
    m = spark.createDataFrame([('{"a": 1, "b": 2}', '{"b": 5}'), (None, '{"c": 1}')], "o string, n string").select(store.merge_json(F.col("o"), F.col("n")).alias("m")).collect()
    assert [r.m for r in m] == [{"a": "1", "b": "5"}, {"c": "1"}]


def test_sources(spark, tmp_path):
    z = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>你好</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "x").mkdir()
    (tmp_path / "a.docx").write_bytes(z.getvalue())
    (tmp_path / "b.txt").write_bytes("文".encode() + b"\xff")
    (tmp_path / "x" / "b.txt").write_text("second")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    got = {r.name: (r.content, r.error) for r in files.read_uploads(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": ("你好\n\na | b", None), "b.txt": ("文", None), "c.pdf": (None, "no reader for .pdf")}
    md = "intro\n## 1. 边界\n主题：关系\n复用方式：原文\n> 一句\n> 两句\n## 2. 空\n"
    rows = files.snippets(frame(spark, [md, "", None]), "id", "t").orderBy("number").collect()
    assert [(r.number, r.title, r.themes, r.reuse_mode, r.text) for r in rows] == [(1, "边界", "关系", "原文", "一句\n两句"), (2, "空", None, None, "")]


def test_streaming(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").write.parquet(str(tmp_path / "in"))
    q = ingest.chunk_stream(ingest.read_stream(spark, str(tmp_path / "in"), ingest.DOCUMENTS), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    want = chunking.chunks(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "content", 900, 120).count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == want
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(tmp_path / "ev"))
    arriving = ingest.read_stream(spark, str(tmp_path / "ev"), ingest.EVENTS)
    once = ingest.distinct_events(arriving).writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    once.awaitTermination(120)
    assert spark.table("once").select("event_id").distinct().count() == spark.table("once").count() > 0
    events = ingest.trace_windows(arriving)
    run = events.writeStream.format("memory").queryName("traces").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("traces").agg(F.sum("n")).first()[0] == 1000


@pytest.mark.parametrize("n", [0, 1, 2])
def test_bm25_and_lexical_on_tiny_tables(spark, n):
    d = spark.createDataFrame([(1, "猫 cat"), (2, None)][:n], "id int, content string")
    q = spark.createDataFrame([(9, "猫"), (8, ""), (7, None)], "query_id int, query string")
    assert retrieval.bm25_scores(q, d, "id").count() == min(n, 1)
    assert retrieval.lexical_scores(q, d, "id").count() == min(n, 1)


def test_bags_count_within_rows(spark):
    df = spark.createDataFrame([(1, "a b a 好好", 9), (2, "", 9), (3, None, 9), (1, "b", 9)], "id int, t string, tf int")
    got = sorted((r.id, r.token, r.tf) for r in retrieval.bag(df, "id", "t", text.words).collect())
    assert got == [(1, "a", 2), (1, "b", 1), (1, "b", 1), (1, "好", 2)]
    assert {r.n for r in retrieval.bags(df, "id", "t", text.words).where("id > 1").collect()} == {0}
    assert sorted(spark.range(1).select(F.explode(text.bigrams(F.lit("Ab🙂\nc"))).alias("b")).toPandas()["b"]) == ["ab", "b🙂"]


def test_number_within_spreads_a_hot_group(spark):
    rows = [(1 if i % 3 else i, i, "x") for i in range(300)] + [(None, 7, "x"), (None, 3, "x")]
    df = spark.createDataFrame(rows, "g int, id int, place string")
    want = {}
    for g, i in sorted(((g, i) for g, i, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        want[g, i] = sum(1 for h, k, _ in rows if h == g and k < i)
    got = {(r.g, r.id): r.n for r in store.number_within(df, "g", "id", "n").collect()}
    assert got == want and store.number_within(df.limit(0), "g", "id", "n").count() == 0


def test_many_query_vectors_meet_rows_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = [(i, [float(x) for x in rng.normal(size=6)], "ab"[i % 2]) for i in range(90)]
    rows = spark.createDataFrame(v, "id int, v array<double>, m string")
    asked = rows.where("id % 3 = 0").select(F.col("id").alias("query_id"), "v", "m")
    best = lambda: sorted((r.query_id, r.id, r.score) for r in retrieval.vector_top_k(asked, rows, "id", 4, "m").collect())
    few = best()
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 20)
    assert best() == few and len(few) == 120


def test_even_positions(spark):
    got = [[r.p for r in spark.range(1).select(F.explode(text.even_positions(F.lit(n), 12)).alias("p")).collect()] for n in (1, 12, 23, 100)]
    assert got[:2] == [[0], list(range(12))] and all(g == sorted({round(i * (n - 1) / 11) for i in range(12)}) for g, n in zip(got[2:], (23, 100)))
