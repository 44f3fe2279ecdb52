"""Retrieval queries with their SQL.

The query set is stated with each: titles of the questions, or summaries, whose id is divisible by 20, each against all
chunks.  Scores are rounded before they are ranked, ties go to the smaller id, so ranks are the same everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import scoring, text
from quernstone.operators import chunking, ranking, retrieval, store
from quernstone.plans.text_queries import WORDS, tokens_sql
from quernstone.session import cut, spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
EVERY = 20
K = 10


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _titles(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "questions").where(F.col("id") % EVERY == 0)
    return q.select(F.col("id").alias("query_id"), F.coalesce("title", F.lit("")).alias("query"))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "document_chunks").select("id", "content"))


Q = f"q as (select id as query_id, coalesce(title, '') as query from questions where id % {EVERY} = 0)"
LEXICAL = f"""
{Q}, qt as (select query_id, token, count(*) as tf from (select query_id, unnest({tokens_sql('query')}) as token from q) group by 1, 2),
dt as (select id, token, count(*) as tf from (select id, unnest({tokens_sql("coalesce(content, '')")}) as token from document_chunks) group by 1, 2),
qn as (select query_id, sqrt(sum(tf * tf)) as n from qt group by 1), dn as (select id, sqrt(sum(tf * tf)) as n from dt group by 1),
lex as (select query_id, id, round(cast(dot as double) / (a.n * b.n), 4) as score from (select query_id, id, sum(qt.tf * dt.tf) as dot from qt join dt using (token) group by 1, 2) join qn a using (query_id) join dn b using (id))
"""


def top_sql(source: str, k: int, extra: str = "") -> str:
    return f"select query_id, id, score{extra}, row_number() over (partition by query_id order by score desc, id) as rank from {source} qualify row_number() over (partition by query_id order by score desc, id) <= {k}"


def _ranked(hits: DataFrame, k: int = K) -> DataFrame:
    return retrieval.top_k(hits, ["query_id"], [F.desc("score"), F.asc("id")], k).select("query_id", "id", "score", "rank")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "document_chunks").select("id", F.coalesce("content", F.lit("")).alias("content"))


@query(f"with {LEXICAL} {top_sql('lex', K)}")
def lexical_topk(spark, sf):
    """The ten chunks with the highest token cosine for each title (K-L1, C7, D9, J1)."""
    return _ranked(ranking.lexical(_titles(spark, sf), _chunks(spark, sf), "id", K))


def bm25_sql(queries: str = "q", name: str = "bm") -> str:
    return f"""
{name}_q as (select distinct query_id, token from (select query_id, unnest({WORDS.format(c='query')}) as token from {queries})),
{name}_d as (select id, {WORDS.format(c='content')} as w from document_chunks), {name}_c as (select count(*) as n, avg(len(w)) as avgdl from {name}_d),
{name}_t as (select id, dl, token, count(*) as tf from (select id, len(w) as dl, unnest(w) as token from {name}_d) where token in (select token from {name}_q) group by 1, 2, 3),
{name}_f as (select token, count(*) as df from {name}_t group by 1),
{name} as (select query_id, id, round(sum(gain), 4) as score from (select id, token, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) as gain from {name}_t join {name}_f using (token), {name}_c) join {name}_q using (token) group by 1, 2)
"""


@query(f"with {Q}, {bm25_sql()} {top_sql('bm', K)}")
def bm25_topk(spark, sf):
    """The ten best chunks for each title by BM25."""
    return _ranked(ranking.bm25(_titles(spark, sf), _chunks(spark, sf), "id", K))


@query(
    f"with s as (select q.vec_id as query_id, e.vec_id as id, round(list_cosine_similarity(cast(q.embedding as double[]), cast(e.embedding as double[])), 4) as score from embeddings q, embeddings e where q.vec_id % {EVERY} = 0) {top_sql('s', K)}"
)
def vector_topk(spark, sf):
    """The ten nearest vectors of the embeddings whose id is divisible by 20 (K4, K-L2), exactly, in blocks of queries."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    hits = retrieval.vector_top_k(e.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), "v"), spread(e), "id", K)
    return retrieval.top_k(hits, ["query_id"], [F.desc("score"), F.asc("id")], K).select("query_id", "id", "score", "rank")


def _summaries(spark, sf) -> DataFrame:
    s = table(spark, sf, "document_summaries").where(F.col("document_id") % EVERY == 0)
    v = retrieval.usable_vectors(s.select("document_id", "summary", "embedding_json", "embedding_model"), table(spark, sf, "embedding_models"))
    return v.select(F.col("document_id").alias("query_id"), F.coalesce("summary", F.lit("")).alias("query"), "embedding_model", "v")


def _channels(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Both channels' twenty best hits of every query."""
    queries = cut(_summaries(spark, sf))
    rows = retrieval.usable_vectors(table(spark, sf, "document_chunks").select("id", "embedding_json", "embedding_model"), table(spark, sf, "embedding_models"))
    semantic = retrieval.vector_top_k(queries.select("query_id", "v", "embedding_model"), spread(rows), "id", 2 * K, "embedding_model")
    return semantic, ranking.bm25(queries.select("query_id", "query"), _chunks(spark, sf), "id", 2 * K)


USABLE = "regexp_matches(embedding_json, '^\\s*\\[[^\\[\\]\"]*\\]\\s*$') and len(v) = dims and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0"
VECTORS = "select *, try_cast(embedding_json as double[]) as v from {t} join embedding_models m on m.model_name = embedding_model"
FUSED = f"""
sv as (select document_id as query_id, coalesce(summary, '') as query, embedding_model, v from ({VECTORS.format(t='document_summaries')}) where {USABLE} and document_id % {EVERY} = 0),
cv as (select id, embedding_model, v from ({VECTORS.format(t='document_chunks')}) where {USABLE}),
vs as (select query_id, id, round(list_cosine_similarity(sv.v, cv.v), 4) as score from sv join cv using (embedding_model)),
vt as (select query_id, id, score from ({top_sql('vs', 2 * K)})), {bm25_sql('sv')}, bt as (select query_id, id, score from ({top_sql('bm', 2 * K)})),
vn as (select query_id, id, case when max(score) over (partition by query_id) > 0 then score / max(score) over (partition by query_id) else 0 end as x from vt),
bn as (select query_id, id, case when max(score) over (partition by query_id) > 0 then score / max(score) over (partition by query_id) else 0 end as x from bt),
fused as (select query_id, id, round(coalesce(vn.x, 0), 4) as semantic_score, round(coalesce(bn.x, 0), 4) as lexical_score, round(0.65 * coalesce(vn.x, 0) + 0.35 * coalesce(bn.x, 0), 4) as score from vn full join bn using (query_id, id))
"""


def _fused(spark, sf) -> DataFrame:
    semantic, lexical = _channels(spark, sf)
    return retrieval.fuse(semantic, lexical, "id")


@query(f"with {FUSED} {top_sql('fused', K, ', semantic_score, lexical_score')}")
def fusion(spark, sf):
    """Vector and BM25 channels of each summary, normalised, weighted and ranked."""
    ranked = retrieval.top_k(_fused(spark, sf), ["query_id"], [F.desc("score"), F.asc("id")], K)
    return ranked.select("query_id", "id", "score", "semantic_score", "lexical_score", "rank")


@query(f"with {FUSED} select query_id, id, score from fused where (semantic_score >= 0.56 or lexical_score >= 0.12 or (semantic_score = 0 and lexical_score = 0)) and score >= 0.2")
def thresholds_second(spark, sf):
    """Fused hits that pass the thresholds of the balanced profile."""
    f = _fused(spark, sf)
    ok = scoring.passes_any(F.col("semantic_score"), F.col("lexical_score"), F.col("score"), (0.56, 0.12, 0.2), both_zero=True)
    return f.where(ok).select("query_id", "id", "score")


PROFILE_ROWS = " union all ".join(f"select '{n}' as profile, {a} as t3, {b} as t1, {c} as t2" for n, a, b, c in scoring.PROFILES)


@query(f"with {FUSED}, p as ({PROFILE_ROWS}) select profile, count(*) as n_hits, count(distinct query_id) as n_queries from fused, p where (semantic_score >= t1 or lexical_score >= t2) and score >= t3 group by 1")
def profile_sweep(spark, sf):
    """How many fused hits each filter profile keeps (K15): all profiles in one pass."""
    f = _fused(spark, sf)
    kept = [
        F.when(scoring.passes_any(F.col("semantic_score"), F.col("lexical_score"), F.col("score"), (b, c, a)), F.lit(n)) for n, a, b, c in scoring.PROFILES
    ]
    each = f.select("query_id", F.explode(F.array_compact(F.array(*kept))).alias("profile"))
    return each.groupBy("profile").agg(F.count("*").alias("n_hits"), F.countDistinct("query_id").alias("n_queries"))


@query(f"with {LEXICAL} select query_id, id, round(case when max(score) over (partition by query_id) > 0 then score / max(score) over (partition by query_id) else 0 end, 4) as normalised from lex")
def max_normalise(spark, sf):
    """Lexical scores of all hits divided by each query's best."""
    return ranking.normalised(_titles(spark, sf), _chunks(spark, sf), "id")


BONUS = f"""
with {LEXICAL}, top as ({top_sql('lex', K)}), terms as (select query_id, list_distinct(list_filter({tokens_sql('query')}, lambda t: length(t) >= 2 and not regexp_full_match(t, '[0-9]+') and t not in ({", ".join(f"'{t}'" for t in text.STOP_TERMS)}))) as terms from q)
select query_id, id, round(least(1.0, len(list_filter(terms, lambda t: contains(lower(coalesce(content, '')), t))) / 8.0), 4) as bonus from top join terms using (query_id) join document_chunks using (id)
"""


@query(BONUS)
def exact_bonus(spark, sf):
    """Exact-term bonus of each title's ten best chunks."""
    top = lexical_topk(spark, sf).select("query_id", "id")
    terms = _titles(spark, sf).select("query_id", text.query_terms(F.col("query")).alias("terms"))
    joined = top.join(terms, "query_id").join(_chunks(spark, sf), "id")
    return joined.select("query_id", "id", F.round(scoring.exact_bonus(F.col("terms"), F.coalesce("content", F.lit(""))), 4).alias("bonus"))


POSITIONS = "pos as (select id, document_id, row_number() over (partition by document_id order by id) - 1 as chunk_index, content from document_chunks)"


def _positions(spark, sf) -> DataFrame:
    """(id, document_id, chunk_index): chunks by their place in the document, without their texts."""
    places = store.number_within(table(spark, sf, "document_chunks"), "document_id", "id", "chunk_index")
    return cut(places.select("id", "document_id", "chunk_index"))


@query(
    f"with {LEXICAL}, {POSITIONS}, hit as (select query_id, document_id, chunk_index, score from ({top_sql('lex', K)}) join pos using (id)) "
    "select query_id, h.document_id, h.chunk_index, h.score, min(p.chunk_index) as window_start, max(p.chunk_index) as window_end, md5(string_agg(coalesce(p.content, ''), chr(10) || chr(10) order by p.chunk_index)) as window_md5 "
    "from hit h join pos p on p.document_id = h.document_id and p.chunk_index between h.chunk_index - 1 and h.chunk_index + 1 group by 1, 2, 3, 4"
)
def chunk_window(spark, sf):
    """Each title's best chunks with their neighbours' text."""
    pos = _positions(spark, sf)
    hits = lexical_topk(spark, sf).join(pos.select("id", "document_id", "chunk_index"), "id").select("query_id", "document_id", "chunk_index", "score")
    w = retrieval.windows(hits, pos, _texts(spark, sf), 1)
    return w.select("query_id", "document_id", "chunk_index", "score", "window_start", "window_end", F.md5("window_text").alias("window_md5"))


@query(
    f"with {LEXICAL}, {POSITIONS}, hit as (select query_id, document_id, chunk_index, score from ({top_sql('lex', 50)}) join pos using (id)), "
    "m as (select document_id, chunk_index // 3 as bucket, count(*) as members from pos group by 1, 2), g as (select query_id, document_id, chunk_index // 3 as bucket, count(distinct chunk_index) as n_hits, max(score) as score from hit group by 1, 2, 3) "
    "select query_id, document_id, bucket, score, n_hits, n_hits >= 2 and n_hits >= 0.5 * members as merged from g join m using (document_id, bucket)"
)
def bucket_merge(spark, sf):
    """Neighbouring hits merged into buckets of three chunks (K-L9, D12)."""
    pos = _positions(spark, sf)
    hits = ranking.lexical(_titles(spark, sf), _chunks(spark, sf), "id", 50).join(pos.select("id", "document_id", "chunk_index"), "id")
    return retrieval.bucket_merge(hits, pos)


@query(None)
def hierarchy_merge(spark, sf):
    """Leaf hits of the titles merged upwards in the documents' size hierarchy (K-L7, K-L8); iterative, rows only."""
    d = spread(table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "content"))
    tree = chunking.hierarchy(d, "document_id", "content")
    nodes = cut(tree.select("document_id", "node_key", "parent_key"))
    leaves = tree.where("level = 0").select(F.concat_ws("/", F.col("document_id").cast("string"), "node_key").alias("leaf"), "content")
    top = ranking.lexical(_titles(spark, sf), leaves, "leaf", 50, text.words)
    parts = F.split("leaf", "/")
    hits = top.select("query_id", parts[0].cast("bigint").alias("document_id"), parts[1].alias("node_key"), "score")
    return retrieval.hierarchy_merge(hits, nodes)


@query(
    f"with {LEXICAL}, {bm25_sql()}, u as (select query_id, id, score, 'lexical' as mode from ({top_sql('lex', K)}) union all select query_id, id, score, 'bm25' from ({top_sql('bm', K)})) "
    "select query_id, id, score, mode from u qualify row_number() over (partition by query_id, id order by score desc, mode) = 1"
)
def multi_mode_dedupe(spark, sf):
    """Hits of two modes together, the best of each chunk."""
    titles, c = _titles(spark, sf), _chunks(spark, sf)
    best = lambda s, m: s.select("query_id", "id", "score", F.lit(m).alias("mode"))
    both = best(ranking.lexical(titles, c, "id", K), "lexical").unionByName(best(ranking.bm25(titles, c, "id", K), "bm25"))
    return retrieval.keep_best(both, ["query_id", "id"], [F.asc("mode")])


ROUTE = f"""
{Q}, rq as (select distinct query_id, token from (select query_id, unnest({WORDS.format(c='query')}) as token from q)),
rs as (select document_id, token, count(*) as tf from (select document_id, unnest({WORDS.format(c='summary')}) as token from document_summaries) group by 1, 2),
route as (select query_id, document_id, cast(count(*) as bigint) as score from rq join rs using (token) group by 1, 2
  qualify row_number() over (partition by query_id order by count(*) desc, document_id) <= 6)
"""


@query(f"with {ROUTE} select query_id, document_id, score from route")
def summary_route(spark, sf):
    """The six documents whose summaries share most words with each title (K5, K-L4, E5)."""
    q = _titles(spark, sf).select("query_id", F.explode(F.array_distinct(text.words(F.col("query")))).alias("token"))
    s = table(spark, sf, "document_summaries").select("document_id", F.explode(F.array_distinct(text.words(F.coalesce("summary", F.lit(""))))).alias("token"))
    n = s.join(q, "token").groupBy("query_id", "document_id").agg(F.count("*").alias("score"))
    return retrieval.top_k(n, ["query_id"], [F.desc("score"), F.asc("document_id")], 6).drop("rank")


@query(
    f"with {ROUTE}, {LEXICAL.replace(Q + ',', '')}, hit as (select query_id, id, document_id, score, rank from ({top_sql('lex', K)}) join (select id, document_id from document_chunks) using (id)) "
    "select h.query_id, h.id, h.document_id, h.score, r.score as route_score from hit h left join route r on r.query_id = h.query_id and r.document_id = h.document_id"
)
def route_attach(spark, sf):
    """Hits with the score of the route that leads to their document, if any."""
    c = table(spark, sf, "document_chunks").select("id", "document_id")
    hits = lexical_topk(spark, sf).join(c, "id")
    r = summary_route(spark, sf).withColumnRenamed("score", "route_score")
    return hits.join(r, ["query_id", "document_id"], "left").select("query_id", "id", "document_id", "score", "route_score")


@query(
    f"with {ROUTE}, {LEXICAL.replace(Q + ',', '')}, hit as (select query_id, id, document_id, score from ({top_sql('lex', K)}) join (select id, document_id from document_chunks) using (id)), "
    "inside as (select h.* from hit h join route r on r.query_id = h.query_id and r.document_id = h.document_id) "
    "select query_id, id, score from inside union all select query_id, id, score from hit where query_id not in (select query_id from inside)"
)
def widening(spark, sf):
    """Hits in routed documents, or all hits of queries whose route holds none."""
    hits = route_attach(spark, sf)
    inside = hits.where("route_score is not null").select("query_id", "id", "score")
    return retrieval.widen(inside, hits.select("query_id", "id", "score"))


@query(f"with {LEXICAL} select query_id, id, score, rank, substring(coalesce(content, ''), 1, 500) as content_preview from ({top_sql('lex', 30)}) join document_chunks using (id)")
def trace_projection(spark, sf):
    """The first thirty candidates of each title as a trace records them."""
    top = _ranked(ranking.lexical(_titles(spark, sf), _chunks(spark, sf), "id", 30), 30)
    return top.join(_chunks(spark, sf), "id").select("query_id", "id", "score", "rank", F.substring(F.coalesce("content", F.lit("")), 1, 500).alias("content_preview"))


@query(
    f"with {LEXICAL}, hit as ({top_sql('lex', K)}), n as (select h.*, length(coalesce(content, '')) as n_chars from hit h join document_chunks using (id)) "
    "select query_id, id, rank, row_number() over (partition by query_id order by case when n_chars < 200 then 0 else 1 end, rank) as rerank_rank from n"
)
def rerank_fill(spark, sf):
    """Hits reordered by a ranker that names only some of them, here the short ones, the rest after them."""
    hits = lexical_topk(spark, sf)
    short = hits.join(_chunks(spark, sf), "id").where(F.length(F.coalesce("content", F.lit(""))) < 200)
    order = short.groupBy("query_id").agg(F.array_sort(F.collect_list("rank")).alias("positions"))
    return retrieval.rerank(hits, order).select("query_id", "id", "rank", "rerank_rank")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Fusion search of each summary with the windows of its hits."""
    pos = _positions(spark, sf)
    hits = fusion(spark, sf).join(pos.select("id", "document_id", "chunk_index"), "id")
    return retrieval.windows(hits.select("query_id", "document_id", "chunk_index", "score", "semantic_score", "lexical_score", "rank"), pos, _texts(spark, sf), 1)


def _query_lexical(source: str) -> str:
    """The CTEs of LEXICAL for the queries in ``source``."""
    return LEXICAL.replace(Q + ",", "").replace("from q)", f"from {source})")


HYBRID = f"""
sv as (select document_id as query_id, coalesce(summary, '') as query, embedding_model, v from ({VECTORS.format(t='document_summaries')}) where {USABLE} and document_id % {EVERY} = 0),
cv as (select id, embedding_model, v from ({VECTORS.format(t='document_chunks')}) where {USABLE}),
vs as (select query_id, id, round(list_cosine_similarity(sv.v, cv.v), 4) as score from sv join cv using (embedding_model)),
{_query_lexical('sv')}, ht as (select query_id, id, score from ({top_sql('vs', 8 * K)})), hl as (select query_id, id, score from ({top_sql('lex', 8 * K)})),
both_ as (select query_id, id, coalesce(ht.score, 0) as s, coalesce(hl.score, 0) as l from ht full join hl using (query_id, id)),
nrm as (select *, case when max(s) over (partition by query_id) > 0 then s / max(s) over (partition by query_id) else 0 end as sn, case when max(l) over (partition by query_id) > 0 then l / max(l) over (partition by query_id) else 0 end as ln from both_),
trm as (select query_id, list_distinct(list_filter({tokens_sql('query')}, lambda t: length(t) >= 2 and not regexp_full_match(t, '[0-9]+') and t not in ({", ".join(f"'{t}'" for t in text.STOP_TERMS)}))) as terms from sv),
scored as (select n.query_id, n.id, s as semantic_score, l as lexical_score, round(0.55 * sn + 0.35 * ln + 0.10 * least(1.0, len(list_filter(terms, lambda t: contains(lower(coalesce(c.content, '')), t))) / 8.0), 4) as score from nrm n join trm using (query_id) join document_chunks c using (id)),
hyb as (select query_id, id, semantic_score, lexical_score, score from scored where (semantic_score >= 0.56 or lexical_score >= 0.12) and score >= 0)
"""


@query(f"with {HYBRID} {top_sql('hyb', K, ', semantic_score, lexical_score')}")
def hybrid_first(spark, sf):
    """First-generation hybrid search of the summaries (K-L3, K-L5, K-L13, B6, J7): both channels over-fetched, normalised,
    weighted 0.55 / 0.35 with 0.10 for exact terms, thresholds, top ten."""
    queries = cut(_summaries(spark, sf))
    rows = retrieval.usable_vectors(table(spark, sf, "document_chunks").select("id", "embedding_json", "embedding_model"), table(spark, sf, "embedding_models"))
    semantic = retrieval.vector_top_k(queries.select("query_id", "v", "embedding_model"), spread(rows), "id", 8 * K, "embedding_model")
    lexical = ranking.lexical(queries.select("query_id", "query"), _chunks(spark, sf), "id", 8 * K)
    terms = queries.select("query_id", text.query_terms(F.col("query")).alias("terms"))
    scored = retrieval.weigh(semantic, lexical, terms, _texts(spark, sf), "id", scoring.HYBRID)
    kept = scored.where(scoring.passes_any(F.col("semantic_score"), F.col("lexical_score"), F.col("score"), (0.56, 0.12, 0.0)))
    return retrieval.top_k(kept, ["query_id"], [F.desc("score"), F.asc("id")], K).select("query_id", "id", "score", "semantic_score", "lexical_score", "rank")


@query(f"with {LEXICAL}, ok as (select * from lex where score >= 0.12 and score >= 0.0) {top_sql('ok', K)}")
def lexical_only(spark, sf):
    """Hits of titles that have no vector: the lexical channel alone with its threshold."""
    return _ranked(ranking.lexical(_titles(spark, sf), _chunks(spark, sf), "id", K)).where("score >= 0.12")


FOLDERS = ["讲义", "默认"]


@query(
    f"with {FUSED}, ok as (select f.query_id, f.id, f.score, d.doc_id as document_id, d.title from fused f join document_chunks c on c.id = f.id join documents d on d.doc_id = c.document_id "
    f"where coalesce(d.folder, '默认') in ({', '.join(repr(x) for x in FOLDERS)}) and not starts_with(coalesce(d.source, ''), 'past_answer:') and (semantic_score >= 0.56 or lexical_score >= 0.12 or (semantic_score = 0 and lexical_score = 0)) and score >= 0.2) "
    f"{top_sql('ok', K, ', document_id, title')}"
)
def search_pipeline(spark, sf):
    """Fused hits restricted to folders and the library, thresholds, top ten with their documents (K1, K10, K-L12, B9, K12)."""
    d = table(spark, sf, "documents").where(store.folder_of().isin(FOLDERS) & ~F.coalesce("source", F.lit("")).startswith("past_answer:"))
    c = table(spark, sf, "document_chunks").select("id", "document_id").join(d.select(F.col("doc_id").alias("document_id"), "title"), "document_id")
    f = _fused(spark, sf)
    ok = scoring.passes_any(F.col("semantic_score"), F.col("lexical_score"), F.col("score"), (0.56, 0.12, 0.2), both_zero=True)
    return retrieval.top_k(f.where(ok).join(c, "id"), ["query_id"], [F.desc("score"), F.asc("id")], K).select("query_id", "id", "score", "document_id", "title", "rank")
