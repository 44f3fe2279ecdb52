"""Reads, orderings, aggregates and writes over the store's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import text
from quernstone.operators import chunking, store
from quernstone.plans import text_queries as texts
from quernstone.session import big, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query("select doc_id, title, source, coalesce(folder, '默认') as folder, cast(length(content) as bigint) as size, created_at from documents")
def doc_list(spark: SparkSession, sf: str) -> DataFrame:
    """Listing of documents (B1)."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", "title", "source", store.folder_of().alias("folder"), big(F.length("content")).alias("size"), "created_at")


@query("select doc_id, title, source, loader, lang, created_at, row_number() over (order by doc_id desc) as position from documents")
def doc_scan(spark, sf):
    """All documents, newest id first (A1); positions come from a range-partitioned numbering."""
    d = table(spark, sf, "documents").select("doc_id", "title", "source", "loader", "lang", "created_at")
    empty = spark.createDataFrame([], "doc_id bigint, title string, source string, loader string, lang string, created_at timestamp_ntz, position bigint")
    return store.insert(empty, d.withColumn("minus", -F.col("doc_id")), "position", "minus").drop("minus")


@query("select distinct a.title, true as found from documents a semi join (select trim(title) as t from documents where folder = '讲义') b on trim(a.title) = b.t")
def exists_by_title(spark, sf):
    """Titles that some document of one folder has (A3), as a semi join for a whole batch."""
    d = table(spark, sf, "documents")
    wanted = store.where_all(d, folder="讲义").select(F.trim("title").alias("t"))
    return d.join(wanted, F.trim(d["title"]) == F.col("t"), "left_semi").select("title", F.lit(True).alias("found")).distinct()


@query(
    "select c.id, c.document_id, c.chunk_index, d.title, d.source, coalesce(d.folder, '默认') as folder, cast(length(c.content) as bigint) as n_chars "
    "from document_chunks c join documents d on d.doc_id = c.document_id"
)
def chunk_scan_join(spark, sf):
    """Chunks with their documents; orphans vanish."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "title", "source", store.folder_of().alias("folder"))
    c = table(spark, sf, "document_chunks").select("id", "document_id", "chunk_index", big(F.length("content")).alias("n_chars"))
    return c.join(d, "document_id").select("id", "document_id", "chunk_index", "title", "source", "folder", "n_chars")


@query(
    "select n.id, n.document_id, n.sentence_index, d.title, coalesce(n.window_text, n.sentence) as window_text from sentence_nodes n join documents d on d.doc_id = n.document_id"
)
def sentence_scan_join(spark, sf):
    """Sentence nodes with their documents."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "title")
    n = table(spark, sf, "sentence_nodes").select("id", "document_id", "sentence_index", F.coalesce("window_text", "sentence").alias("window_text"))
    return n.join(d, "document_id").select("id", "document_id", "sentence_index", "title", "window_text")


@query("select s.document_id, s.summary, s.summary_model, d.title from document_summaries s join documents d on d.doc_id = s.document_id")
def summary_scan_join(spark, sf):
    """Summaries with their documents."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "title")
    return table(spark, sf, "document_summaries").select("document_id", "summary", "summary_model").join(d, "document_id")


@query("select count(*) as n_all, count(feedback_json) as n_feedback, count(case when feedback_json is not null and length(draft) > 200 then 1 end) as n_long from answers")
def feedback_not_null(spark, sf):
    """Answers with feedback."""
    a = table(spark, sf, "answers")
    has = F.col("feedback_json").isNotNull()
    return a.agg(F.count("*").alias("n_all"), F.count_if(has).alias("n_feedback"), F.count_if(has & (F.length("draft") > 200)).alias("n_long"))


@query("select a.id, a.question_id, q.title, a.edited from answers a join questions q on q.id = a.question_id where a.edited is not null and length(a.edited) > 0")
def edited_answers(spark, sf):
    """Edited answers with their questions."""
    q = table(spark, sf, "questions").select(F.col("id").alias("question_id"), "title")
    a = table(spark, sf, "answers").where("edited is not null and length(edited) > 0").select("id", "question_id", "edited")
    return a.join(q, "question_id").select("id", "question_id", "title", "edited")


@query(
    "select a.id as run_id, a.question_id, q.title as question_title, case when a.edited is null then 'drafted' else 'final_saved' end as status, "
    "cast(case when q.heat >= 50 then 1 else 0 end as integer) as is_satisfied from answers a join questions q on q.id = a.question_id where q.heat >= 50"
)
def satisfied_runs(spark, sf):
    """Runs of satisfied questions."""
    q = table(spark, sf, "questions").where("heat >= 50").select(F.col("id").alias("question_id"), F.col("title").alias("question_title"))
    a = table(spark, sf, "answers").select(F.col("id").alias("run_id"), "question_id", F.when(F.col("edited").isNull(), "drafted").otherwise("final_saved").alias("status"))
    return a.join(q, "question_id").select("run_id", "question_id", "question_title", "status", F.lit(1).alias("is_satisfied"))


@query("select id, title, case when source_url is null then 'unknown' when source_url = '用户提问' then 'asked' else 'recommended' end as origin from questions")
def question_origin_split(spark, sf):
    """Questions by origin."""
    url = F.col("source_url")
    origin = F.when(url.isNull(), "unknown").when(url == "用户提问", "asked").otherwise("recommended")
    return table(spark, sf, "questions").select("id", "title", origin.alias("origin"))


@query("select doc_id, title from documents where lower(title) like '%.pdf'")
def pdf_suffix(spark, sf):
    """Documents whose title ends like a pdf file."""
    return table(spark, sf, "documents").where(F.lower("title").endswith(".pdf")).select("doc_id", "title")


@query("select id, status, heat from questions order by (status = 'new') desc nulls last, heat desc nulls last, id desc limit 100")
def question_board(spark, sf):
    """The first hundred questions of the board: new ones first, then by heat (F1), a top-k report."""
    q = table(spark, sf, "questions").select("id", "status", "heat")
    return q.orderBy(F.desc_nulls_last(F.col("status") == "new"), F.desc_nulls_last("heat"), F.desc("id")).limit(100)


@query(
    "select question_id, id, edited, updated_at from (select *, row_number() over (partition by question_id order by updated_at desc nulls last, id desc) r from answers) where r = 1"
)
def latest_answer_per_question(spark, sf):
    """The latest answer of each question (E1); ranks are cut before the shuffle."""
    a = table(spark, sf, "answers").select("question_id", "id", "edited", "updated_at")
    return store.latest(a, "question_id", order=[F.desc_nulls_last("updated_at"), F.desc("id")])


@query("select id, question_id, updated_at from answers order by updated_at desc nulls last, id desc limit 50")
def run_recent(spark, sf):
    """The fifty most recent runs (F3), a top-k report."""
    return table(spark, sf, "answers").select("id", "question_id", "updated_at").orderBy(F.desc_nulls_last("updated_at"), F.desc("id")).limit(50)


@query("select event_id as id, event_type as retrieval_mode, cast(json_extract(props, '$.k') as bigint) as k, cast(floor(value * 10) as bigint) as elapsed_ms from events order by ts desc, event_id desc limit 100")
def trace_recent(spark, sf):
    """The hundred latest traces with their settings decoded (F4, M2), a top-k report."""
    e = table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("retrieval_mode"), k.alias("k"), F.floor(F.col("value") * 10).cast("bigint").alias("elapsed_ms"))


@query(
    "select name from (select name from knowledge_folders union select coalesce(folder, '默认') from documents) where name is not null and name <> ''"
)
def folder_union(spark, sf):
    """Folders that are registered or in use (G1)."""
    used = table(spark, sf, "documents").select(store.folder_of().alias("name"))
    return table(spark, sf, "knowledge_folders").select("name").union(used).where("name is not null and name != ''").distinct()


COUNTED = ("questions", "documents", "knowledge_folders", "document_chunks", "document_summaries", "sentence_nodes", "answers", "embedding_models", "events")


@query(" union all ".join(f"select '{t}' as table_name, count(*) as n from {t}" for t in COUNTED))
def table_counts(spark, sf):
    """Rows of every table."""
    out = None
    for t in COUNTED:
        one = table(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "select 'documents' as table_name, cast(coalesce(sum(length(content)), 0) as bigint) as chars from documents union all "
    "select 'document_chunks', cast(coalesce(sum(length(content)), 0) as bigint) from document_chunks union all "
    "select 'document_summaries', cast(coalesce(sum(length(summary)), 0) as bigint) from document_summaries"
)
def char_totals(spark, sf):
    """Characters stored in each text table."""
    parts = [("documents", "content"), ("document_chunks", "content"), ("document_summaries", "summary")]
    out = None
    for t, c in parts:
        one = table(spark, sf, t).agg(F.coalesce(F.sum(F.length(c)), F.lit(0)).cast("bigint").alias("chars")).select(F.lit(t).alias("table_name"), "chars")
        out = one if out is None else out.unionByName(one)
    return out


EMBEDDED = ("document_chunks", "document_summaries", "sentence_nodes")


@query(
    " union all ".join(
        f"select '{t}' as table_name, embedding_model, count(*) as n, count(embedding_json) as embedded from {t} group by embedding_model" for t in EMBEDDED
    )
)
def embedded_counts(spark, sf):
    """Rows and embedded rows of each table and model."""
    out = None
    for t in EMBEDDED:
        g = table(spark, sf, t).groupBy("embedding_model").agg(F.count("*").alias("n"), F.count("embedding_json").alias("embedded"))
        one = g.select(F.lit(t).alias("table_name"), "embedding_model", "n", "embedded")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "select f.name, count(d.doc_id) as n_documents from knowledge_folders f left join documents d on coalesce(d.folder, '默认') = f.name group by f.name"
)
def folder_counts(spark, sf):
    """Documents of every registered folder, empty ones included (D5, D6); counted before the join."""
    n = table(spark, sf, "documents").groupBy(store.folder_of().alias("name")).agg(F.count("*").alias("n"))
    folders = table(spark, sf, "knowledge_folders").select("name")
    return folders.join(n, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n_documents"))


HEALTH_SQL = """
with c as (select document_id, count(*) n_chunks, count(embedding_json) n_embedded, array_to_string(list_sort(list_distinct(list(chunk_size) filter (chunk_size is not null))), ',') sizes,
  array_to_string(list_sort(list_distinct(list(embedding_model) filter (embedding_model is not null))), ',') models from document_chunks group by 1),
s as (select document_id, count(*) n_sentences from sentence_nodes group by 1), m as (select document_id, count(*) n_summaries from document_summaries group by 1)
select d.doc_id, coalesce(n_chunks, 0) n_chunks, coalesce(n_embedded, 0) n_embedded, coalesce(sizes, '') sizes, coalesce(models, '') models,
 coalesce(n_sentences, 0) n_sentences, coalesce(n_summaries, 0) n_summaries, coalesce(n_chunks, 0) = 0 missing_chunks,
 coalesce(n_embedded, 0) < coalesce(n_chunks, 0) missing_embeddings, coalesce(n_summaries, 0) = 0 missing_summary, coalesce(n_sentences, 0) = 0 missing_sentences
from documents d left join c on c.document_id = d.doc_id left join s on s.document_id = d.doc_id left join m on m.document_id = d.doc_id
"""


@query(HEALTH_SQL)
def document_health(spark, sf):
    """Index health of every document (D7, B19, Q7): each node table is aggregated once before its join."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    c = table(spark, sf, "document_chunks").groupBy(F.col("document_id").alias("doc_id")).agg(
        F.count("*").alias("n_chunks"), F.count("embedding_json").alias("n_embedded"), joined("chunk_size").alias("sizes"), joined("embedding_model").alias("models")
    )
    s = table(spark, sf, "sentence_nodes").groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").alias("n_sentences"))
    m = table(spark, sf, "document_summaries").groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").alias("n_summaries"))
    d = table(spark, sf, "documents").select("doc_id").join(c, "doc_id", "left").join(s, "doc_id", "left").join(m, "doc_id", "left")
    d = d.fillna(0, ["n_chunks", "n_embedded", "n_sentences", "n_summaries"]).fillna("", ["sizes", "models"])
    return d.withColumns(
        {
            "missing_chunks": F.col("n_chunks") == 0,
            "missing_embeddings": F.col("n_embedded") < F.col("n_chunks"),
            "missing_summary": F.col("n_summaries") == 0,
            "missing_sentences": F.col("n_sentences") == 0,
        }
    )


# --- writes: the snapshot after the statement


@query(
    "select id, title, heat, status from questions union all select (select max(id) from questions) + row_number() over (order by id), coalesce(nullif(trim(guidance), ''), title), 50, 'new' "
    "from questions where guidance is not null"
)
def insert_rows(spark, sf):
    """Questions after one was added for every guidance note (H3): ids follow the largest one in order."""
    q = table(spark, sf, "questions")
    new = q.where("guidance is not null").select(
        F.col("id").alias("from_id"), F.coalesce(F.nullif(F.trim("guidance"), F.lit("")), "title").alias("title"), F.lit(50).alias("heat"), F.lit("new").alias("status")
    )
    return store.insert(q.select("id", "title", "heat", "status"), new, "id", "from_id").drop("from_id")


@query("select name from knowledge_folders union all select distinct folder from documents where folder is not null and folder not in (select name from knowledge_folders)")
def insert_or_ignore_folder(spark, sf):
    """Registered folders after those in use were added (H4)."""
    f = table(spark, sf, "knowledge_folders").select("name")
    return store.insert_or_ignore(f, table(spark, sf, "documents").where("folder is not null").select(F.col("folder").alias("name")).distinct(), "name")


SUMMARISED = (
    f"select doc_id as document_id, case when length(t) <= 900 then t else coalesce(title, '') || chr(10) || chr(10) || substring(t, 1, 450) || chr(10) || '...' || chr(10) || right(t, 450) end as summary from (select doc_id, title, {texts.FLAT} as t from documents)"
)


@query(
    f"with n as ({SUMMARISED}) select s.document_id, s.summary, s.created_at from document_summaries s where s.document_id not in (select document_id from n) "
    "union all select n.document_id, n.summary, s.created_at from n left join document_summaries s on s.document_id = n.document_id"
)
def upsert_summary(spark, sf):
    """Summaries after every document was summarised again; creation times stay (H5)."""
    old = table(spark, sf, "document_summaries").select("document_id", "summary", "created_at")
    d = table(spark, sf, "documents")
    new = d.select(F.col("doc_id").alias("document_id"), text.head_tail_summary(F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))).alias("summary"))
    return store.upsert(old, new, "document_id", keep=("created_at",))


CHUNKED = texts.SQL["chunks"].replace("from documents)", "from documents where loader = 'txt')")


@query(
    f"with n as (select doc_id as document_id, cast(chunk_index as bigint) as chunk_index, content from ({CHUNKED})) "
    "select document_id, cast(chunk_index as bigint) as chunk_index, content from document_chunks where document_id is null or document_id not in (select document_id from n) union all select * from n"
)
def replace_chunks(spark, sf):
    """Chunks after those of all plain text documents were cut again from their whole contents (H6)."""
    old = table(spark, sf, "document_chunks").select("document_id", big("chunk_index").alias("chunk_index"), "content")
    d = table(spark, sf, "documents").where("loader = 'txt'").select(F.col("doc_id").alias("document_id"), "content")
    new = chunking.chunks(d, "document_id", "content").select("document_id", big("chunk_index").alias("chunk_index"), "content")
    return store.replace_where(old, new, "document_id")


@query("select id, case when id in (select question_id from answers where edited is not null) then 'edited' else status end as status from questions")
def update_status(spark, sf):
    """Question states after their answers were edited (H7)."""
    edited = table(spark, sf, "answers").where("edited is not null").select(F.col("question_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    q = table(spark, sf, "questions").select("id", "status").join(edited, "id", "left")
    return store.update(q, F.coalesce("hit", F.lit(False)), status=F.lit("edited")).drop("hit")


@query(
    "select id, cast(json_extract(feedback_json, '$.draft_length') as bigint) as draft_length, cast(json_extract(feedback_json, '$.edited_length') as bigint) as edited_length, "
    "cast(round(100 * cast(json_extract(feedback_json, '$.change_ratio') as double)) as bigint) as change_percent, 5 as rating from answers where feedback_json is not null"
)
def merge_feedback(spark, sf):
    """Feedback after a rating was merged into its object (H8)."""
    a = table(spark, sf, "answers").where("feedback_json is not null").select("id", store.merge_json(F.col("feedback_json"), F.lit('{"rating": 5}')).alias("m"))
    at = lambda k: F.try_element_at("m", F.lit(k))
    return a.select(
        "id", at("draft_length").cast("bigint").alias("draft_length"), at("edited_length").cast("bigint").alias("edited_length"),
        F.round(100 * at("change_ratio").cast("double")).cast("bigint").alias("change_percent"), at("rating").cast("int").alias("rating"),
    )


@query(
    "select 'document_chunks' as table_name, count(*) as n from document_chunks where document_id not in (select doc_id from documents where source = '上传文件') union all "
    "select 'sentence_nodes', count(*) from sentence_nodes where document_id not in (select doc_id from documents where source = '上传文件') union all "
    "select 'document_summaries', count(*) from document_summaries where document_id not in (select doc_id from documents where source = '上传文件') union all "
    "select 'documents', count(*) from documents where source is distinct from '上传文件'"
)
def cascade_delete_source(spark, sf):
    """Rows left after all documents of one source were deleted with their nodes (H9)."""
    d = table(spark, sf, "documents")
    gone = d.where("source = '上传文件'").select("doc_id")
    out = store.delete_keys(d, gone, {"doc_id": "doc_id"}).agg(F.count("*").alias("n")).select(F.lit("documents").alias("table_name"), "n")
    for t in ("document_chunks", "sentence_nodes", "document_summaries"):
        left = store.delete_keys(table(spark, sf, t), gone, {"document_id": "doc_id"})
        out = out.unionByName(left.agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n"))
    return out


@query(
    "select q.id, q.title from questions q where q.status <> 'new' union all select a.id, a.draft from answers a where a.question_id is null or a.question_id not in (select id from questions where status = 'new')"
)
def cascade_delete_question(spark, sf):
    """Questions and answers left after the new questions were deleted with their answers (H9)."""
    q = table(spark, sf, "questions")
    gone = q.where("status = 'new'").select("id")
    kept = q.where("status != 'new'").select("id", "title")
    return kept.union(store.delete_keys(table(spark, sf, "answers"), gone, {"question_id": "id"}).select("id", "draft"))


@query(
    "select f.name, count(d.doc_id) = 0 as deletable from knowledge_folders f left join documents d on coalesce(d.folder, '默认') = f.name group by f.name"
)
def guarded_folder_delete(spark, sf):
    """Which folders are empty and may be deleted."""
    return folder_counts(spark, sf).select("name", (F.col("n_documents") == 0).alias("deletable"))


MEMORIES = "select case when edited is null then 'revision_feedback_prompt' else 'manual_edit' end as source_type, question_id as source_id, draft as content from answers"


@query(
    f"with base as (select distinct * from ({MEMORIES} where id % 2 = 0)), m as ({MEMORIES}) select * from base union all "
    "(select distinct source_type, source_id, content from m where regexp_matches(content, '[^\\s\\x{3000}\\x{00a0}]') and not exists (select 1 from base b where b.source_type is not distinct from m.source_type and b.source_id is not distinct from m.source_id and b.content is not distinct from m.content))"
)
def dedupe_insert_memory(spark, sf):
    """Memories of every second answer after those of all answers were inserted, each once."""
    a = table(spark, sf, "answers")
    kind = F.when(F.col("edited").isNull(), "revision_feedback_prompt").otherwise("manual_edit")
    m = lambda rows: rows.select(kind.alias("source_type"), F.col("question_id").alias("source_id"), F.col("draft").alias("content"))
    return store.dedupe_insert(m(a.where("id % 2 = 0")).distinct(), m(a), "source_type", "source_id", "content")


@query("select doc_id, case when folder is null then '默认' when folder not in (select name from knowledge_folders) then '待整理' else folder end as folder from documents")
def migrate_folders(spark, sf):
    """Folders after the migration that fills and registers them (H2)."""
    known = table(spark, sf, "knowledge_folders").select(F.col("name").alias("folder")).withColumn("known", F.lit(True))
    d = table(spark, sf, "documents").select("doc_id", "folder").join(known, "folder", "left")
    folder = F.when(F.col("folder").isNull(), store.DEFAULT_FOLDER).when(F.col("known").isNull(), "待整理").otherwise(F.col("folder"))
    return d.select("doc_id", folder.alias("folder"))


@query(
    "select title, source, doc_id from (select *, row_number() over (partition by coalesce(title, ''), coalesce(folder, '默认') order by doc_id) r from documents where content is not null and trim(content) <> '') where r = 1"
)
def import_batch(spark, sf):
    """What an import keeps: the first document of each title and folder that has a text."""
    d = table(spark, sf, "documents").where("content is not null and trim(content) != ''").withColumns({"t": F.coalesce("title", F.lit("")), "f": store.folder_of()})
    return store.latest(d.select("title", "source", "doc_id", "t", "f"), "t", "f", order=[F.asc("doc_id")]).select("title", "source", "doc_id")


@query("select doc_id, source, case when source is null then 'unknown' when starts_with(source, 'past_answer:') then 'past_answer' else 'library' end as class, try_cast(regexp_extract(source, '^past_answer:([0-9]+)$', 1) as bigint) as answer_id from documents")
def metadata_filter(spark, sf):
    """Source class of every document and the answer it came from."""
    s = F.col("source")
    kind = F.when(s.isNull(), "unknown").when(s.startswith("past_answer:"), "past_answer").otherwise("library")
    return table(spark, sf, "documents").select("doc_id", "source", kind.alias("class"), F.regexp_extract(s, "^past_answer:([0-9]+)$", 1).try_cast("bigint").alias("answer_id"))


@query(
    "with n as (select d.doc_id, sha256(concat_ws('|', cast(d.doc_id as varchar), coalesce(d.title, ''), coalesce(d.content, ''))) as fingerprint from documents d) select doc_id, fingerprint from n"
)
def document_fingerprints(spark, sf):
    """The fingerprint by which an index tells that a document changed."""
    parts = F.concat_ws("|", F.col("doc_id").cast("string"), F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    return table(spark, sf, "documents").select("doc_id", F.sha2(parts, 256).alias("fingerprint"))


LEVEL = "sha256(string_agg({c}, '' order by {o} desc))"
SIGNATURE_SQL = (
    "with f as (select d.doc_id, d.created_at, coalesce(folder, '默认') as folder, sha256(concat_ws('|', cast(d.doc_id as varchar), coalesce(d.title, ''), coalesce(d.content, ''))) as fingerprint from documents d), "
    f"a as (select folder, doc_id // 1000 as b, count(*) as n, {LEVEL.format(c='fingerprint', o='doc_id')} as s from f {{where}} group by 1, 2), "
    f"b as (select folder, b // 1000 as c, sum(n) as n, {LEVEL.format(c='s', o='b')} as s from a group by 1, 2), "
    f"g as (select folder, cast(sum(n) as bigint) as n_documents, {LEVEL.format(c='s', o='c')} as signature from b group by 1)"
)


def _signatures(f: DataFrame) -> DataFrame:
    """(folder, n_documents, signature) of (folder, doc_id, fingerprint): a hash of hashes, newest first, over blocks of a
    thousand neighbouring ids, so that no task gathers all fingerprints of a folder."""
    level = f.select("folder", F.floor(F.col("doc_id") / 1000).alias("up"), F.col("doc_id").alias("o"), F.lit(1).alias("n"), F.col("fingerprint").alias("s"))
    for last in (False, False, True):
        ordered = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("o", "s")))), lambda x: x["s"])
        keys = ["folder"] if last else ["folder", "up"]
        hashed = level.groupBy(*keys).agg(F.sum("n").cast("bigint").alias("n"), F.sha2(F.array_join(ordered, ""), 256).alias("s"))
        level = hashed if last else hashed.select("folder", F.floor(F.col("up") / 1000).alias("up"), F.col("up").alias("o"), "n", "s")
    return level.select("folder", F.col("n").alias("n_documents"), F.col("s").alias("signature"))


def _fingerprints(spark, sf) -> DataFrame:
    parts = F.concat_ws("|", F.col("doc_id").cast("string"), F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    return table(spark, sf, "documents").select("doc_id", "created_at", store.folder_of().alias("folder"), F.sha2(parts, 256).alias("fingerprint"))


@query(SIGNATURE_SQL.format(where="") + " select folder, n_documents, signature from g")
def index_signature(spark, sf):
    """The source signature of every folder's index (U1, A15): documents in descending order of their ids."""
    return _signatures(_fingerprints(spark, sf))


EARLIER = "created_at <= (select max(created_at) - interval 7 day from documents)"


@query(
    f"with old as ({SIGNATURE_SQL.format(where='where ' + EARLIER)} select folder, n_documents, signature from g), now as ({SIGNATURE_SQL.format(where='')} select folder, n_documents, signature from g) "
    "select now.folder, old.folder is not null as exists_, coalesce(old.signature = now.signature, false) as valid, coalesce(old.n_documents, 0) as node_count, now.n_documents as wanted from now left join old on old.folder = now.folder"
)
def index_status(spark, sf):
    """Which folders' indexes, built a week before the newest document, are still valid."""
    f = _fingerprints(spark, sf)
    built = f.agg(F.expr("max(created_at) - interval 7 days").alias("until"))  # one row
    old = _signatures(f.join(F.broadcast(built), F.col("created_at") <= F.col("until")).drop("until"))
    old = old.select("folder", F.col("n_documents").alias("node_count"), F.col("signature").alias("was"))
    joined = _signatures(f).join(old, "folder", "left")
    return joined.select(
        "folder", F.col("was").isNotNull().alias("exists_"), F.coalesce(F.col("was") == F.col("signature"), F.lit(False)).alias("valid"),
        F.coalesce("node_count", F.lit(0)).alias("node_count"), F.col("n_documents").alias("wanted"),
    )


@query("select doc_id, title, folder, source, cast(length(content) as bigint) as size from documents where doc_id = 1001")
def point_lookup(spark, sf):
    """One document by its id (A2); the filter reaches the scan."""
    return table(spark, sf, "documents").where("doc_id = 1001").select("doc_id", "title", "folder", "source", big(F.length("content")).alias("size"))


HEALTH_LISTS = ("missing_index", "missing_embeddings", "missing_summaries", "missing_summary_embeddings", "missing_sentence_index", "missing_sentence_embeddings", "stale_model")
NODES = "select document_id, count(*) n, count(embedding_json) e, {m} as has from {t} group by 1"


@query(
    f"with c as ({NODES.format(t='document_chunks', m="bool_or(embedding_model = 'lumen-embed-64')")}), s as ({NODES.format(t='sentence_nodes', m='null')}), m as ({NODES.format(t='document_summaries', m='null')}), "
    "x as (select doc_id, c.n is null as missing_index, coalesce(c.e < c.n, false) as missing_embeddings, m.n is null as missing_summaries, coalesce(m.e < m.n, false) as missing_summary_embeddings, "
    "s.n is null as missing_sentence_index, coalesce(s.e < s.n, false) as missing_sentence_embeddings, coalesce(not has, false) as stale_model from (select d.doc_id, 1 from documents d) d "
    "left join (select document_id, n, e, has from c) c on c.document_id = doc_id left join (select document_id, n, e from s) s on s.document_id = doc_id left join (select document_id, n, e from m) m on m.document_id = doc_id) "
    + " union all ".join(f"select doc_id, '{n}' as list from x where {n}" for n in HEALTH_LISTS)
)
def health_lists(spark, sf):
    """The documents on each list of missing or stale parts."""

    def nodes(t: str, name: str, *more) -> DataFrame:
        g = table(spark, sf, t).groupBy(F.col("document_id").alias("doc_id"))
        return g.agg(F.count("*").alias(f"{name}_n"), F.count("embedding_json").alias(f"{name}_e"), *more)

    model = F.bool_or(F.col("embedding_model") == "lumen-embed-64").alias("has")
    d = table(spark, sf, "documents").select("doc_id")
    for part in (nodes("document_chunks", "c", model), nodes("sentence_nodes", "s"), nodes("document_summaries", "m")):
        d = d.join(part, "doc_id", "left")
    gone, behind = lambda x: F.col(f"{x}_n").isNull(), lambda x: F.coalesce(F.col(f"{x}_e") < F.col(f"{x}_n"), F.lit(False))
    tests = [gone("c"), behind("c"), gone("m"), behind("m"), gone("s"), behind("s"), F.coalesce(~F.col("has"), F.lit(False))]
    lists = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in zip(HEALTH_LISTS, tests)]))
    return d.select("doc_id", F.explode(lists).alias("list"))


@query(
    "with have as (select distinct sha1(sentence) as h, embedding_model from sentence_nodes where embedding_json is not null and sentence is not null) "
    "select c.id, sha1(c.content) as content_hash, c.embedding_model from document_chunks c where c.content is not null and not exists (select 1 from have where h = sha1(c.content) and have.embedding_model = c.embedding_model)"
)
def cache_misses(spark, sf):
    """Chunks whose text and model no cached vector has (C12, A16): an anti join on the text's hash."""
    have = table(spark, sf, "sentence_nodes").where("embedding_json is not null and sentence is not null").select(F.sha1("sentence").alias("content_hash"), "embedding_model")
    c = table(spark, sf, "document_chunks").where("content is not null").select("id", F.sha1("content").alias("content_hash"), "embedding_model")
    return c.join(have.distinct(), ["content_hash", "embedding_model"], "left_anti").select("id", "content_hash", "embedding_model")


@query(
    "select doc_id, unnest(list_distinct(case when n <= 12 then range(n) else list_transform(range(12), lambda i: cast(round_even(i * (n - 1) / 11.0, 0) as bigint)) end)) as position from (select document_id as doc_id, count(*) as n from document_chunks where document_id is not null group by 1)"
)
def sampled_sections(spark, sf):
    """At most twelve evenly spaced sections of every document."""
    n = table(spark, sf, "document_chunks").where("document_id is not null").groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").cast("int").alias("n"))
    return n.select("doc_id", F.explode(text.even_positions(F.col("n"), 12).cast("array<bigint>")).alias("position"))


@query("select id, cast(case when status = 'new' then 1.2 else 0.9 end as double) as weight, created_at from questions where guidance is not null order by weight desc, created_at desc, id desc limit 12")
def memory_order(spark, sf):
    """The first twelve notes by weight, then age (F2, Q5), a top-k report."""
    q = table(spark, sf, "questions").where("guidance is not null")
    w = F.when(F.col("status") == "new", F.lit(1.2)).otherwise(F.lit(0.9))
    return q.select("id", w.alias("weight"), "created_at").orderBy(F.desc("weight"), F.desc("created_at"), F.desc("id")).limit(12)


@query(" union all ".join(f"select '{t}' as table_name, cast(0 as bigint) as n" if t in EMBEDDED else f"select '{t}' as table_name, count(*) as n from {t}" for t in COUNTED))
def truncated_nodes(spark, sf):
    """Rows of every table after the node tables were emptied (H11, H1): frames of the same schema without rows."""
    out = None
    for t in COUNTED:
        rows = table(spark, sf, t)
        kept = spark.createDataFrame([], rows.schema) if t in EMBEDDED else rows
        one = kept.agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("select id, cast(to_json({'id': id, 'title': title}) as varchar) as encoded from questions where title is not null")
def json_encoded(spark, sf):
    """Questions as JSON objects, other scripts kept as they are (M1)."""
    q = table(spark, sf, "questions").where("title is not null")
    return q.select("id", F.to_json(F.struct("id", "title")).alias("encoded"))


@query("select event_type, cast(date_trunc('hour', ts) as timestamp) as hour, count(*) as n, cast(round(avg(value), 4) as double) as mean_value, cast(max(user_id) as bigint) as last_user from events group by 1, 2")
def trace_hours(spark, sf):
    """Traces by mode and hour: the batch form of the streaming statistics."""
    e = table(spark, sf, "events")
    g = e.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
    return g.agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"), F.max("user_id").cast("bigint").alias("last_user"))


