"""Text functions, chunkers and corpus analytics over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions import text
from quernstone.operators import chunking
from quernstone.session import big, spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: White space as RE2 writes it.
B = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{B}+|{B}+$', '', 'g')"


def collapse_sql(c: str) -> str:
    return f"regexp_replace({c}, '{B}+', ' ', 'g')"


LINES = "regexp_replace(x, '\\n{3,}', chr(10) || chr(10), 'g')".replace("\\n", "\n")


@query(f"select doc_id, {collapse_sql(strip_sql('content'))} as flat, cast(length(content) as bigint) as n_before from documents where content is not null")
def collapse_whitespace(spark, sf):
    """Contents with every run of white space as one blank."""
    d = table(spark, sf, "documents").where("content is not null")
    return d.select("doc_id", text.collapse(text.strip(F.col("content"))).alias("flat"), big(F.length("content")).alias("n_before"))


@query(
    f"select doc_id, pos, sentence from (select doc_id, unnest(range(1, len(s) + 1)) as pos, unnest(s) as sentence from (select doc_id, list_filter(list_transform(string_split_regex(content, '[。！？!?]{B}*'), "
    f"lambda p: {strip_sql('p')}), lambda p: p <> '') as s from documents where content is not null))".replace(B + "*", r"\s*", 1)
)
def sentence_split_plain(spark, sf):
    """Sentences of every content without their end marks."""
    d = spread(table(spark, sf, "documents").where("content is not null").select("doc_id", "content"))
    each = d.select("doc_id", F.posexplode(text.sentences_plain(F.col("content"))).alias("p", "sentence"))
    return each.select("doc_id", (F.col("p") + 1).cast("bigint").alias("pos"), "sentence")


def kept_sql(c: str, point: bool = True) -> str:
    """Sentences with their end marks as a list: the ends are marked first, since RE2 has no look-behind."""
    ends = "'([。！？!?；;])\\s*|(\\.)\\s+', '\\1\\2' || chr(1)" if point else "'([。！？!?；;])\\s*', '\\1' || chr(1)"
    return f"list_filter(list_transform(string_split(regexp_replace({c}, {ends}, 'g'), chr(1)), lambda p: {strip_sql('p')}), lambda p: p <> '')"


@query(
    f"select doc_id, unnest(range(1, len(s) + 1)) as pos, unnest(s) as sentence from (select doc_id, {kept_sql(strip_sql(collapse_sql('content')))} as s from documents where content is not null)"
)
def sentence_split_kept(spark, sf):
    """Sentences of every content with their end marks."""
    d = spread(table(spark, sf, "documents").where("content is not null").select("doc_id", "content"))
    each = d.select("doc_id", F.posexplode(text.sentences_kept(F.col("content"))).alias("p", "sentence"))
    return each.select("doc_id", (F.col("p") + 1).cast("bigint").alias("pos"), "sentence")


@query(f"select doc_id, cast(length(text) as bigint) as chars, cast(len({kept_sql('text', False)}) as bigint) as n_sentences from documents where text is not null")
def profile_lines(spark, sf):
    """Characters and spoken sentences of every text."""
    d = spread(table(spark, sf, "documents").where("text is not null").select("doc_id", "text"))
    return d.select("doc_id", big(F.length("text")).alias("chars"), big(F.size(text.sentences_spoken(F.col("text")))).alias("n_sentences"))


WORDS = "regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9_]+|[\\x{{4e00}}-\\x{{9fff}}]')"


def tokens_sql(c: str) -> str:
    pairs = f"list_filter(list_transform(range(1, greatest(length({c}), 1)), lambda i: substring(lower({c}), i, 2)), lambda b: not contains(b, chr(10)) and length(b) = 2)"
    return f"list_concat({WORDS.format(c=c)}, {pairs})"


@query(f"select token, count(*) as tf, count(distinct id) as df from (select id, unnest({WORDS.format(c='content')}) as token from document_chunks) group by token")
def token_statistics(spark, sf):
    """Term and document frequencies of the chunks' words."""
    c = spread(table(spark, sf, "document_chunks").select("id", "content"))
    per_chunk = c.select("id", F.explode(text.words(F.coalesce("content", F.lit("")))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("n"))
    return per_chunk.groupBy("token").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


@query(f"select id, token, count(*) as tf from (select id, unnest({tokens_sql('title')}) as token from questions where title is not null) group by 1, 2")
def tokens_tf(spark, sf):
    """Token counts of every question's title: words, Han characters and pairs of characters."""
    q = spread(table(spark, sf, "questions").where("title is not null").select("id", "title"))
    return q.select("id", F.explode(text.tokens(F.col("title"))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))


STOP = ", ".join(f"'{t}'" for t in text.STOP_TERMS)


@query(
    f"select distinct id, token from (select id, unnest({tokens_sql('title')}) as token from questions where title is not null) where length(token) >= 2 and not regexp_full_match(token, '[0-9]+') and token not in ({STOP})"
)
def query_terms(spark, sf):
    """Terms of every title for exact matches."""
    q = spread(table(spark, sf, "questions").where("title is not null").select("id", "title"))
    return q.select("id", F.explode(text.query_terms(F.col("title"))).alias("token"))


NOISE_SQL = (
    r"select doc_id, line, regexp_matches(line, '(?i)QQ\s*[0-9]{5,}') or (length(line) >= 4 and length(regexp_replace(line, '[^\x{4e00}-\x{9fff}A-Za-z0-9]', '', 'g')) / greatest(length(line), 1) < 0.35) as noise "
    r"from (select doc_id, unnest(string_split(content, chr(10))) as line from documents where content is not null)"
)


@query(f"select doc_id, count(*) as n_lines, cast(count(case when noise then 1 end) as bigint) as n_noise from ({NOISE_SQL}) group by doc_id")
def noise_lines(spark, sf):
    """Noise lines of every content."""
    d = spread(table(spark, sf, "documents").where("content is not null").select("doc_id", "content"))
    lines = d.select("doc_id", F.explode(F.split("content", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(text.is_noise(F.col("line"))).alias("n_noise"))


@query(None)
def cleaned_text(spark, sf):
    """Extracted contents, tidied."""
    d = spread(table(spark, sf, "documents").where("content is not null").select("doc_id", "content"))
    return d.select("doc_id", text.clean_extracted(F.col("content")).alias("content"))


@query(
    r"select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}', '[邮箱]', 'g'), '(?i)QQ[:：]?\s*[0-9]{5,12}', 'QQ：[账号]', 'g'), '小[\x{4e00}-\x{9fff}]', '小某', 'g') as masked from documents where text is not null"
)
def anonymise_simple(spark, sf):
    """The anonymiser's rules that need no look-around."""
    d = spread(table(spark, sf, "documents").where("text is not null").select("doc_id", "text"))
    return d.select("doc_id", text.mask_contacts(F.col("text")).alias("masked"))


@query(None)
def anonymise_full(spark, sf):
    """All rules of the anonymiser."""
    d = spread(table(spark, sf, "documents").where("text is not null").select("doc_id", "text"))
    return d.select("doc_id", text.anonymise(F.col("text")).alias("masked"))


FIT = (
    "case when length({c}) <= 1200 then {c} else substring(substring({c}, 1, 600) || chr(10) || chr(10) || '[... embedding input truncated: middle sample ...]' || chr(10) || chr(10) || "
    "substring({c}, cast(greatest(0, floor((length({c}) - 120) / 2)) as bigint) + 1, 120) || chr(10) || chr(10) || '[... embedding input truncated: tail sample ...]' || chr(10) || chr(10) || right({c}, 400), 1, 1200) end"
)


@query(f"select doc_id, {FIT.format(c='text')} as fitted from documents where text is not null")
def embedding_input_fit(spark, sf):
    """Texts cut to an embedding model's input (I27), here of 1,200 characters."""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", text.fit_input(F.col("text"), 1200).alias("fitted"))


FLAT = collapse_sql(strip_sql("coalesce(content, '')"))


@query(
    f"select doc_id, case when length(t) <= 900 then t else coalesce(title, '') || chr(10) || chr(10) || substring(t, 1, 450) || chr(10) || '...' || chr(10) || right(t, 450) end as summary from (select doc_id, title, {FLAT} as t from documents)"
)
def summary_legacy(spark, sf):
    """Head and tail summaries."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", text.head_tail_summary(F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))).alias("summary"))


@query(
    f"select 'summary-' || cast(doc_id as varchar) as node_id, doc_id, '标题：' || coalesce(title, '') || chr(10) || '文件夹：' || coalesce(folder, '默认') || chr(10) || '摘要候选文本：' || case when length(t) <= 1200 then t else "
    f"substring(t, 1, 400) || chr(10) || '...' || chr(10) || substring(t, cast(greatest(0, floor(length(t) / 2) - 200) as bigint) + 1, 400) || chr(10) || '...' || chr(10) || right(t, 400) end as text from (select *, {FLAT} as t from documents)"
)
def summary_nodes(spark, sf):
    """One routing node a document."""
    return chunking.summary_nodes(table(spark, sf, "documents"), "doc_id", "title", "folder", "content")


@query("select id, source_url, regexp_extract(source_url, '/question/([0-9]+)', 1) as question_ref, regexp_extract(source_url, '^https?://([^/]+)', 1) as host from questions where source_url is not null")
def url_ids(spark, sf):
    """Ids and hosts from question addresses."""
    q = table(spark, sf, "questions").where("source_url is not null")
    return q.select("id", "source_url", F.regexp_extract("source_url", "/question/([0-9]+)", 1).alias("question_ref"), F.regexp_extract("source_url", "^https?://([^/]+)", 1).alias("host"))


STRIPPED = "replace(replace(replace(replace(replace(replace(regexp_replace({c}, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')"


@query(
    f"select id, {collapse_sql('t')} as title from (select id, regexp_replace({strip_sql('t')}, '\\s*-\\s*知乎[^\\n]*$', '') as t from (select id, regexp_replace({strip_sql(STRIPPED.format(c='title'))}, "
    "'^\\([^)]*(私信|消息)[^)]*\\)\\s*', '') as t from questions where title is not null))"
)
def clean_titles(spark, sf):
    """Titles without markup, message counts and the site's name."""
    return table(spark, sf, "questions").where("title is not null").select("id", text.clean_title(F.col("title")).alias("title"))


@query(
    "select id, replace(replace(replace(replace(replace(replace(regexp_replace(description, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') as plain from questions where description is not null"
)
def html_strip_tags(spark, sf):
    """Descriptions without markup."""
    return table(spark, sf, "questions").where("description is not null").select("id", text.strip_tags(F.col("description")).alias("plain"))


MARKS = ", ".join(f"'{m}'" for m in text.BLOCK_MARKS)


@query(f"select id, title from questions where title is null or trim(title) = '' or len(list_filter([{MARKS}], lambda m: contains(title, m))) > 0")
def bad_titles(spark, sf):
    """Titles that are empty or speak of a blocked page."""
    t = F.col("title")
    bad = t.isNull() | (F.trim(t) == "")
    for m in text.BLOCK_MARKS:
        bad = bad | t.contains(m)
    return table(spark, sf, "questions").where(bad).select("id", "title")


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k, round(value, 4) as value from events")
def json_props(spark, sf):
    """Event properties decoded (M2)."""
    e = table(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.round("value", 4).alias("value"))


@query(
    "select id, pos, cast(json_extract(h, '$.document_id') as bigint) as document_id, cast(json_extract(h, '$.chunk_index') as bigint) as chunk_index, cast(json_extract(h, '$.score') as double) as score from "
    "(select id, unnest(range(cast(json_array_length(context_json) as bigint))) as pos, unnest(cast(json_extract(context_json, '$[*]') as json[])) as h from answers where context_json is not null)"
)
def context_hits(spark, sf):
    """The stored hits of every answer as rows (M2, JSON arrays)."""
    a = table(spark, sf, "answers").where("context_json is not null")
    hits = F.from_json("context_json", "array<struct<document_id: bigint, chunk_index: bigint, score: double>>")
    each = a.select("id", F.posexplode(hits).alias("p", "h"))
    return each.select("id", F.col("p").cast("bigint").alias("pos"), "h.*")


@query(
    "select doc_id, chunk_index, substring(t, chunk_index * 440 + 1, 520) as content from (select doc_id, t, unnest(range(case when length(t) <= 520 then 1 else cast(ceil((length(t) - 520) / 440.0) as bigint) + 1 end)) as chunk_index from "
    f"(select doc_id, regexp_replace({strip_sql("coalesce(content, '')")}, '\\n{{3,}}', chr(10) || chr(10), 'g') as t from documents))"
)
def chunks(spark, sf):
    """Fixed-size chunks of every content."""
    d = spread(table(spark, sf, "documents").select("doc_id", "content"))
    return chunking.chunks(d, "doc_id", "content").select("doc_id", big("chunk_index").alias("chunk_index"), "content")


SPANS = (
    "select doc_id, '{level}' as level, chunk_index, chunk_index * {size} as start_char, least(chunk_index * {size} + {size}, length(t)) as end_char, length(t) as n from (select doc_id, t, unnest(range(case when length(t) <= {size} then 1 else cast(ceil((length(t) - {size}) / {size}.0) as bigint) + 1 end)) as chunk_index from texts)"
)
HIERARCHY_SQL = (
    f"with texts as (select * from (select doc_id, regexp_replace({strip_sql("coalesce(content, '')")}, '\\n{{3,}}', chr(10) || chr(10), 'g') as t from documents) where length(t) > 0), "
    + ", ".join(f"l{i} as ({SPANS.format(level=i, size=s)})" for i, s in enumerate(chunking.HIERARCHY))
    + " select doc_id, 'L0:' || chunk_index as node_key, cast(start_char as bigint) as start_char, cast(end_char as bigint) as end_char, 'L1:' || cast(least(floor((start_char + end_char) / 2 / 800), greatest(1, ceil(n / 800.0)) - 1) as bigint) as parent_key from l0"
    + " union all select doc_id, 'L1:' || chunk_index, start_char, end_char, 'L2:' || cast(least(floor((start_char + end_char) / 2 / 2400), greatest(1, ceil(n / 2400.0)) - 1) as bigint) from l1"
    + " union all select doc_id, 'L2:' || chunk_index, start_char, end_char, null from l2"
)


@query(HIERARCHY_SQL)
def hierarchy_nodes(spark, sf):
    """Nodes of three sizes with their parents."""
    d = spread(table(spark, sf, "documents").select("doc_id", "content"))
    h = chunking.hierarchy(d, "doc_id", "content")
    return h.select("doc_id", "node_key", big("start_char").alias("start_char"), big("end_char").alias("end_char"), "parent_key")


@query(None)
def deposit_memories(spark, sf):
    """Lines of contents worth keeping, under their sections."""
    d = spread(table(spark, sf, "documents").where("content is not null").select("doc_id", "content"))
    return chunking.deposit_memories(d, "doc_id", "content")


MARKERS = ", ".join(f"'{m}'" for m in text.STYLE_MARKERS)


@query(
    f"select marker, cast(sum((length(draft) - length(replace(draft, marker, ''))) // length(marker)) as bigint) as n from (select draft, unnest([{MARKERS}]) as marker from answers where draft is not null) group by marker order by n desc, marker limit 12"
)
def marker_top12(spark, sf):
    """The twelve most frequent markers of style (D16), a top-k report."""
    a = spread(table(spark, sf, "answers").where("draft is not null").select("draft"))
    one = a.agg(*[F.sum(text.occurrences(F.col("draft"), m)).alias(m) for m in text.STYLE_MARKERS])
    rows = one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in text.STYLE_MARKERS]), F.array(*[F.col(m) for m in text.STYLE_MARKERS]))).alias("marker", "n"))
    return rows.orderBy(F.desc("n"), "marker").limit(12)


@query(
    f"select cast(count(*) as bigint) as n_sentences, round(avg(length(s)), 4) as mean_length, cast(median(length(s)) as double) as median_length from (select unnest({kept_sql('draft', False)}) as s from answers where draft is not null)"
)
def sentence_stats(spark, sf):
    """Number, mean and median length of the drafts' sentences."""
    a = spread(table(spark, sf, "answers").where("draft is not null").select("draft"))
    n = F.length(F.col("s"))
    each = a.select(F.explode(text.sentences_spoken(F.col("draft"))).alias("s"))
    return each.agg(F.count("*").alias("n_sentences"), F.round(F.avg(n), 4).alias("mean_length"), F.median(n).cast("double").alias("median_length"))


@query(
    "select cast(sum(length(draft) - length(replace(draft, '我', ''))) as bigint) as first_person, cast(sum(length(draft) - length(regexp_replace(draft, '[？?]', '', 'g'))) as bigint) as questions, "
    "cast(sum(length(draft) - length(regexp_replace(draft, '[！!]', '', 'g'))) as bigint) as exclamations, cast(sum(length(draft)) as bigint) as chars from answers where draft is not null"
)
def char_class_counts(spark, sf):
    """First persons, questions and exclamations in the drafts."""
    d = F.col("draft")
    n = lambda p: F.sum(F.length(d) - F.length(F.regexp_replace(d, p, ""))).cast("bigint")
    return table(spark, sf, "answers").where("draft is not null").agg(
        n("我").alias("first_person"), n("[？?]").alias("questions"), n("[！!]").alias("exclamations"), F.sum(F.length(d)).cast("bigint").alias("chars")
    )


@query(
    "select doc_id, case when n < 1024 then printf('%.1f B', n) when n < 1048576 then printf('%.1f KB', n / 1024) else printf('%.1f MB', n / 1048576) end as label from (select doc_id, cast(octet_length(encode(content)) as double) as n from documents where content is not null)"
)
def size_labels(spark, sf):
    """Sizes of contents for people to read."""
    return table(spark, sf, "documents").where("content is not null").select("doc_id", text.bytes_label(F.octet_length("content")).alias("label"))


@query(
    "select doc_id, pos, value from (select doc_id, unnest(range(1, len(l) + 1)) as pos, unnest(l) as line, unnest(list_transform(l, lambda x: "
    + strip_sql("regexp_replace(x, '^[^：]*：', '')")
    + ")) as value from (select doc_id, string_split(content, chr(10)) as l from documents where content is not null)) where contains(line, '：') and value <> ''"
)
def labelled_lines(spark, sf):
    """Lines with a label and something after it."""
    d = spread(table(spark, sf, "documents").where("content is not null").select("doc_id", "content"))
    lines = d.select("doc_id", F.posexplode(F.split("content", "\n")).alias("p", "line")).where(F.col("line").contains("："))
    return lines.select("doc_id", (F.col("p") + 1).cast("bigint").alias("pos"), text.after_label(F.col("line")).alias("value")).where("value != ''")


@query("select id, regexp_extract(draft, '“([^”]*)”', 1) as quoted from answers where regexp_matches(draft, '“[^”]*”')")
def quoted_parts(spark, sf):
    """What stands between the first pair of quotation marks."""
    a = table(spark, sf, "answers").where(F.col("draft").rlike("“[^”]*”"))
    return a.select("id", F.regexp_extract("draft", "“([^”]*)”", 1).alias("quoted"))


CODE = "try_cast(nullif(regexp_extract({c}, '(?:HTTP |^)([45][0-9][0-9])', 1), '') as integer)"


@query(
    f"select id, field_name, {CODE.format(c='t')} as code, case when {CODE.format(c='t')} = 403 then 'blocked' when {CODE.format(c='t')} is not null then 'http' when contains(lower(t), 'timeout') then 'timeout' when contains(lower(t), 'javascript') then 'script' else 'none' end as class "
    "from (select id, 'title' as field_name, title as t from questions union all select id, 'description', description from questions) where t is not null"
)
def notice_classes(spark, sf):
    """The number and class of an error that a field reports (I30, I31): the first rule that fits."""
    q = table(spark, sf, "questions")
    fields = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("t")) for c in ("title", "description")])
    f = q.select("id", F.explode(fields).alias("f")).select("id", "f.*").where("t is not null")
    code = F.nullif(F.regexp_extract("t", "(?:HTTP |^)([45][0-9][0-9])", 1), F.lit("")).try_cast("int")
    low = F.lower("t")
    kind = F.when(code == 403, "blocked").when(code.isNotNull(), "http").when(low.contains("timeout"), "timeout").when(low.contains("javascript"), "script")
    return f.select("id", "field_name", code.alias("code"), kind.otherwise("none").alias("class"))


LIST = f"list_filter(list_transform(string_split_regex(coalesce(tags, ''), '[,，、;；]'), lambda x: {strip_sql('x')}), lambda x: x <> '')"


@query(f"select id, array_to_string({LIST}[1:5], '|') as first_five, cast(len({LIST}) as bigint) as n, coalesce({LIST}[2], '') as second from questions")
def tag_lists(spark, sf):
    """Lists normalised to trimmed values that aren't blank, their first five and a selected one."""
    v = F.filter(F.transform(F.split(F.coalesce("tags", F.lit("")), "[,，、;；]"), text.strip), lambda x: F.length(x) > 0)
    q = spread(table(spark, sf, "questions").select("id", "tags")).select("id", v.alias("v"))
    return q.select("id", F.array_join(F.slice("v", 1, 5), "|").alias("first_five"), big(F.size("v")).alias("n"), F.coalesce(F.get("v", F.lit(1)), F.lit("")).alias("second"))
