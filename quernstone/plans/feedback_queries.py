"""Feedback and evaluation analytics with their SQL."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F

from quernstone.functions import text
from quernstone.plans.text_queries import strip_sql
from quernstone.session import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Notes on an edit, fixed values.
NOTES = [
    "人工终稿明显更克制，后续生成应减少铺陈和重复。", "人工终稿补充了更多解释，后续生成可以增加背景推理和例子。", "人工终稿保留不确定性表达，后续应避免绝对判断。",
    "人工终稿强调专业求助边界，后续心理类回答需保留安全提示。", "人工修改幅度较小，可把终稿作为相近风格样本。",
]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _edits(spark, sf):
    return table(spark, sf, "answers").where("draft is not null and edited is not null").select("id", "draft", "edited")


@query(
    f"with e as (select id, length(draft) as d, length(edited) as n, edited from answers where draft is not null and edited is not null), r as (select id, d, n, list_filter([case when n < d * 0.85 then '{NOTES[0]}' end, case when n > d * 1.15 then '{NOTES[1]}' end, "
    f"case when contains(edited, '也许') or contains(edited, '可能') then '{NOTES[2]}' end, case when contains(edited, '建议') and contains(edited, '专业') then '{NOTES[3]}' end], lambda x: x is not null) as notes from e) "
    f"select id, cast(d as bigint) as draft_length, cast(n as bigint) as edited_length, case when len(notes) = 0 then '{NOTES[4]}' else array_to_string(notes, '|') end as notes from r"
)
def edit_lengths_and_notes(spark, sf):
    """Lengths and style notes of every edit (Q2)."""
    d, n, e = F.length("draft"), F.length("edited"), F.col("edited")
    notes = F.array_compact(
        F.array(
            F.when(n < d * 0.85, NOTES[0]), F.when(n > d * 1.15, NOTES[1]), F.when(e.contains("也许") | e.contains("可能"), NOTES[2]),
            F.when(e.contains("建议") & e.contains("专业"), NOTES[3]),
        )
    )
    joined = F.when(F.size(notes) == 0, F.lit(NOTES[4])).otherwise(F.array_join(notes, "|"))
    return _edits(spark, sf).select("id", d.cast("bigint").alias("draft_length"), n.cast("bigint").alias("edited_length"), joined.alias("notes"))


def sents_sql(c: str) -> str:
    return f"list_filter(list_transform(string_split_regex({c}, '[。！？!?]\\s*'), lambda p: {strip_sql('p')}), lambda p: p <> '')"


@query(
    f"select id, unnest(range(1, len(s) + 1)) as pos, unnest(s) as sentence from (select id, list_filter({sents_sql('edited')}, lambda x: not list_contains({sents_sql('draft')}, x) and length(x) >= 8) as s from answers where draft is not null and edited is not null)"
)
def added_sentences(spark, sf):
    """Sentences of the edit that the draft lacks."""
    e = _edits(spark, sf).select("id", text.sentences_plain(F.col("draft")).alias("d"), text.sentences_plain(F.col("edited")).alias("e"))
    added = F.filter("e", lambda x: ~F.array_contains(F.col("d"), x) & (F.length(x) >= 8))
    return e.select("id", F.posexplode(added).alias("p", "sentence")).select("id", (F.col("p") + 1).cast("bigint").alias("pos"), "sentence")


@query(None)
def edit_ratio(spark, sf):
    """Share of every draft that its edit changed (Q1, J10); the matcher's junk rule has no SQL form."""

    @F.pandas_udf("double")
    def changed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for drafts, edits in batches:
            yield pd.Series([round(1 - SequenceMatcher(None, a, b).ratio(), 3) for a, b in zip(drafts, edits)], dtype=float)

    return spread(_edits(spark, sf)).select("id", changed("draft", "edited").alias("change_ratio"))


@query(
    "with s as (select question_id, id, draft from answers where draft is not null), q as (select document_id, summary from document_summaries where summary is not null and length(summary) >= 8), "
    "p as (select c.document_id, c.id, c.content from document_chunks c where c.content is not null) "
    "select q.document_id, count(*) as required, cast(count(case when contains(p.content, q.summary) then 1 end) as bigint) as matched from q join p on p.document_id = q.document_id group by 1"
)
def quote_fidelity(spark, sf):
    """How many of a document's chunks hold its summary word for word (P5)."""
    q = table(spark, sf, "document_summaries").where("length(summary) >= 8").select("document_id", "summary")
    p = table(spark, sf, "document_chunks").where("content is not null").select("document_id", "content")
    return p.join(q, "document_id").groupBy("document_id").agg(F.count("*").alias("required"), F.count_if(F.contains("content", "summary")).alias("matched"))


@query(
    "with h as (select id, max(cast(json_extract(x, '$.score') as double)) as best, min(cast(json_extract(x, '$.score') as double)) as worst from (select id, unnest(cast(json_extract(context_json, '$[*]') as json[])) as x from answers where context_json is not null) group by id) "
    "select id, case when best < 0.65 then case when best < 0.45 then 'rerun_intent:high' else 'rerun_intent:medium' end else 'none' end as answer_action, case when worst < 0.65 then case when worst < 0.45 then 'improve_retrieval:high' else 'improve_retrieval:medium' end else 'none' end as context_action from h"
)
def triad_actions(spark, sf):
    """Next actions from low scores (D22, Q3): below 0.65 one is due, below 0.45 with high priority."""
    hits = F.from_json("context_json", "array<struct<document_id: bigint, chunk_index: bigint, score: double>>")
    a = table(spark, sf, "answers").where("context_json is not null").select("id", F.explode(hits).alias("h"))
    g = a.groupBy("id").agg(F.max("h.score").alias("best"), F.min("h.score").alias("worst"))
    act = lambda c, n: F.when(F.col(c) < 0.45, f"{n}:high").when(F.col(c) < 0.65, f"{n}:medium").otherwise("none")
    return g.select("id", act("best", "rerun_intent").alias("answer_action"), act("worst", "improve_retrieval").alias("context_action"))


@query(
    "select question_id, string_agg('- ' || substring(draft, 1, 60), chr(10) order by updated_at desc nulls last, id desc) as block from (select *, row_number() over (partition by question_id order by updated_at desc nulls last, id desc) r from answers where draft is not null and question_id is not null) where r <= 12 group by 1"
)
def memory_block(spark, sf):
    """The twelve latest notes of each question as bullets (F2, Q6)."""
    from quernstone.operators.retrieval import top_k

    a = table(spark, sf, "answers").where("draft is not null and question_id is not null").select("question_id", "id", "updated_at", F.substring("draft", 1, 60).alias("line"))
    top = top_k(a, ["question_id"], [F.desc_nulls_last("updated_at"), F.desc("id")], 12)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda s: F.concat(F.lit("- "), s["line"]))
    return top.groupBy("question_id").agg(F.array_join(lines, "\n").alias("block"))


PART = "nullif({}, '')"


@query(f"select id, concat_ws('；', {', '.join(PART.format(strip_sql(c)) for c in ('title', 'guidance', 'tags'))}) as channel_query from questions")
def channel_queries(spark, sf):
    """One query text from a question's non-empty parts."""
    part = lambda c: F.nullif(text.strip(F.col(c)), F.lit(""))
    return table(spark, sf, "questions").select("id", F.concat_ws("；", part("title"), part("guidance"), part("tags")).alias("channel_query"))


@query(None)
def lenient_feedback(spark, sf):
    """Feedback objects found alone or amid prose (M3)."""
    a = table(spark, sf, "answers").where("feedback_json is not null")
    return a.select("id", text.lenient_object(F.concat(F.lit("见："), "feedback_json", F.lit("。"))).alias("object"))
