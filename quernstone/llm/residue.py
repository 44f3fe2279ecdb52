"""Problem 6: template residue, filler, error pages and script notices instead of a person's text.

Placeholders are found by their delimiters.  Forms that nothing but templates use decide alone; for square, lenticular
and angle brackets the name inside decides: it must be a name that the corpus uses in one of the sure forms, or one of
a few general names.

Filler and notices are found by character n-gram models of filler, of error and script notices, and of natural prose.
The first fit of the two residue models takes fields that consist of seed phrases, of one repeated string or of words
far rarer in prose; the second takes the fields that the first fit finds.  Each character has a log-likelihood
ratio of residue against prose; windows of positive mean ratio are residue, and a field is excluded by how much of it
such windows cover, so that a real question that quotes a notice stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.ngram import Model, codes, count_labels, fit, hashes
from quernstone.session import cut

#: Share of a field's letters and digits that residue windows must cover.
COVERAGE = 0.6
WINDOW = 9
#: How many times rarer in prose than in fields a word of filler is, and how likely prose may hold a field of such words.
RARER = 5
CHANCE = 1e-3
#: Seed phrases, fixed values: well-known filler and notices.
FILLER = [
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua",
    "ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat",
    "lorem ipsum", "asdf", "asdfghjkl", "qwer", "qwerty", "zxcv", "hjkl", "foo bar", "foo", "bar", "test", "testing", "xxx", "todo", "tbd", "blah", "blindtext",
    "sample text", "dummy text", "placeholder", "texto de ejemplo", "texte exemple", "faux texte", "beispieltext", "untitled", "text",
    "测试", "示例标题", "示例文本", "示例", "此处填写描述", "此处填写", "占位", "占位符", "占位文字", "文字", "标题", "内容", "描述", "待补充", "稍后补充", "稍后替换", "这里是占位文字", "暂无内容", "啊啊啊", "ダミーテキスト", "サンプル", "テスト",
]
NOTICES = [
    "404 not found", "403 forbidden", "not found", "502 bad gateway", "bad gateway", "503 service unavailable", "service unavailable", "internal server error",
    "504 gateway timeout", "gateway timeout", "too many requests", "access denied", "page not found", "this page is gone", "page is gone", "the page could not be served", "upstream timed out", "error", "http",
    "please enable javascript", "enable javascript", "this page needs javascript", "turn scripts on and reload", "you need to enable scripts to run this app", "noscript", "content hidden until scripts are allowed",
    "页面不存在", "服务器开小差了", "服务器错误", "服务器繁忙", "访问过于频繁", "请稍后再试", "请稍后重试", "秒后再试", "出错了", "该内容已被删除或暂时无法查看", "代码", "安全验证", "请拖动滑块完成拼图", "系统维护中",
    "请启用 javascript 后继续访问", "您的浏览器禁用了脚本", "部分功能无法显示", "浏览器版本过低", "脚本未开启", "请更换后重试", "veuillez activer javascript pour continuer", "erreur", "page introuvable",
    "bitte schalten sie javascript ein, um diese seite zu sehen", "für diese anwendung werden skripte benötigt", "fehler", "seite nicht gefunden", "active javascript para continuar", "active las secuencias de comandos para ver el contenido", "página no encontrada",
    "このページを表示するにはスクリプトを有効にしてください", "ページが見つかりません",
]
#: General names of fields in templates, fixed values.
NAMES = [
    "name", "user_name", "username", "first_name", "last_name", "title", "topic", "city", "age", "relation", "date", "company", "question_text", "your question here", "insert topic", "insert text",
    "姓名", "姓名占位", "城市", "年龄", "关系", "标题", "问题标题", "咨询主题", "用户昵称", "请输入问题", "请输入", "在此填写标题", "此处填写",
]
SURE = (
    r"\{\{\s*([^{}\n]{1,60}?)\s*\}\}|[$#]\{\s*([^{}\n]{1,60}?)\s*\}|<%=?\s*([^%\n]{1,60}?)\s*%>|(?<![{$#])\{\s*([^{}\n]{1,60}?)\s*\}"
    r"|(?<![\p{N}%])%([\p{L}_][\p{L}\p{N}_ ]{0,40})%|(?<![A-Za-z0-9_])__([\p{L}\p{N}][\p{L}\p{N}_ ]{0,40}?)__(?![A-Za-z0-9_])"
)
UNSURE = r"\[\s*([^\[\]\n]{1,40}?)\s*\]|【\s*([^【】\n]{1,40}?)\s*】|<\s*([^<>\n/]{1,40}?)\s*>"
_seeds = regex.compile("|".join(regex.escape(s) for s in sorted(FILLER + NOTICES, key=len, reverse=True)), regex.IGNORECASE)
_filler_seed = regex.compile("|".join(regex.escape(s) for s in sorted(FILLER, key=len, reverse=True)), regex.IGNORECASE)
_seed_texts = sorted({s.casefold() for s in FILLER + NOTICES}, key=len)
_seed_texts = [s for i, s in enumerate(_seed_texts) if not any(x in s for x in _seed_texts[:i])]
_dotless = regex.compile("[\u0130\u0131]")
_letters = regex.compile(r"[\p{L}\p{N}]")
_four_letters = regex.compile(r"(?:[^\p{L}\p{N}]*+[\p{L}\p{N}]){4}")
_repeat = regex.compile(r"^\W*(.{1,12}?)(?:\W*\1){3,}\W*.{0,3}$", regex.DOTALL)


#: Patterns of the helpers below.
_any_letter = regex.compile(r"\p{L}")
_digits = regex.compile(r"\p{N}+")


def _names(pattern: str, text: F.Column) -> F.Column:
    """The names inside all spans of ``pattern``, lower case, numbers as 9."""
    groups = pattern.count("]{1,60}?") + pattern.count("]{1,40}?") + pattern.count("]{0,40}")
    spans = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = lambda s: F.concat_ws("", *[F.coalesce(F.regexp_extract(s, pattern, i + 1), F.lit("")) for i in range(groups)])
    return F.transform(spans, lambda s: F.regexp_replace(F.lower(inner(s)), r"\p{N}+", "9"))


def fields(questions: DataFrame, key: str = "id", columns: tuple[str, ...] = ("title", "description")) -> DataFrame:
    """(question_id, field_name, text): one row per field that isn't null."""
    rows = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(f"`{c}`").alias("text")) for c in columns])
    return questions.select(F.col(f"`{key}`").alias("question_id"), F.explode(rows).alias("f")).select("question_id", "f.*").where("text is not null")


def placeholders(rows: DataFrame) -> DataFrame:
    """(question_id, field_name) of the fields with an unfilled placeholder anywhere."""
    with_sure = rows.where(F.col("text").rlike(SURE))
    known = with_sure.select(F.explode(_names(SURE, F.col("text"))).alias("name")).where("length(trim(name)) > 0").distinct()
    general = rows.sparkSession.createDataFrame([(n,) for n in NAMES], "name string")
    unsure = rows.where(F.col("text").rlike(UNSURE)).select("question_id", "field_name", F.explode(_names(UNSURE, F.col("text"))).alias("name"))
    named = unsure.join(known.union(general).distinct(), "name", "left_semi")
    return with_sure.select("question_id", "field_name").union(named.select("question_id", "field_name")).distinct()


def seed_label(text: str) -> str | None:
    """'filler' or 'notice' where seed phrases or one repeated string make up most of the text."""
    if not _letters.search(text):
        return None
    if _four_letters.match(text) and _repeat.match(text.strip()):
        return "filler"
    folded = text.casefold()
    # most fields hold no seed phrase at all; the dotless i is folded by the pattern only
    if not any(x in folded for x in _seed_texts) and not _dotless.search(text):
        return None
    found = [m.group() for m in _seeds.finditer(text)]
    # digits belong to whatever they stand beside
    words = len(_any_letter.findall(text))
    covered = sum(len(_any_letter.findall(f)) for f in found)
    if words == 0 or covered < 0.7 * words:
        return None
    own = sum(len(_any_letter.findall(f)) for f in found if _filler_seed.fullmatch(f))
    return "filler" if own * 2 >= covered else "notice"


def _bootstrap(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """``rows`` with a first label: 'filler', 'notice' or 'prose'."""

    @F.pandas_udf("string")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            known = {t: seed_label(t) for t in dict.fromkeys(texts)}
            yield pd.Series([known[t] for t in texts], dtype=object)

    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{IsLatin}]{2,}|[a-z;]{4,}"), F.lit(0)))
    # a word is odd if it is far commoner in fields than in prose, whatever the sizes of both
    asked, said = rows.select("text").distinct(), corpus.select("text").distinct()
    both = asked.select("text", F.lit(1).alias("asked"), F.lit(0).alias("said")).union(said.select("text", F.lit(0), F.lit(1)))
    counts = both.select(F.explode(words(F.col("text"))).alias("w"), "asked", "said").groupBy("w").agg(F.sum("asked").alias("asked"), F.sum("said").alias("said"))
    counts = cut(counts)
    n_asked, n_said = asked.count(), said.count()
    # the chance that prose continues with an unseen word (Good-Turing): prose of few words says nothing about short fields
    prose = counts.agg(F.count_if(F.col("said") == 1).alias("once"), F.coalesce(F.sum("said"), F.lit(0)).alias("all")).first()
    unseen = (prose["once"] + 1) / (prose["all"] + 1)
    is_odd = F.lit(RARER * n_asked) * F.col("said") <= F.lit(n_said) * F.col("asked")
    own = rows.select("question_id", "field_name", F.explode(words(F.col("text"))).alias("w"))
    odd = own.join(counts, "w").groupBy("question_id", "field_name").agg(F.count_if(is_odd).alias("odd"), F.count("*").alias("all"))
    odd = odd.where((F.col("odd") >= 2) & (F.col("odd") >= 0.8 * F.col("all")) & (F.col("odd") * np.log(unseen) < np.log(CHANCE)))
    odd = odd.select("question_id", "field_name", F.lit(True).alias("odd"))
    mostly = F.length(F.regexp_replace("text", r"[^\p{IsLatin}; ]", "")) >= 0.8 * F.length("text")
    told = F.lower("text").rlike("|".join(regex.escape(s) for s in NOTICES))  # such fields teach what stands around notices
    out = rows.withColumn("seeded", label("text")).join(odd, ["question_id", "field_name"], "left")
    return out.select(
        "question_id", "field_name", "text",
        F.coalesce("seeded", F.when(F.col("odd") & mostly, F.when(told, F.lit("notice")).otherwise(F.lit("filler"))), F.lit("prose")).alias("label"),
    )


def _plain(text: str) -> str:
    return _digits.sub("0", text.lower())


_KEYS = np.frombuffer("asdfghjkl;qwertyuiopzxcvbnm ".encode("utf-32-le"), dtype=np.uint32)


def _alphanumeric(char: np.ndarray) -> np.ndarray:
    """str.isalnum of each code point."""
    few, at = np.unique(char, return_inverse=True)
    return np.array([chr(x).isalnum() for x in few.tolist()], dtype=bool)[at]


class Detector:
    """Coverage of a text by windows in which residue is likelier than prose."""

    def __init__(self, models: dict[str, Model]):
        self.models = models

    def coverage(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(share covered, whether notices explain the residue better than filler) of each text."""
        share, notice = np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        # equal texts are scored once
        place, plain = pd.factorize(np.array([_plain(t) for t in texts], dtype=object))
        kept = np.array([i for i, t in enumerate(plain) if t], dtype=np.int64)
        if not len(kept) or "prose" not in self.models:
            return share, notice
        own_share, own_notice = np.zeros(len(plain)), np.zeros(len(plain), dtype=bool)
        own_share[kept], own_notice[kept] = self._coverage([plain[i] for i in kept])
        return own_share[place], own_notice[place]

    def _coverage(self, plain: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of texts that aren't empty, all in one array."""
        c, begin = codes(plain)
        h = hashes(c)
        size = np.array([len(t) for t in plain], dtype=np.int64)
        first = np.cumsum(size) - size
        own = np.arange(int(size.sum())) + np.repeat(begin - 2 - first, size)  # without the starts and ends
        char = c[2:][own].astype(np.int64)
        prose = self.models["prose"].logp(c, h)[own]
        letters = _alphanumeric(char)
        covered = np.zeros(len(char), dtype=bool)
        left = np.repeat(first + size, size) - np.arange(len(char))
        sums = []
        for name in ("filler", "notice"):
            if (m := self.models.get(name)) is None:
                ratio = np.full(len(prose), -9.0)
            else:
                logp = m.logp(c, h)[own]
                if name == "filler":  # keys struck at random: letters of one row of the keyboard are equally likely
                    logp = np.logaddexp(logp + np.log(0.8), np.where(np.isin(char, _KEYS), np.log(0.2 / 28), -20))
                ratio = np.clip(logp - prose, -6, 6)
            sums.append(np.add.reduceat(ratio, first))
            mean = np.zeros(len(ratio))
            for k in range(min(WINDOW, len(ratio))):
                mean[: len(ratio) - k] += ratio[k:] * (1 / WINDOW)
            begins = np.nonzero((mean > 0) & (left >= WINDOW))[0]
            inside = np.zeros(len(ratio) + 1, dtype=np.int64)
            inside[begins] += 1
            inside[begins + WINDOW] -= 1
            covered |= np.cumsum(inside)[:-1] > 0
            covered |= np.repeat((size < WINDOW) & (sums[-1] > 0), size)  # a short text is one window
        n = np.add.reduceat(letters.astype(np.int64), first)
        # as a whole the field must be likelier as residue too
        share = np.where(np.maximum(*sums) > 0, np.add.reduceat((covered & letters).astype(np.int64), first) / np.maximum(n, 1), 0)
        return share, (sums[1] > sums[0]) & (n > 0)


def _scored(rows: DataFrame, models: dict[str, Model], then: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = Detector(shared.value)
        for b in batches:
            share, notice = detector.coverage(b["text"].tolist())
            b = b.assign(coverage=share)
            b[then] = np.where(share >= COVERAGE, np.where(notice, "notice", "filler"), "prose")
            yield b[["question_id", "field_name", "text", "coverage", then]]

    return rows.select("question_id", "field_name", "text").mapInPandas(
        score, f"question_id bigint, field_name string, text string, coverage double, {then} string"
    )


def residue(questions: DataFrame, corpus: DataFrame, wanted: tuple[str, ...] = ("title", "description")) -> DataFrame:
    """(question_id, field_name, kind, coverage) of the fields to exclude; kind is 'placeholder', 'filler' or 'notice'.

    ``corpus`` holds further natural prose in a column ``text``.  Null fields are no rows and blank fields no cases;
    repeated rows come out as often as they occur; an empty table gives an empty result; long fields are read whole;
    further columns don't take part.  Only fields of ``wanted`` names come out; all of them teach the models."""
    rows = cut(fields(questions))
    corpus = corpus.where("text is not null").select("text")
    is_wanted = F.col("field_name").isin(*wanted)
    template = placeholders(rows).where(is_wanted).withColumn("template", F.lit(True))
    seeded = _bootstrap(rows, corpus)
    number = lambda c: F.regexp_replace(F.lower(c), r"\p{N}+", "0")
    extra = {"filler": [_plain(s) for s in FILLER] * 3, "notice": [_plain(s) for s in NOTICES] * 3}
    prose = count_labels(corpus.select(F.lit("prose").alias("label"), number(F.col("text")).alias("text")))  # once for both fits

    def fitted(labelled: DataFrame) -> dict[str, Model]:
        own = count_labels(labelled.select("label", number(F.col("text")).alias("text")))
        for label, tables in prose.items():
            own[label] = [x + y for x, y in zip(own[label], tables)] if label in own else tables
        return fit(own, extra)

    first = fitted(seeded)
    second = fitted(_scored(rows, first, "label"))
    final = _scored(rows.where(is_wanted), second, "kind").join(template, ["question_id", "field_name"], "left")
    kind = F.when(F.col("template"), F.lit("placeholder")).otherwise(F.col("kind"))
    return final.select("question_id", "field_name", kind.alias("kind"), F.round("coverage", 4).alias("coverage")).where("kind != 'prose'")
