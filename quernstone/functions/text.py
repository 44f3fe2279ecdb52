"""Text functions as column expressions; all stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\u0085   -     　]"
HAN = r"\x{4e00}-\x{9fff}"
#: Terms that carry no meaning for exact matches, fixed values.
STOP_TERMS = [
    "这个", "问题", "回答", "什么", "怎么", "应该", "可以", "需要", "不要", "不是", "没有", "以及", "对于", "如果", "时候", "读者", "情绪", "角度", "检索", "知识", "片段", "内容",
]
#: Markers of spoken style, fixed values.
STYLE_MARKERS = [
    "我觉得", "我感觉", "其实", "可能", "也许", "但是", "所以", "而且", "某种程度", "说到底", "说实话", "认真说", "有点", "反而", "大概", "只是", "还是", "确实", "本质上", "后来", "突然",
]
#: Words for people close to the writer, fixed values.
RELATION_WORDS = ["同事", "朋友", "老师", "领导", "室友", "同学", "前任", "对象", "家人", "爸爸", "妈妈", "父亲", "母亲"]
#: What titles of blocked pages hold, fixed values.
BLOCK_MARKS = ["安全验证", "知乎 - 有问题", "知乎，中文互联网", "403", "验证码"]


def text_col(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at both ends, whatever Unicode calls white space."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def collapse(c: Column) -> Column:
    """Every run of white space as one blank."""
    return F.regexp_replace(c, f"{BLANK}+", " ")


def collapse_lines(c: Column) -> Column:
    """Three or more line breaks as two."""
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def non_blank(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda p: F.length(p) > 0)


def sentences_kept(c: Column) -> Column:
    """Sentences with their end marks: after wide marks and semicolons at once, after . ! ? only before a blank."""
    return non_blank(F.split(strip(collapse(c)), r"(?<=[。！？!?；;])\s*|(?<=[.!?])\s+"))


def sentences_plain(c: Column) -> Column:
    """Sentences without their end marks."""
    return non_blank(F.split(c, r"[。！？!?]\s*"))


def sentences_spoken(c: Column) -> Column:
    """Sentences with their end marks, the point being none."""
    return non_blank(F.split(c, r"(?<=[。！？!?；;])\s*"))


def words(c: Column) -> Column:
    """Lower-case Latin words and numbers, and single Han characters."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"[a-z0-9_]+|[{HAN}]"), F.lit(0))


def bigrams(c: Column) -> Column:
    """Neighbouring pairs of characters of the lower-case text, none across a line break; first those that begin at even
    places, then the others: two passes, whatever the length."""
    low = F.lower(c)
    pairs = lambda t: F.regexp_extract_all(t, F.lit("(?s).."), F.lit(0))
    return F.filter(F.concat(pairs(low), pairs(F.substring(low, F.lit(2), F.length(low)))), lambda p: ~F.contains(p, F.lit("\n")))


def tokens(c: Column) -> Column:
    return F.concat(words(c), bigrams(c))


def query_terms(c: Column) -> Column:
    """Different tokens of at least two characters that are neither numbers nor stop terms."""
    stop = F.array(*[F.lit(t) for t in STOP_TERMS])
    keep = lambda t: (F.length(t) >= 2) & ~t.rlike(r"^\p{Nd}+$") & ~F.array_contains(stop, t)
    return F.array_distinct(F.filter(tokens(c), keep))


def occurrences(c: Column, part: str) -> Column:
    """How often ``part`` occurs in the text without overlaps."""
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("bigint")


def is_noise(line: Column) -> Column:
    """A line with a chat number, or of four characters or more with less than 35 % Han characters, letters and digits."""
    useful = F.length(F.regexp_replace(line, f"[^{HAN}A-Za-z0-9]", ""))
    return line.rlike(r"(?i)QQ\s*\d{5,}") | ((F.length(line) >= 4) & (useful / F.greatest(F.length(line), F.lit(1)) < 0.35))


def clean_extracted(c: Column) -> Column:
    """Extracted text without control characters, noise lines and blank lines, blanks collapsed in each line."""
    lines = F.split(F.regexp_replace(c, r"[\x{00}-\x{08}\x{0b}-\x{1f}\x{7f}]", ""), r"\n|\x{85}|\x{2028}|\x{2029}")
    tidy = F.transform(lines, lambda x: strip(collapse(x)))
    return F.array_join(F.filter(tidy, lambda x: (F.length(x) > 0) & ~is_noise(x)), "\n")


def anonymise(c: Column) -> Column:
    """E-mail addresses, mobile numbers, Latin names and accounts, chat ids, named relatives and nicknames, in this order;
    an earlier rule hides text from the later ones."""
    rules = [
        (r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", "[邮箱]"),
        (r"(?<!\d)1[3-9]\d{9}(?!\d)", "[手机号]"),
        (r"(?U)\b[A-Za-z][A-Za-z0-9_.-]{2,20}\b", "[英文名/账号]"),
        (r"(?iU)微信[:：]?\s*[\w.-]{4,}", "微信：[账号]"),
        (r"(?i)QQ[:：]?\s*\d{5,12}", "QQ：[账号]"),
        *[(f"({w})([叫是为])?[{HAN}]{{2,4}}", "$1[某人]") for w in RELATION_WORDS],
        (f"小[{HAN}]", "小某"),
        (f"老[{HAN}]", "老某"),
    ]
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, c)


def mask_contacts(c: Column) -> Column:
    """The rules of :func:`anonymise` that need no look-around: e-mail addresses, chat ids and nicknames."""
    c = F.regexp_replace(c, r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", "[邮箱]")
    c = F.regexp_replace(c, r"(?i)QQ[:：]?\s*\d{5,12}", "QQ：[账号]")
    return F.regexp_replace(c, f"小[{HAN}]", "小某")


def strip_tags(c: Column) -> Column:
    """Without markup tags; the five basic entities resolved."""
    c = F.regexp_replace(c, r"<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def clean_title(c: Column) -> Column:
    """Without markup, a count of messages before it and the site's name after it, blanks collapsed."""
    c = F.regexp_replace(strip(strip_tags(c)), r"^\([^)]*(私信|消息)[^)]*\)\s*", "")
    return collapse(F.regexp_replace(strip(c), r"\s*-\s*知乎.*$", ""))


def clean_tags(c: Column) -> Column:
    """Tags without markup and white space."""
    return F.regexp_replace(strip_tags(c), f"{BLANK}+", "")


def after_label(line: Column) -> Column:
    """What follows the first wide colon, stripped; lines without one as they are."""
    return strip(F.regexp_replace(line, "^[^：]*：", ""))


def even_positions(n: Column, most: int) -> Column:
    """At most ``most`` positions of 0 to n - 1, evenly spaced, both ends among them; halves go to the even one."""
    spaced = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (n - 1) / (most - 1)).cast("int"))
    return F.when(n <= most, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array_distinct(spaced))


def fit_input(c: Column, most: int = 8000) -> Column:
    """Text within ``most`` characters: as it is, or head, middle and tail with markers between them."""
    head, tail = most // 2, most // 3
    middle = most - head - tail - 80
    start = F.greatest(F.lit(0), F.floor((F.length(c) - middle) / 2)).cast("int")
    fitted = F.concat(
        F.substring(c, F.lit(1), F.lit(head)), F.lit("\n\n[... embedding input truncated: middle sample ...]\n\n"),
        F.substring(c, start + 1, F.lit(max(0, middle))), F.lit("\n\n[... embedding input truncated: tail sample ...]\n\n"), F.right(c, F.lit(tail)),
    )
    return F.when(F.length(c) <= most, c).otherwise(F.substring(fitted, F.lit(1), F.lit(most)))


def head_tail_summary(title: Column, c: Column, most: int = 900) -> Column:
    """The collapsed text if short, else title, head and tail."""
    t = collapse(strip(c))
    cut = F.concat(title, F.lit("\n\n"), F.substring(t, F.lit(1), F.lit(most // 2)), F.lit("\n...\n"), F.right(t, F.lit(most // 2)))
    return F.when(F.length(t) <= most, t).otherwise(cut)


def route_summary(title: Column, folder: Column, c: Column, most: int = 1200) -> Column:
    """Title, folder, and the text or its head, middle and tail thirds."""
    t = strip(collapse(c))
    part = most // 3
    start = F.greatest(F.lit(0), F.floor(F.length(t) / 2) - part // 2).cast("int")
    thirds = F.concat_ws("\n...\n", F.substring(t, F.lit(1), F.lit(part)), F.substring(t, start + 1, F.lit(part)), F.right(t, F.lit(part)))
    body = F.when(F.length(t) <= most, t).otherwise(thirds)
    return F.concat(F.lit("标题："), title, F.lit("\n文件夹："), folder, F.lit("\n摘要候选文本："), body)


def bytes_label(n: Column) -> Column:
    """A size in B, KB, MB or GB with one decimal."""
    k = 1024.0
    return (
        F.when(n < k, F.format_string("%.1f B", n.cast("double")))
        .when(n < k**2, F.format_string("%.1f KB", n / k))
        .when(n < k**3, F.format_string("%.1f MB", n / k**2))
        .otherwise(F.format_string("%.1f GB", n / k**3))
    )


def lenient_object(c: Column) -> Column:
    """The JSON object in a text, alone or amid prose, as text; null where there is none."""
    whole = F.when(F.try_parse_json(c).isNotNull() & c.rlike(r"(?s)^\s*\{"), c)
    inner = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.coalesce(whole, F.when(F.try_parse_json(F.nullif(inner, F.lit(""))).isNotNull(), F.nullif(inner, F.lit(""))))
