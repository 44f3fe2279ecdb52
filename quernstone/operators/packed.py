"""Problem 2: several values packed in one field, one row per value with its position kept.

The grammar of a field, as ordered alternatives (the first that fits wins; a quote that isn't closed before a
separator backtracks to a bare value and sets ``malformed``):

    field   <- '[' list ']' / hashtags / list
    list    <- value (separator value)*
    value   <- blank* quoted blank* &(separator / end) / bare
    quoted  <- '"' (!'"' . / '""')* '"' / '“' ... '”' / "'" ... "'" / '‘' ... '’' / '「' ... '」'
    bare    <- (!separator .)+

The separators of a field are its strong ones (comma, ideographic comma, semicolon, bar, line break, tab) if there
is any outside quotes, else slashes, else blanks that don't stand within a Latin-script phrase.  Java's regular
expressions try alternatives in order with backtracking, so each form is one pattern and the whole operator runs
inside whole-stage code generation, without Python and without a shuffle.  Repeated groups are possessive, so the
matcher's stack doesn't grow with a value's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[ \t\r\n\u00a0\u3000\u2000-\u200b\ufeff]"
STRONG = r",，、;；|｜\n\r\t"
LATIN = r"\p{IsLatin}\p{Nd}&+'’.()\-"
#: Possessive throughout: a quotation's alternatives exclude each other, and Java then loops instead of recursing, so
#: that a value may have any length.
QUOTED = r"""(?:"(?:[^"\\]++|\\.|"")*+"|“[^“”]*+”|'(?:[^']++|'')*+'|‘[^‘’]*+’|「[^「」]*+」)"""


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}++|(?<!{BLANK}){BLANK}++$", "")


def _alternatives(separators: str) -> str:
    """quoted before a separator or the end, else bare."""
    pad = r"[ \t\u00a0\u3000]*"
    return f"{pad}{QUOTED}{pad}(?=[{separators}]|$)|[^{separators}]++"


#: A value that holds nothing: blanks, hashes, or an empty quotation; in a list a backslash only escapes.
NOTHING = rf"""^(?:[#＃]*|"{BLANK}*"|“{BLANK}*”|'{BLANK}*'|‘{BLANK}*’|「{BLANK}*」)$"""
NOTHING_LISTED = rf"""{NOTHING}|^"(?:\\?{BLANK})*"$"""


def _raw_values(inner: Column) -> Column:
    """The values of a field without its list brackets, as they stand."""
    masked = F.regexp_replace(inner, f"(^|[{STRONG}/／]|{BLANK}){QUOTED}(?=$|[{STRONG}/／]|{BLANK})", "$1Q")
    in_phrase = f"(?<=[{LATIN}])[ \\t\\u00a0]++(?=[{LATIN}])"
    by_blank = f"{QUOTED}(?={BLANK}|$)|(?:[^ \\t\\u00a0\\u3000]++|{in_phrase})++"
    return (
        F.when(masked.rlike(f"[{STRONG}]"), F.regexp_extract_all(inner, F.lit(_alternatives(STRONG)), F.lit(0)))
        .when(inner.rlike("^[#＃]"), F.regexp_extract_all(inner, F.lit("[#＃][^#＃]++"), F.lit(0)))
        .when(masked.rlike("[/／]"), F.regexp_extract_all(inner, F.lit(_alternatives("/／")), F.lit(0)))
        .otherwise(F.regexp_extract_all(inner, F.lit(by_blank), F.lit(0)))
    )


def split_packed(df: DataFrame, key: str, field: str, key_as: str = "question_id") -> DataFrame:
    """One row per value of ``field``: (``key_as``, pos, tag, form, malformed).

    ``pos`` counts the non-empty values from 0; repeated values are kept.  ``form`` is 'quoted', 'hashtag', 'bracketed' (a
    bare value in list brackets) or 'bare'; ``malformed`` marks a bare value that begins like a quotation.  Rows whose
    field is null, empty or holds only separators give none.  Repeated rows give their values again, an empty table gives
    an empty result, and further columns of ``df``, whatever their names, are left out.  A field of any length and any
    number of values takes time in proportion to it."""
    t = df.select(F.col(f"`{key}`").alias("k"), _strip(F.col(f"`{field}`")).alias("t"))
    t = t.select("k", "t", F.col("t").rlike(r"(?s)^\[.*\]$").alias("listed"))
    inner = F.when(F.col("listed"), _strip(F.regexp_replace("t", r"(?s)^\[(.*)\]$", "$1"))).otherwise(F.col("t"))
    split = t.select("k", "listed", F.explode(F.array(_raw_values(inner))).alias("raw"))
    stripped = split.select("k", "listed", F.transform("raw", _strip).alias("raw"))
    empty = lambda x: F.when(F.col("listed"), x.rlike(NOTHING_LISTED)).otherwise(x.rlike(NOTHING))
    # the outer form: for the inner one the optimizer adds a filter on the array's size and splits every field twice
    each = stripped.select("k", "listed", F.posexplode_outer(F.filter("raw", lambda x: ~empty(x))).alias("pos", "v")).where("v is not null")
    v = F.col("v")
    sized = each.withColumn("quoted", v.rlike(f"(?s)^{QUOTED}$") & (F.length(v) >= 2))
    bare = F.expr("substring(v, 2, length(v) - 2)")
    one = F.replace(bare, F.lit('""'), F.lit('"'))
    undoubled = (
        F.when(v.startswith('"') & F.col("listed"), F.regexp_replace(one, r"\\(.)", "$1"))
        .when(v.startswith('"'), one)
        .when(v.startswith("'"), F.replace(bare, F.lit("''"), F.lit("'")))
        .otherwise(bare)
    )
    tag = F.when(F.col("quoted"), _strip(undoubled)).otherwise(_strip(F.regexp_replace(v, "^[#＃]+", "")))
    form = F.when(F.col("quoted"), "quoted").when(v.rlike("^[#＃]"), "hashtag").when(F.col("listed"), "bracketed").otherwise("bare")
    malformed = ~F.col("quoted") & v.rlike("^[\"“‘「]|^'[^']*$")
    return sized.select(F.col("k").alias(key_as), "pos", tag.alias("tag"), form.alias("form"), malformed.alias("malformed"))
