"""Problem 1: splitting oversized items at natural boundaries.

A text is read as a row of tokens (runs of word characters, single characters of scripts written without spaces,
runs of blanks, single marks).  The tokens' lengths give prefix sums of offsets; the ends of tokens where a cut is
natural give one sorted array of offsets for each rank of boundary (paragraph, line, sentence, clause, blank, token).
For each piece a binary search finds the last boundary below the limit, best rank first; the next piece starts
``overlap`` characters before the cut.  Where no boundary leaves progress, the text is cut hard at the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRIPPED = " \t\r\n 　"
TOKEN = regex.compile(
    r"\r?\n(?:[ \t　]*\r?\n)+|\r?\n|[^\S\r\n]+"
    r"|[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]\p{M}*"
    r"|[\p{L}\p{N}\p{M}_]+|\X"
)
SENTENCE_END = frozenset("。！？!?…．｡؟۔।॥")
CLAUSE_END = frozenset(";；,，、:：،؛")
CLOSERS = frozenset("\"'”’」』）)]】》»")
#: Ranks of boundaries, best first.
RANKS = ("paragraph", "line", "sentence", "clause", "blank", "token", "hard")


def boundaries(text: str) -> list[np.ndarray]:
    """Sorted offsets at which a cut is natural, one array for each rank but the last."""
    tokens = TOKEN.findall(text)
    ends = np.cumsum([len(t) for t in tokens]) if tokens else np.zeros(0, dtype=np.int64)
    found: list[list[int]] = [[] for _ in RANKS[:-1]]
    closed, previous = "", ""
    for i, t in enumerate(tokens):
        e = int(ends[i])
        if t.isspace():
            if "\n" in t:
                found[0 if t.count("\n") > 1 else 1].append(e)
            elif closed == "sentence" or previous == ".":
                found[2].append(e)
            else:
                found[4].append(e)
            closed = ""
        elif t in SENTENCE_END or (t in CLOSERS and closed == "sentence"):
            closed = "sentence"
            following = tokens[i + 1] if i + 1 < len(tokens) else ""
            if not (following in SENTENCE_END or following in CLOSERS or following.isspace()):
                found[2].append(e)
        elif t in CLAUSE_END:
            closed = "clause"
            found[3].append(e)
        else:
            closed = ""
        found[5].append(e)
        previous = t
    return [np.asarray(f, dtype=np.int64) for f in found]


def pieces(text: str, size: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, rank of the cut) of each piece of at most ``size`` characters, neighbours sharing ``overlap``.

    A boundary of a better rank is taken only if it keeps at least half a piece of new text, so that pieces stay
    large; whichever is taken lies at least one character after the previous cut."""
    n = len(text)
    if n <= size:
        return [(0, n, "end")]
    ranks = boundaries(text)
    out: list[tuple[int, int, str]] = []
    start = reached = 0
    while n - start > size:
        limit = start + size
        cut, rank = limit, "hard"
        least = max(reached, start + overlap) + 1
        for r, at in enumerate(ranks):
            k = int(np.searchsorted(at, limit, side="right")) - 1
            floor = max(least, start + overlap + (size - overlap) // 2) if r < 4 else least
            if k >= 0 and at[k] >= floor:
                cut, rank = int(at[k]), RANKS[r]
                break
        out.append((start, cut, rank))
        reached, start = cut, cut - overlap
    out.append((start, n, "end"))
    return out


def _usable(overlap: Column, size: Column) -> Column:
    """null or negative: 0; as large as the piece or larger: size - 1, so that every piece brings new text."""
    return F.least(F.greatest(F.coalesce(overlap, F.lit(0)), F.lit(0)), size - 1)


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = [
            (key, size, overlap, k, a, b, text[a:b], rank)
            for key, text, size, overlap in rows[["key", "t", "size", "overlap"]].itertuples(index=False)
            for k, (a, b, rank) in enumerate(pieces(text, int(size), int(overlap)))
        ]
        yield pd.DataFrame(out, columns=["key", "size", "overlap", "piece_index", "start_char", "end_char", "content", "cut"])


def split_oversized(
    df: DataFrame, key: str = "id", content: str = "content", size: str = "chunk_size", overlap: str = "chunk_overlap"
) -> DataFrame:
    """The pieces of every row whose stripped content is longer than its own positive size.

    Result: key, size, overlap, piece_index, start_char, end_char (places in the stripped content, end exclusive),
    content, cut.  Null contents, contents that fit, and null, zero or negative sizes have no pieces.  A null or negative
    overlap counts as 0, one of the size or more as size - 1.  Repeated rows are split again; an empty table gives an
    empty result; further columns don't take part, so their names can't clash.  No shuffle takes place, and rows that
    fit never reach Python."""
    trimmed = F.regexp_replace(F.col(f"`{content}`"), "^[ \\t\\r\\n\\u00a0\\u3000]+|[ \\t\\r\\n\\u00a0\\u3000]+$", "")
    long = (
        df.select(
            F.col(f"`{key}`").alias("key"), trimmed.alias("t"), F.col(f"`{size}`").alias("size"), F.col(f"`{overlap}`").alias("o")
        )
        .where((F.col("size") > 0) & (F.length("t") > F.col("size")))
        .withColumn("overlap", _usable(F.col("o"), F.col("size")))
    )
    kind = df.schema[key].dataType.simpleString()
    return long.drop("o").mapInPandas(
        _cut,
        f"key {kind}, size int, overlap int, piece_index int, start_char int, end_char int, content string, cut string",
    )
