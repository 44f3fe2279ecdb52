"""Problem 7: sentence units across languages and scripts by a hidden-event n-gram model.

Between the words of a text stand hidden events, boundary or none.  Where marks, line ends and paragraphs leave no
doubt, events are counted over the whole corpus together with the token before and the token after them; the places in
doubt (a point after a possible abbreviation, dots of omission, blanks of scripts without end marks) get the posterior
of a boundary from these counts, by the forward-backward recursion along their paragraph.  Tokens are words in scripts
with blanks and the nearest characters in others.  All counts live in tables of fixed size.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.session import spread

BITS = 20
TABLES = ("left_end", "left_on", "left_dot", "word", "right_start", "right_any")
SPACE = " \t\r\n\x0b\x0c\x85                　"
OPEN = {"“": "”", "‘": "’", "「": "」", "『": "』", "«": "»", "„": "“”", "‹": "›", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》"}
CLOSERS = set("”’」』»“›）)]】》\"'")
SURE_END = set("。！？｡？！।॥؟")
MARKER = regex.compile(r"[ \t　]*(?:[-*•·–—◦▪‣]\s+|\d{1,3}[.)]\s+|\d{1,3}、|[（(]\d{1,3}[)）]\s*|[①-⑳]\s*|[a-zA-Z]\)\s+|#{1,6}\s+)")
HEADING = regex.compile(r"[ \t]*(?:#{1,6}\s|\d{1,2}(?:\.\d{1,2})+\s|第[一二三四五六七八九十\d]+[章节節部]|[一二三四五六七八九十]{1,3}、)")
INTEREST = re.compile("[“”‘’「」『』«»„‹›（）()\\[\\]【】《》\"。！？｡!?।॥؟….\\n]")
#: Scripts written without end marks, where a blank may part sentences.
UNMARKED = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
_gap = re.compile(rf"(?<=[{SPACE}])(?=[^{SPACE}])")
_last_word = regex.compile(r"[\p{L}\p{M}\p{N}.'’-]*$")
_first_word = regex.compile(r"[¿¡\"“‘«„(\[]*\s?([\p{L}\p{M}\p{N}'’-]+)")
_wide = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
_number = regex.compile(r"\p{N}+")


#: Patterns of the helpers below.
_end_mark = regex.compile(r"[。！？!?।॥؟]|(?<=\p{L}{3})\.(?=\s|$)|\.$|…$")


def bucket(s: str) -> int:
    return xxhash.xxh64_intdigest(s) & ((1 << BITS) - 1)


def left_token(text: str, end: int) -> str:
    """The token that ends at ``end`` (before its mark): a word, or the last two characters where words have no blanks."""
    piece = text[max(0, end - 24) : end]
    if piece and _wide.match(piece[-1]):
        return piece[-2:]
    return _number.sub("9", _last_word.search(piece).group().lower().rstrip("."))


def right_token(text: str, start: int) -> str:
    """The token that begins at ``start``: a word, or the first characters where words have no blanks."""
    piece = text[start : start + 28].lstrip(SPACE)
    if not piece:
        return ""
    if _wide.match(piece[0]):
        return _number.sub("9", piece[:2])
    if UNMARKED.match(piece[0]):
        return piece[:6].split(" ")[0]
    m = _first_word.match(piece)
    return _number.sub("9", m.group(1)) if m else piece[0]


class Counts:
    """Hashed counts of tokens beside events."""

    def __init__(self, tables: dict[str, np.ndarray] | None = None):
        self.tables = tables or {}
        self.kept: dict[tuple[str, str], int] = {}

    def __call__(self, what: str, token_: str) -> int:
        k = (what, token_)
        n = self.kept.get(k)
        if n is None:
            if len(self.kept) > 300_000:
                self.kept.clear()
            n = self.kept[k] = int(self.tables[what][bucket(token_)]) if what in self.tables else 0
        return n


def blocks(text: str) -> list[tuple[int, int]]:
    """Paragraphs: ranges parted by blank lines."""
    out, start = [], 0
    for m in re.finditer(rf"\n[{SPACE}]*\n", text):
        out.append((start, m.start()))
        start = m.end()
    out.append((start, len(text)))
    return [(a, e) for a, e in out if text[a:e].strip(SPACE)]


_quoted = re.compile("“[^”]*”|「[^」]*」|『[^』]*』|«[^»]*»|„[^“”]*[“”]|\"[^\"]*\"")


def parts(text: str, a: int, e: int) -> list[tuple[int, int, bool]]:
    """Ranges of a paragraph that line breaks part, and whether each is one unit as it stands (a list item, a heading)."""
    if "\n" not in text[a:e]:
        return [(a, e, MARKER.match(text, a, e) is not None or HEADING.match(text, a, e) is not None and not _has_end(text[a:e]))]
    lines, at = [], a
    for line in text[a:e].split("\n"):
        if line.strip(SPACE):
            lines.append((at, at + len(line)))
        at += len(line) + 1
    body = [text[p:q] for p, q in lines]
    marked = [MARKER.match(t) is not None for t in body]
    unmarked = sum(1 for t in body if UNMARKED.search(t)) * 2 > len(body)
    goes_on = any(t.lstrip(SPACE)[:1].islower() and not t.lstrip(SPACE)[1:2].isupper() for t in body[1:])
    without_end = not unmarked and not goes_on and not any(_has_end(t) for t in body) and not any(marked)
    out: list[list] = []
    for i, (p, q) in enumerate(lines):
        heading = HEADING.match(body[i]) is not None and not _has_end(body[i])
        if not out or marked[i] or without_end or heading or out[-1][3]:
            out.append([p, q, marked[i] or without_end or heading, heading])
        else:
            out[-1][1] = q
    return [(p, q, one) for p, q, one, _ in out]


def _has_end(line: str) -> bool:
    """Whether a line has an end mark outside quotations: a point within a number or an address is none."""
    t = _quoted.sub("", line).rstrip(SPACE + "”’»」")
    return _end_mark.search(t) is not None


def candidates(text: str, a: int, e: int) -> list[tuple[int, int, str]]:
    """(end of the unit before, start of the next, kind) of the places in a[..e] where a boundary may stand.

    Kinds: 'sure', 'dot', 'dots', 'quote' and 'blank'.  Nothing stands inside quotations and brackets."""
    out: list[tuple[int, int, str]] = []
    stack: list[tuple[str, int]] = []
    unit_start = a
    straight = -1
    skip = a
    for m in INTEREST.finditer(text, a, e):
        i, c = m.start(), m.group()
        if i < skip or c == "\n":
            continue
        if c == '"':
            if straight < 0:
                straight = i
                continue
            opened, straight = straight, -1
            if not stack:
                _after_quote(text, opened, i, unit_start, e, out)
            continue
        if stack and c in stack[-1][0]:
            _, opened = stack.pop()
            if not stack and straight < 0 and c not in "）)]】》":
                _after_quote(text, opened, i, unit_start, e, out)
                if out and out[-1][0] == i + 1:
                    unit_start = out[-1][1]
            continue
        if c in OPEN and not (c == "‘" and i > a and text[i - 1].isalpha()):
            close = OPEN[c]
            # a quotation that isn't closed within the paragraph opens nothing
            if any(text.find(x, i + 1, e) >= 0 for x in close):
                stack.append((close, i))
            continue
        if c in CLOSERS or stack or straight >= 0 and text.find('"', i, e) >= 0:
            continue
        if c not in SURE_END and c not in "!?….":
            continue
        j = i + 1
        while j < e and (text[j] in SURE_END or text[j] in "!?…."):
            j += 1
        run = text[i:j]
        while j < e and text[j] in "”’」』»)）]】\"'" and not (text[j] in "\"'" and j + 1 < e and text[j + 1].isalnum()):
            j += 1
        skip = j
        n = j
        while n < e and text[n] in SPACE:
            n += 1
        if n >= e:
            continue
        nxt = text[n]
        wide = _wide.match(nxt) is not None or _wide.match(text[i - 1] if i > a else " ") is not None
        if nxt in ",，、;；:：" or (nxt in CLOSERS and nxt not in "\"'“"):
            continue
        if n == j and not wide and not any(x in SURE_END for x in run) and nxt not in "“「¿¡„«":
            glued = nxt.isupper() and text[n + 1 : n + 2].islower() and text[max(a, i - 3) : i].isalpha() and text[max(a, i - 3) : i].islower()
            if not glued and (nxt.isalnum() or nxt in "-/_@%&=+#.'’"):
                continue
        if nxt in "?!؟" and n > j:
            continue
        if any(x in SURE_END for x in run) or "!" in run or "?" in run:
            kind = "on" if _lower(text, n) else "sure"
        elif "…" in run or len(run) >= 2:
            kind = "dots"
        else:
            kind = "dot"
        if kind != "on":
            out.append((j, n, kind))
            if kind == "sure":
                unit_start = n
    if UNMARKED.search(text, a, e):
        taken = {n for _, n, _ in out}
        for g in _gap.finditer(text, a, e):
            n = g.start()
            if n > a and n not in taken and UNMARKED.match(text[n]):
                p = n
                while p > a and text[p - 1] in SPACE:
                    p -= 1
                if p > a and UNMARKED.match(text[p - 1]) or p > a and text[p - 1].isdigit():
                    out.append((p, n, "blank"))
        out.sort()
    return out


def _lower(text: str, n: int) -> bool:
    """Whether a word in lower case begins at n; names like iPhone aren't."""
    return text[n].islower() and not text[n + 1 : n + 2].isupper()


def _after_quote(text: str, opened: int, closed: int, unit_start: int, e: int, out: list) -> None:
    """A boundary after a quotation that ends with a mark, if a clause introduced it; one that begins the unit stays
    with the clause that follows."""
    inner = text[opened + 1 : closed].rstrip(SPACE)
    if not inner or not (inner[-1] in SURE_END or inner[-1] in "!?….”’»"):
        return
    before = text[unit_start:opened].strip(SPACE)
    n = closed + 1
    while n < e and text[n] in SPACE:
        n += 1
    if n >= e or text[n] in ",，、;；:：.。!！?？—–" or text[n] in CLOSERS and text[n] not in "\"'“":
        return
    if not before or before[-1] not in ":：,，﹐،":
        return
    if _lower(text, n) or text[n] in "的地得之と":
        return
    out.append((closed + 1, n, "sure"))


def observe(text: str, tables: dict[str, Counter]) -> None:
    """Count the tokens beside the events of a text that are in no doubt."""
    for a, e in blocks(text):
        for p, q, one in parts(text, a, e):
            start = p + (len(m.group()) if (m := MARKER.match(text, p, q)) else 0)
            tables["right_start"][right_token(text, start)] += 1
            tables["right_any"][right_token(text, start)] += 1
            body = text[p:q].rstrip(SPACE)
            if body.endswith(".") and not body.endswith(".."):
                tables["left_end"][left_token(body, len(body) - 1)] += 1
                tables["left_dot"][left_token(body, len(body) - 1)] += 1
            for j, n, kind in candidates(text, p, q):
                r = right_token(text, n)
                tables["right_any"][r] += 1
                if kind == "sure":
                    tables["right_start"][r] += 1
                elif kind == "dot":
                    w = left_token(text, text.rfind(".", p, j))
                    tables["left_dot"][w] += 1
                    if _lower(text, n):
                        tables["left_on"][w] += 1
            # words in the middle of lines, with a capital or without
            for m in _mid.finditer(text, p, q):
                tables["right_any"][m.group(1)] += 1
            tables["word"].update(w.lower() for w in _plain.findall(text, p, q))
            if _wide.search(text, p, q):
                s = _number.sub("9", text[p:q])
                tables["right_any"].update(map("".join, zip(s, s[1:])))


_mid = regex.compile(r"(?<=[\p{Ll},;] )(\p{Lu}[\p{L}\p{M}'’-]*)")
_plain = regex.compile(r"\p{L}[\p{L}\p{M}.'’-]*(?![\p{L}\p{M}.'’-])(?!\.)")


def learn(texts: DataFrame) -> Counts:
    """Counts over all texts: each task counts its own, the buckets are summed; their number is bounded."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrays = {k: np.zeros(1 << BITS, dtype=np.int64) for k in TABLES}
        tables = {k: Counter() for k in TABLES}

        def settle():
            for k, c in tables.items():
                for w, n in c.items():
                    arrays[k][bucket(w)] += n
                c.clear()

        for b in batches:
            for t in b["text"]:
                observe(t, tables)
            if sum(map(len, tables.values())) > 500_000:
                settle()
        settle()
        for k, x in arrays.items():
            at = np.nonzero(x)[0]
            yield pd.DataFrame({"what": k, "bucket": at.astype(np.int32), "n": x[at]})

    sums = texts.mapInPandas(count, "what string, bucket int, n bigint").groupBy("what", "bucket").agg(F.sum("n").alias("n")).toPandas()
    out = {k: np.zeros(1 << BITS, dtype=np.int32) for k in TABLES}
    for k, g in sums.groupby("what"):
        out[k][g["bucket"].to_numpy()] = np.minimum(g["n"].to_numpy(), 2**31 - 1)
    return Counts(out)


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def evidence(text: str, j: int, n: int, kind: str, counts: Counts) -> float:
    """Log odds of a boundary from the token before and the token after the place."""
    r = right_token(text, n)
    starts, anywhere = counts("right_start", r), counts("right_any", r)
    after = math.log((starts + 0.3) / (max(anywhere - starts, 0) * 0.25 + 0.3))
    if kind == "blank":
        return math.log((starts + 0.05) / (0.02 * anywhere + 0.5))
    if kind == "dots":
        if _lower(text, n):
            return -9.0
        return after + 0.5
    if _lower(text, n):
        return -9.0
    w = left_token(text, text.rfind(".", 0, j))
    end, on, dot, plain = counts("left_end", w), counts("left_on", w), counts("left_dot", w), counts("word", w)
    if text[n].isdigit() and (on or plain < dot):
        return -9.0
    if len(w) == 1 and w.isalpha():
        before = -5.0
    elif end == 0 and (on >= 2 or (dot >= 3 and plain <= 0.1 * dot)):
        before = -6.0  # it only introduces
    elif on == 0:
        before = 3.0 if w != "9" else 0.5
    else:
        before = _logit((end + 0.5) / (end + on + 1))
    return before + max(-4.0, min(4.0, after))


def posteriors(scores: list[float], gaps: list[int]) -> list[float]:
    """Forward-backward over the places of a paragraph: a boundary right after another one is unlikely."""
    n = len(scores)
    close = [math.log(0.5) if g < 6 else 0.0 for g in gaps]
    forward = np.zeros((n, 2))
    for i, s in enumerate(scores):
        prev = forward[i - 1] if i else np.array([-1e9, 0.0])
        none = np.logaddexp(prev[0], prev[1])
        forward[i] = none, s + np.logaddexp(prev[0], prev[1] + close[i])
    backward = np.zeros((n, 2))
    for i in range(n - 2, -1, -1):
        s = scores[i + 1]
        nxt = backward[i + 1]
        backward[i] = np.logaddexp(nxt[0], s + nxt[1]), np.logaddexp(nxt[0], s + close[i + 1] + nxt[1])
    both = forward + backward
    return [float(1 / (1 + math.exp(min(50, max(-50, x[0] - x[1]))))) for x in both]


def units(text: str, counts: Counts) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit, in order, without white space at either end."""
    out: list[tuple[int, int]] = []
    for a, e in blocks(text):
        for p, q, one in parts(text, a, e):
            cuts = [p]
            if not one:
                places = candidates(text, p, q)
                doubtful = [c for c in places if c[2] != "sure"]
                if doubtful:
                    scores = [evidence(text, *c, counts) for c in doubtful]
                    ends = [p, *(c[1] for c in doubtful)]
                    believed = posteriors(scores, [b - c for c, b in zip(ends, ends[1:])])
                    chosen = {c[1] for c, x in zip(doubtful, believed) if x > 0.5}
                else:
                    chosen = set()
                cuts += [n for _, n, kind in places if kind == "sure" or n in chosen]
            cuts = sorted(set(cuts)) + [q]
            for s, t in zip(cuts, cuts[1:]):
                while s < t and text[s] in SPACE:
                    s += 1
                while t > s and text[t - 1] in SPACE:
                    t -= 1
                if s < t:
                    out.append((s, t))
    return out


def sentence_units(rows: DataFrame) -> DataFrame:
    """(rec_table, rec_id, start_char, end_char) of every unit of (rec_table, rec_id, text).

    Null, empty and blank texts have none.  Every character that isn't white space belongs to exactly one unit.
    Repeated rows give their units again; an empty table gives an empty result; long texts are read whole; further
    columns don't take part."""
    rows = spread(rows.select("rec_table", "rec_id", "text").where("text is not null and text != ''"))
    shared = rows.sparkSession.sparkContext.broadcast(learn(rows.select("text")).tables)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counts(shared.value)
        for b in batches:
            out = [(name, i, s, e) for name, i, t in zip(b["rec_table"], b["rec_id"], b["text"]) for s, e in units(t, counts)]
            yield pd.DataFrame(out, columns=["rec_table", "rec_id", "start_char", "end_char"])

    return rows.mapInPandas(split, "rec_table string, rec_id bigint, start_char int, end_char int")
