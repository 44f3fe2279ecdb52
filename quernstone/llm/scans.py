"""Problem 5: noise in text from scanned pages.

Structure: lines that hold only a page number are told from scales and lists by their neighbours; lines beside them,
at a form feed, or with a page number of their own are edge lines, and an edge line whose normalised text recurs within
the document or over the corpus is a running header.

Hyphens: a broken word's two parts are joined and looked up; the mark vanishes unless the corpus writes the word with it.

Misread characters: every word has an anagram hash, the sum of its characters' values.  In SQL, a rare word's hash
changed by the difference of a confusable pair is joined with the hashes of frequent words; for scripts without blanks
the words are characters between their two neighbours, and the confusable pairs are learned: a character most of whose
occurrences stand where another one dominates is a misreading of that one, and so is a common character in the places
where it stands for a dominating one in scanned pages only.  Corrections are ranked by frequency and carry their place,
so that the text is repaired at all of them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import unicodedata
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.ngram import portions
from quernstone.session import cut, spread

LF = 10
HYPHENS = "-‐‑­¬"
#: Misreadings of letters and what they stand for, fixed values.
CONFUSIONS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("|", "l"), ("!", "i"), ("@", "a"), ("†", "t"), ("9", "g"), ("5", "s"), ("$", "s"), ("6", "e"), ("8", "b"), ("3", "e"),
    ("cl", "d"), ("li", "h"), ("m", "rn"), ("rn", "m"), ("vv", "w"), ("w", "vv"), ("c", "e"), ("e", "c"), ("ii", "u"), ("u", "ii"), ("nn", "rm"), ("ri", "n"), ("é", "e"), ("h", "b"), ("b", "h"), ("f", "t"), ("i", "l"), ("l", "i"), ("q", "g"),
]
SYMBOLS = str.maketrans("01@†9$568|", "olatgssebl")
WORD = re.compile("(?=[0-9@†|$'’-]*[A-Za-zÀ-ɏ])[A-Za-zÀ-ɏ0-9@†|$'’\u0300-\u036f-]+")
#: A page number has at most six digits.
PLAIN = regex.compile(r"\d{1,6}")
ROMAN = regex.compile(r"(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
NUMBER = r"[\dlIOo]{1,6}"
DECORATED = regex.compile(
    rf"(?:[-–—·~]\s*{NUMBER}\s*[-–—·~]|[\[［(（]\s*{NUMBER}\s*[\]］)）]|{NUMBER}\s*[/|／｜]\s*{NUMBER}|(?i:page|p\.|seite|s\.|página|pág\.|pagina)\s*{NUMBER}(?:\s*(?i:of|von|de|sur|/)\s*{NUMBER})?"
    rf"|第\s*{NUMBER}\s*[页頁](?:\s*[,，/]?\s*共\s*{NUMBER}\s*[页頁])?|{NUMBER}\s*(?:ページ|頁|页)|(?:หน้า|صفحة|पृष्ठ)\s*{NUMBER})"
)
ATTACHED = regex.compile(rf"^(?:(?P<a>{NUMBER})\s{{2,}}(?P<t>\S.*)|(?P<u>\S.*?)\s{{2,}}(?P<b>{NUMBER}))$")
END = "。！？!?….;；:：，,、؟।”」』»"


_apart = re.compile(r"\s\s")
_ends_with_hyphen = re.compile(rf"[{HYPHENS}]\s*(?:\n|\Z)")
_beyond_latin = re.compile("[ɐ-􏿿]")
_first_letter = re.compile(r"[^\W_]|[@†|]")


#: Patterns of the helpers below.
_number_first = regex.compile(r"[\d\-–—·~\[［(（lIOopPsSſ第หصपivxlc]")  # what a page number begins with
_not_letter = regex.compile(r"[^\p{L}\p{M}]")
_unmarked_script = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}]{8}")
_broken_word = regex.compile(rf"([\p{{L}}\p{{M}}\p{{N}}@†'’]+(?:-[\p{{L}}\p{{M}}\p{{N}}@†]+)*)([{HYPHENS}])$")
_word_start = regex.compile(r"[\p{L}\p{M}\p{N}@†'’]+")
_any_letter = regex.compile(r"\p{L}")
_ends_wide = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}　-〿＀-￯]$")
_starts_wide = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}　-〿＀-￯]")


class _Keys(dict):
    """What becomes of each character in a key; found once."""

    def __missing__(self, c: int) -> str:
        self[c] = _not_letter.sub("", chr(c).translate(SYMBOLS))
        return self[c]


KEYS = _Keys()


def bare(line: str) -> str:
    return line.replace("\x0c", "").strip()


def key(line: str) -> str:
    """A header's text without its page number, case, spacing, marks and symbols that are misread letters."""
    return _known_key(line) if len(line) <= 256 else _key(line)


def _key(line: str) -> str:
    t = bare(line)
    if _apart.search(t) and (m := ATTACHED.match(t)) is not None:
        t = m.group("t") or m.group("u")
    return unicodedata.normalize("NFKC", t).casefold().translate(KEYS)


#: A document's short lines are asked for several times.
_known_key = lru_cache(4096)(_key)


def page_numbers(lines: list[str]) -> set[int]:
    """Lines that hold only a page number."""
    found, plain = set(), []
    for i, line in enumerate(lines):
        t = bare(line)
        if not t or not _number_first.match(t):
            continue
        if DECORATED.fullmatch(t):
            found.add(i)
        elif PLAIN.fullmatch(t) or ROMAN.fullmatch(t):
            plain.append(i)
    # runs of neighbouring plain numbers: a scale or list counts up from 0 or 1, a page number may stand within it
    at = 0
    while at < len(plain):
        end = at
        while end + 1 < len(plain) and plain[end + 1] == plain[end] + 1:
            end += 1
        run = plain[at : end + 1]
        if len(run) >= 3:
            values = [int(bare(lines[i])) if PLAIN.fullmatch(bare(lines[i])) else -1 for i in run]
            best: list[int] = []
            for start in (0, 1):
                want, chain = start, []
                for i, v in zip(run, values):
                    if v == want:
                        chain.append(i)
                        want += 1
                if len(chain) > len(best):
                    best = chain
            if len(best) >= 3:
                found.update(i for i in run if i not in best)
            else:
                found.update(run)
        else:
            found.update(run)
        at = end + 1
    return found


def edges(lines: list[str], numbers: set[int]) -> dict[int, bool]:
    """Lines that may be running headers, and whether their place says so: beside a page number, at a form feed, or
    with a page number of their own.  The first line is one too."""
    out: dict[int, bool] = {}
    for i, line in enumerate(lines):
        t = bare(line)
        if i in numbers or not t or t[-1] in END or (t[-1] == "." and not t.endswith("No.")):
            continue
        own = _apart.search(t) is not None and ATTACHED.match(t) is not None
        beside = (i - 1 in numbers) or (i + 1 in numbers)
        feed = "\x0c" in line or (i + 1 < len(lines) and "\x0c" in lines[i + 1])
        if own or beside or feed:
            out[i] = True
        elif i == 0 or i == len(lines) - 1:
            out[i] = False
    return {i: sure for i, sure in out.items() if len(key(lines[i])) >= 2}


def _edge_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for doc, text in zip(b["doc_id"], b["content"]):
            lines = text.split("\n")
            found = edges(lines, page_numbers(lines))
            if not found:
                continue
            keys = {i: key(lines[i]) for i in found}
            wanted = set(keys.values())
            same = Counter(k for line in lines if (k := key(line)) in wanted)
            own = {keys[i] for i in found if ATTACHED.match(bare(lines[i]))}
            for k, n in Counter(keys[i] for i, sure in found.items() if sure or same[keys[i]] > 1).items():
                out.append((doc, k, n, k in own))
            # what is said within a page, too, is no header: in scripts without end marks, and on documents without page lines
            unmarked = _unmarked_script.search(text)
            if unmarked or not any(found.values()):
                within = [bare(line) for i, line in enumerate(lines) if len(line) >= 2 and i not in found]
                out += [(doc, k, -1, False) for k in {key(t) for t in within if t and t[-1] not in END and t[-1] != "."} if len(k) >= 2]
        yield pd.DataFrame(out, columns=["doc_id", "key", "n", "own"])


def headers(pages: DataFrame) -> DataFrame:
    """(doc_id, keys): the normalised running headers of each document: edge texts that recur in it or over the corpus."""
    found = cut(pages.mapInPandas(_edge_rows, "doc_id bigint, key string, n int, own boolean"))
    edge, body = F.when(F.col("n") > 0, F.col("n")), F.when(F.col("n") < 0, 1)
    counts = found.groupBy("key").agg(
        F.coalesce(F.sum(edge), F.lit(0)).alias("all"), F.count(edge).alias("docs"), F.count(body).alias("body")
    )
    kept = found.where("n > 0").join(counts, "key")
    kept = kept.where("own or (body * 2 < all and (n >= 2 or (all >= 4 and docs >= 2)))")
    return kept.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def structure(lines: list[str], keys: list[str]) -> dict[int, str]:
    """line -> 'page_number' or 'header'."""
    numbers = page_numbers(lines)
    out = {i: "page_number" for i in numbers}
    known = set(keys)
    alike: dict[str, bool] = {}
    for i, sure in edges(lines, numbers).items():
        k = key(lines[i])
        if k in known or (sure and _alike(k, known, alike)):
            out[i] = "header"
    if known and numbers:  # a header may stand alone within a page's text
        firsts = {k[0] for k in known}
        for i, line in enumerate(lines):
            if i in out or (t := bare(line))[-1:] in END or not t:
                continue
            m = _first_letter.search(t)
            if m and (_apart.search(t) or m.group().casefold().translate(SYMBOLS)[0] in firsts) and key(line) in known:
                out[i] = "header"
    return out


def _alike(k: str, known: set[str], seen: dict[str, bool]) -> bool:
    """Whether a line's key is a known header's with a few characters misread."""
    if k not in seen:
        near = (h for h in known if min(len(h), len(k)) * 3 >= max(len(h), len(k)) * 2)
        seen[k] = any((m := SequenceMatcher(None, k, h)).real_quick_ratio() >= 0.8 and m.quick_ratio() >= 0.8 and m.ratio() >= 0.8 for h in near)
    return seen[k]


def _body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc_id, line_no, what, a, b, at, next_no): page lines, broken words and the body's lines.

    ``at`` is the place of a broken word's first part in its line, ``next_no`` the line that holds the second."""
    for batch in batches:
        out = []
        for doc, text, keys in zip(batch["doc_id"], batch["content"], batch["keys"]):
            lines = text.split("\n")
            kinds = structure(lines, list(keys) if keys is not None else [])
            out += [(doc, i, kind, "", "", 0, -1) for i, kind in kinds.items()]
            body = [i for i in range(len(lines)) if i not in kinds and bare(lines[i])]
            for i, j in zip(body, [*body[1:], -1]):
                here = bare(lines[i])
                after = bare(lines[j]) if j >= 0 else ""
                m = here[-1] in HYPHENS and _broken_word.search(here)
                n = m and _word_start.match(after)
                if m and n and _any_letter.search(n.group()):
                    out.append((doc, i, "broken", m.group(1), n.group(), m.start(), j))
                out.append((doc, i, "line", here, "", 0, j))
        yield pd.DataFrame(out, columns=["doc_id", "line_no", "what", "a", "b", "at", "next_no"])


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words and characters between neighbours with their counts, summed in each task before the shuffle.

    Characters are also counted in texts that weren't scanned (clean), and in scanned ones within a line (inside)."""
    words: Counter = Counter()
    grams: list[np.ndarray] = []  # (a, b and c in one number, n, clean, inside) in columns

    def flush():
        w = pd.DataFrame({"kind": "w", "x": list(words.keys()), "c": "", "n": list(words.values()), "clean": 0, "inside": 0})
        words.clear()
        all_ = _gathered(grams)
        grams.clear()
        a, c, x = all_[0] >> 42, (all_[0] >> 21) & 0x1FFFFF, all_[0] & 0x1FFFFF
        marks = [k for k in np.unique(c).tolist() if chr(k).isalpha() or unicodedata.category(chr(k))[0] == "M"]
        kept = np.isin(c, marks)
        sides = _text(np.stack([a, x], axis=1)[kept].ravel())
        g = pd.DataFrame({
            "kind": "g", "x": [sides[i : i + 2] for i in range(0, len(sides), 2)], "c": list(_text(c[kept])), "n": all_[1][kept],
            "clean": all_[2][kept], "inside": all_[3][kept],
        })
        return [y for y in (w, g) if len(y)]

    for b in batches:
        texts: dict[bool, list[str]] = {False: [], True: []}
        for t, scanned in zip(b["content"], b["scanned"]):
            if _ends_with_hyphen.search(t) is None:
                words.update(WORD.findall(t.lower()))
            else:
                for line in t.split("\n"):
                    line = line.rstrip()
                    here = WORD.findall(line.lower())
                    words.update(here[:-1] if here and line[-1] in HYPHENS else here)
            if _beyond_latin.search(t):
                texts[bool(scanned)].append(t.replace("\x0c", ""))
        for scanned, part in ((k, p) for k, v in texts.items() for p in portions(v)):
            whole = _neighbours([t.replace("\n", "") for t in part])
            at, n = np.unique(whole, return_counts=True)
            grams.append(np.stack([at, n, n * (not scanned), n * 0]))
            if scanned:
                at, n = np.unique(_neighbours(["\n".join(part)], LF), return_counts=True)
                grams.append(np.stack([at, n * 0, n * 0, n]))
        if len(words) + sum(g.shape[1] for g in grams) > 1_000_000:
            grams[:] = [_gathered(grams)]
            if len(words) + grams[0].shape[1] > 1_000_000:
                yield from flush()
    yield from flush()


def _neighbours(texts: list[str], apart: int = -1) -> np.ndarray:
    """All neighbouring three characters of each text in one number, where the middle one is beyond Latin script and none is ``apart``."""
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    kept = (c[1:-1] > ord("ɏ")) & (owner[:-2] == owner[2:])
    if apart >= 0:
        kept &= (c[:-2] != apart) & (c[2:] != apart)
    return ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[kept]


def _gathered(grams: list[np.ndarray]) -> np.ndarray:
    """The sums of the counts of equal numbers."""
    if not grams:
        return np.zeros((4, 0), dtype=np.int64)
    rows = np.concatenate(grams, axis=1)
    rows = rows[:, np.argsort(rows[0], kind="stable")]
    starts = np.nonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))[0] if rows.shape[1] else np.zeros(0, np.int64)
    return np.concatenate([rows[:1, starts], np.add.reduceat(rows[1:], starts, axis=1)]) if len(starts) else rows


def _text(c: np.ndarray) -> str:
    return c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _value(s: str) -> int:
    """The anagram hash: a sum of characters' values, so that exchanging one for another adds their difference."""
    total = sum(xxhash.xxh64_intdigest(c) for c in s) & 0xFFFFFFFFFFFFFFFF
    return total - (1 << 64) if total >= 1 << 63 else total


def _wrap(x: int) -> int:
    x &= 0xFFFFFFFFFFFFFFFF
    return x - (1 << 64) if x >= 1 << 63 else x


def misread_words(words: DataFrame, wanted: DataFrame, ratio: int = 8, least: int = 6) -> DataFrame:
    """(word, correction) of the ``wanted`` (word) that are rare beside a frequent word one confusion away.

    ``words`` (word, n) are the corpus's counts.  Corrections are ranked by how often they occur."""

    @F.pandas_udf("bigint")
    def value(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series([_value(w) for w in x], dtype="int64")

    @F.pandas_udf("array<struct<target:bigint,wrong:string,right:string>>")
    def targets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        steps = [(a, b, _value(b) - _value(a)) for a, b in CONFUSIONS]
        for x in batches:
            out = []
            for w in x:
                v = _value(w)
                here = [{"target": _wrap(v + d), "wrong": a, "right": b} for a, b, d in steps if a in w]
                if (all_ := w.translate(SYMBOLS)) != w:
                    here.append({"target": _value(all_), "wrong": "", "right": all_})
                out.append(here)
            yield pd.Series(out)

    @F.pandas_udf("boolean")
    def fits(w: pd.Series, v: pd.Series, wrong: pd.Series, right: pd.Series) -> pd.Series:
        def ok(w, v, a, b):
            if not a:
                return v == b
            return any(w[i : i + len(a)] == a and w[:i] + b + w[i + len(a) :] == v for i in range(len(w)))

        return pd.Series([ok(*r) for r in zip(w, v, wrong, right)], dtype=bool)

    counted = wanted.join(words, "word", "left").select("word", F.coalesce("n", F.lit(1)).alias("own")).where("length(word) >= 3")
    rare = counted.select("word", "own", F.explode(targets("word")).alias("t")).select("word", "own", "t.*")
    frequent = words.where(f"n >= {least}").select(F.col("word").alias("correction"), "n", value("word").alias("target"))
    joined = rare.join(frequent, "target").where(F.col("n") >= F.lit(ratio) * F.col("own"))
    good = joined.where(fits("word", "correction", "wrong", "right"))
    return good.groupBy("word").agg(F.max_by("correction", "n").alias("correction"))


def misread_characters(grams: DataFrame, ratio: int = 12, least: int = 6, share: float = 0.4, expected: int = 10) -> DataFrame:
    """(x, c, d): between the neighbours ``x`` the character ``c`` stands for ``d``.

    ``grams`` are (x, c, n, clean, inside): occurrences in all texts, in those not scanned, and in scanned ones within a
    line.  Evidence is a place where d is ``ratio`` times as frequent; a pair counts in all such places if they explain
    at least ``share`` of c's occurrences.  Where c is common too, a pair counts in the places that hold it in scanned
    texts only, if texts not scanned, which hold d there, would have ``expected`` of it or more were c no misreading, and
    have hardly any.  Without texts not scanned only the first rule applies."""
    top = grams.groupBy("x").agg(F.max(F.struct("n", "c", "clean")).alias("t"))
    top = top.select("x", F.col("t.n").alias("most"), F.col("t.c").alias("d"), F.col("t.clean").alias("d_clean"))
    evidence = cut(
        grams.join(top.where(f"most >= {least}"), "x").where(F.col("c") != F.col("d")).where(F.col("most") >= F.lit(ratio) * F.col("n"))
    )
    # beside digits and blanks stands anything
    judged = F.col("x").rlike(r"^[^\p{N}\s\u00a0\u3000]{2}$") & F.col("d").rlike(r"^[\p{L}\p{M}]$") & F.col("c").rlike(r"^[\p{L}\p{M}]$")
    zero = F.lit(0)
    pairs = evidence.groupBy("c", "d").agg(
        F.sum("n").alias("explained"), F.sum(F.when(judged, F.col("inside")).otherwise(zero)).alias("scanned"),
        F.sum(F.when(judged, F.col("clean")).otherwise(zero)).alias("unscanned"),
        F.sum(F.when(judged, F.col("inside") * F.col("d_clean") / F.col("most")).otherwise(zero)).alias("due"),
    )
    totals = grams.groupBy("c").agg(F.sum("n").alias("total"))
    by_c = pairs.groupBy("c").agg(F.sum("explained").alias("all_explained"))
    judged_pairs = pairs.join(totals, "c").join(by_c, "c").select(
        "c", "d",
        # letters of alphabets have rare ones of their own, so that only places decide there
        (F.col("c").rlike("[\u3040-\u9fff]") & (F.col("explained") >= F.lit(share) * F.col("total")) & (F.col("explained") >= 0.5 * F.col("all_explained"))).alias("everywhere"),
        ((F.col("due") >= expected) & (F.col("unscanned") * 20 <= F.col("scanned"))).alias("by_place"),
    )
    both = evidence.join(judged_pairs.where("everywhere or by_place"), ["c", "d"])
    return both.where(F.col("everywhere") | (judged & (F.col("clean") == 0) & (F.col("inside") > 0))).select("x", "c", "d")


def analysis(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the pdf documents: (doc_id, line_no, kind, note) of page lines and broken words, and the corrections of misread
    words and characters as (doc_id, line_no, owner_no, at, size, right): from ``at`` in the line without blanks around it,
    ``size`` characters stand for ``right``; a word broken over a line goes on in the next one, and ``owner_no`` is the
    line that holds the wrong character.

    Counts cover the contents of all documents."""
    rows = spread(documents.select("doc_id", "loader", "content").where("content is not null and content != ''"))
    pages = rows.where("loader = 'pdf'").select("doc_id", "content")
    counted = cut(
        rows.select("content", F.coalesce(F.col("loader") == "pdf", F.lit(False)).alias("scanned"))
        .mapInPandas(_words, "kind string, x string, c string, n bigint, clean bigint, inside bigint")
        .groupBy("kind", "x", "c").agg(*[F.sum(k).alias(k) for k in ("n", "clean", "inside")])
    )
    words = counted.where("kind = 'w'").select(F.col("x").alias("word"), "n")
    grams = counted.where("kind = 'g'").select("x", "c", "n", "clean", "inside")
    parts = cut(
        pages.join(headers(pages), "doc_id", "left").mapInPandas(_body, "doc_id bigint, line_no int, what string, a string, b string, at int, next_no int")
    )
    fixed = parts.where("what in ('header', 'page_number')").select("doc_id", "line_no", F.col("what").alias("kind"), F.lit(None).cast("string").alias("note"))

    broken = parts.where("what = 'broken'").select("doc_id", "line_no", "a", "b", "at", "next_no")
    broken = broken.withColumn("joined", F.lower(F.concat("a", "b"))).withColumn("hyphened", F.lower(F.concat_ws("-", "a", "b")))
    n_joined = words.select(F.col("word").alias("joined"), F.col("n").alias("n_joined"))
    n_hyphened = words.select(F.col("word").alias("hyphened"), F.col("n").alias("n_hyphened"))
    known = broken.join(n_joined, "joined", "left").join(n_hyphened, "hyphened", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    hyphen = known.where(zero("n_hyphened") <= zero("n_joined"))
    marked = hyphen.select("doc_id", "line_no", F.lit("hyphen").alias("kind"), F.col("joined").alias("note"))

    # words of body lines, whole or joined over a hyphen
    @F.pandas_udf("array<struct<word:string,at:int>>")
    def line_words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            out = []
            for t in x:
                found = [{"word": m.group(), "at": m.start()} for m in WORD.finditer(t.lower())] if len(t.lower()) == len(t) else []
                out.append(found[:-1] if t and t[-1] in HYPHENS else found)
            yield pd.Series(out)

    lines = parts.where("what = 'line'")
    own = lines.where(F.col("a").rlike(r"\p{IsLatin}")).select("doc_id", "line_no", F.explode(line_words("a")).alias("w")).select("doc_id", "line_no", "w.*")
    whole = broken.select("doc_id", "line_no", "next_no", "at", F.col("joined").alias("word"), F.length("a").alias("cut_at"))
    wanted = own.select("word").union(whole.select("word")).distinct()
    wrong = cut(misread_words(words, wanted))
    in_line = own.join(wrong, "word").select("doc_id", "line_no", F.col("line_no").alias("owner_no"), "at", F.length("word").alias("size"), F.col("correction").alias("right"))

    @F.pandas_udf("int")
    def first_difference(w: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b))) for a, b in zip(w, v)], dtype="int32")

    over = whole.join(wrong, "word").withColumn("first", first_difference("word", "correction"))
    over = over.select(
        "doc_id", "line_no", F.when(F.col("first") < F.col("cut_at"), F.col("line_no")).otherwise(F.col("next_no")).alias("owner_no"), "at",
        F.length("word").alias("size"), F.col("correction").alias("right"),
    )

    bad = cut(misread_characters(grams))
    suspicious = {r.c for r in bad.select("c").distinct().collect()}  # characters, at most as many as there are
    shared = documents.sparkSession.sparkContext.broadcast(suspicious)

    def occurrences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["content"]):
                if not shared.value.isdisjoint(text):
                    joined, at = [], []
                    for no, line in enumerate(text.split("\n")):
                        plain = line.replace("\x0c", "")
                        lead = len(plain) - len(plain.lstrip())
                        joined.append(plain)
                        at += [(no, i - lead) for i in range(len(plain))]
                    t = "".join(joined)
                    out += [(doc, *at[i], t[i - 1] + t[i + 1], t[i]) for i in range(1, len(t) - 1) if t[i] in shared.value]
            yield pd.DataFrame(out, columns=["doc_id", "line_no", "at", "x", "c"])

    seen = pages.mapInPandas(occurrences, "doc_id bigint, line_no int, at int, x string, c string")
    characters = seen.join(bad, ["x", "c"]).groupBy("doc_id", "line_no", "at").agg(F.max("d").alias("right"))
    characters = characters.select("doc_id", "line_no", F.col("line_no").alias("owner_no"), "at", F.lit(1).alias("size"), "right")
    corrections = in_line.union(over).union(characters).join(fixed.select("doc_id", "line_no"), ["doc_id", "line_no"], "left_anti")
    return fixed.union(marked), corrections


def damage(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, kind, note) of every damaged line of the pdf documents' content, lines split at LF from 0.

    kind is 'header', 'page_number', 'hyphen' or 'misread'; note is the joined word, or the corrections in their order,
    parted by blanks.  Null and empty contents have no lines; documents that show no damage give no rows; repeated
    documents give theirs again; an empty table gives an empty result; further columns don't take part."""
    marked, corrections = analysis(documents)
    by_line = corrections.groupBy("doc_id", F.col("owner_no").alias("line_no")).agg(F.array_sort(F.collect_list(F.struct("at", "right"))).alias("c"))
    note = F.array_join(F.transform("c", lambda x: x["right"]), " ")
    return marked.union(by_line.select("doc_id", "line_no", F.lit("misread").alias("kind"), note.alias("note")))


def repaired(documents: DataFrame) -> DataFrame:
    """(doc_id, content): the pdf documents as continuous paragraphs, without headers and page numbers, broken words
    joined and misread words and characters corrected, letters keeping their case.

    Blank lines part paragraphs.  Null contents stay null, contents without damage are only joined to paragraphs;
    repeated documents come out as often as they occur, an empty table gives an empty result."""
    pages = documents.where("loader = 'pdf'").select("doc_id", "content")
    marked, corrections = analysis(documents)
    nothing = [F.lit(-1).alias("at"), F.lit(0).alias("size"), F.lit("").alias("right")]
    each = marked.select("doc_id", "line_no", "kind", *nothing).union(corrections.select("doc_id", "line_no", F.lit("misread"), "at", "size", "right"))
    found = each.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "kind", "at", "size", "right")).alias("found"))

    @F.pandas_udf("string")
    def repair(content: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _repair(t, f if f is not None else []) for t, f in zip(content, found)], dtype=object)

    return pages.join(found, "doc_id", "left").select("doc_id", repair("content", "found").alias("content"))


def recase(wrong: str, right: str) -> str:
    """``right`` in place of ``wrong``: what both share stays as it stands, the rest takes the case of the word."""
    low = wrong.lower()
    a = next((i for i, (p, q) in enumerate(zip(low, right)) if p != q), min(len(low), len(right)))
    b = 0
    while b < min(len(low), len(right)) - a and low[-1 - b] == right[-1 - b]:
        b += 1
    middle = right[a : len(right) - b]
    letters = [c for c in wrong if c.isalpha()]
    if a == 0 and len(letters) and letters[0].isupper() and wrong[:1].isalpha():
        middle = middle[:1].upper() + middle[1:]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        middle = middle.upper()
    return wrong[:a] + middle + wrong[len(wrong) - b :]


def _repair(text: str, found) -> str:
    kinds: dict[int, set[str]] = {}
    edits: list[tuple[int, int, int, str]] = []
    for f in found:
        kinds.setdefault(int(f["line_no"]), set()).add(f["kind"])
        if f["kind"] == "misread":
            edits.append((int(f["line_no"]), int(f["at"]), int(f["size"]), f["right"]))
    out, length, glue, after_page = [], 0, "", False
    begins: dict[int, int] = {}
    last = ""
    for i, line in enumerate(text.split("\n")):
        if kinds.get(i, set()) & {"header", "page_number"}:
            after_page = True
            continue
        t = bare(line)
        if not t:
            if not after_page and out and last != "\n\n":
                out.append("\n\n")
                length, glue, last = length + 2, "", "\n\n"
            continue
        after_page = False
        spaced = not (last and _ends_wide.search(last) and _starts_wide.match(t))
        if glue and spaced:
            out.append(glue)
            length += len(glue)
        begins[i] = length
        broken = "hyphen" in kinds.get(i, ())
        last = t[:-1] if broken else t
        out.append(last)
        length, glue = length + len(last), "" if broken else " "
    whole = "".join(out)
    # wider corrections first, none over another
    done: list[tuple[int, int, str]] = []
    for line, at, size, right in sorted(edits, key=lambda e: (-e[2], e[0], e[1])):
        a = begins.get(line, -1) + at
        if line in begins and at >= 0 and all(a + size <= p or a >= q for p, q, _ in done):
            done.append((a, a + size, right))
    for a, e, right in sorted(done, reverse=True):
        whole = whole[:a] + recase(whole[a:e], right) + whole[e:]
    return whole.rstrip()
