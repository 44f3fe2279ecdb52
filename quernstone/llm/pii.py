"""Problem 10: personal information inside free text, found and replaced by typed placeholders.

A text is first normalised by transducers that keep the place of every character: full-width signs and look-alike
letters become ASCII, numbers spelled digit by digit become digits, and at/dot disguises become '@' and '.'.
Identifiers are found in the normalised text and mapped back to the source's characters.

Names are learned from the corpus: contexts that introduce a name give the tokens of names (in fixed-size tables of
hashed counts) and, for Chinese, the characters of family and given names; contexts that occur with several such names
become contexts themselves.  The second pass then finds full names, parts and nicknames everywhere.
"""

from __future__ import annotations

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

TOKEN_BITS = 20
#: Look-alike letters of other scripts, fixed values.
LOOKALIKE = dict(zip("аеорсухіјѕАВЕКМНОРСТХІЈЅαοΑΒΕΗΙΚΜΝΟΡΤΧ", "aeopcyxijsABEKMHOPCTXIJSaoABEHIKMNOPTX"))
#: Digits as words, fixed values.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "零": "0", "〇": "0", "幺": "1", "一": "1", "二": "2", "两": "2", "三": "3", "四": "4", "五": "5", "六": "6", "七": "7", "八": "8", "九": "9",
}
_wide = {c: chr(c - 0xFEE0) for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), 0xFF20, 0xFF0B, 0xFF0D, 0xFF0E, 0xFF3F)}
_spelled_run = regex.compile(r"(?i)(?:\b(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)\b[ -]?){7,}|[零〇幺一二两三四五六七八九]{7,}")
_spelled_one = regex.compile(r"(?i)zero|oh|one|two|three|four|five|six|seven|eight|nine|[零〇幺一二两三四五六七八九]")
_mixed = regex.compile(r"[A-Za-z][\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}][A-Za-z]")
_disguise = re.compile(r"\s?[\[({<]\s?(?:at|AT|At|艾特)\s?[\])}>]\s?|\s?[\[({<]\s?(?:dot|DOT|Dot|点)\s?[\])}>]\s?|(?<=[\w])\s(?:AT|at)\s(?=[\w.-]+\s(?:DOT|dot)\s)|(?<=\w)\s(?:DOT|dot)\s(?=\w)|(?<=\w)#at#(?=\w)")


#: Cheap signs that a transducer has something to do.
_foreign = re.compile("[Ͱ-ӿ]")
_disguised = ("(at", "[at", "{at", "<at", "( at", "[ at", "(AT", "[AT", "(At", "[At", "艾特", "#at#", " dot ", " DOT ", "[dot", "(dot", "[DOT", "(DOT", "(点", "[点")
_digit_words = re.compile("[零〇幺一二两三四五六七八九]{7}")
_number_words = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "One", "Two", "Three", "Seven", "Nine", "Zero")
_digit = re.compile("[0-9]")
_any_wide = re.compile("[０-９Ａ-Ｚａ-ｚ＠＋－．＿]")


def normalise(text: str) -> tuple[str, np.ndarray | None]:
    """The text for detection and, unless lengths are kept, each character's (start, end) in the source."""
    t = text.translate(_wide) if _any_wide.search(text) else text
    if _foreign.search(t) and _mixed.search(t):
        t = "".join(LOOKALIKE.get(c, c) for c in t)
    edits = []
    if any(x in t for x in _disguised):
        edits = [(m.start(), m.end(), "@" if "at" in m.group().lower() or "艾" in m.group() else ".") for m in _disguise.finditer(t)]
    if _digit_words.search(t) or sum(x in t for x in _number_words) >= 3:
        for m in _spelled_run.finditer(t):
            edits += [(m.start() + d.start(), m.start() + d.end(), SPELLED[d.group().lower()]) for d in _spelled_one.finditer(m.group())]
    if not edits:
        return t, None
    edits.sort()
    out, spans, last = [], [], 0
    for a, e, c in edits:
        if a < last:
            continue
        out.append(t[last:a])
        spans += [(i, i + 1) for i in range(last, a)]
        out.append(c)
        spans.append((a, e))
        last = e
    out.append(t[last:])
    spans += [(i, i + 1) for i in range(last, len(t))]
    return "".join(out), np.array(spans, dtype=np.int64).reshape(-1, 2)


EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*\s?@\s?(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9-])")
#: Words before a number that is no person's: orders, tickets, versions.  Fixed values.
NOT_BEFORE = re.compile(
    r"(?:订单号|流水号|单号|编号|版本|批号|注文番号|第|ISBN|ISSN|DOI|Order no\.|Order|Ticket|release|version|versión|ratio was|Commande n°|Pedido|Rechnung|Bestellung|Auftrag|Nr\.|n°|no\.|No\."
    r"|ऑर्डर संख्या|رقم الطلب|เลขที่ใบสั่ง|#)[\s:：]*$",
    re.IGNORECASE,
)
PHONE = re.compile(
    r"(?<![A-Za-z0-9.+/-])(?:"
    r"(?:[(（]?\+86[)）]?[ -]?)?1[3-9]\d[ -]?\d{4}[ -]?\d{4}"
    r"|(?:[(（]0\d{2,3}[)）][ -]?|0\d{2,3}-)\d{7,8}"
    r"|(?:\+1[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}|(?:\+1[ .-]?)?\d{3}[ .-][2-9]\d{2}[ .-]\d{4}"
    r"|\+44 ?(?:\(0\))?\d{2,4} ?\d{3,4} ?\d{3,4}|0\d{2} \d{4} \d{4}|07\d{3} ?\d{6}"
    r"|\+49 ?\d{2,4}[ /-]?\d{3,8}(?:[ -]\d{1,4})?|\(0\d{2,4}\) ?\d{3,8}(?:[ -]\d{1,5})?|0\d{2,4}[ /]\d{5,8}(?: ?-?\d{1,4})?|0\d{2,3} \d{5} \d{3}"
    r"|\+33 ?\d(?:[ .-]?\d{2}){4}|0\d(?:[ .-]\d{2}){4}"
    r"|\+34 ?\d{3}(?:[ .-]?\d{2,3}){2,3}|[6789]\d{2} \d{3} \d{3}|9\d-\d{3}-\d{4}"
    r"|\+81 ?\d{1,4}[ -]?\d{2,4}[ -]?\d{4}|0[789]0-\d{4}-\d{4}|0\d{1,3}\(\d{3,4}\)\d{4}|0\d-\d{4}-\d{4}"
    r"|0[89]\d-\d{3}-\d{4}|\+66 ?\d{1,2}[ -]?\d{3}[ -]?\d{3,4}"
    r"|\+966 ?\d{1,2} ?\d{3} ?\d{4}|\+91[ -]?\d{5}[ -]?\d{5}|\+91[ -]?\d{10}"
    r"|\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}"
    r")(?![A-Za-z0-9/]|[.-]\d)"
)
ID_NUMBER = re.compile(
    r"(?<![A-Za-z0-9.+/-])(?:"
    r"\d{6}[ -]?(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[ -]?\d{3}[\dXx]"
    r"|9?\d{3}[ -]\d{2}[ -]\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"
    r"|\d \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}|\d{13} \d{2}|\d{8}-?[A-HJ-NP-TV-Z]|[XYZ]-?\d{7}-?[A-Z]"
    r")(?![A-Za-z0-9/]|[.-]\d)"
)
#: Where a number may be: patterns of numbers are tried only there.
DIGIT_RUN = re.compile(r"(?<![A-Za-z0-9.+/-])(?:[+(（]{1,2}\d|\d|[A-Z]{2} ?\d|[XYZ]-?\d)[\d ()（）.+/-]{5,}")
#: Numbers that only their context makes an identity number; the group is the number.
ID_CONTEXT = re.compile(
    r"さんの番号は(\d{4}[- ]?\d{4}[- ]?\d{4})|(?:Steuer-?ID|Steuernummer|Ausweis(?:nummer)?|Ausweis-Nr\.|Personalausweis|Kennnummer|Versichertennummer)[^\d\n]{0,12}([A-Z]?\d[\dA-Z ]{7,14}\d)"
    r"|(?:आधार|Aadhaar)[^\d\n]{0,12}(\d{4}[ -]?\d{4}[ -]?\d{4})|(?:บัตรประชาชน|เลขประจำตัว)[^\d\n]{0,12}(\d[\d -]{11,16}\d)|(?:الهوية|رقم الإقامة)[^\d\n]{0,12}(\d{9,12})"
)
_H = r"一-鿿々"
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]+"
#: Postal addresses: what a text must hold for the pattern to be tried, and the pattern.
ADDRESSES = [
    (("市", "号"), re.compile(rf"[{_H}]{{2}}(?:省[{_H}]{{2}})?市(?:[{_H}]{{1,4}}?[区县镇])?[{_H}]{{1,6}}?(?:大道|路|街|巷|弄|胡同|道)\d+号(?:院)?(?:\d+(?:号楼|栋|幢|座|楼))?(?:\d+单元)?(?:\d+(?:室|户|房))?")),
    (("-", "市"), re.compile(rf"[{_H}]{{2,3}}[都道府県][{_H}]{{1,4}}?[市郡区][{_H}]{{1,6}}?\d+(?:-\d+){{1,3}}(?:[ 　]?[{_H}ァ-ヶー]+\d+号室)?")),
    (("-", "郡"), re.compile(rf"[{_H}]{{2,3}}[都道府県][{_H}]{{1,4}}?[市郡区][{_H}]{{1,6}}?\d+(?:-\d+){{1,3}}(?:[ 　]?[{_H}ァ-ヶー]+\d+号室)?")),
    ((" ",), re.compile(
        rf"(?<![A-Za-z0-9/-])\d{{1,5}}[A-Za-z]? (?:{_CAP} ){{1,3}}?(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Court|Ct|Drive|Dr|Way|Close|Place|Pl|Terrace|Row|Square|Sq|Crescent|Walk|Boulevard|Blvd)\b\.?"
        rf"(?:,? (?:#|Apt\.? ?|Unit |Flat )\w+)?(?:, (?!c/o){_CAP}(?: {_CAP})?(?: \d{{5}})?|,? \d{{5}})?"
    )),
    ((", ",), re.compile(rf"(?<![\w-])(?:(?:Am|An der|An den|Im|In der|Auf der|Auf dem|Zum|Zur|Beim|Hinter der|Unter den) )?[A-ZÄÖÜ][\wäöüß]+\.?(?:[- ](?:Straße|Str\.|Weg|Platz|Allee|Gasse))? \d{{1,4}} ?[a-z]?(?:, (?:\d\. OG|Whg\. \d+))?, \d{{5}} (?:(?:Bad|Sankt|St\.|Neu|Alt|Groß|Klein) )?[A-ZÄÖÜ][\wäöüß-]+")),
    ((", ",), re.compile(rf"(?<![A-Za-z0-9-])\d{{1,4}}(?: (?:bis|ter))?,? (?:rue|av\.|avenue|boulevard|bd\.?|place|chemin|allée|impasse|quai|cours) [^,\n\d]{{2,40}}, (?:(?:appt|bât)\.? \w+, )?\d{{5}} {_CAP}(?:[- ]{_CAP})?")),
    ((", ",), re.compile(rf"(?<![A-Za-zÀ-ÿ])(?:C/|[Cc]alle|Avda\.|Avenida|[Aa]vda\.|[Pp]laza|Pza\.|[Pp]aseo|Camino) ?(?:(?:de|del|de la|la|los|las) )*[A-ZÁÉÍÓÚÑ][^,\n\d]{{1,30}} \d{{1,4}}(?:, \d{{1,2}}\.?[ºª°] ?[A-Z]?)?, \d{{5}} [A-ZÁÉÍÓÚÑ][\w-]+")),
]

_PART = r"(?:von der|von dem|van der|van den|de la|del|von|zu|van|de|di|da|du|le|d['’])"
_FIRST = r"[A-ZÀ-ÖØ-Þ][^\W\d_]+(?:-[A-ZÀ-ÖØ-Þ][^\W\d_]+)?"
_LAST = r"(?:[OD]['’])?[A-ZÀ-ÖØ-Þ][^\W\d_]+(?:-[A-ZÀ-ÖØ-Þ][^\W\d_]+)?"
_FULL = (
    rf"(?:[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ'’-]{{1,}}(?: [A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ'’-]{{1,}})*, {_FIRST}(?: {_FIRST})?"
    rf"|{_FIRST}(?: {_FIRST})? (?:[A-Z]\. )?(?:{_PART} ?)?{_LAST}(?: {_LAST})?|(?:[A-Z]\. ){{1,2}}(?:{_PART} ?)?{_LAST})"
)
#: Contexts that introduce a name in languages of Latin script; the groups are names.  Fixed values.
LATIN_BEFORE = re.compile(
    rf"(?:Contact ?: |Contacto: |Ansprechperson: |Kontakt: |I am |I['’]m |c/o |My name is |Je m['’]appelle |Ich heiße |Me llamo )({_FULL})"
)
LATIN_AFTER = re.compile(r" (?:lives at|wohnt in|habite au|vive en|asked(?= [A-Z]))")
_before = re.compile(rf"({_FULL})$")
_after = re.compile(rf" ({_FULL}) to\b")


def latin_triggered(text: str) -> Iterator[tuple[int, int]]:
    """Places of names in the contexts that introduce one in languages of Latin script."""
    for m in LATIN_BEFORE.finditer(text):
        yield from _fields(m)
    for m in LATIN_AFTER.finditer(text):
        from_ = max(0, m.start() - 48)
        from_ = max(from_, text.rfind(". ", from_, m.start() - 3) + 2 if text.rfind(". ", from_, m.start() - 16) >= 0 else from_, text.rfind("\n", from_, m.start()) + 1)
        if (n := _before.search(text, from_, m.start())) is not None:
            yield n.span(1)
        if (n := _after.match(text, m.end())) is not None:
            yield n.span(1)


LATIN_TITLE = re.compile(
    rf"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Sr|Sra|Srta|M|Mme|Mlle|Hr|Fr)\.? ({_PART} ?)?({_LAST})|(?:Frau|Herr|Herrn|señora?|señorita|Madame|Monsieur|Mademoiselle|Don|Doña) ((?:{_PART} ?)?{_LAST}(?: {_LAST})?)"
)
#: The same for other scripts.  Fixed values.
OTHER_NAMES = [
    (("担当",), re.compile(rf"担当[:：]([{_H}]{{1,4}}[ 　]?[{_H}]{{1,3}})(?=[ 　\n])")),
    (("さん", "様"), re.compile(rf"(?<![{_H}])([{_H}]{{2,3}} ?[{_H}]{{1,4}}|[{_H}]{{2,4}})(?=さん|様)")),
    (("คุณ",), re.compile(r"คุณ([ก-๎]{2,} [ก-๎]{2,})(?= |$|\n)")),
    (("السيد", "الأستاذ", "الدكتور", "حضر"), re.compile(r"(?:السيدة?|الأستاذة?|الدكتورة?|حضرت?) ([ؠ-ي]+ [ؠ-ي]+)")),
    (("श्री", "सुश्री"), re.compile(r"(?:श्रीमती|सुश्री|श्री) ([ऀ-ॣ॰-ॿ]+ [ऀ-ॣ॰-ॿ]+)")),
]
HAN_TRIGGERS = re.compile(
    rf"(?:联系人[:：]|收件人|我叫|姓名[:：])([{_H}]{{2,3}})(?=[ ，。,.”\n]|$)"
)
_capital = re.compile(r"(?<![^\W\d_])[A-ZÀ-ÖØ-Þ][^\W\d_]*(?:['’-][A-ZÀ-ÖØ-Þ][^\W\d_]+)*")
_word = re.compile(r"(?<![A-Za-z])[a-z]{2,}")
_latin = re.compile(r"[A-ZÀ-Þ][\w'’.-]")
#: Verbs that only a person does, before which an ordinary word with a capital is a name.  Fixed values.
PERSON_VERB = re.compile(r" (?:came|always|just|never|said|asked|told|nodded|called|wrote|lives|left)\b")
PERSON_BEFORE = re.compile(r"(?:[Aa]sk for|[Tt]old|[Cc]alled|[Aa]sked|with|c/o) $")


#: Names that are words of a language too, fixed values: they count as names only beside a name or a person's verb.
AMBIGUOUS = {"hope", "will", "may", "grace", "faith", "joy", "rose", "april", "june", "august", "mark", "grant", "bill", "art", "dawn", "summer", "autumn", "constance", "patience", "sol", "luz", "claire", "pierre", "ernst"}


def token(word: str) -> int:
    return xxhash.xxh64_intdigest(word) & ((1 << TOKEN_BITS) - 1)


def _fields(m: re.Match) -> Iterator[tuple[int, int]]:
    for k in range(1, (m.re.groups or 0) + 1):
        if m.group(k):
            yield m.span(k)


class Lexicon:
    """Tables of fixed size: tokens of names and ordinary words in Latin script, characters of Chinese names, contexts."""

    def __init__(self):
        self.names = np.zeros(1 << TOKEN_BITS, dtype=np.int32)
        self.words = np.zeros(1 << TOKEN_BITS, dtype=np.int32)
        self.family = np.zeros(1 << 16, dtype=np.int32)
        self.given = np.zeros(1 << 16, dtype=np.int32)
        self.contexts: set[str] = set()
        self.seen: Counter = Counter()
        self._han = self._nick = None

    def learn(self, text: str) -> None:
        if _latin.search(text):
            self.seen.update(_word.findall(text))
            for a, e in latin_triggered(text):
                for w in _capital.findall(text[a:e]):
                    if len(w) > 1:
                        self.names[token(w.capitalize() if w.isupper() else w)] += 1
        for m in HAN_TRIGGERS.finditer(text):
            n = m.group(1)
            self.family[min(ord(n[0]), 65535)] += 1
            for c in n[1:]:
                self.given[min(ord(c), 65535)] += 1

    def settle(self) -> None:
        """Move the words counted so far into their table; memory stays bounded."""
        for w, n in self.seen.items():
            self.words[token(w)] += n
        self.seen.clear()

    def han(self) -> tuple[re.Pattern, re.Pattern] | None:
        """Patterns of a Chinese full name and of a nickname, from the learned characters."""
        if self._han is None:
            total = self.family.sum()
            least = max(2, total // 400)
            family = "".join(chr(c) for c in np.nonzero(self.family >= least)[0])
            given = "".join(chr(c) for c in np.nonzero(self.given >= least)[0])
            if not family or not given:
                self._han = ()
            else:
                self._han = (re.compile(f"[{family}][{given}]{{1,2}}"), re.compile(f"(?<![{_H}])[小阿老][{given}](?=[{_H}])(?![{given}])"))
        return self._han or None


def _sum_lexicons(texts: DataFrame) -> Lexicon:
    """The tables counted over all texts: each task counts its own, entries are summed; their number is bounded."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Lexicon()
        for b in batches:
            for t in b["text"]:
                own.learn(normalise(t)[0])
            if len(own.seen) > 500_000:
                own.settle()
        own.settle()
        for what in ("names", "words", "family", "given"):
            table = getattr(own, what)
            at = np.nonzero(table)[0]
            yield pd.DataFrame({"what": what, "bucket": at.astype(np.int32), "n": table[at]})

    sums = texts.mapInPandas(count, "what string, bucket int, n bigint").groupBy("what", "bucket").agg(F.sum("n").alias("n"))
    out = Lexicon()
    for what, g in sums.toPandas().groupby("what"):
        getattr(out, what)[g["bucket"].to_numpy()] = g["n"].to_numpy()
    return out


def _contexts(text: str, a: int, e: int) -> list[str]:
    left, right = text[max(0, a - 3) : a], text[e : e + 3]
    out = []
    if len(left) >= 2:
        out.append("<" + left)
        if left[-1].isalnum() or left[-2].isalnum():
            out.append("<" + left[-2:])
    if len(right) >= 2:
        out.append(">" + right)
        if right[0].isalnum() or right[1].isalnum():
            out.append(">" + right[:2])
    return out


def learn(texts: DataFrame) -> Lexicon:
    """The lexicon of a corpus (text), with the contexts that at least three different Chinese names share."""
    lexicon = _sum_lexicons(texts)
    if lexicon.han() is None:
        return lexicon
    shared = texts.sparkSession.sparkContext.broadcast(lexicon)

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pattern = shared.value.han()[0]
        for b in batches:
            rows = {
                (c, m.group())
                for t in b["text"]
                for t in [normalise(t)[0]]
                for m in pattern.finditer(t)
                for c in _contexts(t, m.start(), m.end())
                if any(x.isalnum() for x in c)
            }
            yield pd.DataFrame(list(rows), columns=["context", "name"])

    pairs = texts.mapInPandas(seen, "context string, name string").distinct()
    # a context of many names: its number is bounded by the share of all pairs that it must have
    counted = pairs.groupBy("context").agg(F.count("*").alias("n"))
    total = shared.value.family.sum()
    least = max(3, int(total) // 2000)
    lexicon.contexts = {r.context for r in counted.where(F.col("n") >= least).collect()}
    return lexicon


def find(text: str, lexicon: Lexicon) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every mention, in order and without overlaps, in places of ``text``."""
    t, spans = normalise(text)
    taken = bytearray(len(t) + 1)
    found: list[tuple[int, int, str]] = []

    def add(a: int, e: int, kind: str) -> None:
        if a < e and not taken.count(1, a, e):
            taken[a:e] = b"\1" * (e - a)
            found.append((a, e, kind))

    if "@" in t:
        for m in EMAIL.finditer(t):
            add(m.start(), m.end(), "email")
    if _digit.search(t):
        for m in ID_CONTEXT.finditer(t):
            for a, e in _fields(m):
                add(a, e, "id_number")
        for needed, pattern in ADDRESSES:
            if all(x in t for x in needed):
                for m in pattern.finditer(t):
                    add(m.start(), m.end(), "address")
        for run in DIGIT_RUN.finditer(t):
            from_, to = run.start(), min(len(t), run.end() + 3)
            for m in ID_NUMBER.finditer(t, from_, to):
                if m.start() < run.end() and not NOT_BEFORE.search(t[max(0, m.start() - 20) : m.start()]):
                    add(m.start(), m.end(), "id_number")
            for m in PHONE.finditer(t, from_, to):
                a = m.start()
                if a < run.end() and not NOT_BEFORE.search(t[max(0, a - 20) : a]):
                    add(a, m.end(), "phone")
    for literals, pattern in OTHER_NAMES:
        if any(x in t for x in literals):
            for m in pattern.finditer(t):
                for a, e in _fields(m):
                    add(a, e, "name")
    if (han := lexicon.han()) is not None:
        contexts = lexicon.contexts
        for m in HAN_TRIGGERS.finditer(t):
            if (n := han[0].match(t, m.start(1), m.end(1))) is not None:
                add(n.start(), n.end(), "name")
        for m in han[0].finditer(t):
            if not contexts.isdisjoint(_contexts(t, m.start(), m.end())):
                add(m.start(), m.end(), "name")
        for m in han[1].finditer(t):
            add(m.start(), m.end(), "name")
    _latin_names(t, lexicon, add)
    found.sort()
    if spans is not None:
        found = [(int(spans[a][0]), int(spans[e - 1][1]), kind) for a, e, kind in found]
    return found


def _latin_names(t: str, lexicon: Lexicon, add) -> None:
    if not _latin.search(t):
        return
    for a, e in latin_triggered(t):
        words = [w for w in _capital.findall(t[a:e]) if len(w) > 1]
        if any(_known(w, lexicon) for w in words):
            add(a, e, "name")
    for m in LATIN_TITLE.finditer(t):
        if m.group(2):
            if _known(m.group(2), lexicon):
                add(m.start(1) if m.group(1) else m.start(2), m.end(2), "name")
        elif m.group(3):
            a, e = m.span(3)
            words = list(_capital.finditer(t, a, e))
            if words and _known(words[-1].group(), lexicon):
                add(a, e, "name")
            elif len(words) > 1 and _known(words[0].group(), lexicon):
                add(a, words[0].end(), "name")
    tokens = list(_capital.finditer(t))
    i = 0
    while i < len(tokens):
        m = tokens[i]
        if not (_known(m.group(), lexicon) or (len(m.group()) == 1 and t[m.end() : m.end() + 2] == ". ")):
            i += 1
            continue
        # the longest run of known tokens, initials and particles
        j, end = i, m.end()
        sure = len(m.group()) > 1 and not _ordinary(m.group(), lexicon)
        known = len(m.group()) > 1
        while j + 1 < len(tokens):
            n = tokens[j + 1]
            gap = t[end : n.start()]
            if not re.fullmatch(rf"\.? (?:{_PART} ?)?|, ", gap):
                break
            if gap == ", " and not (tokens[j].group().isupper() and len(tokens[j].group()) > 2):
                break
            if gap.startswith(".") and len(tokens[j].group()) > 1:
                break
            if len(n.group()) == 1:
                if t[n.end() : n.end() + 2] != ". ":
                    break
            elif not _known(n.group(), lexicon):
                break
            else:
                sure = sure or not _ordinary(n.group(), lexicon)
                known = True
            j, end = j + 1, n.end()
        start = m.start()
        before = re.search(rf"(?:{_PART} )$|[Dd]['’]$", t[max(0, start - 8) : start])
        if before and known and j == i:  # before a given name a particle is a preposition
            start -= len(before.group())
        if known and j >= i and len(tokens[j].group()) > 1:
            if sure or PERSON_VERB.match(t, end) or PERSON_BEFORE.search(t[max(0, start - 12) : start]):
                add(start, end, "name")
        i = j + 1


def _known(word: str, lexicon: Lexicon) -> bool:
    kept = lexicon.__dict__.setdefault("_kept", {})
    yes = kept.get(word)
    if yes is None:
        if len(kept) > 200_000:
            kept.clear()
        yes = kept[word] = bool(len(word) > 1 and lexicon.names[token(word.capitalize() if word.isupper() and len(word) > 2 else word)] >= 2)
    return yes


def _ordinary(word: str, lexicon: Lexicon) -> bool:
    """Whether the corpus has the word in lower case too, more often than as a name introduced by its context."""
    return word.lower() in AMBIGUOUS or bool(lexicon.words[token(word.lower())] >= 2)


def mentions(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_char, end_char, kind) of every mention; places are code points, the end exclusive.

    kind is 'name', 'email', 'phone', 'id_number' or 'address'.  Null and empty texts have none; repeated rows give
    their mentions again; an empty table gives an empty result; long texts are read whole; further columns don't take
    part."""
    rows = spread(df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("text")).where("text is not null and text != ''"))
    shared = df.sparkSession.sparkContext.broadcast(learn(rows.select("text")))
    kind = df.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, a, e, what) for k, t in zip(b["k"], b["text"]) for a, e, what in find(t, shared.value)]
            yield pd.DataFrame(out, columns=["k", "start_char", "end_char", "kind"])

    return rows.mapInPandas(scan, f"k {kind}, start_char int, end_char int, kind string").withColumnRenamed("k", key)


#: Placeholders, by kind.
PLACEHOLDER = {"name": "[NAME]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]"}


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each mention replaced by its typed placeholder, everything else as it was."""
    out, last = [], 0
    for a, e, kind in found:
        out += [text[last:a], PLACEHOLDER[kind]]
        last = e
    return "".join([*out, text[last:]])


def redacted(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, n_mentions): every text with typed placeholders; null stays null, empty stays empty."""
    rows = spread(df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text")))
    shared = df.sparkSession.sparkContext.broadcast(learn(rows.select("text").where("text is not null and text != ''")))

    @F.pandas_udf("text string, n_mentions int")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [find(t, shared.value) if t else [] for t in texts]
            yield pd.DataFrame({"text": [redact(t, f) if t else t for t, f in zip(texts, found)], "n_mentions": [len(f) for f in found]})

    return rows.select(key, clean("text").alias("c")).select(key, "c.text", "c.n_mentions")
