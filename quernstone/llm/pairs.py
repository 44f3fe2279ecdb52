"""Problem 4: broken prompt and response pairs, each field with at most one defect.

Openings of responses (their first sentence) are clustered by the Jaccard similarity of their character shingles; all that
share one of their rarest shingles are compared, which leaves no link out, and a cluster is a connected component.  A cluster
that recurs across unrelated prompts is a template; the templates that a character n-gram model, started from seed refusals, finds
likelier as refusals than as prose, and whose answers say nothing else, are refusals, and the model is fitted again on
them.  An answer is a refusal when every sentence of it is.  Copies, languages and broken ends are checked directly:
a copy by what is left of the answer without the title, the language by scripts and by n-gram models of the languages
written in Latin script, the end by how often the last characters end a text when they occur anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.ngram import END, PORTION, START, Model, codes, count_labels, fit, hashes, portions, train
from quernstone.session import cut, spread

#: Stand-ins for no value, fixed values.
NOTHING = {"none", "null", "nil", "na", "nan", "n a", "无", "暂无", "空", "没有", "undefined", "empty", "tbd", "todo", "なし", "keine", "aucun", "ninguno", "leer", "vide", "vacío"}
#: What labels a copied title may carry, fixed values: letters and digits only, lower case.
LABELS = regex.compile(
    r"(q|a|qa|re|fwd|question|questions|answer|title|prompt|youasked|yousaid|yourquestionis|yourquestion|theuserasks|frage|antwort|titel|siefragten|réponse|reponse|titre|pregunta|respuesta"
    r"|título|质问|質問|回答|答|问|問|问题|標題|标题|题目|你的问题是|您的问题是|您问|你问|这是您的问题|这是你的问题|原题|答复|回复|以上是问题|タイトル|คำถาม|سؤال|प्रश्न)*"
)
#: Seed refusals, fixed values.
REFUSALS = [
    "很抱歉，我无法回答这个问题。", "对不起，我不能就此提供内容。", "抱歉，我没有办法给出建议。", "作为一个语言模型，我不被允许谈论这类内容。", "根据规定，我只能拒绝这个请求。",
    "这超出了我能讨论的范围。", "恕我难以给出任何意见。", "这个问题我就不作答了，感谢理解。", "请咨询专业人士。", "换一个话题好吗？", "我们聊点别的吧！", "如有紧急情况请联系身边的人。", "不好意思，我无法回答。", "不好意思，系统只能拒绝这个请求。", "系统暂时不便回应此类话题。", "您好！", "感谢提问，但本助手无法回答。", "很遗憾，系统无法提供帮助。",
    "I'm sorry, but I can't help with that.", "I cannot answer this.", "Unfortunately, this assistant cannot answer this.", "As a language model, I am unable to comment on this.",
    "I must decline to discuss this.", "This is not something I can comment on.", "Please talk to a professional.", "Is there anything else?", "Let's pick another subject.", "Apologies: I am not able to help with this request.", "Thanks for asking; however, I won't answer this.", "Under my guidelines I can't help with that.",
    "Leider kann ich dabei nicht helfen.", "Leider muss ich sagen: zu dieser Frage darf ich nichts sagen.", "Diese Anfrage lehne ich ab.", "Entschuldigung, dabei kann dieser Dienst nicht helfen.", "Bitte wenden Sie sich an eine Fachstelle.",
    "Désolé, je ne peux pas répondre à cette question.", "Il m'est impossible de traiter ce sujet.", "Adressez-vous à un professionnel.", "Je regrette, ce service ne peut pas vous aider.",
    "Lo siento, no puedo responder a esta pregunta.", "Por desgracia, este asistente no puede ayudar con eso.", "No me es posible responder.", "Consulte a un profesional.",
    "申し訳ありませんが、この質問にはお答えできません。", "恐れ入りますが、その内容についてはお手伝いできかねます。", "助言は控えさせていただきます。", "専門の窓口にご相談ください。",
    "ขออภัย ฉันไม่สามารถตอบคำถามนี้ได้", "عذرًا، لا أستطيع الإجابة عن هذا السؤال.", "क्षमा करें, मैं इस प्रश्न का उत्तर नहीं दे सकता।",
]
#: Ends after which a text goes on: abbreviations that introduce something, fixed values.
OPEN_END = regex.compile(
    r"(?:^|[\s(（])(?:(?-i:No|Nos)|e\.g|i\.e|approx|incl|vol|vols|fig|figs|sec|p|pp|vs|cf|dr|mr|mrs|ms|prof|st|z\. ?b|d\. ?h|u\. ?a|nr|abb|kap|bd|vgl|fr|hr|ca|bzw|p\. ?ex|env|chap|mme|c\.-à-d|p\. ?ej|aprox|pág|cap|sr|sra|srta)\.$",
    regex.IGNORECASE,
)
TERMINAL = "。！？!?….．｡؟۔।॥"
CLOSING = "\"'”’“」』）)]】》»"
PAIRS = {"“": "”", "「": "」", "『": "』", "«": "»", "„": "“", "（": "）", "《": "》", "【": "】"}
_invisible = regex.compile(r"[\p{Z}\p{C}\s]+")
_decorated = regex.compile(r"[\p{So}\p{Sk}\p{Mn}‍️\s]")
_decoration = regex.compile(r"[\p{So}\p{Sk}\p{Mn}‍️\s]+$")
_link = regex.compile(r"(?:https?://|www\.)\S+$")
_sentence = regex.compile(
    r"(?:[^。！？!?…．｡؟۔।\n.]++|\.(?!\s|$)|(?<![^\W\d_]{2}|[)”»])\.)*+(?:\.|[。！？!?…．｡؟۔।]+|\n+|$)[\"”’」』）)»]*"
)
_bracketed = regex.compile(r"^\s*[(（][^()（）]{0,40}(?:私信|消息|messages?)[^()（）]{0,20}[)）]\s*")
_scripts = {
    "ja": regex.compile(r"[\p{Hiragana}\p{Katakana}]"), "zh": regex.compile(r"\p{Han}"), "th": regex.compile(r"\p{Thai}"),
    "ar": regex.compile(r"\p{Arabic}"), "hi": regex.compile(r"\p{Devanagari}"), "ko": regex.compile(r"\p{Hangul}"),
    "ru": regex.compile(r"\p{Cyrillic}"), "latin": regex.compile(r"\p{Latin}+"),
}
_ascii_letter = regex.compile("[A-Za-z]")
ENDS_BITS = 20
#: log2 of the number of counts of shingles, and how many openings of a shingle meet in one piece.
GRAM_BITS = 18
BLOCK = 1024


#: Patterns of the helpers below.
_many_letters = regex.compile(r"(?:[^\p{L}\p{N}]*+[\p{L}\p{N}]){16}")  # more than a stand-in for no value has
_not_letter = regex.compile(r"[^\p{L}\p{N}\p{M}]+")
_opener = regex.compile("[" + regex.escape("".join(PAIRS)) + "]")
_kept = regex.compile(r"[\p{L}\p{N}\p{M}]")
_label_firsts = {label[0] for label in LABELS.pattern.strip("()*").split("|")}
_not_word = regex.compile(r"[\p{Z}\p{C}\p{P}\p{S}\s]+")
_letter_or_digit = regex.compile(r"[\p{L}\p{N}]")
_symbol = regex.compile(r"\p{So}")
_latin_end = regex.compile(r"(?<=[^\W\d_]{2}|[)”»])\.[”»\"']*\s")
_not_latin_text = regex.compile(r"[^\p{L}' ]+")
_digits = regex.compile(r"\p{N}+")


def letters(text: str) -> str:
    return _not_letter.sub("", text.casefold())


def is_empty(text: str) -> bool:
    """Nothing but blanks, invisible characters, punctuation or a stand-in for no value."""
    if _many_letters.match(text):
        return False
    t = _not_word.sub(" ", text if _letter_or_digit.search(text) else _symbol.sub("x", text)).strip()
    return not t or t.casefold() in NOTHING or t.casefold().replace(" ", "") in NOTHING


def is_copy(title: str, text: str) -> bool:
    """Only the title, once or more often, perhaps with a label or changed spacing, case or end mark."""
    titles, firsts = _title_letters(title)
    folded = text.casefold()
    m = _kept.search(folded)
    if m is None or m.group() not in firsts:
        return False
    body = _not_letter.sub("", folded)
    for t in titles:
        if t in body and LABELS.fullmatch(body.replace(t, "")):
            return True
    return False


@lru_cache(4096)
def _title_letters(title: str) -> tuple[list[str], set[str]]:
    """The letters of a title, with and without a bracketed remark, and what a copy of it can begin with."""
    titles = [t for t in dict.fromkeys((letters(title), letters(_bracketed.sub("", title)))) if t]
    return titles, {t[0] for t in titles} | _label_firsts if titles else set()


def each_sentence(text: str) -> Iterator[str]:
    return (s for s in (m.group().strip() for m in _sentence.finditer(text)) if letters(s))


def sentences(text: str) -> list[str]:
    return list(each_sentence(text))


_script_names = (*_scripts, None)
_script_numbers = np.full(0x110000, 255, dtype=np.uint8)


def scripts(texts: list[str]) -> list[str | None]:
    """The language that the scripts of each text name, 'latin' for one of several, None without letters."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(c):
        return [None] * len(texts)
    for x in np.unique(c[_script_numbers[c] == 255]).tolist():
        _script_numbers[x] = next((i for i, p in enumerate(_scripts.values()) if p.match(chr(x))), len(_scripts))
    kind, own = _script_numbers[c], np.repeat(np.arange(len(texts)), size)
    latin = list(_scripts).index("latin")
    # of Latin script, words count
    counted = kind < len(_scripts)
    counted[1:] &= (kind[1:] != latin) | (kind[:-1] != latin) | (own[1:] != own[:-1])
    n = np.bincount(own[counted] * len(_scripts) + kind[counted], minlength=len(texts) * len(_scripts)).reshape(-1, len(_scripts))
    ja, zh = list(_scripts).index("ja"), list(_scripts).index("zh")
    n[:, latin] *= 2  # a word counts like two characters of a script without spaces
    mixed = (n[:, ja] > 0) & (n[:, ja] * 8 >= n[:, zh])
    chinese = (n[:, zh] * 2 > size) & (n[:, ja] == 0)
    n[mixed, ja] += n[mixed, zh]
    n[mixed, zh] = 0
    best = np.where(chinese, zh, np.where(n.any(1), n.argmax(1), len(_scripts)))
    return [_script_names[i] for i in best.tolist()]


def script(text: str) -> str | None:
    """The same of one text."""
    if text.isascii():
        return "latin" if _ascii_letter.search(text) else None
    return scripts([text])[0]


def undecorated(text: str) -> str:
    return _decoration.sub("", text) if _decorated.match(text[-1:]) else text


def tail(text: str) -> str:
    """What follows the last end of a sentence; '' where the text ends with one.  Emoji and a link at the end don't count."""
    t = undecorated(text)
    if (m := _link.search(t)) is not None:
        return ""
    body = t.rstrip(CLOSING)
    if body and body[-1] in TERMINAL:
        if body[-1] == "." and OPEN_END.search(body[-24:]):
            return body[-24:]
        return ""
    last = max((t.rfind(c) for c in TERMINAL if c != "."), default=-1)
    for m in _latin_end.finditer(t):
        last = max(last, m.end() - 1)
    last = max(last, t.rfind("\n"))
    return t[last + 1 :].strip(CLOSING + " \t\n　")


def unclosed(text: str) -> bool:
    """Whether the last paragraph ends inside a quotation or bracket."""
    t = text[text.rstrip().rfind("\n") + 1 :]
    if not _opener.search(t):
        return False
    stack: list[str] = []
    for i, c in enumerate(t):
        if stack and c == stack[-1]:
            stack.pop()
        elif c in PAIRS and not (c == "“" and stack):
            stack.append(PAIRS[c])
    return bool(stack)


class Judge:
    """All checks of one field."""

    def __init__(self, languages: dict[str, Model], refusal: dict[str, Model], ends: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.languages, self.refusal, self.ends = languages, refusal, ends
        self.asked: dict[str, tuple[str | None, dict[str, float]]] = {}
        self.said: dict[str, tuple[str | None, dict[str, float]]] = {}

    def latin(self, text: str) -> dict[str, float]:
        c, _ = codes([_not_latin_text.sub(" ", text.lower())])
        h = hashes(c)
        return {k: float(m.logp(c, h)[:-1].sum()) for k, m in self.languages.items()}

    def prepare(self, texts: list[str], titles: list[str | None]) -> None:
        """Tell the scripts of all texts, and score the new titles, and the texts of titles, in Latin script at once."""
        if len(self.asked) > 50_000:
            self.asked.clear()
        new = [t for t in dict.fromkeys(titles) if t and t not in self.asked]
        bare = [_bracketed.sub("", t) for t in new]
        self.asked |= zip(new, self._languages(bare, scripts(bare), whole=False))
        self.said = {t: (s, {}) for t, s in zip(texts, scripts(texts))}
        # only languages in Latin script are compared by scores
        latin = list({x: None for x, t in zip(texts, titles) if t and self.said[x][0] == "latin" and self.asked[t][1]})
        self.said |= zip(latin, self._languages(latin, ["latin"] * len(latin)))

    def _languages(self, texts: list[str], told: list[str | None], whole: bool = True) -> list[tuple[str | None, dict[str, float]]]:
        """The language of each text of a script that is told, with its scores, of its end too if ``whole``, where that is Latin."""
        out: list[tuple[str | None, dict[str, float]]] = [(s, {}) for s in told]
        latin = [i for i, s in enumerate(told) if s == "latin"]
        if not latin or not self.languages:
            return out
        c, begin = codes([_not_latin_text.sub(" ", texts[i].lower()) for i in latin])
        h = hashes(c)
        real = (c[2:] != START) & (whole | (c[2:] != END))
        sums = {k: np.add.reduceat(np.where(real, m.logp(c, h), 0.0), begin - 2) for k, m in self.languages.items()}
        for i, x in zip(latin, zip(*(x.tolist() for x in sums.values()))):
            scores = dict(zip(sums, x))
            out[i] = (max(scores, key=scores.get), scores)
        return out

    def language(self, text: str) -> tuple[str | None, dict[str, float]]:
        s = script(text)
        if s != "latin" or not self.languages:
            return s, {}
        scores = self.latin(text)
        return max(scores, key=scores.get), scores

    def other_language(self, title: str, text: str) -> bool:
        """The whole answer in another language than the title: no sentence of it in the title's."""
        if (known := self.asked.get(title)) is None:
            if len(self.asked) > 50_000:
                self.asked.clear()
            known = self.asked[title] = self.language(_bracketed.sub("", title))
        want, asked = known
        have, said = self.said.get(text) or self.language(text)
        if want is None or have is None or want == have:
            return False
        if asked and said:  # two languages in Latin script: both must be sure
            if said[have] - said[want] < 8 or asked[want] - max(v for k, v in asked.items() if k != want) < 3:
                return False
        for s in sentences(text):
            k, scores = self.language(s)
            if k == want and (not scores or len(s) >= 25) and len(letters(s)) >= 4:
                return False
        return True

    def refusal_ratios(self, texts: list[str]) -> list[float]:
        """How much likelier each answer is as refusals than as prose; very low where a sentence of it refuses nothing."""
        if set(self.refusal) != {"refusal", "prose"}:
            return [-99.0] * len(texts)
        # every sentence must refuse, so that the rest is read only where the first does
        rest = [each_sentence(t) for t in texts]
        first = [next(x, None) for x in rest]
        openings = list({x: None for x in first if x is not None})
        ratios = {x: float(r[0]) for x, r in zip(openings, self._sentence_ratios([[x] for x in openings]))}
        kept = [i for i, x in enumerate(first) if x is not None and ratios[x] > -3]
        more = [list(rest[i]) for i in kept]
        out = [-99.0] * len(texts)
        for i, p, r in zip(kept, more, self._sentence_ratios(more)):
            if (r > -3).all() and sum(len(letters(x)) for x in [first[i], *p]) >= 6:
                out[i] = ratios[first[i]] + float(r.sum())
        return out

    def _sentence_ratios(self, parts: list[list[str]]) -> list[np.ndarray]:
        """How much likelier each sentence is as a refusal than as prose."""
        flat = [plain(s) for p in parts for s in p]
        if not flat:
            return [np.zeros(0)] * len(parts)
        c, begin = codes(flat)
        h = hashes(c)
        ratio = np.clip(self.refusal["refusal"].logp(c, h) - self.refusal["prose"].logp(c, h), -5, 5)
        return np.split(np.add.reduceat(ratio, begin - 2), np.cumsum([len(p) for p in parts])[:-1])

    def refuses(self, texts: list[str]) -> list[bool]:
        """Which answers consist of refusing sentences."""
        return [r > 0 for r in self.refusal_ratios(texts)]

    def breaks_off(self, text: str) -> bool:
        """Whether the text ends inside its last sentence."""
        t = tail(text)
        if not t:
            return unclosed(undecorated(text))
        end = t[-4:] if len(t) >= 4 else ("\n" + t)[-4:]
        at = end_hash(end)
        everywhere, at_end, at_blank = (float(x[at]) for x in self.ends)
        if script(t) in ("th",):
            return at_blank < 0.5 * everywhere or at_blank < 2
        return at_end < 3 or at_end < 0.5 * everywhere


def plain(text: str) -> str:
    return _digits.sub("0", text.lower()).strip()


_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
_M64 = (1 << 64) - 1
_BLANKS = np.frombuffer(" \t\n\r\u00a0\u3000".encode("utf-32-le"), dtype=np.uint32)


def end_hash(end: str) -> int:
    """Bucket of four characters."""
    h = sum(ord(c) * m for c, m in zip(end, _MIX)) & _M64
    return ((h ^ (h >> 29)) * _MIX[0] & _M64) >> (64 - ENDS_BITS)


def end_hashes(c: np.ndarray) -> np.ndarray:
    """Buckets of all neighbouring four characters of an array of code points."""
    c = c.astype(np.uint64)
    h = c[:-3] * np.uint64(_MIX[0]) + c[1:-2] * np.uint64(_MIX[1]) + c[2:-1] * np.uint64(_MIX[2]) + c[3:] * np.uint64(_MIX[3])
    return (((h ^ (h >> np.uint64(29))) * np.uint64(_MIX[0])) >> np.uint64(64 - ENDS_BITS)).astype(np.int64)


def _end_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each 4 characters' bucket: occurrences anywhere, as the last of a tail, and before a blank, over distinct texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((3, 1 << ENDS_BITS), dtype=np.int64)
        for b in batches:
            for t in b["text"]:
                last = tail(t)
                if last:
                    sums[1, end_hash(last[-4:] if len(last) >= 4 else ("\n" + last)[-4:])] += 1
            for texts in portions(b["text"].tolist()):
                # many texts in one array, each with a blank after it; no four characters over two texts count
                bodies = [undecorated(t) + " " for t in texts]
                c = np.frombuffer("".join(bodies).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                if len(c) > 4:
                    owner = np.repeat(np.arange(len(bodies)), [len(t) for t in bodies])
                    within = owner[:-4] == owner[4:]
                    h = end_hashes(c[:-1])[within]
                    sums[0] += np.bincount(h, minlength=1 << ENDS_BITS)
                    sums[2] += np.bincount(h[np.isin(c[4:][within], _BLANKS)], minlength=1 << ENDS_BITS)
        for what in range(3):
            at = np.nonzero(sums[what])[0]
            yield pd.DataFrame({"what": what, "bucket": at.astype(np.int32), "n": sums[what][at]})

    got = texts.mapInPandas(count, "what int, bucket int, n bigint").groupBy("what", "bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((3, 1 << ENDS_BITS), dtype=np.int32)
    out[got["what"].to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out[0], out[1], out[2]


def openings(rows: DataFrame) -> DataFrame:
    """(question_id, text, opening): the first sentence of each answer, lower case, numbers as 0."""

    @F.pandas_udf("string")
    def opening(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([plain(next((x for m in _sentence.finditer(t) if _letter_or_digit.search(x := m.group().strip())), "")) for t in texts])

    return rows.select("question_id", "text", opening("text").alias("opening")).where("length(opening) > 3")


def _shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct three-character shingles of each text as (number of the text, code points in one number), in this order."""
    parts = [np.frombuffer(t.ljust(3, "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.concatenate(parts).astype(np.int64)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    within = owner[:-2] == owner[2:]
    gram = ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[within]
    values, number = np.unique(gram, return_inverse=True)
    both = np.sort(owner[:-2][within] * len(values) + number)
    both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    owner, number = np.divmod(both, len(values))
    return owner, values[number]


def _gram_bucket(gram: np.ndarray) -> np.ndarray:
    return ((gram.astype(np.uint64) * np.uint64(_MIX[0])) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)


def _alike(roots: np.ndarray, row: np.ndarray, gram: np.ndarray, least: float) -> np.ndarray:
    """Of texts with the shingles (row, gram): the first text that each is linked with, by a root in common or a Jaccard
    similarity of ``least``."""
    n = len(roots)
    size = np.bincount(row, minlength=n).astype(np.float64)
    seen, at, often = np.unique(gram, return_inverse=True, return_counts=True)
    column = np.cumsum(often > 1) - 1
    shared = often[at] > 1
    row, at = row[shared], column[at[shared]]
    both = np.zeros((n, n), dtype=np.float64)
    for begin in range(0, int(column[-1]) + 1, 4096):
        here = (at >= begin) & (at < begin + 4096)
        x = np.zeros((n, 4096 if begin + 4096 <= column[-1] else int(column[-1]) + 1 - begin), dtype=np.float32)
        x[row[here], at[here] - begin] = 1
        both += x @ x.T
    near = (both / (size[:, None] + size[None, :] - both) >= least) | (roots[:, None] == roots[None, :])
    label = np.arange(n)
    while True:
        low = np.minimum(label, np.where(near, label[None, :], n).min(1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def cluster_openings(opened: DataFrame, least: float = 0.5) -> DataFrame:
    """(opening, cluster, n_prompts): clusters of the distinct openings of (question_id, opening).

    A cluster is a connected component, named by its smallest id, of the links between all openings whose sets of
    three-character shingles have a Jaccard similarity of ``least``; no link is left out.  Two such sets share one of the
    rarest 1 - ``least`` of their shingles and one more, in one order of all shingles, so that openings meet by these; those
    that more than BLOCK openings hold are met by pairs of blocks.  A task passes over openings that it has linked already."""
    named = opened.select("question_id", "opening", F.xxhash64("opening").alias("id"))
    counted = cut(named.groupBy("id").agg(F.first("opening").alias("opening"), F.countDistinct("question_id").alias("prompts")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(1 << GRAM_BITS, dtype=np.int64)
        for b in batches:
            sums += np.bincount(_gram_bucket(_shingles(b["opening"].tolist())[1]), minlength=1 << GRAM_BITS)
        at = np.nonzero(sums)[0]
        yield pd.DataFrame({"bucket": at, "n": sums[at]})

    got = counted.select("opening").mapInPandas(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(1 << GRAM_BITS, dtype=np.int64)
    often[got["bucket"].to_numpy()] = got["n"].to_numpy()
    shared = opened.sparkSession.sparkContext.broadcast(often)

    def meetings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            owner, gram = _shingles(b["opening"].tolist())
            n = shared.value[_gram_bucket(gram)]
            order = np.lexsort((gram, n, owner))
            owner, gram, n = owner[order], gram[order], n[order]
            size = np.bincount(owner, minlength=len(b))
            place = np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
            kept = (place <= (size - np.ceil(least * size - 1e-9))[owner]) & (n > 1)
            owner, gram, n = owner[kept], gram[kept], n[kept]
            # openings with the shingle are at most n; with m blocks of them each pair of blocks meets
            m = -(-n // BLOCK)
            block = np.where(m > 1, b["id"].to_numpy()[owner] % m, 0)
            copies = np.maximum(m - 1, 1)
            row = np.repeat(np.arange(len(owner)), copies)
            other = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            block, other = block[row], np.where(m[row] > 1, other + (other >= block[row]), 0)
            out = {"gram": gram[row], "low": np.minimum(block, other), "high": np.maximum(block, other)}
            yield pd.DataFrame({**out, "id": b["id"].to_numpy()[owner[row]], "opening": b["opening"].to_numpy()[owner[row]]})

    place = ["gram", "low", "high"]

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, int] = {}
        up = np.zeros(0, dtype=np.int64)

        def roots(members: np.ndarray) -> np.ndarray:
            top = up[members]
            while (up[top] != top).any():
                top = up[top]
            up[members] = top
            return top

        def link(rows: pd.DataFrame) -> None:
            nonlocal up
            number, ids = pd.factorize(rows["id"].to_numpy())
            numbers = np.array([known.setdefault(i, len(known)) for i in ids.tolist()], dtype=np.int64)
            up = np.concatenate([up, np.arange(len(up), len(known))])
            texts = rows["opening"].to_numpy()[np.unique(number, return_index=True)[1]].tolist()
            owner, gram = _shingles(texts)
            begin = np.searchsorted(owner, np.arange(len(texts) + 1))
            keys = rows[place].to_numpy()
            starts = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(1))[0] + 1).tolist(), len(rows)]
            for a, e in zip(starts, starts[1:]):
                members = number[a:e]
                if e - a < 2 or ((top := roots(numbers[members])) == top[0]).all():
                    continue
                row = np.repeat(np.arange(e - a), begin[members + 1] - begin[members])
                label = _alike(top, row, np.concatenate([gram[begin[k] : begin[k + 1]] for k in members.tolist()]), least)
                low = np.full(e - a, len(up))
                np.minimum.at(low, label, top)
                up[top] = low[label]

        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b)
            # openings come in many shingles: theirs are made once in so many rows
            if sum(map(len, held)) >= 50_000:
                rows = pd.concat(held, ignore_index=True)
                end = int(np.argmax((rows[place] == rows[place].iloc[-1]).all(axis=1).to_numpy()))
                held = [rows.iloc[end:]]
                if end:
                    link(rows.iloc[:end])
        if sum(map(len, held)):
            link(pd.concat(held, ignore_index=True))
        ids = np.array(list(known), dtype=np.int64)
        yield pd.DataFrame({"id": ids, "first": ids[roots(np.arange(len(ids)))] if len(ids) else ids})

    meeting = counted.select("id", "opening").mapInPandas(meetings, "gram bigint, low bigint, high bigint, id bigint, opening string")
    links = meeting.repartition(*place).sortWithinPartitions(*place).mapInPandas(met, "id bigint, first bigint").where("id != first")
    labels = _components(counted.select("id"), links)
    clustered = counted.join(labels, "id").select("opening", "cluster", "prompts")
    sizes = clustered.groupBy("cluster").agg(F.sum("prompts").alias("n_prompts"))
    return clustered.join(sizes, "cluster").select("opening", "cluster", "n_prompts")


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, cluster): connected components of (id, first) by the smallest label, to a fix-point."""
    # both directions of a link from one row: a union would make the links twice
    ways = F.array(F.struct("id", F.col("first").alias("to")), F.struct(F.col("first").alias("id"), F.col("id").alias("to")))
    both = cut(links.select(F.explode(ways).alias("way")).select("way.id", "way.to").distinct())
    labels = nodes.select("id", F.col("id").alias("cluster"))
    while True:
        offered = both.join(labels.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("cluster").alias("low"))
        new = cut(labels.join(offered, "id", "left").select("id", F.least("cluster", "low").alias("cluster"), (F.col("low") < F.col("cluster")).alias("moved")))
        labels = new.select("id", "cluster")
        if new.where("moved").isEmpty():
            return labels


def _refusal_models(rows: DataFrame) -> dict[str, Model]:
    """n-gram models of refusals and prose, the refusals being answers, of any length, whose opening's cluster refuses."""
    opened = cut(openings(rows))
    seeds = [plain(s) for s in REFUSALS]
    number = lambda c: F.regexp_replace(F.lower(c), r"\p{N}+", "0")
    everything = count_labels(rows.select(F.lit("all").alias("label"), number(F.col("text")).alias("text"))).get("all")
    if everything is None:
        return {}

    def refit(labelled: DataFrame, weight: int) -> dict[str, Model]:
        """Models of (label, text): the few texts that aren't prose are counted, prose is all the rest."""
        few = count_labels(labelled.select(F.coalesce("label", F.lit("neither")).alias("label"), number(F.col("text")).alias("text")).where("label != 'prose'"))
        prose = [t - sum(f[order] for f in few.values()) for order, t in enumerate(everything)]
        return fit({"prose": prose, **{k: t for k, t in few.items() if k == "refusal"}}, {"refusal": seeds * weight})

    first = fit({"prose": everything}, {"refusal": seeds * 5})
    shared = rows.sparkSession.sparkContext.broadcast(first)

    @F.pandas_udf("double")
    def ratio(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            sums = [np.zeros(0)]
            for part in portions(texts.tolist(), PORTION):
                c, begin = codes(part)
                h = hashes(c)
                r = np.clip(shared.value["refusal"].logp(c, h) - shared.value["prose"].logp(c, h), -5, 5)
                sums.append(np.add.reduceat(r, begin - 2))
            yield pd.Series(np.concatenate(sums))

    clusters = cut(cluster_openings(opened))
    scored = clusters.withColumn("ratio", ratio("opening"))
    templates = scored.groupBy("cluster").agg(
        F.avg("ratio").alias("mean"), F.first("n_prompts").alias("n_prompts"), F.max("ratio").alias("best")
    )
    refusing = scored.join(templates.where("n_prompts >= 2 and (mean > 0 or best > 15)").select("cluster"), "cluster").select("opening")
    own = scored.where("ratio > 0").select("opening")
    refusing = refusing.union(own).distinct().withColumn("refusing", F.lit(True))
    labelled = opened.join(refusing, "opening", "left").withColumn("whole", ratio(number(F.col("text"))))
    # what is neither clearly the one nor the other teaches neither model
    labelled = labelled.select(
        F.when(F.col("refusing") & (F.col("whole") > 0), F.lit("refusal"))
        .when(F.col("refusing").isNull() & (F.col("whole") < -5), F.lit("prose"))
        .alias("label"),
        "text",
    )
    models = refit(labelled, 2)
    for _ in range(2):  # the templates' variants that the last fit recognises teach the next one
        models = refit(_relabelled(rows, models), 1)
    return models


def _relabelled(rows: DataFrame, models: dict[str, Model]) -> DataFrame:
    """(label, text) of all answers by the last models; answers near the threshold have no label."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge({}, shared.value, ())
        for b in batches:
            texts = b["text"].tolist()
            ratios = judge.refusal_ratios(texts)
            labels = ["refusal" if r > 0 else None if r > -8 else "prose" for r in ratios]
            yield pd.DataFrame({"label": labels, "text": texts})

    return rows.select("text").mapInPandas(label, "label string, text string")


def judge_pairs(answers: DataFrame, questions: DataFrame, bad_titles: DataFrame, documents: DataFrame) -> DataFrame:
    """(answer_id, field_name, defect) of every defective field of answers.draft and answers.edited.

    Each field that isn't null is judged alone: 'empty', 'copy', 'refusal', 'language' or 'truncated', the first that
    fits.  Copies and languages aren't judged where the question is missing or its title is among ``bad_titles``
    (question_id).  Null fields give no row; answers saved twice are judged twice; an empty table gives an empty result;
    long answers are read whole; further columns don't take part.  ``documents`` (lang, text) trains the languages."""
    parts = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in ("draft", "edited")])
    rows = answers.select(F.col("id").alias("answer_id"), "question_id", F.explode(parts).alias("f")).select("answer_id", "question_id", "f.*")
    bad = bad_titles.select(F.col("question_id").alias("id")).distinct()
    titles = questions.select(F.col("id"), F.col("title")).join(bad, "id", "left_anti").withColumnRenamed("id", "question_id")
    rows = cut(spread(rows.where("text is not null").join(titles, "question_id", "left")))
    lang = F.lower(F.substring("lang", 1, 2))
    languages = train(
        documents.where(lang.isin("en", "de", "fr", "es")).select(
            lang.alias("label"), F.regexp_replace(F.lower("text"), r"[^\p{L}' ]+", " ").alias("text")
        )
    )
    distinct = rows.select("text").dropDuplicates()
    shared = rows.sparkSession.sparkContext.broadcast((languages, _refusal_models(rows), _end_counts(distinct)))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(*shared.value)
        for b in batches:
            texts, titles = b["text"].tolist(), b["title"].tolist()
            refusing = judge.refuses(texts)
            judge.prepare(texts, titles)
            out = []
            for text, title, no in zip(texts, titles, refusing):
                if is_empty(text):
                    out.append("empty")
                elif title and is_copy(title, text):
                    out.append("copy")
                elif no:
                    out.append("refusal")
                elif title and judge.other_language(title, text):
                    out.append("language")
                else:
                    out.append("truncated" if judge.breaks_off(text) else None)
            b = b.assign(defect=pd.Series(out, index=b.index, dtype=object))
            yield b.loc[b["defect"].notna(), ["answer_id", "field_name", "defect"]]

    return rows.mapInPandas(judged, "answer_id bigint, field_name string, defect string")
