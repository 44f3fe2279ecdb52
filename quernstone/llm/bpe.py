"""Problem 8: encoding a corpus with a public byte-level BPE vocabulary, exactly and in linear time.

The vocabulary's tokens are byte strings; mapped to Latin-1 text they go into an Aho-Corasick automaton.  One pass of
the automaton over a word gives every token that occurs in it; the encoder then walks from the longest token at each
place and steps back to shorter ones.  A row of tokens is what the merges would give exactly when each two neighbours
are, and whether two tokens may stand side by side is looked up in a memo, so the merges themselves run only once for
each pair of tokens.  Places from which the walk failed are marked, which keeps the walk linear.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.session import spread

#: The pattern that splits a text before the merges of the rank files, as published with the vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bound of the memo of whole words, in entries.
WORDS_KEPT = 200_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """The place of a vocabulary file: in ``folder``, in $TOKENIZER_DIR, or in the installed package."""
    folder = folder or os.environ.get("TOKENIZER_DIR")
    if folder is None:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


class Encoder:
    """Exact byte-level BPE by backtracking over Aho-Corasick matches."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.words = regex.compile(PATTERN)
        self.by_id = {i: b for b, i in self.ranks.items()}
        self.one = {b[0]: i for b, i in self.ranks.items() if len(b) == 1}
        self.pair_ok: dict[tuple[int, int], bool] = {}
        self.word_ids: dict[str, list[int]] = {}
        self.automaton = ahocorasick.Automaton()
        reachable = {}
        for b, i in self.ranks.items():
            if len(b) == 1 or self.merged(b) == [i]:
                reachable[b] = i
                self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.ids = {b.decode("latin-1"): i for b, i in reachable.items()}
        #: of each token, the longest token that is a proper prefix of it
        self.shorter: dict[int, int] = {}
        for b, i in reachable.items():
            for n in range(len(b) - 1, 0, -1):
                if (k := reachable.get(b[:n])) is not None:
                    self.shorter[i] = k
                    break
        self.size = {i: len(b) for b, i in reachable.items()}

    def merged(self, data: bytes) -> list[int]:
        """The merges themselves, lowest rank first: the definition, used for single tokens and pairs only."""
        parts = [data[k : k + 1] for k in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = ranks.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` followed by ``b`` as they are."""
        ok = self.pair_ok.get((a, b))
        if ok is None:
            ok = self.pair_ok[a, b] = self.merged(self.by_id[a] + self.by_id[b]) == [a, b]
        return ok

    def encode_word(self, word: str) -> list[int]:
        """The ids of one word of the splitting pattern."""
        data = word.encode("utf-8", "surrogatepass").decode("latin-1")
        if (i := self.ids.get(data)) is not None:
            return [i]
        n = len(data)
        longest = [0] * n
        first = [-1] * n
        for end, (size, i) in self.automaton.iter(data):
            start = end - size + 1
            if size > longest[start]:
                longest[start], first[start] = size, i
        size_of, shorter, pair_ok = self.size, self.shorter, self.pair_ok
        dead = bytearray(n + 1)
        out: list[int] = []
        pos, token = 0, first[0]
        while True:
            end = pos + size_of[token]
            ok = not dead[end]
            if ok and out:
                ok = pair_ok.get((out[-1], token))
                if ok is None:
                    ok = self.compatible(out[-1], token)
            if ok:
                out.append(token)
                if end == n:
                    return out
                pos, token = end, first[end]
                continue
            token = shorter.get(token, -1)
            while token < 0:
                dead[pos] = 1
                last = out.pop()
                pos -= size_of[last]
                token = shorter.get(last, -1)

    def encode(self, text: str) -> list[int]:
        """The ids of a text, special tokens' strings taken as ordinary text."""
        out: list[int] = []
        kept, extend = self.word_ids, out.extend
        for w in self.words.findall(text):
            ids = kept.get(w)
            if ids is None:
                ids = self.encode_word(w)
                if len(kept) >= WORDS_KEPT:
                    kept.clear()
                kept[w] = ids
            extend(ids)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary; it is built from the file once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids array<int>) of every row.

    Null and empty texts have an empty list.  Blank texts and odd code points are encoded like any other text; the
    strings of special tokens are ordinary text.  Repeated rows are encoded again, an empty table gives an empty
    result, and further columns don't take part.  There is no shuffle but the spreading of a small input."""
    path = path or vocabulary_path()

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for texts in batches:
            yield pd.Series([e.encode(t) if t else [] for t in texts])

    few = spread(df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__text")))
    return few.select(key, ids("__text").alias("ids"))
