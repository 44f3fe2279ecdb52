"""Hashed character n-gram models, counted by Spark over whole tables and scored a batch at a time with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the number of buckets of 1-, 2- and 3-grams: the bound of a model's size, whatever the corpus's.
BUCKETS = (13, 16, 18)
START, END = 2, 3
#: How many characters are counted at once, about: their arrays stay in the processor's cache.
PORTION = 1 << 18


def portions(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """The texts in lists of about ``most`` characters, so that arrays over them stay small."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, each with two starts before and one end after, and where each begins."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.cumsum(lengths + 3) - (lengths + 3) + 2
    between = chr(END) + chr(START) * 2
    whole = between[1:] + between.join(texts) + between[:1] if len(texts) else ""
    return np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64), begin


def hashes(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the 1-, 2- and 3-gram that end at each place from the third on."""
    a, b, x = c[:-2], c[1:-1], c[2:]
    one = x * np.uint64(0x9E3779B97F4A7C15)
    two = b * np.uint64(0x100000001B3)
    two += x
    three = a * np.uint64(0xC2B2AE3D27D4EB4F)
    three += two
    two *= np.uint64(0x9E3779B97F4A7C15)
    three *= np.uint64(0x9E3779B97F4A7C15)
    for h, bits in zip((one, two, three), BUCKETS):
        h >>= np.uint64(64 - bits)
    return one.view(np.int64), two.view(np.int64), three.view(np.int64)


class Model:
    """log p(character | two before), interpolated from hashed counts."""

    def __init__(self, counts: list[np.ndarray], weight: float = 2.0):
        self.counts = [c.astype(np.float32) for c in counts]
        self.total = float(counts[0].sum())
        self.weight = weight

    def logp(self, c: np.ndarray, h: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        k = self.weight
        p = ((self.counts[0] + k / 4000) / (self.total + k))[h[0]]
        before = self.counts[0][h[0]]
        for counts, at in zip(self.counts[1:], h[1:]):
            n = counts[at]
            under = n.astype(np.float64)
            np.maximum(before[:-1], n[1:], out=under[1:])
            under += k
            p = (p * k + n) / under
            before = n
        return np.log(p, out=p)


def count_texts(texts: list[str]) -> list[np.ndarray]:
    c, _ = codes(texts)
    h = hashes(c) if len(c) > 2 else (np.zeros(0, np.int64),) * 3
    start = np.nonzero(c[2:] == START)[0]
    return [np.bincount(x, minlength=1 << b) - np.bincount(x[start], minlength=1 << b) for x, b in zip(h, BUCKETS)]


Tables = list[np.ndarray]


def count_into(tables: Tables, texts: list[str]) -> None:
    """Add the counts of any number of texts to ``tables``, by arrays of bounded size."""
    for part in portions(texts, PORTION):
        for t, n in zip(tables, count_texts(part)):
            t += n


def count_labels(labelled: DataFrame) -> dict[str, Tables]:
    """The counts of every label of (label, text), over all rows.

    Each task counts its own rows; only buckets are shuffled and gathered, at most the bound of BUCKETS for a label."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, Tables] = {}
        for b in batches:
            for label, g in b.groupby("label"):
                count_into(sums.setdefault(label, [np.zeros(1 << b, dtype=np.int64) for b in BUCKETS]), g["text"].tolist())
        for label, tables in sums.items():
            for order, t in enumerate(tables):
                at = np.nonzero(t)[0]
                yield pd.DataFrame({"label": label, "gram": order, "bucket": at.astype(np.int32), "n": t[at]})

    partial = labelled.where("label is not null and text is not null").select("label", "text")
    sums = partial.mapInPandas(count, "label string, gram int, bucket int, n bigint").groupBy("label", "gram", "bucket").agg(F.sum("n").alias("n"))
    tables: dict[str, Tables] = {}
    for (label, order), g in sums.toPandas().groupby(["label", "gram"]):
        t = tables.setdefault(label, [np.zeros(1 << b, dtype=np.int64) for b in BUCKETS])
        t[order][g["bucket"].to_numpy()] = g["n"].to_numpy()
    return tables


def fit(tables: dict[str, Tables], extra: dict[str, list[str]] | None = None) -> dict[str, Model]:
    """A model for each label; ``extra`` are further texts for a label."""
    tables = dict(tables)
    for label, texts in (extra or {}).items():
        t = tables.get(label) or [np.zeros(1 << b, dtype=np.int64) for b in BUCKETS]
        tables[label] = [x + y for x, y in zip(t, count_texts(texts))]
    return {label: Model(t) for label, t in tables.items()}


def train(labelled: DataFrame, extra: dict[str, list[str]] | None = None) -> dict[str, Model]:
    """A model for each label of (label, text), over all rows; ``extra`` are further texts for a label."""
    return fit(count_labels(labelled), extra)
