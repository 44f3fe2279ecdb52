"""Problem 9: filling fixed-capacity containers by patterns of few documents, fitted by non-negative least squares.

1. Sizes: tokens of every document by the tokenizers that the containers name.
2. Histogram of sizes for each container kind: at most ``capacity`` rows, whatever the corpus's size.
3. Plan, from the histogram alone: all patterns of up to three sizes that fill a pattern container exactly are
   enumerated, their repeat counts fitted to the histogram by non-negative least squares and rounded down; what is
   left, the documents too large for a pattern, and the filled patterns themselves (where the capacity is a multiple
   of the pattern container) are packed best fit, largest first, over counts of equal items instead of items.
4. Every document's place: its rank among the documents of its size, computed over salted subgroups so that no size
   that a third of the corpus shares lands in one task, looked up in the plan.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.llm.bpe import PATTERN, vocabulary_path
from quernstone.session import cut, spread

#: Grid on which patterns fill a pattern container exactly.
GRID = 256
#: Largest subgroup of equal sizes: the number of salts.
SALTS = 64


class Counter:
    """Number of tokens of a text by one public tokenizer."""

    def __init__(self, name: str, folder: str | None = None):
        self.kept: dict[str, int] = {}
        if name.startswith("byte_bpe"):
            import regex
            import tiktoken

            with open(vocabulary_path(f"{name}.tiktoken", folder), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
            self.words = regex.compile(PATTERN)
            self.bpe = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.count = self._by_words
        elif name.startswith("piece_bpe"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(f"{name}.model", folder))
            self.count = lambda text: len(self.model.encode(text, num_threads=1))
        else:
            from tokenizers import Tokenizer

            self.other = Tokenizer.from_file(vocabulary_path(f"{name}.json", folder))
            self.other.encode_special_tokens = True
            self.count = lambda text: len(self.other.encode(text, add_special_tokens=False).ids)

    def _by_words(self, text: str) -> int:
        total, kept = 0, self.kept
        for w in self.words.findall(text):
            n = kept.get(w)
            if n is None:
                n = len(self.bpe.encode_ordinary(w))
                if len(kept) > 200_000:
                    kept.clear()
                kept[w] = n
            total += n
        return total


_counters: dict[tuple[str, str | None], Counter] = {}


def counter(name: str, folder: str | None) -> Counter:
    if (name, folder) not in _counters:
        _counters[name, folder] = Counter(name, folder)
    return _counters[name, folder]


def token_counts(df: DataFrame, tokenizers: list[str], key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """(key, tokenizer, n_tokens) of every row; null and empty texts have 0 tokens."""
    kind = df.schema[key].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name in tokenizers:
                c = counter(name, folder).count
                yield pd.DataFrame({"k": rows["k"], "tokenizer": name, "n_tokens": [c(t) if t else 0 for t in rows["t"]]})

    few = spread(df.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")))
    counted = few.mapInPandas(count, f"k {kind}, tokenizer string, n_tokens bigint")
    return counted.withColumnRenamed("k", key)


def patterns(grid: int, present: np.ndarray) -> np.ndarray:
    """All multisets of up to three present sizes with sum ``grid``, as rows of three sizes, absent ones 0."""
    a = np.nonzero(present)[0]
    a = a[a > 0]
    ok = np.zeros(grid + 1, dtype=bool)
    ok[a] = True
    out = [[(grid, 0, 0)]] if ok[grid] else []
    out.append([(x, grid - x, 0) for x in a if 0 < grid - x <= x and ok[grid - x]])
    x, y = np.meshgrid(a, a, indexing="ij")
    z = grid - x - y
    keep = (x >= y) & (y >= z) & (z > 0)
    keep[keep] = ok[z[keep]]
    out.append(np.stack([x[keep], y[keep], z[keep]], axis=1))
    return np.concatenate([np.asarray(p, dtype=np.int64).reshape(-1, 3) for p in out])


def nnls(rows: np.ndarray, target: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 with the least squared distance of sum(x * pattern) from ``target``: accelerated projected gradient."""
    n = len(target)
    if not len(rows):
        return np.zeros(0)
    forward = lambda x: sum(np.bincount(rows[:, j], x, n) for j in range(3))
    hits = lambda r: r[rows].sum(1)
    target = target.astype(float).copy()
    target[0] = 0
    v = np.ones(len(rows))
    for _ in range(20):
        u = forward(v)
        u[0] = 0
        v = hits(u)
        v /= np.linalg.norm(v) or 1
    u = forward(v)
    u[0] = 0
    step = 1 / max(np.linalg.norm(hits(u)), 1e-9)
    x = y = np.full(len(rows), target.sum() / (3 * len(rows)))
    t = 1.0
    for _ in range(steps):
        r = forward(y) - target
        r[0] = 0
        new = np.maximum(0, y - step * hits(r))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


#: Shares of the fitted patterns that a plan may use; the one that needs the fewest containers is taken.
SHARES = (1.0, 0.6, 0.3, 0.1)


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple]:
    """The slots of :func:`plan_with` for the share of patterns that needs the fewest containers."""
    return min((plan_with(sizes, counts, capacity, share) for share in SHARES), key=n_containers) if len(sizes) else []


def n_containers(slots: list[tuple]) -> int:
    return max((first + (last - rank + offset - 1) // each + 1 for _, rank, last, each, first, offset, _ in slots), default=0)


def plan_with(sizes: np.ndarray, counts: np.ndarray, capacity: int, share: float) -> list[tuple]:
    """Slots (size, first_rank, last_rank, per_container, first_container, offset, by_pattern): documents of ``size`` with
    ranks from first_rank up to last_rank go ``per_container`` each into the containers from ``first_container`` on.

    Its work and its result depend on the capacity and the number of different sizes, not on the documents."""
    mean = float((sizes * counts).sum() / max(1, counts.sum()))
    inner = capacity
    while inner % 4 == 0 and inner // 4 >= max(2 * mean, 64):
        inner //= 4
    unit = max(1, inner // GRID)
    grid = inner // unit
    order = np.argsort(-sizes, kind="stable")
    sizes, counts = sizes[order], counts[order]
    cells = -(-sizes // unit)
    histogram = np.zeros(grid + 1, dtype=np.int64)
    fits = cells <= grid
    np.add.at(histogram, cells[fits], counts[fits])
    rows = patterns(grid, histogram > 0)
    x = nnls(rows, histogram)
    left = histogram.copy()
    chosen: list[tuple[tuple[int, ...], int]] = []
    for k in np.argsort(-x, kind="stable"):
        n = int(share * x[k] + 0.5)
        if n < 1:
            break
        cell, times = np.unique(rows[k][rows[k] > 0], return_counts=True)
        n = min([n, *(int(left[c]) // int(m) for c, m in zip(cell, times))])
        if n > 0:
            left[cell] -= n * times
            chosen.append((tuple(int(c) for c in rows[k] if c), n))
    # ranks of each size: the largest sizes of a cell go to patterns first
    taken = histogram - left
    used = np.zeros(len(sizes), dtype=np.int64)
    for i in np.nonzero(fits)[0]:
        used[i] = min(counts[i], taken[cells[i]])
        taken[cells[i]] -= used[i]
    # items of the outer packing: patterns (negative ids) and single documents (index of their size)
    items = [(sum(p) * unit, n, -1 - k) for k, (p, n) in enumerate(chosen)]
    items += [(int(sizes[i]), int(counts[i] - used[i]), i) for i in range(len(sizes)) if counts[i] > used[i]]
    items.sort(key=lambda it: (-it[0], it[2]))
    open_: dict[int, list[tuple[int, tuple]]] = {}
    spaces: list[int] = []
    closed: list[tuple[int, tuple]] = []

    def put(space: int, n: int, recipe: tuple) -> None:
        if n <= 0:
            return
        if space <= 0:
            closed.append((n, recipe))
            return
        if space not in open_:
            open_[space] = []
            insort(spaces, space)
        open_[space].append((n, recipe))

    for size, n, what in items:
        while n > 0:
            k = bisect_left(spaces, size)
            if k == len(spaces):
                each = capacity // size
                put(capacity - each * size, n // each, (None, what, each))
                if n % each:
                    put(capacity - (n % each) * size, 1, (None, what, n % each))
                break
            space = spaces[k]
            have, recipe = open_[space].pop()
            if not open_[space]:
                del open_[space]
                spaces.pop(k)
            m = min(have, n)
            put(space, have - m, recipe)
            put(space - size, m, (recipe, what, 1))
            n -= m
    for space in spaces:
        closed.extend(open_[space])
    # number the containers, then hand out ranks
    placed_pattern: list[list[tuple[int, int, int]]] = [[] for _ in chosen]
    next_rank = {i: int(used[i]) for i in range(len(sizes))}
    slots: list[tuple] = []
    first = 0
    for n, recipe in closed:
        parts: dict[int, int] = {}
        while recipe is not None:
            recipe, what, times = recipe
            parts[what] = parts.get(what, 0) + times
        for what, times in parts.items():
            if what < 0:
                placed_pattern[-1 - what].append((n, times, first))
            else:
                r = next_rank[what]
                slots.append((int(sizes[what]), r, r + n * times, times, first))
                next_rank[what] = r + n * times
        first += n
    by_cell: dict[int, list[list[int]]] = {}
    for i in np.nonzero(used)[0]:
        by_cell.setdefault(int(cells[i]), []).append([int(i), 0, int(used[i])])
    for (p, _), places in zip(chosen, placed_pattern):
        for c in sorted(set(p)):
            m = p.count(c)
            for n, times, at in places:
                each, need, offset = m * times, n * m * times, 0
                queue = by_cell[c]
                while need > 0:
                    i, r, end = queue[0]
                    g = min(need, end - r)
                    slots.append((int(sizes[i]), r, r + g, each, at, offset))
                    offset += g
                    need -= g
                    queue[0][1] += g
                    if queue[0][1] == end:
                        queue.pop(0)
    return [(*s, True) if len(s) == 6 else (*s, 0, False) for s in slots]


def _plans(histogram: pd.DataFrame) -> pd.DataFrame:
    h = histogram.groupby("size", as_index=False)["n"].sum()
    pack_id, share = int(histogram["pack_id"].iloc[0]), float(histogram["share"].iloc[0])
    slots = plan_with(h["size"].to_numpy(np.int64), h["n"].to_numpy(np.int64), int(histogram["capacity"].iloc[0]), share)
    out = pd.DataFrame(slots, columns=["size", "first_rank", "last_rank", "each", "first", "offset", "by_pattern"])
    return out.assign(pack_id=pack_id, share=share, containers=n_containers(slots))[[c.split()[0] for c in PLAN.split(", ")]]


PLAN = "pack_id bigint, share double, containers bigint, size bigint, first_rank bigint, last_rank bigint, each bigint, first bigint, offset bigint, by_pattern boolean"
#: Ranks of one size that look up the plan together.
STRIDE = 64


def _items(documents: DataFrame, packs: DataFrame, key: str, text: str, folder: str | None) -> DataFrame:
    """(pack_id, capacity, row, key, piece, start_token, size, salt) of every document and container kind."""
    kinds = packs.select("pack_id", "tokenizer", F.col("capacity").cast("bigint").alias("capacity")).where(
        "pack_id is not null and tokenizer is not null and capacity > 0"
    )
    names = sorted({r.tokenizer for r in kinds.select("tokenizer").distinct().collect()})
    sizes = cut(token_counts(documents, names, key, text, folder).withColumn("row", F.monotonically_increasing_id()))
    joined = sizes.join(F.broadcast(kinds), "tokenizer")
    n_full = F.expr("greatest(n_tokens - 1, 0L) div capacity")
    return joined.select(
        "pack_id", "capacity", "row", F.col(f"`{key}`").alias("key"), "n_tokens",
        F.explode(F.sequence(F.lit(0).cast("bigint"), n_full)).alias("piece"),
    ).select(
        "pack_id", "capacity", "row", "key", "piece", (F.col("piece") * F.col("capacity")).alias("start_token"),
        F.least(F.col("capacity"), F.col("n_tokens") - F.col("piece") * F.col("capacity")).alias("size"),
        F.pmod(F.xxhash64("row", "piece"), F.lit(SALTS)).cast("int").alias("salt"),
    )


def _best_slots(subgroups: DataFrame) -> DataFrame:
    """The slots of each container kind's best plan.

    Every share of the patterns is planned in a task of its own, from the histogram alone; plans stay distributed."""
    shares = F.explode(F.array(*[F.lit(x) for x in SHARES])).alias("share")
    histogram = subgroups.groupBy("pack_id", "capacity", "size").agg(F.sum("n").alias("n")).select("*", shares)
    tasks = len(SHARES) * 8
    slots = cut(histogram.repartition(tasks, "pack_id", "share").groupBy("pack_id", "share").applyInPandas(_plans, PLAN))
    best = slots.groupBy("pack_id").agg(F.min(F.struct("containers", (-F.col("share")).alias("minus"))).alias("b"))  # one row a kind
    best = best.select("pack_id", (-F.col("b.minus")).alias("share"))
    return slots.join(F.broadcast(best), ["pack_id", "share"])


def pack(documents: DataFrame, packs: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """(pack_id, key, piece, start_token, n_tokens, container) of every document and container kind.

    A document longer than the capacity is cut into pieces of exactly the capacity and one rest; no other is cut.  Null
    and empty texts have no tokens and go to container 0.  Repeated rows are packed as often as they occur; an empty
    table gives an empty result; further columns don't take part.  Container kinds with a null or non-positive capacity
    or a null tokenizer are left out.  Containers are numbered from 0 for each kind."""
    items = _items(documents, packs, key, text, folder)
    some = items.where("size > 0")
    subgroups = some.groupBy("pack_id", "capacity", "size", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("pack_id", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = subgroups.select("pack_id", "size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = some.withColumn(
        "r", F.row_number().over(Window.partitionBy("pack_id", "size", "salt").orderBy("row", "piece")) - 1
    ).join(offsets, ["pack_id", "size", "salt"])
    ranked = ranked.withColumn("rank", F.col("r") + F.col("before")).withColumn("stride", F.expr(f"rank div {STRIDE}"))
    # a slot stands under every stride of ranks that it covers, so that the range join is an equi-join of bounded groups
    strides = F.explode(F.sequence(F.expr(f"first_rank div {STRIDE}"), F.expr(f"(last_rank - 1) div {STRIDE}")))
    slots = _best_slots(subgroups).select("pack_id", "size", "first_rank", "last_rank", "each", "first", "offset", strides.alias("stride"))
    met = ranked.join(slots, ["pack_id", "size", "stride"]).where("rank >= first_rank and rank < last_rank")
    placed = met.select(
        "pack_id", "key", "piece", "start_token", F.col("size").alias("n_tokens"), F.expr("first + (rank - first_rank + offset) div each").alias("container")
    )
    empty = items.where("size <= 0").select(
        "pack_id", "key", "piece", "start_token", F.col("size").alias("n_tokens"), F.lit(0).cast("bigint").alias("container")
    )
    return placed.unionByName(empty).withColumnRenamed("key", key)


def plan_report(documents: DataFrame, packs: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """(pack_id, share, containers, tokens, pattern_tokens) of each container kind: the share of the fitted patterns that
    its best plan uses, its containers, and how many of the tokens patterns place."""
    items = _items(documents, packs, key, text, folder).where("size > 0")
    slots = _best_slots(items.groupBy("pack_id", "capacity", "size").agg(F.count("*").alias("n")))
    tokens = F.col("size") * (F.col("last_rank") - F.col("first_rank"))
    return slots.groupBy("pack_id", "share", "containers").agg(
        F.sum(tokens).alias("tokens"), F.coalesce(F.sum(F.when(F.col("by_pattern"), tokens)), F.lit(0)).alias("pattern_tokens")
    )
