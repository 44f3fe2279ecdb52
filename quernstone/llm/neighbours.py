"""Problem 3: most similar vectors for every vector, by a hash-prefix forest.

Every tree gives a vector a long hash string: first the symbol of the nearest of many directions fitted on a bounded
sample, then one bit for each of ``BITS`` random hyperplanes through that direction.  Vectors that share a long prefix
are similar.  A tree is the array of all strings, sorted within subtrees that Spark distributes.

* Pairs: each subtree descends to the longest prefixes that still hold more than ``LEAF`` vectors, so the depth
  varies with the density; vectors are compared within those leaves, over all trees.  Subtrees that are too large for one
  task are parted by longer prefixes, where they are large only; those that share the whole string by blocks.
* Nearest neighbours: a query starts at the subtree of its own symbol in every tree and ascends in all trees at once,
  one sibling symbol at a time, until the subtrees together hold ``ASCENT`` of the model's vectors.

Candidates are scored on 8-bit vectors; those within the error bound of the best are scored again on the numbers, kept
as 4-byte floats.  Exact copies are one class throughout, so that a vector that a third of the rows share is one row of
the index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.session import cut, spread, table

TREES = 4
#: Directions of a tree: few for pairs, whose partners are close, many for neighbours, which lie all over a cluster.
SYMBOLS = 48
FINE_SYMBOLS = 512
BITS = 24
#: Vectors of each model that the directions are fitted on, about, or all it has: the documented sample bound.
SAMPLE = 6000
#: Vectors in a leaf, at most, where deeper prefixes exist.
LEAF = 1024
#: Difference of a vector's two nearest directions below which it has a string under both, for pairs.
MARGIN = 0.05
#: Share of a model's vectors that the ascent gathers over all trees, and how many at least.
ASCENT = 0.07
AT_LEAST = 2000
#: Symbols of a tree that one task searches together.
TOGETHER = 8
#: Rows of one subtree in one task; larger subtrees are split into blocks of this size.
BLOCK = 20_000
#: Error bound of cosines of 8-bit vectors.
SLACK = 0.02
#: Copies of one vector that are paired with each other and with similar vectors; beyond, the class's smallest key stands for it.
COPIES = 50

SOURCES = (("document_chunks", "id", "c"), ("sentence_nodes", "id", "n"), ("document_summaries", "document_id", "s"))


def parse_vectors(df: DataFrame, models: DataFrame) -> DataFrame:
    """(key, id, model, v array<double>) of the usable rows of (key, id, embedding_json, embedding_model).

    Usable: a JSON list of exactly the model's number of finite numbers, not all of them zero.  Null, broken, nested,
    quoted or otherwise written vectors, and models that aren't registered, are left out."""
    dims = models.where("model_name is not null").select(F.col("model_name").alias("model"), "dims").dropDuplicates(["model"])
    text = F.when(F.col("embedding_json").rlike(r"^\s*\[[^\[\]\"]*\]\s*$"), F.col("embedding_json"))
    parsed = df.select("key", "id", F.col("embedding_model").alias("model"), F.from_json(text, "array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        parsed.join(F.broadcast(dims), "model")
        .where((F.size("v") == F.col("dims")) & finite & F.exists("v", lambda x: x != 0))
        .select("key", "id", "model", "v")
    )


def all_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usable vectors of the three tables, keyed by the table's letter and the row's id."""
    parts = [
        table(spark, sf_dir, name).select(
            F.concat(F.lit(letter), F.col(id_).cast("string")).alias("key"), F.col(id_).alias("id"), "embedding_json", "embedding_model"
        )
        for name, id_, letter in SOURCES
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return parse_vectors(spread(rows.where("embedding_json is not null")), table(spark, sf_dir, "embedding_models"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The numbers of each row as 4-byte floats, and a hash of them that names the class of exact copies."""
    for b in batches:
        lists = b.column("v")
        offsets = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] if len(b) else np.zeros(0)
        offsets = offsets - offsets[0]
        raw = [flat[a:e].astype(np.float32).tobytes() for a, e in zip(offsets[:-1], offsets[1:])]
        exact = [hashlib.blake2b(flat[a:e].tobytes(), digest_size=12).digest() for a, e in zip(offsets[:-1], offsets[1:])]
        names = [m.encode() for m in b.column("model").to_pylist()]
        h = [hashlib.blake2b(x + m, digest_size=12).digest() for x, m in zip(exact, names)]
        yield pa.RecordBatch.from_arrays(
            [b.column("key"), b.column("id"), b.column("model"), pa.array(h, pa.binary()), pa.array(raw, pa.binary())],
            names=["key", "id", "model", "h", "raw"],
        )


def packed_vectors(vectors: DataFrame) -> DataFrame:
    """(key, id, model, h, raw): ``h`` is the same for exact copies of the same model only."""
    return vectors.mapInArrow(_packed, "key string, id bigint, model string, h binary, raw binary")


def classes(packed: DataFrame) -> DataFrame:
    """One row per class of exact copies: (h, model, raw, copies); partial aggregation meets hot classes before the shuffle."""
    return packed.groupBy("h").agg(F.first("model").alias("model"), F.first("raw").alias("raw"), F.count("*").alias("copies"))


def _units(raw: pd.Series) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=np.float32).reshape(len(raw), -1).astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


class Forest:
    """The hash functions of one model: directions and hyperplanes of every tree."""

    def __init__(self, sample: np.ndarray, symbols: int = SYMBOLS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.directions, self.planes = [], []
        for _ in range(TREES):
            k = min(symbols, len(sample))
            c = sample[rng.choice(len(sample), k, replace=False)].copy()
            for _ in range(12):
                nearest = (sample @ c.T).argmax(1)
                for j in range(k):
                    mine = sample[nearest == j]
                    if len(mine):
                        c[j] = mine.sum(0) / max(np.linalg.norm(mine.sum(0)), 1e-9)
            # directions within one dense spot would part its vectors for nothing
            apart = [j for j in range(k) if not (c[:j] @ c[j] > 0.9).any()]
            self.directions.append(c[apart])
            self.planes.append(rng.normal(size=(sample.shape[1], BITS)).astype(np.float32))

    def symbols(self, x: np.ndarray, tree: int, first: int = 1) -> np.ndarray:
        """The ``first`` nearest symbols of each vector, nearest first."""
        near = x @ self.directions[tree].T
        return near.argmax(1)[:, None] if first == 1 else np.argsort(-near, axis=1)[:, :first]

    def bits(self, x: np.ndarray, tree: int, symbol: np.ndarray) -> np.ndarray:
        """The hyperplanes' bits as one number, the first bit the highest."""
        side = (x - self.directions[tree][symbol]) @ self.planes[tree] > 0
        return side @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def fit(packed: DataFrame, symbols: int = SYMBOLS) -> dict[str, Forest]:
    """A forest for each model, fitted on about ``SAMPLE`` vectors of it, chosen by a hash of their keys, or on all.

    Each model has its own rate, so that a rare model beside a frequent one isn't missed.  The sample that reaches the
    driver has at most about ``SAMPLE`` vectors for each of the registered models."""
    counts = packed.groupBy("model").agg(F.count("*").alias("n"))
    rates = counts.select("model", F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("n") / SAMPLE)).alias("every"))
    some = packed.join(F.broadcast(rates), "model").where(F.pmod(F.xxhash64("key"), F.col("every")) == 0)
    rows = some.select("model", "h", "raw").toPandas().sort_values("h")
    return {m: Forest(_units(g["raw"]), symbols) for m, g in rows.groupby("model")}


def _quantised(x: np.ndarray) -> np.ndarray:
    return np.rint(x * (127 / np.abs(x).max(axis=1, keepdims=True))).astype(np.int8)


def _floats(q: pd.Series) -> np.ndarray:
    x = np.frombuffer(b"".join(q), dtype=np.int8).reshape(len(q), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def strings(units: DataFrame, forests, margin: float = 0.0) -> DataFrame:
    """(model, tree, symbol, bits, h, q): every class's hash string in every tree, with its 8-bit vector.

    A vector whose two nearest directions differ by less than ``margin`` has a string under each of them, so that close
    vectors on two sides of a border still meet."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for model, g in b.groupby("model"):
                if (forest := forests.value.get(model)) is None:
                    continue
                x = _units(g["raw"])
                q = np.array([r.tobytes() for r in _quantised(x)], dtype=object)
                for tree in range(TREES):
                    near = x @ forest.directions[tree].T
                    symbol = near.argmax(1)
                    at = np.arange(len(x))
                    if margin > 0 and near.shape[1] > 1:
                        best = near[at, symbol].copy()
                        near[at, symbol] = -2
                        second = near.argmax(1)
                        also = np.nonzero(best - near[at, second] < margin)[0]
                        at, symbol = np.concatenate([at, also]), np.concatenate([symbol, second[also]])
                    bits = forest.bits(x[at], tree, symbol)
                    yield pd.DataFrame({"model": model, "tree": tree, "symbol": symbol, "bits": bits, "h": g["h"].to_numpy()[at], "q": q[at]})

    return units.select("h", "model", "raw").mapInPandas(hashed, "model string, tree int, symbol int, bits bigint, h binary, q binary")


def _leaves(bits: np.ndarray, depth: int, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Ranges of the sorted strings: the longest prefixes that hold no more than LEAF vectors each, or all bits."""
    todo = [(depth, start, end)]
    while todo:
        depth, start, end = todo.pop()
        if end - start <= LEAF or depth >= BITS:
            yield start, end
            continue
        middle = start + int(np.searchsorted((bits[start:end] >> (BITS - 1 - depth)) & 1, 1))
        todo += [(depth + 1, start, middle), (depth + 1, middle, end)]


def _small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df``, broadcast if it has at most ``most`` (narrow) rows; beyond, the join shuffles it."""
    return F.broadcast(df) if df.count() <= most else df


def _parted(rows: DataFrame, step: int = 4) -> DataFrame:
    """``rows`` with (depth, prefix, part, block): groups of at most about ``BLOCK`` rows that hold all pairs of a leaf.

    Only subtrees that are too large get longer prefixes, ``step`` bits at a time; where even the whole string is shared
    by more, the rows are dealt into blocks and every pair of blocks is a group of its own."""
    keys = ["model", "tree", "symbol"]
    rows = rows.withColumn("depth", F.lit(0))
    prefix = F.expr(f"shiftright(bits, {BITS} - depth)")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(f"n > {BLOCK}")
    if sizes.isEmpty():
        return rows.withColumns({"prefix": prefix, "part": F.lit(""), "block": F.lit(0)})
    rows = cut(rows)
    at = [*keys, "depth", "prefix"]
    large = sizes.select(*keys, F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("prefix"), "n")
    for depth in range(0, BITS, step):  # at most total / BLOCK prefixes are too large on a level
        rows = rows.withColumn("prefix", prefix).join(_small(large.drop("n").withColumn("large", F.lit(True))), at, "left")
        rows = rows.withColumn("depth", F.when(F.col("large"), depth + step).otherwise(F.col("depth"))).drop("large", "prefix")
        counted = rows.where(f"depth = {depth + step}").groupBy(*keys, "depth", prefix.alias("prefix")).agg(F.count("*").alias("n"))
        large = cut(counted.where(f"n > {BLOCK}"))
    blocks = large.select(*at, F.ceil(F.col("n") / (BLOCK // 2)).cast("int").alias("blocks"))
    rows = rows.withColumn("prefix", prefix).join(_small(blocks), at, "left").fillna(1, ["blocks"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    both = rows.withColumn("other", other).withColumn("part", F.concat_ws("-", F.least("block", "other").cast("string"), F.greatest("block", "other").cast("string")))
    return both.drop("other", "blocks")


def similar_pairs(units: DataFrame, forests, least: float) -> DataFrame:
    """(h_a, h_b, cosine) of classes with a cosine of at least ``least`` that share a leaf in some tree; h_a < h_b."""
    rows = _parted(strings(units, forests, MARGIN))
    bound = least - SLACK

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("bits", kind="stable")
        bits, h, x, block = g["bits"].to_numpy(), g["h"].to_numpy(), _floats(g["q"]), g["block"].to_numpy()
        found_a, found_b = [], []
        two = len(np.unique(block)) > 1
        for start, end in _leaves(bits, int(g["depth"].iloc[0]), 0, len(g)):
            for i in range(start, end, LEAF):
                for j in range(i, end, LEAF):
                    a, b = np.nonzero(x[i : min(i + LEAF, end)] @ x[j : min(j + LEAF, end)].T >= bound)
                    keep = (a + i) < (b + j)
                    if two:  # pairs within a block belong to the group of that block alone
                        keep &= block[a + i] != block[b + j]
                    found_a.append(a[keep] + i)
                    found_b.append(b[keep] + j)
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        return pd.DataFrame({"x": h[a], "y": h[b]})

    pairs = rows.groupBy("model", "tree", "symbol", "prefix", "part").applyInPandas(compare, "x binary, y binary")
    pairs = pairs.select(F.least("x", "y").alias("h_a"), F.greatest("x", "y").alias("h_b")).distinct()
    return _exact(pairs, units, "h_a", "h_b").where(F.col("cosine") >= least)


def _exact(pairs: DataFrame, units: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with the cosine of the stored numbers."""
    left = units.select(F.col("h").alias(a), F.col("raw").alias("raw_a"))
    right = units.select(F.col("h").alias(b), F.col("raw").alias("raw_b"))

    @F.pandas_udf("double")
    def cosine(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(x))
        for n in set(x.map(len)):
            at = np.nonzero((x.map(len) == n).to_numpy())[0]
            u = np.frombuffer(b"".join(x.iloc[at]), dtype=np.float32).reshape(len(at), -1).astype(np.float64)
            v = np.frombuffer(b"".join(y.iloc[at]), dtype=np.float32).reshape(len(at), -1).astype(np.float64)
            out[at] = (u * v).sum(1) / np.sqrt((u * u).sum(1) * (v * v).sum(1))
        return pd.Series(np.minimum(out, 1.0))

    joined = pairs.join(left, a).join(right, b)
    return joined.withColumn("cosine", F.round(cosine("raw_a", "raw_b"), 9)).drop("raw_a", "raw_b")


def _index(spark: SparkSession, sf_dir: str, symbols: int = SYMBOLS):
    """The parsed vectors, written once, their classes, and the forests."""
    packed = cut(packed_vectors(all_vectors(spark, sf_dir)))
    forests = spark.sparkContext.broadcast(fit(packed, symbols))
    return packed, cut(classes(packed)), forests


def found_pairs(spark: SparkSession, sf_dir: str, least: float = 0.95) -> DataFrame:
    """(key_a, key_b): pairs of usable vectors of one model with a cosine of at least ``least``, smaller key first.

    Copies of one vector have cosine 1 and are paired too.  A class of more than ``COPIES`` copies is paired through
    its smallest key, which is linked to each of its copies and to each similar class, so no link between different
    vectors is lost and the result grows with the rows; :func:`class_links` names every vector's class, from which the
    remaining pairs follow: two copies of a class, or copies of two linked classes.  Without usable vectors the result
    is empty."""
    packed, units, forests = _index(spark, sf_dir)
    if not forests.value:
        return spark.createDataFrame([], "key_a string, key_b string")
    pairs = cut(similar_pairs(units, forests, least))
    # keys are needed only of classes with copies or with a partner
    wanted = pairs.select(F.explode(F.array("h_a", "h_b")).alias("h")).union(units.where("copies > 1").select("h")).distinct()
    members = packed.select("h", "key").join(wanted, "h", "left_semi")
    sizes = members.groupBy("h").agg(F.min("key").alias("rep"), F.count("*").alias("copies"))
    members = cut(members.join(sizes, "h"))
    small = members.where(f"copies <= {COPIES} or key = rep")
    within = small.alias("x").join(small.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.key") < F.col("y.key")))
    within = within.select(F.col("x.key").alias("key_a"), F.col("y.key").alias("key_b"))
    star = members.where(f"copies > {COPIES} and key != rep").select(F.col("rep").alias("key_a"), F.col("key").alias("key_b"))
    across = pairs.join(small.select(F.col("h").alias("h_a"), F.col("key").alias("x")), "h_a").join(
        small.select(F.col("h").alias("h_b"), F.col("key").alias("y")), "h_b"
    )
    across = across.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))
    return within.unionByName(star).unionByName(across)


def class_links(spark: SparkSession, sf_dir: str, least: float = 0.95) -> DataFrame:
    """(key, class_key, copies, links): one row per usable vector: its class of exact copies, named by the smallest key,
    the class's size, and the number of other classes with a cosine of at least ``least``."""
    packed, units, forests = _index(spark, sf_dir)
    if not forests.value:
        return spark.createDataFrame([], "key string, class_key string, copies bigint, links bigint")
    pairs = similar_pairs(units, forests, least)
    links = pairs.select(F.explode(F.array("h_a", "h_b")).alias("h")).groupBy("h").agg(F.count("*").alias("links"))
    named = packed.groupBy("h").agg(F.min("key").alias("class_key"), F.count("*").alias("copies")).join(links, "h", "left").fillna(0, ["links"])
    return packed.select("key", "h").join(named, "h").select("key", "class_key", "copies", "links")


def nearest(spark: SparkSession, sf_dir: str, k: int = 10, every: int = 20) -> DataFrame:
    """(key, rank, neighbour, cosine): the ``k`` most similar vectors of the same model for the rows whose id is
    divisible by ``every``, against all rows.  Equal cosines are ordered by the neighbour's key; copies of a vector
    are neighbours like others.  Fewer than ``k`` rows come out only where a model has fewer vectors."""
    packed, units, forests = _index(spark, sf_dir, FINE_SYMBOLS)
    if not forests.value:
        return spark.createDataFrame([], "key string, rank int, neighbour string, cosine double")
    asked = packed.where(F.col("id") % every == 0).select("key", "h")
    queries = units.join(asked.select("h").distinct(), "h", "left_semi")
    rows = strings(units, forests).withColumn("part", F.floor(F.col("symbol") / TOGETHER).cast("int"))
    sizes = rows.groupBy("model", "tree", "symbol").agg(F.count("*").alias("n")).collect()  # at most models x TREES x FINE_SYMBOLS rows
    cells = {(r.model, r.tree, r.symbol): r.n for r in sizes}
    totals: dict[str, int] = {}
    parts: dict[tuple, int] = {}
    for (m, t, s), n in cells.items():
        totals[m] = totals.get(m, 0) + (n if t == 0 else 0)
        parts[m, t, s // TOGETHER] = parts.get((m, t, s // TOGETHER), 0) + n
    blocks = {c: -(-n // BLOCK) for c, n in parts.items()}
    shared = spark.sparkContext.broadcast((cells, totals, blocks))

    def requests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, totals, blocks = shared.value
        for batch in batches:
            for model, g in batch.groupby("model"):
                forest, x = forests.value[model], _units(g["raw"])
                near = [forest.symbols(x, t, FINE_SYMBOLS) for t in range(TREES)]
                q, out = [r.tobytes() for r in _quantised(x)], []
                need = min(max(ASCENT * totals[model], AT_LEAST), totals[model] * TREES)
                for i, h in enumerate(g["h"]):
                    have = step = 0
                    while have < need and step < max(n.shape[1] for n in near):
                        for t in range(TREES):
                            if step >= near[t].shape[1]:
                                continue
                            s = int(near[t][i, step])
                            have += cells.get((model, t, s), 0)
                            out += [(model, t, s // TOGETHER, b, s, h, q[i]) for b in range(blocks.get((model, t, s // TOGETHER), 0))]
                        step += 1
                yield pd.DataFrame(out, columns=["model", "tree", "part", "block", "symbol", "h", "q"])

    asks = queries.select("h", "model", "raw").mapInPandas(requests, "model string, tree int, part int, block int, symbol int, h binary, q binary")
    many = spark.createDataFrame([(*c, n) for c, n in blocks.items()], "model string, tree int, part int, blocks int")
    split = rows.join(F.broadcast(many), ["model", "tree", "part"]).withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))

    def search(g: pd.DataFrame, asked_: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(g) and len(asked_):
            g = g.sort_values("symbol", kind="stable")
            symbols, h, x = g["symbol"].to_numpy(), g["h"].to_numpy(), _floats(g["q"])
            for symbol, qs in asked_.groupby("symbol"):
                a, e = np.searchsorted(symbols, [symbol, symbol + 1])
                for i in range(0, len(qs) if e > a else 0, 512):
                    some = qs.iloc[i : i + 512]
                    score = _floats(some["q"]) @ x[a:e].T
                    n = min(k + 1, e - a)  # one may be the query itself
                    least = np.partition(score, -n, axis=1)[:, -n] - SLACK
                    at, b = np.nonzero(score >= least[:, None])
                    out.append(pd.DataFrame({"h_a": some["h"].to_numpy()[at], "h_b": h[a:e][b], "score": score[at, b].astype(float)}))
        return pd.concat(out) if out else pd.DataFrame({"h_a": [], "h_b": [], "score": []})

    grouped = ["model", "tree", "part", "block"]
    hits = split.groupBy(*grouped).cogroup(asks.groupBy(*grouped)).applyInPandas(search, "h_a binary, h_b binary, score double")
    best = hits.groupBy("h_a", "h_b").agg(F.max("score").alias("score"))
    ranked = best.withColumn("r", F.row_number().over(Window.partitionBy("h_a").orderBy(F.desc("score"), "h_b")))
    least = F.min(F.when(F.col("r") <= k + 1, F.col("score"))).over(Window.partitionBy("h_a"))
    scored = _exact(ranked.withColumn("least", least).where(F.col("score") >= F.col("least") - SLACK).select("h_a", "h_b"), units, "h_a", "h_b")
    # a class's first k + 1 keys suffice: one may be the query itself
    members = packed.select("h", "key").withColumn("m", F.row_number().over(Window.partitionBy("h").orderBy("key"))).where(f"m <= {k + 1}")
    named = scored.join(members.select(F.col("h").alias("h_b"), F.col("key").alias("neighbour")), "h_b")
    per_query = asked.join(named, asked["h"] == named["h_a"]).where("key != neighbour")
    rank = Window.partitionBy("key").orderBy(F.desc("cosine"), "neighbour")
    return per_query.withColumn("rank", F.row_number().over(rank)).where(f"rank <= {k}").select("key", "rank", "neighbour", "cosine")
