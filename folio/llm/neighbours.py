"""Problem 2: the k most similar vectors of every vector, by an inverted file with product quantisation.

Coarse centroids and the codebooks of the residuals are fitted on a bounded sample (SAMPLE rows at
most); every vector is then filed under its nearest centroid together with the codes of its
residual, and asked for in the lists of its nearest centroids. A task holds one block of one list:
it scores block and queries by asymmetric distance tables, and reranks by exact cosine right there
every entry that the tables do not rule out, so that only the k best of each block travel on. The
length of what the codes leave out of a vector is filed with it and bounds how far the tables may
be off; the k best of a block are therefore exact, however alike its entries are. Long lists are
cut into blocks.

Where a crowd of near-copies fills more lists than are asked, the others follow in a second pass:
every list that may hold something as near as the k-th found (or as `least`), by its radius and by
the border between its centroid and that of the query. Lists are taken there in cells of about CELL
vectors, so that a vector travels once to a cell and not to each list. No neighbour is lost.

Equal directions (to 12 digits) are filed once. Each class hands its first members to the classes it
is near to, so a class that holds a third of all rows costs as much as any other.

Defined cases: null vectors and vectors of another length, with null, NaN or infinite parts or
all zero are left out; repeated rows count once (of several vectors under one key the largest
counts); equal cosines (to 12 digits) go by the smaller key; fewer than k others give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.session import written

SAMPLE = 65_536  # rows that centroids and codebooks are fitted on, at most
MOST_LISTS = 4096
BLOCK = 4096  # vectors of a list that one task holds
CELL = 16_384  # vectors of near lists, and vectors asking, that a task of the second pass holds
SLACK = 1e-5  # of a squared distance between unit vectors: more than single precision loses


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k centroids; those that lose all points are put on random points."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c, 1)[:, 0]
        n = np.bincount(at, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, at, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(c))]).astype("f4")
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int, step: int = 2048) -> np.ndarray:
    """The k nearest rows of c for each row of x, nearest first."""
    k, out, norm = min(k, len(c)), [], (c * c).sum(1)
    for i in range(0, len(x), step):
        d = norm - 2 * (x[i : i + step] @ c.T)
        near = np.argpartition(d, k - 1, 1)[:, :k] if k < len(c) else np.tile(np.arange(len(c)), (len(d), 1))
        out.append(np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(1), 1))
    return np.concatenate(out) if out else np.zeros((0, k), int)


def encode(r: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Codes (n, m) of residuals r by codebooks (m, 256, width)."""
    m, _, w = books.shape
    return np.stack([nearest(r[:, j * w : (j + 1) * w], books[j], 1)[:, 0] for j in range(m)], 1).astype("u1")


def left_out(r: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The length of what codes leave out of each residual."""
    m, _, w = books.shape
    told = np.concatenate([books[j][codes[:, j]] for j in range(m)], 1)
    return np.sqrt(((r - told).astype("f8") ** 2).sum(1))


def possible(r: np.ndarray, codes: np.ndarray, err: np.ndarray, books: np.ndarray, k: int) -> np.ndarray:
    """bool (queries, entries): False where k others are surely nearer. r: residuals of the queries; err: left_out of the entries."""
    m, _, w = books.shape
    far = np.repeat((r * r).sum(1, keepdims=True), len(codes), 1)
    for j in range(m):  # asymmetric distance tables: query part to every codeword, looked up by code
        table = (books[j] * books[j]).sum(1) - 2 * (r[:, j * w : (j + 1) * w] @ books[j].T)
        far += table[:, codes[:, j]]
    at_most = np.sqrt(np.maximum(far, 0) + SLACK) + err
    k = min(k, len(codes) - 1)  # one more than k, for the query itself may be among them
    return np.sqrt(np.maximum(far - SLACK, 0)) - err <= np.partition(at_most, k, 1)[:, k : k + 1]


def unit(rows: np.ndarray) -> np.ndarray:
    r = rows.astype("f8")
    return (r / np.sqrt((r * r).sum(1, keepdims=True))).astype("f4")


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.values).astype("f4")


def valid_vectors(df: DataFrame, key: str, vec: str, dims: int) -> DataFrame:
    """(key, vec) of the valid rows, one per key."""
    v = F.col(vec)
    ok = (
        v.isNotNull()
        & (F.size(v) == dims)
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
        & F.exists(v, lambda x: x != 0)
    )
    return df.where(F.col(key).isNotNull() & ok).groupBy(F.col(key).alias("key")).agg(F.max(v).alias("vec"))


def cells(sizes: np.ndarray, coarse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each list, near lists together, and the parts of each cell (several where one list is longer)."""
    groups = kmeans(coarse, max(1, int(sizes.sum()) // CELL))
    order = np.argsort(nearest(coarse, groups, 1)[:, 0], kind="stable")
    cell = np.zeros(len(sizes), int)
    cell[order] = (np.cumsum(sizes[order]) - sizes[order]) // CELL
    return cell, np.maximum(1, np.bincount(cell, sizes).astype(int) // CELL)


def within(v: np.ndarray, home: np.ndarray, bound: np.ndarray, coarse: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """bool (rows, lists): False where a list surely has nothing nearer than bound (a distance) to the row."""
    c = coarse.astype("f8")
    square = lambda a, b: np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0)
    d = square(v, c)
    ball = np.sqrt(d) - radius
    # what is filed in a list lies on its side of the border to the row's own centroid
    border = (d - np.take_along_axis(d, home[:, None], 1) - SLACK) / (2 * np.maximum(np.sqrt(square(c[home], c)), 1e-9))
    return np.maximum(ball, border) <= bound[:, None]


def search(reps: DataFrame, dims: int, k: int, probes: int, subspaces: int = 8, least: float = -1.0) -> DataFrame:
    """(q, e, cos): for each row (key, vec) of distinct directions its k nearest others; below a cosine of `least` only those that are met with."""
    spark = reps.sparkSession
    total = reps.count()
    if total < 2:
        return spark.createDataFrame([], "q long, e long, cos double")
    lists = int(min(MOST_LISTS, 4 * total**0.5, max(1, total // 8)))
    want = min(total, SAMPLE, max(4096, 40 * lists))
    # in hash order: the same rows whatever the partitioning, and at most `want` of them
    sample = reps.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) <= int((1 << 20) * min(1.0, 1.2 * want / total)))
    sample = sample.orderBy(F.xxhash64("key"), "key").limit(want).select("vec")
    x = unit(matrix(sample.toPandas()["vec"]))
    coarse = kmeans(x, lists)
    residual = x - coarse[nearest(x, coarse, 1)[:, 0]]
    w = dims // subspaces
    some = residual[: 16_384]
    books = np.stack([kmeans(some[:, j * w : (j + 1) * w], 256, 6) for j in range(subspaces)])
    if books.shape[1] < 256:
        books = np.concatenate([books, np.full((subspaces, 256 - books.shape[1], w), 1e9, "f4")], 1)
    held = spark.sparkContext.broadcast((coarse, books))  # at most MOST_LISTS + 256 vectors

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coarse, books = held.value
        for b in batches:
            if len(b):
                v = unit(matrix(b.vec))
                near = nearest(v, coarse, probes)
                residual = v - coarse[near[:, 0]]
                codes = encode(residual, books)
                err = left_out(residual, codes, books)
                yield pd.DataFrame({"key": b.key.values, "v": [r.tobytes() for r in matrix(b.vec)], "codes": [c.tobytes() for c in codes], "err": err, "away": np.sqrt((residual.astype("f8") ** 2).sum(1)), "near": list(near.astype("i4"))})

    filed = written(reps.mapInPandas(file, "key long, v binary, codes binary, err double, away double, near array<int>"), "ivf")
    home = F.element_at("near", 1)
    # length and radius of each list: at most MOST_LISTS rows
    about = filed.groupBy(home.alias("l")).agg(F.count("*").alias("n"), F.max("away").alias("r")).collect()
    # at most MOST_LISTS rows: how many blocks each list is cut into
    blocks = F.broadcast(spark.createDataFrame([(r.l, -(-r.n // BLOCK)) for r in about], "l int, blocks int"))
    entries = filed.withColumn("l", home).join(blocks, "l")
    entries = entries.select("l", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("b"), "key", "v", "codes", "err")
    # other names than in entries: cogroup merges columns that both sides take from one table
    asked = filed.select(F.col("key").alias("qkey"), F.col("v").alias("qv"), F.explode("near").alias("l")).join(blocks, "l")
    asked = asked.select(F.col("l").alias("ql"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("qb"), "qkey", "qv")

    def score(entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"q": np.zeros(0, "i8"), "e": np.zeros(0, "i8"), "cos": np.zeros(0)})
        if not len(entries) or not len(asked):
            return none  # an absent side comes without columns
        coarse, books = held.value
        entries = entries.sort_values("key")  # of equal cosines the first is then the smallest key
        ids, qids = entries.key.to_numpy(), asked.qkey.to_numpy()
        ev, qv = (np.frombuffer(b"".join(c), "f4").reshape(len(c), -1) for c in (entries.v, asked.qv))
        codes = np.frombuffer(b"".join(entries.codes), "u1").reshape(len(ids), -1)
        err = entries.err.to_numpy().astype("f4")
        en = ev.astype("f8")
        en /= np.sqrt((en * en).sum(1, keepdims=True))
        out = []
        for i in range(0, len(qids), 256):
            qn = qv[i : i + 256].astype("f8")
            qn /= np.sqrt((qn * qn).sum(1, keepdims=True))
            r = (qn - coarse[int(entries.l.iloc[0])]).astype("f4")
            near = possible(r, codes, err, books, k)
            some = np.flatnonzero(near.any(0))
            cos = qn @ en[some].T
            rank = np.where(near[:, some] & (ids[some] != qids[i : i + 256, None]), np.round(cos, 12), -2)
            every = np.arange(len(qn))
            for _ in range(min(k, len(some))):
                best = rank.argmax(1)
                keep = rank[every, best] > -2
                out.append((qids[i : i + 256][keep], ids[some[best]][keep], cos[every, best][keep]))
                rank[every, best] = -2
        return pd.DataFrame({n: np.concatenate(x) for n, x in zip(["q", "e", "cos"], zip(*out))})

    found = entries.groupBy("l", "b").cogroup(asked.groupBy("ql", "qb")).applyInPandas(score, "q long, e long, cos double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.round("cos", 12).desc(), "e"))
    best = lambda df: df.withColumn("place", place).where(F.col("place") <= k)
    found = written(best(found), "found")

    sizes, radius = np.zeros(len(coarse), int), np.zeros(len(coarse))
    for r in about:
        sizes[r.l], radius[r.l] = r.n, r.r + SLACK
    cell, parts = cells(sizes, coarse)
    kth = found.where(F.col("place") == k).select(F.col("q").alias("key"), F.greatest("cos", F.lit(least)).alias("floor"))
    kth = filed.select("key", "v", "near").join(kth, "key", "left").withColumn("floor", F.coalesce("floor", F.lit(least)))

    def into(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            g = cell[b.near.to_numpy().astype(int)]
            yield pd.DataFrame({"l": g, "b": b.key.to_numpy() % parts[g], "key": b.key.to_numpy(), "v": b.v.to_numpy()})

    def further(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coarse, _ = held.value
        for whole in batches:
            for i in range(0, len(whole), 128):
                b = whole.iloc[i : i + 128]
                v = np.frombuffer(b"".join(b.v), "f4").reshape(len(b), -1).astype("f8")
                v /= np.sqrt((v * v).sum(1, keepdims=True))
                asked = np.stack(b.near.values)
                bound = np.sqrt(np.maximum(2 - 2 * b.floor.to_numpy(), 0) + SLACK)
                more = within(v, asked[:, 0], bound, coarse, radius) & (sizes > 0)
                np.put_along_axis(more, asked, False, 1)
                row, at = np.nonzero(more)
                pairs = np.unique(row * len(parts) + cell[at])  # a row and a cell
                row, g = pairs // len(parts), pairs % len(parts)
                row, g, part = np.repeat(row, parts[g]), np.repeat(g, parts[g]), np.concatenate([np.arange(0), *[np.arange(parts[x]) for x in g]])
                x = b.iloc[row]
                yield pd.DataFrame({"ql": g, "qb": part, "qkey": x.key.to_numpy(), "qv": x.v.to_numpy(), "floor": x.floor.to_numpy()})

    def exact(entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"q": np.zeros(0, "i8"), "e": np.zeros(0, "i8"), "cos": np.zeros(0)})]
        if not len(entries) or not len(asked):
            return out[0]
        entries = entries.sort_values("key")
        ids, qids, floor = entries.key.to_numpy(), asked.qkey.to_numpy(), np.round(asked.floor.to_numpy(), 12)
        en, qn = (np.frombuffer(b"".join(c), "f4").reshape(len(c), -1).astype("f8") for c in (entries.v, asked.qv))
        en /= np.sqrt((en * en).sum(1, keepdims=True))
        qn /= np.sqrt((qn * qn).sum(1, keepdims=True))
        for i in range(0, len(qids), 128):
            cos = qn[i : i + 128] @ en.T
            at, to = np.nonzero(cos > floor[i : i + 128, None] - 1e-11)
            own, c = ids[to] != qids[i + at], np.round(cos[at, to], 12)
            at, to, c = at[own], to[own], c[own]
            order = np.lexsort((to, -c, at))
            at, to = at[order], to[order]
            first = np.arange(len(at)) - np.searchsorted(at, at) < k
            at, to = at[first], to[first]
            out.append(pd.DataFrame({"q": qids[i + at], "e": ids[to], "cos": cos[at, to]}))
        return pd.concat(out)

    turns = -(-total // CELL)  # those that ask a cell come in as many turns
    turn = F.pmod(F.xxhash64("qkey"), F.lit(turns)).cast("int").alias("qt")
    held_in = filed.select("key", "v", home.alias("near")).mapInPandas(into, "l int, b int, key long, v binary")
    held_in = held_in.select("l", "b", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("t"), "key", "v")
    asked = kth.mapInPandas(further, "ql int, qb int, qkey long, qv binary, floor double").select("ql", "qb", turn, "qkey", "qv", "floor")
    more = held_in.groupBy("l", "b", "t").cogroup(asked.groupBy("ql", "qb", "qt")).applyInPandas(exact, "q long, e long, cos double")
    both = found.drop("place").unionByName(more).groupBy("q", "e").agg(F.max("cos").alias("cos"))  # a cell also holds lists of the first pass
    return best(both).drop("place")


def nearest_neighbours(df: DataFrame, key: str, vec: str, dims: int = 64, k: int = 5, probes: int = 16, least: float = -1.0) -> DataFrame:
    """(key, vizinho, cosseno, posicao): the k most similar vectors of every valid vector (below a cosine of `least` perhaps not all)."""
    rows = valid_vectors(df, key, vec, dims)
    # classes of equal directions by 128 bits of hash, so that the vectors themselves are shuffled once
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = rows.withColumn("_n", length)
    way = F.transform("vec", lambda x: F.rint(x.cast("double") / F.col("_n") * 1e12).cast("long"))
    rows = rows.withColumn("_way", way).select("key", "vec", F.xxhash64("_way").alias("h0"), F.xxhash64(F.lit(1), "_way").alias("h1"))
    rows = written(rows, "vectors")
    classes = rows.groupBy("h0", "h1").agg(F.min("key").alias("rep"), F.min_by("vec", "key").alias("vec"))
    salts = 8  # a class may hold a third of all rows
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    mine = F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int").alias("salt")
    members = rows.select("key", "h0", "h1", mine).join(classes.select("h0", "h1", "rep", every), ["h0", "h1", "salt"]).select("rep", "key")
    members = written(members, "members")
    near = search(classes.select(F.col("rep").alias("key"), "vec"), dims, k + 1, probes, least=least)
    # the first members of a class stand for it: more than k + 1 are never needed
    first = members.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("key"))).where(F.col("n") <= k + 1).drop("n")
    others = near.join(first.select(F.col("rep").alias("e"), F.col("key").alias("vizinho")), "e").select(F.col("q").alias("rep"), "vizinho", "cos")
    own = first.select("rep", F.col("key").alias("vizinho"), F.lit(1.0).alias("cos"))
    order = Window.partitionBy("rep").orderBy(F.round("cos", 12).desc(), "vizinho")
    short = others.unionByName(own).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    short = short.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "vizinho", "cos"))).alias("x"))
    got = members.select("rep", "key", mine).join(short.select("rep", "x", every), ["rep", "salt"])
    got = got.select("key", F.posexplode(F.slice(F.filter("x", lambda e: e["vizinho"] != F.col("key")), 1, k)).alias("p", "e"))
    return got.select(
        F.col("key").alias(key), F.col("e.vizinho").alias("vizinho"), F.col("e.cos").alias("cosseno"), (F.col("p") + 1).alias("posicao")
    )


def close_pairs(matriz: DataFrame, least: float = 0.92, k: int = 5) -> DataFrame:
    """(ord_a, ord_b) with a cosine of at least `least` where one is among the k nearest of the other."""
    near = nearest_neighbours(matriz, "ord", "vec", k=k, least=least).where(F.col("cosseno") >= least)
    return near.select(F.least("ord", "vizinho").alias("ord_a"), F.greatest("ord", "vizinho").alias("ord_b")).distinct()
