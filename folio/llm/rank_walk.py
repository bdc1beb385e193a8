"""Problem 4: one ranking from several differently scaled scores, by a rank-walk Markov chain.

From an item the walk picks one of the scores at random and jumps uniformly to one of the items
that are strictly higher on it (it stays if there is none); with probability 1 - damping it jumps
anywhere in the group. Only the order of each score enters, so no score prevails by its spread.
Mass moved by one score is a prefix sum over the items in order of that score, so a round costs
O(items) after one sort. Items are ordered by stationarity (masses that agree to nine digits of the
mean mass tie), ties by id in the id's own order.

The majority winner of a group, an item that beats each other one on most scores, is found through
the walk: every other item sends it a known share of its mass, so its stationary mass has a lower
bound (`winner_bound`). Items below it are ruled out; the others are tried in the walk's order, and
what is left is checked against every item.

Groups up to `small` items are worked off many at a time in Arrow batches. Larger groups never
meet in one task: their distinct score values are cut into blocks, each round sums the mass per
value and takes prefix sums within blocks plus block offsets; their candidates are swept in parts
of `block` items, then the parts' winners, and the one that is left is checked by one join.

Defined cases: null and NaN scores are lower than any number and equal to each other; repeated
rows of one (group, id) count once (the row with the largest scores, taken in the given order);
null group or id rows are dropped; empty input gives empty output; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.session import discard, written

SMALL = 20_000  # items of a group that one task may hold
MOST_PARTS = 1024  # blocks that a larger group is cut into, at most
DAMPING = 0.85
ROUNDS = 60
DIGITS = 9  # of a mass, as a multiple of the mean mass: masses that agree so far tie
SENT_OUT = 200_000  # rows that a table may have to be sent to every task
LOWEST = float("-inf")


def walk(values: np.ndarray, damping: float = DAMPING, rounds: int = ROUNDS) -> np.ndarray:
    """Stationary mass of each row of values (items x scores; -inf for missing)."""
    n, k = values.shape
    mass = np.full(n, 1.0 / n)
    orders = []
    for s in range(k):
        order = np.argsort(values[:, s], kind="stable")
        v = values[order, s]
        first = np.searchsorted(v, v, "left")  # items strictly lower come before this place
        higher = n - np.searchsorted(v, v, "right")
        orders.append((order, first, higher))
    for _ in range(rounds):
        new = np.zeros(n)
        for order, first, higher in orders:
            p = mass[order]
            flow = np.where(higher > 0, p / np.maximum(higher, 1), 0.0)
            before = np.concatenate([[0.0], np.cumsum(flow)])
            new[order] += before[first] + np.where(higher > 0, 0.0, p)
        new = (1 - damping) / n + damping * new / k
        done = np.abs(new - mass).sum() < 1e-12
        mass = new
        if done:
            break
    return mass


def winner_bound(n, k: int, needed: int, damping: float = DAMPING, rounds: int = ROUNDS):
    """(n a number or a column, above 1) The stationary mass that an item must have which beats each of n - 1 others on `needed` of k scores.

    It is strictly higher than each other item on that many scores, from each of which the item jumps to
    one of at most n - 1: it gets damping * needed / k / (n - 1) of all mass that is not its own, and
    (1 - damping) / n besides. The masses of the last two rounds differ by at most 2 damping^(rounds - 1).
    """
    a, b = (1 - damping) / n, damping * needed / k / (n - 1)
    return (a + b * max(0.0, 1 - 2 * damping ** (rounds - 1))) / (1 + b) * (1 - 1e-9)


def majority_champion(values: np.ndarray, order: np.ndarray, candidate: np.ndarray, needed: int) -> int | None:
    """The row that is strictly higher than each other on at least `needed` scores, or None.

    Tried are the candidates in the walk's order: whom one of them beats drops out. Exact as long as the
    winner is a candidate, for it beats whoever is tried before it and is beaten by none."""
    tried = order[candidate[order]]
    if not len(tried):
        return None
    best = tried[0]
    for i in tried[1:]:
        if (values[best] > values[i]).sum() < needed:
            best = i
    wins = (values[best] > values).sum(1) >= needed
    wins[best] = True
    return int(best) if wins.all() else None


def id_places(ids: np.ndarray) -> np.ndarray:
    """The place of each id in the ids' own order."""
    place = np.empty(len(ids), int)
    place[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
    return place


def _clean(df: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    """One row per (group, item) with scores s0.. in which missing is -inf."""
    low = F.lit(LOWEST)
    cols = [F.when(F.col(c).isNull() | F.isnan(c), low).otherwise(F.col(c).cast("double")).alias(f"s{k}") for k, c in enumerate(scores)]
    names = [f"s{k}" for k in range(len(scores))]
    return (
        df.where(F.col(group).isNotNull() & F.col(item).isNotNull())
        .select(F.col(group).alias("g"), F.col(item).alias("i"), *cols)
        .groupBy("g", "i")
        .agg(F.max(F.struct(*names)).alias("s"))
        .select("g", "i", "s.*")
    )


def _sizes(clean: DataFrame, small: int) -> DataFrame:
    """The groups above `small` items: at most rows / small of them."""
    return clean.groupBy("g").agg(F.count("*").alias("size")).where(F.col("size") > small)


def _small_groups(clean: DataFrame, k: int, needed: int, rounds: int) -> DataFrame:
    names = [f"s{j}" for j in range(k)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, sizes = [], []
            for g, items, *cols in zip(b.g, b["i"], *(b[c] for c in names)):
                v = np.stack([np.asarray(c, "f8") for c in cols], 1)
                ids = np.asarray(items)
                mass = walk(v, rounds=rounds)
                order = np.lexsort((id_places(ids), -np.round(mass * len(ids), DIGITS)))
                place = np.empty(len(order), "i8")
                place[order] = np.arange(1, len(order) + 1)
                best = majority_champion(v, order, mass >= winner_bound(max(2, len(ids)), k, needed, rounds=rounds), needed)
                out.append((ids, mass, place, np.arange(len(ids)) == (-1 if best is None else best)))
                sizes.append(len(ids))
            if out:
                ids, mass, place, champion = map(np.concatenate, zip(*out))
                yield pd.DataFrame({"g": np.repeat(b.g.to_numpy(), sizes), "i": ids, "mass": mass, "place": place, "champion": champion})

    kinds = dict(clean.dtypes)
    lists = clean.groupBy("g").agg(F.collect_list(F.struct("i", *names)).alias("x")).select("g", *(F.col(f"x.{c}").alias(c) for c in ["i", *names]))
    return lists.mapInPandas(run, f"g {kinds['g']}, i {kinds['i']}, mass double, place long, champion boolean")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be sent to every task if it is known to be small; else Spark joins it as it sees fit."""
    return F.broadcast(df) if rows <= SENT_OUT else df


def _blocks(rows: DataFrame, keys: list[str], value: str, parts: int, groups: int) -> DataFrame:
    """rows with `block`: at most `parts` consecutive ranges of value within keys, of about as many rows each."""
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 20 * parts).alias("cuts"))
    return rows.join(_small(cuts, groups * parts), keys).withColumn("block", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts")


def _prefix(rows: DataFrame, what: str, alias: str, keys: list[str], value: str, parts: int, groups: int) -> DataFrame:
    """rows with the sum of `what` over all strictly lower values of the same keys (values are distinct)."""
    block_keys = [*keys, "block"]
    within = Window.partitionBy(*block_keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*block_keys).agg(F.sum(what).alias("_t")).withColumn("_o", F.coalesce(F.sum("_t").over(over), F.lit(0.0))).drop("_t")
    return (
        rows.withColumn("_w", F.coalesce(F.sum(what).over(within), F.lit(0.0)))
        .join(_small(offsets, groups * parts), block_keys)
        .withColumn(alias, F.col("_w") + F.col("_o"))
        .drop("_w", "_o")
    )


def _large_groups(clean: DataFrame, sizes: DataFrame, groups: int, k: int, needed: int, rounds: int, block: int, parts: int) -> DataFrame:
    """The same walk for groups that no task may hold: masses by distinct value, prefix sums by block."""
    names = [f"s{j}" for j in range(k)]
    items = written(clean.join(_small(sizes, groups), "g"), "walk-items")
    long = lambda df, *more: reduce(
        DataFrame.unionByName, [df.select("g", F.lit(j).alias("j"), F.col(f"s{j}").alias("v"), *more) for j in range(k)]
    )
    # distinct values with how many items are strictly higher
    values = _blocks(long(items, "size").groupBy("g", "j", "v", "size").agg(F.count("*").cast("double").alias("cnt")), ["g", "j"], "v", parts, groups * k)
    values = _prefix(values, "cnt", "lower", ["g", "j"], "v", parts, groups * k)
    values = written(values.withColumn("higher", F.col("size") - F.col("lower") - F.col("cnt")).select("g", "j", "v", "block", "higher"), "walk-values")
    mass = items.withColumn("mass", 1 / F.col("size"))
    for r in range(rounds):
        per_value = long(mass, "mass").groupBy("g", "j", "v").agg(F.sum("mass").alias("m"))
        flows = values.join(per_value, ["g", "j", "v"]).withColumn("flow", F.when(F.col("higher") > 0, F.col("m") / F.col("higher")).otherwise(0.0))
        inflow = _prefix(flows, "flow", "inflow", ["g", "j"], "v", parts, groups * k).select("g", "j", "v", "higher", "inflow")
        new = mass
        for j in range(k):
            one = inflow.where(F.col("j") == j).select("g", F.col("v").alias(f"s{j}"), F.col("higher").alias(f"h{j}"), F.col("inflow").alias(f"f{j}"))
            new = new.join(one, ["g", f"s{j}"])
        arrived = sum(F.col(f"f{j}") + F.when(F.col(f"h{j}") > 0, 0.0).otherwise(F.col("mass")) for j in range(k))
        last, moved = mass, (1 - DAMPING) / F.col("size") + DAMPING * arrived / k
        mass = written(new.select("g", "i", *names, "size", moved.alias("mass"), F.abs(moved - F.col("mass")).alias("moved")), f"walk-{r}")
        discard(last)
        if mass.groupBy("g").agg(F.sum("moved").alias("m")).where("m >= 1e-12").limit(1).count() == 0:
            break
    # place: order by mass (ties by id) without a window over the group
    ranked = _blocks(mass.withColumn("neg", -F.round(F.col("mass") * F.col("size"), DIGITS)), ["g"], "neg", parts, groups)
    ends = ranked.groupBy("g", "block").agg(F.count("*").alias("c"))
    ends = ends.withColumn("o", F.coalesce(F.sum("c").over(Window.partitionBy("g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.join(_small(ends.select("g", "block", "o"), groups * parts), ["g", "block"]).withColumn(
        "place", F.row_number().over(Window.partitionBy("g", "block").orderBy("neg", "i")) + F.col("o")
    )
    ranked = written(ranked.select("g", "i", *names, "mass", "size", F.col("place").cast("long").alias("place")), "walk-ranked")
    champions = _large_champions(ranked, names, groups, k, needed, rounds, block)
    marked = ranked.join(_small(champions, groups), "g", "left").withColumn("champion", F.coalesce(F.col("ci") == F.col("i"), F.lit(False)))
    return marked.select("g", "i", "mass", "place", "champion")


def _large_champions(ranked: DataFrame, names: list[str], groups: int, k: int, needed: int, rounds: int, block: int) -> DataFrame:
    """(g, ci) of large groups with a majority winner: two sweeps over the candidates, one check against all."""
    rows = ranked.where(F.col("mass") >= winner_bound(F.col("size"), k, needed, rounds=rounds)).select("g", "i", "place", *names)

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        v, order = pdf[names].to_numpy("f8"), pdf.place.to_numpy().argsort()
        best = order[0]
        for x in order[1:]:
            if (v[best] > v[x]).sum() < needed:
                best = x
        return pdf.iloc[[best]][["g", "i", "place", *names]]

    kinds = dict(ranked.dtypes)
    schema = f"g {kinds['g']}, i {kinds['i']}, place long, " + ", ".join(f"{c} double" for c in names)
    # a winner beats everyone: it is left of its own part, and then of the parts' winners
    left = rows.withColumn("part", F.floor(F.col("place") / block)).groupBy("g", "part").applyInPandas(sweep, schema)
    left = left.groupBy("g").applyInPandas(sweep, schema).select("g", F.col("i").alias("ci"), *(F.col(c).alias(f"c{c}") for c in names))
    beats = sum((F.col(f"c{c}") > F.col(c)).cast("int") for c in names) >= needed
    left = written(left, "walk-left")
    checked = ranked.join(_small(left, groups), "g").groupBy("g", "ci").agg(F.min((beats | (F.col("ci") == F.col("i"))).cast("int")).alias("ok"))
    return checked.where("ok = 1").select("g", "ci")


def rank_walk(
    df: DataFrame, group: str, item: str, scores: list[str], needed: int | None = None, small: int = SMALL, rounds: int = ROUNDS, block: int = 8192
) -> DataFrame:
    """(group, item, mass, place, champion): the order of each group's items.

    champion marks the item that beats every other one on at least `needed` scores (a majority by default).
    """
    k = len(scores)
    needed = needed or k // 2 + 1
    clean = _clean(df, group, item, scores)
    sizes = _sizes(clean, small)
    large, most = sizes.agg(F.count("*"), F.max("size")).first()  # decide only how a group is worked off
    if large:
        parts = max(2, min(MOST_PARTS, -(-most // block)))
        few = clean.join(_small(sizes.select("g"), large), "g", "left_anti")
        out = _small_groups(few, k, needed, rounds).unionByName(_large_groups(clean, sizes, large, k, needed, rounds, block, parts))
    else:
        out = _small_groups(clean, k, needed, rounds)
    return out.withColumnsRenamed({"g": group, "i": item})


def majority_winners(achado: DataFrame) -> DataFrame:
    """(consulta_id, id) of the hits that the walk puts up and that prove to beat every other one on two scores of three."""
    return rank_walk(achado, "consulta_id", "id", ["cosseno", "bm25", "rrf"]).where("champion").select("consulta_id", "id")
