"""Problem 3: how distinctive a term is for a record, by a two-Poisson mixture per term.

Each term's occurrence counts over all records (those without it count as zero) are taken as a
mixture of a background and an elite Poisson; both are fitted by expectation-maximisation on the
histogram of the counts, so the fit costs per distinct count and not per posting. The score of an
occurrence count is the posterior of the elite component.

Defined cases: rows with null or empty term, null record or null or non-positive count do not
count; repeated rows count once; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16  # parts into which every term's postings are split, so that no term fills a task


def counting_rows(postings: DataFrame, salts: int = SALTS) -> DataFrame:
    """(term, doc_ord, tf, salt) of the rows that count, once each, partitioned by term and salt.

    The one shuffle of all postings: what follows per (term, salt) finds its rows in place.
    """
    return (
        postings.where("term is not null and term <> '' and doc_ord is not null and tf > 0")
        .select("term", "doc_ord", F.col("tf").cast("int").alias("tf"), F.pmod(F.xxhash64("doc_ord"), F.lit(salts)).cast("int").alias("salt"))
        .repartition("term", "salt")
        .distinct()
    )


def counting_records(postings: DataFrame) -> int:
    """Number of records with at least one counting row."""
    return (
        postings.where("term is not null and term <> '' and doc_ord is not null and tf > 0").agg(F.countDistinct("doc_ord")).first()[0]
    )


def em_two_poisson(start: np.ndarray, tf: np.ndarray, n: np.ndarray, records: int, rounds: int = 60) -> np.ndarray:
    """Mixture of each term, as rows (weight of elite, background rate, elite rate).

    start[i] is where the histogram (tf, n) of term i begins; the zero count is implied by records.
    """
    df = np.add.reduceat(n, start)
    occ = np.add.reduceat(n * tf, start)
    zero = np.maximum(records - df, 0.0)
    total = zero + df
    of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(tf))))
    mean = occ / total
    low, high = np.maximum(mean * 0.5, 1e-6), np.maximum(occ / df, mean * 1.5 + 1e-3) + 0.5
    weight = np.clip(0.5 * df / total, 1e-9, 0.5)
    for _ in range(rounds):
        odds = np.log(weight / (1 - weight)) + low - high
        slope = np.log(high / low)
        at_zero = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        at = 1 / (1 + np.exp(-np.clip(odds[of] + tf * slope[of], -700, 700)))
        elite = zero * at_zero + np.add.reduceat(n * at, start)
        elite_occ = np.add.reduceat(n * at * tf, start)
        weight = np.clip(elite / total, 1e-12, 1 - 1e-9)
        high = np.maximum(elite_occ / np.maximum(elite, 1e-12), 2e-9)
        low = np.clip((occ - elite_occ) / np.maximum(total - elite, 1e-12), 1e-9, high * 0.999)
    return np.stack([weight, low, high], 1)


def fit_terms(counting: DataFrame, records: int, rounds: int = 60) -> DataFrame:
    """(term, occurrences, records, weight, low, high): the mixture of every term."""
    histogram = (
        counting.groupBy("term", "salt", "tf")
        .agg(F.count("*").alias("n"))
        .groupBy("term")
        .agg(F.collect_list(F.struct("tf", "n")).alias("h"))
        .select("term", F.col("h.tf").alias("tf"), F.col("h.n").alias("n"))
    )

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            tfs, ns = [], []
            for t, m in zip(b.tf, b.n):
                v, at = np.unique(np.asarray(t, "f8"), return_inverse=True)
                tfs.append(v)
                ns.append(np.bincount(at, np.asarray(m, "f8")))
            start = np.concatenate([[0], np.cumsum([len(x) for x in tfs])[:-1]]).astype(int)
            tf, n = np.concatenate(tfs), np.concatenate(ns)
            fitted = em_two_poisson(start, tf, n, records, rounds)
            yield pd.DataFrame(
                {
                    "term": b.term.values,
                    "occurrences": np.add.reduceat(n * tf, start).astype("i8"),
                    "records": np.add.reduceat(n, start).astype("i8"),
                    "weight": fitted[:, 0],
                    "low": fitted[:, 1],
                    "high": fitted[:, 2],
                }
            )

    return histogram.mapInPandas(fit, "term string, occurrences long, records long, weight double, low double, high double")


def term_scores(postings: DataFrame, salts: int = SALTS, rounds: int = 60) -> DataFrame:
    """(doc_ord, term, tf, occurrences, records, score, log_odds) of every counting row.

    score is the elite posterior in [0, 1]; log_odds orders rows whose score rounds to 1.
    """
    counting = counting_rows(postings, salts)
    fitted = fit_terms(counting, counting_records(postings), rounds).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    odds = F.log(F.col("weight") / (1 - F.col("weight"))) + F.col("low") - F.col("high") + F.col("tf") * F.log(F.col("high") / F.col("low"))
    return (
        counting.join(fitted, ["term", "salt"])
        .withColumn("log_odds", odds)
        .select("doc_ord", "term", "tf", "occurrences", "records", (1 / (1 + F.exp(-F.col("log_odds")))).alias("score"), "log_odds")
    )


def dominated_terms(postings: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """(doc_ord, term) where the record has at least that share of all occurrences, and `least` of them; the posterior is a score and excludes nothing."""
    return (
        term_scores(postings)
        .where((F.col("tf") >= least) & (F.col("tf") >= share * F.col("occurrences")))
        .select("doc_ord", "term")
    )
