"""Problem 6: occurrences and record counts of every term, kept up to date by signed deltas.

A change set names the (term, record) pairs that were added, changed or deleted, with their rows
before and after. It is aggregated into signed changes per term (occurrences by their counts, records
by whether the pair had any row before and has any after) and merged into a stored table of counts
that is split into buckets by a hash of the term. A merge reads and rewrites only the buckets that the
change set touches, in a folder of its own, and then adds one small file that names the folder of each
bucket. State files are never overwritten: a job that dies half-way leaves the last state. The number
of records of the collection is stored and changed along with the counts.

The queries take the postings in as they came: a first change set of those indexed in the first half
of the time that the table covers, then one of the late ones.

Defined cases: rows with null or empty term, null record, or null or non-positive count do not
count; repeated rows count once; a term whose record count falls to zero leaves the table; an empty
change set changes nothing; rows without a time are in the first set; extra columns are ignored.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.distinctive import SALTS, counting_records
from folio.session import fresh_path, passing

COUNTS = "term string, occurrences long, records long"
VALID = "term is not null and term <> '' and doc_ord is not null and tf > 0"
PAIR = ["term", "doc_ord"]


def changes(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows after, rows before) of the pairs whose rows differ between two snapshots."""
    keep = [*PAIR, "tf"]
    a, b = (x.where(VALID).select(*keep).distinct() for x in (before, after))
    pairs = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(2))).groupBy(*keep).agg(F.sum("side").alias("sides"))
    pairs = pairs.where("sides <> 3").select(*PAIR).distinct()
    return b.join(pairs, PAIR, "left_semi"), a.join(pairs, PAIR, "left_semi")


def late_changes(early: DataFrame, late: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows after, rows before) of the pairs that late rows add to."""
    new = late.where(VALID).select(*PAIR, "tf")
    before = early.where(VALID).select(*PAIR, "tf").join(new.select(*PAIR).distinct(), PAIR, "left_semi")
    return before.unionByName(new), before


def signed_deltas(after: DataFrame | None, before: DataFrame | None = None) -> DataFrame:
    """(term, occurrences, records): what changes for each term as its pairs go from the rows before to those after.

    Every term is aggregated in SALTS parts first, by one shuffle of the change set."""
    parts = [
        x.where(VALID).select("term", "doc_ord", F.col("tf").cast("long").alias("tf"), F.lit(s).alias("sign"))
        for x, s in ((after, 1), (before, -1))
        if x is not None
    ]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_ord"), F.lit(SALTS)).cast("int")).repartition("term", "salt").distinct()
    pairs = rows.groupBy("term", "salt", "doc_ord").agg(
        F.sum(F.col("tf") * F.col("sign")).alias("tf"), (F.max((F.col("sign") > 0).cast("int")) - F.max((F.col("sign") < 0).cast("int"))).alias("record")
    )
    return (
        pairs.groupBy("term", "salt")
        .agg(F.sum("tf").alias("occurrences"), F.sum("record").alias("records"))
        .groupBy("term")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        .where("occurrences <> 0 or records <> 0")
    )


class TermCounts:
    """The stored counts. path/state-N.json, the last N of which holds, names the folder of each bucket."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, lead: str) -> list[str]:
        if not self._fs.exists(self._root):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(self._root)) if n.startswith(lead))

    def state(self) -> dict:
        """{"buckets": how many, "records": of the collection, "at": {bucket: folder}, "number": N}."""
        files = self._names("state-")
        if not files:
            return {"buckets": self.buckets, "records": 0, "at": {}, "number": 0}
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/{files[-1]}").collect()))

    def _commit(self, state: dict) -> None:
        """Adds a state file under a name of its own: written aside, then renamed, never over another."""
        path = lambda n: self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}")
        aside = path(f"_new-{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(state), "utf-8"))
        out.close()
        if not self._fs.rename(aside, path(f"state-{state['number']:09d}.json")):
            raise RuntimeError("another job has merged at the same time; nothing was changed")

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all states but the last `keep`, and the folders that none of these names."""
        files = self._names("state-")
        used = set()
        for f in files[-keep:]:
            used |= set(json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/{f}").collect()))["at"].values())
        for n in [*files[:-keep], *(v for v in self._names("v-") if v not in used)]:
            self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}"), True)

    def _read(self, at: dict[str, str]) -> DataFrame:
        paths = [f"{self.path}/{v}/bucket={b}" for b, v in sorted(at.items())]
        return self.spark.read.schema(COUNTS).parquet(*paths) if paths else self.spark.createDataFrame([], COUNTS)

    def merge(self, deltas: DataFrame, records: int = 0) -> None:
        """Adds signed deltas, and the change of the number of records; at most as many names as buckets come to the driver."""
        state = self.state()
        at, version, aside = state["at"], f"v-{uuid.uuid4().hex}", None
        bucket = F.pmod(F.xxhash64("term"), F.lit(state["buckets"])).cast("int")
        touched = None
        if at:  # read twice below, so it is written once
            aside = f"{self.path}/_delta-{uuid.uuid4().hex}"
            deltas.withColumn("bucket", bucket).write.parquet(aside)
            deltas = self.spark.read.schema(COUNTS + ", bucket int").parquet(aside)
            touched = {str(r[0]) for r in deltas.select("bucket").distinct().collect()}
            deltas = (
                deltas.select("term", "occurrences", "records")
                .unionByName(self._read({b: v for b, v in at.items() if b in touched}))
                .groupBy("term")
                .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
            )
        merged = deltas.where("records > 0").select("term", "occurrences", "records", bucket.alias("bucket"))
        merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{version}")
        held = self._fs.listStatus(self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{version}"))
        there = {s.getPath().getName().partition("=")[2] for s in held if s.getPath().getName().startswith("bucket=")}
        kept = {b: v for b, v in at.items() if touched is not None and b not in touched}
        self._commit({"buckets": state["buckets"], "records": state["records"] + records, "at": kept | {b: version for b in there}, "number": state["number"] + 1})
        if aside:
            self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(aside), True)

    def counts(self) -> DataFrame:
        return self._read(self.state()["at"])


def marked(counts: DataFrame, records: int, rare: int = 2, common: float = 0.5) -> DataFrame:
    """Counts with marca: 'raro' (in at most `rare` records), 'comum' (in more than that share of all), else null."""
    return counts.withColumn(
        "marca",
        F.when(F.col("records") <= rare, "raro").when(F.col("records") > common * records, "comum"),
    )


def stored_counts(postings: DataFrame, when: str = "indexado_em", buckets: int = 16) -> TermCounts:
    """A new store in the shared folder that takes in the early postings, then the late ones as a change set."""
    spark = postings.sparkSession
    store = TermCounts(spark, fresh_path(spark, "terms"), buckets)
    first, last = postings.agg(F.min(when), F.max(when)).first()
    if first is None or first == last:
        early, late = postings, None
    else:
        middle = F.lit(first + (last - first) / 2)
        early, late = postings.where(F.col(when).isNull() | (F.col(when) < middle)), postings.where(F.col(when) >= middle)
    store.merge(signed_deltas(early), counting_records(early))
    passing(spark, store.path)
    if late is not None:
        new = late.where(VALID).select("doc_ord").distinct().join(early.where(VALID).select("doc_ord").distinct(), "doc_ord", "left_anti")
        store.merge(signed_deltas(*late_changes(early, late)), new.count())
        store.vacuum(1)
    return store
