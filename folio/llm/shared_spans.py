"""Problem 10: long exact runs shared between records, by fixed-block anchors.

Of every text the non-overlapping blocks of BLOCK characters are the index (any run of 2 * BLOCK
characters holds a whole block of either text), and every rolling window of BLOCK characters
probes it. Both are 64-bit rolling hashes, computed at array speed. So that probing needs no
shuffle of one row per character, the hashes of all blocks are first folded into a bitmap in the
shared folder (BITS bits a block; never on the driver), and only windows that it lets through
become rows. A bitmap has at most MOST_BITS bits; where one is not enough, up to MOST_PASSES are used,
each for its own part of the hash space. A collection beyond that shuffles its windows once and
semi-joins them with the blocks. Anchors that one record has alone drop out; the rest get the BLOCK
characters on either side and are extended, character by character.

Anchors inside a run (the same characters fill both sides) are never paired: a group of copies
costs pairs only at the ends of what they share, and only where pairs are asked for. Coverage makes
no pairs at all: a run of `least` characters around an anchor is a class, shared if two records have it.

Defined cases: null texts and texts shorter than `least` share nothing; equal texts share all of
them; repeated rows count once; a run within one record alone does not count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.session import fresh_path, passing, written

LEAST = 200
BITS = 24
MOST_BITS = 1 << 29  # 64 MB in each Python worker
MOST_PASSES = 4  # over the texts, one bitmap each; beyond that one shuffle of all windows is cheaper
SEGMENT = 1 << 16  # bits of the bitmap in one row of its table
SALTS = 8
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([np.ones(1, "u8"), np.cumprod(np.full(n - 1, b, "u8"))]) for b in (_BASE, _INVERSE))


@lru_cache(1)
def _mixed() -> np.ndarray:
    """The mixed value of every character of the basic plane."""
    return _mix(np.arange(1 << 16, dtype="u8") + np.uint64(1))


def _prefix_sums(text: str) -> np.ndarray:
    """Sums of mixed characters times rising powers, before each place."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "u4")
    up, _ = _powers(1 << max(12, int(len(c)).bit_length()))
    s = np.zeros(len(c) + 1, "u8")
    with np.errstate(over="ignore"):
        mixed = _mixed().take(c) if not len(c) or c.max() < 1 << 16 else _mix(c.astype("u8") + np.uint64(1))
        np.cumsum(mixed * up[: len(c)], out=s[1:])
    return s


def window_hashes(text: str, size: int) -> np.ndarray:
    """A 64-bit hash of every window of `size` code points."""
    if len(text) < size:
        return np.zeros(0, "u8")
    s = _prefix_sums(text)
    _, down = _powers(1 << max(12, int(len(text)).bit_length()))
    with np.errstate(over="ignore"):
        return _mix((s[size:] - s[:-size]) * down[: len(s) - size])


def block_hashes(text: str, size: int) -> np.ndarray:
    """The hashes of the windows at multiples of `size`."""
    if len(text) < size:
        return np.zeros(0, "u8")
    s = _prefix_sums(text)[::size]
    _, down = _powers(1 << max(12, int(len(text)).bit_length()))
    with np.errstate(over="ignore"):
        return _mix((s[1:] - s[:-1]) * down[::size][: len(s) - 1])


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three bit positions of each hash (bits is a power of two)."""
    m = np.uint64(bits - 1)
    return [h & m, (h >> np.uint64(17)) & m, (_mix(h)) & m]


_cache: dict[str, np.ndarray] = {}


def _bitmap(uri: str, bits: int) -> np.ndarray:
    """The bitmap, read from the shared folder once per Python worker."""
    if uri not in _cache:
        import pyarrow.dataset as ds
        import pyarrow.fs as fs

        known = uri.replace("s3a://", "s3://", 1) if "://" in uri else "file://" + uri.removeprefix("file:")
        system, path = fs.FileSystem.from_uri(known)
        out = np.zeros(bits // 8, "u1")
        for b in ds.dataset(path, filesystem=system, format="parquet").to_batches(batch_size=64):
            for seg, data in zip(b.column("seg").to_pylist(), b.column("data").to_pylist()):
                at = seg * (SEGMENT // 8)
                out[at : at + len(data)] = np.frombuffer(data, "u1")
        _cache.clear()
        _cache[uri] = out
    return _cache[uri]


def _of_pass(h: np.ndarray, p: int, passes: int) -> np.ndarray:
    return (h >> np.uint64(40)) % np.uint64(passes) == np.uint64(p)


def _write_bitmap(texts: DataFrame, block: int, bits: int, p: int, passes: int) -> str:
    """Folds the hashes of all blocks into a bitmap table of the shared folder; returns its place."""
    size = min(SEGMENT, bits)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [block_hashes(t, block) for t in b.t if t]
            if found:
                h = np.concatenate(found)
                if passes > 1:
                    h = h[_of_pass(h, p, passes)]
                at = np.unique(np.concatenate(_places(h, bits))).astype("i8")
                yield pd.DataFrame({"seg": (at // size).astype("i4"), "bit": at % size})

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(size, "u1")
        x[pdf.bit.to_numpy()] = 1
        return pd.DataFrame({"seg": pdf.seg.iloc[:1], "data": [np.packbits(x, bitorder="little").tobytes()]})

    path = fresh_path(texts.sparkSession, "blocks")
    found = texts.mapInPandas(blocks, "seg int, bit long")
    found.groupBy("seg").applyInPandas(fold, "seg int, data binary").write.parquet(path)
    passing(texts.sparkSession, path)
    return path


def _probe(texts: DataFrame, block: int, bits: int, uri: str, p: int, passes: int) -> DataFrame:
    """(h, d, pos) of every rolling window that the bitmap lets through; blocks always pass."""
    kind = dict(texts.dtypes)["d"]

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap = _bitmap(uri, bits)
        for b in batches:
            ds, hs, ps = [], [], []
            for d, t in zip(b.d, b.t):
                h = window_hashes(t, block)
                at = np.flatnonzero(_of_pass(h, p, passes)) if passes > 1 else np.arange(len(h))
                left = h[at]
                for k in range(3):
                    x = _places(left, bits)[k]
                    ok = (bitmap[x >> np.uint64(3)] >> (x & np.uint64(7)).astype("u1")) & 1 == 1
                    at, left = at[ok], left[ok]
                ds += [d] * len(at)
                hs.append(left.view("i8"))
                ps.append(at.astype("i4"))
            if ds:
                yield pd.DataFrame({"h": np.concatenate(hs), "d": ds, "pos": np.concatenate(ps)})

    return texts.mapInPandas(probe, f"h long, d {kind}, pos int")


def _joined(texts: DataFrame, block: int) -> DataFrame:
    """(h, d, pos) of every rolling window that is a block of some text, by a semi-join: for any size of collection."""
    kind = dict(texts.dtypes)["d"]

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [block_hashes(t, block) for t in b.t if t]
            if found:
                yield pd.DataFrame({"h": np.unique(np.concatenate(found)).view("i8")})

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, t in zip(b.d, b.t):
                h = window_hashes(t, block)
                yield pd.DataFrame({"h": h.view("i8"), "d": d, "pos": np.arange(len(h), dtype="i4")})

    known = texts.mapInPandas(blocks, "h long").distinct()
    return texts.mapInPandas(windows, f"h long, d {kind}, pos int").join(known, "h", "left_semi")


def anchors(documents: DataFrame, key: str, text: str, least: int = LEAST) -> DataFrame:
    """(h, d, pos, aligned, left, right): windows of least / 2 characters that stand in several
    records, one of them as a block, with up to as many characters on either side."""
    block = least // 2
    texts = documents.where(F.col(key).isNotNull() & (F.length(text) >= least)).select(F.col(key).alias("d"), F.col(text).alias("t"))
    blocks = texts.agg(F.sum(F.floor(F.length("t") / block))).first()[0] or 0
    bits = 1 << max(16, int(blocks * BITS - 1).bit_length() if blocks else 16)
    passes = max(1, -(-bits // MOST_BITS))
    bits = min(bits, MOST_BITS)
    if passes > MOST_PASSES:
        found = _joined(texts, block)
    else:
        found = reduce(DataFrame.unionByName, [_probe(texts, block, bits, _write_bitmap(texts, block, bits, p, passes), p, passes) for p in range(passes)])
    hits = written(found.dropDuplicates(), "probes")
    aligned = F.col("pos") % block == 0
    several = hits.groupBy("h").agg(F.min("d").alias("a"), F.max("d").alias("b"), F.max(aligned).alias("c")).where("a <> b and c").select("h")
    spread = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    real = hits.withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(SALTS)).cast("int")).join(spread, ["h", "salt"])
    lists = real.groupBy("d").agg(F.collect_list("pos").alias("at"), F.collect_list("h").alias("hs"))
    kind = dict(texts.dtypes)["d"]

    def context(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, t, at, hs in zip(b.d, b.t, b["at"], b.hs):
                out += [(h, d, p, p % block == 0, t[max(0, p - block) : p], t[p + block : p + 2 * block]) for p, h in zip(at, hs)]
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=["h", "d", "pos", "aligned", "left", "right"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["h", "d", "pos", "aligned", "left", "right"])

    schema = f"h long, d {kind}, pos int, aligned boolean, left string, right string"
    return written(texts.join(lists, "d").mapInPandas(context, schema), "anchors")


def _code_points(column: pd.Series, n: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=f"<U{n}").view("u4").reshape(len(column), n)


def _at_ends(found: DataFrame, block: int) -> DataFrame:
    """The anchors of groups but for those that lie inside a run throughout: all rows have the same full contexts."""
    full = lambda c: F.length(c) == block
    ends = found.groupBy("h").agg(
        F.min("left").alias("a"), F.max("left").alias("b"), F.min("right").alias("c"), F.max("right").alias("e")
    ).where(~((F.col("a") == F.col("b")) & full("a") & (F.col("c") == F.col("e")) & full("c"))).select("h")
    spread = ends.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return found.withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(SALTS)).cast("int")).join(spread, ["h", "salt"])


def run_ends(found: DataFrame, least: int = LEAST) -> DataFrame:
    """(da, pa, db, pb, l, r): pairs of equal anchors at the ends of a run of at least `least` characters,
    with how far the characters to the left and right agree (up to half of `least` each)."""
    block = least // 2
    full = lambda c: F.length(c) == block
    rows = _at_ends(found, block)
    names = ["d", "pos", "left", "right"]
    a = rows.where("aligned").select("h", *(F.col(c).alias(f"a_{c}") for c in names), "salt")
    b = rows.select("h", *(F.col(c).alias(f"b_{c}") for c in names), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    inside = (F.col("a_left") == F.col("b_left")) & full("a_left") & (F.col("a_right") == F.col("b_right")) & full("a_right")
    pairs = a.join(b, ["h", "salt"]).where((F.col("a_d") < F.col("b_d")) & ~inside)
    kind = dict(found.dtypes)["d"]

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if not len(p):
                continue
            al, bl = (_code_points(p[c].str[::-1], block) for c in ("a_left", "b_left"))
            ar, br = (_code_points(p[c], block) for c in ("a_right", "b_right"))
            agree = lambda x, y: np.logical_and.accumulate((x == y) & (x != 0), axis=1).sum(1)
            l, r = agree(al, bl), agree(ar, br)
            ok = block + l + r >= least
            yield pd.DataFrame({"da": p.a_d[ok], "pa": p.a_pos[ok], "db": p.b_d[ok], "pb": p.b_pos[ok], "l": l[ok], "r": r[ok]})

    return pairs.drop("h", "salt").mapInPandas(extend, f"da {kind}, pa int, db {kind}, pb int, l int, r int")


def shared_pairs(documents: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: records with a run of at least `least` characters in common."""
    return run_ends(anchors(documents, key, text, least), least).select(F.col("da").alias("doc_a"), F.col("db").alias("doc_b")).distinct()


def shared_windows(found: DataFrame, least: int = LEAST) -> DataFrame:
    """(d, s): the runs of `least` characters around an anchor at the end of a shared run, by their starts, that another
    record has as well. Around an anchor there are least / 2 + 1 of them; each is a class by anchor, place and hash."""
    block = least // 2
    kind = dict(found.dtypes)["d"]

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 2000):
                part = b.iloc[i : i + 2000]
                # left and right put together: its windows of `block` are what a run has besides the anchor
                ws = [window_hashes(x + y, block) for x, y in zip(part.left, part.right)]
                n = np.array([len(w) for w in ws], int)
                if n.sum():
                    before = np.repeat(part.left.str.len().to_numpy(), n) - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                    d, h, pos = (np.repeat(part[c].to_numpy(), n) for c in ("d", "h", "pos"))
                    yield pd.DataFrame({"h": h, "t": before.astype("i4"), "w": np.concatenate(ws).view("i8"), "d": d, "s": (pos - before).astype("i4")})

    rows = written(_at_ends(found, block).select("h", "d", "pos", "left", "right").mapInPandas(around, f"h long, t int, w long, d {kind}, s int"), "windows")
    same = ["h", "t", "w"]
    shared = rows.groupBy(*same).agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a <> b").select(*same)
    spread = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = F.pmod(F.xxhash64("d"), F.lit(SALTS)).cast("int")
    return rows.withColumn("salt", mine).join(spread, [*same, "salt"], "left_semi").select("d", "s").distinct()


def shared_coverage(documents: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, n_chars, trechos, compartilhado, parte): how many characters of each record stand in runs shared
    with another one, in how many maximal stretches, and what part of the record that is."""
    block = least // 2
    found = anchors(documents, key, text, least)
    runs = shared_windows(found, least).select("d", "s", (F.col("s") + least).alias("e"))
    # rows with the same anchor and the same full contexts as another record's lie in a run as a whole
    same = ["h", "left", "right"]
    whole = found.where((F.length("left") == block) & (F.length("right") == block))
    classes = whole.groupBy(*same).agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a <> b").select(*same)
    spread = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    inner = whole.withColumn("salt", F.pmod(F.xxhash64("d"), F.lit(SALTS)).cast("int")).join(spread, [*same, "salt"])
    inner = inner.select("d", (F.col("pos") - block).alias("s"), (F.col("pos") + 2 * block).alias("e"))
    spans = runs.unionByName(inner).distinct()
    before = Window.partitionBy("d").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    top = F.coalesce(F.max("e").over(before), F.lit(-1))
    merged = spans.withColumn("top", top).select(
        "d",
        F.when(F.col("s") > F.col("top"), 1).otherwise(0).alias("new"),
        F.greatest(F.col("e") - F.greatest("s", "top"), F.lit(0)).alias("n"),
    )
    sums = merged.groupBy("d").agg(F.sum("new").alias("trechos"), F.sum("n").alias("compartilhado"))
    sizes = documents.where(F.col(key).isNotNull()).select(F.col(key).alias("d"), F.length(text).cast("long").alias("n_chars")).distinct()
    return sizes.join(sums, "d", "left").select(
        F.col("d").alias(key),
        "n_chars",
        F.coalesce("trechos", F.lit(0)).cast("long").alias("trechos"),
        F.coalesce("compartilhado", F.lit(0)).cast("long").alias("compartilhado"),
        F.when(F.col("n_chars") > 0, F.coalesce("compartilhado", F.lit(0)) / F.col("n_chars")).otherwise(0.0).alias("parte"),
    )
