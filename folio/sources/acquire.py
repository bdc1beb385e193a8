"""Fetching sources and checking what came: magic bytes, hash, provenance."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"%PDF-"


class UnexpectedContent(ValueError):
    pass


class ChangedSource(ValueError):
    pass


def http_fetch(url: str, timeout: float = 120) -> bytes:
    """A GET with a browser's user agent that follows redirects and raises on an error status."""
    import urllib.request

    request = urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36"})
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return r.read()


def acquire(source: dict, folder: str, fetch: Callable[[str], bytes] = http_fetch, today: Callable[[], date] = date.today) -> dict:
    """Fetches a source, checks it and only then writes it; returns its record."""
    data = fetch(source["url"])
    if not data.startswith(MAGIC):
        raise UnexpectedContent(f"{source['id']}: not a PDF")
    digest = hashlib.sha256(data).hexdigest()
    if source.get("sha256") and source["sha256"] != digest:
        raise ChangedSource(f"{source['id']}: sha256 is {digest}")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"{source['id']}.pdf"), "wb") as f:
        f.write(data)
    return {"id": source["id"], "url": source["url"], "sha256": digest, "bytes": len(data), "baixado_em": today().isoformat()}


def acquire_all(
    sources: list[dict], folder: str, provenance: str, fetch: Callable[[str], bytes] = http_fetch, say: Callable[[str], None] = lambda line: None
) -> list[str]:
    """Acquires every source and says how each went; failures are returned and skipped. Provenance holds the successes, if any."""
    records, failed = [], []
    for s in sources:
        try:
            r = acquire(s, folder, fetch)
        except Exception as e:  # noqa: BLE001 - one source must not stop the others
            failed.append(f"{s['id']}: {e}")
            say(f"FALHOU  {failed[-1]}")
        else:
            records.append(r)
            say(f"ok      {r['id']}  {r['sha256'][:12]}  {r['bytes']} bytes")
    if records:
        write_provenance(records, provenance)
    return failed


def write_provenance(records: list[dict], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(sorted(records, key=lambda r: r["id"]), indent=2, ensure_ascii=False) + "\n")


def scan_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(id, sha256, bytes, magico) of fetched files, hashed where they lie."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(
        F.regexp_extract("path", r"([^/]+)\.[^./]*\z", 1).alias("id"),
        F.sha2("content", 256).alias("sha256"),
        F.length("content").cast("long").alias("bytes"),
        (F.substring("content", 1, len(MAGIC)) == F.lit(bytearray(MAGIC))).alias("magico"),
    )


def diverging(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(id, problema) of sources whose file is absent, is no PDF or has another hash than declared."""
    f = files.select("id", F.col("sha256").alias("achado"), "magico")
    why = (
        F.when(F.col("achado").isNull(), "absent")
        .when(~F.col("magico"), "not a PDF")
        .when(F.col("sha256").isNotNull() & (F.col("sha256") != F.col("achado")), "changed")
    )
    return sources.select("id", "sha256").distinct().join(f, "id", "left").select("id", why.alias("problema")).where("problema is not null")
