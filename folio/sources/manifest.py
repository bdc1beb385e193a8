"""The manifest of sources: a small YAML or JSON file, or a table, checked before use."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, titulo string, orgao string, ano int, url string, base_legal string, redistribuivel boolean, areas array<string>, sha256 string, substitui string"
REQUIRED = ["id", "titulo", "orgao", "ano", "url", "base_legal", "redistribuivel", "areas"]
KNOWN = [c.split()[0] for c in SCHEMA.split(", ")]


class InvalidManifest(ValueError):
    pass


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The sources of a manifest in order (`posicao`); unknown or missing fields, repeated ids and replaced
    sources that do not exist raise InvalidManifest and name the source."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            data = json.load(f)
        else:
            try:
                import yaml
            except ImportError as e:  # pragma: no cover - depends on the installation
                raise RuntimeError("a YAML manifest needs the yaml package; JSON needs none") from e
            data = yaml.safe_load(f)
    rows = []
    for k, entry in enumerate((data or {}).get("fontes", [])):
        name = entry.get("id", f"entry {k}")
        missing = [c for c in REQUIRED if entry.get(c) is None]
        if missing:
            raise InvalidManifest(f"{name}: missing {', '.join(missing)}")
        unknown = sorted(set(entry) - set(KNOWN))
        if unknown:
            raise InvalidManifest(f"{name}: unknown {', '.join(unknown)}")
        rows.append((*(entry.get(c) for c in KNOWN), k))
    df = spark.createDataFrame(rows, SCHEMA + ", posicao int")
    bad = problems(df).orderBy("id", "problema").first()
    if bad:
        raise InvalidManifest(f"{bad.id}: {bad.problema}")
    return df


def problems(sources: DataFrame) -> DataFrame:
    """(id, problema) of a table of sources: a missing field, a repeated id, a replaced source that does not exist."""
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]), lambda c: c.isNotNull())
    fields = sources.where(F.size(missing) > 0).select("id", F.concat(F.lit("missing "), F.array_join(missing, ", ")).alias("problema")).distinct()
    repeated = sources.where("id is not null").groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("problema"))
    ids = sources.where("id is not null").select(F.col("id").alias("substitui")).distinct()
    dangling = sources.where("substitui is not null").join(ids, "substitui", "left_anti")
    dangling = dangling.select("id", F.concat(F.lit("replaces unknown "), "substitui").alias("problema")).distinct()
    return fields.unionByName(repeated).unionByName(dangling)
