"""Core queries over empty tables, and over tables with more columns, named like those used inside."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from folio.plans.queries import queries

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="test tables are not here")
EXTRA = ["q", "rank", "score", "key", "h", "salt", "seg", "s", "g", "i", "d", "t", "x", "n", "place", "best", "w", "dl", "df", "idf", "part", "legenda", "qvec", "cosine"]
HEAVY = ["hybrid_batch", "bm25_topk", "chunk_blocks", "caption_asof", "dense_topk", "guaranteed_delivery", "slug_ids", "block_exclusion", "exclusion_reasons", "doc_blocks", "piece_stats", "refused_pieces"]


def copies(spark, folder, change):
    for p in glob.glob(D + "/*.parquet"):
        change(spark.read.parquet(p)).write.parquet(f"{folder}/{os.path.basename(p)}")
    return str(folder)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return copies(spark, tmp_path_factory.mktemp("empty"), lambda df: df.where("false"))


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    return copies(spark, tmp_path_factory.mktemp("wide"), lambda df: df.withColumns({c: F.lit(0) for c in EXTRA if c not in df.columns}))


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty(spark, empty, name):
    rows = queries()[name](spark, empty).collect()
    assert len(rows) == (1 if name in ("corpus_stats", "signature_hash") else 0)


@pytest.mark.parametrize("name", HEAVY)
def test_more_columns(spark, wide, name):
    f = queries()[name]
    assert sorted(map(str, f(spark, wide).collect())) == sorted(map(str, f(spark, D).collect()))
