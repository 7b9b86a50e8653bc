"""The pipeline's stages against plain versions, each on the rows its predecessor kept."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402

from geohour.llm import quality_rules  # noqa: E402
from geohour.llm.common import prepare, read  # noqa: E402
from geohour.session import materialize  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_stages(spark):
    prepare(spark)
    docs = read(spark, SF_DIR, "documents")
    items = {r.item_id: r.text for r in read(spark, SF_DIR, "benchmark").collect()}
    forest = quality_rules.fit(docs, read(spark, SF_DIR, "labels"))
    kept = docs
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialize(stage(spark, kept, SF_DIR), name)
        assert kept.columns == docs.columns
        after = {r.doc_id: r.text for r in kept.collect()}
        if name == "quality_rules":
            good = {r.doc_id for r in quality_rules.judge(docs, forest, "q").where("q.kept").collect()}
            assert set(after) == good and len(good) > 0.7 * len(before)
        elif name == "simhash_near_dedup":
            assert set(after) == {c for _, c in brute.simhash_components(before).values()}
        elif name == "suffix_array_dedup":
            want = brute.without_repeats([t.encode() for t in before.values()])
            assert after == {d: w[0].decode(errors="ignore") for d, w in zip(before, want)}
        else:
            assert set(after) == {d for d, t in before.items() if not brute.contaminated_words(t, items)[1]}
        before = after
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id for r in rows} == set(before)


def test_stages_take_empty_tables_and_extra_columns(spark):
    from pyspark.sql import functions as F

    docs = read(prepare(spark), SF_DIR, "documents").limit(0).withColumn("__rules", F.lit(1)).withColumn("spans", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() == 0
