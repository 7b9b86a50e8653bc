"""The registered queries against DuckDB or against plain versions on the smallest tables."""

import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from geohour.llm.common import read  # noqa: E402
from geohour.llm.queries import ORACLES, QUERIES  # noqa: E402
from workload.compare import compare, oracle  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in read(spark, SF_DIR, "documents").collect()}


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_oracle(spark, name):
    _, n, problem = compare(spark, SF_DIR, name, QUERIES[name], ORACLES[name], oracle(SF_DIR))
    assert problem is None
    assert n > 0


def test_packing_holds_each_token_once(spark, docs, tokenizer):
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for d, t in docs.items()}
    brute.check_packing(QUERIES["op1_pack_mixture"](spark, SF_DIR).collect(), ids)


def test_quality_counts(spark, docs):
    for r in QUERIES["op6_quality_rules"](spark, SF_DIR).collect():
        want = brute.quality_counts(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)


def test_simhash_components(spark, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash_pivots"](spark, SF_DIR).collect()}
    assert got == brute.simhash_components(docs)


def test_suffix_repeats(spark, docs):
    want = dict(zip(docs, brute.without_repeats([(t or "").encode() for t in docs.values()])))
    rows = QUERIES["op8_suffix_repeats"](spark, SF_DIR).collect()
    assert len(rows) == len(docs)
    for r in rows:
        kept, removed, runs = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len((docs[r.doc_id] or "").encode()), removed, runs)
        assert r.kept_sha256 == brute.sha(kept)


def test_extraction_follows_the_markup(spark):
    """On pages with an article element the labeller agrees with what the markup says."""
    from geohour.llm import extract

    html = {r.page_id: r.html for r in read(spark, SF_DIR, "pages").collect()}
    for r in QUERIES["op4_extract_main_text"](spark, SF_DIR).collect():
        want = "\n".join(b.text for b in extract.blocks_of(html[r.page_id] or "") if extract.weak_label(b.path))
        assert r.text == want and r.n_chars == len(want)


def test_grades_find_abuse_and_junk(spark):
    rows = {r.doc_id: r for r in QUERIES["op5_grades"](spark, SF_DIR).collect()}
    labels = read(spark, SF_DIR, "labels").collect()
    good = [rows[r.doc_id].selected for r in labels if r.quality == 1 and r.toxic == 0]
    assert np.mean(good) > 0.95
    assert all(0 <= r.tail <= 1 and 0 <= r.expected_grade <= 2 for r in rows.values())


def test_archive_records_point_to_their_response(spark):
    rows = QUERIES["op9_warc_derivatives"](spark, SF_DIR).collect()
    ids = {r.record_id for r in rows if r.record_type == "response"}
    assert len(ids) * 3 == len(rows) == len({r.record_id for r in rows})
    assert all(r.refers_to in ids for r in rows if r.record_type != "response")
