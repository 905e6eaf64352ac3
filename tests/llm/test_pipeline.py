"""The corpus pipeline on the smallest tables: what each stage keeps, and why the rest went."""

from pathlib import Path

import pytest

import corpus_pipeline
from barloom.llm import decontaminate, jaccard, pii
from barloom.llm.common import stored, table

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")
def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        kept = stored(stage(spark, kept, FOLDER), name)
        rows = {r.doc_id: r for r in kept.collect()}
        assert len(rows) == kept.count() and set(rows) <= set(before)
        gone = set(before) - set(rows)
        if name != "mixing":
            assert kept.columns == columns
        if name == "toxicity":
            assert len(gone) < 0.25 * len(before)
        if name == "near_duplicates":
            assert jaccard.near_duplicates(kept).filter("doc_id <> component_id").count() == 0
        if name == "benchmark_decontamination":
            items = [tuple(r) for r in table(spark, FOLDER, "benchmark").select("item_id", "text").collect()]
            matcher = decontaminate.Matcher(items)
            assert gone == {i for i, t in before.items() if matcher.matches(t)}
        if name == "personal_data":
            assert not gone and all(not pii.base_spans(r.text) and r.n_chars == len(r.text) for r in rows.values())
        if name == "mixing":
            assert not gone and len({(r.mix_slot, r.mix_offset) for r in rows.values()}) == len(rows)
            assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in rows.values())
        before = {i: r.text for i, r in rows.items()}
