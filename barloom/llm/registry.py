"""Queries of the training-data operators: one for each operator, over its whole tables."""

from __future__ import annotations

from barloom.llm import decontaminate, fingerprint, jaccard, katz, licenses, mixing, periodic, pii, resample, sentences, suffixes, toxicity, warc


def queries() -> dict:
    return {
        "op1_content_fingerprints": fingerprint.op1_content_fingerprints,
        "op2_pii": pii.op2_pii,
        "op3_katz_scores": katz.op3_katz_scores,
        "op4_mix_sources": mixing.op4_mix_sources,
        "op5_benchmark_leaks": decontaminate.op5_benchmark_leaks,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_sentence_spans": sentences.op7_sentence_spans,
        "op8_license_scan": licenses.op8_license_scan,
        "op9_near_duplicates": jaccard.op9_near_duplicates,
        "op10_repeated_substrings": suffixes.op10_repeated_substrings,
        "op11_importance_resample": resample.op11_importance_resample,
        "op12_periodic_runs": periodic.op12_periodic_runs,
        "op13_warc_archive": warc.op13_warc_archive,
    }


def oracle_sql() -> dict:
    return {
        "op4_mix_sources": mixing.OP4_SQL,
        "op11_importance_resample": resample.OP11_SQL,
        "op12_periodic_runs": periodic.OP12_SQL,
        "op13_warc_archive": warc.OP13_SQL,
    }
