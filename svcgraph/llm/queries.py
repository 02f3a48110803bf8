"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

import corpus_pipeline

from . import binary_records, chat_format, decontamination, fingerprints, language_id, license_scan, ngram_join, packing, periodic_runs, pii, resampling, topk_search, warc

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_topk_search": topk_search.op2_topk_search,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_binary_records": binary_records.op4_binary_records,
    "op5_warc": warc.op5_warc,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_language_id": language_id.op7_language_id,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_pack_cut": packing.op9_pack_cut,
    "op10_pii": pii.op10_pii,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_fingerprints": fingerprints.op13_fingerprints,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op2_topk_search": topk_search.SQL,
    "op5_warc": warc.SQL,
    "op8_ngram_join": ngram_join.SQL,
    "op12_importance_resampling": resampling.SQL,
}
