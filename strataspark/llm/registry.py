"""The queries of this subpackage, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import licenses, line_dedup, media, minhash, mixing, negatives, packing, quality_model, quality_rules, secrets, toxicity, urls, whitening

QUERIES = {f.__name__: f for f in (minhash.op1_minhash_near_dedup, mixing.op2_mixing, licenses.op3_license_scan, media.op4_media_columns, quality_rules.op5_quality_rules, packing.op6_best_fit_packing, secrets.op7_secret_scan, line_dedup.op8_line_dedup, quality_model.op9_quality_classifier, toxicity.op10_toxicity, urls.op11_url_filter, negatives.op12_hard_negatives, whitening.op13_embedding_whitening, media.page_media_sequences, quality_rules.quality_rule_ablations)}
SQL = {"op2_mixing": mixing.OP2_SQL, "op5_quality_rules": quality_rules.OP5_SQL, "op12_hard_negatives": negatives.OP12_SQL, "quality_rule_ablations": quality_rules.ABLATIONS_SQL}
