"""Queries of the subpackage, one per operator, and their oracle SQL where SQL can say the same."""
from wordframe.llm import (decontamination, fingerprints, html_text, importance, language, licenses, line_dedup, mixing, near_dedup,
                           secrets, sharding, term_pipeline, toxicity)

QUERIES = {f.__name__: f for f in (
    licenses.op1_sentence_rules, near_dedup.op2_order_minhash, html_text.op3_tag_ratio_extraction,
    mixing.op4_pfair_mix, line_dedup.op5_simhash_lines, sharding.op6_hilbert_shards, fingerprints.op7_content_defined_chunks,
    language.op8_rank_order_profiles, decontamination.op9_fm_decontamination, secrets.op10_linked_credentials,
    term_pipeline.op11_term_pipeline, toxicity.op12_counterfactual_classifier, importance.op13_batch_resampling)}
ORACLES = {"op1_sentence_rules": licenses.ORACLE, "op9_fm_decontamination": decontamination.ORACLE,
           "op11_term_pipeline": term_pipeline.ORACLE, "op13_batch_resampling": importance.ORACLE}
