"""The subpackage's registered queries and their DuckDB SQL."""

from __future__ import annotations

from towerfill.llm import chat, decontam, joinsim, minmax, packing, phrases, pii, quality, rlz, rtree, shards, tagpath, warc

QUERIES = {
    "op1_warc_dictionary": warc.query,
    "op2_rlz_substring_dedup": rlz.query,
    "op3_tag_path_extraction": tagpath.query,
    "op4_ngram_jaccard_join": joinsim.query,
    "op5_pii_crf": pii.query,
    "op6_quality_rules": quality.query,
    "op7_minimax_shards": shards.query,
    "op8_best_fit_packing": packing.query,
    "op9_benchmark_decontamination": decontam.query,
    "op10_chat_formatting": chat.query,
    "op11_minmax_hashing": minmax.query,
    "op12_phrase_collocations": phrases.query,
    "op13_rtree_hard_negatives": rtree.query,
}

ORACLE = {
    "op1_warc_dictionary": warc.ORACLE,
    "op2_rlz_substring_dedup": rlz.ORACLE,
    "op4_ngram_jaccard_join": joinsim.ORACLE,
    "op6_quality_rules": quality.ORACLE,
    "op9_benchmark_decontamination": decontam.ORACLE,
    "op10_chat_formatting": chat.ORACLE,
    "op11_minmax_hashing": minmax.ORACLE,
    "op12_phrase_collocations": phrases.ORACLE,
    "op13_rtree_hard_negatives": rtree.ORACLE,
}
