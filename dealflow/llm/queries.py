"""The registered queries of the subpackage, and their SQL twins."""

import corpus_pipeline

from . import bpe, collocations, decontamination, merkle, pieces, ppm, quality_rules, sharding, simhash_dedup, substring_dedup, suffix_dedup, token_counts, token_files

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_simhash_dedup": simhash_dedup.op2_simhash_dedup,
    "op3_ppm": ppm.op3_ppm,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_sharding": sharding.op5_sharding,
    "op6_token_files": token_files.op6_token_files,
    "op7_bpe": bpe.op7_bpe,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_merkle": merkle.op11_merkle,
    "op12_pieces": pieces.op12_pieces,
    "op13_collocations": collocations.op13_collocations,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op1_decontamination": decontamination.SQL,
    "op4_substring_dedup": substring_dedup.SQL,
    "op10_token_counts": token_counts.SQL,
    "op11_merkle": merkle.SQL,
    "op13_collocations": collocations.SQL,
}
