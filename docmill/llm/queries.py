"""The queries of this subpackage and the SQL that checks them, for ``__spark_entry__``."""

from __future__ import annotations

from docmill.llm.decontaminate import op1_decontaminate
from docmill.llm.licenses import OP9_SQL, op9_license_scan
from docmill.llm.line_dedup import OP2_SQL, op2_line_dedup
from docmill.llm.lm import op5_lm_score
from docmill.llm.merkle import OP11_SQL, op11_merkle_manifest
from docmill.llm.mixing import OP8_SQL, op8_mix_sources
from docmill.llm.ngram_join import OP7_SQL, op7_ngram_join
from docmill.llm.quality import OP3_SQL, op3_quality_rules
from docmill.llm.secrets import op10_secret_scan
from docmill.llm.substring_dedup import OP4_SQL, op4_substring_dedup
from docmill.llm.suffix_dedup import OP12_SQL, op12_suffix_dedup
from docmill.llm.toxicity import op6_toxicity

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_lm_score": op5_lm_score,
    "op6_toxicity": op6_toxicity,
    "op7_ngram_join": op7_ngram_join,
    "op8_mix_sources": op8_mix_sources,
    "op9_license_scan": op9_license_scan,
    "op10_secret_scan": op10_secret_scan,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_suffix_dedup": op12_suffix_dedup,
}

#: None for toxicity (a fitted model) and secret scans (positions of matches, decoding): tests/llm holds those against plain Python.
ORACLE_SQL = {
    "op2_line_dedup": OP2_SQL,
    "op3_quality_rules": OP3_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op7_ngram_join": OP7_SQL,
    "op8_mix_sources": OP8_SQL,
    "op9_license_scan": OP9_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_suffix_dedup": OP12_SQL,
}
