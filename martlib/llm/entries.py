"""Registered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from martlib.llm import chat_format, clustering, mixing, quality_rules, resampling, sharding
from martlib.llm.bpe import op4_bpe
from martlib.llm.chat_format import op6_chat_format
from martlib.llm.clustering import op11_centroid_clustering
from martlib.llm.edit_fingerprints import op8_edit_fingerprints
from martlib.llm.html_extract import op2_html_extract
from martlib.llm.language_id import op5_language_id
from martlib.llm.mixing import op10_mixing
from martlib.llm.quality_rules import op3_quality_rules
from martlib.llm.resampling import op12_importance_resampling
from martlib.llm.secret_scan import op1_secret_scan
from martlib.llm.sharding import op13_sharding
from martlib.llm.simhash import op7_simhash
from martlib.llm.toxicity import op9_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_html_extract, op3_quality_rules, op4_bpe, op5_language_id, op6_chat_format, op7_simhash, op8_edit_fingerprints, op9_toxicity, op10_mixing,
        op11_centroid_clustering, op12_importance_resampling, op13_sharding,
    )
}
ORACLE_SQL = {
    "op3_quality_rules": quality_rules.ORACLE_SQL,
    "op6_chat_format": chat_format.ORACLE_SQL,
    "op10_mixing": mixing.ORACLE_SQL,
    "op11_centroid_clustering": clustering.ORACLE_SQL,
    "op12_importance_resampling": resampling.ORACLE_SQL,
    "op13_sharding": sharding.ORACLE_SQL,
}
