"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

import corpus_pipeline
from quillstone.llm import bit_sliced, decontaminate, html_text, lang_hd, license_scan, line_dedup, media_audio, near_dup, packing, quality_cnn, spelling, suffix_dedup, whitening

QUERIES: dict = {
    "op1_prefix_join": decontaminate.query,
    "op2_mpeg_audio": media_audio.query,
    "op3_site_spread": line_dedup.query,
    "op4_hd_profiles": lang_hd.query,
    "op5_byte_cnn": quality_cnn.query,
    "op6_hilbert_packing": packing.query,
    "op7_line_blocks": html_text.query,
    "op8_sparse_suffixes": suffix_dedup.query,
    "op9_licence_tfidf": license_scan.query,
    "op10_setsketch": near_dup.query,
    "op11_errata_trie": spelling.query,
    "op12_bit_sliced": bit_sliced.query,
    "op13_tiled_whitening": whitening.query,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL: dict = {
    "op1_prefix_join": decontaminate.ORACLE,
    "op3_site_spread": line_dedup.ORACLE,
    "op8_sparse_suffixes": suffix_dedup.ORACLE,
    "op9_licence_tfidf": license_scan.ORACLE,
    "op10_setsketch": near_dup.ORACLE,
    "op11_errata_trie": spelling.ORACLE,
}
