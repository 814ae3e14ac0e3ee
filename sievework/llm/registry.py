"""The subpackage's queries and their DuckDB SQL."""

from __future__ import annotations

from . import decontamination, filter_audit, language_id, lexical_search, media_column, mixing, secret_scan, simhash, substring_dedup, token_counts, token_files, toxicity, url_filter

QUERIES = {
    f.__name__: f
    for f in (
        secret_scan.op1_secret_scan, mixing.op2_mixing, media_column.op3_media_column, decontamination.op4_decontamination, token_files.op6_token_files,
        language_id.op7_language_id, simhash.op8_simhash, substring_dedup.op5_substring_dedup, token_counts.op10_token_counts, url_filter.op9_url_filter, mixing.mixing_targets,
        filter_audit.op13_filter_audit, lexical_search.op11_lexical_search, toxicity.op12_toxicity,
    )
}
SQL = {"op1_secret_scan": secret_scan.OP1_SQL, "op5_substring_dedup": substring_dedup.OP5_SQL, "mixing_targets": mixing.TARGETS_SQL, "op13_filter_audit": filter_audit.OP13_SQL, "op11_lexical_search": lexical_search.OP11_SQL}
