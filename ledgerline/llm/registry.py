"""The queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from . import chat, decontaminate, divergence, filter_audit, lines, media, packing, pages, personal, quality, secrets, simhash, token_counts


def queries() -> dict:
    return {
        "op1_media_avi": media.op1_media_avi,
        "op2_quality": quality.op2_quality,
        "op3_chat_format": chat.op3_chat_format,
        "op4_page_text": pages.op4_page_text,
        "op5_simhash": simhash.op5_simhash,
        "op6_pack": packing.op6_pack,
        "op7_secret_scan": secrets.op7_secret_scan,
        "op8_line_dedup": lines.op8_line_dedup,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_token_counts": token_counts.op10_token_counts,
        "op11_personal_data": personal.op11_personal_data,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_filter_audit": filter_audit.op13_filter_audit,
    }


def oracle_sql() -> dict:
    return {
        "op2_quality": quality.quality_sql(),
        "op8_line_dedup": lines.line_dedup_sql(),
        "op9_decontaminate": decontaminate.leaks_sql(),
        "op11_personal_data": personal.personal_sql(),
        "op12_source_divergence": divergence.divergence_sql(),
        "op13_filter_audit": filter_audit.filter_audit_sql(),
    }
