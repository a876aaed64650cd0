"""The subpackage's queries and the SQL of those that SQL can express."""

from __future__ import annotations

from bundlelens.llm import audit, bpe, chat, collocations, gam, licenses, lines, lm, mixing, quality, simhash, topk, warc


def queries() -> dict:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_licenses": licenses.op2_licenses,
        "op3_mixing": mixing.op3_mixing,
        "op4_bpe": bpe.op4_bpe,
        "op5_warc": warc.op5_warc,
        "op6_topk": topk.op6_topk,
        "op7_lm": lm.op7_lm,
        "op8_host_rules": quality.op8_host_rules,
        "op9_line_dedup": lines.op9_line_dedup,
        "op10_chat_format": chat.op10_chat_format,
        "op11_collocations": collocations.op11_collocations,
        "op12_quality_gam": gam.op12_quality_gam,
        "op13_filter_audit": audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.OP3_SQL, "op5_warc": warc.OP5_SQL, "op6_topk": topk.OP6_SQL, "op8_host_rules": quality.OP8_SQL, "op9_line_dedup": lines.OP9_SQL, "op11_collocations": collocations.OP11_SQL, "op13_filter_audit": audit.OP13_SQL}
