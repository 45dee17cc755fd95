"""The queries of this package and, where SQL can say it, their DuckDB SQL."""

from tidemark.llm import alignment, chat_format, decontaminate, language_id, periodic, pieces, repeats, secret_scan, sharding, simhash, token_counts, topk, url_filter


def queries():
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_topk": topk.op2_topk,
        "op3_sharding": sharding.op3_sharding,
        "op4_language_id": language_id.op4_language_id,
        "op5_pieces": pieces.op5_pieces,
        "op6_chat_format": chat_format.op6_chat_format,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_repeats": repeats.op10_repeats,
        "op11_alignment": alignment.op11_alignment,
        "op12_periodic": periodic.op12_periodic,
        "op13_secrets": secret_scan.op13_secrets,
    }


def oracle_sql():
    return {"op2_topk": topk.OP2_SQL, "op6_chat_format": chat_format.OP6_SQL, "op7_url_filter": url_filter.OP7_SQL, "op8_decontaminate": decontaminate.OP8_SQL, "op10_repeats": repeats.OP10_SQL}
