"""Queries of the training-data operators, and their SQL where SQL can say the same."""

from . import chat_format, decontaminate, exact_dedup, hard_negatives, license_scan, mixing, private_data, secret_scan, simhash, spelling, toxicity, url_filter, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_simhash": simhash.op9_simhash,
    "op10_warc": warc.op10_warc,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_private_data": private_data.op13_private_data,
}
ORACLES = {
    "op2_url_filter": url_filter.OP2_SQL,
    "op3_secret_scan": secret_scan.OP3_SQL,
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op6_chat_format": chat_format.OP6_SQL,
    "op8_mix_sources": mixing.OP8_SQL,
    "op10_warc": warc.OP10_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op12_spelling_variants": spelling.OP12_SQL,
    "op13_private_data": private_data.OP13_SQL,
}
