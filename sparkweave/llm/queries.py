"""The queries of this subpackage and their SQL."""

from sparkweave.llm import decontaminate, langid, packing, phrases, pitman_yor, quality, secrets, simhash, spelling, substring, topk, toxicity, urlfilter

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_secrets": secrets.op2_secrets,
    "op3_topk": topk.op3_topk,
    "op4_langid": langid.op4_langid,
    "op5_packing": packing.op5_packing,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_substring": substring.op7_substring,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_url_filter": urlfilter.op9_url_filter,
    "op10_simhash": simhash.op10_simhash,
    "op11_spelling": spelling.op11_spelling,
    "op12_phrases": phrases.op12_phrases,
    "op13_pitman_yor": pitman_yor.op13_pitman_yor,
}

ORACLES = {
    "op3_topk": topk.OP3_SQL,
    "op6_decontamination": decontaminate.OP6_SQL,
    "op7_substring": substring.OP7_SQL,
    "op9_url_filter": urlfilter.OP9_SQL,
    "op11_spelling": spelling.OP11_SQL,
    "op12_phrases": phrases.OP12_SQL,
}
