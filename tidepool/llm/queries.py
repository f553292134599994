"""The queries of this folder and the SQL that says the same where SQL can."""

from tidepool.llm import decontaminate, host_suffixes, norm_topk, order_minhash, pu_quality, repair, sentencepieces, splitters, url_reputation, warc

QUERIES = {
    "op1_url_reputation": url_reputation.op1_url_reputation,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_norm_topk": norm_topk.op3_norm_topk,
    "op4_sampled_splitters": splitters.op4_sampled_splitters,
    "op5_host_suffixes": host_suffixes.op5_host_suffixes,
    "op6_warc": warc.op6_warc,
    "op7_repair_ids": repair.op7_repair_ids,
    "op8_order_minhash": order_minhash.op8_order_minhash,
    "op9_pu_quality": pu_quality.op9_pu_quality,
    "op10_sentencepiece": sentencepieces.op10_sentencepiece,
}

ORACLE_SQL = {"op1_url_reputation": url_reputation.OP1_SQL, "op3_norm_topk": norm_topk.OP3_SQL, "op4_sampled_splitters": splitters.OP4_SQL, "op6_warc": warc.OP6_SQL}
