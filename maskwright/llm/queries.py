"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from . import bag_minhash, bigru_lang, bloom_lm, bpe_trie, flac, host_rules, line_chunks, mixing, token_files, url_markov


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_bpe_trie": bpe_trie.op2_bpe_trie,
        "op3_token_files": token_files.op3_token_files,
        "op4_bag_minhash": bag_minhash.op4_bag_minhash,
        "op5_host_rules": host_rules.op5_host_rules,
        "op6_flac": flac.op6_flac,
        "op7_bigru_lang": bigru_lang.op7_bigru_lang,
        "op8_bloom_lm": bloom_lm.op8_bloom_lm,
        "op9_line_chunks": line_chunks.op9_line_chunks,
        "op10_url_markov": url_markov.op10_url_markov,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_host_rules": host_rules.ORACLE, "op10_url_markov": url_markov.ORACLE}
