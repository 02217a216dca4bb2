"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from quoin.llm import bpe, hyperminhash, leaks, licenses, lines, outliers, quality, repair, secrets, tokenfiles, trie, urls, warc

QUERIES = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op10_leaks": leaks.op10_leaks,
    "op11_repair": repair.op11_repair,
    "op12_token_files": tokenfiles.op12_token_files,
    "op13_prefix_trie": trie.op13_prefix_trie,
    "op2_secrets": secrets.op2_secrets,
    "op3_warc": warc.op3_warc,
    "op4_bpe": bpe.op4_bpe,
    "op5_licenses": licenses.op5_licenses,
    "op6_url_filter": urls.op6_url_filter,
    "op7_quality": quality.op7_quality,
    "op8_quality_rules": outliers.op8_quality_rules,
    "op9_hyperminhash": hyperminhash.op9_hyperminhash,
}

ORACLES: dict[str, str] = {
    "op5_licenses": licenses.OP5_SQL,
    "op6_url_filter": urls.OP6_SQL,
    "op9_hyperminhash": hyperminhash.OP9_SQL,
    "op1_line_dedup": lines.OP1_SQL,
    "op3_warc": warc.OP3_SQL,
    "op13_prefix_trie": trie.OP13_SQL,
}
