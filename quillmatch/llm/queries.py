"""The registered queries of the corpus operators and, where SQL can say the same, their oracles."""

from __future__ import annotations

from quillmatch.llm import bpe, exact, lines, mixing, quality, secrets, simhash, tokens, urls, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality": quality.op3_quality,
    "op4_urls": urls.op4_urls,
    "op5_exact_dedup": exact.op5_exact_dedup,
    "op6_lines": lines.op6_lines,
    "op7_secrets": secrets.op7_secrets,
    "op8_tokens": tokens.op8_tokens,
    "op9_bpe": bpe.op9_bpe,
    "op10_warc": warc.op10_warc,
}

ORACLE_SQL = {
    "op2_mixing": mixing.OP2_SQL,
    "op3_quality": quality.OP3_SQL,
    "op4_urls": urls.OP4_SQL,
    "op5_exact_dedup": exact.OP5_SQL,
    "op6_lines": lines.OP6_SQL,
    "op10_warc": warc.OP10_SQL,
}
