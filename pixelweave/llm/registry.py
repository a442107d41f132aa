"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from . import (op10_topk, op11_spelling, op12_huffman, op13_centroids, op1_jaccard, op2_passages, op3_mix, op4_lm, op5_license, op6_shard, op7_warc, op8_quality, op9_decontaminate)

_OPERATORS = (op1_jaccard, op2_passages, op3_mix, op4_lm, op5_license, op6_shard, op7_warc, op8_quality, op9_decontaminate, op10_topk,
              op11_spelling, op12_huffman, op13_centroids)


def queries() -> dict:
    return {m.NAME: m.query for m in _OPERATORS}


def oracles() -> dict:
    return {m.NAME: m.ORACLE_SQL for m in _OPERATORS if m.ORACLE_SQL}
