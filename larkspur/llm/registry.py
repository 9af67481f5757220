"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import op1_topk, op2_mixing_lm, op3_chat, op4_decontamination, op5_surrogates, op6_jaccard, op7_warc, op8_licences, op9_mixing, op10_language

QUERIES = {
    "op1_topk": op1_topk.op1_topk,
    "op2_mixing_lm": op2_mixing_lm.op2_mixing_lm,
    "op3_chat": op3_chat.op3_chat,
    "op4_decontamination": op4_decontamination.op4_decontamination,
    "op5_surrogates": op5_surrogates.op5_surrogates,
    "op6_jaccard": op6_jaccard.op6_jaccard,
    "op7_warc": op7_warc.op7_warc,
    "op8_licences": op8_licences.op8_licences,
    "op9_mixing": op9_mixing.op9_mixing,
    "op10_language": op10_language.op10_language,
}
ORACLE_SQL = {
    "op1_topk": op1_topk.ORACLE,
    "op3_chat": op3_chat.ORACLE,
    "op4_decontamination": op4_decontamination.ORACLE,
    "op6_jaccard": op6_jaccard.ORACLE,
    "op7_warc": op7_warc.ORACLE,
    "op8_licences": op8_licences.ORACLE,
}
