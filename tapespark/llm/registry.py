"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import chat, decontamination, langid, media, mixing, quality, scoring, simhash, toxicity, warc

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_lm": scoring.op2_lm,
    "op3_decontaminate": decontamination.op3_decontaminate,
    "op4_quality": quality.op4_quality,
    "op5_language": langid.op5_language,
    "op6_simhash": simhash.op6_simhash,
    "op7_media": media.op7_media,
    "op8_chat": chat.op8_chat,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_warc": warc.op10_warc,
}
SQL = {"op1_mix": mixing.SQL, "op8_chat": chat.SQL, "op10_warc": warc.SQL}
