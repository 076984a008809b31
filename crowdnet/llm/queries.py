"""The corpus queries by name, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from crowdnet.llm import chat, decontaminate, languages, mixing, neardup, passages, quality, resample, sharding, warc

QUERIES = {
    "op1_chat": chat.op1_chat,
    "op2_langid": languages.op2_langid,
    "op3_quality": quality.op3_quality,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_neardup": neardup.op5_neardup,
    "op6_mix": mixing.op6_mix,
    "op7_warc": warc.op7_warc,
    "op8_passages": passages.op8_passages,
    "op9_resample": resample.op9_resample,
    "op10_shard": sharding.op10_shard,
}

ORACLES = {
    "op1_chat": chat.ORACLE,
    "op3_quality": quality.ORACLE,
    "op6_mix": mixing.ORACLE,
    "op7_warc": warc.ORACLE,
}
