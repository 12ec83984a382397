"""The registered queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from tideline.llm import chat, jaccard, quality, substring, urls, warc
from tideline.llm.chat import op6_chat_format
from tideline.llm.decontaminate import op4_decontaminate
from tideline.llm.jaccard import op8_ngram_jaccard
from tideline.llm.language import op5_language_id
from tideline.llm.mixer import op3_lm_score
from tideline.llm.mixing import op7_mixing
from tideline.llm.quality import op10_quality_rules
from tideline.llm.substring import op1_substring_dedup
from tideline.llm.urls import op2_url_filter
from tideline.llm.warc import op9_warc

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_lm_score": op3_lm_score,
    "op4_decontaminate": op4_decontaminate,
    "op5_language_id": op5_language_id,
    "op6_chat_format": op6_chat_format,
    "op7_mixing": op7_mixing,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_warc": op9_warc,
    "op10_quality_rules": op10_quality_rules,
}

ORACLE = {
    "op1_substring_dedup": substring.ORACLE_SQL,
    "op2_url_filter": urls.ORACLE_SQL,
    "op6_chat_format": chat.ORACLE_SQL,
    "op8_ngram_jaccard": jaccard.ORACLE_SQL,
    "op9_warc": warc.ORACLE_SQL,
    "op10_quality_rules": quality.ORACLE_SQL,
}
