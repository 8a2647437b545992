"""The corpus operators' queries and their DuckDB oracles."""

from __future__ import annotations

from brinewell.llm.decontam import OP2_ORACLE, op2_decontamination
from brinewell.llm.hosts import op3_url_filter
from brinewell.llm.lmscore import op1_lm_score
from brinewell.llm.merkle import OP11_ORACLE, op11_merkle
from brinewell.llm.mixing import op5_mixing
from brinewell.llm.neardup import OP10_ORACLE, op10_neardup
from brinewell.llm.quality import op4_quality
from brinewell.llm.resample import OP12_ORACLE, op12_resample
from brinewell.llm.secrets import op7_secrets
from brinewell.llm.sentencepieces import op13_sentencepiece
from brinewell.llm.sharding import op8_sharding
from brinewell.llm.substrings import OP9_ORACLE, op9_substrings
from brinewell.llm.tokens import op6_tokens

QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_decontamination": op2_decontamination,
    "op3_url_filter": op3_url_filter,
    "op4_quality": op4_quality,
    "op5_mixing": op5_mixing,
    "op6_tokens": op6_tokens,
    "op7_secrets": op7_secrets,
    "op8_sharding": op8_sharding,
    "op9_substrings": op9_substrings,
    "op10_neardup": op10_neardup,
    "op11_merkle": op11_merkle,
    "op12_resample": op12_resample,
    "op13_sentencepiece": op13_sentencepiece,
}

ORACLES: dict[str, str] = {
    "op2_decontamination": OP2_ORACLE,
    "op9_substrings": OP9_ORACLE,
    "op10_neardup": OP10_ORACLE,
    "op11_merkle": OP11_ORACLE,
    "op12_resample": OP12_ORACLE,
}
