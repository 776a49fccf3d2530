"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from planeworks.llm.op1_suffix_dedup import op1_suffix_dedup
from planeworks.llm.op2_tokens import op2_tokens
from planeworks.llm.op3_packing import op3_packing
from planeworks.llm.op4_tiff import op4_tiff
from planeworks.llm.op5_simhash import op5_simhash
from planeworks.llm.op6_licenses import op6_licenses
from planeworks.llm.op7_substring_dedup import ORACLE as OP7_ORACLE
from planeworks.llm.op7_substring_dedup import op7_substring_dedup
from planeworks.llm.op8_decontaminate import ORACLE as OP8_ORACLE
from planeworks.llm.op8_decontaminate import op8_decontaminate
from planeworks.llm.op9_secrets import ORACLE as OP9_ORACLE
from planeworks.llm.op9_secrets import op9_secrets
from planeworks.llm.op10_toxicity import op10_toxicity

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_tokens": op2_tokens,
    "op3_packing": op3_packing,
    "op4_tiff": op4_tiff,
    "op5_simhash": op5_simhash,
    "op6_licenses": op6_licenses,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_secrets": op9_secrets,
    "op10_toxicity": op10_toxicity,
}
ORACLES: dict[str, str] = {"op7_substring_dedup": OP7_ORACLE, "op8_decontaminate": OP8_ORACLE, "op9_secrets": OP9_ORACLE}
