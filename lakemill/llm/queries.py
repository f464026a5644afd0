"""The training-data operators' queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from lakemill.llm import op05_mixing
from lakemill.llm.op02_suffix import op2_suffix_dedup
from lakemill.llm.op01_ann import op1_ann
from lakemill.llm.op06_decontamination import op6_decontamination
from lakemill.llm.op03_toxicity import op3_toxicity
from lakemill.llm.op04_quality import op4_quality
from lakemill.llm.op05_mixing import op5_mixing
from lakemill.llm.op07_attention import op7_attention
from lakemill.llm.op08_license import op8_license
from lakemill.llm.op09_simhash import op9_simhash
from lakemill.llm.op10_pii import op10_pii
from lakemill.llm.op11_resample import SQL as RESAMPLE_SQL
from lakemill.llm.op11_resample import op11_resample
from lakemill.llm.op12_chat import SQL as CHAT_SQL
from lakemill.llm.op12_chat import op12_chat
from lakemill.llm.op13_phrases import SQL as PHRASES_SQL
from lakemill.llm.op13_phrases import op13_phrases

QUERIES = {f.__name__: f for f in (op1_ann, op2_suffix_dedup, op3_toxicity, op4_quality, op5_mixing, op6_decontamination, op7_attention, op8_license, op9_simhash, op10_pii, op11_resample, op12_chat, op13_phrases)}

SQL = {
    "op5_mixing": op05_mixing.SQL.format(documents="documents"),
    "op11_resample": RESAMPLE_SQL.format(documents="documents", benchmark="benchmark"),
    "op12_chat": CHAT_SQL.format(conversations="conversations"),
    "op13_phrases": PHRASES_SQL.format(documents="documents"),
}
