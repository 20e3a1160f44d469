"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from lattica.llm import perspectives
from lattica.llm.chains import op4_chains
from lattica.llm.decision_rules import op10_decision_rules
from lattica.llm.kneser_ney import op1_kneser_ney
from lattica.llm.line_chunks import op7_line_chunks
from lattica.llm.multi_index import op3_multi_index
from lattica.llm.packing import op2_packing
from lattica.llm.perspectives import op8_perspectives
from lattica.llm.pii import op6_pii
from lattica.llm.sentencepieces import op5_sentencepiece
from lattica.llm.simhash import op9_simhash

QUERIES = {f.__name__: f for f in (op1_kneser_ney, op2_packing, op3_multi_index, op4_chains, op5_sentencepiece, op6_pii, op7_line_chunks, op8_perspectives, op9_simhash, op10_decision_rules)}

#: DuckDB SQL of those that SQL can express on whole tables.
ORACLES: dict[str, str] = {"op8_perspectives": perspectives.ORACLE}
