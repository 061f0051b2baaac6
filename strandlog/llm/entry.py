"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from strandlog.llm.bpe import op10_transducer_bpe
from strandlog.llm.chat import OP1_SQL, op1_typed_parts
from strandlog.llm.langid import op3_recurrent_langid
from strandlog.llm.lines import OP4_SQL, op4_deletion_neighbourhood
from strandlog.llm.pii import op5_feistel_pseudonyms
from strandlog.llm.repetition import OP6_SQL, op6_suffix_repetition
from strandlog.llm.simhash import op8_covering_simhash
from strandlog.llm.superkmers import OP7_SQL, op7_super_kmers
from strandlog.llm.urls import op2_boosted_urls
from strandlog.llm.winnowing import OP9_SQL, op9_winnowing

QUERIES = {f.__name__: f for f in (op1_typed_parts, op2_boosted_urls, op3_recurrent_langid, op4_deletion_neighbourhood, op5_feistel_pseudonyms, op6_suffix_repetition, op7_super_kmers, op8_covering_simhash, op9_winnowing, op10_transducer_bpe)}

SQL: dict[str, str] = {"op1_typed_parts": OP1_SQL, "op4_deletion_neighbourhood": OP4_SQL, "op6_suffix_repetition": OP6_SQL, "op7_super_kmers": OP7_SQL, "op9_winnowing": OP9_SQL}
