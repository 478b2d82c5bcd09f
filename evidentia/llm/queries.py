"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from evidentia.llm.conversations import op11_conversation_repair
from evidentia.llm.decontaminate import op7_decontaminate
from evidentia.llm.embedding_graph import op8_embedding_graph
from evidentia.llm.language_id import op6_language_id
from evidentia.llm.language_model import op9_language_model
from evidentia.llm.lexical_search import OP12_SQL, op12_lexical_search
from evidentia.llm.line_dedup import op10_line_dedup
from evidentia.llm.minhash import op4_minhash
from evidentia.llm.mixing import OP13_SQL, op13_mixing
from evidentia.llm.packing import op2_packing
from evidentia.llm.token_counts import op1_token_counts
from evidentia.llm.token_files import op3_token_files
from evidentia.llm.url_filter import OP5_SQL, op5_url_filter

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_packing": op2_packing,
    "op3_token_files": op3_token_files,
    "op4_minhash": op4_minhash,
    "op5_url_filter": op5_url_filter,
    "op6_language_id": op6_language_id,
    "op7_decontaminate": op7_decontaminate,
    "op8_embedding_graph": op8_embedding_graph,
    "op9_language_model": op9_language_model,
    "op10_line_dedup": op10_line_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_lexical_search": op12_lexical_search,
    "op13_mixing": op13_mixing,
}
ORACLE_SQL = {"op5_url_filter": OP5_SQL, "op12_lexical_search": OP12_SQL, "op13_mixing": OP13_SQL}
