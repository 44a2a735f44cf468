"""Registered queries of this subpackage and their SQL."""

from tracemill.llm.conversations import op11_conversations
from tracemill.llm.decontaminate import op5_decontaminate
from tracemill.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from tracemill.llm.language import op10_language
from tracemill.llm.minhash import op8_minhash
from tracemill.llm.mixing import op3_mixing
from tracemill.llm.oracles import OP2_SQL, OP4_SQL, OP5_SQL, OP8_SQL, OP11_SQL, OP13_SQL
from tracemill.llm.quality import op9_quality
from tracemill.llm.substring_dedup import op4_substring_dedup
from tracemill.llm.suffix_dedup import op2_suffix_dedup
from tracemill.llm.token_counts import op12_token_counts
from tracemill.llm.token_output import op7_token_output
from tracemill.llm.url_filter import OP6_SQL, op6_url_filter
from tracemill.llm.vector_codes import op13_vector_codes

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_mixing": op3_mixing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_url_filter": op6_url_filter,
    "op7_token_output": op7_token_output,
    "op8_minhash": op8_minhash,
    "op9_quality": op9_quality,
    "op10_language": op10_language,
    "op11_conversations": op11_conversations,
    "op12_token_counts": op12_token_counts,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL = {
    "op1_exact_dedup": OP1_SQL,
    "op2_suffix_dedup": OP2_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op5_decontaminate": OP5_SQL,
    "op6_url_filter": OP6_SQL,
    "op8_minhash": OP8_SQL,
    "op11_conversations": OP11_SQL,
    "op13_vector_codes": OP13_SQL,
}
