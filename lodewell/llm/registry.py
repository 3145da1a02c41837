"""The training-data queries for __spark_entry__.py, and SQL for those that SQL can express."""

from lodewell.llm.bpe import op9_byte_level_bpe
from lodewell.llm.fingerprint import ORACLE_OP1, op1_document_fingerprints
from lodewell.llm.langid import op10_language_id
from lodewell.llm.mixing import ORACLE_OP3, op3_source_mixing
from lodewell.llm.neardup import op8_minhash_near_dedup
from lodewell.llm.ngram_lm import op7_lm_scoring
from lodewell.llm.substring import op6_substring_dedup
from lodewell.llm.tokenstore import op4_token_store
from lodewell.llm.topk import ORACLE_OP2, op2_exact_top_k
from lodewell.llm.toxicity import op5_toxicity

QUERIES = {f.__name__: f for f in (op1_document_fingerprints, op2_exact_top_k, op3_source_mixing, op4_token_store, op5_toxicity, op6_substring_dedup, op7_lm_scoring, op8_minhash_near_dedup, op9_byte_level_bpe, op10_language_id)}
ORACLES: dict[str, str] = {"op1_document_fingerprints": ORACLE_OP1, "op2_exact_top_k": ORACLE_OP2, "op3_source_mixing": ORACLE_OP3}
