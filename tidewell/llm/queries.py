"""The queries of this subpackage by name, and their SQL."""

from tidewell.llm.oracle import ORACLE
from tidewell.llm.op1_topk import op1_topk
from tidewell.llm.op2_bpe import op2_bpe
from tidewell.llm.op3_html import op3_html
from tidewell.llm.op4_pii import op4_pii
from tidewell.llm.op5_suffix import op5_suffix_dedup
from tidewell.llm.op6_toxicity import op6_toxicity
from tidewell.llm.op7_quality import op7_quality
from tidewell.llm.op8_mixing import op8_mix_sources
from tidewell.llm.op9_ann import op9_ann
from tidewell.llm.op10_minhash import op10_minhash_dedup
from tidewell.llm.op11_conversations import op11_conversations
from tidewell.llm.op12_fim import op12_fim
from tidewell.llm.op13_exact import op13_exact_dedup

QUERIES = {f.__name__: f for f in (op1_topk, op2_bpe, op3_html, op4_pii, op5_suffix_dedup, op6_toxicity, op7_quality, op8_mix_sources, op9_ann, op10_minhash_dedup, op11_conversations, op12_fim, op13_exact_dedup)}

__all__ = ["ORACLE", "QUERIES"]
