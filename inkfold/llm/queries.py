"""The queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .alignment import op12_alignment
from .decontaminate import OP1_SQL, op1_decontamination
from .divergence import OP11_SQL, op11_divergence
from .embeddings import op6_embeddings
from .html import op5_html
from .linededup import op7_line_dedup
from .lm import op4_lm
from .pii import op10_pii
from .pieces import op9_sentencepiece
from .quality import op2_quality
from .secrets import op13_secrets
from .simhash import op3_simhash
from .toxicity import op8_toxicity

QUERIES = {"op1_decontamination": op1_decontamination, "op2_quality": op2_quality, "op3_simhash": op3_simhash, "op4_lm": op4_lm, "op5_html": op5_html, "op6_embeddings": op6_embeddings, "op7_line_dedup": op7_line_dedup, "op8_toxicity": op8_toxicity, "op9_sentencepiece": op9_sentencepiece, "op10_pii": op10_pii, "op11_divergence": op11_divergence, "op12_alignment": op12_alignment, "op13_secrets": op13_secrets}

ORACLE_SQL = {"op1_decontamination": OP1_SQL, "op11_divergence": OP11_SQL}
