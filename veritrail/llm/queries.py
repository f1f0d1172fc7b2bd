"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .gated_lm import op6
from .near_dedup import op5
from .oracles import OP5, OP7, RULE_ABLATIONS
from .packing import op2
from .periodic_runs import op11
from .phrases import OP13_SQL, op13
from .quality_classifier import op4
from .quality_rules import op7, rule_ablations
from .secrets import op8
from .segmentation import op9
from .sharding import op3
from .simhash import op12
from .topk import OP1_SQL, op1
from .toxicity import op10

QUERIES = {"op1_exact_top_k": op1, "op2_best_fit_packing": op2, "op3_sharding": op3, "op4_quality_classifier": op4, "op5_near_dedup": op5, "op6_lm_scoring": op6, "op7_quality_rules": op7, "op8_secret_scans": op8, "op9_sentencepiece": op9, "op10_toxicity": op10, "op11_periodic_runs": op11, "op12_simhash_near_dedup": op12, "op13_phrase_collocations": op13, "rule_ablations": rule_ablations}
ORACLES: dict[str, str] = {"op1_exact_top_k": OP1_SQL, "op5_near_dedup": OP5, "op7_quality_rules": OP7, "op13_phrase_collocations": OP13_SQL, "rule_ablations": RULE_ABLATIONS}
