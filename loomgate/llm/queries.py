"""The queries of this package by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .ann import op7_ann_hilbert
from .decontaminate import SQL as WINNOW_SQL
from .decontaminate import op13_decontamination_winnowing
from .embed_dedup import SQL as DEDUP_SQL
from .embed_dedup import op10_embedding_dedup
from .hard_negatives import SQL as NEGATIVES_SQL
from .hard_negatives import op11_hard_negatives_va_file
from .langid import op8_language_bigru
from .mixing import SQL as MIX_SQL
from .mixing import op1_mix_sources
from .packing import op9_packing_bm25
from .pii import op4_pii_boosted
from .quality import op2_quality_compression
from .simhash import op3_simhash_deletion
from .tokens import op5_token_counts
from .toxicity import op6_toxicity_noisy_or
from .whitening import op12_whitening_lobpcg

_ALL = (op1_mix_sources, op2_quality_compression, op3_simhash_deletion, op4_pii_boosted, op5_token_counts, op6_toxicity_noisy_or, op7_ann_hilbert, op8_language_bigru, op9_packing_bm25, op10_embedding_dedup, op11_hard_negatives_va_file, op12_whitening_lobpcg, op13_decontamination_winnowing)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op1_mix_sources": MIX_SQL, "op10_embedding_dedup": DEDUP_SQL, "op11_hard_negatives_va_file": NEGATIVES_SQL, "op13_decontamination_winnowing": WINNOW_SQL}
