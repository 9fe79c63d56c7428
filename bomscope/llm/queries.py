"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .embedding_dedup import OP1_SQL, op1_embedding_dedup
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .line_dedup import op9_line_dedup
from .masked_lm import op2_masked_lm
from .packing import op4_packing
from .pii import op5_pii
from .shards import op3_shards
from .toxicity import op8_toxicity
from .tree_bpe import op7_tree_bpe
from .trie_join import op10_trie_join


def queries() -> dict:
    return {"op1_embedding_dedup": op1_embedding_dedup, "op2_masked_lm": op2_masked_lm, "op3_shards": op3_shards, "op4_packing": op4_packing, "op5_pii": op5_pii, "op6_exact_dedup": op6_exact_dedup, "op7_tree_bpe": op7_tree_bpe, "op8_toxicity": op8_toxicity, "op9_line_dedup": op9_line_dedup, "op10_trie_join": op10_trie_join}


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": OP1_SQL, "op6_exact_dedup": OP6_SQL}
