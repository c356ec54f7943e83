"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .fill_in_middle import OP13_SQL, op13_fill_in_middle
from .language_id import op1_language_id
from .line_dedup import OP7_SQL, op7_line_dedup
from .minhash_dedup import op8_minhash_dedup
from .mixing import OP9_SQL, op9_mixing
from .repeated_passages import op6_repeated_passages
from .quality_rules import op2_quality_rules
from .sentencepiece_matching import op5_sentencepiece
from .sharding import op4_sharding, op4_sql
from .site_style_tree import op10_site_style_tree
from .substring_dedup import OP12_SQL, op12_substring_dedup
from .transport_stream import op3_transport_stream
from .whitening import op11_whitening

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_quality_rules": op2_quality_rules,
    "op3_transport_stream": op3_transport_stream,
    "op4_sharding": op4_sharding,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_repeated_passages": op6_repeated_passages,
    "op7_line_dedup": op7_line_dedup,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_mixing": op9_mixing,
    "op10_site_style_tree": op10_site_style_tree,
    "op11_whitening": op11_whitening,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_fill_in_middle": op13_fill_in_middle,
}


def oracles() -> dict[str, str]:
    return {"op4_sharding": op4_sql(), "op7_line_dedup": OP7_SQL, "op9_mixing": OP9_SQL, "op12_substring_dedup": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
