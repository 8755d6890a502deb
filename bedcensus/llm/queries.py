"""The registered queries of this subpackage and their DuckDB texts."""

from __future__ import annotations

from .clustering import OP13_SQL, op13_centroid_clustering
from .decontaminate import OP7_SQL, op7_decontaminate
from .embedding_dedup import OP12_SQL, op12_embedding_near_dedup
from .html_extract import op9_html_extract
from .line_dedup import OP4_SQL, op4_line_dedup
from .near_dedup import op1_minhash_near_dedup
from .packing import op8_best_fit_packing
from .pii import op3_pii
from .quality import OP6_SQL, op6_quality_rules
from .sharding import op10_external_shuffle
from .toxicity import op2_toxicity
from .warc import OP5_SQL, op5_warc
from .whitening import op11_embedding_whitening


def queries():
    return {
        "op1_minhash_near_dedup": op1_minhash_near_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_pii": op3_pii,
        "op4_line_dedup": op4_line_dedup,
        "op5_warc": op5_warc,
        "op6_quality_rules": op6_quality_rules,
        "op7_decontaminate": op7_decontaminate,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_html_extract": op9_html_extract,
        "op10_external_shuffle": op10_external_shuffle,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_embedding_near_dedup": op12_embedding_near_dedup,
        "op13_centroid_clustering": op13_centroid_clustering,
    }


def oracle_sql():
    return {
        "op4_line_dedup": OP4_SQL,
        "op5_warc": OP5_SQL,
        "op6_quality_rules": OP6_SQL,
        "op7_decontaminate": OP7_SQL,
        "op12_embedding_near_dedup": OP12_SQL,
        "op13_centroid_clustering": OP13_SQL,
    }
