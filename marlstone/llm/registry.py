"""Registered queries of the subpackage and their DuckDB equivalents."""

from __future__ import annotations

from .centroids import OP13_SQL, op13_geometric_drift
from .exact import OP9_SQL, op9_golomb_exchange
from .factorisation import op11_factorisation_machine
from .interaction import OP12_SQL, op12_radix_tries
from .licenses import OP10_SQL, op10_license_rules
from .lines import OP8_SQL, op8_line_winnowing
from .lm import op6_log_frequency_bloom
from .mixing import OP5_SQL, op5_weighted_fair_queue
from .near import OP4_SQL, op4_chosen_path
from .pieces import op1_sentencepiece
from .pii import op7_pii
from .quality import OP2_SQL, op2_quality_rules
from .sharding import OP3_SQL, op3_weighted_hash_tree

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_quality_rules": op2_quality_rules,
    "op3_weighted_hash_tree": op3_weighted_hash_tree,
    "op4_chosen_path": op4_chosen_path,
    "op5_weighted_fair_queue": op5_weighted_fair_queue,
    "op6_log_frequency_bloom": op6_log_frequency_bloom,
    "op7_pii": op7_pii,
    "op8_line_winnowing": op8_line_winnowing,
    "op9_golomb_exchange": op9_golomb_exchange,
    "op10_license_rules": op10_license_rules,
    "op11_factorisation_machine": op11_factorisation_machine,
    "op12_radix_tries": op12_radix_tries,
    "op13_geometric_drift": op13_geometric_drift,
}

ORACLES = {
    "op2_quality_rules": OP2_SQL,
    "op3_weighted_hash_tree": OP3_SQL,
    "op4_chosen_path": OP4_SQL,
    "op5_weighted_fair_queue": OP5_SQL,
    "op8_line_winnowing": OP8_SQL,
    "op9_golomb_exchange": OP9_SQL,
    "op10_license_rules": OP10_SQL,
    "op12_radix_tries": OP12_SQL,
    "op13_geometric_drift": OP13_SQL,
}
