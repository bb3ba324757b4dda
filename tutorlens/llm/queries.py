"""The queries of this package and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from . import jump_shards, licence_sentences, merkle_manifest, pareto_mixing, phrase_mining
from .chosen_path_join import op2_ngram_jaccard_join
from .complement_packing import op3_best_fit_packing
from .entropy_secrets import op4_secret_scan
from .hilbert_neighbours import op5_hilbert_neighbours
from .jump_shards import op11_jump_sharding
from .licence_sentences import op9_licence_scan
from .line_templates import op8_line_dedup
from .merkle_manifest import op12_merkle_manifest
from .neighbour_toxicity import op6_toxicity_neighbours
from .pareto_mixing import op7_source_mixing
from .phrase_mining import op13_phrase_collocations
from .quality_rules_ensemble import op1_quality_classifier
from .risk_controlled_rules import op10_quality_rules

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_ngram_jaccard_join, op3_best_fit_packing, op4_secret_scan, op5_hilbert_neighbours,
        op6_toxicity_neighbours, op7_source_mixing, op8_line_dedup, op9_licence_scan, op10_quality_rules, op11_jump_sharding,
        op12_merkle_manifest, op13_phrase_collocations,
    )
}
ORACLES = {
    "op7_source_mixing": pareto_mixing.ORACLE, "op9_licence_scan": licence_sentences.ORACLE, "op11_jump_sharding": jump_shards.ORACLE, "op12_merkle_manifest": merkle_manifest.ORACLE,
    "op13_phrase_collocations": phrase_mining.ORACLE,
}
