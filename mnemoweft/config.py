"""Parameters of the operators, with the defaults that the dataflows use."""

from __future__ import annotations

from dataclasses import dataclass


# Default thresholds, weights and limits.
@dataclass(frozen=True)
class Settings:
    boundary_similarity: float = 0.35
    transition_margin: float = 0.15
    min_segment_turns: int = 3
    label_match: float = 0.65
    similarity_weights: tuple[float, float, float, float] = (0.35, 0.25, 0.20, 0.20)
    cluster_distances: tuple[float, ...] = (0.7, 0.5, 0.3)
    multi_parent: float = 0.55
    multi_parent_candidates: int = 50
    summary_interval: int = 5
    drift: float = 0.3
    sibling_merge: float = 0.85
    sibling_merge_memories: int = 10
    npmi: float = 0.1
    min_cooccurrence: int = 1
    soft_membership: float = 0.5
    causal_low: float = 0.3
    causal_high: float = 0.6
    causal_candidates: int = 30
    edge_weights: tuple[float, float, float] = (0.4, 0.4, 0.2)
    direction_epsilon: float = 0.05
    prune_weight: float = 0.08
    max_out_degree: int = 5
    half_life_days: float = 30.0
    learning_rate: float = 0.2
    weight_max: float = 1.0
    damping: float = 0.85
    ppr_iterations: int = 20
    ppr_epsilon: float = 1e-6
    ppr_top_k: int = 5
    max_routed: int = 7
    min_routed: int = 3
    intra_top_k: int = 10
    scoring_topics: int = 5
    cross_discount: float = 0.7
    global_weight: float = 0.8
    evidence_similarity: float = 0.6
    low_score: float = 0.35
    rebuild_interval: int = 50
    mmr_lambda: float = 0.7
    mmr_topic_weight: float = 0.7


DEFAULTS = Settings()
