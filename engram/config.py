"""Settings of the engine: every constant of its operators in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class MemoryConfig:
    enable_triggers: bool = True
    enable_graph: bool = True
    enable_diffuse: bool = True
    enable_hebbian: bool = True
    enable_gate: bool = False
    # retrieval
    focused_top_k: int = 10
    focused_max_depth: int = 3
    diffuse_top_k: int = 5
    diffuse_temperature: float = 1.0
    novelty_penalty: float = 0.5
    bfs_min_weight: float = 0.25
    frontier_cap: int = 100
    sim_floor: float = 0.05
    path_bonus: float = 0.3
    diffuse_bonus: float = 0.02
    hop1_min_weight: float = 0.10
    hop2_min_weight: float = 0.15
    entry_nodes: int = 5
    trigger_bonus: float = 0.15
    trigger_margin: float = 0.05
    graph_factor: float = 0.3
    # triggers
    trigger_threshold: float = 0.15
    trigger_max_injections: int = 5
    keyword_weight: float = 0.4
    semantic_weight: float = 0.6
    confidence_floor: float = 0.1
    generic_share: float = 0.3
    score_gap: float = 0.5
    min_semantic_support: float = 0.03
    # graph build
    doc_threshold: float = 0.25
    doc_soft: float = 0.4
    doc_hard: float = 0.6
    sibling_min_weight: float = 0.15
    sibling_soft: float = 0.4
    cross_threshold: float = 0.10
    cross_soft: float = 0.5
    # learning
    strengthen_rate: float = 0.1
    decay_rate: float = 0.02
    useless_factor: float = 0.5
    new_edge_weight: float = 0.2
    promote_soft: int = 3
    promote_hard: int = 6
    promote_trigger: int = 10
    learned_keywords: int = 15
    learned_confidence: float = 0.7
    prune_floor: float = 0.05
    out_degree_cap: int = 20
    crystallise_count: int = 15
    crystallise_slowdown: float = 0.1
    usefulness_floor: float = 0.7
    min_fires: int = 3
    dead_confidence: float = 0.05
    tick_every: int = 10
    replay_factor: float = 0.5
    bridge_min_weight: float = 0.4
    bridge_mean_floor: float = 0.15
    bridge_damping: float = 0.5
    mining_min_episodes: int = 3
    mining_share: int = 5
    mining_keywords: int = 12
    mining_confidence: float = 0.5
    episode_retention: int = 10_000
    seed: int = 42

    def __post_init__(self) -> None:
        for name in ("strengthen_rate", "decay_rate", "trigger_threshold", "new_edge_weight", "learned_confidence", "mining_confidence"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be between 0 and 1")
        if self.diffuse_temperature <= 0:
            raise ValueError("diffuse_temperature must be positive")
        if not 0 < self.promote_soft <= self.promote_hard <= self.promote_trigger:
            raise ValueError("promotion counts must be positive and rise")
        if self.focused_top_k < 1 or min(self.focused_max_depth, self.diffuse_top_k, self.trigger_max_injections) < 0:
            raise ValueError("focused_top_k must be 1 at least; depth, walks and injections can't be negative")

    @property
    def variant(self) -> str:
        """A name for what is switched on."""
        if not self.enable_graph:
            return "flat" if not self.enable_triggers else "flat+triggers"
        parts = [n for n, on in (("triggers", self.enable_triggers), ("diffuse", self.enable_diffuse), ("hebbian", self.enable_hebbian)) if on]
        return "full" if len(parts) == 3 else "graph-only" if not parts else "graph+" + "+".join(parts)


def ablations(base: MemoryConfig = MemoryConfig()) -> dict[str, MemoryConfig]:
    """Six variants by name: one part after the other switched on."""
    off = replace(base, enable_triggers=False, enable_graph=False, enable_diffuse=False, enable_hebbian=False)
    graph = replace(off, enable_graph=True)
    made = [off, graph, replace(graph, enable_diffuse=True), replace(graph, enable_triggers=True), replace(graph, enable_triggers=True, enable_diffuse=True), replace(base, enable_triggers=True, enable_graph=True, enable_diffuse=True, enable_hebbian=True)]
    return {c.variant: c for c in made}
