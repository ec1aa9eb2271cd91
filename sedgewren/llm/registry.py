"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from sedgewren.llm import q_decontamination, q_exact, q_lattice, q_lines, q_mixing, q_near, q_quality, q_scoring, q_sharding, q_suffixes, q_toxicity, q_turns, q_variants

_MODULES = (q_quality, q_scoring, q_suffixes, q_toxicity, q_near, q_decontamination, q_sharding, q_mixing, q_lines, q_exact, q_variants, q_lattice, q_turns)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
