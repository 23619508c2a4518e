"""Scoring parameters, as one frozen object.  The values are fixed values."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class RewardConfig:
    lam: float = 0.004
    mu: float = 0.02
    abstain_value: float = 0.0
    abstain_penalty: float = 0.05
    no_commit_penalty: float = 0.45
    shaping_gamma: float = 1.0
    shaping_scale: float = 0.0008
    verify_fraction: float = 0.25
    coherence_scale: float = 0.5
    correctness_scale: float = 1.0
    contraindication_penalty: float = 4.0
    weight_1: float = 1.0
    weight_2: float = 1.8
    weight_3: float = 3.2
    weight_4: float = 6.0

    def hash(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def weight_sql(self, urgency: str = "urgency") -> str:
        return f"CASE {urgency} WHEN 1 THEN {self.weight_1}e0 WHEN 2 THEN {self.weight_2}e0 WHEN 3 THEN {self.weight_3}e0 ELSE {self.weight_4}e0 END"


DEFAULT = RewardConfig()
