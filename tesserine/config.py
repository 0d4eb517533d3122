"""Index configuration (S7): all keys are required when read back."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class LSHConfig:
    num_tables: int = 10
    hash_size: int = 12
    embedding_dim: int = 128
    random_seed: int = 42
    top_k: int = 10
    max_candidates: int = 5000
    cache_max_size: int = 1000
    cache_hamming_threshold: int = 8

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @classmethod
    def from_json(cls, text: str) -> LSHConfig:
        found = json.loads(text)
        if missing := [f.name for f in fields(cls) if f.name not in found]:
            raise KeyError(f"missing keys: {missing}")
        return cls(**{f.name: int(found[f.name]) for f in fields(cls)})


#: What the queries over the 64-dimensional test vectors use.
LOCAL = LSHConfig(num_tables=10, hash_size=8, embedding_dim=64)

# Weights of the fused score, and the mean Hamming distance above which it is 0.
WEIGHTS = {"cnn": 0.60, "hash": 0.20, "sift": 0.10, "orb": 0.05, "hist": 0.05}
HASH_LIMIT = 25

# The sweep, (tables, bits).
GRID = [(10, 12), (5, 12), (15, 12), (20, 12), (10, 8), (10, 10), (10, 14), (5, 8), (20, 14), (15, 10)]

# Linear latency model, in ms.
FIXED_MS, DEDUP, MS_PER_CANDIDATE = 10.0, 0.60, 0.05

# Labelled half-open ranges of bucket sizes; sizes equal to an upper bound fall in none but for the last range.
SIZE_BINS = [("1-10", 1, 10), ("11-50", 11, 50), ("51-100", 51, 100), ("101-250", 101, 250), ("251-500", 251, 500), ("501-1000", 501, 1000), ("1000+", 1001, None)]
