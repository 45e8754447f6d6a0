"""Settings of an ablation: the keys of its YAML file that have an effect, and their defaults."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class AblationConfig:
    dataset: str = "dataset"
    seed: int = 42
    num_shards: tuple[int, ...] = (32,)
    shard_types: tuple[str, ...] = ("topic_based", "heterogeneous")
    top_b_values: tuple[int, ...] = (1, 3, 5, 10)
    centroid_k_values: tuple[int, ...] = (2, 4, 8)
    grouping: bool = False
    num_groups: tuple[int, ...] = ()
    num_selected_groups: tuple[int, ...] = ()
    document_recall_k_values: tuple[int, ...] = ()
    kmeans_iterations: int = 5
    multi_iterations: int = 3

    def fingerprint(self) -> str:
        """Names what decides the rows of one shard count and type, so that partial results of other settings are not
        taken for them."""
        decides = {k: v for k, v in asdict(self).items() if k not in ("num_shards", "shard_types")}
        return hashlib.md5(json.dumps(decides, sort_keys=True).encode()).hexdigest()[:12]


#: Accepted keys of each section; batch sizes tune the execution of other engines and change nothing here.
_SECTIONS = {
    "dataset": {"name", "raw_data_dir", "embedding_dir"},
    "output": {"result_dir", "filename_prefix"},
    "experiment": {"seed", "num_shards", "shard_types", "top_b_values", "centroid_k_values", "embedding_batch_size", "multi_centroid_batch_size", "grouping"},
    "metrics": {"document_recall_k_values", "document_recall_batch_size"},
}
_GROUPING = {"enabled", "num_groups", "num_selected_groups"}


def parse_config(raw: dict) -> AblationConfig:
    """A config from a parsed YAML file; sections and keys without an effect are errors."""
    unknown = [k for k in raw if k not in _SECTIONS] + [f"{s}.{k}" for s in _SECTIONS for k in raw.get(s) or {} if k not in _SECTIONS[s]]
    grouping = (raw.get("experiment") or {}).get("grouping") or {}
    unknown += [f"experiment.grouping.{k}" for k in grouping if k not in _GROUPING]
    if unknown:
        raise ValueError(f"keys without an effect: {unknown}")
    values = {"dataset": (raw.get("dataset") or {}).get("name", "dataset")}
    names = {f.name for f in fields(AblationConfig)}
    for source in (raw.get("experiment") or {}, raw.get("metrics") or {}, {k: v for k, v in grouping.items() if k != "enabled"}):
        values |= {k: tuple(v) if isinstance(v, list) else v for k, v in source.items() if k in names and k != "grouping"}
    return AblationConfig(**values, grouping=bool(grouping.get("enabled", False)))


def load_config(path: str) -> AblationConfig:
    import yaml

    with open(path, encoding="utf-8") as file:
        return parse_config(yaml.safe_load(file) or {})


def pilot_config() -> AblationConfig:
    """32 heterogeneous shards, no document metrics."""
    return AblationConfig(dataset="scifact", shard_types=("heterogeneous",), top_b_values=(1, 3, 5), grouping=True, num_groups=(4,), num_selected_groups=(1, 2, 3))
