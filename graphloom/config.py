"""Parameters with their defaults, checked when they are made."""

from __future__ import annotations

import argparse
import dataclasses
from dataclasses import dataclass

GRAPH_TYPES = ("erdos_renyi", "euclidean", "random_tree", "path_star", "balanced", "khops", "khops_gen")
DIRECTED = ("path_star", "balanced", "khops", "khops_gen")


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class BatchArgs:
    batch_size: int = 256
    max_edges: int = 512
    max_attempts: int = 1000
    min_vocab: int = -1
    max_vocab: int = -1
    shuffle_edges: bool = False
    shuffle_nodes: bool = False

    def __post_init__(self) -> None:
        _check(self.batch_size > 0, "batch_size must be positive")
        _check(self.max_attempts > 0, "max_attempts must be positive")
        _check(self.max_vocab < 0 or self.min_vocab < self.max_vocab, "min_vocab must be below max_vocab")


@dataclass(frozen=True)
class PathArgs:
    max_path_length: int = 10
    min_path_length: int = 1
    task_sample_dist: tuple[float, ...] | None = None
    sample_choice_node: float = 0.9
    start_at_root: bool = True
    end_at_leaf: bool = True
    probs: tuple[float, ...] | None = None

    def __post_init__(self) -> None:
        _check(1 <= self.min_path_length <= self.max_path_length, "path lengths must be 1 <= min <= max")
        n = self.max_path_length - self.min_path_length + 1
        _check(self.task_sample_dist is None or len(self.task_sample_dist) == n, f"task_sample_dist needs {n} weights")

    def weights(self) -> tuple[float, ...]:
        return self.task_sample_dist or (1.0,) * (self.max_path_length - self.min_path_length + 1)


@dataclass(frozen=True)
class CenterArgs:
    max_query_size: int = -1
    min_query_size: int = 2
    given_query: tuple[int, ...] | None = None


@dataclass(frozen=True)
class KhopsArgs:
    max_khops: int = 5
    min_khops: int = 2
    max_prefix_length: int = 20
    min_prefix_length: int = 3
    right_side_connect: bool = True
    no_repeats: bool = True
    permutation_version: bool = False
    mask_to_vocab_size: bool = False
    mask_to_size: int = -1
    intermediate_labels: bool = False
    partition_method: str = "uniform"

    def __post_init__(self) -> None:
        _check(1 <= self.min_khops <= self.max_khops, "k must be 1 <= min <= max")
        _check(self.max_prefix_length >= 3 * self.max_khops, "max_prefix_length must be at least 3 * max_khops")
        _check(self.min_prefix_length <= self.max_prefix_length, "min_prefix_length is above max_prefix_length")
        _check(self.partition_method in ("uniform", "non_uniform"), "partition_method must be uniform or non_uniform")


@dataclass(frozen=True)
class BfsArgs:
    unique_depth_markers: bool = True
    stop_once_found: bool = True
    include_queue: bool = False
    reverse_adjacency: bool = False
    duplicate_adjacency: bool = False


@dataclass(frozen=True)
class TokenArgs:
    query_at_end: bool = True
    no_graph: bool = False
    concat_edges: bool = True
    duplicate_edges: bool = False
    include_nodes: bool = False
    num_thinking_tokens: int = 0
    scratchpad_as_prefix: bool = False
    is_flat_model: bool = True
    align_prefix_front_pad: bool = False

    def __post_init__(self) -> None:
        _check(self.is_flat_model, "only flat models have a layout")
        _check(self.num_thinking_tokens >= 0, "num_thinking_tokens must not be negative")


@dataclass(frozen=True)
class PosArgs:
    return_pos_ids: bool = True
    use_edges_invariance: bool = False
    use_node_invariance: bool = False
    use_graph_invariance: bool = False
    use_query_invariance: bool = False
    use_task_structure: bool = False
    use_graph_structure: bool = False
    use_full_structure: bool = False

    def size(self) -> int:
        """Numbers in a position: 1, one more with graph structure, one more with full structure."""
        return 1 + self.use_graph_structure + self.use_full_structure


_GROUPS = (BatchArgs, PathArgs, KhopsArgs, BfsArgs, TokenArgs, PosArgs)
#: Where the command line's defaults differ from those of a direct call.
COMMAND_LINE = {
    "min_num_nodes": 15, "max_num_nodes": 25, "shuffle_edges": True, "shuffle_nodes": True, "min_path_length": 3, "max_path_length": 12, "min_khops": 1, "max_khops": 7,
    "min_prefix_length": 70, "max_prefix_length": 100, "right_side_connect": False, "no_repeats": False, "unique_depth_markers": False, "query_at_end": False,
}


def args_parser() -> argparse.ArgumentParser:
    """A command-line parser with every parameter of every group."""
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--graph_type", choices=GRAPH_TYPES, default="erdos_renyi")
    parser.add_argument("--task_type", choices=("shortest_path", "bfs", "center", "centroid", "khops", "khops_gen", "none"), default="shortest_path")
    parser.add_argument("--scratchpad_type", choices=("none", "bfs", "dfs"), default="none")
    parser.add_argument("--seed", type=int, default=0)
    numbers = {"min_num_nodes": 15, "max_num_nodes": 25, "p": -1.0, "dim": 2, "radius": -1.0, "max_degree": 3, "max_depth": 7, "bernoulli_p": 0.5, "min_num_arms": 2, "max_num_arms": 5, "min_arm_length": 5, "max_arm_length": 10, "min_lookahead": 3, "max_lookahead": 5, "min_noise_reserve": 0, "max_num_parents": 4, "max_noise": -1, "c_min": 75, "c_max": 125}
    for name, value in numbers.items():
        parser.add_argument(f"--{name}", type=type(value), default=COMMAND_LINE.get(name, value))
    for group in _GROUPS:
        for f in dataclasses.fields(group):
            value = COMMAND_LINE.get(f.name, f.default)
            if isinstance(f.default, bool):
                parser.add_argument(f"--{f.name}", action=argparse.BooleanOptionalAction, default=value)
            elif f.default is None:
                parser.add_argument(f"--{f.name}", type=float, nargs="*", default=None)
            else:
                parser.add_argument(f"--{f.name}", type=type(f.default), default=value)
    return parser


def group_of(kind, values: dict):
    """One group's parameters out of a dictionary of many."""
    names = {f.name for f in dataclasses.fields(kind)}
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in names})
