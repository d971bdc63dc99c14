"""The library in one place, under short names: generators, state, verifiers, gathers.

State that a training script sets once (seed, vocabularies, held-out hashes) lives in a Session; everything else takes
and returns DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from graphloom import config
from graphloom.functions import partitions, vocab
from graphloom.functions.draws import host_between
from graphloom.operators import distances, layout, measures, splits, verify
from graphloom.plans import dataset
from graphloom.sources import registry, shaped_graphs

get_args_parser = config.args_parser
uniform_random_int_partition = partitions.uniform_partition
non_uniform_random_int_partition = partitions.quick_partition
set_int_partition_cache_size = partitions.set_cache_size
balanced_graph_size_check = shaped_graphs.balanced_fits
is_directed = registry.is_directed
task_gather_ids, scratchpad_gather_ids = layout.task_ids, layout.scratchpad_ids
edge_gather_ids, node_gather_ids, query_gather_ids = layout.edge_ids, layout.node_ids, layout.query_ids
create_reconstruct_graphs = layout.reconstructed
pprint_batch = layout.pretty
pprint_distance, pprint_ranks = measures.pretty_distances, measures.pretty_ranks
batch_check = measures.usable
all_pairs_distances = distances.distances


class Session:
    """Seed, vocabularies and held-out hashes, and the generators under them."""

    def __init__(self, spark: SparkSession, seed: int = 0):
        self.spark = spark
        self._seed = seed
        self._draws = 0
        self._first = 0
        self._vocab = vocab.default_vocab()
        self._positions = dict(vocab.POSITIONS)
        self._hashes: dict[str, DataFrame] = {}

    # seed
    def set_seed(self, seed: int) -> None:
        self._seed, self._draws, self._first = seed, 0, 0

    def get_seed(self) -> int:
        return self._seed

    def rand_int(self, low: int, high: int) -> int:
        """The next draw from low to high, both included."""
        self._draws += 1
        return host_between(low, high, self._seed, "int", self._draws)

    # vocabularies
    def set_dictionary(self, ids: dict[str, int], depth_symbol: str = "D") -> None:
        self._vocab = vocab.own_vocab(ids, depth_symbol)

    def set_default_dictionary(self, max_num_nodes: int = 50, extra_after: int = 0, extra_after_symbol: str = "D") -> None:
        self._vocab = vocab.default_vocab(max_num_nodes, extra_after, extra_after_symbol)

    def get_dictionary(self) -> dict[str, int]:
        return dict(self._vocab.ids)

    def get_dictionary_vocab_limits(self) -> tuple[int, int]:
        return self._vocab.min_vocab, self._vocab.max_vocab

    def set_pos_dictionary(self, ids: dict[str, int]) -> None:
        self._positions = vocab.own_positions(ids)

    def set_default_pos_dictionary(self) -> None:
        self._positions = dict(vocab.POSITIONS)

    def get_pos_dictionary(self) -> dict[str, int]:
        return dict(self._positions)

    # held-out sets
    def _set(self, split: str, hashes: DataFrame | Iterable[str]) -> None:
        new = hashes.select("hash") if isinstance(hashes, DataFrame) else self.spark.createDataFrame([(h,) for h in hashes], "hash string")
        old = self._hashes.get(split)
        self._hashes[split] = (new if old is None else old.unionByName(new)).distinct()

    def set_validation_hashes(self, hashes) -> None:
        self._set("valid", hashes)

    def set_test_hashes(self, hashes) -> None:
        self._set("test", hashes)

    def split_hashes(self) -> DataFrame:
        from pyspark.sql import functions as F

        out = self.spark.createDataFrame([], "split string, hash string")
        for split, own in self._hashes.items():
            out = out.unionByName(own.select(F.lit(split).alias("split"), "hash"))
        return out

    def get_validation_size(self) -> int:
        return self._hashes["valid"].count() if "valid" in self._hashes else 0

    def get_test_size(self) -> int:
        return self._hashes["test"].count() if "test" in self._hashes else 0

    def is_invalid_example(self, hashes: DataFrame) -> DataFrame:
        """hashes with in_validation, in_test and is_invalid."""
        return splits.marked(hashes, self.split_hashes())

    is_in_validation = is_in_test = is_invalid_example

    # generators
    def generate(self, graph_type: str, task_type: str = "shortest_path", scratchpad_type: str = "none", **options) -> dataset.Dataset:
        """The next batch: instance numbers go on from call to call, so batches never repeat under one seed."""
        out = dataset.build(self.spark, graph_type, task_type, scratchpad_type, seed=self._seed, first=self._first, **{"vocab": self._vocab, "positions": self._positions, **options})
        self._first += options.get("batch_size", 256)
        return out

    def erdos_renyi_n(self, **options) -> dataset.Dataset:
        return self.generate("erdos_renyi", **options)

    def euclidean_n(self, **options) -> dataset.Dataset:
        return self.generate("euclidean", **options)

    def random_tree_n(self, **options) -> dataset.Dataset:
        return self.generate("random_tree", **options)

    def path_star_n(self, **options) -> dataset.Dataset:
        return self.generate("path_star", **options)

    def balanced_n(self, **options) -> dataset.Dataset:
        return self.generate("balanced", **options)

    def khops_n(self, **options) -> dataset.Dataset:
        return self.generate("khops", **options)

    def khops_gen_n(self, **options) -> dataset.Dataset:
        return self.generate("khops_gen", **options)

    def get_graph(self, args) -> dataset.Dataset:
        """A batch from parsed command-line arguments."""
        given = dict(vars(args) if not isinstance(args, dict) else args)
        kinds = {k: given.pop(k) for k in ("graph_type", "task_type", "scratchpad_type") if k in given}
        given.pop("seed", None)
        return self.generate(**kinds, **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})

    # single graphs
    def single(self, graph_type: str, **options) -> dataset.Dataset:
        return self.generate(graph_type, **{**options, "batch_size": 1})

    # verifiers
    def verify_paths(self, predictions: DataFrame, dist: DataFrame, compat: bool = False) -> DataFrame:
        return verify.verify_paths(predictions, dist, len(self._vocab.ids), compat)

    def verify_path(self, predictions: DataFrame, dist: DataFrame) -> DataFrame:
        return verify.verify_path(predictions, dist, len(self._vocab.ids))

    def verify_bfs_gens(self, predictions: DataFrame, dist: DataFrame, include_queue: bool = False, duplicate_adjacency: bool = False) -> DataFrame:
        return verify.verify_bfs(predictions, dist, self._vocab, len(self._vocab.ids), include_queue, duplicate_adjacency)

    verify_bfs_gen = verify_bfs_gens

    @staticmethod
    def verify_khop_gens(predictions: DataFrame, right_side_connect: bool = True, first: int = 1) -> DataFrame:
        return verify.verify_khops(predictions, right_side_connect, first)
