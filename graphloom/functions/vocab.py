"""Symbols and positions as ids: the default vocabularies, own ones, and their tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The special symbols; a symbol's id is its place. The last is the stem of depth marks.
SPECIALS = ("<s>", "<pad>", "</s>", "<unk>", "|", "!", "=", ".", "t1", "t2", "t3", "t4", "t5", "/", "?", "@", "#", "[", "]", "{", "}", "$", "D")

#: Position ids, single ones and first and last of ranges.
POSITIONS = {
    "pad": 0, "query_invariance": 1, "edge_invariance": 2, "node_invariance": 3, "graph_invariance": 4, "scratchpad_invariance": 5, "task_invariance": 6,
    "misc_start": 11, "misc_end": 49, "query_start": 50, "query_end": 199, "graph_start": 200, "graph_end": 939, "graph_sub_start": 940, "graph_sub_end": 949,
    "thinking_start": 950, "thinking_end": 999, "task_start": 1000, "task_end": 5000,
}
#: What an own position vocabulary must have; thinking positions only if thinking tokens are asked for.
REQUIRED_POSITIONS = tuple(k for k in POSITIONS if not k.startswith("thinking"))


@dataclass(frozen=True)
class Vocab:
    """Symbols with ids. Node symbols are decimal numbers; their ids are the range from min_vocab to max_vocab - 1."""

    ids: dict[str, int]
    min_vocab: int
    max_vocab: int
    depth_symbol: str = "D"
    symbols: dict[int, str] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "symbols", {i: s for s, i in self.ids.items()})

    def __getitem__(self, symbol: str) -> int:
        return self.ids[symbol]

    def depth_ids(self) -> list[int]:
        """The ids of D0, D1, ... as far as they go."""
        out = []
        while (s := f"{self.depth_symbol}{len(out)}") in self.ids:
            out.append(self.ids[s])
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """(symbol, id, kind); kind is special, node or depth."""
        return spark.createDataFrame([(s, i, self.kind(s)) for s, i in sorted(self.ids.items(), key=lambda x: x[1])], "symbol string, id int, kind string")

    def kind(self, symbol: str) -> str:
        if symbol.isdigit():
            return "node"
        return "depth" if symbol[len(self.depth_symbol) :].isdigit() and symbol.startswith(self.depth_symbol) else "special"

    def lit(self, symbol: str) -> Column:
        return F.lit(self.ids[symbol]).cast("int")

    def symbol_of(self, column: Column) -> Column:
        """The symbol of an id column, by a literal map: vocabularies are configuration, not data."""
        pairs = [F.lit(x) for i, s in sorted(self.symbols.items()) for x in (i, s)]
        return F.element_at(F.create_map(*pairs), column)


def default_vocab(max_num_nodes: int = 50, extra_after: int = 0, depth_symbol: str = "D") -> Vocab:
    ids = {s: i for i, s in enumerate((*SPECIALS[:-1], depth_symbol))}
    low = len(ids)
    ids |= {str(i): low + i for i in range(max(0, max_num_nodes))}
    high = len(ids)
    ids |= {f"{depth_symbol}{i}": high + i for i in range(max(0, extra_after))}
    return Vocab(ids, low, high, depth_symbol)


def own_vocab(ids: dict[str, int], depth_symbol: str = "D") -> Vocab:
    """A vocabulary from a dictionary; numbers must have consecutive ids, and no id may occur twice."""
    if len(set(ids.values())) != len(ids):
        raise ValueError("ids occur twice")
    missing = [s for s in SPECIALS[:7] if s not in ids]
    if missing:
        raise ValueError(f"missing symbols: {missing}")
    nodes = sorted(i for s, i in ids.items() if s.isdigit())
    if nodes and nodes[-1] - nodes[0] + 1 != len(nodes):
        raise ValueError("the ids of nodes aren't consecutive")
    low = nodes[0] if nodes else len(ids)
    return Vocab(dict(ids), low, low + len(nodes), depth_symbol)


def own_positions(ids: dict[str, int]) -> dict[str, int]:
    for key in REQUIRED_POSITIONS:
        if key not in ids:
            raise ValueError(f"key {key} not found among positions")
    return dict(ids)
