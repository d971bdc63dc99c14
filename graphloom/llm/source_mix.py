"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only.

Documents of a source are dealt into blocks of about equal size by a hash; a source's blocks are permuted. What a
source gives is its target in words: whole passes over its blocks, then a part of one more pass, that ends inside one
block, inside one document. The blocks so drawn are the source's exact quota. A binary tree over the output shards
splits the quotas of all sources: at each node, the left child gets an exact half of the node's blocks, as many of each
source as a multivariate-hypergeometric draw says (a chain of hypergeometric ones, source by source). A leaf takes the
next blocks, in permuted order, of each source as many as its quota says: blocks of different leaves are disjoint and
together they are the whole draw. Each leaf shuffles its documents locally.

Nodes are rows of counts, so the tree needs neither blocks nor sorting; only what the leaves take is looked up among the
blocks, by source and place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.quality_rules import words_of
from graphloom.llm.shared import materialize

#: Words of an output shard and of a block: about 200 and 25 MB of text.
SHARD_WORDS = 1 << 25
BLOCK_WORDS = 1 << 22
#: A small corpus has smaller blocks and shards, so many in all.
LEAST_BLOCKS = 1024
LEAST_SHARDS = 32
#: Partitions of the mix at most: beyond, each holds some shards, one after another.
PARTITIONS = 1 << 15


def _draw(*key) -> Column:
    """A uniform 32-bit integer from md5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *key)), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size, n_docs, target): sources by code point, null last, get ``weights`` in turn.

    Together they share ``share`` times all words; a target stops at ``cap`` times its source and the excess is shared
    again by weight. This is the level L at which the sum of min(cap * size, weight * L) is the whole: with sources by
    cap * size / weight, the first so many are at their cap, found by running sums. Sources are few, so one window.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * float(cap))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("free", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    per = per.withColumn("whole", share * F.sum("source_size").over(every))
    level = (F.col("whole") - F.col("capped")) / F.col("free")
    # the first source whose cap the level doesn't reach has the level of all that follow
    per = per.withColumn("level", F.when(F.col("weight") * level <= F.col("cap"), level))
    per = per.withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return per.select("source", "source_size", "n_docs", F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("level")), F.col("cap")).alias("target"))


#: How many of a source's x.quota blocks are among the s.want that go left out of s.rest: a hypergeometric draw by inversion.
#: Weights run over all values within 12 standard deviations and 20 more of the mean, from their ratios alone; what lies
#: outside is less than a double can tell. k stays behind the last value whose running sum isn't above the goal.
_HYPERGEOMETRIC = """
transform(array(s.want * x.quota / greatest(s.rest, 1)), mean ->
transform(array(12 * sqrt(mean * (1 - x.quota / greatest(s.rest, 1)) * (s.rest - s.want) / greatest(s.rest - 1, 1)) + 20), far ->
transform(array(sequence(greatest(0L, s.want + x.quota - s.rest, floor(mean - far)), least(s.want, x.quota, ceil(mean + far)))), ks ->
transform(array({u} * aggregate(ks, named_struct('w', 1D, 'sum', 0D), (t, k) -> named_struct('w', {next}, 'sum', t.sum + t.w), t -> t.sum)), goal ->
  least(aggregate(ks, named_struct('w', 1D, 'sum', 0D, 'k', ks[0]), (t, k) -> named_struct('w', {next}, 'sum', t.sum + t.w, 'k', if(t.sum + t.w <= goal, k + 1, t.k)), t -> t.k), s.want, x.quota)
)[0])[0])[0])[0]"""


def _half(seed: int) -> Column:
    """Of a node's blocks, held(slot, start, quota) by source, an exact half rounded down for the left child, in the same
    order."""
    u = f"(cast(conv(substring(md5(concat_ws(':', '{seed}:split', node, x.slot)), 1, 13), 16, 10) as bigint) / {1 << 52}D)"
    ratio = "t.w * ((x.quota - k) * (s.want - k)) / ((k + 1) * (s.rest - x.quota - s.want + k + 1))"
    return F.expr(f"""
        transform(array(aggregate(held, 0L, (s, x) -> s + x.quota)), n -> aggregate(
          held,
          named_struct('rest', n, 'want', n div 2, 'out', cast(array() as array<struct<slot:int,start:bigint,quota:bigint>>)),
          (s, x) -> transform(array({_HYPERGEOMETRIC.format(u=u, next=ratio)}), k -> named_struct(
            'rest', s.rest - x.quota, 'want', s.want - k, 'out', concat(s.out, array(named_struct('slot', x.slot, 'start', x.start, 'quota', k)))))[0],
          s -> s.out))[0]""")


#: A node's children: the half drawn, and the rest behind it; sources of which none is left are gone.
_CHILDREN = """
inline(transform(array(0, 1), side -> named_struct('node', node * 2 + side, 'held', filter(
  zip_with(held, half, (x, k) -> named_struct(
    'slot', x.slot, 'start', if(side = 0, x.start, x.start + k.quota), 'quota', if(side = 0, k.quota, x.quota - k.quota))),
  x -> x.quota > 0))))"""


def _split(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(slot, node, start, quota): how many blocks of each source (by slot) each of 2**levels leaves takes, and from which
    of its places on.

    A node is one row with the sources that it has blocks of. Rows are dealt anew by node once in six levels, so that a
    wide tree is grown by many tasks.
    """
    root = F.struct("slot", F.lit(0).cast("long").alias("start"), "quota")
    nodes = quotas.filter("quota > 0").agg(F.array_sort(F.collect_list(root)).alias("held")).select(F.lit(1).cast("long").alias("node"), "held")
    half, children = _half(seed).alias("half"), F.expr(_CHILDREN)
    for level in range(levels):
        nodes = nodes.select("node", "held", half).select(children)
        if level % 6 == 5:
            nodes = nodes.repartition("node")
    return nodes.select((F.col("node") - (1 << levels)).alias("node"), F.inline("held")).select("slot", "node", "start", "quota")


def _sized(docs: DataFrame, source: str) -> DataFrame:
    """doc_id, source, size, _key, and every column of docs in _doc, where no name can clash. _key tells rows apart: the
    doc_id, or where there is none a hash of the text."""
    text = F.col("text").cast("string")
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.md5(F.coalesce(text, F.lit("")))))
    return docs.select("doc_id", F.col(source).alias("source"), F.size(words_of(text)).cast("long").alias("size"), key.alias("_key"), F.struct("*").alias("_doc"))


class _Plan:
    """The draw as tables: sizes (a row for each row of docs), targets, and blocks with the leaf that each was drawn for."""

    def __init__(self, docs: DataFrame, source: str, share: float, cap: float, weights: tuple[int, ...], seed: int, shard_words: int, block_words: int, least_shards: int, least_blocks: int):
        if not 0 < share <= cap <= 2:
            raise ValueError("share must be in (0, cap] and cap in (0, 2]")
        self.seed = seed
        self.sizes = materialize(_sized(docs, source).drop("_doc"), "sizes")
        total = self.sizes.agg(F.sum("size")).first()[0] or 0
        self.block_words = max(1, min(block_words, total // least_blocks))
        shard_words = max(1, min(shard_words, -(-int(share * total) // least_shards)))
        self.levels = (max(0, int(share * total) - 1) // shard_words).bit_length()
        targets = source_targets(self.sizes, share, cap, weights)
        slot = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("int")
        n = F.greatest(F.lit(1), F.least(F.col("n_docs"), F.round(F.col("source_size") / self.block_words).cast("long")))
        self.targets = materialize(targets.withColumn("slot", slot).withColumn("n_blocks", n.cast("long")), "targets")
        self.dealt = self.deal(self.sizes)
        self.blocks = materialize(self._leaf_blocks(materialize(self._draw_blocks(), "blocks")), "leaf-blocks")

    def deal(self, sized: DataFrame) -> DataFrame:
        """Rows with _key, source and size, given target, slot and block."""
        targets = self.targets.select(F.col("source").alias("_source"), "slot", "n_blocks", "source_size", "target")
        out = sized.join(_small(targets), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        return out.withColumn("block", _draw(F.lit(f"{self.seed}:block"), F.col("_key")) % F.col("n_blocks"))

    def _draw_blocks(self) -> DataFrame:
        """(slot, pass, block, words, take, place): a row for each drawn block of each pass; take < words where the
        draw ends, place counts the source's drawn blocks from 0.

        Running sums go by 256 ranges of the permutation's draws, then inside each range, so that no source's blocks
        meet in one task.
        """
        words = materialize(self.dealt.groupBy("slot", "block").agg(F.sum("size").alias("words")).filter("words > 0"), "block-words")
        each = words.withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1))))
        each = each.withColumn("draw", _draw(F.lit(f"{self.seed}:permute"), "pass", "slot", "block")).withColumn("range", F.shiftright("draw", 24))
        order = Window.partitionBy("slot", "pass").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        base = each.groupBy("slot", "pass", "range").agg(F.sum("words").alias("w"), F.count("*").alias("n"))
        zero = F.lit(0).cast("long")
        base = base.select("slot", "pass", "range", F.coalesce(F.sum("w").over(order), zero).alias("w"), F.coalesce(F.sum("n").over(order), zero).alias("n"), F.sum("n").over(Window.partitionBy("slot", "pass")).alias("all"))
        known = self.targets.select("slot", "source_size", F.round("target").cast("long").alias("due"))
        each = each.join(base, ["slot", "pass", "range"]).join(_small(known), "slot")
        inside = Window.partitionBy("slot", "pass", "range").orderBy("draw", "block")
        before = F.col("w") + F.coalesce(F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, -1)), zero)
        due = F.greatest(zero, F.least("source_size", F.col("due") - F.col("pass") * F.col("source_size")))
        # pass 1 begins when pass 0 is whole, so behind all of its blocks
        place = F.col("pass") * F.col("all") + F.col("n") + F.row_number().over(inside) - 1
        each = each.select("slot", "pass", "block", "words", F.greatest(zero, F.least(F.col("words"), due - before)).alias("take"), place.cast("long").alias("place"))
        return each.filter("take > 0")

    def _leaf_blocks(self, blocks: DataFrame) -> DataFrame:
        """The blocks that the tree's leaves take, each with its shard (leaf)."""
        leaves = _split(blocks.groupBy("slot").agg(F.count("*").alias("quota")), self.levels, self.seed)
        at = leaves.select("slot", F.col("node").alias("shard"), F.explode(F.sequence(F.col("start"), F.col("start") + F.col("quota") - 1)).alias("place"))
        return blocks.join(at, ["slot", "place"]).drop("place")

    def cut(self, rows: DataFrame, words: str, take: str, size: str, place: list) -> DataFrame:
        """rows with ``taken``: the whole size, but in the one block where a source's draw ends the first documents, in
        a drawn order, until the take is reached; the last of them is taken for its first words."""
        within = (F.col(take) > 0) & (F.col(take) < F.col(words))
        full = rows.filter(~within).withColumn("taken", F.when(F.col(take) > 0, F.col(size)).otherwise(F.lit(0)).cast("long"))
        order = Window.partitionBy(*place).orderBy(_draw(F.lit(f"{self.seed}:cut"), F.col("_key")), "_key", size)
        before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        part = rows.filter(within).withColumn("taken", F.greatest(F.lit(0), F.least(size, F.col(take) - before)).cast("long"))
        return full.unionByName(part)


#: Up to so many rows a table of sources or blocks is broadcast, at some 50 bytes each; beyond, it is joined by shuffle.
FEW_ROWS = 1 << 18


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(FEW_ROWS + 1).count() <= FEW_ROWS else table


def mixed_sizes(
    docs: DataFrame, source: str = "source", share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), seed: int = 7,
    shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, least_shards: int = LEAST_SHARDS, least_blocks: int = LEAST_BLOCKS,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, shards) for each row of ``docs``: the words that the leaves of
    :func:`mix_sources` take of it, repeats counted, and these leaves.

    Words are `[^\x20\x09-\x0D]+`. A null text has size 0 and nothing is taken; a null source is a source of its own,
    last in order; rows with one doc_id (without one, with one text) are dealt together and may be cut between them, and
    of equal rows any; an empty table gives no rows; a very long text is a block of its own size and may be cut where its
    source's draw ends. Other columns are ignored, whatever their names. The table of sources has one row each and is
    ordered in one task.
    """
    plan = _Plan(docs, source, share, cap, weights, seed, shard_words, block_words, least_shards, least_blocks)
    takes = plan.blocks.groupBy("slot", "block").agg(
        F.first("words").alias("words"),
        *(F.sum(F.when(F.col("pass") == p, F.col("take")).otherwise(0)).alias(f"take{p}") for p in (0, 1)),
        F.array_sort(F.collect_list("shard")).alias("shards"),
    )
    rows = plan.dealt.join(_small(takes), ["slot", "block"], "left").fillna(0, ["words", "take0", "take1"])
    # only one pass of a source ends early: pass 1 begins when pass 0 is whole
    rows = rows.withColumn("late", F.when(F.col("take0") < F.col("words"), F.col("take0")).otherwise(F.col("take1")))
    rows = plan.cut(rows, "words", "late", "size", ["slot", "block"])
    whole = (F.col("words") > 0) & (F.col("take0") >= F.col("words"))
    taken = F.col("taken") + F.when(whole & (F.col("size") > 0), F.col("size")).otherwise(0)
    return rows.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), taken.cast("long").alias("taken"), F.when(taken > 0, F.col("shards")).alias("shards"))


def mix_sources(
    docs: DataFrame, source: str = "source", share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), seed: int = 7,
    shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, least_shards: int = LEAST_SHARDS, least_blocks: int = LEAST_BLOCKS,
) -> DataFrame:
    """The mix itself: the columns of ``docs`` and shard, pass (0 or 1) and taken, a row for each document and pass in
    which words of it are taken; a new column whose name is taken gets ``mix_`` before it until it is free.

    The text of the one document where a source's draw ends is cut behind its last taken word. Rows are partitioned by
    shard, in each shard in a drawn order. Cases as in :func:`mixed_sizes`.
    """
    plan = _Plan(docs, source, share, cap, weights, seed, shard_words, block_words, least_shards, least_blocks)
    rows = plan.deal(_sized(docs, source)).join(_small(plan.blocks), ["slot", "block"])
    rows = plan.cut(rows, "words", "take", "size", ["slot", "pass", "block"]).filter("taken > 0")
    rows = rows.select("doc_id", "_key", "_doc", "size", "taken", "pass", "shard")
    shift = max(0, plan.levels - (PARTITIONS.bit_length() - 1))
    rows = rows.repartitionById(1 << (plan.levels - shift), F.shiftright("shard", shift).cast("int")).sortWithinPartitions("shard", F.xxhash64(F.lit(seed), "_key", "pass"))
    # a document cut short keeps its first words and the space between them
    token = F.regexp_extract_all(F.col("_doc.text").cast("string"), F.lit(r"[ \t-\r]*[^ \t-\r]+"), F.lit(0))
    short = F.col("taken") < F.col("size")
    first = F.array_join(F.slice(token, F.lit(1), F.col("taken").cast("int")), "")
    new = {"text": F.when(short, first).otherwise(F.col("_doc.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(short, F.char_length(first)).otherwise(F.col("_doc.n_chars")).cast(docs.schema["n_chars"].dataType)
    own = [(new[c] if c in new else F.col("_doc").getField(c)).alias(c) for c in docs.columns]
    names = [c.lower() for c in docs.columns]
    for c in ("shard", "pass", "taken"):
        name = c
        while name in names:
            name = f"mix_{name}"
        names.append(name)
        own.append(F.col(c).alias(name))
    return rows.select(*own)
