"""K-hop tasks: pointers back to the last equal token, hops along them, targets, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.config import KhopsArgs
from graphloom.functions.vocab import Vocab


def back_pointers(sequences: DataFrame, right: bool = True) -> DataFrame:
    """(inst, i, token, ptr): the place beside the last equal token before i, to its right or left; null if there is none."""
    last = F.lag("i").over(Window.partitionBy("inst", "token").orderBy("i"))
    ptr = last + (1 if right else -1)
    return sequences.select("inst", "i", "token", F.when(ptr >= 0, ptr).cast("int").alias("ptr"))


def hops(sequences: DataFrame, k: int | Column, right: bool = True) -> DataFrame:
    """(inst, tokens, hops): each sequence as one row, and for each hop from the first to the k-th the token reached from
    every place, -1 where the way ends before."""
    k = F.lit(k) if isinstance(k, int) else k
    own = back_pointers(sequences.repartition("inst"), right)
    rows = own.groupBy("inst").agg(F.array_sort(F.collect_list(F.struct("i", "token", "ptr"))).alias("s")).select("inst", F.col("s.token").alias("tokens"), F.col("s.ptr").alias("ptrs"))
    step = lambda p: F.transform(p, lambda x: F.get("ptrs", x))
    walks = F.aggregate(F.sequence(F.lit(1), k), F.array("ptrs"), lambda w, i: F.when(i == 1, w).otherwise(F.concat(w, F.array(step(F.element_at(w, -1))))))
    return rows.select("inst", "tokens", F.transform(walks, lambda w: F.transform(w, lambda x: F.coalesce(F.get("tokens", x), F.lit(-1)))).alias("hops"))


def hop_table(hopped: DataFrame) -> DataFrame:
    """(inst, hop, i, value) for all hops that arrive."""
    each = hopped.select("inst", F.posexplode("hops").alias("h", "values")).select("inst", (F.col("h") + 1).alias("hop"), F.posexplode("values").alias("i", "value"))
    return each.filter("value >= 0")


def hop_targets(hopped: DataFrame, args: KhopsArgs, vocab_size: int) -> DataFrame:
    """(inst, i, labels): what each place has to predict: the last hop's token, or with intermediate labels all hops from
    the last back to the first until one repeats. Places without a last hop have none, nor have masked ones: all up to
    mask_to_size if that is above 0, else all but the last vocab_size if mask_to_vocab_size."""
    n = F.size("tokens")

    def labels(i: Column) -> Column:
        back = F.transform(F.reverse("hops"), lambda h: F.get(h, i))
        if not args.intermediate_labels:
            return F.slice(back, 1, 1)
        empty = F.struct(F.expr("cast(array() as array<int>)").alias("out"), F.lit(False).alias("done"))
        return F.aggregate(
            back, empty, lambda s, v: F.struct(F.when(s["done"] | F.array_contains(s["out"], v), s["out"]).otherwise(F.concat(s["out"], F.array(v))).alias("out"), (s["done"] | F.array_contains(s["out"], v)).alias("done")), lambda s: s["out"]
        )

    shown = F.lit(args.mask_to_size > 0) & (F.col("i") > args.mask_to_size)
    shown = shown | (F.lit(args.mask_to_vocab_size) & (F.col("i") >= F.col("n") - vocab_size)) | F.lit(args.mask_to_size < 0 and not args.mask_to_vocab_size)
    each = hopped.select("inst", n.alias("n"), F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), labels)).alias("i", "labels"))
    return each.filter((F.get("labels", F.lit(0)) >= 0) & shown).select("inst", "i", "labels")


def khops_tokens(hopped: DataFrame, targets: DataFrame, vocab: Vocab) -> DataFrame:
    """(inst, query, task, targets, difficulty): ``/ Dk ?`` and ``= sequence .``; places without a target have <pad>."""
    depths = F.array(*(F.lit(i) for i in vocab.depth_ids()))
    k = F.size("hops")
    mark = F.coalesce(F.get(depths, k), F.raise_error(F.lit("the vocabulary has no mark for k")).cast("int"))
    by_place = targets.groupBy("inst").agg(F.map_from_entries(F.collect_list(F.struct("i", "labels"))).alias("m"))
    rows = hopped.join(by_place, "inst", "left")
    told = F.transform("tokens", lambda t, i: F.coalesce(F.try_element_at("m", i), F.array(vocab.lit("<pad>"))))
    return rows.select(
        "inst", F.array(vocab.lit("/"), mark, vocab.lit("?")).alias("query"), F.concat(F.array(vocab.lit("=")), F.col("tokens"), F.array(vocab.lit("."))).alias("task"),
        F.concat(F.array(F.array(vocab.lit("="))), told, F.array(F.array(vocab.lit(".")))).alias("targets"), k.alias("difficulty"),
    )


def generated_tokens(segments: DataFrame, vocab: Vocab, multi_label: bool = False) -> DataFrame:
    """(inst, query, task, targets, difficulty) of segments(inst, seg, i, token, truth): all segments in a row, the last
    token behind ``/`` and closed by ``?``; then ``= truths .``, with ``multi_label`` each truth and all that follow."""
    own = segments.groupBy("inst").agg(F.array_sort(F.collect_list(F.struct("seg", "i", "token"))).alias("s"), F.array_sort(F.collect_set(F.struct("seg", "truth"))).alias("t"))
    rows = own.select("inst", F.col("s.token").alias("tokens"), F.col("t.truth").alias("truths"))
    n = F.size("tokens")
    query = F.concat(F.slice("tokens", F.lit(1), n - 1), F.array(vocab.lit("/"), F.element_at("tokens", -1), vocab.lit("?")))
    size = F.size("truths")
    labels = F.transform("truths", lambda t, i: F.slice("truths", i + 1, size) if multi_label else F.array(t))
    return rows.select(
        "inst", query.alias("query"), F.concat(F.array(vocab.lit("=")), "truths", F.array(vocab.lit("."))).alias("task"),
        F.concat(F.array(F.array(vocab.lit("="))), labels, F.array(F.array(vocab.lit(".")))).alias("targets"), size.alias("difficulty"),
    )
