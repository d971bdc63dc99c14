"""Quality rules over whole texts and over lines that recur across the documents of a host. DataFrame functions only.

Words are `[^\\x20\\x09-\\x0D]+`. Rules on one text (counts of words, symbols, repeated lines and repeated 5-word
windows) need no shuffle. The cross-document rule hashes every normalised line (lower case, white space as one space),
counts the distinct documents of each (host, line), and drops the lines that are above the limit of their host; a
document that loses too large a part of its words is rejected.

Documents are told apart by their whole normalised text: equal copies are one document, and any two texts that differ
are two. A text that somebody has copied a thousand times would else lose every line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import materialize

_SPACE = r"[ \t-\r]+"
WINDOW = 5


def words_of(text: Column) -> Column:
    """The words of a text; none for a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 5-word window which occurs at least twice, each word once.

    Windows are compared by a 64-bit hash, made of those of word pairs and of pairs of pairs. Texts without a repeated
    window, nearly all, stop at a set of hashes; for others the repeated places are found by sorting (hash, place) and
    looking at neighbours.
    """
    n = F.size(words)

    def windows(hashes: Column) -> Column:
        every = F.size(hashes)
        joined = lambda x, y, by: F.zip_with(x, F.slice(y, by + 1, every), lambda a, b: F.xxhash64(a, b))
        four = lambda pairs: joined(joined(pairs, pairs, 2), hashes, 4)
        # what is paired with nothing stands at the end
        return F.slice(_bind(joined(hashes, hashes, 1), four), F.lit(1), every - WINDOW + 1)

    def repeated(w: Column) -> Column:
        order = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(o: Column) -> Column:
            same = F.transform(
                o,
                lambda x, i: F.when((x["h"] == F.get(o, i - 1)["h"]) | (x["h"] == F.get(o, i + 1)["h"]), x["i"]),
            )
            return F.array_sort(F.filter(same, lambda x: x.isNotNull()))

        # each place adds the words that the place before it doesn't cover
        fresh = lambda at: F.aggregate(
            at,
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("p")),
            lambda s, x: F.struct((s["n"] + F.least(F.lit(WINDOW), x - s["p"])).alias("n"), x.alias("p")),
            lambda s: s["n"],
        )
        return _bind(_bind(order, places), fresh)

    count = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(repeated(w))
    return F.when(n <= WINDOW, 0).otherwise(_bind(_bind(F.transform(words, lambda w: F.xxhash64(w)), windows), count)).cast("long")


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, though named often."""
    return F.get(F.transform(F.array(value), use), 0)


def text_rules(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and the arrays _lines
    (hash and words of every line that has a word) and _copy (a hash of the normalised text; null without words)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn("_words", words_of(text)).withColumn("_raw", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]")))
    normal = F.filter(F.transform(F.split(_normal(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.char_length(F.regexp_replace(text, _SPACE, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": (F.size("_raw") - F.size(F.array_distinct("_raw"))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("_words")),
        "_lines": F.transform(normal, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).cast("long").alias("n"))),
        "_copy": F.when(F.size("_words") > 0, F.xxhash64(F.lower(F.array_join("_words", " ")))),
    })
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.drop("_words", "_raw").withColumn("base_failed", failed)


def _normal(text: Column) -> Column:
    """Lower case, and white space within a line as one space."""
    return F.lower(F.regexp_replace(text, r"[ \t\x0B\f\r]+", " "))


def frequent_lines(rules: DataFrame, host: str, max_documents: int, max_share: float) -> DataFrame:
    """(_host, h): the hashes of each host's lines above the limits.

    A host has at most (mean lines of its documents / max_share) of them, whatever its size. Counting distinct documents
    takes two steps, by (host, line, document) and by (host, line), both with partial sums before the shuffle: neither a
    host nor a line is one task's work.
    """
    lines = rules.select(F.col(host).alias("_host"), "_copy", F.explode(F.transform("_lines", lambda x: x["h"])).alias("h"))
    counts = lines.groupBy("_host", "h").agg(F.count_distinct("_copy").alias("c")).filter(F.col("c") > max_documents)
    whole = rules.groupBy(F.col(host).alias("_of")).agg(F.count_distinct("_copy").alias("of"))
    return counts.join(whole, F.col("_host").eqNullSafe(F.col("_of"))).filter(F.col("c") > max_share * F.col("of")).select("_host", "h")


#: Up to so many (host, line) entries are broadcast, 8 bytes each; beyond, lines are joined by (host, line).
FEW_LINES = 1 << 20


class _Frequent:
    """The hosts' dropped lines, and what each row of ``rules`` has of them."""

    def __init__(self, rules: DataFrame, lines: DataFrame):
        self.lines = lines
        self.by_host = None
        if lines.limit(FEW_LINES + 1).count() <= FEW_LINES:
            self.by_host = lines.groupBy("_host").agg(F.collect_list("h").alias("_frequent"))
            self.hits = self._near(rules, F.col("_lines.h"))
        else:
            each = rules.select("_n", F.col("_of"), F.explode(F.array_distinct("_lines.h")).alias("h"))
            met = each.join(lines.withColumnRenamed("h", "_h"), (F.col("h") == F.col("_h")) & F.col("_of").eqNullSafe(F.col("_host")))
            self.hits = rules.join(met.groupBy("_n").agg(F.collect_list("h").alias("_hits")), "_n", "left")

    def _near(self, rows: DataFrame, hashes: Column) -> DataFrame:
        met = rows.join(F.broadcast(self.by_host), F.col("_of").eqNullSafe(F.col("_host")), "left").drop("_host")
        return met.withColumn("_hits", F.when(F.col("_frequent").isNotNull(), F.array_intersect(hashes, "_frequent"))).drop("_frequent")

    def of_texts(self, rows: DataFrame) -> DataFrame:
        """``rows`` with text, _of, _id and _row, and _hits: the lines to drop. Few entries come by broadcast, else rows are
        joined by their key, which spreads a host."""
        if self.by_host is not None:
            return self._near(rows, F.transform(F.split("text", "\n"), lambda x: F.xxhash64(F.trim(_normal(x)))))
        own = self.hits.filter(F.size("_hits") > 0).groupBy(F.col("_id").alias("_i"), F.col("_row").alias("_r")).agg(F.first("_hits").alias("_hits"))
        return rows.join(own, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_row") == F.col("_r")), "left").drop("_i", "_r")


def _checked(docs: DataFrame, host: str, max_documents: int, max_share: float, max_lost: float) -> tuple[DataFrame, _Frequent]:
    text = F.col("text").cast("string")
    thin = docs.select("doc_id", F.col("doc_id").cast("string").alias("_id"), F.col(host).alias("_of"), text.alias("text"), F.xxhash64(text).alias("_row"))
    rules = materialize(text_rules(thin).drop("text").withColumn("_n", F.monotonically_increasing_id()), "quality")
    frequent = _Frequent(rules, materialize(frequent_lines(rules, "_of", max_documents, max_share), "frequent-lines"))
    lost = F.aggregate(F.filter("_lines", lambda x: F.array_contains("_hits", x["h"])), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    out = frequent.hits.withColumn("lost_words", F.when(F.size("_hits") > 0, lost).otherwise(F.lit(0).cast("long")))
    left = F.col("n_words") - F.col("lost_words")
    depleted = (F.col("lost_words") > max_lost * F.col("n_words")) | ((F.col("lost_words") > left) & (left < 10))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted), frequent


def quality_rules(docs: DataFrame, host: str = "source", max_documents: int = 30, max_share: float = 0.02, max_lost: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Two tables: one row per row of ``docs``, with doc_id, the host, the counts of :func:`text_rules`, lost_words and
    ``kept``; and (_host, h), the hashes of each host's dropped lines.

    A line is dropped in a host if the host's distinct documents that have it are more than ``max_documents`` and more
    than ``max_share`` of the host's distinct documents. A document is depleted if more than ``max_lost`` of its words
    are in dropped lines, or more than half of them and fewer than 10 words are left. Documents whose texts are equal but
    for case and white space count once, so that a copied text isn't taken for boilerplate.

    A null text has no words and fails; a null host is a host of its own; repeated rows each get their row; an empty
    table gives none; very long texts are taken whole, in one row's arrays of words and lines. Other columns of ``docs``
    are ignored, whatever their names.
    """
    rules, frequent = _checked(docs, host, max_documents, max_share, max_lost)
    return rules.drop("_lines", "_copy", "_hits", "_id", "_row", "_n").withColumnRenamed("_of", "host"), frequent.lines


#: Up to so many rejected rows are broadcast; beyond, they are joined by shuffle.
FEW_ROWS = 1 << 20


def apply_quality_rules(docs: DataFrame, host: str = "source", max_documents: int = 30, max_share: float = 0.02, max_lost: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that are kept, their dropped lines taken out of ``text`` and ``n_chars`` (if there) counted anew.

    Rows are known again by doc_id and a hash of the text. Texts are shuffled only beyond :data:`FEW_ROWS` rejected rows or
    :data:`FEW_LINES` dropped lines, and then by row, not by host. Cases as in :func:`quality_rules`.
    """
    rules, frequent = _checked(docs, host, max_documents, max_share, max_lost)
    gone = materialize(rules.filter("not kept").select(F.col("_id").alias("_i"), F.col("_row").alias("_r")).distinct(), "rejected")
    few = gone.limit(FEW_ROWS + 1).count() <= FEW_ROWS
    # the caller's columns travel in one struct, where no name can clash
    text = F.col("text").cast("string")
    rows = docs.select(F.struct("*").alias("_doc"), F.col(host).alias("_of"), text.alias("text"), F.col("doc_id").cast("string").alias("_id"), F.xxhash64(text).alias("_row"))
    left = rows.join(F.broadcast(gone) if few else gone, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_row") == F.col("_r")), "left_anti")
    left = frequent.of_texts(left)
    lines = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("_hits", F.xxhash64(F.trim(_normal(x)))))
    left = left.withColumn("text", F.when(F.size("_hits") > 0, F.array_join(lines, "\n")).otherwise(F.col("text")))
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return left.select(*((new[c] if c in new else F.col("_doc").getField(c)).alias(c) for c in docs.columns))
