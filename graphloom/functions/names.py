"""The library's functions under SQL names, for queries written as SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class PartitionCounts:
    """Rows (parts, n): how many partitions of a total have so many parts; n as text, for counts pass any integer type."""

    def eval(self, total: int):
        if total is None or total < 1:
            return
        # ways[k][q]: partitions of q into k parts; either a part is 1, or all parts shrink by 1
        ways = [[1] + [0] * total]
        for k in range(1, total + 1):
            row = [0] * (total + 1)
            for q in range(k, total + 1):
                row[q] = ways[k - 1][q - 1] + row[q - k]
            ways.append(row)
            yield k, str(row[total])


#: SQL functions by name: parameters, type of the result, expression.
EXPRESSIONS = {
    "graph_draw": ("seed BIGINT, key STRING", "BIGINT", "CAST(conv(substring(md5(concat_ws(':', CAST(seed AS STRING), key)), 1, 8), 16, 10) AS BIGINT)"),
    "graph_uniform": ("seed BIGINT, key STRING", "DOUBLE", "CAST(conv(substring(md5(concat_ws(':', CAST(seed AS STRING), key)), 1, 8), 16, 10) AS BIGINT) / 4294967296.0D"),
    "graph_hash": ("cells ARRAY<STRUCT<s: INT, o: INT, d: INT>>", "STRING", "md5(array_join(transform(array_sort(cells), c -> concat_ws(',', c.s, c.o, c.d)), ';'))"),
}


def register(spark: SparkSession) -> None:
    """Registers, for this session:

    * ``partition_counts(total)``, a table function, also behind ``LATERAL``: rows (parts, n) of the partitions of total;
      none for null or numbers below 1
    * ``graph_draw(seed, key)`` and ``graph_uniform(seed, key)``: the draws of :mod:`graphloom.functions.draws` for keys
      joined by ``:``; a null key counts as none
    * ``graph_hash(cells)``: the hash of a graph's packaged distances; of a null array null
    """
    spark.udtf.register("partition_counts", udtf(PartitionCounts, returnType="parts: int, n: string"))
    for name, (given, kind, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {kind} RETURN {body}")
