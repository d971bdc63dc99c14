"""Vocabularies, parameters and the library's front."""

import pytest

from graphloom import api, config
from graphloom.functions import vocab
from graphloom.functions.draws import draw, host_draw, uniform


def test_default_vocabulary(spark):
    v = vocab.default_vocab(100, 15)
    assert (v["<s>"], v["</s>"], v["D"], v["0"], v["99"], v["D0"], v["D14"]) == (0, 2, 22, 23, 122, 123, 137)
    assert (v.min_vocab, v.max_vocab) == (23, 123) and len(v.depth_ids()) == 15
    kinds = {r.kind: r.n for r in v.table(spark).groupBy("kind").count().withColumnRenamed("count", "n").collect()}
    assert kinds == {"special": 23, "node": 100, "depth": 15}
    with pytest.raises(ValueError):
        vocab.own_vocab({"<s>": 0, "<pad>": 0})
    with pytest.raises(ValueError):
        vocab.own_positions({"pad": 0})
    again = vocab.own_vocab(v.ids)
    assert (again.min_vocab, again.max_vocab) == (23, 123)


def test_draws_agree_everywhere(spark):
    row = spark.range(1).select(draw(42, *(__import__("pyspark").sql.functions.lit(x) for x in (7, 3))).alias("d"), uniform(42, "id").alias("u")).first()
    assert row.d == host_draw(42, 7, 3) == 3766247919 and 0 <= row.u < 1


def test_parameters():
    given = config.args_parser().parse_args(["--graph_type", "path_star", "--no-shuffle_nodes", "--max_path_length", "9"])
    assert (given.graph_type, given.shuffle_nodes, given.max_path_length, given.min_num_nodes, given.query_at_end) == ("path_star", False, 9, 15, False)
    path = config.group_of(config.PathArgs, vars(given))
    assert (path.min_path_length, path.max_path_length) == (3, 9)
    for bad in (lambda: config.PathArgs(2, 3), lambda: config.KhopsArgs(max_khops=9), lambda: config.BatchArgs(batch_size=0), lambda: config.TokenArgs(is_flat_model=False), lambda: config.PathArgs(3, 2, (1.0,))):
        with pytest.raises(ValueError):
            bad()
    assert config.PosArgs(use_graph_structure=True, use_full_structure=True).size() == 3


def test_session(spark):
    s = api.Session(spark, 9)
    assert s.get_seed() == 9 and 0 <= s.rand_int(0, 5) <= 5
    s.set_default_dictionary(30, 20)
    assert s.get_dictionary_vocab_limits() == (23, 53) and s.get_dictionary()["D19"] == 72 and s.get_pos_dictionary()["task_start"] == 1000
    small = {"batch_size": 4, "max_num_arms": 3, "max_arm_length": 8}
    first = s.path_star_n(**small)
    second = s.path_star_n(**small)
    assert {r.inst for r in first.packaged.collect()} == {0, 1, 2, 3} and {r.inst for r in second.packaged.collect()} == {4, 5, 6, 7}
    s.set_validation_hashes(first.hashes.filter("inst = 1"))
    s.set_test_hashes(["none"])
    assert (s.get_validation_size(), s.get_test_size()) == (1, 1)
    assert [r.inst for r in s.is_invalid_example(first.hashes).filter("is_invalid").collect()] == [1]
    s.set_seed(9)
    assert [r.src_tokens for r in s.path_star_n(**small).packaged.orderBy("inst").collect()] == [r.src_tokens for r in first.packaged.orderBy("inst").collect()]
    args = vars(config.args_parser().parse_args(["--graph_type", "balanced", "--batch_size", "3", "--min_num_nodes", "25", "--max_num_nodes", "28"]))
    assert s.get_graph(args).packaged.count() == 3
    assert s.single("erdos_renyi", min_num_nodes=15, max_num_nodes=15).packaged.count() == 1
    with pytest.raises(ValueError):
        s.generate("erdos_renyi", "walk")
