import re

import pytest

from graphloom.llm import quality_rules
from graphloom.llm.queries import op4_quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    where = {}
    for i in range(len(words) - 4):
        where.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
        len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


ODD = ["", None, " ", "\n\n", "a", "a b c d e", "a b c d e a b c d e", "x x x x x x x x", "ä b\tc\x0bd e ä b\nc d e", "# * $ % & | < >", "a\na\n a\na \n", "é" * 3000 + " # 1", "1 2 3 4 5 6 7 8 9 10 1 2 3 4 5 6 " * 30]
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_counts_equal_brute_force(spark, sf):
    rows = [(i, t, "s") for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: tuple(r[c] for c in NAMES) for r in quality_rules.quality_rules(docs)[0].collect()}
    assert got == {i: brute(t) for i, t, _ in rows}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r[c] for c in NAMES) for r in op4_quality_rules(spark, sf).collect()}
    assert got == {i: brute(t) for i, t in texts.items()}


def _site():
    """Pages of one host with a notice and own words, pages that are nothing but the notice, and many copies of one page."""
    own = lambda i: " ".join(f"own{i}x{j}" for j in range(30))
    notice = "Please accept all our cookies now or leave this very page for ever"
    rows = [(i, f"{notice}\n{own(i)}", "a") for i in range(40)]
    rows += [(100 + i, f"{notice.upper()}\nvisitor number{i} here", "a") for i in range(5)]
    rows += [(200 + i, f"{own(7000)}\n{own(8000)}", "a") for i in range(60)]
    rows += [(300, f"{notice}\nmore", "b"), (301, f"{own(1)}\n{own(2)}", None)]
    return rows


@pytest.mark.parametrize("few", [True, False])
def test_frequent_lines_go_and_copies_stay(spark, monkeypatch, few):
    """By broadcast, and by joining lines and rows as with very many frequent lines or rejected rows."""
    if not few:
        monkeypatch.setattr(quality_rules, "FEW_LINES", 0)
        monkeypatch.setattr(quality_rules, "FEW_ROWS", 0)
    docs = spark.createDataFrame(_site(), "doc_id long, text string, source string")
    out = {r.doc_id: r for r in quality_rules.quality_rules(docs)[0].collect()}
    assert all(out[i].kept and out[i].lost_words == 13 for i in range(40))
    assert not any(out[100 + i].kept for i in range(5))
    assert all(out[200 + i].kept and not out[200 + i].lost_words for i in range(60))
    assert out[300].kept and out[301].kept
    left = {r.doc_id: r.text for r in quality_rules.apply_quality_rules(docs).collect()}
    assert left.keys() == {i for i, r in out.items() if r.kept}
    assert left[3] == " ".join(f"own3x{j}" for j in range(30)) and left[300] == _site()[-2][1]


def test_empty_table_clashing_names_and_repeated_rows(spark):
    schema = "doc_id long, text string, source string, _host string, _row int, kept int, n_words string"
    assert quality_rules.quality_rules(spark.createDataFrame([], schema))[0].count() == 0
    text = " ".join(map(str, range(20)))
    docs = spark.createDataFrame([(1, text, None, "h", 1, 1, "n")] * 2 + [(None, text, "s", None, None, None, None)], schema)
    left = quality_rules.apply_quality_rules(docs)
    assert left.columns == docs.columns and left.count() == 3


def test_every_different_text_counts_as_a_document(spark):
    """Also where the line holds the longest word of its pages, or all longest words come from few."""
    url, common = "Subscribe at https://www.example.com/newsletter/subscribe", "incomprehensibilities"
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(20))
    rows = [(i, f"{url}\n{own(i)}", "a") for i in range(40)] + [(40, url, "a")]
    rows += [(100 + i, f"Read it again\n{common} {own(i)}", "b") for i in range(40)]
    out = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"))[0].collect()}
    assert [out[i].lost_words for i in range(41)] == [3] * 41 and not out[40].kept
    assert [out[100 + i].lost_words for i in range(40)] == [3] * 40
