import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm.split import BOUNDARY, split_corpus, split_tree

PARTS = st.lists(st.sampled_from(["# Head\n\n", "## Sub\n", "word ", "A sentence. ", "- item\n", "1. first\n", "\n\n", "```\ncode  x\n\ny\n```\n", "長い文。", "x" * 70, "\r\n", "<h2>t</h2>\n", "é" * 30]), max_size=120)


def check(text, limit, overlap):
    p, oversized = split_tree(text, limit, overlap)
    assert p[0][0] == 0 and p[-1][1] == len(text)
    for a, b in zip(p, p[1:]):
        assert b[0] == a[1] - overlap and b[1] > a[1]
        assert b[2] == "forced" or text[a[1] - 1] in BOUNDARY
    assert all(e - s <= limit for s, e, _ in p)
    assert text[: p[0][1]] + "".join(text[a[1] : b[1]] for a, b in zip(p, p[1:])) == text
    assert oversized == bool(re.search(rf"[^{re.escape(BOUNDARY)}]{{{limit + 1},}}", text))


@settings(max_examples=200, deadline=None)
@given(PARTS, st.sampled_from([(100, 10), (60, 20), (200, 0)]))
def test_pieces_tile_overlap_and_cut_at_boundaries(parts, size):
    text = "".join(parts)
    if len(text) > size[0]:
        check(text, *size)


def test_headings_and_blocks_are_preferred():
    text = "# A\n\n" + "alpha beta. " * 40 + "\n\n# B\n\n" + "gamma delta. " * 40
    p = split_tree(text, 700, 50)[0]
    assert [x[2] for x in p] == ["", "section"] and text[p[0][1] :].startswith("# B")


def test_edges_of_the_limit_and_very_long_texts():
    check("x" * 5000, 1200, 120)
    for n in (1080, 1081, 1200, 1201):
        check("w" * 1200 + " " + "v" * n + ". ", 1200, 120)
        check("- " + "v" * n + "\n\n# h\n" + "w " * 900, 1200, 120)
    check("\n" * 4000, 1200, 120)
    check("# t\n" + "y" * 3000, 1200, 120)
    check(("word " * 12 + "\n") * 8000, 1200, 120)


def test_corpus(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a" * 1200, 0), (4, "a" * 1201, 0), (5, "ab " * 600, 0), (5, "ab " * 600, 0)], "doc_id long, text string, piece int")
    got = split_corpus(df, "doc_id", "text").collect()
    assert {(r["doc_id"], r["forced"]) for r in got} == {(4, 1), (5, 0)} and sum(r["piece"] == 0 for r in got) == 3
    assert all(len(r["body"]) == r["end"] - r["start"] <= 1200 for r in got)
    assert split_corpus(df.limit(0), "doc_id", "text").count() == 0
