"""The block parser on hand-built documents, and pieces against a plain rule."""

import random
import time

import pytest

from asoflow.operators import markdown as M
from asoflow.operators import text as T


def kinds(text):
    return [(k, r, p, b) for _, k, r, p, b in M.blocks_of(text)]


def test_headings_of_both_kinds_and_paths():
    found = kinds("Top\n===\n\nintro\n\nSub two\nlines\n---\npara\n### Deep ###\nx\n## Next\ny\r\nz\n#hash is text")
    assert found == [
        ("heading", "structural_heading", "Top", "# Top"), ("paragraph", None, "Top", "intro"), ("heading", "structural_heading", "Top > Sub two lines", "## Sub two lines"), ("paragraph", None, "Top > Sub two lines", "para"),
        ("heading", "structural_heading", "Top > Sub two lines > Deep", "### Deep ###"), ("paragraph", None, "Top > Sub two lines > Deep", "x"), ("heading", "structural_heading", "Top > Next", "## Next"),
        ("paragraph", None, "Top > Next", "y\nz\n#hash is text"),
    ]


def test_comments_rules_fences_and_lists():
    text = "<!-- one\n\ntwo -->\n\n<!-- x --> tail\nstays\n\n***\n\n````py\n```\n# no\n````\n\n- a\n- b\n\n  more\n\n1. n\n\n> q\nlazy\n\n|a|b|\n|-|-|\n|1|2|\n\n    code\n\n    more\n\n[x]: http://h\n\n<div>\nraw\n</div>\n\n---"
    assert [(k, r) for k, r, _, _ in kinds(text)] == [
        ("comment", "html_comment"), ("html_block", None), ("rule", "thematic_break"), ("fence", None), ("bullet_list", None), ("ordered_list", None), ("blockquote", None), ("table", None), ("code_block", None),
        ("reference_definition", None), ("html_block", None), ("rule", "thematic_break"),
    ]
    by = {k: b for k, r, _, b in kinds(text) if r is None}
    assert by["fence"] == "````py\n```\n# no\n````" and by["bullet_list"] == "- a\n- b\n\n  more" and by["code_block"] == "    code\n\n    more" and by["blockquote"] == "> q\nlazy"
    assert kinds("```\nnever closed\n# no") == [("fence", None, "", "```\nnever closed\n# no")] and kinds("<!-- never\nclosed")[0][1] == "html_comment"


def test_navigation_is_left_out():
    text = "# Guide\n\n## Contents\n\n- [A](#a)\n- text\n\n### Inner\n\nx\n\n## A\n\nkept\n\n[up](#top) | [down](#end)\n\nsee [a](#a) there\n\n- [one](#1)\n- [two](#2)"
    found = kinds(text)
    assert [(k, r) for k, r, _, _ in found] == [
        ("heading", "structural_heading"), ("heading", "navigation_section"), ("bullet_list", "navigation_section"), ("heading", "navigation_section"), ("paragraph", "navigation_section"), ("heading", "structural_heading"),
        ("paragraph", None), ("paragraph", "anchor_navigation"), ("paragraph", None), ("bullet_list", "anchor_navigation"),
    ]
    assert [p for k, r, p, _ in found if r is None] == ["Guide > A"] * 2


def plain_pieces(text, limit):
    rest, out = text.strip("\n"), []
    while len(rest.encode()) > limit:
        head = rest.encode()[:limit].decode("utf-8", "ignore")
        cut = head.rfind("\n") if head.rfind("\n") > 0 else head.rfind(" ")
        cut = cut if cut > 0 else max(1, len(head))
        if piece := rest[:cut].strip("\n"):
            out.append(piece)
        rest = rest[cut:].lstrip(" \n")
    return out + ([rest] if rest else [])


@pytest.mark.parametrize("limit", [1, 3, 7, 40])
def test_pieces_by_a_plain_rule(limit):
    rng = random.Random(limit)
    for _ in range(400):
        text = "".join(rng.choices("ab é日😀 \n", k=rng.randrange(0, 120)))
        assert M.bounded_pieces(text, limit) == plain_pieces(text, limit)


def test_long_texts_take_linear_time(spark):
    began = time.perf_counter()
    for text in ("x" * 5_000_000, "a b " * 1_000_000, "é\n" * 1_000_000, " " * 3_000_000, "- " * 1_000_000, "<!--" * 500_000, "`" * 2_000_000, "|-" * 1_000_000, "](#" * 500_000, "[" * 1_000_000):
        M.bounded_pieces(text, 1200)
        M.blocks_of(text)
        M.blocks_of(text.replace(" ", "\n"))
    assert time.perf_counter() - began < 60


def test_tables_of_blocks_and_chunks(spark):
    rows = [(1, "# A\n\npara\n\npara\n\n---\n"), (1, "# A\n\npara"), (None, "x"), (2, None), (3, ""), (4, "# T\n\n" + "word " * 300)]
    df = spark.createDataFrame(rows, "id long, t string")
    all_ = M.markdown_blocks(df, "id", "t", omitted=True).collect()
    assert {r["reason"] for r in all_} == {None, "structural_heading", "thematic_break"}
    assert {r["kind"] for r in T.markdown_blocks(df, "id", "t").collect()} == {"text"}
    chunks = M.chunk_table(df.repartition(3), "id", "t", 200).collect()
    assert sorted((r["id"] or 0, len(r["occurrences"])) for r in chunks if r["text"] in ("para", "x")) == [(0, 1), (1, 1), (1, 2)]
    assert all(len(r["text"].encode()) <= 200 for r in chunks) and M.chunk_table(df.limit(0), "id", "t", 200).count() == 0
