"""Main text: malformed pages, cost, and message passing against all labellings."""

import itertools
import math
import time

import numpy as np
import pytest

from inkfold.llm import html as H

MODEL = H.trained()
TEXT = "This is the first sentence of an article, and it is long enough. Here is another one, which says some more."


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(6)
    for n in (1, 2, 5, 8):
        parents = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        unary, pair = rng.normal(0, 2, n).tolist(), rng.normal(0, 2, (2, 2)).tolist()
        total, single, joint = 0.0, np.zeros(n), np.zeros((2, 2))
        for states in itertools.product((0, 1), repeat=n):
            edges = [(states[parents[i]], states[i]) for i in range(1, n)]
            w = math.exp(sum(u * s for u, s in zip(unary, states, strict=True)) + sum(pair[a][b] for a, b in edges))
            total += w
            single += w * np.array(states)
            for a, b in edges:
                joint[a, b] += w
        got, pairs = H.marginals(parents, unary, pair, with_pairs=True)
        assert np.allclose(got, single / total) and np.allclose(pairs, joint / total)


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>x</title><body><article><h1>Title</h1><p>{TEXT}</p></article></body></html>",
        f"<html><head><title>x</title><meta charset=utf-8><article><h1>Title</h1><p>{TEXT}</article>",
        f"<head><script>var a = 1;</script><style>p {{}}</style><link rel=x href=y><body><article><h1>Title</h1><p>{TEXT}</p></article>",
        f"<!doctype html><html><head></head><body><article><h1>Title</h1></b></i></span><p>{TEXT}</article></div></div>",
        f"<html><html><body><body class=x><article><h1>Title</h1><p>{TEXT}</p></article></html>trailing",
    ],
)
def test_left_out_and_stray_tags(page):
    assert H.extract(page, MODEL).startswith(f"Title\n\n{TEXT}")


def test_head_texts_are_no_content():
    assert "secret" not in H.extract(f"<head><title>secret</title><style>secret</style><body><p>{TEXT}</p>", MODEL)


@pytest.mark.parametrize("open_, close", [("<b>", "</i>"), ("<div>", "</span>"), ("<li>", "</p>"), ("<b>", "<p>")])
def test_cost_grows_with_the_page(open_, close):
    def seconds(n):
        begun = time.perf_counter()
        H.parse(open_ * n + (close + "x") * n)
        return time.perf_counter() - begun

    assert seconds(16_000) < 20 * max(seconds(4_000), 0.02)


@pytest.mark.parametrize("page", [lambda n: "<i><article>" + "<b>" * n + "</i>" * n, lambda n: "<a " * n, lambda n: "<p>x</p>" + "<!-- " * n, lambda n: "<table>" + "<i></b>" * n])
def test_cost_of_stray_and_cut_off_tags(page):
    def seconds(n):
        begun = time.perf_counter()
        H.parse(page(n))
        return time.perf_counter() - begun

    assert seconds(32_000) < 20 * max(seconds(8_000), 0.02)


def test_a_tag_cut_off_by_the_end_is_left_out():
    assert H.extract(f"<article><h1>Title</h1><p>{TEXT} 1 < 2 <a href='x", MODEL) == f"Title\n\n{TEXT} 1 < 2"
    assert H.extract(f"<article><p>{TEXT} <", MODEL) == f"{TEXT} <"


def test_inline_ends_stay_inside_their_fence():
    tree = H.parse("<i><article><b>x</i>y</b>z</article></i>w")
    assert [tree.nodes[i].tag for i, _ in tree.runs] == ["b", "b", "article", "body"]


def test_columns_nulls_and_repeated_rows(spark):
    page = f"<nav><a href=/>Menu</a></nav><article><p>{TEXT}</p></article><footer>Foot of the page</footer>"
    rows = [(1, "u", page, "a", "b")] * 2 + [(2, "u", page, "a", "b"), (None, None, None, None, None)]
    got = H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, TEXT, len(TEXT)), (1, TEXT, len(TEXT)), (2, TEXT, len(TEXT))]
