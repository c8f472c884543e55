"""Tree matching of large lists against the plain table."""

import random
import time
import tracemalloc

from docketry.llm import html_text
from docketry.llm.html_text import Node


def plain(a, b, seen):
    """Size of the largest match and its child pairs, from the whole table."""
    key = (id(a), id(b))
    if key not in seen:
        n, m = len(a.children), len(b.children)
        best, gain = [[0] * (m + 1) for _ in range(n + 1)], {}
        for i, x in enumerate(a.children):
            for j, y in enumerate(b.children):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j])
                if x.label == y.label:
                    gain[i, j] = plain(x, y, seen)[0]
                    best[i + 1][j + 1] = max(best[i + 1][j + 1], best[i][j] + gain[i, j])
        pairs, i, j = [], n, m
        while i and j:
            if (i - 1, j - 1) in gain and best[i][j] == best[i - 1][j - 1] + gain[i - 1, j - 1]:
                pairs.append((a.children[i - 1], b.children[j - 1]))
                i, j = i - 1, j - 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        seen[key] = (1 + best[n][m], pairs[::-1])
    return seen[key]


def tree(draw, depth):
    node = Node(draw.choice("abc"), False, False, False)
    node.children = [tree(draw, depth - 1) for _ in range(draw.randint(0, 5 if depth else 0))]
    return node


def test_pairs_equal_those_of_the_whole_table():
    draw = random.Random(3)
    for _ in range(150):
        a, b = tree(draw, 4), tree(draw, 4)
        seen, want, todo = {}, [], [(a, b)]
        while todo:
            x, y = todo.pop()
            want.append((id(x), id(y)))
            todo.extend(plain(x, y, seen)[1])
        assert [(id(x), id(y)) for x, y in html_text.align(a, b)] == want


def page(blocks):
    return html_text.fold(html_text.parse("<html><body>" + "".join(blocks) + "</body></html>"))


def test_a_page_of_a_megabyte_matches_in_bounded_memory():
    draw = random.Random(7)
    blocks = [f"<{t}>{'x' * 30} {i}</{t}>" for i in range(24_000) for t in (("p", "h2", "ul")[(i + draw.randint(0, 1)) % 3],)]
    a, b = page(blocks), page(blocks[:9_000] + ["<h3>new</h3>"] + blocks[9_500:] + ["<h4>end</h4>"])
    assert sum(map(len, blocks)) > 900_000
    tracemalloc.start()
    began = time.perf_counter()
    pairs = html_text.align(a, b)
    took, (_, peak) = time.perf_counter() - began, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(pairs) > 0.95 * len(html_text.listed(b)) and took < 60 and peak < 300e6
