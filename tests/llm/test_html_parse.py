"""The page parser against one that walks up the open tags, and its time on deep pages."""

import random
import re
import time

import pytest

from frameflow.llm import html


def slow_tree(page):
    """(tag, parent) of the elements, by walking up the stack for every tag."""
    nodes, stack = [("#root", -1)], [0]
    for end, tag in re.findall(r"<(/?)([a-z]+)>", page):
        if tag not in html.BLOCKS:
            continue
        if end:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]][0] == tag:
                    del stack[k:]
                    break
            continue
        for k in range(len(stack) - 1, 0, -1):
            above = nodes[stack[k]][0]
            if above == "p" or above in html.CLOSES.get(tag, ()):
                del stack[k:]
            elif above in html.SCOPE.get(tag, html.BLOCKS):
                break
        if tag != "hr":
            nodes.append((tag, stack[-1]))
            stack.append(len(nodes) - 1)
    return nodes


def test_trees_equal_those_of_a_walk_up_the_stack():
    r = random.Random(0)
    tags = ["div", "p", "table", "tr", "td", "th", "tbody", "thead", "tfoot", "ul", "ol", "li", "dl", "dt", "dd", "option", "section", "hr", "article"]
    for _ in range(3000):
        page = "".join(f"<{'/' if r.random() < 0.4 else ''}{r.choice(tags)}>" for _ in range(r.randint(1, 40)))
        got = html.parse(page)
        assert [(x.tag, x.parent) for x in got] == slow_tree(page), page


@pytest.mark.parametrize("page", ["<div>{}<td></td>", "<div>{}</section>", "<b>x{}", "<li>{}", "<table><tr><td>{}", "<div>{}<li>x", '<a "{}'])
def test_deep_pages_take_linear_time(page):
    one, two = page.split("{}")
    sizes = []
    for n in (10_000, 40_000):
        began = time.process_time()
        html.parse(one * n + two * n)
        sizes.append(time.process_time() - began)
    assert sizes[1] < 10 * sizes[0] + 0.5
