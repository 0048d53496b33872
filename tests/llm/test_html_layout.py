"""Operator 4: layout cases by hand, and time in proportion to the page."""

from __future__ import annotations

import time

import pytest

from roadveil.llm.htmltext import render

TABLE = "<table><tr><td rowspan=2>A<td>b<tr><td><tr><td>c<td>d</table>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (TABLE, "A  b\nc  d"),
        ("<p style='display:none;display:block'>a<p style='display:block;display:none'>b", "a"),
        ("<p style='display:none!important;display:block'>a<p style='display: NONE ! important'>b<p hidden>c<p hidden style='display:block'>d", "d"),
        ("<style>.x{display:none} #y , p.z{visibility:hidden}</style><p class='a x'>1<p id=y>2<p class=z>3<div class=z>4</div>", "4"),
        ("<style>.x{display:none} @media print{p{display:none}} p.x{display:block}</style><p class=x>1<div class=x>2</div><p>3", "1\n\n3"),
        ("<style>/* p{display:none} */ .x{display:none}.x{display:block} div p{display:none} *{visibility:visible}</style><p class=x>1", "1"),
        ("<style media=print>p{display:none}</style><style>#a{display:none}.b{display:block!important}</style><p id=a class=b>1<p id=a>2", "1"),
        ("<style>p{display:none</style><p>1<div>2</div>", "2"),
        ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"),
        ("<ol start=-1><li>a<li value=7>b<li>c<li value=x>d</ol>", "-1. a\n7. b\n8. c\n9. d"),
        ("<ol start=99999999999999999999><li>a</ol>", "1. a"),
        ("x <input value='typed'> <input type=hidden value=no> <input type=password value=no> <input type=submit value=go>", "x go"),
    ],
)
def test_layout(page, text):
    assert render(page) == text


@pytest.mark.parametrize("page", ["<a b" + " " * 1_000_000, "<a b" + "/" * 1_000_000, "<a b=c" + " =" * 500_000, "<div>" * 200_000, "</x>" * 250_000, "<p style='display:none" + " " * 1_000_000 + "x'>a", "<style>" + "@m{p{}}" * 150_000 + "</style>", "<style>" + ".a.b{display:none}" * 60_000 + "</style>" + "<p class='a b'>" * 50_000])
def test_time_in_proportion(page):
    began = time.process_time()
    render(page)
    assert time.process_time() - began < 6
