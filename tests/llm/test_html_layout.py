"""Styles with combinators and media, and pages that are large in one respect."""

import random
import time

import pytest
from residuum.llm.html_extract import _feature, _for_screens, _places, _rows, parse, render


def page(css, body):
    return render(f"<style>{css}</style>{body}")


@pytest.mark.parametrize(
    "media, holds",
    [
        ("", True), ("all", True), ("screen", True), ("print", False), ("only screen", True), ("only print", False), ("not print", True), ("not screen", False), ("speech, screen", True),
        ("screen and (max-width:600px)", False), ("(min-width:600px)", True), ("(max-width: 80em)", True), ("(max-width: 79em)", False), ("screen and (min-width:600px) and (max-width:900px)", False),
        ("(width >= 600px)", True), ("(400px <= width <= 700px)", False), ("(600px < width)", True), ("(orientation: portrait)", False), ("(orientation:landscape)", True),
        ("(prefers-color-scheme: dark)", False), ("(hover: hover)", True), ("(unheard-of: 1)", False), ("print and (min-width:1px)", False), ("(max-width:600px), (min-width:1000px)", True), ("(max-width:9px) or (min-width:9px)", True),
    ],
)
def test_media(media, holds):
    assert _for_screens(media) == holds


def test_both_halves_of_a_responsive_page():
    css = "@media screen and (max-width:600px){.d{display:none}} @media (min-width:600px){.m{display:none}} @media only print{body{display:none}}"
    assert page(css, "<p class=d>desktop<p class=m>mobile<p>both") == "desktop\n\nboth"
    assert not _feature("max-width: none") and not _feature("")


@pytest.mark.parametrize(
    "selector, hidden",
    [
        ("div p", True), ("div > p", False), ("section > p", True), ("div > section > p", True), ("div section p.a", True), ("section section p", False), ("h1 + p", True), ("h2 + p", False), ("h2 ~ p", True),
        ("h1~p", True), ("p:not(.b)", True), ("p:not(.a)", False), ("p:not(.x, .a)", False), ("[data-k]", True), ("[data-k=v]", True), ('p[data-k="w"]', False), ("[data-k^=v]", True), ("p:first-child", False),
        ("p:last-child", True), ("p:hover", False), ("p::before", False), ("div:hover p", False), ("body p", False), ("article div > p", False), ("article div section > p", True), ("* > p.a", True), ("div h1 + p", True), ("div h2 + h1 + p", True),
    ],
)
def test_selectors(selector, hidden):
    body = "<article><div><section><h2>a</h2><h1>b</h1><p class=a data-k=v>text</section></div></article>"
    assert ("text" not in page(selector + "{display:none}", body)) == hidden


def test_cascade_of_combinators():
    assert page("div .a{display:none} .a{display:block}", "<div><p class=a>no") == ""
    assert page("div .a{display:none} p.a.b{display:block}", "<div><p class='a b'>yes") == "yes"
    assert page(".a:not(#k){display:none} .a.b.c{display:block}", "<p class='a b c'>no") == ""


def test_labels_and_list_numbers():
    assert render("<form>a <input type=submit value='Send it'> <input value=typed> <input type=hidden value=x> <button>ok</button></form>").split() == ["a", "Send", "it", "ok"]
    assert render("<ol><li value=5>a<li>b<li value=-1>c<li>d</ol>") == "5. a\n6. b\n-1. c\n0. d"
    assert render("<ol reversed><li>a<li>b<li>c</ol>") == "3. a\n2. b\n1. c"
    assert render("<ol reversed start=10><li>a<li value=4>b<li>c</ol>") == "10. a\n4. b\n3. c"


def plain_places(rows):
    out, taken, before = [], {}, None
    for section, cells in rows:
        taken, before = (taken, before) if section == before else ({}, section)
        line, column, new = [], 0, {}
        for cell in cells:
            while column in taken:
                column += 1
            line.append((column, cell))
            wide, high = int(cell.attrs.get("colspan", 1)), int(cell.attrs.get("rowspan", 1))
            new.update((c, high - 1) for c in range(column, column + wide) if high > 1 and c not in taken)
            column += wide
        taken = {c: n - 1 for c, n in taken.items() if n > 1} | {c: n for c, n in new.items()}
        out.append(line)
    return out


def test_places_of_random_tables():
    rnd = random.Random(0)
    for _ in range(300):
        html = "<table>" + "".join("<tr>" + "".join(f"<td rowspan={rnd.choice([1, 1, 2, 3, 9])} colspan={rnd.choice([1, 1, 2, 3])}>x" for _ in range(rnd.randint(0, 5))) for _ in range(12))
        rows = _rows(parse(html).children[0])[1]
        assert [[c for c, _ in line] for line in _places(rows)] == [[c for c, _ in line] for line in plain_places(rows)]


def test_deep_tables_keep_their_columns():
    table = "<table><tr><td>a<td>b<tr><td>longer<td>c</table>"
    for around in ("<blockquote>", "<ul><li>", "<table><tr><td>", "<div>"):
        lines = [x for x in render(around * 150 + table).split("\n") if x]
        assert [x.lstrip("> -").strip() for x in lines][-2:] == ["a       b", "longer  c"]


WIDE = "word " * 20_000
PAGES = {
    "spans": "<table>" + "<tr><td rowspan=60000 colspan=1000>x" * 28_000,
    "falling spans": "<table>" + "".join(f"<tr><td rowspan={30000 - i}>x<td>y" for i in range(25_000)),
    "wide cell": f"<table><tr><td>{WIDE}<td>end" + "<tr><td>a<td>b" * 50_000,
    "long word": f"<table><tr><td>{'x' * 500_000}<td>end" + "<tr><td>a<td>b" * 20_000,
    "rules": "<style>" + "".join(f".c{i % 50}{{display:block}} .d .e{i}{{display:none}}" for i in range(12_000)) + "</style>" + "".join(f"<p class='c{i % 50} e{i}'>x" for i in range(12_000)),
    "equal rules": "<style>" + ".c{display:block}" * 25_000 + "</style>" + "<p class=c>x" * 25_000,
    "quotes": "<blockquote>x" * 60_000,
    "tables": "<table><tr><td>x" * 12_000,
    "stairs": "<table>" + "".join(f"<tr><td colspan={min(1000, i)}><td>x" for i in range(30_000)),
}


@pytest.mark.parametrize("kind", PAGES)
def test_a_megabyte_of_one_kind_takes_seconds(kind):
    html = PAGES[kind]
    began = time.time()
    text = render(html)
    assert time.time() - began < 30 and len(text) < 12 * len(html), (time.time() - began, len(text) / len(html))
    assert "x" in text or "end" in text
