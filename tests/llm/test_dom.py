"""Markup that is read as browsers do."""

import pytest

from assetweave.llm import dom, extract, labelled_pages


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("<p title=it's>ONE one</p><p>TWO don't</p>", ["ONE one", "TWO don't"]),
        ('<p title=5">ONE</p><p>TWO "quoted"</p>', ["ONE", 'TWO "quoted"']),
        ("<p it's>ONE</p><p>it's TWO</p>", ["ONE", "it's TWO"]),
        ("<!--><p>a</p><!-- x -->b", ["a", "b"]),
        ("<!---><p>a</p>--><p>b</p>", ["a", "-->", "b"]),
        ('<a href="x>y" title=\'1 > 0\'>z</a>', ["z"]),
        ('<p title = "a > b" hidden>v</p>', ["v"]),
        ('<p title="unclosed>u</p>', ["u"]),
        ("<br/><img src=a/b/>w", ["w"]),
    ],
)
def test_pieces(page, wanted):
    assert [piece for _, piece, _ in dom.parse(page).pieces] == wanted


def test_hints_of_unquoted_values():
    assert dom.parse("<div class=main-content id='q>r' role=it's>t</div>").words[1] == ("main", "content", "q", "r", "it", "s")


@pytest.mark.parametrize("around", [False, True])
def test_text_right_in_body_comes_out_whole(around):
    """However long it is, with a menu and a footer beside it or alone, with a heading or without; but a lone paragraph without a
    heading between menu and footer may be taken for a part of them."""
    make, pages, wanted = labelled_pages.Maker(21), [], []
    for n in range(1, 13):
        for heading in ("", "<h1>What there is to say</h1>")[around and n == 1 :]:
            texts = [" ".join(make.r.choice(["kalo", "miter", "sundar", "vel", "porin"]) for _ in range(make.r.randint(15, 40))) + "." for _ in range(n)]
            body = heading + "".join(f"<p>{t}</p>" for t in texts)
            if around:
                body = f"<nav><ul><li><a href=/>Home</a></li><li><a href=/x>Other page</a></li></ul></nav>{body}<footer>All rights reserved</footer>"
            pages.append(f"<html><head><title>t</title></head><body>{body}</body></html>")
            wanted.append(" ".join([*(["What there is to say"] if heading else []), *texts]))
    assert extract.extracted(pages, extract.default_model()) == wanted


def test_held_out_layouts():
    """Pages of other seeds, in all layouts: nine in ten come out exactly."""
    pages = labelled_pages.labelled_pages(300, seed=77)
    trees = [dom.parse(p) for p in pages]
    wanted = [dom.main_text(t, extract.truth([t]).tolist()) for t in trees]
    got = extract.extracted(pages, extract.default_model())
    assert sum(a == b for a, b in zip(got, wanted, strict=True)) >= 0.9 * len(pages)
