"""Classes of wrappers do not erase the article in them."""

from __future__ import annotations

import pytest

from quillsieve.llm.htmltext import main_text

TEXT = "One long sentence of the article, and then another one. " * 8
BESIDE = "<div class='sidebar'><p>More to read.</p></div><div class='page-comments'><p>First!</p></div>"


@pytest.mark.parametrize(
    "opened, closed",
    [
        ("<div id='content' class='has-sidebar'>", "</div>"),
        ("<div class='no-sidebar'>", "</div>"),
        ("<div class='layout-with-sidebar'>", "</div>"),
        ("<article class='post tag-legal'>", "</article>"),
        ("<div class='category-search'>", "</div>"),
        ("<div class='section-commentary'>", "</div>"),
        ("<form action='x'>", "</form>"),
    ],
)
def test_wrappers(opened, closed):
    page = f"<body>{opened}<h1>Title</h1><p>{TEXT}</p>{BESIDE}{closed}</body>"
    assert main_text(page) == f"Title {TEXT.strip()}"


def test_marked_parts_still_go():
    assert main_text(f"<body><p>{TEXT}</p>{BESIDE}<form>Mail me</form></body>") == TEXT.strip()


SAYS = "<p>A reader says a great deal, and says it again, at length, and with no end in sight. So it goes.</p>"


@pytest.mark.parametrize(
    "opened, closed",
    [
        ("<div class='comment-list'>", "</div>"),
        ("<div class='user-comments'>", "</div>"),
        ("<section class='reader-responses'>", "</section>"),
        ("<ol id='commentList'>", "</ol>"),
        ("<div class='article-comments'>", "</div>"),
        ("<div id='comments'>", "</div>"),
        ("<article class='comment'>", "</article>"),
        ("<section class='comments-area'><article class='comment-body'>", "</article></section>"),
    ],
)
@pytest.mark.parametrize("inside", [True, False])
def test_comments_go_however_long(opened, closed, inside):
    part = f"{opened}{SAYS * 40}{closed}"
    held = f"<h1>Title</h1><p>{TEXT}</p>"
    page = f"<article>{held}{part}</article>" if inside else f"<article>{held}</article>{part}"
    assert main_text(f"<body>{page}</body>") == f"Title {TEXT.strip()}"


@pytest.mark.parametrize(
    "opened", ["<article class='post comments-open'>", "<div class='has-comments'>", "<div class='no-comments post'>", "<div class='comments'>"]
)
def test_names_of_comments_around_the_article(opened):
    assert main_text(f"<body>{opened}<h1>Title</h1><p>{TEXT}</p></body>") == f"Title {TEXT.strip()}"
