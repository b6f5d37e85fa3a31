"""Main text of pages whose article nests sections, lists and quotes."""
from ledgermill.llm import htmltext

LONG = [f"Long paragraph {i}, with commas, and words enough to weigh." * 3 for i in range(10)]
PARAGRAPHS = "".join(f"<p>{t}</p>" for t in LONG)
ITEMS = "".join(f"<li>{t}</li>" for t in LONG)


def test_nested_blocks_keep_the_article():
    for nested in (f"<section>{PARAGRAPHS}</section>", f"<ul>{ITEMS}</ul>", f"<blockquote>{PARAGRAPHS}</blockquote>", f"<div><div>{PARAGRAPHS}</div></div>"):
        for open_, close in (("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>")):
            page = f"<body><nav>Menu</nav>{open_}<h1>Title</h1><p>Intro.</p>{nested}<section><p>Short.</p></section><p><a href=/>Source</a></p>{close}<footer>f</footer>"
            assert htmltext.extract(page) == "\n".join(["Title", "Intro.", *LONG, "Short.", "Source"])


def test_sections_together_outweigh_a_division():
    page = f"<article><section>{PARAGRAPHS}</section><section>{PARAGRAPHS}</section></article><div>{PARAGRAPHS}<p>more, text</p></div>"
    assert htmltext.extract(page).startswith("\n".join(LONG + LONG))


def test_without_an_article():
    links = "<ul>" + "".join(f"<li><a href=/>Link {i}</a></li>" for i in range(5)) + "</ul>"
    for nested in (f"<section>{PARAGRAPHS}</section><section><p>Short.</p></section>", f"<ul>{ITEMS}</ul><p>Short.</p>"):
        assert htmltext.extract(f"<body>{links}<div><h1>Title</h1><p>Intro.</p>{nested}</div>{links}") == "\n".join(["Title", "Intro.", *LONG, "Short."])
    assert htmltext.extract(f"<body>{links}<h1>Title</h1><p>Intro.</p><section>{PARAGRAPHS}</section>") == "\n".join(["Title", "Intro.", *LONG])
