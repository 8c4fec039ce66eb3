"""Pages with article elements that are not, or not alone, their text."""

from perkolat.llm import htmltext

GOOD = "The house of the man is in the town and it was built by the sea for all of them to see. " * 4


def test_text_beside_a_teaser_article():
    text = htmltext.main_text(f"<div><p>{GOOD}one</p><p>{GOOD}two</p></div><div>All rights reserved</div><article><h3>Zug Bahn</h3><p><a href=x>Read this story</a></p></article>")
    assert text.split("\n") == [f"{GOOD}one", f"{GOOD}two"]


def test_text_partly_outside_its_article():
    text = htmltext.main_text(f"<article><h1>Title</h1><p>{GOOD}one</p></article><div><p>{GOOD}two</p></div><ul><li><a href=x>More</a></li></ul>")
    assert text.split("\n") == ["Title", f"{GOOD}one", f"{GOOD}two"]


def test_article_is_a_prior_for_words_that_are_not_known():
    strange = "zor blik mepta quon dralle " * 20
    text = htmltext.main_text(f"<p>{strange}out</p><ul><li><a href=x>Home</a></li></ul><article><h1>Blik</h1><p>{strange}in</p><p>Mep</p></article><div><a href=y>More</a></div>")
    assert text.split("\n") == ["Blik", f"{strange}in", "Mep"]


def test_block_between_links_of_an_article():
    text = htmltext.main_text(f"<article><p>{GOOD}one</p><p><a href=x>Link one</a></p><p>Short</p><p><a href=y>Link two</a></p><p>{GOOD}two</p></article>")
    assert text.split("\n") == [f"{GOOD}one", f"{GOOD}two"]
