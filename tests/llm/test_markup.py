"""Markup rules: options without end tags, ids and classes inside articles, frame parts by words."""

import pytest

from logweave.llm.html_extract import blocks, main_text


def text(html):
    return main_text(blocks(html), [])


BODY = "<article><p>One.</p>{}<p>Two.</p></article>"


@pytest.mark.parametrize("before", ["<datalist><option value=a></datalist>", "<datalist><option value=a>x<option>y</datalist>", "<select><option>x<option>y</select>", "<option>x", "<div><option>x</option></div>", "<select><option>x</option></select>"])
def test_options_end_with_their_parents(before):
    assert text(before + BODY.format("")) == "One.\n\nTwo."


@pytest.mark.parametrize("part", ['<h2 id="related-work">R</h2>', '<section id="search-algorithms"><p>R</p></section>', '<p class="ad-hoc">R</p>', '<p class="related-work">R</p>', '<div id="comments-on-method">R</div>', '<p class="header-theorem">R</p>'])
def test_parts_of_the_article_stay(part):
    assert text(BODY.format(part)) == "One.\n\nR\n\nTwo."


@pytest.mark.parametrize("part", ['<div class="related-posts">R</div>', '<div class="notices">R</div>', '<div class="x ad">R</div>', '<div class="ad-slot">R</div>', '<div class="commentList">R</div>', '<div role="complementary">R</div>', "<aside>R</aside>", "<form>R</form>", "<div hidden>R</div>", '<ul class="share-buttons"><li>R</ul>', '<div class=\'newsletter\' id="x">R</div>'])
def test_frame_parts_in_the_article_go(part):
    assert text(BODY.format(part)) == "One.\n\nTwo."


@pytest.mark.parametrize("part", ['<div id="footer-links">R</div>', '<div class="notices">R</div>', '<div class="main-menu">R</div>'])
def test_frame_parts_beside_go_by_any_word(part):
    assert text(part + "<p>One.</p>") == "One."
