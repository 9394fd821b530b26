"""Hand-written pages: wrappers of common site builders, remarks of readers, boilerplate by names, deep markup."""

import time

import pytest

from loomcast.llm import pages

ONE = "The council met on Tuesday, as planned, and voted on the new bridge, which will cross the river north of the mill."
TWO = "Work begins in spring, said the engineer, and should take two years, if floods, frost and funds allow it."
THREE = "Some residents, mostly from the west bank, asked for a ferry instead, but the vote was clear, nine to two."
STORY = f"<p>{ONE}</p><p>{TWO}</p><p>{THREE}</p>"
TEXT = f"{ONE}\n{TWO}\n{THREE}"
REMARK = "I walked there last week, and the path was closed, sadly."

WRAPPERS = [
    '<div id="page" class="site no-sidebar">{}</div>',
    '<div class="content header-fixed">{}</div>',
    '<div class="post no-comments">{}</div>',
    '<div class="layout sidebar-right"><div class="main-column">{}</div><div class="sidebar"><p>Most read, this week, by all.</p></div></div>',
    '<div id="wrapper" class="hfeed site has-header-image has-sidebar">{}</div>',
    '<div class="elementor-widget-wrap"><div class="elementor-widget elementor-widget-theme-post-content">{}</div></div>',
    '<article class="post-12 post type-post hentry category-news tag-bridge comments-open">{}</article>',
    '<div class="single-post with-navbar"><section class="section header-overlap">{}</section></div>',
    '<div class="search-result-page"><main class="article-body">{}</main></div>',
    '<div class="sqs-layout banner-hidden"><div class="entry-content">{}</div></div>',
    '<div class="widget">{}</div>',
    '<div data-x="1" class="articleAdFree">{}</div>',
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_wrappers_don_t_lose_the_article(wrapper):
    around = '<body class="home has-sidebar no-comments"><nav><a href="/">Home</a></nav><div class="site-header"><p>The Valley Courier, since 1890.</p></div>{}<div class="site-footer"><p>All rights, as ever, reserved.</p></div></body>'
    assert pages.main_text(around.format(wrapper.format(STORY))) == TEXT


@pytest.mark.parametrize("remarks", [
    f'<article class="comment"><p>{REMARK}</p></article>',
    f'<section id="comments"><h2>Three comments</h2><article class="comment"><p>{REMARK}</p></article><article class="comment odd"><p>{REMARK}</p></article></section>',
    f'<ol class="comment-list"><li class="comment byuser"><div class="comment-body"><p>{REMARK}</p></div></li></ol>',
    f'<div class="post-comments"><p>{REMARK}</p><p>{REMARK}</p><p>{REMARK}</p><p>{REMARK}</p><p>{REMARK}</p></div>',
    f'<div id="disqus_thread"><div class="reply"><p>{REMARK}</p></div></div>',
    f'<div id="respond" class="comment-respond"><p>{REMARK}</p></div>',
])
@pytest.mark.parametrize("around", ["<div>{}{}</div>", "<article>{}{}</article>", "<main><div class='entry'>{}</div>{}</main>", "<article>{}</article>{}", "<body>{}{}"])
def test_remarks_go(remarks, around):
    assert pages.main_text(around.format(STORY, remarks)) == TEXT


def test_an_article_within_the_article_is_a_remark():
    assert pages.main_text(f"<article>{STORY}<article><p>{REMARK}</p></article></article>") == TEXT


def test_remarks_longer_than_the_article_go():
    assert pages.main_text(f'<div class="story"><p>{ONE}</p></div><div class="comments">' + f"<p>{REMARK} {TWO}</p>" * 5 + "</div>") == ONE


@pytest.mark.parametrize("extra", [
    '<div class="ad">Buy, now, cheap, today, only.</div>', '<div class="ads-slot top">Buy, now, cheap.</div>', '<div id="cookieConsent"><p>We use cookies, as others do, to serve you.</p></div>',
    '<div class="share-bar"><a href="x">Share</a> this, please.</div>', '<div class="related-posts"><p>Read, also, about the mill, the weir and the fish.</p></div>', '<div role="complementary"><p>Weather, today: rain, wind.</p></div>',
    '<div class="newsletter-signup"><p>Get our letter, every day, for free.</p></div>', '<div style="display:none"><p>Not, ever, shown.</p></div>', '<p class="copyright">Copyright, the Courier, all rights reserved.</p>',
])
@pytest.mark.parametrize("around", ["<article>{1}{0}</article>", "<div class='page'><div class='entry-content'>{0}{1}</div></div>", "<body>{1}<article>{0}</article>"])
def test_boilerplate_goes(extra, around):
    assert pages.main_text(around.format(STORY, extra)) == TEXT


@pytest.mark.parametrize(("source", "text"), [
    ("<b>" * 20_000 + "<div></div>" * 20_000, ""), ("<span>" * 20_000 + "<p>text, a</p>" * 3_000, "\n".join(["text, a"] * 3_000)), ("<x-y>" * 20_000 + "<hr>" * 20_000, ""),
    ("<p><td>" + "<x-y>" * 20_000 + "<hr>" * 20_000, ""), ("<b>" * 20_000 + "</i>" * 20_000 + "<div>z</div></b>" * 20_000, None), ("<ul><li>" * 20_000 + "end", "end"), ("<div class='a ad-b'>" * 20_000 + "deep", "deep"),
])
def test_deep_markup_takes_linear_time(source, text):
    began = time.process_time()
    got = pages.main_text(source)
    assert time.process_time() - began < 2
    assert text is None or got == text
