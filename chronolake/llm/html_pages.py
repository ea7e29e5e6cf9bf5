"""Labelled pages for the block classifier, written for it.

A text block begins with ``+`` if it is content and with ``-`` if it is boilerplate; ``{n}`` stands for n words.
Every page is used with its content and its boilerplate at several lengths, and, where boilerplate can still be told,
once more as plain divisions: without class names and with no element that says what it is for.  There only words and
links, of a block and of its neighbours, can tell.
"""

from __future__ import annotations

import re

NAV = "<nav><ul><li><a>-{1}</a></li><li><a>-{2}</a></li><li><a>-{1}</a></li></ul></nav>"
FOOT = "<footer>-&copy; {3} <a>{1}</a> <a>{2}</a></footer>"

PAGES = (
    # news: navigation, article with lists, figures, quotes and inner links, adverts between paragraphs, related links
    f"<header><a>-{{2}}</a><div>-{{4}}</div></header>{NAV}<article><header><h1>+{{8}}</h1><p>+{{4}} <a>{{2}}</a></header><p>+{{45}}</p><p>+{{20}} <a>{{5}}</a> {{12}}</p><div class=ad>-{{9}}</div>"
    "<figure><img><figcaption>+{9}</figcaption></figure><h2>+{3}</h2><p>+{38}</p><blockquote>+{16}</blockquote><ul><li>+{5}</li><li>+{7} <a>{2}</a></li><li>+{2}</li></ul><p>+{30}</p>"
    f"<div class='share-buttons'>-{{1}} <a>{{1}}</a> <a>{{1}}</a></div></article><aside><h3>-{{2}}</h3><ul><li><a>-{{6}}</a></li><li><a>-{{7}}</a></li></ul><p>-{{22}}</p></aside>{FOOT}",
    # advert before the article, unclosed paragraphs with line breaks
    f"{NAV}<div class=ad>-{{12}}</div><article><h1>+{{9}}</h1><p><b>+{{30}}<br>+{{14}}<br><p>+{{11}}</p><p>+{{40}}<p>+{{2}}</p><p>+{{1}}</article><footer>-&copy; {{1}} &middot; {{14}}</footer>",
    f"{NAV}<div class=ad>-{{6}}</div><article><h1>+{{3}}</h1><p><b>+{{3}}<br></article><footer>-&copy; {{1}} &middot; {{9}}</footer>",
    f"{NAV}<article><p>+{{1}}</article>{FOOT}",
    # a blog made of divisions
    "<div id=header><h1><a>-{3}</a></h1><p>-{7}</p></div><div class=menu><a>-{1}</a> <a>{1}</a> <a>{2}</a></div><div id=content class=post><h2>+{6}</h2><p>+{50}</p><p>+{15} <a>{6}</a> {4}</p><p>+{28}</p></div>"
    "<div id=sidebar><h3>-{2}</h3><p>-{18}</p><ul><li><a>-{3}</a></li><li><a>-{4}</a></li></ul></div><div id=comments><h3>-{2}</h3><p>-{25}</p><p>-{40}</p></div><div id=footer>-{5} <a>{2}</a></div>",
    "<div class='layout with-sidebar'><div class=main><h1>+{6}</h1><p>+{44}</p><p>+{9}</p><p>+{31}</p></div><div class=sidebar><p>-{15}</p><a>-{3}</a></div></div>",
    "<div class='layout with-sidebar'><p>+{25}</p><p>+{12} <a>{4}</a></p></div><div class='site-footer'>-{6} <a>{3}</a></div>",
    "<body class='page has-sidebar ad-free'><div class='no-comments wide'><h1>+{4}</h1><p>+{33}</p><p>+{18}</p></div></body>",
    # class names that only hold a word of boilerplate
    f"{NAV}<article><div class='social-history'><p>+{{30}}</p><p>+{{22}}</p></div></article>{FOOT}",
    f"<article><h1>+{{5}}</h1><section class='cookie-recipes'><h2>+{{2}}</h2><p>+{{28}}</p><ul><li>+{{3}}</li><li>+{{4}}</li></ul></section><section class='search-engines'><p>+{{17}}</p></section></article>{FOOT}",
    "<div id=story class='alert-systems'><p>+{26}</p><p>+{13}</p></div>",
    # a page of one block
    "<p>+{1} <a>{2}</a> {1}</p>", "<p>+{12}</p>", "<div>+{20}</div>", "+{14}", "<body>+{30} <a>{3}</a> {9}</body>", "<h1>+{4}</h1><p>+{3} <a>{4}</a></p>", "<p>+{2} <a>{3}</a></p><p>+{20}</p>",
    # articles without paragraphs
    f"{NAV}<article><h1>+{{6}}</h1><div>+{{40}}</div><div>+{{12}}</div><div>+{{30}} <a>{{3}}</a></div><div>+{{4}}</div></article>{FOOT}",
    "<div class=menu><a>-{1}</a><a>-{2}</a></div><div class=text>+{50}<br>+{20}<br><br>+{33}</div><div class=footer>-{4}</div>",
    f"<article>+{{35}}<br>+{{10}}<br>+{{6}}</article>{FOOT}",
    # bare text that stands in the article itself
    f"{NAV}<article><p>+{{30}}</p>+{{7}}<p>+{{25}}</p>+{{3}} <a>{{2}}</a><h2>+{{3}}</h2>+{{12}}</article>{FOOT}",
    "<main><p>+{22}</p>+{9}<p>+{6}</p>+{4}<p>+{18}</p></main>",
    # adverts that no class name tells, bare in a small box between paragraphs
    f"{NAV}<article><h1>+{{5}}</h1><p>+{{40}}</p><div class='box-x'>-{{7}}</div><p>+{{35}}</p><p>+{{20}}</p></article>{FOOT}",
    "<article><p>+{30}</p><div class='c7'>-{4} <a>{3}</a></div><p>+{26}</p><p>+{8}</p></article>",
    "<article><p>+{60}</p><p>+{30}</p><div>-<a>{4}</a></div><p>+{9}</p></article>",
    "<main><h1>+{7}</h1><p>+{33}</p><div class='u-3'>-{10}</div><p>+{27}</p><section><h2>+{3}</h2><p>+{24}</p></section></main>",
    # old layouts of tables
    "<table><tr><td><a>-{1}</a></td><td><a>-{2}</a></td><td><a>-{1}</a></td></tr></table><table><tr><td>+{60}<br>+{25}</td></tr></table><table><tr><td>-{2} <a>{4}</a></td></tr></table>",
    f"{NAV}<article><h1>+{{4}}</h1><p>+{{20}}</p><table><tr><th>+{{1}}</th><th>+{{2}}</th></tr><tr><td>+{{1}}</td><td>+{{3}}</td></tr></table></article>{FOOT}",
    # forms, notices, dialogs
    f"{NAV}<article><h1>+{{6}}</h1><p>+{{42}}</p><form><label>-{{3}}</label><p>-{{12}}</p></form><p>+{{28}}</p></article><form class=login>-{{4}}</form>{FOOT}",
    "<div class='cookie-notice'><p>-{30} <a>{2}</a></p></div><main><h1>+{5}</h1><p>+{36}</p><p>+{14}</p></main><div role=dialog><p>-{18}</p></div>",
    "<div class=notice>-{16}</div><div class=content><h1>+{6}</h1><p>+{34}</p><p>+{22}</p></div><div class='newsletter-signup'><p>-{11}</p></div>",
    "<article><div class=notice><p>-{20}</p></div><p>+{50}</p><div class='paywall'>-{12}</div><p>+{16}</p><div class=promo><p>-{14} <a>{2}</a></p></div></article>",
    "<form id=page><div class=header>-{4}</div><article><h1>+{4}</h1><p>+{31}</p><p>+{12}</p></article><div class=footer>-{6}</div></form>",
    "<div hidden><p>-{25}</p></div><article><p>+{27}</p></article>",
    # readers' comments
    f"<article><h1>+{{6}}</h1><p>+{{30}}</p><p>+{{22}}</p><section id=comments><h2>-{{2}}</h2><article class=comment><p>-{{35}}</p></article><article class=comment><p>-{{12}}</p></article></section></article>{FOOT}",
    "<main><p>+{40}</p><p>+{20}</p></main><div class='comment-list'><div class=comment>-{30}</div><div class=reply><p>-{45}</p></div></div>",
    "<article><p>+{24}</p></article><section class=comments><p>-{60}</p><p>-{30}</p></section>",
    # documentation, encyclopedia, recipe, questions
    f"{NAV}<main><nav class=breadcrumb><a>-{{1}}</a> <a>{{1}}</a></nav><h1>+{{3}}</h1><p>+{{18}} <a>{{8}}</a></p><pre>+{{25}}</pre><ul><li>+{{2}} <a>{{3}}</a></li><li>+{{9}}</li></ul><p>+{{3}} <a>{{2}}</a></p></main>{FOOT}",
    "<div id=body><p>+{12} <a>{3}</a> {6} <a>{4}</a> {5} <a>{4}</a></p><ul><li><a>-{2}</a></li><li><a>-{3}</a></li><li><a>-{2}</a></li></ul><h2>+{2}</h2><p>+{20} <a>{2}</a> {11}</p><p>+{30}</p></div><div class=navbox><a>-{2}</a> <a>{3}</a></div>",
    f"<article><h1>+{{4}}</h1><ul><li>+{{2}}</li><li>+{{3}}</li><li>+{{2}}</li></ul><ol><li>+{{12}}</li><li>+{{20}}</li></ol><p>+{{10}}</p><p><a>+{{4}}</a></p></article>{FOOT}",
    f"{NAV}<div class=faq><dl><dt>+{{7}}</dt><dd>+{{25}}</dd><dt>+{{6}}</dt><dd>+{{18}} <a>{{2}}</a></dd></dl></div>{FOOT}",
    f"<article><h1>+{{5}}</h1><div><p>+{{30}}</p></div><div><p>+{{6}}</p></div><div class=wide><h2>+{{3}}</h2><p>+{{24}}</p></div><p><a>+{{6}}</a></p><p>+{{21}}</p><footer>-{{6}} <a>{{2}}</a></footer></article>{FOOT}",
    # long articles with small parts, references and link lists that belong to them
    f"{NAV}<article><div><p>+{{300}}</p><p>+{{120}}</p></div><section><h2>+{{2}}</h2><p>+{{6}}</p><ul><li><a>+{{3}}</a></li><li><a>+{{4}}</a> {{2}}</li></ul></section><div class=wide><p>+{{3}}</p></div><p>+{{1}}</p></article>{FOOT}",
    f"<main><section><p>+{{400}}</p></section><section><h2>+{{1}}</h2><p>+{{4}}</p></section><div><p>+{{9}}</p><p><a>+{{5}}</a></p></div><div><p>+{{12}}</p></div><div><ul><li>+{{1}}</li><li>+{{2}}</li></ul></div></main>{FOOT}",
    f"<article><h1>+{{5}}</h1><p>+{{250}}</p><table><tr><td>+{{2}}</td><td>+{{1}}</td></tr></table><figure><figcaption>+{{4}}</figcaption></figure><blockquote><p>+{{5}}</p></blockquote><section><p>+{{7}} <a>{{6}}</a></p></section></article><aside><ul><li><a>-{{4}}</a></li></ul></aside>{FOOT}",
    f"<div class=content><div><p>+{{150}}</p></div><div><p>+{{8}}</p></div><div><h2>+{{3}}</h2><p>+{{15}}</p></div><div><p>+{{90}}</p><p>+{{2}}</p></div></div>{FOOT}",
    f"<article><div>+{{200}}</div><div>+{{3}}</div><div>+{{60}}</div><div>+{{9}}</div><div>+{{1}}</div></article>{FOOT}",
    f"{NAV}<article><h1>+{{4}}</h1><p><a>+{{4}}</a></p><p>+{{8}}</p><p><a>+{{5}}</a></p><p>+{{26}}</p><ul><li><a>+{{2}}</a></li></ul><h2>+{{2}}</h2><div class='share-box'><a>-{{1}}</a> <a>{{1}}</a></div><p>+{{12}}</p><div><p>+{{15}}</p></div><div class=share><a>-{{1}}</a></div></article>{FOOT}",
    f"{NAV}<main><p>+{{6}}</p><div class=share><a>-{{1}}</a> <a>{{1}}</a></div><div><p>+{{5}}</p><p>+{{14}}</p></div><div class=share><a>-{{1}}</a></div><p>+{{9}}</p><aside><a>-{{3}}</a></aside><div><h2>+{{2}}</h2></div></main>{NAV}{FOOT}",
    f"<article><p>+{{60}}</p><div class='social-history'><h2>+{{4}}</h2><p>+{{12}}</p><p>+{{5}} <a>{{4}}</a></p><div class='share-prices'><p>+{{9}}</p><h2>+{{2}}</h2><p>+{{5}} <a>{{4}}</a></p></div></div><p>+{{30}}</p></article>{FOOT}",
    # nothing but links
    f"{NAV}<div><h2><a>-{{5}}</a></h2><h2><a>-{{6}}</a></h2><p><a>-{{2}}</a></p></div><ul><li><a>-{{4}}</a></li><li><a>-{{5}}</a></li></ul>{FOOT}",
    "<div class=top><a>-{1}</a> | <a>{1}</a> | <a>{2}</a></div><div class=text><h1>+{5}</h1><p>+{28}</p><p>+{19}</p><div class=related><p><a>-{5}</a></p><p><a>-{6}</a></p></div></div>",
    "<div><a>-{1}</a></div><div><p>+{40}</p><p>+{11}</p></div><div><a>-{1}</a> <a>{2}</a> <a>{1}</a></div>",
)


TOLD = re.compile("comment|hidden|role=|notice|promo|<form")  # boilerplate that reads like content without its marks


def bare(page: str) -> str:
    """The page as plain divisions."""
    page = re.sub(r" (?:class|id)=(?:'[^']*'|[^\s>]*)", "", page)
    return re.sub(r"<(/?)(?:article|main|aside|header|footer|nav|section)\b", r"<\1div", page)


def filled(page: str, content: float, other: float) -> str:
    """The page with {n} filled in, content and boilerplate that many times as long (one or two words stay)."""
    done, rate = [], 1.0
    for part in re.split(r"([+-](?=[{&<])|\{\d+\})", page):
        if part in ("+", "-"):
            rate = content if part == "+" else other
        if re.fullmatch(r"\{\d+\}", part):
            n = int(part[1:-1])
            part = " ".join("word" + "s" * (i % 4) for i in range(n if n < 3 else max(1, round(n * rate))))
        done.append(part)
    return "".join(done)


def labelled() -> list[str]:
    out = [filled(p, *r) for p in PAGES for r in ((1.0, 1.0), (0.3, 1.0), (3.0, 1.0), (1.0, 3.0), (0.5, 2.0))]
    return out + [filled(bare(p), *r) for p in PAGES if not TOLD.search(p) for r in ((1.0, 1.0), (2.5, 1.0), (1.0, 1.6))]
