"""Labelled pages on which the extraction model is trained.

The pages are made from the layouts below with drawn filler words.  In a layout
``[+`` opens an element that is (or holds) main content and ``[-`` one that is
boilerplate through and through; ``]`` closes it, ``{t}`` is a sentence, ``{l}``
a few linked words, ``{w}`` two words, ``{p}`` a run of content paragraphs.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

#: Page parts by (sign, tag, attributes, content).
_NAVS = [
    '[-nav|[-ul|[-li|{l}][-li|{l}][-li|{l}][-li|{l}]]]',
    '[-div class="menu"|[-ul class="nav"|[-li|{l}][-li|{l}][-li|{l}]]]',
    '[-div id="navigation"|{l} {l} {l} {l}]',
    '[-nav class="breadcrumb"|{l} {l} {w}]',
]
_HEADERS = ['[-header|[-div class="logo"|{w}][-p|{w}]]', '[-header class="site-header"|[-h1|{l}]{nav}]', '[-div id="header"|[-h2|{l}][-p class="tagline"|{w}]]', ""]
_ADS = ['[-div class="ad"|{t}]', '[-div class="advert"|[-p|{t}]]', '[-div class="advert banner"|[-p|{t}]{l}]', '[-aside class="promo sponsored"|{t}]', '[-div id="ads"|{l}]', ""]
_NOTICES = ['[-div class="cookie-notice"|[-p|{t}][-button|{w}]]', '[-div class="notice alert"|{t}]', '[-div id="consent" role="dialog"|{t} {l}]', ""]
_SIDES = ['[-aside|[-h3|{w}][-ul|[-li|{l}][-li|{l}]]]', '[-div class="sidebar"|[-h3|{w}][-p|{t}][-ul|[-li|{l}]]]', '[-div id="sidebar" class="widget"|{t} {l}]', '[-div class="related"|[-h4|{w}][-ul|[-li|{l}][-li|{l}][-li|{l}]]]', ""]
_FORMS = ['[-form|[-label|{w}][-p|{w}]]', '[-form class="newsletter subscribe"|[-p|{t}]]', '[-form class="search"|[-div|{w}]]', ""]
_COMMENTS = [
    '[-section class="comments"|[-h3|{w}][-div class="comment"|[-p|{t}]][-div class="comment reply"|[-p|{t} {t}]]]',
    '[-div id="comments"|[-ol class="comment-list"|[-li|[-p|{t} {t}]][-li|[-p|{t}]]]]', '[-div class="reader-comments"|[-article class="comment"|[-p|{t}]]]', "",
]
_SHARES = ['[-div class="share social"|{l} {l}]', '[-ul class="tags meta"|[-li|{l}][-li|{l}]]', ""]
_FOOTERS = ["[-footer|{w} {t}]", '[-footer class="site-footer"|[-p|{w}]{l} {l}]', '[-div id="footer"|[-p class="copyright legal"|{w} {t}]]', ""]
_MAINS = [
    "[+article|[+h1|{t}]{p}{share}]", "[+main|[+article|[+h1|{t}]{p}]{comments}]", "[+article|[+header|[+h1|{t}]]{p}{ad}{p}]", "[+article class=\"post\"|[+h2|{t}]{p}{comments}]",
    '[+div class="content"|[+h1|{t}]{p}]', '[+div id="main"|[+div class="entry-content"|{p}{ad}{p}]{share}]', '[+div class="story-body text"|[+h2|{t}]{p}{form}]', "[+main|{p}]", '[+div id="content"|[+div class="post-body"|[+h2|{w}]{p}]{comments}]', "[+section|[+h2|{t}]{p}]", "[+div|[+h1|{t}]{p}]",
]
_RUNS = ["[+p|{t} {t} {t}][+p|{t} {t}]", "[+p|{t}][+p|{t} {t} {l} {t}][+ul|[+li|{t}][+li|{t}]]", "[+p|{w}][+blockquote|[+p|{t}]][+p|{t} {t} {t} {t}]", "[+h2|{w}][+p|{t} {t}][+pre|{t}]", "[+p|{t} {t}][+figure|[+figcaption|{t}]][+table|[+tr|[+td|{w}][+td|{t}]]]", "[+p|{w}.][+p|{t}]", "[+p|{t} {t}][+ul|[+li|{w}][+li|{w}]][+p|{t}]", "[+p|{t}][+dl|[+dt|{w}][+dd|{t}]][+div|{t} {t}]"]
_PARTS = {"nav": _NAVS, "ad": _ADS, "form": _FORMS, "comments": _COMMENTS, "share": _SHARES}
_WHOLE = "{header}{nav}{notice}{ad}{outer}{side}{comments}{form}{footer}"


def labelled_pages(n: int = 400, seed: int = 11) -> Iterator[str]:
    """HTML whose elements say in ``data-label`` whether they are content."""
    draw = random.Random(seed)
    letters = "etaoinshrdlu"
    word = lambda: "".join(draw.choice(letters) for _ in range(draw.randint(2, 8)))
    words = lambda a, b: " ".join(word() for _ in range(draw.randint(a, b)))

    def fill(layout: str) -> str:
        out, at = [], 0
        closing: list[str] = []
        while at < len(layout):
            c = layout[at]
            if c == "[":
                bar = layout.index("|", at)
                head = layout[at + 2 : bar]
                out.append(f'<{head} data-label="{int(layout[at + 1] == "+")}">')
                closing.append(f"</{head.split()[0]}>")
                at = bar + 1
            elif c == "]":
                out.append(closing.pop())
                at += 1
            elif c == "{":
                end = layout.index("}", at)
                name = layout[at + 1 : end]
                if name == "t":
                    out.append(words(4, 40).capitalize() + draw.choice(".,.?.  !"))
                elif name == "w":
                    out.append(words(1, 3))
                elif name == "l":
                    out.append(f'<a href="/{word()}">{words(1, 3)}</a>')
                elif name == "p":
                    out.append("".join(fill(draw.choice(_RUNS)) for _ in range(draw.randint(1, 4))))
                else:
                    out.append(fill(draw.choice(_PARTS[name])))
                at = end + 1
            else:
                out.append(c)
                at += 1
        return "".join(out)

    for _ in range(n):
        page = _WHOLE
        outer = draw.choice(["{main}", "{main}", '[+div class="wrapper"|{main}]', '[+div id="page"|[+div class="container"|{main}]{side}]'])
        for name, choices in (("outer", [outer]), ("main", _MAINS), ("header", _HEADERS), ("notice", _NOTICES), ("side", _SIDES), ("footer", _FOOTERS)):
            page = page.replace("{" + name + "}", draw.choice(choices))
        if draw.random() < 0.12:  # a fragment without a frame
            yield fill(draw.choice(["{p}", "{t}", "{w}", "{t} {t}", "{nav}{p}", "[+p|{w}]", "[+p|{t}][+p|{t}]", "[+h1|{t}]{p}"]))
            continue
        yield f'<html data-label="1"><body data-label="1">{fill(page)}</body></html>'
