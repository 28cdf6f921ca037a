"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read in one pass into leaf blocks: runs of text between block-level tags, each with its open ancestors.
Scripts, styles, comments and the like are no blocks; one that is never closed reaches to the end of the page, a
self-closed svg is empty, and custom elements (svg-icon, select-box) are tags like others. Features are ancestor tags,
words of their classes and ids, the block's own tag, its length, link share, closing punctuation and a few telling
words, and the place after the first heading. The field has two labels (article, rest) and is trained on the driver, by Adam on the exact likelihood
(forward-backward in numpy), on labelled pages laid out from a seed in many ways, with as many boxes inside articles as
around them and with pages that have no boxes or no tags; pages are decoded by Viterbi.

Nulls and edges: a null html is empty and gives an empty text; unclosed and stray tags are tolerated; text without
tags is an article; pages of any length are read whole; repeated rows give repeated results; no other text is left out.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strata.llm.common import picked, slices

#: The rest of a tag: a quote opens a value only right after an equals sign, elsewhere it is a character like others.
REST = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|object|select|textarea)(?=[\s/>])(?!(?<=svg){REST}(?<=/)>){REST}>.*?(?:</\1\s*+>|\Z)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({REST})(>|\Z)|<[!?/][^>]*+>?",
    re.DOTALL | re.IGNORECASE,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
PART = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html head title body p div ul ol li dl dt dd h1 h2 h3 h4 h5 h6 article section nav header footer aside main table thead tbody tfoot caption tr td th form fieldset legend label button option blockquote pre figure figcaption address details summary dialog hr center menu".split())
#: Tags whose start ends an open tag of the same kind, up to the container that bounds it.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
BOUNDS = frozenset("ul ol dl table article section div main aside nav header footer body blockquote form figure td li html".split())
#: Tags that say by themselves what they hold, as a name does.
BOXES = frozenset("nav header footer aside main article section form button".split())
TELLING = re.compile(r"©|\b(?:copyright|cookies?|subscribe|newsletter|comments?|repl(?:y|ies)|share|log ?in|sign (?:up|in)|advert\w*|sponsored|related|read more|privacy|rights reserved|posted by|says)\b", re.IGNORECASE)


def blocks(page: str | None) -> list[tuple[str, tuple[tuple[str, str], ...], float, bool]]:
    """(text, ancestors as (tag, names) from the root, share of characters in links, after a heading) of each leaf block with text."""
    page = page or ""
    out, stack, parts, linked, seen, links = [], [], [], 0, False, 0

    def close() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, tuple(stack), min(1.0, linked / len(text)), seen))
        parts, linked = [], 0

    def read(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if links:
                linked += len(raw.strip())

    def leave(i: int) -> None:
        nonlocal links
        links -= sum(t == "a" for t, _ in stack[i:])
        del stack[i:]

    at = 0
    for m in TOKEN.finditer(page):
        read(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            parts.append(" " if m[1] else "")
            continue
        if not m[5]:  # a tag that never ends is text
            read(m[0])
            continue
        if tag == "br" or tag == "svg" and not m[2]:  # an svg that comes here is self-closed: an empty element
            parts.append(" ")
        elif m[2]:
            if tag in BLOCK:
                close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    leave(i)
                    break
            seen = seen or tag == "h1"
        else:
            if tag in BLOCK:
                close()
                ends = CLOSES.get(tag, {"p"})
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ends:
                        leave(i)
                        break
                    if stack[i][0] in BOUNDS:
                        break
            if tag not in VOID and not m[4].endswith("/"):
                names = " ".join(a or b or c for a, b, c in NAMED.findall(m[4])).lower() if "=" in m[4] else ""
                stack.append((tag, names))
                links += tag == "a"
    read(page[at:])
    close()
    return out


def features(found) -> list[list[str]]:
    """The names of the features that hold for each block."""
    out = []
    for text, above, linked, seen in found:
        f = {f"in:{t}" for t, _ in above if t in BLOCK} | {f"name:{w}" for _, names in above if names for w in PART.findall(names)}
        own = next((t for t, _ in reversed(above) if t in BLOCK), "none")
        box = next(((t, names) for t, names in reversed(above) if t in BOXES or names), ("none", ""))
        f |= {f"box:{box[0]}", *(f"near:{w}" for w in PART.findall(box[1]))}
        f |= {f"own:{own}", f"size:{min(6, len(text).bit_length() // 2)}", f"links:{int(linked * 4)}", f"ends:{text[-1] in '.!?…»”'}", f"seen:{seen}", "bias"}
        f |= {f"says:{w[0].lower()}" for w in TELLING.finditer(text)} if len(text) < 400 else set()
        out.append(sorted(f))
    return out


class Field:
    """Weights of the field: emission scores by feature and label (0 rest, 1 article), transitions, start."""

    def __init__(self, names: list[str]):
        self.at = {n: i for i, n in enumerate(names)}
        self.w, self.t, self.s = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)

    def emissions(self, feats: list[list[str]]) -> np.ndarray:
        return np.array([self.w[[self.at[n] for n in f if n in self.at]].sum(axis=0) for f in feats]).reshape(-1, 2)

    def viterbi(self, e: np.ndarray) -> list[int]:
        if not len(e):
            return []
        (a, b), (t00, t01), (t10, t11) = (self.s + e[0]).tolist(), self.t[0].tolist(), self.t[1].tolist()
        back = []
        for x, y in e[1:].tolist():
            p, q = b + t10 > a + t00, b + t11 > a + t01
            a, b = (b + t10 if p else a + t00) + x, (b + t11 if q else a + t01) + y
            back.append((int(p), int(q)))
        path = [int(b > a)]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]

    def expected(self, e: np.ndarray):
        """Log partition, label marginals and expected transitions of one page."""
        n = len(e)
        add = lambda m: np.logaddexp(m[0], m[1])
        f, b = np.zeros((n, 2)), np.zeros((n, 2))
        f[0] = self.s + e[0]
        for i in range(1, n):
            f[i] = add(f[i - 1][:, None] + self.t) + e[i]
        for i in range(n - 2, -1, -1):
            b[i] = add((self.t + e[i + 1] + b[i + 1]).T)
        z = add(f[-1])
        pair = np.exp(f[:-1, :, None] + self.t + (e + b)[1:, None, :] - z).sum(axis=0) if n > 1 else np.zeros((2, 2))
        return z, np.exp(f + b - z), pair

    def fit(self, pages, epochs: int = 6, rate: float = 0.08, decay: float = 3e-4) -> None:
        """Adam on the likelihood of labelled pages [(features, labels)], a page a step."""
        m = [np.zeros_like(x) for x in (self.w, self.t, self.s)]
        v = [np.zeros_like(x) for x in m]
        step = 0
        for k in range(epochs):
            for feats, labels in pages:
                step += 1
                ids = [[self.at[n] for n in f if n in self.at] for f in feats]
                e = np.array([self.w[i].sum(axis=0) for i in ids])
                _, p, pair = self.expected(e)
                hot = np.eye(2)[labels]
                g = [decay * self.w, pair.copy(), p[0] - hot[0]]
                for i, d in zip(ids, p - hot):
                    g[0][i] += d
                for a, b in zip(labels, labels[1:]):
                    g[1][a, b] -= 1
                for x, gx, mx, vx in zip((self.w, self.t, self.s), g, m, v):
                    mx *= 0.9
                    mx += 0.1 * gx
                    vx *= 0.999
                    vx += 0.001 * gx * gx
                    x -= rate / (1 + k) * (mx / (1 - 0.9**step)) / (np.sqrt(vx / (1 - 0.999**step)) + 1e-8)


class Layouts:
    """Labelled pages laid out at random: an article among the boxes that pages have, which stand around it and in it.

    Boxes are named by their kind, by a word beside it, or not at all; the article stands in an element of its own, in a
    named or unnamed box, in the body or in nothing.
    """

    # Words that sites name boxes by.
    NAMES = {
        "nav": "nav menu navbar navigation breadcrumb breadcrumbs main-nav topnav toc-links pagination pager".split(),
        "header": "header site-header masthead topbar page-header branding logo".split(),
        "ad": "ad ads advert advertisement ad-slot adsbox banner sponsored sponsor promo promoted promotion dfp partner-content".split(),
        "side": "sidebar side widget rail secondary right-column aside-box".split(),
        "related": "related related-posts recommended recommendations more-stories see-also also-like read-next trending popular most-read recirc".split(),
        "notice": "notice cookie-banner cookie alert cookies consent gdpr popup modal overlay toast disclaimer announcement paywall breaking".split(),
        "form": "newsletter signup sign-up subscribe subscription login search mailing-list optin contact-form poll survey".split(),
        "share": "share social share-buttons social-links tags tag-list follow follow-us toolbar".split(),
        "comments": "comments comment-list commentlist reader-comments discussion responses replies disqus comment-section feedback".split(),
        "footer": "footer site-footer bottom copyright legal page-footer colophon".split(),
    }
    SAYS = {
        "ad": ("Advertisement", "Sponsored", "Promoted", "Advert"),
        "related": ("Related", "Read more", "You may also like", "More stories", "Trending", "Most read"),
        "notice": ("We use cookies.", "Cookie notice:", "Notice:", "This site uses cookies.", "Important:"),
        "form": ("Subscribe", "Sign up", "Newsletter", "Log in", "Join us"),
        "share": ("Share", "Follow us", "Tags"),
        "comments": ("Comments", "Discussion", "Replies", "Leave a reply"),
        "side": ("About", "Archive", "Popular"),
    }
    BOXES = ("div", "div", "div", "section", "aside")
    CONTAINERS = (
        "article", "article", "article", "article", "main", 'div class="content"', 'div id="content"', 'div class="post"', 'div class="entry-content"',
        'div class="article-body"', 'section class="story"', 'div id="main"', 'div class="text"', "div", "section", 'div class="wrap"', "", "",
    )
    SYLLABLES = ("th", "en", "er", "on", "re", "st", "an", "ou", "le", "ch", "ung", "ción", "ment", "é")
    #: Words that junk says often and articles may say too.
    ALSO = ("comments", "subscribe", "cookies", "share", "related", "newsletter", "privacy", "says", "advertisement", "read more")

    def __init__(self, seed: int):
        self.r, self.main = random.Random(seed), []

    def word(self) -> str:
        return "".join(self.r.choice(self.SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def say(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def sentence(self, a: int = 6, b: int = 30) -> str:
        return self.say(a, b).capitalize() + self.r.choice((".", ".", ".", ".", "!", "?", "", ",", " |"))

    def items(self, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{self.word()}">{self.say(1, 3)}</a></{tag}>' for _ in range(self.r.randint(1, 8)))

    def keep(self, text: str) -> str:
        if self.r.random() < 0.06:
            text += " " + self.r.choice(self.ALSO)
        self.main.append(text)
        return text

    def inside(self, kind: str) -> str:
        """What a box of a kind holds."""
        r = self.r
        title = r.choice(self.SAYS.get(kind, ("",))) if r.random() < 0.5 else ""
        heading = f"<{h}>{title or self.say(1, 4)}</{h}>" if (h := r.choice(("", "", "h2", "h3", "h4", "p", "b", "strong"))) else title + " " * bool(title)
        prose = f"<p>{self.sentence(5, r.choice((12, 40, 90)))}</p>" if r.random() < 0.7 else self.sentence(5, 40)
        if kind in ("nav", "share"):
            return r.choice((f"<ul>{self.items()}</ul>", self.items("span"), self.items("b"), heading + self.items("span")))
        if kind in ("related", "side"):
            return heading + r.choice((prose, f"<ul>{self.items()}</ul>", prose + f"<ul>{self.items()}</ul>", self.items("p")))
        if kind == "form":
            form = f'<input name="q"><button>{r.choice(("Subscribe", "Send", self.say(1, 2)))}</button>'
            return r.choice((heading + prose, heading + prose + form, f'<form action="/s"><label>{self.say(1, 3)}</label>{form}</form>', f"{heading}<form>{prose}{form}</form>"))
        if kind == "comments":
            one = lambda: r.choice(('<div class="comment"><b>{0}</b><p>{1}</p></div>', "<li><p>{1}</p></li>", "<p>{0}: {1}</p>", "<div>{0} says: {1}</div>", "<p>{1}</p>")).format(self.word(), self.sentence(4, 60))
            return heading + "".join(one() for _ in range(r.randint(1, 5)))
        if kind == "footer":
            return r.choice((f"&copy; {self.word()}.example &middot; {self.sentence()}", f"<p>&copy; 20{r.randint(10, 29)} {self.say(1, 4)}</p><ul>{self.items()}</ul>", f"<p>{self.sentence()}</p><ul>{self.items()}</ul>", f"<p>{self.sentence()}</p>"))
        if kind == "header":
            return r.choice((f"<h2>{self.say(1, 4)}</h2><p>{self.sentence(2, 8)}</p>", f'{self.say(2, 6)} <a href="/">{self.say(1, 2)}</a>', f"<h1>{self.say(1, 3)}</h1>"))
        return r.choice((prose, heading + prose, heading + prose + f"<button>{self.say(1, 2)}</button>", self.sentence()))

    def box(self, kind: str) -> str:
        """A box of a kind, by its own element or by a name, alone or among others."""
        r, own = self.r, {"nav": "nav", "header": "header", "footer": "footer", "side": "aside"}
        if kind in own and r.random() < 0.5:
            return f"<{own[kind]}>{self.inside(kind)}</{own[kind]}>"
        name = r.choice(self.NAMES[kind])
        if r.random() < 0.25:
            name = r.choice((f"{name}-{self.word()}", f"{self.word()}-{name}", f"{name} {self.word()}", f"box {name}", f"{name}-box", f"widget {name}"))
        tag, body = r.choice(self.BOXES), self.inside(kind)
        if kind in ("comments", "nav", "share", "related") and r.random() < 0.2:
            tag, item = r.choice((("ul", "li"), ("ol", "li"), ("dl", "dd")))
            body = "".join(f"<{item}>{self.sentence(2, 30)}</{item}>" for _ in range(r.randint(1, 4)))
        if kind == "form" and r.random() < 0.3:
            tag = "form"
            if r.random() < 0.6:
                return f'<form action="/{self.word()}">{body}</form>'
        if r.random() < 0.2:
            body = f"<div>{body}</div>"
        return f'<{tag} {r.choice(("class", "class", "id"))}="{name}">{body}</{tag}>'

    def part(self) -> str:
        """A part of an article."""
        r, x = self.r, self.r.random()
        if x < 0.66:
            text = self.keep(self.sentence(1, 2) if r.random() < 0.2 else self.sentence(3, 90 if r.random() < 0.85 else 400))
            return f"<p>{text}" + ("</p>" if r.random() < 0.85 else "")
        if x < 0.76:
            level = r.randint(2, 4)
            return f"<h{level}>{self.keep(self.say(2, 8))}</h{level}>"
        if x < 0.82:
            return "<ul>" + "".join(f"<li>{self.keep(self.sentence(2, 14))}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if x < 0.86:
            return f"<blockquote>{self.keep(self.sentence())}</blockquote>"
        if x < 0.89:
            return f"<p><b>{self.keep(self.sentence(1, 30))}<br>"
        if x < 0.92:
            return f"<table><tr><td>{self.keep(self.say(1, 5))}</td><td>{self.keep(self.say(1, 5))}</td></tr></table>"
        if x < 0.94:
            return f'<figure><img src="x.png"><figcaption>{self.keep(self.sentence(3, 15))}</figcaption></figure>'
        return f"<div>{self.keep(self.sentence(3, 60))}</div>"

    def page(self) -> tuple[str, list[str]]:
        """(html, texts of the article's blocks in order)."""
        r, self.main = self.r, []
        if r.random() < 0.03:  # text alone
            return self.keep(self.sentence(2, 60)), self.main
        body = ""
        if r.random() < 0.75:
            level = 1 if r.random() < 0.88 else 2
            body = f"<h{level}>{self.keep(self.say(2, 10))}</h{level}>"
        boxes = r.choice((0.0, 0.15, 0.4))
        for _ in range(r.randint(1, 12)):
            if r.random() < boxes:
                body += self.box(r.choice(tuple(self.NAMES)))
            body += self.part()
        container = r.choice(self.CONTAINERS)
        if container:
            body = f"<{container}>{body}</{container.split()[0]}>"
            if r.random() < 0.2:
                body = f"<main>{body}</main>"
        if r.random() < 0.15:  # a bare page
            return r.choice(("", "<html><body>")) + body, self.main
        top = [self.box(k) for k in ("nav", "header", "ad", "notice", "form", "side") if r.random() < (0.8 if k == "nav" else 0.4)]
        end = [self.box(k) for k in ("related", "side", "ad", "share", "comments", "form", "nav", "footer", "notice") if r.random() < (0.9 if k == "footer" else 0.35)]
        name = f"<title>{self.say(2, 8)}</title>" if r.random() < 0.8 else ""
        head = f"{name}<style>p{{margin:0}}</style><script>x('</p>')</script>"
        return f"<!DOCTYPE html><html><head>{head}</head><body>{''.join(top)}{body}{''.join(end)}</body></html>", self.main


def labelled_pages(n: int = 1500, seed: int = 9) -> list[tuple[str, list[str]]]:
    """(html, texts of the article's blocks in order) of pages laid out from a seed."""
    made = Layouts(seed)
    return [made.page() for _ in range(n)]


def labels(found, main: list[str]) -> list[int]:
    """1 for each block whose text is the next of the article's."""
    out, k = [], 0
    for text, *_ in found:
        hit = k < len(main) and text == " ".join(html.unescape(main[k]).split())
        k += hit
        out.append(int(hit))
    return out


_FIELD: list[Field] = []


def field() -> Field:
    """The field, trained once a process."""
    if not _FIELD:
        pages = []
        for page, main in labelled_pages():
            found = blocks(page)
            pages.append((features(found), labels(found, main)))
        f = Field(sorted({n for feats, _ in pages for x in feats for n in x}))
        f.fit(pages)
        _FIELD.append(f)
    return _FIELD[0]


def main_text(page: str | None, f: Field) -> str:
    found = blocks(page)
    path = f.viterbi(f.emissions(features(found))) if found else []
    return " ".join([b[0] for b, y in zip(found, path) if y])


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each page."""
    rows, f = picked(pages, "page_id", "url", "html"), field()
    kinds = [rows.schema[n].dataType.simpleString() for n in ("page_id", "url")]

    def run(batches):
        for b in slices(batches):
            texts = [main_text(p, f) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
