"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A leaf block is a run of text and inline elements between two boundaries of
block elements. Its features are its tag, the kinds of its ancestors (from
their tags, classes, ids and roles) and its text (length, share in links,
sentence ends). Two labels, main and other, with transitions, are trained by
maximum likelihood and decoded by Viterbi.

No table here holds labelled pages, so the training pages are made from
templates whose every block has a known label; their number is PAGES.
"""
from __future__ import annotations

import html as html_lib
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Training pages, steps and strength of the penalty.
PAGES, STEPS, PENALTY = 500, 150, 1e-3
OTHER, MAIN = 0, 1

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup: it ends at their end tag or with the page.
RAW = frozenset("script style noscript title iframe textarea xmp noembed noframes".split())
#: Elements whose content is no text of the page, whatever markup it holds.
HIDDEN = frozenset("template object svg canvas audio video select datalist".split())
#: Start tags that end an open svg.
LEAVES_SVG = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Tags that end an open element of the same group.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}

KIND_OF_TAG = {
    "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "article": "article", "main": "main", "form": "form", "fieldset": "form",
    "button": "form", "dialog": "notice", "figure": "figure", "table": "table", "ul": "list", "ol": "list", "dl": "list", "blockquote": "quote", "pre": "quote", "section": "section", "address": "footer",
}
KIND_OF_NAME = {
    "nav": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc tabs topbar toolbar sitemap links".split(),
    "header": "header masthead branding logo banner hero".split(),
    "footer": "footer copyright colophon contentinfo legal bottom".split(),
    "aside": "sidebar aside secondary complementary widget widgets rail related recommended trending popular share sharing social tags".split(),
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion adsbygoogle dfp outbrain taboola commercial".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay dialog disclaimer warning message toast".split(),
    "form": "form search subscribe subscription signup newsletter login register contact".split(),
    "comment": "comment comments commentlist disqus discussion respond reply replies reader readers feedback reviews".split(),
    "content": "content article post entry story body text main maincontent page prose".split(),
}
NAME_KIND = {n: k for k, names in KIND_OF_NAME.items() for n in names}

# A comment may end at once (<!-->, <!--->), and at --!> as well.
_TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*+>)|<[!?/][^>]*+>", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"\shidden(?=[\s>=/])|display\s*:\s*none", re.I)


def kinds(tag: str, attributes: str) -> tuple[str, ...]:
    """What an element's tag and names say it is."""
    out = [KIND_OF_TAG[tag]] if tag in KIND_OF_TAG else []
    if "=" in attributes or "hidden" in attributes:
        for value in _NAMES.findall(attributes):
            out += [NAME_KIND[w] for w in map(str.lower, _WORD.findall(value)) if w in NAME_KIND]
        if _HIDDEN.search(attributes):
            out.append("hidden")
    # Of several, an unwanted kind tells more than content: "article-footer", "post-comments".
    return tuple(dict.fromkeys(sorted(out, key=lambda k: k in ("content", "article", "main", "section"), reverse=True)))


#: What a block's ancestors are: their kinds, and the last two of them that tell most, from outside in.
Path = tuple[frozenset[str], tuple[str, ...]]
_ROOT: Path = (frozenset(), ())


def below(path: Path, own: tuple[str, ...]) -> Path:
    """The path of what lies in an element of these kinds. As large for a deep page as for a flat one."""
    if not own:
        return path
    strong = [k for k in own if k not in ("list", "table", "section", "figure", "quote")]
    return path[0].union(own), (*path[1], *strong)[-2:]


def blocks(page: str) -> list[tuple[str, Path, str, int]]:
    """(tag, path of the ancestors, text, its characters in links) of the leaf blocks in order."""
    out: list[tuple[str, Path, str, int]] = []
    stack: list[tuple[str, Path, bool]] = [("body", _ROOT, False)]
    parts: list[str] = []
    links = linked = 0
    at = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                tag, path, _ = next(e for e in reversed(stack) if not e[2])
                out.append((tag, path, text, linked))
            parts.clear()
        linked = 0

    length = len(page)
    while at < length:
        m = _TAG.search(page, at)
        if not stack[-1][2]:
            text = page[at : m.start() if m else length]
            if text:
                parts.append(text)
                if links:
                    linked += len(text)
        if not m:
            break
        at = m.end()
        if m.group(2) is None:  # a comment or declaration
            continue
        end, tag = m.group(1), m.group(2).lower()
        if not end and tag in LEAVES_SVG and any(e[0] == "svg" for e in stack):
            del stack[next(i for i, e in enumerate(stack) if e[0] == "svg") :]
        if tag in RAW and not end:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if tag not in INLINE:
                flush()
            at = close.end() if close else length
        elif tag in HIDDEN:
            if not end:
                if not (tag == "svg" and m.group(3).rstrip(">").endswith("/")):
                    stack.append((tag, stack[-1][1], True))
            elif any(e[0] == tag for e in stack):
                del stack[len(stack) - 1 - next(i for i, e in enumerate(reversed(stack)) if e[0] == tag) :]
        elif stack[-1][2] and not end:
            if tag not in VOID and tag not in INLINE and not m.group(3).rstrip(">").endswith("/"):
                stack.append((tag, stack[-1][1], True))
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            links = 0 if end else 1
        elif tag in INLINE or (tag in VOID and tag != "hr"):
            continue
        elif end:
            flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    links = 0
                    break
        else:
            flush()
            if tag in ("html", "body", "hr"):
                continue
            closed = CLOSES.get(tag, ("p",))
            scope = _SCOPES.get(tag, ())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in scope or (stack[i][0] not in closed and not scope and stack[i][0] not in ("p",)):
                    break
                if stack[i][0] in closed:
                    del stack[i:]
                    break
            stack.append((tag, below(stack[-1][1], kinds(tag, m.group(3))), False))
    flush()
    return out


def context_features(tag: str, path: Path) -> list[str]:
    every, strong = path
    return [
        "any", f"tag {tag}", *(f"in {k}" for k in sorted(every)), f"near {strong[-1] if strong else 'none'}",
        f"pair {'>'.join(strong) if len(strong) > 1 else 'none'}", f"tag {tag} near {strong[-1] if strong else 'none'}",
    ]


def text_features(text: str, linked: int) -> list[str]:
    n = len(text)
    share = linked / n if n else 0
    size = next((s for s in (10, 25, 60, 120, 300) if n < s), 1000)
    out = [f"length {size}", f"links {'none' if not share else 'some' if share < 0.5 else 'most'}", f"end {text[-1] in '.!?:;…\"”»' }"]
    if text[0] in "©®" or text[:10].lower().startswith("copyright"):
        out.append("copyright")
    return out


class Model:
    """Weights of features (by label), of transitions and of the first label."""

    def __init__(self, weights: dict[str, tuple[float, float]], transitions, first):
        self.weights, self.transitions, self.first = weights, [list(map(float, r)) for r in transitions], list(map(float, first))
        self.contexts: dict[tuple, tuple[float, float]] = {}

    def _sum(self, features) -> tuple[float, float]:
        found = [self.weights[f] for f in features if f in self.weights]
        return sum(f[0] for f in found), sum(f[1] for f in found)

    def decode(self, page: list[tuple[str, Path, str, int]]) -> list[int]:
        """The most likely labels of a page's blocks."""
        (t00, t01), (t10, t11) = self.transitions
        back: list[tuple[int, int]] = []
        a, b = self.first
        for k, (tag, path, text, linked) in enumerate(page):
            context = self.contexts.get((tag, path))
            if context is None:
                if len(self.contexts) > 100_000:
                    self.contexts.clear()
                context = self.contexts[tag, path] = self._sum(context_features(tag, path))
            x, y = self._sum(text_features(text, linked))
            if k:
                to0, to1 = (a + t00, b + t10), (a + t01, b + t11)
                back.append((to0[1] > to0[0], to1[1] > to1[0]))
                a, b = max(to0), max(to1)
            a, b = a + context[0] + x, b + context[1] + y
        labels = [int(b > a)] if page else []
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]


def train(pages: list[tuple[list, list[int]]]) -> Model:
    """A model from (blocks, labels) of pages, by accelerated gradient on the penalised likelihood."""
    names: dict[str, int] = {}
    rows, of, labels = [], [], []
    longest = max(len(b) for b, _ in pages)
    for p, (page, gold) in enumerate(pages):
        for t, ((tag, path, text, linked), label) in enumerate(zip(page, gold)):
            ids = [names.setdefault(f, len(names)) for f in (*context_features(tag, path), *text_features(text, linked))]
            rows += ids
            of += [p * longest + t] * len(ids)
            labels.append((p, t, label))
    rows, of = np.array(rows), np.array(of)
    p, t, y = (np.array(c) for c in zip(*labels))
    n = len(pages)
    size = np.array([len(b) for b, _ in pages])
    gold = np.zeros((n, longest, 2))
    gold[p, t, y] = 1
    real = np.zeros((n, longest), bool)
    real[p, t] = True

    def counts(q):  # of features by label, under label probabilities q
        return np.stack([np.bincount(rows, q[:, :, c].ravel()[of], len(names)) for c in (0, 1)], 1)

    def pairs(q2):
        return q2.sum((0, 1))

    seen, both = counts(gold), pairs(gold[:, :-1, :, None] * gold[:, 1:, None, :])
    w, tr, st = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)
    v = [np.zeros_like(x) for x in (w, tr, st)]
    g2 = [np.full_like(x, 1e-6) for x in (w, tr, st)]
    for _ in range(STEPS):
        unary = np.zeros((n, longest, 2))
        for c in (0, 1):
            unary[:, :, c] = np.bincount(of, w[rows, c], n * longest).reshape(n, longest)
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = unary[:, 0] + st
        for k in range(1, longest):
            step = np.logaddexp.reduce(alpha[:, k - 1, :, None] + tr, axis=1) + unary[:, k]
            alpha[:, k] = np.where(real[:, k, None], step, alpha[:, k - 1])
        for k in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(tr + (unary[:, k + 1] + beta[:, k + 1])[:, None, :], axis=2)
            beta[:, k] = np.where(real[:, k + 1, None], step, 0)
        total = np.logaddexp.reduce(alpha[np.arange(n), size - 1], axis=1)
        q = np.exp(alpha + beta - total[:, None, None]) * real[:, :, None]
        q2 = np.exp(alpha[:, :-1, :, None] + tr + (unary[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]) * real[:, 1:, None, None]
        grads = ((seen - counts(q)) / n - PENALTY * w, (both - pairs(q2)) / n - PENALTY * tr, (gold[:, 0] - q[:, 0]).sum(0) / n)
        for x, g, m, s in zip((w, tr, st), grads, v, g2):
            m *= 0.9
            m += 0.1 * g
            s *= 0.99
            s += 0.01 * g * g
            x += 0.1 * m / np.sqrt(s)
    return Model({f: (float(w[i, 0]), float(w[i, 1])) for f, i in names.items()}, tr, st)


def labelled_pages(count: int = PAGES, seed: int = 7) -> list[tuple[list, list[int]]]:
    """Blocks and labels of pages made from templates. Texts carry their label as a mark, which is taken off again."""
    rng = random.Random(seed)
    pick = rng.choice
    word = lambda: "".join(pick("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    say = lambda mark, a, b, stop=".": f"{mark}{words(a, b).capitalize()}{stop}"
    M, O = "\ue000", "\ue001"  # noqa: E741
    link = lambda mark, a=1, b=3: f'<a href="/{word()}">{mark}{words(a, b)}</a>'
    named = lambda names: pick([f'class="{n}"' for n in names] + [f'id="{n}"' for n in names])
    items = lambda a, b: "".join(f"<li>{link(O)}</li>" for _ in range(rng.randint(a, b)))

    def prose(mark, a, b, tag="p", at=""):
        return "".join(f"<{tag}{at}>{say(mark, 2, 70)}</{tag}>" if rng.random() < 0.9 else f"<{tag}{at}>{say(mark, 3, 30)}<br>" for _ in range(rng.randint(a, b)))

    def nav():
        ul = f"<ul>{items(3, 9)}</ul>"
        return pick([f"<nav>{ul}</nav>", f"<div {named(['menu', 'nav', 'navbar', 'main-menu', 'top-nav'])}>{ul}</div>", f"<div {named(['breadcrumbs', 'pagination'])}>{link(O)} &gt; {link('')}</div>", f'<ul class="nav">{items(3, 8)}</ul>', f"<nav>{link(O)} {link('')} {link('')}</nav>"])

    def ad():
        names = ["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "advertisement"]
        return pick([f"<div {named(names)}>{say(O, 2, 25)}</div>", f"<aside {named(names)}><p>{say(O, 2, 25)}</p></aside>", f"<div {named(names)}><p>{say(O, 2, 20)}</p>{link(O)}</div>", f"<ins {named(['adsbygoogle'])}></ins><section {named(names)}>{say(O, 2, 15)}</section>"])

    def notice():
        names = ["notice", "cookie-notice", "cookie-banner", "consent", "alert", "gdpr-popup", "modal"]
        return pick([f"<div {named(names)}>{say(O, 4, 30)}</div>", f"<div {named(names)}><p>{say(O, 4, 30)}</p><button>{O}{word()}</button></div>", f'<div role="alert">{say(O, 4, 20)}</div>', f"<dialog><p>{say(O, 4, 20)}</p></dialog>"])

    def header():
        inner = pick([f"{O}{words(1, 4)}", f"<h1>{O}{words(1, 3)}</h1><p>{say(O, 3, 8)}</p>", f"<div class=\"logo\">{link(O)}</div>", f"<p>{say(O, 2, 12)}</p>"])
        return pick([f"<header>{inner}</header>", f"<header>{inner}{nav()}</header>", f"<div {named(['header', 'masthead', 'site-header'])}>{inner}</div>"])

    def footer():
        inner = pick([f"{O}&copy; {words(1, 3)} &middot; {say('', 3, 16)}", f"<p>{O}&copy; {words(1, 8)}</p>", f"<p>{say(O, 3, 20)}</p><ul>{items(2, 5)}</ul>", f"<p>{O}Copyright {words(2, 6)}</p>"])
        return pick([f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f"<div {named(['footer', 'site-footer', 'copyright'])}>{inner}</div>"])

    def sidebar():
        inner = pick([f"<h3>{O}{words(1, 4)}</h3><ul>{items(2, 6)}</ul>", prose(O, 1, 3), f"<h2>{O}{words(1, 3)}</h2>{prose(O, 1, 2)}", f"<ul>{''.join(f'<li>{say(O, 2, 12)}</li>' for _ in range(3))}</ul>"])
        names = ["sidebar", "widget", "related", "secondary", "right-rail", "share", "social", "trending"]
        return pick([f"<aside>{inner}</aside>", f"<aside {named(names)}>{inner}</aside>", f"<div {named(names)}>{inner}</div>"])

    def form():
        inner = pick([f"<label>{O}{words(1, 3)}</label><input><button>{O}{word()}</button>", f"<p>{say(O, 3, 20)}</p><input><button>{O}{word()}</button>", f"<h3>{O}{words(2, 5)}</h3><select><option>x</option></select>"])
        return pick([f"<form>{inner}</form>", f"<form action='/{word()}'>{inner}</form>", f"<div {named(['newsletter', 'search', 'subscribe', 'login'])}>{inner}</div>"])

    def comments():
        one = lambda: pick([f"<p>{say(O, 2, 60)}</p>", f"<div {named(['comment', 'reply'])}><b>{O}{word()}</b> {say('', 2, 50)}</div>", f"<div><p>{say(O, 3, 60)}</p></div>", f"<article class=\"comment\"><p>{say(O, 3, 60)}</p></article>"])
        inner = pick(["", f"<h2>{O}{words(1, 3)}</h2>", f"<h3>{O}{rng.randint(1, 99)} {word()}</h3>"]) + "".join(one() for _ in range(rng.randint(1, 5)))
        names = ["comments", "comment-list", "reader-comments", "discussion", "disqus_thread", "responses replies"]
        return pick([f"<section {named(names)}>{inner}</section>", f"<div {named(names)}>{inner}</div>", f"<ol {named(['commentlist', 'comments'])}>" + "".join(f"<li>{one()}</li>" for _ in range(rng.randint(1, 4))) + "</ol>"])

    def story(bare):
        parts = [pick([f"<h1>{say(M, 2, 12, '')}</h1>", f"<h1>{say(M, 2, 12, '')}</h1>", f"<header><h1>{say(M, 2, 12, '')}</h1></header>" if not bare else f"<h1>{say(M, 3, 9, '')}</h1>", ""])]
        if rng.random() < 0.3:
            parts.append(f"<p><b>{say(M, 5, 30)}<br>")
        for _ in range(rng.randint(1, 6)):
            parts.append(prose(M, 1, 3))
            r = rng.random()
            if r < 0.12:
                parts.append(f"<h2>{say(M, 1, 6, '')}</h2>")
            elif r < 0.2:
                parts.append(f"<ul>{''.join(f'<li>{say(M, 2, 14)}</li>' for _ in range(rng.randint(2, 5)))}</ul>")
            elif r < 0.26:
                parts.append(f"<blockquote><p>{say(M, 4, 30)}</p></blockquote>")
            elif r < 0.31:
                parts.append(f"<figure><img src='x'><figcaption>{say(M, 3, 14)}</figcaption></figure>")
            elif r < 0.35:
                parts.append(f"<table><tr><th>{M}{word()}</th><td>{M}{words(1, 4)}</td></tr><tr><td>{M}{word()}</td><td>{M}{rng.randint(1, 999)}</td></tr></table>")
            elif r < 0.4:
                parts.append(f"<p>{say(M, 4, 20, '')} {link('')} {say('', 3, 20)}</p>")
            elif r < 0.44:
                parts.append(f"<pre>{M}{words(3, 20)}</pre>")
            elif r < 0.58:
                parts.append(pick([ad, ad, form, sidebar, notice])())
        if rng.random() < 0.15:
            parts.append(comments())
        return "".join(parts)

    out = []
    for _ in range(count):
        kind = pick(["article", "article", "main", "both", "div", "div", "bare", "plain", "section", "loose"])
        inner = story(kind in ("bare", "plain"))
        content = ["content", "post", "entry-content", "story-body", "article-body", "main-content", "post-text", "page-content"]
        text = "<br><br>".join(say(M, 3, 60) for _ in range(rng.randint(1, 4)))
        loose = pick([text, f"<article>{text}</article>", f"<div {named(content)}>{text}</div>", f"<h1>{say(M, 2, 8, '')}</h1>{text}"])
        body = {"loose": loose, "article": f"<article>{inner}</article>", "main": f"<main>{inner}</main>", "both": f"<main><article>{inner}</article></main>", "div": f"<div {named(content)}>{inner}</div>", "bare": inner, "plain": f"<div>{inner}</div>", "section": f"<section {named(content)}>{inner}</section>"}[kind]
        before = [f() for f in (header, nav, notice, ad, form, sidebar) if rng.random() < 0.45]
        after = [f() for f in (ad, sidebar, comments, form, nav, notice) if rng.random() < 0.35]
        rng.shuffle(before)
        rng.shuffle(after)
        if rng.random() < 0.85:
            after.append(footer())
        page = f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{''.join(before)}<!-- {word()} -->{body}{''.join(after)}"
        found = [(tag, path, text, linked) for tag, path, text, linked in blocks(page)]
        labels = [MAIN if M in text else OTHER for *_, text, _ in found]
        clean = [(tag, path, text.replace(M, "").replace(O, ""), linked) for tag, path, text, linked in found]
        kept = [(b, y) for b, y in zip(clean, labels) if b[2]]
        if kept:
            out.append(([b for b, _ in kept], [y for _, y in kept]))
    return out


@lru_cache(1)
def default_model() -> Model:
    """The model of PAGES template pages, trained once a process."""
    return train(labelled_pages())


def main_text(page: str | None, model: Model) -> str:
    found = blocks(page or "")
    return " ".join(text for (*_, text, _), label in zip(found, model.decode(found)) if label == MAIN)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """pages (with a column html) without html, plus text and n_chars (code points).

    A null or empty page, and one without main blocks, has an empty text.
    Comments, scripts, styles and other elements that hold no text are
    skipped; a self-closed svg is empty and an open one ends where HTML ends it;
    memory grows with a page's length, not with its depth; character references are decoded; white space in a block becomes
    one space; blocks are joined in page order by one space.
    """
    from pyspark.sql import types as T

    model = default_model() if model is None else model
    keep = [c for c in pages.columns if c != "html"]
    html_at = pages.columns.index("html")

    def texts(batches):
        import pyarrow as pa

        for b in batches:
            out = [main_text(p, model) for p in b.column(html_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(c)) for c in keep), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], [*keep, "text", "n_chars"])

    return pages.mapInArrow(texts, T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def op10(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html")))
