"""Labelled pages that train the decision tree of ``html_text``: layouts drawn from a rule.

Words of main text start with ``m``, of unspaced scripts with one of two characters; all
others start with ``x``.  A page has a layout (an article element, a content container, a
table, bare elements, or a frame whose class says something else) and pieces around and
between its paragraphs, marked by element, by class, or not at all.
"""

from __future__ import annotations

import random

#: Class names that mark what is beside the article, of which a page draws some.
BESIDE = ("sidebar", "ad", "advert", "cookie-notice", "newsletter", "related", "share", "comments", "site-footer", "promo", "breadcrumb", "widget", "site-header", "top-menu", "social")
CONTENT = ("content", "entry-content", "post", "main", "story-body", "article-text")
#: Frames that hold a whole article though their class says otherwise.
FRAMES = ("social science", "elementor-widget-text", "header-body", "widget", "sidebar-left", "banner")
PAGES, SEED = 400, 20240311


class _Page:
    def __init__(self, r: random.Random):
        self.r, self.script = r, r.choices(("latin", "\u6587", "\u0e01"), (8, 1, 1))[0]

    def words(self, n: int, mark: str) -> str:
        if mark == "m" and self.script != "latin":
            return self.script + "".join(self.r.choices("\u8a00\u5b57\u8a9e" if self.script == "\u6587" else "\u0e02\u0e04\u0e07", k=3 * n))
        return " ".join(mark + "".join(self.r.choices("abcdeilnorst", k=self.r.randint(1, 8))) for _ in range(n))

    def linked(self, n: int, mark: str = "x") -> str:
        return f"<a href=/{n}>{self.words(n, mark)}</a>"

    def menu(self) -> str:
        """A list of links: marked by its element or class, or bare."""
        r = self.r
        items = [f"<li>{self.linked(r.randint(1, 4))}</li>" for _ in range(r.randint(3, 9))]
        bare = f"<ul>{''.join(items)}</ul>"
        return r.choice([f"<nav>{bare}</nav>", f"<div class={r.choice(BESIDE)}>{bare}</div>", bare, bare, " ".join(f"<div>{self.linked(r.randint(1, 3))}</div>" for _ in items)])

    def junk(self) -> str:
        """Something beside the article that its element or class marks, long or short."""
        r, n = self.r, self.r.choice((3, 8, 15, 40, 70))
        inner = r.choice([f"<p>{self.words(n, 'x')}</p>", self.words(n, "x"), f"<h3>{self.words(2, 'x')}</h3><p>{self.words(n, 'x')}</p>", f"<p>{self.words(n, 'x')} {self.linked(2)}</p>"])
        name = r.choice(BESIDE)
        return r.choice([f"<aside>{inner}</aside>", f'<div class="{name}">{inner}</div>', f'<section id="{name}">{inner}</section>', f"<form>{inner}</form>"])

    def stray(self) -> str:
        """What nothing marks beside the article: labels and dates between links, teasers in a row, a notice among links."""
        r, kind = self.r, self.r.choice(("labels", "teasers", "links", "notice"))
        link = lambda: f"<div>{self.linked(r.randint(1, 6))}</div>"
        if kind == "labels":
            return link() + "".join(f"<div>{self.words(r.randint(1, 4), 'x')}</div>{link()}{link() if r.random() < 0.5 else ''}" for _ in range(r.randint(1, 4)))
        if kind == "teasers":
            return "".join(f"<div>{self.words(r.randint(6, 18), 'x')} {self.linked(r.randint(2, 5))}</div>" for _ in range(r.randint(3, 6)))
        if kind == "notice":
            return link() + f"<div>{self.words(r.randint(6, 16), 'x')}</div>" + link()
        return "".join(f"<p>{self.words(r.randint(1, 3), 'x')} {self.linked(r.randint(2, 5))}</p>" for _ in range(r.randint(2, 4)))

    def last(self) -> str:
        r = self.r
        text = f"x&copy; {self.words(r.randint(2, 12), 'x')}"
        return r.choice([f"<div>{self.linked(2)}</div><div>{text}</div>", f"<footer>{text}</footer>", f"<footer><p>{text} {self.linked(2)}</p></footer>", f"<div class=footer>{text}</div>", f'<div id="site-footer"><p>{text}</p></div>'])

    def body(self, between: list[str]) -> str:
        """Title, paragraphs long and short, subheadings, lists and quotes; pieces of ``between`` among them."""
        r = self.r
        out = [f"<h1{r.choice(['', ' class=page-header', ' class=title'])}>{self.words(r.randint(2, 9), 'm')}</h1>"]
        if r.random() < 0.5:
            out.append(f"<p>{self.words(r.randint(1, 6), 'm')}</p>")
        if r.random() < 0.15:
            out.clear()
        for _ in range(r.choice((1, 1, 2, 3, 4, 5, 6, 7))):
            n = r.choice((1, 4, 8, 14, 25, 40, 60, 90, 200)) if out else 50
            out.append(
                r.choices(
                    [
                        f"<p>{self.words(n, 'm')}</p>",
                        f"<h2>{self.words(r.randint(1, 5), 'm')}</h2><p>{self.words(max(n, 20), 'm')}</p>",
                        f"<ul>{''.join(f'<li>{self.words(r.randint(2, 9), chr(109))}</li>' for _ in range(r.randint(2, 5)))}</ul>",
                        f"<blockquote>{self.words(n, 'm')}</blockquote>",
                        f"<p>{self.words(max(n, 12), 'm')} {self.linked(3, 'm')} {self.words(3, 'm')}</p>",
                        f"<p>{self.words(30, 'm')}</p><p>{self.linked(r.randint(2, 6), 'm')}</p><p>{self.words(30, 'm')}</p>",
                    ],
                    (8, 2, 2, 1, 2, 1),
                )[0]
            )
            if between and r.random() < 0.3:
                out.append(r.choice(between))
        return "".join(out)

    def text(self) -> str:
        r = self.r
        before = [self.menu()] * (r.random() < 0.8) + [self.junk() for _ in range(r.randint(0, 2))] + [self.stray()] * (r.random() < 0.4)
        after = [self.junk() for _ in range(r.randint(0, 2))] + [self.stray()] * (r.random() < 0.5) + [self.menu()] * (r.random() < 0.3) + [self.last()] * (r.random() < 0.8)
        body = self.body([self.junk()] * (r.random() < 0.4))
        if r.random() < 0.25:
            before, after = [], after[:1] if r.random() < 0.3 else []
        layout = r.choices(("article", "main", "content", "bare", "table", "frame"), (5, 2, 4, 5, 1, 2))[0]
        if layout in ("article", "main"):
            body = f"<{layout}>{body}</{layout}>"
            after += [f"<div>{self.words(r.choice((4, 30)), 'x')}</div>"] * (r.random() < 0.3)  # unmarked, but outside of the article
        elif layout == "content":
            body = f'<div class="{r.choice(CONTENT)}">{body}</div>'
        elif layout == "table":
            body = f"<table><tr><td>{body}</td></tr></table>"
        elif layout == "frame":
            body, before, after = f'<div class="{r.choice(FRAMES)}">{body}<p>{self.words(80, chr(109))}</p></div>', before[:1], after[-1:]
        return f"<html><body>{''.join(before)}{body}{''.join(after)}</body></html>"


def labelled_pages(seed: int = SEED, n: int = PAGES) -> list[str]:
    """Pages of a seed; the pages of another seed are held out."""
    r = random.Random(seed)
    return [_Page(r).text() for _ in range(n)]
