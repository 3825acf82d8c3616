"""Main text of web pages: the maximum-scoring run of words and tags.

A page is a row of words, which score positive, and tags, which score negative. The weight of a tag
comes from pages that label their own main region (article, main, articleBody): the log odds of
seeing it inside against outside. One linear scan finds the best contiguous region; it is widened to
the element that encloses it, and the parts in it that are no text of the article are left out.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import blocks, quietly

# Fixed lists: HTML element names by role.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
INLINE = ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img")
CONTAINERS = ("html", "body", "article", "main", "section", "div", "td", "center", "table", "tbody", "tr", "blockquote")
SKIPPED = ("nav", "header", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "svg", "math", "canvas", "audio", "video", "object", "embed", "map", "head", "fieldset", "datalist")
SKIPPED_ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar")
SKIPPED_NAMES = ("ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promoted", "banner", "nav", "navbar", "navigation", "menu", "submenu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "sidebars", "aside", "widget", "comment", "comments", "disqus", "respond", "reply", "replies", "notice", "notices", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "related", "recommended", "copyright", "legal", "pagination", "pager", "toolbar", "search", "form", "hidden", "skip")
MAIN_NAMES = ("articlebody", "article-body")

_token = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.DOTALL)
_name = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_attribute = re.compile(r"""\s(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_raw_end = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}
_closes_p = frozenset("p div ul ol dl table section article aside header footer nav form h1 h2 h3 h4 h5 h6 pre blockquote hr main address figure fieldset details".split())
_void, _inline, _containers, _skipped = frozenset(VOID), frozenset(INLINE), frozenset(CONTAINERS), frozenset(SKIPPED)
_roles, _names, _mains = frozenset(SKIPPED_ROLES), frozenset(SKIPPED_NAMES), frozenset(MAIN_NAMES)

#: Weights where no page labels its main region.
PRIOR = {"word": 1.0, "p": -0.5, "br": -0.5, "a": -2.0, "li": -3.0, "ul": -3.0, "div": -4.0, "td": -2.0, "option": -4.0}
OTHER = -2.0


def attributes(tag: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").lower() for m in _attribute.finditer(tag)}


def is_boilerplate(name: str, tag: str) -> bool:
    """Elements that are no text of an article, by element, role or the words of class and id."""
    if name in _skipped:
        return True
    if " " not in tag and "\n" not in tag and "\t" not in tag:
        return False
    found = attributes(tag)
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    if found.get("role") in _roles:
        return True
    words = re.findall(r"[a-z]+", f"{found.get('class', '')} {found.get('id', '')}")
    return name not in ("body", "html", "article", "main") and not _names.isdisjoint(words)


def is_main(name: str, tag: str) -> bool:
    return name in ("article", "main") or (" " in tag and (found := attributes(tag)) and (found.get("role") == "main" or found.get("itemprop") in _mains or found.get("id") in _mains or found.get("class") in _mains))


def tokens(page: str):
    """(kind, name, source) in page order: kind t for text, o for an opening tag, c for a closing one.

    Comments, declarations and the inside of scripts, styles and the like are passed over.
    """
    at, n = 0, len(page)
    while at < n:
        m = _token.search(page, at)
        if not m:
            yield "t", "", page[at:]
            return
        if m.start() > at:
            yield "t", "", page[at : m.start()]
        at, tag = m.end(), m[0]
        if tag.startswith("<![CDATA["):
            yield "t", "", tag[9:].removesuffix("]]>").replace("&", "&amp;")
            continue
        if tag[1] in "!?":
            continue
        name = _name.match(tag)[1].lower()
        if tag[1] == "/":
            yield "c", name, tag
            continue
        if name in _raw_end:
            end = _raw_end[name].search(page, at)
            at = end.start() if end else n
            if end:
                close = page.find(">", at)
                at = close + 1 if close >= 0 else n
            yield "o", "br", "<br>"
            continue
        yield "o", name, tag


class Page:
    """Text pieces and tags that are left after boilerplate, with the enclosing container of each."""

    def __init__(self, page: str):
        self.items: list[tuple[str, str, int]] = []  # kind t / tag, text or name, container
        self.parent, self.kind, self.main = [-1], ["root"], [False]
        stack: list[tuple[str, int]] = []
        here, skip = 0, 0  # skip: depth in the stack from which boilerplate is left out
        for kind, name, source in tokens(page):
            if kind == "t":
                if not skip:
                    self.items.append(("t", source, here))
                continue
            if kind == "o":
                if name in _closes_p and stack and stack[-1][0] == "p":
                    stack.pop()
                if name == "li" and stack and stack[-1][0] == "li":
                    stack.pop()
                if skip > len(stack):
                    skip = 0
                if not skip and is_boilerplate(name, source):
                    self.items.append(("g", name, here))
                    if name not in _void and not source.endswith("/>"):
                        stack.append((name, here))
                        skip = len(stack)
                    continue
                if not skip:
                    self.items.append(("g", name, here))
                # Inline elements are not kept on the stack, but for those inside skipped ones of their name.
                if name in _void or source.endswith("/>") or (name in _inline and not (skip and stack[skip - 1][0] == name)):
                    continue
                stack.append((name, here))
                if not skip and name in _containers:
                    self.parent.append(here)
                    self.kind.append(name)
                    self.main.append(bool(is_main(name, source)))
                    here = len(self.parent) - 1
                continue
            if name in _void or (name in _inline and not (skip and stack[skip - 1][0] == name)):
                if not skip:
                    self.items.append(("g", name, here))
                continue
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is None:
                continue
            if skip and depth + 1 > skip:
                del stack[depth:]
                continue
            if not skip:
                self.items.append(("g", name, here))
            here = stack[depth][1]
            del stack[depth:]
            if skip > len(stack):
                skip = 0

    def path(self, node: int) -> list[int]:
        found = [node]
        while self.parent[node] >= 0:
            node = self.parent[node]
            found.append(node)
        return found

    def counts(self):
        """(token, words or tags inside, outside) the labelled main region; None if the page has none."""
        if not any(self.main):
            return None
        inside = [any(self.main[k] for k in self.path(node)) for node in range(len(self.parent))]
        found: dict[str, list[int]] = {}
        for kind, what, node in self.items:
            name, n = ("word", len(what.split())) if kind == "t" else (what, 1)
            if n:
                found.setdefault(name, [0, 0])[0 if inside[node] else 1] += n
        return found

    def text(self, weights: dict[str, float]) -> str:
        """The text of the best region, widened to the element around it."""
        word, other = weights.get("word", 1.0), weights.get("other", OTHER)
        best, start, total, first = (0.0, -1, -1), 0, 0.0, 0
        for k, (kind, what, _) in enumerate(self.items):
            total += word * len(what.split()) if kind == "t" else weights.get(what, other)
            if total <= 0:
                total, first = 0.0, k + 1
            elif total > best[0]:
                best, start = (total, first, k), first
        if best[1] < 0:
            return ""
        begin, end = start, best[2]
        held = [node for kind, what, node in self.items[begin : end + 1] if kind == "t" and what.strip()]
        common = set(self.path(held[0]))
        for node in set(held):
            common &= set(self.path(node))
        around = max(common, key=lambda node: len(self.path(node)))
        marked = next((node for node in self.path(around) if self.main[node]), None)
        if marked is None and self.kind[around] not in ("root", "html", "body"):
            marked = around
        if marked is not None:
            within = [marked in self.path(node) for node in range(len(self.parent))]
            items = [item for item in self.items if within[item[2]]]
        else:
            # No element encloses just the region: whole blocks on both sides that stand in the same
            # container as the region's words belong to it.
            same = {node for node in held}
            while begin > 0 and (self.items[begin - 1][2] in same):
                begin -= 1
            while end + 1 < len(self.items) and self.items[end + 1][2] in same:
                end += 1
            items = self.items[begin : end + 1]
        return " ".join(html.unescape("".join(what if kind == "t" else "" if what in _inline else " " for kind, what, _ in items)).split())


def fit_weights(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weights of words and tags from all pages that label their main region.

    One scan sums counts per token over the whole table; at most one row per HTML element name comes
    back (unknown names count as `other`). Without a labelled page the fixed PRIOR holds.
    """
    known = {*VOID, *INLINE, *CONTAINERS, *SKIPPED, *_closes_p, "li", "word"}

    def run(batches):
        total: dict[str, list[int]] = {}
        for part in quietly(blocks(batches, 0)):
            for page in part.column(0).to_pylist():
                if page:
                    for name, (a, b) in (Page(page).counts() or {}).items():
                        row = total.setdefault(name if name in known else "other", [0, 0])
                        row[0] += a
                        row[1] += b
        yield pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.string()), pa.array([a for a, _ in total.values()], type=pa.int64()), pa.array([b for _, b in total.values()], type=pa.int64())], ["token", "a", "b"])

    rows = pages.select(pages[html_col].alias("html")).mapInArrow(run, "token string, a long, b long").groupBy("token").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    counts = {r["token"]: (r["a"], r["b"]) for r in rows}
    if not counts.get("word", (0, 0))[0]:
        return {**PRIOR, "other": OTHER}
    inside, outside = (sum(c[k] for c in counts.values()) for k in (0, 1))
    odds = {t: math.log((a + 1) / (inside + 2)) - math.log((b + 1) / (outside + 2)) for t, (a, b) in counts.items()}
    # Words are positive and tags negative by definition of the method; the odds set how much.
    top = max(0.1, odds["word"])
    return {t: 1.0 if t == "word" else min(-0.1, (x - top) / top) for t, x in odds.items()} | ({} if "other" in odds else {"other": OTHER})


def main_text(pages: DataFrame, weights: dict[str, float] | None = None, keys: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """Rows (keys, text, n_chars): the main text of every page.

    White space inside a block becomes one space, blocks are joined by one space, in page order. A
    null or empty page, and one without words, has an empty text. Repeated rows come out repeatedly;
    other columns are not read.
    """
    weights = weights or fit_weights(pages, html_col)
    fields = [f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches):
        for part in quietly(blocks(batches, len(keys))):
            texts = [Page(page).text(weights) if page else "" for page in part.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(len(keys))], pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], [*keys, "text", "n_chars"])

    return pages.select(*[pages[k] for k in keys], pages[html_col].alias("html")).mapInArrow(run, ", ".join([*fields, "text string", "n_chars long"]))
