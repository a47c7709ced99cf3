"""Main text of HTML pages by a tree-structured graphical model.

The block elements of a page are the nodes of a tree. Each node is content or not; its own features give a potential,
each parent-child pair another. Sum-product messages go up from the leaves and down from the root, and the product at
a node is its content marginal. Both potentials are counted on labelled pages, which a rule of this module makes
(TRAIN_PAGES of them, a fixed seed), so the fit has a fixed bound and needs no table.
"""

from __future__ import annotations

import html
import math
import random
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns

TRAIN_PAGES = 600
#: Weights of a node's own features that the fit chooses from.
SCALES = (0.1, 0.25, 0.5, 0.75, 1.0)
#: Elements that never close, whose text is never shown, and that break a line of text, by the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "title")
BLOCK = set("html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption button label option".split())
#: A start tag closes these open elements, up to the nearest of the limits.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
P_CLOSERS = BLOCK - {"html", "body", "button", "label", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "dd", "dt", "li"}
#: One attribute by the HTML standard: white space and slashes, a name, a value in quotes or up to white space; group 3
#: is a quote that never ends.
ATTR = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|(["'])|([^\s>]*)))?""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
#: Words in class, id, role or aria-label that name page furniture, by group.
FURNITURE = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs",
    "head": "header masthead banner topbar logo branding",
    "foot": "footer copyright legal bottom colophon",
    "side": "sidebar aside related recommended popular widget rail more",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion",
    "notice": "cookie cookies consent notice gdpr alert popup modal newsletter subscribe subscription signup paywall",
    "talk": "comment comments reply replies respond discussion disqus feedback reviews",
    "share": "share sharing social follow tags tag meta byline author",
    "form": "form search login field input",
    "main": "article content main post entry story body text page",
}
GROUP = {w: g for g, ws in FURNITURE.items() for w in ws.split()}
TAGS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "button": "form", "label": "form", "option": "form", "dialog": "dialog", "menu": "nav", "article": "article", "main": "main", "section": "section", "div": "div", "p": "p", "li": "li", "ul": "list", "ol": "list", "dl": "list", "dt": "li", "dd": "li", "table": "table", "tbody": "table", "thead": "table", "tfoot": "table", "tr": "table", "td": "cell", "th": "cell", "body": "root", "html": "root", "blockquote": "quote", "pre": "quote", "figure": "figure", "figcaption": "figure", "address": "address"} | {f"h{i}": "heading" for i in range(1, 7)}
#: Words beside which a furniture word still names furniture; beside any other word it is part of a title or a topic.
NEUTRAL = set("wrap wrapper box block list item items container inner outer area section widget group row col column left right top main site page global primary secondary js c u m l o is has sticky fixed small large".split())
_SPACE = re.compile(r"\s+")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")


class Page:
    """Block nodes of a page (parent, tag, features) and its text blocks in order (node, text)."""

    def __init__(self, source: str):
        self.parent, self.tag, self.groups, self.hidden, self.within = [-1], ["html"], [frozenset()], [False], [False]
        self.blocks: list[tuple[int, str]] = []
        self.words, self.linked = [0], [0]
        self._read(source)

    def _node(self, parent: int, tag: str, attrs: list[tuple[str, str]]) -> int:
        named, hidden = set(), self.hidden[parent]
        for k, v in attrs:
            if k in ("class", "id", "role", "aria-label"):
                for name in v.lower().split():
                    words = [w for w in _SPLIT.split(name) if w]
                    if all(w in GROUP or w in NEUTRAL or w.isdigit() for w in words):
                        named |= {g for w in words if (g := GROUP.get(w))}
            hidden |= k == "hidden" or k == "aria-hidden" and v.lower() == "true" or k == "style" and "display:none" in _SPACE.sub("", v.lower())
        self.parent.append(parent)
        self.tag.append(tag)
        self.groups.append(frozenset(named))
        self.hidden.append(hidden)
        self.within.append(self.within[parent] or self.tag[parent] in ("article", "main"))
        self.words.append(0)
        self.linked.append(0)
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        """One pass in linear time, with the standard's tokenizer; open elements are kept by tag, so no end tag searches the stack."""
        stack: list[tuple[str, int]] = [("html", 0)]  # open elements and the block node each stands in
        where: dict[str, list[int]] = {"html": [0]}  # places in the stack, by tag
        blocks = [0]  # places of the block elements
        text: list[str] = []
        at, end, endless = 0, len(source), set()

        def flush() -> None:
            if text:
                block = _SPACE.sub(" ", html.unescape("".join(text))).strip()
                text.clear()
                if block:
                    self.blocks.append((stack[-1][1], block))

        def close(k: int) -> None:
            if blocks[-1] >= k:
                flush()
            while len(stack) > k:
                where[stack.pop()[0]].pop()
            while blocks[-1] >= k:
                blocks.pop()

        def open_(tag: str, node: int) -> None:
            where.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
            stack.append((tag, node))

        def last(*tags: str) -> int:
            return max((where[t][-1] for t in tags if where.get(t)), default=-1)

        def add(piece: str) -> None:
            n = len(piece.split())
            node = stack[-1][1]
            self.words[node] += n
            if where.get("a"):
                self.linked[node] += n
            text.append(piece)

        while at < end:
            less = source.find("<", at)
            if less < 0:
                add(source[at:])
                break
            if less > at:
                add(source[at:less])
            closing = source.startswith("/", less + 1)
            named = NAME.match(source, less + 1 + closing)
            if not named:
                if source.startswith("<!--", less):
                    empty = source.startswith((">", "->"), less + 4)
                    stop = source.find(">" if empty else "-->", less + 4)
                    at = end if stop < 0 else stop + (1 if empty else 3)
                elif source.startswith(("<!", "<?", "</"), less):
                    at = source.find(">", less) + 1 or end
                else:
                    add("<")
                    at = less + 1
                continue
            at, attrs = named.end(), []
            while m := ATTR.match(source, at):
                at = end if m[4] else m.end()
                if not closing and m[1]:
                    attrs.append((m[1].lower(), m[2] or m[3] or m[5] or ""))
            slash = source[at - 1 : at] == "/"
            while at < end and source[at] != ">":
                slash = source[at] == "/"
                at += 1
            if at >= end:
                break  # the page ends within a tag, which the standard drops
            at += 1
            tag = named[0].lower()
            if closing:
                if tag == "br":
                    text.append(" ")
                elif tag != "html" and (k := last(tag)) > 0 and (tag in BLOCK or tag == "a" or k > blocks[-1]):
                    close(k)  # an inline end tag reaches no further than its block
                continue
            if tag in RAW:
                if tag == "svg" and slash or tag in endless:
                    continue
                stop = RAW_END[tag].search(source, at)
                if stop:
                    at = source.find(">", stop.end()) + 1 or end
                elif tag in ("svg", "title"):
                    endless.add(tag)
                else:
                    at = end
                continue
            if tag in VOID:
                text.append(" " if tag == "br" else "")
                if tag == "hr":
                    flush()
                continue
            if tag in P_CLOSERS and stack[blocks[-1]][0] == "p":
                close(blocks[-1])
            if tag in CLOSES and (k := last(*CLOSES[tag][0])) > last(*CLOSES[tag][1]):
                close(k)
            if tag in BLOCK:
                flush()
                open_(tag, 0 if tag == "html" else self._node(stack[-1][1], tag, attrs))
            elif tag != "head":
                open_(tag, stack[-1][1])
        flush()

    def features(self) -> list[tuple[str, ...]]:
        """Discrete features of each node: its tag, its names, the size and link share of its text, what lies below."""
        n = len(self.tag)
        below, linked, kids = self.words[:], self.linked[:], [0] * n
        for i in range(n - 1, 0, -1):
            below[self.parent[i]] += below[i]
            linked[self.parent[i]] += linked[i]
            kids[self.parent[i]] += 1
        out = []
        for i in range(n):
            share = linked[i] / below[i] if below[i] else 0.0
            size = min(5, int(math.log2(below[i] + 1) / 1.5))
            furniture = self.groups[i] - {"main"}
            kind = TAGS.get(self.tag[i], "other")
            if kind == "header" and self.within[i]:
                kind = "article-header"
            f = [f"tag={kind}", f"size={size}", f"link={0 if share < 0.05 else 1 if share < 0.4 else 2}", f"names={'both' if furniture != self.groups[i] and furniture else 'furniture' if furniture else 'main' if self.groups[i] else 'none'}"]
            if self.hidden[i]:
                f.append("hidden")
            out.append(tuple(f))
        return out


class TreeModel:
    """Node and edge potentials, and content marginals by sum-product."""

    def __init__(self):
        self.node: dict[str, float] = {}
        self.edge: dict[str, tuple[tuple[float, float], tuple[float, float]]] = {}
        self.prior = 0.5
        self.scale = 1.0

    def fit(self, pages: list[tuple[Page, list[int]]]) -> TreeModel:
        """Potentials from three quarters of the pages; the rest says how much a node's own features weigh beside its edges.

        Features of a node depend on one another, so their product claims too much: of SCALES the one is taken under which
        the marginals give the labels of the held-out pages the highest likelihood. Then all pages are counted.
        """
        held = pages[::4]
        self._count([p for i, p in enumerate(pages) if i % 4])
        likely = {}
        for self.scale in SCALES:
            likely[self.scale] = sum(math.log(max(1e-9, p if x else 1 - p)) for page, labels in held for p, x in zip(self.marginals(page), labels))
        self.scale = max(SCALES, key=likely.get)
        return self._count(pages)

    def _count(self, pages: list[tuple[Page, list[int]]]) -> TreeModel:
        """Counts of features by label, and of child labels by parent label and the child's kind; labels: one per node."""
        seen: dict[str, list[float]] = {}
        pairs: dict[str, list[list[float]]] = {}
        total = [1.0, 1.0]
        for page, labels in pages:
            for i, f in enumerate(page.features()):
                total[labels[i]] += 1
                for x in f:
                    seen.setdefault(x, [0.5, 0.5])[labels[i]] += 1
                if i:
                    pairs.setdefault(self._kind(f), [[0.5, 0.5], [0.5, 0.5]])[labels[page.parent[i]]][labels[i]] += 1
        self.prior = total[1] / sum(total)
        self.node = {x: math.log(c[1] / total[1]) - math.log(c[0] / total[0]) for x, c in seen.items()}
        # an edge potential is the child's distribution given its parent's state, against what its features alone say
        self.edge = {k: tuple(tuple(v / sum(row) for v in row) for row in t) for k, t in pairs.items()}
        flat = [[sum(t[a][b] for t in pairs.values()) for b in (0, 1)] for a in (0, 1)]
        self.edge[""] = tuple(tuple(v / sum(row) for v in row) for row in flat)
        return self

    @staticmethod
    def _kind(f: tuple[str, ...]) -> str:
        """What the edge potential depends on: whether the child is named or tagged as page furniture."""
        named = any(x in ("hidden", "names=furniture", "tag=nav", "tag=header", "tag=footer", "tag=aside", "tag=form", "tag=dialog") for x in f)
        main = any(x in ("tag=article", "tag=main", "names=main") for x in f)
        return "furniture" if named else "main" if main else "plain"

    def marginals(self, page: Page) -> list[float]:
        """Probability of content for each node. Nodes come before their children, so two passes in order suffice."""
        feats, n = page.features(), len(page.tag)
        own = []
        for f in feats:
            s = sum(self.node.get(x, 0.0) for x in f) * self.scale
            own.append((1 / (1 + math.exp(min(s, 50))), 1 / (1 + math.exp(-max(s, -50)))))
        edge = [self.edge.get(self._kind(f), self.edge[""]) for f in feats]
        up = [(1.0, 1.0)] * n  # the message of a node to its parent
        inside = list(own)  # own potential times the children's messages
        for i in range(n - 1, 0, -1):
            a, b = inside[i]
            z = a + b
            a, b = a / z, b / z
            inside[i] = (a, b)
            e = edge[i]
            up[i] = (e[0][0] * a + e[0][1] * b, e[1][0] * a + e[1][1] * b)
            p = page.parent[i]
            x, y = inside[p][0] * up[i][0], inside[p][1] * up[i][1]
            z = x + y
            inside[p] = (x / z, y / z)
        down = [(1 - self.prior, self.prior)] * n
        out = [0.0] * n
        for i in range(n):
            if i:
                p = page.parent[i]
                x = down[p][0] * inside[p][0] / max(up[i][0], 1e-300)
                y = down[p][1] * inside[p][1] / max(up[i][1], 1e-300)
                z = x + y
                x, y = x / z, y / z
                e = edge[i]
                down[i] = (x * e[0][0] + y * e[1][0], x * e[0][1] + y * e[1][1])
            a, b = down[i][0] * inside[i][0], down[i][1] * inside[i][1]
            out[i] = b / (a + b)
        return out


def main_text(source: str | None, model: TreeModel) -> str:
    """Blocks of content nodes, joined by an empty line; empty for null or empty pages and pages without content."""
    if not source:
        return ""
    page = Page(source)
    if not page.blocks:
        return ""
    p = model.marginals(page)
    return "\n\n".join(t for i, t in page.blocks if p[i] >= 0.5 and not page.hidden[i])


def labelled_page(r: random.Random) -> str:
    """A page of a made-up layout; content words start with 'c', furniture words with 'x', so that labels can be read off."""

    def words(n: int, mark: str) -> str:
        return " ".join(mark + "".join(r.choice("aeiounrst") for _ in range(r.randint(1, 8))) for _ in range(n)) + r.choice(["", "."])

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{words(r.randint(1, 3), "x")}</a></li>' for k in range(n))

    def named(group: str) -> str:
        return r.choice(FURNITURE[group].split())

    def attr(group: str) -> str:
        return r.choice([f' class="{named(group)}"', f' id="{named(group)}"', f' class="box {named(group)}-wrap"', f' role="{named(group)}"'])

    def furniture(kind: str) -> str:
        long = words(r.choice([3, 8, 20, 60]), "x")
        return {
            "nav": lambda: r.choice([f"<nav><ul>{links(r.randint(2, 9))}</ul></nav>", f"<div{attr('nav')}><ul>{links(r.randint(2, 9))}</ul></div>"]),
            "head": lambda: r.choice([f"<header><h1>{words(2, 'x')}</h1><p>{words(5, 'x')}</p></header>", f"<div{attr('head')}>{words(4, 'x')}</div>"]),
            "foot": lambda: r.choice([f"<footer>{long}</footer>", f"<footer><p>&copy; {long}</p><ul>{links(3)}</ul></footer>", f"<div{attr('foot')}><p>{long}</p></div>"]),
            "side": lambda: r.choice([f"<aside><h3>{words(2, 'x')}</h3><ul>{links(5)}</ul><p>{long}</p></aside>", f"<div{attr('side')}><p>{long}</p></div>"]),
            "ad": lambda: f"<div{attr('ad')}>{r.choice(['', '<p>'])}{long}</div>",
            "notice": lambda: f"<div{attr('notice')}><p>{long}</p><button>{words(1, 'x')}</button></div>",
            "talk": lambda: r.choice(["<section{}>", "<div{}>"]).format(attr("talk")) + f"<h2>{words(2, 'x')}</h2>" + "".join(f'<div class="{r.choice(["comment", "item", "reply"])}"><p>{words(r.choice([5, 15, 40]), "x")}</p></div>' for _ in range(r.randint(1, 5))) + "</div></section>",
            "share": lambda: f"<div{attr('share')}><a href='#'>{words(1, 'x')}</a> {words(2, 'x')}</div>",
            "form": lambda: f"<form{r.choice(['', attr('form')])}><label>{words(2, 'x')}</label><input name='q'><p>{words(6, 'x')}</p><button>{words(1, 'x')}</button></form>",
        }[kind]()

    def body(headed: bool) -> str:
        title = f"<h1>{words(r.randint(3, 9), 'c')}</h1>"
        out = [r.choice([title, title, f"<header>{title}</header>", f"<header>{title}<p>{words(12, 'c')}</p></header>"][: 4 if headed else 2])] if r.random() < 0.8 else []
        for _ in range(r.randint(1, 12)):
            k = r.random()
            n = r.choice([1, 4, 12, 30, 80, 200])
            if k < 0.65:
                inner = words(n, "c")
                out.append(f"<p>{r.choice(['', '<b>', '<a href=x>' + words(2, 'c') + '</a> '])}{inner}" + r.choice(["</p>", "</p>", "<br>", ""]))
            elif k < 0.72:
                out.append(f"<h2>{words(4, 'c')}</h2>")
            elif k < 0.8:
                out.append("<ul>" + "".join(f"<li>{words(r.randint(2, 20), 'c')}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif k < 0.84:
                out.append(f"<blockquote><p>{words(n, 'c')}</p></blockquote>")
            elif k < 0.87:
                out.append(f"<pre>{words(n, 'c')}</pre>")
            elif k < 0.9:
                out.append(f"<table><tr><td>{words(3, 'c')}</td><td>{words(5, 'c')}</td></tr></table>")
            elif k < 0.92:
                out.append(f"<figure><img src=x><figcaption>{words(5, 'c')}</figcaption></figure>")
            elif k < 0.95:
                out.append(r.choice([f"<div>{words(n, 'c')}</div>", f'<div class="{named("main")} {named(r.choice(list(FURNITURE)))}">{words(n, "c")}</div>', f'<section id="{named(r.choice(list(FURNITURE)))}-{r.choice(["loops", "policy", "history", "design", "science"])}"><h2>{words(4, "c")}</h2><p>{words(n, "c")}</p></section>']))
            else:
                out.append(furniture(r.choice(["ad", "share", "notice", "side", "form"])))
        return "".join(out)

    before = "".join(furniture(r.choice(["nav", "head", "ad", "notice", "form"])) for _ in range(r.randint(0, 4)))
    after = "".join(furniture(r.choice(["side", "ad", "share", "talk", "foot", "form", "notice"])) for _ in range(r.randint(0, 4)))
    core = r.choice(["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="{}">{}</div>', '<div id="{}">{}</div>', "<div>{}</div>", "<section>{}</section>"])
    core = core.format(*([r.choice([named("main"), named("main"), f"{named('main')} {named(r.choice(list(FURNITURE)))}"])] if core.count("{}") == 2 else []), body("<article>" in core or "<main>" in core))
    wrap = r.choice(["{}", "<div>{}</div>", '<div id="wrapper"><div class="container">{}</div></div>'])
    foot = furniture("foot") if r.random() < 0.8 else ""
    return f"<!DOCTYPE html><html><head><title>{words(3, 'x')}</title><style>p{{margin:0}}</style></head><body>{wrap.format(before + core + after)}{foot}</body></html>"


@lru_cache(maxsize=1)
def trained(n: int = TRAIN_PAGES, seed: int = 11) -> TreeModel:
    """The model fitted on ``n`` labelled pages; a node's label is what most words below it are."""
    r = random.Random(seed)
    pages = []
    for _ in range(n):
        page = Page(labelled_page(r))
        good, bad = [0] * len(page.tag), [0] * len(page.tag)
        for i, t in page.blocks:
            c = sum(w.startswith("c") for w in t.split())
            good[i] += c
            bad[i] += len(t.split()) - c
        for i in range(len(page.tag) - 1, 0, -1):
            good[page.parent[i]] += good[i]
            bad[page.parent[i]] += bad[i]
        pages.append((page, [int(a > b) for a, b in zip(good, bad)]))
    return TreeModel().fit(pages)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", also: tuple[str, ...] = ()) -> DataFrame:
    """One row per page: id, the columns of ``also``, text, n_chars (code points).

    Null and empty pages give an empty text; repeated rows give a row each; other columns are not read. An empty table
    gives an empty result. The model is fitted once, on the driver.
    """
    model = trained()

    def run(sources: list[str | None]) -> list[pa.Array]:
        texts = [main_text(t, model) for t in sources]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    rows = pages.select(id_col, *also, F.col(html_col).alias("_html"))
    return add_columns(rows, "_html", run, "text string, n_chars long").drop("_html")
