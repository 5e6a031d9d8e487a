"""Main text of web pages by consensus paths of each host.

1. Every page is read once; each of its containers (article, main, section, div, cell, body)
   is scored by the text of its own blocks that is not in links, half of it counting for the
   container around it. A page votes for its best containers by their paths: the chain of
   tags and classes, digits in classes generalised.
2. The votes are added up by host and path. The path with the most votes wins.
3. Every page is read again: the blocks inside the containers on its host's winning path, and
   in the article or main around them (or the lowest container that is mostly theirs), are its
   text: title and lead often stand outside of the inner container. A page without such a
   container falls back to its own best one.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are left out wherever they stand, by their tag, role, class or id. Headings,
paragraphs, articles and the body are not judged by their names, and an element around the
page's text is kept whatever its name.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratasift.llm.common import map_slices, stored

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>""",
    re.S,
)
#: An attribute: its name, and its value with or without quotes.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_OPEN_COMMENT = re.compile(r"<!--.*", re.S)
_SPLIT = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")

# Kinds of tags, and names that mark what is not main text.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "select", "object", "canvas", "title"}
CONTAINERS = {"article": 1.5, "main": 1.4, "section": 1.0, "div": 1.0, "td": 1.0, "body": 0.6}
LEFT_OUT = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "head"}
BLOCKS = {
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "figure", "figcaption",
    "table", "caption", "thead", "tbody", "tfoot", "tr", "th", "hr", "address", "details", "summary", "fieldset", "html",
} | set(CONTAINERS) | LEFT_OUT
VOID = {"hr", "br", "img", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
#: An opening tag ends open ones of these kinds, up to the next container.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
ENDS |= {t: {"p"} for t in BLOCKS - set(ENDS)}
NOISE = {
    "nav", "navbar", "navigation", "menu", "sidebar", "footer", "header", "masthead", "comment", "comments", "reply", "replies", "respond", "disqus",
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies",
    "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login",
    "share", "sharing", "social", "related", "recommended", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "widget", "copyright",
    "skip", "search", "searchbox", "complementary", "contentinfo", "hidden",
}
#: Noise of any size: readers' texts may be longer than the article.
READERS = {"comment", "comments", "reply", "replies", "respond", "disqus", "hidden"}
#: Words that go with noise without naming a subject: "related-posts" is noise, "related-work" is not.
FILLERS = {
    "area", "article", "articles", "bar", "block", "blocks", "body", "bottom", "box", "boxes", "button", "buttons", "col", "column", "container",
    "content", "entry", "form", "global", "group", "holder", "icon", "icons", "inline", "inner", "item", "items", "layout", "left", "link", "links", "list",
    "main", "meta", "mobile", "more", "news", "outer", "page", "pages", "panel", "post", "posts", "primary", "reader", "readers", "right", "row", "secondary",
    "section", "site", "slot", "stories", "story", "strip", "tags", "text", "thread", "title", "top", "unit", "user", "wrap", "wrapper", "zone",
}
#: Parts of names that say what an element has or lacks, not what it is.
MODIFIERS = {"has", "with", "without", "no", "non", "not", "is"}
#: Tags that are never judged by their names.
OWN_TEXT = {"body", "main", "article", "html", "p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "figure", "figcaption"}
DEPTH, VOTES, SALTS = 8, 3, 32
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def _is_noise(value: str) -> int:
    """Whether one of the names is noise (1) of any size (2).

    A name is noise if a word of it is and the others are fillers or numbers; what follows a
    modifier does not count, and a word with another subject makes the name none.
    """
    noise = 0
    for name in value.split():
        worst = 0
        for word in (w.lower() for w in _SPLIT.split(name)):
            if word in MODIFIERS:
                break
            if word in NOISE:
                worst = max(worst, 1 + (word in READERS))
            elif word and not word.isdigit() and word not in FILLERS:
                worst = 0
                break
        noise = max(noise, worst)
    return noise


def _label(tag: str, attributes: str) -> tuple[str, int]:
    """Tag and class, generalised, and whether the element is noise: by its names (1) or surely (2)."""
    names, noise = "", 2 * (tag in LEFT_OUT)
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            noise = 2
        elif name in ("class", "id", "role"):
            if name == "class" and value.split():
                names = "." + re.sub(r"\d+", "#", value.split()[0])
            if tag not in OWN_TEXT:
                # ids of sections are often made from their headings
                whole = tag != "section" or name != "id" or all(w.lower() in NOISE for w in _SPLIT.split(value))
                noise = max(noise, n if (n := _is_noise(value)) == 2 or whole else 0)
    return tag + names, noise


class Page:
    """One page's blocks and containers."""

    def __init__(self, source: str):
        #: Per container: (path, parent); the first stands for the page itself.
        self.containers: list[tuple[str, int]] = [("", -1)]
        #: Per block: (container, text, characters in links).
        self.blocks: list[tuple[int, str, int]] = []
        # blocks with the element that makes them noise by its names, or 0; its parent of that kind
        found: list[tuple[int, str, int, int]] = []
        outer, wraps = [0], [False]
        # open elements: (tag, path, container, noise by names, surely noise)
        stack: list[tuple[str, str, int, int, bool]] = [("", "", 0, 0, False)]
        parts: list[str] = []
        linked, in_link, at, size = 0, 0, 0, len(source)
        last = source.rfind(">")  # no tag ends behind it
        count: Counter[str] = Counter()  # open elements by tag

        def shut(i: int) -> None:
            for element in stack[i:]:
                count[element[0]] -= 1
            del stack[i:]

        def flush() -> None:
            nonlocal linked
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                if text and not stack[-1][4]:
                    found.append((stack[-1][2], text, linked, stack[-1][3]))
                parts.clear()
            linked = 0

        while at < size:
            m = _TAG.search(source, at) if at <= last else _OPEN_COMMENT.search(source, at)
            if m and m.start() > last:
                m = _OPEN_COMMENT.search(source, at)
            end = m.start() if m else size
            if end > at:
                parts.append(source[at:end])
                if in_link:
                    linked += end - at
            if not m:
                break
            at = m.end()
            name = m.re is _TAG and (m[2] or m[5])
            if not name:
                continue
            tag, closing = name.lower(), bool(m[1] or m[4])
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                in_link = 0 if closing else 1
            elif tag in RAW and not closing:
                if not (m[3] or m[6] or "").endswith("/"):
                    stop = re.compile(f"</{tag}(?![a-zA-Z0-9])[^>]*(?:>|\\Z)", re.I).search(source, at)
                    at = stop.end() if stop else size
            elif tag in BLOCKS:
                flush()
                if closing:
                    for i in range(len(stack) - 1, 0, -1) if count[tag] else ():
                        if stack[i][0] == tag:
                            shut(i)
                            in_link = 0
                            break
                elif tag not in VOID:
                    ends = ENDS[tag]
                    for i in range(len(stack) - 1, 0, -1) if any(count[e] for e in ends) else ():
                        if stack[i][0] in ends:
                            shut(i)
                        elif stack[i][0] in CONTAINERS or stack[i][0] in ("ul", "ol", "table", "blockquote"):
                            break
                    label, noise = _label(tag, m[3] or m[6] or "")
                    _, path, inside, named, sure = stack[-1]
                    if noise == 1:
                        outer.append(named)
                        wraps.append(False)
                        named = len(outer) - 1
                    path = "/".join([*path.split("/")[-(DEPTH - 1) :], label]) if path else label
                    if tag in CONTAINERS:
                        self.containers.append((path, inside))
                        inside = len(self.containers) - 1
                    if tag in ("article", "main", "h1"):
                        wraps[named] = True
                    if tag == "h1" and (count["article"] or count["main"]):
                        # the title of an article is no noise inside of it
                        named = next(e[3] for e in reversed(stack) if e[0] in ("article", "main"))
                    stack.append((tag, path, inside, named, sure or noise == 2))
                    count[tag] += 1
        flush()
        self._drop_noise(found, outer, wraps)

    def _drop_noise(self, found: list[tuple[int, str, int, int]], outer: list[int], wraps: list[bool]) -> None:
        """Keep the blocks outside of noise.

        What holds most of the page's own text is none if it holds all of it, or an article,
        main or h1.
        """
        held = [0] * len(outer)
        for _, text, linked, named in found:
            held[named] += max(0, len(text) - 2 * linked)
        for i in range(len(outer) - 1, 0, -1):
            held[outer[i]] += held[i]
            wraps[outer[i]] |= wraps[i]
        noisy = [False] * len(outer)
        for i in range(1, len(outer)):
            noisy[i] = noisy[outer[i]] or 2 * held[i] <= held[0] or not (wraps[i] or held[i] == held[0])
        self.blocks = [(c, text, linked) for c, text, linked, named in found if not noisy[named]]

    def scores(self) -> list[float]:
        own = [0.0] * len(self.containers)
        for c, text, linked in self.blocks:
            own[c] += max(0, len(text) - 2 * linked)
        total = own.copy()
        for c, (_, parent) in enumerate(self.containers):
            if parent >= 0:
                total[parent] += own[c] / 2
        weight = lambda path: CONTAINERS.get(re.split(r"[.]", path.rpartition("/")[2])[0], 0.3)
        return [t * weight(path) for t, (path, _) in zip(total, self.containers)]

    def votes(self) -> list[tuple[str, float]]:
        """Paths of the best containers, with their share of all scores."""
        by_path: dict[str, float] = {}
        for score, (path, _) in zip(self.scores(), self.containers):
            if score > 0:
                by_path[path] = by_path.get(path, 0.0) + score
        total = sum(by_path.values())
        best = sorted(by_path.items(), key=lambda x: (-x[1], x[0]))[:VOTES]
        return [(path, score / total) for path, score in best]

    def text(self, path: str | None) -> str:
        """The blocks inside the containers on ``path`` (or inside the best one), in order."""
        chosen = {c for c, (p, _) in enumerate(self.containers) if p == path}
        inside = self._inside(chosen)
        if not any(inside[b[0]] for b in self.blocks):
            best = self.votes()
            chosen = {c for c, (p, _) in enumerate(self.containers) if best and p == best[0][0]}
        chosen |= self._around(chosen)
        inside = self._inside(chosen)
        return "\n".join(text for c, text, _ in self.blocks if inside[c])

    def _around(self, chosen: set[int]) -> set[int]:
        """For each outermost chosen container, the article or main around it; else the lowest
        container around it, inside the body, with more than half of its text in ``chosen``."""
        inside, held, won = self._inside(chosen), [0] * len(self.containers), [0] * len(self.containers)
        for c, text, _ in self.blocks:
            held[c] += len(text)
            won[c] += len(text) * inside[c]
        for c in range(len(held) - 1, 0, -1):
            parent = self.containers[c][1]
            held[parent] += held[c]
            won[parent] += won[c]
        out = set()
        for c in chosen:
            if c and inside[self.containers[c][1]]:
                continue
            lowest, at = None, c
            while at > 0:
                tag = self.containers[at][0].rpartition("/")[2].partition(".")[0]
                if tag in ("article", "main"):
                    out.add(at)
                    break
                if lowest is None and at != c and tag != "body" and 2 * won[at] > held[at]:
                    lowest = at
                at = self.containers[at][1]
            else:
                out.add(c if lowest is None else lowest)
        return out

    def _inside(self, chosen: set[int]) -> list[bool]:
        """For every container whether it is in ``chosen`` or inside one that is."""
        inside = [False] * len(self.containers)
        for c, (_, parent) in enumerate(self.containers):  # parents come first
            inside[c] = c in chosen or (parent >= 0 and inside[parent])
        return inside


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the winning path of every host, ties to the lesser path."""

    def vote(part: pa.RecordBatch) -> pa.RecordBatch:
        hosts, paths, shares = [], [], []
        for host, source in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
            for path, share in Page(source).votes():
                hosts.append(host)
                paths.append(path)
                shares.append(round(share * 1_000_000))  # whole numbers add up alike in any order
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(shares, pa.int64())], names=["host", "path", "share"])

    votes = map_slices(pages.select("host", "html"), vote, "host string, path string, share long", "html")
    totals = votes.groupBy("host", "path").agg(F.sum("share").alias("votes"))
    return totals.groupBy("host").agg(F.min_by("path", F.struct((-F.col("votes")).alias("v"), "path")).alias("path"))


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """Per row: key, url, text and n_chars (code points) of the page's main text.

    Character references are decoded, white space inside a block becomes one space, blocks
    are joined by a line feed. Null or empty pages give an empty text; pages without a host
    vote together. The winning paths are broadcast if their measured size allows it; else the
    pages meet them by host and a salt, so a host with a third of all pages is spread.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))
    rows = pages.select(
        F.col(key).alias("key"),
        F.col(url).alias("url"),
        host.alias("host"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("html"),
    )
    winners = stored(host_paths(rows), "paths")
    n, size = winners.agg(F.count("*"), F.sum(F.octet_length("host") + F.octet_length("path"))).first()
    if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES:
        told = rows.join(F.broadcast(winners), "host", "left")
    else:
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        told = rows.withColumn("salt", F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def extract(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [Page(s).text(p) for s, p in zip(part.column("html").to_pylist(), part.column("path").to_pylist())]
        return pa.RecordBatch.from_arrays(
            [part.column("key"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=[key, url, "text", "n_chars"],
        )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long"
    return map_slices(told.select("key", "url", "html", "path"), extract, schema, "html")
