"""Main text of web pages by inferred wrappers: union-free regular expressions over the tags of a host's pages.

A page is read as a stream of tags and texts, nested by its block elements; inline tags count as text. Pages of a host are
aligned one after the other. Tokens match by their place, the path of tags that they stand in. Neighbours of the same tag are one
repeated group; a tag that some pages lack is an optional group; texts of a place that differ are a slot, and a text that
stands alike there in nine of ten pages is a token of the template, as a tag is. Each task aligns its own pages, then the
tasks' wrappers are aligned with each other by place, as partial aggregates, so a host with most of the pages is no single
task's work. All pages and places are counted.

The wrapper decides the text. It lies in the articles, else the main parts, else the parts named so, whichever have slots; else
in the innermost part that holds more than half of the slots' text and is neither optional nor repeated. Pages are read there
without the template's texts and without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments.
Copies of one page can't tell template from content: where more than three quarters of the text of a host's articles (main, named parts) stands
alike, all of it stays. So it does on a host of under four pages. A page that has none of the wrapper's places is its own wrapper.

Only the printed expression, not the text, leaves out groups that fewer than one of 64 pages have, so it is bounded.

Defined cases: null html and null urls are empty, and pages without a host form one group; an empty page has an empty text;
unclosed and stray tags are mended as browsers do for block elements; a tag without an end swallows the rest; any depth and
length takes linear time; repeated rows are extracted each; an empty table gives no rows; further columns of any name stay.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelane.llm.common import Scratch, by_batch, meet
from scorelane.llm.tiles import by_group

# Element names and the parts of names that mark what is not main text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas audio video head title textarea select button".split())
CLUTTER = frozenset("nav header footer aside form menu dialog fieldset search".split())
CLUTTER_NAMES = frozenset("ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer disqus footer header masthead menu modal nav navbar navigation newsletter notice notices overlay pagination pager popup promo promoted promotion related recommended replies reply share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split())
CLUTTER_ROLES = frozenset("navigation banner contentinfo complementary search form menu dialog alert".split())
MAIN_NAMES = frozenset("article content entry main post story text body".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody"}, "tfoot": {"thead", "tbody"}}
HOLDS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
PHRASING_ENDS_P = BLOCKS - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "html", "body"}

KINDS = ("", "named", "main", "article")  # of elements that hold main text, by rank
THROUGH = frozenset("html body div section table tbody tr td center".split())  # parts that may lie around the main one

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
TAG_END = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
LEAST_PAGES = 4  # of a host that can show what its template is
RARE = 64  # a place that fewer than one of so many pages have is left out of the printed expression
MOST_TOKENS = 200_000  # that a task holds before it hands them on


@lru_cache(1 << 14)
def _element(tag: str, attributes: str) -> tuple[str, bool, int]:
    """What elements are aligned by: tag, id and classes without digits; whether it is clutter; and its rank in KINDS."""
    label, clutter, words = tag, tag in CLUTTER, set()
    if "=" in attributes:
        for name, a, b, c in NAMED.findall(attributes):
            value = re.sub(r"\d+", "", html_lib.unescape(a or b or c).lower())
            if name.lower() == "role":
                clutter = clutter or value.strip() in CLUTTER_ROLES
                label += "@main" if value.strip() == "main" else ""
                continue
            own = sorted(set(value.split()))
            label += "".join(("." if name.lower() == "class" else "#") + w for w in own)
            words |= {part for w in own for part in re.split(r"[-_:]+", w)}
        clutter = clutter or (tag not in ("html", "body", "article", "main") and bool(words & CLUTTER_NAMES))
    main = words & MAIN_NAMES if tag not in ("html", "body", "p", "li") else set()
    kind = 3 if tag == "article" else 2 if tag == "main" or "@main" in label else int(bool(main))
    # Parts that hold main text are aligned whatever else their classes say.
    return (label, tag, "main", f"{tag}.{'.'.join(sorted(main))}")[0 if not kind else 4 - kind], clutter, kind


@lru_cache(64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I)


def read(html: str) -> Iterator[tuple[str, object]]:
    """Events of a page: ("open", (label, clutter, kind)), ("close", None), ("text", text) and ("break", None), well nested."""
    stack: list[str] = []
    places: dict[str, list[int]] = defaultdict(list)  # of each open tag in the stack
    endless: set[str] = set()  # raw tags without an end from here on
    at, size, last = 0, len(html), html.rfind(">")

    def close(down_to: int) -> Iterator[tuple[str, object]]:
        while len(stack) > down_to:
            places[stack.pop()].pop()
            yield "close", None

    def innermost(tags: set[str]) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=-1)

    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", html[at:]
            break
        if lt > at:
            yield "text", html[at:lt]
        m = NAME.match(html, lt)
        if m is None:
            if html[lt + 1 : lt + 2] not in ("!", "?", "/"):
                yield "text", "<"
                at = lt + 1
                continue
            mark = "-->" if html.startswith("<!--", lt) else ">"
            stop = html.find(mark, lt + 2)
            if stop < 0:
                break
            at = stop + len(mark)
            continue
        t = TAG_END.match(html, m.end()) if lt < last else None
        if t is None:
            break
        at, tag, attributes = t.end(), m[2].lower(), html[m.end() : t.end() - 1]
        if m[1]:
            if places[tag]:
                yield from close(places[tag][-1])
            continue
        empty = attributes.endswith("/")
        if tag in RAW:
            text_only = tag in ("script", "style", "title", "textarea")
            if text_only or not empty:
                found = None if tag in endless else _raw_end(tag).search(html, at)
                if found:
                    at = found.end()
                elif text_only:
                    break
                else:
                    endless.add(tag)
            yield "text", " "
            continue
        if tag in VOID:
            yield ("break", None) if tag == "hr" else ("text", " " if tag == "br" else "")
            continue
        label, clutter, kind = _element(tag, attributes)
        if tag == "header" and label == tag and (places["article"] or places["main"]):
            clutter = False  # an article's own heading
        if tag not in BLOCKS and not clutter:
            continue
        if tag in PHRASING_ENDS_P and places["p"]:
            yield from close(places["p"][-1])
        if tag in CLOSES and (to := innermost(CLOSES[tag])) > innermost(HOLDS[tag]):
            yield from close(to)
        if empty and tag not in BLOCKS:
            continue
        places[tag].append(len(stack))
        stack.append(tag)
        yield "open", (label, clutter, kind)
    yield from close(0)


def clean(text: str) -> str:
    return " ".join(html_lib.unescape(text).split())


def place(parent: int, label: str) -> int:
    return xxhash.xxh3_64_intdigest(label.encode("utf-8", "surrogatepass"), parent & (1 << 64) - 1) - (1 << 63)


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63) or 1


ROOT = 0


@dataclass
class Token:
    """A place of a wrapper, or a text there. mass: code points of text in it; order: its mean number among its neighbours times
    pages."""

    place: int
    parent: int
    label: str
    kind: int
    depth: int
    text: int = 0  # its hash; 0: an element
    pages: int = 1
    repeated: bool = False
    mass: int = 0
    order: int = 0
    children: list[Token] = field(default_factory=list, repr=False)

    def add(self, other: Token) -> None:
        """Aligns another page's or task's token of this place with it."""
        self.pages += other.pages
        self.repeated = self.repeated or other.repeated
        self.mass += other.mass
        self.order += other.order


def blocks(html: str) -> Iterator[tuple[str, object]]:
    """("open", (place, parent, label, kind)), ("close", place) and ("text", clean text) of what is no clutter."""
    path, skip, held = [ROOT], 0, []

    def flush() -> Iterator[tuple[str, object]]:
        if held:
            if line := clean("".join(held)):
                yield "text", line
            held.clear()

    for event, x in read(html):
        if event == "text":
            if not skip:
                held.append(x)
        elif event == "open" and (skip or x[1]):
            if not skip:
                yield from flush()
            skip += 1
        elif event == "close" and skip:
            skip -= 1
        else:
            yield from flush()
            if event == "open":
                path.append(place(path[-1], x[0]))
                yield "open", (path[-1], path[-2], x[0], x[2])
            elif event == "close":
                yield "close", path.pop()
    yield from flush()


def page_tokens(html: str) -> dict[tuple[int, int], Token]:
    """The page as a wrapper of its own, by (place, text)."""
    root = Token(ROOT, ROOT, "", 0, 0)
    out = {(ROOT, 0): root}
    path, masses, met, kinds = [root], [0], [set()], [0]
    for event, x in blocks(html):
        if event == "open":
            at, parent, label, kind = x
            t = out.get((at, 0))
            if t is None:
                t = out[at, 0] = Token(at, parent, label, kind, len(path), order=len(met[-1]))
            t.repeated = t.repeated or at in met[-1]
            met[-1].add(at)
            path.append(t), masses.append(0), met.append(set()), kinds.append(max(kinds[-1], kind))
        elif event == "close":
            t, n = path.pop(), masses.pop()
            met.pop(), kinds.pop()
            t.mass += n
            masses[-1] += n
        else:
            own, h = path[-1], text_hash(x)
            masses[-1] += len(x)
            t = out.get((own.place, h))
            if t is None:
                out[own.place, h] = Token(own.place, own.parent, "", kinds[-1], own.depth + 1, h, mass=len(x))
            else:
                t.mass += len(x)
    root.mass = masses[0]
    return out


@dataclass
class Wrapper:
    """How a host's pages are read. kind: the rank of the elements that hold the text, or 0 with a place."""

    pages: int
    kind: int
    place: int
    without: set[int]  # elements of that kind that have no slots
    same: set[tuple[int, int]]  # texts of the template, by place
    expression: str

    def plan(self) -> str:
        return json.dumps([self.kind, self.place, sorted(self.without), sorted(self.same)])


def is_template(t: Token, pages: int) -> bool:
    return bool(t.text) and pages >= LEAST_PAGES and 10 * t.pages >= 9 * pages


def wrapper_of(tokens: list[Token]) -> Wrapper:
    """The wrapper of a host's aligned tokens: its elements, and of its texts those of the template."""
    by = {t.place: t for t in tokens if not t.text}
    pages = by[ROOT].pages
    same = [t for t in tokens if is_template(t, pages)]
    alike: dict[int, int] = defaultdict(int)  # how much of an element's text is the template's
    for t in same:
        alike[t.place] += t.mass
    deepest_first = sorted((t for t in by.values() if t.place != ROOT), key=lambda t: (-t.depth, t.place))
    for t in deepest_first:
        if t.parent in by:
            alike[t.parent] += alike[t.place]
            by[t.parent].children.append(t)
    slots = {p: t.mass - alike[p] for p, t in by.items()}
    for t in by.values():
        t.children.sort(key=lambda c: (c.order / c.pages, c.label))
    out = Wrapper(pages, 0, ROOT, set(), {(t.place, t.text) for t in same}, _expression(by[ROOT], {t.place for t in same}, slots))
    for kind in (3, 2, 1):
        own = [t for t in by.values() if t.kind == kind]
        if any(slots[t.place] for t in own):
            out.kind, out.without = kind, {t.place for t in own if not slots[t.place]}
            if 4 * sum(t.mass for t in same if t.kind >= kind) > 3 * sum(t.mass for t in own):
                out.same = set()
            return out
    node = by[ROOT]
    while True:
        inner = [c for c in node.children if re.split(r"[.#@]", c.label)[0] in THROUGH and not c.repeated and 2 * c.pages > pages and 2 * slots[c.place] > slots[ROOT]]
        if not inner:
            out.place = node.place
            return out
        node = inner[0]


def _expression(root: Token, template: set[int], slots: dict[int, int]) -> str:
    """The union-free expression: #TEXT is a slot, #SAME a text of the template, ()? optional, ()+ repeated."""
    out, todo = [], [(root, root.pages, "")]
    while todo:
        t, around, closing = todo.pop()
        if t is None:
            out.append(closing)
            continue
        grouped, tag = t.repeated or t.pages < around, re.split(r"[.#@]", t.label)[0]
        out.append(("(" if grouped else "") + (f"<{t.label}>" if tag else ""))
        if t.place in template:
            out.append("#SAME")
        if slots[t.place] > sum(slots[c.place] for c in t.children):
            out.append("#TEXT")
        todo.append((None, 0, (f"</{tag}>" if tag else "") + (")" + "+" * t.repeated + "?" * (t.pages < around) if grouped else "")))
        todo += [(c, t.pages, "") for c in reversed(t.children)]
    return "".join(out)


def extract_page(html: str, kind: int, main: int, without: set[int], same: set[tuple[int, int]]) -> tuple[str, bool]:
    """The text at the wrapper's places, a line per block, and whether the page has any of them."""
    lines, path = [], [ROOT]
    met = not kind and main == ROOT
    inside = len(path) if met else 0
    for event, x in blocks(html):
        if event == "open":
            path.append(x[0])
            if not inside and (x[3] == kind and x[0] not in without if kind else x[0] == main):
                inside, met = len(path), True
        elif event == "close":
            path.pop()
            if len(path) < inside:
                inside = 0
        elif inside and (path[-1], text_hash(x)) not in same:
            lines.append(x)
    return "\n".join(lines), met


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


TOKEN = "host string, place long, parent long, label string, kind int, depth int, text long, pages long, repeated boolean, mass long, order long"
FIELDS = [x.split()[0] for x in TOKEN.split(", ")]


def aligned_tokens(pages: DataFrame, url: str, html: str) -> DataFrame:
    """The tokens of each host's wrapper, aligned over all its pages."""
    rows = pages.select(host(F.col(url)).alias("host"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers: dict[str, dict[tuple[int, int], Token]] = defaultdict(dict)
        held = 0

        def out() -> pa.RecordBatch:
            listed = [[h, *(getattr(t, f) for f in FIELDS[1:])] for h, w in wrappers.items() for t in w.values()]
            wrappers.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*listed, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names=FIELDS)

        for b in batches:
            for h, page in zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1)), strict=True):
                wrapper = wrappers[h]
                for at, t in page_tokens(page).items():
                    if at in wrapper:
                        wrapper[at].add(t)
                    else:
                        wrapper[at] = t
                        held += 1
                if held > MOST_TOKENS:
                    yield out()
                    held = 0
        yield out()

    parts = rows.mapInArrow(per_task, TOKEN)
    first = lambda c: F.max(c).alias(c)  # noqa: E731  (all alike)
    total = lambda c: F.sum(c).alias(c)
    return parts.groupBy("host", "place", "text").agg(*map(first, ("parent", "label", "kind", "depth", "repeated")), *map(total, ("pages", "mass", "order"))).select(FIELDS)


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, pages, wrapper (its expression), plan (how to read the host's pages, in JSON); written."""
    scratch = Scratch(pages.sparkSession, "wrappers")
    every = scratch.put(aligned_tokens(pages, url, html).where((F.col("text") == 0) | (F.col("pages") >= LEAST_PAGES)), "tokens")
    hosts = every.where((F.col("place") == ROOT) & (F.col("text") == 0)).select("host", F.col("pages").alias("all_pages"))
    total = hosts.agg(F.sum("all_pages")).first()[0] or 0
    # Elements that enough pages have, and texts of the template: both are bounded by the mean size of the host's pages.
    met = meet(every, hosts, "host", "all_pages", total)
    kept = met.where(F.when(F.col("text") == 0, F.col("pages") * RARE >= F.col("all_pages")).otherwise(F.col("pages") * 10 >= F.col("all_pages") * 9)).select(FIELDS)

    def finish(t: pa.Table) -> pa.RecordBatch:
        tokens = [Token(**{f: v for f, v in row.items() if f != "host"}) for row in t.to_pylist()]
        w = wrapper_of(tokens)
        return pa.RecordBatch.from_pydict({"host": t.column("host").slice(0, 1).combine_chunks(), "pages": pa.array([w.pages], pa.int64()), "wrapper": pa.array([w.expression]), "plan": pa.array([w.plan()])})

    out = scratch.put(by_group(kept, ["host"], finish, "host string, pages long, wrapper string, plan string"), "wrappers")
    scratch.drop("tokens")
    return out


def extract(pages: DataFrame, url: str = "url", html: str = "html", into: str = "text") -> DataFrame:
    """pages without html, with the main text in column into."""
    wrappers = infer_wrappers(pages, url, html).select(F.col("host").alias("_w_host"), F.col("plan").alias("_w_plan"))
    rows = pages.withColumn("_w_host", host(F.col(url))).join(wrappers, "_w_host", "left")

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        @lru_cache(256)
        def parsed(plan: str) -> tuple[int, int, set[int], set[tuple[int, int]]]:
            kind, main, without, same = json.loads(plan)
            return kind, main, set(without), {(a, b) for a, b in same}

        for htmls, plans in batches:
            out = []
            for page, plan in zip((h.as_py() or "" for h in htmls), (p.as_py() for p in plans), strict=True):
                text, met = extract_page(page, *parsed(plan)) if plan else ("", False)
                if not met:
                    own = wrapper_of(list(page_tokens(page).values()))
                    text, _ = extract_page(page, own.kind, own.place, own.without, set())
                out.append(text)
            yield pa.array(out, pa.string())

    return rows.withColumn(into, by_batch(run, "string", F.col(html).cast("string"), F.col("_w_plan"))).drop(*({html, "_w_host", "_w_plan"} - {into}))
