"""Main text of web pages by equivalence-class template deduction.

A page's tokens are the tag paths of its elements and the texts of its blocks,
in articles too. A token's occurrence vector over the pages of its host is
kept as the sum of count * code(page), so vectors are compared without being
gathered. Tokens with equal vectors on at least half of a host's pages are an
equivalence class; the class of the body is the template's skeleton, and a
class of several tokens is valid if its tokens nest in the skeleton or in its
own paths (paths are known by codes); a text of all pages is valid too. Pages of the same html count once.
What valid classes hold is template: their block texts are dropped, and their innermost container that
holds most of the host's running text is the main slot. An article or main
element is evidence only: a slot in one is widened to all of it, and its texts
aren't taken for template; where the classes give no such slot, a page's
articles are its main text if they hold most of its running text.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dealt, only, stash
from .url_rules import host_of

#: Templates, and texts of them, that are sent to all executors at most (some tens of MB); more are joined by a shuffle.
BROADCAST_ROWS = 20_000
BROADCAST_TEXTS = 500_000
#: A template needs this many pages; its tokens are on at least half of them.
LEAST_PAGES = 4
#: The share of a host's running text that its main slot holds at least.
MAIN_SHARE = 0.6

#: Tag names by what they do.
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "noembed", "noframes", "xmp", "template", "svg", "math", "object", "video", "audio", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
OUT = {"nav", "aside", "footer", "form", "menu", "dialog", "button", "select", "head", "search", "fieldset"}
#: Words of class, id and role that mark what isn't main text.
OUT_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations", "comment", "comments", "disqus", "respond", "reply", "replies", "widget", "widgets", "toolbar", "pagination", "pager", "search", "contentinfo", "complementary", "tags", "byline"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: A tag that ends an open paragraph, item, cell or option when it starts.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

_TAG = re.compile(r"<(?:!--(?:>|->|(?s:.*?)(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z))|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: The attributes that say what an element is.
_TELLING = {"class", "id", "role", "hidden", "style", "aria-hidden"}
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: An id that numbers its kind of element, like comment-12.
_NUMBERED = re.compile(r"([a-z]+)[-_]?[0-9]+")
#: Blocks that are text rather than containers of a page's text.
_LEAF = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "li", "dt", "dd", "address", "caption", "figcaption", "legend", "summary"}
_WORD = re.compile(r"[A-Za-z]+")


def _marks(name: str, key: str, value: str, within: bool) -> list[str]:
    """What may mark an element: whole names in an article and of text blocks, whose ids say what they are about, else their words."""
    if key == "id" and (name in HEADINGS or name == "section" and within):
        return []
    if within or name in HEADINGS or name == "p" or name == "section" and key == "id":
        return value.split()
    return _WORD.findall(value)


def _out(name: str, attributes: str, within: bool) -> bool:
    """Whether an element isn't main text, by its name and attributes."""
    if name in OUT or name == "header" and not within:
        return True
    if not attributes or name in ("html", "body"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        if key not in _TELLING:
            continue
        value = (m[2] or m[3] or m[4] or "").lower()
        if name in ("article", "main") and not within:  # a page's article, unless it is one comment or teaser of many
            marks = value.split() if key == "class" else _NUMBERED.findall(value) if key == "id" else []
            if name == "article" and any(w in OUT_WORDS for w in marks):
                return True
            continue
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _UNSEEN.search(value):
            return True
        if key in ("class", "id", "role") and any(w in OUT_WORDS for w in _marks(name, key, value, within)):
            return True
    return False


def _code(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x) >> 1


class Paths:
    """The tag paths of a page's block elements, each known by a number that is greater than its parent's; 0 is the page itself."""

    def __init__(self) -> None:
        self.parent, self.code, self.depth, self.leaf, self.marked = [0], [0], [0], [False], [0]
        self._known: dict[tuple[int, str], int] = {}

    def add(self, parent: int, name: str) -> int:
        at = self._known.get((parent, name))
        if at is None:
            at = self._known[parent, name] = len(self.code)
            code = _code(f"{self.code[parent]:x}/{name}")
            self.parent.append(parent)
            self.code.append(code)
            self.depth.append(self.depth[parent] + 1)
            self.leaf.append(name in _LEAF)
            # the innermost article or main around a path, itself included
            self.marked.append(code if name in ("article", "main") else self.marked[parent])
        return at

    def under(self, code: int) -> list[bool]:
        """For each path whether it is that of a code or lies in it."""
        held = [False] * len(self.code)
        for at in range(1, len(held)):
            held[at] = self.code[at] == code or held[self.parent[at]]
        return held


class Block(NamedTuple):
    """A text block: its element's path, its text, whether it is out, whether it is in an article, its characters in links."""

    path: int
    text: str
    out: bool
    within: bool
    linked: int

    @property
    def running(self) -> int:
        return max(0, len(self.text) - self.linked)


class _Open(NamedTuple):
    """An open element: its path (an inline element's is its block's), the innermost block's place in the stack and whether that is out."""

    name: str
    path: int
    out: bool
    within: bool
    block: int
    block_out: bool
    link: int


def blocks(page: str | None) -> tuple[Paths, list[Block]]:
    """The paths and, in order, the text blocks of a page. Time and memory grow with the page's length, whatever its depth."""
    paths, found = Paths(), []
    stack = [_Open("", 0, False, False, 0, False, 0)]
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack the elements of a name are
    parts: list[str] = []
    linked = 0
    page = page or ""

    def last(names: set[str]) -> int:
        """The place of the last open element of these names; 0 if there is none."""
        return max((places[n][-1] for n in names if places[n]), default=0)

    def cut(at: int) -> None:
        for x in stack[at:]:
            places[x.name].pop()
        del stack[at:]

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                top = stack[-1]
                found.append(Block(top.path, text, top.block_out, top.within, linked))
            parts.clear()
        linked = 0

    def text(raw: str) -> None:
        nonlocal linked
        top = stack[-1]
        if raw and (not top.out or top.block_out):  # else an inline element of a kept block is out
            parts.append(raw)
            if top.link:
                linked += len(raw)

    at = 0
    while m := _TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, closing, attributes = name.lower(), m[1] or m[4], (m[3] or m[6] or "").rstrip()
        if not closing and name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br" or name == "wbr":
            parts.append(" " if name == "br" else "")
            continue
        block = name in BLOCK
        if block:
            flush()
        if closing:
            k = last({name})
            if k and (block or stack[-1].block < k):  # an inline end tag doesn't end a block
                cut(k)
            continue
        if block and name not in ("html", "body") and stack[stack[-1].block].name == "p":
            cut(stack[-1].block)  # a block ends the open paragraph
        if name in CLOSES:
            k = last(CLOSES[name])
            if k and k > last(STOPS[name]):
                cut(k)
        if name in VOID or attributes.endswith("/") and not block:
            continue
        top = stack[-1]
        gone = top.out or _out(name, attributes, top.within)
        path = paths.add(top.path, name) if block else top.path
        places[name].append(len(stack))
        stack.append(_Open(name, path, gone, top.within or name in ("article", "main") and not gone, len(stack) if block else top.block, gone if block else top.block_out, 4 if name == "a" else max(0, top.link - 1)))
    text(page[at:])
    flush()
    return paths, found


def _text_code(path_code: int, text: str) -> int:
    return _code(f"{path_code:x} {text}")


class Token(NamedTuple):
    """A token's kind (t: text, p: path, or the page itself), its code, that of the path around it, and a path's depth, kind and article."""

    kind: str
    code: int
    around: int
    depth: int
    leaf: bool
    marked: int


_PAGE = Token("", 0, 0, 0, False, 0)


def page_tokens(page: str | None) -> dict[Token, tuple[int, int]]:
    """For each token of a page: its count, and the characters of running text (outside links and what is out) under it; a container counts once."""
    paths, found = blocks(page)
    mass, own = [0] * len(paths.code), [0] * len(paths.code)
    held = [False] * len(paths.code)
    tokens: dict[Token, tuple[int, int]] = {}
    for b in found:
        if not b.out:
            code = paths.code[b.path]
            t = Token("t", _text_code(code, b.text), code, 0, False, 0)
            tokens[t] = (tokens.get(t, (0, 0))[0] + 1, 0)
            mass[b.path] += b.running
            own[b.path] += 1
            held[b.path] = True
    for at in range(len(mass) - 1, 0, -1):  # parents have smaller numbers
        mass[paths.parent[at]] += mass[at]
        held[paths.parent[at]] |= held[at]
    for at in range(1, len(mass)):
        if held[at]:
            tokens[Token("p", paths.code[at], paths.code[paths.parent[at]], paths.depth[at], paths.leaf[at], paths.marked[at])] = (own[at] or 1, mass[at])
    return tokens


def _distinct(rows: DataFrame) -> DataFrame:
    """One row of each (host, html); only rows that are repeated are shuffled whole."""
    keyed = rows.withColumn("same", F.xxhash64("html"))
    repeated = stash(keyed.groupBy("host", "same").agg(F.count("*").alias("n")).where("n > 1").select("host", "same"), "repeated")
    again = keyed.join(repeated, ["host", "same"], "left_semi").dropDuplicates(["host", "same"])
    return keyed.join(repeated, ["host", "same"], "left_anti").unionByName(again).select("host", "html")


#: Vectors are sums of a page's code for each time that it has a token, modulo this prime; a host's tokens meet its page count in so many parts.
PRIME = (1 << 61) - 1
PARTS = 16


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, marked, texts): the code of each host's main slot (null if none holds most of its text), whether it is an article, and the codes of its template's block texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("host", pa.string()), ("kind", pa.string()), ("code", pa.int64()), ("around", pa.int64()), ("depth", pa.int64()), ("leaf", pa.bool_()), ("marked", pa.int64()), ("pages", pa.int64()), ("vector", pa.int64()), ("mass", pa.int64())])
        for batch in batches:
            sums: dict[tuple[str, Token], list[int]] = defaultdict(lambda: [0, 0, 0])
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = xxhash.xxh3_64_intdigest(page or "") % PRIME
                for token, (n, mass) in [*page_tokens(page).items(), (_PAGE, (1, 0))]:
                    s = sums[host, token]
                    s[0] += 1
                    s[1] = (s[1] + n * own) % PRIME
                    s[2] += mass
            rows = [(host, *token, *s) for (host, token), s in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    rows = only(pages, "url", "html").select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    each = _distinct(rows).mapInArrow(count, "host string, kind string, code long, around long, depth long, leaf boolean, marked long, pages long, vector long, mass long")
    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    sums = each.groupBy("host", "kind", "code").agg(*[F.max(c).alias(c) for c in ("around", "depth", "leaf", "marked")], F.sum("pages").alias("pages"), (big("vector") % F.lit(PRIME)).cast("long").alias("vector"), F.sum("mass").alias("mass"))
    sums = stash(sums.where(F.col("pages") >= LEAST_PAGES), "tokens")
    whole = sums.where("kind = ''").select("host", F.col("pages").alias("all"), F.col("vector").alias("body"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    common = sums.where("kind <> ''").withColumn("part", F.pmod("code", F.lit(PARTS)).cast("int")).join(whole, ["host", "part"]).where(F.col("pages") * 2 >= F.col("all"))
    # equivalence classes: equal vectors; the skeleton is the class of the page itself
    member = F.struct("kind", "code", "around", "depth", "leaf", "marked", "mass", (F.col("pages") == F.col("all")).alias("always"))
    classes = common.groupBy("host", "vector", "pages").agg(F.collect_list(member).alias("members"), F.max(F.col("vector") == F.col("body")).alias("skeleton"))
    own = F.transform(F.filter("members", lambda m: m["kind"] == "p"), lambda m: m["code"])
    bones = classes.where("skeleton").select("host", own.alias("bones"))
    # a class is valid if all of its tokens lie in its own paths, the skeleton's, or the page itself
    loose = F.array_except(F.transform("members", lambda m: m["around"]), F.concat(own, F.coalesce("bones", F.array().cast("array<bigint>")), F.array(F.lit(0).cast("long"))))
    valid = F.col("skeleton") | (F.size("members") > 1) & (F.size(loose) == 0)
    flat = classes.join(bones, "host", "left").select("host", "skeleton", valid.alias("valid"), F.explode("members").alias("m")).select("host", "skeleton", "valid", "m.*")
    path = F.col("kind") == "p"
    slots = F.array_sort(F.collect_list(F.when(F.col("skeleton") & path & ~F.col("leaf"), F.struct((-F.col("depth")).alias("up"), "code", "marked", "mass")))).alias("slots")
    texts = F.collect_set(F.when(~path & (F.col("valid") | F.col("always")), F.col("code"))).alias("texts")
    per = flat.groupBy("host").agg(F.max(F.when(path, F.col("mass"))).alias("total"), slots, texts)
    per = per.select("host", "texts", F.get(F.filter("slots", lambda p: p["mass"] >= F.col("total") * MAIN_SHARE), F.lit(0)).alias("slot"))
    return per.select("host", F.when(F.col("slot.marked") != 0, F.col("slot.marked")).otherwise(F.col("slot.code")).alias("main"), (F.col("slot.marked") != 0).alias("marked"), "texts")


def slot_text(page: str | None, main: int | None = None, marked: bool | None = False, texts: frozenset[int] = frozenset()) -> str:
    """The blocks of a page's main slot that aren't out, joined by two line ends."""
    paths, found = blocks(page)
    got = [b for b in found if not b.out]
    under = paths.under(main) if main else None
    kept = [b for b in got if under[b.path]] if under and marked else []
    if not kept:
        fresh = [b for b in got if _text_code(paths.code[b.path], b.text) not in texts] if texts else got
        kept = [b for b in fresh if under[b.path]] if under else []
        kept = kept or fresh
        own = [b for b in kept if b.within]
        if own and sum(b.running for b in own) >= MAIN_SHARE * sum(b.running for b in kept):
            kept = own
    return "\n\n".join(b.text for b in kept)


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars.

    The whole html is read, however long or deep; a null one is empty, and so is
    the text of a page without main text. Repeated rows and null ids or urls
    come out as they come in (pages without a host share a template); an empty
    table gives no rows; other columns are ignored. Templates go to all
    executors if they are at most BROADCAST_ROWS with BROADCAST_TEXTS texts, else
    pages meet them in a join by host.
    """
    made = stash(templates(pages), "templates")
    size = made.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(F.size("texts")), F.lit(0))).first()
    few = size[0] <= BROADCAST_ROWS and size[1] <= BROADCAST_TEXTS
    rows = only(pages, "page_id", "url", "html").select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    rows = dealt(rows)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    known = None
    if few:
        known = pages.sparkSession.sparkContext.broadcast({r[0]: (r[1], r[2], frozenset(r[3])) for r in made.collect()})
    else:
        rows = rows.join(made, "host", "left").select("page_id", "url", "html", "host", "main", "marked", "texts")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (None, False, frozenset())
        for batch in batches:
            htmls = batch.column(2).to_pylist()
            if known is not None:
                found = [known.value.get(h, none) for h in batch.column(3).to_pylist()]
            else:
                found = [(m, k, frozenset(t or ())) for m, k, t in zip(*(batch.column(i).to_pylist() for i in (4, 5, 6)), strict=True)]
            out = [slot_text(h, *f) for h, f in zip(htmls, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
