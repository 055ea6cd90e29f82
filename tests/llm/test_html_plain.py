"""Main text against a plain version of its method: explicit occurrence vectors, tuples as paths, the standard library's parser."""

import os
from collections import defaultdict
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from arbora.llm import html_text as H


class Plain(HTMLParser):
    """The blocks of a well-formed page (paragraphs may lack their end): [path, text, out, within, linked]."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.open, self.parts, self.found = [], [], []
        self.feed(page or "")
        self.close()
        self.flush()

    def path(self):
        return tuple(n for n, *_ in self.open if n in H.BLOCK)

    def flush(self):
        text = " ".join("".join(t for t, _ in self.parts).split())
        if text:
            blocks = [x for x in self.open if x[0] in H.BLOCK]
            self.found.append((self.path(), text, bool(blocks) and blocks[-1][1], any(w for *_, w in self.open), sum(len(t) for t, a in self.parts if a)))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append((" ", False))
        if tag in H.BLOCK:
            self.flush()
            if self.open and [x for x in self.open if x[0] in H.BLOCK][-1:] and [x for x in self.open if x[0] in H.BLOCK][-1][0] == "p":
                while self.open.pop()[0] != "p":
                    pass
        if tag not in H.VOID:
            text = " ".join(f'{k}="{v or ""}"' for k, v in attrs)
            within = any(w for *_, w in self.open)
            out = any(o for _, o, _ in self.open) or H._out(tag, text, within)
            self.open.append((tag, out, tag in ("article", "main") and not out))

    def handle_endtag(self, tag):
        if tag in H.BLOCK:
            self.flush()
        if any(x[0] == tag for x in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if any(x[0] in H.RAW for x in self.open):
            return
        blocks = [x for x in self.open if x[0] in H.BLOCK]
        if not any(o for _, o, _ in self.open) or blocks and blocks[-1][1]:
            self.parts.append((data, any(x[0] == "a" for x in self.open[-4:])))


def _host(url):
    return (urlsplit(url).netloc if "://" in (url or "") else "").lower()


def plain_main_texts(pages):
    """(page_id, text) of each of the pages (page_id, url, html), and of how many pages the template gave the slot."""
    hosts = defaultdict(set)
    for _, url, page in pages:
        hosts[_host(url)].add(page)
    made = {}
    for host, distinct in hosts.items():
        vectors, mass = defaultdict(lambda: [0] * len(distinct)), defaultdict(int)
        for k, page in enumerate(sorted(distinct, key=str)):
            kept = [b for b in Plain(page).found if not b[2]]
            for path, text, _, _, linked in kept:
                vectors["t", path, text][k] += 1
                vectors["p", path][k] += 1
                for n in range(1, len(path) + 1):
                    mass[path[:n]] += max(0, len(text) - linked)
            for path, *_ in kept:
                for n in range(1, len(path)):
                    vectors["p", path[:n]][k] = vectors["p", path[:n]][k] or 1
        often = {t: tuple(v) for t, v in vectors.items() if t[1] and sum(x > 0 for x in v) >= max(H.LEAST_PAGES, len(v) / 2) or t[0] == "t" and sum(x > 0 for x in v) >= max(H.LEAST_PAGES, len(v) / 2)}
        classes = defaultdict(set)
        for t, v in often.items():
            classes[v].add(t)
        body = (1,) * len(distinct)
        bones = {t[1] for t in classes[body] if t[0] == "p"}
        texts = set()
        for v, members in classes.items():
            held = {t[1] for t in members if t[0] == "p"} | bones | {()}
            nested = all((t[1] if t[0] == "t" else t[1][:-1]) in held for t in members)
            valid = v == body or len(members) > 1 and nested
            texts |= {t for t in members if t[0] == "t" and (valid or all(v))}
        total = max((mass[t[1]] for t in often if t[0] == "p"), default=0)
        slots = [p for p in bones if p[-1] not in H._LEAF and mass[p] >= H.MAIN_SHARE * total]
        main = max(slots, key=len, default=None)
        marks = [n for n in range(len(main or ()), 0, -1) if main[n - 1] in ("article", "main")]
        made[host] = (main[: marks[0]] if marks else main, bool(marks), texts)
    out, deduced = [], 0
    for page_id, url, page in pages:
        main, marked, texts = made[_host(url)]
        got = [b for b in Plain(page).found if not b[2]]
        slot = [b for b in got if main and b[0][: len(main)] == main]
        running = lambda bs: sum(max(0, len(b[1]) - b[4]) for b in bs)
        deduced += bool(slot)
        if not (slot and marked):
            fresh = [b for b in got if ("t", b[0], b[1]) not in texts]
            slot = [b for b in fresh if b in slot] or fresh
            own = [b for b in slot if b[3]]
            if own and running(own) >= H.MAIN_SHARE * running(slot):
                slot = own
        out.append((page_id, "\n\n".join(b[1] for b in slot)))
    return out, deduced


def _made_pages():
    """Hosts with and without articles: lists, boxes on some pages, lines on all or most, teasers, comments, copies."""
    pages = []
    text = lambda h, k: f"Host {h} tells story {k} at length: " + " ".join(f"word{(h * 31 + k * 17 + i * 7) % 101}" for i in range(40)) + "."
    for h in range(8):
        for k in range(h + 3):
            body = [f"<div class='{'top' if h % 2 else 'menu'}'><ul><li><a href=/a>News</a></li><li><a href=/b>Sport</a></li></ul></div>", "<div><p>All rights reserved by us.</p></div>"]
            inner = f"<h1>Title {k}</h1><p>{text(h, k)}</p><div><p>More &amp; more {k}</p><p>Read on</p></div>"
            body.append(f"<article>{inner}</article>" if h % 3 == 0 else f"<div><div>{inner}</div></div>" if h % 3 == 1 else f"<article class=card><p>Teaser {k % 2}</p></article><main><section>{inner}</section></main>")
            if k % 2:
                body.append("<section><h4>Our shop</h4><p>Buy this now.</p></section>")
            body.append(f"<article class='comment even'><p>I liked story {k}</p></article><div class=comments><p>Me too {k}</p></div><footer>&copy; us</footer>")
            page = f"<html><head><title>x</title></head><body><header>Top</header>{''.join(body)}</body></html>"
            pages += [(len(pages), f"https://H{h}.Example/{k}?q", page)] * (2 if k == 1 else 1)
    return [*pages, (9000, None, None), (9001, "nohost", "<p>lone"), (9002, "x://empty/", "")]


def test_main_text_is_the_plain_method(spark, monkeypatch):
    pages = _made_pages()
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want, deduced = plain_main_texts(pages)
    assert deduced > 40 and sum("Teaser" in t for _, t in want) < len(want) / 2
    assert sorted((r.page_id, r.text) for r in H.main_text(df).collect()) == sorted(want)
    monkeypatch.setattr(H, "BROADCAST_TEXTS", 0)  # the join by host gives the same
    assert sorted((r.page_id, r.text) for r in H.main_text(df).collect()) == sorted(want)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_main_text_of_the_tables(spark, sf):
    d = f"/root/testdata/{sf}"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    df = spark.read.parquet(f"{d}/pages.parquet")
    want, _ = plain_main_texts([tuple(r) for r in df.select("page_id", "url", "html").collect()])
    assert sorted((r.page_id, r.text) for r in H.main_text(df).collect()) == sorted(want)
    # without their article's marks the template alone must find the same texts on hosts with enough pages
    bare = df.withColumn("html", F.regexp_replace("html", "(</?)article", "$1div"))
    found = {r.page_id: r.text for r in H.main_text(bare).collect()}
    many = {_host(r.url) for r in df.groupBy("url").count().collect()}
    size = {h: len({r.html for r in df.collect() if _host(r.url) == h}) for h in many}
    held = [found[r.page_id] == t for r, (_, t) in zip(df.collect(), want, strict=True) if size[_host(r.url)] >= H.LEAST_PAGES]
    print(sf, sum(held), len(held))
    assert sum(held) >= 0.9 * len(held)


def test_probes():
    assert H.slot_text("<p title='the hidden truth'>Keep me.</p><a href='/hidden-gems'>gem</a><p data-id='share 5' data-role=ad>D</p><p hidden>no<p>yes") == "Keep me.\n\ngem\n\nD\n\nyes"
    assert H.slot_text("<article><header class=entry-header><h1 class='entry-header'>T</h1></header><p>x</article><article class='comment'>no</article><article id=comment-7>no</article>") == "T\n\nx"
    deep = "<div>" * 20000 + "at the end"
    paths, found = H.blocks(deep)
    assert len(paths.code) == 20001 and found[0].text == "at the end" and H.slot_text(deep) == "at the end"
    assert len(H.page_tokens("<li>same</li>" * 100000)) == 2
