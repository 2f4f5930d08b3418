"""Main text of web pages by union-free wrapper inference.

Each page becomes a stream of tags and text slots.  Runs of equal stretches in it are
folded into repeated groups.  The distinct folded streams of a host are aligned one after
another into a wrapper, a regular expression without unions: what both have stays, what one
lacks becomes optional, a group that occurs once or more is repeated.  Slots align only with
slots of the same containers.

Every slot of the wrapper gathers what its pages show there: on how many there is text, how
much, how much of it in links, and whether it is the same.  Text that is the same on all
pages is template, and repeated groups of links are menus.  Of the other slots, those in the
region with most text that varies are content; the region is <article> or <main> if the wrapper
has slots there, and what the words of class, id and role or the element call a menu, header,
footer, aside, form, advert, notice or comment is none.  A page is read by matching its
folded stream against its host's wrapper, and taking the text of the slots that are content.

Equal streams of a task meet before the shuffle; a host's wrappers are joined in a tree of
fixed fan-in, so a host of any share of the pages is no single task's work.  Wrappers are
sent to every executor only if measured small, and are joined else.

Decided cases: null and empty html give the empty text; pages without a known host share
one wrapper; a page that is all boilerplate gives the empty text; a page with none of its host's
content slots is read by a wrapper of its own; malformed markup is read
as browsers do, roughly: a closing tag without its opening one is ignored, and one that
skips open elements closes them; repeated rows give repeated results; extra columns are left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from html import unescape
from math import ceil, log

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, record, table, written

_RAW = "script|style|noscript|template|iframe|textarea|title|svg|select|option|object|xmp"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attr>[^>]*)>|<[!?/][^>]*>",
    re.I | re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Elements that say where text stands; the others don't belong to a slot's path.
_CONTAINER = frozenset("html head body nav header footer aside main article section div form ul ol dl table figure fieldset menu dialog button details".split())
_OUTER = frozenset("head nav header footer aside form menu dialog button fieldset".split())
#: A class, id or role with one of these words marks boilerplate.
_OUTER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices "
    "alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer header masthead comment comments "
    "disqus reply replies share sharing social related recommended newsletter subscribe subscription signup login search toolbar pagination pager".split()
)
_MAIN = frozenset(("article", "main"))
#: The few of them that count on <article> and <main>; on <html> and <body>, which speak of the whole page, none does.
_OUTER_ARTICLE = _OUTER_WORDS & frozenset("ad advert advertisement promo sponsored comment comments reply replies related".split())
#: Wrappers that one task joins, about.
FAN_IN = 16
#: Bytes of all wrappers up to which every executor gets them.
SENT_TO_ALL = 16 << 20
#: Pages on which a slot must show the same text to be a part of the template, and texts of a slot that are told apart.
_PAGES, _TEXTS = 5, 4


# -- pages as streams -------------------------------------------------------


@lru_cache(maxsize=20_000)
def _symbol(tag: str, attr: str) -> tuple[str, bool]:
    """An opening tag with its names' words, and whether these mark boilerplate."""
    words = [w.lower() for m in _NAMES.finditer(attr) for w in _WORDS.findall(m[1] or m[2] or m[3] or "")]
    telling = () if tag in ("html", "body") else _OUTER_ARTICLE if tag in _MAIN else _OUTER_WORDS
    outer = tag in _OUTER or any(w in telling for w in words)
    kind = "!" if outer else "*" if tag in _MAIN or "main" in words and tag in _CONTAINER else ""
    return ".".join([kind + tag, *sorted(set(words))[:3]]), outer


def stream(html: str) -> Iterator[tuple[str, str, str]]:
    """(symbol, path, text) in page order; symbol is '#' for a text, else text is empty.

    A path lists the open containers; an element with a telling class is one.
    """
    stack: list[tuple[str, str, str]] = []
    path, at = "", 0
    for m in _TOKEN.finditer(html):
        if m.start() > at and (text := html[at : m.start()]) and not text.isspace():
            yield "#", path, text
        elif m.start() > at:
            yield " ", path, " "
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in _VOID:
            yield tag, path, ""
        elif m["close"]:
            if any(t == tag for t, _, _ in stack):
                while stack:
                    t, _, path = stack.pop()
                    if t == tag:
                        break
            yield "/" + tag, path, ""
        else:
            symbol, outer = _symbol(tag, m["attr"])
            if tag in _CONTAINER or outer or symbol[0] == "*":
                stack.append((tag, symbol, path))
                path = f"{path}/{symbol}"
            elif tag == "a":
                stack.append((tag, symbol, path))
                path = f"{path}/a"
            yield symbol, path, ""
    if at < len(html):
        yield "#", path, html[at:]


class Page:
    """A page's folded stream, and the texts of its slots."""

    def __init__(self, html: str):
        symbols: list[str] = []
        self.paths: list[str] = []
        self.texts: list[list[str]] = []  # of each slot: pieces of text
        self.links: list[int] = []  # characters inside links
        self.glued: list[bool] = []  # whether a slot goes on in the block of the one before
        open_slot = False
        for symbol, path, text in stream(html):
            if text:
                bare = path.removesuffix("/a")
                same = open_slot and self.paths[-1] == bare
                if not same and symbol == " ":
                    if open_slot:
                        self.texts[-1].append(" ")
                    continue
                if not same:
                    symbols.append("#" + bare)
                    self.paths.append(bare)
                    self.texts.append([])
                    self.links.append(0)
                    self.glued.append(open_slot)
                self.texts[-1].append(unescape(text))
                if path != bare:
                    self.links[-1] += len(text)
                open_slot = True
            elif symbol.lstrip("/!*").split(".")[0] not in _INLINE:
                symbols.append(symbol)
                open_slot = False
        self.items, self.slots = folded(symbols)

    def statistics(self) -> list[list]:
        """For each slot of the folded stream: [pages, characters, those in links, hashes of the text]."""
        out = []
        for own in self.slots:
            text = "".join(x for k in own for x in self.texts[k])
            out.append([1, len(text), sum(self.links[k] for k in own), [xxhash.xxh3_64_intdigest(" ".join(text.split()).encode())]])
        return out

    def read(self, content: list[bool]) -> str:
        """The text of the folded slots that are content: blocks with single spaces, joined by one space."""
        wanted = [False] * len(self.texts)
        for own, good in zip(self.slots, content, strict=True):
            if good:
                for k in own:
                    wanted[k] = True
        out, apart = [], True
        for good, glued, pieces in zip(wanted, self.glued, self.texts, strict=True):
            apart = apart or not glued
            if good:
                out += [" ", *pieces] if apart else pieces
                apart = False
        return " ".join("".join(out).split())


def folded(symbols: list[str]) -> tuple[list, list[list[int]]]:
    """Neighbouring equal stretches of up to 12 symbols become ('+', stretch); with the numbers of the slots at each of its slots."""
    out: list = []
    held: list[list[list[int]]] = []  # for each item, for each slot in it
    n_slots = 0
    for x in symbols:
        out.append(x)
        held.append([])
        if x[0] == "#":
            held[-1].append([n_slots])
            n_slots += 1
        again = True
        while again:
            again = False
            n = len(out)
            for k in range(1, min(12, n - 1) + 1):
                body = out[n - k - 1]
                if isinstance(body, tuple) and len(body[1]) == k and out[n - k :] == list(body[1]):
                    for own, more in zip(held[n - k - 1], [s for h in held[n - k :] for s in h], strict=True):
                        own += more
                    del out[n - k :], held[n - k :]
                    again = True
                    break
                if 2 * k <= n and out[-1] == out[-1 - k] and out[n - k :] == out[n - 2 * k : n - k]:
                    slots = [s for h in held[n - 2 * k : n - k] for s in h]
                    for own, more in zip(slots, [s for h in held[n - k :] for s in h], strict=True):
                        own += more
                    if k == 1 and isinstance(out[-1], tuple):
                        out.pop()
                        held.pop()
                    else:
                        out[n - 2 * k :] = [("+", tuple(out[n - k :]))]
                        held[n - 2 * k :] = [slots]
                    again = True
                    break
    return out, [s for h in held for s in h]


def fold(symbols: list[str]) -> list:
    return folded(symbols)[0]


# -- wrappers ---------------------------------------------------------------


def leaves(x) -> list[str]:
    """The symbols of an item, those of a group once."""
    return [s for y in x[1] for s in leaves(y)] if isinstance(x, tuple) else [x]


def n_slots(x) -> int:
    return sum(s[0] == "#" for s in leaves(x))


def _sum(a: list[list], b: list[list]) -> list[list]:
    """Statistics of the same slots together."""
    return [[p + q, c + d, i + j, sorted({*h, *g})[:_TEXTS]] for (p, c, i, h), (q, d, j, g) in zip(a, b, strict=True)]


def _within(a: list[list], b: list[list], most: int | None) -> list[list]:
    """Statistics of slots that one page has several times in a group."""
    return [[max(p, q), c + d, i + j, sorted({*h, *g})[:most]] for (p, c, i, h), (q, d, j, g) in zip(a, b, strict=True)]


def lifted(items: list, statistics: list[list] | None = None) -> list[tuple]:
    """A folded stream as a wrapper: items (symbol or ('+', stretch), optional, statistics of its slots)."""
    out, at = [], 0
    for x in items:
        n = n_slots(x)
        out.append((x, False, statistics[at : at + n] if statistics else [[1, 0, 0, []]] * n))
        at += n
    return out


def _gather(items: list[tuple], bodies: set, most: int | None = _TEXTS) -> list[tuple]:
    """Single occurrences of known repeated stretches become the repeated group."""
    for body in sorted(bodies, key=lambda b: (len(b), str(b)), reverse=True):
        k, out, at = len(body), [], 0
        while at < len(items):
            part = items[at : at + k]
            if tuple(x for x, _, _ in part) == body:
                group = (("+", body), all(o for _, o, _ in part), [s for *_, own in part for s in own])
                if out[-1:] and out[-1][0] == group[0]:
                    _, optional, own = out.pop()
                    group = (group[0], group[1] and optional, _within(own, group[2], most))
                out.append(group)
                at += k
            else:
                out.append(items[at])
                at += 1
        items = out
    return items


def align(wrapper: list[tuple], other: list[tuple]) -> list[tuple]:
    """The wrapper of both."""
    bodies = {x[1] for x, *_ in (*wrapper, *other) if isinstance(x, tuple)}
    wrapper, other = _gather(wrapper, bodies), _gather(other, bodies)
    both = lambda u, v: [(x, o or p, _sum(s, t)) for (x, o, s), (_, p, t) in zip(u, v, strict=True)]
    a, b = [x for x, *_ in wrapper], [x for x, *_ in other]
    if a == b:
        return both(wrapper, other)
    out = []
    for op, i, j, k, n in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            out += both(wrapper[i:j], other[k:n])
        else:
            out += [(x, True, s) for x, _, s in (*wrapper[i:j], *other[k:n])]
    return out


def infer(streams: list[list]) -> list[tuple]:
    """One wrapper of folded streams, aligned from the first on."""
    wrapper = lifted(streams[0])
    for s in streams[1:]:
        wrapper = align(wrapper, lifted(s))
    return wrapper


def expression(wrapper: list[tuple]) -> str:
    """The wrapper as text: (…)+ repeated, […] optional, # a text slot."""

    def item(x) -> str:
        return f"({' '.join(map(item, x[1]))})+" if isinstance(x, tuple) else "#" if x[0] == "#" else x

    return " ".join(f"[{item(x)}]" if o else item(x) for x, o, *_ in wrapper)


_LISTS = frozenset("ul ol dl table figure details".split())


def content_slots(wrapper: list[tuple]) -> list[bool]:
    """For each slot of the wrapper, whether it is content."""
    slots = [(leaf[1:], isinstance(x, tuple), s) for x, _, own in wrapper for leaf, s in zip([y for y in leaves(x) if y[0] == "#"], own, strict=True)]
    menu = [group and 10 * link > 9 * chars for _, group, (_, chars, link, _) in slots]
    inner = ["/!" not in path for path, *_ in slots]
    main = [ok and "/*" in path for ok, (path, *_) in zip(inner, slots, strict=True)]
    if any(main):
        region = main
    else:
        def plain_text(varying: bool) -> dict[str, int]:
            """Characters outside links by containers."""
            sums: dict[str, int] = {}
            for (path, _, (_, chars, link, texts)), ok, m in zip(slots, inner, menu, strict=True):
                if ok and not m and (not varying or len(texts) != 1):
                    sums[path] = sums.get(path, 0) + chars - link
            return sums

        plain = plain_text(True)
        if not any(plain.values()):  # one page, or copies of it
            plain = plain_text(False)
        best = max(plain, key=lambda p: (plain[p], p), default=None)
        if best is None or plain[best] <= 0:
            return [False] * len(slots)
        while best.count("/") > 1 and best.rsplit("/", 1)[1] in _LISTS:
            best = best.rsplit("/", 1)[0]
        region = [ok and (path == best or path.startswith(best + "/")) and not m for ok, m, (path, *_) in zip(inner, menu, slots, strict=True)]
    same = [len(texts) == 1 and n >= _PAGES for *_, (n, _, _, texts) in slots]
    shown = sum(c for good, (*_, (_, c, _, _)) in zip(region, slots, strict=True) if good)
    fixed = sum(c for good, t, (*_, (_, c, _, _)) in zip(region, same, slots, strict=True) if good and t)
    if 2 * fixed > shown:  # the pages are copies of each other: nothing tells the template
        return region
    return [good and not t for good, t in zip(region, same, strict=True)]


def _as_items(data) -> list[tuple]:
    def item(x):
        return ("+", tuple(map(item, x[1]))) if isinstance(x, list) else x

    return [(item(x), bool(o), s) for x, o, s in data]


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, n_pages) of (host, html): JSON of the items of each host's wrapper."""

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], list] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = []
            for (host, items), (n, statistics) in seen.items():
                rows.append((host, json.dumps(lifted(_read_items(items), statistics)), n))
            seen.clear()
            cells = list(zip(*rows, strict=True)) or [()] * 3
            return record(host=pa.array(cells[0], pa.string()), wrapper=pa.array(cells[1], pa.string()), n=pa.array(cells[2], pa.int64()))

        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(html or "")
                key = host, json.dumps(page.items)
                known = seen.get(key)
                if known:
                    known[0] += 1
                    known[1] = _sum(known[1], page.statistics())
                else:
                    seen[key] = [1, page.statistics()]
                    size += len(key[1]) + 100 * len(page.slots)
                if size > 32 << 20:
                    yield out()
                    size = 0
        yield out()

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        """One wrapper of the rows' wrappers, the most frequent first."""
        pdf = pdf.sort_values(["n", "wrapper"], ascending=[False, True])
        wrapper = None
        for s in pdf["wrapper"]:
            items = _as_items(json.loads(s))
            wrapper = items if wrapper is None else align(wrapper, items)
        return pd.DataFrame({"host": pdf["host"].iloc[:1].tolist(), "wrapper": [json.dumps(wrapper)], "n": [int(pdf["n"].sum())]})

    schema = "host string, wrapper string, n long"
    found = written(pages.select("host", "html").mapInArrow(streams, schema), "html-streams")
    most = found.groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    for level in range(ceil(log(most, FAN_IN)) - 1 if most > 1 else 0, -1, -1):
        place = F.pmod(F.xxhash64("wrapper"), F.lit(FAN_IN**level))
        found = written(found.withColumn("place", place).groupBy("host", "place").applyInPandas(joined, schema), "html-wrappers")
    return found.withColumnRenamed("n", "n_pages")


# -- extraction -------------------------------------------------------------


def _read_items(items: str) -> list:
    return [x for x, *_ in _as_items([(x, False, None) for x in json.loads(items)])]


def matched(wrapper: list[tuple], content: list[bool], items: list) -> list[bool]:
    """For each slot of a page's folded stream, whether the slot of the wrapper that it meets is content.

    A slot that meets none, as alignments needn't find the same way twice, goes with those of its containers.
    """
    page = _gather(lifted(items, [[1, 0, 0, [k]] for k in range(sum(map(n_slots, items)))]), {x[1] for x, *_ in wrapper if isinstance(x, tuple)}, None)
    first = [0]
    for x, *_ in wrapper:
        first.append(first[-1] + n_slots(x))
    paths = [leaf[1:] for x, *_ in wrapper for leaf in leaves(x) if leaf[0] == "#"]
    inside = {p for p, good in zip(paths, content, strict=True) if good}
    a, b = [x for x, *_ in wrapper], [x for x, *_ in page]
    meets: dict[int, int] = {}
    for i, k, n in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks():
        meets |= {k + step: first[i + step] for step in range(n)}
    own = [leaf[1:] for x in items for leaf in leaves(x) if leaf[0] == "#"]
    out = [p in inside for p in own]
    for at, begin in meets.items():
        for step, (*_, held) in enumerate(page[at][2]):
            for k in held:
                out[k] = content[begin + step]
    return out


class Reader:
    """Reads pages of some hosts by their wrappers; what a folded stream meets is worked out once."""

    def __init__(self):
        self.hosts: dict[str, tuple[list[tuple], list[bool]]] = {}
        self.known: dict[tuple[str, str], list[bool]] = {}

    def text(self, host: str, wrapper: str, html: str) -> str:
        page = Page(html)
        key = host, json.dumps(page.items)
        content = self.known.get(key)
        if content is None:
            if host not in self.hosts:
                if len(self.hosts) > 2_000:
                    self.hosts.clear()
                items = _as_items(json.loads(wrapper))
                self.hosts[host] = items, content_slots(items)
            if len(self.known) > 20_000:
                self.known.clear()
            content = self.known[key] = matched(*self.hosts[host], page.items)
        if not any(content):
            own = content_slots(lifted(page.items, page.statistics()))
            return page.read(own)
        return page.read(content)


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of `pages`."""
    hosted = pages.select("page_id", "url", "html", host_of().alias("host"))
    known = wrappers(hosted).select("host", "wrapper")
    size = known.agg(F.sum(F.length("host") + F.length("wrapper"))).first()[0] or 0
    names = "page_id long, url string, text string, n_chars long"

    def read(batch: pa.RecordBatch, wrapper_of: list[str], reader: Reader) -> pa.RecordBatch:
        rows = zip(batch.column(3).to_pylist(), wrapper_of, batch.column(2).to_pylist(), strict=True)
        texts = [reader.text(host, wrapper, html or "") for host, wrapper, html in rows]
        return record(page_id=batch.column(0), url=batch.column(1), text=pa.array(texts, pa.string()), n_chars=pa.array([len(t) for t in texts], pa.int64()))

    if size <= SENT_TO_ALL:
        sent = pages.sparkSession.sparkContext.broadcast({r.host: r.wrapper for r in known.collect()})

        def make():
            reader = Reader()

            def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                yield read(batch, [sent.value[h] for h in batch.column(3).to_pylist()], reader)

            return step

        return map_rows(hosted, make, names, 256)

    def make_joined():
        reader = Reader()

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield read(batch, batch.column(4).to_pylist(), reader)

        return step

    # a host's pages lie in several tasks, each with its wrapper once for each of them
    spread = hosted.withColumn("copy", F.pmod(F.xxhash64("page_id", "url"), F.lit(FAN_IN)))
    copies = known.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FAN_IN - 1).cast("long"))))
    ruled = spread.join(copies, ["host", "copy"]).select("page_id", "url", "html", "host", "wrapper")
    return map_rows(ruled, make_joined, names, 256)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
