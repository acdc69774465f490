"""Main text of web pages by equivalence classes of template tokens.

1. Every page becomes tokens: tags, told apart by their path (element names with class and id), and the words of short text
   runs, told apart by the path they stand in.
2. Pages of one host vote: tokens with the same occurrence vector (as often as each other on every page) form a class. The
   vector is kept as two sums over halves of hash(page, count), so it adds up before the shuffle and a large host needs no
   list of its pages; a repeated row adds the same to all tokens of its page. A class is frequent if it is on at least half of the host's pages (and on ``SUPPORT``), and
   valid if its tokens come in the same order on every page.
3. Valid classes nest by their paths into the host's template. The text between template tokens are the slots; the slot that
   holds the article is the deepest template container with at least ``SHARE`` of the host's running text, or the article
   or main element around it if there is one, so that a heading beside the container stays.
4. A run that stands word for word on a frequent number of the host's different pages is a class of its own (its words occur
   equally often, in one order). Such template runs do not count as running text and are no main text. List items, terms and
   table cells of one word are values that articles share and do not vote.
5. What a page has in that slot between the template runs is its main text, without menus, headers, footers, side bars,
   forms, scripts and styles by their element. Names in class, id and role are an additional aid: they leave out notices,
   adverts and reader comments that differ from page to page, but not an element that holds over ``MOST`` of the running
   text of the pages that have it (an element called comments: over ``SHARE``). A page without the slot (or a host too small
   for a template) gives everything that is not such an element.

Defined cases: null or empty html gives an empty text; a page without host belongs to the host ''; broken markup is read to
its end (an open tag at the end is dropped, open elements are closed); repeated rows give a row each; extra columns are
ignored. A page whose slot holds nothing but template runs stays. ``head`` ends where
content starts, as browsers read it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourpanel.session import materialise

from .common import slices

SUPPORT = 3
SHARE = 0.9
MOST = 0.5
SHORT_RUN = 8
#: Templates of so many hosts (a path each) may be sent to all tasks; more are joined by a shuffle.
BROADCAST_HOSTS = 100_000

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>?|<[a-zA-Z][^>]*\Z", re.S | re.I)
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_OUTSIDE = frozenset("head nav footer aside form button dialog title object".split())
_OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner promo sponsor sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent "
    "notice gdpr popup modal newsletter subscribe signup login comment comments disqus respond reply replies share sharing social related widget footer masthead "
    "toolbar contentinfo complementary search dialog alert".split()
)
_COMMENT_NAMES = frozenset("comment comments disqus respond reply replies".split())
_VALUES = frozenset("li dt dd td th".split())
_HEAD = frozenset("html head title meta link base".split())


class _Open:
    __slots__ = ("link", "name", "named", "outside", "path", "plain")

    def __init__(self, name: str, path: str, plain: str, outside: bool, named: tuple[str, ...], link: bool) -> None:
        self.name, self.path, self.plain, self.outside, self.named, self.link = name, path, plain, outside, named, link


class Block(NamedTuple):
    path: str
    text: str
    linked: int  # characters inside links
    outside: bool  # the article, by an element's kind
    named: tuple[str, ...]  # elements around it that a listed name calls something else: element names and listed names
    run: int | None  # hash of the text under its element names; none for a value of one word


def blocks(page: str) -> tuple[list[Block], list[str]]:
    """Text blocks and the paths of all elements, in order."""
    found, opened = [], []
    stack = [_Open("", "", "", False, (), False)]
    parts: list[str] = []
    linked = 0
    home = stack[0]  # the block element that the text belongs to

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                run = xxhash.xxh64_intdigest(f"{home.plain} {text}") - (1 << 63) if " " in text or home.name not in _VALUES else None
                found.append(Block(home.path, text, linked, home.outside, home.named, run))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked, home
        if not text:
            return
        if stack[-1].name == "head" and text.strip():
            stack.pop()
        top = stack[-1]
        if (top.outside, top.named) != (home.outside, home.named) and parts:  # an inline element that does not belong to the article
            close()
        if not parts:
            around = next((o for o in reversed(stack) if o.name not in _INLINE), stack[0])
            home = around if (top.outside, top.named) == (around.outside, around.named) else top
        parts.append(text)
        linked += len(text) if top.link else 0

    at = 0
    for m in _TAG.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name not in _INLINE:
            close()
        elif name == "br":
            parts and parts.append(" ")
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
                if name in _INLINE and stack[i].name not in _INLINE:
                    break  # a stray end tag does not close a block
            continue
        if name not in _HEAD:  # </head> may be left out
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "head":
                    del stack[i:]
                    break
        if name in _CLOSES:
            while len(stack) > 1 and (stack[-1].name in _CLOSES[name] or stack[-1].name in _INLINE and any(o.name in _CLOSES[name] for o in stack[-3:])):
                stack.pop()
        elif name not in _INLINE:
            while len(stack) > 1 and (stack[-1].name == "p" or stack[-1].name in _INLINE and any(o.name == "p" for o in stack[-3:])):
                stack.pop()
        top = stack[-1]
        marks = [(k.lower(), re.sub(r"\d+", "0", (a or b or c).lower())) for k, a, b, c in _NAMED.findall(m[4])]
        path = f"{top.path}/{name}" + "".join(f"[{v}]" for k, v in marks if k != "role")
        words = {w for _, v in marks for w in re.split(r"[^a-z0-9]+", v)}
        inside = any(o.name in ("article", "main") for o in stack)
        outside = top.outside or name in _OUTSIDE or name == "header" and not inside
        plain, named = f"{top.plain}/{name}", top.named
        if name not in ("html", "body", "article", "main") and not words.isdisjoint(_OUTSIDE_NAMES):
            whole = not _COMMENT_NAMES.isdisjoint(w for _, v in marks for w in v.split())
            named = (*named, " ".join([plain, *sorted(words & _OUTSIDE_NAMES), *["only"] * whole]))
        opened.append(path)
        if name not in _VOID:
            stack.append(_Open(name, path, plain, outside, named, top.link or name == "a"))
    add(page[at:])
    close()
    return found, opened


def page_tokens(found: list[Block], opened: list[str]) -> list[tuple[str, int, int]]:
    """(token, how often, first place) of a page: element paths, and words of short runs under their path."""
    count: dict[str, list[int]] = {}
    for i, path in enumerate(opened):
        count.setdefault(path, [0, i])[0] += 1
    place = {p: i for i, p in reversed(list(enumerate(opened)))}
    for path, text, *_ in found:
        words = text.split()
        if len(words) <= SHORT_RUN:
            for w in words:
                count.setdefault(f"{path} {w}", [0, place.get(path, 0)])[0] += 1
    return [(t, n, at) for t, (n, at) in count.items()]


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of every page; (kind 1) its blocks with their text's length, 0 if it is mostly links; (kind 2) the running text
    below every element with a listed name, and in ``at`` that of the whole page."""
    types = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int64(), pa.int64())
    for batch in slices(batches, "html"):
        out = []
        for host, key, page in zip(*(batch.column(c).to_pylist() for c in ("host", "key", "html")), strict=True):
            found, opened = blocks(page)
            copy = xxhash.xxh64_intdigest(page) - (1 << 63)  # the same for exact copies
            out += [(host, key, 0, t, n, at, None, None, None) for t, n, at in page_tokens(found, opened)]
            below: dict[str, int] = {}
            total = 0
            for b in found:
                if not b.outside:
                    n = len(b.text) if b.linked * 2 <= len(b.text) else 0
                    out.append((host, key, 1, b.path, n, 0, list(b.named), b.run, copy))
                    total += n
                    for named in b.named:
                        below[named] = below.get(named, 0) + n
            out += [(host, key, 2, named, n, total, None, None, None) for named, n in below.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["host", "key", "kind", "token", "n", "at", "named", "run", "page"])


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def template_classes(tokens: DataFrame, sizes: DataFrame) -> DataFrame:
    """host, class, token of all frequent, valid classes. ``tokens``: host, key, token, n, at."""
    marked = tokens.withColumn("mark", F.xxhash64("key", "n"))
    low, high = F.col("mark").bitwiseAND((1 << 32) - 1), F.shiftrightunsigned("mark", 32)
    vectors = marked.groupBy("host", "token").agg(F.count("*").alias("pages"), F.sum(low).alias("low"), F.sum(high).alias("high"))
    frequent = vectors.join(sizes, "host").where((F.col("pages") >= SUPPORT) & (2 * F.col("pages") >= F.col("host_pages")))
    named = frequent.select("host", "token", F.xxhash64("pages", "low", "high").alias("class"))
    ordered = tokens.join(named, ["host", "token"]).groupBy("host", "class", "key").agg(F.sort_array(F.collect_set(F.struct("at", "token")))["token"].alias("tokens"))
    ordered = ordered.select("host", "class", F.hash("tokens").alias("order"), F.size("tokens").alias("size"))
    valid = ordered.groupBy("host", "class").agg(F.min("order").alias("low"), F.max("order").alias("high"), F.max("size").alias("size")).where("low = high and size >= 2")
    return named.join(valid.select("host", "class"), ["host", "class"])


def article_slots(pages: DataFrame) -> DataFrame:
    """host, slot: the template element that holds the article; kept: elements with a listed name that are no reason to leave
    text out; runs: the template's runs. ``pages``: host, key, html."""
    rows = materialise(pages.mapInArrow(_token_rows, "host string, key long, kind int, token string, n long, at int, named array<string>, run long, page long"), "tokens")
    sizes = pages.select("host").groupBy("host").agg(F.count("*").alias("host_pages"))
    template = template_classes(rows.where("kind = 0").select("host", "key", "token", "n", "at"), sizes)
    share = F.when(F.col("token").endswith(" only"), SHARE).otherwise(MOST)
    kept = rows.where("kind = 2").groupBy("host", "token").agg(F.sum("n").alias("n"), F.sum("at").alias("all")).where(F.col("n") > share * F.col("all"))
    kept = kept.groupBy("host").agg(F.collect_list("token").alias("kept"))
    different = pages.select("host", F.xxhash64("html").alias("page")).distinct().groupBy("host").agg(F.count("*").alias("host_pages"))
    told = rows.where("kind = 1")
    voted = told.where("run is not null").select("host", "run", "page").distinct().groupBy("host", "run").agg(F.count("*").alias("pages"))
    frequent = voted.where(F.col("pages") >= SUPPORT).join(different, "host").where(2 * F.col("pages") >= F.col("host_pages")).select("host", "run")
    frequent = materialise(frequent, "runs")
    # a page's own running text: below every element of a block's path, by the listed names around it
    steps = F.split("token", "/")
    paths = F.transform(F.sequence(F.lit(2), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    own = told.where((F.col("n") > 0) & (F.size(steps) > 1)).join(frequent, ["host", "run"], "left_anti")
    below = own.select("host", "named", "n", F.explode(paths).alias("token")).groupBy("host", "token", "named").agg(F.sum("n").alias("n"))
    inside = below.join(kept, "host", "left").where(F.size(F.array_except("named", F.coalesce("kept", F.array().cast("array<string>")))) == 0)
    running = inside.groupBy("host", "token").agg(F.sum("n").alias("chars"))
    total = running.groupBy("host").agg(F.max("chars").alias("most"))  # the outermost element holds all of it
    fit = running.join(template.select("host", "token").distinct(), ["host", "token"]).join(total, "host").where(F.col("chars") >= SHARE * F.col("most"))
    fit = fit.where(F.col("token").rlike(r"/(html|body|main|article|section|div|center|td)(\[[^/]*\])?$"))
    deep = F.size(F.split("token", "/"))
    best = fit.groupBy("host").agg(F.max(F.struct(deep.alias("deep"), "chars", "token")).alias("best")).select("host", F.col("best.token").alias("token"))
    around = F.regexp_extract("token", r"^(.*?/(?:article|main)(?:\[[^/]*\])?)(?:/|$)", 1)
    slots = best.select("host", F.when(around != "", around).otherwise(F.col("token")).alias("slot"))
    return slots.join(kept, "host", "full").join(frequent.groupBy("host").agg(F.collect_list("run").alias("runs")), "host", "full")


def main_text(page: str, slot: str | None, kept: frozenset[str], runs: frozenset[int]) -> str:
    found = [b for b in blocks(page)[0] if not b.outside and kept.issuperset(b.named)]
    inside = [b for b in found if slot is not None and (b.path == slot or b.path.startswith(slot + "/"))] or found
    return "\n".join(b.text for b in [b for b in inside if b.run not in runs] or inside)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        columns = (batch.column(c).to_pylist() for c in ("html", "slot", "kept", "runs"))
        texts = [main_text(p, s, frozenset(k or ()), frozenset(r or ())) for p, s, k, r in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    bare = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host_of(F.col("url")).alias("host"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    slots = materialise(article_slots(bare.select("host", F.xxhash64("page_id", "url", "html").alias("key"), "html")), "slots")
    side = F.broadcast(slots) if slots.count() <= BROADCAST_HOSTS else slots
    return bare.join(side, "host", "left").select("page_id", "url", "html", "slot", "kept", "runs").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
