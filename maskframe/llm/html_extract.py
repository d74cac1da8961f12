"""Main text of HTML pages: page structure, and a suffix array over each host's token streams.

Pages of a host are cut into blocks (text between block-level tags) that carry their zone: article, page furniture
(menus, headers, footers, sidebars, notices, adverts, forms, reader comments) or neither. The blocks' tokens of a
host's pages are concatenated with separators, and their suffixes are sorted up to ``SPAN`` tokens, so that equal
spans are neighbours. Spans that occur on pages with different articles are boilerplate: covered blocks go, unique runs stay.
A page's article element, where it has one, is its main text, and if it has several, the longest of them and those
others that aren't covered; elsewhere it is every block outside the furniture that isn't covered. Inside an article
repetition removes those parts whose class or id leaves in doubt whether they are furniture, and nothing else: articles
quote each other and repeat lines that adverts and footers hold too. Names count as a whole, and a compound by its last
word, so neither ``social-history`` nor a body that ``has-sidebar`` goes unless its text is repeated.

A host with more than ``PAGES`` pages is dealt into parts by the hash of the page, so that no task holds a whole large
host. Its evidence is counted over all its pages all the same: spans have 64-bit names, batches of pages name theirs
with up to ``ARTICLES`` of the articles they saw, the different articles of each span are counted across the batches,
and the parts only apply the marked spans. A large host whose pages all have a single article element has nothing to
decide, so its spans aren't counted.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.llm import words as W
from maskframe.llm.shared import ensure_importable, map_batches, shuffle_width, stored

PAGES = 400
BIN_BYTES = 4 << 20
SPAN = 8
#: Different articles that a span must be seen with to be boilerplate, and the share of a block under such spans.
ARTICLES = 3
COVERED = 0.9
BROADCAST_HOSTS = 200_000
#: Hosts whose common blocks are broadcast; each has a few dozen.
BROADCAST_COMMON = 10_000

# HTML's block-level, raw-text and furniture elements, and words in class, id and role attributes.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre search section select summary svg table tbody td template textarea tfoot th thead title tr ul video audio canvas".split())
RAW_TAGS = frozenset("script style textarea title template noscript iframe svg xmp noframes math canvas".split())
FURNITURE_TAGS = frozenset("nav aside form menu dialog button select footer search".split())
CONTAINERS = frozenset("div section ul ol dl table tbody tr td article main header details figure span p li fieldset blockquote head body a".split()) | FURNITURE_TAGS
FURNITURE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored sponsors
promo promotion promotions banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup signin login
sidebar rail aside nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs footer foot
masthead topbar toolbar bottombar related recommended recommendations trending share sharing follow popup modal overlay
pagination pager widget widgets copyright searchbox paywall tagcloud""".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies".split())
HEADER_WORDS = frozenset("header head sitehead pageheader siteheader".split())
#: Words that also name articles' own parts: they are hints that repetition must confirm.
DOUBTFUL_WORDS = frozenset("popular social legal register side skip tags search reply respond discussion reactions".split())
#: In a compound name the last word says what a thing is; these only say that it holds something.
HOLDER_WORDS = frozenset("slot box unit bar list links posts articles items buttons widget wrap wrapper container block area panel inner outer section content text row column".split())
#: A name that begins so says something about the element around it.
STATE_WORDS = frozenset("has no is with without show hide".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_MARKUP = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_TAG_END = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
OTHER, ARTICLE, DOUBTFUL, REMOVED, COMMENTS = 0, 1, 2, 3, 4


def _hint(name: str) -> tuple[str, bool]:
    """What one class or id says: "comments", "furniture", "header" or nothing, and whether without a doubt."""
    kinds = (("comments", COMMENT_WORDS), ("furniture", FURNITURE_WORDS), ("header", HEADER_WORDS))
    words = [name.lower()] if name.lower() in COMMENT_WORDS | FURNITURE_WORDS | HEADER_WORDS else [w.lower() for w in _WORDS.findall(name)]
    if not words or words[0] in STATE_WORDS:
        return "", False
    last = words[-1] if words[-1] not in HOLDER_WORDS or len(words) == 1 else words[-2]
    for kind, listed in kinds:
        if last in listed:
            return kind, True
    return ("furniture", False) if {words[0], last} & (COMMENT_WORDS | FURNITURE_WORDS | DOUBTFUL_WORDS) else ("", False)


def _zone_of(tag: str, attributes: str, above: int) -> int:
    """Zone that an element opens, under the zone it stands in. The whole page is never furniture."""
    hints: set[tuple[str, bool]] = set()
    role, hidden = "", False
    if attributes.strip() and tag not in ("html", "body"):
        for name, value in _ATTRIBUTE.findall(attributes):
            value = value.strip("\"'")
            name = name.lower()
            if name in ("class", "id"):
                hints.update(_hint(x) for x in value.split())
            elif name == "role":
                role = value.lower()
            elif name == "style":
                hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            else:
                hidden |= name == "hidden" or value.lower() == "true"
    if ("comments", True) in hints:
        return COMMENTS
    if tag in ("article", "main") or role in ("main", "article"):
        # an advert or a menu that was never closed doesn't swallow the article
        return ARTICLE
    if above >= REMOVED:
        return REMOVED
    if tag in FURNITURE_TAGS or tag == "head" or role in FURNITURE_ROLES or hidden or ("furniture", True) in hints:
        return REMOVED
    inside = above in (ARTICLE, DOUBTFUL)
    if not inside and (tag == "header" or ("header", True) in hints and not tag.startswith("h")):
        return REMOVED
    return DOUBTFUL if inside and ("furniture", False) in hints else above


def page_blocks(source: str) -> list[tuple[int, int, str]]:
    """(zone, article element, text) of each non-empty block in page order; white space as single spaces.

    In time linear in the page: a tag that is never closed is text, with all behind it, and once a quote is never
    closed, quotes no longer hide the ends of tags.
    """
    blocks: list[tuple[int, int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []
    open_tags: dict[str, int] = {}
    zone, articles, commented, quotes = OTHER, 0, 0, True

    def close() -> None:
        if held:
            text = "".join(held)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                blocks.append((zone, articles, text))
            held.clear()

    def pop() -> None:
        nonlocal commented
        tag, z = stack.pop()
        open_tags[tag] -= 1
        commented -= z == COMMENTS

    at, n = 0, len(source)
    while at < n:
        m = _MARKUP.search(source, at)
        if m is None:
            held.append(source[at:])
            break
        if m.start() > at:
            held.append(source[at : m.start()])
        comment, cdata, declaration, end, tag = m.groups()
        if tag is None:
            mark = "-->" if comment else "]]>" if cdata else ">"
            stop = source.find(mark, m.end())
            at = n if stop < 0 else stop + len(mark)
            continue
        closing = _TAG_END.match(source, m.end()) if quotes else None
        if closing is not None:
            attributes, at = closing[1], closing.end()
        else:
            stop = source.find(">", m.end())
            if stop < 0:
                held.append(source[m.start() :])
                break
            quotes, attributes, at = False, source[m.end() : stop], stop + 1
        tag = tag.lower()
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCK_TAGS:
            close()
        if not end and tag in RAW_TAGS and not attributes.endswith("/"):
            stop = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            at = stop.end() if stop else n
            continue
        if tag not in CONTAINERS:
            continue
        if end:
            if open_tags.get(tag):
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                if tag not in BLOCK_TAGS and stack[i][1] != (stack[i - 1][1] if i else OTHER):
                    close()
                while len(stack) > i:
                    pop()
                zone = stack[-1][1] if stack else OTHER
            continue
        if attributes.endswith("/") and tag in ("a", "span"):
            continue
        if tag in ("p", "li", "td", "tr") and stack and stack[-1][0] == tag:
            pop()  # closed by its successor
            zone = stack[-1][1] if stack else OTHER
        new = _zone_of(tag, attributes, zone)
        if commented:
            new = REMOVED  # an article element inside the reader comments is a comment
        if new != zone and tag not in BLOCK_TAGS:
            close()
        if tag in ("p", "span", "a") and new == zone:
            continue  # nothing to restore
        articles += tag == "article" and new == ARTICLE
        stack.append((tag, new))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        commented += new == COMMENTS
        zone = new
    close()
    return blocks


def _sorted_spans(tokens: np.ndarray, span: int) -> np.ndarray:
    """Rank of each suffix by its first ``span`` tokens; equal ranks are equal spans."""
    rank, step = tokens.astype(np.int64), 1
    while step < span:
        nxt = np.zeros(len(rank), np.int64)
        nxt[:-step] = rank[step:] + 1 if step < len(rank) else 0
        key = rank * (int(rank.max(initial=0)) + 2) + nxt
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.append(False, s[1:] != s[:-1])
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(new)
        step *= 2
    return rank


def _name(text: str) -> int:
    """64-bit name of a text, the same in every process."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


Blocks = list[tuple[int, int, str]]


def undecided(blocks: Blocks) -> bool:
    """Whether repetition has a say in the page's text: it has no article element, or several, or one with a part that
    may be furniture."""
    units = {a for z, a, _ in blocks if z in (ARTICLE, DOUBTFUL)}
    return len(units) > 1 or any(z == DOUBTFUL for z, _, _ in blocks) or not units and any(z == OTHER for z, _, _ in blocks)


class _Streams:
    """Blocks of pages as one token stream; each block is closed by a separator of its own, so no span crosses blocks."""

    def __init__(self, pages: list[Blocks]):
        self.n_pages = len(pages)
        self.flat = [(p, z, a, t) for p, blocks in enumerate(pages) for z, a, t in blocks]
        self.page = np.array([x[0] for x in self.flat])
        self.zone = np.array([x[1] for x in self.flat])
        self.element = np.array([x[2] for x in self.flat])
        self.numbers: dict[str, int] = {}
        self.streams = [[self.numbers.setdefault(w, len(self.numbers)) for w in x[3].split(" ")] for x in self.flat]
        self.size = size = np.array([len(s) for s in self.streams])
        self.begin = begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        self.tokens = np.zeros(int((size + 1).sum()), np.int64)
        self.tokens[begin + size] = np.arange(len(self.flat)) + len(self.numbers)
        self.inside = np.ones(len(self.tokens), bool)
        self.inside[begin + size] = False
        self.tokens[self.inside] = np.concatenate([np.array(s, np.int64) for s in self.streams])
        self.block = np.repeat(np.arange(len(self.flat)), size + 1)
        # a block shorter than a span is compared as a whole
        self.whole = (np.arange(len(self.tokens)) - begin[self.block]) + SPAN <= size[self.block]
        self.short = np.flatnonzero(size < SPAN)
        self.where = np.concatenate([np.flatnonzero(self.whole), begin[self.short]])
        self.owner = self.block[self.where]

    def kinds(self) -> np.ndarray:
        """A number for each span, the same for equal spans."""
        rank = _sorted_spans(self.tokens, SPAN)
        kinds: dict[tuple, int] = {}
        short_kind = np.array([kinds.setdefault(tuple(self.streams[b]), len(kinds)) for b in self.short.tolist()], np.int64) + int(rank.max()) + 1
        return np.concatenate([rank[self.whole], short_kind])

    def span_names(self, rows: np.ndarray) -> np.ndarray:
        """64-bit names of the spans of these rows of ``where``, the same in every process."""
        word = np.array([_name(w) for w in self.numbers], np.int64).view(np.uint64)
        length, at = np.minimum(SPAN, self.size[self.owner[rows]]), self.where[rows]
        h = length.astype(np.uint64)
        for j in range(SPAN):
            on = np.flatnonzero(length > j)
            h[on] = W.mix(h[on]) * np.uint64(0xD6E8FEB86659FD93) + word[self.tokens[at[on] + j]]
        return W.mix(h).view(np.int64)

    def articles(self, rare: Callable[[int, str], bool]) -> list[str]:
        """The longest block of each page, if possible a rare one: pages that share it are copies of one article."""
        longest: dict[int, tuple[bool, int, str]] = {}
        for p, _, _, t in self.flat:
            longest[p] = max(longest.get(p, (False, 0, "")), (rare(p, t), len(t), t))
        return [longest[p][2] if p in longest else "" for p in range(self.n_pages)]

    def texts(self, marked: np.ndarray) -> list[str]:
        """Main text of each page, with ``marked`` for each row of ``where``."""
        flat, page, zone, element, size, where, owner = self.flat, self.page, self.zone, self.element, self.size, self.where, self.owner
        cover = np.zeros(len(self.tokens) + 1, np.int64)
        np.add.at(cover, where[marked], 1)
        np.add.at(cover, where[marked] + np.minimum(SPAN, size[owner[marked]]), -1)
        under = (np.cumsum(cover[:-1]) > 0) & self.inside
        boilerplate = np.bincount(self.block, under, minlength=len(flat)) >= COVERED * size
        # of several article elements the longest stays, and of the others those with a unique block
        mine = (zone == ARTICLE) | (zone == DOUBTFUL)
        keys, unit = np.unique(page[mine] * (int(element.max()) + 1) + element[mine], return_inverse=True)
        units = np.full(len(flat), -1)
        units[mine] = unit
        words = np.bincount(unit, size[mine], minlength=len(keys))
        unique = np.bincount(unit, ~boilerplate[mine], minlength=len(keys)) > 0
        of_page = keys // (int(element.max()) + 1)
        best: dict[int, int] = {}
        for u, (p, w) in enumerate(zip(of_page.tolist(), words.tolist(), strict=True)):
            if p not in best or w > words[best[p]]:
                best[p] = u
        stays = unique
        stays[list(best.values())] = True
        has_article = np.zeros(self.n_pages, bool)
        has_article[page[mine]] = True
        out: list[list[str]] = [[] for _ in range(self.n_pages)]
        for b, (p, z, _, t) in enumerate(flat):
            if z in (ARTICLE, DOUBTFUL):
                keep = stays[units[b]] and (z == ARTICLE or not boilerplate[b])
            else:
                keep = z == OTHER and not has_article[p] and not boilerplate[b]
            if keep:
                out[p].append(t)
        return ["\n".join(x) for x in out]


def host_main_text(sources: list[str | None]) -> list[str]:
    """Main text of each page of one whole host."""
    s = _Streams([page_blocks(x or "") for x in sources]) if any(sources) else None
    if s is None or not s.flat:
        return [""] * len(sources)
    # a block on most pages names no article
    on: dict[str, set[int]] = {}
    for p, _, _, t in s.flat:
        on.setdefault(t, set()).add(p)
    names: dict[str, int] = {}
    article = np.array([names.setdefault(t, len(names)) for t in s.articles(lambda p, t: 2 * len(on[t]) <= len(sources))])
    kind = s.kinds()
    pair = np.unique(np.stack([kind, article[s.page[s.owner]]], 1), axis=0)
    return s.texts(np.bincount(pair[:, 0], minlength=int(kind.max()) + 1)[kind] >= ARTICLES)


def part_main_text(sources: list[str | None], marked: np.ndarray) -> list[str]:
    """Main text of some of a host's pages, by the names of the spans that are marked on the whole host."""
    s = _Streams([page_blocks(x or "") for x in sources]) if any(sources) else None
    if s is None or not s.flat:
        return [""] * len(sources)
    return s.texts(np.isin(s.span_names(np.arange(len(s.where))), marked) if len(marked) else np.zeros(len(s.where), bool))


def _block_pages(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """For (hid, html): on how many of the batch's pages each block is; without a block, how many pages are undecided."""
    count: dict[tuple[int, int | None], int] = {}
    for hid, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        blocks = page_blocks(source or "")
        for name in [_name(t) for t in {t for _, _, t in blocks}] + [None] * undecided(blocks):
            count[hid, name] = count.get((hid, name), 0) + 1
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in count], pa.int64()), pa.array([k[1] for k in count], pa.int64()), pa.array(count.values(), pa.int64())], ["hid", "block", "n"])


def _span_articles(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """For (hid, common, html): each span of a host in the batch with up to ``ARTICLES`` of its different articles,
    the least by name: whether a union of such lists has that many is the same as for the full lists."""
    hids, common, sources = (batch.column(i).to_pylist() for i in range(3))
    groups: dict[int, list[int]] = {}
    for i, hid in enumerate(hids):
        groups.setdefault(hid, []).append(i)
    for hid, rows in groups.items():
        blocks = [b for b in (page_blocks(sources[i] or "") for i in rows) if b]
        if not blocks:
            continue
        s = _Streams(blocks)
        on_most = set(common[rows[0]] or ())
        article = np.array([_name(t) for t in s.articles(lambda p, t: _name(t) not in on_most)], np.int64)[s.page[s.owner]]
        kind = s.kinds()
        order = np.lexsort((article, kind))
        k, a = kind[order], article[order]
        new = np.append(True, (k[1:] != k[:-1]) | (a[1:] != a[:-1]))
        order, k = order[new], k[new]
        head = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        size = np.diff(np.append(head, len(k)))
        few = np.arange(len(k)) - np.repeat(head, size) < ARTICLES
        name = np.repeat(s.span_names(order[head]), size)[few]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(name), hid, np.int64)), pa.array(name), pa.array(article[order[few]])], ["hid", "span", "article"])


def _marked_spans(pages: DataFrame, large: DataFrame) -> DataFrame | None:
    """(hid, span, parts) of the spans that are boilerplate on large hosts; None if nothing is to be decided there.

    ``pages`` has hid and html of the pages of large hosts, ``large`` hid, n and parts of each.
    """
    counts = map_batches(pages.select("hid", "html"), _block_pages, "hid long, block long, n long").groupBy("hid", "block").agg(F.sum("n").alias("on"))
    facts = stored(counts.join(large, "hid").where("block is null or 2 * on > n").select("hid", "parts", "block"), "hosts")
    # collect_list leaves the null out that stands for undecided pages
    hosts = facts.groupBy("hid", "parts").agg(F.collect_list("block").alias("common"), F.max(F.col("block").isNull()).alias("open")).where("open")
    hosts = stored(hosts.drop("open"), "open-hosts")
    n = hosts.count()
    if not n:
        return None
    asked = hosts.select("hid", "common")
    asked = pages.join(F.broadcast(asked) if n <= BROADCAST_COMMON else asked.hint("merge"), "hid").select("hid", "common", "html")
    seen = map_batches(asked, _span_articles, "hid long, span long, article long")
    # the pairs are dealt by span and article first, so a line on every page isn't one task's
    marked = seen.groupBy("hid", "span").agg(F.countDistinct("article").alias("n")).where(F.col("n") >= ARTICLES).select("hid", "span")
    return marked.join(hosts.select("hid", "parts"), "hid")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row; a null html is empty, and an empty page has an empty text.

    The host is what the url has between ``//`` and the next slash, colon, question mark or number sign, in lower
    case; rows without one form a host of their own. Rows that repeat a page give a row each and count as one article;
    an empty table gives no rows; other columns aren't read. Texts of any length are taken whole, in linear time.
    """
    spark = pages.sparkSession
    ensure_importable(spark)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^/]*//(?:[^/@?#]*@)?([^/:?#]*)", 1))
    pages = pages.select("page_id", "url", "html").withColumn("host", host)
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    bins = max(1, min(4 * shuffle_width(pages), total // (1 << 18)), -(-total // BIN_BYTES))
    large = pages.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > PAGES).select(F.col("host").alias("_host"), F.xxhash64("host").alias("hid"), "n", F.ceil(F.col("n") / PAGES).cast("int").alias("parts"))
    large = large.persist()
    n_large = large.count()
    # broadcast only while the number of large hosts, each with over PAGES pages, is small
    joined = pages.join(F.broadcast(large) if n_large <= BROADCAST_HOSTS else large, F.col("host") == F.col("_host"), "left")
    marked = _marked_spans(joined.where("parts is not null").select("hid", "html"), large.select("hid", "n", "parts")) if n_large else None
    # part -1: the whole host
    part = F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.col("parts")), F.lit(-1)).cast("int")
    keyed = joined.select("page_id", "url", "html", "host", F.coalesce("hid", F.lit(0)).alias("hid"), part.alias("part"))
    keyed = keyed.withColumn("bin", F.when(F.col("part") < 0, F.pmod(F.xxhash64("host"), F.lit(bins))).otherwise(F.pmod(F.xxhash64("hid", "part"), F.lit(bins))))

    def run(table: pa.Table, spans: pa.Table | None = None) -> pa.Table:
        hosts, hids, parts, sources = (table[c].to_pylist() for c in ("host", "hid", "part", "html"))
        groups: dict[tuple, list[int]] = {}
        for i, k in enumerate(zip(hosts, hids, parts, strict=True)):
            groups.setdefault(k, []).append(i)
        of: dict[tuple, np.ndarray] = {}
        if spans is not None and len(spans):
            hid, of_part, span = (spans[c].to_numpy() for c in ("hid", "part", "span"))
            order = np.lexsort((of_part, hid))
            cuts = np.append(np.flatnonzero(np.append(True, (np.diff(hid[order]) != 0) | (np.diff(of_part[order]) != 0))), len(order))
            of = {(int(hid[order[a]]), int(of_part[order[a]])): span[order[a:b]] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)}
        texts = [""] * len(hosts)
        for (_, hid, part), rows in groups.items():
            mine = [sources[i] for i in rows]
            for i, t in zip(rows, host_main_text(mine) if part < 0 else part_main_text(mine, of.get((hid, part), np.zeros(0, np.int64))), strict=True):
                texts[i] = t
        return pa.table({"page_id": table["page_id"], "url": table["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    schema = "page_id long, url string, text string, n_chars long"
    if marked is None:
        return keyed.groupBy("bin").applyInArrow(lambda t: run(t), schema)
    spans = marked.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select("hid", "part", "span", F.pmod(F.xxhash64("hid", "part"), F.lit(bins)).alias("bin"))
    return keyed.groupBy("bin").cogroup(spans.groupBy("bin")).applyInArrow(lambda t, s: run(t, s), schema)
