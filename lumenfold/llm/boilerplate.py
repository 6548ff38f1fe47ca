"""Main text of web pages: page structure, blocks and substrings that a host repeats, by a suffix array where a host is small."""

from __future__ import annotations

import html as html_
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import Words, pieces, written
from lumenfold.llm.passages import shingles
from lumenfold.session import join_stats

#: Tokens of a repeated substring, share of a block that repetition must cover, most pages of a host whose suffix array one task sorts.
LONG, COVERED, SHARD = 6, 0.6, 256
#: Distinct pages of a host that repeat a substring or block outside of articles.
PAGES = 3
#: Distinct pages, and their share of the host's, from which what articles repeat is boilerplate: copies of an article are not.
ARTICLE_PAGES, ARTICLE_SHARE = 20, 0.8
BROADCAST_HOSTS, BROADCAST_HITS = 500_000, 32 << 20
#: Cells of a larger host's counts of substrings, hosts that a task counts at once, groups of `shard` pages whose substrings are compared at once.
CELLS, COUNTED, TOGETHER = 4096, 1024, 16

# A quoted value begins right after =. One that holds < or > must be short and end where an attribute may end: an open quote ends with its tag.
_PART = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"
    r"((?>[^>\"'=]+|=\s*+(?>\"[^\"<>]*\"|'[^'<>]*'|\"[^\"]{0,4096}\"(?=[\s/>])|'[^']{0,4096}'(?=[\s/>])|)|[\"'])*+)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_MAIN = re.compile(r"\brole\s*=\s*[\"']?main\b|\bitemprop\s*=\s*[\"']?articleBody\b")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_CHROME = {"nav", "footer", "aside", "button", "select", "head", "noscript", "template", "svg", "object", "dialog", "menu", "canvas",
           "audio", "video", "map", "datalist", "annotation", "annotation-xml"}
_FORM = {"form", "fieldset"}
_ARTICLE = {"article", "main"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
           "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
           "math", "semantics", "mrow", "mi", "mn", "mo", "ms", "mtext", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder"}
_READERS = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond"}
_NOISE = _READERS | {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription",
    "signup", "login", "sidebar", "side", "aside", "widget", "widgets", "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs",
    "header", "masthead", "topbar", "footer", "share", "sharing", "social", "related", "recommended", "recommendations", "search", "searchbox",
    "complementary", "contentinfo", "skip"}
#: Parts of a name that leave it the name of noise: sidebar-left is one, share-price and page-with-sidebar are none.
_NEUTRAL = {"area", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "form", "global", "group",
            "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "page", "panel", "post", "posts", "article", "articles",
            "primary", "right", "secondary", "section", "site", "slot", "space", "thread", "top", "unit", "wrap", "wrapper", "zone"}


def _noise(value: str, article: bool) -> int:
    """2 where a class, id or role marks comments of readers, 1 where it marks other noise, else 0.

    Every part of one of its names, split at - and _, must be a word of noise or a neutral one. In an article a header
    may hold its heading.
    """
    found = 0
    for name in value.lower().split():
        parts = [p for p in re.split(r"[_-]+", name) if p and not p.isdigit()]
        words = [p for p in parts if p in _NOISE and not (article and p == "header")]
        if words and all(p in _NOISE or p in _NEUTRAL for p in parts):
            found = max(found, 2 if any(p in _READERS for p in words) else 1)
    return found


def _chrome(name: str, attributes: str, article: bool) -> int:
    """2 where an element is no part of the article, 1 where that only holds for what no article element in it holds, else 0."""
    if name in _CHROME:
        return 2
    if name in ("html", "body", "main"):
        return 0
    level = 1 if name in _FORM or (name == "header" and not article) else 0
    if attributes:
        if _HIDDEN.search(attributes):
            return 2
        for value in _NAMED.findall(attributes):
            level = max(level, _noise(value.strip("\"'"), article or name == "article"))
    if name == "article" and not article:
        return 2 if level == 2 else 0
    return level


def blocks(page: str) -> list[tuple[str, int]]:
    """Text blocks of a page in order, outside of chrome: the text with single spaces, and what holds it.

    That is 2 for an article, 1 for an article inside an element named as noise, 0 for no article. Block elements part
    blocks, inline ones and line breaks do not. Character references are decoded. An element that is never closed ends
    with its parent; a `p` that is open ends at the next block; a quotation mark that is never closed ends with its tag.
    """
    out: list[tuple[str, int]] = []
    text: list[str] = []
    open_: list[tuple[str, int, int]] = []  # name, level of chrome, kind of article
    chrome = article = place = 0

    def close() -> None:
        if text:
            joined = " ".join(html_.unescape("".join(text)).split())
            if joined:
                out.append((joined, article))
            text.clear()

    for part in _PART.finditer(page):
        if part.start() < place:
            continue
        if not chrome and part.start() > place:
            text.append(page[place:part.start()])
        place = part.end()
        name = part[2].lower() if part[2] else ""
        if not name:
            if not chrome and part[0].startswith("<![CDATA["):
                text.append(html_.escape(part[0][9:-3]))
            continue
        if name in _RAW and not part[1]:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, place)
            place = end.end() if end else len(page)
            continue
        if name == "br":
            if not chrome:
                text.append(" ")
            continue
        if name not in _INLINE:
            close()
        if part[1]:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    del open_[k:]
                    break
                if open_[k][0] in _ARTICLE and name in _INLINE:  # a stray end tag does not end the article
                    break
        elif name not in _VOID and not part[3].rstrip().endswith("/"):
            if name not in _INLINE:
                while open_ and open_[-1][0] in _INLINE | {"p"}:
                    open_.pop()
            _, level, kind = open_[-1] if open_ else ("", 0, 0)
            own = _chrome(name, part[3], kind > 0)
            if not kind and own < 2 and level < 2 and (name in _ARTICLE or _MAIN.search(part[3])):
                kind, level = (1 if level else 2), 0
            else:
                level = max(level, own)
            open_.append((name, level, kind))
        _, level, kind = open_[-1] if open_ else ("", 0, 0)
        if level != chrome or kind != article:
            close()
            chrome, article = level, kind
    if not chrome and place < len(page):
        text.append(page[place:])
    close()
    return out


def chosen(page: str) -> tuple[str, bool]:
    """The blocks of a page that may be its text, joined by empty lines, and whether an article element holds them.

    Articles come first. An article that stands inside an element named as noise is taken if it is longer than what
    stands in no article.
    """
    found = blocks(page)
    size = [sum(len(text) for text, kind in found if kind == k) for k in range(3)]
    kind = 2 if size[2] else 1 if size[1] > size[0] else 0
    return "\n\n".join(text for text, k in found if k == kind), kind > 0


def host(url: Column) -> Column:
    """Lower-case host of a URL without port or user; urls without a scheme begin with it. Null: the empty host."""
    bare = F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), r"^\s*([a-zA-Z][a-zA-Z0-9+.-]*:)?//", "")
    name = F.regexp_extract(bare, r"^([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"^.*@", ""), r":\d*$", ""))


def occurrences(words: np.ndarray, page: np.ndarray, long: int = LONG) -> np.ndarray:
    """For each token the most distinct pages that have one of the substrings of `long` tokens it lies in; 0 for none.

    words are the tokens of all pages of a host end to end, page the number of each token's page, ascending. The suffix
    array is sorted by doubling as far as `long` tokens, which is all that telling such substrings apart needs.
    """
    n = len(words)
    most = np.zeros(n, dtype=np.int64)
    if n < long:
        return most
    _, rank = np.unique(words, return_inverse=True)
    rank, step = rank.astype(np.int64) + 1, 1
    while step < long:
        jump = min(step, long - step)
        key = rank * (n + 2)
        key[:-jump] += rank[jump:]
        _, rank = np.unique(key, return_inverse=True)
        rank, step = rank + 1, step + jump
    order = np.argsort(rank, kind="stable")  # the suffix array; suffixes that begin with the same tokens lie together, in page order
    order = order[order + long <= n]
    order = order[page[order] == page[order + long - 1]]
    if not len(order):
        return most
    new = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
    other = new | np.concatenate([[True], page[order][1:] != page[order][:-1]])
    same = np.cumsum(new) - 1
    starts = np.zeros(n, dtype=np.int64)
    starts[order] = np.bincount(same, weights=other).astype(np.int64)[same]
    for k in range(long):
        np.maximum(most[k:], starts[:n - k], out=most[k:])
    return most


def repeated(words: np.ndarray, page: np.ndarray, long: int = LONG, least: int = 2) -> np.ndarray:
    """Which tokens lie in a substring of `long` tokens that occurs on `least` or more distinct pages."""
    return occurrences(words, page, long) >= least


def _article_least(articles: int) -> int:
    """Distinct pages from which what an article repeats is boilerplate, on a host with so many distinct articles."""
    return max(ARTICLE_PAGES, int(np.ceil(ARTICLE_SHARE * articles)))


def _kept(parts: list[str], article: bool, covered: np.ndarray, hashes: list[int], gone: set[int], most: set[int]) -> str:
    """Text of a page without the blocks that are covered or that the whole host repeats (gone).

    A page that would lose all its text loses only what most pages of the host have; an article never loses all.
    """
    kept = [t for t, c, h in zip(parts, covered, hashes, strict=True) if not c and h not in gone]
    if not kept:
        kept = parts if article else [t for t, h in zip(parts, hashes, strict=True) if h not in most]
    return "\n\n".join(kept)


def _texts(bodies: list[str], named: list[bool], gone: list[set[int]], most: list[set[int]], hashes: list[list[int]],
           long: int, share: float) -> list[str]:
    """Main texts of all pages of one host, equal pages being one page.

    Blocks go that the host repeats (gone) or that its repeated substrings cover.
    """
    number: dict[tuple[str, bool], int] = {}
    own = [number.setdefault(page, len(number)) for page in zip(bodies, named, strict=True)]
    parts = [[text for text in body.split("\n\n") if text] for body, _ in number]
    article = np.array([a for _, a in number], dtype=bool)
    words = Words(pa.array([text for page in parts for text in page], pa.string()))
    counts = np.diff(words.docs)
    block = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    pages = occurrences(words.hashes, np.repeat(block, counts), long)
    least = np.where(article, _article_least(int(article.sum())), PAGES)
    sums = np.concatenate([[0], np.cumsum(pages >= np.repeat(least[block], counts))])
    covered = (sums[words.docs[1:]] - sums[words.docs[:-1]]) >= share * np.maximum(counts, 1)
    begin = np.searchsorted(block, np.arange(len(parts) + 1))
    done: dict[int, str] = {}
    for i, k in enumerate(own):
        if k not in done:
            done[k] = _kept(parts[k], bool(article[k]), covered[begin[k]:begin[k + 1]], hashes[i], gone[i], most[i])
    return [done[k] for k in own]


def _parsed(rows: DataFrame) -> DataFrame:
    """Rows (with html) with their chosen text, whether an article holds it, its hash (body) and those of its blocks instead."""
    others = [c for c in rows.columns if c != "html"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            found = [chosen(page or "") for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array([t for t, _ in found], pa.string()),
                                              pa.array([a for _, a in found], pa.bool_())], [*others, "text", "named"])

    schema = rows.select(*others).schema.add("text", "string").add("named", "boolean")
    return rows.mapInArrow(parse, schema).select("*", F.xxhash64("text").alias("body"), _block_hashes("text").alias("hashes"))


def _block_hashes(text: str) -> Column:
    return F.transform(F.filter(F.split(text, "\n\n"), lambda t: t != ""), lambda t: F.xxhash64(t))


def _distinct_pages(rows: DataFrame, long: int) -> DataFrame:
    """A row for each distinct page: host, named, body and hashes of its blocks; and counts over a task's pages of larger hosts.

    A row of counts (host, cells, tag) says for each of CELLS classes of substrings how many of these pages have one of
    it; the host's sum is no less than the number of pages that have any one of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        seen: set[int] = set()
        first, tag = TaskContext.get().partitionId() << 32, 0
        names = ["host", "text", "named", "cells", "tag"]

        def flush() -> pa.RecordBatch:
            nonlocal tag
            n, tag = len(counts), tag + len(counts)
            out = [pa.array(list(counts), pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.bool_()),
                   pa.array([c.astype("<u4").tobytes() for c in counts.values()], pa.binary()), pa.array(np.arange(tag - n, tag) + first)]
            counts.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays(out, names)

        for batch in pieces(batches, "html"):
            found = [chosen(page or "") for page in batch.column("html").to_pylist()]
            n = len(found)
            texts = pa.array([t for t, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("host"), texts, pa.array([a for _, a in found], pa.bool_()),
                                              pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names)
            large = np.flatnonzero(np.asarray(batch.column("groups").is_valid()))
            if not len(large):
                continue
            hosts = batch.column("host").to_pylist()
            hashed, offsets = shingles(Words(texts.take(pa.array(large))), long)
            for k, i in enumerate(large.tolist()):
                page = hash((hosts[i], found[i]))
                if page not in seen:
                    seen.add(page)
                    if hosts[i] not in counts:
                        counts[hosts[i]] = np.zeros(CELLS, dtype=np.int64)
                    counts[hosts[i]][np.unique(hashed[offsets[k]:offsets[k + 1]] % np.uint64(CELLS)).astype(np.int64)] += 1
            if len(counts) >= COUNTED:
                yield flush()
        if counts:
            yield flush()

    pages = rows.select("host", "groups", "html").mapInArrow(run, "host long, text string, named boolean, cells binary, tag long")
    return written(pages.select("host", "named", F.xxhash64("text").alias("body"), F.array_distinct(_block_hashes("text")).alias("blocks"),
                                "cells", "tag").distinct(), "page_blocks")


def _host_blocks(distinct: DataFrame) -> DataFrame:
    """Blocks of each distinct page that its whole host repeats: host, named, body, gone, and most (half of its pages have it).

    One row of hashes for each distinct page, so that copies count once; counts combine before they are shuffled.
    """
    keys = ["host", "named"]
    blocks_ = distinct.select(*keys, "body", F.explode("blocks").alias("block"))
    counts = blocks_.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("has")).where(F.col("has") >= PAGES)
    counts = join_stats(counts, distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("of")), keys)
    often = (F.col("has") >= ARTICLE_PAGES) & (F.col("has") >= ARTICLE_SHARE * F.col("of"))
    repeats = written(counts.where(~F.col("named") | often), "repeated_blocks")
    return written(join_stats(blocks_, repeats, [*keys, "block"]).groupBy(*keys, "body").agg(
        F.collect_list("block").alias("gone"), F.collect_list(F.when(2 * F.col("has") >= F.col("of"), F.col("block"))).alias("most")), "page_repeats")


def _heavy_cells(cells: DataFrame) -> DataFrame:
    """Hosts (host, articles, cells; articles only) with the cells whose substrings enough pages may have, a bit for each."""
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(parts, "host").sortWithinPartitions("host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host_, least, total = None, 0, np.zeros(CELLS, dtype=np.int64)

        def bits() -> pa.RecordBatch:
            heavy = total >= least
            n = int(heavy.any())
            return pa.RecordBatch.from_arrays([pa.array([host_] * n, pa.int64()), pa.array([np.packbits(heavy).tobytes()] * n, pa.binary())], ["host", "heavy"])

        for batch in batches:
            for h, articles, own in zip(*(batch.column(c).to_pylist() for c in ("host", "articles", "cells")), strict=True):
                if h != host_:
                    if host_ is not None:
                        yield bits()
                    host_, least, total = h, _article_least(articles), np.zeros(CELLS, dtype=np.int64)
                total += np.frombuffer(own, dtype="<u4")
        if host_ is not None:
            yield bits()

    return dealt.mapInArrow(run, "host long, heavy binary")


def _host_substrings(rows: DataFrame, distinct: DataFrame, crowd: DataFrame, long: int) -> DataFrame:
    """Substrings of each distinct page of the larger hosts (crowd: host, groups) that its whole host repeats: host, named, body, hits.

    Hosts with pages without an article send all hashes of their substrings; hosts of articles only those in cells whose
    counts reach the number of pages that an article needs, so hardly any. Hashes are dealt by host and value, so that a
    task compares those of about TOGETHER groups of pages at once; equal pages count once.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pages = distinct.where("cells is null").join(crowd, "host").groupBy("host", "groups").agg(
        F.count_if("named").alias("articles"), F.count_if(~F.col("named")).alias("others"))
    pages = written(pages, "page_counts")
    heavy = _heavy_cells(distinct.where("cells is not null").select("host", "cells").join(pages.where("others = 0"), "host").select("host", "articles", "cells"))
    hosts = pages.where("others > 0").withColumn("heavy", F.lit(None).cast("binary")).unionByName(pages.join(heavy, "host"))
    hosts = written(hosts.select("host", "articles", "heavy", F.ceil(F.col("groups") / TOGETHER).alias("deals")), "page_hosts")
    chosen_ = _parsed(join_stats(rows.select("host", "html"), hosts, ["host"])).drop("hashes")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            hashed, offsets = shingles(Words(batch.column("text")), long)
            out: dict[tuple[int, int], tuple[int, list[tuple], list[np.ndarray]]] = {}
            columns = (batch.column(c).to_pylist() for c in ("host", "named", "body", "articles", "heavy", "deals"))
            for i, (h, named, body, articles, heavy_, deals) in enumerate(zip(*columns, strict=True)):
                own = np.unique(hashed[offsets[i]:offsets[i + 1]])
                if heavy_ is not None:
                    bits = np.unpackbits(np.frombuffer(heavy_, dtype=np.uint8)).astype(bool)
                    own = own[bits[(own % np.uint64(CELLS)).astype(np.int64)]]
                deal = (own >> np.uint64(32)) % np.uint64(deals)
                for d in np.unique(deal).tolist():
                    some = own[deal == d] if deals > 1 else own
                    _, heads, hashes = out.setdefault((h, d), (articles, [], []))
                    heads.append((body, int(named), len(some)))
                    hashes.append(some)
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in out], pa.int64()), pa.array([d for _, d in out], pa.int64()), pa.array([a for a, _, _ in out.values()], pa.int64()),
                 pa.array([np.array(x, dtype="<i8").tobytes() for _, x, _ in out.values()], pa.binary()),
                 pa.array([np.concatenate(x).astype("<u8").tobytes() for _, _, x in out.values()], pa.binary())], ["host", "deal", "articles", "pages", "hashes"])

    sent = chosen_.mapInArrow(send, "host long, deal long, articles long, pages binary, hashes binary")
    dealt = sent.repartition(parts, "host", "deal").sortWithinPartitions("host", "deal")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, articles, heads, hashes = None, 0, [], []

        def group() -> pa.RecordBatch:
            head, hashed = np.concatenate(heads).reshape(-1, 3), np.concatenate(hashes)
            order = np.lexsort((head[:, 1], head[:, 0]))
            once = np.zeros(len(head), dtype=bool)
            once[order] = np.concatenate([[True], (np.diff(head[order, :2], axis=0) != 0).any(axis=1)])
            hashed, head = hashed[np.repeat(once, head[:, 2])], head[once]
            _, value, has = np.unique(hashed, return_inverse=True, return_counts=True)
            enough = has[value] >= np.repeat(np.where(head[:, 1] > 0, _article_least(articles), PAGES), head[:, 2])
            ends = np.concatenate([[0], np.cumsum(enough)])[np.concatenate([[0], np.cumsum(head[:, 2])])]
            hit, hashed = np.flatnonzero(np.diff(ends)), hashed[enough]
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(hit), pa.int64()), pa.array(head[hit, 1] > 0), pa.array(head[hit, 0].astype(np.int64)),
                 pa.array([hashed[ends[i]:ends[i + 1]].tobytes() for i in hit], pa.binary())], ["host", "named", "body", "hits"])

        for batch in batches:
            for h, d, of, own, values in zip(*(batch.column(c).to_pylist() for c in ("host", "deal", "articles", "pages", "hashes")), strict=True):
                if (h, d) != key:
                    if key is not None:
                        yield group()
                    key, articles, heads, hashes = (h, d), of, [], []
                heads.append(np.frombuffer(own, dtype="<i8"))
                hashes.append(np.frombuffer(values, dtype="<u8"))
        if key is not None:
            yield group()

    hits = dealt.mapInArrow(compare, "host long, named boolean, body long, hits binary")
    return written(hits.groupBy("host", "named", "body").agg(F.collect_list("hits").alias("hits")), "page_hits")


def extract(pages: DataFrame, long: int = LONG, share: float = COVERED, shard: int = SHARD) -> DataFrame:
    """Main text of every page (page_id, url, html): page_id, url, text and n_chars (code points).

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments go by the elements and the
    class, id and role names that mark them. An article or main element is the text where a page has one, also inside
    an element with such a name; else all that is left. Of that goes what the host repeats:

    * blocks that are the same on PAGES distinct pages of the host, counted by Spark;
    * blocks of which substrings of `long` tokens on PAGES distinct pages of the host cover `share` or more: found by a
      suffix array over the token streams of a host of at most `shard` pages, else by counting their hashes, dealt by
      host and value, so that no task gets a whole host.

    Inside article elements both need ARTICLE_PAGES pages and ARTICLE_SHARE of the host's articles. A page that would
    lose all its text loses only the blocks that half of the host's pages have; an article never loses all.

    Null html is empty; pages without url share the empty host; repeated rows give repeated rows and count as one page;
    an empty table gives no rows; other columns are ignored. Pages are parsed twice, for the counts (hashes of blocks,
    written to the shared folder when this is called) and for the result, and a third time in between where substrings of a
    larger host may be repeated often enough.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    rows = rows.select("page_id", "url", F.xxhash64(host(F.col("url"))).alias("host"), "html")
    crowd = rows.groupBy("host").count().where(F.col("count") > shard).select("host", F.ceil(F.col("count") / shard).alias("groups"))
    crowd = written(crowd, "page_crowds")  # hosts of many pages only, 16 bytes each
    rows = rows.join(F.broadcast(crowd) if crowd.count() <= BROADCAST_HOSTS else crowd, "host", "left")
    distinct = _distinct_pages(rows, long)
    repeats = _host_blocks(distinct.where("cells is null"))
    hits = _host_substrings(rows.where("groups is not null"), distinct, crowd, long)
    none = F.array().cast("array<bigint>")  # empty lists, as null ones cost Spark's Arrow writer time with the square of a batch
    keys, taken = ["host", "named", "body"], ["page_id", "url", "text", "named", "hashes", "gone", "most"]

    def marked(own: DataFrame) -> DataFrame:
        return join_stats(_parsed(own), repeats, keys, "left").withColumns({c: F.coalesce(c, none) for c in ("gone", "most")})

    def result(ids: list, urls: list, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()),
                                           pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, urls, held = None, [], [], []

        def group() -> pa.RecordBatch:
            return result(ids, urls, _texts(*(list(c) for c in zip(*held, strict=True)), long, share))

        for batch in pieces(batches, "text"):
            columns = (batch.column(c).to_pylist() for c in ("host", *taken))
            for h, page_id, url, text, named, hashes, gone, most in zip(*columns, strict=True):
                if h != key:
                    if ids:
                        yield group()
                    key, ids, urls, held = h, [], [], []
                ids.append(page_id)
                urls.append(url)
                # no hash is needed where nothing of the page is repeated
                held.append((text, named, set(gone), set(most), hashes or [0] * (text.count("\n\n") + 1 if text else 0)))
        if ids:
            yield group()

    def run_larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            ids, urls, texts, named, hashes, gone, most, hits_ = (batch.column(c).to_pylist() for c in (*taken, "hits"))
            for i, text in enumerate(texts):
                if not gone[i] and not hits_[i]:
                    continue
                parts_ = [t for t in text.split("\n\n") if t]
                covered = np.zeros(len(parts_), dtype=bool)
                if hits_[i]:
                    words = Words(pa.array(parts_, pa.string()))
                    hashed, _ = shingles(Words(pa.array([text], pa.string())), long)
                    inside = np.zeros(len(words.hashes) + 1, dtype=np.int64)
                    at = np.flatnonzero(np.isin(hashed, np.frombuffer(b"".join(hits_[i]), dtype="<u8")))
                    np.add.at(inside, at, 1)
                    np.add.at(inside, at + long, -1)
                    sums = np.concatenate([[0], np.cumsum(np.cumsum(inside[:-1]) > 0)])
                    covered = sums[words.docs[1:]] - sums[words.docs[:-1]] >= share * np.maximum(np.diff(words.docs), 1)
                texts[i] = _kept(parts_, named[i], covered, hashes[i], set(gone[i]), set(most[i]))
            yield result(ids, urls, texts)

    schema = "page_id long, url string, text string, n_chars long"
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    smaller = marked(rows.where("groups is null")).select(
        "host", "page_id", "url", "text", "named", F.when(F.size("gone") > 0, F.col("hashes")).otherwise(none).alias("hashes"), "gone", "most")
    smaller = smaller.repartition(parts, "host").sortWithinPartitions("host").mapInArrow(run, schema)
    few = (hits.agg(F.sum(F.aggregate("hits", F.lit(0), lambda n, h: n + F.length(h)) + 32)).first()[0] or 0) <= BROADCAST_HITS
    larger = marked(rows.where("groups is not null")).join(F.broadcast(hits) if few else hits, keys, "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<binary>")))
    return smaller.union(larger.select(*taken, "hits").mapInArrow(run_larger, schema))
