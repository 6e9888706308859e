"""Main text of web pages: suffix arrays of the words of each host find what its pages repeat, the markup checks it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import scratch
from .runs import suffix_levels
from .urls import host_and_path

LONG = 8  # words of a repeated substring that counts
COVERED = 0.5  # share of a block's words in repeated substrings, above which it goes
PAGES = 8  # different pages that share a substring, at least, before it counts as the template of a host
_SEGMENT = 12_000_000  # characters whose suffixes are sorted at once
#: Elements whose text is never page text.
RAW = "script style noscript template svg math iframe object canvas textarea select title xmp noembed noframes audio video".split()
#: Elements that hold menus, footers, side matter, forms.
JUNK = set("nav footer aside button menu dialog head".split())
#: Elements that start and end blocks.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that mark junk.
JUNK_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social sidebar aside related recommended "
    "recommendations comment comments commentlist disqus reply replies respond breadcrumb breadcrumbs nav navbar navigation menu footer "
    "header masthead toolbar pagination pager widget widgets search skip copyright contentinfo complementary hidden".split()
)
#: Words that go along with one of JUNK_WORDS in a name that marks junk (share-buttons, but not share-price or has-sidebar).
PARTS = set(
    "site page main primary secondary global top bottom left right sticky fixed inner outer box bar bars block blocks button buttons btn btns "
    "link links list lists item items icon icons wrapper wrap container section area region group row column col content form panel pane title "
    "text body post posts entry article articles blog wp jp js module component field popular latest recent media google dfp slot unit space "
    "label inline is visually".split()
)
#: Words of class, id and role that mark an article or main as no main text.
NO_MAIN_WORDS = set("comment comments reply related sidebar ad ads sponsored promo".split())
#: Words of class, id and role that mark the container of the main text, if no element does.
MAIN_WORDS = set("article post entry story main content maincontent".split())
_RAW = "|".join(RAW)
_REST = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<(?:svg|math)(?=[\s/])(?:[^>\"'/]++|\"[^\"]*+\"|'[^']*+'|/(?!>))*+/>"
    rf"|<(?P<open>script|style)(?=[\s/>]){_REST}>.*?(?:</(?P=open)(?=[\s/>])[^>]*>|\Z)"
    rf"|<(?P<raw>{_RAW})(?=[\s/>])(?P<marks>{_REST})>"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[a-z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.I | re.S,
)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
_MARK = re.compile(r"(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MAYBE_JUNK, _JUNKY, _PLAIN, _BY_WORD, _BY_MAIN, _BY_ARTICLE = -2, -1, 0, 1, 2, 4


def _named(value: str, marks: set[str]) -> bool:
    """Whether one of the names in ``value`` is made of words of ``marks`` and of PARTS only."""
    for name in value.split():
        words = {w.lower() for w in _WORD.findall(name)}
        if words & marks and not words - marks - JUNK_WORDS - PARTS:
            return True
    return False


def _kind(tag: str, rest: str, in_article: bool) -> int:
    if tag in JUNK:
        return _JUNKY
    kind = {"article": _BY_ARTICLE, "main": _BY_MAIN, "form": _MAYBE_JUNK, "header": _PLAIN if in_article else _MAYBE_JUNK}.get(tag, _PLAIN)
    if not rest.strip(" /") or tag in ("html", "body"):
        return kind
    for name, a, b, c in _MARK.findall(rest):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return _JUNKY
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return _JUNKY
            continue
        if name == "aria-hidden":
            continue
        words = {w.lower() for w in _WORD.findall(value)}
        if tag in ("article", "main"):
            if _named(value, NO_MAIN_WORDS):
                return _JUNKY
        elif _named(value, JUNK_WORDS - ({"header"} if in_article else set())):
            kind = _MAYBE_JUNK
        elif kind == _PLAIN and words & MAIN_WORDS:
            kind = _BY_MAIN if name == "role" and "main" in words else _BY_WORD
    return kind


def _tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, tag, whether it is an end tag, rest) of markup in order; without tag where it is only left out.

    A raw element is left out with what is inside of it, up to its end tag. Where no end tag follows it is a tag like any other;
    that is found out once a name, so the time is linear in the page.
    """
    at, unclosed = 0, set()
    while match := _TOKEN.search(page, at):
        at, tag, rest = match.end(), match["tag"] or "", match["rest"] or ""
        if match["raw"]:
            name = match["raw"].lower()
            end = None if name in unclosed else _RAW_END[name].search(page, at)
            if end:
                at = end.end()
            else:
                unclosed.add(name)
                tag, rest = name, match["marks"]
        yield match.start(), at, tag.lower(), bool(match["end"]), rest


def blocks(page: str | None) -> list[tuple[str, int, int]]:
    """(text, containers, junk) of each block that is not empty, in page order.

    Character references are decoded, white space is one blank. containers is the sum of the kinds of main text the
    block is inside of (0: not at all). junk is _JUNKY inside menus, footers, what is hidden and the like, else
    _MAYBE_JUNK inside forms, headers and what names mark as junk, else 0. The elements around the container with the
    most text mark no junk by their names. Unclosed elements end with their parents; a new block ends an open paragraph.
    """
    found: list[tuple[str, list[tuple[int, int]]]] = []
    stack: list[str] = []
    open_tags: Counter[str] = Counter()
    marked: list[tuple[int, int, int]] = []  # of the stack what is not plain: place, kind, number
    above: dict[int, list[int]] = {}  # of each container, the elements around it that may be junk
    text: list[str] = []
    page = page or ""
    n = 0

    def flush() -> None:
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                found.append((joined, [(k, i) for _, k, i in marked]))

    def close(tag: str, within: tuple[str, ...] = ()) -> None:
        if not open_tags[tag]:
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] == tag:
                if any(t in BLOCK for t in stack[i:]):
                    flush()
                open_tags.subtract(stack[i:])
                del stack[i:]
                while marked and marked[-1][0] >= i:
                    marked.pop()
                return
            if stack[i] in within:
                return

    at = 0
    for start, end, tag, closes, rest in _tokens(page):
        if start > at:
            text.append(unescape(page[at:start]))
        at = end
        if not tag:
            continue
        if closes:
            if tag in BLOCK:
                flush()
            close(tag)
        elif tag == "br":
            text.append(" ")
        else:
            if tag in BLOCK:
                flush()
                close("p", ("button", "td", "th", "table"))
                if tag == "li":
                    close("li", ("ul", "ol", "menu"))
            if tag not in VOID:
                in_article = any(k > _PLAIN for _, k, _ in marked)
                n += 1
                kind = _kind(tag, rest, in_article)
                if kind > _PLAIN:
                    above[n] = [i for _, k, i in marked if k == _MAYBE_JUNK]
                if kind != _PLAIN:
                    marked.append((len(stack), kind, n))
                stack.append(tag)
                open_tags[tag] += 1
    if at < len(page):
        text.append(unescape(page[at:]))
    flush()

    sizes = dict.fromkeys(above, 0)
    for joined, path in found:
        if not any(k == _JUNKY for k, _ in path):
            for kind, i in reversed(path):
                if kind == _MAYBE_JUNK:
                    break
                sizes[i] += len(joined)
    around = set(above[max(sizes, key=sizes.get)]) if any(sizes.values()) else set()
    out = []
    for joined, path in found:
        kinds = {k for k, i in path if i not in around}
        junk = _JUNKY if _JUNKY in kinds else _MAYBE_JUNK if _MAYBE_JUNK in kinds else 0
        out.append((joined, sum(k for k in kinds if k > _PLAIN), junk))
    return out


def covered(texts: list[str], starts: list[int] | None) -> np.ndarray:
    """Of each block, whether more than COVERED of its words are in the substrings of LONG words at ``starts``."""
    lengths = np.array([text.count(" ") + 1 for text in texts], np.int64)
    ends = np.cumsum(lengths)
    depth = np.zeros(ends[-1] + 1 if len(ends) else 1, np.int64)
    at = np.array([] if starts is None else starts, np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + LONG, -1)
    before = np.concatenate([[0], np.cumsum(np.cumsum(depth[:-1]) > 0)])
    return before[ends] - before[ends - lengths] > COVERED * lengths


def uncovered(texts: list[str], starts: list[int] | None) -> str:
    """The blocks with at most COVERED of their words in the substrings of LONG words at ``starts``."""
    return "\n\n".join(text for text, goes in zip(texts, covered(texts, starts)) if not goes)


def _container(found: list[tuple[str, int, int]], repeated: np.ndarray) -> int:
    """The narrowest kind of container that has at least half as much text as any other kind; 0 if there is none.

    Text that the host repeats does not count, unless containers hold no other text.
    """
    for counts in (~repeated, np.ones(len(found), bool)):
        sizes = {kind: sum(len(t) for (t, kinds, junk), c in zip(found, counts) if c and kinds & kind and not junk) for kind in (_BY_ARTICLE, _BY_MAIN, _BY_WORD)}
        if any(sizes.values()):
            return next(kind for kind, size in sizes.items() if size and 2 * size >= max(sizes.values()))
    return 0


def main_text(found: list[tuple[str, int, int]], starts: list[int] | None) -> str:
    """The main text of a page of blocks (text, containers, junk), in which substrings of LONG words at ``starts`` are repeated.

    What is repeated goes; the markup is the check after it. Where it names a container, what is around goes too, and
    the repeated blocks stay if they are the greater part of its text: it is the article that stands on many pages, then.
    Where it names none, blocks that may be junk go, unless all blocks may be.
    """
    repeated = covered([t for t, _, _ in found], starts)
    best = _container(found, repeated)
    if best:
        inside = np.array([bool(kinds & best) and not junk for _, kinds, junk in found])
        sizes = np.array([len(t) for t, _, _ in found])
        if 2 * sizes[inside & repeated].sum() > sizes[inside].sum():
            repeated = np.zeros(len(found), bool)
    else:
        level = max((junk for _, _, junk in found if junk != _JUNKY), default=0)
        inside = np.array([junk == level for _, _, junk in found], bool)
    return "\n\n".join(t for (t, _, _), kept in zip(found, inside & ~repeated) if kept)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The blocks of each page with their containers and junk, whether a container is named, and what the markup alone says (else None)."""
    for batch in batches:
        rows = []
        for n, page in zip(batch["n"], batch["html"]):
            found = blocks(page)
            named = any(kinds and not junk for _, kinds, junk in found)
            text = main_text(found, None) if named else None
            rows.append((n, named, [t for t, _, _ in found], [k for _, k, _ in found], [j for _, _, j in found], text))
        yield pd.DataFrame(rows, columns=["n", "named", "blocks", "kinds", "junk", "text"])


def _words(pages: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of pages one after the other: numbers, 64-bit hashes, the page of each, and where LONG words are left in it.

    Pages end with a word of their own, so no suffix is like another beyond its page.
    """
    streams = [" ".join(blocks).split(" ") if len(blocks) else [] for blocks in pages]
    lengths = np.array([len(words) for words in streams], np.int64)
    page = np.repeat(np.arange(len(pages)), lengths + 1)
    ends = np.cumsum(lengths + 1) - 1
    numbers, distinct = pd.factorize(np.array([word for words in streams for word in words], object))
    inside = np.ones(len(page), bool)
    inside[ends] = False
    ids = np.empty(len(page), np.int64)
    ids[inside], ids[ends] = numbers, len(distinct) + np.arange(len(pages))
    hashes = np.zeros(len(page), np.uint64)
    if len(distinct):
        hashes[inside] = pd.util.hash_array(distinct, categorize=False)[numbers]
    return ids, hashes, page, np.flatnonzero(np.arange(len(page)) + LONG <= ends[page])


def _keys(hashes: np.ndarray, at: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the LONG words from each place ``at`` on and of its ``salt``."""
    key = salt.astype(np.uint64)
    for i in range(LONG):
        key = (key ^ hashes[at + i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _hosts_of(batch: pd.DataFrame) -> np.ndarray:
    return pd.util.hash_array(batch["host"].to_numpy(object))


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ends = np.cumsum([sum(map(len, blocks)) for blocks in batch["blocks"]])
        if len(ends):
            for _, segment in batch.groupby(ends * (ends[-1] // _SEGMENT + 1) // (ends[-1] + 1), sort=False):
                yield segment.reset_index(drop=True)


def repeats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, start, low, high, known, open, held, met) of substrings of LONG words in the pages (host, page, known, open, blocks) of each segment.

    A suffix array of each host's words is sorted to the depth of LONG words; neighbours that have these in common are
    one substring, and longer ones are chains of such. low and high are the least and greatest ``page`` that holds it, held the
    number of pages that hold it, met that of the host's pages in the segment, and known that in all. Of hosts with an
    ``open`` page all substrings leave the segment, of others with PAGES pages or more those on over 9 of 20 pages met.
    """
    for batch in _segments(batches):
        ids, hashes, row, at = _words(batch["blocks"])
        rank = suffix_levels(ids, LONG)[-1] if len(at) else ids
        host, (code, _) = _hosts_of(batch), pd.factorize(batch["host"])
        in_order = at[np.lexsort((rank[at], code[row[at]]))]  # the suffix arrays of the hosts; equal suffixes by page
        rows = row[in_order]
        new = np.ones(len(in_order), bool)
        new[1:] = (rank[in_order][1:] != rank[in_order][:-1]) | (code[rows][1:] != code[rows][:-1])
        first = np.flatnonzero(new)
        new_row = new.copy()
        new_row[1:] |= rows[1:] != rows[:-1]
        page = batch["page"].to_numpy()[rows]
        held, low, high = (f.reduceat(x, first) if len(first) else x for f, x in ((np.add, new_row.astype(np.int64)), (np.minimum, page), (np.maximum, page)))
        of_page = batch[["host", "known", "open"]].iloc[rows[first]].reset_index(drop=True)
        out = of_page.assign(start=_keys(hashes, in_order[first], host[rows[first]]), low=low, high=high, held=held, met=np.bincount(code)[code[rows[first]]])
        kept = out["open"] | (out["known"] >= PAGES) & (20 * out["held"] > 9 * out["met"])
        yield out.loc[kept, ["host", "start", "low", "high", "known", "open", "held", "met"]]


def _suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(n, page, named, starts, places): the first LONG words of suffixes of a page as a hash, as ``repeats`` has them, and their places.

    Of pages with a container those in ``wide``, of the others all. The place is -1 where the substring touches no block that may be in the result.
    """
    for batch in _segments(batches):
        _, hashes, row, at = _words(batch["blocks"])
        keys = _keys(hashes, at, _hosts_of(batch)[row[at]])
        first = np.searchsorted(row, np.arange(len(batch)))
        bounds = np.searchsorted(row[at], np.arange(len(batch) + 1))
        out = []
        for i, (n, page, named, wide, blocks, kinds, junk) in enumerate(zip(*(batch[c] for c in ("n", "page", "named", "wide", "blocks", "kinds", "junk")))):
            starts, places = keys[bounds[i] : bounds[i + 1]], at[bounds[i] : bounds[i + 1]] - first[i]
            if named:
                shared = np.isin(starts, np.asarray(wide, np.int64))
                inside = np.repeat((np.asarray(kinds) != 0) & (np.asarray(junk) == 0), [t.count(" ") + 1 for t in blocks])
                before = np.concatenate([[0], np.cumsum(inside)])
                starts, places = starts[shared], places[shared]
                places = np.where(before[places + LONG] > before[places], places, -1)
            if len(starts):
                out.append((n, page, named, starts, places.astype(np.int32)))
        yield pd.DataFrame(out, columns=["n", "page", "named", "starts", "places"])


def repeated_places(pages: DataFrame) -> DataFrame:
    """(n, starts): the places of pages (n, host, page, named, blocks, kinds, junk) where LONG words start that their host repeats.

    On pages without a container that is a substring found on two different pages of the host, on the others one of the
    host's template: found on more than half of its pages, and of its different pages, at least PAGES. Suffix arrays are
    built over all pages (``repeats``), each within a segment of bounded size, so a hot host is spread over all tasks;
    their substrings are merged by hash. A segment that does not tell of a substring has it on at most 9 of 20 pages, which bounds
    its pages from above; only what may be on more than half of them is counted exactly, over all pages of the host.
    """
    totals = pages.groupBy("host", "page").agg(F.count("*").alias("known"), F.max(~F.col("named")).alias("open"))
    totals = totals.groupBy("host").agg(F.sum("known").alias("known"), F.count("*").alias("texts"), F.max("open").alias("open"))
    hosts = scratch.stored(totals.filter((F.col("known") >= PAGES) | F.col("open")))
    asked = pages.join(hosts.select("host", "known", "open"), "host").select("host", "page", "known", "open", "blocks")
    found = asked.mapInPandas(repeats, "host string, start long, low long, high long, known long, open boolean, held long, met long").groupBy("host", "start")
    merged = found.agg(F.min("low").alias("low"), F.max("high").alias("high"), *(F.max(c).alias(c) for c in ("known", "open")), *(F.sum(c).alias(c) for c in ("held", "met")))
    wide = (10 * (2 * F.col("held") - F.col("met")) > F.col("known") - F.col("met")) & (F.col("known") >= PAGES)
    merged = merged.select("host", "start", (F.col("open") & (F.col("low") != F.col("high"))).alias("again"), wide.alias("wide"))
    merged = scratch.stored(merged.filter("again or wide"))

    of_hosts = merged.groupBy("host").agg(F.collect_list(F.when(F.col("wide"), F.col("start"))).alias("wide"))  # what half of the pages share
    holders = pages.join(of_hosts, "host").filter("not named or size(wide) > 0").select("host", "n", "page", "named", "wide", "blocks", "kinds", "junk")
    suffixes = holders.mapInPandas(_suffixes, "n long, page long, named boolean, starts array<long>, places array<int>")
    suffixes = suffixes.select("n", "page", "named", F.explode(F.arrays_zip("starts", "places")).alias("s"))
    suffixes = suffixes.select("n", "page", "named", F.col("s.starts").alias("start"), F.col("s.places").alias("at"))
    hits = scratch.stored(suffixes.join(merged, "start"))
    counts = hits.filter("wide").select("host", "start", "page", "n").distinct().groupBy("host", "start", "page").agg(F.count("*").alias("k"))
    counts = counts.groupBy("host", "start").agg(F.sum("k").alias("k"), F.count("*").alias("t")).join(hosts, "host")
    template = counts.filter((2 * F.col("k") > F.col("known")) & (2 * F.col("t") > F.col("texts")) & (F.col("t") >= PAGES)).select("start")
    on_open = hits.filter("not named and again").select("n", "at")
    on_named = hits.filter("named and wide and at >= 0").join(template, "start", "left_semi").select("n", "at")
    return scratch.stored(on_open.union(on_named).groupBy("n").agg(F.collect_list("at").alias("starts")))  # at most a page's words


@F.pandas_udf(T.StringType())
def _main_text(texts: pd.Series, kinds: pd.Series, junk: pd.Series, starts: pd.Series) -> pd.Series:
    return pd.Series([main_text(list(zip(*page[:3])), page[3]) for page in zip(texts, kinds, junk, starts)], dtype=object)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) for every row: the blocks of the main text, joined by an empty line.

    ``repeated_places`` finds by suffix arrays what the pages of a host repeat, and ``main_text`` leaves it out, with the markup
    as the check after it. Where the markup names the container (article, main, or a class, id or role of that sense), the text
    is its blocks, less menus, headers, footers, asides, notices, adverts, forms and comments inside, and less what the template
    of the host puts there without such a name. An article or passage that stands on some other pages is kept there. Pages without a
    container of that sense lose all that another page of the host has too. Null and empty html have an empty text. Null urls
    are one host. Repeated rows and null keys stay; other columns are not read; an empty table gives no rows.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), F.monotonically_increasing_id().alias("n"))
    host, _ = host_and_path(F.col("url"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = next(_parse(iter([batch]))).drop(columns="text")
            yield pd.concat([batch[["key", "url", "host"]].reset_index(drop=True), found], axis=1)

    schema = f"key {kinds['key']}, url string, host string, n long, named boolean, blocks array<string>, kinds array<int>, junk array<int>"
    parsed = scratch.stored(rows.withColumn("host", host).mapInPandas(run, schema).withColumn("page", F.xxhash64("blocks")))
    judged = parsed.join(repeated_places(parsed.drop("key", "url")), "n", "left")
    joined = judged.select("key", "url", _main_text("blocks", "kinds", "junk", "starts").alias("text"))
    return joined.select(F.col("key").alias(key), "url", "text", F.length("text").cast("long").alias("n_chars"))
