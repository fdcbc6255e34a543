"""Main text of web pages by a suffix array over each host.

Pages become streams of tokens: a marker for each block (its tag and class) and its words. The streams
of a host's pages are put one behind another and their suffixes sorted; runs of at least ``least_run``
tokens that stand in two distinct pages of the host (pages with equal streams count as one) are
repeated, and blocks that they cover are the host's boilerplate. What is left are the unique runs.

Markup decides first where it speaks: elements that are not content by tag, role or class (menus,
headers, footers, sidebars, notices, adverts, forms, reader comments, scripts, styles) are left out,
and what stands in an ``article`` is main text however often it is repeated, since articles share
passages with one another. Every other block (all of a page without an article, and blocks in plain
containers beside one) is decided by the suffix array.

Sorting needs the first ``least_run`` tokens of a suffix only: substrings of at least that length are
repeated where those are, so ranks are doubled up to that length and no further.

Hosts with very many pages are dealt into parts, none above a quarter of a mean partition or ``part_bytes``. What is
repeated is still decided over the whole host: hashes of the runs of ``least_run`` tokens on pages that
need the verdict (those with such a block) are looked for on all pages of the host, and each part gets
those of its runs that two distinct pages have, wherever these are.

Null html gives an empty text, a null url counts as a host without name. Very long pages are read
whole, unclosed elements and comments reach to the end. Repeated rows keep a row each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm.common import cut, reduced, shuffle_partitions, table, workspace, written
from fieldweave.llm.words import rolling

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_NAMES = re.compile(r"[A-Za-z0-9]+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_RAW = frozenset(("script", "style", "textarea", "title", "xmp", "noscript", "iframe", "template"))
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUT_BY_TAG = frozenset("head nav footer aside form button select dialog menu svg object script style textarea title noscript iframe template".split())
_OUT_BY_WORD = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer header masthead notice notices cookie cookies consent gdpr popup modal overlay alert newsletter subscribe subscription signup login "
    "search form comment comments disqus replies share sharing social related recommended pagination pager widget toolbar copyright".split()
)
_OUT_BY_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_COMMENT_WORDS = frozenset("comment comments reply replies teaser related".split())
_WHOLE = frozenset(("html", "body", "main"))

NEUTRAL, MAIN, OUT = 0, 1, 2
_FEW_HOSTS = 100_000


@dataclass
class Block:
    text: str
    zone: int
    marker: str


def _zone(name: str, rest: str, around: int, in_article: bool) -> int:
    if around == OUT or name in _OUT_BY_TAG or (name == "header" and not in_article):
        return OUT
    if rest and name not in _WHOLE:
        found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(rest)}
        given = f"{found.get('class', '')} {found.get('id', '')}"
        words = {w.lower() for w in [*_NAMES.findall(given), *_PARTS.findall(given)]}
        if name == "article":
            out = words & _COMMENT_WORDS
        else:
            out = "hidden" in found or found.get("role", "").lower() in _OUT_BY_ROLE or words & (_OUT_BY_WORD - {"header"} if in_article else _OUT_BY_WORD)
        if out:
            return OUT
    return MAIN if name == "article" else around


def blocks(page: str | None) -> list[Block]:
    """The page's blocks of text in order, outside of left-out elements or not."""
    page = page or ""
    out: list[Block] = []
    opened: list[tuple[str, int, bool]] = []  # name, zone, within an article
    text: list[str] = []
    zone, in_article, marker, at = NEUTRAL, False, "", 0

    def close() -> None:
        joined = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if joined:
            out.append(Block(joined, zone, marker))

    while found := _MARKUP.search(page, at):
        if found.start() > at:
            text.append(page[at : found.start()])
        at = found.end()
        name = (found["name"] or found["name2"] or "").lower()
        if not name:
            continue
        if name in _INLINE:
            continue
        if name == "br":
            text.append(" ")
            continue
        close()
        rest = found["rest"] or found["rest2"] or ""
        if found["end"] or found["end2"]:
            for i in range(len(opened) - 1, -1, -1):
                if opened[i][0] == name:
                    del opened[i:]
                    break
            zone, in_article = opened[-1][1:] if opened else (NEUTRAL, False)
            continue
        if name in _VOID or rest.endswith("/") and name in _RAW:
            continue
        if name in _RAW:
            stop = re.compile(f"</{name}", re.IGNORECASE).search(page, at)
            at = stop.start() if stop else len(page)
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and opened and opened[-1][0] == name:
            opened.pop()
            zone, in_article = opened[-1][1:] if opened else (NEUTRAL, False)
        zone = _zone(name, rest, zone, in_article)
        in_article = in_article or name == "article" and zone == MAIN
        opened.append((name, zone, in_article))
        marker = f"<{name}{rest}"
    text.append(page[at:])
    close()
    return out


class TokenHashes(dict):
    """64-bit hashes of tokens; known ones are kept up to a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[token] = xxhash.xxh3_64_intdigest(token)
        return value

    def of(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def repeated(streams: list[np.ndarray], least_run: int, elsewhere: np.ndarray | None = None) -> list[np.ndarray]:
    """For each stream, which of its tokens lie in a run of least_run tokens or more that another, different stream also has.

    ``elsewhere`` has the hashes of runs of least_run tokens that are repeated by streams that are not given.
    """
    keys = [s.tobytes() for s in streams]
    content = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    page = np.repeat([content[k] for k in keys], [len(s) + 1 for s in streams])
    tokens = np.concatenate([x for s in streams for x in (s, np.zeros(1, dtype=np.uint64))])
    _, rank = np.unique(tokens, return_inverse=True)
    rank = rank.reshape(-1) + 1
    ends = np.cumsum([len(s) + 1 for s in streams]) - 1
    rank[ends] = len(tokens) + 2 + np.arange(len(streams))  # nothing runs over the end of a page
    length = 1
    while length < least_run:
        step = min(length, least_run - length)
        after = np.zeros_like(rank)
        after[:-step] = rank[step:]
        _, rank = np.unique(rank * (2 * len(tokens) + 4) + after, return_inverse=True)
        rank = rank.reshape(-1) + 1
        length += step
    suffixes = np.argsort(rank, kind="stable")
    starts = np.flatnonzero(np.diff(rank[suffixes], prepend=0))
    low, high = np.minimum.reduceat(page[suffixes], starts), np.maximum.reduceat(page[suffixes], starts)
    shared = np.zeros(len(tokens), dtype=bool)
    shared[suffixes] = np.repeat(low != high, np.diff(starts, append=len(tokens)))
    if elsewhere is not None and len(elsewhere):
        for s, e in zip(streams, ends):
            shared[e - len(s) : e - len(s) + max(len(s) - least_run + 1, 0)] |= np.isin(rolling(s, least_run).view(np.int64), elsewhere)
    within = np.zeros(len(tokens) + 1, dtype=np.int64)
    first = np.flatnonzero(shared)
    np.add.at(within, first, 1)
    np.add.at(within, np.minimum(first + least_run, len(tokens)), -1)
    covered = np.cumsum(within)[:-1] > 0
    return [covered[e - len(s) : e] for s, e in zip(streams, ends)]


def stream(own: list[Block], hashes: TokenHashes) -> tuple[np.ndarray, list[int]]:
    """The tokens of a page's blocks and how many each block has."""
    words = [[b.marker, *b.text.split(" ")] for b in own]
    return hashes.of([w for ws in words for w in ws]) | np.uint64(1), [len(w) for w in words]


def is_open(own: list[Block]) -> bool:
    """Whether the page has a block that markup leaves open."""
    return any(b.zone == NEUTRAL for b in own)


def main_texts(pages: list[str | None], least_run: int = 8, covered_share: float = 0.8, elsewhere: np.ndarray | None = None) -> list[str]:
    """The main texts of pages of one host; ``elsewhere`` as in repeated."""
    hashes = TokenHashes()
    parsed = [[b for b in blocks(p) if b.zone != OUT] for p in pages]
    streams, lengths = [], []
    for own in parsed:
        tokens, sizes = stream(own, hashes)
        lengths.append(sizes)
        streams.append(tokens)
    out = []
    for own, size, covered in zip(parsed, lengths, repeated(streams, least_run, elsewhere) if streams else []):
        ends = np.cumsum(size)
        kept = [b for b, n, e in zip(own, size, ends) if b.zone == MAIN or covered[e - n + 1 : e].mean() < covered_share]
        out.append("\n".join(b.text for b in kept))
    return out


def runs(pages: DataFrame, least_run: int, left_open: bool) -> DataFrame:
    """site, part, code (hash of a run of least_run tokens) and page (hash of its tokens): the distinct runs of each page with or without open blocks."""

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = TokenHashes()
        for batch in batches:
            for begin in range(0, len(batch), 256):
                rows = batch.iloc[begin : begin + 256]
                codes, names = [], []
                for page in rows["html"]:
                    own = [b for b in blocks(page) if b.zone != OUT]
                    tokens = stream(own, hashes)[0] if is_open(own) == left_open else np.zeros(0, dtype=np.uint64)
                    codes.append(np.unique(rolling(tokens, least_run).view(np.int64)))
                    names.append(xxhash.xxh3_64_intdigest(tokens.tobytes()))
                sizes = [len(c) for c in codes]
                page = np.repeat(np.array(names, dtype=np.uint64).view(np.int64), sizes)
                yield pd.DataFrame({"site": rows["site"].repeat(sizes), "part": rows["part"].repeat(sizes), "code": np.concatenate(codes), "page": page})

    return pages.select("site", "part", "html").mapInPandas(cover, "site long, part long, code long, page long")


def repeated_elsewhere(dealt: DataFrame, large: DataFrame, least_run: int) -> DataFrame | None:
    """host, part and code of the runs of pages with open blocks that two distinct pages of a host dealt into parts have. None where there are no such runs.

    A run on very many pages is one row a task before the shuffle, and one row a part after it. Only the runs that are repeated are left in the shared folder.
    """
    with workspace(dealt.sparkSession) as result:
        found = _repeated_elsewhere(dealt, large, least_run)
        return None if found is None else result(found)


def _repeated_elsewhere(dealt: DataFrame, large: DataFrame, least_run: int) -> DataFrame | None:
    split = dealt.where("parts is not null").withColumn("site", F.xxhash64("host"))
    asked = written(runs(split, least_run, True))
    if asked.isEmpty():
        return None
    keys = ["site", "code"]
    first_last = [F.min("page").alias("low"), F.max("page").alias("high")]
    wanted = cut(asked.groupBy(*keys, "part").agg(*first_last))
    others = reduced(runs(split, least_run, False), wanted.select(*keys).distinct(), keys).groupBy(*keys).agg(*first_last)
    found = wanted.select(*keys, "low", "high").union(others).groupBy(*keys).agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high")
    return wanted.select(*keys, "part").join(found.select(*keys), keys).join(large.select(F.xxhash64("host").alias("site"), "host"), "site").select("host", "part", "code")


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", least_run: int = 8, part_bytes: int = 32 << 20) -> DataFrame:
    """id, url, text and n_chars of every page."""
    spark = pages.sparkSession
    named = pages.select(
        F.col(id_column).alias("id"),
        F.col(url_column).alias("url"),
        F.col(html_column).alias("html"),
        F.lower(F.regexp_extract(F.coalesce(url_column, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
    )
    kinds = dict(named.dtypes)
    sizes = cut(named.groupBy("host").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + 64).alias("bytes")))
    whole = sizes.agg(F.sum("bytes").alias("b")).first().b or 0
    most = min(max(whole // (4 * shuffle_partitions(spark)), 1), part_bytes)
    large = cut(sizes.where(F.col("bytes") > most).select("host", F.ceil(F.col("bytes") / most).cast("int").alias("parts")))
    few = large.count() <= _FEW_HOSTS  # of more hosts the table may be too large to broadcast
    dealt = named.join(F.broadcast(large) if few else large, "host", "left").withColumn("part", F.pmod(F.xxhash64("id", "url"), F.coalesce("parts", F.lit(1))))

    def run(rows: pd.DataFrame, elsewhere: np.ndarray | None = None) -> pd.DataFrame:
        texts = main_texts(list(rows["html"]), least_run, elsewhere=elsewhere)
        return pd.DataFrame({"id": rows["id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    schema = f"id {kinds['id']}, url string, text string, n_chars long"
    grouped = dealt.select("id", "url", "html", "host", "part").groupBy("host", "part")
    codes = None if large.isEmpty() else repeated_elsewhere(dealt, large, least_run)
    if codes is None:
        out = grouped.applyInPandas(lambda rows: run(rows), schema)
    else:
        out = grouped.cogroup(codes.groupBy("host", "part")).applyInPandas(lambda rows, own: run(rows, own["code"].to_numpy()), schema)
    return out.withColumnsRenamed({"id": id_column, "url": url_column})


def op2_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
