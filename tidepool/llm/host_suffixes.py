"""Main text of HTML pages; boilerplate by markup, and by long passages that pages of a host share.

A page is cut into blocks. The token streams of all pages of a host (all but the running text of articles) are put in suffix
order to a depth of TOKENS: by prefix doubling inside of a task, which leaves one key for each suffix, and by these keys
between tasks. Suffixes of two different pages with the same prefix are a repeated substring; longer ones are runs of such
suffixes, shorter ones stay. Covered tokens are removed and unique runs stay, on every page, with an article or without.
Then markup is looked at: running text of an article stays, menus, footers, adverts and so on go though they be unique,
and so do blocks beside an article that are mostly links.

Repetition alone can't decide: copies of one article on a host, and passages that articles share, repeat too, and a menu may
occur once. So running text of an article stays, repeated or not. Null and empty html give an empty text, null urls the
empty host. Equal rows count as one page among others. Html of any length is parsed in one pass, as one value. An empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm import common
from tidepool.llm.url_reputation import host_of

#: Tokens that a repeated substring has at least.
TOKENS = 8

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea select iframe svg math object canvas audio video title".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("aside button dialog footer form head menu nav".split())
ARTICLE = frozenset(("article", "main"))
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMES = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer menu modal nav navbar navigation newsletter notice notices popup promo promotion related share sharing sidebar social sponsor sponsored subscribe widget".split())
OUTER_NAMES = frozenset(("header", "masthead", "topbar"))
WHOLE_NAMES = re.compile(r"[a-z0-9]+")
TEXT, OTHER, BOILER, LINKS, BESIDE = 0, 1, 2, 3, 4


def looks_dropped(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and tag not in ("body", "html", "article", "main"):
            words = set(WHOLE_NAMES.findall(value))
            if words & NAMES or not in_article and words & OUTER_NAMES:
                return True
    return False


def blocks_of(html: str) -> list[tuple[int, str]]:
    """(TEXT, LINKS, OTHER, BESIDE or BOILER; text) of the non-empty blocks in page order. LINKS and BESIDE: mostly links, in an
    article and outside."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, dropped, in an article
    dropped = article = False
    linked = 0  # characters of the block in links

    def close() -> None:
        nonlocal linked
        if held:
            raw = "".join(held)
            if text := " ".join(unescape(raw).split()):
                many = 2 * linked > len(raw)
                out.append((BOILER if dropped else (LINKS if many else TEXT) if article else BESIDE if many else OTHER, text))
            held.clear()
        linked = 0

    at = 0
    while m := TAG.search(html, at):
        if m.start() > at:
            held.append(html[at : m.start()])
            if stack and any(x[0] == "a" for x in stack[-3:]):
                linked += m.start() - at
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at) if tag != "title" or not article else None
                at = end.end() if end else len(html) if tag != "title" else at
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCKS:
            close()
        if tag in VOID or attributes.endswith("/"):
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if (stack[i - 1][1:] if i else (False, False)) != (dropped, article):
                        close()
                    del stack[i:]
                    break
            dropped, article = stack[-1][1:] if stack else (False, False)
            continue
        if tag in BLOCKS and any(x[0] == "p" for x in stack[-4:]):
            i = max(i for i, x in enumerate(stack) if x[0] == "p")
            if not any(x[0] in BLOCKS for x in stack[i + 1 :]):
                del stack[i:]
                dropped, article = stack[-1][1:] if stack else (False, False)
        now = (dropped or looks_dropped(tag, attributes, article), article or tag in ARTICLE)
        if now != (dropped, article):
            close()
        stack.append((tag, *now))
        dropped, article = now
    held.append(html[at:])
    close()
    return out


def stream(blocks: list[tuple[int, str]]) -> list[str]:
    return [w for kind, x in blocks if kind != TEXT for w in x.split()]


def main_text(blocks: list[tuple[int, str]], starts: set[int] = frozenset(), tokens: int = TOKENS) -> str:
    """Running text of the article, and what of other blocks outside boilerplate isn't in a repeated substring that begins at one
    of `starts` of the stream; where there is such text, blocks beside it that are mostly links go."""
    covered, n, kept = set(), 0, []
    has_text = any(kind == TEXT for kind, _ in blocks)
    for s in starts:
        covered.update(range(s, s + tokens))
    for kind, x in blocks:
        if kind == TEXT:
            kept.append(x)
            continue
        words = x.split()
        if kind in (LINKS, OTHER) or kind == BESIDE and not has_text:
            if left := [w for i, w in enumerate(words, n) if i not in covered]:
                kept.append(" ".join(left))
        n += len(words)
    return "\n".join(kept)


def packed(blocks: list[tuple[int, str]]) -> tuple[bytes, int]:
    """Blocks, compressed, and the bytes that they take without; of boilerplate only how many words it has."""
    raw = "\n".join(f"{kind}{' '.join('.' * len(x.split())) if kind == BOILER else x}" for kind, x in blocks).encode()
    return pa.compress(raw, codec="zstd", asbytes=True), len(raw)


def unpacked(data: bytes, size: int) -> list[tuple[int, str]]:
    raw = pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True).decode() if size else ""
    return [(int(x[0]), x[1:]) for x in raw.split("\n")] if raw else []


def prefix_ranks(codes: np.ndarray, depth: int) -> np.ndarray:
    """For each place, the rank of its suffix's first `depth` codes among all; equal ones share a rank. By prefix doubling."""
    rank, known = np.unique(codes, return_inverse=True)[1].astype(np.int64), 1
    while known < depth:
        step = min(known, depth - known)
        after = np.zeros(len(rank), np.int64)
        after[: max(0, len(rank) - step)] = rank[step:] + 1  # what ends sooner comes first
        rank, known = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1].astype(np.int64), known + step
    return rank


def suffix_keys(pages: list[tuple[str, int, list[str], bool]], tokens: int = TOKENS) -> tuple[list[int], list[int], list[int | None]]:
    """pages: host, uid, stream, asks -> (key, uid, place) of suffixes by their first `tokens` tokens on their host.

    Of pages that ask, every suffix; of the others, one place-less key for each different prefix of the smallest and of the
    largest uid, which is all that others need to know.
    """
    from xxhash import xxh64_intdigest

    known: dict[str, int] = {}
    codes = np.array([known.setdefault(w, len(known)) for _, _, words, _ in pages for w in words], np.int64)
    size = np.array([len(x[2]) for x in pages], np.int64)
    begin = np.cumsum(size) - size
    of = np.repeat(np.arange(len(pages)), size)
    whole = np.arange(len(codes)) - begin[of] <= size[of] - tokens
    host: dict[str, int] = {}
    hosts = np.array([host.setdefault(x[0], len(host)) for x in pages], np.int64)
    at = np.flatnonzero(whole)
    group = np.unique(prefix_ranks(codes, tokens)[at] * len(host) + hosts[of[at]], return_index=True, return_inverse=True) if len(at) else None
    keys: list[int] = []
    uids: list[int] = []
    places: list[int | None] = []
    if group is None:
        return keys, uids, places
    uid, asks = np.array([x[1] for x in pages], np.int64), np.array([x[3] for x in pages], bool)
    key = np.array([xxh64_intdigest("\0".join((pages[p][0], *pages[p][2][i : i + tokens]))) - (1 << 63) for p, i in zip(of[at[group[1]]].tolist(), (at - begin[of[at]])[group[1]].tolist(), strict=True)], np.int64)
    asking = asks[of[at]]
    keys += key[group[2][asking]].tolist()
    uids += uid[of[at[asking]]].tolist()
    places += (at - begin[of[at]])[asking].tolist()
    low, high = np.full(len(key), np.iinfo(np.int64).max), np.full(len(key), np.iinfo(np.int64).min)
    np.minimum.at(low, group[2][~asking], uid[of[at[~asking]]])
    np.maximum.at(high, group[2][~asking], uid[of[at[~asking]]])
    for some, ids in ((low <= high, low), (low < high, high)):
        keys += key[some].tolist()
        uids += ids[some].tolist()
        places += [None] * int(some.sum())
    return keys, uids, places


def extract(pages: DataFrame, tokens: int = TOKENS) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html)."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "uid": F.xxhash64("page_id", "url", "html")})
    id_type = rows.schema["page_id"].dataType.simpleString()

    def suffixes(batches):
        for batch in common.text_slices(batches, "html"):
            streams = [stream(blocks_of(x)) for x in batch.column("html").to_pylist()]
            keys, uids, places = suffix_keys([(host, uid, x, True) for host, uid, x in zip(batch.column("host").to_pylist(), batch.column("uid").to_pylist(), streams, strict=True)], tokens)
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "uid": pa.array(uids, pa.int64()), "place": pa.array(places, pa.int32())})

    def parse(batches):
        for batch in common.text_slices(batches, "html"):
            blocks = [packed(blocks_of(x)) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("page_id", "url", "uid")} | {"blocks": pa.array([x for x, _ in blocks], pa.binary()), "size": pa.array([n for _, n in blocks], pa.int64())})

    def rest(batches):
        for batch in batches:
            text = [main_text(unpacked(x, n), set(s or ()), tokens) for x, n, s in zip(*(batch.column(c).to_pylist() for c in ("blocks", "size", "starts")), strict=True)]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(text, pa.string())})

    found = common.stash(common.map_arrow(rows.select("host", "uid", "html"), suffixes, "key long, uid long, place int"), "suffixes")
    repeated = found.groupBy("key").agg(F.min("uid").alias("low"), F.max("uid").alias("high")).where("low < high").select("key")
    starts = common.salted_join(found, repeated, ["key"], F.col("uid"), "inner", 8).groupBy("uid").agg(F.collect_set("place").alias("starts"))
    starts = common.stash(starts, "repeated-substrings")
    common.discard(found)
    common.release(pages.sparkSession)
    parsed = common.map_arrow(rows.select("page_id", "url", "uid", "html"), parse, f"page_id {id_type}, url string, uid long, blocks binary, size long")
    out = common.map_arrow(parsed.join(starts.hint("merge"), "uid", "left").select("page_id", "url", "blocks", "size", "starts"), rest, f"page_id {id_type}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op5_host_suffixes(spark, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
