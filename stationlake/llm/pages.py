"""Main text of HTML pages: the marked article or else all blocks, without what a host suffix array calls repeats.

A page is cut into blocks of text in page order. Menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments are told
by element, role, class or id and are chrome. A class or id tells by its whole
name, its first part, or its last part after a part that only says where. Blocks
inside ``article`` (or else ``main``) are the page's text. A form around an
article is none; nor is what a class or id calls chrome, if the page marks no
other article and this one has at least as much text as all that is not chrome.

All blocks go to the host's suffix array: the token streams of its pages, articles
and what lies outside them, stand one after another, and their suffixes are
ordered by their first ``depth`` tokens (prefix doubling, in slices of bounded
size). Suffixes that start alike in enough distinct pages are neighbours there, so
every token they cover is part of a substring of ``depth`` tokens or more that
pages share. Small hosts are one slice. The slices of others meet by the hash of
those tokens, if any page there marks no article or the articles of a slice agree.

An article's blocks that consist of its host's frame go: all their tokens are
covered by what a share ``frame`` of the host's articles hold, ``FRAMED`` articles
at least. Passages that fewer articles share are quotations and stay, and so does
an article that would lose nine tenths of its tokens. Pages without a marked
article keep what is neither chrome nor covered, in unique runs; there two pages
must agree, in their articles or outside, and a share ``support`` of the host's.
If nine tenths of a longer such page (``LONG`` tokens that are not chrome) are
covered, it is a copy of others and keeps all that is not chrome.

Defined results: null and empty html give an empty text; pages without host
have no others beside them; pages with equal text count as one page; an
empty table gives an empty table. Added columns replace columns of the same name.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlake.llm.frames import extended, stored
from stationlake.llm.hashing import SPACED, mixed, portions, word_hashes

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript iframe template xmp".split())
_CHROME = set("nav aside form svg math object canvas video audio button select dialog menu head footer".split())
_BLOCKS = set(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDERS = set("article aside body div dl footer form header html main nav ol section table td th ul".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_WORDS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar nav navbar navigation menu "
    "breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "signup login share sharing social related recommended comment comments disqus replies respond pagination pager toolbar".split()
)
_PLACES = set("site main page post entry article content left right top bottom global primary secondary mobile desktop user reader".split())
_STATES = set("open opened closed on off free enabled disabled active inactive visible hidden none layout page collapsed expanded".split())
_PAGE_WORDS = {"header", "topbar", "widget", "widgets"}
MAIN, LOOSE, CHROME = 0, 1, 2
LONG = 64
FRAMED = 5
ALWAYS, NAMED, FORM = 1, 2, 4  # why an element is chrome


def _telling(name: str) -> set[str]:
    """The words by which a class or id name can tell chrome."""
    parts = re.split(r"[-_]+", name.strip("-_"))
    if len(parts) == 1:
        return set(parts)
    if parts[-1] in _STATES:
        return set()
    return {parts[0]} | ({parts[-1]} if all(p in _PLACES for p in parts[:-1]) else set())


def _attributes(text: str) -> tuple[set[str], str, bool]:
    names, role, hidden = set(), "", False
    for m in _NAMES.finditer(text):
        value = (m[2] or m[3] or m[4] or "").lower()
        kind = m[1].lower()
        if kind == "role":
            role = value.strip()
        elif kind == "hidden" or (kind == "aria-hidden" and value == "true"):
            hidden = True
        elif kind in ("class", "id"):
            for name in value.split():
                names |= _telling(name)
    return names, role, hidden


def blocks(html: str | None) -> list[tuple[int, str]]:
    """(kind, text) of every block with text, in page order."""
    html = html or ""
    spared: set[int] = set()
    found, shaded = _parsed(html, spared)
    if forms := [around for why, around, _ in shaded if why == FORM]:
        spared.update(*forms)
        found, shaded = _parsed(html, spared)
    if shaded and not any(place & 2 for kind, place, _ in found if kind != CHROME):
        own = [(place, len(text)) for kind, place, text in found if kind != CHROME]
        rest = sum(n for place, n in own if place or not any(p for p, _ in own))
        _, around, size = max(shaded, key=lambda x: x[2])
        if size and size >= rest:
            found, _ = _parsed(html, spared | around)
    own = [place for kind, place, _ in found if kind != CHROME]
    level = 2 if any(p & 2 for p in own) else 1
    marked = any(p & level for p in own)
    return [(CHROME if kind == CHROME else MAIN if marked and place & level else LOOSE, text) for kind, place, text in found]


def _parsed(html: str, spared: set[int]) -> tuple[list[tuple[int, int, str]], list[tuple[int, set[int], int]]]:
    """Blocks as (kind without regard to main, where the block lies, text), and the articles within chrome.

    Of an article: why it is chrome, where the tags that make it so stand, the
    length of its text. Tags at ``spared`` places are not chrome by name or as forms.
    """
    found: list[tuple[int, int, str]] = []
    shaded: list[list] = []
    parts: list[str] = []
    stack: list[tuple] = []  # tag, chrome, in article, in main, article within chrome, place if chrome itself
    nothing = (0, False, False, None)
    chrome, article, main, shade = nothing

    def flush():
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                found.append((CHROME if chrome else LOOSE, 2 * article + main, text))
                if shade is not None and not chrome & ALWAYS:
                    shaded[shade][2] += len(text)

    def close(at: int):
        nonlocal chrome, article, main, shade
        flush()
        del stack[at:]
        chrome, article, main, shade = stack[-1][1:5] if stack else nothing

    at = 0
    while m := _MARKUP.search(html, at):
        if m.start() > at:
            parts.append(entities.unescape(html[at : m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag in _BLOCKS or any(s[0] in _BLOCKS for s in stack[i:]):
                        close(i)
                    else:
                        del stack[i:]
                        if (stack[-1][1:5] if stack else nothing) != (chrome, article, main, shade):
                            flush()
                            chrome, article, main, shade = stack[-1][1:5] if stack else nothing
                    break
                if stack[i][0] in _HOLDERS and tag not in _HOLDERS:
                    break
            else:
                if tag in _BLOCKS:
                    flush()
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            parts.append(" ")
            continue
        if tag in _VOID:
            parts.append(" ") if tag != "wbr" else None
            if tag == "hr":
                flush()
            continue
        if tag in _BLOCKS:
            flush()
            ended = _ENDS.get(tag, set()) | {"p"}
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ended:
                    close(i)
                elif stack[i][0] in _HOLDERS:
                    break
        if tag == "body":
            close(0)
        names, role, hidden = _attributes(m[3]) if m[3] else (set(), "", False)
        inner = article or main
        why = 0
        if tag in _CHROME - {"form"} or hidden or role in _ROLES - {"form"} or tag == "header" and not inner:
            why = ALWAYS
        if m.start() not in spared:
            if names & (_WORDS if inner else _WORDS | _PAGE_WORDS) and tag not in ("html", "body", "main"):
                why |= NAMED
            if tag == "form" or role == "form":
                why |= FORM
        dark, place = chrome | why, m.start() if why else None
        held = shade
        if (tag in ("article", "main") or role in ("article", "main")) and dark and not dark & ALWAYS:
            around = {x[5] for x in stack} | {place}
            held = len(shaded)
            shaded.append([dark, around - {None}, 0])
        state = (dark, article or tag == "article" or role == "article", main or tag == "main" or role == "main", held)
        if state != (chrome, article, main, shade):
            flush()
        stack.append((tag, *state, place))
        chrome, article, main, shade = state
        if m[3].endswith("/") and tag not in _BLOCKS:
            del stack[-1:]
            chrome, article, main, shade = stack[-1][1:5] if stack else nothing
    if at < len(html):
        parts.append(entities.unescape(html[at:]))
    flush()
    return found, [tuple(x) for x in shaded]


def _page(html: str | None) -> tuple[bool, str, list[tuple[int, str]]]:
    """Whether an article is marked, its text, and the other blocks."""
    listed = blocks(html)
    own = [t for kind, t in listed if kind == MAIN]
    return bool(own), "\n".join(own), [b for b in listed if b[0] != MAIN]


def _key(own: str, other: list[tuple[int, str]]) -> int:
    """The page's number: the hash of all its text."""
    return xxhash.xxh3_64_intdigest("\n".join([own, "", *[t for _, t in other]]).encode())


def _streams(batches):
    """The page's number, whether an article is marked, and its text: the article's and what lies outside it."""
    codec = pa.Codec("zstd")
    for batch in batches:
        pages, marked, streams = [], [], []
        for html in batch.column("html").to_pylist():
            has, own, other = _page(html)
            marked.append(has)
            pages.append(_key(own, other))
            parts = [own.encode(), " ".join(t for _, t in other).encode()]
            size = np.array([len(t) for t in parts], np.int64)
            streams.append(size.tobytes() + codec.compress(b"".join(parts), asbytes=True) if size.any() else b"")
        yield [pa.array(np.array(pages, np.uint64).view(np.int64)), marked, streams]


def _unpacked(stream: bytes) -> list[bytes]:
    """Both texts of a page, as ``_streams`` packed them."""
    own, other = np.frombuffer(stream[:16], np.int64).tolist()
    text = pa.Codec("zstd").decompress(stream[16:], own + other, asbytes=True)
    return [text[:own], text[own:]]


def suffix_ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every suffix by its first ``depth`` tokens (a power of two); the end sorts first."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while step < depth:
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 2) + ahead, return_inverse=True)[1].astype(np.int64) + 1
        step *= 2
    return rank


def _beginnings(tokens: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Hash of the ``depth`` tokens that start at each place."""
    factors = np.random.default_rng(77).integers(0, 2**63, depth, dtype=np.uint64) | np.uint64(1)
    key = np.zeros(len(at), np.uint64)
    for j in range(depth):
        key += tokens[at + j] * factors[j]
    return mixed(key).view(np.int64)


def _classes(depth: int, most: int, support: float, frame: float, counted: bool):
    """The suffix array of each slice of a host, as rows of classes of equal beginnings.

    A row has the hash of the beginning, the number of pages that hold it and of
    articles that do, and the places of pages that mark no article. Of a host that is
    one slice come the repeats only. Of others comes a row per slice without key: its
    pages, its articles, and whether the host is ``open`` and must be ``counted``, as
    pages mark no article or a share ``frame`` of the articles agree here (if they do
    in the whole host, they do in a slice). With ``counted`` come all classes of a slice.
    """

    def one(host, pages, marked, streams, whole):
        empty = np.empty(0, np.int64)

        def rows(key, held, own, open_=None, ends=None, at=empty, places=empty):
            ends = pa.array(np.zeros(len(held) + 1, np.int32) if ends is None else ends)
            listed = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in (at, places)]
            numbers = [pa.array(x, pa.int64()) for x in (key, held, own)]
            return pa.RecordBatch.from_arrays(
                [pa.array([host] * len(held), pa.string()), *numbers, pa.array([open_] * len(held), pa.bool_()), *listed],
                names=["host", "key", "held", "own", "open", "pages", "places"],
            )

        texts = [t for s in streams for t in _unpacked(s)]
        found = [word_hashes(texts[a:b], SPACED) for a, b in portions(texts)]
        tokens, size = np.concatenate([h for h, _ in found]), np.concatenate([np.diff(s) for _, s in found])
        of = np.repeat(np.arange(len(texts)), size)  # a page has two parts, the article and the rest; no beginning lies in both
        place = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
        full = np.flatnonzero(place <= size[of] - depth)  # beginnings that do not run into the next part
        if not whole and not counted and (not len(full) or not marked.all()):
            return rows([None], [len(pages)], [marked.sum()], bool(len(full)))
        if not len(full):
            return rows([], [], [])
        rank = suffix_ranks(tokens, depth)
        order = full[np.lexsort((of[full], rank[full]))]
        part = of[order]
        page = part // 2
        fresh = np.concatenate(([True], np.diff(rank[order]) != 0))
        first = np.flatnonzero(fresh)
        held = np.add.reduceat(fresh | np.concatenate(([True], np.diff(page) != 0)), first, dtype=np.int64)
        own = np.add.reduceat((fresh | np.concatenate(([True], np.diff(part) != 0))) & (part % 2 == 0), first, dtype=np.int64)
        if not whole and not counted:
            return rows([None], [len(pages)], [marked.sum()], bool((own >= max(1, frame * marked.sum() - 1e-6)).any()))
        loose = ~marked[page]
        wanted = np.ones(len(first), bool)
        if whole:
            wanted = np.logical_or.reduceat(loose, first) & (held >= max(2, np.ceil(len(pages) * support)))
            own[own < max(FRAMED, np.ceil(marked.sum() * frame))] = 0
            wanted |= own > 0
        loose &= wanted[np.cumsum(fresh) - 1]
        ends = np.concatenate(([0], np.cumsum(np.add.reduceat(loose, first, dtype=np.int32)[wanted], dtype=np.int32)))
        at = order[loose]
        return rows(_beginnings(tokens, order[first[wanted]], depth), held[wanted], own[wanted], None, ends, pages[page[loose]], place[at])

    def run(batches):
        held: list[tuple] = []
        seen: set[int] = set()  # copies of a page meet in one group
        group, parts, size, cut = None, 1, 0, False

        def flush():
            out = one(group[0], np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], bool), [r[2] for r in held], parts == 1 and not cut)
            held.clear()
            return out

        for batch in batches:
            for host, part, of, page, marked, stream in zip(*[batch.column(c).to_pylist() for c in ("host", "part", "parts", "page", "marked", "stream")]):
                if group != (host, part):
                    if held:
                        yield flush()
                    group, parts, size, cut = (host, part), of, 0, False
                    seen.clear()
                if page in seen:
                    continue
                seen.add(page)
                n = (int(np.frombuffer(stream[:16], np.int64).sum()) + 2) // 2  # tokens at most
                if held and size + n > most:
                    cut, size = True, 0
                    yield flush()
                held.append((page, marked, stream))
                size += n
        if held:
            yield flush()

    return run


def _covered(sizes: list[int], places, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens the repeats that start at ``places`` cover, and where each block starts (and the last ends)."""
    ends = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64))))
    covered = np.zeros(int(ends[-1]) + depth, bool)
    for p in places:
        covered[p : p + depth] = True
    return covered[: int(ends[-1])], ends


def _unframed(own: list[str], keys, depth: int) -> list[str]:
    """An article's blocks without those that consist of frame; nine tenths of it are no frame."""
    tokens = word_hashes([" ".join(own).encode()], SPACED)[0]
    starts = np.arange(max(len(tokens) - depth + 1, 0))
    places = starts[np.isin(_beginnings(tokens, starts, depth), np.array(keys, np.int64))]
    if not len(places):
        return own
    covered, ends = _covered([len(t.split()) for t in own], places, depth)
    gone = np.array([covered[a:b].all() for a, b in zip(ends, ends[1:])])
    if np.diff(ends)[gone].sum() >= 0.9 * len(tokens):
        return own
    return [t for t, g in zip(own, gone) if not g]


def _articles(depth: int):
    """Whether a page marks an article, its number, and the article's text without the host's frame."""

    def run(batches):
        for batch in batches:
            marked, pages, texts = [], [], []
            for html, keys in zip(batch.column("__html").to_pylist(), batch.column("__keys").to_pylist()):
                has, own, other = _page(html)
                marked.append(has)
                pages.append(_key(own, other))
                texts.append(None if not has else "\n".join(_unframed(own.split("\n"), keys, depth)) if keys else own)
            yield [marked, pa.array(np.array(pages, np.uint64).view(np.int64)), texts]

    return run


def _without(depth: int):
    """Text of pages without a marked article: chrome and covered tokens go, unique runs stay."""

    def run(batches):
        for batch in batches:
            texts = []
            for text, html, places in zip(*[batch.column(c).to_pylist() for c in ("__text", "__html", "__places")]):
                if text is not None:
                    texts.append(text)
                    continue
                other = _page(html)[2]
                words = [t.split() for _, t in other]
                # The stream's words are cut at ASCII white space; the blocks hold no other.
                size = [len(w) for w in words]
                covered, ends = _covered(size, places or (), depth)
                loose = np.repeat(np.array([kind == LOOSE for kind, _ in other], bool), size)
                if loose.sum() >= LONG and covered[loose].mean() >= 0.9:
                    covered[:] = False
                out = []
                for (kind, _), listed, at in zip(other, words, ends):
                    kept = [w for w, c in zip(listed, covered[at : at + len(listed)]) if not c]
                    if kept and kind == LOOSE:
                        out.append(" ".join(kept))
                texts.append("\n".join(out))
            yield [texts]

    return run


def extract(
    pages: DataFrame, url: str = "url", html: str = "html", depth: int = 8, slice_tokens: int = 1 << 20, keep=None, support: float = 0.05, frame: float = 0.9
) -> DataFrame:
    """``pages`` with ``text``, the main text of each page."""
    kept = pages.columns if keep is None else list(keep)
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    given = pages.select(host.alias("host"), F.col(html).alias("html")).filter("host <> ''")
    # A token and its space take two bytes of html at least, so a host of one part is one slice.
    size = F.sum(F.expr("octet_length(html) + 2"))
    parts = stored(given.groupBy("host").agg(F.ceil(size / (2 * slice_tokens)).alias("parts")).filter("parts > 1"), "parts")

    def classes(some: DataFrame, counted: bool, name: str) -> DataFrame:
        streams = extended(some, "page long, marked boolean, stream binary", _streams, keep=["host"]).filter("length(stream) > 0")
        streams = streams.join(parts, "host", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        dealt = streams.withColumn("part", F.expr("pmod(page, parts)")).repartition("host", "part").sortWithinPartitions("host", "part")
        rows = "host string, key long, held long, own long, open boolean, pages array<long>, places array<long>"
        return stored(dealt.mapInArrow(_classes(depth, slice_tokens, support, frame, counted), rows), name)

    first = classes(given, False, "classes")
    large = first.filter("key IS NULL").groupBy("host").agg(F.sum("held").alias("size"), F.sum("own").alias("articles"), F.max("open").alias("open"))
    large = stored(large.filter("open").drop("open"), "large")
    # The slices of such hosts meet by the hash of the beginnings.
    second = classes(given.join(large, "host", "left_semi"), True, "counted")
    repeated = second.groupBy("host", "key").agg(F.sum("held").alias("held"), F.sum("own").alias("own")).filter("held > 1").join(large, "host")
    framed = repeated.filter((F.col("own") >= FRAMED) & (F.col("own") >= F.ceil(F.col("articles") * frame)))
    # Few hosts have so many pages that more than two must agree.
    repeated = repeated.filter(F.col("held") >= F.ceil(F.col("size") * support))
    bare = second.filter(F.size("pages") > 0).join(repeated, ["host", "key"], "left_semi").select("host", "pages", "places")
    hits = first.filter(F.size("pages") > 0).select("host", "pages", "places").unionByName(bare)
    hits = hits.select("host", F.explode(F.arrays_zip("pages", "places")).alias("at"))
    # At most one place for each token of a page, and one key for each of a frame.
    covered = hits.groupBy("host", F.col("at.pages").alias("page")).agg(F.collect_set("at.places").alias("marks"))
    keys = first.filter("key IS NOT NULL AND own > 0").select("host", "key").unionByName(framed.select("host", "key"))
    keys = keys.groupBy("host").agg(F.collect_set("key").alias("marks"))
    found = stored(covered.unionByName(keys.withColumn("page", F.lit(None).cast("long"))), "repeats")
    covered = found.filter("page IS NOT NULL").select(F.col("host").alias("__host"), F.col("page").alias("__page"), F.col("marks").alias("__places"))
    keys = found.filter("page IS NULL").select(F.col("host").alias("__host"), F.col("marks").alias("__keys"))
    work = pages.select(F.struct(*kept).alias("__row"), host.alias("__host"), F.col(html).alias("__html")).join(keys, "__host", "left")
    parsed = extended(work, "__marked boolean, __page long, __text string", _articles(depth), keep=["__row", "__host", "__html"])
    parsed = parsed.withColumn("__html", F.expr("CASE WHEN NOT __marked THEN __html END"))
    whole = extended(parsed.join(covered, ["__host", "__page"], "left"), "__text string", _without(depth), keep=["__row"])
    return whole.select("__row.*", "__text").select(*[c for c in kept if c.lower() != "text"], F.col("__text").alias("text"))
