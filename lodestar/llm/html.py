"""Operator 8: main text of web pages, by structure and by what a host repeats.

A page becomes blocks of text in page order. Structure says where the text is: elements that hold menus, headers, footers,
sidebars, notices, adverts, forms or comments are left out, and text inside an article (else a main) element is kept.

Repetition is asked on every page. Each page of a host gives token streams: its lists of links, kept or left out, and where it
has neither article nor main, all that structure lets stand. They are the host's text, and the suffixes of it, sorted by their
first ``RUN`` tokens, are a suffix array of that depth: suffixes that agree so far are neighbours, and longer repeated substrings
are chains of such runs. A run counts as repeated if it occurs on ``LEAST`` pages of the host with different text, and on a share
``SHARE`` of them:

* on pages without article and main, where structure can't judge, repeated runs are cut and the words beside them stay;
* blocks that are mostly links go if the host repeats all of them, inside articles too.

All else stays: a passage that articles share, and in a block the words beside a run. Prose inside an article is never cut by
repetition, even where menus and footers hold the same sentence: articles quote, and hosts reuse their sentences.

Scale: the suffix array is dealt by prefix. Each different run is one 64-bit hash a page, counted by run with partial sums before the
shuffle; the prose of articles never moves. Hashes that stand out are joined back, broadcast if they are few, else runs of more than
``SALT_ROWS`` pages in several parts. No page's text depends on how pages are dealt to tasks, and no task holds a host. Pages without
a repeated run are read where they are and never move.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut_lineage, small_side, spread_table

RUN, LEAST, SHARE, SALT_ROWS, OUT_ROWS, PAGE_KEYS = 6, 3, 0.025, 100_000, 500, 1_000_000

#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template iframe svg annotation annotation-xml object embed canvas audio video textarea title select option datalist".split())
#: Those of them that reach to the end of the page where they are not closed; other ones without an end are passed over.
ENDLESS = frozenset("script style noscript iframe textarea title".split())
#: Elements that are left out with all they hold. A form is left out like a marked wrapper: not where it holds the page.
ASIDE = frozenset("nav header footer aside menu dialog button fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of an article's own text: their ids are anchors, and names that a mark is only a part of ("notice-of-appeal") say nothing.
PROSE = frozenset("p pre blockquote figure figcaption table section dl ol".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that end where another of the kind begins right inside them.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}}
#: Words in class, id or role that mark boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist complementary consent "
    "contentinfo cookie cookies copyright disclaimer discussion disqus footer gdpr header login masthead menu modal nav navbar navigation "
    "navigational newsletter notice notices notification overlay paging pagination popup promo promoted promotion recommended related reply "
    "replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Those of them that hide articles, too.
OTHERS_TEXT = frozenset("comment comments commentlist discussion disqus recommended related replies reply respond".split())
#: Words beside a mark that do not change what a name says.
NEUTRAL = frozenset("article articles box item items link links list post posts stories story".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+")


class Block(NamedTuple):
    """One block of a page's text. shown: whether structure lets it stand. linked: whether most of it lies in links."""

    text: str
    zone: str  # article, main or open
    shown: bool
    heading: bool
    linked: bool


class Element(NamedTuple):
    name: str
    level: int
    zone: str
    inline: bool


def _end(text: str, at: int) -> int:
    """The place after the ``>`` that closes a tag whose name ends at ``at``; quoted ones do not count. Without any, the text's end."""
    while True:
        close = text.find(">", at)
        if close < 0:
            return len(text)
        if close == at:
            return close + 1
        start = min((i for q in "\"'" if (i := _opens(text, q, at, close)) >= 0), default=-1)
        after = text.find(text[start], start + 1) if start >= 0 else -1
        if after < 0:
            return close + 1
        at = after + 1


def _opens(text: str, quote: str, at: int, close: int) -> int:
    """The first ``quote`` in text[at:close] if an equals sign stands before it, else -1."""
    i = before = text.find(quote, at, close)
    if i < 0:
        return -1
    while before > at and text[before - 1].isspace():
        before -= 1
    return i if text[before - 1 : before] == "=" else -1


@lru_cache(1 << 14)
def _marks(attributes: str, ids: bool = True) -> frozenset[str]:
    """Words of an element's class, role and (unless told otherwise) id that mark boilerplate; "hidden" if it is not shown, "whole" if a name says nothing
    else, "others" if such a name says that it is another text's."""
    found: set[str] = set()
    if attributes.strip("/ \t\n\r"):
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name in ("class", "role") or ids and name == "id":
                for one in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
                    words = set(_WORDS.findall(one))
                    found |= MARKS & words
                    if MARKS & words and not words - MARKS - NEUTRAL:
                        found |= {"whole", "others"} if words & OTHERS_TEXT else {"whole"}
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                found.add("hidden")
    return frozenset(found)


#: How far the text at some place is left out: not at all, but for headings (an article's own header), by a mark, by an element's name.
SHOWN, HEADINGS, MARKED, NAMED = range(4)


def _level(name: str, marks: frozenset[str], parent: int, zone: str) -> int:
    """How far an element with these marks is left out inside a parent in ``zone``.

    A marked wrapper (a layout "with-sidebar") does not hide an article in it; an article that is marked itself is hidden where
    something is left out already or inside another article, as comments are, and everywhere if its mark says that it is
    another text's (a class "related").
    """
    words = marks - {"whole", "others"}
    if name in ("article", "main"):
        if "others" in marks or parent == NAMED:
            return NAMED
        return max(parent, MARKED) if words and (parent or zone == "article") else SHOWN
    inner = zone != "open"
    if name in HEADING:
        # what a heading is called hides its text nowhere; an article's own header shows its headings
        return MARKED if "hidden" in words else SHOWN if parent == HEADINGS else parent
    if inner and name in PROSE and not marks & {"whole", "hidden"}:
        return parent
    if name == "header" or words == {"header"}:
        own = HEADINGS if inner else NAMED if name == "header" else MARKED
    else:
        others = "others" in marks if inner else words & OTHERS_TEXT
        own = NAMED if name in ASIDE or others else MARKED if (words or name == "form") and name not in ("body", "html") else SHOWN
    return max(parent, own)


def blocks(page: str | None) -> list[Block]:
    """The blocks of :func:`_read`. On a page without article and main, wrappers that only a part of a name marks ("no-sidebar")
    and that hold most of the page's text are read as if they had no mark."""
    found, layouts = _read(page)
    if layouts and all(b.zone == "open" for b in found if b.shown):
        return _read(page, layouts)[0]
    return found


def _read(page: str | None, shown_at: frozenset[int] = frozenset()) -> tuple[list[Block], frozenset[int]]:
    """All blocks of a page in page order, and where weakly marked elements begin that hold most of the text outside of elements
    which are left out for sure.

    White space inside a block is one space, the ends are trimmed, character references are decoded. Null or markup alone: no
    blocks. Marks of elements that begin at ``shown_at`` do not count. Phrases (button, span, a) that are left out do not split
    the block around them; of their marks only whole names count, and links are hidden by such names alone.
    """
    text, n = page or "", len(page or "")
    found: list[Block] = []
    parts: list[str] = []
    aside: list[str] = []
    stack = [Element("", SHOWN, "open", False)]
    names: Counter[str] = Counter()
    weak: list[list[int]] = []  # depth, start and characters of the weakly marked elements around
    unclosed: set[str] = set()
    sure = n  # the depth of the outermost element that is left out for sure
    links = 0
    linked, written = [0, 0], [0, 0]  # characters of this block in links, and in all: left out, and shown
    total, held, at = 0, {}, 0

    def close() -> None:
        for kept, pieces in ((True, parts), (False, aside)):
            if pieces:
                if words := " ".join(entities.unescape("".join(pieces)).split()):
                    found.append(Block(words, stack[-1].zone, kept, stack[-1].name in HEADING, 2 * linked[kept] > written[kept]))
                pieces.clear()
                linked[kept] = written[kept] = 0

    def push(name: str, level: int, zone: str, inline: bool) -> None:
        stack.append(Element(name, level, zone, inline))
        names[name] += 1

    def cut(depth: int) -> None:
        nonlocal sure
        for e in stack[depth:]:
            names[e.name] -= 1
        del stack[depth:]
        sure = n if len(stack) <= sure else sure
        while weak and weak[-1][0] >= len(stack):
            leave()

    def leave() -> None:
        """Close a weakly marked element: what it holds counts for the one around it, too."""
        _, began, size = weak.pop()
        held[began] = size
        if weak:
            weak[-1][2] += size

    def place(name: str) -> int:
        """Where the innermost open element of that name lies."""
        return next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name)

    while at < n:
        start = text.find("<", at)
        if start < 0:
            start = n
        shown = stack[-1].level == SHOWN
        if len(stack) <= sure:
            size = start - at - text.count(" ", at, start)
            total += size
            if weak:
                weak[-1][2] += size
        if start > at:
            (parts if shown else aside).append(text[at:start])
            size = start - at - text.count(" ", at, start)
            written[shown] += size
            linked[shown] += size * links
        if start == n:
            break
        if text.startswith("<!--", start):
            end = text.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if text.startswith(("<!", "<?"), start):
            end = text.find(">", start)
            at = n if end < 0 else end + 1
            continue
        tag = _TAG.match(text, start)
        if not tag:
            (parts if shown else aside).append("<")
            at = start + 1
            continue
        name, closing = tag[2].lower(), bool(tag[1])
        at = _end(text, tag.end())
        if name in RAW:
            if not closing and name not in VOID and not text[tag.end() : at].rstrip(">").endswith("/"):
                end = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(text, at)
                if end is not None:
                    at = end.end()
                elif name in ENDLESS:
                    at = n
                else:
                    unclosed.add(name)
        elif name == "br":
            (parts if shown else aside).append("\n")
        elif name not in BLOCKS:
            if name == "a":
                links = 0 if closing else 1
            if closing:
                # only the phrases inside one that is left out are on the stack
                if stack[-1].inline and names[name] and stack[place(name)].inline:
                    cut(place(name))
            elif name not in VOID:
                marks = frozenset() if start in shown_at else _marks(text[tag.end() : at - 1])
                if name in ASIDE or marks & {"whole", "hidden"}:
                    sure = min(sure, len(stack))
                    push(name, max(stack[-1].level, NAMED if name in ASIDE else MARKED), stack[-1].zone, True)
                elif stack[-1].inline:
                    push(name, stack[-1].level, stack[-1].zone, True)
        else:
            close()
            if closing:
                if names[name]:
                    cut(place(name))
            elif name not in VOID:
                outer = len(stack)
                while stack[outer - 1].inline:
                    outer -= 1
                if stack[outer - 1].name == "p":
                    cut(outer - 1)
                while stack[-1].name in ENDS.get(name, ()):
                    cut(len(stack) - 1)
                parent = stack[-1]
                zone = name if name in ("article", "main") and parent.zone != "article" else parent.zone
                kind, anchor = name, name in HEADING or parent.zone != "open" and name in PROSE
                marks = _marks(text[tag.end() : at - 1], not anchor)
                if name in HEADING:
                    marks &= {"hidden"}
                if start in shown_at:
                    kind, marks = "div", frozenset()
                if name in ASIDE or marks & {"whole", "hidden"} and name not in ("body", "html"):
                    sure = min(sure, len(stack))
                elif marks or kind == "form":
                    weak.append([len(stack), start, 0])
                push(name, _level(kind, marks, parent.level, parent.zone), zone, False)
    close()
    while weak:
        leave()
    return found, frozenset(began for began, size in held.items() if 2 * size > total)


class Page(NamedTuple):
    """A page's blocks as the method sees them: kept ones, whether they stand open (no article, no main), and the rest."""

    kept: list[Block]
    open: bool
    rest: list[Block]


def read_page(page: str | None) -> Page:
    found = blocks(page)
    zones = {b.zone for b in found if b.shown}
    zone = next((z for z in ("article", "main") if z in zones), "open")
    return Page([b for b in found if b.shown and b.zone == zone], zone == "open", [b for b in found if not b.shown or b.zone != zone])


def link_groups(found: list[Block]) -> list[list[int]]:
    """Places of blocks that are mostly links, neighbours together: entries of one list are blocks of their own."""
    groups: list[list[int]] = []
    for i, b in enumerate(found):
        if b.linked and not b.heading:
            if groups and groups[-1][-1] == i - 1:
                groups[-1].append(i)
            else:
                groups.append([i])
    return groups


@lru_cache(1 << 16)
def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def run_keys(texts: list[str], host: str) -> np.ndarray:
    """For each place in the tokens of ``texts``, one after the other, the hash of the host and the run of ``RUN`` tokens there."""
    tokens = np.array([_hash(w) for text in texts for w in text.split(" ")], np.int64)
    n = max(0, len(tokens) - RUN + 1)
    keys = np.full(n, _hash("//" + host), np.int64)
    with np.errstate(over="ignore"):
        for k in range(RUN):
            keys = (keys ^ (keys >> 31)) * np.int64(-4658895280553007687) + tokens[k : k + n]
    return keys


class Evidence(NamedTuple):
    """Run keys of one page. own: of an open page's kept text. menus: of its lists of links. links: of those that structure keeps."""

    content: int
    open: bool
    own: np.ndarray
    menus: np.ndarray
    links: np.ndarray


def _list_keys(found: list[Block], host: str) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.int64), *(run_keys([found[i].text for i in group], host) for group in link_groups(found))]))


def evidence(html: str | None, host: str) -> Evidence:
    page = read_page(html)
    texts = [b.text for b in page.kept]
    links = _list_keys(page.kept, host)
    own = np.unique(run_keys(texts, host)) if page.open else links[:0]
    # pages with one text are one page published twice
    return Evidence(_hash.__wrapped__(" ".join(texts)), page.open, own, np.union1d(_list_keys(page.rest, host), links), links)


def _covered(hits: np.ndarray) -> np.ndarray:
    """For each token whether one of the ``RUN`` runs that hold it is a hit; hits[p] is the run that begins at token p."""
    total = np.r_[0, np.cumsum(np.r_[np.zeros(RUN - 1, bool), hits, np.zeros(RUN - 1, bool)])]
    return total[RUN:] > total[:-RUN]


def without_runs(page: Page, host: str, bulk: np.ndarray, menus: np.ndarray) -> str:
    """A page's text without what its host repeats: runs of open pages (bulk), and of lists of links (menus).

    On open pages runs may span blocks, as the entries of a menu are blocks of their own; a block that they cover wholly is left
    out. Of other blocks only runs inside them are cut, so that a run which ends in a block's first words leaves them.
    """
    texts = [b.text for b in page.kept]
    words = [t.split(" ") for t in texts]
    gone: set[int] = set()
    for group in link_groups(page.kept):
        covered, at = _covered(np.isin(run_keys([texts[i] for i in group], host), menus)), 0
        for i in group:
            if len(covered) and covered[at : at + len(words[i])].all():
                gone.add(i)
            at += len(words[i])
    if not page.open:
        return "\n\n".join(t for i, t in enumerate(texts) if i not in gone)
    hits, at, kept = np.isin(run_keys(texts, host), bulk), 0, []
    around = _covered(hits) if len(hits) else np.zeros(sum(map(len, words)), bool)
    for i, block in enumerate(words):
        n = len(block)
        if i not in gone and not around[at : at + n].all():
            inside = hits[at : at + n - RUN + 1] if n >= RUN else hits[:0]
            drop = _covered(inside) if len(inside) else np.zeros(n, bool)
            kept.append(" ".join(w for w, c in zip(block, drop.tolist(), strict=True) if not c))
        at += n
    return "\n\n".join(kept)


def _batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in frames:
        for at in range(0, batch.num_rows, OUT_ROWS):
            yield batch.slice(at, OUT_ROWS)


def _read_evidence(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    longs = pa.list_(pa.int64())
    for part in _batches(frames):
        pages, hosts = part.column("html").to_pylist(), part.column("host").to_pylist()
        found = [evidence(page, host) for page, host in zip(pages, hosts, strict=True)]
        lists = [pa.array([getattr(e, name) for e in found], longs) for name in ("own", "menus", "links")]
        yield pa.RecordBatch.from_arrays(
            [part.column("pk"), part.column("hk"), pa.array([e.content for e in found], pa.int64()), pa.array([e.open for e in found], pa.bool_()), *lists],
            names=["pk", "hk", "content", "open", "own", "menus", "links"],
        )


def _read_texts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _batches(frames):
        texts = ["\n\n".join(b.text for b in read_page(page).kept) for page in part.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _cut_texts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _batches(frames):
        columns = [part.column(name).to_pylist() for name in ("html", "host", "bulk", "menus")]
        texts = [without_runs(read_page(page), host, *(np.array(k or [], np.int64) for k in keys)) for page, host, *keys in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _kinds(**arrays: str) -> Column:
    """Rows (key, kind) of array columns; their names are the kinds."""

    def rows(kind: str, name: str) -> Column:
        return F.transform(name, lambda k: F.struct(k.alias("key"), F.lit(kind).alias("kind")))

    return F.inline(F.concat(*(rows(kind, name) for kind, name in arrays.items())))


def repeated_runs(marks: DataFrame) -> DataFrame:
    """(key, bulk, menus) of runs that a host repeats, from the evidence of all pages."""
    one_each = marks.groupBy("hk", "open", "content").agg(F.min(F.struct("own", "menus")).alias("e")).select("hk", "open", "e.*")
    one_each = cut_lineage(one_each)
    sizes = small_side(one_each.groupBy("hk").agg(F.count_if("open").alias("open_pages"), F.count("*").alias("pages")))
    runs = one_each.select("hk", _kinds(bulk="own", menus="menus"))
    of = lambda kind: F.count_if(F.col("kind") == kind)
    # a key belongs to one host
    counted = runs.groupBy("key").agg(F.min("hk").alias("hk"), of("bulk").alias("n_bulk"), of("menus").alias("n_menus"))
    counted = counted.filter(F.greatest("n_bulk", "n_menus") >= LEAST).join(sizes, "hk")
    enough = lambda n, pages: F.col(n) >= F.greatest(F.lit(LEAST), SHARE * F.col(pages))
    return cut_lineage(counted.select("key", enough("n_bulk", "open_pages").alias("bulk"), enough("n_menus", "pages").alias("menus")).filter("bulk or menus"))


def joined(runs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``runs`` (pk, key, ...) that are ``repeated``: by broadcast if those are few, else keys of many rows in parts."""
    if repeated.count() <= BROADCAST_ROWS:
        return runs.join(F.broadcast(repeated), "key")
    rows = runs.join(repeated.select("key"), "key", "left_semi").groupBy("key").agg(F.count("*").alias("rows"))
    large = small_side(rows.filter(F.col("rows") > SALT_ROWS).select("key", F.ceil(F.col("rows") / SALT_ROWS).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    salted = repeated.join(large, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    dealt = runs.join(large, "key", "left").withColumn("salt", F.pmod(F.xxhash64("pk"), parts).cast("int")).drop("parts")
    return dealt.join(salted, ["key", "salt"]).drop("salt")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    Null html is an empty page; pages without text give an empty string. Null urls are one host; repeated rows are pages of
    their own with equal content. An empty table gives no rows. Other columns are ignored.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    # equal rows share a key; two others that did would only be offered each other's runs, which they do not hold
    rows = rows.select("*", F.xxhash64("page_id", "url", "html").alias("pk"), F.xxhash64("host").alias("hk"))
    arrays = ", ".join(f"{name} array<long>" for name in ("own", "menus", "links"))
    marks = cut_lineage(rows.mapInArrow(_read_evidence, f"pk long, hk long, content long, open boolean, {arrays}"))
    repeated = repeated_runs(marks)
    met = joined(marks.select("pk", _kinds(bulk="own", menus="links")), repeated).filter("case kind when 'bulk' then bulk else menus end")
    met = cut_lineage(met.groupBy("pk").agg(F.collect_set(F.when(F.col("kind") == "bulk", F.col("key"))).alias("bulk"), F.collect_set(F.when(F.col("kind") == "menus", F.col("key"))).alias("menus")))
    n_met = met.count()
    schema = "page_id long, url string, text string"
    if not n_met:
        texts = rows.mapInArrow(_read_texts, schema)
    else:
        named = met.select("pk")
        named = F.broadcast(named) if n_met <= PAGE_KEYS else named
        texts = rows.join(named, "pk", "left_anti").mapInArrow(_read_texts, schema)
        texts = texts.unionByName(rows.join(named, "pk", "left_semi").join(met, "pk").mapInArrow(_cut_texts, schema))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spread_table(spark, sf_dir, "pages"))
