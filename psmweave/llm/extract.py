"""Main text of web pages by a suffix array per host.

1. Each page is parsed into blocks of text with decoded character references. Blocks inside an article
   container are the article; blocks inside marked-up boilerplate (menus, asides, forms, adverts,
   notices, comments, ... by element or by words of ``class``, ``id`` and ``role``) are dropped, unless
   the article's own container says otherwise; all others are open.
2. The words of a page outside its article form its stream, menus included, as their text may return
   on other pages without markup. A separator of its own ends every block, and blocks of fewer than
   ``RUN`` words are filled up, so that a short block is compared as a whole. Equal streams of a host are
   one, with the number of pages that have it; pages of equal text, article included, count once. Streams are dealt to chunks of a
   host of about ``CHUNK_WORDS`` words, so a host with a third of all pages is many groups.
3. In each chunk the streams are concatenated and the suffix array is sorted by prefix doubling up to
   ``RUN`` words. Neighbours that agree on ``RUN`` words form
   a repeated substring; the pages of their streams are counted over all chunks of the host.
4. A substring on ``MIN_PAGES`` distinct pages is boilerplate, whatever the size of the host. Open
   blocks lose the words it covers; the unique runs stay. Article blocks keep every word: equal or
   quoted articles are no boilerplate.

A page without an article container is all open blocks, so its text is what repetition leaves.
Defined results: null and empty html give an empty text; every row gets a row; repeated rows get equal
results and count once for repetition; a null ``page_id`` or ``url`` is like any other (a null url
belongs to the host ""); other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psmweave.llm.store import written

RUN = 20
MIN_PAGES = 3
CHUNK_WORDS = 200_000

#: Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style noscript template svg math iframe object canvas audio video map datalist".split())
BOILERPLATE = frozenset("nav aside footer form button select textarea menu dialog".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
STRUCTURE = frozenset("article aside body blockquote dd div dl dt fieldset figure footer form header html li main menu nav ol section table tbody td th tr ul".split())
MARKED_WORDS = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disqus footer gdpr login menu modal nav navbar navigation newsletter notice notification pagination "
    "pager popup promo promoted related replies reply respond search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription toolbar widget widgets masthead".split()
)
#: Words that make an ``article`` element a comment, a teaser or an advert.
NO_ARTICLE = frozenset(
    "ad ads adv advert advertisement adverts comment comments disqus promo promoted related replies reply respond "
    "sponsor sponsored teaser teasers".split()
)
ARTICLE_NAMES = frozenset(
    "article articlebody article-body article-content article-text article__body content-body entry-content main "
    "main-content maincontent post-body post-content post-text story story-body".split()
)

OPEN, ARTICLE, DROPPED = 0, 1, 2

#: Places of a stream that hold no word: the end of a block, and what fills up a short one.
END, FILL = 0, 1


@dataclass
class _Element:
    tag: str
    state: int


@dataclass
class Blocks(HTMLParser):
    """Collects ``(state, text)`` blocks in page order."""

    found: list[tuple[int, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[_Element] = []
        self.parts: list[str] = []
        self.unseen: list[str] = []

    def state(self) -> int:
        return self.stack[-1].state if self.stack else OPEN

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            self.found.append((self.state(), text))

    def judge(self, tag: str, attrs: dict[str, str]) -> int | None:
        """The state that an element sets for what is inside, or None."""
        names = {n.lower() for k in ("class", "id", "role", "itemprop") for n in (attrs.get(k) or "").split()}
        within = self.state()
        if within == DROPPED:
            return None
        if (
            tag in BOILERPLATE
            or "hidden" in attrs
            or (attrs.get("aria-hidden") or "").lower() == "true"
            or "display:none" in (attrs.get("style") or "").lower().replace(" ", "")
        ):
            return DROPPED
        words = {w for n in names for w in re.split("[-_]+", n)}
        if tag == "article" and words & NO_ARTICLE:
            return DROPPED
        if tag in ("article", "main") or names & ARTICLE_NAMES:
            return ARTICLE
        if within == ARTICLE and tag not in BLOCK and tag != "ins":
            return None  # a word of the article's text, whatever its style is called
        if words & MARKED_WORDS or ((tag == "header" or "header" in words) and within != ARTICLE):
            return DROPPED
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.unseen:
            if tag == self.unseen[-1]:
                self.unseen.append(tag)
            elif tag == "body":
                self.unseen.clear()
            else:
                return
        if tag in UNSEEN:
            self.flush()
            self.unseen.append(tag)
            return
        if tag in BLOCK:
            self.flush()
            if self.stack and self.stack[-1].tag == "p":
                self.stack.pop()
            if tag == "li" and self.stack and self.stack[-1].tag == "li":
                self.stack.pop()
        if tag in VOID:
            return
        state = self.judge(tag, dict(attrs))
        if state is not None and tag not in BLOCK:
            self.flush()
        if state is not None or tag in STRUCTURE:
            self.stack.append(_Element(tag, self.state() if state is None else state))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if self.unseen:
            if tag == self.unseen[-1]:
                self.unseen.pop()
            return
        if tag in BLOCK:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                if tag not in BLOCK:
                    self.flush()
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.parts.append(data)


def blocks(html: str) -> list[tuple[int, str]]:
    parser = Blocks()
    html = re.sub(r"<!\[(?!CDATA\[)[^>]*>", "", html)
    comment = html.rfind("<!--")
    if comment >= 0 and "-->" not in html[comment:]:
        html = html[:comment]
    parser.feed(re.sub(r"<[A-Za-z/][^<>]*\Z", "", html))  # a tag that the end of the page cuts off
    parser.close()
    parser.flush()
    return parser.found


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


_PARSED = "page_id long, url string, host string, stream long, text string, blocks array<struct<state:int,text:string>>"
_BLOCKS = pa.list_(pa.struct([("state", pa.int32()), ("text", pa.string())]))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages without open blocks come with their text, the others with their blocks."""
    for batch in batches:
        streams, texts, kept = [], [], []
        for html in batch.column(3).to_pylist():
            found = blocks(html or "")
            streams.append(stream_key(found))
            undecided = any(s == OPEN for s, _ in found)
            texts.append(None if undecided else " ".join(t for s, t in found if s == ARTICLE))
            kept.append([{"state": s, "text": t} for s, t in found] if undecided else None)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(streams, pa.int64()), pa.array(texts, pa.string()), pa.array(kept, _BLOCKS)],
            names=["page_id", "url", "host", "stream", "text", "blocks"],
        )


def _hash(text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))


def stream_words(found: list[tuple[int, str]], run: int) -> list[int]:
    """Word hashes of all blocks outside the article."""
    out: list[int] = []
    for state, text in found:
        if state != ARTICLE:
            words = text.split(" ")
            out += map(_hash, words)
            out += [FILL] * (run - len(words))
            out.append(END)
    return out


def stream_key(found: list[tuple[int, str]]) -> int | None:
    """Identifies a stream; None where there is none."""
    outside = "\n".join(t for s, t in found if s != ARTICLE)
    return _hash(outside) if outside else None


def _streams(run: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(html or "") for html in batch.column(1).to_pylist()]
            keys = [stream_key(f) for f in found]
            whole = [_hash("\n".join(f"{s} {t}" for s, t in f)) for f in found]
            words = [None if k is None else stream_words(f, run) for f, k in zip(found, keys, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.int64()), pa.array(whole, pa.int64()), pa.array(words, pa.list_(pa.int64()))],
                names=["host", "stream", "page", "words"],
            )

    return rows


def suffix_ranks(words: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes by their first ``depth`` words, by prefix doubling; equal prefixes, equal ranks."""
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    done = 1
    while done < depth:
        step = min(done, depth - done)  # the next words are known from the rank ``step`` further on
        ahead = np.full(len(rank), -1, np.int64)
        ahead[:-step] = rank[step:] if step < len(rank) else ahead[:-step]
        rank = np.unique(rank * (len(rank) + 1) + ahead + 1, return_inverse=True)[1].astype(np.int64)
        done += step
    return rank


def repeated_runs(streams: list[np.ndarray], run: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(hash, streams, places)`` of every distinct run of ``run`` words: where it starts, and in which stream.

    The suffix array orders the places of the concatenation; a group of equal ranks is a run. Runs do
    not reach over the end of a block.
    """
    lengths = np.array([len(s) + 1 for s in streams])
    text = np.concatenate([np.append(s, END) for s in streams])
    starts = np.cumsum(lengths) - lengths
    ends = text == END
    rank = suffix_ranks(text, run)
    until = np.concatenate((np.cumsum(ends), np.full(run, ends.sum() + 1)))  # a run has no end inside
    whole = until[np.arange(len(text)) + run - 1] == until[: len(text)] - ends
    suffixes = np.argsort(rank, kind="stable")
    suffixes = suffixes[whole[suffixes]]
    owner = np.searchsorted(starts, suffixes, "right") - 1
    place = suffixes - starts[owner]
    bounds = np.flatnonzero(np.concatenate(([True], np.diff(rank[suffixes]) > 0, [True]))) if len(suffixes) else []
    for a, b in zip(bounds[:-1], bounds[1:]):
        first = text[suffixes[a] : suffixes[a] + run]
        yield _signed(xxhash.xxh64_intdigest(first.tobytes())), owner[a:b], place[a:b]


def _runs(run: int):
    def of_chunk(part: pa.Table) -> pa.Table:
        host = part["host"][0].as_py()
        ids, pages = part["stream"].to_numpy(), part["pages"].to_numpy()
        streams = [np.asarray(x.values) for x in part["words"]]
        rows = [
            (host, h, int(pages[np.unique(owner)].sum()), ids[owner].tolist(), place.tolist())
            for h, owner, place in repeated_runs(streams, run)
        ]
        types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = ["host", "run", "pages", "streams", "places"]
        columns = list(zip(*rows)) or [[]] * 5
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types)})

    return of_chunk


def covered_places(pages: DataFrame, run: int = RUN, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, stream, places``: where boilerplate runs start in each distinct stream of a host."""
    hosted = pages.select(_host(pages["url"]).alias("host"), F.col("html"))
    distinct = written(
        hosted.mapInArrow(_streams(run), "host string, stream long, page long, words array<long>")
        .filter("stream IS NOT NULL")
        .groupBy("host", "stream", "page")
        .agg(F.first("words").alias("words")),
        "distinct-pages",
    )
    streams = written(
        distinct.groupBy("host", "stream").agg(F.first("words").alias("words"), F.count("*").alias("pages")), "streams"
    )
    sizes = streams.groupBy("host").agg(
        F.ceil(F.sum(F.size("words")) / F.lit(CHUNK_WORDS)).cast("int").alias("chunks")
    )
    runs = (
        streams.join(sizes, "host")
        .select("host", "stream", "words", "pages", F.pmod(F.xxhash64("stream"), F.col("chunks")).alias("chunk"))
        .groupBy("host", "chunk")
        .applyInArrow(_runs(run), "host string, run long, pages long, streams array<long>, places array<int>")
    )
    runs = written(runs, "runs")
    boilerplate = (
        runs.groupBy("host", "run")
        .agg(F.sum("pages").alias("pages"))
        .filter(F.col("pages") >= min_pages)
        .select("host", "run")
    )
    return (
        runs.join(boilerplate, ["host", "run"])
        .select("host", F.explode(F.arrays_zip("streams", "places")).alias("at"))
        .groupBy("host", F.col("at.streams").alias("stream"))
        .agg(F.collect_set("at.places").alias("places"))
    )


def _host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def unique_text(found: list[tuple[int, str]], places: list[int], run: int = RUN) -> str:
    """Article blocks, and the words of open blocks that no boilerplate run covers, in page order."""
    covered: set[int] = set()
    for p in places:
        covered.update(range(p, p + run))
    out, at = [], 0
    for state, text in found:
        if state == ARTICLE:
            out.append(text)
            continue
        words = text.split(" ")
        if state == OPEN:
            out += [w for i, w in enumerate(words, at) if i not in covered]
        at += max(len(words), run) + 1
    return " ".join(out)


def _finish(run: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                unique_text([(b["state"], b["text"]) for b in found], places or [], run)
                for found, places in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rows


def main_text(pages: DataFrame, run: int = RUN, min_pages: int = MIN_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""
    places = covered_places(pages, run, min_pages)
    parsed = pages.select(F.col("page_id").cast("long"), "url", _host(F.col("url")).alias("host"), "html").mapInArrow(_parse, _PARSED)
    decided = parsed.filter("blocks IS NULL").select("page_id", "url", "text")
    open_ = (
        parsed.filter("blocks IS NOT NULL")
        .select("page_id", "url", "host", "stream", "blocks")
        .join(places, ["host", "stream"], "left")
        .select("page_id", "url", "blocks", "places")
        .mapInArrow(_finish(run), "page_id long, url string, text string")
    )
    return decided.unionAll(open_).withColumn("n_chars", F.length("text").cast("long"))
