"""Main text of web pages, with boilerplate found as long substrings repeated across a host's pages.

Pages become blocks of text with the elements they stand in. All text of a host outside marked articles is read as one
concatenation of token streams, one a page. Its suffix array would put suffixes with the same first tokens side by
side; a maximal repeat of at least `LONG` tokens is a run of intervals of suffixes that share their first `LONG`, one
interval for each place in it but the last ones, so the union of these places is what the maximal repeats cover. The
intervals are found by grouping suffixes on a fingerprint of these tokens, without putting a host's suffixes into one
sorted list, so that a host with a third of all pages is summed up before any shuffle. Whole blocks, of articles too, are
grouped in the same way whatever their length.

What repeats is boilerplate where enough of the host's distinct pages hold it (`LEAST_PAGES`, `SHARE`); a quotation or
an ordinary phrase is not. Near-copies of a page count as one page. On every page, the uncovered runs are its text, in
page order. Markup does two things besides. It rules out what is no main text even if it stands on one page only, such
as an advert or a reader's comment. And it protects a marked article: a passage in it may well occur on other pages, so
its blocks go only if they stand on most pages of the host (`ARTICLE_LEAST_PAGES`, `ARTICLE_SHARE`).

Outside articles, classes and ids rule out containers by words in them; within a marked article only element kinds, roles
and a few whole names do. Headings, paragraphs, quotations and the like are never ruled out by their own class, and a
header within an article is part of it.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, mix64, read, settle, text_bytes, window_hashes, word_hashes

#: Tokens in the shortest substring that counts as repeated if it is not a whole block; the mark before each block is
#: a token.
LONG = 24
#: Distinct pages of the host that must hold a substring, at least, and their share.
LEAST_PAGES, SHARE = 3, 0.2
#: The same for a whole block of a marked article.
ARTICLE_LEAST_PAGES, ARTICLE_SHARE = 5, 0.5
#: Pages are near-copies where so large a part of their minimum hashes over windows of `SHINGLE` tokens agrees.
SHINGLE, BANDS, ROWS, ALIKE = 5, 12, 5, 0.7
#: Repeats of all hosts that go to every executor, at most; more are joined by a shuffle.
BROADCAST = 2_000_000
#: Copies of a repeat, and parts of the pages that meet them, in that shuffle.
SPREAD = 16
_ODD = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)

_TAGS = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*+)>
    |<[!?/a-zA-Z][^>]*+(?:>|\Z)
    |[^<]++|<""",
    re.VERBOSE | re.DOTALL | re.IGNORECASE,
)
#: One attribute after another, so that nothing in a value passes for a name.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements and words in class, id or role whose content is not main text.
ASIDE = frozenset("nav header footer aside form menu head button dialog fieldset label input select option audio video canvas map svg".split())
#: Of these, what may be wrapped around text by mistake.
WRAPPERS = frozenset("form fieldset dialog".split())
#: Elements whose content is no markup; without an end tag, the first two reach to the page's end, the others nowhere.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
#: Elements that a class or id does not rule out.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr tbody b i em strong a code figcaption caption html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies dialog disclaimer disqus footer form gdpr legal masthead menu modal nav navbar navigation newsletter notice notices notification alert pagination paywall popup promo promoted recommended related reply replies respond search share sharing sidebar skip social sponsor sponsored subscribe toolbar widget complementary".split())
_NAMED = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
#: Roles whose content is not main text.
ASIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Within a marked article a class or id rules out by its whole name only (words joined by hyphens), since an article's own
#: sections are named after what they are about, such as market-share.
PARTS = frozenset("ad ads ad-slot advert adverts advertisement advertising sponsored comment comments comment-list comments-list comment-section commentlist disqus-thread post-comments reader-comments user-comments respond replies sidebar newsletter newsletter-signup subscribe notice cookie-notice cookie-banner paywall popup breadcrumb breadcrumbs navbar navigation pagination related related-articles related-posts share sharing social social-share share-buttons site-header site-footer skip-link toolbar widget".split())
#: An article's parts are named like this, too, so a header must be the site's.
_SITE_HEADER = re.compile(r"(?:(?:site|page|global|top|nav)[-_]?)?header", re.IGNORECASE)


Blocks = list[tuple[str, bool]]


@dataclass
class Page:
    """Blocks in page order: text, whether the page's article holds it, whether an element rules it out."""

    blocks: list[tuple[str, bool, bool]] = field(default_factory=list)
    has_article: bool = False

    def main(self) -> list[str]:
        return [t for t, inside, out in self.blocks if inside and not out]

    def rest(self) -> Blocks:
        """All blocks that are not the article's text; everything where no article is marked."""
        return [(t, out) for t, inside, out in self.blocks if not (self.has_article and inside and not out)]


def _attributes(rest: str) -> dict[str, str]:
    """Names in lower case and values of a tag's attributes; of a repeated one the first counts, as in browsers."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        out.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
    return out


def _set_aside(name: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element's content is no main text; `inside` says that a marked article holds it."""
    if name in ASIDE and not (inside and name == "header"):
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or attributes.get("role", "").lower() in ASIDE_ROLES:
        return True
    if "style" in attributes and re.search(r"(?:^|;)\s*display\s*:\s*none", attributes["style"], re.IGNORECASE):
        return True
    if name in TEXTUAL:
        return False
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w.lower() for w in _NAMED.findall(token)]
        if inside:
            if "-".join(words) in PARTS:
                return True
        elif not re.match(r"(has|with|no|without)[-_]", token, re.IGNORECASE) and any(w in ASIDE_WORDS for w in words) or _SITE_HEADER.fullmatch(token):
            return True
    return False


class _Open:
    """Elements that are open, with what each does to the text in it, and how many there are of each name."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, int]] = []
        self.names: dict[str, int] = {}
        self.inside = self.aside = self.headers = 0

    def push(self, name: str, marks: int, out: int) -> None:
        self.stack.append((name, marks, out))
        self.names[name] = self.names.get(name, 0) + 1
        self._count(name, marks, out, 1)

    def pop(self) -> None:
        name, marks, out = self.stack.pop()
        self.names[name] -= 1
        self._count(name, marks, out, -1)

    def _count(self, name: str, marks: int, out: int, by: int) -> None:
        self.inside += by * marks
        self.aside += by * out
        self.headers += by * (name == "header")

    def close(self, name: str) -> None:
        """An end tag closes what is open within its element; one without an element does nothing."""
        if self.names.get(name):
            while self.stack[-1][0] != name:
                self.pop()
            self.pop()

    def last(self) -> str:
        return self.stack[-1][0] if self.stack else ""


def parse(source: str | None) -> Page:
    """Blocks of a page. Unclosed and stray tags, cut comments and tags at the end, and unknown elements are borne; time
    grows with the page's length, whatever its depth.
    """
    source = source or ""
    page, text, open_ = Page(), [], _Open()
    ends: dict[str, tuple[int, int]] = {}
    at, size = 0, len(source)

    def close_block() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if line:
                page.blocks.append((line, open_.inside > 0, open_.aside > 0))

    def raw_end(name: str, start: int) -> int:
        """Where the content of such an element ends with its end tag; each end tag is looked for once."""
        if name not in ends or 0 <= ends[name][0] < start:
            found = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE).search(source, start)
            ends[name] = (found.start(), found.end()) if found else (-1, size if name in ("script", "style") else -1)
        return ends[name][1]

    def closes(name: str, start: int) -> bool:
        """Whether an end tag of a form or the like follows; the last one is looked for once."""
        if name not in WRAPPERS:
            return True
        if name not in last:
            last[name] = max((m.start() for m in re.finditer(f"</{name}", source, re.IGNORECASE)), default=-1)
        return last[name] >= start

    last: dict[str, int] = {}
    while at < size:
        m = _TAGS.match(source, at)
        piece, at = m[0], m.end()
        if piece[0] != "<" or len(piece) == 1:
            text.append(piece)
            continue
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if name == "br":
            text.append(" ")
            continue
        block = name in BLOCK
        if block:
            close_block()
        if m["end"] or m["end2"]:
            if open_.names.get(name) and not block:
                close_block()
            open_.close(name)
            continue
        rest = m["rest"] or m["rest2"] or ""
        if name in RAW:
            at = max(at, raw_end(name, at))
            continue
        if name in VOID or rest.endswith("/") and not block:
            continue
        while block and name not in ("option", "optgroup") and open_.last() in ("select", "option", "optgroup"):
            open_.pop()
        if name in ("p", "li", "dd", "dt", "td", "th", "tr", "option") and open_.last() == name:
            open_.pop()
        if block and name != "p" and open_.last() == "p":
            open_.pop()
        attributes = _attributes(rest) if "=" in rest or "hidden" in rest.lower() else {}
        # A form that is never closed rules out nothing, since its end would be a guess.
        out = _set_aside(name, attributes, open_.inside > 0) and closes(name, at)
        marks = not out and (name in ("article", "main") or attributes.get("role", "").lower() == "main")
        if not block and not out and not marks:
            continue
        if out and not block:
            close_block()
        page.has_article |= marks and not open_.aside
        open_.push(name, int(marks), int(out))
    close_block()
    return page


def stream(texts: list[str]) -> np.ndarray:
    """Token hashes of blocks, each led by a mark."""
    if not texts:
        return np.zeros(0, np.uint64)
    words = word_hashes(text_bytes("\n".join(texts)))
    return np.insert(words, np.cumsum([0, *(t.count(" ") + 1 for t in texts[:-1])]), np.uint64(0x51ED270B))


def _host_hash(host: str) -> np.uint64:
    return np.bitwise_xor.reduce(mix64(word_hashes(text_bytes(host)) + np.uint64(1))) if host else np.uint64(0)


def _lengths(texts: list[str]) -> np.ndarray:
    return np.fromiter((t.count(" ") + 2 for t in texts), np.int64, len(texts))


def _block_heads(tokens: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Fingerprints of whole blocks, from their stream."""
    if not len(length):
        return np.zeros(0, np.uint64)
    first = np.cumsum(length) - length
    place = (np.arange(len(tokens)) - np.repeat(first, length)).astype(np.uint64)
    return mix64(np.add.reduceat(mix64(tokens ^ mix64(place)), first) + length.astype(np.uint64) + np.uint64(0xB10C))


@dataclass
class Units:
    """What of a page can repeat: suffixes by position and whole blocks, outside the article, then the article's blocks."""

    page: Page
    host: np.uint64
    heads: np.ndarray
    outside: int
    windows: np.ndarray


def units_of(sources: list[str | None], hosts: list[str], shingles: bool = False) -> list[Units]:
    """Pages are hashed together, since calls for single pages cost more than the work."""
    pages = [parse(h) for h in sources]
    parts = [([t for t, _ in p.rest()], p.main() if p.has_article else []) for p in pages]
    rest, main = ([t for part in parts for t in part[k]] for k in (0, 1))
    outside, article = stream(rest), stream(main)
    rest_length, main_length = _lengths(rest), _lengths(main)
    suffixes = window_hashes(outside, LONG) if len(outside) >= LONG else np.zeros(0, np.uint64)
    rest_blocks, main_blocks = _block_heads(outside, rest_length), _block_heads(article, main_length)
    out, r, m, i, j = [], 0, 0, 0, 0
    for page, name, (own, marked) in zip(pages, hosts, parts, strict=True):
        n, k = int(rest_length[i : i + len(own)].sum()), int(main_length[j : j + len(marked)].sum())
        at = _host_hash(name)
        heads = mix64(np.concatenate([suffixes[r : r + max(n - LONG + 1, 0)], rest_blocks[i : i + len(own)], main_blocks[j : j + len(marked)]]) ^ at)
        windows = window_hashes(np.concatenate([article[m : m + k], outside[r : r + n]]), SHINGLE) if shingles else np.zeros(0, np.uint64)
        out.append(Units(page, at, heads, len(heads) - len(marked), windows))
        r, m, i, j = r + n, m + k, i + len(own), j + len(marked)
    return out


def signatures(windows: list[np.ndarray]) -> list[np.ndarray]:
    """Minimum hashes of pages' windows; none for a page without text."""
    length = np.array([len(w) for w in windows], np.int64)
    if not length.any():
        return [np.zeros(0, np.uint64)] * len(windows)
    joined, first = np.concatenate(windows), (np.cumsum(length) - length)[length > 0]
    least = iter(np.stack([np.minimum.reduceat(joined * k, first) for k in _ODD], axis=1))
    return [next(least) if n else np.zeros(0, np.uint64) for n in length]


def uncovered_runs(rest: Blocks, at: list[int]) -> tuple[list[str], int]:
    """(words of each block that no repeat covers, none of one that is ruled out; code points covered), from the places
    of repeated heads: suffixes first, then whole blocks.
    """
    runs, hidden, first = [], 0, 0
    size = sum(t.count(" ") + 2 for t, _ in rest)
    suffixes = max(size - LONG + 1, 0)
    covered = np.zeros(size, bool)
    whole = {k - suffixes for k in at if k >= suffixes}
    for k in at:
        if k < suffixes:
            covered[k : k + LONG] = True
    for i, (text, out) in enumerate(rest):
        words = text.split(" ")
        here = covered[first + 1 : first + 1 + len(words)]
        first += 1 + len(words)
        if i in whole:
            here = np.ones(len(words), bool)
        if here.any():
            hidden += sum(len(w) for w, c in zip(words, here, strict=True) if c)
            words = [w for w, c in zip(words, here, strict=True) if not c]
        runs.append("" if out else " ".join(words))
    return runs, hidden


def near_copies(units: DataFrame) -> DataFrame:
    """row, page: for rows that are copies or near-copies of another one, the row they count as."""
    bands = units.select("row", F.explode("bands").alias("band"))
    led = bands.groupBy("band").agg(F.min("row").alias("page"), F.max("row").alias("high")).filter("page != high").select("band", "page")
    pairs = bands.join(led, "band").filter("row != page").select("row", "page").distinct()
    sign = units.select("row", "sign").dropDuplicates(["row"])
    pairs = pairs.join(sign, "row").join(sign.select(F.col("row").alias("page"), F.col("sign").alias("other")), "page")
    same = F.aggregate(F.zip_with("sign", "other", lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x)
    alike = pairs.filter(same >= ALIKE * BANDS * ROWS).groupBy("row").agg(F.min("page").alias("page"))
    # The row with the least number of a group leads it; a leader that follows another one takes its followers along.
    up = alike.select(F.col("row").alias("page"), F.col("page").alias("top"))
    alike = alike.join(up, "page", "left").select("row", F.coalesce("top", "page").alias("page"))
    twice = units.groupBy("row").count().filter("count > 1").select("row", F.col("row").alias("page"))
    leaders = alike.select(F.col("page").alias("row"), "page").union(twice)
    return alike.union(leaders).groupBy("row").agg(F.min("page").alias("page"))


def repeats_by_page(units: DataFrame, repeated: DataFrame) -> DataFrame:
    """row, repeats, most: what each page holds of its host's repeats, for tables with too many to send to all. Heads are
    met one by one, and the repeats are copied to `SPREAD` parts, so that a head on a third of all pages is many keys.
    Pages then go by their own number, not by host.
    """
    copies = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part")
    some = repeated.select("host_id", F.explode("repeats").alias("head")).select("host_id", "head", F.lit(False).alias("is_most"), copies)
    most = repeated.select("host_id", F.explode("most").alias("head")).select("host_id", "head", F.lit(True).alias("is_most"), copies)
    held = units.select("row", F.col("host").alias("host_id"), F.pmod(F.col("row"), F.lit(SPREAD)).cast("int").alias("part"), F.explode(F.array_distinct("heads")).alias("head")).distinct()
    met = held.join(some.unionByName(most), ["host_id", "head", "part"])
    of = lambda flag: F.collect_set(F.when(F.col("is_most") == flag, F.col("head")))
    return met.groupBy("row").agg(of(False).alias("repeats"), of(True).alias("most"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and repeated_chars (code points of words that the host's repeats cover).

    One row comes out for each row in, repeated rows included; an empty table gives none. Null and empty html have no
    text, which is given as an empty string; a null url is a host of its own. Copies and near-copies of a page do not
    count as repeats of it; pages are told apart by 64 bits of their contents. Other columns are not read, whatever
    their names. Pages are read whole.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    kinds = dict(pages.dtypes)
    rows = pages.select("page_id", "url", "html", host.alias("host"), F.xxhash64(host).alias("host_id"), F.xxhash64("page_id", "url", "html").alias("row"))

    def heads(batch: pa.RecordBatch) -> pa.RecordBatch:
        units = units_of(batch.column("html").to_pylist(), batch.column("host").to_pylist(), shingles=True)
        out = []
        for u, sign in zip(units, signatures([u.windows for u in units]), strict=True):
            bands = mix64(window_hashes(sign, ROWS)[::ROWS] ^ u.host ^ mix64(np.arange(BANDS, dtype=np.uint64))) if len(sign) else sign
            out.append((u.heads.view(np.int64), bands.view(np.int64), mix64(sign).astype(np.uint8).view(np.int8)))
        columns = list(zip(*out, strict=True)) if out else [()] * 3
        kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int8()))
        return pa.RecordBatch.from_arrays([batch.column("row"), batch.column("host_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["row", "host", "heads", "bands", "sign"])

    units = settle(map_batches(rows.select("row", "html", "host", "host_id"), heads, "row bigint, host bigint, heads array<bigint>, bands array<bigint>, sign array<tinyint>"))
    copies = settle(near_copies(units.select("row", "bands", "sign")))
    # Pages without copies are summed up before the shuffle; of the others, each group counts once.
    paged = units.select("row", "host", "heads").join(copies, "row", "left")
    single, grouped = paged.filter("page IS NULL"), paged.filter("page IS NOT NULL")
    pages_of = single.select("host").union(grouped.select("host", "page").distinct().select("host")).groupBy("host").agg(F.count("*").alias("pages"))
    head = F.explode(F.array_distinct("heads")).alias("head")
    held = single.select("host", head).union(grouped.select("host", "page", head).distinct().select("host", "head"))
    held = held.groupBy("host", "head").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_PAGES)
    repeated = held.join(pages_of, "host").filter(F.col("n") >= SHARE * F.col("pages"))
    most = (F.col("n") >= ARTICLE_LEAST_PAGES) & (F.col("n") > ARTICLE_SHARE * F.col("pages"))
    # A host has at most 1 / SHARE times as many as a page has heads, on average, however many pages there are.
    repeated = repeated.groupBy("host").agg(F.collect_list("head").alias("repeats"), F.collect_list(F.when(most, F.col("head"))).alias("most"))

    repeated = settle(repeated.withColumnRenamed("host", "host_id"))
    total = repeated.agg(F.sum(F.size("repeats") + F.size("most"))).first()[0] or 0
    asked = rows.select("page_id", "url", "html", "host", "host_id", "row")
    if total <= BROADCAST:  # then no page is moved
        asked = asked.join(F.broadcast(repeated), "host_id", "left")
    else:
        asked = asked.join(settle(repeats_by_page(units, repeated)), "row", "left")

    def text(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, hidden = [], []
        none = pa.scalar([], pa.list_(pa.int64())).values
        for u, some, most in zip(units_of(batch.column("html").to_pylist(), batch.column("host").to_pylist()), batch.column("repeats"), batch.column("most"), strict=True):
            own = u.heads.view(np.int64)
            outside, inside = (np.flatnonzero(np.isin(x, (y.values if y.is_valid else none).to_numpy(zero_copy_only=False))).tolist() for x, y in ((own[: u.outside], some), (own[u.outside :], most)))
            runs, n = uncovered_runs(u.page.rest(), outside)
            gone, blocks = set(inside), u.page.main() if u.page.has_article else []
            n += sum(len(blocks[i]) - blocks[i].count(" ") for i in gone)
            own, other = iter("" if i in gone else t for i, t in enumerate(blocks)), iter(runs)
            in_order = [next(own if u.page.has_article and held and not out else other) for _, held, out in u.page.blocks]
            texts.append("\n\n".join(t for t in in_order if t))
            hidden.append(n)
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(hidden, pa.int64())], names=["page_id", "url", "text", "n_chars", "repeated_chars"])

    return map_batches(asked.select("page_id", "url", "html", "host", "repeats", "most"), text, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint, repeated_chars bigint")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(read(spark, sf_dir, "pages"))
