"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into its leaf blocks, the runs of text between block-level tags. Each block is described by its ancestors
(tags, words of their class, id and role attributes, whether a tag stands inside an article) and by its text (length,
share of links, punctuation, typical words), and the chain of blocks is labelled main text or not: trained on labelled
pages by maximum likelihood (forward-backward, in numpy), decoded by Viterbi. Pages are independent, so extraction is one
pass without a shuffle.
"""

from __future__ import annotations

import html as htmllib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import slices

#: Fixed sets of the markup language.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
HIDDEN_TAGS = frozenset("script style template svg iframe noframes textarea title".split())
VOID_TAGS = frozenset("hr".split())
CLOSES_P = BLOCK_TAGS - frozenset("button caption label legend option optgroup select td th tr tbody thead tfoot body html".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",), "body": ("head",)}
SCOPES = frozenset("table ul ol dl select html body".split())
KEEP_P = ("button", "td", "th", "table")

_OPENING = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*"|'[^']*')*+>""")
_HIDDEN_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in HIDDEN_TAGS}
_LONG_NUMBER = re.compile(r"&#(?:[0-9]{9,}|[xX][0-9a-fA-F]{9,});?")
_ATTRIBUTE = re.compile(r"""(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Words of attribute values, by what they usually mark.
NAME_GROUPS = {
    "ad": "ad ads adv advert advertisement advertising adsbygoogle adslot sponsor sponsored promo promotion banner commercial",
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar tabs skip topnav subnav toc directory contentinfo",
    "side": "sidebar side aside widget widgets related recommend recommended recommendations trending popular rail complementary teaser teasers",
    "comment": "comment comments commentlist reply replies respond discussion disqus thread responses reader readers",
    "foot": "foot footer copyright legal colophon bottom imprint",
    "head": "header masthead topbar logo brand banner site top",
    "notice": "cookie cookies consent gdpr notice notices alert warning popup modal overlay paywall subscribe subscription newsletter signup announcement dialog toast privacy",
    "social": "social share sharing follow shares tweet",
    "form": "form search login signin register input contact poll survey",
    "content": "content article post entry story body text main prose markdown page single blog",
}
_GROUP_OF = {w: g for g in reversed(NAME_GROUPS) for w in NAME_GROUPS[g].split()}
_SHOWN_TAGS = "nav footer header aside form article main section ul ol li table td p h1 h2 h3 h4 div button figure figcaption blockquote pre dl dialog menu address details label fieldset option select".split()
_INSIDE = ("header", "footer", "aside", "nav", "form", "section", "ul", "figure")
_TYPICAL = re.compile(r"\b(?:cookies?|subscribe|newsletter|sign (?:in|up)|log ?in|register|advert(?:isement)?|sponsored|share|tweet|menu|home|contact|privacy|terms|copyright|all rights reserved|read more|comments?|reply|related|search|follow us|next|previous|accept)\b", re.I)

_NAMES = (
    [f"tag:{t}" for t in _SHOWN_TAGS] + [f"parent:{t}" for t in _SHOWN_TAGS] + [f"name:{g}" for g in NAME_GROUPS] + [f"{t} in article" for t in _INSIDE] + [f"name:{g} in article" for g in NAME_GROUPS]
    + [f"words:{k}" for k in range(7)] + [f"links:{k}" for k in range(4)] + ["ends", "commas", "(c)", "separators", "typical", "typical short", "digits", "capitals", "first", "last", "early", "late", "always"]
)
FEATURE = {name: i for i, name in enumerate(_NAMES)}


@dataclass(slots=True)
class Block:
    """text is decoded and single-spaced; linked counts its characters inside links; about has the ancestors' features."""

    text: str
    linked: int
    about: frozenset[int]
    parent: str


#: Characters of a tag's attributes up to which what they say is kept for the next such tag.
KEPT = 300


@lru_cache(maxsize=20_000)
def _own_kept(tag: str, attributes: str) -> tuple[int, ...]:
    """Features of one element: its tag and the groups of its attribute words."""
    out = [FEATURE[f"tag:{tag}"]] if f"tag:{tag}" in FEATURE else []
    for m in _ATTRIBUTE.finditer(attributes):
        for word in _NAME_WORD.findall(m[2] or m[3] or m[4] or ""):
            if group := _GROUP_OF.get(word.lower()):
                out.append(FEATURE[f"name:{group}"])
    return tuple(out)


def _own(tag: str, attributes: str) -> tuple[int, ...]:
    return (_own_kept if len(attributes) <= KEPT else _own_kept.__wrapped__)(tag, attributes)


_ARTICLE = frozenset((FEATURE["tag:article"], FEATURE["tag:main"], FEATURE["name:content"]))
_WITHIN = {FEATURE[f"tag:{t}"]: FEATURE[f"{t} in article"] for t in _INSIDE} | {FEATURE[f"name:{g}"]: FEATURE[f"name:{g} in article"] for g in NAME_GROUPS}


@lru_cache(maxsize=50_000)
def _below_kept(above: frozenset[int], tag: str, attributes: str) -> frozenset[int]:
    own = _own(tag, attributes)
    inside = [_WITHIN[f] for f in own if f in _WITHIN] if above & _ARTICLE else []
    return above.union(own, inside)


def _below(above: frozenset[int], tag: str, attributes: str) -> frozenset[int]:
    return (_below_kept if len(attributes) <= KEPT else _below_kept.__wrapped__)(above, tag, attributes)


def tag_ends(page: str) -> tuple[list[int], list[int]]:
    """The places of quotes and >, and for each the place of the > that ends a tag which is open there outside quotes,
    -1 if none does. One pass from the end."""
    at = [m.start() for m in re.finditer("[\"'>]", page)]
    ends, later = [-1] * (len(at) + 1), {'"': -1, "'": -1}
    for k in range(len(at) - 1, -1, -1):
        c = page[at[k]]
        if c == ">":
            ends[k] = at[k]
        else:
            if later[c] >= 0:
                ends[k] = ends[later[c] + 1]
            later[c] = k
    return at, ends


class _Tags:
    """The tags of a page in order, in time linear in its length: a tag ends at the first > outside quotes, or, where
    none follows, at the first >."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.table: tuple[list[int], list[int]] | None = None

    def end_of(self, at: int) -> int:
        """The place of the > that ends a tag whose name ends at `at`."""
        if self.table is None:
            if m := _ATTRIBUTES.match(self.page, at):
                return m.end() - 1
            self.table = tag_ends(self.page)
        places, ends = self.table
        k = bisect_left(places, at)
        return ends[k] if ends[k] >= 0 else self.page.index(">", at)

    def __iter__(self) -> Iterator[tuple[int, int, str | None, bool, str]]:
        """(start, end, name or None, closing, attributes); send a place to go on from there."""
        page, at = self.page, 0
        while m := _OPENING.search(page, at, self.last):
            name = m[2]
            if name is not None:
                end = self.end_of(m.end())
                go_on = yield m.start(), end + 1, name.lower(), bool(m[1]), page[m.end() : end]
            else:
                comment = page[m.start() : m.start() + 4] == "<!--"
                end = page.find("-->", m.end()) + 3 if comment else page.index(">", m.end() - 1) + 1
                end = len(page) if comment and end == 2 else end
                go_on = yield m.start(), end, None, False, ""
            at = end if name is None else end + 1
            if go_on is not None:
                at = go_on
                yield 0, 0, None, False, ""


class _Open:
    """The stack of open elements (tag, features), and where each tag stands in it, so that no step walks the stack."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, frozenset[int]]] = [("", frozenset())]
        self.places: dict[str, list[int]] = {}

    def last(self, tags: Iterable[str]) -> int:
        """The highest place of any of the tags, 0 for none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def first_above(self, tags: Iterable[str], floor: int) -> int:
        """The lowest place above the floor of any of the tags, 0 for none."""
        found = [p[k] for t in tags if (p := self.places.get(t)) and (k := bisect_right(p, floor)) < len(p)]
        return min(found, default=0)

    def push(self, tag: str, attributes: str) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, _below(self.stack[-1][1], tag, attributes)))

    def cut(self, place: int) -> None:
        """Closes the element at a place and those in it; nothing for place 0."""
        while place and len(self.stack) > place:
            self.places[self.stack.pop()[0]].pop()


def _decoded(piece: str) -> str:
    if "&" not in piece:
        return piece
    return htmllib.unescape(_LONG_NUMBER.sub("\ufffd", piece) if "&#" in piece else piece)


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks in page order. Text of hidden elements and of the head is left out; unclosed and stray tags are
    treated as browsers do for the common cases. Linear in the page's length, whatever its tags, quotes and nesting."""
    if not page:
        return []
    out: list[Block] = []
    open_ = _Open()
    stack = open_.stack
    pieces: list[str] = []
    linked, link_at, at = 0, 0, 0  # link_at: depth of the stack where the open link began, 0 for none
    hidden_head = False

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text and not hidden_head:
                out.append(Block(text, linked, stack[-1][1], stack[-1][0]))
            pieces.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        piece = _decoded(piece)
        pieces.append(piece)
        if link_at:
            linked += len(piece.strip())

    tags = _Tags(page)
    found = iter(tags)
    for start, end, tag, closing, attributes in found:
        if start > at:
            add(page[at:start])
        at = end
        if tag is None:
            continue
        if tag == "br":
            pieces.append(" ")
        elif tag == "a":
            link_at = 0 if closing else len(stack)
        elif tag in HIDDEN_TAGS:
            if not closing and not attributes.endswith("/"):
                close = _HIDDEN_END[tag].search(page, at, tags.last + 1)
                at = close.end() if close else len(page)
                found.send(at)
        elif tag == "head":
            flush()
            hidden_head = not closing
        elif tag in BLOCK_TAGS:
            flush()
            if tag == "body":
                hidden_head = False
            if closing:
                open_.cut(open_.last((tag,)))
            else:
                if tag in CLOSES_P and (p := open_.last(("p",))) > open_.last(KEEP_P):
                    open_.cut(p)
                if tag in CLOSES:
                    open_.cut(open_.first_above(CLOSES[tag], open_.last(t for t in SCOPES if t not in CLOSES[tag])))
                if tag not in VOID_TAGS:
                    open_.push(tag, attributes)
            if link_at > len(stack):
                link_at = 0
    if at < len(page):  # no tag ends any more, but a comment may begin
        comment = page.find("<!--", at)
        add(page[at:] if comment < 0 else page[at:comment])
    flush()
    return out


def features(blocks: list[Block], start: int = 0, stop: int | None = None) -> list[list[int]]:
    """Active features of each block of a page, or of a stretch of them."""
    out, n = [], len(blocks)
    for i, b in enumerate(blocks[start:stop], start):
        text = b.text
        own = list(b.about)
        f = FEATURE
        if (p := f"parent:{b.parent}") in f:
            own.append(f[p])
        words = text.count(" ") + 1
        own.append(f[f"words:{min(6, words.bit_length() - 1)}"])
        share = b.linked / len(text)
        own.append(f[f"links:{0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}"])
        if text[-1] in ".!?…:;”\"»。":
            own.append(f["ends"])
        if text.count(",") >= 2:
            own.append(f["commas"])
        if "©" in text or "(c)" in text:
            own.append(f["(c)"])
        if "|" in text or "·" in text or "»" in text or "›" in text:
            own.append(f["separators"])
        if words <= 60 and _TYPICAL.search(text):
            own.append(f["typical"])
            if words <= 6:
                own.append(f["typical short"])
        if text[0].isdigit():
            own.append(f["digits"])
        if text[0].isupper():
            own.append(f["capitals"])
        if i == 0:
            own.append(f["first"])
        if i == n - 1:
            own.append(f["last"])
        if i * 10 < n:
            own.append(f["early"])
        if (n - 1 - i) * 10 < n:
            own.append(f["late"])
        own.append(f["always"])
        out.append(own)
    return out


@dataclass
class Chain:
    """Two-label CRF: state weights (features x 2), transition weights (2 x 2) and start weights."""

    state: np.ndarray = field(default_factory=lambda: np.zeros((len(FEATURE), 2)))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))


def _padded(pages: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(page, position, feature) of each active feature, and the pages' lengths."""
    lengths = np.array([len(p) for p in pages], np.int64)
    count = np.array([len(b) for p in pages for b in p], np.int64)
    page = np.repeat(np.arange(len(pages)), lengths)
    position = np.arange(len(page)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    feature = np.array([f for p in pages for b in p for f in b], np.int64)
    return np.repeat(page, count), np.repeat(position, count), feature, lengths


def _emissions(chain: Chain, page: np.ndarray, position: np.ndarray, feature: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    steps = int(lengths.max()) if len(lengths) else 0
    cell = page * steps + position
    return np.stack([np.bincount(cell, chain.state[feature, y], len(lengths) * steps) for y in (0, 1)], axis=-1).reshape(len(lengths), steps, 2)


def fit(pages: list[list[list[int]]], labels: list[list[int]], rounds: int = 250, rate: float = 0.15, decay: float = 0.02) -> Chain:
    """Maximises the L2-regularised log-likelihood by Adam over all pages at once."""
    pages, labels = zip(*[(p, y) for p, y in zip(pages, labels, strict=True) if p], strict=True)
    page, position, feature, lengths = _padded(list(pages))
    n, steps = len(lengths), int(lengths.max())
    inside = np.arange(steps)[None, :] < lengths[:, None]
    y = np.zeros((n, steps), np.int64)
    for i, own in enumerate(labels):
        y[i, : len(own)] = own
    truth = np.eye(2)[y] * inside[..., None]
    moves = np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:])
    chain, m, v = Chain(), None, None
    cell = page * steps + position
    for t in range(1, rounds + 1):
        e = _emissions(chain, page, position, feature, lengths)
        a = np.empty((n, steps, 2))
        b = np.zeros((n, steps, 2))
        a[:, 0] = e[:, 0] + chain.start
        for s in range(1, steps):
            x = a[:, s - 1, :, None] + chain.move
            a[:, s] = np.where(inside[:, s, None], np.logaddexp(x[:, 0], x[:, 1]) + e[:, s], a[:, s - 1])
        for s in range(steps - 2, -1, -1):
            x = chain.move + (e[:, s + 1] + b[:, s + 1])[:, None, :]
            b[:, s] = np.where(inside[:, s + 1, None], np.logaddexp(x[..., 0], x[..., 1]), 0.0)
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        p = np.exp(a + b - z[:, None, None]) * inside[..., None]
        pair = a[:, :-1, :, None] + chain.move + (e + b)[:, 1:, None, :] - z[:, None, None, None]
        expected = (np.exp(np.minimum(pair, 0.0)) * inside[:, 1:, None, None]).sum(axis=(0, 1))
        gap = (p - truth).reshape(-1, 2)
        total = inside.sum()
        grad_state = np.stack([np.bincount(feature, gap[cell, k], len(FEATURE)) for k in (0, 1)], axis=-1)
        grad = np.concatenate([grad_state.ravel(), (expected - moves).ravel(), (p[:, 0] - truth[:, 0]).sum(axis=0)]) / total
        w = np.concatenate([chain.state.ravel(), chain.move.ravel(), chain.start])
        grad += decay * w / total
        m = 0.9 * (0 if m is None else m) + 0.1 * grad
        v = 0.999 * (0 if v is None else v) + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        k = chain.state.size
        chain = Chain(w[:k].reshape(-1, 2), w[k : k + 4].reshape(2, 2), w[k + 4 :])
    return chain


def emissions(chain: Chain, blocks: list[Block], chunk: int = 4096) -> np.ndarray:
    """(blocks x 2): the weights of each block's features, summed for a bounded number of blocks at once."""
    parts = [_summed(chain, features(blocks, i, i + chunk)) for i in range(0, len(blocks), chunk)]
    return np.concatenate([*parts, np.zeros((0, 2))])


def _summed(chain: Chain, active: list[list[int]]) -> np.ndarray:
    owner = np.repeat(np.arange(len(active)), [len(f) for f in active])
    flat = np.array([f for own in active for f in own], np.int64)
    return np.stack([np.bincount(owner, chain.state[flat, y], len(active)) for y in (0, 1)], axis=-1)


def best_labels(chain: Chain, pages: list[np.ndarray], cells: int = 65_536) -> list[np.ndarray]:
    """The best labels of each page's blocks from their emissions. Pages of like length are decoded together, padded to
    at most `cells` blocks unless one page alone has more."""
    found = [np.zeros(0, np.int64)] * len(pages)
    order = sorted((i for i, e in enumerate(pages) if len(e)), key=lambda i: len(pages[i]))
    while order:
        take = 1
        while take < len(order) and (take + 1) * len(pages[order[-take - 1]]) <= cells and len(pages[order[-1]]) * (take + 1) <= cells:
            take += 1
        group, order = order[-take:], order[:-take]
        lengths = np.array([len(pages[i]) for i in group])
        e = np.zeros((take, int(lengths.max()), 2))
        for k, i in enumerate(group):
            e[k, : lengths[k]] = pages[i]
        for i, y in zip(group, _decode(chain, e, lengths), strict=True):
            found[i] = y
    return found


def _decode(chain: Chain, e: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    n, steps = e.shape[:2]
    back = np.zeros((n, steps, 2), np.int8)
    best = e[:, 0] + chain.start
    final = np.zeros((n, 2))
    final[lengths == 1] = best[lengths == 1]
    for s in range(1, steps):
        x = best[:, :, None] + chain.move
        back[:, s] = x.argmax(axis=1)
        best = x.max(axis=1) + e[:, s]
        final[lengths == s + 1] = best[lengths == s + 1]
    y = np.zeros((n, steps), np.int8)
    now = final.argmax(axis=1)
    for s in range(steps - 1, -1, -1):
        if s + 1 < steps:
            now = np.where(lengths > s + 1, back[np.arange(n), s + 1, now], now)
        now = np.where(lengths == s + 1, final.argmax(axis=1), now)
        y[:, s] = now
    return [y[k, : lengths[k]].astype(np.int64) for k in range(n)]


def viterbi(chain: Chain, pages: list[list[list[int]]]) -> list[np.ndarray]:
    """The best labels of each page's blocks, from their active features."""
    return best_labels(chain, [_summed(chain, p) if p else np.zeros((0, 2)) for p in pages])


def train(labelled: Iterable[tuple[str, set[str]]]) -> Chain:
    """Fits on (html, texts of the main blocks) of labelled pages, which must be bounded in number."""
    pages, labels = [], []
    for page, main in labelled:
        blocks = blocks_of(page)
        pages.append(features(blocks))
        labels.append([int(b.text in main) for b in blocks])
    return fit(pages, labels)


@lru_cache(maxsize=1)
def default_chain() -> Chain:
    """Trained on the labelled pages of html_training, once for each process."""
    from palimpsest.llm.html_training import labelled_pages

    return train(labelled_pages())


def extract(pages: DataFrame, chain: Chain | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text (blocks of the main text in page order, joined by line feeds; empty if there
    are none or html is null), n_chars, n_blocks. Repeated rows are extracted each; null ids and urls stay null; other
    columns are not read."""
    shared = pages.sparkSession.sparkContext.broadcast(chain or default_chain())
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for whole in batches:
            for batch in slices(whole, "html", rows=256):
                found = [blocks_of(x) for x in batch.column(2).to_pylist()]
                labels = best_labels(c, [emissions(c, b) for b in found])
                main = [[b.text for b, y in zip(bs, ys, strict=True) if y] for bs, ys in zip(found, labels, strict=True)]
                text = ["\n".join(m) for m in main]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array([len(m) for m in main], pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks"])

    columns = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return columns.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint, n_blocks bigint")
