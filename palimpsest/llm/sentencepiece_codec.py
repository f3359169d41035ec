"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs whose concatenation is a piece, best score first and leftmost first
among equals; it merges the best pair, adds the pairs the merge creates and goes on until the agenda is empty. What
remains outside the vocabulary falls back to byte pieces.

No piece of such a vocabulary has a space mark behind another character (checked when a model is loaded), so no merge
crosses the start of a word, and a text's ids are those of its words end to end. Workers therefore run the agenda once
for each distinct word they meet, those of many words side by side, and keep as many words as a number of characters
allows. Each word that an Arrow batch adds is encoded and decoded by the sentencepiece library too, and a difference
raises an error. With check="texts" the library also encodes and decodes every whole text.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
_NONE = float("-inf")
#: Rank of a pair that is no piece, behind all others.
_NEVER = np.iinfo(np.int32).max
#: Words of up to so many characters have their agendas side by side, those up to each number at a time.
_WIDTHS = (8, 12, 16, 24, 48)
#: Characters of words that the library is given at a time.
_AT_ONCE = 5_000
_WORDS = re.compile(r" *[^ \n]+| +|\n")


class PieceCodec:
    """Encoder and decoder for one model; keeps the words met last, of up to 2 * `young` characters. Words of more than
    `longest` characters are kept for the texts at hand only."""

    def __init__(self, model: bytes, young: int = 1_600_000, longest: int = 100):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.unknown = sp.unk_id()
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        self.surface: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.surface.append(b"" if sp.is_control(i) else " ⁇ ".encode())
            else:
                self.ids[piece] = i
                self.score[piece] = sp.get_score(i)
                self.surface.append(piece.replace(MARK, " ").encode())
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        self.numbers = [str(i) for i in range(len(self.surface))]
        self.by_words = not any("\n" in p or MARK in p.lstrip(MARK) for p in self.ids)
        self._index_pairs()
        self.young, self.longest, self.size = young, longest, 0
        self.new: dict[str, tuple[str, bytes]] = {}
        self.old: dict[str, tuple[str, bytes]] = {}
        self.long: list[str] = []

    def _index_pairs(self) -> None:
        """Pieces of one character by code point (0 for none), and each pair of pieces that is a piece: its key, its piece
        and the rank of its score, behind them one that no pair has."""
        ids, score = self.ids, self.score
        self.point = np.zeros(0x110000, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.point[ord(p)] = i
        rank = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = sorted((ids[p[:k]] * len(self.surface) + ids[p[k:]], i, rank[score[p]]) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
        key, piece, ranks = zip(*pairs, (len(self.surface) ** 2, 0, _NEVER), strict=True)
        self.pairs = np.array(key, np.int64), np.array(piece, np.int32), np.array(ranks, np.int32)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and pieces of pairs, 0 being no piece."""
        key, piece, rank = self.pairs
        own = left.astype(np.int64) * len(self.surface) + right
        at = np.searchsorted(key, own)
        none = key[at] != own
        return np.where(none, _NEVER, rank[at]), piece[at]

    def _together(self, words: list[str]) -> list[list[int]]:
        """Ids of words whose spaces are marks already."""
        out: list[list[int] | None] = [None] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        least = 0
        for most in _WIDTHS:
            own = np.flatnonzero((size > least) & (size <= most)).tolist()
            least = most
            if own:
                for k, ids in zip(own, self._side_by_side([words[k] for k in own], size[own]), strict=True):
                    out[k] = ids
        return [self.agenda(w) if ids is None else ids for w, ids in zip(words, out, strict=True)]

    def _side_by_side(self, words: list[str], size: np.ndarray) -> list[list[int] | None]:
        """The agendas as rows of ranks, whose minima are merged at once; None for words with a character that is no piece."""
        n, width = len(words), int(size.max()) + 1
        symbol = np.zeros((n, width), np.int32)  # 0: no symbol, such as behind the word's end and, merged, in the place of the right one
        inside = np.arange(width) < size[:, None]
        symbol[inside] = self.point[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        whole = ((symbol > 0) == inside).all(1)
        rank, piece = np.full((n, width), _NEVER, np.int32), np.zeros((n, width), np.int32)
        rank[:, :-1], piece[:, :-1] = self._ranks(symbol[:, :-1], symbol[:, 1:])
        rank[~whole] = _NEVER
        start = np.arange(n) * width
        after = (start[:, None] + np.minimum(np.arange(1, width + 1), width - 1)).ravel()
        before = (start[:, None] + np.r_[width - 1, np.arange(width - 1)]).ravel()
        symbol, ranks, piece = symbol.ravel(), rank.ravel(), piece.ravel()
        while True:
            i = start + rank.argmin(1)
            i = i[ranks[i] < _NEVER]
            if not len(i):
                break
            j, new = after[i], piece[i]
            symbol[i], symbol[j], ranks[j] = new, 0, _NEVER
            k, h = after[j], before[i]
            after[i], before[k] = k, i
            ranks[i], piece[i] = self._ranks(new, symbol[k])
            ranks[h], piece[h] = self._ranks(symbol[h], new)
        left = symbol.reshape(n, width) > 0
        ends = np.cumsum(left.sum(1)).tolist()
        ids = symbol[left.ravel()].tolist()
        return [ids[a:b] if good else None for a, b, good in zip([0, *ends[:-1]], ends, whole.tolist(), strict=True)]

    def agenda(self, text: str) -> list[int]:
        """Ids of a text whose spaces are marks already, without begin mark."""
        return self._to_ids(self._short(text) if len(text) <= 48 else self._long(text))

    def _short(self, text: str) -> list[str]:
        """The agenda as a list in text order, whose maximum is sought anew each time: fastest for words."""
        symbol, get = list(text), self.score.get
        agenda = [get(a + b, _NONE) for a, b in zip(symbol, symbol[1:], strict=False)]
        while agenda:
            best = max(agenda)
            if best == _NONE:
                break
            i = agenda.index(best)
            symbol[i : i + 2] = [symbol[i] + symbol[i + 1]]
            del agenda[i]
            if i < len(agenda):
                agenda[i] = get(symbol[i] + symbol[i + 1], _NONE)
            if i:
                agenda[i - 1] = get(symbol[i - 1] + symbol[i], _NONE)
        return symbol

    def _long(self, text: str) -> list[str]:
        """The agenda as a heap, for texts of any length."""
        symbol: list[str | None] = list(text)
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        score, todo = self.score, []
        for i in range(n - 1):
            pair = symbol[i] + symbol[i + 1]
            s = score.get(pair)
            if s is not None:
                todo.append((-s, i, i + 1, pair))
        heapq.heapify(todo)
        while todo:
            _, i, j, pair = heapq.heappop(todo)
            if symbol[i] is None or symbol[j] is None or after[i] != j or len(symbol[i]) + len(symbol[j]) != len(pair):
                continue
            symbol[i], symbol[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                s = score.get(longer := pair + symbol[k])
                if s is not None:
                    heapq.heappush(todo, (-s, i, k, longer))
            h = before[i]
            if h >= 0:
                s = score.get(longer := symbol[h] + pair)
                if s is not None:
                    heapq.heappush(todo, (-s, h, i, longer))
        return [s for s in symbol if s is not None]

    def _to_ids(self, symbols: list[str]) -> list[int]:
        out, ids = [], self.ids
        for s in symbols:
            i = ids.get(s)
            if i is None:
                out += [self.bytes[b] for b in s.encode()]
            else:
                out.append(i)
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.surface[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids): the begin mark goes, broken byte runs become replacement characters."""
        out = self.decode_bytes(ids).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out

    def split(self, text: str | None) -> list[str]:
        """The words, each with the spaces before it, behind the begin mark; [] for null and empty texts."""
        if not text:
            return []
        text = " " + text.replace(MARK, " ")
        return _WORDS.findall(text) if self.by_words else [text]

    def encode(self, text: str | None) -> list[int]:
        return [i for word in self.split(text) for i in self.agenda(word.replace(" ", MARK))]

    def learn(self, words: set[str], check: bool) -> dict[str, tuple[str, bytes]]:
        """(ids as text, decoded bytes) of the words, among others."""
        for w in self.long:
            del self.new[w]
        if self.size >= self.young:
            self.new, self.old, self.size = {}, self.new, 0
        new, old, longest = self.new, self.old, self.longest
        fresh, size = [], 0
        for w in words:
            if w not in new:
                if w in old:
                    new[w] = old[w]
                    size += len(w)
                else:
                    fresh.append(w)
        encoded = self._together([w.replace(" ", MARK) for w in fresh])
        surface, number = self.surface, self.numbers
        surfaces = [b"".join([surface[i] for i in ids]) for ids in encoded]
        if check and fresh and not (self.by_words and self._same(fresh, encoded, surfaces)):
            self._compare(fresh, encoded, surfaces)
        for w, ids, back in zip(fresh, encoded, surfaces, strict=True):
            new[w] = (",".join([number[i] for i in ids]), back)
            size += len(w) if len(w) <= longest else 0
        self.long = [w for w in fresh if len(w) > longest]
        self.size += size
        return new

    def _same(self, words: list[str], encoded: list[list[int]], surfaces: list[bytes]) -> bool:
        """Whether the library encodes the words to these ids and decodes the ids to these bytes, many words to a text: each
        stands behind a line feed, which no merge crosses."""
        feed, mark = self.agenda("\n"), self.library.encode("\n")
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        cuts = np.unique(np.searchsorted(ends, np.arange(_AT_ONCE, ends[-1] + _AT_ONCE, _AT_ONCE), "right")).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(words)], strict=True):
            if a < b:
                ours = mark + encoded[a]
                for ids in encoded[a + 1 : b]:
                    ours += feed
                    ours += ids
                theirs = self.library.encode("\n" + "\n".join(words[a:b]), num_threads=1)
                if ours != theirs or self.library.decode(theirs, num_threads=1) != "\n" + b"\n".join(surfaces[a:b]).decode("utf-8", "replace"):
                    return False
        return True

    def _compare(self, words: list[str], encoded: list[list[int]], surfaces: list[bytes]) -> None:
        """An error unless the library encodes the words to these ids and decodes the ids to these bytes."""
        before = "\n" if self.by_words else ""  # no merge crosses a line feed; the begin mark stands before it
        theirs = self.library.encode([before + w if before else w[1:] for w in words], num_threads=1)
        back = self.library.decode(theirs, num_threads=1)
        mark = self.library.encode(before)
        ours = [mark + ids for ids in encoded]
        texts = [before + x.decode("utf-8", "replace") for x in surfaces] if before else [self.decode(ids) for ids in encoded]
        if ours != theirs or texts != back:
            w, a, b, x, y = next(d for d in zip(words, ours, theirs, texts, back, strict=True) if d[1] != d[2] or d[3] != d[4])
            raise AssertionError(f"the codec and the library differ on {w[:80]!r}: {a[:20]} and {b[:20]}, {x[:80]!r} and {y[:80]!r}")


_CODECS: dict[bytes, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """One codec for each model and process."""
    key = hashlib.sha256(model).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = PieceCodec(model)
    return _CODECS[key]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", check: str | None = "words", with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256, and on demand the ids and the decoded text.

    Null and empty texts have no ids and decode to the empty text; null ids stay null, repeated rows are encoded each.
    check: "words" holds ids and decoded text of each new word of a batch against the library, "texts" those of every
    whole text as well, None nothing. Other columns are not read. The model (about half a megabyte) is read on the driver
    and sent to the workers.
    """
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from palimpsest.llm.common import slices

        c = codec(model.value)
        for whole in batches:
            for batch in slices(whole, text_col, rows=1000, chars=1_000_000):
                texts = batch.column(1).to_pylist()
                split = [c.split(t) for t in texts]
                known = c.learn(set().union(*split), check is not None).__getitem__
                n, ids, decoded, id_lists, raw = [], [], [], [], []
                for words in split:
                    id_texts, surfaces = zip(*map(known, words), strict=True) if words else ((), ())
                    joined = ",".join(id_texts)
                    back = b"".join(surfaces)[1:]
                    n.append(joined.count(",") + 1 if joined else 0)
                    ids.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded.append(hashlib.sha256(back).hexdigest())
                    if with_ids or check == "texts":
                        id_lists.append([int(x) for x in joined.split(",")] if joined else [])
                    if with_text or check == "texts":
                        raw.append(back.decode())
                if check == "texts":
                    theirs = c.library.encode([t or "" for t in texts], num_threads=1)
                    if theirs != id_lists or c.library.decode(theirs, num_threads=1) != raw:
                        raise AssertionError("the codec and the library differ on a whole text")
                columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                if with_ids:
                    columns.append(pa.array(id_lists, pa.list_(pa.int32())))
                if with_text:
                    columns.append(pa.array(raw, pa.string()))
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids, *["decoded"] * with_text]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
