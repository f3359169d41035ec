"""Word-piece lengths of texts by a linear longest-match automaton.

The vocabulary is a trie with two roots, one for pieces that start a word and one for pieces that go on. Every node
whose path cannot be extended has a failure link: what greedy longest match would emit there is popped, and the link
leads to the node for the rest. Only the number of popped pieces is stored with a link, so a word's length in pieces
comes out in time linear in its characters, and no piece is ever built (Song et al. 2021).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.common import slices

_PRETOKENS = re.compile(r"\w+|[^\w\s]")
START, GO_ON = 0, 1
_UNKNOWN = 1 << 40


class LongestMatch:
    """starting: pieces that start words; going_on: pieces within words. A word that greedy longest match cannot cover
    is one unknown token."""

    def __init__(self, starting: Iterable[str], going_on: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((START, starting), (GO_ON, going_on)):
            for piece in pieces:
                at = root
                for c in piece:
                    to = self.next[at].get(c)
                    if to is None:
                        to = self.next[at][c] = len(self.next)
                        self.next.append({})
                        final.append(False)
                    at = to
                final[at] = at > GO_ON
        self.link: list[int | None] = [None] * len(self.next)
        self.pops = [0] * len(self.next)
        level = [START, GO_ON]
        while level:
            below = []
            for u in level:
                for c, v in self.next[u].items():
                    below.append(v)
                    if final[v]:
                        self.link[v], self.pops[v] = GO_ON, 1
                        continue
                    z, popped = self.link[u], self.pops[u]
                    while z is not None and c not in self.next[z]:
                        popped += self.pops[z]
                        z = self.link[z]
                    if z is not None:
                        self.link[v], self.pops[v] = self.next[z][c], popped
            level = below

    def pieces(self, word: str) -> int | None:
        """How many pieces greedy longest match makes of the word; None if it gets stuck."""
        at, count = START, 0
        nexts, link, pops = self.next, self.link, self.pops
        for c in word:
            while (to := nexts[at].get(c)) is None:
                if (back := link[at]) is None:
                    return None
                count += pops[at]
                at = back
            at = to
        while at != GO_ON:
            if (back := link[at]) is None:
                return None
            count += pops[at]
            at = back
        return count


class WordLengths(dict):
    """word -> pieces, an unknown word as 1 + _UNKNOWN; forgets all once it holds `most` words."""

    def __init__(self, automaton: LongestMatch, most: int = 300_000):
        super().__init__()
        self.automaton, self.most = automaton, most

    def __missing__(self, word: str) -> int:
        n = self.automaton.pieces(word)
        n = 1 + _UNKNOWN if n is None else n
        if len(word) <= 100:
            if len(self) >= self.most:
                self.clear()
            self[word] = n
        return n


def piece_vocabulary(model_path: str) -> tuple[list[str], list[str]]:
    """Starting and continuing pieces of a SentencePiece vocabulary: with and without the space mark; no byte, control
    or unknown pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    return [p[1:] for p in pieces if p.startswith("▁") and len(p) > 1], [p for p in pieces if not p.startswith("▁")]


def count_tokens(docs: DataFrame, vocabulary: tuple[list[str], list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words (runs of word characters, and other visible characters one by one), n_tokens,
    n_unknown (words that are one unknown token). All are 0 for null and empty texts. Repeated rows are counted each, null
    ids stay null; other columns are not read. One pass, no shuffle; the vocabulary, of some ten thousand pieces, is sent to the workers."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = WordLengths(LongestMatch(*shared.value))
        get = lengths.__getitem__
        for whole in batches:
            for batch in slices(whole, text_col, rows=2000):
                words, tokens, unknown = [], [], []
                for text in batch.column(1).to_pylist():
                    found = _PRETOKENS.findall(text) if text else []
                    total = sum(map(get, found))
                    words.append(len(found))
                    tokens.append(total & (_UNKNOWN - 1))
                    unknown.append(total >> 40)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))], [id_col, "n_words", "n_tokens", "n_unknown"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_tokens bigint, n_unknown bigint")
