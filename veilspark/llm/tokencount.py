"""Word-piece token counts in linear time, without building the pieces.

Greedy longest-match word pieces: a word is cut into the longest piece that
starts it, then the longest continuation piece, and so on; a word that cannot
be cut whole is one unknown token. A trie over initial and continuation pieces
gets, for every node, a failure link and the number of pieces that are popped
by following it, so each word is read once from left to right and only numbers
are added.

The vocabulary's word-start mark tells initial pieces from continuations.

Defined cases: words are what white space separates; null and empty texts have
no words; equal words have equal counts.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .base import slices, small_batches

#: Words whose counts a worker remembers before it starts afresh.
MEMORY = 500_000
MARK = "▁"


def pieces(path: str) -> tuple[list[str], list[str]]:
    """Initial and continuation pieces of a SentencePiece vocabulary; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    all_ = [model.id_to_piece(i) for i in ids]
    return [p[1:] for p in all_ if p.startswith(MARK) and len(p) > 1], [p for p in all_ if not p.startswith(MARK)]


class Automaton:
    """Nodes are numbers: 0 starts words, 1 continues them."""

    START, INNER = 0, 1

    def __init__(self, initial: list[str], inner: list[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for root, words in ((self.START, initial), (self.INNER, inner)):
            for word in words:
                node = root
                for c in word:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        final.append(False)
                    node = self.next[node][c]
                final[node] = True
        #: where to go on when no child fits (-1: nowhere), and how many pieces that pops
        self.fail = [-1] * len(self.next)
        self.pops = [0] * len(self.next)
        queue = deque([self.START, self.INNER])
        while queue:
            parent = queue.popleft()
            for c, node in self.next[parent].items():
                queue.append(node)
                if final[node]:
                    self.fail[node], self.pops[node] = self.INNER, 1
                    continue
                at, popped = self.fail[parent], self.pops[parent]
                while at >= 0 and c not in self.next[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.pops[node] = self.next[at][c], popped

    def count(self, word: str) -> int:
        """Number of pieces, or -1 where the word cannot be cut whole."""
        step, fail, pops = self.next, self.fail, self.pops
        node, n = self.START, 0
        for c in word:
            while c not in step[node]:
                if fail[node] < 0:
                    return -1
                n += pops[node]
                node = fail[node]
            node = step[node][c]
        while node != self.INNER:
            if fail[node] < 0:
                return -1
            n += pops[node]
            node = fail[node]
        return n


class _Counter(dict):
    """Remembered counts of words."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        n = self[word] = self.automaton.count(word)
        return n


@lru_cache(maxsize=2)
def _counter(path: str) -> _Counter:
    return _Counter(Automaton(*pieces(path)))


def counts(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds n_words, n_tokens (unknown words are one each) and n_unknown to the other columns."""
    names = ["n_words", "n_tokens", "n_unknown"]
    keep = [f for f in df.schema if f.name not in (text, *names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _counter(path)
        for batch in slices(batches, text):
            rows = []
            for t in batch.column(text).to_pylist():
                n = [known[w] for w in (t or "").split()]
                bad = n.count(-1)
                rows.append((len(n), sum(n) + 2 * bad, bad))
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in keep] + [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[f.name for f in keep] + names)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"{n} long" for n in names]))
