"""Token counts by a linear longest-match automaton.

Greedy word pieces: at each place of a word the longest vocabulary string that fits is taken. The vocabulary is a
trie; a node that cannot go on has a failure link to where matching resumes and the number of pieces that are settled
on the way, so a word's count takes time linear in its length and no piece is ever built.

Words are the runs between ASCII blanks, as UTF-8 bytes, A-Z lowered. A word that cannot be cut counts as one token.
Defined cases: null, empty and blank texts have no words and no tokens; repeated rows are counted each; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from timegrid.llm.common import slices, words_of

KNOWN_WORDS = 500_000


class Automaton:
    """Counts greedy pieces of byte strings. follow: vocabulary of what may stand after a word's first piece, if another."""

    def __init__(self, vocabulary: Iterable[bytes], follow: Iterable[bytes] | None = None):
        self.next: list[dict[int, int]] = [{}]
        ends: set[int] = set()
        self._add(0, vocabulary, ends)
        self.rest = 0
        if follow is not None:
            self.next.append({})
            self.rest = len(self.next) - 1
            self._add(self.rest, follow, ends)
        size = len(self.next)
        self.fail, self.popped = [-1] * size, [0] * size
        roots = list(dict.fromkeys((0, self.rest)))
        queue = [(v, root, c) for root in roots for c, v in self.next[root].items()]
        for v, parent, c in queue:  # breadth first: links of shorter strings are ready
            queue += [(w, v, d) for d, w in self.next[v].items()]
            if v in ends:
                self.fail[v], self.popped[v] = self.rest, 1
                continue
            z, n = self.fail[parent], self.popped[parent]
            while z >= 0 and c not in self.next[z]:
                n += self.popped[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.popped[v] = self.next[z][c], n

    def _add(self, root: int, strings: Iterable[bytes], ends: set[int]) -> None:
        for s in strings:
            at = root
            for c in s:
                to = self.next[at].get(c)
                if to is None:
                    self.next.append({})
                    to = self.next[at][c] = len(self.next) - 1
                at = to
            if s:
                ends.add(at)

    def count(self, word: bytes) -> int:
        nxt, fail, popped = self.next, self.fail, self.popped
        at = n = 0
        for c in word:
            to = nxt[at].get(c)
            while to is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return 1
                to = nxt[at].get(c)
            at = to
        while at not in (0, self.rest):
            n += popped[at]
            at = fail[at]
            if at < 0:
                return 1
        return n


def byte_strings(path: str, word_end: str = "</w>") -> list[bytes]:
    """The strings of a byte-level vocabulary file (a tokenizers JSON), without marks of word ends and special tokens.

    Such files write byte b as chr(b) where that is printable, and the others in order from chr(256).
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    special = {t["content"] for t in data.get("added_tokens", ())}
    names = {k.removesuffix(word_end) for k in data["model"]["vocab"] if k not in special}
    return [bytes(map(back.__getitem__, k)) for k in sorted(names) if k]


@lru_cache(maxsize=2)
def _automaton(path: str) -> tuple[Automaton, dict[bytes, int]]:
    return Automaton(byte_strings(path)), {}


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every text, by the vocabulary file at path (a place that all executors have)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = _automaton(path)
        for batch in batches:
            for part in slices(batch):
                flat, n_words = words_of(part.column("text"))
                coded = pa.array(flat, pa.binary()).dictionary_encode()
                if len(known) > KNOWN_WORDS:
                    known.clear()
                names = coded.dictionary.to_pylist()
                for w in names:
                    if w not in known:
                        known[w] = automaton.count(w)
                table = np.fromiter((known[w] for w in names), np.int64, len(names))
                each = table[coded.indices.to_numpy(zero_copy_only=False)] if flat else np.empty(0, np.int64)
                sums = np.concatenate([[0], np.cumsum(each)])
                ends = np.cumsum(n_words)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n_words), pa.array(sums[ends] - sums[ends - n_words])], ["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
