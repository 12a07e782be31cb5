"""Token counts by a linear longest-match automaton.

Greedy word pieces take the longest vocabulary entry at each place of a word;
pieces after the first come from the continuation vocabulary. The automaton is
a trie of both (continuations below a second root) with failure links: where no
longer match exists, the link leads to the node that stands for what is left
after whole pieces were taken off, and a count says how many those were. A word
is thus counted in one pass over its bytes, without making pieces.

Words are what stands between blanks; each is counted in its UTF-8 bytes, so a
vocabulary that has every byte covers every word. Counts of words are kept per
worker in a bounded memory. Defined results: a null or empty text has no words
and no tokens; a word that can't be matched counts as one unknown token; null
and repeated ids pass through; other columns are dropped.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.byte_bpe import read_ranks
from tessera.llm.common import BLANKS

REMEMBERED = 400_000


class Automaton:
    """``count(word)`` is the number of greedy pieces, or -1 if there is no way."""

    def __init__(self, initial: Iterable[bytes], continuation: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]
        piece = [False, False]
        for root, vocabulary in ((0, initial), (1, continuation)):
            for entry in vocabulary:
                node = root
                for byte in entry:
                    if byte not in self.next[node]:
                        self.next[node][byte] = len(self.next)
                        self.next.append({})
                        piece.append(False)
                    node = self.next[node][byte]
                piece[node] = piece[node] or node > 1
        # fail: where to go on when no child fits (-1: nowhere); popped: pieces taken off on the way.
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        waiting = deque((0, 1))
        while waiting:
            node = waiting.popleft()
            for byte, child in self.next[node].items():
                if piece[child]:
                    self.fail[child], self.popped[child] = 1, 1
                else:
                    at, taken = self.fail[node], self.popped[node]
                    while at >= 0 and byte not in self.next[at]:
                        taken += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[child], self.popped[child] = self.next[at][byte], taken
                waiting.append(child)

    def count(self, word: bytes) -> int:
        nxt, fail, popped, node, n = self.next, self.fail, self.popped, 0, 0
        for byte in word:
            while byte not in nxt[node]:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return -1
            node = nxt[node][byte]
        while node != 1:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return -1
        return n


def word_vocabulary(ranks: Iterable[bytes]) -> tuple[set[bytes], set[bytes]]:
    """Word-initial and continuation pieces of a byte-level vocabulary.

    Entries that begin with a blank start words; the others, and every single
    byte, go on with them. Single bytes may start words, too.
    """
    entries = list(ranks)
    single = {bytes([b]) for b in range(256)}
    return {e[1:] for e in entries if e[:1] == b" " and len(e) > 1} | single, {e for e in entries if not e.startswith(b" ")} | single


_made: dict[int, tuple[Automaton, dict[str, int]]] = {}


def _from_entries(entries: list[bytes]) -> tuple[Automaton, dict[str, int]]:
    """This worker's automaton and what it has counted, made once for each vocabulary."""
    key = hash(tuple(entries))
    if key not in _made:
        _made.clear()
        _made[key] = Automaton(*word_vocabulary(entries)), {}
    return _made[key]


SCHEMA = "doc_id long, n_words long, n_tokens long, n_unknown long, max_word_tokens long"


def count_tokens(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Words and greedy pieces of each whole text; the vocabulary file is read on the driver and shipped."""
    entries = docs.sparkSession.sparkContext.broadcast(list(read_ranks(ranks_path)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, known = _from_entries(entries.value)
        for rows in batches:
            out = []
            for text in rows["text"]:
                for blank in BLANKS:
                    text = text.replace(blank, " ")
                found = list(filter(None, text.split(" ")))
                for word in set(found).difference(known):
                    if len(known) >= REMEMBERED:
                        known.clear()
                        known.update((w, automaton.count(w.encode("utf-8", "surrogatepass"))) for w in set(found))
                        break
                    known[word] = automaton.count(word.encode("utf-8", "surrogatepass"))
                n = [known[w] for w in found]
                lost = n.count(-1)
                out.append((len(n), sum(n) + 2 * lost, lost, max(n, default=0)))
            frame = pd.DataFrame(out, columns=["n_words", "n_tokens", "n_unknown", "max_word_tokens"])
            frame.insert(0, "doc_id", rows["doc_id"].astype("Int64").to_numpy())
            yield frame

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInPandas(count, SCHEMA)
