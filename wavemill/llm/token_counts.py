"""Token counts under a unigram vocabulary, without making tokens.

Distinct parts of texts (see ``pieces``) go into a trie. Every node holds the best score of the
characters on its path and how many tokens that takes; both follow from the nodes above it, so a
shared beginning is scored once. The count at a part's last node is all that is stored of it, and
a document's count is the sum over its parts.
"""

from __future__ import annotations

from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from . import pieces as P
from .common import Memo, documents, tidy

#: Nodes after which a task starts a new trie.
NODES = 400_000


class CountTrie:
    def __init__(self, pieces: P.Pieces):
        self.pieces = pieces
        # Every ending of a piece, with the score of those that are pieces themselves: looking back
        # from a character ends where no piece can end there.
        self.endings: dict[str, float | None] = {}
        for piece in pieces.scores:
            for at in range(len(piece)):
                self.endings[piece[at:]] = pieces.scores.get(piece[at:])
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.best, self.count = [0.0], [0]

    def add(self, part: str) -> int:
        """Insert a part and return its token count; of equally good ways, the longest last piece."""
        if len(self.best) > NODES:
            self.clear()
        text = part.replace(P.SIGN, "\0").replace(" ", P.SIGN)
        endings, longest, unknown, lost = self.endings, self.pieces.longest, self.pieces.unknown, -float("inf")
        children, best, count, path = self.children, self.best, self.count, [0]
        at = 0
        for end, c in enumerate(text, 1):
            key = at << 21 | ord(c)
            node = children.get(key)
            if node is None:
                node = children[key] = len(best)
                top, tokens = best[at] + unknown, 0
                for start in range(end - 1, max(-1, end - 1 - longest), -1):
                    score = endings.get(text[start:end], lost)
                    if score is None:
                        continue
                    if score == lost:
                        break
                    before = path[start]
                    if best[before] + score >= top:
                        top, tokens = best[before] + score, count[before] + 1
                best.append(top)
                count.append(tokens or count[at] + len(part[end - 1].encode()))
            path.append(node)
            at = node
        return count[at]


def token_counts(docs: DataFrame, model: str, chunk: int = 256) -> DataFrame:
    """doc_id, n_tokens: a row for each input row, in one pass and without a shuffle.

    Null and empty texts have none. Other columns than doc_id and text are not read.
    """

    def run(batches):
        pieces = P.load(model)
        trie = CountTrie(pieces)
        memo = Memo(trie.add)
        for t in batches:
            for at in range(0, t.num_rows, chunk):
                parts = [P.split(x.as_py(), pieces) for x in t["text"][at : at + chunk]]
                for part in sorted(memo.lacks(set(chain.from_iterable(parts)))):  # neighbours share most
                    memo.put(part, trie.add(part))
                counts = [sum(map(memo.__getitem__, p)) for p in parts]
                yield pa.RecordBatch.from_arrays([t["doc_id"][at : at + chunk], pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return documents(docs).mapInArrow(tidy(run), "doc_id long, n_tokens long")
