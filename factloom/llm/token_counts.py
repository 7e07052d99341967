"""Token counts: the best unigram segmentation of every pre-token, over a trie that shares prefixes.

Distinct pre-tokens go into a trie of bytes. A node holds the forward score of its prefix, which
is the least cost of cutting it into pieces of the vocabulary, and the number of pieces; both
depend on the prefix alone, so they are computed once however many pre-tokens share it. A
pre-token's count is stored with it when its last node is reached.

The vocabulary is a public one of byte pieces in order of rank; every single byte is a piece, so
every text can be cut. A piece's cost is -ln of its chance by Zipf's law, ln((rank + 1) * H), in
whole millionths of a nat; ties are for fewer pieces. Nothing is trained.

Each Python worker keeps a trie of its own, and starts a new one when it is full. A pre-token of more than LONG bytes shares its
prefix with nothing: it is not put into the trie, but cut with the scores of its last bytes alone, as many as the longest
piece has, so its memory is that of its text. No rows are shuffled.

Defined results: a null or empty text has no tokens; repeated rows are counted each; a very long
pre-token is cut like any other; other columns are left out.
"""

import base64
import functools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.pretokens import pretokens


#: Bytes of a pre-token from which on it stays out of the trie.
LONG = 1_000


def costs(path: str) -> dict[bytes, int]:
    """Cost of each piece of a file of base64 pieces and ranks."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    h = sum(1 / (r + 1) for r in ranks.values())
    return {p: round(1e6 * math.log((r + 1) * h)) for p, r in ranks.items()}


class Trie:
    """Forward scores of prefixes; a node is (children, cost, pieces)."""

    def __init__(self, cost: dict[bytes, int], most: int = 1_000_000):
        self.cost, self.most = cost, most
        self.longest = max(map(len, cost))
        self.prefixes = {p[:n] for p in cost for n in range(1, len(p))}
        self.clear()

    def clear(self) -> None:
        self.root, self.nodes, self.terminal = ({}, 0, 0), 0, {}

    def count(self, token: str) -> tuple[int, int]:
        """(pieces, cost) of the best segmentation."""
        if (known := self.terminal.get(token)) is not None:
            return known
        if self.nodes > self.most:
            self.clear()
        raw = token.encode("utf-8", "surrogatepass")
        if len(raw) > LONG:
            return self.rolled(raw)
        path, node = [self.root], self.root
        for d, b in enumerate(raw, 1):
            child = node[0].get(b)
            if child is None:
                best, pieces = None, 0
                for at in range(max(0, d - self.longest), d):
                    own = self.cost.get(raw[at:d])
                    if own is not None:
                        _, cost, n = path[at]
                        if best is None or (cost + own, n + 1) < (best, pieces):
                            best, pieces = cost + own, n + 1
                child = node[0][b] = ({}, best, pieces)
                self.nodes += 1
            path.append(child)
            node = child
        known = self.terminal[token] = (node[2], node[1])
        return known

    def rolled(self, raw: bytes) -> tuple[int, int]:
        """The same for one long token: a ring of the scores of the places that pieces can still reach."""
        cost, prefixes, size = self.cost, self.prefixes, self.longest + 1
        ring: list = [None] * size  # (cost, pieces) of the best cut up to each place
        ring[0] = (0, 0)
        for at in range(len(raw)):
            (done, n), ring[at % size] = ring[at % size], None
            for end in range(at + 1, min(at + self.longest, len(raw)) + 1):
                piece = raw[at:end]
                own = cost.get(piece)
                if own is not None:
                    to, found = end % size, (done + own, n + 1)
                    if ring[to] is None or found < ring[to]:
                        ring[to] = found
                if piece not in prefixes:
                    break
        best = ring[len(raw) % size]
        return best[1], best[0]


@functools.cache
def trie(path: str) -> Trie:
    """One for all tasks that a Python worker runs."""
    return Trie(costs(path))


def token_counts(docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens and score (the log chance of the best segmentation, in nats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = trie(vocabulary).count
        for batch in batches:
            out: list[list] = [[], [], []]
            for value in batch.column("text"):
                found = list(map(count, pretokens(value.as_py() or "")))
                out[0].append(len(found))
                out[1].append(sum(n for n, _ in found))
                out[2].append(-sum(c for _, c in found) / 1e6)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())],
                names=[key, "n_pretokens", "n_tokens", "score"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, n_pretokens long, n_tokens long, score double")
