"""Token counts under a unigram model, shared over a trie of pre-tokens.

Method: texts are cut into pre-tokens; distinct ones go into a trie over their
bytes, and the forward score of a node (the cheapest way to cut the path to it
into vocabulary pieces) is computed once for all pre-tokens that share it.
The count at a pre-token's last node is stored, so a repeated pre-token costs
one lookup.

The vocabulary is a public rank file and is not trained here.  A piece of rank
r costs ln(r + 2), as if frequencies followed Zipf's law; costs are whole
millionths, and among equally cheap cuts the one with fewer pieces counts.
"""

from __future__ import annotations

import base64
import math

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import ready

#: Where the rank file is by default; a parameter of the operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens: contractions, words and numbers with one space before, runs of signs, white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Trie nodes that a task keeps; beyond them it starts afresh (counts stay the same).
NODES = 1_500_000
#: Bytes from which a pre-token is scored by itself: it shares no prefix worth keeping, and its nodes would know no bound.
LONGEST = 4096

_COUNT = (1 << 24) - 1


def load(path: str = VOCABULARY) -> dict[bytes, int]:
    """Piece -> (cost << 24) + 1 from a file of base64 pieces and ranks."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return {base64.b64decode(a): (round(1e6 * math.log(int(b) + 2)) << 24) + 1 for a, b in pairs}


class Trie(dict):
    """Pre-token -> token count; missing ones are inserted and scored."""

    def __init__(self, vocabulary: dict[bytes, int]):
        super().__init__()
        self.vocabulary, self.longest = vocabulary, max(map(len, vocabulary), default=1)
        # Bytes that no piece has alone cost more than any cut made of pieces.
        self.unknown = ((max(vocabulary.values(), default=0) >> 24) * 4 << 24) + 1
        self.child: dict[tuple[int, int], int] = {}
        self.score = [0]

    def _alone(self, raw: bytes) -> int:
        """Count of a token too long to be shared: the same forward scores, of which only those in reach are kept."""
        get, reach = self.vocabulary.get, [0]  # scores before each of the last bytes
        for i in range(1, len(raw) + 1):
            best = reach[-1] + self.unknown
            for back in range(1, len(reach) + 1):
                cost = get(raw[i - back : i])
                if cost is not None and reach[-back] + cost < best:
                    best = reach[-back] + cost
            reach.append(best)
            if len(reach) > self.longest:
                del reach[0]
        return reach[-1] & _COUNT

    def __missing__(self, token: str) -> int:
        if len(self.score) > NODES:
            self.clear()
            self.child, self.score = {}, [0]
        raw, node, path = token.encode("utf-8", "surrogatepass"), 0, [0]
        if len(raw) > LONGEST:
            return self._alone(raw)
        child, score, get = self.child, self.score, self.vocabulary.get
        for i, byte in enumerate(raw, 1):
            after = child.get((node, byte))
            if after is None:
                best = path[i - 1] + self.unknown
                for start in range(max(0, i - self.longest), i):
                    cost = get(raw[start:i])
                    if cost is not None and path[start] + cost < best:
                        best = path[start] + cost
                after = child[(node, byte)] = len(score)
                score.append(best)
            node = after
            path.append(score[node])
        self[token] = count = path[-1] & _COUNT
        return count


def brute_count(token: str, vocabulary: dict[bytes, int]) -> int:
    """The same count for one pre-token, on its own."""
    raw, unknown = token.encode("utf-8", "surrogatepass"), ((max(vocabulary.values()) >> 24) * 4 << 24) + 1
    best = [0]
    for i in range(1, len(raw) + 1):
        best.append(min([best[i - 1] + unknown, *(best[s] + vocabulary[raw[s:i]] for s in range(i) if raw[s:i] in vocabulary)]))
    return best[-1] & _COUNT


def _run(vocabulary: dict[bytes, int], pattern: str):
    def run(batches):
        split, trie = regex.compile(pattern), Trie(vocabulary)
        for batch in batches:
            chars, pre, tokens = [], [], []
            for text in batch.column(1).to_pylist():
                parts = split.findall(text) if text else []
                chars.append(len(text or ""))
                pre.append(len(parts))
                tokens.append(sum(map(trie.__getitem__, parts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (chars, pre, tokens))], ["doc_id", "n_chars", "n_pretokens", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_chars, n_pretokens, n_tokens) for every row of ``docs``.

    One pass without a shuffle.  Null and empty texts count 0.  A byte that the
    vocabulary lacks counts as one token.  Repeated rows count alike; other
    columns are ignored.  The vocabulary is read on the driver and sent to the
    tasks; a rank file has a fixed size.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_run(load(path), pattern), "doc_id long, n_chars long, n_pretokens long, n_tokens long")
