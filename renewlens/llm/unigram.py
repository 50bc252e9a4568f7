"""Token counts of a unigram tokenizer, with forward scores shared along a trie of pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from renewlens.llm.text import per_text, slices, words

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Stands before every pre-token, as in the vocabulary file (fixed value).
SPACE = "▁"
#: A character outside the vocabulary is one token per byte, each this much below the worst piece.
UNKNOWN_PENALTY = 10.0
#: Nodes of a task's trie; beyond them it starts anew, which changes no count.
MAX_NODES = 2_000_000


def vocabulary(path: str = MODEL) -> dict[str, float]:
    """Log-scores of the pieces of a vocabulary file.

    The file ranks its pieces, so a piece of rank r gets the score of Zipf's law, -log(r + 1).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [
        i for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    plain.sort(key=lambda i: (-model.get_score(i), i))
    return {model.id_to_piece(i): -math.log(rank + 1) for rank, i in enumerate(plain)}


class ScoreTrie:
    """Trie of pre-tokens. Each node keeps the best score of its prefix and the tokens on that path.

    A prefix's score needs the nodes above it only, so it is computed once however many pre-tokens
    share it. Of equal scores the path with the longer last piece wins.
    """

    def __init__(self, scores: dict[str, float], max_nodes: int = MAX_NODES):
        self.scores, self.max_nodes = scores, max_nodes
        self.longest = max(map(len, scores), default=1)
        self.floor = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.tokens = [0.0], [0]

    def count(self, token: str) -> int:
        """Insert a pre-token and return the count stored at its end."""
        if len(self.best) > self.max_nodes:
            self.clear()
        child, best, tokens, scores = self.child, self.best, self.tokens, self.scores
        path, node = [0], 0
        for i, c in enumerate(token, 1):
            found = child.get((node, c))
            if found is None:
                high, many = -math.inf, 0
                for j in range(max(0, i - self.longest), i):
                    score = scores.get(token[j:i])
                    if score is not None and best[path[j]] + score > high:
                        high, many = best[path[j]] + score, tokens[path[j]] + 1
                if c not in scores:
                    size = len(c.encode())
                    if best[node] + size * self.floor > high:
                        high, many = best[node] + size * self.floor, tokens[node] + size
                found = child[(node, c)] = len(best)
                best.append(high)
                tokens.append(many)
            node = found
            path.append(node)
        return tokens[node]


def token_counts(docs: DataFrame, path: str = MODEL, max_nodes: int = MAX_NODES) -> DataFrame:
    """All columns of ``docs`` with n_pretokens and n_tokens.

    A pre-token is a word with the space sign before it. Each batch is reduced to its distinct words,
    which go through the task's trie once; a document adds up the counts of its words. A null text has
    none. Columns under the two names have to be shielded by the caller. The vocabulary is read by the driver and sent to the tasks; its
    size is that of the file.
    """
    scores = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in ("n_pretokens", "n_tokens"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ScoreTrie(scores.value, max_nodes)
        for batch in slices(batches, "text", 8 << 20):
            found = words(batch.column("text"))
            distinct = found.arrow().dictionary_encode()
            counts = np.fromiter(
                (trie.count(SPACE + x.decode()) for x in distinct.dictionary.to_pylist()), np.int64, len(distinct.dictionary)
            )
            ids = distinct.indices.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found.count, pa.int64()), pa.array(per_text(found, counts[ids]), pa.int64())],
                names=[*names, "n_pretokens", "n_tokens"],
            )

    return docs.mapInArrow(run, schema)
