"""Token counts of a unigram vocabulary by a shared trie.

Texts are cut at white space into pre-tokens, each marked at its front.  A task
puts its distinct new pre-tokens into a trie by sorting them: neighbours share
their longest common prefix.  The forward scores of the unigram model (for each
prefix, the best sum of piece scores that spells it, and the pieces used) are
computed once for each node of that trie; a pre-token's count is read at its
terminal node and remembered.  A text's count is the sum over its pre-tokens.

The model: the pieces of a public vocabulary with scores by Zipf's law over
their order (log of 1 / (rank + 2.7)); a character outside the vocabulary costs
``UNKNOWN`` and is as many tokens as it has bytes (byte fallback).  Ties go to
the longest last piece.

Edge cases: null and empty texts have 0 tokens; repeated rows are counted one by
one; extra columns are ignored. Memory is bounded by ``CACHE_BYTES`` of remembered
pre-tokens and by the longest pre-token.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_BYTES, ENTRY_BYTES = 1 << 26, 128
UNKNOWN = -25.0
MARK = "▁"


def vocabulary(path: str) -> dict[str, float]:
    """piece -> score from a SentencePiece model file; control, unknown and byte pieces left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    usable = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {sp.id_to_piece(i): -math.log(rank + 2.7) for rank, i in enumerate(usable)}


class PrefixCounter:
    """Counts of pre-tokens, computed along a trie of them."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        # which lengths pieces ending in a character have: few substrings need looking up
        by_last: dict[str, set[int]] = {}
        for p in scores:
            by_last.setdefault(p[-1], set()).add(len(p))
        self.lengths = {c: sorted(n, reverse=True) for c, n in by_last.items()}

    def counts(self, tokens: list[str]) -> dict[str, int]:
        """Distinct pre-tokens -> number of pieces of their best segmentation.

        ``best[i]`` and ``used[i]`` belong to the trie node at depth i of the path in
        hand; moving to the next token in sorted order cuts back to the shared prefix.
        """
        out: dict[str, int] = {}
        score, none = self.scores.get, ()
        best, used, before = [0.0], [0], ""
        for w in sorted(set(tokens)):
            shared = 0
            for a, b in zip(before, w):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], used[shared + 1 :]
            for end in range(shared + 1, len(w) + 1):
                c = w[end - 1]
                top, n = -math.inf, 0
                for k in self.lengths.get(c, none):
                    if k <= end and (s := score(w[end - k : end])) is not None:
                        s += best[end - k]
                        if s > top:
                            top, n = s, used[end - k] + 1
                if top == -math.inf:  # no piece ends here: the character by its bytes
                    top, n = best[end - 1] + UNKNOWN, used[end - 1] + len(c.encode("utf-8", "surrogatepass"))
                best.append(top)
                used.append(n)
            out[w] = used[-1]
            before = w
        return out


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """``docs``: doc_id, text -> doc_id, n_pretokens, n_tokens."""

    def run(batches):
        counter = PrefixCounter(vocabulary(vocabulary_path))
        known: dict[bytes, int] = {}
        held = 0
        for b in batches:
            texts = [(t.encode("utf-8", "surrogatepass").split() if t else []) for t in b.column("text").to_pylist()]
            new = {w for ws in texts for w in ws if w not in known}
            size = sum(map(len, new)) + ENTRY_BYTES * len(new)
            if held + size > CACHE_BYTES:
                known.clear()
                new = {w for ws in texts for w in ws}
                held = 0
            held += sum(map(len, new)) + ENTRY_BYTES * len(new)
            found = counter.counts([MARK + w.decode("utf-8", "replace") for w in new])
            known.update((w, found[MARK + w.decode("utf-8", "replace")]) for w in new)
            n = [sum(map(known.__getitem__, ws)) for ws in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
