"""Token counts of texts under a unigram vocabulary, by a Viterbi pass that carries only scores and counts.

An Aho-Corasick automaton of the vocabulary gives all pieces that end at each character, the longest first. The best
segmentation up to a character is the first of the best-scored ones in that order (a later start wins only with a
higher score), a character without a piece of its own costs the vocabulary's least score less 10 and counts as its
UTF-8 bytes if the vocabulary has byte pieces: the rules of the public unigram tokenizers, in double precision.

A text is cut where no piece can cross: before runs of word marks, and around characters that stand in no longer
piece. Cuts hold for every path, so a word's count is remembered. Only rounding could tie a word to what is before it:
where two segmentations of a word are nearer than the rounding errors, it is done again from the exact score so far.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a worker remembers, at most, and their greatest length.
REMEMBERED, LONGEST = 400_000, 64
#: The mark of a word's start, and what an unknown character costs below the least score.
MARK, UNKNOWN_COST = "▁", 10.0

_RESULT = ("n_tokens", "best_score")


def count_tokens(docs: DataFrame, model: str, column: str = "text") -> DataFrame:
    """docs with `n_tokens` (long) and `best_score` (double, the sum of the pieces' scores).

    model: a sentencepiece file, whose pieces and scores are taken as a unigram vocabulary and whose own normalizer is
    applied; each executor has it at that path. Texts are counted whole. Null and empty texts have no tokens and score
    0. Each row, a repeated one too, is counted on its own; an empty table gives an empty table. Columns of docs that
    are named as a result column are replaced.
    """
    own = [c for c in docs.columns if c.lower() not in _RESULT]
    row = F.struct(*[F.col(f"`{c}`") for c in own]) if own else F.struct(F.lit(0).alias("none"))
    rows = docs.select(row.alias("row"), F.col(column).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(partial(_count, model=model), f"row {kind}, n_tokens long, best_score double")
    return out.select(*[F.col("row").getField(c).alias(c) for c in own], *_RESULT)


class Unigram:
    """Counts by pieces and their scores."""

    def __init__(self, pieces: dict[str, float], least: float, byte_pieces: bool):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown, self.byte_pieces = least - UNKNOWN_COST, byte_pieces
        longer = {c for p in pieces if len(p) > 1 for c in p}
        #: Sums of integers are exact in doubles, so ties are the same everywhere.
        self.exact = all(float(s).is_integer() for s in pieces.values())
        crossed = any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        solo = "".join(re.escape(c) for c in "\n\t\r" if c not in longer)
        if crossed or not byte_pieces:  # then unknown characters in a row are one token, over cuts too
            self.words = re.compile(".+", re.S)
        elif solo:
            self.words = re.compile(f"{MARK}+[^{MARK}{solo}]*|[^{MARK}{solo}]+|[{solo}]")
        else:
            self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.known: dict[str, int] = {}
        self.counts, self.margins, self.sums, self.scores = [], [], [], []

    def best(self, text: str, base: float = 0.0) -> tuple[int, float, list[float], float]:
        """Count, score with base, the pieces' scores and the least gap between the chosen path and others."""
        n = len(text)
        score: list[float | None] = [None] * (n + 1)
        score[0] = base
        count, start, gap, own = [0] * (n + 1), [0] * (n + 1), [float("inf")] * (n + 1), [0.0] * (n + 1)
        ended = 0

        def end(e: int) -> None:
            c = text[e - 1]
            if c not in self.single:
                put(e, e - 1, self.unknown, len(c.encode("utf-8", "surrogatepass")) if self.byte_pieces else 1)

        def put(e: int, s: int, cost: float, more: int) -> None:
            new = score[s] + cost
            old = score[e]
            if old is None or new > old:
                if old is not None:
                    gap[e] = new - old
                score[e], count[e], start[e], own[e] = new, count[s] + more, s, cost
            else:
                gap[e] = min(gap[e], old - new)

        for at, (size, cost) in self.automaton.iter(text):
            e = at + 1
            while ended < e - 1:
                ended += 1
                end(ended)
            put(e, e - size, cost, 1)
        while ended < n:
            ended += 1
            end(ended)
        path, margin, e = [], float("inf"), n
        while e:
            path.append(own[e])
            margin = min(margin, gap[e])
            e = start[e]
        if not self.byte_pieces and self.unknown in path:
            runs = sum(1 for a, b in zip(path, path[1:]) if a == b == self.unknown)
            return count[n] - runs, score[n], path[::-1], margin
        return count[n], score[n], path[::-1], margin

    def best_count(self, text: str) -> tuple[int, float]:
        """Count and score alone; texts of characters that all have pieces of their own need no other rule."""
        if not self.single.issuperset(text):
            count, total, _, _ = self.best(text)
            return count, total
        score, count = [0.0], [0]
        ended = 0
        for at, (size, cost) in self.automaton.iter(text):
            new = score[at + 1 - size] + cost
            if at == ended:
                score.append(new)
                count.append(count[at + 1 - size] + 1)
                ended += 1
            elif new > score[ended]:
                score[ended] = new
                count[ended] = count[at + 1 - size] + 1
        return count[-1], score[-1]

    def _learn(self, word: str) -> int:
        if self.exact:
            count, total = self.best_count(word)
        else:
            count, total, path, margin = self.best(word)
            self.margins.append(margin)
            self.scores.append(path)
        self.counts.append(count)
        self.sums.append(total)
        return len(self.counts) - 1

    def __call__(self, text: str) -> tuple[int, float]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
            for x in (self.counts, self.margins, self.sums, self.scores):
                x.clear()
        if not self.exact:
            return self._rounded(text)
        n, total, known, counts, sums = 0, 0.0, self.known, self.counts, self.sums
        for word in self.words.findall(text):
            k = known.get(word)
            if k is None:
                if len(word) > LONGEST:
                    more, score = self.best_count(word)
                    n += more
                    total += score
                    continue
                k = known[word] = self._learn(word)
            n += counts[k]
            total += sums[k]
        return n, total

    def _rounded(self, text: str) -> tuple[int, float]:
        """With scores that aren't whole numbers: the exact running sum decides where a word is nearly tied."""
        n, total = 0, 0.0
        for word in self.words.findall(text):
            k = self.known.get(word)
            if k is None and len(word) <= LONGEST:
                k = self.known[word] = self._learn(word)
            if k is not None:
                path = self.scores[k]
                bound = (len(path) + len(word)) * np.spacing(abs(total) + abs(self.sums[k]))
                if self.margins[k] > bound:
                    n += self.counts[k]
                    for x in path:
                        total += x
                    continue
            more, total, _, _ = self.best(word, total)
            n += more
        return n, total


@lru_cache(1)
def _tokenizer(path: str) -> tuple[object, Unigram]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    pieces = {model.id_to_piece(i): model.get_score(i) for i in plain}
    return model, Unigram(pieces, min(pieces.values()), any(model.is_byte(i) for i in ids))


def _count(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    normalizer, unigram = _tokenizer(model)
    for batch in batches:
        told = [unigram(normalizer.normalize(x.as_py())) if x.is_valid else (0, 0.0) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in told], pa.int64()), pa.array([x[1] for x in told], pa.float64())], ["row", *_RESULT])
