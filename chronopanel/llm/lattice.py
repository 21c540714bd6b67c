"""Marginal likelihood of words under a piece vocabulary: log-space forward (and backward) recursion over all segmentations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

from chronopanel.llm import textblocks as tb

MARK = "▁"
_CELLS = 1 << 18


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their weights as they stand in the file; spelled: index of the piece of each byte, for unknown characters."""

    pieces: tuple[str, ...]
    weights: np.ndarray
    spelled: np.ndarray

    @property
    def starts_word(self) -> np.ndarray:
        return np.array([p.startswith(MARK) for p in self.pieces])


def read_vocabulary(path: str) -> Vocabulary:
    """Pieces of a sentencepiece file that can stand in a word. Ranked scores (0, -1, -2, ...) become weights 1 / (rank + 10)."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces, scores, spelled = [], [], np.zeros(256, np.int64)
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or MARK in piece[1:]:
            continue
        if model.is_byte(i):
            spelled[int(piece[3:5], 16)] = len(pieces)
            piece = "\0" + piece
        pieces.append(piece)
        scores.append(model.get_score(i))
    scores = np.array(scores)
    weights = np.exp(scores) if scores.min() > -100 else 1 / (scores.max() - scores + 10)
    return Vocabulary(tuple(pieces), weights / weights.sum(), spelled)


class Lattice:
    """Finds pieces in words by substring hashes. log_p has a log probability for each piece."""

    def __init__(self, vocabulary: Vocabulary, log_p: np.ndarray) -> None:
        self.vocabulary, self.log_p = vocabulary, np.append(log_p, -np.inf)
        by_size: dict[int, list[int]] = {}
        for i, p in enumerate(vocabulary.pieces):
            if p[0] != "\0":
                by_size.setdefault(len(p), []).append(i)
        self.tables = {}
        for size, ids in sorted(by_size.items()):
            codes = np.array([[ord(c) for c in vocabulary.pieces[i]] for i in ids], np.uint64)
            hashes = self._hash(codes, size)[:, 0]
            order = np.argsort(hashes)
            seen = np.zeros(1 << 18, bool)
            seen[hashes & np.uint64(len(seen) - 1)] = True
            self.tables[size] = (hashes[order], np.array(ids)[order], seen)

    @staticmethod
    def _sums(codes: np.ndarray) -> np.ndarray:
        total = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        np.cumsum(tb.mix(codes + np.uint64(1)) * tb.powers(codes.shape[1])[: codes.shape[1]], axis=1, out=total[:, 1:])
        return total

    def _hash(self, codes: np.ndarray, size: int, total: np.ndarray | None = None) -> np.ndarray:
        total = self._sums(codes) if total is None else total
        return (total[:, size:] - total[:, :-size]) * tb.powers(codes.shape[1], "down")[: codes.shape[1] - size + 1]

    def arcs(self, codes: np.ndarray) -> dict[int, np.ndarray]:
        """For each size, the piece that starts at each place of each word, or -1."""
        total, out = self._sums(codes), {}
        for size, (hashes, ids, seen) in self.tables.items():
            if size > codes.shape[1]:
                break
            h = self._hash(codes, size, total)
            at = np.nonzero(seen[h & np.uint64(len(seen) - 1)])
            near = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
            found = np.full(h.shape, -1, np.int32)
            found[at] = np.where(hashes[near] == h[at], ids[near], -1)
            if size == 1 or (found >= 0).any():
                out[size] = found
        return out

    def spelling(self, code: int) -> np.ndarray:
        return self.vocabulary.spelled[list(chr(code).encode("utf-8", "replace"))]

    def arc_weights(self, codes: np.ndarray, arcs: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        out = {size: self.log_p[found] for size, found in arcs.items()}
        unknown = np.nonzero(arcs[1] < 0)
        if len(unknown[0]):
            chars, which = np.unique(codes[unknown], return_inverse=True)
            out[1][unknown] = np.array([self.log_p[self.spelling(int(c))].sum() for c in chars])[which]
        return out

    @staticmethod
    def _sum(terms: list[np.ndarray]) -> np.ndarray:
        stacked = np.stack(terms)
        top = stacked.max(axis=0)
        safe = np.where(np.isfinite(top), top, 0)
        with np.errstate(divide="ignore"):
            return safe + np.log(np.exp(stacked - safe).sum(axis=0))

    def forward(self, weights: dict[int, np.ndarray], n: int, width: int) -> np.ndarray:
        """Log probability of each prefix, all segmentations summed."""
        alpha = np.full((n, width + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, width + 1):
            alpha[:, j] = self._sum([alpha[:, j - s] + w[:, j - s] for s, w in weights.items() if s <= j])
        return alpha

    def backward(self, weights: dict[int, np.ndarray], n: int, width: int) -> np.ndarray:
        beta = np.full((n, width + 1), -np.inf)
        beta[:, width] = 0
        for j in range(width - 1, -1, -1):
            beta[:, j] = self._sum([w[:, j] + beta[:, j + s] for s, w in weights.items() if j + s <= width])
        return beta

    @staticmethod
    def groups(words: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(indices, codes) of words of one length, each with the word mark before it, in groups of bounded size."""
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            size = int(sizes[order[at]])
            to = min(int(np.searchsorted(sizes[order], size, "right")), at + max(1, _CELLS // (size + 1)))
            take = order[at:to]
            text = "".join(words[i] for i in take.tolist())
            codes = np.full((len(take), size + 1), ord(MARK), np.uint64)
            codes[:, 1:] = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).reshape(len(take), size)
            yield take, codes
            at = to

    def log_marginals(self, words: Sequence[str]) -> np.ndarray:
        """Natural logarithm of each word's probability as a string of pieces."""
        out = np.empty(len(words))
        for take, codes in self.groups(words):
            weights = self.arc_weights(codes, self.arcs(codes))
            out[take] = self.forward(weights, *codes.shape)[:, -1]
        return out

    def expected_counts(self, words: Sequence[str], times: np.ndarray) -> np.ndarray:
        """How often each piece is expected to be used in the words, each seen `times` times."""
        total = np.zeros(len(self.vocabulary.pieces))
        for take, codes in self.groups(words):
            arcs = self.arcs(codes)
            weights = self.arc_weights(codes, arcs)
            alpha, beta = self.forward(weights, *codes.shape), self.backward(weights, *codes.shape)
            whole, seen = alpha[:, -1:], times[take][:, None]
            for size, w in weights.items():
                share = np.exp(alpha[:, : w.shape[1]] + w + beta[:, size:] - whole) * seen
                known = arcs[size] >= 0
                total += np.bincount(arcs[size][known], share[known], minlength=len(total))
                if size == 1 and not known.all():
                    chars, which = np.unique(codes[~known], return_inverse=True)
                    for c, x in zip(chars, np.bincount(which, share[~known]), strict=True):
                        np.add.at(total, self.spelling(int(c)), x)
        return total
