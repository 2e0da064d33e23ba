"""Segmentation lattices over an existing subword vocabulary, for many strings at once.

An arc is a vocabulary piece that spells a substring, or the byte pieces of a character that is no piece itself.
Strings of one length form a matrix of code points; the recursion walks over start positions and piece lengths, and each
step is a few numpy operations on all the strings. The semiring is the caller's: max-plus gives the best segmentation,
log-sum-exp the marginal over all of them.
"""

from __future__ import annotations

import math

import numpy as np
import sentencepiece

SPACE = "▁"
#: Stands for a literal U+2581 of the text, which must not read as a space. Text has no lone surrogates.
LITERAL = "\udc81"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
#: Scores below this mark pieces that are no merges: runs of spaces (each worse than its single spaces, so never part
#: of a best path) and single symbols.
NEVER = -1e8
#: Marks in the hash table.
NONE, PREFIX = -1, -2


class Vocabulary:
    """Pieces, ids and scores of a SentencePiece model file; read only, nothing is trained."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces: dict[str, int] = {}
        self.scores = np.full(n, -np.inf)
        self.byte_ids = np.full(256, -1, np.int32)
        #: What a piece decodes to.
        self.bytes = [b""] * n
        for k in range(n):
            piece, score = model.id_to_piece(k), model.get_score(k)
            if model.is_byte(k):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = k
                self.bytes[k] = bytes([value])
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                self.bytes[k] = piece.replace(SPACE, " ").encode("utf-8")
                if score > NEVER or SPACE not in piece[1:]:
                    self.pieces[piece] = k
                    self.scores[k] = score
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary has no byte pieces, so it can't spell every text")
        inner = [p for p in self.pieces if SPACE in p[1:]]
        if inner:
            raise ValueError(f"pieces with inner spaces: {inner[:3]}")
        # a lone piece with such a score is a last resort: below every other piece, above bytes
        last = self.scores[self.scores > NEVER].min() - 1.0
        self.scores = np.where((self.scores > -np.inf) & (self.scores < NEVER), last, self.scores)
        #: As in unigram segmentation, a fallback is worse than any piece.
        self.byte_score = float(self.scores[self.scores > -np.inf].min()) - 10.0
        self.scores[self.byte_ids] = self.byte_score
        self.longest = max(map(len, self.pieces))
        self.line_feed_stands_alone = not any("\n" in p for p in self.pieces)

    def zipf(self) -> np.ndarray:
        """Unigram log probabilities of all pieces, which add up to 1. The file's scores are ranks and no probabilities of
        their own: a piece of rank r gets a weight of 1 / (r + 3), and one last rank is shared by all bytes."""
        used = self.scores > -np.inf
        weight = np.zeros(len(self.scores))
        weight[used] = 1.0 / (3.0 - self.scores[used])
        weight[self.byte_ids] = 1.0 / (3.0 - self.byte_score) / 256
        with np.errstate(divide="ignore"):
            return np.log(weight / weight.sum())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Lattice:
    """A vocabulary's pieces in a hash table of code-point sequences, with a score for each id."""

    def __init__(self, vocabulary: Vocabulary, scores: np.ndarray):
        self.vocabulary, self.scores = vocabulary, scores
        # proper prefixes of pieces are entered too, so a substring that no piece starts with is dropped at once
        entries = dict.fromkeys((p[:n] for p in vocabulary.pieces for n in range(1, len(p))), PREFIX) | vocabulary.pieces
        self.bits = max(10, math.ceil(math.log2(6 * len(entries))))
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.ids = np.full(1 << self.bits, NONE, np.int32)
        keys = np.array([self._key(p) for p in entries], np.uint64)
        for slot, key, k in zip(self._slot(keys).tolist(), keys, entries.values(), strict=True):
            while self.ids[slot] != NONE:
                slot = (slot + 1) & (len(self.keys) - 1)
            self.keys[slot], self.ids[slot] = key, k

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_MULTIPLIER) + ord(c) + 1) % 2**64
        return h

    def _slot(self, h):
        with np.errstate(over="ignore"):
            return ((h ^ (h >> np.uint64(29))) * _SPREAD) >> np.uint64(64 - self.bits)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of the hashed substrings; PREFIX where only longer pieces start so, NONE where no piece does."""
        slot = self._slot(h).astype(np.int64)
        out = self.ids[slot]
        other = np.flatnonzero((out != NONE) & (self.keys[slot] != h))
        while len(other):
            slot[other] = (slot[other] + 1) & (len(self.keys) - 1)
            out[other] = self.ids[slot[other]]
            other = other[(out[other] != NONE) & (self.keys[slot[other]] != h[other])]
        return out

    def fallback_bytes(self, points: np.ndarray) -> np.ndarray:
        """UTF-8 bytes of each character; the stand-in of U+2581 has that character's three."""
        return np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))

    def run(self, points: np.ndarray, sizes: np.ndarray, combine, keep=None) -> np.ndarray:
        """States of reaching each end, by ``combine(old, offered)``; ``keep`` sees every arc.

        ``points``: length x strings, the strings by falling ``sizes``, so those that are long enough for an arc are
        a prefix of the row. Returns (length + 1) x strings, the state after each prefix."""
        length, n = points.shape
        state = np.full((length + 1, n), -np.inf)
        state[0] = 0.0
        reach = [int(np.searchsorted(-sizes, -e, side="right")) for e in range(length + 1)]  # strings of size e or more
        for i in range(length):
            rows, h = np.arange(reach[i + 1]), np.zeros(reach[i + 1], np.uint64)
            for size in range(1, min(self.vocabulary.longest, length - i) + 1):
                m = np.searchsorted(rows, reach[i + size])
                rows = rows[:m]
                if not m:
                    break
                h = h[:m] * _MULTIPLIER + points[i + size - 1, rows] + np.uint64(1)
                ids = self.find(h)
                if size == 1:
                    lone = np.flatnonzero(ids < 0)
                    if len(lone):
                        self._arcs(state, i, 1, rows[lone], np.full(len(lone), NONE), self.byte_weight(points[i, rows[lone]]), combine, keep)
                whole = ids >= 0
                self._arcs(state, i, size, rows[whole], ids[whole], self.scores[ids[whole]], combine, keep)
                alive = ids != NONE
                rows, h = rows[alive], h[alive]
        return state

    @staticmethod
    def _arcs(state, i, size, rows, ids, weight, combine, keep) -> None:
        offered, old = state[i, rows] + weight, state[i + size, rows]
        if keep is not None:
            better = offered > old
            keep(i, size, rows[better], ids[better])
        state[i + size, rows] = combine(old, offered)

    def byte_weight(self, points: np.ndarray) -> np.ndarray:
        return self.fallback_bytes(points) * self.scores[self.vocabulary.byte_ids[0]]


def blocks(words: list[str], most: int = 1 << 19):
    """Words in blocks of bounded size, each by falling length and of similar lengths: their indices, a matrix of code
    points (position x word) and the lengths."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    at = 0
    while at < len(order):
        top = int(length[order[at]])
        end = min(len(order), at + max(1, most // top))
        end = at + int(np.searchsorted(-length[order[at:end]], -(top // 2 if top > 32 else 0), side="left"))
        end = max(end, at + 1)
        block = order[at:end]
        sizes = length[block]
        points = np.zeros((len(block), top), np.uint64)
        points[np.arange(top)[None, :] < sizes[:, None]] = code_points("".join([words[k] for k in block]))
        yield block, np.ascontiguousarray(points.T), sizes
        at = end


class BestPaths(Lattice):
    """Max-plus: the segmentation with the highest sum of the vocabulary's own scores. Of equals, the one whose
    last differing piece is longer."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(vocabulary, vocabulary.scores)

    def encode(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as int32 bytes."""
        out = [b""] * len(words)
        for block, points, sizes in blocks(words):
            length, n = points.shape
            arc_size = np.zeros((length + 1, n), np.int16)
            arc_id = np.full((length + 1, n), -1, np.int32)

            def keep(i, size, rows, ids, arc_size=arc_size, arc_id=arc_id):
                arc_size[i + size, rows] = size
                arc_id[i + size, rows] = ids

            self.run(points, sizes, np.maximum, keep)
            rows = np.arange(n)
            # backwards: every word takes one arc a step, until all are at their start
            at, steps = sizes.copy(), []
            while at.any():
                live = at > 0
                ids = np.where(live, arc_id[at, rows], PREFIX)
                at = at - np.where(live, arc_size[at, rows], 0)
                steps.append((ids, at))
            path = np.stack([ids for ids, _ in steps[::-1]], 1)
            starts = np.stack([s for _, s in steps[::-1]], 1)
            spelled = (path == NONE).any(1)
            flat, ends = path[path >= 0].astype(np.int32), (path >= 0).sum(1).cumsum()
            data, at = flat.tobytes(), 0
            for r, (k, end) in enumerate(zip(block.tolist(), (4 * ends).tolist(), strict=True)):
                out[k] = self._spelled(path[r], starts[r], words[k]) if spelled[r] else data[at:end]
                at = end
        return out

    def _spelled(self, path, starts, word: str) -> bytes:
        ids: list[int] = []
        for k, start in zip(path, starts, strict=True):
            if k >= 0:
                ids.append(int(k))
            elif k == NONE:
                c = word[start]
                ids += [int(self.vocabulary.byte_ids[b]) for b in (SPACE if c == LITERAL else c).encode("utf-8")]
        return np.array(ids, np.int32).tobytes()


class Marginals(Lattice):
    """Log-sum-exp: the log probability that a string is spelled, summed over all of its segmentations."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(vocabulary, vocabulary.zipf())

    def log_probability(self, words: list[str]) -> np.ndarray:
        total = np.zeros(len(words))
        for block, points, sizes in blocks(words):
            total[block] = self.run(points, sizes, np.logaddexp)[sizes, np.arange(len(block))]
        return total
