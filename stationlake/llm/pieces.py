"""SentencePiece N-best segmentation and decoding over the piece lattice.

A text becomes a lattice: a node between any two characters, an edge for every
piece of the vocabulary, and for a character that no piece covers one edge that
stands for its UTF-8 bytes (score: the lowest of the vocabulary less 10). The
best segmentation has the highest sum of piece scores.

Pieces never reach over a space that follows another character, so a text is a
chain of words. Forward Viterbi over the distinct words of many texts at once
gives each word's best and second best score. A segmentation among the best n of a
text can differ from the best only in the n - 1 words with the smallest gap
between the two. For these, backward A* search lists the n best paths: the
forward Viterbi scores are the exact cost of what is left, so complete paths
come out in order. A last search joins the words' lists to the text's.

Defined results: null and empty texts have no pieces and one segmentation of
score 0; equal scores come earlier word first; U+2581 in a text decodes to a
space, as in the library; added columns replace columns of the same name.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from stationlake.llm.frames import extended
from stationlake.llm.hashing import Lookup, mixed

SPACE = "▁"
_RANDOM = np.random.default_rng(31)
_FACTORS = _RANDOM.integers(0, 2**63, 1024, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0xD1342543DE82EF95)


def _powers(n: int) -> np.ndarray:
    factors = np.full(max(n, 1), _STEP, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


class Vocabulary:
    """Pieces, scores and the table of their beginnings."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.byte_ids, self.texts = [sp.unk_id()] * 256, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.texts.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i):
                self.texts.append(b"")
            elif sp.is_unknown(i):
                self.texts.append(" ⁇ ".encode())
            else:
                self.texts.append(piece.encode())
                if not sp.is_unused(i):
                    self.pieces[piece] = (i, sp.get_score(i))
        self.unknown = min(s for _, s in self.pieces.values()) - 10.0
        self.longest = max(map(len, self.pieces))
        #: A text may be cut before a space that follows another character.
        self.cut = not any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        begins = sorted({p[:k] for p in self.pieces for k in range(1, len(p) + 1)})
        codes = np.frombuffer("".join(begins).encode("utf-32-le"), np.uint32)
        size = np.array([len(b) for b in begins])
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        values = mixed(codes.astype(np.uint64)) * _FACTORS[np.arange(len(codes)) - np.repeat(first, size)]
        self.begins = Lookup(np.add.reduceat(values, first))
        found = [self.pieces.get(b, (-1, -np.inf)) for b in begins] + [(-1, -np.inf)]
        self.begin_id = np.array([f[0] for f in found])
        self.begin_score = np.array([f[1] for f in found])

    def edges(self, word: str) -> list[list[tuple[int, float, int]]]:
        """For each node, the edges that end there: start, score, piece (-1: bytes)."""
        ending: list[list[tuple[int, float, int]]] = [[] for _ in range(len(word) + 1)]
        for i in range(len(word)):
            for k in range(1, min(self.longest, len(word) - i) + 1):
                if found := self.pieces.get(word[i : i + k]):
                    ending[i + k].append((i, found[1], found[0]))
                elif k == 1:
                    ending[i + 1].append((i, self.unknown, -1))
        return ending

    def ids(self, word: str, path: tuple[tuple[int, int], ...]) -> list[int]:
        return [x for start, piece in path for x in ([piece] if piece >= 0 else [self.byte_ids[b] for b in word[start].encode()])]

    def best_paths(self, word: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a word, best first, by backward A* search."""
        ending = self.edges(word)
        ahead = [0.0] + [-np.inf] * len(word)
        for end in range(1, len(word) + 1):
            ahead[end] = max((ahead[i] + score for i, score, _ in ending[end]), default=-np.inf)
        # Priority, node, score from the node to the end, and the path there as a linked list.
        agenda, order, out = [(-ahead[-1], len(word), 0, 0.0, None)], 0, []
        while agenda and len(out) < n:
            _, node, _, after, path = heapq.heappop(agenda)
            if node == 0:
                steps = []
                while path:
                    steps.append(path[0])
                    path = path[1]
                out.append((after, self.ids(word, tuple(steps))))
                continue
            for start, score, piece in ending[node]:
                order += 1
                heapq.heappush(agenda, (-(after + score + ahead[start]), start, order, after + score, ((start, piece), path)))
        return out

    def two_best(self, codes: np.ndarray, offsets: np.ndarray):
        """Best ids (flat, with offsets), best and second best score of many words.

        ``codes`` holds the words' characters one after another; all words
        advance together, one character at a time.
        """
        size = np.diff(offsets)
        n_words, most = len(size), int(size.max(initial=0))
        place = np.arange(len(codes)) - np.repeat(offsets[:-1], size)
        left = np.repeat(size, size) - place
        node = np.arange(len(codes)) + np.repeat(np.arange(n_words), size)
        values = mixed(codes.astype(np.uint64))
        found, at, h = [], np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        for k in range(self.longest):
            h = h + values[at + k] * _FACTORS[k]
            entry = self.begins.find(h)
            score, piece = self.begin_score[entry], self.begin_id[entry]
            if k == 0:
                bare = piece < 0
                score = np.where(bare, self.unknown, score)
                found.append((at, np.ones(len(at), np.int64), score, piece))
            else:
                is_piece = piece >= 0
                found.append((at[is_piece], np.full(int(is_piece.sum()), k + 1), score[is_piece], piece[is_piece]))
            go = (entry < self.begins.n) & (left[at] > k + 1)
            at, h = at[go], h[go]
            if not len(at):
                break
        start, width, score, piece = (np.concatenate([f[i] for f in found]) for i in range(4))
        order = np.argsort(place[start], kind="stable")
        start, width, score, piece = start[order], width[order], score[order], piece[order]
        source = node[start]
        target = source + width
        best = np.full(len(codes) + n_words, -np.inf)
        second = best.copy()
        best[offsets[:-1] + np.arange(n_words)] = 0.0
        back = np.full(len(best), -1)
        bounds = np.searchsorted(place[start], np.arange(most + 1))
        for s in range(most):
            e = slice(bounds[s], bounds[s + 1])
            to, one, two = target[e], best[source[e]] + score[e], second[source[e]] + score[e]
            old = best[to]
            second[to] = np.maximum(np.minimum(old, one), np.maximum(second[to], two))
            better = one > old
            best[to[better]] = one[better]
            back[to[better]] = np.flatnonzero(better) + bounds[s]
        ends = offsets[1:] + np.arange(n_words)
        at, rows, steps = ends.copy(), np.arange(n_words), []
        while len(rows):
            edge = back[at]
            go = edge >= 0
            rows, edge = rows[go], edge[go]
            steps.append((rows, edge))
            at = source[edge]
        of = np.concatenate([s[0] for s in steps]) if steps else np.empty(0, np.int64)
        edge = np.concatenate([s[1] for s in steps]) if steps else np.empty(0, np.int64)
        order = np.lexsort((start[edge], of))
        of, edge = of[order], edge[order]
        ids, counts = piece[edge], np.ones(len(edge), np.int64)
        for i in np.flatnonzero(ids < 0)[::-1]:
            raw = chr(codes[start[edge[i]]]).encode("utf-8", "surrogatepass")
            ids = ids if len(raw) == 1 else np.insert(ids, i, [-1] * (len(raw) - 1))
            counts[i] = len(raw)
            ids[i : i + len(raw)] = [self.byte_ids[b] for b in raw]
        n_ids = np.bincount(of, counts, n_words).astype(np.int64)
        return ids, np.concatenate(([0], np.cumsum(n_ids))), best[ends], second[ends]

    def decode(self, ids) -> str:
        text = b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def vocabulary(model_file: str) -> Vocabulary:
    return Vocabulary(model_file)


def _joined(gaps: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n smallest sums of one gap from each list, each list ascending from 0."""
    agenda, seen, out = [(0.0, (0,) * len(gaps))], set(), []
    while agenda and len(out) < n:
        total, chosen = heapq.heappop(agenda)
        if chosen in seen:
            continue
        seen.add(chosen)
        out.append((total, chosen))
        for i, c in enumerate(chosen):
            if c + 1 < len(gaps[i]):
                heapq.heappush(agenda, (total - gaps[i][c] + gaps[i][c + 1], (*chosen[:i], c + 1, *chosen[i + 1 :])))
    return out


class Encoder:
    """Segments batches of texts; keeps the A* lists of words seen, up to ``most``."""

    def __init__(self, model_file: str, n: int, most: int = 50_000):
        self.vocabulary, self.n = vocabulary(model_file), n
        self.paths = lru_cache(maxsize=most)(lambda word: self.vocabulary.best_paths(word, n))

    def __call__(self, texts: list[str]):
        """Per text: ids, best score, and the best n as (score, [(word number, ids)])."""
        v = self.vocabulary
        spaced = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        joined = "".join(spaced)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        text_at = np.concatenate(([0], np.cumsum([len(s) for s in spaced]))).astype(np.int64)
        begins = np.zeros(len(codes), bool)
        if v.cut:
            gap = codes == ord(SPACE)
            begins[1:] = gap[1:] & ~gap[:-1]
        begins[text_at[:-1][np.diff(text_at) > 0]] = True
        first = np.flatnonzero(begins)
        size = np.diff(np.append(first, len(codes)))
        place = np.arange(len(codes)) - np.repeat(first, size)
        hashes = np.add.reduceat(mixed(codes.astype(np.uint64)) * _powers(int(size.max(initial=0)))[place], first) if len(first) else np.empty(0, np.uint64)
        _, sample, word = np.unique(mixed(hashes + size.astype(np.uint64)), return_index=True, return_inverse=True)
        offsets = np.concatenate(([0], np.cumsum(size[sample])))
        take = np.repeat(first[sample] - offsets[:-1], size[sample]) + np.arange(offsets[-1])
        ids, id_at, best, second = v.two_best(codes[take], offsets)
        gaps, n_ids = best - second, np.diff(id_at)
        words_at = np.searchsorted(first, text_at)
        for i, _ in enumerate(texts):
            own = word[words_at[i] : words_at[i + 1]]
            n_own = n_ids[own]
            total = int(n_own.sum())
            flat = ids[np.repeat(id_at[own] - np.concatenate(([0], np.cumsum(n_own)[:-1])), n_own) + np.arange(total)] if total else ids[:0]
            score = float(best[own].sum())
            near = gaps[own]
            k = self.n - 1
            pick = np.flatnonzero(near <= np.partition(near, k - 1)[k - 1])[:k] if 0 < k < len(near) else np.arange(len(near) if k else 0)
            if 0 < k < len(near):  # fewer than k below the k-th: fill up with equal gaps in order
                below = np.flatnonzero(near < np.partition(near, k - 1)[k - 1])
                equal = np.flatnonzero(near == np.partition(near, k - 1)[k - 1])[: k - len(below)]
                pick = np.sort(np.concatenate([below, equal]))
            pick = pick[np.isfinite(near[pick])]
            begin = int(words_at[i])
            lists = [self.paths(joined[first[begin + w] : first[begin + w] + size[begin + w]]) for w in pick]
            found = _joined([[p[0][0] - q[0] for q in p] for p in lists], self.n)
            yield flat, score, [
                (score - lost, [(int(pick[j]), lists[j][c][1]) for j, c in enumerate(chosen) if c]) for lost, chosen in found
            ]


SCHEMA = (
    "ids array<int>, score double, restored boolean, "
    "nbest array<struct<score: double, swaps: array<struct<word: int, ids: array<int>>>>>"
)


_NBEST = pa.list_(pa.struct([("score", pa.float64()), ("swaps", pa.list_(pa.struct([("word", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))


def encode(docs: DataFrame, model_file: str, n: int = 4, text: str = "text", keep=None) -> DataFrame:
    """``docs`` with the best ``ids``, their ``score``, whether they decode to the text, and ``nbest``.

    An entry of ``nbest`` has its score and the words whose pieces differ from
    the best: the word's number in the text and its ids.
    """

    types = [pa.list_(pa.int32()), pa.float64(), pa.bool_(), _NBEST]

    def run(batches):
        encoder = Encoder(model_file, n)
        for batch in batches:
            column, parts = batch.column(text), []
            # A portion's results are Arrow arrays before the next is begun.
            for a, b in _portions(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
                texts = [t or "" for t in column.slice(a, b - a).to_pylist()]
                ids, scores, restored, nbest = [], [], [], []
                for t, (flat, score, found) in zip(texts, encoder(texts)):
                    ids.append(flat.astype(np.int32))
                    scores.append(score)
                    restored.append(encoder.vocabulary.decode(flat.tolist()) == t.replace(SPACE, " "))
                    nbest.append([{"score": s, "swaps": [{"word": w, "ids": x} for w, x in swaps]} for s, swaps in found])
                at = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(at, pa.array(np.concatenate(ids)))
                parts.append([lists, pa.array(scores, types[1]), pa.array(restored, types[2]), pa.array(nbest, types[3])])
            yield [pa.concat_arrays([p[i] for p in parts]) if parts else pa.array([], t) for i, t in enumerate(types)]

    return extended(docs, SCHEMA, run, keep)


def _portions(sizes: list[int], most: int = 500_000):
    """Bounds of texts in a row with up to ``most`` bytes together; a longer text stands alone."""
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > most:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def decode(docs: DataFrame, model_file: str, ids: str = "ids", into: str = "decoded", keep=None) -> DataFrame:
    """``docs`` with the text of the ids; null ids give null, unknown ids the library's sign."""

    def run(batches):
        words = vocabulary(model_file)
        for batch in batches:
            yield [[None if x is None else words.decode(x) for x in batch.column(ids).to_pylist()]]

    return extended(docs, f"`{into}` string", run, keep)
