"""The greedy merge: pieces of bytes (or characters) to ids, and its Arrow wrapper with a cache of pieces."""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa

from ..memory import by_slices
from ..session import small_batches
from ..sources.vocabulary import LOW_BAR, Vocabulary

#: Symbols from which a piece is merged with a heap.
LONG = 48
#: Bytes of pieces and their ids that a worker remembers, about; beyond it, it starts afresh.
KEPT = 32 << 20
#: What a remembered piece takes besides its characters and ids.
_EACH = 150
_WORD, _WORD_OR_TAG = re.compile(f"{LOW_BAR}*[^{LOW_BAR}]+|{LOW_BAR}+"), re.compile(f"{LOW_BAR}*(?:[^{LOW_BAR}]|(?<=>){LOW_BAR})+|{LOW_BAR}+")


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, piece: np.ndarray, counts: np.ndarray, mask: pa.Array | None) -> pa.Array:
    """Arrays of ids: for each row so many consecutive pieces, whose ids lie in `flat`."""
    sizes = lengths[piece].astype(np.int64)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    ids = flat[np.arange(total) + np.repeat(starts[piece] - (ends - sizes), sizes)]
    stops = np.concatenate(([0], ends))[np.cumsum(counts)]
    offsets = np.concatenate(([0], stops)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids), mask=mask)


class Merger:
    """Exact greedy merging: always the lowest rank, leftmost first."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.rank_of = {(a, b): (rank, new) for rank, (a, b, new) in enumerate(vocab.merges)}
        self.tags = any(vocab.tokens[a].endswith(b">") and vocab.tokens[b].startswith(LOW_BAR.encode()) for a, b, _ in vocab.merges) if vocab.sentence_piece else False
        self.fast = None
        self.clear()

    def clear(self) -> None:
        self.known: dict[str | bytes | int, int] = {}
        self.held = 0
        self.flat, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def first_ids(self, piece: str | bytes) -> list[int]:
        """The ids before any merge."""
        v = self.vocab
        if v.sentence_piece:
            out: list[int] = []
            for c in piece if isinstance(piece, str) else piece.decode("utf-8"):
                own = v.model_ids.get(c.encode("utf-8"))
                out += [own] if own is not None else [v.byte_ids[b] for b in c.encode("utf-8")]
            return out
        raw = piece.encode("utf-8") if isinstance(piece, str) else piece
        return [v.byte_ids[b] for b in raw]

    def piece(self, piece: str | bytes) -> list[int]:
        """The ids of one pre-token."""
        v = self.vocab
        if isinstance(piece, str) and piece in v.added:
            return [v.added[piece]]
        if v.ignore_merges:
            whole = v.model_ids.get(piece.encode("utf-8") if isinstance(piece, str) else piece)
            if whole is not None:
                return [whole]
        if self.fast is not None:
            return self.fast(piece.encode("utf-8") if isinstance(piece, str) else piece)
        ids = self.first_ids(piece)
        return self.heap(ids) if len(ids) >= LONG else self.scan(ids)

    def scan(self, ids: list[int]) -> list[int]:
        rank_of = self.rank_of.get
        while len(ids) > 1:
            best, at, product = None, -1, -1
            for i in range(len(ids) - 1):
                found = rank_of((ids[i], ids[i + 1]))
                if found is not None and (best is None or found[0] < best):
                    (best, product), at = found, i
            if best is None:
                break
            ids[at : at + 2] = [product]
        return ids

    def heap(self, ids: list[int]) -> list[int]:
        """The same in O(n log n), over a linked list."""
        n, rank_of = len(ids), self.rank_of.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        todo: list[tuple[int, int, int, int, int]] = []

        def look(i: int) -> None:
            j = after[i]
            if j < n and (found := rank_of((ids[i], ids[j]))) is not None:
                heapq.heappush(todo, (found[0], i, ids[i], ids[j], found[1]))

        for i in range(n - 1):
            look(i)
        while todo:
            _, i, a, b, product = heapq.heappop(todo)
            j = after[i]
            if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = product, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        return [x for x, live in zip(ids, alive) if live]

    def words(self, text: str) -> list[str]:
        """A sentence-piece text without literals, cut where no merge of the vocabulary can cross.

        A loaded vocabulary has none from another character into a low bar, but for a closing bracket and a tag.
        """
        return (_WORD_OR_TAG if self.tags else _WORD).findall(low_bar(text))

    def known_at(self, words: list) -> np.ndarray:
        """The places of words in the cache: texts or bytes of pre-tokens, or ids that stand for themselves."""
        if self.held > KEPT:
            self.clear()
        at = list(map(self.known.get, words))
        fresh: list[list[int]] = []
        if None in at:
            for k, i in enumerate(at):
                if i is None:
                    w = words[k]
                    i = self.known.get(w)
                    if i is None:
                        i = self.known[w] = len(self.known)
                        fresh.append([w] if isinstance(w, int) else self.piece(w))
                        self.held += _EACH + 4 * len(fresh[-1]) + (0 if isinstance(w, int) else len(w))
                    at[k] = i
            self.sizes = np.concatenate((self.sizes, np.fromiter(map(len, fresh), np.int64, len(fresh))))
            self.flat = np.concatenate((self.flat, np.array([x for ids in fresh for x in ids], np.int32)))
        return np.array(at, np.int64)

    def ids_at(self, piece: np.ndarray, counts: np.ndarray, mask: pa.Array | None = None) -> pa.Array:
        """Arrays of ids of consecutive pieces, so many for each row."""
        return gathered(self.flat, np.cumsum(self.sizes) - self.sizes, self.sizes, piece, counts, mask)

    def lists(self, pieces: pa.Array) -> pa.Array:
        """Arrays of pre-tokens to arrays of ids; each distinct pre-token of a slice is looked up once."""
        return by_slices(self._lists, pa.list_(pa.int32()), pieces)

    def _lists(self, pieces: pa.Array) -> pa.Array:
        coded = pieces.flatten().dictionary_encode()
        at = self.known_at(coded.dictionary.to_pylist())
        piece = at[coded.indices.to_numpy(zero_copy_only=False)] if len(at) else np.zeros(0, np.int64)
        counts = np.asarray(pieces.value_lengths().fill_null(0)).astype(np.int64)
        return self.ids_at(piece, counts, pieces.is_null() if pieces.null_count else None)

    def rows(self, rows: list[list | None]) -> pa.Array:
        """The same for lists of words as known_at takes them."""
        at = self.known_at([w for row in rows if row for w in row])
        missing = [row is None for row in rows]
        return self.ids_at(at, np.array([len(row or ()) for row in rows], np.int64), pa.array(missing) if any(missing) else None)

    def texts(self, texts: pa.Array, literal: re.Pattern | None) -> pa.Array:
        """Sentence-piece texts to arrays of ids."""
        added = self.vocab.added

        def cut(text: str) -> list:
            parts = literal.split(text) if literal else [text]
            # a word that is spelled like a literal isn't one: its low bars were spaces
            return [w if i % 2 or w not in added else w.encode() for i, p in enumerate(parts) for w in ((added[p],) if i % 2 else self.words(p))]

        return by_slices(lambda own: self.rows([None if t is None else cut(t) for t in own.to_pylist()]), pa.list_(pa.int32()), texts)


_mergers: dict[str, Merger] = {}


def merger(broadcast) -> Merger:
    """The worker's merger for a broadcast vocabulary."""
    if broadcast.id not in _mergers:
        if len(_mergers) > 4:
            _mergers.clear()
        own = _mergers[broadcast.id] = Merger(broadcast.vocab.value)
        if broadcast.library:
            from .library import single

            own.fast = single(own.vocab)
    return _mergers[broadcast.id]


class Sent:
    """A vocabulary on its way to the workers, with the digest that their caches know it by."""

    def __init__(self, spark, vocab: Vocabulary):
        self.vocab = small_batches(spark).sparkContext.broadcast(vocab)
        self.id = vocab.digest
        from .library import merges

        self.library = merges(vocab)


def low_bar(text: str) -> str:
    return text.replace(" ", LOW_BAR)
