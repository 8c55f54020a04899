"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a single-pass Viterbi.

The model file's pieces make an Aho-Corasick automaton. One pass over a text's characters
follows, at each position, the automaton's output links to all pieces that end there; each
relaxes the best path to that position from the best path to the piece's start.

- Unigram models: a path's score is the sum of its pieces' scores; where no piece covers a
  character, the unknown piece does, at the least score less 10. Of paths of one score the one with the longest last piece is taken.
- BPE models: a prefix's path is the one that merging would give. It is the piece whose pair with
  the path's last piece before it is stable, that is, merging the two pieces' own symbols
  in order of score never joins across their border. So the same pass gives exactly the ids that the merges
  give, without merging.

Characters outside the vocabulary become byte pieces where the model has byte fallback. Spaces are
written as U+2581 with one in front where the model says so. Chunks that start with such a mark
are encoded apart when no piece has a mark after another character (and words and runs of
punctuation when no piece joins the two), and remembered in a bounded cache. Chunks with runs of marks, whose pieces can share
one score, are merged directly with a heap, in n log n steps.

Only models whose normalizer changes nothing but spaces are taken; others raise
ValueError. Decoding joins pieces and bytes, and drops the mark in front.

Defined results: null and empty texts have no ids and decode to the empty text;
repeated rows get equal results; an empty table gives an empty table. Characters
that no piece and no byte fallback covers become the unknown id, and then a text does
not decode to itself.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.batches import Recent, bound_batches

MARK = "▁"
CACHE = 300_000
SOME = 256
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
TWO_MARKS = MARK * 2
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
POINTS = r"\n.,;:!?|%$#&*"
JOINS = re.compile(f"[{LATIN}][{POINTS}]|[{POINTS}][{LATIN}]")


# The model file: a protocol buffer --------------------------------------------------------


def _fields(data: bytes):
    """(number, value) of a message; lengths give bytes, fixed 32 bits give bytes too."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {5: 4, 1: 8}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


class Model:
    """Pieces, scores, kinds and the settings that matter here."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.type, self.bytes, self.prefix, self.squeeze, self.escape = UNIGRAM, False, True, True, True
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                self.type, self.bytes = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            elif number == 3:
                norm = dict(_fields(value))
                if norm.get(2):
                    raise ValueError("the model's normalizer maps characters")
                self.prefix, self.squeeze, self.escape = (bool(norm.get(k, 1)) for k in (3, 4, 5))
        if self.type not in (UNIGRAM, BPE):
            raise ValueError("not a unigram or BPE model")
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}


@lru_cache(2)
def load(path: str) -> Pieces:
    with open(path, "rb") as f:
        return Pieces(Model(f.read()))


class Pieces:
    """Encoder and decoder of one model."""

    def __init__(self, model: Model):
        self.model = model
        usable = [(p, i) for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k in (NORMAL, USER) and p]
        self.ids = dict(usable)
        self._splits: dict[int, tuple[int, int] | None] = {}
        self._stable: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in usable:
            if model.type != BPE or self._own(i):  # merging never gives the others
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.least = min((model.scores[i] for _, i in usable), default=0.0) - 10.0
        top = max((model.scores[i] for _, i in usable), default=0.0)
        self._gain = [len(p.encode()) * top - 0.1 if k == USER else v for p, v, k in zip(model.pieces, model.scores, model.kinds, strict=True)]
        self.apart = not any(MARK in p.lstrip(MARK) for p, _ in usable)
        finer = f"{MARK}?[{LATIN}]++(?=[{POINTS}{MARK}]|$)|[{POINTS}]++(?=[{LATIN}{MARK}]|$)|" if not any(map(JOINS.search, self.ids)) else ""
        self.chunk = re.compile(f"{finer}{MARK}*[^{MARK}]+|{MARK}+")
        self._letters = {p for p in self.ids if len(p) == 1}
        self._cache = Recent(CACHE)
        # What pieces decode to alone; bytes beyond ASCII, control and unknown pieces depend on their neighbours or are no text.
        shown = [p.replace(MARK, " ") if model.escape else p for p in model.pieces]
        for b, i in model.byte_ids.items():
            shown[i] = chr(b)
        self._plain = np.array([k in (NORMAL, USER) or k == BYTE and p < "\x80" for k, p in zip(model.kinds, shown, strict=True)])
        self._shown, self._texts = shown, pa.array(shown, pa.string())

    # Spaces

    def _normal(self, text: str) -> str:
        m = self.model
        if m.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        if m.prefix:
            text = " " + text
        return text.replace(" ", MARK) if m.escape else text

    # Encoding

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        made = [self._normal(t or "") for t in texts]
        cut = [self.chunk.findall(m) if self.apart else [m] if m else [] for m in made]
        known = self._cache.known(set(chain.from_iterable(cut)), self._learn)
        return [np.frombuffer(b"".join(map(known.__getitem__, c)), np.int32) for c in cut]

    def _ids(self, text: str) -> list[int]:
        if self.model.type == BPE:
            path = self._merged(text) if TWO_MARKS in text else self._bpe_path(text)
        else:
            path = self._unigram_path(text)
        out = []
        for piece, start, end in path:
            if piece >= 0:
                out.append(piece)
            elif self.model.bytes:
                out += [self.model.byte_ids[b] for b in text[start:end].encode()]
            elif not out or out[-1] != self.model.unknown:  # neighbouring unknowns are one
                out.append(self.model.unknown)
        return out

    def _learn(self, keys: list[str]) -> dict[str, bytes]:
        if self.model.type != BPE:
            return {k: array("i", self._ids(k)).tobytes() for k in keys}
        out, letters, path = {}, self._letters.issuperset, self._bpe_ids
        for k in keys:
            out[k] = array("i", path(k) if letters(k) and TWO_MARKS not in k else self._ids(k)).tobytes()
        return out

    def _bpe_ids(self, text: str) -> list[int]:
        """``_bpe_path`` for a text of the vocabulary's characters without runs of marks: ids alone."""
        n, known, stable, wide = len(text), self._stable, self._is_stable, len(self.model.pieces)
        last: list = [-2] + [None] * n
        begin = [0] * (n + 1)
        for end, (size, piece) in self.automaton.iter(text):
            end += 1
            if last[end] is None:
                start = end - size
                before = last[start]
                if start:
                    ok = known.get(before * wide + piece)
                    if not (stable(before, piece) if ok is None else ok):
                        continue
                last[end], begin[end] = piece, start
        out = []
        while n:
            out.append(last[n])
            n = begin[n]
        out.reverse()
        return out

    @staticmethod
    def _walk(last: list, n: int) -> list[tuple[int, int, int]]:
        path, at = [], n
        while at:
            piece, start = last[at]
            path.append((piece, start, at))
            at = start
        return path[::-1]

    def _unigram_path(self, text: str) -> list[tuple[int, int, int]]:
        n, gain = len(text), self._gain
        best = [0.0] + [None] * n
        last: list = [None] * (n + 1)
        ends = iter([*self.automaton.iter(text), (n, (0, 0))])
        end, (size, piece) = next(ends)
        for at in range(1, n + 1):
            single = False
            while end == at - 1:
                start = at - size
                score = best[start] + gain[piece]
                if best[at] is None or score > best[at]:
                    best[at], last[at] = score, (piece, start)
                single |= size == 1
                end, (size, piece) = next(ends)
            if not single:
                score = best[at - 1] + self.least
                if best[at] is None or score > best[at]:
                    best[at], last[at] = score, (-1, at - 1)
        return self._walk(last, n)

    def _bpe_path(self, text: str) -> list[tuple[int, int, int]]:
        n, known, stable, wide = len(text), self._stable, self._is_stable, len(self.model.pieces)
        last, begin = [-2] + [None] * n, [0] * (n + 1)
        if not self._letters.issuperset(text):
            for i, c in enumerate(text, 1):  # no piece ends at a character outside the vocabulary
                if c not in self._letters:
                    last[i], begin[i] = -1, i - 1
        for end, (size, piece) in self.automaton.iter(text):
            end += 1
            if last[end] is not None:
                continue
            start = end - size
            before = last[start]
            if before < 0:
                ok = True
            else:
                ok = known.get(before * wide + piece)
                if ok is None:
                    ok = stable(before, piece)
            if ok:
                last[end], begin[end] = piece, start
        path = []
        while n:
            path.append((last[n], begin[n], n))
            n = begin[n]
        return path[::-1]

    def _own(self, piece: int) -> bool:
        """Whether merging a piece's characters gives that piece."""
        if piece not in self._splits:
            self._split(piece)
        return self._splits[piece] is not None

    def _split(self, piece: int) -> None:
        """Notes the two pieces that the last merge joins; (-1, -1) for one character, None if merging ends elsewhere."""
        text = self.model.pieces[piece]
        if len(text) == 1:
            self._splits[piece] = (-1, -1)
            return
        steps: list[tuple[int, int]] = []
        path = self._merged(text, steps)
        self._splits[piece] = steps[-1] if len(path) == 1 and steps else None

    def _rank(self, piece: int) -> float:
        return -self.model.scores[piece]

    def _is_stable(self, left: int, right: int) -> bool:
        """Whether merging the text of two pieces keeps the border between them.

        The merges inside each piece run in order of rank. Undo them from the latest: the pair of
        symbols at the border must not merge before the earlier of its symbols is used up.
        """
        a, b, limit, of_right = left, right, float("inf"), False
        ok = True
        pieces, ids = self.model.pieces, self.ids
        while True:
            joint = ids.get(pieces[a] + pieces[b])
            if joint is not None:
                rank = self._rank(joint)
                # Equal ranks merge from the left: what used a comes before the border, what used b after it.
                if rank < limit or rank == limit and of_right:
                    ok = False
                    break
            self._own(a), self._own(b)
            sa, sb = self._splits[a], self._splits[b]
            if sa in (None, (-1, -1)) and sb in (None, (-1, -1)):
                break
            ra = self._rank(a) if sa not in (None, (-1, -1)) else -float("inf")
            rb = self._rank(b) if sb not in (None, (-1, -1)) else -float("inf")
            if ra > rb:
                a, limit, of_right = sa[1], ra, False
            else:
                b, limit, of_right = sb[0], rb, True
        if len(self._stable) > CACHE:
            self._stable.clear()
        self._stable[left * len(self.model.pieces) + right] = ok
        return ok

    def _merged(self, text: str, steps: list | None = None) -> list[tuple[int, int, int]]:
        """The pieces that merging gives: always the best-scored pair next to each other, the leftmost of equals.

        A heap holds the pairs and a linked list the parts, so n characters cost n log n steps.
        """
        ids, scores, n = self.ids, self.model.scores, len(text)
        parts: list[str | None] = list(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        joints = ((i, ids.get(parts[i] + parts[i + 1])) for i in range(n - 1))
        heap = [(-scores[j], i, j) for i, j in joints if j is not None]
        heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (j := ids.get(parts[i] + parts[after[i]])) is not None:
                heappush(heap, (-scores[j], i, j))

        while heap:
            _, i, joint = heappop(heap)
            right = after[i]
            if parts[i] is None or right >= n or ids.get(parts[i] + parts[right]) != joint:
                continue  # one of the two has merged with another since
            if steps is not None:
                steps.append((ids.get(parts[i], -1), ids.get(parts[right], -1)))
            parts[i] += parts[right]
            parts[right] = None
            after[i] = after[right]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [(ids.get(p, -1), at, at + len(p)) for at, p in enumerate(parts) if p is not None]

    # Decoding

    def decode(self, ids) -> str:
        m, out, raw = self.model, [], bytearray()
        ids = np.asarray(ids, np.int64)
        if self._plain[ids].all():
            text = "".join(map(self._shown.__getitem__, ids.tolist()))
            return text[1:] if m.prefix and text.startswith(" ") else text
        for i in ids.tolist():
            if m.kinds[i] == BYTE:
                raw.append(int(m.pieces[i][3:5], 16))
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if m.kinds[i] == UNKNOWN:
                out.append(" ⁇ ")
            elif m.kinds[i] != CONTROL:
                out.append(m.pieces[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out)
        if m.escape:
            text = text.replace(MARK, " ")
        return text[1:] if m.prefix and text.startswith(" ") else text

    def same(self, ids: list[np.ndarray], texts: list[str | None]) -> np.ndarray:
        """Whether each array of ids decodes to its text (null: empty). Ids that all are plain pieces are decoded in columns."""
        edges = np.r_[0, np.cumsum([len(i) for i in ids])]
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        odd = np.flatnonzero(~self._plain[flat])
        made = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), self._texts.take(pa.array(flat))), "")
        want = pa.array([t or "" for t in texts], pa.string())
        if self.model.prefix:  # one leading space does not count
            made_so = pc.starts_with(made, " ")
            want = pc.if_else(made_so, pc.binary_join_element_wise("", want, " "), want)
        out = pc.equal(made, want).to_numpy(zero_copy_only=False).copy()
        for i in np.unique(np.searchsorted(edges, odd, side="right") - 1).tolist():
            out[i] = self.decode(ids[i]) == (texts[i] or "")
        return out


def encode(docs: DataFrame, model: str, text: str = "text") -> Column:
    """Struct (ids array, n_pieces, ids_crc32, round_trip) for a text column."""
    bound_batches(docs.sparkSession, "4m")

    @F.pandas_udf("ids array<int>, n_pieces long, ids_crc32 long, round_trip boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        made = load(model)
        ids, trip = [], np.zeros(len(texts), bool)
        for lo in range(0, len(texts), SOME):
            some = texts.iloc[lo : lo + SOME].tolist()
            ids += made.encode_all(some)
            trip[lo : lo + SOME] = made.same(ids[lo:], some)
        return pd.DataFrame({"ids": ids, "n_pieces": [len(i) for i in ids], "ids_crc32": [zlib.crc32(i.astype("<u4").tobytes()) for i in ids], "round_trip": trip})

    return run(F.col(text))


def decode(df: DataFrame, model: str, ids: str = "ids") -> Column:
    """The text of an id column; null ids give the empty text."""
    bound_batches(df.sparkSession)

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        made = load(model)
        return pd.Series([made.decode([] if r is None else list(r)) for r in rows])

    return run(F.col(ids))


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, n_pieces, ids_crc32, round_trip), a row for each document."""
    return docs.select("doc_id", encode(docs, model).alias("_e")).select("doc_id", "_e.*")
