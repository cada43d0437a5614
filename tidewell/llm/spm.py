"""SentencePiece encoding and decoding by a batched numpy Viterbi.

A text is cut into units that no piece can cross. Units of equal length advance together: substring hashes of all lengths are
probed in the sorted hashes of the pieces, and vectorised maxima over the piece lengths store back-pointers.

For a unigram model the maximum is over the sums of scores. For a BPE model it is over the one segmentation that merging gives:
a sequence of pieces is what merging makes of its text if and only if every two neighbours stay apart when they are merged
alone, so the best path to a place ends in the one piece that is compatible with the best path before it. A character without a
piece becomes its UTF-8 bytes, so that every text survives a round trip.

Texts of any length are encoded whole: units are short, but for words that no border cuts, which take a step for each character and piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, others, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN = 10.0
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Units kept with their ids in a Python worker and their characters, characters and cells of a table taken on at a time, and the length from which units are cut.
CACHED, CHARS, CHUNK, CELLS, LONG = 320_000, 12_000_000, 1_000_000, 60_000, 48
#: Words longer than this are segmented one by one; lots of them would be too few to share the steps.
ALONE = 4096
UNIT = re.compile(r"\n[^ \n]*| +[^ \n]*")


class Pieces:
    """A SentencePiece vocabulary: what is needed to probe substrings. A blank stands for the vocabulary's own space mark."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=model)
        n = len(sp)
        self.scores = np.array([sp.get_score(i) for i in range(n)], dtype=np.float64)
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        texts = {i: sp.id_to_piece(i).replace("▁", " ") for i in normal}
        self.bytes = [b""] * n
        for i, t in texts.items():
            self.bytes[i] = t.encode()
        self.byte_id = np.full(256, -1, dtype=np.int32)
        for i in range(n):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_id[b], self.bytes[i] = i, bytes([b])
        self.n_bytes = np.array(list(map(len, self.bytes)), dtype=np.int64)
        self.normal = np.array(normal, dtype=np.int32)
        self.unknown_score = float(self.scores[normal].min()) - UNKNOWN
        by_len: dict[int, list[int]] = {}
        for i, t in texts.items():
            by_len.setdefault(len(t), []).append(i)
        self.longest = max(by_len)
        self.power = [np.uint64(pow(int(BASE), k, 1 << 64)) for k in range(self.longest + 1)]
        self.tables = {}
        for length, ids in by_len.items():
            codes = self.codes([texts[i] for i in ids])
            keys = self.hashes(codes)[:, -1]
            order = np.argsort(keys)
            self.tables[length] = (keys[order], np.array(ids, dtype=np.int32)[order], codes[order])
        if any(" " in t.lstrip(" ") or "\n" in t for t in texts.values()):
            raise ValueError("pieces that hold a line end, or a blank after something else, are not supported")
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        self.merging = spec.trainer_spec.model_type == 2
        if self.merging:
            self._splits(texts)
        self.inner = {t[k : k + 2] for t in texts.values() for k in range(len(t) - 1)}

    def _splits(self, texts: dict[int, str]) -> None:
        """What merging needs: each piece's rank, hash and the two pieces that its last merge joins (itself twice: one character; -1: merging never makes it)."""
        ids, n = {t: i for i, t in texts.items()}, len(self.scores)
        self.rank = np.full(n, 1 << 30, dtype=np.int64)
        self.rank[sorted(texts, key=lambda i: -self.scores[i])] = np.arange(len(texts))
        self.size, self.hash = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.uint64)
        self.left, self.right = np.full(n, -1, dtype=np.int32), np.full(n, -1, dtype=np.int32)
        for length, (keys, own, _) in self.tables.items():
            self.size[own], self.hash[own] = length, keys
        self.all_hashes = np.sort(self.hash[list(texts)])
        self.all_ids = np.array(sorted(texts, key=lambda i: self.hash[i]), dtype=np.int32)
        self.powers = np.array([pow(int(BASE), k, 1 << 64) for k in range(self.longest + 1)], dtype=np.uint64)
        self.memo, self.memo_said = np.full(1 << 20, -1, dtype=np.int64), np.zeros(1 << 20, dtype=bool)
        rank = self.rank.tolist()
        self.texts, self.rank_of = texts, {t: rank[i] for i, t in texts.items()}
        for i, t in texts.items():
            if len(t) == 1:
                self.left[i] = self.right[i] = i
                continue
            parts = list(t)
            while len(parts) > 2:
                best = min(((rank[m], k) for k in range(len(parts) - 1) if (m := ids.get(parts[k] + parts[k + 1])) is not None), default=None)
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            if len(parts) == 2 and parts[0] in ids and parts[1] in ids:
                self.left[i], self.right[i] = ids[parts[0]], ids[parts[1]]
        for length, (_, own, _) in self.tables.items():  # blanks alone are dealt with apart
            self.left[[i for i in own if length > 1 and not texts[int(i)].strip(" ")]] = -1

    def _joined_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the piece that a and b make together; 1 << 30 if there is none."""
        size = self.size[a] + self.size[b]
        key = self.hash[a] * self.powers[np.minimum(self.size[b], self.longest)] + self.hash[b]
        at = np.minimum(np.searchsorted(self.all_hashes, key), len(self.all_ids) - 1)
        found = self.all_ids[at]
        return np.where((self.all_hashes[at] == key) & (self.size[found] == size), self.rank[found], 1 << 30)

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of a and b leaves a and b: no earlier merge crosses the border.

        Undoes the merges inside both, the latest first; what then touches the border must not have merged before them.
        """
        out = np.ones(len(a), dtype=bool)
        rows, a, b = np.arange(len(a)), a.copy(), b.copy()
        until = np.full(len(a), 1 << 30, dtype=np.int64)
        while len(rows):
            crossed = self._joined_rank(a, b) < until
            out[rows[crossed]] = False
            ra, rb = np.where(self.size[a] > 1, self.rank[a], -1), np.where(self.size[b] > 1, self.rank[b], -1)
            go = ~crossed & ((ra >= 0) | (rb >= 0))
            undo_a = ra > rb  # of equal merges the left one came first, and so is undone last
            until = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            rows, a, b, until = rows[go], a[go], b[go], until[go]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_apart, with a memo of fixed size."""
        key = a.astype(np.int64) * len(self.scores) + b
        slot = ((key.astype(np.uint64) * BASE) >> np.uint64(44)).astype(np.int64)
        known = self.memo[slot] == key
        out = self.memo_said[slot]
        if not known.all():
            new, back = np.unique(key[~known], return_inverse=True)
            said = self._apart((new // len(self.scores)).astype(np.int32), (new % len(self.scores)).astype(np.int32))
            out[~known] = said[back]
            slot = ((new.astype(np.uint64) * BASE) >> np.uint64(44)).astype(np.int64)
            # of two new keys with one slot numpy keeps the last in both arrays
            self.memo[slot], self.memo_said[slot] = new, said
        return out

    @staticmethod
    def codes(words: list[str]) -> np.ndarray:
        """Code points of words of equal length, a row each."""
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), -1)

    @staticmethod
    def hashes(codes: np.ndarray) -> np.ndarray:
        """Polynomial hashes of all prefixes, modulo 2**64."""
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
        for k in range(codes.shape[1]):
            out[:, k + 1] = out[:, k] * BASE + codes[:, k] + np.uint64(1)
        return out

    def hits(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """By length, (rows, places, pieces) of the pieces that start there. Hash hits are compared with the piece."""
        size, prefix = codes.shape[1], self.hashes(codes)
        for length, (keys, ids, spelled) in self.tables.items():
            if length > size:
                continue
            part = prefix[:, length:] - prefix[:, :-length] * self.power[length]
            at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
            rows, cols = np.nonzero(keys[at] == part)
            own = at[rows, cols]
            same = np.ones(len(rows), dtype=bool)
            for k in range(length):
                same &= codes[rows, cols + k] == spelled[own, k]
            yield length, rows[same], cols[same], ids[own[same]]

    def probe(self, codes: np.ndarray) -> dict[int, np.ndarray]:
        """By length, the piece that starts at each place of each row, or -1."""
        found = {length: np.full((codes.shape[0], codes.shape[1] - length + 1), -1, dtype=np.int32) for length in self.tables if length <= codes.shape[1]}
        for length, rows, cols, ids in self.hits(codes):
            found[length][rows, cols] = ids
        return found

    @staticmethod
    def keys(text: str) -> list[str]:
        """The units of a text led by a blank: each begins with a line end or with blanks, of which the key leaves out the first. No piece crosses units."""
        out = text.replace("\n", " \n").split(" ")
        if "" in out:
            out = [u[1:] if u[0] == " " else u for u in UNIT.findall(" " + text)] if text else []
        return out

    @staticmethod
    def unit(key: str) -> str:
        return key if key[:1] == "\n" else " " + key

    def _cut(self, unit: str) -> Iterator[str]:
        start = 0
        for k in range(1, len(unit)):
            if unit[k - 1 : k + 1] not in self.inner:
                yield unit[start:k]
                start = k
        yield unit[start:]

    def best(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, numbers of ids) of some words of equal length."""
        if not self.merging:
            return self.viterbi(words)
        if not any(w[:2] == "  " for w in words):
            return self.viterbi(words)
        runs = [len(w) - len(w.lstrip(" ")) for w in words]
        # Blanks join last, from the left, each time as many as the longest run among the pieces; the last may have joined the word.
        blanks = {len(t): i for i in self.normal.tolist() if not (t := self.bytes[i].decode()).strip(" ")}
        out = []
        for w, run in zip(words, runs):
            own = self.viterbi([w[max(run - 1, 0) :]])[0]
            if run:
                alone = blanks.get(1) == own[0]
                run, own = (run, own[1:]) if alone else (run - 1, own)
                lead = []
                while run:
                    step = max(k for k in blanks if k <= run)
                    lead.append(blanks[step])
                    run -= step
                own = np.concatenate([lead, own]).astype(np.int32)
            out.append(own)
        return np.concatenate(out), np.array([len(o) for o in out])

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, numbers of ids) of the best segmentations of some words of equal length; of equal ones, that with the longest last pieces."""
        codes = self.codes(words)
        if not self.merging:
            last, back = self._scored(codes)
        elif codes.shape[1] > ALONE:
            last, back = (np.stack(x) for x in zip(*[self._merged_alone(codes[k : k + 1]) for k in range(len(words))]))
        else:
            last, back = self._merged(codes)
        return self._traced(words, last, back)

    def _scored(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last piece or -1, its length) at each end, for the greatest sum of scores."""
        (n, size), found = codes.shape, self.probe(codes)
        score = {length: np.where(ids >= 0, self.scores[ids], -np.inf) for length, ids in found.items()}
        if 1 not in score:
            score[1], found[1] = np.full((n, size), -np.inf), np.full((n, size), -1, dtype=np.int32)
        score[1] = np.where(found[1] >= 0, score[1], self.unknown_score)
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        last, back = np.full((n, size + 1), -1, dtype=np.int32), np.zeros((n, size + 1), dtype=np.int32)
        for j in range(1, size + 1):
            for length in sorted((k for k in score if k <= j), reverse=True):
                sums = best[:, j - length] + score[length][:, j - length]
                more = sums > best[:, j]
                best[more, j], back[more, j], last[more, j] = sums[more], length, found[length][more, j - length]
        return last, back

    def _merged_hits(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, end, length, piece) of all pieces that merging can make and, as -1, of characters without one, by end and then length."""
        n, size = codes.shape
        bare = np.ones((n, size), dtype=bool)
        parts = []
        for length, rows, cols, ids in self.hits(codes):
            if length == 1:
                bare[rows, cols] = False
            else:
                made = self.left[ids] >= 0
                rows, cols, ids = rows[made], cols[made], ids[made]
            parts.append((rows, cols + length, np.full(len(rows), length), ids))
        rows, cols = np.nonzero(bare)
        parts.append((rows, cols + 1, np.ones(len(rows), dtype=np.int64), np.full(len(rows), -1, dtype=np.int32)))
        row, end, length, piece = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(end * (self.longest + 1) + length, kind="stable")
        return row[order], end[order], length[order], piece[order]

    def _merged(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last piece or -1, its length) at each end, for the segmentation whose neighbours all stay apart. All rows take a step together."""
        n, size = codes.shape
        row, end, length, piece = self._merged_hits(codes)
        last, back = np.full((n, size + 1), -1, dtype=np.int32), np.zeros((n, size + 1), dtype=np.int32)
        bounds = np.searchsorted(end, np.arange(1, size + 2))
        for j, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()), 1):
            rows, sizes, own = row[a:b], length[a:b], piece[a:b]
            before = last[rows, j - sizes]
            ask = np.flatnonzero((before >= 0) & (own >= 0))
            can = np.ones(len(rows), dtype=bool)
            can[ask] = self.compatible(before[ask], own[ask])
            rows, sizes, own = rows[can], sizes[can], own[can]
            back[rows, j], last[rows, j] = sizes, own  # of several for a row the longest, which comes last
        return last, back

    def _merged_alone(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """_merged() for a single row too long for steps in numpy: the same recursion over plain numbers."""
        _, end, length, piece = self._merged_hits(codes)
        size = codes.shape[1]
        last, back, known = [-1] * (size + 1), [0] * (size + 1), {}
        for j, k, own in zip(end.tolist(), length.tolist(), piece.tolist()):
            before = last[j - k]
            if own >= 0 and before >= 0:
                can = known.get((before, own))
                if can is None:
                    can = known[before, own] = self._apart_alone(before, own)
                if not can:
                    continue
            last[j], back[j] = own, k
        return np.array(last, dtype=np.int32), np.array(back, dtype=np.int32)

    def _apart_alone(self, a: int, b: int) -> bool:
        """_apart() for one pair."""
        until = 1 << 30
        while True:
            if self.rank_of.get(self.texts[a] + self.texts[b], 1 << 30) < until:
                return False
            ra, rb = (self.rank_of[self.texts[x]] if len(self.texts[x]) > 1 else -1 for x in (a, b))
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                until, a = ra, int(self.right[a])
            else:
                until, b = rb + 1, int(self.left[b])

    def _traced(self, words: list[str], last: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, numbers of ids) along the back-pointers from the ends of the words."""
        n, size = len(words), len(words[0])
        used = np.zeros((n, size + 1), dtype=bool)
        used[:, size] = True
        if size > ALONE:
            for row, steps in zip(used, back):
                at, steps = size, steps.tolist()
                while at:
                    row[at] = True
                    at -= steps[at]
        else:
            rows, at = np.arange(n), np.full(n, size)
            while len(rows):
                used[rows, at] = True
                at = at - back[rows, at]
                rows, at = rows[at > 0], at[at > 0]
        used[:, 0] = False
        row, end = np.nonzero(used)
        flat, sizes = last[row, end], used.sum(axis=1)
        if (flat < 0).any():  # characters without a piece become bytes
            unknown = np.flatnonzero(flat < 0)
            spelled = [self.byte_id[list(words[r][e - 1].encode("utf-8", "surrogatepass"))] for r, e in zip(row[unknown].tolist(), end[unknown].tolist())]
            more = np.array([len(b) for b in spelled])
            np.add.at(sizes, row[unknown], more - 1)
            times = np.ones(len(flat), dtype=np.int64)
            times[unknown] = more
            flat = np.repeat(flat, times)
            flat[flat < 0] = np.concatenate(spelled)
        return flat, sizes


@lru_cache(maxsize=2)
def pieces_of(model: bytes) -> Pieces:
    """A worker reads a vocabulary once."""
    return Pieces(model)


def by_length(words: list[str]) -> Iterator[list[int]]:
    """Positions of words of equal length, in lots of at most CELLS characters or a single word."""
    sizes: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        sizes.setdefault(len(w), []).append(k)
    for size, own in sizes.items():
        step = max(1, CELLS // size)
        for at in range(0, len(own), step):
            yield own[at : at + step]


class _Known(dict):
    """Numbers for keys; those of new keys are given on the way, and the keys noted."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        self[key] = at = len(self)
        return at


class Encoder:
    """Encodes texts in a Python worker. Keeps the ids of the units it has met; beyond CACHED of them, or CHARS characters, only the more used stay."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.known = _Known()
        self.flat = np.zeros(0, dtype=np.int32)
        #: by unit: where its ids begin and how many they are, its characters, whether its ids spell it, and how often it was used
        self.start, self.size, self.chars, self.uses = (np.zeros(0, dtype=np.int64) for _ in range(4))
        self.spelled = np.zeros(0, dtype=bool)

    def _learn(self, keys: list[str]) -> None:
        units = list(map(self.pieces.unit, keys))
        chars = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        size, start, at = np.zeros(len(units), dtype=np.int64), np.zeros(len(units), dtype=np.int64), len(self.flat)
        flat, short = [self.flat], np.flatnonzero(chars <= LONG)
        for lot in by_length([units[k] for k in short]):
            own = short[lot]
            ids, n = self.pieces.best([units[k] for k in own])
            size[own], start[own] = n, at + np.cumsum(n) - n
            flat.append(ids)
            at += len(ids)
        for k in np.flatnonzero(chars > LONG).tolist():
            parts = list(self.pieces._cut(units[k]))
            got: list = [None] * len(parts)
            for lot in by_length(parts):
                ids, n = self.pieces.best([parts[j] for j in lot])
                for j, own in zip(lot, np.split(ids, np.cumsum(n)[:-1])):
                    got[j] = own
            flat.append(np.concatenate(got))
            size[k], start[k] = len(flat[-1]), at
            at += len(flat[-1])
        self.flat = np.concatenate(flat)
        spelled = self._spelled(units, start, size)
        self.start, self.size = np.concatenate([self.start, start]), np.concatenate([self.size, size])
        self.chars = np.concatenate([self.chars, chars])
        self.uses = np.concatenate([self.uses, np.zeros(len(units), dtype=np.int64)])
        self.spelled = np.concatenate([self.spelled, spelled])

    def _spelled(self, units: list[str], start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether decoding a unit's ids gives the unit."""
        piece, first = self.pieces.bytes.__getitem__, int(start.min())
        whole, new, begin, end = [u.encode("utf-8", "surrogatepass") for u in units], self.flat[first:], start - first, start + size - first
        if b"".join(map(piece, new.tolist())) == b"".join([whole[k] for k in np.argsort(start, kind="stable").tolist()]):
            upto = np.concatenate(([0], np.cumsum(self.pieces.n_bytes[new])))
            if (upto[end] - upto[begin] == np.fromiter(map(len, whole), dtype=np.int64, count=len(whole))).all():
                return np.ones(len(units), dtype=bool)
        return np.array([b"".join(map(piece, new[a:b].tolist())) == u for u, a, b in zip(whole, begin.tolist(), end.tolist())], dtype=bool)

    def _forget(self) -> None:
        order = np.lexsort((self.chars, -self.uses))
        keep = np.sort(order[: CACHED // 2])
        keep = keep[np.cumsum(self.chars[keep]) <= CHARS // 2]
        keys = list(self.known)
        self.known = _Known()
        self.known.update((keys[k], n) for n, k in enumerate(keep.tolist()))
        size = self.size[keep]
        ends = np.cumsum(size)
        self.flat = self.flat[np.repeat(self.start[keep] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        self.start, self.size, self.chars, self.spelled, self.uses = ends - size, size, self.chars[keep], self.spelled[keep], self.uses[keep] // 2

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offsets, ids, whether decoding gives the text back) of some texts.

        A text's units follow one another, so it is given back if each unit is and their characters are as many as the text's and the leading blank.
        """
        if len(self.known) > CACHED or self.chars.sum() > CHARS:
            self._forget()
        keys = [self.pieces.keys(t) for t in texts]
        counts = np.cumsum([0, *map(len, keys)])
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(keys)), dtype=np.int64, count=counts[-1])
        del keys
        if self.known.new:
            new, self.known.new = self.known.new, []
            self._learn(new)
        self.uses += np.bincount(at, minlength=len(self.uses))
        total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[counts])
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.start[at] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        lengths = np.array([len(t) + (t != "") for t in texts], dtype=np.int64)
        return np.concatenate(([0], ends))[counts], ids, (total(self.spelled[at]) == np.diff(counts)) & (total(self.chars[at]) == lengths)


@lru_cache(maxsize=1)
def encoder_of(model: bytes) -> Encoder:
    """A worker keeps what it has learned from task to task."""
    return Encoder(pieces_of(model))


def chunks(batch: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch, some CHUNK characters at a time; null: empty."""
    own, size = [], 0
    for value in batch:
        own.append(value.as_py() or "")
        size += len(own[-1])
        if size > CHUNK:
            yield own
            own, size = [], 0
    if own:
        yield own


def read_model(spark: SparkSession, path: str = MODEL) -> bytes:
    """The vocabulary file, read by the driver (under 1 MB); executors get it with the tasks."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()


def _decoded(ids: np.ndarray, spelled) -> str:
    text = b"".join(map(spelled, ids.tolist())).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def encode(col: Column, model: bytes) -> Column:
    """struct<ids: array<int>, round_trip: boolean>: piece ids, and whether decoding them gives the text back. Null and empty texts: an empty array."""

    @F.arrow_udf("struct<ids: array<int>, round_trip: boolean>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = encoder_of(model)
        for batch in batches:
            for texts in chunks(batch):
                offsets, ids, same = encoder.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32, copy=False)))
                yield pa.StructArray.from_arrays([lists, pa.array(same, pa.bool_())], ["ids", "round_trip"])

    return run(col)


def decode(col: Column, model: bytes) -> Column:
    """The text of piece ids, without the leading blank that encoding adds. Null: null; control and unknown pieces: nothing."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        spelled = pieces_of(model).bytes.__getitem__
        for batch in batches:
            yield pa.array([_decoded(v.values.to_numpy(zero_copy_only=False), spelled) if v.is_valid else None for v in batch], pa.string())

    return run(col)


RESULTS = ["ids", "n_tokens", "round_trip"]


def encoded(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """docs with ids, n_tokens and round_trip (decoding gives the text back); columns of those names are replaced. Rows are encoded one by one, so repeated rows
    are alike; no rows: no rows."""
    (own,) = fresh(docs, "encoded")
    out, e = docs.withColumn(own, encode(F.col(text_col), model)), F.col(own)
    return out.select(*others(docs, RESULTS), e["ids"].alias("ids"), F.size(e["ids"]).cast("long").alias("n_tokens"), e["round_trip"].alias("round_trip"))


def op1(spark: SparkSession, sf_dir: str, model_path: str = MODEL) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), read_model(spark, model_path)).select("doc_id", "n_tokens", "ids", "round_trip")
