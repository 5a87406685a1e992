"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

Byte-pair encoding by an agenda: adjacent pairs whose union is a piece wait in a priority queue, best score first and leftmost among equals;
a pair that comes up is merged unless a keyed hash of (seed, document, word's place in it, span) says to skip it, which drops that candidate: every
occurrence of a word draws for itself. With dropout 0 the ids are SentencePiece's own. No piece of such a vocabulary crosses into a word's leading space
marks (this is checked), so words are encoded apart.

A slice of texts is one array of symbols, and its words are ranges of it. A word that occurs once in the slice is merged with its own draws. One that
repeats is first merged without dropping anything, which gives the candidates that come up; an occurrence that drops none of them ends in the same ids,
and only the others are merged with their own draws. Words are merged many together, each taking the best of its agenda in step with the others; words
of more than WIDTH symbols are merged alone, by a heap. All ways give what the agenda gives for that occurrence.

A symbol that no piece knows never merges and falls back to its bytes. So does a literal space mark in a text, which SentencePiece would turn into a
space: decoding gives the text back to the byte for every seed and rate.

Nulls and odd cases: a null text has null ids and null counts, an empty one none; texts of any length are encoded whole; repeated rows give repeated
results (draws follow from seed, doc_id and place); a null doc_id keys as 0; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mix, slices

MARK = "▁"
#: Words of up to WIDTH symbols are merged TOGETHER at a time; a place in such a word takes PLACE bits.
WIDTH, TOGETHER, PLACE = 48, 1 << 14, 6
NONE = np.iinfo(np.int32).max
_ALL = (1 << 64) - 1
#: A pair of symbols is one number; symbols are pieces and, after them, code points that no piece has.
_PAIR, _FREE = 21, np.iinfo(np.int64).min
_STEP = np.uint64(0x9E3779B97F4A7C15)
_models: dict[str, Model] = {}


def _mixed(h):
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & _ALL
    h = (h ^ h >> 27) * 0x94D049BB133111EB & _ALL
    return h ^ h >> 31


def occurrence_key(seed: int, doc: int, place):
    """Key of the draws of the word at a place, or places, of a document; a number or an array of uint64."""
    return _mixed(_mixed(place ^ _mixed(doc & _ALL)) ^ seed * 0x9E3779B97F4A7C15 & _ALL)


def drawn(span, key):
    """A keyed 32-bit hash of a candidate, start << 32 | end in its word; numbers or arrays of uint64."""
    return _mixed(key + (span * 0xC2B2AE3D27D4EB4F & _ALL) & _ALL) >> 32


def spread(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... n[0] of them, then those of at[1], and so on."""
    return np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Model:
    """Pieces and scores of a byte-fallback BPE model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.ids: dict[str, int] = {}
        #: What each id stands for in a text.
        self.raw: list[bytes] = []
        self.bytes = np.zeros(256, dtype=np.int32)
        score: dict[str, float] = {}
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            else:
                self.raw.append(piece.replace(MARK, " ").encode("utf-8", "surrogatepass"))
                if not sp.is_control(i) and not sp.is_unknown(i):
                    self.ids[piece], score[piece] = i, sp.get_score(i)
        if crossing := [p for p in self.ids if re.search(f"[^{MARK}]{MARK}", p)]:
            raise ValueError(f"pieces cross into the next word: {crossing[:3]}")
        if MARK not in self.ids or sum(sp.is_byte(i) for i in range(size)) != 256:
            raise ValueError("the model has no space mark or no byte fallback")
        place = {x: r for r, x in enumerate(sorted(set(score.values()), reverse=True))}
        #: Rank of each piece's score, the best 0; equal scores have equal ranks. The last entry is that of no piece.
        self.rank = np.full(size + 1, NONE, dtype=np.int32)
        self.first_free = size
        self.symbol = np.arange(size, size + 0x110000, dtype=np.int32)
        for p, i in self.ids.items():
            self.rank[i] = place[score[p]]
            if len(p) == 1 and p != MARK:
                self.symbol[ord(p)] = i
        self.mark = self.symbol[0x20] = self.ids[MARK]
        self.code = np.where(self.rank < NONE, self.rank << PLACE, NONE).astype(np.int32)
        #: Union of each pair of pieces that makes one.
        self.pairs = {self.ids[p[:k]] << _PAIR | self.ids[p[k:]]: i for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        self._fill()
        self.raw_all = np.frombuffer(b"".join(self.raw), dtype=np.uint8)
        self.raw_n = np.array([len(r) for r in self.raw], dtype=np.int64)
        self.raw_at = np.cumsum(self.raw_n) - self.raw_n
        self.salt = mix(np.arange(1, size + 0x110001, dtype=np.uint64))

    def _fill(self) -> None:
        """The pairs again, in a table of open addressing for arrays."""
        bits = max(8, (4 * len(self.pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.unions = np.full(1 << bits, _FREE, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int32)
        key, union = np.fromiter(self.pairs.keys(), np.int64, len(self.pairs)), np.fromiter(self.pairs.values(), np.int32, len(self.pairs))
        slot = self._slot(key)
        while len(key):
            at = np.flatnonzero(self.keys[slot] == _FREE)
            where, first = np.unique(slot[at], return_index=True)
            self.keys[where], self.unions[where] = key[at[first]], union[at[first]]
            left = np.ones(len(key), dtype=bool)
            left[at[first]] = False
            key, union, slot = key[left], union[left], slot[left] + 1 & (1 << bits) - 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * _STEP >> self.shift).view(np.int64)

    def union_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Piece that symbols a and b make, -1 if none."""
        want = a.astype(np.int64) << _PAIR | b
        slot = self._slot(want)
        met = self.keys[slot]
        out = np.where(met == want, self.unions[slot], -1)
        todo = np.flatnonzero((met != want) & (met != _FREE))
        slot = slot[todo]
        while len(todo):
            slot = slot + 1 & len(self.keys) - 1
            met, wanted = self.keys[slot], want[todo]
            hit = met == wanted
            out[todo[hit]] = self.unions[slot[hit]]
            on = ~hit & (met != _FREE)
            todo, slot = todo[on], slot[on]
        return out

    def symbols(self, text: str) -> np.ndarray:
        """A text's symbols, the space mark before it included."""
        return self.symbol[np.frombuffer((" " + text if text else "").encode("utf-32-le", "surrogatepass"), dtype="<u4")]

    def merge(self, word: list[int], limit: int, key: int) -> list[int]:
        """Symbols that one occurrence of a word ends in. A part is named by where it starts; end has where it ends, 0 once it is merged away."""
        n, rank, union = len(word), self.rank, self.pairs.get
        part, end, before = list(word), list(range(1, n + 1)), list(range(-1, n - 1))
        # a candidate is its rank, start and end
        agenda = [(int(rank[u]), i, i + 2) for i in range(n - 1) if (u := union(word[i] << _PAIR | word[i + 1])) is not None]
        heapify(agenda)
        while agenda:
            _, i, e = heappop(agenda)
            m = end[i]
            if not m or m >= e or end[m] != e:
                continue
            if limit and drawn(i << 32 | e, key) < limit:
                continue
            part[i] = union(part[i] << _PAIR | part[m])
            end[i], end[m] = e, 0
            if e < n:
                before[e] = i
                if (u := union(part[i] << _PAIR | part[e])) is not None:
                    heappush(agenda, (int(rank[u]), i, end[e]))
            if (b := before[i]) >= 0 and (u := union(part[b] << _PAIR | part[i])) is not None:
                heappush(agenda, (int(rank[u]), b, e))
        return [part[i] for i in range(n) if end[i]]

    def _together(self, all_symbols: np.ndarray, start: np.ndarray, size: np.ndarray, keys: np.ndarray | None, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """merge for many words of at most WIDTH symbols: what they end in and how many each has; and, without keys, the spans that come up and how many.

        Arrays are (place in a word, word). A candidate is rank and place in one number, so that the least of a word's is its next.
        """
        total, width = len(start), int(size.max())
        row = np.arange(total)
        at = np.arange(width)[:, None]
        part = np.where(at < size, all_symbols[np.minimum(start + at, len(all_symbols) - 1)], -1)
        done = part
        end = np.repeat(at + 1, total, axis=1).astype(np.int32)
        before = end - 2
        union = np.full((width, total), -1, dtype=np.int32)
        union[:-1] = self.union_of(part[:-1].ravel(), part[1:].ravel()).reshape(width - 1, total)
        next_up = self.code[union] | at.astype(np.int32)
        met_rows, met_spans = [], []
        while len(row):
            n = len(row)
            best = next_up.min(axis=0)
            go = np.flatnonzero(best < NONE)
            if 2 * len(go) < n:
                if done is not part:
                    done[:, row] = part
                row, size, best = row[go], size[go], best[go]
                part, end, before, union, next_up = (np.take(x, go, axis=1) for x in (part, end, before, union, next_up))
                keys = keys if keys is None else keys[go]
                n, go = len(row), np.arange(len(row))
                if not n:
                    break
            _part, _end, _before, _union, _next = (x.reshape(-1) for x in (part, end, before, union, next_up))
            i = (best[go] & (1 << PLACE) - 1).astype(np.int64)
            p = i * n + go
            q = _end[p] * n + go
            e = _end[q].astype(np.int64)
            spans = (i << 32 | e).view(np.uint64)
            if keys is None:
                met_rows.append(row[go])
                met_spans.append(spans)
            elif limit:
                drop = drawn(spans, keys[go]) < limit
                _next[p[drop]] = NONE
                keep = ~drop
                go, i, p, q, e = (x[keep] for x in (go, i, p, q, e))
            new = _union[p]
            _part[p], _end[p], _part[q] = new, e, -1
            _next[p] = _next[q] = NONE
            r = np.flatnonzero(e < size[go])
            z = e[r] * n + go[r]
            _before[z] = i[r]
            b = _before[p]
            left = np.flatnonzero(b >= 0)
            y = b[left] * n + go[left]
            x = np.concatenate((p[r], y))
            u = self.union_of(np.concatenate((new[r], _part[y])), np.concatenate((_part[z], new[left])))
            _union[x] = u
            _next[x] = self.code[u] | np.concatenate((i[r], b[left])).astype(np.int32)
        kept = done.T >= 0
        none = np.zeros(0, dtype=np.int64)
        rows = np.concatenate([*met_rows, none])
        path = np.concatenate([*met_spans, none.view(np.uint64)])[np.argsort(rows, kind="stable")]
        return done.T[kept], kept.sum(axis=1), path, np.bincount(rows, minlength=total)

    def _merged(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray, keys: np.ndarray | None, limit: int) -> tuple[np.ndarray, ...]:
        """What the words at start end in, one after the other, and how many each has; without keys, also the spans that come up."""
        short = np.flatnonzero(size <= WIDTH)
        short = short[np.argsort(size[short], kind="stable")]
        many = [short[lo : lo + TOGETHER] for lo in range(0, len(short), TOGETHER)]
        found = [self._together(symbols, start[g], size[g], keys if keys is None else keys[g], limit) for g in many]
        long = np.flatnonzero(size > WIDTH)
        alone = [self.merge(symbols[start[w] : start[w] + size[w]].tolist(), limit, 0 if keys is None else int(keys[w])) for w in long.tolist()]
        words = np.concatenate([*many, long])
        back = np.argsort(words, kind="stable")
        out: list[np.ndarray] = []
        lone = (np.array([x for a in alone for x in a], dtype=np.int32), np.array([len(a) for a in alone], dtype=np.int64), np.zeros(0, np.uint64), np.zeros(len(long), np.int64))
        for flat, n in ((0, 1), (2, 3)):
            all_n = np.concatenate([*(f[n] for f in found), lone[n]])
            at = np.cumsum(all_n) - all_n
            out += [np.concatenate([*(f[flat] for f in found), lone[flat]])[spread(at[back], all_n[back])], all_n[back]]
        return tuple(out)

    def _classes(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word a word equal to it, and how many have that one. Words are told apart by hashes, and then by their symbols."""
        power = np.multiply.accumulate(np.full(int(size.max()), _STEP, dtype=np.uint64))
        h = np.add.reduceat(self.salt[symbols] * power[np.arange(len(symbols)) - np.repeat(start, size)], start)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        of = first[which]
        same = symbols[np.minimum(np.arange(len(symbols)) + np.repeat(start[of] - start, size), len(symbols) - 1)] == symbols
        apart = np.add.reduceat(~same, start) > 0
        apart |= size != size[of]
        of[apart] = np.flatnonzero(apart)
        return of, np.bincount(of, minlength=len(start))

    def encode_all(self, texts: list[str], keys: list[int], rate: float = 0.0, seed: int = 0) -> list[np.ndarray]:
        """Ids of each text; keys name their documents."""
        limit = int(rate * 2**32)
        length = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
        symbols = self.symbol[np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        if not len(symbols):
            return [np.zeros(0, dtype=np.int32) for _ in texts]
        first = np.cumsum(length) - length
        head = symbols == self.mark
        head[1:] &= symbols[:-1] != self.mark
        head[first[length > 0]] = True
        start = np.flatnonzero(head)
        size = np.diff(start, append=len(symbols))
        words = np.diff(np.searchsorted(start, first), append=len(start))  # of each text
        of, n = self._classes(symbols, start, size)
        own = np.repeat(np.array([_mixed(k & _ALL) for k in keys], dtype=np.uint64), words) ^ spread(np.zeros(len(words), np.int64), words).view(np.uint64)
        drawing = _mixed(_mixed(own) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & _ALL))
        shared = np.flatnonzero((n > 1) & (size <= WIDTH)) if limit else np.flatnonzero(n)
        flat, count, path, met = self._merged(symbols, start[shared], size[shared], None, 0)
        row = np.full(len(start), -1)
        row[shared] = np.arange(len(shared))
        row = row[of]
        alone = np.flatnonzero(row < 0)
        if limit:
            some = np.flatnonzero(row >= 0)
            k = met[row[some]]
            spans = path[spread((np.cumsum(met) - met)[row[some]], k)]
            dropped = drawn(spans, np.repeat(drawing[some], k)) < limit
            hit = np.zeros(len(start), dtype=bool)
            hit[np.repeat(some, k)[dropped]] = True
            alone = np.flatnonzero(hit | (row < 0))
        flat_own, count_own, _, _ = self._merged(symbols, start[alone], size[alone], drawing[alone], limit)
        at, many = (np.cumsum(count) - count)[row] if len(count) else np.zeros(len(row), np.int64), count[row] if len(count) else np.zeros(len(row), np.int64)
        at[alone], many[alone] = len(flat) + np.cumsum(count_own) - count_own, count_own
        ids = np.concatenate((flat, flat_own))[spread(at, many)]
        ends = np.concatenate(([0], np.cumsum(many)))[np.concatenate(([0], np.cumsum(words)))]
        ids, ends = self._spelt(ids, ends)
        return np.split(ids, ends[1:-1])

    def _spelt(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids: symbols with those of no piece spelt in bytes, and where texts end then."""
        strange = np.flatnonzero(symbols >= self.first_free)
        if not len(strange):
            return symbols, ends
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in (symbols[strange] - self.first_free).tolist()]
        n = np.ones(len(symbols), dtype=np.int64)
        n[strange] = [len(r) for r in raw]
        out = np.repeat(symbols, n)
        at = np.cumsum(n) - n
        out[spread(at[strange], n[strange])] = self.bytes[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        return out, np.concatenate((at, [len(out)]))[ends]

    def encode(self, text: str, rate: float = 0.0, seed: int = 0, key: int = 0) -> list[int]:
        return self.encode_all([text], [key], rate, seed)[0].tolist()

    def decode_all(self, ids: list[np.ndarray]) -> list[bytes]:
        """UTF-8 of each text."""
        flat = np.concatenate([*ids, np.zeros(0, dtype=np.int32)]).astype(np.int64)
        n = self.raw_n[flat]
        raw = self.raw_all[spread(self.raw_at[flat], n)].tobytes()
        ends = np.concatenate(([0], np.cumsum(n)))[np.cumsum([0, *map(len, ids)])].tolist()
        return [raw[a + 1 : z] for a, z in zip(ends, ends[1:], strict=False)]  # without the space before the text

    def decode(self, ids) -> str:
        return self.decode_all([np.asarray(ids, dtype=np.int64)])[0].decode("utf-8", "surrogatepass")


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _coded(batches, model_path: str, dropout: float, seed: int):
    """(doc_ids, texts, ids of each text, an empty one for null) of slices of batches of doc_id and text."""
    m = model(model_path)
    for b in batches:
        keys, texts = b.column(0).fill_null(0).to_pylist(), b.column(1).to_pylist()
        for lo, hi in slices(texts):
            yield m, b.column(0).slice(lo, hi - lo), texts[lo:hi], m.encode_all([t or "" for t in texts[lo:hi]], keys[lo:hi], dropout, seed)


def _lists(ids: list[np.ndarray], null: list[bool]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)), mask=pa.array(null, pa.bool_()))


def encode(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of each row of docs."""

    def run(batches):
        for _, doc_ids, texts, ids in _coded(batches, model_path, dropout, seed):
            yield pa.RecordBatch.from_arrays([doc_ids, _lists(ids, [t is None for t in texts])], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row of encoded."""

    def run(batches):
        m = model(model_path)
        for b in batches:
            ids = [x.values.drop_null().to_numpy() if x.is_valid else None for x in b.column(1)]
            texts = m.decode_all([np.zeros(0, np.int32) if x is None else x for x in ids])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else t.decode("utf-8", "surrogatepass") for x, t in zip(ids, texts, strict=True)], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_crc32, n_chars and text_crc32 of each row; n_chars and text_crc32 are those of the decoded text. All but doc_id are null for a null text."""

    def run(batches):
        for m, doc_ids, texts, ids in _coded(batches, model_path, dropout, seed):
            back = m.decode_all(ids)
            cols = (map(len, ids), (zlib.crc32(x.astype("<u4").tobytes()) for x in ids), (len(r.decode("utf-8", "surrogatepass")) for r in back), map(zlib.crc32, back))
            cols = [pa.array([None if t is None else x for t, x in zip(texts, c, strict=True)], pa.int64()) for c in cols]
            yield pa.RecordBatch.from_arrays([doc_ids, *cols], ["doc_id", "n_pieces", "ids_crc32", "n_chars", "text_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, n_chars long, text_crc32 long")
