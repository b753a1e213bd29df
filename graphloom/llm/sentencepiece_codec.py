"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

The vocabulary is read from a model file on the driver and sent to the workers. A text gets one space in front and is cut before each run of
spaces that follows other characters; no piece spans such a cut (checked when the model is read), so the cut parts are encoded one by one. A part of over LONG
characters is cut again between characters that no piece holds side by side. In a part the
agenda holds adjacent pairs that form a piece, best score first and leftmost of equals; a pair that comes up is skipped if a keyed hash of (seed, document,
the part's number in it, place in the part, piece) falls below the dropout rate. So each occurrence of a word is segmented anew, and reruns agree. What
does not depend on the occurrence is kept by each worker: a part's pieces without skips, and the merges on the way to them. An occurrence that
skips none of those merges has those pieces; the others are segmented one by one. Characters outside the vocabulary (the
space mark itself among them) become byte pieces, so decoding gives back the text byte by byte.

Defined results: null or empty text has no pieces and decodes to ""; equal (id, text) rows are encoded alike; very long texts are encoded part by
part (a stretch in which pieces hold every two neighbours is walked as one, in memory proportional to it); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import lean, mix, quoted, short_batches, slices, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: A worker forgets what it has worked out beyond so many parts.
KEPT, KEPT_CHARACTERS = 200_000, 1 << 23
#: Parts beyond so many characters are cut where no piece can lie.
LONG = 2048
#: Parts up to so many characters are segmented many at once.
SHORT = 24
#: So many parts are segmented at once.
TOGETHER = 4000
#: The order of a pair that forms no piece, and a slot of the table of pairs that holds none.
LAST, _FREE = 1 << 30, -(1 << 62)
_PART = re.compile(r" *[^ ]+| +")


class Vocabulary:
    """Pieces with the space mark as a space. Plain data: it is sent to workers."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.ids, self.scores, self.raw, self.bytes = {}, [0.0] * n, [b""] * n, [-1] * 256
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text = piece.replace("▁", " ")
                if " " in text.lstrip(" "):
                    raise ValueError(f"a piece spans words: {piece!r}")
                self.ids[text] = i
                self.scores[i] = sp.get_score(i)
                self.raw[i] = text.encode()
        if min(self.bytes) < 0:
            raise ValueError("the model has no byte pieces")


def segment(v: Vocabulary, part: str, dropout: float, key: int, merges: list[tuple[int, int]] | None = None) -> list[int]:
    """Ids of one part by agenda processing; candidate merges are skipped by a hash under the occurrence's key. What is merged, as (place, piece), is added to merges."""
    ids, scores = v.ids, v.scores
    if not dropout and part in ids and len(part) == 1:
        return [ids[part]]
    piece = list(part)
    n = len(piece)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    right[-1] = -1
    agenda: list[tuple[float, int, int, str]] = []
    for i in range(n - 1):
        both = piece[i] + piece[i + 1]
        if (k := ids.get(both)) is not None:
            agenda.append((-scores[k], i, i + 1, both))
    heapq.heapify(agenda)
    limit = int(dropout * 2**32)
    while agenda:
        _, i, j, both = heapq.heappop(agenda)
        if not piece[i] or not piece[j] or right[i] != j or piece[i] + piece[j] != both:
            continue
        if limit and _word(key, i, ids[both]) < limit:
            continue
        if merges is not None:
            merges.append((i, ids[both]))
        piece[i], piece[j] = both, ""
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b >= 0:
                joined = piece[a] + piece[b]
                if (k := ids.get(joined)) is not None:
                    heapq.heappush(agenda, (-scores[k], a, b, joined))
    out: list[int] = []
    for p in piece:
        if p:
            k = ids.get(p)
            out.extend([k] if k is not None else [v.bytes[x] for x in p.encode("utf-8", "surrogatepass")])
    return out


def _word(key: int, place: int, piece: int) -> int:
    """32 bits that depend on all three."""
    x = (key ^ (place * 0x9E3779B97F4A7C15) ^ (piece * 0xC2B2AE3D27D4EB4F)) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    return (x ^ (x >> 32)) & 0xFFFFFFFF


class Merges:
    """Which two pieces form a third, as a hash table in arrays, to segment many parts at once. A part's symbols are ids; a character outside the vocabulary has none (-1)."""

    def __init__(self, v: Vocabulary):
        found: dict[int, int] = {}
        for text, k in v.ids.items():
            for i in range(1, len(text)):
                a, b = v.ids.get(text[:i]), v.ids.get(text[i:])
                if a is not None and b is not None:
                    found[a << 20 | b] = k
        keys, pieces = np.array(list(found), np.int64), np.array(list(found.values()), np.int32)
        self.bits = max(10, 3 + len(keys).bit_length())
        self.pairs, self.merged = np.full(1 << self.bits, _FREE, np.int64), np.full(1 << self.bits, -1, np.int32)
        slot = self._slot(keys)
        while len(keys):  # who finds its slot taken tries the next one
            first = np.unique(slot, return_index=True)[1]
            first = first[self.pairs[slot[first]] == _FREE]
            self.pairs[slot[first]], self.merged[slot[first]] = keys[first], pieces[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, pieces, slot = keys[rest], pieces[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)
        self.neighbours = np.array(sorted({ord(a) << 21 | ord(b) for text in v.ids for a, b in zip(text, text[1:], strict=False)}), np.int64)
        # the rank by score, best first, leaves room for a place; equal scores share a rank. No piece (-1) comes last
        scores = -np.array(v.scores)
        self.order = np.append(np.searchsorted(np.unique(scores), scores) * 64, LAST).astype(np.int32)
        self.letter = np.full(0x110000, -1, np.int32)
        for text, k in v.ids.items():
            if len(text) == 1:
                self.letter[ord(text)] = k

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that a and b form, or -1. A negative symbol makes a negative key, which no slot has."""
        key = a.astype(np.int64) << 20 | b
        slot = self._slot(key)
        held = self.pairs[slot]
        out = np.where(held == key, self.merged[slot], np.int32(-1))
        on = np.flatnonzero((held != key) & (held != _FREE))
        key, slot = key[on], slot[on]
        while len(on):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            held = self.pairs[slot]
            out[on] = np.where(held == key, self.merged[slot], np.int32(-1))
            more = (held != key) & (held != _FREE)
            on, key, slot = on[more], key[more], slot[more]
        return out


def _skipped(key: np.ndarray, place: np.ndarray, piece: np.ndarray, limit: int) -> np.ndarray:
    """_word() < limit, elementwise."""
    x = key ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (piece.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) & np.uint64(0xFFFFFFFF)) < np.uint64(limit)


def segment_many(v: Vocabulary, m: Merges, parts: Sequence[str], keys: np.ndarray, dropout: float, merges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None = None) -> list[bytes]:
    """segment() of many parts of SHORT characters at most, as bytes of 32-bit ids."""
    flat, count = _segmented(v, m, parts, keys, dropout, merges)
    ends = np.cumsum(count).tolist()
    return [flat[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _segmented(v: Vocabulary, m: Merges, parts: Sequence[str], keys: np.ndarray, dropout: float, merges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] | None) -> tuple[np.ndarray, np.ndarray]:
    """The ids one after the other, and how many each part has: in each round every part merges its best pair that isn't skipped.
    A pair's skip depends on place and piece alone, so this is the agenda's order. What a round merges, as (part, place, piece), is added to merges."""
    n, limit = len(parts), int(dropout * 2**32)
    size = np.array([len(p) for p in parts])
    width = int(size.max())
    # by place, then part, flat; a symbol stays where its first character is, and -2 is none, as all of the last place are
    symbol = np.full((n, width + 1), -2, np.int32)
    symbol[np.arange(width + 1)[None, :] < size[:, None]] = m.letter[np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)]
    symbol = symbol.T.ravel()
    after, before = (np.repeat(np.array(x, np.int32), n) for x in ([*range(1, width + 1), width], [width, *range(width)]))
    piece = np.full((width + 1) * n, -1, np.int32)

    def candidate(part, at, left, right):
        """What two symbols form, kept in piece, and the order of the pair: rank, then place; LAST or more if they form nothing or are skipped."""
        k = piece[left] = m.of(symbol[left], symbol[right])
        out = m.order[k] + at
        if limit:
            some = np.flatnonzero(k >= 0)
            out[some[_skipped(keys[part[some]], at[some], k[some], limit)]] = LAST
        return out

    inner = np.arange(width * n)
    order = np.full((width + 1, n), LAST, np.int32)
    order[:width] = candidate(np.tile(np.arange(n), width), np.repeat(np.arange(width, dtype=np.int32), n), inner, inner + n).reshape(width, n)
    active = np.arange(n)  # the parts that order has columns of
    while len(active):
        best = order.min(0)
        column = np.flatnonzero(best < LAST)
        if 2 * len(column) < len(active):
            order, active, best, column = order[:, column], active[column], best[column], np.arange(len(column))
        if not len(column):
            break
        part, at = active[column], best[column] & 63
        # the pair becomes one symbol at the place of its first
        here = at * n + part
        gone = after[here]
        old = gone * n + part
        k = symbol[here] = piece[here]
        symbol[old] = -2
        order[gone, column] = LAST
        if merges is not None:
            merges.append((part, at, k))
        follows = after[here] = after[old]
        right = follows * n + part
        before[right] = at
        order[at, column] = candidate(part, at, here, right)
        ahead = before[here]
        some = np.flatnonzero(ahead < width)
        ahead, column, part = ahead[some], column[some], part[some]
        order[ahead, column] = candidate(part, ahead, ahead * n + part, here[some])
    grid = symbol.reshape(width + 1, n).T
    there = grid != -2
    flat, count = grid[there], there.sum(1)
    strange = np.flatnonzero(flat == -1)
    if len(strange):  # characters outside the vocabulary, which are symbols of their own
        row, at = np.nonzero(there)
        byte = [[v.bytes[x] for x in parts[i][j].encode("utf-8")] for i, j in zip(row[strange].tolist(), at[strange].tolist(), strict=True)]
        more = np.array([len(x) for x in byte])
        np.add.at(count, row[strange], more - 1)
        size = np.ones(len(flat), np.int64)
        size[strange] = more
        flat = np.repeat(flat, size)
        flat[flat == -1] = np.array([x for some in byte for x in some], np.int32)
    return flat, count


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows of `size` that begin at `start`, one after the other."""
    ends = np.cumsum(size)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - ends + size, size)]


class Known(dict):
    """Numbers of parts. A part that is asked for the first time gets the next one, and stands in new."""

    def __init__(self):
        self.first, self.new = 0, []

    def __missing__(self, part: str) -> int:
        self[part] = n = self.first + len(self.new)
        self.new.append(part)
        return n

    def numbers(self, parts: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))

    def settle(self, used: set[str]) -> list[str]:
        """The new parts, which are none from now on. Parts of over LONG characters are not kept, and stand as empty where they are not used."""
        new, self.new = self.new, []
        self.first += len(new)
        for i, part in enumerate(new):
            if len(part) > LONG:
                del self[part]
                if part not in used:
                    new[i] = ""
        return new


class Rows:
    """Arrays of varied length, one after the other, to be gathered many at once."""

    def __init__(self, kind):
        self.flat, self.start, self.size, self.used, self.n = np.empty(1 << 12, kind), np.empty(1 << 10, np.int64), np.empty(1 << 10, np.int64), 0, 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        while self.n + len(sizes) > len(self.size):
            self.start, self.size = (np.concatenate((x, np.empty_like(x))) for x in (self.start, self.size))
        self.flat[self.used : self.used + len(flat)] = flat
        self.size[self.n : self.n + len(sizes)] = sizes
        self.start[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used, self.n = self.used + len(flat), self.n + len(sizes)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows one after the other, and their sizes."""
        size = self.size[which]
        return gather(self.flat, self.start[which], size), size


class Encoder:
    def __init__(self, v: Vocabulary, dropout: float, seed: int):
        self.v, self.dropout, self.seed, self.merges = v, dropout, seed, Merges(v)
        self.forget()
        start = np.concatenate(([0], np.cumsum([len(x) for x in v.raw])))
        self.start, self.length = start[:-1], np.diff(start)
        self.flat = np.frombuffer(b"".join(v.raw), np.uint8)

    def forget(self) -> None:
        """known: number of a part; row, letters: where it is in what follows, and its characters there; pieces, places, merged: its pieces without skips, and the merges on the way to them."""
        self.known = Known()
        self.characters = 0
        self.row, self.letters = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pieces, self.places, self.merged = Rows(np.int32), Rows(np.int32), Rows(np.int32)

    def encode(self, key: int, text: str) -> np.ndarray:
        return self.encode_many([key], [text])[0]

    def _parts(self, text: str) -> list[str]:
        out = _PART.findall(" " + text) if text else []
        if len(text) <= LONG or max(map(len, out)) <= LONG:
            return out
        return [x for part in out for x in (self.cut(part) if len(part) > LONG else [part])]

    def cut(self, part: str) -> list[str]:
        """A part in pieces that no merge can span: a merge across a cut would need a piece that holds the two characters side by side."""
        letters = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        key = letters[:-1] << 21 | letters[1:]
        at = np.minimum(np.searchsorted(self.merges.neighbours, key), len(self.merges.neighbours) - 1)
        ends = [0, *(np.flatnonzero(self.merges.neighbours[at] != key) + 1).tolist(), len(part)]
        return [part[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _learn(self, parts: list[str]) -> None:
        sizes = np.array([len(x) for x in parts], np.int64)
        self.characters += int(sizes.sum())
        order = np.argsort(sizes, kind="stable")
        row = np.empty(len(parts), np.int64)
        row[order] = np.arange(self.pieces.n, self.pieces.n + len(parts))
        self.row, self.letters = np.concatenate((self.row, row)), np.concatenate((self.letters, sizes[order]))
        short = int((sizes <= SHORT).sum())
        for at in range(0, short, TOGETHER):
            some, rounds = [parts[i] for i in order[at : min(short, at + TOGETHER)].tolist()], []
            got, count = _segmented(self.v, self.merges, some, np.zeros(len(some), np.uint64), 0.0, rounds)
            part, place, piece = (np.concatenate(x) for x in zip(*rounds, strict=True)) if rounds else np.zeros((3, 0), np.int64)
            by_part = np.argsort(part, kind="stable")
            self._add(got, count, place[by_part], piece[by_part], np.bincount(part, minlength=len(some)))
        for i in order[short:].tolist():
            merges: list[tuple[int, int]] = []
            got = np.array(segment(self.v, parts[i], 0.0, 0, merges), np.int32)
            place, piece = np.array(merges, np.int64).reshape(-1, 2).T
            self._add(got, np.array([len(got)]), place, piece, np.array([len(merges)]))

    def _add(self, got: np.ndarray, count: np.ndarray, place: np.ndarray, piece: np.ndarray, sizes: np.ndarray) -> None:
        self.pieces.add(got, count)
        self.places.add(place, sizes)
        self.merged.add(piece, sizes)

    def encode_many(self, keys: list[int], texts: list[str]) -> list[np.ndarray]:
        if len(self.known) >= KEPT or self.characters >= KEPT_CHARACTERS:
            self.forget()
        cut = [_PART.findall(" " + text) if text else [] for text in texts]
        if not any(cut):
            return [np.empty(0, np.int32) for _ in texts]
        counts, used = np.array([len(x) for x in cut], np.int64), set()
        which = self.known.numbers([x for some in cut for x in some])
        long = [self.known.first + i for i, x in enumerate(self.known.new) if len(x) > LONG]  # all that are met, as a known part is never so long
        if long:  # their texts are cut again
            own = np.split(which, np.cumsum(counts)[:-1])
            for i in np.unique(np.searchsorted(np.cumsum(counts), np.flatnonzero(np.isin(which, long)), side="right")).tolist():
                cut[i] = self._parts(texts[i])
                own[i], counts[i] = self.known.numbers(cut[i]), len(cut[i])
                used.update(x for x in cut[i] if len(x) > LONG)
            which = np.concatenate(own)
        parts = [x for some in cut for x in some]
        self._learn(self.known.settle(used))
        which = self.row[which]
        first = np.cumsum(counts) - counts
        occurrence = mix(np.arange(len(parts), dtype=np.uint64) - np.repeat(first, counts).astype(np.uint64) + np.repeat(np.array(keys, np.uint64), counts))
        limit = int(self.dropout * 2**32)
        other = np.zeros(len(parts), bool)
        for at in range(0, len(parts) if limit else 0, 1 << 15):
            some = which[at : at + (1 << 15)]
            place, size = self.places.take(some)
            row = np.repeat(np.arange(at, at + len(some)), size)
            other[row[_skipped(occurrence[row], place, self.merged.take(some)[0], limit)]] = True
        anew = np.flatnonzero(other)
        letters = self.letters[which[anew]]
        by_size = np.argsort(letters, kind="stable")
        anew, short = anew[by_size], int((letters <= SHORT).sum())
        got, sizes = [], []
        for at in range(0, short, TOGETHER):
            some = anew[at : min(short, at + TOGETHER)]
            flat, count = _segmented(self.v, self.merges, [parts[i] for i in some.tolist()], occurrence[some], self.dropout, None)
            got.append(flat)
            sizes.append(count)
        for i in anew[short:].tolist():
            got.append(np.array(segment(self.v, parts[i], self.dropout, int(occurrence[i])), np.int32))
            sizes.append(np.array([len(got[-1])]))
        flat, size = self.pieces.take(which[~other])
        flat, sizes = np.concatenate((flat, *got)), np.concatenate((size, *sizes))
        start = np.cumsum(sizes) - sizes
        order = np.empty(len(parts), np.int64)
        order[~other] = np.arange(len(parts) - len(anew))
        order[anew] = np.arange(len(parts) - len(anew), len(parts))
        start, size = start[order], sizes[order]
        ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum(counts)]
        return np.split(gather(flat, start, size), ends[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes of the text."""
        out = []
        for at in range(0, len(ids), 1 << 18):
            part = ids[at : at + (1 << 18)]
            n = self.length[part]
            ends = np.cumsum(n)
            out.append(self.flat[np.arange(int(ends[-1])) + np.repeat(self.start[part] - ends + n, n)].tobytes())
        return b"".join(out)[1:]


_encoders: dict[tuple, Encoder] = {}


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, dropout: float = 0.1, seed: int = 5) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, token_ids, lossless (decoding gave back the text)."""
    spark: SparkSession = docs.sparkSession
    short_batches(spark, 500)
    sent = spark.sparkContext.broadcast(Vocabulary(model))  # one file's vocabulary
    base = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    name = f"{model}:{dropout}:{seed}"

    def run(batches):
        import pyarrow as pa

        if name not in _encoders:
            _encoders[name] = Encoder(sent.value, dropout, seed)
        e = _encoders[name]
        for b in slices(batches, most=1 << 20):
            texts = utf8(b.column("text"))
            keys = [xxhash.xxh3_64_intdigest(str(key), seed) >> 1 for key in b.column("id").to_pylist()]
            ids = e.encode_many(keys, [t.decode("utf-8") for t in texts])
            lossless = [e.decode(got) == t if len(got) else not t for got, t in zip(ids, texts, strict=True)]
            sizes = [len(t) for t in texts]
            counts = [len(x) for x in ids]
            offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
            listed = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), listed, pa.array(lossless)], names=["id", "n_bytes", "n_tokens", "token_ids", "lossless"])

    return base.mapInArrow(lean(run), "id long, n_bytes long, n_tokens long, token_ids array<int>, lossless boolean")


def decode(encoded: DataFrame, id_col: str = "id", ids_col: str = "token_ids", model: str = MODEL) -> DataFrame:
    """id, text from ids."""
    sent = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def run(batches):
        import pyarrow as pa

        e = Encoder(sent.value, 0.0, 0)
        for b in batches:
            texts = [e.decode(np.array(x or [], np.int64)).decode("utf-8") if x else "" for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(lean(run), "id long, text string")


