"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The pieces and scores of a merge-type SentencePiece model are read from its file; the
encoding is done here. A text gets the model's leading space and is cut into units, a
run of spaces with what follows up to the next space or line end, because no piece of
such a model spans more. Each unit begins as characters; an agenda holds the
neighbouring pairs whose union is a piece, best score first, leftmost on ties, and the
best is merged until none is left. With merge-dropout each candidate that comes off the
agenda is skipped when a hash keyed by seed, document id, the unit's place in the text and the
candidate's number falls under the rate, so that a seed fixes the segmentation, other
seeds vary it, and so does each occurrence of a unit.

What is kept by unit does not depend on those keys: its segmentation without skips and the number of
its candidates. Units with a skipped candidate are merged each for itself, many at a time.
Characters without a piece, and the character U+2581 itself, become byte pieces: decoding
gives every text back exactly.

Defined results: null and empty texts have no ids; repeated rows get equal results. Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import bounded_batches, held

SPACE = "▁"
UNIT = re.compile(r" +[^ \n]*|[^ \n]+|\n")
#: Segmentations that are kept, at most.
CACHE_UNITS = 500_000
#: Candidates of a unit that are drawn at once, and units; units that are worked on together, about.
DRAWN, BATCH, TOGETHER = 32, 4096, 100_000
NORMAL = 1
#: Units of up to so many characters are merged in a list, longer ones with a heap.
SHORT, NEVER = 40, 1 << 40
#: No union, in arrays; units of up to the second number of characters share arrays.
NONE = 1 << 30
WIDTHS = ((0, 6), (6, 9), (9, 14), (14, SHORT))

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))

def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class PieceCoder:
    """With a number of ``variants``, documents share so many keys; without, each has its own."""

    def __init__(self, path: str, rate: float = 0.1, seed: int = 0, variants: int | None = None):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        pieces = list(model.pieces)
        order = sorted((i for i, p in enumerate(pieces) if p.type == NORMAL), key=lambda i: (-pieces[i].score, i))
        #: a piece's place in the order of merging, and the id at each place
        self.rank_of, self.id_of = {pieces[i].piece: k for k, i in enumerate(order)}, order
        names = {p.piece: i for i, p in enumerate(pieces)}
        self.byte_ids = [names[f"<0x{b:02X}>"] for b in range(256)]
        self.plain = [p.piece.replace(SPACE, " ").encode() if p.type == NORMAL else b"" for p in pieces]
        for b, i in enumerate(self.byte_ids):
            self.plain[i] = bytes([b])
        self.limit, self.seed, self.variants = int(rate * 2**32), seed, variants
        self.packed = {p.piece: array("I", [i]).tobytes() for i, p in enumerate(pieces) if p.type == NORMAL}
        #: by symbol (a piece's place in the order, from 1 on; 0 is none): its id; by code point: the symbol; by two symbols: their union
        self.id_at = np.array([0, *order], np.uint32)
        self.symbol = np.zeros(0x110000, np.int32)
        for piece, rank in self.rank_of.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = rank + 1
        self.symbol[ord(" ")], self.symbol[ord(SPACE)] = self.symbol[ord(SPACE)], 0
        place = self.rank_of.get
        cuts = ((place(p[:k]), place(p[k:]), rank) for p, rank in self.rank_of.items() for k in range(1, len(p)))
        union = sorted((a + 1 << 32 | b + 1, rank) for a, b, rank in cuts if a is not None and b is not None)
        self.pairs, self.union = np.array([k for k, _ in union], np.int64), np.array([r for _, r in union], np.int32)
        #: by unit: the candidates that it has when none is skipped, as bits, and its ids then; and the units that have occurred in one slice
        self.kept: dict[str, tuple[int, bytes]] = {}
        self.met: set[str] = set()

    def variant(self, doc_id: int | None) -> int:
        if self.variants is None:
            return int.from_bytes(hashlib.blake2b(str(doc_id).encode(), digest_size=8).digest(), "little")
        return zlib.crc32(f"{self.seed}:{doc_id}".encode()) % self.variants

    def _skips(self, variant: int, first: int, units: int, candidates: int) -> np.ndarray:
        """A row for each of the units from place ``first`` on: whether its candidates are skipped."""
        if not self.limit:
            return np.zeros((units, candidates), bool)
        key = int.from_bytes(hashlib.blake2b(b"%d:%d" % (self.seed, variant), digest_size=8).digest(), "little")
        unit = _mixed(np.arange(first + 1, first + 1 + units, dtype=np.uint64) * _A ^ np.uint64(key))
        step = np.arange(1, candidates // 2 + 1, dtype=np.uint64) * _A
        return _mixed(unit[:, None] + step[None, :]).view(np.uint32) <= np.uint32(self.limit - 1)

    def _merged_short(self, parts: list[str], skipped: int) -> tuple[list[str], int]:
        """The parts and the number of candidates. For short units the agenda is a list of ranks beside the parts;
        a bit of ``skipped`` stands for a candidate."""
        rank_of, n = self.rank_of.get, 0
        agenda = [rank_of(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while agenda and (rank := min(agenda)) != NEVER:
            i = agenda.index(rank)
            if skipped >> n & 1:
                agenda[i] = NEVER
            else:
                part = parts[i] = parts[i] + parts.pop(i + 1)
                del agenda[i]
                if i:
                    agenda[i - 1] = rank_of(parts[i - 1] + part, NEVER)
                if i < len(agenda):
                    agenda[i] = rank_of(part + parts[i + 1], NEVER)
            n += 1
        return parts, n

    def _merged_long(self, parts: list[str], skipped: set[int]) -> tuple[list[str], int]:
        """The same with a heap and linked neighbours."""
        rank_of, n, candidate = self.rank_of.get, len(parts), -1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, str, str]] = []

        def add(i: int, j: int) -> None:
            if (rank := rank_of(parts[i] + parts[j])) is not None:
                heapq.heappush(agenda, (rank, i, parts[i], parts[j]))

        for i in range(n - 1):
            add(i, i + 1)
        while agenda:
            rank, i, left, right = heapq.heappop(agenda)
            if parts[i] != left or (j := after[i]) >= n or parts[j] != right:
                continue
            candidate += 1
            if candidate in skipped:
                continue
            parts[i], parts[j] = left + right, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                add(i, k)
            if before[i] >= 0:
                add(before[i], i)
        return [p for p in parts if p], candidate + 1

    def _segmented(self, text: str, skipped: int) -> tuple[int, bytes]:
        """The number of candidates of one unit, and its ids as unsigned 32-bit integers; a bit of ``skipped``
        stands for a candidate."""
        if SPACE in text:  # the character itself has no piece
            parts = ["\0" + c if c == SPACE else SPACE if c == " " else c for c in text]
        else:
            parts = list(text.replace(" ", SPACE))
        if len(parts) <= SHORT:
            parts, n = self._merged_short(parts, skipped)
        else:
            parts, n = self._merged_long(parts, {k for k, bit in enumerate(reversed(f"{skipped:b}")) if bit == "1"})
        known = self.packed.get
        return n, b"".join([known(part) or self._as_bytes(part) for part in parts])

    def _as_bytes(self, part: str) -> bytes:
        """The byte pieces of a character without a piece of its own."""
        return array("I", (self.byte_ids[b] for b in part[-1:].encode())).tobytes()

    def unit(self, text: str, variant: int, at: int = 0) -> bytes:
        """The ids of the unit at this place; each merge makes two candidates at most."""
        most = -(-max(3 * len(text), DRAWN) // 2) * 2
        row = np.packbits(self._skips(variant, at, 1, most)[0], bitorder="little")
        return self._segmented(text, int.from_bytes(row.tobytes(), "little"))[1]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place in the order of merging of each union of two symbols, NONE where it is no piece."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.union[at], NONE)

    def _segment_all(self, texts: list[str], masks: list[int]) -> list[tuple[int, bytes]]:
        """What _segmented gives for each unit; those of known characters go in steps through arrays."""
        if len(texts) > TOGETHER:  # of one very long text
            return [x for k in range(0, len(texts), TOGETHER) for x in self._segment_all(texts[k : k + TOGETHER], masks[k : k + TOGETHER])]
        out: list[tuple[int, bytes]] = [(0, b"")] * len(texts)
        if not texts:
            return out
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        start = np.cumsum(size) - size
        flat = self.symbol[np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")]
        plain = (np.minimum.reduceat(flat, start) > 0) & (size <= SHORT)
        drawn = np.array(masks, np.int64)
        for low, high in WIDTHS:
            some = np.flatnonzero(plain & (size > low) & (size <= high))
            if some.size:
                self._steps(flat, start[some], size[some], drawn[some], high, some, out)
        for k in np.flatnonzero(~plain).tolist():
            out[k] = self._segmented(texts[k], masks[k])
        return out

    def _steps(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray, drawn: np.ndarray, width: int, place: np.ndarray, out: list) -> None:
        """One unit a row; in each step every row takes its next candidate off its agenda."""
        column = np.arange(width + 1)
        symbol = np.where(column < size[:, None], flat[np.minimum(start[:, None] + column, flat.size - 1)], 0)
        agenda = np.full(symbol.shape, NONE, np.int32)
        agenda[:, :-1] = self._ranks(symbol[:, :-1], symbol[:, 1:])
        step = 0
        while True:
            i = agenda.argmin(1)
            rank = agenda[np.arange(len(i)), i]
            ended = rank == NONE
            if ended.any():
                ids = self.id_at[symbol[ended]][column < size[ended][:, None]].tobytes()
                end = (np.cumsum(size[ended]) * 4).tolist()
                for k, a, b in zip(place[ended].tolist(), [0, *end], end, strict=False):
                    out[k] = step, ids[a:b]
                on = ~ended
                symbol, agenda, size, drawn, place, i, rank = symbol[on], agenda[on], size[on], drawn[on], place[on], i[on], rank[on]
            if not place.size:
                return
            skip = (drawn >> step & 1).astype(bool) if step < DRAWN else np.zeros(place.size, bool)
            agenda[np.flatnonzero(skip), i[skip]] = NONE
            merge = np.flatnonzero(~skip)
            at, row = i[merge], np.arange(merge.size)
            source = np.minimum(column + (column > at[:, None]), width)
            left, waiting = np.take_along_axis(symbol[merge], source, 1), np.take_along_axis(agenda[merge], source, 1)
            left[row, at] = rank[merge] + 1
            waiting[row, at] = self._ranks(left[row, at], left[row, at + 1])
            inner = np.flatnonzero(at)
            before = at[inner] - 1
            waiting[inner, before] = self._ranks(left[inner, before], left[inner, before + 1])
            symbol[merge], agenda[merge] = left, waiting
            size[merge] -= 1
            step += 1

    def _encoded(self, units: list[str], masks: list[int], docs: list[tuple[int, int]]) -> Iterator[array]:
        """The ids of each document, given as (number of units, variant)."""
        kept = self.kept
        data: list[bytes | None] = [None] * len(units)
        find, to_do = kept.get, []
        for k, (unit, mask) in enumerate(zip(units, masks, strict=True)):
            node = find(unit)
            if node is None or mask & node[0]:
                to_do.append(k)
            else:
                data[k] = node[1]
        texts = [units[k] for k in to_do]
        new = {u for u in texts if len(u) < 64 and u not in kept}
        fresh = list(new & self.met)[: max(0, CACHE_UNITS - len(kept))]  # kept from the second slice on in which they occur
        if len(self.met) > CACHE_UNITS:
            self.met.clear()
        self.met |= new
        self.met.difference_update(fresh)
        found = self._segment_all(texts + fresh, [masks[k] for k in to_do] + [0] * len(fresh))
        for k, (n, ids) in zip(to_do, found, strict=False):
            if n <= DRAWN:
                data[k] = ids
        for unit, (n, ids) in zip(fresh, found[len(to_do) :], strict=True):
            if n <= DRAWN:
                kept[unit] = (1 << n) - 1, ids
        first = 0
        for count, variant in docs:
            parts = data[first : first + count]
            if None in parts:  # units with more candidates than are drawn at once
                parts = [self.unit(units[first + at], variant, at) if p is None else p for at, p in enumerate(parts)]
            out = array("I")
            out.frombytes(b"".join(parts))
            yield out
            first += count

    def encode_all(self, texts: Iterable[str], variants: Iterable[int]) -> Iterator[array]:
        """The ids of each text, in order; units of several texts are worked on together."""
        units, masks, docs = [], [], []
        for text, variant in zip(texts, variants, strict=True):
            own = UNIT.findall(" " + text) if text else []
            for first in range(0, len(own), BATCH):
                drawn = self._skips(variant, first, min(BATCH, len(own) - first), DRAWN)
                masks += np.packbits(drawn, axis=1, bitorder="little").view("<u4").ravel().tolist()
            units += own
            docs.append((len(own), variant))
            if len(units) >= TOGETHER:
                yield from self._encoded(units, masks, docs)
                units, masks, docs = [], [], []
        yield from self._encoded(units, masks, docs)

    def encode(self, text: str, variant: int = 0) -> array:
        return next(self.encode_all([text], [variant]))

    def decode(self, ids) -> str:
        return b"".join(map(self.plain.__getitem__, ids))[1:].decode()


def coder(*key) -> PieceCoder:
    return held((PieceCoder, *key), lambda: PieceCoder(*key))


def encode(docs: DataFrame, path: str, rate: float = 0.1, seed: int = 0, variants: int | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(path, rate, seed, variants)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                ids = [list(x) for x in c.encode_all((t or "" for t in part["text"]), (c.variant(_whole(i)) for i in part["doc_id"]))]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(dtype=object), "ids": ids})

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of (doc_id, ids)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(path)
        for batch in batches:
            text = [c.decode(ids) if ids is not None else "" for ids in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": text})

    bounded_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, rate: float = 0.1, seed: int = 0, variants: int | None = None) -> DataFrame:
    """Encodes and decodes every row in one pass: doc_id, n_tokens, ids_crc32 (little-endian
    32-bit ids), decoded_chars, decoded_sha256 and lossless (decoded as it was)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(path, rate, seed, variants)
        for batch in batches:
            rows = []
            encoded = c.encode_all((t or "" for t in batch["text"]), (c.variant(_whole(i)) for i in batch["doc_id"]))
            for doc_id, text, ids in zip(batch["doc_id"], batch["text"], encoded, strict=True):
                back = c.decode(ids)
                rows.append((doc_id, len(ids), zlib.crc32(ids.tobytes()), len(back), hashlib.sha256(back.encode()).hexdigest(), back == (text or "")))
            out = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_crc32", "decoded_chars", "decoded_sha256", "lossless"])
            yield out.astype({"doc_id": "Int64"})

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_chars long, decoded_sha256 string, lossless boolean")


def _whole(doc_id) -> int | None:
    return None if pd.isna(doc_id) else int(doc_id)
