"""SentencePiece encoding and decoding for merge-type vocabularies.

Adjacent pairs of symbols that form a piece wait in an agenda ordered by score
and position; the best is merged and its new neighbours join the agenda, until
none is left.  Symbols without a piece fall back to their UTF-8 bytes.  No
piece of the vocabulary may hold a word boundary behind another sign, which is
checked, so texts are cut before runs of boundaries and the pieces of each
segment are kept.  Every segment that is new to a task is also encoded by the
sentencepiece library, one call per Arrow batch; where the two differ the
library's pieces are used and counted.

Defined cases: a null or empty text has the begin and end ids only; rows are
independent, so ties and repeats need no rule; an empty table gives an empty
table.  Ids are kept as one binary of little-endian unsigned 32-bit numbers.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BOUNDARY = "▁"
KEPT_SEGMENTS = 300_000  # segments kept by a task; speed only
KEPT_LENGTH = 48  # longer segments are not kept
BATCH_CHARS = 1 << 20
SIDE_BY_SIDE = ((0, 6), (6, 9), (9, 12), (12, 16), (16, 24), (24, 48))  # segments of these lengths are merged together
ROWS_TOGETHER = 1 << 14
UNKNOWN = 1 << 24  # signs without a piece are symbols from here on
NOTHING = -1
NO_PAIR = np.int32(2**31 - 1)
SCHEMA = "ids binary, decoded string, mismatches int"
_SEGMENT = re.compile(f"{BOUNDARY}+[^{BOUNDARY}]*")


class MergeEncoder:
    """Encoder over one vocabulary file, made once per Python worker."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model)
        self.pieces: dict[str, tuple[float, int]] = {}
        self.bytes = [lib.unk_id()] * 256
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not lib.is_control(i) and not lib.is_unknown(i):
                self.pieces[piece] = (-lib.get_score(i), i)
        if any(BOUNDARY in p.lstrip(BOUNDARY) for p in self.pieces):
            raise ValueError("a piece holds a word boundary behind another sign")
        self.kept: dict[str, bytes] = {}
        self.of_sign = np.arange(UNKNOWN, UNKNOWN + 0x110000, dtype=np.int32)
        for piece, (_, i) in self.pieces.items():
            if len(piece) == 1:
                self.of_sign[ord(piece)] = i
        best_first = sorted(self.pieces, key=self.pieces.__getitem__)
        self.id_by_order = np.array([self.pieces[p][1] for p in best_first], np.int32)
        pairs = {}
        for order, piece in enumerate(best_first):
            for cut in range(1, len(piece)):
                left, right = self._symbol(piece[:cut]), self._symbol(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = order
        self.pairs = np.array(sorted(pairs), np.int64)
        self.pair_orders = np.array([pairs[p] for p in self.pairs.tolist()], np.int32)

    def _symbol(self, text: str) -> int | None:
        if text in self.pieces:
            return self.pieces[text][1]
        return int(self.of_sign[ord(text)]) if len(text) == 1 else None

    def merge(self, segment: str) -> list[int]:
        """The ids of one segment, by the agenda."""
        find, push, pop = self.pieces.get, heapq.heappush, heapq.heappop
        symbol = list(segment)
        n = len(symbol)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            found = find(symbol[i] + symbol[i + 1])
            if found:
                agenda.append((found[0], i, i + 1, 2))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, size = pop(agenda)
            a, b = symbol[left], symbol[right]
            if not a or not b or after[left] != right or len(a) + len(b) != size:
                continue  # one of the two has been merged since
            symbol[left] = merged = a + b
            symbol[right] = ""
            behind = after[left] = after[right]
            ahead = before[left]
            if ahead >= 0 and (found := find(symbol[ahead] + merged)):
                push(agenda, (found[0], ahead, left, len(symbol[ahead]) + size))
            if behind < n:
                before[behind] = left
                if found := find(merged + symbol[behind]):
                    push(agenda, (found[0], left, behind, size + len(symbol[behind])))
        ids = []
        for piece in symbol:
            if piece:
                found = find(piece)
                if found:
                    ids.append(found[1])
                else:
                    ids.extend(self.bytes[b] for b in piece.encode())
        return ids

    def merge_all(self, segments: list[str]) -> list[bytes]:
        """The packed ids of many segments; short ones go through the same steps side by side."""
        out: list[bytes] = [b""] * len(segments)
        length = np.fromiter(map(len, segments), np.int64, len(segments))
        for low, high in SIDE_BY_SIDE:
            chosen = np.flatnonzero((length > low) & (length <= high))
            for first in range(0, len(chosen), ROWS_TOGETHER):
                rows = chosen[first : first + ROWS_TOGETHER]
                own = [segments[i] for i in rows]
                for i, packed in zip(rows, self._side_by_side(own, length[rows], high), strict=True):
                    out[i] = packed
        for i in np.flatnonzero(length > SIDE_BY_SIDE[-1][1]):
            ids = self.merge(segments[i])
            out[i] = pack(f"<{len(ids)}I", *ids)
        return out

    def _side_by_side(self, segments: list[str], length: np.ndarray, width: int) -> list[bytes]:
        signs = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        symbol = np.full((len(segments), width), NOTHING, np.int32)
        symbol[np.arange(width) < length[:, None]] = self.of_sign[signs]
        order = self._orders(symbol[:, :-1], symbol[:, 1:])
        result = np.full_like(symbol, NOTHING)
        rows, column = np.arange(len(segments)), np.arange(width)
        while len(rows):
            best = order.argmin(axis=1)
            at = np.arange(len(rows))
            chosen = order[at, best]
            going = chosen < NO_PAIR
            if not going.all():
                result[rows[~going]] = symbol[~going]
                rows, symbol, order, best, chosen = (x[going] for x in (rows, symbol, order, best, chosen))
                at = np.arange(len(rows))
                if not len(rows):
                    break
            symbol = np.take_along_axis(symbol, np.minimum(column + (column > best[:, None]), width - 1), 1)
            symbol[at, best] = self.id_by_order[chosen]
            symbol[:, -1] = NOTHING
            order = np.take_along_axis(order, np.minimum(column[:-1] + (column[:-1] >= best[:, None]), width - 2), 1)
            order[:, -1] = NO_PAIR
            behind = np.minimum(best, width - 2)
            order[at, behind] = self._orders(symbol[at, behind], symbol[at, behind + 1])
            ahead = np.maximum(best - 1, 0)
            order[at, ahead] = self._orders(symbol[at, ahead], symbol[at, ahead + 1])
        return self._packed(result)

    def _orders(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.pair_orders[at], NO_PAIR)

    def _packed(self, symbol: np.ndarray) -> list[bytes]:
        """Symbols to packed ids, signs without a piece to their bytes."""
        count = (symbol != NOTHING).sum(axis=1)
        flat = symbol[symbol != NOTHING]
        if (flat >= UNKNOWN).any():
            known = [[i] if i < UNKNOWN else [self.bytes[b] for b in chr(i - UNKNOWN).encode()] for i in flat.tolist()]
            size = np.fromiter(map(len, known), np.int64, len(known))
            flat = np.array([i for ids in known for i in ids])
            ends = np.r_[0, np.cumsum(size)][np.cumsum(count)]
        else:
            ends = np.cumsum(count)
        data = flat.astype("<u4").tobytes()
        ends = (ends * 4).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[int]]:
        """Packed ids of each text, and how many of its new segments the library had otherwise."""
        cut = [_SEGMENT.findall(BOUNDARY + t.replace(" ", BOUNDARY)) if t else [] for t in texts]
        kept = self.kept
        fresh = list({s for segments in cut for s in segments if s not in kept})
        wanted = self.library.encode([s[1:].replace(BOUNDARY, " ") or " " for s in fresh], num_threads=1) if fresh else []
        other = set()
        for segment, own, library in zip(fresh, self.merge_all(fresh), wanted, strict=True):
            # The library adds no boundary to an empty text, so a lone one can't be asked for.
            if segment != BOUNDARY and own != (library := pack(f"<{len(library)}I", *library)):
                other.add(segment)
                own = library
            kept[segment] = own
        begin, end = pack("<I", self.library.bos_id()), pack("<I", self.library.eos_id())
        packed = [begin + b"".join([kept[s] for s in segments]) + end for segments in cut]
        if len(kept) > KEPT_SEGMENTS:
            kept.clear()
        for segment in fresh:
            if len(segment) > KEPT_LENGTH:
                kept.pop(segment, None)
        return packed, [sum(s in other for s in segments) if other else 0 for segments in cut]

    def decode(self, packed: list[bytes]) -> list[str]:
        return self.library.decode([np.frombuffer(p, "<u4").tolist() for p in packed])


@lru_cache(maxsize=2)
def encoder(model: str) -> MergeEncoder:
    return MergeEncoder(model)


def encode_texts(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, its text's ``ids``, their ``decoded`` text, and ``mismatches`` with the library.

    ``model`` is the path of a vocabulary file that every executor has.
    """
    schema = docs.select(key).schema.simpleString().removeprefix("struct<").removesuffix(">")

    def run(batches):
        own = encoder(model)
        for batch in batches:
            keys, texts, first = batch.column(0), batch.column(1), 0
            while first < len(texts):
                part, chars = [], 0
                while first + len(part) < len(texts) and chars < BATCH_CHARS:
                    part.append(texts[first + len(part)].as_py() or "")
                    chars += len(part[-1])
                packed, wrong = own.encode(part)
                columns = [
                    keys.slice(first, len(part)),
                    pa.array(packed, pa.binary()),
                    pa.array(own.decode(packed), pa.string()),
                    pa.array(wrong, pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [key, "ids", "decoded", "mismatches"])
                first += len(part)

    return docs.select(key, text).mapInArrow(run, f"{schema}, {SCHEMA}")
