"""Exact removal of repeated passages by longest-previous-factor arrays.

A byte goes if some string of ``LENGTH`` bytes over it also starts in a document with a smaller id. The first copy stays.

Finding where to look. Every string of LENGTH bytes has an *anchor*, the sequence of ``ANCHOR`` bytes in it with the least hash (the first of equals).
Neighbouring strings mostly share it, so a text falls into *pieces*: maximal runs of strings with one anchor. Equal strings lie in pieces
with equal anchors, and equal pieces are found by their hash: all pieces of the corpus are asked once (``slabs``) which document has them first.

Comparing. Where pieces with one anchor differ, one copy of each goes to the anchor's bucket. There their strings are put in suffix order with the
lengths of common prefixes; the nearest entries before and after with a smaller document (previous and next smaller values) give
the longest factor that an earlier document has, and a string whose factor reaches LENGTH is removed. Equal pieces are the same
question with a known answer and are not compared again.

No text is shuffled but these copies; anchors and pieces are combined per slab, so a passage in a third of all documents sends one entry per slab.
Hot anchors. Where more than ``HOT_PIECES`` different pieces have one anchor, no bucket gets them together: their strings, whose hash is the same in all
copies, go to buckets by a 128-bit hash of their LENGTH bytes, combined per slab, and come back with whether an earlier document has them. The
first question still has 24 bytes in one bucket for every different piece of an anchor.

Defined results: a NULL text is empty; texts shorter than LENGTH keep everything; documents with equal ids are not earlier than each other;
documents with a NULL id come before all others; other columns of the input are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scanledger.staging import staged

from .arrays import U64, chunks, mixed, prefix_hashes, ranges, span_hashes, text_bytes
from .slabs import SLAB_BYTES, answer, ask, bucket_count, cut, each_slab, make_slabs, pack, unpack, with_answers

LENGTH, ANCHOR = 50, 24
TOP48 = U64(0xFFFFFFFFFFFF0000)
NO_ID = np.int64(-(1 << 63))

PLACE_BITS = 28

ONLY, LATER, COMPARE, HOT = 0, 1, 2, 3
HOT_PIECES = 256


def least_in_windows(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value in every ``width`` consecutive values; values are compared by their first ``64 - PLACE_BITS`` bits.

    The place stands in the other bits, so that one minimum finds both. An array too long for that keeps places beside the values.
    """
    value, have = h & ~U64((1 << PLACE_BITS) - 1), 1
    if len(h) < 1 << PLACE_BITS:
        value = value | np.arange(len(h), dtype=U64)
        while have < width:
            step = min(have, width - have)
            value = np.minimum(value[step:], value[:-step])
            have += step
        return (value & U64((1 << PLACE_BITS) - 1)).astype(np.int32)
    place = np.arange(len(h))
    while have < width:
        step = min(have, width - have)
        right = value[step:] < value[:-step]
        place = np.where(right, place[step:], place[:-step])
        value = np.where(right, value[step:], value[:-step])
        have += step
    return place


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, number of strings, anchor hash, piece hash) of every piece of a slab; hashes have 48 bits.

    Anchors are least hashes, so they are scrambled once more to spread evenly over the buckets.
    """
    parts = []
    for i, _, part, offs in chunks(data, offsets):
        n = len(part) - LENGTH + 1
        if n <= 0:
            continue
        sums = prefix_hashes(part)
        grams = np.arange(len(part) - ANCHOR + 1)
        h = span_hashes(sums, grams, grams + ANCHOR)
        place = least_in_windows(h, LENGTH - ANCHOR + 1)[:n]
        inside = np.zeros(n + 1, np.int8)  # strings that end within their row
        whole = np.flatnonzero(np.diff(offs) >= LENGTH)
        np.add.at(inside, offs[whole], 1)
        np.add.at(inside, offs[whole + 1] - LENGTH + 1, -1)
        inside = np.cumsum(inside[:n]) > 0
        head = inside.copy()
        head[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
        head[offs[whole]] = True
        first = np.flatnonzero(head)
        end = np.zeros(n, bool)
        end[:-1] = inside[:-1] & (head[1:] | ~inside[1:])
        end[-1] = inside[-1]
        count = np.flatnonzero(end) + 1 - first
        row = np.searchsorted(offs, first, "right") - 1
        parts.append((row + i, first + offsets[i], count, mixed(h[place[first]]) & TOP48, span_hashes(sums, first, first + count + LENGTH - 1) & TOP48))
    if not parts:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, U64), np.empty(0, U64)
    return tuple(np.concatenate(x) for x in zip(*parts))


class Slab:
    """The distinct pieces of a slab in the order of (anchor, piece), and where they occur."""

    def __init__(self, ids: pa.Array, texts: pa.Array):
        self.data, self.offsets = text_bytes(texts)
        self.ids = ids.fill_null(int(NO_ID)).to_numpy()
        self.row, self.first, self.count, anchor, piece = pieces(self.data, self.offsets)
        order = np.lexsort((self.ids[self.row], piece, anchor))
        a, p = anchor[order], piece[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1])
        self.entry = np.empty(len(order), np.int64)  # of every occurrence
        self.entry[order] = np.cumsum(new) - 1
        self.example = order[new]                     # an occurrence in the entry's least document
        self.anchor, self.piece, self.least = a[new], p[new], self.ids[self.row[self.example]]


def _first_question(buckets: int):
    def question(slab, ids, texts, _):
        s = Slab(ids, texts)
        edges = cut(s.anchor, buckets)
        for b in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[b], edges[b + 1])
            anchor = (s.anchor[part] >> U64(16)).astype(np.int64)
            piece = (s.piece[part] >> U64(16)).view(np.uint8).reshape(-1, 8)[:, :6]
            yield b, pack(np.diff(anchor, prepend=0), *piece.T, s.least[part])
    return question


def _who_is_first(slabs: list[int], bodies: list[bytes], hot_pieces: int = HOT_PIECES) -> Iterator[tuple[int, bytes]]:
    """Per slab and entry: ONLY (no other piece has its anchor), LATER (an earlier document has the piece), COMPARE or, for many pieces, HOT."""
    parts = [unpack(b) for b in bodies]
    sizes = [len(p[0]) for p in parts]
    anchor = np.concatenate([np.cumsum(p[0]) for p in parts])
    piece = np.zeros((len(anchor), 8), np.uint8)
    for k in range(6):
        piece[:, k] = np.concatenate([p[1 + k] for p in parts])
    piece, least = piece.view(U64).ravel(), np.concatenate([p[7] for p in parts])
    order = np.lexsort((piece, anchor))
    a, p = anchor[order], piece[order]
    new_anchor = np.concatenate([[True], a[1:] != a[:-1]])
    new_piece = new_anchor | np.concatenate([[True], p[1:] != p[:-1]])
    earliest = np.minimum.reduceat(least[order], np.flatnonzero(new_piece))[np.cumsum(new_piece) - 1]
    kinds = np.add.reduceat(new_piece.astype(np.int64), np.flatnonzero(new_anchor))[np.cumsum(new_anchor) - 1]
    state = np.empty(len(order), np.uint8)
    state[order] = np.where(least[order] > earliest, LATER, np.where(kinds > hot_pieces, HOT, np.where(kinds > 1, COMPARE, ONLY)))
    for slab, end, n in zip(slabs, np.cumsum(sizes), sizes):
        yield slab, pack(state[end - n:end])


def _states(s: Slab, answers: dict[int, bytes], buckets: int) -> np.ndarray:
    edges = cut(s.anchor, buckets)
    out = np.zeros(len(s.anchor), np.uint8)
    for b, body in answers.items():
        out[edges[b]:edges[b + 1]] = unpack(body)[0]
    return out


class HotStrings:
    """The distinct strings in a slab's pieces of hot anchors, in the order of two hashes, with the least document of each."""

    def __init__(self, s: Slab, state: np.ndarray):
        entry = np.flatnonzero(state == HOT)
        at, count = s.first[s.example[entry]], s.count[s.example[entry]]
        start, self.owner = ranges(at, count), np.repeat(entry, count)
        self.bit = (start - np.repeat(at, count)).astype(np.uint32)
        h, g = np.zeros(len(start), U64), np.ones(len(start), U64)
        for k in range(0, LENGTH, 8):
            word = np.zeros(len(start), U64)
            for i in range(k, min(k + 8, LENGTH)):
                word = word << U64(8) | s.data[start + i].astype(U64)
            h, g = mixed(h + word), mixed(g * U64(0x9E3779B97F4A7C15) ^ word)
        order = np.lexsort((s.least[self.owner], g, h))
        h, g = h[order], g[order]
        new = np.ones(len(order), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        self.string = np.empty(len(order), np.int64)  # of every occurrence
        self.string[order] = np.cumsum(new) - 1
        self.h, self.g, self.least = h[new], g[new], s.least[self.owner[order[new]]]


def _second_question(buckets: int):
    def question(slab, ids, texts, answers):
        s = Slab(ids, texts)
        state = _states(s, answers["first"], buckets)
        hot = HotStrings(s, state)
        edges = cut(hot.h, buckets)
        for b in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[b], edges[b + 1])
            yield buckets + b, pack(hot.h[part], hot.g[part], hot.least[part])
        entry = np.flatnonzero(state == COMPARE)
        at, count = s.first[s.example[entry]], s.count[s.example[entry]]
        edges = np.searchsorted(entry, cut(s.anchor, buckets))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[b], edges[b + 1])
            yield b, pack(count[part].astype(np.int32), s.least[entry[part]], s.data[ranges(at[part], count[part] + LENGTH - 1)])
    return question


def previous_factors(order: np.ndarray, common: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix with one of a smaller document.

    ``order`` is the suffix order, ``common[i]`` the common prefix of its entries i - 1 and i, ``doc`` the document of each suffix. The longest is
    at the nearest entry with a smaller document on either side, found for all entries at once in blocks of doubling size.
    """
    value, out = doc[order], np.zeros(len(order), np.int16)
    for value_, common_ in ((value, common), (value[::-1], np.concatenate([[0], common[:0:-1]]))):
        least, shared = [value_], [common_]
        while (1 << len(least)) <= len(order):
            step = 1 << (len(least) - 1)
            v, c = least[-1].copy(), shared[-1].copy()
            v[step:] = np.minimum(v[step:], least[-1][:-step])
            c[step:] = np.minimum(c[step:], shared[-1][:-step])
            least.append(v)
            shared.append(c)
        at, length = np.arange(len(order)) - 1, common_.copy()
        for level in range(len(least) - 1, -1, -1):
            fits = at - (1 << level) + 1 >= 0
            skip = fits & (least[level][np.maximum(at, 0)] >= value_)
            length = np.where(skip, np.minimum(length, shared[level][np.maximum(at, 0)]), length)
            at = np.where(skip, at - (1 << level), at)
        length = np.where(at >= 0, length, 0)
        out = np.maximum(out, length if value_ is value else length[::-1])
    back = np.empty(len(order), np.int16)
    back[order] = out
    return back


def common_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal leading bytes of two tables of big-endian words."""
    out, live = np.zeros(len(a), np.int16), np.ones(len(a), bool)
    for k in range(a.shape[1]):
        x = a[:, k] ^ b[:, k]
        equal = np.full(len(a), 8, np.int16)
        some = x != 0
        for byte in range(8):  # the first byte that differs
            equal[some & (x >> U64(56 - 8 * byte) > 0) & (equal == 8)] = byte
        out += np.where(live, equal, 0).astype(np.int16)
        live &= ~some
    return out


def _compare(slabs: list[int], bodies: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """Per slab and entry: bit i is set if string i of the piece starts in an earlier document too."""
    parts = [unpack(b) for b in bodies]
    sizes = [len(p[0]) for p in parts]
    count, least, data = (np.concatenate([p[k] for p in parts]) for k in range(3))
    count = count.astype(np.int64)
    begins = np.cumsum(count + LENGTH - 1) - (count + LENGTH - 1)
    start, piece = ranges(begins, count), np.repeat(np.arange(len(count)), count)
    # a string whose hash is not there twice has no equal: only the others are put in order
    sums = prefix_hashes(data)
    hashes = span_hashes(sums, start, start + LENGTH)
    by_hash = np.argsort(hashes)
    same = hashes[by_hash[1:]] == hashes[by_hash[:-1]]
    twice = np.zeros(len(start), bool)
    twice[by_hash[1:][same]] = twice[by_hash[:-1][same]] = True
    start, piece = start[twice], piece[twice]
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.zeros((len(start), -(-LENGTH // 8)), U64)
    for k in range(LENGTH):
        words[:, k // 8] |= raw[start + k].astype(U64) << U64(56 - 8 * (k % 8))
    order = np.lexsort(words.T[::-1])
    ordered = words[order]
    common = np.zeros(len(order), np.int16)
    common[1:] = np.minimum(common_bytes(ordered[1:], ordered[:-1]), LENGTH)
    doc = np.unique(least, return_inverse=True)[1].astype(np.int32)
    gone = previous_factors(order, common, doc[piece]) >= LENGTH if len(order) else np.zeros(0, bool)
    mask = np.zeros(len(count), np.uint32)
    bit = (start - begins[piece]).astype(np.uint32)
    np.bitwise_or.at(mask, piece[gone], np.uint32(1) << bit[gone])
    for slab, end, n in zip(slabs, np.cumsum(sizes), sizes):
        yield slab, pack(mask[end - n:end])


def _settle(slabs: list[int], bodies: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """The answers of a bucket of pieces or of a bucket of hot strings: of those, per string, 1 if another slab has it in an earlier document."""
    parts = [unpack(b) for b in bodies]
    if parts[0][0].dtype != U64:
        yield from _compare(slabs, bodies)
        return
    h, g, least = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.lexsort((g, h))
    new = np.concatenate([[True], (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]])])
    earliest = np.empty(len(order), np.int64)
    earliest[order] = np.minimum.reduceat(least[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    sizes = [len(p[0]) for p in parts]
    for slab, end, n in zip(slabs, np.cumsum(sizes), sizes):
        yield slab, pack((least > earliest)[end - n:end].astype(np.uint8))


def _covered(s: Slab, state: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which bytes of the slab go."""
    later = (state[s.entry] == LATER) | (s.ids[s.row] > s.least[s.entry])
    bits = np.where(later, np.uint32(0xFFFFFFFF), mask[s.entry])
    some = np.flatnonzero(bits)
    at, bits = ranges(s.first[some], s.count[some]), np.repeat(bits[some], s.count[some])
    bit = (at - np.repeat(s.first[some], s.count[some])).astype(np.uint32)
    at = at[(bits >> bit) & np.uint32(1) > 0]
    edge = np.zeros(len(s.data) + 1, np.int32)
    edge[at] += 1  # strings start at different bytes
    ends = at + LENGTH
    edge[ends] -= 1
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slab_bytes: int = SLAB_BYTES,
                   hot_pieces: int = HOT_PIECES) -> DataFrame:
    """Per document: doc_id, n_bytes, ``spans`` (ARRAY<STRUCT<start, end>> of removed bytes) and ``kept`` (the rest, BINARY)."""
    slabs = make_slabs(docs, id_col, text_col, slab_bytes)
    buckets = bucket_count(slabs)
    first = staged(answer(ask(slabs, _first_question(buckets)), lambda slabs, bodies: _who_is_first(slabs, bodies, hot_pieces)))
    second = staged(answer(ask(with_answers(slabs, first=first), _second_question(buckets), ["first"]), _settle))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, texts, answers in each_slab(batches, ["first", "second"]):
            s = Slab(ids, texts)
            state = _states(s, answers["first"], buckets)
            entry, mask = np.flatnonzero(state == COMPARE), np.zeros(len(state), np.uint32)
            edges = np.searchsorted(entry, cut(s.anchor, buckets))
            hot = HotStrings(s, state)
            places, earlier = cut(hot.h, buckets), np.zeros(len(hot.h), bool)
            for b, body in answers["second"].items():
                if b < buckets:
                    mask[entry[edges[b]:edges[b + 1]]] = unpack(body)[0]
                else:
                    earlier[places[b - buckets]:places[b - buckets + 1]] = unpack(body)[0]
            before = earlier[hot.string] | (hot.least[hot.string] < s.least[hot.owner])
            np.bitwise_or.at(mask, hot.owner[before], np.uint32(1) << hot.bit[before])
            gone = _covered(s, state, mask)
            kept, spans, sizes = [], [], []
            for a, z in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist()):
                here = gone[a:z]
                kept.append(s.data[a:z][~here].tobytes() if here.any() else s.data[a:z].tobytes())
                turns = np.flatnonzero(np.diff(here.astype(np.int8), prepend=0, append=0))
                spans.append([{"start": x, "end": y} for x, y in turns.reshape(-1, 2).tolist()])
                sizes.append(z - a)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                                              pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return with_answers(slabs, first=first, second=second).mapInArrow(
        apply, "doc_id bigint, n_bytes bigint, spans array<struct<start:int,end:int>>, kept binary")
