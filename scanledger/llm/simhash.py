"""SimHash near-duplicates by tiled exact comparison.

A document's fingerprint has bit b set if more than half of its shingles' 64-bit hashes have it set. Equal fingerprints are collapsed first, so
a group of exact copies is one fingerprint. The distinct fingerprints are cut into tiles of one population count and at most about ``TILE``
fingerprints. Two fingerprints that differ in r bits have population counts that differ by r at most, so a tile meets the tiles of
its own and the next ``radius`` counts and no others. Inside a pair of tiles the rows are ordered by the population counts of their four
16-bit quarters and compared in blocks by exclusive-or and bit count; blocks whose quarters differ by more than the radius in
sum are skipped. Nothing is approximated and no candidates are capped. A pair of tiles answers with a forest of links, never with
all pairs, and the forests are merged into components by joins.

The comparison remains quadratic in the number of distinct fingerprints, with a small factor; see the README for figures.

With a ``similarity``, fingerprints only propose: documents link if the sets of their shingles have that Jaccard similarity. Documents with equal sets are one node.
Members of a group of near fingerprints (``GROUP_RADIUS``) are first compared with ``CENTRES`` members of it, which is linear and joins most of a large group (bounds on
the common shingles, from the sizes of 256 cells of the sets, settle most of these pairs before texts are read); then
every pair of nodes within ``radius`` that is not joined yet is compared in two passes. The first tells each node in which parts of which tiles it has candidates, the second
sends the hashes of these nodes there, checks the pairs and answers with a forest of links. Neither gives out pairs. As bits of a similar pair are independent draws, the radius has to be far above their mean difference
(about 10 of 64 at a similarity of 0.8, with a deviation of 3): 22 bits leave out few such pairs. So wide a radius
lets many others pass, so a second fingerprint of 64 one-bit min-hashes must be near too (6.4 bits differ at 0.8, deviation 2.4; 18 are allowed).

Defined results: NULL and blank texts have fingerprint zero and link like any other; a document with fewer words than a shingle is
one shingle; a NULL id never names a component that has another id; repeated rows share a component; other columns
of the input are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from scanledger.staging import staged

from .arrays import LOWER, SPACED, chunks, mixed, ranges, text_bytes
from .components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
TILE = 1 << 15
BLOCK = 256
GROUP_RADIUS, CENTRES, CELLS = 8, 8, 256
SKETCH_RADIUS = 18
PARTS, PART_HASHES = 62, 1 << 20
ODD = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def spaced_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes in lower case with one blank after every word, starts and ends of the words in them, and words per row."""
    inside = SPACED[data]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    rows = offsets[1:][np.diff(offsets) > 0] - 1
    last[rows] = inside[rows]
    ends = np.cumsum(inside)[last]                      # in the words' bytes alone
    out = np.full(len(ends) + int(inside.sum()), 32, np.uint8)
    place = np.arange(int(inside.sum())) + np.searchsorted(ends, np.arange(int(inside.sum())), "right")
    out[place] = LOWER[data[inside]]
    ends = ends + np.arange(len(ends))
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    counts = np.diff(np.searchsorted(np.flatnonzero(last), offsets))
    return out, starts, ends, counts


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(64-bit hashes of the shingles, shingles per row) of runs of rows."""
    for _, _, part, offs in chunks(data, offsets):
        text, starts, ends, counts = spaced_words(part, offs)
        sizes = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
        base = np.cumsum(counts) - counts
        first = np.repeat(base - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        final = np.minimum(first + shingle, np.repeat(base + counts, sizes)) - 1
        raw, digest = text.tobytes(), xxhash.xxh64_intdigest
        yield np.fromiter((digest(raw[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[final].tolist())), np.uint64, len(first)), sizes


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One unsigned 64-bit fingerprint per row."""
    ones, some = np.zeros((len(sizes), 64), np.int64), np.flatnonzero(sizes)
    for a in range(0, len(some), 4096):
        rows = some[a:a + 4096]
        low, high = (np.cumsum(sizes) - sizes)[rows[0]], np.cumsum(sizes)[rows[-1]]
        bits = np.unpackbits(hashes[low:high, None].view(np.uint8), axis=1, bitorder="little")
        ones[rows] = np.add.reduceat(bits, (np.cumsum(sizes) - sizes)[rows] - low, axis=0, dtype=np.int64)
    bit = (2 * ones > sizes[:, None]).astype(np.uint8)
    return np.packbits(bit, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """One unsigned 64-bit fingerprint per row."""
    out = [majority_bits(*x) for x in shingle_hashes(data, offsets, shingle)]
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def least_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 bits per row: bit k is one of the least hash under the k-th of 64 orders. 0 for no shingles."""
    out, some = np.zeros(len(sizes), np.uint64), np.flatnonzero(sizes)
    if len(some):
        starts = (np.cumsum(sizes) - sizes)[some]
        for k, odd in enumerate(ODD):
            out[some] |= (mixed(np.minimum.reduceat(mixed(hashes ^ odd), starts)) & np.uint64(1)) << np.uint64(k)
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    for hashes, sizes in shingle_hashes(data, offsets, shingle):
        for part in np.split(hashes, np.cumsum(sizes)[:-1]):
            yield np.unique(part)


def with_fingerprint(docs: DataFrame, *, text_col: str = "text", name: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """The rows with their fingerprint as a BIGINT instead of the text."""
    own = [f for f in docs.schema.fields if f.name != text_col]
    schema = StructType([*own, StructField(name, LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = fingerprints(*text_bytes(batch.column(text_col)), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in own], pa.array(marks)], schema.names)

    return docs.mapInArrow(add, schema)


def forest(n: int, u: np.ndarray, v: np.ndarray, root: np.ndarray) -> None:
    """Joins the trees of u and v in ``root``, where every node points to the smallest of its tree."""
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root[root], root):
            root[:] = root[root]


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest of its tree) for all links between two tiles, or within one where ``right`` is None."""
    quarters = lambda x: np.bitwise_count(x.view(np.uint16).reshape(len(x), 4)).astype(np.int16)

    def ordered(x: np.ndarray):
        q = quarters(x)
        order = np.lexsort(q.T[::-1])
        x, q = x[order], q[order]
        edges = np.arange(0, len(x), BLOCK)
        return x, np.minimum.reduceat(q, edges, axis=0), np.maximum.reduceat(q, edges, axis=0)

    a, a_low, a_high = ordered(left)
    b, b_low, b_high = (a, a_low, a_high) if right is None else ordered(right)
    nodes = a if right is None else np.concatenate([a, b])
    shift = 0 if right is None else len(a)
    root = np.arange(len(nodes))
    for i in range(len(a_low)):
        gap = np.maximum(np.maximum(a_low[i] - b_high, b_low - a_high[i]), 0).sum(axis=1)
        near = np.flatnonzero(gap <= radius)
        if right is None:
            near = near[near >= i]
        mine = a[i * BLOCK:(i + 1) * BLOCK]
        for some in np.array_split(near, max(1, len(near) // 16)):
            if len(some):
                places = (some[:, None] * BLOCK + np.arange(BLOCK)).ravel()
                places = places[places < len(b)]
                bits = np.bitwise_count(mine[:, None] ^ b[places][None, :])
                if bits.min() <= radius:
                    x, y = np.nonzero(bits <= radius)
                    forest(len(nodes), x + i * BLOCK, places[y] + shift, root)
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[linked], nodes[root[linked]]


def pairs_of_tiles(marks: DataFrame, radius: int, tile: int, key: str = "fingerprint") -> DataFrame:
    """The rows of ``marks`` in every pair of tiles (a, b) that they meet; ``left`` are the rows of a. Rows with different ``key`` are spread over tiles."""
    columns = marks.columns
    counted = marks.withColumn("p", F.bit_count("fingerprint"))
    sizes = {r.p: r.n for r in counted.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}  # 65 rows at most
    tiles = {p: -(-n // tile) for p, n in sizes.items()}
    first = {p: sum(tiles[q] for q in tiles if q < p) for p in tiles}  # number of the first tile of a count
    per_count = lambda d, p: F.element_at(F.array(*[F.lit(int(d.get(q, 0))) for q in range(65)]), p + 1)
    mine = per_count(first, F.col("p")) + F.pmod(F.xxhash64(key), F.greatest(per_count(tiles, F.col("p")), F.lit(1))).cast("int")
    placed = counted.select(*columns, "p", mine.alias("t"))
    low, high = F.greatest(F.col("p") - radius, F.lit(0)), F.least(F.col("p") + radius, F.lit(64))
    # the tiles of near counts are numbered without a gap
    before = F.when(low > 0, per_count({q: first.get(q, sum(tiles[x] for x in tiles if x < q)) for q in range(65)}, low)).otherwise(F.lit(0))
    after = per_count({q: sum(tiles[x] for x in tiles if x <= q) for q in range(65)}, high)
    met = placed.select(*columns, "t", F.explode(F.sequence(before, after - 1)).alias("o"))
    return met.select(F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b"), (F.col("t") == F.least("t", "o")).alias("left"), *columns)


def links(marks: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(u, v): a forest that joins the distinct BIGINT fingerprints ``marks.fingerprint`` that differ in at most ``radius`` bits."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["left"].to_numpy()
        marks = pdf["fingerprint"].to_numpy().view(np.uint64)
        same = pdf["a"].iloc[0] == pdf["b"].iloc[0]
        none = pd.DataFrame({"u": np.empty(0, np.int64), "v": np.empty(0, np.int64)})
        if not same and (side.all() or not side.any()):
            return none
        u, v = tile_links(marks, None, radius) if same else tile_links(marks[side], marks[~side], radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return pairs_of_tiles(marks.select("fingerprint"), radius, tile).groupBy("a", "b").applyInPandas(compare, "u bigint, v bigint")


def near(x: dict, mine: np.ndarray, others: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of ``mine`` and ``others`` with different roots, fingerprints that differ in at most ``radius`` bits, near sketches and fit sizes."""
    p, q = np.nonzero(np.bitwise_count(x["sketch"][mine][:, None] ^ x["sketch"][others][None, :]) <= SKETCH_RADIUS)
    p, q = mine[p], others[q]
    n = x["n"]
    fit = (x["root"][p] != x["root"][q]) & (np.bitwise_count(x["fingerprint"][p] ^ x["fingerprint"][q]) <= radius)
    fit &= np.minimum(n[p], n[q]) >= similarity * np.maximum(n[p], n[q]) - 1e-6
    return p[fit], q[fit]


def sides(pdf: pd.DataFrame) -> tuple[dict, np.ndarray, np.ndarray, bool]:
    """The columns as arrays, and the places of both sides in order of size; one tile with itself has one side."""
    x = {c: pdf[c].to_numpy() for c in pdf.columns if c not in ("a", "b", "left")}
    for c in ("fingerprint", "sketch"):
        x[c] = x[c].view(np.uint64)
    left, same = pdf["left"].to_numpy(), pdf["a"].iloc[0] == pdf["b"].iloc[0]
    one, two = (np.arange(len(pdf)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
    return x, one[np.argsort(x["n"][one])], two[np.argsort(x["n"][two])], same


def near_nodes(nodes: DataFrame, radius: int, similarity: float, tile: int = TILE) -> DataFrame:
    """(a, b, left, node, sub, met, ones, others): the nodes of a pair of tiles that have a candidate in the other one, and in which of its ``PARTS`` parts (bits of
    ``met``); ``ones`` and ``others`` are the population counts of both tiles. A row for each node and pair of tiles at most, however many candidates it has.
    ``nodes`` has node, fingerprint, sketch, n, root and sub."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, one, two, same = sides(pdf)
        met, n, part = np.zeros(len(pdf), np.int64), x["n"], np.int64(1) << x["sub"].astype(np.int64)
        for i in range(0, len(one), BLOCK):
            mine = one[i:i + BLOCK]
            low, high = np.searchsorted(n[two], [n[mine[0]] * similarity - 1e-6, n[mine[-1]] / similarity + 1e-6])  # a block meets a range of sizes
            for j in range(max(low, i) if same else low, high, 16 * BLOCK):
                p, q = near(x, mine, two[j:min(j + 16 * BLOCK, high)], radius, similarity)
                np.bitwise_or.at(met, p, part[q])
                np.bitwise_or.at(met, q, part[p])
        ones = np.bitwise_count(x["fingerprint"]).astype(np.int32)
        others = np.where(pdf["left"], ones[two[0]], ones[one[0]]) if len(one) and len(two) else ones
        return pdf[["a", "b", "left", "node", "sub"]].assign(met=met, ones=ones, others=others)[met != 0]

    met = pairs_of_tiles(nodes.select("node", "fingerprint", "sketch", "n", "root", "sub"), radius, tile, "node")
    return met.groupBy("a", "b").applyInPandas(compare, "a int, b int, left boolean, node bigint, sub int, met bigint, ones int, others int")


def verified(pdf: pd.DataFrame, radius: int, similarity: float) -> pd.DataFrame:
    """(u, v): a forest of the pairs of rows with different roots whose sets of shingles (``hashes``) are similar; candidates as in ``near``."""
    x, one, two, same = sides(pdf)
    sizes = x["n"].astype(np.int64)
    _, words = np.unique(np.frombuffer(b"".join(x["hashes"]), np.uint64), return_inverse=True)
    begins = np.cumsum(sizes) - sizes
    marked, (_, tree) = np.zeros(len(words) + 1, np.int32), np.unique(x["root"], return_inverse=True)
    u, v = [], []
    blocks = [(i, j) for i in range(0, len(one), BLOCK) for j in range(i if same else 0, len(two), 16 * BLOCK)]
    for i, j in blocks:
        p, q = near(x, one[i:i + BLOCK], two[j:j + 16 * BLOCK], radius, similarity)
        order = np.argsort(p, kind="stable")
        p, q = p[order], q[order]
        for k in np.unique(p):
            others = q[np.searchsorted(p, k):np.searchsorted(p, k, "right")]
            others = others[(tree[others] != tree[k]) & (sizes[others] > 0)]
            if not len(others):
                continue
            mine = words[begins[k]:begins[k] + sizes[k]]
            marked[mine] = 1
            common = np.add.reduceat(marked[words[ranges(begins[others], sizes[others])]], np.cumsum(sizes[others]) - sizes[others])
            marked[mine] = 0
            for o in others[common >= similarity * (sizes[k] + sizes[others] - common) - 1e-9]:
                if tree[o] != tree[k]:
                    tree[tree == tree[o]] = tree[k]
                    u.append(x["node"][k])
                    v.append(x["node"][o])
    return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})


def with_hashes(rows: DataFrame, shingle: int) -> DataFrame:
    """The rows with the sorted hashes of their distinct shingles instead of ``text``."""
    own = [f for f in rows.schema.fields if f.name != "text"]
    schema = StructType([*own, *StructType.fromDDL("hashes binary")])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [one.tobytes() for one in shingle_sets(*text_bytes(batch.column("text")), shingle)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in own], pa.array(sets, pa.binary())], schema.names)

    return rows.mapInArrow(add, schema)


def similar_links(nodes: DataFrame, rows: DataFrame, *, shingle: int, radius: int, similarity: float, tile: int = TILE, part_hashes: int = PART_HASHES) -> DataFrame:
    """(u, v): forests that join all pairs of candidates with similar sets. ``nodes`` has node, rid, fingerprint, sketch, n and root; ``rows`` has rid and text.

    First the nodes with a candidate are found in each pair of tiles. The hashes of such nodes alone are sent to the pairs of tiles, and where a tile has more than
    ``part_hashes`` of them, to the pairs of its parts (``PARTS`` at most) where their candidates are; links are checked there."""
    nodes = nodes.withColumn("sub", F.pmod(F.xxhash64("node", F.lit("part")), F.lit(PARTS)).cast("int"))
    met = staged(near_nodes(nodes, radius, similarity, tile))
    needed = staged(nodes.join(met.select("node").distinct(), "node", "left_semi").drop("sub"))
    texts = rows.select("rid", "text").join(staged(needed.select("rid")), "rid", "left_semi")  # a table of known size: texts stay where they are while it is small
    sets = staged(with_hashes(texts, shingle).join(needed, "rid").drop("rid"))
    # at most 65 rows: hashes of needed nodes by population count, and how many tiles they are in
    sizes = {r.p: r.size for r in needed.groupBy(F.bit_count("fingerprint").alias("p")).agg(F.sum("n").alias("size")).collect()}
    tiles = {r.p: -(-r.n // tile) for r in nodes.groupBy(F.bit_count("fingerprint").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = F.array(*[F.lit(min(PARTS, max(1, -(-sizes.get(p, 0) // (tiles.get(p, 1) * part_hashes))))) for p in range(65)])
    coarse = lambda sub, ones: F.floor(sub * F.element_at(parts, F.col(ones) + 1) / PARTS).cast("int")
    bits = F.filter(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.col("met").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), k)) != 0)
    sent = met.select("a", "b", "left", "node", coarse(F.col("sub"), "ones").alias("mine"), F.explode(F.array_distinct(F.transform(bits, lambda k: coarse(k, "others")))).alias("o"))
    first = F.when(F.col("a") == F.col("b"), F.least("mine", "o")).when(F.col("left"), F.col("mine")).otherwise(F.col("o"))
    keyed = sent.select("a", "b", first.alias("x"), (F.col("mine") + F.col("o") - first).alias("y"), "left", "node").distinct().join(sets, "node")
    return keyed.groupBy("a", "b", "x", "y").applyInPandas(lambda pdf: verified(pdf.drop(columns=["x", "y"]), radius, similarity), "u bigint, v bigint")


def with_shingles(docs: DataFrame, shingle: int) -> DataFrame:
    """The rows, without their column ``text``, and its fingerprint, sketch (``least_bits``), node (a hash of the set of shingles), n (its size) and cells (sizes of its CELLS parts)."""
    own = [f for f in docs.schema.fields if f.name != "text"]
    schema = StructType([*own, *StructType.fromDDL("fingerprint bigint, sketch bigint, node bigint, n bigint, cells binary")])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, sketch, node, n, cells = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [], [], []
            for hashes, sizes in shingle_hashes(*text_bytes(batch.column("text")), shingle):
                marks.append(majority_bits(hashes, sizes))
                sketch.append(least_bits(hashes, sizes))
                for part in np.split(hashes, np.cumsum(sizes)[:-1]):
                    one = np.unique(part)
                    node.append(mixed(one).sum(dtype=np.uint64))
                    n.append(len(one))
                    many = np.bincount((one % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
                    cells.append(many.astype(np.uint8 if many.max() < 256 else np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in own], *[pa.array(np.concatenate(x).view(np.int64)) for x in (marks, sketch)], pa.array(np.array(node, np.uint64).view(np.int64)),
                                              pa.array(n, pa.int64()), pa.array(cells, pa.binary())], schema.names)

    return docs.mapInArrow(add, schema)


def similar_pairs(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of nodes whose sets of shingles have the Jaccard similarity. ``nodes`` has node, rid and cells; ``rows`` has rid and text."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("left"), batch.column("right")):
                a, b = (np.frombuffer(x, np.uint8 if len(x) == CELLS else np.uint32).astype(np.int64) for x in (a.as_py(), b.as_py()))
                common = int(np.minimum(a, b).sum())  # at most
                keep.append(common >= similarity * (int(a.sum()) + int(b.sum()) - common) - 1e-6)
            yield batch.select(["u", "v", "ru", "rv"]).filter(pa.array(keep, pa.bool_()))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(*(shingle_sets(*text_bytes(batch.column(c)), shingle) for c in ("left", "right"))):
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(common >= similarity * (len(a) + len(b) - common) - 1e-9)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    of = lambda k: nodes.select(F.col("node").alias(k), F.col("rid").alias(f"r{k}"), F.col("cells").alias({"u": "left", "v": "right"}[k]))
    named = pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "ru", "rv", "left", "right")
    may = staged(named.mapInArrow(possible, "u bigint, v bigint, ru bigint, rv bigint"))
    needed = staged(may.select(F.explode(F.array("ru", "rv")).alias("rid")).distinct())  # a table of known size: texts stay where they are while it is small
    texts = staged(rows.join(needed, "rid", "left_semi").select("rid", "text"))
    text = lambda k: texts.select(F.col("rid").alias(f"r{k}"), F.col("text").alias({"u": "left", "v": "right"}[k]))
    return may.join(text("u"), "ru").join(text("v"), "rv").select("u", "v", "left", "right").mapInArrow(check, "u bigint, v bigint")


def similar_roots(rows: DataFrame, *, shingle: int, radius: int, similarity: float, tile: int = TILE) -> DataFrame:
    """(node, root) for all nodes of the rows of ``with_shingles`` with a unique rid; linked nodes have one root."""
    nodes = staged(rows.groupBy("node").agg(F.min(F.struct("rid", "fingerprint", "sketch", "n", "cells")).alias("x")).select("node", "x.*"))
    groups = components(links(nodes.select("fingerprint").distinct(), min(GROUP_RADIUS, radius), tile))
    grouped = nodes.join(groups, nodes.fingerprint == groups.node, "left").select(nodes.node, F.coalesce(groups.root, nodes.fingerprint).alias("g"))
    grouped = staged(grouped)
    some = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node"))["node"].alias(f"c{k}") for k in range(CENTRES)]
    centres = grouped.groupBy("g").agg(F.count(F.lit(1)).alias("size"), *some).filter("size > 1")
    centres = centres.select("g", F.explode(F.array_distinct(F.array(*[f"c{k}" for k in range(CENTRES)]))).alias("c"))
    spokes = grouped.join(centres, "g").filter("node <> c").select(F.least("node", "c").alias("u"), F.greatest("node", "c").alias("v")).distinct()
    joined = staged(similar_pairs(spokes, nodes, rows, shingle, similarity))
    near = components(joined).withColumnRenamed("node", "_n")
    rooted = nodes.join(near, nodes.node == near._n, "left").select("node", "rid", "fingerprint", "sketch", "n", F.coalesce("root", "node").alias("root"))
    rest = staged(similar_links(staged(rooted), rows, shingle=shingle, radius=radius, similarity=similarity, tile=tile))
    last = components(joined.unionByName(rest)).withColumnRenamed("node", "_n")
    return nodes.select("node").join(last, F.col("node") == F.col("_n"), "left").select("node", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS,
                    tile: int = TILE, extra: dict[str, Column] | None = None) -> DataFrame:
    """Per document: doc_id, fingerprint (BIGINT) and component_id, the smallest id that is reachable over links. ``extra`` columns
    are computed from the documents and carried along."""
    extra = extra or {}
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[c.alias(k) for k, c in extra.items()])
    rows = staged(with_fingerprint(rows, shingle=shingle))
    marks = staged(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    roots = components(links(marks, radius, tile))
    root = F.coalesce("root", "fingerprint").alias("root")
    rooted = marks.join(roots, marks.fingerprint == roots.node, "left").select("fingerprint", root, "least")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(named, "root").select("fingerprint", "component_id"), "fingerprint").select("doc_id", "fingerprint", *extra, "component_id")


def hex_digits(fingerprint: Column) -> Column:
    """The 16 lowercase hex digits of a BIGINT fingerprint."""
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def drop_similar(docs: DataFrame, *, shingle: int, radius: int, similarity: float, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """One document, unchanged, of each component of documents whose sets of shingles are similar: the one with the smallest id and, of rows that share it,
    the smallest text hash. An id comes before no id."""
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), text_hash.alias("text_hash"), F.col(text_col).alias("text"))
    rows = staged(with_shingles(keyed.withColumn("rid", F.monotonically_increasing_id()), shingle))
    texts = rows.withColumn("text", F.col("row")[text_col])  # one copy of the text is staged
    roots = similar_roots(texts, shingle=shingle, radius=radius, similarity=similarity, tile=tile)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "rid"))["rid"].alias("rid")
    first = rows.select("node", "doc_id", "text_hash", "rid").join(roots, "node").groupBy("root").agg(best)
    return rows.join(first.select("rid"), "rid", "left_semi").select("row.*")
