"""Near duplicates by an LSH forest of MinHash signatures, confirmed on full shingle sets.

1. Every text gets its set of ``SHINGLE``-word shingles (as 64-bit hashes) and ``TREES * DEPTH`` minima. Texts with
   equal sets are one *class* from here on, with the smallest id; any number of copies costs one row.
2. Forest: each tree sorts the classes by its own sequence of minima. Neighbours in an order whose longest common
   prefix is ``SHALLOW`` minima or more make a region. In a region of up to ``REGION`` classes all pairs are compared by
   compact signatures (4 bits of each minimum): those that agree well enough for a similarity near the threshold are
   candidates, and a spanning star of each set of candidates is sent on, not its pairs. A larger region is taken
   deeper, by longer common prefixes, as far as it is crowded: neighbours there that differ in few minima are candidates,
   and one of them stands for the others, with how far they are.
3. What going deeper parts is not lost: those that are left of a crowded region (and of one that a cut of the sorted order
   runs through) meet again in blocks, each pair of blocks in its own task; how far the others are that one stands for is
   added to what may differ.
4. Connected candidates make candidate groups. The whole texts of a group meet in one task, a group of more than ``TILE``
   classes (or ``TILE_SHINGLES``) in blocks: first each block alone, then one text of each part that came out connected,
   and only where a group still has several parts, pairs of blocks. Full shingle sets decide every link; texts already
   connected need no test.
5. Connected components of the confirmed links.

A pair at similarity 0.8 meets in a region of at least one of 16 trees with probability
1 - (1 - 0.8**3)**16 > 0.99998, and passes the compact signature with probability > 0.99999.

Results in every case: texts without words have an empty set, n_shingles 0, and are their own component;
copies share a component; rows that share an id are taken as copies of one row; rows without an id are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.llm import sketch
from tsforge.llm.components import connected, stars
from tsforge.llm.tables import id_and_text, staged, tidy
from tsforge.llm.textcodes import BYTE_CODES, Ranges, mix, run_starts, slabs

SHINGLE, PERCENT = 4, 80
TREES, DEPTH, SHALLOW = 16, 8, 3
REGION, TILE, TILE_SHINGLES = 512, 2000, 4_000_000
#: Of more than FEW classes of a region in a batch, those at most NEAR minima from one are stood for by it; given up after VAIN that stand for none.
FEW, NEAR, VAIN = 4, 12, 32
_HOLD = 500_000
MINIMA = TREES * DEPTH
#: Equal 4-bit minima, of MINIMA, that make a candidate: 4.6 standard deviations below the mean at similarity 0.8.
AGREE = 84

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTORS = (mix(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFTS = (mix(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(32)).astype(np.uint32)


class Shingles:
    """Shingle hashes of the texts of a slab: ``codes`` of all texts in a row, ``at`` bounds each text's."""

    def __init__(self, slab, width: int = SHINGLE):
        s, e, bounds = slab.words()
        words = mix(Ranges(BYTE_CODES[_LOWER[slab.data]]).of(s, e) + (e - s).astype(np.uint64))
        ranges = Ranges(words)
        n_words = np.diff(bounds)
        start = np.flatnonzero(run_starts(bounds, width, len(words)))
        text = np.searchsorted(bounds, start, "right") - 1
        few = np.flatnonzero((n_words > 0) & (n_words < width))
        # a text of fewer words is one shingle; its length keeps it apart from others
        codes = np.concatenate([mix(ranges.of(start, start + width)), mix(ranges.of(bounds[few], bounds[few + 1]) + n_words[few].astype(np.uint64))])
        text = np.concatenate([text, few])
        order = np.argsort(text, kind="stable")
        self.codes, text = codes[order], text[order]
        self.at = np.searchsorted(text, np.arange(len(slab) + 1))
        key = mix(self.codes + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        first = np.ones(len(key), bool)
        first[order[1:]] = key[order][1:] != key[order][:-1]
        self.distinct = first if len(key) else np.zeros(0, bool)

    def _sums(self, values):
        total = np.append(np.uint64(0), np.cumsum(values, dtype=np.uint64))
        return total[self.at[1:]] - total[self.at[:-1]]

    def sizes(self) -> np.ndarray:
        return self._sums(self.distinct.astype(np.uint64)).astype(np.int64)

    def set_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each text's set, whatever the order of its shingles."""
        return tuple(self._sums(np.where(self.distinct, mix(self.codes ^ np.uint64(c)), 0)).view(np.int64)
                     for c in (0x243F6A8885A308D3, 0x13198A2E03707344))

    def minima(self) -> np.ndarray:
        """MINIMA values for each text (0 without shingles), spread over 32 bits."""
        out = np.zeros((len(self.at) - 1, MINIMA), np.uint32)
        some = np.flatnonzero(np.diff(self.at))
        if len(some):
            h = (self.codes >> np.uint64(32)).astype(np.uint32)
            low = self.codes.astype(np.uint32)
            for j in range(MINIMA):
                out[some, j] = np.minimum.reduceat((h ^ _SHIFTS[j]) * _FACTORS[j] + (low if j % 2 else h), self.at[some])
        return (out ^ (out >> np.uint32(15))) * np.uint32(0x2C1B3C6D)

    def set(self, i: int) -> np.ndarray:
        part = slice(self.at[i], self.at[i + 1])
        return np.sort(self.codes[part][self.distinct[part]])


def compact(minima: np.ndarray) -> np.ndarray:
    """Four bits of each minimum, one byte each."""
    return (minima >> np.uint32(28)).astype(np.uint8)


def signatures(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, h0, h1, minima binary) of every text."""

    def run(batches):
        for b in batches:
            for s in slabs(b.column("text")):
                sh = Shingles(s, width)
                h0, h1 = sh.set_hashes()
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(s.first, len(s)), pa.array(sh.sizes()), pa.array(h0), pa.array(h1),
                     pa.array([m.tobytes() for m in sh.minima()], pa.binary())], names=["doc_id", "n_shingles", "h0", "h1", "minima"])

    return docs.mapInArrow(tidy(run), "doc_id long, n_shingles long, h0 long, h1 long, minima binary")


def far(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """In how many minima each of ``many`` packed signatures (rows of 64-bit words) differs from ``one``; a metric."""
    x = many ^ one
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(1, dtype=np.int64)


def _thin(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, radius): of each signature one that stands for it, at most ``NEAR`` away, and how far those it stands for are."""
    first, radius = np.arange(len(packed)), np.zeros(len(packed), np.int32)
    left, vain = np.arange(len(packed)), 0
    while len(left) > 1 and vain < VAIN:
        d = far(packed[left[0]], packed[left[1:]])
        near = d <= NEAR
        first[left[1:][near]] = left[0]
        radius[left[0]] = d[near].max(initial=0)
        vain = 0 if near.any() else vain + 1
        left = left[1:][~near]
    return first, radius


def _compare(doc: np.ndarray, radius: np.ndarray, block: np.ndarray, packed: np.ndarray, reach: int):
    """Links that span the classes of a tile at most ``reach`` apart, and as much more as those they stand for are away.
    Of a tile of two blocks only pairs across are compared; each block has a tile of its own."""
    if block[0] != block[-1]:
        own, others = np.flatnonzero(block == block[0]), np.flatnonzero(block != block[0])
        pairs = ((i, others) for i in own)
    else:
        pairs = ((i, np.arange(i + 1, len(doc))) for i in range(len(doc) - 1))
    a, b, held = [], [], 0
    for i, js in pairs:
        near = js[far(packed[i], packed[js]) <= reach + radius[i] + radius[js]]
        if len(near):
            a.append(np.full(len(near), doc[i]))
            b.append(doc[near])
            held += len(near)
        if held > _HOLD:
            x, y = stars(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], 0
    return stars(np.concatenate(a), np.concatenate(b)) if a else None


def _spans(cuts: np.ndarray, n: int):
    """(begin, end) of the stretches that begin at 0 and behind each of ``cuts``."""
    at = np.append(0, np.flatnonzero(cuts) + 1)
    return zip(at.tolist(), np.append(at[1:], n).tolist(), strict=True)


def _deeper(keys: np.ndarray, begin: int, end: int, depth: int, region: int):
    """Stretches of neighbours with common prefixes as long as it takes for them to have no more than ``region`` rows."""
    if end - begin <= region or depth == DEPTH:
        yield from ((k, min(k + region, end)) for k in range(begin, end, region))
        return
    part = keys[begin:end, depth]
    for i, j in _spans(part[1:] != part[:-1], end - begin):
        yield from _deeper(keys, begin + i, begin + j, depth + 1, region)


def orders(classes: DataFrame) -> DataFrame:
    """(tree, key binary, doc_id, sign binary): each class in the sorted order of every tree; ``key`` sorts like its minima."""

    def run(batches):
        for b in batches:
            raw = [x.as_buffer() for x in b.column("minima")]
            if not raw:
                continue
            minima = np.stack([np.frombuffer(x, np.uint32) for x in raw])
            sign = compact(minima)
            packed = np.ascontiguousarray((sign[:, ::2] << 4) | sign[:, 1::2])
            signs = pa.array([x.tobytes() for x in packed], pa.binary())
            for t in range(TREES):
                keys = np.ascontiguousarray(minima[:, t * DEPTH:(t + 1) * DEPTH].astype(">u4"))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), t), pa.int32()), pa.array([x.tobytes() for x in keys], pa.binary()),
                                                  b.column("doc_id"), signs], names=["tree", "key", "doc_id", "sign"])

    return classes.mapInArrow(tidy(run), "tree int, key binary, doc_id long, sign binary")


def candidates(classes: DataFrame, region: int = REGION, agree: int = AGREE) -> DataFrame:
    """(a, b): links that connect all classes that meet in some region and whose signatures agree, and maybe more."""
    reach = MINIMA - agree

    def walk(batches):
        """A stretch of the sorted orders: links, and what is left of crowded and cut regions."""
        tree = keys = ids = packed = None
        first = True

        def settled(ready: int, last: bool):
            """The regions among the first ``ready`` rows; the first and the last one of a stretch may go on outside of it."""
            nonlocal first
            a, b, rest = [], [], []
            new = (tree[1:ready] != tree[:ready - 1]) | (keys[1:ready, :SHALLOW] != keys[:ready - 1, :SHALLOW]).any(1)
            spans = list(_spans(new, ready))
            for n, (i, j) in enumerate(spans):
                cut = (first and n == 0) or (last and n == len(spans) - 1)
                if not cut and j - i <= region:
                    if j - i > 1 and (out := _compare(ids[i:j], np.zeros(j - i, np.int32), np.zeros(j - i, np.int32), packed[i:j], reach)) is not None:
                        a.append(out[0])
                        b.append(out[1])
                    continue
                name = int(mix(mix(keys[i:i + 1, :SHALLOW].astype(np.uint64) @ np.array([[1], [1 << 20], [1 << 40]], np.uint64)[:SHALLOW])[0]
                               + np.uint64(tree[i]))[0].view(np.int64))
                for x, y in _deeper(keys, i, j, SHALLOW, region):
                    stands, radius = _thin(packed[x:y]) if y - x > FEW else (np.arange(y - x), np.zeros(y - x, np.int32))
                    own = stands == np.arange(y - x)
                    a.append(ids[x:y][~own])
                    b.append(ids[x:y][stands[~own]])
                    rest.append((np.full(own.sum(), name), ids[x:y][own], radius[own], packed[x:y][own]))
            first = first and ready == 0
            out = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b)]
            left = [np.concatenate(x) for x in zip(*rest, strict=True)] if rest else [np.zeros(0, np.int64)] * 3 + [np.zeros((0, MINIMA // 16), np.uint64)]
            n, m = len(out[0]), len(left[0])
            none = lambda k, t: pa.nulls(k, t)
            if n or m:
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([pa.array(out[0]), none(m, pa.int64())]), pa.concat_arrays([pa.array(out[1]), none(m, pa.int64())]),
                     pa.concat_arrays([none(n, pa.int64()), pa.array(left[0].astype(np.int64))]), pa.concat_arrays([none(n, pa.int64()), pa.array(left[1])]),
                     pa.concat_arrays([none(n, pa.int32()), pa.array(left[2].astype(np.int32))]),
                     pa.concat_arrays([none(n, pa.binary()), pa.array([x.tobytes() for x in left[3]], pa.binary())])],
                    names=["a", "b", "region", "doc_id", "radius", "sign"])

        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = (batch.column("tree").to_numpy(), np.frombuffer(b"".join(batch.column("key").to_pylist()), ">u4").reshape(-1, DEPTH),
                     batch.column("doc_id").to_numpy(), np.frombuffer(b"".join(batch.column("sign").to_pylist()), np.uint64).reshape(-1, MINIMA // 16))
            tree, keys, ids, packed = fresh if tree is None else (np.concatenate(x) for x in zip((tree, keys, ids, packed), fresh, strict=True))
            new = np.flatnonzero((tree[1:] != tree[:-1]) | (keys[1:, :SHALLOW] != keys[:-1, :SHALLOW]).any(1))
            if len(new):  # the last region may go on in the next batch
                ready = int(new[-1]) + 1
                yield from settled(ready, False)
                tree, keys, ids, packed = tree[ready:], keys[ready:], ids[ready:], packed[ready:]
        if tree is not None:
            yield from settled(len(tree), True)

    def links(batches):
        now, held = None, []

        def done():
            doc, radius, block = (np.array([x[k] for x in held]) for k in range(3))
            order = np.argsort(block, kind="stable")
            packed = np.stack([np.frombuffer(held[i][3], np.uint64) for i in order])
            return _compare(doc[order], radius[order], block[order], packed, reach)

        for b in batches:
            keys = zip(*(b.column(c).to_pylist() for c in ("region", "x", "y")), strict=True)
            for k, row in zip(keys, zip(*(b.column(c).to_pylist() for c in ("doc_id", "radius", "block", "sign")), strict=True), strict=True):
                if k != now:
                    if len(held) > 1 and (out := done()) is not None:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["a", "b"])
                    now, held = k, []
                held.append(row)
        if len(held) > 1 and (out := done()) is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["a", "b"])

    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    walked = staged(orders(classes).repartitionByRange(n, "tree", "key").sortWithinPartitions("tree", "key", "doc_id")
                    .mapInArrow(tidy(walk), "a long, b long, region long, doc_id long, radius int, sign binary"), "walked")
    rest = walked.where("region IS NOT NULL").select("region", "doc_id", "radius", "sign")
    crowded = staged(rest.groupBy("region").agg(F.count("*").alias("n")).where("n > 1")
                     .select("region", F.ceil(F.col("n") / region).cast("int").alias("blocks")), "crowded")
    placed = rest.join(crowded, "region").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = placed.select("region", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "doc_id", "radius", "block", "sign")
    across = tiles.repartition(n, "region", "x", "y").sortWithinPartitions("region", "x", "y", "doc_id").mapInArrow(tidy(links), "a long, b long")
    return walked.where("a IS NOT NULL").select("a", "b").unionByName(across)


def confirm(part: np.ndarray, block: np.ndarray, sets: list[np.ndarray], packed: np.ndarray, percent: int, reach: int) -> np.ndarray:
    """The least part that each text is connected with by full sets. Texts of one ``part``, or already connected, are not
    tested; of the texts that another may be linked with, each connected part's nearest is tested first, so copies take
    one test. Of two blocks only pairs across are tested; each block has a tile of its own."""
    names, root = np.unique(part, return_inverse=True)  # roots are numbers of parts
    size = np.array([len(x) for x in sets])
    begin = np.append(0, np.cumsum(size))
    codes, place = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(codes), bool)
    alone = block.min() == block.max()
    for i in range(1, len(part)):
        may = root[:i] != root[i]
        near = np.flatnonzero(may if alone else may & (block[:i] != block[i]))
        d = far(packed[i], packed[near])
        likely = (d <= reach) & (100 * np.minimum(size[near], size[i]) >= percent * np.maximum(size[near], size[i]))
        near = near[likely][np.argsort(d[likely], kind="stable")]
        if not len(near):
            continue
        own = place[begin[i]:begin[i + 1]]
        mark[own] = True
        turn = np.zeros(len(near), bool)
        turn[np.unique(root[near], return_index=True)[1]] = True
        for these in (near[turn], near[~turn]):  # the nearest of each part, then the others of parts still apart
            these = these[root[these] != root[i]]
            if not len(these):
                continue
            both = np.add.reduceat(mark[np.concatenate([place[begin[j]:begin[j + 1]] for j in these.tolist()])],
                                   np.cumsum(size[these]) - size[these], dtype=np.int64)
            for j in these[100 * both >= percent * (size[these] + size[i] - both)].tolist():
                if root[j] != root[i]:
                    low, high = sorted((root[i], root[j]))
                    root[root == high] = low
        mark[own] = False
    return names[root]


def tested(tiles: DataFrame, docs: DataFrame, width: int, percent: int, agree: int) -> DataFrame:
    """(a, b): of the parts that a tile's texts, from (doc_id, component, x, y, part, block), connect, each with the least."""
    # only texts that may be in a tile are shuffled: a sketch of the ids, of bounded size, lets the others go
    ids_of = lambda b: iter([b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.uint64)])
    wanted = docs.sparkSession.sparkContext.broadcast(
        sketch.build(tiles.select("doc_id"), ids_of, sketch.log2_cells(tiles.count()), least=1))

    def grouped(batches):
        for b in batches:
            yield b.filter(pa.array(wanted.value.may_repeat(b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.uint64))))

    texts = tiles.join(docs.mapInArrow(tidy(grouped), docs.schema), "doc_id").select("component", "x", "y", "doc_id", "part", "block", "text")

    def run(batches):
        now, held = None, []

        def done():
            if len({x[1] for x in held}) < 2:
                return None
            held.sort(key=lambda x: x[0])
            sign = np.stack([x[3] for x in held])
            packed = np.ascontiguousarray((sign[:, ::2] << 4) | sign[:, 1::2]).view(np.uint64)
            part = np.array([x[1] for x in held])
            least = confirm(part, np.array([x[4] for x in held]), [x[2] for x in held], packed, percent, MINIMA - agree)
            star = np.unique(np.stack([part, least])[:, part != least], axis=1)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in star], names=["a", "b"])

        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in ("component", "x", "y")), strict=True))
            ids, parts, blocks = (b.column(c).to_pylist() for c in ("doc_id", "part", "block"))
            for s in slabs(b.column("text")):
                sh = Shingles(s, width)
                signs = compact(sh.minima())
                for i in range(len(s)):
                    if keys[s.first + i] != now:
                        if held and (out := done()) is not None:
                            yield out
                        now, held = keys[s.first + i], []
                    held.append((ids[s.first + i], parts[s.first + i], sh.set(i), signs[i], blocks[s.first + i]))
        if held and (out := done()) is not None:
            yield out

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.repartition(n, "component", "x", "y").sortWithinPartitions("component", "x", "y", "doc_id").mapInArrow(tidy(run), "a long, b long")


def _blocks(placed: DataFrame, tile: int) -> DataFrame:
    """(doc_id, component, part, n_shingles) with ``blocks``, how many its group is dealt over, and ``block``, its own."""
    size = placed.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum("n_shingles") / TILE_SHINGLES)).cast("int").alias("blocks"))
    return placed.join(size, "component").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))


def _pairs_of_blocks(blocks: DataFrame, across: bool) -> DataFrame:
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = blocks.withColumn("other", other).select("doc_id", "component", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "part", "block")
    return tiles.where("x < y") if across else tiles


def confirmed(groups: DataFrame, docs: DataFrame, width: int, percent: int, agree: int, tile: int) -> DataFrame:
    """(a, b): confirmed links from (doc_id, component, n_shingles) of candidate groups and the texts."""
    blocks = staged(_blocks(groups.withColumn("part", F.col("doc_id")), tile), "blocks")
    alone = blocks.select("doc_id", "component", F.col("block").alias("x"), F.col("block").alias("y"), "part", "block")
    links = staged(tested(alone, docs, width, percent, agree), "links-alone")
    large = blocks.where("blocks > 1")
    if large.isEmpty():
        return links
    # one text of each part that came out connected speaks for it first; each text was in one tile, so links are stars
    large = staged(_in_parts(large, links), "parts")
    speakers = staged(_blocks(large.where("doc_id = part").drop("blocks", "block"), tile), "speakers")
    merged = staged(tested(_pairs_of_blocks(speakers, False), docs, width, percent, agree), "links-speakers")
    links = links.unionByName(merged)
    if not speakers.where("blocks > 1").isEmpty():
        merged = connected(merged).toDF("a", "b")
    large = staged(_in_parts(large, merged), "parts")
    several = large.groupBy("component").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("component")
    left = staged(large.join(several, "component", "left_semi"), "left")
    if left.isEmpty():
        return links
    return links.unionByName(tested(_pairs_of_blocks(left, True), docs, width, percent, agree))


def _in_parts(rows: DataFrame, stars: DataFrame) -> DataFrame:
    """``rows`` with the part that ``stars`` (a, b) connects theirs with."""
    return rows.join(stars.withColumnsRenamed({"a": "part", "b": "least"}), "part", "left").withColumn("part", F.coalesce("least", "part")).drop("least")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT,
                    region: int = REGION, agree: int = AGREE, tile: int = TILE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    ``percent`` may rise above 80 as it is; a lower one needs a lower ``agree``.
    """
    docs = id_and_text(df, id_col, text_col)
    sig = staged(signatures(docs, width), "signatures")
    some = sig.where("n_shingles > 0")
    classes = some.groupBy("h0", "h1").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    classes = staged(classes, "classes")
    firsts = staged(some.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "n_shingles", "minima"), "firsts")
    groups = connected(candidates(firsts, region, agree)).withColumnRenamed("id", "doc_id")
    groups = staged(groups.join(firsts.select("doc_id", "n_shingles"), "doc_id"), "groups")
    parts = connected(confirmed(groups, docs, width, percent, agree, tile))
    return sig.where("n_shingles > 0").drop("minima").join(classes.where("copies > 1").drop("copies"), ["h0", "h1"], "left") \
        .withColumn("class_id", F.coalesce("class_id", "doc_id")) \
        .join(parts.withColumnRenamed("id", "class_id"), "class_id", "left") \
        .select("doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id")) \
        .unionByName(sig.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))) \
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
