"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors at cosine >= ``least`` are at most eps = sqrt(2 - 2 * least) apart, and so are their projections.
1. The leading ``DIMENSIONS`` principal directions come from one distributed sum of outer products.
2. Vectors are ordered by the cells of width eps that they occupy on those directions (epsilon grid order).
   The occupied cells are counted; their number is bounded by the grid, not by the rows. The order is cut into at
   most ``MAX_BLOCKS`` blocks of equal size; a cell with more vectors than a block holds is parted by its sides of the
   mean on further directions, and what is still too large is spread over several blocks.
3. Sequence intervals are joined recursively: two intervals whose cells are provably further apart than eps
   on the principal directions are skipped, others are halved until they are blocks. This works on the blocks'
   bounds alone.
4. Every vector goes to its block once, as it was given, and blocks are staged as pieces: a row holds the ids and
   vectors of at most ``PIECE_BYTES``, in tiles of vectors near each other, each with a centre and a radius. Strips are
   folders of neighbouring pieces of ``STRIP_BYTES`` to twice as much. Pairs of pieces are read from the staged strips by a nested
   loop, and are neither shuffled nor written: disk grows with the vectors, not with the pairs. Pairs of strips without
   a remaining pair of blocks are not read.
5. The remaining pairs of blocks are first read without their vectors: pairs whose tiles are all further apart than eps go.
   Then, in each pair of pieces, tiles too far apart are skipped, tiles that link throughout are counted whole, and of
   others products in single precision sort out what is clearly on one side of the threshold, and the rest is decided
   in double precision. A task returns link counts and a spanning star for each local component, so its links are
   never listed.
6. Counts are added up and connected components found on the stars.

Results in every case: vectors that are null, zero, of another length than most, or hold null or non-finite
components link with nothing and are their own component; equal vectors link; rows that share an id are
linked like different vectors and give one row; rows without an id are left out.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.llm.components import connected, stars
from tsforge.llm.tables import bounded_batches, tidy
from tsforge.llm.textcodes import mix
from tsforge.session import remove_path, shared_path, staged_table

LEAST = 0.9
DIMENSIONS = 6
#: Further directions that part large cells, in two.
_SIDES = 24
#: Vectors of a block, at least, and the most blocks (so the bounds on the driver and in broadcasts stay small).
BLOCK, MAX_BLOCKS = 6000, 2048
#: Vectors as given: of a piece (a row on the way to Python), and of a strip (what a task holds of the second side).
PIECE_BYTES, STRIP_BYTES = 2 << 20, 32 << 20
#: Strips that one job joins with their partners; up to so many strips in all a strip is also dealt to several tasks.
_AT_ONCE, _FEW = 16, 4
_HOLD = 500_000
_SPAN = 64
#: Vectors multiplied at once, and vectors of a tile unless they are very near each other.
_TILE, _NEAR = 512, 128
#: Single precision is trusted further than this from the threshold.
_DOUBT = 1e-4


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x width in double precision, flags of usable rows) of a list column."""
    out, ok = np.zeros((len(column), width)), np.zeros(len(column), bool)
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(lengths == width)
    if len(right):
        values = column.take(pa.array(right)).flatten().cast(pa.float64())
        x = values.to_numpy(zero_copy_only=False).reshape(-1, width)  # a null component is NaN
        good = np.isfinite(x).all(1) & (x != 0).any(1)
        out[right[good]], ok[right[good]] = x[good], True
    return out, ok


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)
    x = x / np.where(scale > 0, scale, 1)  # no overflow or underflow in the squares
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def principal(vectors: DataFrame, width: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading principal directions, as columns, and the mean: each task sends one sum of width x width numbers."""

    def run(batches):
        n, total, outer = 0, np.zeros(width), np.zeros((width, width))
        for b in batches:
            x, ok = _matrix(b.column("v"), width)
            u = unit(x[ok])
            n, total, outer = n + len(u), total + u.sum(0), outer + u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()]), pa.array([outer.ravel().tolist()])], names=["n", "total", "outer"])

    def add(batches):
        n, total, outer = 0, np.zeros(width), np.zeros(width * width)
        for b in batches:
            for i in range(len(b)):
                n, total, outer = n + b.column("n")[i].as_py(), total + b.column("total")[i].values.to_numpy(), outer + b.column("outer")[i].values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()]), pa.array([outer.tolist()])], names=["n", "total", "outer"])

    sums = "n long, total array<double>, outer array<double>"
    n, total, outer = 0, np.zeros(width), np.zeros((width, width))
    for r in vectors.mapInArrow(tidy(run), sums).repartition(8).mapInArrow(tidy(add), sums).toLocalIterator():  # else one task at a time reads the vectors
        n, total, outer = n + r.n, total + np.array(r.total), outer + np.array(r.outer).reshape(width, width)
    mean = total / max(n, 1)
    _, directions = np.linalg.eigh(outer / max(n, 1) - np.outer(mean, mean))
    return np.round(directions[:, ::-1][:, :min(dimensions, width)], 9), np.round(mean, 9)  # the same whatever the order of the sums


def cut_blocks(cells: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first block, number of blocks) of each cell in grid order, and (lowest, highest) cell bounds of each block."""
    first, many = np.zeros(len(cells), np.int64), np.ones(len(cells), np.int64)
    low, high, held, block = [], [], 0, -1
    for i, (cell, n) in enumerate(zip(cells, counts.tolist(), strict=True)):
        if n > size:  # a cell of its own, spread by a hash
            many[i] = -(-n // size)
            first[i] = block + 1
            block += int(many[i])
            low += [cell] * int(many[i])
            high += [cell] * int(many[i])
            held = size
            continue
        if block < 0 or held + n > size:
            block, held = block + 1, 0
            low.append(cell)
            high.append(cell)
        first[i], held = block, held + n
        low[block], high[block] = np.minimum(low[block], cell), np.maximum(high[block], cell)
    return first, many, np.array(low), np.array(high)


def join_intervals(low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of blocks (i <= j) whose cells may hold vectors within one cell width of each other."""
    out, todo = [], [((0, len(low)), (0, len(low)))] if len(low) else []

    def apart(a, b):
        gap = np.maximum(0, np.maximum(low[a[0]:a[1]].min(0) - high[b[0]:b[1]].max(0), low[b[0]:b[1]].min(0) - high[a[0]:a[1]].max(0)) - 1)
        return (gap * gap).sum() > 1  # in cell widths, that is, in eps

    while todo:
        a, b = todo.pop()
        if a != b and apart(a, b):
            continue
        if max(a[1] - a[0], b[1] - b[0]) <= _SPAN:  # the blocks of both, each with each
            la, ha, lb, hb = low[a[0]:a[1], None], high[a[0]:a[1], None], low[None, b[0]:b[1]], high[None, b[0]:b[1]]
            gap = np.maximum(0, np.maximum(la - hb, lb - ha) - 1)
            i, j = np.nonzero((gap * gap).sum(2) <= 1)
            i, j = i + a[0], j + b[0]
            out += zip(i[i <= j].tolist(), j[i <= j].tolist(), strict=True)
        elif a == b:
            m = (a[0] + a[1]) // 2
            todo += [((a[0], m), (a[0], m)), ((a[0], m), (m, a[1])), ((m, a[1]), (m, a[1]))]
        elif a[1] - a[0] >= b[1] - b[0]:
            m = (a[0] + a[1]) // 2
            todo += [((a[0], m), b), ((m, a[1]), b)]
        else:
            m = (b[0] + b[1]) // 2
            todo += [(a, (b[0], m)), (a, (m, b[1]))]
    return out


def _raw(x: np.ndarray, kind: str) -> pa.Array:
    """A binary value for each row."""
    x = np.ascontiguousarray(x, kind)
    ends = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x.tobytes())])


def cut_strips(rows: np.ndarray, row_bytes: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first strip, number of strips) of each block, in order: whole blocks up to ``most`` bytes, and a larger block over several."""
    first, many, strip, held = np.zeros(len(rows), np.int64), np.ones(len(rows), np.int64), -1, 0
    for i, size in enumerate((rows * row_bytes).tolist()):
        if strip < 0 or held + size > most:
            strip, held = strip + 1, 0
        first[i], many[i] = strip, max(1, -(-size // most))
        strip, held = strip + int(many[i]) - 1, held + size if many[i] == 1 else most
    return first, many


def _halves(u: np.ndarray) -> np.ndarray:
    """Flags of the rows nearer to one of two distant groups; by the median where one would be very small."""
    p = u[((u - u.mean(0)) ** 2).sum(1).argmax()]
    q = u[((u - p) ** 2).sum(1).argmax()]
    for _ in range(2):
        along = u @ (p - q)
        side = along > (p + q) @ (p - q) / 2
        if not 0 < side.sum() < len(u):
            break
        p, q = u[side].mean(0), u[~side].mean(0)
    if min(side.sum(), (~side).sum()) < len(u) // 20:
        side = np.zeros(len(u), bool)
        side[np.argsort(along, kind="stable")[len(u) // 2:]] = True
    return side


def _groups(u: np.ndarray, tight: float) -> list[np.ndarray]:
    """The rows in groups within ``tight`` of their first row, if that makes them four rows on average at least; else all rows."""
    near, left, out = 2 - 2 * (u @ u.T) <= tight * tight, np.ones(len(u), bool), []
    while left.any():
        if 4 * len(out) >= len(u):
            return [np.arange(len(u))]
        first = left.argmax()
        now = near[first] & left
        now[first] = True
        out.append(np.flatnonzero(now))
        left &= ~now
    return out


def cut_tiles(u: np.ndarray, tight: float) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, rows of each tile): tiles of at most ``_TILE`` rows within ``tight`` of their centre, and of others at
    most ``_NEAR``, or the groups of near rows in them."""
    out, todo, u = [], [np.arange(len(u))], u.astype(np.float32)
    while todo:
        rows = todo.pop()
        part = u[rows]
        if ((part - part.mean(0)) ** 2).sum(1).max() <= tight * tight:
            out += np.array_split(rows, -(-len(rows) // _TILE))
        elif len(rows) <= _NEAR:
            out += [rows[g] for g in _groups(part, tight)]
        else:
            side = _halves(part)
            todo += [rows[side], rows[~side]]
    return np.concatenate(out), np.array([len(x) for x in out], np.int32)


def balls(u: np.ndarray, tiles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centre, radius) of each tile, in single precision: no row of it is further from the centre than that."""
    centres = (np.add.reduceat(u, np.cumsum(tiles) - tiles, 0) / tiles[:, None]).astype(np.float32)
    far = np.sqrt(((u - np.repeat(centres.astype(float), tiles, 0)) ** 2).sum(1))
    return centres, (np.maximum.reduceat(far, np.cumsum(tiles) - tiles) * (1 + 1e-6) + 1e-6).astype(np.float32)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(float), b.astype(float)
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T))


class Piece:
    """Vectors as given, by tiles, and the links that each has so far."""

    def __init__(self, ids, x, tiles, centres, radii):
        self.ids, self.x, self.tiles, self.centres, self.radii = ids, x, tiles, centres, radii
        self.u32 = unit(x.astype(float)).astype(np.float32)
        self.n = np.zeros(len(ids), np.int64)
        self.first = np.cumsum(tiles) - tiles


def _linked(a: Piece, b: Piece, rows: np.ndarray, cols: np.ndarray, least: float) -> list:
    s = a.u32[rows] @ b.u32[cols].T
    if s.size == 0 or s.max() < least - _DOUBT:
        return []
    x, y = np.nonzero(s >= least - _DOUBT)
    link = s[x, y] >= least + _DOUBT
    x, y = rows[x], cols[y]
    doubt = np.flatnonzero(~link)
    if len(doubt):
        link[doubt] = np.einsum("ij,ij->i", unit(a.x[x[doubt]].astype(float)), unit(b.x[y[doubt]].astype(float))) >= least
    if a is b:
        link &= y > x
    x, y = x[link], y[link]
    a.n += np.bincount(x, minlength=len(a.n))
    b.n += np.bincount(y, minlength=len(b.n))
    return [stars(a.ids[x], b.ids[y])] if len(x) else []


def join_pieces(a: Piece, b: Piece, least: float) -> list:
    """Stars of the pairs at cosine >= ``least``; their links are added to ``n``. A piece joins itself, each pair once."""
    apart, reach = _distances(a.centres, b.centres), a.radii[:, None].astype(float) + b.radii
    near = apart <= reach + math.sqrt(2 - 2 * least) + 1e-5
    full = apart + reach <= math.sqrt(max(0, 2 - 2 * least - 2 * _DOUBT)) - 1e-5  # all pairs of such tiles link
    if a is b:
        near, full = np.triu(near), np.triu(full)
    found = []
    if full.any():
        own = np.diag(np.diag(full)) if a is b else np.zeros_like(full)
        others = (full & ~own).astype(np.int64)
        a.n += np.repeat(others @ b.tiles, a.tiles)
        b.n += np.repeat(a.tiles @ others, b.tiles)
        if a is b:
            a.n += np.repeat(np.diag(full) * (a.tiles - 1), a.tiles)
        x, y = np.nonzero(full)
        links = [(a.ids[a.first[x]], b.ids[b.first[y]])]
        for p, some in ((a, full.any(1)), (b, full.any(0))):  # rows of a tile are connected, each by the other tile's
            rows = np.repeat(some, p.tiles)
            links.append((p.ids[rows], np.repeat(p.ids[p.first], p.tiles)[rows]))
        found.append(stars(*(np.concatenate(z) for z in zip(*links, strict=True))))
    near &= ~full
    if not full.any() and a.tiles @ near @ b.tiles > len(a.ids) * len(b.ids) / 4:
        for i in range(0, len(a.ids), _TILE):
            for j in range(i if a is b else 0, len(b.ids), _TILE):
                found += _linked(a, b, np.arange(i, min(i + _TILE, len(a.ids))), np.arange(j, min(j + _TILE, len(b.ids))), least)
        return found
    for i in np.flatnonzero(near.any(1)).tolist():
        cols = np.flatnonzero(np.repeat(near[i], b.tiles))
        rows = np.arange(a.first[i], a.first[i] + a.tiles[i])
        for j in range(0, len(cols), 4 * _TILE):
            found += _linked(a, b, rows, cols[j:j + 4 * _TILE], least)
    return found


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST,
                    dimensions: int = DIMENSIONS, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    spark = df.sparkSession
    bounded_batches(spark)
    vectors = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where("vec_id IS NOT NULL")
    widths = vectors.where("v IS NOT NULL AND size(v) > 0").groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    alone = vectors.select("vec_id").distinct()
    nothing = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if widths is None:
        return nothing
    width, eps = widths.w, math.sqrt(2 - 2 * least) * (1 + 1e-9)
    directions, mean = principal(vectors, width, dimensions + _SIDES)
    directions, further = directions[:, :dimensions], directions[:, dimensions:]
    names, bits = [f"c{k}" for k in range(directions.shape[1])], further.shape[1]

    kind = "<f4" if vectors.schema["v"].dataType.elementType.typeName() == "float" else "<f8"  # vectors are staged as given

    def cells(batches):
        for b in batches:
            x, ok = _matrix(b.column("v"), width)
            u = unit(x[ok])
            cell = np.floor(u @ directions / eps).astype(np.int64)
            side = ((u - mean) @ further > 0) @ (1 << np.arange(bits)[::-1])
            yield pa.RecordBatch.from_arrays([b.column("vec_id").filter(pa.array(ok)), *(pa.array(c) for c in cell.T), pa.array(side.astype(np.int64)), _raw(x[ok], kind)],
                                             names=["vec_id", *names, "side", "x"])

    placed, given = staged_table(vectors.mapInArrow(tidy(cells), "vec_id long, " + ", ".join(f"{c} long" for c in names) + ", side long, x binary"), "llm-vectors")
    # at most (2 / eps + 2) ** dimensions cells, however many rows
    counted = placed.groupBy(*names).count().orderBy(*names).toArrow()
    grid = np.stack([counted[c].to_numpy() for c in names], 1)
    counts = counted["count"].to_numpy()
    if not len(counts):
        return nothing
    size = max(block, math.ceil(2 * counts.sum() / MAX_BLOCKS))
    # so many of a large cell's sides are looked at that its parts are about a quarter of a block: a few for each block
    drop = np.where(counts > size, np.maximum(0, bits - 2 - np.ceil(np.log2(np.maximum(1, counts / size))).astype(int)), bits)
    sides = np.zeros(len(counts), np.int64)
    if (drop < bits).any():
        large = spark.createDataFrame([(*c, d) for c, d in zip(grid[drop < bits].tolist(), drop[drop < bits].tolist(), strict=True)], ", ".join(f"{c} long" for c in names) + ", k int")
        parted = placed.join(F.broadcast(large), names).withColumn("side", F.expr("shiftright(side, k)")).groupBy(*names, "side").count().toArrow()
        grid = np.concatenate([grid[drop == bits], np.stack([parted[c].to_numpy() for c in names], 1)])
        counts = np.concatenate([counts[drop == bits], parted["count"].to_numpy()])
        sides = np.concatenate([sides[drop == bits], parted["side"].to_numpy()])
        drop = {tuple(r[:-1]): r[-1] for r in large.toLocalIterator()}
        order = np.lexsort((sides, *grid.T[::-1]))
        grid, counts, sides = grid[order], counts[order], sides[order]
    else:
        drop = {}
    first, many, low, high = cut_blocks(grid, counts, size)
    rows = np.zeros(len(low))
    for f, m, c in zip(first.tolist(), many.tolist(), counts.tolist(), strict=True):
        rows[f:f + m] += c / m
    row_bytes = width * np.dtype(kind).itemsize
    strip_bytes = int(min(2 * STRIP_BYTES, max(STRIP_BYTES, counts.sum() * row_bytes / 32)))
    piece_rows = max(1, PIECE_BYTES // row_bytes)
    strip, strips = cut_strips(np.ceil(rows).astype(np.int64), row_bytes, strip_bytes)
    bundle = strip if strip[-1] > _AT_ONCE else np.arange(len(low))  # what one task packs into one file
    partner = np.zeros((len(low), len(low)), bool)
    partner[tuple(np.array(join_intervals(low, high)).T)] = True
    partner |= partner.T
    plan = spark.sparkContext.broadcast((drop, {(*c, d): (int(f), int(m)) for c, d, f, m in zip(grid.tolist(), sides.tolist(), first, many, strict=True)},
                                         strip, strips, bundle))

    def deal(batches):
        drop, place, *_, bundle = plan.value
        for b in batches:
            ids = b.column("vec_id").to_numpy(zero_copy_only=False)
            cell = zip(*(b.column(c).to_pylist() for c in names), strict=True)
            cell = [(*c, d >> drop.get(c, bits)) for c, d in zip(cell, b.column("side").to_pylist(), strict=True)]
            first, many = np.array([place[c] for c in cell], np.int64).reshape(-1, 2).T
            block_of = first + (mix(ids.astype(np.uint64)) % many.astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bundle[block_of]), pa.array(block_of), b.column("vec_id"), b.column("x")], names=["bundle", "block", "vec_id", "x"])

    def pack(batches):
        _, _, strip, strips, _ = plan.value
        now, k, ids, held = None, 0, [], []

        def done():
            at = int(strip[now]) + min(k * piece_rows * row_bytes // strip_bytes, int(strips[now]) - 1)
            x = np.frombuffer(b"".join(held), kind).reshape(-1, width)
            u = unit(x.astype(float))
            order, tiles = cut_tiles(u, 0.4 * eps)
            centres, radii = balls(u[order], tiles)
            values = {"ids": np.concatenate(ids).astype("<i8")[order], "x": x[order], "tiles": tiles, "centres": centres, "radii": radii}
            row = {"strip": at, "block": now, "piece": k} | {c: v.tobytes() for c, v in values.items()}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([(c, pa.binary() if isinstance(v, bytes) else pa.int64()) for c, v in row.items()]))

        for b in batches:
            block_of = b.column("block").to_numpy()
            begin = 0
            while begin < len(block_of):
                if block_of[begin] != now:
                    if held:
                        yield done()
                    now, k, ids, held = int(block_of[begin]), 0, [], []
                elif len(held) == piece_rows:
                    yield done()
                    k, ids, held = k + 1, [], []
                end = min(int(np.searchsorted(block_of, now, "right")), begin + piece_rows - len(held))
                ids.append(b.column("vec_id").slice(begin, end - begin).to_numpy())
                held += b.column("x").slice(begin, end - begin).to_pylist()
                begin = end
        if held:
            yield done()

    n = max(1, min(int(bundle[-1]) + 1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = placed.mapInArrow(tidy(deal), "bundle long, block long, vec_id long, x binary").repartition(n, "bundle").sortWithinPartitions("block")
    layout = "strip long, block long, piece long, ids binary, x binary, tiles binary, centres binary, radii binary"
    path = shared_path(spark, f"llm-vector-pieces-{uuid.uuid4().hex}")
    small = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1}  # row groups of a few pieces
    dealt.mapInArrow(tidy(pack), layout).write.options(**small).partitionBy("strip").parquet(path)
    remove_path(spark, given)
    pieces, packed = spark.read.schema(layout).parquet(path), path

    holds = np.zeros((len(low), int((strip + strips).max())), np.float32)  # blocks by strips
    for k, (f, m) in enumerate(zip(strip.tolist(), strips.tolist(), strict=True)):
        holds[k, f:f + m] = 1
    # a pair within a strip is taken from one side or the other in turn, so that no task gets all pairs of the first pieces
    met = F.expr("substring(l_partners, CAST(r_block AS INT) + 1, 1) = X'01' AND (l_strip < r_strip OR l_block = r_block AND l_piece = r_piece OR "
                 "(struct(l_block, l_piece) < struct(r_block, r_piece)) = ((l_block + l_piece + r_block + r_piece) % 2 = 0))")

    def meetings(partner, columns):
        """Jobs of pairs of pieces: each pair of partners once, or a piece with itself."""
        near = holds.T @ partner.astype(np.float32) @ holds > 0
        masks = F.broadcast(spark.createDataFrame([(k, bytearray(p.tobytes())) for k, p in enumerate(partner)], "l_block long, l_partners binary"))
        sides = [pieces.select(*(F.col(c).alias(f"{side}_{c}") for c in ("strip", "block", "piece", *columns))) for side in "lr"]
        for begin in range(0, len(near), _AT_ONCE):
            pairs = []
            for t in range(begin, min(begin + _AT_ONCE, len(near))):
                left, right = sides[0].where(F.col("l_strip").isin(np.flatnonzero(near[:t + 1, t]).tolist())), sides[1].where(F.col("r_strip") == t)
                right = right.coalesce(1) if len(near) > _FEW else right
                left = left.coalesce(int(near[:t + 1, t].sum())) if len(near) > _AT_ONCE else left
                pairs.append(left.join(masks, "l_block").join(right.hint("shuffle_replicate_nl"), met).drop("l_partners"))
            yield reduce(DataFrame.unionAll, pairs)

    def sides_of(batches):
        """(number of the row in its batch, batch, name of the left piece, of the right one) of each pair."""
        for b in batches:
            for i, (lb, lp, rb, rp) in enumerate(zip(*(b.column(c).to_pylist() for c in ("l_block", "l_piece", "r_block", "r_piece")), strict=True)):
                yield i, b, (lb, lp), (rb, rp)

    def value(b, i, name, form):
        return np.frombuffer(b.column(name)[i].as_buffer(), form).copy()

    def within(batches):
        kept = set()
        for i, b, l, r in sides_of(batches):
            if l[0] == r[0] or (l[0], r[0]) in kept:
                continue
            a, c = (value(b, i, f"{side}_centres", "<f4").reshape(-1, width) for side in "lr")
            if (_distances(a, c) <= value(b, i, "l_radii", "<f4")[:, None].astype(float) + value(b, i, "r_radii", "<f4") + eps + 1e-5).any():
                kept.add((l[0], r[0]))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64())], names=["i", "j"])

    remain = np.eye(len(low), dtype=bool)
    for pairs in meetings(partner, ("centres", "radii")):
        kept = pairs.mapInArrow(tidy(within), "i long, j long").distinct().toArrow()  # of blocks: their number is bounded
        remain[kept["i"].to_numpy(), kept["j"].to_numpy()] = True
    remain |= remain.T

    def compare(batches):
        left, now, right, found = None, None, {}, []

        def links(p):
            some = p.n > 0
            return pa.RecordBatch.from_arrays([pa.array(p.ids[some]), pa.array(p.n[some]), pa.nulls(int(some.sum()), pa.int64())], names=["a", "n", "b"])

        def joined():
            star = stars(*(np.concatenate(x) for x in zip(*found, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(star[0]), pa.nulls(len(star[0]), pa.int64()), pa.array(star[1])], names=["a", "n", "b"])

        def read(b, i, side):
            return Piece(value(b, i, f"{side}_ids", "<i8"), value(b, i, f"{side}_x", kind).reshape(-1, width), value(b, i, f"{side}_tiles", "<i4").astype(np.int64),
                         value(b, i, f"{side}_centres", "<f4").reshape(-1, width), value(b, i, f"{side}_radii", "<f4"))

        for i, b, l, r in sides_of(batches):
            if l != now:
                if left:
                    yield links(left)
                now, left = l, read(b, i, "l")
            if l != r and r not in right:
                right[r] = read(b, i, "r")
            found += join_pieces(left, left if l == r else right[r], least)
            if sum(len(x) for x, _ in found) > _HOLD:
                star = joined()
                found = [(star.column("a").to_numpy(), star.column("b").to_numpy())]
                if len(found[0][0]) > _HOLD // 2:
                    yield star
                    found = []
        if left:
            yield links(left)
        for p in right.values():
            yield links(p)
        if found:
            yield joined()

    path = shared_path(spark, f"llm-vector-links-{uuid.uuid4().hex}")
    for pairs in meetings(remain, ("ids", "x", "tiles", "centres", "radii")):
        pairs.mapInArrow(tidy(compare), "a long, n long, b long").write.mode("append").parquet(path)
    remove_path(spark, packed)
    found = spark.read.schema("a long, n long, b long").parquet(path)
    links = found.where("n IS NOT NULL").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n_links"))
    parts = connected(found.where("b IS NOT NULL").select("a", "b")).withColumnsRenamed({"id": "vec_id", "component": "component_id"})
    return alone.join(links, "vec_id", "left").join(parts, "vec_id", "left") \
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")) \
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
