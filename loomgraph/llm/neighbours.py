"""The k most similar vectors of every vector, with little loss against the exact answer.

Method: *additive quantisation*. A vector is the sum of one codeword from each of several codebooks, all of full
dimension; the first codebook is also the coarse index (its codewords are cells), the others are trained on what the ones
before leave over. Codes are chosen by beam search over all codebooks. The norm of each reconstruction is stored. A query
makes one table of its products with all codewords, so that a stored vector is scored with a few look-ups and its norm;
the best ``RERANKED`` are then scored exactly.

Each vector is listed in the cells nearest to it and asks in its own cell only. In how many cells, is the least number with
which the sample's own nearest pairs share a cell to the degree ``COVERED``, found for each model and not bounded: where
vectors have hardly any structure it goes up to all cells, which is exact. A model of n vectors has n / ``PER_CELL`` cells or,
beyond ``FLAT_CELLS``, twice the square root of n, so that both finding cells and searching them cost a root of n for each
vector. Cells near each other form regions of about ``REGION`` vectors, found by halving the codebook along its longest axis; a vector is sent once to each
region in which it is listed, as 16-bit fixed-point numbers (cosines differ by about 1e-5), so a region is searched by one
task without joins. Regions that, going by the sample, hold more than the bounds are split by query and by stored
vector, and the parts' best are merged.

Where only neighbours of at least some cosine are asked for, the cells are those that such pairs need: a pair counts for both of
its vectors, whichever is listed in the other's cell, and of the sample's nearest pairs, turned towards each other to just that
cosine where they are farther apart, ``SURE`` have a vector that lies within ``reach`` of the other's cell. The cells listed don't
grow with the vectors, as those for the nearest pairs of vectors without structure do. A stored vector is then
scored exactly wherever its score by table, with the angle between it and its reconstruction, leaves the cosine possible, so
that quantisation loses nothing.

Groups of more than ``COPIES`` equal vectors are indexed by their first members; the others' nearest are these, exactly.

Codebooks are fitted, each model by one task, on a sample of ``SAMPLE`` vectors of each model, or of ``PER_CENTRE`` for each
cell where that is more (those with the least hash of their id); every usable vector is indexed and asks. Defined results: null, empty, short, long, zero and non-finite vectors, null
elements and null ids or models take no part; of several usable rows of one id and model the latest counts (ties: the
greatest hash of the vector); null ``created_at`` is least; equal similarities are ordered by id; a model with one vector
has no neighbours; an empty table gives none. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

K = 5
LEAST_PROBES, COVERED, SURE, SUREST = 8, 0.95, 0.99, 0.999
RERANKED, BEAM = 160, 3
BOOKS, WORDS = 12, 256
PER_CELL, FLAT_CELLS = 256, 2048
SAMPLE, PER_CENTRE = 65_536, 8
#: Scores that a block of queries and stored vectors has at once.
BLOCK = 1 << 22
#: Scores that are summed up at once, within a core's cache.
INNER = 1 << 18
REGION = 32_768
MOST_QUERIES, MOST_STORED = 65_536, 262_144
FIXED = 32_767
COPIES = K + 1
#: How much the cosine of 16-bit vectors is trusted to differ from that of the stored ones.
SLACK = 1e-3


@dataclass
class Codebooks:
    """``cells`` is the first codebook, ``books`` the others; ``region`` has the region of each cell; ``probes`` is in how
    many cells a vector is listed, at most where ``reach`` bounds by how much more it may lose there than in its own;
    ``asking`` and ``stored`` are the expected numbers of vectors of each region."""

    cells: np.ndarray
    books: list[np.ndarray]
    region: np.ndarray
    probes: int
    asking: np.ndarray
    stored: np.ndarray
    reach: float = np.inf

    @property
    def cell_type(self) -> type:
        """Numbers of cells take two bytes where they can."""
        return np.uint16 if len(self.cells) <= 1 << 16 else np.int32

    @property
    def words(self) -> np.ndarray:
        return np.vstack([self.cells, *self.books])


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    if len(x) <= k:
        return np.vstack([x, np.zeros((max(0, min(k, 1) - len(x)), x.shape[1]), x.dtype)])
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        counts = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        used = np.flatnonzero(counts)
        starts = np.concatenate([[0], np.cumsum(counts[used])[:-1]])
        centres[used] = np.add.reduceat(x[order], starts, axis=0) / counts[used, None]
        if (lost := np.flatnonzero(counts == 0)).size:  # a lost centre starts again beside a crowded one
            crowded = np.argsort(-counts, kind="stable")[: lost.size]
            centres[lost] = centres[crowded] + rng.normal(0, 1e-3, (lost.size, x.shape[1])).astype(x.dtype)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray, block: int = 8192) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + block] @ centres.T - half, axis=1) for i in range(0, len(x), block)] or [np.zeros(0, int)])


def _regions(cells: np.ndarray, weight: np.ndarray, most: float) -> np.ndarray:
    """Numbers cells by halving along the axis of greatest spread until a part weighs at most ``most``."""
    out, todo, n = np.zeros(len(cells), np.int32), [np.arange(len(cells))], 0
    while todo:
        part = todo.pop()
        if len(part) > 1 and weight[part].sum() > most:
            x = cells[part] - cells[part].mean(0)
            axis = np.linalg.svd(x, full_matrices=False)[2][0]
            order = part[np.argsort(x @ axis, kind="stable")]
            at = int(np.searchsorted(np.cumsum(weight[order]), weight[part].sum() / 2)) + 1
            at = min(max(at, 1), len(order) - 1)
            todo += [order[:at], order[at:]]
        else:
            out[part] = n
            n += 1
    return out


def cells_of(total: int) -> int:
    """The number of cells for so many vectors."""
    return int(max(1, min(total / PER_CELL, max(FLAT_CELLS, 2 * total**0.5))))


def sample_of(total: int) -> int:
    """The greatest number of vectors from which codebooks are fitted: a root of the total, beyond SAMPLE."""
    return min(total, max(PER_CENTRE * cells_of(total), min(SAMPLE, max(64 * WORDS, 32 * total // PER_CELL))))


def fit(sample: np.ndarray, total: int, seed: int = 0, least: float | None = None) -> Codebooks:
    """Codebooks for about ``total`` unit vectors of which ``sample`` is a sample, for neighbours of at least the cosine ``least``."""
    rng = np.random.default_rng(seed)
    k = int(min(cells_of(total), max(1, len(sample) / PER_CENTRE)))
    cells = _kmeans(sample, k, 8, rng)
    near = _nearest(sample, cells)
    rest, books = sample - cells[near], []
    part = rest[: 64 * WORDS]
    for _ in range(BOOKS):
        book = _kmeans(part, min(WORDS, len(part)), 4, rng)
        books.append(book)
        part = part - book[_nearest(part, book)]
    scale = total / max(1, len(sample))
    region = _regions(cells, np.bincount(near, minlength=len(cells)) * scale + 1e-9, REGION)
    some = sample[:16_384]
    probes, reach = (_probes(some, cells, rng), np.inf) if least is None else _reach(some, cells, rng, least)
    lists = _reached(some, cells, _listed(some, cells, probes), reach)
    part = np.unique((region[lists] + np.arange(len(some))[:, None] * (region.max() + 1))[lists >= 0]) % (region.max() + 1)
    scale, most = total / max(1, len(some)), int(region.max()) + 1
    return Codebooks(cells, books, region, probes, np.bincount(region[lists[:, 0]], minlength=most) * scale, np.bincount(part, minlength=most) * scale, reach)


def _listed(x: np.ndarray, cells: np.ndarray, probes: int) -> np.ndarray:
    """The nearest cells of each vector, nearest first."""
    probes = min(probes, len(cells))
    block = max(1, BLOCK // len(cells))
    half, out = (cells * cells).sum(1) / 2, np.empty((len(x), probes), np.int64)
    for i in range(0, len(x), block):
        loss = half - x[i : i + block] @ cells.T
        near = np.argpartition(loss, probes - 1, axis=1)[:, :probes]
        out[i : i + block] = np.take_along_axis(near, np.argsort(np.take_along_axis(loss, near, 1), axis=1, kind="stable"), 1)
    return out


def _reached(x: np.ndarray, cells: np.ndarray, near: np.ndarray, reach: float) -> np.ndarray:
    """The cells of ``near`` that lose no more than ``reach`` against the first; -1 for the others."""
    if reach == np.inf:
        return near
    loss = (cells * cells).sum(1)[near] / 2 - np.stack([np.einsum("nd,nd->n", x, cells[c]) for c in near.T], axis=1)
    return np.where((loss <= loss[:, :1] + reach) | (np.arange(near.shape[1]) == 0), near, -1)


def _turned(x: np.ndarray, near: np.ndarray, least: float) -> np.ndarray:
    """Of each vector's ``near`` (n, k, d) those farther than the cosine ``least`` turned towards the vector to just that."""
    cosine = np.einsum("nd,nkd->nk", x, near)[:, :, None]
    aside = near - cosine * x[:, None, :]
    length = np.sqrt((aside * aside).sum(2, keepdims=True))
    edge = least * x[:, None, :] + (1 - least * least) ** 0.5 * aside / np.maximum(length, 1e-6)
    return np.where((cosine < least) & (length > 1e-6), edge, near).astype(np.float32)


def _some_nearest(sample: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Some of the sample and the nearest of each in it."""
    asked = rng.choice(len(sample), min(512, len(sample)), replace=False)
    score = sample[asked] @ sample.T
    score[np.arange(len(asked)), asked] = -np.inf
    return asked, _best(score, min(K, max(1, len(sample) - 1)))


def _probes(sample: np.ndarray, cells: np.ndarray, rng: np.random.Generator) -> int:
    """In how many cells vectors must be listed so that enough of a vector's nearest in the sample are in its own cell."""
    asked, top = _some_nearest(sample, rng)
    half = (cells * cells).sum(1) / 2
    home = np.argmin(half - sample[asked] @ cells.T, axis=1)
    ranks = []
    for near, at in zip(top, home, strict=True):
        loss = half - sample[near] @ cells.T
        ranks.append((loss < loss[:, at, None]).sum(1))
    need = int(np.quantile(np.concatenate(ranks), COVERED, method="higher")) + 1
    return min(len(cells), max(LEAST_PROBES, need))


def _reach(sample: np.ndarray, cells: np.ndarray, rng: np.random.Generator, least: float) -> tuple[int, float]:
    """In how many cells at most, and how far from their own, vectors must be listed so that of enough pairs at the cosine
    ``least`` one is in the other's own cell."""
    asked, top = _some_nearest(sample, rng)
    half = (cells * cells).sum(1) / 2
    ranks, reaches = [], []
    for x, others in zip(sample[asked], _turned(sample[asked], sample[top], least), strict=True):
        mine, theirs = half - x @ cells.T, half - others @ cells.T
        there, here = mine[np.argmin(theirs, axis=1)], theirs[:, np.argmin(mine)]
        reaches.append(np.minimum(there - mine.min(), here - theirs.min(1)))
        ranks.append(np.minimum((mine < there[:, None]).sum(1), (theirs < here[:, None]).sum(1)))
    need = int(np.quantile(np.concatenate(ranks), SUREST, method="higher")) + 1
    return min(len(cells), max(LEAST_PROBES, need)), float(np.quantile(np.concatenate(reaches), SURE, method="higher")) + 1e-5


def encode(x: np.ndarray, c: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (n, 1 + books), norms of the reconstructions, and the nearest cells (n, probes), nearest first, -1
    for those beyond reach."""
    n = len(x)
    near = _listed(x, c.cells, max(c.probes, BEAM))
    codes = near[:, :BEAM, None].astype(np.int32)  # n, beam, levels so far
    rest = x[:, None, :] - c.cells[codes[:, :, 0]]  # what each beam leaves over
    cost = (rest * rest).sum(2)
    near = _reached(x, c.cells, near[:, : c.probes], c.reach)
    for book in c.books:
        step = (book * book).sum(1) - 2 * (rest.reshape(-1, x.shape[1]) @ book.T)
        total = (cost[:, :, None] + step.reshape(n, -1, len(book))).reshape(n, -1)
        keep = min(BEAM, total.shape[1])
        best = np.argpartition(total, keep - 1, axis=1)[:, :keep]
        cost = np.take_along_axis(total, best, 1)
        parent, word = np.divmod(best, len(book))
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.int32)], axis=2)
        rest = np.take_along_axis(rest, parent[:, :, None], 1) - book[word]
    pick = np.argmin(cost, axis=1)
    rows = np.arange(n)
    made = x - rest[rows, pick]
    return codes[rows, pick], np.maximum(np.sqrt((made * made).sum(1)), 1e-6), near


def _best(score: np.ndarray, k: int) -> np.ndarray:
    k = min(k, score.shape[1])
    return np.argpartition(-score, k - 1, axis=1)[:, :k]


def _scores(table: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Sums of the table's rows, for each stored vector and query."""
    score, more = np.take(table, flat[:, 0], axis=0), np.empty((len(flat), table.shape[1]), np.float32)
    for level in range(1, flat.shape[1]):
        score += np.take(table, flat[:, level], axis=0, out=more, mode="clip")
    return score


def _nearest_stored(table: np.ndarray, q: np.ndarray, own: np.ndarray, members: np.ndarray, flat: np.ndarray, norms: np.ndarray, stored: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places among ``members`` and the cosines of each query's nearest: the best by table, ranked exactly."""
    top = top_score = None
    width, inner = max(RERANKED, BLOCK // len(q)), max(1, INNER // len(q))
    for j in range(0, len(members), width):
        block = members[j : j + width]
        score = np.empty((len(q), len(block)), np.float32)
        for i in range(0, len(block), inner):
            part = block[i : i + inner]
            score[:, i : i + inner] = (_scores(table, flat[part]) / norms[part, None]).T
        if len(block) > RERANKED or top is not None:
            best = _best(score, RERANKED)
            found, score = block[best], np.take_along_axis(score, best, 1)
        else:
            found = np.broadcast_to(block, score.shape)
        if top is not None:
            found, score = np.hstack([top, found]), np.hstack([top_score, score])
            best = _best(score, RERANKED)
            found, score = np.take_along_axis(found, best, 1), np.take_along_axis(score, best, 1)
        top, top_score = found, score
    exact = np.einsum("nd,nrd->nr", q, stored[top])
    exact[top == own[:, None]] = -np.inf
    rank = np.lexsort((top, -exact), axis=1)[:, :k]
    cosines = np.take_along_axis(exact, rank, 1)
    return np.where(np.isfinite(cosines), np.take_along_axis(top, rank, 1), -1), cosines


def _stored_within(table: np.ndarray, q: np.ndarray, own: np.ndarray, members: np.ndarray, flat: np.ndarray, bound: np.ndarray, stored: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """As ``_nearest_stored``, of those of at least the cosine ``least``: all whose score by table reaches their ``bound`` are
    scored exactly."""
    row, place, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    width = max(1, INNER // len(q))
    for j in range(0, len(members), width):
        block = members[j : j + width]
        possible = np.flatnonzero(_scores(table, flat[block]) >= bound[block, None])
        for i in range(0, len(possible), 1 << 16):
            at, ask = np.divmod(possible[i : i + (1 << 16)], len(q))
            cosine = np.einsum("nd,nd->n", q[ask], stored[block[at]])
            near = (cosine >= least) & (block[at] != own[ask])
            row, place, value = np.append(row, ask[near]), np.append(place, block[at[near]]), np.append(value, cosine[near])
            order = np.lexsort((place, -value, row))
            order = order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < k]
            row, place, value = row[order], place[order], value[order]
    places, cosines = np.full((len(q), k), -1, np.int64), np.full((len(q), k), -np.inf, np.float32)
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    places[row, rank], cosines[row, rank] = place, value
    return places, cosines


def _bounds(c: Codebooks, stored: np.ndarray, flat: np.ndarray, norms: np.ndarray, least: float) -> np.ndarray:
    """The least sum by table that a query can have whose cosine with the stored vector is at least ``least``: the angle to the
    reconstruction is no more than that to the vector and the one between these two."""
    words, lean = c.words, np.empty(len(stored), np.float32)
    for i in range(0, len(stored), 8192):
        made = _scores(words, flat[i : i + 8192])
        lean[i : i + 8192] = np.einsum("nd,nd->n", made, stored[i : i + 8192]) / norms[i : i + 8192]
    angle = np.arccos(np.clip(lean, -1, 1)) + np.arccos(least)
    return (np.cos(np.minimum(angle, np.pi)) - SLACK) * norms  # vectors have 16 bits


def search(c: Codebooks, queries: np.ndarray, own: np.ndarray, home: np.ndarray, stored: np.ndarray, codes: np.ndarray, norms: np.ndarray, listed: dict[int, np.ndarray], k: int = K, least: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each query (with its cell in ``home`` and its own place among ``stored`` or -1) the places and cosines of its
    ``k`` nearest stored vectors, of at least the cosine ``least``; -1 where there are fewer."""
    places = np.full((len(queries), k), -1, np.int64)
    cosines = np.full((len(queries), k), -np.inf, np.float32)
    offsets = np.cumsum([0, len(c.cells), *(len(b) for b in c.books)])[:-1]
    words, flat = c.words, codes + offsets[None, :]
    bound = None if least is None else _bounds(c, stored, flat, norms, least)
    order = np.argsort(home, kind="stable")
    bounds = np.flatnonzero(np.diff(home[order], prepend=-1, append=-1))
    for a, b in pairwise(bounds):
        asking = order[a:b]
        members = listed.get(int(home[asking[0]]))
        if members is None:
            continue
        step = max(1, min(256, BLOCK // len(members)))
        for i in range(0, len(asking), step):
            ask = asking[i : i + step]
            q = queries[ask]
            table = words @ q.T  # the products of all codewords; a codeword's row is contiguous
            if least is None:
                found, exact = _nearest_stored(table, q, own[ask], members, flat, norms, stored, k)
            else:
                found, exact = _stored_within(table, q, own[ask], members, flat, bound, stored, k, least)
            places[ask, : found.shape[1]], cosines[ask, : found.shape[1]] = found, exact
    return places, cosines


def usable(vectors: DataFrame) -> DataFrame:
    """The rows that count: model, method_id, embedding."""
    v = vectors.select("model", "method_id", F.col("embedding").cast("array<float>").alias("embedding"), "created_at").filter("model is not null and method_id is not null and size(embedding) > 0")
    sizes = v.groupBy("model").agg(F.mode(F.size("embedding")).alias("_full"))  # one row per model
    v = v.join(F.broadcast(sizes), "model").filter(F.size("embedding") == F.col("_full"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = v.filter(finite & F.exists("embedding", lambda x: x != 0))
    last = F.max(F.struct("created_at", F.xxhash64("embedding").alias("h"), "embedding")).alias("_last")
    return v.groupBy("model", "method_id").agg(last).select("model", "method_id", "_last.embedding")


def _matrix(column: Any) -> np.ndarray:
    """Unit rows from an Arrow column of float lists of one length."""
    n = len(column)
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def _binary(x: np.ndarray, offsets: np.ndarray | None = None) -> Any:
    """An Arrow column of binary values: the rows of ``x``, or its bytes between offsets."""
    import pyarrow as pa

    if offsets is None:
        offsets = np.arange(len(x) + 1) * x[:1].nbytes
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _bytes(column: Any) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and the lengths of its values."""
    import pyarrow as pa

    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(whole.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets)


def _joined(column: Any, kind: Any, width: int) -> np.ndarray:
    return _bytes(column)[0].copy().view(kind).reshape(-1, width)


def fitted(base: DataFrame, sizes: dict[str, int], least: float | None = None) -> dict[str, Codebooks]:
    """The codebooks of each model, fitted by one task a model from the rows of least id hash."""
    spark = base.sparkSession
    wanted = spark.createDataFrame([(m, n, sample_of(n)) for m, n in sizes.items()], "model string, _total long, _most int")
    h = F.shiftrightunsigned(F.xxhash64("method_id"), 1)
    # the hash's upper part is even: so many rows fall below the bound, give or take a root of them
    few = base.join(F.broadcast(wanted), "model").withColumn("_h", h).filter((F.col("_total") <= F.col("_most")) | (F.col("_h") < F.col("_most") / F.col("_total") * F.lit(float(2**63))))

    def run(table):  # noqa: ANN001, ANN202
        import pickle

        import pyarrow as pa

        order = np.lexsort((np.array(table.column("method_id").to_pylist(), object).astype(str), table.column("_h").to_numpy()))
        total, most = table.column("_total")[0].as_py(), table.column("_most")[0].as_py()
        taken = table.take(pa.array(order[:most]))
        made = fit(_matrix(taken.column("embedding").combine_chunks()), total, least=least)
        return pa.table({"model": pa.array([table.column("model")[0].as_py()]), "books": pa.array([pickle.dumps(made)], pa.binary())})

    import pickle

    rows = few.groupBy("model").applyInArrow(run, "model string, books binary").collect()  # one row per model
    return {r["model"]: pickle.loads(r["books"]) for r in rows}


def neighbours(vectors: DataFrame, k: int = K, least: float | None = None) -> DataFrame:
    """(model, method_id, neighbour, cosine): the ``k`` nearest of each usable vector within its model; with ``least``, those of
    them that are at least so similar, for which far fewer vectors are looked at."""
    spark = vectors.sparkSession
    base = cut(usable(vectors).withColumn("_copy", F.xxhash64("embedding")))
    sizes = {r["model"]: r["n"] for r in base.groupBy("model").agg(F.count("*").alias("n")).collect()}  # one row per model
    result = "model string, method_id string, neighbour string, cosine float"
    if not sizes:
        return spark.createDataFrame([], result)

    crowded = base.groupBy("model", "_copy").agg(F.count("*").alias("n")).filter(F.col("n") > COPIES).select("model", "_copy")
    crowded = cut(crowded)
    copies, index = None, base
    if not crowded.isEmpty():
        group = ["model", "_copy"]
        many = base.select("model", "method_id", "_copy").join(crowded, group).withColumn("_salt", F.pmod(F.xxhash64("method_id"), F.lit(1024)))
        few = many.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_salt").orderBy("method_id"))).filter(F.col("_r") <= COPIES)
        few = cut(few.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy("method_id"))).filter(F.col("_r") <= COPIES).drop("_salt"))
        first = few.filter(F.col("_r") <= k).groupBy(*group).agg(F.collect_list("method_id").alias("_nearest"))
        others = many.join(few.select("model", "method_id"), ["model", "method_id"], "left_anti")
        index = base.join(others.select("model", "method_id"), ["model", "method_id"], "left_anti")
        copies = others.join(first, group).select("model", "method_id", F.explode("_nearest").alias("neighbour"), F.lit(1.0).cast("float").alias("cosine"))

    books = fitted(base.select("model", "method_id", "embedding"), sizes, least)
    # a 256th of the vectors at most, a root of them in great models, and BOOKS * WORDS codewords for each model
    shared = spark.sparkContext.broadcast(books)
    names = sorted(sizes)
    first_unit = dict(zip(names, np.cumsum([0, *(int(books[m].region.max()) + 1 for m in names)])[:-1].tolist(), strict=True))

    def place(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            models = batch.column(0).to_pylist()
            for model in sorted(set(models)):
                rows = np.flatnonzero(np.array([m == model for m in models]))
                for i in range(0, len(rows), 2048):
                    part = batch.take(pa.array(rows[i : i + 2048]))
                    c, x = shared.value[model], _matrix(part.column(2))
                    codes, norms, near = encode(x, c)
                    row, cell = np.nonzero(near >= 0)[0], near[near >= 0]
                    unit = c.region[cell] + first_unit[model]
                    order = np.lexsort((unit, row))  # stable: a vector's cells within a region stay nearest first
                    row, of, own = row[order], unit[order], c.region[near[:, 0]] + first_unit[model]
                    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (of[1:] != of[:-1])))
                    take = pa.array(row[first].astype(np.int32))
                    coded = np.hstack([codes[:, :1].astype(np.int32).view(np.uint8), codes[:, 1:].astype(np.uint8)])
                    raw = np.rint(x * FIXED).astype(np.int16)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(of[first], pa.int32()), pa.array(of[first] == own[row[first]]), part.column(0).take(take), part.column(1).take(take), _binary(coded).take(take), pa.array(norms).take(take), _binary(raw).take(take), _binary(cell[order].astype(c.cell_type), np.append(first, len(order)) * np.dtype(c.cell_type).itemsize)],
                        names=["unit", "home", "model", "method_id", "codes", "norm", "vector", "cells"],
                    )

    placed = index.select("model", "method_id", "embedding").mapInArrow(place, "unit int, home boolean, model string, method_id string, codes binary, norm float, vector binary, cells binary")
    split = {}
    for m in names:
        for r, (a, h) in enumerate(zip(books[m].asking, books[m].stored, strict=True)):
            if a > MOST_QUERIES or h > MOST_STORED:
                split[first_unit[m] + r] = (max(1, -(-int(a) // MOST_QUERIES)), max(1, -(-int(h) // MOST_STORED)))
    placed = placed.withColumn("asks", F.col("home")).withColumn("holds", F.lit(True)).withColumn("qs", F.lit(0)).withColumn("ss", F.lit(0))
    if split:
        hot = spark.createDataFrame([(u, q, s) for u, (q, s) in split.items()], "unit int, nq int, ns int")
        h = F.xxhash64("method_id")
        placed = placed.join(F.broadcast(hot), "unit", "left").withColumns({"nq": F.coalesce("nq", F.lit(1)), "ns": F.coalesce("ns", F.lit(1))})
        placed = placed.withColumns({"myq": F.pmod(h, "nq").cast("int"), "mys": F.pmod(F.shiftright(h, 32), "ns").cast("int")})
        grid = F.flatten(F.transform(F.sequence(F.lit(0), F.col("nq") - 1), lambda q: F.transform(F.sequence(F.lit(0), F.col("ns") - 1), lambda s: F.struct(q.alias("q"), s.alias("s")))))
        grid = F.filter(grid, lambda x: (x["s"] == F.col("mys")) | (F.col("home") & (x["q"] == F.col("myq"))))
        placed = placed.withColumn("_at", F.explode(grid)).withColumns({"qs": F.col("_at.q"), "ss": F.col("_at.s"), "asks": F.col("home") & (F.col("_at.q") == F.col("myq")), "holds": F.col("_at.s") == F.col("mys")})
    placed = placed.select("unit", "qs", "ss", "asks", "holds", "model", "method_id", "codes", "norm", "vector", "cells")

    def ask(table):  # noqa: ANN001, ANN202
        import pyarrow as pa

        model = table.column("model")[0].as_py()
        c = shared.value[model]
        ids = np.array(table.column("method_id").to_pylist(), object)
        order = np.argsort(ids, kind="stable")  # places rise with the ids, so ties go to the lesser id
        table, ids = table.take(pa.array(order)), ids[order]
        vectors = _joined(table.column("vector"), np.int16, c.cells.shape[1]).astype(np.float32) / FIXED
        raw = _joined(table.column("codes"), np.uint8, 4 + len(c.books))
        codes = np.hstack([np.ascontiguousarray(raw[:, :4]).view(np.int32), raw[:, 4:]]).astype(np.int64)
        norms = table.column("norm").to_numpy().astype(np.float32)
        asks, holds = (table.column(x).to_numpy(zero_copy_only=False) for x in ("asks", "holds"))
        data, lengths = _bytes(table.column("cells"))
        cells, counts = data.copy().view(c.cell_type), lengths // np.dtype(c.cell_type).itemsize
        starts = np.cumsum(counts) - counts
        held = np.repeat(holds, counts)
        owner, of = np.repeat(np.arange(len(counts)), counts)[held], cells[held].astype(np.int64)
        by = np.argsort(of, kind="stable")
        bounds = np.flatnonzero(np.diff(of[by], prepend=-1, append=-1)) if len(of) else []
        listed = {int(of[by[a]]): owner[by[a:b]] for a, b in pairwise(bounds)}
        asking = np.flatnonzero(asks)
        home = cells[starts[asking]].astype(np.int64)
        places, cosines = search(c, vectors[asking], asking, home, vectors, codes, norms, listed, k, least)
        row, col = np.nonzero(places >= 0)
        one, other, cosine = ids[asking[row]], ids[places[row, col]], cosines[row, col]
        if least is not None:  # a pair counts for both
            one, other, cosine = np.append(one, other), np.append(other, one), np.append(cosine, cosine)
        return pa.table({"model": pa.array([model] * len(one), pa.string()), "method_id": pa.array(one, pa.string()), "neighbour": pa.array(other, pa.string()), "cosine": pa.array(cosine, pa.float32())})

    found = placed.groupBy("unit", "qs", "ss").applyInArrow(ask, result)
    if least is not None:  # found from both ends, in parts
        found = found.groupBy("model", "method_id", "neighbour").agg(F.max("cosine").alias("cosine"))
        order = Window.partitionBy("model", "method_id").orderBy(F.desc("cosine"), "neighbour")
        found = found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")
    elif any(s > 1 for _, s in split.values()):
        best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "neighbour"))), 1, k)
        found = found.groupBy("model", "method_id").agg(best.alias("_best")).select("model", "method_id", F.explode("_best").alias("_b")).select("model", "method_id", "_b.neighbour", (-F.col("_b.c")).alias("cosine"))
    if least is not None:
        found = cut(found)  # few rows, at which those who ask for them look twice
    return found.unionByName(copies) if copies is not None else found


def similar_pairs(nearest: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """(model, method_id_a, method_id_b): each pair once, the lesser id first, of those at least ``least`` similar.

    The few pairs within ``SLACK`` of that are scored again with the vectors as stored."""
    named = ["model", F.least("method_id", "neighbour").alias("method_id_a"), F.greatest("method_id", "neighbour").alias("method_id_b")]
    sure = nearest.filter(F.col("cosine") >= F.lit(least + SLACK)).select(*named)
    pairs = cut(nearest.filter((F.col("cosine") >= F.lit(least - SLACK)) & (F.col("cosine") < F.lit(least + SLACK))).select(*named).distinct())
    asked = pairs.select("model", F.explode(F.array("method_id_a", "method_id_b")).alias("method_id")).distinct()
    known = usable(vectors.join(asked, ["model", "method_id"], "left_semi"))
    unit = F.transform("embedding", lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x * x))
    known = known.select("model", "method_id", F.transform(unit, lambda x: x / length).alias("v"))
    a, b = (known.select("model", F.col("method_id").alias(f"method_id_{s}"), F.col("v").alias(f"v_{s}")) for s in "ab")
    both = pairs.join(a, ["model", "method_id_a"]).join(b, ["model", "method_id_b"])
    cosine = F.aggregate(F.zip_with("v_a", "v_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return sure.unionByName(both.filter(cosine >= least).select("model", "method_id_a", "method_id_b")).distinct()
