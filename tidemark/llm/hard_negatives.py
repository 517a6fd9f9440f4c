"""Hard negatives of anchors, exact, through an inverted multi-index.

Vectors are whole numbers (``scale`` times each component, rounded down), scores their inner products.
An anchor's positives are the best rows of its label; the negatives of an anchor and a positive are
the best rows of other labels whose score lies within a window of percentages of the positive's.

The index cuts vectors in half. Each half has a codebook; a pair of codewords is a cell, and every row
is in the list of its cell. A half's score is at most the product with its codeword plus the
anchor's length times the codeword's radius (the largest distance of any row assigned to it). A heap over
both sorted sequences of half bounds visits cells by their sum (multi-sequence search). Two rounds per
search: the first visits ``seed_rows`` rows and so finds a score that the last wanted row has at least;
the second visits until the bound falls below that score, or below the window. What it has then is
certified: rows of cells not visited score less. How many cells that leaves out depends on the
data; on vectors without clusters the bounds exclude next to nothing, and the search degrades to all cells.

The codebooks are fitted on ``sample_rows`` vectors at most; every row is indexed, and results
do not depend on the codebooks.

Skew: rows of equal vector and label are one node, of which only the ids that can appear in a result are
kept (ties go to the smaller id, so the first ``max(positives + 1, negatives)`` of them); equal anchors are
searched once. Lists are cut into parts of about ``list_rows`` rows, the anchors that visit a cell into
groups of about ``group_rows``; a task multiplies one part with one group and keeps the best of each.
On the driver: codebooks, radii and the cells' sizes, whose number the settings bound.

Defined results: rows with a NULL label, a NULL vector, or a NULL or non-finite component take no part.
NULL ids are no anchors and come last among ties. Shorter vectors end in zeros. Repeated rows
are rows of their own. A vector whose squared length reaches 2^52 raises ValueError, since its scores might
not be exact. Columns besides vec_id, embedding and label are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.keyed import settled

LEAST, MOST = -(1 << 62), 1 << 62


@dataclass(frozen=True)
class Settings:
    positives: int = 5
    negatives: int = 10
    #: Window of a negative's score, as percentages of the positive's.
    low: int = 30
    high: int = 90
    scale: int = 256
    codewords: int = 16
    sample_rows: int = 4096
    seed_rows: int = 2048
    list_rows: int = 1024
    group_rows: int = 512

    @property
    def kept_ids(self) -> int:
        return max(self.positives + 1, self.negatives)


def matrix(packed: pa.Array, width: int) -> np.ndarray:
    """Packed vectors as rows of a matrix; shorter ones end in zeros."""
    out = np.zeros((len(packed), width))
    for i, x in enumerate(packed.to_pylist()):
        v = np.frombuffer(x, np.int32)
        out[i, : len(v)] = v
    return out


def whole_vectors(vectors: DataFrame, settings: Settings) -> DataFrame:
    """vec_id, label, packed (32-bit whole numbers) of the rows that take part, with a row number."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, packed = b.column(2), []
            values, ends = cells.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *cells.value_lengths().to_pylist()])
            whole = np.floor(values * settings.scale)
            for i, j in zip(ends[:-1], ends[1:], strict=True):
                if (whole[i:j] ** 2).sum() >= 2.0**52:
                    raise ValueError("a vector is too long for exact scores")
                packed.append(whole[i:j].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], names=["vec_id", "label", "packed"])

    found = rows.mapInArrow(run, "vec_id long, label long, packed binary")
    return settled(found.withColumn("row", F.monotonically_increasing_id()), "vectors")


def nodes_of(rows: DataFrame, settings: Settings) -> DataFrame:
    """One row per distinct vector and label: node, label, packed, ids (row and vec_id) by which ties are broken."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("row")]
    first = rows.withColumn("at", F.row_number().over(Window.partitionBy("packed", "label").orderBy(*order))).where(F.col("at") <= settings.kept_ids)
    ids = F.array_sort(F.collect_list(F.struct("at", "vec_id", "row")))
    return first.groupBy("packed", "label").agg(F.min_by("row", "at").alias("node"), ids.alias("ids"))


def fit_codebook(sample: np.ndarray, codewords: int, rounds: int = 8) -> np.ndarray:
    """Whole-numbered codewords by k-means from evenly spaced rows."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    words = np.unique(sample[np.linspace(0, len(sample) - 1, codewords).astype(int)], axis=0)
    for _ in range(rounds):
        at = nearest(sample, words)[0]
        words = np.stack([sample[at == k].mean(0) if (at == k).any() else words[k] for k in range(len(words))])
    return np.unique(np.round(words), axis=0)


def nearest(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Closest codeword of each row, and the squared distance."""
    distance = (x**2).sum(1)[:, None] - 2 * x @ words.T + (words**2).sum(1)
    at = distance.argmin(1)
    return at, np.maximum(distance[np.arange(len(x)), at], 0)


@dataclass
class Index:
    """Codebooks, radii and sizes of cells; the lists are a table."""

    width: int
    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    sizes: np.ndarray
    lists: DataFrame

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.width // 2
        return x[..., :half], x[..., half:]


def build_index(nodes: DataFrame, settings: Settings) -> Index:
    widest = nodes.agg(F.max(F.length("packed"))).first()[0] or 0
    width = max(2, widest // 4)
    sample = nodes.orderBy(F.xxhash64("packed"), "node").limit(settings.sample_rows).select("packed").toArrow()
    points = matrix(sample.column(0).combine_chunks(), width)
    half = width // 2
    books = (fit_codebook(points[:, :half], settings.codewords), fit_codebook(points[:, half:], settings.codewords))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), width)
            made = [*nearest(x[:, :half], books[0]), *nearest(x[:, half:], books[1])]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, made)], names=["node", "one", "far_one", "two", "far_two"])

    placed = nodes.select("node", "packed").mapInArrow(run, "node long, one long, far_one double, two long, far_two double")
    placed = settled(placed.withColumn("cell", F.col("one") * len(books[1]) + F.col("two")), "cells")
    cells = settled(placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far_one").alias("far_one"), F.max("far_two").alias("far_two")), "sizes")
    got = cells.toArrow()
    cell, sizes = got.column("cell").to_numpy(), np.zeros(len(books[0]) * len(books[1]), np.int64)
    sizes[cell] = got.column("n").to_numpy()
    radii = (np.full(len(books[0]), -1.0), np.full(len(books[1]), -1.0))
    np.maximum.at(radii[0], cell // len(books[1]), np.sqrt(got.column("far_one").to_numpy()))
    np.maximum.at(radii[1], cell % len(books[1]), np.sqrt(got.column("far_two").to_numpy()))

    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / settings.list_rows)).cast("int")
    tied = F.coalesce(F.element_at("ids", 1)["vec_id"], F.lit(MOST))
    rows = placed.select("node", "cell").join(cells.select("cell", "n"), "cell").select("node", "cell", part.alias("part"))
    rows = rows.join(nodes.select("node", "label", "packed", tied.alias("tied")), "node")
    lists = rows.groupBy("cell", "part").agg(F.collect_list(F.struct("node", "label", "tied", "packed")).alias("rows"))
    return Index(width, books, radii, sizes, settled(lists, "lists"))


def visited_cells(bounds: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, floor: float, budget: float) -> list[int]:
    """Cells by falling sum of half bounds, down to ``floor`` or until they hold ``budget`` rows."""
    order = [np.argsort(-b, kind="stable") for b in bounds]
    one, two = (b[o] for b, o in zip(bounds, order, strict=True))
    heap, done, cells, members = [(-(one[0] + two[0]), 0, 0)], set(), [], 0
    while heap:
        bound, i, j = heapq.heappop(heap)
        if -bound < floor or members >= budget:
            break
        done.add((i, j))
        cell = int(order[0][i]) * len(two) + int(order[1][j])
        if sizes[cell]:
            cells.append(cell)
            members += int(sizes[cell])
        for x, y, other in ((i + 1, j, (i + 1, j - 1)), (i, j + 1, (i - 1, j + 1))):
            if x < len(one) and y < len(two) and (min(other) < 0 or other in done):
                heapq.heappush(heap, (-(one[x] + two[y]), x, y))
    return cells


def visits(searches: DataFrame, index: Index, budget: float) -> DataFrame:
    """(cell, query) for every cell a search has to visit; searches are (query, packed, floor)."""
    width, radii, sizes, books = index.width, index.radii, index.sizes, index.books
    half = width // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                x, cells = matrix(part.column(1), width), []
                sides = []
                for y, book, radius in zip((x[:, :half], x[:, half:]), books, radii, strict=True):
                    bound = y @ book.T + np.sqrt((y**2).sum(1))[:, None] * np.maximum(radius, 0)
                    bound += 1e-6 + 1e-9 * np.abs(bound)
                    sides.append(np.where(radius < 0, -np.inf, bound))
                for one, two, floor in zip(*sides, part.column(2).to_pylist(), strict=True):
                    cells.append(visited_cells((one, two), sizes, floor, budget))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cells, pa.list_(pa.int64()))], names=["query", "cells"])

    found = searches.select("query", "packed", "floor").mapInArrow(run, "query long, cells array<long>")
    return found.select("query", F.explode("cells").alias("cell"))


def best_rows(searches: DataFrame, index: Index, same: bool, wanted: int, budget: float, n_queries: int, settings: Settings) -> DataFrame:
    """(query, window, node, score): the best ``wanted`` nodes of each window among the visited cells.

    ``searches``: query, label, packed, floor, windows (array of window, low, high).
    """
    groups = max(1, -(-n_queries // settings.group_rows))
    seen = visits(searches, index, budget).join(searches.select("query", "label", "packed", "windows"), "query")
    dealt = seen.groupBy("cell", F.pmod(F.xxhash64("query"), F.lit(groups)).alias("group")).agg(
        F.collect_list(F.struct("query", "label", "packed", "windows")).alias("queries")
    )
    work = dealt.join(index.lists, "cell").select("queries", "rows")
    width = index.width

    def columns(cells: pa.StructArray, names: tuple[str, ...]) -> list[np.ndarray]:
        return [cells.field(n).to_numpy(zero_copy_only=False) for n in names]

    def one(queries: pa.StructArray, rows: pa.StructArray) -> list[np.ndarray] | None:
        query, label = columns(queries, ("query", "label"))
        node, other, tied = columns(rows, ("node", "label", "tied"))
        score = np.rint(matrix(queries.field("packed"), width) @ matrix(rows.field("packed"), width).T).astype(np.int64)
        fits = (label[:, None] == other) == same
        given = queries.field("windows").to_pylist()
        found = []
        for k in range(max(map(len, given))):
            low = np.array([w[k]["low"] if k < len(w) else MOST for w in given])
            high = np.array([w[k]["high"] if k < len(w) else LEAST for w in given])
            q, n = np.nonzero(fits & (score >= low[:, None]) & (score <= high[:, None]))
            s = score[q, n]
            order = np.lexsort((tied[n], -s, q))
            q, n, s = q[order], n[order], s[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            keep = rank < wanted
            q, n, s = q[keep], n[keep], s[keep]
            window = np.array([w[k]["window"] if k < len(w) else 0 for w in given], np.int64)
            found.append([query[q], window[q], node[n], s, tied[n]])
        return [np.concatenate(c) for c in zip(*found, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                made = one(b.column(0).slice(i, 1).flatten(), b.column(1).slice(i, 1).flatten())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], names=["query", "window", "node", "score", "tied"])

    found = work.mapInArrow(run, "query long, window long, node long, score long, tied long")
    rank = F.row_number().over(Window.partitionBy("query", "window").orderBy(F.desc("score"), "tied", "node"))
    return found.withColumn("rank", rank).where(F.col("rank") <= wanted).drop("rank", "tied")


def search(searches: DataFrame, index: Index, same: bool, wanted: int, n_queries: int, settings: Settings) -> DataFrame:
    """Certified best rows of each window: a first round finds how low it has to go, a second goes there.

    ``searches``: query, label, packed, windows.
    """
    lowest = F.array_min(F.transform("windows", lambda w: w["low"]))
    first = settled(best_rows(searches.withColumn("floor", F.lit(LEAST).cast("double")), index, same, wanted, settings.seed_rows, n_queries, settings), "seeds")
    reached = first.groupBy("query", "window").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= wanted)
    reached = reached.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("window", "least"))).alias("reached"))
    raised = F.transform(
        "windows",
        lambda w: F.struct(w["window"].alias("window"), F.greatest(w["low"], F.try_element_at(F.col("reached"), w["window"])).alias("low"), w["high"].alias("high")),
    )
    again = searches.join(settled(reached, "reached"), "query", "left").withColumn("windows", F.when(F.col("reached").isNull(), F.col("windows")).otherwise(raised))
    again = settled(again.drop("reached").withColumn("floor", lowest.cast("double")), "searches")
    return settled(best_rows(again, index, same, wanted, float("inf"), n_queries, settings), "best")


def hard_negatives(vectors: DataFrame, is_anchor: Column, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``vectors``: vec_id, embedding, label."""
    rows = whole_vectors(vectors, settings)
    nodes = settled(nodes_of(rows, settings), "nodes")
    index = build_index(nodes, settings)
    anchors = rows.where(F.coalesce(is_anchor, F.lit(False)) & F.col("vec_id").isNotNull())
    anchors = settled(anchors.join(nodes.select("node", "label", "packed"), ["label", "packed"]).select("row", "vec_id", F.col("node").alias("query")), "anchors")
    queries = settled(
        anchors.select("query").distinct().join(nodes.select(F.col("node").alias("query"), "label", "packed"), "query"), "queries"
    )
    n_queries = queries.count()

    everything = F.array(F.struct(F.lit(0).cast("long").alias("window"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high")))
    near = search(queries.withColumn("windows", everything), index, True, settings.positives + 1, n_queries, settings)

    def with_ids(best: DataFrame, wanted: int, name: str) -> DataFrame:
        """The first ``wanted`` rows of each query and window, as an array of score, vec_id, row."""
        each = best.join(nodes.select("node", "ids"), "node").select("query", "window", "score", F.explode("ids").alias("id"))
        key = F.struct((-F.col("score")).alias("falling"), F.col("id.vec_id").isNull().alias("no_id"), F.col("id.vec_id").alias("vec_id"), F.col("id.row").alias("row"))
        return each.groupBy("query", "window").agg(F.slice(F.array_sort(F.collect_list(key)), 1, wanted).alias(name))

    near = settled(with_ids(near, settings.positives + 1, "near").select("query", "near"), "positives")
    windows = F.expr(
        "transform(filter(array_distinct(transform(near, x -> -x.falling)), p -> p >= 0), p -> "
        f"named_struct('window', p, 'low', (p * {settings.low} + 99) div 100, 'high', p * {settings.high} div 100))"
    )
    wanted = queries.join(near, "query").select("query", "label", "packed", windows.alias("windows")).where("size(windows) > 0")
    far = search(settled(wanted, "windows"), index, False, settings.negatives, n_queries, settings)
    far = settled(with_ids(far, settings.negatives, "far"), "negatives")

    other = F.filter("near", lambda x: x["row"] != F.col("row"))
    pairs = anchors.join(near, "query").select("query", F.col("vec_id").alias("anchor_id"), F.explode(F.slice(other, 1, settings.positives)).alias("positive"))
    pairs = pairs.select("query", "anchor_id", F.col("positive.vec_id").alias("positive_id"), (-F.col("positive.falling")).alias("positive_score"))
    far = far.select(F.col("query").alias("far_query"), "window", "far")
    found = pairs.join(far, (F.col("query") == F.col("far_query")) & (F.col("positive_score") == F.col("window")))
    found = found.select("anchor_id", "positive_id", "positive_score", F.posexplode("far").alias("at", "negative"))
    return found.select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("negative.vec_id").alias("negative_id"),
        "positive_score", (-F.col("negative.falling")).alias("negative_score"),
    )
