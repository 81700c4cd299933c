"""Embedding vectors and their search.

Searches take a table of queries against all vectors. The vectors are never broadcast; they
are scored in Arrow batches against blocks of queries by matrix products, each partition
keeps its best k per query before the shuffle, and a window ranks what is left. Queries are
broadcast in blocks of ``QUERY_BLOCK`` rows, ``BLOCKS`` of them, a fixed bound, to a scan.

Defined results: null or empty vectors and those of another dimension than the query have no
score and are not returned; ties are ranked by the vector's key; a zero vector stays zero.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import PROFILES, Config
from ..session import cut

#: Queries in a block, blocks in a scan, and vectors that are scored against a block at a time.
QUERY_BLOCK, BLOCKS, TILE = 4096, 6, 1024
#: More than sums in another order, and rounding to twelve places, can make of a score.
SLACK = 1e-11
#: Candidates whose exact scores are summed at a time, and the lengths of vectors for which
#: scores are first estimated in single precision.
EXACT, LENGTHS = 1024, (1e-12, 1e12)
#: Of a CellIndex: the recall that its probes are measured for, on so many queries and neighbours.
RECALL, TUNE, TUNE_K = 0.97, 256, 10


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column) -> Column:
    """Length one; a zero vector as it is."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))


def dimension(v: Column) -> Column:
    return F.size(v)


def _rank(cost: np.ndarray, keys: np.ndarray, row: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Places of the k[row] lowest costs of every row, ties by key."""
    order = np.lexsort((np.unique(keys, return_inverse=True)[1] if keys.dtype == object else keys, cost, row))
    sorted_row = row[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_row, sorted_row) < k[sorted_row]]


class _Best:
    """The best vectors of each query of a block so far, ``k`` or its own ``depth`` of them,
    none below its ``floor``. ``least`` is what a query's next one must reach; sums in another
    order differ by less than SLACK. Inner products are estimated in single precision, with
    a bound of the error, and the exact ones are summed of those that may reach it."""

    def __init__(self, ids: list, q: np.ndarray, k: int, metric: str, floor: np.ndarray | None = None, depth: np.ndarray | None = None):
        self.ids, self.q, self.metric = ids, q, metric
        self.depth = np.full(len(q), k) if depth is None else np.minimum(depth, k)
        self.k = int(self.depth.max())
        self.least = np.full(len(q), -np.inf) if floor is None else floor.astype(np.float64)
        size = _lengths(q)
        self.rough = q.astype(np.float32, copy=False) if metric == "ip" and _usual(size) else None
        self.error = (q.shape[1] + 8) * float(np.finfo(np.float32).eps) * size
        self.kept, self.found, self.waiting = None, [], 0

    def add(self, asked: np.ndarray, keys: np.ndarray, m: np.ndarray, size: np.ndarray) -> None:
        least = self.least[asked]
        new = ~np.isfinite(least)
        n = min(self.k, len(m))
        if self.rough is not None and _usual(size):
            all_asked = len(asked) == len(self.q)
            good = (self.rough if all_asked else self.rough[asked]) @ m.astype(np.float32, copy=False).T
            error = self.error[asked] * size.max()
            if new.any():
                least[new] = np.partition(good[new], len(m) - n, axis=1)[:, len(m) - n] - 2 * error[new]
            r, col = _reaching(good, least - error)
            many = np.bincount(r, minlength=len(asked)) > self.depth[asked]
            if many.any():  # so many here that they raise what is to be reached
                for d in np.unique(self.depth[asked[many]]):
                    x = np.flatnonzero(many & (self.depth[asked] == d))
                    least[x] = np.maximum(least[x], np.partition(good[x], len(m) - d, axis=1)[:, len(m) - d] - error[x])
                    self.least[asked[x]] = least[x]
                keep = good[r, col] >= (least - error - SLACK)[r]
                r, col = r[keep], col[keep]
            good = self._exact(asked[r], m, col)
            some = good >= (least - SLACK)[r]
            r, col, good = r[some], col[some], good[some]
        else:
            q, m = self.q[asked].astype(np.float64), m.astype(np.float64)
            good = q @ m.T
            if self.metric == "l2":
                good = -((q * q).sum(1)[:, None] - 2 * good + (m * m).sum(1)[None])
            if new.any():
                least[new] = np.partition(good[new], len(m) - n, axis=1)[:, len(m) - n]
            r, col = np.nonzero(good >= (least - SLACK)[:, None])
            good = good[r, col]
        if len(r):
            self.found.append((asked[r], keys[col], good))
            self.waiting += len(r)
        if self.waiting > self.depth.sum() or len(r) and new.any():
            self.merge()

    def _exact(self, rows: np.ndarray, m: np.ndarray, cols: np.ndarray) -> np.ndarray:
        out, q, m = np.empty(len(rows)), self.q.astype(np.float64), m.astype(np.float64)
        for a in range(0, len(rows), EXACT):
            part = slice(a, a + EXACT)
            out[part] = np.einsum("ij,ij->i", q[rows[part]], m[cols[part]])
        return out

    def merge(self) -> None:
        if not self.found:
            return
        row, keys, good = (np.concatenate(x) for x in zip(*([self.kept] if self.kept else []), *self.found))
        keep = _rank(-np.round(good, 12), keys, row, self.depth)
        row, keys, good = self.kept = row[keep], keys[keep], good[keep]
        self.found, self.waiting = [], 0
        last = np.flatnonzero(np.diff(row, append=-1))
        full = last[np.diff(last, prepend=-1) == self.depth[row[last]]]
        self.least[row[full]] = np.maximum(self.least[row[full]], good[full])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        self.merge()
        if not self.kept:
            return None
        row, keys, good = self.kept
        return np.asarray(self.ids)[row], keys, good if self.metric == "ip" else -good


def _reaching(good: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the estimates that reach their row's ``least``, which is rounded down."""
    return np.nonzero(good >= np.nextafter((least - SLACK).astype(np.float32), np.float32(-np.inf))[:, None])


def _lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", m, m, dtype=np.float64))


def _usual(size: np.ndarray) -> bool:
    """Whether products in single precision neither overflow nor vanish."""
    return bool(((size == 0) | (size > LENGTHS[0]) & (size < LENGTHS[1])).all())


def _kind(df: DataFrame, vec: str) -> type:
    return np.float32 if dict(df.dtypes)[vec] == "array<float>" else np.float64


def _pack(v: Column, kind: type) -> Column:
    """Vectors as bytes, exactly; null stays null."""

    @F.pandas_udf("binary")
    def pack(vs: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else zlib.compress(np.asarray(x, kind).tobytes(), 1) for x in vs], dtype=object)

    return pack(v)


def _unpack(v: bytes | np.ndarray | None, kind: type) -> np.ndarray | None:
    return np.frombuffer(zlib.decompress(v), kind) if isinstance(v, bytes) else v


def _best_of(vectors: DataFrame, shared, k: int, metric: str, key: str, vec: str, schema: str, kind: type, cell: str | None = None) -> DataFrame:
    """The k best vectors of every query within each partition: tiles of vectors are scored
    against blocks of queries by matrix products, and what they leave is merged into the best
    so far, so that a partition gives k rows a query whatever its size. With ``cell``, only
    the queries that probe a vector's cell are scored against it."""
    qkey = schema.split()[0]

    def score(batches):
        blocks = [(_Best(ids, q, k, metric, *bounds), probes) for ids, q, bounds, probes in shared.value]
        for pdf in batches:
            all_of = [_unpack(v, kind) for v in pdf[vec]]
            size = np.array([-1 if v is None else len(v) for v in all_of])
            for width in {b.q.shape[1] for b, _ in blocks}:
                ok = np.flatnonzero(size == width)
                if not len(ok):
                    continue
                keys, m = pdf[key].to_numpy()[ok], np.stack([all_of[i] for i in ok]).astype(kind)
                length = _lengths(m)
                tiles = [(None, np.arange(a, min(a + TILE, len(m)))) for a in range(0, len(m), TILE)]
                if cell:
                    at = pdf[cell].to_numpy()[ok]
                    order = np.argsort(at, kind="stable")
                    edge = np.flatnonzero(np.diff(at[order], prepend=-1))
                    tiles = [(int(at[x[a]]), x[a : a + TILE]) for x in np.split(order, edge[1:]) for a in range(0, len(x), TILE)]
                for b, probes in blocks:
                    if b.q.shape[1] != width:
                        continue
                    everyone = np.arange(len(b.q))
                    for c, mine in tiles:
                        asked = everyone if c is None else np.asarray(probes.get(c, ()), np.int64)
                        if len(asked):
                            b.add(asked, keys[mine], m[mine], length[mine])
        for b, _ in blocks:
            if (got := b.rows()) is not None:
                yield pd.DataFrame(dict(zip((qkey, key, "score"), got)))

    columns = [key, vec, *([cell] if cell else [])]
    # No filter on the vectors: it would make an embedder below run twice.
    return vectors.select(*columns).mapInPandas(score, schema)


def _in_blocks(queries: DataFrame, vectors: DataFrame, k: int, metric: str, qkey: str, key: str, qvec: str, vec: str, cell: str | None = None, probed=None, bounds: tuple[str, str] | None = None) -> DataFrame:
    """Queries go out in blocks of QUERY_BLOCK rows of one dimension, BLOCKS of them to a scan;
    a window ranks what the partitions leave. Where there are more, the vectors are written
    once, packed, and each scan's result before the next one is planned, so that the driver
    holds the queries and the plan of one. ``probed`` gives the cells of a block's queries.
    ``bounds`` names the columns of a query's lowest score and number of vectors: those
    beyond may be missing, or stand at another rank."""
    spark = queries.sparkSession
    qtype, ktype = dict(queries.dtypes)[qkey], dict(vectors.dtypes)[key]
    schema = f"{qkey} {qtype}, {key} {ktype}, score double"
    kind, kind_of_vectors = _kind(queries, qvec), _kind(vectors, vec)
    best = F.round("score", 12)
    w = Window.partitionBy(qkey).orderBy(best.desc() if metric == "ip" else best.asc(), key)
    clean = queries.where(F.col(qvec).isNotNull() & (F.size(qvec) > 0)).select(qkey, _pack(F.col(qvec), kind).alias("_q"), *(bounds or ()))
    n = clean.count()
    if several := n > QUERY_BLOCK * BLOCKS:
        vectors = cut(vectors.select(key, _pack(F.col(vec), kind_of_vectors).alias(vec), *([cell] if cell else [])))
    # A partition leaves k rows a query, so there are no more partitions than cores.
    vectors = vectors.coalesce(spark.sparkContext.defaultParallelism)

    def scan(blocks: list) -> tuple:
        shared = spark.sparkContext.broadcast([(ids, q, b, probed(q.astype(np.float64)) if probed else None) for ids, q, b in blocks])
        found = _best_of(vectors, shared, k, metric, key, vec, schema, kind_of_vectors, cell)
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(qkey, "rank", key, "score"), shared

    def block(ids: list, rows: list, ends: list) -> tuple:
        return ids, np.stack(rows), tuple(np.array(x) for x in zip(*ends)) if bounds else ()

    parts, blocks, held = [], [], {}
    # The driver takes a partition at a time, so these have a block's rows.
    clean = clean.repartition(max(1, -(-n // QUERY_BLOCK)))
    for r in clean.toLocalIterator():
        v = _unpack(bytes(r[1]), kind)
        ids, rows, ends = held.setdefault(len(v), ([], [], []))
        ids.append(r[0]), rows.append(v), ends.append(r[2:])
        if len(rows) == QUERY_BLOCK:
            if len(blocks) == BLOCKS:
                part, shared = scan(blocks)
                parts.append(cut(part))
                shared.destroy()
                blocks = []
            blocks.append(block(ids, rows, ends))
            del held[len(v)]
    blocks += [block(*x) for x in held.values()]
    if blocks:
        last = scan(blocks)[0]
        parts.append(cut(last) if several else last)
    if not parts:
        return spark.createDataFrame([], f"{qkey} {qtype}, rank int, {key} {ktype}, score double")
    return reduce(DataFrame.unionByName, parts)


def search(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "ip", qkey: str = "qid", key: str = "vec_id", qvec: str = "qvec", vec: str = "embedding") -> DataFrame:
    """(qid, rank, key, score) of the k best vectors of every query; ``score`` is the inner
    product ('ip', larger is better) or the squared distance ('l2', smaller is better)."""
    if metric not in ("ip", "l2"):
        raise ValueError(f"unknown metric {metric!r}")
    return _in_blocks(queries, vectors, k, metric, qkey, key, qvec, vec)


def retrieve(queries: DataFrame, vectors: DataFrame, cfg: Config = PROFILES["module"], **names: str) -> DataFrame:
    """Top k, then the threshold on the unrounded score; ranks are those before it. Scores
    are rounded to four places, and given in percent."""
    found = search(queries, vectors, cfg.top_k or 5, **names).where(F.col("score") >= cfg.min_score)
    return found.withColumns({"score_percent": F.round(F.round("score", 4) * 100, 2), "score": F.round("score", 4)})


def routes(question_en: Column, cfg: Config = PROFILES["module"]) -> dict[str, Column]:
    """k and threshold of the first try and of the retry, by whether a summary is asked."""
    q = F.lower(question_en)
    summary = F.coalesce(F.contains(q, F.lit("summary")) | F.contains(q, F.lit("summarise")) | F.contains(q, F.lit("summarize")), F.lit(False))
    return {
        "is_summary": summary,
        "k": F.when(summary, max(cfg.summary_least_k, cfg.summary_factor_k * cfg.top_k)).otherwise(cfg.top_k),
        "min_score": F.when(summary, cfg.min_score * cfg.summary_factor_score).otherwise(cfg.min_score),
        "retry_k": F.lit(cfg.top_k + cfg.retry_more_k),
        "retry_min_score": F.lit(cfg.min_score * cfg.retry_factor_score),
    }


def retrieve_routed(questions: DataFrame, vectors: DataFrame, text: str = "question_en", cfg: Config = PROFILES["module"], **names: str) -> DataFrame:
    """One search for both tries: flags say which rows belong to the first and the retry."""
    qkey = names.get("qkey", "qid")
    deepest = max(cfg.summary_least_k, cfg.summary_factor_k * cfg.top_k, cfg.top_k + cfg.retry_more_k)
    routed = questions.select(qkey, text).withColumns(routes(F.col(text), cfg)).drop(text)
    qvec, key, vec = names.get("qvec", "qvec"), names.get("key", "vec_id"), names.get("vec", "embedding")
    # Rows that neither try takes need not be found.
    asked = questions.select(qkey, qvec, text).withColumns(routes(F.col(text), cfg))
    asked = asked.select(qkey, qvec, F.least("min_score", "retry_min_score").cast("double").alias("_floor"), F.greatest("k", "retry_k").cast("int").alias("_depth"))
    found = _in_blocks(asked, vectors, deepest, "ip", qkey, key, qvec, vec, bounds=("_floor", "_depth")).join(routed, qkey)
    found = found.withColumns({"first": (F.col("rank") <= F.col("k")) & (F.col("score") >= F.col("min_score")), "retry": (F.col("rank") <= F.col("retry_k")) & (F.col("score") >= F.col("retry_min_score"))})
    return found.where("first or retry")


class CellIndex:
    """Approximate search: k-means cells, fitted on at most ``sample`` vectors by hash; every
    vector is assigned to its cell, and a query is scored against the vectors of its
    ``probes`` nearest cells by matrix products, without a shuffle of vectors. Cells, unless
    given, are min(n // 10, 100), from 10,000 vectors on the square root of n. Probes, unless
    given, are measured: as few as hold ``recall`` of the TUNE_K exact neighbours of TUNE
    sample vectors. ``recall=1`` with probes=cells is the exact way."""

    def __init__(self, vectors: DataFrame, cells: int | None = None, sample: int = 50_000, key: str = "vec_id", vec: str = "embedding", seed: int = 0, recall: float = RECALL):
        self.key, self.vec = key, vec
        ok = vectors.where(F.col(vec).isNotNull() & (F.size(vec) > 0))
        n = ok.count()
        if not n:
            raise ValueError("cannot index an empty table")
        cells = cells or max(1, min(n // 10, 100), int(n**0.5) if n >= 10_000 else 1)
        rows = ok.select(vec, F.xxhash64(key).alias("_h")).orderBy("_h").limit(sample).select(vec).toPandas()[vec]
        x = np.stack(rows.to_list()).astype(np.float64)
        rng = np.random.RandomState(seed)
        c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
        for _ in range(12):
            near = _nearest_cell(x, c)
            size = np.bincount(near, minlength=len(c))
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
        self.centres = c
        self.probes = self._tuned(x, recall)
        shared = vectors.sparkSession.sparkContext.broadcast(c)

        @F.pandas_udf("int")
        def cell(v: pd.Series) -> pd.Series:
            return pd.Series(_nearest_cell(np.stack(v.to_list()).astype(np.float64), shared.value).astype(np.int32)) if len(v) else pd.Series([], dtype=np.int32)

        self.table = ok.withColumn("cell", cell(F.col(vec)))

    def _order(self, q: np.ndarray) -> np.ndarray:
        c = self.centres
        return np.argsort(-2 * q @ c.T + (c * c).sum(1)[None], axis=1, kind="stable")

    def _tuned(self, x: np.ndarray, recall: float) -> int:
        q = x[:TUNE]
        near = _nearest_cell(x, self.centres)
        place = np.argsort(self._order(q), axis=1)  # of each cell in a query's order
        top = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :TUNE_K]
        needed = np.sort(place[np.arange(len(q))[:, None], near[top]].ravel())
        return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1

    def search(self, queries: DataFrame, k: int, probes: int | None = None, qkey: str = "qid", qvec: str = "qvec") -> DataFrame:
        width = probes or self.probes

        def probed(q: np.ndarray) -> dict[int, list[int]]:
            asked: dict[int, list[int]] = {}
            for i, cells in enumerate(self._order(q)[:, :width]):
                for c in cells.tolist():
                    asked.setdefault(c, []).append(i)
            return asked

        return _in_blocks(queries, self.table, k, "ip", qkey, self.key, qvec, self.vec, "cell", probed)


def _nearest_cell(m: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (-2 * m @ c.T + (c * c).sum(1)[None]).argmin(1)


def chunk_by_id(index: DataFrame, doc_id: int, chunk_id: int) -> DataFrame:
    """The chunk's row; none if there is none. The key reaches the scan as a filter."""
    return index.where((F.col("doc_id") == doc_id) & (F.col("chunk_id") == chunk_id))


def total_chunks(index: DataFrame | None) -> int:
    """Chunks with a vector; 0 where nothing is indexed."""
    return 0 if index is None else index.where(F.col("embedding").isNotNull()).count()
