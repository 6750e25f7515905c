"""Hard-negative mining by dual-tree search over anchors and candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.common import few, stored

#: Components are scaled by SCALE and floored; positives of an anchor, negatives of a positive, and the share of the
#: positive's score, in hundredths, that a negative has at least and at most.
SCALE, POSITIVES, NEGATIVES, LEAST, MOST = 256, 5, 10, 30, 90
#: Rows of a shard, cells that shards are cut from, and rows of a leaf.
SHARD, CELLS, LEAF = 8192, 256, 128
_LONG = (1 << 63) - 1


def usable(embedding: str) -> Column:
    """Whether a vector has neither a null nor a non-finite component."""
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite, F.lit(False))


def scaled(vectors, scale: float = SCALE) -> np.ndarray:
    """Vectors of one length as whole numbers in doubles."""
    values = np.array([np.asarray(v, np.float64) for v in vectors])
    return np.floor(values.reshape(len(vectors), values.size // max(1, len(vectors))) * scale)


class Ball:
    """A node of a tree: its rows, a ball around them, and two halves unless it is a leaf."""

    __slots__ = ("rows", "center", "radius", "norm", "halves")

    def __init__(self, points: np.ndarray, rows: np.ndarray, leaf: int):
        own = points[rows]
        self.rows, self.center = rows, own.mean(0)
        away = np.sqrt(((own - self.center) ** 2).sum(1))
        self.radius, self.norm, self.halves = float(away.max()), float(np.sqrt((self.center**2).sum())), ()
        if len(rows) > leaf:
            one = own[away.argmax()]
            two = own[((own - one) ** 2).sum(1).argmax()]
            order = np.argsort(own @ (two - one), kind="stable")
            half = len(rows) // 2
            self.halves = tuple(Ball(points, rows[x], leaf) for x in (order[:half], order[half:]))


def interval(x: Ball, y: Ball) -> tuple[float, float]:
    """What the inner product of a point of x with one of y is at least and at most, by the balls around them."""
    middle, slack = float(x.center @ y.center), x.radius * y.norm + y.radius * x.norm + x.radius * y.radius
    slack += 1e-9 * (slack + x.norm * y.norm + 1)
    return middle - slack, middle + slack


def exact_in_doubles(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether no inner product of whole numbers, nor a sum on the way to it, leaves what doubles hold exactly."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return most < 2.0**53


def dual_search(anchors: np.ndarray, points: np.ndarray, allowed: Callable[[np.ndarray, np.ndarray], np.ndarray], least: np.ndarray, most: np.ndarray, k: int, leaf: int = LEAF, tree: Ball | None = None, visited: list | None = None):
    """(anchor, want, row, score) of the `k` largest inner products of each anchor and each of its wants within
    [least, most] (a row for each anchor, a column for each want), and of all rows that tie with the k-th; in no order.

    `allowed(anchor rows, point rows)` is the matrix of pairs that count. A pair of nodes is left out if the interval of
    its inner products lies above all wants of its anchors, or below what each of these wants still takes: its least,
    and the k-th best found so far. Nodes that may have the largest products come first. Pairs of leaves are scored exactly.
    `visited` gets the number of products of each such pair.
    """
    kind = np.float64 if exact_in_doubles(anchors, points) else object
    a, b = (x if kind is np.float64 else np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) for x in (anchors, points))
    wants = least.shape[1]
    best = np.full((len(a), wants, k), -np.inf, kind)
    bar = least.astype(np.float64)
    top = most.astype(np.float64).max(1, initial=-np.inf)
    low, high = least.astype(kind), most.astype(kind)
    out = [[np.zeros(0, int)] * 3 + [np.zeros(0, kind)]]
    with np.errstate(over="ignore", invalid="ignore"):
        tree = tree or Ball(points, np.arange(len(points)), leaf)
        stack = [(Ball(anchors, np.arange(len(anchors)), leaf), tree)]
        while stack:
            x, y = stack.pop()
            from_, to = interval(x, y)
            # Doubles may be rounded, so a bar is met a little below it.
            if to < bar[x.rows].min() - 1e-6 * abs(bar[x.rows].min()) or from_ > top[x.rows].max() + 1e-6 * abs(top[x.rows].max()):
                continue
            if x.halves and (not y.halves or x.radius * y.norm >= y.radius * x.norm):
                stack += [(half, y) for half in x.halves]
                continue
            if y.halves:
                stack += sorted(((x, half) for half in y.halves), key=lambda p: float(x.center @ p[1].center))
                continue
            if visited is not None:
                visited.append(len(x.rows) * len(y.rows))
            product = a[x.rows] @ b[y.rows].T
            fit = allowed(x.rows, y.rows)
            for want in range(wants):
                inside = fit & (product >= low[x.rows, want][:, None]) & (product <= high[x.rows, want][:, None]) & (product >= best[x.rows, want, -1][:, None])
                rows = np.flatnonzero(inside.any(1))
                if not len(rows):
                    continue
                here, inside = x.rows[rows], inside[rows]
                found = np.where(inside, product[rows], -np.inf)
                best[here, want] = -np.sort(-np.hstack([best[here, want], found]), axis=1)[:, :k]
                kth = best[here, want, -1]
                bar[here, want] = np.maximum(least[here, want].astype(np.float64), kth.astype(np.float64))
                i, j = np.nonzero(inside & (found >= kth[:, None]))
                out.append([here[i], np.full(len(i), want), y.rows[j], found[i, j]])
    anchor, want, row, score = (np.concatenate(x) for x in zip(*out))
    kept = np.flatnonzero(score >= best[anchor, want, -1]) if len(anchor) else np.zeros(0, int)
    return anchor[kept], want[kept], row[kept], score[kept]


def bounds(score: int, least: int = LEAST, most: int = MOST) -> tuple[int, int]:
    """The whole scores s with least * score <= 100 * s <= most * score, from and to; none if from exceeds to."""
    return -(-least * score // 100), most * score // 100


def _leading(frame: pd.DataFrame, by: list[str], k: int) -> pd.DataFrame:
    frame = frame.sort_values([*by, "score", "vec_id"], ascending=[True] * len(by) + [False, True], kind="stable")
    return frame.groupby(by).head(k)


def _met(points: DataFrame, asks: DataFrame, ask: Callable, ddl: str) -> DataFrame:
    """What `ask(shard's rows, their tree, anchors)` finds where `points` and `asks` share a `shard`. Both are shuffled by
    it; a shard's tree is built once, and the anchors stream through its task behind its points, near ones together."""
    spark = points.sparkSession
    both = points.unionByName(asks, allowMissingColumns=True)
    both = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard").sortWithinPartitions("shard", "asks", "cell")

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, waiting, ready = None, [], None
        for batch in batches:
            for name, rows in batch.groupby("shard", sort=False):
                if name != now:
                    now, waiting, ready = name, [], None
                own, anchors = rows[~rows["asks"]], rows[rows["asks"]]
                if len(own):
                    waiting.append(own[["vec_id", "label", "embedding"]])
                if not len(anchors) or not (waiting or ready):
                    continue
                if ready is None:
                    held, waiting = pd.concat(waiting, ignore_index=True), []
                    values = scaled(held["embedding"])
                    ready = held["vec_id"].to_numpy(), held["label"].to_numpy(), values, Ball(values, np.arange(len(held)), LEAF)
                yield ask(*ready, anchors.reset_index(drop=True))

    return both.mapInPandas(answer, ddl)


def _clipped(scores: np.ndarray) -> list[int]:
    return [max(-_LONG, min(_LONG, int(x))) for x in scores]


def _positives(k: int) -> Callable:
    def ask(ids, labels, values, tree, anchors):
        names = anchors["vec_id"].to_numpy()
        free = np.full((len(anchors), 1), np.inf)
        a, _, row, score = dual_search(scaled(anchors["embedding"]), values, lambda x, y: names[x][:, None] != ids[y][None, :], -free, free, k, tree=tree)
        found = pd.DataFrame({"anchor_id": names[a], "vec_id": ids[row], "score": _clipped(score)})
        return _leading(found, ["anchor_id"], k)

    return ask


def _negatives(k: int, least: int, most: int) -> Callable:
    def ask(ids, labels, values, tree, anchors):
        names, own = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
        wants = [list(map(int, x)) for x in anchors["wants"]]
        low = np.full((len(anchors), max(map(len, wants))), 1, object)
        high = np.full(low.shape, 0, object)
        for i, scores in enumerate(wants):
            for j, score in enumerate(scores):
                low[i, j], high[i, j] = bounds(score, least, most)
        a, want, row, score = dual_search(scaled(anchors["embedding"]), values, lambda x, y: own[x][:, None] != labels[y][None, :], low, high, k, tree=tree)
        found = pd.DataFrame({"anchor_id": names[a], "positive_score": [wants[i][j] for i, j in zip(a, want)], "vec_id": ids[row], "score": _clipped(score)})
        return _leading(found, ["anchor_id", "positive_score"], k)

    return ask


def hard_negatives(vectors: DataFrame, anchor: Column, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, shard: int = SHARD) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor, a row of `vectors`
    where `anchor` holds, and each of its `positives` best other rows of its label, the `negatives` best rows of other
    labels whose score is from `least` to `most` hundredths of the positive's. Scores are inner products of scaled, floored
    vectors; higher ones come first, then smaller ids; there are fewer rows where there are fewer.

    Rows with a null id, label or vector, or a null or non-finite component take no part; zero vectors do. Vectors of
    another length than an anchor's are neither its positives nor its negatives. Of rows that repeat an id, the one of the
    smallest label and vector counts. A score beyond a long is the largest long. Empty tables and labels of one row give
    no rows; `anchor` is a condition on the id; other columns are ignored.

    Anchors meet the rows of their label in shards by label and hash for positives, then all rows in shards of near
    ones, cut from the cells of at most CELLS pivots, for negatives; a cell is not asked if the interval of its inner
    products with an anchor is outside all wanted scores. In a shard, trees over its rows and over a batch of anchors are
    searched together. Of equal vectors of a label only the smallest ids can be found, so the others are left out before
    the shuffle. A task holds the rows of a shard and a batch of anchors; results are ranked by windows with a limit.
    """
    spark = vectors.sparkSession
    named = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    named = named.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding"))
    rows = named.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("r")).select("vec_id", "r.*").withColumn("dim", F.size("embedding"))
    rows = stored(rows, "rows")
    kinds = dict(rows.dtypes)
    turn = F.row_number().over(W.partitionBy("label", "embedding").orderBy("vec_id"))
    points = stored(rows.withColumn("turn", turn).where(F.col("turn") <= max(positives + 1, negatives)).drop("turn"), "points")
    anchors = rows.where(anchor)

    def parts(n: Column) -> Column:
        return F.ceil(n / shard).cast("int")

    def spread(df: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
        dealt = df.join(few(sizes), by).withColumn("part", F.pmod(F.xxhash64("vec_id", "label"), F.col("parts")).cast("int"))
        return dealt.select("vec_id", "label", "embedding", F.lit(False).alias("asks"), F.xxhash64(*by, "part").alias("shard"), F.lit(0).alias("cell"))

    sizes = stored(points.groupBy("dim", "label").agg(parts(F.count("*")).alias("parts")), "labels")
    asks = anchors.join(few(sizes), ["dim", "label"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asks = asks.select("vec_id", "label", "embedding", F.lit(True).alias("asks"), F.xxhash64("dim", "label", "part").alias("shard"), F.lit(0).alias("cell"))
    near = _met(spread(points, sizes, ["dim", "label"]), asks, _positives(positives), "anchor_id long, vec_id long, score long")
    order = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    near = stored(near.withColumn("at", order).where(F.col("at") <= positives), "positives")

    wants = near.groupBy("anchor_id").agg(F.collect_set("score").alias("wants"))
    asked = anchors.join(wants, anchors["vec_id"] == wants["anchor_id"]).drop("anchor_id")
    # Pivots: the rows of the smallest hashes of each length of vectors, as many as there are shards, CELLS at most.
    lengths = points.groupBy("dim").agg(F.least(F.lit(CELLS), parts(F.count("*"))).alias("pivots"))
    first = F.row_number().over(W.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id"))
    chosen = points.select("vec_id", "dim", "embedding").withColumn("at", first).where(F.col("at") <= CELLS).join(F.broadcast(lengths), "dim").where("at <= pivots")
    pivots = {d: scaled(list(x["embedding"])) for d, x in chosen.toPandas().groupby("dim")}

    def place(batches):
        for batch in batches:
            for dim, here in batch.groupby("dim"):
                values, to = scaled(here["embedding"]), pivots[dim]
                far = np.maximum(0, (values**2).sum(1)[:, None] - 2 * values @ to.T + (to**2).sum(1))
                far = np.nan_to_num(far, nan=np.inf)
                cell = far.argmin(1)
                yield here.assign(cell=cell, away=np.sqrt(((values - to[cell]) ** 2).sum(1)))

    placed = points.mapInPandas(place, f"vec_id long, label {kinds['label']}, embedding {kinds['embedding']}, dim int, cell int, away double")
    placed = stored(placed, "placed")
    cells = stored(placed.groupBy("dim", "cell").agg(parts(F.count("*")).alias("parts"), F.max("away").alias("away")), "cells")
    reach = {d: x.sort_values("cell") for d, x in cells.toPandas().groupby("dim")}

    def route(batches):
        for batch in batches:
            for dim, here in batch.groupby("dim"):
                if dim not in reach:
                    continue
                values, held = scaled(here["embedding"]), reach[dim]
                middle = values @ pivots[dim][held["cell"]].T
                slack = np.sqrt((values**2).sum(1))[:, None] * held["away"].to_numpy()
                slack = slack + 1e-9 * (np.abs(middle) + slack + 1)
                ends = [[bounds(int(s), least, most) for s in x] for x in here["wants"]]
                low, high = (np.array([float(f(e[i] for e in x)) for x in ends])[:, None] for i, f in ((0, min), (1, max)))
                row, at = np.nonzero(~((middle + slack < low) | (middle - slack > high)))
                yield here.iloc[row].assign(cell=held["cell"].to_numpy()[at])

    asked = asked.select("vec_id", "label", "embedding", "dim", "wants")
    routed = asked.mapInPandas(route, f"vec_id long, label {kinds['label']}, embedding {kinds['embedding']}, dim int, wants array<long>, cell int")
    routed = routed.join(few(cells), ["dim", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    routed = routed.select("vec_id", "label", "embedding", "wants", F.lit(True).alias("asks"), F.xxhash64("dim", "cell", "part").alias("shard"), "cell")
    found = _met(spread(placed, cells.drop("away"), ["dim", "cell"]), routed, _negatives(negatives, least, most), "anchor_id long, positive_score long, vec_id long, score long")
    order = F.row_number().over(W.partitionBy("anchor_id", "positive_score").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("rank", order).where(F.col("rank") <= negatives).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    near = near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return near.join(found, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
