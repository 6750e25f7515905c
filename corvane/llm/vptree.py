"""Approximate nearest neighbours by vantage-point trees, one for each shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.common import stored
from corvane.llm.embedding_dedup import unit, usable

#: Neighbours, rows of a shard, rows of a leaf, and the pruning factor: 1 is exact.
K, SHARD, LEAF, FACTOR = 5, 4096, 128, 1.0
#: Vectors that come to the driver: what they are near to bounds a query's search, and the first are pivots of shards.
SAMPLE, PIVOTS = 4096, 256
#: Different vectors of one id in a shard up to which they are points of the tree.
OF_ONE_ID = 8
#: Cosines this near are a tie until scores and ids decide; an angle's rounding error near zero.
TIE, SLACK = 1e-12, 1e-7


def build(units: np.ndarray, leaf: int = LEAF, seed: int = 7):
    """A tree over rows of unit vectors: (rows,) for a leaf, else (vantage row, radius, inner, outer). The vantage row
    stays in the inner half."""
    rng = np.random.default_rng(seed)

    def node(rows: np.ndarray):
        if len(rows) <= leaf:
            return (rows,)
        vantage = rows[rng.integers(len(rows))]
        angles = np.arccos(np.clip(units[rows] @ units[vantage], -1, 1))
        order = np.argsort(angles, kind="stable")
        half = len(rows) // 2
        return vantage, (angles[order[half - 1]], angles[order[half]]), node(rows[order[:half]]), node(rows[order[half:]])

    return node(np.arange(len(units)))


def search(tree, units: np.ndarray, queries: np.ndarray, k: int, factor: float = FACTOR, floor: np.ndarray | None = None, visited: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the `k` nearest rows of each query and of every row that ties with the k-th, in no order.

    `floor`: a cosine for each query below which its neighbours are of no use. All queries walk the tree together. By
    the triangle inequality a half can be left out for a query if it begins farther from the vantage point than the
    query, by more than the k-th best angle so far. That angle times `factor` is what has to be exceeded: below one it
    prunes more and may miss neighbours. `visited` gets the number of queries at each leaf.
    """
    best = np.full((len(queries), k), -2.0)
    floor = np.full(len(queries), -2.0) if floor is None else floor
    out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]

    def bar(active):
        return np.maximum(best[active, -1], floor[active])

    def visit(node, active: np.ndarray):
        if not len(active):
            return
        if len(node) == 1:
            here = node[0]
            if visited is not None:
                visited.append(len(active))
            cosine = queries[active] @ units[here].T
            best[active] = -np.sort(-np.hstack([best[active], cosine]), axis=1)[:, :k]
            i, j = np.nonzero(cosine >= bar(active)[:, None] - TIE)
            out.append((active[i], here[j], cosine[i, j]))
            return
        vantage, (inner_to, outer_from), inner, outer = node
        angle = np.arccos(np.clip(queries[active] @ units[vantage], -1, 1))
        first = angle <= (inner_to + outer_from) / 2

        def reach(at):
            worst = bar(active[at])
            return np.where(worst <= -1.0, np.inf, np.arccos(np.clip(worst, -1, 1)) * factor + SLACK)

        visit(inner, active[first])
        visit(outer, active[~first])
        over = np.flatnonzero(first)
        visit(outer, active[over[outer_from - angle[over] <= reach(over)]])
        under = np.flatnonzero(~first)
        visit(inner, active[under[angle[under] - inner_to <= reach(under)]])

    visit(tree, np.arange(len(queries)))
    query, row, cosine = (np.concatenate(x) for x in zip(*out))
    kept = cosine >= bar(query) - TIE
    return query[kept], row[kept]


def cosines(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The cosine of each row of `one` with the same row of `two`, from the vectors as they are, in double precision; of
    their unit vectors where squares overflow or vanish."""
    with np.errstate(all="ignore"):
        size = np.sqrt(np.einsum("ij,ij->i", one, one) * np.einsum("ij,ij->i", two, two))
        out = np.einsum("ij,ij->i", one, two) / size
    odd = np.flatnonzero(~((size > 1e-140) & (size < 1e140)))
    if len(odd):
        out[odd] = np.einsum("ij,ij->i", unit(one[odd])[0], unit(two[odd])[0])
    return np.clip(out, -1, 1)


class Shard:
    """The points of a shard, each different vector once, with its ids, and their tree. Ids of over `OF_ONE_ID` different
    vectors are aside: their vectors are compared one by one, so that no such id widens the search for the others."""

    def __init__(self, rows: pd.DataFrame, k: int, leaf: int):
        rows = rows.sort_values("vec_id", kind="stable")
        vectors = np.array([np.asarray(v, np.float64) for v in rows["embedding"]]) + 0.0
        point, _ = pd.factorize(np.array([x.tobytes() for x in vectors], object))
        members = pd.DataFrame({"point": point, "vec_id": rows["vec_id"].to_numpy()}).drop_duplicates()
        vectors = vectors[pd.Series(point).drop_duplicates().index]
        times = members["vec_id"].map(members["vec_id"].value_counts())
        aside = members[times > OF_ONE_ID].sort_values("vec_id", kind="stable")
        members = members[times <= OF_ONE_ID]
        self.many, self.of = vectors[aside["point"]], aside["vec_id"].to_numpy()
        used = np.unique(members["point"])
        self.vectors = vectors[used]
        self.units = unit(self.vectors)[0] if len(used) else self.vectors
        members = members.assign(point=np.searchsorted(used, members["point"]))
        # An id may stand at several points: so many more are looked for, one of them for the query's own id.
        self.k, self.wanted = k, (k + 1) * int(times[times <= OF_ONE_ID].max() if len(members) else 1)
        # Of equal vectors, the smallest ids are enough.
        self.members = members.groupby("point").head(k + 1)
        self.tree = build(self.units, leaf) if len(used) else None

    def ask(self, rows: pd.DataFrame, factor: float) -> pd.DataFrame:
        """(query_id, vec_id, score): the shard's nearest of each row, ties to smaller ids."""
        asked, names, found = np.array([np.asarray(v, np.float64) for v in rows["embedding"]]), rows["vec_id"].to_numpy(), []
        if self.tree is not None:
            query, row = search(self.tree, self.units, unit(asked)[0], self.wanted, factor, rows["floor"].to_numpy(float))
            score = np.concatenate([np.zeros(0), *[cosines(asked[query[at : at + 8192]], self.vectors[row[at : at + 8192]]) for at in range(0, len(query), 8192)]])
            found.append(pd.DataFrame({"query_id": names[query], "point": row, "score": score}).merge(self.members, on="point")[["query_id", "vec_id", "score"]])
        for at in range(0, len(self.of), 8192):
            ids, first = np.unique(self.of[at : at + 8192], return_index=True)
            for i, x in enumerate(asked):
                near = cosines(np.broadcast_to(x, self.many[at : at + 8192].shape), self.many[at : at + 8192])
                found.append(pd.DataFrame({"query_id": names[i], "vec_id": ids, "score": np.maximum.reduceat(near, first)}))
        ours = pd.concat(found)
        ours = ours.loc[ours["vec_id"] != ours["query_id"], ["query_id", "vec_id", "score"]]
        ours = ours.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).drop_duplicates(["query_id", "vec_id"])
        return ours.groupby("query_id").head(self.k)


def nearest(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, factor: float = FACTOR, shard: int = SHARD, leaf: int = LEAF, sample: int = SAMPLE, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest of `vectors` to each of `queries` by cosine in double precision,
    nearest first, ties to the smaller vec_id; fewer where there are fewer. A query's own vec_id is no candidate.

    Both tables have `vec_id` and `embedding`. Null, empty and zero vectors, those with null or non-finite components
    and those with a null vec_id take no part; vectors of another length than a query's are no candidates for it. Of
    rows that repeat a vec_id, the pair of rows that are nearest counts. Empty tables give an empty table; other columns
    are ignored.

    A bounded sample of vectors (`sample`, those of the smallest hashes) comes to the driver. Points go to the nearest
    of its first `pivots` and from there by hash to shards of about `shard` rows; they are shuffled once, and each
    shard's tree is built once. The sample gives each query a cosine that its neighbours reach, so it is sent only to
    the shards that the triangle inequality cannot rule out. The queries of a shard stream through its task behind its
    points: neither side has to fit a task, and each shard keeps `k` rows for a query, which a window ranks.
    """
    named = lambda df: df.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding")).where(F.col("vec_id").isNotNull() & usable("embedding"))
    points, asked = named(vectors), named(queries)
    # As many pivots as shards are needed: cells of few points would only be many small trees.
    pivots = min(pivots, max(1, -(-points.count() // shard)))
    sizes = {r["dim"]: r["n"] for r in points.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()}
    lengths = list(sizes)
    each = max(1, sample // max(1, len(lengths)))
    # The smallest hashes of each length: a threshold leaves about twice as many as wanted before any row moves, and equal
    # rows are one.
    cuts = points.sparkSession.createDataFrame([(d, min(1.0, 2.0 * each / n) * (1 << 30)) for d, n in sizes.items()], "dim int, cut double")
    hashed = points.withColumns({"dim": F.size("embedding"), "h": F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 30))})
    few_ = hashed.join(F.broadcast(cuts), "dim").where("h < cut").drop("cut").distinct()
    first = F.row_number().over(W.partitionBy("dim").orderBy("h", "vec_id", "embedding"))
    chosen = few_.withColumn("at", first).where(F.col("at") <= each).collect()
    chosen = {d: [r for r in chosen if r["dim"] == d] for d in lengths}
    ids = {d: np.array([r["vec_id"] for r in rows]) for d, rows in chosen.items()}
    near = {d: unit([r["embedding"] for r in rows])[0] for d, rows in chosen.items()}
    del chosen

    def place(batches):
        for batch in batches:
            for dim, rows in batch.groupby(batch["embedding"].map(len)):
                cosines = np.clip(unit(rows["embedding"])[0] @ near[dim][:pivots].T, -1, 1)
                yield rows.assign(dim=dim, cell=cosines.argmax(1), angle=np.arccos(cosines.max(1)))

    kind = dict(points.dtypes)["embedding"]
    placed = stored(points.mapInPandas(place, f"vec_id long, embedding {kind}, dim int, cell int, angle double"), "points")
    cells = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard).cast("int").alias("parts"), F.min("angle").alias("least"), F.max("angle").alias("most")).collect()
    parts = placed.sparkSession.createDataFrame([(r["dim"], r["cell"], r["parts"]) for r in cells], "dim int, cell int, parts int")
    held = {d: sorted((r["cell"], r["least"], r["most"]) for r in cells if r["dim"] == d) for d in lengths}

    def route(batches):
        for batch in batches:
            for dim, rows in batch.groupby(batch["embedding"].map(len)):
                if dim not in held:
                    continue
                units = unit(rows["embedding"])[0]
                cosines = np.clip(units @ near[dim].T, -1, 1)
                angles = np.arccos(cosines[:, [c for c, _, _ in held[dim]]])
                # Each id of the sample counts once, and the query's own never.
                cosines[rows["vec_id"].to_numpy()[:, None] == ids[dim][None, :]] = -2.0
                once = np.unique(ids[dim], return_index=True)[1]
                floor = -np.sort(-cosines[:, once], axis=1)[:, k - 1] - TIE if len(once) >= k else np.full(len(rows), -2.0)
                reach = np.where(floor <= -1.0, np.inf, np.arccos(np.clip(floor, -1, 1)) * factor + SLACK)[:, None]
                least, most = (np.array([x[i] for x in held[dim]]) for i in (1, 2))
                query, cell = np.nonzero((angles - most <= reach) & (least - angles <= reach))
                yield rows.iloc[query].assign(dim=dim, cell=np.array([c for c, _, _ in held[dim]])[cell], floor=floor[query])

    parts = F.broadcast(parts)
    key = F.xxhash64("dim", "cell", "part").alias("shard")
    here = placed.join(parts, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("parts")).cast("int"))
    here = here.select("vec_id", "embedding", F.lit(False).alias("asks"), F.lit(None).cast("double").alias("floor"), key)
    routed = asked.mapInPandas(route, f"vec_id long, embedding {dict(asked.dtypes)['embedding']}, dim int, cell int, floor double")
    there = routed.join(parts, ["dim", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    there = there.select("vec_id", "embedding", F.lit(True).alias("asks"), "floor", key)

    def answer(batches):
        now, waiting, ready = None, [], None
        for batch in batches:
            for name, rows in batch.groupby("shard", sort=False):
                if name != now:
                    now, waiting, ready = name, [], None
                points, asks = rows[~rows["asks"]], rows[rows["asks"]]
                if len(points):
                    waiting.append(points[["vec_id", "embedding"]])
                # A part whose hash no point has can still be asked.
                if len(asks) and (waiting or ready is not None):
                    if ready is None:
                        ready, waiting = Shard(pd.concat(waiting), k, leaf), []
                    yield ready.ask(asks, factor)

    shards = sum(r["parts"] for r in cells)
    both = here.unionByName(there).repartition(max(1, shards, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "shard")
    found = both.sortWithinPartitions("shard", "asks").mapInPandas(answer, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
