"""Embedding near-dedup by binary codes of randomly rotated vectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import components, discard, few, stored

#: Cosine of linked vectors, rows of a block, blocks of a label that are compared without tables, seed.
THRESHOLD, BLOCK, PLAIN, SEED = 0.98, 2048, 32, 42
#: The chance at which a pair at the threshold may meet in none of a large label's tables.
MISS = 1e-12
#: Pairs that are recomputed at once, and rows of a task that compares small cells.
AT_ONCE, TASK_ROWS = 1 << 16, 8192


def usable(embedding: str) -> Column:
    """Whether a vector has a direction: not null, not empty, no null or non-finite component, not zero."""
    x = F.col(embedding)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(x.isNotNull() & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix: equal for all tasks."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(vectors) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as doubles of length one, and their lengths. Scaled first, so that no square overflows or vanishes."""
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    scale = np.abs(x).max(1, keepdims=True)
    norm = np.linalg.norm(x / scale, axis=1, keepdims=True)
    return x / scale / norm, (norm * scale)[:, 0]


def encode(units: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sign bits of rotated unit vectors, packed, and the correction factor of each: its inner product with its
    code, which is the vector of entries +-1/sqrt(dim)."""
    turned = units @ turn
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / math.sqrt(units.shape[1])


def close_pairs(codes: np.ndarray, factors: np.ndarray, units: np.ndarray, other: np.ndarray, turn: np.ndarray, threshold: float = THRESHOLD):
    """Yield (i, j, cosine) arrays of the pairs of `units` and `other` at `threshold` or more.

    The inner product of a code with the other vector, divided by the code's factor f, is an unbiased estimate of the
    cosine. Its error is sqrt(1 - f^2) / f times the inner product of the other vector with a unit vector
    perpendicular to this one, which is sqrt(1 - cosine^2) at most. So the estimate of a pair at the threshold or above
    is never below threshold - sqrt(1 - f^2) / f * sqrt(1 - threshold^2): pairs that reach this bound are recomputed
    in double precision, the others need not be.
    """
    dim = units.shape[1]
    signs = (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(dim))
    turned = (other @ turn).astype(np.float32)
    bound = (threshold - np.sqrt(np.maximum(0, 1 - factors**2)) / factors * math.sqrt(1 - threshold**2)) * factors - 1e-5
    for at in range(0, len(signs), 512):
        i, j = np.nonzero(signs[at : at + 512] @ turned.T >= bound[at : at + 512, None].astype(np.float32))
        for k in range(0, len(i), AT_ONCE):
            a, b = i[k : k + AT_ONCE] + at, j[k : k + AT_ONCE]
            cosine = np.einsum("ij,ij->i", units[a], other[b])
            near = cosine >= threshold
            yield a[near], b[near], cosine[near]


def tables(bits: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """Tables of `bits` signs that a pair at the threshold needs to share one of them but for a chance of `miss`."""
    if not bits:
        return 1
    alike = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log1p(-alike))


def cells(units: np.ndarray, bits: int, n_tables: int, seed: int = SEED) -> np.ndarray:
    """The cell of each vector in each table: on which side of `bits` random planes it lies."""
    if not bits:
        return np.zeros((len(units), n_tables), np.int64)
    planes = np.random.default_rng([seed, units.shape[1], bits]).standard_normal((units.shape[1], n_tables * bits))
    sides = (units @ planes > 0).reshape(len(units), n_tables, bits)
    return sides @ (1 << np.arange(bits, dtype=np.int64))


def _forest(n: int, linked: np.ndarray) -> list[tuple[int, int]]:
    """Fewer than `n` links that connect what the symmetric matrix `linked` connects."""
    rest, out = np.arange(n), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            here = queue.pop()
            near = linked[here, rest]
            out += [(here, x) for x in rest[near]]
            queue += list(rest[near])
            rest = rest[~near]
    return out


def _compare(rows: pd.DataFrame, threshold: float, miss: float, seed: int) -> list[np.ndarray]:
    """Rows (a, b, n, met) of a cell, or of a pair of its blocks. b null: n is the weight of the vectors linked with a.
    met 0: a link, enough of them to connect the vectors; met 1: every link of a vector that has an id twice over.

    A pair that shares several tables counts in the first of them only.
    """
    units, _ = unit(rows["embedding"])
    dim, n, bits, table = units.shape[1], len(rows), int(rows["bits"].iat[0]), int(rows["table"].iat[0])
    same, part = rows["bi"].iat[0] == rows["bj"].iat[0], rows["part"].to_numpy()
    left = np.arange(n) if same else np.flatnonzero(part == rows["bi"].iat[0])
    right = np.arange(n) if same else np.flatnonzero(part == rows["bj"].iat[0])
    if not len(left) or not len(right):
        return []
    codes, factors = np.array([np.frombuffer(c, np.uint8) for c in rows["code"].iloc[left]]).reshape(len(left), -1), rows["factor"].to_numpy()[left]
    linked = np.zeros((n, n), bool)
    for i, j, _ in close_pairs(codes, factors, units[left], units[right], rotation(dim, seed), threshold):
        linked[left[i], right[j]] = True
    linked |= linked.T
    np.fill_diagonal(linked, False)
    has = np.flatnonzero(linked.any(1))
    if table and len(has):
        before = np.full((n, table), -1, np.int64)
        before[has] = cells(units[has], bits, tables(bits, threshold, miss), seed)[:, :table]
        for i in has:
            j = np.flatnonzero(linked[i])
            linked[i, j[(before[j] == before[i]).any(1)]] = False
        has = np.flatnonzero(linked.any(1))
    if not len(has):
        return []
    ids, weight, mixed = rows["class"].to_numpy(), rows["weight"].to_numpy(), rows["mixed"].to_numpy()
    found = np.array(_forest(n, linked))
    a, b = np.nonzero(linked & (mixed[:, None] | mixed[None, :])) if mixed.any() else (np.zeros(0, int),) * 2
    none = np.full(len(has), -1)
    return [
        np.column_stack([ids[has], none, linked[has] @ weight, none]),
        np.column_stack([ids[found[:, 0]], ids[found[:, 1]], np.zeros((len(found), 2), np.int64)]),
        np.column_stack([ids[a], ids[b], np.zeros(len(a), np.int64), np.ones(len(a), np.int64)]),
    ]


def near_duplicate_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, block: int = BLOCK, plain: int = PLAIN, miss: float = MISS, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for each vec_id of `vectors`.

    Vectors link at a cosine of `threshold` or more, in double precision, if their labels are equal and not null and
    their lengths are equal. Null, empty and zero vectors and those that hold null or non-finite components link with
    nothing and stand for themselves. Rows that repeat a vec_id all count: the id has the links of each of them, its own
    excepted, and n_links is the number of other ids. Rows with a null vec_id cannot be named by a link: they have one
    row, (null, 0, null, false). An empty table gives an empty table; other columns are ignored.

    Equal vectors of a label are one class that is compared once. The classes of a label go to blocks of about `block`
    rows, and each pair of blocks is compared in a task: codes and factors first, doubles where the bound leaves a pair
    open. A label of over `plain` blocks goes through tables of random planes before, as many as leave a pair at the
    threshold a chance of `miss` to share no cell of them, and only the pairs of a cell are compared; so work grows
    little faster than the label. A task yields the number of links of each vector and a spanning forest, so what is
    shuffled grows with the vectors. Only where ids repeat in several classes are the links of those classes listed.
    """
    every = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).cast("string").alias("label"))
    able = every.where(F.col("vec_id").isNotNull() & usable("embedding") & F.col("label").isNotNull())
    able = able.withColumn("label", F.concat_ws("/", F.size("embedding"), "label"))
    classes = able.groupBy("label", "embedding").agg(F.min("vec_id").alias("least")).withColumn("class", F.monotonically_increasing_id())
    classes = stored(classes, "classes")
    members = stored(able.join(classes, ["label", "embedding"]).select("vec_id", "class").distinct(), "members")
    several = stored(members.groupBy("vec_id").count().where("count > 1").select("vec_id"), "several")
    repeats = not several.isEmpty()
    twice = stored(members.join(few(several), "vec_id", "left_semi"), "twice")
    weights = members.join(few(several), "vec_id", "left_anti") if repeats else members
    weights = weights.groupBy("class").agg(F.count("*").alias("weight"))

    sizes = classes.groupBy("label").agg(F.count("*").alias("of"))
    bits = F.when(F.col("of") <= plain * block, 0).otherwise(F.ceil(F.log2(F.col("of") / block)) + 3).cast("int")
    rows = classes.join(few(stored(sizes.select("label", bits.alias("bits")), "sizes")), "label").join(weights, "class", "left").withColumn("weight", F.coalesce("weight", F.lit(0)).cast("long"))
    if repeats:
        rows = rows.join(twice.select("class").distinct().withColumn("mixed", F.lit(True)), "class", "left")
    rows = rows.withColumn("mixed", F.coalesce("mixed", F.lit(False)) if repeats else F.lit(False))

    def code(batches):
        for batch in batches:
            for (dim, b), part in batch.groupby([batch["embedding"].map(len), "bits"]):
                units, _ = unit(part["embedding"])
                codes, factors = encode(units, rotation(dim, seed))
                yield part.assign(code=[c.tobytes() for c in codes], factor=factors, cells=list(cells(units, b, tables(b, threshold, miss), seed)))

    kind, shape = dict(classes.dtypes)["embedding"], "label string, class long, weight long, mixed boolean, bits int"
    coded = stored(rows.select("label", "class", "weight", "mixed", "bits", "embedding").mapInPandas(code, f"{shape}, embedding {kind}, code binary, factor double, cells array<long>"), "codes")
    light = coded.select("class", "label", F.posexplode("cells").alias("table", "cell"))
    held = stored(light.groupBy("label", "table", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"), F.count("*").alias("n")).where("n > 1"), "cells")
    tasks = max(1, -(-held.agg(F.coalesce(F.sum(F.col("n") * F.col("parts")), F.lit(0))).first()[0] // TASK_ROWS))
    placed = light.join(few(held.select("label", "table", "cell", "parts")), ["label", "table", "cell"])
    placed = placed.withColumn("part", F.pmod(F.xxhash64("class", F.lit("part")), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("class", "label", "table", "cell", "part", F.least("part", "other").alias("bi"), F.greatest("part", "other").alias("bj"))
    placed = placed.withColumn("task", F.pmod(F.xxhash64("label", "table", "cell", "bi", "bj"), F.lit(tasks)))
    dealt = placed.join(coded.select("class", "weight", "mixed", "bits", "embedding", "code", "factor"), "class")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("class")
        out = [np.zeros((0, 4), np.int64)]
        for _, same in part.groupby(["label", "table", "cell", "bi", "bj"]):
            out += _compare(same.reset_index(drop=True), threshold, miss, seed)
        return pd.DataFrame(np.concatenate(out).astype(np.int64), columns=["a", "b", "n", "met"])

    found = stored(dealt.groupBy("task").applyInPandas(compare, "a long, b long, n long, met long"), "links")
    discard(coded)
    counts = found.where("b < 0").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    links = found.where("met = 0").select("a", "b")
    if repeats:
        links = links.unionByName(twice.join(twice.groupBy("vec_id").agg(F.min("class").alias("a")), "vec_id").select("a", F.col("class").alias("b")))
    roots = stored(components(links).withColumnRenamed("node", "class"), "roots")
    near = few(roots).join(classes.select("class", "least"), "class")
    near = near.join(near.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("class", "component_id")
    alone = weights.join(few(stored(counts, "counts")), "class", "left").select("class", (F.col("weight") + F.coalesce("n", F.lit(0)) - 1).alias("n_links"))
    if repeats:
        alone = _with_repeats(alone, found, twice, weights)
    linked = members.select("vec_id", "class").join(alone, "class", "left").join(near, "class", "left").join(classes.select("class", "least"), "class")
    linked = linked.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min(F.coalesce("component_id", "least")).alias("component_id"))
    if repeats:
        linked = linked.join(_of_repeats(found, twice, weights), "vec_id", "left").select("vec_id", F.coalesce("several", "n_links").alias("n_links"), "component_id")
    out = every.select("vec_id").distinct().join(linked, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _listed(found: DataFrame, twice: DataFrame) -> DataFrame:
    """(a, b): the listed links of classes, both ways, and of each class of `twice` with itself."""
    own = twice.select(F.col("class").alias("a"), F.col("class").alias("b"))
    return found.where("met = 1").select("a", "b").unionByName(own).distinct()


def _with_repeats(alone: DataFrame, found: DataFrame, twice: DataFrame, weights: DataFrame) -> DataFrame:
    """`alone` (class, n_links of its other ids) with the ids that repeat in linked classes added, each once."""
    met = _listed(found, twice).join(twice.select(F.col("class").alias("b"), "vec_id"), "b").groupBy(F.col("a").alias("class")).agg(F.count_distinct("vec_id").alias("more"))
    return alone.join(met, "class", "left").select("class", (F.col("n_links") + F.coalesce("more", F.lit(0))).alias("n_links"))


def _of_repeats(found: DataFrame, twice: DataFrame, weights: DataFrame) -> DataFrame:
    """(vec_id, several): how many other ids an id that repeats in several classes is linked with."""
    reach = twice.join(_listed(found, twice).withColumnRenamed("a", "class"), "class").select("vec_id", "b").distinct()
    plain = reach.join(weights.withColumnRenamed("class", "b"), "b", "left").groupBy("vec_id").agg(F.sum(F.coalesce("weight", F.lit(0))).alias("plain"))
    also = reach.join(twice.select(F.col("class").alias("b"), F.col("vec_id").alias("other")), "b").groupBy("vec_id").agg(F.count_distinct("other").alias("also"))
    return plain.join(also, "vec_id").select("vec_id", (F.col("plain") + F.col("also") - 1).alias("several"))
