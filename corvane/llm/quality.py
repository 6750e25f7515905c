"""Quality classifier: a document classifier's evidence under hierarchical empirical Bayes posteriors of hosts and paths."""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import BROADCAST_ROWS, stored, text_udf

#: Labelled rows that the document classifier is fitted on at most, the ridge of its weights, and the score of kept documents.
SAMPLE, RIDGE, KEEP = 20_000, 1.0, 0.5
#: Bounds of a prior's strength in documents, and of a classifier's log-odds.
WEAKEST, STRONGEST, MOST_LOGIT = 1.0, 1e6, 12.0
SYMBOL = re.compile(rb"[^\w\s.,;:'\"()?\x80-\xff-]")
UPPER, LETTER = re.compile(rb"[A-Z]"), re.compile(rb"[A-Za-z\x80-\xff]")
N_FEATURES = 12


def features(text: str | None) -> list[float]:
    """How a text is written: its size and, over all of it and in its worst line, symbols, capitals, repeats and bars.

    A line's share counts from six words on, so a heading cannot decide. A null text is an empty one.
    """
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * N_FEATURES

    def shares(part: bytes, own: list[bytes]) -> tuple[float, float, float, float]:
        letters = len(LETTER.findall(part))
        again = sum(map(bytes.__eq__, own, own[1:]))
        return len(SYMBOL.findall(part)) / len(part), len(UPPER.findall(part)) / max(letters, 1), again / len(own), own.count(b"|") / len(own)

    lines = raw.split(b"\n")
    each = [shares(x, own) for x in lines if len(own := x.split()) >= 6]
    worst = np.max(each, axis=0) if each else np.zeros(4)
    distinct = len(set(words)) / len(words)
    repeated = 1 - len(set(lines)) / len(lines)
    size = math.log1p(len(words))
    return [size, *map(float, shares(raw, words)), *map(float, worst), (1 - distinct) * size, repeated, len(raw) / len(words)]


class Classifier(NamedTuple):
    """Log-odds of good quality: bias + sum of weights times features, from which the share of good documents that it
    was fitted on (`base`, as log-odds) can be taken off again."""

    weights: list[float]
    bias: float
    base: float


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 30) -> Classifier:
    """Logistic regression by Newton's method. Without rows of both classes: no evidence either way."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = math.log(share / (1 - share))
    if len(set(y.tolist())) < 2:
        return Classifier([0.0] * x.shape[1], base, base)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    beta, keep = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [0.0])
    beta[-1] = base
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep + 1e-9 * np.eye(len(beta)), z.T @ (y - p) - keep @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    weights = beta[:-1] / scale
    return Classifier(weights.tolist(), float(beta[-1] - weights @ mean), base)


def described(docs: DataFrame, doc_id: str, text: str, host: str, path: str) -> DataFrame:
    """(doc_id, host, path, features): a row for each row of `docs`, without its text. Map-only."""
    of = text_udf(lambda texts: [features(x) for x in texts], "array<double>", pa.list_(pa.float64()))
    # A null host or path is a host or path of its own.
    named = [F.to_json(F.struct(F.col(c).alias("v"))).alias(n) for c, n in ((host, "host"), (path, "path"))]
    return docs.select(F.col(doc_id).alias("doc_id"), *named, of(F.col(text)).alias("features"))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(of: DataFrame, mean: Column) -> float:
    """How many documents a prior is worth, by the method of moments: rates of groups (n, s) around `mean` vary by more
    than chance by what the prior allows. Few or like groups make it strong."""
    rate, p = F.col("s") / F.col("n"), mean
    found = of.where("n > 1").agg(F.sum(F.col("n") * (rate - p) ** 2).alias("spread"), F.sum(p * (1 - p)).alias("chance"), F.sum(F.col("n") * p * (1 - p)).alias("whole")).first()
    if not found["whole"]:
        return STRONGEST
    # E[n (rate - p)^2] = p (1 - p) (n + m) / (m + 1) for a Beta prior of strength m.
    over = (found["spread"] - found["chance"]) / (found["whole"] - found["chance"])
    return STRONGEST if over <= 1 / STRONGEST else float(np.clip(1 / over - 1, WEAKEST, STRONGEST))


def posteriors(scored: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`scored` (host, path, y, evidence and other columns) with host_posterior, path_posterior and score.

    y: a document's good quality, 0 to 1: its label, or the classifier's probability. A host's rate is shrunk to that
    of all documents and a path's rate to its host's posterior, each by a prior whose strength the data give. A
    document's own y is left out of its posteriors, so it is not counted twice. Hosts and paths are partial sums, also
    those that hold a third of all rows; their tables are broadcast while a count says that they are small.
    """
    paths = stored(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("y").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n"), F.sum("s")).first()
    rate = float(np.clip(((total[1] or 0) + 0.5) / ((total[0] or 0) + 1), 1e-6, 1 - 1e-6))
    host_m = _strength(hosts, F.lit(rate))
    host_posterior = (F.col("host_s") + host_m * rate) / (F.col("host_n") + host_m)
    sites = paths.join(hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s")), "host")
    path_m = _strength(sites, host_posterior)
    sites = sites.withColumnsRenamed({"n": "path_n", "s": "path_s"})
    few = paths.count() <= broadcast_rows
    out = scored.join(F.broadcast(sites) if few else sites, ["host", "path"])
    own = F.col("y")
    host_left = (F.col("host_s") - own + host_m * rate) / (F.col("host_n") - 1 + host_m)
    path_left = (F.col("path_s") - own + path_m * F.col("host_posterior")) / (F.col("path_n") - 1 + path_m)
    bounded = lambda p: F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    out = out.withColumn("host_posterior", bounded(host_left)).withColumn("path_posterior", bounded(path_left))
    out = out.withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("path_posterior"))))))
    return out.drop("host_n", "host_s", "path_n", "path_s")


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", quality: str = "quality", sample: int = SAMPLE, keep: float = KEEP, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, host, path, evidence, host_posterior, path_posterior, score, kept): a row for each row of `docs`.

    The document classifier is fitted on the labelled documents of the smallest hashes, about `sample` of them at most;
    all else covers all documents. evidence is its log-odds without the share of good documents that it was fitted on;
    score joins it with the posteriors; kept means a score of `keep` or more. `labels` (doc_id, quality 0 or 1) may
    cover none of the documents: evidence is zero then. Labels that are null, or both for one document, don't count. A
    null text is an empty one; null hosts and paths are hosts and paths of their own; a null doc_id has no label;
    repeated rows are scored alike; an empty table gives an empty table; other columns are ignored. Texts are read
    once, map-only, and only their features go on.
    """
    seen = described(docs, doc_id, text, host, path)
    known = labels.where(F.col(quality).isin(0, 1)).groupBy(F.col(doc_id).alias("doc_id")).agg(F.min(quality).alias("label"), F.max(quality).alias("most"))
    seen = stored(seen.join(known.where("label = most").select("doc_id", F.col("label").cast("double").alias("label")), "doc_id", "left"), "features")
    # Rows that repeat an id with other texts are examples of their own; equal ones are one.
    labelled = stored(seen.where("label is not null and doc_id is not null").select("doc_id", "features", "label").distinct(), "labelled")
    share = min(1.0, sample / max(1, labelled.count()))
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", "features"), F.lit(1 << 30)) < int(share * (1 << 30))).select("features", "label").toPandas()
    model = fit(np.array(chosen["features"].tolist(), float).reshape(-1, N_FEATURES), chosen["label"].to_numpy(float))
    logit = F.lit(model.bias)
    for i, w in enumerate(model.weights):
        logit = logit + F.lit(w) * F.col("features")[i]
    logit = F.least(F.greatest(logit, F.lit(-MOST_LOGIT)), F.lit(MOST_LOGIT))
    scored = seen.withColumn("evidence", logit - model.base)
    scored = scored.withColumn("y", F.coalesce("label", 1 / (1 + F.exp(-logit)))).drop("features", "label")
    out = posteriors(scored, broadcast_rows)
    name = lambda c: F.get_json_object(c, "$.v").alias(c)
    return out.select("doc_id", name("host"), name("path"), "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= keep).alias("kept"))
