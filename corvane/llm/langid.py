"""Language ID in two steps: the family first, then one-versus-one linear support vector machines inside it."""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.common import BROADCAST_ROWS, TEXTS, discard, small_batches, stored, text_udf

#: Documents of each language that the model is fitted on at most, and documents of one machine's task at most; hashed
#: n-grams; passes and cost of the machines.
PER_LANGUAGE, PER_MACHINE, DIMS, PASSES, COST = 1500, 4000, 1 << 12, 8, 4.0
UNKNOWN = "und"
#: Score from which a prediction overrules a tag, and score below which a text shows no learned language. Of the 12,752
#: held-out rows of 0.1 GB whose prediction is their tag, 0.9992 reach LEAST; gibberish of 100 words or more stays below.
SURE, LEAST = 0.9, 0.55

# Language families by ISO 639-1 code. A language that none lists is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "celtic": ["br", "cy", "ga", "gd", "gv"],
    "uralic": ["et", "fi", "hu", "se"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"],
    "iranian": ["fa", "ku", "ps", "tg"],
    "turkic": ["az", "kk", "ky", "tk", "tr", "tt", "ug", "uz"],
    "semitic": ["am", "ar", "he", "mt", "ti"],
    "austronesian": ["id", "jv", "mg", "mi", "ms", "su", "tl"],
    "dravidian": ["kn", "ml", "ta", "te"],
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

#: ASCII bytes that are no letters are blanks; A-Z were lower-cased before.
_LETTERS = bytes(b if chr(b).isalpha() or b >= 0x80 else 0x20 for b in range(256))


def family(lang: str) -> str:
    """The family of a language tag by its first part: en-GB is germanic."""
    return _FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], lang)


def profile(text: str, dims: int = DIMS) -> np.ndarray:
    """Square roots of the shares of hashed byte 2-grams and 3-grams of the lower-cased letters: a vector of length one."""
    raw = np.frombuffer(b" " + b" ".join(text.lower().encode().translate(_LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    two = raw[:-1] * np.uint32(0x9E3779B1) + raw[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + raw[2:] * np.uint32(0x27D4EB2F) + np.uint32(1)
    shift = np.uint32(32 - (dims.bit_length() - 1))
    counts = np.bincount(two >> shift, minlength=dims) + np.bincount(three >> shift, minlength=dims)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and (text.isalpha() or any(map(str.isalpha, text)))


def machine(x: np.ndarray, sign: np.ndarray, cost: float = COST, passes: int = PASSES, seed: int = 7) -> np.ndarray:
    """Weights of a linear support vector machine: dual coordinate descent on the squared hinge loss. Both classes weigh
    the same in sum."""
    rng, w, alpha = np.random.default_rng(seed), np.zeros(x.shape[1]), np.zeros(len(x))
    each = np.where(sign > 0, len(sign) / 2 / max((sign > 0).sum(), 1), len(sign) / 2 / max((sign < 0).sum(), 1)) * cost
    slack, norm = 1 / (2 * each), np.array([np.square(row, dtype=np.float32).sum() for row in x])
    for _ in range(passes):
        for i in rng.permutation(len(x)):
            old, row = alpha[i], x[i].astype(np.float32)
            alpha[i] = max(0.0, old - (sign[i] * (w @ row) - 1 + slack[i] * old) / (norm[i] + slack[i]))
            if alpha[i] != old:
                w += (alpha[i] - old) * sign[i] * row
    return w.astype(np.float32)


class Model(NamedTuple):
    """Families with their one-versus-rest machines (a column each), languages of each, and a machine for each pair."""

    families: list[str]
    family_w: np.ndarray
    languages: dict[str, list[str]]
    pairs: dict[tuple[str, str], np.ndarray]


def machines(langs: list[str]) -> tuple[list[str], dict[str, list[str]], list[tuple[str, str, str]]]:
    """Families, the languages of each, and the machines to fit: (name, what counts for it, what counts against it). A
    family's machine is for the family against all others; a pair's for one language against the other."""
    of = {c: family(c) for c in sorted(set(langs))}
    families = sorted(set(of.values()))
    languages = {f: [c for c in of if of[c] == f] for f in families}
    wanted = [("family", f, "") for f in families] if len(families) > 1 else []
    return families, languages, wanted + [("pair", a, b) for f in families for a, b in combinations(languages[f], 2)]


def assembled(langs: list[str], weights: dict[tuple[str, str, str], np.ndarray], dims: int) -> Model:
    """The model of `langs` from the weights of its machines; no languages make a model that knows none."""
    families, languages, _ = machines(langs)
    family_w = np.zeros((dims + 1, len(families)), np.float32)
    for k, f in enumerate(families if len(families) > 1 else []):
        family_w[:, k] = weights["family", f, ""]
    return Model(families, family_w, languages, {(a, b): w for (what, a, b), w in weights.items() if what == "pair"})


def decide(model: Model, x: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The language of each profile and a score of 0 to 1: the family's softmax share times the mean, over the
    language's duels with its kin, of the logistic of its margin. Most duels won wins, then the score, then the tag."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    raw = x @ model.family_w
    share = np.exp(2 * (raw - raw.max(1, keepdims=True)))
    share /= share.sum(1, keepdims=True)
    best = share.argmax(1)
    out, score = np.empty(len(x), object), np.zeros(len(x))
    for k, f in enumerate(model.families):
        rows = np.flatnonzero(best == k)
        tags = model.languages[f]
        won, sure = np.zeros((len(rows), len(tags))), np.zeros((len(rows), len(tags)))
        for (i, a), (j, b) in combinations(enumerate(tags), 2):
            p = 1 / (1 + np.exp(-4 * np.clip(x[rows] @ model.pairs[a, b], -20, 20)))
            won[:, i] += p >= 0.5
            won[:, j] += p < 0.5
            sure[:, i] += p
            sure[:, j] += 1 - p
        sure = sure / (len(tags) - 1) if len(tags) > 1 else sure + 1
        pick = (won + sure / 2).argmax(1)
        out[rows] = np.array(tags, object)[pick]
        score[rows] = share[rows, k] * sure[np.arange(len(rows)), pick]
    return list(out), np.clip(score, 0, 1)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from the fitting: crc32 of its id as text has remainder 2 by 4. A null id is not."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = PER_LANGUAGE, per_machine: int = PER_MACHINE, dims: int = DIMS) -> Model:
    """A model fitted on at most `per_language` different texts of each language that `docs` names, those of the smallest
    hashes, held-out documents never. Rows whose text is null or has no letter, or whose language is null or the tag for
    unknown, teach nothing; copies of a text teach once, also where they repeat an id.

    Each machine is fitted in a task of its own, on at most `per_machine` of the sampled texts, a family's share and all
    others' being halves; only the languages and the machines' weights come to the driver, 16 KB for each machine.
    """
    able = docs.where(~held_out(doc_id) & F.col(lang).isNotNull() & (F.col(lang) != UNKNOWN) & F.col(text).isNotNull())
    able = able.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(text), F.col(lang)).alias("h"))
    counts = {r["lang"]: r["n"] for r in able.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return assembled([], {}, dims)
    # Somewhat more than is wanted, as the counts are estimates; the smallest hashes of those stay.
    limit = [(c, int(min(1.0, 1.25 * per_language / max(1, n)) * (1 << 30))) for c, n in counts.items()]
    limit = docs.sparkSession.createDataFrame(limit, "lang string, below long")
    limit = F.broadcast(limit) if len(counts) <= BROADCAST_ROWS else limit
    sample = able.join(limit, "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("below")).select("lang", "h", "text")

    def profiles(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                part = part.filter(pa.array([has_letter(t) for t in part["text"].to_pylist()], pa.bool_()))
                x = [profile(t, dims).astype("<f2").tobytes() for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["lang"], part["h"], pa.array(x, pa.binary())], ["lang", "h", "x"])

    rows = sample.mapInArrow(profiles, "lang string, h long, x binary").dropDuplicates(["lang", "h"])
    rows = rows.withColumn("at", F.row_number().over(W.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))).where(F.col("at") <= per_language)
    with small_batches(docs.sparkSession):
        rows = stored(rows, "sample")
    taken = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    wanted, total = machines(list(taken))[2], sum(taken.values())
    dealt = []
    for what, a, b in wanted:
        own = sum(n for c, n in taken.items() if (family(c) == a if what == "family" else c == a))
        for c in taken:
            side = (1 if family(c) == a else -1) if what == "family" else 1 if c == a else -1 if c == b else 0
            if side:
                most = per_machine // 2 / max(1, own if side > 0 else total - own)
                dealt.append((what, a, b, c, float(side), int(min(1.0, most) * (1 << 20))))
    dealt = docs.sparkSession.createDataFrame(dealt, "what string, a string, b string, lang string, side double, below long")
    held = rows.join(F.broadcast(dealt) if len(wanted) * len(taken) <= BROADCAST_ROWS else dealt, "lang")
    held = held.where(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < F.col("below")).select("what", "a", "b", "lang", "h", "side", "x")

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["lang", "h"], kind="stable")
        name, side, x = part[["what", "a", "b"]].head(1), part["side"].to_numpy(), np.ones((len(part), dims + 1), np.float16)
        for i, b in enumerate(part.pop("x")):
            x[i, :dims] = np.frombuffer(b, "<f2")
        return name.assign(w=machine(x, side).tobytes())

    found = held.groupBy("what", "a", "b").applyInPandas(learn, "what string, a string, b string, w binary").collect()
    discard(rows)
    return assembled(list(taken), {(r["what"], r["a"], r["b"]): np.frombuffer(r["w"], np.float32) for r in found}, dims)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score. Map-only.

    A null text or one without a letter is `und` with score 0, as is any text where the model knows no language. The
    text alone decides; whole texts count. Every row stays, repeated rows are judged alike, an empty table gives an
    empty table; columns of `docs` under the two names are replaced.
    """
    dims = model.family_w.shape[0] - 1

    def judge(texts: list) -> list:
        out = [(UNKNOWN, 0.0)] * len(texts)
        able = [i for i, t in enumerate(texts) if model.families and has_letter(t)]
        if able:
            for i, found in zip(able, zip(*decide(model, np.stack([profile(texts[i], dims) for i in able])))):
                out[i] = found
        return out

    judge = text_udf(judge, "lang_pred string, score double", pa.struct({"lang_pred": pa.string(), "score": pa.float64()}))
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.select(*names, judge(F.col(text)).alias("__judged"))
    return out.select(*names, "__judged.lang_pred", "__judged.score")
