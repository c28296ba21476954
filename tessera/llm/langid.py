"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character n-grams (1 to 3 characters of the lower-cased text, runs of anything but letters taken
as one space). A text's vector holds tf * idf, scaled to a sum of 1; document frequencies for idf are counted over all
training documents. Weights are learned by follow-the-regularised-leader with elastic-net penalties (L1 keeps them
sparse), on at most SAMPLE whole documents, and a temperature is fitted to a held-back part of the sample.

Because the vector is linear in the occurrences, a text's scores are sums over its n-grams: one table look-up each.

Defined cases: a null text or one without a letter is `und` with score 0. Documents with a null lang are not learned
from. With no training document at all every text is `und` with score 0; with one language every text with a letter
has that language. Rows that repeat a doc_id are predicted each for itself; other columns are ignored. Ties go to the
language that sorts first. Texts are read whole.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import KEPT, mapped

#: Training documents that weights are learned from, at most: those with the smallest hash of their id, after as many of
#: each language as QUOTA and half the sample allow (one at least).
SAMPLE = 4000
QUOTA = 500
#: One in so many of them fits the temperature instead.
HOLD_BACK = 8
#: n-grams share 2**BITS features.
BITS = 16
ORDERS = (1, 2, 3)
EPOCHS = 3
ALPHA, BETA, L1, L2 = 4.0, 1.0, 0.001, 0.0005
#: The vectors' sum: a text is as strong an example whatever its length.
SCALE = 20.0
#: Characters, and texts, handled at once.
SLICE_CHARS = 1 << 18
SLICE_TEXTS = 128
UND = "und"
_LETTER = regex.compile(r"\p{L}")

PREDICTED = "doc_id long, lang_pred string, score double"


@dataclasses.dataclass
class Model:
    langs: list[str]
    idf: np.ndarray  # of each feature
    weights: np.ndarray  # feature x language
    base: np.ndarray
    temperature: float = 1.0

    def __post_init__(self):
        # for each language weight * idf by feature, then idf alone
        self.table = [np.ascontiguousarray(x, np.float32) for x in (*(self.weights * self.idf[:, None]).T, self.idf)]


def _letters() -> np.ndarray:
    """Each code point, or a space for what is no letter."""
    global _CODES
    if _CODES is None:
        table = np.full(0x110000, 32, np.uint32)
        for lo in range(0, 0x110000, 0x800):  # a block at a time, without the surrogates
            if not 0xD800 <= lo < 0xE000:
                for run in regex.finditer(r"\p{L}+", "".join(map(chr, range(lo, lo + 0x800)))):
                    table[lo + run.start() : lo + run.end()] = np.arange(lo + run.start(), lo + run.end())
        _CODES = table
    return _CODES


_CODES: np.ndarray | None = None


def _forget() -> None:
    global _CODES
    _CODES = None


KEPT["langid"] = _forget


def grams(texts: list[str]):
    """Features of a batch of texts: yield for each order the features and the text of each. Every text begins and
    ends with a space; runs of spaces are one."""
    joined = " ".join(["", *texts, ""]).lower()
    lengths = np.fromiter((len(t.lower()) for t in texts), np.int64, len(texts))
    chars = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    # the space before each text belongs to it, and so does the one behind it, which the next shares
    owner = np.repeat(np.arange(len(texts) + 1), np.r_[lengths + 1, 1])
    keep = np.r_[True, (chars[1:] != 32) | (chars[:-1] != 32)]
    first = np.r_[0, np.cumsum(lengths + 1)]
    keep[first] = True  # a text's own spaces stay
    chars, owner = chars[keep], owner[keep]
    mask = np.uint32((1 << BITS) - 1)
    with np.errstate(over="ignore"):
        for order in ORDERS:
            n = max(0, len(chars) - order + 1)
            h = np.full(n, order * 0x85EBCA6B & 0xFFFFFFFF, np.uint32)
            for i in range(order):
                h = (h ^ chars[i : i + n]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            own = owner[:n]
            # an n-gram may end with the space behind its text
            inside = owner[np.minimum(np.arange(n) + order - 2, len(owner) - 1)] == own if order > 1 else np.ones(n, bool)
            inside &= own < len(texts)
            yield (h & mask)[inside].astype(np.int64), own[inside]


def _batches(column: pa.Array):
    """Slices of a text column as lists; null counts as empty."""
    texts = [t or "" for t in column.to_pylist()]
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and hi < lo + SLICE_TEXTS and (hi == lo or size + len(texts[hi]) <= SLICE_CHARS):
            size += len(texts[hi])
            hi += 1
        yield texts[lo:hi]
        lo = hi


def in_fold():
    """Whether a document is held out: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


# ---- fitting


def _frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all training documents each feature occurs, and how many there are."""

    def run(batches):
        total = np.zeros(1 << BITS, np.int64)
        docs = 0
        for batch in batches:
            for texts in _batches(batch.column("text")):
                docs += len(texts)
                seen = np.zeros((len(texts), 1 << BITS), bool)
                for feature, own in grams(texts):
                    seen[own, feature] = True
                total += seen.sum(0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[docs, total[at]])], ["feature", "n"])

    rows = mapped(train.select("text"), run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    found = np.zeros(1 << BITS, np.int64)
    feature, n = rows["feature"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    found[feature[feature >= 0]] = n[feature >= 0]
    return found, int(n[feature < 0].sum())


def _vectors(train: DataFrame, sample: int):
    """[(features, counts, lang)] of the sampled documents, by hash of their id; bounded by sample, or by the number of
    languages if that is larger. Every language with a letter in its documents is among them."""
    lettered = train.where(F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull())
    found = max(1, lettered.select("lang").distinct().count())
    quota = max(1, min(QUOTA, sample // (2 * found)))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    every = lettered.select("doc_id", "lang").distinct()
    first = every.withColumn("__n", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("__n") <= quota)
    rest = every.orderBy(*order, "lang").limit(sample)
    both = first.select("doc_id", "lang", F.lit(0).alias("__n")).unionByName(rest.select("doc_id", "lang", F.lit(1).alias("__n")))
    ids = both.groupBy("doc_id", "lang").agg(F.min("__n").alias("__n")).orderBy("__n", *order, "lang").limit(max(sample, found))
    chosen = F.broadcast(ids.select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang")))

    def run(batches):
        for batch in batches:
            langs, doc_ids = batch.column("lang").to_pylist(), batch.column("doc_id").to_pylist()
            at = 0
            for texts in _batches(batch.column("text")):
                every = [np.concatenate(x) for x in zip(*grams(texts))]
                key, n = np.unique((every[1] << BITS) | every[0], return_counts=True)
                cut = np.searchsorted(key >> BITS, np.arange(len(texts) + 1))
                feature = (key & ((1 << BITS) - 1)).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids[at : at + len(texts)], pa.int64()),
                        pa.array(langs[at : at + len(texts)]),
                        pa.array([feature[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                        pa.array([n[a:b].astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                        pa.array([bool(_LETTER.search(t)) for t in texts]),
                    ],
                    ["doc_id", "lang", "features", "counts", "letter"],
                )
                at += len(texts)

    rows = train.join(chosen, (F.col("doc_id") == F.col("__id")) & (F.col("lang") == F.col("__lang"))).select("doc_id", "lang", "text")
    rows = mapped(rows, run, "doc_id long, lang string, features binary, counts binary, letter boolean").where("letter").drop("letter")
    table = rows.toPandas().sort_values(["doc_id", "lang"])
    return [(np.frombuffer(f, "<u4").astype(np.int64), np.frombuffer(c, "<u4").astype(float), x) for f, c, x in zip(table["features"], table["counts"], table["lang"])]


def _ftrl(examples, langs: list[str], features: int):
    """Weights and bases by follow-the-regularised-leader, an update for each example, EPOCHS times over."""
    z = np.zeros((features + 1, len(langs)))
    n = np.zeros_like(z)

    def weights(at):
        big = np.abs(z[at]) > L1
        return np.where(big, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    rng = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            at, value, y = examples[i]
            at, value = np.r_[at, features], np.r_[value, 1.0]
            w = weights(at)
            logits = value @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            g = value[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(features + 1))
    return w[:-1], w[-1]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the documents outside the held-out fold whose lang is known; see the module."""
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("lang is not null").where(~in_fold())
    df, n_docs = _frequencies(train)
    raw = _vectors(train, sample)
    langs = sorted({x for _, _, x in raw})
    features = 1 << BITS
    idf = np.where(df > 0, np.log((1 + n_docs) / (1 + df)) + 1, 0.0)
    examples = []
    for at, count, lang in raw:
        value = count * idf[at]
        examples.append((at, SCALE * value / max(value.sum(), 1e-12), langs.index(lang)))
    if len(langs) < 2:
        return Model(langs, idf, np.zeros((features, len(langs))), np.zeros(len(langs)))
    # the first example of a language is always learned from
    firsts = {y: i for i, (_, _, y) in reversed(list(enumerate(examples)))}
    back = [i % HOLD_BACK == 0 and firsts[y] != i for i, (_, _, y) in enumerate(examples)]
    held = [x for x, b in zip(examples, back) if b]
    weights, base = _ftrl([x for x, b in zip(examples, back) if not b], langs, features)
    model = Model(langs, idf, weights, base)
    if not held:
        return model
    logits = np.array([x @ weights[at] + base for at, x, _ in held])
    truth = np.array([y for _, _, y in held])

    def loss(t):
        scaled = logits / t
        top = scaled.max(1)
        return float(np.mean(np.log(np.exp(scaled - top[:, None]).sum(1)) + top - scaled[np.arange(len(truth)), truth]))

    model.temperature = min((float(t) for t in np.geomspace(0.2, 10, 60)), key=loss)
    return model


# ---- use


def probabilities(model: Model, texts: list[str]) -> np.ndarray:
    """Calibrated probability of each language (columns) for each text."""
    k = len(model.langs)
    sums = np.zeros((len(texts), k + 1))
    for feature, own in grams(texts):
        if not len(own):
            continue
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        for i, column in enumerate(model.table):
            sums[own[first], i] += np.add.reduceat(column[feature], first, dtype=np.float64)
    logits = (SCALE * sums[:, :k] / np.maximum(sums[:, k:], 1e-12) + model.base) / model.temperature
    p = np.exp(logits - logits.max(1, keepdims=True, initial=0.0))
    return p / p.sum(1, keepdims=True) if k else p


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """See PREDICTED."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            at, doc_ids = 0, batch.column("doc_id")
            for texts in _batches(batch.column("text")):
                p = probabilities(held.value, texts)
                known = [bool(held.value.langs) and bool(_LETTER.search(t)) for t in texts]
                best = p.argmax(1) if held.value.langs else np.zeros(len(texts), int)
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids[at : at + len(texts)],
                        pa.array([held.value.langs[b] if ok else UND for b, ok in zip(best, known)]),
                        pa.array([float(p[i, b]) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, known))]),
                    ],
                    ["doc_id", "lang_pred", "score"],
                )
                at += len(texts)

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PREDICTED)


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    return predict(docs, fit(docs)).select("doc_id", in_fold().alias("held_out"), "lang_pred", "score")
