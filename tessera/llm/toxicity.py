"""Toxic passages: maximum-scoring segments of token log-odds, aggregated by extreme-value calibration.

Fitting, on at most SAMPLE labelled training documents (one of each group with equal text), counts for every unit how
many toxic and how many clean documents hold it. A unit is a word or the first 4, 5 or 6 bytes of one, told apart by its
bytes (a word beyond LONG bytes by its SHA-256). Its log-odds take a Dirichlet prior in proportion to the unit's own
frequency; units beyond Z standard deviations from 0 (toxic ones also beyond a least value) are kept; the sample bounds
them. A token scores as its most specific kept unit, any other token scores GAP.

A scan linear in the tokens finds all maximal scoring segments of a text (Ruzzo and Tompa). Scores of random segments
follow an extreme-value law: of n tokens, K n exp(-lambda S) segments reach S by chance, lambda being the root of
E[exp(lambda s)] = 1 over clean tokens and K fitted to the segments of clean texts that reach TAIL / lambda. A segment's surplus
is lambda S - ln(K n / chance) where positive: how far it lies beyond a score that fewer than `chance` segments of a text
of its length reach by chance. A document's evidence is the sum of its different passages' surpluses, and its score a
logistic function of that sum's logarithm. Lambda, K and the logistic function are fitted on a quarter of the sample
that no unit was counted in; the least log-odds (of LEASTS) and `chance` (of CHANCES) are those with which that quarter's
labels are likeliest. Documents outside the training folds have no part in any of it.

Defined cases: a null or empty text, or one without words, has no evidence and the lowest score. Labels of a doc_id
that repeats count as toxic if any is; null labels and ids are skipped. With no labels of both kinds every score is
the share of toxic ones (0 without any). Rows that repeat a doc_id are scored each for itself. Other columns of the
documents are ignored by score() and pass through reject() unchanged. Texts are read whole.
"""

from __future__ import annotations

import dataclasses
import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textvec as tv
from tessera.llm.common import discard, mapped, materialize

#: Labelled documents that the model is fitted on, at most: those with the smallest hash of their id.
SAMPLE = 20_000
Z = 2.0
#: Log-odds that a toxic unit has at least, to choose from: function words lean one way or the other by little.
LEASTS = (1.0, 2.0, 3.0)
#: Bytes of a word that is a unit as it is, at most.
LONG = 64
#: One in so many sampled documents is not counted, but calibrates: counted ones would flatter their own words.
CALIBRATE = 4
PRIOR = 0.01
GAP = -1.0
LARGEST = 8.0
#: Nats beyond which clean texts' segments are counted for K, and the least K that is taken.
TAIL = 2.0
LEAST_K = 0.001
#: A passage is significant if a text holds fewer of its score by chance, to choose from.
CHANCES = (1.0, 0.1, 0.01, 0.001)
PREFIXES = (4, 5, 6)

#: kind: 0 for a word, else the length of the prefix.
UNITS = "kind int, unit binary, toxic long, clean long"
SCORED = "doc_id long, score double, evidence double, passages int"


@dataclasses.dataclass
class Model:
    units: dict[int, pa.Array]  # by kind
    odds: dict[int, np.ndarray]
    scale: float = 1.0  # lambda
    k: float = 0.1  # K, unless it is fitted
    chance: float = CHANCES[0]
    slope: float = 0.0
    base: float = -50.0

    def probability(self, evidence):
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(evidence) + self.base, -50, 50)))


NOTHING = Model({}, {})


def _words(data: np.ndarray, starts: np.ndarray):
    """Word spans, each text's first word, the number of each one's word, and the different words."""
    begin, end, first = tv.spans(data, starts, tv.ALNUM)
    return begin, end, first, *tv.distinct_words(data, begin, end)


def _units(words: pa.Array):
    """(kind, units, which words have them), most specific first."""
    size = pc.binary_length(words).to_numpy(zero_copy_only=False)
    whole = words
    if (size > LONG).any():
        whole = pa.array([w if len(w) <= LONG else b"\0" + hashlib.sha256(w).digest() for w in words.to_pylist()], pa.large_binary())
    yield 0, whole, np.ones(len(words), bool)
    for k in reversed(PREFIXES):
        yield k, pc.binary_slice(words, 0, k), size >= k


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def _word_scores(model: Model, words: pa.Array) -> np.ndarray:
    """The score of each different word: that of its most specific known unit."""
    scores = np.full(len(words), GAP)
    open_ = np.ones(len(scores), bool)  # no more specific unit known
    for kind, units, has in _units(words):
        if kind in model.units and len(units):
            slot = pc.fill_null(pc.index_in(units, value_set=model.units[kind]), -1).to_numpy(zero_copy_only=False)
            known = np.flatnonzero((slot >= 0) & has & open_)
            odds = model.odds[kind][slot[known]]
            scores[known] = np.where(odds > 0, odds, GAP)
            open_[known] = False
    return scores


def segments(scores: list[float] | np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, end), from left to right, in time linear in the tokens."""
    scores = np.asarray(scores, float)
    total = np.r_[0.0, np.cumsum(scores)]
    stack: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, end
    below: list[int] = []  # for each stacked segment, the nearest one below it whose left sum is smaller
    for i in np.flatnonzero(scores > 0).tolist():
        left, right, first = total[i], total[i + 1], i
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= left:
                j = below[j]
            if j < 0 or stack[j][1] >= right:
                break
            left, first, under = stack[j][0], stack[j][2], below[j]
            del stack[j:], below[j:]
            j = under
        stack.append((left, right, first, i + 1))
        below.append(j)
    return [(r - lo, a, b) for lo, r, a, b in stack]


def surplus(score: float, tokens: int, scale: float, k: float, chance: float) -> float:
    """How far a segment's score lies beyond a significant one in a text of so many tokens, in nats."""
    return max(0.0, scale * score - math.log(max(1.0, k * tokens / chance)))


def _evidence(model: Model, column: pa.Array, chances: tuple[float, ...] | None = None):
    """Yield for each text: evidence and its significant passages (surplus, byte begin, byte end); evidence is a list where
    several chances are asked for, and passages are those of the last. A passage that is repeated word for word counts
    once: lines that repeat are no further evidence."""
    for _, _, data, starts in tv.slices(_lower(column)):
        begin, end, first, index, words = _words(data, starts)
        scores = _word_scores(model, words)[index]
        positive = np.r_[0, np.cumsum(scores > 0)][first]
        for t in range(len(starts) - 1):
            a, b = first[t], first[t + 1]
            maximal = segments(scores[a:b]) if positive[t + 1] > positive[t] else []
            sums, found = [], []
            for chance in chances or (model.chance,):
                found = [(surplus(s, b - a, model.scale, model.k, chance), int(begin[a + i] - starts[t]), int(end[a + j - 1] - starts[t])) for s, i, j in maximal]
                found = [x for x in found if x[0] > 0]
                sums.append(sum({data[starts[t] + i : starts[t] + j].tobytes(): extra for extra, i, j in found}.values()))
            yield (sums if chances else sums[0]), found


# ---- fitting


def in_fold(doc_id: str = "doc_id"):
    """Whether a document is held out: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _lambda(scores: np.ndarray, counts: np.ndarray) -> float:
    """Root of E[exp(lambda s)] = 1 over the tokens of clean texts; half a token is added to each score."""
    p = (counts + 0.5) / (counts + 0.5).sum()
    if not (scores > 0).any() or (p * scores).sum() >= 0:
        return 1.0
    lo, hi = 0.0, 1.0
    value = lambda x: float((p * np.exp(x * scores)).sum())
    while value(hi) < 1 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if value(mid) < 1 else (lo, mid)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and base of a logistic function with a slight penalty on the slope, by Newton's method."""
    x = x.astype(float)
    beta, unit = np.zeros(2), max(1e-9, float(np.std(x)))
    a = np.c_[x / unit, np.ones(len(x))]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (y - p) - np.array([0.01, 0.001]) * beta
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag([0.01, 0.001])
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta[0] / unit, beta[1]


def _chosen(docs: DataFrame, labels: DataFrame, sample: int) -> list[tuple[int, int]]:
    """(toxic, doc_id) of the documents that the model is fitted on, one of each text: at most `sample`."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id is not null and toxic is not null").where(~in_fold())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # about twice as many as are taken, so that every task's best are few
    share, rank = -(-(2 * sample << 20) // max(1, known.count())), F.xxhash64("doc_id")
    known = known.where(F.pmod(rank, F.lit(1 << 20)) < share).orderBy(rank, "doc_id").limit(sample)
    known = [(r.doc_id, int(r.toxic)) for r in known.collect()]  # bounded by sample
    if not known:
        return []
    chosen = F.broadcast(spark.createDataFrame(known, "__id long, __toxic int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, F.col("doc_id") == F.col("__id"))
    # copies of one text would weigh as many documents
    firsts = texts.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256)).agg(F.min("doc_id").alias("doc_id"), F.max("__toxic").alias("toxic")).collect()
    return sorted((int(r.toxic), r.doc_id) for r in firsts)


def count_units(counting: DataFrame) -> DataFrame:
    """(kind, unit, y1, y0): toxic and clean documents of counting(text, __toxic) that hold each unit."""

    def run(batches):
        for batch in batches:
            marks = np.array(batch.column("__toxic").to_pylist(), np.int64)
            for lo, hi, data, starts in tv.slices(_lower(batch.column("text"))):
                _, _, first, index, words = _words(data, starts)
                owner = np.repeat(np.arange(hi - lo), np.diff(first))
                held = np.unique(owner * max(1, len(words)) + index)  # a text's different words
                owner, word = held // max(1, len(words)), held % max(1, len(words))
                for kind, units, has in _units(words):
                    encoded = units.dictionary_encode()
                    unit, n = encoded.indices.to_numpy().astype(np.int64), len(encoded.dictionary)
                    pairs = np.unique(owner[has[word]] * max(1, n) + unit[word[has[word]]])
                    if len(pairs):
                        is_toxic = marks[lo:hi][pairs // n]
                        every, toxic = np.bincount(pairs % n, minlength=n), np.bincount(pairs % n, is_toxic, minlength=n).astype(np.int64)
                        own = np.flatnonzero(every)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(own), kind, np.int32)), encoded.dictionary.take(pa.array(own)).cast(pa.binary()), pa.array(toxic[own]), pa.array((every - toxic)[own])],
                            ["kind", "unit", "toxic", "clean"],
                        )

    return mapped(counting, run, UNITS).groupBy("kind", "unit").agg(F.sum("toxic").alias("y1"), F.sum("clean").alias("y0"))


def log_odds(counted: DataFrame, toxic: int, clean: int) -> DataFrame:
    """counted with odds and z: document counts with a Dirichlet prior of PRIOR times the unit's own count on either side."""
    a = PRIOR * (F.col("y1") + F.col("y0"))
    odds = F.log((F.col("y1") + a) / (toxic + PRIOR * (toxic + clean))) - F.log((F.col("y0") + a) / (clean + PRIOR * (toxic + clean)))
    return counted.withColumn("odds", odds).withColumn("z", odds / F.sqrt(1 / (F.col("y1") + a) + 1 / (F.col("y0") + a)))


def _clean_only(batch: pa.RecordBatch) -> pa.Array:
    return _lower(batch.filter(pc.equal(batch.column("__toxic"), 0)).column("text"))


def calibrate(model: Model, calibrating: DataFrame) -> list[tuple[float, Model]]:
    """For each of CHANCES the model with lambda, K and the logistic function fitted to calibrating(text, __toxic), and
    the labels' mean log-likelihood under it."""

    def tally(batches):  # clean tokens by score, for lambda; bounded by the number of kept units
        for batch in batches:
            for _, _, data, starts in tv.slices(_clean_only(batch)):
                *_, index, words = _words(data, starts)
                s, n = np.unique(_word_scores(model, words)[index].round(3), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(n)], ["s", "n"])

    seen = mapped(calibrating, tally, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).toPandas()
    possible = np.unique(np.concatenate([[GAP], *(x[x > 0].round(3) for x in model.odds.values())])).tolist()
    every = dict.fromkeys(possible, 0) | dict(zip(seen["s"].tolist(), seen["n"].tolist()))
    model = dataclasses.replace(model, scale=_lambda(np.array(list(every)), np.array(list(every.values()), float)))

    def tails(batches):  # clean tokens, and segments of clean texts beyond TAIL
        tokens = beyond = 0
        for batch in batches:
            for _, _, data, starts in tv.slices(_clean_only(batch)):
                _, _, first, index, words = _words(data, starts)
                scores = _word_scores(model, words)[index]
                tokens += len(scores)
                for a, b in zip(first[:-1], first[1:]):
                    beyond += sum(model.scale * s >= TAIL for s, _, _ in segments(scores[a:b]))
        yield pa.RecordBatch.from_arrays([pa.array([tokens]), pa.array([beyond])], ["tokens", "beyond"])

    tokens, beyond = mapped(calibrating, tails, "tokens long, beyond long").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "beyond"))).first()
    model = dataclasses.replace(model, k=max(LEAST_K, (beyond + 0.5) / (max(1, tokens) * math.exp(-TAIL))))

    def weigh(batches):
        for batch in batches:
            found = [x for x, _ in _evidence(model, batch.column("text"), CHANCES)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column("__toxic")], ["x", "y"])

    weighed = mapped(calibrating, weigh, "x array<double>, y int").toPandas()  # bounded by the sample
    x, y, out = np.array(weighed["x"].tolist(), float).reshape(len(weighed), len(CHANCES)), weighed["y"].to_numpy(float), []
    for i, chance in enumerate(CHANCES):
        slope, base = _logistic(np.log1p(x[:, i]), y)
        made = dataclasses.replace(model, chance=chance, slope=slope, base=base)
        p = np.clip(made.probability(x[:, i]), 1e-12, 1 - 1e-12)
        out.append((float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))), made))
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the labelled documents outside the held-out fold; see the module."""
    spark = docs.sparkSession
    kept = _chosen(docs, labels, sample)
    if not kept:
        return NOTHING
    parts = [[x for i, x in enumerate(kept) if (i % CALIBRATE == 1) == aside] for aside in (False, True)]
    toxic, clean = (sum(t == k for t, _ in parts[0]) for k in (1, 0))
    if not toxic or not clean or len({t for t, _ in parts[1]}) < 2:
        share = sum(t for t, _ in kept) / len(kept)
        return dataclasses.replace(NOTHING, base=math.log((share + 1e-9) / (1 - share + 1e-9)))

    def labelled(rows):
        chosen = F.broadcast(spark.createDataFrame(rows, "__toxic int, __id long"))
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, F.col("doc_id") == F.col("__id")).select("text", "__toxic")

    counting, calibrating = labelled(parts[0]), materialize(labelled(parts[1]), "calibrating")
    counted = log_odds(count_units(counting), toxic, clean).where((F.abs("z") >= Z) & ~F.col("odds").between(0, min(LEASTS)))
    rows = counted.select("kind", "unit", "odds").toPandas().sort_values(["kind", "unit"])
    made = []
    for least in LEASTS:
        own = rows[(rows["odds"] <= 0) | (rows["odds"] > least)]
        by_kind = {int(k): x for k, x in own.groupby("kind")}
        units = {k: pa.array([bytes(u) for u in x["unit"]], pa.large_binary()) for k, x in by_kind.items()}
        made += calibrate(Model(units, {k: np.clip(x["odds"].to_numpy(float), -LARGEST, LARGEST) for k, x in by_kind.items()}), calibrating)
    discard(calibrating)
    return max(made, key=lambda x: x[0])[1]  # the first of equals: the smallest least value, the largest chance


# ---- use


def score(docs: DataFrame, model: Model) -> DataFrame:
    """See SCORED; passages counts the significant ones."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = list(_evidence(held.value, batch.column("text")))
            evidence = np.array([x for x, _ in found], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(held.value.probability(evidence)), pa.array(evidence), pa.array([len(p) for _, p in found], pa.int32())],
                ["doc_id", "score", "evidence", "passages"],
            )

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCORED)


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """One row per significant passage: doc_id, surplus, passage (its lower-cased text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            lowered = _lower(batch.column("text"))
            out = []
            for doc_id, text, (_, found) in zip(batch.column("doc_id").to_pylist(), lowered, _evidence(held.value, batch.column("text"))):
                raw = text.as_py().encode() if found else b""
                out += [(doc_id, s, raw[a:b].decode()) for s, a, b in found]
            if out:
                ids, extra, parts = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(extra), pa.array(parts)], ["doc_id", "surplus", "passage"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, surplus double, passage string")


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence, passages."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", in_fold().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "passages")


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic, all columns as they are. Texts go to Python beside their row, nothing shuffles."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        for batch in batches:
            evidence = np.array([x for x, _ in _evidence(held.value, batch.column("text"))], float)
            yield batch.filter(pa.array(held.value.probability(evidence) < 0.5))

    return mapped(docs, run, docs.schema)
