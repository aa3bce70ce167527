"""Toxicity classifier with counterfactual regularisation.

A sparse logistic model over the presence of hashed words and word prefixes. It is fitted on at most
``max_rows`` labelled rows (those of smallest seeded id hash, a documented bound); scoring covers
every text whole. In each labelled text that names an identity group, the term is swapped for the
next of its list, and the squared change of the logit is penalised, so that merely naming a group
moves no score.

Features are selected by a chi-square test on the sample and fitted by accelerated proximal gradient
steps. Null or empty texts get the model's base score, unlabelled or null-labelled rows are not used
for fitting, labels of ids without a document fall out, repeated rows count as often as they occur.
Without both classes among the labels the base rate alone is the score.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlake.llm.scratch import free_memory, free_name, tidy
from recordlake.llm.wordcode import ALNUM_WORDS, Words, mix, powers, slices, split_words, _BYTE_CODES

BITS = 20
PREFIXES = (5, 6, 7, 9)
MAX_ROWS = 12_000
#: Training rows whose features are counted at once.
BLOCK_ROWS = 500
#: Identity terms by list, in English, French, German and Spanish; each term stands in one list only. A counterfactual swaps a term for the next one of its list.
IDENTITY_TERMS = (
    ("man", "woman"), ("men", "women"), ("male", "female"), ("boy", "girl"), ("he", "she"), ("his", "her"),
    ("straight", "gay", "lesbian", "bisexual"), ("cisgender", "transgender"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("white", "black", "asian", "latino"), ("american", "mexican", "chinese", "african", "european", "arab"),
    ("young", "old"), ("blind", "deaf", "disabled"),
    ("homme", "femme"), ("hommes", "femmes"), ("garçon", "fille"), ("il", "elle"), ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"),
    ("blanc", "noir"), ("américain", "mexicain", "chinois", "africain", "européen", "arabe"), ("jeune", "vieux"), ("aveugle", "sourd", "handicapé"),
    ("mann", "frau"), ("männer", "frauen"), ("junge", "mädchen"), ("schwul", "lesbisch", "bisexuell"), ("christen", "muslime", "juden"),
    ("weiße", "schwarze"), ("amerikaner", "mexikaner", "chinesen", "afrikaner", "europäer", "araber"), ("jung", "alt"), ("gehörlos", "behindert"),
    ("hombre", "mujer"), ("hombres", "mujeres"), ("niño", "niña"), ("él", "ella"), ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo"),
    ("blanco", "negro"), ("americano", "mexicano", "chino", "africano", "europeo", "árabe"), ("joven", "viejo"), ("ciego", "sordo", "discapacitado"),
)


def feature_hashes(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text row, bucket) of every word and word prefix, and the words' full hashes."""
    n = len(words.data)
    up, down = powers(0, n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODES[words.data] * up[:n], out=sums[1:])
    length = words.end - words.start
    scale, base = down[words.start], sums[words.start]
    full = mix((sums[words.end] - base) * scale + length.astype(np.uint64))
    owner = words.owner()
    rows, buckets = [owner], [full >> np.uint64(64 - BITS)]
    for k in PREFIXES:
        long = np.flatnonzero(length > k)
        rows.append(owner[long])
        buckets.append(mix((sums[words.start[long] + k] - base[long]) * scale[long], k) >> np.uint64(64 - BITS))
    return np.concatenate(rows), np.concatenate(buckets).astype(np.int64), full


def _term_features(term: str) -> tuple[int, list[int]]:
    words = split_words(pa.array([term], pa.large_string()), ALNUM_WORDS, lower=True)
    _, buckets, full = feature_hashes(words)
    return int(full[0]), sorted(set(buckets.tolist()))


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = [t for group in IDENTITY_TERMS for t in group]
    known = np.array([_term_features(t)[0] for t in terms], dtype=np.uint64)
    order = np.argsort(known)
    for batch in batches:
        toxic = np.asarray(batch.column(0))
        for at, part in slices(batch.column(1)):
            words = split_words(part, ALNUM_WORDS, lower=True)
            rows, buckets, full = feature_hashes(words)
            keys = np.unique(rows << BITS | buckets)
            cut = np.searchsorted(keys, np.arange(len(part) + 1) << BITS)
            spot = np.minimum(np.searchsorted(known[order], full), len(known) - 1)
            hit = known[order][spot] == full
            named = np.unique(words.owner()[hit] << 16 | order[spot[hit]])
            named_cut = np.searchsorted(named, np.arange(len(part) + 1) << 16)
            yield pa.RecordBatch.from_arrays([
                pa.array(toxic[at : at + len(part)].astype(np.int32)),
                pa.array([(keys[a:b] & (2**BITS - 1)).astype("<i4").tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()),
                pa.array([(named[a:b] & 0xFFFF).astype("<i4").tobytes() for a, b in zip(named_cut, named_cut[1:], strict=False)], pa.binary()),
            ], ["toxic", "features", "terms"])


@dataclass
class ToxicityModel:
    bias: float
    weights: np.ndarray

    def logits(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        for at, part in slices(column):
            rows, buckets, _ = feature_hashes(split_words(part, ALNUM_WORDS, lower=True))
            keep = np.flatnonzero(self.weights[buckets])
            keys = np.unique(rows[keep] << BITS | buckets[keep])
            out[at : at + len(part)] += np.bincount(keys >> BITS, weights=self.weights[keys & (2**BITS - 1)], minlength=len(part))
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _blocks(features: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of all features, ``BLOCK_ROWS`` rows at a time: the driver never holds them all as wide integers."""
    for at in range(0, len(features), BLOCK_ROWS):
        part = features[at : at + BLOCK_ROWS]
        yield np.repeat(np.arange(at, at + len(part)), [len(f) for f in part]), np.concatenate(part)


def fit_rows(features: list[np.ndarray], toxic: np.ndarray, terms: list[np.ndarray], l1: float = 2e-4, counterfactual: float = 1.0, least_chi2: float = 8.0, steps: int = 400) -> ToxicityModel:
    """Fit on bucket arrays, 0/1 labels and indexes of the identity terms named."""
    n, dims = len(toxic), 1 << BITS
    rate = (toxic.sum() + 0.5) / (n + 1) if n else 0.5
    weights = np.zeros(dims, np.float32)
    if n == 0 or toxic.min() == toxic.max():
        return ToxicityModel(float(np.log(rate / (1 - rate))), weights)
    seen, bad = np.zeros(dims), np.zeros(dims)
    for rows, flat in _blocks(features):
        seen += np.bincount(flat, minlength=dims)
        bad += np.bincount(flat, weights=toxic[rows].astype(float), minlength=dims)
    expected = seen * rate
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = (bad - expected) ** 2 / (expected * (1 - rate)) * n / (n - seen + 1)
    chosen = np.flatnonzero((seen >= 2) & (chi2 >= least_chi2))
    place = np.full(dims, -1)
    place[chosen] = np.arange(len(chosen))
    row, column = [], []
    for rows, flat in _blocks(features):
        kept = place[flat] >= 0
        row.append(rows[kept])
        column.append(place[flat[kept]])
    row, column = np.concatenate(row), np.concatenate(column)
    # swapped minus original features of each naming text and term
    names = [t for group in IDENTITY_TERMS for t in group]
    step_to, at = {}, 0
    for group in IDENTITY_TERMS:
        step_to |= {at + i: at + (i + 1) % len(group) for i in range(len(group))}
        at += len(group)
    buckets = [_term_features(t)[1] for t in names]
    swap_row, swap_column, swap_sign, swaps = [], [], [], 0
    for named in terms:
        for t in named.tolist():
            for sign, term in ((-1.0, t), (1.0, step_to[t])):
                cols = [c for c in place[buckets[term]].tolist() if c >= 0]
                swap_row += [swaps] * len(cols)
                swap_column += cols
                swap_sign += [sign] * len(cols)
            swaps += 1
    swap_row, swap_column, swap_sign = np.array(swap_row, np.int64), np.array(swap_column, np.int64), np.array(swap_sign)

    def hessian_bound(v: np.ndarray) -> np.ndarray:
        """An upper bound of the Hessian times ``v`` (last entry: bias)."""
        across = np.bincount(row, weights=v[column], minlength=n) + v[-1]
        out = np.append(np.bincount(column, weights=across[row], minlength=len(chosen)), across.sum()) / (4 * n)
        if swaps:
            change = np.bincount(swap_row, weights=swap_sign * v[swap_column], minlength=swaps)
            out[:-1] += 2 * counterfactual / n * np.bincount(swap_column, weights=swap_sign * change[swap_row], minlength=len(chosen))
        return out

    v = np.ones(len(chosen) + 1)
    for _ in range(20):
        v = hessian_bound(v / np.linalg.norm(v))
    step = 1 / (1.1 * np.linalg.norm(v))
    x = np.append(np.zeros(len(chosen)), np.log(rate / (1 - rate)))
    ahead, momentum = x.copy(), 1.0
    for _ in range(steps):
        logit = np.bincount(row, weights=ahead[column], minlength=n) + ahead[-1]
        error = (_sigmoid(logit) - toxic) / n
        gradient = np.append(np.bincount(column, weights=error[row], minlength=len(chosen)), error.sum())
        if swaps:
            change = np.bincount(swap_row, weights=swap_sign * ahead[swap_column], minlength=swaps)
            gradient[:-1] += 2 * counterfactual / n * np.bincount(swap_column, weights=swap_sign * change[swap_row], minlength=len(chosen))
        new = ahead - step * gradient
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * l1, 0)
        if ((ahead - new) * (new - x)).sum() > 0:  # the momentum points uphill
            momentum = 1.0
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / following * (new - x)
        x, momentum = new, following
    w, b = x[:-1], x[-1]
    weights[chosen] = w
    return ToxicityModel(float(b), weights)


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, seed: int = 5) -> ToxicityModel:
    """Fit on the ``max_rows`` labelled rows of smallest seeded id hash."""
    order = F.xxhash64(F.col(key), F.lit(seed))
    bounded = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias("__toxic")).orderBy(order, key).limit(max_rows)
    rows = (
        documents.select(key, text).join(F.broadcast(bounded), key).select("__toxic", text)
        .mapInArrow(tidy(_training_rows), "toxic int, features binary, terms binary").toArrow()
    )
    read = lambda name: [np.frombuffer(x.as_buffer(), "<i4") for x in rows[name]]
    model = fit_rows(read("features"), rows["toxic"].to_numpy().astype(float), read("terms"))
    del rows
    free_memory()
    return model


def toxic_score(spark: SparkSession, model: ToxicityModel, text: Column) -> Column:
    """The score of a text column; only that column goes to Python."""
    bound = spark.sparkContext.broadcast((model.bias, model.weights))

    @F.arrow_udf("double")
    def scored(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        loaded = ToxicityModel(*bound.value)
        for part in parts:
            yield pa.array(_sigmoid(loaded.logits(part)), pa.float64())
        free_memory()

    return scored(text.cast("string"))


def score(documents: DataFrame, model: ToxicityModel, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the score of every row's whole text; a kept column named score comes out as score_."""
    kept = (F.col(c).alias(free_name(c, ["score"])) for c in keep)
    return documents.select(*kept, toxic_score(documents.sparkSession, model, F.col(text)).alias("score"))


def drop_toxic(documents: DataFrame, model: ToxicityModel, threshold: float, text: str = "text") -> DataFrame:
    """``documents`` whose score is below the threshold; all columns are kept."""
    return documents.filter(toxic_score(documents.sparkSession, model, F.col(text)) < threshold)


def save(model: ToxicityModel, path: str) -> None:
    kept = np.flatnonzero(model.weights)
    with open(path, "w") as out:
        json.dump({"bias": model.bias, "buckets": kept.tolist(), "weights": model.weights[kept].tolist()}, out)
