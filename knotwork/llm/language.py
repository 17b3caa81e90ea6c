"""Language identification by hierarchical discrimination.

Languages are first grouped into families by the likeness of their character profiles. A text
is assigned a family and then a language within it, in both steps by linear support vector
machines, one for each pair of classes; the class that wins most pairs, then by most margin, is
taken. Features are hashed character 1- to 3-grams of the whole text (letters in lower case,
anything else as one blank), square-rooted and scaled to unit length.

The machines are trained by dual coordinate descent on a bounded sample.
"""

from __future__ import annotations

import base64
import json
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, share_broadcast, small_batches

BITS = 12
UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of a text, or None if it has no letter."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[c]
    if not is_letter.any():
        return None
    c = np.where(is_letter, c, 32)
    first = np.ones(len(c), bool)
    first[1:] = is_letter[1:] | is_letter[:-1]
    c = np.concatenate(([32], c[first], [32])).astype(np.uint64)
    count = np.zeros(1 << BITS)
    gram = np.zeros(len(c), np.uint64)
    for n in range(3):
        gram = gram[: len(c) - n] * np.uint64(0x110000) + c[n:]
        slot = (gram + np.uint64(n << 62)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)
        count += np.bincount(slot.astype(np.int64), minlength=1 << BITS)
    count = np.sqrt(count)
    return (count / np.linalg.norm(count)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 30, seed: int = 1) -> np.ndarray:
    """Weights of a linear support vector machine for labels -1 and 1; the last is the bias."""
    x = np.column_stack([x, np.ones(len(x), x.dtype)])
    w, a, order = np.zeros(x.shape[1]), np.zeros(len(x)), np.random.default_rng(seed)
    own = (x.astype(np.float64) ** 2).sum(1)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1
            step = min(max(a[i] - gradient / own[i], 0.0), c) - a[i]
            if step:
                a[i] += step
                w += step * y[i] * x[i]
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return w.astype(np.float32)


def families(names: list[str], x: np.ndarray, y: np.ndarray) -> list[list[str]]:
    """Languages in half as many groups, merging the two groups with the likest mean profiles."""
    groups = [[n] for n in names]
    mean = {n: x[y == i].mean(0) for i, n in enumerate(names)}
    while len(groups) > math.ceil(len(names) / 2):
        centre = [np.mean([mean[n] for n in g], 0) for g in groups]
        _, i, j = max((float(centre[i] @ centre[j]) / float(np.linalg.norm(centre[i]) * np.linalg.norm(centre[j])), i, j) for i, j in combinations(range(len(groups)), 2))
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [sorted(groups[i] + groups[j])]
    return sorted(groups)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 500, most: int = 4000) -> dict:
    """Model from rows with a language; null and empty ones are left out.

    Of each language at most ``per_language`` rows with the least hashes of their ids are used
    and at most ``most`` in all, those that come first within their languages. An id that
    repeats counts with the least of its (language, text).
    """
    small_batches(docs.sparkSession)
    known = docs.filter(F.col(lang_col).isNotNull() & (F.col(lang_col) != "") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.lit(5)).alias("h"))
    # a hash bound that keeps about four times what is wanted, so that no task orders more than that
    total = cut(known.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n")))
    known = known.join(share_broadcast(total, total.count(), 10_000), F.col("lang") == F.col("of")).filter(F.pmod("h", F.lit(1 << 30)) <= F.least(F.lit(1.0), F.lit(4.0 * per_language) / F.col("n")) * (1 << 30))
    ranked = known.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).filter(F.col("r") <= per_language)
    ids = ranked.orderBy("r", "lang").limit(most).select("id").distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and lang != ''").join(F.broadcast(ids), "id")
    texts = texts.groupBy("id").agg(F.min(F.struct("lang", "text")).alias("x")).select("id", "x.lang", "x.text")

    def vectors(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = [(i, f.tobytes()) for i, x in enumerate(b.column("text").to_pylist()) if (f := features(x)) is not None]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lang")], names=["id", "lang"]).take(pa.array([r[0] for r in rows], pa.int64())).append_column("v", pa.array([r[1] for r in rows], pa.binary()))

    rows = sorted(texts.mapInArrow(vectors, f"id {docs.schema[id_col].dataType.simpleString()}, lang string, v binary").collect(), key=lambda r: (r["lang"], r["id"]))
    names = sorted({r["lang"] for r in rows})
    model: dict = {"families": [], "pairs": {}}
    if not names:
        return model
    x = np.frombuffer(b"".join(r["v"] for r in rows), np.float32).reshape(len(rows), -1)
    y = np.array([names.index(r["lang"]) for r in rows])
    groups = families(names, x, y)
    of = np.array([next(k for k, g in enumerate(groups) if n in g) for n in names])[y]

    def pair(mask, sign) -> str:
        return base64.b64encode(svm(x[mask], np.where(sign[mask], 1.0, -1.0)).tobytes()).decode()

    model["families"] = groups
    for i, j in combinations(range(len(groups)), 2):
        model["pairs"][f"{i} {j}"] = pair((of == i) | (of == j), of == i)
    for g in groups:
        for a, b in combinations(g, 2):
            p, q = names.index(a), names.index(b)
            model["pairs"][f"{a} {b}"] = pair((y == p) | (y == q), y == p)
    return model


class Predictor:
    def __init__(self, model: dict):
        self.families = model["families"]
        self.names = list(model["pairs"])
        self.w = np.array([np.frombuffer(base64.b64decode(v), np.float32) for v in model["pairs"].values()], np.float32).reshape(len(self.names), (1 << BITS) + 1)
        self.at = {n: i for i, n in enumerate(self.names)}

    def best(self, classes: list, margins: np.ndarray):
        """The class that wins most pairs and its least margin there."""
        wins, least, total = dict.fromkeys(classes, 0), dict.fromkeys(classes, math.inf), dict.fromkeys(classes, 0.0)
        for a, b in combinations(classes, 2):
            m = float(margins[self.at[f"{a} {b}"]])
            wins[a if m > 0 else b] += 1
            for c, v in ((a, m), (b, -m)):
                least[c], total[c] = min(least[c], v), total[c] + v
        top = max(classes, key=lambda c: (wins[c], total[c]))
        return top, least[top]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or (f := features(text)) is None:
            return UNKNOWN, 0.0
        margins = self.w[:, :-1] @ f + self.w[:, -1] if len(self.names) else np.empty(0)
        family, first = self.best(list(range(len(self.families))), margins)
        name, second = self.best(self.families[family], margins)
        return name, float(np.prod([1 / (1 + math.exp(-max(-30.0, min(30.0, 3 * m)))) for m in (first, second)]))


_PREDICTORS: dict[str, Predictor] = {}


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, lang_pred, score).

    ``lang_pred`` is a language of the model, or ``und`` with score 0 if the text is null or has
    no letter (or the model has no language). The whole text is read. Repeated rows are judged
    each, an empty table gives no rows, other columns are not read.
    """
    small_batches(docs.sparkSession)
    plain = json.dumps(model)
    sent = docs.sparkSession.sparkContext.broadcast(plain)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if sent.value not in _PREDICTORS:
            _PREDICTORS.clear()
            _PREDICTORS[sent.value] = Predictor(json.loads(sent.value))
        p = _PREDICTORS[sent.value]
        for b in batches:
            found = [p.predict(x) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")
