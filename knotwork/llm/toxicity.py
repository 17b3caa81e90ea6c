"""Toxicity by a weighted finite-state pattern grammar.

Words map to classes by a lexicon: insults and insulting word beginnings learned from labelled
documents, and given threats, targets, negations and verbs of reported speech. Five transducers,
for insults, threats, targets, negations and reported speech, are composed and read the classes
of one clause. A target counts before and after what is aimed at it, by nondeterministic arcs
that guess whether one is still to come; negation and reported speech count for what follows
them. Arcs charge a negative cost for an insult or threat, less of it in the scope of a negation
or of reported speech, more beside a target. The tropical shortest path through a clause is its
score, so a word is scored by the clause that it stands in.

Only clauses with an insult or threat can score; an Aho-Corasick automaton of the lexicon finds
them in the whole text. What scopes are worth is learned too: how often a labelled document is
toxic whose strongest clause is negated, reported, aimed or plain, drawn towards the given
offsets by a fixed weight. The score is a logistic function of the strongest clause and of the
number of matched clauses.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .wfst import Wfst

#: Closed word classes in English, German, French and Spanish.
TARGETS = "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta vous votre tú ti tus usted ustedes vosotros".split()
NEGATIONS = "not no never neither nor don't doesn't isn't aren't wasn't nicht kein keine nie niemals pas jamais aucun aucune nunca jamás ningún ninguna".split()
REPORTS = "said says say claimed claims quoted quote reported called sagte sagt behauptete zitierte dit disait déclaré cité dijo dice afirmó citó".split()
THREATS = "kill murder destroy hurt töten umbringen tuer détruire matar destruir".split()
#: Worth of a threat word that is aimed at nobody, before its target, and after it (or in another
#: scope); and what scopes add before learning.
THREAT = {"plain": 0.5, "ahead": 1.5, "aimed": 2.0}
OFFSETS = {"plain": 0.0, "aimed": 0.5, "negated": -2.0, "reported": -1.5}
CLAUSE = re.compile(r"[.!?;\n]")
WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


def grammar(offsets: dict[str, float]) -> Wfst:
    """Insult, threat, target, negation and reported-speech transducers, composed in this order.

    Reads word classes; an insult's class is ("insult", weight in tenths). The first two make
    hits ("hit", weight, scope), the next two set their scope, the last one charges them.
    """
    words = [None, "target", "negation", "report"]
    levels = [*range(0, 121), "threat"]
    scopes = ("plain", "aimed", "ahead", "negated")

    def passing(g: Wfst, state, labels, to=None) -> None:
        for label in labels:
            g.arc(state, label, label, 0.0, state if to is None else to)

    insult = Wfst("read").end("read")
    passing(insult, "read", [*words, "threat"])
    for w in range(0, 121):
        insult.arc("read", ("insult", w), ("hit", w, "plain"), 0.0, "read")

    plain = [("hit", w, "plain") for w in levels]
    threat = Wfst("read").end("read")
    passing(threat, "read", [*words, *plain[:-1]])
    threat.arc("read", "threat", plain[-1], 0.0, "read")

    # a clause starts with a guess: no target at all, or one ahead, which then has to come
    target = Wfst("start").end("start").end("none").end("seen")
    passing(target, "none", [None, "negation", "report", *plain])
    for state in ("start", "ahead"):
        passing(target, state, ["target"], "seen")
        passing(target, state, [None, "negation", "report"], "ahead")
        for _, w, _ in plain:
            target.arc(state, ("hit", w, "plain"), ("hit", w, "ahead"), 0.0, "ahead")
    passing(target, "start", [None, "negation", "report", *plain], "none")
    passing(target, "seen", words)
    for _, w, _ in plain:
        target.arc("seen", ("hit", w, "plain"), ("hit", w, "aimed"), 0.0, "seen")

    # of negation and report, the later one counts
    aimed = [("hit", w, scope) for w in levels for scope in scopes[:3]]
    negation = Wfst("off").end("off").end("on")
    passing(negation, "off", [None, "target", "report", *aimed])
    passing(negation, "off", ["negation"], "on")
    passing(negation, "on", [None, "target", "negation"])
    passing(negation, "on", ["report"], "off")
    for _, w, scope in aimed:
        negation.arc("on", ("hit", w, scope), ("hit", w, "negated"), 0.0, "on")

    report = Wfst("off").end("off").end("on")
    for state in ("off", "on"):
        passing(report, state, [None, "target"])
        passing(report, state, ["report"], "on")
        passing(report, state, ["negation"], "off")
        for w in levels:
            for scope in scopes:
                found = "reported" if state == "on" else scope
                weight = THREAT.get(found, THREAT["aimed"]) if w == "threat" else w / 10
                found = "aimed" if found == "ahead" else found
                report.arc(state, ("hit", w, scope), found, -max(0.0, weight + offsets[found]), state)
    return insult.compose(threat).compose(target).compose(negation).compose(report)


class Scorer:
    """Lexicon, grammar and calibration; made from a plain dictionary so that it travels well."""

    def __init__(self, model: dict):
        import ahocorasick

        self.model = model
        self.words = {w: x for w, x in model["words"].items()}
        self.stems = {w: x for w, x in model["stems"].items()}
        self.longest = max(map(len, self.stems), default=0)
        self.classes = {w: kind for kind, given in (("report", REPORTS), ("negation", NEGATIONS), ("target", TARGETS), ("threat", THREATS)) for w in given}
        self.grammar = grammar(model["offsets"])
        self.finder = ahocorasick.Automaton()
        for w in {*self.words, *self.stems, *THREATS}:
            self.finder.add_word(w, w)
        self.finder.make_automaton()

    def class_of(self, word: str):
        if (w := self.words.get(word)) is None:
            w = max((self.stems[word[:n]] for n in range(1, min(len(word), self.longest) + 1) if word[:n] in self.stems), default=None)
        return ("insult", min(120, max(0, round(10 * w)))) if w is not None else self.classes.get(word)

    def clauses(self, text: str) -> list[tuple[float, str]]:
        """(score, scope of its last insult) of each clause with an insult or threat."""
        found, first, after = [], 0, 0
        marks, mark = CLAUSE.finditer(text), None
        for end, word in self.finder.iter(text) if len(self.finder) else ():
            start = end - len(word) + 1
            if start < after or start and text[start - 1].isalpha():
                continue
            # one sweep over the clause marks: those behind are never looked at again
            while after <= end:
                first, mark = after + (mark is not None), next(marks, None)
                after = mark.start() if mark else len(text)
            kinds = [self.class_of(w) for w in WORDS.findall(text, first, after)]
            if not any(k == "threat" or isinstance(k, tuple) for k in kinds):
                continue
            cost, scopes = self.grammar.shortest(kinds)
            if cost < 0:
                hit = [s for k, s in zip(kinds, scopes, strict=True) if k == "threat" or isinstance(k, tuple)]
                found.append((-cost, hit[-1]))
        return found

    def features(self, text: str | None) -> tuple[float, float, str]:
        found = self.clauses((text or "").lower())
        best = max(found, default=(0.0, ""))
        return best[0], math.log1p(len(found)), best[1]

    def score(self, text: str | None) -> float:
        best, many, scope = self.features(text)
        a, b, c, none = self.model["calibration"]
        x = a * best + b * many + c if scope else none
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = 12_000, min_docs: int = 3, min_share: float = 0.7, clear: float = 0.9, cover: int = 3000) -> dict:
    """Model from the documents that ``labels`` (id, label 0 or 1) name.

    At most ``most`` ids of each label are used, those with the least hashes, so the texts that
    the model is fitted on are bounded. Candidates are words, and word beginnings of four to
    seven letters, that at least ``min_docs`` toxic documents hold, of whose documents a share
    of ``min_share`` is toxic, and whose log likelihood ratio against the general share exceeds
    chance over all candidates. Of these, insults are those with a share of ``clear`` or more, and
    further ones chosen one by one, each the one that explains most toxic documents without an
    insult so far (among ``cover`` of them), until the next explains fewer than ``min_docs``. Null labels and ids are left out; an id that repeats
    counts as toxic if any of its labels is. Without toxic rows the lexicon is empty and every
    score low.
    """
    small_batches(docs.sparkSession)
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.bool_or(F.col(label_col) == 1).alias("toxic"))
    known = known.withColumn("h", F.xxhash64("id", F.lit(3)))
    # a hash bound that keeps about twice what is wanted, so that no task orders more than that
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.create_map(*[x for t in (True, False) for x in (F.lit(t), F.lit(min(1.0, 2.0 * most / max(1, total.get(t, 1)))))])
    near = known.filter(F.pmod("h", F.lit(1 << 30)) <= share[F.col("toxic")] * (1 << 30))
    ids = [near.filter(F.col("toxic") == t).orderBy("h", "id").limit(most).select("id", "toxic") for t in (True, False)]
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chosen = texts.join(F.broadcast(ids[0].union(ids[1])), "id").select(F.xxhash64("text").alias("doc"), "text", "toxic").persist()
    try:
        n = {r[0]: r[1] for r in chosen.groupBy("toxic").count().collect()}
        words = chosen.select("doc", "toxic", F.explode(F.array_distinct(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)"))).alias("w"))
        ends = words.select("doc", "toxic", "w", F.explode(F.array(*map(F.lit, (99, 4, 5, 6, 7)))).alias("n")).filter("n = 99 or length(w) > n")
        terms = ends.select("doc", "toxic", F.expr("substring(w, 1, n)").alias("w"), (F.col("n") < 99).alias("stem"))
        # words of one document that begin alike count once, and so do copies of it
        counted = terms.distinct().groupBy("w", "stem").agg(F.count_if(F.col("toxic")).alias("bad"), F.count_if(~F.col("toxic")).alias("good")).filter(F.col("bad") >= min_docs).persist()
        base = n.get(True, 0) / max(1, sum(n.values()))
        share = F.col("bad") / (F.col("bad") + F.col("good"))
        log_of = lambda x: F.log(F.greatest(x, F.lit(1e-12)))
        evidence = F.col("bad") * log_of(share / max(base, 1e-9)) + F.col("good") * log_of((1 - share) / max(1 - base, 1e-9))
        strong = counted.filter((share >= min_share) & (evidence > math.log(max(1, counted.count())) + 3))
        best = {(r["w"], r["stem"]): (r["bad"], r["good"]) for r in strong.select("w", "stem", "bad", "good").collect()}
        some = chosen.filter("toxic").select("doc").distinct().orderBy("doc").limit(cover)
        met = terms.join(F.broadcast(some), "doc").join(strong.select("w", "stem"), ["w", "stem"]).distinct()
        holds = {(r["w"], r["stem"]): set(r["docs"]) for r in met.groupBy("w", "stem").agg(F.collect_set("doc").alias("docs")).collect()}
        counted.unpersist()
        model = {"words": {}, "stems": {}, "offsets": OFFSETS, "calibration": [1.0, 0.5, -2.0, -4.0]}
        insults = {t for t, (bad, good) in best.items() if bad >= clear * (bad + good)}
        explained = set().union(*(holds.get(t, set()) for t in insults))
        holds = {t: left for t, docs in holds.items() if (left := docs - explained)}
        while holds:
            # whole words before beginnings, longer before shorter
            top = max(holds, key=lambda t: (len(holds[t]), not t[1], len(t[0]), t[0]))
            if len(holds[top]) < min_docs:
                break
            insults.add(top)
            gone = holds.pop(top)
            holds = {t: left for t, docs in holds.items() if (left := docs - gone)}
        for word, stem in insults:
            bad, good = best[word, stem]
            model["stems" if stem else "words"][word] = round(min(8.0, max(0.5, math.log((bad + 0.1) / (good + 0.1)) + 1)), 2)
        text = json.dumps(model)
        seen = chosen.mapInArrow(_features(text), "best double, many double, scope string, toxic boolean")
        for r in seen.filter("scope != ''").groupBy("scope").agg(F.count_if(F.col("toxic")).alias("bad"), F.count("*").alias("n")).collect():
            prior = 1 / (1 + math.exp(-2 - OFFSETS[r["scope"]]))
            p = (r["bad"] + 5 * prior) / (r["n"] + 5)
            model["offsets"] = model["offsets"] | {r["scope"]: round(max(-4.0, min(2.0, math.log(p / (1 - p)) - 2)), 2)}
        seen = chosen.mapInArrow(_features(json.dumps(model)), "best double, many double, scope string, toxic boolean")
        model["calibration"] = calibrate(np.array([tuple(r) for r in seen.select("best", "many", F.expr("double(scope != '')"), F.col("toxic").cast("double")).collect()]).reshape(-1, 4))
        return model
    finally:
        chosen.unpersist()


def calibrate(x: np.ndarray) -> list[float]:
    """Logistic regression on (best, many) of matched rows, and the log odds of the others."""
    hit = x[x[:, 2] > 0]
    rest = x[x[:, 2] == 0]
    none = math.log((rest[:, 3].sum() + 0.5) / (len(rest) - rest[:, 3].sum() + 50)) if len(rest) else -4.0
    if not len(hit):
        return [1.0, 0.5, -2.0, min(none, -1.0)]
    w = logistic(np.column_stack([hit[:, 0], hit[:, 1], np.ones(len(hit))]), hit[:, 3], np.array([0.05, 0.05, 0.01]))
    return [*map(float, w), float(min(none, -1.0))]


def logistic(a: np.ndarray, y: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """Weights of least penalised logistic loss, by Newton steps that are halved until they help."""

    def loss(w):
        z = a @ w
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * (ridge * w * w).sum()

    w = np.zeros(a.shape[1])
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (p - y) + ridge * w
        step, t = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), slope), 1.0
        while t > 1e-6 and loss(w - t * step) > now - 1e-4 * t * (slope @ step):
            t /= 2
        new = loss(w - t * step)
        if new >= now:
            break
        w = w - t * step
        if now - new < 1e-9 * max(1.0, now):
            break
        now = new
    return w


_SCORERS: dict[str, Scorer] = {}


def scorer(model: str) -> Scorer:
    """The scorer of a model in JSON; one is kept in each worker."""
    if model not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model] = Scorer(json.loads(model))
    return _SCORERS[model]


def _features(model: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        s = scorer(model)
        for b in batches:
            found = [s.features(x) for x in b.column("text").to_pylist()]
            columns = [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.float64(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*columns, b.column("toxic")], names=["best", "many", "scope", "toxic"])

    return run


def _scores(model: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        s = scorer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([s.score(x) for x in b.column("text").to_pylist()], pa.float64())], names=["id", "score"])

    return run


def toxicity(docs: DataFrame, model: dict, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, score, predicted).

    The whole text is scored; a null or empty text gets the score of a text without a match.
    Ties don't arise, repeated rows are scored each, an empty table gives no rows, other columns
    are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(_scores(json.dumps(model)), f"id {docs.schema[id_col].dataType.simpleString()}, score double")
    return scored.select("id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: dict, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``.

    A null or empty text scores as one without a match, repeated rows stay or go together, an
    empty table gives no rows; columns of any name are passed on.
    """
    small_batches(docs.sparkSession)
    text = json.dumps(model)

    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        s = scorer(text)
        for b in batches:
            yield b.filter(pa.array([s.score(x) < threshold for x in b.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
