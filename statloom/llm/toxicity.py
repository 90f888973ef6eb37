"""Toxicity by weak supervision: lexicon and pattern voters, a label model for their accuracies, a linear classifier.

Labels only serve to find the lexicons and to say which of the label model's two classes is the toxic one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.langid import _follow, smallest

SAMPLE = 6000  # labelled texts of each class that the lexicons and weights are learned from
FEATURES = 4000  # words and word beginnings that the classifier knows
LIFT, CERTAIN = 3.5, 3.5  # log ratio of a feature's rates in the two classes, and its number of standard deviations
BEGINNINGS = (4, 5, 6)
STEPS = (-6.0, -5.0, -4.2)  # lexicon voters of each kind hold features of a lift of 6 and more, of 5 and more, ...
GROUPS = len(STEPS) + 1
# fixed list: common English insults
INSULTS = frozenset("idiot stupid moron loser pathetic worthless disgusting trash scum clown dumb fool jerk garbage ugly".split())
_WORD = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return ["=" + word, *(f"{n}{word[:n]}" for n in BEGINNINGS if len(word) > n)]


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def patterns(text: str | None) -> list[bool]:
    """Votes that look at how a text is written or use a fixed list."""
    text = text or ""
    low = text.lower()
    return [any(w in INSULTS for w in _WORD.findall(low)),
            sum(c.isupper() for c in text) > 0.4 * max(1, sum(c.isalpha() for c in text)),
            text.count("!") > 0.01 * len(text) > 0,
            re.search(r"\b(?:you|they|he|she)\s+(?:are|is)\s+(?:a|an|so|such)\b", low) is not None]


@dataclass
class LabelModel:
    """Two hidden classes; each voter says yes with a rate that depends on the class, correlated voters count less."""
    prior: float
    yes: np.ndarray  # classes x voters
    share: np.ndarray  # weight of each voter's evidence

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        evidence = votes @ (self.share * np.log(self.yes[1] / self.yes[0])) \
            + (1 - votes) @ (self.share * np.log((1 - self.yes[1]) / (1 - self.yes[0])))
        return 1 / (1 + np.exp(-np.clip(evidence + np.log(self.prior / (1 - self.prior)), -40, 40)))


def fit_label_model(votes: np.ndarray, start: np.ndarray, prior: float, rounds: int = 50) -> LabelModel:
    """Expectation-maximisation for the voters' rates, and after each step their correlation inside the classes.

    ``start`` gives a first guess of each row's class, ``prior`` the known share of the toxic class.  Correlated voters repeat one another: a voter's evidence is
    divided by one plus the correlations it has with the others when the class is known.
    """
    p = np.clip(start.astype(float), 0.05, 0.95)
    model = None
    for _ in range(rounds):
        weight = np.stack([1 - p, p])
        yes = (weight @ votes + 0.5) / (weight.sum(1, keepdims=True) + 1.0)
        overlap = np.zeros((votes.shape[1],) * 2)
        for k in (0, 1):
            centred = votes - yes[k]
            cov = (centred * weight[k][:, None]).T @ centred
            spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            overlap += np.maximum(cov / np.outer(spread, spread), 0) * (weight[k].sum() / len(p))
        np.fill_diagonal(overlap, 0)
        share = 1 / (1 + np.where(overlap > 0.05, overlap, 0).sum(1))
        model = LabelModel(float(np.clip(prior, 0.01, 0.99)), yes, share)
        new = model.posterior(votes)
        if np.abs(new - p).max() < 1e-4:
            break
        p = new
    return model


@dataclass
class ToxicityModel:
    weights: dict  # feature -> weight
    bias: float

    def score(self, texts) -> np.ndarray:
        known: dict[str, float] = {}
        out = np.empty(len(texts))
        get = self.weights.get
        for i, text in enumerate(texts):
            total = self.bias
            for w in words(text):
                value = known.get(w)
                if value is None:
                    if len(known) > 500_000:
                        known.clear()
                    value = known[w] = sum(get(f, 0.0) for f in features(w))
                total += value
            out[i] = total
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def _count(batches):
    tally: dict[str, list] = {}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for f in {f for w in words(text) for f in features(w)}:
                tally.setdefault(f, [0, 0])[toxic] += 1
    if tally:
        clean, bad = zip(*tally.values())
        yield pa.RecordBatch.from_arrays([pa.array(list(tally)), pa.array(clean, pa.int64()), pa.array(bad, pa.int64())], ["f", "clean", "bad"])


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> tuple[DataFrame, dict]:
    """(id, text, toxic) of at most ``sample`` different labelled texts of each class, those whose hashes of (id, text) are smallest,
    and all labels' counts."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)")
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("draw", F.xxhash64("id", "text"))
    drawn = texts.select("id", "draw").join(known, "id")
    picked = smallest(drawn, "toxic", F.col("draw"), sample)
    limit = F.when(F.col("toxic") == 1, picked.get("1")).otherwise(picked.get("0"))
    chosen = drawn.filter(F.col("draw") <= limit).distinct()
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema)  # 2 * sample rows of three numbers at most
    # equal texts are one example: the words of a much-copied text say nothing about its class
    return texts.join(F.broadcast(chosen), ["id", "draw"]).drop("draw").dropDuplicates(["text", "toxic"]), sizes


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                 sample: int = SAMPLE, n_features: int = FEATURES) -> ToxicityModel:
    """Learn from the labelled rows given; the sample's bound is ``sample`` texts a class.

    Without both classes among the labels the model gives every text 0.  Where no feature tells the classes apart, or the
    classifier gives none a weight, every text gets the share of toxic labels.
    """
    chosen, sizes = labelled_sample(docs, labels, id_col, text_col, label_col, sample)
    counts = chosen.select("text", "toxic").mapInArrow(_count, "f string, clean long, bad long").groupBy("f").agg(
        F.sum("clean").alias("clean"), F.sum("bad").alias("bad")).filter("clean + bad >= 5")
    totals = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if set(totals) != {0, 1}:
        return ToxicityModel({}, -40.0)
    lift = F.log((F.col("bad") + 0.5) / (totals[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (totals[0] + 1.0))
    deviation = lift / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("clean") + 0.5))
    table = (counts.select("f", lift.alias("lift"), deviation.alias("z")).filter((F.col("lift") > LIFT) & (F.col("z") > CERTAIN))
             .orderBy(F.desc("z"), "f").limit(n_features).collect())
    if not table:
        return ToxicityModel({}, float(np.log(sizes[1] / sizes[0])))
    number = {r["f"]: i for i, r in enumerate(table)}

    def run(batches):
        for batch in batches:
            lists, votes = [], []
            for text in batch.column(1).to_pylist():
                hits = [[number[f] for f in features(w) if f in number] for w in words(text)]
                lists.append([f for h in hits for f in h])
                found = sum(bool(h) for h in hits)
                votes.append([*patterns(text), found > 1, found > 2])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2), pa.array(lists, pa.list_(pa.int32())),
                                              pa.array(votes, pa.list_(pa.bool_()))], ["id", "toxic", "f", "votes"])

    rows = chosen.select("id", "text", "toxic").mapInArrow(run, "id string, toxic int, f array<int>, votes array<boolean>").toArrow()
    rows = rows.sort_by([("id", "ascending")])
    toxic = np.array(rows["toxic"].to_pylist())
    lists = [np.unique(np.array(f, np.int64), return_counts=True) for f in rows["f"].to_pylist()]
    # lexicon voters: for each kind the purest features, then weaker ones, so that a voter is as good as its words
    voter = np.full(len(table), -1)
    kinds = np.array([0 if r["f"][0] == "=" else 1 + BEGINNINGS.index(int(r["f"][0])) for r in table])
    lifts = np.array([r["lift"] for r in table])
    for kind in range(1 + len(BEGINNINGS)):
        voter[kinds == kind] = kind * GROUPS + np.searchsorted(STEPS, -lifts[kinds == kind], "right")
    n_lexicon = GROUPS * (1 + len(BEGINNINGS))
    votes = np.zeros((len(toxic), n_lexicon + 7))
    for i, ((f, _), p) in enumerate(zip(lists, rows["votes"].to_pylist())):
        hit = voter[f]
        votes[i, hit[hit >= 0]] = 1
        votes[i, n_lexicon:-1] = p
        votes[i, -1] = not (hit >= 0).any()
    posterior = fit_label_model(votes, votes[:, -2] == 1, toxic.mean()).posterior(votes)
    if posterior[toxic == 1].mean() < posterior[toxic == 0].mean():
        posterior = 1 - posterior
    # the classifier learns the posterior labels: each text once as either class, if that is likely enough
    examples, target = [], []
    for (f, n), p in zip(lists, posterior):
        target.append(int(p >= 0.5))
        sure = abs(2 * p - 1)
        examples.append((np.append(f, len(table)), np.append(n * 1.0, 1.0) * max(sure, 0.1)))
    weights, bias = _follow(examples, np.array(target), len(table), 2, passes=12, alpha=0.3, l1=0.05, l2=0.05)
    w, b = weights[:, 1] - weights[:, 0], float(bias[1] - bias[0])
    raw = np.array([w[f] @ n + b for f, n in lists])
    slope, shift = _calibrate(raw, toxic)
    drawn = np.log(toxic.sum() / max((toxic == 0).sum(), 1))
    shift += np.log(sizes[1] / sizes[0]) - drawn  # the sample has more of the rarer class
    return ToxicityModel({r["f"]: float(x * slope) for r, x in zip(table, w) if x}, b * slope + shift)


def _calibrate(raw: np.ndarray, toxic: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift that make the classifier's output a log odds for the labelled sample, by Newton steps.

    An output that is the same for all texts gets slope 0 and the log odds of the sample.
    """
    if raw.std() < 1e-9:  # the same for all texts: no evidence, and the odds of the sample
        return 0.0, float(np.log(toxic.sum() / max((toxic == 0).sum(), 1)))
    x = np.stack([raw / raw.std(), np.ones(len(raw))], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (toxic - p) - 1e-3 * theta)
        theta = theta + np.clip(step, -1, 1)
    return float(max(theta[0], 1e-3) / raw.std()), float(theta[1])


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted``; input columns of these names are replaced.

    A null or empty text gets the score of no evidence.  Texts are read whole.
    """
    inputs = [c for c in docs.columns if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers at most

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(text))

    out = docs.select(*[F.col(f"`{c}`") for c in inputs], score(F.col(f"`{text_col}`").cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
