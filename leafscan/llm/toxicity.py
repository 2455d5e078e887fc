"""Toxicity by weak supervision: many voters, a generative label model of their accuracies and correlations, a linear classifier.

1. Voters. Lexicon voters say whether a text has a word of a list: small seed lists by kind of abuse, and lists mined from labelled training
   rows (words and first letters of words that are most bound to the label, dealt out to ``mined_voters`` lists in turn). Pattern voters look for attacks on the reader,
   masked letters, shouting and bursts of exclamation marks.
2. Label model. First and second moments of the votes, over all documents that are not held out, labelled or not. With ``p`` the share of toxic
   rows, independent voters have covariance ``p (1-p) d_i d_j``, ``d`` being the difference of their rates in the two classes: a rank-one fit
   of the off-diagonal covariance gives ``d``. Pairs that it leaves a large rest for are correlated; they are taken out, the fit is repeated,
   and the rest becomes covariance within the classes. The posterior follows the votes along a forest of the strongest correlations.
3. Classifier. Logistic regression on words and their first letters of training rows against the posteriors, then a two-parameter calibration on the same rows' labels.

Labels are learnt only from rows whose crc32 of the id is not 0 modulo ``folds``; at most ``sample_rows`` labelled rows, those with the smallest hash,
are used (that bounds the driver's work and the broadcast list of ids), one text for each id (the least, if an id repeats); everything else covers all
rows. The classifier knows at most ``features`` words, the mined lists at most ``mined_words``: sizes of the model, whatever the input. Scores look at
the text alone.

Null texts are empty and get a score as any other; a null id counts as the empty string; null labels are left out, several labels of an id count as
their maximum; without any labels the seed lists alone make the posteriors. Empty tables give empty results; repeated rows are scored each.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from leafscan.llm import common as c
from leafscan.session import settle

# Seed words of abuse by kind, in four languages.
SEEDS = {
    "stupidity": "idiot idiots moron morons stupid dumb imbecile fool idiota estúpido imbécil idiote débile imbécile dummkopf trottel blödmann".split(),
    "contempt": "pathetic worthless loser losers clown useless garbage trash patético inútil basura payaso minable nul clown nutzlos erbärmlich versager abschaum".split(),
    "disgust": "disgusting scum filth filthy vermin vile asqueroso escoria dégoûtant ordure racaille ekelhaft widerlich dreck".split(),
    "threat": "kill die hang shoot murder morir matar mort tuer crève töten sterben verrecke".split(),
    "profanity": "damn crap shit bullshit ass asshole bitch bastard fuck fucking mierda puta cabrón merde putain connard salope scheiße arschloch hure".split(),
    "hate": "hate hateful subhuman odio haine hass".split(),
}
# Patterns of attacks, masked words and shouting, on lower case or raw text.
PATTERNS = {
    "attack": (True, r"\b(?:you|you're|ur|u)\s+(?:are\s+)?(?:an?\s+|all\s+|such\s+an?\s+)?(?:" + "|".join(SEEDS["stupidity"][:7] + SEEDS["contempt"][:8]) + r")\b"),
    "order": (True, r"\b(?:shut up|go to hell|get lost|drop dead|kill yourself|halt die|vete a|ferme la)\b"),
    "this": (True, r"\b(?:what an?|this|such an?)\s+(?:" + "|".join(SEEDS["stupidity"][:7] + SEEDS["contempt"][:8]) + r")\b"),
    "masked": (True, r"\b(?:f[*@#]{1,3}k|sh[*@#!1]t|b[*@#]tch|a[*@#$]{2}hole|1d10t|id1ot|m0ron|l0ser|stup1d)"),
    "shout": (False, r"(?:\b[A-ZÀ-Þ]{4,}\b[ ,.!?]+){4}"),
    "burst": (False, r"[!?]{3,}"),
}
WORDS = re.compile(r"[^\W\d_]+")
STEM = 4
TELLING = 3.0
SLICE_BYTES = 2 << 20


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 12_000
    folds: int = 5
    mined_words: int = 48
    mined_voters: int = 12
    min_rows: int = 3
    features: int = 8192
    mined_errors: float = 4.0
    purity: float = 0.95
    feature_errors: float = 3.0
    rest: float = 0.25
    penalty: float = 0.5
    steps: int = 250


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    lists: list[list[str]]
    rates: np.ndarray  # rate of each voter in clean and toxic texts
    pairs: list[tuple[int, int, float]]  # correlated voters with their covariance within a class
    balance: float


def terms(lower: str) -> set[str]:
    """The words of a text in lower case, and the first letters of the longer ones with a star: inflected and compound forms share these."""
    words = set(WORDS.findall(lower))
    return words | {w[:STEM] + "*" for w in words if len(w) > STEM}


def id_text(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def held_out(column: str, folds: int) -> Column:
    return F.crc32(F.encode(id_text(column), "UTF-8")) % folds == 0


def _votes(texts: list[str], lists: list[set[str]]) -> np.ndarray:
    patterns = [(lower, re.compile(p)) for lower, p in PATTERNS.values()]
    out = np.zeros((len(texts), len(lists) + len(patterns)), bool)
    voters_of: dict[str, list[int]] = {}
    for k, words in enumerate(lists):
        for w in words:
            voters_of.setdefault(w, []).append(k)
    known = set(voters_of)
    for i, text in enumerate(texts):
        low = text.lower()
        for w in known.intersection(terms(low)):
            out[i, voters_of[w]] = True
        for k, (lower, p) in enumerate(patterns):
            if p.search(low if lower else text):
                out[i, len(lists) + k] = True
    return out


def _sample(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """Settled (text, toxic) of the bounded set of labelled training rows."""
    train = labels.filter(~held_out("doc_id", s.folds) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample_rows)
    rows = docs.join(F.broadcast(chosen.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id"))
    once = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max(F.col("toxic").cast("int")).alias("toxic"))
    return settle(once.select("text", "toxic"), "labelled")


def _word_rows(sample: DataFrame) -> DataFrame:
    """(word, clean, toxic): in how many rows of each class a word stands, added up inside each partition first."""
    def work(batches):
        counts: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                counts[int(y > 0)].update(terms(text.lower()))
        words = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([k[w] for w in words], pa.int64()) for k in counts)], ["word", "clean", "toxic"])
        del counts, words
        c.give_back()

    return sample.mapInArrow(work, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _moments(texts: DataFrame, lists: list[set[str]]) -> tuple[int, np.ndarray]:
    """Number of rows and the matrix of joint votes; each task sends one small row."""
    size = len(lists) + len(PATTERNS)

    def work(batches):
        n, joint = 0, np.zeros((size, size))
        for batch in c.slices(batches, "text", SLICE_BYTES):
            v = _votes(batch.column("text").to_pylist(), lists).astype(np.float32)
            n, joint = n + len(v), joint + v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([joint.ravel()], pa.list_(pa.float64()))], ["n", "joint"])

    parts = texts.mapInArrow(work, "n long, joint array<double>")
    total = parts.agg(F.sum("n"), *(F.sum(F.col("joint")[k]) for k in range(size * size))).first()
    return int(total[0] or 0), np.array([x or 0.0 for x in total[1:]], float).reshape(size, size)


def fit_label_model(n: int, joint: np.ndarray, balance: float, rest: float) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """(rates of each voter in the two classes, correlated pairs with their covariance within a class)."""
    mean = np.diag(joint) / max(n, 1)
    cov = joint / max(n, 1) - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    m, use = len(mean), ~np.eye(len(mean), dtype=bool)
    active = mean * n >= 1
    use &= active[:, None] & active[None, :]
    corr, v = cov / np.outer(spread, spread), np.zeros(m)
    for i in np.flatnonzero(active):  # start: the median over triplets, which a few correlated pairs do not move
        others = [j for j in np.flatnonzero(active) if j != i]
        triplets = [abs(corr[i, j] * corr[i, k] / corr[j, k]) for j in others for k in others if j < k and abs(corr[j, k]) > 1e-4]
        side = 1.0 if not others or corr[i, others].sum() >= 0 else -1.0
        v[i] = side * min(np.sqrt(np.median(triplets)), 0.999) if triplets else 0.3
    for _ in range(3):
        left = np.where(use, corr - np.outer(v, v), 0.0)
        if np.abs(left).max(initial=0) <= rest:
            break
        use &= np.abs(left) <= rest
        for _ in range(60):  # rank-one fit of the pairs in use, one coordinate at a time
            for i in range(m):
                u = v * use[i]
                v[i] = np.clip((corr[i] * use[i]) @ v / max(u @ u, 1e-9), -0.999, 0.999) if use[i].any() else v[i]
    if v.sum() < 0:
        v = -v
    v = np.maximum(v, 0.0)
    d = v * spread / np.sqrt(balance * (1 - balance))
    rates = np.clip(np.stack([mean - balance * d, mean + (1 - balance) * d]), 1e-4, 1 - 1e-4)
    within = (corr - np.outer(v, v)) * np.outer(spread, spread)
    tree, pairs = list(range(m)), []
    for i, j in sorted(((i, j) for i in range(m) for j in range(i) if active[i] and active[j] and not use[i, j]), key=lambda ij: -abs(within[ij])):
        roots = [tree[i], tree[j]]
        if roots[0] != roots[1]:  # a forest: each new edge joins two trees
            tree = [roots[0] if x == roots[1] else x for x in tree]
            pairs.append((i, j, float(within[i, j])))
    return rates, pairs


def posterior(votes: np.ndarray, rates: np.ndarray, pairs: list[tuple[int, int, float]], balance: float) -> np.ndarray:
    """Probability of the toxic class: the factors of the voters that fired and, for correlated pairs of these, joint over single factors.

    A voter that stays silent abstains, as its list may not be of the text's language; silence counts only where all voters that tell the
    classes apart (by ``TELLING`` times) are silent.
    """
    quiet = ~votes[:, rates[1] > TELLING * rates[0]].any(1)
    log = []
    for rate in rates:
        total = votes @ np.log(rate) + quiet * ((1 - votes) @ np.log(1 - rate))
        for i, j, within in pairs:
            both = np.clip(rate[i] * rate[j] + within, 1e-6, min(rate[i], rate[j]))
            total = total + (votes[:, i] & votes[:, j]) * (np.log(both) - np.log(rate[i]) - np.log(rate[j]))
        log.append(total)
    odds = log[1] - log[0] + np.log(balance / (1 - balance))
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _logistic(rows: np.ndarray, columns: np.ndarray, n: int, size: int, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on sparse 0/1 features, by adaptive steps over all rows; ``penalty`` is shared out over the rows."""
    w, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[size] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    for step in range(1, steps + 1):
        z = np.bincount(rows, w[columns], n) + w[size]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gradient = np.append(np.bincount(columns, error[rows], size) + penalty * w[:size], error.sum()) / n
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient ** 2
        w -= 0.1 * (1 - step / (steps + 1)) * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    return w[:size], float(w[size])


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """``docs``: (doc_id, text) without null texts; ``labels``: (doc_id, toxic)."""
    sample = _sample(docs, labels, s)
    sizes = sample.agg(F.count(F.lit(1)), F.sum(F.col("toxic").cast("long"))).first()
    n, toxic = int(sizes[0]), int(sizes[1] or 0)
    learnt = 0 < toxic < n
    balance = float(np.clip(toxic / n if learnt else 0.1, 0.01, 0.99))
    words = settle(_word_rows(sample).filter(F.col("clean") + F.col("toxic") >= s.min_rows), "words")
    both = (F.col("toxic") + F.col("clean")) / F.lit(float(max(n, 1)))
    # How many standard errors a word's shares in the two classes lie apart.
    apart = (F.col("toxic") / F.lit(float(max(toxic, 1))) - F.col("clean") / F.lit(float(max(n - toxic, 1)))) / F.sqrt(
        (both * (1 - both) + 1e-9) * F.lit(1 / max(toxic, 1) + 1 / max(n - toxic, 1)))
    pure = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    strong = words.select("word", apart.alias("apart"), pure.alias("pure")).filter(F.abs("apart") >= s.feature_errors).orderBy(F.desc(F.abs("apart")), "word").limit(s.features)
    found = strong.collect() if learnt else []
    ranked = [(r[0], r[1]) for r in found]
    best = float(np.median([r[2] for r in found if r[1] > 0][:20] or [0.0]))
    mined = [r[0] for r in found if r[1] >= s.mined_errors and r[2] >= s.purity * best][:s.mined_words]
    # Seed words that training rows show to be harmless here are no votes.
    seeds = sorted(set().union(*SEEDS.values()))
    harmless = {r[0] for r in words.filter(F.col("word").isin(seeds) & (pure < 0.5 * best)).select("word").collect()} if learnt else set()
    lists = [set(x) - harmless for x in SEEDS.values()] + [set(mined[k::s.mined_voters]) for k in range(min(s.mined_voters, len(mined)))]
    total, joint = _moments(docs.filter(~held_out("doc_id", s.folds)).select("text"), lists)
    rates, pairs = fit_label_model(total, joint, balance, s.rest)
    place = {w: k for k, (w, _) in enumerate(ranked)}

    def features(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [sorted({place[w] for w in terms(t.lower()) if w in place}) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(posterior(_votes(texts, lists), rates, pairs, balance)), pa.array(found, pa.list_(pa.int32()))],
                                             ["toxic", "posterior", "features"])
            c.give_back()

    rows = sample.mapInArrow(features, "toxic int, posterior double, features array<int>").toArrow()
    seeds = {w: 2.0 for x in SEEDS.values() for w in x}
    if not learnt:
        return Model(seeds, -2.0, [sorted(x) for x in lists], rates, pairs, balance)
    offsets, columns = c.list_parts(rows.column("features").combine_chunks())
    row, column = c.owners(offsets), columns.to_numpy()
    y, soft = rows.column("toxic").to_numpy() > 0, rows.column("posterior").to_numpy()
    w, bias = _logistic(row, column, n, max(len(ranked), 1), soft, s.penalty, s.steps)
    z = np.bincount(row, w[column], n) + bias
    a, b = 1.0, 0.0
    for _ in range(50):  # calibration: Newton steps for two parameters
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        x, h = np.stack([z, np.ones(n)], 1), p * (1 - p) + 1e-6
        step = np.linalg.solve((x * h[:, None]).T @ x + np.diag([1e-3, 1e-3]) * n ** 0.5, x.T @ (y - p) - np.array([a - 1, b]) * 1e-3 * n ** 0.5)
        a, b = a + np.clip(step[0], -0.5, 0.5), b + np.clip(step[1], -1, 1)
    weights = {word: float(a * w[k]) for word, k in place.items()}
    return Model(weights, float(a * bias + b), [sorted(x) for x in lists], rates, pairs, balance)


def score_texts(docs: DataFrame, model: Model, text: str, score: str, predicted: str) -> DataFrame:
    """``docs`` with columns ``score`` and ``predicted`` for the string column ``text`` (null: empty). The model is a bounded list of words with weights."""
    weights, bias, names = model.weights, model.bias, docs.columns
    known = set(weights)

    def work(batches):
        for batch in c.slices(batches, text, SLICE_BYTES):
            z = np.array([bias + sum(weights[w] for w in known.intersection(terms((t.as_py() or "").lower()))) for t in batch.column(text)])
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*names, score, predicted])
            c.give_back()

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings = Settings()) -> Model:
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), c.text_of(text_col).alias("text"))
    return train(slim, labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").alias("toxic")), settings)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = fit(docs, labels, id_col, text_col, settings=settings)
    slim = docs.select(c.row_id(id_col).alias("doc_id"), held_out(id_col, settings.folds).alias("held_out"), c.text_of(text_col).alias("text"))
    return score_texts(slim, model, "text", "score", "predicted").drop("text")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns as they were."""
    model = fit(docs, labels, id_col, text_col, settings=settings)
    text, score, predicted = text_col, c.fresh(docs, "_score"), c.fresh(docs, "_predicted")
    if not isinstance(docs.schema[text_col].dataType, T.StringType):
        text = c.fresh(docs, "_text")
        docs_read = docs.withColumn(text, c.text_of(text_col))
    else:
        docs_read = docs
    scored = score_texts(docs_read, model, text, score, predicted)
    return scored.filter(F.col(predicted) == 0).select(*[F.col(f"`{n}`") for n in docs.columns])
