"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features are densities of two lexicons (a fixed one of insults, plain and after undoing obfuscation, and one learnt from
the labelled texts), nearness to second-person words, and rates of capitals, punctuation and obfuscation; nothing else of
a row is used. The trees are fitted on the driver over a bounded sample of labelled rows. A text's learnt features come
from the words of the other folds' texts while training, and out-of-fold scores give the isotonic map.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.common import map_column, q, settle, without

#: Words of insult and contempt.
LEXICON = """
airhead asshole bastard bigot bimbo bitch bollocks bozo brainless bullshit buffoon clown clueless coward creep cretin
crap cunt damn degenerate deplorable despicable dickhead dimwit disgrace disgusting dolt donkey douche dumb dumbass
dunce dweeb fag fatso filth filthy fool foolish freak fuck fucker fucking garbage goon gross halfwit hate hateful
hideous hypocrite idiot idiotic ignorant imbecile inbred jackass jerk junkie kill lame laughable lazy liar lousy loser
lunatic maggot maniac miserable mongrel monster moron moronic mutt nasty nazi nincompoop nitwit numbskull oaf parasite
pathetic peasant pest pig poop prick psycho puke racist rat repulsive retard retarded revolting rotten rubbish savage
scum scumbag shit shitty shithead sicko sleazy slime slob slut smelly snob sordid spineless stink stupid suck swine
terrorist thug traitor tramp trash twat twit ugly useless vermin vile wanker weasel weirdo whore wimp worm worthless
wretch wretched
abruti connard connasse crétin débile enculé imbécile merde minable ordure salaud salope
arschloch blödmann depp dreck dumm dummkopf hurensohn mistkerl scheiße schwein trottel versager
basura cabrón estúpido gilipollas idiota imbécil inútil mierda pendejo puta
""".split()
#: Second-person words.
YOU = set("you your yours youre yourself yourselves u ur ya tu te toi ton tes vous votre vos du dich dir dein deine euch ihr tú ti usted ustedes vosotros".split())
#: Signs that stand for letters.
LEET = str.maketrans("013457@$!|", "oieastasil")

TERMS = frozenset(LEXICON) | frozenset(w + "s" for w in LEXICON)
LETTERS = re.compile(r"[^\W\d_]+")
SIGNS = ".,;:?!\"'()[]{}<>#%&*$|/\\-_=+~^`"
NEAR = 5  # words between an insult and the one it is aimed at
FOLDS = 5
#: A word is learnt if so many toxic texts of the sample hold it, and so many standard deviations more than would by chance.
LEAST_TEXTS, LEAST_DEVIATIONS = 3, 4.0
LEARNT = 10_000  # words of the learnt lexicon at most, those of most toxic texts

NAMES = (
    "log_words", "hit_density", "log_hits", "distinct_hits", "hidden_density", "log_hidden", "you_density", "near_you", "nearest_you", "capitals",
    "upper_words", "exclaims", "questions", "punctuation", "mark_runs", "digits", "odd_words", "spaced", "stretched", "word_length", "non_ascii",
    "learnt_density", "learnt_distinct", "learnt_weight", "learnt_top", "near_learnt",
)


def _term(word: str) -> bool:
    if word in TERMS:
        return True
    once = re.sub(r"(.)\1+", r"\1", word)
    return once in TERMS or re.sub(r"(.)\1\1+", r"\1\1", word) in TERMS


def _hidden(core: str) -> bool:
    """Whether a word with signs or digits in it is a term once they are read as letters, dropped, or taken as masks."""
    letters = re.sub(r"[^a-zà-ÿß]", "", core.translate(LEET))
    dropped = re.sub(r"[^a-zà-ÿß]", "", core)
    if _term(letters) or len(dropped) > 3 and _term(dropped):
        return True
    if len(core) < 20 and re.fullmatch(r"[a-z]+[*#_\-]+[a-z]+", core):
        mask = re.compile(re.sub(r"[^a-z]", ".", core))
        return any(mask.fullmatch(t) for t in TERMS)
    return False


def _spaced(words: list[str]) -> int:
    """Terms written with spaces between their letters."""
    found, run = 0, ""
    for w in [*words, ""]:
        if len(w) == 1:
            run += w
        else:
            found += len(run) > 3 and any(t in run for t in TERMS if len(t) > 3)
            run = ""
    return found


def plain_words(text: str | None) -> list[str]:
    """The lower-case words of a text without signs at their ends."""
    return [w.strip(SIGNS) for w in (text or "").lower().split()]


def _learnt(words: list[str], yous: list[int], lexicon: Mapping[str, float]) -> tuple[float, ...]:
    """Density of learnt words, distinct ones, the sum and largest of their weights, and those near a second-person word."""
    hits = [(i, w) for i, w in enumerate(words) if w in lexicon]
    if not hits:
        return 0.0, 0.0, 0.0, 0.0, 0.0
    weights = [lexicon[w] for w in {w for _, w in hits}]
    near = sum(any(abs(i - yous[j]) <= NEAR for j in (k - 1, k) if 0 <= j < len(yous)) for (i, _), k in zip(hits, np.searchsorted(yous, [i for i, _ in hits]), strict=True)) if yous else 0
    return len(hits) / len(words), len(weights), sum(weights), max(weights), near


def features(text: str | None, lexicon: Mapping[str, float] | None = None) -> list[float]:
    """The features NAMES of one whole text, given weights of learnt words; null counts as empty."""
    text = text or ""
    low = text.lower()
    tokens = text.split()
    words = plain_words(text)
    n, chars = max(1, len(words)), max(1, len(text))
    hits = [i for i, w in enumerate(words) if w in TERMS]
    odd = [i for i, w in enumerate(words) if not w.isalpha() and len(w) > 1]
    hidden = 0
    for i in odd:
        if any(w in TERMS for w in LETTERS.findall(words[i])):
            hits.append(i)
        elif not words[i].isdigit():
            hidden += _hidden(words[i])
    hits.sort()
    yous = [i for i, w in enumerate(words) if w in YOU]
    near, nearest = 0, 1e3
    if hits and yous:
        at = np.searchsorted(yous, hits)
        for i, k in zip(hits, at, strict=True):
            gap = min(abs(i - yous[j]) for j in (k - 1, k) if 0 <= j < len(yous))
            near, nearest = near + (gap <= NEAR), min(nearest, gap)
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    b = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    capitals = int(np.count_nonzero(a != b)) if len(a) == len(b) else sum(map(str.isupper, text))
    stretched = 0
    if np.any((b[2:] == b[1:-1]) & (b[1:-1] == b[:-2]) & (b[2:] > 64)):
        drawn = [w for w in words if w.isalpha() and re.search(r"(.)\1\1", w)]
        stretched = len(drawn)
        hidden += sum(w not in TERMS and _term(w) for w in drawn)
    spaced = _spaced(words)
    marks = np.bincount(np.minimum(a, 128), minlength=129)
    return [
        float(x)
        for x in (
            np.log1p(len(words)), len(hits) / n, np.log1p(len(hits)), len({words[i] for i in hits}), (hidden + spaced) / n, np.log1p(hidden + spaced), len(yous) / n, near, nearest,
            capitals / chars, sum(map(str.isupper, tokens)) / n, marks[33] / chars, marks[63] / chars,
            (marks[33:48].sum() + marks[58:65].sum() + marks[91:97].sum() + marks[123:127].sum()) / chars, sum(map(text.count, ("!!", "??", "!?"))) / n, marks[48:58].sum() / chars,
            len(odd) / n, spaced, stretched / n, chars / n, marks[128] / chars,
            *_learnt(words, yous, lexicon or {}),
        )
    ]


@dataclass
class Trees:
    """Boosted regression trees on the log odds; inner nodes of one tree are laid out as a complete binary tree."""

    start: float
    column: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows, inner = np.arange(len(x)), self.column.shape[1]
        for column, cut, leaf in zip(self.column, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            while at.size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, column[at]] > cut[at])
            out += leaf[at - inner]
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 4.0, ridge: float = 2.0) -> Trees:
    """Boosting by Newton steps; splits are sought over quantile bins of each feature."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], axis=1)
    width, inner = bins + 1, 2**depth - 1
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    model = Trees(float(np.log(share / (1 - share))), np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    z = np.full(len(y), model.start)
    gain_of = lambda g, h: g * g / (h + ridge)
    for t in range(trees):
        p = sigmoid(z)
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-6)
            chosen = np.full(count, -1)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                cell = (at - first) * width + codes[:, j]
                gs, hs = (np.bincount(cell, weights=v, minlength=count * width).reshape(count, width) for v in (g, h))
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                ga, ha = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gain_of(gl, hl) + gain_of(ga - gl, ha - hl) - gain_of(ga, ha)
                gain[(hl < least) | (ha - hl < least)] = 0
                gain[:, len(e) :] = 0
                k = gain.argmax(1)
                top = gain[np.arange(count), k]
                for node in np.flatnonzero(top > best):
                    best[node], chosen[node] = top[node], j
                    model.column[t, first + node], model.cut[t, first + node] = j, e[k[node]]
            at = 2 * at + 1 + (x[np.arange(len(x)), model.column[t, at]] > model.cut[t, at])
        leaf = at - inner
        gl, hl = (np.bincount(leaf, weights=v, minlength=inner + 1) for v in (g, h))
        model.leaf[t] = rate * gl / (hl + ridge)
        z += model.leaf[t, leaf]
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of the non-decreasing step means of y by score."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, sum of scores
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class Model:
    trees: Trees | None
    knots: np.ndarray
    means: np.ndarray
    base: float
    lexicon: dict[str, float] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; a thousandth of the uncalibrated ones orders those that the isotonic map ties."""
        if self.trees is None or not len(x):
            return np.full(len(x), self.base)
        p = sigmoid(self.trees.raw(x))
        return np.clip(0.999 * np.interp(p, self.knots, self.means) + 0.001 * p, 0.0, 1.0)


def fit(x: np.ndarray, y: np.ndarray, fold: np.ndarray | None = None) -> Model:
    """Trees over all rows, isotonic map over out-of-fold scores. Without both classes: the constant share of ones."""
    if len(y) < 2 * FOLDS or not 0 < y.sum() < len(y):
        return Model(None, np.zeros(0), np.zeros(0), float(y.mean()) if len(y) else 0.0)
    fold = np.arange(len(y)) % FOLDS if fold is None else fold
    out = np.zeros(len(y))
    for k in range(FOLDS):
        out[fold == k] = sigmoid(fit_trees(x[fold != k], y[fold != k]).raw(x[fold == k]))
    knots, means = isotonic(out, y)
    return Model(fit_trees(x, y), knots, means, float(y.mean()))


FEATURES = T.StructType([T.StructField("fold", T.IntegerType(), False), T.StructField("features", T.ArrayType(T.DoubleType(), False), False)])
WORDS = T.StructType([T.StructField("fold", T.IntegerType(), False), T.StructField("words", T.ArrayType(T.StringType(), False), False)])
SCORE = T.StructType([T.StructField("score", T.DoubleType(), False)])


def fold_of(text: str | None) -> int:
    """Equal texts are in one fold."""
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) % FOLDS


def add_features(df: DataFrame, col: str = "text", lexicons: list[dict[str, float]] | None = None) -> DataFrame:
    """df with fold and features, the array of NAMES for each text; lexicons has the learnt words for texts of each fold."""
    held = df.sparkSession.sparkContext.broadcast(lexicons)

    def make():
        by_fold = held.value

        def run(texts):
            folds = [fold_of(t) for t in texts]
            return folds, [features(t, by_fold[k] if by_fold else None) for t, k in zip(texts, folds, strict=True)]

        return run

    return map_column(df, col, FEATURES, make)


def held_out(doc_id: Column) -> Column:
    """Rows that training must not see; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def weigh(words: list[str], toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> dict[str, float]:
    """Weights of the words that toxic texts hold more often than by chance: their log odds, shrunk for rare words.

    toxic and clean have the numbers of texts that hold each word, of n_toxic and n_clean in all.
    """
    if not n_toxic or not n_clean:
        return {}
    share = n_toxic / (n_toxic + n_clean)
    chance = (toxic + clean) * share
    sure = (toxic >= LEAST_TEXTS) & (toxic - chance >= LEAST_DEVIATIONS * np.sqrt(chance * (1 - share)))
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    weight = odds * toxic / (toxic + LEAST_TEXTS)
    return {words[i]: float(weight[i]) for i in np.flatnonzero(sure)}


def learn_words(texts: DataFrame, col: str = "__text", label: str = "__y") -> tuple[dict[str, float], list[dict[str, float]]]:
    """The lexicon learnt from all of the labelled texts, and for each fold that learnt from the other folds.

    The driver gets the at most LEARNT words that most toxic texts hold and that are more frequent there than elsewhere.
    """

    def make():
        return lambda texts: ([fold_of(t) for t in texts], [sorted(set(plain_words(t)) - {""}) for t in texts])

    rows = map_column(texts.select(col, label), col, WORDS, make).drop(col)
    sides = [(F.col(label) == y) & (F.col("fold") == k) for k in range(FOLDS) for y in (1, 0)]
    counts = [F.count(F.when(w, 1)).alias(f"c{i}") for i, w in enumerate(sides)]
    totals = np.array(rows.agg(*counts).first(), dtype=float).reshape(FOLDS, 2)
    toxic, clean = (sum(F.col(f"c{i}") for i in range(y, 2 * FOLDS, 2)) for y in (0, 1))
    n_toxic, n_clean = totals.sum(axis=0)
    likely = (toxic >= LEAST_TEXTS) & (toxic * F.lit(float(n_clean)) > clean * F.lit(float(n_toxic)))
    found = rows.select(label, "fold", F.explode("words").alias("word")).groupBy("word").agg(*counts).where(likely)
    found = found.orderBy(toxic.desc(), "word").limit(LEARNT).collect()
    words = [r["word"] for r in found]
    by_fold = np.array([[r[f"c{i}"] for i in range(2 * FOLDS)] for r in found], dtype=float).reshape(-1, FOLDS, 2)
    every = by_fold.sum(axis=1)
    others = [weigh(words, *(every - by_fold[:, k]).T, *(totals.sum(axis=0) - totals[k])) for k in range(FOLDS)]
    return weigh(words, *every.T, n_toxic, n_clean), others


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, col: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Model:
    """A model from at most sample labelled rows, those of the lowest hash of the id, none of them held out.

    Rows with a null id or label do not count; of an id with several labels the largest holds; documents that share
    an id all count, equal texts once (toxic, if one of them is). sample bounds what the driver and the broadcast hold.
    """
    known = labels.where(F.col(q(doc_id)).isNotNull() & F.col(q(label)).isNotNull() & ~held_out(F.col(q(doc_id))))
    known = known.groupBy(F.col(q(doc_id)).alias("__id")).agg(F.max(F.col(q(label))).cast("double").alias("__y"))
    chosen = settle(known.orderBy(F.xxhash64("__id"), "__id").limit(sample))  # fixed bound: broadcast below
    texts = docs.select(F.col(q(doc_id)).alias("__id"), F.col(q(col)).alias("__text")).join(F.broadcast(chosen), "__id")
    texts = settle(texts.groupBy("__text").agg(F.max("__y").alias("__y"), F.min(F.xxhash64("__id")).alias("__h")))
    lexicon, others = learn_words(texts)
    rows = add_features(texts, "__text", others).select("__y", "fold", "__h", F.xxhash64("__text").alias("__t"), "features")
    rows = rows.orderBy("__h", "__t").limit(sample).collect()
    x = np.array([r["features"] for r in rows]).reshape(-1, len(NAMES))
    model = fit(x, np.array([r["__y"] for r in rows]), np.array([r["fold"] for r in rows]))
    model.lexicon = lexicon
    return model


def score(df: DataFrame, model: Model, col: str = "text") -> DataFrame:
    """df with score (double, 0 to 1) and predicted (int, 1 if score >= 0.5). Null and empty texts are scored as
    texts without words; equal texts get equal scores. Columns of df with one of these names are replaced."""
    broadcast = df.sparkSession.sparkContext.broadcast(model)

    def make():
        one = broadcast.value
        return lambda texts: (pa.array(one.score(np.array([features(t, one.lexicon) for t in texts]).reshape(-1, len(NAMES)))),)

    rest = df.select(*(F.col(q(c)) for c in without(df, ["score", "predicted"])))
    return map_column(rest, col, SCORE, make).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
