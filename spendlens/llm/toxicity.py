"""Toxicity by weak supervision.

Many voters look at a text: fixed lexicons, patterns of its form, and words or beginnings of words found in labelled texts. A
voter fires or not. A generative label model takes the class of a text as hidden: it estimates how often each voter fires in
either class (its accuracy) from all texts, beginning with what the labelled ones say, and how the voters depend on each other
within a class; voters that repeat each other share their weight. Its posterior is the label of every text. A linear classifier
is then trained on texts with these labels, and scores any text by many more words than there are voters.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import fresh, written

# Insults by language.
LEXICONS = {
    "en": "idiot moron stupid trash pathetic loser scum worthless disgusting clown dumb fool jerk bastard ugly filth vermin liar "
          "coward imbecile retard freak creep garbage bitch whore asshole",
    "de": "idiot dumm dummkopf trottel arschloch abschaum versager widerlich wertlos miststück hure schlampe dreckig spinner",
    "es": "idiota estúpido estúpida imbécil basura inútil asqueroso patético escoria payaso perdedor puta mierda cabrón",
    "fr": "idiot idiote stupide imbécile ordure minable connard connasse salope débile pathétique crétin pute merde",
}
# Forms of a text, and of a word, that often come with insults.
FORMS = {
    "masked": r"[*#@$]{2,}\w",
    "marks": r"[!?]{3}",
}
DRAWN = re.compile(r"(.)\1{3}")
PREFIXES = (3, 4, 5, 6, 7)
LEVELS = 5  # it occurs; in 1 of 256 words, of 128, of 64, of 32
_WORD = re.compile(r"[^\W\d_]+")
_LONGEST = 40
_SCALE = 1 << 16


def _words(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def names_of(word: str) -> list[str]:
    """Features of a word: itself and its beginnings."""
    return ([word] if len(word) <= _LONGEST else []) + [f"{word[:k]}*" for k in PREFIXES if len(word) > k]


def _level(count: int, words: int) -> int:
    return min(LEVELS, 1 + (256 * count // words).bit_length())


def _text_features(text: str) -> dict[str, int]:
    """Level of every feature of a text."""
    counts: Counter = Counter()
    words = _words(text)
    for word, n in words.items():
        for name in names_of(word):
            counts[name] += n
    total = words.total()
    return {name: _level(n, total) for name, n in counts.items()}


@dataclass
class Marks:
    """Which of the listed features and of the fixed voters a text has."""

    features: list[str]
    known: dict[str, int] = field(init=False)
    cache: dict[str, tuple[tuple[int, ...], int]] = field(init=False, default_factory=dict)

    def __post_init__(self):
        self.known = {f: i for i, f in enumerate(self.features)}
        self.forms = [re.compile(x) for x in FORMS.values()]
        self.listed: dict[str, int] = {}
        for place, words in enumerate(LEXICONS.values()):
            for word in words.split():
                self.listed[word] = self.listed.get(word, 0) | 1 << place

    def _of_word(self, word: str) -> tuple[tuple[int, ...], int]:
        hits = tuple(self.known[x] for x in names_of(word) if x in self.known)
        return hits, self.listed.get(word, 0) | (DRAWN.search(word) is not None) << (FIXED - 1)

    def of(self, text: str) -> tuple[dict[int, int], int]:
        """Level of each feature of the text, and the fixed voters that fire, as bits."""
        words, counts, bits = _words(text), {}, 0
        if len(self.cache) > 500_000:
            self.cache.clear()
        for word, n in words.items():
            found = self.cache.get(word)
            if found is None:
                found = self.cache[word] = self._of_word(word)
            bits |= found[1]
            for i in found[0]:
                counts[i] = counts.get(i, 0) + n
        for place, form in enumerate(self.forms, len(LEXICONS)):
            bits |= (form.search(text) is not None) << place
        total = words.total()
        return {i: _level(n, total) for i, n in counts.items()}, bits


FIXED = len(LEXICONS) + len(FORMS) + 1


@dataclass
class LabelModel:
    """P(voter fires | class), shares of weight and the prior: the posterior of a pattern of votes.

    A voter that does not fire abstains; only that no lexicon and no word fires says something, as one more voter does. A voter's
    share is one over the sum of its squared correlations with all voters within a class: one of m copies has 1/m.
    """

    prior: float
    toxic: np.ndarray
    clean: np.ndarray
    share: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = np.log(self.prior / (1 - self.prior)) + votes @ (np.log(self.toxic / self.clean) * self.share)
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))

    @staticmethod
    def fitted(both_toxic: np.ndarray, both_clean: np.ndarray, n_toxic: float, n_clean: float) -> LabelModel:
        """From the numbers of texts of either class in which two voters fire together (a voter's own number on the diagonal)."""
        rates, within, weight = [], 0.0, 0.0
        for both, n in ((both_toxic, n_toxic), (both_clean, n_clean)):
            rate = (np.diag(both) + 0.5) / (n + 1.0)
            rates.append(np.clip(rate, 1e-9, 1 - 1e-9))
            within = within + both - np.outer(np.diag(both), np.diag(both)) / max(n, 1.0)
            weight += n
        spread = np.sqrt(np.maximum(np.diag(within), 1e-12))
        correlation = np.clip(within / np.outer(spread, spread), 0.0, 1.0)
        np.fill_diagonal(correlation, 1.0)
        total = n_toxic + n_clean
        prior = min(max((n_toxic + 0.5) / (total + 1.0), 1e-9), 1 - 1e-9)
        return LabelModel(prior, rates[0], rates[1], 1 / (correlation**2).sum(axis=1))


@dataclass
class Model:
    """A linear classifier over the levels that features reach and the fixed voters."""

    features: list[str]
    weights: np.ndarray  # levels of each feature, fixed voters, constant
    voters: list[tuple[int, int]]  # feature, level
    labels: LabelModel | None

    def __post_init__(self):
        # what all levels up to one add, in the order of the features
        size = len(self.features) * LEVELS
        self.reached = self.weights[:size].reshape(-1, LEVELS).cumsum(axis=1).tolist()
        self.fixed = self.weights[size:].tolist()

    def scores(self, texts: list[str | None], marks: Marks) -> list[float]:
        out = []
        for text in texts:
            levels, bits = marks.of(text or "")
            value = self.fixed[-1]
            for i in sorted(levels):
                value += self.reached[i][levels[i] - 1]
            for p in range(FIXED):
                if bits >> p & 1:
                    value += self.fixed[p]
            out.append(1 / (1 + math.exp(-min(60.0, max(-60.0, value)))))
        return out


def pattern_of(levels: dict[int, int], bits: int, voters: list[tuple[int, int]]) -> int:
    """Votes as the bits of one number: fixed voters first."""
    for place, (feature, level) in enumerate(voters, FIXED):
        bits |= (levels.get(feature, 0) >= level) << place
    return bits


_WORDLESS = ((1 << FIXED) - 1) ^ ((1 << len(LEXICONS)) - 1)  # voters that look at the form


def votes_of(patterns: np.ndarray, voters: int) -> np.ndarray:
    """Votes as rows of 0 and 1; the last column says that none of the voters that look at words has fired."""
    votes = (patterns[:, None] >> np.arange(voters, dtype=np.int64)[None, :]) & 1
    return np.concatenate((votes, (patterns & ~_WORDLESS == 0)[:, None]), axis=1).astype(np.float64)


def _chance(share: float) -> int:
    """Bound for 62 bits of a hash, so that about such a share lies below."""
    return int(min(1.0, share) * (1 << 62))


def _drawn(share: float, *columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 2) <= _chance(share)


def _sample(documents: DataFrame, labels: DataFrame, sample_rows: int, doc_id: str, text: str, label: str) -> tuple[DataFrame, dict]:
    """(text, toxic, w) of labelled documents, `sample_rows` at most in the mean; w restores the shares of the classes."""
    toxic = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(
        F.max((F.col(label) > 0).cast("int")).alias("toxic"))
    toxic = written(toxic, "labels")
    counts = {r.toxic: r.n for r in toxic.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {c: min(1.0, sample_rows / 2 / n) for c, n in counts.items()}
    # about `sample_rows` rows of an id and a label
    drawn = toxic.where(_drawn(share.get(1, 0.0), F.col("id"), F.lit("label")) & (F.col("toxic") == 1)
                        | _drawn(share.get(0, 0.0), F.col("id"), F.lit("label")) & (F.col("toxic") == 0))
    rows = documents.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(drawn), "id")
    return written(rows.select("text", "toxic").distinct(), "labelled"), share


def _mined(sample: DataFrame, size: int, least: int) -> tuple[list[str], np.ndarray]:
    """Features that tell the classes apart best in the sample, and the numbers of (toxic, clean) rows with each level."""

    def counted(wanted: list[str] | None, only: int | None):
        chosen = None if wanted is None else frozenset(wanted)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[str, int], int] = {}

            def emitted() -> pa.RecordBatch:
                rows = pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.int32()), pa.array(list(held.values()), pa.int64())],
                    names=["feature", "place", "n"])
                held.clear()
                return rows

            for batch in batches:
                for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if only is not None and toxic != only:
                        continue
                    for name, level in _text_features(text).items():
                        if chosen is None or name in chosen:
                            key = name, (1 - toxic) * LEVELS + level - 1
                            held[key] = held.get(key, 0) + 1
                    if len(held) > 300_000:
                        yield emitted()
            yield emitted()

        return sample.mapInArrow(count, "feature string, place int, n long").groupBy("feature", "place").agg(F.sum("n").alias("n"))

    # a feature has to be in some toxic rows; counts of the others are not needed
    often = counted(None, 1).groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    wanted = [r.feature for r in often.orderBy(F.desc("n"), "feature").limit(20 * size).collect()]
    table = {name: i for i, name in enumerate(sorted(wanted))}
    counts = np.zeros((len(table), 2 * LEVELS), np.int64)
    for r in counted(wanted, None).collect():
        counts[table[r.feature], r.place] = r.n
    counts = counts.reshape(-1, 2, LEVELS)[:, :, ::-1].cumsum(axis=2)[:, :, ::-1]  # this level or more
    return sorted(wanted), counts


def _lean(counts: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """How surely a feature at a level speaks for the toxic class: log ratio of its rates less three errors, 0 below a ratio of
    two, times the root of its rows."""
    toxic, clean = counts[:, 0] + 0.5, counts[:, 1] + 0.5
    sure = np.log(toxic / (n_toxic + 1)) - np.log(clean / (n_clean + 1)) - 3 * np.sqrt(1 / toxic + 1 / clean)
    return np.where(sure > math.log(2), sure, 0) * np.sqrt(counts[:, 0])


def _newton(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, weight: np.ndarray, size: int, ridge: float) -> np.ndarray:
    """Weights of a logistic regression on sparse rows of ones, the last one without penalty."""
    w, n = np.zeros(size), len(y)
    penalty = np.full(size, ridge)
    penalty[-1] = 1e-9

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows, x[cols], n)

    def back(x: np.ndarray) -> np.ndarray:
        return np.bincount(cols, x[rows], size)

    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -60, 60)))
        gradient = back(weight * (p - y)) + penalty * w
        if np.abs(gradient).max() < 1e-7 * max(1.0, weight.sum()):
            break
        curve = weight * p * (1 - p)
        step, rest = np.zeros(size), -gradient
        way, size2 = rest.copy(), float(rest @ rest)
        for _ in range(40):
            bent = back(curve * forward(way)) + (penalty + 1e-9) * way
            by = size2 / float(way @ bent)
            step += by * way
            rest -= by * bent
            before, size2 = size2, float(rest @ rest)
            if size2 < 1e-10:
                break
            way = rest + size2 / before * way
        w = w + step / max(1.0, np.abs(step).max() / 4)
    return w


def learn(
    documents: DataFrame, labels: DataFrame, sample_rows: int = 20_000, size: int = 1000, most_voters: int = 48, turns: int = 8,
    doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
) -> Model | None:
    """The classifier, from all documents and the labels of some. None if no row of either table says anything.

    Words come from `sample_rows` labelled documents at most, half of them toxic, if there are so many; `size` features and
    `most_voters` of them as voters at most. The label model is estimated on all documents in up to `turns` turns, each of which
    reads one row per pattern of votes; sums are of whole numbers, so they depend on no order. The linear classifier is fitted on
    `sample_rows` different texts at most, drawn by hash from either class of the posterior, and on the labelled ones.

    A null text is empty. Labels that are null or have no id are left out; of several labels of an id the largest counts, and
    all rows with that id have it. Without labels, the lexicons' votes stand in for them at first.
    """
    spark = documents.sparkSession
    sample, share = _sample(documents, labels, sample_rows, doc_id, text, label)
    found = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = found.get(1, 0), found.get(0, 0)
    features, counts = _mined(sample, size, 3) if n_toxic and n_clean else ([], np.zeros((0, 2, LEVELS), np.int64))
    lean = _lean(counts, n_toxic, n_clean) if len(features) else np.zeros((0, LEVELS))
    against = _lean(counts[:, ::-1], n_clean, n_toxic) if len(features) else lean
    best = np.argsort(-np.maximum(lean, against).max(axis=1, initial=0), kind="stable")[:size]
    best = best[np.maximum(lean, against)[best].max(axis=1, initial=0) > 0]
    lean, features = lean[best], [features[i] for i in best]
    marks = Marks(features)

    # labelled rows: features, for the choice of voters and for the classifier
    shared = spark.sparkContext.broadcast(features)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Marks(shared.value)
        for batch in batches:
            rows = [own.of(t) for t in batch.column(0).to_pylist()]
            yield _vectors(rows, [b for _, b in rows], batch.column(1))

    gold = sample.mapInArrow(marked, _VECTOR + ", toxic int").collect() if n_toxic + n_clean else []
    voters = _voters(gold, lean, most_voters)
    several = FIXED + len(voters)
    chosen = spark.sparkContext.broadcast((features, voters))

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, places = chosen.value
        own = Marks(names)
        for batch in batches:
            rows = [own.of(t or "") for t in batch.column(0).to_pylist()]
            yield _vectors(rows, [pattern_of(levels, bits, places) for levels, bits in rows])

    # equal vectors of votes and features are one row with a count
    vectors = written(
        documents.select(F.col(text).alias("text")).mapInArrow(voted, _VECTOR)
        .groupBy("pattern", "features", "levels").agg(F.count("*").alias("n")), "vote-vectors")
    patterns = written(vectors.groupBy("pattern").agg(F.sum("n").alias("n"), F.count("*").alias("rows")), "vote-patterns")

    own = np.array([pattern_of(dict(zip(r.features, r.levels)), r.pattern, voters) for r in gold], np.int64)
    is_toxic = np.array([r.toxic for r in gold], bool)
    known = votes_of(own, several)
    if n_toxic and n_clean:
        # classes in the shares that they have among the labels
        weight = np.where(is_toxic, 1 / share[1], 1 / share[0])
    else:
        weight = np.zeros(len(gold))
    sums = [(known[c] * weight[c][:, None]).T @ known[c] for c in (is_toxic, ~is_toxic)]
    sizes = [float(weight[c].sum()) for c in (is_toxic, ~is_toxic)]
    if sum(sizes):
        model = LabelModel.fitted(*sums, *sizes)
    else:
        lexicons, none = np.arange(several + 1) < len(LEXICONS), np.arange(several + 1) == several
        model = LabelModel(
            0.05, np.select([lexicons, none], [0.5, 0.3], 0.1), np.select([lexicons, none], [0.01, 0.95], 0.1), np.ones(several + 1))
    rows_of = np.zeros(2)
    for _ in range(turns):
        both_toxic, both, n_toxic_all, n_all, rows_of = _expected(patterns, model, several)
        if not n_all:
            break
        after = LabelModel.fitted(sums[0] + both_toxic, sums[1] + both - both_toxic, sizes[0] + n_toxic_all, sizes[1] + n_all - n_toxic_all)
        change = max(np.abs(after.toxic - model.toxic).max(), np.abs(after.clean - model.clean).max())
        model = after
        if change < 1e-4:
            break
    if not sum(sizes) and not both_fired(patterns, len(LEXICONS)):
        return None
    return _classifier(vectors, model, rows_of, gold, own, weight, features, voters, sample_rows)


def both_fired(patterns: DataFrame, lexicons: int) -> bool:
    """Whether any lexicon has fired."""
    return not patterns.where(F.col("pattern").bitwiseAND(F.lit((1 << lexicons) - 1)) != 0).isEmpty()


_VECTOR = "pattern long, features array<int>, levels array<int>"


def _vectors(rows: list[tuple[dict[int, int], int]], patterns: list[int], *more: pa.Array) -> pa.RecordBatch:
    ordered = [sorted(levels.items()) for levels, _ in rows]
    arrays = [
        pa.array(patterns, pa.int64()), pa.array([[i for i, _ in x] for x in ordered], pa.list_(pa.int32())),
        pa.array([[n for _, n in x] for x in ordered], pa.list_(pa.int32())), *more,
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["pattern", "features", "levels", "toxic"][: len(arrays)])


def _voters(gold: list, lean: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Features at a level, surest first, each for the toxic rows that few voters before it have found; most frequent ones first."""
    toxic = [dict(zip(r.features, r.levels)) for r in gold if r.toxic]
    if not len(lean) or not toxic:
        return []
    level = lean.argmax(axis=1) + 1
    fires = np.zeros((len(toxic), len(lean)), bool)
    for row, levels in enumerate(toxic):
        for i, n in levels.items():
            fires[row, i] = n >= level[i]
    worth, left, out = lean.max(axis=1), np.ones(len(toxic)), []
    sure = worth / np.sqrt(np.maximum(fires.sum(axis=0), 1))
    for _ in range(min(most, len(lean))):
        gain = (left @ fires) * sure
        i = int(gain.argmax())
        if gain[i] <= 0:
            break
        out.append((i, int(level[i])))
        left = np.where(fires[:, i], left / 2, left)
        sure[i] = 0
    return out


def _expected(patterns: DataFrame, model: LabelModel, several: int) -> tuple[np.ndarray, np.ndarray, float, float, np.ndarray]:
    """Expected numbers of toxic texts, and of all, in which two voters fire together; sizes; and rows of either class."""
    table = patterns.sparkSession.sparkContext.broadcast(model)
    square = (several + 1) ** 2

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * square + 4, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, n, rows = (batch.column(i).to_numpy() for i in range(3))
            votes = votes_of(keys, several)
            p = table.value.posterior(votes)
            mass = n * np.rint(p * _SCALE).astype(np.int64)
            whole = votes.astype(np.int64)
            total += np.concatenate((
                (whole.T @ (whole * mass[:, None])).reshape(-1), (whole.T @ (whole * n[:, None])).reshape(-1),
                [mass.sum(), n.sum(), rows[p >= 0.5].sum(), rows[p < 0.5].sum()],
            ))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    total = np.zeros(2 * square + 4)
    for r in patterns.mapInArrow(counted, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        total[r["at"]] = r.n
    toxic, every = (total[i * square : (i + 1) * square].reshape(several + 1, several + 1) for i in (0, 1))
    return toxic / _SCALE, every, total[-4] / _SCALE, total[-3], total[-2:]


def _classifier(
    vectors: DataFrame, labels: LabelModel, rows_of: np.ndarray, gold: list, own: np.ndarray, gold_weight: np.ndarray,
    features: list[str], voters: list[tuple[int, int]], sample_rows: int,
) -> Model:
    several = FIXED + len(voters)
    shares = [min(1.0, sample_rows / 2 / max(1.0, n)) for n in rows_of]
    table = vectors.sparkSession.sparkContext.broadcast((labels, [_chance(s) for s in shares]))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, bounds = table.value
        for batch in batches:
            if batch.num_rows:
                p = model.posterior(votes_of(batch.column(0).to_numpy(), several))
                keep = batch.column(4).to_numpy() <= np.where(p >= 0.5, bounds[0], bounds[1])
                yield batch.append_column("p", pa.array(p)).filter(pa.array(keep))

    hashed = vectors.withColumn("h", F.shiftrightunsigned(F.xxhash64("pattern", "features", "levels"), 2))
    weak = hashed.mapInArrow(drawn, _VECTOR + ", n long, h long, p double").collect()
    weak.sort(key=lambda r: (r.h, r.pattern, r.features, r.levels))  # in no order of tasks
    rows, cols, y, weight = [], [], [], []
    size = len(features) * LEVELS + FIXED + 1

    def add(r, target: float, by: float, pattern: int) -> None:
        reached = [i * LEVELS + x for i, level in zip(r.features, r.levels) for x in range(level)]
        fixed = [size - 1 - FIXED + p for p in range(FIXED) if pattern >> p & 1]
        own = np.array([*reached, *fixed, size - 1])
        rows.append(np.full(len(own), len(y)))
        cols.append(own)
        y.append(target)
        weight.append(by)

    for r in weak:
        add(r, r.p, r.n / shares[0 if r.p >= 0.5 else 1], r.pattern)
    n_weak = len(y)
    for r, pattern, by in sorted(zip(gold, own.tolist(), gold_weight.tolist()), key=lambda x: (x[1], x[0].toxic, x[0].features, x[0].levels)):
        add(r, float(r.toxic), by, pattern)
    weight = np.array(weight, float)
    # either half counts as much, whatever its number of texts
    for some in (slice(0, n_weak), slice(n_weak, None)):
        total = weight[some].sum()
        if total:
            weight[some] *= 10_000 / total
    if not rows:
        return Model(features, np.zeros(size), voters, labels)
    w = _newton(np.concatenate(rows), np.concatenate(cols), np.array(y), weight, size, 0.3)
    return Model(features, w, voters, labels)


def scored(documents: DataFrame, model: Model | None, text: str = "text", score: str = "score") -> DataFrame:
    """Adds the score of every whole text: 0 to 1, higher where a toxic text is likelier.

    Null and empty texts have the score of a text without any feature; without a model every score is 0. Equal texts have equal
    scores. Other columns pass through, one named as the score is replaced; an empty table gives an empty result. Very long
    texts are held one batch at a time.
    """
    if model is None:
        return documents.withColumn(score, F.lit(0.0))
    table = documents.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        marks = Marks(table.value.features)
        for batch in batches:
            yield pa.array(table.value.scores(batch.to_pylist(), marks), pa.float64())

    (name,) = fresh(documents, "found")
    return documents.withColumn(name, score_of(F.col(text))).withColumn(score, F.col(name)).drop(name)
