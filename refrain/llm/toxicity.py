"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features of a text (FEATURES) are densities of a lexicon's words in plain
and in disguised spelling (digits and signs for letters, signs or spaces
between letters, drawn-out letters), how many of them stand within five words
of a second person, shares of capitals, punctuation rates, and rates of the
disguises themselves. The lexicon is a short built-in list together with words
mined from labelled texts: words far more frequent in toxic than in other ones,
each seen between several different neighbours, as words of copies aren't.

The fit reads a bounded sample: at most ``max_labelled`` labelled rows, half of
each class, those with the least hash of id. Half of them serve the mining,
three tenths the trees, two tenths the calibration. What is broadcast is the
lexicon's hashes and the trees, bounded by the sample. Scoring is one pass
without a shuffle over whole texts.

Defined results: null, empty and blank texts have probability 0. Without
labelled rows of both classes in a part of the sample, the probability is 1
where a lexicon word occurs, else 0. Rows are scored one by one: repeated rows
get equal probabilities, ids may be null, other columns pass through. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytekit as B
from .common import col, cut, fresh, pieces
from .quality import labelled_texts

MAX_LABELLED = 10_000
THRESHOLD = 0.5
#: Different pairs of neighbours that a mined word must have in toxic texts, also as a share (VARIETY) of its occurrences
#: there, since words of copied texts and passages always have the same, and as a share (SHARE) of the toxic texts. And how much likelier it must be in toxic texts.
SUPPORT = 3
VARIETY = 0.3
SHARE = 0.01
ODDS = 20.0
REACH = 5
FEATURES = (
    "log_words", "lexicon_density", "lexicon_hits", "lexicon_kinds", "disguised_density", "disguised_hits", "second_person_density", "hits_near_second_person",
    "capitals", "shouted_words", "exclamations", "questions", "punctuation", "signs_in_words", "digits_in_words", "drawn_out_letters", "spaced_letters",
)
LEXICON = (
    "asshole bastard bitch clown crap cretin cunt damn disgusting dumb dumbass fool freak fuck fucking garbage hate idiot idiotic idiots imbecile jerk kill loser losers lunatic moron moronic morons pathetic pig "
    "pig retard retarded scum scumbag shit shitty shut slut stupid sucker trash ugly vermin whore worthless "
    "abschaum arsch arschloch bastard blödmann depp dreck dumm dummkopf drecksau fotze hure idiotin miststück missgeburt scheisse scheiße schlampe schwachkopf schwein trottel vollidiot wichser "
    "abruti connard connasse crétin débile dégueulasse enculé idiote imbécile merde minable ordure pourriture putain pute salaud salope "
    "basura cabrón capullo estúpido estúpida gilipollas idiota imbécil mierda puta puto tonto zorra"
).split()
SECOND_PERSON = (
    "you your yours yourself yourselves u ur ya thou thee thy du dich dir dein deine deinem deinen deiner euch euer eure tu te toi tes ton vous votre vos tú ti tus usted ustedes vosotros vosotras contigo vuestro"
).split()

_GAP = B.SPACE.copy()
_GAP[33:48] = _GAP[58:65] = _GAP[91:97] = _GAP[123:127] = True
_PUNCT = _GAP & ~B.SPACE
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LEET = np.zeros(256, np.uint8)
for _a, _b in zip("0134578@$!|+", "oieastbasilt"):
    _LEET[ord(_a)] = ord(_b)


def hashes(words: list[str] | tuple[str, ...]) -> np.ndarray:
    data, offs = B.flat(pa.array(sorted(set(words))))
    return np.sort(B.spans(data, offs[:-1], offs[1:]))


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _per(at: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(at, weights=weight, minlength=n).astype(np.float64)


@dataclass
class _Plain:
    """Words of a block of texts, and what their disguises hide."""

    words: np.ndarray
    row: np.ndarray
    size: np.ndarray
    clear: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    clear_row: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def _undisguised(low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text with signs for letters read as letters, signs inside words, drawn-out letters and spaces between single letters taken out."""
    n = len(low)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    before[1:], after[:-1] = low[:-1], low[1:]
    word = _LETTER | _DIGIT
    out = low.copy()
    digit = _DIGIT[low] & (_LEET[low] > 0) & (_LETTER[before] | _LETTER[after])
    sign = _PUNCT[low] & (_LEET[low] > 0) & word[after] & ~_PUNCT[before]
    read = digit | sign
    out[read] = _LEET[low[read]]
    keep = ~_PUNCT[out]
    # runs of three and more of one letter are one
    change = np.concatenate(([True], out[1:] != out[:-1]))
    begin = np.flatnonzero(change)
    length = np.diff(np.append(begin, n))
    long = np.repeat(length >= 3, length) & _LETTER[out] & (out < 128)
    keep &= ~long | change
    # three and more single letters in a row are one word
    starts, ends, row = B.tokens(out, offs)
    single = (ends - starts == 1) & _LETTER[out[starts]] if len(starts) else np.zeros(0, bool)
    link = single[1:] & single[:-1] & (row[1:] == row[:-1])
    if link.any():
        a, b = np.flatnonzero(np.diff(np.concatenate(([0], link.astype(np.int8), [0])))).reshape(-1, 2).T
        a, b = a[b - a >= 2], b[b - a >= 2]
        inside = np.zeros(n + 1, np.int32)
        inside[starts[a] + 1] += 1
        inside[starts[b]] -= 1
        keep &= (np.cumsum(inside)[:-1] == 0) | ~B.SPACE[out]
    kept = np.concatenate(([0], np.cumsum(keep)))
    return out[keep], kept[offs], starts


def _read(data: np.ndarray, low: np.ndarray, offs: np.ndarray) -> _Plain:
    starts, ends, row = B.tokens(low, offs, _GAP)
    clear, at, _ = _undisguised(low, offs)
    s, e, r = B.tokens(clear, at)
    return _Plain(B.spans(low, starts, ends), row, ends - starts, B.spans(clear, s, e), r)


def features(data: np.ndarray, offs: np.ndarray, lexicon: np.ndarray, person: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    n = len(offs) - 1
    if not len(data):
        return np.zeros((n, len(FEATURES)))
    low = B.lower(data)
    t = _read(data, low, offs)
    words = np.maximum(_per(t.row, n), 1)
    size = np.maximum(np.diff(offs), 1).astype(float)
    hit = _member(t.words, lexicon)
    hits = _per(t.row[hit], n)
    pairs = np.unique(np.stack((t.row[hit].astype(np.uint64), t.words[hit])), axis=1)
    kinds = _per(pairs[0].astype(np.int64), n)
    disguised = np.maximum(0, _per(t.clear_row[_member(t.clear, lexicon)], n) - hits)
    second = _member(t.words, person)
    # second persons up to each word; a hit's reach ends with its text
    upto = np.concatenate(([0], np.cumsum(second)))
    edge = np.searchsorted(t.row, np.arange(n + 1))
    index = np.arange(len(t.row))
    near = hit & (upto[np.minimum(index + REACH + 1, edge[t.row + 1])] > upto[np.maximum(index - REACH, edge[t.row])])
    at = np.repeat(np.arange(n), np.diff(offs))
    before, after = np.zeros(len(low), np.uint8), np.zeros(len(low), np.uint8)
    before[1:], after[:-1] = low[:-1], low[1:]
    upper = _UPPER[data]
    letters = np.maximum(_per(at[_LETTER[low]], n), 1)
    starts, ends, row = B.tokens(data, offs, _GAP)
    caps = np.concatenate(([0], np.cumsum(upper)))
    shouted = (ends - starts > 2) & (caps[ends] - caps[starts] == ends - starts)
    inner = _PUNCT[low] & _LETTER[before] & _LETTER[after]
    digit = _DIGIT[low] & (_LETTER[before] | _LETTER[after])
    drawn = np.zeros(len(low), bool)
    drawn[2:] = (low[2:] == low[1:-1]) & (low[2:] == low[:-2]) & _LETTER[low[2:]] & (low[2:] < 128)
    single = (t.size == 1)
    spaced = np.zeros(len(single), bool)
    if len(single) > 2:
        spaced[2:] = single[2:] & single[1:-1] & single[:-2] & (t.row[2:] == t.row[:-2])
    out = np.stack((
        np.log(words), hits / words, hits, kinds, disguised / words, disguised, _per(t.row[second], n) / words, _per(t.row[near], n),
        _per(at[upper], n) / letters, _per(row[shouted], n) / words, _per(at[data == 33], n) / size, _per(at[data == 63], n) / size, _per(at[_PUNCT[low]], n) / size,
        _per(at[inner], n) / words, _per(at[digit], n) / words, _per(at[drawn], n) / words, _per(t.row[spaced], n) / words,
    ), axis=1)
    out[_per(t.row, n) == 0] = 0
    return out


@dataclass
class Trees:
    """Boosted trees of equal depth in heap order, for the log odds."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss on binned features; a split must leave Hessian weight on both sides."""
    n, m = x.shape
    cuts = [np.unique(np.concatenate((np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]), [(x[:, j].min() + x[:, j][x[:, j] > x[:, j].min()].min(initial=x[:, j].max())) / 2]))) for j in range(m)]
    width = max(len(c) for c in cuts) + 1
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    odds = np.full(n, base)
    inner = 2**depth - 1
    features_, cuts_, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        q = 1 / (1 + np.exp(-odds))
        g, h = y - q, q * (1 - q)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            local = node - first
            best = np.zeros(many)
            for j in range(m):
                at = local * width + binned[:, j]
                gs = np.bincount(at, g, many * width).reshape(many, width).cumsum(1)
                hs = np.bincount(at, h, many * width).reshape(many, width).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < least) | (ht - hs < least)] = 0
                gain = gain[:, : len(cuts[j])]
                k = gain.argmax(1)
                top = gain[np.arange(many), k]
                for i in np.flatnonzero(top > best + 1e-9):
                    best[i], features_[t, first + i], cuts_[t, first + i] = top[i], j, cuts[j][k[i]]
            node = 2 * node + 1 + (x[np.arange(n), features_[t, node]] > cuts_[t, node])
        local = node - inner
        leaves[t] = rate * np.bincount(local, g, inner + 1) / (np.bincount(local, h, inner + 1) + 1)
        odds += leaves[t][local]
    return Trees(base, features_, cuts_, leaves)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: the nondecreasing steps of the mean of y by score, as points to interpolate between."""
    value, at = np.unique(score, return_inverse=True)
    blocks: list[list[float]] = []  # mean, weight, from, to
    for v, s, w in zip(value, np.bincount(at, y), np.bincount(at)):
        blocks.append([s / w, w, v, v])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w2, _, hi = blocks.pop()
            a = blocks[-1]
            a[0], a[1], a[3] = (a[0] * a[1] + m * w2) / (a[1] + w2), a[1] + w2, hi
    xs = np.array([e for b in blocks for e in ((b[2], b[3]) if b[2] < b[3] else (b[2],))])
    ys = np.array([e for b in blocks for e in ((b[0], b[0]) if b[2] < b[3] else (b[0],))])
    return xs, ys


@dataclass
class Model:
    lexicon: np.ndarray
    person: np.ndarray
    trees: Trees | None = None
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def probability(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        x = features(data, offs, self.lexicon, self.person)
        if self.trees is None or self.steps is None:
            p = (x[:, 2] + x[:, 5] > 0).astype(float)
        else:
            p = np.interp(self.trees.odds(x), *self.steps)
        return np.where(np.isin(np.arange(len(x)), np.flatnonzero(np.diff(offs) > 0)) & (x.any(axis=1)), p, 0.0)


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, label, sign, first): words of a toxic text, once for each pair of words around them, and of another text once."""
    for batch in batches:
        for piece in pieces(batch, 2):
            data, offs = B.flat(piece.column(2))
            if not len(data):
                continue
            low = B.lower(data)
            t = _read(data, low, offs)
            before, after = np.zeros(len(t.words), np.uint64), np.zeros(len(t.words), np.uint64)
            before[1:], after[:-1] = t.words[:-1], t.words[1:]
            label = piece.column(1).to_numpy()
            sign = np.where(label[t.row] == 1, B.mix(before * np.uint64(3) + after), np.uint64(0))
            rows = np.unique(np.stack((t.row.astype(np.uint64), t.words, sign)), axis=1)
            first = np.ones(rows.shape[1], np.int32)
            first[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(rows[1].view(np.int64)), pa.array(label[rows[0].astype(np.int64)].astype(np.int32)), pa.array(rows[2].view(np.int64)), pa.array(first)], ["word", "label", "sign", "first"])


def _featured(lexicon: np.ndarray, person: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 2):
                x = features(*B.flat(piece.column(2)), lexicon, person)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["part", "label", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, support: int = SUPPORT, odds: float = ODDS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of a bounded sample of labelled rows."""
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("doc_id")), F.lit(10)).cast("int")
    sample = cut(labelled_texts(docs, labels, "toxic", max_labelled, id_col, text_col).select(part.alias("part"), "label", "text"))
    mining = sample.where("part < 5")
    by = {r[0]: r[1] for r in mining.groupBy("label").count().collect()}
    toxic, other = by.get(1, 0), by.get(0, 0)
    found = np.zeros(0, np.uint64)
    if toxic and other:
        one = F.col("label") == 1
        counts = mining.mapInArrow(_vocabulary, "word long, label int, sign long, first int").groupBy("word").agg(
            F.sum(F.col("label") * F.col("first")).alias("t"), F.sum((1 - F.col("label")) * F.col("first")).alias("n"), F.countDistinct(F.when(one, F.col("sign"))).alias("signs")
        ).withColumn("signs", F.least("signs", "t"))
        ratio = ((F.col("signs") + 0.5) / (toxic + 1)) / ((F.col("n") + 0.5) / (other + 1))
        words = counts.where((F.col("signs") >= max(support, SHARE * toxic)) & (F.col("signs") >= VARIETY * F.col("t")) & (ratio >= odds)).select("word").collect()
        found = np.array([w[0] for w in words], np.int64).view(np.uint64)
    lexicon = np.unique(np.concatenate((hashes(LEXICON), found)))
    person = hashes(SECOND_PERSON)
    model = Model(lexicon, person)
    rows = sample.where("part >= 5").mapInArrow(_featured(lexicon, person), "part int, label int, x binary").toPandas().sort_values(["part", "label", "x"])
    x = np.array([np.frombuffer(v, float) for v in rows.x]).reshape(-1, len(FEATURES))
    y, later = rows.label.to_numpy(float), rows.part.to_numpy() >= 8
    if len(np.unique(y[~later])) < 2 or len(np.unique(y[later])) < 2:
        return model
    model.trees = boost(x[~later], y[~later])
    model.steps = isotonic(model.trees.odds(x[later]), y[later])
    return model


def scored(text: Column, model: Model) -> Column:
    """The calibrated probability of a text as a column."""

    @F.arrow_udf("double")
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([texts], ["t"])
            parts = [model.probability(*B.flat(p.column(0))) for p in pieces(batch, 0, 1 << 20)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return probability(text)


def classify(docs: DataFrame, labels: DataFrame, training_docs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, toxicity, toxic) for each row of docs."""
    model = fit(training_docs if training_docs is not None else docs, labels, max_labelled, id_col=id_col, text_col=text_col)
    out = docs.select(col(docs, id_col).cast("long").alias("doc_id"), scored(col(docs, text_col), model).alias("toxicity"))
    return out.withColumn("toxic", F.col("toxicity") >= threshold)


def keep_clean(docs: DataFrame, labels: DataFrame, training_docs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """docs without the rows at or above the threshold, all columns as they were."""
    model = fit(training_docs if training_docs is not None else docs, labels, max_labelled, id_col=id_col, text_col=text_col)
    score = fresh(docs, "toxicity")
    return docs.withColumn(score, scored(col(docs, text_col), model)).where(F.col(score) < threshold).drop(score)
