"""Quality classifier: a linear-chain conditional random field over lines.

Each line of a text that has a word is labelled good or bad. A line's score sums
its own surface features and some of its neighbours'; transition weights tie
adjacent labels. Forward-backward gives each line's marginal, and the document's
quality is their mean weighted by the lines' lengths in bytes.

Training finds line labels between the documents' (see ``ChainCRF.fit``), on a
bounded sample: at most ``FIT_DOCUMENTS`` labelled documents, those smallest by
hash among the rows that are not held out. Only that many ids are broadcast, and
only the features of at most ``FIT_LINES`` lines around the middle of each reach the driver;
scores read all lines. Scoring reads every whole text in one pass
without a shuffle.

Defined cases. Null, empty or blank text: no line, score 0. Texts of one line have
no transitions. Without labels of both kinds all weights are zero and a text with
words scores 0.5. Repeated labels of a document: the largest counts; of texts that
share an id, training takes the smallest. Null labels and ids aren't trained on. Very
long texts are scored whole, in memory of their length. Empty table: empty result. Ids
are of any type. Labels, language, source and id are never features; ``keep_good``
returns all columns unchanged, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import sliced

FIT_DOCUMENTS = 3000
FIT_LINES = 400
SURE = 3.0  # log odds from which a line is held to be of the other label than its document
HELD_OUT = 5
THRESHOLD = 0.3

_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_SYMBOL = b"#*$%&|<>"
_POINT = b".,;:"
_LETTERISH = bytes(b for b in range(128) if not chr(b).isalpha())
# Frequent function words of four languages.
_STOP = frozenset(
    w.encode() for w in (
        "the of and to in is that for with was be it on as at by are this or from "
        "le la les de des du et un une que qui pour dans en au par avec elle "
        "der die das den und zu von mit ist ein eine nicht für auf im sich "
        "el los las del se por con una no es su más como"
    ).split()
)

OWN = ("chars", "words", "symbols", "upper", "bangs", "bars", "digits", "word_len", "stop", "points", "repeats", "again")
#: Features that a line also takes from the one before and the one after.
SHARED = (2, 3, 4, 8)
NEIGHBOURS = slice(len(OWN), len(OWN) + 2 * len(SHARED))
WIDTH = len(OWN) + 2 * len(SHARED) + 3


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x WIDTH features, lengths) of the lines with a word."""
    own, lengths, seen = [], [], set()
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        if not words:
            continue
        n, k = len(line), len(words)
        letters = len(line.translate(None, _LETTERISH)) or 1
        own.append((
            math.log1p(n), math.log1p(k), (n - len(line.translate(None, _SYMBOL))) / k,
            (n - len(line.translate(None, _UPPER))) / letters, line.count(b"!") / k, line.count(b"|") / k,
            (n - len(line.translate(None, _DIGIT))) / n, min(n / k, 40.0), sum(map(_STOP.__contains__, words)) / k,
            (n - len(line.translate(None, _POINT))) / k, 1.0 - len(set(words)) / k, float(line in seen),
        ))
        seen.add(line)
        lengths.append(n)
    if not own:
        return np.zeros((0, WIDTH)), np.zeros(0)
    base = np.array(own)
    shared = base[:, SHARED]
    edge = np.zeros((1, len(SHARED)))
    ends = np.zeros((len(base), 2))
    ends[0, 0] = ends[-1, 1] = 1.0
    x = np.hstack([base, np.vstack([edge, shared[:-1]]), np.vstack([shared[1:], edge]), ends, np.ones((len(base), 1))])
    return x, np.array(lengths, dtype=float)


class ChainCRF:
    """Two labels (0 bad, 1 good); emission weights and a 2 x 2 transition table."""

    def __init__(self, mean=None, scale=None, weights=None, transitions=None):
        self.mean = np.zeros(WIDTH) if mean is None else mean
        self.scale = np.ones(WIDTH) if scale is None else scale
        self.weights = np.zeros(WIDTH) if weights is None else weights
        self.transitions = np.zeros((2, 2)) if transitions is None else transitions

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def marginals(self, x: np.ndarray) -> list[float]:
        """P(good) of each line by scaled forward-backward."""
        odds = np.exp(np.clip(self.emissions(x), -30.0, 30.0)).tolist()
        (bb, bg), (gb, gg) = np.exp(self.transitions).tolist()
        forward, b, g = [], 1.0, 1.0
        for t, o in enumerate(odds):
            nb, ng = (1.0, o) if t == 0 else (b * bb + g * gb, (b * bg + g * gg) * o)
            b, g = nb / (nb + ng), ng / (nb + ng)
            forward.append((b, g))
        out, b, g = [0.0] * len(odds), 1.0, 1.0
        for t in range(len(odds) - 1, -1, -1):
            fb, fg = forward[t]
            out[t] = fg * g / (fb * b + fg * g)
            nb, ng = b * bb + g * odds[t] * bg, b * gb + g * odds[t] * gg
            b, g = nb / (nb + ng), ng / (nb + ng)
        return out

    def score(self, text: str | None) -> float:
        x, lengths = line_features(text)
        if not len(x):
            return 0.0
        return min(1.0, max(0.0, float(np.dot(self.marginals(x), lengths) / lengths.sum())))

    @classmethod
    def fit(cls, chains: list[np.ndarray], labels: list[int], steps: int = 150, l2: float = 1.0, rate: float = 0.1) -> ChainCRF:
        """From document labels: line labels are latent and found in between.

        A first fit, without transitions and neighbours' features, gives every line its
        document's label and learns what single lines look like. A line that it holds to be of the other label gets that
        one; each document keeps its own label on the line that fits it best. The chain is
        then fitted to these line labels, so it sees changes of label inside documents.
        """
        kept = [(x, int(y)) for x, y in zip(chains, labels, strict=True) if len(x)]
        if len({y for _, y in kept}) < 2:
            return cls()
        chains, labels = [x for x, _ in kept], [y for _, y in kept]
        alone = cls.fit_lines(chains, [np.full(len(x), float(y)) for x, y in kept], labels, steps, l2, rate, chained=False)
        lines = []
        for x, y in kept:
            odds = alone.emissions(x)
            own = (odds > (-SURE if y else SURE)).astype(float)
            own[np.argmax(odds if y else -odds)] = y
            lines.append(own)
        return cls.fit_lines(chains, lines, labels, steps, l2, rate)

    @classmethod
    def fit_lines(cls, chains: list[np.ndarray], lines: list[np.ndarray], labels: list[int], steps: int = 150, l2: float = 1.0, rate: float = 0.1, chained: bool = True) -> ChainCRF:
        """Maximum likelihood of line labels by Adam; documents of both labels weigh the same."""
        order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
        problem = Likelihood([chains[i] for i in order], [lines[i] for i in order], np.array([labels[i] for i in order], dtype=float), l2)
        theta, m1, m2 = np.zeros(problem.size), 0.0, 0.0
        for step in range(1, steps + 1):
            grad = problem.gradient(theta)
            if not chained:
                grad[-4:] = 0.0
                grad[NEIGHBOURS] = 0.0
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
            theta = theta + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        return cls(problem.mean, problem.scale, theta[:-4], theta[-4:].reshape(2, 2))


class Likelihood:
    """The mean log-likelihood of labelled chains, longest first, with an l2 penalty."""

    def __init__(self, chains: list[np.ndarray], lines: list[np.ndarray], labels: np.ndarray, l2: float):
        self.l2 = l2
        self.sizes = sizes = np.array([len(x) for x in chains])
        self.starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        x, self.y = np.vstack(chains), np.concatenate(lines)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0)
        self.mean[-1], self.scale[-1] = 0.0, 1.0
        self.scale[self.scale < 1e-9] = 1.0
        self.z = (x - self.mean) / self.scale
        # both labels weigh the same, by lines, so that the score is not the classes' ratio
        share = float(np.repeat(labels, sizes).mean())
        self.weight = np.where(labels > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
        self.of_line = np.repeat(self.weight, sizes)
        self.active = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(int(sizes[0]))]
        self.true_t = np.zeros((2, 2))
        for y, c in zip(lines, self.weight, strict=True):
            at = y.astype(int)
            np.add.at(self.true_t, (at[:-1], at[1:]), c)
        self.size = self.z.shape[1] + 4

    def _forward(self, e: np.ndarray, t2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = np.zeros((len(e), 2))
        for t, n in enumerate(self.active):
            at = self.starts[:n] + t
            if t:
                p = f[at - 1]
                f[at] = np.logaddexp(p[:, :1] + t2[0], p[:, 1:] + t2[1])
            f[at, 1] += e[at]
        last = self.starts + self.sizes - 1
        return f, np.logaddexp(f[last, 0], f[last, 1])

    def value(self, theta: np.ndarray) -> float:
        e, t2 = self.z @ theta[:-4], theta[-4:].reshape(2, 2)
        told = (self.of_line * self.y * e).sum() + (self.true_t * t2).sum()
        return float(told - (self.weight * self._forward(e, t2)[1]).sum() - 0.5 * self.l2 * (theta**2).sum()) / len(self.sizes)

    def gradient(self, theta: np.ndarray) -> np.ndarray:
        """Exact: what was seen less what forward-backward expects."""
        e, t2 = self.z @ theta[:-4], theta[-4:].reshape(2, 2)
        f, norm = self._forward(e, t2)
        b, pair = np.zeros_like(f), np.zeros((2, 2))
        for t in range(len(self.active) - 1, 0, -1):
            n = self.active[t]
            at = self.starts[:n] + t
            nxt = b[at].copy()
            nxt[:, 1] += e[at]
            b[at - 1] = np.logaddexp(nxt[:, :1] + t2[:, 0], nxt[:, 1:] + t2[:, 1])
            for i in (0, 1):
                for j in (0, 1):
                    pair[i, j] += (self.weight[:n] * np.exp(f[at - 1, i] + t2[i, j] + nxt[:, j] - norm[:n])).sum()
        good = np.exp(f[:, 1] + b[:, 1] - np.repeat(norm, self.sizes))
        grad = np.concatenate([self.z.T @ (self.of_line * (self.y - good)), (self.true_t - pair).ravel()]) - self.l2 * theta
        return grad / len(self.sizes)


def middle(x: np.ndarray, rows: int = FIT_LINES) -> np.ndarray:
    """At most so many rows, in a run around the middle."""
    at = max(0, (len(x) - rows) // 2)
    return x[at:at + rows]


def is_held_out(key):
    return F.coalesce(F.crc32(key.cast("string")) % HELD_OUT == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCUMENTS) -> ChainCRF:
    """Fit on at most limit labelled documents that are not held out."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [middle(line_features(t.as_py())[0]).astype("<f8").tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["doc_id", "quality", "x"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    found = texts.mapInArrow(run, f"doc_id {kind}, quality int, x binary").collect()
    found.sort(key=lambda r: r.doc_id)
    chains = [np.frombuffer(bytes(r.x), "<f8").reshape(-1, WIDTH) for r in found]
    return ChainCRF.fit(chains, [r.quality for r in found])


def score(docs: DataFrame, model: ChainCRF, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, score) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [model.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    source = docs.select(F.col(key).alias("doc_id"), F.col(text))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: ChainCRF, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs whose text scores the threshold or more, with all their columns."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield batch.filter(pa.array([model.score(t.as_py()) >= threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
