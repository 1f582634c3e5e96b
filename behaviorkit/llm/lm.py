"""LM scoring by masked pseudo-likelihood.

A small window network predicts every character from the two before and the two after it: one
embedding per context position is added up, passed through tanh and turned into a softmax over the
alphabet.  A document's score is the sum of the conditional log-probabilities of all its characters.
Characters beyond the alphabet share one id; each of them has the probability of that id times its own
share of all such characters, so that no two characters are alike and the probabilities add up to 1.

The alphabet and the training set cover all texts: Spark counts every code point and every distinct
five-character window.  The window counts are the whole training set (equal windows are one row with
a weight).  Training is data-parallel: each of ``workers`` tasks takes minibatch steps in numpy over
its share of the windows, and the driver averages the networks of a round (``workers`` times 80 KB).
Scoring is row by row; each distinct window of a slice of texts goes through the network once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from behaviorkit.llm.common import slices, written

VOCABULARY = 128                 # ids of 7 bits: 0 beyond the text, 1 any other character, then the most frequent
EDGE, OTHER = 0, 1
SIDE = 2                         # context characters on each side
HIDDEN = 32
_OFFSETS = [k for k in range(-SIDE, SIDE + 1) if k]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def code_points_counted(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(code points, counts) of all texts, most frequent first (ties: smaller); bounded by the code space."""

    def count(batches):
        for b in batches:
            total = None
            for some in slices(b["_text"], 1 << 21):
                n = np.bincount(code_points("".join(some)), minlength=0x110000)
                total = n if total is None else total + n
            if total is not None:
                used = np.flatnonzero(total)
                yield pd.DataFrame({"cp": used.astype("int32"), "n": total[used]})

    seen = (docs.select(F.col(text).alias("_text")).where("_text <> ''").mapInPandas(count, "cp int, n long")
            .groupBy("cp").agg(F.sum("n").alias("n"))).toPandas()
    points, counts = seen["cp"].to_numpy(np.int64), seen["n"].to_numpy(np.int64)
    at = np.lexsort((points, -counts))
    return points[at], counts[at]


def alphabet(docs: DataFrame, text: str = "text") -> list[int]:
    """The most frequent code points of all texts, most frequent first (ties: smaller)."""
    return code_points_counted(docs, text)[0][:VOCABULARY - 2].tolist()


def rest_table(points: list[int], rest: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Log-share of each code point among those beyond the alphabet; 0 for the alphabet.

    ``rest`` has the code points beyond the alphabet and their counts; one more count is spread evenly
    over all code points beyond the alphabet, so that none has share 0.
    """
    found, counts = rest if rest is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    total = float(np.sum(counts)) + 1
    even = 1 / (0x110000 - len(points))
    table = np.full(0x110000, np.log(even / total), np.float32)
    table[found] = np.log((counts + even) / total)
    table[np.array(points, np.int64)] = 0
    return table


def id_table(points: list[int]) -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    table[np.array(points, np.int64)] = np.arange(2, 2 + len(points))
    return table


def windows(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Code of the window around every character of all texts: 7 bits for each of the five ids."""
    gap = np.zeros(SIDE, np.uint8)
    ids = np.concatenate([gap] + [x for t in texts for x in (table[code_points(t)], gap)])
    inside = ids != EDGE
    code = np.zeros(np.count_nonzero(inside), np.int64)
    for k in range(-SIDE, SIDE + 1):
        code <<= 7
        code |= np.roll(ids, -k)[inside]
    return code


def window_counts(docs: DataFrame, points: list[int], text: str = "text") -> DataFrame:
    """``(window, n)`` over all texts; each slice of texts is counted before the shuffle."""

    def count(batches):
        table = id_table(points)
        for b in batches:
            for some in slices(b["_text"], 1 << 20):
                number, distinct = pd.factorize(windows(some, table))
                yield pd.DataFrame({"window": distinct, "n": np.bincount(number, minlength=len(distinct)).astype("int64")})

    return (docs.select(F.col(text).alias("_text")).where("_text <> ''").mapInPandas(count, "window long, n long")
            .groupBy("window").agg(F.sum("n").alias("n")))


class Network:
    """Window network: ``context[k]`` embeds the character at one offset, ``out`` scores the centre."""

    def __init__(self, weights: np.ndarray | None = None, seed: int = 7):
        shapes = [(2 * SIDE, VOCABULARY, HIDDEN), (HIDDEN,), (HIDDEN, VOCABULARY), (VOCABULARY,)]
        sizes = [int(np.prod(s)) for s in shapes]
        if weights is None:
            weights = np.random.default_rng(seed).normal(0, 0.1, sum(sizes)).astype(np.float32)
        self.weights = weights
        cuts = np.cumsum(sizes)[:-1]
        self.context, self.bias, self.out, self.rest = (w.reshape(s) for w, s in zip(np.split(weights, cuts), shapes))

    @staticmethod
    def unpack(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the context, id of the centre) of window codes."""
        ids = code[:, None] >> (7 * np.arange(2 * SIDE, -1, -1)) & 127
        return np.delete(ids, SIDE, axis=1), ids[:, SIDE]

    def forward(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hidden values, log-probabilities); the edge is never predicted."""
        h = np.tanh(sum(self.context[k][context[:, k]] for k in range(2 * SIDE)) + self.bias)
        z = h @ self.out + self.rest
        z[:, EDGE] = -1e4
        z -= z.max(axis=1, keepdims=True)
        return h, z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def log_probability(self, code: np.ndarray, step: int = 8192) -> np.ndarray:
        out = np.empty(len(code))
        for s in range(0, len(code), step):
            context, centre = self.unpack(code[s:s + step])
            out[s:s + step] = self.forward(context)[1][np.arange(len(centre)), centre]
        return out

    def gradient(self, code: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of the mean cross-entropy over windows weighted by their counts."""
        context, centre = self.unpack(code)
        h, logp = self.forward(context)
        share = (n / n.sum()).astype(np.float32)[:, None]
        dz = np.exp(logp)
        dz[np.arange(len(centre)), centre] -= 1
        dz *= share
        dh = (dz @ self.out.T) * (1 - h * h)
        one_hot = np.zeros((len(code), VOCABULARY), np.float32)
        parts = []
        for k in range(2 * SIDE):
            one_hot[:] = 0
            one_hot[np.arange(len(code)), context[:, k]] = 1
            parts.append((one_hot.T @ dh).ravel())
        return np.concatenate(parts + [dh.sum(axis=0), (h.T @ dz).ravel(), dz.sum(axis=0)])


def train(counts: DataFrame, workers: int = 24, rounds: int = 6, batch: int = 512, rate: float = 0.01) -> np.ndarray:
    """Weights after ``rounds`` rounds of local Adam steps and averaging; ``counts`` is a stored table."""
    parted = written(counts.repartition(workers, "window"), "windows")
    weights = Network().weights
    for turn in range(rounds):
        start, lr = weights, rate * 0.6 ** turn

        def steps(batches):
            w = start.copy()
            m, v, k, seen = np.zeros_like(w), np.zeros_like(w), 0, 0
            for b in batches:
                code, n = b["window"].to_numpy(), b["n"].to_numpy()
                mixed = np.random.default_rng([turn, k]).permutation(len(code))
                for s in range(0, len(code), batch):
                    at = mixed[s:s + batch]
                    g = Network(w).gradient(code[at], n[at])
                    k += 1
                    m = 0.9 * m + 0.1 * g
                    v = 0.99 * v + 0.01 * g * g
                    w = (w - lr * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)).astype(np.float32)
                seen += int(n.sum())
            if seen:
                yield pd.DataFrame({"w": [w.tobytes()], "seen": [seen]})

        # one row for each of ``workers`` tasks
        rows = parted.mapInPandas(steps, "w binary, seen long").collect()
        if not rows:
            return weights
        total = sum(r["seen"] for r in rows)
        weights = sum(np.frombuffer(r["w"], np.float32) * np.float32(r["seen"] / total) for r in rows)
    return weights


def score(docs: DataFrame, weights: np.ndarray, points: list[int], text: str = "text",
          rest: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``docs`` plus ``n_tokens``, ``log_likelihood`` (sum over all characters) and ``mean_log_likelihood``.

    ``rest`` has the counts of the code points beyond the alphabet; without it they are equally likely.
    A null or empty text has 0 tokens, sum 0 and a null mean.  Row by row, no shuffle.
    """
    @F.pandas_udf("struct<n_tokens long, log_likelihood double>")
    def grade(texts: pd.Series) -> pd.DataFrame:
        table, net, own = id_table(points), Network(weights), None
        sums = []
        for some in slices((t or "" for t in texts), 1 << 20):
            lengths = np.array([len(t) for t in some], np.int64)
            number, distinct = pd.factorize(windows(some, table))
            each = net.log_probability(distinct)[number] if len(number) else np.zeros(0)
            beyond = np.flatnonzero((distinct >> 7 * SIDE & 127 == OTHER)[number]) if len(number) else number
            if len(beyond):
                own = rest_table(points, rest) if own is None else own
                each[beyond] += own[code_points("".join(some))[beyond]]
            each = np.concatenate(([0.0], np.cumsum(each)))
            ends = np.cumsum(lengths)
            sums.extend(zip(lengths.tolist(), (each[ends] - each[ends - lengths]).tolist()))
        return pd.DataFrame(sums, columns=["n_tokens", "log_likelihood"])

    return (docs.withColumn("_lm", grade(F.col(text)))
            .withColumns({"n_tokens": F.col("_lm.n_tokens"), "log_likelihood": F.col("_lm.log_likelihood"),
                          "mean_log_likelihood": F.try_divide(F.col("_lm.log_likelihood"), F.col("_lm.n_tokens"))}).drop("_lm"))


def pseudo_likelihood(docs: DataFrame, text: str = "text", key: str = "doc_id", workers: int = 24, rounds: int = 6) -> DataFrame:
    """Train on ``docs`` and score every row: key, n_tokens, log_likelihood, mean_log_likelihood.

    Null keys and repeated rows are scored like any other; an empty table gives an empty result;
    other columns are ignored.
    """
    src = docs.select(F.col(key), F.col(text))
    found, counts = code_points_counted(src, text)
    points = found[:VOCABULARY - 2].tolist()
    rest = found[VOCABULARY - 2:], counts[VOCABULARY - 2:]
    weights = train(window_counts(src, points, text), workers, rounds)
    return score(src, weights, points, text, rest).select(key, "n_tokens", "log_likelihood", "mean_log_likelihood")
