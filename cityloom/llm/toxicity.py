"""Toxicity by compression distance: two zstandard dictionaries, one trained on ordinary and one on toxic text.

Every text is cut into windows of whole words; each window is compressed with the ordinary dictionary and with both dictionaries
at once, and the difference of the two lengths is what the toxic dictionary adds. (Compressed with the toxic dictionary alone, the
ordinary words of a window drown that difference; the README has figures.) A toxic text is mostly ordinary, so the toxic dictionary
is trained in rounds on the windows that dictionaries of other toxic texts shorten more than they do ordinary windows; what
these have in common, whole words or parts of ever-different ones, is what zstandard's training keeps. Thresholds on the differences
are calibrated on labelled texts that none of the dictionaries used for them has seen, by a small logistic model over how many
windows reach each difference.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityloom.llm.common import bounded_sample

WINDOW, LEVEL = 48, 6
STEPS = np.array([1, 2, 3, 4, 5, 6, 8, 10, 13])
#: Bytes that a dictionary is given at least.
LEAST = 512
#: Bytes that a trained dictionary's header takes at most.
HEADER = 256
#: Share of ordinary windows whose difference a window must exceed to be chosen.
SPARE = 0.005


def word_windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """All words of a text in order, packed into windows of at least size bytes; very long words are cut. No words: none."""
    out, now = [], b""
    for word in (text or "").encode().split():
        for a in range(0, len(word), 4 * size):
            now += b" " + word[a : a + 4 * size]
        if len(now) >= size:
            out.append(now + b" ")
            now = b""
    if now:
        out.append(now + b" ")
    return out


def _compressor(raw: bytes):
    known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=4, window_log=18, write_content_size=False, write_dict_id=False)
    known.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=how)


def _trained(size: int, samples: list[bytes], k: int) -> bytes:
    """Dictionary content; where there is too little to train on, the samples themselves.

    The trainer lays out what it picks first, from the first samples, at the end, and then cuts the end to make room for its header of
    up to HEADER bytes. Random bytes in front of the samples are what it picks first here, so that they are what is cut.
    """
    room = size + HEADER
    spare = np.random.default_rng(7).bytes(max(len(samples), 1) + sum(map(len, samples)) * 3 * HEADER // (2 * room))
    try:
        return zstandard.train_dictionary(room, [spare[i : i + WINDOW] for i in range(0, len(spare), WINDOW)] + samples, k=k, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


class CompressionClassifier:
    """Both dictionaries and the calibrated weights; compressors are made in each worker on first use."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic
        self.weights, self.offset = np.zeros(2 * len(STEPS) + 1), 0.0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_pair"}

    def pair(self):
        if "_pair" not in self.__dict__:
            self._pair = _compressor(self.ordinary).compress, _compressor(self.toxic + self.ordinary).compress
        return self._pair

    def differences(self, parts: list[bytes]) -> np.ndarray:
        plain, toxic = self.pair()
        return np.array([len(plain(w)) - len(toxic(w)) for w in parts], np.int32)

    def features(self, text: str | None) -> np.ndarray:
        d = self.differences(word_windows(text))
        over = (d[:, None] >= STEPS).sum(axis=0) if len(d) else np.zeros(len(STEPS))
        return np.concatenate([np.log1p(over), 30 * over / (len(d) + 20), [np.log1p(len(d)) / 4]])

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-(self.features(text) @ self.weights + self.offset))))

    def calibrate(self, x: np.ndarray, labels: np.ndarray, weight: np.ndarray, rounds: int = 60, ridge: float = 1.0) -> CompressionClassifier:
        """Logistic regression on rows of features by Newton steps."""
        x = np.hstack([x, np.ones((len(x), 1))])
        w = np.zeros(x.shape[1])
        keep = ridge * np.eye(len(w))
        keep[-1, -1] = 1e-6
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + keep, x.T @ (weight * (labels - p)) - keep @ w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights, self.offset = w[:-1], float(w[-1])
        return self


def fit(ordinary: list[str], toxic: list[str], ordinary_bytes: int = 110_000, rounds: tuple[int, ...] = (8192, 4096, 2048, 1024), folds: int = 4) -> tuple[CompressionClassifier, np.ndarray, np.ndarray]:
    """Train both dictionaries; returns them uncalibrated, with features of ordinary and of toxic texts that no dictionary used for them has seen.

    A third of the ordinary texts is held back from the ordinary dictionary. Toxic texts are dealt into folds; each round trains, for
    every fold, a toxic dictionary of at most that round's size on the chosen windows of the other folds, and chooses the fold's windows that
    it shortens by more than all but SPARE of the windows held back. The windows chosen last train the dictionary that stays.
    """
    order = np.random.default_rng(11).permutation(len(ordinary))
    third = max(1, len(order) // 3)
    common = _trained(ordinary_bytes, [w for i in order[third:] for w in word_windows(ordinary[i])] or [b" "], 16)
    held = [w for i in order[:third] for w in word_windows(ordinary[i])] or [b" "]
    parts = [(i % folds, w) for i, t in enumerate(toxic) for w in word_windows(t)]
    fold, text = np.array([f for f, _ in parts], int), [w for _, w in parts]

    def trained(mask: np.ndarray, size: int, segment: int) -> CompressionClassifier:
        """On the windows of mask, equal ones once; a dictionary takes a sixteenth of them at most."""
        own = list(dict.fromkeys(text[i] for i in np.flatnonzero(mask))) or [b" "]
        return CompressionClassifier(common, _trained(max(LEAST, min(size, sum(map(len, own)) // 16)), own, segment))

    chosen, plain = np.ones(len(parts), bool), CompressionClassifier(common, b"").pair()[0]
    plain_held, plain_text = np.array([len(plain(w)) for w in held]), np.array([len(plain(w)) for w in text], int)
    for turn, size in enumerate(rounds):
        gain, usual = np.zeros(len(parts)), np.zeros(len(held))
        for f in range(folds):
            both = trained(chosen & (fold != f), size, 12 if turn == 0 else 10).pair()[1]
            for i in np.flatnonzero(fold == f):
                gain[i] = plain_text[i] - len(both(text[i]))
            usual += plain_held - np.array([len(both(w)) for w in held])
        new = gain > np.quantile(usual / folds, 1 - SPARE)
        if not new.any():
            break
        chosen = new
    best = trained(chosen, rounds[-1], 8)
    apart = [trained(chosen & (fold != f), rounds[-1], 8) for f in range(folds)] if len(toxic) >= folds else [best] * folds
    return best, np.array([best.features(ordinary[i]) for i in order[:third]]), np.array([apart[i % folds].features(t) for i, t in enumerate(toxic)])


def calibrated(model: CompressionClassifier, ordinary: tuple[np.ndarray, float], toxic: tuple[np.ndarray, float], long_ordinary: np.ndarray, long_toxic: np.ndarray, toxic_share: float) -> CompressionClassifier:
    """model with weights from features of short texts, (features, texts that each row stands for), and of long ones."""
    x = [v[0] if isinstance(v, tuple) else v for v in (ordinary, long_ordinary, toxic, long_toxic)]
    stand = np.concatenate([np.full(len(x[0]), ordinary[1]), np.ones(len(x[1])), np.full(len(x[2]), toxic[1]), np.ones(len(x[3]))])
    labels = np.repeat([0.0, 0.0, 1.0, 1.0], [len(v) for v in x])
    rows = np.concatenate([v.reshape(-1, 2 * len(STEPS) + 1) for v in x])
    for y, share in ((0, 1 - toxic_share), (1, toxic_share)):
        stand[labels == y] *= share * len(rows) / stand[labels == y].sum()
    return model.calibrate(rows, labels, stand)


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", max_toxic: int = 1800, max_ordinary: int = 3600, max_chars: int = 20_000) -> CompressionClassifier:
    """Fit on a sample of labelled documents; where a class has no text, every score is that of the other class.

    Of the ids that labels gives each class, at most max_toxic and max_ordinary with the smallest hash are taken, then their
    texts are fetched. Of texts of more than max_chars characters only the features come, which are worked out where the texts
    are; those count in the calibration as the others do. So what is broadcast and what reaches the driver is bounded by these
    parameters. Null texts, labels and ids are left out.
    """
    known = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    size = 2 * len(STEPS) + 1

    def picked(y: int, n: int) -> DataFrame:
        ids = bounded_sample(known.where(F.col("y") == y), F.xxhash64("i"), n).select("i").distinct()
        return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("j"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(ids), F.col("i") == F.col("j")).select("j", "t")

    def short(rows: DataFrame, n: int) -> list[str]:
        return [r["t"] for r in rows.where(F.length("t") <= max_chars).orderBy(F.xxhash64("j"), "t").limit(n).collect()]

    both = picked(0, max_ordinary), picked(1, max_toxic)
    ordinary, toxic = short(both[0], max_ordinary), short(both[1], max_toxic)
    share = known.where(F.col("y").isin(0, 1)).agg(F.avg(F.col("y").cast("double"))).first()[0]
    if not ordinary or not toxic:
        none = CompressionClassifier(b" " * 16, b" " * 16)
        none.offset = -20.0 if not toxic else 20.0
        return none
    model, plain, bad = fit(ordinary, toxic)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def features(text: pa.Array) -> pa.Array:
        return pa.array([shared.value.features(t).tolist() for t in text.to_pylist()], pa.list_(pa.float64()))

    def long(rows: DataFrame, n: int) -> np.ndarray:
        found = rows.where(F.length("t") > max_chars).orderBy(F.xxhash64("j")).limit(n).select(features("t").alias("x")).collect()
        return np.array([r["x"] for r in found]).reshape(-1, size)

    return calibrated(model, (plain, len(ordinary) / len(plain)), (bad, 1.0), long(both[0], max_ordinary), long(both[1], max_toxic), min(0.95, max(0.05, share or 0.0)))


def score(df: DataFrame, model: CompressionClassifier, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """df with score_col in 0 to 1, of every whole text (null and empty texts: the score of no window).

    All windows of a text count, however long it is; repeated rows get equal scores, ties stay ties. A column named score_col is
    replaced; other columns stay. An empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def toxic(text: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(t) for t in text.to_pylist()], pa.float64())

    return df.withColumn(score_col, toxic(F.col(text_col).cast("string")))
