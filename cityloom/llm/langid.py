"""Language identification: a byte convolutional network over fixed-length windows of whole texts.

Bytes get a small learned vector; filters of several widths run over a window of bytes, each keeps its largest value in the
window (max pooling), a softmax layer turns these into languages. It is trained in numpy with Adam on the driver, from a
bounded, documented sample of labelled texts. A text is scored by all its windows: the mean of their log shares.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityloom.llm.common import bounded_sample

UNDETERMINED = "und"
WINDOW, WIDTHS, FILTERS, VECTOR = 256, (2, 3, 4, 5), 12, 8


def windows(data: bytes, size: int = WINDOW) -> np.ndarray:
    """All windows of a text, as rows of bytes; the last is filled with zero bytes."""
    n = max(1, -(-len(data) // size))
    out = np.zeros(n * size, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, size)


class ByteConvNet:
    """Weights of the network; ``forward`` and ``fit`` are plain numpy."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.reach = languages, max(WIDTHS)
        total = FILTERS * len(WIDTHS)
        self.mask = np.zeros((self.reach, VECTOR, total), np.float32)
        for k, w in enumerate(WIDTHS):
            self.mask[:w, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(-1, total)
        self.p = {
            "vector": rng.normal(0, 0.5, (256, VECTOR)).astype(np.float32),
            "filters": (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32),
            "bias": np.zeros(total, np.float32),
            "out": rng.normal(0, 0.1, (total, len(languages))).astype(np.float32),
            "prior": np.zeros(len(languages), np.float32),
        }

    def _columns(self, rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), rows.shape[1] + self.reach - 1, VECTOR), np.float32)
        x[:, : rows.shape[1]] = self.p["vector"][rows]
        at = np.lib.stride_tricks.sliding_window_view(x, self.reach, axis=1)  # (rows, places, VECTOR, reach)
        return np.ascontiguousarray(at.transpose(0, 1, 3, 2)).reshape(len(rows), rows.shape[1], -1)

    def forward(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """(log shares, hidden, places of the maxima, columns) of windows."""
        cols = self._columns(rows)
        value = (cols.reshape(-1, cols.shape[2]) @ self.p["filters"]).reshape(len(rows), rows.shape[1], -1)
        place = value.argmax(axis=1)
        top = np.take_along_axis(value, place[:, None], axis=1)[:, 0] + self.p["bias"]
        hidden = np.maximum(top, 0)
        z = hidden @ self.p["out"] + self.p["prior"]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True)), hidden, place, cols

    def log_shares(self, rows: np.ndarray, batch: int = 64) -> np.ndarray:
        """Log shares of the languages for each window, in bounded batches (the pooled maximum needs no places here)."""
        out = np.empty((len(rows), len(self.languages)), np.float32)
        for a in range(0, len(rows), batch):
            cols = self._columns(rows[a : a + batch])
            value = (cols.reshape(-1, cols.shape[2]) @ self.p["filters"]).reshape(len(cols), cols.shape[1], -1)
            z = np.maximum(value.max(axis=1) + self.p["bias"], 0) @ self.p["out"] + self.p["prior"]
            z -= z.max(axis=1, keepdims=True)
            out[a : a + batch] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out

    def fit(self, rows: np.ndarray, labels: np.ndarray, epochs: int = 3, batch: int = 64, rate: float = 0.004, seed: int = 7) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for a in range(0, len(order), batch):
                x, y = rows[order[a : a + batch]], labels[order[a : a + batch]]
                logs, hidden, place, cols = self.forward(x)
                n = len(x)
                d = np.exp(logs)
                d[np.arange(n), y] -= 1
                d /= n
                dh = (d @ self.p["out"].T) * (hidden > 0)
                patch = cols[np.arange(n)[:, None], place]  # (n, filters, reach * VECTOR)
                back = dh[:, :, None] * self.p["filters"].T[None]
                dv = np.zeros((256, VECTOR), np.float32)
                padded = np.zeros((n, x.shape[1] + self.reach - 1), np.uint8)
                padded[:, : x.shape[1]] = x
                used = place[:, :, None] + np.arange(self.reach)
                np.add.at(dv, padded[np.arange(n)[:, None, None], used], back.reshape(n, -1, self.reach, VECTOR))
                g = {"vector": dv, "filters": np.einsum("nf,nfk->kf", dh, patch) * self.mask, "bias": dh.sum(0), "out": hidden.T @ d, "prior": d.sum(0)}
                t += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
        return self

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """(language, score) of whole texts; ``und`` and 0 where there is no letter."""
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        rows, owner = [], []
        for k, text in enumerate(texts):
            if text and any(map(str.isalpha, text)):
                w = windows(text.encode())
                rows.append(w)
                owner.append(np.full(len(w), k))
        if rows and self.languages:
            at = np.concatenate(owner)
            logs = self.log_shares(np.concatenate(rows))
            begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            mean = np.add.reduceat(logs, begin, axis=0) / np.diff(np.append(begin, len(at)))[:, None]
            share = np.exp(mean - mean.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            for k, best, row in zip(at[begin], share.argmax(axis=1), share):
                langs[k], scores[k] = self.languages[best], float(row[best])
        return langs, scores


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_texts: int = 2400, max_windows: int = 4, epochs: int = 3) -> ByteConvNet:
    """Fit on a sample of labelled rows (null text or label: left out).

    The sample is bounded by ``max_texts`` rows, those with the smallest hash of their id and text, and by ``max_windows``
    windows of each, evenly spread over the whole text; that is all that reaches the driver. No rows: a net without languages.
    """
    known = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(text_col) / WINDOW))
    step = F.greatest(F.lit(1), F.floor(size / max_windows))
    parts = F.transform(F.sequence(F.lit(0), F.lit(max_windows - 1)), lambda k: F.substring(F.encode(F.col(text_col), "utf-8"), (k * step * WINDOW + 1).cast("int"), F.lit(WINDOW)))
    order = F.xxhash64(F.col(id_col), F.col(text_col))
    picked = bounded_sample(known, order, max_texts).select(order.alias("o"), F.col(lang_col).cast("string").alias("l"), parts.alias("w")).collect()
    picked.sort(key=lambda r: (r["o"], r["l"]))
    languages = sorted({r["l"] for r in picked})
    net = ByteConvNet(languages)
    rows, labels = [], []
    for r in picked:
        for w in r["w"]:
            if w:
                rows.append(windows(bytes(w))[0])
                labels.append(languages.index(r["l"]))
    return net.fit(np.array(rows), np.array(labels), epochs) if len(languages) > 1 else net


def identify(df: DataFrame, net: ByteConvNet, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """df with the predicted language of every whole text and its share (0 to 1).

    Null, empty or letterless texts: ``und`` and 0. All windows of a text count, however long it is; of languages with equal shares
    the first by name is taken; repeated rows get equal results. Columns named lang_col or score_col are replaced; others stay. An
    empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("struct<lang:string,score:double>")
    def guess(text: pa.Array) -> pa.Array:
        langs, scores = shared.value.predict(text.to_pylist())
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    g = guess(F.col(text_col).cast("string"))
    return df.withColumn(lang_col, g).withColumns({score_col: F.col(f"{lang_col}.score"), lang_col: F.col(f"{lang_col}.lang")})
