"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in windows, forward and backward, labels every
position with a probability for each language and pools them over the whole text. It is
trained in numpy by backpropagation through time, on the driver, from a bounded sample
of labelled rows (``SAMPLE_ROWS`` texts, one window of ``SAMPLE_CHARS`` characters each,
the rows and windows taken by hash). Gates use x / (1 + |x|) in place of the exponential
sigmoid, which numpy computes several times faster.

Defined results: a null text, and one without a letter, is ``und`` with score 1.0;
without a labelled row to learn from every text is ``und``; repeated rows are scored
alike; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import common, words

SAMPLE_ROWS, SAMPLE_CHARS = 3_000, 512
HIDDEN, WINDOW, LANES = 8, 128, 2_048
EPOCHS, BATCH, RATE = 5, 256, 0.02
STEPS = 200  # a small sample is gone through more often, until so many steps are taken
FOLDS, HELD = 5, 0
#: The pipeline's stage keeps documents whose language is found with this score or more; short texts score low, so it is lenient.
MIN_SCORE = 0.35
UND = "und"


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def _gate(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class Network:
    """Weights: for each direction a table of input terms by byte (3H x 256) and recurrent weights (3H x H); then the output layer."""
    def __init__(self, languages: list[str], seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.languages, h, n = languages, HIDDEN, len(languages)
        self.p = {}
        for d in "fb":
            self.p[f"in_{d}"] = rng.normal(0, 0.4, (3 * h, 256)).astype(np.float32)
            self.p[f"rec_{d}"] = rng.normal(0, 0.5 / h**0.5, (3 * h, h)).astype(np.float32)
            self.p[f"out_{d}"] = rng.normal(0, 0.3, (n, h)).astype(np.float32)
        self.p["out"] = np.zeros((n, 1), np.float32)

    # -- training: x is (time, lanes) of bytes, y the language of each lane --

    def _run(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        table, rec, h = self.p[f"in_{d}"], self.p[f"rec_{d}"], np.zeros((HIDDEN, x.shape[1]), np.float32)
        states, kept = np.empty((len(x), HIDDEN, x.shape[1]), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a, u = table[:, x[t]], rec @ h
            az, ar = np.split(a[: 2 * HIDDEN] + u[: 2 * HIDDEN], 2)
            z, r, c = 0.5 + 0.5 * _gate(az), 0.5 + 0.5 * _gate(ar), u[2 * HIDDEN :]
            an = a[2 * HIDDEN :] + r * c
            n = _gate(an)
            kept.append((t, h, az, ar, z, r, c, an, n))
            h = n + z * (h - n)
            states[t] = h
        return states, kept

    def _back(self, x: np.ndarray, d: str, kept: list, d_states: np.ndarray) -> dict:
        rec = self.p[f"rec_{d}"]
        d_rec, d_pre, carry = np.zeros_like(rec), np.empty((len(x), 3 * HIDDEN, x.shape[1]), np.float32), 0.0
        slope = lambda v: 1 / (1 + np.abs(v)) ** 2
        for t, h, az, ar, z, r, c, an, n in reversed(kept):
            dh = d_states[t] + carry
            dan = dh * (1 - z) * slope(an)
            daz, dar, dc = dh * (h - n) * 0.5 * slope(az), dan * c * 0.5 * slope(ar), dan * r
            du = np.concatenate([daz, dar, dc])
            d_pre[t] = np.concatenate([daz, dar, dan])
            d_rec += du @ h.T
            carry = dh * z + rec.T @ du
        flat, at = d_pre.transpose(1, 0, 2).reshape(3 * HIDDEN, -1), x.ravel()
        return {f"in_{d}": np.stack([np.bincount(at, row, 256) for row in flat]).astype(np.float32), f"rec_{d}": d_rec}

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over all positions (each lane weighted) and its gradients."""
        (f, kept_f), (b, kept_b) = self._run(x, "f"), self._run(x, "b")
        logits = self.p["out_f"] @ f + self.p["out_b"] @ b + self.p["out"]
        q = np.exp(logits - logits.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        lanes = np.arange(len(y))
        scale = weight / (weight.sum() * len(x))
        loss = float(-(np.log(q[:, y, lanes] + 1e-9) * scale).sum())
        q[:, y, lanes] -= 1
        q *= scale.astype(np.float32)
        out = {"out": q.sum((0, 2))[:, None]}
        for d, states, kept in (("f", f, kept_f), ("b", b, kept_b)):
            out[f"out_{d}"] = np.einsum("tln,thn->lh", q, states, optimize=True)
            out |= self._back(x, d, kept, self.p[f"out_{d}"].T @ q)
        return loss, out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> float:
        rng, m, v, step, loss = np.random.default_rng(seed), {}, {}, 0, 0.0
        weight = (len(y) / np.maximum(np.bincount(y, minlength=len(self.languages)), 1))[y]
        epochs = max(epochs, -(-STEPS // -(-len(y) // BATCH)))
        total = epochs * -(-len(y) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                loss, grads = self.gradients(x[:, own], y[own], weight[own])
                norm = float(np.sqrt(sum((g**2).sum() for g in grads.values())))
                step += 1
                for k, g in grads.items():
                    g = g * min(1.0, 1 / (norm + 1e-9))
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                    rate = RATE * (1 - step / (total + 1))
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return loss

    # -- use: the same recurrence without what training keeps, in place --

    def _logits(self, x: np.ndarray, d: str, out: np.ndarray, lanes: np.ndarray) -> None:
        """Add one direction's part to ``out``; ``lanes``: how many lanes, the first ones, reach each time."""
        table, rec, head, n = self.p[f"in_{d}"], self.p[f"rec_{d}"], self.p[f"out_{d}"], x.shape[1]
        h, a, u, w = np.zeros((HIDDEN, n), np.float32), np.empty((3 * HIDDEN, n), np.float32), np.empty((3 * HIDDEN, n), np.float32), np.empty((2 * HIDDEN, n), np.float32)
        part = np.empty((len(self.languages), n), np.float32)
        g, last, new, wide = a[: 2 * HIDDEN], a[2 * HIDDEN :], u[2 * HIDDEN :], w[:HIDDEN]
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            np.take(table, x[t], axis=1, out=a, mode="clip")
            np.matmul(rec, h, out=u)
            g += u[: 2 * HIDDEN]
            np.abs(g, out=w)
            w += 1
            g /= w
            g *= 0.5
            g += 0.5
            new *= g[HIDDEN:]
            new += last
            np.abs(new, out=wide)
            wide += 1
            new /= wide
            h -= new
            h *= g[:HIDDEN]
            h += new
            h[:, lanes[t] :] = 0  # behind its end a lane has no state yet
            np.matmul(head, h, out=part)
            out[t] += part

    def pooled(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Mean probabilities (texts x languages) over the positions of each text; 0 for an empty one."""
        size = np.diff(off)
        per = -(-size // WINDOW)
        doc = np.repeat(np.arange(len(size)), per)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        start = off[doc] + nth * WINDOW
        length = np.minimum(off[doc + 1] - start, WINDOW) if len(doc) else np.zeros(0, np.int64)
        sums = np.zeros((len(size), len(self.languages)))
        order = np.argsort(-length, kind="stable")  # windows of like length share a run
        padded = np.append(data, np.zeros(WINDOW, np.uint8))
        for at in range(0, len(order), LANES):
            own = order[at : at + LANES]
            n = int(length[own[0]])
            x = np.ascontiguousarray(padded[start[own][None, :] + np.arange(n)[:, None]])
            inside = np.arange(n)[:, None] < length[own][None, :]
            x[~inside] = 0
            logits = np.empty((n, len(self.languages), len(own)), np.float32)
            logits[:] = self.p["out"]
            lanes = inside.sum(1)
            self._logits(x, "f", logits, lanes)
            self._logits(x, "b", logits, lanes)
            logits -= logits.max(1, keepdims=True)
            np.exp(logits, out=logits)
            logits /= logits.sum(1, keepdims=True)
            if not inside.all():
                logits *= inside[:, None, :]
            np.add.at(sums, doc[own], logits.sum(0).T)
        return sums / np.maximum(size, 1)[:, None]


def train(spark: SparkSession, docs: DataFrame) -> Network | None:
    """A network for the languages of ``docs`` (doc_id, text, lang), learned from rows that aren't held out."""
    begin = 1 + F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("window")), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1)))
    known = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("string").alias("key"), "lang", F.substring("text", begin.cast("int"), F.lit(SAMPLE_CHARS)).alias("part"))
    rows = common.bounded_sample(known, SAMPLE_ROWS, "key", "lang").where(F.col("part").rlike(r"\p{L}")).collect()
    if not rows:
        return None
    languages = sorted({r.lang for r in rows})
    x, y = [], []
    for r in rows:
        raw = np.frombuffer(r.part.encode(), np.uint8)
        raw = np.tile(raw, -(-WINDOW // len(raw)))
        for at in range(0, len(raw) - WINDOW + 1, WINDOW):
            x.append(raw[at : at + WINDOW])
            y.append(languages.index(r.lang))
    net = Network(languages)
    net.fit(np.stack(x, axis=1), np.array(y))
    return net


def has_letter(col: pa.Array, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    lower = data | 32
    sums = np.concatenate([[0], np.cumsum((lower >= 97) & (lower <= 122))])
    out = sums[off[1:]] > sums[off[:-1]]
    for i in np.flatnonzero(~out & (np.diff(off) > 0)):
        out[i] = any(c.isalpha() for c in col[int(i)].as_py())
    return out


def judged(net: Network | None, text: pa.Array) -> Iterator[tuple[int, int, list[str], np.ndarray]]:
    """For ranges of ``text``: begin, end, language of each text and score."""
    for at, to in words.chunks(text, 1 << 20):
        part = text.slice(at, to - at)
        data, off = words.text_bytes(part)
        fine = has_letter(part, data, off) if net else np.zeros(to - at, bool)
        best, score = np.zeros(to - at, np.int64), np.ones(to - at)
        if fine.any():
            pooled = net.pooled(data, off)
            best = pooled.argmax(1)
            score = np.where(fine, np.clip(pooled.max(1), 0, 1), 1.0)
        yield at, to, [net.languages[b] if ok else UND for b, ok in zip(best, fine, strict=True)], score


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of ``docs`` (doc_id, text, and lang to learn from)."""
    net = train(spark, docs)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            for at, to, found, score in judged(net, batch.column("text")):
                own = [batch.column(c).slice(at, to - at) for c in ("doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(found, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return identify(spark, common.table(spark, sf_dir, "documents"))


def keep_known(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` whose language is found: not ``und``, and with a score of ``MIN_SCORE`` or more."""
    net = train(spark, docs)

    def run(batches):
        for batch in batches:
            for at, to, found, score in judged(net, batch.column("text")):
                yield batch.slice(at, to - at).filter(pa.array((score >= MIN_SCORE) & (np.array(found) != UND)))

    return docs.mapInArrow(run, docs.schema)
