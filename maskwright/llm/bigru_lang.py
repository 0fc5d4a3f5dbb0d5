"""Language ID with a bidirectional gated recurrent network over bytes.

Texts are cut into windows of WINDOW bytes; in each, one network reads forwards and one backwards, and both states at a
byte give the probabilities of the languages there. A document's probabilities are the means over all its bytes. The
network is trained here, in numpy, by backpropagation through time on a bounded sample of labelled rows:
SAMPLE_DOCS documents for each language (those with the lowest hash of their id), SAMPLE_WINDOWS windows of each.

Nulls and texts without a letter are ``und`` with score 0. Rows with a null id or language teach nothing. Repeated rows
get equal results; empty tables give no rows. If nothing can be learned from, all is ``und``. A very long text is read
LANES windows at a time. Other columns, of any name, play no part and pass through ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import runs, table, trimmed

WINDOW = 128
HIDDEN = 8
SAMPLE_DOCS, SAMPLE_WINDOWS = 300, 3
STEPS, BATCH, RATE = 240, 192, 0.02
SEED = 7
#: Windows worked on at a time.
LANES = 1024
PAD = 256
#: Documents whose best language has a mean probability below this are rejected, as are those without any letter.
LEAST_SCORE = 0.4


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters: for each direction w (gates x bytes, padding's column zero) and u (gates x states); v and c give the labels.

    Gates are update, reset and candidate. With a zero column for padding and no other bias, a zero state stays zero
    over padding, so the backward reader starts at the last byte.
    """

    NAMES = ("wf", "uf", "wb", "ub", "v", "c")

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng, h = np.random.default_rng(seed), hidden
        normal = lambda scale, *shape: (scale * rng.standard_normal(shape)).astype(np.float32)
        self.labels, self.h = labels, h
        self.p = {"wf": normal(0.3, 3 * h, PAD + 1), "uf": normal(0.3, 3 * h, h), "wb": normal(0.3, 3 * h, PAD + 1), "ub": normal(0.3, 3 * h, h), "v": normal(0.3, len(labels), 2 * h), "c": np.zeros((len(labels), 1), np.float32)}
        for w in ("wf", "wb"):
            self.p[w][:, PAD] = 0

    def _read(self, w, u, x, order, keep: bool):
        """States after each step, (time, state, lane); with ``keep``, also what backpropagation needs."""
        h, lanes = self.h, x.shape[1]
        states = np.zeros((x.shape[0], h, lanes), np.float32)
        now, kept = np.zeros((h, lanes), np.float32), {}
        for t in order:
            gx, a = np.take(w, x[t], axis=1), u @ now
            zr = gx[: 2 * h]
            zr += a[: 2 * h]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[:h], zr[h:]
            n = r * a[2 * h :]
            n += gx[2 * h :]
            np.tanh(n, out=n)
            if keep:
                kept[t] = (now, z, r, n, a[2 * h :])
            now = now - n
            now *= z
            now += n
            states[t] = now
        return states, kept

    def _back(self, u, kept, order, dstates):
        """Gradients by u and by each step's input gates, through time."""
        h = self.h
        du, dgates, dh = np.zeros_like(u), np.zeros((dstates.shape[0], 3 * h, dstates.shape[2]), np.float32), 0.0
        for t in reversed(order):
            before, z, r, n, c = kept[t]
            d = dstates[t] + dh
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (before - n) * z * (1 - z)
            dr = dn * c * r * (1 - r)
            da = np.concatenate([dz, dr, dn * r])
            dgates[t] = np.concatenate([dz, dr, dn])
            du += da @ before.T
            dh = d * z + u.T @ da
        return du, dgates

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy over all bytes and its gradients; x is (time, lane) with PAD, y the lanes' labels."""
        p, times = self.p, list(range(x.shape[0]))
        sf, kf = self._read(p["wf"], p["uf"], x, times, True)
        sb, kb = self._read(p["wb"], p["ub"], x, times[::-1], True)
        s = np.concatenate([sf, sb], axis=1)
        logits = p["v"] @ s + p["c"]
        logits -= logits.max(axis=1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=1, keepdims=True)
        real = (x != PAD)[:, None, :]
        n = real.sum()
        lanes = np.arange(x.shape[1])
        loss = -float((np.log(prob[:, y, lanes] + 1e-12) * real[:, 0]).sum() / n)
        d = prob
        d[:, y, lanes] -= 1
        d = d * real / n
        grads = {"v": np.einsum("tcl,tsl->cs", d, s), "c": d.sum(axis=(0, 2))[:, None]}
        ds = np.einsum("cs,tcl->tsl", p["v"], d)
        flat = x.reshape(-1)
        for side, kept, order, part in (("f", kf, times, ds[:, : self.h]), ("b", kb, times[::-1], ds[:, self.h :])):
            grads["u" + side], gates = self._back(p["u" + side], kept, order, part)
            rows = gates.transpose(1, 0, 2).reshape(3 * self.h, -1)
            w = np.stack([np.bincount(flat, row, PAD + 1) for row in rows]).astype(np.float32)
            w[:, PAD] = 0
            grads["w" + side] = w
        return loss, grads

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> list[float]:
        """Adam on random batches of windows; x is (window, byte). Returns the losses."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for i in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            loss, grads = self.gradients(np.ascontiguousarray(x[pick].T), y[pick])
            losses.append(loss)
            scale = rate * min(1.0, 2 * (1 - (i - 1) / steps))
            for k, g in grads.items():
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.01 * (g * g - s[k])
                self.p[k] -= (scale * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return losses

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(time, label, lane) for windows (time, lane)."""
        p, times = self.p, range(x.shape[0])
        sf, _ = self._read(p["wf"], p["uf"], x, times, False)
        sb, _ = self._read(p["wb"], p["ub"], x, range(x.shape[0] - 1, -1, -1), False)
        out = p["v"][:, : self.h] @ sf + p["v"][:, self.h :] @ sb
        out += p["c"]
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        return out

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(text, label): mean probabilities over all bytes of each text; zeros for empty texts."""
        sizes = np.array([len(t) for t in texts], np.int64)
        per = -(-sizes // WINDOW)
        out = np.zeros((len(texts), len(self.labels)))
        if not per.sum():
            return out
        # bytes of all texts, each from a new window on; what fills its last one is not a byte, which lengths tell
        x = np.zeros(int(per.sum()) * WINDOW, np.uint8)
        starts = (np.cumsum(per) - per) * WINDOW
        for t, s in zip(texts, starts):
            x[s : s + len(t)] = np.frombuffer(t, np.uint8)
        x, doc = x.reshape(-1, WINDOW), np.repeat(np.arange(len(texts)), per)
        real = np.minimum(sizes[doc] - (np.arange(len(x)) - np.repeat(starts // WINDOW, per)) * WINDOW, WINDOW)
        sums = np.zeros((len(x), len(self.labels)))
        for s in range(0, len(x), LANES):
            w = np.ascontiguousarray(x[s : s + LANES].T).astype(np.int64)
            fill = np.arange(WINDOW)[:, None] >= real[s : s + LANES]
            w[fill] = PAD
            prob = self.probabilities(w)
            if fill.any():
                prob *= ~fill[:, None, :]
            sums[s : s + LANES] = prob.sum(axis=0).T
        np.add.at(out, doc, sums)
        return out / np.maximum(sizes, 1)[:, None]

    def positions(self, text: str) -> list[str]:
        """The label of each byte of a text."""
        raw = text.encode("utf-8", "surrogatepass")
        out: list[str] = []
        for s in range(0, len(raw), WINDOW):
            x = np.frombuffer(raw[s : s + WINDOW], np.uint8).astype(np.int64)[:, None]
            out += [self.labels[k] for k in self.probabilities(x)[:, :, 0].argmax(axis=1)]
        return out


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2):
    """Whether a row is kept from training; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def sample_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """(language, window) of the bounded sample. Only windows are shuffled, and of each language only the first few of each task."""
    places = F.explode(F.array(*(F.lit(k) for k in range(SAMPLE_WINDOWS)))).alias("_k")
    rows = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0) & F.col(id_col).isNotNull() & ~held_out(id_col))
    # of a language with many rows only low hashes can be among the first: four times as many as wanted stay, wherever they are
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    limits = [x for k, n in counts.items() for x in (F.lit(k), F.lit(int(-(2**63) + min(1.0, 4 * SAMPLE_DOCS / n) * (2**64 - 1025))))]
    if limits:
        rows = rows.where(F.xxhash64(F.lit(SEED), F.col(id_col)) <= F.element_at(F.create_map(*limits), F.col(lang_col)))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.lit(SEED), F.col(id_col)).alias("_hash"), places)
    at = 1 + F.pmod(F.xxhash64(F.lit(SEED), "id", "_k"), F.greatest(F.length("text") - (WINDOW - 1), F.lit(1)))
    rows = rows.select("lang", "_hash", "_k", F.substring(F.col("text"), at.cast("int"), F.lit(WINDOW)).alias("window"))
    first = F.row_number().over(W.partitionBy("lang").orderBy("_hash", "_k", "window"))
    rows = rows.withColumn("_n", first).where(F.col("_n") <= SAMPLE_DOCS * SAMPLE_WINDOWS)
    found = [(r["lang"], r["window"].encode("utf-8", "surrogatepass")[:WINDOW]) for r in rows.select("lang", "window").collect()]
    return sorted(found)


def train(docs: DataFrame, **columns: str) -> Network | None:
    found = sample_windows(docs, **columns)
    labels = sorted({lang for lang, _ in found}, key=lambda s: s.encode())
    if not labels:
        return None
    x = np.full((len(found), WINDOW), PAD, np.int64)
    for i, (_, raw) in enumerate(found):
        x[i, : len(raw)] = np.frombuffer(raw, np.uint8)
    y = np.array([labels.index(lang) for lang, _ in found])
    # batches draw languages alike, however many windows each has
    counts = np.bincount(y)
    again = np.concatenate([np.resize(np.flatnonzero(y == k), counts.max()) for k in range(len(labels))])
    net = Network(labels)
    net.fit(x[again], y[again])
    return net


def judged(net: Network | None, texts: pa.Array) -> tuple[list[str], list[float]]:
    """Languages and scores of texts, about 1 MB of them at a time."""
    langs: list[str] = []
    scores: list[float] = []
    for start, end in runs(texts, 1_000_000):
        part = texts.slice(start, end - start).to_pylist()
        known = [bool(t) and net is not None and (t.isalpha() or any(map(str.isalpha, t))) for t in part]
        pooled = net.pooled([t.encode("utf-8", "surrogatepass") if k else b"" for t, k in zip(part, known)]) if net else np.zeros((len(part), 1))
        best = pooled.argmax(axis=1)
        langs += [net.labels[i] if k else "und" for i, k in zip(best, known)]
        scores += [float(min(1.0, max(0.0, p[i]))) if k else 0.0 for p, i, k in zip(pooled, best, known)]
    return langs, scores


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each row; texts are read where they are, without a shuffle."""
    id_type = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = judged(net, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")


def accepted(docs: DataFrame, net: Network | None, least: float = LEAST_SCORE, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` as they are, without those that are ``und`` or whose score is below ``least``."""
    names, at = docs.columns, docs.columns.index(text_col)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, end in runs(b.column(at), 4_000_000):
                part = b.slice(start, end - start)
                langs, scores = judged(net, part.column(at))
                stay = part.filter(pa.array([k != "und" and x >= least for k, x in zip(langs, scores)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(stay.columns, names)

    return docs.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(run, docs.schema)


def op7_bigru_lang(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs, train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
