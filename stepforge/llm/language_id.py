"""Language identification by a bidirectional gated recurrent network over bytes, trained by backpropagation through time.

Every byte of every text is read: a text's UTF-8 bytes are cut into windows of WINDOW bytes, each read in both directions,
each position gets language probabilities, and a document's probabilities are the mean over its positions. The network is
fitted on the driver on windows of at most SAMPLE_PER_LANGUAGE documents for each language (SAMPLE_CHARS characters of
each, from a place that the id's hash gives), the documents with the smallest hashes of their ids; this bound does not
depend on the size of the corpus. At most MOST_LANGUAGES languages, the commonest, are learned.

Defined cases: null text and text without a letter (Unicode category L) are `und` with score 0; without any labelled row
all are `und`; null ids are rows like others (never held out, so learned from), ids are whole at any size; repeated rows
get equal results and are learned from once; ties go to the first language by code point; an empty table gives no rows;
the columns asked for pass through unchanged, others are ignored.
"""

from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stepforge.llm.storage import arrow_schema, bounded_batches, bounded_reads, give_back

HIDDEN, WINDOW, TRAIN_WINDOW = 8, 64, 32
STEPS, BATCH, RATE, SEED = 400, 256, 0.02, 11
SAMPLE_PER_LANGUAGE, SAMPLE_CHARS, MOST_LANGUAGES = 800, 512, 400
UNDETERMINED = "und"
_PIECE = 1 << 19


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class ByteGRU:
    """Gates z, r and candidate n in one block of 3h columns: the byte table E gives the input's part (bias included)."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages, self.h = languages, hidden
        n = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("E", n(256, 3 * hidden, s=0.3)), ("U", n(hidden, 3 * hidden, s=hidden**-0.5)), ("W", n(hidden, len(languages), s=0.3)))}
        self.p["c"] = np.zeros(len(languages), np.float32)

    def _steps(self, d: str, steps: int):
        return range(steps) if d == "f" else range(steps - 1, -1, -1)

    def loss_and_grads(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """x: (T, N) bytes; y: (N,) classes. Mean cross-entropy over all positions, and gradients by BPTT."""
        t_, n_ = x.shape
        h_, p = self.h, self.p
        states, logits = {}, np.zeros((t_, n_, len(self.languages)), np.float32) + p["c"]
        for d in "fb":
            h, keep = np.zeros((n_, h_), np.float32), {}
            for t in self._steps(d, t_):
                a, u = p[f"E{d}"][x[t]], h @ p[f"U{d}"]
                zr = _sigmoid(a[:, : 2 * h_] + u[:, : 2 * h_])
                z, r = zr[:, :h_], zr[:, h_:]
                c = np.tanh(a[:, 2 * h_ :] + r * u[:, 2 * h_ :])
                new = c + z * (h - c)
                keep[t] = (h, z, r, c, u[:, 2 * h_ :], new)
                h = new
                logits[t] += h @ p[f"W{d}"]
            states[d] = keep
        logits -= logits.max(-1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(-1, keepdims=True)
        loss = float(-np.log(prob[:, np.arange(n_), y] + 1e-9).mean())
        prob[:, np.arange(n_), y] -= 1
        prob /= t_ * n_
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["c"] = prob.sum((0, 1))
        for d in "fb":
            back = np.zeros((n_, h_), np.float32)
            for t in reversed(self._steps(d, t_)):
                h, z, r, c, un, new = states[d][t]
                g[f"W{d}"] += new.T @ prob[t]
                dh = prob[t] @ p[f"W{d}"].T + back
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * un * r * (1 - r)
                da = np.concatenate((dz, dr, dc), 1)
                du = np.concatenate((dz, dr, dc * r), 1)
                np.add.at(g[f"E{d}"], x[t], da)
                g[f"U{d}"] += h.T @ du
                back = dh * z + du @ p[f"U{d}"].T
        return loss, g

    def fit(self, windows: np.ndarray, labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> "ByteGRU":
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        by = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        by = [b for b in by if len(b)]
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(b, max(1, batch // len(by))) for b in by])  # languages weigh alike
            _, g = self.loss_and_grads(windows[pick].T, labels[pick])
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def pooled(self, texts: list[bytes], window: int = WINDOW) -> np.ndarray:
        """Mean language probabilities over all positions of each (non-empty) byte string."""
        sizes = np.array([len(b) for b in texts])
        rows = -(-sizes // window)
        first = np.concatenate(([0], np.cumsum(rows)))
        x = np.zeros((first[-1], window), np.uint8)
        flat = x.reshape(-1)
        for i, b in enumerate(texts):
            flat[first[i] * window : first[i] * window + len(b)] = np.frombuffer(b, np.uint8)
        inside = np.ones((first[-1], window), np.float32)
        for i in np.flatnonzero(sizes % window):
            inside[first[i + 1] - 1, sizes[i] % window :] = 0
        x, inside = np.ascontiguousarray(x.T), np.ascontiguousarray(inside.T)
        n_, h_, p = x.shape[1], self.h, self.p
        logits = np.empty((window, n_, len(self.languages)), np.float32)
        a, u = np.empty((n_, 3 * h_), np.float32), np.empty((n_, 3 * h_), np.float32)
        for d in "fb":
            h = np.zeros((n_, h_), np.float32)
            for t in self._steps(d, window):
                np.take(p[f"E{d}"], x[t], axis=0, out=a)
                np.matmul(h, p[f"U{d}"], out=u)
                zr = _sigmoid(a[:, : 2 * h_] + u[:, : 2 * h_])
                c = zr[:, h_:] * u[:, 2 * h_ :]
                c += a[:, 2 * h_ :]
                np.tanh(c, out=c)
                h -= c
                h *= zr[:, :h_]
                h += c
                if d == "f":
                    np.matmul(h, p["Wf"], out=logits[t])
                else:
                    h *= inside[t][:, None]  # bytes after a text's end leave no state
                    logits[t] += h @ p["Wb"]
        logits += p["c"]
        np.exp(logits, out=logits)
        logits *= (inside / logits.sum(-1))[:, :, None]
        return np.add.reduceat(logits.sum(0, dtype=np.float64), first[:-1], axis=0) / sizes[:, None]


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> list:
    """At most per_language (lang, excerpt) rows of each language, those with the smallest hashes of their ids. How many
    rows a language has is counted first, so rows above a hash that leaves enough are dropped where they are."""
    rows = bounded_reads(docs).where(F.col("lang").isNotNull() & F.rlike("text", F.lit(r"\p{L}")) & ~held_out(F.col("doc_id")))
    at = F.pmod(F.shiftright(F.xxhash64("doc_id"), 7), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1))).cast("int") + 1
    count = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not count:
        return []
    below = F.create_map(*[F.lit(x) for r in count for x in (r["lang"], int((1 << 40) * min(1.0, 1.1 * per_language / r["n"])))])
    key = F.shiftrightunsigned(F.xxhash64(F.lit(97), "doc_id"), 24)
    # the filter runs where the rows are; equal rows count once, so no id can fill the sample
    cut = rows.where(key < F.try_element_at(below, F.col("lang"))).select("lang", key.alias("__key"), F.substring(F.col("text"), at, F.lit(SAMPLE_CHARS)).alias("text"))
    found = sorted(cut.dropDuplicates(["lang", "__key"]).collect(), key=lambda r: (r["lang"], r["__key"], r["text"]))
    return [r for _, own in groupby(found, lambda r: r["lang"]) for r in islice(own, per_language)]


def train(docs: DataFrame) -> ByteGRU | None:
    sample = sorted((r["lang"], r["text"]) for r in training_sample(docs))
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return None
    windows, labels = [], []
    for lang, text in sample:
        b = text.encode("utf-8", "surrogatepass")
        b = b * (TRAIN_WINDOW // len(b) + 1) if len(b) < TRAIN_WINDOW else b
        for s in range(0, len(b) - TRAIN_WINDOW + 1, TRAIN_WINDOW):
            windows.append(np.frombuffer(b[s : s + TRAIN_WINDOW], np.uint8))
            labels.append(languages.index(lang))
    return ByteGRU(languages).fit(np.stack(windows), np.array(labels))


def predict(docs: DataFrame, model: ByteGRU | None, columns: list[str]) -> DataFrame:
    """The columns of docs with lang_pred and score."""

    def label(texts: list) -> tuple[list, list]:
        pred, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        todo, size = [], 0

        def flush():
            if todo:
                prob = model.pooled([b for _, b in todo])
                for (i, _), k, s in zip(todo, prob.argmax(1).tolist(), prob.max(1).tolist(), strict=True):
                    pred[i], score[i] = model.languages[k], min(1.0, s)
                todo.clear()

        for i, t in enumerate(texts):
            if model is None or not isinstance(t, str) or not any(map(str.isalpha, t)):
                continue
            todo.append((i, t.encode("utf-8", "surrogatepass")))
            size += len(todo[-1][1])
            if size >= _PIECE:
                flush()
                size = 0
        flush()
        return pred, score

    rows = bounded_batches(bounded_reads(docs)).select(*columns, *(["text"] if "text" not in columns else []))
    schema = docs.select(*columns).schema.add("__pred", "string").add("__score", "double")
    names = arrow_schema(schema).names

    def run(batches):  # the columns that pass through stay as they are
        for b in batches:
            pred, score = label(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names)
        give_back()

    return rows.mapInArrow(run, schema)
