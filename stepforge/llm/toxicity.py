"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (labelled 1 in the learning folds) are the positives; unlabelled text (any rows of the learning
folds, whatever their label) stands for the whole corpus. A linear classifier over counts of hashed words and word beginnings minimises
    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))
with logistic losses; where the second part falls below zero its gradient is turned round. The class prior is the share
of toxic rows among the labelled rows of the learning folds. The same risk in zero-one loss, over the learning folds' sample,
sets the cut, where the score is 0.7. Positives and unlabelled rows are bounded samples (MAX_POSITIVE, MAX_UNLABELLED rows,
those with the smallest hashes of the id, whole texts); every row is scored on its whole text.

Defined cases: null or empty text has no words and gets the bias's score, long texts count a word MOST times at most;
without labelled toxic rows every score is 0; null ids are scored, held out of nothing and not learned from as toxic; ids
are whole at any size; an id labelled twice is toxic if one label says so; repeated rows get equal scores; ties in hash are
ordered by text; an empty table gives no rows; extra columns are ignored.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from stepforge.llm.hashing import NOT_ALNUM, batches_by_bytes, word_hashes
from stepforge.llm.storage import bounded_batches, hash_sample, map_frames

MAX_POSITIVE, MAX_UNLABELLED = 3000, 9000
FEATURE_BITS, PREFIXES, MOST = 22, (4, 5, 6, 7), 8
#: So many of the commonest features join in as a measure of length in each language: words that toxic texts only seem to hold
#: more of, being longer, are set off against them.
COMMON, COMMON_MOST, COMMON_UNIT = 128, 200, 20.0
#: Small samples can show less significance.
MIN_POSITIVE_TEXTS, MIN_LIFT, MIN_Z, MAX_Z, POSITIVES_A_Z = 5, 3.0, 5.0, 12.0, 200
EPOCHS, BATCH, RATE, L2, SEED = 30, 512, 0.03, 1e-3, 5
CUT = 0.7


def features(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words and word beginnings of each text with counts: (index, count, bounds)."""
    h, b = word_hashes([t and t.lower() for t in texts], breaks=NOT_ALNUM, prefixes=PREFIXES)
    doc = np.repeat(np.arange(len(b) - 1, dtype=np.int64), np.diff(b))
    key, count = np.unique((doc << np.int64(FEATURE_BITS)) | (h >> np.uint64(64 - FEATURE_BITS)).astype(np.int64), return_counts=True)
    return key & ((1 << FEATURE_BITS) - 1), count.astype(float), np.searchsorted(key >> np.int64(FEATURE_BITS), np.arange(len(b)))


def _holders(texts) -> np.ndarray:
    """In how many texts each feature is found."""
    out = np.zeros(1 << FEATURE_BITS, np.int32)
    for lo, hi in batches_by_bytes(texts):
        found, n = np.unique(features(texts[lo:hi])[0], return_counts=True)
        out[found] += n.astype(np.int32)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def risk_gradients(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the risk in logistic loss by the margins of positive and of unlabelled texts; where its second part, the
    risk of the negatives, is below zero, they are those of that part alone turned round, which raise it again."""
    negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    gu, gp = _sigmoid(fu) / len(fu), -prior * _sigmoid(fp) / len(fp)
    if negative < 0:
        return -gp, -gu
    return gp - prior * _sigmoid(-fp) / len(fp), gu


def least_risk_cut(fp: np.ndarray, fu: np.ndarray, prior: float) -> float:
    """The cut with the least non-negative risk in zero-one loss, prior * P_p(f < cut) + max(0, P_u(f >= cut) - prior *
    P_p(f >= cut)), over the margins of positive and unlabelled texts: the middle of the widest gap that has it."""
    at = np.unique(np.concatenate((fp, fu)))
    cuts = np.concatenate(([at[0] - 1], (at[1:] + at[:-1]) / 2, [at[-1] + 1]))
    p = 1 - np.searchsorted(np.sort(fp), cuts) / len(fp)
    u = 1 - np.searchsorted(np.sort(fu), cuts) / len(fu)
    risk = prior * (1 - p) + np.maximum(0, u - prior * p)
    gap = np.concatenate(([0], np.diff(at), [0]))
    best = np.flatnonzero(risk <= risk.min() + 1e-12)
    return float(cuts[best[np.argmax(gap[best])]])


class NonNegativePU:
    def __init__(self, prior: float):
        self.prior = prior

    def _rows(self, data, rows):
        idx, val, b = data
        n = b[rows + 1] - b[rows]
        at = np.repeat(b[rows] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return idx[at], val[at], np.repeat(np.arange(len(rows)), n)

    def _margin(self, idx, val, row, n):
        return np.bincount(row, self.w[idx] * val, n) + self.bias

    def fit(self, pos, unl) -> "NonNegativePU":
        """pos, unl: texts. A word has a weight if significantly more positives than unlabelled texts hold it."""
        dim, n_p, n_u = 1 << FEATURE_BITS, len(pos), len(unl)
        seen, likely = _holders(pos), _holders(unl) * (n_p / n_u)
        z = min(MAX_Z, MIN_Z + n_p / POSITIVES_A_Z)
        known = np.flatnonzero((seen >= MIN_POSITIVE_TEXTS) & (seen >= MIN_LIFT * likely) & (seen - likely >= z * np.sqrt(np.maximum(likely, 0.5))))
        common = np.setdiff1d(np.argsort(-likely, kind="stable")[: min(COMMON, n_p // 10)], known)
        self.significant = len(known)
        known = np.concatenate((known, common[likely[common] > 0]))
        self.slot = np.zeros(dim, np.int32)
        self.slot[known] = np.arange(1, len(known) + 1)
        p, u = self._weighed(pos), self._weighed(unl)
        self.w, self.bias = np.zeros(len(known) + 1), -2.0
        rng = np.random.default_rng(SEED)
        m, v, step = np.zeros(len(self.w) + 1), np.zeros(len(self.w) + 1), 0
        mean_w, mean_bias, averaged = np.zeros_like(self.w), 0.0, 0
        for epoch in range(EPOCHS):
            order = rng.permutation(n_u)
            for lo in range(0, n_u, BATCH):
                ru, rp = order[lo : lo + BATCH], rng.integers(0, n_p, BATCH // 2)
                iu, vu, du = self._rows(u, ru)
                ip, vp, dp = self._rows(p, rp)
                fu, fp = self._margin(iu, vu, du, len(ru)), self._margin(ip, vp, dp, len(rp))
                gp, gu = risk_gradients(fp, fu, self.prior)
                g = np.bincount(iu, gu[du] * vu, len(self.w)) + np.bincount(ip, gp[dp] * vp, len(self.w)) + L2 * self.w
                g = np.append(g, gu.sum() + gp.sum())
                step += 1
                m = 0.9 * m + 0.1 * g
                v = 0.999 * v + 0.001 * g * g
                d = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
                self.w -= d[:-1]
                self.w[0] = 0
                self.bias -= d[-1]
                if epoch >= EPOCHS // 2:  # the mean of the later steps, which sway as the correction turns gradients round
                    averaged += 1
                    mean_w += (self.w - mean_w) / averaged
                    mean_bias += (self.bias - mean_bias) / averaged
        self.w, self.bias = mean_w, mean_bias
        fu, fp = self._margin(*self._rows(u, np.arange(n_u)), n_u), self._margin(*self._rows(p, np.arange(n_p)), n_p)
        self.cut = least_risk_cut(fp, fu, self.prior)
        self.scale = float(max(1e-6, np.std(fu)))
        return self

    def _weighed(self, texts):
        """Features with a weight, made batch by batch so that the others never pile up."""
        parts = [self._known(features(texts[lo:hi])) for lo, hi in batches_by_bytes(texts)]
        ends = np.cumsum([0, *(len(i) for i, _, _ in parts)])
        bounds = np.concatenate([[0], *(b[1:] + e for (_, _, b), e in zip(parts, ends, strict=False))])
        return np.concatenate([i for i, _, _ in parts]), np.concatenate([v for _, v, _ in parts]), bounds.astype(np.int64)

    def _known(self, data):
        idx, val, b = data
        s = self.slot[idx]
        kept = np.concatenate(([0], np.cumsum(s > 0)))
        s, val = s[s > 0], val[s > 0]
        return s, np.where(s <= self.significant, np.minimum(val, MOST), np.minimum(val, COMMON_MOST) / COMMON_UNIT), kept[b]

    def score(self, texts) -> np.ndarray:
        out = []
        for lo, hi in batches_by_bytes(texts):
            d = self._known(features(texts[lo:hi]))
            f = self._margin(*self._rows(d, np.arange(hi - lo)), hi - lo)
            out.append(_sigmoid(4 * (f - self.cut) / self.scale + np.log(CUT / (1 - CUT))))
        return np.concatenate(out) if out else np.empty(0)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> NonNegativePU | None:
    lab = labels.where("toxic is not null and doc_id is not null").select("doc_id", "toxic").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = lab.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if not prior:
        return None
    learn = docs.where("doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pick = lambda d, n: [r["text"] for r in hash_sample(d, "doc_id", n, ["text"])]
    positive = pick(learn.join(lab.where("toxic = 1").select("doc_id"), "doc_id", "left_semi"), MAX_POSITIVE)
    unlabelled = pick(learn, MAX_UNLABELLED)
    if not positive or not unlabelled:
        return None
    return NonNegativePU(float(min(0.9, prior))).fit(positive, unlabelled)


def score(docs: DataFrame, model: NonNegativePU | None) -> DataFrame:
    """doc_id and score of every row of docs."""

    def run(frames):
        for pdf in frames:
            texts = [t if isinstance(t, str) else None for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": model.score(texts) if model else 0.0})

    return map_frames(bounded_batches(docs).select("doc_id", "text"), run, "doc_id long, score double")
