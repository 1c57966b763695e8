"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels come per document, so tokens are labelled first: over the labelled sample, features that explain
toxic documents nothing else explains, and that clean documents all but lack, are taken one by one, and the
tokens of toxic documents that carry one are the toxic tokens.  Copies of one document therefore add nothing:
what tells it apart is explained by then.  The field has two states; its features are hashes of a token, its
beginnings and its ending.  Forward-backward gives each token's marginal; a document's score comes from the
largest and from the expected number of toxic tokens, calibrated to the share of toxic labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telerisk.llm.words import LOWER, WORDS, Block, blocks, mix

BINS = 1 << 22
#: labelled documents fitted on, at most, of each class; and the bytes of the longest one taken
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 2000, 3000, 16384
STEP = 128
ROUNDS = 25
_AFFIXES = (("start", 4), ("start", 5), ("start", 6), ("end", 4))


@dataclass
class Model:
    """Non-zero feature weights, transition scores [from][to], start score, calibration, and the prior."""
    index: np.ndarray
    weight: np.ndarray
    transition: np.ndarray
    start: float
    calibration: np.ndarray

    def table(self) -> np.ndarray:
        out = np.zeros(BINS, np.float32)
        out[self.index] = self.weight
        return out


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each token, and its feature bins (tokens x features)."""
    starts, ends, rows = block.words()
    text = LOWER[block.data]
    a, b = block.cores(starts, ends)
    sums = WORDS.sums(text)
    columns = [WORDS.spans(sums, a, b)]
    for k, (side, n) in enumerate(_AFFIXES):
        lo, hi = (a, np.minimum(a + n, b)) if side == "start" else (np.maximum(b - n, a), b)
        columns.append(mix(WORDS.spans(sums, lo, hi) + np.uint64(k + 1)))
    features = np.stack([c % np.uint64(BINS) for c in columns], axis=1).astype(np.int32) if len(a) else np.zeros((0, len(_AFFIXES) + 1), np.int32)
    return starts, ends, rows, features


def chain(emission: np.ndarray, rows: np.ndarray, transition: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of the toxic state at each token of the sequences named by ``rows``.

    Exact for any length: sequences are cut into segments that run side by side; a segment's effect is a 2 x 2
    matrix, and the matrices carry the odds from segment to segment.
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros(0)
    (oo, ot), (to, tt) = np.exp(transition)
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    size = np.diff(np.append(first, n))
    inside = np.arange(n) - np.repeat(first, size)
    per = -(-size // STEP)
    base = np.cumsum(per) - per
    seg, col = np.repeat(base, size) + inside // STEP, inside % STEP
    total = int(per.sum())
    e = np.ones((STEP, total))
    live = np.zeros((STEP + 1, total), bool)
    e[col, seg] = np.exp(np.clip(emission, -30, 30))
    live[col, seg] = True

    def composed(order, step):
        m = [np.ones(total), np.zeros(total), np.zeros(total), np.ones(total)]
        for t in order:
            m = step(t, m)
            scale = m[0] + m[1] + m[2] + m[3]
            m = [x / scale for x in m]
        return m

    def carry(m, initial, order):
        """Odds before each segment, following the segments of each sequence in ``order``."""
        out = np.full(total, initial)
        for k in range(1, int(per.max())):
            have = np.flatnonzero(per > k)
            here, last = (base[have] + k, base[have] + k - 1) if order > 0 else (base[have] + per[have] - 1 - k, base[have] + per[have] - k)
            x = out[last]
            out[here] = (m[2][last] + m[3][last] * x) / (m[0][last] + m[1][last] * x)
        return out

    # rows of m: (O from O, O from T, T from O, T from T)
    def ahead(t, m):
        o0, o1, t0, t1 = m
        a, b = oo * o0 + to * t0, oo * o1 + to * t1
        c, d = e[t] * (ot * o0 + tt * t0), e[t] * (ot * o1 + tt * t1)
        on = live[t]
        return [np.where(on, x, y) for x, y in zip((a, b, c, d), m)]

    def behind(t, m):
        o0, o1, t0, t1 = m
        a, b = oo * o0 + ot * e[t] * t0, oo * o1 + ot * e[t] * t1
        c, d = to * o0 + tt * e[t] * t0, to * o1 + tt * e[t] * t1
        on = live[t]
        return [np.where(on, x, y) for x, y in zip((a, b, c, d), m)]

    forward, backward = np.empty((STEP, total)), np.empty((STEP, total))
    several = int(per.max()) > 1
    # odds such that one transition from them gives the start score
    s = np.exp(start)
    opening = (s * oo - ot) / (tt - s * to) if abs(tt - s * to) > 1e-12 else 0.0
    r = carry(composed(range(STEP), ahead), opening, 1) if several else np.full(total, opening)
    for t in range(STEP):
        r = e[t] * (ot + tt * r) / (oo + to * r)
        forward[t] = r
    b = carry(composed(range(STEP - 1, -1, -1), behind), 1.0, -1) if several else np.ones(total)
    for t in range(STEP - 1, -1, -1):
        backward[t] = b
        x = e[t] * b
        b = np.where(live[t], (to + tt * x) / (oo + ot * x), b)
    return forward[col, seg], backward[col, seg]


def marginals(emission, rows, transition, start) -> np.ndarray:
    f, b = chain(emission, rows, transition, start)
    return f * b / (1 + f * b)


def seed_features(features: np.ndarray, rows: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Features that explain toxic documents, most telling first."""
    pairs = np.unique((rows[:, None].astype(np.int64) * BINS + features).ravel())
    doc, feature = pairs // BINS, pairs % BINS
    hit = toxic[doc]
    in_toxic, in_clean = np.bincount(feature[hit], minlength=BINS), np.bincount(feature[~hit], minlength=BINS)
    share = max(1.0, toxic.sum()) / max(1.0, (~toxic).sum())
    good = (in_toxic >= 3) & (in_clean * share <= 0.03 * in_toxic)
    use = hit & good[feature]
    doc, feature = doc[use], feature[use]
    least = max(3, int(0.004 * toxic.sum()))
    chosen = []
    while len(doc):
        count = np.bincount(feature, minlength=BINS)
        best = int(count.argmax())
        if count[best] < least:
            break
        chosen.append(best)
        explained = np.isin(doc, doc[feature == best])
        doc, feature = doc[~explained], feature[~explained]
    return np.array(chosen, np.int64)


def fit_field(features, rows, y, rounds: int = ROUNDS):
    """Weights (dense over the bins in use), transitions and start score that raise the likelihood of ``y``."""
    bins, local = np.unique(features, return_inverse=True)
    local = local.reshape(features.shape)
    w, transition, start = np.zeros(len(bins)), np.array([[0.0, -3.0], [0.0, -3.0]]), -3.0
    seen_w, seen_t, seen_s = np.full(len(bins), 1e-2), np.full((2, 2), 1.0), 1.0
    first = np.append(True, rows[1:] != rows[:-1])
    inner = np.flatnonzero(~first)
    scale = 1.0
    for _ in range(rounds):
        e = w[local].sum(axis=1)
        f, b = chain(e, rows, transition, start)
        p = f * b / (1 + f * b)
        rest = y - p
        g = np.zeros(len(bins))
        for k in range(features.shape[1]):
            g += np.bincount(local[:, k], weights=rest, minlength=len(bins))
        g -= 0.02 * w
        seen_w += g * g
        w += scale * g / np.sqrt(seen_w)
        x = np.exp(np.clip(e[inner], -30, 30)) * b[inner]
        r = f[inner - 1]
        a = np.exp(transition)
        joint = np.stack([np.full(len(inner), a[0, 0]), a[0, 1] * x, a[1, 0] * r, a[1, 1] * r * x])
        joint /= joint.sum(axis=0)
        was, now = y[inner - 1].astype(int), y[inner].astype(int)
        gt = (np.bincount(2 * was + now, minlength=4) - joint.sum(axis=1)).reshape(2, 2) - 0.02 * transition
        gt[:, 0] = 0  # staying or going back to clean is the reference
        seen_t += gt * gt
        transition = np.clip(transition + 0.5 * gt / np.sqrt(seen_t), -8, 4)
        gs = (y[first] - p[first]).sum() - 0.02 * start
        seen_s += gs * gs
        start = float(np.clip(start + 0.5 * gs / np.sqrt(seen_s), -8, 4))
    return bins, w, transition, start


def summaries(p: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """Per document: 1, log-odds of the largest marginal, log of 1 + expected toxic tokens among the likelier ones."""
    top = np.full(count, 1e-6)
    np.maximum.at(top, rows, np.clip(p, 1e-6, 1 - 1e-6))
    many = np.bincount(rows, weights=np.where(p > 0.05, p, 0), minlength=count)
    return np.stack([np.ones(count), np.log(top / (1 - top)), np.log1p(many)], axis=1)


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    c = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        grad = x.T @ (weight * (y - p)) - 0.1 * c
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(c))
        c = c + np.clip(np.linalg.solve(curve, grad), -2, 2)
    return c


def fit(texts: pa.Array, toxic: np.ndarray, n_toxic: int, n_clean: int) -> Model:
    """The field and its calibration from labelled texts; the counts are those of all labels to learn from."""
    parts = [(b, tokens(b)) for b in blocks(texts)]
    rows = np.concatenate([t[2] + b.lo for b, t in parts])
    features = np.concatenate([t[3] for _, t in parts])
    seeds = seed_features(features, rows, toxic)
    y = (np.isin(features, seeds).any(axis=1) & toxic[rows]).astype(float)
    bins, w, transition, start = fit_field(features, rows, y)
    p = marginals(w[np.searchsorted(bins, features)].sum(axis=1), rows, transition, start)
    share = np.where(toxic, n_toxic / max(1, toxic.sum()), n_clean / max(1, (~toxic).sum()))
    c = calibrate(summaries(p, rows, len(toxic)), toxic.astype(float), share / share.mean())
    use = np.abs(w) > 1e-3
    return Model(bins[use].astype(np.int32), w[use].astype(np.float32), transition, start, c)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on labelled documents outside the held-out fifth (crc32 of the id as text, mod 5 = 0).

    Of each class at most ``sample_toxic`` and ``sample_clean`` documents are taken, in the order of a hash of their
    ids, and of those the ones of up to ``sample_bytes`` bytes.  That bounded sample is fitted in one task; only the
    model reaches the driver.  Null labels and ids are no labels; of several labels the highest counts.  Without
    labels of both kinds every score is the share of toxic labels, or 0.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(
        F.col("doc_id").cast("long").alias("_id")).agg((F.max("toxic") > 0).alias("_toxic"))
    counts = known.agg(F.sum(F.col("_toxic").cast("long")), F.count("*")).first()
    n_toxic, n_clean = counts[0] or 0, (counts[1] or 0) - (counts[0] or 0)
    base = float(np.log((n_toxic + 1e-3) / (n_clean + 1e-3))) if counts[1] else -10.0
    nothing = Model(np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros((2, 2)), 0.0, np.array([base, 0.0, 0.0]))
    if not n_toxic or not n_clean:
        return nothing
    some = lambda flag, n: known.where(F.col("_toxic") == flag).orderBy(F.xxhash64("_id"), "_id").limit(n)
    chosen = F.broadcast(some(True, sample_toxic).union(some(False, sample_clean)))  # bounded by the two parameters
    picked = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).where(
        F.octet_length("_text") <= sample_bytes).join(chosen, "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = pa.Table.from_batches(list(batches))
        if sample.num_rows:
            sample = sample.sort_by("_id").combine_chunks()
            toxic = sample.column("_toxic").to_numpy(zero_copy_only=False).astype(bool)
            if toxic.any() and not toxic.all():
                m = fit(sample.column("_text").combine_chunks() if sample.column("_text").num_chunks != 1 else sample.column("_text").chunk(0), toxic, n_toxic, n_clean)
                numbers = np.concatenate([m.transition.ravel(), [m.start], m.calibration])
                yield pa.record_batch([pa.array([x.tobytes()]) for x in (m.index, m.weight, numbers)], ["index", "weight", "numbers"])

    made = picked.select("_id", "_text", "_toxic").repartition(1).mapInArrow(run, "index binary, weight binary, numbers binary").collect()
    if not made:
        return nothing
    numbers = np.frombuffer(made[0]["numbers"])
    return Model(np.frombuffer(made[0]["index"], np.int32), np.frombuffer(made[0]["weight"], np.float32), numbers[:4].reshape(2, 2), float(numbers[4]), numbers[5:])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Each row of ``docs`` as the struct ``row``, with ``score``, ``predicted`` and ``spans``.

    ``spans`` are runs of tokens whose marginal is ``threshold`` or more: start and end in code points, and the
    largest marginal.  Null and empty texts have no tokens and get the score of a text without toxic ones.  Whole
    texts are scored, in blocks of bounded memory; columns of ``docs`` cannot clash, they stay in ``row``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        table = field.table()
        for batch in batches:
            scores, found = [], []
            for block in blocks(batch.column(1)):
                starts, ends, rows, features = tokens(block)
                p = marginals(table[features].sum(axis=1, dtype=np.float64), rows, field.transition, field.start)
                x = summaries(p, rows, block.rows) @ field.calibration
                scores.append(1 / (1 + np.exp(-np.clip(x, -30, 30))))
                found += toxic_spans(block, starts, ends, rows, p, threshold)
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.record_batch([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)),
                                   pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])))],
                                  ["row", "score", "predicted", "spans"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, score double, predicted int, spans array<struct<start:long,end:long,p:double>>")


def toxic_spans(block, starts, ends, rows, p, threshold) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(block.rows)]
    at = np.flatnonzero(p >= threshold)
    if not len(at):
        return out
    places = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    new = np.append(True, (at[1:] != at[:-1] + 1) | (rows[at[1:]] != rows[at[:-1]]))
    begin = np.flatnonzero(new)
    finish = np.append(begin[1:], len(at)) - 1
    best = np.maximum.reduceat(p[at], begin)
    row = rows[at[begin]]
    zero = places[block.offsets[row]]
    for r, a, b, x in zip(row.tolist(), (places[starts[at[begin]]] - zero).tolist(), (places[ends[at[finish]]] - zero).tolist(), best.tolist()):
        out[r].append({"start": a, "end": b, "p": x})
    return out
