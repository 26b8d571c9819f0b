"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text as UTF-8 bytes (A-Z lowered), one byte a step. Every
byte position gets a distribution over the languages from the states of both
directions there; a document's probabilities are the mean over all its
positions. Texts are read in windows of WINDOW bytes, each with CONTEXT bytes
more on either side from which the states get going, so every position is
labelled once and knows at least that much of what surrounds it. The network
is trained in numpy by backpropagation through time on the driver, on the
whole texts of a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.storage import map_arrow

WINDOW, CONTEXT, HIDDEN = 512, 32, 10
#: Windows that go through the network together.
LANES = 1024
#: Labelled rows of a language in the training sample (about); their whole texts are used.
TRAIN_ROWS = 200
#: Steps of training, windows in a batch, bytes in a window, and step size.
STEPS, BATCH, TRAIN_BYTES, STEP_SIZE = 200, 96, 128, 0.03
UNDETERMINED = "und"
#: Stands after the end of a text; the backward direction starts with an empty state before it.
PAD = 256


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # 2 x 256 x 3H: update, reset and new gates of the forward and of the backward direction
    bias: np.ndarray  # 2 x 3H
    cells: np.ndarray  # 2 x H x 3H
    out: np.ndarray  # 2H x C
    out_bias: np.ndarray  # C

    @property
    def params(self) -> list[np.ndarray]:
        return [self.embed, self.bias, self.cells, self.out, self.out_bias]


def new_network(languages: list[str], seed: int = 0) -> Network:
    r, h, c = np.random.default_rng(seed), HIDDEN, len(languages)
    draw = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
    return Network(languages, draw(2, 256, 3 * h, scale=0.5), np.zeros((2, 3 * h), np.float32), draw(2, h, 3 * h, scale=0.3), draw(2 * h, c, scale=0.3), np.zeros(c, np.float32))


def _scan(x: np.ndarray, u: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (T, lanes, H) of one direction over gate inputs x (T, lanes, 3H)."""
    h = u.shape[0]
    state, states, tape = np.zeros((x.shape[1], h), np.float32), np.empty((*x.shape[:2], h), np.float32), []
    for t in range(len(x)):
        a = state @ u
        zr = x[t, :, : 2 * h] + a[:, : 2 * h]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r = zr[:, :h], zr[:, h:]
        n = np.tanh(x[t, :, 2 * h :] + r * a[:, 2 * h :])
        new = n + z * (state - n)
        if keep:
            tape.append((state, a[:, 2 * h :], z, r, n))
        state = states[t] = new
    return states, tape


def _unscan(grad: np.ndarray, u: np.ndarray, tape: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs and of u, through time."""
    h = u.shape[0]
    dx, du, carry = np.empty((*grad.shape[:2], 3 * h), np.float32), np.zeros_like(u), np.zeros(grad.shape[1:], np.float32)
    for t in range(len(grad) - 1, -1, -1):
        state, an, z, r, n = tape[t]
        d = grad[t] + carry
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (state - n) * z * (1 - z)
        dr = dn * an * r * (1 - r)
        da = np.concatenate([dz, dr, dn * r], axis=1)
        dx[t] = np.concatenate([dz, dr, dn], axis=1)
        du += state.T @ da
        carry = d * z + da @ u.T
    return dx, du


def _softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(np.clip(logits, -30, 30))
    p /= p.sum(axis=-1, keepdims=True)
    return p


def _taped(net: Network, data: np.ndarray):
    """Probabilities (T, lanes, C) of bytes (T, lanes), the states, and what the way back needs."""
    x = [np.take(net.embed[d], data, axis=0, mode="clip") + net.bias[d] for d in (0, 1)]
    x[1] *= (data != PAD)[..., None]  # without input an empty state stays empty
    f, tape_f = _scan(x[0], net.cells[0], True)
    b, tape_b = _scan(x[1][::-1], net.cells[1], True)
    states = np.concatenate([f, b[::-1]], axis=2)
    return _softmax(states @ net.out + net.out_bias), states, tape_f, tape_b


def _gradients(net: Network, data: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy over real positions; label is a language per lane."""
    p, states, tape_f, tape_b = _taped(net, data)
    real = (data != PAD).astype(np.float32)
    hit = np.zeros((len(label), len(net.languages)), np.float32)
    hit[np.arange(len(label)), label] = 1
    d = (p - hit) * (real / max(real.sum(), 1))[..., None]
    ds = d @ net.out.T
    h = net.cells.shape[1]
    dxf, duf = _unscan(ds[..., :h], net.cells[0], tape_f)
    dxb, dub = _unscan(ds[::-1, :, h:], net.cells[1], tape_b)
    embed = np.zeros_like(net.embed)
    order = np.argsort(np.minimum(data, 255).ravel(), kind="stable")
    at = np.minimum(data, 255).ravel()[order]
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    dxs = [dx * real[..., None] for dx in (dxf, dxb[::-1])]
    for k, dx in enumerate(dxs):
        embed[k][at[starts]] = np.add.reduceat(dx.reshape(-1, 3 * h)[order], starts, axis=0)
    return [embed, np.stack([dx.sum(axis=(0, 1)) for dx in dxs]), np.stack([duf, dub]), np.einsum("tlh,tlc->hc", states, d), d.sum(axis=(0, 1))]


def position_probabilities(net: Network, data: np.ndarray) -> np.ndarray:
    """Probabilities (T, lanes, C) of bytes (T, lanes), both directions in one pass and without a tape."""
    h, c, (steps, lanes) = net.cells.shape[1], len(net.languages), data.shape
    # gates side by side as update, reset, new, each forward then backward; update and reset negated and new doubled for exp
    scale = np.repeat(np.array([-1, -1, 2], np.float32), h)
    embed, cells, out = np.zeros((2, PAD + 1, 6 * h), np.float32), np.zeros((2 * h, 6 * h), np.float32), np.zeros((2 * h, 2 * c), np.float32)
    for d in (0, 1):
        own = np.concatenate([np.arange(h) + (2 * g + d) * h for g in range(3)])
        embed[d][:PAD, own] = (net.embed[d] + net.bias[d]) * scale
        cells[d * h : (d + 1) * h, own] = net.cells[d] * scale
        out[d * h : (d + 1) * h, d * c : (d + 1) * c] = net.out[d * h : (d + 1) * h]
    x, y, a = (np.empty((lanes, 6 * h), np.float32) for _ in range(3))
    gates, new, state = np.empty((lanes, 4 * h), np.float32), np.empty((lanes, 2 * h), np.float32), np.zeros((lanes, 2 * h), np.float32)
    logits = np.zeros((steps, lanes, c), np.float32) + net.out_bias
    for t in range(steps):
        np.take(embed[0], data[t], axis=0, out=x, mode="clip")
        np.take(embed[1], data[steps - 1 - t], axis=0, out=y, mode="clip")
        x += y
        np.matmul(state, cells, out=a)
        np.add(x[:, : 4 * h], a[:, : 4 * h], out=gates)
        np.exp(np.minimum(gates, 60, out=gates), out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        np.multiply(gates[:, 2 * h :], a[:, 4 * h :], out=new)
        new += x[:, 4 * h :]
        np.exp(np.minimum(new, 60, out=new), out=new)  # tanh(v) = 1 - 2 / (1 + exp(2v))
        new += 1
        np.divide(-2, new, out=new)
        new += 1
        state -= new
        state *= gates[:, : 2 * h]
        state += new
        both = state @ out
        logits[t] += both[:, :c]
        logits[steps - 1 - t] += both[:, c:]
    return _softmax(logits)


def _columns(texts: list[bytes], size: int) -> np.ndarray:
    """Bytes (size, lanes), with PAD after the ends."""
    data = np.frombuffer(b"".join(t.ljust(size, b"\0") for t in texts), np.uint8).reshape(len(texts), size).T.astype(np.int16)
    data[np.arange(size)[:, None] >= np.array([len(t) for t in texts])[None, :]] = PAD
    return data


def train(texts: list[tuple[bytes, str]], seed: int = 0, steps: int = STEPS) -> Network | None:
    """Adam on balanced batches of windows, drawn from anywhere in the (text, language) pairs; None without any."""
    languages = sorted({lang for _, lang in texts})
    if not languages:
        return None
    r, net = np.random.default_rng(seed), new_network(languages, seed)
    windows = {x: [(t, a) for t, lang in texts if lang == x for a in range(0, len(t), TRAIN_BYTES)] for x in languages}
    m, v = [np.zeros_like(p) for p in net.params], [np.zeros_like(p) for p in net.params]
    for step in range(1, steps + 1):
        label, drawn = r.integers(len(languages), size=BATCH), []
        for k in label:
            text, a = windows[languages[k]][r.integers(len(windows[languages[k]]))]
            a = max(0, a - int(r.integers(TRAIN_BYTES)))
            drawn.append(text[a : a + TRAIN_BYTES])
        rate = STEP_SIZE * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, a, b in zip(net.params, _gradients(net, _columns(drawn, TRAIN_BYTES), label), m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return net


def document_probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean distribution over all positions of each text (uniform for an empty one)."""
    lanes = [(i, t[max(0, a - CONTEXT) : a + WINDOW + CONTEXT], min(a, CONTEXT), min(WINDOW, len(t) - a)) for i, t in enumerate(texts) for a in range(0, len(t), WINDOW)]
    lanes.sort(key=lambda x: len(x[1]))
    total = np.zeros((len(texts), len(net.languages)))
    for k in range(0, len(lanes), LANES):
        part = lanes[k : k + LANES]
        size = len(part[-1][1])
        first, n = (np.array([x[j] for x in part])[None, :] for j in (2, 3))
        at = np.arange(size)[:, None]
        p = position_probabilities(net, _columns([x[1] for x in part], size))
        p *= ((at >= first) & (at < first + n))[..., None]
        np.add.at(total, [x[0] for x in part], p.sum(axis=0))
    norm = total.sum(axis=1, keepdims=True)
    return np.where(norm > 0, total / np.where(norm > 0, norm, 1), 1 / len(net.languages))


def held_out(id_: Column) -> Column:
    """Rows kept from training: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network from the whole texts of about TRAIN_ROWS rows of each language that aren't held out, picked by a hash of the id."""
    rows = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    million = 1_000_000
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(million, 2 * million * TRAIN_ROWS // n))))
    chosen = rows.where(F.pmod(F.xxhash64("i", F.lit("train")), F.lit(million)) < share[F.col("lang")]).where(F.col("text").rlike(r"\p{L}"))
    found = chosen.select("lang", "text").limit(4 * TRAIN_ROWS * len(counts)).collect()
    return train(sorted((r["text"].encode().lower(), r["lang"]) for r in found))


def _predict(net: Network, text_at: int, read_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = batch.column(read_at).to_pylist()
            texts = [t.lower() if ok else b"" for t, ok in zip(batch.column(text_at).cast(pa.binary()).to_pylist(), read, strict=True)]
            p = document_probabilities(net, texts)
            best = p.argmax(axis=1)
            lang = pa.array([net.languages[k] if ok else UNDETERMINED for k, ok in zip(best, read, strict=True)], pa.string())
            score = pa.array(np.where(read, np.clip(p[np.arange(len(best)), best], 0, 1), 0.0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 2], lang, score], names)

    return run


def identify(docs: DataFrame, net: Network | None, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with lang_pred and score.

    Texts that are null or hold no letter get "und" and score 0, as all do
    without a network. Rows are neither dropped nor merged; columns named
    lang_pred or score are replaced, all others may have any name; an empty
    table gives an empty table.
    """
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in ("lang_pred", "score")]
    kept = [docs[c] for c in keep]
    if net is None:
        return docs.select(*kept, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    text = docs[text_col].cast("string")
    read, sent = F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), list(kept)
    if text_col in keep and docs.schema[text_col].dataType == T.StringType():
        text_at = keep.index(text_col)
    else:
        text_at = len(sent)
        sent.append(F.when(read, text))
    # by place, so that no name can clash
    sent = docs.select(*(c.alias(f"c{i}") for i, c in enumerate([*sent, read])))
    schema = T.StructType([*(T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(keep)), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    made = map_arrow(sent, _predict(net, text_at, len(sent.columns) - 1, schema.names), schema)
    return made.toDF(*keep, "lang_pred", "score")


def language_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, held_out, lang_pred, score, by a network fitted on the rows that aren't held out."""
    net = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    made = identify(docs.select(id_col, text_col), net, text_col=text_col, keep=[id_col])
    return made.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
