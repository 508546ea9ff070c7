"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in windows of ``SPAN``, forwards and
backwards, and labels every byte; a text's probabilities are the mean of those
of all its bytes. It is trained in numpy by backpropagation through time on
windows of a bounded sample. All windows of a piece of a batch go through the
network together, one byte position at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortfold.llm.shared import map_arrow
from cohortfold.llm.words import slices, utf8

UNITS = 12
SPAN = 64
#: Rows of each language that training takes, excerpts of each and their characters.
SAMPLE = 1500
EXCERPTS = 3
EXCERPT_CHARS = 150
STEPS = 500
BATCH = 384
RATE = 0.01
#: Bytes that go through the network together.
_PIECE = 1 << 18
UNDETERMINED = "und"


def _tanh(x: np.ndarray, spare: np.ndarray) -> None:
    """In place: x (27 + x^2) / (27 + 9 x^2), which agrees with tanh to within 0.03 and is much faster."""
    np.clip(x, -3, 3, out=x)
    np.multiply(x, x, out=spare)
    spare += 27
    x *= spare
    spare -= 24
    spare *= 9
    x /= spare


def _sigmoid(x: np.ndarray, spare: np.ndarray) -> None:
    """In place."""
    x *= 0.5
    _tanh(x, spare)
    x *= 0.5
    x += 0.5


@dataclass
class Gru:
    """One direction: ``input`` (3 units, 256) by byte, ``state`` (3 units, units)."""

    input: np.ndarray
    state: np.ndarray

    def run(self, codes: np.ndarray, mask: np.ndarray, order: range, kept: list | None = None) -> np.ndarray:
        """States (span, units, windows); ``codes`` and ``mask`` are (span, windows)."""
        u = len(self.state) // 3
        out = np.empty((len(codes), u, codes.shape[1]), np.float32)
        h, spare = np.zeros(out.shape[1:], np.float32), np.empty((3 * u, out.shape[2]), np.float32)
        a, g = np.empty_like(spare), np.empty_like(spare)
        for t in order:
            if kept is not None:
                a, g = np.empty_like(spare), np.empty_like(spare)
            np.take(self.input, codes[t], axis=1, out=a, mode="clip")
            np.matmul(self.state, h, out=g)
            gates, n = a[: 2 * u], a[2 * u:]
            gates += g[: 2 * u]
            _sigmoid(gates, spare[: 2 * u])
            np.multiply(gates[u:], g[2 * u:], out=spare[:u])
            n += spare[:u]
            _tanh(n, spare[:u])
            if kept is not None:
                kept.append((h, gates, n, g[2 * u:]))
            new = out[t]
            np.subtract(h, n, out=new)
            new *= gates[:u]
            new += n
            new *= mask[t]
            h = new
        return out

    def back(self, codes: np.ndarray, mask: np.ndarray, order: range, kept: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of ``input`` and ``state``, through time."""
        u = len(self.state) // 3
        d_state = np.zeros_like(self.state)
        d_codes = np.empty((3 * u, *codes.shape), np.float32)
        dh = np.zeros_like(d_out[0])
        for t, (before, gates, n, gn) in zip(reversed(order), reversed(kept)):
            z, r = gates[:u], gates[u:]
            dh = (dh + d_out[t]) * mask[t]
            dn = dh * (1 - z) * (1 - n * n)
            da = np.concatenate([dh * (before - n) * z * (1 - z), dn * gn * r * (1 - r), dn])
            d_codes[:, t] = da
            dg = np.concatenate([da[: 2 * u], dn * r])
            d_state += dg @ before.T
            dh = dh * z + self.state.T @ dg
        flat = codes.ravel()
        d_input = np.stack([np.bincount(flat, row.ravel(), 256) for row in d_codes]).astype(np.float32)
        return d_input, d_state


@dataclass
class LanguageModel:
    languages: list[str]
    forward: Gru
    backward: Gru
    label: np.ndarray  # (languages, 2 units)
    bias: np.ndarray  # (languages, 1)

    @classmethod
    def new(cls, languages: list[str], seed: int = 0) -> LanguageModel:
        rng = np.random.default_rng(seed)
        gru = lambda: Gru(
            (rng.standard_normal((3 * UNITS, 256)) * 0.3).astype(np.float32), (rng.standard_normal((3 * UNITS, UNITS)) / np.sqrt(UNITS)).astype(np.float32)
        )
        label = (rng.standard_normal((len(languages), 2 * UNITS)) * 0.1).astype(np.float32)
        return cls(languages, gru(), gru(), label, np.zeros((len(languages), 1), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.forward.input, self.forward.state, self.backward.input, self.backward.state, self.label, self.bias]

    def labelled(self, states_forward: np.ndarray, states_backward: np.ndarray) -> np.ndarray:
        """Probabilities (span, languages, windows) of every position."""
        p = self.label[:, :UNITS] @ states_forward + self.label[:, UNITS:] @ states_backward + self.bias
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def sums(self, codes: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Sum of the probabilities of each window's positions, (languages, windows)."""
        ahead = range(len(codes))
        p = self.labelled(self.forward.run(codes, mask, ahead), self.backward.run(codes, mask, ahead[::-1]))
        p *= mask[:, None]
        return p.sum(axis=0)

    def text_probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, languages): means over all bytes; 0 for an empty text."""
        size = np.diff(offsets)
        out = np.zeros((len(size), len(self.languages)))
        count = -(-size // SPAN)
        of = np.repeat(np.arange(len(size)), count)
        at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        begin = offsets[:-1][of] + at * SPAN
        many = _PIECE // SPAN
        for lo in range(0, len(of), many):
            b, who = begin[lo:lo + many], of[lo:lo + many]
            place = b + np.arange(SPAN)[:, None]
            inside = place < offsets[1:][who]
            codes = data[np.where(inside, place, b)].astype(np.intp)
            np.add.at(out, who, self.sums(codes, inside.astype(np.float32)).T)
        return out / np.maximum(size, 1)[:, None]


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    codes, mask = np.zeros((SPAN, len(texts)), np.intp), np.zeros((SPAN, len(texts)), np.float32)
    for i, t in enumerate(texts):
        codes[: len(t), i] = np.frombuffer(t, np.uint8)
        mask[: len(t), i] = 1
    return codes, mask


def train(windows: list[bytes], labels: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 0) -> LanguageModel:
    """Adam on the cross-entropy of every position, languages drawn evenly."""
    model, rng = LanguageModel.new(languages, seed), np.random.default_rng(seed)
    codes, mask = _windows(windows)
    by_language = [np.flatnonzero(labels == k) for k in range(len(languages))]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in model.parameters()]
    ahead = range(SPAN)
    for step in range(steps):
        want = rng.integers(0, len(languages), BATCH)
        rows = np.array([rng.choice(by_language[k]) for k in want])
        c, m = codes[:, rows], mask[:, rows]
        kept: tuple[list, list] = ([], [])
        hf, hb = model.forward.run(c, m, ahead, kept[0]), model.backward.run(c, m, ahead[::-1], kept[1])
        d = model.labelled(hf, hb)
        d[:, want, np.arange(BATCH)] -= 1
        d *= m[:, None] / m.sum()
        d_label = np.concatenate([np.einsum("tcb,tub->cu", d, hf), np.einsum("tcb,tub->cu", d, hb)], axis=1)
        gradients = [
            *model.forward.back(c, m, ahead, kept[0], model.label[:, :UNITS].T @ d),
            *model.backward.back(c, m, ahead[::-1], kept[1], model.label[:, UNITS:].T @ d),
            d_label, d.sum(axis=(0, 2))[:, None],
        ]
        rate = RATE * min(1.0, 2 * (1 - step / steps))
        for p, g, (first, second) in zip(model.parameters(), gradients, moments):
            np.clip(g, -1, 1, out=g)
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            p -= rate * (first / (1 - 0.9 ** (step + 1))) / (np.sqrt(second / (1 - 0.99 ** (step + 1))) + 1e-8)
    return model


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, learn_from: Column, language: str = "lang", sample: int = SAMPLE, steps: int = STEPS) -> LanguageModel | None:
    """A model from about ``sample`` rows of each language, or None without any.

    Rows for which ``learn_from`` holds, with a language and a letter in the
    text, are taken by a hash of doc_id; ``EXCERPTS`` excerpts at hashed places
    of each text reach the driver.
    """
    rows = docs.select("doc_id", "text", F.col(language).cast("string").alias("language")).filter(learn_from)
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("language").isNotNull() & has_letter(F.col("text")))
    counts = rows.groupBy("language").agg(F.least(F.lit(1.0), sample / F.count(F.lit(1))).alias("share"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(F.broadcast(counts), "language").filter(place < F.col("share"))  # a row for each language
    begin = lambda k: 1 + F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.length("text")).cast("int")
    cuts = [F.substring(F.col("text"), begin(k), F.lit(EXCERPT_CHARS)) for k in range(EXCERPTS - 1)] + [F.substring("text", 1, EXCERPT_CHARS)]
    found = sorted(chosen.select("doc_id", "language", F.array(*cuts).alias("cuts")).distinct().collect())
    pieces = [(b[at:at + SPAN], r.language) for r in found for c in r.cuts for b in [c.encode()] for at in range(0, len(b), SPAN)]
    if not pieces:
        return None
    languages = sorted({x for _, x in pieces})
    number = {x: i for i, x in enumerate(languages)}
    return train([p for p, _ in pieces], np.array([number[x] for _, x in pieces]), languages, steps)


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred and score (the language's probability) of each row's whole text.

    A text that is null or has no letter is ``und`` with score 0, as is every
    text without a model. Other columns are not read.
    """
    id_type = docs.select("doc_id").dtypes[0][1]
    rows = docs.select("doc_id", F.when(has_letter(F.col("text")), F.col("text")).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*model.languages, UNDETERMINED])
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                data, offsets = utf8(piece.column("text"))
                p = model.text_probabilities(data, offsets)
                best = np.where(np.diff(offsets) > 0, p.argmax(axis=1), len(model.languages))
                yield pa.record_batch([piece.column("doc_id"), names.take(pa.array(best)), pa.array(np.minimum(p.max(axis=1), 1.0))], names=["doc_id", "lang_pred", "score"])

    return map_arrow(rows, predicted, f"doc_id {id_type}, lang_pred string, score double")
