"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Every byte gets a distribution over the languages and noise from a forward and a backward state. Texts
run in windows of WINDOW bytes, each from a zero state in either direction, so that windows of many
documents go through the network side by side and a text of any length is read whole in bounded
memory. A document's distribution is the mean over all its letters; numbers and signs, which no
language owns, don't count. Equal windows of a document go through the network once and count as
often as they occur. Training is backpropagation through time with Adam on a bounded sample.

Noise is a class of its own that no document is labelled with: the network learns it from snippets
whose characters are shuffled, and from random letters and keys. It is never predicted; its share
(column noise on demand) tells texts in no learned language.

Null texts, and texts without a letter, are "und" with score 0. Without labelled rows every
text is "und". Repeated rows get equal results; of languages that tie, the first by name is taken. Rows
with a null key are predicted, never learned from. Other columns are only carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkforge.llm.sampling import least_hashes
from linkforge.llm.text import raw, slices

#: Cells of each direction, bytes in a window, labelled snippets that the fit takes at most, and their characters.
CELLS, WINDOW, SAMPLE_ROWS, SNIPPET = 8, 96, 6000, 160
_F = np.float32
#: Bytes that are letters or parts of them, and odd multipliers, one a place in a window, by which windows are told apart.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MIX = np.random.default_rng(7).integers(1, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return _F(0.5) * (np.tanh(_F(0.5) * x) + _F(1))


class Direction:
    """A gated recurrent layer; weights: bytes x 3 cells, cells x 3 cells, 3 cells (update, reset, candidate)."""

    def __init__(self, r: np.random.Generator, cells: int):
        self.w = r.normal(0, 0.3, (256, 3 * cells)).astype(_F)
        self.u = r.normal(0, 0.3, (cells, 3 * cells)).astype(_F)
        self.b = np.zeros(3 * cells, _F)

    def forward(self, x: np.ndarray, sizes: np.ndarray, back: bool, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (time, row, cell) of windows x (row, time), longest first; keep: what backward() needs."""
        n, t_max = x.shape
        c = self.u.shape[0]
        h = np.zeros((n, c), _F)
        out = np.zeros((t_max, n, c), _F)
        table = self.w + self.b
        u_gate, u_cand = np.ascontiguousarray(self.u[:, : 2 * c]), np.ascontiguousarray(self.u[:, 2 * c :])
        saved = []
        active = np.searchsorted(-sizes, -np.arange(t_max), "left")  # rows longer than t
        for t in range(t_max - 1, -1, -1) if back else range(t_max):
            k = int(active[t])
            if not k:
                continue
            a = table[x[:k, t]]
            old = h[:k]
            gates = _sigmoid(a[:, : 2 * c] + old @ u_gate)
            z, r = gates[:, :c], gates[:, c:]
            m = old @ u_cand
            cand = np.tanh(a[:, 2 * c :] + r * m)
            new = cand + z * (old - cand)
            if keep:
                saved.append((t, k, old.copy(), z, r, m, cand))
            h[:k] = new
            out[t, :k] = new
        return out, saved

    def backward(self, x: np.ndarray, saved: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of w, u and b from those of the states."""
        c = self.u.shape[0]
        n = x.shape[0]
        d_h = np.zeros((n, c), _F)
        d_w, d_u, d_b = np.zeros_like(self.w), np.zeros_like(self.u), np.zeros_like(self.b)
        held, which = [], []
        for t, k, old, z, r, m, cand in reversed(saved):
            g = d_h[:k] + d_out[t, :k]
            d_cand = g * (1 - z) * (1 - cand * cand)
            d_z = g * (old - cand) * z * (1 - z)
            d_r = d_cand * m * r * (1 - r)
            d_m = d_cand * r
            d_gate = np.concatenate((d_z, d_r), 1)
            d_u[:, : 2 * c] += old.T @ d_gate
            d_u[:, 2 * c :] += old.T @ d_m
            d_h[:k] = g * z + d_gate @ self.u[:, : 2 * c].T + d_m @ self.u[:, 2 * c :].T
            held.append(np.concatenate((d_gate, d_cand), 1))
            which.append(x[:k, t])
        flat, byte = np.concatenate(held), np.concatenate(which)
        for j in range(3 * c):
            d_w[:, j] = np.bincount(byte, flat[:, j], 256)
        d_b += flat.sum(0)
        return d_w, d_u, d_b


@dataclass
class Network:
    """Two directions and a read-out over languages and, last, noise (where the network was trained with it)."""

    langs: list[str]
    ahead: Direction
    back: Direction
    v: np.ndarray
    c: np.ndarray

    @classmethod
    def new(cls, langs: list[str], seed: int = 0, cells: int = CELLS, noise: bool = False) -> Network:
        r, classes = np.random.default_rng(seed), len(langs) + noise
        return cls(langs, Direction(r, cells), Direction(r, cells), r.normal(0, 0.3, (2 * cells, classes)).astype(_F), np.zeros(classes, _F))

    def weights(self) -> list[np.ndarray]:
        return [self.ahead.w, self.ahead.u, self.ahead.b, self.back.w, self.back.u, self.back.b, self.v, self.c]

    def positions(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The distribution at every place: (time, row, language); zero beyond a window's end."""
        f, _ = self.ahead.forward(x, sizes, False)
        b, _ = self.back.forward(x, sizes, True)
        half = self.ahead.u.shape[0]
        e = np.exp(f @ self.v[:half] + b @ self.v[half:] + self.c)
        e /= e.sum(2, keepdims=True)
        e[np.arange(x.shape[1])[:, None] >= sizes[None, :]] = 0
        return e

    def step(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over all places, and the gradients of weights()."""
        f, sf = self.ahead.forward(x, sizes, False, True)
        b, sb = self.back.forward(x, sizes, True, True)
        h = np.concatenate((f, b), 2)
        z = h @ self.v + self.c
        z -= z.max(2, keepdims=True)
        p = np.exp(z)
        p /= p.sum(2, keepdims=True)
        mask = (np.arange(x.shape[1])[:, None] < sizes[None, :]).astype(_F)
        n = mask.sum()
        loss = float(-(np.log(p[:, np.arange(len(y)), y] + 1e-9) * mask).sum() / n)
        d = p
        d[:, np.arange(len(y)), y] -= 1
        d *= mask[:, :, None] / n
        half = f.shape[2]
        d_h = d @ self.v.T
        flat = d.reshape(-1, d.shape[2])
        grads = [*self.ahead.backward(x, sf, d_h[:, :, :half]), *self.back.backward(x, sb, d_h[:, :, half:]), h.reshape(-1, 2 * half).T @ flat, flat.sum(0)]
        return loss, grads

    def pooled(self, buf: np.ndarray, off: np.ndarray, rows: int = 2048) -> np.ndarray:
        """Each document's distribution: the mean over its letters (zeros for a text without any)."""
        size = np.diff(off)
        count = -(-size // WINDOW)
        doc = np.repeat(np.arange(len(size)), count)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = off[doc] + nth * WINDOW
        length = np.minimum(WINDOW, off[doc + 1] - start)
        padded = np.concatenate((buf, np.zeros(WINDOW, np.uint8)))
        key = np.zeros(len(doc), np.uint64)
        for at in range(0, len(doc), rows):
            w = slice(at, at + rows)
            x = padded[start[w][:, None] + np.arange(WINDOW)].astype(np.uint64) + np.uint64(1)
            x[np.arange(WINDOW) >= length[w][:, None]] = 0
            key[w] = (x * _MIX).sum(1, dtype=np.uint64)
        by = np.lexsort((key, doc))
        new = np.ones(len(by), bool)
        new[1:] = (doc[by[1:]] != doc[by[:-1]]) | (key[by[1:]] != key[by[:-1]])
        once = by[new]
        times = np.zeros(len(doc))
        times[once] = np.diff(np.append(np.flatnonzero(new), len(by)))
        order = once[np.argsort(-length[once], kind="stable")]
        total, letters = np.zeros((len(size), len(self.c))), np.zeros(len(size))
        for at in range(0, len(order), rows):
            w = order[at : at + rows]
            x = padded[start[w][:, None] + np.arange(int(length[w[0]]))[None, :]]
            mask = _LETTER[x] & (np.arange(x.shape[1]) < length[w][:, None])
            p = np.einsum("tnk,nt->nk", self.positions(x, length[w]), mask.astype(_F))
            letters += np.bincount(doc[w], mask.sum(1) * times[w], len(size))
            for k in range(p.shape[1]):
                total[:, k] += np.bincount(doc[w], p[:, k] * times[w], len(size))
        return total / np.maximum(letters, 1)[:, None]


def noise(texts: list[str], rows: int, r: np.random.Generator) -> list[str]:
    """Texts in no language: by thirds shuffled characters of texts, words of random letters, and keys of letters and digits."""
    lower, mixed = list("abcdefghijklmnopqrstuvwxyz"), list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    out = []
    for i in range(rows):
        if i % 3 == 0:
            chars = list(texts[int(r.integers(len(texts)))])
            out.append("".join(r.permutation(chars)))
        else:
            letters, longest = (lower, 12) if i % 3 == 1 else (mixed, 40)
            out.append(" ".join("".join(r.choice(letters, int(r.integers(1, longest)))) for _ in range(SNIPPET // longest + 2)))
    return [t for t in out if t]


def train(texts: list[str], labels: list[str], steps: int = 500, batch: int = 96, window: int = 48, seed: int = 0) -> Network:
    """Fit by Adam; each step takes random windows, languages and noise in equal shares."""
    langs = sorted(set(labels))
    known = [t for t in texts if t]
    net = Network.new(langs, seed, noise=bool(known))
    if not known:
        return net
    r = np.random.default_rng(seed)
    labels = [*labels, *[None] * 600]
    texts = [*texts, *noise(known, 600, r)]
    data = [[np.frombuffer(t.encode(), np.uint8) for t, y in zip(texts, labels) if y == k and t] for k in [*langs, None]]
    taught = [k for k, rows in enumerate(data) if rows]
    m = [np.zeros_like(w) for w in net.weights()]
    v = [np.zeros_like(w) for w in net.weights()]
    for i in range(1, steps + 1):
        y = r.choice(taught, batch)
        rows = []
        for k in y:
            t = data[k][r.integers(len(data[k]))]
            s = int(r.integers(0, max(1, len(t) - window + 1)))
            rows.append(t[s : s + window])
        sizes = np.array([len(t) for t in rows])
        order = np.argsort(-sizes, kind="stable")
        x = np.zeros((batch, int(sizes.max())), np.uint8)
        for j, o in enumerate(order):
            x[j, : sizes[o]] = rows[o]
        _, grads = net.step(x, sizes[order], y[order])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * min(1.0, 2.0 * (1 - (i - 1) / steps))
        for w, g, a, b in zip(net.weights(), grads, m, v):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= (rate * (a / (1 - 0.9**i)) / (np.sqrt(b / (1 - 0.99**i)) + 1e-8)).astype(_F)
    return net


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> tuple[list[str], list[str]]:
    """At most rows snippets of SNIPPET characters, from learnable documents of the least key hashes.

    Learnable: lang and text are not null and crc32 of the key as text, mod 4, is not 2.
    """
    h = F.xxhash64(F.lit(3), F.col(key))
    at = F.pmod(h, F.greatest(F.char_length(text) - SNIPPET, F.lit(1))) + 1
    known = docs.where(F.col(lang).isNotNull() & ~held_out(key))
    some = known.where(F.col(text).isNotNull()).select(h.alias("h"), F.col(text).substr(at.cast("int"), F.lit(SNIPPET)).alias("t"), F.col(lang).alias("y"))
    found = least_hashes(some, known, rows, "t").collect()  # rows snippets at most
    return [r["t"] for r in found], [r["y"] for r in found]


def held_out(key: str = "doc_id"):  # noqa: ANN201
    """Whether a document is kept from learning; a null key counts as not held out, but isn't learned from either."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def predict(docs: DataFrame, net: Network, text: str = "text", keep: list[str] | None = None, out: tuple[str, str, str] = ("lang_pred", "score", "noise")) -> DataFrame:
    """docs' columns in keep with lang_pred, score (the share of that language) and noise (the share of none), under the names in out.

    Kept columns that have one of these names, in any case, are replaced.
    """
    taken = {x.lower() for x in out}
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        letter = np.zeros(256, bool)
        letter[[*range(65, 91), *range(97, 123)]] = True
        for batch in batches:
            for part in slices(batch, text):
                col = part.column(part.schema.get_field_index(text))
                buf, off = raw(col)
                p = model.pooled(buf, off) if model.langs else np.zeros((len(col), 1))
                odd = p[:, len(model.langs)] if p.shape[1] > len(model.langs) else np.zeros(len(col))
                p = p[:, : max(1, len(model.langs))]
                best = p.argmax(1)
                seen = np.concatenate(([0], np.cumsum(letter[buf])))
                some = seen[off[1:]] > seen[off[:-1]]
                for i in np.flatnonzero(~some):
                    t = col[int(i)].as_py()
                    some[i] = bool(t) and any(c.isalpha() for c in t)
                ok = some & bool(model.langs)
                lang = [model.langs[b] if o else "und" for b, o in zip(best, ok)]
                score = np.round(np.clip(np.where(ok, p.max(1), 0.0), 0, 1), 5)  # what lies beyond depends on which texts run together
                cols = [part.column(part.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(score), pa.array(np.clip(odd, 0, 1).astype(float))], names=[*names, *out])

    schema = docs.select(*names).schema.add(out[0], "string").add(out[1], "double").add(out[2], "double")
    source = docs if text in names else docs.select(*names, text)
    return source.mapInArrow(run, schema)
