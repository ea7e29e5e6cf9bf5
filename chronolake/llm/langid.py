"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads a text's bytes in windows of `WINDOW` bytes that together cover
the whole text, in both directions, labels every position with a distribution
over the learned languages and pools the positions inside letters to one
distribution per document.  It is trained here in numpy by backpropagation
through time on a bounded labelled sample.

Defined results: null texts and texts without a letter get ``und`` with score 0;
null languages aren't learned from; without any labelled text all is ``und``;
rows are returned one for one, repeated rows too; texts of any length are read whole,
a piece at a time; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.llm import bytekit as bk
from chronolake.llm.common import discard, fold, stored
from chronolake.llm.hashed import first_rows, thinned

FOLDS, HELD = 5, 0
WINDOW, HIDDEN, EMBED = 128, 8, 8
PIECE = 4096  # windows read at once
LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class BiGru:
    """Weights; `table[d]` maps a byte (256: padding) to the input part of direction d's gates."""

    langs: list[str]
    p: dict[str, np.ndarray]

    def tables(self) -> list[np.ndarray]:
        return [(self.p["emb"] @ self.p[f"w{d}"] + self.p[f"b{d}"]).astype(np.float32) for d in (0, 1)]

    def states(self, x: np.ndarray) -> np.ndarray:
        """Hidden states [time, window, 2 * HIDDEN] of byte windows x [time, window]."""
        big_t, n = x.shape
        h_all = np.empty((big_t, n, 2 * HIDDEN), np.float32)
        g, a, b = np.empty((n, 3 * HIDDEN), np.float32), np.empty((n, 2 * HIDDEN), np.float32), np.empty((n, HIDDEN), np.float32)
        half = np.array([0.5] * (2 * HIDDEN) + [1.0] * HIDDEN, np.float32)  # sigmoid(z) is tanh(z / 2) / 2 + 1 / 2
        for d, table in enumerate(self.tables()):
            table, u, un = table * half, 0.5 * self.p[f"u{d}"], self.p[f"un{d}"]
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(big_t) if d == 0 else range(big_t - 1, -1, -1):
                np.take(table, x[t], axis=0, out=g, mode="clip")
                np.matmul(h, u, out=a)
                a += g[:, : 2 * HIDDEN]
                np.tanh(a, out=a)
                a *= 0.5
                a += 0.5
                np.matmul(a[:, HIDDEN:] * h, un, out=b)
                b += g[:, 2 * HIDDEN :]
                np.tanh(b, out=b)
                h -= b
                h *= a[:, :HIDDEN]
                h += b
                h_all[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
        return h_all

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Distribution over the languages at every position: [language, time, window]."""
        z = self.p["o"].T @ self.states(x).reshape(-1, 2 * HIDDEN).T + self.p["ob"][:, None]
        z -= z.max(0)
        np.exp(z, out=z)
        z /= z.sum(0)
        return z.reshape(-1, *x.shape)

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(best language or -1, score) by document; windows are read PIECE at a time, so a long text needs no more memory."""
        n, k = len(texts), len(self.langs)
        if not k:
            return np.full(n, -1), np.zeros(n)
        total = np.zeros((n, k))
        letter = np.append(LETTER, False)
        for s in bk.slices(texts, PIECE * WINDOW):
            begin, end, of = window_bounds(s.offs)
            for a in range(0, len(of), PIECE):
                x = cut(s.raw, begin[a : a + PIECE], end[a : a + PIECE])
                by = np.einsum("ktn,tn->kn", self.positions(x), letter[x].astype(np.float32))
                for j in range(k):
                    total[s.lo : s.hi, j] += np.bincount(of[a : a + PIECE], weights=by[j], minlength=s.hi - s.lo)
        mass = total.sum(1)
        best = np.where(mass > 0, total.argmax(1), -1)
        return best, np.where(mass > 0, total.max(1, initial=0) / np.maximum(mass, 1e-9), 0.0)


def window_bounds(offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of the windows that together cover every byte of every row, and the row of each."""
    per = -(-np.diff(offs) // WINDOW)
    of = np.repeat(np.arange(len(per)), per)
    first = np.concatenate(([0], np.cumsum(per)))
    begin = offs[:-1][of] + (np.arange(len(of)) - first[:-1][of]) * WINDOW
    return begin, np.minimum(begin + WINDOW, offs[1:][of]), of


def cut(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Windows [WINDOW, n] of bytes, padded with 256."""
    at = begin[None, :] + np.arange(WINDOW)[:, None]
    return np.where(at < end[None, :], np.append(raw, 0)[np.minimum(at, len(raw))].astype(np.int16), 256)


def windows(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows [WINDOW, n] of the rows, and the row of each."""
    begin, end, of = window_bounds(offs)
    return cut(raw, begin, end), of


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 4, batch: int = 512, rate: float = 0.02, seed: int = 3) -> BiGru:
    """Backpropagation through time over windows x [time, n] with labels y; every letter position has its window's label."""
    rng = np.random.default_rng(seed)
    k, hid = len(langs), HIDDEN
    p = {"emb": rng.normal(0, 0.3, (257, EMBED)), "o": rng.normal(0, 0.2, (2 * hid, k)), "ob": np.zeros(k)}
    for d in (0, 1):
        p |= {f"w{d}": rng.normal(0, 0.3, (EMBED, 3 * hid)), f"b{d}": np.zeros(3 * hid), f"u{d}": rng.normal(0, 0.3, (hid, 2 * hid)), f"un{d}": rng.normal(0, 0.3, (hid, hid))}
    p = {a: v.astype(np.float32) for a, v in p.items()}
    m, s = ({a: np.zeros_like(v) for a, v in p.items()} for _ in range(2))
    step, steps = 0, max(60, epochs * -(-x.shape[1] // batch))
    share = np.bincount(y, minlength=k)
    weight = (share.sum() / (k * np.maximum(share, 1))).astype(np.float32)
    order = rng.permutation(x.shape[1])
    net = BiGru(langs, p)
    mask_of = np.append(LETTER, False)
    while step < steps:
        pick = np.take(order, np.arange(step * batch, (step + 1) * batch), mode="wrap")
        xb, yb = x[:, pick], y[pick]
        big_t, nb = xb.shape
        cache, h_all = [], np.empty((big_t, nb, 2 * hid), np.float32)
        for d, table in enumerate(net.tables()):
            h, seq = np.zeros((nb, hid), np.float32), []
            for t in range(big_t) if d == 0 else range(big_t - 1, -1, -1):
                g = table[xb[t]]
                zr = _sig(g[:, : 2 * hid] + h @ p[f"u{d}"])
                rh = zr[:, hid:] * h
                n = np.tanh(g[:, 2 * hid :] + rh @ p[f"un{d}"])
                seq.append((t, h, zr, rh, n))
                h = n + zr[:, :hid] * (h - n)
                h_all[t, :, d * hid : (d + 1) * hid] = h
            cache.append(seq)
        flat = h_all.reshape(-1, 2 * hid)
        z = flat @ p["o"] + p["ob"]
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        z = z.reshape(big_t, nb, k)
        z[:, np.arange(nb), yb] -= 1
        live = mask_of[xb].astype(np.float32) * weight[yb]
        z *= (live / max(1.0, float(live.sum())))[:, :, None]
        zf = z.reshape(-1, k)
        grad = {a: np.zeros_like(v) for a, v in p.items()}
        grad["o"], grad["ob"] = flat.T @ zf, zf.sum(0)
        dh_all = (zf @ p["o"].T).reshape(big_t, nb, 2 * hid)
        for d in (0, 1):
            dh = np.zeros((nb, hid), np.float32)
            gates = np.empty((big_t, nb, 3 * hid), np.float32)
            u, un = p[f"u{d}"], p[f"un{d}"]
            for t, h, zr, rh, n in reversed(cache[d]):
                dh = dh + dh_all[t, :, d * hid : (d + 1) * hid]
                zg, rg = zr[:, :hid], zr[:, hid:]
                dn = dh * (1 - zg) * (1 - n * n)
                dz = dh * (h - n) * zg * (1 - zg)
                drh = dn @ un.T
                dr = drh * h * rg * (1 - rg)
                grad[f"un{d}"] += rh.T @ dn
                dzr = np.concatenate((dz, dr), 1)
                grad[f"u{d}"] += h.T @ dzr
                gates[t, :, : 2 * hid], gates[t, :, 2 * hid :] = dzr, dn
                dh = dh * zg + drh * rg + dzr @ u.T
            flat_x, flat_g = xb.ravel(), gates.reshape(-1, 3 * hid)
            dtab = np.stack([np.bincount(flat_x, weights=flat_g[:, c], minlength=257) for c in range(3 * hid)], 1).astype(np.float32)
            grad[f"b{d}"] = dtab.sum(0)
            grad[f"w{d}"] = p["emb"].T @ dtab
            grad["emb"] += dtab @ p[f"w{d}"].T
        step += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        now = rate * (1 - step / (steps + 1)) + 1e-4
        for a in p:
            g = grad[a] / max(1.0, norm)
            m[a] = 0.9 * m[a] + 0.1 * g
            s[a] = 0.99 * s[a] + 0.01 * g * g
            p[a] -= now * (m[a] / (1 - 0.9**step)) / (np.sqrt(s[a] / (1 - 0.99**step)) + 1e-7)
    return net


def train(docs: DataFrame, per_lang: int = 200, most_windows: int = 16384) -> BiGru:
    """Learn from at most `per_lang` whole documents of each language outside the held-out fold.

    Of their windows those with the smallest hash are trained on, `most_windows` in all and as many of each language as of
    any other (8 at least).  Languages are those of the table, however many; the bounds keep the fit on one machine.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", FOLDS) != HELD))
    ids = rows.select("lang", F.col("doc_id").alias("id"), F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40)).alias("at"))
    picked = first_rows(thinned(ids, ["lang"], "at", per_lang), ["lang"], ["at", "id"], per_lang).distinct()  # per_lang rows of a language at most
    found = rows.select("lang", F.col("doc_id").alias("id"), "text").join(F.broadcast(picked), ["lang", "id"])
    found = first_rows(found, ["lang"], ["at", "id", F.xxhash64("text")], per_lang)  # an id that repeats doesn't widen the sample

    def cuts(batches):
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = np.frombuffer(text.encode(), np.uint8)
                begin, end, _ = window_bounds(np.array([0, len(raw)]))
                for a in range(0, len(begin), PIECE):
                    parts = [raw[i:j].tobytes() for i, j in zip(begin[a : a + PIECE], end[a : a + PIECE], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(parts), pa.string()), pa.array(parts, pa.binary())], names=["lang", "bytes"])

    pieces = found.select("lang", "text").mapInArrow(cuts, "lang string, bytes binary")
    pieces = stored(pieces.withColumn("at", F.pmod(F.xxhash64("bytes"), F.lit(1 << 40))), "windows")
    langs = sorted(r[0] for r in pieces.select("lang").distinct().collect())
    if not langs:
        return BiGru([], {})
    each = max(8, -(-most_windows // len(langs)))
    got = first_rows(thinned(pieces, ["lang"], "at", each), ["lang"], ["at", "bytes"], each).select("lang", "bytes").toArrow()
    discard(pieces)
    pairs = sorted(zip(got.column("lang").to_pylist(), map(bytes, got.column("bytes").to_pylist()), strict=True))
    size = np.array([len(b) for _, b in pairs])
    x, _ = windows(np.frombuffer(b"".join(b for _, b in pairs), np.uint8), np.concatenate(([0], np.cumsum(size))))
    at = {v: i for i, v in enumerate(langs)}
    return fit(x, np.array([at[v] for v, _ in pairs]), langs)


def predict(docs: DataFrame, model: BiGru, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of `docs`."""
    at = docs.sparkSession.sparkContext.broadcast(model)  # some kilobytes
    id_type = docs.schema[id_col].dataType.simpleString()

    def each(batches):
        for batch in batches:
            net, texts = at.value, batch.column(1)
            best, score = net.documents(texts)
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            ok = letters & (best >= 0)
            names = [net.langs[b] if good else "und" for b, good in zip(best, ok, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(np.where(ok, np.minimum(score, 1.0), 0.0))],
                names=[id_col, "held_out", "lang_pred", "score"],
            )

    return docs.select(id_col, "text", (fold(id_col, FOLDS) == HELD).alias("held")).mapInArrow(each, f"{id_col} {id_type}, held_out boolean, lang_pred string, score double")
