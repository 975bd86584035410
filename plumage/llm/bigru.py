"""A bidirectional gated recurrent network over bytes that labels every position, in numpy.

A step of the recurrence takes ``stride`` neighbouring bytes, each through an input table of its own, and gives a
label to each of them, so every byte is read and every position is labelled while the recurrence is that much
shorter. Both ways run as one batch. Input is looked up, not multiplied: an input table has a row of gate inputs
for each byte. Trained by backpropagation through time.

Arrays are laid out by gate (update, reset, candidate), way (forward, backward), row and hidden unit, so that every
operation of a step runs over one contiguous block; update and reset gates are tanh units of half their input.
"""

from __future__ import annotations

import io

import numpy as np

PAD = 0
#: Rows of a batch in use: a step's arrays then stay in the second cache.
BATCH = 256


class BiGru:
    def __init__(self, classes: int, hidden: int = 32, seed: int = 0, stride: int = 2):
        rng = np.random.default_rng(seed)
        h, s = hidden, stride
        f = np.float32
        self.h, self.s, self.classes = h, s, classes
        orth = lambda: np.linalg.qr(rng.standard_normal((h, h)))[0]
        self.p = {
            "E": (rng.standard_normal((3, 2, s, 256, h)) * 0.1).astype(f),
            "U": np.stack([np.stack([orth() for _ in range(2)]) for _ in range(3)]).astype(f),
            "b": np.zeros((3, 2, 1, h), f),
            "V": (rng.standard_normal((2, h, s * classes)) / np.sqrt(2 * h)).astype(f),
            "c": np.zeros(classes, f),
        }

    # ---- kept networks ---------------------------------------------------------------------------

    def to_bytes(self) -> bytes:
        """The fitted network as a numpy archive, to be kept and loaded again."""
        out = io.BytesIO()
        np.savez_compressed(out, shape=np.array([self.classes, self.h, self.s]), **self.p)
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> BiGru:
        with np.load(io.BytesIO(data)) as z:
            classes, h, s = (int(x) for x in z["shape"])
            net = BiGru(classes, h, stride=s)
            net.p = {k: z[k] for k in net.p}
        return net

    # ---- one pass --------------------------------------------------------------------------------

    def _steps(self, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """((steps, 2, stride, rows) of bytes, the second way reversed inside each row's steps; steps of each row)."""
        rows, width = x.shape
        steps = -(-width // self.s)
        if steps * self.s != width:
            x = np.concatenate([x, np.zeros((rows, steps * self.s - width), x.dtype)], 1)
        x = np.where(np.arange(steps * self.s) < n[:, None], x, PAD)
        k = -(-n // self.s)
        a = x.reshape(rows, steps, self.s)
        t = np.arange(steps)
        back = np.where(t < k[:, None], k[:, None] - 1 - t, t)
        both = np.stack([a, np.take_along_axis(a, back[:, :, None], 1)])  # way, row, step, byte
        return np.ascontiguousarray(both.transpose(2, 0, 3, 1)), back

    def forward(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log-probabilities (rows, width, classes) of every position of the byte rows ``x`` of lengths ``n``."""
        return self.by_class(x, n).transpose(1, 2, 0)

    def by_class(self, x: np.ndarray, n: np.ndarray, keep: list | None = None) -> np.ndarray:
        """The same as (classes, rows, width), in which sums over classes are fast; ``keep`` takes what training needs."""
        p, h, s, f = self.p, self.h, self.s, self.p["E"].dtype.type
        xs, back = self._steps(x, n)
        steps, rows = len(xs), x.shape[0]
        half = np.array([0.5, 0.5, 1.0], f)[:, None, None, None]
        table = p["E"] * half[..., None]
        table[:, :, 0] += p["b"] * half
        table = table.reshape(3, 2 * s * 256, h)
        u = p["U"] * half
        at = xs.astype(np.intp) + np.arange(0, 512 * s, 256).reshape(2, s, 1)
        a, more, r = (np.empty((3, 2, rows, h), f) for _ in range(3))
        turn, d = np.empty((2, rows, h), f), np.empty((2, rows, h), f)
        state = np.zeros((2, rows, h), f)
        logits = np.empty((2, steps, rows, s * self.classes), f)
        for t in range(steps):
            for j in range(s):
                into = more if j else a
                for g in range(3):
                    np.take(table[g], at[t, :, j], axis=0, out=into[g], mode="clip")
                if j:
                    a += more
            np.matmul(state, u, out=r)
            np.add(a[:2], r[:2], out=a[:2])
            np.tanh(a[:2], out=a[:2])
            a[:2] += 1  # twice the gates
            np.multiply(r[2], a[1], out=turn)
            turn *= f(0.5)
            m = np.add(a[2], turn, out=a[2])
            np.tanh(m, out=m)
            np.subtract(state, m, out=d)
            d *= a[0]
            d *= f(0.5)
            if keep is None:
                state = np.add(d, m, out=state)
            else:
                keep.append((state, a[0] * f(0.5), a[1] * f(0.5), m.copy(), r[2].copy()))
                state = d + m
            for w in (0, 1):
                np.matmul(state[w], p["V"][w], out=logits[w, t])
        # the second way's labels stand in the reversed order of their row's steps
        turned = back.T * rows + np.arange(rows)
        out = logits[0] + np.take(logits[1].reshape(steps * rows, -1), turned, axis=0)
        out = np.ascontiguousarray(out.reshape(steps, rows, s, self.classes).transpose(3, 1, 0, 2)).reshape(self.classes, rows, steps * s)[:, :, : x.shape[1]]
        out = out + p["c"][:, None, None]
        out -= out.max(0)
        out -= np.log(np.exp(out).sum(0))
        if keep is not None:
            keep.append((xs, back))
        return out

    def gradients(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """(mean loss over positions, gradients); ``y`` holds a class for each position, -1 for none."""
        p, h, s, k = self.p, self.h, self.s, self.classes
        saved: list = []
        logp = self.by_class(x, n, saved).transpose(1, 2, 0)
        xs, back = saved.pop()
        steps, rows = len(xs), x.shape[0]
        mask = (np.arange(x.shape[1]) < n[:, None]) & (y >= 0)
        total = max(1, int(mask.sum()))
        ys = np.where(mask, y, 0)
        loss = -float((np.take_along_axis(logp, ys[:, :, None], 2)[:, :, 0] * mask).sum()) / total
        dl = np.ascontiguousarray(np.exp(logp))
        np.put_along_axis(dl, ys[:, :, None], np.take_along_axis(dl, ys[:, :, None], 2) - 1, 2)
        dl *= mask[:, :, None] / dl.dtype.type(total)
        g = {name: np.zeros_like(v) for name, v in p.items()}
        g["c"] = dl.sum((0, 1))
        wide = np.zeros((rows, steps * s, k), dl.dtype)
        wide[:, : x.shape[1]] = dl
        one = wide.reshape(rows, steps, s * k)
        # the reversing index is its own inverse inside the steps of a row
        dlog = np.stack([one, np.take_along_axis(one, back[:, :, None], 1)]).transpose(2, 0, 1, 3)  # step, way, row
        das = np.empty((steps, 3, 2, rows, h), dl.dtype)
        lasts = np.empty((steps, 2, rows, h), dl.dtype)  # what the candidate's recurrent part gets
        carry = np.zeros((2, rows, h), dl.dtype)
        ut, vt = p["U"].transpose(0, 1, 3, 2), p["V"].transpose(0, 2, 1)
        du = np.empty((3, 2, rows, h), dl.dtype)
        for t in range(steps - 1, -1, -1):
            state, z, r, m, um = saved[t]
            d = dlog[t] @ vt + carry
            da = das[t]
            dm = np.multiply(d, 1 - z, out=da[2])
            dm *= 1 - m * m
            np.multiply(d, state - m, out=da[0])
            da[0] *= z * (1 - z)
            np.multiply(dm, um, out=da[1])
            da[1] *= r * (1 - r)
            du[:2] = da[:2]
            du[2] = np.multiply(dm, r, out=lasts[t])
            carry = d * z + (du @ ut).sum(0)
        long = lambda v: v.reshape(-1, v.shape[-1])
        for w in (0, 1):
            states = [s_[0][w] for s_ in saved]
            before = np.concatenate(states)
            after = np.concatenate([*states[1:], (saved[-1][3] + saved[-1][1] * (saved[-1][0] - saved[-1][3]))[w]])
            g["V"][w] = after.T @ long(dlog[:, w])
            for i, part in enumerate((das[:, 0, w], das[:, 1, w], lasts[:, w])):
                g["U"][i, w] = before.T @ long(part)
        g["b"] = das.sum((0, 3))[:, :, None, :]
        for w in (0, 1):
            values = np.ascontiguousarray(das[:, :, w].transpose(0, 2, 1, 3)).reshape(steps * rows, 3 * h)
            for j in range(s):
                # rows of the input table, summed by byte in one sorted pass
                at = xs[:, w, j].ravel()
                order = np.argsort(at, kind="stable")
                byte, first = np.unique(at[order], return_index=True)
                g["E"][:, w, j, byte] = np.add.reduceat(values[order], first, axis=0).reshape(-1, 3, h).transpose(1, 0, 2)
        return loss, g


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict[str, np.ndarray], scale: float = 1.0) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float((x * x).sum()) for x in g.values())))
        clip = min(1.0, 1.0 / max(norm, 1e-9))
        for k, x in g.items():
            x = x * np.float32(clip)
            self.m[k] += np.float32(0.1) * (x - self.m[k])
            self.v[k] += np.float32(0.01) * (x * x - self.v[k])
            mh = self.m[k] / np.float32(1 - 0.9**self.t)
            vh = self.v[k] / np.float32(1 - 0.99**self.t)
            self.p[k] -= np.float32(self.rate * scale) * mh / (np.sqrt(vh) + np.float32(1e-8))
