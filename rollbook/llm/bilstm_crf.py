"""A character-level bidirectional LSTM with CRF transitions, trained and decoded in numpy."""

from __future__ import annotations

import random
import string

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: Outside, then beginning and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
WIDTH = 128
#: Of a span that the edge of a training text cuts, so much must be left for it to be labelled.
LEAST_PART = 12
#: Characters known apart: ASCII as it is; then other letters, other white space, and all else.
LETTER, BLANK, OTHER, PAD = 128, 129, 130, 131
VOCABULARY = 132


def char_ids(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = codes.astype(np.int64)
    for i in np.flatnonzero(codes >= 128).tolist():
        c = text[i]
        out[i] = LETTER if c.isalpha() else BLANK if c.isspace() else OTHER
    return out


class Tagger:
    """Parameters: for each direction input (one row a character), recurrent and bias weights; then output and transitions."""

    def __init__(self, hidden: int = 20, seed: int = 11, kind: type = np.float32):
        rng = np.random.default_rng(seed)
        self.hidden, self.kind = hidden, kind
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (VOCABULARY, 4 * hidden))
            self.p[f"h{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)) * 0.5
            bias = np.zeros(4 * hidden)
            bias[hidden:2 * hidden] = 1  # remember, at first
            self.p[f"b{d}"] = bias
        self.p["out"] = rng.normal(0, 0.3, (2 * hidden, TAGS))
        self.p["bias"] = np.zeros(TAGS)
        move = np.zeros((TAGS, TAGS))
        for k in range(TAGS):
            for inside in range(2, TAGS, 2):
                if k not in (inside, inside - 1):
                    move[k, inside] = -4  # an inside tag follows its own kind
        self.p["move"] = move
        self.p = {k: v.astype(kind) for k, v in self.p.items()}

    def lstm(self, ids: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (time, batch, both directions' hidden) in the order of the text, and with keep what backward() needs.

        Both directions take each step together; the second reads the text from its end.
        """
        n, steps = ids.shape
        x, u, bias = (np.stack([self.p[f"{w}{d}"] for d in "fb"]) for w in "xhb")
        read, way = np.stack([ids, ids[:, ::-1]]), np.arange(2)[:, None]
        h = c = np.zeros((2, n, self.hidden), self.kind)
        out, cache, wide = np.zeros((steps, n, 2 * self.hidden), self.kind), [], 3 * self.hidden
        half = np.where(np.arange(4 * self.hidden) < wide, 0.5, 1).astype(self.kind)  # a gate is 1 / (1 + exp(-z)) = (1 + tanh(z / 2)) / 2
        x, u, bias = (x * half, u * half, bias * half)
        x += bias[:, None]
        for t in range(steps):
            z = np.tanh(x[way, read[:, :, t]] + h @ u)
            gates, g = z[..., :wide] * 0.5 + 0.5, z[..., wide:]
            i, f, o = (gates[..., k * self.hidden:(k + 1) * self.hidden] for k in range(3))
            before, was = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t, :, :self.hidden], out[steps - 1 - t, :, self.hidden:] = h[0], h[1]
            if keep:
                cache.append((before, was, gates, g, tc))
        return out, cache

    def backward(self, ids: np.ndarray, cache: list, dout: np.ndarray, grad: dict[str, np.ndarray]) -> None:
        """Adds to grad what dout, the gradient of lstm()'s states, means for its parameters."""
        n, steps = ids.shape
        u = np.stack([self.p[f"h{d}"] for d in "fb"]).transpose(0, 2, 1)
        given = np.stack([dout[..., :self.hidden], dout[::-1, :, self.hidden:]], axis=1)
        dh_next = dc_next = np.zeros((2, n, self.hidden), self.kind)
        dz, states = np.zeros((steps, 2, n, 4 * self.hidden), self.kind), np.stack([x[0] for x in cache])
        for t in range(steps - 1, -1, -1):
            _, was, gates, g, tc = cache[t]
            i, f, o = (gates[..., k * self.hidden:(k + 1) * self.hidden] for k in range(3))
            dh = given[t] + dh_next
            dc = dc_next + dh * o * (1 - tc**2)
            wide = 3 * self.hidden
            dz[t, ..., :wide] = np.concatenate([dc * g, dc * was, dh * tc], axis=2) * gates * (1 - gates)
            dz[t, ..., wide:] = dc * i * (1 - g**2)
            dh_next, dc_next = dz[t] @ u, dc * f
        read = (ids.T, ids.T[::-1])
        for k, d in enumerate("fb"):
            flat = dz[:, k].reshape(-1, 4 * self.hidden)
            grad[f"x{d}"] += (read[k].reshape(-1)[None, :] == np.arange(VOCABULARY)[:, None]).astype(self.kind) @ flat
            grad[f"h{d}"] += states[:, k].reshape(-1, self.hidden).T @ flat
            grad[f"b{d}"] += flat.sum(axis=0)

    def emissions(self, ids: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray, list]:
        both, cache = self.lstm(ids, keep)
        return both @ self.p["out"] + self.p["bias"], both, cache

    def posterior(self, e: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log of the sum over all taggings, each tag's probability (time, batch, tag) and expected moves.

        Forward and backward weights are scaled to a sum of one at every step.
        """
        steps, n, k = e.shape
        move, top = np.exp(self.p["move"]), e.max(axis=2, keepdims=True)
        weight = np.exp(e - top)
        alpha, beta, scale = np.zeros((steps, n, k), self.kind), np.ones((steps, n, k), self.kind), np.ones((steps, n, 1), self.kind)
        real = (np.arange(steps)[:, None] < length[None, :])[..., None]
        for t in range(steps):
            new = weight[t] if t == 0 else (alpha[t - 1] @ move) * weight[t]
            scale[t] = np.maximum(new.sum(axis=1, keepdims=True), 1e-30)
            alpha[t] = np.where(real[t], new / scale[t], alpha[t - 1] if t else 0)
        total = ((np.log(scale) + top) * real).sum(axis=(0, 2), dtype=np.float64)
        moves = np.zeros((k, k), self.kind)
        for t in range(steps - 2, -1, -1):
            ahead = weight[t + 1] * beta[t + 1] / scale[t + 1] * real[t + 1]
            beta[t] = np.where(real[t + 1], ahead @ move.T, 1)
            moves += alpha[t].T @ ahead
        return total, alpha * beta, moves * move

    def viterbi(self, e: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The best tagging (batch, time); tags beyond a window's length mean nothing."""
        steps, n, k = e.shape
        best, back = e[0].copy(), np.zeros((steps, n, k), np.int8)
        for t in range(1, steps):
            step = best[:, :, None] + self.p["move"][None]
            back[t] = step.argmax(axis=1)
            best = np.where((t < length)[:, None], e[t] + step.max(axis=1), best)
        out = np.zeros((n, steps), np.int8)
        now = best.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            out[:, t] = now
            inside = t < length
            before = back[t][np.arange(n), now]
            now = np.where(inside & (t > 0), before, now)
        return out

    def step(self, ids: np.ndarray, tags: np.ndarray, length: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of a batch, and its gradient."""
        e, both, cache = self.emissions(ids, keep=True)
        total, marginal, moves = self.posterior(e, length)
        steps, n, _ = e.shape
        real = np.arange(steps)[:, None] < length[None, :]
        gold = np.zeros_like(marginal)
        gold[np.arange(steps)[:, None], np.arange(n)[None, :], tags.T] = 1
        score = (e * gold * real[:, :, None]).sum()
        pairs = real[1:]
        a, b = tags.T[:-1][pairs], tags.T[1:][pairs]
        score += self.p["move"][a, b].sum()
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["move"] = moves
        np.subtract.at(grad["move"], (a, b), 1)
        de = (marginal - gold) * real[:, :, None]
        grad["bias"] = de.sum(axis=(0, 1))
        grad["out"] = both.reshape(-1, both.shape[2]).T @ de.reshape(-1, TAGS)
        dboth = de @ self.p["out"].T
        self.backward(ids, cache, dboth, grad)
        return float((total.sum() - score) / n), {k: v / n for k, v in grad.items()}

    def fit(self, examples: list[tuple[str, list[tuple[str, int, int]]]], steps: int, batch: int, held_out: int = 256, every: int = 50, gain: float = 0.1, rate: float = 0.03, seed: int = 5) -> list[float]:
        """Trains on texts of up to WIDTH characters with labelled spans (kind, start, end), by Adam; returns held-out losses.

        The last held_out examples are not trained on. Their loss is taken every so many steps; once it is not less by
        `gain` than the least before it, the rate falls to a third, and the second time training stops.
        """
        ids, tags, length = encoded(examples)
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses: list[float] = []
        apart, falls = slice(len(ids) - held_out, None), 0
        for t in range(1, steps + 1):
            pick = rng.integers(0, len(ids) - held_out, batch)
            _, grad = self.step(ids[pick], tags[pick], length[pick])
            norm = np.sqrt(sum((g**2).sum() for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1, 5 / max(norm, 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g**2
                self.p[k] -= rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-8)
            if t % every == 0:
                losses.append(self.loss(ids[apart], tags[apart], length[apart]))
                if losses[-1] > min(losses[:-1], default=np.inf) * (1 - gain):
                    rate, falls = rate / 3, falls + 1
                    if falls == 2:
                        break
        return losses

    def loss(self, ids: np.ndarray, tags: np.ndarray, length: np.ndarray) -> float:
        """Mean negative log likelihood."""
        e = self.emissions(ids)[0]
        total = self.posterior(e, length)[0]
        real = np.arange(len(e))[:, None] < length[None, :]
        score = (np.take_along_axis(e, tags.T[..., None], axis=2)[..., 0] * real).sum() + self.p["move"][tags.T[:-1], tags.T[1:]][real[1:]].sum()
        return float((total.sum() - score) / len(ids))

    def spans(self, windows: list[np.ndarray]) -> list[list[tuple[str, int, int, float]]]:
        """(kind, start, end, mean probability of its tags) of the best tagging of each window of characters."""
        out: list[list[tuple[str, int, int, float]]] = []
        for at in range(0, len(windows), 512):
            some = windows[at:at + 512]
            length = np.array([len(w) for w in some])
            ids = np.full((len(some), max(1, length.max())), PAD)
            for row, w in zip(ids, some, strict=True):
                row[:len(w)] = w
            e = self.emissions(ids)[0]
            tags, marginal = self.viterbi(e, length), self.posterior(e, length)[1]
            for n, row in enumerate(tags):
                found, t = [], 0
                while t < length[n]:
                    tag = row[t]
                    if tag % 2 == 0:
                        t += 1
                        continue
                    end = t + 1
                    while end < length[n] and row[end] == tag + 1:
                        end += 1
                    sure = float(np.mean([marginal[i, n, row[i]] for i in range(t, end)]))
                    found.append((KINDS[tag // 2], t, end, sure))
                    t = end
                out.append(found)
        return out


def encoded(examples: list[tuple[str, list[tuple[str, int, int]]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, tags = np.full((len(examples), WIDTH), PAD), np.zeros((len(examples), WIDTH), np.int64)
    length = np.array([len(text) for text, _ in examples])
    for n, (text, spans) in enumerate(examples):
        ids[n, :len(text)] = char_ids(text)
        for kind, start, end in spans:
            tags[n, start:end] = 2 + 2 * KINDS.index(kind)
            tags[n, start] -= 1
    return ids, tags, length


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return total % 10 == 0


def made_up(rng: random.Random) -> tuple[str, str]:
    """(kind, text) of one invented piece: personal data in usual and unusual writings, or ('', text) of something else."""
    digits = lambda n: "".join(rng.choices(string.digits, k=n))
    word = lambda a=2, b=9: "".join(rng.choices(string.ascii_lowercase, k=rng.randint(a, b)))
    kind = rng.choice(KINDS + ("", "", ""))
    if kind == "email":
        many = lambda marks: "".join(word(2, 12) + rng.choice(marks) for _ in range(rng.randint(1, 7))) + word(2, 12)
        name = rng.choice([word(), f"{word()}.{word()}", f"{word()}{digits(2)}", f"{word()}.{digits(2)}", f"{word()}_{word()}", f"{word().title()}+{word()}", many("."), many("._-")])
        host = rng.choice([f"{word()}.com", f"mail{digits(1)}.{word()}.org", f"{word()}-{word()}.co.uk", f"{word()}.example.com", many("..-") + ".edu", many("..-") + ".net"])
        at = rng.choice(["@", "@", "@", "@", " @ ", " @ ", "@ ", " @", " (at) ", "(at)", " [at] "])
        return kind, name + at + (host if at.strip() == "@" or rng.random() < 0.5 else host.replace(".", " [dot] " if "[" in at else " (dot) " if " " in at else "(dot)"))
    if kind == "ip":
        return kind, rng.choice([".", ".", ".", " . "]).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        body = digits(rng.choice([14, 15, 15, 15, 18]))
        number = body + next(x for x in string.digits if luhn(body + x))
        mark = rng.choice(["", "", " ", "-", ".", "/", "  "])
        return kind, mark.join(number[i:i + 4] for i in range(0, len(number), 4))
    if kind == "phone":
        a, b, c = str(rng.randint(200, 999)), digits(3), digits(4)
        code = rng.choice(["+1 ", "+44 ", "+49-", "+33 ", "", "", "00"])
        return kind, code + rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"{a}/{b}-{c}"])
    other = [lambda: f'token = "{"".join(rng.choices("0123456789abcdef", k=rng.randint(20, 40)))}"', lambda: f"Version {rng.randint(1, 12)}.{rng.randint(0, 20)}", lambda: f"{rng.randint(1, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 99)}", lambda: f"{rng.randint(1900, 2040)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", lambda: f"{rng.randint(0, 23):02}:{rng.randint(0, 59):02}", lambda: f"${rng.randint(1, 9999)}.{digits(2)}", lambda: digits(rng.randint(1, 12)), lambda: f"@{word()}", lambda: f"{word()} (at {word()})", lambda: f"{word()}.{word()}", lambda: f"({word()})", lambda: f"[{word()}]", lambda: f"{rng.randint(1, 31)}/{rng.randint(1, 12)}/{rng.randint(1990, 2030)}", lambda: f"{rng.randint(1, 999)},{digits(3)},{digits(3)}", lambda: f"sha1:{digits(3)}{word(20, 30)}", lambda: f"#{digits(4)}", lambda: f"{word()}{digits(2)}", lambda: f"CC BY-NC {rng.randint(1, 4)}.0", lambda: f"{digits(2)}.{digits(6)}", lambda: f"{digits(3)}-{digits(2)}"]
    return "", rng.choice(other)()


def labelled(n: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """n texts of up to WIDTH characters with labelled spans. Pieces may be cut by an edge, if LEAST_PART characters are left."""
    rng = random.Random(seed)
    letters = string.ascii_lowercase * 3 + "éèçêñáíóüäößа"
    out = []
    while len(out) < n:
        parts, spans, size = [], [], 0
        while size < 2 * WIDTH:
            if rng.random() < 0.3:
                kind, piece = made_up(rng)
            else:
                kind, piece = "", "".join(rng.choices(letters, k=rng.randint(1, 10)))
                piece = piece.title() if rng.random() < 0.15 else piece
            if kind:
                spans.append((kind, size, size + len(piece)))
            piece += rng.choice([" ", " ", " ", " ", "\n", ". ", ", ", "; ", ") ", " (", ": ", " | "])
            parts.append(piece)
            size += len(piece)
        text = "".join(parts)
        start = rng.choice([0, rng.randint(0, WIDTH)])
        end = start + rng.randint(WIDTH // 2, WIDTH)
        inside = [(k, max(a, start), min(b, end), b - a) for k, a, b in spans if a < end and b > start]
        if all(b - a >= min(LEAST_PART, size) for _, a, b, size in inside):
            out.append((text[start:end], [(k, a - start, b - start) for k, a, b, _ in inside]))
    return out
