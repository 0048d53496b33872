"""A causal self-attention model over classes of subword ids, in numpy."""

from __future__ import annotations

from itertools import pairwise

import numpy as np

#: classes of ids: the most frequent have one each, the rest share the last by bands of frequency
OWN, SHARED = 112, 16
CLASSES = OWN + SHARED
START, PAD = CLASSES, CLASSES + 1
#: what stands before a token is known by itself if it is among the most frequent ids, else by its class
KNOWN = 1024
SYMBOLS = KNOWN + CLASSES + 2
#: a window scores the last ``STRIDE`` tokens and sees ``CONTEXT`` more before them
CONTEXT, STRIDE = 8, 24
SPAN = CONTEXT + STRIDE
#: windows at once, and tokens whose outputs a core's cache holds
BATCH, ROWS = 64, 256
HEADS, WIDE, VALUE, HIDDEN = 1, 8, 16, 24
#: numbers of the model that are trained, by name and shape
SHAPES = {
    "embed": (CLASSES + 2, 16),
    "query": (16, HEADS * WIDE),
    "key": (16, HEADS * WIDE),
    "value": (16, HEADS * VALUE),
    "near": (HEADS, SPAN),
    "mix": (HEADS * VALUE, HIDDEN),
    "skip": (CLASSES + 2, HIDDEN),
    "out": (HIDDEN, CLASSES),
}
ENDS = np.cumsum([0, *(np.prod(s) for s in SHAPES.values())]).tolist()
SIZE, PLACES = ENDS[-1], dict(zip(SHAPES, pairwise(ENDS), strict=True))
LOW = np.float32(-1e4)


def classes_of(counts: np.ndarray) -> np.ndarray:
    """Class of every id by how often it occurs; the rare ones are dealt so that shared classes weigh about the same."""
    order = np.argsort(-counts, kind="stable")
    rest = order[OWN:]
    mass = counts[rest] + 1  # unseen ids have a place too
    before = np.cumsum(mass) - mass
    out = np.empty(len(counts), np.uint8)
    out[order[:OWN]] = np.arange(min(OWN, len(order)))
    out[rest] = OWN + np.minimum(SHARED - 1, before * SHARED // max(1, mass.sum()))
    return out


def windows(classes: np.ndarray, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Many texts that lie one after the other, laid out for windows: ``CONTEXT`` paddings, a text's inputs (each token's place
    holds the class before it), paddings to a whole number of strides, so that no window reaches into another text. Returns the
    inputs as classes and as symbols, the targets (-1: none), where each window begins, and the place of every token."""
    count = -(-lengths // STRIDE)
    room = np.where(lengths > 0, CONTEXT + STRIDE * count, 0)
    base = np.cumsum(room) - room
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(classes)) + np.repeat(base + CONTEXT - first, lengths)
    inputs, before, targets = (np.full(int(room.sum()), x, np.intp) for x in (PAD, KNOWN + PAD, -1))
    inputs[place[1:]], before[place[1:]] = classes[:-1], symbols[:-1]
    starts = (base + CONTEXT)[lengths > 0]
    inputs[starts], before[starts] = START, KNOWN + START
    targets[place] = classes
    begin = np.repeat(base, count) + STRIDE * (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))
    return inputs, before, targets, begin, place


def views(of: np.ndarray, size: int) -> np.ndarray:
    """Every window of so many that follow each other, without a copy."""
    return np.lib.stride_tricks.sliding_window_view(of, size)


def parted(params: np.ndarray) -> dict[str, np.ndarray]:
    """The numbers of the model by name, without a copy."""
    return {name: params[begin:end].reshape(SHAPES[name]) for name, (begin, end) in PLACES.items()}


def by_class(classes: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    """Sums of the parts' rows, side by side, of each class."""
    classes = classes.astype(np.uint8)
    rows = np.concatenate(parts, 1).take(classes.argsort(kind="stable"), 0)
    count = np.bincount(classes, minlength=CLASSES + 2)
    out, there = np.zeros((CLASSES + 2, rows.shape[1]), np.float32), np.flatnonzero(count)
    out[there] = np.add.reduceat(rows, (np.cumsum(count) - count)[there], 0)
    return out


class Attention:
    """One layer: every token looks back over its window, by what the tokens are and how far off they lie;
    what it brings and the token before give a hidden layer, whose output is added to ``direct``, the
    corpus's own log-odds of a class behind the token before."""

    def __init__(self, direct: np.ndarray, params: np.ndarray | None = None, seed: int = 7):
        self.direct = direct.astype(np.float32)
        self.odds = np.exp(self.direct)
        self.looked = [np.ones((HEADS, CLASSES + 2, n + 1), np.float32) for n in (WIDE, WIDE, VALUE)]
        self.room = np.empty((2, ROWS, CLASSES), np.float32)
        self.line, self.one = np.arange(ROWS), np.ones(CLASSES, np.float32)
        if params is None:
            rng = np.random.default_rng(seed)
            params = np.concatenate([(np.zeros(s) if n in ("out", "near") else rng.normal(0, s[0] ** -0.5 if n in ("query", "key", "value", "mix") else 0.3, s)).ravel() for n, s in SHAPES.items()])
        self.params = params.astype(np.float32)
        self.moments = np.zeros_like(self.params), np.zeros_like(self.params), 0
        for name, part in parted(self.params).items():
            setattr(self, name, part)
        distance = np.arange(CONTEXT, SPAN)[:, None] - np.arange(SPAN)  # of a scored token's input and those it sees
        self.distance = np.maximum(distance, 0)
        self.causal = distance >= 0
        self.apart = (distance.ravel()[:, None] == np.arange(SPAN)).astype(np.float32)

    def tables(self) -> None:
        """Queries, keys and values of every class, so that a token's are looked up."""
        table = lambda m, d: (self.embed @ m).reshape(CLASSES + 2, HEADS, d)
        self.q, self.k, self.v = table(self.query, WIDE) / np.float32(WIDE**0.5), table(self.key, WIDE), table(self.value, VALUE)

    def ready(self) -> None:
        """What can be looked up made before: the masked bias as a factor, paddings as a component of the keys, the weights' sum as a
        component of the values."""
        self.tables()
        # no score exceeds the bound, so that exponentials need no running maximum
        bound = np.abs(self.q).sum(2).max() * np.abs(self.k).max()
        for looked, own in zip(self.looked, (self.q, self.k, self.v), strict=True):
            looked[:, :, :-1] = own.transpose(1, 0, 2)
        self.looked[1][:, :, -1] = min(0.0, 40 - bound)
        self.looked[1][:, PAD, -1] = LOW
        self.factor = np.exp(self.near - self.near.max(1, keepdims=True))[:, self.distance] * self.causal

    def attend(self, seen: np.ndarray, before: np.ndarray):
        """Of some windows: by head queries, keys, values, weights and their sums; what the heads bring; the hidden layer."""
        heads, parts = np.empty((len(before), HEADS * VALUE), np.float32), []
        for h in range(HEADS):
            q, k, v = (x[h] for x in self.looked)
            q, k, v = q.take(before, 0).reshape(len(seen), STRIDE, -1), k.take(seen, 0), v.take(seen, 0)
            w = q @ k.transpose(0, 2, 1)
            np.exp(w, out=w)
            w *= self.factor[h]
            got = (w @ v).reshape(len(before), VALUE + 1)
            np.divide(got[:, :VALUE], got[:, VALUE:], out=heads[:, h * VALUE : (h + 1) * VALUE])
            parts.append((q, k, v, w, got[:, VALUE:]))
        hidden = heads @ self.mix
        hidden += self.skip.take(before, 0)
        return parts, heads, np.maximum(hidden, 0, out=hidden)

    def shares(self, hidden: np.ndarray, symbols: np.ndarray, targets: np.ndarray | None):
        """Of ``ROWS`` tokens at most: the classes' probabilities before they are divided by their sum, that sum, and the targets' log-probabilities
        if there are targets."""
        out, odd = self.room[0, : len(hidden)], self.room[1, : len(hidden)]
        self.odds.take(symbols, 0, out=odd, mode="clip")
        for most in (False, True):  # a running maximum only where exponentials need it
            np.matmul(hidden, self.out, out=out)
            if most:
                out -= out.max(1, keepdims=True)
            own = None if targets is None else out[self.line[: len(hidden)], targets] + self.direct[symbols, targets]
            np.exp(out, out=out)
            out *= odd
            total = out @ self.one
            if 1e-30 < total.min() and total.max() < 1e30:
                break
        return out, total, None if own is None else own - np.log(total)

    @np.errstate(over="ignore", invalid="ignore")
    def log_probs(self, classes: np.ndarray, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural log-probability of every token's class, each scored in one window, many windows at once."""
        self.ready()
        inputs, last, targets, begin, place = windows(classes, symbols, lengths)
        found = np.zeros(len(inputs))
        shown, ahead = views(inputs, SPAN), np.arange(CONTEXT, SPAN)
        for at in range(0, len(begin), BATCH):
            b = begin[at : at + BATCH]
            seen, scored = shown[b], (b[:, None] + ahead).ravel()
            hidden = self.attend(seen, seen[:, CONTEXT:].ravel())[2]
            for row in range(0, len(scored), ROWS):
                each = scored[row : row + ROWS]
                found[each] = self.shares(hidden[row : row + ROWS], last[each], np.maximum(targets[each], 0))[2]
        return found[place]

    @np.errstate(over="ignore", invalid="ignore")
    def gradient(self, seen: np.ndarray, symbols: np.ndarray, targets: np.ndarray, told: bool = True) -> tuple[np.ndarray, float]:
        """Of the mean negative log-probability of the targets (below 0: none), by all parameters; and that mean, if it is to be ``told``."""
        self.ready()
        before, symbols, there, targets = seen[:, CONTEXT:].ravel(), symbols.ravel(), targets.ravel() >= 0, np.maximum(targets.ravel(), 0)
        grads = np.zeros_like(self.params)
        g = parted(grads)
        parts, heads, hidden = self.attend(seen, before)
        n, loss, back = max(1, int(there.sum())), 0.0, np.empty_like(hidden)
        part, share, scale = there.astype(np.float32) / np.float32(n), np.empty_like(hidden), np.empty((len(hidden), 1), np.float32)
        for at in range(0, len(before), ROWS):
            row = slice(at, at + ROWS)
            out, total, own = self.shares(hidden[row], symbols[row], targets[row] if told else None)
            loss -= float(own[there[row]].sum()) / n if told else 0.0
            # what the differences to the targets bring is scaled, not they themselves
            out.ravel()[self.line[: len(out)] * CLASSES + targets[row]] -= total
            np.divide(part[row], total, out=scale[row, 0])
            np.multiply(hidden[row], scale[row], out=share[row])
            g["out"] += share[row].T @ out
            np.matmul(out, self.out.T, out=back[row])
        # also 0 where the hidden layer is
        back *= (hidden > 0) * scale
        np.matmul(heads.T, back, out=g["mix"])
        d_heads = back @ self.mix.T
        asked, shown = [back], []
        for h, (q, k, v, w, whole) in enumerate(parts):
            own = slice(h * VALUE, (h + 1) * VALUE)
            d = np.empty((len(before), VALUE + 1), np.float32)
            np.divide(d_heads[:, own], whole, out=d[:, :VALUE])
            np.negative(np.einsum("ij,ij->i", d[:, :VALUE], heads[:, own]), out=d[:, VALUE])
            d = d.reshape(len(seen), STRIDE, VALUE + 1)
            d_s = d @ v.transpose(0, 2, 1)
            d_s *= w
            g["near"][h] = d_s.sum(0).ravel() @ self.apart
            asked.append((d_s @ k).reshape(-1, WIDE + 1)[:, :WIDE])
            shown += [(d_s.transpose(0, 2, 1) @ q).reshape(-1, WIDE + 1)[:, :WIDE], (w.transpose(0, 2, 1) @ d).reshape(-1, VALUE + 1)[:, :VALUE]]
        asked, shown = by_class(before, asked), by_class(seen.ravel(), shown)
        g["skip"][:] = asked[:, :HIDDEN]
        both = shown.reshape(-1, HEADS, WIDE + VALUE)
        for name, d in (("query", asked[:, HIDDEN:] / np.float32(WIDE**0.5)), ("key", both[:, :, :WIDE]), ("value", both[:, :, WIDE:])):
            d = d.reshape(CLASSES + 2, -1)
            np.matmul(self.embed.T, d, out=g[name])
            g["embed"] += d @ getattr(self, name).T
        return grads, loss

    def train(self, classes: np.ndarray, symbols: np.ndarray, lengths: np.ndarray, fresh: np.ndarray, rate: float = 0.01, epochs: int = 1, seed: int = 3) -> Attention:
        """Adam over the windows of some pieces of texts, in an order that the seed gives, its moments as earlier pieces left them. Every token is
        learnt, but of pieces that are not ``fresh``, the later ones of a text, the first is seen alone: the piece before ends with it."""
        inputs, last, targets, begin, place = windows(classes, symbols, lengths)
        targets[place[(np.cumsum(lengths) - lengths)[(lengths > 0) & ~fresh]]] = -1
        shown, last, targets = views(inputs, SPAN), views(last, STRIDE), views(targets, STRIDE)
        rng = np.random.default_rng(seed)
        m, s, step = self.moments
        for _ in range(epochs):
            order = rng.permutation(len(begin))
            for at in range(0, len(order), BATCH):
                b = begin[order[at : at + BATCH]]
                grad, _ = self.gradient(shown[b], last[b + CONTEXT], targets[b + CONTEXT], told=False)
                step += 1
                m += 0.1 * (grad - m)
                s += 0.01 * (grad * grad - s)
                self.params -= np.float32(rate) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
        self.moments = m, s, step
        return self
