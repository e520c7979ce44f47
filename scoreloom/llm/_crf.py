"""Two-state linear-chain conditional random fields over the lines of a text, in numpy.

State 1 is good (content), state 0 bad (boilerplate). A line's inputs are what its bytes
show and the same of the lines beside it; nothing but the text is ever an input. Each input
is a step number, so a line's score is a sum of looked-up weights. With two states every
message is one number, the log odds; long texts are cut into segments that run side by side,
joined through what each segment makes of either state before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from . import _text as T

_CLASSES = (
    T.byte_set((ord("#"), ord("#")), (ord("*"), ord("*")), (ord("$"), ord("&")), (ord("<"), ord("<")), (ord(">"), ord(">"))),
    T.byte_set((ord("|"), ord("|"))),
    T.byte_set((ord("!"), ord("!"))),
    T.byte_set((ord("A"), ord("Z"))),
    T.byte_set((ord("a"), ord("z")), (0x80, 0xFF)),
    T.byte_set((ord("0"), ord("9"))),
    T.byte_set((ord("."), ord(".")), (ord(","), ord(",")), (ord(";"), ord(";")), (ord("?"), ord("?"))),
)
#: Upper ends of the steps into which a share or a length is cut.
_STEPS = {
    "share": (0.0, 0.02, 0.06, 0.12, 0.25, 0.5),
    "words": (0, 1, 3, 8, 20, 60, 200),
    "width": (2.5, 3.5, 4.5, 6.0, 8.0, 12.0),
    "flag": (0,),
}
_NAMES = ["share"] * len(_CLASSES) + ["share", "share", "words", "width", "flag", "flag", "flag"]
#: Where each input's steps begin among the weights: classes of bytes, repeated and echoed words, words, width, then three flags.
_BEGINS = np.concatenate([[0], np.cumsum([len(_STEPS[kind]) + 1 for kind in _NAMES])])
INPUTS = len(_NAMES)
OWN = int(_BEGINS[-1])
#: Weights of own inputs, of those of the lines before and after, and a constant.
WIDTH = 3 * OWN + 1
#: Lines of a segment.
SEGMENT = 512


@dataclass
class Lines:
    """Lines with a word, in text order."""

    doc: np.ndarray
    length: np.ndarray  # code points
    own: np.ndarray  # lines x INPUTS, places among the OWN weights
    n_docs: int


def _shown(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, code points, hash and inputs (flags still 0) of each line that has a word. Lines without one take no part."""
    words = T.spans(data, offsets, T.SPACE)
    ln = T.lines(data, offsets)
    of = np.searchsorted(ln.starts, words.starts, side="right") - 1
    # an empty line and the next one of another text may start at one place: take the last, which holds the word
    n_words = np.bincount(of, minlength=len(ln.starts))
    keep = np.flatnonzero(n_words > 0)
    own = np.zeros((len(keep), INPUTS), np.uint8)
    own[:] = _BEGINS[:-1]
    if not len(keep):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64), own
    place = np.full(len(ln.starts), -1)
    place[keep] = np.arange(len(keep))
    starts, ends, doc = ln.starts[keep], ln.ends[keep], ln.doc[keep]
    line_of = place[of]

    def count(of_byte: np.ndarray) -> np.ndarray:
        if len(keep) == 1:  # may be long
            return np.array([sum(int(of_byte[data[a : min(a + T.BLOCK_BYTES, ends[0])]].sum()) for a in range(int(starts[0]), int(ends[0]), T.BLOCK_BYTES))], float)
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(of_byte[data], out=total[1:])
        return (total[ends] - total[starts]).astype(float)

    length = count(T.LEAD)
    solid = np.maximum(count(T.LEAD & ~T.SPACE), 1)
    nw = n_words[keep].astype(float)
    key = T.hashes(T.LOWER[data], words.starts, words.ends)
    again, _ = T.seen_before(line_of, key)
    echo = np.zeros(len(key), bool)
    echo[1:] = (key[1:] == key[:-1]) & (line_of[1:] == line_of[:-1])
    columns = [count(c) / solid for c in _CLASSES]
    columns += [np.bincount(line_of, again, len(keep)) / nw, np.bincount(line_of, echo, len(keep)) / nw, nw, solid / nw]
    for j, values in enumerate(columns):
        own[:, j] += np.searchsorted(_STEPS[_NAMES[j]], values, side="left").astype(np.uint8)
    return doc, length.astype(np.int32), T.hashes(data, starts, ends), own


def _flags(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Lines x 3: an earlier line of the text is equal; the text's first line; its last."""
    out = np.zeros((len(doc), 3), bool)
    if len(doc):
        out[:, 0] = T.seen_before(doc, key)[0] if doc[0] != doc[-1] else T.repeated(key)
        apart = doc[1:] != doc[:-1]
        out[:, 1] = np.r_[True, apart]
        out[:, 2] = np.r_[apart, True]
    return out


def line_inputs(block: T.Block) -> Lines:
    """What each line that has a word shows."""
    doc, length, key, own = _shown(block.data, block.offsets)
    own[:, -3:] += _flags(doc, key).astype(np.uint8)
    return Lines(doc, length, own, len(block.offsets) - 1)


class Chain:
    """The segments of all texts' lines, and the steps over them: step t takes line t of all segments that have one."""

    def __init__(self, doc: np.ndarray, width: int = SEGMENT):
        begins = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, int)
        counts = np.diff(np.r_[begins, len(doc)])
        parts = -(-counts // width)
        self.number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        self.begins = np.repeat(begins, parts) + width * self.number
        self.counts = np.minimum(width, np.repeat(counts, parts) - width * self.number)
        self.last = np.r_[self.number[1:] == 0, True] if len(doc) else np.zeros(0, bool)
        self.ends = self.begins + self.counts - 1
        behind = np.flatnonzero(self.number > 0)
        behind = behind[np.argsort(self.number[behind], kind="stable")]
        #: segments behind another one of their text, by their number
        self.rounds = np.split(behind, np.flatnonzero(np.diff(self.number[behind])) + 1) if len(behind) else []

    def steps(self, which: np.ndarray | None = None, back: bool = False) -> Iterator[tuple[int, np.ndarray]]:
        """(t, segments with a line t), of the segments `which`; with back from the segments' ends on."""
        which = np.arange(len(self.counts)) if which is None else which
        counts = self.counts[which]
        order = np.argsort(-counts, kind="stable")
        which, counts = which[order], counts[order]
        alive = len(counts) - np.searchsorted(counts[::-1], np.arange(int(counts.max(initial=0))), side="right")
        for t, n in enumerate(alive):
            at = which[:n]
            yield t, (self.ends[at] - t if back else self.begins[at] + t), at


def _through(z, chain: Chain, move, add) -> tuple[np.ndarray, np.ndarray]:
    """For segments behind another: the scores (2 x segments) that either state before them leads to, of state 0 at their end, and the log odds of 1 there."""
    behind = np.flatnonzero(chain.number > 0)
    c, r = np.zeros((2, len(chain.counts))), np.zeros((2, len(chain.counts)))
    for t, at, s in chain.steps(behind):
        for a in (0, 1):
            if t:
                zero, one = add(move[0, 0], r[a, s] + move[1, 0]), add(move[0, 1], r[a, s] + move[1, 1])
                c[a, s] += zero
                r[a, s] = z[at] + one - zero
            else:
                c[a, s], r[a, s] = move[a, 0], z[at] + move[a, 1] - move[a, 0]
    return c, r


def _forward(z, chain: Chain, move, add, through) -> np.ndarray:
    """Log odds of state 1 at each line, given it and the lines before it (add=np.maximum: of the best paths there)."""
    r, into = np.empty(len(z)), np.zeros(len(chain.counts))

    def run(which: np.ndarray | None) -> None:
        for t, at, s in chain.steps(which):
            before = r[at - 1] if t else into[s]
            r[at] = z[at] + add(move[0, 1], before + move[1, 1]) - add(move[0, 0], before + move[1, 0])
            if not t:
                first = chain.number[s] == 0
                r[at[first]] = z[at[first]]

    if chain.rounds:
        heads = np.flatnonzero((chain.number == 0) & ~chain.last)
        run(heads)
        c, out = through
        here = np.zeros(len(chain.counts))  # at each segment's end
        here[heads] = r[chain.ends[heads]]
        for s in chain.rounds:
            before = into[s] = here[s - 1]
            here[s] = add(c[0, s] + out[0, s], before + c[1, s] + out[1, s]) - add(c[0, s], before + c[1, s])
    run(None)
    return r


def _backward(z, chain: Chain, move, through) -> np.ndarray:
    """Log odds of state 1 at each line by the lines after it."""
    out, after = np.empty(len(z)), np.zeros(len(chain.counts))
    if chain.rounds:
        c, r = through
        for s in reversed(chain.rounds):
            # what the segments s say of the line before them
            after[s - 1] = (c[1, s] + np.logaddexp(0, r[1, s] + after[s])) - (c[0, s] + np.logaddexp(0, r[0, s] + after[s]))
    for t, at, s in chain.steps(back=True):
        if t:
            ahead = out[at + 1] + z[at + 1]
            out[at] = np.logaddexp(move[1, 0], ahead + move[1, 1]) - np.logaddexp(move[0, 0], ahead + move[0, 1])
        else:
            out[at] = after[s]
    return out


def _odds(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def marginals(z: np.ndarray, doc: np.ndarray, move: np.ndarray, width: int = SEGMENT) -> np.ndarray:
    """Probability of state 1 at each line. z: score of 1 against 0. move[a, b]: score of b after a."""
    chain = Chain(doc, width)
    through = _through(z, chain, move, np.logaddexp)
    r = _forward(z, chain, move, np.logaddexp, through)
    r += _backward(z, chain, move, through)
    return _odds(r)


def forward_backward(z: np.ndarray, doc: np.ndarray, move: np.ndarray, width: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of state 1, pair marginals (2 x 2, summed) and the sum of all texts' log partitions."""
    chain = Chain(doc, width)
    through = _through(z, chain, move, np.logaddexp)
    r = _forward(z, chain, move, np.logaddexp, through)
    s = _backward(z, chain, move, through)
    inner = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, int)
    ahead = z[inner + 1] + s[inner + 1]
    four = np.stack([np.full(len(inner), move[0, 0]), move[0, 1] + ahead, r[inner] + move[1, 0], r[inner] + move[1, 1] + ahead])
    four = np.exp(four - four.max(0, initial=-np.inf, keepdims=True)) if len(inner) else four
    pairs = (four / four.sum(0)).sum(1).reshape(2, 2)
    ends = np.flatnonzero(np.r_[doc[1:] != doc[:-1], True]) if len(doc) else np.zeros(0, int)
    log_z = np.logaddexp(move[0, 0], r[inner] + move[1, 0]).sum() + np.logaddexp(0, r[ends]).sum()
    return _odds(r + s), pairs, float(log_z)


def viterbi(z: np.ndarray, doc: np.ndarray, move: np.ndarray, width: int = SEGMENT) -> np.ndarray:
    """The likeliest states; ties go to state 1."""
    chain = Chain(doc, width)
    r = _forward(z, chain, move, np.maximum, _through(z, chain, move, np.maximum))
    # the state of each line if its segment ends in 0 or in 1
    state = np.zeros((2, len(z)), np.int8)
    for t, at, _ in chain.steps(back=True):
        for end in (0, 1):
            state[end, at] = _before(r[at], state[end, at + 1], move) if t else end
    chosen = np.zeros(len(chain.counts), np.int8)
    tails = chain.ends[chain.last]
    chosen[chain.last] = r[tails] >= 0
    for s in reversed(chain.rounds):
        chosen[s - 1] = _before(r[chain.ends[s - 1]], np.where(chosen[s] == 1, state[1, chain.begins[s]], state[0, chain.begins[s]]), move)
    return np.where(np.repeat(chosen, chain.counts) == 1, state[1], state[0])


def _before(r: np.ndarray, ahead: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best state of lines with log odds r, before a line of state `ahead`."""
    return np.where(ahead == 1, r + move[1, 1] >= move[0, 1], r + move[1, 0] >= move[0, 0])


@dataclass
class Model:
    weights: np.ndarray  # WIDTH, for state 1 against 0
    move: np.ndarray  # 2 x 2
    scale: float = 1.0  # of the log odds of a text's mean marginal
    shift: float = 0.0
    prior: float = 0.5  # of texts without lines

    def parts(self, own: np.ndarray) -> np.ndarray:
        """3 x lines: what each line adds to its own score, to the next line's and to that of the line before."""
        return np.stack([sum((w[own[:, j]] for j in range(own.shape[1])), np.zeros(len(own), np.float32)) for w in self.weights[:-1].astype(np.float32).reshape(3, OWN)])

    def joined(self, parts: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Scores of all lines."""
        z = parts[0].astype(float) + self.weights[-1]
        if len(doc) > 1:
            same = doc[1:] == doc[:-1]
            z[1:] += parts[1, :-1] * same
            z[:-1] += parts[2, 1:] * same
        return z

    def emit(self, lines: Lines) -> np.ndarray:
        return self.joined(self.parts(lines.own), lines.doc)


@dataclass
class Scored:
    """Lines with a word: text, code points, score, and whether an earlier line of the text is equal."""

    doc: np.ndarray
    length: np.ndarray
    z: np.ndarray
    again: np.ndarray
    n_docs: int


def scored(block: T.Block, model: Model, limit: int = T.BLOCK_BYTES) -> Scored:
    """The lines of a block. One long text is read in pieces of whole lines, of which only a few numbers a line are kept."""
    n = len(block.offsets) - 1
    if n != 1 or len(block.data) <= limit:
        lines = line_inputs(block)
        return Scored(lines.doc, lines.length, model.emit(lines), lines.own[:, -3] > _BEGINS[INPUTS - 3], n)
    parts, lengths, keys = [], [], []
    for a, b in T.pieces(block.data, T.BREAK, limit):
        _, length, key, own = _shown(block.data[a:b], np.array([0, b - a], np.int64))
        parts.append(model.parts(own))
        lengths.append(length)
        keys.append(key)
    part, length, key = np.concatenate(parts, 1), np.concatenate(lengths), np.concatenate(keys)
    del parts, lengths, keys
    doc = np.zeros(len(length), np.int8)
    flags = _flags(doc, key)
    del key
    weights = model.weights[:-1].astype(np.float32).reshape(3, OWN)
    for j in range(3):
        for k in range(3):
            at = _BEGINS[INPUTS - 3 + k]
            part[j] += np.where(flags[:, k], weights[j, at + 1] - weights[j, at], 0)
    return Scored(doc, length, model.joined(part, doc), flags[:, 0], n)


def weighted_mean(lines: Lines | Scored, value: np.ndarray, empty: float) -> np.ndarray:
    """By text, weighted by the lines' lengths."""
    total = np.bincount(lines.doc, lines.length, lines.n_docs)
    return np.where(total > 0, np.bincount(lines.doc, lines.length * value, lines.n_docs) / np.maximum(total, 1), empty)


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def text_score(model: Model, lines: Lines | Scored) -> np.ndarray:
    """Probability-like score of each text from its length-weighted marginals."""
    z = model.emit(lines) if isinstance(lines, Lines) else lines.z
    mean = weighted_mean(lines, marginals(z, lines.doc, model.move), model.prior)
    return 1 / (1 + np.exp(-np.clip(model.scale * log_odds(mean) + model.shift, -60, 60)))


def fit(lines: Lines, target: np.ndarray, pairs: np.ndarray | None = None, start: Model | None = None, rounds: int = 160, rate: float = 0.12, ridge: float = 2e-3) -> Model:
    """Adam on the mean negative log likelihood of a line. target: wanted probability of state 1 of each line; pairs: wanted counts of neighbours' states (2 x 2), those of targets of 0 and 1 if not given."""
    doc, own, n = lines.doc, lines.own, max(len(lines.doc), 1)
    y = target.astype(float)
    inner = np.flatnonzero(doc[1:] == doc[:-1]) if n > 1 else np.zeros(0, int)
    if pairs is None:
        pairs = np.bincount((2 * y[inner] + y[inner + 1]).astype(int), minlength=4).reshape(2, 2).astype(float)
    theta = np.zeros(WIDTH + 4) if start is None else np.r_[start.weights, start.move.ravel()]
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    best, best_loss = theta.copy(), np.inf
    for i in range(1, rounds + 1):
        model = Model(theta[:WIDTH], theta[WIDTH:].reshape(2, 2))
        z = model.emit(lines)
        good, moved, log_z = forward_backward(z, doc, model.move)
        loss = (log_z - (z * y).sum() - (pairs * model.move).sum()) / n + ridge * (theta[: WIDTH - 1] ** 2).sum() / 2
        if loss < best_loss:
            best, best_loss = theta.copy(), loss
        g = good - y
        slope = np.zeros((3, OWN))
        for j in range(own.shape[1]):
            slope[0] += np.bincount(own[:, j], g, OWN)
            slope[1] += np.bincount(own[inner, j], g[inner + 1], OWN)
            slope[2] += np.bincount(own[inner + 1, j], g[inner], OWN)
        gradient = np.r_[slope.ravel(), g.sum(), (moved - pairs).ravel()] / n
        gradient[: WIDTH - 1] += ridge * theta[: WIDTH - 1]
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        theta = theta - rate * (1 - i / (rounds + 1)) * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-8)
    return Model(best[:WIDTH], best[WIDTH:].reshape(2, 2))


def fit_texts(lines: Lines, label: np.ndarray) -> Model:
    """label: 0 or 1 of each text, which all its lines take."""
    model = fit(lines, label[lines.doc])
    model.prior = float((label.sum() + 1) / (len(label) + 2))
    return calibrate(model, lines, label)


#: Log odds by which a text's label speaks for each of its lines.
BAG = 1.5


def fit_bags(lines: Lines, label: np.ndarray, rounds: int = 3, bag: float = BAG) -> Model:
    """A field of lines from labels of texts: a text's label is a hint on each of its lines, not their label.

    What a line alone shows, learned from the lines of all texts and freed of the share of
    good ones, weighs against `bag` log odds for its text's label: so a line like those of bad
    texts is boilerplate in a good text too, and the other way round. Expectation: states of
    all lines by that evidence and the moves of the field so far; maximisation: a field that
    fits these states and moves.
    """
    alone = Lines(np.arange(len(lines.doc)), lines.length, lines.own.copy(), len(lines.doc))
    alone.own[:, -3:] = _BEGINS[INPUTS - 3 : INPUTS]  # a line alone has no place in its text
    y = label[lines.doc].astype(float)
    model = fit(alone, y, rounds=100)
    model.move = np.zeros((2, 2))
    evidence = model.emit(alone) - np.log((y.sum() + 1) / (len(y) - y.sum() + 1)) + np.where(y == 1, bag, -bag)
    for _ in range(rounds):
        # what is likelier than not is taken as such, so that the rounds settle
        target = marginals(evidence, lines.doc, model.move) >= 0.5
        model = fit(lines, target, rounds=80)
    model.prior = float((label.sum() + 1) / (len(label) + 2))
    return model


def calibrate(model: Model, lines: Lines, label: np.ndarray) -> Model:
    """Scale and shift (Newton steps of a ridge logistic fit) of the log odds of the texts' mean marginals."""
    z, y = log_odds(weighted_mean(lines, marginals(model.emit(lines), lines.doc, model.move), model.prior)), label.astype(float)
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        w, g = p * (1 - p) + 1e-9, p - y
        h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, [(g * z).sum() + (a - 1), g.sum()])
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    if not (np.isfinite(a) and np.isfinite(b) and a > 0):
        a, b = 1.0, 0.0
    model.scale, model.shift = float(a), float(b)
    return model
