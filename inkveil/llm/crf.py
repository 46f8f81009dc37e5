"""Linear-chain conditional random field over word shapes, in numpy.

A token is a run of digits, a run of letters or one other sign.  Its class is its word, where the labelled table holds that
word twice or more, else its shape; potentials are tables over the classes of a token, of its two neighbours on each side, of
neighbouring pairs, and of whether tokens touch.  Training maximises the penalised likelihood by forward and backward sums;
decoding is Viterbi over batches of sequences.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: O, then B and I of each kind.
LABELS = 1 + 2 * len(KINDS)
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
#: A longer line is cut into sequences before a plain word, or at this length.
LONGEST = 256
_LOW = -1e9


def tokens(line: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(line)]


def shape(token: str) -> str:
    n = len(token)
    if "0" <= token[0] <= "9":
        return "9" * n if n <= 6 else "9<13" if n < 13 else "9<20" if n < 20 else "9>19"
    if token.isalpha():
        case = "a" if token.islower() else "A" if token.isupper() else "Aa" if token.istitle() else "aA"
        return f"{case}{min(n, 4)}"
    return token if token.isascii() else "other"


@dataclass
class Model:
    classes: dict[str, int]  # "w:" words and "s:" shapes; 0 is the edge of a sequence, 1 any other class
    weights: dict[str, np.ndarray]
    moves: np.ndarray

    def class_of(self, token: str) -> int:
        return self.classes.get("w:" + token.lower()) or self.classes.get("s:" + shape(token), 1)


#: Potentials: offset of the first token, offset of the second (or none), and whether touching counts.
TABLES = {
    "own": (0, None), "before": (-1, None), "after": (1, None), "before2": (-2, None), "after2": (2, None),
    "pair": (-1, 0), "next": (0, 1), "skip": (-1, 1),
}


def _indexes(codes: np.ndarray, glued: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Row of each potential table for each place; ``codes`` (S, T) with 0 outside of the sequences."""
    wide = np.pad(codes, ((0, 0), (2, 2)))
    touch = np.pad(glued, ((0, 0), (0, 1))).astype(np.int64)
    at = lambda d: wide[:, 2 + d : wide.shape[1] - 2 + d]
    out = {k: at(a) if b is None else at(a) * n + at(b) for k, (a, b) in TABLES.items()}
    out["touch"] = (codes * 2 + touch[:, :-1]) * 2 + touch[:, 1:]
    return out


def _sizes(n: int) -> dict[str, int]:
    return {k: n if b is None else n * n for k, (_, b) in TABLES.items()} | {"touch": 4 * n}


def _packed(sequences: list[tuple[list[int], list[bool]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(c) for c, _ in sequences])
    codes = np.zeros((len(sequences), lengths.max()), dtype=np.int64)
    glued = np.zeros(codes.shape, dtype=bool)
    for i, (c, g) in enumerate(sequences):
        codes[i, : len(c)], glued[i, : len(c)] = c, g
    return codes, glued, lengths


def _allowed() -> np.ndarray:
    """Moves: I of a kind stands only behind B or I of it; the last row is the start."""
    out = np.zeros((LABELS + 1, LABELS))
    for k in range(len(KINDS)):
        begin, inside = 1 + 2 * k, 2 + 2 * k
        out[:, inside] = _LOW
        out[begin, inside] = out[inside, inside] = 0
    return out


def sequence_of(line: str, spans: list[tuple[int, int]]) -> tuple[list[str], list[bool]]:
    words = [line[a:b] for a, b in spans]
    return words, [i > 0 and spans[i - 1][1] == a for i, (a, _) in enumerate(spans)]


def train(lines: list[tuple[str, list[tuple[int, int, str]]]], penalty: float = 0.02, steps: int = 250, rate: float = 0.1) -> Model:
    """Fit to ``lines`` of text and labelled spans (begin, end, kind)."""
    words, glues, labels = [], [], []
    for text, marked in lines:
        spans = tokens(text)
        if not spans:
            continue
        tags = [0] * len(spans)
        for begin, end, kind in marked:
            inside = [i for i, (a, b) in enumerate(spans) if a >= begin and b <= end]
            for i in inside:
                tags[i] = (1 if i == inside[0] else 2) + 2 * KINDS.index(kind)
        w, g = sequence_of(text, spans)
        words.append(w), glues.append(g), labels.append(tags)
    often = Counter(t.lower() for w in words for t in w if t.isalpha())
    names = sorted({"s:" + shape(t) for w in words for t in w} | {"w:" + t for t, n in often.items() if n > 1})
    model = Model({name: i + 2 for i, name in enumerate(names)}, {}, _allowed())
    n = len(names) + 2
    codes, glued, lengths = _packed([([model.class_of(t) for t in w], g) for w, g in zip(words, glues)])
    truth = np.zeros(codes.shape, dtype=np.int64)
    for i, tags in enumerate(labels):
        truth[i, : len(tags)] = tags
    mask = np.arange(codes.shape[1]) < lengths[:, None]
    rows = {k: v[mask] for k, v in _indexes(codes, glued, n).items()}
    model.weights = {k: np.zeros((size, LABELS)) for k, size in _sizes(n).items()}
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in [*model.weights.items(), ("moves", model.moves)]}
    hot = np.eye(LABELS)[truth]
    free = model.moves > _LOW / 2
    seen_moves = np.zeros_like(model.moves)
    np.add.at(seen_moves, (np.full(len(truth), LABELS), truth[:, 0]), 1)
    both = mask[:, 1:]
    np.add.at(seen_moves, (truth[:, :-1][both], truth[:, 1:][both]), 1)
    for step in range(1, steps + 1):
        potential = emissions(model, codes, glued)
        place, move = _expected(potential, model.moves, mask)
        gap = (hot - place)[mask]
        gradients = {"moves": np.where(free, seen_moves - move - penalty * np.where(free, model.moves, 0), 0)}
        for k, row in rows.items():
            g = -penalty * model.weights[k]
            np.add.at(g, row, gap)
            gradients[k] = g
        for k, g in gradients.items():  # Adam, uphill
            first, second = state[k]
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            change = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            if k == "moves":
                model.moves = model.moves + change
            else:
                model.weights[k] += change
    return model


def emissions(model: Model, codes: np.ndarray, glued: np.ndarray) -> np.ndarray:
    n = len(model.classes) + 2
    return sum(model.weights[k][rows] for k, rows in _indexes(codes, glued, n).items())


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _expected(potential: np.ndarray, moves: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each label at each place, and the expected number of each move."""
    many, long, _ = potential.shape
    inner = moves[:-1]
    ahead, behind = np.zeros_like(potential), np.zeros_like(potential)
    ahead[:, 0] = potential[:, 0] + moves[-1]
    for t in range(1, long):
        new = _sum(ahead[:, t - 1, :, None] + inner, 1) + potential[:, t]
        ahead[:, t] = np.where(mask[:, t, None], new, ahead[:, t - 1])
    for t in range(long - 2, -1, -1):
        new = _sum(inner + (potential[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        behind[:, t] = np.where(mask[:, t + 1, None], new, 0)
    total = _sum(ahead[:, -1], 1)
    place = np.exp(ahead + behind - total[:, None, None])
    count = np.zeros_like(moves)
    count[-1] = place[:, 0].sum(axis=0)
    for t in range(1, long):
        both = ahead[:, t - 1, :, None] + inner + (potential[:, t] + behind[:, t])[:, None, :] - total[:, None, None]
        count[:-1] += np.exp(np.minimum(both, 0))[mask[:, t]].sum(axis=0)
    return place, count


def likelihood(model: Model, codes: np.ndarray, glued: np.ndarray, labels: np.ndarray) -> float:
    """Log likelihood of one labelled sequence (1, T)."""
    potential = emissions(model, codes, glued)
    score = potential[0, np.arange(labels.shape[1]), labels[0]].sum() + model.moves[-1, labels[0, 0]] + model.moves[labels[0, :-1], labels[0, 1:]].sum()
    ahead = potential[:, 0] + model.moves[-1]
    for t in range(1, potential.shape[1]):
        ahead = _sum(ahead[:, :, None] + model.moves[:-1], 1) + potential[:, t]
    return float(score - _sum(ahead, 1)[0])


def viterbi(model: Model, codes: np.ndarray, glued: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The most likely labels (S, T); ties to the smaller label.  Places behind a sequence's end carry no meaning."""
    potential = emissions(model, codes, glued)
    many, long, _ = potential.shape
    back = np.zeros((many, long, LABELS), dtype=np.int8)
    best = potential[:, 0] + model.moves[-1]
    for t in range(1, long):
        live = int(np.searchsorted(-lengths, -t, side="left"))  # sequences come longest first
        paths = best[:live, :, None] + model.moves[:-1]
        back[:live, t] = paths.argmax(axis=1)
        best[:live] = paths.max(axis=1) + potential[:live, t]
    out = np.zeros((many, long), dtype=np.int8)
    out[np.arange(many), lengths - 1] = best.argmax(axis=1)
    for t in range(long - 1, 0, -1):
        inside = np.flatnonzero(lengths > t)
        out[inside, t - 1] = back[inside, t, out[inside, t]]
    return out


def decode(model: Model, sequences: list[tuple[list[int], list[bool]]], at_once: int = 100_000) -> list[np.ndarray]:
    """Labels of each sequence of (class codes, touching flags), in batches of about ``at_once`` tokens."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i][0]))
    out: list = [None] * len(sequences)
    while order:
        n = max(1, at_once // len(sequences[order[0]][0]))
        batch, order = order[:n], order[n:]
        codes, glued, lengths = _packed([sequences[i] for i in batch])
        found = viterbi(model, codes, glued, lengths)
        for i, labels, length in zip(batch, found, lengths):
            out[i] = labels[:length]
    return out


def spans_of(labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, first token, last token) of the labelled runs."""
    out = []
    for i in np.flatnonzero(labels).tolist():
        kind, inside = divmod(int(labels[i]) - 1, 2)
        if inside and out and out[-1][0] == kind and out[-1][2] == i - 1:
            out[-1] = (kind, out[-1][1], i)
        else:
            out.append((kind, i, i))
    return out
