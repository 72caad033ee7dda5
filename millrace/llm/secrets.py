"""Secrets in texts: three fixed patterns, and a character convolutional network that judges every other candidate.

Base findings, by pattern, leftmost and not overlapping within a kind: ``assign`` (a telling name, a colon or equals sign and a
value of 8 characters or more), ``access`` (key ids of 16 characters or more) and ``hex`` (32 digits or more).

The method: a candidate is a run of 8 or more of ``A-Za-z0-9+/_.-`` that has a digit or a capital after a small letter, from its
first to its last letter or digit, with up to two ``=`` after it. The net reads the candidate, ``LEFT`` bytes before and
``RIGHT`` after it (bytes as symbols, nothing beyond the text): a convolution of ``WIDTH`` symbols and ``FILTERS`` filters, their
largest values over the candidate and over its surroundings and their means over the candidate, a hidden layer, a logistic
unit. It scores candidates of any length whole, as maxima and sums add up over stretches. Its scores are calibrated by a
logistic fit on findings it did not learn from, and every shape of value (digits, hexadecimal, capitals and digits, mixed) gets
a threshold at which ``RECALL`` of those labelled true are still found, with the fewest false ones. Candidates at or above it that no base
finding touches become findings of kind ``learned``; base findings always stay.

Labelled findings: all distinct candidates of the corpus by what the net reads (copies count once; readings of up to ``READ``
bytes), true if a base pattern holds them, else false unless a first net doubts that; and ``MADE`` made ones of either label,
which show values outside the patterns: key-like values of published formats after other names, and addresses, numbers, dates,
versions, paths and names as false ones. A net that has learned from the made ones goes on by ``ROUNDS`` steps; each adds up, in
Spark tasks, the gradient over all findings that are not held out. Calibration and thresholds come from counts of all findings
held out, by steps of 1/``FINE`` of the logit. The corpus weighs at most ``SHARE`` times as much as the made ones of a label,
by a smaller weight for each of its findings. Only sums and counts reach the driver.

Defined cases: null and empty texts have no findings; without candidates in the corpus the net learns from made findings alone;
equal texts get equal findings; rows are judged one by one, so null and repeated doc_id need no care; findings never cross
rows. Of findings that start at one place the order is assign, access, hex, learned. An empty table gives no rows. Extra
columns pass through; a new column whose name is taken gets a trailing underscore.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import text as tx
from millrace.plans.checkpoints import cut, release

KINDS = ("assign", "access", "hex", "learned")
# The patterns of the base findings; assign is matched in lower-cased text.
ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
VALUE, ACCESS_ID, HEX_DIGITS = 8, 16, 32

LEFT, RIGHT, SHORTEST, READ = 24, 8, 8, 1 << 16
MADE, SHARE, RECALL = 1500, 2, 0.97
FILTERS, WIDTH, HIDDEN = 16, 5, 16
STEPS, BATCH, RATE = 300, 128, 0.01
#: Steps over all findings, and parts of a unit by which their logits (from -LIMIT to LIMIT) are counted.
ROUNDS, FINE, LIMIT = 12, 64, 32
#: Rows of the convolution that are held at once.
ROWS = 1 << 16

_bytes = lambda s: np.isin(np.arange(256), np.frombuffer(s.encode(), np.uint8))
HEX, DIGIT, UPPER, LOWER = _bytes("0123456789abcdef"), _bytes(string.digits), _bytes(string.ascii_uppercase), _bytes(string.ascii_lowercase)
CORE = DIGIT | UPPER | LOWER
RUN = CORE | _bytes("+/_.-")
#: 0 is what lies outside; bytes beyond ASCII are one symbol.
SYMBOL = np.minimum(np.arange(256), 128) + 1
SYMBOLS = 130


def base(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind, start and end of the base findings in a run of texts, each closed by a newline."""
    found = [(0, m.start(), m.end()) for m in ASSIGN.finditer(tx.LOWER[data].tobytes()) if m.end() - m.start(1) >= VALUE]
    found += [(1, m.start(), m.end()) for m in ACCESS.finditer(data.tobytes()) if m.end() - m.start() >= ACCESS_ID]
    starts, ends = tx.words(data, HEX)
    long = ends - starts >= HEX_DIGITS
    found += [(2, int(s), int(e)) for s, e in zip(starts[long], ends[long], strict=True)]
    kind, start, end = np.array(found, np.int64).reshape(-1, 3).T
    order = np.lexsort((kind, start))
    return kind[order], start[order], end[order]


def candidates(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the candidates."""
    starts, ends = tx.words(data, RUN)
    some = ends - starts >= SHORTEST
    starts, ends = starts[some], ends[some]
    if not len(starts):
        return starts, ends
    at = np.arange(len(data))
    core = CORE[data]
    last = np.maximum.accumulate(np.where(core, at, -1))
    after = np.minimum.accumulate(np.where(core, at, len(data))[::-1])[::-1]
    starts, ends = np.maximum(starts, after[starts]), np.minimum(ends, last[ends - 1] + 1)
    turn = DIGIT[data]
    turn[1:] |= UPPER[data[1:]] & LOWER[data[:-1]]
    turns = np.concatenate(([0], np.cumsum(turn)))
    # a turn at the very start is only one if it is a digit
    marks = np.where(ends > starts, turns[np.maximum(ends, starts)] - turns[starts] - (turn[starts] & ~DIGIT[data[starts]]), 0)
    some = (ends - starts >= SHORTEST) & (marks > 0)
    starts, ends = starts[some], ends[some]
    for _ in range(2):
        ends = ends + (data[ends] == ord("="))
    return starts, ends


def held(starts: np.ndarray, ends: np.ndarray, base_starts: np.ndarray, base_ends: np.ndarray) -> np.ndarray:
    """Whether each candidate touches a base finding; these come sorted by start."""
    if not len(base_starts):
        return np.zeros(len(starts), bool)
    reach = np.maximum.accumulate(base_ends)
    before = np.searchsorted(base_starts, ends) - 1  # the last one that starts before the candidate's end
    return (before >= 0) & (reach[np.maximum(before, 0)] > starts)


def read(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all readings, each with WIDTH - 1 symbols from outside round it, and their lengths. low, high: the bounds of
    each candidate's text."""
    n = LEFT + ends - starts + RIGHT
    padded = n + WIDTH - 1
    origin = starts - LEFT - WIDTH // 2
    at = np.arange(padded.sum()) + np.repeat(origin - (np.cumsum(padded) - padded), padded)
    inside = (at >= np.repeat(np.maximum(low, starts - LEFT), padded)) & (at < np.repeat(np.minimum(high, ends + RIGHT), padded))
    return np.where(inside, SYMBOL[data[np.clip(at, 0, len(data) - 1)]], 0), n


@dataclass
class Net:
    weights: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    thresholds: tuple[float, ...] = (0.5,) * 4

    def convolve(self, symbols: np.ndarray) -> np.ndarray:
        rows = len(symbols) - WIDTH + 1
        y = np.repeat(self.weights["b"][None], rows, 0)
        for k in range(WIDTH):
            y += self.weights["T"][k][symbols[k : k + rows]]
        return np.maximum(y, 0)

    def pool(self, symbols: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
        """Maxima over surroundings and candidate and means over the candidate, of readings laid end to end."""
        y = self.convolve(np.concatenate((symbols, np.zeros(WIDTH - 1, np.int64))))
        begin = np.cumsum(n + WIDTH - 1) - (n + WIDTH - 1)
        marks = (begin[:, None] + np.stack((0 * n, 0 * n + LEFT, n - RIGHT, n), 1)).ravel()
        top = np.maximum.reduceat(y, marks).reshape(len(n), 4, FILTERS)
        inner = n - LEFT - RIGHT
        mean = np.add.reduceat(y, marks)[1::4] / inner[:, None]
        return {"y": y, "marks": marks, "inner": inner, "top": top, "x": np.concatenate((np.maximum(top[:, 0], top[:, 2]), top[:, 1], mean, np.log2(inner)[:, None] / 8), 1)}

    def head(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.weights["W"] + self.weights["c"])
        return h, h @ self.weights["w"] + self.weights["d"]

    def long(self, data: np.ndarray, start: int, end: int, low: int, high: int) -> np.ndarray:
        """The head's input for one candidate, a stretch at a time."""
        top, total = np.zeros((2, FILTERS)), np.zeros(FILTERS)
        for a in range(start - LEFT, end + RIGHT, ROWS):
            z = min(a + ROWS, end + RIGHT)
            at = np.arange(a - WIDTH // 2, z + WIDTH // 2)
            inside = (at >= max(low, start - LEFT)) & (at < min(high, end + RIGHT))
            y = self.convolve(np.where(inside, SYMBOL[data[np.clip(at, 0, len(data) - 1)]], 0))
            inner = (np.arange(a, z) >= start) & (np.arange(a, z) < end)
            for k, part in enumerate((y[~inner], y[inner])):
                top[k] = np.maximum(top[k], part.max(0, initial=0))
            total += y[inner].sum(0, dtype=float)
        return np.concatenate((*top, total / (end - start), [np.log2(end - start) / 8]))[None]

    def logits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out, i = np.zeros(len(starts)), 0
        done = np.cumsum(ends - starts + LEFT + RIGHT)
        while i < len(starts):
            j = int(np.searchsorted(done, (done[i - 1] if i else 0) + ROWS, "right"))
            if j == i:
                out[i] = self.head(self.long(data, int(starts[i]), int(ends[i]), int(low[i]), int(high[i])))[1][0]
                i += 1
                continue
            out[i:j] = self.head(self.pool(*read(data, starts[i:j], ends[i:j], low[i:j], high[i:j]))["x"])[1]
            i = j
        return out

    def score(self, logits: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * logits + self.shift)

    def judge(self, findings: list[tuple[bytes, int, int, int]]) -> np.ndarray:
        """Whether each of (text, start, end, label) reaches its threshold."""
        data, low, high, starts, ends = _laid(findings)
        return self.score(self.logits(data, starts, ends, low, high)) >= np.array(self.thresholds)[shape(data, starts, ends)]

    def gradient(self, symbols: np.ndarray, n: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy, or of its sum by ``weight``, for each of the net's weights."""
        w, f = self.weights, self.pool(symbols, n)
        y, x, marks = f["y"], f["x"], f["marks"]
        h, logit = self.head(x)
        dl = (_sigmoid(logit) - label) * (1 / len(label) if weight is None else weight)
        dh = dl[:, None] * w["w"] * (1 - h**2)
        dx = dh @ w["W"].T
        around, inside, mean = dx[:, :FILTERS], dx[:, FILTERS : 2 * FILTERS], dx[:, 2 * FILTERS : 3 * FILTERS] / f["inner"][:, None]
        none = np.zeros_like(around)
        left_wins = f["top"][:, 0] >= f["top"][:, 2]
        size = np.diff(np.append(marks, len(y)))
        spread = lambda parts: np.repeat(np.stack(parts, 1).reshape(-1, FILTERS), size, 0)
        peak = (y == np.repeat(f["top"].reshape(-1, FILTERS), size, 0)) & (y > 0)
        twice = np.maximum(np.add.reduceat(peak.astype(np.float32), marks), 1)
        dy = peak * spread((around * left_wins, inside, around * ~left_wins, none)) / np.repeat(twice, size, 0) + (y > 0) * spread((none, mean, none, none))
        out = {"b": dy.sum(0), "T": np.zeros_like(w["T"]), "W": x.T @ dh, "c": dh.sum(0), "w": h.T @ dl, "d": dl.sum()}
        padded = np.concatenate((symbols, np.zeros(WIDTH - 1, np.int64)))
        for k in range(WIDTH):
            s = padded[k : k + len(y)]
            order = np.argsort(s, kind="stable")
            kinds, at = np.unique(s[order], return_index=True)
            out["T"][k][kinds] = np.add.reduceat(dy[order], at)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def begin(seed: int = 7) -> Net:
    rng = np.random.default_rng(seed)
    shapes = {"T": (WIDTH, SYMBOLS, FILTERS), "b": (FILTERS,), "W": (3 * FILTERS + 1, HIDDEN), "c": (HIDDEN,), "w": (HIDDEN,), "d": ()}
    return Net({k: (rng.normal(0, 0.25, s) if k in "TWw" else np.zeros(s)).astype(np.float32) for k, s in shapes.items()})


def shape(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """0 digits and marks, 1 hexadecimal, 2 capitals and digits, 3 mixed."""
    has = lambda kind: (s := np.concatenate(([0], np.cumsum(kind[data]))))[ends] > s[starts]
    letters, beyond, small = has(UPPER | LOWER), has((UPPER | LOWER) & ~HEX), has(LOWER)
    return np.where(~letters, 0, np.where(~beyond, 1, np.where(~small, 2, 3)))


def made(n: int, seed: int = 23) -> list[tuple[bytes, int, int, int]]:
    """(text, start, end, label): findings made by rule, n of either label."""
    rng = np.random.default_rng(seed)
    pick = lambda letters, k: "".join(rng.choice(list(letters), k))
    word = lambda: pick(string.ascii_lowercase * 5 + "éüñçàößждл日本", int(rng.integers(2, 10)))
    mixed, upper = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    # Names and leads of credentials as their makers publish them.
    names = ("pwd", "pass", "passphrase", "credential", "auth", "bearer", "private_key", "client_key", "access_key", "signing key", "authorization", "login")
    leads = (("ghp_", 36), ("gho_", 36), ("sk_live_", 24), ("xoxb-", 40), ("glpat-", 20), ("AIza", 35), ("npm_", 36), ("eyJ", 60), ("SG.", 60))
    name = lambda: pick(string.ascii_lowercase, int(rng.integers(2, 10)))
    out = []
    for _ in range(n):
        i = rng.integers(4)
        if i == 0:
            lead, k = leads[rng.integers(len(leads))]
            value = lead + pick(mixed, k)
        else:
            value = pick((mixed + "+/", "0123456789abcdef", upper)[i - 1], int(rng.integers((16, 20, 20)[i - 1], 48)))
        value = value if re.search(r"\d|[a-z][A-Z]", value) else value + "7"
        named = rng.random() < 0.7 or i > 0
        before = f"{word()} {names[rng.integers(len(names))]}{rng.choice([' = ', '=', ': ', ' ', ' is '])}{rng.choice(['', chr(34)])}" if named else f"{word()} {word()} "
        out.append((before, value, f"{rng.choice(['', chr(34), ',', ';'])} {word()}", 1))
        digits = lambda k: pick(string.digits, k)
        false = (
            ".".join(str(rng.integers(1, 255)) for _ in range(4)), f"{digits(3)}-{digits(4)}", digits(16), digits(int(rng.integers(8, 14))), f"20{digits(2)}-0{rng.integers(1, 9)}-{rng.integers(10, 28)}",
            f"mail{digits(1)}.{name()}.com", f"v{digits(1)}.{digits(2)}.{digits(2)}-{name()}", f"{name()}/{name()}/{name()}{digits(2)}.txt", f"{name()}{name().title()}{name().title()}", f"{name()}_{name()}_{digits(2)}",
            f"{name().title()}-{name().title()}-{digits(1)}", f"{name()}{name()}{digits(int(rng.integers(1, 5)))}", f"{digits(2)}.{digits(3)}.{digits(3)}", f"www.{name()}{digits(2)}.org/{name()}/{name()}",
        )
        value = false[rng.integers(len(false))]
        while len(value) < SHORTEST or not re.search(r"\d|[a-z][A-Z]", value):
            value += digits(3)
        out.append((f"{word()} {word()}{rng.choice([' ', ', ', ': ', ' ('])}", value, f"{rng.choice(['', '.', ',', ')'])} {word()}", 0))
    return [(f"{b}{v}{a}\n".encode(), len(b.encode()), len(b.encode()) + len(v), label) for b, v, a, label in out]


def _laid(findings: list[tuple[bytes, int, int, int]]) -> tuple[np.ndarray, ...]:
    """Texts end to end, and the bounds of each (without its newline) and of its candidate."""
    low = np.cumsum([0, *(len(f[0]) for f in findings)])[:-1]
    high = low + np.array([len(f[0]) - 1 for f in findings], np.int64)
    starts, ends = (low + np.array([f[k] for f in findings], np.int64) for k in (1, 2))
    return np.frombuffer(b"".join(f[0] for f in findings), np.uint8), low, high, starts, ends


def train(findings: list[tuple[bytes, int, int, int]], recall: float = RECALL) -> Net:
    """findings: (text, start, end, label). Every fourth by hash is kept for calibration and thresholds."""
    data, low, high, starts, ends = _laid(findings)
    label = np.array([f[3] for f in findings], np.float32)
    kept = tx.stretch_hashes(tx.prefix(data), low, high) % np.uint64(4) == 0
    learn = np.flatnonzero(~kept)
    rng = np.random.default_rng(7)
    net = begin()
    m, v = ({k: np.zeros_like(w) for k, w in net.weights.items()} for _ in range(2))
    sides = [learn[label[learn] == y] for y in (0, 1)]
    for step in range(1, STEPS + 1):
        pick = np.concatenate([rng.choice(s, BATCH // 2) for s in sides])
        rate = RATE * (1 - step / (STEPS + 1))
        for k, g in net.gradient(*read(data, starts[pick], ends[pick], low[pick], high[pick]), label[pick]).items():
            w = net.weights[k]
            g = g + 1e-4 * w
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g**2
            net.weights[k] = (w - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    logit = net.logits(data, starts[kept], ends[kept], low[kept], high[kept])
    set_limits(net, logit, label[kept], shape(data, starts[kept], ends[kept]), recall)
    return net


def set_limits(net: Net, logit: np.ndarray, label: np.ndarray, form: np.ndarray, recall: float, weight: np.ndarray | None = None) -> None:
    """Calibration and thresholds by findings held out, each as often as its weight."""
    weight = np.ones(len(logit)) if weight is None else weight
    net.slope, net.shift = calibrate(logit, label, weight)
    score, true = net.score(logit), label == 1
    overall = threshold(score, true, recall, weight)
    net.thresholds = tuple(threshold(score[form == k], true[form == k], recall, weight[form == k]) if weight[true & (form == k)].sum() >= 20 else overall for k in range(4))


def threshold(score: np.ndarray, true: np.ndarray, recall: float, weight: np.ndarray | None = None) -> float:
    """The middle (in log-odds) of those thresholds that keep the recall with the fewest false findings: from the largest that
    keeps it down to the next false finding's score."""
    if not true.any():
        return 1.0
    order = np.argsort(score[true])
    upto = np.cumsum((np.ones(len(score)) if weight is None else weight)[true][order])
    most = float(score[true][order][min(np.searchsorted(upto, np.floor((1 - recall) * upto[-1]), "right"), len(upto) - 1)])
    least = float(score[~true & (score < most)].max(initial=1e-6))
    middle = np.mean([np.log(x / (1 - x)) for x in np.clip((least, most), 1e-9, 1 - 1e-9)])
    return float(_sigmoid(middle))


def calibrate(logit: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and shift of the logistic fit, by Newton steps with smoothed targets."""
    weight = np.ones(len(label)) if weight is None else weight
    p, n = (weight * label).sum(), (weight * (1 - label)).sum()
    target = np.where(label == 1, (p + 1) / (p + 2), 1 / (n + 2))
    x, z = np.stack((logit / 4, np.ones(len(logit))), 1), np.array([4.0, 0.0])
    for _ in range(30):
        q = _sigmoid(x @ z)
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (weight * (q - target)) + 1e-3 * (z - [4.0, 0.0]))
        z = z - np.clip(step, -2, 2)
    return float(max(z[0], 0.04) / 4), float(z[1])


def readings(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, label, reading, start, end) of all distinct candidates, labelled by the base patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in tx.chunks(batch.column(0)):
                starts, ends = candidates(data)
                short = ends - starts <= READ - LEFT - RIGHT
                starts, ends = starts[short], ends[short]
                if not len(starts):
                    continue
                _, b_starts, b_ends = base(data)
                row = np.searchsorted(offsets, starts, "right") - 1
                low, high = np.maximum(offsets[row], starts - LEFT), np.minimum(offsets[row + 1] - 1, ends + RIGHT)
                h = tx.stretch_hashes(tx.prefix(data), low, high) >> np.uint64(1)
                raw = data.tobytes()
                reading = pa.array([raw[a:z] for a, z in zip(low.tolist(), high.tolist(), strict=True)], pa.binary())
                label = pa.array(held(starts, ends, b_starts, b_ends).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), label, reading, *(pa.array((x - low).astype(np.int32)) for x in (starts, ends))], names=["h", "label", "reading", "start", "end"])

    return docs.select(text_col).mapInArrow(run, "h long, label int, reading binary, start int, end int").dropDuplicates(["label", "h", "start", "end"])


def labelled(docs: DataFrame, text_col: str = "text", sample: int = 3000) -> list[tuple[bytes, int, int, int]]:
    """(reading, start, end, label) of the ``sample`` candidates of least hash of either label, to look at; no net learns from them."""
    found, out = readings(docs, text_col), []
    for y in (0, 1):
        out += [(bytes(r.reading) + b"\n", r.start, r.end, y) for r in found.where(F.col("label") == y).orderBy("h", "start", "end").limit(sample).collect()]
    return out


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """Label, weight, and data, low, high, starts and ends of the findings of a batch, for about ``ROWS`` symbols at a time."""
    columns = batch.to_pydict()
    done = np.cumsum([len(x) + WIDTH for x in columns["reading"]])
    part = done // ROWS
    for k in np.unique(part):
        i, j = np.searchsorted(part, k), np.searchsorted(part, k, "right")
        laid = _laid([(r + b"\n", a, z, y) for r, a, z, y in zip(*(columns[c][i:j] for c in ("reading", "start", "end", "label")), strict=True)])
        yield (np.array(columns["label"][i:j], np.float32), np.array(columns["weight"][i:j]), *laid)


def _slopes(net: Net, learn: DataFrame) -> np.ndarray:
    """The gradient over all findings, as one array; one sum a task reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            for label, weight, data, low, high, starts, ends in _runs(batch):
                g = net.gradient(*read(data, starts, ends, low, high), label, weight)
                total = total + np.concatenate([np.ravel(g[k]).astype(float) for k in net.weights])
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sum"])

    return np.sum([np.frombuffer(r[0]) for r in learn.mapInArrow(run, "sum binary").collect()], 0)


def _counts(net: Net, kept: DataFrame) -> np.ndarray:
    """(label, shape, logit, weight) of all findings held out, counted by label, shape and step of the logit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, weight, data, low, high, starts, ends in _runs(batch):
                step = np.rint(np.clip(net.logits(data, starts, ends, low, high), -LIMIT, LIMIT) * FINE).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(shape(data, starts, ends).astype(np.int32)), pa.array(step), pa.array(weight)], names=["label", "form", "step", "weight"])

    counted = kept.mapInArrow(run, "label int, form int, step int, weight double").groupBy("label", "form", "step").agg(F.count("*").alias("n"), F.min("weight").alias("least"), F.count_if(F.col("weight") == 1).alias("ones"))
    # two weights a label at most: 1 and that of the corpus
    rows = [(r.label, r.form, r.step / FINE, r.ones + (r.n - r.ones) * r.least) for r in counted.orderBy("label", "form", "step").collect()]
    return np.array(rows, float).reshape(-1, 4)


def refine(net: Net, found: DataFrame, recall: float = RECALL) -> Net:
    """A net that goes on from ``net`` by all of ``found`` (h, label, reading, start, end, weight); every fourth by hash is held out."""
    learn, kept = found.where("h % 4 <> 0"), found.where("h % 4 = 0")
    sums = {r.label: r.w for r in learn.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    even = learn.withColumn("weight", F.col("weight") * F.when(F.col("label") == 1, 0.5 / sums.get(1, 1)).otherwise(0.5 / sums.get(0, 1)))
    out = Net(dict(net.weights))
    m, v = 0.0, 0.0
    for step in range(1, ROUNDS + 1):
        flat = np.concatenate([np.ravel(w) for w in out.weights.values()]).astype(float)
        g = _slopes(out, even) + 1e-4 * flat
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        flat -= RATE * (1 - step / (ROUNDS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        at = np.cumsum([0, *(w.size for w in out.weights.values())])
        out.weights = {k: flat[a:z].reshape(w.shape).astype(np.float32) for (k, w), a, z in zip(out.weights.items(), at[:-1], at[1:], strict=True)}
    label, form, logit, weight = _counts(out, kept).T
    set_limits(out, logit, label, form, recall, weight)
    return out


def fit(docs: DataFrame, text_col: str = "text") -> Net:
    """A net for a corpus. Candidates outside the patterns that a first net, which learned from sure findings alone, already
    takes for secrets are doubtful: they are no false findings to learn from."""
    sure = made(MADE)
    net = train(sure)
    held_all = cut(readings(docs, text_col))
    n = {r.label: r.n for r in held_all.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not n:
        release(held_all)
        return net
    data, low, high, _, _ = _laid(sure)
    h = (tx.stretch_hashes(tx.prefix(data), low, high) >> np.uint64(1)).tolist()
    rows = [(x, y, t[:-1], a, z, 1.0) for x, (t, a, z, y) in zip(h, sure, strict=True)]
    shown = docs.sparkSession.createDataFrame(rows, "h long, label int, reading binary, start int, end int, weight double")
    weight = F.when(F.col("label") == 1, min(1.0, SHARE * MADE / n.get(1, 1))).otherwise(min(1.0, SHARE * MADE / n.get(0, 1)))
    found = held_all.withColumn("weight", weight)
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-sum(n.values()) // 20_000))
    laid = lambda df: cut(df.repartition(tasks).sortWithinPartitions("h", "label", "start", "end"))
    certain = laid(found.where("label = 1").union(shown))
    first = refine(net, certain)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doubtful = [np.zeros(0, bool)]
            for _, _, data, low, high, starts, ends in _runs(batch):
                doubtful.append(first.score(first.logits(data, starts, ends, low, high)) >= np.array(first.thresholds)[shape(data, starts, ends)])
            yield batch.filter(pa.array(~np.concatenate(doubtful)))

    whole = laid(found.where("label = 0").mapInArrow(sift, found.schema).union(certain))
    out = refine(first, whole)
    for df in (held_all, certain, whole):
        release(df)
    return out


def scan(docs: DataFrame, net: Net, text_col: str = "text") -> DataFrame:
    """``docs`` with findings: an array of (kind, start, end, score), by start, then kind; places in code points, ends exclusive;
    base findings have score 1."""
    model = docs.sparkSession.sparkContext.broadcast(net)
    schema = tx.extended(docs, "findings array<struct<kind: string, start: long, end: long, score: double>>")
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(KINDS, object)
        for batch in batches:
            for first, end, data, offsets in tx.chunks(batch.column(where)):
                kind, starts, ends = base(data)
                c_starts, c_ends = candidates(data)
                free = ~held(c_starts, c_ends, starts, ends)
                c_starts, c_ends = c_starts[free], c_ends[free]
                c_row = np.searchsorted(offsets, c_starts, "right") - 1
                score = model.value.score(model.value.logits(data, c_starts, c_ends, offsets[c_row], offsets[c_row + 1] - 1))
                hit = score >= np.array(model.value.thresholds)[shape(data, c_starts, c_ends)]
                kind, score = np.concatenate((kind, np.full(hit.sum(), 3))), np.concatenate((np.ones(len(starts)), score[hit]))
                starts, ends = np.concatenate((starts, c_starts[hit])), np.concatenate((ends, c_ends[hit]))
                order = np.lexsort((kind, starts))
                kind, starts, ends, score = kind[order], starts[order], ends[order], score[order]
                row = np.searchsorted(offsets, starts, "right") - 1
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                held_by = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=end - first))))
                entry = pa.StructArray.from_arrays([pa.array(names[kind].tolist(), pa.string()), *(tx.int64s(points[x] - points[offsets[row]]) for x in (starts, ends)), pa.array(score, pa.float64())], ["kind", "start", "end", "score"])
                yield pa.RecordBatch.from_arrays([*(c.slice(first, end - first) for c in batch.columns), pa.ListArray.from_arrays(pa.array(held_by, pa.int32()), entry)], names=schema.names)

    return docs.mapInArrow(run, schema)


def op11_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, fit(docs)).drop("text")
    listed = lambda fs: F.array_join(F.transform(fs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    of_base = F.filter("findings", lambda x: x["kind"] != "learned")
    return found.select("doc_id", *map(n, KINDS[:3]), F.sha2(listed(of_base), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))


QUERIES = {"op11_secrets": op11_secrets}
