"""Personal data by fixed patterns plus a semi-Markov conditional random field.

Four fixed patterns give the base spans.  Around anything that could be
personal data (a run of digits and their punctuation, a word with an at sign,
spelled out or not) a zone is cut into tokens, and a semi-Markov conditional
random field chooses boundaries and types together: a dynamic programme over
segments of at most ``LONGEST`` tokens, scored by features of the whole segment
(digit count and grouping, separators, check digits, octet ranges, words before
it) and by neighbouring types.  Decoded segments that touch no base span are
added to them.

The weights maximise the penalised conditional likelihood of the right
segmentation among all, summed by the same dynamic programme forwards and
backwards.  They are fitted on pieces of zones of a bounded sample, whose base
spans are the truth and are shown with and without their tell-tale marks: at
most ``MAX_TEXTS`` texts, and from these at most ``MAX_CASES`` pieces that begin
with each kind or with none, of at most ``MAX_CHARS`` characters each.  Only
these pieces come to the driver.

Zones are cut by linear scans, so one very long token costs no more than its
length.  A zone of any length is decoded as a whole: scores are kept for the
last ``LONGEST`` tokens only, and the way back in a few bytes a token.

Defined results: a null or empty text has no spans; every input row gives one
row, whatever its id; offsets are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.scratch import Scratch

KINDS = ("email", "ip", "card", "phone")
#: Tokens of a segment at most, and of a training case, which ends at the first place after them that no span covers.
LONGEST = 15
ZONE_TOKENS = 120
#: Documented bounds of the fit: texts sampled, pieces of zones for each kind and for none, characters of a piece.
MAX_TEXTS, MAX_CASES, MAX_CHARS = 600, 400, 2000
#: Characters before a segment in which a word may announce it.
CONTEXT = 24
#: One of these a text must hold to have any span; fixed strings come first, as they are cheap to look for.
MAYBE = ("@", "t)", "t]", "t}", "T)", "T]", "T}")
MAYBE_NUMBER = "[+0-9][0-9 ().+-]{6}"

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[+0-9][0-9 ().+-]*")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SPELLED = re.compile(r"(?:\(at\)|\[at\]|\{at\})", re.I)
_ADDRESS = re.compile(r"(?:@|[(\[{]at[)\]}] ?)\S*(?: ?(?:\.|\(dot\)|\[dot\]) ?\S+)*", re.I)
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s|.", re.S)
_WORD_BEFORE = re.compile(r"([^\W\d_]+)[^\w]{0,4}$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern, found from each at sign outwards."""
    out, end, at, last = [], 0, text.find("@"), -1
    while at >= 0:
        floor = max(end, last + 1)
        head = text[floor:at]
        start = floor + len(head.rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        last, at = at, text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for zone in _DIGITS.finditer(text):
        z, at = zone.group(), zone.start()
        if len(z) < 7:
            continue
        if z.count(".") >= 3:
            out += [(at + m.start(), 1, at + m.end()) for m in _IP.finditer(z) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        if len(z) >= 14:
            for m in _CARD.finditer(z):
                d = _only_digits(m.group())
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append((at + m.start(), 2, at + m.end()))
        if "+" in z:
            for m in _PHONE.finditer(z):
                if 10 <= len(_only_digits(m.group())) <= 15:
                    out.append((at + m.start(), 3, at + m.end()))
    return sorted(out)


def zones(text: str) -> list[tuple[int, int]]:
    """Stretches worth decoding: numbers of 7 digits or more, and words around at signs, however long."""
    out = [(m.start(), m.start() + len(m.group().rstrip(" ("))) for m in _DIGITS.finditer(text) if len(m.group()) >= 7 and len(_only_digits(m.group())) >= 7]
    marks = [m.start() for m in re.finditer("@", text)] if "@" in text else []
    if any(x in text for x in ("at)", "at]", "at}", "At)", "At]", "At}", "AT)", "AT]", "AT}", "aT)", "aT]", "aT}")):
        marks = sorted(marks + [m.start() for m in _SPELLED.finditer(text)])
    end = 0
    for at in marks:
        if at < end:
            continue  # inside the zone of an earlier mark
        word = at
        while word > end and text[word - 1] in " \n":  # blanks before a spelled at sign
            word -= 1
            if text[word] == "\n":
                word += 1
                break
        start = max(text.rfind(" ", end, word), text.rfind("\n", end, word), end - 1) + 1
        end = _ADDRESS.match(text, at).end()
        out.append((start, end))
    merged: list[tuple[int, int]] = []
    for s, e in sorted(out):
        if merged and s < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        elif e > s:
            merged.append((s, e))
    return merged


def tokens(text: str, start: int, end: int) -> list[int]:
    """Token limits inside a zone: one more than there are tokens."""
    return [m.start() for m in _TOKEN.finditer(text, start, end)] + [end]


def features(text: str, start: int, end: int) -> list[str]:
    """What a whole candidate segment looks like."""
    s = text[start:end]
    digits = _only_digits(s)
    n = len(digits)
    out = [f"digits={n if n < 20 else 20}", f"first={_shape(s[0])}", f"last={_shape(s[-1])}"]
    if start and text[start - 1].isalnum() or end < len(text) and text[end].isalnum():
        out.append("cuts a word")
    if start and text[start - 1] in "+.-@(" or end < len(text) - 1 and text[end] in ".-@" and text[end + 1].isalnum():
        out.append("cuts a number")
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    letters = any(c.isalpha() for c in s)
    if not letters and n >= 7:
        separators = "".join(sorted({c for c in s if not c.isdigit()}))
        out += [f"sep={separators}", f"groups={len(groups)}", f"digits,sep={n},{separators}"]
        if 14 <= n <= 19:
            out.append(f"luhn={luhn(digits)}")
        if separators == "." and len(groups) == 4:
            out.append(f"octets={all(len(g) < 4 and int(g) < 256 for g in s.split('.') if g)}")
    if "@" in s or _SPELLED.search(s):
        host = re.split(r"@|[(\[{]at[)\]}]", s, flags=re.I)[-1]
        out += ["at", f"at,host={bool(re.search(r'[.]|dot', host))}", f"at,space={' ' in s.strip()}"]
    before = _WORD_BEFORE.search(text, max(0, start - CONTEXT), start)
    word = before.group(1).lower() if before else ""
    if word in _CUES:
        out.append(f"cue={_CUES[word]}")
    return out


#: Words that announce personal data.
_CUES = {
    "phone": "phone", "tel": "phone", "telephone": "phone", "mobile": "phone", "call": "phone", "fax": "phone",
    "mail": "email", "email": "email", "contact": "email",
    "ip": "ip", "host": "ip", "address": "ip",
    "card": "card", "visa": "card", "mastercard": "card", "credit": "card",
}


def _shape(c: str) -> str:
    return "d" if c.isdigit() else "a" if c.isalpha() else "s" if c.isspace() else c


class SemiMarkov:
    """Weights of segment features and of neighbouring types; type -1 is one token of other text."""

    def __init__(self, weights: dict[str, float] | None = None) -> None:
        self.weights = weights or {}

    def decode(self, text: str, limits: list[int]) -> list[tuple[int, int, int]]:
        """The best segmentation: (first token, type, end token) of all segments."""
        w, n = self.weights.get, len(limits) - 1
        types = range(-1, len(KINDS))
        best: dict[int, dict[int, float]] = {0: {-1: 0.0}}  # of the last tokens
        back = bytearray(2 * len(types) * (n + 1))  # size and last type + 1, by token and type
        for end in range(1, n + 1):
            best[end] = now = {}
            for size in range(1, min(LONGEST, end) + 1):
                start = end - size
                found = None
                for kind in types:
                    if kind < 0:
                        if size > 1:
                            continue
                        own = w(f"o|{_shape(text[limits[start]])}", 0.0)
                    else:
                        if found is None:
                            found = features(text, limits[start], limits[end])
                        own = w(f"{kind}|", 0.0) + sum(w(f"{kind}|{f}", 0.0) for f in found)
                    for last, total in best[start].items():
                        value = total + own + w(f"{last}>{kind}", 0.0)
                        if kind not in now or value > now[kind]:
                            now[kind] = value
                            cell = 2 * (len(types) * end + kind + 1)
                            back[cell], back[cell + 1] = size, last + 1
            best.pop(end - LONGEST, None)
        out, at = [], n
        kind = max(best[n], key=best[n].get)
        while at > 0:
            cell = 2 * (len(types) * at + kind + 1)
            out.append((at - back[cell], kind, at))
            at, kind = at - back[cell], back[cell + 1] - 1
        return out[::-1]

    def score(self, text: str, limits: list[int], segments: list[tuple[int, int, int]]) -> float:
        """The sum of the weights of a segmentation."""
        w, total, last = self.weights.get, 0.0, -1
        for start, kind, end in segments:
            total += w(f"{last}>{kind}", 0.0)
            if kind < 0:
                total += w(f"o|{_shape(text[limits[start]])}", 0.0)
            else:
                total += w(f"{kind}|", 0.0) + sum(w(f"{kind}|{f}", 0.0) for f in features(text, limits[start], limits[end]))
            last = kind
        return total


Case = tuple[str, list[int], list[tuple[int, int, int]]]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


class Likelihood:
    """The conditional likelihood of some cases' segmentations, and its gradient.

    All cases advance together, token by token, longest first.  Segments that
    look alike, that is with the same features, are scored once.
    """

    def __init__(self, cases: list[Case]) -> None:
        cases = sorted(cases, key=lambda c: (-len(c[1]), c))
        self.length = np.array([len(limits) - 1 for _, limits, _ in cases])
        self.last = int(self.length[0]) if len(cases) else 0
        self.active = [int((self.length >= e).sum()) for e in range(self.last + 1)]
        looks: dict[tuple[str, ...], int] = {}
        shapes: dict[str, int] = {}
        # by end: for each active case and size, what the segment looks like; and each token's shape
        self.look = [np.zeros((self.active[e], min(LONGEST, e)), np.int64) for e in range(self.last + 1)]
        self.shape = [np.zeros(self.active[e], np.int64) for e in range(self.last + 1)]
        types = len(KINDS) + 1
        self.seen_moves = np.zeros((types, types))
        seen_looks: list[tuple[int, int]] = []
        seen_shapes: list[int] = []
        for i, (text, limits, truth) in enumerate(cases):
            for end in range(1, len(limits)):
                self.shape[end][i] = shapes.setdefault(_shape(text[limits[end - 1]]), len(shapes))
                for size in range(1, min(LONGEST, end) + 1):
                    found = ("", *features(text, limits[end - size], limits[end]))
                    self.look[end][i, size - 1] = looks.setdefault(found, len(looks))
            before = -1
            for start, kind, end in truth:
                self.seen_moves[before + 1, kind + 1] += 1
                before = kind
                if kind < 0:
                    seen_shapes.append(self.shape[end][i])
                else:
                    seen_looks.append((self.look[end][i, end - start - 1], kind))
        self.shapes, self.names = list(shapes), sorted({f for look in looks for f in look})
        place = {f: i for i, f in enumerate(self.names)}
        self.flat = np.array([place[f] for look in looks for f in look], np.int64)
        self.owner = np.repeat(np.arange(len(looks)), [len(look) for look in looks])
        self.n_looks = len(looks)
        counts = np.zeros((self.n_looks, len(KINDS)))
        for look, kind in seen_looks:
            counts[look, kind] += 1
        self.seen = self._by_feature(counts)
        self.seen_shapes = np.bincount(np.array(seen_shapes, np.int64), minlength=len(shapes)).astype(float)

    def _by_feature(self, by_look: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.flat, by_look[self.owner, k], len(self.names)) for k in range(len(KINDS))], axis=1)

    def sizes(self) -> list[tuple[int, ...]]:
        return [(len(self.names), len(KINDS)), (len(self.shapes),), (len(KINDS) + 1, len(KINDS) + 1)]

    def unpack(self, x: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for shape in self.sizes():
            n = int(np.prod(shape))
            out.append(x[at : at + n].reshape(shape))
            at += n
        return out

    def partition(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The logarithm of each case's sum over all segmentations, and the expected counts of all weights."""
        weight, other, move = self.unpack(x)
        types, n = len(KINDS) + 1, len(self.length)
        look_score = np.stack([np.bincount(self.owner, weight[self.flat, k], self.n_looks) for k in range(len(KINDS))], axis=1)
        score: list[np.ndarray] = []
        for e in range(self.last + 1):
            own = np.full((self.active[e], min(LONGEST, e), types), -np.inf)
            if e:
                own[:, :, 1:] = look_score[self.look[e]]
                own[:, 0, 0] = other[self.shape[e]]
            score.append(own)
        first = np.full((n, types), -np.inf)
        first[:, 0] = 0.0
        alpha = [first]
        into = [_logsum(first[:, :, None] + move, 1)]  # by the type that follows
        for e in range(1, self.last + 1):
            m = self.active[e]
            steps = np.stack([into[e - size][:m] + score[e][:, size - 1] for size in range(1, min(LONGEST, e) + 1)], axis=1)
            alpha.append(_logsum(steps, 1))
            into.append(_logsum(alpha[e][:, :, None] + move, 1))
        total = np.zeros(n)
        beta = [np.zeros((self.active[e], types)) for e in range(self.last + 1)]
        looks, shapes, moves = np.zeros((self.n_looks, types - 1)), np.zeros(len(self.shapes)), np.zeros((types, types))
        for e in range(self.last, -1, -1):
            m = self.active[min(e + 1, self.last)] if e < self.last else 0  # cases that go on after e
            ends = slice(m, self.active[e])
            total[ends] = _logsum(alpha[e][ends], 1)
            if m:
                onward = np.full((m, min(LONGEST, self.last - e), types), -np.inf)
                for size in range(1, onward.shape[1] + 1):
                    k = self.active[e + size]
                    onward[:k, size - 1] = score[e + size][:, size - 1] + beta[e + size]
                go = _logsum(onward, 1)
                beta[e][:m] = _logsum(move + go[:, None, :], 2)
        for e in range(self.last, -1, -1):
            m, z = self.active[e], total[: self.active[e]]
            for size in range(1, min(LONGEST, e) + 1):
                share = np.exp(into[e - size][:m] + score[e][:, size - 1] + beta[e] - z[:, None])
                for k in range(types - 1):
                    looks[:, k] += np.bincount(self.look[e][:, size - 1], share[:, k + 1], self.n_looks)
                if size == 1:
                    shapes += np.bincount(self.shape[e], share[:, 0], len(self.shapes))
            m = self.active[e + 1] if e < self.last else 0
            if m:
                onward = np.full((m, min(LONGEST, self.last - e), types), -np.inf)
                for size in range(1, onward.shape[1] + 1):
                    k = self.active[e + size]
                    onward[:k, size - 1] = score[e + size][:, size - 1] + beta[e + size]
                go = _logsum(onward, 1)
                moves += np.exp(alpha[e][:m, :, None] + move + go[:, None, :] - total[:m, None, None]).sum(axis=0)
        return total, [self._by_feature(looks), shapes, moves]

    def loss(self, x: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
        """The penalised negative log likelihood and its gradient."""
        total, expected = self.partition(x)
        seen = np.concatenate([self.seen.ravel(), self.seen_shapes, self.seen_moves.ravel()])
        gradient = np.concatenate([e.ravel() for e in expected]) - seen
        return float(total.sum() - x @ seen + penalty / 2 * (x @ x)), gradient + penalty * x


def minimised(f, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with halving steps."""
    value, gradient = f(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, kept = gradient.copy(), []
        for s, y, r in reversed(past):
            kept.append(a := r * (s @ q))
            q -= a * y
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(np.abs(gradient).sum()))
        for (s, y, r), a in zip(past, reversed(kept), strict=True):
            q += (a - r * (y @ q)) * s
        slope, step = float(gradient @ q), 1.0
        while step > 1e-6:
            there, g = f(x - step * q)
            if there <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = -step * q, g - gradient
        small = value - there < 1e-5 * max(1.0, abs(value))
        x, value, gradient = x + s, there, g
        if s @ y > 1e-10:
            past = [*past[1 - memory :], (s, y, 1 / (s @ y))]
        if small:
            break
    return x


def _pieces(limits: list[int], spans: list[tuple[int, int, int]]) -> Iterator[list[int]]:
    """A zone's tokens in training cases, cut between spans only."""
    inside = {x for s, _, e in spans for x in limits[bisect_right(limits, s) : bisect_left(limits, e)]}
    at, n = 0, len(limits) - 1
    while at < n:
        end = min(at + ZONE_TOKENS, n)
        while limits[end] in inside and end < n:
            end += 1
        yield limits[at : end + 1]
        at = end


def _truth(limits: list[int], spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]] | None:
    """The segmentation that has exactly these spans, if they fall on tokens and don't overlap."""
    at = {x: i for i, x in enumerate(limits)}
    out, token = [], 0
    for start, kind, end in spans:
        if start not in at or end not in at or at[start] < token or at[end] - at[start] > LONGEST:
            return None
        out += [(i, -1, i + 1) for i in range(token, at[start])] + [(at[start], kind, at[end])]
        token = at[end]
    return out + [(i, -1, i + 1) for i in range(token, len(limits) - 1)]


def _variants(text: str, start: int, end: int, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int, int]]]]:
    """A zone as it is; an address with its at sign spelled out; a number announced by a word, without its plus."""
    yield text, start, end, spans
    if len(spans) == 1:
        s, kind, e = spans[0]
        own = text[s:e]
        if kind == 0:
            other = own.replace("@", " (at) ")
            yield other, 0, len(other), [(0, 0, len(other))]
        if kind == 3 and own[0] == "+":
            other = f"phone {own[1:].strip()}"
            yield other, 6, len(other), [(6, 3, len(other))]


def cases_of(text: str) -> Iterator[Case]:
    """A text's zones, with and without their marks, cut into pieces with the right segmentation of each."""
    spans = base_spans(text)
    for start, end in zones(text):
        inside = [x for x in spans if x[0] >= start and x[2] <= end]
        for t, s, e, own in _variants(text, start, end, inside):
            for limits in _pieces(tokens(t, s, e), own):
                if limits[-1] - limits[0] > MAX_CHARS:
                    continue
                truth = _truth(limits, [x for x in own if limits[0] <= x[0] and x[2] <= limits[-1]])
                if truth is not None:
                    a = max(0, limits[0] - CONTEXT)
                    yield t[a : limits[-1] + 2], [x - a for x in limits], truth


def train(examples: list[str | Case], penalty: float = 0.3, rounds: int = 60) -> SemiMarkov:
    """The weights of the greatest penalised likelihood; without cases all are zero.

    A text stands for all its cases.
    """
    cases = [c for x in examples for c in (cases_of(x) if isinstance(x, str) else [x])]
    if not cases:
        return SemiMarkov()
    likelihood = Likelihood(cases)
    x = minimised(lambda v: likelihood.loss(v, penalty), np.zeros(sum(int(np.prod(s)) for s in likelihood.sizes())), rounds)
    weight, other, move = likelihood.unpack(x)
    out = {f"{k}|{f}": float(weight[i, k]) for i, f in enumerate(likelihood.names) for k in range(len(KINDS))}
    out |= {f"o|{c}": float(v) for c, v in zip(likelihood.shapes, other, strict=True)}
    out |= {f"{a - 1}>{b - 1}": float(move[a, b]) for a in range(len(move)) for b in range(len(move))}
    return SemiMarkov({k: v for k, v in out.items() if v})


def find(text: str, model: SemiMarkov) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans with those that the model adds."""
    base = base_spans(text)
    added = []
    for start, end in zones(text):
        own = [x for x in base if x[0] < end and x[2] > start]
        if sum(e - s for s, _, e in own) >= (end - start) - 2:
            continue  # nothing is left to add
        limits = tokens(text, start, end)
        for s, kind, e in model.decode(text, limits):
            if kind >= 0 and not any(a < limits[e] and limits[s] < b for a, _, b in own):
                added.append((limits[s], kind, limits[e]))
    return base, sorted([*base, *added])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _case_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        rows = []
        for text in rb.column(0):
            for own, limits, truth in cases_of(text.as_py() or ""):
                kind = next((k for _, k, _ in truth if k >= 0), -1)
                rows.append((kind, own, limits, [x for segment in truth for x in segment]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.int32())), pa.array([r[3] for r in rows], pa.list_(pa.int32()))],
            names=["kind", "text", "limits", "truth"],
        )


def _maybe(text: Column) -> Column:
    out = text.contains(MAYBE[0])
    for part in MAYBE[1:]:
        out = out | text.contains(part)
    return out | text.rlike(MAYBE_NUMBER)


def sample_cases(docs: DataFrame, id_col: str, text_col: str, max_texts: int = MAX_TEXTS, max_cases: int = MAX_CASES) -> list[Case]:
    """Training cases of the ``max_texts`` texts of the least hashes, and of their pieces those of the least hashes.

    The hashes are ordered without the texts, and only pieces leave the executors.
    """
    some = docs.where(_maybe(F.col(text_col))).select(F.xxhash64(F.col(id_col).cast("string"), text_col).alias("h"), F.col(text_col).alias("t"))
    least = [r.h for r in some.select("h").distinct().orderBy("h").limit(max_texts).collect()]
    if not least:
        return []
    rows = some.where(F.col("h") <= least[-1]).select("t").mapInArrow(_case_rows, "kind int, text string, limits array<int>, truth array<int>")
    rows = Scratch(docs.sparkSession, "personal").keep(rows.distinct(), "cases")
    out: list[Case] = []
    for kind in range(-1, len(KINDS)):
        own = rows.where(F.col("kind") == kind).orderBy(F.xxhash64("text", "limits"), "text", "limits", "truth").limit(max_cases)
        out += [(r.text, r.limits, [tuple(r.truth[i : i + 3]) for i in range(0, len(r.truth), 3)]) for r in own.collect()]
    return out


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_texts: int = MAX_TEXTS, max_cases: int = MAX_CASES) -> DataFrame:
    """One row per document: id, counts of base spans by kind, base (joined), spans (joined, all)."""
    kind = docs.schema[id_col].dataType.simpleString()
    model = train(sample_cases(docs, id_col, text_col, max_texts, max_cases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            n, base, spans = [[] for _ in KINDS], [], []
            for text in rb.column(1):
                own, every = find(text.as_py() or "", model)
                for k in range(len(KINDS)):
                    n[k].append(sum(x[1] == k for x in own))
                base.append(_joined(own))
                spans.append(_joined(every))
            yield pa.RecordBatch.from_arrays([rb.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(base, pa.string()), pa.array(spans, pa.string())], names=["id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    # Texts that can have no span stay in the JVM.
    text = F.when(_maybe(F.col(text_col)), F.col(text_col))
    out = docs.select(F.col(id_col).alias("id"), text.alias("text")).mapInArrow(run, f"id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string")
    return out.withColumnRenamed("id", id_col)


def base_digest(text: str) -> str:
    return hashlib.sha256(_joined(base_spans(text)).encode()).hexdigest()


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


QUERIES = {"op4_pii": op4_pii}
ORACLE_SQL: dict[str, str] = {}
