"""Personal data: exact base patterns, and more spans from a linear-chain conditional random field.

The field labels tokens (runs of letters, digits or space, or one other
character) with the beginning, inside or outside of a kind. Its features are
the shapes of a token and its neighbours. It is trained here from a small
table, of lines labelled by hand and lines made by rule, and decoded by
Viterbi in numpy batches. Every span it may find has a digit or an @. Its
labels are those of a decode of the whole text: a text is cut only at tokens
proved to be outside in that decode, and parts without digit or @ are passed
over. What it finds must bear the content of its kind (an address with a
domain, four numbers up to 255, a check digit, enough digits); how that is
written is the field's judgement.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .lexer import bytes_of, texts
from .pii_table import LINES, parsed
from .store import lean, slim_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
TOKEN = re.compile(r"[A-Za-zÀ-ɏ]+|[0-9]+|\s+|[^\sA-Za-z0-9À-ɏ]")

# --- base patterns -----------------------------------------------------------------------------------------------

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails at its beginning fails everywhere in it, hence the look-behind, which keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(d * 2 - 9 * (d > 4) for d in map(int, even))) % 10 == 0


def good(kind: str, s: str) -> bool:
    """Whether a match of the kind's pattern holds: parts of an address, check digit, number of digits."""
    if kind == "ip":
        return all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))
    if kind == "card":
        return 14 <= len(d := _digits(s)) <= 19 and luhn(d)
    return kind != "phone" or 10 <= len(_digits(s)) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, leftmost and without overlap for each kind, in order."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for k, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if good(KINDS[k], m.group())]
    return sorted(out)


# --- features ----------------------------------------------------------------------------------------------------

CUES = ("at", "dot", "com", "org", "net", "tel", "phone", "fax", "call", "mail", "email", "e-mail", "ip", "host", "card", "visa", "v", "version", "token", "key", "id", "no", "page", "ref")
_SHAPES: dict[str, int] = {}
for _s in ("", *(f"={c}" for c in CUES), *(f"{c}{n}" for c in ("a", "Aa", "A", "aA") for n in "1234"), *(f"d{n}" for n in (1, 2, 3, 4, 5, 9, 14, 20)), " ", "\n", *".,;:!?@+-_()[]{}<>/\\#*$%&|'\"=~^`", "?other"):
    _SHAPES.setdefault(_s, len(_SHAPES))
N_SHAPES, REACH = len(_SHAPES), 3


def shape(token: str) -> int:
    c = token[0]
    if "0" <= c <= "9":
        n = len(token)
        return _SHAPES[f"d{n if n < 5 else 5 if n < 9 else 9 if n < 14 else 14 if n < 20 else 20}"]
    if c.isspace():
        return _SHAPES["\n" if "\n" in token else " "]
    if c.isalpha():
        if (cue := _SHAPES.get(f"={token.lower()}")) is not None:
            return cue
        kind = "a" if token.islower() else "A" if token.isupper() else "Aa" if token.istitle() else "aA"
        return _SHAPES[f"{kind}{min(4, len(token))}"]
    return _SHAPES.get(token, _SHAPES["?other"])


@dataclass
class Field:
    near: np.ndarray  # (2 * REACH + 1, N_SHAPES, labels): by offset and shape
    pair: np.ndarray  # (2, N_SHAPES ** 2, labels): shape with the one before, with the one after
    move: np.ndarray  # (labels, labels)
    begin: np.ndarray

    def emit(self, x: np.ndarray) -> np.ndarray:
        return sum(w[f] for w, f in zip((*self.near, *self.pair), facets(x), strict=True))

    def decode(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best labels of each row of x (shapes, padded), by Viterbi over the whole batch at once."""
        e = self.emit(x)
        best, steps = self.begin + e[:, 0], []
        for t in range(1, x.shape[1]):
            through = best[:, :, None] + self.move
            back = through.argmax(1)
            new = through.max(1) + e[:, t]
            on = (t < lengths)[:, None]
            best = np.where(on, new, best)
            steps.append(np.where(on, back, np.arange(len(LABELS))))
        out = np.zeros(x.shape, np.int8)
        out[:, -1] = label = best.argmax(1)
        for t in range(x.shape[1] - 1, 0, -1):
            label = steps[t - 1][np.arange(len(x)), label]
            out[:, t - 1] = label
        return out


def facets(x: np.ndarray) -> list[np.ndarray]:
    padded = np.pad(x, ((0, 0), (REACH, REACH)))
    at = lambda k: padded[:, REACH + k : REACH + k + x.shape[1]]
    return [*(at(k) for k in range(-REACH, REACH + 1)), at(-1) * N_SHAPES + x, x * N_SHAPES + at(1)]


# --- the labelled table and the fit ------------------------------------------------------------------------------

_FILL = "the of and que les und der with over from Then Alors 12 2019 3.5 v2 call tel mail is , . ; : ! &&& %%% *** ### $$$ | ( ) id page".split()


def examples(n: int = 300, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """n labelled lines with their spans (start, end, kind), made by rule from formats in use."""
    rng = np.random.RandomState(seed)
    digits = lambda k: "".join(map(str, rng.randint(0, 10, k)))
    pick = lambda *a: a[rng.randint(len(a))]
    word = lambda: "".join(pick(*"aeiourstnldmc") for _ in range(rng.randint(2, 9)))

    def card():
        d = digits(pick(13, 14, 15, 15, 15, 17, 18))
        d += next(c for c in "0123456789" if luhn(d + c))
        return pick(d, d, d, *(c.join(d[i : i + 4] for i in range(0, len(d), 4)) for c in (" ", " ", "-", "-", ".", " - ")))

    def positive():
        k = rng.randint(4)
        if k == 0:
            local = pick(word(), f"{word()}.{word()}", f"{word()}{digits(2)}", f"{word()}.{digits(2)}", f"{word()}_{word()}+{word()}", digits(3))
            return pick(f"{local}@{word()}.com", f"{local}@{word()}{digits(1)}.{word()}.org", f"{local}@{word()}-{word()}.net", f"{local} @ {word()} . com", f"{local}@ {word()}.com"), "email"
        if k == 1:
            return pick(".", ".", ".", " . ", "[.]").join(str(rng.randint(256)) for _ in range(4)), "ip"
        if k == 2:
            return card(), "card"
        a, b, c = digits(3), digits(3), digits(4)
        return pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a}/{b} {c}", f"+{digits(2)} {a} {b} {c}", f"+{digits(2)}{a}{b}{c}", f"({a}){b}-{c}"), "phone"

    def negative():
        a, b = digits(2), digits(4)
        return pick(
            digits(rng.randint(1, 8)), f"{digits(1)}.{a}", f"{digits(1)}.{digits(1)}.{a}", f"20{a}-0{digits(1)}-1{digits(1)}", f"{a}/{a}/{b}", f"{a}:{a}:{a}", f"${digits(3)}.{a}", f"{a}%", f"{b}-{b}",
            f'token = "{"".join(pick(*"0123456789abcdef") for _ in range(40))}"', f"{word()}@{word()}", f"@{word()}", f"v{digits(1)}.{digits(1)}.{digits(2)}.{b}{b}", digits(25), f"No. {digits(6)}", f"{b} {b}", f"{a} {a} {a}", f"(c) {b}", f"{digits(10)}", f"{a}-{a}-{a}",
            f"{a}.{a}.20{a}", f"20{a}.{a}.{a}", f"{a}/{a}/20{a} {a}:{a}", f"ISBN {digits(3)}-{digits(1)}-{a}-{digits(6)}-{digits(1)}", f"{a} {digits(3)} {digits(3)}", f"{a}.{digits(5)}, {a}.{digits(5)}", f"{b}-{digits(5)}-{a}", f"page {a}-{a}, {digits(3)}",
        )

    out = []
    for _ in range(n):
        line, spans = "", []
        for _ in range(rng.randint(1, 4)):
            for _ in range(rng.randint(0, 5)):
                line += pick(word(), word().title(), word().upper(), pick(*_FILL)) + " "
            if rng.rand() < 0.6:
                s, kind = positive()
                spans.append((len(line), len(line) + len(s), kind))
            else:
                s = negative()
            line += s + pick(" ", " ", ". ", ", ", "&&& ", "### ", "!! ")
        out.append((line + word(), spans))
    return out


def _rows(lines: list[str]) -> tuple[list[list[tuple[int, int]]], np.ndarray, np.ndarray]:
    """Token spans, padded shapes and lengths."""
    spans = [[m.span() for m in TOKEN.finditer(s)] for s in lines]
    lengths = np.array([len(t) for t in spans])
    x = np.zeros((len(lines), max(1, lengths.max(initial=1))), np.int64)
    for row, s, t in zip(x, lines, spans, strict=True):
        row[: len(t)] = [shape(s[a:b]) for a, b in t]
    return spans, x, lengths


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)


@lru_cache(maxsize=2)
def train(steps: int = 45, seed: int = 11) -> Field:
    """Maximum likelihood with a small penalty, by Adam on exact gradients (forward and backward sums)."""
    # Lines by hand are few and true to life: they count three times.
    table = examples(seed=seed) + parsed(LINES) * 3
    spans, x, lengths = _rows([line for line, _ in table])
    n, length, k = *x.shape, len(LABELS)
    y = np.zeros((n, length), np.int64)
    for i, (_, marks) in enumerate(table):
        for a, b, kind in marks:
            for t, (c, d) in enumerate(spans[i]):
                if a <= c and d <= b:
                    y[i, t] = 1 + 2 * KINDS.index(kind) + (c > a)
    on = np.arange(length) < lengths[:, None]
    feats, gold = facets(x), np.eye(k)[y]
    sizes = [N_SHAPES] * (2 * REACH + 1) + [N_SHAPES**2] * 2
    params = [np.zeros((s, k)) for s in sizes] + [np.zeros((k, k)), np.zeros(k)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        e, move = sum(w[f] for w, f in zip(params, feats, strict=False)), params[-2]
        alpha, beta = np.zeros((n, length, k)), np.zeros((n, length, k))
        alpha[:, 0] = params[-1] + e[:, 0]
        for t in range(1, length):
            alpha[:, t] = np.where(on[:, t, None], _logsum(alpha[:, t - 1, :, None] + move, 1) + e[:, t], alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            beta[:, t] = np.where(on[:, t + 1, None], _logsum(move + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        z = _logsum(alpha[:, -1], 1)
        diff = (gold - np.exp(alpha + beta - z[:, None, None])) * on[..., None]
        grads = [np.stack([np.bincount(f.ravel(), diff[..., c].ravel(), s) for c in range(k)], 1) for f, s in zip(feats, sizes, strict=True)]
        joint = np.exp(alpha[:, :-1, :, None] + move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
        grads += [np.einsum("nti,ntj->ij", gold[:, :-1] * on[:, 1:, None], gold[:, 1:]) - (joint * on[:, 1:, None, None]).sum((0, 1)), diff[:, 0].sum(0)]
        for p, g, a, b in zip(params, grads, first, second, strict=True):
            g = g / n - 2e-4 * p
            a += 0.1 * (g - a)
            b += 0.02 * (g * g - b)
            p += 0.25 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.98**step)) + 1e-6)
    for j, label in enumerate(LABELS):  # an inside follows only its own kind
        if label[0] == "I":
            ban = [i for i, other in enumerate(LABELS) if other[2:] != label[2:]]
            params[-2][ban, j] = params[-1][j] = -1e4
    return Field(np.stack(params[: 2 * REACH + 1]), np.stack(params[2 * REACH + 1 : -2]), params[-2], params[-1])


# --- application -------------------------------------------------------------------------------------------------

#: Tokens on each side that must bear out a cut, and tokens between the places tried.
BEAR, BLOCK = 4, 32
_CORE_SHAPES = np.array([s == "@" or s[:1] == "d" and s[1:].isdigit() for s in _SHAPES])


class _Shapes(dict):
    def __missing__(self, token: str) -> int:
        found = shape(token)
        if len(self) < 1 << 16 and len(token) < 64:
            self[token] = found
        return found


_shape_of = _Shapes()


def emissions(field: Field, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Scores of the labels of the tokens at the places `at` of the line of shapes x, which has REACH blanks round each text."""
    e = sum(w[x[at + k]] for k, w in zip(range(-REACH, REACH + 1), field.near, strict=True))
    return e + field.pair[0][x[at - 1] * N_SHAPES + x[at]] + field.pair[1][x[at] * N_SHAPES + x[at + 1]]


def certain(field: Field, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the token is outside in the best labelling of its whole text, whatever stands further than BEAR tokens (and their features' reach) away.

    That is so if, for each label BEAR tokens before and each label BEAR
    tokens after, the best way from one to the other is outside here.
    """
    out = np.zeros(len(at), bool)
    for lo in range(0, len(at), 256):
        q = at[lo : lo + 256]
        ways = []
        for first in (1 - BEAR, 1):
            e = emissions(field, x, q[:, None] + np.arange(first, first + BEAR))
            way = field.move + e[:, 0, None, :]
            for t in range(1, BEAR):
                way = (way[:, :, :, None] + field.move).max(2) + e[:, t, None, :]
            ways.append(way)
        through = ways[0][:, :, :, None] + ways[1][:, None, :, :]
        out[lo : lo + 256] = (through[:, :, 0] > through[:, :, 1:].max(2) + 1e-6).all((1, 2))
    return out


def cuts(field: Field, x: np.ndarray, inner: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Places of certain outside tokens, tried in the blocks with a digit or @ and those next to them; inner: places far enough from their text's ends."""
    near = np.unique((core[:, None] // BLOCK + [-1, 0, 1]).ravel())
    near, found = near[near >= 0], []
    for offsets in (np.arange(2), np.arange(2, 12)):
        at = (near[:, None] * BLOCK + offsets).ravel()
        at = at[at < len(x)]
        at = at[inner[at]]
        at = at[certain(field, x, at)]
        found.append(at)
        near = np.setdiff1d(near, at // BLOCK)
    return np.sort(np.concatenate(found))


def _labels(field: Field, x: np.ndarray, start: np.ndarray, length: np.ndarray, head: np.ndarray, tail: np.ndarray, out: np.ndarray) -> None:
    """Viterbi over stretches of x at once; outside is given at the first token unless it is a text's head, and at the last unless it is its tail."""
    width, rows = int(length.max()), np.arange(len(start))
    e = emissions(field, x, np.minimum(start[:, None] + np.arange(width), (start + length - 1)[:, None]))
    e[~head, 0, 1:] = -1e9
    e[rows[~tail], length[~tail] - 1, 1:] = -1e9
    best = np.empty((width, len(start), len(LABELS)))
    best[0] = e[:, 0] + np.where(head[:, None], field.begin, 0)
    for t in range(1, width):
        best[t] = np.where((t < length)[:, None], (best[t - 1][:, :, None] + field.move).max(1) + e[:, t], best[t - 1])
    label = best[-1].argmax(1)
    for t in range(width - 1, -1, -1):
        on = t < length
        out[start[on] + t] = label[on]
        if t:
            label = np.where(on, (best[t - 1] + field.move[:, label].T).argmax(1), label)


def field_spans(field: Field, strings: list[str], most: int = 1 << 15) -> list[list[tuple[int, int, int]]]:
    """(start, kind number, end) for each string, as by decoding each whole; where there is neither digit nor @ spans may be left out.

    A text falls apart at tokens that are certainly outside: the parts don't
    depend on each other, and those without digit or @ needn't be decoded.
    """
    out: list[list] = [[] for _ in strings]
    tokens = [TOKEN.findall(s) for s in strings]
    count = np.array([len(t) for t in tokens], np.int64)
    first = np.cumsum(count + REACH) - count  # place of each text's first token
    x = np.zeros(int((count + REACH).sum()) + 2 * REACH, np.int64)
    inner = np.zeros(len(x), bool)
    for t, a in zip(tokens, first.tolist(), strict=True):
        x[a : a + len(t)] = np.fromiter(map(_shape_of.__getitem__, t), np.int64, len(t))
        inner[a + BEAR : max(a + BEAR, a + len(t) - BEAR)] = True
    core = np.flatnonzero(_CORE_SHAPES[x])
    if not len(core):
        return out
    # Stretches from cut to cut (both included), or to the ends of the text.
    at, full = cuts(field, x, inner, core), count > 0
    ends, cut = np.unique(np.concatenate([at, first[full], (first + count - 1)[full]])), np.zeros(len(x), bool)
    cut[at] = True
    is_head, is_tail = np.zeros(len(x), bool), np.zeros(len(x), bool)
    is_head[first[full]] = is_tail[(first + count - 1)[full]] = True
    start, last = ends[:-1], ends[1:]
    inside = ~is_tail[start] & ~is_head[last]
    start, last = start[inside], last[inside]
    single = (first[full])[count[full] == 1]
    start, last = np.concatenate([start, single]), np.concatenate([last, single])
    some = np.searchsorted(core, last, "right") > np.searchsorted(core, start)
    start, last = start[some], last[some]
    order = np.argsort(last - start, kind="stable")
    start, length = start[order], (last - start)[order] + 1
    labels, lo = np.zeros(len(x), np.int8), 0
    while lo < len(start):
        hi = lo + 1
        while hi < len(start) and (hi + 1 - lo) * length[hi] <= most:
            hi += 1
        a, n = start[lo:hi], length[lo:hi]
        _labels(field, x, a, n, is_head[a], is_tail[a + n - 1], labels)
        lo = hi
    marked = np.flatnonzero(labels)
    for i in np.unique(np.searchsorted(first, marked, "right") - 1).tolist():
        a, t = int(first[i]), tokens[i]
        edge = np.concatenate([[0], np.cumsum(np.fromiter(map(len, t), np.int64, len(t)))]).tolist()
        open_, before = None, -2
        for k in (np.flatnonzero(labels[a : a + len(t)])).tolist():
            v = int(labels[a + k])
            if v % 2 == 1:
                out[i].append(open_ := [edge[k], (v - 1) // 2, edge[k + 1]])
            elif open_ and before == k - 1:
                open_[2] = edge[k + 1]
            else:
                open_ = None
            before = k
    return [[tuple(s) for s in row] for row in out]


_DOMAIN_END = re.compile(r"\.\s*[A-Za-z]{2,}$")


def bears(kind: str, s: str) -> bool:
    """Whether a span that the field found has the content of its kind, however it is written."""
    if "\n" in s or len(s) > 320:
        return False
    if kind == "email":
        local, at, domain = s.partition("@")
        return bool(at) and "@" not in domain and any(c.isalnum() for c in local) and _DOMAIN_END.search(domain) is not None
    if any(c.isalpha() or c == "@" for c in s):
        return False
    if kind == "ip":
        numbers = re.findall("[0-9]+", s)
        return len(numbers) == 4 and all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or "0") <= 255 for x in numbers)
    return good(kind, s)


def find(field: Field, batch: list[str]) -> list[tuple[list, list]]:
    """For each text its base spans and all spans. A span of the field is added if it bears the content of its kind and overlaps no base span."""
    out = []
    for text, got in zip(batch, field_spans(field, batch), strict=True):
        base = base_spans(text)
        every = list(base)
        if got:
            # Base spans of different kinds may overlap; united, they are found by their ends.
            starts, ends = [], []
            for a, _, b in base:
                if ends and a < ends[-1]:
                    ends[-1] = max(ends[-1], b)
                else:
                    starts.append(a)
                    ends.append(b)
            for start, kind, end in got:
                while end > start and text[end - 1].isspace():
                    end -= 1
                near = bisect_right(ends, start)
                if bears(KINDS[kind], text[start:end]) and (near == len(starts) or starts[near] >= end):
                    every.append((start, kind, end))
        out.append((base, sorted(every)))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span, or stretch of overlapping spans, replaced by its first kind in brackets."""
    out, done = [], 0
    for a, k, b in spans:
        if a >= done:
            out += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


_CORE_BYTES = np.isin(np.arange(256), list(b"0123456789@"))


def _candidates(array: pa.Array) -> np.ndarray:
    """Which texts have a digit or an @."""
    data, off = bytes_of(array)
    at = np.flatnonzero(_CORE_BYTES[data])
    return np.flatnonzero(np.diff(np.searchsorted(at, off)))


def detect(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of docs (doc_id, text).

    Null counts as empty; texts without spans have counts of 0, the digest of
    the empty string and empty spans. Repeated rows fare alike; extra columns
    are left out; an empty table gives an empty result.
    """
    slim_batches(docs.sparkSession)
    field, nothing = field or train(), hashlib.sha256(b"").hexdigest()

    def rows(batches):
        for batch in batches:
            array = texts(batch.column(1))
            n = np.zeros((len(KINDS), len(array)), np.int64)
            digest, spans = [nothing] * len(array), [""] * len(array)
            at = _candidates(array)
            for i, (base, every) in zip(at.tolist(), find(field, array.take(pa.array(at)).to_pylist()), strict=True):
                for _, k, _ in base:
                    n[k, i] += 1
                digest[i], spans[i] = hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, n), pa.array(digest), pa.array(spans)], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    own = docs.select("doc_id", "text")
    return own.mapInArrow(lean(rows), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with all spans in `text` replaced; a null text stays null, other columns stay as they are but n_chars, which follows the text."""
    slim_batches(docs.sparkSession)
    field = field or train()

    def rows(batches):
        for batch in batches:
            k = batch.schema.get_field_index("text")
            array = texts(batch.column(k))
            at = _candidates(array)
            own = array.take(pa.array(at)).to_pylist()
            new = {int(i): redacted(t, every) for i, t, (_, every) in zip(at, own, find(field, own), strict=True) if every}
            if new:
                column = batch.column(k).to_pylist()
                for i, t in new.items():
                    column[i] = t
                batch = batch.set_column(k, batch.schema.field(k), pa.array(column, batch.schema.field(k).type))
            yield batch

    out = docs.mapInArrow(lean(rows), StructType(docs.schema.fields))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out
