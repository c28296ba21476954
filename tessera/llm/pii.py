r"""Personal data by a semi-Markov conditional random field over candidate spans.

Four kinds have a base pattern each (email, ip, card, phone), found exactly, leftmost and without overlap within a kind;
what fails its kind's test (parts of an address, digits, Luhn) is dropped. The field adds what the patterns miss: numbers
without a country's plus, other separators, "(at)" for @, letters outside ASCII, and the like.

Texts are looked at in windows around digits, @ and "(at)". A window's tokens are runs of ASCII letters, of digits and of
other letters, and single characters. Every run of at most LONGEST tokens that may be of a kind (its whole-span test: a
card's Luhn digits, an address' four parts) is a candidate segment; features of the whole span (digits, parts,
separators, brackets, what stands before and behind it, cue words) are weighed for each kind, and kinds next to each
other as well. Dynamic programming over a window's tokens finds the best of all ways to cut it into entities, no longer than
LONGEST, and single tokens outside them: boundaries and kinds are chosen together. Found patterns are held in that
decision by a score that nothing outweighs. Candidates that could not gain even with the best neighbours are left out
beforehand, which changes no result.

Training maximises the exact conditional likelihood by forward and backward sums over all segmentations. Its data are
SAMPLE windows of the corpus (those with the smallest hashes, of some SAMPLE_DOCS documents), labelled by the base patterns; the same windows
with an entity rewritten in a way that the patterns miss, or by a number that is none (a date, an amount, a version);
and made-up windows of each kind, which also serve tables without any. Nothing else is learned from.

Defined cases: a null or empty text has no spans (their SHA-256 is that of the empty string). A null doc_id and
repeated rows are texts like any other. An empty table gives no rows. Ties between segmentations go to fewer entities,
then to those that end first. Offsets are code points, ends exclusive. Other columns are ignored by find() and pass
through redact() unchanged. Texts are read whole, in time linear in their length.
"""

from __future__ import annotations

import dataclasses
import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mapped

KINDS = ("email", "ip", "card", "phone")
#: Documents of the corpus (by hash of the id) whose windows are looked at for training, about; windows that the field is
#: trained on, at most; and characters of one of them.
SAMPLE_DOCS = 40_000
SAMPLE = 1500
MOST_CHARS = 240
#: Tokens of an entity, at most.
LONGEST = 24
#: Characters between two digits of one window, at most, and around them.
REACH, AROUND = 24, 48
#: Tokens before a candidate among which cues count.
NEAR = 4
#: Tokens whose candidates are weighed at once.
BLOCK = 1 << 13
ROUNDS = 60
SURE = 1e6

# The base patterns' characters. Digits and letters are ASCII. Possessive forms match the same text as
# plain ones here, without going back over it.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\x00-\x7F]+|.", re.S)
# Words before an entity that speak for a kind.
CUES = {
    "email": {"mail", "email", "contact", "write"},
    "ip": {"ip", "host", "server", "address", "addr"},
    "card": {"card", "visa", "mastercard", "credit", "cc"},
    "phone": {"tel", "phone", "call", "fax", "mobile", "cell"},
}

FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others."""
    total = sum(int(x) for x in digits[-1::-2]) + sum(int(x) * 2 - 9 * (x > "4") for x in digits[-2::-2])
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(x for x in text if "0" <= x <= "9")


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in LOCAL:
            begin -= 1
        match = DOMAIN.match(text, at + 1) if begin < at else None
        if match:
            end = match.end()
            yield begin, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what the patterns find, by kind and start."""
    out = [("email", a, b) for a, b in _emails(text)]
    # a part of more than three digits may have zeros in front
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = _only_digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_only_digits(m[0])) <= 15]
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def in_order(spans) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


# ---- windows and candidates


def windows(text: str, base) -> list[tuple[int, int]]:
    """Stretches of the text that can hold entities: all around triggers, and all of the base's spans."""
    marks = sorted([(m.start(), m.end()) for m in TRIGGER.finditer(text)] + [(a, b) for _, a, b in base])
    out: list[list[int]] = []
    for a, b in marks:
        if out and a - out[-1][1] <= REACH:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(max(a - AROUND, 0, out[i - 1][1] if i else 0), min(b + AROUND, len(text), out[i + 1][0] if i + 1 < len(out) else len(text))) for i, (a, b) in enumerate(out)]


#: Kinds of tokens: letters, digits, letters beyond ASCII; the single characters below by their own; others 3.
SINGLES = " .-()+@[]/:,_"
LETTERS, DIGITS, BEYOND, OTHER, FIRST_SINGLE = 0, 1, 2, 3, 4
SPACE, DOT, DASH, OPEN, CLOSE, PLUS, AT, OPEN2, CLOSE2, SLASH, COLON, COMMA, UNDERSCORE = range(FIRST_SINGLE, FIRST_SINGLE + len(SINGLES))
N_TOKEN_KINDS = FIRST_SINGLE + len(SINGLES)


def _kind_of(token: str) -> int:
    c = token[0]
    if c in SINGLES:
        return FIRST_SINGLE + SINGLES.index(c)
    return DIGITS if "0" <= c <= "9" else LETTERS if c.isascii() and c.isalpha() else BEYOND if not c.isascii() else OTHER


@dataclasses.dataclass
class Tokens:
    """The tokens of several windows, one behind the other."""

    text: list[str]
    kind: np.ndarray
    begin: np.ndarray  # in the window's text
    end: np.ndarray
    window: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> "Tokens":
        words, begin, end, window = [], [], [], []
        for number, text in enumerate(texts):
            for m in TOKEN.finditer(text):
                words.append(m[0])
                begin.append(m.start())
                end.append(m.end())
                window.append(number)
        return cls(words, np.array([_kind_of(x) for x in words], np.int64), *(np.array(x, np.int64) for x in (begin, end, window)))


#: Numbers of digits that have a feature each.
DIGIT_STEPS = (1, 4, 7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 20)
_NAMES = [
    "bias", *(f"digits>={n}" for n in DIGIT_STEPS), "plus", "double zero", "open first", "brackets paired", "brackets odd", "no separator", "dots", "dashes", "spaces",
    "slashes", "underscores", "other", "several separators", "double separator", "four parts", "luhn", "at", "at word", "space at at", "dots behind at", "letters last",
    "beyond ascii", "letters", "before: letter", "before: digit", "before: separator and digit", "before: symbol", "after: letter", "after: digit", "after: separator and digit",
    "after: symbol", "even groups of four", "last group of four", "first group of year", "groups of two", "groups of three", "tokens>8", "tokens>14", *(f"cue {k}" for k in KINDS),
]


def candidates(tokens: Tokens, lo: int = 0, hi: int | None = None):
    """(first token, end token, kinds allowed, features) of all candidate segments that begin in tokens lo to hi."""
    n = len(tokens.kind)
    hi = n if hi is None else hi
    kind, window = tokens.kind, tokens.window
    base, stop = max(0, lo - NEAR), min(n, hi + LONGEST + NEAR)
    k = kind[base:stop]
    size = (tokens.end - tokens.begin)[base:stop]
    at_word = np.zeros(len(k), bool)
    for i in np.flatnonzero(k[1:-1] == LETTERS) if len(k) > 2 else ():
        at_word[i + 1] = tokens.text[base + i + 1] == "at" and k[i] in (OPEN, OPEN2) and k[i + 2] in (CLOSE, CLOSE2)
    value = np.array([int(x) if len(x) < 10 else 10**9 for x in (tokens.text[base + i] if k[i] == DIGITS else "0" for i in range(len(k)))], np.int64)
    total = lambda x: np.r_[0, np.cumsum(x)]
    counts = {c: total(k == c) for c in range(N_TOKEN_KINDS)}
    digits, ats = total(np.where(k == DIGITS, size, 0)), total((k == AT) | at_word)
    first = np.isin(k, (LETTERS, DIGITS, BEYOND, OPEN, PLUS))
    last = np.isin(k, (LETTERS, DIGITS, BEYOND))
    begin = np.flatnonzero(first[lo - base : hi - base]) + lo - base
    ends = begin[:, None] + np.arange(1, LONGEST + 1)
    s = np.repeat(begin, LONGEST)
    e = ends.reshape(-1)
    ok = e <= len(k)
    s, e = s[ok], e[ok]
    w = window[base:stop]
    ok = (w[s] == w[e - 1]) & last[e - 1] & ((digits[e] > digits[s]) | (ats[e] > ats[s]))
    s, e = s[ok], e[ok]
    of = lambda c: counts[c][e] - counts[c][s]
    nd, nat, letters = digits[e] - digits[s], ats[e] - ats[s], of(LETTERS) + of(BEYOND)
    numeric = (letters == 0) & (nat == 0)
    parts = of(DIGITS)
    symbols = of(OTHER) + of(COLON) + of(COMMA)
    big = total(value > 255)
    four = numeric & (parts == 4) & (of(DOT) == 3) & (big[e] == big[s]) & (of(DASH) + of(PLUS) + of(OPEN) + of(SLASH) + of(UNDERSCORE) + symbols == 0) & (k[s] == DIGITS)
    at_index = np.maximum.accumulate(np.where((k == AT) | at_word, np.arange(len(k)), -1))[e - 1]
    behind = np.where(nat == 1, at_index, s)
    dots_behind = np.where(nat == 1, counts[DOT][e] - counts[DOT][behind], 0)
    mail = (nat == 1) & (at_index > s) & (dots_behind >= 1) & (of(SLASH) + symbols + of(OPEN) * (at_word[behind] == 0) == 0) & np.isin(k[s], (LETTERS, DIGITS, BEYOND)) & (letters > 0)
    mail &= np.isin(k[e - 1], (LETTERS, BEYOND)) & (of(SPACE) <= 2 * (of(DOT) + 1))
    long_number = numeric & (nd >= 7) & (nd <= 19) & (symbols == 0) & (k[e - 1] == DIGITS) & np.isin(k[s], (DIGITS, PLUS, OPEN))
    phone = long_number & (nd <= 15) & ~four & (of(PLUS) == (k[s] == PLUS)) & (of(OPEN) <= 1) & (of(OPEN) == of(CLOSE))
    card = long_number & (nd >= 13) & (k[s] == DIGITS) & (of(PLUS) + of(OPEN) == 0)
    for i in np.flatnonzero(card):
        card[i] = luhn("".join(tokens.text[base + t] for t in range(s[i], e[i]) if k[t] == DIGITS))
    allowed = np.stack([mail, four, card, phone], 1)
    ok = allowed.any(1)
    s, e, allowed, nd, nat, letters, parts, four, card, dots_behind, behind, symbols = (x[ok] for x in (s, e, allowed, nd, nat, letters, parts, four, card, dots_behind, behind, symbols))
    pad = lambda x, i, none: np.where((i >= 0) & (i < len(k)), x[np.clip(i, 0, max(0, len(k) - 1))], none)
    same = lambda i: (i >= 0) & (i < len(k)) & (pad(w, i, -1) == w[s]) if len(s) else np.zeros(0, bool)
    neighbour = lambda i: np.where(same(i), pad(k, i, -1), -1)
    before, before2, after, after2 = neighbour(s - 1), neighbour(s - 2), neighbour(e), neighbour(e + 1)
    word = lambda x: np.isin(x, (LETTERS, BEYOND, UNDERSCORE))
    joint = lambda x: np.isin(x, (DOT, DASH, SLASH, COLON, COMMA, PLUS))
    seps = [of(c) > 0 for c in (DOT, DASH, SPACE, SLASH, UNDERSCORE)]
    double = total(np.r_[False, (k[1:] == k[:-1]) & np.isin(k[1:], (SPACE, DOT, DASH))] if len(k) else k == 1)
    groups = lambda n: (total((k == DIGITS) & (size == n))[e] - total((k == DIGITS) & (size == n))[s]) == parts
    year = (value >= 1900) & (value < 2100) & (size == 4)
    features = [
        np.ones(len(s)), *(nd >= n for n in DIGIT_STEPS), k[s] == PLUS, (k[s] == DIGITS) & np.array([tokens.text[base + i].startswith("00") for i in s.tolist()], bool), k[s] == OPEN, (of(OPEN) > 0) & (of(OPEN) == of(CLOSE)),
        of(OPEN) != of(CLOSE), sum(seps) == 0, *seps, symbols > 0, sum(x.astype(int) for x in seps) > 1, double[e] > double[np.minimum(s + 1, e)], four, card, nat > 0, (nat > 0) & at_word[behind],
        (nat > 0) & ((pad(k, behind - 1, -1) == SPACE) | (pad(k, behind + 1, -1) == SPACE)), dots_behind > 0, word(k[e - 1]), of(BEYOND) > 0, letters > 0, word(before), before == DIGITS,
        joint(before) & (before2 == DIGITS), (before >= OTHER) & (before != SPACE), word(after), after == DIGITS, joint(after) & (after2 == DIGITS), (after == OTHER) | np.isin(after, (AT, SLASH, COLON, PLUS)),
        groups(4), (k[e - 1] == DIGITS) & (size[e - 1] == 4), year[s] | year[e - 1], groups(2), groups(3), e - s > 8, e - s > 14,
    ]
    start = np.maximum(s - NEAR, np.searchsorted(w, w[s]))
    lowered = {i: tokens.text[base + i].lower() for i in np.flatnonzero(k == LETTERS).tolist()}
    cues = []
    for kind_cues in CUES.values():
        marks = np.zeros(len(k), bool)
        marks[[i for i, x in lowered.items() if x in kind_cues]] = True
        cues.append(total(marks)[s] > total(marks)[start])
    matrix = np.stack([*features, *cues], 1).astype(np.float32) if len(s) else np.zeros((0, len(_NAMES)), np.float32)
    return s + base, e + base, allowed, matrix


# ---- the field


@dataclasses.dataclass
class Field:
    weights: np.ndarray  # features x kinds
    next_to: np.ndarray  # kinds x kinds: a kind right behind another

    def gain(self) -> float:
        """What neighbours can add to a candidate, at most."""
        return 2 * max(0.0, float(self.next_to.max(initial=0.0)))


def likelihood(field: Field, spans, gold, behind, tokens: Tokens):
    """Log-likelihood of the gold segments and its gradient, by forward and backward sums over all segmentations of all
    windows side by side. spans: first, end, kind and features' row of each allowed pair of segment and kind; behind:
    pairs of gold ones of which the second stands right behind the first."""
    s, e, y, row, matrix = spans
    scores = (matrix @ field.weights)[row, y].astype(float)
    number = np.r_[0, np.cumsum(np.bincount(tokens.window))] if len(tokens.window) else np.zeros(1, int)
    sizes = np.diff(number)
    count, longest, kinds = len(sizes), int(sizes.max(initial=0)), len(KINDS)
    w = tokens.window[s]
    a, b = s - number[w], e - number[w]  # boundaries within the window
    forward = np.full((count, longest + 1, kinds + 1), -np.inf)
    forward[:, 0, 0] = 0
    entry = np.zeros((kinds + 1, kinds))
    entry[1:] = field.next_to
    by_end, by_begin = np.argsort(b, kind="stable"), np.argsort(a, kind="stable")
    cut_end, cut_begin = np.searchsorted(b[by_end], np.arange(longest + 2)), np.searchsorted(a[by_begin], np.arange(longest + 2))
    arrive = np.zeros(len(s))
    with np.errstate(divide="ignore"):
        for i in range(1, longest + 1):
            forward[:, i, 0] = np.logaddexp.reduce(forward[:, i - 1], 1)
            own = by_end[cut_end[i] : cut_end[i + 1]]
            if len(own):
                arrive[own] = np.logaddexp.reduce(forward[w[own], a[own]] + entry[:, y[own]].T, 1) + scores[own]
                np.logaddexp.at(forward, (w[own], np.full(len(own), i), y[own] + 1), arrive[own])
        ends = (np.arange(count), sizes)
        total = np.logaddexp.reduce(forward[ends], 1)
        backward = np.full((count, longest + 1, kinds + 1), -np.inf)
        for i in range(longest, -1, -1):
            backward[sizes == i, i] = 0
            inner = sizes > i
            if i < longest:
                backward[inner, i] = backward[inner, i + 1, 0][:, None]
            own = by_begin[cut_begin[i] : cut_begin[i + 1]]
            if len(own):
                leave = scores[own] + backward[w[own], b[own], y[own] + 1]
                for p in range(kinds + 1):
                    np.logaddexp.at(backward, (w[own], a[own], np.full(len(own), p)), leave + entry[p, y[own]])
    rest = scores + backward[w, b, y + 1] - total[w]
    pairs = np.exp(forward[w, a] + entry[:, y].T + rest[:, None])  # of what is before, and the segment
    share = pairs.sum(1)
    weights = np.zeros_like(field.weights)
    next_to = np.zeros_like(field.next_to)
    for k in range(kinds):
        mine = y == k
        weights[:, k] = matrix[row[mine]].T @ (gold[mine] - share[mine])
        next_to[:, k] = -pairs[mine, 1:].sum(0)
    np.add.at(next_to, (y[behind[0]], y[behind[1]]), 1)
    return float(scores[gold > 0].sum() + field.next_to[y[behind[0]], y[behind[1]]].sum() - total.sum()), weights, next_to


def train(examples: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = ROUNDS, penalty: float = 0.02) -> Field:
    """Weights that maximise the likelihood of (text, spans) examples, less a penalty on their squares, by Adam steps on the
    whole. A span that is no candidate is left out."""
    field = Field(np.zeros((len(_NAMES), len(KINDS))), np.zeros((len(KINDS), len(KINDS))))
    tokens = Tokens.of([t for t, _ in examples])
    if not len(tokens.kind):
        return field
    s, e, allowed, matrix = candidates(tokens)
    row, y = np.nonzero(allowed)
    wanted = {(i, a, b, KINDS.index(k)) for i, (_, spans) in enumerate(examples) for k, a, b in spans}
    place = zip(tokens.window[s[row]].tolist(), tokens.begin[s[row]].tolist(), tokens.end[e[row] - 1].tolist(), y.tolist())
    gold = np.array([x in wanted for x in place], float)
    spans = (s[row], e[row], y, row, matrix)
    chosen = np.flatnonzero(gold)
    starts = {(int(tokens.window[spans[0][i]]), int(spans[0][i])): i for i in chosen.tolist()}
    behind = [(i, starts[int(tokens.window[spans[0][i]]), int(spans[1][i])]) for i in chosen.tolist() if (int(tokens.window[spans[0][i]]), int(spans[1][i])) in starts]
    behind = np.array(behind, int).reshape(-1, 2).T
    state = [np.zeros_like(field.weights), np.zeros_like(field.weights), np.zeros_like(field.next_to), np.zeros_like(field.next_to)]
    for t in range(1, rounds + 1):
        _, *gradients = likelihood(field, spans, gold, behind, tokens)
        for i, (name, g) in enumerate(zip(("weights", "next_to"), gradients)):
            x = getattr(field, name)
            g = g - penalty * x
            state[2 * i] = 0.9 * state[2 * i] + 0.1 * g
            state[2 * i + 1] = 0.99 * state[2 * i + 1] + 0.01 * g * g
            step = state[2 * i] / (1 - 0.9**t) / (np.sqrt(state[2 * i + 1] / (1 - 0.99**t)) + 1e-6)
            setattr(field, name, x + 0.3 * (1 - t / (rounds + 1)) * step)
    return field


def decode(field: Field, texts: list[str], sure: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """The best segmentation of each window, with its sure spans (in the window's offsets) as likely as can be."""
    tokens = Tokens.of(texts)
    fixed = {(i, a, b, KINDS.index(k)) for i, spans in enumerate(sure) for k, a, b in spans}
    ends: dict[int, list[tuple[int, int, float]]] = {}  # by end token: first token, kind, score
    for lo in range(0, len(tokens.kind), BLOCK):
        s, e, allowed, matrix = candidates(tokens, lo, min(lo + BLOCK, len(tokens.kind)))
        scores = np.where(allowed, matrix @ field.weights, -np.inf)
        for i, y in zip(*np.nonzero(scores + field.gain() > 0)):
            ends.setdefault(int(e[i]), []).append((int(s[i]), int(y), float(scores[i, y])))
    if fixed:
        first = {(int(w), int(b)): t for t, (w, b) in enumerate(zip(tokens.window, tokens.begin))}
        last = {(int(w), int(b)): t + 1 for t, (w, b) in enumerate(zip(tokens.window, tokens.end))}
        for i, a, b, y in fixed:
            if (i, a) in first and (i, b) in last:
                ends.setdefault(last[i, b], []).append((first[i, a], y, SURE))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    bounds = np.searchsorted(tokens.window, np.arange(len(texts) + 1))
    by_window: dict[int, list[int]] = {}
    for t in sorted(ends):
        by_window.setdefault(int(tokens.window[t - 1]), []).append(t)
    kinds = len(KINDS)
    for number, own in by_window.items():
        a, b = int(bounds[number]), int(bounds[number + 1])
        # best[t][label]: score, then the segment that ends at t, or none
        best = [[-np.inf] * (kinds + 1) for _ in range(b - a + 1)]
        back: list[list] = [[None] * (kinds + 1) for _ in range(b - a + 1)]
        best[0][0] = 0.0
        for t in range(1, b - a + 1):
            p = max(range(kinds + 1), key=lambda x: (best[t - 1][x], -x))
            best[t][0], back[t][0] = best[t - 1][p], (t - 1, p)
            for first_token, y, score in ends.get(t + a, ()):
                i = first_token - a
                values = [best[i][0], *(best[i][x + 1] + field.next_to[x, y] for x in range(kinds))]
                p = max(range(kinds + 1), key=lambda x: (values[x], -x))
                if values[p] + score > best[t][y + 1]:
                    best[t][y + 1], back[t][y + 1] = values[p] + score, (i, p)
        t, label = b - a, max(range(kinds + 1), key=lambda x: (best[b - a][x], -x))
        while t:
            i, p = back[t][label]
            if label:
                out[number].append((KINDS[label - 1], int(tokens.begin[a + i]), int(tokens.end[a + t - 1])))
            t, label = i, p
        out[number].reverse()
    return out


def find_in(field: Field, texts: list[str]) -> list[tuple[list, list]]:
    """(base, all) spans of each text. Spans that the field adds overlap none of the base's; all of the base's stay."""
    bases = [base_spans(t) for t in texts]
    places = [(i, a, b) for i, t in enumerate(texts) for a, b in windows(t, bases[i])]
    inside: list[list] = []
    for i, a, b in places:
        inside.append([(k, x - a, y - a) for k, x, y in bases[i] if a <= x and y <= b])
    added: list[set] = [set() for _ in texts]
    found = decode(field, [texts[i][a:b] for i, a, b in places], inside)
    for (i, a, _), spans in zip(places, found):
        taken = [(x, y) for _, x, y in bases[i]]
        added[i] |= {(k, x + a, y + a) for k, x, y in spans if all(y + a <= p or q <= x + a for p, q in taken)}
    return [(base, in_order({*base, *more})) for base, more in zip(bases, added)]


# ---- training data


def rewritten(kind: str, text: str, turn: int) -> str:
    """An entity in a form that its pattern misses."""
    digits = _only_digits(text)
    if kind == "email":
        name, _, domain = text.rpartition("@")
        forms = [f"{name} @ {domain}", f"{name}(at){domain}", f"{name} [at] {domain}", f"{name}é@{domain}", f"{name} (at) {domain}"]
    elif kind == "ip":
        forms = [text.replace(".", " . "), text.replace(".", ". ")]
    elif kind == "card":
        forms = [".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), "/".join(digits[i : i + 4] for i in range(0, len(digits), 4)), "  ".join(digits[i : i + 4] for i in range(0, len(digits), 4))]
    else:
        rest = digits[-10:]
        forms = [f"({rest[:3]}) {rest[3:6]}-{rest[6:]}", f"{rest[:3]}-{rest[3:6]}-{rest[6:]}", f"00{digits[:-10] or '1'} {rest[:3]} {rest[3:6]} {rest[6:]}", f"{rest[:3]}.{rest[3:6]}.{rest[6:]}", f"+{digits[:-10] or '1'}/{rest[:3]}/{rest[3:]}"]
    return forms[turn % len(forms)]


def numbers(seed: int) -> list[str]:
    """Numbers that are no personal data: dates, times, amounts, versions, codes."""
    r = np.random.default_rng(seed)
    d = lambda n: "".join(map(str, r.integers(0, 10, n)))
    year, month, day = int(r.integers(1900, 2100)), int(r.integers(1, 13)), int(r.integers(1, 29))
    hexes = "".join(r.choice(list("0123456789abcdef"), 40))
    return [
        f"{year}-{month:02d}-{day:02d}", f"{day:02d}.{month:02d}.{year}", f"{year}{month:02d}{day:02d}", f"{year}-{year + 5}", f"{month:02d}/{day:02d}/{year}", f"{d(1)}.{d(2)}.{d(1)}", f"{d(8)}",
        f"{d(12)}", f"{d(3)},{d(3)},{d(3)}", f"{d(2)}:{d(2)}:{d(2)}.{d(6)}", f"{d(9)}", f"{d(4)} {d(4)}", f"#{d(7)}", f"{d(7)}.{d(2)}", hexes, f"{d(5)}-{d(5)}", f"{d(10)}", f"x{d(9)}", f"{d(3)} {d(3)} {d(2)} {d(1)}",
        f"{year}-{month:02d}-{day:02d} {d(2)}:{d(2)}", f"{d(3)}.{d(4)}.{d(3)}.{d(3)}", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(11)}", f"{d(13)}",
    ]


def made_up(count: int = 60) -> list[tuple[str, str, str]]:
    """(before, entity's text, kind) of each kind, the same ones always."""
    r = np.random.default_rng(7)
    d = lambda n: "".join(map(str, r.integers(0, 10, n)))
    word = lambda: "".join(r.choice(list("abcdefghiklmnoprstuvw"), int(r.integers(2, 9))))
    out = []
    for _ in range(count):
        number = d(15)
        number += next(x for x in "0123456789" if luhn(number + x))
        cues = {k: sorted(x)[int(r.integers(0, len(x)))] for k, x in CUES.items()}
        pick = lambda kind: f"{word()} {cues[kind]}: " if r.random() < 0.3 else f"{word()} {word()} "
        out += [
            (pick("email"), f"{word()}.{d(2)}@{word()}.{word()}.com", "email"), (pick("ip"), ".".join(str(int(x)) for x in r.integers(0, 256, 4)), "ip"),
            (pick("card"), number, "card"), (pick("phone"), f"+{int(r.integers(1, 99))} ({d(3)}) {d(3)}-{d(4)}", "phone"),
        ]
    return out


def examples(sample: list[str]) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Windows with their spans: as they are, rewritten, and with other numbers in an entity's place."""
    out = []
    made = [(f"{before}{entity} und {before}", [(kind, len(before), len(before) + len(entity))]) for before, entity, kind in made_up()]
    for turn, (text, spans) in enumerate([*made, *((t, base_spans(t)) for t in sample)]):
        out.append((text, spans))
        if len(spans) == 1:
            (kind, a, b), other = spans[0], numbers(turn)
            form = rewritten(kind, text[a:b], turn)
            out.append((f"{text[:a]}{form}{text[b:]}", [(kind, a, a + len(form))]))
            out += [(f"{text[:a]}{other[(turn + i) % len(other)]}{text[b:]}", []) for i in (0, 11)]
    return out


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Train on windows of the corpus and made-up ones; see the module."""

    def run(batches):
        for batch in batches:
            rows = [(i, t) for i, t in _with_triggers(batch)]
            out = [(i, n, t[a:b]) for i, t in rows for n, (a, b) in enumerate(windows(t, ())) if b - a <= MOST_CHARS]
            ids = batch.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _, _ in out], pa.int64()), pa.array([n for _, n, _ in out], pa.int32()), pa.array([t for *_, t in out], pa.string())], ["doc_id", "number", "window"])

    # few enough that the best of every task are few as well
    share = -(-(SAMPLE_DOCS << 20) // max(1, docs.count()))
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < share).where("doc_id is not null")
    found = mapped(some, run, "doc_id long, number int, window string")
    rows = found.orderBy(F.xxhash64("doc_id", "number"), "doc_id", "number", "window").limit(sample).collect()  # bounded by sample
    return train(examples([r.window for r in rows]))


# ---- use


def _with_triggers(batch: pa.RecordBatch):
    """(row, text) of the texts that have a digit, an @ or an (at)."""
    column = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
    at = np.flatnonzero(pc.match_substring_regex(column, r"[0-9@]|[(\[]at[)\]]").to_numpy(zero_copy_only=False))
    return zip(at.tolist(), column.take(pa.array(at)).to_pylist())


def find(docs: DataFrame, field: Field) -> DataFrame:
    """See FOUND: counts and digest of the base's spans, all spans, and how many of them the field added."""
    held = docs.sparkSession.sparkContext.broadcast(field)
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            counts = np.zeros((n, len(KINDS)), np.int64)
            digests, spans, added = [nothing] * n, [""] * n, np.zeros(n, np.int64)
            rows = list(_with_triggers(batch))
            for (i, _), (base, every) in zip(rows, find_in(held.value, [t for _, t in rows])):
                for kind, _, _ in base:
                    counts[i, KINDS.index(kind)] += 1
                digests[i], spans[i], added[i] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)
            arrays = [batch.column("doc_id"), *(pa.array(c) for c in counts.T), pa.array(digests), pa.array(spans), pa.array(added)]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in FOUND.split(", ")])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, FOUND)


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """docs with every span in text replaced by its kind in angle brackets; spans that overlap become one."""
    held = docs.sparkSession.sparkContext.broadcast(field)
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows = list(_with_triggers(batch))
            for (i, text), (_, every) in zip(rows, find_in(held.value, [t for _, t in rows])):
                out, end = [], 0
                for kind, a, b in sorted(every, key=lambda x: (x[1], -x[2])):
                    if a >= end:
                        out += [text[end:a], f"<{kind}>"]
                    end = max(end, b)
                texts[i] = "".join([*out, text[end:]])
            yield batch.set_column(place, batch.schema.field(place).name, pa.array(texts, batch.schema.field(place).type))

    return mapped(docs, run, docs.schema)


def audit(docs: DataFrame) -> DataFrame:
    """find() by a field that is trained on docs."""
    return find(docs, fit(docs))
