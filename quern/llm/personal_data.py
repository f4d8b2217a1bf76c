"""Personal data by patterns and a skip-chain conditional random field.

Four kinds are found: e-mail addresses, IP addresses, card and phone numbers.
Patterns give the base spans.  The field adds those that patterns miss: numbers
that stand next to other numbers, national and spelled-out forms, and weaker
mentions of what the document names elsewhere.  Its variables are the document's
candidate tokens (numbers, what has an at sign, and addresses spelled out);
all other words are outside of any span.  Neighbouring candidates share chain
potentials; each candidate also shares skip potentials with the next equal one,
and with the next one that ends with the same seven digits, wherever in the
document they stand, so labels of an entity agree over the whole text.  Beliefs
come from loopy message passing, of all documents of a slice at once; the weights
are fitted by the gradient of the beliefs on made documents (``made_document``)
with mentions of all forms, repeats, and numbers that are no personal data.

Defined cases: a null or empty text has no spans; a very long text is searched
whole, but a run of more than 254 characters, longer than any address or number
may be, is no candidate of the field; repeated rows are rows of their own; where
an added span would overlap a base span, the base span stays alone; spans with one start go
by their kind; ids may be of any type or null; other columns are left out,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import task, text_slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_ANY = re.compile(r"[0-9@]|[\[(] ?(?:at|AT) ?[\])]| dot | DOT ")


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    doubled = digits[-2::-2]
    return (sum(map(int, digits[-1::-2])) + sum(2 * int(x) - 9 * (x > "4") for x in doubled)) % 10 == 0


def _is_card(digits: str) -> bool:
    return 12 <= len(digits) <= 19 and luhn(digits)


def _small(part: str) -> bool:
    """Whether the digits are 255 at most; very many of them aren't turned into a number."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _emails(text: str) -> Iterator[Span]:
    """One domain after each at sign; what stands before it, back to the span before, is the name."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL_END.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, (end := found.end())
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, those that fail their check left out, by start and kind."""
    found = list(_emails(text))
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() < 40 and _is_card(_NOT_DIGIT.sub("", m[0]))]
    found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


# the field's variables

LABELS = ("out", "email", "ip", "card", "card+", "phone", "phone+")
_KIND_OF = ("", "email", "ip", "card", "card", "phone", "phone")
#: A run of more characters is no candidate.
LONG_RUN = 254

_RUN = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
_PARTS = re.compile(r"[A-Za-z0-9._%+@()-]+")
_TOKEN = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*|\(\+?[0-9]{1,4}\)|\+?[0-9A-Za-z]+(?:[.-][0-9A-Za-z]+)*")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?[\[(] ?(?:at|AT|@) ?[\])] ?| (?:at|AT) )[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[(] ?(?:dot|DOT|\.) ?[\])] ?| (?:dot|DOT) )[A-Za-z0-9-]{2,63}){1,4}")
_BETWEEN = re.compile(r"[ ().,/-]{0,3}")
_BEFORE = re.compile(r"([A-Za-z]+)[^A-Za-z0-9\n]{0,3}$")

_KNOWN_END = re.compile(r"[^A-Za-z](?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|ch|at|nl)$")

#: Fixed words that name a kind before a value, by kind; the last are of values that are no personal data.
CUES = {
    "email": "mail email emails contact write address courriel correo",
    "phone": "phone tel telephone telefon call mobile fax cell reach telefono",
    "card": "card visa mastercard amex credit payment karte carte tarjeta",
    "ip": "ip host server addr login client from",
    "none": "version release order isbn invoice token password key year section page chapter id item license licence no number room",
}
_CUE_OF = {w: k for k, words in CUES.items() for w in words.split()}


@dataclass
class Candidate:
    start: int
    end: int
    text: str
    digits: str
    shape: str


def _shape(text: str, digits: str) -> str:
    if "@" in text:
        return "mail" if "." in text[text.index("@") :] else "at"
    if re.search("[A-Za-z]", text):
        return "spelled" if re.search(r"\b(?:at|AT)\b", text) and " " in text or "[" in text or re.search(r"\((?:at|AT|dot|DOT)\)", text) else "mixed"
    if text[0] == "+":
        return "plus"
    if text[0] == "(":
        return "bracketed"
    parts = text.split(".")
    if len(parts) == 4 and "-" not in text:
        return "quad" if all(map(_small, parts)) else "wide quad"
    return "dotted" if len(parts) > 1 else "dashed" if "-" in text else "digits"


def candidates(text: str) -> list[Candidate]:
    """In order; spelled-out addresses first, others where they don't lie in one.  Letters and digits mixed are a word."""
    out, spelled = [], [m.span() for m in _SPELLED.finditer(text)] if re.search(r"[\[(] ?(?:at|AT|@) ?[\])]| dot | DOT ", text) else []
    # without brackets, an address spells its dot out
    spelled = [(a, b) for a, b in spelled if re.search(r"[\[(]| (?:dot|DOT) ", text[a:b])]
    out += [Candidate(a, b, text[a:b], "", "spelled") for a, b in spelled]
    ends = [b for _, b in spelled]
    for run in _RUN.finditer(text):
        for part in _PARTS.finditer(text, *run.span()):
            if part.end() - part.start() > LONG_RUN:
                continue
            for m in _TOKEN.finditer(text, *part.span()):
                token = m[0]
                digits = _NOT_DIGIT.sub("", token)
                k = bisect_right(ends, m.start())
                if (digits or "@" in token) and not (k < len(ends) and spelled[k][0] < m.end()):
                    shape = _shape(token, digits)
                    if shape != "mixed":
                        out.append(Candidate(*m.span(), token, digits, shape))
    return sorted(out, key=lambda c: c.start)


def _size(n: int) -> str:
    return str(n) if n <= 11 else "12-15" if n <= 15 else str(n) if n == 16 else "17-19" if n <= 19 else "more"


def _features(text: str, own: list[Candidate], i: int, joined: list[bool]) -> list[str]:
    """``joined[i]``: candidate i stands right after the one before."""
    c = own[i]
    found = ["bias", f"shape {c.shape}", f"shape {c.shape} {_size(len(c.digits))}", "joined" if joined[i] else "first", "goes on" if i + 1 < len(own) and joined[i + 1] else "last"]
    if 12 <= len(c.digits) <= 19 and c.shape in ("digits", "dashed"):
        found.append(f"check digit {luhn(c.digits)}")
    if c.shape == "plus" and 9 <= len(c.digits) <= 15:
        found.append("whole number")
    if c.shape == "spelled":
        found += ["brackets" if re.search(r"[\[(]", c.text) else "words only", f"known end {bool(_KNOWN_END.search(c.text))}", f"digit {bool(re.search('[0-9]', c.text))}"]
    if c.shape == "dashed":
        found.append("dashes " + "-".join(str(len(x)) for x in c.text.split("-")[:4]))
    # runs of short groups of digits with a check digit, which begin here or hold this one
    first = i
    while joined[first] and i - first < 6:
        first -= 1
    for a in range(first, i + 1):
        digits, b = "", a
        while b < len(own) and (b == a or joined[b]) and own[b].shape == "digits" and 3 <= len(own[b].digits) <= 6 and len(digits) < 20:
            digits += own[b].digits
            if b >= i and b > a and _is_card(digits) and (b + 1 == len(own) or not joined[b + 1] or own[b + 1].shape != "digits" or len(own[b + 1].digits) > 6):
                found.append("group run begins" if a == i else "in a group run")
            b += 1
    before, k = "", i
    total = len(c.digits)
    while joined[k] and k > 0 and i - k < 4:
        k -= 1
        total += len(own[k].digits)
        if own[k].shape == "plus":
            found.append(f"plus {i - k} before" + (" in length" if total <= 15 else ""))
            break
        if own[k].shape == "bracketed":
            found.append(f"brackets {i - k} before")
    if not joined[i]:
        m = _BEFORE.search(text, max(0, c.start - 24), c.start)
        before = m[1].lower() if m else ""
        found.append(f"cue {_CUE_OF.get(before, 'word' if before else 'other')}")
        found.append(f"cue {_CUE_OF.get(before, '')} {c.shape}")
    if i + 1 < len(own) and joined[i + 1]:
        found.append(f"then {own[i + 1].shape} {_size(len(own[i + 1].digits))}")
    return found


@dataclass
class Graph:
    """Of one or many documents: the candidates' features, and pairs by potential: 0 neighbours, 1 equal, 2 with the same last digits."""

    features: list[list[str]]
    pairs: np.ndarray
    kinds: np.ndarray


def graph(text: str, own: list[Candidate]) -> Graph:
    joined = [i > 0 and _BETWEEN.fullmatch(text, own[i - 1].end, c.start) is not None for i, c in enumerate(own)]
    pairs = [(i - 1, i, 0) for i in range(1, len(own)) if joined[i]]
    last: dict[tuple, int] = {}
    for i, c in enumerate(own):
        keys = [(1, c.text.lower())] * (len(c.text) >= 5) + [(2, c.digits[-7:])] * (len(c.digits) >= 7)
        linked = {last[k]: k[0] for k in reversed(keys) if k in last and last[k] < i}
        pairs += [(j, i, kind) for j, kind in linked.items()]
        last.update(dict.fromkeys(keys, i))
    table = np.array(pairs, np.int64).reshape(-1, 3)
    return Graph([_features(text, own, i, joined) for i in range(len(own))], table[:, :2], table[:, 2])


def together(graphs: list[Graph]) -> Graph:
    starts = np.cumsum([0] + [len(g.features) for g in graphs])
    pairs = [g.pairs + s for g, s in zip(graphs, starts)]
    return Graph([x for g in graphs for x in g.features], np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64), np.concatenate([g.kinds for g in graphs]) if graphs else np.empty(0, np.int64))


# message passing

#: Rounds of messages; edges are worked through in blocks of so many.
ROUNDS, EDGES = 12, 1 << 14


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows of ``values`` by their numbers ``at``, for ``n`` numbers."""
    k = values.shape[1]
    return np.bincount((at[:, None] * k + np.arange(k)).ravel(), values.ravel(), n * k).reshape(n, k)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis, keepdims=True)
    return np.log(np.exp(x - most).sum(axis)) + most.squeeze(axis)


def beliefs(unary: np.ndarray, pairs: np.ndarray, potentials: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log beliefs of the variables, messages' senders' scores without the receivers, directed pairs); ``potentials``: a square for each pair."""
    n, e, k = len(unary), len(pairs), unary.shape[1]
    directed = np.concatenate([pairs, pairs[:, ::-1]])
    back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
    messages = np.zeros((2 * e, k))

    def gathered() -> np.ndarray:
        return unary + _sums(directed[:, 1], messages, n)

    cavity = unary[directed[:, 0]] if e else np.zeros((0, k))
    for _ in range(rounds if e else 0):
        cavity = gathered()[directed[:, 0]] - messages[back]
        new = np.empty_like(messages)
        for at in range(0, 2 * e, EDGES):
            own = np.arange(at, min(at + EDGES, 2 * e))
            square = potentials[own % e]
            square = np.where((own < e)[:, None, None], square, square.transpose(0, 2, 1))
            new[own] = _log_sum(cavity[own][:, :, None] + square, 1)
        new -= new.max(1, keepdims=True)
        settled = np.abs(new - messages).max() < 1e-5
        messages = new
        if settled:
            break
    total = gathered()
    cavity = total[directed[:, 0]] - messages[back] if e else cavity
    return total - _log_sum(total, 1)[:, None] if n else total, cavity, directed


class Field:
    """Weights of features by label, and of label pairs by kind of pair."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, squares: np.ndarray):
        self.names, self.weights, self.squares = names, weights, squares

    def unary(self, features: list[list[str]]) -> np.ndarray:
        rows = [[self.names[x] for x in f if x in self.names] for f in features]
        at, flat = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([x for r in rows for x in r], np.int64)
        return _sums(at, self.weights[flat], len(rows))

    def marginals(self, g: Graph) -> np.ndarray:
        return np.exp(beliefs(self.unary(g.features), g.pairs, self.squares[g.kinds])[0])

    def labels(self, g: Graph) -> np.ndarray:
        """Each variable's likeliest label, out where no span is likelier than none."""
        found = self.marginals(g)
        return np.where(found[:, 0] >= 0.5, 0, 1 + found[:, 1:].argmax(1)) if len(found) else np.empty(0, np.int64)


def spans_of(own: list[Candidate], labels: list[int], joined: set[int]) -> list[Span]:
    """Spans from a first label on, over the following ones of its kind; ``joined``: candidates that stand right after the one before.

    A span with more or fewer digits than any number of its kind has is none.
    """
    out: list[list] = []
    for i, (c, label) in enumerate(zip(own, labels)):
        if not label:
            continue
        if label in (4, 6) and i in joined and out and out[-1][3] == i - 1 and out[-1][0] == _KIND_OF[label]:
            out[-1][2:] = [c.end, i, out[-1][4] + len(c.digits)]
        else:
            out.append([_KIND_OF[label], c.start, c.end, i, len(c.digits)])
    sound = {"card": range(12, 20), "phone": range(7, 16)}
    return [(kind, a, b) for kind, a, b, _, n in out if n in sound.get(kind, (n,))]


def find_spans(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    busy = [i for i, x in enumerate(texts) if _ANY.search(x)]
    found = {i: candidates(texts[i]) for i in busy}
    graphs = {i: graph(texts[i], own) for i, own in found.items()}
    labels = field.labels(together(list(graphs.values()))).tolist() if graphs else []
    out: list[tuple[list[Span], list[Span]]] = [([], []) for _ in texts]
    at = 0
    for i, own in found.items():
        g, mine = graphs[i], labels[at : at + len(own)]
        at += len(own)
        base = base_spans(texts[i])
        joined = set(g.pairs[g.kinds == 0, 1].tolist())
        taken = sorted((a, b) for _, a, b in base)
        added, k = [], 0
        for span in spans_of(own, mine, joined):
            while k < len(taken) and taken[k][1] <= span[1]:
                k += 1
            if not any(a < span[2] and span[1] < b for a, b in taken[k : k + len(KINDS)]):
                added.append(span)
        out[i] = (base, sorted(base + added, key=lambda x: (x[1], KINDS.index(x[0]))))
    return out


# fitting

_SYLLABLES = "the ing ti on er an re ed st lo mi ca sche ung eau ción é ü br ka".split()


def _digits(rng: random.Random, n: int) -> str:
    return str(rng.randint(1, 9)) + "".join(rng.choices("0123456789", k=n - 1))


def _checked(rng: random.Random, n: int) -> str:
    first = _digits(rng, n - 1)
    return next(first + x for x in "0123456789" if luhn(first + x))


def _word(rng: random.Random) -> str:
    return "".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4)))


def _grouped(digits: str, sign: str) -> str:
    return sign.join(digits[i : i + 4] for i in range(0, len(digits), 4))


def _entity(rng: random.Random) -> tuple[str, list[str]]:
    """(kind, forms from plain to weak): a weak form is personal data only where a plain one of the same value stands too."""
    kind = rng.choice(KINDS)
    if kind == "email":
        name, host, end = f"{_word(rng)}{rng.choice(['', '.', '_'])}{rng.randint(0, 99)}".encode("ascii", "ignore").decode(), rng.choice(["mail", "post", "web"]) + str(rng.randint(0, 9)), rng.choice(["com", "org", "de", "example.com"])
        last = end.rpartition(".")[2]
        return kind, [f"{name}@{host}.{end}", f"{name} [at] {host} [dot] {last}", f"{name} (at) {host}.{last}", f"{name} at {host} dot {last}", f"{name}@{host}"]
    if kind == "ip":
        return kind, [".".join(str(rng.randint(1, 255)) for _ in range(4))]
    if kind == "card":
        digits = _checked(rng, rng.choice([16, 16, 16, 15, 13]))
        return kind, [digits, _grouped(digits, " "), _grouped(digits, "-"), digits]
    area, a, b = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    code = rng.choice(["+1", "+49", "+33", "+34", "+44"])
    return kind, [f"{code} ({area}) {a}-{b}", f"{code} {area} {a} {b}", f"{code}-{area}-{a}-{b}", f"{code}{area}{a}{b}", f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{a}-{b}"]


def _harmless(rng: random.Random) -> str:
    return rng.choice([
        lambda: str(rng.randint(1900, 2030)), lambda: str(rng.randint(0, 99)), lambda: _digits(rng, rng.randint(3, 15)), lambda: f"{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}",
        lambda: f"{rng.randint(0, 99)}.{rng.randint(0, 99)}", lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"({rng.randint(1, 2030)})", lambda: f"+{rng.randint(1, 99)}",
        lambda: f"token = \"{rng.getrandbits(160):040x}\"", lambda: f"password={rng.getrandbits(72):018x}", lambda: f"{_digits(rng, 3)}-{_digits(rng, 4)}", lambda: f"978-{_digits(rng, 1)}-{_digits(rng, 3)}-{_digits(rng, 5)}-{_digits(rng, 1)}",
        lambda: ".".join(str(rng.randint(256, 999)) for _ in range(4)), lambda: f"{_word(rng)}{rng.randint(0, 99)}", lambda: next(x for x in iter(lambda: _digits(rng, 16), "") if not luhn(x)), lambda: f"@{_word(rng)}", lambda: f"{_word(rng)}@{_word(rng)}", lambda: f"{rng.choice('abxy')}@{rng.choice('abxy')}{rng.choice(['', '1'])}", lambda: f"{rng.randint(1, 20)}-{rng.randint(21, 99)}",
        lambda: " ".join(str(rng.randint(1, 999)) for _ in range(rng.randint(2, 5))), lambda: " ".join(str(rng.randint(0, 20)) for _ in range(rng.randint(3, 12))), lambda: f"{_digits(rng, 4)} {_digits(rng, 4)}", lambda: f"{rng.randint(2, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}.", lambda: f"{_word(rng)} at {_word(rng)} with a dot", lambda: f"{rng.choice(['look', 'arrive', 'mill'])} at {rng.choice(['that', 'home', 'noon'])} dot {rng.choice(['there', 'this', 'lost'])}",
    ])()


def made_document(rng: random.Random) -> tuple[str, list[Span]]:
    """A text of invented words with mentions, and their spans."""
    text, spans = "", []
    for _ in range(rng.randint(1, 3)):
        entity = _entity(rng) if rng.random() < 0.6 else None
        pending: list[tuple[str, str]] = []
        if entity:
            kind, forms = entity
            strong = [f for f in forms if not (kind == "phone" and f.count("-") == 1 and f[0] not in "+(") and not (kind == "email" and f.count("@") and "." not in f)]
            weak = [f for f in forms if f not in strong]
            pending = [(kind, rng.choice(strong))] + [(kind, rng.choice(rng.choice([forms, weak or forms]))) for _ in range(rng.choice([0, 0, 1, 2]))]
        pending += [("", _harmless(rng)) for _ in range(rng.randint(0, 2))]
        rng.shuffle(pending)
        tight = rng.random() < 0.35  # mentions that follow each other without a word between
        for kind, value in pending:
            if not (tight and text):
                text += "".join(f"{_word(rng)}{rng.choice([' ', ' ', ' ', ', ', '. '])}" for _ in range(rng.randint(1, 4)))
                cue = kind or "none"
                if rng.random() < 0.3:
                    text += rng.choice(CUES[cue].split()) + rng.choice([" ", ": ", " is "])
            start = len(text)
            text += value
            if kind:
                spans.append((kind, start, len(text)))
            text += " " if tight else rng.choice([" ", ". ", ", ", "### ", "\n"])
        text += _word(rng) + " "
    return text, spans


def labels_of(own: list[Candidate], spans: list[Span]) -> np.ndarray:
    """The first candidate in a span has its kind's first label, the others the next."""
    out, begun = np.zeros(len(own), np.int64), set()
    for i, c in enumerate(own):
        for span in spans:
            if span[1] < c.end and c.start < span[2]:
                first = LABELS.index(span[0])
                out[i] = first + (span in begun and span[0] in ("card", "phone"))
                begun.add(span)
    return out


@lru_cache(maxsize=2)
def fit_field(seed: int = 12, documents: int = 700, steps: int = 80, rate: float = 0.25, decay: float = 2e-4) -> Field:
    """The field, by adaptive gradient steps on made documents; the same for the same parameters."""
    rng = random.Random(seed)
    graphs, truth = [], []
    for _ in range(documents):
        text, spans = made_document(rng)
        own = candidates(text)
        graphs.append(graph(text, own))
        truth.append(labels_of(own, spans))
    g, y = together(graphs), np.concatenate(truth)
    names = {x: i for i, x in enumerate(sorted({x for f in g.features for x in f}))}
    k = len(LABELS)
    field = Field(names, np.zeros((len(names), k)), np.zeros((3, k, k)))
    at = np.repeat(np.arange(len(y)), [len(f) for f in g.features])
    flat = np.array([names[x] for f in g.features for x in f], np.int64)
    due = _sums(flat, np.eye(k)[y[at]], len(names))
    due_pairs = _sums(g.kinds, np.eye(k * k)[y[g.pairs[:, 0]] * k + y[g.pairs[:, 1]]], 3).reshape(3, k, k)
    even = lambda x: np.concatenate([x[:1], (x[1:] + x[1:].transpose(0, 2, 1)) / 2])  # noqa: E731  skips have no direction
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (field.weights, field.squares)]
    e = len(g.pairs)
    for step in range(1, steps + 1):
        squares = field.squares[g.kinds]
        log, cavity, _ = beliefs(_sums(at, field.weights[flat], len(y)), g.pairs, squares, 6)
        had = _sums(flat, np.exp(log)[at], len(names))
        joint = cavity[:e, :, None] + squares + cavity[e:, None, :]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        had_pairs = _sums(g.kinds, (joint / joint.sum((1, 2), keepdims=True)).reshape(e, k * k), 3).reshape(3, k, k)
        for value, slope, (mean, spread) in zip((field.weights, field.squares), ((due - had) / len(y) - decay * field.weights, even(due_pairs - had_pairs) / len(y) - decay * field.squares), moments):
            mean += 0.1 * (slope - mean)
            spread += 0.01 * (slope**2 - spread)
            value += rate * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-6) * min(1, 2 * (1 - step / (steps + 1)))
    return field


# documents

_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span's kind in square brackets in its place; overlapping spans go as one."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def personal_data(docs: DataFrame, field: Field | None = None, id_column: str = "doc_id", text_column: str = "text", with_masked: bool = False) -> DataFrame:
    """(id, base, spans, and on demand the masked text) of every row; spans are (kind, start, end) in code points, the end exclusive."""
    field = field or fit_field()
    columns = [T.StructField(id_column, docs.schema[id_column].dataType), T.StructField("base", _SPANS), T.StructField("spans", _SPANS)]
    if {id_column} & {"base", "spans", "masked"}:
        raise ValueError("the id may not have the name of a result")
    columns += [T.StructField("masked", T.StringType())] * with_masked
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    names = [c.name for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            found = find_spans(texts, field)
            arrays = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in spans] for spans in side], kind) for side in zip(*found)]
            more = [pa.array([masked(t, s) for t, (_, s) in zip(texts, found)], pa.string())] * with_masked
            yield pa.RecordBatch.from_arrays([part.column("id"), *arrays, *more], names=names)

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(task(run), T.StructType(columns))


def written_spans(spans: str):
    """kind:start:end of a column of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
