"""Personal data by rules and a semi-Markov conditional random field (operator 9).

The base rules are exact patterns. Around everything that could be a number or
an address, a semi-Markov CRF (Sarawagi and Cohen, 2004) scores whole candidate
spans - their shape, digit counts, check digit, surroundings - and dynamic
programming over segments of bounded length chooses boundaries and types
together. Its spans are added where no base span lies.

The model is learned from a bounded sample of the documents, labelled by the
base rules, and from rewritten copies of those spans (no plus sign, spelled-out
at and dot, dotted and spaced numbers) and plain numbers as counter-examples.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

#: Regions that the model is learned from, and rounds over them.
SAMPLE_REGIONS, ROUNDS = 600, 4
#: Tokens and characters of an entity, at most.
MAX_TOKENS, MAX_CHARS = 24, 80
#: How much better than leaving it out an added span must be (log odds).
MARGIN = 0.5

_CLUSTER = re.compile(r"[+0-9][0-9 ().\-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SPELLED = re.compile(r"[\[({] ?at ?[\])}]", re.IGNORECASE)
_PART, _DOT = "[A-Za-z0-9-]{1,63}", r"(?: ?[\[({] ?dot ?[\])}] ?| dot |\.)"
#: From the at to the end of an address that is spelled out: at in brackets, or bare before a bare dot.
_ADDRESS = re.compile(rf"[\[({{] ?at ?[\])}}] ?{_PART}(?:{_DOT}{_PART}){{1,10}}| at {_PART}(?: dot {_PART}){{1,10}}", re.IGNORECASE)
#: What carries an address on.
_MORE = re.compile(f"{_DOT}[A-Za-z0-9-]", re.IGNORECASE)
#: Groups of digits parted by slashes too.
_SLASHED = re.compile(r"[+0-9][0-9 ().\-]*+/[0-9 ().\-/]*+")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[Span]:
    """The base rules' spans, by kind in the order of KINDS, then by start."""
    ips: list[Span] = []
    cards: list[Span] = []
    phones: list[Span] = []
    for c in _CLUSTER.finditer(text):
        lo, hi = c.span()
        if hi - lo < 7:
            continue
        for m in _IP.finditer(text, lo, hi):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                ips.append(("ip", *m.span()))
        for m in _CARD.finditer(text, lo, hi):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    cards.append(("card", *m.span()))
        if text[lo] == "+" and (m := _PHONE.match(text, lo, hi)) and 8 <= len(_DIGITS.findall(m.group())) <= 15:
            phones.append(("phone", *m.span()))
    return _emails(text) + ips + cards + phones


def regions(text: str) -> list[tuple[int, int]]:
    """Parts of text in which the model looks: clusters of seven digits or more and addresses with all their spelled-out parts, to the next blanks."""
    marks = [c.span() for c in _CLUSTER.finditer(text) if c.end() - c.start() >= 7 and len(_DIGITS.findall(c.group())) >= 7]
    marks += [(i, i + 1) for i in _places(text, "@")] + [m.span() for m in _SPELLED.finditer(text)] + [m.span() for m in _ADDRESS.finditer(text)]
    marks += [m.span() for m in _SLASHED.finditer(text) if len(_DIGITS.findall(m.group())) >= 7]
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(marks):
        lo, hi = _blank_before(text, lo), _blank_after(text, hi)
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


def _places(text: str, what: str) -> Iterator[int]:
    i = text.find(what)
    while i >= 0:
        yield i
        i = text.find(what, i + 1)


def _blank_before(text: str, at: int) -> int:
    """Start of the word before the one at at, within MAX_CHARS."""
    floor = max(0, at - MAX_CHARS)
    i = max(text.rfind(" ", floor, at), text.rfind("\n", floor, at), floor - 1)
    i = max(text.rfind(" ", floor, max(floor, i)), text.rfind("\n", floor, max(floor, i)), floor - 1)
    return i + 1


def _blank_after(text: str, at: int) -> int:
    top = min(len(text), at + MAX_CHARS)
    for _ in range(2):
        found = [i for i in (text.find(" ", at, top), text.find("\n", at, top)) if i >= 0]
        if not found:
            return top
        at = min(found) + 1
    return at - 1


def _shape(text: str) -> str:
    s = re.sub(r"[A-Za-z]+", "a", text)
    return re.sub(r"\s+", " ", re.sub(r"[0-9]+", "9", s))


def _span_features(text: str, s: int, e: int) -> list[str]:
    """What is said of text[s:e] as one entity, whatever its type."""
    body = text[s:e]
    digits = _DIGITS.findall(body)
    n = len(digits)
    out = [
        f"shape={_shape(body)[:40]}",
        f"digits={n if n < 20 else 20}",
        f"groups={'-'.join(str(len(g)) for g in re.findall('[0-9]+', body))[:24]}",
        f"at={'@' in body or bool(_SPELLED.search(body) or _ADDRESS.search(body))}",
        f"first={_kind(body[0])}",
        f"last={_kind(body[-1])}",
        f"before={_kind(text[s - 1]) if s else 'edge'}",
        f"after={_kind(text[e]) if e < len(text) else 'edge'}",
    ]
    if n < 7 and _MORE.match(text, e):
        out.append("more")
    if 16 <= n <= 19:
        out.append(f"luhn={luhn(''.join(digits))}")
    parts = body.split(".")
    if len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts):
        out.append(f"octets={all(len(p) < 4 and int(p) < 256 for p in parts)}")
    return out


def _kind(c: str) -> str:
    return "digit" if "0" <= c <= "9" else "letter" if c.isalpha() else "blank" if c.isspace() else c


def _segments(text: str) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Number of tokens, and candidate entities (first token, token after, start, end)."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    out = []
    for i, (s, _) in enumerate(tokens):
        if not (text[s].isalnum() or text[s] in "+("):
            continue
        digits = at = 0
        for j in range(i, min(len(tokens), i + MAX_TOKENS)):
            a, e = tokens[j]
            if e - s > MAX_CHARS:
                break
            if "0" <= text[a] <= "9":
                digits += e - a
            at += text[a] == "@" or text[a : a + 2].lower() == "at"
            if text[e - 1].isalnum() and text[e - 1].isascii() and (digits >= 4 or at):
                out.append((i, j + 1, s, e))
    return len(tokens), out


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)

    def scores(self, text: str, s: int, e: int) -> list[float]:
        """Of text[s:e] as each of KINDS, against its tokens being outside."""
        got, w = _span_features(text, s, e), self.weights
        return [w.get(kind, 0.0) + sum(w.get(f"{kind}|{f}", 0.0) for f in got) for kind in KINDS]

    def decode(self, text: str) -> list[Span]:
        """The best segmentation: entities of bounded length, the other tokens outside."""
        n, found = _segments(text)
        ends: dict[int, list[tuple[int, int, int]]] = {}
        for i, j, s, e in found:
            ends.setdefault(j, []).append((i, s, e))
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i, s, e in ends.get(j, ()):
                scores = self.scores(text, s, e)
                k = max(range(len(KINDS)), key=scores.__getitem__)
                if scores[k] > MARGIN and best[i] + scores[k] > best[j]:
                    best[j], back[j] = best[i] + scores[k], (i, (KINDS[k], s, e))
        out, j = [], n
        while j:
            if back[j]:
                j, span = back[j]
                out.append(span)
            else:
                j -= 1
        return out[::-1]

    def spans(self, text: str, base: list[Span] | None = None) -> list[Span]:
        """Base spans and the model's spans that overlap none of them, by kind and start."""
        base = base_spans(text) if base is None else base
        added = []
        for lo, hi in regions(text):
            part = text[lo:hi]
            near = [(s, e) for _, s, e in base if s < hi and e > lo]
            for kind, s, e in self.decode(part):
                if not any(s + lo < b and e + lo > a for a, b in near):
                    added.append((kind, s + lo, e + lo))
        return sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def _rewritten(text: str, spans: list[Span], rng: random.Random) -> tuple[str, list[Span]]:
    """The region with its entities in other notations."""
    out, moved, at = "", [], 0
    for kind, s, e in sorted(spans, key=lambda x: x[1]):
        if s < at:
            return text, spans
        body = text[s:e]
        if kind == "email":
            dot = rng.choice([".", " [dot] ", " (dot) "])
            local, _, domain = body.partition("@")
            at_sign = rng.choice([" [at] ", "[at]", " (at) ", "(at)", " at "])
            body = local + at_sign + domain.replace(".", " dot " if at_sign == " at " else dot)
        elif kind == "phone":
            groups = re.findall(r"[0-9]+", body)
            body = rng.choice(["00" + " ".join(groups), "({}) {}".format(groups[-3], "-".join(groups[-2:])) if len(groups) > 2 else " ".join(groups), "-".join(groups), ".".join(groups), "/".join(groups)])
        elif kind == "card":
            digits = "".join(_DIGITS.findall(body))
            body = rng.choice([".", " ", "-"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
        out += text[at:s]
        moved.append((kind, len(out), len(out) + len(body)))
        out, at = out + body, e
    return out + text[at:], moved


def _plain_number(rng: random.Random) -> str:
    """What isn't personal data: dates, versions, amounts, serial numbers."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    return rng.choice([f"20{d(2)}-0{rng.randrange(1, 10)}-1{d(1)}", f"1{d(1)}.0{rng.randrange(1, 10)}.20{d(2)}", f"1{d(1)}/0{rng.randrange(1, 10)}/20{d(2)}", f"{d(7)}", f"{d(9)}", f"{d(3)},{d(3)},{d(3)}", f"{d(1)}.{d(2)}.{d(4)}", f"{d(6)}.{d(2)}", f"{d(12)}", f"20{d(2)}-20{d(2)}", f"97{rng.choice('89')}-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"4{d(15)}", f"{d(20)}", f"{d(3)}.9{d(2)}.{d(3)}.{d(3)}"])


def learn(samples: list[str], rounds: int = ROUNDS, seed: int = 9) -> Model:
    """A model from regions of text, by stochastic gradient on the conditional likelihood of their labelled segmentation."""
    rng = random.Random(seed)
    data: list[tuple[str, list[Span]]] = []
    for text in samples:
        spans = base_spans(text)
        data.append((text, spans))
        if spans:
            data.append(_rewritten(text, spans, rng))
            kind, s, e = spans[0]
            data.append((number := text[:s] + _plain_number(rng) + text[e:], base_spans(number)))
    names: dict[str, int] = {}
    lattices = []
    for text, spans in data:
        n, found = _segments(text)
        gold = {(s, e): KINDS.index(kind) for kind, s, e in spans}
        rows, right = [], []
        for i, j, s, e in found:
            got = ["", *("|" + f for f in _span_features(text, s, e))]
            for k, kind in enumerate(KINDS):
                rows.append((i, j, np.array([names.setdefault(kind + f, len(names)) for f in got])))
                right.append(gold.get((s, e)) == k)
        if rows:
            lattices.append((n, rows, np.array(right, float)))
    w, squared = np.zeros(len(names)), np.full(len(names), 1e-6)
    for _ in range(rounds):
        rng.shuffle(lattices)
        for n, rows, right in lattices:
            score = np.array([w[ids].sum() for _, _, ids in rows])
            gradient = right - _marginals(n, rows, score)
            for g, (_, _, ids) in zip(gradient.tolist(), rows, strict=True):
                if abs(g) > 1e-4:
                    step = g - 1e-3 * w[ids]
                    squared[ids] += step * step
                    w[ids] += 0.3 * step / np.sqrt(squared[ids])
    return Model({name: round(float(w[i]), 6) for name, i in names.items() if abs(w[i]) > 1e-6})


def _marginals(n: int, rows: list[tuple[int, int, np.ndarray]], score: np.ndarray) -> np.ndarray:
    """Probability of each candidate (segment and type) by forward and backward sums."""
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for r, (i, j, _) in enumerate(rows):
        by_end.setdefault(j, []).append(r)
        by_start.setdefault(i, []).append(r)
    score = np.minimum(score, 40)
    forward, backward = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        terms = [forward[j - 1], *(forward[rows[r][0]] + score[r] for r in by_end.get(j, ()))]
        top = max(terms)
        forward[j] = top + np.log(sum(exp(t - top) for t in terms))
    for i in range(n - 1, -1, -1):
        terms = [backward[i + 1], *(backward[rows[r][1]] + score[r] for r in by_start.get(i, ()))]
        top = max(terms)
        backward[i] = top + np.log(sum(exp(t - top) for t in terms))
    return np.array([exp(min(0.0, forward[i] + score[r] + backward[j] - forward[n])) for r, (i, j, _) in enumerate(rows)])


def sample_regions(docs: DataFrame, size: int = SAMPLE_REGIONS) -> list[str]:
    """size regions at most of the documents' texts, the first by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [text[lo:hi] for text in batch.column(0).to_pylist() if text for lo, hi in regions(text)]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.string())], names=["region"])

    # documents enough for the sample in any likely corpus; fewer regions only make a smaller sample
    share = min(1.0, 40 * size / max(1, docs.count()))
    chosen = docs.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000)).select("text")
    found = chosen.mapInArrow(run, "region string").distinct()
    return [r[0] for r in found.orderBy(F.xxhash64("region"), "region").limit(size).collect()]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 (of the base spans), spans (all of them).

    Null and empty texts have no span; repeated rows stay rows; other columns
    aren't looked at. Places count code points, the end excluded.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, every = [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                every.append(joined(shared.value.spans(text, base) if text else []))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(every, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
