"""Personal data by patterns and a semi-Markov conditional random field.

Patterns give the base spans. The model adds further ones: a text's surroundings of digits and
at-signs are cut into tokens (a spelled-out separator is one), each run of at most `MAX_TOKENS`
tokens and each whole address of any length is a candidate segment of some kind, whole-span
features (shape, counts, marks, the words before) score it, and a dynamic program over segment
ends picks the best labelling of a window of any length: boundaries and kinds together. The weights
maximise the penalised conditional likelihood of the labels that patterns give on a sample: at
most `sample` distinct texts and of these at most `TRAINED_WINDOWS` distinct windows of at most
`TRAINED_LENGTH` code points, chosen by hashes (documented bounds of the fit; whatever is scanned
is scanned whole, and windows of any length are decoded whole). So that it learns more than the patterns, part of the training labels is rewritten to
forms that the patterns miss (other separators, no plus sign, spelled-out at-signs).

Added spans never overlap base spans or each other. Kinds of the base: email, ip, card, phone;
`secret` (long keys, in one or in several groups) is the model's own.

Bounds of what the model may call an entity: `MAX_TOKENS` tokens and `LONGEST` code points,
other than whole addresses and keys, which may have any length.

Edge cases: null counts as an empty text without spans; a very long text is scanned whole, in
time in proportion to its length (runs of digits included); repeated rows are scanned one by one; an empty table trains on the
built-in examples only and gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavegrid.llm.common import columns_of, cut, documents, free_name, in_small_batches, once

KINDS = ("email", "ip", "card", "phone", "secret")
OTHER = len(KINDS)
MAX_TOKENS = 16
LONGEST = 120
MARGIN = 48
#: Bounds of the fit.
SAMPLE, TRAINED_WINDOWS, TRAINED_LENGTH = 400, 4_000, 2_000

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A leftmost match begins at the first digit of a run, and runs are taken whole: linear time.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Digits, at-signs and spelled-out separators; the bare words only between words that may be of an address.
TRIGGER = re.compile(r"[0-9@]|[(\[](?i:at|dot)[)\]]| (?:(?i:at) (?=[\w-]+(?:\.| ?\((?i:dot)\) ?| ?\[(?i:dot)\] ?| (?i:dot) )[\w-])|(?i:dot) (?=[\w-]))", re.ASCII)
#: A whole address, from the start of its run of letters on; its last mark may not be part of it.
DOT = r"(?: ?\((?i:dot)\) ?| ?\[(?i:dot)\] ?)"
LOCAL = rf"[\w.%+-]++(?:{DOT}[\w.%+-]++)*+"
FORM = rf"{LOCAL}(?:@| ?\((?i:at|@)\) ?| ?\[(?i:at|@)\] ?| (?i:at) )[\w-]+(?:(?:\.|{DOT}| (?i:dot) )[\w-]+)+"
ADDRESS = re.compile(rf"(?<![\w.%+-])(?<![(\[](?i:dot)[)\]])(?<![(\[](?i:dot)[)\]] ){FORM}", re.ASCII)
SPELLED = re.compile(r"@|[(\[](?:at|dot)[)\]]| (?:at|dot) ", re.IGNORECASE)
TOKEN = re.compile(r" ?(?:\((?i:at|dot|@)\)|\[(?i:at|dot|@)\]) ?| (?i:at|dot) (?=[\w-])|[A-Za-z0-9]+|\n|[^\S\n]+|[^\w\s]|\w", re.ASCII)
#: Keys of several groups, and a group that mixes letters and digits.
DASHED = re.compile(r"(?<![\w-])[A-Za-z0-9]++(?:[-_][A-Za-z0-9]++)++(?![\w-])", re.ASCII)
MIXED_GROUP = re.compile(r"(?=[0-9]*[A-Za-z])(?=[A-Za-z]*[0-9])[A-Za-z0-9]{6,}", re.ASCII)
#: What a window's edges are moved over, so that they are in no address or key.
RUN = re.compile(r"[\w.%+-]+", re.ASCII)
RUN_CHARS = LOCAL_CHARS


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, from one at-sign to the next in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns, by kind and start."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    first = DIGIT.search(text)
    if first:
        begin = first.start()
        for m in IP.finditer(text, begin):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
                out.append((1, *m.span()))
        for m in CARD.finditer(text, begin):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                    out.append((3, *m.span()))
    return out


def windows(text: str) -> list[tuple[int, int]]:
    """Parts of the text around digits, at-signs and spelled-out separators, merged where they meet, within lines.

    Each reaches to MARGIN characters before its first and after its last trigger at least, and on
    to the ends of the runs of characters that addresses and keys are made of, however long.
    """
    out: list[tuple[int, int]] = []
    if not SPELLED.search(text) and not DIGIT.search(text):
        return out
    for m in TRIGGER.finditer(text):
        last = out[-1][1] if out else 0
        e = min(len(text), m.end() + MARGIN)
        nl = text.find("\n", m.end(), e)
        e = e if nl < 0 else nl
        if e > last and (run := RUN.match(text, e)) and text[e - 1] in RUN_CHARS:
            e = run.end()
        e = max(e, last)
        if out and m.end() <= last:
            out[-1] = (out[-1][0], e)
            continue
        s = max(last, m.start() - MARGIN)
        s = max(s, text.rfind("\n", s, m.start()) + 1)
        while s > last and text[s - 1] in RUN_CHARS and text[s] in RUN_CHARS:
            s -= 1
        if out and s <= last:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def is_dashed_key(span: str) -> bool:
    """Whether a run of groups may be a key: long enough, of letters and digits, one group of both."""
    return len(span) >= 16 and sum(map(str.isdigit, span)) >= 4 and sum(map(str.isalpha, span)) >= 4 and MIXED_GROUP.search(span) is not None


def features(text: str, tokens: list[tuple[int, int]], i: int, j: int, kind: int) -> list[str]:
    """Whole-span features of the segment of tokens i..j-1."""
    start, end = tokens[i][0], tokens[j - 1][1]
    if kind == OTHER:
        t = text[start:end]
        shape = "n" + str(min(len(t), 6)) if t.isdigit() else "a" if t.isalpha() else " " if t.isspace() else t.strip()[:1]
        return [f"o:{shape}"]
    span = text[start:end]
    digits = sum(map(str.isdigit, span))
    letters = sum(map(str.isalpha, span))
    k = KINDS[kind]
    out = [f"{k}:", f"{k}:digits{min(digits, 20)}", f"{k}:letters{min(letters.bit_length(), 4)}", f"{k}:tokens{min(j - i, MAX_TOKENS + 1)}"]
    out += [f"{k}:has{c}" for c in "@.+()-:/ " if c in span]
    out += [f"{k}:dots{min(span.count('.'), 4)}", f"{k}:at{min(span.count('@'), 2)}"]
    edge = lambda c: "d" if c.isdigit() else "a" if c.isalpha() else c
    out += [f"{k}:first{edge(span[0])}", f"{k}:last{edge(span[-1])}"]
    before, after = text[start - 1 : start], text[end : end + 1]
    out += [f"{k}:before{edge(before) if before else '^'}", f"{k}:after{edge(after) if after else '$'}"]
    if digits and not letters:
        groups = re.findall(r"[0-9]+", span)
        out.append(f"{k}:groups" + "-".join(str(len(g)) for g in groups[:5]))
        out.append(f"{k}:ngroups{min(len(groups), 6)}")
        if 13 <= digits <= 19:
            out.append(f"{k}:luhn{luhn(''.join(groups))}")
        if len(groups) == 4:
            out.append(f"{k}:octets{all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    if letters and digits and re.fullmatch(r"[0-9a-f]+", span):
        out.append(f"{k}:hex{min(len(span) // 8, 5)}")
    if kind == 4 and ("-" in span or "_" in span):
        out.append(f"{k}:dashed{min(max(map(len, re.split('[-_]', span))) // 8, 3)}")
    if re.search(r"(?i:\bat\b|\(at\)|\[at\]|[(\[]@[)\]])", span):
        out.append(f"{k}:spelled{bool(re.search(r'(?i:dot|[.])', span))}")
    if letters and re.fullmatch(FORM, span, re.ASCII):
        out.append(f"{k}:address")
    return out


@lru_cache(1 << 14)
def shaped(span: str) -> tuple[int, bool]:
    """Bits of the kinds that a span of at most LONGEST code points may have by its shape, and whether a longer one from its start may have any."""
    digits = sum(map(span.count, "0123456789"))
    letters = sum(map(str.isalpha, span))
    more = digits <= 19 or letters > 0
    if span[0].isspace() or span[-1].isspace() or "\n" in span:
        return 0, more and "\n" not in span
    out = 0
    if letters and (span[0].isalnum() and span[-1].isalnum()) and ("@" in span or "at" in span.lower()):
        out |= 1
    if not letters and digits >= 4 and span.count(".") == 3 and span[0].isdigit():
        out |= 2
    if not letters and 13 <= digits <= 19 and span[0].isdigit() and span[-1].isdigit():
        out |= 4
    if not letters and 7 <= digits <= 15 and span[0] in "+(0123456789" and span[-1].isdigit():
        out |= 8
    if digits >= 4 and letters >= 4 and len(span) >= 16 and span.isalnum():
        out |= 16
    return out, more


def candidate(text: str, start: int, end: int) -> tuple[int, bool]:
    """shaped() for spans of any length: only keys may be longer than LONGEST."""
    if end - start <= LONGEST:
        return shaped(text[start:end])
    run = text[start:end]
    return (16 if run.isalnum() and sum(map(run.count, "0123456789")) >= 4 and sum(map(str.isalpha, run)) >= 4 else 0), False


def tokens_of(text: str, start: int, end: int) -> tuple[list[tuple[int, int]], dict[int, set[tuple[int, int]]]]:
    """The tokens of a window, and token -> (end, kind) of the whole addresses and keys of several groups that begin there."""
    tokens = [m.span() for m in TOKEN.finditer(text, start, end)]
    whole: dict[int, set[tuple[int, int]]] = {}
    if found := [m.span() for m in ADDRESS.finditer(text, start, end)]:
        at_start, at_end = {s: i for i, (s, _) in enumerate(tokens)}, {e: i + 1 for i, (_, e) in enumerate(tokens)}
        for s, e in found:
            while s < e and not text[s].isalnum():
                s += 1
            while e > s and not text[e - 1].isalnum():
                e -= 1
            if s in at_start and e in at_end:
                whole.setdefault(at_start[s], set()).add((at_end[e], 0))
    if keys := [m.span() for m in DASHED.finditer(text, start, end) if is_dashed_key(m.group())]:
        at_start, at_end = {s: i for i, (s, _) in enumerate(tokens)}, {e: i + 1 for i, (_, e) in enumerate(tokens)}
        for s, e in keys:
            if s in at_start and e in at_end:
                whole.setdefault(at_start[s], set()).add((at_end[e], 4))
    return tokens, whole


def segments(text: str, tokens: list[tuple[int, int]], i: int, more: set[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(end, kind) of the segments that begin at a token; more: those that are candidates whatever their length."""
    yield i + 1, OTHER
    s = tokens[i][0]
    if text[s].isspace():
        return
    last = min(len(tokens), i + MAX_TOKENS)
    for j in range(i + 1, last + 1):
        kinds, longer = candidate(text, s, tokens[j - 1][1])
        if kinds or more:
            for k in range(OTHER):
                if kinds >> k & 1 or (j, k) in more:
                    yield j, k
        if not longer:
            last = j
            break
    for j, k in sorted(more):
        if j > last:
            yield j, k


class Scores(dict):
    """Score of each kind and span with the marks beside it, kept for those seen before."""

    def __init__(self, number, weights: np.ndarray):
        self.number, self.weights = number, list(map(float, weights))

    def of(self, text: str, tokens: list[tuple[int, int]], i: int, j: int, kind: int) -> float:
        a, b = tokens[i][0], tokens[j - 1][1]
        key = (kind, text[a:b]) if kind == OTHER else (kind, text[a:b], text[a - 1 : a] if a else "", text[b : b + 1])
        if (value := self.get(key)) is None:
            if len(self) >= 50_000:
                self.clear()
            value = sum(self.weights[f] for f in self.number(features(text, tokens, i, j, kind)))
            if b - a <= LONGEST:
                self[key] = value
        return value


def best_entities(text: str, start: int, end: int, scores: Scores) -> list[tuple[int, int, int]]:
    """What Lattice.best gives, with the scores and ways back of the tokens kept only."""
    tokens, whole = tokens_of(text, start, end)
    top: list[tuple[float, int, int] | None] = [(0.0, 0, OTHER)] + [None] * len(tokens)
    for i in range(len(tokens)):
        for j, k in segments(text, tokens, i, whole.get(i, set())):
            new = (top[i][0] + scores.of(text, tokens, i, j, k), -i, k)
            if top[j] is None or new > top[j]:
                top[j] = new
    out, j = [], len(tokens)
    while j > 0:
        _, i, k = top[j]
        if k != OTHER:
            out.append((k, tokens[-i][0], tokens[j - 1][1]))
        j = -i
    return out[::-1]


class Lattice:
    """The segments of one window with the ids of their features."""

    def __init__(self, text: str, start: int, end: int, number, gold=()):
        self.tokens, more = tokens_of(text, start, end)
        n = len(self.tokens)
        at_start = {s: i for i, (s, _) in enumerate(self.tokens)}
        at_end = {e: i + 1 for i, (_, e) in enumerate(self.tokens)}
        self.gold = {}
        for k, s, e in gold:
            if s in at_start and e in at_end:
                self.gold[at_start[s]] = (at_end[e], k)
                more.setdefault(at_start[s], set()).add((at_end[e], k))
        self.by_end: list[list[tuple[int, int, list[int]]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            for j, k in segments(text, self.tokens, i, more.get(i, set())):
                self.by_end[j].append((i, k, number(features(text, self.tokens, i, j, k))))

    def best(self, weights: np.ndarray) -> list[tuple[int, int, int]]:
        """The best labelling's entities (kind, start, end)."""
        score, back = [0.0], [None]
        for j in range(1, len(self.by_end)):
            top = max(((score[i] + sum(weights[f] for f in fs), -i, k) for i, k, fs in self.by_end[j]))
            score.append(top[0])
            back.append((-top[1], top[2]))
        out, j = [], len(self.by_end) - 1
        while j > 0:
            i, k = back[j]
            if k != OTHER:
                out.append((k, self.tokens[i][0], self.tokens[j - 1][1]))
            j = i
        return out[::-1]

    def gradient(self, weights: np.ndarray) -> tuple[float, dict[int, float]]:
        """Log-likelihood of the gold labelling and its gradient, by forward and backward sums."""
        n = len(self.by_end) - 1
        s = [[(i, k, fs, float(sum(weights[f] for f in fs))) for i, k, fs in arcs] for arcs in self.by_end]
        forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        forward[0] = backward[n] = 0
        for j in range(1, n + 1):
            forward[j] = np.logaddexp.reduce([forward[i] + x for i, _, _, x in s[j]])
        for j in range(n, 0, -1):
            for i, _, _, x in s[j]:
                backward[i] = np.logaddexp(backward[i], backward[j] + x)
        out: dict[int, float] = {}
        gold, inside = 0.0, 0
        right = {}
        at = 0
        while at < n:
            end, k = self.gold.get(at, (at + 1, OTHER))
            right[at, end, k] = True
            at = end
        for j in range(1, n + 1):
            for i, k, fs, x in s[j]:
                p = math.exp(forward[i] + x + backward[j] - forward[n])
                if (i, j, k) in right:
                    gold += x
                    inside += 1
                    p -= 1
                if abs(p) > 1e-9:
                    for f in fs:
                        out[f] = out.get(f, 0.0) - p
        return gold - forward[n], out


def labels_of(text: str) -> list[tuple[int, int, int]]:
    """Training labels: what the patterns find, without overlaps, and long hexadecimal keys."""
    spans = base_spans(text) + [(4, *m.span()) for m in HEX.finditer(text) if DIGIT.search(m.group()) and re.search("[a-f]", m.group())]
    out: list[tuple[int, int, int]] = []
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
        if not out or s >= out[-1][2]:
            out.append((k, s, e))
    return out


def rewritten(text: str, spans: list[tuple[int, int, int]], rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with entities in other forms, and where they stand then."""
    out, new, at = [], [], 0
    length = 0
    for k, s, e in spans:
        span = text[s:e]
        if k == 0:
            span = span.replace("@", rng.choice(["@", " (at) ", "(at)", " [at] ", "[at]", " at ", " (@) ", " AT "]))
            if "(" in span or "[" in span:
                span = span.replace(".", rng.choice([".", " (dot) " if "(" in span else " [dot] "]))
            elif len(parts := re.split(" at ", span, flags=re.IGNORECASE)) == 2:
                dot = " dot " if " at " in span else " DOT "
                span = f"{parts[0]}{dot.replace('dot', 'at').replace('DOT', 'AT')}{parts[1].replace('.', dot)}"
            if rng.random() < 0.1:
                span = span.upper()
        elif k == 3:
            digits = re.sub(r"[^0-9]", "", span)[-10:]
            if len(digits) == 10:
                a, b, c = digits[:3], digits[3:6], digits[6:]
                span = rng.choice([span, f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}"])
        elif k == 4:
            span = rng.choice([span, span, f"{rng.choice(['sk', 'key', 'pk-live', 'tok_v2'])}-{span}", "-".join(span[i : i + 8] for i in range(0, len(span), 8))])
        out += [text[at:s], span]
        length += s - at
        new.append((k, length, length + len(span)))
        length += len(span)
        at = e
    return "".join(out) + text[at:], new


#: Built-in training examples: (text, kind, entity); no entity: all of it is other text.
EXAMPLES = [
    ("write to jane.doe@mail.example.org today", 0, "jane.doe@mail.example.org"),
    ("write to jane.doe (at) example (dot) org today", 0, "jane.doe (at) example (dot) org"),
    ("Ask smith(at)example.com. Or wait", 0, "smith(at)example.com"), ("reach a.lee [at] mail [dot] example [dot] net, or", 0, "a.lee [at] mail [dot] example [dot] net"),
    ("our doe (at) example (dot) co (dot) uk is", 0, "doe (at) example (dot) co (dot) uk"), ("send it to john_s[at]example.org", 0, "john_s[at]example.org"),
    ("mail to jane.doe at example dot org about it", 0, "jane.doe at example dot org"), ("by lee at mail dot example dot com", 0, "lee at mail dot example dot com"),
    ("see us at example.org for more", None, ""), ("they stood at example.com and the dot matters", None, ""), ("3 (at) noon, 5 [at] night", None, ""),
    ("the host 192.168.10.24 answered", 1, "192.168.10.24"),
    ("paid with 4111 1111 1111 1111 in May", 2, "4111 1111 1111 1111"),
    ("paid with 4111111111111111 in May", 2, "4111111111111111"),
    ("call +1 (212) 555-0134 after six", 3, "+1 (212) 555-0134"),
    ("call +44 20 7946 0958 after six", 3, "+44 20 7946 0958"),
    ('api key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"', 4, "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"),
    ('token sk-proj-a1b2c3d4-e5f6a7b8 is', 4, "sk-proj-a1b2c3d4-e5f6a7b8"), ("set KEY=pk_live_51Habc92kdLm3 now", 4, "pk_live_51Habc92kdLm3"),
    ("mail jane (@) example.org or", 0, "jane (@) example.org"), ("mail JANE AT EXAMPLE DOT ORG or", 0, "JANE AT EXAMPLE DOT ORG"), ("mail jane AT example DOT org or", 0, "jane AT example DOT org"),
    ("the covid-19-2020-2021-season page", None, ""), ("file report-final-v2-2019-05-17 is", None, ""), ("look AT 5 (@) noon", None, ""),
    ("under the Apache License, Version 2.0.", None, ""), ("licensed under CC BY-NC 4.0.", None, ""),
    ("on 2024-05-17 at 10:35:20 we met 12 people", None, ""), ("about 3.14159 or 1,234,567 of them", None, ""),
    ("number 4371290084125427 of the list", None, ""), ("version 1.2.3.400 was old", None, ""),
    ("from 1998-2004 and 2005-2010, pages 100-234", None, ""), ("they met at noon. it was late", None, ""),
    ("isbn 978-3-16-148410 in 2007", None, ""), ("room 12, 2nd floor, 7 of 19", None, ""), ("id 20240517103520 done", None, ""),
    ("look at the. other one", None, ""), ("@someone said it @ 5 pm", None, ""),
]


def train(texts: list[str], rounds: int = 12, seed: int = 7, penalty: float = 1e-3) -> tuple[dict[str, int], np.ndarray]:
    """Feature numbers and weights of distinct texts, by stochastic ascent of the penalised log-likelihood."""
    rng = random.Random(seed)
    numbers: dict[str, int] = {}

    def number(names):
        return [numbers.setdefault(x, len(numbers)) for x in names]

    lattices = []
    for text, kind, entity in EXAMPLES:
        spans = [] if kind is None else [(kind, text.index(entity), text.index(entity) + len(entity))]
        for _ in range(3):
            t, g = rewritten(text, spans, rng)
            lattices.append(Lattice(t, 0, len(t), number, g))
    for text in texts:
        for s, e in windows(text):
            part = text[s:e]
            t, g = rewritten(part, labels_of(part), rng)
            for a, b in windows(t):
                lattices.append(Lattice(t, a, b, number, [x for x in g if a <= x[1] and x[2] <= b]))
    weights, squares = np.zeros(len(numbers)), np.full(len(numbers), 1e-2)
    for _ in range(rounds):
        rng.shuffle(lattices)
        for x in lattices:
            _, g = x.gradient(weights)
            for f, v in g.items():
                v -= penalty * weights[f]
                squares[f] += v * v
                weights[f] += 0.3 * v / math.sqrt(squares[f])
    return numbers, weights


def sample_texts(docs: DataFrame, sample: int = SAMPLE) -> list[str]:
    """Windows of at most `sample` distinct documents with digits or at-signs, both chosen by hashes, each as a text of its own.

    The documents are chosen by the hash of their text, whose copies count once; a text that
    many rows share is no likelier than another.
    """
    text = F.col("text")
    hashed = docs.select(*columns_of(docs, "text")).where(text.rlike("[0-9@]")).withColumn("hash", F.xxhash64(text))
    n = hashed.count()
    # Most rows have no chance: they are left out before the copies are told apart.
    share = 16 * sample / max(n, 1)
    low = cut(hashed.where(F.col("hash") < -(2**63) + int(share * 2**64)) if share < 1 else hashed)
    chosen = F.broadcast(low.select("hash").distinct().orderBy("hash").limit(sample))

    def parts(batches):
        for batch in batches:
            out = [t[s:e] for t in batch.column(0).to_pylist() for s, e in windows(t) if e - s <= TRAINED_LENGTH]
            yield pa.record_batch([pa.array(out, pa.string())], names=["text"])

    found = low.join(chosen, "hash").select("text").mapInArrow(parts, "text string").distinct()
    return [r.text for r in found.orderBy(F.xxhash64("text"), "text").limit(TRAINED_WINDOWS).collect()]


def scores_of(numbers: dict[str, int], weights: np.ndarray) -> Scores:
    """The scores of a trained model; features that training has not seen count nothing."""
    return Scores(lambda names: [numbers[x] for x in names if x in numbers], weights)


def added_spans(text: str, scores: Scores, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The model's entities that do not overlap base spans."""
    starts, ends = [], []
    for _, s, e in sorted(base, key=lambda b: b[1]):
        starts.append(s)
        ends.append(max(e, ends[-1] if ends else 0))
    out = []
    for s, e in windows(text):
        for k, x, y in best_entities(text, s, e, scores):
            before = bisect_left(starts, y)
            if not before or ends[before - 1] <= x:
                out.append((k, x, y))
    return out


def find_spans(docs: DataFrame, sample: int = SAMPLE, column: str = "pii", redact: bool = False, model=None) -> DataFrame:
    """docs with a struct of base and added spans (array of kind, start, end in code points) and, if asked for, the redacted text."""
    numbers, weights = model or train(sample_texts(docs, sample))
    key = hashlib.sha256(repr(sorted(numbers.items())).encode() + weights.tobytes()).hexdigest()
    name = free_name(docs, column)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    kind = pa.struct([("base", pa.list_(span)), ("added", pa.list_(span)), ("redacted", pa.string())])

    def scan(text: pa.Array) -> pa.Array:
        scores = once(("pii", key), lambda: scores_of(numbers, weights))
        rows = []
        for value in text:
            t = value.as_py()
            base = base_spans(t or "")
            added = added_spans(t or "", scores, base)
            as_rows = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in spans]
            rows.append({"base": as_rows(base), "added": as_rows(added), "redacted": redacted(t, base + added) if redact and t is not None else None})
        return pa.array(rows, kind)

    one = "array<struct<kind string, start bigint, end bigint>>"
    found = F.arrow_udf(scan, f"struct<base {one}, added {one}, redacted string>").asNondeterministic()
    return in_small_batches(docs).withColumn(name, found(*columns_of(docs, "text")))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each entity replaced by its kind; overlapping ones are replaced as one."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def span_string(column):
    """Spans as kind:start:end, by kind in the order of KINDS, then start, joined by commas."""
    order = F.transform(
        column,
        lambda x: F.struct(
            F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("k"), x["start"].alias("s"), x["end"].alias("e"),
            F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")).alias("t"),
        ),
    )
    return F.array_join(F.transform(F.sort_array(order), lambda x: x["t"]), ",")


def op10_pii(spark, sf_dir: str) -> DataFrame:
    out = find_spans(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.size(F.filter("pii.base", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return out.select(
        "doc_id", *map(count, KINDS[:4]),
        F.sha2(span_string(F.col("pii.base")).cast("binary"), 256).alias("base_sha256"),
        span_string(F.concat("pii.base", "pii.added")).alias("spans"),
    )
