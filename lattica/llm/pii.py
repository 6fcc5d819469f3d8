"""Personal information in free text: a skip-chain conditional random field with loopy message passing.

A text is cut into tokens: runs of letters, runs of digits, single marks. Each token is a node; its label says which kind of value it begins or
continues, or none, so the spans come from labels alone. Neighbouring tokens share a transition potential, and repeated or similar words and
numbers of a document, however far apart, share a skip potential (each is tied to its next occurrence, so ties grow with the text and not with its
square). Sum-product messages pass along all edges between all nodes for a fixed number of rounds; each node takes its most likely label.

The field is fitted on at most `train_docs` whole documents of at most `train_chars` characters (those with a rough cue first), labelled by rules
(`pii_lexer`) whose names are learned from the sample. Half of the training is done on copies of these documents in which every name, and some other
words, are replaced by invented ones, and some names are said again among words that tell nothing: what is left to learn there is the
context, and for the repeated ones the tie to their first mention. The node potentials are a softmax
regression over hashed features of the token, its neighbours, its blank-free chunk and its run of digits. The edge potentials are
fitted by pseudo-likelihood on documents that the node potentials they are fitted with have not seen. The weights, a few MB whatever the table's size,
are broadcast. Every document is labelled whole, in Arrow batches; there is no shuffle, unless the input has fewer splits than there are cores.

Null and empty texts hold nothing. Repeated documents give their own rows; a value that occurs twice in a document is one row
of `found`. Offsets are in characters.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import pii_lexer as lex
from lattica.session import spread

TRAIN_DOCS, TRAIN_CHARS = 3000, 20_000
#: Rough cue for documents worth labelling by rules in the training sample.
CUES = r"@|[\[(]at[\])]|\bdot\b|\(0?\d{2,3}\)|\+\d{1,2}[ -]|\d{3}[-. /]\d{2,}|\b[A-Z]{2}\d{7}|Tel|Dr |Prof|Regards|Patient"
DIM = 1 << 17
LABELS = 2 * len(lex.KINDS) - 1
ROUNDS = 8
CHARS_PER_BATCH = 200_000
#: Features of a token by its text alone, and which of them count for a neighbour at each distance.
_OWN = 6
_OFFSETS = {-4: (0,), -3: (0, 4), -2: (0, 2, 4), -1: (0, 1, 2, 3, 4), 0: (0, 1, 2, 3, 4, 5), 1: (0, 1, 2, 3, 4), 2: (0, 3, 4), 3: (0, 3), 4: (0,)}


def _crc(s: str) -> int:
    return zlib.crc32(s.encode()) & 0x7FFFFFFF


def _shape(s: str) -> str:
    return re.sub(r"\d+", lambda m: f"9{len(m[0])}", re.sub(r"[A-ZÀ-Þ]+", "A", re.sub(r"[a-zß-ÿ]+", "a", s)))[:32]


def _mix(a: np.ndarray, b: np.ndarray | int, salt: int) -> np.ndarray:
    """Hashed place of a pair of codes in the weights."""
    return ((a * 1000003 + np.asarray(b) * 7919 + salt * 40503) % 2147483629 * 48271 % 2147483647 % DIM).astype(np.int64)


class Codes:
    """Numbers of strings, and what is known of a token by its text; kept from batch to batch, emptied when large."""

    def __init__(self) -> None:
        self.tokens: dict[str, int] = {}
        self.own: list[tuple[int, ...]] = []
        self.tie: list[int] = []
        self.other: dict[str, int] = {}

    def tidy(self) -> None:
        if len(self.tokens) > 200_000 or len(self.other) > 400_000:
            self.__init__()

    def token(self, s: str) -> int:
        got = self.tokens.get(s)
        if got is None:
            got = self.tokens[s] = len(self.own)
            low = s.lower()
            if s[0].isdigit():
                n = str(min(len(s), 12))
                self.own.append((_crc("d" + n), _crc("dd"), _crc("z" + s[:1] + n), _crc("z" + s[:2]), _crc("d" + n), _crc("d")))
                self.tie.append(_crc("d" + s) if len(s) >= 5 else 0)
            elif s[0].isalpha():
                case = "A" if s.isupper() else "a" if s.islower() else "Aa"
                n = min(len(s), 8)
                self.own.append((_crc("w" + low), _crc("p" + low[:3]), _crc("s" + low[-3:]), _crc("t" + low[-5:]), _crc(f"c{case}{n}"), _crc("c" + case)))
                self.tie.append(_crc("t" + plain_word(low)) if len(s) >= 4 else 0)
            else:
                self.own.append((_crc("m" + s), _crc("m" + s), _crc("m"), _crc("m" + s), _crc("m"), _crc("m")))
                self.tie.append(0)
        return got

    def code(self, s: str) -> int:
        got = self.other.get(s)
        if got is None:
            got = self.other[s] = _crc(s)
        return got


def plain_word(low: str) -> str:
    """A word without accents and spellings of umlauts: what ties distant tokens."""
    s = "".join(c for c in unicodedata.normalize("NFKD", low.replace("ß", "ss")) if not unicodedata.combining(c))
    return s.replace("oe", "o").replace("ae", "a").replace("ue", "u")


@dataclass
class Batch:
    """Tokens of several documents in one array; outer holds the features of a token beyond its own text and its neighbours'."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    token: np.ndarray
    outer: np.ndarray
    skip: np.ndarray


_OUTSIDE = ".,;:!?()[]<>\"'|/-"
_RUN_MARKS = frozenset("+()-./")
_OUTER = 14


def _chunks(text: str, starts: np.ndarray, codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: code of its blank-free chunk, its place in it, and the chunk's number."""
    spans = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    shapes = np.empty(len(spans), np.int64)
    for i, (a, b) in enumerate(spans):
        s = text[a:b].strip(_OUTSIDE)
        shapes[i] = codes.code("k" + (s.lower() if len(s) <= 4 else "@" + _shape(s.split("@")[-1])[-6:] if "@" in s else _shape(s) if not s.isalpha() else "word"))
    of = np.searchsorted(np.array([a for a, _ in spans], np.int64), starts, side="right") - 1
    first = np.searchsorted(of, of, side="left")
    return shapes, np.minimum(np.arange(len(of)) - first, 9), of


def _runs(text: str, spans: list[tuple[int, int]], codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Per token: code of the run of digits and marks it stands in (0: none), and whether it opens it."""
    sig, place = np.zeros(len(spans), np.int64), np.zeros(len(spans), np.int64)
    i, n = 0, len(spans)
    while i < n:
        if not text[spans[i][0]].isdigit():
            i += 1
            continue
        def inside(j: int) -> bool:
            c = text[spans[j][0]]
            if c.isdigit():
                return True
            if c in _RUN_MARKS:
                return True
            beside = (j + 1 < n and text[spans[j + 1][0]].isdigit() and spans[j + 1][0] - spans[j][1] <= 1) or (j and text[spans[j - 1][0]].isdigit() and spans[j][0] - spans[j - 1][1] <= 1)
            return c.isalpha() and spans[j][1] - spans[j][0] <= 2 and bool(beside)

        a = b = i
        while a > 0 and spans[a][0] - spans[a - 1][1] <= 1 and inside(a - 1) and not sig[a - 1]:
            a -= 1
        while b + 1 < n and spans[b + 1][0] - spans[b][1] <= 1 and inside(b + 1):
            b += 1
        last = b
        while b > i and text[spans[b][0]] in "+-./(" or b > i and text[spans[b][0]] == ")" and "(" not in text[spans[a][0] : spans[b][0]]:
            b -= 1
        while a < i and text[spans[a][0]] in "-./)":
            a += 1
        parts = []
        for j in range(a, b + 1):
            s = text[spans[j][0] : spans[j][1]]
            parts.append((" " if j > a and spans[j][0] > spans[j - 1][1] else "") + (f"{'0' if s[0] == '0' else '9'}{len(s)}" if s[0].isdigit() else "A" * len(s) if s.isalpha() else s))
        code = codes.code("r" + "".join(parts)[:48])
        sig[a : b + 1] = code
        place[a + 1 : b + 1] = 1
        i = last + 1
    return sig, place


def read(texts: list[str], codes: Codes) -> Batch:
    docs, starts, ends, toks, outers, skips = [], [], [], [], [], []
    base = 0
    for d, text in enumerate(texts):
        spans = [m.span() for m in lex.TOKEN.finditer(text)]
        if not spans:
            continue
        st, en = np.array(spans, np.int64).T
        tok = np.array([codes.token(text[a:b]) for a, b in spans], np.int64)
        n = len(spans)
        gaps = np.empty(n, np.int64)
        gaps[0] = 3
        breaks = np.array([m.start() for m in re.finditer(r"\n", text)], np.int64)
        line = np.searchsorted(breaks, st)
        width = st[1:] - en[:-1]
        gaps[1:] = np.where(line[1:] > line[:-1], 3, np.minimum(width, 2))
        after = np.append(gaps[1:], 3)
        shapes, place, of = _chunks(text, st, codes)
        sig, inner = _runs(text, spans, codes)
        chunk = shapes[of]
        before_chunk = np.where(of > 0, shapes[np.maximum(of - 1, 0)], 5)
        next_chunk = np.where(of + 1 < len(shapes), shapes[np.minimum(of + 1, len(shapes) - 1)], 5)
        third = np.where(of + 2 < len(shapes), shapes[np.minimum(of + 2, len(shapes) - 1)], 5)
        own = np.array([codes.own[t] for t in tok], np.int64)
        case, low = own[:, 4], own[:, 0]
        prev = lambda x, k=1: np.concatenate([np.full(k, 5, np.int64), x[:-k]])[:n] if n > k else np.full(n, 5, np.int64)
        nxt = lambda x, k=1: np.concatenate([x[k:], np.full(k, 5, np.int64)])[:n] if n > k else np.full(n, 5, np.int64)
        head = place == 0
        out = np.stack([
            _mix(gaps * 4 + after, 1, 101), _mix(chunk, np.minimum(place, 3), 102), _mix(sig, inner, 103), _mix(before_chunk, head + 10 * (sig > 0), 104),
            _mix(next_chunk, head + 10 * case, 105), _mix(case, gaps * 4 + after, 106), _mix(case * 31 + prev(case), gaps, 107), _mix(case * 31 + nxt(case), after, 108),
            _mix(case * 961 + nxt(case) * 31 + nxt(case, 2), after, 109), _mix(case * 31 + prev(low), gaps, 110), _mix(case * 31 + nxt(low), after, 111),
            _mix(case * 961 + prev(low) * 31 + prev(low, 2), gaps, 112), _mix(case * 31 + nxt(own[:, 2], 2), after, 113), _mix(next_chunk * 31 + third, head, 114),
        ], axis=1).astype(np.int32)
        tie = np.array([codes.tie[t] for t in tok], np.int64)
        at = np.flatnonzero(tie)
        if len(at) > 1:
            order = at[np.argsort(tie[at], kind="stable")]
            same = tie[order[1:]] == tie[order[:-1]]
            skips.append(np.stack([order[:-1][same], order[1:][same]], axis=1) + base)
        docs.append(np.full(n, d))
        starts.append(st)
        ends.append(en)
        toks.append(tok)
        outers.append(out)
        base += n
    if not docs:
        none = np.zeros(0, np.int64)
        return Batch(none, none, none, none, np.zeros((0, _OUTER), np.int32), np.zeros((0, 2), np.int64))
    return Batch(*map(np.concatenate, (docs, starts, ends, toks, outers)), np.concatenate(skips) if skips else np.zeros((0, 2), np.int64))


def _own_index(own: np.ndarray, offset: int) -> np.ndarray:
    return np.stack([_mix(own[:, i], i, 7 + 13 * (offset + 5)) for i in _OFFSETS[offset]], axis=1)


def feature_index(batch: Batch, codes: Codes, at: np.ndarray) -> np.ndarray:
    """(nodes, features) places in the weights, for training on the nodes at the given places."""
    n = len(batch.doc)
    table = np.array(codes.own, np.int64).reshape(-1, _OWN)
    cols = []
    for o in _OFFSETS:
        j = np.clip(at + o, 0, n - 1)
        same = (at + o >= 0) & (at + o < n) & (batch.doc[j] == batch.doc[at])
        cols.append(np.where(same[:, None], _own_index(table[batch.token[j]], o), o + 5))
    return np.concatenate([*(c.astype(np.int32) for c in cols), batch.outer[at]], axis=1)


@dataclass
class Field:
    weights: np.ndarray
    bias: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def unary(field: Field, batch: Batch, codes: Codes) -> np.ndarray:
    """Node potentials. What depends on a token's text alone is added up once per distinct text and offset."""
    n = len(batch.doc)
    score = np.tile(field.bias, (n, 1)).astype(np.float32)
    for c in range(batch.outer.shape[1]):
        score += field.weights[batch.outer[:, c]]
    distinct, inverse = np.unique(batch.token, return_inverse=True)
    own = np.array([codes.own[t] for t in distinct], np.int64).reshape(-1, _OWN)
    for o in _OFFSETS:
        part = field.weights[_own_index(own, o)].sum(1)
        edge = len(_OFFSETS[o]) * field.weights[o + 5]
        lo, hi = max(0, -o), min(n, n - o)
        if hi <= lo:
            score += edge
            continue
        add = np.tile(edge, (n, 1))
        same = batch.doc[lo:hi] == batch.doc[lo + o : hi + o]
        add[lo:hi][same] = part[inverse[lo + o : hi + o][same]]
        score += add
    return score


def chain_edges(batch: Batch) -> np.ndarray:
    a = np.flatnonzero(batch.doc[1:] == batch.doc[:-1])
    return np.stack([a, a + 1], axis=1)


def beliefs(field: Field, batch: Batch, score: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Log beliefs after loopy sum-product over all chain and skip edges, all messages at once in each round."""
    state = []
    for e, psi in ((chain_edges(batch), field.chain), (batch.skip, field.skip)):
        if len(e):
            zero = np.zeros((len(e), LABELS), np.float32)
            state.append([e[:, 0], e[:, 1], np.exp(psi).astype(np.float32), zero, zero])
    total = score.astype(np.float32)
    for _ in range(rounds if state else 0):
        for s in state:
            u, v, pos, uv, vu = s
            s[3], s[4] = _message(total[u] - vu, pos), _message(total[v] - uv, pos.T)
        total = score.astype(np.float32)
        for u, v, _pos, uv, vu in state:
            # a node has one next neighbour and one next occurrence, so no index comes twice
            total[v] += uv
            total[u] += vu
    return total


def _message(cavity: np.ndarray, pos: np.ndarray) -> np.ndarray:
    m = np.log(np.exp(cavity - cavity.max(1, keepdims=True)) @ pos + np.float32(1e-30))
    return m - m.max(1, keepdims=True)


_SYLLABLES = ("ba be bo bra ca che co da del do dri fa fe fin ga gen go ha hen ho ja jo ka kel ko la len lo ma mer mi na nel no pa per po ra ren ri sa sen so ta ter ti to va ven vi wa wil ya zan ze smith ton ley son well wood ford er o a").split()


def _invented(rng: random.Random, like: str) -> str:
    word = "".join(rng.choice(_SYLLABLES) for _ in range(rng.choice((2, 2, 2, 3, 3, 1))))
    word = word if len(word) > 2 else word + rng.choice(("n", "s", "rd"))
    return word.upper() if like.isupper() else word.title() if like[:1].isupper() else word


def renamed(text: str, spans: list[tuple[int, int, int]], rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with the words of its names, and some other capitalised words, replaced by invented ones, and the spans in it."""
    held: dict[str, str] = {}
    out, moved, at = [], [], 0
    people = [(a, b) for a, b, k in spans if k == 5]
    inside = lambda p, q: next((s for s in spans if s[0] <= p and q <= s[1]), None)
    edits = []
    for a, b in people:
        edits += [(a + m.start(), a + m.end()) for m in re.finditer(r"[^\W\d_]{2,}", text[a:b]) if m.group() not in ("von", "van", "der", "den", "de", "la", "del", "da", "di", "al")]
    for m in re.finditer(r"(?<=[a-z] )[A-ZÀ-Þ][^\W\d_]{3,}(?![\w@.-])", text):
        if inside(*m.span()) is None and rng.random() < 0.5:
            edits.append(m.span())
    shift = []
    for a, b in sorted(edits):
        if a < at:
            continue
        old = text[a:b]
        new = held.setdefault(old.lower(), _invented(rng, old))
        new = new.upper() if old.isupper() and len(old) > 1 else new.title() if old[:1].isupper() else new.lower()
        out += [text[at:a], new]
        shift.append((b, len(new) - len(old)))
        at = b
    out.append(text[at:])
    edges = [b for b, _ in shift]
    total = np.concatenate([[0], np.cumsum([s for _, s in shift])]).astype(int)
    move = lambda x: x + int(total[int(np.searchsorted(edges, x, side="right"))])
    for a, b, k in spans:
        moved.append((move(a), move(b), k))
    return "".join(out), moved


def echoed(text: str, spans: list[tuple[int, int, int]], rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with one of its names said again at the end between words of the text that tell nothing, and the spans in it."""
    people = [s for s in spans if s[2] == 5 and "\n" not in text[s[0] : s[1]]]
    words = re.findall(r"(?<= )[a-zß-ÿ]{2,}(?= )", text)
    if not people or len(words) < 4:
        return text, spans
    a, b, _ = rng.choice(people)
    before, after = (" ".join(rng.sample(words, rng.choice((1, 2)))) for _ in "ab")
    start = len(text) + 1 + len(before) + 1
    return f"{text} {before.capitalize()} {text[a:b]} {after}.", [*spans, (start, start + b - a, 5)]


@dataclass
class Sample:
    """Chosen tokens of the training documents: feature places, labels, weights, and the document of each."""

    index: np.ndarray
    y: np.ndarray
    heavy: np.ndarray
    doc: np.ndarray


def _labels(batch: Batch, marked: list[tuple[str, list[tuple[int, int, int]]]]) -> np.ndarray:
    bounds = np.searchsorted(batch.doc, np.arange(len(marked) + 1))
    parts = [lex.token_labels(list(zip(batch.start[a:b].tolist(), batch.end[a:b].tolist(), strict=True)), s) for (_, s), a, b in zip(marked, bounds[:-1], bounds[1:], strict=True)]
    return np.array([x for p in parts for x in p], np.int64)


def _sample(marked: list[tuple[str, list[tuple[int, int, int]]]], codes: Codes, seed: int, docs_at_once: int = 200) -> Sample:
    """All tokens near a value, and a part of the others at as much more weight; read in parts, so that only what is chosen stays in memory."""
    rng = np.random.default_rng(seed)
    parts: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, len(marked), docs_at_once):
        part = marked[lo : lo + docs_at_once]
        batch = read([t for t, _ in part], codes)
        if not len(batch.doc):
            continue
        y = _labels(batch, part)
        digit = np.array([codes.own[t][1] for t in batch.token]) == _crc("dd")
        share = np.where(np.convolve(y > 0, np.ones(9), "same") > 0.5, 1.0, np.where(digit, 0.25, 0.05))
        chosen = np.flatnonzero(rng.random(len(y)) < share)
        parts.append((feature_index(batch, codes, chosen), y[chosen].astype(np.int8), (1 / share[chosen]).astype(np.float32), (batch.doc[chosen] + lo).astype(np.int32)))
    if not parts:
        return Sample(np.zeros((0, 1), np.int32), np.zeros(0, np.int8), np.zeros(0, np.float32), np.zeros(0, np.int32))
    return Sample(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _empty_field() -> Field:
    return Field(np.zeros((DIM, LABELS), np.float32), np.zeros(LABELS, np.float32), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)))


def _softmax_fit(sample: Sample, docs: np.ndarray, epochs: int, seed: int) -> Field:
    """Node potentials by Adagrad, on the documents marked in docs."""
    field = _empty_field()
    rng = np.random.default_rng(seed)
    rows = np.flatnonzero(docs[sample.doc])
    width = sample.index.shape[1]
    eye = np.eye(LABELS, dtype=np.float32)
    grad2 = np.full((DIM, LABELS), 1e-3, np.float32)
    bias2 = np.full(LABELS, 1e-3, np.float32)
    for _ in range(epochs):
        order = rng.permutation(rows)
        for lo in range(0, len(order), 8192):
            part = order[lo : lo + 8192]
            index = sample.index[part]
            score = np.tile(field.bias, (len(part), 1))
            for c in range(width):
                score += field.weights[index[:, c]]
            p = np.exp(score - score.max(1, keepdims=True))
            err = (p / p.sum(1, keepdims=True) - eye[sample.y[part]]) * sample.heavy[part, None] / 32
            flat = index.ravel()
            for k in range(LABELS):
                g = np.bincount(flat, weights=np.repeat(err[:, k], width), minlength=DIM).astype(np.float32)
                grad2[:, k] += g * g
                field.weights[:, k] -= 0.2 * g / np.sqrt(grad2[:, k])
            b = err.sum(0)
            bias2 += b * b
            field.bias -= 0.2 * b / np.sqrt(bias2)
    return field


def _edge_fit(field: Field, batch: Batch, score: np.ndarray, y: np.ndarray, steps: int = 120, decay: float = 2e-4) -> None:
    """Transition and skip potentials by pseudo-likelihood: each label given its neighbours' labels and its own node potential."""
    hot = np.convolve(y > 0, np.ones(5), "same") > 0.5
    top = np.partition(score, -2, axis=1)
    use = hot | (top[:, -1] - top[:, -2] < 6.0)
    if not use.any():
        return
    number = np.cumsum(use) - 1
    eye, base = np.eye(LABELS), score[use].astype(np.float64)
    gold = eye[y[use]]
    # per kind of edge: the nodes that look forward, and what stands there; the nodes that look back, and what stands there
    sides = []
    for e in (chain_edges(batch), batch.skip):
        ahead, back = e[use[e[:, 0]]], e[use[e[:, 1]]]
        sides.append((number[ahead[:, 0]], y[ahead[:, 1]], number[back[:, 1]], y[back[:, 0]]))
    psis = [np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))]
    squares = [np.full((LABELS, LABELS), 1e-6) for _ in psis]
    for _ in range(steps):
        logits = base.copy()
        for psi, (n1, y1, n2, y2) in zip(psis, sides, strict=True):
            logits[n1] += psi.T[y1]
            logits[n2] += psi[y2]
        p = np.exp(logits - logits.max(1, keepdims=True))
        err = p / p.sum(1, keepdims=True) - gold
        for i, (n1, y1, n2, y2) in enumerate(sides):
            g = (err[n1].T @ eye[y1] + eye[y2].T @ err[n2]) / len(base) + decay * psis[i]
            squares[i] += g * g
            psis[i] -= 0.3 * g / np.sqrt(squares[i])
    field.chain, field.skip = psis[0], (psis[1] + psis[1].T) / 2


def fit(texts: list[str], epochs: int = 10, seed: int = 1) -> Field:
    """Node potentials on all texts and their renamed copies; edge potentials on one half with node potentials of the other."""
    texts = [t for t in texts if t]
    rng = random.Random(seed)
    names = lex.learn_names(texts)
    marked = [(t, lex.rule_spans(t, names)) for t in texts]
    copies = [renamed(t, s, rng) for t, s in marked]
    marked += [echoed(t, s, rng) if rng.random() < 0.5 else (t, s) for t, s in copies]
    codes = Codes()
    sample = _sample(marked, codes, seed)
    half = np.arange(len(marked)) % len(texts) % 2 == 0 if texts else np.zeros(0, bool)
    if not len(sample.y):
        return _empty_field()
    field = _softmax_fit(sample, np.ones(len(marked), bool), epochs, seed)
    other = _softmax_fit(sample, half, max(2, epochs // 3), seed + 1)
    del sample
    unseen = [m for i, m in enumerate(marked) if i >= len(texts) and not half[i]]
    batch = read([t for t, _ in unseen], codes)
    if len(batch.doc):
        _edge_fit(field, batch, unary(other, batch, codes), _labels(batch, unseen))
    return field


_WORD = re.compile(r"[^\W\d_]{3,}")


def _holds(kind: int, value: str) -> bool:
    """What a value of the kind is by its definition: a mail has a sign for at, a name two parts and a word, a number its digits."""
    digits = sum(c.isdigit() for c in value)
    if kind == 1:
        return bool(re.search(r"@|\bat\b|[\[(]at[\])]", value)) and bool(re.search(r"\.|dot", value))
    if kind == 5:
        return bool(_WORD.search(value)) and len(re.findall(r"[^\W\d_]+", value)) > 1 and bool(re.search(r"[ , ]", value))
    return digits >= (6 if kind in (2, 3) else 1)


_END = re.compile(r"[.;:!?,]$")


def _parted(kind: int, text: str, last: tuple[int, int], nxt: int) -> bool:
    """Whether a value of the kind cannot go on from the token at last to the one that starts at nxt: over a line break, or over the end of a sentence."""
    between = text[last[1] : nxt]
    if "\n" in between:
        return True
    if not between or kind in (1, 4):
        return False
    mark = text[last[0] : last[1]]
    # a point after more than an initial
    return bool(_END.match(mark)) and mark != "," and (kind != 5 or text[max(0, last[0] - 2) : last[0]].isalpha())


def _trimmed(a: int, b: int, k: int, text: str) -> tuple[int, int, int]:
    """Without surrounding punctuation; an abbreviation point of a street name stays."""
    while b > a and text[b - 1] in ".,;:!?" and not (k == 4 and text[b - 1] == "." and text[b - 2 : b - 1].isalpha()) and not (k == 5 and text[b - 1] == "." and re.search(r"(?<![^\W\d_])[^\W\d_]\.$", text[a:b])):
        b -= 1
    return a, b, k


def spans(text: str, starts: np.ndarray, ends: np.ndarray, labels: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, pii kind) in order, from the labels of the tokens."""
    out: list[tuple[int, int, int]] = []
    kinds = (labels + 1) // 2
    last = -2
    for i in np.flatnonzero(labels).tolist():
        k, a, b = int(kinds[i]), int(starts[i]), int(ends[i])
        if out and last == i - 1 and out[-1][2] == k and labels[i] == 2 * k and not _parted(k, text, (int(starts[last]), int(ends[last])), a):
            out[-1] = (out[-1][0], b, k)
        else:
            out.append((a, b, k))
        last = i
    return [(a, b, lex.KINDS[k]) for a, b, k in (_trimmed(*s, text) for s in out) if _holds(k, text[a:b])]


def label_texts(field: Field, texts: list[str | None], codes: Codes) -> list[list[tuple[int, int, str]]]:
    """The spans of each text; texts are gathered into batches of tokens, a long text is a batch of its own."""
    result: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    group: list[int] = []
    size = 0

    def run() -> None:
        codes.tidy()
        batch = read([texts[i] for i in group], codes)
        if len(batch.doc):
            y = beliefs(field, batch, unary(field, batch, codes)).argmax(1)
            bounds = np.searchsorted(batch.doc, np.arange(len(group) + 1))
            for g, i in enumerate(group):
                a, b = bounds[g], bounds[g + 1]
                if y[a:b].any():
                    result[i] = spans(texts[i], batch.start[a:b], batch.end[a:b], y[a:b])
        group.clear()

    for i, t in enumerate(texts):
        if not t:
            continue
        if group and size + len(t) > CHARS_PER_BATCH:
            run()
            size = 0
        group.append(i)
        size += len(t)
    if group:
        run()
    return result


def train(docs: DataFrame, doc_id: str, text: str, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Field:
    """Fit on at most `train_docs` whole documents of at most `train_chars` characters: those with a cue first, among them the smallest hashes of the id."""
    kept = docs.select(F.col(text).alias("t"), F.xxhash64(doc_id).alias("h")).filter(F.col("t").isNotNull() & (F.length("t") <= train_chars))
    sample = kept.withColumn("cued", F.col("t").rlike(CUES)).orderBy(F.desc("cued"), "h", "t").limit(train_docs)
    return fit([r.t for r in sample.collect()])


def _run(df: DataFrame, field: Field, doc_id: str, text: str, schema: str, rows) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast((field.weights, field.bias, field.chain, field.skip))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine, codes = Field(*shared.value), Codes()
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):  # bounds the memory of long texts
                part = pdf.iloc[lo : lo + 1000]
                texts = [t if isinstance(t, str) else None for t in part["text"]]
                yield rows(part["doc_id"].tolist(), texts, label_texts(mine, texts, codes))

    return spread(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).mapInPandas(work, schema)


def find(df: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, pii_kind, pii_text, start, end): every place."""

    def rows(ids, texts, found):
        flat = [(i, k, t[a:b], a, b) for i, t, s in zip(ids, texts, found, strict=True) for a, b, k in s]
        return pd.DataFrame(flat, columns=["doc_id", "pii_kind", "pii_text", "start", "end"])

    return _run(df, field, doc_id, text, "doc_id bigint, pii_kind string, pii_text string, start int, end int", rows)


def redact(df: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_replaced): the text with typed placeholders such as [EMAIL], the rest as it was."""

    def rows(ids, texts, found):
        out = []
        for i, t, s in zip(ids, texts, found, strict=True):
            parts, at = [], 0
            for a, b, k in s:
                parts += [t[at:a], f"[{k.upper()}]"]
                at = b
            out.append((i, None if t is None else "".join(parts) + t[at:], len(s)))
        return pd.DataFrame(out, columns=["doc_id", "text", "n_replaced"])

    return _run(df, field, doc_id, text, "doc_id bigint, text string, n_replaced int", rows)
