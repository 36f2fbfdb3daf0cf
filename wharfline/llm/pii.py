"""Personal data by base patterns and a skip-chain conditional random field.

Base spans are the non-overlapping matches, from the left, of four patterns and
always stay. The field adds to them. Its nodes are the tokens (runs without
white space) that hold a digit or an ``@``; any other token can only be plain,
so leaving it out changes no marginal. Neighbouring tokens that can be pieces of
one number are a run and share chain potentials; a run ends where a number
begins (``+``, a bracket, groups that pass the card checksum). Equal runs of a
document are the same nodes, so equal tokens get equal labels, and how often or
how far away they are repeated decides nothing. Nodes whose text, last seven
digits or mail name is the same share a skip potential with the fullest mention
among them, however far apart in the document. What a node hears over its skip
edges is averaged, so many bare repeats don't outvote a full mention. Loopy
sum-product message passing then makes labels agree, until no message of the
document changes by more than ``TOLERANCE``: a phone number without its ``+`` is
found because it was written in full elsewhere. An added span ends where the
label changes and with its run.

The potentials are trained here, by pseudo-likelihood, on ``TRAIN_DOCS``
generated documents whose labels are known by construction.

Defined results: a null text is empty, and an empty text has no spans; long
texts are taken whole, runs of any length included; spans that begin at the same
place are in the order of their kinds, and of equally full mentions the first
is the one that others refer to; repeated rows each get their own result; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Documents that the field is trained on, and the marginal that adds a span.
TRAIN_DOCS = 400
SEED = 7
CERTAIN = 0.9
#: Messages are passed until they change by less; loops that never settle end after ROUNDS.
TOLERANCE, ROUNDS = 1e-6, 2000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern finds them, but from each ``@`` outwards, in linear time."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, sorted."""
    if not _MARK.search(text):
        return []
    out = [(a, 0, z) for a, z in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out)


def tokens(text: str) -> list[tuple[int, int]]:
    """The runs without white space that hold a digit or an ``@``."""
    out: list[tuple[int, int]] = []
    end = 0
    for m in _MARK.finditer(text):
        if m.start() < end:
            continue
        a, z = m.start(), m.end()
        while a > end and not text[a - 1].isspace():
            a -= 1
        while z < len(text) and not text[z].isspace():
            z += 1
        out.append((a, z))
        end = z
    return out


def _trim(text: str, a: int, z: int) -> tuple[int, int]:
    while a < z and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    while z > a and not (text[z - 1].isalnum() or text[z - 1] == ")"):
        z -= 1
    return a, z


def _shape(s: str, joined: str, all_d: str, first: bool) -> list[float]:
    """Features of one token; ``joined`` is the run of neighbours it is part of, ``all_d`` its digits."""
    d = _digits(s)
    letters = sum(c.isalpha() for c in s)
    parts = s.split(".")
    quad = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    n = len(d)
    return [
        1.0,
        float("@" in s),
        float(bool(re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z0-9]", s))),
        float(0 < n <= 3),
        float(4 <= n <= 6),
        float(7 <= n <= 11),
        float(12 <= n <= 19),
        float(n > 19),
        float(letters == 0),
        float(letters > n),
        float(letters > 0 and n > 0),
        float(quad),
        float(quad and all(len(p) <= 3 and int(p) <= 255 for p in parts)),
        float(joined.startswith("+")),
        float(joined.startswith("+") and 9 <= len(all_d) <= 15),
        float("(" in joined[:6]),
        float(s.count("-") == 1 and letters == 0),
        float(s.count("-") > 1),
        float(12 <= len(all_d) <= 19 and luhn(all_d)),
        float(12 <= len(all_d) <= 19 and not luhn(all_d)),
        float(first),
        float(":" in s or "/" in s),
    ]


def _whole(s: str) -> bool:
    """Whether a token can't be a piece of a longer number."""
    return "@" in s or s.count(".") >= 3 or len(_digits(s)) >= 12


def _runs(text: str, spots: list[tuple[int, int]]) -> list[list[int]]:
    """Neighbouring tokens that can be pieces of one number."""
    runs: list[list[int]] = []
    for i, (a, z) in enumerate(spots):
        before = spots[i - 1] if i else (0, 0)
        piece = i and text[before[1] : a] == " " and not _whole(text[slice(*before)]) and not _whole(text[a:z])
        if piece and (text[a] == "+" or text[a] == "(" and (len(runs[-1]) > 1 or len(_digits(text[slice(*before)])) > 3)):
            piece = False  # a number begins here, unless its country code is all before it
        if piece:
            runs[-1].append(i)
        else:
            runs.append([i])
    out = []
    for run in runs:
        size = [z - a if text[a:z].isascii() and text[a:z].isdigit() else 0 for a, z in (spots[i] for i in run)]
        first = k = 0
        while k < len(run):
            n = _card_groups("".join(text[slice(*spots[i])] for i in run[k : k + 6]), size[k : k + 6]) if len(run) > 2 else 0
            if n:
                out += [run[first:k]] * (first < k) + [run[k : k + n]]
                k = first = k + n
            else:
                k += 1
        if first < len(run):
            out.append(run[first:])
    return out


def _card_groups(digits: str, size: list[int]) -> int:
    """How many groups of 3 to 7 digits from the first on are a card number, or 0."""
    total = 0
    for n, k in enumerate(size, 1):
        if not 3 <= k <= 7:
            return 0
        total += k
        if n > 2 and 12 <= total <= 19 and luhn(digits[:total]):
            return n
    return 0


@dataclass
class Field:
    """The field of one document: nodes are the tokens of runs unlike all before them."""

    spots: list[tuple[int, int]]
    node: list[int]  # of each token
    joined: list[bool]  # whether a token goes on with the run of the one before
    first: list[int]  # the first token of each node
    feats: list[list[float]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def graph(text: str) -> Field:
    spots = [x for x in (_trim(text, a, z) for a, z in tokens(text)) if x[0] < x[1]]
    field = Field(spots, [], [], [], [], [], [])
    known: dict[str, int] = {}
    groups: dict[tuple[str, str], list[int]] = {}
    full: list[tuple] = []
    for run in _runs(text, spots):
        joined = text[spots[run[0]][0] : spots[run[-1]][1]]
        at = known.setdefault(joined, len(field.first))
        field.node += range(at, at + len(run))
        field.joined += [k > 0 for k in range(len(run))]
        if at < len(field.first):
            continue
        field.first += run
        field.chain += [(at + k, at + k + 1) for k in range(len(run) - 1)]
        digits = _digits(joined)
        whole = (joined.startswith("+"), "@" in joined, len(digits))
        for k, i in enumerate(run):
            s = text[slice(*spots[i])]
            field.feats.append(_shape(s, joined, digits, k == 0))
            full.append(whole)
            low, d = s.lower(), _digits(s)
            for key in {("t", low), ("d", d[-7:]) if len(d) >= 7 else ("t", low), ("m", low.partition("@")[0])}:
                groups.setdefault(key, []).append(at + k)
    skips = set()
    for nodes in groups.values():
        if len(nodes) > 1:
            hub = max(nodes, key=lambda n: (full[n], -n))
            skips |= {(min(hub, n), max(hub, n)) for n in nodes if n != hub}
    field.skip = sorted(skips)
    return field


def _example(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A document and its true (start, kind, end) spans."""
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        head = num(15)
        return next(head + c for c in "0123456789" if luhn(head + c))

    def bad_card() -> str:
        return next(x for x in iter(lambda: num(16), "") if not luhn(x))

    def phone() -> tuple[str, list[str]]:
        a, b, c = num(3), num(3), num(4)
        return f"+1 ({a}) {b}-{c}", [f"({a}) {b}-{c}", f"{b}-{c}", f"1 ({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a}{b}{c}"]

    def grouped(c: str) -> str:
        return rng.choice([c, " ".join(c[i : i + 4] for i in range(0, 16, 4)), "-".join(c[i : i + 4] for i in range(0, 16, 4))])

    pieces: list[tuple[str, int | None]] = []
    for _ in range(rng.randint(3, 8)):
        k = rng.randrange(12)
        if k == 0:
            pieces.append((f"{word()}.{num(2)}@{word()}.{word()}.com", 0))
        elif k == 1:
            pieces.append((".".join(str(rng.randint(0, 255)) for _ in range(4)), 1))
        elif k == 2:
            pieces.append((grouped(card()), 2))
        elif k in (3, 4):
            full, shorter = phone()
            pieces.append((full, 3))
            if k == 4:  # the same number again, in one or more forms, up to 20 times each
                for short in rng.sample(shorter, rng.choice([1, 1, 1, 2, 4])):
                    pieces += [(short, 3)] * rng.choice([1, 1, 2, 5, 20])
        else:
            decoys = [num(rng.randint(1, 6)), bad_card(), hashlib.sha1(num(8).encode()).hexdigest(), f"{num(1)}.{num(1)}.{num(1)}", f"20{num(2)}-0{num(1)}-1{num(1)}", f"{num(2)}:{num(2)}", f"${num(3)}.{num(2)}", f"v{num(1)}.{num(1)}", f"{num(3)}-{num(4)}", f"({num(3)})", f"@{word()}", f"{num(3)}.{num(3)}.{num(3)}.{9}{num(2)}", f"{word()}{num(3)}", num(10), " ".join(num(rng.randint(1, 2)) for _ in range(rng.randint(2, 9))), " ".join(num(rng.randint(3, 5)) for _ in range(2))]
            pick = rng.choice(decoys)
            pieces += [(pick, None)] * rng.choice([1, 1, 2, 5, 20])
    rng.shuffle(pieces)
    text, spans = "", []
    for s, kind in pieces:
        text += " ".join(word() for _ in range(rng.randint(1, 5))) + " "
        if kind is not None:
            spans.append((len(text), kind, len(text) + len(s)))
        text += s + rng.choice([" ", ", ", ". "])
    return text, spans


def _labels(spots: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    return [next((k + 1 for a, k, z in spans if a < e and s < z), 0) for s, e in spots]


@lru_cache(maxsize=1)
def train(n_docs: int = TRAIN_DOCS, seed: int = SEED, steps: int = 400) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emission, chain and skip weights by pseudo-likelihood, with momentum."""
    rng, feats, labels, chain, skip = random.Random(seed), [], [], [], []
    for _ in range(n_docs):
        text, spans = _example(rng)
        f, at = graph(text), len(labels)
        feats += f.feats
        labels += _labels([f.spots[i] for i in f.first], spans)
        chain += [(a + at, b + at) for a, b in f.chain]
        skip += [(a + at, b + at) for a, b in f.skip]
    x, y = np.array(feats), np.eye(len(KINDS) + 1)[labels]
    c, s = np.array(chain).reshape(-1, 2), np.array(skip).reshape(-1, 2)
    k = y.shape[1]
    before, after, near = np.zeros((len(x), k)), np.zeros((len(x), k)), np.zeros((len(x), k))
    np.add.at(before, c[:, 1], y[c[:, 0]])
    np.add.at(after, c[:, 0], y[c[:, 1]])
    np.add.at(near, s[:, 0], y[s[:, 1]])
    np.add.at(near, s[:, 1], y[s[:, 0]])
    near /= np.maximum(1, np.bincount(s.ravel(), minlength=len(x)))[:, None]
    w = [np.zeros((x.shape[1], k)), np.zeros((k, k)), np.zeros((k, k))]
    v = [np.zeros_like(a) for a in w]
    for _ in range(steps):
        score = x @ w[0] + before @ w[1] + after @ w[1].T + near @ w[2]
        p = np.exp(score - score.max(axis=1, keepdims=True))
        g = (y - p / p.sum(axis=1, keepdims=True)) / len(x)
        skipped = near.T @ g
        grads = [x.T @ g, before.T @ g + g.T @ after, (skipped + skipped.T) / 2]
        for i, d in enumerate(grads):
            v[i] = 0.9 * v[i] + d - 1e-4 * w[i]
            w[i] = w[i] + 2.0 * v[i]
    return tuple(w)


def marginals(feats: np.ndarray, chain: np.ndarray, skip: np.ndarray, model: tuple[np.ndarray, ...], doc: np.ndarray | None = None, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> np.ndarray:
    """Label marginals of all nodes by damped loopy sum-product messages.

    A document (``doc`` of each node) whose messages have settled is left alone,
    so its marginals don't depend on what else is passed at once.
    """
    emit, a, s = model
    total = feats @ emit
    n, k = total.shape
    local, doc = total.copy(), np.zeros(n, np.int64) if doc is None else doc
    src = np.concatenate((chain[:, 0], chain[:, 1], skip[:, 0], skip[:, 1]))
    dst = np.concatenate((chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0]))
    nc, ns = len(chain), len(skip)
    kind = np.repeat([0, 1, 2], [nc, nc, 2 * ns])  # forward, backward, skip
    pots = np.stack((a, a.T, s))
    weight = np.ones(len(src))
    weight[2 * nc :] = 1 / np.maximum(1, np.bincount(dst[2 * nc :], minlength=n))[dst[2 * nc :]]
    back = np.concatenate((np.arange(nc) + nc, np.arange(nc), np.arange(ns) + 2 * nc + ns, np.arange(ns) + 2 * nc))
    msg, live = np.zeros((len(src), k)), np.arange(len(src))
    for _ in range(rounds):
        if not live.size:
            break
        into = total[src[live]] - msg[back[live]] * weight[back[live], None]
        new = into[:, :, None] + pots[kind[live]]
        top = new.max(axis=1)
        new = top + np.log(np.exp(new - top[:, None]).sum(axis=1))
        new = 0.5 * msg[live] + 0.5 * (new - new.max(axis=1, keepdims=True))
        change = np.zeros(int(doc.max()) + 1)
        np.maximum.at(change, doc[dst[live]], np.abs(new - msg[live]).max(axis=1))
        msg[live] = new
        met = np.unique(dst[live])
        total[met] = local[met]
        np.add.at(total, dst[live], new * weight[live, None])
        live = live[change[doc[dst[live]]] > tolerance]
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def all_spans(texts: list[str], model: tuple[np.ndarray, ...], certain: float = CERTAIN) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, added spans) of each text, message passing over all at once."""
    base = [base_spans(t) for t in texts]
    feats, chain, skip, doc, of, spots, node, joined = [], [], [], [], [], [], [], []
    for i, t in enumerate(texts):
        if not _MARK.search(t):
            continue
        f, at = graph(t), len(feats)
        feats += f.feats
        chain += [(a + at, b + at) for a, b in f.chain]
        skip += [(a + at, b + at) for a, b in f.skip]
        doc += [i] * len(f.feats)
        node += [n + at for n in f.node]
        joined += f.joined
        of += [i] * len(f.spots)
        spots += f.spots
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if feats:
        pairs = lambda e: np.array(e, np.int64).reshape(-1, 2)
        p = marginals(np.array(feats), pairs(chain), pairs(skip), model, np.array(doc))[node]
        label = np.where(p[:, 1:].max(axis=1) >= certain, p[:, 1:].argmax(axis=1), -1).tolist()
        taken = [iter(b) for b in base]
        held = [next(t, None) for t in taken]
        ends = [0] * len(texts)  # the furthest end of the base spans passed
        last = None
        for j, (i, (a, z), k) in enumerate(zip(of, spots, label, strict=True)):
            while held[i] is not None and held[i][0] < z:
                ends[i] = max(ends[i], held[i][2])
                held[i] = next(taken[i], None)
            if k < 0 or ends[i] > a:
                last = None
                continue
            if last == (j - 1, k) and joined[j]:
                s, _, _ = added[i].pop()
                added[i].append((s, k, z))
            else:
                added[i].append((a, k, z))
            last = (j, k)
    return list(zip(base, added, strict=True))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", certain: float = CERTAIN) -> DataFrame:
    """One row per document: base counts and digest, all spans, ``n_added``."""
    model = train()
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                got = all_spans([t or "" for t in b.column("t").to_pylist()], model, certain)
                counts = [pa.array([sum(s[1] == k for s in base) for base, _ in got], pa.int64()) for k in range(4)]
                digest = pa.array([hashlib.sha256(_written(base).encode()).hexdigest() for base, _ in got], pa.string())
                spans = pa.array([_written(sorted(base + more)) for base, more in got], pa.string())
                more = pa.array([len(m) for _, m in got], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("d"), *counts, digest, spans, more], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col(doc_id).alias("d"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string, n_added long")
