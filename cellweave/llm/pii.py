"""Operator 2: personal data by a skip-chain conditional random field.

Base spans come from patterns with checks (email, ip, card, phone).  The field then labels the
candidate tokens of each document: tokens with an @ and groups of digits.  A token's potential
comes from its shape; neighbouring candidates share a chain potential; candidates anywhere in the
document that repeat the same local part or the same digits (in whatever punctuation) share a skip
potential, and those that are only similar (the same letters, the same last seven digits) another.
Loopy sum-product passing over all edges gives marginals, and a candidate outside all base spans
becomes a span if its best entity label reaches ``sure``.  So a number that is unmistakable once
(+1 ..., a valid card) is also found where it is written another way.
Repeats are linked to the first base span of each kind among them, or to the first of them where
there is none, never all with all, so a document's edges are linear in its candidates and no repeat
is more than one link from the evidence.  Numbers of 9 to 15 digits repeat by their last nine.

Weights are trained here, conditionally: they maximise the pseudo-likelihood of the candidates'
labels (base spans, over all documents) given their shapes and their neighbours' labels.  Candidates
without a label that repeat a labelled one count as unknown and are left out.  Equal contexts
(shape and neighbours' labels) are counted once over all partitions; each of ``rounds`` Newton steps
(diagonal, with a normal prior that favours agreement on skip edges) sums the gradient over the
partitions of that table.  To the driver come the sums, one row per weight.

Plan: two maps over the texts and small aggregations; nothing else is shuffled, and a batch holds few
documents.  Defined cases: a null or empty text has no spans; very long texts are scanned whole;
documents are scanned row by row, so repeated rows, ties and null ids need no rule; further columns of
the input, whatever their names, aren't read; an empty table gives no rows; without any base span the
field adds nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, input_rows, materialize

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ADDRESS = re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}")
CANDIDATE = re.compile(r"[+(]{0,2}[0-9][0-9().+-]*+(?: \(?[0-9][0-9().+-]*+)*+")
EDGE = re.compile(r"[0-9@]")
EDGES = ("chain", "skip", "like")
CONTEXTS = "shape string, around string, label int, n double"
SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the pattern, sought from each @, so that no run is read twice."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        end = DOMAIN.match(text, at + 1) if start < at else None
        free = end.end() if end else at + 1
        if end:
            yield start, end.end()
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if EDGE.search(text) is None:
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, shape, key) of candidate tokens, in order; equal keys are repeats."""
    out = []
    if "@" in text:
        at = text.find("@")
        while at >= 0:
            start = at
            while start > 0 and text[start - 1] in LOCAL:
                start -= 1
            m = LOCAL_END.match(text, at + 1)
            end = m.end() if m else at + 1
            while end > at + 1 and text[end - 1] in ".%+-_":
                end -= 1
            if start < at:
                domain = text[at + 1 : end]
                out.append((start, end, f"@{min(domain.count('.'), 2)}{'x' if domain else ''}", "@" + text[start:at].lower()))
            at = text.find("@", at + 1)
    for m in CANDIDATE.finditer(text):
        token = m[0].rstrip("().+-")
        digits = "".join(c for c in token if c.isdigit())
        if len(digits) < 5:
            continue
        n, dots = len(digits), token.count(".")
        plus, bracket, dash, gap = "+" in token, "(" in token, "-" in token, " " in token
        size = "s" if n < 9 else "p" if n < 12 else "c" if n < 20 else "l"
        valid = size == "c" and luhn(digits)
        key = token if ADDRESS.fullmatch(token) else digits[-9:] if 9 <= n <= 15 else digits
        out.append((m.start(), m.start() + len(token), f"{size}{int(plus)}{int(bracket)}{int(dash)}{int(gap)}{min(dots, 4)}{int(valid)}", key))
    out.sort()
    return out


def labelled(found: list[tuple[int, int, str, str]], spans: list[tuple[int, int, int]]) -> list[int]:
    """Label of each candidate: the kind of the first base span that overlaps it, else 0."""
    labels, i = [], 0
    for start, end, _, _ in found:
        while i < len(spans) and max(s[2] for s in spans[i : i + 1]) <= start:
            i += 1
        j, label = i, 0
        while j < len(spans) and spans[j][0] < end and not label:
            label = spans[j][1] + 1 if spans[j][2] > start else 0
            j += 1
        labels.append(label)
    return labels


def alike(key: str) -> str:
    """What similar keys have in common: the letters of a local part, the last digits of a number."""
    if key.startswith("@"):
        return "@" + "".join(c for c in key.split("+")[0] if c.isalpha())
    return key[-7:] if key.isdigit() else key


def links(found: list[tuple[int, int, str, str]], labels: list[int], near: int = 40) -> list[list[tuple[int, int]]]:
    """Chain edges between close neighbours; skip edges from hubs to their repeats (hubs: the first
    labelled mention of each kind, or the first mention where none is labelled); edges of the same
    form between mentions that are only similar."""
    out = [[(i, i + 1) for i in range(len(found) - 1) if found[i + 1][0] - found[i][1] <= near]]
    for name in (lambda k: k, alike):
        hubs: dict[str, dict[int, int]] = {}
        for i, (f, label) in enumerate(zip(found, labels, strict=True)):
            hubs.setdefault(name(f[3]), {}).setdefault(label, i)
        edges = []
        for i, f in enumerate(found):
            of = hubs[name(f[3])]
            edges += [(h, i) for label, h in of.items() if h != i and (label or len(of) == 1)]
        out.append(edges)
    out[2] = [(a, b) for a, b in out[2] if found[a][3] != found[b][3]]
    return out


def count_contexts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """How often a candidate of a shape has a label, with so many neighbours of each edge and label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def written() -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([k[i] for k in n], t) for i, t in enumerate(kinds)] + [pa.array([float(v) for v in n.values()])], names=["shape", "around", "label", "n"])

        for batch in batches:
            for text in batch.column(1):
                text = text.as_py() or ""
                found = candidates(text) if EDGE.search(text) else []
                if not found:
                    continue
                labels = labelled(found, base_spans(text))
                known = {f[3] for f, label in zip(found, labels, strict=True) if label}
                sure = [bool(label) or f[3] not in known for f, label in zip(found, labels, strict=True)]
                around: list[Counter] = [Counter() for _ in found]
                for kind, edges in enumerate(links(found, labels)):
                    for a, b in edges:
                        if sure[a] and sure[b]:
                            around[a][5 * kind + labels[b]] += 1
                            around[b][5 * kind + labels[a]] += 1
                for f, label, near, s in zip(found, labels, around, sure, strict=True):
                    if s:
                        n[f[2], " ".join(f"{k}:{v}" for k, v in sorted(near.items())), label] += 1
                if len(n) > 50_000:
                    yield written()
                    n.clear()
        if n:
            yield written()

    texts = input_rows(docs, id_col, text_col).select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return texts.mapInArrow(count, CONTEXTS).groupBy("shape", "around", "label").agg(F.sum("n").alias("n"))


def start_weights() -> dict:
    """Prior means: most candidates are nothing, and repeats agree."""
    eye = np.eye(5)
    return {"": np.array([3.0, 0, 0, 0, 0]), "chain": np.zeros((5, 5)), "skip": 4 * eye, "like": 1.5 * eye}


def gradient(model: dict, rows: list[tuple[str, str, int, float]]) -> dict[tuple[str, int], list[float]]:
    """(weight, place) -> sums of first and second derivatives of the log pseudo-likelihood."""
    pair = np.concatenate([model[k] for k in EDGES])
    near = np.zeros((len(rows), 15))
    for i, (_, around, _, _) in enumerate(rows):
        for x in around.split():
            k, v = x.split(":")
            near[i, int(k)] = int(v)
    unary = np.stack([model[""] + model.get(f"node {r[0]}", 0) for r in rows])
    z = unary + near @ pair
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    n = np.array([r[3] for r in rows])[:, None]
    first, second = n * (np.eye(5)[[r[2] for r in rows]] - p), n * p * (1 - p)
    out: dict[tuple[str, int], list[float]] = {}

    def put(name: str, g: np.ndarray, h: np.ndarray) -> None:
        for i, (x, y) in enumerate(zip(g.ravel(), h.ravel(), strict=True)):
            held = out.setdefault((name, i), [0.0, 0.0])
            held[0] += float(x)
            held[1] += float(y)

    put("", first.sum(0), second.sum(0))
    for i, k in enumerate(EDGES):
        some = near[:, 5 * i : 5 * i + 5]
        put(k, some.T @ first, (some * some).T @ second)
    shapes: dict[str, list[int]] = {}
    for i, r in enumerate(rows):
        shapes.setdefault(f"node {r[0]}", []).append(i)
    for name, at in shapes.items():
        put(name, first[at].sum(0), second[at].sum(0))
    return out


def train(contexts: DataFrame, rounds: int, prior: float = 1.0, step: float = 0.5) -> dict:
    """Weights after Newton steps on sums over all partitions of ``contexts``."""
    model, mean = start_weights(), start_weights()
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
                if rows:
                    g = gradient(model, rows)
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in g]), pa.array([k[1] for k in g], pa.int32()), pa.array([v[0] for v in g.values()]), pa.array([v[1] for v in g.values()])], names=["w", "i", "g", "h"])

        total = contexts.mapInArrow(sums, "w string, i int, g double, h double").groupBy("w", "i").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        g: dict[str, np.ndarray] = {}
        for r in total.collect():  # one row per weight
            g.setdefault(r["w"], np.zeros((2, 25 if r["w"] in EDGES else 5)))[:, r["i"]] = r["g"], r["h"]
        model = dict(model)
        for name, (first, second) in g.items():
            own = model.get(name, np.zeros(5))
            if name in EDGES:  # an edge is the same from both ends
                first, second = (x.reshape(5, 5) + x.reshape(5, 5).T for x in (first, second))
            model[name] = own + step * (first - prior * (own - mean.get(name, 0))) / (second + prior)
    return model


def marginals(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray, damp: float = 0.3, settled: float = 1e-4) -> np.ndarray:
    """Loopy sum-product over edges (a, b) with log potentials pair[edge], until messages settle;
    damping grows once a message could have crossed every edge, so loops that swing come to rest."""
    if not len(edges):
        m = np.exp(unary - unary.max(1, keepdims=True))
        return m / m.sum(1, keepdims=True)
    a, b = edges[:, 0], edges[:, 1]
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    psi = np.concatenate([pair, pair.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    message = np.zeros((len(src), unary.shape[1]))
    change, i = np.inf, 0
    while change > settled:
        i += 1
        keep = 1 - (1 - damp) * min(1.0, (100 + len(src)) / i) ** 2
        belief = unary.copy()
        np.add.at(belief, dst, message)
        out = (belief[src] - message[back])[:, :, None] + psi
        top = out.max(1)
        new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
        step = (1 - keep) * (new - new.max(1, keepdims=True) - message)
        message = message + step
        change = np.abs(step).max()
    belief = unary.copy()
    np.add.at(belief, dst, message)
    m = np.exp(belief - belief.max(1, keepdims=True))
    return m / m.sum(1, keepdims=True)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_pii(docs: DataFrame, sure: float = 0.8, rounds: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, base and spans (kind:start:end, by start and kind)."""
    bound_batches(docs.sparkSession)
    contexts = materialize(count_contexts(docs, id_col, text_col), "contexts")
    able = not contexts.where("label > 0").isEmpty()  # without a base span there is nothing to learn from
    model = train(contexts, rounds) if able else start_weights()

    def added(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        found = candidates(text)
        labels = labelled(found, base)
        if not found or all(labels):
            return []
        kinds = links(found, labels)
        unary = np.stack([model[""] + model.get(f"node {f[2]}", 0) for f in found])
        for i, label in enumerate(labels):
            if label:  # base spans stay
                unary[i] = np.where(np.arange(5) == label, 0.0, -1e6)
        edges = np.array(sum(kinds, []), np.int64).reshape(-1, 2)
        pair = np.concatenate([np.broadcast_to(model[k], (len(e), 5, 5)) for k, e in zip(EDGES, kinds, strict=True)])
        p = marginals(unary, edges, pair)
        best = p[:, 1:].argmax(1) + 1
        return [(f[0], int(k) - 1, f[1]) for f, label, k, row in zip(found, labels, best, p, strict=True) if not label and row[k] >= sure]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, rows = batch.slice(at, 1000), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    text = text.as_py() or ""
                    base = base_spans(text)
                    more = added(text, base) if able and EDGE.search(text) else []
                    n = Counter(k for _, k, _ in base)
                    rows.append((doc, n[0], n[1], n[2], n[3], written(base), written(sorted(base + more)), len(more)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SPANS.split(", ")])

    return input_rows(docs, id_col, text_col).select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(scan, SPANS)
