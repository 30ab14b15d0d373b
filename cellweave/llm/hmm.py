"""Operator 5: a hidden Markov language model.

Words fall into classes: the ``single`` most frequent training words are classes of their own, the
rest are dealt by hash into ``buckets``; the end of a text is class 0.  A hidden chain of
``states`` states emits classes, and a class emits its words in proportion to their training
counts (plus a half each, and a half for all unknown words).  Baum-Welch: each partition of the
training documents adds up its expected transitions and emissions, the sums over partitions give
the next model.  A start model comes from ``start_docs`` training documents (smallest hashes),
clustered by their words; ``rounds`` rounds over all training documents follow.  Scores are exact:
the scaled forward recursion over the whole text.

Word counts cover all training documents and stay distributed.  Only the most frequent words (with
counts; those above the lowest power of two that leaves at most ``hot``), one row per bucket and the model itself come to the driver and go to the
tasks; the remaining words of a text meet their counts in a join, where no word is frequent.
Texts become class numbers once, in a written table that all rounds reread.

Defined cases: a null or empty text is the end token alone; a null id counts as training; without
training documents every count is 0 and classes are uniform; very long texts are one sequence, in training
(their forward variables are kept in parts) as in scoring; repeated rows are documents of their own;
further columns of the input, whatever their names, aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, bound_batches, digest, input_rows, materialize

ENCODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inner double, classes binary, words array<string>, times array<long>"


class Batch:
    """Sequences side by side, longest first, their tokens in order of time."""

    def __init__(self, sequences: list[np.ndarray]):
        n = np.array([len(s) for s in sequences])
        self.order = np.argsort(-n, kind="stable")
        n = n[self.order]
        self.active = np.searchsorted(-n, -np.arange(n[0]), side="left") if len(n) else np.zeros(0, int)
        self.offset = np.concatenate([[0], np.cumsum(self.active)])
        self.which = np.repeat(np.arange(len(n)), n)
        when = np.arange(len(self.which)) - np.repeat(np.cumsum(n) - n, n)
        self.at = self.offset[when] + self.which
        self.tokens = np.empty(len(self.which), np.int64)
        self.tokens[self.at] = np.concatenate([sequences[i] for i in self.order])

    def forward(self, model: dict, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Scale of each token, and the scaled forward variables if wanted."""
        move, emit = model["move"], np.ascontiguousarray(model["emit"].T)
        scale = np.empty(len(self.tokens))
        alphas = np.empty((len(self.tokens), len(move))) if keep else None
        alpha = None
        for t, m in enumerate(self.active):
            a, b = self.offset[t], self.offset[t + 1]
            alpha = (model["start"] if alpha is None else alpha[:m] @ move) * emit[self.tokens[a:b]]
            total = alpha.sum(1)
            alpha /= total[:, None]
            scale[a:b] = total
            if keep:
                alphas[a:b] = alpha
        return scale, alphas

    def log10(self, model: dict) -> np.ndarray:
        """log10 probability of each sequence, in the order given."""
        scale, _ = self.forward(model)
        out = np.empty(len(self.order))
        out[self.order] = np.bincount(self.which, weights=np.log10(scale)[self.at], minlength=len(self.order))
        return out

    def expect(self, model: dict) -> dict:
        """Expected starts, transitions and emissions."""
        scale, alphas = self.forward(model, keep=True)
        move, emit = model["move"], np.ascontiguousarray(model["emit"].T)
        beta, ahead = np.ones_like(alphas), np.empty_like(alphas)
        for t in range(len(self.active) - 2, -1, -1):
            m = self.active[t + 1]
            a, b = self.offset[t], self.offset[t + 1]
            ahead[b : b + m] = emit[self.tokens[b : b + m]] * beta[b : b + m] / scale[b : b + m, None]
            beta[a : a + m] = ahead[b : b + m] @ move.T
        later = np.arange(self.active[0], len(self.tokens))
        before = later - np.repeat(self.active[:-1], self.active[1:])
        gamma = alphas * beta
        emitted = np.stack([np.bincount(self.tokens, weights=g, minlength=emit.shape[0]) for g in gamma.T])
        return {"start": gamma[: self.active[0]].sum(0), "move": move * (alphas[before].T @ ahead[later]), "emit": emitted}


def expect_long(tokens: np.ndarray, model: dict, part: int) -> dict:
    """``Batch.expect`` of one sequence, whose forward variables are kept for a part at a time and
    computed again from where the part begins."""
    move, emit = model["move"], np.ascontiguousarray(model["emit"].T)
    parts = np.array_split(tokens, -(-len(tokens) // part))

    def forward(some: np.ndarray, alpha: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        alphas, scale = np.empty((len(some), len(move))), np.empty(len(some))
        for t, k in enumerate(some):
            alpha = (model["start"] if alpha is None else alpha @ move) * emit[k]
            scale[t] = alpha.sum()
            alphas[t] = alpha = alpha / scale[t]
        return alphas, scale

    heads: list = [None]
    for some in parts[:-1]:
        heads.append(forward(some, heads[-1])[0][-1])
    counts = {"start": np.zeros(len(move)), "move": np.zeros_like(move), "emit": np.zeros_like(model["emit"])}
    later = None  # the next part's first token as seen from before it
    for i in range(len(parts) - 1, -1, -1):
        some = parts[i]
        alphas, scale = forward(some, heads[i])
        beta, ahead = np.ones_like(alphas), np.empty_like(alphas)
        if later is not None:
            beta[-1] = move @ later
            counts["move"] += move * np.outer(alphas[-1], later)
        for t in range(len(some) - 1, -1, -1):
            ahead[t] = emit[some[t]] * beta[t] / scale[t]
            if t:
                beta[t - 1] = move @ ahead[t]
        counts["move"] += move * (alphas[:-1].T @ ahead[1:])
        gamma, later = alphas * beta, ahead[0]
        counts["emit"] += np.stack([np.bincount(some, weights=g, minlength=emit.shape[0]) for g in gamma.T])
        if i == 0:
            counts["start"] += gamma[0]
    return counts


def expected(sequences: list[np.ndarray], model: dict, part: int = 100_000) -> dict:
    """Expected counts of sequences, whole, whatever their length."""
    total = None
    short = [s for s in sequences if len(s) <= part]
    if short:
        total = Batch(short).expect(model)
    for s in sequences:
        if len(s) > part:
            total = add(total, expect_long(s, model, part))
    return total


def batches_of(sequences: Iterator, tokens: int) -> Iterator[list]:
    """Lists of sequences of about ``tokens`` tokens."""
    held, n = [], 0
    for s in sequences:
        held.append(s)
        n += len(s)
        if n >= tokens:
            yield held
            held, n = [], 0
    if held:
        yield held


def estimate(counts: dict, common: np.ndarray, weight: float = 50.0) -> dict:
    """Model from expected counts, smoothed towards the class frequencies ``common``."""
    start, move = counts["start"] + 0.5, counts["move"] + 0.5
    emit = counts["emit"] + weight * common
    return {"start": start / start.sum(), "move": move / move.sum(1, keepdims=True), "emit": emit / emit.sum(1, keepdims=True)}


def first_model(sequences: list[np.ndarray], common: np.ndarray, states: int, rounds: int, seed: int) -> dict:
    """Start model: documents clustered by their classes, then Baum-Welch on them alone."""
    rng = np.random.default_rng(seed)
    if not sequences:
        return estimate({"start": np.ones(states), "move": np.ones((states, states)), "emit": np.ones((states, len(common)))}, common)
    counts = np.stack([np.bincount(s, minlength=len(common)) for s in sequences]).astype(float)
    x = np.log1p(counts) * -np.log(common)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres = x[rng.choice(len(x), states, replace=len(x) < states)]
    for _ in range(10):
        own = (x @ centres.T).argmax(1)
        for k in range(states):
            if (own == k).any():
                centres[k] = x[own == k].sum(0) / np.linalg.norm(x[own == k].sum(0))
    emit = np.stack([counts[own == k].sum(0) for k in range(states)]) * np.exp(0.2 * rng.standard_normal((states, len(common))))
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    model = estimate({"start": np.bincount(own, minlength=states).astype(float), "move": 100 * move, "emit": emit}, common)
    for _ in range(rounds):
        total = None
        for part in batches_of(iter(sequences), 200_000):
            total = add(total, expected(part, model))
        model = estimate(total, common)
    return model


def add(a: dict | None, b: dict) -> dict:
    return b if a is None else {k: a[k] + b[k] for k in a}


class HiddenMarkov:
    def __init__(self, docs: DataFrame, states: int = 8, single: int = 4096, buckets: int = 512, hot: int = 200_000, start_docs: int = 500, start_rounds: int = 10, rounds: int = 2, seed: int = 11, id_col: str = "doc_id", text_col: str = "text"):
        self.shape = (states, 1 + single + buckets)
        self.single, self.buckets = single, buckets
        bound_batches(docs.sparkSession)
        self.docs = input_rows(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.docs = self.docs.select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False)).alias("held_out"))
        self.count_words(hot)
        self.encode()
        self.train(start_docs, start_rounds, rounds, seed)

    def count_words(self, hot: int) -> None:
        train = self.docs.where("not held_out")
        words = train.select(F.explode(F.split(ascii_lower(F.col("text")), f"{SPACE}+")).alias("word")).where("word <> ''")
        self.counts = materialize(words.groupBy("word").agg(F.count(F.lit(1)).alias("c")), "word_counts")
        self.n_train = train.count()
        total = self.counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
        self.n, self.v = total[0] + self.n_train, total[1] + (self.n_train > 0)
        # the lowest power of two such that at most ``hot`` words occur so often: one row of counts
        steps = [1 << i for i in range(62)]
        above = self.counts.agg(*[F.count_if(F.col("c") >= x).alias(f"n{i}") for i, x in enumerate(steps)]).first()
        least = next((x for x, n in zip(steps, above, strict=True) if n <= hot), 1 << 62)
        top = sorted(self.counts.where(F.col("c") >= least).collect(), key=lambda r: (-r["c"], r["word"].encode()))
        self.hot = [(r["word"].encode(), r["c"]) for r in top]
        # what the buckets hold: all words after the single ones in that order
        rest = self.counts
        if top:
            last = top[min(self.single, len(top)) - 1]
            rest = rest.where((F.col("c") < last["c"]) | ((F.col("c") == last["c"]) & (F.col("word") > last["word"])))
        self.mass, self.kinds = np.zeros(self.buckets), np.zeros(self.buckets)
        for r in rest.groupBy((F.crc32(F.col("word").cast("binary")) % self.buckets).alias("b")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
            self.mass[r["b"]], self.kinds[r["b"]] = r["c"], r["v"]
        singles = np.zeros(self.single)
        singles[: min(self.single, len(self.hot))] = [c for _, c in self.hot[: self.single]]
        common = np.concatenate([[self.n_train], singles, self.mass]) + 0.5
        self.common = common / common.sum()

    def encode(self) -> None:
        """Texts as class numbers, sums over frequent words, and the other words by document."""
        hot, single, buckets = self.hot, self.single, self.buckets
        unit = np.log10(self.n + 0.5 * (self.v + 1))
        within = np.log10(self.mass + 0.5 * (self.kinds + 1))
        end = float(np.log10(self.n_train + 0.5) - unit)
        known_end = int(self.n_train > 0)

        def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place = {w: i for i, (w, _) in enumerate(hot)}
            log = np.log10(np.array([c for _, c in hot], float) + 0.5)
            own = np.array([i + 1 if i < single else 1 + single + zlib.crc32(w) % buckets for i, (w, _) in enumerate(hot)], np.int64)
            inner = np.array([0.0 if i < single else log[i] - within[own[i] - 1 - single] for i in range(len(hot))])
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part, rows = batch.slice(at, 500), []
                    for doc, text, held in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        words = (text or "").encode().lower().split()
                        i = np.array([place.get(w, -1) for w in words], np.int64)
                        other = [words[j] for j in np.flatnonzero(i < 0)]
                        classes = np.zeros(len(words) + 1, np.uint16)
                        classes[:-1][i >= 0] = own[i[i >= 0]]
                        classes[:-1][i < 0] = [1 + single + zlib.crc32(w) % buckets for w in other]
                        seen = i[i >= 0]
                        tail = Counter(other)
                        rows.append((doc, held, len(words) + 1, len(seen) + known_end, float(log[seen].sum() - unit * len(seen)) + end, float(inner[seen].sum()), classes.tobytes(), [w.decode() for w in tail], list(tail.values())))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in ENCODED.split(", ")])

        made = self.docs.select("doc_id", "text", "held_out").mapInArrow(numbers, ENCODED)
        self.encoded = materialize(made.withColumn("row", F.monotonically_increasing_id()), "encoded")
        self.unit, self.within = float(unit), within

    def train(self, start_docs: int, start_rounds: int, rounds: int, seed: int) -> None:
        training = self.encoded.where("not held_out")
        start = training.select("classes", "row").orderBy(digest("row", F.lit(seed)), "row").limit(start_docs).collect()
        sequences = [np.frombuffer(r["classes"], np.uint16).astype(np.int64) for r in start]
        self.model = first_model(sequences, self.common, self.shape[0], start_rounds, seed)
        s, c = self.shape
        for _ in range(rounds):
            model = self.model

            def expect(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
                total = None
                read = (np.frombuffer(x.as_py(), np.uint16).astype(np.int64) for b in batches for x in b.column(0))
                for part in batches_of(read, 200_000):
                    total = add(total, expected(part, model))
                if total:
                    flat = np.concatenate([total[k].ravel() for k in ("start", "move", "emit")])
                    for at in range(0, len(flat), 8192):
                        some = flat[at : at + 8192]
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(some))), pa.array(some)], names=["i", "n"])

            sums = training.select("classes").mapInArrow(expect, "i long, n double").groupBy("i").agg(F.sum("n").alias("n"))
            flat = np.zeros(s + s * s + s * c)
            for r in sums.collect():  # one row per parameter
                flat[r["i"]] = r["n"]
            if flat.any():
                self.model = estimate({"start": flat[:s], "move": flat[s : s + s * s].reshape(s, s), "emit": flat[s + s * s :].reshape(s, c)}, self.common)

    def score(self) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
        model = self.model

        def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = iter(zip(b.column(0).to_pylist(), b.column(1), strict=True))
                done = 0
                for part in batches_of((np.frombuffer(x.as_py(), np.uint16).astype(np.int64) for _, x in rows), 400_000):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(part)), pa.array(Batch(part).log10(model))], names=["row", "chain"])
                    done += len(part)

        chain = self.encoded.select("row", "classes").mapInArrow(forward, "row long, chain double")
        tail = self.encoded.where(F.size("words") > 0).select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
        c = F.coalesce("c", F.lit(0))
        log = F.log10(c + F.lit(0.5))
        inner = F.element_at(F.array(*[F.lit(float(w)) for w in self.within]), (F.crc32(F.col("word").cast("binary")) % self.buckets + 1).cast("int"))
        sums = tail.join(self.counts, "word", "left").groupBy("row").agg(F.sum(F.col("times") * (log - self.unit)).alias("more_base"), F.sum(F.col("times") * (log - inner)).alias("more_inner"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"))
        rows = self.encoded.drop("classes", "words", "times").join(chain, "row").join(sums, "row", "left")
        zero = lambda name: F.coalesce(F.col(name), F.lit(0))
        return rows.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("more_known")).cast("long").alias("n_known"), F.lit(self.n).cast("long").alias("train_tokens"), (F.col("base_score") + zero("more_base")).alias("base_score"), (F.col("chain") + F.col("inner") + zero("more_inner")).alias("score"))
