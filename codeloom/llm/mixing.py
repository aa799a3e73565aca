"""Mixing sources to target weights.

1. A Bernoulli naive Bayes classifier over hashed token ids, fitted on a bounded hash sample of the labelled documents,
   gives every document posteriors over the listed sources from its text alone (its soft membership).
2. Distributed projected gradient fits a rate in [0, max_repeats] for each document: least squares on the token totals
   by label and on the expected token totals by posterior, both against the targets. A round is one pass that sums what
   the step needs (the totals and, over the documents that are free to move, how the totals answer to a step) and one that
   sums the totals of a few step lengths, of which the best is taken; a plain gradient step, short enough to descend, is
   among them, so the objective falls in each round. Rates are functions of the few steps so far: no state per document.
3. Rates become whole numbers of uses by a hash of the document, with one shift per source for texts that are large
   against its target and one for the rest, found from histograms of bounded size, so that the source meets its target.
   The large texts are decided first; the rates of the rest then go on from where they are, against what is left.
   A text of more tokens than its source's whole target is used, once, only if the rest of the source can't reach the
   target and it comes nearer with it.

The total is the largest at which every listed source can reach its share within its repeats, unless one is given.
Sources that aren't listed, and null sources, get no use. A listed source without tokens can't contribute; the total
is then that of the others and the report shows a share of 0. Null and empty texts have no tokens and get no use. Rows
with one doc_id are one document, that with the most tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm import bpe
from codeloom.session import cut, spread

#: Features of the classifier: token ids modulo this.
FEATURES = 4096
#: Labelled documents the classifier is fitted on, at most about so many.
SAMPLE = 10_000
BINS = 1 << 14
#: The evidence of a text is divided by a root of its features over this, from 1 to the second, as they aren't independent.
TEMPER = (3.0, 5.0)
#: Lengths of the scaled step that a round tries.
STEPS = (1.0, 0.5, 0.25, 0.1)
#: The objective, relative to the square of the total, at which the fit ends.
GOOD = 1e-7


FINE, COARSE, OVER = range(3)


@dataclass(frozen=True)
class Classifier:
    sources: list[str]
    weights: np.ndarray  # (FEATURES, sources): what the presence of a feature adds over its absence
    prior: np.ndarray
    absent: np.ndarray  # log-likelihoods of a text without any feature


def _fraction(key: str) -> Column:
    """A uniform number in [0, 1) from the key."""
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def fit(docs: DataFrame, sources: list[str], path: str, sample: int = SAMPLE) -> Classifier:
    """Counts per source and feature, summed where the sampled documents are; at most sources x FEATURES numbers return."""
    labelled = docs.where(F.col("source").isin(sources) & F.col("text").isNotNull())
    n = labelled.count()
    chosen = labelled.where(_fraction("doc_id") < min(1.0, sample / max(n, 1))).select("source", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe._counter(path)
        place = {s: i for i, s in enumerate(sources)}
        counts = np.zeros((len(sources), FEATURES), dtype=np.int64)
        rows = np.zeros(len(sources), dtype=np.int64)
        for batch in batches:
            for s, t in zip(batch.column("source").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array(encoder.encode_ordinary(t), dtype=np.int64)
                rows[place[s]] += 1
                # Presence, so that one long text doesn't speak for its source.
                counts[place[s], np.unique(ids % FEATURES)] += 1
        i, f = np.nonzero(counts)
        i, f, c = (np.concatenate(x) for x in ((i, np.arange(len(sources))), (f, np.full(len(sources), -1)), (counts[i, f], rows)))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(f, pa.int32()), pa.array(c, pa.int64())], names=["s", "f", "n"])

    table = chosen.mapInArrow(run, "s int, f int, n bigint").groupBy("s", "f").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(sources), FEATURES))
    rows = np.zeros(len(sources))
    own = table[table.f >= 0]
    counts[own.s, own.f] = own.n
    rows[table[table.f < 0].s] = table[table.f < 0].n
    # Smoothed towards how frequent a feature is at all, so that a source of few documents isn't held to have every other.
    overall = (counts.sum(axis=0) + 0.5) / (rows.sum() + 1.0)
    present = (counts + overall) / (rows[:, None] + 1.0)
    absent = np.log1p(-present)
    return Classifier(sources, (np.log(present) - absent).T, np.log((rows + 1) / (rows.sum() + len(sources))), absent.sum(axis=1))


def memberships(docs: DataFrame, model: Classifier, path: str) -> DataFrame:
    """(doc_id, source, n_tokens, q): posteriors over model.sources, in their order."""
    rows = docs.select("doc_id", "source", "text")
    key_type = docs.schema["doc_id"].dataType
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)  # FEATURES x sources numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe._counter(path)
        model = shared.value
        for batch in batches:
            sizes, posteriors = [], []
            for t in batch.column("text").to_pylist():
                ids = np.array(encoder.encode_ordinary(t), dtype=np.int64) if t else np.empty(0, np.int64)
                sizes.append(len(ids))
                posteriors.append(posterior(ids, model))
            q = pa.array(posteriors, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(sizes, pa.int64()), q], names=["doc_id", "source", "n_tokens", "q"])

    return rows.mapInArrow(run, f"doc_id {key_type.simpleString()}, source string, n_tokens bigint, q array<double>")


def posterior(ids: np.ndarray, model: Classifier) -> np.ndarray:
    seen = np.unique(ids % FEATURES)
    temper = min(TEMPER[1], max(1.0, len(seen) ** 0.5 / TEMPER[0]))
    score = model.prior + (model.absent + model.weights[seen].sum(axis=0)) / temper
    p = np.exp(score - score.max())
    return p / p.sum()


@dataclass(frozen=True)
class Step:
    """Rates move by -length x (towards[label] + posteriors . towards[after the labels]), for a plain step divided by the
    document's curvature, and are projected to [0, cap]."""

    towards: np.ndarray
    length: float = 1.0
    plain: bool = False


@dataclass(frozen=True)
class Fit:
    """history: the objective after each round, relative to the square of the total; expected: the shares expected by
    posterior at its end."""

    sources: list[str]
    targets: np.ndarray
    caps: np.ndarray
    total: float
    start: np.ndarray
    tokens: np.ndarray  # by label, then by posterior
    steps: list[Step]
    history: list[float]
    expected: np.ndarray


def rates(fitted: Fit, place: np.ndarray, q: np.ndarray, steps: Sequence[Step] | None = None) -> np.ndarray:
    """The rates of documents by place of their label (from 0) and posteriors."""
    n = len(fitted.sources)
    cap = fitted.caps[place]
    out = np.minimum(fitted.start[place], cap)
    for step in fitted.steps if steps is None else steps:
        move = step.towards[:n][place] + q @ step.towards[n:]
        if step.plain:
            move = move / np.maximum(fitted.tokens[:n][place] + q @ fitted.tokens[n:], 1.0)
        out = np.clip(out - step.length * move, 0.0, cap)
    return out


def _columns(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place from 0, tokens, posteriors) of a batch of listed documents."""
    q = batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
    return batch.column("place").to_numpy() - 1, batch.column("n_tokens").to_numpy().astype(float), q


def _summed(listed: DataFrame, n: int, size: int, of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all documents of a vector of `size` numbers that `of` gives for a batch: one row per task returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(*_columns(batch, n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["i", "x"])

    rows = listed.select("place", "n_tokens", "q").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r.i] = r.x
    return out


def _totals(fitted: Fit, place: np.ndarray, tokens: np.ndarray, q: np.ndarray, used: np.ndarray) -> np.ndarray:
    n = len(fitted.sources)
    return np.concatenate([np.bincount(place, used * tokens, n), (used * tokens) @ q])


def fit_rates(members: DataFrame, targets: list[tuple[str, float, int]], total: float | None = None, iterations: int = 6) -> Fit:
    """Projected gradient; members is (doc_id, source, n_tokens, q)."""
    sources = [s for s, _, _ in targets]
    n = len(sources)
    share = np.array([t for _, t, _ in targets], dtype=float)
    caps = np.array([m for _, _, m in targets], dtype=float)
    empty = Fit(sources, share * 0, caps, 0.0, share * 0, np.zeros(2 * n), [], [], share * 0)
    if not n:
        return empty
    listed = _listed(members, sources)
    tokens = _summed(listed, n, 2 * n, lambda place, size, q: np.concatenate([np.bincount(place, size, n), size @ q]))
    have = tokens[:n]
    usable = (have > 0) & (share > 0) & (caps > 0)
    if not usable.any():
        return empty
    most = float(np.min(have[usable] * caps[usable] / share[usable])) * float(share[usable].sum())
    total = most if total is None else min(total, most)
    goal = np.where(usable, share, 0.0) / share[usable].sum() * total
    start = np.array([min(c, g / h) if h else 0.0 for c, g, h in zip(caps, goal, have)])
    fitted = Fit(sources, goal, caps, total, start, tokens, [], [], share * 0)
    steps, history, reached = descend(listed, fitted, np.zeros(2 * n), iterations)
    return replace(fitted, steps=steps, history=history, expected=reached[n:] / max(reached[n:].sum(), 1e-9))


def descend(listed: DataFrame, fitted: Fit, fixed: np.ndarray, iterations: int = 6) -> tuple[list[Step], list[float], np.ndarray]:
    """(steps, history, totals): the fit's steps and those that bring the totals of `listed`, beside `fixed` totals by label
    and by posterior, nearer to the targets."""
    n = len(fitted.sources)
    size = 2 * n
    both = np.concatenate([fitted.targets, fitted.targets])
    objective = lambda reached: float(((reached - both) ** 2).sum()) / fitted.total**2
    steps, history = list(fitted.steps), []
    reached = fixed
    for _ in range(iterations):

        def moments(place: np.ndarray, tokens: np.ndarray, q: np.ndarray) -> np.ndarray:
            """The totals and what documents that can still move answer to a step."""
            used = rates(fitted, place, q, steps)
            sums = _totals(fitted, place, tokens, q, used)
            free = (used > 0) & (used < fitted.caps[place])
            rows = np.concatenate([np.eye(n)[place], q], axis=1)[free]
            return np.concatenate([sums, ((rows * tokens[free, None]).T @ rows).ravel()])

        got = _summed(listed, n, size + size * size, moments)
        reached, answer = got[:size] + fixed, got[size:].reshape(size, size)
        if not history:
            history.append(objective(reached))
        if history[-1] < GOOD:
            break
        gap = reached - both
        answer = answer + np.eye(size) * max(1e-3 * np.trace(answer) / size, 1.0)
        scaled = np.linalg.solve(answer, gap)
        tries = [*(Step(scaled, x) for x in STEPS), Step(gap, 1.0, True)]

        def attempts(place: np.ndarray, tokens: np.ndarray, q: np.ndarray) -> np.ndarray:
            return np.concatenate([_totals(fitted, place, tokens, q, rates(fitted, place, q, [*steps, t])) for t in tries])

        ends = _summed(listed, n, size * len(tries), attempts).reshape(len(tries), size) + fixed
        best = min(range(len(tries)), key=lambda k: objective(ends[k]))
        if objective(ends[best]) >= history[-1] * (1 - 1e-6):
            break
        steps.append(tries[best])
        reached = ends[best]
        history.append(objective(reached))
    return steps, history, reached


def _listed(members: DataFrame, sources: list[str]) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source")).cast("int")
    return members.withColumn("place", place).where("place > 0 and n_tokens > 0")


def rated(members: DataFrame, fitted: Fit) -> DataFrame:
    """The listed documents with place, rate_ and cap_."""
    n = len(fitted.sources)
    listed = _listed(members, fitted.sources)
    schema = T.StructType([*listed.schema.fields, T.StructField("rate_", T.DoubleType()), T.StructField("cap_", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, _, q = _columns(batch, n) if batch.num_rows else (np.empty(0, int), None, np.empty((0, n)))
            new = [pa.array(rates(fitted, place, q)), pa.array(fitted.caps[place])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "rate_", "cap_"])

    return listed.mapInArrow(run, schema)


def draw(members: DataFrame, fitted: Fit) -> DataFrame:
    """(doc_id, source, n_tokens, uses, q): every document used at least once."""
    n = len(fitted.sources)
    key = members.schema["doc_id"].dataType.simpleString()
    if fitted.total <= 0:
        return members.sparkSession.createDataFrame([], f"doc_id {key}, source string, n_tokens bigint, uses int, q array<double>")
    at = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("place"))
    # Texts of more than a hundredth of their source's target are coarse: what they miss, the others make up for. One
    # that is more than the whole target is used last, if at all.
    size = F.when(F.col("n_tokens") > at(fitted.targets), OVER).when(F.col("n_tokens") * 100 > at(fitted.targets), COARSE).otherwise(FINE)
    rows = cut(rated(members, fitted).where(at(fitted.targets) > 0).withColumn("size_", size))

    def uses_of(group: DataFrame) -> DataFrame:
        # The k-th use of a document is won when the shift of its group passes k - rate - hash, binned over [-cap, cap].
        uses = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("cap_").cast("int"))), lambda k: F.struct(k.alias("k"), (k - F.col("rate_") - _fraction("doc_id")).alias("threshold")))
        out = group.withColumn("use", F.explode(uses)).select("doc_id", "source", "n_tokens", "q", "place", "rate_", "cap_", "use.*")
        bin_ = F.floor((F.col("threshold") + F.col("cap_") + 1) / (2 * F.col("cap_") + 2) * BINS)
        return out.withColumn("bin", F.least(F.lit(BINS - 1), F.greatest(F.lit(0), bin_)).cast("int"))

    def binned(won: DataFrame) -> Callable[[int], pd.DataFrame]:
        # At most sources x BINS rows.
        expected = F.sum(F.when(F.col("k") == 1, F.col("rate_") * F.col("n_tokens")))
        bins = won.groupBy("place", "bin").agg(F.sum("n_tokens").alias("n"), expected.alias("expected")).toPandas()
        return lambda i: bins[bins.place == i + 1].sort_values("bin")

    room = {r.place: r.n for r in rows.where(F.col("size_") == FINE).groupBy("place").agg(F.sum(F.col("n_tokens") * F.col("cap_")).alias("n")).collect()}
    coarse = uses_of(rows.where(F.col("size_") == COARSE))
    bins = binned(coarse)
    edges, got = [], np.zeros(n)
    for i in range(n):
        goal, left = fitted.targets[i], room.get(i + 1, 0.0)
        want = max(min(bins(i).expected.sum(), goal), goal - left)
        edge, got[i] = _nearest(bins(i), want, goal if left > 0 else np.inf)
        edges.append(edge)
    taken = coarse.where(F.col("bin") <= at(edges))
    sums = taken.agg(*[F.coalesce(F.sum(F.col("n_tokens") * F.col("q")[i]), F.lit(0.0)).alias(f"q{i}") for i in range(n)]).first()
    fine = rows.where(F.col("size_") == FINE).drop("rate_", "cap_", "size_")
    steps, _, _ = descend(fine, fitted, np.concatenate([got, np.array(list(sums))]))
    fine = uses_of(rated(fine.drop("place"), replace(fitted, steps=steps)))
    bins = binned(fine)
    over = {r.place: r.least for r in rows.where(F.col("size_") == OVER).groupBy("place").agg(F.min(F.struct("n_tokens", "doc_id")).alias("least")).collect()}
    edges, last_resort = [], []
    for i in range(n):
        goal = fitted.targets[i]
        edge, more = _nearest(bins(i), goal - got[i], np.inf)
        edges.append(edge)
        missing = goal - got[i] - more
        if i + 1 in over and missing > 0 and abs(over[i + 1].n_tokens - missing) < missing:
            last_resort.append(over[i + 1].doc_id)
    won = taken.unionByName(fine.where(F.col("bin") <= at(edges)))
    kept = won.groupBy("doc_id", "source").agg(F.first("n_tokens").alias("n_tokens"), F.count(F.lit(1)).cast("int").alias("uses"), F.first("q").alias("q"))
    if last_resort:
        large = rows.where((F.col("size_") == OVER) & F.col("doc_id").isin(last_resort)).select("doc_id", "source", "n_tokens", F.lit(1).alias("uses"), "q")
        kept = kept.unionByName(large)
    return kept


def _nearest(bins, want: float, most: float) -> tuple[int, float]:
    """(last bin, tokens) of the run of bins from the first whose tokens come nearest to `want` without passing `most`."""
    reached = np.concatenate([[0.0], np.cumsum(bins.n.to_numpy(dtype=float))])
    last = np.concatenate([[-1], bins.bin.to_numpy()])
    miss = np.where(reached > most, np.inf, np.abs(reached - want))
    k = int(np.argmin(miss))
    return int(last[k]), float(reached[k])


def mixture(docs: DataFrame, targets: DataFrame, path: str | None = None, total: float | None = None) -> tuple[DataFrame, Fit]:
    """(draw, fit). targets: source, target_share, max_repeats; a few rows, a source named twice counts once."""
    vocab = path or bpe.vocabulary_path()
    listed = sorted({r.source: (r.source, float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.collect() if r.source is not None}.values())
    docs = spread(docs.select("doc_id", "source", "text"))
    model = fit(docs, [s for s, _, _ in listed], vocab)
    # Null ids are no documents that could be told apart, so they stay as they are.
    each = memberships(docs, model, vocab).groupBy(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("\0"), F.xxhash64("source", "n_tokens", "q"))).alias("i_"))
    members = cut(each.agg(F.max(F.struct("n_tokens", "source", "q", "doc_id")).alias("m")).select("m.doc_id", "m.source", "m.n_tokens", "m.q"))
    fitted = fit_rates(members, listed, total)
    return draw(members, fitted), fitted


def report(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per listed source: target_share, max_repeats, documents, most_uses, tokens, share and expected_share, the share
    of the tokens drawn that the posteriors expect to be of the source's kind."""
    named = sorted({r.source for r in targets.select("source").collect() if r.source is not None})
    used = F.col("n_tokens") * F.col("uses")
    by = drawn.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"), F.sum(used).alias("tokens"))
    sums = [F.coalesce(F.sum(used * F.col("q")[i]), F.lit(0.0)) for i in range(len(named))]
    whole = drawn.agg(F.sum(used).alias("all_"), F.map_from_arrays(F.array(*[F.lit(s) for s in named]), F.array(*sums)).alias("expected_"))
    rows = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).join(by, "source", "left").join(F.broadcast(whole))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    share = lambda c: F.coalesce(c / F.col("all_"), F.lit(0.0))
    expected = share(F.try_element_at("expected_", F.col("source")))
    return rows.select("source", "target_share", "max_repeats", zero("documents"), zero("most_uses"), zero("tokens"), share(F.col("tokens")).alias("share"), expected.alias("expected_share"))
