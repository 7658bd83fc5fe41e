"""Toxicity scores by weak supervision.

Voters are lexicon entries (a fixed seed list, and words or word beginnings that labelled training
rows show to be associated with the label) and patterns of writing. Each fires on a text or not. A
generative label model over all documents estimates how often each voter fires in either class by
expectation maximisation, and how voters fire together; a voter correlated with others counts for
less. Its posterior labels of all documents train a logistic regression on the votes; a slope and
an offset fit its logits to the labelled sample. The score is a function of the text alone.

Bounded parts, by parameter: ``sample_rows`` labelled rows (smallest md5 of their id) are read to
find lexicon entries, first rates and the final slope and offset, and at most ``max_voters`` voters
exist. Votes, rates, correlations and the regression cover all documents. A step of the estimation sends the driver sums
for voters and pairs of voters, never rows of documents.

Defined cases: a null or empty text has no votes and gets the score of a text without any; label
rows with a null id or label are ignored, several for one id count as their largest; without labels
the seed list and default rates serve; repeated rows are scored each; an empty table gives an empty
result; other input columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import materialise, narrow
from .words import mix, run_hash, slices, utf8, _table

# Fixed seed lexicon.
SEEDS = """
idiot idiots moron morons stupid dumb loser losers pathetic worthless disgusting scum trash clown
garbage filth vermin imbecile fool freak creep pig jerk coward hate kill
""".split()
PREFIXES = (4, 5, 6)
PATTERNS = 3  # shouting, exclamations, stretched letters
SEED = 21


def lexical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and hashes of all words (runs of ASCII letters and non-ASCII bytes) and of their
    beginnings of 4 to 6 characters."""
    letter = (data >= 0x80) | ((data >= 0x61) & (data <= 0x7A))
    start, end = letter.copy(), letter.copy()
    start[1:] &= ~letter[:-1]
    end[:-1] &= ~letter[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    start[inner] |= letter[inner]
    end[inner - 1] |= letter[inner - 1]
    begin, stop = np.flatnonzero(start), np.flatnonzero(end) + 1
    doc = np.searchsorted(offsets, begin, "right") - 1
    chars = np.flatnonzero((data & 0xC0) != 0x80)
    first = np.searchsorted(chars, begin)
    values = _table(SEED)[0][data]
    docs, begins, stops, kinds = [doc], [begin], [stop], [np.zeros(len(doc), np.uint64)]
    for n in PREFIXES:
        last = first + n
        cut = np.where(last < len(chars), chars[np.minimum(last, max(len(chars) - 1, 0))]
                       if len(chars) else 0, len(data))
        longer = cut < stop
        docs.append(doc[longer])
        begins.append(begin[longer])
        stops.append(cut[longer])
        kinds.append(np.full(int(longer.sum()), n, np.uint64))
    hashes = run_hash(values, np.concatenate(begins), np.concatenate(stops), SEED)
    return np.concatenate(docs), mix(hashes ^ np.concatenate(kinds))


def word_hash(word: str) -> int:
    data = np.frombuffer(word.lower().encode(), np.uint8)
    return int(lexical(data, np.array([0, len(data)]))[1][0])


def _lowered(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pc.utf8_lower(pc.fill_null(part.column("text"), "")))


def _labelled_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, toxic documents, clean documents), combined over each slice."""
    for batch in batches:
        for part in slices(batch, "text"):
            doc, entry = lexical(*_lowered(part))
            order = np.lexsort((doc, entry))
            doc, entry = doc[order], entry[order]
            if not len(entry):
                continue
            keep = np.r_[True, (entry[1:] != entry[:-1]) | (doc[1:] != doc[:-1])]
            doc, entry = doc[keep], entry[keep]
            toxic = part.column("toxic").to_numpy()[doc]
            begin = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]])
            pos = np.add.reduceat(toxic.astype(np.int64), begin)
            total = np.diff(np.r_[begin, len(entry)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(entry[begin].view(np.int64)), pa.array(pos), pa.array(total - pos)],
                names=["entry", "pos", "neg"])


def patterns(text: str | None) -> list[bool]:
    """Shouting, exclamations and stretched letters."""
    found = text or ""
    caps = sum(1 for w in found.split() if len(w) > 2 and w.isupper() and w.isalpha())
    return [caps >= 5, "!!" in found,
            any(c * 4 in found for c in "aeiou")]


def _votes(batches: Iterator[pa.RecordBatch], entries: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The sorted numbers of the voters that fire on each text; patterns come after the entries."""
    order = np.argsort(entries)
    known = entries[order]
    maybe = np.zeros(65536, dtype=bool)
    maybe[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
    for batch in batches:
        for part in slices(batch, "text"):
            doc, entry = lexical(*_lowered(part))
            some = np.flatnonzero(maybe[(entry & np.uint64(0xFFFF)).astype(np.int64)])
            doc, entry = doc[some], entry[some]
            at = np.minimum(np.searchsorted(known, entry), len(known) - 1)
            hit = known[at] == entry
            fired = [[] for _ in range(part.num_rows)]
            pairs = np.unique(np.stack([doc[hit], order[at[hit]]], axis=1), axis=0)
            for d, v in pairs.tolist():
                fired[d].append(v)
            for d, text in enumerate(part.column("text").to_pylist()):
                fired[d] += [len(entries) + i for i, x in enumerate(patterns(text)) if x]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(fired, pa.list_(pa.int32()))],
                names=["doc_id", "votes"])


@dataclass
class LabelModel:
    """Rates at which each voter fires on toxic and on clean texts, the share of toxic texts, and
    each voter's weight after its correlations."""
    toxic: np.ndarray
    clean: np.ndarray
    share: float
    weight: np.ndarray

    def posterior(self, fires: np.ndarray) -> np.ndarray:
        """Probability of toxic for rows of 0/1 votes."""
        on = self.weight * np.log(self.toxic / self.clean)
        off = self.weight * np.log((1 - self.toxic) / (1 - self.clean))
        logit = math.log(self.share / (1 - self.share)) + off.sum() + fires @ (on - off)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def _matrix(votes: list, n: int) -> np.ndarray:
    fires = np.zeros((len(votes), n))
    for row, v in enumerate(votes):
        fires[row, v] = 1
    return fires


def _sums(batches: Iterator[pd.DataFrame], model: LabelModel) -> Iterator[pd.DataFrame]:
    """Sums over documents: co-firing of voters i <= j weighted by the posterior, and by 1."""
    n = len(model.toxic)
    both, every = np.zeros((n + 1, n + 1)), np.zeros((n + 1, n + 1))
    for batch in batches:
        for begin in range(0, len(batch), 2000):
            rows = batch.iloc[begin:begin + 2000]
            fires = _matrix(rows["votes"].tolist(), n)
            p, count = model.posterior(fires), rows["n"].to_numpy(dtype=float)
            ones = np.hstack([fires, np.ones((len(fires), 1))])
            both += ones.T @ (ones * (p * count)[:, None])
            every += ones.T @ (ones * count[:, None])
    i, j = np.nonzero(np.triu(every))
    yield pd.DataFrame({"i": i, "j": j, "toxic": both[i, j], "all": every[i, j]})


def fit_label_model(votes: DataFrame, start: LabelModel, rounds: int = 6, pseudo: float = 20.0
                    ) -> LabelModel:
    """Expectation maximisation over (votes, n): ``n`` documents with these votes. The starting
    rates count as ``pseudo`` documents of each class."""
    n, model = len(start.toxic), start
    for _ in range(rounds):
        now = model
        sums = votes.mapInPandas(lambda it: _sums(it, now), "i int, j int, toxic double, all double") \
            .groupBy("i", "j").agg(F.sum("toxic").alias("toxic"), F.sum("all").alias("all")).toPandas()
        toxic, every = np.zeros((n + 1, n + 1)), np.zeros((n + 1, n + 1))
        for target, name in ((toxic, "toxic"), (every, "all")):
            target[sums["i"], sums["j"]] = sums[name]
            target += np.triu(target, 1).T
        mass, total = toxic[n, n], every[n, n]
        if total == 0:
            return model
        rate = (toxic[n, :n] + pseudo * start.toxic) / (mass + pseudo)
        other = ((every - toxic)[n, :n] + pseudo * start.clean) / (total - mass + pseudo)
        # how voters fire together on toxic texts, beyond their rates
        p = toxic[n, :n] / max(mass, 1e-9)
        spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
        corr = (toxic[:n, :n] / max(mass, 1e-9) - np.outer(p, p)) / np.outer(spread, spread)
        np.fill_diagonal(corr, 1)
        low, high = 1e-6, 1 - 1e-6
        model = LabelModel(np.clip(rate, low, high), np.clip(other, low, high),
                           float(np.clip((mass + pseudo * start.share) / (total + pseudo), low, high)),
                           1 / np.maximum(1, (np.clip(corr, 0, 1) ** 2).sum(axis=1)))
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _association(pos: Column, neg: Column, n_pos: int, n_neg: int) -> Column:
    """Likelihood ratio of an entry's documents being more toxic than the rest, at least 0."""
    def part(k: Column, expected: Column) -> Column:
        return F.when(k > 0, k * F.ln(k / expected)).otherwise(0.0)

    total, n = pos + neg, n_pos + n_neg
    g = 2 * (part(pos, total * n_pos / n) + part(neg, total * n_neg / n)
             + part(n_pos - pos, (n - total) * n_pos / n) + part(n_neg - neg, (n - total) * n_neg / n))
    return F.when(pos * n > total * n_pos, g).otherwise(0.0)


def labelled_sample(labels: DataFrame, sample_rows: int) -> DataFrame:
    """At most ``sample_rows`` (doc_id, toxic) of the labels that may be learned from."""
    sample = (labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id")
              .agg(F.max("toxic").cast("int").alias("toxic"))
              .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample_rows))
    return materialise(sample, "labelled")


def calibration(logits: np.ndarray, toxic: np.ndarray, rows: np.ndarray | None = None
                ) -> tuple[float, float]:
    """Slope and offset that fit logits to labels (logistic regression on one number, by Newton's
    method, with targets kept off 0 and 1). rows: how many rows each pair stands for."""
    rows = np.ones(len(logits)) if rows is None else rows
    n_pos, n_neg = int((rows * toxic).sum()), int((rows * (1 - toxic)).sum())
    if not n_pos or not n_neg:
        return 1.0, 0.0
    target = np.where(toxic > 0, (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2))
    x = np.stack([logits, np.ones(len(logits))], axis=1)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((rows * (np.logaddexp(0, z) - target * z)).sum() + 1e-3 * (w @ w))

    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        grad = x.T @ (rows * (p - target)) + 2e-3 * w
        hess = x.T @ (x * (rows * p * (1 - p))[:, None]) + 2e-3 * np.eye(2)
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def choose_voters(docs: DataFrame, sample: DataFrame, max_voters: int
                  ) -> tuple[np.ndarray, LabelModel]:
    """Entries (hashes) of the lexicon voters and the rates seen in the labelled sample."""
    seeds = sorted({word_hash(w) for w in SEEDS})
    rows = docs.join(F.broadcast(sample), "doc_id").select("text", "toxic")
    counts = materialise(
        rows.mapInArrow(_labelled_counts, "entry long, pos long, neg long")
        .groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "entries")
    seen = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("toxic")).first()
    n_pos, n_neg = int(seen[0]), int(seen[1] - seen[0])
    signed = [s - 2 ** 64 if s >= 2 ** 63 else s for s in seeds]
    chosen = {s: (0, 0) for s in signed}
    if n_pos and n_neg:
        bar = 1.5 * math.log(max(2, counts.count()))
        strong = (counts.withColumn("g", _association(F.col("pos"), F.col("neg"), n_pos, n_neg))
                  .filter(F.col("g") >= bar).orderBy(F.desc("g"), "entry").limit(max_voters))
        chosen.update({r["entry"]: (r["pos"], r["neg"]) for r in strong.collect()})
        own = counts.filter(F.col("entry").isin(signed)).collect()
        chosen.update({r["entry"]: (r["pos"], r["neg"]) for r in own})
    entries = np.array(sorted(chosen), dtype=np.int64)
    pos, neg = (np.array([chosen[e][k] for e in entries.tolist()], dtype=float) for k in (0, 1))
    # without labels a seed fires on 3 in 10 toxic texts and 1 in 100 others; labels outweigh this
    toxic = np.r_[(pos + 0.3) / (n_pos + 1), np.full(PATTERNS, 0.05)]
    clean = np.r_[(neg + 0.01) / (n_neg + 1), np.full(PATTERNS, 0.05)]
    return entries.view(np.uint64), LabelModel(toxic, clean, (n_pos + 0.1) / (n_pos + n_neg + 1),
                                               np.ones(len(toxic)))


def _features(votes: Column, n: int) -> Column:
    """One number for each voter, then whether and how many voters fire."""
    fired = F.size(votes)
    return F.concat(F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                                lambda v: F.array_contains(votes, v).cast("double")),
                    F.array((fired > 0).cast("double"), F.log1p(fired.cast("double"))))


def _with_posterior(batches: Iterator[pd.DataFrame], model: LabelModel) -> Iterator[pd.DataFrame]:
    for batch in batches:
        p = np.concatenate([model.posterior(_matrix(batch["votes"].tolist()[i:i + 2000],
                                                    len(model.toxic)))
                            for i in range(0, len(batch), 2000)] or [np.empty(0)])
        n = batch["n"].to_numpy(dtype=float)
        yield pd.concat([pd.DataFrame({"votes": batch["votes"], "label": y, "weight": w * n})
                         for y, w in ((1.0, p), (0.0, 1 - p))])


def score_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000,
                    max_voters: int = 200, threshold: float = 0.7, id_col: str = "doc_id",
                    text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted and votes (numbers of the voters that fire) for every row
    of ``docs``. Labels of held-out ids (crc32 of the id modulo 3 is 1) are never read."""
    docs = narrow(docs, doc_id=id_col, text=text_col)
    known = narrow(labels, doc_id=id_col, toxic=label_col).filter(~held_out(F.col("doc_id")))
    sample = labelled_sample(known, sample_rows)
    entries, start = choose_voters(docs, sample, max_voters)
    kind = docs.schema["doc_id"].dataType.simpleString()
    votes = materialise(docs.mapInArrow(lambda it: _votes(it, entries),
                                        f"doc_id {kind}, votes array<int>"), "votes")
    groups = materialise(votes.groupBy("votes").agg(F.count(F.lit(1)).alias("n")), "vote-sets")
    model = fit_label_model(groups, start)
    n = len(model.toxic)
    soft = groups.mapInPandas(lambda it: _with_posterior(it, model),
                              "votes array<int>, label double, weight double").filter("weight > 0")
    weights, intercept = [0.0] * (n + 2), math.log(model.share / (1 - model.share))
    train = materialise(soft, "posterior")
    if train.select("label").distinct().count() == 2:
        fitted = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight",
                                    regParam=1e-5, standardization=False, maxIter=60).fit(
            train.select(array_to_vector(_features(F.col("votes"), n)).alias("x"), "label", "weight"))
        weights, intercept = fitted.coefficients.toArray().tolist(), fitted.intercept
    each = F.array(*[F.lit(float(w)) for w in weights[:n]])
    fired = F.size("votes")
    logit = F.lit(float(intercept)) + F.aggregate(
        "votes", F.lit(0.0), lambda acc, v: acc + F.get(each, v)) \
        + F.lit(float(weights[n])) * (fired > 0).cast("double") \
        + F.lit(float(weights[n + 1])) * F.log1p(fired.cast("double"))
    scored = votes.select("doc_id", logit.alias("logit"), "votes")
    # one row for each logit that occurs: at most as many as sets of votes among the sample's ids
    known = scored.join(F.broadcast(sample), "doc_id").groupBy("logit", "toxic").agg(
        F.count(F.lit(1)).alias("n")).toPandas().sort_values(["logit", "toxic"])
    slope, offset = calibration(*(known[c].to_numpy(dtype=float) for c in ("logit", "toxic", "n")))
    return (scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                          (1 / (1 + F.exp(-(slope * F.col("logit") + offset)))).alias("score"),
                          "votes")
            .select("doc_id", "held_out", "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted"), "votes"))
