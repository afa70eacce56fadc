"""Toxicity by weak supervision.

Many voters look at a text: fixed lexicons, and word and word-prefix patterns mined from labelled
training documents, each with a low and a high count.  A voter says toxic or clean, or abstains.
A generative label model over texts with and without labels estimates by expectation maximisation
how often each voter speaks on toxic and on clean texts, and from the voters' conditional
correlations how much each repeats what others say.  The posterior of a text without a label comes
from its voters; that of a labelled text is its label, which no silence of voters outweighs.
Posteriors train a linear classifier, which scores all texts.  Labels serve to mine patterns, to
calibrate the voters' rates and the classifier's scores, and as labelled texts' posteriors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import textvec as tv
from quillspark.llm.common import Scratch, crc_mod, fresh, written
from quillspark.llm.training import mixed_sample

#: At most so many labelled and other documents are fitted on, and so many patterns kept.
TRAIN_ROWS, OTHER_ROWS = 6000, 4000
PATTERNS = 384
#: What a document without a label weighs in the voters' rates.
OTHER_WEIGHT = 0.25
#: Log-likelihood that a mined pattern gains at least beyond the logarithm of the number of candidates:
#: by chance hardly one of them does, however many texts are labelled.
LEAST_GAIN = 2.0
THRESHOLD = 0.3
PREFIXES = (4, 5, 6, 7, 8)
#: Bytes of text that are scored at once: short texts are many rows of as many inputs as there are voters.
SCORED_BYTES = 256 << 10
#: Counts from which a pattern's voters say toxic.
LOW, HIGH = 1, 3

# Lexicons of common insults by theme and language, one voter each.
LEXICONS = {
    "fool": "idiot idiots moron morons stupid dumb fool imbecile dimwit halfwit clown",
    "contempt": "loser losers pathetic worthless useless disgusting trash garbage scum filth",
    "creature": "pig pigs rat rats vermin maggot parasite cockroach",
    "threat": "kill die murder destroy hurt",
    "insult_de": "idiot dumm blöd trottel abschaum versager",
    "insult_fr": "idiot imbécile crétin abruti minable ordure",
    "insult_es": "idiota imbécil estúpido basura escoria inútil",
}


def _hashes(w: tv.Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word and of its prefixes."""
    rows = w.row_of()
    row, hashes = [rows], [w.hash]
    for size in PREFIXES:
        at, h = tv.prefixes(w, size)
        row.append(rows[at])
        hashes.append(h)
    return np.concatenate(row), np.concatenate(hashes)


def _mine(batches):
    for batch in batches:
        label = np.array(batch.column(2).to_pylist(), np.int64)
        for w in tv.pieces(batch.column(1)):
            bag = tv.bags(*_hashes(w), w.rows)
            y = label[w.first + bag.row]
            again = bag.count >= HIGH
            uniq, back = np.unique(bag.hash, return_inverse=True)
            count = lambda k: pa.array(np.bincount(back, k, len(uniq)).astype(np.int64))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), count(y), count(1 - y), count(y * again), count((1 - y) * again)], ["hash", "toxic", "clean", "toxic_high", "clean_high"])


def mine(sample: DataFrame, limit: int = PATTERNS) -> list[int]:
    """Hashes of the words and word prefixes that best tell toxic training texts from clean ones.

    Counted over the whole sample on the executors; ranked by the binomial log-likelihood gain of
    knowing that the pattern is there (or there often).  Candidates stand in three toxic texts.
    """
    n1, n0 = (sample.agg(F.coalesce(F.sum("label"), F.lit(0)), F.coalesce(F.sum(1 - F.col("label")), F.lit(0))).first())
    if not n1 or not n0:
        return []
    counts = sample.mapInArrow(_mine, "hash bigint, toxic bigint, clean bigint, toxic_high bigint, clean_high bigint").groupBy("hash").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "toxic_high", "clean_high")])

    def gain(a: str, b: str):
        x, z = F.col(a) + 0.5, F.col(b) + 0.5
        rate = x / (x + z)
        base = F.lit(n1 / (n1 + n0))
        return F.when(rate > 2 * base, x * F.log(rate / base) + z * F.log((1 - rate) / (1 - base))).otherwise(0.0)

    held = written(counts.where("toxic >= 3").select("hash", F.greatest(gain("toxic", "clean"), gain("toxic_high", "clean_high")).alias("gain")), "candidates")
    best = held.where(F.col("gain") > LEAST_GAIN + float(np.log(max(1, held.count()))))
    return [r["hash"] for r in best.orderBy(F.desc("gain"), "hash").limit(limit).select("hash").collect()]


@dataclass
class Voters:
    """Hashes to count in a text, and the columns their counts go to."""

    hashes: tv.HashSet
    column: np.ndarray  # of each sorted hash: mined patterns first
    mined: int
    lexicon_words: dict[int, list[int]]
    names: list[str]

    def counts(self, w: tv.Words) -> np.ndarray:
        """(rows, mined + lexicons) counts."""
        out = np.zeros((w.rows, self.mined + len(LEXICONS)), np.int32)
        row, hashes = _hashes(w)
        at, place = self.hashes.find(hashes)
        own = self.column[place]
        good = own >= 0
        np.add.at(out, (row[at][good], own[good]), 1)
        for k, where in self.lexicon_words.items():
            hit = row[at][place == k]
            for lexicon in where:
                np.add.at(out, (hit, self.mined + lexicon), 1)
        return out


def voters(patterns: list[int]) -> Voters:
    mined = np.array(patterns, np.int64).view(np.uint64)
    words = {tv.word_hash(x): [] for text in LEXICONS.values() for x in text.split()}
    for k, text in enumerate(LEXICONS.values()):
        for x in text.split():
            words[tv.word_hash(x)].append(k)
    every = tv.HashSet(np.concatenate([mined, np.fromiter(words, np.uint64, len(words))]))
    column = np.full(len(every.sorted), -1)
    column[np.searchsorted(every.sorted, mined)] = np.arange(len(mined))
    places = {int(np.searchsorted(every.sorted, np.uint64(h))): k for h, k in words.items()}
    return Voters(every, column, len(mined), places, [f"pattern {h:x}" for h in mined.tolist()] + list(LEXICONS))


def votes(counts: np.ndarray) -> np.ndarray:
    """Low and high voters of each column say toxic (1) or abstain (nan); the last voter says clean
    (0) where all others abstain, else it abstains."""
    say = np.concatenate([counts >= LOW, counts >= HIGH], axis=1)
    out = np.full((len(say), say.shape[1] + 1), np.nan, np.float32)
    out[:, :-1][say] = 1
    out[~say.any(axis=1), -1] = 0
    return out


def label_model(say: np.ndarray, known: np.ndarray, *, rounds: int = 6, other: float = OTHER_WEIGHT) -> np.ndarray:
    """Posterior toxicity of each row from its votes (1 toxic, 0 clean, nan abstains) alone.

    Each voter has rates of saying toxic and of saying clean for either class.  A row's log odds
    sum the log ratios of what its voters say; abstaining adds nothing.  A voter's part is divided
    by one plus its summed squared correlation with the others given the class, so that a hundred
    prefixes of one word speak once.  ``known`` (0, 1 or nan) calibrates the rates: rows with a
    known class count for it, others for their posteriors with weight ``other``; without known
    rows the model starts from a share of a tenth.
    """
    given = ~np.isnan(known)
    klass = np.where(given, np.nan_to_num(known), 0).astype(np.float32)
    row_weight = np.where(given, 1.0, other).astype(np.float32)
    share = float(np.clip(klass[given].mean(), 0.01, 0.99)) if given.any() else 0.1
    said = np.nan_to_num(2 * say - 1).astype(np.float32)  # toxic 1, clean -1
    toxic = np.maximum(said, 0)
    post = np.full(len(say), share, np.float32)
    if not given.any():  # the more voters say toxic, the likelier at first
        post = np.clip(toxic.sum(axis=1) / np.maximum(np.abs(said).sum(axis=1), 1), 0.02, 0.98)
    for k in range(rounds):
        p = np.where(given, klass, post)
        weight = row_weight * given if k == 0 and given.any() else row_weight  # the first rates are those of known rows
        z = np.full(len(say), np.log(share / (1 - share)))
        repeats, rates = np.zeros(say.shape[1]), []
        for part in (p, 1 - p):
            wt = (part * weight).astype(np.float32)
            total = float(wt.sum()) + 1e-9
            sums = wt @ said, wt @ toxic
            cov = (said * wt[:, None]).T @ said / total - np.outer(sums[0], sums[0]) / total**2
            sd = np.sqrt(np.maximum(np.diag(cov), 0)) + 1e-9
            repeats += 0.5 * ((cov / np.outer(sd, sd)) ** 2).sum(axis=1)
            rates.append([np.clip((n + 0.5) / (total + 1), 1e-4, 1 - 1e-4) for n in (sums[1], sums[1] - sums[0])])
        own = 1 / np.maximum(repeats, 1)
        for_toxic, for_clean = (own * np.log(a / b) for a, b in zip(*rates))
        z += toxic @ (for_toxic + for_clean) - said @ for_clean
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return post


def calibrated(z: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and shift by which log odds ``z`` fit labels: logistic, on smoothed targets, drawn
    towards slope 1 and shift 0, by damped Newton steps."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p)
        slope = np.array([((p - target) * z).sum() + 5 * (a - 1), (p - target).sum() + 0.1 * b])
        step = np.linalg.solve(np.array([[(w * z * z).sum() + 5, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]]), slope)
        step *= min(1.0, 2 / max(np.abs(step).max(), 1e-9))
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def _inputs(counts: np.ndarray) -> np.ndarray:
    """Of each column whether it is there, whether often, and its capped count."""
    n = counts.shape[1]
    out = np.empty((len(counts), 3 * n), np.float32)
    out[:, :n], out[:, n : 2 * n] = counts >= LOW, counts >= HIGH
    np.minimum(counts, 2 * HIGH, out=out[:, 2 * n :], casting="unsafe")
    out[:, 2 * n :] /= 2 * HIGH
    return out


@dataclass
class Classifier:
    voters: Voters
    bias: float
    weights: np.ndarray

    def scores(self, w: tv.Words) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + _inputs(self.voters.counts(w)) @ self.weights, -30, 30)))


def fit_linear(x: np.ndarray, target: np.ndarray, *, rounds: int = 400, rate: float = 0.1, shrink: float = 2e-4) -> tuple[float, np.ndarray]:
    """Logistic regression on soft targets by full-batch Adam."""
    share = np.clip(target.mean(), 1e-3, 1 - 1e-3) if len(target) else 0.01
    theta = np.zeros(x.shape[1] + 1, np.float64)
    theta[0] = np.log(share / (1 - share))
    if not len(target):
        return float(theta[0]), theta[1:].astype(np.float32)
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(theta[0] + x @ theta[1:].astype(np.float32), -30, 30)))
        g = np.concatenate([[np.mean(p - target)], (p - target).astype(np.float32) @ x / len(target) + shrink * theta[1:]])
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-9)
    return float(theta[0]), theta[1:].astype(np.float32)


def fit(who: Voters, counts: np.ndarray, known: np.ndarray) -> Classifier:
    """The classifier trained on known classes and, of other rows, on the label model's posteriors;
    calibrated on known classes."""
    given = ~np.isnan(known)
    post = np.where(given, known, label_model(votes(counts), known))
    x = _inputs(counts)
    bias, weights = fit_linear(x, post)
    slope, shift = calibrated(bias + x[given] @ weights.astype(float), known[given])
    return Classifier(who, slope * bias + shift, (slope * weights).astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, *, limit: int = TRAIN_ROWS, others: int = OTHER_ROWS, mod: int = 4, held_out: int = 2) -> Classifier:
    """Mine voters on at most ``limit`` labelled documents; fit the label model and the classifier on
    these and on at most ``others`` documents without a label.

    Labels of ids whose crc32 modulo ``mod`` is ``held_out`` are never read.  Without labels only
    the fixed lexicons vote.  Of documents that repeat an id one enters, chosen by hash.
    """
    with Scratch(docs.sparkSession):
        sample = written(mixed_sample(docs, labels, "toxic", limit, others, mod, held_out), "sample")
        who = voters(mine(sample.where("label is not null")))
        spread = docs.sparkSession.sparkContext.broadcast(who)

        def collect(batches):
            for batch in batches:
                for w in tv.pieces(batch.column(1), SCORED_BYTES):
                    counts = np.minimum(spread.value.counts(w), 255).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, w.rows), batch.column(2).slice(w.first, w.rows), pa.array([c.tobytes() for c in counts], pa.binary())], ["doc_id", "label", "counts"])

        rows = sorted(sample.mapInArrow(collect, "doc_id bigint, label int, counts binary").collect(), key=lambda r: r.doc_id)
    width = who.mined + len(LEXICONS)
    known = np.array([np.nan if r.label is None else r.label for r in rows], float)
    if np.isnan(known).all():
        weights = np.zeros(3 * width, np.float32)
        weights[:width] = 3.0
        return Classifier(who, -3.0, weights)
    return fit(who, np.array([np.frombuffer(r.counts, np.uint8) for r in rows], np.int32).reshape(-1, width), known)


def score(docs: DataFrame, classifier: Classifier, *, text: str = "text", name: str = "toxicity_score") -> DataFrame:
    """``docs`` with a column of scores (replaced if it is there); nulls score as empty texts."""
    names = [c for c in docs.columns if c != name]
    out = docs.select(*names).withColumn(name, F.lit(0.0))
    spread = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches):
        for batch in batches:
            found = [spread.value.scores(w) for w in tv.pieces(batch.column(names.index(text)), SCORED_BYTES)]
            got = pa.array((np.concatenate(found) if found else np.zeros(0)).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), got], [*names, name])

    return out.mapInArrow(run, out.schema)


def reject_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """Documents scoring below ``threshold``; columns are those of ``docs``, whatever their names.
    Null texts score as empty ones; rows that repeat an id are scored each by its own text."""
    (name,) = fresh(docs.columns, "toxicity")
    return score(docs, train(docs, labels), name=name).where(F.col(name) < threshold).select(*docs.columns)


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels), name="score")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
