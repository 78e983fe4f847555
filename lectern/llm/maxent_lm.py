"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

    p(word | history) = p(class | history) * p(word | class, history)

The ``HEAD`` most frequent words are dealt into classes by rank, and each is a choice of its own within its
class. All other words of the vocabulary are one more class, the tail, which is factored once more:

    p(word | tail, history) = p(bucket | tail, history) * share of the word in its bucket

(whose features go without the skip), where a word's bucket comes from its hash, and its share from the add-half counts of the corpus; one word
that was never seen has its add-half share of the tail. All three factors are maximum-entropy models over
the same features of the history - the word before, the two before (an n-gram) and the one before that alone
(a skip) - whose weights stand in tables that features are hashed into. They start from the corpus's shares.

Training is distributed: in each round every task takes gradient steps over its own texts from the
weights all share, and sends by how much each row of the tables moved. The moves are averaged row by row,
weighted by how often a task saw the row, so that what one task alone has seen isn't diluted. Every
training text belongs to one round, and at most ``LEARNERS`` tasks learn in one, so that their moves stay bounded. The model's scores therefore depend on how the table is dealt into
tasks, and on the order of a task's rows; the base score does not. What the driver holds is the model; its
tables follow the number of training tokens up to a fixed bound (``rows_for``), as they are broadcast.

Counts cover every training text. Words of high count are broadcast up to ``KNOWN``; the rest reach their
counts by a shuffle of (row, word, times), so no vocabulary is ever held in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._shared import durable, plain_text
from lectern.llm._tokens import chunks, mix, small, words_of

CLASS_WORDS, CLASSES, BUCKETS = 32, 32, 16
HEAD = CLASS_WORDS * CLASSES
KNOWN = 1 << 18
#: Bits of a word's hash that are its bucket.
BUCKET_SHIFT = 40
#: Fewest and most rows of a hashed weight table, and training tokens a row.
FEWEST_ROWS, MOST_ROWS, TOKENS_A_ROW = 1 << 16, 1 << 18, 2048
LEVELS, BLOCK = 3, 1024
BATCH = 8192
#: A row that is met in more tokens of a batch is summed up by itself.
FEW = 12
ROUNDS, RATE = 2, 0.6
#: Tasks that learn in a round, at most: each sends moves of up to the model's size, so what is shuffled doesn't grow past that.
LEARNERS = 128
#: Words are counted in a task up to so many at a time.
COUNTED = 1 << 21
END = np.uint64(0x5D1F_0E4D_A3C2_9B71)
NEVER = np.float32(-1e9)


def rows_for(tokens: int) -> tuple[int, int, int]:
    """Rows of the weight tables for classes, for words within a class, and for buckets of the tail."""
    rows = min(MOST_ROWS, max(FEWEST_ROWS, 1 << (tokens // TOKENS_A_ROW).bit_length()))
    return rows // 4, rows, rows


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (the words of each lower-cased text, then an end), and the texts' bounds."""
    hashes, bounds, *_ = words_of([x.lower() for x in texts])
    ends = bounds[1:] + np.arange(len(texts))
    out = np.empty(len(hashes) + len(texts), np.uint64)
    word = np.ones(len(out), bool)
    word[ends] = False
    out[ends] = END
    out[word] = hashes
    return out, np.concatenate([[0], ends + 1])


def history(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The hashed features of each token's history, one row a feature; before a text stands an end."""
    one, two = np.full(len(tokens), END), np.full(len(tokens), END)
    one[1:], two[2:] = tokens[:-1], tokens[:-2]
    starts = bounds[:-1]
    one[starts] = two[starts] = END
    two[(starts + 1)[starts + 1 < len(tokens)]] = END
    return np.stack([mix(one + np.uint64(11)), mix(mix(one + np.uint64(23)) + two), mix(two + np.uint64(37))])


@dataclass
class MaxentModel:
    """Weights and the shares they start from; levels are classes, words within a class, buckets of the tail."""

    head: np.ndarray  # sorted hashes of the most frequent words
    ranks: np.ndarray  # their ranks
    class_bias: np.ndarray
    word_bias: np.ndarray
    bucket_bias: np.ndarray
    weights: list[np.ndarray]

    def places(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's class and place in it; words outside the head have the class ``CLASSES`` and their bucket."""
        buckets = bucket_of(tokens)
        if not len(self.head):
            return np.full(len(tokens), CLASSES), buckets
        at = np.minimum(np.searchsorted(self.head, tokens), len(self.head) - 1)
        inside = self.head[at] == tokens
        rank = self.ranks[at]
        return np.where(inside, rank // CLASS_WORDS, CLASSES), np.where(inside, rank % CLASS_WORDS, buckets)

    def rows(self, level: int, features: np.ndarray, classes: np.ndarray | None = None) -> np.ndarray:
        """The rows of the weight table that each feature of each token uses."""
        if classes is not None:
            features = mix(features + classes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return (features >> np.uint64(20)).astype(np.int64) & (len(self.weights[level]) - 1)

    def logits(self, level: int, rows: np.ndarray, classes: np.ndarray | None = None) -> np.ndarray:
        w = self.weights[level]
        out = w.take(rows[0], axis=0)
        for r in rows[1:]:
            out += w.take(r, axis=0)
        out += self.word_bias.take(classes, axis=0) if level == 1 else self.class_bias if level == 0 else self.bucket_bias
        return out


def bucket_of(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(BUCKET_SHIFT)).astype(np.int64) % BUCKETS


def log_softmax(logits: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The probabilities of each row, and the natural log of the wanted one's."""
    logits -= logits.max(axis=1, keepdims=True)
    own = logits[np.arange(len(logits)), wanted]
    np.exp(logits, out=logits)
    total = logits.sum(axis=1)
    logits /= total[:, None]
    return logits, own - np.log(total)


def _choices(model: MaxentModel, tokens: np.ndarray, bounds: np.ndarray):
    """(level, tokens' numbers, rows, classes, wanted) of every choice the tokens make, a batch at a time."""
    features = history(tokens, bounds)
    classes, places = model.places(tokens)
    inside = classes < CLASSES
    for level, who in ((0, np.arange(len(tokens))), (1, np.flatnonzero(inside)), (2, np.flatnonzero(~inside))):
        for a in range(0, len(who), BATCH):
            at = who[a : a + BATCH]
            k = classes[at] if level == 1 else None
            # the tail's buckets go without the skip
            yield level, at, model.rows(level, features[: 2 if level == 2 else 3, at], k), k, (classes if level == 0 else places)[at]


def word_scores(model: MaxentModel, tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 of p(class) and, for words of the head, p(word | class); log10 of p(bucket | tail) of the others; which tokens are in the head."""
    out, bucket = np.zeros(len(tokens)), np.zeros(len(tokens))
    for level, at, rows, classes, wanted in _choices(model, tokens, bounds):
        (bucket if level == 2 else out)[at] += log_softmax(model.logits(level, rows, classes), wanted)[1]
    return out / np.log(10), bucket / np.log(10), model.places(tokens)[0] < CLASSES


class Learner:
    """Gradient steps of one task: the moved weights, and how often each row was met."""

    def __init__(self, model: MaxentModel, rate: float):
        self.model = MaxentModel(model.head, model.ranks, model.class_bias, model.word_bias, model.bucket_bias, [w.copy() for w in model.weights])
        self.rate = rate
        self.met = [np.zeros(len(w), np.int32) for w in model.weights]
        self.size = [np.ones(len(w), np.float32) for w in model.weights]  # sums of squared gradients

    def _step(self, level: int, rows: np.ndarray, classes: np.ndarray | None, wanted: np.ndarray) -> None:
        slope = log_softmax(self.model.logits(level, rows, classes), wanted)[0]
        slope[np.arange(len(slope)), wanted] -= 1
        order = np.argsort(rows.ravel(), kind="stable")
        ordered, source = rows.ravel()[order], order % len(slope)
        first = np.flatnonzero(np.diff(ordered, prepend=-1))
        row, times = ordered[first], np.diff(np.append(first, len(order)))
        # most rows are met once; to those met a few times the second token is added, then the third ...
        total = slope.take(source[first], axis=0)
        for k in range(1, FEW):
            who = np.flatnonzero((times > k) & (times <= FEW))
            if not len(who):
                break
            total[who] += slope.take(source[first[who] + k], axis=0)
        for r in np.flatnonzero(times > FEW):
            total[r] = slope.take(source[first[r] : first[r] + times[r]], axis=0).sum(axis=0)
        self.met[level][row] += times.astype(np.int32)
        self.size[level][row] += np.einsum("ij,ij->i", total, total)
        self.model.weights[level][row] -= (self.rate / np.sqrt(self.size[level][row]))[:, None] * total

    def learn(self, tokens: np.ndarray, bounds: np.ndarray) -> None:
        for level, _, rows, classes, wanted in _choices(self.model, tokens, bounds):
            self._step(level, rows, classes, wanted)


MOVES = "level int, block int, rows binary, met binary, moves binary"


def _moved(sent, rate: float):
    """(text) to the moves of each block of rows that this task met."""

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = None
        for batch in small(batches):
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            learner = learner or Learner(sent.value, rate)
            for a, b in chunks(texts):
                learner.learn(*tokens_of(texts[a:b]))
        if learner is None:
            return
        for level in range(LEVELS):
            for block in range(len(learner.met[level]) // BLOCK):
                met = learner.met[level][block * BLOCK : (block + 1) * BLOCK]
                rows = np.flatnonzero(met)
                if len(rows):
                    at = rows + block * BLOCK
                    moves = (learner.model.weights[level][at] - sent.value.weights[level][at]).astype("<f2")
                    yield pa.RecordBatch.from_pylist([{"level": level, "block": block, "rows": rows.astype("<u2").tobytes(), "met": met[rows].astype("<i4").tobytes(), "moves": moves.tobytes()}], schema=_SCHEMA)

    return moved


_SCHEMA = pa.schema([("level", pa.int32()), ("block", pa.int32()), ("rows", pa.binary()), ("met", pa.binary()), ("moves", pa.binary())])


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All tasks' moves of each block to their weighted mean."""
    held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for x in batch.to_pylist():
            rows, met = np.frombuffer(x["rows"], "<u2"), np.frombuffer(x["met"], "<i4").astype(np.float64)
            moves = np.frombuffer(x["moves"], "<f2").reshape(len(rows), -1)
            total, weight = held.setdefault((x["level"], x["block"]), (np.zeros((BLOCK, moves.shape[1])), np.zeros(BLOCK)))
            total[rows] += moves * met[:, None]
            weight[rows] += met
    for (level, block), (total, weight) in held.items():
        rows = np.flatnonzero(weight)
        mean = (total[rows] / weight[rows, None]).astype("<f4")
        yield pa.RecordBatch.from_pylist([{"level": level, "block": block, "rows": rows.astype("<u2").tobytes(), "met": b"", "moves": mean.tobytes()}], schema=_SCHEMA)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to (word, n): a task's counts, up to ``COUNTED`` tokens at a time."""
    held: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        words, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    for batch in small(batches):
        texts = batch.column(0).cast(pa.binary()).to_pylist()
        for a, b in chunks(texts):
            held.append(tokens_of(texts[a:b])[0])
            if sum(map(len, held)) >= COUNTED:
                yield out()
    if held:
        yield out()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): the hash of every token of the column ``text`` and how often it occurs."""
    partial = texts.select("text").mapInArrow(_counted, "word long, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Counts:
    """What scoring needs of the corpus's counts in one place: sums, and the words of high count."""

    tokens: int
    words: int
    known: np.ndarray  # sorted hashes
    times: np.ndarray
    buckets: np.ndarray  # add-half weight of all words in each bucket, those of the head too


def _gathered(counts: DataFrame) -> Counts:
    sums = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    # how many words there are of which count, in a few hundred steps of a logarithmic scale
    step = F.floor(F.log2("n") * 8)
    left, above, share = KNOWN, None, 0.0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["step"]):
        above, share = r["step"], min(1.0, left / r["words"])
        left -= r["words"]
        if left <= 0:
            break
    # of the last step the part that there is room for, by hash
    fits = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20))
    known = counts.where(F.lit(False)) if above is None else counts.where((step > above) | ((step == above) & fits))
    known = known.toArrow()  # KNOWN rows, or by chance a few more
    words, times = known["word"].to_numpy().view(np.uint64), known["n"].to_numpy()
    order = np.argsort(words)
    buckets = np.zeros(BUCKETS)
    bucket = F.pmod(F.shiftrightunsigned("word", BUCKET_SHIFT), F.lit(BUCKETS))
    for r in counts.groupBy(bucket.alias("bucket")).agg(F.sum(F.col("n") + 0.5).alias("weight")).collect():
        buckets[r["bucket"]] = r["weight"]
    return Counts(sums[0] or 0, sums[1], words[order], times[order], buckets)


def _untrained(counts: Counts) -> tuple[MaxentModel, np.ndarray]:
    """A model that gives every word its share of the corpus, and the weight of the tail's words in each bucket."""
    order = np.lexsort((counts.known, -counts.times))[:HEAD]
    words, times = counts.known[order], counts.times[order]
    tail = counts.buckets - np.bincount(bucket_of(words), times + 0.5, minlength=BUCKETS)
    tail = np.where(tail < 0.25, 0, tail)  # of a bucket without other words nothing but rounding is left
    padded = np.zeros(HEAD)
    padded[: len(times)] = times + 0.5
    padded = padded.reshape(CLASSES, CLASS_WORDS)
    log = lambda x: np.where(x > 0, np.log(np.maximum(x, 1e-30)), NEVER).astype(np.float32)
    by_hash = np.argsort(words)
    sizes = rows_for(counts.tokens)
    weights = [np.zeros((rows, width), np.float32) for rows, width in zip(sizes, (CLASSES + 1, CLASS_WORDS, BUCKETS))]
    class_bias = log(np.append(padded.sum(axis=1), tail.sum() + 0.5))
    return MaxentModel(words[by_hash], by_hash, class_bias, log(padded), log(tail) if tail.any() else np.zeros(BUCKETS, np.float32), weights), tail


def train(texts: DataFrame, counts: Counts) -> tuple[MaxentModel, np.ndarray]:
    """The trained model, and the tail's weight in each bucket; ``texts`` has ``text`` and ``round``."""
    spark = texts.sparkSession
    model, tail = _untrained(counts)
    if texts.rdd.getNumPartitions() > LEARNERS:  # fewer stay as they are dealt
        texts = texts.coalesce(LEARNERS)
    for k in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model)
        moves = texts.where(F.col("round") == k).select("text").mapInArrow(_moved(sent, RATE / (k + 1)), MOVES)
        merged = moves.repartition("level", "block").mapInArrow(_averaged, MOVES).toArrow()  # the size of the model at most
        for x in merged.to_pylist():
            rows = np.frombuffer(x["rows"], "<u2").astype(np.int64) + x["block"] * BLOCK  # past 2^16 in large tables
            model.weights[x["level"]][rows] += np.frombuffer(x["moves"], "<f4").reshape(len(rows), -1)
        sent.unpersist()
    return model, tail


SCORED = "id {id}, n_tokens long, n_seen long, seen_log double, model_log double, words array<long>, times array<int>, logs array<double>"


def tail_logs(bucket: np.ndarray, tokens: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """log10 of what a tail word's add-half count is multiplied by, given log10 p(bucket | tail)."""
    unseen = 0.5 / (tail.sum() + 0.5)
    return bucket - np.log10(np.maximum(tail, 0.5))[bucket_of(tokens)] + np.log10(1 - unseen) if unseen < 1 else bucket


def _scored(sent):
    """(id, text) to what a row needs no more of the corpus for, and its words of low count."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, times, tail = sent.value
        logs = np.log10(times + 0.5)
        for batch in small(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in chunks(texts):
                tokens, bounds = tokens_of(texts[a:b])
                starts, sizes = bounds[:-1], np.diff(bounds)
                own, bucket, inside = word_scores(model, tokens, bounds)
                at = np.minimum(np.searchsorted(known, tokens), max(len(known) - 1, 0))
                seen = known[at] == tokens if len(known) else np.zeros(len(tokens), bool)
                log = np.where(seen, logs[at], 0.0) if len(known) else np.zeros(len(tokens))
                rest = tail_logs(bucket, tokens, tail)
                # words of the tail have their share of a bucket; of those of low count it is added later
                own = own + np.where(seen & ~inside, rest + log, 0.0)
                out = np.flatnonzero(~seen)
                owner = np.repeat(np.arange(b - a), sizes)[out]
                order = np.lexsort((tokens[out], owner))
                doc, word = owner[order], tokens[out][order]
                first = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(word, prepend=0) != 0)) if len(doc) else np.zeros(0, np.int64)
                n = np.diff(np.append(first, len(doc))).astype(np.int32)
                cuts = pa.array(np.searchsorted(doc[first], np.arange(b - a + 1)), pa.int32())
                later = np.add.reduceat(rest[out][order], first) if len(first) else np.zeros(0)
                sums = [np.add.reduceat(x, starts) for x in (seen.astype(np.int64), log, own)]
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (word[first].view(np.int64), n, later)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), *map(pa.array, sums), *lists],
                    ["id", "n_tokens", "n_seen", "seen_log", "model_log", "words", "times", "logs"],
                )

    return scored


def lm_scores(docs: DataFrame, fold: int = 1, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``gain``.

    Learns from the rows whose crc32 of the id as text, modulo ``folds``, isn't ``fold``, and scores all.
    ``base_score`` is the add-half unigram log10 probability, ``score`` the model's, and ``gain`` by how much
    a token's is higher on average: what the model has met before gains most. Null and empty texts
    have one token, the end. A null id is never held out. Rows that repeat an id or a text are rows of
    their own and count as often. With nothing to learn from, every score is 0. An empty table gives an
    empty result. Other columns are not read.
    """
    named = docs.select(F.col(id_col).alias("id"), plain_text(F.col(text_col)).alias("text"))
    crc = F.crc32(F.encode(F.col("id").cast("string"), "UTF-8"))
    held = F.coalesce(F.pmod(crc, F.lit(folds)) == fold, F.lit(False))
    learn = named.where(~held).select("text", F.coalesce(F.pmod(F.floor(crc / folds), F.lit(ROUNDS)), F.lit(0)).alias("round"))
    counts = durable(word_counts(learn), "lm-counts")
    got = _gathered(counts)
    model, tail = train(learn, got)
    sent = docs.sparkSession.sparkContext.broadcast((model, got.known, got.times, tail))
    scored = named.mapInArrow(_scored(sent), SCORED.format(id=named.schema["id"].dataType.simpleString()))
    scored = durable(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")

    each = scored.select("row", F.explode(F.arrays_zip("words", "times", "logs")).alias("w"))
    low = each.select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"), F.col("w.logs").alias("log"))
    met = low.join(counts, "word", "left")
    share = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    unseen = float(np.log10(0.5 / (tail.sum() + 0.5)))
    sums = met.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"), F.sum(share).alias("low_log"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("log") + share).otherwise(F.col("times") * F.lit(unseen))).alias("low_model"),
    )
    both = scored.drop("words", "times", "logs").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    all_log = float(np.log10(got.tokens + 0.5 * (got.words + 1)))
    return both.select(
        F.col("id").alias(id_col),
        held.alias("held_out"),
        "n_tokens",
        (F.col("n_seen") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(got.tokens)).cast("long").alias("train_tokens"),
        (F.col("seen_log") + zero("low_log") - F.col("n_tokens") * F.lit(all_log)).alias("base_score"),
        (F.col("model_log") + zero("low_model")).alias("score"),
    ).withColumn("gain", (F.col("score") - F.col("base_score")) / F.col("n_tokens"))
