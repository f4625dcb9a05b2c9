"""Toxicity by class-conditional Kneser-Ney models.

An expression is a word, spelt letter by letter to an end mark; the context of a letter is the whole beginning of
the word before it, however long.  Counts are of Kneser-Ney's kind: C_c(p) is how many words that begin with p the
distinct training texts of class c hold, each word once a text.  With q the context, x the letter and p = qx,

    P_c(x | q) = max(C_c(p) - D, 0) / C_c(q) + lambda_c(q) P(x | q)
    P(x | q)   = max(C(p) - d, 0) / C(q) + d N(q) / C(q) * K(x)

where C counts both classes together, N(q) is how many letters follow q, and K(x) is the share of contexts that x
follows, the continuation count.  So P is the shared backoff: an interpolated Kneser-Ney model of both classes.
lambda_c(q) is what the discount D took from the class, so P_c sums to 1; a class that has nothing in a context
backs off wholly.  A context that toxic texts hold at most D times says nothing about them: from there on both models
go on with the shared counts.  So rare words, inflections of a stem for instance, share the evidence of the longest
beginning that isn't rare.

A passage is ``passage`` words in a row.  Its two log-likelihoods are divided by its number of words, and a text
scores as its most toxic passage does; a long text is not measured against its own harmless length.

Beginnings are 64-bit hashes, extended letter by letter, so a word costs its length whatever that is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import id_texts, likely_among, stored

WORDS = re.compile(r"[^\W\d_]+")
END = "$"
ROOT = np.uint64(0x6A09E667F3BCC909)
NO_CONTEXT = float("nan")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def longer(before: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The hashes of beginnings, each with one more letter."""
    x = (before ^ letters.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def spelt(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All letters, end marks among them, and where each word begins and how many it has."""
    letters = np.frombuffer("".join(w + END for w in words).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    return letters, np.cumsum(sizes) - sizes, sizes


def beginnings(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Level by level: its number, the words that reach it, the letter there, the beginning before and the one with it."""
    letters, first, sizes = spelt(words)
    state, alive, level = np.full(len(words), ROOT, np.uint64), np.arange(len(words)), 0
    while len(alive):
        here, before = letters[first[alive] + level], state[alive]
        after = state[alive] = longer(before, here)
        level += 1
        yield level, alive, here, before, after
        alive = alive[sizes[alive] > level]


def count_words(labelled: DataFrame, held: int = 300_000) -> DataFrame:
    """``word, toxic, n``: how many rows of ``labelled`` (text, toxic) hold the word."""

    def batch_of(seen: dict[int, Counter]) -> pa.RecordBatch:
        rows = [(w, y, n) for y, c in seen.items() for w, n in c.items()]
        words, labels, counts = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(labels, pa.int32()), pa.array(counts, pa.int64())], names=["word", "toxic", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[label].update(set(words_of(text)))
                if len(seen[0]) + len(seen[1]) > held:
                    yield batch_of(seen)
                    seen = {0: Counter(), 1: Counter()}
        yield batch_of(seen)

    return labelled.select("text", "toxic").mapInArrow(count, "word string, toxic int, n long").groupBy("word", "toxic").agg(F.sum("n").alias("n"))


def count_beginnings(by_word: DataFrame, held: int = 2_000_000) -> DataFrame:
    """``context, node, letter, depth, t, o``: every beginning with the one before it and its counts by class."""
    names = ["context", "node", "letter", "depth", "t", "o"]

    def merged(parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(parts) if parts else np.empty((0, 6), np.int64)
        _, first, at = np.unique(rows[:, 1], return_index=True, return_inverse=True)
        sums = [np.bincount(at, weights=rows[:, c], minlength=len(first)).astype(np.int64) for c in (4, 5)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*rows[first, :4].T, *sums)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        size = 0
        for batch in batches:
            counts = np.column_stack([batch.column(i).to_numpy() for i in (1, 2)])
            for level, words, letters, before, after in beginnings(batch.column(0).to_pylist()):
                parts.append(np.column_stack((before.view(np.int64), after.view(np.int64), letters.astype(np.int64), np.full(len(words), level), counts[words])))
                size += len(words)
            if size > held:
                yield merged(parts)
                parts, size = [], 0
        yield merged(parts)

    spelled = by_word.mapInArrow(run, "context long, node long, letter long, depth long, t long, o long")
    return spelled.groupBy("context", "node", "letter", "depth").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def learn(labelled: DataFrame, discount: float = 3.0, shared_discount: float = 0.75) -> DataFrame | None:
    """``node, depth, ratio, back``: what each beginning adds to the log ratio of a word; None without both labels.

    ``labelled`` has text and toxic (0 or 1).  ``back`` is what a word gets that goes on from there by a letter that
    isn't listed, null where both models go on with the shared counts.  A beginning that neither class holds more
    than ``discount`` times isn't listed: its ratio is its context's ``back``, so nothing is lost by that.
    """
    toxic = F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0))
    plain = F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0))
    by_word = stored(count_words(labelled).groupBy("word").agg(toxic.alias("t"), plain.alias("o")), "kn-words")
    nodes = stored(count_beginnings(by_word), "kn-nodes", instead_of=by_word)
    over = lambda c: F.greatest(F.col(c) - F.lit(float(discount)), F.lit(0.0))
    contexts = nodes.groupBy("context").agg(F.sum("t").alias("ct"), F.sum("o").alias("co"), F.count("*").alias("kids"), F.sum(over("t")).alias("ut"), F.sum(over("o")).alias("uo"))
    root = contexts.filter(F.col("context") == int(ROOT.view(np.int64))).select("ct", "co").first()
    if root is None or not root["ct"] or not root["co"]:
        return None
    left_t = 1 - F.col("ut") / F.col("ct")
    left_o = F.when(F.col("co") > 0, 1 - F.col("uo") / F.greatest("co", F.lit(1))).otherwise(F.lit(1.0))
    contexts = contexts.filter(F.col("ct") > discount).select("context", "ct", "co", "kids", left_t.alias("left_t"), left_o.alias("left_o"))
    contexts = stored(contexts.withColumn("back", F.log("left_t") - F.log("left_o")), "kn-contexts")
    after = nodes.groupBy("letter").agg(F.count("*").alias("follows"))
    all_follow = nodes.count()
    c = F.col("ct") + F.col("co")
    shared = (F.greatest(F.col("t") + F.col("o") - shared_discount, F.lit(0.0)) + shared_discount * F.col("kids") * F.col("follows") / F.lit(float(all_follow))) / c
    own = lambda n, of, left: over(n) / F.greatest(F.col(of), F.lit(1)) + F.col(left) * shared
    listed = nodes.filter((F.col("t") > discount) | (F.col("o") > discount)).join(contexts, "context").join(after, "letter")
    listed = listed.select("node", "depth", (F.log(own("t", "ct", "left_t")) - F.log(own("o", "co", "left_o"))).alias("ratio"))
    backs = contexts.select(F.col("context").alias("node"), "back")
    model = listed.join(backs, "node", "left").select("node", "depth", "ratio", "back")
    first = backs.filter(F.col("node") == int(ROOT.view(np.int64))).select("node", F.lit(0).cast("long").alias("depth"), F.lit(0.0).alias("ratio"), "back")
    return stored(model.unionByName(first), "kn-model", instead_of=nodes)


class Model:
    """Log ratios of words, looked up level by level for many at once."""

    def __init__(self, nodes: np.ndarray, ratios: np.ndarray, backs: np.ndarray):
        order = np.argsort(nodes)
        self.nodes, self.ratios, self.backs = nodes[order], ratios[order], backs[order]

    @classmethod
    def of(cls, model: DataFrame | None) -> Model:
        if model is None:
            return cls(np.empty(0, np.int64), np.empty(0), np.empty(0))
        read = model.select("node", "ratio", F.coalesce("back", F.lit(NO_CONTEXT))).toArrow()
        return cls(*(read.column(i).to_numpy() for i in range(3)))

    def of_words(self, words: list[str]) -> np.ndarray:
        """Of each word the difference of its log-likelihoods under the toxic and the ordinary model."""
        total = np.zeros(len(words))
        if not len(self.nodes) or not words:
            return total
        letters, first, sizes = spelt(words)
        state, alive, level = np.full(len(words), ROOT, np.uint64), np.arange(len(words)), 0
        here = np.full(len(words), np.searchsorted(self.nodes, ROOT.view(np.int64)))
        while len(alive):
            state[alive] = longer(state[alive], letters[first[alive] + level])
            level += 1
            wanted = state[alive].view(np.int64)
            at = np.minimum(np.searchsorted(self.nodes, wanted), len(self.nodes) - 1)
            found = self.nodes[at] == wanted
            lost = alive[~found]
            total[lost] += self.backs[here[lost]]
            alive, at = alive[found], at[found]
            total[alive] += self.ratios[at]
            here[alive] = at
            alive = alive[~np.isnan(self.backs[at]) & (sizes[alive] > level)]
        return total


def most_toxic(ratios: np.ndarray, passage: int) -> float:
    """The greatest mean of ``passage`` neighbours; of fewer the mean of all, of none 0."""
    if len(ratios) <= passage:
        return float(ratios.mean()) if len(ratios) else 0.0
    sums = np.cumsum(ratios)
    sums[passage:] -= sums[:-passage].copy()
    return float(sums[passage - 1 :].max() / passage)


def log_ratios(docs: DataFrame, model: Model, passage: int = 2, held: int = 500_000) -> DataFrame:
    """``doc_id, ratio`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [words_of(t) for t in part.column(1).to_pylist()]
                if len(known) > held:
                    known = {}
                new = [w for w in set().union(*texts) if w not in known]
                known.update(zip(new, model.of_words(new).tolist(), strict=True))
                found = [most_toxic(np.fromiter(map(known.__getitem__, words), np.float64, len(words)), passage) for words in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], names=["doc_id", "ratio"])

    return id_texts(docs).mapInArrow(run, "doc_id long, ratio double")


def log_ratios_joined(docs: DataFrame, model: DataFrame, passage: int = 2, salts: int = 64, shallow: int = 4) -> DataFrame:
    """``doc_id, ratio`` of every row like ``log_ratios``, for a model of any size: distinct words are joined with it.

    Beginnings of up to ``shallow`` letters, which many words share, and words that many texts share are salted.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([words_of(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["doc_id", "words"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0)
            for level, at, _, _, after in beginnings(words.to_pylist()):
                yield pa.RecordBatch.from_arrays([words.take(pa.array(at)), pa.array(np.full(len(at), level, np.int64)), pa.array(after.view(np.int64))], names=["word", "level", "node"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for words, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ratios = dict(known or [])
                found.append(most_toxic(np.array([ratios[w] for w in words or []]), passage))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "ratio"])

    # Rows are numbered once: the number is read back from the table.
    rows = stored(id_texts(docs).mapInArrow(cut, "doc_id long, words array<string>").withColumn("row", F.monotonically_increasing_id()), "kn-texts")
    held = rows.select("row", F.explode(F.array_distinct("words")).alias("word"))
    every = held.select("word").distinct()
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(salts)).cast("int")
    tried = every.mapInArrow(spell, "word string, level long, node long").withColumn("salt", F.when(F.col("level") <= shallow, salt("word")).otherwise(0))
    spread = model.withColumn("salt", F.explode(F.when(F.col("depth") <= shallow, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    chain = tried.join(spread, ["node", "salt"]).groupBy("word").agg(F.sum("ratio").alias("total"), F.max(F.struct("level", "back")).alias("deepest"))
    start = model.filter("depth = 0").first()
    ratio = every.join(chain, "word", "left").select("word", F.when(F.col("total").isNull(), F.lit(start["back"])).otherwise(F.col("total") + F.coalesce("deepest.back", F.lit(0.0))).alias("ratio"))
    ratio = ratio.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    known = held.withColumn("salt", salt("row")).join(ratio, ["word", "salt"]).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("word", "ratio"))).alias("known"))
    return rows.join(known, "row", "left").select("doc_id", "words", "known").mapInArrow(score, "doc_id long, ratio double")


def threshold(pairs: list[tuple[float, int]]) -> float:
    """The positive ratio that parts the labels with fewest errors, midway between its neighbours."""
    if not any(y for _, y in pairs):
        return 1.0
    ratios, labels = np.array([r for r, _ in pairs]), np.array([y for _, y in pairs])
    order = np.argsort(ratios, kind="stable")
    ratios, labels = ratios[order], labels[order]
    errors = np.concatenate(([0], np.cumsum(labels))) + np.concatenate((np.cumsum((1 - labels)[::-1])[::-1], [0]))
    middles = np.concatenate(([ratios[0]], (ratios[:-1] + ratios[1:]) / 2, [ratios[-1]]))
    possible = np.concatenate(([True], ratios[1:] > ratios[:-1], [True])) & (middles > 0)
    return float(middles[possible][errors[possible].argmin()]) if possible.any() else 1.0


def fitted_threshold(rows: DataFrame, parts: int = 1024, part_rows: int = 50_000) -> float:
    """What ``threshold`` finds for ``ratio, toxic`` of all rows, from running counts in ranges of the ratio.

    Rows are counted by ratio, map-side first, and ratios are cut into at most ``parts`` ranges at approximate
    quantiles; each range adds the sums of those below, so no task orders all ratios and no row is left out.
    """
    counts = stored(rows.groupBy("ratio").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o")), "kn-fit")
    k = max(1, min(parts, counts.count() // part_rows))
    bounds = sorted(set(counts.agg(F.percentile_approx("ratio", F.array(*[F.lit(i / k) for i in range(1, k)]), F.lit(10_000))).first()[0] or [])) if k > 1 else []
    listed = "array(" + ", ".join(f"{b!r}D" for b in bounds) + ")"
    dealt = counts.withColumn("part", F.expr(f"size(filter({listed}, b -> b <= ratio))") if bounds else F.lit(0))
    ranges = sorted(dealt.groupBy("part").agg(F.sum("t"), F.sum("o"), F.min("ratio")).collect())
    all_t, all_o = sum(r[1] for r in ranges), sum(r[2] for r in ranges)
    if not all_t:
        return 1.0
    # Of each range: toxic rows below it, ordinary ones from its start on, and where the next begins.
    known, below, above = [], 0, all_o
    for (part, t, o, _), following in zip(ranges, [*(r[3] for r in ranges[1:]), None], strict=True):
        known.append((part, below, above, following))
        below, above = below + t, above - o
    known = F.broadcast(rows.sparkSession.createDataFrame(known, "part int, below long, above long, following double"))
    own = Window.partitionBy("part").orderBy("ratio")
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    errors = F.col("below") + F.sum("t").over(upto) + F.col("above") - F.sum("o").over(upto)
    middle = (F.col("ratio") + F.coalesce(F.lead("ratio").over(own), "following", "ratio")) / 2
    best = dealt.join(known, "part").select(errors.alias("errors"), middle.alias("middle")).filter("middle > 0").agg(F.min(F.struct("errors", "middle"))).first()[0]
    least = ranges[0][3]  # a threshold there calls every row toxic
    possible = ([tuple(best)] if best else []) + ([(all_o, least)] if least > 0 else [])
    return float(min(possible)[1]) if possible else 1.0


def score_toxicity(docs: DataFrame, labels: DataFrame, max_nodes: int = 4_000_000, passage: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, score, predicted``; ``labels`` (doc_id, toxic) holds what may be learned.

    Equal texts are counted once per label.  Rows of ``labels`` with a null id or label, or of unknown ids, teach
    nothing; without any of both labels every score is 0.  A text without words, null or empty, scores 0.  The
    score is r / (r + threshold) for a log ratio r above 0; the threshold is fitted on all
    labelled rows.  Texts are read whole; repeated rows score alike.
    A model of more than ``max_nodes`` beginnings (24 bytes each) stays in its table and is joined with the words of
    the texts; a smaller one is sent to the tasks.  Scores are the same.
    """
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = likely_among(id_texts(docs), taught)
    first = own.select("doc_id", F.xxhash64("text", F.octet_length("text")).alias("content")).join(taught, "doc_id").groupBy("content", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic")
    model = learn(own.join(first, "doc_id").select("text", "toxic"))
    if model is None or model.count() <= max_nodes:
        found = log_ratios(docs, Model.of(model), passage)
    else:
        found = log_ratios_joined(docs, model, passage)
    ratios = stored(found, "kn-ratios")
    cut = fitted_threshold(ratios.join(taught, "doc_id").select("ratio", "toxic"))
    positive = F.greatest(F.col("ratio"), F.lit(0.0))
    score = positive / (positive + F.lit(cut))
    return ratios.select("doc_id", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
