"""Language identification with interpolated Kneser-Ney character models.

One model per language, over the letters of words: each word is read between boundary marks, and a letter is predicted from
up to ``ORDER`` - 1 symbols before it. The n-grams of all models lie in one sorted array of hashes per order, beside it one
column of probabilities and one of back-off weights per language. A text goes to the language of lowest cross-entropy per
letter. Words are scored once per task and remembered, so long texts cost little more than splitting them.

Learning uses labelled rows only: about ``SAMPLE`` per language, drawn by a hash of the identifier over all rows (a documented
bound for fitting a classifier). N-grams are counted, discounted and turned into probabilities in Spark, on all counts of the sample.
Only then is the table pruned, to n-grams that make up 1/``GRAMS`` of their order's occurrences and their beginnings: what a context
gave to pruned ones goes to its back-off weight, so all chances after it still add up to one. What reaches the driver is at most some
``GRAMS`` numbers per language and order, which it only sorts. A fifth of them, kept out of the counts, calibrates the rejection: a text is
rejected whose cross-entropy is above what clean text of that length reaches.

Defined cases
- combining marks stand between words, so words of scripts that write vowels as marks are learned and read in pieces.
- null text, or text without a letter: language ``und``, score 0, rejected.
- no labelled rows at all: every text is ``und``. Languages with fewer than two labelled rows are learned without calibration.
- repeated rows are repeated; ties in cross-entropy go to the language first in code point order.
- extra columns are kept by ``identify``; those it adds take the place of columns of the same name. Labels, source and
  identifier never enter a prediction. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from ..sources.tables import read_table
from .alike import as_struct
from .words import column_blocks, mix

ORDER, SAMPLE, HELD_OUT, GRAMS = 4, 3000, 5, 1 << 18
START, END = "\x02", "\x03"
#: Words remembered per task; beyond, the memory is emptied.
REMEMBERED = 200_000
#: Rejection: cross-entropy above the mean by this many nats and by this many standard errors for the length.
MARGIN, ERRORS = 0.35, 6.0

_LETTERS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words with their marks, and the start of each word there."""
    joined = START + (END + START).join(words) + END
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    return codes, np.cumsum(sizes) - sizes


def _gram_hashes(codes: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order 1.. the hash of the n-gram that ends at each place; 0 where it would reach over a word's start."""
    depth = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
    out, h = [], np.zeros(len(codes), np.uint64)
    for k in range(order):
        shifted = np.zeros_like(codes)
        shifted[k:] = codes[: len(codes) - k]
        h = h + mix(shifted + np.uint64((k + 1) << 32))
        out.append(np.where(depth >= k, mix(h) | np.uint64(1), np.uint64(0)))
    return out


@dataclass
class Model:
    languages: list[str]
    hashes: list[np.ndarray]  # per order, sorted
    logs: list[np.ndarray]  # per order, (n-grams, languages): probability of the last symbol
    backs: list[np.ndarray]  # per order, (n-grams, languages): weight left for lower orders after this context
    base: float  # probability of a symbol never seen
    empty: np.ndarray  # per language, weight left to ``base`` by the order without context
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Minus the log probability of every symbol, (symbols, languages), and where words start; their start costs nothing."""
        codes, starts = _codes(words)
        hashes = _gram_hashes(codes, starts, len(self.hashes))
        n, k = len(codes), len(self.languages)
        p = np.full((n, k), self.base, np.float32)
        back = np.broadcast_to(self.empty, (n, k))
        for order, keys in enumerate(self.hashes):
            h = hashes[order]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = (keys[at] == h) & (h != 0)
            lower = p * back
            # A context that a model never saw has weight 1 and adds nothing; one that it saw adds its own count.
            p = np.where(h[:, None] != 0, lower, p)
            p[hit] += self.logs[order][at[hit]]
            weight = np.ones((n, k), np.float32)
            weight[hit] = self.backs[order][at[hit]]
            back = np.concatenate((weight[:1], weight[:-1]))  # the context of a symbol ends one place before it
        cost = -np.log(p)
        cost[starts] = 0
        return cost, starts

    def words(self, words: list[str]) -> np.ndarray:
        """(words, languages): minus the log probability of each word with its end."""
        return np.add.reduceat(*self.symbols(words), axis=0)


def _estimates(counts: DataFrame, order: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (lang, gram, n) of all orders: (lang, size, gram, prob, back), (lang, empty), and the symbols of all languages.

    Lower orders count the distinct symbols before an n-gram; at the start of a word nothing stands before it, so its own count
    is used. ``prob`` is what an n-gram's order gives its last symbol, ``back`` what the next order leaves to it after this context.
    """
    rows = counts.select("lang", "gram", F.length("gram").alias("size"), F.col("n").cast("double").alias("c"))
    top = rows.where(F.col("size") == order)
    own = rows.where((F.col("size") < order) & (F.col("size") > 1) & F.col("gram").startswith(START))
    after = rows.where("size > 1").select("lang", F.expr("substring(gram, 2)").alias("gram"), (F.col("size") - 1).alias("size"))
    used = top.unionByName(own).unionByName(after.groupBy("lang", "gram", "size").agg(F.count(F.lit(1)).cast("double").alias("c")))
    used = materialize(used.select("lang", "size", "gram", "c"), "lang-used")
    ones, twos = F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
    discount = F.when(ones + twos > 0, F.greatest(F.lit(0.1), F.least(F.lit(0.95), ones / (ones + 2 * twos)))).otherwise(0.5)
    discounts = materialize(used.groupBy("lang", "size").agg(discount.alias("d")), "lang-discounts")
    ends = used.where(~F.col("gram").endswith(START)).withColumn("context", F.expr("substring(gram, 1, size - 1)"))
    sums = ends.groupBy("lang", "size", "context").agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("kinds"))
    sums = materialize(sums.join(discounts, ["lang", "size"]), "lang-contexts")
    prob = ends.join(sums, ["lang", "size", "context"]).select("lang", "size", "gram", (F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("t")).alias("prob"))
    left = (F.col("d") * F.col("kinds") / F.col("t")).alias("back")
    back = sums.where("size > 1").select("lang", (F.col("size") - 1).alias("size"), F.col("context").alias("gram"), left)
    both = prob.join(back, ["lang", "size", "gram"], "full").select("lang", "size", "gram", F.coalesce("prob", F.lit(0.0)).alias("prob"), F.coalesce("back", F.lit(1.0)).alias("back"))
    return both, sums.where("size = 1").select("lang", left.alias("empty")), used.where("size = 1").select("gram").distinct()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Estimates with the hash of the n-gram in place of its text."""
    for batch in batches:
        size, grams = batch.column("size").to_numpy(), np.array(batch.column("gram").to_pylist(), object)
        out = np.zeros(len(grams), np.uint64)
        for k in np.unique(size).tolist():
            at = np.flatnonzero(size == k)
            codes, starts = _grams_as_codes(grams[at].tolist(), k)
            out[at] = _gram_hashes(codes, starts, k)[k - 1][starts + k - 1]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("size"), pa.array(out.view(np.int64)), batch.column("prob"), batch.column("back")], ["lang", "size", "hash", "prob", "back"])


def _pruned(both: DataFrame, counts: DataFrame, grams: int) -> DataFrame:
    """Estimates of n-grams with at least 1/``grams`` of their order's occurrences, of their beginnings and of single symbols.

    Interpolated chances after a context are its n-grams' own and its weight times the lower order's, which add up to one, so
    what pruned n-grams had is added to the weight. A context without n-grams ends with weight 1, which is that of one never seen.
    """
    both = materialize(both, "lang-estimates")
    sized = counts.select("lang", "gram", "n", F.length("gram").alias("size"))
    sums = sized.groupBy("lang", "size").agg(F.sum("n").alias("all"))
    strong = sized.join(sums, ["lang", "size"]).where((F.col("size") == 1) | (F.col("n") * grams >= F.col("all")))
    kept = strong.select("lang", F.explode(F.transform(F.sequence(F.lit(1), "size"), lambda k: F.substr("gram", F.lit(1), k))).alias("gram")).distinct()
    flagged = materialize(both.join(kept.withColumn("kept", F.lit(True)), ["lang", "gram"], "left"), "lang-flagged")
    lost = flagged.where("kept is null and prob > 0").groupBy("lang", F.expr("substring(gram, 1, size - 1)").alias("gram")).agg(F.sum("prob").alias("lost"))
    left = flagged.where("kept").join(lost, ["lang", "gram"], "left")
    return left.select("lang", "size", "gram", "prob", (F.col("back") + F.coalesce("lost", F.lit(0.0))).alias("back"))


def train(counts: DataFrame, order: int = ORDER, *, grams: int | None = None) -> Model:
    """Model from (lang, gram, n) of all orders, pruned after all has been estimated where ``grams`` is given."""
    both, empty, symbols = _estimates(counts, order)
    if grams is not None:
        both = _pruned(both, counts, grams)
    table = both.mapInArrow(_hashed, "lang string, size int, hash long, prob double, back double").toArrow()
    left = {r["lang"]: r["empty"] for r in empty.collect()}  # one row per language
    languages = sorted(left)
    column = np.searchsorted(np.array(languages, object), np.array(table["lang"].to_pylist(), object)) if languages else np.empty(0, int)
    size, keys = table["size"].to_numpy(), table["hash"].to_numpy().view(np.uint64)
    hashes, logs, backs = [], [], []
    for k in range(1, order + 1):
        at = np.flatnonzero(size == k)
        sorted_keys, row = np.unique(keys[at], return_inverse=True)
        prob, back = np.zeros((len(sorted_keys), len(languages)), np.float32), np.ones((len(sorted_keys), len(languages)), np.float32)
        prob[row, column[at]], back[row, column[at]] = table["prob"].to_numpy()[at], table["back"].to_numpy()[at]
        hashes.append(sorted_keys)
        logs.append(prob)
        backs.append(back)
    known = symbols.where(F.col("gram") != END).count() + 1
    return Model(languages, hashes, logs, backs, 1.0 / (known + 1), np.array([left[x] for x in languages], np.float32))


def _grams_as_codes(grams: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    return codes, np.arange(0, len(grams) * size, size)


def _count_grams(order: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in batches:
            for name, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words.setdefault(name, Counter()).update(letter_runs(text))
        for name, found in words.items():
            grams: Counter = Counter()
            for word, n in found.items():
                marked = START + word + END
                for k in range(1, order + 1):
                    for i in range(len(marked) - k + 1):
                        grams[marked[i : i + k]] += n
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams)), pa.array(list(grams)), pa.array(grams.values(), pa.int64())], ["lang", "gram", "n"])

    return count


class Scorer:
    """Scores texts with a model, remembering words."""

    def __init__(self, model: Model):
        self.model, self.costs, self.known = model, np.empty((0, len(model.languages)), np.float32), {}

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) cost in nats per letter, and the number of letters of each text."""
        if len(self.known) > REMEMBERED:
            self.known, self.costs = {}, self.costs[:0]
        runs = [letter_runs(t) for t in texts]
        new = dict.fromkeys(w for r in runs for w in r if w not in self.known)
        if new:
            fresh = list(new)
            parts = [self.model.words(fresh[i : i + 20_000]) for i in range(0, len(fresh), 20_000)]
            self.known.update(zip(fresh, range(len(self.costs), len(self.costs) + len(fresh)), strict=True))
            self.costs = np.concatenate((self.costs, *parts))
        cost, letters = np.zeros((len(texts), self.costs.shape[1])), np.zeros(len(texts), np.int64)
        for i, r in enumerate(runs):
            if r:
                letters[i] = sum(map(len, r))
                ids = np.fromiter(map(self.known.__getitem__, r), np.int64, len(r))
                cost[i] = self.costs[ids].sum(0, dtype=np.float64) / (letters[i] + len(r))
        return cost, letters


def _predict(sent):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        model = sent.value
        for batch in batches:
            names, scores, costs, out = [], [], [], []
            for _, texts in column_blocks(batch.column("text").fill_null("")):
                cost, letters = scorer.texts(texts)
                best = cost.argmin(1)
                least = cost[np.arange(len(texts)), best]
                # Certainty from at most 50 letters' worth of evidence, so that it stays comparable over lengths.
                share = np.exp((least[:, None] - cost) * np.minimum(letters, 50)[:, None])
                some = letters > 0
                names += [model.languages[b] if s else "und" for b, s in zip(best, some, strict=True)]
                scores.append(np.where(some, 1 / share.sum(1), 0.0))
                costs.append(np.where(some, least, np.nan))
                limit = model.mean[best] + MARGIN + ERRORS * model.spread[best] / np.sqrt(np.maximum(letters, 1))
                out.append(~some | (least > limit))
            flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.empty(0), kind)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(names, pa.string()), flat(scores, pa.float64()), flat(costs, pa.float64()), flat(out, pa.bool_())],
                [*(c for c in batch.schema.names if c != "text"), "lang_pred", "score", "cross_entropy", "rejected"],
            )

    return predict


def _calibrate(sent):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        column = {n: i for i, n in enumerate(sent.value.languages)}
        for batch in batches:
            own, size = [], []
            names = batch.column("lang").to_pylist()
            for first, texts in column_blocks(batch.column("text")):
                cost, letters = scorer.texts(texts)
                own += [cost[i, column[names[first + i]]] if names[first + i] in column else np.nan for i in range(len(texts))]
                size += letters.tolist()
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(own, pa.float64()), pa.array(size, pa.int64())], ["lang", "cost", "letters"])

    return measure


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def learn(labelled: DataFrame, *, order: int = ORDER, sample: int = SAMPLE, grams: int = GRAMS) -> Model:
    """Model from rows (doc_id, text, lang); rows of null text or language are left out.

    Every language's finished table keeps the n-grams that make up at least 1/``grams`` of their order's occurrences.
    """
    rows = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample)) / F.count(F.lit(1))).alias("share"))
    draw = (F.xxhash64(F.lit("lang"), "doc_id") / 2.0**64 + 0.5).alias("draw")
    picked = rows.select("*", draw).join(materialize(share, "lang-share"), "lang").where(F.col("draw") < F.col("share"))
    picked = materialize(picked.select("lang", "text", (F.col("draw") < F.col("share") * 0.2).alias("aside")), "lang-sample")
    counts = picked.where("not aside").select("lang", "text").mapInArrow(_count_grams(order), "lang string, gram string, n long")
    counts = materialize(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "lang-grams")
    model = train(counts, order, grams=grams)
    spark = labelled.sparkSession
    k = len(model.languages)
    model.mean, model.spread = np.full(k, 2.0), np.full(k, 3.0)
    if k:
        measured = picked.where("aside").select("lang", "text").mapInArrow(_calibrate(spark.sparkContext.broadcast(model)), "lang string, cost double, letters long")
        measured = measured.where("letters > 0 and not isnan(cost)")
        stats = measured.groupBy("lang").agg((F.sum(F.col("cost") * F.col("letters")) / F.sum("letters")).alias("mean"))
        stats = materialize(measured, "lang-measured").join(stats, "lang").groupBy("lang").agg(F.first("mean").alias("mean"), F.sqrt(F.avg(F.col("letters") * (F.col("cost") - F.col("mean")) ** 2)).alias("spread"))
        for r in stats.collect():  # one row per language
            i = model.languages.index(r["lang"])
            model.mean[i], model.spread[i] = r["mean"], max(r["spread"], 0.5)
    return model


ADDED = ("lang_pred", "score", "cross_entropy", "rejected")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` but ``text`` and those it adds: lang_pred, score, cross_entropy, rejected."""
    rest = [c for c in docs.columns if c not in ("text", *ADDED)]
    if not model.languages:
        return docs.select(*(F.col(f"`{c}`") for c in rest), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    rows = docs.select(as_struct(rest, "row"), "text")
    kinds = f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double, cross_entropy double, rejected boolean"
    found = rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), kinds)
    return found.select(*(F.col("row")[c].alias(c) for c in rest), *ADDED)


def _keep(sent):
    """The rows whose text is not rejected; a text is sent once, inside its row."""
    predict = _predict(sent)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, again = itertools.tee(batches)
        found = predict(pa.RecordBatch.from_arrays([b.column("row").field("text")], ["text"]) for b in again)
        for batch, judged in zip(rows, found, strict=True):
            yield batch.filter(pc.invert(judged.column("rejected")))

    return keep


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose language is not rejected, all columns as they were."""
    if not model.languages:
        return docs.where(F.lit(False))
    rows = docs.select(as_struct(docs.columns, "row"))
    kept = rows.mapInArrow(_keep(docs.sparkSession.sparkContext.broadcast(model)), rows.schema)
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")
