"""Quality by the perplexity of an interpolated modified Kneser-Ney model of characters.

The model counts the character n-grams of *all* trusted documents (labelled with quality
1).  Lower orders count the distinct left neighbours of a gram, each order has its own
three discounts from its counts of counts, and orders are interpolated.  Each distinct gram
of the corpus gets its log probability by joins on gram, context and suffix; documents get
theirs by the join of their sparse gram counts to it, sharded by gram (:mod:`.blocks`).
A word or line that repeats the one before it is a single symbol of its own, so that runs
of one word are rare events instead of common characters.  A document is rejected when its
perplexity exceeds a high quantile of the trusted documents' in its language, short texts
and others apart, as perplexities of short texts scatter more.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks, pretoken, runtime

ORDER, SYMBOL_BITS = 3, 16
#: Stands for a word or line that is equal to the one before it; no character.
AGAIN = "\uffff"
_LINES, _WORDS = re.compile(r"^(.++)(?:\n\1$)+", re.MULTILINE), re.compile(r"(?<!\S)(\S++)(?:\s++\1(?!\S))+")
#: Texts of fewer characters, repetitions included, have thresholds of their own.
SHORT = 100
#: Share of the trusted documents of a language that its threshold keeps.
QUANTILE = 0.997
#: Logarithms of perplexities are compared in steps, which bounds their histogram.
STEP = 0.001
#: Rows of ids or languages that are broadcast, at most; beyond, they are shuffled.
FEW = 1_000_000
BLOCK_CHARS, PART_CHARS = 3_000_000, 500_000
_MASK = (1 << SYMBOL_BITS) - 1
_EDGE = 10


def marked(text: str) -> str:
    """The text with ``AGAIN`` for each repetition of a line or word, and of the space before it."""
    text = _LINES.sub(lambda m: m[1] + AGAIN * ((len(m[0]) + 1) // (len(m[1]) + 1) - 1), text)
    return _WORDS.sub(lambda m: m[1] + AGAIN * (len(m[0].split()) - 1), text)


def grams(text: str) -> Iterator[np.ndarray]:
    """The n-grams of a text once marked, between line ends, as integers of 16 bits per character; those beyond U+FFFF fold onto others.

    ``PART_CHARS`` come at a time, so that long texts take no more memory than their code points.
    """
    points = pretoken.code_points("\n" * (ORDER - 1) + marked(text) + "\n")
    for at in range(0, len(points) - ORDER + 1, PART_CHARS):
        part = points[at : at + PART_CHARS + ORDER - 1].astype(np.int64) & _MASK
        out = np.zeros(len(part) - ORDER + 1, np.int64)
        for k in range(ORDER):
            out = (out << SYMBOL_BITS) | part[k : k + len(out)]
        yield out


def merged(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of distinct keys, in their order, summed up over several such lists."""
    keys, code = np.unique(np.concatenate([k for k, _ in counts]), return_inverse=True)
    return keys, np.bincount(code, np.concatenate([n for _, n in counts]), len(keys)).astype(np.int64)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, in order, and how often each comes."""
    parts = (np.unique(part, return_counts=True) for part in grams(text))
    return functools.reduce(lambda total, part: merged([total, part]), parts)


def _extract(rows: Iterator[tuple]) -> Iterator[blocks.Counts]:
    """Blocks of documents' gram counts; a row is (doc_id, lang, row, text).

    Each text is counted on its own, so a block takes memory for its documents' distinct
    grams, neither for every character nor for every pair of a document and a gram.
    """

    def block(ids: list, sizes: list[int], owners: list[int], found: list[tuple]) -> blocks.Counts:
        if not found:
            return blocks.Counts(ids, sizes, *(np.zeros(0, np.uint32) for _ in range(3)), np.zeros(0, np.int64))
        own = np.repeat(np.array(owners, np.uint32), [len(k) for k, _ in found])
        freq = np.concatenate([n for _, n in found])
        keys, code = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        return blocks.Counts(ids, sizes, own, code.astype(np.uint32), freq, keys)

    ids, sizes, owners, found, size = [], [], [], [], 0
    for *own, text in rows:
        if text:
            owners.append(len(ids))
            keys, n = gram_counts(text)
            found.append((keys, n.astype(np.uint32)))
        ids.append(tuple(own))
        sizes.append(len(text))
        size += len(text) + 1
        if size >= BLOCK_CHARS:
            yield block(ids, sizes, owners, found)
            ids, sizes, owners, found, size = [], [], [], [], 0
    if ids:
        yield block(ids, sizes, owners, found)


GRAM_COUNTS = pa.schema([("gram", pa.int64()), ("c", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        keys, n = merged(held)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], schema=GRAM_COUNTS)

    for (text,) in runtime.rows_of(batches):
        if text:
            held.append(gram_counts(text))
            size += len(text)
        if size > BLOCK_CHARS:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _discounts(level: DataFrame) -> list[float]:
    """Discounts of counts 1, 2, and 3 or more, from four counts of counts."""
    row = level.select(*(F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    n = [row[f"n{k}"] for k in (1, 2, 3, 4)]
    if not all(n):
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k + 1 - (k + 1) * y * n[k + 1] / n[k], 0.05), k + 0.95) for k in range(3)]


def kneser_ney(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, logp) of each wanted gram, given (gram, c) counts of trusted text."""
    levels = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << (SYMBOL_BITS * n)) - 1))
        levels[n] = runtime.stored(levels[n + 1].groupBy(suffix.alias("gram")).agg(F.count("*").alias("c")))
    out = wanted.select("gram").withColumn("p", F.lit(1.0 / (1 << SYMBOL_BITS)))
    for n in range(1, ORDER + 1):
        d = _discounts(levels[n])
        seen = levels[n].withColumn("d", F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2]))
        context = F.shiftright("gram", SYMBOL_BITS)
        sums = F.sum("c").alias("total"), F.sum("d").alias("mass")
        own = F.col("gram").bitwiseAND(F.lit((1 << (SYMBOL_BITS * n)) - 1))
        out = out.withColumn("g", own).withColumn("h", F.shiftright(own, SYMBOL_BITS))
        own = seen.select(F.col("gram").alias("g"), "c", "d")
        if n == 1:  # the empty context alone, and at most a row per symbol
            whole = seen.agg(*sums).first()
            out = out.join(F.broadcast(own), "g", "left").withColumns({k: F.lit(whole[k]).cast("double") for k in ("total", "mass")})
        else:
            contexts = seen.groupBy(context.alias("h")).agg(*sums)
            out = out.join(own, "g", "left").join(F.broadcast(contexts) if n == 2 else contexts, "h", "left")
        over = F.coalesce((F.col("c") - F.col("d")) / F.col("total"), F.lit(0.0))
        out = out.select("gram", F.coalesce(over + F.col("mass") / F.col("total") * F.col("p"), F.col("p")).alias("p"))
    return out.select("gram", F.log("p").alias("logp"))


def _as_shards(model: DataFrame, shards: int) -> DataFrame:
    """Gram values as rows for :func:`.blocks.answered`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = batch["gram"].to_numpy(), batch["logp"].to_numpy()
            shard = blocks.shard_of(keys, shards)
            yield runtime.emit(blocks.BLOCKS, [("", int(s), runtime.pack((keys[shard == s], values[shard == s]))) for s in np.unique(shard)])

    return model.mapInArrow(run, "block string, shard int, data binary")


def _answer(rows: Iterator[tuple]) -> Iterator[tuple]:
    now, keys, values, sorted_ = None, [], [], None
    for block, shard, data in rows:
        if shard != now:
            now, keys, values, sorted_ = shard, [], [], None
        a, b = runtime.unpack(data)
        if not block:
            keys.append(a)
            values.append(b)
            continue
        if sorted_ is None:
            order = np.argsort(k := np.concatenate(keys))
            sorted_ = k[order], np.concatenate(values)[order]
        yield block, shard, runtime.pack((b, sorted_[1][np.searchsorted(sorted_[0], blocks.keys_of(a))]))


KEYS = pa.schema([("gram", pa.int64())])


def _dictionary(rows: Iterator[tuple]) -> Iterator[tuple]:
    for _, _, data in rows:
        yield from ((k,) for k in blocks.keys_of(runtime.unpack(data)[0]).tolist())


SCORED = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("row", pa.int64()), ("chars", pa.int64()), ("n_grams", pa.int64()), ("log_perplexity", pa.float64())])
SCORED_DDL = "doc_id long, lang string, row long, chars long, n_grams long, log_perplexity double"


def row_key() -> Column:
    """Tells a row from others of its doc_id, or without one, by its language and text."""
    return F.xxhash64(F.col("lang").cast("string"), F.coalesce(F.col("text"), F.lit("")))


def some(ids: DataFrame) -> DataFrame:
    """Broadcast if it has few rows."""
    return F.broadcast(ids) if ids.count() <= FEW else ids


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(doc_id, lang, row, chars, n_grams, log_perplexity) of every row, by a model of the texts whose doc_id is in ``trusted``."""
    spark = runtime.tune(docs.sparkSession)
    shards = runtime.shards(spark)
    texts = runtime.with_text(docs, F.col("lang").cast("string").alias("lang"), row_key().alias("row"))
    learnt = texts.join(some(trusted), "doc_id", "left_semi").select("text").mapInArrow(_counted, "gram long, c long")
    counts = runtime.stored(learnt.groupBy("gram").agg(F.sum("c").alias("c")))
    packed = runtime.stored(blocks.packed(texts, _extract, shards))
    wanted = packed.where(F.col("shard") != blocks.COUNTS).mapInArrow(runtime.by_rows(_dictionary, KEYS, 50_000), "gram long").distinct()
    model = kneser_ney(counts, runtime.stored(wanted))
    answers = blocks.answered(packed, _as_shards(model, shards), _answer, shards)
    finish = lambda ids, chars, total, n: (*ids, chars, round(n), -total / n if n else None)
    return blocks.summed(packed, answers, shards, finish, SCORED, SCORED_DDL)


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, row, n_grams, perplexity, threshold, rejected) of every row; ``row`` is its :func:`row_key`.

    ``labels`` has (doc_id, quality); documents with quality 1 are trusted.  ``threshold``
    is the ``quantile`` of the trusted documents' perplexity in the row's language, among
    those short or not as the row is; where there are none, of all in the language, then of
    all short or not, then of all.  ``n_grams`` counts repetitions as one each.  A null or empty text has no perplexity and
    is not rejected; without trusted documents nothing is.  A null doc_id stays null and
    is judged like others; repeated rows give repeated results; an empty table gives none.
    Columns besides doc_id, text, lang and quality are not read.
    """
    trusted = runtime.stored(labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct())
    scored = runtime.stored(perplexities(docs, trusted))
    step = F.ceil(F.col("log_perplexity") / STEP)
    scored = scored.withColumn("short", F.col("chars") < SHORT)
    sample = scored.where("n_grams > 0").join(some(trusted), "doc_id", "left_semi").groupBy("lang", "short", step.alias("at")).agg(F.count("*").alias("n"))
    # A row per language, size and step, so few per language.
    sample = runtime.stored(sample)
    known = sample.where("lang IS NOT NULL")
    over = lambda *by: _threshold((known if "lang" in by else sample).groupBy(*by, "at").agg(F.sum("n").alias("n")), list(by), quantile)
    by_size = {r["short"]: r["limit"] for r in over("short").collect()}
    pooled = over().first()
    rest = F.coalesce(*(F.when(F.col("short") == k, F.lit(v)) for k, v in by_size.items()), F.lit(pooled["limit"] if pooled else None).cast("long"))
    found = scored.join(some(runtime.stored(over("lang", "short"))), ["lang", "short"], "left")
    found = found.join(some(runtime.stored(over("lang").withColumnRenamed("limit", "of_lang"))), "lang", "left")
    found = found.withColumn("limit", F.coalesce("limit", "of_lang", rest))
    return found.select("doc_id", "lang", "row", "n_grams", F.exp("log_perplexity").alias("perplexity"), F.exp(F.col("limit") * STEP).alias("threshold"), F.coalesce(step > F.col("limit"), F.lit(False)).alias("rejected"))


def classified(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, n_grams, perplexity, threshold, rejected) of every row, as :func:`judged` gives them."""
    return judged(docs, labels, quantile).drop("row")


def _threshold(sample: DataFrame, by: list[str], quantile: float) -> DataFrame:
    """The smallest step up to which ``quantile`` of the rows lie."""
    part = Window.partitionBy(*by)
    upto = sample.withColumn("upto", F.sum("n").over(part.orderBy("at"))).withColumn("all", F.sum("n").over(part))
    return upto.where(F.col("upto") >= F.lit(quantile) * F.col("all")).groupBy(*by).agg(F.min("at").alias("limit"))


def accepted(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The rows that aren't rejected; each row's own verdict decides, also without a doc_id."""
    gone = judged(docs, labels, quantile).where("rejected").select(F.col("doc_id").alias("_gone"), F.col("row").alias("_row")).distinct()
    gone = runtime.stored(gone)
    return docs.join(some(gone), docs.doc_id.eqNullSafe(gone["_gone"]) & (row_key() == gone["_row"]), "left_anti")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(runtime.read(spark, sf_dir, "documents"), runtime.read(spark, sf_dir, "labels"))
