"""Quality classifier by importance resampling over hashed n-gram models.

Two generative models count hashed byte n-grams (n = 4 and 8): the raw model over all documents, the target
model over labelled good ones (a bounded sample, see LABELLED). A document's mean is the mean log ratio of target to
raw over its n-grams (with a few grams of ratio 0 added). A fifth of the labelled rows is kept out of the target
model; the level that parts its good rows from its bad ones best (balanced accuracy) stands for the weight 1.

Resampling: a document's log importance weight is its mean against that level times LENGTH, the grams that a document
counts for whatever its size; so weights of long and short documents compare, and the draw has a say. Its key is the
log weight plus standard Gumbel noise from a hash of its id, and the documents of the k largest keys are drawn, which
is sampling without replacement in proportion to the weights. The rate is stated by the weights: k is the number of
documents whose weight is over 1. Documents well above the level (by some nats) stay and those well below it go;
within a few nats of it the noise decides. One seed gives one draw. All documents are scored and whole texts counted.

Defined results: a null or empty text has the grams of its line ends only; without good labels, or without bad
ones held out, there is nothing to learn from and all rows stay; labels for unknown documents are ignored, of
repeated labels of a document the lowest counts, of rows that repeat a labelled doc_id the lowest mean is held
against its label; ties in key go to the smaller doc_id; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._common import numbered, table, written
from gridloom.llm._counts import summed_cells

#: Most labelled rows used, those with the least hash of their id: the documented bound of the sample.
LABELLED = 40_000
GRAMS, BITS = (4, 8), 18
CELLS = len(GRAMS) << BITS
KAPPA = 4.0  # counts in a cell that the ratio starts to trust
UNIT = 1 << 16  # log ratios are whole numbers of 1/UNIT, so that sums do not depend on batches
PRIOR = 128  # grams of ratio 0 that stand in each mean, so that a few odd grams don't decide over a short text
LENGTH, SEED = 128, 17  # grams that a document's weight stands for, in nats a gram
MULTIPLIER = 0x9E3779B97F4A7C15


def gram_cells(texts: list[bytes]):
    """Cells of all n-grams of the texts, each between line ends: for each n, cells by place and whether one starts there; and the texts' offsets."""
    import numpy as np

    from gridloom.llm._words import joined

    buf, offsets = joined([t + b"\n" for t in texts], b"\n")
    end = int(offsets[-1])
    eight = np.ndarray((end,), "<u8", buf, strides=(1,))
    out = []
    for k, n in enumerate(GRAMS):
        grams = eight if n == 8 else eight & np.uint64((1 << 8 * n) - 1)
        cells = ((grams * np.uint64(MULTIPLIER)) >> np.uint64(64 - BITS)).astype(np.int64) + (k << BITS)
        inside = np.ones(end, bool)
        for back in range(1, n):
            inside[np.maximum(offsets[1:] - back, offsets[:-1])] = False
        out.append((cells, inside))
    return out, offsets


def log_ratios(raw, target):
    """Whole numbers of 1/UNIT for each cell; cells of few counts are drawn to 0."""
    import numpy as np

    out = np.zeros(CELLS, np.int64)
    for k in range(len(GRAMS)):
        at = slice(k << BITS, (k + 1) << BITS)
        expected = raw[at] * (target[at].sum() / max(1, raw[at].sum()))
        out[at] = np.round(np.log((target[at] + KAPPA) / (expected + KAPPA)) * UNIT)
    return out


def labelled_sample(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """_id, good, held: at most ``most`` rows, so small enough to broadcast."""
    mark = F.xxhash64(F.lit(SEED), "doc_id")
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") >= 1).alias("good"))
    return one.withColumn("_mark", mark).orderBy("_mark", "doc_id").limit(most).select(F.col("doc_id").alias("_id"), "good", (F.pmod("_mark", F.lit(5)) == 0).alias("held"))


def score(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """doc_id, text_hash, n_grams, total (of 1/UNIT), good and held (null without a label) for each row."""
    import numpy as np

    sample = written(labelled_sample(labels, labelled), "labelled")
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("_id"), "left")
    known = rows.select("text", (F.col("good") & ~F.col("held")).alias("fit"))

    def count(batch):
        from gridloom.llm._words import text_slices

        both = np.zeros(2 * CELLS, np.int64)
        for piece in text_slices(batch):
            grams, offsets = gram_cells(piece.column(0).to_pylist())
            fit = np.repeat(piece.column(1).fill_null(False).to_numpy(zero_copy_only=False), np.diff(offsets))
            for cells, inside in grams:
                both[:CELLS] += np.bincount(cells[inside], minlength=CELLS)
                both[CELLS:] += np.bincount(cells[inside & fit], minlength=CELLS)
        return both

    counts = summed_cells(known, 2 * CELLS, count)
    ratios = log_ratios(counts[:CELLS], counts[CELLS:])
    shared = docs.sparkSession.sparkContext.broadcast(ratios.astype(np.int32))  # CELLS numbers: 2 MB

    def weigh(batches):
        import pyarrow as pa

        from gridloom.llm._words import text_slices

        weights = shared.value
        for batch in batches:
            for piece in text_slices(batch, 1):
                grams, offsets = gram_cells(piece.column(1).to_pylist())
                total, n = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
                for cells, inside in grams:
                    for into, values in ((total, np.where(inside, weights[cells], 0)), (n, inside)):
                        ends = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[offsets]
                        into += np.diff(ends)
                columns = [piece.column(0), *(piece.column(c) for c in (2, 3, 4)), pa.array(n), pa.array(total)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "good", "held", "n_grams", "total"])

    schema = "doc_id long, text_hash long, good boolean, held boolean, n_grams long, total long"
    return rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), "good", "held").mapInArrow(weigh, schema)


def threshold(scores: DataFrame) -> float | None:
    """The mean log ratio (of 1/UNIT) that parts the held-out labels best; None if there is nothing to learn from.
    Collects a row for each labelled document, so LABELLED at most."""
    import numpy as np

    mean = F.col("total") / (F.col("n_grams") + PRIOR)
    rows = scores.where("good is not null").groupBy("doc_id").agg(F.first("held").alias("held"), F.first("good").alias("good"), F.min(mean).alias("mean")).toPandas()
    if not (rows.good & ~rows.held).any():
        return None
    held = rows[rows.held].sort_values("mean", ascending=False)
    good, means = held.good.to_numpy(bool), held["mean"].to_numpy()
    if not len(good) or good.all() or not good.any():
        return None
    kept, through = np.concatenate([[0], np.cumsum(good)]) / good.sum(), np.concatenate([[0], np.cumsum(~good)]) / (~good).sum()
    gain = kept - through
    at = np.flatnonzero(gain == gain.max())[-1]  # of equals the one that keeps most
    low, high = (means[at] if at < len(means) else means[-1] - UNIT), (means[at - 1] if at else means[0] + UNIT)
    return float((low + high) / 2)


def resample(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """doc_id, text_hash, n_grams, log_weight, sample_key, kept, good, held: one row for each document."""
    scores = written(score(docs, labels, labelled), "quality-scores")
    level = threshold(scores)
    mean = F.col("total") / (F.col("n_grams") + PRIOR)
    uniform = (F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id", "text_hash"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = scores.withColumn("log_weight", (mean - F.lit(level or 0.0)) * (LENGTH / UNIT)).withColumn("sample_key", F.col("log_weight") - F.log(-F.log(uniform)))
    names = ["doc_id", "text_hash", "n_grams", "log_weight", "sample_key", "kept", "good", "held"]
    if level is None:
        return keyed.withColumn("kept", F.lit(True)).select(*names)
    k = scores.where(mean > level).count()
    ranked = numbered(keyed.withColumn("_down", -F.col("sample_key")), ["_down", "doc_id", "text_hash"])
    return ranked.withColumn("kept", F.col("row_number") < k).select(*names)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    gone = resample(docs, labels).groupBy("doc_id", "text_hash").agg(F.max("kept").alias("_kept")).where(~F.col("_kept"))
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")) == F.col("_hash"))
    return docs.join(gone, same, "left_anti")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_grams", "log_weight", "sample_key", "kept")
