"""Mixing sources to target shares along a time-varying curriculum.

A plan wants ``target_share`` of its tokens from each source.  A source's weight runs linearly over training time,
``share * (1 + g * (2t - 1))``: sources of short documents lead, sources of long ones follow, and at every moment the weights
sum to the plan's shares.  The integral of a weight is the source's cumulative demand; inverting it at the tokens that precede
a copy of a document in its (shuffled, repeated) source gives the copy's position in training, and copies are range-sorted
by it.  A source that is too small is repeated, each document at most ``max_repeats`` times; if even so it cannot meet its
demand, its last copy ends before training does.  The report is read off the sorted sequence: what each
source got in all and in either half of it, and how far it reached.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.operators.positions import running
from vecloom.sources.tables import durable, ship_code, small_enough

#: A rank file of a public byte-level vocabulary, and the pattern that splits text before its merges (fixed value).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: How strongly weights move over time, below 1.
TILT = 0.8


def source_name(source: Column) -> Column:
    """One spelling per source: lower case, blanks and hyphens as underscores; blank is no source."""
    name = F.regexp_replace(F.lower(F.trim(source)), r"[\s\-_]+", "_")
    return F.when(name != "", name)


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens): every document's size; a null text has 0 tokens, a null source stays null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            sizes = [len(encode(t.as_py())) if t.is_valid else 0 for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "tokens"])

    ship_code(documents.sparkSession)
    lean = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_name(F.col("source")).alias("source"), "text")
    return lean.mapInArrow(count, "doc_id bigint, source string, tokens bigint")


def schedule(counts: DataFrame, targets: DataFrame, tilt: float = TILT) -> DataFrame:
    """Per row of ``targets``: (plan, source, target_share, max_repeats, size, demand, supply, g).

    ``size`` is the plan's wanted size in tokens, ``demand`` the source's part, ``supply`` what its documents hold once.
    Repeated target rows count once.  A source without documents has supply 0.
    """
    total = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    held = counts.where("source is not null").groupBy("source").agg(F.sum("tokens").alias("supply"), F.avg("tokens").alias("length"))
    wanted = targets.select("plan", source_name(F.col("source")).alias("source"), "target_share", "corpus_multiple", "max_repeats").where("plan is not null and source is not null").distinct()
    rows = wanted.join(held, "source", "left").withColumn("total", F.lit(total))
    by = W.partitionBy("plan")
    share, length = F.coalesce("target_share", F.lit(0.0)), F.coalesce("length", F.lit(0.0))
    mean = F.sum(share * length).over(by) / F.greatest(F.sum(share).over(by), F.lit(1e-12))
    rows = rows.withColumn("lean", length - mean).withColumn("widest", F.max(F.abs("lean")).over(by))
    supply = F.coalesce("supply", F.lit(0))
    demand = share * F.coalesce("corpus_multiple", F.lit(0.0)) * F.col("total")
    return rows.select(
        "plan", "source", share.alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"),
        (F.coalesce("corpus_multiple", F.lit(0.0)) * F.col("total")).alias("size"), demand.alias("demand"), supply.alias("supply"),
        F.when(F.col("widest") > 0, tilt * F.col("lean") / F.col("widest")).otherwise(0.0).alias("g"),
    )


def offsets(counts: DataFrame, ranges: int | None = None) -> DataFrame:
    """(doc_id, source, tokens, offset): tokens of the source before the document, in a fixed shuffled order.

    A source with a third of all documents is cut into ranges like any other.
    """
    placed = counts.where("source is not null").withColumn("h", F.xxhash64(F.lit("order"), "doc_id"))
    return running(placed, ["source"], "h", ["doc_id", "tokens"], "tokens", "offset", ranges).select("doc_id", "source", "tokens", "offset")


def when_reached(part: Column, g: Column) -> Column:
    """The time at which ``part`` of a weight's integral is used: t of  t + g (t^2 - t) = part, for g between -1 and 1."""
    b = 1.0 - g
    return 2.0 * part / (b + F.sqrt(b * b + 4.0 * g * part))


def assignments(counts: DataFrame, plan_rows: DataFrame) -> DataFrame:
    """(plan, source, doc_id, copy, tokens, position, until): every placed copy.

    ``position`` and ``until`` are the times, in tokens from the plan's start, at which the source's cumulative demand reaches the copy's
    first token and has used its last; the copy with which the demand is met lasts until the end.  A copy is placed if it starts within
    the demand.  Empty documents are not placed.
    """
    bounded = F.broadcast(plan_rows) if small_enough(plan_rows, 200, 4 * 2**20) else plan_rows
    docs = offsets(counts).where("tokens > 0").join(bounded, "source")
    copies = docs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(F.col("max_repeats") - 1, F.lit(0)))))
    start = F.col("offset") + F.col("copy") * F.col("supply")
    placed = copies.withColumn("start", start).where((F.col("start") < F.col("demand")) & (F.col("copy") < F.col("max_repeats")))
    end = F.col("start") + F.col("tokens")
    time = lambda tokens: when_reached(tokens / F.col("demand"), F.col("g")) * F.col("size")
    until = F.when(end >= F.col("demand"), F.col("size")).otherwise(F.least(time(end), F.col("size")))
    return placed.select("plan", "source", "doc_id", F.col("copy").cast("int").alias("copy"), "tokens", time(F.col("start")).alias("position"), until.alias("until"))


def training_order(placed: DataFrame) -> DataFrame:
    """The copies range-sorted by plan and position, with ``place``: the tokens of the plan's sequence before each.

    Lies in the shared folder, sorted within and across its partitions.
    """
    return running(placed, ["plan"], "position", ["source", "doc_id", "copy"], "tokens", "place")


def report(order: DataFrame, plan_rows: DataFrame) -> DataFrame:
    """(plan, source, target_share, actual_share, first_half_share, second_half_share, demand, supply, placed_tokens, copies, reached, size,
    short) per target row, from the training order.

    The halves are those of the plan's sequence by tokens placed.  ``reached`` is the time at which the source's last copy ends; ``short``
    says that this is before the end of training: with every repeat allowed, the source falls short of its demand.  A source without
    any copy reached 0, and is short if anything was demanded.
    """
    lengths = order.groupBy("plan").agg(F.sum("tokens").alias("sequence"))  # a row per plan
    lengths = F.broadcast(lengths) if small_enough(lengths, 64, 2**20) else lengths
    halved = order.join(lengths, "plan").withColumn("early", F.when(F.col("place") * 2 < F.col("sequence"), F.col("tokens")).otherwise(0))
    got = halved.groupBy("plan", "source").agg(F.sum("tokens").alias("placed_tokens"), F.sum("early").alias("early"), F.count("*").alias("copies"), F.max("until").alias("reached"))
    none = {"placed_tokens": 0, "early": 0, "copies": 0, "reached": 0.0}
    rows = plan_rows.join(got, ["plan", "source"], "left").na.fill(none)
    by = W.partitionBy("plan")
    share = lambda part: F.when(F.sum(part).over(by) > 0, part / F.sum(part).over(by)).otherwise(0.0)
    late = F.col("placed_tokens") - F.col("early")
    short = (F.col("demand") > 0) & (F.col("reached") < F.col("size"))
    return rows.select(
        "plan", "source", "target_share", share(F.col("placed_tokens")).alias("actual_share"), share(F.col("early")).alias("first_half_share"), share(late).alias("second_half_share"),
        "demand", "supply", "placed_tokens", "copies", "reached", "size", short.alias("short"),
    )


class Mix:
    """A mix of ``documents`` for all plans of ``targets``; documents are tokenised once."""

    def __init__(self, documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, tilt: float = TILT):
        self.counts = durable(token_counts(documents, vocabulary))
        self.plans = durable(schedule(self.counts, targets, tilt))
        self.sequence = training_order(assignments(self.counts, self.plans))

    def order(self) -> DataFrame:
        return self.sequence

    def report(self) -> DataFrame:
        return report(self.sequence, self.plans)
