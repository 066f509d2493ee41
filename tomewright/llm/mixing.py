"""Mixing sources to target weights (operator 6): exact length counts and a bounded-knapsack fit."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tomewright.llm.text import count_words, payload
from tomewright.sources.artifacts import staged

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_COPIES = 2
TICKET_BITS = 10


@F.arrow_udf(LongType())
def n_words(text: pa.Array) -> pa.Array:
    return pa.array([count_words(data) for data in payload(text)], pa.int64())


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE) -> dict[str | None, float]:
    """Words to take from each source.

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` times all words.  A target above ``MOST_COPIES`` times its source
    is held there, and what is left is shared by weight among the others until
    none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        wanted = {s: left * weight[s] / total for s in open_}
        above = [s for s in open_ if wanted[s] > MOST_COPIES * sizes[s]]
        if not above:
            return out | wanted
        for s in above:
            out[s] = float(MOST_COPIES * sizes[s])
        left -= sum(out[s] for s in above)
        open_ = [s for s in open_ if s not in out]
    return out


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = 1 << 16) -> np.ndarray:
    """How many documents of each size to take, so that their words sum to ``budget`` or as near below as can be.

    All lengths first give the same fraction, with rounding carried from long to
    short; the last ``dp_words`` of the budget, or all of a smaller one, are
    fitted by dynamic programming over the sums that the remaining documents can
    reach (bounded knapsack with counts split in powers of two).
    """
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    total, take = int((sizes * counts).sum()), np.zeros(len(sizes), np.int64)
    if budget >= total:
        return counts
    order = np.argsort(-sizes, kind="stable")
    fraction, carry = max(0, budget - dp_words) / max(total, 1), 0.0
    for i in order:
        if sizes[i] > 0:
            carry += fraction * float(sizes[i] * counts[i])
            take[i] = min(counts[i], int(carry // sizes[i]))
            carry -= float(take[i] * sizes[i])
    left = budget - int((sizes * take).sum())
    for i in order:  # rounding of very long documents can leave more than the programme is to fit
        if left > 2 * dp_words and sizes[i] > 0:
            more = min(int(counts[i] - take[i]), (left - dp_words) // int(sizes[i]))
            take[i], left = take[i] + more, left - more * int(sizes[i])
    mask, reach, steps = (1 << (left + 1)) - 1, 1, []
    for i in order:
        room = min(int(counts[i] - take[i]), left // int(sizes[i])) if sizes[i] > 0 else 0
        part = 1
        while room > 0 and not reach >> left & 1:
            part = min(part, room)
            steps.append((i, part, reach))
            reach |= reach << (part * int(sizes[i])) & mask
            room, part = room - part, 2 * part
    rest = reach.bit_length() - 1
    for i, part, before in reversed(steps):
        if not before >> rest & 1:
            take[i] += part
            rest -= part * int(sizes[i])
    return take


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, seed: int = 17, dp_words: int = 1 << 16) -> DataFrame:
    """Mix documents: ``doc_id, size, source_size, target, taken``.

    ``size`` is the number of words; ``target`` are the words wanted of the
    document's source, ``taken`` those the mix takes of the document, with
    repeats: nothing, once or twice its size.  Which documents of one source and
    size are taken follows from hashes of their ids, so reruns agree.

    One row per source comes to the driver, since each has a weight there, and
    only distinct lengths of a source meet in one task.  Documents of one length are numbered
    within ``2 ** TICKET_BITS`` hash ranges, so that a length which many copies
    share is no hot group.  A null text has no words; a null source is a source
    of its own; a null ``doc_id`` hashes as a value of its own; rows that repeat
    an id are drawn one by one; no rows give no rows.  Other columns are not read.
    """
    ticket = F.xxhash64(F.lit(seed), docs["doc_id"])
    sized = staged(
        docs.select(
            docs["doc_id"], F.when(docs["source"].isNull(), "").otherwise(F.concat(F.lit("="), docs["source"])).alias("key"),
            n_words(docs["text"]).alias("size"), ticket.alias("ticket"),
            F.shiftrightunsigned(ticket, 64 - TICKET_BITS).cast("int").alias("range"),
        ),
        "sizes",
    )
    by_range = staged(sized.groupBy("key", "size", "range").agg(F.count("*").alias("n")), "sizes_by_range")
    per_source = {r["key"]: r["n"] for r in by_range.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("n")).collect()}
    named = {key: key[1:] if key else None for key in per_source}
    wanted = targets({named[k]: n for k, n in per_source.items()}, weights, share)
    plan = {k: (per_source[k], wanted[named[k]]) for k in per_source}

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        """Full rounds of the source and the number of documents of each size in the last, partial one."""
        have, target = plan[rows["key"].iat[0]]
        rounds = min(MOST_COPIES, int(target // have)) if have else 0
        take = fit_budget(rows["size"].to_numpy(), rows["n"].to_numpy(), round(target - rounds * have), dp_words)
        return pd.DataFrame(
            {"key": rows["key"], "size": rows["size"], "rounds": rounds, "take": take, "source_size": have, "target": float(target)}
        )

    lengths = by_range.groupBy("key", "size").agg(F.sum("n").alias("n"))
    fits = lengths.groupBy("key").applyInPandas(
        fitted, "key string, size long, rounds int, take long, source_size long, target double"
    )
    before = F.sum("n").over(W.partitionBy("key", "size").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    ranges = by_range.join(fits, ["key", "size"]).select(
        "key", "size", "range", "rounds", "source_size", "target",
        F.greatest(F.lit(0), F.col("take") - F.coalesce(before, F.lit(0))).alias("here"),
    )
    number = F.row_number().over(W.partitionBy("key", "size", "range").orderBy("ticket", "doc_id"))
    drawn = sized.join(ranges, ["key", "size", "range"]).withColumn("number", number)
    copies = F.col("rounds") + F.when(F.col("number") <= F.col("here"), 1).otherwise(0)
    return drawn.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
