"""Benchmark decontamination (operator 8): winnowed fingerprints, joined and extended to whole shared windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.llm.text import chunks, gram_hashes, payload, plain_words

WINDOW = 10
GRAM = 5
BLOCK_BYTES = 4 << 20
CHUNK_BYTES = 2 << 20
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def winnowed(hashes: np.ndarray, span: int) -> np.ndarray:
    """Positions of the (rightmost) smallest hash of each ``span`` consecutive ones; ``NONE`` is never picked."""
    count = len(hashes) - span + 1
    if count <= 0:
        return np.empty(0, np.int64)
    least = hashes[:count].copy()
    for j in range(1, span):
        np.minimum(least, hashes[j : j + count], out=least)
    place = np.arange(count)
    for j in range(1, span):
        np.copyto(place, np.arange(j, j + count), where=hashes[j : j + count] == least)
    picked = np.zeros(len(hashes), bool)
    picked[place[least != NONE]] = True
    return np.flatnonzero(picked)


@dataclass
class Windows:
    """Distinct windows of one length, and the fingerprints that lead to them."""

    length: int
    gram: int
    prints: np.ndarray  # sorted
    hashes: np.ndarray  # of the windows, sorted
    words: np.ndarray  # word numbers of the windows, one row each
    first: np.ndarray  # start of each window's items in ``owners``, and the end
    owners: np.ndarray
    longest_chain: int

    @classmethod
    def of(cls, items: list[tuple[int, np.ndarray]], length: int, gram: int) -> Windows:
        span = length - gram + 1
        prints, rows, owners = [], [], []
        for number, words in items:
            grams = gram_hashes(words.astype(np.uint64), gram)
            prints.append(grams[winnowed(grams, span)])
            rows.append(np.lib.stride_tricks.sliding_window_view(words, length))
            owners.append(np.full(len(rows[-1]), number))
        distinct, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), np.concatenate(owners)]), axis=1)
        hashes = cls.hashed(distinct)
        order = np.argsort(hashes, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        by_window = np.argsort(place[pairs[0]], kind="stable")
        first = np.searchsorted(place[pairs[0]][by_window], np.arange(len(order) + 1))
        chain = int(np.unique(hashes, return_counts=True)[1].max())
        return cls(
            length, gram, np.unique(np.concatenate(prints)), hashes[order], distinct[order].astype(np.int32),
            first, pairs[1][by_window].astype(np.int32), chain,
        )

    @staticmethod
    def hashed(rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(rows.shape[1]):
                total = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + rows[:, j].astype(np.uint64)
        return total

    def found(self, words: np.ndarray, unknown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of windows in ``words`` and their numbers; ``unknown`` counts the unknown words before each place."""
        grams = gram_hashes(words.astype(np.uint64), self.gram)
        grams[unknown[self.gram :] != unknown[: -self.gram]] = NONE
        picked = winnowed(grams, self.length - self.gram + 1)
        at = np.minimum(np.searchsorted(self.prints, grams[picked]), len(self.prints) - 1)
        seeds = picked[self.prints[at] == grams[picked]]
        starts = np.unique((seeds[:, None] - np.arange(self.length - self.gram + 1)).ravel())
        starts = starts[(starts >= 0) & (starts <= len(words) - self.length)]
        starts = starts[unknown[starts + self.length] == unknown[starts]]
        rows = words[starts[:, None] + np.arange(self.length)]
        hashes = self.hashed(rows)
        place, out_s, out_w = np.searchsorted(self.hashes, hashes), [], []
        for j in range(self.longest_chain):
            at = np.minimum(place + j, len(self.hashes) - 1)
            same = (self.hashes[at] == hashes) & (self.words[at] == rows).all(axis=1)
            out_s.append(starts[same])
            out_w.append(at[same])
        return np.concatenate(out_s), np.concatenate(out_w)


@dataclass
class Block:
    """Some benchmark items: numbers of their words, and their windows by length."""

    numbers: dict[bytes, int]
    names: list[str]
    windows: list[Windows]

    @classmethod
    def of(cls, items: list[tuple[str, str]], window: int, gram: int) -> Block:
        numbers: dict[bytes, int] = {}
        names, by_length = [], {}
        for name, text in items:
            words = np.array([numbers.setdefault(w, len(numbers)) for w in plain_words(text.encode())], np.int64)
            if len(words):
                by_length.setdefault(min(window, len(words)), []).append((len(names), words))
                names.append(name)
        # Winnowing sees every shared span of gram + span - 1 words; items below a window keep all their grams.
        windows = [Windows.of(v, n, min(gram, n) if n == window else n) for n, v in sorted(by_length.items())]
        return cls(numbers, names, windows)

    def search(self, texts: list[list[bytes]], spans: list[list], items: list[set[str]]) -> list[list]:
        """Merge what is found in each text's words into ``items`` and return the merged spans."""
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes + 1)
        begins = ends - sizes - 1
        get = self.numbers.get
        words = np.full(int(ends[-1]) + 1, -1, np.int64)
        for t, b in zip(texts, begins, strict=True):
            words[b : b + len(t)] = [get(w, -1) for w in t]
        unknown = np.concatenate([[0], np.cumsum(words < 0)])
        depth = np.zeros(len(words) + 1, np.int32)
        for b, known in zip(begins, spans, strict=True):
            for s in known:
                depth[b + s["start"]] += 1
                depth[b + s["end"]] -= 1
        for w in self.windows:
            if len(words) > w.length:
                starts, which = w.found(words, unknown)
                np.add.at(depth, starts, 1)
                np.add.at(depth, starts + w.length, -1)
                for doc, number in zip(np.searchsorted(ends, starts, side="right").tolist(), which.tolist(), strict=True):
                    items[doc].update(self.names[o] for o in w.owners[w.first[number] : w.first[number + 1]].tolist())
        hit = np.concatenate([[0], (np.cumsum(depth) > 0).view(np.int8)])
        change = np.flatnonzero(np.diff(hit))
        out: list[list] = [[] for _ in texts]
        for s, e in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
            doc = int(np.searchsorted(ends, s, side="right"))
            out[doc].append({"start": s - int(begins[doc]), "end": e - int(begins[doc])})
        return out


def _searching(block: Broadcast, last: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            data = payload(whole.column("text"))
            for a, b in chunks(map(len, data), CHUNK_BYTES):
                batch = whole.slice(a, b - a)
                words = [plain_words(d) for d in data[a:b]]
                items = [set(x) for x in batch.column("items").to_pylist()]
                spans = block.value.search(words, batch.column("spans").to_pylist(), items)
                kind = whole.schema.field("spans").type
                text = pa.nulls(b - a, pa.string()) if last else batch.column("text")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc"), text, pa.array([len(w) for w in words], pa.int64()), pa.array(spans, kind),
                        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    ],
                    ["doc", "text", "n_words", "spans", "items"],
                )

    return search


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM,
    block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None,
) -> DataFrame:
    """Spans of benchmark windows in each document: ``doc, n_words, spans, items``.

    ``doc`` holds the document's columns (all, or those in ``keep``).  Words are
    runs of letters and digits.  A window is ``window`` consecutive words of an
    item, or all words of a shorter one; ``spans`` are the maximal runs of words
    inside occurrences, ``items`` the sorted ids of items with an occurrence.

    Both sides keep the least hash of every ``window - gram + 1`` consecutive
    ``gram``-word hashes, so every shared window shares a fingerprint.  Equal
    fingerprints are extended to the windows around them, which are compared word by word.

    The benchmark is searched in blocks of about ``block_bytes`` of text, one
    broadcast each.  Each block passes through the driver by itself, but all broadcasts
    stay alive together in the chained stages, so the benchmark as a whole should
    be some tens of MB at most; documents are read once and stay where they are.

    Null texts have no words; a null item id counts as empty; items that repeat
    an id count once; repeated documents are judged one by one; no items mean no
    spans; no documents give no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(benchmark["item_id"].cast("string"), F.lit("")).alias("item"), F.coalesce(benchmark["text"], F.lit("")).alias("text")
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    columns = [docs[f"`{c}`"] for c in (docs.columns if keep is None else keep)]
    none = F.array().cast("array<struct<start: int, end: int>>")
    rows = docs.select(
        F.struct(*columns).alias("doc"), docs["text"].cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"),
        none.alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    for number in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == number)
        block = Block.of(sorted((r["item"], r["text"]) for r in part.collect()), window, gram)
        sent = spark.sparkContext.broadcast(block)
        rows = rows.mapInArrow(_searching(sent, number == n_blocks - 1), rows.schema)
    return rows.drop("text")


def digest(found: DataFrame) -> DataFrame:
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc.doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"]))


_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
SQL = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
b as (select coalesce(cast(item_id as varchar), '') as item, {_WORDS} as w from benchmark),
bw as (
    select distinct item, n, array_to_string(w[i : i + n - 1], ' ') as win
    from (select item, w, n, unnest(range(1, len(w) - n + 2)) as i
          from (select item, w, least(len(w), {WINDOW}) as n from b) where n > 0)
),
dw as (
    select r, n, i, array_to_string(w[i : i + n - 1], ' ') as win
    from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i
          from d, (select distinct n from bw) where len(w) >= n)
),
hits as (select r, n, i, win from dw where (n, win) in (select n, win from bw)),
words as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hits) group by r),
named as (
    select r, count(*) as n_items, string_agg(item, ',' order by item) as items
    from (select distinct h.r, bw.item from hits h join bw on h.n = bw.n and h.win = bw.win) group by r
)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words on words.r = d.r left join named on named.r = d.r
"""
