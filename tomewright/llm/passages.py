"""Substring dedup (operator 9): recurring passages, located by sharded Aho-Corasick automata."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import blake2b

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.llm.text import IS_WHITE, chunks, gram_hashes, mixed, payload
from tomewright.sources.artifacts import delete_at_end, new_path, staged

WINDOW = 20
GRAM = 8
BLOCK_BYTES = 4 << 20
CHUNK_BYTES = 1 << 20
#: Words of all passages in one automaton; a block with more compiles one after the other.
AUTOMATON_WORDS = 200_000
_BASE = 0x9E3779B97F4A7C15
#: A word is hashed in blocks of eight bytes; one of more than so many bytes, as a whole.
_LONG = 1 << 12


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts one after the other, start and end of each word in them, and the text that each word is from."""
    data = np.frombuffer(b" ".join([b"", *texts, b" " * 8]), np.uint8)
    edge = np.diff(IS_WHITE[data].view(np.int8))
    starts, ends = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    firsts = np.cumsum([1, *[len(t) + 1 for t in texts[:-1]]]) if texts else np.empty(0, np.int64)
    return data, starts, ends, np.searchsorted(firsts, starts, side="right") - 1


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A scramble of each word's length and blocks of eight bytes, one after the other.

    Every block is mixed by a bijection before the next one enters, so words of up
    to eight bytes and one length never share a hash, and no pattern of bytes cancels out.
    """
    size = ends - starts
    out = mixed(size.astype(np.uint64) + np.uint64(seed))
    left = np.flatnonzero(size <= _LONG)
    at = 0
    while len(left):
        begin, rest = starts[left] + at, np.minimum(size[left] - at, 8)
        block = np.zeros(len(left), np.uint64)
        for k in range(8):
            byte = data[begin + k].astype(np.uint64)
            block |= np.where(rest > k, byte, np.uint64(0)) << np.uint64(8 * k)
        out[left] = mixed(out[left] ^ block)
        at += 8
        left = left[size[left] > at]
    for k in np.flatnonzero(size > _LONG):
        whole = blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, salt=seed.to_bytes(16, "little"))
        out[k] = int.from_bytes(whole.digest(), "little")
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and the text each is from; a word is a run of anything but ASCII white space."""
    data, starts, ends, owner = word_spans(texts)
    return _hashed(data, starts, ends, 1), owner


def word_hash_pairs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``word_hashes`` with a second hash of each word that shares nothing with the first."""
    data, starts, ends, owner = word_spans(texts)
    return _hashed(data, starts, ends, 1), _hashed(data, starts, ends, 2), owner


def windows(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one text, and the hash and place of each one's anchor.

    The anchor is the window's (last) least ``GRAM``-word hash, so equal windows have equal anchors.
    """
    count = len(words) - WINDOW + 1
    if count <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    grams = gram_hashes(words, GRAM)
    least, place = grams[:count].copy(), np.arange(count)
    for j in range(1, WINDOW - GRAM + 1):
        here = grams[j : j + count]
        np.copyto(place, np.arange(j, j + count), where=here <= least)
        np.minimum(least, here, out=least)
    starts = np.flatnonzero(owner[:count] == owner[WINDOW - 1 :])
    return starts, least[starts], place[starts]


def _keys(words: np.ndarray, others: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """128-bit keys of the windows at ``starts``, as rows of two numbers, each from a hash of words of its own."""
    out = np.zeros((len(starts), 2), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(WINDOW):
            out[:, 0] = mixed(out[:, 0] * np.uint64(_BASE) + words[starts + j])
            out[:, 1] = mixed((out[:, 1] ^ others[starts + j]) + np.uint64(_BASE))
    return out


def _shard_of(hashes: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard by leading bits, so that sorted hashes fall into runs."""
    bits = n_shards.bit_length() - 1
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _by_shard(block: int, hashes: np.ndarray, packed: np.ndarray, n_shards: int) -> pa.RecordBatch:
    """One row per shard with what sorted ``hashes`` of it carry."""
    shards = _shard_of(hashes, n_shards)
    cut = np.flatnonzero(np.diff(shards, prepend=-1))
    parts = [p.tobytes() for p in np.split(packed, cut[1:])] if len(cut) else []
    return pa.RecordBatch.from_arrays(
        [pa.array(shards[cut], pa.int32()), pa.array([block] * len(cut), pa.int32()), pa.array(parts, pa.binary())],
        ["shard", "block", "packed"],
    )


def _anchors(n_shards: int):
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct anchors of a stretch of one block; those that occur at two places are given twice."""
        for batch in batches:
            blocks, data = batch.column("block").to_numpy(), payload(batch.column("text"))
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for first, last in zip(cuts, cuts[1:], strict=False):
                found, extra = [], []
                for a, b in chunks(map(len, data[first:last]), CHUNK_BYTES):
                    _, least, place = windows(*word_hashes(data[first + a : first + b]))
                    # Neighbouring windows share an anchor; the same hash at another place is another one.
                    values, n = np.unique(least[np.diff(place, prepend=-1) != 0], return_counts=True)
                    found.append(values)
                    extra.append(values[n > 1])
                if found:
                    every = np.sort(np.concatenate(found + extra))
                    yield _by_shard(int(blocks[first]), every, every, n_shards)

    return anchors


ROUTED = "shard int, block int, packed binary"


def _repeated(table: pa.Table) -> pa.Table:
    """For each block its anchors that occur at another place too."""
    blocks = table.column("block").to_numpy()
    parts = [np.frombuffer(p, np.uint64) for p in table.column("packed").to_pylist()]
    hashes, block = np.concatenate(parts), np.repeat(blocks, [len(p) for p in parts])
    order = np.argsort(hashes, kind="stable")
    hashes, block = hashes[order], block[order]
    again = np.concatenate([hashes[1:] == hashes[:-1], [False]])
    again[1:] |= again[:-1].copy()
    hashes, block = hashes[again], block[again]
    order = np.argsort(block, kind="stable")
    hashes, block = hashes[order], block[order]
    cut = np.flatnonzero(np.diff(block, prepend=-1))
    packed = [p.tobytes() for p in np.split(hashes, cut[1:])] if len(cut) else []
    return pa.table({"block": pa.array(block[cut], pa.int32()), "packed": pa.array(packed, pa.binary())})


class Candidates:
    """Windows of a block whose anchors recur, by distinct key in the order of keys."""

    def __init__(self, texts: list[bytes], repeated: np.ndarray):
        keys, doc, start = [np.empty((0, 2), np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a, b in chunks(map(len, texts), CHUNK_BYTES):
            words, others, owner = word_hash_pairs(texts[a:b])
            at, least, _ = windows(words, owner)
            at = at[np.isin(least, repeated)]
            keys.append(_keys(words, others, at))
            doc.append(owner[at] + a)
            first_word = np.searchsorted(owner, np.arange(b - a))
            start.append(at - first_word[owner[at]])
        keys, self.doc, self.start = np.concatenate(keys), np.concatenate(doc), np.concatenate(start)
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        keys, self.doc, self.start = keys[order], self.doc[order], self.start[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.empty(0, bool)
        self.keys = keys[new]
        self.number = np.cumsum(new) - 1
        self.count = np.bincount(self.number, minlength=len(self.keys))
        self.least = np.minimum.reduceat(self.start, np.flatnonzero(new)) if len(keys) else self.start


def _block_rows(docs: pa.Table) -> tuple[list[int | None], list[bytes]]:
    return docs.column("doc_id").to_pylist(), payload(docs.column("text").combine_chunks())


def _hashes_in(table: pa.Table) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64), *[np.frombuffer(p, np.uint64) for p in table.column("packed").to_pylist()]])


def _candidate_keys(n_shards: int, shared: np.ndarray):
    def candidate_keys(docs: pa.Table, repeated: pa.Table) -> pa.Table:
        if not docs.num_rows or not repeated.num_rows:
            return pa.table({"shard": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), "packed": pa.array([], pa.binary())})
        found = Candidates(_block_rows(docs)[1], _hashes_in(repeated))
        block = docs.column("block")[0].as_py()
        packed = np.column_stack([found.keys, found.least.astype(np.uint64)]) if shared[block] else found.keys
        return pa.Table.from_batches([_by_shard(block, found.keys[:, 0], packed, n_shards)])

    return candidate_keys


def _earlier(first: np.ndarray, shared: np.ndarray):
    def earlier(table: pa.Table) -> pa.Table:
        """For each block a bit per key, set if an earlier id's block has the key.

        Blocks that share one id are none earlier than the other; after its bits each gets the
        least start of every key in them.
        """
        order = np.argsort(table.column("block").to_numpy(), kind="stable")
        blocks = table.column("block").to_numpy()[order]
        texts = table.column("packed").to_pylist()
        parts = [np.frombuffer(texts[i], np.uint64).reshape(-1, 3 if shared[b] else 2) for i, b in zip(order, blocks, strict=True)]
        sizes = [len(p) for p in parts]
        keys, home = np.concatenate([p[:, :2] for p in parts]), np.repeat(first[blocks], sizes)
        start = np.concatenate([p[:, 2] if p.shape[1] == 3 else np.zeros(len(p), np.uint64) for p in parts])
        sort = np.lexsort((keys[:, 1], keys[:, 0]))  # stable: of equal keys that of the first block comes first
        keys, home = keys[sort], home[sort]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
        later, least = np.zeros(len(keys), bool), np.zeros(len(keys), np.uint64)
        later[sort] = home != home[np.flatnonzero(new)][np.cumsum(new) - 1]
        new[1:] |= home[1:] != home[:-1]
        least[sort] = np.minimum.reduceat(start[sort], np.flatnonzero(new))[np.cumsum(new) - 1]
        ends = np.cumsum(sizes)[:-1]
        bits = [
            np.packbits(p).tobytes() + (q.tobytes() if shared[b] else b"")
            for p, q, b in zip(np.split(later, ends), np.split(least, ends), blocks, strict=True)
        ]
        return pa.table(
            {
                "block": pa.array(blocks, pa.int32()), "shard": pa.array([table.column("shard")[0].as_py()] * len(blocks), pa.int32()),
                "earlier": pa.array(bits, pa.binary()),
            }
        )

    return earlier


def _letters(numbers: np.ndarray) -> str:
    """One code point per word number, surrogates left out."""
    return (numbers + np.where(numbers >= 0xD800 - 1, 0x800 + 1, 1)).astype("<u4").tobytes().decode("utf-32-le")


def _passages(found: Candidates, recurring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of recurring windows in the order of texts, and where a run of consecutive ones begins in it.

    A run is a maximal recurring passage of its text.
    """
    at = np.flatnonzero(recurring[found.number])
    at = at[np.lexsort((found.start[at], found.doc[at]))]
    doc, start = found.doc[at], found.start[at]
    return at, np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))


def removed_words(
    words: list[list[bytes]], ids: list[int | None], found: Candidates, earlier: np.ndarray, least: np.ndarray | None = None
) -> list[np.ndarray]:
    """For each text of a block, which words go.

    The maximal recurring passages of all texts, each distinct one once, are
    compiled into automata over word numbers, some ``AUTOMATON_WORDS`` words at a
    time; a longer passage is given in pieces that share all but one word of a window,
    so that none of its windows is cut.  Each automaton numbers the words of its own
    passages, so its alphabet is bounded however many words a block has; any other
    word is letter 0.  Every automaton streams all texts and reports each occurrence
    of its passages, and so of all their windows.  An occurrence of a window goes if an
    earlier block has it, or an earlier document or place in this block.  Where blocks
    share one id, ``least`` is the first start of each window in all of them.
    """
    gone = [np.zeros(len(w), bool) for w in words]
    again = earlier | (found.count > 1)
    at, begins = _passages(found, again if least is None else again | (found.least > least))
    if not len(at):
        return gone
    numbers: dict[bytes, int] = {}
    coded = [np.array([numbers.setdefault(w, len(numbers)) for w in t], np.int32) for t in words]
    most = max(1, AUTOMATON_WORDS - WINDOW + 1)
    distinct: dict[bytes, np.ndarray] = {}
    for whole in np.split(at, begins[1:]):
        for run in np.split(whole, range(most, len(whole), most)):
            doc, start = int(found.doc[run[0]]), int(found.start[run[0]])
            distinct.setdefault(coded[doc][start : start + len(run) + WINDOW - 1].tobytes(), found.number[run])
    offset = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    located = np.full(int(offset[-1]), -1, np.int64)  # the window that starts at each word, if it was found
    passages = [np.frombuffer(p, np.int32) for p in distinct]
    windows_of = list(distinct.values())
    for a, b in chunks(map(len, passages), AUTOMATON_WORDS):
        own = np.unique(np.concatenate(passages[a:b]))
        letter = np.zeros(len(numbers), np.int64)
        letter[own] = np.arange(1, len(own) + 1)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k in range(a, b):
            automaton.add_word(_letters(letter[passages[k]]), k)
        automaton.make_automaton()
        for first, text in zip(offset.tolist(), coded, strict=False):
            for end, k in automaton.iter(_letters(letter[text])):
                place = first + end + 1 - len(passages[k])
                located[place : place + len(windows_of[k])] = windows_of[k]
    place = np.flatnonzero(located >= 0)
    which, doc = located[place], np.searchsorted(offset, place, side="right") - 1
    rank = np.unique([(i is None, i or 0) for i in ids], axis=0, return_inverse=True)[1].ravel()[doc]
    start = place - offset[doc]
    order = np.lexsort((start, rank, which))
    place, which, rank, start = place[order], which[order], rank[order], start[order]
    group = np.cumsum(np.diff(which, prepend=-1) != 0) - 1
    head = np.flatnonzero(np.diff(which, prepend=-1))[group]
    start_of = start[head] if least is None else least[which]
    late = place[(rank != rank[head]) | (start != start_of) | earlier[which]]
    depth = np.zeros(int(offset[-1]) + 1, np.int32)
    np.add.at(depth, late, 1)
    np.add.at(depth, late + WINDOW, -1)
    return np.split(np.cumsum(depth)[:-1] > 0, offset[1:-1])


def _cleaned(n_shards: int, shared: np.ndarray):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cleaned(docs: pa.Table, marks: pa.Table) -> pa.Table:
        ids, data = _block_rows(docs)
        words = [d.split() for d in data]
        gone = [np.zeros(len(w), bool) for w in words]
        if docs.num_rows and marks.num_rows:
            repeated = marks.filter(pc.is_valid(marks.column("packed")))
            found = Candidates(data, _hashes_in(repeated))
            bits = {s: e for s, e in zip(marks.column("shard").to_pylist(), marks.column("earlier").to_pylist(), strict=True) if e}
            shards, sizes = np.unique(_shard_of(found.keys[:, 0], n_shards), return_counts=True)
            parts = [np.unpackbits(np.frombuffer(bits[s], np.uint8, -(-n // 8)), count=n) for s, n in zip(shards.tolist(), sizes.tolist(), strict=True)]
            earlier = np.concatenate([np.empty(0, bool), *parts]).astype(bool)
            least = None
            if shared[docs.column("block")[0].as_py()]:
                starts = [np.frombuffer(bits[s], np.int64, n, -(-n // 8)) for s, n in zip(shards.tolist(), sizes.tolist(), strict=True)]
                least = np.concatenate([np.empty(0, np.int64), *starts])
            gone = removed_words(words, ids, found, earlier, least)
        spans, kept = [], []
        for w, g in zip(words, gone, strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
            spans.append([{"start": s, "end": e} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
            kept.append(b" ".join([x for x, y in zip(w, g, strict=True) if not y] if len(edge) else w))
        return pa.table(
            {
                "doc_id": docs.column("doc_id"), "n_words": pa.array([len(w) for w in words], pa.int64()),
                "n_removed": pa.array([int(g.sum()) for g in gone], pa.int64()),
                "removed": pa.array(spans, kind), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )

    return cleaned


CLEANED = "doc_id long, n_words long, n_removed long, removed array<struct<start: int, end: int>>, kept_text string"


def _cuts(block_bytes: int):
    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First id of each block of a stretch of ids in order, and over how many blocks its rows are spread.

        It is more than one only for an id whose rows together exceed a block.
        """
        total, closed = 0, True
        for batch in batches:
            firsts, spread = [], []
            for doc, size, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "bytes", "n")), strict=True):
                parts = _spread(size, n, block_bytes)
                if closed or parts > 1 or total + size > block_bytes:
                    firsts.append(doc)
                    spread.append(parts)
                    total = 0
                total, closed = total + size, parts > 1
            yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.int64()), pa.array(spread, pa.int64())], ["doc_id", "parts"])

    return cuts


def _spread(size: int, n_rows: int, block_bytes: int) -> int:
    return min(n_rows, -(-size // block_bytes))


def _blocks(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Documents in ranges of ``doc_id`` of at most ``block_bytes`` of text or one document, stored in buckets by block.

    Rows of one id that exceed a block, those without id among them, are spread over
    several.  Also returns for each block the first one that has its ids, and whether
    others have its id too.  Only two numbers a block reach the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    sized = rows.groupBy("doc_id").agg(F.sum(F.octet_length("text") + F.lit(32).cast("long")).alias("bytes"), F.count("*").alias("n"))
    sizes = staged(sized, "passage_bytes")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    # Each stretch holds some blocks, so that their ends, which may leave a block part filled, are few.
    stretches = max(1, -(-total // (8 * block_bytes)))
    ids = sizes.where("doc_id is not null").repartitionByRange(stretches, "doc_id").sortWithinPartitions("doc_id")
    cuts = sorted(tuple(r) for r in ids.mapInArrow(_cuts(block_bytes), "doc_id long, parts long").collect())
    without = sizes.where("doc_id is null").first()
    firsts = np.array([first for first, _ in cuts], np.int64)
    parts = np.array([n for _, n in cuts] + [_spread(without.bytes, without.n, block_bytes) if without else 1], np.int64)
    begin = np.cumsum(parts) - parts
    count = int(parts.sum())

    @F.pandas_udf("int")
    def block_of(doc: pd.Series, null: pd.Series, row: pd.Series) -> pd.Series:
        at = np.maximum(np.searchsorted(firsts, doc.to_numpy(), side="right") - 1, 0)
        at[null.to_numpy()] = len(firsts)
        turn = mixed(row.to_numpy().astype(np.uint64)) % parts[at].astype(np.uint64)
        return pd.Series((begin[at] + turn.astype(np.int64)).astype(np.int32))

    name = f"passage_blocks_{uuid.uuid4().hex}"
    known = F.coalesce("doc_id", F.lit(0).cast("long"))
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    placed = numbered.withColumn("block", block_of(known, F.col("doc_id").isNull(), "row")).drop("row")
    path = new_path(spark, name)
    # A bucket holds several blocks where there are more of them than Spark allows buckets.
    buckets = min(count, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")) // 2)
    placed.repartition(buckets, "block").write.option("path", path).bucketBy(buckets, "block").sortBy("block").saveAsTable(name)
    delete_at_end(spark, path)
    table = spark.table(name)
    # The catalog needs the name only to hand out the buckets; the files stay.
    spark.sql(f"drop table {name}")
    return table, np.repeat(begin, parts), np.repeat(parts > 1, parts)


def dedup_passages(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Remove repeated passages: ``doc_id, n_words, n_removed, removed, kept_text``.

    A word is a run of anything but ASCII white space, a window ``WINDOW``
    consecutive words of one document.  A word goes if it is in a window whose
    words also start earlier: in a document of smaller id, or before in the same
    one.  ``removed`` are the runs of words that go; the others are joined by a space.

    1. Documents are stored in blocks, ranges of ids cut by summed bytes, bucketed so
       that the later steps meet each block without moving its text again.
    2. A window's anchor is its least ``GRAM``-word hash.  Shards of the hash space
       get each block's distinct anchors and tell the block which recur.
    3. Windows around recurring anchors are confirmed in the same way: shards get
       each block's distinct 128-bit keys and answer with one bit for each, whether an
       earlier block has it.  A passage in every document is sent once per block.
    4. Each block compiles the passages that confirmed windows make up into automata
       of bounded size and streams its documents through them to find every occurrence.

    A null text has no words.  A null ``doc_id`` counts as larger than any other,
    and all null ids as one document.  Of rows that repeat a ``doc_id``, windows at
    the same place are neither earlier than the other; else the smaller start is.
    No rows give no rows.  Columns other than ``doc_id`` and ``text`` are not read.
    """
    table, first, shared = _blocks(docs, block_bytes)
    n_shards = 1 << max(5, len(first).bit_length())
    anchors = table.mapInArrow(_anchors(n_shards), ROUTED)
    repeated = staged(anchors.groupBy("shard").applyInArrow(_repeated, "block int, packed binary"), "repeated_anchors")
    blocks = table.groupBy("block")
    keys = blocks.cogroup(repeated.groupBy("block")).applyInArrow(_candidate_keys(n_shards, shared), ROUTED)
    bits = keys.groupBy("shard").applyInArrow(_earlier(first, shared), "block int, shard int, earlier binary")
    marks = bits.select("block", "shard", "earlier", F.lit(None).cast("binary").alias("packed")).unionByName(
        repeated.select("block", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("binary").alias("earlier"), "packed")
    )
    return blocks.cogroup(marks.groupBy("block")).applyInArrow(_cleaned(n_shards, shared), CLEANED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = rf"""
with d as (
    select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
),
wins as (
    select r, doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') as win
    from (select r, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from d where len(w) >= {WINDOW})
),
firsts as (select win, min(doc_id) as f from wins group by win having count(*) > 1),
starts as (select wins.win, f, min(i) as s from wins join firsts on wins.win = firsts.win and doc_id = f group by wins.win, f),
late as (select r, i from wins join starts on wins.win = starts.win where doc_id > f or i > s),
gone as (select distinct r, unnest(range(i, i + {WINDOW})) as p from late),
words as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
kept as (
    select words.r, string_agg(word, ' ' order by words.p) as kept
    from words left join gone on words.r = gone.r and words.p = gone.p where gone.p is null group by words.r
),
counts as (select r, count(*) as n from gone group by r)
select d.doc_id, len(d.w) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join counts on counts.r = d.r left join kept on kept.r = d.r
"""
