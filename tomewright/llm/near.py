"""Near-duplicate detection (operator 5): consistent weighted samples of TF-IDF shingles, banded and verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.llm.passages import word_hashes
from tomewright.llm.text import PLAIN, SLICES, chunks, count_slices, gathered, gram_hashes, mixed, payload, unwrapped, whole_rows
from tomewright.sources.artifacts import staged

WORDS = 5
SIMILARITY = 0.8
ROWS = 4
BANDS = 12
FREQUENCY_BITS = 20
CHUNK_BYTES = 1 << 20
#: A chunk of a component: texts, and bytes of text.
CHUNK_TEXTS = 500
CHUNK_TEXT_BYTES = 16 << 20
POOL_BITS = 16


def _pool() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of the random variates r, log c (both Gamma(2, 1)) and beta; a hash picks an entry."""
    n = 1 << POOL_BITS
    u = (mixed(np.arange(1, 5 * n + 1, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    u = np.maximum(u, 1e-300).reshape(5, n)
    return tuple(x.astype(np.float32) for x in (-np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), u[4]))


R, LOG_C, BETA = _pool()


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: hash, text and number of times, sorted by text and hash.

    A shingle is ``WORDS`` consecutive words of letters and digits, A-Z in lower
    case; a text of fewer words is one shingle, one without words has none.
    """
    words, owner = word_hashes([t.translate(PLAIN) for t in texts])
    count = max(0, len(words) - WORDS + 1)
    inside = owner[:count] == owner[WORDS - 1 :]
    grams, owners = gram_hashes(words, WORDS)[inside], owner[:count][inside]
    sizes = np.bincount(owner, minlength=len(texts))
    short = np.flatnonzero((sizes > 0) & (sizes < WORDS))
    if len(short):
        firsts = np.searchsorted(owner, short)
        extra = [gram_hashes(words[f : f + sizes[s]], int(sizes[s])) for f, s in zip(firsts, short, strict=True)]
        grams, owners = np.concatenate([grams, *extra]), np.concatenate([owners, short])
    order = np.lexsort((grams, owners))
    grams, owners = grams[order], owners[order]
    new = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]) | (owners[1:] != owners[:-1])]) if len(grams) else [])
    return grams[new], owners[new], np.diff(np.append(new, len(grams)))


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count, n_docs = np.zeros(1 << FREQUENCY_BITS, np.int32), 0
    for batch in batches:
        data = payload(batch.column("text"))
        n_docs += len(data)
        for a, b in chunks(map(len, data), CHUNK_BYTES):
            hashes, _, _ = shingles(data[a:b])
            count += np.bincount(_buckets(hashes), minlength=len(count)).astype(np.int32)
    if n_docs:
        yield count_slices(count, n_docs)


def inverse_frequency(rows: DataFrame) -> np.ndarray:
    """IDF between 1 and 2 of each of ``2 ** FREQUENCY_BITS`` ranges of shingle hashes, counted over all rows.

    Shingles of one range share their count, a share of all documents that does
    not depend on how many there are; what stands out are passages that many
    documents share.  The bounds keep a large family of copies from weighing its
    own shingles down to nothing.
    """
    count, n_docs = gathered(rows.select("text").mapInArrow(_frequencies, SLICES), 1 << FREQUENCY_BITS)
    return (1 + np.log((1 + n_docs) / (1 + np.minimum(count, n_docs))) / np.log(2 + n_docs)).astype(np.float32)


def weighted(texts: list[bytes], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes, owner, times = shingles(texts)
    return hashes, owner, times * idf[_buckets(hashes)]


def band_keys(texts: list[bytes], idf: np.ndarray, rows: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts that have shingles, and ``bands`` keys of each, from ``rows`` consistent weighted samples a key.

    A sample is the shingle, and the level of its weight, for which log a =
    log c - r (t + 1 - beta) with t = floor(log w / r + beta) is least; two texts
    agree in one with the probability of their weighted Jaccard similarity.
    """
    hashes, owner, weight = weighted(texts, idf)
    if not len(hashes):
        return np.empty(0, np.int64), np.empty((0, bands), np.int64)
    firsts = np.flatnonzero(np.diff(owner, prepend=-1))
    sizes = np.diff(np.append(firsts, len(owner)))
    log_w, keys = np.log(weight).astype(np.float32), np.zeros((len(firsts), bands), np.uint64)
    step = mixed(hashes) | np.uint64(1)
    with np.errstate(over="ignore"):
        place = hashes.copy()
        for d in range(rows * bands):
            place += step
            at = (place >> np.uint64(64 - POOL_BITS)).astype(np.int64)
            r, beta = R[at], BETA[at]
            level = np.floor(log_w / r + beta)
            value = LOG_C[at] - r * (level + 1 - beta)
            hit = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, firsts), sizes))
            hit = hit[np.diff(owner[hit], prepend=-1) != 0]  # of equal ones that of the least hash
            sample = hashes[hit] ^ mixed(level[hit].astype(np.int64).astype(np.uint64))
            band = d // rows
            keys[:, band] = mixed(keys[:, band] * np.uint64(0x9E3779B97F4A7C15) + sample + np.uint64(band + 1))
    return owner[firsts], keys.view(np.int64)


def _banded(idf, rows: int, bands: int):
    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Copies within a batch need no second look.
            distinct = dict(zip(batch.column("node").to_pylist(), payload(batch.column("text")), strict=True))
            nodes, data = list(distinct), list(distinct.values())
            for a, b in chunks(map(len, data), CHUNK_BYTES):
                owner, keys = band_keys(data[a:b], idf.value, rows, bands)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([nodes[a + o] for o in owner], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], ["node", "keys"]
                )

    return banded


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for the nodes that edges ``a, b`` link to another; a root is the least node of its component.

    In a round each node points to its least neighbour or itself; pointers jump
    until they reach a root, and edges are drawn between roots.  Each round at
    least halves the nodes that still have edges; each step is a written table.
    """
    ordered = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links, labels = staged(ordered.distinct(), "edges"), None
    while labels is None or not links.isEmpty():
        both = links.select(F.col("a").alias("node"), "b").union(links.select(F.col("b").alias("node"), F.col("a").alias("b")))
        up = staged(both.groupBy("node").agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up")), "pointers")
        moved = True
        while moved:
            further = up.select(F.col("node").alias("up"), F.col("up").alias("further"))
            jumped = up.join(further, "up").select("node", F.col("further").alias("up"), (F.col("further") != F.col("up")).alias("moved"))
            jumped = staged(jumped, "pointers")
            up, moved = jumped.drop("moved"), not jumped.where("moved").isEmpty()
        if labels is None:
            labels = up.select("node", F.col("up").alias("root"))
        else:
            later = up.select(F.col("node").alias("root"), "up")
            labels = staged(labels.join(later, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
        one = links.join(up.select(F.col("node").alias("a"), F.col("up").alias("a_root")), "a").select("a_root", "b")
        two = one.join(up.select(F.col("node").alias("b"), F.col("up").alias("b_root")), "b").where("a_root != b_root")
        links = staged(two.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "edges")
    return labels


class _Sets:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.root(i)] = self.root(j)


def _similarity(a: tuple[np.ndarray, np.ndarray, float], b: tuple[np.ndarray, np.ndarray, float]) -> float:
    """Weighted Jaccard similarity of two sets of sorted hashes with weights and their sum."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    common = float(np.minimum(a[1][same], b[1][at[same]]).sum())
    return common / (a[2] + b[2] - common)


EDGES = "a binary, b binary"


def _verified(idf, similarity: float):
    def verified(table: pa.Table) -> pa.Table:
        """Links of one chunk, or between two, that keep all sets together which links would.

        Texts are compared if they share a band's key and no chain of verified links joins them yet.
        """
        nodes = table.column("node").to_pylist()
        first = {node: i for i, node in reversed(list(enumerate(nodes)))}
        rows = sorted(first.values(), key=nodes.__getitem__)
        nodes = [nodes[i] for i in rows]
        table = table.take(pa.array(rows, pa.int64()))
        side, one = table.column("side").to_pylist(), table.column("i")[0].as_py() == table.column("j")[0].as_py()
        data, sets = payload(table.column("text").combine_chunks()), []
        for a, b in chunks(map(len, data), CHUNK_BYTES):
            hashes, owner, weight = weighted(data[a:b], idf.value)
            cuts = np.searchsorted(owner, np.arange(b - a + 1))
            for s, e in zip(cuts, cuts[1:], strict=False):
                sets.append((hashes[s:e], weight[s:e], float(weight[s:e].sum())))
        buckets: dict[tuple[int, int], list[int]] = {}
        for i, keys in enumerate(table.column("keys").to_pylist()):
            for band, key in enumerate(keys):
                buckets.setdefault((band, key), []).append(i)
        linked, seen, out = _Sets(len(nodes)), set(), []
        for members in buckets.values():
            for x, i in enumerate(members):
                for j in members[:x]:
                    if (one or side[i] != side[j]) and (i, j) not in seen and linked.root(i) != linked.root(j):
                        seen.add((i, j))
                        low, high = sorted((sets[i][2], sets[j][2]))
                        if low >= similarity * high and _similarity(sets[i], sets[j]) >= similarity:
                            linked.join(i, j)
                            out.append((nodes[i], nodes[j]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})

    return verified


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, rows: int = ROWS, bands: int = BANDS, chunk_texts: int = CHUNK_TEXTS
) -> DataFrame:
    """Classes of near copies: ``doc_id, class_id, class_size, n_links, kept``.

    Two texts are linked if they share the key of one of ``bands`` bands and
    their weighted Jaccard similarity over TF-IDF shingles of five words is
    ``similarity`` or more; a class is what links connect, its id the least
    ``doc_id``, and that document is ``kept``.  ``n_links`` is the number of
    verified links that hold the class together.

    Equal texts are one node from the start.  Nodes that share a key are joined
    to components by their narrow keys; texts meet in one task per component, or
    per pair of chunks of a large one, so that no group is ever whole in one
    task, no pair is lost and only links that join something new are returned.

    A null text counts as empty; a text without words is linked to equal ones
    only.  A null ``doc_id`` counts as larger than any other; a class without
    any id has a null ``class_id`` and keeps all its rows.  Rows that repeat a
    ``doc_id`` are returned one by one; no rows give no rows.  Columns other than
    ``doc_id`` and ``text`` are not read.
    """
    placed, links, classes = _classes(docs, similarity, rows, bands, chunk_texts)
    linked = links.join(classes, links["a"] == classes["node"]).groupBy("root").agg(F.count("*").alias("n_links"))
    summary = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")).join(linked, "root", "left")
    summary = staged(summary, "classes")
    return placed.join(summary, "root").select(
        "doc_id", "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"),
    )


def text_node(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def one_of_each_class(docs: DataFrame, **options) -> DataFrame:
    """The documents, one row of each class of near copies: the same rows as ``docs`` has, with all their columns.

    It is the row of least ``doc_id``, null counting as larger than any other; of rows
    that share an id, one with the least hash of the text, and of equal ones of these the
    least row.  So copies go also where an id repeats or is missing.
    """
    placed, _, _ = _classes(docs, **options)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")
    chosen = placed.groupBy("root").agg(F.min(order).alias("first")).select("first.doc_id", "first.node")
    known = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")
    chosen = staged(chosen.select("node", known, F.col("doc_id").isNull().alias("no_id")), "kept_rows")
    own = whole_rows(
        docs, node=text_node(docs["text"]), id=F.coalesce(docs["doc_id"].cast("string"), F.lit("")), no_id=docs["doc_id"].isNull()
    )
    kept = own.join(chosen, ["node", "id", "no_id"], "left_semi")
    return unwrapped(kept.groupBy("node", "id", "no_id").agg(F.min("doc").alias("doc")))


def _classes(
    docs: DataFrame, similarity: float = SIMILARITY, rows: int = ROWS, bands: int = BANDS, chunk_texts: int = CHUNK_TEXTS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``doc_id, node, root`` of each row, verified links, and the classes of the nodes that links join."""
    spark = docs.sparkSession
    text = F.coalesce(docs["text"], F.lit(""))
    base = docs.select(docs["doc_id"].alias("doc_id"), text_node(docs["text"]).alias("node"), text.alias("text"))
    owned = staged(base.select("doc_id", "node", F.octet_length("text").alias("n_bytes")), "nodes")
    idf = spark.sparkContext.broadcast(inverse_frequency(base))
    banded = base.select("node", "text").mapInArrow(_banded(idf, rows, bands), "node binary, keys array<long>")
    keyed = staged(banded.dropDuplicates(["node"]), "bands")

    each = keyed.select("node", F.posexplode("keys").alias("band", "key"))
    # Tables written before a join are shuffled by it alone, so that it can split the rows of a hot key.
    shared = each.groupBy("band", "key").agg(F.min("node").alias("center"), F.max("node").alias("other")).where("center < other")
    shared = staged(shared.select("band", "key", "center"), "shared_keys")
    stars = each.join(shared, ["band", "key"]).select(F.col("node").alias("a"), F.col("center").alias("b")).where("a != b").distinct()
    roots = components(stars)

    sizes = owned.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"))
    members = staged(roots.join(sizes, "node"), "members")
    per_root = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes"))
    n_chunks = F.ceil(F.greatest(F.col("n") / chunk_texts, F.col("n_bytes") / CHUNK_TEXT_BYTES)).cast("int")
    # Components that are larger than a chunk are few; the others need no lookup.
    large = staged(per_root.select("root", n_chunks.alias("n_chunks")).where("n_chunks > 1"), "large_components")
    chunked = members.join(large, "root", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(1)))
    chunk = F.pmod(F.xxhash64("node"), F.col("n_chunks")).cast("int")
    sent = chunked.withColumn("side", chunk).join(keyed, "node")
    texts = base.join(sent.select("node", "doc_id", "root", "side", "n_chunks", "keys"), [base["node"] == sent["node"], base["doc_id"].eqNullSafe(sent["doc_id"])])
    texts = texts.select(base["node"], base["text"], "root", "side", "keys", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("with"))
    pairs = texts.select("node", "text", "root", "side", "keys", F.least("side", "with").alias("i"), F.greatest("side", "with").alias("j"))
    links = staged(pairs.groupBy("root", "i", "j").applyInArrow(_verified(idf, similarity), EDGES), "links")

    classes = components(links)
    return owned.join(classes, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root")), links, classes


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
