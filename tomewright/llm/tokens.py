"""Token counts (operator 4): segment trees of pre-token counts, re-encoded only where a text was edited."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

#: Pre-tokens in a leaf of a new tree; a leaf that edits fill beyond ``4 * LEAF`` is split.
LEAF = 64
#: A pre-token depends on its own characters and at most this many after it.
REACH = 3
CACHED = 1 << 18
EDITS = ArrayType(
    StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("text", StringType())])
)


def default_tokenizer() -> tuple[str, str]:
    """File of ranks and pre-token pattern of the installed byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def counter(path: str, pattern: str) -> Counter:
    return Counter(path, pattern)


class Counter:
    """Pre-tokens of a text and the number of tokens of each, remembered for frequent ones."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(self.known) >= CACHED:
                self.known.clear()
            self.known[piece] = n
        return n


class Leaves(NamedTuple):
    chars: np.ndarray
    tokens: np.ndarray


def leaves_of(pieces: list[str], counts: list[int]) -> Leaves:
    firsts = np.arange(0, len(pieces), LEAF)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    if not len(pieces):
        return Leaves(np.empty(0, np.int64), np.empty(0, np.int64))
    return Leaves(np.add.reduceat(sizes, firsts), np.add.reduceat(np.array(counts, np.int64), firsts))


@dataclass
class Tree:
    """Sums of characters and tokens over ranges of leaves; node k has children 2k and 2k + 1, the root is 1."""

    chars: np.ndarray = field(default_factory=lambda: np.zeros(2, np.int64))
    tokens: np.ndarray = field(default_factory=lambda: np.zeros(2, np.int64))

    @classmethod
    def over(cls, leaves: Leaves) -> Tree:
        width = 1 << max(0, (len(leaves.chars) - 1).bit_length())
        out = []
        for values in leaves:
            sums = np.zeros(2 * width, np.int64)
            sums[width : width + len(values)] = values
            level = width
            while level > 1:
                sums[level // 2 : level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
                level //= 2
            out.append(sums)
        return cls(*out)

    @property
    def width(self) -> int:
        return len(self.chars) // 2

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at ``place`` (the last one beyond the end) and where it starts."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if place - before >= self.chars[node] and self.chars[node + 1]:
                before += int(self.chars[node])
                node += 1
        return node - self.width, before

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        """Set a leaf and update the sums above it."""
        node = leaf + self.width
        by = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += by[0]
            self.tokens[node] += by[1]
            node //= 2

    def edit(self, text: str, start: int, end: int, new: str, counter: Counter) -> tuple[str, Tree, int]:
        """Replace ``text[start:end]``: the new text, its tree and the number of pre-tokens encoded.

        Pre-tokens that end ``REACH`` characters before the edit stay.  Encoding
        starts at the leaf of that place and ends where a new pre-token ends at the
        start of an old leaf behind the edit: nothing after it looks back.
        """
        start = min(max(start, 0), len(text))
        end = min(max(end, start), len(text))
        after = text[:start] + new + text[end:]
        shift = len(after) - len(text)
        first, begin = self.leaf_at(max(0, start - REACH))
        last, bound = first + 1, begin + int(self.chars[self.width + first])
        pieces, counts, place = [], [], begin
        for match in counter.pieces.finditer(after, begin):
            pieces.append(match[0])
            counts.append(counter.count(match[0]))
            place = match.end()
            while last < self.width and (bound < end or bound + shift < place):
                bound += int(self.chars[self.width + last])
                last += 1
            if bound >= end and bound + shift == place:
                break
        else:
            last = self.width
        if len(pieces) <= 4 * LEAF:
            self.put(first, place - begin, sum(counts))
            for leaf in range(first + 1, last):
                if self.chars[self.width + leaf]:
                    self.put(leaf, 0, 0)
            return after, self, len(pieces)
        middle, w = leaves_of(pieces, counts), self.width
        spliced = [np.concatenate([v[w : w + first], m, v[w + last :]]) for v, m in zip((self.chars, self.tokens), middle, strict=True)]
        return after, Tree.over(Leaves(*spliced)), len(pieces)


def token_trees(docs: DataFrame, tokenizer: tuple[str, str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``doc`` (the document's columns, all or those in ``keep``), ``n_tokens`` and its tree ``chars, tokens``.

    Tokens of a text are those of its pre-tokens.  A tree takes two numbers per
    ``LEAF / 2`` pre-tokens.  ``tokenizer`` is a file of ranks that every executor
    has, and the pattern of pre-tokens.  A null text has no tokens; repeated rows
    are counted one by one; no rows give no rows.
    """
    tokenizer = tokenizer or default_tokenizer()
    rows = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in (docs.columns if keep is None else keep)]).alias("doc"),
        docs["text"].cast("string").alias("text"),
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(*tokenizer)
        for batch in batches:
            chars, tokens = [], []
            for text in batch.column("text"):
                pieces = count.pieces.findall(text.as_py() or "")
                tree = Tree.over(leaves_of(pieces, list(map(count.count, pieces))))
                chars.append(tree.chars.astype(np.int32))
                tokens.append(tree.tokens.astype(np.int32))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array([int(t[1]) for t in tokens], pa.int64()), pa.array(chars, kind), pa.array(tokens, kind)],
                ["doc", "n_tokens", "chars", "tokens"],
            )

    kind = ArrayType(IntegerType())
    fields = [StructField("n_tokens", LongType()), StructField("chars", kind), StructField("tokens", kind)]
    return rows.mapInArrow(build, StructType([rows.schema["doc"], *fields]))


def edited(rows: DataFrame, tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """Apply edits: ``doc_id, text, n_tokens, chars, tokens, n_encoded`` after them.

    ``rows`` has ``doc_id, text``, the tree ``chars, tokens`` of the text, and
    ``edits``, an array of ``start, end, text`` in code points of the text as the
    edits before left it.  Only pre-tokens that an edit touches, and those of the
    leaf or two around it, are encoded again; ``n_encoded`` is their number.

    Places outside the text are moved to its ends; a null text counts as empty,
    null edits as none, a null place as 0 and a null replacement as empty.
    Repeated rows are edited one by one; no rows give no rows.
    """
    tokenizer = tokenizer or default_tokenizer()
    rows = rows.select("doc_id", "text", "chars", "tokens", F.col("edits").cast(EDITS).alias("edits"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(*tokenizer)
        for batch in batches:
            texts, trees, encoded = [], [], []
            for text, chars, tokens, edits in zip(*[batch.column(c).to_pylist() for c in ("text", "chars", "tokens", "edits")], strict=True):
                text, tree, n = text or "", Tree(np.array(chars, np.int64), np.array(tokens, np.int64)), 0
                for e in edits or []:
                    text, tree, more = tree.edit(text, e["start"] or 0, e["end"] or 0, e["text"] or "", count)
                    n += more
                texts.append(text)
                trees.append(tree)
                encoded.append(n)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(texts, pa.string()), pa.array([int(t.tokens[1]) for t in trees], pa.int64()),
                    pa.array([t.chars.astype(np.int32) for t in trees], kind), pa.array([t.tokens.astype(np.int32) for t in trees], kind),
                    pa.array(encoded, pa.int64()),
                ],
                ["doc_id", "text", "n_tokens", "chars", "tokens", "n_encoded"],
            )

    kind = ArrayType(IntegerType())
    fields = [
        StructField("text", StringType()), StructField("n_tokens", LongType()), StructField("chars", kind),
        StructField("tokens", kind), StructField("n_encoded", LongType()),
    ]
    return rows.mapInArrow(apply, StructType([rows.schema["doc_id"], *fields]))


def sample_edits(docs: DataFrame) -> DataFrame:
    """``docs`` with three edits of each text: its first third's end replaced by its own last words, a cut, and a new head."""
    n = F.coalesce(F.length("text"), F.lit(0))
    third, cut = F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int")

    def one(start, end, text):
        return F.struct(start.alias("start"), end.alias("end"), text.alias("text"))

    return docs.withColumn(
        "edits",
        F.array(one(third, third + 20, F.coalesce(F.right("text", F.lit(30)), F.lit(""))), one(cut, cut + 10, F.lit("")), one(F.lit(0), F.lit(0), F.lit("Edited: "))),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, and after three edits of each."""
    docs = sample_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    trees = token_trees(docs, keep=["doc_id", "text", "edits"]).select("doc.*", "n_tokens", "chars", "tokens")
    # The count before the edits rides along in the id's place.
    before = trees.select(F.struct("doc_id", "n_tokens").alias("doc_id"), "text", "chars", "tokens", "edits")
    after = edited(before)
    return after.select("doc_id.doc_id", "doc_id.n_tokens", F.col("n_tokens").alias("n_tokens_edited"), "n_encoded")
