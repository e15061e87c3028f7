"""Vector code compression: a product quantiser whose codebooks are searched through kd-trees.

Vectors become whole numbers and are cut into equal consecutive parts.  Each round
broadcasts one kd-tree for every codebook (at most 64 entries of one part each, so
its size does not depend on the table).  A search goes to the child whose box is
nearer first and to the other one unless its box is farther than the best entry so
far: a box at exactly that distance is visited, since it may hold an equal entry of
lower index.  Tasks add up the parts of each entry in whole numbers, these partial
sums are reduced by Spark, and only the sums of the codebooks (entries times
dimension numbers) come back to the driver.  Sums of whole numbers do not depend on
the order of addition, so the codebooks do not depend on how rows are split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_if_small, in_bounded_batches, materialize

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Components at or beyond this size count as not finite: sums of squares stay within 64 bits up to 256 dimensions.
LARGEST = float(1 << 18)
#: Entries of a leaf of a tree.
LEAF = 8


class Tree:
    """A kd-tree over a codebook (entries x components) with tight boxes; nodes in arrays, children side by side."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.members: list[np.ndarray | None] = [np.arange(len(entries))]
        self.child: list[int] = [-1]
        at = 0
        while at < len(self.members):
            own = self.members[at]
            if len(own) > LEAF:
                values = entries[own]
                axis = int(np.argmax(values.max(0) - values.min(0)))
                order = own[np.lexsort((own, values[:, axis]))]
                self.child[at] = len(self.members)
                self.members += [np.sort(order[: len(order) // 2]), np.sort(order[len(order) // 2 :])]
                self.child += [-1, -1]
            at += 1
        self.low = np.array([entries[m].min(0) for m in self.members])
        self.high = np.array([entries[m].max(0) for m in self.members])

    def bound(self, node: int, queries: np.ndarray) -> np.ndarray:
        """Squared distance of each query to the node's box."""
        away = np.maximum(np.maximum(self.low[node] - queries, queries - self.high[node]), 0)
        return np.einsum("ij,ij->i", away, away)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry, the lowest of equals, and the squared distance, of each query."""
        best = np.full(len(queries), np.iinfo(np.int64).max)
        index = np.zeros(len(queries), np.int64)
        self._visit(0, np.arange(len(queries)), queries, best, index)
        return index, best

    def _visit(self, node: int, rows: np.ndarray, queries: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        if not len(rows):
            return
        if self.child[node] < 0:
            own, q = self.members[node], queries[rows]
            for entry in own.tolist():
                away = q - self.entries[entry]
                distance = np.einsum("ij,ij->i", away, away)
                better = (distance < best[rows]) | ((distance == best[rows]) & (entry < index[rows]))
                best[rows[better]], index[rows[better]] = distance[better], entry
            return
        left = self.child[node]
        bounds = [self.bound(left, queries[rows]), self.bound(left + 1, queries[rows])]
        nearer = (bounds[1] < bounds[0]).astype(int)
        for far in (0, 1):  # first the nearer child of every query, then the other where its box is not farther than the best
            for side in (0, 1):
                here = nearer == (1 - side if far else side)
                if far:
                    here &= bounds[side] <= best[rows]
                self._visit(left + side, rows[here], queries, best, index)


def whole_numbers(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label, v: usable vectors as floor(256 * x)."""
    x = F.col(vector).cast("array<double>")
    usable = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    return embeddings.where(F.coalesce(usable, F.lit(False))).select("vec_id", "label", F.transform(x, lambda c: F.floor(c * SCALE).cast("int")).alias("v"))


def matrix(column: pa.Array, width: int, parts: int) -> np.ndarray:
    """rows x parts x components of a list column, filled up with zeros to whole parts."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)
    return np.pad(flat, ((0, 0), (0, -width % parts))).reshape(len(column), parts, -(-width // parts))


def first_entries(vectors: DataFrame, width: int, parts: int, entries: int) -> np.ndarray:
    """parts x entries x components: the parts of the vectors of the smallest ids; ``entries`` rows at most come to the driver."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow().column("v").combine_chunks()
    books = matrix(rows, width, parts).swapaxes(0, 1).copy()
    return books if books.size else np.zeros((parts, 1, books.shape[2]), np.int64)  # nothing will be searched


def fit(vectors: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (parts x entries x components) after ``rounds`` rounds over all vectors."""
    books = first_entries(vectors, width, parts, entries)
    context = vectors.sparkSession.sparkContext
    for _ in range(rounds):
        trees = context.broadcast([Tree(book) for book in books])

        def sums(batches: Iterator[pa.RecordBatch], trees=trees, shape=books.shape) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
            for batch in batches:
                rows = matrix(batch.column("v"), width, parts)
                for p, tree in enumerate(trees.value):
                    index = tree.nearest(rows[:, p])[0]
                    np.add.at(total[p], index, rows[:, p])
                    n[p] += np.bincount(index, minlength=shape[1])
            part, entry = np.nonzero(n)
            if len(part):
                place = pa.array(np.arange(len(part) + 1) * shape[2], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.ListArray.from_arrays(place, pa.array(total[part, entry].ravel()))], ["part", "entry", "n", "total"])

        partial = vectors.select("v").mapInArrow(sums, "part int, entry int, n long, total array<long>")
        components = [F.sum(F.col("total")[i]).alias(f"c{i}") for i in range(books.shape[2])]
        added = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *components).toArrow()
        part, entry, n = (added.column(c).to_numpy() for c in ("part", "entry", "n"))
        if len(n):
            total = np.stack([added.column(f"c{i}").to_numpy() for i in range(books.shape[2])], axis=1)
            books[part, entry] = total // n[:, None]  # rounds down
        trees.unpersist()
    return books


def encode(vectors: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """vec_id, label, code, error of every vector under the final codebooks."""
    trees = vectors.sparkSession.sparkContext.broadcast([Tree(book) for book in books])
    parts = len(books)
    kinds = dict(vectors.dtypes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column("v"), width, parts)
            found = [tree.nearest(rows[:, p]) for p, tree in enumerate(trees.value)]
            digits = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
            text = digits.tobytes().hex()
            codes = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
            error = sum((distance for _, distance in found), np.zeros(len(rows), np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return vectors.mapInArrow(assign, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(embeddings: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable vector.

    A null vector, an empty one and one with a null, NaN or infinite component (or
    one of 2**18 and more, whose squares could leave 64 bits) is left out.  All
    vectors must have as many components as that of the smallest kept vec_id; those
    of another length are left out too.  A length that ``parts`` does not divide is
    filled up with zeros.  Rows of one vec_id are vectors of their own, ordered by
    their components for the first codebooks; a null vec_id comes last.  Fewer
    than ``entries`` vectors make smaller codebooks.  An empty table gives an empty
    result, further columns are ignored.  Null labels are one label.
    """
    assert 1 <= entries <= 256
    vectors = materialize(whole_numbers(embeddings, vector), "vectors")
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("width")).first()
    width = first["width"] if first else parts
    vectors = in_bounded_batches(vectors.where(F.size("v") == width), 8192)
    books = fit(vectors, width, parts, entries, rounds)
    rows = materialize(encode(vectors, books, width), "codes")
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = rows.join(broadcast_if_small(materialize(sums, "label-errors")), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


#: Every part of every vector meets the 64 entries of its codebook, not other rows.
ORACLE = """
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT vec_id, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS v FROM k, range(16) t(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v AS c FROM x QUALIFY e < 64),
{rounds}
final AS (SELECT vec_id, p, {nearest} AS best FROM x JOIN b2 USING (p) GROUP BY vec_id, p),
codes AS (SELECT vec_id, string_agg(lpad(printf('%x', best.e), 2, '0'), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM final GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM codes JOIN k USING (vec_id), h
"""
_NEAREST = "min({'d': list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e})"
_ROUND = """a{0} AS (SELECT vec_id, p, {nearest} AS best FROM x JOIN b{0} USING (p) GROUP BY vec_id, p),
s{0} AS (SELECT p, e, i, floor(sum(y)::DOUBLE / count(*))::BIGINT AS y FROM (SELECT p, best.e AS e, unnest(v) AS y, unnest(range(len(v))) AS i FROM a{0} JOIN x USING (vec_id, p)) GROUP BY p, e, i),
n{0} AS (SELECT p, e, list(y ORDER BY i) AS c FROM s{0} GROUP BY p, e), b{1} AS (SELECT p, e, coalesce(n{0}.c, b{0}.c) AS c FROM b{0} LEFT JOIN n{0} USING (p, e)),"""
ORACLE = ORACLE.replace("{rounds}", "\n".join(_ROUND.format(i, i + 1, nearest=_NEAREST) for i in range(ROUNDS))).replace("{nearest}", _NEAREST)
