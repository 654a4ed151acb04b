"""An inverted file of vectors with product quantisation, on shared storage.

Each row belongs to the nearest of some centres, and what is left of it is held as one
byte for each few numbers, the nearest word of a code book.  A search reads the bytes
of a query's nearest cells only, and scores the best again from whole vectors.  Each
row also holds how far its bytes are off, and each cell how far it reaches, so that a
search can go on until nothing better can be left: then it is exact.

Centres and code books are fitted on a bounded sample; every row is indexed.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..sources.scratch import materialize
from ..sources.versions import Versions
from .vectors import _centres, _matrix

#: Cells at most, vectors that are fitted on at most, and asked of these for :attr:`Model.probes`.
MOST_CELLS, SAMPLE, ASKED = 1024, 16_384, 256
#: Numbers that a byte stands for, and words of a code book.
NUMBERS, WORDS = 4, 256
#: Rows of a part of a cell, queries of a block, and queries that are scored at once.
PART_ROWS, QUERY_BLOCK, AT_ONCE = 100_000, 1024, 32
#: Rows that are encoded at once, and queries whose cells, up to MOST_CELLS each with the
#: vector beside it, leave a task at once.
ENCODED, MET = 1024, 16
#: What sums in doubles may be off, for each unit of lengths multiplied.
_SLACK = 1e-9


@dataclass
class Model:
    """Centres, code books, and how many cells the nearest rows of a query lie in."""

    centres: np.ndarray
    books: np.ndarray
    probes: int

    @staticmethod
    def fit(sample: np.ndarray, cells: int, recall: float, near: int = 10) -> Model:
        """Fitted on ``sample``; ``probes`` is the least number of nearest cells that
        hold the share ``recall`` of the ``near`` nearest rows of some of the sample."""
        centres = _centres(sample, cells)
        left, order = sample - centres[_nearest(sample, centres)], _by_distance(sample[:ASKED], centres)
        wide = _wide(left)
        books = [_centres(wide[:, k : k + NUMBERS], WORDS) for k in range(0, wide.shape[1], NUMBERS)]
        # A book of fewer words repeats its last.
        held = np.stack([np.vstack((b, np.repeat(b[-1:], WORDS - len(b), axis=0))) for b in books])
        scores = sample[:ASKED] @ sample.T
        np.fill_diagonal(scores, -np.inf)
        best = np.argsort(-scores, axis=1)[:, : max(1, min(near, len(sample) - 1))]
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), axis=1)
        needed = np.sort(np.take_along_axis(place, _nearest(sample, centres)[best], axis=1).ravel())
        return Model(centres, held, int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1)

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell, bytes, how far these are off, and distance from the centre."""
        cell = _nearest(rows, self.centres)
        left = _wide(rows - self.centres[cell])
        codes = np.stack([_nearest(left[:, k * NUMBERS : (k + 1) * NUMBERS], book) for k, book in enumerate(self.books)], axis=1).astype(np.uint8)
        told = np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], axis=1)
        return cell, codes, np.sqrt(((left - told) ** 2).sum(1)), np.sqrt((left * left).sum(1))

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, centres=self.centres, books=self.books, probes=np.array(self.probes))
        return out.getvalue()

    @staticmethod
    def unpack(raw: bytes) -> Model:
        held = np.load(io.BytesIO(raw))
        return Model(held["centres"], held["books"], int(held["probes"]))


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    return (batch.slice(s, rows) for s in range(0, len(batch), rows))


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * rows @ centres.T, axis=1)


def _by_distance(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argsort((centres * centres).sum(1) - 2 * rows @ centres.T, axis=1, kind="stable")


def _wide(rows: np.ndarray) -> np.ndarray:
    """With zeros up to a multiple of NUMBERS."""
    return np.pad(rows, ((0, 0), (0, -rows.shape[1] % NUMBERS)))


def _known(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")


class InvertedFile(Versions):
    """The index in a folder.  ``vec_id, embedding`` come in; null ids or vectors are
    in no index, and of rows that share an id the least vector counts.

    Batches are added without a change to what is there; a reader sees whole ones.
    """

    def _manifest(self, number: int | None = None) -> dict:
        number = self.version() if number is None else number
        return {"model": None, "batches": []} if number is None else self._content(number)

    def _read(self, name: str, manifest: dict) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/data/{b}/{name}" for b in manifest["batches"]])

    def model(self, number: int | None = None) -> Model:
        return Model.unpack(bytes(self.spark.read.parquet(f"{self.root}/data/{self._manifest(number)['model']}/model").first()[0]))

    def rows(self, number: int | None = None) -> DataFrame:
        """``vec_id, embedding, cell, part, codes, off`` of a version, by default the last."""
        return self._read("rows", self._manifest(number))

    def add(self, vectors: DataFrame, cells: int | None = None, recall: float = 0.95, part_rows: int = PART_ROWS) -> int:
        """Index the rows whose ids the index does not hold; how many.

        The first batch that has rows fits the model, on SAMPLE of them at most, with
        the root of their number as ``cells`` unless that is given.
        """
        manifest = self._manifest()
        fresh = _known(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        if manifest["batches"]:
            fresh = fresh.join(self._read("rows", manifest).select("vec_id"), "vec_id", "left_anti")
        fresh = materialize(fresh, "index-rows")
        n, low, high = fresh.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
        if not n:
            return 0
        folder = uuid.uuid4().hex
        if manifest["model"]:
            model = self.model()
        else:
            # A bounded sample, spread by the hash of the id.
            sample = fresh.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()
            if low == high:
                model = Model.fit(np.array([r[0] for r in sample], np.float64), min(cells or int(n**0.5), MOST_CELLS, len(sample)), recall)
        if low != high or low != len(model.centres[0]):
            raise ValueError(f"vectors of {low} to {high} numbers do not go into one index")
        if not manifest["model"]:
            self.spark.createDataFrame([(bytearray(model.pack()),)], "model binary").coalesce(1).write.parquet(f"{self.root}/data/{folder}/model")
        sent = self.spark.sparkContext.broadcast(model)

        def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in _slices(whole, ENCODED):
                    cell, codes, off, far = sent.value.encode(_matrix(batch.column("embedding")))
                    raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(batch), [None, pa.py_buffer(np.ascontiguousarray(codes))])
                    columns = [batch.column("vec_id"), batch.column("embedding"), pa.array(cell, pa.int64()), raw.cast(pa.binary()), pa.array(off), pa.array(far)]
                    yield pa.RecordBatch.from_arrays(columns, ["vec_id", "embedding", "cell", "codes", "off", "far"])

        kind = fresh.schema["embedding"].dataType.simpleString()
        placed = materialize(fresh.select("vec_id", "embedding").mapInArrow(place, f"vec_id long, embedding {kind}, cell long, codes binary, off double, far double"), "index-codes")
        self._write(placed, folder, len(manifest["batches"]), part_rows)
        self._publish((self.version() or 0) + 1, {"model": manifest["model"] or folder, "batches": [*manifest["batches"], folder]})
        return n

    def _write(self, placed: DataFrame, folder: str, batch: int, part_rows: int) -> None:
        """Rows by cell, so that a filter of cells skips row groups, and a row a part."""
        counts = placed.groupBy("cell").agg(F.ceil(F.count("*") / part_rows).alias("parts"))  # one row a cell
        part = F.pmod(F.xxhash64("vec_id"), F.col("parts")) + F.lit(batch << 32)
        rows = placed.join(F.broadcast(counts), "cell").withColumn("part", part).drop("parts")
        rows.repartitionByRange("cell", "part").sortWithinPartitions("cell", "part").write.parquet(f"{self.root}/data/{folder}/rows")
        written = self.spark.read.parquet(f"{self.root}/data/{folder}/rows")
        written.groupBy("cell", "part").agg(F.count("*").alias("n"), F.max("far").alias("far")).write.parquet(f"{self.root}/data/{folder}/parts")

    def compact(self, part_rows: int = PART_ROWS) -> None:
        """One batch in place of all; earlier versions stay."""
        manifest, folder = self._manifest(), uuid.uuid4().hex
        if manifest["batches"]:
            self._write(self._read("rows", manifest).drop("part"), folder, 0, part_rows)
            self._publish(self.version() + 1, manifest | {"batches": [folder]})

    def search(
        self, queries: DataFrame, k: int, min_score: float = 0.0, probes: int | None = None, take: int | None = None,
        exact: bool = False, number: int | None = None,
    ) -> DataFrame:
        """``query_id, vec_id, score, rank`` of the ``k`` best rows of each query.

        ``queries(vec_id, embedding)``; the ``take`` best rows by their bytes (by
        default 30 a result) in the ``probes`` nearest cells are scored again, as dot
        products.  With ``exact`` all other rows are asked that the bounds do not rule
        out.  Ties go to the lesser id; scores below ``min_score`` are dropped.
        """
        manifest = self._manifest(number)
        if not manifest["batches"]:
            return self.spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
        model, rows, parts = self.model(number), self._read("rows", manifest), self._read("parts", manifest)
        asked = materialize(_known(queries).select(F.col("vec_id").alias("query_id"), "embedding"), "index-asked")
        if asked.where(F.size("embedding") != len(model.centres[0])).limit(1).count():
            raise ValueError(f"queries have {len(model.centres[0])} numbers, as the index has")
        many = min(probes or model.probes, len(model.centres))
        near = self._met(asked.withColumn("floor", F.lit(float("-inf"))), model, lambda q, c, product, floor: np.isin(np.arange(len(c)), _by_distance(q[None], c)[0][:many]))
        best = Window.partitionBy("query_id").orderBy(F.desc("about"), "vec_id")
        kept = self._scan(near, rows, parts, model, take or 30 * k).withColumn("place", F.row_number().over(best)).where(F.col("place") <= (take or 30 * k))
        found = _scored(kept, asked, rows, k, min_score)
        if not exact:
            return found
        found = materialize(found, "index-found")
        floor = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        floored = asked.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float(min_score))))
        reach = np.full(len(model.centres), -np.inf)
        for r in parts.groupBy("cell").agg(F.max("far").alias("far")).collect():  # one row a cell
            reach[r["cell"]] = r["far"]

        def may(q: np.ndarray, c: np.ndarray, product: np.ndarray, floor: float) -> np.ndarray:
            length = np.sqrt(q @ q)
            return product + length * (reach + _SLACK * (1 + np.sqrt((c * c).sum(1)))) >= floor

        rest = self._scan(self._met(floored, model, may), rows, parts, model, None)
        return _scored(rest, asked, rows, k, min_score)

    def _met(self, asked: DataFrame, model: Model, chosen: Callable[[np.ndarray, np.ndarray, np.ndarray, float], np.ndarray]) -> DataFrame:
        """``query_id, embedding, floor, cell`` of the cells that ``chosen`` says."""
        sent = self.spark.sparkContext.broadcast(model)

        def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in _slices(whole, MET):
                    own, c = _matrix(batch.column("embedding")), sent.value.centres
                    floors, products = batch.column("floor").to_pylist(), own @ c.T
                    hits = [np.flatnonzero(chosen(q, c, p, f)) for q, p, f in zip(own, products, floors)]
                    repeated = batch.take(pa.array(np.repeat(np.arange(len(own)), [len(h) for h in hits])))
                    yield pa.RecordBatch.from_arrays([*repeated.columns, pa.array(np.concatenate(hits), pa.int64())], [*repeated.schema.names, "cell"])

        kind = asked.schema["embedding"].dataType.simpleString()
        met = asked.select("query_id", "embedding", "floor").mapInArrow(meet, f"query_id long, embedding {kind}, floor double, cell long")
        return materialize(met, "index-cells")

    def _scan(self, met: DataFrame, rows: DataFrame, parts: DataFrame, model: Model, take: int | None) -> DataFrame:
        """``query_id, vec_id, cell, part, about``: of each part the ``take`` best rows by
        bytes, or all that may reach the query's floor.  A block of queries meets a part
        of a cell in one task; both are bounded."""
        sizes = met.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("long").alias("blocks")).collect()  # one row a cell

        def blocks() -> DataFrame:
            return F.broadcast(self.spark.createDataFrame([(r["cell"], r["blocks"]) for r in sizes], "cell long, blocks long"))

        asked = met.join(blocks(), "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks"))).join(parts.select("cell", "part"), "cell")
        held = rows.select("cell", "part", "vec_id", "codes", "off")
        if len(sizes) < len(model.centres):
            held = held.where(F.col("cell").isin([r["cell"] for r in sizes]))
        held = held.join(blocks(), "cell").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        sent = self.spark.sparkContext.broadcast(model)

        def scan(ask: pa.Table, own: pa.Table) -> pa.Table:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            if len(ask) and len(own):
                cell = own.column("cell")[0].as_py()
                centre, books = sent.value.centres[cell], sent.value.books
                codes = np.frombuffer(b"".join(own.column("codes").to_pylist()), np.uint8).reshape(len(own), -1)
                ids, off = own.column("vec_id").to_numpy(), own.column("off").to_numpy()
                asking, floors, wide = ask.column("query_id").to_numpy(), ask.column("floor").to_numpy(), _matrix(ask.column("embedding").combine_chunks())
                for s in range(0, len(ask), AT_ONCE):
                    q = wide[s : s + AT_ONCE]
                    cut, about = _wide(q), np.repeat((q @ centre)[:, None], len(ids), axis=1)
                    for m, book in enumerate(books):
                        about += (cut[:, m * NUMBERS : (m + 1) * NUMBERS] @ book.T)[:, codes[:, m]]
                    if take is None:
                        length = np.sqrt((q * q).sum(1))[:, None]
                        a, b = np.nonzero(about + length * (off + _SLACK * (1 + np.sqrt(centre @ centre)))[None] >= floors[s : s + AT_ONCE, None])
                    else:
                        order = np.lexsort((np.broadcast_to(ids, about.shape), -about), axis=1)[:, :take]
                        a, b = np.repeat(np.arange(len(q)), order.shape[1]), order.ravel()
                    out.append((asking[s + a], ids[b], about[a, b]))
            query, vec, about = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            return pa.table({
                "query_id": query, "vec_id": vec, "about": about,
                "cell": np.full(len(query), own.column("cell")[0].as_py() if len(own) else 0, np.int64),
                "part": np.full(len(query), own.column("part")[0].as_py() if len(own) else 0, np.int64),
            })

        keys = ["cell", "part", "block"]
        return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(scan, "query_id long, vec_id long, about double, cell long, part long")


def _scored(kept: DataFrame, asked: DataFrame, rows: DataFrame, k: int, min_score: float) -> DataFrame:
    """The best of some rows by their whole vectors."""
    pairs = materialize(kept.select("query_id", "vec_id", "cell", "part"), "index-kept")
    both = pairs.join(rows.select("cell", "part", "vec_id", F.col("embedding").alias("own")), ["cell", "part", "vec_id"]).join(asked.select("query_id", "embedding"), "query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    scored = both.select("query_id", "vec_id", dot(F.col("embedding"), F.col("own")).alias("score")).where(F.col("score") >= min_score)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def build(spark: SparkSession, root: str, vectors: DataFrame, **options) -> InvertedFile:
    """A new index of a table in an empty folder."""
    index = InvertedFile(spark, root)
    index.add(vectors, **options)
    return index
