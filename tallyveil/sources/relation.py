"""Relations: a DataFrame with declared domains, filtered, projected and turned into histogram vectors."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyveil.functions.binning import Attribute, cell, predicate


@dataclass(frozen=True)
class Relation:
    frame: DataFrame
    attributes: tuple[Attribute, ...]

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(a.bins for a in self.attributes)

    @property
    def n(self) -> int:
        out = 1
        for k in self.shape:
            out *= k
        return out

    def where(self, text: str) -> Relation:
        return replace(self, frame=self.frame.filter(predicate(text)))

    def project(self, *names: str) -> Relation:
        """Keeps the named attributes, in declared order. Other columns stay readable by earlier filters alone."""
        if unknown := set(names) - {a.name for a in self.attributes}:
            raise ValueError(f"no attributes {sorted(unknown)}")
        return replace(self, attributes=tuple(a for a in self.attributes if a.name in names))

    def sparse(self, weight: str | None = None, reduced: tuple[int, ...] | None = None, bounds: tuple[float, float] | None = None) -> DataFrame:
        """(b0.., value) of the non-empty cells: one aggregate. reduced: a coarser shape that divides this one; bounds: those
        that weights are clipped to."""
        shape = reduced or self.shape
        if any(a % b for a, b in zip(self.shape, shape, strict=True)):
            raise ValueError("a reduced shape must divide the domain")
        w = F.col(weight).cast("double") if weight else F.lit(1)
        if bounds:
            w = F.least(F.greatest(w, F.lit(float(bounds[0]))), F.lit(float(bounds[1])))
        rows = self.frame.select(*[a.bin().alias(f"k{i}") for i, a in enumerate(self.attributes)], w.alias("w"))
        for i in range(len(shape)):
            rows = rows.where(F.col(f"k{i}").isNotNull())
        bins = [F.expr(f"k{i} div {a // b}").cast("int").alias(f"b{i}") for i, (a, b) in enumerate(zip(self.shape, shape, strict=True))]
        return rows.select(*bins, "w").groupBy(*[f"b{i}" for i in range(len(shape))]).agg(F.sum("w").alias("value"))

    def vectorize(self, weight: str | None = None, reduced: tuple[int, ...] | None = None, bounds: tuple[float, float] | None = None) -> DataFrame:
        """The dense vector (cell, value): empty cells are there with 0, for noise must cover them too."""
        shape = reduced or self.shape
        cells = self.sparse(weight, reduced, bounds).select(cell([F.col(f"b{i}") for i in range(len(shape))], shape).alias("cell"), "value")
        return dense(cells, _size(shape))

    def statistics(self) -> DataFrame:
        """Each attribute's mean, after recoding; recodings() gives the codes."""
        return self.frame.agg(*[F.avg(a.value()).alias(f"mean_{a.name}") for a in self.attributes])

    def recodings(self) -> dict[str, dict]:
        return {a.name: dict(a.recode) for a in self.attributes if a.recode}


def _size(shape: tuple[int, ...]) -> int:
    out = 1
    for k in shape:
        out *= k
    return out


def dense(cells: DataFrame, n: int) -> DataFrame:
    full = cells.sparkSession.range(n).select(F.col("id").alias("cell"))
    return full.join(cells, "cell", "left").select("cell", F.coalesce("value", F.lit(0)).alias("value"))


def load(spark: SparkSession, path: str, attributes: list[Attribute], form: str = "parquet", **options: object) -> Relation:
    """A relation from files; give CSV a schema in options rather than letting it be inferred."""
    reader = spark.read.options(**{k: v for k, v in options.items() if k != "schema"})
    if "schema" in options:
        reader = reader.schema(options["schema"])
    return Relation(reader.format(form).load(path), tuple(attributes))


def vector_from_text(spark: SparkSession, path: str) -> DataFrame:
    """(cell, value) from files of one number a line, numbered in the order of files and lines. Each partition counts its
    own lines, and the counts before it, one row a partition, are its offset."""
    lines = spark.read.text(path).select(F.trim("value").cast("double").alias("value"), F.monotonically_increasing_id().alias("id"))
    lines = lines.withColumn("part", F.shiftright("id", 33).cast("int")).withColumn("at", F.col("id").bitwiseAND((1 << 33) - 1))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lines.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    return lines.join(F.broadcast(offsets), "part").select((F.col("first") + F.col("at")).alias("cell"), "value")


def vector_from_array(spark: SparkSession, path: str) -> DataFrame:
    """(cell, value) from a .npy file on the driver, flattened in row-major order."""
    x = np.load(path).reshape(-1)
    return spark.createDataFrame(pa.table({"cell": np.arange(len(x)), "value": x.astype(float)}))


def write_libsvm(x: DataFrame, path: str) -> None:
    """Rows (label, features array<double>) in LIBSVM's text form, indices from 1, zeros left out."""
    terms = F.filter(F.transform("features", lambda v, i: F.when(v != 0, F.concat((i + 1).cast("string"), F.lit(":"), v.cast("string")))), lambda t: t.isNotNull())
    x.select(F.concat_ws(" ", F.col("label").cast("string"), F.array_join(terms, " ")).alias("value")).write.text(path)


class Sources:
    """Named relations."""

    def __init__(self) -> None:
        self._known: dict[str, tuple[str, list[Attribute], str]] = {}

    def register(self, name: str, path: str, attributes: list[Attribute], form: str = "parquet") -> None:
        self._known[name] = (path, sorted(attributes, key=lambda a: a.name), form)

    def load(self, spark: SparkSession, name: str) -> Relation:
        path, attributes, form = self._known[name]
        return load(spark, path, attributes, form)
