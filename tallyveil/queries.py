"""Named queries of the counting engine with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyveil.functions import noise
from tallyveil.functions.binning import Attribute
from tallyveil.operators import bayes, inference, measure, partitions, strategy, vectors
from tallyveil.operators import workload as w
from tallyveil.plans import algorithms
from tallyveil.plans.kernel import Protected
from tallyveil.sources import synthetic
from tallyveil.sources.relation import Relation, dense
from tallyveil.streaming.histogram import windowed_histogram

QUANTITY = Attribute("l_quantity", 50, 1, 51)
DISCOUNT = Attribute("l_discount", 11, -0.005, 0.105)
TAX = Attribute("l_tax", 9, -0.005, 0.085)
PRICE = Attribute("l_extendedprice", 64, 0, 131072)
FLAG = Attribute("l_returnflag", 3, 0, 3, {"A": 0, "N": 1, "R": 2})
BALANCE = Attribute("c_acctbal", 64, -1000, 10000)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def lineitem(spark: SparkSession, d: str, *attributes: Attribute) -> Relation:
    return Relation(spark.read.parquet(f"{d}/lineitem.parquet"), attributes)


def balances(spark: SparkSession, d: str) -> DataFrame:
    return Relation(spark.read.parquet(f"{d}/customer.parquet"), (BALANCE,)).vectorize()


def bin_sql(a: Attribute) -> str:
    """The binning rule in SQL, in the same order of operations."""
    v = f"CAST({a.name} AS DOUBLE)" if not a.recode else "CASE " + a.name + "".join(f" WHEN '{k}' THEN {float(x)}::DOUBLE" for k, x in a.recode.items()) + " END"
    s, lo, hi = (a.high - a.low) / a.bins, f"{float(a.low)!r}::DOUBLE", f"{float(a.high)!r}::DOUBLE"
    step = f"{s!r}::DOUBLE"
    k = f"floor(({v} - {lo}) / {step})"
    k = f"(CASE WHEN {v} < {k} * {step} + {lo} THEN {k} - 1 WHEN {v} >= ({k} + 1) * {step} + {lo} THEN {k} + 1 ELSE {k} END)"
    return f"(CASE WHEN {v} BETWEEN {lo} AND {hi} THEN CAST(least(greatest({k}, 0), {a.bins - 1}) AS BIGINT) END)"


def cell_sql(*attributes: Attribute) -> str:
    out = "0"
    for a in attributes:
        out = f"({out}) * {a.bins} + {bin_sql(a)}"
    return out


def vector_sql(table: str, *attributes: Attribute, where: str = "true", value: str = "CAST(count(*) AS BIGINT)") -> str:
    n = int(np.prod([a.bins for a in attributes]))
    return f"""x AS (SELECT r.cell, coalesce(value, 0) AS value FROM (SELECT unnest(range({n})) AS cell) r LEFT JOIN (
      SELECT {cell_sql(*attributes)} AS cell, {value} AS value FROM {table} WHERE {where} GROUP BY 1) USING (cell))"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


X = "WITH " + vector_sql("customer", BALANCE)
NOISE = "(-{scale}::DOUBLE * sign(u - 0.5::DOUBLE) * ln(1 - 2 * abs(u - 0.5::DOUBLE)))"
UNIFORM = "((CAST(('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 13)) AS UBIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def noise_sql(seed: str, key: str, scale: float) -> str:
    return NOISE.format(scale=repr(float(scale))).replace("u ", UNIFORM.format(seed=seed, key=key) + " ")


@query("WITH " + vector_sql("lineitem", DISCOUNT, where="l_quantity >= 30") + f", y AS (SELECT cell, value + {noise_sql('cdf', 'cell', 10.0)} AS value FROM x) SELECT cell AS query, round(sum(value) OVER (ORDER BY cell), 6) AS value FROM y")
def private_cdf(spark, d):
    """The flagship: filter, histogram, noisy identity, running sum."""
    x = lineitem(spark, d, DISCOUNT, QUANTITY).where("l_quantity >= 30").project("l_discount").vectorize()
    y = measure.laplace(w.Identity(11), x, 0.1, "cdf")
    return w.Prefix(11).apply(y.withColumnRenamed("query", "cell")).select("query", F.round("value", 6).alias("value"))


@query("WITH " + vector_sql("lineitem", QUANTITY) + " SELECT * FROM x")
def vectorize_1d(spark, d):
    return lineitem(spark, d, QUANTITY).vectorize()


@query("WITH " + vector_sql("lineitem", DISCOUNT, TAX, FLAG) + " SELECT * FROM x")
def vectorize_3d_recoded(spark, d):
    return lineitem(spark, d, DISCOUNT, TAX, FLAG).vectorize()


@query("WITH " + vector_sql("lineitem", Attribute("l_extendedprice", 64, 0, 131072)) + " SELECT cell // 8 AS cell, CAST(sum(value) AS BIGINT) AS value FROM x GROUP BY 1")
def vectorize_reduced(spark, d):
    return lineitem(spark, d, PRICE).vectorize(reduced=(8,))


@query("WITH " + vector_sql("lineitem", QUANTITY, value="sum(l_tax)") + " SELECT cell, round(value, 6) AS value FROM x")
def vectorize_weighted(spark, d):
    return lineitem(spark, d, QUANTITY).vectorize(weight="l_tax").select("cell", F.round("value", 6).alias("value"))


@query("SELECT b AS cell, CAST(count(*) AS BIGINT) AS value FROM (SELECT CASE WHEN p_size BETWEEN 1 AND 50 THEN (p_size >= 5)::BIGINT + (p_size >= 20)::BIGINT END AS b FROM part) WHERE b IS NOT NULL GROUP BY 1")
def vectorize_edges(spark, d):
    return Relation(spark.read.parquet(f"{d}/part.parquet"), (Attribute("p_size", 3, edges=(1, 5, 20, 50)),)).vectorize()


@query("WITH " + vector_sql("lineitem", TAX, where="l_quantity BETWEEN 5 AND 20 AND l_returnflag IN ('A', 'R') AND NOT l_discount > 0.05") + " SELECT * FROM x")
def where_project_vectorize(spark, d):
    return lineitem(spark, d, TAX, QUANTITY).where("5 <= l_quantity <= 20 and l_returnflag in ['A', 'R'] and not l_discount > 0.05").project("l_tax").vectorize()


@query("SELECT avg(CAST(l_quantity AS DOUBLE)) AS mean_l_quantity, round(avg(CAST(l_tax AS DOUBLE)), 8) AS mean_l_tax FROM lineitem")
def relation_statistics(spark, d):
    return lineitem(spark, d, QUANTITY, TAX).statistics().select("mean_l_quantity", F.round("mean_l_tax", 8).alias("mean_l_tax"))


@query(X + " SELECT avg((value <> 0)::DOUBLE) AS nonzero, max(value)::DOUBLE AS max_count, sum(value)::DOUBLE AS total FROM x")
def histogram_stats(spark, d):
    return vectors.histogram_stats(balances(spark, d))


@query(X + " SELECT CAST(0 AS BIGINT) AS query, CAST(sum(value) AS BIGINT) AS value FROM x")
def total(spark, d):
    return w.Total(64).apply(balances(spark, d))


@query(X + " SELECT cell AS query, CAST(sum(value) OVER (ORDER BY cell) AS BIGINT) AS value FROM x")
def prefix(spark, d):
    return w.Prefix(64).apply(balances(spark, d))


@query(X + " SELECT cell AS query, CAST(sum(value) OVER (ORDER BY cell DESC) AS BIGINT) AS value FROM x")
def suffix(spark, d):
    return w.Suffix(64).apply(balances(spark, d))


@query(X + " SELECT a.cell AS query, CAST(sum(b.value) AS BIGINT) AS value FROM x a JOIN x b ON b.cell BETWEEN a.cell AND a.cell + 4 WHERE a.cell <= 59 GROUP BY 1")
def width_k_range(spark, d):
    return w.WidthK(64, 5).apply(balances(spark, d))


@query(X + ", q AS (SELECT a.cell AS i, b.cell AS j FROM x a JOIN x b ON b.cell >= a.cell) SELECT i * 64 - i * (i - 1) // 2 + j - i AS query, sum(value)::DOUBLE AS value FROM q JOIN x ON cell BETWEEN i AND j GROUP BY i, j")
def all_range(spark, d):
    return w.all_ranges(64).apply(balances(spark, d))


def _boxes() -> w.Ranges:
    return w.random_ranges((10, 8), 25)


_GRID = (Attribute("l_quantity", 10, 1, 51), Attribute("l_extendedprice", 8, 0, 131072))


@query("WITH " + vector_sql("lineitem", *_GRID) + ", q(query, a, b, c, e) AS (VALUES " + ", ".join(f"({k}::BIGINT, {a[0]}, {b[0]}, {a[1]}, {b[1]})" for k, (a, b) in enumerate(zip(_boxes().low, _boxes().high, strict=True))) + ") SELECT query, sum(value)::DOUBLE AS value FROM q JOIN x ON cell // 8 BETWEEN a AND b AND cell % 8 BETWEEN c AND e GROUP BY 1")
def range_2d_corners(spark, d):
    return _boxes().apply(lineitem(spark, d, *_GRID).vectorize())


@query(X + " SELECT k - 1 AS query, sum(pow(cell, k) * value)::DOUBLE AS value FROM x, (SELECT unnest([1, 2, 3])::BIGINT AS k) GROUP BY 1")
def moments(spark, d):
    return w.moments(64).apply(balances(spark, d))


@query(f"WITH t AS (SELECT {bin_sql(DISCOUNT)} AS b0, {bin_sql(TAX)} AS b1, {bin_sql(FLAG)} AS b2 FROM lineitem) SELECT coalesce(b0, -1)::INT AS b0, coalesce(b1, -1)::INT AS b1, coalesce(b2, -1)::INT AS b2, CAST(count(*) AS BIGINT) AS value FROM t WHERE b0 IS NOT NULL AND b1 IS NOT NULL AND b2 IS NOT NULL GROUP BY GROUPING SETS ((b0, b1), (b0, b2), (b1, b2), (b0), (b1), (b2))")
def marginals_up_to_2(spark, d):
    return w.marginals(lineitem(spark, d, DISCOUNT, TAX, FLAG).sparse(), [(0, 1), (0, 2), (1, 2), (0,), (1,), (2,)], 3)


@query("WITH " + vector_sql("lineitem", *_GRID) + " SELECT (a.cell // 8) * 8 + a.cell % 8 AS query, sum(b.value)::DOUBLE AS value FROM x a JOIN x b ON b.cell // 8 <= a.cell // 8 AND b.cell % 8 <= a.cell % 8 GROUP BY 1")
def prefix_2d(spark, d):
    return w.Kronecker([w.Prefix(10), w.Prefix(8)]).apply(lineitem(spark, d, *_GRID).vectorize())


@query("WITH " + vector_sql("lineitem", *_GRID) + " SELECT cell // 8 AS query, sum(value)::DOUBLE AS value FROM x GROUP BY 1")
def kron_identity_total(spark, d):
    return w.Kronecker([w.Identity(10), w.Total(8)]).apply(lineitem(spark, d, *_GRID).vectorize())


def boxes_sql(shape: tuple[int, ...], branching: int, root: bool = True) -> str:
    """t(level, low, high per attribute): the boxes of a tree, by its rule: part i of an interval of length n begins at
    ceil(n * i / b), b being no more than n."""
    d = range(len(shape))
    part = lambda i, k: f"a{i} + CAST(ceil((z{i} - a{i} + 1) * {k} / least({branching}, z{i} - a{i} + 1)::DOUBLE) AS BIGINT)"
    start = ", ".join(f"0::BIGINT AS a{i}, {n - 1}::BIGINT AS z{i}" for i, n in enumerate(shape))
    step = ", ".join(f"{part(i, f'k{i}')}, {part(i, f'(k{i} + 1)')} - 1" for i in d)
    tables = "".join(f", (SELECT unnest(range({branching})) AS k{i}) u{i}" for i in d)
    larger, inside = " OR ".join(f"z{i} > a{i}" for i in d), " AND ".join(f"k{i} < least({branching}, z{i} - a{i} + 1)" for i in d)
    shift = 0 if root else 1
    strides = [int(np.prod(shape[i + 1 :])) for i in d]
    low = " + ".join(f"a{i} * {k}" for i, k in enumerate(strides))
    n, cut = int(np.prod(shape)), "" if root else " AND level > 0"
    columns = ", ".join(f"a{i}, z{i}" for i in d)
    held = " AND ".join(f"(cell // {k}) % {m} BETWEEN a{i} AND z{i}" for i, (k, m) in enumerate(zip(strides, shape, strict=True)))
    return f"""t(level, {columns}) AS (SELECT 0, {start} UNION ALL SELECT level + 1, {step} FROM t{tables} WHERE ({larger}) AND {inside}),
      larger AS (SELECT * FROM t WHERE ({larger}){cut}), leaf AS (SELECT coalesce(max(level) + 1 - {shift}, 0) AS level FROM larger),
      boxes AS (SELECT (level - {shift}) * {n} + {low} AS query, sum(value) AS value, count(*) AS size FROM larger JOIN x ON {held} GROUP BY ALL
        UNION ALL SELECT level * {n} + cell, value, 1 FROM x, leaf)"""


def recursive(vector: str) -> str:
    return "WITH RECURSIVE " + vector


@query(recursive(vector_sql("customer", BALANCE)) + ", " + boxes_sql((64,), 2) + " SELECT query, CAST(value AS BIGINT) AS value FROM boxes")
def h2_tree(spark, d):
    return w.Tree(64, 2).apply(balances(spark, d))


@query(recursive(vector_sql("customer", BALANCE)) + ", " + boxes_sql((64,), 8, False) + " SELECT query, CAST(value AS BIGINT) AS value FROM boxes")
def tree_8(spark, d):
    return w.Tree(64, 8, root=False).apply(balances(spark, d))


_UNEVEN = {n: Attribute("l_extendedprice", n, 0, 131072) for n in (50, 560)}


@query(recursive(vector_sql("lineitem", _UNEVEN[50])) + ", " + boxes_sql((50,), 3, False) + " SELECT query, CAST(value AS BIGINT) AS value FROM boxes")
def hb_tree_50(spark, d):
    """A size that the branching does not divide."""
    return w.Tree(50, 3, root=False).apply(lineitem(spark, d, _UNEVEN[50]).vectorize())


@query(recursive(vector_sql("lineitem", _UNEVEN[560])) + ", " + boxes_sql((560,), 24, False) + " SELECT query, CAST(value AS BIGINT) AS value FROM boxes")
def hb_tree_560(spark, d):
    return w.hb_tree((560,)).apply(lineitem(spark, d, _UNEVEN[560]).vectorize())


@query(recursive(vector_sql("lineitem", *_GRID)) + ", " + boxes_sql((10, 8), 2) + " SELECT query, CAST(value AS BIGINT) AS value FROM boxes")
def h2_2d(spark, d):
    return w.Hierarchy((10, 8), 2).apply(lineitem(spark, d, *_GRID).vectorize())


@query(recursive(vector_sql("lineitem", DISCOUNT, TAX, FLAG)) + ", " + boxes_sql((11, 9, 3), 3, False) + " SELECT query, CAST(value AS BIGINT) AS value FROM boxes")
def hierarchy_3d(spark, d):
    return w.Hierarchy((11, 9, 3), 3, root=False).apply(lineitem(spark, d, DISCOUNT, TAX, FLAG).vectorize())


@query(X + " SELECT CASE WHEN l = 0 THEN 0 ELSE (1 << (l - 1)) + cell // (64 >> (l - 1)) END::BIGINT AS query, CAST(sum(CASE WHEN l = 0 OR cell % (64 >> (l - 1)) < (64 >> l) THEN value ELSE -value END) AS BIGINT) AS value FROM x, (SELECT unnest(range(7))::INT AS l) GROUP BY 1")
def haar(spark, d):
    return w.Haar(64).apply(balances(spark, d))


@query("WITH RECURSIVE " + vector_sql("lineitem", *_GRID) + ", t(r0, r1, c0, c1) AS (SELECT 0::BIGINT, 9::BIGINT, 0::BIGINT, 7::BIGINT UNION ALL SELECT r0 + h * ((r1 - r0 + 1) // 2), CASE WHEN h = 0 AND r1 > r0 THEN r0 + (r1 - r0 + 1) // 2 - 1 ELSE r1 END, c0 + g * ((c1 - c0 + 1) // 2), CASE WHEN g = 0 AND c1 > c0 THEN c0 + (c1 - c0 + 1) // 2 - 1 ELSE c1 END FROM t, (VALUES (0), (1)) u(h), (VALUES (0), (1)) v(g) WHERE (r1 > r0 OR c1 > c0) AND (h = 0 OR r1 > r0) AND (g = 0 OR c1 > c0)) SELECT r0, c0, r1, c1, sum(value)::DOUBLE AS value FROM t JOIN x ON cell // 8 BETWEEN r0 AND r1 AND cell % 8 BETWEEN c0 AND c1 GROUP BY ALL")
def quadtree_nodes(spark, d):
    """Every node of the quad tree with its box, corners inclusive."""
    tree = strategy.quad_tree((10, 8))
    boxes = spark.createDataFrame([(k, *a, *b) for k, (a, b) in enumerate(zip(tree.low.tolist(), tree.high.tolist(), strict=True))], "query long, r0 long, c0 long, r1 long, c1 long")
    return tree.apply(lineitem(spark, d, *_GRID).vectorize()).join(boxes, "query").select("r0", "c0", "r1", "c1", "value")


@query(X + " SELECT cell // 4 AS cell, CAST(sum(value) AS BIGINT) AS value FROM x GROUP BY 1")
def grid_reduce(spark, d):
    x = balances(spark, d)
    return vectors.reduce_by(x, x.select("cell", vectors.grid(64, 4).alias("part")))


@query(X + " SELECT cell, avg(value) OVER (PARTITION BY cell // 4) AS value FROM x")
def reduce_expand(spark, d):
    x = balances(spark, d)
    parts = x.select("cell", vectors.grid(64, 4).alias("part"))
    return vectors.expand_by(vectors.reduce_by(x, parts), parts)


@query(X + " SELECT cell % 8 AS part, cell // 8 AS local, value FROM x")
def striped_split(spark, d):
    x = balances(spark, d)
    return vectors.split_by(x, x.select("cell", F.expr("cell % 8").alias("part")))


@query(X + " SELECT cell, CASE WHEN cell % 3 = 0 THEN value ELSE 0 END AS value FROM x")
def filter_mask(spark, d):
    return vectors.masked(balances(spark, d), F.col("cell") % 3 == 0)


@query(X + f" SELECT cell AS query, round(value + {noise_sql('id', 'cell', 2.0)}, 6) AS value FROM x")
def laplace_identity(spark, d):
    return measure.laplace(w.Identity(64), balances(spark, d), 0.5, "id").select("query", F.round("value", 6).alias("value"))


@query(X + f" SELECT cell AS query, round(sum(value) OVER (ORDER BY cell) + {noise_sql('pre', 'cell', 128.0)}, 6) AS value FROM x")
def laplace_prefix(spark, d):
    return measure.laplace(w.Prefix(64), balances(spark, d), 0.5, "pre").select("query", F.round("value", 6).alias("value"))


@query(X + f" SELECT arg_max(cell, value + {noise_sql('max', 'cell', 10.0)}) AS query FROM x")
def noisy_max(spark, d):
    return measure.noisy_max(balances(spark, d).withColumnRenamed("cell", "query"), 0.1, "max")


@query(X + " SELECT arg_max(cell, 0.1::DOUBLE * value / 2 - ln(-ln(" + UNIFORM.format(seed="exp", key="cell") + "))) AS query FROM x")
def exponential_mechanism(spark, d):
    return measure.exponential(balances(spark, d).withColumnRenamed("cell", "query"), 0.1, "exp")


@query(X + f" SELECT cell, CASE WHEN value <= {0.35 * float(np.log(64)) / (0.1 * 0.35)!r}::DOUBLE THEN 0.0::DOUBLE ELSE value::DOUBLE END AS value FROM x")
def ahp_threshold(spark, d):
    return inference.threshold(balances(spark, d), 64, 0.1)


@query(X + ", n AS (SELECT sum(value)::DOUBLE AS n FROM x), m AS (SELECT cell, n, n / 64 * exp((value - n / 64) / (2 * n)) AS v FROM x, n) SELECT cell, round(v * n / sum(v) OVER (), 6) AS value FROM m")
def mw_one_round(spark, d):
    x = balances(spark, d)
    total = float(x.agg(F.sum("value")).first()[0])
    flat, steps = x.select("cell", F.lit(total / 64.0).alias("value")), x.select("cell", (F.col("value") - total / 64.0).alias("step"))
    return inference.multiplicative_round(flat, steps, total).select("cell", F.round("value", 6).alias("value"))


@query(f"WITH t AS (SELECT {bin_sql(DISCOUNT)} AS a, {bin_sql(FLAG)} AS b FROM lineitem), p AS (SELECT a, b, count(*)::DOUBLE / sum(count(*)) OVER () AS v FROM t GROUP BY 1, 2) SELECT round(sum(v * ln(v / (pa * pb)) / ln(2)), 8) AS information FROM (SELECT v, sum(v) OVER (PARTITION BY a) AS pa, sum(v) OVER (PARTITION BY b) AS pb FROM p)")
def mutual_information(spark, d):
    """Of two attributes, from one contingency table of the domain's size."""
    t = lineitem(spark, d, DISCOUNT, FLAG).sparse()
    n, a, b = t.agg(F.sum("value").alias("n")), t.groupBy("b0").agg(F.sum("value").alias("na")), t.groupBy("b1").agg(F.sum("value").alias("nb"))
    p = t.join(F.broadcast(a), "b0").join(F.broadcast(b), "b1").crossJoin(F.broadcast(n))
    return p.agg(F.round(F.sum(F.col("value") / F.col("n") * F.ln(F.col("value") * F.col("n") / (F.col("na") * F.col("nb"))) / F.ln(F.lit(2.0))), 8).alias("information"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, CAST(floor(value / 8) AS BIGINT) AS cell, count(*) AS value FROM events WHERE value BETWEEN 0 AND 512 GROUP BY 1, 2")
def windowed_histogram_daily(spark, d):
    return windowed_histogram(spark.read.parquet(f"{d}/events.parquet"), [Attribute("value", 64, 0, 512)], "ts", "1 day", "1 hour")


# Further operators


@query(X + " SELECT cell AS query, value::DOUBLE AS value FROM x UNION ALL SELECT 64, 0.5::DOUBLE * sum(value) FROM x")
def identity_total(spark, d):
    return w.identity_total(64, 0.5).apply(balances(spark, d)).select("query", F.col("value").cast("double").alias("value"))


@query(X + " SELECT q AS query, CAST(sum(value) AS BIGINT) AS value FROM x, (SELECT unnest(range(3)) AS q) GROUP BY 1")
def ones(spark, d):
    return w.Ones(3, 64).apply(balances(spark, d))


@query(X + " SELECT cell AS query, 2.0::DOUBLE * sum(value) OVER (ORDER BY cell) - value AS value FROM x")
def weighted_difference(spark, d):
    return (2.0 * w.Prefix(64) - w.Identity(64)).apply(balances(spark, d))


@query(X + " SELECT cell % 32 AS query, CAST(sum(sum(CASE WHEN cell < 32 THEN value END)) OVER (ORDER BY cell % 32) + sum(CASE WHEN cell >= 32 THEN value END) AS BIGINT) AS value FROM x GROUP BY 1")
def beside(spark, d):
    return w.Beside([w.Prefix(32), w.Identity(32)]).apply(balances(spark, d))


@query(X + ", p AS (SELECT cell, sum(value) OVER (ORDER BY cell) AS value FROM x) SELECT cell // 8 AS query, CAST(sum(value) AS BIGINT) AS value FROM p GROUP BY 1")
def product(spark, d):
    return (w.Blocks(64, 8) @ w.Prefix(64)).apply(balances(spark, d))


@query(X + ", l AS (SELECT unnest(range(7))::INT AS l) SELECT c.cell AS query, CAST(sum(CASE WHEN l = 0 OR c.cell % (64 >> (l - 1)) < (64 >> l) THEN y.value ELSE -y.value END) AS BIGINT) AS value FROM x c, l JOIN x y ON y.cell = CASE WHEN l = 0 THEN 0 ELSE (1 << (l - 1)) + c.cell // (64 >> (l - 1)) END GROUP BY 1")
def haar_adjoint(spark, d):
    return w.Haar(64).transpose().apply(balances(spark, d)).select("query", F.col("value").cast("long").alias("value"))


@query(X + ", small AS (SELECT cell, value FROM x WHERE cell < 8) SELECT row_number() OVER (ORDER BY a.cell, b.cell, c.cell) - 1 AS query, (a.value + b.value + c.value)::DOUBLE AS value FROM small a, small b, small c WHERE a.cell < b.cell AND b.cell < c.cell UNION ALL SELECT 56 + cell, value FROM small")
def all_norm_k(spark, d):
    return w.all_norm_k(8, [3, 1]).apply(balances(spark, d).where("cell < 8"))


@query("WITH " + vector_sql("lineitem", *_GRID) + ", q AS (SELECT unnest(range(80)) AS query) SELECT query, sum(CASE WHEN cell // 8 <= query // 8 OR cell % 8 = query % 8 THEN value ELSE 0 END)::DOUBLE AS value FROM q, x GROUP BY 1")
def disjunction(spark, d):
    return w.disjuncts([w.Prefix(10), w.Identity(8)]).apply(lineitem(spark, d, *_GRID).vectorize()).select("query", F.col("value").cast("double").alias("value"))


@query(X + " SELECT CASE k WHEN 2 THEN 0 ELSE 63 END + a.cell AS query, CAST(sum(b.value) AS BIGINT) AS value FROM (VALUES (2), (10)) v(k), x a JOIN x b ON b.cell >= a.cell WHERE b.cell < a.cell + k AND a.cell <= 64 - k GROUP BY ALL")
def width_k_ranges(spark, d):
    return w.width_k_ranges(64, [2, 10]).apply(balances(spark, d))


_SIDED = w.random_ranges((11, 9), 12, 7, [(2, 3), (4, 1)]).unproject((11, 9, 3), (0, 1))


@query("WITH " + vector_sql("lineitem", DISCOUNT, TAX, FLAG) + ", q(query, a, b, c, e) AS (VALUES " + ", ".join(f"({k}::BIGINT, {a[0]}, {b[0]}, {a[1]}, {b[1]})" for k, (a, b) in enumerate(zip(_SIDED.low.tolist(), _SIDED.high.tolist(), strict=True))) + ") SELECT query, sum(value)::DOUBLE AS value FROM q JOIN x ON cell // 27 BETWEEN a AND b AND (cell // 3) % 9 BETWEEN c AND e GROUP BY 1")
def unprojected_ranges(spark, d):
    """Boxes of given sides over two of three attributes."""
    return _SIDED.apply(lineitem(spark, d, DISCOUNT, TAX, FLAG).vectorize())


@query("WITH " + vector_sql("lineitem", DISCOUNT, TAX, FLAG) + " SELECT cell // 27 * 3 + cell % 3 AS query, 2.0 * sum(value)::DOUBLE AS value FROM x GROUP BY 1 UNION ALL SELECT 33 + cell // 27 * 9 + (cell // 3) % 9, 0.5 * sum(value) FROM x GROUP BY 1")
def weighted_marginals(spark, d):
    keys = {w.key_of((0, 2), 3): 2.0, w.key_of((0, 1), 3): 0.5}
    return w.weighted_marginals((11, 9, 3), keys).apply(lineitem(spark, d, DISCOUNT, TAX, FLAG).vectorize())


@query("WITH " + vector_sql("lineitem", DISCOUNT, TAX, FLAG) + " SELECT (cell // 3) % 9 * 3 + cell % 3 AS query, CAST(sum(value) AS BIGINT) AS value FROM x GROUP BY 1 UNION ALL SELECT 27 + cell // 27 * 3 + cell % 3, sum(value) FROM x GROUP BY 1 UNION ALL SELECT 60 + cell // 3, sum(value) FROM x GROUP BY 1")
def two_way_marginals(spark, d):
    return w.k_way_marginals((11, 9, 3), 2).apply(lineitem(spark, d, DISCOUNT, TAX, FLAG).vectorize())


@query(X + ", g AS (SELECT a.cell AS cell, b.cell AS b FROM x a, x b) SELECT cell, b, (64 - greatest(cell, b))::DOUBLE AS value FROM g WHERE cell < 8 AND b < 8")
def gram_of_prefix(spark, d):
    g = w.Gram(w.Prefix(64).gram()).gram()[:8, :8]
    i, j = np.indices(g.shape)
    return w.frame(spark, cell=i.reshape(-1), b=j.reshape(-1), value=g.reshape(-1))


@query("WITH v AS (SELECT unnest(range(24)) AS i), s AS (SELECT a.i AS a, b.i AS b, CASE WHEN a.i // 12 = b.i // 12 AND a.i % 4 = b.i % 4 THEN 4.0 ELSE 0 END + CASE WHEN a.i % 12 = b.i % 12 THEN 1.0 ELSE 0 END AS value FROM v a, v b) SELECT a, b, value::DOUBLE AS value FROM s WHERE value > 0")
def marginals_gram(spark, d):
    """Of two weighted marginals of a 2 x 3 x 4 domain, from eight numbers."""
    g = w.MarginalsGram.of((2, 3, 4), {w.key_of((0, 2), 3): 2.0, w.key_of((1, 2), 3): 1.0}).numpy()
    i, j = np.nonzero(g)
    return w.frame(spark, a=i, b=j, value=g[i, j])


def _by_part(spark, d, part: np.ndarray) -> DataFrame:
    x = balances(spark, d)
    return vectors.reduce_by(x, w.frame(spark, cell=np.arange(len(part)), part=part))


@query(X + " SELECT (cell // 8) // 3 * 4 + (cell % 8) // 2 AS cell, CAST(sum(value) AS BIGINT) AS value FROM x GROUP BY 1")
def combined_partition(spark, d):
    return _by_part(spark, d, partitions.combine(np.arange(8) // 3, np.arange(8) // 2))


@query(X + " SELECT cell // 8 * 1 AS cell, CAST(sum(value) AS BIGINT) AS value FROM x GROUP BY 1")
def striped_partition(spark, d):
    return _by_part(spark, d, partitions.striped((8, 8), 1))


@query(X + " SELECT cell % 8 AS cell, CAST(sum(value) AS BIGINT) AS value FROM x GROUP BY 1")
def marginal_partition(spark, d):
    return _by_part(spark, d, partitions.of_marginal((8, 8), 1))


@query(X + " SELECT (cell // 8) // 3 * 3 + (cell % 8) // 3 AS cell, CAST(sum(value) AS BIGINT) AS value FROM x GROUP BY 1")
def uniform_grid_partition(spark, d):
    """Cells of side 3, the last ones clipped."""
    return _by_part(spark, d, partitions.of_boxes(strategy.uniform_grid((8, 8), 0, 1, side=3)))


@query(X + " SELECT CASE WHEN cell < 40 THEN 0 WHEN cell < 50 THEN 1 ELSE 2 END::BIGINT AS cell, CAST(sum(value) AS BIGINT) AS value FROM (SELECT 63 - cell AS cell, value FROM x) GROUP BY 1")
def cluster_partition(spark, d):
    """Runs of places, the cells' places given by a rank."""
    return _by_part(spark, d, partitions.of_clusters([(0, 40), (40, 50), (50, 64)], range(63, -1, -1)))


@query(X + " SELECT row_number() OVER (ORDER BY v.k) - 1 AS cell, value FROM (VALUES (0, 60), (1, 3), (2, 17)) v(k, c) JOIN x ON cell = c")
def group_cells(spark, d):
    table = Relation(spark.read.parquet(f"{d}/customer.parquet"), (BALANCE,))
    return Protected.over(table, 1, seed="group").vectorize().group([60, 3, 17])._data


@query(X + ", free AS (SELECT value, row_number() OVER (ORDER BY cell) - 1 AS k FROM x WHERE cell NOT BETWEEN 10 AND 29) SELECT 0::BIGINT AS query, sum(value)::DOUBLE AS value FROM x WHERE cell BETWEEN 10 AND 29 UNION ALL SELECT 1 + k // 8, sum(value) FROM free GROUP BY ALL")
def added_intervals(spark, d):
    """A query, and sums of eight cells each of what it leaves out."""
    return strategy.with_intervals(w.Ranges((64,), [10], [29]), 8).apply(balances(spark, d)).select("query", F.col("value").cast("double").alias("value"))


@query(X + " SELECT cell AS query, sum(b) OVER (ORDER BY cell)::DOUBLE AS value FROM (SELECT cell // 16 AS cell, sum(value) AS b FROM x GROUP BY 1)")
def lossless_reduction(spark, d):
    """Cells that a workload treats alike are summed first; the workload over the parts gives the same answers."""
    workload = w.Prefix(4) @ w.Blocks(64, 16)
    part = strategy.same_columns(workload.numpy())
    return (workload @ partitions.expansion(part)).apply(_by_part(spark, d, part)).select("query", F.col("value").cast("double").alias("value"))


@query("WITH p AS (SELECT *, sum(s) OVER (ORDER BY cell) / 10.0 AS upto FROM (VALUES (0, 1.0::DOUBLE), (1, 2.0), (3, 4.0), (4, 3.0)) v(cell, s)), u AS (SELECT " + UNIFORM.format(seed="draw", key="i") + " AS u FROM (SELECT unnest(range(5000)) AS i)), c AS (SELECT (SELECT min(cell) FROM p WHERE upto > u) AS cell FROM u) SELECT r.cell, count(c.cell) AS value FROM (SELECT unnest(range(6)) AS cell) r LEFT JOIN c USING (cell) GROUP BY 1")
def sampled_histogram(spark, d):
    shares = w.frame(spark, cell=np.array([0, 1, 3, 4]), share=np.array([1.0, 2, 4, 3]))
    return synthetic.sampled(shares, 6, 5000, "draw")


@query("WITH r AS (SELECT i AS cell, row_number() OVER (ORDER BY " + UNIFORM.format(seed="even", key="i") + ", i) AS k FROM (SELECT unnest(range(100)) AS i)) SELECT cell, CASE WHEN k <= 30 THEN 1000.0::DOUBLE / 30 ELSE 0 END AS value FROM r")
def uniformity_histogram(spark, d):
    return synthetic.uniformity(spark, 100, 0.3, 1000.0, "even")


@query("WITH r AS (SELECT i AS cell, row_number() OVER (ORDER BY " + UNIFORM.format(seed="z/cells", key="i") + ", i) AS k FROM (SELECT unnest(range(200)) AS i)), s AS (SELECT cell, pow(k, -1.5) AS s FROM r WHERE k <= 40), p AS (SELECT cell, sum(s) OVER (ORDER BY cell) / sum(s) OVER () AS upto FROM s), u AS (SELECT " + UNIFORM.format(seed="z/draws", key="i") + " AS u FROM (SELECT unnest(range(3000)) AS i)), c AS (SELECT (SELECT min(cell) FROM p WHERE upto > u) AS cell FROM u) SELECT r.cell, count(c.cell) AS value FROM r LEFT JOIN c USING (cell) GROUP BY 1")
def zipf_histogram(spark, d):
    return synthetic.zipf(spark, 200, 3000, "z", power=1.5)


@query("WITH p AS (SELECT a.k * 3 + b.k AS cell, a.s / 4.0 * b.s / 10.0 AS s FROM (VALUES (0, 1.0::DOUBLE), (1, 3.0)) a(k, s), (VALUES (0, 5.0::DOUBLE), (1, 3.0), (2, 2.0)) b(k, s)), q AS (SELECT cell, sum(s) OVER (ORDER BY cell) AS upto FROM p), u AS (SELECT " + UNIFORM.format(seed="census", key="i") + " AS u FROM (SELECT unnest(range(4000)) AS i)), c AS (SELECT (SELECT min(cell) FROM q WHERE upto > u) AS cell FROM u) SELECT r.cell, count(c.cell) AS value FROM (SELECT unnest(range(6)) AS cell) r LEFT JOIN c USING (cell) GROUP BY 1")
def product_histogram(spark, d):
    """Independent attributes with published marginals."""
    return synthetic.product(spark, [[1, 3], [5, 3, 2]], 4000, "census")


_LAWS = {"exponential": "-2.0::DOUBLE * ln({u})", "geometric": "floor(ln({u}) / ln(1 - 0.25::DOUBLE))", "cauchy": "3.0::DOUBLE * tan(pi() * ({u} - 0.5::DOUBLE))"}


@query("SELECT i AS id, " + ", ".join(f"round({f.format(u=UNIFORM.format(seed=k, key='i'))}, 6) AS {k}" for k, f in _LAWS.items()) + ", round(2.0::DOUBLE * sqrt(-2 * ln(" + UNIFORM.format(seed="gaussian/r", key="i") + ")) * cos(2 * pi() * " + UNIFORM.format(seed="gaussian/a", key="i") + "), 6) AS gaussian, floor(ln(" + UNIFORM.format(seed="discrete/a", key="i") + ") * -5.0::DOUBLE)::BIGINT - floor(ln(" + UNIFORM.format(seed="discrete/b", key="i") + ") * -5.0::DOUBLE)::BIGINT AS discrete, CASE WHEN " + UNIFORM.format(seed="choice", key="i") + " * 4 >= 1 THEN 1 ELSE 0 END + CASE WHEN " + UNIFORM.format(seed="choice", key="i") + " * 4 >= 3 THEN 1 ELSE 0 END AS choice FROM (SELECT unnest(range(200)) AS i)")
def noise_laws(spark, d):
    k = F.col("id")
    laws = {"exponential": noise.exponential("exponential", k, 2.0), "geometric": noise.geometric("geometric", k, 0.25), "cauchy": noise.cauchy("cauchy", k, 3.0), "gaussian": noise.gaussian("gaussian", k, 2.0)}
    exact = [noise.discrete_laplace("discrete", k, 5.0).cast("long").alias("discrete"), noise.weighted_choice("choice", k, [1, 2, 1]).cast("int").alias("choice")]
    return spark.range(200).select("id", *[F.round(v.cast("double"), 6).alias(n) for n, v in laws.items()], *exact)


_BAYES = (DISCOUNT, TAX, FLAG)
_CANDIDATES = [(0, ((1, 0),)), (1, ((0, 1), (2, 0))), (2, ((0, 0), (1, 2)))]


def _score_sql(k: int, x: int, parents: tuple[tuple[int, int], ...]) -> str:
    p = "0" + "".join(f" * 100 + (b{i} >> {level})" for i, level in parents)
    p = p.replace("0 * 100 + ", "", 1)
    return f"""SELECT {k}::BIGINT AS query, round(sum(abs(coalesce(j.v, 0) - x.v * p.v)), 8) AS distance, round(sum(CASE WHEN j.v > 0 THEN j.v * log2(j.v / (x.v * p.v)) ELSE 0 END), 8) AS information
      FROM (SELECT b{x} AS x, count(*) / any_value(n) AS v FROM t GROUP BY 1) x CROSS JOIN (SELECT {p} AS p, count(*) / any_value(n) AS v FROM t GROUP BY 1) p
      LEFT JOIN (SELECT b{x} AS x, {p} AS p, count(*) / any_value(n) AS v FROM t GROUP BY 1, 2) j ON j.x = x.x AND j.p = p.p"""


@query("WITH t AS (SELECT *, (count(*) OVER ())::DOUBLE AS n FROM (SELECT " + ", ".join(f"{bin_sql(a)} AS b{i}" for i, a in enumerate(_BAYES)) + " FROM lineitem) WHERE b0 IS NOT NULL AND b1 IS NOT NULL AND b2 IS NOT NULL) " + " UNION ALL ".join(_score_sql(k, *c) for k, c in enumerate(_CANDIDATES)))
def bayes_scores(spark, d):
    """How far attributes depend on candidate parents, some of them at coarser levels."""
    return bayes.scores(lineitem(spark, d, *_BAYES), _CANDIDATES).select("query", F.round("distance", 8).alias("distance"), F.round("information", 8).alias("information"))


@query("WITH t AS (SELECT " + ", ".join(f"{bin_sql(a)} AS b{i}" for i, a in enumerate(_BAYES)) + " FROM lineitem) SELECT CASE k WHEN 0 THEN b2 WHEN 1 THEN 3 + b0 * 3 + b2 ELSE 36 + b1 // 2 * 3 + b2 END AS query, count(*)::DOUBLE AS value FROM t, (SELECT unnest(range(3)) AS k) GROUP BY 1")
def bayes_measurements(spark, d):
    """The marginals that a network names."""
    net = [(2, ()), (0, ((2, 0),)), (2, ((1, 1),))]
    y = bayes.measurements(net, (11, 9, 3)).apply(lineitem(spark, d, *_BAYES).vectorize())
    return y.select("query", F.col("value").cast("double").alias("value")).where("value > 0")


@query("WITH t AS (SELECT *, (count(*) OVER ())::DOUBLE AS n FROM (SELECT " + ", ".join(f"{bin_sql(a)} AS b{i}" for i, a in enumerate(_BAYES)) + " FROM lineitem)), f AS (SELECT b2, sum(count(*)) OVER (ORDER BY b2) / sum(count(*)) OVER () AS upto FROM t GROUP BY 1), c AS (SELECT b2, b1, sum(count(*)) OVER (PARTITION BY b2 ORDER BY b1) / sum(count(*)) OVER (PARTITION BY b2) AS upto FROM t GROUP BY 1, 2), s AS (SELECT i, (SELECT min(b2) FROM f WHERE upto > " + UNIFORM.format(seed="syn/2", key="i") + ") AS b2 FROM (SELECT unnest(range(2000)) AS i)) SELECT i AS id, (SELECT min(b1) FROM c WHERE c.b2 = s.b2 AND upto > " + UNIFORM.format(seed="syn/1", key="i") + ")::INT AS b1, b2::INT AS b2 FROM s")
def bayes_synthesis(spark, d):
    """Rows drawn from a network's tables, here without noise."""
    r = lineitem(spark, d, *_BAYES)
    net = [(2, ()), (1, ((2, 0),)), (0, ())]
    return bayes.synthesize(r, net, bayes.noisy_tables(r, net, None, ""), 2000, "syn").select("id", "b1", "b2")


@query(X + f", y AS (SELECT cell, value AS t, value + {noise_sql('err', 'cell', 2.0)} AS e FROM x) SELECT round(sqrt(avg((t - e) * (t - e))), 6) AS root_mean_square, round(avg(abs(t - e)), 6) AS mean, round(max(abs(t - e)), 6) AS largest FROM y")
def error_summary(spark, d):
    x = balances(spark, d)
    y = inference.errors(x.withColumnRenamed("cell", "query"), measure.laplace(w.Identity(64), x, 0.5, "err"))
    return y.select(*[F.round(c, 6).alias(c) for c in y.columns])


# Plans. Their noise is a hash, so that SQL gives the same answers wherever the estimate has a closed form.


def _plan(name: str, run: Callable[[Protected], np.ndarray], sql: str | None = None) -> None:
    def one(spark: SparkSession, d: str) -> DataFrame:
        table = Relation(spark.read.parquet(f"{d}/customer.parquet"), (BALANCE,))
        estimate = run(Protected.over(table, 1, seed=name).vectorize().keep())
        return w.frame(spark, cell=np.arange(len(estimate)), value=np.round(estimate, 5))

    QUERIES[f"plan_{name}"] = one
    if sql:
        ORACLE_SQL[f"plan_{name}"] = sql


def _plan_of_total(name: str, run: Callable[[Protected, float, str], np.ndarray], sql: str | None = None) -> None:
    """run: of the vector, its noisy total and what the total, at a twentieth, leaves of the budget."""
    _plan(name, lambda x: run(x, algorithms.noisy_total(x, "0.05"), "0.95"), sql)


def nested_sql(seed: str, levels: list[tuple[str, str, int]], eps: float = 1.0, vector: str = X) -> str:
    """Least squares for levels of blocks, each of one size and within those of the level before: (block, query id, size).

    With z the sum of a cell's answers, the part of z that is constant on a level's blocks but not on the level's before is
    stretched by the sizes of this and all finer levels.
    """
    answers = " UNION ALL ".join(f"SELECT {k} AS level, block, v + {noise_sql(seed, query, len(levels) / eps)} AS y FROM (SELECT {block} AS block, min(cell) AS cell, sum(value) AS v FROM x GROUP BY {block})" for k, (block, query, _) in enumerate(levels))
    z = " + ".join(f"(SELECT y FROM a WHERE level = {k} AND block = {block})" for k, (block, _, _) in enumerate(levels))
    means = ", ".join(f"avg(z) OVER (PARTITION BY {block}) AS m{k}" for k, (block, _, _) in enumerate(levels))
    stretch = [sum(size for _, _, size in levels[k:]) for k in range(len(levels))]
    x = " + ".join(f"(m{k}{f' - m{k - 1}' if k else ''}) / {float(s)!r}::DOUBLE" for k, s in enumerate(stretch))
    return f"{vector}, a AS ({answers}), z AS (SELECT cell, {z} AS z FROM x), m AS (SELECT cell, {means} FROM z) SELECT cell, round({x}, 5) AS value FROM m"


def _quad(bits: int) -> str:
    """The block of an 8 x 8 grid's cell in a quad tree, in the order of the tree's boxes."""
    out = "cell * 0"
    for k in range(bits):
        out = f"({out}) * 4 + ((cell // 8) >> {2 - k}) % 2 * 2 + ((cell % 8) >> {2 - k}) % 2"
    return f"({out})"


_HAAR_X = " + ".join(f"CASE WHEN cell % {64 >> k} < {32 >> k} THEN 1 ELSE -1 END * (SELECT y FROM a WHERE query = {1 << k} + cell // {64 >> k}) / {64 >> k}.0::DOUBLE" for k in range(6))
_TOTAL = f"n AS (SELECT greatest(1, sum(value) + {{}}) AS n FROM x)"

_plan("identity", lambda x: algorithms.identity(x, 1), X + f" SELECT cell, round(value + {noise_sql('identity/0', 'cell', 1.0)}, 5) AS value FROM x")
_plan("identity_reduced", lambda x: algorithms.identity(x, 1, w.Prefix(8) @ w.Blocks(64, 8)), X + f", y AS (SELECT cell // 8 AS part, (sum(value) + {noise_sql('identity_reduced/0', 'cell // 8', 1.0)}) / 8.0::DOUBLE AS y FROM x GROUP BY 1) SELECT cell, round(y, 5) AS value FROM x JOIN y ON part = cell // 8")
_plan("uniform", lambda x: algorithms.uniform(x, 1), X + f" SELECT cell, round((sum(value) OVER () + {noise_sql('uniform/0', '0', 1.0)}) / 64.0::DOUBLE, 5) AS value FROM x")
_plan("privelet", lambda x: algorithms.privelet(x, 1), X + f", q AS (SELECT CASE WHEN l = 0 THEN 0 ELSE (1 << (l - 1)) + cell // (64 >> (l - 1)) END AS query, sum(CASE WHEN l = 0 OR cell % (64 >> (l - 1)) < (64 >> l) THEN value ELSE -value END) AS v FROM x, (SELECT unnest(range(7))::INT AS l) GROUP BY 1), a AS (SELECT query, v + {noise_sql('privelet/0', 'query', 7.0)} AS y FROM q) SELECT cell, round((SELECT y FROM a WHERE query = 0) / 64.0::DOUBLE + {_HAAR_X}, 5) AS value FROM x")
_plan("h2", lambda x: algorithms.h2(x, 1), nested_sql("h2/0", [(f"cell // {64 >> k}", f"({k * 64} + cell // {64 >> k} * {64 >> k})", 64 >> k) for k in range(7)]))
_plan("hb", lambda x: algorithms.hb(x, 1), X + f" SELECT cell, round(value + {noise_sql('hb/0', 'cell', 1.0)}, 5) AS value FROM x")
_plan("h2_2d", lambda x: algorithms.h2(x, 1, (8, 8)), nested_sql("h2_2d/0", [(f"((cell // 8 >> {3 - k}) * 8 + (cell % 8 >> {3 - k}))", f"({k * 64} + ((cell // 8 >> {3 - k}) << {3 - k}) * 8 + ((cell % 8 >> {3 - k}) << {3 - k}))", 64 >> 2 * k) for k in range(4)]))
_plan("greedy_h", lambda x: algorithms.greedy_h(x, w.Prefix(64), 1))
_plan("quad_tree", lambda x: algorithms.quad_tree(x, (8, 8), 1), nested_sql("quad_tree/0", [(_quad(k), f"({(4**k - 1) // 3} + {_quad(k)})", 64 >> 2 * k) for k in range(4)]))
_plan_of_total("uniform_grid", lambda x, total, eps: algorithms.uniform_grid(x, (8, 8), total, eps), X + ", " + _TOTAL.format(noise_sql("uniform_grid/0", "0", 20.0)) + ", s AS (SELECT greatest(1, floor(8 / sqrt(n * 0.95::DOUBLE / 10)))::BIGINT AS s FROM n), b AS (SELECT cell, value, (cell // 8) // s * CAST(ceil(8.0::DOUBLE / s) AS BIGINT) + (cell % 8) // s AS block FROM x, s), y AS (SELECT block, (sum(value) + " + noise_sql("uniform_grid/1", "block", 1 / 0.95) + ") / count(*) AS y FROM b GROUP BY 1) SELECT cell, round(y, 5) AS value FROM b JOIN y USING (block)")
_plan_of_total("adaptive_grid", lambda x, total, eps: algorithms.adaptive_grid(x, (8, 8), total, eps), X + f" SELECT cell, round(value + ({noise_sql('adaptive_grid/1', 'cell', 1 / 0.475)} + {noise_sql('adaptive_grid/2', 'cell', 1 / 0.475)}) / 2, 5) AS value FROM x")
_plan("marginals", lambda x: algorithms.marginals(x, (8, 8), 1), X + f", c AS (SELECT cell % 8 AS j, sum(value) + {noise_sql('marginals/0', '(cell % 8)', 2.0)} AS c FROM x GROUP BY 1, cell % 8), r AS (SELECT cell // 8 AS i, sum(value) + {noise_sql('marginals/0', '(8 + cell // 8)', 2.0)} AS r FROM x GROUP BY 1, cell // 8) SELECT i * 8 + j AS cell, round((avg(r) OVER () + avg(c) OVER ()) / 16 + (r - avg(r) OVER ()) / 8 + (c - avg(c) OVER ()) / 8, 5) AS value FROM r, c")
_plan("marginals_smart", lambda x: algorithms.marginals_smart(x, (8, 8), w.Prefix(64), 1))
_plan("ahp", lambda x: algorithms.ahp(x, 1))
_plan("ahp_runs", lambda x: algorithms.ahp(x, 1, clusters=strategy.cluster_runs))
_plan_of_total("ahp_adaptive", lambda x, total, eps: algorithms.ahp_adaptive(x, total, eps))
_plan("dawa", lambda x: algorithms.dawa(x, w.Prefix(64), 1, seed=1))
_plan("dawa_2d", lambda x: algorithms.dawa_2d(x, (8, 8), w.Kronecker([w.Prefix(8), w.Prefix(8)]), 1, seed=1))
_plan("dawa_striped", lambda x: algorithms.dawa_striped(x, (4, 16), 1, w.Prefix(64), 1, seed=1))
_plan("dawa_striped_product", lambda x: algorithms.dawa_striped_product(x, (4, 16), 1, [[w.Identity(4), w.Prefix(16)]], 1, seed=1))
_plan_of_total("mwem", lambda x, total, eps: algorithms.mwem(x, w.Prefix(64), total, eps, 3))
_plan_of_total("mwem_intervals", lambda x, total, eps: algorithms.mwem(x, w.Prefix(64), total, eps, 3, intervals=True))
_plan_of_total("mwem_least_squares", lambda x, total, eps: algorithms.mwem(x, w.Prefix(64), total, eps, 3, least=True))
_plan_of_total("mwem_intervals_least_squares", lambda x, total, eps: algorithms.mwem(x, w.Prefix(64), total, eps, 3, least=True, intervals=True))


@query("WITH " + vector_sql("lineitem", _UNEVEN[560]) + ", b AS (SELECT cell, value, (SELECT max(k) FROM (SELECT unnest(range(24)) AS k) WHERE ceil(560 * k / 24.0::DOUBLE) <= cell) AS block FROM x), y AS (SELECT block, CAST(ceil(560 * block / 24.0::DOUBLE) AS BIGINT) AS query, count(*) AS size, sum(value) AS v FROM b GROUP BY 1), z AS (SELECT block, size, v + " + noise_sql("hb560/0", "query", 2.0) + " AS v FROM y), c AS (SELECT cell, block, value + " + noise_sql("hb560/0", "(560 + cell)", 2.0) + " AS v FROM b), s AS (SELECT block, sum(v) AS held FROM c GROUP BY 1) SELECT cell, round(c.v + (z.v - held) / (size + 1), 5) AS value FROM c JOIN z USING (block) JOIN s USING (block)")
def plan_hb_560(spark, d):
    """On a domain that the branching does not divide: two levels, whose least squares share each block's gap evenly."""
    x = Protected.over(lineitem(spark, d, _UNEVEN[560]), 1, seed="hb560").vectorize()
    estimate = algorithms.hb(x, 1)
    return w.frame(spark, cell=np.arange(560), value=np.round(estimate, 5))


_STRIPES = (FLAG, Attribute("l_extendedprice", 256, 0, 131072))
_STRIPE_LEVELS = [("cell // 16", "(cell // 256 * {k} + cell % 256 // 16 * 16)", 16), ("cell", "(cell // 256 * {k} + 256 + cell % 256)", 1)]


def _striped(sql_seed: str, k: int) -> str:
    return nested_sql(sql_seed, [(block, key.format(k=k), size) for block, key, size in _STRIPE_LEVELS], vector="WITH " + vector_sql("lineitem", *_STRIPES))


@query(_striped("stripes/0", 512))
def plan_striped_hb(spark, d):
    estimate = algorithms.striped_hb(Protected.over(lineitem(spark, d, *_STRIPES), 1, seed="stripes").vectorize(), (3, 256), 1, 1)
    return w.frame(spark, cell=np.arange(len(estimate)), value=np.round(estimate, 5))


@query(_striped("apart/' || (cell // 256) || '", 0))
def plan_striped_hb_apart(spark, d):
    """Stripe by stripe, each with its own noise, charged in parallel."""
    x = Protected.over(lineitem(spark, d, *_STRIPES), 1, seed="apart").vectorize().keep()
    estimate = algorithms.striped_hb_apart(x, (3, 256), 1, 1)
    return w.frame(spark, cell=np.arange(len(estimate)), value=np.round(estimate, 5))


@query()
def plan_bayes_least_squares(spark, d):
    estimate = algorithms.bayes_least_squares(Protected.over(lineitem(spark, d, *_BAYES), 1, seed="bayes"), 1)
    return w.frame(spark, cell=np.arange(len(estimate)), value=np.round(estimate, 5))
