"""Quality rules: base statistics of each text and a decision list learned by sequential covering.

Rules are conjunctions of thresholds on ratios of the statistics. Each is grown on two thirds of a labelled sample by
information gain, pruned on the other third by dropping final conditions, and kept only while it is precise enough on
both; rows that it covers leave the sample and the next rule is grown. The list becomes one ordered CASE expression.

The classifier is fitted on at most SAMPLE labelled documents (the smallest hashes of their ids); statistics and verdicts
cover every document. Text pass by Arrow batches.

Defined cases: a null text has no words and fails the base rules; a document with several labels counts as its lowest one;
without labels of both kinds the list is empty and the base rules alone decide; equal rows get equal verdicts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyveil.llm.shared import documents, private_name

#: Labelled documents that the list is fitted on, at most.
SAMPLE = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_RULES, MAX_CONDITIONS, THRESHOLDS = 12, 4, 48
MIN_PRECISION, MIN_COVER = 0.97, 3

#: Fixed values of the contract.
_SYMBOLS, _SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
_UPPER, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_distinct", "n_upper", "n_letters", "n_marks"]


def repeated_words(codes: np.ndarray, n_distinct: int) -> int:
    """Words in 3-word windows that occur twice or more. codes: each word's number below n_distinct."""
    n = len(codes)
    if n < 4:
        return 0
    pairs = codes[:-2] * n_distinct + codes[1:-1]
    if n_distinct > 1 << 20:  # three factors no longer fit in 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs * n_distinct + codes[2:]
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    found = np.isin(windows, twice)
    marked = np.zeros(n, bool)
    for k in range(3):
        marked[k : n - 2 + k] |= found
    return int(marked.sum())


def text_stats(text: str) -> tuple[int, ...]:
    """The values of STATS. bytes.split() parts words at exactly the contract's white space."""
    raw = text.encode()
    words = raw.split()
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    lines = text.split("\n")
    seen: set[str] = set()
    dups = 0
    for line in lines:
        if line in seen:
            dups += bool(line.strip(" \t\x0b\x0c\r"))
        else:
            seen.add(line)
    size = len(raw)
    without = lambda chars: size - len(raw.translate(None, chars))
    return (
        len(words), len(text) - without(_SPACES), without(_SYMBOLS), dups, repeated_words(codes, len(numbers)),
        len(text), len(lines), len(numbers), without(_UPPER), without(_LETTERS), without(b"!?;"),
    )


def with_stats(docs: DataFrame, prefix: str = "") -> DataFrame:
    """docs with the statistics of `text` as long columns, named prefix + name; all columns of docs pass through."""
    clash = {prefix + s for s in STATS} & set(docs.columns)
    if clash:
        raise ValueError(f"docs already has {sorted(clash)}; choose a prefix")
    at = docs.columns.index("text")
    names = [prefix + s for s in STATS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([text_stats(t.as_py() or "") for t in batch.column(at)], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], [*batch.schema.names, *names])

    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{ddl}, {', '.join(f'`{n}` long' for n in names)}")


def features(c: dict[str, object], least=np.maximum) -> dict[str, object]:
    """Ratios of the statistics, for NumPy arrays or, with F.greatest, Spark columns."""
    words, chars = least(c["n_words"], 1), least(c["n_chars"], 1)
    return {
        "words": c["n_words"] * 1.0, "word_length": c["word_chars"] / words, "symbols": c["n_symbols"] / chars, "dup_lines": c["n_dup_lines"] / least(c["n_lines"], 1),
        "repeats": c["n_repeat_words"] / words, "distinct": c["n_distinct"] / words, "upper": c["n_upper"] / least(c["n_letters"], 1), "marks": c["n_marks"] / words,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.cut if self.above else x[self.feature] <= self.cut

    def column(self, x: dict[str, Column]) -> Column:
        return x[self.feature] > F.lit(self.cut) if self.above else x[self.feature] <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.covers(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Rule:
    """Adds the condition of largest gain until no clean row is covered."""
    rule: list[Condition] = []
    inside = rows.copy()
    while len(rule) < MAX_CONDITIONS and (inside & ~bad).any():
        p, n = (inside & bad).sum(), inside.sum()
        if not p:
            break
        best, gain = None, 1e-9
        for name, v in x.items():
            cuts = np.unique(np.quantile(v[inside], np.linspace(0.01, 0.99, THRESHOLDS)))
            for above in (True, False):
                hit = (v[inside][:, None] > cuts) if above else (v[inside][:, None] <= cuts)
                p1, n1 = (hit & bad[inside][:, None]).sum(0), hit.sum(0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p1 > 0, p1 * (np.log2(p1 / n1) - np.log2(p / n)), -1.0)
                k = int(g.argmax())
                if g[k] > gain:
                    best, gain = Condition(name, above, float(cuts[k])), float(g[k])
        if best is None:
            break
        # the widest margin: halfway between the covered values and the clean ones that are left out
        v, hit = x[best.feature], best.covers(x)
        inner, outer = v[inside & hit], v[inside & ~hit & ~bad]
        if len(outer):
            best = Condition(best.feature, best.above, float(inner.min() + outer.max() if best.above else inner.max() + outer.min()) / 2)
        rule.append(best)
        inside &= best.covers(x)
    return tuple(rule)


def learn(stats: np.ndarray, quality: np.ndarray) -> list[Rule]:
    """The decision list of rejections, from the rows that the base rules leave. stats: rows of STATS; quality: 0 to reject."""
    col = dict(zip(STATS, stats.T, strict=True))
    judged = (col["n_words"] >= MIN_WORDS) & (100 * col["n_repeat_words"] <= MAX_REPEAT_PERCENT * col["n_words"])
    stats, bad = stats[judged], (quality == 0)[judged]
    n = len(bad)
    if not n or bad.all() or not bad.any():
        return []
    x = {k: np.asarray(v, float) for k, v in features(dict(zip(STATS, stats.T.astype(float), strict=True))).items()}
    # every third row of each kind is for pruning
    prune = np.zeros(n, bool)
    for kind in (bad, ~bad):
        prune[np.flatnonzero(kind)[2::3]] = True
    left, open_, rules = np.ones(n, bool), ~prune, []
    for _ in range(2 * MAX_RULES):
        if len(rules) == MAX_RULES or not (left & open_ & bad).any():
            break
        grown = rule = _grow(x, bad, left & open_)

        def worth(r: Rule) -> float:
            hit = _covered(r, x, n) & left & prune
            return (int((hit & bad).sum()) - int((hit & ~bad).sum())) / max(1, int(hit.sum()))

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        for r in dict.fromkeys((rule, grown)):
            hit = _covered(r, x, n) & left
            p = int((hit & bad).sum())
            if r and p >= MIN_COVER and p >= MIN_PRECISION * hit.sum():
                rules.append(r)
                left &= ~hit
                break
        else:
            # not good enough: no later rule is grown from the rows that led here
            open_ &= ~(_covered(grown, x, n) & bad) if grown else False
    return rules


def rejects(rules: list[Rule], prefix: str = "") -> Column:
    """The list as one CASE: the first rule that holds rejects; else false."""
    x = features({s: F.col(f"`{prefix}{s}`") for s in STATS}, lambda a, b: F.greatest(a, F.lit(b)))
    out = None
    for rule in rules:
        cond = rule[0].column(x)
        for c in rule[1:]:
            cond = cond & c.column(x)
        out = F.when(cond, True) if out is None else out.when(cond, True)
    return F.lit(False) if out is None else out.otherwise(False)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Learns the list from labels (doc_id, quality) of docs, on at most `sample` documents."""
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("label_id"), "quality")
    text = docs.select("doc_id", "text")
    told = with_stats(text.join(F.broadcast(chosen), text["doc_id"] == chosen["label_id"]).select("doc_id", "quality", "text"))
    rows = told.drop("text").orderBy(F.xxhash64("doc_id"), "doc_id", *STATS).limit(sample).collect()
    return learn(np.array([[r[s] for s in STATS] for r in rows], np.int64).reshape(-1, len(STATS)), np.array([r["quality"] for r in rows]))


def base_failed(prefix: str = "") -> Column:
    c = lambda s: F.col(f"`{prefix}{s}`")
    return (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of docs that neither the base rules nor the list reject, with the columns of docs."""
    prefix = private_name(docs, "quality") + "_"
    judged = with_stats(docs, prefix).where(~base_failed(prefix) & ~rejects(rules, prefix))
    return judged.select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    base = base_failed()
    return with_stats(docs).select("doc_id", *STATS[:5], base.alias("base_failed"), (~base & ~rejects(rules)).alias("kept"))
