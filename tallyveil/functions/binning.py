"""Equal-width binning and predicates as column expressions."""

from __future__ import annotations

import ast
import io
import tokenize
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Attribute:
    """A column's domain [low, high] in equal bins, half-open but for the last; or explicit edges; recoded first if mapped."""

    name: str
    bins: int
    low: float = 0.0
    high: float = 1.0
    recode: dict = field(default_factory=dict, hash=False)
    edges: tuple[float, ...] = ()

    def value(self) -> Column:
        if not self.recode:
            return F.col(self.name).cast("double")
        out = F.lit(None).cast("double")
        for k, v in self.recode.items():
            out = F.when(F.col(self.name) == k, F.lit(float(v))).otherwise(out)
        return out

    def bin(self) -> Column:
        """The bin number; null outside the domain, for null and for NaN. Edges are those of lo + k * step in doubles."""
        v = self.value()
        if self.edges:
            inner = F.lit(0)
            for e in self.edges[1:-1]:
                inner = inner + F.when(v >= e, 1).otherwise(0)
            return F.when((v >= self.edges[0]) & (v <= self.edges[-1]) & ~F.isnan(v), inner).cast("int")
        step = (self.high - self.low) / self.bins
        k = F.floor((v - self.low) / step)
        k = F.when(v < k * step + self.low, k - 1).when(v >= (k + 1) * step + self.low, k + 1).otherwise(k)
        return F.when((v >= self.low) & (v <= self.high), F.least(F.greatest(k, F.lit(0)), F.lit(self.bins - 1))).cast("int")


def cell(bins: list[Column], shape: tuple[int, ...]) -> Column:
    """Row-major cell number."""
    out = F.lit(0).cast("long")
    for b, n in zip(bins, shape, strict=True):
        out = out * n + b
    return out


_COMPARE = {ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__", ast.Eq: "__eq__", ast.NotEq: "__ne__"}
_ARITHMETIC = {ast.Add: "__add__", ast.Sub: "__sub__", ast.Mult: "__mul__", ast.Div: "__truediv__", ast.Mod: "__mod__"}


def predicate(text: str) -> Column:
    """A filter from a small expression language: comparisons, and/or/not, in, arithmetic. Nulls and NaN compare false,
    but unequal to everything."""

    def missing(c: Column) -> Column:
        return c.isNull() | F.coalesce(F.isnan(c.try_cast("double")), F.lit(False))

    def walk(e: ast.AST) -> Column:
        match e:
            case ast.Expression():
                return walk(e.body)
            case ast.BoolOp():
                parts = [walk(v) for v in e.values]
                out = parts[0]
                for p in parts[1:]:
                    out = out & p if isinstance(e.op, ast.And) else out | p
                return out
            case ast.UnaryOp(op=ast.Not()):
                return ~walk(e.operand)
            case ast.UnaryOp(op=ast.USub()):
                return -walk(e.operand)
            case ast.Compare():
                left, out = e.left, None
                for op, right in zip(e.ops, e.comparators, strict=True):
                    if isinstance(op, ast.In | ast.NotIn):
                        one = F.coalesce(walk(left).isin([ast.literal_eval(x) for x in right.elts]), F.lit(False))
                        one = ~one if isinstance(op, ast.NotIn) else one
                    else:
                        a, b = walk(left), walk(right)
                        gone = missing(a) | missing(b)
                        one = F.when(gone, isinstance(op, ast.NotEq)).otherwise(getattr(a, _COMPARE[type(op)])(b))
                    out, left = one if out is None else out & one, right
                return out
            case ast.BinOp() if type(e.op) in _ARITHMETIC:
                return getattr(walk(e.left), _ARITHMETIC[type(e.op)])(walk(e.right))
            case ast.Name():
                return F.col(e.id)
            case ast.Constant(value=int() | float() | str() | bool()):
                return F.lit(e.value)
        raise ValueError(f"not allowed in a filter: {ast.dump(e)[:60]}")

    return walk(ast.parse(_worded(text), mode="eval"))


def _worded(text: str) -> str:
    """&, | and ~ as and, or and not, which bind less than comparisons do; what stands in string literals is left alone."""
    words = {"&": "and", "|": "or", "~": "not"}
    tokens = tokenize.generate_tokens(io.StringIO(text.strip()).readline)
    return " ".join(words.get(t.string, t.string) if t.type == tokenize.OP else t.string for t in tokens if t.type not in (tokenize.NEWLINE, tokenize.ENDMARKER)).strip()
