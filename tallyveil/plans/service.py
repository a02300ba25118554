"""The kernel behind a line of text: requests and answers are JSON, and clients hold ids of nodes, never data.

A request is {"node": id, "op": name, ...arguments}. Transformations answer {"node": id}, a split {"nodes": [ids]},
measurements {"value": ...}; whatever fails answers {"error": kind, "message": text} and charges nothing.
Matrices travel as {"matrix": name, ...fields}; only the names below are known, so a request cannot name code.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import uuid
from collections.abc import Callable

import numpy as np

from tallyveil.operators import strategy
from tallyveil.operators import workload as w
from tallyveil.plans import algorithms
from tallyveil.plans.kernel import BudgetExceeded, Protected, exact

MATRICES: dict[str, type[w.Matrix]] = {c.__name__: c for c in (w.Dense, w.Identity, w.Ones, w.Prefix, w.Suffix, w.WidthK, w.Ranges, w.Haar, w.Blocks, w.Scaled, w.Sparse, w.Hierarchy, w.Weighted, w.Transposed, w.Product, w.Sum, w.Beside, w.Kronecker, w.Union, w.Gram, w.NormK)}


def encode(value: object) -> object:
    if isinstance(value, w.Matrix):
        return {"matrix": type(value).__name__} | {f.name: encode(getattr(value, f.name)) for f in dataclasses.fields(value)}
    if isinstance(value, np.ndarray | np.generic):
        return value.tolist()
    if isinstance(value, list | tuple):
        return [encode(v) for v in value]
    return value


def encode_all(fields: dict[str, object]) -> dict[str, object]:
    return {k: encode(v) for k, v in fields.items()}


def decode(value: object) -> object:
    if isinstance(value, list):
        return [decode(v) for v in value]
    if not isinstance(value, dict) or "matrix" not in value:
        return value
    kind = MATRICES.get(value["matrix"])
    if kind is None:
        raise ValueError(f"no matrix {value['matrix']!r}")
    arrays = {"a", "d", "q", "c", "w", "g"} if kind in (w.Dense, w.Scaled, w.Sparse, w.Gram) else set()
    known = {f.name: decode(value[f.name]) for f in dataclasses.fields(kind)}
    if kind is w.Union:
        known["parts"] = [(m, c) for m, c in known["parts"]]
    return kind(**{k: np.array(v) if k in arrays else tuple(v) if k == "shape" else v for k, v in known.items()})


def fingerprint(spec: object) -> str:
    """The same for equal plans or matrices, whatever the order of their fields."""
    return hashlib.sha1(json.dumps(encode(spec), sort_keys=True).encode()).hexdigest()


class Service:
    """Owns the protected data. root: the id of the whole relation."""

    def __init__(self, data: Protected):
        self.root = uuid.uuid4().hex[:8]
        self._nodes = {self.root: data}
        self._ops: dict[str, Callable[..., object]] = {
            "where": lambda x, text: x.where(text),
            "project": lambda x, names: x.project(*names),
            "vectorize": lambda x, weight=None, reduced=None, bounds=None: x.vectorize(weight, reduced and tuple(reduced), bounds and tuple(bounds)),
            "reshape": lambda x, shape: x.reshape(tuple(shape)),
            "group": lambda x, cells: x.group(cells),
            "reduce_by_partition": lambda x, part: x.reduce_by_partition(np.array(part)),
            "split_by_partition": lambda x, part: x.split_by_partition(np.array(part)),
            "laplace": lambda x, matrix, eps: x.laplace(matrix, eps),
            "worst_approximated": lambda x, matrix, estimate, measured, eps, mechanism="exponential": x.worst_approximated(matrix, np.array(estimate), measured, eps, mechanism),
            "ahp_partition": self._ahp,
            "dawa_partition": lambda x, eps, ratio="0.25": x.mapping(exact(eps) * exact(ratio), lambda v: strategy.interval_partition(v, float(exact(eps)), float(exact(ratio)))),
            "plan": lambda x, name, eps, **options: getattr(algorithms, self._plan(name))(x, eps=eps, **options),
        }

    @staticmethod
    def _ahp(x: Protected, eps, ratio: str = "0.35", eta: float = 0.35) -> np.ndarray:
        first = exact(eps) * exact(ratio)
        noisy = x.laplace(w.Identity(x.n), first)
        return strategy.cluster_sorted(np.where(noisy <= eta * np.log(x.n) / float(first), 0, noisy), float(first))

    @staticmethod
    def _plan(name: str) -> str:
        if name not in {"identity", "uniform", "privelet", "h2", "hb", "greedy_h", "quad_tree", "uniform_grid", "adaptive_grid", "marginals", "marginals_smart", "striped_hb", "ahp", "dawa", "dawa_2d", "dawa_striped", "mwem"}:
            raise ValueError(f"no plan {name!r}")
        return name

    def answer(self, request: str) -> str:
        try:
            told = json.loads(request)
            node, op = self._nodes[told.pop("node")], self._ops[told.pop("op")]
            out = op(node, **{k: decode(v) for k, v in told.items()})
        except BudgetExceeded as e:
            return json.dumps({"error": "budget", "message": str(e)})
        except (KeyError, TypeError, ValueError) as e:
            return json.dumps({"error": type(e).__name__, "message": str(e)})
        if isinstance(out, list):
            return json.dumps({"nodes": [self._add(x) for x in out]})
        if isinstance(out, Protected):
            return json.dumps({"node": self._add(out), "cells": out.n})
        return json.dumps({"value": encode(out)})

    def _add(self, x: Protected) -> str:
        own = uuid.uuid4().hex[:8]
        self._nodes[own] = x
        return own
