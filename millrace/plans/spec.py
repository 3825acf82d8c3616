"""Recorded preparation steps: fit, replay, undo, JSON.

A step is (kind, columns, params). Every kind registers ``fit(df, columns, **params) -> learned``
(a JSON-able dict) and ``apply(df, learned) -> DataFrame`` (a projection or a bounded join), so a
fitted spec runs unchanged on new tables and on streams.
"""

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

KINDS = {}


def step(kind, fit=None):
    """Register ``apply`` for ``kind``; without ``fit`` the learned state is just the parameters."""

    def plain_fit(df, columns, **params):
        return {"columns": columns, **params}

    def wrap(apply):
        KINDS[kind] = (fit or plain_fit, apply)
        return apply

    return wrap


@dataclass
class Fitted:
    kind: str
    learned: dict

    def transform(self, df: DataFrame) -> DataFrame:
        return KINDS[self.kind][1](df, self.learned)


def fit(kind, df, columns=None, **params) -> Fitted:
    if kind not in KINDS:
        raise ValueError(f"unknown step {kind}")
    return Fitted(kind, KINDS[kind][0](df, columns, **params))


def fit_transform(kind, df, columns=None, **params) -> DataFrame:
    return fit(kind, df, columns, **params).transform(df)


@dataclass
class Recipe:
    """An ordered log of steps. ``undo`` returns the log without its last step."""

    steps: list = field(default_factory=list)

    def add(self, kind, columns=None, **params):
        return Recipe([*self.steps, {"kind": kind, "columns": columns, "params": params}])

    def undo(self):
        return Recipe(self.steps[:-1])

    def fit(self, df: DataFrame):
        fitted = []
        for s in self.steps:
            f = fit(s["kind"], df, s["columns"], **s["params"])
            df = f.transform(df)
            fitted.append(f)
        return FittedRecipe(fitted)

    def apply(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def to_json(self):
        return json.dumps(self.steps)

    @classmethod
    def from_json(cls, text):
        return cls(json.loads(text))


@dataclass
class FittedRecipe:
    steps: list

    def transform(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = s.transform(df)
        return df

    def to_json(self):
        return json.dumps([{"kind": s.kind, "learned": s.learned} for s in self.steps])

    @classmethod
    def from_json(cls, text):
        return cls([Fitted(s["kind"], s["learned"]) for s in json.loads(text)])
