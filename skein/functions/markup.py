"""Widening of pronoun brackets to whole tokens, a character-level rule that Catalyst has no expression for."""

from __future__ import annotations

import re
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MARK

_MARK = re.compile(MARK)
#: a word keeps the apostrophe it ends in
TOKEN = re.compile(r"\w+['’]?|[^\w\s]|\s+")


def widen_brackets(marked: str, token: re.Pattern[str] = TOKEN) -> str:
    """Every ``[..]`` grows to the tokens it touches, unless a token also touches a ``{..}`` name.

    Supplied ``[+..]`` marks keep their places. Brackets that come to touch become one.
    """
    text, kinds, supplied = "", "", []
    at = 0
    for m in [*_MARK.finditer(marked), None]:
        plain = marked[at : m.start() if m else len(marked)]
        text, kinds = text + plain, kinds + "." * len(plain)
        if m is None:
            break
        at, inner = m.end(), m.group(0)[1:-1]
        if m.group(0).startswith("[+"):
            supplied.append((len(text), m.group(0)))
        else:
            text, kinds = text + inner, kinds + ("[" if m.group(0)[0] == "[" else "{") * len(inner)
    for t in token.finditer(text):
        touched = kinds[t.start() : t.end()]
        if "[" in touched and "{" not in touched:
            kinds = kinds[: t.start()] + "[" * len(touched) + kinds[t.end() :]
    out, close = [], {"[": "]", "{": "}"}
    edges = [0, *[p for p, _ in supplied], len(text)]
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        for kind, run in groupby(range(a, b), kinds.__getitem__):
            chars = "".join(text[k] for k in run)
            out.append(f"{kind}{chars}{close[kind]}" if kind in close else chars)
        if i < len(supplied):
            out.append(supplied[i][1])
    return "".join(out)


def token_brackets(c: Column) -> Column:
    """``widen_brackets`` in Arrow batches; null where a line's brackets do not close."""

    def safe(x: str | None) -> str | None:
        rest = None if x is None else _MARK.sub("", x)
        return None if rest is None or set(rest) & set("[]{}") else widen_brackets(x)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(safe)

    return run(c)
