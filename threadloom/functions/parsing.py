"""Grammars that regular expressions cannot balance, as pandas functions; all else stays in ``text``."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_blobs_of(text: str | None) -> list[str]:
    """Outermost ``{...}`` parts that parse; broken ones are left out. Braces count inside strings too."""
    out, depth, start = [], 0, -1
    for m in re.finditer(r"[{}]", text or ""):
        if m[0] == "{":
            start = m.start() if depth == 0 else start
            depth += 1
        else:
            depth -= 1
            if depth == 0 and start >= 0:
                try:
                    out.append(json.dumps(json.loads(text[start : m.end()]), ensure_ascii=False, sort_keys=True))
                except ValueError:
                    pass
                start = -1
    return out


def first_json_of(text: str | None) -> str | None:
    """The first JSON object in a model's output, strings and escapes respected; None without one."""
    decoder, at = json.JSONDecoder(), 0
    while (at := (text or "").find("{", at)) >= 0:
        try:
            return json.dumps(decoder.raw_decode(text, at)[0], ensure_ascii=False, sort_keys=True)
        except ValueError:
            at += 1
    return None


def entries_of(text: str | None) -> list[dict[str, str]]:
    """``### ENTRY`` notes of ``key: value`` lines; a line without a key goes on with the value before it."""
    out = []
    for block in re.split(r"(?m)^###\s*ENTRY\b.*$", text or "")[1:]:
        entry, last = {}, None
        for line in block.splitlines():
            m = re.match(r"\s*([A-Za-z_]+)\s*:\s*(.*)$", line)
            if m:
                last = m[1].lower()
                entry[last] = m[2].strip()
            elif last and line.strip():
                entry[last] = f"{entry[last]}\n{line.strip()}"
        if entry:
            out.append(entry)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_blobs(texts: pd.Series) -> pd.Series:
    return texts.map(json_blobs_of)


@F.pandas_udf(T.StringType())
def first_json(texts: pd.Series) -> pd.Series:
    return texts.map(first_json_of)


@F.pandas_udf(T.ArrayType(T.MapType(T.StringType(), T.StringType())))
def entries(texts: pd.Series) -> pd.Series:
    return texts.map(entries_of)
