"""Canonical JSON (RFC 8785) and checks of JSON text."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def number_text(x: float | int) -> str:
    """A number as ECMAScript writes it."""
    if isinstance(x, int) and not isinstance(x, bool) and abs(x) < 1 << 53:
        return str(x)
    x = float(x)
    if not math.isfinite(x):
        raise ValueError("not a finite number")
    if x == 0:
        return "0"
    digits, _, power = repr(abs(x)).partition("e") if "e" in repr(abs(x)) else (repr(abs(x)), "", "")
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(power or 0)
    figures = (whole + part).lstrip("0")
    point -= len(whole + part) - len((whole + part).lstrip("0"))
    figures = figures.rstrip("0")
    sign = "-" if x < 0 else ""
    if len(figures) <= point <= 21:
        return sign + figures + "0" * (point - len(figures))
    if 0 < point <= 21:
        return f"{sign}{figures[:point]}.{figures[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{figures}"
    body = figures[0] + ("." + figures[1:] if len(figures) > 1 else "")
    return f"{sign}{body}e{'+' if point > 0 else '-'}{abs(point - 1)}"


def canonical_text(value) -> str:
    """The canonical text of a JSON value; keys go by UTF-16 units."""
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, (int, float)):
        return number_text(value)
    if isinstance(value, str):
        value.encode()  # lone surrogates have no canonical form
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_text, value)) + "]"
    return "{" + ",".join(f"{canonical_text(k)}:{canonical_text(v)}" for k, v in sorted(value.items(), key=lambda kv: kv[0].encode("utf-16-be"))) + "}"


def _unique(pairs):
    found = dict(pairs)
    if len(found) != len(pairs):
        raise ValueError("a key stands twice")
    return found


def _refuse(name: str):
    raise ValueError(f"{name} is not JSON")


class _Rare(Exception):
    """A number that json writes otherwise than ECMAScript."""


def _whole(digits: str) -> int:
    if len(digits) > 15:
        raise _Rare
    return int(digits)


def _broken(digits: str) -> int | float:
    x = float(digits)
    told = repr(x)
    if "e" in told or "n" in told or abs(x) >= 1 << 53:
        raise _Rare
    return int(x) if told[-2:] == ".0" else x


class _Json:
    """json's reader and writer, made where they are used: they can't be sent to tasks."""

    made = None

    def __reduce__(self):
        return _Json, ()

    def again(self, text: str) -> str:
        if self.made is None:
            reader = json.JSONDecoder(object_pairs_hook=_unique, parse_constant=_refuse, parse_int=_whole, parse_float=_broken)
            self.made = reader.decode, json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode
        read, write = self.made
        return write(read(text))


_json = _Json()


def canonical_or_none(text: str | None) -> str | None:
    try:
        # json's own writer, where it writes the canonical text
        if text is not None and text.isascii() and "\\u" not in text and text.count("[") + text.count("{") <= 200:
            return _json.again(text)
    except _Rare:
        pass
    except ValueError:
        return None
    try:
        return None if text is None else canonical_text(json.loads(text, object_pairs_hook=_unique, parse_constant=_refuse))
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Canonical text; null for what isn't JSON, has a key twice or a number out of range. Texts that
    stand several times in a batch are parsed once."""
    told = {t: canonical_or_none(t) for t in text.unique()}
    return text.map(told.get)
