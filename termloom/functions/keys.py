"""The key under which two spellings of a name are the same.

With SPACE, PUNCT and the rest as classes of bytes, a name without leading PUNCT is its leading SPACE run, kept as it
is; its middle up to the last other byte, without SPACE and in ASCII upper case; and what follows, without trailing
PUNCT. ``skeleton`` is weaker: all bytes but SPACE and PUNCT. Equal keys have equal skeletons.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.functions.latin import latin

# The two classes of bytes that the comparison of names treats apart.
SPACE = "\t\n\r -_"
PUNCT = "!\"'(),.:;?[]{}"

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_S = r"\t\n\r _\-"
_P = r"!\"'(),.:;?\[\]{}"


def canonical_key(name: Column) -> Column:
    """``H \\x01 M \\x01 T`` of a name; null for null."""
    s = F.regexp_replace(latin(name), rf"^[{_P}]+", "")
    head = F.regexp_extract(s, rf"^([{_S}]*)", 1)
    rest = F.regexp_replace(s, rf"^[{_S}]+", "")
    middle = F.regexp_replace(F.regexp_extract(rest, rf"(?s)^(.*[^{_P}{_S}])", 1), rf"[{_S}]", "")
    tail = F.regexp_replace(F.regexp_extract(rest, rf"([{_P}{_S}]*)\z", 1), rf"[{_P}]+\z", "")
    return F.concat(head, F.lit("\x01"), F.translate(middle, LOWER, UPPER), F.lit("\x01"), tail)


def skeleton(name: Column) -> Column:
    return F.translate(latin(name), LOWER + SPACE + PUNCT, UPPER)


_FRONT = re.compile(rf"[{_P}]*([{_S}]*)")
_BACK = re.compile(rf"[{_P}{_S}]*\Z")
_TO_UPPER = str.maketrans(LOWER, UPPER, SPACE)


def key_of(name: str) -> str:
    """``canonical_key`` of a Python string that holds a byte per character."""
    front = _FRONT.match(name)
    head, rest = front[1], name[front.end() :]
    back = _BACK.search(rest)
    tail = rest[back.start() :]
    end = re.search(rf"[{_P}]+\Z", tail)
    return f"{head}\x01{rest[: back.start()].translate(_TO_UPPER)}\x01{tail[: end.start()] if end else tail}"
