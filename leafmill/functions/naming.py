"""First mentions: introducing a name with its original once, and short forms after."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql.types import DoubleType

from leafmill.functions.markup import by_text

_JOINED = r"[\w‌‍]"


def places(text: str, form: str) -> list[tuple[int, int]]:
    """Where ``form`` stands alone outside code and addresses."""
    hidden = re.sub(r"`[^`]*`|(?:https?://|www\.)\S+", lambda m: "\0" * len(m.group()), text)
    return [m.span() for m in re.finditer(rf"(?<!{_JOINED}){re.escape(form)}(?!{_JOINED})", hidden)]


def introduced(text: str, form: str, first: str) -> str:
    """The first place of ``form`` as ``first``, unless the text has that already."""
    if first in text or not (found := places(text, form)):
        return text
    start, end = found[0]
    return text[:start] + first + text[end:]


def flattened(text: str, first: str, later: str) -> str:
    """Every place of ``first`` as ``later``."""
    out = text
    for start, end in reversed(places(text, first)):
        out = out[:start] + later + out[end:]
    return out


def obligations(text: str, forms: list[str]) -> list[str]:
    """Forms that stand in a text, longest first over the whole text, without overlaps."""
    found, left = [], text
    for form in sorted(set(forms), key=lambda f: (-len(f), f)):
        for start, end in places(left, form):
            found.append((start, form))
            left = left[:start] + "\0" * (end - start) + left[end:]
    return [form for _, form in sorted(found)]


def right_to_left(text: str) -> float:
    """Share of a text's strong characters that run right to left."""
    kinds = [unicodedata.bidirectional(c) for c in text]
    strong = sum(k in ("L", "R", "AL") for k in kinds)
    return sum(k in ("R", "AL") for k in kinds) / strong if strong else 0.0


rtl_share = by_text(right_to_left, DoubleType())
