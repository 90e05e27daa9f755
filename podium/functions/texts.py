"""Sentences about gems, as one table of templates.

A template's `{x}` is a value as it is, `{x%}` a share in whole percent, rounded half up, and `{x:word}` a number with a word
that has an s unless the number is one. The first template of a kind whose condition holds is taken.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (kind, what, holds where this value is 0, or always, text).
GEM_TEXTS = [
    ("underused", "reason", "recent", "{blade} has {win%} win rate with no recent appearances"),
    ("underused", "reason", None, "{blade} has {win%} win rate but only {recent:recent appearance}"),
    ("underused", "insight", None, "Best combo shown above. This blade is undervalued in current meta."),
    ("forgotten", "reason", None, "Won {wins:tournament} in {era} era"),
    ("forgotten", "insight", None, "Former champion with {win%} past win rate - meta may have moved on prematurely"),
    ("rising", "reason", "wins", "New combo showing potential in last 60 days"),
    ("rising", "reason", None, "New combo with {wins:win} in last 60 days"),
    ("rising", "insight", None, "Emerging pick gaining traction - could be next meta contender"),
    ("counter", "reason", "wins", "Non-meta blade placing well in current era"),
    ("counter", "reason", None, "Non-meta blade with {wins:win} in current era"),
    ("counter", "insight", None, "Could exploit weaknesses in popular meta choices"),
]


def whole_percent(share: Column) -> Column:
    return F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%"))


def counted(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def filled(template: str, values: dict[str, Column]) -> Column:
    pieces = []
    for text, name, form in re.findall(r"([^{]*)(?:\{(\w+)(%|:[^}]*)?\})?", template):
        pieces += [F.lit(text)] if text else []
        if name:
            value = values[name]
            pieces.append(whole_percent(value) if form == "%" else counted(value, form[1:]) if form else value.cast("string"))
    return F.concat(*pieces)


def sentence(kind: str, what: str, **values: Column) -> Column:
    """The text of a kind of gem."""
    own = [(zero, text) for k, w, zero, text in GEM_TEXTS if (k, w) == (kind, what)]
    return F.coalesce(*[F.when(values[zero] == 0 if zero else F.lit(True), filled(text, values)) for zero, text in own])
