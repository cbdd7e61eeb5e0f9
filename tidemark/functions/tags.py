"""The tags of reviews: one table of their forms, read as columns and as predicates.

A tag is a column or a name of its own, an underscore and a value. ``FORMS`` says for each what the value may be
and how a review gets the tag; everything else here is derived from it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.itemsets import SPACES
from tidemark.functions.reviews import PLAYTIME_BUCKETS, PLAYTIME_TOP, playtime_bucket
from tidemark.schemas import BOOLEANS, HARDWARE, PILLARS

TREND = "kpi"
_ANY, _FLAG, _NUMBER = ".*", "True|False", "[0-9]+"
#: A hardware value with more underscores has too many spellings for the scan.
MOST_UNDERSCORES = 5
_BUCKETS = [*(name for name, _ in PLAYTIME_BUCKETS), PLAYTIME_TOP]


@dataclass(frozen=True)
class Form:
    """``values`` is a pattern of the value; ``fold`` forms are read in any case of letters."""

    name: str
    column: str
    values: str
    fold: bool


FORMS = [
    Form("playtime", "playtime_at_review", "|".join(_BUCKETS), True),
    Form(TREND, TREND, _ANY, True),
    Form("lang", "language", _ANY, False),
    *[Form(c, c, _ANY, False) for c in HARDWARE],
    *[Form(c, c, _FLAG, False) for c in BOOLEANS],
    *[Form(c, c, _NUMBER, False) for c in PILLARS],
]


def canonical_tag(tag: Column) -> Column:
    """The tag in the form that ``all_tags`` gives it; null for unknown tags."""
    bare, out = F.trim(tag), F.lit(None).cast("string")
    for form in FORMS:
        folds = form.fold or form.values == _ANY
        value = F.regexp_extract(bare, f"(?s)^{'(?i)' if folds else ''}{form.name}_({form.values})$", 1)
        value = F.lower(value) if form.fold else value
        if form.values == _NUMBER:
            value = value.try_cast("int").cast("string")
        fits = bare.rlike(f"(?s)^{'(?i)' if folds else ''}{form.name}_({form.values})$")
        out = F.when(fits, F.concat(F.lit(f"{form.name}_"), value)).otherwise(out)
    return out


def all_tags(trend: Column) -> Column:
    """The sorted tags of a review row by which rules can ask for it."""
    tags = []
    for form in FORMS:
        if form.name == "playtime":
            tags.append(playtime_bucket(F.col(form.column)))
            continue
        value = trend if form.name == TREND else F.col(form.column)
        if form.values == _FLAG:
            value = F.when(value, F.lit("True")).when(~value, F.lit("False"))
        elif form.column in HARDWARE:
            value = F.replace(value, F.lit(" "), F.lit("_"))
        tags.append(F.concat(F.lit(f"{form.name}_"), value.cast("string")))
    return F.sort_array(F.array_except(F.array(*tags), F.array(F.lit(None).cast("string"))))


@dataclass(frozen=True)
class Tag:
    """One known tag of a rule."""

    column: str
    value: str
    values: str

    def predicate(self) -> Column:
        """The tag on the columns of ``reviews``, in a form that the scan can take over."""
        column = F.col(self.column)
        if self.column == "playtime_at_review":
            bounds = [0, *(below for _, below in PLAYTIME_BUCKETS)]
            at = _BUCKETS.index(self.value)
            low = column >= bounds[at] if at else column.isNotNull()
            return low if self.value == PLAYTIME_TOP else low & (column < bounds[at + 1])
        if self.values == _FLAG:
            return column == (self.value == "True")
        if self.values == _NUMBER:
            return column == int(self.value)
        if self.column in HARDWARE:
            # spaces became underscores in the tag, so every spelling is asked for
            if " " in self.value:
                return F.lit(False)
            if self.value.count("_") <= MOST_UNDERSCORES:
                return column.isin(["".join(x) for x in product(*[" _" if c == "_" else c for c in self.value])])
            return F.replace(column, F.lit(" "), F.lit("_")) == self.value
        return column == self.value


def tags_of_text(text: str | None) -> list[str]:
    """The tags of one itemset text, as ``split_items`` and ``canonical_tag`` read a column of them."""
    bare = (text or "").strip(SPACES)
    if bare.startswith("frozenset"):
        inner = re.search(r"\{(.*)\}", bare, re.DOTALL)
        parts = inner.group(1).split(",") if inner else []
    else:
        parts = re.split(r"\s+AND\s+|,\s*", bare, flags=re.ASCII)
    found = []
    for part in parts:
        tag = re.sub(r"""^['"]+|['"]+$""", "", part.strip(SPACES)).strip(" ")
        known = None
        for form in FORMS:
            folds = form.fold or form.values == _ANY
            fits = re.fullmatch(f"{form.name}_({form.values})", tag, re.DOTALL | re.ASCII | (re.IGNORECASE if folds else 0))
            if fits:
                value = fits.group(1).lower() if form.fold else fits.group(1)
                if form.values == _NUMBER:
                    value = str(int(value)) if int(value) < 1 << 31 else None
                known = None if value is None else f"{form.name}_{value}"
        if known is not None:
            found.append(known)
    return found


def known_tags(*sides: str | None) -> list[Tag]:
    """The known tags of a rule's sides, without a job."""
    found = []
    for tag in sorted({tag for side in sides for tag in tags_of_text(side)}):
        form = max((f for f in FORMS if tag.startswith(f.name + "_")), key=lambda f: len(f.name))
        found.append(Tag(form.column, tag[len(form.name) + 1:], form.values))
    return found
