"""Reports that users define: conditions over a closed list of fields, compiled to Columns. Values
are bound as literals and never become part of a statement."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteaudit.plans.catalogue import COLUMNS, PAGE, compile_sql, condition

#: Field: expression over the wide view and whether it is a number.
FIELDS: dict[str, tuple[str, bool]] = {
    "address": ("url", False), "path": ("path", False), "status": ("status", True), "contentType": ("content_type", False), "indexability": ("indexability", False), "title": ("title", False), "titleLength": ("title_length", True), "titlePixels": ("title_pixels", True),
    "description": ("meta_description", False), "descriptionLength": ("meta_description_length", True), "h1": ("h1", False), "h2": ("h2", False), "wordCount": ("word_count", True), "textLength": ("text_length", True), "depth": ("depth", True), "inlinks": ("inlinks", True),
    "size": ("content_length", True), "responseTime": ("response_time_ms", True), "canonical": ("canonical_url", False), "metaRobots": ("meta_robots", False), "lang": ("lang", False), "analytics": ("analytics", False), "ogTitle": ("og_title", False), "inSitemap": ("in_sitemap", True),
    "renderedWords": ("rendered_words", True), "clicks": ("{gsc|Clicks}", True), "sessions": ("{ga4|Sessions}", True),
}
TEXT_ONLY = ("contains", "notContains", "startsWith", "endsWith")
NUMBER_ONLY = ("greaterThan", "lessThan")
ANY = ("equals", "notEquals", "isEmpty", "isNotEmpty")
DEFAULT_COLUMNS = ("address", "status", "indexability", "title", "wordCount")


@dataclass(frozen=True)
class Condition:
    field: str
    comparison: str
    value: str = ""


@dataclass(frozen=True)
class CustomReport:
    id: str
    name: str
    conditions: tuple[Condition, ...] = ()
    columns: tuple[str, ...] = field(default_factory=tuple)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> CustomReport:
        d = json.loads(text)
        return cls(d["id"], d["name"], tuple(Condition(**c) for c in d.get("conditions", ())), tuple(d.get("columns", ())))


def _number(text: str) -> float | None:
    try:
        return float(text.strip())
    except ValueError:
        return None


def compile_condition(c: Condition) -> Column | None:
    """The condition as a Column; None for one that makes no sense. ``%`` and ``_`` in a text are
    wildcards. Numbers compare as numbers, counts too."""
    if c.field not in FIELDS or c.comparison not in (*TEXT_ONLY, *NUMBER_ONLY, *ANY):
        return None
    sql, numeric = FIELDS[c.field]
    e = F.expr(compile_sql(sql))
    text = F.lower(e.cast("string"))
    if c.comparison in ("isEmpty", "isNotEmpty"):
        empty = e.isNull() | (F.trim(e.cast("string")) == "")
        return empty if c.comparison == "isEmpty" else ~empty
    if not c.value.strip() or (numeric and c.comparison in TEXT_ONLY) or (not numeric and c.comparison in NUMBER_ONLY):
        return None
    if c.comparison in ("equals", "notEquals"):
        n = _number(c.value)
        same = (e.cast("double").eqNullSafe(F.lit(n)) if n is not None else F.lit(False)) if numeric else e.eqNullSafe(F.lit(c.value))
        return same if c.comparison == "equals" else ~same
    if c.comparison in NUMBER_ONLY:
        n = _number(c.value)
        if n is None:
            return None
        return e.cast("double") > n if c.comparison == "greaterThan" else e.cast("double") < n
    v = c.value.lower()
    like = text.like({"contains": f"%{v}%", "notContains": f"%{v}%", "startsWith": f"{v}%", "endsWith": f"%{v}"}[c.comparison])
    return ~F.coalesce(like, F.lit(False)) if c.comparison == "notContains" else like


@dataclass(frozen=True)
class Compiled:
    id: str
    name: str
    columns: tuple[str, ...]
    matching: Column

    def select(self, pv: DataFrame, filter_id: str = "matching") -> DataFrame:
        pages = pv.where(condition(PAGE))
        return pages.where(self.matching) if filter_id == "matching" else pages


def compile_report(r: CustomReport) -> Compiled | None:
    """None if no condition is left."""
    parts = [F.coalesce(p, F.lit(False)) for p in map(compile_condition, r.conditions) if p is not None]
    if not parts:
        return None
    columns = tuple(c for c in r.columns if c in COLUMNS) or DEFAULT_COLUMNS
    return Compiled(f"custom_{r.id}", r.name, columns, reduce(lambda a, b: a & b, parts))
