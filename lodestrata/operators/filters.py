"""Faceted filters over the two entities, compiled once for lists, counts, facets, discovery and export."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import jsonval as J
from lodestrata.functions.canonical import BUCKETS
from lodestrata.operators.json_predicates import FilterSet, matches


@dataclass(frozen=True)
class Choice:
    """Values to include or to exclude; exclusion wins where both are given."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    def __bool__(self) -> bool:
        return bool(self.include or self.exclude)


@dataclass(frozen=True)
class PushStatus:
    client_id: str
    platform: str
    status: str  # pushed or not_pushed


@dataclass(frozen=True)
class Dimension:
    """A facet: its filter's name, its column, whether that is an array, and whether empty texts count."""

    name: str
    column: str
    many: bool = False
    skip_empty: bool = False


COMPANY_DIMENSIONS = (
    Dimension("niche", "niche", skip_empty=True), Dimension("source", "source_tokens", many=True), Dimension("industry", "industry_id"),
    Dimension("country", "country_id"), Dimension("email_status", "email_status"), Dimension("phone_type", "phone_type"),
)
PERSON_DIMENSIONS = (Dimension("niche", "niche_tokens", many=True), *COMPANY_DIMENSIONS[1:])


@dataclass(frozen=True)
class Filters:
    """A filter request. search_columns name the columns of the free-text search."""

    search: str | None = None
    job_title: str | None = None
    employee_min: float | None = None
    employee_max: float | None = None
    buckets: tuple[str, ...] = ()
    email: str = "any"
    phone: str = "any"
    created_from: str | None = None
    created_to: str | None = None
    niche: Choice = field(default_factory=Choice)
    source: Choice = field(default_factory=Choice)
    industry: Choice = field(default_factory=Choice)
    country: Choice = field(default_factory=Choice)
    email_status: Choice = field(default_factory=Choice)
    phone_type: Choice = field(default_factory=Choice)
    virtual: FilterSet | None = None
    push: PushStatus | None = None
    null_excludes: bool = False  # True: an exclusion drops nulls too


def include_exclude(c: Column, choice: Choice, many: bool, null_excludes: bool = False) -> Column:
    """Two-valued; an exclusion keeps nulls unless told otherwise."""
    values = choice.exclude or choice.include
    hit = F.coalesce(F.arrays_overlap(c, F.array(*map(F.lit, values))) if many else c.isin(*values), F.lit(False))
    if not choice.exclude:
        return hit
    return ~hit & c.isNotNull() if null_excludes else ~hit


def contains(c: Column, term: str) -> Column:
    """Case-insensitive containment; % in the term is dropped, a backslash stands for itself, _ is any letter."""
    return F.coalesce(c.ilike("%" + term.replace("%", "").replace("\\", "\\\\") + "%"), F.lit(False))


def presence(c: Column, wanted: str) -> Column:
    filled = F.coalesce(c, F.lit("")) != ""
    return {"not_empty": filled, "empty": ~filled}.get(wanted, F.lit(True))


def employees(n: Column, f: Filters) -> Column:
    """A range where either end is given, else size classes; unknown counts never match."""
    if f.employee_min is not None or f.employee_max is not None:
        low = n >= f.employee_min if f.employee_min is not None else F.lit(True)
        high = n <= f.employee_max if f.employee_max is not None else F.lit(True)
        return F.coalesce(low & high & n.isNotNull(), F.lit(False))
    ranges = [((n >= lo) if hi is None else n.between(lo, hi)) for label, lo, hi in BUCKETS if label in f.buckets]
    return F.coalesce(reduce(lambda a, b: a | b, ranges, F.lit(False)), F.lit(False)) if f.buckets else F.lit(True)


def base(f: Filters, search_columns: tuple[str, ...]) -> Column:
    """Everything but the facets' own filters and the push status."""
    parts = [employees(F.col("employee_count"), f), presence(F.col("email"), f.email), presence(F.col("phone"), f.phone)]
    if f.search and f.search.strip():
        parts.append(reduce(lambda a, b: a | b, [contains(F.col(c), f.search) for c in search_columns]))
    if f.job_title:
        terms = [t.strip() for t in f.job_title.split(",") if t.strip()]
        parts.append(reduce(lambda a, b: a | b, [contains(F.col("job_title"), t) for t in terms], F.lit(False)) if terms else F.lit(True))
    if f.created_from:
        parts.append(F.col("created_at") >= F.lit(f.created_from).cast("timestamp_ntz"))
    if f.created_to:
        parts.append(F.col("created_at") < F.lit(f.created_to).cast("timestamp_ntz"))
    if f.virtual:
        parts.append(matches(F.col("_data"), f.virtual))
    return reduce(lambda a, b: a & b, parts)


def dimension_passes(f: Filters, dims: tuple[Dimension, ...]) -> dict[str, Column]:
    """The two-valued predicate of every dimension with a filter."""
    out = {}
    for d in dims:
        choice = getattr(f, d.name)
        if choice:
            out[d.name] = include_exclude(F.col(d.column), choice, d.many, f.null_excludes)
    return out


def with_data(df: DataFrame, f: Filters) -> DataFrame:
    """The attributes parsed once, where a virtual filter needs them."""
    return df.withColumn("_data", J.parsed(F.col("custom_data"))) if f.virtual else df


def apply(df: DataFrame, f: Filters, dims: tuple[Dimension, ...], search_columns: tuple[str, ...]) -> DataFrame:
    """The rows that meet every filter (push status apart, see push_status)."""
    out = with_data(df, f).where(base(f, search_columns))
    for p in dimension_passes(f, dims).values():
        out = out.where(p)
    return out.drop("_data")


def companies(df: DataFrame, f: Filters) -> DataFrame:
    return apply(df, f, COMPANY_DIMENSIONS, ("company_name", "domain"))


def people(df: DataFrame, f: Filters) -> DataFrame:
    return apply(df, f, PERSON_DIMENSIONS, ("full_name", "email"))


def from_params(params: dict[str, list[str]]) -> Filters:
    """A request from URL parameters: unknown names and unreadable numbers are dropped, repeated ones add up."""

    def number(name: str) -> float | None:
        try:
            x = float((params.get(name) or [""])[0])
        except ValueError:
            return None
        return x if x == x and abs(x) != float("inf") else None

    kw: dict = {"search": (params.get("search") or [None])[0], "job_title": (params.get("title") or [None])[0], "employee_min": number("empmin"), "employee_max": number("empmax")}
    kw["buckets"] = tuple(b for b in params.get("bucket", []) if b in {x[0] for x in BUCKETS})
    for p in ("email", "phone"):
        v = (params.get(p) or ["any"])[0]
        kw[p] = v if v in ("any", "not_empty", "empty") else "any"
    for f in fields(Filters):
        if isinstance(f.default_factory, type) and f.default_factory is Choice:
            kw[f.name] = Choice(tuple(params.get(f.name, [])), tuple(params.get("not_" + f.name, [])))
    return Filters(**kw)
