"""Named measures over a star schema, evaluated by any dimension columns and under filters.

A measure is additive, or it counts something once however often it shows up in the fact (customers,
reviews). The second kind is reduced to its *first appearance* per group and period, after which it is
additive as well; that keeps period-to-date values linear in the data (see ``time_intelligence``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.functions.columns import date_key, divide_or_null, hour_boundaries
from martlet.operators.relations import Relation, bridges, matching, owners, visible_from


@dataclass(frozen=True)
class Measure:
    """``source`` is fact, reviews or forecast. ``kind`` is sum, count, average or distinct."""

    name: str
    source: str
    kind: str
    column: str | None = None
    blank_is_zero: bool = False


MEASURES: dict[str, Measure] = {
    m.name: m
    for m in (
        Measure("total_sales", "fact", "sum", "price"),
        Measure("total_orders", "fact", "count"),
        Measure("average_review", "reviews", "average", "review_score"),
        Measure("total_reviews", "reviews", "count"),
        Measure("total_active_customers", "fact", "distinct", "customer_id"),
        Measure("average_delivery_time", "fact", "average", "time_to_delivery_hours"),
        Measure("total_sales_forecast", "forecast", "sum", "predicted_sales"),
        Measure("average_defect_ratio", "reviews", "average", "defect_score"),
        Measure("total_sales_missing_dates", "fact", "sum", "price", blank_is_zero=True),
    )
}


@dataclass(frozen=True)
class StarModel:
    """Fact at item grain, dimensions as ``{name: (table, fact key, dimension key)}``, reviews that hang on
    ``order_id`` many-to-many, and an optional forecast that is only related to the calendar.

    ``date_roles`` names the fact timestamps a calendar can be attached to; the first one is the default. ``relations``
    are further many-to-many tables (see ``relations``), whose columns group and filter like those of a dimension; the
    reviews are one of them.
    """

    fact: DataFrame
    dimensions: Mapping[str, tuple[DataFrame, str, str]]
    reviews: DataFrame | None = None
    forecast: DataFrame | None = None
    date_roles: Sequence[str] = ("order_approved_at", "order_purchase_timestamp")
    calendar: DataFrame | None = None
    hierarchies: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: {"product": ("product_segment", "category")}
    )
    relations: Mapping[str, Relation] = field(default_factory=dict)

    def all_relations(self) -> dict[str, Relation]:
        own = {} if self.reviews is None else {"reviews": Relation(self.reviews, "order_id")}
        return {**own, **self.relations}

    def outside(self, columns: Sequence[str]) -> list[str]:
        """Those of ``columns`` that neither the fact, a dimension nor the calendar has."""
        near = {"date", *self.fact.columns}.union(*(t.columns for t, _, _ in self.dimensions.values()))
        near |= set() if self.calendar is None else set(self.calendar.columns)
        return [c for c in dict.fromkeys(columns) if c not in near]

    def with_facts(self, fact: DataFrame) -> StarModel:
        return replace(self, fact=fact)


def with_calculated_columns(fact: DataFrame, approved: str, delivered: str, purchased: str) -> DataFrame:
    """Add the calendar key of the approval and the delivery time in crossed hours."""
    return fact.withColumns(
        {"date_key": date_key(approved), "time_to_delivery_hours": hour_boundaries(purchased, delivered)}
    )


def visible_fact(
    model: StarModel,
    columns: Sequence[str],
    filters: Mapping[str, Sequence[Any] | Column] | None = None,
    date_role: str | None = None,
) -> DataFrame:
    """Fact rows under the filters, with the wanted dimension columns looked up.

    Only dimensions that supply a wanted or filtered column are joined. A ``date`` column is the day of
    the chosen role; calendar columns come from the calendar through that day. With columns of many-to-many
    relations a fact row appears once in each group that it is related to, and not at all without one.
    """
    filters = dict(filters or {})
    far = model.outside([*columns, *filters])
    met = bridges(model.all_relations(), model.dimensions, [c for c in far if c in columns], {c: filters.pop(c) for c in far if c in filters})
    needed = {*(c for c in columns if c not in far), *filters}
    role = date_role or model.date_roles[0]
    rows = model.fact.withColumn("date", F.to_date(F.col(role)))
    for name, (table, fact_key, dim_key) in model.dimensions.items():
        supplied = [c for c in table.columns if c in needed and c not in rows.columns]
        if supplied:
            keyed = table.select(F.col(dim_key).alias(fact_key), *supplied)
            rows = rows.join(keyed, fact_key, "left")
    if model.calendar is not None:
        supplied = [c for c in model.calendar.columns if c in needed and c not in rows.columns]
        if supplied:
            rows = rows.join(model.calendar.select("date", *supplied), "date", "left")
    rows = matching(rows, filters)
    for bridge in met:
        rows = bridge.onto(rows)
    return rows


def _single_dimension(model: StarModel, chosen: list[Measure], by: list[str], filters: Mapping) -> str | None:
    """Name of the only dimension needed, when the fact can be aggregated by its key before the lookup."""
    outside = {*by, *filters} - set(model.fact.columns)
    for name, (table, fact_key, _) in model.dimensions.items():
        if outside and outside <= set(table.columns):
            summable = all(m.kind != "distinct" or m.column == fact_key for m in chosen)
            return name if summable else None
    return None


def _evaluate_by_key(
    model: StarModel, chosen: list[Measure], by: list[str], filters: Mapping, dimension: str
) -> DataFrame:
    """Fact measures by one dimension: sums per key first, then the lookup, then sums per group.

    The lookup sees one row per key instead of all items, so a key that holds a large share of the fact costs
    no more than any other, and the shuffle for the first sums is the one the lookup would need anyway.
    """
    table, fact_key, dim_key = model.dimensions[dimension]
    of_fact = {c: f for c, f in filters.items() if c in model.fact.columns}
    rows = visible_fact(model, [], of_fact)
    plain = [c for c in by if c in model.fact.columns]
    keys = list(dict.fromkeys([fact_key, *plain]))
    parts = [p for m in chosen if m.kind != "distinct" for p in _order_parts(m)] or [F.count(F.lit(1)).alias("_items")]
    per_key = rows.groupBy(*keys).agg(*parts)
    supplied = [c for c in table.columns if c in {*by, *filters} and c not in keys]
    joined = per_key.join(table.select(F.col(dim_key).alias(fact_key), *supplied), fact_key, "left")
    for name, wanted in filters.items():
        if name not in of_fact:
            joined = matching(joined, {name: wanted})
    finals = [(F.countDistinct(fact_key) if m.kind == "distinct" else _from_parts(m)).alias(m.name) for m in chosen]
    return joined.groupBy(*by).agg(*finals)


def reviews_per_order(reviews: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Reviews folded to one row per order (and group of their own), so that a much-reviewed order joins as one row."""
    return reviews.groupBy("order_id", *by).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum("review_score").alias("_score_sum"),
        F.count("review_score").alias("_score_count"),
        F.sum("defect_score").alias("_defect_sum"),
        F.count("defect_score").alias("_defect_count"),
    )


_REVIEW_PARTS = {
    "review_score": ("_score_sum", "_score_count"),
    "defect_score": ("_defect_sum", "_defect_count"),
}


def _reviewed(model: StarModel, reviews: DataFrame) -> StarModel:
    """The model with the fact rows of reviewed orders only, for measures that no other order has a part in."""
    return replace(model, fact=model.fact.join(reviews.select("order_id"), "order_id", "left_semi"))


def _fact_aggregate(m: Measure) -> Column:
    if m.kind == "count":
        return F.count(F.lit(1))
    return {"sum": F.sum, "average": F.avg, "distinct": F.countDistinct}[m.kind](m.column)


def _order_parts(m: Measure) -> list[Column]:
    """Sum and count of an additive fact measure per group and order."""
    value = F.lit(1) if m.kind == "count" else F.col(m.column)
    return [F.sum(value).alias(f"_sum_{m.name}"), F.count(value).alias(f"_count_{m.name}")]


def _from_parts(m: Measure) -> Column:
    """Measure of a group from the parts of its orders."""
    if m.source == "fact":
        total, count = f"_sum_{m.name}", f"_count_{m.name}"
    elif m.kind == "count":
        total, count = "_rows", "_rows"
    else:
        total, count = _REVIEW_PARTS[m.column]
    return divide_or_null(F.sum(total), F.sum(count)) if m.kind == "average" else F.sum(total)


def _outer(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Full join where null group labels match each other."""
    if not by:
        return left.join(right, F.lit(True))  # one row on each side
    tagged = right.withColumnsRenamed({c: f"_r_{c}" for c in by})
    condition = None
    for c in by:
        test = left[c].eqNullSafe(tagged[f"_r_{c}"])
        condition = test if condition is None else condition & test
    joined = left.join(tagged, condition, "full")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_r_{c}")) for c in by}).drop(
        *[f"_r_{c}" for c in by]
    )


def split_by_reviews(model: StarModel, by: Sequence[str], filters: Mapping[str, Any]) -> tuple[list[str], dict, DataFrame]:
    """(other group columns, other filters, reviews per order and own group) for measures of the reviews.

    A group or filter on the reviews' own columns holds for each review, not for all reviews of an order that has such a
    one, so it is applied before the reviews are folded.
    """
    owner = owners(model.all_relations(), model.outside([*by, *filters]))
    own = {c for c, name in owner.items() if name == "reviews"}
    rows = matching(model.reviews, {c: f for c, f in filters.items() if c in own})
    folded = reviews_per_order(rows, [c for c in by if c in own])
    return [c for c in by if c not in own], {c: f for c, f in filters.items() if c not in own}, folded


def _evaluate_related(model: StarModel, chosen: list[Measure], by: list[str], filters: Mapping, date_role: str | None) -> DataFrame:
    """Measures where groups or filters lie on many-to-many relations.

    Fact measures are summed by the keys of the bridges first and meet them as one row per key, so a key that holds a large
    share of the fact costs no more than any other.
    """
    results = []
    far = model.outside([*by, *filters])
    met = bridges(model.all_relations(), model.dimensions, [c for c in far if c in by], {c: f for c, f in filters.items() if c in far})
    near, rest = [c for c in by if c not in far], {c: f for c, f in filters.items() if c not in far}
    of_fact = [m for m in chosen if m.source == "fact"]
    additive, distinct = [m for m in of_fact if m.kind != "distinct"], [m for m in of_fact if m.kind == "distinct"]

    def across(keys: list[str], *parts: Column) -> DataFrame:
        keys = list(dict.fromkeys([*near, *(b.fact_key for b in met), *keys]))
        rows = visible_fact(model, near, rest, date_role)
        for bridge in met:  # rows in no group go before they are held as sums
            rows = rows.join(bridge.rows.select(bridge.fact_key), bridge.fact_key, "left_semi")
        rows = rows.groupBy(*keys).agg(*parts)
        for bridge in met:
            rows = bridge.onto(rows)
        return rows.groupBy(*by)

    if additive:
        parts = across([], *[p for m in additive for p in _order_parts(m)])
        results.append(parts.agg(*[_from_parts(m).alias(m.name) for m in additive]))
    for m in distinct:
        results.append(across([m.column], F.count(F.lit(1)).alias("_rows")).agg(F.countDistinct(m.column).alias(m.name)))
    of_reviews = [m for m in chosen if m.source == "reviews"]
    if of_reviews:
        others, kept, folded = split_by_reviews(model, by, filters)
        orders = visible_fact(_reviewed(model, folded), others, kept, date_role).select(*others, "order_id").distinct()
        results.append(orders.join(folded, "order_id").groupBy(*by).agg(*[_from_parts(m).alias(m.name) for m in of_reviews]))
    of_forecast = [m for m in chosen if m.source == "forecast"]
    if of_forecast:
        results.append(_evaluate_forecast(model, of_forecast, by, filters))
    out = results[0]
    for other in results[1:]:
        out = _outer(out, other, by)
    return out


def related_rows(
    model: StarModel,
    relation: str,
    by: Sequence[str] = (),
    filters: Mapping[str, Sequence[Any] | Column] | None = None,
    date_role: str | None = None,
) -> DataFrame:
    """Rows of a many-to-many table that the filters of the whole model leave, once for each group of ``by``.

    Filters on its own columns hold for its rows, all others reach it through the fact. ``by`` are columns of the fact, of
    dimensions or of other relations.
    """
    far = model.all_relations()[relation]
    owner = owners(model.all_relations(), model.outside(list(filters or {})))
    own = {c: f for c, f in (filters or {}).items() if owner.get(c) == relation}
    clash = [c for c in by if c in far.table.columns]
    if clash:
        raise ValueError(f"{relation} has {clash} itself: group its rows by them afterwards")
    fact_rows = visible_fact(model, list(by), {c: f for c, f in (filters or {}).items() if c not in own}, date_role)
    return visible_from(fact_rows, list(by), far, own)


def evaluate(
    model: StarModel,
    measures: Sequence[str],
    by: Sequence[str] = (),
    filters: Mapping[str, Sequence[Any] | Column] | None = None,
    date_role: str | None = None,
) -> DataFrame:
    """Measures by dimension columns, under an IN-list or a predicate per column (the key of ``filters``).

    Groups without any value do not appear. Only named measures can be asked for.
    """
    unknown = [m for m in measures if m not in MEASURES]
    if unknown:
        raise ValueError(f"unknown measures: {unknown}")
    by, filters = list(by), dict(filters or {})
    chosen = [MEASURES[m] for m in measures]
    results = []
    dimension = _single_dimension(model, chosen, by, filters)
    if dimension and all(m.source == "fact" for m in chosen):
        return _finished(_evaluate_by_key(model, chosen, by, filters, dimension), chosen, by)
    if model.outside([*by, *filters]):
        return _finished(_evaluate_related(model, chosen, by, filters, date_role), chosen, by)
    visible = visible_fact(model, by, filters, date_role)
    of_fact = [m for m in chosen if m.source == "fact"]
    of_reviews = [m for m in chosen if m.source == "reviews"]
    if of_reviews:
        # Every order once per group, whatever its number of items. Additive fact measures ride along, so
        # the fact is read once; the order key of the fact's own join also serves the grouping and the reviews.
        additive = [m for m in of_fact if m.kind != "distinct"]
        of_fact = [m for m in of_fact if m.kind == "distinct"]
        parts = [p for m in additive for p in _order_parts(m)] or [F.count(F.lit(1)).alias("_items")]
        orders = visible.groupBy(*by, "order_id").agg(*parts)
        how = "left" if additive else "inner"
        if not additive:
            orders = visible_fact(_reviewed(model, model.reviews), by, filters, date_role).groupBy(*by, "order_id").agg(*parts)
        joined = orders.join(reviews_per_order(model.reviews), "order_id", how)
        results.append(joined.groupBy(*by).agg(*[_from_parts(m).alias(m.name) for m in additive + of_reviews]))
    if of_fact:
        results.append(visible.groupBy(*by).agg(*[_fact_aggregate(m).alias(m.name) for m in of_fact]))
    of_forecast = [m for m in chosen if m.source == "forecast"]
    if of_forecast:
        results.append(_evaluate_forecast(model, of_forecast, by, filters))
    out = results[0]
    for other in results[1:]:
        out = _outer(out, other, by)
    return _finished(out, chosen, by)


def _finished(out: DataFrame, chosen: list[Measure], by: list[str]) -> DataFrame:
    return out.select(
        *by,
        *[F.coalesce(m.name, F.lit(0.0)).alias(m.name) if m.blank_is_zero else F.col(m.name) for m in chosen],
    )


def visible_forecast(model: StarModel, by: Sequence[str], filters) -> DataFrame:
    """The forecast is related to the calendar only, so other columns cannot group or filter it."""
    rows = model.forecast.withColumn("date", F.to_date("date"))
    calendar_columns = [] if model.calendar is None else model.calendar.columns
    needed = [c for c in {*by, *(filters or {})} if c != "date" and c in calendar_columns]
    if needed:
        rows = rows.join(model.calendar.select("date", *needed), "date", "left")
    foreign = [c for c in by if c not in rows.columns]
    if foreign:
        raise ValueError(f"the forecast has no relation to {foreign}")
    rows = matching(rows, {c: f for c, f in (filters or {}).items() if c in rows.columns})
    return rows


def _evaluate_forecast(model: StarModel, measures: list[Measure], by: list[str], filters) -> DataFrame:
    return visible_forecast(model, by, filters).groupBy(*by).agg(*[F.sum(m.column).alias(m.name) for m in measures])


def total_sales_all_dates(model: StarModel, calendar: DataFrame, date_role: str | None = None) -> DataFrame:
    """Total sales per calendar day, 0 where nothing was sold."""
    sold = evaluate(model, ["total_sales_missing_dates"], ["date"], date_role=date_role)
    return (
        calendar.select("date")
        .join(sold, "date", "left")
        .withColumn("total_sales_missing_dates", F.coalesce("total_sales_missing_dates", F.lit(0.0)))
    )


def drill(model: StarModel, measures: Sequence[str], hierarchy: str, level: int) -> DataFrame:
    """Measures at a level of a hierarchy: level 1 is the top, deeper levels keep the levels above."""
    return evaluate(model, measures, list(model.hierarchies[hierarchy][:level]))


def sorted_by(df: DataFrame, label: str, key: str) -> DataFrame:
    """Distinct labels in the display order given by another column."""
    return df.groupBy(label).agg(F.min(key).alias(key)).orderBy(key)
