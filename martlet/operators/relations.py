"""Many-to-many relations of a star: tables that share a key with the fact, a dimension or each other.

Filters and groups pass an edge by a *bridge*: the distinct pairs of key and group columns that the far table leaves after
its own filters. A bridge meets the near table by key, so a near row shows up once in every group it belongs to, however
many far rows say so, and with filters alone it is a semi join. Near rows without a far row are in no group of it. The
other way, rows of a far table are visible when their key is left in the fact.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Relation:
    """``table.key`` meets ``target_key`` (the same name if not given) of ``target``: the fact, a dimension or a relation."""

    table: DataFrame
    key: str
    target: str = "fact"
    target_key: str | None = None

    @property
    def near_key(self) -> str:
        return self.target_key or self.key


@dataclass(frozen=True)
class Bridge:
    """What reaches the fact from one relation: pairs of the fact's key and group columns, or the keys alone."""

    fact_key: str
    rows: DataFrame
    columns: tuple[str, ...]

    def onto(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.rows, self.fact_key, "inner" if self.columns else "left_semi")


def matching(rows: DataFrame, filters: Mapping[str, Any]) -> DataFrame:
    """Rows under an IN-list or a predicate for each column."""
    for name, wanted in filters.items():
        rows = rows.filter(wanted if isinstance(wanted, Column) else F.col(name).isin(*wanted))
    return rows


def owners(relations: Mapping[str, Relation], columns: Iterable[str]) -> dict[str, str]:
    """The relation that supplies each column. Unknown columns are left out, columns of several relations are an error."""
    out = {}
    for column in columns:
        names = [n for n, r in relations.items() if column in r.table.columns]
        if len(names) > 1:
            raise ValueError(f"{column} is a column of several relations: {sorted(names)}")
        out.update({column: n for n in names})
    return out


def _branch(relations: Mapping[str, Relation], name: str) -> list[str]:
    """``name`` and the relations behind it."""
    return [name, *(n for child, r in relations.items() if r.target == name for n in _branch(relations, child))]


def _left(relations: Mapping[str, Relation], name: str, columns: list[str], filters: Mapping[str, Any], owner: Mapping[str, str]) -> DataFrame:
    """Distinct (near key, group columns of the branch) of the rows that all filters of the branch leave."""
    relation = relations[name]
    own = [c for c in columns if owner[c] == name]
    rows, wanted = matching(relation.table, {c: f for c, f in filters.items() if owner[c] == name}), list(own)
    for child, r in relations.items():
        behind = set(_branch(relations, child)) if r.target == name else set()
        below = [c for c in columns if owner[c] in behind]
        if below or any(owner[c] in behind for c in filters):
            met = _left(relations, child, below, {c: f for c, f in filters.items() if owner[c] in behind}, owner)
            rows = rows.join(met.withColumnRenamed(r.near_key, "_near"), F.col(r.near_key) == F.col("_near"), "inner" if below else "left_semi")
            wanted += below
    if relation.near_key in own and relation.near_key != relation.key:
        raise ValueError(f"{relation.near_key} is the key and a column of {name}")
    key = F.col(relation.key).alias(relation.near_key)
    return rows.filter(F.col(relation.key).isNotNull()).select(key, *[c for c in wanted if c != relation.near_key]).distinct()


def bridges(
    relations: Mapping[str, Relation],
    dimensions: Mapping[str, tuple[DataFrame, str, str]],
    columns: Iterable[str],
    filters: Mapping[str, Any],
) -> list[Bridge]:
    """One bridge for each branch of relations next to the fact or a dimension that has one of ``columns`` or ``filters``."""
    columns = list(columns)
    owner = owners(relations, [*columns, *filters])
    unknown = {*columns, *filters} - set(owner)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    out = []
    for name, relation in relations.items():
        if relation.target in relations:
            continue
        branch = set(_branch(relations, name))
        wanted, kept = [c for c in columns if owner[c] in branch], {c: f for c, f in filters.items() if owner[c] in branch}
        if not wanted and not kept:
            continue
        rows, fact_key = _left(relations, name, wanted, kept, owner), relation.near_key
        if relation.target != "fact":
            table, fact_key, dim_key = dimensions[relation.target]
            met = table.select(F.col(dim_key).alias(fact_key), F.col(relation.near_key).alias("_near")).filter(F.col(fact_key).isNotNull())
            joined = met.join(rows.withColumnRenamed(relation.near_key, "_far"), F.col("_near") == F.col("_far"))
            rows = joined.select(fact_key, *wanted).distinct()
        out.append(Bridge(fact_key, rows, tuple(wanted)))
    return out


def visible_from(fact_rows: DataFrame, by: list[str], relation: Relation, filters: Mapping[str, Any]) -> DataFrame:
    """Rows of a relation next to the fact that ``fact_rows`` leave visible, once for each group of ``by``.

    ``filters`` are on the relation's own columns.
    """
    if relation.target != "fact":
        raise ValueError(f"the relation hangs on {relation.target}, not on the fact")
    own = matching(relation.table, filters)
    keys = fact_rows.select(*by, F.col(relation.near_key).alias("_near")).distinct()
    joined = own.join(keys, F.col(relation.key) == F.col("_near"), "inner" if by else "left_semi")
    return joined.drop("_near")
