"""References to records that do not exist.

``orphan_references`` walks the foreign-key graph to a fixpoint and tells direct orphans from inherited ones, row by row;
``orphan_cascade`` counts them per table, column and month. A parent table may hold stretches of life, and a reference a
time: then the parent must have been alive when the reference was made.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.scratch import Scratch
from graphloom.plans.skew import crowded_keys, salted_join


@dataclass(frozen=True)
class Table:
    """A table of the foreign-key graph.

    ``key`` is the column others refer to and orphans are named by (None: a table of references only), ``period`` the
    time of its rows, by which orphans are reported. ``born`` and ``gone`` bound the life of a row of a parent table
    (gone null: still alive); without them a row is always alive.
    """

    df: DataFrame
    key: str | None = None
    period: str | None = None
    born: str | None = None
    gone: str | None = None


@dataclass(frozen=True)
class ForeignKey:
    """``child.column`` refers to ``parent``'s key.

    Values other than null and '' are references, of those only the ones for which the SQL condition ``where`` over the
    child's columns holds. ``timed``: the parent must be alive at the child's ``period``.
    """

    child: str
    column: str
    parent: str
    where: str | None = None
    timed: bool = False


def _lives(t: Table) -> DataFrame:
    """``_ref`` (and ``_born, _gone``) of every distinct stretch of life of the keys of ``t``."""
    cols = [F.col(t.key).cast("string").alias("_ref")]
    if t.born:
        cols += [F.col(t.born).alias("_born"), (F.col(t.gone) if t.gone else F.lit(None).cast("timestamp_ntz")).alias("_gone")]
    return t.df.select(*cols).where("_ref is not null" + (" and _born is not null" if t.born else "")).distinct()


def _references(t: Table, fk: ForeignKey) -> DataFrame:
    """``_ref, _own, _at`` of every reference of ``fk``; repeated rows stay."""
    rows = t.df.where(fk.where) if fk.where else t.df
    own = F.col(t.key).cast("string") if t.key else F.lit(None).cast("string")
    at = F.col(t.period) if t.period else F.lit(None).cast("timestamp_ntz")
    return rows.select(F.col(fk.column).cast("string").alias("_ref"), own.alias("_own"), at.alias("_at")).where("_ref is not null and _ref <> ''")


class _Cascade:
    """Direct orphans of every foreign key and, per parent table, the keys of its orphaned rows."""

    def __init__(self, tables: Mapping[str, Table], keys: Sequence[ForeignKey]):
        self.tables, self.keys = tables, list(keys)
        self.scratch = Scratch(next(iter(tables.values())).df.sparkSession, "orphans")
        self.lives = {name: _lives(t) for name, t in tables.items() if t.key}
        self.refs = {fk: _references(tables[fk.child], fk) for fk in keys}
        self.heavy = {fk: crowded_keys(r, "_ref") for fk, r in self.refs.items()}
        self.direct = {fk: self._join(fk, self.refs[fk], self.lives[fk.parent], "left_anti", fk.timed) for fk in keys}
        self.orphans = self._fixpoint()

    def _join(self, fk: ForeignKey, refs: DataFrame, side: DataFrame, how: str, timed: bool = False) -> DataFrame:
        alive: Column | None = None
        if timed and self.tables[fk.parent].born:
            alive = (F.col("_born") <= F.col("_at")) & (F.col("_gone").isNull() | (F.col("_gone") > F.col("_at")))
        elif "_born" in side.columns:
            side = side.select("_ref").distinct()
        return salted_join(refs, side, "_ref", self.heavy[fk], F.struct("_own", "_at"), how, on=alive)

    def _fixpoint(self) -> dict[str, DataFrame]:
        """Keys of orphaned rows per parent table; every round follows only the keys found in the last one."""
        parents = {fk.parent for fk in self.keys}
        passing = [fk for fk in self.keys if fk.child in parents and self.tables[fk.child].key]
        known: dict[str, list[DataFrame]] = {}

        def add(found: dict[str, list[DataFrame]]) -> dict[str, DataFrame]:
            fresh = {}
            for name, parts in found.items():
                new = functools.reduce(DataFrame.unionByName, parts).select(F.col("_own").alias("_ref")).where("_ref is not null").distinct()
                if name in known:
                    new = new.join(functools.reduce(DataFrame.unionByName, known[name]), "_ref", "left_anti")
                new, path = self.scratch.put(new, name)
                if new.isEmpty():
                    self.scratch.drop(path)
                else:
                    known.setdefault(name, []).append(new)
                    fresh[name] = new
                    if len(known[name]) > 8:  # Long chains must not make long plans.
                        known[name] = [self.scratch.put(functools.reduce(DataFrame.unionByName, known[name]), name)[0]]
            return fresh

        found: dict[str, list[DataFrame]] = {}
        for fk in passing:
            found.setdefault(fk.child, []).append(self.direct[fk])
        frontier = add(found)
        while frontier:
            found = {}
            for fk in passing:
                if fk.parent in frontier:
                    found.setdefault(fk.child, []).append(self._join(fk, self.refs[fk], frontier[fk.parent], "left_semi"))
            frontier = add(found)
        return {name: functools.reduce(DataFrame.unionByName, parts) for name, parts in known.items()}

    def inherited(self, fk: ForeignKey) -> DataFrame | None:
        """References whose parent row exists and is itself an orphan."""
        if fk.parent not in self.orphans:
            return None
        hit = self._join(fk, self.refs[fk], self.orphans[fk.parent], "left_semi")
        return self._join(fk, hit, self.lives[fk.parent], "left_semi", fk.timed)


def _labelled(fk: ForeignKey, df: DataFrame, state: str) -> DataFrame:
    return df.select(
        F.lit(fk.child).alias("tbl"), F.lit(fk.column).alias("column"), F.col("_own").alias("key"), F.col("_ref").alias("ref"), F.col("_at").alias("at"), F.lit(state).alias("state")
    )


def orphan_references(tables: Mapping[str, Table], keys: Sequence[ForeignKey]) -> DataFrame:
    """``tbl, column, key, ref, at, state`` of every orphan reference; ``state`` is ``direct`` or ``inherited``.

    A reference is *direct* if its parent table has no row of that key (for a timed key: none alive at the time of the
    reference), *inherited* if it has, but the parent row is itself an orphan, directly or by inheritance. Null and ''
    are no references. A timed reference without a time has no living parent. Rounds repeat until no parent row is newly
    orphaned, each following only what the last round found, so cycles and chains of any length end. Repeated rows count
    as they stand. Only key, period, life and reference columns are read, so other columns may have any name.
    """
    c = _Cascade(tables, keys)
    parts = []
    for fk in keys:
        parts.append(_labelled(fk, c.direct[fk], "direct"))
        if (inherited := c.inherited(fk)) is not None:
            parts.append(_labelled(fk, inherited, "inherited"))
    return functools.reduce(DataFrame.unionByName, parts)


def orphan_cascade(tables: Mapping[str, Table], keys: Sequence[ForeignKey]) -> DataFrame:
    """:func:`orphan_references` counted as ``tbl, column, month, direct, inherited, references`` per column and month.

    ``references`` counts all references, sound ones too; a month is null where the table has no period or its value is null.
    """
    c = _Cascade(tables, keys)
    month = F.date_format("_at", "yyyy-MM").alias("month")
    out = []
    for fk in keys:
        for df, col in ((c.refs[fk], "references"), (c.direct[fk], "direct"), (c.inherited(fk), "inherited")):
            if df is not None:
                zero = [F.lit(0).cast("bigint").alias(x) if x != col else F.count(F.lit(1)).alias(x) for x in ("direct", "inherited", "references")]
                out.append(df.groupBy(month).agg(*zero).select(F.lit(fk.child).alias("tbl"), F.lit(fk.column).alias("column"), "month", "direct", "inherited", "references"))
    sums = [F.sum(x).alias(x) for x in ("direct", "inherited", "references")]
    return functools.reduce(DataFrame.unionByName, out).groupBy("tbl", "column", "month").agg(*sums)


#: Edges name no node of kind ``link``: those are web addresses.
NOT_A_LINK = "split_part({0}, ':', 2) <> 'link'"


def project_keys(edges: Table, nodes: Table, files: Table | None = None) -> tuple[dict[str, Table], list[ForeignKey]]:
    """The foreign-key graph of edges, nodes and (if given) the files nodes were taken from."""
    tables = {"edges": edges, "nodes": nodes}
    keys = [ForeignKey("edges", end, "nodes", NOT_A_LINK.format(end), timed=True) for end in ("source", "target")]
    if files is not None:
        tables["files"] = files
        keys.append(ForeignKey("nodes", "sourcefile", "files"))
    return tables, keys


def graph_orphans(edges: DataFrame, nodes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``edge_id, endpoint, id, built_at``: the direct orphans among the references of ``edges``, one row per edge and endpoint.

    ``nodes`` has id, built_at, removed_at (and sourcefile if ``files``, with path, is given: then nodes of missing files
    are orphans too, and the cascade passes on to the edges). Rows come out of :func:`orphan_references`.
    """
    e = Table(edges.select("edge_id", "source", "target", "built_at"), "edge_id", "built_at")
    columns = ["id", "built_at", "removed_at"] + (["sourcefile"] if files is not None else [])
    n = Table(nodes.select(*columns), "id", "built_at", "built_at", "removed_at")
    f = None if files is None else Table(files.select("path"), "path")
    found = orphan_references(*project_keys(e, n, f)).where("tbl = 'edges' and state = 'direct'")
    key_type = dict(edges.dtypes)["edge_id"]
    return found.select(F.col("key").cast(key_type).alias("edge_id"), F.col("column").alias("endpoint"), F.col("ref").alias("id"), F.col("at").alias("built_at")).distinct()
