"""Identical rows, leakage between splits, conflicting labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.base import Analyzer, require_column
from gaugewell.functions.missing import canon, col
from gaugewell.plans.ranking import with_rank


class ExactDuplicates(Analyzer):
    """Rows are identical if all columns but split, label and id are; missing equals missing.

    group_id is the rank of a row's identity among all distinct identities, in column
    order, missing last. Rates and summaries need one shuffle on the identity; ids are
    ranked only for the reports that show them.
    """

    id = "dataset.duplicates.exact"
    capability = "duplicates.exact"
    provides = ("duplicates.exact",)

    def __init__(self, df: DataFrame, split_col: str | None = None, label_col: str | None = None, id_col: str | None = None):
        for c, role in ((split_col, "split_col"), (label_col, "label_col"), (id_col, "id_col")):
            require_column(df, c, role)
        self.df, self.split_col, self.label_col, self.id_col = df, split_col, label_col, id_col
        self.identity = [c for c in df.columns if c not in (split_col, label_col, id_col)]
        self._ranked: DataFrame | None = None

    @classmethod
    def from_splits(cls, splits: dict[str, DataFrame], label_col: str | None = None, split_col_name: str = "split", id_col: str | None = None):
        """Union of the splits, tagged with their names. Two at least, with the same columns."""
        if len(splits) < 2:
            raise ValueError("from_splits needs two splits at least")
        first = next(iter(splits.values()))
        for name, df in splits.items():
            if split_col_name in df.columns:
                raise ValueError(f"split {name!r} has a column {split_col_name!r} already")
            if set(df.columns) != set(first.columns):
                raise ValueError(f"split {name!r} has other columns: {sorted(set(df.columns) ^ set(first.columns))}")
        tagged = [df.withColumn(split_col_name, F.lit(name)) for name, df in splits.items()]
        return cls(reduce(lambda a, b: a.unionByName(b), tagged), split_col_name, label_col, id_col)

    def _keys(self):
        return [canon(self.df, c).alias(f"__k{i}") for i, c in enumerate(self.identity)]

    def _names(self):
        return [f"__k{i}" for i in range(len(self.identity))]

    def _sets(self) -> list:
        """Aggregates of a group: size, and sorted distinct splits and labels (labels by their text)."""
        out = [F.count("*").alias("size")]
        if self.split_col:
            out.append(F.array_sort(F.collect_set(canon(self.df, self.split_col))).alias("splits"))
        if self.label_col:
            label = canon(self.df, self.label_col)
            pairs = F.collect_set(F.when(label.isNotNull(), F.struct(label.cast("string").alias("s"), label.alias("v"))))
            out.append(F.transform(F.array_sort(pairs), lambda x: x["v"]).alias("labels"))
        return out

    def _flags(self) -> list:
        """Aggregates of a group: size, and whether it has two splits and two labels. Of fixed size, however many labels a group has."""
        out = [F.count("*").alias("size")]
        for c, name in ((self.split_col, "splits"), (self.label_col, "labels")):
            if c:
                text = canon(self.df, c).cast("string")
                out.append(F.coalesce(F.min(text) != F.max(text), F.lit(False)).alias(f"two_{name}"))
        return out

    def _groups(self) -> DataFrame:
        return self.df.groupBy(*self._keys()).agg(*self._sets())

    def groups(self) -> DataFrame:
        """Every distinct identity with its group_id, size, splits, labels."""
        if self._ranked is None:
            self._ranked = with_rank(self._groups(), [F.col(k).asc_nulls_last() for k in self._names()], "group_id")
        return self._ranked

    def _duplicated(self) -> DataFrame:
        return self.groups().where("size > 1")

    def duplicate_rate(self) -> DataFrame:
        """One row: n_rows, n_duplicate_rows (originals too), rate, n_groups."""
        return self._report(self.df.groupBy(*self._keys()).agg(F.count("*").alias("size")))

    def _report(self, groups: DataFrame, extra=()) -> DataFrame:
        many = F.col("size") > 1
        rows, duplicate = F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.when(many, F.col("size"))), F.lit(0))
        return groups.agg(rows.alias("n_rows"), duplicate.alias("n_duplicate_rows"), F.when(rows > 0, duplicate / rows).otherwise(F.lit(0.0)).alias("rate"), F.count_if(many).alias("n_groups"), *extra)

    def duplicate_groups(self) -> DataFrame:
        """group_id, size, removable_rows, largest first. group_members() lists their rows."""
        return self._duplicated().select("group_id", "size", (F.col("size") - 1).alias("removable_rows")).orderBy(F.desc("size"), "group_id")

    def _joined(self, groups: DataFrame) -> DataFrame:
        names = self._names()
        on = reduce(lambda a, b: a & b, [k.eqNullSafe(groups[n]) for k, n in zip((canon(self.df, c) for c in self.identity), names)], F.lit(True))
        return self.df.join(groups, on).drop(*names)

    def group_members(self) -> DataFrame:
        """group_id and id of every row of a duplicate group: a row each, not a list, as a group may hold much of the table."""
        if not self.id_col:
            raise ValueError("group_members needs id_col")
        return self._joined(self._duplicated().select("group_id", *self._names())).select("group_id", col(self.id_col))

    def rows_in(self, group_id: int) -> DataFrame:
        found = self.groups().where(F.col("group_id") == group_id).select(*self._names())
        if not found.take(1):
            raise ValueError(f"no group {group_id}")
        return self._joined(found).select(*[col(c) for c in self.df.columns])

    def cross_split_overlap(self) -> DataFrame:
        """group_id, size, splits, n_splits, is_cross_split of duplicate groups; missing splits don't count."""
        if not self.split_col:
            raise ValueError("cross_split_overlap needs split_col")
        out = self._duplicated().select("group_id", "size", "splits", F.size("splits").alias("n_splits"), (F.size("splits") > 1).alias("is_cross_split"))
        return out.orderBy(F.desc("is_cross_split"), F.desc("size"), "group_id")

    def label_conflicts(self) -> DataFrame:
        """group_id, size, labels, n_distinct_labels, has_conflict of duplicate groups; missing labels don't count."""
        if not self.label_col:
            raise ValueError("label_conflicts needs label_col")
        out = self._duplicated().select("group_id", "size", "labels", F.size("labels").alias("n_distinct_labels"), (F.size("labels") > 1).alias("has_conflict"))
        return out.orderBy(F.desc("has_conflict"), F.desc("size"), "group_id")

    def summary(self) -> DataFrame:
        """duplicate_rate(), and counts and rates of cross-split and conflicting groups where the columns are given."""
        many = F.col("size") > 1
        extra = []
        for c, of, count, rate in ((self.split_col, "splits", "cross_split_groups", "cross_split_rate_of_groups"), (self.label_col, "labels", "conflicting_groups", "conflict_rate_of_groups")):
            if c:
                hit = F.count_if(many & F.col(f"two_{of}"))
                extra += [hit.alias(count), F.when(F.count_if(many) > 0, hit / F.count_if(many)).otherwise(F.lit(0.0)).alias(rate)]
        return self._report(self.df.groupBy(*self._keys()).agg(*self._flags()), extra)

    def flagged_groups(self) -> DataFrame:
        """size, and two_splits and two_labels where the columns are given, of duplicate groups; no ids and no lists."""
        return self.df.groupBy(*self._keys()).agg(*self._flags()).where("size > 1").drop(*self._names())
