"""Networks: signed, weighted edges from regulators to targets. Every method returns a new network."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.ranks import average_rank, top_and_bottom
from .common import GROUPS, names_frame, only

COLUMNS = ("regulator", "target", "mor", "likelihood")


class Network:
    def __init__(self, edges: DataFrame, name: str = "net", groups: dict[str, DataFrame] | None = None):
        """``edges`` has four columns, taken by position."""
        if len(edges.columns) != 4:
            raise ValueError("a network has four columns: regulator, target, mor, likelihood")
        e = edges.toDF(*COLUMNS)
        self.edges = e.select(*[F.col(c).cast("string" if c in COLUMNS[:2] else "double").alias(c) for c in COLUMNS])
        self.name, self.groups = str(name), groups or {}

    def _with(self, edges: DataFrame, name: str | None = None) -> Network:
        return Network(edges.select(*COLUMNS), name or self.name, self.groups)

    copy = lambda self: self  # noqa: E731  frames are immutable

    # -- filters
    def _names(self, names) -> DataFrame:
        if isinstance(names, DataFrame):
            return names
        names = [names] if isinstance(names, str) else list(names)
        keys = [GROUPS.get(str(n).lower()) for n in names]
        if names and len(names) <= 4 and None not in keys:
            if missing := [k for k in keys if k not in self.groups]:
                raise ValueError(f"no list of regulators is set for {missing}")
            out = self.groups[keys[0]]
            for k in keys[1:]:
                out = out.union(self.groups[k])
            return out
        return names_frame(self.edges.sparkSession, names)

    def _filter(self, column: str, keep, remove) -> Network:
        e = self.edges
        if keep is not None:
            e = only(e, column, self._names(keep))
        if remove is not None:
            e = only(e, column, self._names(remove), anti=True)
        return self._with(e)

    def filter_regulators(self, keep=None, remove=None) -> Network:
        """By names, a one-column frame, or up to four group names (tfs, cotfs, sig, surf)."""
        return self._filter("regulator", keep, remove)

    def filter_targets(self, keep=None, remove=None) -> Network:
        return self._filter("target", keep, remove)

    def get_reg(self, name: str) -> DataFrame:
        return self.edges.where(F.col("regulator") == str(name))

    def regulators(self) -> DataFrame:
        return self.edges.select("regulator").distinct()

    def targets(self) -> DataFrame:
        return self.edges.select("target").distinct()

    # -- measures
    def size(self) -> DataFrame:
        return self.edges.agg(F.countDistinct("regulator").alias("regulators"))

    def targets_per_regulon(self) -> DataFrame:
        return self.edges.groupBy("regulator").agg(F.countDistinct("target").alias("targets"))

    def summary(self) -> DataFrame:
        """regulators, interactions, median_targets, mean_abs_mor, mean_likelihood: one row."""
        per = self.edges.groupBy("regulator").agg(
            F.countDistinct("target").alias("targets"), F.count("*").alias("n"),
            F.sum(F.abs("mor")).alias("m"), F.sum("likelihood").alias("l"))
        return per.agg(F.count("*").alias("regulators"), F.sum("n").alias("interactions"), F.median("targets").alias("median_targets"),
                       (F.sum("m") / F.sum("n")).alias("mean_abs_mor"), (F.sum("l") / F.sum("n")).alias("mean_likelihood"))

    def icp(self) -> DataFrame:
        """regulator, icp: the root of the sum of squared likelihoods over the largest."""
        return self.edges.groupBy("regulator").agg(
            F.try_divide(F.sqrt(F.sum(F.col("likelihood") * F.col("likelihood"))), F.max("likelihood")).alias("icp"))

    def weights(self) -> DataFrame:
        """regulator, target, mor, weight: repeated pairs averaged, likelihoods summing to one per regulator."""
        one = self.edges.groupBy("regulator", "target").agg(F.avg("mor").alias("mor"), F.avg("likelihood").alias("likelihood"))
        total = F.sum("likelihood").over(W.partitionBy("regulator"))
        return one.select("regulator", "target", "mor", F.try_divide("likelihood", total).alias("weight"))

    def repeated_pairs(self) -> DataFrame:
        return self.edges.groupBy("regulator", "target").agg(F.count("*").alias("times")).where("times > 1")

    def regulons(self) -> DataFrame:
        """regulator, edges: the nested form."""
        return self.edges.groupBy("regulator").agg(F.sort_array(F.collect_list(F.struct("target", "mor", "likelihood"))).alias("edges"))

    # -- transforms
    def prune(self, max_targets: int | None = 50, min_targets: int | None = None, eliminate: bool = True) -> Network:
        """The most likely targets of each regulator; regulators with too few go.

        With ``eliminate`` regulators need ``min_targets``, or else ``max_targets``.
        """
        e = self.edges
        if max_targets is not None:
            place = F.row_number().over(W.partitionBy("regulator").orderBy(F.desc("likelihood"), "target", F.desc("mor")))
            e = e.withColumn("place", place).where(F.col("place") <= max_targets)
        least = min_targets if min_targets is not None else max_targets if eliminate else None
        if least:
            e = e.withColumn("n", F.count("*").over(W.partitionBy("regulator"))).where(F.col("n") >= least)
        return self._with(e)

    def remove_duplicate_pairs(self, keep: str | bool = "likelihood", order: str | None = None) -> Network:
        """One edge per pair: the likeliest, the first or last by ``order`` (an expression), or none of repeated ones (False)."""
        w = W.partitionBy("regulator", "target")
        if keep is False:
            return self._with(self.edges.withColumn("n", F.count("*").over(w)).where("n = 1"))
        if keep == "likelihood":
            by = [F.desc("likelihood"), F.desc("mor")]
        elif keep in ("first", "last"):
            key = F.expr(order) if order else F.monotonically_increasing_id()
            by = [key if keep == "first" else key.desc()]
        else:
            raise ValueError("keep is 'likelihood', 'first', 'last' or False")
        return self._with(self.edges.withColumn("place", F.row_number().over(w.orderBy(*by))).where("place = 1"))

    def _translate(self, column: str, mapping: DataFrame, source: str, target: str) -> Network:
        table = mapping.select(F.col(source).alias(column), F.col(target).alias("to")).where(F.col(column).isNotNull())
        first = table.groupBy(column).agg(F.min("to").alias("to"))
        e = self.edges.join(first, column).where(F.col("to").isNotNull() & ~F.col("to").isin("", "-1"))
        return self._with(e.drop(column).withColumnRenamed("to", column))

    def translate_targets(self, mapping: DataFrame, source: str, target: str) -> Network:
        """Targets by another name; those that ``mapping`` lacks go, of several names the first in order counts."""
        return self._translate("target", mapping, source, target)

    def translate_regulators(self, mapping: DataFrame, source: str, target: str) -> Network:
        return self._translate("regulator", mapping, source, target)

    def normalized_likelihoods(self, ascending: bool = True) -> Network:
        """Likelihood ranks over (targets + 1) per regulator, the largest likelihood highest unless ``ascending`` is false."""
        value = F.col("likelihood") if ascending else -F.col("likelihood")
        n = F.count("*").over(W.partitionBy("regulator"))
        return self._with(self.edges.withColumn("likelihood", average_rank(value, "regulator") / (n + 1)))

    def integrate(self, others: Sequence[Network], weights: Iterable[float] | None = None,
                  normalize_likelihoods: bool = False, ascending: bool = True) -> Network:
        """The weighted consensus with ``others``.

        A pair that a network lacks counts as 0 if it has the regulator, else not at all.
        """
        nets = [self, *others]
        weights = list(weights) if weights is not None else [1.0] * len(nets)
        if len(weights) != len(nets):
            raise ValueError("one weight a network")
        stacked = regs = None
        for k, (net, w) in enumerate(zip(nets, weights)):
            net = net.normalized_likelihoods(ascending) if normalize_likelihoods else net
            one = net.edges.groupBy("regulator", "target").agg(F.avg("mor").alias("mor"), F.avg("likelihood").alias("likelihood"))
            one = one.withColumn("w", F.lit(float(w)))
            has = net.regulators().withColumn("w", F.lit(float(w)))
            stacked = one if stacked is None else stacked.unionByName(one)
            regs = has if regs is None else regs.unionByName(has)
        total = regs.groupBy("regulator").agg(F.sum("w").alias("total"))
        sums = stacked.groupBy("regulator", "target").agg(
            F.sum(F.col("mor") * F.col("w")).alias("m"), F.sum(F.col("likelihood") * F.col("w")).alias("l"))
        out = sums.join(total, "regulator").select(
            "regulator", "target", (F.col("m") / F.col("total")).alias("mor"), (F.col("l") / F.col("total")).alias("likelihood"))
        return self._with(out, "integrated")

    # -- makers
    @classmethod
    def from_aracne(cls, table: DataFrame, annotation: DataFrame | None = None, mi_threshold: float = 0.0,
                    regulon_size: int = 50, normalize_per_regulon: bool = True, name: str = "aracne") -> Network:
        """From regulator, target, mi, scc, count (by position): edges above the threshold, the most supported per regulator."""
        t = table.toDF("regulator", "target", "mi", "scc", "count")
        if annotation is not None:
            a = annotation.toDF("id", "name").groupBy("id").agg(F.min("name").alias("name"))
            for c in ("regulator", "target"):
                t = t.join(a.select(F.col("id").alias(c), F.col("name").alias("_n")), c, "left").withColumn(
                    c, F.coalesce("_n", c)).drop("_n")
        t = t.where(F.col("mi") > mi_threshold)
        place = F.row_number().over(W.partitionBy("regulator").orderBy(F.desc("count"), F.desc("mi"), "target"))
        t = t.withColumn("place", place).where(F.col("place") <= regulon_size)
        top = F.max("mi").over(W.partitionBy("regulator")) if normalize_per_regulon else F.max("mi").over(W.partitionBy())
        return cls(t.select("regulator", "target", F.col("scc").alias("mor"), (F.col("mi") / top).alias("likelihood")), name)

    @classmethod
    def from_incidence(cls, table: DataFrame, name: str = "incidence") -> Network:
        """From regulator, target, present: an edge with mor 1 and likelihood 1 where present is 1."""
        t = table.toDF("regulator", "target", "present").where("present = 1")
        return cls(t.select("regulator", "target", F.lit(1.0), F.lit(1.0)), name)

    @classmethod
    def from_activity(cls, activity: DataFrame, n_top: int = 50, symmetric: bool = True, name: str = "activity") -> Network:
        """Each sample's most (and, if symmetric, half as many each of most and least) active regulators as its targets."""
        a = activity.select("sample", "regulator", "nes")
        if symmetric:
            t = top_and_bottom(a, "nes", "regulator", n_top // 2, "sample")
            mor = F.when(F.col("top") <= n_top // 2, 1.0).otherwise(-1.0)
        else:
            t, mor = top_and_bottom(a, "nes", "regulator", n_top, "sample", keep="top"), F.lit(1.0)
        return cls(t.select("sample", "regulator", mor.alias("mor"), F.lit(1.0)), name)
