"""Reports (A1-A5, W1, L1-L3, S12, T19).

All aggregates are partial + final hash aggregates. The five-number report
computes exact medians from quantile sketches and counts alone: no value is
exchanged, ranked or held with its group in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .filters import numeric_columns
from .rowindex import running_sum

# Fixed values.
METRIC_SUFFIX = "_metrics"
RATE_NAMES = ("True Postive", "True Negative", "False Negative", "False Positive", "Overall Accuracy")
SKETCH_ACCURACY = 10_000
PIVOTS = 4
ACCURACY_EVERY = 100
ACCURACY_AT = 1
EVAL_CAP = 200
TOP_K_RUNS = 3


def describe_metrics(df: DataFrame, cols: list[str] | None = None, by: Iterable[str] = (),
                     accuracy: int = SKETCH_ACCURACY, exact: bool = True) -> DataFrame:
    """A1 (+P14): one row per (by..., metric) with min, max, median (exact,
    interpolated), mean and std (population) of the numeric columns; NULL and NaN
    values are left out, and so is a metric without any other.

    Metrics stay columns: an aggregate combines in each partition and exchanges
    one row for each partition and group, whatever the number of values. For the
    exact median each metric has an open interval that holds its middle ranks.
    A pass takes a quantile sketch of the values inside, whose values around the
    ranks are pivots; the next counts the values below and up to every pivot. A
    pivot either is the value of a middle rank, by those counts, or bounds the
    interval anew, so the loop ends with the exact values; a sketch of
    ``accuracy`` shrinks the interval about ``accuracy`` / 20 times in a round.

    ``by`` gives the grouped variant (NULL is a group); its intervals, one row a
    group, join the values by group. ``exact=False`` takes the median from the
    first sketch alone (one aggregation, rank error at most n / ``accuracy``)."""
    keys = list(by)
    cols = cols or numeric_columns(df, exclude=keys)
    ids = list(range(len(cols)))
    values = df.select(*keys, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"_v{i}") for i, c in enumerate(cols)])
    stats = [f"{f}(_v{i}) AS {name}{i}" for i in ids for f, name in
             (("count", "n"), ("min", "min"), ("max", "max"), ("avg", "mean"), ("stddev_pop", "std"))]
    fixed = [f"{c}{i}" for i in ids for c in ("n", "min", "max", "mean", "std")]
    if not exact:
        state = _aggregate(values, keys, stats + [f"percentile_approx(_v{i}, 0.5D, {accuracy}) AS mid{i}" for i in ids])
        return _report_rows(state, keys, cols, "mid{i}")
    # every pass reads the narrow values, never their lineage
    values = materialize(values, "report-values")
    grid = max(4, accuracy // 5)
    first = _aggregate(values, keys, stats + [s for i in ids for s in _sketch(i, f"_v{i}", grid, accuracy)])
    start = {f"{c}{i}": kind for i in ids for c, kind in (("lo", "CAST(NULL AS DOUBLE)"), ("hi", "CAST(NULL AS DOUBLE)"), ("below", "0L"),
                                                          ("m1_", "CAST(NULL AS DOUBLE)"), ("m2_", "CAST(NULL AS DOUBLE)"))}
    first = first.selectExpr("*", *[f"{v} AS {c}" for c, v in start.items()])
    state = _State(keys).settle(first, fixed + list(start), {k: v for i in ids for k, v in _pivots(i, lambda c: c, grid).items()})
    todo = ids
    while todo:
        pairs = [(i, state.ref(f"p{j}_{i}"), j) for i in todo for j in range(PIVOTS)]
        counts = _aggregate(state.beside(values), keys, [s for i, pivot, j in pairs for s in (
            f"count_if(_v{i} < {pivot}) AS lt{j}_{i}", f"count_if(_v{i} <= {pivot}) AS le{j}_{i}")])
        found = {k: v for i in todo for k, v in _found(i, state.ref).items()}
        counts = state.beside(counts).selectExpr("*", *[f"{v} AS new_{c}" for c, v in found.items()])
        new = {k: v for i in todo for k, v in _bounds(i, state.ref).items()} | {c: f"new_{c}" for c in found}
        state = state.settle(counts, [], new)
        todo = state.unsettled(todo)
        if todo:
            sketch = [s for i in todo for s in _sketch(
                i, f"CASE WHEN coalesce(_v{i} > {state.ref(f'lo{i}')}, true) AND coalesce(_v{i} < {state.ref(f'hi{i}')}, true) THEN _v{i} END",
                grid, accuracy)]
            inside = state.beside(_aggregate(state.beside(values), keys, sketch))
            state = state.settle(inside, [], {k: v for i in todo for k, v in _pivots(i, state.ref, grid).items()})
    return _report_rows(state.table(df.sparkSession), keys, cols, "(m1_{i} + m2_{i}) / 2D")


def _aggregate(df: DataFrame, keys: list[str], exprs: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(e) for e in exprs])


def _report_rows(state: DataFrame, keys: list[str], cols: list[str], median: str) -> DataFrame:
    """One row a group -> one row for each group and metric that has values."""
    each = ", ".join(f"struct('{c}{METRIC_SUFFIX}' AS metric, min{i} AS min, max{i} AS max, {median.format(i=i)} AS median, "
                     f"mean{i} AS mean, std{i} AS std, n{i} AS _n)" for i, c in enumerate(cols))
    return state.selectExpr(*[f"`{k}`" for k in keys], f"inline(array({each}))").where("_n > 0").drop("_n")


class _State:
    """What is known of each group's metrics: constants of the plan where there
    is but one group, else a written table that joins by group."""

    def __init__(self, keys: list[str], known: dict[str, str] | DataFrame | None = None):
        self.keys, self.known = keys, {} if known is None else known

    def ref(self, name: str) -> str:
        return self.known[name] if isinstance(self.known, dict) else name

    def beside(self, df: DataFrame) -> DataFrame:
        """``df`` with its group's state."""
        if isinstance(self.known, dict):
            return df
        state = self.known.withColumnsRenamed({k: f"_by_{k}" for k in self.keys})
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in self.keys])
        return df.join(state, same).drop(*[f"_by_{k}" for k in self.keys])

    def settle(self, df: DataFrame, names: list[str], new: dict[str, str]) -> _State:
        """The state with columns ``names`` of ``df`` and the ``new`` ones, computed once."""
        new = {c: c for c in names} | new
        if not self.keys:
            out = df.selectExpr(*[f"{v} AS {c}" for c, v in new.items()])
            row = out.first()
            return _State(self.keys, self.known | {f.name: _literal(row[f.name], f.dataType.simpleString()) for f in out.schema})
        kept = [] if isinstance(self.known, dict) else [c for c in self.known.columns if c not in new and c not in self.keys]
        return _State(self.keys, materialize(df.selectExpr(*[f"`{k}`" for k in self.keys], *kept, *[f"{v} AS {c}" for c, v in new.items()]), "report-state"))

    def table(self, spark: SparkSession) -> DataFrame:
        if isinstance(self.known, dict):
            return spark.range(1).selectExpr(*[f"{v} AS {c}" for c, v in self.known.items()])
        return self.known

    def unsettled(self, ids: list[int]) -> list[int]:
        """The metrics of which some group lacks a middle value."""
        lacks = {i: f"{self.ref(f'n{i}')} > 0 AND ({self.ref(f'm1_{i}')} IS NULL OR {self.ref(f'm2_{i}')} IS NULL)" for i in ids}
        if isinstance(self.known, dict):
            return [i for i in ids if self.known[f"n{i}"] != "0L" and any(self.known[f"m{r}_{i}"].startswith("CAST(NULL") for r in (1, 2))]
        left = self.known.agg(*[F.expr(f"max({sql}) AS u{i}") for i, sql in lacks.items()]).first()
        return [i for i in ids if left[f"u{i}"]]


def _literal(value: float | int | None, kind: str) -> str:
    if value is None:
        return f"CAST(NULL AS {kind})"
    return f"{value}L" if isinstance(value, int) else f"double('{value!r}')"


def _open_ranks(i: int, m1: str, m2: str, n: str) -> tuple[str, str]:
    """The least and the greatest 0-based middle rank whose value is not known."""
    k1, k2 = f"floor(({n} - 1) / 2)", f"floor({n} / 2)"
    return f"(CASE WHEN {m1} IS NULL THEN {k1} ELSE {k2} END)", f"(CASE WHEN {m2} IS NULL THEN {k2} ELSE {k1} END)"


def _sketch(i: int, value: str, grid: int, accuracy: int) -> list[str]:
    """Number and ``grid`` + 1 quantiles of a metric's values."""
    # the shares as one literal: a plan holds it many times
    shares = f"CAST(split('{' '.join(str(j / grid) for j in range(grid + 1))}', ' ') AS ARRAY<DOUBLE>)"
    return [f"count({value}) AS in{i}", f"percentile_approx({value}, {shares}, {accuracy}) AS q{i}"]


def _pivots(i: int, ref: Callable[[str], str], grid: int) -> dict[str, str]:
    """Sketch values at the open ranks and a little outside them."""
    ranks = _open_ranks(i, ref(f"m1_{i}"), ref(f"m2_{i}"), ref(f"n{i}"))
    low, high = (f"least(floor(try_divide(({k} - {ref(f'below{i}')} + 0.5D) * {grid}, in{i})), {grid})" for k in ranks)
    places = (f"greatest({low} - 2, 0)", low, high, f"least({high} + 2, {grid})")
    return {f"p{j}_{i}": f"get(q{i}, CAST({place} AS INT))" for j, place in enumerate(places)}


def _found(i: int, ref: Callable[[str], str]) -> dict[str, str]:
    """Middle values that a pivot turned out to be."""
    n = ref(f"n{i}")
    return {f"m{r}_{i}": "coalesce(" + ", ".join([ref(f"m{r}_{i}"), *[
        f"CASE WHEN lt{j}_{i} <= {k} AND {k} < le{j}_{i} THEN {ref(f'p{j}_{i}')} END" for j in range(PIVOTS)]]) + ")"
        for r, k in ((1, f"floor(({n} - 1) / 2)"), (2, f"floor({n} / 2)"))}


def _bounds(i: int, ref: Callable[[str], str]) -> dict[str, str]:
    """The open interval between the pivots around the middle ranks not found."""
    low, high = _open_ranks(i, f"new_m1_{i}", f"new_m2_{i}", ref(f"n{i}"))

    def of(f: str, name: str, test: str, value: str) -> str:
        whens = [f"CASE WHEN {test.format(j=j)} THEN {ref(f'p{j}_{i}') if value == 'p' else f'le{j}_{i}'} END" for j in range(PIVOTS)]
        return f"{f}({ref(f'{name}{i}')}, {', '.join(whens)})"

    return {f"lo{i}": of("greatest", "lo", f"le{{j}}_{i} <= {low}", "p"), f"below{i}": of("greatest", "below", f"le{{j}}_{i} <= {low}", "le"),
            f"hi{i}": of("least", "hi", f"lt{{j}}_{i} > {high}", "p")}


def confusion(df: DataFrame, label: str = "label", pred: str = "pred", by: Iterable[str] = ()) -> DataFrame:
    """A2: true/false positive/negative counts in one pass."""
    lb, pr = F.col(label), F.col(pred)

    def cnt(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    return df.groupBy(*by).agg(cnt((lb == 1) & (pr == 1)).alias("pp"),
                               cnt((lb == 1) & (pr == 0)).alias("fn"),
                               cnt((lb == 0) & (pr == 1)).alias("fp"),
                               cnt((lb == 0) & (pr == 0)).alias("nn"))


def rates(counts: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """A3 + A4 from A2 counts; an empty class gives NULL, not an error."""
    pp, fn, fp, nn = (F.col(c).cast("double") for c in ("pp", "fn", "fp", "nn"))
    tp_n, tn_n, fn_n, fp_n, acc_n = RATE_NAMES
    return counts.select(*by,
                         F.try_divide(pp, pp + fn).alias(tp_n),
                         F.try_divide(nn, nn + fp).alias(tn_n),
                         F.try_divide(fn, fn + pp).alias(fn_n),
                         F.try_divide(fp, fp + nn).alias(fp_n),
                         F.try_divide(nn + pp, fp + fn + nn + pp).alias(acc_n))


def running_accuracy(df: DataFrame, pos: str = "pos", ok: str = "ok",
                     every: int = ACCURACY_EVERY, at: int = ACCURACY_AT,
                     block: int = 1 << 20) -> DataFrame:
    """Running count of correct rows and accuracy ``acc / (pos + 1)``,
    reported at rows where ``pos % every == at``. Block prefix sum: no
    single-task window over the whole table."""
    r = running_sum(df.select(pos, ok), pos, F.col(ok).cast("long"), "acc", block=block)
    return (r.filter(F.col(pos) % every == at)
            .select(F.col(pos), F.col("acc"), (F.col("acc") / (F.col(pos) + 1)).alias("accuracy")))


def eval_cap(valid: DataFrame, pos: str = "pos", cap: int = EVAL_CAP, probe: int = 1000) -> DataFrame:
    """L1: valid rows up to position ``cap``, plus the first valid row after
    it (the reference breaks only after appending a row past the cap).

    The first valid row after the cap is looked for in the next ``probe``
    positions first (one small job); only if none is valid there is the
    search extended to every later row, so the result is always exact while
    rows far past the cap are normally never evaluated."""
    head = valid.filter(F.col(pos) <= cap)
    near = valid.filter((F.col(pos) > cap) & (F.col(pos) <= cap + probe)).orderBy(pos).limit(1)
    if near.isEmpty():
        near = valid.filter(F.col(pos) > cap + probe).orderBy(pos).limit(1)
    return head.unionByName(near)


def epoch_loss(log: DataFrame) -> DataFrame:
    """A5: mean loss and step count per (run, epoch)."""
    return log.groupBy("run", "epoch").agg(F.avg("loss").alias("mean_loss"),
                                           F.count(F.lit(1)).alias("steps"))


def top_k_runs(log: DataFrame, k: int = TOP_K_RUNS) -> DataFrame:
    """L2: the ``k`` saved artifacts with the lowest mean training loss (ties
    by name). A top-k: each partition keeps k rows before the merge."""
    per = log.groupBy(F.col("artifact").alias("name")).agg(F.avg("loss").alias("train_loss"))
    return per.orderBy(F.col("train_loss").asc(), F.col("name").asc()).limit(k)


def latest_artifact(log: DataFrame, exclude_partial: bool = True) -> DataFrame:
    """Per run, the lexicographically largest artifact name that starts
    with ``run-`` (and, by default, is not a partial ``.part`` save)."""
    a = F.col("artifact")
    ok = a.startswith(F.concat(F.col("run"), F.lit("-")))
    if exclude_partial:
        ok = ok & ~a.endswith(".part")
    return log.filter(ok).groupBy("run").agg(F.max(a).alias("latest"))


def batch_rows(df: DataFrame, pos: str = "pos", size: int = 4, cols: list[str] | None = None) -> DataFrame:
    """Consecutive rows in batches of ``size`` (last one partial); each
    batch holds its rows in position order. Groups are bounded by ``size``."""
    cols = cols or [c for c in df.columns if c != pos]
    return (df.withColumn("batch_id", F.floor(F.col(pos) / size))
            .groupBy("batch_id")
            .agg(F.sort_array(F.collect_list(F.struct(pos, *cols))).alias("rows")))
