"""Expressions of the panel engine as SQL text, for Spark and for the DuckDB side of the comparison.

The panel has a row for each (``ts_code``, ``pos``); ``pos`` counts trading days, so range frames on it are exact when
a stock has no row on some day. All helpers give NULL, never NaN, infinity or an error, where a value is undefined.
"""

from __future__ import annotations


class Sql:
    """Builds expressions; ``duck`` chooses DuckDB's names."""

    def __init__(self, duck: bool = False):
        self.duck = duck

    # -- frames ---------------------------------------------------------------------------------

    def over(self, agg: str, k: int, to: int = 0) -> str:
        """An aggregate over the days t-k .. t-to of a stock."""
        end = "CURRENT ROW" if to == 0 else f"{to} PRECEDING"
        return f"{agg} OVER (PARTITION BY ts_code ORDER BY pos RANGE BETWEEN {k} PRECEDING AND {end})"

    def lag(self, x: str, k: int) -> str:
        """The value exactly k trading days ago."""
        return self.over(f"first({x})", k, k)

    def lead(self, x: str, k: int) -> str:
        return f"first({x}) OVER (PARTITION BY ts_code ORDER BY pos RANGE BETWEEN {k} FOLLOWING AND {k} FOLLOWING)"

    def day(self, agg: str) -> str:
        """An aggregate over the cross-section of a day."""
        return f"{agg} OVER (PARTITION BY pos)"

    # -- scalars --------------------------------------------------------------------------------

    def div(self, a: str, b: str) -> str:
        return f"(CAST({a} AS DOUBLE) / nullif({b}, 0))"

    def pos_ln(self, x: str) -> str:
        return f"CASE WHEN ({x}) > 0 THEN ln({x}) END"

    def nz(self, *xs: str) -> str:
        """Sum with NULL as zero."""
        return "(" + " + ".join(f"coalesce({x}, 0)" for x in xs) + ")"

    def any_sum(self, *xs: str) -> str:
        """Sum of the values that are there; NULL if none is."""
        return f"CASE WHEN coalesce({', '.join(xs)}) IS NOT NULL THEN {self.nz(*xs)} END"

    def struct(self, **kw: str) -> str:
        if self.duck:
            return "struct_pack(" + ", ".join(f"{k} := {v}" for k, v in kw.items()) + ")"
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in kw.items()) + ")"

    def week(self, day: str) -> str:
        """The number of a date's week, Monday to Sunday."""
        days = f"date_diff('day', DATE '1970-01-05', {day})" if self.duck else f"datediff({day}, DATE '1970-01-05')"
        return f"CAST(floor({days} / 7e0) AS BIGINT)"

    # -- windows over time ----------------------------------------------------------------------

    def quantile(self, x: str, p: float, k: int) -> str:
        return self.over(f"{'quantile_cont' if self.duck else 'percentile'}({x}, {p})", k)

    def first_max(self, x: str, k: int) -> str:
        """``pos`` of the first maximum."""
        return f"(-(({self.over(f'max(CASE WHEN {x} IS NOT NULL THEN {self.struct(a=x, b="-pos")} END)', k)}).b))"

    def first_min(self, x: str, k: int) -> str:
        return f"(({self.over(f'min(CASE WHEN {x} IS NOT NULL THEN {self.struct(a=x, b="pos")} END)', k)}).b)"

    def values(self, x: str, k: int, to: int = 0) -> str:
        """The window's values as an array, without NULLs."""
        return self.over(f"list({x}) FILTER (WHERE {x} IS NOT NULL)" if self.duck else f"collect_list({x})", k, to)

    def pct_rank(self, x: str, k: int) -> str:
        """Rank of today's value, ties averaged, over the count."""
        h = self.values(x, k)
        if self.duck:
            less, same, n = f"len(list_filter({h}, lambda e: e < {x}))", f"len(list_filter({h}, lambda e: e = {x}))", f"len({h})"
        else:
            less, same, n = f"size(filter({h}, e -> e < {x}))", f"size(filter({h}, e -> e = {x}))", f"size({h})"
        return f"CASE WHEN {x} IS NOT NULL THEN {self.div(f'{less} + ({same} + 1) / 2.0', n)} END"

    def top_mean(self, x: str, n: int, k: int) -> str:
        """Mean of the n largest values; NULL if there are fewer."""
        h = self.values(x, k)
        if self.duck:
            top = f"list_sum(list_reverse_sort({h})[1:{n}])"
            return f"CASE WHEN len({h}) >= {n} THEN {top} / {n} END"
        top = f"aggregate(slice(sort_array({h}, false), 1, {n}), 0D, (a, e) -> a + e)"
        return f"CASE WHEN size({h}) >= {n} THEN {top} / {n} END"

    def regr(self, what: str, y: str, x: str, k: int, to: int = 0) -> str:
        """``regr_slope`` and the like; NULL with fewer than two pairs."""
        pairs = self.over(f"count(CASE WHEN ({y}) IS NOT NULL AND ({x}) IS NOT NULL THEN 1 END)", k, to)
        return f"CASE WHEN {pairs} >= 2 THEN {self.over(f'regr_{what}({y}, {x})', k, to)} END"

    def corr(self, a: str, b: str, k: int, least: int = 2) -> str:
        """Correlation of pairs; NULL where a side does not vary."""
        both = f"({a}) IS NOT NULL AND ({b}) IS NOT NULL"
        x, y = f"CASE WHEN {both} THEN {a} END", f"CASE WHEN {both} THEN {b} END"
        sx, sy = self.over(f"stddev_samp({x})", k), self.over(f"stddev_samp({y})", k)
        n = self.over(f"count({x})", k)
        return f"CASE WHEN {n} >= {least} AND {sx} > 1e-10 AND {sy} > 1e-10 THEN {self.over(f'covar_samp({x}, {y})', k)} / ({sx} * {sy}) END"

    # -- exponential windows ---------------------------------------------------------------------
    # Days are cut into blocks of n. A window of n days is the running sum of its own block and what the block before has after the day
    # n days ago, so every sum costs one pass, whatever n. Weights count from the start of a block: they stay between 1 and 2 ** (n / half-life).

    def ewm(self, tag: str, sums: dict[str, str], n: int, hl: float) -> list[dict[str, str]]:
        """Layers with ``<tag>_<k>`` for each of ``sums``: its exponentially weighted sum over n days, today having weight 1 (0 without a value), and
        ``<tag>_n``, the count of days on which the first one is there."""
        w, b, first = f"{tag}w", f"{tag}b", next(iter(sums.values()))
        block = {b: f"CAST((pos - pos % {n}) / {n} AS BIGINT)", w: f"power(2.0, pos % {n} / {float(hl)})"}
        terms = {k: f"({x}) * {w}" for k, x in sums.items()}
        aggs = {k: f"sum({x})" for k, x in terms.items()} | {"n": f"count({first})"}
        run = {f"{tag}p_{k}": f"coalesce({x} OVER (PARTITION BY ts_code, {b} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)" for k, x in aggs.items()}
        before = {f"{tag}t_{k}": f"coalesce({x} OVER (PARTITION BY ts_code ORDER BY {b} RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0)" for k, x in aggs.items()}
        then = self.struct(b=b, **{k: f"{tag}p_{k}" for k in aggs})
        left = {f"{tag}l": f"last({then}) OVER (PARTITION BY ts_code ORDER BY pos RANGE BETWEEN UNBOUNDED PRECEDING AND {n} PRECEDING)"}
        past = {k: f"({tag}t_{k} - CASE WHEN {tag}l.b = {b} - 1 THEN {tag}l.{k} ELSE 0 END)" for k in aggs}
        out = {f"{tag}_{k}": f"({tag}p_{k} + {past[k]} * {0.5 ** (n / hl)!r}) / {w}" for k in sums} | {f"{tag}_n": f"{tag}p_n + {past['n']}"}
        return [block, run | before, left, out]

    def ewm_sum(self, tag: str, x: str, n: int, hl: float, least: int) -> tuple[list[dict[str, str]], str]:
        """Exponentially weighted sum over n days with weights that sum to one over the full window: layers, and the expression."""
        norm = sum(0.5 ** (i / hl) for i in range(n))
        return self.ewm(tag, {"x": x}, n, hl), f"CASE WHEN {tag}_n >= {least} THEN {tag}_x / {norm!r} END"

    def ewm_std(self, tag: str, x: str, n: int, hl: float, least: int) -> tuple[list[dict[str, str]], str]:
        layers = self.ewm(tag, {"w": f"CASE WHEN ({x}) IS NOT NULL THEN 1.0 END", "x": x, "xx": f"({x}) * ({x})"}, n, hl)
        return layers, f"CASE WHEN {tag}_n >= {least} THEN sqrt(greatest(0.0, {tag}_xx / {tag}_w - ({tag}_x / {tag}_w) * ({tag}_x / {tag}_w))) END"

    def ewm_wls(self, tag: str, y: str, x: str, n: int, hl: float, least: int) -> tuple[list[dict[str, str]], dict[str, str]]:
        """Exponentially weighted regression of y on x: layers of its six moments, and expressions for ``beta``, ``alpha`` and the residuals' ``sigma``."""
        both = f"({y}) IS NOT NULL AND ({x}) IS NOT NULL"
        moments = {"w": "1.0", "x": x, "y": y, "xx": f"({x}) * ({x})", "yy": f"({y}) * ({y})", "xy": f"({x}) * ({y})"}
        layers = self.ewm(tag, {k: f"CASE WHEN {both} THEN {v} END" for k, v in moments.items()}, n, hl)
        mean = {f"{tag}m{k}": f"{tag}_{k} / nullif({tag}_w, 0)" for k in ("x", "y", "xx", "yy", "xy")}
        spread = {f"{tag}v{k}": f"{tag}m{k} - {tag}m{k[0]} * {tag}m{k[1]}" for k in ("xx", "yy", "xy")}
        ok = f"{tag}_n >= {least} AND {tag}vxx > 1e-12"
        return [*layers, mean, spread], {
            "beta": f"CASE WHEN {ok} THEN {tag}vxy / {tag}vxx END",
            "alpha": f"CASE WHEN {ok} THEN {tag}my - {tag}vxy / {tag}vxx * {tag}mx END",
            "sigma": f"CASE WHEN {ok} THEN sqrt(greatest(0.0, {tag}vyy - {tag}vxy * {tag}vxy / {tag}vxx)) END",
        }

    # -- cross-section --------------------------------------------------------------------------

    def median(self, x: str) -> str:
        return self.day(f"{'quantile_cont' if self.duck else 'percentile'}({x}, 0.5)")


def standardise(e: Sql, xs: list[str], cap: str, width: float = 3.0) -> list[dict[str, str]]:
    """Layers that turn columns ``xs`` into ``z_<x>``: clipped at ``width`` robust deviations from the median, centred by cap
    weight, scaled to unit equal-weight root mean square. Rows without a valid cap are scored but take no part in the estimates."""
    ok = f"{cap} > 0"
    med = {f"m_{x}": e.median(f"CASE WHEN {ok} THEN {x} END") for x in xs}
    mad = {f"d_{x}": e.median(f"CASE WHEN {ok} THEN abs({x} - m_{x}) END") for x in xs}
    w = f"{width * 1.4826!r}"
    clip = {f"c_{x}": f"CASE WHEN d_{x} > 0 AND {x} IS NOT NULL THEN least(greatest({x}, m_{x} - {w} * d_{x}), m_{x} + {w} * d_{x}) ELSE {x} END" for x in xs}
    mean = {f"e_{x}": f"c_{x} - " + e.div(e.day(f"sum(CASE WHEN {ok} THEN c_{x} * {cap} END)"), e.day(f"sum(CASE WHEN {ok} AND c_{x} IS NOT NULL THEN {cap} END)")) for x in xs}
    scale = {f"s_{x}": f"CASE WHEN {e.day(f'count(CASE WHEN {ok} THEN e_{x} END)')} >= 2 THEN sqrt({e.day(f'avg(CASE WHEN {ok} THEN e_{x} * e_{x} END)')}) END" for x in xs}
    z = {f"z_{x}": f"CASE WHEN s_{x} > 1e-10 THEN e_{x} / s_{x} END" for x in xs}
    return [med, mad, clip, mean, scale, z]


def combine(e: Sql, xs: list[str], cap: str) -> list[dict[str, str]]:
    """Standardises each of ``xs``, takes the mean where all are valid, and standardises that into ``value``."""
    mean = {"comb": "(" + " + ".join(f"z_{x}" for x in xs) + f") / {float(len(xs))}"}
    return [*standardise(e, xs, cap), mean, *standardise(e, ["comb"], cap), {"value": "z_comb"}]
