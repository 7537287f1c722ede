"""Least-squares curve fits for every group of a table at once.

Points are first reduced to one row per (group, x): count, mean and inner variation of y, which is all that
a least-squares fit can see. A group whose x are few (calendar periods, say) then becomes one row with its points as an array,
and the damped Newton solver runs inside an expression over that row: all groups, all passes, one aggregation. For a group with more x than
one row should hold, each pass is a grouped aggregation of gradient and curvature sums; lineage is cut every few passes with a reliable
checkpoint. Both forms are built from the same expressions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthstat.session import cut_lineage

_EPSILON = 1e-4
_PART_ROWS = 4_096


@dataclass(frozen=True)
class Solver:
    """Limits of the solver. ``tolerance`` is the largest relative parameter step at the end.

    A group of at most ``row_points`` distinct x is solved within one row. Of larger ones lineage is cut, and the open ones are counted, every
    ``passes_per_check`` passes.
    """

    passes: int = 120
    passes_per_check: int = 4
    tolerance: float = 1e-9
    first_damping: float = 1e-3
    row_points: int = _PART_ROWS


def _determinant(m: Sequence[Sequence[str]]) -> str:
    if len(m) == 2:
        return f"({m[0][0]} * {m[1][1]} - {m[0][1]} * {m[1][0]})"
    minors = [_determinant([[row[c] for c in range(3) if c != j] for row in m[1:]]) for j in range(3)]
    return f"({m[0][0]} * {minors[0]} - {m[0][1]} * {minors[1]} + {m[0][2]} * {minors[2]})"


def solve_linear(matrix: Sequence[Sequence[str]], right: Sequence[str]) -> list[str]:
    """Solution of a 2x2 or 3x3 system of SQL expressions (Cramer's rule); NULL where it is singular."""
    whole = _determinant(matrix)
    out = []
    for j in range(len(right)):
        replaced = [[right[i] if c == j else row[c] for c in range(len(row))] for i, row in enumerate(matrix)]
        out.append(f"try_divide({_determinant(replaced)}, {whole})")
    return out


def _inside_unit(share: str) -> str:
    return f"greatest(least({share}, {1 - _EPSILON}D), {_EPSILON}D)"


def logit_line(points: DataFrame, by: Sequence[str], x: str, y: str, asymptote: float) -> DataFrame:
    """Closed-form logistic fit on the logit scale: a straight line through ``ln(y / (L - y))``.

    y is kept inside ``(eps L, (1 - eps) L)`` so that 0 and L have a logit; ``clamped`` counts the points that were moved.
    Columns: by, k, x0, points, clamped.
    """
    rows = points.dropna(how="any", subset=[*by, x, y]).select(
        *by, F.col(x).cast("double").alias("_x"), F.expr(f"`{y}` / {float(asymptote)}D").alias("_raw")
    ).withColumn("_share", F.expr(_inside_unit("_raw")))
    line = rows.groupBy(*by).agg(
        F.expr("regr_slope(ln(_share / (1 - _share)), _x)").alias("k"),
        F.expr("regr_intercept(ln(_share / (1 - _share)), _x)").alias("_intercept"),
        F.count(F.lit(1)).alias("points"),
        F.expr("count_if(_share <> _raw)").alias("clamped"),
    )
    return line.select(*by, "k", F.expr("try_divide(-_intercept, k)").alias("x0"), "points", "clamped")


def _scaled_points(
    points: DataFrame, by: Sequence[str], x: str, y: str, asymptote: float | str | None, part_rows: int
) -> DataFrame:
    """One row per (group, x) with x moved to [-1, 1] and y divided by its scale; scales ride along.

    A group with many x is cut into parts, so that no pass runs it in a single task.
    """
    known = F.col(asymptote) if isinstance(asymptote, str) else F.lit(asymptote)
    per_x = (
        points.dropna(how="any", subset=[*by, x, y])
        .groupBy(*by, F.col(x).cast("double").alias("_x"))
        .agg(
            F.count(F.lit(1)).cast("double").alias("_n"),
            F.avg(y).alias("_y"),
            (F.var_pop(y) * F.count(F.lit(1))).alias("_inner"),
            F.max(known.cast("double")).alias("_known"),
        )
    )
    per_group = per_x.groupBy(*by).agg(
        F.expr("(min(_x) + max(_x)) / 2").alias("_center"),
        F.expr("(max(_x) - min(_x)) / 2").alias("_half"),
        F.max("_y" if asymptote is None else "_known").alias("_top"),
        F.expr(f"CAST(ceil(count(*) / {part_rows}) AS INT)").alias("_parts"),
    )
    # one row per group on the right; adaptive execution splits a group that is too large for a task
    return per_x.join(per_group, list(by)).selectExpr(
        *by,
        "_parts",
        "CAST(pmod(xxhash64(_x), _parts) AS INT) AS _part",
        "_n",
        "try_divide(_x - _center, _half) AS _u",
        "try_divide(_y, _top) AS _v",
        "try_divide(_inner, _top * _top) AS _inner",
        "_center",
        "_half",
        "_top",
    )


class _State:
    """Column names of the per-group solver state."""

    scales = ["_center", "_half", "_top", "_points", "_inner", "_parts"]
    control = ["_sse", "_damping", "_passes"]

    def __init__(self, free: bool):
        self.free = free
        self.params = ["slope", "shift"] + (["height"] if free else [])
        self.size = len(self.params)
        self.pairs = [(i, j) for i in range(self.size) for j in range(i, self.size)]
        self.sums = [
            *[f"_a_{i}{j}" for i, j in self.pairs],
            *[f"_c_{i}{j}" for i, j in self.pairs],
            *[f"_g_{i}" for i in range(self.size)],
        ]

    @property
    def carried(self) -> list[str]:
        params = [f"{kind}{p}" for kind in ("_p_", "_t_") for p in self.params]
        return [*params, *self.sums, *self.scales, *self.control]

    def matrix(self, prefix: str, size: int | None = None) -> list[list[str]]:
        size = size or self.size
        return [[f"{prefix}{min(i, j)}{max(i, j)}" for j in range(size)] for i in range(size)]


def _first_state(scaled: DataFrame, by: Sequence[str], state: _State, solver: Solver, listed: bool = False) -> DataFrame:
    """Start from the weighted logit line; a free height starts a little above the data. ``listed`` adds the points as an array."""
    points = [F.sort_array(F.collect_list(F.struct("_u", "_n", "_v"))).alias("_list")] if listed else []
    height = 1.1 if state.free else 1.0
    weighted = scaled.withColumn("_share", F.expr(_inside_unit(f"_v / {height}D"))).withColumns({
        "_z": F.expr("ln(_share / (1 - _share))"),
        "_w": F.expr("_n * pow(_share * (1 - _share), 2)"),
    })
    sums = weighted.groupBy(*by).agg(
        F.expr("sum(_w)").alias("_m0"),
        F.expr("sum(_w * _u)").alias("_m1"),
        F.expr("sum(_w * _u * _u)").alias("_m2"),
        F.expr("sum(_w * _z)").alias("_b0"),
        F.expr("sum(_w * _u * _z)").alias("_b1"),
        F.sum("_n").alias("_points"),
        F.sum("_inner").alias("_inner"),
        *[F.max(name).alias(name) for name in ("_center", "_half", "_top", "_parts")],
        *points,
    )
    slope, shift = solve_linear([["_m2", "_m1"], ["_m1", "_m0"]], ["_b1", "_b0"])
    start = {"slope": slope, "shift": shift, "height": f"{height}D"}
    return sums.selectExpr(
        *by,
        *[f"{start[p]} AS _p_{p}" for p in state.params],
        *[f"{start[p]} AS _t_{p}" for p in state.params],
        *[f"0D AS {name}" for name in state.sums],
        *state.scales,
        "double('infinity') AS _sse",
        f"{solver.first_damping}D AS _damping",
        "0 AS _passes",
        f"{slope} IS NULL AS _done",
        *(["_list"] if listed else []),
    )


class _Pass:
    """Expressions of one pass, in stages: each names columns made from those of the stage before.

    Per point: ``curve`` and ``slopes``, then ``sums`` over the points. Per group: evaluate the trial parameters, keep or refuse
    them, propose the next ones.
    """

    def __init__(self, state: _State, solver: Solver):
        size, pairs, params = state.size, state.pairs, state.params
        # The curve height * s(z) with z = slope * u + shift, and its first and second derivatives.
        height = "_t_height" if state.free else "1D"
        first = [f"{height} * _s1 * _u", f"{height} * _s1", "_s"][:size]
        second = {
            (0, 0): f"{height} * _s2 * _u * _u", (0, 1): f"{height} * _s2 * _u", (1, 1): f"{height} * _s2",
            (0, 2): "_s1 * _u", (1, 2): "_s1", (2, 2): "0D",
        }
        self.curve = {"_s": "1 / (1 + exp(-(_t_slope * _u + _t_shift)))"}
        self.slopes = {"_s1": "_s * (1 - _s)", "_s2": "_s * (1 - _s) * (1 - 2 * _s)", "_r": f"_v - {height} * _s"}
        self.sums = {
            "_new_sse": "_n * _r * _r",
            **{f"_new_a_{i}{j}": f"_n * {first[i]} * {first[j]}" for i, j in pairs},
            **{f"_new_c_{i}{j}": f"_n * _r * {second[i, j]}" for i, j in pairs},
            **{f"_new_g_{i}": f"_n * {first[i]} * _r" for i in range(size)},
        }
        better = "coalesce(_new_sse <= _sse, false) AND NOT _done"
        kept = {
            **{f"_tried_{p}": f"_t_{p}" for p in params},
            **{f"_p_{p}": f"if({better}, _t_{p}, _p_{p})" for p in params},
            **{name: f"if({better}, _new{name}, {name})" for name in state.sums},
            "_sse": f"if({better}, _new_sse, _sse)",
            "_damping": f"if({better}, greatest(_damping / 20, 1e-12D), least(_damping * 5, 1e12D))",
            "_passes": "_passes + if(_done, 0, 1)",
            "_done": "_done",
        }
        # Newton matrix where it is positive definite, else its Gauss-Newton part alone; damped on the diagonal.
        newton = {f"_f_{i}{j}": f"_a_{i}{j} - _c_{i}{j}" for i, j in pairs}
        minors = ["_f_00", _determinant(state.matrix("_f_", 2))] + ([_determinant(state.matrix("_f_"))] if state.free else [])
        judged = {"_convex": " AND ".join(f"{minor} > 0" for minor in minors)}
        damped = {
            f"_h_{i}{j}": f"if(_convex, _f_{i}{j}, _a_{i}{j})" + (f" + _damping * _a_{i}{j}" if i == j else "")
            for i, j in pairs
        }
        step = solve_linear(state.matrix("_h_"), [f"_g_{i}" for i in range(size)])
        stepped = {f"_d_{p}": step[i] for i, p in enumerate(params)}
        movement = f"greatest({', '.join(f'abs(_d_{p}) / (abs(_p_{p}) + 1e-3D)' for p in params)})"
        proposed = {
            **{f"_p_{p}": f"_p_{p}" for p in params},
            **{f"_t_{p}": f"if(_done, _tried_{p}, _p_{p} + _d_{p})" for p in params},
            **{name: name for name in (*state.sums, *state.control)},
            "_done": f"_done OR coalesce({movement} < {solver.tolerance}D, true)",
        }
        #: Stages of a group's row; those marked True add columns, the others replace them.
        self.stages = [(kept, False), (newton, True), (judged, True), (damped, True), (stepped, True), (proposed, False)]


def _pass_text(by: Sequence[str], state: _State, one: _Pass) -> str:
    """SQL of one pass over ``{scaled}`` and ``{current}`` for all groups, with the points of a group in many rows."""

    def names(columns: dict[str, str]) -> str:
        return ", ".join(f"{text} AS {name}" for name, text in columns.items())

    key = [f"`{name}`" for name in by]
    on_key = ", ".join([*key, "_part"])
    ride = ", ".join([*key, *state.scales])
    sums = names({name: f"sum({text})" for name, text in one.sums.items()} | {name: f"max({name})" for name in (*state.carried, "_done")})
    text = f"""
WITH parts AS (SELECT *, explode(sequence(0, _parts - 1)) AS _part FROM {{current}}),
points AS (SELECT {on_key}, _n, _u, _v FROM {{scaled}}),
curve AS (SELECT *, {names(one.curve)} FROM points JOIN parts USING ({on_key})),
slopes AS (SELECT *, {names(one.slopes)} FROM curve),
stage0 AS (SELECT {', '.join(key)}, {sums} FROM slopes GROUP BY {', '.join(key)})"""
    for i, (columns, adds) in enumerate(one.stages):
        text += f",\nstage{i + 1} AS (SELECT {'*' if adds else ride}, {names(columns)} FROM stage{i})"
    return f"{text}\nSELECT * FROM stage{len(one.stages)}"


def _bound(text: str, owners: Sequence[tuple[str, set[str] | None]]) -> str:
    """The expression with each name read from the first variable that owns it; an owner of None has all names."""

    def owned(m: re.Match) -> str:
        return next(f"{variable}.{m[0]}" for variable, names in owners if names is None or m[0] in names)

    return re.sub(r"\b_[a-z]\w*", owned, text)


def _struct(columns: dict[str, str]) -> str:
    return f"named_struct({', '.join(f"'{name}', {text}" for name, text in columns.items())})"


def _solved_text(state: _State, one: _Pass, passes: int) -> str:
    """Expression of the state after all passes, over a row with its first state in columns and its points in ``_list``."""
    point = ["_n", "_u", "_v"]
    on_curve = [*point, *one.curve]
    on_slopes = [*on_curve, *one.slopes]

    def per_point(variable: str, old: list[str], new: dict[str, str]) -> str:
        owners = [(variable, set(old)), ("s", None)]
        return _struct({name: f"{variable}.{name}" for name in old} | {name: _bound(text, owners) for name, text in new.items()})

    curve = f"transform(_list, p -> {per_point('p', point, one.curve)})"
    slopes = f"transform({curve}, q -> {per_point('q', on_curve, one.slopes)})"
    zero = _struct(dict.fromkeys(one.sums, "0D"))
    added = _struct({name: f"t.{name} + {_bound(text, [('r', set(on_slopes)), ('s', None)])}" for name, text in one.sums.items()})
    fresh = f"aggregate({slopes}, {zero}, (t, r) -> {added})"

    # each stage binds the row of the stage before to a variable: a one-element array stands for the binding
    held = [name for name in (*state.carried, "_done") if name not in state.scales]
    row = _struct({name: f"f.{name}" for name in one.sums} | {name: f"s.{name}" for name in held})
    body = f"element_at(transform(array({fresh}), f -> {row}), 1)"
    names = [*one.sums, *held]
    for i, (columns, adds) in enumerate(one.stages):
        variable = f"v{i}"
        made = {name: _bound(text, [(variable, None)]) for name, text in columns.items()}
        if adds:
            made = {name: f"{variable}.{name}" for name in names} | made
        body, names = f"element_at(transform(array({body}), {variable} -> {_struct(made)}), 1)", list(made)
    start = _struct({name: name for name in names})
    return f"aggregate(sequence(1, {passes}), {start}, (s, i) -> if(s._done, s, {body}))"


def fit_logistic(
    points: DataFrame,
    by: Sequence[str],
    x: str,
    y: str,
    asymptote: float | str | None = None,
    solver: Solver = Solver(),
) -> DataFrame:
    """Logistic least-squares fit per group.

    ``asymptote`` is a number, the name of a column that is constant within a group, or None to fit it as a
    third parameter.

    Columns: by columns, L, k, x0, sse, points, passes, converged. A group whose points do not determine a
    curve, or that is still open after the last pass, gets NULL parameters and ``converged = false``; nothing raises.
    """
    if not by:
        points, by = points.withColumn("series", F.lit("all")), ["series"]
    state = _State(free=asymptote is None)
    one = _Pass(state, solver)
    scaled = cut_lineage(_scaled_points(points, by, x, y, asymptote, solver.row_points))
    solved = _within_rows(scaled.where("_parts = 1"), by, state, one, solver)
    large = scaled.where("_parts > 1")
    if not large.isEmpty():
        solved = solved.unionByName(_over_rows(large, by, state, one, solver))
    return _readable(solved, by, state)


def _within_rows(scaled: DataFrame, by: Sequence[str], state: _State, one: _Pass, solver: Solver) -> DataFrame:
    """Last state of groups of one part: a group is a row, and an expression runs all passes over it."""
    first = _first_state(scaled, by, state, solver, listed=True)
    solved = first.withColumn("_solved", F.expr(_solved_text(state, one, solver.passes)))
    return solved.select(*by, *state.scales, "_solved.*")


def _over_rows(scaled: DataFrame, by: Sequence[str], state: _State, one: _Pass, solver: Solver) -> DataFrame:
    """Last state of groups of several parts: a pass is an aggregation over their rows. Finished groups ride along unchanged."""
    current = _first_state(scaled, by, state, solver)
    text, used = _pass_text(by, state, one), 0
    while used < solver.passes:
        batch = min(solver.passes_per_check, solver.passes - used)
        for _ in range(batch):
            current = scaled.sparkSession.sql(text, scaled=scaled, current=current)
        current, used = cut_lineage(current), used + batch
        if current.where("NOT _done").isEmpty():
            break
    return current


def _readable(current: DataFrame, by: Sequence[str], state: _State) -> DataFrame:
    height = "_p_height" if state.free else "1D"
    fitted = "_p_slope IS NOT NULL AND coalesce(_sse < double('infinity'), false)"
    return current.selectExpr(
        *by,
        f"if(_done AND _p_slope IS NOT NULL, {height} * _top, NULL) AS L",
        "if(_done, try_divide(_p_slope, _half), NULL) AS k",
        "if(_done, _center - try_divide(_p_shift * _half, _p_slope), NULL) AS x0",
        f"if(_done AND {fitted}, (_sse + _inner) * _top * _top, NULL) AS sse",
        "CAST(_points AS BIGINT) AS points",
        "_passes AS passes",
        f"_done AND {fitted} AS converged",
    )


def fit_quadratic(points: DataFrame, by: Sequence[str], x: str, y: str, origin: float) -> DataFrame:
    """Least-squares parabola ``c0 + c1 t + c2 t^2`` in ``t = x - origin`` per group, from power sums in one pass.

    Choose the origin near the middle of the data. A group with fewer than three distinct x gets NULL.
    """
    rows = points.dropna(how="any", subset=[*by, x, y]).select(
        *by, (F.col(x).cast("double") - float(origin)).alias("_t"), F.col(y).cast("double").alias("_v")
    )
    powers = ["1D", "_t", "_t * _t", "_t * _t * _t", "_t * _t * _t * _t"]
    sums = rows.groupBy(*by).agg(
        *[F.expr(f"sum({p})").alias(f"_s{i}") for i, p in enumerate(powers)],
        *[F.expr(f"sum(_v * {p})").alias(f"_m{i}") for i, p in enumerate(powers[:3])],
        F.count(F.lit(1)).alias("points"),
    )
    solution = solve_linear([[f"_s{i + j}" for j in range(3)] for i in range(3)], ["_m0", "_m1", "_m2"])
    return sums.selectExpr(*by, *[f"{c} AS c{i}" for i, c in enumerate(solution)], "points")


def quadratic(x: str, origin: float, c0: str = "c0", c1: str = "c1", c2: str = "c2") -> Column:
    """Value of the fitted parabola."""
    t = F.col(x).cast("double") - float(origin)
    return F.col(c0) + F.col(c1) * t + F.col(c2) * t * t
