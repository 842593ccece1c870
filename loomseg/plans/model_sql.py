"""DuckDB SQL of hidden Markov models with fixed parameters, for any number of states: what the engine's recursions are compared with.

`regions` has region, chrom, bin, s, e, scale and the observed columns; each function returns CTEs that follow it.
"""

from __future__ import annotations

END = 1e-10


def _list(f, n: int, sep: str = ", ") -> str:
    return sep.join(f(i) for i in range(n))


def recursions(lls: list[str], trans: list[list[float]]) -> str:
    """obs (with t, len and l0...), f (forward), g (backward), post (p0...), xi (x00..., the transition posteriors; 0 at a region's first bin)."""
    n = len(lls)
    top = f"greatest({_list(lambda i: f'l{i}', n)})"
    e = lambda i: f"exp(l{i} - {top})"
    total = lambda v: "(" + _list(lambda i: f"{v}{i}", n, " + ") + ")"
    step = lambda i: "(" + _list(lambda j: f"a{j} * {trans[j][i]!r}", n, " + ") + ")"
    back = lambda i: "(" + _list(lambda j: f"{trans[i][j]!r} * {e(j)} * b{j}", n, " + ") + ")"
    both = total("z")
    x = lambda i, j: f"q{i} * {trans[i][j]!r} * y{j}"
    mass = " + ".join(x(i, j) for i in range(n) for j in range(n))
    return f"""obs AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY bin) AS t, count(*) OVER (PARTITION BY region) AS len, {_list(lambda i: f"{lls[i]} AS l{i}", n)} FROM regions),
f AS (SELECT region, t, len, {_list(lambda i: f"{e(i)} / {n}.0 AS a{i}", n)}, {top} AS c FROM obs WHERE t = 1 UNION ALL
  SELECT o.region, o.t, o.len, {_list(lambda i: f"{step(i)} / {total('a')} * {e(i)}", n)}, f.c + ln({total('a')}) + {top} FROM f JOIN obs o ON o.region = f.region AND o.t = f.t + 1),
g AS (SELECT region, t, {_list(lambda i: f"(1.0 / {n})::DOUBLE AS b{i}", n)} FROM obs WHERE t = len UNION ALL
  SELECT region, t - 1, {_list(lambda i: f"z{i} / {both}", n)} FROM (SELECT g.region, g.t, {_list(lambda i: f"{back(i)} AS z{i}", n)} FROM g JOIN obs o ON o.region = g.region AND o.t = g.t WHERE g.t > 1) w),
post AS (SELECT o.*, {_list(lambda i: f"a{i} * b{i} / ({_list(lambda j: f'a{j} * b{j}', n, ' + ')}) AS p{i}", n)} FROM obs o JOIN f USING (region, t) JOIN g USING (region, t)),
xq AS (SELECT o.region, o.t, {_list(lambda i: f"lag(a{i} / {total('a')}) OVER w AS q{i}", n)}, {_list(lambda i: f"{e(i)} * b{i} AS y{i}", n)} FROM obs o JOIN f USING (region, t) JOIN g USING (region, t) WINDOW w AS (PARTITION BY o.region ORDER BY o.t)),
xi AS (SELECT region, t, {", ".join(f"coalesce({x(i, j)} / ({mass}), 0) AS x{i}{j}" for i in range(n) for j in range(n))} FROM xq)"""


def likelihood() -> str:
    """An expression over f's last rows: the log-likelihood of all regions, with the end probabilities."""
    return "sum(c + ln(a0 + a1) + ln(1e-10))"


def decoded(trans: list[list[float]]) -> str:
    """dec: obs with the likeliest state; ties go to the last of two states, and to the first of three."""
    n = len(trans)
    came = lambda i, j: f"v.v{j} + ln({trans[j][i]!r})"
    order = range(n - 1, -1, -1) if n == 2 else range(n)

    def pick(value) -> str:
        most = f"greatest({_list(value, n)})"
        return "CASE " + " ".join(f"WHEN {value(j)} = {most} THEN {j}" for j in order) + " END"

    return f"""v AS (SELECT region, t, len, {_list(lambda i: f"ln(1.0 / {n}) + l{i} AS v{i}", n)}, {_list(lambda i: f"-1 AS k{i}", n)} FROM obs WHERE t = 1 UNION ALL
  SELECT o.region, o.t, o.len, {_list(lambda i: f"greatest({_list(lambda j: came(i, j), n)}) + l{i}", n)}, {_list(lambda i: pick(lambda j: came(i, j)), n)} FROM v JOIN obs o ON o.region = v.region AND o.t = v.t + 1),
trace AS (SELECT region, t, {pick(lambda j: f"v{j}")} AS state FROM v WHERE t = len UNION ALL
  SELECT v.region, v.t - 1, CASE trace.state {" ".join(f"WHEN {i} THEN v.k{i}" for i in range(n))} END FROM trace JOIN v ON v.region = trace.region AND v.t = trace.t WHERE trace.t > 1),
dec AS (SELECT o.*, trace.state FROM obs o JOIN trace USING (region, t))"""


def domains(n: int, k: str, cutoff: float, undefined: int) -> str:
    """dom: labelled stretches (region, chrom, label, start, end, mean, score, n) from dec and post."""
    turn = lambda c, name, src: f"SELECT *, sum(turn_{name}) OVER (PARTITION BY region ORDER BY bin) AS {name} FROM (SELECT *, CASE WHEN {c} IS DISTINCT FROM lag({c}) OVER (PARTITION BY region ORDER BY bin) THEN 1 ELSE 0 END AS turn_{name} FROM {src})"
    most = f"greatest({_list(lambda i: f'v{i}', n)})"
    majority = "CASE WHEN 2 * v0 >= v0 + v1 THEN 0 ELSE 1 END" if n == 2 else "CASE " + " ".join(f"WHEN v{i} = {most} THEN {i}" for i in range(n)) + " END"
    return f"""sc AS (SELECT dec.*, CASE state {" ".join(f"WHEN {i} THEN p{i}" for i in range(n))} END AS score FROM dec JOIN (SELECT region, t, {_list(lambda i: f"p{i}", n)} FROM post) USING (region, t)),
r1 AS ({turn("state", "run", "sc")}),
r2 AS (SELECT *, CASE WHEN max(score) OVER (PARTITION BY region, run) >= {cutoff} THEN state ELSE -1 END AS firm FROM r1),
r3 AS ({turn("firm", "stretch", "r2")}),
st AS (SELECT region, stretch, firm, min(s) AS s, max(e) AS e, {_list(lambda i: f"sum((state = {i})::INT) AS v{i}", n)} FROM r3 GROUP BY ALL),
st2 AS (SELECT *, lag(firm) OVER w AS l, lead(firm) OVER w AS r FROM st WINDOW w AS (PARTITION BY region ORDER BY stretch)),
named AS (SELECT region, stretch, CASE WHEN firm >= 0 THEN firm WHEN e - s > {undefined} THEN -1 WHEN l = r THEN l ELSE {majority} END AS label FROM st2),
lab AS (SELECT r3.*, label, CASE WHEN label < 0 OR label = state THEN score ELSE (1 - score) / {n - 1} END AS local FROM r3 JOIN named USING (region, stretch)),
r4 AS ({turn("label", "island", "lab")}),
dom AS (SELECT region, island, chrom, label, min(s) AS start, max(e) AS "end", sum({k}) / sum(scale) AS mean, sum(local) AS score, count(*) AS n FROM r4 GROUP BY region, island, chrom, label)"""


def scored(n: int) -> str:
    """sco: dec with xi and score, the probability of a move into the state that the nearest change enters."""
    into = " ".join(f"WHEN {j} THEN {' + '.join(f'x{i}{j}' for i in range(n) if i != j)}" for j in range(n))
    return f"""tu AS (SELECT *, coalesce(state <> lag(state) OVER (PARTITION BY region ORDER BY t), false) AS turn FROM dec),
ch AS (SELECT region, t, state FROM tu WHERE turn),
le AS (SELECT tu.*, (SELECT max(ch.t) FROM ch WHERE ch.region = tu.region AND ch.t <= tu.t) AS lt, (SELECT min(ch.t) FROM ch WHERE ch.region = tu.region AND ch.t > tu.t) AS rt FROM tu),
nc AS (SELECT le.*, ch.state AS change FROM le LEFT JOIN ch ON ch.region = le.region AND ch.t = CASE WHEN lt IS NULL OR rt - le.t < le.t - lt THEN coalesce(rt, lt) ELSE lt END),
sco AS (SELECT nc.*, CASE change {into} ELSE 0 END AS score, COLUMNS('x\\d\\d') FROM nc JOIN xi USING (region, t))"""


def boundaries(n: int, cutoff: float, islands: bool = False) -> str:
    """bou: the intervals of score > cutoff around domain ends with the probability of a single change; islands: those of score >= cutoff that hold a change."""
    pairs = [(a, b) for a in range(n) for b in range(n) if a != b]
    row = lambda i, j: f"(CASE WHEN nth = 1 THEN x{i}{j} ELSE x{i}{j} / greatest({_list(lambda q: f'x{i}{q}', n, ' + ')}, 1e-300) END)"
    ln = lambda v: f"ln(greatest({v}, 1e-300))"
    before = "OVER (PARTITION BY region, island ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    after = "OVER (PARTITION BY region, island ORDER BY nth ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
    terms = ", ".join(f"coalesce(sum({ln(row(a, a))}) {before}, 0) + {ln(row(a, b))} + coalesce(sum({ln(row(b, b))}) {after}, 0) AS w{a}{b}" for a, b in pairs)
    best = "greatest(" + ", ".join(f"sum(exp(w{a}{b}))" if n == 2 else f"CASE WHEN min(own) IN ({a}, {b}) THEN sum(exp(w{a}{b})) ELSE 0 END" for a, b in pairs) + ")"
    ends = (
        """SELECT region, run, state AS of, beside AS island FROM opens UNION ALL SELECT region, was_run, was, beside FROM opens WHERE was_run IS NOT NULL UNION ALL
  SELECT region, run, state, island FROM tail"""
        if n == 2
        else "SELECT region, run, state AS of, beside AS island FROM opens UNION ALL SELECT region, run, state, island FROM tail"
    )
    keep = "of = 0 AND island IS NOT NULL" if n == 2 else "island IS NOT NULL"
    twice = "QUALIFY count(*) OVER (PARTITION BY region, run) = 2" if n == 2 else ""
    if islands:
        ends, keep, twice = "SELECT DISTINCT region, island FROM nb WHERE was_run <> run", "island IS NOT NULL", ""
        best = "greatest(" + ", ".join(f"sum(exp(w{a}{b}))" for a, b in pairs) + ")" if n == 2 else best
    return f"""hb AS (SELECT *, score {">=" if islands else ">"} {cutoff} AS hot FROM sco),
ru AS (SELECT *, sum(sw::INT) OVER (PARTITION BY region ORDER BY t) AS run, CASE WHEN hot THEN sum(hs::INT) OVER (PARTITION BY region ORDER BY t) END AS island
  FROM (SELECT *, state IS DISTINCT FROM lag(state) OVER w AS sw, hot IS DISTINCT FROM lag(hot) OVER w AS hs FROM hb WINDOW w AS (PARTITION BY region ORDER BY t))),
nb AS (SELECT *, coalesce(island, lag(island) OVER w) AS beside, lag(run) OVER w AS was_run, lag(state) OVER w AS was FROM ru WINDOW w AS (PARTITION BY region ORDER BY t)),
opens AS (SELECT * FROM nb WHERE was_run IS NULL OR was_run <> run), tail AS (SELECT * FROM ru WHERE t = len),
ends AS (SELECT * FROM ({ends}) WHERE {keep} {twice}),
isl AS (SELECT *, row_number() OVER (PARTITION BY region, island ORDER BY t) AS nth, first_value(state) OVER (PARTITION BY region, island ORDER BY t) AS own FROM ru WHERE island IS NOT NULL),
wt AS (SELECT *, {terms} FROM isl),
sums AS (SELECT region, island, any_value(chrom) AS chrom, min(s) AS start, max(e) AS "end", count(*) AS bins, arg_max(s, (score, -t)) AS peak, max(score) AS peak_score, {best} AS p FROM wt GROUP BY region, island),
bou AS (SELECT chrom, start, "end", bins, peak, peak_score, p FROM ends JOIN sums USING (region, island))"""
