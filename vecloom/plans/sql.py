"""Pieces of the SQL twins: element-wise arithmetic spelled out in order, and shared common table expressions."""

from __future__ import annotations

#: Dimensions of the test tables.
D, D_EMB = 32, 64


def sq(a: str, b: str, d: int = D) -> str:
    return "(" + " + ".join(f"({a}[{i}]::DOUBLE - {b}[{i}]::DOUBLE) * ({a}[{i}]::DOUBLE - {b}[{i}]::DOUBLE)" for i in range(1, d + 1)) + ")"


def dot(a: str, b: str, d: int = D) -> str:
    return "(" + " + ".join(f"{a}[{i}]::DOUBLE * {b}[{i}]::DOUBLE" for i in range(1, d + 1)) + ")"


def unit(a: str, d: int = D) -> str:
    n = f"sqrt({dot(a, a, d)})"
    return f"list_transform(range(1, {d + 1}), lambda i: {a}[i]::DOUBLE / CASE WHEN {n} < 1e-10 THEN 1 ELSE {n} END)"


def minus(a: str, b: str, d: int = D) -> str:
    return f"list_transform(range(1, {d + 1}), lambda i: {a}[i]::DOUBLE - {b}[i]::DOUBLE)"


def usable(c: str, d: int = D) -> str:
    return f"coalesce({c} IS NOT NULL AND len({c}) = {d} AND len(list_filter({c}, lambda x: x IS NULL OR isnan(x))) = 0, false)"


KIND = """CASE WHEN lower(trim(op)) IN ('i', 'insert', '1') THEN 'insert'
     WHEN lower(trim(op)) IN ('d', 'delete', '2') THEN 'delete'
     WHEN lower(trim(op)) IN ('u', 'update', '3') THEN 'update' END"""

#: name: (needs, body).  Bodies may be long; ``query`` puts the needed ones in order.
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "stored": ((), f"SELECT DISTINCT index_id, global_id, vector AS v FROM vectors WHERE global_id IS NOT NULL AND index_id IS NOT NULL AND {usable('vector')}"),
    "asked": ((), f"SELECT qid, index_id, q AS v FROM queries WHERE {usable('q')}"),
    "last": ((), "SELECT index_id, max_by(checkpoint_id, timestamp_ns) AS checkpoint_id, max(timestamp_ns) AS taken FROM checkpoints WHERE finished IS NOT NULL AND timestamp_ns IS NOT NULL GROUP BY index_id"),
    "cents": (("last",), f"SELECT index_id, cluster, max(centroids) AS mu, max(coalesce(cluster_counts, 0)) AS stated FROM checkpoint_clusters JOIN last USING (checkpoint_id) WHERE cluster IS NOT NULL AND {usable('centroids')} GROUP BY ALL"),
    "ax": ((), "SELECT DISTINCT axis, a FROM axes"),
    "home_all": (("stored", "cents"), f"SELECT s.index_id, s.global_id, s.v, c.cluster, c.mu, {sq('s.v', 'c.mu')} AS sq FROM stored s JOIN cents c USING (index_id)"),
    "home3": (("home_all",), "SELECT *, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY global_id ORDER BY sq, cluster) AS r FROM home_all) WHERE r <= 3"),
    "home": (("home3",), "SELECT * FROM home3 WHERE rank = 1"),
    "routed": (("asked", "cents"), f"SELECT *, r::INTEGER AS cluster_rank FROM (SELECT q.qid, q.index_id, q.v, c.cluster, c.mu, {sq('q.v', 'c.mu')} AS sq, row_number() OVER (PARTITION BY q.qid ORDER BY {sq('q.v', 'c.mu')}, c.cluster) AS r FROM asked q JOIN cents c USING (index_id) WHERE c.stated > 0) WHERE r <= 4"),
    "centred": (("home",), f"SELECT *, {minus('v', 'mu')} AS x FROM home"),
    "fans": (("centred", "ax"), f"SELECT *, abs(p) / CASE WHEN sqrt({dot('x', 'x')}) < 1e-10 THEN 1 ELSE sqrt({dot('x', 'x')}) END AS score FROM (SELECT c.index_id, c.global_id, c.cluster, c.x, a.axis, {dot('c.x', 'a.a')} AS p FROM centred c CROSS JOIN ax a)"),
    "projs": (("fans",), "SELECT index_id, global_id, cluster, list(p ORDER BY axis) AS proj FROM fans GROUP BY ALL"),
    "members": (("fans",), "SELECT index_id, cluster, axis AS fan, global_id, score FROM (SELECT *, row_number() OVER (PARTITION BY global_id ORDER BY score DESC, axis) AS r FROM fans) WHERE r <= 2"),
    "cones": (("members", "projs"), "SELECT m.*, p.proj FROM members m JOIN projs p USING (index_id, cluster, global_id)"),
    "qcent": (("routed",), f"SELECT *, {minus('v', 'mu')} AS x FROM routed"),
    "qfans": (("qcent", "ax"), f"SELECT *, abs(p) / CASE WHEN sqrt({dot('x', 'x')}) < 1e-10 THEN 1 ELSE sqrt({dot('x', 'x')}) END AS score FROM (SELECT c.qid, c.index_id, c.cluster, c.cluster_rank, c.x, a.axis, {dot('c.x', 'a.a')} AS p FROM qcent c CROSS JOIN ax a)"),
    "qproj": (("qfans",), "SELECT qid, index_id, cluster, list(p ORDER BY axis) AS q_proj FROM qfans GROUP BY ALL"),
    "visited": (("qfans", "qproj"), "SELECT f.qid, f.index_id, f.cluster, f.cluster_rank, f.fan, f.fan_rank, f.score, p.q_proj FROM (SELECT qid, index_id, cluster, cluster_rank, axis AS fan, score, (row_number() OVER (PARTITION BY qid, cluster ORDER BY score DESC, axis))::INTEGER AS fan_rank FROM qfans) f JOIN qproj p USING (qid, index_id, cluster) WHERE f.fan_rank <= 2"),
    "csize": (("members",), "SELECT index_id, cluster, fan, count(*) AS n FROM members GROUP BY ALL"),
    "cpairs": (("visited", "cones", "csize"), "SELECT v.qid, v.index_id, v.cluster, v.fan, c.global_id, s.n, u.axis, c.proj[u.axis + 1] - v.q_proj[u.axis + 1] AS over FROM visited v JOIN csize s USING (index_id, cluster, fan) JOIN cones c USING (index_id, cluster, fan) CROSS JOIN ax u"),
    "cranks": (("cpairs",), "SELECT *, abs(over) AS gap, CASE WHEN over >= 0 THEN row_number() OVER (PARTITION BY qid, cluster, fan, axis, over >= 0 ORDER BY over, global_id) ELSE row_number() OVER (PARTITION BY qid, cluster, fan, axis, over >= 0 ORDER BY over DESC, global_id DESC) END AS rank FROM cpairs"),
    "ccands": (("cranks",), "SELECT DISTINCT qid, global_id FROM cranks WHERE rank <= 50 OR n <= 100"),
    "pall": (("stored", "ax"), f"SELECT s.index_id, s.global_id, a.axis, {dot('s.v', 'a.a')} AS p FROM stored s CROSS JOIN ax a"),
    "ppos": (("pall",), "SELECT *, row_number() OVER (PARTITION BY index_id, axis ORDER BY p, global_id) - 1 AS pos FROM pall"),
    "qall": (("asked", "ax"), f"SELECT q.qid, q.index_id, a.axis, {dot('q.v', 'a.a')} AS p FROM asked q CROSS JOIN ax a"),
    "qpos": (("qall", "pall"), "SELECT q.qid, q.index_id, q.axis, q.p, (SELECT count(*) FROM pall x WHERE x.index_id = q.index_id AND x.axis = q.axis AND x.p < q.p) AS pos FROM qall q"),
    "wcands": (("ppos", "qpos"), "SELECT DISTINCT q.qid, q.index_id, p.global_id FROM qpos q JOIN ppos p ON p.index_id = q.index_id AND p.axis = q.axis AND p.pos >= q.pos - 100 AND p.pos < q.pos + 100"),
    "wfound": (("wcands", "asked", "stored"), f"SELECT qid, rank::INTEGER AS rank, global_id, sqrt(d) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, global_id) AS rank FROM (SELECT c.qid, c.global_id, {sq('q.v', 's.v')} AS d FROM wcands c JOIN asked q USING (qid) JOIN stored s ON s.global_id = c.global_id)) WHERE rank <= 10"),
    "truth": (("asked", "stored"), f"SELECT qid, rank::INTEGER AS rank, global_id, sqrt(d) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, global_id) AS rank FROM (SELECT q.qid, s.global_id, {sq('q.v', 's.v')} AS d FROM asked q JOIN stored s USING (index_id))) WHERE rank <= 10"),
    "changes": ((), f"SELECT global_id, kind, timestamp_ns, vector, min(seq) AS seq, min(index_id) AS index_id FROM (SELECT global_id, {KIND} AS kind, timestamp_ns, vector, seq, index_id FROM mutations) WHERE global_id IS NOT NULL AND kind IS NOT NULL GROUP BY global_id, kind, timestamp_ns, vector"),
    "effective": (("changes",), f"SELECT * FROM changes WHERE kind = 'delete' OR {usable('vector')}"),
    "ends": (("effective",), "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY global_id ORDER BY timestamp_ns DESC, seq DESC) AS r FROM effective) WHERE r = 1"),
    "live": (("ends", "stored"), "SELECT global_id, vector AS v FROM ends WHERE kind <> 'delete' UNION ALL SELECT global_id, v FROM stored WHERE global_id NOT IN (SELECT global_id FROM ends)"),
    "dead": (("ends",), "SELECT global_id FROM ends WHERE kind = 'delete'"),
    "tombs": (("home", "dead"), "SELECT h.index_id, h.cluster, count(*) AS n, count(d.global_id) AS n_tomb FROM home h LEFT JOIN dead d USING (global_id) GROUP BY ALL"),
    "qerr": (("home",), "SELECT index_id, cluster, count(*) AS n, (sum(sq::DECIMAL(28,12)) / count(*))::DOUBLE AS error FROM home GROUP BY ALL"),
    "vmean": (("home",), "SELECT index_id, cluster, n, list(m ORDER BY pos) AS mu FROM (SELECT index_id, cluster, pos, (sum(x::DOUBLE::DECIMAL(28,12)))::DOUBLE / count(*) AS m, count(*) AS c FROM (SELECT index_id, cluster, unnest(v) AS x, unnest(range(1, 33)) AS pos FROM home) GROUP BY ALL) JOIN (SELECT index_id, cluster, count(*) AS n FROM home GROUP BY ALL) USING (index_id, cluster) GROUP BY index_id, cluster, n"),
    "cells": (("qerr", "cents"), "SELECT q.index_id, q.cluster, c.mu, q.n, q.error FROM qerr q JOIN cents c USING (index_id, cluster)"),
    "near_cells": (("cells",), f"SELECT * FROM (SELECT x.index_id, x.cluster AS a, y.cluster AS b, {sq('x.mu', 'y.mu')} AS sq, x.n::DOUBLE AS na, y.n::DOUBLE AS nb, x.error AS ea, y.error AS eb FROM cells x JOIN cells y ON x.index_id = y.index_id AND x.cluster < y.cluster) WHERE sq < 250"),
    "gains": (("near_cells",), "SELECT index_id, a, b, sq, na * nb / ((na + nb) * (na + nb)) * sq AS gain, na * nb / ((na + nb) * (na + nb)) * sq <= 0.5 * (ea + eb) AS passes FROM near_cells"),
    "mends": (("gains",), "SELECT index_id, a AS c, b AS o, sq FROM gains WHERE passes UNION ALL SELECT index_id, b, a, sq FROM gains WHERE passes"),
    "mnear": (("mends",), "SELECT index_id, c, o FROM (SELECT *, row_number() OVER (PARTITION BY index_id, c ORDER BY sq, o) AS r FROM mends) WHERE r = 1"),
    "mplan": (("mnear",), "SELECT x.index_id, x.c AS kept, x.o AS folded FROM mnear x JOIN mnear y ON x.index_id = y.index_id AND x.c = y.o AND x.o = y.c WHERE x.c < x.o"),
}


def query(final: str, *needs: str) -> str:
    """``final`` behind the WITH clause of everything it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in PARTS[name][0]:
            add(other)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n][1]})" for n in order) + "\n" + final
