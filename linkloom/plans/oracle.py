"""SQL for the example's graph queries, written step by step as common table expressions."""

from __future__ import annotations

from linkloom.plans import trade as T

DAY = f"DATE '{T.SNAPSHOT}'"
C, P = T.CUSTOMER, T.PART


def month_after(c: str) -> str:
    return f"CAST(date_trunc('month', CAST({c} AS DATE) + INTERVAL 1 MONTH) AS DATE)"


def md5(*columns: str) -> str:
    return f"md5(concat_ws(':', '{T.SEED}', {', '.join(columns)}))"


def capped(table: str, groups: list[str], n: int, unique: list[str]) -> str:
    return f"SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY {', '.join(groups)} ORDER BY {md5(*unique)}, {', '.join(unique)}) <= {n}"


ORD = f"ord AS (SELECT o_orderkey, o_custkey, o_totalprice, {month_after('o_orderdate')} AS date FROM orders)"
LIN = f"{ORD},\nlin AS (SELECT l_orderkey AS o_orderkey, l_partkey, l_suppkey, l_quantity, o_custkey, date FROM lineitem JOIN ord ON l_orderkey = o_orderkey)"


def _edge(u: str, v: str, ut: int, vt: int, e: int, table: str) -> str:
    return f"SELECT DISTINCT CAST({u} AS BIGINT) AS u_node_id, CAST({v} AS BIGINT) AS v_node_id, {ut} AS u_node_type, {vt} AS v_node_type, {e} AS edge_type, {DAY} AS date FROM {table}"


INNER = f"""{LIN},
inner_e AS (
{_edge("o_orderkey", "o_custkey", 0, 1, 0, f"ord WHERE date < {DAY}")}
UNION ALL {_edge("o_orderkey", "l_partkey", 0, 2, 1, f"lin WHERE date < {DAY}")}
UNION ALL {_edge("o_orderkey", "l_suppkey", 0, 3, 2, f"lin WHERE date < {DAY}")}
UNION ALL {_edge("l_partkey", "l_suppkey", 2, 3, 3, f"lin WHERE date < {DAY}")}
UNION ALL {_edge("c_custkey", "c_nationkey", 1, 4, 4, "customer")})"""
OUTER = f"""{INNER},
both_e AS (SELECT u_node_id AS join_node_id, v_node_id AS add_node_id, u_node_type AS join_node_type, v_node_type AS add_node_type, edge_type, 0 AS join_node_side, date FROM inner_e
UNION ALL SELECT v_node_id, u_node_id, v_node_type, u_node_type, edge_type, 1, date FROM inner_e),
outer_e AS ({capped("both_e", ["join_node_id", "join_node_type", "edge_type", "join_node_side", "date"], T.MAX_NEIGHBOR, ["add_node_id"])})"""

_SNAPS = "(SELECT unnest([DATE '1998-01-01', DATE '1999-01-01', DATE '2000-01-01', DATE '2001-01-01']) AS date)"
ACTIVE = f"active AS (SELECT DISTINCT o_custkey AS id, s.date FROM ord JOIN {_SNAPS} s ON year(ord.date) BETWEEN year(s.date) - 5 AND year(s.date) - 1)"
_SPLIT = " ".join(f"WHEN first_date >= DATE '{a}' AND first_date < DATE '{b}' THEN '{n}'" for n, (a, b) in T.RANGES.items())
KNOWN = f"""{ACTIVE},
first_e AS (SELECT o_custkey AS u_node_id, l_partkey AS v_node_id, min(date) AS first_date FROM lin GROUP BY ALL),
known_all AS (SELECT * FROM (SELECT u_node_id, v_node_id, CAST(date_trunc('year', first_date) AS DATE) AS date, CASE {_SPLIT} END AS sample_type FROM first_e) k
  WHERE sample_type IS NOT NULL AND EXISTS (SELECT 1 FROM active a WHERE a.id = k.u_node_id AND a.date = k.date)),
targets AS (SELECT * FROM known_all WHERE date = {DAY}),
exist AS (SELECT u_node_id, v_node_id, {DAY} AS date FROM first_e WHERE first_date < {DAY} AND u_node_id IN (SELECT id FROM active WHERE date = {DAY}))"""


def _seeds(name: str, end: str, pool: str, node_type: int, side: int) -> str:
    return f"""{name}_ends AS (SELECT DISTINCT {end} AS id FROM targets),
{name} AS (SELECT id AS node_0_id, {node_type} AS node_0_type, {side} AS side, {DAY} AS date FROM (SELECT id FROM {name}_ends UNION ALL
  SELECT id FROM (SELECT id, row_number() OVER (ORDER BY {md5("id")}, id) AS r FROM ({pool}) p WHERE id NOT IN (SELECT id FROM {name}_ends)) WHERE r <= (SELECT ceil(count(*) * 0.25) FROM {name}_ends)))"""


SEEDS = f"""{KNOWN},
{_seeds("u0", "u_node_id", f"SELECT id FROM active WHERE date = {DAY}", C, 0)},
{_seeds("v0", "v_node_id", "SELECT p_partkey AS id FROM part", P, 1)}"""


def nodes(k: int) -> list[str]:
    return [f"node_{i}_{p}" for i in range(k + 1) for p in ("id", "type")]


def edges(lo: int, hi: int) -> list[str]:
    return [f"edge_{i}_{p}" for i in range(lo, hi) for p in ("type", "u", "v")]


def types(k: int) -> list[str]:
    return [f"node_{i}_type" for i in range(k + 1)] + edges(0, k)


def _differ(i: int, j: int, a: str = "", b: str = "") -> str:
    def end(k: int, w: str, p: str, t: str) -> str:
        return f"(CASE WHEN {t}edge_{k}_{w} = {k} THEN {t}node_{k}_{p} ELSE {t}node_{k + 1}_{p} END)"

    return "NOT (" + " AND ".join(f"{end(i, w, p, a)} = {end(j, w, p, b)}" for w in "uv" for p in ("id", "type")) + ")"


def hop(s: str, h: int, restrict: str = "") -> str:
    """Tables {s}{h} from {s}{h-1}; restrict: a table of allowed types of h edges."""
    j = h - 1
    old = ", ".join(f"p.{c}" for c in [*nodes(j), *edges(0, j)])
    raw = f"""{s}{h}_raw AS (SELECT {old}, e.add_node_id AS node_{h}_id, e.add_node_type AS node_{h}_type, e.edge_type AS edge_{j}_type, CASE WHEN e.join_node_side = 0 THEN {j} ELSE {h} END AS edge_{j}_u,
  CASE WHEN e.join_node_side = 0 THEN {h} ELSE {j} END AS edge_{j}_v, p.side, p.date FROM {s}{j} p JOIN outer_e e ON p.node_{j}_id = e.join_node_id AND p.node_{j}_type = e.join_node_type AND p.date = e.date)"""
    conds = [_differ(i, j) for i in range(j)]
    if restrict:
        conds.append(f"EXISTS (SELECT 1 FROM {restrict} r WHERE " + " AND ".join(f"r.{c} = t.{c}" for c in types(h)) + ")")
    src = f"(SELECT * FROM {s}{h}_raw t{' WHERE ' + ' AND '.join(conds) if conds else ''})"
    if h == 1:
        return f"{raw},\n{s}1 AS (SELECT * FROM {src})"
    group = ["node_0_id", "node_0_type", "side", *edges(0, h), "date"]
    return f"{raw},\n{s}{h} AS ({capped(src, group, T.MAX_INSTANCE, [f'node_{i}_id' for i in range(1, h + 1)])})"


def back(k: int, s: str = "v") -> str:
    f, b = (k + 1) // 2, k // 2
    cols = [f"node_{i}_{p} AS node_{k - i}_{p}" for i in range(b + 1) for p in ("id", "type")]
    cols += [c for i in range(b) for c in (f"edge_{i}_type AS edge_{k - i - 1}_type", f"{k} - edge_{i}_u AS edge_{k - i - 1}_u", f"{k} - edge_{i}_v AS edge_{k - i - 1}_v")]
    raw = f"{s}back{k}_raw AS (SELECT {', '.join(cols)}, date FROM {s}{b})"
    if b == 0:
        return f"{raw},\n{s}back{k} AS (SELECT * FROM {s}back{k}_raw)"
    return f"{raw},\n{s}back{k} AS ({capped(f'{s}back{k}_raw', [f'node_{f}_id', f'node_{f}_type', *edges(f, k), 'date'], T.MAX_INSTANCE, [f'node_{i}_id' for i in range(f + 1, k + 1)])})"


def met(k: int, u: str = "u", v: str = "v", restrict: str = "", pairs: str = "", name: str = "met") -> str:
    f = (k + 1) // 2
    left = [c for c in [*nodes(f), *edges(0, f)]]
    right = [c for c in nodes(k) if c not in nodes(f)] + edges(f, k)
    conds = [_differ(i, j) for i in range(f) for j in range(f, k)]
    on = f"a.node_{f}_id = b.node_{f}_id AND a.node_{f}_type = b.node_{f}_type AND a.date = b.date"
    body = f"SELECT {', '.join(f'a.{c}' for c in left)}{''.join(f', b.{c}' for c in right)}, a.date FROM {u}{f} a JOIN {v}back{k} b ON {on}"
    if restrict:
        conds.append(f"EXISTS (SELECT 1 FROM {restrict} r WHERE r.hop_k = {k} AND " + " AND ".join(f"r.{c} = m.{c}" for c in types(k)) + ")")
    if pairs:
        conds.append(f"EXISTS (SELECT 1 FROM {pairs} q WHERE q.u_node_id = m.node_0_id AND q.v_node_id = m.node_{k}_id AND q.date = m.date)")
    return f"{name}{k} AS (SELECT * FROM ({body}) m{' WHERE ' + ' AND '.join(conds) if conds else ''})"


def bip(k: int, name: str = "met") -> str:
    return f"bip{k} AS (SELECT DISTINCT node_0_id, node_{k}_id, {', '.join(types(k))}, date FROM {name}{k})"


def left_over(k: int) -> str:
    """Pairs that are not known, capped."""
    return f"""new{k}_raw AS (SELECT * FROM bip{k} x WHERE NOT EXISTS (SELECT 1 FROM exist e WHERE e.u_node_id = x.node_0_id AND e.v_node_id = x.node_{k}_id AND x.node_0_type = {C} AND x.node_{k}_type = {P} AND e.date = x.date)),
new{k} AS ({capped(f'new{k}_raw', ['node_0_id', *types(k), 'date'], T.MAX_INSTANCE, [f'node_{k}_id'])})"""


def ranked(k: int) -> str:
    return f"""rank{k} AS (SELECT {', '.join(types(k))}, CAST(coalesce(sum(CASE WHEN t.u_node_id IS NOT NULL THEN 1 END), 0) AS BIGINT) AS tgt_pair_count, count(*) AS all_pair_count,
  coalesce(sum(CASE WHEN t.u_node_id IS NOT NULL THEN 1 END), 0) / count(*) AS tgt_pair_percent, {k} AS hop_k
  FROM new{k} x LEFT JOIN (SELECT DISTINCT u_node_id, v_node_id, date FROM targets) t ON t.u_node_id = x.node_0_id AND t.v_node_id = x.node_{k}_id AND x.node_0_type = {C} AND x.node_{k}_type = {P} AND t.date = x.date GROUP BY {', '.join(types(k))})"""


def explored(hops_u: int, hops_v: int) -> str:
    return ",\n".join([OUTER, SEEDS, *[hop("u", h) for h in range(1, hops_u + 1)], *[hop("v", h) for h in range(1, hops_v + 1)]])


def ranking(k_max: int) -> str:
    """All steps up to the table `ranked` of types of all lengths."""
    parts = [explored((k_max + 1) // 2, k_max // 2)]
    for k in range(1, k_max + 1):
        parts += [back(k), met(k), bip(k), left_over(k), ranked(k)]
    def padded(k: int) -> str:
        return ", ".join(c if c in types(k) else f"CAST(NULL AS INTEGER) AS {c}" for c in types(k_max))

    parts.append("ranked AS (" + " UNION ALL ".join(f"SELECT {padded(k)}, tgt_pair_count, all_pair_count, tgt_pair_percent, hop_k FROM rank{k}" for k in range(1, k_max + 1)) + ")")
    return ",\n".join(parts)


def select(steps: str, body: str) -> str:
    return f"WITH {steps}\n{body}"
