"""DuckDB twins of the registered queries (same column names, same rounding)."""

from __future__ import annotations

from txgraph.plans.registry import BATCH, EV_SPLIT, RATIOS, SCORE_CENTER, SCORE_SCALE, TX_SPLIT
from txgraph.operators.splits import resolve_split
from txgraph.sources.tables import EVENT_VIEW_SQL, TX_VIEW_SQL

_TS = resolve_split(TX_SPLIT)
_ES = resolve_split(EV_SPLIT)
_R_TRAIN = repr(1 - RATIOS[1] - RATIOS[2])
_R_VAL = repr(1 - RATIOS[2])


def _between(col: str, lo, hi) -> str:
    return f"{col} BETWEEN TIMESTAMP '{lo.isoformat()}' AND TIMESTAMP '{hi.isoformat()}'"


def _codes(col: str, s) -> tuple[str, str]:
    hpo = (f"CAST(CASE WHEN {_between(col, s.from_date, s.to_train_hpo)} THEN 0 "
           f"WHEN {_between(col, s.from_validation, s.to_validation)} THEN 1 "
           f"WHEN {_between(col, s.from_test, s.to_test)} THEN 2 ELSE 3 END AS INTEGER)")
    full = (f"CAST(CASE WHEN {_between(col, s.from_date, s.to_train_full)} THEN 0 "
            f"WHEN {_between(col, s.from_test, s.to_test)} THEN 2 ELSE 3 END AS INTEGER)")
    return hpo, full


_TX_HPO, _TX_FULL = _codes("ts", _TS)
_EV_HPO, _EV_FULL = _codes("ts", _ES)

TX = TX_VIEW_SQL.strip()
B = (f"b AS (SELECT *, {_TX_HPO} AS split_hpo, {_TX_FULL} AS split_full FROM tx "
     f"WHERE {_between('ts', _TS.from_date, _TS.to_test)})")
EV = EVENT_VIEW_SQL.strip()
# events with positional row index and mask
E = ("e AS (SELECT ev.*, x.row_index, CASE WHEN x.row_index <= CAST(n.n AS DOUBLE) * " + _R_TRAIN +
     " THEN 'train' WHEN x.row_index <= CAST(n.n AS DOUBLE) * " + _R_VAL +
     " THEN 'val' ELSE 'test' END AS mask FROM ev JOIN (SELECT event_id AS xid, "
     "row_number() OVER (ORDER BY ts, event_id) - 1 AS row_index FROM ev) x ON ev.event_id = x.xid, "
     "(SELECT count(*) AS n FROM ev) n)")


def _ids(name: str, key: str, src: str = "b", idcol: str = "id") -> str:
    return (f"{name} AS (SELECT {key}, dense_rank() OVER (ORDER BY {key}) - 1 AS {idcol} "
            f"FROM (SELECT DISTINCT {key} FROM {src} WHERE {key} IS NOT NULL))")


def _fill(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL OR isnan({x}) THEN 0.0 ELSE {x} END)"


def _slog(x: str) -> str:
    return f"(sign({x}) * ln(abs({x}) + 1))"


def _std_ctes(src: str, xexpr: str) -> str:
    return (f"l AS (SELECT {src}.*, {xexpr} AS x FROM {src}), "
            "st AS (SELECT avg(x) FILTER (WHERE split_full = 0 AND NOT isnan(x)) AS m, "
            "stddev_samp(x) FILTER (WHERE split_full = 0 AND NOT isnan(x)) AS s FROM l), "
            "f AS (SELECT l.*, (x - st.m) / (st.s + 1e-12) AS z FROM l, st)")


def _mono_pairs(name: str, p: str, aux: str, src: str = "b") -> str:
    return (f"{name}_c AS (SELECT {aux} AS aux, {p} AS p, count(*) AS c FROM {src} "
            f"WHERE {aux} IS NOT NULL AND {p} IS NOT NULL GROUP BY 1, 2), "
            f"{name} AS (SELECT x.p AS src, y.p AS dst, CAST(sum(x.c * y.c) AS BIGINT) AS weight "
            f"FROM {name}_c x JOIN {name}_c y ON x.aux = y.aux AND x.p <> y.p GROUP BY 1, 2)")


_ATTRS = [("LAST_NAME", '"last"'), ("CITY", "city"), ("JOB", "job"), ("DOB", "dob"),
          ("FIRST_ORDER_DATE", "first_order_date"), ("FIRST_ORDER_MERCHANT", "first_order_merchant")]


def _bi_count(s: str, r: str, d: str, a: str, b: str) -> str:
    return (f"SELECT '{s}' AS src_type, '{r}' AS relation, '{d}' AS dst_type, "
            f"CAST(count(*) AS BIGINT) AS n_edges, CAST(count(*) AS BIGINT) AS n_bag "
            f"FROM (SELECT DISTINCT {a}, {b} FROM b WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")


def _edge_centric() -> str:
    ctes = [TX, B] + [_mono_pairs(f"m_{t}", "cc_num", col) for t, col in _ATTRS]
    sel = [_bi_count("TRANSACTION", "MADE_BY", "CUSTOMER", "trans_num", "cc_num"),
           _bi_count("CUSTOMER", "MADE", "TRANSACTION", "trans_num", "cc_num"),
           _bi_count("TRANSACTION", "MADE_AT", "MERCHANT", "trans_num", "merchant"),
           _bi_count("MERCHANT", "RECEIVED", "TRANSACTION", "trans_num", "merchant")]
    for t, _ in _ATTRS:
        sel.append(f"SELECT 'CUSTOMER' AS src_type, 'HAS_SAME_{t}' AS relation, 'CUSTOMER' AS dst_type, "
                   f"CAST(count(*) AS BIGINT) AS n_edges, CAST(coalesce(sum(weight), 0) AS BIGINT) AS n_bag FROM m_{t}")
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(sel)


def _node_centric() -> str:
    sel = [_bi_count("TRANSACTION", "MADE_BY", "CUSTOMER", "trans_num", "cc_num"),
           _bi_count("CUSTOMER", "MADE", "TRANSACTION", "trans_num", "cc_num"),
           _bi_count("TRANSACTION", "MADE_AT", "MERCHANT", "trans_num", "merchant"),
           _bi_count("MERCHANT", "RECEIVED", "TRANSACTION", "trans_num", "merchant")]
    for t, col in _ATTRS:
        sel.append(_bi_count("CUSTOMER", f"HAS_SAME_{t}", t, "cc_num", col))
        sel.append(_bi_count(t, f"REV_HAS_SAME_{t}", "CUSTOMER", "cc_num", col))
    return "WITH " + TX + ", " + B + " " + " UNION ALL ".join(sel)


def _shared_attributes() -> str:
    """Real pairs where they are few; for attributes with few values (over 10^7 pairs at sf0.01) the pairs of their
    (value, other value) classes, counted per transaction against all others of the value."""
    attrs = [("CUSTOMER", "cc_num", "MADE_BY_SAME_CUSTOMER")] + [(t, c, f"CUSTOMER_HAS_SAME_{t}") for t, c in _ATTRS]
    sparse = {"cc_num", "dob", "first_order_date", "first_order_merchant", '"last"'}
    sel = []
    for _, col, rel in attrs:
        if col in sparse:
            src = (f"SELECT x.trans_num AS s, y.trans_num AS t, count(*) AS w FROM b x JOIN b y ON x.{col} = y.{col} AND x.trans_num <> y.trans_num GROUP BY 1, 2")
            sel.append(f"SELECT 'TRANSACTION' AS src_type, '{rel}' AS relation, 'TRANSACTION' AS dst_type, CAST(count(*) AS BIGINT) AS n_edges, "
                       f"CAST(coalesce(sum(w), 0) AS BIGINT) AS n_bag FROM ({src})")
        else:
            sel.append(f"SELECT 'TRANSACTION' AS src_type, '{rel}' AS relation, 'TRANSACTION' AS dst_type, CAST(coalesce(sum(others), 0) AS BIGINT) AS n_edges, "
                       f"CAST(coalesce(sum(others), 0) AS BIGINT) AS n_bag FROM (SELECT count(*) OVER (PARTITION BY {col}) - 1 AS others FROM b "
                       f"WHERE {col} IS NOT NULL AND trans_num IS NOT NULL)")
    return "WITH " + TX + ", " + B + " " + " UNION ALL ".join(sel)


_NODE_KEYS = [("TRANSACTION", "trans_num"), ("CUSTOMER", "cc_num"), ("MERCHANT", "merchant"),
              ("LAST_NAME", '"last"'), ("CITY", "city"), ("JOB", "job"), ("DOB", "dob"),
              ("FIRST_ORDER_DATE", "first_order_date"), ("FIRST_ORDER_MERCHANT", "first_order_merchant")]


def _graph_summary() -> str:
    sel = [f"SELECT '{t}' AS node_type, CAST(count(DISTINCT {k}) AS BIGINT) AS n_nodes FROM b" for t, k in _NODE_KEYS]
    return "WITH " + TX + ", " + B + " " + " UNION ALL ".join(sel)


def _graph_checks() -> str:
    sel = [f"SELECT 'rows_without_node_id' AS \"check\", '{t}' AS node_type, "
           f"CAST(sum(CASE WHEN {k} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_bad FROM b" for t, k in _NODE_KEYS]
    sel.append("SELECT 'labelled_key_on_several_rows' AS \"check\", 'TRANSACTION' AS node_type, "
               "CAST(count(*) AS BIGINT) AS n_bad FROM (SELECT trans_num FROM b WHERE trans_num IS NOT NULL "
               "GROUP BY trans_num HAVING count(*) > 1)")
    return "WITH " + TX + ", " + B + " " + " UNION ALL ".join(sel)


_SAMPLING = (
    "WITH " + TX + ", " + B + ", " + _ids("it", "trans_num", idcol="tid") + ", " + _ids("ic", "cc_num", idcol="cid")
    + ", " + _ids("ix", "city", idcol="xid")
    + ", r AS (SELECT b.*, it.tid, ic.cid, ix.xid FROM b LEFT JOIN it USING (trans_num) LEFT JOIN ic USING (cc_num) "
    "LEFT JOIN ix USING (city)), "
    "made AS (SELECT DISTINCT cid AS src, tid AS dst FROM r WHERE cid IS NOT NULL AND tid IS NOT NULL), "
    "cc AS (SELECT xid AS aux, cid AS p, count(*) AS c FROM r WHERE xid IS NOT NULL AND cid IS NOT NULL GROUP BY 1, 2), "
    "city AS (SELECT DISTINCT x.p AS src, y.p AS dst FROM cc x JOIN cc y ON x.aux = y.aux AND x.p <> y.p), "
    "tt AS (SELECT tid AS node_id, max(\"timestamp\") AS ta FROM r WHERE tid IS NOT NULL GROUP BY tid), "
    "ct AS (SELECT cid AS node_id, min(\"timestamp\") AS ta FROM r WHERE cid IS NOT NULL GROUP BY cid), "
    "s0 AS (SELECT DISTINCT tid AS node_id FROM r WHERE split_full = 2 AND tid IS NOT NULL)"
)


def _draw(name: str, edges: str, frontier: str, hop: int, k: int, strategy: str = "", src_time: str = "") -> str:
    """Up to k in-neighbours of every frontier row over all pairs: the smallest md5(hop:src), or the most recent ones."""
    order = "nb DESC, src" if strategy == "last" else f"md5('{hop}:' || CAST(src AS VARCHAR)), src"
    if not strategy:
        return (f"{name} AS (SELECT src, dst FROM (SELECT e.src, e.dst, row_number() OVER (PARTITION BY e.dst ORDER BY {order}) AS rn "
                f"FROM {edges} e JOIN {frontier} f ON e.dst = f.node_id) WHERE rn <= {k})")
    return (f"{name} AS (SELECT src, dst, seed_time FROM (SELECT e.src, e.dst, f.seed_time, row_number() OVER (PARTITION BY e.dst, f.seed_time "
            f"ORDER BY {order.replace('nb', 't.ta').replace('src', 'e.src')}) AS rn FROM {edges} e JOIN {frontier} f ON e.dst = f.node_id "
            f"JOIN {src_time} t ON e.src = t.node_id WHERE f.seed_time IS NULL OR t.ta <= f.seed_time) WHERE rn <= {k})")


# fan-outs [10, 15]: the first hop from the seeds draws 15, the next 10; the nodes of a hop stay in the next frontier
_RELATIONS = (", made_by AS (SELECT dst AS src, src AS dst FROM made), "
              "tc AS (SELECT DISTINCT xid AS aux, tid AS p FROM r WHERE xid IS NOT NULL AND tid IS NOT NULL), "
              "in_city AS (SELECT x.p AS src, y.p AS dst FROM tc x JOIN tc y ON x.aux = y.aux AND x.p <> y.p)")


def _sample_uniform() -> str:
    parts = [("MADE", "a1", 1), ("IN_SAME_CITY", "b1", 1), ("MADE", "a2", 2), ("IN_SAME_CITY", "b2", 2), ("MADE_BY", "c2", 2), ("HAS_SAME_CITY", "d2", 2)]
    return (_SAMPLING + _RELATIONS + ", " + ", ".join([
        _draw("a1", "made", "s0", 1, 15), _draw("b1", "in_city", "s0", 1, 15),
        "t1 AS (SELECT node_id FROM s0 UNION SELECT src FROM b1)", "c1 AS (SELECT DISTINCT src AS node_id FROM a1)",
        _draw("a2", "made", "t1", 2, 10), _draw("b2", "in_city", "t1", 2, 10), _draw("c2", "made_by", "c1", 2, 10), _draw("d2", "city", "c1", 2, 10)])
        + " " + " UNION ALL ".join(f"SELECT {hop} AS hop, '{rel}' AS relation, src, dst FROM {cte}" for rel, cte, hop in parts))


def _sample_temporal(strategy: str) -> str:
    parts = [("MADE", "a1", 1), ("MADE", "a2", 2), ("MADE_BY", "c2", 2), ("HAS_SAME_CITY", "d2", 2)]
    return (_SAMPLING + ", made_by AS (SELECT dst AS src, src AS dst FROM made), " + ", ".join([
        "seeds AS (SELECT s0.node_id, tt.ta AS seed_time FROM s0 LEFT JOIN tt USING (node_id))",
        _draw("a1", "made", "seeds", 1, 15, strategy, "ct"), "c1 AS (SELECT DISTINCT src AS node_id, seed_time FROM a1)",
        _draw("a2", "made", "seeds", 2, 10, strategy, "ct"), _draw("c2", "made_by", "c1", 2, 10, strategy, "tt"), _draw("d2", "city", "c1", 2, 10, strategy, "ct")])
        + " " + " UNION ALL ".join(f"SELECT {hop} AS hop, '{rel}' AS relation, src, dst, seed_time FROM {cte}" for rel, cte, hop in parts))


_NEIGHBOR_AGG = (
    _SAMPLING + ", "
    f"tx_x AS (SELECT tid AS node_id, max({_slog('amt')}) AS amt_log FROM r WHERE tid IS NOT NULL GROUP BY tid), "
    f"cu_x AS (SELECT cid AS node_id, arg_max({_slog('city_pop')}, (\"timestamp\", trans_num)) AS city_pop_log "
    "FROM r WHERE cid IS NOT NULL GROUP BY cid), "
    "made_by AS (SELECT DISTINCT tid AS src, cid AS dst FROM r WHERE tid IS NOT NULL AND cid IS NOT NULL), "
    "p1 AS (SELECT mb.dst AS node_id, sum(tx_x.amt_log) AS amt_log, CAST(NULL AS DOUBLE) AS city_pop_log "
    "FROM made_by mb JOIN tx_x ON mb.src = tx_x.node_id GROUP BY mb.dst), "
    "p2 AS (SELECT c.dst AS node_id, CAST(NULL AS DOUBLE) AS amt_log, sum(cu_x.city_pop_log) AS city_pop_log "
    "FROM city c JOIN cu_x ON c.src = cu_x.node_id GROUP BY c.dst) "
    "SELECT node_id, round(sum(coalesce(amt_log, 0.0)), 6) AS amt_log, round(sum(coalesce(city_pop_log, 0.0)), 6) "
    "AS city_pop_log FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2) GROUP BY node_id"
)

def _mean_over(name: str, edges: str, x: str, cols: str) -> str:
    return (f"{name} AS (SELECT e.dst AS node_id, " + ", ".join(f"sum(coalesce(x.{c}, 0.0)) / count(*) AS {c}" for c in cols.split())
            + f" FROM {edges} e JOIN {x} x ON e.src = x.node_id GROUP BY e.dst)")


# two hops of means over the explicit pairs of every relation
_PROPAGATED = (
    _NEIGHBOR_AGG[: _NEIGHBOR_AGG.index("p1 AS (")] + ", ".join([
        _mean_over("tu1", "made_by", "tx_x", "amt_log"), _mean_over("cc1", "city", "cu_x", "city_pop_log"), _mean_over("ct1", "made", "cu_x", "city_pop_log"),
        "c_1 AS (SELECT cu_x.node_id, cu_x.city_pop_log AS own, coalesce(tu1.amt_log, 0.0) AS amt_log, coalesce(cc1.city_pop_log, 0.0) AS city_pop_log "
        "FROM cu_x LEFT JOIN tu1 USING (node_id) LEFT JOIN cc1 USING (node_id))",
        "t_1 AS (SELECT tx_x.node_id, tx_x.amt_log AS own, coalesce(ct1.city_pop_log, 0.0) AS city_pop_log FROM tx_x LEFT JOIN ct1 USING (node_id))",
        _mean_over("tu2", "made_by", "t_1", "city_pop_log"), _mean_over("cc2", "city", "c_1", "amt_log city_pop_log"), _mean_over("ct2", "made", "c_1", "amt_log city_pop_log")])
    + " SELECT 'CUSTOMER' AS ntype, node_id, round(own, 6) AS own, round(c_1.amt_log, 6) AS amt_log_h1, round(c_1.city_pop_log, 6) AS city_pop_log_h1, "
    "round(coalesce(cc2.amt_log, 0.0), 6) AS amt_log_h2, round(coalesce(tu2.city_pop_log, 0.0) + coalesce(cc2.city_pop_log, 0.0), 6) AS city_pop_log_h2 "
    "FROM c_1 LEFT JOIN tu2 USING (node_id) LEFT JOIN cc2 USING (node_id) UNION ALL "
    "SELECT 'TRANSACTION', node_id, round(own, 6), 0.0, round(t_1.city_pop_log, 6), round(coalesce(ct2.amt_log, 0.0), 6), round(coalesce(ct2.city_pop_log, 0.0), 6) "
    "FROM t_1 LEFT JOIN ct2 USING (node_id)"
)


def _newton(steps: int) -> str:
    """Chained CTEs b0..b<steps>: Newton's method for a weighted logistic regression on x1, x2 of table ``z`` (y, w),
    each with the 3 x 3 system solved by its adjugate."""
    out = ["b0 AS (SELECT CAST(0 AS DOUBLE) AS p0, CAST(0 AS DOUBLE) AS p1, CAST(0 AS DOUBLE) AS p2)"]
    for i in range(steps):
        out.append(
            f"b{i + 1} AS (SELECT p0 + ((d * f - e * e) * g0 + (c * e - b * f) * g1 + (b * e - c * d) * g2) / det AS p0, "
            "p1 + ((c * e - b * f) * g0 + (a * f - c * c) * g1 + (b * c - a * e) * g2) / det AS p1, "
            "p2 + ((b * e - c * d) * g0 + (b * c - a * e) * g1 + (a * d - b * b) * g2) / det AS p2 FROM (SELECT *, "
            "a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM (SELECT any_value(p0) AS p0, any_value(p1) AS p1, any_value(p2) AS p2, "
            "sum(h) AS a, sum(h * x1) AS b, sum(h * x2) AS c, sum(h * x1 * x1) AS d, sum(h * x1 * x2) AS e, sum(h * x2 * x2) AS f, "
            "sum(w * (y - q)) AS g0, sum(w * (y - q) * x1) AS g1, sum(w * (y - q) * x2) AS g2 FROM "
            f"(SELECT *, w * q * (1 - q) AS h FROM (SELECT *, 1 / (1 + exp(-(p0 + p1 * x1 + p2 * x2))) AS q FROM z, b{i})))))")
    return ", ".join(out)


_TRAIN_SCORE = (
    "WITH " + EV + ", " + E + ", um AS (SELECT user_id, avg(\"value\") AS m FROM e WHERE mask = 'train' GROUP BY user_id), "
    "r AS (SELECT (SELECT CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS DOUBLE) / sum(CASE WHEN label <> 0 THEN 1 ELSE 0 END) FROM e WHERE mask = 'train') AS ratio), "
    "x AS (SELECT e.event_id, e.mask, e.label, \"value\" AS x1, coalesce(um.m, 0.0) AS x2 FROM e LEFT JOIN um USING (user_id)), "
    "z AS (SELECT x1, x2, CAST(label AS DOUBLE) AS y, CASE WHEN label = 1 THEN r.ratio ELSE 1.0 END AS w FROM x, r WHERE mask = 'train'), "
    + _newton(9) + " SELECT event_id, round(p0 + p1 * x1 + p2 * x2, 6) AS score, label FROM x, b9 WHERE mask = 'test'"
)

_PRED = (f"p AS (SELECT event_id, (\"value\" - {SCORE_CENTER}) / {SCORE_SCALE} AS score, label FROM e "
         "WHERE mask = 'test'), "
         "w AS (SELECT CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS DOUBLE) / "
         "sum(CASE WHEN label <> 0 THEN 1 ELSE 0 END) AS w FROM e WHERE mask = 'train')")
_PREC = ("coalesce(sum(CASE WHEN score > 0.5 AND label = 1 THEN 1 ELSE 0 END) / "
         "NULLIF(sum(CASE WHEN score > 0.5 THEN 1 ELSE 0 END), 0), 0.0)")
_REC = ("coalesce(sum(CASE WHEN score > 0.5 AND label = 1 THEN 1 ELSE 0 END) / "
        "NULLIF(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END), 0), 0.0)")
_LOSS = ("avg((1 - label) * score + (1 + (w.w - 1) * label) * "
         "(ln(1 + exp(-abs(score))) + greatest(-score, 0.0)))")


def _inc_keys(t: str, col: str) -> str:
    return (f"k_{t}_old AS (SELECT {col} AS k, dense_rank() OVER (ORDER BY {col}) - 1 AS node_id "
            f"FROM (SELECT DISTINCT {col} FROM tr WHERE {col} IS NOT NULL)), "
            f"k_{t}_new AS (SELECT k, dense_rank() OVER (ORDER BY k) - 1 + (SELECT count(*) FROM k_{t}_old) AS node_id "
            f"FROM (SELECT DISTINCT {col} AS k FROM va WHERE {col} IS NOT NULL "
            f"AND {col} NOT IN (SELECT k FROM k_{t}_old))), "
            f"k_{t} AS (SELECT * FROM k_{t}_old UNION ALL SELECT * FROM k_{t}_new)")


_INC = ("WITH " + EV + ", " + E + ", tr AS (SELECT * FROM e WHERE mask = 'train'), "
        "va AS (SELECT * FROM e WHERE mask = 'val'), tv AS (SELECT * FROM e WHERE mask IN ('train', 'val')), "
        + _inc_keys("user", "user_id") + ", " + _inc_keys("event", "event_id") + ", " + _inc_keys("property", "props"))

def _inc3_keys(t: str, col: str) -> str:
    """Ids after a first state and three increments: new keys of an increment go behind all earlier ones."""
    out = [f"q_{t}_0 AS (SELECT {col} AS k, dense_rank() OVER (ORDER BY {col}) - 1 AS node_id FROM (SELECT DISTINCT {col} FROM tr WHERE {col} IS NOT NULL))"]
    for i in (1, 2, 3):
        out.append(f"q_{t}_{i} AS (SELECT * FROM q_{t}_{i - 1} UNION ALL SELECT k, dense_rank() OVER (ORDER BY k) - 1 + (SELECT count(*) FROM q_{t}_{i - 1}) "
                   f"FROM (SELECT DISTINCT {col} AS k FROM va WHERE part = {i} AND {col} IS NOT NULL AND {col} NOT IN (SELECT k FROM q_{t}_{i - 1})))")
    return ", ".join(out) + f", k_{t} AS (SELECT * FROM q_{t}_3)"


_INC3 = ("WITH " + EV + ", " + E + ", tr AS (SELECT * FROM e WHERE mask = 'train'), "
         "lim AS (SELECT min(row_index) AS lo, (max(row_index) - min(row_index) + 3) // 3 AS third FROM e WHERE mask = 'val'), "
         "va AS (SELECT e.*, (row_index - lo) // third + 1 AS part FROM e, lim WHERE mask = 'val'), tv AS (SELECT * FROM e WHERE mask IN ('train', 'val')), "
         + _inc3_keys("user", "user_id") + ", " + _inc3_keys("event", "event_id") + ", " + _inc3_keys("property", "props"))

_HOMOGENEOUS = (
    "WITH " + EV + ", " + E + ", " + _ids("i_ev", "event_id", "e") + ", " + _ids("i_pr", "props", "e")
    + ", " + _ids("i_us", "user_id", "e")
    + ", cnt AS (SELECT (SELECT count(*) FROM i_ev) AS ne, (SELECT count(*) FROM i_pr) AS np), "
    "evf AS (SELECT i_ev.id, arg_min(e.\"value\", e.row_index) AS v, arg_min(e.label, e.row_index) AS lab "
    "FROM e JOIN i_ev USING (event_id) GROUP BY i_ev.id), "
    "usf AS (SELECT i_us.id, arg_min(e.\"value\", e.row_index) AS v FROM e JOIN i_us USING (user_id) GROUP BY i_us.id) "
    "SELECT id AS hid, 'event' AS ntype, id AS orig_id, round(coalesce(v, 0.0), 6) AS x_0, 0.0 AS x_1, "
    "round(coalesce(CAST(lab AS DOUBLE), 0.0), 6) AS label FROM evf "
    "UNION ALL SELECT id + ne, 'property', id, 0.0, 0.0, 0.0 FROM i_pr, cnt "
    "UNION ALL SELECT id + ne + np, 'user', id, 0.0, round(coalesce(v, 0.0), 6), 0.0 FROM usf, cnt"
)

_HOMOGENEOUS_EDGES = (
    "WITH " + EV + ", " + E + ", " + _ids("i_ev", "event_id", "e") + ", " + _ids("i_pr", "props", "e")
    + ", " + _ids("i_us", "user_id", "e")
    + ", x AS (SELECT e.row_index, i_ev.id AS ev, i_pr.id + (SELECT count(*) FROM i_ev) AS pr, "
    "i_us.id + (SELECT count(*) FROM i_ev) + (SELECT count(*) FROM i_pr) AS us FROM e LEFT JOIN i_ev USING (event_id) "
    "LEFT JOIN i_pr USING (props) LEFT JOIN i_us USING (user_id)), "
    "p AS (SELECT us AS src, ev AS dst, 'sends' AS etype, row_index AS orig_eid FROM x "
    "UNION ALL SELECT ev, us, 'sent_by', row_index FROM x UNION ALL SELECT ev, pr, 'has', row_index FROM x) "
    "SELECT * FROM p WHERE src IS NOT NULL AND dst IS NOT NULL"
)


SQL = {
    "transaction_view": (
        "WITH " + TX + " SELECT trans_num, cc_num, round(amt, 6) AS amt, category, \"timestamp\", label, city, job, "
        "round(city_pop, 6) AS city_pop, \"last\", CAST(dob AS VARCHAR) AS dob, merchant, "
        "CAST(first_order_date AS VARCHAR) AS first_order_date, first_order_merchant FROM tx"),
    "date_split_counts": (
        "WITH " + TX + ", " + B + " SELECT split_hpo, split_full, CAST(count(*) AS BIGINT) AS n_rows, "
        "CAST(sum(coalesce(label, 0)) AS BIGINT) AS n_pos, min(\"timestamp\") AS first_ts, max(\"timestamp\") AS last_ts "
        "FROM b GROUP BY 1, 2"),
    "filtered_dataset": (
        "WITH " + TX + " SELECT trans_num, CAST(label IS NOT NULL AS INTEGER) AS is_inference FROM tx WHERE "
        + _between("ts", _TS.from_date, _TS.to_test) + " AND amt > 100000 AND category <> '5-LOW'"),
    "positional_split": "WITH " + EV + ", " + E + " SELECT event_id, row_index, mask AS train_val_test_mask FROM e",
    "row_batches": (
        "WITH " + EV + ", " + E + ", t AS (SELECT * FROM e WHERE mask = 'test'), m AS (SELECT min(row_index) AS lo FROM t) "
        f"SELECT CAST(floor((row_index - lo) / {BATCH}) AS BIGINT) AS batch_id, CAST(count(*) AS BIGINT) AS n_rows, "
        "min(row_index) AS first_index, max(row_index) AS last_index FROM t, m GROUP BY 1"),
    "node_ids_customer": (
        "WITH " + TX + " SELECT cc_num, dense_rank() OVER (ORDER BY cc_num) - 1 AS node_id "
        "FROM (SELECT DISTINCT cc_num FROM tx WHERE cc_num IS NOT NULL)"),
    "node_ids_composite": (
        "WITH " + TX + " SELECT merchant, category, dense_rank() OVER (ORDER BY merchant NULLS FIRST, "
        "category NULLS FIRST) - 1 AS node_id FROM (SELECT DISTINCT merchant, category FROM tx)"),
    "validity_max_txs": (
        "SELECT l_suppkey, dense_rank() OVER (ORDER BY l_suppkey) - 1 AS node_id FROM "
        "(SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING count(*) < 600 AND l_suppkey IS NOT NULL)"),
    "validity_unique_customers": (
        "WITH " + TX + " SELECT city, dense_rank() OVER (ORDER BY city) - 1 AS node_id FROM "
        "(SELECT city FROM tx GROUP BY city HAVING city IS NOT NULL AND count(DISTINCT cc_num) + "
        "max(CASE WHEN cc_num IS NULL THEN 1 ELSE 0 END) BETWEEN 55 AND 66)"),
    "validity_unique_customers_nulls": (
        "WITH " + TX + ", j AS (SELECT job AS key FROM tx GROUP BY job HAVING job IS NOT NULL AND "
        "count(DISTINCT first_order_merchant) + max(CASE WHEN first_order_merchant IS NULL THEN 1 ELSE 0 END) >= 1), "
        "c AS (SELECT city AS key FROM tx GROUP BY city HAVING city IS NOT NULL AND "
        "count(DISTINCT first_order_merchant) + max(CASE WHEN first_order_merchant IS NULL THEN 1 ELSE 0 END) <= 40) "
        "SELECT 'job' AS rule, key, dense_rank() OVER (ORDER BY key) - 1 AS node_id FROM j "
        "UNION ALL SELECT 'city' AS rule, key, dense_rank() OVER (ORDER BY key) - 1 AS node_id FROM c"),
    "validity_min_length": (
        "WITH " + TX + " SELECT city, job, dense_rank() OVER (ORDER BY city, job) - 1 AS node_id FROM "
        "(SELECT DISTINCT city, job FROM tx WHERE city IS NOT NULL AND job IS NOT NULL AND length(city) > 6 "
        "AND length(job) > 8)"),
    "customer_nodes": (
        "WITH " + TX + ", " + B + ", " + _ids("ids", "cc_num", idcol="node_id")
        + ", r AS (SELECT ids.node_id, b.* FROM b JOIN ids USING (cc_num)), " + _std_ctes("r", _slog("city_pop"))
        + " SELECT node_id, min(\"timestamp\") AS time_attr, round(arg_max(" + _fill("z")
        + ", (\"timestamp\", trans_num)), 6) AS city_pop_log_standardize FROM f GROUP BY node_id"),
    "transaction_nodes": (
        "WITH " + TX + ", " + B + ", " + _ids("ids", "trans_num", idcol="node_id")
        + ", r AS (SELECT ids.node_id, b.*, coalesce(category, 'N/A') AS cat FROM b JOIN ids USING (trans_num)), "
        + _std_ctes("r", _slog("amt"))
        + " SELECT node_id, max(\"timestamp\") AS time_attr, "
        + ", ".join(f"round(arg_max(CASE WHEN cat = '{v}' THEN 1.0 ELSE 0.0 END, (\"timestamp\", trans_num)), 6) "
                    f"AS \"category_{v}\"" for v in ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))
        + ", round(arg_max(" + _fill("z") + ", (\"timestamp\", trans_num)), 6) AS amt_log_standardize, "
        "CAST(min(split_hpo) AS INTEGER) AS split_hpo, CAST(min(split_full) AS INTEGER) AS split_full, "
        "CAST(max(coalesce(label, 0)) AS INTEGER) AS label FROM f GROUP BY node_id"),
    "feat_signed_log": (
        "WITH " + TX + " SELECT trans_num, round(" + _slog("amt") + ", 6) AS amt_log, round(" + _slog("city_pop")
        + ", 6) AS city_pop_log FROM tx"),
    "feat_standardize": (
        "WITH " + TX + ", " + B + ", r AS (SELECT * FROM b WHERE cc_num IS NOT NULL), " + _std_ctes("r", _slog("city_pop"))
        + " SELECT trans_num, round(" + _fill("z") + ", 6) AS city_pop_log_standardize FROM f"),
    "feat_onehot_rare": (
        "WITH " + TX + ", " + B + ", r AS (SELECT trans_num, coalesce(category, 'N/A') AS cat FROM b "
        "WHERE trans_num IS NOT NULL), cnt AS (SELECT cat, count(*) AS n FROM r GROUP BY cat), "
        "top AS (SELECT cat FROM cnt ORDER BY n DESC, cat ASC LIMIT 3), "
        "c AS (SELECT trans_num, CASE WHEN (SELECT count(*) FROM cnt) > 3 AND cat NOT IN (SELECT cat FROM top) "
        "THEN 'RARE_VALUE' ELSE cat END AS col FROM r), v AS (SELECT min(col) AS first_v, count(DISTINCT col) AS k FROM c) "
        "SELECT trans_num, CASE WHEN col = first_v THEN NULL ELSE 'category_' || col END AS hot_column, "
        "CAST(k - 1 AS INTEGER) AS n_dummies FROM c, v"),
    "feat_label": (
        "SELECT p_partkey, round(CAST(dense_rank() OVER (ORDER BY coalesce(p_brand, 'N/A')) AS DOUBLE), 6) "
        "AS p_brand_label FROM part"),
    "feat_label_norm": (
        "SELECT p_partkey, round(CAST(dense_rank() OVER (ORDER BY coalesce(p_brand, 'N/A')) AS DOUBLE) / "
        "(SELECT count(DISTINCT coalesce(p_brand, 'N/A')) FROM part), 6) AS p_brand_label_norm FROM part"),
    "feat_target": (
        "WITH " + EV + ", b AS (SELECT *, " + _EV_FULL + " AS split_full FROM ev WHERE "
        + _between("ts", _ES.from_date, _ES.to_test) + "), "
        "tm AS (SELECT avg(CAST(label AS DOUBLE)) FILTER (WHERE split_full = 0) AS m FROM b), "
        "w AS (SELECT event_id, sum(CASE WHEN split_full = 0 AND label IS NOT NULL THEN label ELSE 0 END) OVER win AS sy, "
        "sum(CASE WHEN split_full = 0 AND label IS NOT NULL THEN 1 ELSE 0 END) OVER win AS cy FROM b "
        "WINDOW win AS (PARTITION BY coalesce(props, 'N/A') ORDER BY \"timestamp\", event_id "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) "
        "SELECT event_id, round(coalesce(CASE WHEN cy > 0 THEN CAST(sy AS DOUBLE) / cy END, tm.m, 0.05), 6) "
        "AS props_target FROM w, tm"),
    "zscore_train_fit": (
        "WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS idx "
        "FROM orders), n AS (SELECT count(*) AS n FROM orders), "
        "t AS (SELECT o.* FROM o, n WHERE idx <= CAST(n.n AS DOUBLE) * " + _R_TRAIN + "), "
        "st AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM t) "
        "SELECT o_orderkey, round((o_totalprice - st.m) / CASE WHEN st.s IS NULL OR st.s = 0 THEN 1 ELSE st.s END, 6) "
        "AS z FROM o, st"),
    "ordinal_encode": (
        "WITH " + EV + ", " + E + ", tr AS (SELECT * FROM e WHERE mask = 'train'), "
        "codes AS (SELECT props AS value, dense_rank() OVER (ORDER BY props) - 1 AS code FROM "
        "(SELECT DISTINCT props FROM tr WHERE props IS NOT NULL)) "
        "SELECT event_id, CAST(coalesce(code, -1) AS BIGINT) AS props_code FROM e LEFT JOIN codes ON e.props = codes.value"),
    "imbalance_ratio": (
        "WITH " + EV + ", " + E + " SELECT round(CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS DOUBLE) / "
        "sum(CASE WHEN label <> 0 THEN 1 ELSE 0 END), 6) AS imbalance_ratio FROM e WHERE mask = 'train'"),
    "feat_label_numeric": (
        "SELECT p_partkey, round(CAST(dense_rank() OVER (ORDER BY coalesce(p_size, 0)) AS DOUBLE), 6) "
        "AS p_size_label FROM part"),
    "ordinal_encode_numeric": (
        "WITH " + EV + ", " + E + ", codes AS (SELECT user_id AS u, dense_rank() OVER (ORDER BY user_id) - 1 AS code FROM "
        "(SELECT DISTINCT user_id FROM e WHERE mask = 'train' AND user_id IS NOT NULL)) "
        "SELECT event_id, CAST(coalesce(code, -1) AS BIGINT) AS user_code FROM e LEFT JOIN codes ON e.user_id = codes.u"),
    "zscore_with_nan": (
        "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS x, "
        "row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS idx FROM orders), "
        "n AS (SELECT count(*) AS n FROM orders), st AS (SELECT avg(x) AS m, stddev_pop(x) AS s FROM o, n "
        "WHERE idx <= CAST(n.n AS DOUBLE) * " + _R_TRAIN + ") SELECT o_orderkey, round((x - m) / s, 6) AS z FROM o, st"),
    "num_batches": (
        "WITH " + EV + ", " + E + f", t AS (SELECT row_index AS i FROM e WHERE mask = 'test' AND \"value\" > {SCORE_CENTER}) "
        f"SELECT CAST(coalesce(floor((max(i) - min(i)) / {BATCH}) + 1, 0) AS BIGINT) AS n_batches FROM t"),
    "homogeneous_edges": _HOMOGENEOUS_EDGES,
    "edges_two_definitions": (
        "WITH " + TX + ", " + B + ", " + _ids("ic", "cc_num", idcol="cid") + ", r AS (SELECT cid, city, "
        "first_order_merchant AS fom FROM b JOIN ic USING (cc_num)), " + _mono_pairs("m1", "cid", "city", "r") + ", "
        + _mono_pairs("m2", "cid", "fom", "r") + " SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM "
        "(SELECT * FROM m1 UNION ALL SELECT * FROM m2) GROUP BY 1, 2"),
    "graph_written_back": (
        "SELECT 'nodes' AS kind, node_type AS name, n_nodes AS n_rows FROM (" + _graph_summary() + ") UNION ALL "
        "SELECT 'edges', src_type || '__' || relation || '__' || dst_type, n_edges FROM (" + _node_centric() + ")"),
    "score_linear": "WITH " + EV + ", " + E + ", " + _PRED + " SELECT event_id, round(score, 6) AS score FROM p",
    "edges_mono_customer": (
        "WITH " + TX + ", " + B + ", " + _ids("it", "trans_num", idcol="tid") + ", " + _ids("ic", "cc_num", idcol="cid")
        + ", r AS (SELECT it.tid, ic.cid FROM b JOIN it USING (trans_num) JOIN ic USING (cc_num)), "
        + _mono_pairs("m", "tid", "cid", "r") + " SELECT src, dst, weight FROM m"),
    "edges_mono_weighted_nation": (
        "WITH " + TX + ", " + B + ", " + _ids("ic", "cc_num", idcol="cid") + ", " + _ids("ix", "city", idcol="xid")
        + ", r AS (SELECT ic.cid, ix.xid FROM b JOIN ic USING (cc_num) JOIN ix USING (city)), "
        + _mono_pairs("m", "cid", "xid", "r") + " SELECT src, dst, weight FROM m"),
    "edges_bipartite": (
        "WITH " + TX + ", " + B + ", " + _ids("it", "trans_num", idcol="tid") + ", " + _ids("im", "merchant", idcol="mid")
        + " SELECT DISTINCT it.tid AS src, im.mid AS dst FROM b JOIN it USING (trans_num) JOIN im USING (merchant)"),
    "edges_reverse": (
        "WITH " + TX + ", " + B + ", " + _ids("it", "trans_num", idcol="tid") + ", " + _ids("ic", "cc_num", idcol="cid")
        + " SELECT DISTINCT ic.cid AS src, it.tid AS dst FROM b JOIN it USING (trans_num) JOIN ic USING (cc_num)"),
    "edges_rowwise": (
        "WITH " + EV + ", " + E + ", " + _ids("u", "user_id", "e", "uid") + ", " + _ids("v", "event_id", "e", "vid")
        + " SELECT u.uid AS src, v.vid AS dst, e.row_index FROM e JOIN u USING (user_id) JOIN v USING (event_id)"),
    "graph_summary": _graph_summary(),
    "graph_checks": _graph_checks(),
    "preset_shared_attributes": _shared_attributes(),
    "preset_node_centric": _node_centric(),
    "preset_edge_centric": _edge_centric(),
    "homogeneous_nodes": _HOMOGENEOUS,
    "increment_new_ids": (
        _INC + " SELECT 'user' AS ntype, CAST(k AS VARCHAR) AS key, node_id FROM k_user "
        "UNION ALL SELECT 'event', CAST(k AS VARCHAR), node_id FROM k_event "
        "UNION ALL SELECT 'property', CAST(k AS VARCHAR), node_id FROM k_property"),
    "increment_features": (
        _INC + ", fv AS (SELECT user_id, arg_min(\"value\", row_index) AS v FROM va GROUP BY user_id), "
        "ft AS (SELECT user_id, arg_min(\"value\", row_index) AS v FROM tr GROUP BY user_id) "
        "SELECT k_user.node_id, round(coalesce(fv.v, ft.v), 6) AS \"value\" FROM k_user "
        "LEFT JOIN fv ON k_user.k = fv.user_id LEFT JOIN ft ON k_user.k = ft.user_id"),
    "increment_edges": (
        _INC + " SELECT 'sends' AS etype, ku.node_id AS src, ke.node_id AS dst, tv.row_index FROM tv "
        "JOIN k_user ku ON tv.user_id = ku.k JOIN k_event ke ON tv.event_id = ke.k "
        "UNION ALL SELECT 'sent_by', ke.node_id, ku.node_id, tv.row_index FROM tv "
        "JOIN k_user ku ON tv.user_id = ku.k JOIN k_event ke ON tv.event_id = ke.k "
        "UNION ALL SELECT 'has', ke.node_id, kp.node_id, tv.row_index FROM tv "
        "JOIN k_event ke ON tv.event_id = ke.k JOIN k_property kp ON tv.props = kp.k"),
    "increments_features": (
        _INC3 + ", every AS (SELECT user_id, 0 AS part, \"value\", row_index FROM tr UNION ALL SELECT user_id, part, \"value\", row_index FROM va), "
        "first_rows AS (SELECT user_id, part, arg_min(\"value\", row_index) AS v FROM every GROUP BY 1, 2) "
        "SELECT user_id, round(arg_max(v, part), 6) AS \"value\" FROM first_rows WHERE user_id IS NOT NULL GROUP BY user_id"),
    "propagated_features": _PROPAGATED,
    "train_score_nodes": _TRAIN_SCORE,
    "prequential_custom_scorer": (
        "WITH " + EV + ", " + E + ", lo AS (SELECT min(row_index) AS lo FROM e WHERE mask = 'test'), "
        "v AS (SELECT e.*, CASE WHEN mask = 'test' THEN CAST(floor((row_index - lo.lo) / " + str(BATCH) + ") AS BIGINT) ELSE -1 END AS vis FROM e, lo), "
        "u AS (SELECT user_id, vis, arg_min(\"value\", row_index) AS state, sum(\"value\") AS s, count(\"value\") AS c, count(*) AS n FROM v WHERE user_id IS NOT NULL GROUP BY 1, 2), "
        "uu AS (SELECT user_id, vis, state, sum(s) OVER o / sum(c) OVER o AS m, sum(n) OVER o AS n FROM u WINDOW o AS (PARTITION BY user_id ORDER BY vis)), "
        "p AS (SELECT props, vis, sum(\"value\") AS s, count(\"value\") AS c, count(*) AS n FROM v WHERE props IS NOT NULL GROUP BY 1, 2), "
        "pp AS (SELECT props, vis, sum(s) OVER o / sum(c) OVER o AS m, sum(n) OVER o AS n FROM p WINDOW o AS (PARTITION BY props ORDER BY vis)) "
        f"SELECT v.vis AS batch_id, event_id, round((0.8 * (\"value\" - {SCORE_CENTER}) + 0.5 * (coalesce(uu.state, {SCORE_CENTER}) - {SCORE_CENTER}) "
        f"+ 0.3 * (coalesce(uu.m, {SCORE_CENTER}) - {SCORE_CENTER}) - 0.2 * (coalesce(pp.m, {SCORE_CENTER}) - {SCORE_CENTER})) / {SCORE_SCALE} "
        "+ 0.1 * ln(1 + coalesce(uu.n, 0)) - 0.05 * ln(1 + coalesce(pp.n, 0)), 6) AS score, CAST(label AS INTEGER) AS label "
        "FROM v LEFT JOIN uu ON uu.user_id = v.user_id AND uu.vis = v.vis LEFT JOIN pp ON pp.props = v.props AND pp.vis = v.vis WHERE mask = 'test'"),
    "stream_graph_features": (
        "SELECT 'event' AS ntype, CAST(event_id AS VARCHAR) AS key, round(arg_max(\"value\", (ts, event_id)), 6) AS \"value\", "
        "CAST(count(*) AS BIGINT) AS n_obs FROM events WHERE event_id IS NOT NULL GROUP BY event_id "
        "UNION ALL SELECT 'user', CAST(user_id AS VARCHAR), round(arg_max(\"value\", (ts, event_id)), 6), "
        "CAST(count(*) AS BIGINT) FROM events WHERE user_id IS NOT NULL GROUP BY user_id "
        "UNION ALL SELECT 'property', props, CAST(NULL AS DOUBLE), CAST(count(*) AS BIGINT) FROM events "
        "WHERE props IS NOT NULL GROUP BY props"),
    "stream_edges": (
        "SELECT 'user__sends__event' AS etype, CAST(count(*) AS BIGINT) AS n_edges, "
        "CAST(count(DISTINCT (user_id, event_id)) AS BIGINT) AS n_distinct FROM events "
        "WHERE user_id IS NOT NULL AND event_id IS NOT NULL "
        "UNION ALL SELECT 'event__has__property', CAST(count(*) AS BIGINT), "
        "CAST(count(DISTINCT (event_id, props)) AS BIGINT) FROM events WHERE event_id IS NOT NULL AND props IS NOT NULL"),
    "neighbor_sample_2hop": _sample_uniform(),
    "neighbor_sample_temporal_last": _sample_temporal("last"),
    "neighbor_sample_temporal_uniform": _sample_temporal("uniform"),
    "neighbor_aggregate": _NEIGHBOR_AGG,
    "precision_recall": (
        "WITH " + EV + ", " + E + ", " + _PRED + " SELECT CAST(count(*) AS BIGINT) AS num_samples, round(" + _PREC
        + ", 6) AS precision, round(" + _REC + ", 6) AS recall FROM p"),
    "weighted_log_loss": "WITH " + EV + ", " + E + ", " + _PRED + " SELECT round(" + _LOSS + ", 6) AS loss FROM p, w",
    "pr_curve": (
        "WITH " + EV + ", " + E + ", " + _PRED + ", g AS (SELECT score AS threshold, sum(label) AS pos, count(*) AS cnt "
        "FROM p GROUP BY score), c AS (SELECT threshold, sum(pos) OVER o AS tp, sum(cnt) OVER o AS pp FROM g "
        "WINDOW o AS (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), "
        "tot AS (SELECT sum(label) AS P FROM p) "
        "SELECT round(threshold, 6) AS threshold, round(CAST(tp AS DOUBLE) / pp, 6) AS precision, "
        "round(CASE WHEN P > 0 THEN CAST(tp AS DOUBLE) / P ELSE 1.0 END, 6) AS recall FROM c, tot "
        "UNION ALL SELECT CAST(NULL AS DOUBLE), 1.0, 0.0"),
    "evaluation_summary": (
        "WITH " + EV + ", " + E + ", " + _PRED + " SELECT 'testing' AS mode, CAST(count(*) AS BIGINT) AS num_samples, "
        "round(" + _PREC + ", 6) AS precision, round(" + _REC + ", 6) AS recall, round(" + _LOSS + ", 6) AS loss FROM p, w"),
    "prequential_scores": (
        "WITH " + EV + ", " + E + ", lo AS (SELECT min(row_index) AS lo FROM e WHERE mask = 'test'), "
        "v AS (SELECT e.*, CASE WHEN mask IN ('train', 'val') THEN -1 WHEN mask = 'test' THEN "
        f"CAST(floor((row_index - lo.lo) / {BATCH}) AS BIGINT) END AS vis FROM e, lo), "
        "per AS (SELECT user_id, vis, sum(\"value\") AS s, count(\"value\") AS n FROM v WHERE vis IS NOT NULL "
        "AND user_id IS NOT NULL GROUP BY 1, 2), "
        "run AS (SELECT user_id, vis, sum(s) OVER o AS rs, sum(n) OVER o AS rn FROM per "
        "WINDOW o AS (PARTITION BY user_id ORDER BY vis ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) "
        "SELECT v.vis AS batch_id, v.event_id, round(1.0 * coalesce(v.\"value\", 0.0) + 1.0 * coalesce(CASE WHEN "
        "run.rn > 0 THEN run.rs / run.rn END, 0.0) + 0.0, 9) AS score, CAST(v.label AS INTEGER) AS label "
        "FROM v LEFT JOIN run ON v.user_id = run.user_id AND v.vis = run.vis WHERE v.mask = 'test'"),
    "csv_round_trip": "SELECT r_regionkey, r_name FROM region",
}
SQL["summary_written_back"] = SQL["evaluation_summary"]
for _name in ("new_ids", "edges"):  # the same question after three increments
    SQL[f"increments_{_name}"] = SQL[f"increment_{_name}"].replace(_INC, _INC3)
