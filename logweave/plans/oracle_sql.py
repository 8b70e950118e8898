"""Plain-SQL (DuckDB dialect) definitions of every registered query, for the oracle check.

The same derived views as ``logweave.sources.tables`` and the same rules as the operators,
written the straightforward way (whole-partition windows, string_agg); the Spark side
computes them distributed.
"""

from __future__ import annotations

from logweave.functions.text import KEYWORDS, V1_LINE_PATTERN, keyed_mask_pattern
from logweave.operators.detect import DOC_KEYWORDS
from logweave.operators.flows import COVER_FLOWS, EVENT_FLOWS, flow_variants, step_template
from logweave.operators.splits import INCIDENTS, SEED, SELECTION, VAL_SHARE
from logweave.sources.tables import BROKEN_SQL, ORDER_SPLIT_SQL, order_text_sql


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple], cols: list[str], name: str) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return str(v)
        return q(str(v))
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    names = ", ".join(f'"{c}"' for c in cols)
    return f"{name} AS (SELECT * FROM (VALUES {body}) t({names}))"


MASK = keyed_mask_pattern()

LOG_LINES = f"""
ll0 AS (
  SELECT event_id AS line_no, ts, event_type, user_id, value,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS level,
    event_type || '-service' AS service,
    'u' || CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS trace_id,
    event_type || ' handled user=' || CAST(user_id AS VARCHAR) || ' key=' || CAST(event_id AS VARCHAR) AS message
  FROM events),
log_lines AS (
  SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS ts_text,
    'host-' || CAST(user_id % 4 AS VARCHAR) AS host,
    CASE WHEN value < 1.0 THEN '-' ELSE trace_id END AS corr_id,
    strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S.%g') || '+01:00' AS ts_local,
    service || ' ' || level || ' ' || message AS content,
    regexp_replace(service || ' ' || level || ' ' || message, {q(MASK)}, '\\1=<*>', 'g') AS template,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z ' || level || ' ' || service || ' trace=' || trace_id || ' ' || message AS raw,
    strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S.%g') || '+01:00 ' || level || ' ' || service
      || ' host=host-' || CAST(user_id % 4 AS VARCHAR) || ' corrId='
      || (CASE WHEN value < 1.0 THEN '-' ELSE trace_id END) || ' ' || message AS raw_prod
  FROM ll0),
tl AS (
  SELECT trace_id, ts, line_no, level, service, content, template,
    CAST(row_number() OVER (PARTITION BY trace_id ORDER BY ts, line_no) - 1 AS BIGINT) AS idx
  FROM log_lines)"""


BROKEN = f"""
broken0 AS (
  SELECT strftime(ts, '%Y%m%d') AS day, {BROKEN_SQL} AS value,
    CAST(row_number() OVER (PARTITION BY strftime(ts, '%Y%m%d') ORDER BY line_no) AS BIGINT) AS line_no
  FROM log_lines),
broken AS (
  SELECT *, CASE WHEN trim(value) = '' THEN 'blank' WHEN NOT regexp_matches(value, {q(V1_LINE_PATTERN)}) THEN 'shape'
    WHEN try_cast(regexp_extract(value, '^(\\S+)', 1) AS TIMESTAMPTZ) IS NULL THEN 'timestamp' END AS reason
  FROM broken0)"""


def _flow_tables(flows=EVENT_FLOWS) -> str:
    first, match, nexp, what, names, opt = [], [], [], [], [], []
    seen_first = set()
    for f in sorted(flows, key=lambda f: f.name):
        t = step_template(f.steps[0].service, f.steps[0].level, f.steps[0].message)
        if t not in seen_first:
            seen_first.add(t)
            first.append((t, f.name))
    for f in flows:
        pos = {s.step: i for i, s in enumerate(f.steps)}
        nexp.append((f.name, len(f.steps)))
        for i, s in enumerate(f.steps):
            match.append((f.name, step_template(s.service, s.level, s.message), 0, i))
            what.append((f.name, i, s.what))
            names.append((f.name, i, s.step))
        for o in f.optional:
            t = step_template(o.service, o.level, o.message)
            opt.append((f.name, t))
            for j, c in enumerate(o.covers):
                match.append((f.name, t, j, pos[c]))
    errm = []
    for f in flows:
        for i, st in enumerate(f.steps):
            errm.append((f.name, st.service, step_template(st.service, st.level, st.message).split(" ", 2)[2], i))
    return ",\n".join([
        values(errm, ["flow", "service", "msg", "pos"], "f_errmatch"),
        values(first, ["template", "flow"], "f_first"),
        values(match, ["flow", "template", "sub", "pos"], "f_match"),
        values(nexp, ["flow", "n_exp"], "f_nexp"),
        values(what, ["flow", "pos", "what"], "f_what"),
        values(names, ["flow", "pos", "step"], "f_names"),
        values(opt, ["flow", "template"], "f_opt"),
    ])


_CONFORMANCE_RULES = """
heads0 AS (
  SELECT trace_id, count(*) AS n_lines, arg_min(template, idx) AS first_template,
    min(idx) FILTER (WHERE level = 'ERROR') AS err_line,
    arg_min(service, idx) FILTER (WHERE level = 'ERROR') AS err_service
  FROM tl GROUP BY trace_id),
heads AS (
  SELECT h.*, coalesce(f.flow, 'unknown') AS flow, coalesce(n.n_exp, 0) AS n_exp
  FROM heads0 h LEFT JOIN f_first f ON f.template = h.first_template
  LEFT JOIN f_nexp n ON n.flow = f.flow),
obs0 AS (
  SELECT l.trace_id, h.flow, h.n_exp, l.idx, m.sub, m.pos
  FROM tl l JOIN heads h ON h.trace_id = l.trace_id AND h.flow <> 'unknown'
  JOIN f_match m ON m.flow = h.flow AND m.template = l.template),
obs1 AS (
  SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY idx, sub) - 1 AS k FROM obs0),
obs AS (
  SELECT *, lag(pos, 1) OVER w AS prev_pos, lag(pos, 2) OVER w AS prev2_pos,
    lag(idx, 1) OVER w AS prev_idx
  FROM obs1 WINDOW w AS (PARTITION BY trace_id ORDER BY k)),
oagg AS (
  SELECT trace_id, count(*) AS n_obs, count(DISTINCT pos) AS n_distinct, max(pos) AS max_pos,
    count(*) FILTER (WHERE pos = k) AS n_match,
    arg_min(idx, k) FILTER (WHERE k >= n_exp OR pos <> k) AS bad_line,
    arg_min(pos, k) FILTER (WHERE k >= n_exp OR pos <> k) AS bad_pos,
    min(k) FILTER (WHERE k >= n_exp OR pos <> k) AS bad_k,
    arg_min(prev_idx, k) FILTER (WHERE pos = prev_pos AND prev_pos = prev2_pos) AS storm_line,
    arg_min(pos, k) FILTER (WHERE pos = prev_pos AND prev_pos = prev2_pos) AS storm_pos,
    bool_or(coalesce(pos < prev_pos, false)) AS decreases,
    arg_max(pos, k) AS last_pos
  FROM obs GROUP BY trace_id),
ostep AS (
  SELECT trace_id, pos, count(*) AS n, string_agg(CAST(idx AS VARCHAR), ', ' ORDER BY idx) FILTER (WHERE turn <= 1000)
    || CASE WHEN count(*) > 1000 THEN ', and ' || CAST(count(*) - 1000 AS VARCHAR) || ' more' ELSE '' END AS lines
  FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, pos ORDER BY idx, sub) AS turn FROM obs) GROUP BY trace_id, pos),
t0 AS (
  SELECT h.trace_id, h.flow, h.n_lines, h.err_line, h.err_service, h.n_exp,
    coalesce(o.n_obs, 0) AS n_obs, coalesce(o.n_distinct, 0) AS n_distinct,
    coalesce(o.n_match, 0) AS n_match, o.max_pos, o.bad_line, o.bad_pos, o.bad_k, o.storm_line,
    o.storm_pos, o.decreases, o.last_pos, s.n AS storm_n
  FROM heads h LEFT JOIN oagg o ON o.trace_id = h.trace_id
  LEFT JOIN ostep s ON s.trace_id = h.trace_id AND s.pos = o.storm_pos),
t1 AS (
  SELECT *, CASE
    WHEN flow = 'unknown' THEN 'other'
    WHEN err_line IS NOT NULL THEN 'visible_error'
    WHEN storm_line IS NOT NULL THEN 'retry_storm'
    WHEN n_obs = n_exp AND n_match = n_exp THEN 'none'
    WHEN n_distinct = n_exp AND decreases THEN 'wrong_order'
    WHEN n_obs < n_exp AND n_match = n_obs THEN 'truncated'
    WHEN n_distinct < max_pos + 1 THEN 'silent_skip'
    ELSE 'other' END AS anomaly_type
  FROM t0),
t2 AS (
  SELECT t1.*,
    CASE WHEN anomaly_type = 'none' THEN 'normal' ELSE 'anomalous' END AS verdict,
    CAST(CASE WHEN t1.flow = 'unknown' THEN 0
      WHEN anomaly_type = 'visible_error' THEN err_line
      WHEN anomaly_type = 'retry_storm' THEN storm_line
      WHEN anomaly_type = 'none' THEN NULL
      WHEN anomaly_type = 'truncated' THEN n_lines
      ELSE bad_line END AS BIGINT) AS first_deviation_line,
    ws.what AS storm_what, wb.what AS bad_what, wl.what AS last_what, wk.what AS badk_what
  FROM t1
  LEFT JOIN f_what ws ON ws.flow = t1.flow AND ws.pos = t1.storm_pos
  LEFT JOIN f_what wb ON wb.flow = t1.flow AND wb.pos = t1.bad_pos
  LEFT JOIN f_what wl ON wl.flow = t1.flow AND wl.pos = t1.last_pos
  LEFT JOIN f_what wk ON wk.flow = t1.flow AND wk.pos = t1.bad_k),
t3 AS (
  SELECT *, CASE
    WHEN flow = 'unknown' THEN 'No expected flow starts like this trace.'
    WHEN anomaly_type = 'none' THEN printf('%s: all expected steps found, each once and in order.', flow)
    WHEN anomaly_type = 'visible_error' THEN printf('%s: line %d is the first at ERROR level, logged by %s.', flow, err_line, err_service)
    WHEN anomaly_type = 'retry_storm' THEN printf('%s: step %s has %d lines and repeats itself from line %d.', flow, storm_what, storm_n, storm_line)
    WHEN anomaly_type = 'wrong_order' THEN printf('%s: step %s stands too early, at line %d.', flow, bad_what, bad_line)
    WHEN anomaly_type = 'truncated' THEN printf('%s: last known step is %s, later steps have no line.', flow, last_what)
    WHEN anomaly_type = 'silent_skip' THEN printf('%s: no line for step %s before the one at line %d.', flow, badk_what, bad_line)
    ELSE printf('%s: line %d deviates from the expected steps.', flow, bad_line) END AS explanation
  FROM t2),
errstep AS (
  SELECT l.trace_id, m.pos, min(l.idx) AS err_idx
  FROM tl l JOIN heads h ON h.trace_id = l.trace_id AND h.flow <> 'unknown'
  JOIN f_errmatch m ON m.flow = h.flow AND m.service = l.service
    AND m.msg = regexp_replace(l.template, '^\\S+ \\S+ ', '')
  WHERE l.level = 'ERROR' GROUP BY l.trace_id, m.pos),
scheck AS (
  SELECT h.trace_id, string_agg(fn.step || ': ' || CASE WHEN e.err_idx IS NOT NULL THEN 'ERROR ' || CAST(e.err_idx AS VARCHAR)
      WHEN s.n IS NULL THEN 'missing' ELSE s.lines END, '; ' ORDER BY fn.pos) AS step_check
  FROM heads h JOIN f_names fn ON fn.flow = h.flow
  LEFT JOIN ostep s ON s.trace_id = h.trace_id AND s.pos = fn.pos
  LEFT JOIN errstep e ON e.trace_id = h.trace_id AND e.pos = fn.pos
  GROUP BY h.trace_id),
answers AS (
  SELECT t3.trace_id, flow, n_lines, verdict, anomaly_type, first_deviation_line,
    coalesce(sc.step_check, '') AS step_check, explanation
  FROM t3 LEFT JOIN scheck sc ON sc.trace_id = t3.trace_id)"""

CONFORMANCE = _flow_tables() + "," + _CONFORMANCE_RULES

_TOLD_BY_FIRST = "LEFT JOIN f_first f ON f.template = h.first_template"
# The alignment by one row per trace, flow and line: the vector of costs per flow position moves line by line.
ALIGNMENT = """
al_act AS (SELECT flow, template, min(pos) AS p, count(*) AS c FROM f_match GROUP BY flow, template),
al_line AS (
  SELECT l.trace_id, l.idx, n.flow, n.n_exp, a.p, a.c, CASE WHEN o.template IS NULL THEN 1 ELSE 0 END AS e
  FROM tl l CROSS JOIN f_nexp n LEFT JOIN al_act a ON a.flow = n.flow AND a.template = l.template
  LEFT JOIN f_opt o ON o.flow = n.flow AND o.template = l.template),
al AS (
  SELECT DISTINCT trace_id, flow, n_exp, CAST(-1 AS BIGINT) AS idx, CAST(0 AS BIGINT) AS dropped, range(0, n_exp + 1) AS v FROM al_line
  UNION ALL
  SELECT al.trace_id, al.flow, al.n_exp, l.idx, al.dropped + l.e,
    list_transform(range(1, al.n_exp + 2), lambda q: least(al.v[q] + l.e,
      CASE WHEN l.p IS NOT NULL AND q - 1 >= l.p + l.c THEN al.v[l.p + 1] + (q - 1) - l.p - l.c ELSE al.v[q] + l.e END))
  FROM al JOIN al_line l ON l.trace_id = al.trace_id AND l.flow = al.flow AND l.idx = al.idx + 1),
al_cost AS (
  SELECT trace_id, flow, arg_max(v[n_exp + 1], idx) AS cost, max(dropped) + any_value(n_exp) AS worst
  FROM al GROUP BY trace_id, flow),
al_best AS (
  SELECT trace_id, first(flow ORDER BY cost, cost - worst, flow) AS flow, min(cost) AS cost
  FROM al_cost WHERE cost < worst GROUP BY trace_id),
"""


def aligned(flows) -> str:
    """Conformance with the flow told by alignment; needs WITH RECURSIVE."""
    rules = _CONFORMANCE_RULES.replace(_TOLD_BY_FIRST, "LEFT JOIN al_best f ON f.trace_id = h.trace_id")
    return _flow_tables(flows) + "," + ALIGNMENT + rules


ALIGNED = "WITH RECURSIVE " + LOG_LINES.strip() + ",\n" + aligned(EVENT_FLOWS)
ALIGNED_COVER = "WITH RECURSIVE " + LOG_LINES.strip() + ",\n" + aligned(COVER_FLOWS)

INCIDENT_TABLE = values(
    [(i, t, f, a, s, e, n) for n, (i, t, f, a, s, e) in enumerate(INCIDENTS)],
    ["id", "title", "flow", "precursor_start", "start", "end", "list_pos"], "inc_raw")

INCIDENTS_TYPED = INCIDENT_TABLE + """,
incidents AS (
  SELECT id, title, flow, list_pos,
    CAST(strptime(precursor_start, '%Y-%m-%dT%H:%M:%S%z') AT TIME ZONE 'UTC' AS TIMESTAMP) AS precursor_start,
    CAST(strptime(start, '%Y-%m-%dT%H:%M:%S%z') AT TIME ZONE 'UTC' AS TIMESTAMP) AS start,
    CAST(strptime("end", '%Y-%m-%dT%H:%M:%S%z') AT TIME ZONE 'UTC' AS TIMESTAMP) AS "end"
  FROM inc_raw)"""

_OPT_COUNT = """
opt_n AS (
  SELECT l.trace_id, count(*) FILTER (WHERE o.template IS NOT NULL) AS n_optional
  FROM tl l JOIN heads h ON h.trace_id = l.trace_id AND h.flow <> 'unknown'
  LEFT JOIN f_opt o ON o.flow = h.flow AND o.template = l.template
  GROUP BY l.trace_id)"""

TRUTH = _OPT_COUNT + """,
truth0 AS (
  SELECT a.trace_id, a.flow, st.start, CAST(a.verdict = 'anomalous' AS INTEGER) AS label,
    a.anomaly_type, a.first_deviation_line AS first_deviation_index,
    coalesce(o.n_optional, 0) AS n_optional
  FROM answers a JOIN (SELECT trace_id, min(ts) AS start FROM log_lines GROUP BY trace_id) st
    ON st.trace_id = a.trace_id
  LEFT JOIN opt_n o ON o.trace_id = a.trace_id),
truth_ph AS (
  SELECT t.*, i.id AS incident_id, i.list_pos,
    CASE WHEN i.id IS NULL THEN 'background' WHEN t.start >= i.start THEN 'incident'
      ELSE 'precursor' END AS phase
  FROM truth0 t LEFT JOIN incidents i
    ON t.flow = i.flow AND t.start >= i.precursor_start AND t.start <= i."end"),
truth AS (
  SELECT trace_id, flow, start, label, anomaly_type, first_deviation_index, n_optional,
    arg_min(incident_id, list_pos) AS incident_id,
    coalesce(arg_min(phase, list_pos), 'background') AS phase
  FROM truth_ph
  GROUP BY trace_id, flow, start, label, anomaly_type, first_deviation_index, n_optional)"""


def _md5(col: str) -> str:
    return f"md5({q(SEED + ':')} || {col})"


def _quota_rows() -> str:
    return values(list(SELECTION["anomalous_quota"].items()), ["stratum", "quota"], "quota")


SPLITS = _quota_rows() + f""",
known AS (SELECT *, {_md5('trace_id')} AS h FROM truth WHERE flow <> 'unknown'),
anom AS (SELECT *, CASE WHEN phase = 'incident' THEN incident_id ELSE 'background' END AS stratum
  FROM known WHERE label = 1),
anom_q AS (
  SELECT a.* FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h) AS rn FROM anom) a
  JOIN quota q ON q.stratum = a.stratum WHERE a.rn <= q.quota),
anom_fill AS (
  SELECT * FROM anom WHERE trace_id NOT IN (SELECT trace_id FROM anom_q)
  ORDER BY h LIMIT greatest({SELECTION['anomalous']} - (SELECT count(*) FROM anom_q), 0)),
hard AS (
  SELECT * FROM known WHERE label = 0 AND phase = 'precursor' AND n_optional > 0
  ORDER BY h LIMIT {SELECTION['hard_negatives']}),
rr AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY flow ORDER BY h) AS turn
    FROM known WHERE label = 0 AND trace_id NOT IN (SELECT trace_id FROM hard))
  ORDER BY turn, flow LIMIT greatest({SELECTION['normal']} - (SELECT count(*) FROM hard), 0)),
test_ids AS (
  SELECT trace_id FROM anom_q UNION ALL SELECT trace_id FROM anom_fill
  UNION ALL SELECT trace_id FROM hard UNION ALL SELECT trace_id FROM rr),
pool AS (
  SELECT t.trace_id, {_md5('t.trace_id')} AS h FROM truth t
  WHERE t.trace_id NOT IN (SELECT trace_id FROM test_ids)
    AND NOT EXISTS (SELECT 1 FROM incidents i
                    WHERE t.start >= i.precursor_start AND t.start <= i."end")),
pool_r AS (SELECT trace_id, row_number() OVER (ORDER BY h) AS r FROM pool),
splits AS (
  SELECT trace_id, 'test' AS split FROM test_ids
  UNION ALL
  SELECT trace_id, CASE WHEN r <= round_even((SELECT count(*) FROM pool) * {VAL_SHARE}, 0)
    THEN 'val' ELSE 'train' END AS split FROM pool_r)"""

EVAL_RECORDS = f"""
docs AS (
  SELECT d.doc_id, d.text, d.lang, d.n_chars, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
doc_hit AS (
  SELECT *, list_position(list_transform(string_split(text, chr(10)),
      lambda x: regexp_matches(x, {q('(?i)(' + DOC_KEYWORDS + ')')})), true) AS p,
    string_split(text, chr(10)) AS ls
  FROM docs),
eval_records AS (
  SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS trace_id, doc_id,
    CAST(1 - quality AS INTEGER) AS label,
    CASE WHEN 1 - quality = 1 THEN lang ELSE 'none' END AS anomaly_type,
    coalesce(p, 0) > 0 AS flagged, CAST(n_chars AS DOUBLE) AS score,
    CAST(CASE WHEN coalesce(p, 0) > 0 THEN p - 1 END AS INTEGER) AS pred_index,
    CAST(doc_id % 5 AS INTEGER) AS first_deviation_index,
    CASE WHEN coalesce(p, 0) > 0 THEN ls[p] ELSE '' END AS worst_line_text
  FROM doc_hit)"""

def surprise(order: int, calibrate_below: str) -> str:
    """Back-off model, line and trace scores and threshold, over tl, splits, truth and the flow definitions."""
    variants = values([(f"variant-{n}", i, t) for n, seq in enumerate(flow_variants()) for i, t in enumerate(seq)],
                      ["trace_id", "idx", "template"], "f_variants")
    lags = ", ".join(f"CASE WHEN idx >= {k} THEN lag(next, {k}) OVER w WHEN idx = {k - 1} THEN '<START>' END AS p{k}"
                     for k in range(1, order + 1))
    contexts = " UNION ALL ".join(
        f"SELECT *, {k} AS k, md5({'concat_ws(chr(1), ' + ', '.join(f'p{j}' for j in range(k, 0, -1)) + ')' if k else q('')}) AS context"
        f" FROM hist{f' WHERE p{k} IS NOT NULL' if k else ''}" for k in range(order + 1))
    per_level = ", ".join(f"max({x}) FILTER (WHERE k = {k}) AS {x}{k}" for k in range(order + 1) for x in "cnt")
    mixed = ",\n".join(
        f"lv{k} AS (SELECT *, CASE WHEN n{k} IS NULL THEN q{k - 1} ELSE (c{k} + t{k} * q{k - 1}) / (n{k} + t{k}) END AS q{k} "
        f"FROM lv{k - 1})".replace("q-1", "u").replace("lv-1", "lv") for k in range(order + 1))
    return variants + f""",
lws AS (
  SELECT l.trace_id, l.idx, l.template, s.split, CASE WHEN t.label = 0 AND s.split IN ('train', 'val') THEN
    CASE WHEN md5('surprise:' || l.trace_id) < {q(calibrate_below)} THEN 'calibrate' ELSE 'learn' END END AS role
  FROM tl l JOIN splits s ON s.trace_id = l.trace_id JOIN truth t ON t.trace_id = l.trace_id),
seq0 AS (
  SELECT trace_id, split, role, idx, template AS next FROM lws
  UNION ALL SELECT trace_id, 'variant', 'learn', CAST(idx AS BIGINT), template FROM f_variants),
seq AS (
  SELECT * FROM seq0
  UNION ALL SELECT trace_id, any_value(split), any_value(role), max(idx) + 1, '<END>' FROM seq0 GROUP BY trace_id),
hist AS (SELECT *, {lags} FROM seq WINDOW w AS (PARTITION BY trace_id ORDER BY idx)),
ctx AS ({contexts}),
model AS (SELECT k, context, next, count(*) AS n FROM ctx WHERE role = 'learn' GROUP BY k, context, next),
tot AS (SELECT k, context, CAST(sum(n) AS BIGINT) AS n, count(*) AS t FROM model GROUP BY k, context),
vocab AS (SELECT count(DISTINCT next) + 2 AS v FROM model WHERE next <> '<END>'),
lv AS (
  SELECT trace_id, any_value(split) AS split, any_value(role) AS role, idx, any_value(next) AS next, 1.0 / (SELECT v FROM vocab) AS u,
    {per_level}
  FROM (SELECT c.*, CAST(coalesce(m.n, 0) AS DOUBLE) AS c, CAST(t.n AS DOUBLE) AS n, CAST(t.t AS DOUBLE) AS t
        FROM ctx c LEFT JOIN tot t ON t.k = c.k AND t.context = c.context
        LEFT JOIN model m ON m.k = c.k AND m.context = c.context AND m.next = c.next WHERE c.split <> 'variant')
  GROUP BY trace_id, idx),
{mixed},
ls AS (SELECT trace_id, split, role, idx, next, -ln(q{order}) AS surprise FROM lv{order}),
ts AS (
  SELECT trace_id, split, role, max(surprise) AS score,
    first(idx ORDER BY surprise DESC, idx ASC) AS pred_index,
    first(CASE WHEN next = '<END>' THEN 'TRACE END' ELSE next END ORDER BY surprise DESC, idx ASC) AS worst_line_text,
    avg(surprise) AS mean_nll
  FROM ls GROUP BY trace_id, split, role),
thr AS (SELECT quantile_cont(score, 0.99) AS threshold FROM ts WHERE role = 'calibrate')"""


ORDER_LINES = f"""
order_lines AS (
  SELECT CAST(o_orderkey AS BIGINT) AS line_no, o_orderdate AS ts, 'c' || CAST(o_custkey AS VARCHAR) AS trace_id,
    {ORDER_SPLIT_SQL} AS split, {order_text_sql("VARCHAR")} AS text
  FROM orders)"""


def _similar(src: str, p: str) -> str:
    """Clusters of similar lines inside a split by comparing all pairs: ``{p}_m(split, text, template)``."""
    head = "list_transform({0}.tok[1:2], lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END)"
    return f"""
{p}_l AS (SELECT DISTINCT split, text, string_split(text, ' ') AS tok FROM {src}),
{p}_e AS (
  SELECT a.split, a.text AS x, b.text AS y FROM {p}_l a JOIN {p}_l b
    ON a.split = b.split AND len(a.tok) = len(b.tok) AND {head.format("a")} = {head.format("b")}
    AND 100 * len(list_filter(list_zip(a.tok, b.tok), lambda z: z[1] = z[2])) >= 90 * len(a.tok)),
{p}_r AS (SELECT split, x, y FROM {p}_e UNION SELECT r.split, r.x, e.y FROM {p}_r r JOIN {p}_e e ON e.split = r.split AND e.x = r.y),
{p}_c AS (SELECT split, x AS text, min(y) AS comp FROM {p}_r GROUP BY split, x),
{p}_k AS (
  SELECT split, comp, i, CASE WHEN count(DISTINCT t) = 1 THEN min(t) ELSE '<*>' END AS tok
  FROM (SELECT c.split, c.comp, unnest(range(1, len(l.tok) + 1)) AS i, unnest(l.tok) AS t
        FROM {p}_c c JOIN {p}_l l ON l.split = c.split AND l.text = c.text) GROUP BY split, comp, i),
{p}_t AS (SELECT split, comp, string_agg(tok, ' ' ORDER BY i) AS template FROM {p}_k GROUP BY split, comp),
{p}_m AS (SELECT c.split, c.text, t.template FROM {p}_c c JOIN {p}_t t ON t.split = c.split AND t.comp = c.comp)"""


SIMILAR_TEMPLATES = "WITH RECURSIVE " + ORDER_LINES.strip() + """,
st_train AS (SELECT split, text FROM order_lines WHERE split = 'train'),""" + _similar("st_train", "tr") + """,
st_later AS (SELECT DISTINCT split, text FROM order_lines WHERE split <> 'train'),
st_wild AS (
  SELECT DISTINCT template, string_split(template, ' ') AS fixed FROM tr_m WHERE list_contains(string_split(template, ' '), '<*>')),
st_fit AS (
  SELECT l.text, first(w.template ORDER BY len(list_filter(w.fixed, lambda f: f = '<*>')), w.template) AS template
  FROM (SELECT DISTINCT text, string_split(text, ' ') AS tok FROM st_later) l JOIN st_wild w ON len(w.fixed) = len(l.tok)
    AND len(list_filter(list_zip(w.fixed, l.tok), lambda z: z[1] <> '<*>' AND z[1] <> z[2])) = 0
  GROUP BY l.text),
st_placed AS (
  SELECT l.split, l.text, coalesce(m.template, f.template) AS template
  FROM st_later l LEFT JOIN tr_m m ON m.text = l.text LEFT JOIN st_fit f ON f.text = l.text),
st_rest AS (SELECT split, text FROM st_placed WHERE template IS NULL),""" + _similar("st_rest", "ow") + """,
st_all AS (
  SELECT split, text, template FROM tr_m UNION ALL SELECT split, text, template FROM st_placed WHERE template IS NOT NULL
  UNION ALL SELECT split, text, template FROM ow_m),
st_lines AS (
  SELECT o.*, a.template, CASE o.split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 4 END AS sr
  FROM order_lines o JOIN st_all a ON a.split = o.split AND a.text = o.text),
st_first AS (
  SELECT *, row_number() OVER (PARTITION BY template ORDER BY sr, ts, line_no) AS turn FROM st_lines),
st_ids AS (
  SELECT template, row_number() OVER (ORDER BY sr, ts, line_no, template) AS id FROM st_first WHERE turn = 1),
st_dict AS (
  SELECT i.id, i.template AS text, count(*) AS count, count(*) FILTER (WHERE l.split = 'train') AS train_count,
    count(*) FILTER (WHERE l.split = 'train') > 0 AS seen_in_train
  FROM st_ids i JOIN st_lines l ON l.template = i.template GROUP BY i.id, i.template)"""

KEYWORD_RE = "(?i)(" + KEYWORDS + ")"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts if p.strip())
