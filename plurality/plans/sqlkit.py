"""ANSI-SQL twins: named common table expressions with their dependencies."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body


def r(expr: str, alias: str | None = None) -> str:
    out = f"round(({expr})::DOUBLE, 6) + 0.0"
    return f"{out} AS {alias}" if alias else out


def big(expr: str, alias: str) -> str:
    return f"({expr})::BIGINT AS {alias}"


def ksum(template: str, k: int = 6) -> str:
    """Sum a per-class template over classes; '#' stands for the class number."""
    return "(" + " + ".join(template.replace("#", str(i)) for i in range(k)) + ")"


def klist(template: str, k: int = 6, sep: str = ", ") -> str:
    return sep.join(template.replace("#", str(i)) for i in range(k))


def sql(select: str, recursive: bool = False, **extra: str) -> str:
    """Prefix ``select`` with every CTE it needs, in dependency order."""
    local = {**CTES, **extra}
    order: list[str] = []

    def visit(text: str, seen: tuple = ()) -> None:
        for name in re.findall(r"\b[a-z_][a-z0-9_]*\b", text):
            if name in local and name not in order and name not in seen:
                visit(local[name], seen + (name,))
                if name not in order:
                    order.append(name)

    visit(select)
    if not order:
        return select
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"{n} AS ({local[n]})" for n in order) + "\n" + select


_VK = (("A", "F"), ("A", "O"), ("N", "F"), ("N", "O"), ("R", "F"), ("R", "O"))


def md5i(*parts: str) -> str:
    """md5 prefix integer; parts are SQL expressions."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"


_P = 2147483647


def mix(key: str, seed: str, stream: str) -> str:
    s = f"((({key} % {_P})*1000003 + {seed}::BIGINT*7919 + {stream}::BIGINT*104729) % {_P})"
    return f"(({s} * {s} + 12345) % {_P})"


def unit(state: str, i: int) -> str:
    w = f"(({state} + {(i + 1) * 715225739 % _P}) % {_P})"
    return f"((({w} * {w}) % {_P})::DOUBLE / {_P}.0::DOUBLE)"


cte("s_orders", "SELECT l_orderkey, "
    + ", ".join(f"sum(CASE WHEN l_returnflag='{a}' AND l_linestatus='{b}' THEN 1 ELSE 0 END)::BIGINT AS v{k}"
                for k, (a, b) in enumerate(_VK))
    + ", count(*)::BIGINT AS n, min(l_partkey) AS recording_id, min(l_suppkey) AS spectrogram_id,"
    " sum(CASE WHEN l_discount >= 0.02::DOUBLE THEN 1 ELSE 0 END)::DOUBLE / count(*) AS local_valid,"
    " sum(CASE WHEN l_tax >= 0.02::DOUBLE THEN 1 ELSE 0 END)::DOUBLE / count(*) AS context_valid"
    " FROM lineitem GROUP BY 1")
_MX = "greatest(v0,v1,v2,v3,v4,v5)"
_FIRST = "CASE " + " ".join(f"WHEN v{k} = {_MX} THEN {k}" for k in range(6)) + " END"
_LAST = "CASE " + " ".join(f"WHEN v{k} = {_MX} THEN {k}" for k in reversed(range(6))) + " END"


def first_argmax(prefix: str) -> str:
    mx = "greatest(" + klist(f"{prefix}#") + ")"
    return "(CASE " + " ".join(f"WHEN {prefix}{k} = {mx} THEN {k}" for k in range(6)) + " END)::BIGINT"


def majority(prefix: str = "v") -> str:
    mx = "greatest(" + klist(f"{prefix}#") + ")"
    cnt = ksum(f"({prefix}# = {mx})::INT")
    return f"(CASE WHEN {cnt} = 1 THEN {first_argmax(prefix)} ELSE -1 END)::BIGINT"


def pick(prefix: str, idx: str) -> str:
    return "(CASE " + " ".join(f"WHEN {idx} = {k} THEN {prefix}{k}" for k in range(6)) + " END)"


_U = "(" + md5i("'part'", "'20260907'", "o_custkey::VARCHAR") + " / 4294967296.0::DOUBLE)"
cte("s_labels0", "SELECT l_orderkey AS label_id, o_custkey AS group_id, recording_id, spectrogram_id,"
    " v0,v1,v2,v3,v4,v5, n, local_valid, context_valid,"
    " (round(o_totalprice*100)::BIGINT % 4000) / 200.0::DOUBLE AS offset_seconds,"
    " (round(o_totalprice*100)::BIGINT % 1200) / 2.0::DOUBLE AS spectrogram_offset_seconds,"
    f" o_orderstatus AS order_status, o_orderpriority AS priority, {_U} AS pu"
    " FROM s_orders JOIN orders ON l_orderkey = o_orderkey")
cte("s_labels", "SELECT *, "
    f"(['Seizure','LPD','GPD','LRDA','GRDA','Other'])[1 + (CASE WHEN order_status='P' THEN {_LAST} ELSE {_FIRST} END)] AS consensus,"
    " CASE WHEN pu < 0.6 THEN 'train' WHEN pu < 0.7 THEN 'tune' WHEN pu < 0.75 THEN 'calibration_t'"
    " WHEN pu < 0.8 THEN 'calibration_p' ELSE 'test' END AS \"partition\" FROM s_labels0")
cte("s_q", "SELECT *, " + klist("v#::DOUBLE / n AS q#") + " FROM s_labels")
cte("s_method", "SELECT * FROM (VALUES ('m1', 0.8::DOUBLE, 1), ('m2', 1.2::DOUBLE, 2), ('m3', 1.6::DOUBLE, 3)) t(method, sigma, stream)")
cte("s_seed", "SELECT * FROM (VALUES (101), (202), (303)) t(seed)")
cte("s_w", f"SELECT q.*, method, seed, {mix('label_id', 'seed', 'stream')} AS h, sigma"
    " FROM s_q q CROSS JOIN s_method CROSS JOIN s_seed")
cte("s_w2", "SELECT *, " + ", ".join(
    f"(q{k} + 0.05::DOUBLE) * exp(sigma * (2.0::DOUBLE * {unit('h', k)} - 1.0::DOUBLE)) AS w{k}" for k in range(6))
    + f", {unit('h', 6)} AS u6, {unit('h', 7)} AS gate FROM s_w")
cte("s_pred0", "SELECT *, " + klist("w# / (w0+w1+w2+w3+w4+w5) AS p#") + " FROM s_w2")
cte("s_pred", "SELECT *, 0.7::DOUBLE * (1.0::DOUBLE - " + ksum("p#*p#") + ") + 0.3::DOUBLE * u6 AS d_hat FROM s_pred0")
cte("s_hd", f"SELECT *, {mix('label_id', '1', '11')} AS hl, {mix('label_id', '1', '13')} AS hx FROM s_q")
cte("s_hd2", "SELECT *, " + ", ".join(
    f"(q{k} + 0.05::DOUBLE) * exp(1.0::DOUBLE * (2.0::DOUBLE * {unit('hl', k)} - 1.0::DOUBLE)) AS a{k}" for k in range(6)) + ", "
    + ", ".join(f"(q{k} + 0.05::DOUBLE) * exp(1.4::DOUBLE * (2.0::DOUBLE * {unit('hx', k)} - 1.0::DOUBLE)) AS b{k}" for k in range(6))
    + f", {unit('hl', 7)} AS gate FROM s_hd")
cte("s_heads", "SELECT *, " + klist("a#/(a0+a1+a2+a3+a4+a5) AS l#") + ", " + klist("b#/(b0+b1+b2+b3+b4+b5) AS x#") + " FROM s_hd2")
cte("s_links", "SELECT DISTINCT o_custkey AS group_id, (o_custkey // 2)*2000 + l_partkey % 2000 AS recording_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
# clipped probabilities and the row metrics
cte("s_clip0", "SELECT *, " + klist("greatest(p#, 1e-7::DOUBLE) AS f#") + " FROM s_pred")
cte("s_clip", "SELECT *, " + klist("f#/(f0+f1+f2+f3+f4+f5) AS c#") + " FROM s_clip0")


def kl(q: str, p: str) -> str:
    return ksum(f"(CASE WHEN {q}# > 0 THEN {q}# * (ln({q}#) - ln({p}#)) ELSE 0.0 END)")


cte("s_rows", f"SELECT *, {kl('q', 'c')} AS kl, -{ksum('q#*ln(c#)')} AS ce, {ksum('(c#-q#)*(c#-q#)')} AS sse,"
    f" 1.0::DOUBLE - 2.0::DOUBLE*{ksum('q#*c#')} + {ksum('c#*c#')} AS brier, -{ksum('c#*ln(c#)')} AS ent,"
    f" 1.0::DOUBLE - greatest({klist('c#')}) AS omx, {majority('v')} AS y, {first_argmax('c')} AS yhat,"
    f" CASE WHEN n > 1 THEN 1.0::DOUBLE - {ksum('(v#*(v#-1))')}::DOUBLE/(n::DOUBLE*(n-1.0::DOUBLE)) END AS d_obs,"
    " CASE WHEN n = 1 THEN 'n=1' WHEN n <= 4 THEN 'n=2-4' WHEN n <= 9 THEN 'n=5-9' ELSE 'n>=10' END AS band FROM s_clip")
# signal
cte("s_sig0", "SELECT vec_id // 5 AS recording_id, vec_id % 5 AS channel, unnest(range(0, 64)) AS sample,"
    " unnest(embedding)::DOUBLE AS raw FROM embeddings")
cte("s_sig", "SELECT recording_id, channel, sample, CASE WHEN abs(raw) <= 0.3::DOUBLE THEN raw END AS x FROM s_sig0")
cte("s_win", "SELECT recording_id, start, recording_id*100 + start AS \"row\" FROM (SELECT DISTINCT vec_id // 5 AS recording_id FROM embeddings)"
    " CROSS JOIN (SELECT unnest(range(0, 41, 8)) AS start)")
cte("s_wv", "SELECT vec_id // 5 AS recording_id, " + klist("sum((label % 6 = #)::INT)::BIGINT AS v#") + ", count(*)::BIGINT AS n FROM embeddings GROUP BY 1")
cte("s_ev", "SELECT event_id, user_id, event_type, value, epoch_us(ts) AS micros, epoch_us(ts) // 86400000000 AS day,"
    " (epoch_us(ts) % 86400000000) / 1000000.0::DOUBLE AS seconds FROM events")
_VB = "CASE WHEN value < 20 THEN 1.0::DOUBLE WHEN value < 50 THEN 2.0 WHEN value < 90 THEN 3.0 ELSE 4.0 END"
cte("s_spec", "SELECT *, slot * 2.0::DOUBLE + 1.0::DOUBLE AS time FROM (SELECT user_id AS spectrogram_id, floor(seconds/7200)::BIGINT AS slot,"
    f" event_type AS region, {_VB} AS freq, sum(value) AS power FROM s_ev GROUP BY ALL)")
cte("s_revents", "SELECT user_id AS run_id, event_id, micros, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch,"
    " value AS loss, (event_id*7) % 50 + 1 AS examples, event_type AS stage FROM s_ev")
cte("s_runs", "SELECT event_id AS run_id, 'c' || (user_id % 8)::VARCHAR AS config, event_id % 3 + 1 AS seed_no,"
    " CASE WHEN event_type='error' THEN 'FAIL' WHEN event_type='signup' THEN 'RUNNING' ELSE 'PASS' END AS status,"
    " user_id % 3 + 1 AS epochs, ([0.25::DOUBLE,0.5,0.75,1.0])[1 + (event_id // 3) % 4] AS fraction,"
    " CASE WHEN user_id % 2 = 0 THEN 'foveated' ELSE 'uniform' END AS encoding,"
    " ([8,16,32])[1 + (event_id // 12) % 3]::BIGINT AS bins, CASE WHEN event_type <> 'signup' THEN value / 97.0::DOUBLE END AS tune_kl,"
    " (user_id % 8) * 1000 + 450 AS params, value / 3600.0::DOUBLE AS hours, event_type AS stage FROM events")
