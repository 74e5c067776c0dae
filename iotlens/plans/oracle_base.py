"""SQL text of the shared base tables used by the reference SQL of every query."""

from __future__ import annotations

EV = """
raw0 AS (
  SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, user_id // 10 AS src
  FROM events),
raw1 AS (
  SELECT *, CASE WHEN src % 2 = 0 THEN 'mqtt' ELSE 'coap' END AS protocol,
         CAST(event_id % 3 AS INTEGER) AS rep,
         CASE WHEN event_id % 6 = 5 THEN 'outgoing' ELSE 'incoming' END AS direction
  FROM raw0),
ev AS (
  SELECT event_id,
    1704067200000000 + (us - 1704067200000000) // (3600 * (1 + 6 * (src % 5))) AS t_us,
    protocol, protocol || '-' || src AS source_id, direction,
    CASE WHEN protocol = 'mqtt' AND event_type = 'signup' THEN 'connection_open' ELSE 'traffic' END AS event,
    least(CAST(floor(value * 12) AS BIGINT), CASE WHEN protocol = 'mqtt' THEN 4096 ELSE 2048 END) AS bytes,
    CASE WHEN protocol = 'mqtt' THEN
      CASE WHEN direction = 'outgoing' THEN 'broker_to_client' ELSE 'client_to_broker' END ||
      CASE WHEN event_type = 'signup' THEN '|connect|client_id:dev-' || user_id ||
             CASE WHEN k % 5 = 0 THEN '|will' ELSE '' END || '|keepalive:' || (k * 5)
           WHEN event_type = 'purchase' AND k % 8 = 0 THEN '|subscribe|wildcard'
           WHEN event_type = 'error' THEN '|publish|malform|qos:' || (k % 3) || '|topic:site/' || (k % 4) || '/dev/' || (k % 9)
           WHEN event_type = 'click' AND k % 20 = 0 THEN '|pubrel'
           ELSE '|publish|qos:' || (k % 3) || CASE WHEN k % 10 = 0 THEN '|retain' ELSE '' END ||
                '|topic:site/' || (k % 4) || '/dev/' || (k % 9) END
    ELSE
      CASE WHEN direction = 'outgoing' THEN 'backend_to_client' ELSE 'client_to_backend' END ||
      CASE WHEN event_type = 'error' THEN '|con|get|malform'
           ELSE '|' || ['con','non','ack','rst'][k % 4 + 1] || '|' ||
             CASE event_type WHEN 'view' THEN 'get' WHEN 'click' THEN 'post' WHEN 'purchase' THEN 'put' ELSE 'delete' END ||
             '|token:' || k || '|path:/s/' || (k % 4) || '/r/' || (k % 7) ||
             CASE WHEN k % 6 = 0 THEN '|observe' ELSE '' END ||
             CASE WHEN k % 11 = 0 THEN '|blockwise' ELSE '' END || '|optcount:' || (2 + k % 5) END
    END AS detail,
    CAST(event_id % 64 AS INTEGER) AS mid,
    protocol || '-R' || (src % 7) || '-' || rep AS run_id, rep,
    CASE WHEN event_type = 'error' THEN protocol || '_protocol_abuse'
         WHEN protocol = 'mqtt' AND event_type = 'purchase' AND k % 8 = 0 THEN 'mqtt_wildcard_abuse'
         WHEN src % 5 = 4 THEN CASE WHEN protocol = 'mqtt' THEN 'mqtt_publish_flood' ELSE 'coap_request_flood' END
         ELSE 'benign' END AS label,
    user_id, k, src, event_type
  FROM raw1)
"""


def round6(x: str) -> str:
    return f"(floor(({x}) * 1e6 + 0.50001) / 1e6)"


def clamp01(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(CAST({x} AS DOUBLE), 1.0::DOUBLE))"


def tag(key: str, d: str = "detail") -> str:
    return (
        f"CASE WHEN strpos({d}, '{key}') > 0 THEN "
        f"split_part(substr({d}, strpos({d}, '{key}') + {len(key)}), '|', 1) ELSE '' END"
    )


def entropy(s: str) -> str:
    """Entropy in bits of an ASCII string, from its characters."""
    return (
        f"(CASE WHEN length({s}) <= 1 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, log2(length({s})) - "
        f"list_sum(list_transform(list_distinct(string_split({s}, '')), lambda ch: "
        f"CAST(length({s}) - length(replace({s}, ch, '')) AS DOUBLE) * log2(length({s}) - length(replace({s}, ch, ''))))) "
        f"/ length({s})) END)"
    )


# Flags and tags of the detail text.
FLAGS = f"""
flags AS (
  SELECT *,
    CASE WHEN ({tag('topic:')}) <> '' THEN ({tag('topic:')}) ELSE ({tag('path:')}) END AS resource,
    (contains(detail, 'error') OR contains(detail, 'abuse') OR contains(detail, 'malform')) AS is_error,
    (contains(detail, 'wildcard') OR contains(detail, 'observe')) AS is_breadth,
    (event = 'connection_open') AS is_open,
    (contains(detail, '|con') OR contains(detail, 'con|')) AS is_con,
    (contains(detail, '|non') OR contains(detail, 'non|')) AS is_non,
    (contains(detail, '|ack') OR contains(detail, 'ack|')) AS is_ack,
    (contains(detail, '|rst') OR contains(detail, 'rst|')) AS is_rst,
    (contains(detail, 'pubrec') OR contains(detail, 'pubrel') OR contains(detail, 'pubcomp')) AS is_qos2,
    coalesce(try_cast(regexp_extract({tag('optcount:')}, '^[0-9]+') AS DOUBLE), 0.0) AS opt_count,
    coalesce(try_cast(regexp_extract({tag('keepalive:')}, '^[0-9]+') AS DOUBLE), 60.0) AS keepalive_s
  FROM ev)
"""

TYPED = """
inc AS (
  SELECT *, (is_open OR is_qos2 OR is_ack OR is_con) AS is_handshake,
    CASE WHEN is_con THEN 'con' WHEN is_non THEN 'non' WHEN is_ack THEN 'ack' WHEN is_rst THEN 'rst' END AS ctype
  FROM flags WHERE direction = 'incoming')
"""

STATE = """
st AS (
  SELECT *,
    coalesce((t_us - lag(t_us) OVER o) // 1000, 1000) AS gap_ms,
    coalesce(max(CASE WHEN is_open THEN t_us END) OVER o_run, first_value(t_us) OVER o) AS start_us,
    count(*) OVER w1 AS n1,
    count(DISTINCT CASE WHEN resource <> '' THEN resource END) OVER w10 AS resources10,
    count(*) OVER w10 AS n10,
    CAST(sum(CASE WHEN is_error THEN 1 ELSE 0 END) OVER w10 AS BIGINT) AS err10,
    CAST(sum(CASE WHEN is_handshake THEN 1 ELSE 0 END) OVER w10 AS BIGINT) AS hs10,
    CAST(sum(CASE WHEN is_open THEN 1 ELSE 0 END) OVER w30 AS BIGINT) AS open30,
    CAST(sum(CASE WHEN is_breadth THEN 1 ELSE 0 END) OVER w30 AS BIGINT) AS breadth30,
    count(*) OVER w30 AS n30,
    CAST(sum(bytes) OVER w30 AS BIGINT) AS b30,
    CAST(sum(bytes * bytes) OVER w30 AS BIGINT) AS bb30,
    CAST(sum(CASE WHEN ctype = 'con' AND protocol = 'coap' THEN 1 ELSE 0 END) OVER w10 AS BIGINT) AS con10,
    CAST(sum(CASE WHEN ctype = 'non' AND protocol = 'coap' THEN 1 ELSE 0 END) OVER w10 AS BIGINT) AS non10,
    CAST(sum(CASE WHEN ctype = 'ack' AND protocol = 'coap' THEN 1 ELSE 0 END) OVER w10 AS BIGINT) AS ack10,
    CAST(sum(CASE WHEN ctype = 'rst' AND protocol = 'coap' THEN 1 ELSE 0 END) OVER w10 AS BIGINT) AS rst10,
    CAST(sum(CASE WHEN protocol = 'coap' THEN CAST(opt_count AS BIGINT) ELSE 0 END) OVER w10 AS BIGINT) AS opt10
  FROM inc
  WINDOW o AS (PARTITION BY protocol, source_id ORDER BY t_us, event_id),
    o_run AS (PARTITION BY protocol, source_id ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    w1 AS (PARTITION BY protocol, source_id ORDER BY t_us RANGE BETWEEN 1000000 PRECEDING AND CURRENT ROW),
    w10 AS (PARTITION BY protocol, source_id ORDER BY t_us RANGE BETWEEN 10000000 PRECEDING AND CURRENT ROW),
    w30 AS (PARTITION BY protocol, source_id ORDER BY t_us RANGE BETWEEN 30000000 PRECEDING AND CURRENT ROW))
"""

_SIZE = clamp01("ln(1 + greatest(CAST(bytes AS DOUBLE), 0.0)) / ln(4097.0::DOUBLE)")
_Q = "(is_con)"

STD30 = (
    "CASE WHEN n30 < 2 THEN 0.0::DOUBLE ELSE sqrt(greatest(CAST(CAST(n30 AS HUGEINT) * bb30 - "
    "CAST(b30 AS HUGEINT) * b30 AS DOUBLE), 0.0)) / n30 END"
)

BEHAVIORAL_EXPR = {
    "f00": clamp01("n1 / 20.0"),
    "f01": "1.0 - " + clamp01("gap_ms / 1000.0"),
    "f02": _SIZE,
    "f03": clamp01(entropy("detail") + " / 8.0"),
    "f04": "CASE WHEN resource = '' THEN 0.0::DOUBLE ELSE "
    + clamp01("(length(resource) - length(replace(resource, '/', '')) + 1) / 8.0") + " END",
    "f05": clamp01(entropy("resource") + " / 4.0"),
    "f06": "CASE WHEN protocol = 'mqtt' THEN CASE WHEN contains(detail, 'qos:2') THEN 1.0::DOUBLE "
    "WHEN contains(detail, 'qos:1') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END "
    "ELSE CASE WHEN is_con THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END",
    "f07": clamp01("(t_us - start_us) / 1e6 / 300.0"),
    "f08": clamp01("resources10 / 32.0"),
    "f09": "CAST(err10 AS DOUBLE) / n10",
    "f10": "CAST(hs10 AS DOUBLE) / n10",
    "f11": clamp01("breadth30 / 16.0"),
    "f12": clamp01("open30 / 30.0"),
    "f13": clamp01("ln(1 + CAST(bytes AS DOUBLE) / greatest(1, length(resource))) / ln(65.0::DOUBLE)"),
    "f14": "1.0 - CAST(err10 AS DOUBLE) / n10",
    "f15": "CASE WHEN protocol = 'mqtt' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "f16": "CASE WHEN protocol = 'mqtt' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END",
    "f17": "CASE WHEN protocol = 'mqtt' AND contains(detail, 'retain') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "f18": "CASE WHEN protocol = 'mqtt' THEN "
    + clamp01("(length(detail) - length(translate(detail, '#+', ''))) / 4.0") + " ELSE 0.0::DOUBLE END",
    "f19": "CASE WHEN protocol = 'mqtt' THEN CASE WHEN is_open THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END ELSE 0.0::DOUBLE END",
    "f20": "CASE WHEN protocol = 'mqtt' THEN " + clamp01("keepalive_s / 300.0") + " ELSE 0.0::DOUBLE END",
    "f21": "CASE WHEN protocol = 'mqtt' AND contains(detail, 'will') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "f22": "CASE WHEN protocol = 'mqtt' AND is_qos2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "f23": "CASE WHEN protocol = 'mqtt' THEN " + clamp01(entropy("source_id") + " / 4.0") + " ELSE 0.0::DOUBLE END",
    "f24": "CASE WHEN protocol = 'mqtt' THEN " + clamp01(f"({STD30}) / 2048.0") + " ELSE 0.0::DOUBLE END",
    "f25": "CASE WHEN protocol = 'coap' AND con10+non10+ack10+rst10 > 0 THEN CAST(con10 AS DOUBLE) / (con10+non10+ack10+rst10) ELSE 0.0::DOUBLE END",
    "f26": "CASE WHEN protocol = 'coap' AND con10+non10+ack10+rst10 > 0 THEN CAST(non10 AS DOUBLE) / (con10+non10+ack10+rst10) ELSE 0.0::DOUBLE END",
    "f27": "CASE WHEN protocol = 'coap' AND con10+non10+ack10+rst10 > 0 THEN CAST(ack10 AS DOUBLE) / (con10+non10+ack10+rst10) ELSE 0.0::DOUBLE END",
    "f28": "CASE WHEN protocol = 'coap' AND con10+non10+ack10+rst10 > 0 THEN CAST(rst10 AS DOUBLE) / (con10+non10+ack10+rst10) ELSE 0.0::DOUBLE END",
    "f29": "CASE WHEN protocol = 'coap' AND contains(detail, 'observe') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "f30": "CASE WHEN protocol = 'coap' AND contains(detail, 'blockwise') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END",
    "f31": "CASE WHEN protocol = 'coap' AND contains(detail, 'token:') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END",
    "f32": "CASE WHEN protocol = 'coap' THEN " + clamp01("CAST(opt10 AS DOUBLE) / n10 / 16.0") + " ELSE 0.0::DOUBLE END",
}


def legacy_expr(detail: str = "detail") -> dict[str, str]:
    """Stateless vector; ``detail`` may be wrapped (lower-cased for dataset rows)."""
    m = "protocol = 'mqtt'"

    def pick(a: str, b: str) -> str:
        return f"CASE WHEN {m} THEN CAST({a} AS DOUBLE) ELSE CAST({b} AS DOUBLE) END"

    opened = "event = 'connection_open'"
    err = f"(CASE WHEN contains({detail}, 'error') OR contains({detail}, 'abuse') THEN 0.6 ELSE 0.05 END)"
    out = {
        "f00": "CASE WHEN event = 'traffic' THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END",
        "f01": "0.5::DOUBLE",
        "f02": _SIZE,
        "f03": "CASE WHEN bytes > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END",
        "f04": pick("0.25", "0.3"),
        "f05": pick("0.45", "0.5"),
        "f06": pick("0.5", f"CASE WHEN contains({detail}, 'con') THEN 1.0 ELSE 0.0 END"),
        "f07": pick("0.5", "0.3"),
        "f08": pick("0.2", "0.25"),
        "f09": f"CAST({err} AS DOUBLE)",
        "f10": pick(f"CASE WHEN {opened} THEN 0.6 ELSE 0.2 END", "CASE WHEN direction = 'outgoing' THEN 0.6 ELSE 0.2 END"),
        "f11": pick(f"CASE WHEN contains({detail}, 'wildcard') THEN 0.7 ELSE 0.15 END", "0.4"),
        "f12": pick(f"CASE WHEN {opened} THEN 0.8 ELSE 0.2 END", "0.3"),
        "f13": pick(clamp01("bytes / 20.0 / 50.0"), clamp01("bytes / 16.0 / 64.0")),
        "f14": f"CASE WHEN contains({detail}, 'malform') THEN 0.3::DOUBLE ELSE 0.95::DOUBLE END",
        "f15": pick("1", "0"),
        "f16": pick("0", "1"),
        "f17": "0.0::DOUBLE",
        "f18": pick(f"CASE WHEN contains({detail}, 'wildcard') THEN 1.0 ELSE 0.0 END", "0"),
        "f19": pick(f"CASE WHEN {opened} THEN 1.0 ELSE 0.2 END", "0"),
        "f20": pick("0.6", "0"),
        "f21": "0.0::DOUBLE",
        "f22": pick("0.2", "0"),
        "f23": pick("0.5", "0"),
        "f24": pick(clamp01("bytes / 2048.0"), "0"),
    }
    for i in range(25, 33):
        out[f"f{i:02d}"] = "0.0::DOUBLE"
    return out


def select_features(exprs: dict[str, str], keep: str, source: str, rounded: bool) -> str:
    cols = ", ".join(f"{round6(e) if rounded else e} AS {n}" for n, e in exprs.items())
    return f"SELECT {keep}, {cols} FROM {source}"


BEHAVIORAL = (
    "bv AS MATERIALIZED ("
    + select_features(BEHAVIORAL_EXPR, "event_id, t_us, protocol, source_id, direction, event, bytes, detail, label, run_id, rep, k, src, event_type, user_id, mid", "st", False)
    + ")"
)
LEGACY = (
    "lv AS MATERIALIZED ("
    + select_features(legacy_expr(), "event_id, t_us, protocol, source_id, direction, event, bytes, detail, label, run_id, rep, scenario", "(SELECT *, label AS scenario FROM ev)", False)
    + ")"
)

SCORED = """
sc0 AS (
  SELECT *,
    CASE WHEN f00 >= 0.95 THEN 'rule:msg_rate_exceeded' WHEN f02 >= 0.97 THEN 'rule:oversized_payload' ELSE '' END AS rule_reason,
    least(1.0::DOUBLE, greatest(0.0::DOUBLE, least(0.65 * f00 + 0.35 * f02, 1.0::DOUBLE)) +
      CASE WHEN protocol = 'coap' THEN 0.03 ELSE 0.0 END) AS anomaly_score
  FROM bv),
sc AS MATERIALIZED (
  SELECT *,
    CASE WHEN anomaly_score >= 0.5 THEN 'suspicious' ELSE 'benign' END AS predicted_label,
    (rule_reason = '' AND anomaly_score < 0.9) AS allow,
    CASE WHEN rule_reason <> '' OR anomaly_score >= 0.9 THEN 'drop'
         WHEN anomaly_score >= 0.75 THEN 'rate_limit' ELSE 'forward' END AS action,
    CASE WHEN rule_reason <> '' THEN rule_reason
         WHEN anomaly_score >= 0.9 THEN 'inference:high_anomaly_score'
         WHEN anomaly_score >= 0.75 THEN 'inference:elevated_anomaly_score' ELSE '' END AS reason
  FROM sc0)
"""

WITH_EV = "WITH " + EV
WITH_FLAGS = WITH_EV + "," + FLAGS
WITH_STATE = WITH_FLAGS + "," + TYPED + "," + STATE
WITH_BEHAVIORAL = WITH_STATE + "," + BEHAVIORAL
WITH_SCORED = WITH_BEHAVIORAL + "," + SCORED
WITH_LEGACY = WITH_EV + "," + LEGACY
WITH_BOTH = WITH_BEHAVIORAL + "," + LEGACY
WITH_ALL = WITH_SCORED + "," + LEGACY
