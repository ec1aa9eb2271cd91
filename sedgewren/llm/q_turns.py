from pyspark.sql import DataFrame, SparkSession

from sedgewren.llm.common import table
from sedgewren.llm.turns import damaged, repair_conversations, with_missing


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return with_missing(repair_conversations(damaged(turns)), turns)


def _least(*ways: str) -> str:
    return f"least({', '.join(ways)})"


def _way(edit: str, state: str, price: str) -> str:
    return f"{{'c': {state}.c + {price}, 't': '{edit}' || {state}.t}}"


def _if(condition: str, way: str) -> str:
    return f"CASE WHEN {condition} THEN {way} ELSE {{'c': 1000000000, 't': ''}} END"


#: Of a row, what may be done with it in a state: e nothing yet, s after system, u after user, a after assistant.
_STAYS = {
    "e": (_if("ok AND r = 's'", _way("K", "f.s", "cut")), _if("ok AND r = 'u'", _way("K", "f.u", "cut")), _if("ok", _way("R", "f.u", "cut + 3"))),
    "s": (_if("ok AND r = 'u'", _way("K", "f.u", "cut")), _if("ok", _way("R", "f.u", "cut + 3"))),
    "u": (_if("ok AND r = 'a'", _way("K", "f.a", "cut")), _if("ok", _way("R", "f.a", "cut + 3"))),
    "a": (_if("ok AND r = 'u'", _way("K", "f.u", "cut")), _if("ok", _way("R", "f.u", "cut + 3"))),
}
_ROW = ", ".join(f"{_least(_way('D', 'f.' + q, '4'), *ways)} AS {q}" for q, ways in _STAYS.items())
_INSERTED = ", ".join(f"{_least('w.' + q, _way('I', 'w.' + to, '3'))} AS {q}" for q, to in (("e", "u"), ("s", "u"), ("u", "a"), ("a", "u")))

#: Goes through each conversation from its end with whole audits; q holds the rows after damage.
REPAIR_SQL = rf"""
    WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS table_),
    b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM conversations),
    k AS (SELECT *, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, table_[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)::BIGINT % 20 AS kind FROM b, crc),
    d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                 unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM d),
    p AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, left(role, 1) AS r,
                 lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS two FROM o),
    q AS (SELECT *, again AND NOT blank AS duplicate, NOT blank AND NOT again AND regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$') AS truncated FROM p),
    z AS (SELECT *, NOT blank AND NOT duplicate AS ok, CASE WHEN truncated THEN 3 ELSE 0 END AS cut FROM q),
    n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
                 count(*) FILTER (truncated) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM q GROUP BY conv_id),
    f AS (
      SELECT conv_id, n + 1 AS i, {{'c': 0::BIGINT, 't': ''}} AS e, {{'c': 6::BIGINT, 't': 'II'}} AS s, {{'c': 3::BIGINT, 't': 'I'}} AS u, {{'c': 0::BIGINT, 't': ''}} AS a FROM n
      UNION ALL
      SELECT conv_id, i, {_INSERTED} FROM (SELECT f.conv_id, z.i, {_ROW} FROM f JOIN z ON f.conv_id IS NOT DISTINCT FROM z.conv_id AND z.i = f.i - 1) AS w),
    g AS (SELECT conv_id, e.c AS cost, e.t AS audit FROM f WHERE i = 1),
    x AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS nth FROM g),
    y AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS place FROM x WHERE edit <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY nth ROWS UNBOUNDED PRECEDING)),
    t AS (SELECT y.conv_id, place, edit, z.role, CASE WHEN edit = 'I' THEN '' ELSE z.text END AS text, z.r FROM y JOIN z ON y.conv_id IS NOT DISTINCT FROM z.conv_id AND z.i = greatest(y.i, 1) WHERE edit <> 'D'),
    m AS (SELECT *, max(CASE WHEN place = 1 AND edit = 'K' AND r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS opened FROM t),
    h AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY place) AS repaired FROM m GROUP BY conv_id),
    c AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
    FROM c LEFT JOIN n ON c.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN g ON c.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN h ON c.conv_id IS NOT DISTINCT FROM h.conv_id"""

QUERIES = {"op11_conversation_repair": op11_conversation_repair}
ORACLES = {"op11_conversation_repair": REPAIR_SQL}
