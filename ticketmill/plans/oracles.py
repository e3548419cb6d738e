"""The registered queries in SQL, for a second engine on the same tables."""

from __future__ import annotations

from ticketmill import defaults as D
from ticketmill.plans import inputs as I

NOW = f"TIMESTAMP '{I.NOW}'"
TZ = D.BASELINE_TZ
_WS = (
    r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
_QUOTE = (
    r"(?i)^\s*on .{0,80}\bwrote:\s*$|^\s*-{2,}\s*original message\s*-{2,}\s*$|^\s*from:\s.+$|^\s*_{5,}\s*$"
)
_SIGN = (
    r"(?i)^\s*(?:thanks|thank you|regards|best|sincerely|cheers)[,!.\s]*$"
    r"|^\s*(?:sent from my|get outlook for)\b|^\s*[-_]{2,}\s*$"
    r"|^\s*(?:this email|the information contained|confidentiality notice|disclaimer)\b"
)
_OPEN = (
    r"(?i)^\s*(?:hello|hi|hey|good morning|good afternoon)[ ,].{0,60}?"
    r"(?:thank you for contacting|thanks for contacting).*$"
)


def text_time(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%SZ')"


def strip_html(x: str) -> str:
    out = f"regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g')"
    for entity, char in D.HTML_ENTITIES:
        out = f"replace({out}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return out


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def clean(name: str, source: str, column: str = "text", out: str = "cleaned") -> str:
    """CTEs that add ``out``, the cleaned ``column``, to ``source``."""
    def cut(lines: str, pattern: str) -> str:
        hits = f"list_transform({lines}, lambda x: regexp_matches(x, '{pattern}'))"
        return (
            f"CASE WHEN list_contains({hits}, true) THEN {lines}[1:list_position({hits}, true) - 1] ELSE {lines} END"
        )

    return f"""
    {name}_0 AS (SELECT *, list_filter(list_transform(
        regexp_split_to_array({strip_html(column)}, '{_BREAK}'),
        lambda x: regexp_replace(x, '[{_WS}]+$', '')), lambda x: x <> '') AS ls FROM {source}),
    {name}_1 AS (SELECT * REPLACE ({cut('ls', _QUOTE)} AS ls) FROM {name}_0),
    {name}_2 AS (SELECT * REPLACE ({cut('ls', _SIGN)} AS ls) FROM {name}_1),
    {name} AS (SELECT * EXCLUDE (ls), {trim(
        f"array_to_string(list_filter(ls, lambda x: NOT regexp_matches(x, '{_OPEN}')), chr(10))"
    )} AS {out} FROM {name}_2)"""


_LABEL = r"\b(?:" + "|".join(D.SECRET_LABELS) + r")\b"
_PHONE = r"(^|[^0-9])(?:\+?1[\s.-]?)?\(?[0-9]{3}\)?[\s.-]?[0-9]{3}[\s.-]?[0-9]{4}([^0-9]|$)"


def redact(x: str, contacts: bool = True) -> str:
    """Look-around rewritten: neighbours are captured, marked values are hidden first."""
    out = f"regexp_replace({x}, '{D.GUID}', '{D.KEY_MARK}', 'g')"
    out = rf"regexp_replace({out}, '(?i)({_LABEL}\s*)([:=])(\s*<redacted)', '\1' || chr(1) || '\2\3', 'g')"
    out = rf"regexp_replace({out}, '(?i){_LABEL}\s*[:=]\s*[^{_WS}]+', '{D.SECRET_MARK}', 'g')"
    out = f"replace({out}, chr(1), '')"
    if contacts:
        out = f"regexp_replace({out}, '{D.EMAIL}', '{D.EMAIL_MARK}', 'g')"
        for _ in range(2):
            out = rf"regexp_replace({out}, '{_PHONE}', '\1{D.PHONE_MARK}\2', 'g')"
    return out


def has_secret(x: str) -> str:
    hidden = rf"regexp_replace({x}, '(?i)({_LABEL}\s*)([:=])(\s*<redacted)', '\1' || chr(1) || '\2\3', 'g')"
    return (
        rf"(regexp_matches({hidden}, '(?i){_LABEL}\s*[:=]\s*[^{_WS}]+') OR regexp_matches({x}, '{D.GUID}'))"
    )


def secret_only(x: str) -> str:
    rest = f"replace(replace({redact(x)}, '{D.SECRET_MARK}', ''), '{D.KEY_MARK}', '')"
    return rf"({has_secret(x)} AND length(regexp_replace({rest}, '[^\p{{L}}\p{{N}}_]+', '', 'g')) < 20)"


def dedupe(x: str) -> str:
    low = f"list_transform({x}, lambda v: lower(v))"
    return f"list_filter({x}, lambda v, i: list_position({low}, lower(v)) = i)"


def all_matches(column: str, patterns) -> str:
    found = [
        f"regexp_extract_all({column}, '{p}', {1 if '(' in p.replace('(?', '') else 0})" for p in patterns
    ]
    return f"list_concat({', '.join(found)})"


def has_word(x: str, word: str) -> str:
    return f"contains({x}, '{word}')"


# --- views ------------------------------------------------------------------
TICKETS = """
  turns AS (SELECT conv_id, min(turn) FILTER (role = 'user') AS first, max(turn) AS turns FROM conversations GROUP BY conv_id),
  tickets AS (
    SELECT t.conv_id AS id, d.text AS description, CASE WHEN t.conv_id % 5 = 0 THEN 2 ELSE 4 END AS status,
      TIMESTAMP '2024-01-01' + to_hours(t.conv_id) AS created,
      TIMESTAMP '2024-01-01' + to_hours(t.conv_id) + to_hours((t.conv_id % 9) * 20) AS closed,
      TIMESTAMP '2024-01-01' + to_hours(t.conv_id) + to_minutes(t.turns) AS updated,
      CASE WHEN t.conv_id % 7 = 0 THEN 'Replaced the cable of desk ' || t.conv_id || ' and restarted it.' ELSE '' END AS fix
    FROM turns t LEFT JOIN conversations d ON d.conv_id = t.conv_id AND d.turn = t.first AND d.role = 'user'),
  convs AS (
    SELECT c.conv_id, c.turn, c.role, c.text FROM conversations c JOIN turns t USING (conv_id)
    WHERE c.role <> 'user' OR c.turn > t.first)"""

PARTS = TICKETS + "," + clean("cl", "convs") + "," + clean("ti", "tickets", "description", "clean_description") + """,
  inc AS (SELECT conv_id, cleaned, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
    FROM cl WHERE role = 'user' AND cleaned <> ''),
  parts AS (
    SELECT t.*,
      (SELECT string_agg(cleaned, chr(10) ORDER BY rn) FROM inc WHERE inc.conv_id = t.id AND rn <= 2) AS incoming,
      (SELECT arg_max(cleaned, turn) FROM cl WHERE cl.conv_id = t.id AND role = 'system' AND text <> '') AS note,
      (SELECT arg_max(cleaned, turn) FROM cl WHERE cl.conv_id = t.id AND role = 'assistant' AND text <> '') AS reply
    FROM ti t),
  texts AS (
    SELECT *, concat_ws(chr(10), nullif(clean_description, ''), incoming) AS symptom,
      coalesce(nullif(fix, ''), nullif(note, ''), nullif(reply, ''), '') AS resolution,
      CASE WHEN fix <> '' THEN 'resolution_field' WHEN note <> '' THEN 'private_note'
        WHEN reply <> '' THEN 'reply' ELSE 'unknown' END AS source
    FROM parts)"""

BUILT = PARTS + f""",
  ok AS (SELECT * FROM texts WHERE status = 4 AND length(symptom) >= 15 AND resolution <> ''
    AND NOT {secret_only('resolution')}),""" + clean("s2", "ok", "symptom", "s_clean") + "," + clean(
    "r2", "s2", "resolution", "r_clean") + f""",
  built AS (SELECT *, {redact('s_clean')} AS symptom_text, {redact('r_clean')} AS resolution_text FROM r2
    WHERE s_clean <> '' AND r_clean <> '')"""

EVENTS = """
  evt AS (SELECT event_id AS id, ts AS created_at, event_type AS key,
    event_type || '/' || (user_id % 3) AS system_key FROM events)"""

HOURS = EVENTS + """,
  hourly AS (
    SELECT key || '@' || epoch(date_trunc('hour', created_at))::BIGINT AS cluster_id, key, count(*) AS count,
      date_trunc('hour', created_at) AS window_start, date_trunc('hour', created_at) + INTERVAL 1 HOUR AS window_end,
      arg_min(id, struct_pack(a := created_at, b := id)) AS first_ticket_id,
      (epoch(date_trunc('hour', created_at)) / 3600)::BIGINT AS hour_no
    FROM evt GROUP BY ALL HAVING count(*) >= 5),
  clusters AS (SELECT *, CASE WHEN hour_no % 2 = 0 THEN 'p' || (hour_no % 4) END AS pool FROM hourly)"""
# grouping by every plain column needs the columns spelled out
HOURS = HOURS.replace("GROUP BY ALL", "GROUP BY key, date_trunc('hour', created_at)")

SIGNALS = HOURS + """,
  cat AS (SELECT * FROM (VALUES ('log.signup', 'cause', 'signup'), ('log.error', 'effect', 'error'),
    ('log.error', 'effect', 'purchase')) AS v(signal_key, role, event_type)),
  sig AS (SELECT DISTINCT signal_key, role FROM cat),
  logs AS (SELECT event_id, ts, 'p' || (user_id % 4) AS desktop_id, 'Pool ' || (user_id % 4) AS desktop,
    signal_key FROM events JOIN cat USING (event_type)),
  win AS (SELECT c.*, s.signal_key, s.role,
    window_start - CASE WHEN role = 'cause' THEN INTERVAL 24 HOUR ELSE INTERVAL 1 HOUR END AS lo
    FROM clusters c CROSS JOIN sig s),
  span AS (SELECT *, lo - (window_end - lo) AS prior_lo FROM win),
  signals AS (
    SELECT s.cluster_id, s.signal_key, s.role,
      count(l.event_id) FILTER (l.ts >= s.lo AND l.ts <= s.window_end) AS count,
      CASE WHEN s.role = 'cause' THEN 0
        ELSE count(l.event_id) FILTER (l.ts >= s.prior_lo AND l.ts < s.lo) END AS prior
    FROM span s LEFT JOIN logs l ON l.signal_key = s.signal_key AND (s.pool IS NULL OR l.desktop_id = s.pool)
      AND l.ts >= s.prior_lo AND l.ts <= s.window_end
    GROUP BY s.cluster_id, s.signal_key, s.role),
  scored AS (SELECT *, CASE WHEN role = 'cause' THEN count > 0
    ELSE count >= 3 AND count >= greatest(3, 2 * prior) END AS elevated FROM signals)"""

TIERS = SIGNALS + """,
  tiers AS (SELECT cluster_id, CASE
      WHEN bool_or(role = 'cause' AND elevated) AND bool_or(role = 'effect' AND elevated) THEN 'likely'
      WHEN bool_or(elevated) THEN 'consistent with' ELSE 'none' END AS confidence
    FROM scored GROUP BY cluster_id)"""

SAMPLES = SIGNALS + """,
  picked AS (
    SELECT s.cluster_id, s.signal_key, l.event_id, l.desktop, l.desktop_id,
      row_number() OVER (PARTITION BY s.cluster_id, s.signal_key ORDER BY l.ts DESC, l.event_id DESC) - 1 AS ord
    FROM win s JOIN logs l ON l.signal_key = s.signal_key AND l.ts >= s.lo AND l.ts <= s.window_end
      AND (s.pool IS NULL OR l.desktop_id = s.pool)),
  samples AS (SELECT * FROM picked WHERE ord < 5)"""

POOLS = SAMPLES + """,
  pool_n AS (SELECT cluster_id, desktop AS pool, count(*) AS n FROM picked GROUP BY cluster_id, desktop),
  pools AS (SELECT cluster_id, pool, n, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, pool) AS rank
    FROM pool_n QUALIFY rank <= 3)"""

FB = """
  fb AS (SELECT event_id % 500 AS ticket_id, user_id AS suggested_ticket_id,
    event_type IN ('purchase', 'click') AS accepted,
    CASE WHEN event_type <> 'view' THEN value > 10 END AS resolved, ts AS made, event_id AS seq
    FROM events WHERE event_type <> 'error'),
  last AS (SELECT * FROM fb QUALIFY row_number() OVER (
    PARTITION BY ticket_id, suggested_ticket_id ORDER BY made DESC, seq DESC) = 1),
  counted AS (SELECT suggested_ticket_id, count(*) AS shown, count(*) FILTER (accepted) AS accepted,
    count(*) FILTER (accepted AND resolved) AS resolved_after_accept FROM last GROUP BY suggested_ticket_id),
  stats AS (SELECT *, CASE WHEN shown > 0 THEN round(accepted / shown, 4) ELSE 0.0 END AS accept_rate,
    CASE WHEN accepted > 0 THEN round(resolved_after_accept / accepted, 4) ELSE 0.0 END AS success_rate FROM counted),
  boosts AS (SELECT suggested_ticket_id AS ticket_id,
    round(1 + 0.4::DOUBLE * success_rate + least(accepted / 10, 0.1::DOUBLE), 4) AS boost FROM stats WHERE accepted > 0)"""

SIG = r"""
  sig AS (SELECT doc_id, lang, regexp_replace(lower(text), '[^\p{L}\p{N}_]+', '', 'g') AS s FROM documents),
  grp AS (SELECT sha256(s) AS fix_key, count(*) AS size, min(doc_id) AS first_ticket_id FROM sig WHERE length(s) >= 20 GROUP BY s),
  gold AS (SELECT s.doc_id, s.lang, s.s, coalesce(size, 1) AS expected_count, coalesce(fix_key, 'ticket:' || s.doc_id) AS fix_key
    FROM sig s LEFT JOIN grp g ON length(s.s) >= 20 AND sha256(s.s) = g.fix_key)"""

VECTORS = """
  sims AS (SELECT q.vec_id AS query_id, q.label AS q_label, d.vec_id AS ticket_id, d.label,
    round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 12) AS score
    FROM embeddings q CROSS JOIN embeddings d)"""


def vector_hits(exclude: bool, k: int) -> str:
    where = "WHERE query_id <> ticket_id" if exclude else ""
    return VECTORS + f""",
  hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ticket_id) AS rank
    FROM sims {where} QUALIFY rank <= {k})"""


def report(exclude: bool) -> str:
    minus = 1 if exclude else 0
    gate = ", hit_at_k >= 0.8 AS passed" if exclude else ""
    return f"""WITH {vector_hits(exclude, 3)},
  sizes AS (SELECT label, count(*) - {minus} AS n FROM embeddings GROUP BY label),
  per AS (SELECT e.vec_id, any_value(s.n) AS n, min(h.rank) FILTER (h.label = e.label) AS first,
      count(DISTINCT h.ticket_id) FILTER (h.label = e.label) AS found
    FROM embeddings e JOIN sizes s ON s.label = e.label LEFT JOIN hits h ON h.query_id = e.vec_id GROUP BY e.vec_id),
  rep AS (SELECT count(*) AS items, count(*) FILTER (n > 0) AS evaluated,
    round(count(*) FILTER (first = 1) / greatest(count(*) FILTER (n > 0), 1), 4) AS hit_at_1,
    round(count(first) / greatest(count(*) FILTER (n > 0), 1), 4) AS hit_at_k,
    round(coalesce(sum(found / n) FILTER (first IS NOT NULL), 0) / greatest(count(*) FILTER (n > 0), 1), 4) AS recall_at_k,
    round(coalesce(sum(1.0::DOUBLE / first), 0) / greatest(count(*) FILTER (n > 0), 1), 4) AS mrr,
    3 AS k, {str(exclude).lower()} AS exclude_self, count(*) FILTER (n > 0 AND first IS NULL) AS miss_count FROM per)
  SELECT *{gate} FROM rep"""


# the same text serves as symptom and resolution
TWICE = "text || ' ' || text"


def bm25(docs: str, queries: str, depth: int) -> str:
    """CTEs ending in ``lex(query_id, ticket_id, score, rank)``."""
    toks = r"list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    return f"""
  dt AS (SELECT ticket_id, {toks.format('text')} AS toks FROM {docs}),
  corpus AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM dt),
  qt AS (SELECT query_id, unnest(list_distinct({toks.format('text')})) AS term FROM {queries}),
  voc AS (SELECT DISTINCT term FROM qt),
  ex AS (SELECT ticket_id, len(toks) AS dl, unnest(toks) AS term FROM dt),
  tf AS (SELECT ticket_id, dl, term, count(*) AS tf FROM ex SEMI JOIN voc USING (term) GROUP BY ticket_id, dl, term),
  idf AS (SELECT term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf, corpus GROUP BY term, n),
  lex0 AS (SELECT query_id, ticket_id, round(sum(idf * tf * 2.2::DOUBLE
      / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score
    FROM tf JOIN idf USING (term) JOIN qt USING (term), corpus GROUP BY query_id, ticket_id),
  lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ticket_id) AS rank
    FROM lex0 QUALIFY rank <= {depth})"""


def fused(where: str, depth: int, text: str = "text") -> str:
    """CTEs for lexical and vector ranking of documents with vectors, ending in ``rr``."""
    return f"""
  kd AS (SELECT doc_id AS ticket_id, {text} AS text, e.embedding FROM documents LEFT JOIN embeddings e ON e.vec_id = doc_id {where}),
  kq AS (SELECT item_id AS query_id, text, e.embedding FROM benchmark LEFT JOIN embeddings e ON e.vec_id = item_id),
  {bm25('kd', 'kq', depth)},
  near AS (SELECT query_id, ticket_id, row_number() OVER (PARTITION BY query_id ORDER BY
      round(list_cosine_similarity(kq.embedding::DOUBLE[], kd.embedding::DOUBLE[]), 12) DESC, ticket_id) AS rank
    FROM kq CROSS JOIN kd WHERE kq.embedding IS NOT NULL AND kd.embedding IS NOT NULL QUALIFY rank <= {depth}),
  rr AS (SELECT query_id, ticket_id, sum(1.0::DOUBLE / (60 + rank)) AS score
    FROM (SELECT query_id, ticket_id, rank FROM lex UNION ALL SELECT query_id, ticket_id, rank FROM near)
    GROUP BY query_id, ticket_id)"""


def baseline(ages: str, n: int) -> str:
    return EVENTS + f""",
  loc AS (SELECT system_key AS key, timezone('{TZ}', created_at AT TIME ZONE 'UTC') AS lt FROM evt),
  nowl AS (SELECT date_trunc('week', timezone('{TZ}', TIMESTAMP '2024-01-31' AT TIME ZONE 'UTC')) AS wk),
  slots AS (SELECT DISTINCT key, isodow(lt) - 1 AS dow, hour(lt) AS hour FROM loc),
  weeks AS (SELECT unnest({ages}) AS a),
  cnt AS (SELECT key, isodow(lt) - 1 AS dow, hour(lt) AS hour, date_diff('day', date_trunc('week', lt), wk) // 7 AS a,
    count(*) AS c FROM loc, nowl GROUP BY ALL),
  series AS (SELECT s.key, s.dow, s.hour, coalesce(c.c, 0) AS v FROM slots s CROSS JOIN weeks w
    LEFT JOIN cnt c ON c.key = s.key AND c.dow = s.dow AND c.hour = s.hour AND c.a = w.a),
  base AS (SELECT key, dow, hour, {n} AS n, median(v)::DOUBLE AS median, mad(v)::DOUBLE AS mad
    FROM series GROUP BY key, dow, hour)"""


BASE = baseline("[0, 1, 2, 3]", 4)

CANDIDATES = BASE + f""",
  ticks AS (
    SELECT e.*, to_timestamp(ceil(epoch_us(created_at) / 300000000.0) * 300 + i * 300)::TIMESTAMP AS tick
    FROM evt e CROSS JOIN range(13) r(i)),
  inwin AS (SELECT * FROM ticks WHERE created_at <= tick AND created_at >= tick - INTERVAL 60 MINUTE),
  lim AS (SELECT w.*, isodow(timezone('{TZ}', tick AT TIME ZONE 'UTC')) - 1 AS dow,
    hour(timezone('{TZ}', tick AT TIME ZONE 'UTC')) AS hour FROM inwin w),
  joined AS (SELECT l.key, l.tick, l.id, l.created_at,
      CASE WHEN b.key IS NOT NULL THEN greatest(3.0::DOUBLE, b.median + 3.0::DOUBLE * (1.4826::DOUBLE * b.mad)) END AS thr
    FROM lim l LEFT JOIN base b ON b.key = l.system_key AND b.dow = l.dow AND b.hour = l.hour),
  cand AS (SELECT key, tick, count(*) AS count, arg_min(id, struct_pack(a := created_at, b := id)) AS first_ticket_id,
      max(thr) AS threshold
    FROM joined GROUP BY key, tick HAVING count(*) >= 3 AND (max(thr) IS NULL OR count(*) >= max(thr)))"""

FIRED = CANDIDATES + """,
  fired AS (
    SELECT key, min(tick) AS tick FROM cand GROUP BY key
    UNION ALL
    SELECT c.key, min(c.tick) FROM fired f JOIN cand c ON c.key = f.key AND c.tick >= f.tick + INTERVAL 120 MINUTE
    GROUP BY c.key),
  alerts AS (SELECT c.* FROM fired f JOIN cand c ON c.key = f.key AND c.tick = f.tick)"""

SHIP = """
  ship AS (SELECT 'ship@' || strftime(l_shipdate, '%Y-%m-%d') AS cluster_id, l_shipdate AS ws,
    l_shipdate + INTERVAL 1 HOUR AS we, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) % 2 AS odd
    FROM lineitem GROUP BY l_shipdate HAVING count(*) >= 20),
  chg AS (SELECT o_orderkey AS id, lower(o_orderpriority) AS subject, o_orderpriority AS shown,
    'svc ' || lower(o_orderstatus) AS svc, o_orderdate AS s, o_orderdate + INTERVAL 2 DAY AS e FROM orders),
  pairs AS (SELECT cluster_id, id, shown FROM ship JOIN chg ON s <= we AND e >= ws AND s >= ws - INTERVAL 72 HOUR
    WHERE odd <> 1 OR contains(subject, 'urgent') OR contains(svc, 'urgent') OR contains(svc, 'svc f') OR contains(subject, 'svc f'))"""

SNAPS = """
  snap AS (SELECT event_id, event_type || CASE WHEN user_id % 2 = 0 THEN ' (Prod)' ELSE ' Test-Flight' END AS app, ts,
    date_trunc('week', ts) AS published,
    '1.0.' || (json_extract_string(props, '$.k')::INT % 3) || '|' ||
      strftime(date_trunc('week', ts), '%a, %d %b %Y %H:%M:%S GMT') AS cur FROM events),
  moved AS (SELECT *, lag(cur) OVER (PARTITION BY app ORDER BY ts, cur) AS prev FROM snap)"""


def lists(rows: str) -> str:
    """``rows`` of (cluster_id, part, rank, id, created_at, key) as list items."""
    return (
        "string_agg('<li><b>#' || id || '</b> &mdash; ' || " + iso("created_at")
        + " || ' &mdash; event ' || id || ' &lt;' || key || '&gt;</li>', '' ORDER BY rank)"
    )


def digests(size: int) -> str:
    return HOURS + f""",
  listed AS (SELECT c.cluster_id, c.key, c.count, c.window_end, c.first_ticket_id, e.id, e.created_at, e.system_key,
      row_number() OVER (PARTITION BY c.cluster_id ORDER BY e.created_at, e.id) AS rank
    FROM clusters c JOIN evt e ON e.key = c.key AND e.created_at >= c.window_start AND e.created_at <= c.window_end),
  sys AS (SELECT cluster_id, string_agg(DISTINCT system_key, ', ' ORDER BY system_key) AS systems FROM listed GROUP BY cluster_id),
  items AS (SELECT cluster_id, key, count, window_end, ((rank - 1) // {size})::INT AS part, {lists('listed')} AS li
    FROM listed GROUP BY cluster_id, key, count, window_end, (rank - 1) // {size}),
  notes AS (SELECT i.cluster_id, i.part,
    CASE WHEN part = 0 THEN '<p><b>[correlated-ticket monitor] Possible incident cluster: ' || key || ' (' || key
      || ')</b></p><p>' || count || ' ticket(s) created within 60 min as of ' || {iso('window_end')}
      || ' (UTC).</p><p>Tickets (oldest first):</p>' ELSE '' END
    || '<ul>' || li || '</ul>' ||
    CASE WHEN part = 0 THEN '<p><b>System key(s):</b> ' || systems || '</p><p><i>Found by words that the ticket texts share; categories played no part. This is a guess at a common cause, not a confirmed incident. The tickets stay separate. Check the systems before you act.</i></p>' ELSE '' END AS note
    FROM items i JOIN sys USING (cluster_id))"""


def _build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["strip_html"] = f"SELECT page_id, {strip_html('html')} AS plain FROM pages"
    q["clean_text"] = "WITH src AS (SELECT 'd' AS src, doc_id AS id, text FROM documents UNION ALL SELECT 'p', page_id, html FROM pages)," + clean("c", "src") + " SELECT src, id, cleaned FROM c"
    q["redact"] = f"SELECT doc_id, {redact('text')} AS redacted FROM documents"
    q["redact_keys_only"] = f"SELECT doc_id, {redact('text', False)} AS redacted FROM documents"
    q["sanitize"] = "WITH " + clean("c", "conversations") + f" SELECT conv_id, turn, {redact('cleaned')} AS safe FROM c"
    q["secret_flags"] = f"SELECT doc_id, {has_secret('text')} AS has_secret, {secret_only('text')} AS secret_only FROM documents"
    q["normalize"] = "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS normal FROM documents"
    for name, out, patterns in (("error_codes", "codes", I.CODE_PATTERNS), ("hostnames", "hosts", I.HOST_PATTERNS)):
        q[name] = (
            f"WITH f AS (SELECT doc_id, {all_matches('text', patterns)} AS l FROM documents), "
            f"u AS (SELECT doc_id, lower(v) AS low, v, i FROM f, LATERAL (SELECT unnest(l) AS v, generate_subscripts(l, 1) AS i)), "
            f"d AS (SELECT doc_id, arg_min(v, i) AS v, min(i) AS i FROM u GROUP BY doc_id, low) "
            f"SELECT doc_id, coalesce(string_agg(v, '|' ORDER BY i), '') AS {out} FROM documents LEFT JOIN d USING (doc_id) GROUP BY doc_id"
        )
    q["apps"] = "SELECT doc_id, concat_ws('|', " + ", ".join(
        f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in I.WORDS) + ") AS apps FROM documents"
    q["dedupe_ci"] = (
        "WITH f AS (SELECT conv_id, turn, string_split(text, ' ') AS l FROM conversations), "
        f"u AS (SELECT conv_id, turn, {trim('v')} AS v, i FROM f, LATERAL (SELECT unnest(l) AS v, generate_subscripts(l, 1) AS i)), "
        "d AS (SELECT conv_id, turn, arg_min(v, i) AS v, min(i) AS i FROM u WHERE v <> '' GROUP BY conv_id, turn, lower(v)) "
        "SELECT conv_id, turn, coalesce(string_agg(v, '|' ORDER BY i), '') AS words FROM conversations LEFT JOIN d USING (conv_id, turn) GROUP BY conv_id, turn"
    )
    q["normalize_store"] = (
        "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'a' || c_custkey || '|b' "
        "WHEN c_custkey % 3 = 1 THEN 'x' || c_custkey || '|y' ELSE c_mktsegment END AS stores FROM customer"
    )
    q["parse_ts"] = (
        "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN " + text_time("o_orderdate + INTERVAL '10:11:12'")
        + " WHEN 1 THEN " + text_time("o_orderdate + INTERVAL '08:11:12'") + " WHEN 2 THEN " + text_time("o_orderdate")
        + " WHEN 3 THEN " + text_time("o_orderdate + INTERVAL '23:59:00'") + " ELSE 'none' END AS parsed FROM orders"
    )
    q["http_date_age"] = f"SELECT event_id, round((epoch_us({NOW}) - epoch_us(date_trunc('second', ts))) / 3600000000.0::DOUBLE, 6) AS hours FROM events"
    q["manifest_version"] = (
        "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '1.2.3.' || p_partkey "
        "WHEN p_partkey % 3 = 0 THEN '4.5.6.' || p_partkey ELSE 'none' END AS version FROM part"
    )
    head = f"lower({strip_html('page')})"
    q["vendor_status"] = (
        "WITH p AS (SELECT url, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS page FROM pages), "
        f"s AS (SELECT url AS vendor, CASE WHEN regexp_matches({head}, 'status is up') THEN 'up' "
        f"WHEN regexp_matches({head}, 'status is (down|degraded)|is experiencing (issues|an outage)') THEN 'issues' ELSE 'unknown' END AS status, "
        "CASE WHEN regexp_matches(page, '(?i)<time[^>]*datetime=\"') THEN 1 END AS checked FROM p) "
        "SELECT vendor, status, count(*) AS pages, count(checked) AS with_time FROM s GROUP BY vendor, status"
    )
    q["pool_hint"] = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'man' || (c_custkey % 90) ELSE 'none' END AS hint FROM customer"
    q["system_key"] = "SELECT event_id, event_type || '/' || (user_id % 3) AS system_key FROM events"
    q["feedback_outcome"] = (
        "SELECT event_id AS seq, CASE WHEN event_type = 'view' THEN 'unknown' WHEN value > 10 THEN 'resolved' "
        "ELSE 'not_resolved' END AS outcome FROM events"
    )
    q["recency_boost"] = (
        "SELECT doc_id AS ticket_id, CASE WHEN doc_id % 500 <= 30 THEN 1.15::DOUBLE WHEN doc_id % 500 <= 180 THEN 1.05::DOUBLE "
        "WHEN doc_id % 500 <= 365 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS factor FROM documents"
    )
    q["terminal_status"] = "SELECT o_orderkey, o_orderkey % 4 < 2 AS terminal FROM orders"
    q["age_days"] = "SELECT event_id, greatest(0, (event_id % 100 - 10) // 24)::INT AS days FROM events"
    q["log_properties"] = (
        "SELECT event_id, 'L' || user_id AS level, json_extract_string(props, '$.k') AS k, event_type, 6 AS n_fields FROM events"
    )
    norm = "(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ')"
    q["match_keys"] = (
        f"WITH n AS (SELECT doc_id, {norm} AS p FROM documents), h AS (SELECT doc_id, "
        "contains(p, ' that ') AS a, contains(p, ' with ') OR contains(p, ' this ') AS b, "
        "contains(p, 'of the') OR contains(p, 'and the') AS c, contains(p, ' from ') AS d FROM n), "
        "k AS (SELECT doc_id, concat_ws('|', CASE WHEN a THEN 'w:that' END, CASE WHEN b THEN 'w:with' END, "
        "CASE WHEN c THEN 'p:of-the' END, CASE WHEN d THEN 'w:from' END) AS keys FROM h) "
        "SELECT doc_id, keys, coalesce(nullif(split_part(keys, '|', 1), ''), 'none') AS primary_key, "
        "CASE split_part(keys, '|', 1) WHEN 'w:that' THEN 'That' WHEN 'w:with' THEN 'With' WHEN 'p:of-the' THEN 'Of the' "
        "WHEN 'w:from' THEN 'From' ELSE 'none' END AS label FROM k"
    )
    norm2 = norm.replace("lower(text)", "lower(lang || chr(10) || text)")
    q["live_tickets"] = (
        f"WITH n AS (SELECT doc_id, lang, text, {norm2} AS p FROM documents WHERE doc_id % 11 <> 0) "
        f"SELECT doc_id AS id, {text_time(chr(84) + 'IMESTAMP ' + chr(39) + '2024-01-01' + chr(39) + ' + to_hours(doc_id % 700)')} AS created, "
        "length(lang) + 1 + length(text) AS chars, lang AS system_key, "
        "contains(p, ' that ')::INT + (contains(p, ' with ') OR contains(p, ' this '))::INT + "
        "(contains(p, 'of the') OR contains(p, 'and the'))::INT + contains(p, ' from ')::INT AS n_keys FROM n"
    )
    q["symptom"] = "WITH " + PARTS + " SELECT id AS conv_id, symptom FROM texts"
    q["resolution"] = "WITH " + PARTS + " SELECT id AS conv_id, resolution, source FROM texts"
    both = "list_concat(" + all_matches("symptom_text", I.CODE_PATTERNS) + ", " + all_matches("resolution_text", I.CODE_PATTERNS) + ")"
    hosts = "list_concat(" + all_matches("symptom_text", I.HOST_PATTERNS) + ", " + all_matches("resolution_text", I.HOST_PATTERNS) + ")"
    q["documents"] = "WITH " + BUILT + f""",
  linked AS (SELECT conv_id FROM conversations WHERE turn = 1)
  SELECT id::VARCHAR AS id, id AS ticket_id, 'T-' || id AS display_id, 'Ticket ' || id AS subject, symptom_text, resolution_text,
    source AS resolution_source, true AS has_resolution, 'cat' || (id % 4) AS category,
    CASE WHEN id % 3 <> 0 THEN 'Sub ' || (id % 3) ELSE '' END AS sub_category,
    CASE WHEN id % 2 = 0 AND id % 6 <> 0 THEN (id % 6)::VARCHAR ELSE 'Sales' END AS department,
    (id % 3) || '-A|' || (id % 4) || '-B' AS store, 'Desk' AS "group", 'Incident' AS ticket_type, 'kb' AS tags,
    array_to_string({dedupe(both)}, '|') AS error_codes, array_to_string({dedupe(hosts)}, '|') AS hostnames,
    concat_ws('|', {", ".join(f"CASE WHEN contains(lower(symptom_text || ' ' || resolution_text), '{w}') THEN '{w}' END" for w in I.WORDS)}) AS apps,
    {text_time('created')} AS created, {text_time('closed')} AS closed, ((id % 9) * 20 // 24)::INT AS age_days,
    CASE WHEN id IN (SELECT conv_id FROM linked) THEN 'doc-' || id ELSE '' END AS linked_ids,
    CASE WHEN id IN (SELECT conv_id FROM linked) THEN 'https://kb/' || id ELSE '' END AS linked_urls
  FROM built"""
    q["build_metrics"] = "WITH " + BUILT + (
        f" SELECT (SELECT count(*) FROM tickets) AS tickets_seen, count(*) AS records_built, "
        f"(SELECT count(*) FROM tickets) - count(*) AS records_dropped, {text_time('max(updated)')} AS newest_updated_at FROM built"
    )
    q["upload_metrics"] = "SELECT count(*) FILTER (vec_id % 9 <> 0) AS upload_ok, count(*) FILTER (vec_id % 9 = 0) AS upload_failed FROM embeddings"
    q["metadata_filter"] = "SELECT doc_id AS ticket_id FROM documents WHERE doc_id % 10 <> 0 AND lang = 'en' AND source = 'src3' AND doc_id <> 17"
    q["upsert"] = """
  WITH t AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment, c_acctbal::FLOAT AS x FROM customer WHERE c_custkey % 4 <> 3),
  u AS (SELECT c_custkey, 'new ' || c_name AS c_name, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal + 1 END AS c_acctbal,
    CASE WHEN c_custkey % 3 = 0 THEN 1.0::FLOAT END AS x FROM customer WHERE c_custkey % 2 = 1)
  SELECT coalesce(t.c_custkey, u.c_custkey) AS c_custkey, coalesce(u.c_name, t.c_name) AS c_name,
    coalesce(CASE WHEN u.c_custkey IS NOT NULL THEN u.c_acctbal ELSE t.c_acctbal END, -1.0) AS c_acctbal,
    coalesce(t.c_mktsegment, 'none') AS c_mktsegment, coalesce(coalesce(u.x, t.x)::DOUBLE, -1.0) AS x0
  FROM t FULL JOIN u ON t.c_custkey = u.c_custkey"""
    q["upsert_buckets"] = q["upsert"]
    q["delete"] = "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"
    q["delete_buckets"] = q["delete"]
    q["document_count"] = "SELECT count(*) AS documents FROM documents"
    q["scan_documents"] = "SELECT doc_id AS ticket_id, lang AS category, source AS store, (doc_id % 500)::INT AS age_days FROM documents"
    q["facets_category"] = "SELECT lang AS value, count(*) AS documents FROM documents GROUP BY lang"
    q["facets_store"] = "SELECT source AS value, count(*) AS documents FROM documents GROUP BY source"
    q["reconcile"] = "SELECT doc_id::VARCHAR AS id FROM documents EXCEPT SELECT doc_id::VARCHAR FROM labels WHERE quality = 1"
    q["latest_n"] = "SELECT o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500"
    mark = (
        "mark AS (SELECT to_timestamp((epoch(min(o_orderdate)) + epoch(max(o_orderdate))) / 2)::TIMESTAMP AS m "
        "FROM orders WHERE o_orderstatus = 'F')"
    )
    q["incremental"] = f"WITH {mark} SELECT o_orderkey FROM orders, mark WHERE o_orderdate >= m"
    q["watermark"] = (
        f"WITH {mark}, b AS (SELECT max(o_orderdate) AS newest, count(*) AS n FROM orders, mark "
        "WHERE o_orderdate >= m AND o_orderstatus <> 'P') "
        f"SELECT 'full' AS run, {text_time('newest')} AS mark, n AS last_indexed_count FROM b "
        f"UNION ALL SELECT 'capped', {text_time('m')}, n FROM b, mark"
    )
    q["filter_tickets"] = "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 50 = 0 OR o_orderdate >= TIMESTAMP '1999-06-01'"
    q["latest_feedback"] = f"WITH {FB} SELECT ticket_id, suggested_ticket_id, seq, accepted FROM last"
    q["suggestion_stats"] = f"WITH {FB} SELECT * FROM stats"
    q["boost_table"] = f"WITH {FB} SELECT * FROM boosts"
    q["accept_rate_listing"] = f"WITH {FB} SELECT suggested_ticket_id, accept_rate FROM stats ORDER BY suggested_ticket_id LIMIT 10"
    q["signature_groups"] = f"WITH {SIG} SELECT fix_key, size, first_ticket_id FROM grp"
    q["cluster_mates"] = f"WITH {SIG} SELECT doc_id AS ticket_id, g.fix_key, size - 1 AS mates FROM sig s JOIN grp g ON sha256(s.s) = g.fix_key WHERE length(s.s) >= 20"
    q["gold_set"] = f"WITH {SIG} SELECT doc_id AS query_ticket_id, expected_count, fix_key, lang AS category, false AS labeled FROM gold"
    q["gold_members"] = f"WITH {SIG} SELECT fix_key, doc_id AS ticket_id FROM gold"
    q["gold_sample"] = "SELECT doc_id AS ticket_id FROM documents WHERE text <> '' ORDER BY md5('42:' || doc_id), doc_id LIMIT 50"
    q["gold_summary"] = f"WITH {SIG} SELECT count(*) AS items, count(*) FILTER (expected_count = 1) AS single_fix, count(*) FILTER (expected_count > 1) AS with_mates FROM gold"
    q["eval_loo"] = report(True)
    q["eval_integrity"] = report(False)
    q["eval_misses"] = f"""WITH {vector_hits(True, 3)}
  SELECT query_id AS ticket_id, 'vector ' || query_id AS query, q_label::VARCHAR AS fix_key, string_agg(ticket_id::VARCHAR, '|' ORDER BY rank) AS got
  FROM hits GROUP BY query_id, q_label HAVING count(*) FILTER (label = q_label) = 0"""
    q["relevant_found"] = f"""WITH {vector_hits(True, 3)}
  SELECT query_id AS query_ticket_id, count(*) FILTER (abs(ticket_id - query_id) <= 100)::INT AS n_found FROM hits GROUP BY query_id"""
    q["knn_topk"] = f"WITH {vector_hits(True, 20)} SELECT query_id, ticket_id, rank, round(score, 6) AS score FROM hits"
    plain = "kd AS (SELECT doc_id AS ticket_id, text FROM documents), kq AS (SELECT item_id AS query_id, text FROM benchmark),"
    q["bm25"] = f"WITH {plain} {bm25('kd', 'kq', 20)} SELECT query_id, ticket_id, rank, round(score, 6) AS score FROM lex"
    q["bm25_stored"] = q["bm25"]
    q["knn_indexed"] = q["knn_topk"]
    q["embed"] = r"""WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS w FROM documents),
  hashed AS (SELECT doc_id, ('0x' || md5(w)[1:8])::UBIGINT AS h FROM words),
  places AS (SELECT doc_id, (h % 64)::INT AS i, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::BIGINT AS c FROM hashed GROUP BY ALL),
  norms AS (SELECT doc_id, sqrt(sum(c * c)::DOUBLE)::FLOAT AS n FROM places GROUP BY doc_id),
  probes AS (SELECT doc_id, sum((c::FLOAT / n)::DOUBLE * (i + 1)) AS p FROM places JOIN norms USING (doc_id) WHERE n > 0 GROUP BY doc_id)
  SELECT d.doc_id AS ticket_id, 64 AS dims, round(CASE WHEN p IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE, 3) AS norm, round(coalesce(p, 0.0)::DOUBLE, 6) AS probe
  FROM documents d LEFT JOIN probes USING (doc_id)"""
    q["rrf"] = f"WITH {fused('', 20)} SELECT query_id, ticket_id, round(score, 9) AS score FROM rr"
    q["hybrid_filtered"] = f"""WITH {fused("WHERE doc_id % 10 <> 0 AND lang = 'en'", 20, TWICE)},
  mixed AS (SELECT query_id, ticket_id, rr.score, 'hybrid' AS mode FROM rr JOIN kq USING (query_id) WHERE kq.embedding IS NOT NULL
    UNION ALL SELECT query_id, ticket_id, lex.score, 'bm25-only' FROM lex JOIN kq USING (query_id) WHERE kq.embedding IS NULL)
  SELECT query_id, ticket_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ticket_id) AS rank,
    round(score, 9) AS score, mode FROM mixed QUALIFY rank <= 5"""
    en = f"kd AS (SELECT doc_id AS ticket_id, {TWICE} AS text, text AS raw FROM documents WHERE doc_id % 10 <> 0 AND lang = 'en'), kq AS (SELECT item_id AS query_id, text FROM benchmark),"
    q["search_kb"] = f"""WITH {FB}, {en} {bm25('kd', 'kq', 40)},
  pool AS (SELECT * FROM lex WHERE rank <= 10),
  w AS (SELECT p.query_id, p.ticket_id, p.score * CASE WHEN p.ticket_id % 500 <= 30 THEN 1.15::DOUBLE WHEN p.ticket_id % 500 <= 180 THEN 1.05::DOUBLE
      WHEN p.ticket_id % 500 <= 365 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END * coalesce(b.boost, 1.0) AS s
    FROM pool p LEFT JOIN boosts b USING (ticket_id))
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, ticket_id) AS rank, ticket_id, raw AS symptom,
    length(raw) AS resolution_chars, (ticket_id % 500)::INT AS age_days, round(s, 4) AS score, 'bm25-only' AS mode
  FROM w JOIN kd USING (ticket_id) QUALIFY rank <= 3"""
    q["search_kb_hybrid"] = f"""WITH {FB}, {fused("WHERE doc_id % 10 <> 0 AND lang = 'en'", 40, TWICE)},
  mixed AS (SELECT query_id, ticket_id, rr.score, 'hybrid' AS mode FROM rr JOIN kq USING (query_id) WHERE kq.embedding IS NOT NULL
    UNION ALL SELECT query_id, ticket_id, lex.score, 'bm25-only' FROM lex JOIN kq USING (query_id) WHERE kq.embedding IS NULL),
  pool AS (SELECT * FROM mixed QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ticket_id) <= 10),
  w AS (SELECT p.query_id, p.ticket_id, p.mode, p.score * CASE WHEN p.ticket_id % 500 <= 30 THEN 1.15::DOUBLE WHEN p.ticket_id % 500 <= 180 THEN 1.05::DOUBLE
      WHEN p.ticket_id % 500 <= 365 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END * coalesce(b.boost, 1.0) AS s
    FROM pool p LEFT JOIN boosts b USING (ticket_id))
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, ticket_id) AS rank, ticket_id,
    (ticket_id % 500)::INT AS age_days, mode FROM w QUALIFY rank <= 3"""
    q["trailing_count"] = "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW) AS trailing FROM events"
    q["ticket_ranks"] = "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rank FROM events"
    q["clusters_at"] = (
        f"SELECT event_type AS key, count(DISTINCT event_id) AS count, arg_min(event_id, struct_pack(a := ts, b := event_id)) AS first_ticket_id, "
        f"{text_time('min(ts)')} AS first_created_at FROM events WHERE ts >= {NOW} - INTERVAL 60 MINUTE GROUP BY event_type HAVING count(DISTINCT event_id) >= 3"
    )
    q["first_ticket"] = "SELECT event_type AS key, arg_min(event_id, struct_pack(a := ts, b := event_id)) AS first_ticket_id FROM events GROUP BY event_type"
    q["baseline_rows"] = f"WITH {BASE} SELECT * FROM base"
    q["baseline_full_weeks"] = f"WITH {baseline('[1, 2]', 2)} SELECT * FROM base"
    q["week_starts"] = (
        f"WITH n AS (SELECT date_trunc('week', timezone('{TZ}', max(ts) AT TIME ZONE 'UTC')) AS wk FROM events) "
        "SELECT strftime(wk - to_days(7 * i::INT), '%Y-%m-%d') AS week_start FROM n, range(4) r(i)"
    )
    q["baseline_threshold"] = f"""WITH {BASE},
  touched AS (SELECT DISTINCT key, system_key FROM evt WHERE created_at >= {NOW} - INTERVAL 60 MINUTE),
  l AS (SELECT timezone('{TZ}', {NOW} AT TIME ZONE 'UTC') AS lt)
  SELECT t.key, round(max(CASE WHEN b.key IS NOT NULL THEN greatest(3.0::DOUBLE, b.median + 3.0::DOUBLE * (1.4826::DOUBLE * b.mad)) END), 6) AS threshold
  FROM touched t CROSS JOIN l LEFT JOIN base b ON b.key = t.system_key AND b.dow = isodow(lt) - 1 AND b.hour = hour(lt) GROUP BY t.key"""
    q["candidate_ticks"] = f"WITH {CANDIDATES} SELECT key, {text_time('tick')} AS tick, count, first_ticket_id, round(threshold, 6) AS threshold FROM cand"
    q["cooldown_alerts"] = f"""WITH RECURSIVE {FIRED} SELECT key, {text_time('tick')} AS opened, count, first_ticket_id,
  {text_time("tick + INTERVAL 120 MINUTE")} AS cooldown_until, 'open' AS status FROM alerts"""
    q["replay_once"] = f"""WITH {BASE},
  n AS (SELECT max(created_at) + INTERVAL 1 MINUTE AS t FROM evt),
  w AS (SELECT e.*, t, timezone('{TZ}', t AT TIME ZONE 'UTC') AS lt FROM evt e, n WHERE created_at >= t - INTERVAL 60 MINUTE),
  j AS (SELECT w.*, CASE WHEN b.key IS NOT NULL THEN greatest(3.0::DOUBLE, b.median + 3.0::DOUBLE * (1.4826::DOUBLE * b.mad)) END AS thr
    FROM w LEFT JOIN base b ON b.key = w.system_key AND b.dow = isodow(lt) - 1 AND b.hour = hour(lt))
  SELECT key, {text_time('max(t)')} AS tick, count(*) AS count, arg_min(id, struct_pack(a := created_at, b := id)) AS first_ticket_id
  FROM j GROUP BY key HAVING count(*) >= 2 AND (max(thr) IS NULL OR count(*) >= max(thr))"""
    q["in_cooldown"] = f"""SELECT user_id::VARCHAR AS key, count(*) AS count FROM events WHERE user_id NOT IN (
  SELECT user_id FROM events WHERE event_type = 'error' AND ts <= {NOW} AND ts + INTERVAL 2 HOUR > {NOW}) GROUP BY user_id"""
    q["lifecycle"] = (
        "SELECT o_orderpriority AS key, CASE WHEN o_orderdate + INTERVAL 2 HOUR < TIMESTAMP '1998-01-01 02:00:00' THEN 'closed' ELSE 'open' END AS status, "
        "count(*) AS alerts, sum(o_orderkey)::BIGINT AS ids FROM orders GROUP BY ALL"
    )
    q["latest_alert"] = (
        f"SELECT o_orderpriority AS key, o_orderkey AS id, {text_time('o_orderdate')} AS opened FROM orders "
        "QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"
    )
    q["verdicts"] = """
  WITH v AS (SELECT l_orderkey AS id, CASE l_returnflag WHEN 'A' THEN 'accept' WHEN 'R' THEN 'reject' ELSE 'unsure' END AS verdict,
    l_linestatus = 'F' AS close, l_shipdate AS made, l_linenumber AS seq FROM lineitem),
  l AS (SELECT id, verdict FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY made DESC, seq DESC, verdict DESC) = 1),
  c AS (SELECT id, bool_or(close AND verdict IN ('accept', 'reject')) AS closes FROM v GROUP BY id)
  SELECT o_orderkey AS id, CASE WHEN closes THEN 'closed' ELSE 'open' END AS status, coalesce(verdict, 'none') AS verdict
  FROM orders LEFT JOIN l ON l.id = o_orderkey LEFT JOIN c ON c.id = o_orderkey"""
    q["signal_counts"] = f"""WITH {SIGNALS} SELECT cluster_id, signal_key, role, 'horizon' AS stream,
  CASE WHEN role = 'cause' THEN 'presence' ELSE 'elevation' END AS mode, count, prior, elevated FROM scored"""
    q["confidence"] = f"WITH {TIERS} SELECT * FROM tiers"
    q["alert_evidence"] = f"""WITH {POOLS},
  tiers AS (SELECT cluster_id, CASE
      WHEN bool_or(role = 'cause' AND elevated) AND bool_or(role = 'effect' AND elevated) THEN 'likely'
      WHEN bool_or(elevated) THEN 'consistent with' ELSE 'none' END AS confidence,
      string_agg(concat_ws(':', signal_key, role, count, prior, elevated), '|' ORDER BY signal_key) AS signals
    FROM scored GROUP BY cluster_id),
  named AS (SELECT cluster_id, string_agg(pool, '|' ORDER BY rank) AS pools FROM pools GROUP BY cluster_id)
  SELECT cluster_id, confidence, signals, coalesce(pools, '') AS pools FROM tiers LEFT JOIN named USING (cluster_id)"""
    q["log_samples"] = f"WITH {SAMPLES} SELECT cluster_id, signal_key, ord::INT AS ord, event_id, desktop FROM samples WHERE ord < 3"
    q["sample_fields"] = (
        f"SELECT CASE WHEN event_type = 'signup' THEN 'log.signup' ELSE 'log.error' END AS signal_key, {text_time('ts')} AS at, "
        "'host' || (user_id % 5) AS source, event_type AS event, 'Pool ' || (user_id % 4) AS desktop, user_id::VARCHAR AS user "
        "FROM events WHERE event_type IN ('signup', 'error', 'purchase')"
    )
    q["pools_seen"] = f"WITH {POOLS} SELECT cluster_id, rank::INT AS rank, pool, n FROM pools"
    q["log_window"] = "SELECT event_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 06:00:00'"
    q["error_rate"] = f"""WITH {HOURS}, l AS (SELECT ts FROM events WHERE event_type = 'purchase' AND value > 15)
  SELECT cluster_id, 'purchase.log_errors' AS signal_key, count(ts) FILTER (ts >= window_start AND ts <= window_end) AS count,
    count(ts) FILTER (ts >= window_start - INTERVAL 1 HOUR AND ts < window_start) AS prior
  FROM clusters LEFT JOIN l ON ts >= window_start - INTERVAL 1 HOUR AND ts <= window_end GROUP BY cluster_id"""
    q["metric_elevation"] = f"""WITH {HOURS},
  m AS (SELECT * FROM (VALUES ('m.view', 'view', NULL), ('m.click', 'click', 60.0), ('m.signup', 'signup', NULL)) AS v(mk, metric, thr)),
  ask AS (SELECT c.*, mk, metric, thr FROM clusters c, m WHERE CASE WHEN contains(key, 'view') OR contains(key, 'err') THEN mk IN ('m.view', 'm.click')
    WHEN contains(key, 'sign') THEN mk = 'm.signup' ELSE mk IN ('m.view', 'm.signup') END),
  p AS (SELECT cluster_id, mk, thr, max(value) FILTER (ts > window_start) AS cur, max(value) FILTER (ts <= window_start) AS prior
    FROM ask LEFT JOIN events e ON e.event_type = metric AND ts > window_start - INTERVAL 1 HOUR AND ts <= window_end GROUP BY cluster_id, mk, thr)
  SELECT cluster_id, 'metric.' || mk AS signal_key, round_even(coalesce(cur, 0), 0)::BIGINT AS count, round_even(coalesce(prior, 0), 0)::BIGINT AS prior,
    coalesce(cur > thr, false) AS threshold_hit, coalesce(CASE WHEN prior <> 0 THEN round(cur / prior, 4) END, -1.0) AS ratio FROM p"""
    q["change_overlap"] = f"WITH {SHIP} SELECT cluster_id, count(id) AS count FROM ship LEFT JOIN pairs USING (cluster_id) GROUP BY cluster_id"
    q["change_samples"] = f"WITH {SHIP} SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY id)::INT AS rank, id, shown AS subject FROM pairs QUALIFY rank <= 6"
    q["change_updates"] = f"""WITH {SHIP} SELECT cluster_id, count(id) AS count FROM ship LEFT JOIN chg ON s >= ws - INTERVAL 72 HOUR GROUP BY cluster_id"""
    q["filter_changes"] = """SELECT o_orderkey AS id, o_orderpriority AS subject, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS updated_at
  FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01'"""
    q["explode_conversations"] = """SELECT conv_id AS ticket_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS seq,
  role = 'system' AS private, role = 'user' AS incoming, text AS body_text FROM conversations"""
    q["feedback_rows"] = f"""SELECT event_id AS seq, event_id % 500 AS ticket_id, user_id AS suggested_ticket_id,
  coalesce(CASE WHEN value > 5 THEN value > 10 END, false) AS accepted, CASE WHEN event_type = 'error' THEN 'cluster' ELSE 'retrieval' END AS kind,
  true AS no_rank, {text_time('ts')} AS at FROM events"""
    q["score_search"] = f"SELECT * EXCLUDE (passed) FROM ({q['eval_loo']})"
    q["pool_errors"] = """
  WITH h AS (SELECT 'c' || c_custkey AS cluster_id, CASE WHEN c_custkey % 3 <> 0 THEN 'man' || (c_custkey % 150) END AS hint FROM customer),
  p AS (SELECT 'man' || s_suppkey || '-vdi pool ' || s_suppkey AS n, s_suppkey % 5 AS e FROM supplier)
  SELECT cluster_id, coalesce(sum(e), 0)::BIGINT AS count FROM h LEFT JOIN p ON hint IS NULL OR contains(n, hint) GROUP BY cluster_id"""
    q["resolve_pool"] = """
  WITH h AS (SELECT 'c' || c_custkey AS cluster_id, CASE WHEN c_custkey % 3 <> 0 THEN 'man' || (c_custkey % 150) END AS hint FROM customer),
  p AS (SELECT s_suppkey AS ord, 'man' || s_suppkey || '-vdi' AS name, 'man' || s_suppkey || '-vdi pool ' || s_suppkey AS n FROM supplier)
  SELECT cluster_id, coalesce(arg_min(name, ord), 'none') AS pool FROM h LEFT JOIN p ON contains(n, hint) GROUP BY cluster_id"""
    q["aligned_pools"] = f"""WITH {SAMPLES},
  h AS (SELECT cluster_id, coalesce(pool, 'pool 1') AS pool_hint FROM clusters),
  n AS (SELECT cluster_id, desktop_id AS name FROM picked UNION SELECT cluster_id, desktop FROM picked),
  m AS (SELECT cluster_id, name FROM n JOIN h USING (cluster_id) WHERE contains(lower(name), pool_hint))
  SELECT h.cluster_id, h.pool_hint, coalesce(string_agg(name, ', ' ORDER BY name), 'none matched') AS aligned
  FROM h LEFT JOIN m USING (cluster_id) GROUP BY h.cluster_id, h.pool_hint"""
    q["cluster_keywords"] = f"WITH {HOURS} SELECT cluster_id, CASE WHEN key = 'error' THEN '' ELSE key END AS keywords FROM clusters"
    q["cluster_pool_hint"] = f"""WITH {HOURS},
  t AS (SELECT c.cluster_id, e.id, e.created_at FROM clusters c JOIN evt e ON e.key = c.key
    AND date_trunc('hour', e.created_at) = c.window_start WHERE e.id % 2 = 0)
  SELECT cluster_id, 'gr' || (arg_min(id, struct_pack(a := created_at, b := id)) % 30) AS pool_hint FROM t GROUP BY cluster_id"""
    q["version_transitions"] = f"WITH {SNAPS} SELECT event_id, coalesce(prev <> cur, false) AS changed, coalesce(prev, 'none') AS previous FROM moved"
    q["version_change"] = f"""WITH {HOURS}, {SNAPS},
  latest AS (SELECT c.cluster_id, c.window_end, m.app, arg_max(m.published, struct_pack(a := ts, b := cur)) AS published,
      arg_max(coalesce(prev <> cur, false), struct_pack(a := ts, b := cur)) AS changed
    FROM clusters c JOIN moved m ON m.ts <= c.window_end WHERE contains(c.key, 'click') GROUP BY c.cluster_id, c.window_end, m.app)
  SELECT cluster_id, 'click.version_change' AS signal_key, count(*) AS count FROM latest
  WHERE changed OR (contains(lower(app), 'prod') AND window_end - published <= INTERVAL 100 HOUR) GROUP BY cluster_id"""
    q["vendor_signal"] = f"WITH {HOURS} SELECT cluster_id, (SELECT count(DISTINCT url) FROM pages) AS count FROM clusters"
    rises = "count >= 3 AND count >= greatest(3, 2 * prior)"
    q["corroborate"] = f"""WITH s AS (
  SELECT cluster_id, signal_key, role, count, prior, elevated FROM ({q["signal_counts"]})
  UNION ALL SELECT cluster_id, signal_key, 'effect', count, prior, {rises} FROM ({q["error_rate"]})
  UNION ALL SELECT cluster_id, 'saas_status', 'cause', count, 0, count > 0 FROM ({q["vendor_signal"]})
  UNION ALL SELECT cluster_id, signal_key, 'effect', count, prior, threshold_hit OR ({rises}) FROM ({q["metric_elevation"]})
  UNION ALL SELECT cluster_id, signal_key, 'cause', count, 0, count > 0 FROM ({q["version_change"]}))
  SELECT cluster_id, CASE WHEN bool_or(role = 'cause' AND elevated) AND bool_or(role = 'effect' AND elevated) THEN 'likely'
      WHEN bool_or(elevated) THEN 'consistent with' ELSE 'none' END AS confidence,
    string_agg(concat_ws(':', signal_key, role, count, prior, elevated), '|' ORDER BY signal_key) AS signals, any_value(pools) AS pools
  FROM s LEFT JOIN (SELECT cluster_id, pools FROM ({q["alert_evidence"]})) USING (cluster_id) GROUP BY cluster_id"""
    q["digests"] = f"WITH {digests(500)} SELECT cluster_id, part, note FROM notes"
    q["digest_parts"] = f"WITH {digests(3)} SELECT cluster_id, part, length(note)::INT AS chars FROM notes"
    q["outbox"] = f"""WITH {digests(500)} SELECT cluster_id, key AS cluster_key, key AS label, count, first_ticket_id,
  ((count(*) + 499) // 500)::INT AS parts, any_value(note) AS note
  FROM listed JOIN notes n USING (cluster_id) WHERE n.part = 0 GROUP BY cluster_id, key, count, first_ticket_id"""
    q["outbox_tickets"] = f"WITH {digests(500)} SELECT cluster_id, rank, id AS ticket_id, ((rank - 1) // 500)::INT AS part FROM listed"
    item = (
        "'<li>[' || role || '] <b>' || signal_key || '</b> @ ' || stream || ': ' || count || CASE WHEN count = 1 THEN ' event' ELSE ' events' END"
        " || CASE WHEN role = 'effect' THEN ' (prior window ' || prior || ')' ELSE '' END || CASE WHEN role = 'effect' AND elevated THEN ' *' ELSE '' END || '</li>'"
    )
    q["digest_evidence"] = f"""WITH s AS (
  SELECT cluster_id, signal_key, role, 'horizon' AS stream, count, prior, elevated FROM ({q["signal_counts"]})
  UNION ALL SELECT cluster_id, signal_key, 'effect', 'seq', count, prior, {rises} FROM ({q["error_rate"]})
  UNION ALL SELECT cluster_id, 'saas_status', 'cause', 'status-pages', count, 0, count > 0 FROM ({q["vendor_signal"]})
  UNION ALL SELECT cluster_id, signal_key, 'effect', 'metrics', count, prior, threshold_hit OR ({rises}) FROM ({q["metric_elevation"]})
  UNION ALL SELECT cluster_id, signal_key, 'cause', 'versions', count, 0, count > 0 FROM ({q["version_change"]})),
  lines AS (SELECT cluster_id, string_agg({item}, '' ORDER BY signal_key) AS li FROM s GROUP BY cluster_id)
  SELECT cluster_id, '<p><b>Corroborators</b> &mdash; ' || confidence || ':</p><ul>' || li || '</ul>' || CASE WHEN pools <> ''
    THEN '<p><b>Pools seen:</b> ' || replace(pools, '|', ', ') || '</p>' ELSE '' END AS section
  FROM ({q["corroborate"]}) JOIN lines USING (cluster_id)"""
    q["stream_replay"] = f"""WITH RECURSIVE {FIRED}
  SELECT key, {text_time('tick')} AS opened, count, first_ticket_id, 'open' AS status FROM alerts"""
    return q


ORACLES = _build()
