"""The same queries as plain SQL over the given tables, written independently."""

from __future__ import annotations

MASK = 4294967295

# -- views ------------------------------------------------------------------

KV = """kv AS (SELECT event_id AS seq, 'key' || (user_id % 20) AS key,
 CAST(floor(value) AS INTEGER) % 10 AS val FROM events)"""
KV_WIDE = "kv_wide AS (SELECT l_orderkey AS seq, 'key' || l_partkey AS key, l_linenumber AS val FROM lineitem)"
NFRAMES = "(SELECT count(*) // 10 FROM embeddings)"
FRAMES = f"""frames AS (SELECT vec_id % 10 AS row_id, vec_id // 10 AS projection_id, vec_id // 10 + 1 AS seq,
 (vec_id // 10 + 0.37::DOUBLE) * (pi() / {NFRAMES}) AS theta, 0::DOUBLE AS center, embedding AS ray FROM embeddings)"""
IMAGES = """images AS (SELECT vec_id AS seq, vec_id AS unique_id, vec_id * 0.01::DOUBLE AS theta, embedding AS data FROM embeddings)"""
CALIB = f"""{FRAMES}, coded AS (SELECT *, CASE projection_id % 25 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 2
 WHEN 3 THEN 5 WHEN 4 THEN 3 ELSE 1 END AS itype FROM frames),
calib AS (SELECT row_id, seq, itype, generate_subscripts(ray, 1) - 1 AS pix, unnest(ray) AS raw FROM coded),
samples AS (SELECT row_id, seq, itype, CAST(pix AS INTEGER) AS pix, CAST(CASE WHEN itype IN (2, 4) THEN abs(raw::DOUBLE) + 2
 WHEN itype IN (3, 5) THEN abs(raw::DOUBLE) * 0.1::DOUBLE ELSE abs(raw::DOUBLE) END AS FLOAT)::DOUBLE AS x FROM calib)"""
DIRTY = f"""{FRAMES}, longform AS (SELECT row_id, projection_id, CAST(generate_subscripts(ray, 1) - 1 AS INTEGER) AS pix,
 unnest(ray) AS raw FROM frames),
dirty AS (SELECT row_id, projection_id, pix, CASE pix % 8 WHEN 0 THEN 'nan'::FLOAT WHEN 1 THEN 'inf'::FLOAT
 WHEN 2 THEN '-inf'::FLOAT WHEN 3 THEN 0::FLOAT WHEN 4 THEN 1e-40::FLOAT ELSE raw END AS x FROM longform)"""
ARRIVALS = """arrivals AS (SELECT user_id AS row_id, event_id, ts, CAST(floor(value) AS BIGINT) AS seq,
 value * 0.01::DOUBLE AS theta, value AS center, CASE WHEN event_id % 97 = 0 THEN 'FIN' ELSE 'DATA' END AS kind,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
 count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


def fnv_floats(ray: str) -> str:
    bits = f"list_transform({ray}, lambda x: (x::FLOAT::BIT)::UINTEGER::BIGINT)"
    octets = f"flatten(list_transform({bits}, lambda b: [b & 255, (b >> 8) & 255, (b >> 16) & 255, b >> 24]))"
    return f"CAST(list_reduce({octets}, lambda h, b: (xor(h, b) * 16777619) & {MASK}, 2166136261::BIGINT) AS BIGINT)"


def codes(text: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda c: unicode(c)::BIGINT)"


def java_hash_sql(text: str) -> str:
    h = f"list_reduce({codes(text)}, lambda a, c: (a * 31 + c) & {MASK}, 0::BIGINT)"
    return f"(({h} + 2147483648) % 4294967296 - 2147483648)"


def checksum_sql(text: str) -> str:
    eight = "list_reduce(range(8), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b))"
    crc = f"xor(list_reduce({codes(text)}, lambda c, b: {eight}, 4294967295::BIGINT), 4294967295)"
    rounds = ("list_reduce(range(1000)::UBIGINT[], lambda c, i: "
              f"xor((c & 9223372036854775807) << 1, c >> 3), CAST({crc} AS UBIGINT))")
    return (f"CAST(CASE WHEN {rounds} >= 9223372036854775808 THEN {rounds}::HUGEINT - 18446744073709551616 "
            f"ELSE {rounds}::HUGEINT END AS BIGINT)")


CHECKSUMS = f"sums AS (SELECT key, {checksum_sql('key')} AS checksum FROM (SELECT DISTINCT key FROM kv))"
CHECKSUMS_WIDE = CHECKSUMS.replace("FROM kv)", "FROM kv_wide)")
HASHED = f"hashed AS (SELECT *, abs({java_hash_sql('key')}) % 4 AS p FROM kv)"
SHIFTED = f"{KV}, {HASHED}, shifted AS (SELECT seq, key, val, CASE WHEN p = 0 THEN 1 ELSE p END AS sink_id FROM hashed)"
INTERLEAVED = f"""{KV}, {HASHED}, interleaved AS (
 SELECT seq, key, val, p AS sink_id FROM hashed WHERE p <> 0 UNION ALL
 SELECT seq, key, val, ((row_number() OVER (ORDER BY seq) - 1) // 1000) % 3 + 1 FROM hashed WHERE p = 0)"""


def _chain(first: str, steps: list[str]) -> str:
    """CTEs t0, t1, ... each replacing column h by an expression of it."""
    out = [f"t0 AS ({first})"]
    for i, step in enumerate(steps):
        out.append(f"t{i + 1} AS (SELECT * REPLACE (CAST({step} AS BIGINT) AS h) FROM t{i})")
    return ", ".join(out)


def _mul(factor: int) -> str:
    return f"(h::HUGEINT * {factor}) % 4294967296"


def _rot(bits: int) -> str:
    return f"((h << {bits}) & {MASK}) | (h >> {32 - bits})"


MURMUR = [_mul(0xCC9E2D51), _rot(15), _mul(0x1B873593), _rot(13), f"xor((h * 5 + 3864292196) & {MASK}, 4)",
          "xor(h, h >> 16)", _mul(0x85EBCA6B), "xor(h, h >> 13)", _mul(0xC2B2AE35), "xor(h, h >> 16)"]


def murmur_over(source: str, value: str, keep: str, prefix: str) -> str:
    """Chain of CTEs ending in `prefix`: columns keep.. and h, the hash of value."""
    text = _chain(f"SELECT {keep}, {value} & {MASK} AS h FROM {source}", MURMUR)
    text = text.replace(" t", f" {prefix}_t").replace("t0 AS", f"{prefix}_t0 AS", 1)
    return f"{text}, {prefix} AS (SELECT * FROM {prefix}_t{len(MURMUR)})"


# -- reconstruction ---------------------------------------------------------
# Geometry by grid lines: all crossings of a ray with vertical and horizontal
# lines, sorted along x; neighbours bound one pixel.

def weights(source: str, extra: str, n: int = 64) -> str:
    half = n / 2
    return f"""grid AS (SELECT CAST(i AS DOUBLE) - {half}::DOUBLE AS g FROM range(0, {n + 1}) t(i)),
cols AS (SELECT CAST(i AS INTEGER) AS col FROM range(0, {n}) t(i)),
rayline AS (SELECT {extra}, col, sin(theta) AS s, cos(theta) AS c,
 (1 - {n}) / 2.0::DOUBLE + col + ({half}::DOUBLE - mid + 1e-6::DOUBLE) AS off FROM {source}, cols),
points AS (
 SELECT {extra}, col, g AS x, (off + g * s) / c AS y FROM rayline, grid WHERE c <> 0 AND abs((off + g * s) / c) < {half}
 UNION ALL
 SELECT {extra}, col, (g * c - off) / s AS x, g AS y FROM rayline, grid WHERE s <> 0 AND abs((g * c - off) / s) < {half}),
spans AS (SELECT {extra}, col, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM points
 WINDOW w AS (PARTITION BY {extra}, col ORDER BY x, y * sign(tan(theta)))),
weight AS (SELECT {extra}, col, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS len,
 CAST(floor((x + x2) / 2 + {half}) + floor((y + y2) / 2 + {half}) * {n} AS INTEGER) AS pix FROM spans WHERE x2 IS NOT NULL)"""


MESSAGES = f"""{FRAMES}, angles AS (SELECT DISTINCT seq, theta, 32::DOUBLE AS mid FROM frames),
sample AS (SELECT row_id, seq, CAST(generate_subscripts(ray, 1) - 1 AS INTEGER) AS col, unnest(ray)::DOUBLE AS v FROM frames)"""
START = "start AS (SELECT row_id, CAST((seq - 1) % 64 * 64 + col AS INTEGER) AS pix, sum(v) AS val FROM sample GROUP BY ALL)"
NORM = "norm AS (SELECT seq, col, sum(len * len) AS a2 FROM weight GROUP BY ALL)"


def clean_round(x: str) -> str:
    """Six decimals without a negative zero."""
    return f"CASE WHEN round({x}, 6) = 0 THEN 0::DOUBLE ELSE round({x}, 6) END"


def reconstruction(mid: str, length: int, step: int, sweeps: int) -> str:
    """Passes as a recursive query; column k is the number of passes done."""
    size = f"CASE WHEN (n.k - 1) * {step} < {length} THEN n.k * {step} ELSE {max(length, step)} END"
    body = f"""n AS (SELECT row_id, pix, val, k + 1 AS k FROM image WHERE (k + 1) * {step} <= {NFRAMES}),
 inwin AS (SELECT DISTINCT n.row_id, seq FROM (SELECT DISTINCT row_id, k FROM n) n JOIN (SELECT DISTINCT row_id, seq FROM frames) f
  ON f.row_id = n.row_id AND f.seq <= n.k * {step} AND f.seq > n.k * {step} - ({size}))"""
    previous = "n"
    for i in range(sweeps):
        body += f""",
 sim{i} AS (SELECT m.row_id, w.seq, w.col, sum(w.len * p.val) AS sim FROM inwin m JOIN weight w ON w.seq = m.seq
  JOIN {previous} p ON p.row_id = m.row_id AND p.pix = w.pix GROUP BY ALL),
 upd{i} AS (SELECT s.row_id, s.seq, s.col, (v - sim) / a2 AS u FROM sim{i} s JOIN sample USING (row_id, seq, col) JOIN norm USING (seq, col)),
 chg{i} AS (SELECT u.row_id, w.pix, sum(w.len * u.u) / sum(w.len) AS d FROM upd{i} u JOIN weight w ON w.seq = u.seq AND w.col = u.col GROUP BY ALL),
 img{i} AS (SELECT p.row_id, p.pix, p.val + coalesce(c.d, 0) AS val, p.k FROM {previous} p LEFT JOIN chg{i} c ON c.row_id = p.row_id AND c.pix = p.pix)"""
        previous = f"img{i}"
    messages = MESSAGES.replace("32::DOUBLE AS mid", f"{mid} AS mid")
    return f"""WITH RECURSIVE {messages}, {weights('angles', 'seq, theta')}, {NORM},
image AS (SELECT row_id, CAST(i AS INTEGER) AS pix, 0::DOUBLE AS val, CAST(0 AS BIGINT) AS k
 FROM (SELECT DISTINCT row_id FROM frames), range(0, 4096) t(i)
 UNION ALL (WITH {body} SELECT row_id, pix, val, k FROM {previous}))"""


GATHER = f"""{FRAMES}, longform AS (SELECT row_id, projection_id, CAST(generate_subscripts(ray, 1) - 1 AS INTEGER) AS pix,
 unnest(ray)::DOUBLE AS val FROM frames),
messages AS (SELECT row_id, pix, val + again AS val, lpad(projection_id::VARCHAR, 6, '0') AS iteration,
 (row_id + again * 7) * 2 + again AS arrival FROM longform, (VALUES (0), (1)) r(again)
 WHERE NOT (projection_id % 7 = 3 AND row_id = 4) AND (again = 0 OR row_id % 3 = 1)),
firsts AS (SELECT iteration, row_id, min(arrival) AS f FROM messages GROUP BY ALL),
done AS (SELECT iteration, max(f) AS done_at FROM firsts GROUP BY iteration HAVING count(*) = 10)"""

MEANS = """member AS (SELECT *, CASE WHEN itype IN (2, 4) THEN 'white' ELSE 'dark' END AS set FROM samples WHERE itype <> 1),
sets AS (SELECT c.row_id, c.set, c.seq, c.pix, (SELECT avg(m.x) FROM member m WHERE m.row_id = c.row_id AND m.pix = c.pix
 AND m.set = c.set AND m.seq <= c.seq AND m.seq >= (SELECT coalesce(max(r.seq), -1) FROM coded r
  WHERE r.row_id = c.row_id AND r.itype = CASE c.set WHEN 'white' THEN 4 ELSE 5 END AND r.seq <= c.seq)) AS mean FROM member c)"""
NORMALIZED = f"""{CALIB}, {MEANS},
used AS (SELECT p.row_id, p.seq, max(c.seq) FILTER (WHERE c.itype IN (2, 4)) AS ws, max(c.seq) FILTER (WHERE c.itype IN (3, 5)) AS ds
 FROM coded p LEFT JOIN coded c ON c.row_id = p.row_id AND c.itype <> 1 AND c.seq <= p.seq WHERE p.itype = 1 GROUP BY ALL),
normal AS (SELECT s.row_id, s.seq, s.pix, CASE WHEN w.mean IS NULL OR k.mean IS NULL THEN x
 ELSE (x - k.mean) / greatest(w.mean - k.mean, 1e-6::DOUBLE) END AS x
 FROM samples s JOIN used u ON u.row_id = s.row_id AND u.seq = s.seq
 LEFT JOIN sets w ON w.set = 'white' AND w.row_id = s.row_id AND w.seq = u.ws AND w.pix = s.pix
 LEFT JOIN sets k ON k.set = 'dark' AND k.row_id = s.row_id AND k.seq = u.ds AND k.pix = s.pix WHERE s.itype = 1)"""

WINDOWS = f"""{ARRIVALS}, passes AS (SELECT row_id, unnest(range(1, max(n) // 4 + 1)) AS pass FROM arrivals GROUP BY row_id),
member AS (SELECT a.*, p.pass FROM passes p JOIN arrivals a ON a.row_id = p.row_id AND a.rn <= p.pass * 4
 AND a.rn > p.pass * 4 - CASE WHEN (p.pass - 1) * 4 < 6 THEN p.pass * 4 ELSE 6 END)"""

BAD = f"""{FRAMES}, bad AS (SELECT CASE WHEN (projection_id * 10 + row_id) % 17 = 0 THEN NULL ELSE row_id END AS row_id,
 projection_id, seq, (projection_id * 10 + row_id) % 17 AS m, CASE (projection_id * 10 + row_id) % 17 WHEN 1 THEN ray[1:63]
 WHEN 2 THEN ray[1:0] ELSE ray END AS ray, {fnv_floats('ray')} + CASE WHEN (projection_id * 10 + row_id) % 17 = 3 THEN 1 ELSE 0 END AS checksum FROM frames)"""


def list_total(ray: str) -> str:
    return f"list_reduce({ray}, lambda a, x: a + x::DOUBLE, 0::DOUBLE)"


def summary(source: str) -> str:
    return f"""SELECT sink_id, count(*) AS records, count(DISTINCT key) AS keys, CAST(sum(val) AS BIGINT) AS total,
 bit_xor(checksum) AS checksum FROM {source} JOIN sums USING (key) GROUP BY sink_id"""


def ticks_sql(iterations: int, per: str) -> str:
    return (f"SELECT i AS seq, CAST((i - 1) // {per} AS INTEGER) AS iter, 'DATA' AS kind "
            f"FROM range(1, {iterations} * {per} + 1) t(i)")


def event_ticks() -> str:
    return f"SELECT event_id + 1 AS seq, CAST(event_id // {NFRAMES} AS INTEGER) AS iter, 'DATA' AS kind FROM events"


def union_sql() -> str:
    return f"""SELECT * FROM ({event_ticks()}) UNION ALL SELECT 0::BIGINT, 0::INTEGER, 'WARMUP'
 UNION ALL SELECT max(event_id) + 2, CAST(max(event_id) // {NFRAMES} + 1 AS INTEGER), 'FIN' FROM events"""


def all_oracles() -> dict[str, str]:
    r = clean_round
    long_frames = ("SELECT row_id, seq, CAST(generate_subscripts(ray, 1) - 1 AS INTEGER) AS pix, unnest(ray) AS x FROM frames")
    q = {}
    q["gen_kv"] = f"""WITH {murmur_over('events', '(event_id * 2 + 7)', 'event_id', 'a')},
 {murmur_over('events', '(event_id * 2 + 8)', 'event_id', 'b')}
 SELECT event_id AS seq, 'key' || (a.h % 60) AS key, CAST(b.h % 10 AS INTEGER) AS val FROM a JOIN b USING (event_id)"""
    q["ticks"] = event_ticks()
    q["tick_iter"] = "SELECT event_id + 1 AS seq, CAST(event_id // 144 AS INTEGER) AS iter, 'DATA' AS kind FROM events"
    q["tick_union"] = union_sql()
    q["control_rows"] = f"""SELECT seq, iter, kind, CAST(i AS INTEGER) AS row_id FROM ({union_sql()}),
 (SELECT DISTINCT vec_id % 10 AS i FROM embeddings) WHERE kind <> 'DATA'"""
    q["split_control"] = f"""WITH {ARRIVALS} SELECT row_id, count(*) AS n, CASE WHEN kind = 'FIN' THEN 'control' ELSE 'data' END AS part
 FROM arrivals GROUP BY ALL"""
    q["scan_frames"] = f"""WITH {FRAMES} SELECT row_id, seq, {r('theta')} AS theta, {r('theta * 180 / pi()')} AS theta_deg,
 {r(list_total('ray'))} AS total FROM frames"""
    q["save_frames"] = f"""WITH {FRAMES} SELECT row_id, seq, {r('theta * 180 / pi()')} AS theta_deg,
 {r(list_total('ray'))} AS total FROM frames"""
    q["read_slices"] = f"WITH {FRAMES} SELECT row_id, seq, CAST(len(ray) AS INTEGER) AS nx FROM frames WHERE row_id IN (3, 4, 5, 6)"
    q["read_projections"] = f"WITH {FRAMES} SELECT row_id, projection_id, ray[1] AS x0 FROM frames WHERE projection_id BETWEEN 5 AND 24"
    q["dataset_stats"] = f"""WITH {FRAMES} SELECT count(DISTINCT projection_id) AS projections, min(projection_id) AS first_projection,
 max(projection_id) AS last_projection, min(row_id) AS first_row, max(row_id) AS last_row,
 CAST(min(len(ray)) AS INTEGER) AS min_columns, CAST(max(len(ray)) AS INTEGER) AS max_columns, count(*) AS messages,
 CAST(sum(len(ray)) * 4 AS BIGINT) AS bytes FROM frames"""
    q["tile_rows"] = f"""WITH {FRAMES} SELECT j AS row_id, seq, ray[2] AS x1 FROM range(0, 24) t(j)
 JOIN frames ON frames.row_id = j % 10"""
    q["sequence_frames"] = f"""WITH {IMAGES}, kinds AS (SELECT *, least(unique_id % 5, 2) AS kind,
 row_number() OVER (PARTITION BY least(unique_id % 5, 2) ORDER BY unique_id) - 1 AS idx FROM images),
 numbered AS (SELECT kind, theta, data, idx, row_number() OVER (ORDER BY kind, idx) - 1 AS seq FROM kinds)
 SELECT seq, seq AS unique_id, itype, {r('CASE WHEN itype = 1 THEN theta ELSE 0 END')} AS theta, x0,
 CASE itype WHEN 1 THEN 'Projection' WHEN 2 THEN 'White' WHEN 3 THEN 'Dark' WHEN 4 THEN 'WhiteReset' ELSE 'DarkReset' END AS label
 FROM (SELECT seq, theta, data[1] AS x0, CAST(CASE kind WHEN 2 THEN 1 WHEN 0 THEN CASE WHEN idx = 0 THEN 4 ELSE 2 END
 ELSE CASE WHEN idx = 0 THEN 5 ELSE 3 END END AS INTEGER) AS itype FROM numbered)"""
    q["replay"] = f"""WITH {IMAGES} SELECT i * (SELECT count(*) FROM images) + seq AS seq, CAST(i AS INTEGER) AS iter, unique_id,
 data[3] AS x2 FROM images, range(0, 3) t(i)"""
    n = "(SELECT count(*) FROM embeddings)"
    q["tick_frames"] = f"""WITH {IMAGES}, tick AS ({ticks_sql(2, n)}) SELECT t.seq, iter, unique_id, data[4] AS x3
 FROM tick t JOIN images f ON f.seq = (t.seq - 1) % {n}"""
    q["ordered_subset"] = f"""WITH {FRAMES}, k AS (SELECT CAST(ceil({NFRAMES} / 16.0) AS BIGINT) AS ns)
 SELECT row_id, projection_id AS idx, projection_id % ns AS subset,
 row_number() OVER (PARTITION BY row_id ORDER BY projection_id % ns, projection_id) - 1 AS position FROM frames, k"""
    q["sink_kv_csv"] = f"WITH {KV}, {CHECKSUMS} SELECT key, val, checksum, count(*) AS n FROM kv JOIN sums USING (key) GROUP BY ALL"
    q["sink_iterations"] = f"""WITH {FRAMES} SELECT lpad(projection_id::VARCHAR, 6, '0') AS iteration, count(DISTINCT row_id) AS row_ids,
 CAST(sum(len(ray)) AS BIGINT) AS samples, {r(f"sum({list_total('ray')})")} AS total FROM frames GROUP BY projection_id"""
    q["placement_forward"] = "SELECT 0::BIGINT AS moved, count(*) AS records FROM events"
    q["placement_shuffle"] = "SELECT 4 AS targets, count(*) AS records, 0::BIGINT AS above_share FROM events"
    q["balanced_placement"] = "SELECT o_orderkey AS row_id, CAST(o_orderkey % 4 AS INTEGER) AS part FROM orders"
    q["stream_progress"] = f"""WITH {KV}, span AS (SELECT min(seq) AS low, max(seq) + 1 - min(seq) AS width FROM kv)
 SELECT CAST(b AS BIGINT) AS batch, count(*) AS messages, CAST(sum(strlen(key)) AS BIGINT) AS bytes, max(seq) AS last_seq
 FROM kv, span, range(0, 3) t(b) WHERE seq >= low + width * b // 3 AND seq < low + width * (b + 1) // 3 GROUP BY b"""
    for job in ("forward", "shuffle", "reroute", "interleave"):
        q[f"stream_kv_{job}"] = q["sink_kv_csv"]
    q["stream_kv_broadcast"] = q["sink_kv_csv"].replace("count(*) AS n", "4 * count(*) AS n")
    q["upper_map"] = "SELECT event_id, upper(event_type) AS event_type FROM events"
    q["split_rows_even"] = f"""WITH {IMAGES}, parts AS (SELECT * FROM (VALUES (0, 0, 3), (1, 3, 3), (2, 6, 2)) p(part, row_offset, nrows))
 SELECT seq, part, row_offset, nrows AS rows, nrows * 8 AS samples,
 {r(list_total('data[row_offset * 8 + 1 : (row_offset + nrows) * 8]'))} AS total FROM images, parts"""
    q["explode_rows"] = f"""WITH {IMAGES}, cut AS (SELECT CAST(i AS INTEGER) AS row_id, seq, unique_id, theta,
 data[i * 8 + 1 : i * 8 + 8] AS ray FROM images, range(0, 8) t(i))
 SELECT row_id, seq, unique_id AS projection_id, {r('theta')} AS theta, 4::DOUBLE AS center, 8 AS nx, ray[1] AS x0,
 {fnv_floats('ray')} AS checksum FROM cut"""
    q["validate_rows"] = f"""WITH {BAD} SELECT projection_id, CASE m WHEN 0 THEN 'missing field' WHEN 1 THEN 'wrong length'
 WHEN 2 THEN 'empty payload' ELSE 'ok' END AS reason, count(*) AS n FROM bad GROUP BY ALL"""
    q["verify_checksum"] = f"""WITH {BAD} SELECT row_id, seq, checksum, {fnv_floats('ray')} AS actual,
 checksum = {fnv_floats('ray')} AS checksum_ok FROM bad"""
    q["validate_strict"] = f"WITH {FRAMES} SELECT row_id, seq, {fnv_floats('ray')} AS checksum FROM frames"
    q["job_rejects"] = f"""WITH {BAD} SELECT CASE m WHEN 0 THEN 'missing field' WHEN 1 THEN 'wrong length' WHEN 2 THEN 'empty payload'
 WHEN 3 THEN 'wrong checksum' ELSE 'ok' END AS reason, count(*) AS n, CAST(sum(len(ray)) AS BIGINT) AS samples FROM bad GROUP BY ALL"""
    byte, word = "(floor(abs(x::DOUBLE) * 1000)::BIGINT % 256)::DOUBLE", "(floor(abs(x::DOUBLE) * 100000)::BIGINT % 65536)::DOUBLE"
    q["reinterpret"] = f"""WITH {FRAMES} SELECT row_id, seq, pix, {byte} AS u8, {word} AS u16, {byte} AS s8, x::DOUBLE AS f32
 FROM ({long_frames})"""
    q["calibration_sets"] = f"WITH {CALIB}, {MEANS} SELECT row_id, set, seq, pix, {r('mean')} AS mean FROM sets"
    q["normalize"] = f"WITH {NORMALIZED} SELECT row_id, seq, pix, {r('x')} AS x FROM normal"
    log = "CASE WHEN x > 0 THEN -ln(x) ELSE 0 END"
    q["calibrate_frames"] = f"""WITH {NORMALIZED} SELECT row_id, seq, pix, {r(f'greatest({log}, 0)')} AS x FROM normal"""
    q["minus_log"] = f"""WITH {DIRTY} SELECT row_id, projection_id, pix, CASE WHEN isnan(x) OR x < 0 THEN 'nan' WHEN x = 0 THEN 'inf'
 WHEN isinf(x) THEN '-inf' ELSE 'number' END AS state,
 CASE WHEN NOT isnan(x) AND x > 0 AND NOT isinf(x) THEN {r('-ln(CASE WHEN x > 0 THEN x::DOUBLE ELSE 1 END)')} END AS x FROM dirty"""
    q["remove_invalids"] = f"""WITH {DIRTY} SELECT row_id, projection_id, pix,
 CASE WHEN isnan(x) OR x < 0 OR isinf(x) THEN 0::DOUBLE ELSE {r('x::DOUBLE')} END AS x FROM dirty"""
    fin = lambda e: f"sum(CASE WHEN isnan({e}) OR isinf({e}) THEN 0 ELSE {e} END)"
    q["sanitize_report"] = f"""WITH {DIRTY}, d AS (SELECT row_id, x::DOUBLE AS x FROM dirty) SELECT row_id, count(*) AS samples,
 count(*) FILTER (WHERE NOT isnan(x) AND x < 0) AS negatives, count(*) FILTER (WHERE isnan(x)) AS nans,
 count(*) FILTER (WHERE isnan(x) OR isinf(x) OR abs(x) < 1.17549435e-38::DOUBLE) AS abnormal,
 {r(fin('abs(x)'))} AS sum_absolute, {r(fin('CASE WHEN x < 0 THEN 0 ELSE x END'))} AS sum_nonnegative,
 {r(fin('x'))} AS sum_without_nan,
 {r('sum(CASE WHEN isnan(x) OR isinf(x) OR abs(x) < 1.17549435e-38::DOUBLE THEN 0 ELSE x END)')} AS sum_normal FROM d GROUP BY row_id"""
    q["fnv1a"] = f"WITH {FRAMES} SELECT row_id, seq, {fnv_floats('ray')} AS hash FROM frames"
    q["fnv1a_text"] = f"""WITH {KV} SELECT key, count(*) AS n, list_reduce({codes('key')}, lambda h, b: (xor(h, b) * 16777619) & {MASK},
 2166136261::BIGINT) AS hash FROM kv GROUP BY key"""
    q["murmur_u32"] = f"WITH {murmur_over('events', 'event_id', 'event_id', 'a')} SELECT event_id, h AS hash FROM a"
    # the hash is a bijection on 32 bits: the source is whatever hashes to event_id
    q["murmur_inv_u32"] = inverse_sql()
    q["record_checksum"] = f"WITH {KV}, {CHECKSUMS} SELECT seq, checksum FROM kv JOIN sums USING (key)"
    q["record_checksum_wide"] = f"WITH {KV_WIDE}, {CHECKSUMS_WIDE} SELECT key, checksum, count(*) AS n FROM kv_wide JOIN sums USING (key) GROUP BY ALL"
    q["java_hash"] = f"WITH {KV_WIDE} SELECT key, count(*) AS n, CAST({java_hash_sql('key')} AS INTEGER) AS hash FROM kv_wide GROUP BY key"
    q["route_forward"] = q["route_shuffle"] = f"WITH {KV} SELECT seq, key, val FROM kv"
    q["route_broadcast"] = f"WITH {KV} SELECT seq, key, val, CAST(i AS INTEGER) AS sink_id FROM kv, range(0, 4) t(i)"
    q["route_shift_zero"] = f"WITH {SHIFTED} SELECT seq, key, val, CAST(sink_id AS INTEGER) AS sink_id FROM shifted"
    q["route_interleave"] = f"WITH {INTERLEAVED} SELECT seq, key, val, CAST(sink_id AS INTEGER) AS sink_id FROM interleaved"
    q["route_modulo"] = f"WITH {FRAMES} SELECT row_id, seq, ray[1] AS x0, CAST(row_id % 4 AS INTEGER) AS sink_id FROM frames"
    q["key_or_random"] = f"""WITH {BAD}, {murmur_over('bad', 'seq', 'row_id, seq', 'a')}
 SELECT seq, coalesce(row_id, h % 10) AS row_id, count(*) AS n FROM a GROUP BY ALL"""
    q["routing_skew"] = f"""WITH {INTERLEAVED}, {murmur_over('events', 'event_id', 'event_id', 'a')}, load AS (
 SELECT 'hash' AS strategy, p AS sink_id, count(*) AS records FROM hashed GROUP BY ALL UNION ALL
 SELECT 'shift_zero', CASE WHEN p = 0 THEN 1 ELSE p END AS s, count(*) FROM hashed GROUP BY s UNION ALL
 SELECT 'interleave', sink_id, count(*) FROM interleaved GROUP BY sink_id UNION ALL
 SELECT 'spread', h % 4 AS s, count(*) FROM a GROUP BY s UNION ALL
 SELECT 'balanced', event_id % 4 AS s, count(*) FROM events GROUP BY s)
 SELECT strategy, CAST(sink_id AS INTEGER) AS sink_id, records,
 {r('records / (sum(records) OVER (PARTITION BY strategy))::DOUBLE')} AS share FROM load"""
    q["kv_reroute_summary"] = f"WITH {SHIFTED}, {CHECKSUMS} " + summary("(SELECT * REPLACE (CAST(sink_id AS INTEGER) AS sink_id) FROM shifted)")
    q["kv_interleave_summary"] = f"WITH {INTERLEAVED}, {CHECKSUMS} " + summary("(SELECT * REPLACE (CAST(sink_id AS INTEGER) AS sink_id) FROM interleaved)")
    q["kv_broadcast_summary"] = f"WITH {KV_WIDE}, {CHECKSUMS_WIDE} " + summary("(SELECT kv_wide.*, CAST(i AS INTEGER) AS sink_id FROM kv_wide, range(0, 4) t(i))")
    q["ray_geometry"] = f"""WITH {MESSAGES}, line AS (SELECT row_id, seq, col, sin(theta) AS s, cos(theta) AS c,
 col - 31.5::DOUBLE + 1e-6::DOUBLE AS off FROM sample JOIN angles USING (seq))
 SELECT row_id, seq, col, 64 AS nx, abs(s) > abs(c) AS steep, {r('CASE WHEN abs(s) > abs(c) THEN c / s ELSE s / c END')} AS slope,
 {r('CASE WHEN abs(s) > abs(c) THEN 32 - 32 * c / s - off / s ELSE 32 - 32 * s / c + off / c END')} AS icept FROM line"""
    q["ray_weights"] = f"""WITH {MESSAGES}, {weights('angles', 'seq, theta')}
 SELECT seq, pix, count(*) AS rays, {r('sum(len)')} AS chord FROM weight WHERE len > 0 GROUP BY seq, pix"""
    q["forward_project"] = f"""WITH {MESSAGES}, {weights('angles', 'seq, theta')}, {NORM}, {START}
 SELECT f.row_id, w.seq, w.col, {r('sum(len * coalesce(val, 0))')} AS sim, {r('sum(len * len)')} AS norm FROM weight w
 CROSS JOIN (SELECT DISTINCT row_id FROM frames) f LEFT JOIN start s ON s.row_id = f.row_id AND s.pix = w.pix GROUP BY f.row_id, w.seq, w.col"""
    q["back_project"] = f"""WITH {MESSAGES}, {weights('angles', 'seq, theta')}, {NORM}
 SELECT row_id, pix, {r('sum(len * v / a2)')} AS num, {r('sum(len)')} AS den FROM weight JOIN norm USING (seq, col)
 JOIN sample USING (seq, col) GROUP BY row_id, pix"""
    q["sirt_update"] = f"""WITH {MESSAGES}, {weights('angles', 'seq, theta')}, {NORM}, {START},
 full_start AS (SELECT f.row_id, CAST(i AS INTEGER) AS pix, coalesce(s.val, 0) AS val FROM (SELECT DISTINCT row_id FROM frames) f
  CROSS JOIN range(0, 4096) t(i) LEFT JOIN start s ON s.row_id = f.row_id AND s.pix = i),
 sim AS (SELECT p.row_id, w.seq, w.col, sum(len * val) AS sim FROM weight w JOIN full_start p USING (pix) GROUP BY ALL),
 upd AS (SELECT row_id, seq, col, (v - sim) / a2 AS u FROM sim JOIN sample USING (row_id, seq, col) JOIN norm USING (seq, col)),
 chg AS (SELECT row_id, pix, sum(len * u) / sum(len) AS d FROM upd JOIN weight USING (seq, col) GROUP BY ALL)
 SELECT p.row_id, p.pix, {r('p.val + coalesce(d, 0)')} AS val FROM full_start p LEFT JOIN chg c ON c.row_id = p.row_id AND c.pix = p.pix"""
    recon = reconstruction("32::DOUBLE", 32, 16, 1)
    label = "lpad((k - 1)::VARCHAR, 6, '0')"
    q["sirt_emit"] = f"{recon} SELECT row_id, {label} AS iteration, pix, {r('val')} AS val FROM image WHERE k > 0 AND (k - 1) % 2 = 0"
    q["recon_state"] = f"""{recon} SELECT row_id, k - 1 AS pass0, count(*) AS pixels, {r('sum(val)')} AS total FROM image
 WHERE k > 0 AND k = {NFRAMES} // 16 GROUP BY ALL"""
    q["sirt_iterated"] = f"""{reconstruction('31::DOUBLE', 40, 40, 2)}
 SELECT row_id, {label} AS iteration, pix, {r('val')} AS val FROM image WHERE k > 0"""
    q["tomography_job"] = tomography_sql()
    q["restore_rows"] = f"SELECT * FROM ({q['recon_state']}) state WHERE row_id % 2 = 0"
    q["stream_tomography"] = f"SELECT iteration, pixels, total FROM ({q['tomography_job']}) job WHERE status = 'DENOISED'"
    q["stream_reconstruct"] = q["sirt_emit"]
    q["assemble_iterations"] = f"""WITH {GATHER} SELECT iteration, row_id, pix, arrival, {r('val')} AS val FROM messages JOIN done USING (iteration)
 WHERE arrival <= done_at QUALIFY arrival = max(arrival) OVER (PARTITION BY iteration, row_id)"""
    q["iteration_notices"] = f"""WITH {GATHER} SELECT row_id, 'DENOISED' AS status, iteration FROM firsts JOIN done USING (iteration) WHERE f = done_at"""
    q["count_windows"] = f"WITH {WINDOWS} SELECT row_id, pass, rn, event_id FROM member"
    by_id = WINDOWS.replace("ORDER BY ts, event_id", "ORDER BY event_id")
    q["stream_count_windows"] = f"WITH {by_id} SELECT row_id, pass, rn, event_id AS seq FROM member"
    q["stateful_count_windows"] = q["stream_count_windows"]
    q["window_view"] = f"""WITH {WINDOWS} SELECT row_id, pass, count(*) AS messages, min(rn) AS first_rn, max(rn) AS last_rn,
 CAST(trunc(arg_max(center, rn)) AS BIGINT) AS center, {r('min(theta)')} AS min_theta, {r('max(theta)')} AS max_theta FROM member GROUP BY row_id, pass"""
    q["snapshot_points"] = f"WITH {ARRIVALS} SELECT row_id, event_id, rn AS processed FROM arrivals WHERE rn % 4 = 0"
    before = "OVER (PARTITION BY row_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    q["monotone_dedup"] = f"WITH {ARRIVALS} SELECT row_id, event_id, seq FROM arrivals QUALIFY seq > coalesce(max(seq) {before}, -1)"
    q["after_fin_filter"] = f"""WITH {ARRIVALS} SELECT row_id, event_id, kind FROM arrivals
 QUALIFY coalesce(sum((kind = 'FIN')::INTEGER) {before}, 0) = 0"""
    q["processed_counts"] = f"WITH {ARRIVALS} SELECT row_id, count(*) AS processed FROM arrivals GROUP BY row_id"
    q["progress_snapshot"] = f"""WITH {ARRIVALS} SELECT row_id, max(seq) AS last_seq, count(*) AS nmsgs, 1 AS version, 'events' AS input
 FROM arrivals GROUP BY row_id"""
    q["progress_json"] = f"""WITH {ARRIVALS} SELECT row_id, to_json({{'row_id': row_id, 'last_seq': max(seq), 'nmsgs': count(*), 'version': 1,
 'input': 'events'}})::VARCHAR AS json FROM arrivals GROUP BY row_id"""
    secs = "((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE)"
    mib = "(sum(strlen(props)) / 1048576::DOUBLE)"
    q["throughput_stats"] = f"""SELECT event_type, count(*) AS messages, {r(mib)} AS mib, {r(secs)} AS seconds,
 {r(f'{mib} / {secs}')} AS mib_per_s, {r(f'count(*) / {secs}')} AS messages_per_s FROM events GROUP BY event_type"""
    return q


def tomography_sql() -> str:
    """Four windows over images of 8 x 8 samples, rows 8 to 11 repeating 0 to 3."""
    n = "(SELECT count(*) FROM embeddings)"
    frames = """frames AS (SELECT j AS row_id, vec_id + 1 AS seq, vec_id * 0.01::DOUBLE AS theta,
 list_transform(embedding[(j % 8) * 8 + 1 : (j % 8) * 8 + 8], lambda x: greatest(x, 0::FLOAT)) AS ray FROM embeddings, range(0, 12) t(j))"""
    body = f"""WITH RECURSIVE {frames}, angles AS (SELECT DISTINCT seq, theta, 4::DOUBLE AS mid FROM frames),
sample AS (SELECT row_id, seq, CAST(generate_subscripts(ray, 1) - 1 AS INTEGER) AS col, unnest(ray)::DOUBLE AS v FROM frames),
{weights('angles', 'seq, theta', 8)}, {NORM}, step AS (SELECT {n} // 4 AS s),
image AS (SELECT row_id, CAST(i AS INTEGER) AS pix, 0::DOUBLE AS val, CAST(0 AS BIGINT) AS k
 FROM (SELECT DISTINCT row_id FROM frames), range(0, 64) t(i)
 UNION ALL (WITH n AS (SELECT row_id, pix, val, k + 1 AS k FROM image WHERE k < 4),
 inwin AS (SELECT DISTINCT n.row_id, f.seq FROM (SELECT DISTINCT row_id, k FROM n) n, step JOIN (SELECT DISTINCT row_id, seq FROM frames) f
  ON f.row_id = n.row_id AND f.seq <= n.k * s AND f.seq > (n.k - 1) * s),
 sim AS (SELECT m.row_id, w.seq, w.col, sum(w.len * p.val) AS sim FROM inwin m JOIN weight w ON w.seq = m.seq
  JOIN n p ON p.row_id = m.row_id AND p.pix = w.pix GROUP BY ALL),
 upd AS (SELECT x.row_id, x.seq, x.col, (v - sim) / a2 AS u FROM sim x JOIN sample USING (row_id, seq, col) JOIN norm USING (seq, col)),
 chg AS (SELECT u.row_id, w.pix, sum(w.len * u.u) / sum(w.len) AS d FROM upd u JOIN weight w ON w.seq = u.seq AND w.col = u.col GROUP BY ALL)
 SELECT p.row_id, p.pix, p.val + coalesce(c.d, 0) AS val, p.k FROM n p LEFT JOIN chg c ON c.row_id = p.row_id AND c.pix = p.pix))
"""
    return f"""{body} SELECT 'DENOISED' AS status, lpad((k - 1)::VARCHAR, 6, '0') AS iteration, 1::BIGINT AS notices,
 count(*) AS pixels, {clean_round('sum(val)')} AS total FROM image WHERE k > 0 AND (k - 1) % 3 = 0 GROUP BY k
 UNION ALL SELECT 'WARMUP', NULL, 12, NULL, NULL UNION ALL SELECT 'FIN', NULL, 12, NULL, NULL"""


def inverse_sql() -> str:
    """Undo the hash steps in reverse order, with modular inverses."""
    inv = lambda c: _mul(pow(c, -1, 2**32))
    steps = ["xor(h, h >> 16)", inv(0xC2B2AE35), "xor(xor(h, h >> 13), h >> 26)", inv(0x85EBCA6B), "xor(h, h >> 16)",
             "xor(h, 4)", "(h + 4294967296 - 3864292196) % 4294967296", inv(5), _rot(19), inv(0x1B873593), _rot(17), inv(0xCC9E2D51)]
    chain = _chain(f"SELECT event_id, event_id & {MASK} AS h FROM events", steps)
    return f"WITH {chain} SELECT event_id, h AS source, event_id AS again FROM t{len(steps)}"
