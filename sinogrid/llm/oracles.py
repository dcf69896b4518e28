"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

from sinogrid.llm import warc


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _uuid(parts: str) -> str:
    cut = " || '-' || ".join(f"substr(h, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"list_transform([md5({parts})], lambda h: '<urn:uuid:' || {cut} || '>')[1]"


def _warc() -> str:
    plain = f"regexp_replace(html, {_text(warc._HIDDEN)}, '', 'g')"
    plain = f"regexp_replace(regexp_replace({plain}, {_text(warc._BREAKS)}, chr(10), 'g'), {_text(warc._TAG)}, '', 'g')"
    for name, char in warc.ENTITIES:
        plain = f"replace({plain}, {_text(name)}, {_text(char)})"
    plain = rf"regexp_replace({plain}, '[ \t\r\f\x0b]+', ' ', 'g')"
    plain = rf"trim(regexp_replace({plain}, ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"
    meta = f"""to_json({{'Envelope': {{'WARC-Header-Metadata': {{'WARC-Type': 'response', 'WARC-Record-ID': source_id, 'WARC-Target-URI': url,
     'WARC-Date': date, 'WARC-Payload-Digest': source_digest}}, 'Payload-Metadata': {{'HTTP-Response-Metadata': {{'Headers': http,
     'Entity-Length': strlen(html), 'HTML-Metadata': {{'Title': regexp_extract(html, {_text(warc._TITLE)}, 1),
     'Links': regexp_extract_all(html, {_text(warc._LINK)}, 1)}}}}}}}}}})::VARCHAR"""
    return f"""
WITH page AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, '1970-01-01T00:00:00Z' AS date FROM pages),
response AS (SELECT *, {_uuid("'response' || chr(10) || coalesce(page_id::VARCHAR, '') || chr(10) || url")} AS source_id,
 'sha256:' || sha256(html) AS source_digest,
 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) AS http
 FROM page),
derived AS (SELECT *, 'metadata' AS kind, 'application/json' AS content_type, {meta} AS content FROM response
 UNION ALL SELECT *, 'conversion', 'text/plain', {plain} FROM response)
SELECT page_id, kind AS record_type, {_uuid("kind || chr(10) || source_id")} AS record_id, source_id AS refers_to, url AS target_uri,
 date AS warc_date, content_type, http AS source_headers, source_digest, 'sha256:' || sha256(content) AS block_digest,
 strlen(content)::BIGINT AS content_length, content FROM derived"""


def _cell(text: str, bits: int = 16) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT >> {32 - bits})"


def _ring(shards: int = 24, vnodes: int = 128) -> str:
    """Every key finds its place by its own rank; the Spark query joins pieces of cells instead."""
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

    def share(amount: str, weight: str) -> str:
        by = "PARTITION BY shard ORDER BY cell"
        return (f"CASE WHEN sum({weight}) OVER (PARTITION BY shard) = 0 THEN 0 ELSE {amount} * sum({weight}) OVER ({by}) // sum({weight}) OVER (PARTITION BY shard)"
                f" - {amount} * coalesce(sum({weight}) OVER ({by} {before}), 0) // sum({weight}) OVER (PARTITION BY shard) END")

    step = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    return f"""
WITH crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: {step}) ORDER BY i) AS t FROM range(0, 256) r(i)),
hexed AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, [('0x' || x)::BIGINT FOR x IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')] AS b FROM documents),
doc AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, b), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) AS text_crc32 FROM hexed, crc),
keyed AS (SELECT *, {_cell("coalesce(doc_id::VARCHAR, '')")} AS cell FROM doc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY doc_id, text_crc32, size) - 1 AS rank FROM keyed),
point AS (SELECT cell, shard, row_number() OVER (ORDER BY cell, shard, replica) AS v FROM (SELECT s AS shard, r AS replica,
 {_cell("'shard-' || s || '-' || r")} AS cell FROM range(0, {shards}) a(s), range(0, {vnodes}) b(r))),
first_at AS (SELECT cell, arg_min(shard, v) AS shard FROM point GROUP BY cell),
ring AS (SELECT c AS cell, coalesce(shard, (SELECT arg_min(shard, cell) FROM first_at)) AS shard FROM range(0, 65536) r(c) ASOF LEFT JOIN first_at f ON c <= f.cell),
loaded AS (SELECT ring.cell, shard, count(rank)::HUGEINT AS n FROM ring LEFT JOIN ranked USING (cell) GROUP BY ALL),
homes AS (SELECT *, 1 AS one, sum(n) OVER (PARTITION BY shard) AS home,
 (SELECT count(*) FROM doc) // {shards} + CASE WHEN shard < (SELECT count(*) FROM doc) % {shards} THEN 1 ELSE 0 END AS cap FROM loaded),
flow AS (SELECT *, {share("greatest(home - cap, 0)", "n")} AS surplus, {share("greatest(cap - home, 0)", "one")} AS room FROM homes),
walk AS (SELECT *, sum(surplus - room) OVER (ORDER BY cell) AS s FROM flow),
turned AS (SELECT *, CASE WHEN cell > (SELECT arg_min(cell, (s, cell)) FROM walk) THEN 0 ELSE 1 END AS turn FROM flow),
again AS (SELECT *, sum(surplus - room) OVER (ORDER BY turn, cell) AS s FROM turned),
way AS (SELECT *, s - least(0, min(s) OVER (ORDER BY turn, cell)) AS under_way FROM again),
use AS (SELECT *, coalesce(lag(under_way) OVER (ORDER BY turn, cell), 0) + surplus - under_way AS used FROM way),
place AS (SELECT *, coalesce(sum(surplus) OVER (ORDER BY turn, cell {before}), 0) AS surplus_from, coalesce(sum(used) OVER (ORDER BY turn, cell {before}), 0) AS place_from,
 coalesce(sum(n - surplus + used) OVER (PARTITION BY shard ORDER BY cell {before}), 0) AS slot_from FROM use),
stay AS (SELECT r.*, p.shard, p.slot_from + rank AS slot FROM ranked r JOIN place p USING (cell) WHERE rank < n - surplus),
go AS (SELECT r.*, p.surplus_from + rank - (n - surplus) AS k FROM ranked r JOIN place p USING (cell) WHERE rank >= n - surplus),
went AS (SELECT g.*, t.shard, t.slot_from + (t.n - t.surplus) + k - t.place_from AS slot FROM go g ASOF JOIN (SELECT * FROM place WHERE used > 0) t ON g.k >= t.place_from)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard, slot::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM (SELECT doc_id, size, text_crc32, shard, slot FROM stay UNION ALL SELECT doc_id, size, text_crc32, shard, slot FROM went)"""


def _audit() -> str:
    """Masks of failed filters per document; the Spark query joins tables of failing ids instead."""
    return r"""
WITH doc AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
cut AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first_id FROM doc),
fails AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
 + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
 + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS mask FROM cut),
mark AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
few AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM fails LEFT JOIN mark USING (doc_id) GROUP BY part, mask),
letter AS (SELECT substr('ABCDE', i::INTEGER + 1, 1) AS l, 1 << i AS bit FROM range(0, 5) r(i)),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
 FROM letter a, letter b, letter c, letter d, letter e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, s::INTEGER AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::BIGINT AS before FROM orders, range(1, 6) r(s)),
act AS (SELECT bit, before, part, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
 sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
 sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
 sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
 sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
 FROM (SELECT DISTINCT bit, before FROM steps) s, few GROUP BY bit, before, part),
share AS (SELECT part, bit, sum(removed) AS shapley FROM steps JOIN act USING (bit, before) GROUP BY part, bit)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
 good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, shapley::BIGINT AS shapley
FROM steps JOIN act USING (bit, before) JOIN share USING (part, bit)"""


def all_oracles() -> dict[str, str]:
    return {"op13_filter_audit": _audit(), "op2_warc_derivatives": _warc(), "op8_ring_shards": _ring()}
