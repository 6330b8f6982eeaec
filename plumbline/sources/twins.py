"""SQL of the derived frames, written on its own for the oracle."""

LINES = "lines AS (SELECT doc_id, pos, text FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS text FROM documents))"

FAULTY_LINES = (
    LINES
    + """, faulty AS (SELECT doc_id, pos,
  CASE WHEN pos % 7 IN (1, 2, 3) THEN (pos % 7)::VARCHAR || '. ' || text
       WHEN pos % 7 = 5 THEN '- ' || text
       WHEN pos % 11 = 4 THEN text || ' et al. (2019)'
       WHEN pos % 13 = 6 THEN (pos + 100)::VARCHAR || ' MAYER SMITH'
       WHEN pos % 17 = 0 THEN 'Table ' || (pos + 1)::VARCHAR || '. ' || text
       WHEN pos % 19 = 7 THEN pos::VARCHAR
       ELSE text END AS text,
  CASE WHEN pos % 5 = 0 THEN 1 + (doc_id + pos) % 4 END::INT AS heading_level FROM lines)"""
)

COLOURS = """colours AS (SELECT k, k // 30 AS doc_id,
  CASE WHEN k % 10 = 0 THEN printf('#%02X%02X%02X', (200 + k % 56)::INT, (200 + k * 3 % 56)::INT, (k % 100)::INT)
       ELSE printf('#%02X%02X%02X', (k * 37 % 256)::INT, (k * 91 % 256)::INT, (k * 53 % 256)::INT) END AS fg,
  CASE WHEN k % 3 = 0 THEN '#FFFFFF' WHEN k % 3 = 1 THEN '#F5F5F0'
       ELSE printf('#%02X%02X%02X', (k * 7 % 256)::INT, (k * 11 % 256)::INT, (k * 13 % 256)::INT) END AS bg,
  (8 + k % 15)::DOUBLE AS size, k % 3 = 0 AS bold FROM (SELECT c_custkey AS k FROM customer))"""


def channel(colour: str, k: int) -> str:
    a, b = 2 + 2 * k, 3 + 2 * k
    digit = lambda n: f"(instr('0123456789ABCDEF', upper(substr({colour}, {n}, 1))) - 1)"
    return f"(16 * {digit(a)} + {digit(b)})"


def luminance(colour: str) -> str:
    linear = lambda k: f"(CASE WHEN {channel(colour, k)} / 255.0 <= 0.03928 THEN {channel(colour, k)} / 255.0 / 12.92 ELSE pow(({channel(colour, k)} / 255.0 + 0.055) / 1.055, 2.4) END)"
    return f"(0.2126 * {linear(0)} + 0.7152 * {linear(1)} + 0.0722 * {linear(2)})"


RATED = (
    COLOURS
    + f""", lum AS (SELECT *, {luminance('fg')} AS lf, {luminance('bg')} AS lb FROM colours),
rated AS (SELECT *, (greatest(lf, lb) + 0.05) / (least(lf, lb) + 0.05) AS ratio,
  CASE WHEN size >= CASE WHEN bold THEN 14 ELSE 18 END THEN 3.0 ELSE 4.5 END AS required,
  {channel('fg', 0)} >= 200 AND {channel('fg', 1)} >= 200 AND {channel('fg', 2)} < 100 AND {channel('bg', 0)} >= 240 AND {channel('bg', 1)} >= 240 AND {channel('bg', 2)} >= 240 AS yellow FROM lum)"""
)

RUNS = """runs AS (SELECT k // 250 AS doc_id, k % 250 AS pos, 1 + k * 7 % 90 AS n_chars, 5 + k % 9 + (k % 10) / 10.0::DOUBLE AS size, k % 3 = 0 AS bold,
  CASE k % 4 WHEN 0 THEN 'ABCDEF+TimesNewRomanPS-BoldMT' WHEN 1 THEN 'TimesNewRomanPSMT' WHEN 2 THEN 'GHIJKL+Century-Italic' ELSE 'Arial-BoldItalic' END AS font
  FROM (SELECT event_id AS k FROM events))"""

BASE_FONT = "regexp_replace(regexp_replace(regexp_replace({0}, '^[A-Z]{{6}}\\+', ''), 'MT$', ''), '-(BoldItalic|BoldItal|Bold|Italic|Ital)$', '')"

ANCHORS = """anchors AS (SELECT page_id, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)))) AS pos,
  unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text,
  unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS url FROM pages)"""

FAULTY_ANCHORS = (
    ANCHORS
    + """, faulty_anchors AS (SELECT page_id, pos,
  CASE pos % 6 WHEN 0 THEN '' WHEN 1 THEN 'click here' WHEN 2 THEN 'Read more.' WHEN 3 THEN url ELSE text END AS text,
  CASE (page_id + pos) % 8 WHEN 0 THEN replace(url, '://', ':/') WHEN 1 THEN replace(url, '://', ':////')
    WHEN 2 THEN regexp_replace(url, '://([^/]*)/', '://\\1 /') WHEN 3 THEN 'mailto: u@ ex.com' WHEN 4 THEN url || '/a b' ELSE url END AS url FROM anchors)"""
)

STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
N_WORDS = "(CASE WHEN trim({0}, chr(32)||chr(9)||chr(10)||chr(13)) = '' THEN 0 ELSE len(regexp_split_to_array(trim({0}, chr(32)||chr(9)||chr(10)||chr(13)), '\\s+')) END)"

ALTS = (
    LINES
    + """, words AS (SELECT doc_id, pos, array_to_string(list_slice(string_split(text, ' '), 1, 1 + pos % 18), ' ') AS w FROM lines),
alts AS (SELECT doc_id, pos, CASE (doc_id + pos) % 9 WHEN 0 THEN '' WHEN 1 THEN 'Image of ' || w WHEN 2 THEN 'Figure ' || pos
  WHEN 3 THEN w || ' Description automatically generated' WHEN 4 THEN 'scan_' || pos || '.jpg' WHEN 5 THEN 'A picture containing ' || w ELSE w END AS alt,
  (doc_id + pos) % 11 = 3 AS decorative FROM words)"""
)

CELLS = """cells AS (SELECT t AS table_id, r, c, CASE WHEN (t + n) % (2 + t % 5) = 0 THEN '' WHEN t % 11 = 5 AND c = 0 THEN chr(8226) || ' item ' || n
    WHEN t % 13 = 2 AND c = 1 THEN repeat('long cell text ', 12) ELSE 'v' || (t * 31 % 97 + n) END AS text,
  CASE WHEN (t + n) % 7 = 0 THEN 2 ELSE 1 END AS span, CASE WHEN t % 2 = 0 THEN 1 ELSE 0 END AS header_rows
  FROM (SELECT o_orderkey AS t, n, (n // 3)::INT AS r, (n % 3)::INT AS c FROM orders, range(12) g(n)) WHERE r < 1 + t % 4 AND c < 1 + t * 7 % 3)"""

BOXES = """boxes AS (SELECT p // 100 AS doc_id, ((p // 20) % 5)::INT AS page, p % 20 AS pos, 40 + p * 13 % 400 AS x0, 30 + p * 29 % 700 AS y0,
  40 + p * 13 % 400 + 60 + p % 90 AS x1, 30 + p * 29 % 700 + 12 AS y1, CASE WHEN p // 20 % 7 = 3 THEN p % 3 WHEN p * 29 % 700 < 50 THEN 40 + p % 2 ELSE p % 37 END AS n_chars FROM (SELECT p_partkey AS p FROM part))"""

JOBS = """jobs AS (SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'processing' ELSE 'completed' END AS status,
  o_orderdate::DATE AS created_at, o_totalprice::DOUBLE AS cost, 1 + o_orderkey % 30 AS pages, o_orderkey // 50 AS batch_id FROM orders)"""

OUTLINED = (
    FAULTY_LINES.replace("faulty AS", "raw AS")
    + """, faulty AS (SELECT doc_id, pos, text, CASE WHEN doc_id % 3 <> 1 THEN heading_level WHEN pos = 0 THEN 1 WHEN pos % 5 = 0 THEN 2 + pos // 10 % 2 END::INT AS heading_level FROM raw)"""
)


def _with_lightness(light: str, turn: str) -> str:
    top = f"(CASE WHEN {light} <= 0.5 THEN {light} * (1 + s) ELSE {light} + s - {light} * s END)"
    low, h = f"(2 * {light} - {top})", f"((hue + {turn}) - floor(hue + {turn}))"
    return f"(CASE WHEN s = 0 THEN {light} WHEN {h} < 1.0::DOUBLE / 6 THEN {low} + ({top} - {low}) * {h} * 6 WHEN {h} < 0.5 THEN {top} WHEN {h} < 2.0::DOUBLE / 3 THEN {low} + ({top} - {low}) * (2.0::DOUBLE / 3 - {h}) * 6 ELSE {low} END)"


_TURNS = ("1.0::DOUBLE / 3", "0.0::DOUBLE", "-1.0::DOUBLE / 3")
_LINEAR = "(CASE WHEN {0} <= 0.03928 THEN {0} / 12.92 ELSE pow(({0} + 0.055) / 1.055, 2.4) END)"

#: Of a table pairs (fg, bg, size, bold): fixed, by thirty halvings of the lightness.
REPAIRED = f"""ch AS (SELECT *, {channel('fg', 0)} / 255.0::DOUBLE AS r, {channel('fg', 1)} / 255.0::DOUBLE AS g, {channel('fg', 2)} / 255.0::DOUBLE AS b, {luminance('fg')} AS lf, {luminance('bg')} AS ground, CASE WHEN size >= CASE WHEN bold THEN 14 ELSE 18 END THEN 3.0 ELSE 4.5 END::DOUBLE AS need FROM pairs),
  hl AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM ch),
  hls AS (SELECT *, (mx + mn) / 2 AS light, CASE WHEN mx = mn THEN 0 ELSE (mx - mn) / CASE WHEN (mx + mn) / 2 <= 0.5 THEN mx + mn ELSE 2 - mx - mn END END AS s,
    CASE WHEN mx = mn THEN 0 ELSE (CASE WHEN r = mx THEN (g - b) / (mx - mn) WHEN g = mx THEN 2 + (b - r) / (mx - mn) ELSE 4 + (r - g) / (mx - mn) END) / 6 END AS hue FROM hl),
  steps AS (WITH RECURSIVE st AS (SELECT fg, bg, size, bold, hue, s, ground, need, 0 AS k, 0.0::DOUBLE AS low, light AS top, NULL::DOUBLE AS best FROM hls
    UNION ALL SELECT fg, bg, size, bold, hue, s, ground, need, k + 1, CASE WHEN good THEN mid ELSE low END, CASE WHEN good THEN top ELSE mid END, CASE WHEN good THEN mid ELSE best END FROM (
      SELECT *, (greatest(own, ground) + 0.05) / (least(own, ground) + 0.05) >= need + 0.05 AS good FROM (SELECT *, 0.2126 * {_LINEAR.format('cr')} + 0.7152 * {_LINEAR.format('cg')} + 0.0722 * {_LINEAR.format('cb')} AS own FROM (
        SELECT *, {_with_lightness('mid', _TURNS[0])} AS cr, {_with_lightness('mid', _TURNS[1])} AS cg, {_with_lightness('mid', _TURNS[2])} AS cb FROM (SELECT *, (low + top) / 2 AS mid FROM st WHERE k < 30))))) SELECT * FROM st WHERE k = 30),
  repaired AS (SELECT fg, bg, size, bold, CASE WHEN (greatest(lf, ground) + 0.05) / (least(lf, ground) + 0.05) >= need OR best IS NULL THEN fg
    ELSE printf('#%02X%02X%02X', round_even({_with_lightness('best', _TURNS[0])} * 255, 0)::INT, round_even({_with_lightness('best', _TURNS[1])} * 255, 0)::INT, round_even({_with_lightness('best', _TURNS[2])} * 255, 0)::INT) END AS fixed
    FROM hls JOIN (SELECT fg, bg, size, bold, best FROM steps) USING (fg, bg, size, bold))"""
