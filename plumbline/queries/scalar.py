"""Queries of scalar rules: colours, alternative texts, links, lists, fonts, LaTeX."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import colour, latex, text
from plumbline.registry import query
from plumbline.sources import tables as s
from plumbline.sources import twins as q


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def starts(column: str, words) -> str:
    return "(" + " OR ".join(f"starts_with({column}, '{w}')" for w in words) + ")"


def holds(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


@query("b01_hex_to_rgb", f"WITH {q.COLOURS} SELECT k, round({q.channel('fg', 0)} / 255.0, 6) AS r, round({q.channel('fg', 1)} / 255.0, 6) AS g, round({q.channel('fg', 2)} / 255.0, 6) AS b FROM colours")
def b01(spark, sf):
    return s.colours(spark, sf).select("k", *(F.round(colour.channel(F.col("fg"), n) / 255, 6).alias(c) for n, c in enumerate("rgb")))


@query("b02_rgb_to_hex", f"WITH {q.COLOURS} SELECT k, printf('#%02X%02X%02X', round_even(k % 17 / 16.0 * 255, 0)::INT, round_even(k % 5 / 4.0 * 255, 0)::INT, round_even(k % 3 / 2.0 * 255, 0)::INT) AS hex FROM colours")
def b02(spark, sf):
    k = F.col("k")
    return s.colours(spark, sf).select("k", colour.hex_of(k % 17 / 16.0, k % 5 / 4.0, k % 3 / 2.0).alias("hex"))


@query("b03_large_text", f"WITH {q.COLOURS} SELECT k, CASE WHEN k % 20 = 7 THEN false ELSE size >= CASE WHEN bold THEN 14 ELSE 18 END END AS large FROM colours")
def b03(spark, sf):
    return s.colours(spark, sf).select("k", colour.is_large(F.when(F.col("k") % 20 != 7, F.col("size")), F.col("bold")).alias("large"))


@query("b04_contrast", f"WITH {q.RATED} SELECT k, round(ratio, 2) AS ratio, required::DOUBLE AS required, ratio >= required AS passes FROM rated")
def b04(spark, sf):
    r, need = colour.ratio(F.col("fg"), F.col("bg")), colour.required(F.col("size"), F.col("bold"))
    return s.colours(spark, sf).select("k", F.round(r, 2).alias("ratio"), need.alias("required"), (r >= need).alias("passes"))


@query("b07_severe_contrast", f"WITH {q.RATED} SELECT k, yellow AND ratio < 1.5 AS severe FROM rated")
def b07(spark, sf):
    return s.colours(spark, sf).select("k", colour.is_severe(F.col("fg"), F.col("bg"), colour.ratio(F.col("fg"), F.col("bg"))).alias("severe"))


@query("b50_colour_from_int", "SELECT c_custkey AS k, CASE WHEN v <> 0 THEN printf('#%02X%02X%02X', ((v >> 16) & 255)::INT, ((v >> 8) & 255)::INT, (v & 255)::INT) END AS hex, (c_custkey & 16) > 0 AS bold, (c_custkey & 2) > 0 AS italic FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE c_custkey * 7919 % 16777216 END AS v FROM customer)")
def b50(spark, sf):
    k = F.col("c_custkey")
    v = F.when(k % 9 == 0, 0).otherwise(k * 7919 % 16777216)
    return s.table(spark, sf, "customer").select(k.alias("k"), colour.from_int(v).alias("hex"), (k.bitwiseAND(F.lit(16)) > 0).alias("bold"), (k.bitwiseAND(F.lit(2)) > 0).alias("italic"))


def alt_sql(phrases) -> str:
    return f"""graded AS (SELECT doc_id, pos, alt, decorative, CASE
  WHEN t = '' OR length(t) < 20 OR n < 4 OR (n <= 5 AND {starts('low', text.LABEL_STARTS)}) OR {holds('low', phrases)} OR contains(low, 'graphical user interface') THEN 'bad'
  WHEN n >= 15 THEN 'good' WHEN n < 12 AND {starts('low', text.META_STARTS)} THEN 'borderline' WHEN n >= 8 THEN 'good' WHEN n >= 5 THEN 'borderline' ELSE 'bad' END AS quality
  FROM (SELECT *, lower(t) AS low, {q.N_WORDS.format('t')} AS n FROM (SELECT *, trim(alt) AS t FROM alts)))"""


@query("b08_alt_quality", f"WITH {q.ALTS}, {alt_sql(text.AUTO_CAPTIONS)} SELECT doc_id, pos, quality FROM graded")
def b08(spark, sf):
    return s.alts(spark, sf).select("doc_id", "pos", text.alt_quality(F.col("alt")).alias("quality"))


@query("b09_auto_caption", f"WITH {q.ALTS} SELECT doc_id, pos, {holds('lower(alt)', text.AUTO_CAPTIONS)} AS auto FROM alts")
def b09(spark, sf):
    return s.alts(spark, sf).select("doc_id", "pos", text.is_auto_caption(F.col("alt")).alias("auto"))


@query("b10_filename_alt", f"WITH {q.ALTS} SELECT doc_id, pos, regexp_matches(lower(trim(alt)), '\\.(jpg|jpeg|png|gif|bmp|tiff|svg)$') OR starts_with(trim(alt), 'Screen Shot ') OR starts_with(trim(alt), 'image') OR (length(trim(alt)) < 10 AND contains(alt, '.')) AS is_file FROM alts")
def b10(spark, sf):
    return s.alts(spark, sf).select("doc_id", "pos", text.is_filename(F.col("alt")).alias("is_file"))


@query("b11_alt_quality_one_phrase", f"WITH {q.ALTS}, {alt_sql(('automatically generated',))} SELECT doc_id, pos, quality FROM graded")
def b11(spark, sf):
    return s.alts(spark, sf).select("doc_id", "pos", text.alt_quality(F.col("alt"), ("automatically generated",)).alias("quality"))


REPAIR = """repaired AS (SELECT *, CASE WHEN url <> '' AND out <> trim(url) THEN out END AS fixed FROM (SELECT *, CASE WHEN starts_with(lower(u), 'mailto:') THEN 'mailto:' || regexp_replace(substr(u, 8), '\\s+', '', 'g')
  WHEN regexp_matches(u, '(?i)^https?://') THEN regexp_replace(u, '\\s+', '', 'g') ELSE u END AS out
  FROM (SELECT *, CASE WHEN regexp_matches(trim(url), '(?i)^https?:/+') THEN lower(regexp_extract(trim(url), '(?i)^(https?):/+', 1)) || '://' || regexp_replace(trim(url), '(?i)^https?:/+', '') ELSE trim(url) END AS u FROM faulty_anchors)))"""
SEVERITY = """CASE WHEN regexp_matches(trim(url), 'https?:/([^/]|$)') OR contains(trim(url), ':///') OR regexp_matches(regexp_extract(trim(url), '^https?://([^/]*)', 1), '\\s')
  OR (starts_with(trim(url), 'mailto:') AND contains(url, '@') AND NOT regexp_matches(trim(substr(trim(url), 8)), '^\\S+@\\S+')) THEN 'severe' WHEN regexp_matches(trim(url), '\\s') THEN 'minor' ELSE 'ok' END"""


@query("b12_repair_uri", f"WITH {q.FAULTY_ANCHORS}, {REPAIR} SELECT page_id, pos, url, fixed FROM repaired")
def b12(spark, sf):
    return s.faulty_anchors(spark, sf).select("page_id", "pos", "url", text.repair_uri(F.col("url")).alias("fixed"))


@query("b13_uri_severity", f"WITH {q.FAULTY_ANCHORS} SELECT page_id, pos, {SEVERITY} AS severity FROM faulty_anchors")
def b13(spark, sf):
    return s.faulty_anchors(spark, sf).select("page_id", "pos", text.uri_severity(F.col("url")).alias("severity"))


@query("b14_is_url", f"WITH {q.FAULTY_ANCHORS} SELECT page_id, pos, regexp_matches(trim(text), '(?i)^(https?://|www\\.|ftp://|mailto:)') AS is_url FROM faulty_anchors")
def b14(spark, sf):
    return s.faulty_anchors(spark, sf).select("page_id", "pos", text.is_url(F.col("text")).alias("is_url"))


@query("b15_vague_link", f"WITH {q.FAULTY_ANCHORS} SELECT page_id, pos, rtrim(lower(trim(text)), '.') IN ({quoted(text.VAGUE)}) AS vague FROM faulty_anchors")
def b15(spark, sf):
    return s.faulty_anchors(spark, sf).select("page_id", "pos", text.is_vague(F.col("text")).alias("vague"))


BULLET = "^[\\x{2022}\\x{2023}\\x{25E6}\\x{2043}\\x{2219}\\x{25AA}\\x{25CF}\\x{25CB}\\x{2013}\\x{2014}\\-*>]\\s+"
ORDERED = ("^(\\d{1,3})[.)]\\s+", "^[a-zA-Z][.)]\\s+", "(?i)^(?:i{1,3}|iv|vi{0,3}|ix|x{0,3})[.)]\\s+")
LIST_TYPE = f"CASE WHEN regexp_matches(trim(text), '{BULLET}') THEN 'bulleted' WHEN " + " OR ".join(f"regexp_matches(trim(text), '{p}')" for p in ORDERED) + " THEN 'numbered' END"


@query("b16_list_type", f"WITH {q.FAULTY_LINES} SELECT doc_id, pos, {LIST_TYPE} AS list_type FROM faulty")
def b16(spark, sf):
    return s.faulty_lines(spark, sf).select("doc_id", "pos", text.list_type(F.col("text")).alias("list_type"))


@query("b17_strip_list_prefix", f"WITH {q.FAULTY_LINES} SELECT doc_id, pos, CASE " + " ".join(f"WHEN regexp_matches(trim(text), '{p}') THEN regexp_replace(trim(text), '{p}', '')" for p in (BULLET, *ORDERED)) + " ELSE trim(text) END AS item FROM faulty")
def b17(spark, sf):
    return s.faulty_lines(spark, sf).select("doc_id", "pos", text.without_list_prefix(F.col("text")).alias("item"))


@query("b19_citation", f"WITH {q.FAULTY_LINES} SELECT doc_id, pos, regexp_matches(text, '\\(\\d{{4}}\\)') OR regexp_matches(text, '(?i)\\bet\\s+al\\.') OR length(text) - length(replace(text, ',', '')) >= 3 AS citation FROM faulty")
def b19(spark, sf):
    return s.faulty_lines(spark, sf).select("doc_id", "pos", text.is_citation(F.col("text")).alias("citation"))


@query("b20_base_font", f"WITH {q.RUNS} SELECT doc_id, pos, {q.BASE_FONT.format('font')} AS base FROM runs")
def b20(spark, sf):
    return s.runs(spark, sf).select("doc_id", "pos", text.base_font(F.col("font")).alias("base"))


DEDUP_FORM = "lower(translate(regexp_replace(regexp_replace({0}, '\\s+', ' ', 'g'), '([\\p{{L}}\\p{{N}}_])- ([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g'), chr(8212)||chr(8211)||chr(8220)||chr(8221)||chr(8216)||chr(8217), '--\"\"'''''))"
DASHED = "CASE WHEN pos % 3 = 0 THEN replace(text, 'th', 't- h') WHEN pos % 3 = 1 THEN chr(8220) || text || chr(8221) || ' ' || chr(8212) ELSE replace(text, ' ', '  ') END"


@query("b21_dedup_form", f"WITH {q.LINES}, dashed AS (SELECT doc_id, pos, {DASHED} AS text FROM lines) SELECT doc_id, pos, {DEDUP_FORM.format(q.STRIP.format('text'))} AS form FROM dashed")
def b21(spark, sf):
    t, pos = F.col("text"), F.col("pos")
    dashed = F.when(pos % 3 == 0, F.replace(t, F.lit("th"), F.lit("t- h"))).when(pos % 3 == 1, F.concat(F.lit("“"), t, F.lit("” —"))).otherwise(F.replace(t, F.lit(" "), F.lit("  ")))
    return s.lines(spark, sf).select("doc_id", "pos", text.dedup_form(dashed).alias("form"))


NAMES = "CASE doc_id % 6 WHEN 0 THEN 'English (US)' WHEN 1 THEN 'French, Canadian' WHEN 2 THEN lang WHEN 3 THEN '' WHEN 4 THEN ' German. ' ELSE 'Unknown tongue of ' || lang END"


@query("b22_language_code", f"SELECT doc_id, CASE WHEN t = '' THEN '' ELSE coalesce(CASE rtrim(split_part(lower(t), ' ', 1), ',.') {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in text.LANGUAGES.items())} END, CASE WHEN length(t) <= 10 AND NOT contains(t, ' ') AND NOT contains(t, '(') THEN t END, substr(t, 1, 10)) END AS code FROM (SELECT doc_id, trim({NAMES}) AS t FROM documents)")
def b22(spark, sf):
    k, lang = F.col("doc_id") % 6, F.col("lang")
    name = F.when(k == 0, "English (US)").when(k == 1, "French, Canadian").when(k == 2, lang).when(k == 3, "").when(k == 4, " German. ").otherwise(F.concat(F.lit("Unknown tongue of "), lang))
    return s.table(spark, sf, "documents").select("doc_id", text.language_code(name).alias("code"))


@query("b23_leaked_header", f"WITH {q.FAULTY_LINES} SELECT doc_id, pos, n BETWEEN 1 AND 12 AND (regexp_matches(t, '^[A-Z][A-Z\\s''\\x{{2019}}:,\\-]+\\d{{1,4}}\\s*$') OR regexp_matches(t, '^\\d{{1,4}}\\s+[A-Z]{{2,}}(\\s+[A-Z]{{2,}})*\\s*$') OR regexp_matches(t, '^\\d{{1,3}}$')) AS leaked FROM (SELECT doc_id, pos, trim(text) AS t, {q.N_WORDS.format('text')} AS n FROM faulty)")
def b23(spark, sf):
    return s.faulty_lines(spark, sf).select("doc_id", "pos", text.is_leaked_header(F.col("text")).alias("leaked"))


@query("b25_strip_page_header", "SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE text END) AS body_md5 FROM documents")
def b25(spark, sf):
    headed = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("158 MAYER\n\n"), F.col("text"))).otherwise(F.col("text"))
    return s.table(spark, sf, "documents").select("doc_id", F.md5(text.without_page_header(headed).cast("binary")).alias("body_md5"))


@query("b37_usage_cost", "SELECT event_id, round(CASE WHEN contains(m, 'gemini') THEN (i * 0.15 + o * 0.60) / 1000000 WHEN contains(m, 'claude') THEN (i * 3.0 + o * 15.0) / 1000000 ELSE 0 END, 9) AS cost FROM (SELECT event_id, event_id % 5000 AS i, event_id * 3 % 900 AS o, lower(CASE event_id % 3 WHEN 0 THEN 'Gemini-flash' WHEN 1 THEN 'claude-x' ELSE 'other' END) AS m FROM events)")
def b37(spark, sf):
    k = F.col("event_id")
    model = F.when(k % 3 == 0, "Gemini-flash").when(k % 3 == 1, "claude-x").otherwise("other")
    return s.table(spark, sf, "events").select("event_id", F.round(text.usage_cost(model, k % 5000, k * 3 % 900), 9).alias("cost"))


@query("b38_relative_size", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 16.0 WHEN 1 THEN 12.0 WHEN 2 THEN 10.0 ELSE 12.0 END::DOUBLE AS pt FROM events")
def b38(spark, sf):
    k = F.col("event_id") % 4
    label = F.when(k == 0, "large").when(k == 1, "normal").when(k == 2, "small").otherwise("huge")
    return s.table(spark, sf, "events").select("event_id", F.when(label == "large", 16.0).when(label == "small", 10.0).otherwise(12.0).alias("pt"))


@query("b39_escape_html", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped_md5 FROM pages")
def b39(spark, sf):
    return s.table(spark, sf, "pages").select("page_id", F.md5(text.escape_html(F.col("html")).cast("binary")).alias("escaped_md5"))


@query("b40_strip_ids", f"WITH {q.LINES} SELECT doc_id, pos, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(', ocr_p_' || pos || ' ' || text || ' img_3 x tbl_1 ;', '\\b(ocr_)?[a-z]+_\\d+\\b', '', 'g'), '\\s{{2,}}', ' ', 'g'), '^\\s*[,;:]\\s*', ''), '\\s*[,;:]\\s*$', '')) AS t FROM lines")
def b40(spark, sf):
    dirty = F.concat(F.lit(", ocr_p_"), F.col("pos").cast("string"), F.lit(" "), F.col("text"), F.lit(" img_3 x tbl_1 ;"))
    return s.lines(spark, sf).select("doc_id", "pos", text.without_ids(dirty).alias("t"))


@query("b41_duration", "SELECT k, CASE WHEN k < 60 THEN k || ' seconds' WHEN k // 60 < 60 THEN (k // 60) || ' min' || CASE WHEN k % 60 > 0 THEN ' ' || (k % 60) || ' sec' ELSE '' END ELSE (k // 3600) || ' hr ' || (k // 60 % 60) || ' min' END AS t FROM (SELECT DISTINCT event_id * 7 % 9000 AS k FROM events)")
def b41(spark, sf):
    k = (F.col("event_id") * 7 % 9000).alias("k")
    return s.table(spark, sf, "events").select(k).distinct().select("k", text.duration(F.col("k")).alias("t"))


@query("b42_private_use", "SELECT c_custkey AS k, c_custkey % 4 IN (0, 1, 2) AS private FROM customer")
def b42(spark, sf):
    k = F.col("c_custkey") % 4
    t = F.when(k == 0, "").when(k == 1, "a").when(k == 2, "\U000f1234").otherwise(F.col("c_name"))
    return s.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), text.is_private_use(t).alias("private"))


@query("b44_truncate", f"WITH {q.LINES} SELECT doc_id, pos, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS t FROM lines")
def b44(spark, sf):
    return s.lines(spark, sf).select("doc_id", "pos", text.cut(F.col("text")).alias("t"))


@query("b45_mime", "SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'image/svg+xml' WHEN 4 THEN 'application/pdf' ELSE 'image/png' END AS mime FROM customer")
def b45(spark, sf):
    k = F.col("c_custkey")
    ending = F.element_at(F.array(*map(F.lit, (".png", ".jpg", ".JPEG", ".svg", ".pdf", ".bmp"))), (k % 6 + 1).cast("int"))
    return s.table(spark, sf, "customer").select(k.alias("k"), text.mime(F.concat(F.col("c_name"), ending)).alias("mime"))


@query("b47_token_hash", "SELECT c_custkey AS k, sha256(c_name) AS hash FROM customer")
def b47(spark, sf):
    return s.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.sha2("c_name", 256).alias("hash"))


@query("b48_client_ip", "SELECT event_id, '10.0.' || (event_id % 256) || '.1' AS ip FROM events")
def b48(spark, sf):
    header = F.concat(F.lit(" 10.0."), (F.col("event_id") % 256).cast("string"), F.lit(".1 , 172.16.0.9, 8.8.8.8"))
    return s.table(spark, sf, "events").select("event_id", F.trim(F.split(header, ",")[0]).alias("ip"))


@query("b51_retry_delay", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN (event_id % 1000) / 1000.0::DOUBLE WHEN 1 THEN (event_id % 90)::DOUBLE END AS delay FROM events")
def b51(spark, sf):
    k = F.col("event_id")
    message = F.when(k % 3 == 0, F.concat(F.lit("429 'retryDelay': '"), (k % 1000).cast("string"), F.lit("ms'"))).when(k % 3 == 1, F.concat(F.lit("'retryDelay': '"), (k % 90).cast("string"), F.lit("s'"))).otherwise("no hint")
    return s.table(spark, sf, "events").select("event_id", text.retry_delay(message).alias("delay"))


@query("b36_wcag_criterion", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN array_to_string(string_split((100 + c_custkey % 900)::VARCHAR, ''), '.') END AS criterion FROM customer")
def b36(spark, sf):
    k = F.col("c_custkey")
    tag = F.when(k % 3 == 0, F.concat(F.lit("wcag"), (100 + k % 900).cast("string"))).when(k % 3 == 1, "wcag2a").otherwise("wcag21")
    return s.table(spark, sf, "customer").select(k.alias("k"), text.wcag_criterion(tag).alias("criterion"))


@query("b34_conversion_errors", "SELECT page_id, (length(h) - length(replace(h, 'class=\"ltx_ERROR', ''))) // 16 AS errors, (length(h) - length(replace(h, 'class=\"ltx_math_unparsed\"', ''))) // 25 AS unparsed FROM (SELECT page_id, replace(replace(html, '<li>', '<li class=\"ltx_ERROR x\">'), '<h1>', '<h1 class=\"ltx_math_unparsed\">') AS h FROM pages)")
def b34(spark, sf):
    h = F.replace(F.replace("html", F.lit("<li>"), F.lit('<li class="ltx_ERROR x">')), F.lit("<h1>"), F.lit('<h1 class="ltx_math_unparsed">'))
    errors, unparsed = latex.error_marks(h)
    return s.table(spark, sf, "pages").select("page_id", errors.alias("errors"), unparsed.alias("unparsed"))


FORMULAS = ("", "x", "\\alpha", "{\\Omega}", "n!", "x_{12}", "y_i", "a^2", "b^{3}", "c^{10}", "d^n", "-3.5", "\\frac{a}{b}", "a+b=c", "a + b = c + d", "long formula here")
CLASSES = ("trivial",) * 12 + ("complex", "trivial", "complex", "trivial")
WORDS = ("", "x", "alpha", "Omega", "n factorial", "x sub 12", "y sub i", "a squared", "b cubed", "c to the 10", "d to the n", "-3.5", "\\frac{a}{b", "a+b=c", "a + b = c + d", "long formula here")


def listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query("b26_math_class", f"SELECT c_custkey AS k, CASE WHEN c_custkey % 16 = 15 AND c_custkey % 2 = 1 THEN 'complex' ELSE ({listed(CLASSES)})[c_custkey % 16 + 1] END AS class FROM customer")
def b26(spark, sf):
    k = F.col("c_custkey")
    source = F.element_at(F.array(*map(F.lit, FORMULAS)), (k % 16 + 1).cast("int"))
    return s.table(spark, sf, "customer").select(k.alias("k"), latex.math_class(source, F.when(k % 16 == 15, "block").otherwise("inline")).alias("class"))


@query("b27_math_words", f"SELECT c_custkey AS k, ({listed(WORDS)})[c_custkey % 16 + 1] AS words FROM customer")
def b27(spark, sf):
    k = F.col("c_custkey")
    source = F.element_at(F.array(*map(F.lit, FORMULAS)), (k % 16 + 1).cast("int"))
    return s.table(spark, sf, "customer").select(k.alias("k"), latex.math_words(source).alias("words"))


PSEUDO = ("\\If x \\State y", "\\Return \\Call f", "\\Require n \\Return m", "\\If only", "plain", "\\StateMachine \\Iffy", "\\While z \\EndWhile")


@query("b28_pseudocode", "SELECT c_custkey AS k, c_custkey % 7 IN (0, 1, 2, 6) AS pseudo FROM customer")
def b28(spark, sf):
    k = F.col("c_custkey")
    return s.table(spark, sf, "customer").select(k.alias("k"), latex.is_pseudocode(F.element_at(F.array(*map(F.lit, PSEUDO)), (k % 7 + 1).cast("int"))).alias("pseudo"))


TIKZ = ("\\node (a) {A}; \\node (b) {B}; \\draw (a) -- (b);", "\\node[state] (q0) {}; \\path (q0) edge (q1);", "\\begin{tikzpicture}\\end{tikzpicture}", "\\draw (0,0);", "plain text", "\\nodes")


@query("b29_tikz", "SELECT c_custkey AS k, c_custkey % 6 IN (0, 1, 2, 3) AS tikz FROM customer")
def b29(spark, sf):
    k = F.col("c_custkey")
    return s.table(spark, sf, "customer").select(k.alias("k"), latex.is_tikz(F.element_at(F.array(*map(F.lit, TIKZ)), (k % 6 + 1).cast("int"))).alias("tikz"))


def told(kind: str, detail: str) -> str:
    return f"[Diagram: This {kind} could not be automatically converted. {detail} Please refer to the original document or provide a description.]"


PLACEHOLDERS = (
    told("diagram", "It contains a TikZ diagram with 2 nodes and 2 edges."),
    told("finite automaton", "It contains a TikZ finite automaton with 1 state and 1 transition."),
    told("drawing", "It contains TikZ drawing commands."),
    told("diagram", "It contains a TikZ diagram with 1 edge."),
    told("drawing", "It contains TikZ drawing commands."),
    told("drawing", "It contains TikZ drawing commands."),
)


@query("b30_tikz_placeholder", f"SELECT c_custkey AS k, ({listed(PLACEHOLDERS)})[c_custkey % 6 + 1] AS placeholder FROM customer")
def b30(spark, sf):
    k = F.col("c_custkey")
    return s.table(spark, sf, "customer").select(k.alias("k"), latex.tikz_placeholder(F.element_at(F.array(*map(F.lit, TIKZ)), (k % 6 + 1).cast("int"))).alias("placeholder"))


@query("b31_latex_noise", f"WITH {q.LINES} SELECT doc_id, pos, CASE WHEN pos % 4 = 3 THEN '' ELSE trim(text) END AS t FROM lines")
def b31(spark, sf):
    t, pos = F.col("text"), F.col("pos")
    noisy = F.when(pos % 4 == 0, F.concat(F.lit("Problem 3 continued on next page... "), t)).when(pos % 4 == 1, F.concat(F.lit("automata, positioning\n"), t)).when(pos % 4 == 2, F.concat(t, F.lit("\n\\exitProblemHeader{x}"))).otherwise(F.concat(F.lit("frame=single, "), t))
    return s.lines(spark, sf).select("doc_id", "pos", latex.without_noise(noisy).alias("t"))


@query("b35_converter_warnings", "SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN ['Warning: a', 'x undefined'] WHEN 1 THEN [] ELSE ['Error: b'] END AS told FROM customer")
def b35(spark, sf):
    k = F.col("c_custkey")
    log = F.when(k % 3 == 0, "(Loading 1.2 sec)\n Warning: a \nfine\nx undefined").when(k % 3 == 1, "all good\n\n").otherwise("(Error: 0 sec)\nError: b")
    return s.table(spark, sf, "customer").select(k.alias("k"), latex.warnings(log).alias("told"))


@query("a22_pages", f"SELECT doc_id, greatest(ceil({q.N_WORDS.format('text')} / 275.0), 1)::INT AS pages FROM documents")
def a22(spark, sf):
    return s.table(spark, sf, "documents").select("doc_id", text.pages(F.col("text")).alias("pages"))


@query("a24_render_paragraph", f"WITH {q.FAULTY_LINES} SELECT doc_id, pos, CASE WHEN heading_level IS NOT NULL THEN '<h' || least(heading_level, 6) || '>' || t || '</h' || least(heading_level, 6) || '>' WHEN {LIST_TYPE} IS NOT NULL THEN '<li>' || t || '</li>' ELSE '<p>' || t || '</p>' END AS html FROM (SELECT *, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;') AS t FROM faulty) WHERE trim(text) <> ''")
def a24(spark, sf):
    level, t = F.least(F.col("heading_level"), F.lit(6)).cast("string"), text.escape_html(F.col("text"))
    heading = F.concat(F.lit("<h"), level, F.lit(">"), t, F.lit("</h"), level, F.lit(">"))
    html = F.when(F.col("heading_level").isNotNull(), heading).when(text.list_type(F.col("text")).isNotNull(), F.concat(F.lit("<li>"), t, F.lit("</li>"))).otherwise(F.concat(F.lit("<p>"), t, F.lit("</p>")))
    return s.faulty_lines(spark, sf).where(text.strip(F.col("text")) != "").select("doc_id", "pos", html.alias("html"))


@query("a27_render_image", f"WITH {q.ALTS} SELECT doc_id, pos, '<img alt=\"' || CASE WHEN decorative THEN '' ELSE replace(replace(replace(replace(replace(alt, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') END || '\"' || CASE WHEN decorative THEN ' role=\"presentation\"' ELSE '' END || '>' AS html, alt = '' AND NOT decorative AS warned FROM alts")
def a27(spark, sf):
    alt = F.when(F.col("decorative"), "").otherwise(text.escape_html(F.col("alt")))
    return s.alts(spark, sf).select("doc_id", "pos", F.concat(F.lit('<img alt="'), alt, F.lit('"'), F.when(F.col("decorative"), ' role="presentation"').otherwise(""), F.lit(">")).alias("html"), ((F.col("alt") == "") & ~F.col("decorative")).alias("warned"))


@query("c11_title_language", "SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) <> '' AS has_title, trim(regexp_extract(html, '<html lang=\"([^\"]*)\"', 1)) <> '' AS has_language FROM pages")
def c11(spark, sf):
    found = lambda p: text.strip(F.regexp_extract("html", p, 1)) != ""
    return s.table(spark, sf, "pages").select("page_id", found("<title>([^<]*)</title>").alias("has_title"), found('<html lang="([^"]*)"').alias("has_language"))
