"""Queries over the driver's tables for the operators that are relations, with DuckDB SQL for the same rows.

Inputs that the tables don't have (page evidence, damaged text, lines with positions) are
derived by SQL that both engines run, so that operators are tested on whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import labels, text
from folioforge.operators import layout, metrics, ocr, quality, routing, tables

#: Words of one document in both dialects are the same pattern; SPACE for DuckDB's trim.
EVIDENCE = """SELECT l_partkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS INT) AS page,
  CAST(l_orderkey % 67 AS INT) AS text_ops, CAST(l_orderkey % 71 AS INT) AS font_changes, CAST(l_suppkey % 3 AS INT) AS image_count,
  CAST(l_orderkey % 31 AS INT) AS unique_chars, CAST(l_orderkey % 41 AS INT) AS unique_alnum,
  l_suppkey % 3 > 0 AND l_partkey % 3 = 0 AS has_images, l_orderkey % 5 = 0 AND l_partkey % 4 = 0 AS has_template_image, l_orderkey % 53 = 0 AND l_partkey % 2 = 0 AS has_vector_text,
  l_orderkey % 59 = 0 AS identity_h_no_tounicode, l_orderkey % 61 = 0 AS only_type3, l_suppkey % 2 = 0 AS decodable FROM lineitem"""

DAMAGED = """SELECT doc_id, 1 AS page, CASE doc_id % 9
  WHEN 0 THEN replace(text, ' ', '$')
  WHEN 1 THEN replace(text, 'the', '��')
  WHEN 2 THEN replace(text, 'en', '')
  WHEN 3 THEN replace(text, 'on', chr(133) || chr(134))
  WHEN 4 THEN translate(text, 'aeioutnshr', 'xzqjkvwbpf')
  WHEN 5 THEN replace(text, 'e', '. ')
  WHEN 6 THEN replace(text, ' ', ' @@@@@@@@@@ ')
  ELSE text END AS text FROM documents"""

SQL_SPACE = r"\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

LINES = """SELECT o_custkey AS doc_id, CAST(o_orderkey % 5 AS INT) AS page, o_orderkey AS ord, CAST(700 - (o_orderkey % 97) * 7 AS DOUBLE) AS y,
  CASE WHEN o_orderkey % 11 = 0 THEN 18.0 WHEN o_orderkey % 13 = 0 THEN 14.5 WHEN o_orderkey % 7 = 0 THEN 10.0 WHEN o_orderkey % 17 = 0 THEN 8.0 ELSE 11.0 END AS font_size,
  CASE WHEN o_orderkey % 10 = 0 THEN '42' ELSE o_orderpriority END AS text FROM orders"""


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def counted(sql: str) -> str:
    """count_if(x), which is a HUGEINT in DuckDB, as a count of BIGINT."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) FILTER (WHERE {sql[at + 9 : end - 1]}){sql[end:]}"
    return sql


def query(name: str, oracle: str | None, *needs: str):
    """Registers make(spark) over the named tables as views."""

    def keep(make):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            views(spark, sf_dir, *needs)
            return make(spark)

        run.__doc__ = make.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = counted(oracle)
        return make

    return keep


# --- text ---------------------------------------------------------------------

ODD_TEXT = "SELECT doc_id, replace(replace(text, ' the ', chr(13) || chr(10) || ' '), ' of ', '​' || chr(9) || chr(7)) AS text FROM documents"


@query("clean_text", rf"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\r\n|[\r\n\x{{A0}}]', ' ', 'g'), '[\x{{00}}-\x{{08}}\x{{0B}}\x{{0C}}\x{{0E}}-\x{{1F}}\x{{7F}}-\x{{9F}}\x{{AD}}\x{{200B}}\x{{FEFF}}]', '', 'g')) AS cleaned FROM ({ODD_TEXT})", "documents")
def _clean(spark):
    return spark.sql(ODD_TEXT).select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("cleaned"))


URIS = "SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'c:/' || url WHEN 2 THEN '/rel' || url WHEN 3 THEN 'mailto:x' ELSE '1x:' || url END AS uri FROM pages"


@query("absolute_uris", f"SELECT page_id, uri, regexp_matches(uri, '^[A-Za-z][A-Za-z0-9+.\\-]*:') AND NOT regexp_matches(uri, '^[A-Za-z]:[\\\\/]') AS is_absolute FROM ({URIS})", "pages")
def _uris(spark):
    return spark.sql(URIS).select("page_id", "uri", text.is_absolute_uri(F.col("uri")).alias("is_absolute"))


NAMES = "SELECT p_partkey, concat(p_brand, CASE p_partkey % 6 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.svg' WHEN 3 THEN '.tif' WHEN 4 THEN '.xyz' ELSE '' END) AS name FROM part"


@query(
    "media_types",
    f"""SELECT p_partkey, name, coalesce(element_at(MAP {{{', '.join(f"'{k}': '{v}'" for k, v in text.MEDIA_TYPES.items())}}}, lower(regexp_extract(name, '\\.([^.]*)$', 1))), 'application/octet-stream') AS media_type FROM ({NAMES})""".replace("element_at(MAP", "map_extract_value(MAP"),
    "part",
)
def _media(spark):
    return spark.sql(NAMES).select("p_partkey", "name", text.media_type(F.col("name")).alias("media_type"))


ALL_LINES = "SELECT doc_id, CAST(ord AS BIGINT) AS ord, line FROM (SELECT doc_id, posexplode(split(text, '\\n', -1)) AS (ord, line) FROM documents)"
SQL_LINES = "SELECT doc_id, CAST(unnest(range(len(parts))) AS BIGINT) AS ord, unnest(parts) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)"


@query(
    "gfm_slug_unique",
    rf"""WITH s AS (SELECT doc_id, ord, regexp_replace(translate(lower(trim(line)), ' ', '-'), '[^\-\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}]', '', 'g') AS k FROM ({SQL_LINES})),
t AS (SELECT doc_id, ord, CASE WHEN k = '' THEN 'section' ELSE k END AS slug FROM s)
SELECT doc_id, ord, slug, CASE WHEN n = 0 THEN slug ELSE slug || '-' || n END AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY ord) - 1 AS n FROM t)""",
    "documents",
)
def _slugs_of_lines(spark):
    """Every line of every document as a heading of that document."""
    return layout.unique_slugs(spark.sql(ALL_LINES).select("doc_id", "ord", text.slug(F.col("line")).alias("slug")))


MARKS = "CASE (doc_id + ord) % 6 WHEN 0 THEN '• ' WHEN 1 THEN '12. ' WHEN 2 THEN '  3) ' WHEN 3 THEN '- ' WHEN 4 THEN '1234. ' ELSE '' END || line AS line"


@query(
    "list_markers",
    rf"""WITH l AS (SELECT doc_id, ord, regexp_replace(line, '^ +', '') AS t FROM (SELECT doc_id, ord, {MARKS} FROM ({SQL_LINES}))),
m AS (SELECT doc_id, ord, t, regexp_extract(t, '^([•·◦○●\-*])(?: |$)', 1) AS b, regexp_extract(t, '^([0-9]{{1,3}})(?:\. |\) | )', 1) AS n FROM l)
SELECT doc_id, ord, CASE WHEN b <> '' THEN '-' WHEN n <> '' THEN n || '.' END AS marker,
 CASE WHEN b <> '' THEN regexp_replace(regexp_replace(t, '^[•·◦○●\-*]', ''), '^ +', '') WHEN n <> '' THEN regexp_replace(regexp_replace(t, '^[0-9]{{1,3}}(?:\. |\) | )', ''), '^ +', '') END AS rest FROM m""",
    "documents",
)
def _markers_of_lines(spark):
    """Every line of every document."""
    return spark.sql(f"SELECT doc_id, ord, {MARKS} FROM ({ALL_LINES})").select("doc_id", "ord", text.list_marker(F.col("line")).alias("m")).select("doc_id", "ord", "m.marker", "m.rest")


NUMBERS = "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(o_custkey AS STRING) || '/' || CAST(o_orderkey AS STRING) WHEN 1 THEN ' - 12 - ' WHEN 2 THEN 'page 3' WHEN 3 THEN '' ELSE '1,234,567,890' END AS line FROM orders"


@query("page_numbers", rf"SELECT o_orderkey, strlen(trim(line)) <= 12 AND regexp_matches(trim(line), '^[\p{{Nd}}/ ,\-]+$') AS is_number FROM ({NUMBERS.replace('STRING', 'VARCHAR')})", "orders")
def _page_numbers(spark):
    return spark.sql(NUMBERS).select("o_orderkey", text.is_page_number(F.col("line")).alias("is_number"))


HYPHENS = "SELECT doc_id, replace(replace(text, 'ti', 'ti-' || chr(10)), '. ', chr(10) || chr(10) || chr(10)) AS md FROM documents"


@query("hyphenation", rf"SELECT doc_id, md5(regexp_replace(regexp_replace(md, '(\p{{L}})-\n(\p{{Ll}})', '\1' || chr(10) || '\2', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')) AS joined FROM ({HYPHENS})", "documents")
def _hyphens(spark):
    return spark.sql(HYPHENS).select("doc_id", F.md5(text.squeeze_blank_lines(text.join_hyphens(F.col("md")))).alias("joined"))


REFS = "SELECT l_orderkey, l_linenumber, concat(chr(CAST(65 + l_partkey % 26 AS INT)), CASE WHEN l_suppkey % 2 = 0 THEN chr(CAST(65 + l_suppkey % 26 AS INT)) ELSE '' END, CAST(l_orderkey % 1048576 + 1 AS STRING)) AS ref FROM lineitem"


@query(
    "a1_refs",
    rf"""SELECT l_orderkey, l_linenumber, CAST(regexp_extract(ref, '([0-9]+)$', 1) AS INTEGER) AS r,
 CAST(CASE WHEN length(regexp_extract(ref, '^[A-Z]+')) = 1 THEN ascii(ref) - 64 ELSE (ascii(ref) - 64) * 26 + ascii(substr(ref, 2)) - 64 END AS INTEGER) AS c FROM ({REFS.replace('STRING', 'VARCHAR')})""",
    "lineitem",
)
def _a1(spark):
    return spark.sql(REFS).select("l_orderkey", "l_linenumber", text.a1_row(F.col("ref")).alias("r"), text.a1_column(F.col("ref")).cast("int").alias("c"))


SERIALS = "SELECT l_orderkey, l_linenumber, CAST((l_partkey * 37 + l_suppkey * 11 + l_linenumber) % 60000 AS DOUBLE) + 0.25 AS serial FROM lineitem"


@query(
    "excel_serial_dates",
    f"""SELECT l_orderkey, l_linenumber, CASE WHEN floor(serial) = 60 OR floor(serial) < 1 THEN NULL WHEN floor(serial) < 60 THEN strftime(DATE '1899-12-31' + CAST(floor(serial) AS INTEGER), '%Y-%m-%d') ELSE strftime(DATE '1899-12-30' + CAST(floor(serial) AS INTEGER), '%Y-%m-%d') END AS day1900,
 strftime(DATE '1904-01-01' + CAST(floor(serial) AS INTEGER), '%Y-%m-%d') AS day1904 FROM ({SERIALS})""",
    "lineitem",
)
def _serials(spark):
    return spark.sql(SERIALS).select("l_orderkey", "l_linenumber", text.serial_date(F.col("serial")).alias("day1900"), text.serial_date(F.col("serial"), True).alias("day1904"))


@query(
    "marker_labels_alpha",
    """WITH n AS (SELECT p_partkey, p_partkey - 1 AS n FROM part)
SELECT p_partkey, CASE WHEN n <= 0 THEN CAST(n AS VARCHAR) WHEN n <= 26 THEN chr(CAST(96 + n AS INTEGER)) WHEN n <= 702 THEN chr(CAST(96 + (n - 1) // 26 AS INTEGER)) || chr(CAST(97 + (n - 1) % 26 AS INTEGER))
 ELSE chr(CAST(97 + ((n - 703) // 676) % 26 AS INTEGER)) || chr(CAST(97 + ((n - 27) // 26) % 26 AS INTEGER)) || chr(CAST(97 + (n - 1) % 26 AS INTEGER)) END AS label FROM n""",
    "part",
)
def _alpha(spark):
    return spark.sql("SELECT p_partkey, p_partkey - 1 AS n FROM part").select("p_partkey", labels.alpha(F.col("n")).alias("label"))


def _place(digits: list[str], unit: int) -> str:
    return f"(ARRAY[{', '.join(repr(d) for d in digits)}])[1 + (n // {unit}) % 10]"


@query(
    "marker_labels_roman",
    f"""WITH n AS (SELECT o_orderkey, o_orderkey % 4100 AS n FROM orders)
SELECT o_orderkey, CASE WHEN n <= 0 OR n > 3999 THEN CAST(n AS VARCHAR) ELSE {_place(labels.THOUSANDS, 1000)} || {_place(labels.HUNDREDS, 100)} || {_place(labels.TENS, 10)} || {_place(labels.ONES, 1)} END AS label FROM n""",
    "orders",
)
def _roman(spark):
    return spark.sql("SELECT o_orderkey, o_orderkey % 4100 AS n FROM orders").select("o_orderkey", labels.roman(F.col("n")).alias("label"))


VALUES = """SELECT l_orderkey, l_linenumber, CASE l_orderkey % 12 WHEN 0 THEN CAST(l_partkey AS STRING) WHEN 1 THEN '1,234.5%' WHEN 2 THEN 'Yes' WHEN 3 THEN CAST(CAST(l_shipdate AS DATE) AS STRING)
 WHEN 4 THEN '10:30' WHEN 5 THEN '' WHEN 6 THEN l_returnflag WHEN 7 THEN '1.2.3.4' WHEN 8 THEN '-1e5' WHEN 9 THEN '2020-01-02T10:11:12.5Z' WHEN 10 THEN ' 0x1F ' ELSE '1/2/2020 5' END AS v FROM lineitem"""


@query(
    "value_classify",
    rf"""WITH v AS (SELECT l_orderkey, l_linenumber, trim(v) AS v FROM ({VALUES.replace('STRING', 'VARCHAR')}))
SELECT l_orderkey, l_linenumber, CASE WHEN v = '' THEN 'blank'
 WHEN regexp_matches(regexp_replace(regexp_replace(v, '%$', ''), '[, _\x{{A0}}]', '', 'g'), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN 'number'
 WHEN lower(v) IN ('true', 'false', 'yes', 'no') THEN 'bool'
 WHEN regexp_matches(v, '^(?:(?:\d{{1,4}}-\d{{1,4}}-\d{{1,4}}|\d{{1,4}}/\d{{1,4}}/\d{{1,4}}|\d{{1,4}}\.\d{{1,4}}\.\d{{1,4}})(?:[T ](?:\d{{1,4}}:\d{{1,4}}(?::\d{{1,4}})?)?(?:\.[^Z]*)?Z*)?|\d{{1,4}}:\d{{1,4}}(?::\d{{1,4}})?)$') THEN 'date' ELSE 'text' END AS kind FROM v""",
    "lineitem",
)
def _values(spark):
    return spark.sql(VALUES).select("l_orderkey", "l_linenumber", labels.value_kind(F.col("v")).alias("kind"))


# --- quality --------------------------------------------------------------------

_n = lambda chars, t="t": f"length(regexp_replace({t}, '[^{chars}]', '', 'g'))"
_run = lambda chars, t="t": f"coalesce(list_max(list_transform(regexp_extract_all({t}, '[{chars}]+'), lambda x: length(x))), 0)"
_bare = f"regexp_replace(t, '[{SQL_SPACE}]', '', 'g')"
_plain = f"regexp_replace(t, '[{SQL_SPACE}·]', '', 'g')"
_sym = r"regexp_replace(regexp_replace(t, '\.{3,}|_{3,}|·{3,}|\.(?: \.){2,}|_(?: _){2,}|·(?: ·){2,}', '', 'g'), '[" + SQL_SPACE + r"#*|\-]', '', 'g')"
SPANS_SQL = rf"""SELECT doc_id, page, text, t,
  {_n(r'\x{FFFD}')} AS replaced, {_run(r'\x{FFFD}')} AS run, length({_bare}) AS chars,
  ({_run(text.PRIVATE)} >= 3 OR (length({_bare}) >= 5 AND {_n(text.PRIVATE)} >= 2 AND {_n(text.PRIVATE)} * 2 >= length({_bare}))) AS private_use,
  len(list_filter(regexp_split_to_array(t, '[{SQL_SPACE}]+'), lambda x: length(x) >= 5 AND {_n(text.C1, 'x')} >= 2 AND {_n(text.C1, 'x')} * 20 >= length(x))) > 0 AS c1_token,
  {_n(r'\$')} AS dollars,
  len(list_filter(generate_series(2, length(t) - 1), lambda i: i > 1 AND t[i] = '$' AND regexp_matches(t[i-1], '[A-Za-z]') AND regexp_matches(t[i+1], '[A-Za-z]'))) AS between_letters,
  (length({_sym}) >= 50 AND {_n(r'\p{L}\p{Nd}', _sym)} * 2 < length({_sym})) AS symbols,
  length({_plain}) AS plain, {_n(text.C1, _plain)} AS c1, {_n(r'\x{A0}-\x{FF}', _plain)} AS high, {_n('A-Za-z', _plain)} AS ascii_letters
  FROM (SELECT *, regexp_replace(regexp_replace(text, '^[{SQL_SPACE}]+', ''), '[{SQL_SPACE}]+$', '') AS t FROM ({DAMAGED}))"""
GARBAGE_SQL = "(symbols OR (plain >= 5 AND ((c1 >= 2 AND c1 * 20 >= plain) OR (plain >= 20 AND high * 5 >= plain * 2 AND ascii_letters * 3 < plain))))"
DOLLAR_SQL = "(dollars > 10 AND (between_letters > 20 OR between_letters * 2 > dollars))"
KIND_SQL = f"CASE WHEN t = '' THEN 'none' WHEN {DOLLAR_SQL} OR private_use OR {GARBAGE_SQL} OR c1_token THEN 'strong' WHEN run >= 2 OR replaced >= 3 THEN 'replacement' ELSE 'none' END"

for _name, _column, _sql in (
    ("quality_replacement", lambda t: quality.has_replacement_run(t), "run >= 2 OR replaced >= 3"),
    ("quality_private_use", lambda t: quality.has_private_use(t), "private_use"),
    ("quality_c1_tokens", lambda t: quality.has_control_token(t), "c1_token"),
    ("quality_dollar", lambda t: quality.has_dollars_for_spaces(t), DOLLAR_SQL),
    ("quality_non_alnum", lambda t: quality.is_mostly_symbols(t), "symbols"),
    ("quality_font_garbage", lambda t: quality.is_font_garbage(t), GARBAGE_SQL),
    ("quality_span_kind", lambda t: quality.span_kind(t), KIND_SQL),
):
    query(_name, f"SELECT doc_id, {_sql} AS verdict FROM ({SPANS_SQL})", "documents")(lambda spark, f=_column: spark.sql(DAMAGED).select("doc_id", f(text.trimmed(F.col("text"))).alias("verdict")))

_letters = ", ".join(f"length(l) - length(replace(l, '{chr(97 + i)}', ''))" for i in range(26))
_english = ", ".join(map(str, quality.ENGLISH))
_sorted = ", ".join(map(str, sorted(quality.ENGLISH, reverse=True)))
CIPHER_SQL = rf"""SELECT doc_id, n, vowels, pairs, shifts, latin_more, non_latin, CASE WHEN n = 0 THEN 1.0 ELSE list_cosine_similarity(s, [{_english}]::DOUBLE[]) END AS english, CASE WHEN n = 0 THEN 1.0 ELSE list_cosine_similarity(list_reverse_sort(s), [{_sorted}]::DOUBLE[]) END AS shape
 FROM (SELECT *, list_transform(letters, lambda x: CASE WHEN n = 0 THEN 0.0 ELSE x / n END)::DOUBLE[] AS s FROM (SELECT *, list_sum(letters)::BIGINT AS n FROM (
  SELECT doc_id, [{_letters}] AS letters, length(regexp_replace(l, '[^aeiou]', '', 'g')) AS vowels, length(l) - len(regexp_extract_all(text, '[A-Za-z]+')) AS pairs,
   len(regexp_extract_all(text, '[a-z][A-Z]')) AS shifts,
   length(regexp_replace(u, '[^\x{{C0}}-\x{{24F}}\x{{1E00}}-\x{{1EFF}}]', '', 'g')) AS latin_more, length(regexp_replace(u, '[A-Za-z\x{{C0}}-\x{{24F}}\x{{1E00}}-\x{{1EFF}}]', '', 'g')) AS non_latin
  FROM (SELECT *, lower(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l, regexp_replace(text, '[^\p{{L}}]', '', 'g') AS u FROM ({DAMAGED}))))) """


@query("quality_cipher_cosine", f"SELECT doc_id, n AS n_letters, vowels, pairs, shifts, latin_more, non_latin, round(english, 6) AS english, round(shape, 6) AS shape FROM ({CIPHER_SQL})", "documents")
def _cipher(spark):
    e = quality.with_cosines(quality.page_evidence(spark.sql(DAMAGED)))
    return e.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("n_letters", "vowels", "pairs", "shifts", "latin_more", "non_latin")), F.round("english", 6).alias("english"), F.round("shape", 6).alias("shape"))


@query(
    "quality_garbled_pages",
    f"""SELECT s.doc_id, 1 AS page FROM (SELECT *, {KIND_SQL} AS kind, replaced * 10000 // nullif(chars, 0) AS bps FROM ({SPANS_SQL})) s JOIN ({CIPHER_SQL}) c USING (doc_id)
WHERE kind = 'strong' OR (kind = 'replacement' AND chars > 0 AND ((chars <= 80 AND run >= 2) OR (replaced >= 12 AND bps >= 500) OR (run >= 8 AND bps >= 250)))
 OR (n >= 200 AND non_latin <= n + latin_more AND vowels * 100 <= n * 30 AND ((pairs >= 100 AND shifts * 10 >= pairs) OR (english < 0.60 AND shape >= 0.90)))""",
    "documents",
)
def _garbled(spark):
    return quality.garbled_pages(spark.sql(DAMAGED))


# --- routing --------------------------------------------------------------------

DOC_SQL = f"SELECT *, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS total FROM ({EVIDENCE})"
SAMPLE_SQL = "(total <= 8 OR page = 1 OR page = total OR (page > 1 AND page < total AND (page - 1) % ((total - 2) // 7) = 0 AND (page - 1) // ((total - 2) // 7) BETWEEN 1 AND 6))"
SCAN_SQL = "(image_count <= 1 AND text_ops < 50 AND unique_alnum < 10 AND NOT (decodable AND text_ops >= 10))"
DOMINATED_SQL = "(image_count > 10 AND image_count > text_ops * 3)"
TEXT_SQL = f"(text_ops >= CASE WHEN has_images OR image_count > 0 THEN 10 ELSE 3 END AND NOT {DOMINATED_SQL} AND unique_chars >= 5 AND NOT has_vector_text AND NOT only_type3)"
CLASS_SQL = f"""SELECT doc_id, page_count, pages_sampled, pages_with_text,
 CASE WHEN scans > 0 AND pages_with_text > 0 THEN 'mixed' WHEN pages_with_text / pages_sampled >= 0.6 THEN 'text_based' WHEN pages_with_text = 0 AND (images > 0 OR vectors > 0) AND ops = 0 AND vectors = 0 THEN 'scanned' WHEN pages_with_text = 0 AND (images > 0 OR vectors > 0) THEN 'image_based' WHEN pages_with_text > 0 AND (images > 0 OR vectors > 0) THEN 'mixed' WHEN ops = 0 THEN 'scanned' ELSE 'text_based' END AS pdf_type,
 CASE WHEN scans > 0 AND pages_with_text > 0 THEN 0.5 + 0.3 * (1.0 - scans / pages_sampled) WHEN pages_with_text / pages_sampled >= 0.6 THEN pages_with_text / pages_sampled WHEN pages_with_text = 0 AND (images > 0 OR vectors > 0) AND ops = 0 AND vectors = 0 THEN 0.95 WHEN pages_with_text = 0 AND (images > 0 OR vectors > 0) THEN 0.8 WHEN pages_with_text > 0 AND (images > 0 OR vectors > 0) THEN 0.7 WHEN ops = 0 THEN 0.9 ELSE greatest(pages_with_text / pages_sampled, 0.5) END AS confidence
 FROM (SELECT doc_id, CAST(count(*) AS INT) AS page_count, CAST(count_if(s) AS INT) AS pages_sampled, CAST(count_if(s AND {TEXT_SQL}) AS INT) AS pages_with_text, count_if(s AND has_images) AS images, count_if(s AND has_template_image AND {SCAN_SQL}) AS scans, count_if(s AND has_vector_text) AS vectors, sum(CASE WHEN s THEN text_ops ELSE 0 END) AS ops
  FROM (SELECT *, {SAMPLE_SQL} AS s FROM ({DOC_SQL})) GROUP BY doc_id)"""
ROUTED_SQL = f"""SELECT e.doc_id, e.page, CASE WHEN NOT (s OR pdf_type = 'mixed' OR identity_h_no_tounicode OR only_type3) THEN 'scanned'
 WHEN identity_h_no_tounicode OR only_type3 OR has_vector_text THEN concat_ws(',', CASE WHEN identity_h_no_tounicode OR only_type3 THEN 'suspected_garbled_text' END, CASE WHEN has_vector_text THEN 'vector_text' END)
 WHEN NOT (text_ops > 0 AND unique_chars > 0) AND NOT has_images AND NOT has_template_image THEN 'no_text' ELSE 'scanned' END AS reasons
 FROM (SELECT *, {SAMPLE_SQL} AS s FROM ({DOC_SQL})) e JOIN ({CLASS_SQL}) c USING (doc_id)
 WHERE pdf_type IN ('scanned', 'image_based') OR identity_h_no_tounicode OR only_type3 OR (pdf_type = 'mixed' AND ((has_template_image AND {SCAN_SQL}) OR has_vector_text OR (has_template_image AND text_ops < 10) OR (text_ops < 3 AND has_images)))"""


@query("sample_pages", f"SELECT doc_id, page FROM ({DOC_SQL}) WHERE {SAMPLE_SQL}", "lineitem")
def _sample(spark):
    return routing.with_sample(spark.sql(EVIDENCE)).where("sampled").select("doc_id", "page")


@query(
    "sample_early_exit",
    f"""SELECT doc_id, page FROM (SELECT *, min(CASE WHEN (text_ops < 3 OR {DOMINATED_SQL} OR unique_chars < 5) AND (has_images OR has_template_image) THEN page END) OVER (PARTITION BY doc_id) AS stop FROM ({EVIDENCE})) WHERE stop IS NULL OR page <= stop""",
    "lineitem",
)
def _early(spark):
    return routing.with_sample(spark.sql(EVIDENCE), "early_exit").where("sampled").select("doc_id", "page")


@query("classify_pdf", f"SELECT doc_id, page_count, pages_sampled, pages_with_text, pdf_type, round(confidence, 6) AS confidence FROM ({CLASS_SQL})", "lineitem")
def _classify(spark):
    return routing.classify(routing.with_sample(spark.sql(EVIDENCE))).select("doc_id", "page_count", "pages_sampled", "pages_with_text", "pdf_type", F.round("confidence", 6).alias("confidence"))


@query("routed_pages", ROUTED_SQL, "lineitem")
def _routed(spark):
    s = routing.with_sample(spark.sql(EVIDENCE))
    return routing.routed_pages(s, routing.classify(s)).select("doc_id", "page", F.array_join("reasons", ",").alias("reasons"))


GARBLED_PAGES = "SELECT l_partkey AS doc_id, CAST(1 + l_orderkey % 9 AS INT) AS page FROM lineitem WHERE l_orderkey % 19 = 0"


@query(
    "page_reasons",
    f"""WITH r AS (SELECT doc_id, page, unnest(string_split(reasons, ',')) AS reason FROM ({ROUTED_SQL}) UNION ALL SELECT doc_id, page, 'suspected_garbled_text' FROM ({GARBLED_PAGES}))
SELECT doc_id, page, string_agg(reason, ',' ORDER BY list_position(['suspected_garbled_text', 'vector_text', 'scanned', 'no_text'], reason)) AS reasons FROM (SELECT DISTINCT * FROM r) GROUP BY doc_id, page""",
    "lineitem",
)
def _reasons(spark):
    s = routing.with_sample(spark.sql(EVIDENCE))
    both = routing.merge_routes(routing.routed_pages(s, routing.classify(s)), spark.sql(GARBLED_PAGES))
    return both.select("doc_id", "page", F.array_join("reasons", ",").alias("reasons"))


@query(
    "strip_routed_anti",
    f"""SELECT doc_id, page, text_ops FROM ({EVIDENCE}) e WHERE NOT EXISTS (SELECT 1 FROM ({ROUTED_SQL}) r JOIN ({CLASS_SQL}) c USING (doc_id) WHERE pdf_type = 'text_based' AND r.doc_id = e.doc_id AND r.page = e.page)""",
    "lineitem",
)
def _strip(spark):
    e = spark.sql(EVIDENCE)
    s = routing.with_sample(e)
    c = routing.classify(s)
    return routing.erase_routed(e.select("doc_id", "page", "text_ops"), routing.routed_pages(s, c), c)


# --- OCR ------------------------------------------------------------------------

#: Line numbers repeat in an order, so that pages are counted anew.
NUMBERED = "(SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INT) AS page FROM lineitem)"
ASKED = f"SELECT CAST(l_orderkey % 4 AS INT) AS run_id, l_orderkey AS doc_id, l_orderkey AS ord, page FROM {NUMBERED}"
CAPPED_SQL = f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY run_id, doc_id ORDER BY page) AS nth FROM ({ASKED})),
w AS (SELECT run_id, ord, doc_id, least(max(nth), {{doc}}) AS asked FROM a GROUP BY ALL),
b AS (SELECT run_id, doc_id, least(asked, greatest(0, {{run}} - coalesce(sum(asked) OVER (PARTITION BY run_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS allowed FROM w)
SELECT run_id, doc_id, page, nth <= allowed AS billed FROM a JOIN b USING (run_id, doc_id)"""


@query("ocr_doc_cap", CAPPED_SQL.format(doc=3, run=10**9), "lineitem")
def _doc_cap(spark):
    return ocr.capped(spark.sql(ASKED), per_doc=3).select("run_id", "doc_id", "page", "billed")


@query("ocr_run_budget", CAPPED_SQL.format(doc=4, run=1000), "lineitem")
def _run_cap(spark):
    return ocr.capped(spark.sql(ASKED), per_doc=4, per_run=1000).select("run_id", "doc_id", "page", "billed")


@query(
    "ocr_cost_report",
    f"""SELECT run_id, doc_id, count_if(billed) AS pages_billed, round(count_if(billed) * 0.004::DOUBLE, 6) AS estimated_cost_usd, bool_or(NOT billed) AS truncated, coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (WHERE NOT billed), '') AS dropped FROM ({CAPPED_SQL.format(doc=4, run=1000)}) GROUP BY run_id, doc_id""",
    "lineitem",
)
def _cost(spark):
    report = ocr.cost_report(ocr.capped(spark.sql(ASKED), per_doc=4, per_run=1000), 0.004, "fake")
    return report.select("run_id", "doc_id", "pages_billed", F.round("estimated_cost_usd", 6).alias("estimated_cost_usd"), "truncated", F.array_join("dropped", ",").alias("dropped"))


@query(
    "ocr_cost_rollup",
    f"""SELECT run_id, count(DISTINCT doc_id) AS documents, count_if(billed) AS pages_billed, round(count_if(billed) * 0.004::DOUBLE, 6) AS usd FROM ({CAPPED_SQL.format(doc=4, run=1000)}) GROUP BY ROLLUP (run_id)""",
    "lineitem",
)
def _rollup(spark):
    c = ocr.capped(spark.sql(ASKED), per_doc=4, per_run=1000)
    return c.rollup("run_id").agg(F.count_distinct("doc_id").alias("documents"), F.count_if("billed").alias("pages_billed"), F.round(F.count_if("billed") * 0.004, 6).alias("usd"))


READ = f"""SELECT l_orderkey AS doc_id, page, CASE l_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'bad ' || '��' || ' text' ELSE 'read ' || CAST(l_partkey AS STRING) END AS markdown,
 CASE l_suppkey % 3 WHEN 0 THEN 0.3 WHEN 1 THEN 0.9 ELSE 0.0 END AS confidence FROM {NUMBERED} WHERE l_partkey % 7 > 0"""
OWN = f"SELECT l_orderkey AS doc_id, page, 'own ' || l_returnflag AS markdown FROM {NUMBERED}"
HEALTHY_SQL = "(NOT (confidence > 0 AND confidence < 0.5) AND trim(coalesce(o, '')) <> '' AND strpos(o, '�') = 0)"


@query("ocr_health", f"SELECT doc_id, page, {HEALTHY_SQL.replace('(o', '(markdown').replace('o,', 'markdown,')} AS healthy FROM ({READ.replace('STRING', 'VARCHAR')})".replace("coalesce(o", "coalesce(markdown"), "lineitem")
def _health(spark):
    return ocr.with_health(spark.sql(READ)).select("doc_id", "page", "healthy")


GARBLED_SQL = ORACLE["quality_garbled_pages"]
#: Documents as OCR results: whole texts, some broken in each of the ways that a page can be, one of them a cipher.
READ_DOCUMENTS = f"SELECT doc_id, page, text AS markdown, CASE doc_id % 7 WHEN 0 THEN 0.4 WHEN 1 THEN 0.0 WHEN 2 THEN 0.5 ELSE 0.9 END AS confidence FROM ({DAMAGED})"
HEALTHY_DOCUMENTS = f"SELECT r.doc_id, r.page, r.markdown, NOT (confidence > 0 AND confidence < 0.5) AND NOT regexp_full_match(r.markdown, '[{SQL_SPACE}]*') AND g.doc_id IS NULL AS healthy FROM ({READ_DOCUMENTS}) r LEFT JOIN ({GARBLED_SQL}) g USING (doc_id)"


@query("ocr_health_documents", f"SELECT doc_id, healthy FROM ({HEALTHY_DOCUMENTS})", "documents")
def _health_of_documents(spark):
    return ocr.with_health(spark.sql(READ_DOCUMENTS)).select("doc_id", "healthy")


@query(
    "ocr_fusion_documents",
    f"""SELECT d.doc_id, md5(CASE WHEN h.healthy THEN h.markdown ELSE d.text END) AS md, NOT h.healthy AS needs_review FROM documents d JOIN ({HEALTHY_DOCUMENTS}) h USING (doc_id) WHERE doc_id % 10 <> 3
UNION ALL SELECT doc_id, md5(text), doc_id % 20 = 3 FROM documents WHERE doc_id % 10 = 3""",
    "documents",
)
def _fuse_documents(spark):
    """Pages that are asked for, cut by a cap (3 of 20) or not asked for (13 of 20)."""
    own = spark.sql("SELECT doc_id, 1 AS page, text AS markdown FROM documents")
    billed = own.where("doc_id % 20 <> 13").select("doc_id", "page", (F.col("doc_id") % 10 != 3).alias("billed"))
    return ocr.fuse(own, spark.sql(READ_DOCUMENTS), billed).select("doc_id", F.md5("markdown").alias("md"), "needs_review")


@query(
    "ocr_fusion_left_join",
    f"""SELECT n.doc_id, n.page, CASE WHEN coalesce(billed, false) AND coalesce({HEALTHY_SQL}, false) THEN o ELSE n.markdown END AS markdown, coalesce(NOT billed, false) OR (coalesce(billed, false) AND NOT coalesce({HEALTHY_SQL}, false)) AS needs_review
FROM ({OWN}) n LEFT JOIN ({CAPPED_SQL.format(doc=3, run=10**9)}) b USING (doc_id, page) LEFT JOIN (SELECT doc_id, page, markdown AS o, confidence FROM ({READ.replace('STRING', 'VARCHAR')})) r USING (doc_id, page)""",
    "lineitem",
)
def _fuse(spark):
    return ocr.fuse(spark.sql(OWN), spark.sql(READ), ocr.capped(spark.sql(ASKED), per_doc=3)).drop("replaced")


@query(
    "ctc_greedy_decode",
    """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(abs(x) * 20) AS INTEGER) % 4) AS steps FROM embeddings)
SELECT vec_id, array_to_string(list_filter(list_transform(steps, lambda v, i: CASE WHEN v > 0 AND (i = 1 OR steps[i-1] <> v) THEN ['a', 'b', 'c'][v] END), lambda c: c IS NOT NULL), '') AS decoded FROM s""",
    "embeddings",
)
def _ctc(spark):
    steps = F.transform("embedding", lambda x: (F.floor(F.abs(x) * 20) % 4).cast("int"))
    return spark.table("embeddings").select("vec_id", ocr.ctc_decode(steps, ["a", "b", "c"]).alias("decoded"))


CATALOG = "SELECT p_partkey AS ord, p_name AS model_id, concat(p_brand, ',', p_type) AS langs FROM part"


@query(
    "model_select_rank",
    f"""WITH c AS (SELECT ord, model_id, unnest(string_split(langs, ',')) AS language FROM ({CATALOG}))
SELECT w.language, model_id FROM (SELECT DISTINCT p_brand AS language FROM part UNION ALL SELECT 'none') w LEFT JOIN (SELECT language, arg_min(model_id, ord) AS model_id FROM c GROUP BY language) USING (language)""",
    "part",
)
def _models(spark):
    catalog = spark.sql(CATALOG).withColumn("languages", F.split("langs", ","))
    return ocr.select_models(catalog, spark.sql("SELECT DISTINCT p_brand AS language FROM part UNION ALL SELECT 'none'"))


# --- tables ---------------------------------------------------------------------

CELLS = """SELECT o_custkey AS table_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS r, o_orderkey, o_totalprice, o_orderpriority FROM orders"""
LONG_CELLS = f"""SELECT table_id, r, 0 AS c, CASE WHEN r = 0 AND table_id % 3 > 0 THEN 'Order' ELSE CAST(o_orderkey AS STRING) END AS text FROM ({CELLS})
UNION ALL SELECT table_id, r, 1 AS c, CASE WHEN r = 0 AND table_id % 5 > 0 THEN 'Priority' ELSE o_orderpriority END FROM ({CELLS})
UNION ALL SELECT table_id, r, 2 AS c, CASE WHEN r = 0 AND table_id % 3 > 0 THEN CASE WHEN table_id % 7 = 0 THEN 'order' ELSE 'Total' END ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END FROM ({CELLS})
UNION ALL SELECT table_id, r, 3 AS c, 'x|y' FROM ({CELLS}) WHERE r % 4 > 0 AND table_id % 2 = 0"""
_long = LONG_CELLS.replace("STRING", "VARCHAR")


@query("modal_width", f"SELECT table_id, arg_max(width, (n * 1000 + width)) AS width FROM (SELECT table_id, width, count(*) AS n FROM (SELECT table_id, r, count(*) AS width FROM ({_long}) GROUP BY ALL) GROUP BY ALL) GROUP BY table_id", "orders")
def _modal(spark):
    return tables.modal_width(spark.sql(LONG_CELLS).groupBy("table_id", "r").agg(F.count("*").alias("width")))


@query(
    "pipe_table_render",
    rf"""WITH l AS (SELECT table_id, r, count(*) AS n, '| ' || string_agg(replace(text, '|', '\|'), ' | ' ORDER BY c) || ' |' AS line FROM ({_long}) GROUP BY ALL)
SELECT table_id, md5(string_agg(CASE WHEN r = 0 THEN line || chr(10) || '|' || repeat(' --- |', m::INTEGER) ELSE line END, chr(10) ORDER BY r)) AS markdown FROM (SELECT *, max(n) OVER (PARTITION BY table_id) AS m FROM l) GROUP BY table_id""",
    "orders",
)
def _pipes(spark):
    return tables.pipe_tables(spark.sql(LONG_CELLS)).select("table_id", F.md5("markdown").alias("markdown"))


TYPED = f"SELECT * FROM ({LONG_CELLS}) WHERE c < 3"


@query(
    "header_row_detect",
    # column 0 and 2 are whole numbers below the head, column 1 is text: the head is a header where its labels are text, differ and don't stand below
    f"""WITH t AS (SELECT * FROM ({_long}) WHERE c < 3),
h AS (SELECT table_id, max(CASE WHEN c = 0 THEN text END) AS a, max(CASE WHEN c = 1 THEN text END) AS b, max(CASE WHEN c = 2 THEN text END) AS d FROM t WHERE r = 0 GROUP BY table_id),
s AS (SELECT table_id, max(r) AS last FROM t GROUP BY table_id),
rep AS (SELECT t.table_id, bool_or(lower(t.text) = lower(h.b)) AS rep FROM t JOIN h USING (table_id) WHERE r BETWEEN 1 AND 50 AND c = 1 GROUP BY 1)
SELECT table_id, CASE WHEN last < 1 OR lower(a) = lower(d) OR lower(a) = lower(b) OR lower(b) = lower(d) THEN 0
 WHEN (CASE WHEN a = 'Order' THEN 1 ELSE 0 END) + (CASE WHEN lower(d) IN ('order', 'total') THEN 1 ELSE 0 END) > (CASE WHEN a = 'Order' THEN 0 ELSE 1 END) + (CASE WHEN lower(d) IN ('order', 'total') THEN 0 ELSE 1 END) + (CASE WHEN rep THEN 1 ELSE 0 END) THEN 1 ELSE 0 END AS header_rows
FROM h JOIN s USING (table_id) LEFT JOIN rep USING (table_id)""",
    "orders",
)
def _header(spark):
    return tables.header_rows(spark.sql(TYPED))


@query(
    "numeric_token_spread",
    """WITH r AS (SELECT o_orderkey, o_custkey % 3 AS k, CAST(o_custkey AS VARCHAR) || ' ' || CAST(o_orderkey AS VARCHAR) AS two FROM orders)
SELECT o_orderkey, CASE WHEN k = 0 THEN concat_ws('|', 'a', split_part(two, ' ', 1), split_part(two, ' ', 2), '') WHEN k = 1 THEN concat_ws('|', 'a', two, 'b', '') ELSE concat_ws('|', two || ' x', '', '', '$5') END AS cells FROM r""",
    "orders",
)
def _spread(spark):
    r = spark.sql("""SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN array('a', two, '', '') WHEN 1 THEN array('a', two, 'b', '') ELSE array(two || ' x', '', '', '$5') END AS row FROM (SELECT *, CAST(o_custkey AS STRING) || ' ' || CAST(o_orderkey AS STRING) AS two FROM orders)""")
    return r.select("o_orderkey", F.array_join(tables.spread_numbers(F.col("row")), "|").alias("cells"))


ITEMS = f"SELECT l_orderkey AS doc_id, 1 AS page, page AS ord, CAST(l_partkey % 400 AS DOUBLE) AS x, CAST(l_suppkey % 300 AS DOUBLE) AS y, 10.0D AS width, 8.0D AS height, l_returnflag AS text FROM {NUMBERED}"
GRID = "SELECT o_orderkey AS doc_id, 1 AS page, 0 AS table_id, CAST(i AS INT) AS r, CAST(j AS INT) AS c, j * 100.0D AS x0, i * 100.0D AS y0, (j + 1) * 100.0D AS x1, (i + 1) * 100.0D AS y1 FROM orders"


@query(
    "rect_item_range_join",
    f"""WITH g AS (SELECT o_orderkey AS doc_id, i AS r, j AS c FROM orders, range(3) a(i), range(4) b(j)), it AS ({ITEMS.replace('10.0D', '10.0').replace('8.0D', '8.0')})
SELECT it.doc_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, string_agg(text, ' ' ORDER BY ord) AS text FROM it JOIN g ON it.doc_id = g.doc_id AND x + width / 2 >= c * 100 AND x + width / 2 < (c + 1) * 100 AND y + height / 2 >= r * 100 AND y + height / 2 < (r + 1) * 100 GROUP BY ALL""",
    "lineitem", "orders",
)
def _cells(spark):
    grid = spark.sql(GRID.replace("FROM orders", "FROM orders LATERAL VIEW explode(sequence(0, 2)) AS i LATERAL VIEW explode(sequence(0, 3)) AS j"))
    return tables.cells_of_items(spark.sql(ITEMS), grid).select("doc_id", "r", "c", "text")


SHEET = "SELECT o_custkey AS sheet, CAST(o_orderkey % 11 AS INT) AS r, CAST(o_orderkey % 7 AS INT) AS c, max(o_orderpriority) AS text FROM orders GROUP BY 1, 2, 3"
HIDDEN = "SELECT c_custkey AS sheet, 'row' AS axis, CAST(c_custkey % 11 AS INT) AS n FROM customer UNION ALL SELECT c_custkey, 'col', CAST(c_custkey % 7 AS INT) FROM customer"


@query(
    "hidden_row_anti",
    f"""WITH s AS ({SHEET}), h AS ({HIDDEN}), v AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.sheet = s.sheet AND ((axis = 'row' AND n = r) OR (axis = 'col' AND n = c)))),
rr AS (SELECT sheet, i, row_number() OVER (PARTITION BY sheet ORDER BY i) - 1 AS k FROM (SELECT sheet, unnest(generate_series(min(r), max(r))) AS i FROM v GROUP BY sheet) x WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.sheet = x.sheet AND axis = 'row' AND n = i)),
cc AS (SELECT sheet, i, row_number() OVER (PARTITION BY sheet ORDER BY i) - 1 AS k FROM (SELECT sheet, unnest(generate_series(min(c), max(c))) AS i FROM v GROUP BY sheet) x WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.sheet = x.sheet AND axis = 'col' AND n = i))
SELECT rr.sheet, CAST(rr.k AS INTEGER) AS "row", CAST(cc.k AS INTEGER) AS col, coalesce(text, '') AS text FROM rr JOIN cc USING (sheet) LEFT JOIN v ON v.sheet = rr.sheet AND v.r = rr.i AND v.c = cc.i""",
    "orders", "customer",
)
def _hidden(spark):
    return tables.used_range(spark.sql(SHEET), spark.sql(HIDDEN)).select("sheet", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "text")


# --- layout ---------------------------------------------------------------------

BASE_SQL = f"SELECT doc_id, coalesce(arg_max(k, n * 100000 + k) FILTER (WHERE k IS NOT NULL) / 10, 12.0) AS base FROM (SELECT doc_id, CASE WHEN font_size >= 9 THEN CAST(round(font_size * 10) AS INTEGER) END AS k, count(*) AS n FROM ({LINES}) GROUP BY ALL) GROUP BY doc_id"


@query("base_font_mode", BASE_SQL, "orders")
def _base(spark):
    return layout.base_sizes(spark.sql(LINES))


@query(
    "heading_tiers",
    f"""SELECT b.doc_id, coalesce(string_agg(DISTINCT font_size::DOUBLE::VARCHAR, ',' ORDER BY font_size::DOUBLE::VARCHAR DESC), '') AS tiers FROM ({BASE_SQL}) b LEFT JOIN ({LINES}) l ON l.doc_id = b.doc_id AND font_size / base >= 1.2 AND regexp_matches(text, '\\p{{L}}') GROUP BY b.doc_id""",
    "orders",
)
def _tiers(spark):
    lines = spark.sql(LINES).withColumn("font_size", F.col("font_size").cast("double"))
    return layout.heading_tiers(lines, layout.base_sizes(lines)).select("doc_id", F.array_join(F.transform("tiers", lambda x: x.cast("string")), ",").alias("tiers"))


THRESHOLD_SQL = f"""SELECT b.doc_id, CASE WHEN coalesce(len(g), 0) < 5 THEN base * 1.8 ELSE greatest(g[len(g) // 2 + 1] * 1.3, base * 1.5) END AS threshold FROM ({BASE_SQL}) b LEFT JOIN
 (SELECT doc_id, list_sort(list(gap)) AS g FROM (SELECT doc_id, lag(y) OVER (PARTITION BY doc_id, page ORDER BY ord) - y AS gap FROM ({LINES})) JOIN ({BASE_SQL}) USING (doc_id) WHERE gap > 0 AND gap < base * 10 GROUP BY doc_id) USING (doc_id)"""


@query("paragraph_threshold", f"SELECT doc_id, round(threshold, 6) AS threshold FROM ({THRESHOLD_SQL})", "orders")
def _gaps(spark):
    lines = spark.sql(LINES)
    return layout.paragraph_gaps(lines, layout.base_sizes(lines)).select("doc_id", F.round("threshold", 6).alias("threshold"))


@query(
    "paragraph_islands",
    f"""WITH m AS (SELECT doc_id, page, ord, text, CASE WHEN gap > 0 AND gap <= threshold THEN 0 ELSE 1 END AS new FROM (SELECT *, lag(y) OVER (PARTITION BY doc_id, page ORDER BY ord) - y AS gap FROM ({LINES})) JOIN ({THRESHOLD_SQL}) USING (doc_id)),
p AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY ord ROWS UNBOUNDED PRECEDING) AS paragraph FROM m)
SELECT doc_id, page, CAST(paragraph AS BIGINT) AS paragraph, string_agg(text, ' ' ORDER BY ord) AS text FROM p GROUP BY ALL""",
    "orders",
)
def _paragraphs(spark):
    lines = spark.sql(LINES)
    return layout.paragraphs(lines, layout.paragraph_gaps(lines, layout.base_sizes(lines)))


@query(
    "furniture_having",
    f"""WITH l AS (SELECT *, min(ord) OVER w AS a, max(ord) OVER w AS z FROM ({LINES}) WINDOW w AS (PARTITION BY doc_id, page)),
e AS (SELECT doc_id, page, text, 'top' AS edge FROM l WHERE ord = a UNION ALL SELECT doc_id, page, text, 'bottom' FROM l WHERE ord = z)
SELECT doc_id, text, edge FROM e JOIN (SELECT doc_id, count(DISTINCT page) AS pages FROM l GROUP BY 1) USING (doc_id) GROUP BY doc_id, text, edge, pages HAVING count(DISTINCT page) >= 2 AND count(DISTINCT page) * 2 >= pages""",
    "orders",
)
def _furniture(spark):
    return layout.furniture(spark.sql(LINES))


SPREAD_ITEMS = "SELECT l_suppkey AS doc_id, CAST(l_orderkey % 40 AS INT) AS page, l_orderkey * 10 + l_linenumber AS ord, CAST(l_partkey % 600 AS DOUBLE) AS x, CAST(30 AS DOUBLE) AS width, CAST(l_partkey % 5 AS DOUBLE) * 0 AS rotation FROM lineitem"


@query(
    "column_gaps",
    f"""SELECT DISTINCT doc_id, page FROM (SELECT *, lag(x) OVER (PARTITION BY doc_id, page ORDER BY x) AS b, count(*) OVER w AS n, min(x) OVER w AS lo, max(x + width) OVER w AS hi FROM ({SPREAD_ITEMS}) WINDOW w AS (PARTITION BY doc_id, page))
WHERE n >= 6 AND x - b > 40 AND (b + x) / 2 > lo + (hi - lo) * 0.2 AND (b + x) / 2 < lo + (hi - lo) * 0.85""",
    "lineitem",
)
def _columns(spark):
    return layout.pages_with_columns(spark.sql(SPREAD_ITEMS))


RULED_ITEMS = f"SELECT l_orderkey AS doc_id, 1 AS page, page AS ord, CAST(l_partkey % 50 AS DOUBLE) AS x, CAST(l_suppkey % 40 AS DOUBLE) AS y, CAST(20 AS DOUBLE) AS width, CAST(10 AS DOUBLE) AS font_size FROM {NUMBERED}"
RULES = "SELECT l_orderkey AS doc_id, 1 AS page, CAST(l_partkey % 50 AS DOUBLE) AS x, CAST((l_suppkey + l_linenumber) % 40 AS DOUBLE) AS y, CAST(18 + l_linenumber % 2 AS DOUBLE) AS width, CAST(1 AS DOUBLE) AS height FROM lineitem"


@query(
    "rule_underline_range_join",
    f"""WITH r AS (SELECT *, round(x) AS sx, round(width) AS sw FROM ({RULES})), lone AS (SELECT * FROM r JOIN (SELECT doc_id, page, sx, sw FROM r GROUP BY ALL HAVING count(DISTINCT y) < 3) USING (doc_id, page, sx, sw)),
j AS (SELECT i.doc_id, i.page, i.ord, (r.y <= i.y + 0.05 * font_size AND r.y >= i.y - 0.35 * font_size) AS u, (r.y > i.y + 0.15 * font_size AND r.y < i.y + 0.6 * font_size) AS s FROM ({RULED_ITEMS}) i JOIN lone r ON r.doc_id = i.doc_id AND r.page = i.page AND least(i.x + i.width, r.x + r.width) - greatest(i.x, r.x) >= 0.6 * i.width)
SELECT doc_id, page, ord, bool_or(u) AS underlined, bool_or(s) AS struck FROM j WHERE u OR s GROUP BY ALL""",
    "lineitem",
)
def _rules(spark):
    return layout.decorated(spark.sql(RULED_ITEMS), spark.sql(RULES))


NOTE_REFS = "SELECT conv_id AS doc_id, 'n' || CAST(length(text) % 9 AS STRING) AS note_id, turn AS ord FROM conversations"
NOTES = "SELECT conv_id AS doc_id, 'n' || CAST(i AS STRING) AS note_id, i AS ord FROM (SELECT DISTINCT conv_id FROM conversations) c"


@query(
    "note_numbering",
    f"""WITH refs AS ({NOTE_REFS.replace('STRING', 'VARCHAR')}), notes AS (SELECT conv_id AS doc_id, 'n' || CAST(i AS VARCHAR) AS note_id, i AS ord FROM (SELECT DISTINCT conv_id FROM conversations), range(9) r(i)),
f AS (SELECT doc_id, note_id, min(ord) AS first_at FROM refs GROUP BY ALL)
SELECT doc_id, note_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_at NULLS LAST, ord) AS INTEGER) AS number FROM notes LEFT JOIN f USING (doc_id, note_id)""",
    "conversations",
)
def _notes(spark):
    return layout.note_numbers(spark.sql(NOTE_REFS), spark.sql(NOTES + " LATERAL VIEW explode(sequence(0, 8)) AS i"))


# --- measures -------------------------------------------------------------------

MARKDOWN = """SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN '# ' || text WHEN 1 THEN '- ' || text WHEN 2 THEN '| ' || replace(text, chr(10), ' ') || ' |' || chr(10) || '| --- |' WHEN 3 THEN '```' || chr(10) || '# ' || text || chr(10) || '```' WHEN 4 THEN '[^1]: see [a](http://x) and ![b](y) ' || text ELSE text END AS md FROM conversations"""
FLAGS_SQL = r"""SELECT conv_id, turn, i, line, f, (sum(f) OVER (PARTITION BY conv_id, turn ORDER BY i)) % 2 = 0 AND f = 0 AS live FROM (SELECT *, CASE WHEN regexp_matches(line, '^[ \t]*(```|~~~)') THEN 1 ELSE 0 END AS f FROM (SELECT conv_id, turn, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS i FROM ({md})))"""
_h, _r, _u, _i = r"regexp_matches(line, '^#{1,6}[ \t]+[^ \t]')", r"regexp_matches(line, '^[ \t]*\|.*\|[ \t]*$')", r"regexp_matches(line, '^[ \t]*\|([ \t]*:?-+:?[ \t]*\|)+[ \t]*$')", r"regexp_matches(line, '^[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]+[^ \t]')"


@query(
    "structural_counts",
    f"""SELECT conv_id, turn, CAST(count_if(live AND {_h}) AS INTEGER) AS headings, CAST(count_if(live AND NOT {_h} AND {_r} AND NOT {_u}) AS INTEGER) AS table_rows, CAST(count_if(live AND NOT {_h} AND NOT {_r} AND {_i}) AS INTEGER) AS list_items,
 CAST(coalesce(sum(CASE WHEN live THEN len(regexp_extract_all(line, '(?:^|[^!])\\[[^\\]^][^\\]]*\\]\\([^) \\t]+(?:[ \\t]+"[^"]*")?\\)')) END), 0) AS INTEGER) AS links, CAST(count_if(live AND regexp_matches(line, '^\\[\\^[^\\]]+\\]:')) AS INTEGER) AS footnotes FROM ({FLAGS_SQL.replace('{md}', MARKDOWN)}) GROUP BY conv_id, turn""",
    "conversations",
)
def _structure(spark):
    docs = spark.sql(MARKDOWN).withColumn("id", F.struct("conv_id", "turn"))
    return metrics.structural_counts(docs, "id", "md").select("id.conv_id", "id.turn", "headings", "table_rows", "list_items", "links", "footnotes")


WORDS_SQL = r"regexp_extract_all(lower({t}), '[\p{L}\p{N}_]+')"
GRAMS_SQL = "SELECT doc_id, gram, count(*) AS n FROM (SELECT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+2], ' ') END AS gram FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM (SELECT doc_id, {w} AS w FROM {src}) WHERE len(w) > 0)) GROUP BY ALL"
EDITED = "SELECT doc_id, replace(replace(text, ' the ', ' '), 'on ', 'no ') AS text FROM documents"


@query("word_trigrams", f"SELECT doc_id, count(*) AS distinct_grams, CAST(sum(n) AS BIGINT) AS grams, max(n) AS most FROM ({GRAMS_SQL.format(w=WORDS_SQL.replace('{t}', 'text'), src='documents')}) GROUP BY doc_id", "documents")
def _trigrams(spark):
    return metrics.trigrams(spark.table("documents")).groupBy("doc_id").agg(F.count("*").alias("distinct_grams"), F.sum("n").alias("grams"), F.max("n").alias("most"))


@query(
    "trigram_containment",
    f"""WITH a AS ({GRAMS_SQL.format(w=WORDS_SQL.replace('{t}', 'text'), src='documents')}), b AS ({GRAMS_SQL.format(w=WORDS_SQL.replace('{t}', 'text'), src=f'({EDITED})')})
SELECT doc_id, CAST(sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) AS BIGINT) AS shared, CAST(sum(coalesce(a.n, 0)) AS BIGINT) AS ours_total, CAST(sum(coalesce(b.n, 0)) AS BIGINT) AS theirs_total FROM a FULL JOIN b USING (doc_id, gram) GROUP BY doc_id""",
    "documents",
)
def _containment(spark):
    return metrics.containment(metrics.trigrams(spark.table("documents")), metrics.trigrams(spark.sql(EDITED)))


@query(
    "word_f1",
    f"""WITH d AS (SELECT doc_id, text, replace(replace(text, ' the ', ' '), 'on ', 'no ') AS e FROM documents),
a AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest({WORDS_SQL.replace('{t}', 'e')}) AS w FROM d) GROUP BY ALL), b AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest({WORDS_SQL.replace('{t}', 'text')}) AS w FROM d) GROUP BY ALL),
s AS (SELECT doc_id, sum(least(coalesce(a.n, 0), coalesce(b.n, 0))) AS x, sum(coalesce(a.n, 0)) AS p, sum(coalesce(b.n, 0)) AS r FROM a FULL JOIN b USING (doc_id, w) GROUP BY doc_id)
SELECT doc_id, round(coalesce(2 * x / (p + r), 1.0), 9) AS f1 FROM d LEFT JOIN s USING (doc_id)""",
    "documents",
)
def _f1(spark):
    pairs = spark.sql("SELECT doc_id, text AS reference, replace(replace(text, ' the ', ' '), 'on ', 'no ') AS predicted FROM documents")
    return metrics.word_f1(pairs).select("doc_id", F.round("f1", 9).alias("f1"))


RUNS = "SELECT event_type AS format, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS engine, user_id AS doc_id, user_id * 1000 AS bytes, CAST(event_id % 5 AS INT) AS round, CAST(event_id % 97 + 1 AS DOUBLE) / 100 AS seconds FROM events"


@query(
    "speed_median",
    f"SELECT format, engine, count(*) AS documents, round(median(s) * 1000, 6) AS median_ms, round(sum(bytes) / 1e6 / sum(s), 6) AS mb_per_s FROM (SELECT format, engine, doc_id, median(seconds) AS s, max(bytes) AS bytes FROM ({RUNS}) GROUP BY ALL) GROUP BY ALL",
    "events",
)
def _speed(spark):
    return metrics.speed(spark.sql(RUNS)).select("format", "engine", "documents", F.round("median_ms", 6).alias("median_ms"), F.round("mb_per_s", 6).alias("mb_per_s"))


@query("alternating_rounds", f"SELECT engine, round(median(seconds), 9) AS median_s, count(*) AS rounds FROM ({RUNS}) WHERE round >= 1 GROUP BY engine", "events")
def _rounds(spark):
    return metrics.timed_rounds(spark.sql(RUNS)).select("engine", F.round("median_s", 9).alias("median_s"), "rounds")


SCORES = "SELECT o_orderkey AS doc_id, CAST(o_orderkey % 89 AS DOUBLE) / 100 AS baseline, CAST(o_orderkey % 83 AS DOUBLE) / 100 AS candidate FROM orders"


@query(
    "evaluation_compare",
    f"""SELECT *, concat_ws(',', CASE WHEN mean_delta < 0 THEN 'mean' END, CASE WHEN worst_delta < -0.02 THEN 'regression' END) AS failures FROM (SELECT count(*) AS shared, count_if(d > 1e-9) AS improved, count_if(d < -1e-9) AS regressed, count_if(abs(d) <= 1e-9) AS unchanged, arg_min(doc_id, (d, doc_id)) AS worst_document, round(min(d), 9) AS worst_delta, round(avg(d), 9) AS mean_delta FROM (SELECT doc_id, candidate - baseline AS d FROM ({SCORES})))""",
    "orders",
)
def _compare(spark):
    c = metrics.gate_failures(metrics.compare(spark.sql(SCORES)))
    return c.select("shared", "improved", "regressed", "unchanged", "worst_document", F.round("worst_delta", 9).alias("worst_delta"), F.round("mean_delta", 9).alias("mean_delta"), F.array_join("failures", ",").alias("failures"))


BENCHED = "SELECT c_mktsegment AS grp, c_custkey % 9 AS pages, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 3 ELSE 0 END AS routed, c_custkey % 29 = 0 AS failed FROM customer"


@query(
    "ocr_routing_rollup",
    f"""SELECT grp, count_if(NOT failed) AS documents, count_if(failed) AS n_failed, count_if(NOT failed AND routed > 0) AS documents_routed, CAST(coalesce(sum(pages) FILTER (WHERE NOT failed), 0) AS BIGINT) AS n_pages, CAST(coalesce(sum(routed) FILTER (WHERE NOT failed), 0) AS BIGINT) AS routed_pages,
 round(CASE WHEN sum(pages) FILTER (WHERE NOT failed) > 0 THEN 100.0 * sum(routed) FILTER (WHERE NOT failed) / sum(pages) FILTER (WHERE NOT failed) ELSE 0 END, 6) AS routing_pct FROM ({BENCHED}) GROUP BY ROLLUP (grp)""",
    "customer",
)
def _routing_rollup(spark):
    return metrics.routing_summary(spark.sql(BENCHED)).withColumn("routing_pct", F.round("routing_pct", 6))


@query(
    "live_plan_first_fit",
    """WITH RECURSIVE r AS (SELECT o_custkey AS plan, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderkey AS ord, o_orderkey % 13 + 1 AS need FROM orders),
f AS (SELECT plan, i, ord, need, need <= 25 AS taken, 25 - CASE WHEN need <= 25 THEN need ELSE 0 END AS left_ FROM r WHERE i = 1
 UNION ALL SELECT r.plan, r.i, r.ord, r.need, r.need <= f.left_, f.left_ - CASE WHEN r.need <= f.left_ THEN r.need ELSE 0 END FROM f JOIN r ON r.plan = f.plan AND r.i = f.i + 1)
SELECT plan, ord, need, taken FROM f""",
    "orders",
)
def _first_fit(spark):
    return metrics.first_fit(spark.sql("SELECT o_custkey AS plan, o_orderkey AS ord, o_orderkey % 13 + 1 AS need FROM orders"), 25)


LOCAL = """SELECT o_orderpriority AS model, CASE WHEN o_custkey % 2 = 0 THEN 'go' ELSE 'onnx' END AS backend, o_orderkey AS ord, o_orderkey % 23 + 1 AS pages, o_orderkey % 23 + 1 - CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS billed,
 CAST(o_orderkey % 50 + 1 AS DOUBLE) AS seconds, CAST(o_orderkey % 17 AS DOUBLE) / 16 AS f1, CASE WHEN o_orderkey % 19 = 0 THEN 'failed' END AS error FROM orders"""


@query(
    "local_run_accounting",
    f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY model, backend ORDER BY ord) AS i FROM ({LOCAL})),
f AS (SELECT model, backend, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS pages, CAST(0 AS BIGINT) AS documents, 0.0::DOUBLE AS seconds, 0.0::DOUBLE AS f1, CAST(0 AS BIGINT) AS errors FROM r GROUP BY ALL
 UNION ALL SELECT f.model, f.backend, r.i, f.pages + CASE WHEN f.pages + r.pages <= 2000 AND r.error IS NULL THEN r.billed ELSE 0 END, f.documents + CASE WHEN f.pages + r.pages <= 2000 AND r.error IS NULL THEN 1 ELSE 0 END,
  f.seconds + CASE WHEN f.pages + r.pages <= 2000 AND r.error IS NULL THEN r.seconds ELSE 0 END, f.f1 + CASE WHEN f.pages + r.pages <= 2000 AND r.error IS NULL THEN r.f1 ELSE 0 END, f.errors + CASE WHEN f.pages + r.pages <= 2000 AND r.error IS NOT NULL THEN 1 ELSE 0 END
 FROM f JOIN r ON r.model = f.model AND r.backend = f.backend AND r.i = f.i + 1)
SELECT model, backend, documents, pages, seconds, round(CASE WHEN seconds > 0 THEN pages / seconds ELSE 0 END, 9) AS pages_per_sec, round(CASE WHEN documents > 0 THEN f1 / documents END, 9) AS text_f1, errors FROM f QUALIFY row_number() OVER (PARTITION BY model, backend ORDER BY i DESC) = 1""",
    "orders",
)
def _local_runs(spark):
    out = metrics.local_runs(spark.sql(LOCAL), 2000)
    return out.withColumns({"pages_per_sec": F.round("pages_per_sec", 9), "text_f1": F.round("text_f1", 9)})


CONVERTED = """SELECT l_returnflag AS format, l_orderkey * 10 + l_linenumber AS doc_id, e.engine, CAST(l_quantity AS BIGINT) AS bytes,
 CASE WHEN l_partkey % 11 = 0 THEN 'failed' WHEN l_partkey % 13 = 0 AND e.engine = 'theirs' THEN 'missing' ELSE 'ok' END AS status,
 l_partkey % 5 AS headings, l_suppkey % 3 AS table_rows, l_partkey % 7 AS list_items, l_suppkey % 2 AS links, l_partkey % 2 AS footnotes, l_partkey % 40 AS shared, l_partkey % 40 + l_suppkey % 9 AS total
 FROM lineitem JOIN (SELECT 'ours' AS engine UNION ALL SELECT 'theirs') e ON true"""


@query(
    "format_summary",
    f"""SELECT format, engine, count(*) AS documents, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'missing') AS missing,
 CAST(sum(headings) AS BIGINT) AS headings, CAST(sum(table_rows) AS BIGINT) AS table_rows, CAST(sum(list_items) AS BIGINT) AS list_items, CAST(sum(links) AS BIGINT) AS links, CAST(sum(footnotes) AS BIGINT) AS footnotes,
 round(sum(shared) FILTER (WHERE status = 'ok') / sum(total) FILTER (WHERE status = 'ok'), 9) AS contained FROM ({CONVERTED}) GROUP BY ALL""",
    "lineitem",
)
def _format_summary(spark):
    rows = spark.sql(CONVERTED)
    out = metrics.format_summary(rows, rows.where("status = 'ok'").select("format", "engine", "doc_id", "shared", "total"))
    some = lambda k: F.coalesce(F.try_element_at("status", F.lit(k)), F.lit(0)).alias(k)
    return out.select("format", "engine", "documents", "bytes", some("ok"), some("failed"), some("missing"), "headings", "table_rows", "list_items", "links", "footnotes", F.round("contained", 9).alias("contained"))


QUALITY = "SELECT o_custkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'auto' ELSE 'force' END AS engine, CAST(o_orderkey % 91 AS DOUBLE) / 100 AS score FROM orders"


@query("quality_deltas", f"SELECT doc_id, round(a - f, 9) AS delta FROM (SELECT doc_id, max(score) FILTER (WHERE engine = 'auto') AS a, max(score) FILTER (WHERE engine = 'force') AS f FROM ({QUALITY}) GROUP BY 1) WHERE a IS NOT NULL AND f IS NOT NULL", "orders")
def _deltas(spark):
    return metrics.quality_delta(spark.sql(QUALITY)).select("doc_id", F.round("delta", 9).alias("delta"))
