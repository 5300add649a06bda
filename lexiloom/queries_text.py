"""Registered queries over documents: units, windows, sampling, preparation; and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import sampling as P
from lexiloom.operators import units as U

WORD = "the"
KEY = ["doc_id", "start"]
_WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


_TITLES = ("Mercury", "Mercury (disambiguation)", "a List of words", "plain", "DESAMBIGUACIÓN", "Anexo:x", "lista de", "Véase también", "category:x", "template:x")
_HEADS = ("", "Mercury may also refer to ", "", "x May Refer To y", "", "hace referencia a varios ", "puede referirse a ", "can refer to", "puede hacer referencia a", "", "see")
_HEADERS = ("See also", "REFERENCES", "External links", "Fuentes", "further reading", "Notes", "Bibliography", "Véase también", "Sources", "Referencias", "Enlaces externos", "Notas", "Bibliografía")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return U.corpus(spark.read.parquet(f"{sf}/documents.parquet"))


def seg(spark: SparkSession, sf: str, word: str = WORD, mode: str = "exact") -> DataFrame:
    return U.segments(docs(spark, sf), word, mode)


def _kwic(spark: SparkSession, sf: str, mode: str, size: int = 50) -> DataFrame:
    return U.concordance(docs(spark, sf), WORD, "exact", mode, size)


def _digest(df: DataFrame) -> DataFrame:
    """Long texts as lengths and MD5."""
    for c in ("left", "right"):
        df = df.withColumn(c, F.md5(F.col(c).cast("binary")))
    return df


def _occ(regex: str, name: str = "occ") -> str:
    """CTE of matches with offsets: doc_id, occ, start, end, text, body, source."""
    return rf"""{name}_l AS (SELECT doc_id, source, text AS body, regexp_extract_all(text, '{regex}') AS m, regexp_split_to_array(text, '{regex}') AS g FROM documents),
{name} AS (SELECT doc_id, source, body, (i - 1)::INTEGER AS occ, m[i] AS text,
  (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::INTEGER AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {name}_l))"""


_R = {"exact": r"(?i)\b{}\b", "variants": r"(?i)\b{}[a-záéíóúñ]{{0,3}}\b", "loose": r"(?i){}"}


def _seg_sql(word: str = WORD, mode: str = "exact") -> str:
    return "WITH " + _occ(_R[mode].format(word))


_SEG = _seg_sql()
_END = "start + length(text) AS \"end\""
#: start and end of each cut and of each stop of a body, one row a document
_CUTS = "WITH " + _occ(_R["exact"].format(WORD)) + ", " + _occ(r"[.!?]+\s+", "cut") + ", " + _occ(r"[.!?]+", "stop")
_KWIC = """, k AS (SELECT o.doc_id, occ, start, start + length(text) AS "end", text, body, source, {a} AS w_start, {b} AS w_end FROM occ o {join})
SELECT doc_id, occ, start, "end", md5(substr(body, w_start + 1, start - w_start)) AS left, text, md5(substr(body, "end" + 1, greatest(w_end - "end", 0))) AS right,
  w_start::INTEGER AS w_start, w_end::INTEGER AS w_end, source FROM k"""
_LISTS = "LEFT JOIN (SELECT doc_id, list(start + length(text)) AS e FROM cut GROUP BY doc_id) c USING (doc_id) LEFT JOIN (SELECT doc_id, list(start + length(text)) AS e FROM stop GROUP BY doc_id) s USING (doc_id)"


def _md5(seed: int, *key: str) -> str:
    return f"md5('{seed}|' || " + " || '|' || ".join(f"{k}::VARCHAR" for k in key) + ")"


_UNITS = "WITH occ AS (SELECT doc_id, source, lang, length(text) AS n FROM documents)"


def _thin(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", F.length("text").alias("n"))


def _two_stage(spark: SparkSession, sf: str) -> DataFrame:
    chosen = P.random(U.with_word(docs(spark, sf), WORD).select("doc_id"), 50, ["doc_id"], 0)
    occ = U.segments(docs(spark, sf).join(chosen, "doc_id"), WORD).drop("body")
    return _digest(U.kwic(P.random(P.cap_per_group(occ, 3, "doc_id", KEY, 0), 100, KEY, 0), "chars", 30, docs(spark, sf))).drop("w_start", "w_end")


_SPEC: dict[str, tuple] = {
    "docs_with_word": (lambda s, d: U.with_word(docs(s, d), WORD).select("doc_id", "source"), rf"SELECT doc_id, source FROM documents WHERE regexp_matches(text, '{_R['exact'].format(WORD)}')"),
    **{
        f"segments_{mode}": (lambda s, d, m=mode: seg(s, d, WORD, m).drop("body"), _seg_sql(WORD, mode) + f" SELECT doc_id, occ, start, {_END}, text, source FROM occ")
        for mode in T.MODES
    },
    "documents_as_units": (lambda s, d: U.whole(docs(s, d)).withColumn("text", F.md5(F.col("text").cast("binary"))), "SELECT doc_id, 0 AS start, length(text)::INTEGER AS \"end\", md5(text) AS text, source FROM documents"),
    "sentences": (
        lambda s, d: U.sentences(docs(s, d)),
        "WITH " + _occ(r"[.!?]+\s+", "cut") + r""", e AS (SELECT doc_id, start + length(text) AS e FROM cut UNION SELECT doc_id, length(text) FROM documents),
b AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY e), 0) AS a, e FROM e),
p AS (SELECT b.doc_id, a, substr(text, (a + 1)::BIGINT, (e - a)::BIGINT) AS t, source FROM b JOIN documents USING (doc_id)),
q AS (SELECT doc_id, source, a + length(t) - length(regexp_replace(t, '^\s+', '')) AS start, regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '') AS text FROM p)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INTEGER AS occ, start::INTEGER AS start, (start + length(text))::INTEGER AS "end", text, source FROM q WHERE text <> ''""",
    ),
    "kwic_chars": (lambda s, d: _digest(_kwic(s, d, "chars", 50)), _SEG + _KWIC.format(a="greatest(start - 50, 0)", b="least(start + length(text) + 50, length(body))", join="")),
    "kwic_words": (
        lambda s, d: _digest(_kwic(s, d, "words", 5)),
        _SEG + _KWIC.format(a=r"start - length(regexp_extract(substr(body, 1, start), '(?:\S+\s+){0,5}\S*\z'))", b=r"start + length(regexp_extract(substr(body, start + 1), '^\S+(?:\s+\S+){0,5}'))", join=""),
    ),
    "kwic_sentence": (
        lambda s, d: _digest(_kwic(s, d, "sentence")),
        _CUTS + _KWIC.format(a="coalesce(list_max(list_filter(c.e, lambda x: x <= start)), 0)", b="coalesce(list_min(list_filter(s.e, lambda x: x >= start + length(text))), length(body))", join=_LISTS),
    ),
    "kwic_paragraph": (
        lambda s, d: _digest(_kwic(s, d, "paragraph")),
        _SEG + ", " + _occ(r"\n\s*\n", "cut") + _KWIC.format(
            a="coalesce(list_max(list_filter(c.e, lambda x: x <= start)), 0)", b="coalesce(list_min(list_filter(c.s, lambda x: x >= start + length(text))), length(body))",
            join="LEFT JOIN (SELECT doc_id, list(start + length(text)) AS e, list(start) AS s FROM cut GROUP BY doc_id) c USING (doc_id)"),
    ),
    "kwic_lines": (
        lambda s, d: _kwic(s, d, "chars", 30).select("doc_id", "occ", T.kwic_line(F.col("left"), F.col("text"), F.col("right")).alias("line")),
        _SEG + " SELECT doc_id, occ, substr(replace(substr(body, greatest(start - 30, 0) + 1, start - greatest(start - 30, 0)) || '[' || text || ']' || substr(body, start + length(text) + 1, 30), chr(10), ' '), 1, 100) AS line FROM occ",
    ),
    "filter_source_prefix": (lambda s, d: docs(s, d).where(F.col("source").startswith("src1")).select("doc_id", "source"), "SELECT doc_id, source FROM documents WHERE starts_with(source, 'src1')"),
    "filter_expression": (lambda s, d: U.with_word(docs(s, d), "tion", "loose").select("doc_id"), "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)tion')"),
    "hits_threshold": (
        lambda s, d: docs(s, d).select("doc_id", U.hits(F.col("body"), ["the", "of"]).alias("hits")).where("hits >= 2"),
        r"SELECT doc_id, (len(regexp_extract_all(lower(text), '\bthe\b')) + len(regexp_extract_all(lower(text), '\bof\b')))::INTEGER AS hits FROM documents WHERE hits >= 2",
    ),
    "length_window": (lambda s, d: docs(s, d).where(F.length("body") >= 1000).select("doc_id", F.length(F.substring("body", 1, 15000)).alias("n")), "SELECT doc_id, least(length(text), 15000)::INTEGER AS n FROM documents WHERE length(text) >= 1000"),
    "junk_filter": (
        lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", U.is_junk(F.col("url"), F.col("html")).alias("junk")),
        r"SELECT page_id, regexp_matches(url, '(?i)(disambiguation|list of|desambiguación|anexo:|lista de|véase también)') OR regexp_matches(substr(html, 1, 400), '(?i)(may refer to|may also refer to|puede referirse a|hace referencia a varios)') AS junk FROM pages",
    ),
    "clean_body": (
        lambda s, d: docs(s, d).select("doc_id", F.md5(U.clean_body(F.concat("body", F.lit("\nReferences\nx"))).cast("binary")).alias("body")),
        r"SELECT doc_id, md5(regexp_replace(text, '\s+$', '')) AS body FROM documents",
    ),
    "validate_corpus": (lambda s, d: U.validate(docs(s, d)), "SELECT doc_id, 'missing' AS defect FROM documents WHERE text IS NULL OR doc_id IS NULL UNION ALL SELECT doc_id, 'repeated' FROM documents GROUP BY doc_id HAVING count(*) > 1"),
    "sample_random": (lambda s, d: P.random(_thin(s, d), 100, ["doc_id"], 7), _UNITS + f" SELECT doc_id, source, lang, n::INTEGER AS n FROM occ ORDER BY {_md5(7, 'doc_id')}, doc_id LIMIT 100"),
    "sample_reservoir": (lambda s, d: P.reservoir(seg(s, d).select("doc_id", "occ", "start"), 100, KEY, 3), _SEG + f" SELECT doc_id, occ, start FROM occ ORDER BY {_md5(3, 'doc_id', 'start')}, doc_id, start LIMIT 100"),
    "sample_stratified": (
        lambda s, d: P.stratified(_thin(s, d), 101, "lang", ["doc_id"], 5).select("doc_id", "lang"),
        _UNITS + f""", r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_md5(5, 'doc_id')}, doc_id) AS k,
floor(101 * count(*) OVER (PARTITION BY lang) / count(*) OVER ()) AS quota FROM occ),
c AS (SELECT doc_id, lang FROM r WHERE k <= quota),
x AS (SELECT doc_id, lang, row_number() OVER (ORDER BY {_md5(6, 'doc_id')}, doc_id) AS z FROM r WHERE k > quota)
SELECT doc_id, lang FROM c UNION ALL SELECT doc_id, lang FROM x WHERE z <= 101 - (SELECT count(*) FROM c)""",
    ),
    "cap_per_doc": (lambda s, d: P.cap_per_group(seg(s, d), 3, "doc_id", KEY, 1).select("doc_id", "occ", "start"), _SEG + f" SELECT doc_id, occ, start FROM occ QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {_md5(1, 'doc_id', 'start')}, start) <= 3"),
    "cap_spaced": (lambda s, d: P.cap_per_group_spaced(seg(s, d).select("doc_id", "occ", "start"), 3, "doc_id", ["start"], "start", 500, 1), None),
    "summary_per_group": (lambda s, d: P.summary(_thin(s, d), "source"), "SELECT source, count(*) AS n FROM documents GROUP BY source"),
    "n_articles": (lambda s, d: seg(s, d).agg(F.count(F.lit(1)).alias("n_units"), F.countDistinct("doc_id").alias("n_articles")), _SEG + " SELECT count(*) AS n_units, count(DISTINCT doc_id) AS n_articles FROM occ"),
    "one_stage_kwic": (
        lambda s, d: _digest(U.kwic(P.random(P.cap_per_group(seg(s, d).drop("body"), 2, "doc_id", KEY, 0), 60, KEY, 0), "chars", 30, docs(s, d))),
        _SEG.replace("occ AS (", "every AS (", 1) + f", occ AS (SELECT * FROM (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {_md5(0, 'doc_id', 'start')}, start) <= 2) ORDER BY {_md5(0, 'doc_id', 'start')}, doc_id, start LIMIT 60)"
        + _KWIC.format(a="greatest(start - 30, 0)", b="least(start + length(text) + 30, length(body))", join=""),
    ),
    "two_stage_kwic": (
        _two_stage,
        _SEG.replace("occ AS (", "every AS (", 1) + f""", stage1 AS (SELECT doc_id FROM documents WHERE regexp_matches(text, '{_R["exact"].format(WORD)}') ORDER BY {_md5(0, 'doc_id')}, doc_id LIMIT 50),
occ AS (SELECT * FROM (SELECT * FROM every SEMI JOIN stage1 USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {_md5(0, 'doc_id', 'start')}, start) <= 3) ORDER BY {_md5(0, 'doc_id', 'start')}, doc_id, start LIMIT 100)
SELECT doc_id, occ, start, {_END}, md5(substr(body, greatest(start - 30, 0) + 1, start - greatest(start - 30, 0))) AS left, text, md5(substr(body, start + length(text) + 1, 30)) AS right, source FROM occ""",
    ),
    "collapse_ws": (lambda s, d: docs(s, d).select("doc_id", F.md5(T.collapse_whitespace(F.col("body")).cast("binary")).alias("text")), rf"SELECT doc_id, md5(regexp_replace(text, '{_WS}+', ' ', 'g')) AS text FROM documents"),
    "lowercase": (lambda s, d: docs(s, d).select("doc_id", F.md5(F.lower("body").cast("binary")).alias("text")), "SELECT doc_id, md5(lower(text)) AS text FROM documents"),
    "nfc": (lambda s, d: docs(s, d).select("doc_id", F.md5(T.nfc(F.col("body")).cast("binary")).alias("text")), "SELECT doc_id, md5(nfc_normalize(text)) AS text FROM documents"),
    "strip_accents": (lambda s, d: docs(s, d).select("doc_id", F.md5(T.strip_accents(F.col("body")).cast("binary")).alias("text")), "SELECT doc_id, md5(strip_accents(text)) AS text FROM documents"),
    "casefold": (lambda s, d: docs(s, d).select("doc_id", F.md5(T.casefold(F.col("body")).cast("binary")).alias("text")), "SELECT doc_id, md5(replace(lower(text), 'ß', 'ss')) AS text FROM documents"),
    "slugs": (
        lambda s, d: docs(s, d).select("doc_id", F.md5(T.slugify(F.col("body")).cast("binary")).alias("slug")),
        r"SELECT doc_id, md5(CASE WHEN s = '' THEN 'term' ELSE s END) AS slug FROM (SELECT doc_id, regexp_replace(regexp_replace(lower(trim(text)), '[^\p{L}\p{N}_\s-]', '', 'g'), '[\s-]+', '_', 'g') AS s FROM documents)",
    ),
    "kwic_rows": (
        lambda s, d: _kwic(s, d, "chars", 60).select("doc_id", "occ", T.kwic_row(F.col("doc_id"), F.col("left"), F.col("text"), F.col("right"), 40).alias("line")),
        _SEG + """ SELECT doc_id, occ, rpad(substr(doc_id::VARCHAR, 1, 12), 12, ' ') || ' | ' || lpad(replace(substr(body, greatest(start - 40, 0) + 1, start - greatest(start - 40, 0)), chr(10), ' '), 40, ' ') || ' [' || text || '] '
 || replace(substr(body, start + length(text) + 1, 40), chr(10), ' ') AS line FROM occ""",
    ),
    "sample_by_expression": (
        lambda s, d: P.cap_per_group(_thin(s, d), 2, F.floor(F.col("n") / 1000), ["doc_id"], 4).select("doc_id"),
        f"SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY length(text) // 1000 ORDER BY {_md5(4, 'doc_id')}, doc_id) <= 2",
    ),
    "offset_remap": (
        lambda s, d: U.remapped(docs(s, d), WORD),
        _SEG + rf" SELECT doc_id, occ, length(regexp_replace(substr(body, 1, start), '{_WS}+', ' ', 'g'))::INTEGER AS start FROM occ",
    ),
    "top_words": (
        lambda s, d: docs(s, d).select(F.explode(F.split(F.lower("body"), r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(100),
        r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+')) AS word FROM documents) WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 100",
    ),
    "junk_pages": (
        lambda s, d: docs(s, d).select("doc_id", U.is_junk(F.concat(F.lit("x "), F.get(F.array(*map(F.lit, _TITLES)), (F.col("doc_id") % len(_TITLES)).cast("int"))), F.concat(F.get(F.array(*map(F.lit, _HEADS)), (F.col("doc_id") % len(_HEADS)).cast("int")), "body")).alias("junk")),
        "WITH t AS (SELECT doc_id, lower('x ' || ([" + ", ".join(f"'{x}'" for x in _TITLES) + f"])[doc_id % {len(_TITLES)} + 1]) AS title, lower(substr(([" + ", ".join(f"'{x}'" for x in _HEADS) + f"])[doc_id % {len(_HEADS)} + 1] || text, 1, 400)) AS head FROM documents)"
        """ SELECT doc_id, contains(title, 'disambiguation') OR contains(title, 'list of') OR contains(title, 'desambiguación') OR contains(title, 'anexo:') OR contains(title, 'lista de') OR contains(title, 'véase también')
 OR contains(head, 'may refer to') OR contains(head, 'may also refer to') OR contains(head, 'puede referirse a') OR contains(head, 'hace referencia a varios') AS junk FROM t""",
    ),
    "clean_appendix": (
        lambda s, d: docs(s, d).select("doc_id", F.md5(U.clean_body(F.concat("body", F.lit(" \n "), F.get(F.array(*map(F.lit, _HEADERS)), (F.col("doc_id") % len(_HEADERS)).cast("int")), F.lit(" \nx"))).cast("binary")).alias("body")),
        "WITH t AS (SELECT doc_id, text, ([" + ", ".join(f"'{x}'" for x in _HEADERS) + f"])[doc_id % {len(_HEADERS)} + 1] AS h FROM documents)"
        r""" SELECT doc_id, md5(CASE WHEN lower(h) IN ('see also', 'references', 'external links', 'further reading', 'notes', 'bibliography', 'véase también', 'referencias', 'enlaces externos', 'notas', 'bibliografía')
 THEN regexp_replace(text, '\s+$', '') ELSE text || ' ' || chr(10) || ' ' || h || ' ' || chr(10) || 'x' END) AS body FROM t""",
    ),
    "word_contexts": (
        lambda s, d: U.word_contexts(docs(s, d), WORD),
        r"""WITH s AS (SELECT doc_id, list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')) AS s FROM documents),
c AS (SELECT doc_id, list_transform(list_filter(s, lambda x: regexp_matches(lower(x), '\bthe\b') AND len(regexp_split_to_array(x, '\s+')) >= 5), lambda x: regexp_split_to_array(x, '\s+')) AS c FROM s),
x AS (SELECT doc_id, unnest(c) AS w, unnest(range(len(c))) AS ctx FROM c),
o AS (SELECT doc_id, w, ctx, list_filter(range(len(w)), lambda i: regexp_replace(lower(w[i + 1]), '[^\p{L}\p{N}_]', '', 'g') = 'the') AS p FROM x),
y AS (SELECT doc_id, w, ctx, unnest(p) AS position, unnest(range(len(p))) AS occ FROM o)
SELECT doc_id, format('ctx_{:03d}_occ_{:02d}', ctx, occ) AS key, position::INTEGER AS position,
  array_to_string(list_transform(w, lambda z, i: CASE WHEN i = position + 1 THEN '[TARGET]' || z || '[/TARGET]' ELSE z END), ' ') AS marked FROM y""",
    ),
    "word_contexts_limited": (
        lambda s, d: U.word_contexts(docs(s, d), WORD, 2).groupBy("doc_id").agg(F.count_distinct(F.substring("key", 1, 7)).alias("n")),
        r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM documents),
c AS (SELECT doc_id, list_filter(s, lambda x: regexp_matches(lower(x), '\bthe\b') AND len(regexp_split_to_array(trim(x, chr(10) || ' '), '\s+')) >= 5)[1:2] AS c FROM s),
w AS (SELECT doc_id, len(list_filter(c, lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda y: regexp_replace(lower(y), '[^\p{L}\p{N}_]', '', 'g') = 'the')) > 0)) AS n FROM c)
SELECT doc_id, n FROM w WHERE n > 0""",
    ),
    "merge_no_overwrite": (
        lambda s, d: (a := _thin(s, d).where("lang = 'en'")).unionByName(_thin(s, d).join(a, "doc_id", "left_anti")).select("doc_id", "lang"),
        "SELECT doc_id, lang FROM documents",
    ),
    "exclude": (lambda s, d: _thin(s, d).join(s.read.parquet(f"{d}/labels.parquet").where("toxic = 1").select("doc_id"), "doc_id", "left_anti").select("doc_id"), "SELECT doc_id FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) USING (doc_id)"),
    "add_reference": (
        lambda s, d: docs(s, d).select("doc_id", F.coalesce(F.try_element_at("meta", F.lit("title")), F.col("doc_id").cast("string")).alias("title"), F.try_element_at("meta", F.lit("source")).alias("source")),
        "SELECT doc_id, doc_id::VARCHAR AS title, source FROM documents",
    ),
}


def queries() -> dict:
    return {k: v[0] for k, v in _SPEC.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _SPEC.items() if v[1]}
