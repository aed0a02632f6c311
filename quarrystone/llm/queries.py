"""Queries over the driver's tables for the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions.frames import table
from quarrystone.llm import dedup, leak, mix, sentences, sight, split, terms

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split.cut_rows(table(spark, d, "records"), table(spark, d, "chunking_configs"))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_bodies(table(spark, d, "records"), table(spark, d, "chunking_configs"))


def p1_checks(spark: SparkSession, d: str) -> DataFrame:
    """For each body: the digest of its pieces put together without what they repeat, and whether all are within the
    limit of its collection."""
    records = table(spark, d, "records")
    got = split.split_bodies(records, table(spark, d, "chunking_configs"))
    new = F.expr("substring(text, overlap_chars + 1)")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", new.alias("t")))), lambda x: x["t"]), "")
    sizes = got.groupBy("row_no").agg(F.md5(whole).alias("body_md5"), F.max(F.octet_length("text")).alias("largest"))
    limit = records.select("row_no", "collection").join(split.limits(table(spark, d, "chunking_configs")), "collection", "left")
    joined = sizes.join(limit, "row_no")
    return joined.select("row_no", "body_md5", (F.col("largest") <= F.coalesce("max_bytes", F.lit(split.DEFAULT_MAX_BYTES))).alias("within"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.copies(table(spark, d, "records"))


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    return dedup.distinct_records(table(spark, d, "records"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_terms(table(spark, d, "records")).where("mark IS NOT NULL").select("field", "term", "mark")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_terms(table(spark, d, "records"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return sight.same_sight_pairs(table(spark, d, "records"), table(spark, d, "chunks"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return sight.same_sight_classes(table(spark, d, "records"), table(spark, d, "chunks"))


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    return sight.consistent_values(table(spark, d, "records"), table(spark, d, "chunks")).select("field", "key", "form")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaked_pairs(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    return leak.removal_spans(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each leaked item is in."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mix.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_margins(spark: SparkSession, d: str) -> DataFrame:
    return mix.margins(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """For each source with a target: whether it is wanted in the mixture, keeps its cap of repeats, and comes to its
    tokens, give or take a hundredth or its longest document."""
    got = mix.deviations(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    near = F.abs(F.col("tokens") - F.col("wanted_tokens")) <= F.greatest(F.col("wanted_tokens") * 0.01, F.col("longest"))
    return got.select("source", "max_repeats", (F.col("wanted_tokens") > 0).alias("used"), (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"), near.alias("near_share"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents")).select("doc_id", "start_char", "end_char")


def p9_units(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents"), with_text=True)


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p1_checks": p1_checks,
    "p2_found": p2_found,
    "p2_records": p2_records,
    "p4_found": p4_found,
    "p4_counts": p4_counts,
    "p5_found": p5_found,
    "p5_classes": p5_classes,
    "p5_forms": p5_forms,
    "p7_found": p7_found,
    "p7_spans": p7_spans,
    "p7_items": p7_items,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p8_margins": p8_margins,
    "p8_checks": p8_checks,
    "p9_found": p9_found,
    "p9_units": p9_units,
}

_FORMS = r"""
lines AS (
  SELECT row_no, title, body, list_filter(string_split(replace(coalesce(body, ''), chr(13), ''), chr(10)), lambda x: trim(x) <> '') AS ls,
    regexp_matches(coalesce(body, ''), '^\s*\{') AND regexp_matches(coalesce(body, ''), '\}\s*$') AND json_valid(body) AS is_json
  FROM records),
forms AS (
  SELECT row_no, regexp_replace(lower(coalesce(title, '')), '[^\p{L}\p{N}\p{M}]+', '', 'g') AS t,
    CASE
      WHEN is_json THEN 'F' || array_to_string(list_sort(list_distinct(list_transform(map_entries(CAST(CAST(body AS JSON) AS MAP(VARCHAR, VARCHAR))),
        lambda e: regexp_replace(lower(e.key), '[^\p{L}\p{N}\p{M}]+', '', 'g') || ':' || regexp_replace(lower(coalesce(e.value, '')), '[^\p{L}\p{N}\p{M}]+', '', 'g')))), '|')
      WHEN len(ls) >= 2 AND len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[\p{L}\p{N}\p{M}_-]+\s*:'))) = len(ls)
        THEN 'F' || array_to_string(list_sort(list_distinct(list_transform(ls,
        lambda x: regexp_replace(lower(regexp_extract(x, '^([^:]*):', 1)), '[^\p{L}\p{N}\p{M}]+', '', 'g') || ':' || regexp_replace(lower(regexp_extract(x, '(?s)^[^:]*:(.*)$', 1)), '[^\p{L}\p{N}\p{M}]+', '', 'g')))), '|')
      ELSE regexp_replace(lower(coalesce(body, '')), '[^\p{L}\p{N}\p{M}]+', '', 'g') END AS b
  FROM lines),
firsts AS (SELECT row_no, min(row_no) OVER (PARTITION BY t, b) AS first_row_no FROM forms)
"""

_TERMS = r"""
terms AS (
  SELECT 'tags' AS field, row_no, lower(trim(tag, chr(32) || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288))) AS term FROM (SELECT row_no, unnest(tags) AS tag FROM records)
  UNION ALL
  SELECT 'body', row_no, unnest(regexp_extract_all(lower(body), '[\p{L}\p{N}\p{M}]+')) FROM records),
counts AS (
  SELECT field, term, count(*) AS occurrences, count(DISTINCT row_no) AS records FROM terms WHERE term <> '' GROUP BY ALL),
marked AS (
  SELECT field, term, occurrences, records, CASE WHEN records < 3 THEN 'rare' WHEN records * 10 > (SELECT count(*) FROM records) THEN 'common' END AS mark FROM counts)
"""

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_BLANKS = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# Fixed values, on their own: the look-alike letters that the tables hold, each with the Latin one at the same place.
_CYRILLIC, _CYRILLIC_AS = "АВЕЁКМНОРСТУХаеёорсухѕіїј", "ABEËKMHOPCTYXaeëopcyxsiïj"
_GREEK, _GREEK_AS = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαινρυγ", "ABEZHIKMNOPTYXoaivpuy"
_FROM = _WIDE + _BLANKS + _CYRILLIC + _GREEK
_TO = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''") + " " * len(_BLANKS) + _CYRILLIC_AS + _GREEK_AS
_JOINS = "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{FE0F}]"


def _sight(x: str) -> str:
    """The form of a text in SQL, as far as the tables' characters need it."""
    x = f"regexp_replace({x}, '[\\x{{AD}}\\x{{200B}}\\x{{200C}}\\x{{2060}}\\x{{FEFF}}]', '', 'g')"
    x = f"regexp_replace({x}, '({_JOINS})\\x{{200D}}({_JOINS})', '\\1' || chr(1) || '\\2', 'g')"
    x = f"replace(replace({x}, chr(8205), ''), chr(1), chr(8205))"
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"nfc_normalize(translate({x}, '{_FROM}', '{_TO}'))"


_VALUES = f"""
raw_values AS (
  SELECT 'title' AS field, row_no AS key, title AS raw FROM records UNION ALL SELECT 'body', row_no, body FROM records
  UNION ALL SELECT 'text', chunk_id, text FROM chunks),
forms AS (SELECT field, key, raw, {_sight("raw")} AS form FROM raw_values WHERE raw IS NOT NULL)
"""

_LEAKS = r"""
docs AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}]+', '', 'g') AS t FROM documents),
items AS (SELECT item_id, CASE WHEN lang IN ('zh', 'ja') THEN 20 ELSE 50 END AS run, regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}]+', '', 'g') AS t FROM eval_items),
phrases AS (SELECT DISTINCT item_id, run, substr(t, CAST(k AS BIGINT), run) AS p FROM (SELECT *, unnest(generate_series(1, length(t) - run + 1)) AS k FROM items)),
windows AS (SELECT DISTINCT doc_id, run, substr(t, CAST(k AS BIGINT), run) AS p FROM (SELECT doc_id, t, run, unnest(generate_series(1, length(t) - run + 1)) AS k FROM docs, (VALUES (20), (50)) r(run)))
"""

_OUTER = r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$"
_INNER = r"[\s\x1c-\x1f\x85\p{Z}]+"
# The letters of leaked windows, islands of them as spans of characters, and what is left of each text.
_SPANS = rf"""{_LEAKS},
places AS (SELECT doc_id, run, CAST(k AS BIGINT) AS k, substr(t, CAST(k AS BIGINT), run) AS p FROM (SELECT doc_id, t, run, unnest(generate_series(1, length(t) - run + 1)) AS k FROM docs, (VALUES (20), (50)) r(run))),
covered AS (SELECT DISTINCT doc_id, unnest(generate_series(k, k + run - 1)) AS n FROM places JOIN phrases USING (run, p)),
texts AS (SELECT doc_id, min(text) AS text FROM documents WHERE doc_id IN (SELECT doc_id FROM covered) GROUP BY doc_id),
chars AS (SELECT doc_id, c, ch, sum(CASE WHEN regexp_matches(lower(ch), '[\p{{L}}\p{{N}}\p{{M}}]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY c) AS n, regexp_matches(lower(ch), '[\p{{L}}\p{{N}}\p{{M}}]') AS is_letter
  FROM (SELECT doc_id, c, substr(text, CAST(c AS BIGINT), 1) AS ch FROM (SELECT doc_id, text, unnest(generate_series(1, length(text))) AS c FROM texts))),
hit AS (SELECT doc_id, c, n, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS island FROM chars JOIN covered USING (doc_id, n) WHERE is_letter),
spans AS (SELECT doc_id, min(c) - 1 AS begin_char, max(c) AS end_char FROM hit GROUP BY doc_id, island),
rest AS (
  SELECT doc_id, coalesce(string_agg(ch, '' ORDER BY c), '') AS t FROM chars a WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = a.doc_id AND a.c > s.begin_char AND a.c <= s.end_char) GROUP BY doc_id)
SELECT doc_id, begin_char, end_char, CAST(coalesce(length(regexp_replace(regexp_replace(t, '{_OUTER}', '', 'g'), '{_INNER}', ' ', 'g')), 0) AS BIGINT) AS chars_left FROM spans LEFT JOIN rest USING (doc_id)"""
_SOURCE = "regexp_replace(lower(trim(source)), '[\\s_-]+', '_', 'g')"

ORACLE: dict[str, str] = {
    "p8_checks": f"""
        SELECT {_SOURCE} AS source, CAST(greatest(1, coalesce(max_repeats, 1)) AS INTEGER) AS max_repeats,
          {_SOURCE} IN (SELECT {_SOURCE} FROM documents WHERE text <> '' AND source IS NOT NULL) AS used, true AS within_repeats, true AS near_share
        FROM mix_targets WHERE target_share > 0""",
    "p5_found": f"""WITH {_VALUES}
        SELECT a.field, a.key AS key_a, b.key AS key_b FROM forms a JOIN forms b ON a.field = b.field AND a.form = b.form AND a.raw <> b.raw AND a.key < b.key""",
    "p5_classes": f"""WITH {_VALUES}
        SELECT field, key, class_key, links FROM (
          SELECT field, key, min(key) OVER (PARTITION BY field, form) AS class_key, count(*) OVER (PARTITION BY field, form) - count(*) OVER (PARTITION BY field, form, raw) AS links FROM forms)
        WHERE links > 0""",
    "p5_forms": f"WITH {_VALUES} SELECT field, key, form FROM forms",
    "p7_spans": f"WITH {_SPANS}",
    "p1_checks": "SELECT row_no, md5(body) AS body_md5, true AS within FROM records WHERE body <> ''",
    "p7_items": f"WITH {_LEAKS} SELECT item_id, count(DISTINCT doc_id) AS documents FROM windows JOIN phrases USING (run, p) GROUP BY item_id",
    "p7_found": f"WITH {_LEAKS} SELECT DISTINCT doc_id, item_id FROM windows JOIN phrases USING (run, p)",
    "p1_found": """
        SELECT row_no FROM records LEFT JOIN chunking_configs USING (collection)
        WHERE strlen(body) > greatest(coalesce(max_chunk_bytes, 8192), 256)""",
    "p2_found": f"WITH {_FORMS} SELECT first_row_no, row_no FROM firsts WHERE row_no <> first_row_no",
    "p2_records": f"WITH {_FORMS} SELECT first_row_no, count(*) AS copies FROM firsts GROUP BY first_row_no",
    "p4_found": f"WITH {_TERMS} SELECT field, term, mark FROM marked WHERE mark IS NOT NULL",
    "p4_counts": f"WITH {_TERMS} SELECT field, term, occurrences, records, mark FROM marked",
}
