"""One form for texts that look the same.

A transducer over grapheme clusters, compiled once into one pattern and one table, rewrites a text in a single pass,
taking the longest match at each place: a base with its combining marks, a joined emoji, or a single character that
has an entry. Its table is derived by rule from the Unicode data (widths, presentation forms, ligatures, blanks) and
from a list of look-alike letters, closed under itself, and checked for conflicts before use: every output is in its
final form, so rewriting twice changes nothing.
"""

from __future__ import annotations

import re
import sys
import unicodedata as ud
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.functions.frames import cut, join_groups, python_batches
from quarrystone.llm import dedup

# Letters of other scripts that look like a Latin one (or a digit), each with that at the same place.
CYRILLIC, CYRILLIC_AS = "аеорсухіјѕһԁԛԝѵүӏАВЕКМНОРСТУХІЈЅԚԜѴҮӀԌ", "aeopcyxijshdqwvylABEKMHOPCTYXIJSQWVYlG"
GREEK, GREEK_AS = "οαγινρυκϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϿ", "oayivpuĸcjABEZHIKMNOPTYXCƆ"
ARMENIAN, ARMENIAN_AS = "օսհոցզգյՕՍՏԼ", "ouhngqqjOUSL"
CHEROKEE, CHEROKEE_AS = "ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏃᏎᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴ", "DRTiYAJEWMHYGZ4RWSVSLCPKdGB"
LISU, LISU_AS = "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"
LETTERS, LETTERS_AS = CYRILLIC + GREEK + ARMENIAN + CHEROKEE + LISU, CYRILLIC_AS + GREEK_AS + ARMENIAN_AS + CHEROKEE_AS + LISU_AS
# Characters that show nothing (the default ignorable ones), but for those that turn the direction of
# what follows, and for fillers of Korean syllables; U+3164 and U+FFA0 show as a blank. U+200D shows nothing unless it
# joins emoji, U+FE0E and U+FE0F nothing unless they follow one, and tags nothing but behind the flag that they name.
UNSEEN_RANGES = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202C), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
UNSEEN = "".join(chr(i) for a, b in UNSEEN_RANGES for i in range(a, b + 1))
FILLERS = "\u3164\uffa0"
JOINER = "\u200d"
# Hyphens that look like the ordinary one.
HYPHENS = "\u2010\u2011"
EMOJI = "\U0001f000-\U0001faff\u2190-\u21ff\u2300-\u2328\u232b-\u27bf\u2b00-\u2bff"
# Joined emoji, emoji with a choice of presentation, and flags spelled by tags: these stay as they are.
JOINED = f"[{EMOJI}]\ufe0f?(?:{JOINER}[{EMOJI}]\ufe0f?)+"
CHOSEN = f"[{EMOJI}#*0-9\u00a9\u00ae\u203c\u2049\u2122\u2139\u24c2\u3030\u303d\u3297\u3299][\ufe0e\ufe0f]"
FLAG = "\U0001f3f4[\U000e0020-\U000e007e]+\U000e007f"
KEPT = re.compile(f"{JOINED}|{FLAG}|{CHOSEN}")
# Classes of <compat> characters that show just what they stand for: the micro sign, digraphs and
# ligatures of letters, L with a dot, Arabic letters with high hamza, Lao and Tibetan digraphs, degrees, Hebrew letters as symbols,
# roman numerals, radicals, Hangzhou tens. Not among them: Greek variants of another shape,
# punctuation, enclosed, squared or raised letters, and Hangul compatibility letters: those they stand for join to
# syllables, and come out as compatibility letters only where they stand alone.
SAME_GLYPH = re.compile(
    "[\u00b5\u0132-\u01f3\u0587\u0675-\u0678\u0edc\u0edd\u0f77\u0f79\u2103\u2109\u2135-\u2138\u2160-\u217f\u2e9f\u2ef3\u2f00-\u2fd5\u3038-\u303a\ufb00-\ufb4f]"
)
# Thai and Lao AM written as ring and AA, with tone marks before or after the ring; it comes out as one character.
AM = re.compile("([\u0e48-\u0e4b]*)\u0e4d([\u0e48-\u0e4b]*)\u0e32|([\u0ec8-\u0ecb]*)\u0ecd([\u0ec8-\u0ecb]*)\u0eb2")
# Conjoining Hangul letters (leading, vowel, trailing; syllables) that join neither the one before nor the one after.
_L, _V, _T, _S = "\u1100-\u115f\ua960-\ua97c", "\u1160-\u11a7\ud7b0-\ud7c6", "\u11a8-\u11ff\ud7cb-\ud7fb", "\uac00-\ud7a3"
CONJOINING = re.compile(f"[{_L}{_V}{_T}]")
ALONE = re.compile(f"(?<![{_L}])[{_L}](?![{_L}{_V}{_S}])|(?<![{_L}{_V}{_S}])[{_V}](?![{_V}{_T}])|(?<![{_V}{_T}{_S}])[{_T}](?![{_T}])")
ALONE_AS = {ud.normalize("NFKC", c): c for c in map(chr, range(0x3131, 0x318F))}


def _same_sight(c: str) -> str | None:
    """What a character with a compatibility decomposition shows, if its own shape adds nothing to be seen."""
    kind = ud.decomposition(c).partition(" ")[0]
    if ud.category(c) == "Zs" or c in FILLERS:
        return " "
    if "\uffa0" <= c <= "\uffdc":  # half-width Hangul letters: as the ordinary ones, which don't join either
        return chr(int(ud.decomposition(c).split()[1], 16))
    out = ud.normalize("NFKC", c)
    if kind in ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<font>"):
        return out if out.strip() and not out.startswith(" ") else None
    return out if kind == "<compat>" and SAME_GLYPH.match(c) else None


@lru_cache(1)
def mapping() -> dict[str, str]:
    """The table for single characters, closed and checked."""
    first = {c: s for i in range(0x80, sys.maxunicode + 1) if (c := chr(i)) and ud.decomposition(c)[:1] == "<" or ud.category(c) == "Zs" or c in FILLERS if (s := _same_sight(c)) is not None and s != c}
    first |= dict(zip(LETTERS, LETTERS_AS, strict=True)) | dict.fromkeys(UNSEEN, "") | dict.fromkeys(HYPHENS, "-")
    out = {}
    for c in first:
        seen, now = {c}, first[c]
        while (then := "".join(first.get(x, x) for x in ud.normalize("NFD", now))) != ud.normalize("NFD", now):
            if then in seen:
                raise ValueError(f"the mapping of {c!r} goes in circles")
            seen.add(then)
            now = then
        out[c] = ud.normalize("NFC", now)
    # A letter that is a mapped base with a mark (as U+0451) maps to the mapped base with that mark, and one that is
    # canonically another text (as U+212B, U+F900) to that. No character without a decomposition of its own can be either.
    for i in range(0x80, sys.maxunicode + 1):
        c, d = chr(i), ud.normalize("NFD", chr(i)) if ud.decomposition(chr(i)) else ""
        if d and c not in out and (then := ud.normalize("NFC", "".join(out.get(x, x) for x in d))) != c:
            out[c] = then
    for c, s in out.items():
        if any(x in out for x in s):
            raise ValueError(f"{c!r} maps to {s!r}, which is mapped itself")
    return out


def _class(chars: str) -> str:
    """A class of characters by ranges: beyond U+FFFF, re tries its members one after another."""
    parts: list[list[int]] = []
    for i in sorted(set(map(ord, chars))):
        if parts and parts[-1][1] == i - 1:
            parts[-1][1] = i
        else:
            parts.append([i, i])
    return f"[{''.join(f'{re.escape(chr(a))}-{re.escape(chr(b))}' for a, b in parts)}]"


@lru_cache(1)
def _compiled() -> tuple[re.Pattern[str], dict[str, str]]:
    single = mapping()
    every = [chr(i) for i in range(0x80, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    composing = {x for c in every for x in ud.normalize("NFD", c)[1:]}  # also the later letters of a Korean syllable
    marks = "".join(c for c in every if ud.combining(c) or c in composing)
    marks += "".join(c for c, s in single.items() if s and ud.combining(s[0]))  # half-width sound marks
    m, unseen, keys = map(_class, (marks, UNSEEN, "".join(single)))
    return re.compile(f"{KEPT.pattern}|[^\\s{unseen[1:-1]}](?:{unseen}*{m})+|{keys}"), {}


def consistent(text: str) -> str:
    """The form of a text that all texts of the same sight share."""
    if text.isascii():
        return text
    pattern, known = _compiled()
    single = mapping()

    def one(match: re.Match[str]) -> str:
        x = match.group()
        if (y := known.get(x)) is None:
            if x in single:
                y = single[x]
            elif KEPT.fullmatch(x):
                y = x
            else:
                y = ud.normalize("NFC", "".join(single.get(c, c) for c in ud.normalize("NFD", x)))
            if len(known) < 100_000:
                known[x] = y
        return y

    done = pattern.sub(one, text)
    if CONJOINING.search(done):
        done = ALONE.sub(lambda m: ALONE_AS.get(m[0], m[0]), done)
    if "\u0e4d" in done or "\u0ecd" in done:
        done = AM.sub(lambda m: f"{m[1]}{m[2]}\u0e33" if m[3] is None else f"{m[3]}{m[4]}\u0eb3", done)
    return done


@F.pandas_udf(T.StringType())
def _consistent(texts: pd.Series) -> pd.Series:
    return texts.map(consistent, na_action="ignore")


def consistent_text(text: Column) -> Column:
    """consistent() of a column. Texts of ASCII characters are in this form already and stay in the JVM."""
    odd = text.rlike(r"[^\x00-\x7f]")
    return F.coalesce(_consistent(F.when(odd, text)), text)


def consistent_values(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """field (title, body, text), key, raw, form for every value that is not NULL; empty ones are their own form.

    key is row_no or chunk_id. Only these columns are read, so others cannot clash.
    """
    python_batches(records.sparkSession)
    values = records.select(
        F.col("row_no").cast("long").alias("key"),
        F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("raw")) for f in ("title", "body")))).alias("v"),
    ).select("key", "v.field", "v.raw")
    texts = chunks.select(F.col("chunk_id").cast("long").alias("key"), F.lit("text").alias("field"), F.col("text").alias("raw"))
    both = values.unionByName(texts).where("raw IS NOT NULL")
    return both.withColumn("form", consistent_text(F.col("raw")))


#: Rows of one variant beyond which a join of two variants is spread over several tasks.
PART_ROWS = 20_000
GROUP = ["field", "form"]


def _members(records: DataFrame, chunks: DataFrame) -> tuple[DataFrame, int]:
    """(field, form, key, value: digests of the form and of the characters; the number of all values) of every value
    whose form a rewritten value has too.

    Two values of one sight cannot both be in that form already, so only groups that hold a rewritten value matter. A
    Bloom filter of the forms of rewritten values, of bounded size, leaves out nearly all other values where they lie;
    what passes is grouped exactly.
    """
    digest = lambda c: F.unhex(F.md5(c))
    values = consistent_values(records, chunks)
    rows = cut(values.select("field", "key", digest("form").alias("form"), F.when(F.col("raw") != F.col("form"), digest("raw")).alias("other")))
    h = F.xxhash64("field", "form")
    bits, size = dedup.member_filter(rows.where("other IS NOT NULL").select(h.alias("h")))
    held = rows.sparkSession.sparkContext.broadcast(bits)
    may = cut(rows.where(dedup.may_hold(held, size)(h)))
    groups = may.groupBy(GROUP).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("other").isNotNull()).alias("rewritten")).where("rewritten AND n > 1")
    total = may.count()
    members = join_groups(may, cut(groups), GROUP, "n", total)
    return cut(members.select(*GROUP, "key", F.coalesce("other", "form").alias("value"))), total


def same_sight_classes(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """field, key, class_key, links for every value that another of its field shows the same text as in other code
    points: class_key is the smallest key of all values of that sight, links the number of those others. Linear in the
    values, however many share a sight."""
    members, total = _members(records, chunks)
    each = members.groupBy(*GROUP, "value").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least"))
    whole = each.groupBy(GROUP).agg(F.sum("n").alias("all"), F.min("least").alias("class_key"), F.count(F.lit(1)).alias("variants")).where("variants > 1")
    joined = cut(each.join(whole, GROUP).select(*GROUP, "value", "n", "class_key", (F.col("all") - F.col("n")).alias("links")))
    return join_groups(members, joined, [*GROUP, "value"], "n", total).select("field", "key", "class_key", "links")


def same_sight_pairs(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """field, key_a < key_b: values of a field that differ in code points and have the same form.

    Distinct values of a group are paired first and their rows after that; values that many rows share are spread. All
    pairs are the result that is asked for; same_sight_classes has the same links in linear size.
    """
    group = GROUP
    members, _ = _members(records, chunks)
    variants = members.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("n"))
    mixed = variants.groupBy(*group).agg(F.count(F.lit(1)).alias("variants")).where("variants > 1")
    variants = variants.join(mixed, group, "left_semi")
    a, b = (variants.select(*group, F.col("value").alias(f"value_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    first = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("value_a") < F.col("value_b")))
    pairs = cut(
        a.join(b, group)
        .where((F.col("value_a") != F.col("value_b")) & first)
        .select(*group, "value_a", "value_b", F.ceil(F.col("n_a") / PART_ROWS).cast("int").alias("parts"))
    )
    left = members.withColumnRenamed("value", "value_a").join(pairs, [*group, "value_a"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    right = members.withColumnRenamed("value", "value_b").join(pairs, [*group, "value_b"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = [*group, "value_a", "value_b", "part"]
    x = left.select(*keys, F.col("key").alias("x")).join(right.select(*keys, F.col("key").alias("y")), keys)
    return x.select("field", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))
