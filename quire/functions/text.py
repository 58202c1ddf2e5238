"""Text as Spark columns: folds, tokens, sentences, values and references.

Five folds exist and must not be unified: ``match_key`` deletes accented letters, ``strict_key``
folds them to capitals, ``tokens`` keeps them, ``slug`` folds to identifiers and ``heading_key``
folds and keeps blanks.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Content words are told from these.
STOPWORDS = """
le la les un une des du de da au aux et ou ni mais donc or car que qui quoi dont
ce cet cette ces son sa ses leur leurs mon ma mes ton ta tes notre nos votre vos
pour par sur sous dans avec sans vers chez entre est sont ete etre avoir ont avait
plus moins tres bien aussi comme tout tous toute toutes ne pas plus rien on nous vous
ils elles il elle je tu se sa son lui eux y en il-y-a cela ceci celui celle
the a an of to and or in on at for with without from by as is are was were be been
this that these those it its his her their our your my we you they he she them us
not no any all can will would should could may might one two
""".split()
# What a word is.
TOKEN = "[a-zA-ZÀ-ÿ0-9]+"
MIN_TOKEN = 3


@functools.cache
def _marks() -> tuple[str, str]:
    """Latin letters that decompose to a base letter and marks, and their base letters."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base, *rest = unicodedata.normalize("NFD", chr(code))
        if rest and all(unicodedata.combining(c) for c in rest):
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


def strip_marks(c: Column) -> Column:
    """Letters without their accents; letters that don't decompose stay."""
    return F.regexp_replace(F.translate(c, *_marks()), "[\\u0300-\\u036f]", "")


def match_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def strict_key(c: Column) -> Column:
    """The identity key: equal only for equal names up to accents, case and separators."""
    return F.coalesce(F.regexp_replace(F.upper(strip_marks(c)), "[^A-Z0-9]", ""), F.lit(""))


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def heading_key(c: Column) -> Column:
    return F.lower(collapse_spaces(strip_marks(c)))


def slug(c: Column, default: str = "champ") -> Column:
    plain = F.regexp_replace(strip_marks(c), "[^\\x00-\\x7f]", "")
    made = F.substring(F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 40)
    return F.when(made == "", F.lit(default)).otherwise(made)


def field_name(c: Column) -> Column:
    """A proposed field name as an identifier; empty where nothing of it is left."""
    return slug(c, "")


def tokens(c: Column) -> Column:
    """Lower-case content words of three or more characters, accents kept, in order."""
    found = F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), F.lower)
    return F.filter(found, lambda t: (F.length(t) >= MIN_TOKEN) & ~t.isin(*sorted(set(STOPWORDS))))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def sentences(c: Column) -> Column:
    """Split behind a full stop, question or exclamation mark; fragments of one character go."""
    return F.filter(F.transform(F.split(c, r"(?U)(?<=[.!?])\s+"), strip), lambda s: F.length(s) > 1)


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda p: p != "")


def normalise_value(c: Column, rule: Column | str | None) -> Column:
    """A read value by its field's rule: ``date_ddmmyyyy``, ``amount``, ``upper``, or stripped."""
    rule = F.lit(rule) if rule is None or isinstance(rule, str) else rule
    value = strip(c)
    digits = F.regexp_replace(value, "[^0-9]", "")
    iso = F.concat_ws("-", F.substring(digits, 5, 4), F.substring(digits, 3, 2), F.substring(digits, 1, 2))
    return (
        F.when((rule == "date_ddmmyyyy") & (F.length(digits) == 8), iso)
        .when(rule == "amount", F.regexp_replace(value, r"(?U)\s", ""))
        .when(rule == "upper", F.upper(value))
        .otherwise(value)
    )


def reference_key(c: Column) -> Column:
    """``article 4`` and the like: the first element named in a reference, or null."""
    pattern = r"(?i)(article|annexe|avenant)\s+(?:n[°ºo]\s*)?([ivxlc]+|\d+)"  # fixed value
    kind = F.regexp_extract(c, pattern, 1)
    return F.when(kind != "", F.lower(F.concat_ws(" ", kind, F.regexp_extract(c, pattern, 2))))


def keys_in(heading: Column) -> Column:
    """All reference keys that a folded heading holds: ``article 12`` holds ``article 1`` too."""
    found = F.regexp_extract_all(heading, F.lit(r"(?:article|annexe|avenant) (?:[ivxlc]+|\d+)"), F.lit(0))
    first = lambda k: F.position(F.lit(" "), k) + 1
    heads = F.transform(found, lambda k: F.transform(F.sequence(first(k), F.length(k)), lambda n: F.substr(k, F.lit(1), n)))
    return F.array_distinct(F.flatten(heads))


def is_document_reference(c: Column) -> Column:
    """The text leads with a document element, after one determiner at most."""
    determiner = r"(?i)^(?:l['’]|d['’]|les?\s+|du\s+|des\s+|de\s+la\s+|au[x]?\s+|à\s+l['’])"
    return F.trim(F.regexp_replace(F.trim(c), determiner, "")).rlike(r"(?i)^(?:articles?|annexes?|avenants?|contrat)\b")


def article_heading(c: Column) -> Column:
    """``struct(id, title)`` of an article's heading line, or null."""
    pattern = r"^\s*(?:ARTICLE|Article)\s+([IVXLC]+|\d+)\b[\s.:)–-]*(.*)$"
    made = F.struct(F.regexp_extract(c, pattern, 1).alias("id"), F.trim(F.regexp_extract(c, pattern, 2)).alias("title"))
    return F.when(c.rlike(pattern), made)


# What a label line is, and the letters that make a line or a label structural.
COLON_LINE = r"(?Ud)^\s*([^:\n]{2,60}?)\s*:\s*(\S.*)$"
LABEL_LETTERS, LINE_LETTERS = "[a-zA-ZÀ-ÿ]{3,}", "[a-zA-ZÀ-ÿ]{4,}"


def colon_pair(c: Column) -> Column:
    """``struct(label, value)`` of a line ``label : value`` whose label has 2 to 60 characters, no colon, and
    a run of three letters, or null."""
    label, value = strip(F.regexp_extract(c, COLON_LINE, 1)), strip(F.regexp_extract(c, COLON_LINE, 2))
    return F.when(c.rlike(COLON_LINE) & label.rlike(LABEL_LETTERS), F.struct(label.alias("label"), value.alias("value")))


def escaped_pattern(label: Column) -> Column:
    """A pattern that reads the value behind a label taken literally."""
    return F.concat(F.regexp_replace(label, r"([^A-Za-z0-9_À-ÿ])", r"\\$1"), F.lit(r"\s*:\s*([^\n]+)"))


def is_structural(c: Column) -> Column:
    return c.rlike(LINE_LETTERS)


def quoted(c: Column) -> Column:
    """A string as reasons quote it: single quotes, double ones where it holds a single one only."""
    plain = F.regexp_replace(c, r"\\", r"\\\\")
    double = c.contains("'") & ~c.contains('"')
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


# The characters of code page 1252 between U+0080 and U+009F, and their bytes.
CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_BYTES = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"


def integrity(c: Column) -> Column:
    """``struct(replacement_count, disposition, repaired)``: lost characters, then text decoded by
    the wrong code page that decodes back, then such text that doesn't, then clean."""
    lost = F.length(c) - F.length(F.replace(c, F.lit("�"), F.lit("")))
    raw = F.translate(c, CP1252, CP1252_BYTES)
    garbled = raw.rlike("[\\u00C2-\\u00F4][\\u0080-\\u00BF]")
    narrow = ~raw.rlike("[^\\u0000-\\u00ff]")
    back = F.when(garbled & narrow, F.try_validate_utf8(F.encode(F.when(narrow, raw), "ISO-8859-1").cast("string")))
    kind = F.when(lost > 0, "irreversible_loss").when(back.isNotNull(), "repairable_mojibake").when(garbled, "suspect_encoding").otherwise("clean")
    return F.struct(lost.alias("replacement_count"), kind.alias("disposition"), F.when(lost == 0, back).alias("repaired"))
