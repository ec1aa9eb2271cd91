"""Text expressions. All are built-in Spark expressions, evaluated in the JVM; lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed character classes (regular expression syntax of Java and RE2 alike).
#: Whitespace that trimming removes.
SPACE = r"\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Characters that are a term of their own: CJK ideographs, Extension A, CJK punctuation, full-width forms.
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}"
#: Sentence ends at which chunks may break. The ASCII full stop is not one.
TERMINATORS = "[。！？!?；;\r\n]+"
LATIN1_RUN = r"[\x20-\x7E\x{00A0}-\x{00FF}]{4,}"
#: Markup entities, in the order in which they are decoded: `&amp;lt;` becomes `<`.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "))


def trim(text: Column) -> Column:
    """Without leading and trailing Unicode whitespace (Spark's own trim only knows the space)."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def normalize_ws(text: Column) -> Column:
    """Runs of blanks become one space, three or more newlines two; trimmed. Tags stay."""
    return trim(F.regexp_replace(F.regexp_replace(text, r"[ \t\x0B\f\r]+", " "), r"\n{3,}", "\n\n"))


def strip_xml(xml: Column) -> Column:
    """Text of word-processing markup: paragraph ends and breaks become newlines, other tags go, entities are decoded."""
    text = F.replace(F.replace(xml, F.lit("</w:p>"), F.lit("\n")), F.lit("<w:br/>"), F.lit("\n"))
    text = F.regexp_replace(text, "<[^>]*>", "")
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return normalize_ws(text)


#: Letters whose lower case depends on, or changes, what is around them: such texts are lower-cased term by term.
_BY_TERM = "[\u0130\u03a3]"


def terms(text: Column) -> Column:
    """Search terms in order: each CJK character alone, and each run of other letters and digits in lower case.

    CJK characters are set apart first, where a text has any, so that one plain class finds the runs, and a text is
    lower-cased once.
    """
    apart = F.when(F.rlike(text, F.lit(f"[{CJK}]")), F.regexp_replace(text, f"([{CJK}])", " $1 ")).otherwise(text)
    found = lambda t: F.regexp_extract_all(t, F.lit(rf"[\p{{L}}\p{{N}}]+|[{CJK}]"), 0)
    return F.when(F.rlike(text, F.lit(_BY_TERM)), F.transform(found(apart), F.lower)).otherwise(found(F.lower(apart)))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def latin1_runs(content: Column) -> Column:
    """Runs of four or more printable Latin-1 bytes, each followed by a newline."""
    runs = F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(f"({LATIN1_RUN})"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(r, F.lit("\n"))), "")


def decode_text(content: Column) -> Column:
    """Text of a file's bytes: by its byte order mark, UTF-8 without one."""
    mark = F.hex(F.substring(content, 1, 4))
    rest = lambda n: F.substring(content, n + 1, 2147483647)
    return (
        F.when(mark.isin("FFFE0000", "0000FEFF"), F.decode(content, "UTF-32"))  # which reads the mark itself
        .when(mark.startswith("FFFE"), F.decode(rest(2), "UTF-16LE"))
        .when(mark.startswith("FEFF"), F.decode(rest(2), "UTF-16BE"))
        .when(mark.startswith("EFBBBF"), F.decode(rest(3), "UTF-8"))
        .otherwise(F.decode(content, "UTF-8"))
    )
