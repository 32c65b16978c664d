"""Line-first cleaning, in DataFrame functions only.

Rules of punctuation, navigation and boilerplate judge each line; failing lines go; a document that
loses too much of its text goes as a whole. Everything is arithmetic on one row's arrays: no shuffle,
and a document of any length is judged in time in proportion to it (but for one sort of its window
hashes, where some repeat).
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, WORD_REGEX, columns_of, fresh, text_or_empty

#: What counts as a symbol, marks that stand between links, marks that end a sentence or a clause.
SYMBOLS = "#*$%&|<>"
LINK_MARKS = "|»›•·"
END_MARKS = ".!?…。؟।:;,"
#: What notices and page furniture say, in the languages of the texts.
PHRASES = {
    "en": ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie", "javascript", "subscribe", "sign in", "sign up", "log in", "click here", "read more", "skip to content"),
    "de": ("alle rechte vorbehalten", "nutzungsbedingungen", "datenschutz", "impressum", "cookie", "abonnieren", "anmelden", "hier klicken", "weiterlesen", "zum inhalt springen"),
    "fr": ("tous droits réservés", "conditions d'utilisation", "mentions légales", "confidentialité", "cookie", "s'abonner", "se connecter", "cliquez ici", "lire la suite", "aller au contenu"),
    "es": ("todos los derechos reservados", "condiciones de uso", "aviso legal", "política de privacidad", "cookie", "suscríbete", "iniciar sesión", "haga clic aquí", "leer más", "saltar al contenido"),
}
#: Words of a notice, at most, and of a menu's entry; entries that follow one another in a menu, at least.
NOTICE_WORDS, ENTRY_WORDS, MENU_LINES = 12, 3, 4
#: Fixed value: a web or mail address.
ADDRESS = r"(?i)(?:https?://|www\.)[^\x20\x09-\x0D]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z.]+"


def _count(text: Column, characters: str) -> Column:
    """How often any of the characters stands in the text, where that is seldom."""
    return F.regexp_count(text, F.lit(f"[{characters}]"))


def _words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def menu_entry(line: Column) -> Column:
    """Whether a line with a word could be an entry of a menu: short, and neither a sentence nor a clause."""
    return line.rlike(WORD_REGEX) & (_words(line) <= ENTRY_WORDS) & ~line.rlike(f"[{END_MARKS}][\\x20\\x09-\\x0D]*\\z")


def line_rule(line: Column, phrases: dict[str, tuple[str, ...]] = PHRASES) -> Column:
    """The rule that a line fails by itself: punctuation, navigation or boilerplate; null if it passes.

    Boilerplate is judged by signs of a notice (©, ®, ™), by addresses that are half of its words, and by
    the phrases of notices in short lines. How many documents share a line says nothing here: of exact
    copies all lines are shared, and to tell these is another operator's work.
    """
    words = _words(line)
    marks = _count(line, "#*$%&<>!")
    links = _count(line, LINK_MARKS)
    phrase = "(?iu)" + "|".join(dict.fromkeys(p for some in phrases.values() for p in some))
    return (
        F.when((links >= 1) & (links * 4 >= words), "navigation")
        .when((marks >= 4) & (marks * 2 > words), "punctuation")
        .when((words >= 100) & ~line.rlike("[.!?…。؟।]"), "punctuation")
        .when((words <= NOTICE_WORDS) & (line.rlike("[©®™]") | line.rlike(phrase)), "boilerplate")
        .when(line.rlike(ADDRESS) & (F.regexp_count(line, F.lit(ADDRESS)) * 2 >= words), "boilerplate")
    )


def clean_lines(documents: DataFrame, max_lost: float = 0.5, repeat_window: int = 8, min_words: int = 20, max_repeat_percent: int = 30, rules_col: str = "rules", text_col: str = "clean_text") -> DataFrame:
    """documents(doc_id, text, ...) -> all its columns, clean_text, and the struct `rules` of counts and verdict (names by text_col and rules_col).

    A line fails by itself (line_rule) or, as navigation, in a menu: a run of short lines, none of which
    ends like a sentence. rules: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_failed_lines, lost (share of the characters of lines with a word that failing lines hold),
    base_failed, kept. Null text has no words and fails. Repeated rows and null ids are judged like any other; an empty table gives no row.
    clean_text is the text without its failing lines (blank lines stay). Input columns of those two names
    are taken over; others stay.
    """
    if repeat_window != 8:
        raise ValueError("windows are built by doubling: 8 words")
    kept_columns = [F.col("`" + c.replace("`", "``") + "`") for c in documents.columns if c.lower() not in (rules_col.lower(), text_col.lower())]
    names = ("text", "trim", "lines", "words", "n", "h1", "h2", "h4", "h8", "repeats", "sorted", "at", "entry", "menu", "bad", "worded", "repeat", "all", "lost")
    N = dict(zip(names, fresh(documents, *[f"line_{x}" for x in names]), strict=True))
    t, space = F.col(N["text"]), F.lit(SPACE_CHARS)
    has_word = lambda line: line.rlike(WORD_REGEX)
    pair = lambda a, step: F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - step, F.lit(0))), F.slice(a, step + 1, F.greatest(F.size(a) - step, F.lit(0))), lambda x, y: F.xxhash64(x, y))
    df = documents.withColumn(N["text"], text_or_empty())
    df = df.withColumn(N["trim"], F.btrim(t, space)).withColumn(N["lines"], F.split(t, "\n", -1))
    df = df.withColumn(N["words"], F.when(F.col(N["trim"]) == "", F.array().cast("array<string>")).otherwise(F.split(N["trim"], r"[\x20\x09-\x0D]+", -1)))
    df = df.withColumn(N["n"], F.size(N["words"])).withColumn(N["h1"], F.transform(N["words"], lambda w: F.xxhash64(w)))
    # Each doubling is a column of its own: nested, it would be computed again for each use.
    df = df.withColumn(N["h2"], pair(F.col(N["h1"]), 1)).withColumn(N["h4"], pair(F.col(N["h2"]), 2)).withColumn(N["h8"], pair(F.col(N["h4"]), 4))
    # Only texts in which some window repeats pay for the sort.
    df = df.withColumn(N["repeats"], F.size(F.array_distinct(N["h8"])) < F.size(N["h8"]))
    ordered = F.when(F.col(N["repeats"]), F.sort_array(F.arrays_zip(F.col(N["h8"]).alias("h"), F.sequence(F.lit(0), F.size(N["h8"]) - 1).alias("i")).cast("array<struct<h:bigint,i:int>>")))
    df = df.withColumn(N["sorted"], ordered)
    s = F.col(N["sorted"])
    same = F.transform(s, lambda x, k: F.when(F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"]), x["i"]))
    df = df.withColumn(N["at"], F.sort_array(F.filter(same, lambda i: i.isNotNull())))
    at = F.col(N["at"])
    covered = F.aggregate(F.transform(at, lambda i, k: F.least(F.lit(repeat_window), F.coalesce(F.get(at, k + 1) - i, F.lit(repeat_window))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    # A line is in a menu if it is one of MENU_LINES entries in a row.
    lines, entry, menu, bad = (F.col(N[x]) for x in ("lines", "entry", "menu", "bad"))
    sure = lambda x: F.coalesce(x, F.lit(False))
    df = df.withColumn(N["entry"], F.transform(lines, menu_entry))
    df = df.withColumn(N["menu"], F.transform(entry, lambda x, i: reduce(and_, [sure(F.get(entry, i + k)) for k in range(MENU_LINES)])))
    df = df.withColumn(N["bad"], F.transform(lines, lambda x, i: has_word(x) & (line_rule(x).isNotNull() | reduce(or_, [sure(F.get(menu, i - k)) for k in range(MENU_LINES)]))))
    df = df.withColumn(N["worded"], F.filter(lines, has_word))
    failing = F.filter(lines, lambda x, i: F.get(bad, i))
    chars = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    df = df.withColumn(N["repeat"], F.coalesce(covered, F.lit(0).cast("long"))).withColumn(N["all"], chars(F.col(N["worded"]))).withColumn(N["lost"], chars(failing))
    n = F.col(N["n"]).cast("long")
    failed = (n < min_words) | (F.col(N["repeat"]) * 100 > n * max_repeat_percent)
    rules = F.struct(
        n.alias("n_words"),
        chars(F.col(N["words"])).alias("word_chars"),
        _count(t, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size(N["worded"]) - F.size(F.array_distinct(N["worded"]))).cast("long").alias("n_dup_lines"),
        F.col(N["repeat"]).alias("n_repeat_words"),
        F.size(F.filter(bad, lambda x: x)).cast("long").alias("n_failed_lines"),
        F.when(F.col(N["all"]) > 0, F.col(N["lost"]) / F.col(N["all"])).otherwise(0.0).alias("lost"),
        failed.alias("base_failed"),
        (~failed & (F.col(N["lost"]) <= F.col(N["all"]) * F.lit(max_lost))).alias("kept"),
    )
    clean = F.when(~F.array_contains(bad, True), t).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.get(bad, i)), "\n"))
    return df.select(*kept_columns, clean.alias(text_col), rules.alias(rules_col))


def keep_clean(documents: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with failing lines out of their text; n_chars follows where it is a column.

    Null and empty texts have no words and go. Repeated rows and null ids are judged like any other; an
    empty table gives no row. Columns of any names pass through.
    """
    verdict, clean, row = fresh(documents, "verdict", "clean", "row")
    rows = clean_lines(documents, **options, rules_col=verdict, text_col=clean)
    # The row number keeps the filter above the rules: pushed below, it would compute them all again, in one nested expression.
    rows = rows.withColumn(row, F.monotonically_increasing_id()).where(F.col(verdict)["kept"] & (F.col(row) >= 0)).withColumn("text", F.col(clean))
    return (rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in documents.columns else rows).select(*columns_of(documents))
