import re

from pyspark.sql import types as T

from wavelark.llm.line_rules import PHRASES, clean_lines, keep_clean

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("rules", T.LongType())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


PHRASE = re.compile("|".join(p for some in PHRASES.values() for p in some), re.I)
ADDRESS = re.compile(r"(?:https?://|www\.)[^\x20\x09-\x0D]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z.]+", re.I)


def line_fails(line):
    words = line.count(" ") + 1
    marks, links = sum(line.count(c) for c in "#*$%&<>!"), sum(line.count(c) for c in "|»›•·")
    notice = words <= 12 and (re.search("[©®™]", line) or PHRASE.search(line))
    addresses = len(ADDRESS.findall(line))
    return (links >= 1 and links * 4 >= words) or (marks >= 4 and marks * 2 > words) or (words >= 100 and not re.search("[.!?…。؟।]", line)) or bool(notice) or (addresses and addresses * 2 >= words)


def good_lines(text):
    """(lines with a word that pass, those that fail, the text without these)"""
    lines = text.split("\n")
    entry = [bool(WORD.search(x)) and x.count(" ") <= 2 and not x.rstrip(" \t\n\x0b\x0c\r").endswith(tuple(".!?…。؟।:;,")) for x in lines]
    menu = {j for i in range(len(lines) - 3) if all(entry[i : i + 4]) for j in range(i, i + 4)}
    bad = [bool(WORD.search(x)) and (bool(line_fails(x)) or i in menu) for i, x in enumerate(lines)]
    return [x for x, b in zip(lines, bad, strict=True) if not b and WORD.search(x)], [x for x, b in zip(lines, bad, strict=True) if b], "\n".join(x for x, b in zip(lines, bad, strict=True) if not b)


def brute(doc_id, text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = {}
    for w in wins:
        count[w] = count.get(w, 0) + 1
    covered = {j for i, w in enumerate(wins) if count[w] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    lost, total = sum(map(len, good_lines(text)[1])), sum(map(len, lines))
    return doc_id, len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed, not failed and lost <= total * 0.5


def check(df):
    got = sorted(((r.doc_id, *(r.rules[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))) for r in clean_lines(df).select("doc_id", "rules").collect()), key=str)
    assert got == sorted((brute(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)
    return got


def test_documents(spark):
    got = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert any(r[5] for r in got)


def test_labels_agree(spark):
    good = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = clean_lines(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).select("doc_id", "rules.kept", "rules.n_words").collect()
    clean = [r.kept for r in rows if good.get(r.doc_id) == 1 and r.n_words >= 20]
    junk = [r.kept for r in rows if good.get(r.doc_id) == 0]
    assert sum(clean) >= 0.95 * len(clean) and sum(junk) <= 0.2 * len(junk)


def test_edges(spark):
    w8 = "a b c d e f g h"
    texts = [None, "", " \n\t\n", w8, f"{w8} {w8}", f"{w8} {w8} x " * 40, "x " * 30000, "\n".join(["One two three four."] * 9), "\U0001f600é " * 25, " a\x0bb\x0cc\rd\x1fe   f", "word. " * 30 + "\n" + "All rights reserved.", "a | b | c\n" * 10, "Home\nAbout us\nNews \r\nContact\n" + "word. " * 30, "Home\nAbout\n\nNews\nContact\n" + "word. " * 30, "word. " * 30 + "\nDROITS Tous droits RÉSERVÉS 2020\nsee www.a.b/c x@y.zz",  f"{w8}\n" + "k l m n o p q. " * 2 + f"{w8} z"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, w8, "x", 1), (None, w8, "y", 2)]
    check(spark.createDataFrame(rows, SCHEMA))
    assert clean_lines(spark.createDataFrame([], SCHEMA)).collect() == []
    kept = keep_clean(spark.createDataFrame([(1, " ".join(f"Word{i} ends." for i in range(40)) + "\nAll rights reserved.\n\nEnd here.", "x", 7)], SCHEMA))
    row = kept.collect()[0]
    assert kept.columns == SCHEMA.names and row.rules == 7 and row.text.endswith("ends.\n\nEnd here.")


def test_columns_of_any_name(spark):
    text = "\n".join(f"Word{i} goes on and ends." for i in range(9)) + "\nAll rights reserved."
    df = spark.createDataFrame([(1, text, 1, 2, 3, 4)], "doc_id long, text string, Rules int, `__text` int, line_words int, `__row` int")
    assert [tuple(r) for r in keep_clean(df).collect()] == [(1, text.rpartition("\n")[0], 1, 2, 3, 4)]
    assert clean_lines(df).columns == ["doc_id", "text", "__text", "line_words", "__row", "clean_text", "rules"]
    assert keep_clean(df.limit(0)).collect() == []
