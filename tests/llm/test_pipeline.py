"""The pipeline against plain Python: each stage on what the one before it kept."""

import re
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from wavelark.llm.common import stage
from wavelark.llm.queries import tokenizer_path

from .test_line_rules import WORD, brute, good_lines
from .test_mixing import brute_targets
from .test_secrets import BASE, RUN
from .test_simhash import components, plain


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    functions = {n: lambda *a, n=n, f=f: stage(f(*a), n)[0] for n, f in corpus_pipeline.STAGES}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "secret_scans", "source_mixing", "best_fit_packing"]

    out = functions["quality_rules"](spark, docs, folder)
    assert out.columns == columns
    got = {r.doc_id: r.text for r in out.collect()}
    want = {d: good_lines(r.text)[2] for d, r in before.items() if brute(d, r.text)[7]}
    assert got == want

    docs, texts = out, got
    out = functions["simhash_near_dedup"](spark, docs, folder)
    ids = sorted(texts)
    low = components([plain(texts[d]) for d in ids], ids)
    assert out.columns == columns and sorted(r.doc_id for r in out.collect()) == sorted(set(low.values()))

    docs = out
    texts, source = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.source for r in docs.collect()}
    out = functions["secret_scans"](spark, docs, folder)
    owners = defaultdict(set)
    runs = lambda t: [m for m in RUN.finditer(t) if all(re.search(c, m[0]) for c in ("[a-z]", "[A-Z]", "[0-9]"))]
    base = lambda t: [(m[1] if k == "assign" else m[0], m) for k, rx, ok in BASE for m in rx.finditer(t) if ok(m)]
    for d, t in texts.items():
        for value, _ in [*base(t), *((m[0], m) for m in runs(t))]:
            owners[value].add(source[d])
    want = {}
    for d, t in texts.items():
        hidden = np.zeros(len(t) + 1, bool)
        starts = set()
        for m in [m for _, m in base(t)] + [m for m in runs(t) if len(owners[m[0]]) < 3]:
            hidden[m.start() : m.end()] = True
            starts.add(m.start())
        want[d] = "".join(("[SECRET]" if hidden[i] and (i == 0 or not hidden[i - 1]) else "" if hidden[i] else c) for i, c in enumerate(t))
    rows = out.collect()
    assert out.columns == columns and {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)

    docs, size = out, defaultdict(int)
    for d, t in want.items():
        size[source[d]] += len(WORD.findall(t))
    out = functions["source_mixing"](spark, docs, folder)
    rows = out.collect()
    taken, copies = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.text == want[r.doc_id]
        taken[r.source] += len(WORD.findall(r.text))
        copies[r.doc_id] += 1
    goal, largest = brute_targets(size), max(len(WORD.findall(t)) for t in want.values())
    assert max(copies.values()) <= 2 and all(abs(taken[s] - goal[s]) <= largest for s in size)

    tok, pieces = Tokenizer.from_file(tokenizer_path()), []
    for r in rows:
        ids = np.array([*tok.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        pieces += [(r.doc_id, k // 4096, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096)]
    run = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in run) == sorted(pieces)


def test_no_rows_and_null_texts(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, `key` int, `rules` string"
    good = "Words here make up a line that is long enough to pass every rule of the first stage and to be kept as it is by it."
    for rows in ([], [(1, None, None, None, None, 1, "x"), (None, None, "en", "s", 0, 2, "y")], [(1, good, "en", None, 9, 1, "x"), (1, good, "en", None, 9, 1, "x"), (2, None, "en", "s", 0, 1, "x"), (None, good + " More.", None, "s", None, 3, "z")]):
        docs = spark.createDataFrame(rows, schema)
        for name, f in corpus_pipeline.STAGES:
            docs = stage(f(spark, docs, ""), name)[0]
            if name != "best_fit_packing":
                assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "rules"]
        assert (docs.count() > 0) == (len(rows) > 2)
