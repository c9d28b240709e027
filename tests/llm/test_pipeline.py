"""The pipeline on a small corpus against a plain-Python version of each stage."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(9)
    vocab = {"xx": "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy".split(), "yy": "eins zwei drei vier funf sechs sieben acht neun zehn elf zwolf".split()}
    rows = []
    for i in range(160):
        lang = "xx" if i % 3 else "yy"
        text = "\n".join(" ".join(rng.choice(vocab[lang]) for _ in range(rng.randint(12, 40))) for _ in range(2))
        rows.append([i, ("menu of the site\n" if i % 2 else "") + text, lang, f"src{i % 4}"])
    rows[20][1] = rows[4][1]
    rows[21][1] = rows[5][1] + " amet"
    rows[30][1] = "123 456 !"
    rows[31][1] = None
    leak = " ".join(f"leak{k}" for k in range(12))
    rows[40][1] += "\n" + leak
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], leak


def brute(rows):
    """Line dedup, near copies and decontamination of rows (doc_id, text, source), as kept texts by doc_id."""
    hosts = Counter(s for _, _, s in rows)
    pages = Counter((s, line) for _, t, s in rows for line in {x.strip(" \t\r") for x in (t or "").split("\n")} - {""})
    kept = {}
    for i, t, s in rows:
        bad = {line for (h, line), n in pages.items() if h == s and n >= 5 and n > 0.05 * hosts[s]}
        kept[i] = "\n".join(x for x in t.split("\n") if x.strip(" \t\r") not in bad)
    sets = {}
    for i, t in kept.items():
        w = WORD.findall(t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in kept}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in kept:
        for b in kept:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: t for i, t in kept.items() if find(i) == i and "leak0 leak1" not in t}


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows, leak = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak.upper())], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    want = brute([(i, t, s) for i, t, _, s, _ in rows if t and re.search("[a-z]", t)])
    size = {i: len(WORD.findall(t)) for i, t in want.items()}
    by_source = Counter()
    for i, n in size.items():
        by_source[f"src{i % 4}"] += n
    taken = Counter(r.doc_id for r in got)
    assert set(taken) <= set(want) and max(taken.values()) <= 2
    assert all(r.text == want[r.doc_id] and r.n_chars == len(r.text) and r["size"] == size[r.doc_id] for r in got)
    for s, total in by_source.items():
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {total}
        assert abs(sum(r["size"] for r in mine) - mine[0].target) <= 1
    assert abs(sum(r["size"] for r in got) - 1.5 * sum(by_source.values())) <= 4


def test_stages_name_the_operators_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "decontamination", "mixture"]


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_rows_of_one_or_no_doc_id_stand_by_their_texts(spark, tmp_path):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(20)) for x in "abcd")
    leak = " ".join(f"leak{k}" for k in range(12))
    rows = [(1, a), (2, a), (3, b), (3, c), (3, c), (None, a), (None, d), (None, d), (None, "e f g"), (None, ""), (None, ""), (4, leak + " x"), (None, leak + " y z w v u t s r q p"), (3, "so " + leak)]
    docs = spark.createDataFrame([(i, t, "src", len(t)) for i, t in rows], "doc_id long, text string, source string, n_chars long").repartition(3)
    key = lambda r: (str(r[0]), r[1])
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs, "").select("doc_id", "text").collect()
    left = [(1, a), (3, b), (3, c), (None, d), (None, "e f g"), (None, ""), (None, ""), (4, leak + " x"), (None, leak + " y z w v u t s r q p"), (3, "so " + leak)]
    joined = {t for _, t in left if t.startswith(leak) or t.startswith("so ")}
    assert sorted([tuple(r) for r in kept if r.text not in joined], key=key) == sorted([r for r in left if r[1] not in joined], key=key)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.drop_contaminated(spark, docs, f"file://{tmp_path}").select("doc_id", "text").collect()
    assert sorted(map(tuple, clean), key=key) == sorted([r for r in rows if r[1] not in joined], key=key)
    two = spark.createDataFrame([(3, b, "src", 1), (3, c + " x", "src", 1), (None, a + " x y", "src", 1), (None, d + " x y z", "src", 1)], docs.schema)
    mixed = corpus_pipeline.mix_sources(spark, two, "").collect()
    assert all(r["size"] == len(r.text.split()) for r in mixed) and len({(r.text, r.copy) for r in mixed}) == len(mixed)


CLASHES = ["size", "target", "source_size", "copies", "copy", "taken", "_id", "_key", "_other", "_again", "_text", "_bp", "_bp_host", "_kept", "_bad_id", "_bad_key", "_spans", "_file", "_row", "_hash", "lang_pred", "score", "clean_text", "lines_dropped", "key", "n", "words", "text_key"]


def test_stages_stand_clashing_names_long_texts_and_repeated_rows(spark, tmp_path):
    rng = random.Random(3)
    text = lambda k: " ".join(rng.choice("lorem ipsum dolor sit amet elitr sed diam".split()) + str(rng.randint(0, 99)) for _ in range(k))
    rows = [(i, text(30), "xx", f"src{i % 2}", 1) for i in range(40)] + [(50, text(30_000), "xx", "src0", 1)]
    rows += [(None, None, None, None, None), (51, "", "xx", None, 0), rows[3], rows[3], (None, text(20), "xx", "src1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs = docs.withColumns({c: F.lit("mine") for c in CLASHES})
    spark.createDataFrame([(1, rows[7][1])], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, f"file://{tmp_path}")
        got = out.collect()
        assert set(docs.columns) <= set(out.columns) and all(r[c] == "mine" for r in got for c in CLASHES), name
        if name != "mixture":
            assert out.columns == docs.columns
        n = Counter((r.doc_id, r.text) for r in got)
        if name == "language_id":
            assert len(got) == len(rows) - 2
        if name == "ngram_jaccard":
            assert len(got) == len(rows) - 2 and n[(3, rows[3][1])] == 1
        if name == "decontamination":
            assert len(got) == len(rows) - 1 and (7, rows[7][1]) not in n
        if name == "mixture":
            assert n[(3, rows[3][1])] <= 6 and max(v for k, v in n.items() if k != (3, rows[3][1])) <= 2 and "_target" in out.columns


def test_mixing_rows_without_doc_id_takes_none_twice_too_often(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g h", "s", 1)] * 6, "doc_id long, text string, source string, n_chars long").repartition(2)
    assert len(corpus_pipeline.mix_sources(spark, docs, "").collect()) == 9
