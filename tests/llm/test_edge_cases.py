"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

import hashlib
import json
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cascata.llm import ann_aq, decontam, html_extract, langid, licenses, line_dedup, mixing, ngram_join, signature_tree, substring_dedup, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(seed, n=60):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefghijklmnop") for _ in range(40)) for _ in range(5)]
    out = []
    for i in range(n):
        parts = [rng.choice([rng.choice(base), " ".join(rng.choice("qrstuvwxyzé") + rng.choice("QRST") for _ in range(rng.randint(1, 30)))]) for _ in range(rng.randint(0, 4))]
        out.append((i, rng.choice(["", " ", "\n"]).join(parts)))
    return out + [(100, None), (101, ""), (102, " \n\t "), (103, "one"), (104, "one"), (3, out[3][1]), (105, "w " * 30_000), (None, base[0])]


def frame(spark, rows, schema="doc_id long, text string"):
    """With columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit("clash") for c in ("n", "comp", "rep", "words", "span", "size", "_hash", "order") if c not in df.columns})


def test_ngram_join_matches_brute_force(spark):
    rows = texts(1)
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b) or (rows[i][0] is not None and rows[i][0] == rows[j][0]):
                up[find(i)] = find(j)
    want = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        want.append((doc, len(sets[i]), min(ids) if ids and sets[i] else doc))
    got = [tuple(r) for r in ngram_join.link_documents(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.link_documents(frame(spark, [])).count() == 0
    assert [tuple(r) for r in ngram_join.link_documents(frame(spark, [(1, None), (2, "")])).orderBy("doc_id").collect()] == [(1, 0, 1), (2, 0, 2)]


def token_sets(seed, n=240):
    rng = np.random.default_rng(seed)
    base = [np.unique(rng.integers(0, 2**63, k).astype(np.uint64)) for k in (3, 40, 200, 1500)]
    sets = []
    for k in range(n):
        b = base[k % 4]
        kept = b[rng.random(len(b)) > rng.random() * 0.3]
        sets.append(np.unique(np.concatenate((kept, rng.integers(0, 2**63, len(b) // 8 + 1).astype(np.uint64)))))
    return sets


def tree_pairs(sets, block, side, comp, spanning=False):
    order = np.argsort(block, kind="stable")
    block, side, comp = (np.asarray(x, np.int64)[order] for x in (block, side, comp))
    sigs = pa.array([signature_tree.signature(sets[i]) for i in order], pa.binary())
    crossed = np.bincount(block, side) > 0
    found = signature_tree.block_pairs(block, side, crossed, np.array([len(sets[i]) for i in order]), order.astype(np.int64), comp, sigs, spanning)
    return {(int(y), int(x)) for a, b in found for x, y in zip(a, b)}


@pytest.mark.parametrize("blocks,sides", [(1, 1), (1, 2), (7, 1), (60, 2)])
def test_signature_tree_keeps_every_link(blocks, sides):
    sets = token_sets(5)
    n = len(sets)
    block, side, comp = [i * 7 % blocks for i in range(n)], [i % 3 % sides for i in range(n)], [i if i % 9 else 1000 for i in range(n)]
    met = [(j, i) for i in range(n) for j in range(i) if block[i] == block[j] and (max(side[k] for k in range(n) if block[k] == block[i]) == 0 or side[i] != side[j]) and comp[i] != comp[j]]
    want = {(j, i) for j, i in met if 7 * len(np.intersect1d(sets[i], sets[j])) >= 3 * (len(sets[i]) + len(sets[j]))}
    found = tree_pairs(sets, block, side, comp)
    assert want and want <= found <= set(met)
    assert len(found) < max(len(met) / 2, 2 * len(want))


def test_spanning_pairs_join_what_all_pairs_join():
    sets = token_sets(6)
    block, zero = [i % 5 for i in range(len(sets))], [0] * len(sets)
    every, few = tree_pairs(sets, block, zero, range(len(sets))), tree_pairs(sets, block, zero, range(len(sets)), True)

    def groups(pairs):
        up = list(range(len(sets)))
        for a, b in sorted(pairs):
            x, y = up[a], up[b]
            up = [min(x, y) if u in (x, y) else u for u in up]
        return up

    assert few <= every and groups(few) == groups(every) and len(few) < len(sets) * 2


def test_size_classes_keep_similar_sizes_near():
    for n in range(1, 3000):
        assert signature_tree.size_class(4 * n // 3) - signature_tree.size_class(n) <= 1
    assert all(8 * len(signature_tree.signature(np.arange(n, dtype=np.uint64))) >= min(n, 65536) for n in (1, 7, 300, 40_000, 90_000))


@pytest.mark.parametrize("chunk", [1024, 4])
def test_every_link_comes_from_the_trees(spark, monkeypatch, chunk):
    """With the trees of one round silenced the other finds every component; with those of both, none is found."""
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    whole = ngram_join.candidates
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(60)) for _ in range(6)]
    rows = [(i, base[i % 6] + "".join(f" x{i}y{k}" for k in range(i % 7))) for i in range(90)]
    docs = frame(spark, rows)

    def components(*rounds):
        def some(texts, hot, first_round):
            found = whole(texts, hot, first_round)
            return found if (1 if first_round else 2) in rounds else found.limit(0)

        monkeypatch.setattr(ngram_join, "candidates", some)
        return sorted((r.doc_id, r.component_id) for r in ngram_join.link_documents(docs).collect())

    both, second, neither = components(1, 2), components(2), components()
    assert both == second and len({c for _, c in both}) == 6
    assert len({c for _, c in neither}) == len({t for _, t in rows})


@pytest.mark.parametrize("region,exact", [(1 << 19, 64 << 20), (4000, 1 << 12)])
def test_pairs_that_nearly_link_do_not_grow_with_the_square_of_their_group(spark, monkeypatch, region, exact):
    """Texts of which two share some 0.6 to 0.75 of their shingles, and a few links among them; a doc_id that repeats."""
    monkeypatch.setattr(ngram_join, "REGION", region)
    monkeypatch.setattr(signature_tree, "EXACT_BYTES", exact)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]

    def near(k, words=base):
        words = list(words)
        for j in range(k):
            words[8 + 45 * j + rng.randint(0, 35)] = f"x{rng.random()}"
        return words

    found = [near(3) for _ in range(80)]
    found += [near(1, w) for w in found[:20]]
    rows = [(i, " ".join(w)) for i, w in enumerate(found)] + [(7, "a text that is of another length " * 2), (500, "a text that is of another length " * 2)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    up = {i: i for i, _ in rows}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            x, y = up[rows[i][0]], up[rows[j][0]]
            if x != y and 100 * len(a & b) >= 75 * len(a | b):
                up = {k: min(x, y) if v in (x, y) else v for k, v in up.items()}
    whole, made = ngram_join.candidates, []

    def counted(texts, hot, first_round):
        out = whole(texts, hot, first_round)
        if not first_round:
            made.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "candidates", counted)
    got = {(r.doc_id, r.component_id) for r in ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(up.items()) and 20 < len(set(up.values())) < len(up)
    assert made[0] < 10 * len(rows)  # before: nearly all pairs of them, once for each of several blocks


@pytest.mark.parametrize("hot", [False, True])
def test_substring_dedup_matches_brute_force(spark, monkeypatch, hot):
    if hot:  # every minimiser is sent the way of frequent ones
        monkeypatch.setattr(substring_dedup, "HOT_ROWS", 1)
    rows = texts(2)
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (doc, _), w in zip(rows, words):
        if doc is not None:
            for i in range(len(w) - 12):
                first[tuple(w[i : i + 13])] = min(first.get(tuple(w[i : i + 13]), doc), doc)
    want = []
    for (doc, _), w in zip(rows, words):
        gone = {k for i in range(len(w) - 12) if doc is not None and first[tuple(w[i : i + 13])] < doc for k in range(i, i + 13)}
        want.append((doc, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [tuple(r) for r in substring_dedup.remove_repeats(frame(spark, rows).repartition(3)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[2] for r in got) > 0
    assert substring_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_survey_knows_every_repeated_minimiser(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_ROWS", 3)
    rng = random.Random(12)
    rows = [(" ".join(f"w{rng.randint(0, 7)}" for _ in range(60)),) for _ in range(90)] + [(None,), ("",), ("a b",)]
    known, size = substring_dedup.survey(spark.createDataFrame(rows, "text string").repartition(4))
    raw = np.frombuffer("".join(f"{t or ''} " for t, in rows).encode(), np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(t or "") + 1 for t, in rows])))
    keys, n = np.unique(substring_dedup.super_kmers(substring_dedup.Words(raw, bounds))[3], return_counts=True)
    repeated, hot = known.split(keys)
    assert set(keys[n >= 3].tolist()) <= set(keys[hot].tolist()) and not hot[n < 3].any()
    assert (repeated | hot)[n > 1].all() and not (repeated & hot).any() and (repeated | hot)[n == 1].mean() < 0.3 and size > 0


def brute_decontamination(rows, items):
    known = {}
    for item, t in items:
        w = NORMAL.findall((t or "").translate(LOWER))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            known.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, t in rows:
        w = NORMAL.findall((t or "").translate(LOWER))
        hit, named = set(), set()
        for n in {len(k) for k in known}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in known:
                    hit |= set(range(i, i + n))
                    named |= {str(x) for x in known[tuple(w[i : i + n])] if x is not None}
        out.append((doc, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("limit", [1 << 25, 0])
def test_decontamination_matches_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "fits_broadcast", lambda df, size: limit > 0)
    rows = texts(3) + [(200, "Was it, THE one two three?"), (201, "the one TWO"), (202, "é É ü x y"), (203, "É é")]
    items = [(1, texts(3)[5][1]), (2, "the one two"), (12, "The ONE, two!"), (3, None), (4, ""), (5, "É é"), (None, "x y"), (6, texts(3)[7][1])]
    got = [tuple(r) for r in decontam.report(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted(brute_decontamination(rows, items), key=str)


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontam.report(frame(spark, [(1, "a b")]), none).collect()] == [0]
    assert decontam.report(frame(spark, []), none).count() == 0


def test_decontamination_removes(spark):
    docs = spark.createDataFrame([(1, "keep this text"), (2, "so the One two is here"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the one TWO")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.decontaminate(docs, items).collect()) == [1, 3]
    spans = {r.doc_id: r.clean_text for r in decontam.decontaminate(docs, items, remove="spans").collect()}
    assert spans[2] == "so is here" and spans[1] == "keep this text"


def test_line_dedup(spark):
    rows = [(i, "menu\n  menu \nown %d\n" % i, "a") for i in range(10)] + [(20, "menu", "b"), (21, None, "a"), (22, "", None), (23, "menu\nx", None)]
    out = {r.doc_id: r for r in line_dedup.drop_boilerplate(frame(spark, rows, "doc_id long, text string, source string"), ratio=0.5).collect()}
    assert out[3].text == "own 3\n" and out[3].lines_dropped == 2
    assert out[20].text == "menu" and out[21].text is None and out[22].text == "" and out[23].text == "menu\nx"
    assert line_dedup.drop_boilerplate(frame(spark, [], "doc_id long, text string, source string")).count() == 0


def test_mixing_meets_its_budget(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(1, 90)) if i % 11 else None, rng.choice(["a", "b", "c", "d", None])) for i in range(400)]
    rows += [(7, "x y z", "a"), (None, "x y", "b"), (8, "", "e")]
    docs = frame(spark, rows, "doc_id long, text string, source string").drop("size")
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes, order = {}, sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, open_, budget = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        level = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] < level * weight[s]}
        if not full:
            break
        want |= {s: 2.0 * sizes[s] for s in full}
        budget -= sum(2 * sizes[s] for s in full)
        open_ -= full
    want |= {s: level * weight[s] for s in open_}
    assert len(got) == len(rows)
    for s in order:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 1
        assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in mine)
    assert mixing.mix(frame(spark, [], "doc_id long, text string, source string")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_knapsack_is_exact_where_it_can_be(seed):
    rng = np.random.default_rng(seed)
    sizes, counts = np.unique(rng.integers(1, 60, 12)), None
    counts = rng.integers(1, 9, len(sizes))
    total = int((sizes * counts).sum())
    for budget in rng.integers(0, total + 5, 20).tolist():
        take = mixing.fit_counts(sizes, counts, budget, reserve=200)
        assert (take >= 0).all() and (take <= counts).all()
        reach = {0}
        for s, n in zip(sizes.tolist(), counts.tolist()):
            reach = {r + k * s for r in reach for k in range(n + 1) if r + k * s <= budget}
        assert int((take * sizes).sum()) == max(reach)


@pytest.mark.parametrize("seed", range(8))
def test_knapsack_takes_back_where_that_fits(monkeypatch, seed):
    monkeypatch.setattr(mixing, "WHOLE", 0)
    rng = np.random.default_rng(seed)
    sizes = np.unique(rng.integers(1, 90, 10))
    counts = rng.integers(1, 12, len(sizes))
    for budget in rng.integers(0, int((sizes * counts).sum()) + 5, 20).tolist():
        take = mixing.fit_counts(sizes, counts, budget, reserve=2000)
        reach = {0}
        for s, n in zip(sizes.tolist(), counts.tolist()):
            reach = {r + k * s for r in reach for k in range(n + 1) if r + k * s <= budget}
        assert (take >= 0).all() and (take <= counts).all() and int((take * sizes).sum()) == max(reach)


def test_targets_of_many_sources_match_a_loop(spark):
    rng = random.Random(2)
    sizes = {f"s{i:03d}": rng.choice([0, 1, 3, rng.randint(1, 5000)]) for i in range(200)} | {None: 70}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, open_, budget = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        level = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] < level * weight[s]}
        if not full:
            break
        want |= {s: 2.0 * sizes[s] for s in full}
        budget -= sum(2 * sizes[s] for s in full)
        open_ -= full
    want |= {s: level * weight[s] for s in open_}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)).collect()}
    assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "x" * 120
    rows = [(5, "http://a.example/x?y#z", big), (2, "http://b.example/", big), (9, None, big), (3, "http://c.example/a\r\nb", "short"), (4, "u", "short"), (6, "v", None), (7, "w", ""), (None, "n", big), (2, "http://b.example/", big)]
    got = warc.round_trip(frame(spark, rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and all(r.has_request and r.has_metadata for r in got)
    for page, _, html in rows:
        data = (html or "").encode()
        mine = [r for r in got if r.page_id == page]
        assert mine and all((r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest()) for r in mine)
        kind = "revisit" if html == big and page != 2 else "response"
        assert all(r.record_type == kind and r.refers_to == (2 if kind == "revisit" else None) for r in mine)
    assert warc.round_trip(frame(spark, [], "page_id long, url string, html string")).count() == 0


def test_warc_blocks_and_broken_archives(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write(spark.createDataFrame([(1, "http://a.example/", "<p>hé</p>")], "page_id long, url string, html string"), path)
    row = warc.assemble(warc.records(spark, path)).first()
    assert bytes(row.response.block).endswith("\r\n\r\n<p>hé</p>".encode()) and row.request.kind == "request"
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parse(b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 9\r\n\r\nabc"))


def test_warc_archives_are_members_of_bounded_size(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/w"
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    noise = "".join(chr(0x4E00 + (i * i) % 9000) for i in range(6_000_000))  # 18 MB: the member doesn't end with a NUL by itself
    rows = [(i, f"http://a.example/{i}", f"{i} " + noise[i * 50 : i * 50 + 2000]) for i in range(60)] + [(99, "http://a.example/99", noise), (100, "http://a.example/100", noise)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), path)
    files = sorted((tmp_path / "w").rglob("part-*.txt"))
    assert len(files) > 6
    kinds, ids, refers = [], {}, []
    for f in files:
        data, first = f.read_bytes(), True
        while data:
            member = zlib.decompressobj(31)
            text, data = member.decompress(data), member.unused_data
            if not text:
                continue
            ((headers, block),) = warc.parse(text)  # one record in each member
            assert (headers["warc-type"] == "warcinfo") == first
            assert headers["warc-type"] == "warcinfo" or headers["warc-block-digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
            kinds.append(headers["warc-type"])
            ids[headers["warc-record-id"]] = headers
            refers.append(headers.get("warc-refers-to"))
            first = False
    assert kinds.count("response") == 61 and kinds.count("revisit") == 1 and kinds.count("warcinfo") == len(files) and len(ids) == len(kinds)
    (target,) = set(refers) - {None}
    assert ids[target]["warc-type"] == "response" and ids[target]["x-page-id"] == "99"
    got = warc.assemble(warc.records(spark, path, with_blocks=False))
    assert got.where("request is not null and metadata is not null").count() == 62 and warc.dangling(warc.records(spark, path, with_blocks=False)).count() == 0


def test_warc_ties_go_either_way(spark):
    rows = [("a", "response", "b"), ("b", "request", None), ("c", "metadata", "a"), ("d", "request", "x"), ("e", "revisit", None), ("f", "request", "e"), ("g", "request", "e"), ("h", "warcinfo", None), ("i", "metadata", None)]
    found = spark.createDataFrame([(i, k, c, None, None, None, None, None, None) for i, k, c in rows], warc.RECORD_SQL)
    got = {r.capture_id: (r.request and r.request.record_id, r.metadata and r.metadata.record_id) for r in warc.assemble(found).collect()}
    assert got == {"a": ("b", "c"), "e": ("f", None)}
    assert sorted(r.record_id for r in warc.dangling(found).collect()) == ["d", "i"]


def test_html_extraction_cases(spark):
    def page(i, body):
        return f"<html><head><title>t</title></head><body><nav>m{i}</nav><div class='ad'>buy {i}</div><article><h1>Title {i}</h1>{body}<p>Share this page</p><div class='comments'>c{i}</div></article><footer>f {i}</footer></body></html>"

    rows = [(i, f"http://h.example/{i}", page(i, f"<p>Text&nbsp;&amp;  more\n{i}<p>second {i}<script>var x='<p>';</script>")) for i in range(8)]
    rows += [(50, None, "<p>lone"), (51, "::bad", None), (52, "http://h.example/x", ""), (53, "http://z.example/", "a < b"), (0, rows[0][1], rows[0][2])]
    got = {r.page_id: r for r in html_extract.main_text(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "Title 3\nText & more 3\nsecond 3" and got[3].n_chars == len(got[3].text)
    assert got[50].text == "lone" and got[51].text == "" and got[52].text == "" and got[53].text == "a < b"
    assert html_extract.main_text(frame(spark, [], "page_id long, url string, html string")).count() == 0


def test_simple_tree_matching_aligns():
    a = html_extract.slots([html_extract.parse("<div><p>x</p><ul><li>1</ul><h2>y</h2></div>")])
    b = html_extract.slots([html_extract.parse("<div><h3>new</h3><p>x</p><h2>z</h2></div>")])
    assert html_extract.match(a, b)[0] == 4  # root, div, p, h2


def brute_match(a, b):
    """The size of the best alignment, by trying every choice of the last children."""
    if a.label != b.label:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[:-1], y), best(x, y[:-1]), best(x[:-1], y[:-1]) + brute_match(x[-1], y[-1]))

    return 1 + best(a.kids, b.kids)


@pytest.mark.parametrize("seed", range(5))
def test_tree_matching_is_best_and_keeps_order(seed):
    rng = random.Random(seed)

    def tree(depth):
        kids = "".join(tree(depth - 1) for _ in range(rng.randint(0, 4))) if depth else ""
        tag = rng.choice(["div", "section", "ul"])
        return f"<{tag}>{kids}</{tag}>"

    for _ in range(20):
        a, b = (html_extract.slots([html_extract.parse(f"<body>{tree(3)}</body>")]) for _ in "ab")
        size, pairs = html_extract.match(a, b)
        assert size == brute_match(a, b) and size == 1 + sum(brute_match(x, y) for x, y in pairs)
        places = [(a.kids.index(x), b.kids.index(y)) for x, y in pairs]
        assert places == sorted(places) and len({i for i, _ in places}) == len({j for _, j in places}) == len(places)


def test_template_texts_are_those_on_nearly_every_page():
    rng = random.Random(4)
    pages, lines = [], []
    for i in range(20):
        lines.append([t for t, share in (("always", 1.0), ("often", 0.5), ("rarely", 0.1)) if rng.random() < share])
        pages.append("<body><div>" + "".join(f"<h6>{t}</h6>" for t in lines[-1]) + f"<p>story {i} of this page</p></div></body>")
    wrapper = html_extract.induce(pages)
    assert [html_extract.extract(p, wrapper) for p in pages] == ["\n".join([t for t in kept if t != "always"] + [f"story {i} of this page"]) for i, kept in enumerate(lines)]


def test_html_of_any_depth_and_length():
    deep = "<div>" * 100_000 + "<p>in</p>" + "</div>" * 100_000 + "<p>out</p>"
    wrapper = html_extract.Slot.load(json.loads(json.dumps(html_extract.induce([deep, deep + " ", deep + "<p>more</p>"]).dump())))
    assert html_extract.extract(deep, wrapper) == "in\nout"
    nav = "<div>" * 400 + "a<nav>no<b>no</b></nav>b" + "</div>" * 400 + "c c c c"
    assert html_extract.extract(nav, None) == "a\nb\nc c c c"
    began = time.time()
    assert html_extract.extract("x" + "<a " * 1_700_000, None).startswith("x<a <a")  # 5 MB that never close
    assert html_extract.extract('<a "' * 500_000 + ">t", None) == "t"
    html_extract.extract("<script></script " * 200_000, None)
    long = "".join(f"<h2>{i}</h2><p>text {i}</p>" for i in range(40_000))
    got = html_extract.extract(long, html_extract.induce([long, long + "<p>y</p>", "<p>z</p>" + long]))
    assert got.startswith("0\ntext 0\n1\n") and got.endswith("39999\ntext 39999")
    assert time.time() - began < 60


def test_class_words_yield_to_the_pages(spark):
    def page(i, name):
        body = " ".join(f"word{(i * 7 + k) % 91}" for k in range(40))
        return f"<body><div class='menu'>home {i}</div><article><h1>Title {i}</h1><div class='{name}'><p>{body}</p></div><p>end {i}</p><div class='share-buttons'>post it {i}</div><div class='comments'>{body} {body} said {i}</div></article></body>"

    names = ["share-price", "search-results", "related-work", "notice", "widget", "plain"]
    rows = [(n * 100 + i, f"http://h{n}.example/{i}", page(i, name)) for n, name in enumerate(names) for i in range(8)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert len({got[n * 100 + i] for n in range(len(names))}) == 1
        assert got[i].startswith(f"Title {i}\nword") and got[i].endswith(f"\nend {i}")


def test_copies_of_a_page_leave_its_host_a_wrapper(spark):
    page = lambda i: f"<body><div><h1>Title {i}</h1><p>Site slogan here</p><p>Unique text {i} about things</p></div></body>"
    rows = [(i, f"http://h.example/{i}", page(min(i, 7))) for i in range(4000)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {min(i, 7)}\nUnique text {min(i, 7)} about things" for i in range(4000))


def test_every_page_counts_for_its_hosts_template(spark):
    """A line on the 64 pages of the smallest hashes only is no template text; one on 90 % of all pages is."""
    page = lambda i, line: f"<body><div><h1>Title {i}</h1><h6>{line}</h6><p>Unique text {i} about things</p></div></body>"
    hashed = lambda pages: [tuple(r) for r in spark.createDataFrame([(p,) for p in pages], "html string").select(F.xxhash64("html").alias("o"), "html").orderBy("o").collect()]
    smallest = hashed(page(i, "Always here") for i in range(2000))[:64]
    others = [p for o, p in hashed(page(2000 + i, f"Said once {i}") for i in range(300)) if o > smallest[-1][0]]
    pages = [p for _, p in smallest] + others
    rows = [(i, "http://h.example/", p) for i, p in enumerate(pages)] + [(1000 + i, "http://g.example/", page(i, "Always here" if i % 20 else "Seldom")) for i in range(300)]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(others) > 200 and all("Always here" in got[i] for i in range(64)) and all("Said once" in got[64 + i] for i in range(len(others)))
    assert all(("Seldom" in got[1000 + i]) == (i % 20 == 0) and "Always" not in got[1000 + i] and f"Unique text {i} " in got[1000 + i] for i in range(300))


def test_licenses(spark):
    mit = licenses.LICENSES["MIT"]
    varied = mit.replace("<year> <copyright holders>", "2019 Jane Doe").upper().replace("\n", " \n ").replace("SUBLICENSE", "SUB-LICENCE")
    rows = [(1, mit), (2, varied), (3, mit + " more"), (4, None), (5, ""), (6, "text\nLicensed under the Apache License, Version 2.0.\nSPDX-License-Identifier: MIT"), (1, mit)]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert got[1].license_id == got[2].license_id == "MIT" and got[3].license_id is None
    assert got[4].canonical_sha256 == hashlib.sha256(b"").hexdigest() == got[5].canonical_sha256
    assert got[6].notices == "Apache-2.0,MIT"
    for doc, t in rows:
        assert got[doc].canonical_sha256 == licenses.digest(t)
    assert licenses.scan(frame(spark, [])).count() == 0


def test_license_lines_in_any_case_and_full_texts(spark):
    lines = {1: ("RELEASED UNDER THE MIT LICENSE.", "MIT"), 2: ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), 3: ("Re-leased under the MIT Li-cense.", "MIT"), 4: ("spdx-license-identifier: agpl-3.0-only", "AGPL-3.0-only"), 5: ("a cense or a lien", "")}
    names = ["Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0"]
    rows = [(i, f"text\n{line}\nmore") for i, (line, _) in lines.items()] + [(100 + i, licenses.LICENSES[n].replace(" ", "  ")) for i, n in enumerate(names)]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert {i: got[i].notices for i in lines} == {i: name for i, (_, name) in lines.items()}
    assert [got[100 + i].license_id for i in range(len(names))] == names
    every = [(licenses.digest(x), n) for n, xs in licenses.NOTICES.items() for x in xs]
    assert len({d for d, _ in every}) == len(every) and all(licenses.NOTICE_PART in licenses.canonical_text(x) for xs in licenses.NOTICES.values() for x in xs)


def test_language_id(spark):
    rng = random.Random(6)
    vocab = {"xx": "lorem ipsum dolor sit amet", "yy": "zwei drei vier funf sechs", "zz": "ключ слово текст дом"}
    rows = [(i, " ".join(rng.choice(vocab[lang].split()) for _ in range(rng.randint(3, 40))), lang) for i, lang in ((i, rng.choice(list(vocab))) for i in range(600))]
    extra = [(1000, None, "xx"), (1001, "", "xx"), (1002, "123 !?", None), (None, "lorem", "yy"), (1003, "dolor sit", None)]
    docs = frame(spark, rows + extra, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert 90 < len(held) < 210
    assert sum(got[i].lang_pred == lang for i, _, lang in held) / len(held) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "xx" and 0 <= got[1003].score <= 1 and not got[None].held_out
    empty = frame(spark, [], "doc_id long, text string, lang string")
    assert langid.fit(empty) is None and langid.predict(empty, None).count() == 0


def test_language_id_trains_on_executors(spark, monkeypatch):
    """The driver gets the model alone; it holds neither the sample nor the state of training."""
    rows = [(i, ("lorem ipsum dolor" if i % 2 else "zwei drei vier") + " x" * (i % 5), "xx" if i % 2 else "yy") for i in range(80)]
    docs = frame(spark, rows, "doc_id long, text string, lang string")

    def never(*_):
        raise AssertionError("trained in the driver")

    monkeypatch.setattr(langid, "train_ftrl", never)
    model = langid.fit(docs)
    assert model.labels == ["xx", "yy"] and model.weights.shape == (langid.DIMENSIONS, 2) and model.idf.shape == (langid.DIMENSIONS,)
    assert all(r.lang_pred == ("xx" if r.doc_id % 2 else "yy") for r in langid.predict(docs, model).collect())


def test_ftrl_matches_a_plain_loop():
    """Per-coordinate FTRL-proximal with elastic net, one weight at a time, on the same order of rows."""
    rng = random.Random(8)
    rows, y = [], []
    for i in range(30):
        bins = sorted(rng.sample(range(12), 4))
        rows.append((np.array(bins), np.array([rng.random() + 0.1 for _ in bins])))
        y.append(sum(bins) % 3)
    alpha, beta, l1, l2 = 0.7, 1.0, 0.05, 0.1
    weights, bias = langid.train_ftrl(rows, np.array(y), 3, alpha, beta, l1, l2, epochs=2, seed=5)
    z, n = {}, {}

    def weight(j, c):
        one, two = (0.0, 0.0) if j == "bias" else (l1, l2)
        zj, nj = z.get((j, c), 0.0), n.get((j, c), 0.0)
        return 0.0 if abs(zj) <= one else -(zj - (1 if zj > 0 else -1) * one) / ((beta + nj**0.5) / alpha + two)

    order = np.random.default_rng(5)
    for _ in range(2):
        for i in order.permutation(len(rows)):
            x = dict(zip(rows[i][0].tolist(), rows[i][1].tolist())) | {"bias": 1.0}
            now = {(j, c): weight(j, c) for j in x for c in range(3)}
            score = [sum(v * now[j, c] for j, v in x.items()) for c in range(3)]
            e = [np.exp(s - max(score)) for s in score]
            for j, v in x.items():
                for c in range(3):
                    g = v * (e[c] / sum(e) - (c == y[i]))
                    sigma = ((n.get((j, c), 0.0) + g * g) ** 0.5 - n.get((j, c), 0.0) ** 0.5) / alpha
                    z[j, c] = z.get((j, c), 0.0) + g - sigma * now[j, c]
                    n[j, c] = n.get((j, c), 0.0) + g * g
    assert np.allclose(weights[:12], [[weight(j, c) for c in range(3)] for j in range(12)]) and not weights[12:].any()
    assert np.allclose(bias, [weight("bias", c) for c in range(3)]) and (weights[:12] == 0).any()


def test_temperature_has_the_least_loss():
    rng = np.random.default_rng(1)
    scores, y = rng.normal(size=(200, 4)) * 6, rng.integers(0, 4, 200)
    scores[np.arange(200), y] += 4
    right, rest = 201 / 202, (1 - 201 / 202) / 3

    def loss(t):
        p = np.log(langid.softmax(scores / t))
        return -(rest * p.sum(axis=1) + (right - rest) * p[np.arange(200), y]).mean()

    best = langid.fit_temperature(scores, y)
    assert all(loss(best) <= loss(t) + 1e-9 for t in np.geomspace(0.03, 19, 200))


def test_licenses_of_a_registry_table(spark):
    registry = spark.createDataFrame([("ours", "You may NOT copy this work."), ("also-ours", "you may not copy this work"), ("none", None)], "license_id string, text string")
    docs = frame(spark, [(1, "Copyright 2020 Us\nYou may not copy this work!"), (2, "You may copy this work."), (3, licenses.LICENSES["MIT"])])
    assert {r.doc_id: r.license_id for r in licenses.scan(docs, registry).collect()} == {1: "also-ours", 2: None, 3: None}


def test_vector_search_recall_and_cases(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [1.0]), (2004, [None] + [1.0] * 15), (2005, [float("inf")] * 16), (0, x[0].tolist())]
    got = ann_aq.search(frame(spark, rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, 20).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == set(range(0, 900, 20))
    exact = x.astype(float) @ x.astype(float).T
    recall = []
    for q, found in by.items():
        order = [i for i in np.lexsort((np.arange(900), -exact[q])) if i != q][:20]
        recall.append(len({v for v, _ in found} & set(order)) / 20)
        assert all(abs(s - exact[q, v]) < 1e-9 for v, s in found) and [s for _, s in found] == sorted((s for _, s in found), reverse=True)
    assert np.mean(recall) >= 0.9
    assert ann_aq.search(frame(spark, [], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0
    few = ann_aq.search(frame(spark, rows[:3], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0)
    assert sorted(r.vec_id for r in few.collect()) == [1, 2]


def brute_neighbours(rows, is_query, k):
    x = {i: np.asarray(v, float) for i, v in rows}
    out = {}
    for q in filter(is_query, x):
        scored = sorted((-float(sum(a * b for a, b in zip(x[q], x[i]))), i) for i in x if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("scale", [1.0, 1e25, 1e-30])
def test_vector_search_with_copies_ties_and_any_magnitude(spark, scale):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(8, 6)).round(3) * scale
    rows = [(i, (base[0] if i % 2 else base[i // 2 % 8]).tolist()) for i in range(1000)]  # half of all rows are one vector
    got = ann_aq.search(frame(spark, rows, "vec_id long, embedding array<double>").repartition(5), F.col("vec_id") % 100 == 0, 20, rerank=30).collect()
    want = brute_neighbours(rows, lambda i: i % 100 == 0, 20)
    for q, best in want.items():
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert [(i, s) for _, i, s in mine] == best


def test_recall_on_fifty_thousand_vectors():
    """Vectors without clusters, as hard as the given ones: the best 20 of 51,000 among 384 candidates."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(51_000, 64)).astype(np.float32)
    directions, lengths = ann_aq.units(x)
    books = ann_aq.train(directions[: ann_aq.SAMPLE])
    codes = ann_aq.encode(directions, books)
    norms = np.sqrt((ann_aq.reconstruct(codes, books) ** 2).sum(1))
    at = np.arange(0, 51_000, 1020)
    near = ann_aq.approximate(directions[at], lengths[at], codes, lengths, norms, books, False)
    exact = x[at].astype(float) @ x.astype(float).T
    near[np.arange(len(at)), at] = exact[np.arange(len(at)), at] = -np.inf
    kept = ann_aq.cut(near, np.broadcast_to(np.arange(len(x)), near.shape), ann_aq.RERANK)[1]
    best = np.argsort(-exact, axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(kept.tolist(), best.tolist())]) >= 0.9


def test_cut_prefers_small_ids_among_equals():
    scores, ids = np.array([[1.0, 2.0, 2.0, 2.0, 0.0], [5.0, 4.0, 3.0, 2.0, 1.0]]), np.array([[9, 8, 2, 5, 1]] * 2)
    assert [sorted(r) for r in ann_aq.cut(scores, ids, 2)[1].tolist()] == [[2, 5], [8, 9]]
