"""Each operator against its plain version, over a table with nulls, ties, copies, long texts and clashing columns."""

import html as entities
import random
import textwrap
import time
import tracemalloc
from collections import Counter, defaultdict

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import components, decontam, group_join, html_tree, licenses, line_dedup, lm_score, mixing, quality, sharding, suffix_dedup, words

TEXTS = brute.corpus()
ROWS = list(enumerate(TEXTS))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, token string, run string, h string, id long, doc_id_ long, lang_ string, source_ string, shard int"


def frame(spark, rows):
    """Rows of (doc_id, text) with columns whose names the operators use inside."""
    out = [(i, t, None if i is not None and i % 5 == 0 else "en", None if i is not None and i % 4 == 0 else f"s{(i or 0) % 3}", 1, 2, "t", "r", "h", 7, 8, "l", "s", 9) for i, t in rows]
    return spark.createDataFrame(out, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def test_words_and_windows_do_not_depend_on_blocks(monkeypatch):
    texts = [(t or "").encode() for t in TEXTS]
    whole = {k + j: w.hashes[w.first[j] : w.first[j + 1]] for k, w in words.words(texts, words.SPACED) for j in range(len(w.first) - 1)}
    monkeypatch.setattr(words, "BLOCK", 100)
    parts = {k + j: w.hashes[w.first[j] : w.first[j + 1]] for k, w in words.words(texts, words.SPACED) for j in range(len(w.first) - 1)}
    assert whole.keys() == parts.keys() == set(range(len(texts)))
    for k, t in enumerate(TEXTS):
        w = brute.SPACED.findall(brute.fold(t))
        assert len(whole[k]) == len(w) and (whole[k] == parts[k]).all() and len(set(w)) == len(set(whole[k].tolist()))


def test_suffix_order_sorts_and_finds_repeats():
    r = np.random.default_rng(2)
    for n in (1, 7, 60, 300):
        for letters in (1, 2, 4):
            s = bytes(r.integers(97, 97 + letters, n).astype(np.uint8)) + b"\xff"
            got = [s[i : i + 16] for i in suffix_dedup.suffix_order(np.frombuffer(s, np.uint8), 16)]
            assert got == sorted(got) and len(got) == len(s)
    pieces = [b"abcdefgh12345678", b"xabcdefgh1234567", b"zzzz", b"abcdefgh12345678"]
    count = Counter(p[i : i + 8] for p in pieces for i in range(len(p) - 7))
    assert suffix_dedup.repeated(pieces, 8) == [sum(1 << i for i in range(max(0, len(p) - 7)) if count[p[i : i + 8]] > 1) for p in pieces]


@pytest.mark.parametrize("fit", [2000, 1])
def test_suffix_dedup(docs, fit, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "FIT", fit)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digest(docs).collect()}
    assert got == dict(enumerate(brute.suffix(TEXTS)))


def test_suffix_dedup_of_repeated_rows(spark):
    rows = [(1, "ab" * 150), (1, "ab" * 150), (1, "other " * 5), (None, "cd" * 150), (2, "cd" * 150)]
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.digest(frame(spark, rows)).collect())
    assert got == Counter({(1, 300, 300): 2, (1, 30, 0): 1, (None, 300, 300): 1, (2, 300, 300): 1})
    began = time.time()
    many = frame(spark, [(1, TEXTS[-4])] * 3000 + [(2, TEXTS[-4][:-5] + "other")]).repartition(4)
    assert {(r["n_bytes"] - r["n_removed"]) for r in suffix_dedup.digest(many).collect()} == {0, 5}
    assert time.time() - began < 60


def test_jaccard_groups(docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in group_join.joined(docs).collect()}
    assert got == {i: (len(brute.shingles(t)), c) for (i, t), c in zip(ROWS, brute.groups(ROWS).values(), strict=True)}
    kept = group_join.one_of_each(docs)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(set(brute.groups(ROWS).values())) and kept.columns == docs.columns


def test_jaccard_groups_with_common_tokens_last(spark, monkeypatch):
    monkeypatch.setattr(group_join, "OFTEN", 2)
    monkeypatch.setattr(group_join, "GROUP", 2)
    rows = [(100 - i, t) for i, t in enumerate(brute.corpus(3))]
    got = {r["doc_id"]: r["component_id"] for r in group_join.joined(frame(spark, rows)).collect()}
    assert got == brute.groups(rows)


def test_components(spark):
    pairs = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5), (None, 1)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}


@pytest.mark.parametrize("limit", [1 << 20, 10])
def test_decontamination(spark, docs, limit):
    items = [(1, brute.corpus()[8]), (2, "one"), (3, None), (4, " ".join(TEXTS[11].split()[20:40])), (None, "One two"), (5, ""), (2, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in decontam.judged(docs, bench, limit=limit).collect()}
    assert got == dict(enumerate(brute.contaminated(TEXTS, items)))
    kept = decontam.without_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not g[-1] for g in got.values())
    cut = decontam.without_spans(docs, bench)
    assert cut.columns == docs.columns
    left = decontam.judged(cut, spark.createDataFrame(items[:1], "item_id long, text string"))
    assert left.agg(F.sum("n_hit")).first()[0] == 0


def test_quality(docs):
    got = {r["doc_id"]: r for r in quality.quality_rules(docs).collect()}
    for i, t in ROWS:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.measures(t)
        assert not (r["kept"] and r["base_failed"])
    assert not got[len(TEXTS) - 1]["kept"] and got[8]["kept"]
    assert sorted(r["doc_id"] for r in quality.kept_rows(docs).select("doc_id").collect()) == sorted(i for i, r in got.items() if r["kept"])


def test_quality_sketches_merge(spark):
    rows = spark.range(1000).selectExpr("'en' as lang", "cast(id % 2 as string) as source", "(id + 1) / 10.0D as mark_ratio", "0.0D as repetition", "5.0D as mean_word", "id as n_words")
    s = quality.sketches(rows, ["lang", "source"])
    q = {r["measure"]: r for r in quality.quartiles(quality.merged(s, ["lang"]), ["lang"]).collect()}
    assert q["mark_ratio"]["rows"] == 1000 and abs(q["mark_ratio"]["q1"] - 25) < 0.6 and abs(q["mark_ratio"]["q3"] - 75) < 1.6
    assert q["repetition"]["q3"] == 0 and abs(q["n_words"]["q2"] - 500) < 10


def test_quality_limits_follow_the_group(spark):
    def text(r, marks, n):
        return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) + ("," if r.random() < marks else "") for _ in range(n))

    r = random.Random(5)
    rows = [(i, "en", s, text(r, marks, r.randint(60, 300))) for i, (s, marks) in enumerate([("prose", 0.1), ("tables", 0.8)] * 300)]
    odd = [(1000, "en", "prose", text(r, 0.8, 150)), (1001, "en", "tables", text(r, 0.8, 150)), (1002, "en", "prose", text(r, 0.1, 25)), (1003, "en", "prose", " ".join(["word"] * 6 + [str(i) for i in range(20)]) + " x" * 60), (1004, "en", "few", text(r, 0.1, 90))]
    odd += [(1005, None, None, None), (1006, "en", "prose", "")]
    docs = spark.createDataFrame([*rows, *odd], "doc_id long, lang string, source string, text string")
    judged = {x["doc_id"]: x for x in quality.quality_rules(docs).collect()}
    assert not judged[1000]["kept"] and judged[1001]["kept"] and judged[1002]["kept"] and not judged[1003]["kept"] and judged[1004]["kept"]
    assert not judged[1005]["kept"] and not judged[1006]["kept"]
    assert judged[0]["mark_ratio_hi"] < judged[1]["mark_ratio_hi"] and judged[1002]["mark_ratio_hi"] > judged[1000]["mark_ratio_hi"]
    assert sum(judged[i]["kept"] for i in range(600)) >= 590


def test_mixing_reaches_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40))) for i in range(600)]
    docs = frame(spark, [*rows, (601, None), (602, "")])
    got = mixing.copies(docs).collect()
    size = defaultdict(int)
    for r in got:
        size[r["source"]] += r["size"]
    wanted = brute.targets(size)
    taken = defaultdict(int)
    for r in got:
        assert abs(r["target"] - wanted[r["source"]]) < 1e-6 and 0 <= r["copies"] <= 3 and r["source_size"] == size[r["source"]]
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(abs(taken[s] - t) <= 20.5 for s, t in wanted.items()) and len(got) == 602
    again = {(r["doc_id"], r["copies"]) for r in mixing.copies(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in got}
    assert mixing.mix(docs).count() == sum(r["copies"] for r in got) and mixing.mix(docs).columns == docs.columns


def test_mixing_keeps_every_documents_expectation(spark):
    docs = frame(spark, [(i, "w " * (5 + i % 3)) for i in range(120)])
    total = Counter()
    for seed in range(6):
        for r in mixing.copies(docs, seed=seed).where("source = 's2'").collect():
            total[r["doc_id"] % 3] += r["copies"]
    assert max(total.values()) <= 1.5 * min(total.values())


def test_mixing_repeated_rows(spark):
    docs = frame(spark, [(1, "a b c")] * 40 + [(2, "a b")] * 3)
    got = mixing.copies(docs)
    assert got.count() == 43 and mixing.mix(docs).count() == got.agg(F.sum("copies")).first()[0]


def test_target_cap(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 100), ("c", 1000), (None, 7)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    wanted = brute.targets({"a": 1, "b": 100, "c": 1000, None: 7})
    assert got.keys() == wanted.keys() and all(abs(got[s] - wanted[s]) < 1e-9 for s in got)


def test_shards_balance_and_slots_have_no_gaps(spark):
    rows = [(i, "x" * (i * 37 % 900)) for i in range(900)] + [(5, "same")] * 30 + [(None, None), (None, "")]
    got = sharding.shards(frame(spark, rows)).collect()
    load, slots = Counter(), defaultdict(list)
    for r in got:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(rows) and sorted(load) == list(range(24)) and max(load.values()) - min(load.values()) <= 2 * 908
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(load.values()) == sum(len(t or "") + 8 for _, t in rows)
    whole = sharding.sharded(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in whole) == Counter(rows) and {(r["shard"], r["slot"]) for r in whole} == {(r["shard"], r["slot"]) for r in got}


def test_decontamination_block_is_small():
    r = random.Random(3)
    items = [(k, " ".join(f"w{r.randrange(10**6)}" for _ in range(200)).encode()) for k in range(500)]
    tracemalloc.start()
    block = decontam.Block(items)
    assert sum(len(x[0]) for x in block.sizes.values()) == 500 * 188 and tracemalloc.get_traced_memory()[0] < 60 * 500 * 188
    tracemalloc.stop()


def test_line_dedup(spark, docs):
    got = {r["doc_id"]: (r["n_equal"], r["n_near"]) for r in line_dedup.counted(docs).collect()}
    assert got == brute.lines(ROWS)
    cleaned = {r["doc_id"]: r["text"] for r in line_dedup.cleaned(docs).collect()}
    assert cleaned[0] is None and cleaned[8] == TEXTS[8]
    rest = line_dedup.counted(line_dedup.cleaned(docs)).agg(F.sum("n_equal")).first()[0]
    assert rest == 0
    same = frame(spark, [(1, TEXTS[8]), (1, TEXTS[8]), (2, TEXTS[8]), (None, TEXTS[8]), (None, "other")])
    kept = [r["text"] for r in line_dedup.cleaned(same).collect()]
    assert Counter(kept) == Counter(["", "", "", TEXTS[8], "other"])
    assert sum(r["n_kept"] for r in line_dedup.counted(same).collect()) == 2


@pytest.mark.parametrize("crowd", [16, 2])
def test_line_dedup_of_short_lines_and_of_several_edits(spark, crowd, monkeypatch):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    r = random.Random(3)
    prose = lambda n: "".join(r.choice("abcdé ") for _ in range(n))

    def edited(line, k):
        for _ in range(k):
            at, kind = r.randrange(len(line)), r.randrange(3)
            line = line[:at] + ("", "#", "#" + line[at])[kind] + line[at + 1 :]
        return line

    bases = [prose(n) for n in (33, 60, 65, 127, 130, 255, 258, 290)]
    bases += [bases[7][:60] + prose(200) for _ in range(3)]
    texts = ["All rights reserved.\n\n \nAll rights reserved.", "All rights reserved.\nx", "x\nX", *bases]
    texts += [edited(b, k) for b in bases for k in (1, 2, 3, 4, 5, 4)]
    rows = list(enumerate(texts))
    got = {x["doc_id"]: (x["n_equal"], x["n_near"]) for x in line_dedup.counted(frame(spark, rows), 4).collect()}
    wanted = brute.lines_within(rows)
    assert got == wanted and sum(e for e, _ in wanted.values()) == 3 and sum(n for _, n in wanted.values()) > 30
    cleaned = {x["doc_id"]: x["text"] for x in line_dedup.cleaned(frame(spark, rows), 4).collect()}
    assert cleaned[0] == "All rights reserved.\n\n " and cleaned[1] == "x" and cleaned[2] == "X"


def test_line_dedup_asks_for_earlier_lines_only(spark):
    crowd = spark.range(30).selectExpr("id AS no", "struct(30 - id AS doc_id, 0 AS line_no) AS at", "80 AS n", "7L AS h", "3 AS has_e")
    for asking, wanted in ((29, 0), (0, 29), (20, 9)):
        got = line_dedup.pairs_of(crowd.where(f"no = {asking}"), crowd, 4)
        assert [r["other"] for r in got.orderBy("other").collect()] == list(range(30))[30 - wanted :]


def test_line_dedup_asks_few_lines_of_a_crowd_of_near_copies(spark, monkeypatch):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(45)]

    def edited(words_, k):
        got = list(words_)
        for at in r.sample(range(45), k):
            got[at] = word()
        return " ".join(got)

    texts = [" ".join(base), *[edited(base, r.choice((1, 2, 3, 3))) for _ in range(40)]]
    texts += [t[:at] + c + t[at + 1 :] for t in texts[::4] for at, c in ((r.randrange(len(t)), "#"), (r.randrange(len(t)), ""))]
    texts += ["x" * 300, "x" * 299, "x" * 290, "ab" * 150, "ab" * 149 + "a", "é" * 2000 + "z", "é" * 2000]
    r.shuffle(texts)
    rows, asked, real = list(enumerate(texts)), [], line_dedup.pairs_of
    monkeypatch.setattr(line_dedup, "pairs_of", lambda *a: asked.append(real(*a).count()) or real(*a))
    got = {x["doc_id"]: (x["n_equal"], x["n_near"]) for x in line_dedup.counted(frame(spark, rows), 4).collect()}
    assert got == brute.lines_within(rows) and sum(n for _, n in got.values()) > 15
    assert sum(asked) < 5 * len(rows)


@pytest.mark.parametrize("own, other, wanted", [([], [], 0), ([0, 8, 30], [], 3), ([0, 40], [4, 80], 3), ([0], [12], 2), ([0], [11], 1), ([0, 8], [0, 8], 2)])
def test_line_dedup_counts_edits_that_are_needed_at_least(spark, own, other, wanted):
    lists = spark.createDataFrame([(own, other)], "own array<int>, other array<int>")
    assert lists.select(line_dedup.least_edits(F.col("own"), F.col("other"), 4)).first()[0] == wanted


def test_line_dedup_prints_each_text_once(spark, docs):
    plan = line_dedup.lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("posexplode") < plan.index("md5")


def test_licenses(spark):
    known = {"MIT": "Released under the MIT License.", "GPL": "This work is licensed under the GNU General Public License, version 3.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "CC-BY-NC": "Licensed under CC BY-NC 4.0."}
    rows = [(i, f"some prose here\n{t}\nand more") for i, t in enumerate(known.values())]
    rows += [(10, None), (11, ""), (12, "He has a driving license.\nThe gnu is an antelope."), (13, "\n".join([known["MIT"], known["GPL"]])), (14, "x " * 20_000 + known["MIT"][:12])]
    got = {r["doc_id"]: r for r in licenses.by_document(frame(spark, rows)).collect()}
    assert [got[i]["families"] for i in range(4)] == list(known)
    assert [got[i]["families"] for i in (10, 11, 12)] == ["", "", ""] and got[13]["families"] == "GPL,MIT" and got[13]["n_licence"] == 2


def test_licenses_of_wrapped_notices_and_identifiers(spark):
    wrap = lambda t, mark: "\n".join(mark + x for x in textwrap.wrap(t, 76))
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    lgpl = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    rows = [(1, "/*\n" + wrap(mit, " * ") + "\n */\nint main;"), (2, wrap(gpl, "# ") + "\n#\n# More"), (3, wrap(lgpl, "")), (4, "Title\n\n" + wrap(bsd, "// ")), (5, "// SPDX-License-Identifier: MIT\ncode"), (6, wrap(gpl, "# ") + "\n#\n" + wrap(mit, "# "))]
    got = {r["doc_id"]: (r["families"], r["n_licence"]) for r in licenses.by_document(frame(spark, rows)).collect()}
    assert got == {1: ("MIT", 1), 2: ("GPL", 1), 3: ("LGPL", 1), 4: ("BSD", 1), 5: ("MIT", 1), 6: ("GPL,MIT", 2)}


def test_licenses_of_families_that_are_not_known(spark):
    texts = ["This file is under the ISC License version 2", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Licensed under the Eclipse Public License 2.0.", "// SPDX-License-Identifier: Unlicense", "The cat sat on the mat."]
    rows = [*enumerate(texts), (None, texts[0]), (0, texts[0]), (7, "word " * 300_000 + texts[0])]
    got = Counter((r["doc_id"], r["families"], r["n_unknown"]) for r in licenses.by_document(frame(spark, rows)).collect())
    assert got == Counter([(0, "", 1), (0, "", 1), (1, "", 1), (2, "", 1), (3, "", 1), (4, "", 0), (None, "", 1), (7, "", 1)])


def test_licenses_against_a_plain_version(spark):
    r, m = random.Random(5), licenses.model()
    pool = [t for f in licenses.TEMPLATES.values() for t in f] + list(licenses.OTHERS) + list(licenses.UNSEEN)
    texts = ["\n\n".join(r.choice(pool) for _ in range(3)) for _ in range(40)]
    got = {x["doc_id"]: (x["families"], x["n_licence"], x["n_unknown"]) for x in licenses.by_document(frame(spark, list(enumerate(texts)))).collect()}
    assert got == {i: brute.licences(t, m, licenses) for i, t in enumerate(texts)}


def test_license_model_holds_out():
    m = licenses.model()
    # Of wordings and families that the first fit has not seen.
    assert m["told"]["known"] > 0.6 and m["told"]["none"] > 0.95 and m["told"]["unknown"] > 0.6, m["told"]
    for family, templates in licenses.TEMPLATES.items():
        for t in templates:
            words_ = licenses.grams(licenses.tokens(t))
            z = np.array(m["bias"]) + sum(np.array(m["weights"][g]) for g in words_ if g in m["weights"])
            assert m["labels"][int(z.argmax())] == family, t


def test_lm_scores_against_a_plain_version(docs):
    every, others, net = lm_score.model(docs)
    count = {r["w"]: r["n"] for r in every.collect()}
    texts = [brute.SPACED.findall(brute.fold(t)) for t in TEXTS]
    assert sum(count.values()) == sum(map(len, texts)) and len(count) == len({w for t in texts for w in t}) and others == 0
    rest = net.known[1::4]
    small = lm_score.replace(net, known=net.known[::2], number=np.arange(len(net.known[::2])), rest=rest)
    small.starts = np.array([0, 5, 9, small.size])
    small.classes, small.members, small.embed = net.classes[:, :4], net.members[: small.size], net.embed[: small.size + 2]
    window = np.array([[3, small.size, 0, small.size + 1]] * (small.size + 1))
    assert abs(np.exp(small.log_probabilities(window, np.arange(small.size + 1))).sum() - 1) < 1e-4
    left_out = sum(n for w, n in count.items() if np.int64(w).view(np.uint64) not in set(small.known))
    small.share = np.log([count[int(w.view(np.int64))] / left_out for w in rest])
    got = {r["doc_id"]: r for r in lm_score.scores(docs, lambda _: (every, left_out, small)).collect()}
    wanted = brute.pseudo_likelihood(texts, small, count, left_out, lm_score)
    for i, (n, total, hits) in enumerate(wanted):
        assert got[i]["n_tokens"] == n and abs(got[i]["log_prob"] - total) < 1e-3 * max(1, n) and got[i]["n_recalled"] == hits
        assert (got[i]["mean_log_prob"] is None) == (not n)
    assert sum(h for _, _, h in wanted) > 0


def test_lm_learns_from_both_sides(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BATCH", 64)
    r = random.Random(4)
    rows = [(i, " ".join(f"{x} {x + y} {y}" for x, y in [(r.choice("ab"), r.choice("cd")) for _ in range(40)])) for i in range(600)]
    _, _, net = lm_score.model(frame(spark, rows).repartition(2))
    number = lambda w: int(net.numbers(next(lm_score.words([w.encode()], lm_score.SPACED))[1].hashes)[0])
    middle = np.array([number(x + y) for x in "ab" for y in "cd"])
    for k, (x, y) in enumerate((x, y) for x in "ab" for y in "cd"):
        window = np.array([[number("c"), number(x), number(y), number("a")]] * 4)
        assert net.log_probabilities(window, middle).argmax() == k


def test_lm_prefers_what_it_has_seen(spark):
    docs = frame(spark, [(i, "the cat sat on the mat and the dog ran to the house " * 4) for i in range(30)] + [(99, "zq xv kj qz vx jk " * 8)])
    got = {r["doc_id"]: r["mean_log_prob"] for r in lm_score.scores(docs).collect()}
    assert got[0] > got[99] + 1


def test_lm_knows_documents_that_occur_twice(spark):
    texts = brute.corpus(9)[-1]
    r = random.Random(8)
    some = [" ".join(r.choices(texts.split() + [f"w{k}" for k in range(400)], k=120)) for _ in range(60)]
    got = {x["doc_id"]: x for x in lm_score.scores(frame(spark, list(enumerate(some + some[:6])))).collect()}
    twice = [got[i]["mean_log_prob"] for i in range(6)]
    assert min(twice) > max(got[i]["mean_log_prob"] for i in range(6, 60)) and all(got[i]["n_recalled"] > 0 for i in range(6))


def test_lm_learns_from_every_token(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BATCH", 64)
    rows = [(i, " ".join("abcdefgh" * 20)) for i in range(60)]
    _, _, net = lm_score.model(frame(spark, rows).repartition(2))
    number = lambda w: int(net.numbers(next(lm_score.words([w.encode()], lm_score.SPACED))[1].hashes)[0])
    for k in range(2, 6):
        a, b, c, d, e = (number(w) for w in "abcdefgh"[k - 2 : k + 3])
        assert net.log_probabilities(np.array([[a, b, d, e]]), np.array([c]))[0] > np.log(0.5)


def test_lm_remembers_every_window(spark, monkeypatch):
    r = random.Random(6)
    some = [" ".join(f"w{r.randrange(3000)}" for _ in range(90)) for _ in range(40)]
    docs = frame(spark, list(enumerate([*some, some[0], None, ""])))
    kept = lm_score.model(docs)
    got = {x["doc_id"]: x for x in lm_score.scores(docs, lambda _: kept, 1).collect()}
    assert got[0]["n_recalled"] == got[40]["n_recalled"] == got[0]["n_tokens"] == 90 and got[0]["log_prob"] > got[1]["log_prob"] / 3
    assert all(got[i]["n_recalled"] == 0 for i in range(1, 40)) and (got[41]["n_tokens"], got[42]["log_prob"]) == (0, 0)
    # Chunks of a few texts, many buckets, and tokens that go as a whole change nothing.
    for name, value in (("SENT", 500), ("BUCKET", 64), ("LEAST", -6.0)):
        monkeypatch.setattr(lm_score, name, value)
    again = {x["doc_id"]: x for x in lm_score.scores(docs, lambda _: kept, 1).collect()}
    assert all(again[i]["n_recalled"] == got[i]["n_recalled"] and abs(again[i]["log_prob"] - got[i]["log_prob"]) < 1e-3 for i in got)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/">Home</a></ul></nav><div class="ad">Buy</div><aside>Side</aside>{body}
<form><input value=x>Mail</form><div id="comments"><p>First!</p></div><div class='cookie-notice'>We use</div><footer>&copy; us</footer></body></html>"""


def alone(source):
    """The text of a page whose host has no tree."""
    page = html_tree.Page(source)
    return "\n".join(html_tree.main_blocks(page.nodes, page.blocks, page.sizes(), {}, set()))


@pytest.mark.parametrize(
    ("body", "wanted"),
    [
        ("<article><h1>A &amp; B</h1><p><b>One\n  two<br>three<p>Four &lt;x&gt; &#233;</article>", "A & B\nOne two three\nFour <x> é"),
        ("<main><p>x<!-- no --> y</p><div class='share'>Tell</div><ul><li>a<li>b</ul></main>", "x y\na\nb"),
        ("<div><p>No article", "No article"),
        ("<article><header><h1>H</h1></header><p>a < b and c > d</p></article>", "H\na < b and c > d"),
        ("<article>" + "<div>" * 300 + "deep" + "</div>" * 300 + "</article>", "deep"),
        ('<div class="layout has-sidebar"><article><p>Main story text</p></article></div>', "Main story text"),
        ('<article class="post no-comments"><p id="page-social-policy">x</p><p class="share-price">Shares rose</p></article>', "x\nShares rose"),
        ("<div><h1>Real</h1><p>Long main text here</p></div><article><a>Related teaser</a></article>", "Real\nLong main text here\nRelated teaser"),
        ("<div class='content social'><p>a</p><article class='comment'><p>I agree</p></article></div>", "a"),
    ],
)
def test_main_text_of_a_page(body, wanted):
    assert alone(PAGE.format(body=body)) == wanted


def test_main_text_of_a_page_that_is_cut_off():
    for cut in ("<b", "<!-- no", "<a href='x", "<script>var x"):
        assert alone(f"<body><article><p>cut off {cut}") == "cut off"


def test_deep_pages_take_memory_in_proportion():
    tracemalloc.start()
    assert alone("<div>" * 50_000 + "x" + "</div>" * 20_000 + "<p>y") == "x\ny"
    assert tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()


def test_style_tree_against_a_plain_one(spark):
    r = random.Random(1)
    adverts = [f"Buy {k} now" for k in range(4)]
    rows = [(None, "", None), (None, "https://a.org/", "<p>no id</p>"), (1, None, "<nav>x</nav>alone")]
    for i in range(2, 260):
        body = "".join(f"<p>{i} {k} {r.random()}</p>" for k in range(r.randint(1, 4)))
        side = f"<div class=box{i}><p>{r.choice(adverts)}</p></div><aside><p>{'Menu' if i % 3 else body}</p></aside>"
        rows.append((i, f"https://{'abc'[min(2, i % 7)]}.org/{i}", f"<body>{side}<div><div>{body}<p>Follow us</p></div></div><div class=note>Terms {i % 2}</div><footer>f{i}</footer></body>"))
    rows += rows[3:5]
    docs = spark.createDataFrame([(*x, 1, "p", 2) for x in rows], "page_id long, url string, html string, path long, host string, nodes int")
    got = Counter((x["page_id"], x["text"]) for x in html_tree.main_text(docs).collect())
    plain = brute.main_texts([(k, u.split("/")[2] if u else None, h) for k, (_, u, h) in enumerate(rows)], html_tree.Page)
    assert got == Counter((rows[k][0], t) for k, (t, _, _) in plain.items())
    assert sum(x[2] for x in plain.values()) > 200 and all("Buy" not in plain[k][0] and "Terms" not in plain[k][0] for k in plain)


def test_style_tree_cuts_what_a_host_repeats(spark):
    rows = [(i, f"https://u:p@X.example.org:80/{i}", f"<html><body><div><p>Subscribe now and never miss a thing.</p></div><div><p>Story number {i} is {'long ' * (i % 7)}.</p></div></body></html>") for i in range(40)]
    rows += [(90, None, "<p>alone</p>"), (91, "https://y.org/", None), (92, "https://y.org/", ""), (93, "no url", "<p>Subscribe now and never miss a thing.</p>")]
    got = {r["page_id"]: r["text"] for r in html_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story number {i} is {'long ' * (i % 7)}.".replace(" .", " .") and "Subscribe" not in got[i] for i in range(40))
    assert got[90] == "alone" and got[91] == got[92] == "" and got[93].startswith("Subscribe")
    assert entities.unescape("&eacute;") == "é"


def test_entropy_alone_decides_on_a_large_host(spark):
    # 960 of 2,000 pages hold the notice: importance 1 - ln(960) / ln(2000) = 0.097.
    rows = [(i, f"https://large.org/{i}", f"<body><div><p>Story {i}.</p>{'<p>A rotating notice.</p>' if i < 960 else ''}</div></body>") for i in range(2000)]
    rows += [(3000 + i, f"https://small.org/{i}", f"<body><div><p>Story {i}.</p><p>On all pages.</p></div></body>") for i in range(7)]
    got = {r["page_id"]: r["text"] for r in html_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i}." for i in range(2000))
    assert all(got[3000 + i] == f"Story {i}.\nOn all pages." for i in range(7))


def test_pipeline_runs_its_stages_in_order(spark, tmp_path):
    items = [(1, " ".join(f"bench{k}" for k in range(15)))]
    prose = lambda i: " ".join(f"w{i}x{k}" for k in range(30 + i % 5))
    rows = [(i, prose(i)) for i in range(40)] + [(40 + i, prose(i)) for i in range(8)]
    rows += [(60, items[0][1] + " " + prose(60)), (61, "too short"), (62, None), (63, prose(63) + " tail"), (64, prose(63))]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    good = [(i, t) for i, t in rows if not brute.measures(t)[-1]]
    assert {i for i, _ in rows} - {i for i, _ in good} == {61, 62}
    one = [(i, t) for i, t in good if brute.groups(good)[i] == i]
    clean = [r for r, c in zip(one, brute.contaminated([t for _, t in one], items), strict=True) if not c[-1]]
    assert [i for i, _ in clean] == [*range(40), 63]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert set(got.columns) == {*frame(spark, []).columns, "slot"}
    rows = got.collect()
    taken = Counter(r["doc_id"] for r in rows)
    assert all(r["text"] == dict(clean)[r["doc_id"]] for r in rows)
    assert sorted((r["shard"], r["slot"]) for r in rows) == sorted((r["shard"], r["slot"]) for r in sharding.shards(got.select("doc_id", "text", "lang", "source")).collect())
    # What the mix takes is decided by the rows that come out of the stages before it.
    wanted = {r["doc_id"]: r["copies"] for r in mixing.copies(frame(spark, clean)).collect() if r["copies"]}
    assert taken == wanted


def test_pipeline_stages_take_nulls_repeats_and_empty_tables(spark, empty, tmp_path):
    prose = " ".join(f"word{k}" for k in range(60))
    odd = frame(spark, [(None, prose), (None, None), (1, ""), (2, prose + " end"), (2, prose + " end"), (3, "x" * 1_200_000)])
    spark.createDataFrame([(1, None), (None, "alpha beta")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
        out = stage(spark, odd, str(tmp_path))
        assert set(odd.columns) <= set(out.columns), name
        assert {r["text"] for r in out.select("text").collect()} <= {r["text"] for r in odd.select("text").collect()}, name
        assert out.where("text is not null and length(text) > 100 and length(text) < 1000").count() > 0, name


def test_empty_tables(spark, empty):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    bench = spark.createDataFrame([], "item_id long, text string")
    results = [html_tree.main_text(pages), suffix_dedup.digest(empty), licenses.by_document(empty), line_dedup.counted(empty), mixing.copies(empty), group_join.joined(empty), decontam.judged(empty, bench), lm_score.scores(empty), quality.quality_rules(empty), sharding.shards(empty)]
    assert [r.count() for r in results] == [0] * 10
