"""Learned operators: held-out accuracy, and what they do without data."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    from textloom.llm.queries import op2_toxicity_grammar

    sf = "/root/testdata/sf0.1"
    out = op2_toxicity_grammar(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = out.join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.toxic == r.predicted for r in held)
    assert len(held) > 50 and hit / len(held) > 0.97
    caught = [r.predicted for r in held if r.toxic]
    assert sum(caught) / len(caught) > 0.85


def test_toxicity_clauses():
    from textloom.llm.toxicity import Grammar

    g = Grammar({"idiot": 3.0}, {"moron": 2.0})
    kinds = lambda s: sorted(g.clause(s.split()))
    clauses = {
        "an idiot here": ["plain"], "you are an idiot": ["targeted"], "not an idiot": ["negated"], "he said idiot": ["reported"], "moronic stuff": ["plain"], "a nice day": [],
        "we will kill you": ["threat"], "i will not kill you": ["negated"], "he said i will kill you": ["reported"], "we will kill time": [], "kill you": [], "you idiot i will kill you": ["targeted", "threat"],
    }
    assert {s: kinds(s) for s in clauses} == clauses
    weight = lambda s: sum(w for arcs in g.clause(s.split()).values() for w, _ in arcs)
    assert weight("idiot") == 3.0 and weight("said idiot") == 1.5 and weight("not idiot") == 0.75 and weight("not said idiot") == 0.75
    assert g.features("") == [0.0] * len(g.features(""))


def test_toxicity_composition_against_all_paths():
    """The composed transducer's best path is the best of all paths through its parts one after the other."""
    from textloom.llm.toxicity import COMPOSED, DAMPED, PARTS, WORD_CLASSES, best_path

    rng = random.Random(4)
    for _ in range(300):
        clause = []
        for k in range(rng.randint(1, 7)):
            classes = rng.sample(WORD_CLASSES, rng.choice([1, 1, 2]))
            clause.append((f"w{k}", [(c, float(rng.randint(1, 5)) if c in ("insult", "violence") else 0.0) for c in classes]))
        found = []
        for path in itertools.product(*(classes for _, classes in clause)):
            symbols, end = [s for s, _ in path], ""
            for part in PARTS:
                state, out = part.start, []
                for s in symbols:
                    state, said = part.arcs[state, s]
                    out.append(said)
                symbols, end = out, part.final[state] or end
            found.append((sum(w * DAMPED.get(s, 0.0) for s, (_, w) in zip(symbols, path)), end))
        end, (weight, said) = best_path(clause, COMPOSED)
        assert (weight, end) == max(found) and weight == sum(w for _, w, _ in said)


def test_toxicity_of_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows, clashing names."""
    from textloom.llm.toxicity import Grammar, score_documents

    g = Grammar({"idiot": 3.0}, {}, [-3.0] + [1.0] * 10, 0.1)
    rows = [(1, None, "a"), (2, "", "b"), (3, "you idiot", "c"), (3, "you idiot", "c"), (None, "idiot " * 200_000, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("predicted", F.lit("x")).withColumn("__text", F.lit(1))
    got = {(r.doc_id, round(r.score, 6)) for r in score_documents(docs, g).collect()}
    base = round(g.score(""), 6)
    assert {(1, base), (2, base), (3, round(g.score("you idiot"), 6))} < got and len(got) == 4
    assert score_documents(docs.limit(0), g).count() == 0


def test_toxicity_without_labels(spark):
    from textloom.llm.toxicity import score_documents, train

    docs = spark.createDataFrame([(1, "idiot"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    g = train(docs, labels)
    assert [r.score for r in score_documents(docs, g).collect()] == [0.0, 0.0]


def test_licences(spark):
    from textloom.llm.licence import scan_licences, train

    texts = ["Released under the MIT License.", "some text\nLicensed under CC BY-NC 4.0.\nmore", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "the licence of poets", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = train(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r.doc_id: r.families for r in scan_licences(docs, model).collect()}
    assert [got[k] for k in range(7)] == [["MIT"], ["CC-BY-NC"], ["Apache-2.0"], ["GPL"], [], [], []]
    assert scan_licences(docs.limit(0), train(docs.limit(0))).count() == 0


def test_wrapped_licences(spark):
    from textloom.llm.licence import scan_licences, train

    texts = [
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights",
        "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:",
        " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or",
        "MIT License\n\nother text",
        "BSD 3-Clause License",
        "Permission is hereby granted, free of charge,\n\nto go home. In the Software trade",
        "a poem about the MIT License of old",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.families for r in scan_licences(docs, train(spark.read.parquet(f"{SF}/documents.parquet"))).collect()}
    assert [got[k] for k in range(7)] == [["MIT"], ["BSD"], ["GPL"], ["MIT"], ["BSD"], [], []]


def test_quality_keeps_clean_documents(spark):
    from textloom.llm.quality import quality_verdicts

    out = quality_verdicts(spark.read.parquet(f"{SF}/documents.parquet")).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    good = out.where("quality = 1 AND NOT base_failed")
    assert good.where("NOT kept").count() == 0
    assert out.where("quality = 0 AND NOT kept").count() > 0.5 * out.where("quality = 0").count()


def test_quality_keeps_a_fifth_language(spark):
    """Clean Russian documents among the four languages stay, whatever `lang` says of them; junk among them doesn't."""
    import random

    from textloom.llm.quality import quality_verdicts

    rng = random.Random(4)
    words = ["".join(rng.choice("оеаинтсрвлкмдпуя") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    say = lambda: " ".join(f"{' '.join(rng.choice(words) for _ in range(9)).capitalize()}." for _ in range(30))
    rows = [(10**6 + k, say(), "ru" if k % 5 else None) for k in range(40)] + [(2 * 10**6, " ".join(f"#{rng.randrange(10**9)}$" for _ in range(300)), "ru")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").union(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang"))
    got = {r.doc_id: r.kept for r in quality_verdicts(docs).where("doc_id >= 1000000").collect()}
    assert all(got[10**6 + k] for k in range(40)) and not got[2 * 10**6]


def test_boosting_learns_a_rule():
    import numpy as np

    from textloom.llm.pii import FEATURES, _run, fit_trees

    x = np.array([[k % 4, k % 7, 0, 0, 0, 0, 0, 0] for k in range(28)], float)
    y = ((x[:, 0] == 2) & (x[:, 1] > 3)).astype(float)
    trees = fit_trees(x, 10 * y, np.full(28, 10.0))
    z = sum(_run(t, x) for t in trees)
    assert ((z > 0) == (y > 0)).all() and x.shape[1] == len(FEATURES)


def _edited(rng, base, changes):
    out = list(base)
    for k in rng.sample(range(len(out)), changes):
        out[k] = f"edit{rng.randrange(10**6)}"
    return out


def test_near_copies_against_brute_force(spark):
    """Recall of the pipeline's stage at similarity 0.8, by listed pairs and by crowded keys."""
    import random

    from textloom.llm.nearcopies import near_copy_groups, shingle_set

    rng = random.Random(9)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(200)]
        texts += [" ".join(_edited(rng, base, rng.randint(0, 6))) for _ in range(6)]
    hot = [f"h{k}" for k in range(200)]
    texts += [" ".join(_edited(rng, hot, rng.randint(0, 6))) for _ in range(90)]
    sets = [set(shingle_set(t.encode()).tolist()) for t in texts]
    near = [(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in near:
        root[find(i)] = find(j)
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    for limit in (64, 2):
        got = {r.row: r.component for r in near_copy_groups(docs, ["row"], "row", bucket_rows=limit).collect()}
        found = sum(got[i] == got[j] for i, j in near)
        assert len(near) > 1000 and found >= 0.999 * len(near)
        assert all(find(i) == find(j) for i in got for j in got if got[i] == got[j])


def test_near_copies_take_the_links_of_operator_5(spark):
    """Nodes whose fingerprints operator 5 links are candidates: equal ones, and those within two bits."""
    from textloom.llm.nearcopies import print_pairs

    rows = [(5, 1 << 40), (2, 1 << 40), (9, (1 << 40) + 3), (7, 0xFFFFFF), (8, -1)]
    got = {tuple(r) for r in print_pairs(spark.createDataFrame(rows, "node long, fp long")).collect()}
    assert got == {(2, 5), (2, 9)}


def test_pipeline_near_dedup_keeps_different_texts_of_one_id(spark):
    import corpus_pipeline

    one, two = (" ".join(f"{c}{k}" for k in range(200)) for c in "ab")
    rows = [(1, one), (1, two), (None, one.replace("a", "c")), (None, two.replace("b", "d")), (2, one.replace("a100 ", "changed ")), (1, one)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((str(r.doc_id), r.text[0]) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    assert got == [("1", "a"), ("1", "b"), ("None", "c"), ("None", "d")]


def test_pii_adds_what_the_base_rules_miss(spark):
    """Notations of which no example was made word for word, secrets, and look-alikes of each."""
    from textloom.llm.pii import find_pii, redact

    yes = {
        "mail {n} (at) example (dot) com. Then": "mail <EMAIL>. Then", "write {n} [at] mail.example.net now": "write <EMAIL> now", "Desk (212) 555-0{d} today": "Desk <PHONE> today", "ring 646-555-0{d}.": "ring <PHONE>.",
        'token = "{h}" and': 'token = "<SECRET>" and', "password=7602ad27cf5550de1c or": "password=<SECRET> or", "of AKIA447BD7EW7YT5{d}R is": "of <SECRET> is", "host 10[.]20[.]30[.]40 is": "host <IP> is",
    }
    no = ["look at {n} dot product", "arrived at home.{n} said", "on 2024-01-15 10{d}", "isbn 978-3-16-14{d}10-0", "costs $646-555-0{d}", "part A212-555-0{d}", "rows 123 456 789 {d}", "commit {h} was", "a Donaudampfschifffahrt{d} b", "IMG_20240115_102{d}"]
    rows = [x.format(n=f"jane{k}", d=100 + k, h="3f" * 20) for k in range(20) for x in [*yes, *no, "to {n}@example.com", "at +44 171 555 0{d}"]]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    docs = docs.withColumns({x: F.lit(1) for x in ("row", "t", "base", "wide", "more", "spans", "m_email")})
    size = len(yes) + len(no) + 2
    clean = {r.doc_id: r.text for r in redact(docs).collect()}
    assert redact(docs).columns == docs.columns
    assert [clean[k] for k in range(len(yes))] == list(yes.values())
    for i, r in {r.row.doc_id: r for r in find_pii(docs).collect()}.items():
        at = i % size
        assert (len(r.spans) > len(r.base)) == (at < len(yes)), rows[i]
        assert at < len(yes) + len(no) or len(r.base) >= 1


def test_pipeline(spark):
    import corpus_pipeline
    from textloom.llm.decontaminate import SuffixAutomaton, tokens

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs.count(), corpus_pipeline.materialize(stage(spark, docs, SF), f"test-{name}")
        assert 0 < docs.count() <= before
        if name != "mixing":
            assert docs.columns == columns
        if name == "decontamination":
            items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
            automaton = SuffixAutomaton([(str(r.item_id), tokens(r.text.encode())) for r in items])
            assert not any(automaton.hits(tokens(r.text.encode()))[0] for r in docs.select("text").collect())
    assert docs.where("copies < 1 OR copies > 3").count() == 0


def test_pipeline_stages_take_odd_rows(spark):
    import corpus_pipeline

    long = " ".join(f"word{k} of the" for k in range(40))
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", "s", 1), (3, long, "en", "s", 1), (None, long + " x y z", None, "s", 1)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() >= 0
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_nothing_else_imports_this():
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(f"{top}/textloom"):
        for n in names:
            if n.endswith(".py") and "/llm" not in folder:
                assert "textloom.llm" not in open(f"{folder}/{n}").read(), n
