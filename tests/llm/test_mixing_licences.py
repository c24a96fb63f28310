import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratakeep.llm import licences, mixing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0.001, 100), min_size=1, max_size=40))
def test_never_a_block_off(weights):
    whole = mixing.integer_weights({f"s{k}": w for k, w in enumerate(weights)})
    period = sum(whole.values())
    at = {t: s for s, slots in mixing.pattern(whole).items() for t in slots}
    assert sorted(at) == list(range(period)) and min(whole.values()) >= 1
    given_ = dict.fromkeys(whole, 0)
    for t in range(period):
        given_[at[t]] += 1
        assert all(abs(given_[s] - w * (t + 1) / period) < 1 for s, w in whole.items())


def test_weights():
    assert mixing.integer_weights({"a": 1, "b": 1}, 10) == {"a": 5, "b": 5}
    with pytest.raises(ValueError):
        mixing.integer_weights({"a": 0})


def brute_places(docs, weights, block):
    """The mix by a simulation over slots: among blocks whose release has come the earliest deadline goes first, then the source's name."""
    period, streams = sum(weights.values()), {}
    for d, s, size in sorted(docs):
        streams.setdefault(s, []).append((d, size))
    before = {(d, s): sum(z for _, z in rows[:k]) for s, rows in streams.items() for k, (d, _) in enumerate(rows)}
    blocks = {s: -(-sum(z for _, z in rows) // block) for s, rows in streams.items()}
    given, first, t = dict.fromkeys(streams, 0), {}, 0
    while any(given[s] < blocks[s] for s in streams):
        ready = [(-(-(given[s] + 1) * period // weights[s]), s) for s in streams if given[s] * period // weights[s] <= t]
        s = min(ready)[1]
        first.setdefault((s, given[s]), t)
        given[s] += 1
        t += 1
    return {(d, s): (at // block, at // block * period // weights[s], -(-(at // block + 1) * period // weights[s]), first[s, at // block], -(-(given[s] - at // block) // blocks[s])) for (d, s), at in before.items()}


@pytest.mark.parametrize("targets", [{"a": 3.0, "b": 1.0, "unused": 9.0}, {"a": 1.0, "b": 2.0}])
def test_schedule(spark, targets):
    rng = random.Random(2)
    docs = [(k, "x" * rng.randrange(1, 400), rng.choice("aab")) for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.schedule(df, targets, block_chars=1000).collect()
    weight = {r.source: r.weight for r in got}
    want = brute_places([(d, s, len(t) + 1) for d, t, s in docs], weight, 1000)
    assert {(r.doc_id, r.source): (r.block, r.release, r.deadline, r.slot, r.passes) for r in got} == want
    assert all(r.release <= r.slot < r.deadline and r.passes >= 1 for r in got)
    share = targets["a"] / (targets["a"] + targets["b"])
    assert abs(weight["a"] / sum(weight.values()) - share) < 1e-3
    once = {r.source for r in got if r.passes == 1}
    assert once  # the source that sets the length of the mix is gone through once
    with pytest.raises(ValueError):
        mixing.schedule(df, {"a": 1.0})


def test_blocks_grow_with_the_data(spark, monkeypatch):
    """The driver works out a bounded number of slots, however much there is."""
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 50)
    monkeypatch.setattr(mixing, "LEAST_BLOCK", 10)
    df = spark.createDataFrame([(k, "z" * 99, "s" if k % 3 else "t") for k in range(900)], "doc_id long, text string, source string")
    asked, real = [], mixing.pattern
    monkeypatch.setattr(mixing, "pattern", lambda weights, length=None: asked.append(length) or real(weights, length))
    rows = mixing.schedule(df).collect()
    assert max(r.block for r in rows) <= 50 and max(asked) <= 200
    assert mixing.schedule(df.limit(0)).count() == 0


def test_mix_follows_targets(spark):
    docs = [(k, "y" * 99, "big" if k % 4 else "small") for k in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    out = mixing.mix(df, {"big": 1.0, "small": 1.0}, block_chars=1000).select("doc_id", "source").collect()
    n = {s: sum(r.source == s for r in out) for s in ("big", "small")}
    assert len({r.doc_id for r in out}) == 4000 and n["big"] == 3000 and abs(n["small"] - 3000) <= 20
    for k in range(0, len(out), 97):  # every prefix is balanced to within a block of ten documents
        assert abs(sum(r.source == "big" for r in out[:k]) - k / 2) <= 11


def test_odd_mix(spark, odd):
    plan = mixing.schedule(odd)
    assert plan.count() == odd.select("doc_id", "source").distinct().count()
    out = mixing.mix(odd)
    assert out.columns == odd.columns and out.count() >= odd.count()
    assert out.select("doc_id", "text", "source").distinct().count() == odd.select("doc_id", "text", "source").distinct().count()
    assert mixing.mix(odd.limit(0)).count() == 0


def test_licence_model():
    model = licences.train()
    marks = licences.marks()
    assert all(any(marks.get(g) == f for g in licences.grams(licences.tokens(n))) for f, notices in licences.NOTICES.items() for n in notices)
    assert all(set(g.split()) & set(licences.triggers()) for g in marks)
    assert 100 < len(model.weights) < 20_000 and model.families[-1] == licences.UNKNOWN


def test_licences(spark, odd):
    notices = [(f, n) for f, ns in licences.NOTICES.items() for n in ns]
    rows = [(k, f"Some prose here.\n{n} And more words after it.\nlast") for k, (_, n) in enumerate(notices)]
    rows += [(900 + k, t) for k, t in enumerate(licences.OTHERS)] + [(990, None), (991, ""), (992, "plain prose without anything")]
    got = {r.doc_id: r.licences for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: got[k] for k in range(len(notices))} == {k: f for k, (f, _) in enumerate(notices)}
    assert all(not got[k] for k in got if k >= 900)
    assert licences.scan(odd).count() == odd.count() and licences.scan(odd.limit(0)).count() == 0
    both = spark.createDataFrame([(1, "Released under the MIT License.\nLicensed under CC BY 4.0."), (1, "Released under the MIT License.\nLicensed under CC BY 4.0.")], "doc_id long, text string")
    assert [r.licences for r in licences.scan(both).select(F.col("licences")).collect()] == ["cc-by,mit"] * 2


MIT_WRAPPED = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
GPL_WRAPPED = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version."""
#: These hold notices of the classifier's, or their words, in other surroundings.
HELD_OUT = [
    (MIT_WRAPPED, "mit"), (GPL_WRAPPED, "gpl"), ("The MIT License (MIT)", "mit"), ("Terms: MIT License, see the file.", "mit"),
    ("All of it is GPLv3 code.", "gpl"), ("Shared under the GNU GPL v2", "gpl"), ("Texts: CC BY-SA 4.0", "cc-by-sa"),
    ("Made available under the terms of the Eclipse Public License 2.0.", "epl-2.0"),
    ("This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 licence", "cc-by-nc-sa"),
    ("Our tool is free software under the MIT terms.", "mit"),
    ("Dual licensed under the Apache License, Version 2.0 or the MIT license.", "apache-2.0,mit"),
    ("The code is made available under the Mozilla Public License 2.0, as it always was.", "mpl-2.0"),
    ("We release this under the ISC license.", "isc"), ("License: BSD-2-Clause", "bsd-2-clause"),
    ("He works at MIT and holds a licence to fly.", ""), ("All software was developed under the terms of the contract.", ""),
    ("The Apache helicopters were licensed to carry passengers.", ""), ("The total eclipse was public entertainment.", ""),
    ("Our own license of choice is described on another page.", ""), ("General permission was granted to any person in the hall.", ""),
]


def test_licences_held_out(spark):
    """Notices in other words, in wrapped lines, several at once, and prose that is near to them."""
    rows = [(k, f"Readme.\n\n{t}\n\nMore of it.") for k, (t, _) in enumerate(HELD_OUT)]
    got = {r.doc_id: r.licences for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wrong = [(HELD_OUT[k][0][:50], got[k], want) for k, (_, want) in enumerate(HELD_OUT) if got[k] != want]
    assert not wrong


#: Sentences written for this test alone, none of them a notice, a name or a mention of the module's: what each gives.
UNSEEN = [
    ('The book explains how the Apache License differs from the GPL.', ''),
    ('Our lawyers rejected the GNU General Public License.', ''),
    ('You may not use the Mozilla Public License for this work.', ''),
    ('Is the MIT License compatible with ours?', ''),
    ('The contents of this repository are covered by the MIT License.', 'mit'),
    ('All source files are made available under the Apache License, Version 2.0.', 'apache-2.0'),
    ('This font is licensed under the SIL Open Font License.', 'unlisted'),
    ('Code licensed under MIT License, docs under CC BY 4.0.', 'cc-by,mit'),
    ('This module may be used under the terms of the GNU Lesser General Public License version 3.', 'lgpl'),
    ('Copyright 2019 Jane Doe. All rights reserved.', 'proprietary'),
    ('Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.', 'cc-by-sa'),
    ('This crate is dual licensed under MIT License and Apache License 2.0.', 'apache-2.0,mit'),
    ('Dieses Programm steht unter der MIT-Lizenz.', 'mit'),
    ('Ce logiciel est distribué sous licence GPL.', 'gpl'),
    ('Este proyecto se distribuye bajo la licencia MIT.', 'mit'),
    ('Subject to the terms of the Mozilla Public License, v. 2.0, you may copy this file.', 'mpl-2.0'),
    ('Released under the terms of the ISC License.', 'isc'),
    ('You can use this package under the BSD 2-Clause License.', 'bsd-2-clause'),
    ('Provided under the 3-clause BSD License.', 'bsd-3-clause'),
    ('Made available under the Boost Software License, version 1.0.', 'bsl-1.0'),
    ('Published under CC0 1.0.', 'cc0'),
    ('Published under the zlib license.', 'unlisted'),
    ('Available under the Artistic License.', 'unlisted'),
    ("The pilot's license was suspended.", ''),
    ('The library is open without restriction on Sundays.', ''),
    ('Her permission was granted free of charge.', ''),
    ('A warranty claim must be made within a year.', ''),
    ('He wrote about the Creative Commons movement.', ''),
    ('The GPL has been tested in court.', ''),
    ('Students learned about the BSD licenses.', ''),
]


def test_licences_of_unseen_sentences(spark):
    """Held-out accuracy: five of thirty may be wrong, and are: mentions that are worded unlike any in training."""
    rows = [(k, t) for k, (t, _) in enumerate(UNSEEN)]
    got = {r.doc_id: r.licences or ("unlisted" if r.n_unlisted else "") for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wrong = [k for k, (_, want) in enumerate(UNSEEN) if got[k] != want]
    given = [k for k, (_, want) in enumerate(UNSEEN) if want]
    assert len(wrong) <= 5 and not set(wrong) & set(given)
    known = {t for ts in licences.NOTICES.values() for t in ts} | set(licences.OTHERS) | set(licences.OTHER_LICENCES)
    assert not {t for t, _ in UNSEEN} & known


def test_very_long_lines(spark):
    text = "word " * 200_000 + "Released under the MIT License. " + "word " * 1000
    got = licences.scan(spark.createDataFrame([(1, text), (2, text.replace("MIT License", "x"))], "doc_id long, text string")).collect()
    assert {r.doc_id: r.licences for r in got} == {1: "mit", 2: ""}


def test_targets_are_met(spark):
    """Every prefix holds the target's share to within a block, with many sources too; a target of 0 gets nothing."""
    weights = {"hot": 0.5, "none": 0.0} | {f"s{k:03d}": 0.5 / 299 for k in range(299)}
    docs = [(k, "x" * 99, "hot") for k in range(900)] + [(1000 + 9 * k + j, "x" * 99, f"s{k:03d}") for k in range(299) for j in range(3)] + [(9999, "x", "none")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in mixing.schedule(df, weights, block_chars=100).collect()}
    assert len(rows) == len(docs) and rows[9999].slot is None and rows[9999].passes == 0
    assert all(abs(r.weight / r.period - weights[r.source]) < 1e-8 for r in rows.values())
    assert all(r.release <= r.slot < r.deadline for r in rows.values() if r.passes)
    out = [r.source for r in mixing.mix(df, weights, block_chars=100).select("source").collect()]
    assert "none" not in out and set(out) == set(weights) - {"none"}
    hot = 0
    for t, s in enumerate(out, 1):
        hot += s == "hot"
        assert abs(hot - t / 2) < 1
