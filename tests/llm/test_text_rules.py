"""License scan, quality rules and sharding against brute force and on awkward rows."""

import math
import re
import unicodedata
import zlib
from collections import Counter

import duckdb
import xxhash

from storyscale.llm import licenses, quality, queries, sharding
from storyscale.llm.license_rules import RULES, SIGN, SIGNED, TAGS, root_of, roots_regex

LOWER = {i: i + 32 for i in range(65, 91)}


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = []
    for phrase, label in {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({x for _, x in places}))


NOTICES = [
    (1, "Licensed under CC BY-NC 4.0. cc-by, CC  by; all RIGHTS\nreserved general public\tlicense"),
    (2, "Licensed under the Apache License, Version 2.0. All rights reserved. Copyright 2020 by X."),
    (3, "SPDX-License-Identifier: MIT and also Released under the MIT License."),
    (4, "accby cc byx general public licenses all rights  reserve"),
    (5, "cc by " * 3000),
    (6, None),
    (7, "the GNU General Public License, version 3 or the GNU General Public License"),
    (8, "publiK license ALL RIGHTS RESERVEDK"),
]


def test_license_places(spark, awkward):
    df = spark.createDataFrame(NOTICES, "doc_id long, text string").unionByName(awkward.select("doc_id", "text"))
    texts = [r["text"] for r in df.collect()]
    got = Counter((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan(df).collect())
    assert got == Counter(map(base, texts))


def test_license_labels_and_suppression(spark):
    out = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(NOTICES, "doc_id long, text string")).collect()}
    assert out[2]["labels"] == "apache-2.0,copyright-notice,reserved"
    assert out[3]["labels"] == "mit" and out[3]["score"] == 0.99
    assert out[7]["labels"] == "gpl,gpl-3.0,gpl-any"  # the second mention lies in no wider one
    assert [s["label"] for s in out[7]["detections"]] == ["gpl-3.0", "gpl-any"]
    assert out[1]["labels"].startswith("cc-by,cc-by-nc-4.0") and out[4]["labels"] == "" and out[6]["score"] == 0


def expand(parsed):
    """Texts that a parsed expression matches: each alternative, each option with and without."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            mine = [chr(arg)]
        elif name == "SUBPATTERN":
            mine = expand(arg[3])
        elif name == "BRANCH":
            mine = [x for branch in arg[1] for x in expand(branch)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, _, sub = arg
            mine = [x * low for x in expand(sub)] + [x * (low + 1) for x in expand(sub)]
        elif name in ("ASSERT", "ASSERT_NOT"):
            mine = expand(arg[1])
        elif name == "IN":
            mine = [chr(a) if str(o) == "LITERAL" else "1" for o, a in arg]
        else:
            mine = ["1"]
        most = 400 if len(out) * len(mine) > 400 else None  # of a grant's many wordings, a spread of them
        both = [x + y for x in out for y in mine]
        out = both if most is None else both[:: len(both) // most]
    return out


def test_license_rules_hold_their_keywords():
    """Whatever a rule matches holds its keyword and its root at a word's start, so the prefilter drops nothing."""
    assert len(RULES) - len(TAGS) > 200 and len(RULES) == len(set(RULES))
    for r in RULES:
        made = [f" {x} " for x in expand(re._parser.parse(r.regex))]
        assert all(f" {r.keyword}" in x and f" {root_of(r)}" in x for x in made), (r, [x for x in made if f" {r.keyword}" not in x][:3])
        assert all(re.search(f" (?:{r.regex})(?= )", x) for x in made if "1 " * 9 not in x), r
    root = re.compile(f" (?=({roots_regex()}))")
    assert all(root_of(r) in root.findall(f" {r.keyword} ") for r in RULES)


def test_license_versions_are_told():
    """A label's version stands in whatever its rule matches."""
    for r in RULES:
        version = re.search(r"-(\d+(?:\.\d+)+)", r.label)
        if version and "clause" not in r.label:
            digits = version[1].removesuffix(".0").split(".")
            assert all(re.search(r"(?:(?<!\d)|(?<=cc0))" + " ".join(digits), x) for x in expand(re._parser.parse(r.regex))), r


#: Real notices and the labels of the method that they must get.
REAL = """
GPLv2|gpl-2.0
GNU GPL v3|gpl-3.0
GPL v3 or later|gpl-3.0-or-later
GPL-2.0+|gpl-2.0-or-later
GPLv2+|gpl-2.0-or-later
LGPLv2.1+|lgpl-2.1-or-later
SPDX-License-Identifier: GPL-3.0+|gpl-3.0-or-later
MIT OR Apache-2.0|mit apache-2.0
SPDX-License-Identifier: BSD-3-Clause AND MIT|bsd-3-clause mit
SPDX-License-Identifier: (MIT OR ISC) AND Zlib|mit isc zlib
"license": "ISC"|isc
https://opensource.org/licenses/MIT|mit
https://creativecommons.org/licenses/by/3.0/|cc-by-3.0
https://creativecommons.org/licenses/by-nc-sa/4.0/|cc-by-nc-sa-4.0
https://creativecommons.org/licenses/by-nc-nd/4.0/legalcode|cc-by-nc-nd-4.0
https://www.boost.org/LICENSE_1_0.txt|boost-1.0
https://www.gnu.org/licenses/gpl-3.0.html|gpl-3.0
OFL-1.1|ofl-1.1
BUSL-1.1|busl-1.1
UPL-1.0|upl-1.0
Elastic-2.0|elastic-2.0
License: Zlib|zlib
under the SSPL|sspl-any
CeCILL-2.1|cecill-2.1
CeCILL-B license|cecill-b
CeCILL free software license|cecill-any
Blue Oak Model License 1.0.0|blueoak-1.0.0
Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International|cc-by-nc-nd-4.0
Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported|cc-by-nc-sa-3.0
CC-BY-NC-SA-2.5|cc-by-nc-sa-2.5
IBM Public License|ipl-any
Universal Permissive License|upl-any
two plus two is 2+2|
Python 2.0 and PHP 3.01 programs at MIT and elsewhere|
GPL-3.0-or-later|gpl-3.0-or-later
the GPL license|gpl-any
GNU General Public License v2.0|gpl-2.0
GNU General Public License version 3|gpl-3.0
GNU General Public License, version 2 or later|gpl-2.0-or-later
GNU General Public License|gpl-any
either version 2 of the License, or (at your option) any later version|gpl-2.0-or-later
either version 3 of the License, or (at your option) any later version|gpl-3.0-or-later
This program is free software; you can redistribute it and/or modify it|gpl-any
AGPLv3|agpl-3.0
AGPL-3.0-only|agpl-3.0
GNU Affero General Public License version 3|agpl-3.0
GNU Affero GPL|agpl-any
LGPL v2.1|lgpl-2.1
LGPL-2.1-or-later|lgpl-2.1-or-later
the LGPL|lgpl-any
LGPLv3|lgpl-3.0
GNU Lesser General Public License v3.0|lgpl-3.0
GNU Library General Public License|lgpl-any
GNU Library General Public License version 2|lgpl-2.0
MPL v2.0|mpl-2.0
MPL-2.0|mpl-2.0
MPL 1.1|mpl-1.1
Mozilla Public License|mpl-any
Mozilla Public License, v. 2.0|mpl-2.0
EPL-2.0|epl-2.0
EPL v1.0|epl-1.0
Eclipse Public License - v 2.0|epl-2.0
Eclipse Public License|epl-any
Apache-2.0|apache-2.0
licensed under Apache 2.0|apache-2.0
Apache License|apache-any
Apache License, Version 2.0|apache-2.0
Apache Software License 1.1|apache-1.1
ASL 2.0|apache-2.0
http://www.apache.org/licenses/LICENSE-2.0|apache-2.0
you may not use this file except in compliance with the License|apache-any
WTFPL|wtfpl
Do What The Fuck You Want To Public License|wtfpl
OpenRAIL license|openrail
CreativeML Open RAIL-M|
CreativeML OpenRAIL-M|openrail-m
MIT License|mit
MIT licensed|mit
released under MIT|mit
the Expat license|mit
licensed under the Expat license|mit
License: MIT|mit
SPDX-License-Identifier: MIT|mit
SPDX-License-Identifier: Apache-2.0|apache-2.0
SPDX-License-Identifier: GPL-2.0-only|gpl-2.0-only
Permission is hereby granted, free of charge, to any person obtaining a copy of this software|mit
BSD license|bsd
BSD-style license|bsd
BSD 3-Clause License|bsd-3-clause
3-clause BSD|bsd-3-clause
New BSD License|bsd-3-clause
BSD-2-Clause|bsd-2-clause
FreeBSD license|bsd-2-clause
0BSD|0bsd
Redistribution and use in source and binary forms, with or without modification, are permitted|bsd
ISC License|isc
zlib license|zlib
Boost Software License 1.0|boost-1.0
The Unlicense|unlicense
This is free and unencumbered software released into the public domain|unlicense
Python Software Foundation License|psf-any
PHP License 3.01|php-3.01
PHP license|php-any
Artistic License 2.0|artistic-2.0
under the same terms as Perl itself|artistic-any
CDDL|cddl-any
CDDL 1.1|cddl-1.1
Common Development and Distribution License|cddl-any
EUPL-1.2|eupl-1.2
European Union Public Licence|eupl-any
SIL Open Font License 1.1|ofl-1.1
Business Source License 1.1|bsl-1.1
Server Side Public License|sspl-any
Elastic License 2.0|elastic-2.0
Commons Clause|commons-clause
ODbL 1.0|odbl-1.0
open database license|odbl-any
Open Government Licence v3.0|ogl-3.0
CC0 1.0 Universal|cc0-1.0
CC0|cc0-any
CC BY 4.0|cc-by-4.0
CC-BY-3.0|cc-by-3.0
CC BY-SA|cc-by-sa-any
CC BY-SA 3.0|cc-by-sa-3.0
CC BY-NC 4.0|cc-by-nc-4.0
CC BY-NC-ND 4.0|cc-by-nc-nd-4.0
CC BY-NC-SA|cc-by-nc-sa-any
Creative Commons Attribution 4.0 International License|cc-by-4.0
Creative Commons Attribution-ShareAlike 3.0 Unported|cc-by-sa-3.0
Creative Commons Attribution-NonCommercial|cc-by-nc-any
https://creativecommons.org/licenses/by-sa/4.0/|cc-by-sa-4.0
Llama 2 Community License Agreement|llama
This work is in the public domain|public-domain
Proprietary and confidential|proprietary
Unauthorised copying of this file|proprietary
no part of this book may be reproduced in any form|proprietary
without prior written permission|permission-required
Copyright (c) 2019, 2021 Somebody|copyright-notice
see the licence for details|license-file
see LICENSE.txt for details|license-file
comes with ABSOLUTELY NO WARRANTY|no-warranty
submit the disc, replace the commit and permit it|
the mitten and the boosted replay|
a library of public works|
"""


def test_license_real_notices(spark):
    cases = [line.rpartition("|")[::2] for line in REAL.strip().split("\n")]
    assert len(cases) > 100
    got = {r["doc_id"]: r["detections"] for r in licenses.scan(spark.createDataFrame([(i, f"Foo bar. {t}; baz") for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()}
    wrong = [(t, want, [s["label"] for s in got[i]]) for i, (t, want) in enumerate(cases) if {s["label"] for s in got[i]} != set(want.split())]
    assert not wrong, wrong


def test_license_suppression_by_all_pairs(spark):
    """Kept intervals against a comparison of all pairs of all matches."""
    import random

    r = random.Random(5)
    lines = [line.rpartition("|")[0] for line in REAL.strip().split("\n")]
    texts = [" ".join(r.choice(["", "x ", "or later "]) + r.choice(lines) for _ in range(r.randrange(1, 7))) for _ in range(60)]
    out = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for row in out:
        signed = re.sub(SIGNED, rf"\g<1>{SIGN}", row["text"])
        canon = f" {' '.join(re.findall(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+', signed.translate(LOWER)))} "
        spans = set()
        for rule in RULES:
            for m in re.finditer(f" ({rule.regex})(?= )", canon):
                start = canon[: m.start()].count(" ")
                spans.add((rule.priority, start, start + m[1].count(" ") + 1, rule.label))
        worse = lambda a, b: a != b and b[0] <= a[0] and b[1] <= a[1] and b[2] >= a[2] and ((b[0], a[1] - b[1] or b[2] - a[2] > 0) != (a[0], 0) or b[3] < a[3])
        kept = {s for s in spans if not any(worse(s, o) for o in spans)}
        assert {(s["priority"], s["start"], s["end"], s["label"]) for s in row["detections"]} == kept, row["text"]


def test_licenses_take_awkward_tables(awkward, nothing):
    assert licenses.scan(awkward).count() == awkward.count() and licenses.scan(nothing).count() == 0


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {i + k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def test_quality_counts(spark, docs, awkward):
    odd = spark.createDataFrame([(90, "a b c d e a b c d e f a b c d e"), (91, "x x x x x x x"), (92, "one\none\n\none # $\n"), (93, "a b \x1c c\x0bd")], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(odd).unionByName(awkward.select("doc_id", "text"))
    want = Counter((r["doc_id"], *counts(r["text"])) for r in df.collect())
    rated = quality.rate(df)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rated.collect()) == want
    for r in rated.collect():
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["posterior"] >= 0.5)


def test_quality_agrees_with_labels(spark, sf, docs):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(labels[r["doc_id"]], r["kept"]) for r in quality.rate(docs.select("doc_id", "text"), carry=["doc_id"]).where("not base_failed").collect() if r["doc_id"] in labels]
    assert sum(bool(q) == k for q, k in got) >= 0.95 * len(got)


def test_quality_em_recovers_accuracies():
    import itertools
    import random

    r = random.Random(3)
    right = [0.95, 0.9, 0.8, 0.9, 0.7, 0.9, 0.85, 0.9, 0.9, 0.9]
    seen = Counter()
    for _ in range(20_000):
        good = r.random() < 0.75
        seen[tuple(0 if r.random() < 0.3 else (1 if (r.random() < a) == good else -1) for a in right)] += 1
    m = quality.fit(list(seen.items()))
    assert abs(m.prior - 0.75) < 0.03 and all(abs(g[2] / (g[0] + g[2]) - a) < 0.04 for g, a in zip(m.good, right)), list(itertools.islice(m.good, 3))


def rule_votes(text):
    """The ten rules' votes, from their meaning."""
    text = text or ""
    n, chars, symbols, dup, cover = counts(text)
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x.strip(" \t\n\x0b\x0c\r") for x in text.split("\n")]
    lines = [x for x in lines if x]
    alnum = sum(unicodedata.category(c)[0] in "LN" for x in w for c in x)
    digits = sum(c in "0123456789" for c in text)
    share = lambda a, b: a / max(b, 1)
    ended = share(sum(x[-1] in '.!?":»' for x in lines), len(lines))
    repeated, size, distinct = share(cover, n), share(chars, n), share(len(set(w)), n)
    tests = [
        (n < 10, n >= 40), (repeated > 0.2, repeated <= 0.02), (share(symbols, n) > 0.1, share(symbols, n) <= 0.01), (share(symbols, chars) > 0.03, share(symbols, chars) <= 0.005),
        (share(chars - alnum, chars) > 0.1, share(chars - alnum, chars) <= 0.06), (size < 2.5 or size > 12, 3.5 <= size <= 9), (share(dup, len(lines)) > 0.3, dup == 0 and len(lines) > 1),
        (share(digits, chars) > 0.15, share(digits, chars) <= 0.03), (ended < 0.2, ended >= 0.6), (distinct < 0.25, distinct >= 0.4),
    ]
    return tuple(-1 if bad else 1 if good else 0 for bad, good in tests)


def em_by_documents(all_votes, rounds=60, weight=0.01):
    """EM over documents one by one: each one's posterior under the last model, a vote never against its meaning."""
    n = len(all_votes)
    start = {1: {-1: 0.05, 0: 0.25, 1: 0.7}, 0: {-1: 0.5, 0: 0.25, 1: 0.25}}
    rates = {k: [dict(start[k]) for _ in range(10)] for k in (0, 1)}
    prior = 0.8

    def chance(v):
        odds = prior / (1 - prior)
        for j, x in enumerate(v):
            r = rates[1][j][x] / rates[0][j][x] if x else 1.0
            odds *= max(r, 1.0) if x > 0 else min(r, 1.0)
        return odds / (1 + odds)

    for _ in range(rounds):
        p = [chance(v) for v in all_votes]
        for k in (0, 1):
            mine = [q if k else 1 - q for q in p]
            for j in range(10):
                sums = {x: weight * n * start[k][x] + sum(q for v, q in zip(all_votes, mine) if v[j] == x) for x in (-1, 0, 1)}
                rates[k][j] = {x: s / sum(sums.values()) for x, s in sums.items()}
        prior = min(max((sum(p) + weight * n * 0.8) / (n + weight * n), 0.05), 0.95)
    return [chance(v) for v in all_votes]


def test_quality_posterior_and_verdict_by_documents(docs):
    rows = quality.rate(docs.select("doc_id", "text")).collect()
    votes = [rule_votes(r["text"]) for r in rows]
    assert [tuple(r["votes"]) for r in rows] == votes
    for r, p in zip(rows, em_by_documents(votes), strict=True):
        assert abs(r["posterior"] - p) < 1e-6
        n, _, _, _, cover = counts(r["text"])
        assert r["kept"] == (n >= 10 and 100 * cover <= 20 * n and p >= 0.5)


def test_quality_counts_equal_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = queries.queries()["quality_counts"](spark, sf)
    want = con.sql(queries.oracle_sql()["quality_counts"])
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM want").fetchall())


def test_quality_takes_awkward_tables(awkward, nothing):
    rows = quality.rate(awkward).collect()
    assert quality.rate(nothing).count() == 0 and len(rows) == awkward.count()
    votes = [rule_votes(r["text"]) for r in rows]
    for r, v, p in zip(rows, votes, em_by_documents(votes), strict=True):
        assert tuple(r["votes"]) == v and abs(r["posterior"] - p) < 1e-6
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts(r["text"])
        assert (r["score"], r["fp"], r["labels"]) == ("clash", "clash", "clash")
    assert set(quality.rate(awkward).columns) >= set(awkward.columns)


def test_license_takes_awkward_tables(awkward, nothing):
    assert licenses.scan(nothing).count() == 0
    rows = licenses.scan(awkward).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["shard"], r["fp"]) for r in rows)
    assert got == Counter((r["doc_id"], *base(r["text"]), "clash", "clash") for r in awkward.collect())


def test_sharding(docs, awkward, nothing):
    rows = sharding.shard(docs.select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))).collect()
    slots = {}
    for r in rows:
        data = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        assert r["grown_shard"] in (r["shard"], 16)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    assert sharding.shard(nothing).count() == 0 and sharding.shard(awkward).count() == awkward.count()


def test_sharding_shares_and_movement(spark):
    tree = sharding.Tree((((1.0, 2.0), (1.0,)), ((4.0,),)))
    ids = spark.range(40_000).selectExpr("id AS doc_id")
    one = tree.grow(1, 0, 2.0)
    df = ids.select(sharding.shard_of(ids["doc_id"], tree).alias("a"), sharding.shard_of(ids["doc_id"], one).alias("b"), sharding.shard_of(ids["doc_id"], one.grow(0, 1)).alias("c")).collect()
    n = Counter(r["a"] for r in df)
    assert all(abs(n[s] / 40_000 - w / 8) < 0.01 for s, w in enumerate((1, 2, 1, 4)))
    assert {r["b"] for r in df if r["b"] != r["a"]} == {4} and abs(sum(r["b"] == 4 for r in df) / 40_000 - 0.2) < 0.01
    assert {r["c"] for r in df if r["c"] != r["b"]} == {5}


def test_sharding_draws(spark):
    """Shards by a plain descent of the tree, with the hash library's own draws."""

    def race(key, name, weight):
        h = xxhash.xxh64_intdigest(name, seed=xxhash.xxh64_intdigest(key, seed=42))
        return -math.log(((h >> 11) + 0.5) / 2**53) / weight

    def descend(key, tree):
        first = [sum(len(r) for g in tree.weights[:k] for r in g) for k in range(len(tree.weights))]
        times = [race(key, f"region {g}", sum(map(sum, racks))) for g, racks in enumerate(tree.weights)]
        g = times.index(min(times))
        racks = tree.weights[g]
        r = min(range(len(racks)), key=lambda r: race(key, f"rack {g}/{r}", sum(racks[r])))
        s = min(range(len(racks[r])), key=lambda s: race(key, f"shard {g}/{r}/{s}", racks[r][s]))
        best, out = min(times), first[g] + sum(map(len, racks[:r])) + s
        for i, a in enumerate(tree.added):
            time = race(key, f"added {i} {a.region}/{a.rack}", a.weight)
            if time < best:
                best, out = time, sum(len(r) for g in tree.weights for r in g) + i
        return out

    keys = ["", *map(str, range(-50, 1500))]
    trees = [sharding.SIXTEEN, sharding.SIXTEEN.grow(0, 0), sharding.Tree((((1.0, 2.0), (1.0,)), ((4.0,),))).grow(1, 0, 2.0)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    for r in df.select("k", *[sharding.shard_of(df["k"], t).alias(f"t{n}") for n, t in enumerate(trees)]).collect():
        assert r[1:] == tuple(descend(r["k"], t) for t in trees)


def test_sharding_of_one_hot_id(spark):
    """Rows of one id and text are numbered in chunks of places, gaplessly."""
    hot = spark.range(60_000).selectExpr("CAST(CASE WHEN id % 3 = 0 THEN id END AS BIGINT) AS doc_id", "'same' AS text", "id AS slot").repartition(4)
    rows = sharding.shard(hot, chunk=1000).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == 60_000 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) > 40_000
