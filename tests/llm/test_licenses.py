"""Licence scans: notices as files hold them, and the classifier in plain Python."""

import math
import random

from pyspark.sql import functions as F

from coppice.llm import licenses

MIT = """MIT License

Copyright (c) 2021 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
GPL2 = GPL3.replace("version 3 of the License", "version 2 of the License").replace("Foundation, either","Foundation; either")
LGPL = GPL3.replace("GNU General Public", "GNU Lesser General Public").replace("version 3 of","version 2.1 of")
AGPL = GPL3.replace("GNU General Public", "GNU Affero General Public")
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
ACME = "Licensed under the Acme Commercial License, Version 2.0."
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.
Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
FOO = "Released under the Foo Public License, version 3."
EULA = "This software is licensed under the terms of the Initech End User License Agreement."
CASES = [("MIT", MIT, ["MIT"]), ("MIT one line", " ".join(MIT.split()), ["MIT"]), ("BSD", BSD, ["BSD"]), ("GPL3", GPL3, ["GPL-3.0"]), ("GPL2", GPL2, ["GPL-2.0"]), ("LGPL", LGPL, ["LGPL"]), ("AGPL", AGPL, ["AGPL"]), ("APACHE", APACHE, ["Apache-2.0"]), ("ACME", ACME, []), ("ISC", ISC, []), ("BOOST", BOOST, []), ("ZLIB", ZLIB, []), ("MPL", MPL, ["MPL-2.0"]), ("FOO", FOO, []), ("EULA", EULA, [])]
CASES += [(n+" commented", "\n".join(" * "+l for l in t.split("\n")), w) for n,t,w in CASES]


def test_notices_of_files(spark):
    df = spark.createDataFrame([(i, t, "x") for i, (_, t, _) in enumerate(CASES)], "doc_id long, text string, _found string")
    out = licenses.scan(df)
    got = {r.doc_id: r for r in out.collect()}
    assert [(n, got[i].licenses) for i, (n, _, _) in enumerate(CASES)] == [(n, want) for n, _, want in CASES]
    assert all(got[i].unknown_notices > 0 for i, (_, _, want) in enumerate(CASES) if not want)
    assert "_found" in out.columns and licenses.scan(df.limit(0)).count() == 0


def by_hand(line: str, model: licenses.Classifier, least: float):
    """Family, probability and confirmation of a paragraph, by the definitions."""
    tokens = licenses._tokens(line)
    grams = {" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)}
    z = [b + (model.offset if f == licenses.UNKNOWN else 0) for f, b in zip(model.families, model.bias)]
    for g in grams & model.weights.keys():
        z = [a + b for a, b in zip(z, model.weights[g])]
    total = sum(math.exp(x - max(z)) for x in z)
    family = model.families[z.index(max(z))]
    share = 0.0
    if family != licenses.UNKNOWN:
        pairs = {" ".join(p) for p in zip(tokens, tokens[1:])}
        share = max(len(pairs & {*p}) / len(p) if 2 * len(pairs & {*o}) >= len(o) else 0.0 for p, o in licenses.template_pairs()[family])
    return family, 1 / total, share >= least and 1 / total > 0.5


def test_classifier_by_hand(spark):
    rng, model = random.Random(9), licenses.train(1)
    words = [w for t in [*sum(licenses.TEMPLATES.values(), []), *licenses.ORDINARY, *licenses.FOREIGN] for w in licenses._tokens(t)]
    lines = [t for texts in licenses.TEMPLATES.values() for t in texts] + licenses.ORDINARY + licenses.FOREIGN
    lines += [" ".join(rng.choices(words, k=rng.randrange(1, 25))) for _ in range(60)]
    lines += [" ".join(w for w in t.split() if rng.random() > 0.3) for t in lines[:60]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string")
    for r in df.select("i", licenses.classify(F.col("t"), model, 0.6).alias("x")).collect():
        family, probability, confirmed = by_hand(lines[r.i], model, 0.6)
        assert (r.x.family, r.x.confirmed) == (family, confirmed) and abs(r.x.probability - probability) < 1e-9, lines[r.i]


def test_long_text_and_repeated_rows(spark):
    long = "words of no notice at all\n" * 20_000 + "Released under the MIT License."
    out = licenses.scan(spark.createDataFrame([(1, long), (1, long), (2, None), (None, "x")], "doc_id long, text string")).collect()
    assert sorted(r.licenses for r in out) == [[], [], ["MIT"], ["MIT"]]
