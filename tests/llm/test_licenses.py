"""Licence texts as they stand in files: wrapped, signed, with comment marks, changed words and cut ends."""

import random

from tests.llm.fixtures import documents
from tilewater.llm import licenses

MIT = """MIT License

Copyright (c) 2019 Jane Doe and others

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
SOFTWARE.
"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 2 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
"""


def _spelt(text):
    """Words of a contract, spelt out."""
    return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()


def _brute(texts, weights):
    """Every start of every template in every text, word by word."""
    out = {}
    for i, text in texts.items():
        w, found = _spelt(text), set()
        for t in licenses.TEMPLATES:
            p, key = t.text.split(), t.key.split()
            at = next(j for j in range(len(p)) if p[j : j + len(key)] == key)
            for start in range(-len(p), len(w)):
                said = [0 <= start + j < len(w) and w[start + j] == x for j, x in enumerate(p)]
                score = sum(weights[x] for x, hit in zip(p, said, strict=True) if hit) / sum(weights[x] for x in p)
                if all(said[at : at + len(key)]) and (score == 1 if t.base else score >= licenses.ACCEPT):
                    found.add((start, t.label, round(score, 9)))
        out[i] = found
    return out


def test_whole_licence_texts(spark):
    rnd = random.Random(3)
    texts = {1: MIT, 2: "int main;\n" * 50 + GPL, 3: MIT.replace("merge, publish, ", "merge, print, "), 4: MIT[MIT.index("copies or sub") :], 5: "", 6: GPL[: GPL.index("useful")]}
    for i in range(10, 40):  # pieces of the templates between other words
        parts = [rnd.choice(licenses.TEMPLATES).text.split() for _ in range(3)]
        texts[i] = " ".join(w for p in parts for w in p[rnd.randrange(3) : len(p) - rnd.randrange(3)] if rnd.random() > 0.01)
    docs = documents(spark, [(i, t) for i, t in texts.items()])
    weights = licenses.word_weights(docs)
    got = {r.doc_id: {(x.start, x.label, round(x.score, 9)) for x in r.found} for r in licenses.scan(docs).collect()}
    assert got == _brute(texts, weights)
    labels = {i: {x[1] for x in found} for i, found in got.items()}
    assert labels[1] == {"mit", "mit-notice", "mit-grant", "mit-condition", "mit-warranty"} and labels[3] == labels[1]
    assert labels[2] == {"gpl", "gpl-header", "gpl-warranty"}
    assert "mit-warranty" in labels[4] and not {"mit-grant", "mit-condition"} & labels[4] and labels[5] == set()
    assert "gpl-warranty" not in labels[6]
