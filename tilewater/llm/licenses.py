"""License scans by a positional index of rare words.

Templates are names of licenses, opening lines of notices and whole paragraphs of licence texts, cut where names and years stand. For each, the words of its key phrase with the highest inverse document frequency in the
corpus are its anchors, so no place that could be accepted lacks one. Every place of an anchor in a file is looked up in the postings (template, position in it); postings that agree on
`place - position` name one candidate start, which is scored by the weight of the template words that stand at
their relative positions and must hold the template's key phrase in full.

Defined results: null and empty texts have no words, no labels and score 0; rows are kept one to one; an empty table has no weights
to learn and no rows to label.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewater.llm.common import array_lit, ascii_lower, words


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str
    base: bool = False


#: fixed values: label, words of the notice, mandatory key phrase (part of the words); base templates must stand word for word
TEMPLATES = (
    Template("mit", "mit license", "mit license", True),
    Template("apache", "apache license", "apache license", True),
    Template("gpl", "general public license", "general public license", True),
    Template("agpl-notice", "gnu affero general public license", "affero general public license"),
    Template("apache-2.0-notice", "licensed under the apache license version 2 0", "apache license version 2"),
    Template("boost-notice", "boost software license version 1 0", "boost software license"),
    Template("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted",
             "redistribution and use in source and binary forms"),
    Template("cc-by-notice", "licensed under a creative commons attribution", "creative commons attribution"),
    Template("epl-notice", "eclipse public license version 2 0", "eclipse public license"),
    Template("gpl-2-notice", "licensed under the gnu general public license version 2", "public license version 2"),
    Template("gpl-3-notice", "licensed under the gnu general public license version 3", "public license version 3"),
    Template("isc-notice", "permission to use copy modify and or distribute this software for any purpose",
             "permission to use copy modify and or distribute"),
    Template("lgpl-notice", "gnu lesser general public license", "lesser general public license"),
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             "permission is hereby granted free of charge"),
    Template("mit-release", "released under the mit license", "the mit license"),
    Template("mpl-notice", "subject to the terms of the mozilla public license", "mozilla public license"),
    Template("unlicense-notice", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("apache-2.0-header",
             "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy "
             "of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under "
             "the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the "
             "specific language governing permissions and limitations under the license",
             "you may not use this file except in compliance with the license"),
    Template("bsd-binary-clause",
             "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
             "documentation and or other materials provided with the distribution",
             "redistributions in binary form must reproduce"),
    Template("bsd-source-clause",
             "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
             "redistributions of source code must retain"),
    Template("bsd-warranty",
             "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the "
             "implied warranties of merchantability and fitness for a particular purpose are disclaimed",
             "by the copyright holders and contributors as is"),
    Template("gpl-header",
             "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
             "software foundation either version 3 of the license or at your option any later version",
             "under the terms of the gnu general public license as published by the free software foundation"),
    Template("gpl-warranty",
             "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or "
             "fitness for a particular purpose see the gnu general public license for more details",
             "in the hope that it will be useful but without any warranty"),
    Template("isc-grant",
             "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
             "copyright notice and this permission notice appear in all copies",
             "with or without fee is hereby granted"),
    Template("mit-condition",
             "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
             "shall be included in all copies or substantial portions"),
    Template("mit-grant",
             "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal "
             "in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
             "copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
             "to deal in the software without restriction"),
    Template("mit-warranty",
             "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
             "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other "
             "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings "
             "in the software",
             "the software is provided as is without warranty of any kind"),
    Template("mpl-2.0-header",
             "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can "
             "obtain one at https mozilla org mpl 2 0",
             "if a copy of the mpl was not distributed with this file"),
    Template("unlicense-grant",
             "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any "
             "purpose commercial or non commercial and by any means",
             "anyone is free to copy modify publish use compile sell"),
    Template("zlib-grant",
             "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely "
             "subject to the following restrictions",
             "permission is granted to anyone to use this software for any purpose"),
)
ANCHORS, ACCEPT = 3, 0.8
_BIAS, _SHIFT = 1 << 10, 1 << 34


def word_weights(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """Inverse document frequency of every template word over all of `docs`, in thousandths and at least 1."""
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    seen = F.array_intersect(array_lit(vocabulary, "string"), words(ascii_lower(F.col("text"))))
    found = docs.select(F.explode(F.concat(seen, F.array(F.lit("")))).alias("w")).groupBy("w").count()
    df = {r.w: r["count"] for r in found.collect()}  # as many rows as the templates have words, and one for the total
    return {w: max(1, round(1000 * math.log((df.get("", 0) + 1) / (df.get(w, 0) + 1)))) for w in vocabulary}


def _key_range(t: Template) -> tuple[int, int]:
    all_words, key = t.text.split(), t.key.split()
    at = next(i for i in range(len(all_words)) if all_words[i : i + len(key)] == key)
    return at, at + len(key)


def scan(docs: DataFrame, templates=TEMPLATES, weights: dict[str, int] | None = None, accept: float = ACCEPT) -> DataFrame:
    """doc_id, n_words and `found`: label, base, start (words from 0), score of every place of a template, in order of start."""
    weights = weights or word_weights(docs, templates)
    parts = [t.text.split() for t in templates]
    anchors = [sorted(set(t.key.split()), key=lambda w: (-weights[w], w))[:ANCHORS] for t in templates]
    postings = [(w, k, i) for k, p in enumerate(parts) for i, w in enumerate(p) if w in anchors[k]]
    lookup = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(k).cast("long").alias("k"), F.lit(i).alias("i")) for w, k, i in postings])
    forms = F.array(*[
        F.struct(
            F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), array_lit(p, "string").alias("words"),
            array_lit([weights[w] for w in p], "int").alias("weights"), F.lit(float(sum(weights[w] for w in p))).alias("total"),
            F.lit(_key_range(t)[0]).alias("key_from"), F.lit(_key_range(t)[1]).alias("key_to"),
        )
        for t, p in zip(templates, parts, strict=True)
    ])
    rare = sorted({w for a in anchors for w in a})
    df = docs.select("doc_id", words(ascii_lower(F.col("text"))).alias("w"))
    w = F.col("w")
    df = df.select("doc_id", "w", F.when(F.arrays_overlap(w, array_lit(rare, "string")), w).alias("file"))
    file = F.col("file")
    places = F.filter(F.sequence(F.lit(0), F.size(file) - 1), lambda i: F.get(file, i).isin(rare))
    starts = F.transform(places, lambda i: F.transform(
        F.filter(lookup, lambda p: p["w"] == F.get(file, i)), lambda p: p["k"] * _SHIFT + (i - p["i"]) + _BIAS))
    df = df.select("doc_id", "w", "file", F.array_distinct(F.flatten(starts)).alias("starts"))

    def score(c: Column) -> Column:
        form, at = F.get(forms, (c / _SHIFT).cast("int")), (c % _SHIFT).cast("int") - _BIAS
        hit = lambda j: F.coalesce(F.get(file, at + j) == F.get(form["words"], j), F.lit(False))
        every = F.sequence(F.lit(0), F.size(form["words"]) - 1)
        got = F.aggregate(every, F.lit(0), lambda acc, j: acc + F.when(hit(j), F.get(form["weights"], j)).otherwise(0))
        key = F.forall(F.sequence(form["key_from"], form["key_to"] - 1), hit)
        return F.struct(at.alias("start"), form["label"].alias("label"), form["base"].alias("base"),
                        (got / form["total"]).alias("score"), key.alias("key"))

    scored = F.transform("starts", score)
    keep = F.filter(scored, lambda x: x["key"] & F.when(x["base"], x["score"] == 1).otherwise(x["score"] >= accept))
    return df.select(
        "doc_id", F.size("w").cast("long").alias("n_words"),
        F.array_sort(F.coalesce(keep, F.array().cast("array<struct<start:int,label:string,base:boolean,score:double,key:boolean>>"))).alias("found"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: base places and labels, labels of the method too, and the best score."""
    df = scan(docs)
    base = F.filter("found", lambda x: x["base"])
    names = lambda xs: F.array_join(F.sort_array(F.array_distinct(F.transform(xs, lambda x: x["label"]))), ",")
    starts = F.transform(base, lambda x: x["start"].cast("long"))
    return df.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )
