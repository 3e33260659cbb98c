"""Licence detection with a positional rare-token index."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._text import SPACED, slices

#: base phrases and their labels
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: (label, notice, mandatory key phrases of which one must stand at its place); fixed values
NOTICES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("gpl", "this work is licensed under the gnu general public license", ("gnu general public license",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("general public license version 2",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("bsd", "licensed under the bsd license", ("bsd license",)),
    ("mpl-2.0", "licensed under the mozilla public license version 2 0", ("mozilla public license",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc0", "dedicated to the public domain under cc0 1 0", ("cc0 1 0",)),
    ("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0 international", ("attribution noncommercial",)),
    # paragraphs of licence texts and of the notices that they ask for
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ("to deal in the software without restriction", "use copy modify merge publish distribute sublicense")),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise", ("warranties of merchantability fitness for a particular purpose and noninfringement",)),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice")),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("used to endorse or promote products derived from this software",)),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", ("provided by the copyright holders and contributors as is",)),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("you may not use this file except in compliance with the license",)),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("distributed on an as is basis without warranties or conditions of any kind",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("under the terms of the gnu general public license",)),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("see the gnu general public license for more details",)),
    ("gpl-3.0", "published by the free software foundation either version 3 of the license or at your option any later version", ("either version 3 of the license or at your option any later version",)),
    ("gpl-2.0", "published by the free software foundation either version 2 of the license or at your option any later version", ("either version 2 of the license or at your option any later version",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("under the terms of the gnu lesser general public license",)),
    ("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("subject to the terms of the mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("for any purpose with or without fee is hereby granted",)),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ("to alter it and redistribute it freely",)),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("person or organization obtaining a copy of the software",)),
    ("boost", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("free and unencumbered software released into the public domain",)),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license 2 0",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international",)),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0",)),
    ("cc0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("proprietary", "all rights reserved", ("all rights reserved",)),
)


@dataclass
class LicenceIndex:
    """Postings of each mandatory phrase's rarest word (template, place), and the words' weights from the corpus.

    A notice counts only with a mandatory phrase in place, so the rarest word of every phrase leads to
    every place where a notice can stand: the weights decide how many places are looked at, not which notices are found.
    """

    idf: dict[bytes, float] = field(default_factory=dict)
    coverage: float = 0.6

    def __post_init__(self):
        self.words = [n.encode().split() for _, n, _ in NOTICES]
        self.vocabulary = {w for ws in self.words for w in ws}
        self.postings, self.must = defaultdict(list), []
        for t, (ws, (_, _, keys)) in enumerate(zip(self.words, NOTICES, strict=True)):
            for key in (k.encode().split() for k in keys):
                at = self._place(ws, key)
                q = max(range(len(key)), key=lambda q: self.idf.get(key[q], 0.0))
                self.postings[key[q]].append((t, at, q, key))
                self.must.append(frozenset(key))
        self.base = [p.encode().split() for p, _ in BASE]

    @staticmethod
    def _place(words, key) -> int:
        return next(i for i in range(len(words)) if words[i : i + len(key)] == key)

    def scan(self, text: bytes):
        """n_words, base places (word number of their first word, phrase), labels, score, (label, start, end, coverage) spans."""
        words = text.translate(SPACED).split()
        present = self.vocabulary & set(words)
        places, spans = [], []
        if b"license" in present:
            for i, w in enumerate(words):
                if w == b"license":
                    for b, phrase in enumerate(self.base):
                        s = i + 1 - len(phrase)
                        if s >= 0 and words[s : i + 1] == phrase:
                            places.append((s, b))
        if any(m <= present for m in self.must):
            starts = set()
            for i, w in enumerate(words):
                for t, at, q, key in self.postings.get(w, ()):
                    if i >= q and words[i - q : i - q + len(key)] == key:
                        starts.add((t, i - q - at))
            for t, at in starts:
                ws = self.words[t]
                same = sum(0 <= at + q < len(words) and words[at + q] == w for q, w in enumerate(ws)) / len(ws)
                if same >= self.coverage:
                    spans.append((NOTICES[t][0], max(at, 0), min(at + len(ws), len(words)), same))
        labels = {BASE[b][1] for _, b in places} | {s[0] for s in spans}
        score = max([s[3] for s in spans] + [0.5] * bool(places), default=0.0)
        return len(words), places, labels, score, sorted(set(spans), key=lambda s: (s[1], s[0], *s[2:]))


def _frequencies(batches):
    import pyarrow as pa

    vocabulary = {w for _, n, _ in NOTICES for w in n.encode().split()}
    df, n = Counter(), 0
    for _, texts in slices(batches):
        for t in texts:
            df.update(vocabulary & set(t.translate(SPACED).split()))
        n += len(texts)
    words = sorted(df)
    yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words] + [""]), pa.array([df[w] for w in words] + [n], pa.int64())], ["word", "n"])


def licence_index(docs: DataFrame) -> LicenceIndex:
    """The index, with inverse document frequencies over all documents (one row a licence word and task)."""
    counts = {r[0]: r[1] for r in docs.select("text").mapInArrow(_frequencies, "word string, n long").groupBy("word").agg(F.sum("n")).collect()}
    total = counts.pop("", 0)
    return LicenceIndex({w.encode(): math.log((total + 1) / (counts.get(w, 0) + 0.5)) for _, n, _ in NOTICES for w in n.split()})


def _scan(index: LicenceIndex):
    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        kinds = [None, *[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))]
        for rows, texts in slices(batches):
            out = [[] for _ in names[1:]]
            for t in texts:
                n, places, labels, score, spans = index.scan(t)
                at = [s for s, _ in places]
                row = (n, len(places), min(at, default=None), max(at, default=None), ",".join(sorted({BASE[b][1] for _, b in places})), ",".join(sorted(labels)), score, [dict(zip(("label", "first", "end", "coverage"), s, strict=True)) for s in spans])
                for c, x in zip(out, row, strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, k) for c, k in zip(out, kinds[1:], strict=True))], names)

    return run


def license_scan(docs: DataFrame, index: LicenceIndex | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and notice spans, one row a row.

    Whole texts are scanned, however long; repeated rows come out alike; an empty table gives no rows;
    only doc_id and text are read, whatever other columns there are. Words are runs of ASCII letters and digits or of any other characters above ASCII, with A-Z
    lower-cased. Null texts are empty: no words, no labels, score 0. A base phrase without a whole
    notice scores 0.5; else the score is the best share of a notice's words found in place.
    """
    index = index or licence_index(docs)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,end:long,coverage:double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(index), schema)
