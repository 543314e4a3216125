"""License scans by template-markup matching.

A template is wording with markup: ``[[ ... ]]`` may be absent, ``{{n}}`` stands for up to n words of any kind, and
``{{a|b}}`` for any one of some wordings. Each is compiled into a token automaton (a set of states, one step for each
word) which accepts a place of a text if every mandatory word stands there, in order and exactly. Places to try come
from the template's first mandatory words, looked up by hash among all words of many texts at once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Words, gram_ok, grams, list_array, map_texts, table

#: Phrases and labels that the base scan counts (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label -> wordings with markup. Each starts with mandatory words. Those of text: are whole, disclaimers included; of the
#: long licenses (Apache, GPL, MPL, Creative Commons) it is the notice that files carry.
TEMPLATES = {
    "notice:mit": ["released under the [[terms of the]] mit license", "licensed under the [[terms of the]] mit license", "distributed under the [[terms of the]] mit license"],
    "notice:apache-2.0": ["licensed under the apache license version 2 0 [[the license you may not use this file except in compliance with the license]]", "released under the apache license version 2 0"],
    "notice:cc-by-nc": ["licensed under [[a]] [[creative commons]] cc by nc {{3 0|4 0}} [[international]] [[license]]", "licensed under a creative commons attribution noncommercial {{2}} license"],
    "notice:cc-by": ["licensed under [[a]] cc by {{3 0|4 0}} [[international]] [[license]]"],
    "notice:cc-by-sa": ["licensed under [[a]] cc by sa {{3 0|4 0}} [[international]] [[license]]"],
    "notice:gpl": ["under the terms of the gnu general public license [[as published by the free software foundation]] [[either]] version {{2|3}} [[of the license]] [[or at your option any later version]]"],
    "notice:bsd": ["use of this source code is governed by a bsd style license [[that can be found in the license file]]"],
    "notice:mpl-2.0": ["subject to the terms of the mozilla public license v 2 0"],
    "text:mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{the authors or copyright holders|the authors|the copyright holders}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ],
    "text:isc": ["permission to use copy modify and {{or|}} distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {{the author disclaims|isc disclaims|the authors disclaim|copyright holder disclaims}} all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{the author|isc|the authors|copyright holder}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"],
    "text:bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met {{1}} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer {{1}} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [[{{1}} neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission]] "
        "this software is provided by {{12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
    ],
    "text:zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions {{1}} the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required {{1}} altered source versions must be plainly marked as such and must not be misrepresented as being the original software {{1}} this notice may not be removed or altered from any source distribution"
    ],
    "text:unlicense": ["this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software [[for more information please refer to {{http|https}} unlicense org]]"],
    "text:apache-2.0-notice": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [[{{1}} www apache org licenses license 2 0]] unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"
    ],
    "text:gpl-notice": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation {{either version 2|either version 3|version 2|version 3}} of the license [[or at your option any later version]] this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"
    ],
    "text:mpl-2.0-notice": ["this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at {{1}} mozilla org mpl 2 0"],
}
MARKUP = re.compile(r"\[\[|\]\]|\{\{.*?\}\}|[^\s\[\]{}]+")
FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))), T.StructField("score", T.DoubleType()),
]


def _hashes(text: str) -> list[int]:
    return Words(pa.array([text.lower()]), ALNUM).hashes.tolist()


@dataclass
class Automaton:
    """States in a row: steps[i] has the words that lead on from state i (word -> state, None: any word), skips[i] the free moves."""

    label: str
    steps: list[dict[int | None, set[int]]]
    skips: list[set[int]]
    prefix: list[int]
    mandatory: int

    @classmethod
    def compile(cls, label: str, template: str) -> Automaton:
        steps: list[dict] = [{}]
        skips: list[set[int]] = [set()]
        opened: list[int] = []
        prefix, straight, mandatory = [], True, 0

        def new() -> int:
            steps.append({})
            skips.append(set())
            return len(steps) - 1

        def word(start: int, h: int | None) -> int:
            steps[start].setdefault(h, set()).add(end := new())
            return end

        at = 0
        for token in MARKUP.findall(template):
            if token == "[[":
                opened.append(at)
                straight = False
            elif token == "]]":
                end = new()
                skips[at].add(end)
                skips[opened.pop()].add(end)
                at = end
            elif token.startswith("{{"):
                straight, body = False, token[2:-2]
                if body.isdigit():
                    ends = [at]
                    for _ in range(int(body)):
                        ends.append(word(ends[-1], None))
                else:
                    ends = []
                    for choice in body.split("|"):
                        place = at
                        for h in _hashes(choice):
                            place = word(place, h)
                        ends.append(place)
                end = new()
                for place in ends:
                    skips[place].add(end)
                at = end
            else:
                for h in _hashes(token):
                    at = word(at, h)
                    if straight:
                        prefix.append(h)
                    mandatory += not opened
        if opened or not prefix:
            raise ValueError(f"the template of {label} must start with mandatory words and close its optional regions")
        return cls(label, steps, skips, prefix, mandatory)

    def match(self, words: np.ndarray, start: int, stop: int) -> int:
        """Where the longest accepted run of words that starts at start ends; -1 if none does."""

        def closed(states: set[int]) -> set[int]:
            todo, seen = list(states), set(states)
            while todo:
                for x in self.skips[todo.pop()] - seen:
                    seen.add(x)
                    todo.append(x)
            return seen

        final, best = len(self.steps) - 1, -1
        now = closed({0})
        for at in range(start, stop + 1):
            if final in now:
                best = at
            if at == stop or not now:
                break
            w = int(words[at])
            now = closed(set().union(*(self.steps[x].get(k, ()) for x in now for k in (w, None))))
        return best


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]]):
        self.phrases = [(label, np.uint64(h), k, np.array(words, np.uint64)) for phrase, label in phrases.items() for words in [_hashes(phrase)] for k, h in [self._key(words)]]
        self.automata = [(a, np.uint64(h), k) for label, texts in templates.items() for t in texts for a in [Automaton.compile(label, t)] for k, h in [self._key(a.prefix)]]

    @staticmethod
    def _key(hashes: list[int]) -> tuple[int, int]:
        """How many first words, four at most, places are looked up by, and their hash."""
        k = min(len(hashes), 4)
        if not k:
            raise ValueError("a phrase needs a word")
        return k, int(grams(np.array(hashes[:k], np.uint64), k)[0])

    def scan(self, column: pa.Array) -> tuple[Words, list[list[tuple]]]:
        w = Words(column, ALNUM)
        n, doc = len(w.hashes), w.doc
        places: list[list[tuple]] = [[] for _ in range(len(w.counts))]
        keyed = {}
        wanted = [x[1:3] for x in [*self.phrases, *self.automata]]
        for k in {k for _, k in wanted}:
            g, keys = grams(w.hashes, k), np.unique(np.array([h for h, kk in wanted if kk == k], np.uint64))
            at = np.flatnonzero(gram_ok(w.offsets, n, k))
            where = np.minimum(np.searchsorted(keys, g[at]), len(keys) - 1)
            hit = keys[where] == g[at]
            keyed[k] = (at[hit], g[at[hit]])
        for label, h, k, own in self.phrases:
            at, g = keyed[k]
            for x in at[g == h].tolist():
                d, end = doc[x], x + len(own)
                if end <= w.offsets[d + 1] and (w.hashes[x:end] == own).all():  # all its words, not only the first
                    places[d].append((label, x - int(w.offsets[d]), end - int(w.offsets[d]), True, 0.5))
        for a, h, k in self.automata:
            at, g = keyed[k]
            for x in at[g == h].tolist():
                d = doc[x]
                end = a.match(w.hashes, x, int(w.offsets[d + 1]))
                if end > 0:
                    base = int(w.offsets[d])
                    places[d].append((a.label, x - base, end - base, False, 0.5 + 0.5 * min(1.0, a.mandatory / (end - x))))
        return w, places


def scan_licenses(docs: DataFrame, keep: list[str] | None = None, text: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """Each document with n_words, places (label, start, end in words, and whether a base phrase or a template) and score.

    score: 0 without any place, 0.5 with base phrases alone, above that for templates (the share of mandatory words in
    the accepted run, from 0.5 to 1; the best place counts). Null or empty texts have no words and no places; repeated
    documents each get their row; an input column named like a result gives way to it; places of one start are ordered by
    end and label; an empty table gives no rows. No shuffle, no state beyond the
    compiled templates.
    """
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates

    def start():
        scanner = Scanner(phrases, templates)

        def step(batch: pa.RecordBatch) -> list[pa.Array]:
            w, places = scanner.scan(batch.column(text))
            flat = [p for x in places for p in sorted(x, key=lambda p: (p[1], p[2], p[0]))]
            columns = [pa.array([p[i] for p in flat], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.bool_()))]
            pair = pa.StructArray.from_arrays(columns, ["label", "start", "end", "base"])
            return [pa.array(w.counts), list_array(pair, np.array([len(x) for x in places], np.int64)), pa.array([max([0.0, *(p[4] for p in x)]) for x in places])]

        return step

    return map_texts(docs, FIELDS, start, docs.columns if keep is None else keep, text)


def op10_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"]).withColumn("b", F.expr("filter(places, p -> p.base)"))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size("b").cast("long").alias("n_base"),
        F.array_min(F.transform("b", lambda p: p["start"])).cast("long").alias("first_word"), F.array_max(F.transform("b", lambda p: p["start"])).cast("long").alias("last_word"),
        labels("b").alias("base_labels"), labels("places").alias("labels"), "score",
    )
