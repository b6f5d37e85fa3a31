"""Licence texts by template markup compiled to token automata.

Markup: `[words]` may be left out, `{n}` stands for up to n free words (a holder, a year, a title), and
regions nest; all else must stand word for word. A template compiles to a nondeterministic automaton
over words, its states a set of bits; it is started at the places of its first word, which is mandatory,
and walks on while a state lives. A text that reaches the end of a template has its label.

The score is 1 for an accepted template, else the larger of 0.5 for a base phrase and half the share of
its mandatory words that the best started automaton had consumed, a graded near miss.

A null or empty text has no words, no labels and score 0. Texts are read whole, however long. Rows are
judged one by one, so repeated rows and ids get a row each and a null id is kept; columns other than
doc_id and text are not read; an empty table gives no rows.
"""
import re
from collections import defaultdict

from pyspark.sql import DataFrame

from .common import add_columns, columns_of, words

# Base phrases with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_DISCLAIMER = ("as is [and] [without warranty of any kind] [and] [any] express or implied [warranties] including but not limited to the [implied] warranties of "
               "merchantability [and] fitness for a particular purpose")
# Wording of public licences and their notices, with markup.
TEMPLATES = [
    ("mit", "released under [the terms of] the mit license"),
    ("mit", "licensed under [the terms of] the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in "
            "the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of "
            "the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this "
            "permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software "
            "[the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
            "fitness for a particular purpose and noninfringement]"),
    ("apache-2", "licensed under the apache license [as published] version 2 [0]"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
                 "[you may obtain a copy of the license at {10} unless required by applicable law or agreed to in writing software distributed under the license is "
                 "distributed on an as is basis without warranties or conditions of any kind either express or implied]"),
    ("cc-by-nc", "licensed under [a] [creative commons] cc by nc [{1}] [4] [0]"),
    ("cc-by-nc", "licensed under [a] [the] creative commons attribution non commercial [share alike] [no derivatives] [4 0] [3 0] [international] [unported] license"),
    ("cc-by-nc", "licensed under [a] [the] creative commons attribution noncommercial [sharealike] [noderivatives] [noderivs] [4 0] [3 0] [international] [unported] license"),
    ("cc-by-sa", "licensed under [a] [the] creative commons attribution share alike [4 0] [3 0] [international] [unported] license"),
    ("cc-by-sa", "licensed under [a] [the] creative commons attribution sharealike [4 0] [3 0] [international] [unported] license"),
    ("cc-by", "licensed under [a] [the] creative commons attribution [4 0] [3 0] [international] [unported] license"),
    ("cc-by-sa", "licensed under [a] [creative commons] cc by sa"),
    ("cc0", "to the extent possible under law {12} waived all copyright and related or neighboring rights to this work"),
    ("gpl-3", "licensed under the [gnu] general public license {2} version 3"),
    ("gpl-2", "licensed under the [gnu] general public license {2} version 2"),
    ("gpl-3", "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
              "foundation either version 3 of the license or [at your option] any later version"),
    ("gpl-2", "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
              "foundation either version 2 of the license or [at your option] any later version"),
    ("lgpl", "free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free "
             "software foundation either version [2] [2 1] [3] of the license or [at your option] any later version"),
    ("lgpl", "free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free "
             "software foundation either version [2] [2 1] [3] of the license or [at your option] any later version"),
    ("agpl-3", "free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software "
               "foundation either version 3 of the license or [at your option] any later version"),
    ("bsd-2", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
              "[1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
              "[2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
              "and or other materials provided with the distribution [this software is provided by {20} " + _DISCLAIMER + "]"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
              "[1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
              "[2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
              "and or other materials provided with the distribution [3] neither the name of {12} nor the names of {4} contributors may be used to endorse or promote "
              "products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright "
            "notice and this permission notice appear in all copies"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0 [if a copy of the mpl was not distributed with this file you can obtain one at {8}]"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely "
             "subject to the following restrictions"),
    ("unlicense", "free and unencumbered software released into the public domain"),
    ("mit", "spdx license identifier mit"),
    ("apache-2", "spdx license identifier apache 2 0"),
    ("gpl-2", "spdx license identifier gpl 2 0 [only] [or later]"),
    ("gpl-3", "spdx license identifier gpl 3 0 [only] [or later]"),
    ("bsd-2", "spdx license identifier bsd 2 clause"),
    ("bsd-3", "spdx license identifier bsd 3 clause"),
    ("mpl-2", "spdx license identifier mpl 2 0"),
    ("cc-by-nc", "spdx license identifier cc by nc"),
]


class Automaton:
    """States are places between tokens; bit i of a set stands for place i."""

    def __init__(self, template):
        tokens, opened, self.skips = [], [], defaultdict(int)
        self.words, self.free, self.mandatory = defaultdict(int), 0, []
        for piece in re.findall(r"\[|\]|\{\d+\}|[^\s\[\]]+", template):
            if piece == "[":
                opened.append(len(tokens))
            elif piece == "]":
                self.skips[opened.pop()] |= 1 << len(tokens)
            elif piece[0] == "{":
                for _ in range(int(piece[1:-1])):
                    self.skips[len(tokens)] |= 1 << len(tokens) + 1
                    tokens.append(None)
            else:
                if not opened:
                    self.mandatory.append(len(tokens))
                tokens.append(piece.encode())
        if opened or self.mandatory[:1] != [0]:
            raise ValueError("a template starts with a mandatory word and closes its regions")
        for i, w in enumerate(tokens):
            if w is None:
                self.free |= 1 << i
            else:
                self.words[w] |= 1 << i
        self.words, self.end, self.first = dict(self.words), 1 << len(tokens), tokens[0]
        # Skips closed under following one another, from the last place to the first.
        for i in range(len(tokens), -1, -1):
            todo = self.skips.pop(i, 0)
            reach = todo
            while todo:
                low = todo & -todo
                reach |= self.skips.get(low.bit_length() - 1, 0)
                todo ^= low
            if reach:
                self.skips[i] = reach
        self.jumps = sum(1 << i for i in self.skips)

    def _close(self, states):
        todo = states & self.jumps
        while todo:
            low = todo & -todo
            states |= self.skips[low.bit_length() - 1]
            todo ^= low
        return states

    def run(self, found, at):
        """(accepted, share of the mandatory words consumed) from a place."""
        states, best = self._close(1), 0
        while at < len(found):
            states = self._close((states & (self.free | self.words.get(found[at], 0))) << 1)
            if not states:
                break
            if states & self.end:
                return True, 1.0
            best = max(best, states.bit_length() - 1)
            at += 1
        return False, sum(i < best for i in self.mandatory) / len(self.mandatory)


class Library:
    """Automata and phrases by their first word."""

    def __init__(self, phrases=None, templates=None):
        self.phrases, self.automata = defaultdict(list), defaultdict(list)
        for k, v in (PHRASES if phrases is None else phrases).items():
            self.phrases[k.encode().split()[0]].append((k.encode().split(), v))
        for label, text in TEMPLATES if templates is None else templates:
            a = Automaton(text)
            self.automata[a.first].append((a, label))
        self.heads = set(self.phrases) | set(self.automata)


def scan(text, library=None):
    found = words(text)
    library = library or Library()
    places, base, extra, near = [], set(), set(), 0.0
    for i, w in enumerate(found):
        if w in library.heads:
            for p, label in library.phrases.get(w, ()):
                if found[i:i + len(p)] == p:
                    places.append(i)
                    base.add(label)
            for a, label in library.automata.get(w, ()):
                accepted, share = a.run(found, i)
                near = max(near, share)
                if accepted:
                    extra.add(label)
    score = 1.0 if extra else max(0.5 if base else 0.0, 0.5 * near if near >= 0.5 else 0.0)
    return (len(found), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | extra)), score)


def licenses(docs: DataFrame) -> DataFrame:
    """One row for each document."""
    def make():
        library = Library()
        return lambda texts: columns_of((scan(t, library) for t in texts), 7)

    return add_columns(docs.select("doc_id", "text"), ["doc_id"], ["text"],
                       "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", make)
