"""License scans: fixed phrases, plus template markup compiled to token automata.

A template is wording with optional and replaceable regions:

    <<var;least=1;most=8>>                       any words, so many of them
    <<beginOptional>> ... <<endOptional>>        may be missing; nests

Each template becomes an automaton over words whose states are places in the template; a text's words are run
through it from every place where its first mandatory word stands, and it accepts only if all mandatory wording
matches word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans(UPPER, LOWER)
#: Typographic quotes: parts of words in phrases, which are the contract's, but not in templates.
QUOTES = "\u2018\u2019\u201c\u201d"

#: Fixed by the contract: phrase -> label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label -> templates. Headers and notices as licensors publish them, with their variable parts marked.
TEMPLATES = {
    "mit-notice": [
        "<<beginOptional>>this <<var;least=1;most=2>> is<<endOptional>> <<beginOptional>>released<<endOptional>> <<beginOptional>>licensed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> mit license",
    ],
    "mit-text": [
        "permission is hereby granted free of charge to any person obtaining a copy of this <<var;least=1;most=10>> to deal in the <<var;least=1;most=3>> without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the <<var;least=1;most=3>>",
    ],
    "apache-2.0": [
        "licensed under the apache license version 2 0 <<beginOptional>>the license you may not use this file except in compliance with the license<<endOptional>>",
    ],
    "gpl-notice": [
        "<<beginOptional>>this <<var;least=1;most=3>> is<<endOptional>> <<beginOptional>>free software you can redistribute it and or modify it<<endOptional>> <<beginOptional>>licensed<<endOptional>> under <<beginOptional>>the terms of<<endOptional>> the gnu <<beginOptional>>lesser<<endOptional>> <<beginOptional>>affero<<endOptional>> general public license <<beginOptional>>as published by the free software foundation either<<endOptional>> version <<var;least=1;most=2>>",
    ],
    "bsd-text": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ],
    "cc-notice": [
        "<<beginOptional>>this <<var;least=1;most=2>> is<<endOptional>> licensed under a creative commons <<var;least=1;most=6>> license",
    ],
}

_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright
    notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form
    must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
    other materials provided with the distribution."""
_BSD_NAMES = """<<beginOptional>>3.<<endOptional>> Neither the name of <<var;least=1;most=12>> nor the names of its contributors may be used
    to endorse or promote products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY <<var;least=1;most=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
    NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
    SHALL <<var;least=1;most=12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
    (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
    INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
    NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: label -> templates of whole licences, as published, with the parts marked that licensors fill in. A text in which any
#: other word was altered, added or left out gets no label of these.
LICENCES = {
    "mit": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
        IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL <<var;least=1;most=12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
        IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    ],
    "bsd-2-clause": [f"{_BSD_TERMS} {_BSD_DISCLAIMER}"],
    "bsd-3-clause": [f"{_BSD_TERMS} {_BSD_NAMES} {_BSD_DISCLAIMER}"],
    "isc": [
        """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or
        without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND <<var;least=1;most=8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;least=1;most=8>> BE LIABLE FOR
        ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
        PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will <<var;least=1;most=8>> be
        held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
        for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: <<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not claim
        that you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required. <<beginOptional>>2.<<endOptional>> Altered source versions must be
        plainly marked as such, and must not be misrepresented as being the original software.
        <<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source distribution.""",
    ],
}

MARK = re.compile(r"<<(var|beginOptional|endOptional)((?:;[^>]*)?)>>")


@dataclass(frozen=True)
class Automaton:
    """Per state: the words it takes with the next state, and the states reached without a word. Any-word arcs have the key None."""

    arcs: tuple[dict[str | None, int], ...]
    free: tuple[tuple[int, ...], ...]
    final: int
    mandatory: int  # words that every match has
    first: frozenset[str]  # words that can start a match
    words: frozenset[str] = frozenset()  # words that stand in every match

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def accepts_without(self, word: str) -> bool:
        """Whether a match exists that takes no arc of ``word``."""
        seen = self.closure({0})
        todo = list(seen)
        while todo:
            for k, t in self.arcs[todo.pop()].items():
                if k != word:
                    new = self.closure({t}) - seen
                    seen |= new
                    todo += new
        return self.final in seen

    def match(self, words: list[str], start: int) -> int | None:
        """End (exclusive) of the longest match that starts at ``start``, or None."""
        states, best = self.closure({0}), None
        for i in range(start, len(words) + 1):
            if self.final in states:
                best = i
            if i == len(words) or not states:
                break
            states = self.closure({t for s in states for k in (words[i], None) if (t := self.arcs[s].get(k)) is not None})
        return best


def compile_template(markup: str) -> Automaton:
    """Build the automaton of a template by walking its words and marks once."""
    arcs: list[dict[str | None, int]] = [{}]
    free: list[list[int]] = [[]]
    mandatory, opened, at = 0, [], 0

    def state() -> int:
        arcs.append({})
        free.append([])
        return len(arcs) - 1

    def step(word: str | None) -> None:
        nonlocal at
        nxt = state()
        arcs[at][word] = nxt
        at = nxt

    place = 0
    for m in [*MARK.finditer(markup), None]:
        for w in WORD.findall(markup[place : m.start() if m else len(markup)].translate(FOLD)):
            step(w)
            mandatory += not opened
        if m is None:
            break
        place = m.end()
        if m[1] == "beginOptional":
            # a state of its own, so that what stands before and inside keep apart
            nxt = state()
            free[at].append(nxt)
            at = nxt
            opened.append(at)
        elif m[1] == "endOptional":
            nxt = state()
            free[at].append(nxt)
            free[opened.pop()].append(nxt)
            at = nxt
        else:
            options = dict(x.split("=") for x in m[2].split(";") if "=" in x)
            least, most = int(options.get("least", 1)), int(options.get("most", 10))
            skips = []
            for k in range(most):
                if k >= least:
                    skips.append(at)
                step(None)
            for s in skips:
                free[s].append(at)
            mandatory += least * (not opened)
    if opened:
        raise ValueError("an optional region isn't closed")
    auto = Automaton(tuple(arcs), tuple(map(tuple, free)), at, mandatory, frozenset())
    first = auto.closure({0})
    if any(None in arcs[s] for s in first) or at in first:
        raise ValueError("a template must start with mandatory or optional wording")
    words = frozenset(w for w in {w for a in arcs for w in a if w is not None} if not auto.accepts_without(w))
    return Automaton(auto.arcs, auto.free, at, mandatory, frozenset(w for s in first for w in arcs[s]), words)


class Scanner:
    """Phrases and templates made ready to scan texts."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]]):
        self.phrases = [(WORD.findall(p.translate(FOLD)), label) for p, label in phrases.items()]
        self.automata = [(label, compile_template(t)) for label, ts in templates.items() for t in ts]
        # words of which a text must have one for anything to match: the last words of phrases, any start of templates
        self.need_phrase = {p[-1] for p, _ in self.phrases}
        self.starts: dict[str, list[tuple[str, Automaton]]] = {}
        for label, a in self.automata:
            for w in a.first:
                self.starts.setdefault(w, []).append((label, a))
        # words that every match of a template has: it runs only where a text has them all
        self.keys = [a.words for _, a in self.automata]

    def scan(self, text: str | None) -> tuple:
        """(n_words, places [(start, label)], spans [(start, end, label, mandatory share)])."""
        words = WORD.findall((text or "").translate(FOLD))
        have = set(words)
        places = []
        if have & self.need_phrase:
            for p, label in self.phrases:
                if have.issuperset(p):
                    places += [(i, label) for i, w in enumerate(words) if w == p[0] and words[i : i + len(p)] == p]
            places.sort()
        spans = []
        if text and any(q in text for q in QUOTES):
            words = [w.strip(QUOTES) for w in words]
            have = set(words)
        if any(have >= k for k in self.keys):
            starts = {w: [x for x in self.starts[w] if have >= x[1].words] for w in have & self.starts.keys()}
            for i, w in enumerate(words):
                for label, a in starts.get(w, ()):
                    if (end := a.match(words, i)) is not None:
                        spans.append((i, end, label, a.mandatory))
        return len(words), places, spans


SCHEMA = "n_words long, places array<struct<start:long,label:string>>, spans array<struct<start:long,end:long,label:string,mandatory:int>>"


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``licenses`` added: struct of n_words, places of phrases, and spans of templates (word offsets).

    Null texts count as empty (no words, no places). Texts are read whole, whatever their length; repeated rows are
    scanned each; an existing column of that name is replaced; an empty table gives an empty result.
    """
    phrases, templates = PHRASES if phrases is None else phrases, {**TEMPLATES, **LICENCES} if templates is None else templates

    @F.pandas_udf(SCHEMA)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(phrases, templates)
        for texts in batches:
            rows = [scanner.scan(t) for t in texts]
            yield pd.DataFrame(
                {
                    "n_words": [r[0] for r in rows],
                    "places": [[{"start": s, "label": k} for s, k in r[1]] for r in rows],
                    "spans": [[{"start": s, "end": e, "label": k, "mandatory": m} for s, e, k, m in r[2]] for r in rows],
                }
            )

    return docs.withColumn("licenses", scan(F.col(text_col)))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every document.

    score: 0 without a label, 0.5 with phrases only, from 0.8 to 1 with templates, by the longest one's mandatory words.
    """
    x = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "licenses.*")
    starts = F.transform("places", lambda p: p.start)
    names = lambda spans: F.transform(spans, lambda s: s.label)
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    most = F.array_max(F.transform("spans", lambda s: s.mandatory))
    score = F.when(F.size("spans") > 0, F.lit(1.0) - F.lit(0.2) / F.greatest(most, F.lit(1))).when(F.size("places") > 0, F.lit(0.5)).otherwise(F.lit(0.0))
    return x.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(names("places")).alias("base_labels"),
        joined(F.concat(names("places"), names("spans"))).alias("labels"),
        score.alias("score"),
    )


SQL: dict[str, str] = {}
