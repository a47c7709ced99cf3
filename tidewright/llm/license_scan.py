"""Licence scans by sentence and rule.

A text's sentences are normalised and mapped to identifiers of known licence sentences; the sequence of identifiers is
then matched against ordered rules, the first and longest that fits at a place giving the licence. A sentence is known
whatever it says is licensed ("this file is", "the software is") and whichever verb it uses for that.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows

#: Known licence sentences (normalised: lower case, words only) by identifier.
SENTENCES = {
    "mit.name": ["released under the mit license", "licensed under the mit license", "the mit license", "mit license", "the mit license mit", "this project is licensed under the mit license", "distributed under the mit license", "available under the mit license"],
    "permission.mit": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "notice.mit": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "asis": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "liability.mit": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "apache2.name": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "released under the apache license version 2 0", "apache license version 2 0", "licensed under the apache 2 0 license", "distributed under the apache license version 2 0", "apache license"],
    "apache2.comply": ["you may not use this file except in compliance with the license"],
    "apache2.copy": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0"],
    "apache2.basis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache2.see": ["see the license for the specific language governing permissions and limitations under the license"],
    "gpl3.name": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3", "gnu general public license version 3", "licensed under gpl v3", "licensed under the gnu gpl v3"],
    "gpl2.name": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "released under the gnu general public license version 2", "gnu general public license version 2", "licensed under gpl v2"],
    "gpl.free3": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl.free2": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "agpl.free3": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "lgpl.free3": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "lgpl.free21": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"],
    "gpl.hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl.details": ["see the gnu general public license for more details"],
    "agpl.details": ["see the gnu affero general public license for more details"],
    "lgpl.details": ["see the gnu lesser general public license for more details"],
    "lgpl.name": ["licensed under the gnu lesser general public license version 3", "licensed under the gnu lesser general public license version 2 1", "gnu lesser general public license"],
    "agpl3.name": ["licensed under the gnu affero general public license version 3", "gnu affero general public license version 3", "gnu affero general public license"],
    "bsd.name": ["licensed under the bsd license", "released under the bsd license", "bsd license"],
    "bsd3.name": ["licensed under the bsd 3 clause license", "released under the bsd 3 clause license", "bsd 3 clause license"],
    "bsd2.name": ["licensed under the bsd 2 clause license", "released under the bsd 2 clause license", "bsd 2 clause license"],
    "bsd.redistribute": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd.source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd.binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd.endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "isc.permission": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "mpl2.subject": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "mpl2.name": ["licensed under the mozilla public license version 2 0", "mozilla public license version 2 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "ccbync4.name": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "ccbysa4.name": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "ccby4.name": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc0.name": ["released under cc0 1 0", "licensed under cc0 1 0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "proprietary": ["all rights reserved"],
}
#: Ordered rules (licence, sequence of sentence identifiers); an identifier with ? may be missing.
RULES = [
    ("MIT", ["mit.name?", "permission.mit", "notice.mit", "asis?", "liability.mit?"]),
    ("Apache-2.0", ["apache2.name", "apache2.comply", "apache2.copy?", "apache2.basis?", "apache2.see?"]),
    ("GPL-3.0-or-later", ["gpl.free3", "gpl.hope?", "gpl.details?"]),
    ("GPL-2.0-or-later", ["gpl.free2", "gpl.hope?", "gpl.details?"]),
    ("AGPL-3.0-or-later", ["agpl.free3", "gpl.hope?", "agpl.details?"]),
    ("LGPL-3.0-or-later", ["lgpl.free3", "gpl.hope?", "lgpl.details?"]),
    ("LGPL-2.1-or-later", ["lgpl.free21", "gpl.hope?", "lgpl.details?"]),
    ("BSD-3-Clause", ["bsd3.name?", "bsd.redistribute", "bsd.source", "bsd.binary", "bsd.endorse"]),
    ("BSD-2-Clause", ["bsd2.name?", "bsd.redistribute", "bsd.source", "bsd.binary"]),
    ("ISC", ["isc.permission", "asis?"]),
    ("MPL-2.0", ["mpl2.subject"]),
    ("Unlicense", ["unlicense"]),
    ("MIT", ["mit.name"]),
    ("Apache-2.0", ["apache2.name"]),
    ("GPL-3.0-only", ["gpl3.name"]),
    ("GPL-2.0-only", ["gpl2.name"]),
    ("LGPL", ["lgpl.name"]),
    ("AGPL-3.0", ["agpl3.name"]),
    ("BSD-3-Clause", ["bsd3.name"]),
    ("BSD-2-Clause", ["bsd2.name"]),
    ("BSD", ["bsd.name"]),
    ("MPL-2.0", ["mpl2.name"]),
    ("CC-BY-NC-4.0", ["ccbync4.name"]),
    ("CC-BY-SA-4.0", ["ccbysa4.name"]),
    ("CC-BY-4.0", ["ccby4.name"]),
    ("CC0-1.0", ["cc0.name"]),
    ("Proprietary", ["proprietary"]),
]
#: What a sentence may say is licensed, and the verbs that all count as "licensed" before "under".
THINGS = ["file", "software", "project", "code", "source code", "program", "library", "package", "module", "work", "document", "repository"]
VERBS = ["licensed", "released", "distributed", "available", "made available", "published", "provided"]
_SUBJECTS = [f"{a}{t} is " for a in ("this ", "the ", "") for t in THINGS]
_SUBJECT = re.compile("|".join(_SUBJECTS))
_VERB = re.compile(rf"(?:{'|'.join(VERBS)}) under (?:the terms of )?")


def plain(sentence: str) -> str:
    """A normalised sentence without its subject, and with one verb for all; applied to known sentences and to texts."""
    sentence = _SUBJECT.sub("", sentence, count=1) if _SUBJECT.match(sentence) else sentence
    return _VERB.sub("licensed under ", sentence, count=1) if _VERB.match(sentence) else sentence


KNOWN = {plain(s): k for k, every in SENTENCES.items() for s in every}
#: Beginnings of known sentences, by words, so that wrapped lines are joined only as far as one may match.
_STARTS = {" ".join(w[:i]) for s in [*KNOWN, *_SUBJECTS, *(f"{v} under the terms of" for v in VERBS)] for w in [s.split()] for i in range(1, len(w) + 1)}
_PIECE = re.compile(r"[^.!?;:\n]+(?:[.:](?=[\w/])[^.!?;:\n]+)*")
_WORD = re.compile(r"[^\W_]+")
_SPDX = re.compile(r"SPDX-License-Identifier:\s*([A-Za-z0-9.+-]+)")
_HINT = re.compile(r"licen[sc]|permission|copyright|redistribution|warrant|public domain|rights reserved|cc0|free software|noninfringement|liable|gpl|cc[\W_]+by", re.I)


def sentence_ids(text: str) -> list[tuple[str, int, int]]:
    """(identifier, start, end) of the known sentences in a text, in order; lines of one sentence may be wrapped."""
    pieces = [(" ".join(w.lower() for w in _WORD.findall(m[0])), m.start(), m.end()) for m in _PIECE.finditer(text)]
    pieces = [p for p in pieces if p[0]]
    out, i = [], 0
    while i < len(pieces):
        joined, best, j = "", None, i
        while j < len(pieces):
            joined = f"{joined} {pieces[j][0]}" if joined else pieces[j][0]
            short = plain(joined)
            if short in KNOWN:
                best = (KNOWN[short], j)
            if short not in _STARTS:
                break
            j += 1
        if best:
            out.append((best[0], pieces[i][1], pieces[best[1]][2]))
            i = best[1]
        i += 1
    return out


def licences(text: str | None) -> list[tuple[str, int, int]]:
    """(licence, start, end) found in a text; null and empty texts have none."""
    if not text or not _HINT.search(text):
        return []
    ids = sentence_ids(text)
    out = [(m[1], *m.span()) for m in _SPDX.finditer(text)]
    i = 0
    while i < len(ids):
        best = (0, "")
        for name, rule in RULES:
            j = i
            for step in rule:
                if j < len(ids) and ids[j][0] == step.rstrip("?"):
                    j += 1
                elif not step.endswith("?"):
                    break
            else:
                if j - i > best[0]:
                    best = (j - i, name)
        if best[0]:
            out.append((best[1], ids[i][1], ids[i + best[0] - 1][2]))
        i += max(1, best[0])
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def find_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each licence found: id, licence, start_char, end_char. Repeated rows repeat theirs; extra columns are not read.

    Null and empty texts give no row, null ids stay null, and an empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = [(r, *x) for r, t in enumerate(batch.column(1).to_pylist()) for x in licences(t)]
        if not found:
            return None
        rows, names, a, b = zip(*found)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(names), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["id", "licence", "start_char", "end_char"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], run, f"id {kind}, licence string, start_char long, end_char long").withColumnRenamed("id", id_col)
